"""Find generated, minified, vendored and data-only source files by layout statistics, with markers and paths in support.

The layout of a file is measured in one pass over its bytes: longest and mean line, share of
white space and of alphanumeric characters, density of numeric literals, share of long
encoded runs, and how serial its numbered names are. The limits on them are set for each
language (``LIMITS``). The layout decides first. A copied or generated file whose layout is
that of hand-written code can only be told by a marker or its path; ``signals`` names what
spoke for each file. Markers count only where a whole comment line has the form a tool or a
copyist writes; code that mentions such banners does not match.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from weftline.llm.file_texts import chunk_parts, with_text

SUFFIXES = ("py", "js", "ts", "go", "java", "css")

#: Comment lines of code generators (fixed values).
GENERATED_LINES = (
    r"code generated by .{1,120}do not edit",
    r"@generated\b",
    r"auto-?generated(?:[: ]|\sfile\b)",
    r"<auto-?generated\b",
    r"(?:this|the) file (?:was|is|has been) (?:automatically|auto-?)\s*generated",
    r"(?:this|the) file (?:was|is) generated (?:by|from)",
    r"generated (?:by|from|with) .{1,160}(?:do not (?:edit|modify)|edits? (?:are|will be) (?:overwritten|lost)|changes will be lost)",
    r"source: .{1,120}produced by",
    r"automatisch (?:erzeugt|generiert)",
    r"g[eé]n[eé]rado autom[aá]ticamente|generado autom[aá]ticamente|archivo generado",
    r"g[eé]n[eé]r[eé] automatiquement",
)
#: Comment lines on copies of foreign code (fixed values).
VENDORED_LINES = (
    r"vendored from \S",
    r"(?:taken|copied) verbatim from\b",
    r"imported (?:unchanged|unmodified|verbatim) from\b",
    r"(?:copied|taken|mirrored) from (?:upstream|the upstream)\b",
    r".{0,120}\bthird[- ]party code\b",
    r"upstream copy of\b",
)
_COMMENT = r"^[ \t]*(?:#|//|/\*+|\*|<!--)!?[ \t]*"
_GENERATED = re.compile(_COMMENT + "(?:" + "|".join(GENERATED_LINES) + ")", re.I | re.M)
_VENDORED = re.compile(_COMMENT + "(?:" + "|".join(VENDORED_LINES) + ")", re.I | re.M)
#: A text without any of these cannot hold a marker line.
_HINTS = (b"generat", b"produced by", b"vendored from", b"verbatim", b"imported un", b"copied from", b"mirrored from", b"taken from", b"third-party", b"third party", b"upstream copy", b"automatisch", b"autom")
_SOURCE_MAP = re.compile(rb"^(?://|/\*)[#@] sourceMappingURL=", re.M)
_SERIAL = re.compile(r"^.*?[A-Za-z_\-.](\d{1,6})(?![\w.%])|^.*?[A-Za-z_](\d{3,6})(?=[_(:])", re.M)
_NUMBER = re.compile(rb"(?<![\w.])(?:0x[0-9a-fA-F]+|\d+(?:\.\d+)?)(?![\w])")
_LONG_RUN = 48

#: Paths of generated and minified files, and of folders that hold foreign packages (fixed values).
GENERATED_PATH = r"(?i)(_pb2(_grpc)?\.pyi?|\.pb\.go|\.pb\.(js|ts)|[a-z0-9]Grpc\.java|\.g\.(js|ts|dart)|\.generated\.\w+|_generated\.(go|py|ts|js))$|/__generated__/"
MINIFIED_PATH = r"(?i)[.-](min|bundle)\.(js|css)$"
VENDORED_PATH = r"(?i)/(vendor|_vendor|third[_-]?party|3rd[_-]?party|node_modules|bower_components|extern|external|deps|site-packages|Pods)/[^/]+/"

#: Limits by language. ``mean_line``, ``max_line``, ``space``: a file with longer lines and less white space is minified;
#: ``wrapped``: so is one with less white space than this, however short its lines; ``number``, ``encoded``: a file with more
#: numeric literals or long encoded runs is data; ``mixed`` and ``alnum``: so is one with fewer encoded runs, but hardly any other
#: character than letters and digits; ``serial``: a file with more consecutively numbered lines is generated.
#: Each lies between the outermost hand-written file and the nearest other one of 6,596 files, about halfway on a log scale (fixed values).
LIMITS = {
    "py": {"mean_line": 200, "max_line": 400, "space": 0.06, "wrapped": 0.02, "number": 0.30, "encoded": 0.65, "mixed": 0.50, "alnum": 0.90, "serial": 0.25},
    "js": {"mean_line": 175, "max_line": 200, "space": 0.065, "wrapped": 0.05, "number": 0.30, "encoded": 0.60, "mixed": 0.45, "alnum": 0.90, "serial": 0.22},
    "ts": {"mean_line": 240, "max_line": 400, "space": 0.06, "wrapped": 0.04, "number": 0.30, "encoded": 0.60, "mixed": 0.45, "alnum": 0.90, "serial": 0.30},
    "go": {"mean_line": 180, "max_line": 300, "space": 0.05, "wrapped": 0.03, "number": 0.30, "encoded": 0.70, "mixed": 0.55, "alnum": 0.92, "serial": 0.20},
    "java": {"mean_line": 200, "max_line": 400, "space": 0.05, "wrapped": 0.03, "number": 0.30, "encoded": 0.60, "mixed": 0.45, "alnum": 0.90, "serial": 0.30},
    "css": {"mean_line": 60, "max_line": 100, "space": 0.05, "wrapped": 0.03, "number": 0.40, "encoded": 0.50, "mixed": 0.40, "alnum": 0.90, "serial": 0.40},
}
#: Signals in the order in which they decide, and the kind that each speaks for.
SIGNALS = {
    "layout: numbers": "data", "layout: encoded": "data", "layout: dense": "minified", "layout: source map": "minified", "layout: serial": "generated",
    "marker: generated": "generated", "path: generated": "generated", "path: vendored": "vendored", "marker: vendored": "vendored", "path: minified": "minified",
}

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True
_ALNUM[128:] = True
_CODED = np.zeros(256, bool)
_CODED[48:58] = _CODED[65:91] = _CODED[97:123] = True
_CODED[[43, 47, 61, 92]] = True

STATS = "path string, n_lines int, max_line int, mean_line double, space_share double, alnum_share double, number_share double, encoded_share double, serial_share double, generated_mark boolean, vendored_mark boolean, source_map boolean"


def serial_share(text: str, n_lines: int) -> float:
    """Share of the lines in a run of names numbered one after another (0 if fewer than four numbers)."""
    numbers = [int(a or b) for a, b in _SERIAL.findall(text)]
    if len(numbers) < 4 or len(set(numbers)) < 4:
        return 0.0
    steps = np.diff(numbers)
    ordered = float(np.mean((steps == 0) | (steps == 1)))
    return len(numbers) / max(1, n_lines) if ordered >= 0.9 else 0.0


def encoded_share(b: np.ndarray) -> float:
    """Share of the bytes in unbroken runs of at least ``_LONG_RUN`` base64 or hex characters."""
    stops = np.flatnonzero(~_CODED[b])
    runs = np.diff(np.concatenate([[-1], stops, [len(b)]])) - 1
    return float(runs[runs >= _LONG_RUN].sum()) / max(1, len(b))


def layout(paths: list[str], texts: list[str]) -> pd.DataFrame:
    """One row of ``STATS`` for each file text."""
    rows = []
    for path, text in zip(paths, texts, strict=True):
        raw = text.encode("utf-8", "surrogatepass")
        b = np.frombuffer(raw, np.uint8)
        n = max(1, len(b))
        ends = np.flatnonzero(b == 10)
        lens = np.diff(np.concatenate([[-1], ends, [len(b)]])) - 1
        used = lens[lens > 0]
        digits = np.count_nonzero((b >= 48) & (b <= 57))
        number = sum(len(m) for m in _NUMBER.findall(raw)) / n if digits > 0.08 * n else 0.0
        low = raw.lower()
        marked = any(h in low for h in _HINTS)
        rows.append((
            path, len(lens), int(lens.max()), float(used.mean()) if len(used) else 0.0,
            np.count_nonzero(_SPACE[b]) / n, np.count_nonzero(_ALNUM[b]) / n, number, encoded_share(b),
            serial_share(text, len(used)) if digits > 0.01 * n else 0.0,
            marked and bool(_GENERATED.search(text)), marked and bool(_VENDORED.search(text)), b"sourceMappingURL" in raw and bool(_SOURCE_MAP.search(raw)),
        ))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in STATS.split(", ")])


def _limit(suffix: Column, name: str) -> Column:
    return F.element_at(F.create_map(*[x for k, v in LIMITS.items() for x in (F.lit(k), F.lit(float(v[name])))]), suffix)


def layout_signals() -> dict[str, Column]:
    """Which layout statistics are beyond the limits of the language (columns ``suffix`` and those of ``STATS``)."""
    limit = lambda name: _limit(F.col("suffix"), name)
    used = F.col("n_lines") > 0
    dense = (F.col("mean_line") > limit("mean_line")) & (F.col("max_line") > limit("max_line")) & (F.col("space_share") < limit("space"))
    wrapped = (F.col("space_share") < limit("wrapped")) & (F.col("mean_line") > 60) & (F.col("alnum_share") > 0.5)
    encoded = (F.col("encoded_share") > limit("encoded")) | ((F.col("encoded_share") > limit("mixed")) & (F.col("alnum_share") > limit("alnum")))
    return {
        "layout: numbers": used & (F.col("number_share") > limit("number")), "layout: encoded": used & encoded, "layout: dense": used & (dense | wrapped),
        "layout: source map": F.col("source_map") & (F.col("space_share") < 0.10), "layout: serial": F.col("serial_share") > limit("serial"),
    }


def not_handwritten(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """A row for every file of ``SUFFIXES``: (path, suffix, kind, signals, and the layout statistics).

    ``kind``: generated, minified, vendored, data, or null for hand-written files; that of the first of its
    ``signals``, of which the layout comes first. Paths are compared as they are and count once; null paths have
    no row. A file without chunks is judged by its path alone, an empty one has statistics of 0. Nulls in other
    columns, and extra columns, have no effect.
    """
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    paths = files.where(F.col("path").isNotNull()).select("path", suffix.alias("suffix")).where(F.col("suffix").isin(*SUFFIXES)).distinct()
    stats = with_text(chunk_parts(chunks, SUFFIXES), layout, STATS)
    holds = layout_signals() | {
        "marker: generated": F.col("generated_mark"), "path: generated": F.col("path").rlike(GENERATED_PATH), "path: vendored": F.col("path").rlike(VENDORED_PATH),
        "marker: vendored": F.col("vendored_mark"), "path: minified": F.col("path").rlike(MINIFIED_PATH),
    }
    signals = F.array_compact(F.array(*[F.when(holds[name], name) for name in SIGNALS]))
    kind_of = F.create_map(*[F.lit(x) for pair in SIGNALS.items() for x in pair])
    df = paths.join(stats, "path", "left").withColumn("signals", signals)
    return df.withColumn("kind", F.when(F.size("signals") > 0, F.element_at(kind_of, F.get("signals", F.lit(0)))))
