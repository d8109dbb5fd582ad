"""Line tables, chunk ids, gaps between symbols, and symbols of Python files."""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.schemas import SYMBOL_SCHEMA


def chunk_id(path: Column, start: Column, end: Column) -> Column:
    """First 12 digits of md5("path:start-end")."""
    return F.substring(F.md5(F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))), 1, 12)


def lines(texts: DataFrame) -> DataFrame:
    """(file_path, line, content) of texts (file_path, text), lines counted from 0. Null texts have none, an empty one has one line."""
    return texts.select("file_path", F.posexplode(F.split("text", "\n")).alias("line", "content"))


def file_lines(chunks: DataFrame) -> DataFrame:
    """(file_path, line, content): the lines of the files that the chunks cover, each once (overlaps hold the same line)."""
    each = chunks.where("file_path IS NOT NULL AND content IS NOT NULL AND start_line >= 0").select(
        "file_path", "start_line", F.posexplode(F.split("content", "\n")).alias("_i", "content")
    )
    return each.groupBy("file_path", (F.col("start_line") + F.col("_i")).alias("line")).agg(F.max("content").alias("content"))


def file_texts(chunks: DataFrame) -> DataFrame:
    """(file_path, text): the whole texts of the files that the chunks (file_path, start_line, content) cover. One file is one row, as is its text."""
    parts = chunks.where("file_path IS NOT NULL AND content IS NOT NULL AND start_line >= 0").groupBy("file_path").agg(F.collect_set(F.struct("start_line", "content")).alias("parts"))

    @F.pandas_udf("string")
    def join(files: pd.Series) -> pd.Series:
        out = []
        for parts in files:
            lines: dict[int, str] = {}
            for p in parts:
                for i, line in enumerate(p["content"].split("\n"), p["start_line"]):
                    lines[i] = max(line, lines.get(i, line))
            out.append("\n".join(lines.get(i, "") for i in range(max(lines) + 1)))
        return pd.Series(out)

    return parts.select("file_path", join("parts").alias("text"))


def gaps(lines_df: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, file_path, start_line, end_line, content): maximal runs of lines that no symbol covers; blank runs are dropped."""
    covered = symbols.select("file_path", F.explode(F.sequence("start_line", "end_line")).alias("line")).distinct()
    free = lines_df.join(covered, ["file_path", "line"], "left_anti")
    island = F.col("line") - F.row_number().over(Window.partitionBy("file_path").orderBy("line"))
    runs = free.withColumn("_island", island).groupBy("file_path", "_island").agg(
        F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.sort_array(F.collect_list(F.struct("line", "content"))).alias("_l")
    )
    text = F.array_join(F.transform("_l", lambda x: x["content"]), "\n")
    out = runs.select("file_path", "start_line", "end_line", text.alias("content")).where(F.trim(F.regexp_replace("content", r"\s+", "")) != "")
    return out.select(chunk_id(F.col("file_path"), F.col("start_line"), F.col("end_line")).alias("id"), "file_path", "start_line", "end_line", "content")


def first_symbols(symbols: DataFrame) -> DataFrame:
    """Symbols once per (file_path, name, start_line, end_line), the first by type."""
    by = Window.partitionBy("file_path", "name", "start_line", "end_line").orderBy("type")
    return symbols.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def enclosing_class(symbols: DataFrame) -> DataFrame:
    """(file_path, name, start_line, end_line, parent): the innermost class of the file around each function or method.

    A join on the file with a containment test; the innermost is the one that begins last.
    """
    classes = symbols.where("type = 'class'").select("file_path", F.col("name").alias("_c"), F.col("start_line").alias("_s"), F.col("end_line").alias("_e"))
    inner = symbols.where("type IN ('function', 'method')").select("file_path", "name", "start_line", "end_line")
    around = inner.join(classes, "file_path", "left").withColumn("_c", F.when((F.col("_s") <= F.col("start_line")) & (F.col("_e") >= F.col("end_line")), F.col("_c")))
    return around.groupBy("file_path", "name", "start_line", "end_line").agg(F.max_by("_c", F.when(F.col("_c").isNotNull(), F.struct("_s", "_c"))).alias("parent"))


def python_symbols(texts: DataFrame) -> DataFrame:
    """Classes, functions, methods and imports of Python texts (file_path, text); files that do not parse have none."""

    def symbols_of(path: str, text: str) -> Iterator[tuple]:
        rows = text.split("\n")

        def walk(node: ast.AST, parent: str | None) -> Iterator[tuple]:
            for child in ast.iter_child_nodes(node):
                kind = {"ClassDef": "class", "FunctionDef": "function", "AsyncFunctionDef": "function", "Import": "import", "ImportFrom": "import"}.get(type(child).__name__)
                if kind:
                    a, b = child.lineno - 1, child.end_lineno - 1
                    body = "\n".join(rows[a : b + 1])
                    name = getattr(child, "name", None) or body.strip()
                    yield path, name, "method" if kind == "function" and parent else kind, a, b, parent, body
                yield from walk(child, child.name if kind == "class" else parent)

        try:
            yield from walk(ast.parse(text), None)
        except (SyntaxError, ValueError, RecursionError):
            return

    return texts.where("text IS NOT NULL").select("file_path", "text").mapInPandas(_symbol_rows(symbols_of), SYMBOL_SCHEMA)


_BLANKED = re.compile(
    r"//[^\n]*|/\*.*?\*/|`(?:[^`\\]|\\.)*`|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|(?<=[=(,:\[!&|?{};\s])/(?![/*\s])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/(?=[\s.,;)\]gimsuy])", re.S
)
_TOP = re.compile(r"^[ \t]*((?:export[ \t]+)?(?:default[ \t]+)?(?:(?:abstract|async|declare)[ \t]+)*(class|function)\b[ \t]*\*?[ \t]*([A-Za-z_$][\w$]*))", re.M)
_METHOD = re.compile(r"^[ \t]*((?:(?:static|async|get|set|public|private|protected|override|abstract|readonly)[ \t]+)*\*?[ \t]*(#?[A-Za-z_$][\w$]*))[ \t]*(?:<[^>\n]*>)?[ \t]*\(", re.M)
_NO_METHOD = frozenset("if for while switch catch return function new typeof await super".split())
_PAIRS = {")": "(", "]": "[", "}": "{"}


def bracket_symbols(texts: DataFrame) -> DataFrame:
    """Classes, functions and methods of JavaScript and TypeScript texts (file_path, text), by their first lines and matching brackets.

    Comments, strings and regular expressions are blanked first. A text whose brackets do not match has the symbols that close.
    """

    def symbols_of(path: str, text: str) -> Iterator[tuple]:
        bare = _BLANKED.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
        ends, stack = {}, []
        for m in re.finditer(r"[()\[\]{}]", bare):
            c = m.group()
            if c in "([{":
                stack.append((c, m.start()))
            elif stack and stack[-1][0] == _PAIRS[c]:
                ends[stack.pop()[1]] = m.start()
        starts = [0, *(m.end() for m in re.finditer("\n", text))]
        rows = text.split("\n")
        line = lambda at: bisect_right(starts, at) - 1

        def body(at: int) -> int | None:
            """Where the block ends that a declaration opens, whose name ends at ``at``."""
            while True:
                m = re.compile(r"[({;]").search(bare, at)
                if not m or m.group() == ";":
                    return None
                if m.group() == "{":
                    return ends.get(m.start())
                at = ends.get(m.start(), len(bare))

        def row(m: re.Match, kind: str, name: str, end: int, parent: str | None) -> tuple:
            a, b = line(m.start(1)), line(end)
            return path, name, kind, a, b, parent, "\n".join(rows[a : b + 1])

        for m in _TOP.finditer(bare):
            end = body(m.end())
            if end is None:
                continue
            yield row(m, m.group(2), m.group(3), end, None)
            if m.group(2) != "class":
                continue
            at = bare.index("{", m.end()) + 1
            while at < end:  # members stand directly in the class
                k = _METHOD.match(bare, at) if at == 0 or bare[at - 1] in "\n{};" else None
                if k and k.group(2) not in _NO_METHOD and (stop := body(k.end() - 1)) is not None and stop < end:
                    yield row(k, "method", k.group(2), stop, m.group(3))
                    at = stop + 1
                    continue
                nxt = re.compile(r"[({\[\n;]").search(bare, at)
                if not nxt:
                    break
                at = ends.get(nxt.start(), nxt.start()) + 1

    return texts.where("text IS NOT NULL").select("file_path", "text").mapInPandas(_symbol_rows(symbols_of), SYMBOL_SCHEMA)


def _symbol_rows(symbols_of):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [s for p, t in zip(pdf["file_path"], pdf["text"], strict=True) for s in symbols_of(p, t)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SYMBOL_SCHEMA.split(", ")])

    return run
