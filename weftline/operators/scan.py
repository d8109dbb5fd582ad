"""Line search, pattern scans and sanitising, file listings, edits and logs."""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.operators.blocks import in_blocks
from weftline.operators.lexical import once_per_text, top_k

BLOCK_QUERIES, BLOCK_TEXTS = 120_000, 20_000
#: Instructions aimed at an assistant: (kind, pattern), matched without case (fixed values).
INJECTION_PATTERNS = (
    ("instruction override", r"ignore (all |any |the )?(previous|above|prior|earlier) (instructions|prompts|messages|context|directions)"),
    ("instruction override", r"disregard (all |the )?(previous|above|prior|earlier) (instructions|prompts|messages|context)"),
    ("role hijack", r"you (are|must act as|now act as|are now) (a |an )?(different|new) (assistant|agent|AI|model|system)"),
    ("role hijack", r"you are now (a |an )?(assistant|agent|AI|model|system) named"),
    ("memory wipe", r"forget (everything|all previous|the system prompt)"),
    ("exfiltration request", r"(reveal|show|print|output|send|exfiltrate).{0,40}(system prompt|instructions|api key|secrets|credentials)"),
    ("prompt leak", r"(system|developer) prompt.{0,30}(reveal|show|leak|expose)"),
    ("concealment", r"do not tell (the user|anyone|humans)"),
    ("false denial", r"say you (can't|cannot|did not|didn't) (do|perform|complete) (it|the task)"),
    ("conditional trigger", r"if you (see|find|read) (this|the following)"),
    ("embedded system tag", r"<[^>]*system[^>]*>"),
    ("emphasis instruction", r"\*\*important\*\*:?\s*you"),
    ("constrained reply", r"reply with (only|just) (yes|no|ok)"),
)
#: Sources whose findings are cut out; all others are marked (fixed values).
STRIP_SOURCES = ("web", "mcp")
#: Simple secret patterns: (kind, pattern) (fixed values).
SECRET_PATTERNS = (
    ("github_token", r"gh[pousr]_[A-Za-z0-9]{20,}"),
    ("aws_key", r"AKIA[0-9A-Z]{16}"),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("key_value", r"(?i)(password|passwd|secret|token|api_key|apikey)\s*[=:]\s*[^\s,;]{8,}"),
)
#: Paths that a scan skips, as regexes of ignore patterns (fixed values).
IGNORED = (
    r"(^|/)(\.git|\.venv|venv|node_modules|__pycache__)/",
    r"\.(pyc|so|dylib|dll|exe|bin|jpg|jpeg|png|gif|ico|pdf|mp3|mp4|zip|tar\.gz)$",
    r"(^|/)\.DS_Store$",
)


def grep_lines(texts: DataFrame, pattern: str, *, ignore_case: bool = False, suffixes: tuple[str, ...] | None = None) -> DataFrame:
    """(id, file_path, line_no, line): lines that match, counted from 1 within the text, without white space at their end.

    texts: (id, file_path, content). Null contents have no lines.
    """
    rows = texts if suffixes is None else texts.where(F.lower(F.regexp_extract("file_path", r"\.([^./]+)$", 1)).isin(*suffixes))
    rx = f"(?i){pattern}" if ignore_case else pattern
    rows = rows.where(F.col("content").rlike(rx))  # most texts end here
    each = rows.select("id", "file_path", F.posexplode(F.split("content", "\n")).alias("_i", "_l")).where(F.col("_l").rlike(rx))
    return each.select("id", "file_path", (F.col("_i") + 1).alias("line_no"), F.regexp_replace("_l", r"[ \t\r]+$", "").alias("line"))


def has_all_tokens(text: Column, query: Column) -> Column:
    """Whether the text holds every word of the query as a substring, without case."""
    words = F.filter(F.split(F.lower(query), r"[ \t\n\r]+"), lambda w: w != "")
    return F.forall(words, lambda w: F.contains(F.lower(text), w))


def all_tokens_hits(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank): for each query (qid, text) the first ``k`` ids of docs (id, content) that hold all its words; the score is 1.

    Distinct texts are tested against all docs, block by block; a cell keeps the first ``k`` of each. Queries without words find nothing.
    A cell looks for the words' runs of letters and digits in the distinct runs of its docs, and reads whole docs only for words with other characters.
    """
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[ \t\n\r]+"), lambda w: w != ""))
    lower = docs.where("content IS NOT NULL").select("id", F.lower("content").alias("content"))

    def meet(q_rows: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        ids, texts = rows["id"].to_numpy(), rows["content"].tolist()
        places = _word_places({w for found in q_rows["words"] for w in found}, texts)
        qids, at = [], []
        for qid, found in zip(q_rows["qid"], q_rows["words"], strict=True):
            held = sorted((places[w] for w in found), key=len)
            got = list(islice((i for i in held[0] if all(_holds(o, i) for o in held[1:])), k))
            qids += [qid] * len(got)
            at += got
        return pd.DataFrame({"qid": qids, "id": ids[np.array(at, np.int64)], "score": 1.0}).astype({"qid": str, "id": str, "score": float})

    def search(asked: DataFrame) -> DataFrame:
        some = asked.select("qid", words.alias("words")).where(F.size("words") > 0)
        return top_k(in_blocks(some, lower, meet, "qid string, id string, score double", query_rows=BLOCK_QUERIES, rows_a_block=BLOCK_TEXTS), k)

    return once_per_text(queries, search)


def _holds(places: list[int], i: int) -> bool:
    at = bisect_left(places, i)
    return at < len(places) and places[at] == i


def _word_places(words: set[str], texts: list[str]) -> dict[str, list[int]]:
    """The places, in order, of the texts that hold each word (all in lower case).

    A word's longest run of ``[a-z0-9_]`` lies within such a run of every text that holds the word.
    """
    run = re.compile("[a-z0-9_]+")
    longest = {w: max(run.findall(w), key=len, default="") for w in words}
    sought, lengths = set(longest.values()) - {""}, sorted({len(r) for r in longest.values()} - {0})
    holding: dict[str, tuple[str, ...]] = {}  # distinct run of the texts: what it holds of those sought
    places: dict[str, list[int]] = {r: [] for r in sought}
    for i, text in enumerate(texts):
        here = set()
        for token in set(run.findall(text)):
            if (held := holding.get(token)) is None:
                n = len(token)
                held = holding[token] = tuple({part for m in lengths if m <= n for j in range(n - m + 1) if (part := token[j : j + m]) in sought})
            here.update(held)
        for r in here:
            places[r].append(i)
    return {w: places[r] if w == r else [i for i in (places[r] if r else range(len(texts))) if w in texts[i]] for w, r in longest.items()}


def pattern_counts(texts: DataFrame, patterns: tuple[tuple[str, str], ...], *, ignore_case: bool) -> DataFrame:
    """(id, kind, n): matches of each kind in texts (id, content); kinds without a match have no row."""
    flag = "(?i)" if ignore_case else ""
    found = [F.struct(F.lit(kind).alias("kind"), F.regexp_count("content", F.lit(flag + p)).alias("n")) for kind, p in patterns]
    each = texts.where("content IS NOT NULL").select("id", F.explode(F.array(*found)).alias("_x")).where("_x.n > 0")
    return each.groupBy("id", "_x.kind").agg(F.sum("_x.n").alias("n"))


def matches(texts: DataFrame, patterns: tuple[tuple[str, str], ...], *, ignore_case: bool) -> DataFrame:
    """(id, kind, found, n): what matched in texts (id, content), and how often."""
    flag = "(?i)" if ignore_case else ""
    as_kind = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("found"))
    found = F.concat(*[F.transform(F.regexp_extract_all("content", F.lit(flag + p), F.lit(0)), as_kind(kind)) for kind, p in patterns])
    each = texts.where("content IS NOT NULL").select("id", F.explode(found).alias("_x"))
    return each.groupBy("id", "_x.kind", "_x.found").agg(F.count("*").alias("n"))


def checked_output(text: Column) -> Column:
    """Output of a foreign tool: secrets redacted, then instructions to assistants cut out."""
    return sanitize(redact(text), F.lit("mcp"))


def sanitize(text: Column, source: Column) -> Column:
    """Text with instructions to assistants cut out (``STRIP_SOURCES``) or marked; overlapping matches become one."""
    compiled = [(kind, re.compile(p, re.I)) for kind, p in INJECTION_PATTERNS]

    @F.pandas_udf("string")
    def run(texts: pd.Series, sources: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(texts, sources, strict=True):
            if t:
                hits = sorted((m.start(), -m.end(), kind) for kind, rx in compiled for m in rx.finditer(t))
                parts, at = [], 0
                for start, end, kind in hits:
                    if start >= at:
                        parts += [t[at:start], "[redacted]" if s in STRIP_SOURCES else f"[INJECTION DETECTED ({kind})]"]
                    at = max(at, -end)
                t = "".join([*parts, t[at:]])
            out.append(t)
        return pd.Series(out)

    return run(text, source)


def redact(text: Column) -> Column:
    """Text with the simple secret patterns replaced by ***REDACTED***."""
    return reduce(lambda c, p: F.regexp_replace(c, p[1], "***REDACTED***"), SECRET_PATTERNS, text)


def replace_first(text: Column, old: str, new: str, count: int = 1) -> Column:
    """Text with the first ``count`` occurrences of ``old`` replaced (0: all)."""
    if count == 0:
        return F.replace(text, F.lit(old), F.lit(new))
    parts = F.split(text, re.escape(old))
    head = F.slice(parts, 1, count + 1)
    return F.when(text.isNull(), None).when(F.size(parts) <= count + 1, F.array_join(parts, new)).otherwise(
        F.concat_ws(old, F.array_join(head, new), F.array_join(F.slice(parts, count + 2, 2**31 - 1), old))
    )


def occurrences(text: Column, old: str) -> Column:
    """How often ``old`` stands in the text, without overlaps."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(old), F.lit("")))) / len(old))


def is_ignored(path: Column) -> Column:
    """Whether a scan skips the path."""
    return path.rlike("|".join(f"(?:{p})" for p in IGNORED))


def listing(files: DataFrame, depth: int) -> DataFrame:
    """(folder, name, is_dir, n_files): entries of each folder down to ``depth`` levels, hidden names left out."""
    parts = F.split("path", "/")
    levels = files.select("path", parts.alias("_p"), F.explode(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depth)))).alias("_d"))
    entry = levels.select(
        F.array_join(F.slice("_p", 1, F.col("_d") - 1), "/").alias("folder"), F.element_at("_p", F.col("_d")).alias("name"), (F.col("_d") < F.size("_p")).alias("is_dir")
    )
    return entry.where(~F.col("name").startswith(".")).groupBy("folder", "name", "is_dir").agg(F.count("*").alias("n_files"))


def parse_test_logs(logs: DataFrame) -> DataFrame:
    """Counts and seconds of test logs (run_id, raw); the order of the counts in the summary does not matter."""
    num = lambda p: F.coalesce(F.nullif(F.regexp_extract("raw", p, 1), F.lit("")).cast("double"), F.lit(0.0))
    out = logs.select("run_id", *[num(rf"(\d+) {w}").cast("int").alias(w) for w in ("passed", "failed", "error")], num(r"in ([\d.]+)s").alias("seconds"))
    return out.withColumn("total", F.col("passed") + F.col("failed") + F.col("error"))


def failures(logs: DataFrame) -> DataFrame:
    """(run_id, test, error_type, message, file_path, line): a row per failure block of a log."""
    block = logs.select("run_id", F.explode(F.split("raw", "_{20,}")).alias("b")).where(F.col("b").rlike("FAILED|ERROR"))
    get = lambda p, i: F.regexp_extract("b", p, i)
    error = r"([\w.]+Error|AssertionError|Exception):\s*(.+)"
    where = r'File "(.+?)", line (\d+)'
    return block.select(
        "run_id", F.coalesce(F.nullif(get(r"FAILED (.+?)(?:\s|$)", 1), F.lit("")), F.lit("unknown")).alias("test"), F.coalesce(F.nullif(get(error, 1), F.lit("")), F.lit("TestError")).alias("error_type"),
        F.trim(get(error, 2)).alias("message"), get(where, 1).alias("file_path"), F.coalesce(F.nullif(get(where, 2), F.lit("")).cast("int"), F.lit(0)).alias("line"),
    )


def compare_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """(run_id, passed_before, passed_after, regressions, new_failures, mended, success) of test logs (run_id, raw) before and after a change.

    ``regressions`` counts the tests that pass no more by the summaries; ``new_failures`` and ``mended`` name tests by their failure blocks.
    """
    a, b = (parse_test_logs(x).select("run_id", F.col("passed").alias(f"passed_{w}"), (F.col("failed") + F.col("error")).alias(f"_bad_{w}")) for x, w in ((before, "before"), (after, "after")))
    named = lambda x, w: failures(x).groupBy("run_id").agg(F.collect_set("test").alias(f"_f_{w}"))  # noqa: E731  # one log's tests
    both = a.join(b, "run_id").join(named(before, "before"), "run_id", "left").join(named(after, "after"), "run_id", "left")
    none = F.array().cast("array<string>")
    old, new = F.coalesce("_f_before", none), F.coalesce("_f_after", none)
    gone = F.greatest(F.col("passed_before") - F.col("passed_after"), F.lit(0))
    return both.select(
        "run_id", "passed_before", "passed_after", gone.alias("regressions"), F.sort_array(F.array_except(new, old)).alias("new_failures"), F.sort_array(F.array_except(old, new)).alias("mended"),
        ((gone == 0) & (F.col("_bad_after") == 0)).alias("success"),
    )


def test_frameworks(files: DataFrame) -> DataFrame:
    """(repo, framework): by marker files: pytest, npm, cargo or unknown."""
    base = F.element_at(F.split("path", "/"), -1)
    any_ = lambda p: F.bool_or(base.rlike(p))
    per = files.groupBy(F.split("path", "/")[0].alias("repo")).agg(any_(r"(?i)^test_.*\.py$|_test\.py$").alias("_py"), any_(r"^package\.json$").alias("_npm"), any_(r"^Cargo\.toml$").alias("_cargo"))
    return per.select("repo", F.when(F.col("_py"), "pytest").when(F.col("_npm"), "npm").when(F.col("_cargo"), "cargo").otherwise("unknown").alias("framework"))


def language_histogram(files: DataFrame, k: int = 10) -> DataFrame:
    """(language, n): the ``k`` most frequent languages by suffix."""
    from weftline.functions.text import language_of

    counts = files.select(language_of(F.col("path")).alias("language")).where("language IS NOT NULL").groupBy("language").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "language").limit(k)


def top_lines(grep: DataFrame, k: int) -> DataFrame:
    """The first ``k`` lines of each file."""
    by = Window.partitionBy("file_path").orderBy("line_no", "id")
    return grep.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= k).drop("_n")
