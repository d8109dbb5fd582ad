"""Expansion and reranking of hits, and summaries of recorded agent runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.functions.text import code_tokens
from weftline.operators.lexical import bm25_scores, bm25_top, top_k
from weftline.session import cut_lineage

#: Words that speak for a role, in the order in which roles win ties (fixed values).
ROLE_WORDS = {
    "coder": ("implement", "write", "create", "add", "refactor", "change", "update", "edit", "build", "make", "fix", "modify"),
    "debugger": ("debug", "fix the bug", "why is", "failing", "failure", "crash", "traceback", "error", "exception"),
    "tester": ("test", "run tests", "pytest", "unit test", "regression"),
    "reviewer": ("review", "check", "verify", "audit", "code quality", "lint"),
    "researcher": ("understand", "explain", "where", "how does", "what does", "locate", "find", "search", "research", "investigate the code", "architecture", "overview", "summarize", "summarise"),
}
#: Tools whose calls count as retrieval (fixed values).
RETRIEVAL_TOOLS = ("search_code", "find_symbol", "find_definition", "find_references", "get_context", "get_dependencies")


def expand_by_parent(hits: DataFrame, docs: DataFrame, *, tries: int = 3, least: float = 0.1) -> DataFrame:
    """(qid, base_id, id, score): for each hit (qid, id, parent) the best text for its parent's name that is no hit of the query.

    The parents of all hits are searched as one set of queries; of the best ``tries`` texts of each, the first
    over ``least`` that is not yet among the query's hits is taken. A text found for two hits goes to the first by id.
    """
    asked = hits.where("parent IS NOT NULL AND parent <> ''").select("qid", F.col("id").alias("base_id"), "parent")
    found = top_k(bm25_scores(asked.select(F.col("parent").alias("qid"), F.col("parent").alias("text")).distinct(), docs), tries).where(F.col("score") > least)
    rows = asked.join(found.select(F.col("qid").alias("parent"), "id", "score", "rank"), "parent").join(hits.select("qid", "id"), ["qid", "id"], "left_anti")
    per_hit = rows.withColumn("_n", F.row_number().over(Window.partitionBy("qid", "base_id").orderBy("rank"))).where("_n = 1")
    return per_hit.withColumn("_m", F.row_number().over(Window.partitionBy("qid", "id").orderBy("base_id"))).where("_m = 1").select("qid", "base_id", "id", "score")


def expand_hits(hits: DataFrame, docs: DataFrame, *, tries: int = 3, least: float = 0.1) -> DataFrame:
    """(qid, base_id, id, score, reason): up to two more texts for each hit (qid, id, rank, symbol, symbol_type, parent).

    A method or function looks for its parent's name, then every hit for 'import <symbol>', of which a text counts
    with 'import' in its first 100 characters. Of the best ``tries`` texts over ``least`` each takes the first
    that is no hit of the query and that no earlier hit has taken. A query's candidates are its hits, twice ``tries``, folded in order.
    """
    base = hits.select("qid", F.col("id").alias("base_id"), F.col("rank").alias("place"), "symbol", "symbol_type", "parent")
    up = base.where("parent <> '' AND symbol_type IN ('method', 'function')").select("qid", "base_id", "place", F.lit(0).alias("branch"), F.col("parent").alias("text"))
    imports = base.select("qid", "base_id", "place", F.lit(1).alias("branch"), F.concat(F.lit("import "), F.coalesce("symbol", F.lit(""))).alias("text"))
    asked = cut_lineage(up.unionByName(imports))
    found = top_k(bm25_scores(asked.select(F.col("text").alias("qid"), "text").distinct(), docs), tries).where(F.col("score") > least)
    starts = docs.select("id", F.coalesce(F.contains(F.substring("text", 1, 100), F.lit("import")), F.lit(False)).alias("imports"))
    rows = asked.join(found.select(F.col("qid").alias("text"), "id", "score", "rank"), "text").join(starts, "id").where("branch = 0 OR imports")
    rows = rows.join(hits.select("qid", "id"), ["qid", "id"], "left_anti")
    listed = rows.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("place", "base_id", "branch", "rank", "id", "score"))).alias("_c"))
    fold = F.expr(
        """aggregate(_c, filter(_c, x -> false), (s, x) -> CASE
             WHEN exists(s, y -> y.id = x.id OR (y.base_id = x.base_id AND y.branch = x.branch)) THEN s ELSE concat(s, array(x)) END)"""
    )
    taken = listed.select("qid", F.explode(fold).alias("_t"))
    return taken.select("qid", "_t.base_id", "_t.id", "_t.score", F.when(F.col("_t.branch") == 0, "parent").otherwise("import").alias("reason"))


def rerank(hits: DataFrame, scorer: Callable[[Column, Column], Column] | None, k: int) -> DataFrame:
    """The best ``k`` of each query by ``scorer``(query text, content); without a scorer the given ranks stay.

    hits: (qid, id, text, content, rank). A scorer is any column function, a pandas UDF around a model included;
    it gets the whole content, and one with a limit cuts it itself.
    """
    if scorer is None:
        return hits.where(F.col("rank") <= k)
    scored = hits.drop("rank").withColumn("score", F.round(scorer(F.col("text"), F.col("content")), 6))
    return top_k(scored, k)


def word_overlap(query: Column, content: Column) -> Column:
    """Share of the query's code words that the content holds; a scorer that needs no model."""
    q = F.array_distinct(code_tokens(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, code_tokens(content))) / F.size(q)).otherwise(0.0)


def overlap_of_words(query: Column, words: Column) -> Column:
    """``word_overlap`` with a content of which the words are known, with spaces between."""
    q = F.array_distinct(code_tokens(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, F.split(words, " "))) / F.size(q)).otherwise(0.0)


def best_overlaps(queries: DataFrame, docs: DataFrame, tries: int, k: int) -> DataFrame:
    """(qid, id, score, rank): rows as those of ``rerank`` by ``word_overlap`` over the best ``tries`` docs (id, text) of each query (qid, text).

    The search itself counts the words of a query that a doc holds, so that no text is sent on to be compared.
    """

    def share(hits: DataFrame) -> DataFrame:
        return top_k(hits.select("qid", "id", F.round(F.col("held") / F.size(F.array_distinct(code_tokens(F.col("qid")))), 6).alias("score")), k)

    return bm25_top(queries, docs, tries, share)


def assign_role(task: Column) -> Column:
    """The role with the most keywords in the task; ties go by the order of ``ROLE_WORDS``; null without any."""
    low = F.lower(task)
    hits = {role: sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)) for role, words in ROLE_WORDS.items()}
    best = F.greatest(*hits.values())
    out = F.lit(None).cast("string")
    for role in reversed(ROLE_WORDS):
        out = F.when(hits[role] == best, role).otherwise(out)
    return F.when(best > 0, out)


def agent_runs(messages: DataFrame) -> DataFrame:
    """A row per conversation: iterations, tool calls, distinct retrieval tools, tokens, seconds, and whether it ended without an error."""
    calls = messages.select("conv_id", F.explode("tool_calls").alias("c")).groupBy("conv_id").agg(
        F.count("*").alias("tool_calls"), F.countDistinct(F.when(F.col("c.name").isin(*RETRIEVAL_TOOLS), F.col("c.name"))).alias("retrieval_tools")
    )
    base = messages.groupBy("conv_id").agg(
        F.sum(F.when(F.col("type") == "assistant", 1).otherwise(0)).alias("iterations"), F.floor(F.sum(F.coalesce(F.length("content"), F.lit(0))) / 4).alias("tokens"),
        F.max_by("type", "turn").alias("_last"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return base.join(calls, "conv_id", "left").select("conv_id", "iterations", "tokens", zero("tool_calls"), zero("retrieval_tools"), (F.col("_last") != "error").alias("success"))


def run_summary(runs: DataFrame) -> DataFrame:
    """One row: number of runs, success rate and means; zeros for no runs."""
    mean = lambda c: F.coalesce(F.round(F.avg(c), 4), F.lit(0.0)).alias(f"mean_{c}")
    return runs.agg(F.count("*").alias("n"), F.coalesce(F.round(F.avg(F.col("success").cast("int")), 4), F.lit(0.0)).alias("success_rate"), *[mean(c) for c in ("iterations", "tokens", "tool_calls", "retrieval_tools")])


def merge_states(first: Column, second: Column) -> Column:
    """Two maps of lists merged key by key, the lists one after the other."""
    return F.map_zip_with(first, second, lambda _, a, b: F.concat(F.coalesce(a, F.array()), F.coalesce(b, F.array())))


def plan_items(text: Column) -> Column:
    """Steps of a JSON list in a text, fenced or not: array of (title, priority, depends_on); null if there is none."""
    listed = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    return F.from_json(F.nullif(listed, F.lit("")), "array<struct<title:string,priority:int,depends_on:array<string>>>")
