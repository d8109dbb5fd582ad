"""Context for a reader: filters, duplicates, order, truncation and packing to a budget of characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from weftline.functions.text import compress_code, word_set
from weftline.session import cut_lineage


def min_score(hits: DataFrame, least: float = 0.01) -> DataFrame:
    """Hits with final_score, else rrf_score, of at least ``least``; hits without any score stay."""
    return hits.where(F.coalesce("final_score", "rrf_score", F.lit(0.99)) >= least)


def exact_dedup(rows: DataFrame, text: str, order: list[str]) -> DataFrame:
    """The first row of each text by ``order``; null texts count as one text."""
    by = Window.partitionBy(F.md5(F.coalesce(text, F.lit("")))).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def type_rank(symbol_type):
    """Imports 0, classes and modules 1, functions and methods 2, others 3."""
    return F.when(symbol_type == "import", 0).when(symbol_type.isin("class", "module"), 1).when(symbol_type.isin("function", "method"), 2).otherwise(3)


def truncate_to_target(rows: DataFrame, target_chars: int, group: str) -> DataFrame:
    """Where a group's texts exceed the target, each is cut to an equal part of it, with a marker."""
    w = Window.partitionBy(group)
    n, total = F.count("*").over(w), F.sum(F.length("content")).over(w)
    part = F.floor(F.lit(target_chars) / F.col("_n")).cast("int")
    cut = F.when((F.col("_t") > target_chars) & (F.length("content") > part), F.concat(F.substring("content", F.lit(1), part), F.lit("\n... [truncated]"))).otherwise(F.col("content"))
    return rows.withColumn("_n", n).withColumn("_t", total).withColumn("content", cut).drop("_n", "_t")


def within_budget(rows: DataFrame, group: str, order: list, size: str, budget: int) -> DataFrame:
    """The first rows of each group whose running size stays within the budget, up to the first that does not."""
    by = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(size).over(by)).where(F.col("running") <= budget)


def assemble(blocks: DataFrame, max_chars: int, order: list[str]) -> DataFrame:
    """(qid, context, n_blocks): titled blocks (qid, title, content) joined until the budget is used.

    The block that overflows is cut to the room that is left, if that is 100 characters or more; then the
    context ends. A query's blocks are its hits, a bounded group, folded in order.
    """
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(*order))
    group = blocks.withColumn("_p", rank).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("_p", "title", "content"))).alias("_b"))
    fold = F.expr(
        f"""aggregate(_b, named_struct('used', 0, 'out', cast(array() as array<string>), 'open', true),
              (s, b) -> CASE
                WHEN NOT s.open THEN s
                WHEN s.used + length(b.title) + length(b.content) + 2 <= {max_chars}
                  THEN named_struct('used', s.used + length(b.title) + length(b.content) + 2, 'out', concat(s.out, array(concat(b.title, '\n', b.content))), 'open', true)
                WHEN {max_chars} - s.used - length(b.title) - 20 >= 100
                  THEN named_struct('used', {max_chars}, 'out', concat(s.out, array(concat(b.title, '\n', substring(b.content, 1, {max_chars} - s.used - length(b.title) - 20)))), 'open', false)
                ELSE named_struct('used', s.used, 'out', s.out, 'open', false) END)"""
    )
    return group.select("qid", fold.alias("_f")).select("qid", F.array_join("_f.out", "\n\n").alias("context"), F.size("_f.out").alias("n_blocks"))


def assembled(blocks: DataFrame, max_chars: int) -> DataFrame:
    """(qid, context, n_blocks) of hits (qid, rank, id, file_path, symbol, symbol_type, content): of equal contents the best ranked,
    docstrings and long import lists cut, in order of type and rank, until the budget is used."""
    same = Window.partitionBy("qid", F.xxhash64(F.coalesce("content", F.lit("")))).orderBy("rank", "id")
    once = blocks.withColumn("_n", F.row_number().over(same)).where("_n = 1")
    titled = once.select(
        "qid", F.concat_ws(" ", F.lit("##"), "file_path", "symbol").alias("title"), compress_code(F.coalesce("content", F.lit("")), F.col("symbol_type")).alias("content"),
        type_rank(F.col("symbol_type")).alias("_t"), "rank", "id",
    )
    return assemble(titled, max_chars, ["_t", "rank", "id"])


def similar_texts(docs: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(id_a, id_b, similarity): pairs of different word sets with a Jaccard similarity of at least ``threshold``.

    docs: (id, text). Identical word sets are one class, named by its least id, and pair as one; see
    ``duplicate_classes`` for the members. A set is joined on its rarest words only: two sets that are similar
    enough share a word among the first n - ceil(threshold * n) + 1 by frequency, so no pair is lost and common
    words join nothing. Null and wordless texts pair with nothing.
    """
    sets = cut_lineage(duplicate_classes(docs).groupBy("words").agg(F.min("id").alias("id")).select("id", "words"))
    freq = sets.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("f"))
    ranked = sets.select("id", F.explode("words").alias("w")).join(freq, "w").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("f", "w"))).alias("_s"))
    n = F.size("_s")
    prefix = ranked.select("id", n.alias("n"), F.posexplode(F.slice("_s", 1, (n - F.ceil(n * threshold - 1e-9) + 1).cast("int"))).alias("at", "_w")).select("id", "n", "at", F.col("_w.w").alias("w"))
    a, b = prefix.alias("a"), prefix.alias("b")
    reachable = F.col("a.n") >= F.col("b.n") * threshold
    # two sets that are similar enough have this much in common from their first shared word on
    likely = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at")) >= F.ceil((F.col("a.n") + F.col("b.n")) * (threshold / (1 + threshold)) - 1e-9)
    other = (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.id") < F.col("b.id")))
    pairs = a.join(b, (F.col("a.w") == F.col("b.w")) & other & reachable & likely).select(F.col("a.id").alias("x"), F.col("b.id").alias("y")).distinct()
    both = pairs.join(sets.select(F.col("id").alias("x"), F.col("words").alias("_x")), "x").join(sets.select(F.col("id").alias("y"), F.col("words").alias("_y")), "y")
    inter = F.size(F.array_intersect("_x", "_y"))
    sim = inter / (F.size("_x") + F.size("_y") - inter)
    return both.where(sim >= threshold).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), F.round(sim, 6).alias("similarity"))


def duplicate_classes(docs: DataFrame) -> DataFrame:
    """(id, words): the sorted word set of each text with words; equal sets are one class."""
    return docs.where("text IS NOT NULL").select("id", F.sort_array(word_set(F.col("text"))).alias("words")).where(F.size("words") > 0)


def near_duplicates(docs: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(id, class_id, class_size, links): for each text its class of equal word sets and the number of similar other classes."""
    member = duplicate_classes(docs).select("id", F.xxhash64("words").alias("_h"), F.size("words").alias("_n"))
    classes = member.groupBy("_h", "_n").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))
    pairs = similar_texts(docs, threshold)
    ends = pairs.select(F.col("id_a").alias("class_id")).unionByName(pairs.select(F.col("id_b").alias("class_id")))
    links = ends.groupBy("class_id").agg(F.count("*").alias("links"))
    return member.join(classes, ["_h", "_n"]).join(links, "class_id", "left").select("id", "class_id", "class_size", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
