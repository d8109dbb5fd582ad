"""Retrieval metrics of ranked hits against judgments, per query and per strategy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

KS = (1, 5, 10)


def judged(hits: DataFrame, judgments: DataFrame) -> DataFrame:
    """hits (strategy, qid, id, rank) with rel: 1 if (qid, id) is judged relevant, compared without case."""
    rel = judgments.select("qid", F.lower("id").alias("_id"), F.lit(1).alias("rel")).distinct()
    return hits.withColumn("_id", F.lower("id")).join(rel, ["qid", "_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0))).drop("_id")


def query_metrics(hits: DataFrame, judgments: DataFrame, strategies: list[str]) -> DataFrame:
    """A row per strategy and judged query: recall at 1, 5, 10, precision at 5, reciprocal rank, nDCG at 5.

    Precision divides by the number of hits returned. nDCG leaves rank 1 undiscounted, divides the gain of
    rank r by log2(r) from rank 2, and takes as ideal the relevant hits among those retrieved, in front.
    """
    wanted = judgments.select("qid", F.lower("id").alias("_id")).distinct().groupBy("qid").agg(F.count("*").alias("n_rel"))
    return _metrics_of(judged(hits, judgments), wanted, strategies)


def symbol_metrics(hits: DataFrame, queries: DataFrame, named: DataFrame, strategies: list[str]) -> DataFrame:
    """``query_metrics`` where the chunks (id, text) with the text of a query (qid, text) are its judgments.

    Pairs of query and chunk grow with the square of a text's count, so they are not made: chunks are counted once
    for each text that is asked for, and a hit is judged by the texts of its own chunk.
    """
    asked = queries.groupBy("qid").agg(F.sort_array(F.collect_set("text")).alias("texts"))
    own = named.where("text IS NOT NULL").select(F.lower("id").alias("_id"), "text").distinct()
    counts = asked.select("texts").distinct().select("texts", F.explode("texts").alias("text")).join(own, "text").groupBy("texts").agg(F.countDistinct("_id").alias("n_rel"))
    wanted = asked.join(counts, "texts").select("qid", "n_rel")
    held = own.groupBy("_id").agg(F.collect_set("text").alias("_held"))
    pairs = hits.withColumn("_id", F.lower("id")).join(held, "_id", "left").join(asked, "qid")
    rel = F.coalesce(F.arrays_overlap("texts", "_held"), F.lit(False)).cast("int")
    return _metrics_of(pairs.select("strategy", "qid", "rank", rel.alias("rel")), wanted, strategies)


def _metrics_of(rated: DataFrame, wanted: DataFrame, strategies: list[str]) -> DataFrame:
    """Metrics of hits (strategy, qid, rank, rel) of the queries (qid, n_rel)."""
    base = wanted.select("qid", "n_rel", F.explode(F.array(*[F.lit(x) for x in strategies])).alias("strategy"))
    discount = F.when(F.col("rank") == 1, 1.0).otherwise(1.0 / F.log2("rank"))
    within = lambda k, c: F.sum(F.when(F.col("rank") <= k, c).otherwise(0))
    agg = rated.groupBy("strategy", "qid").agg(
        *[within(k, F.col("rel")).alias(f"_r{k}") for k in KS], within(5, F.lit(1)).alias("_n5"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("_first"), within(5, F.col("rel") * discount).alias("_dcg")
    )
    m = base.join(agg, ["strategy", "qid"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    ideal = F.expr("aggregate(sequence(1, greatest(coalesce(_r5, 0), 1)), cast(0 as double), (s, r) -> s + CASE WHEN r = 1 THEN 1.0D ELSE 1.0D / log2(r) END)")
    return m.select(
        "strategy", "qid", *[F.round(zero(F.col(f"_r{k}") / F.col("n_rel")), 6).alias(f"recall_{k}") for k in KS],
        F.round(zero(F.when(F.col("_n5") > 0, F.col("_r5") / F.col("_n5"))), 6).alias("precision_5"), F.round(zero(1.0 / F.col("_first")), 6).alias("rr"),
        F.round(F.when(F.coalesce("_r5", F.lit(0)) > 0, F.col("_dcg") / ideal).otherwise(0.0), 6).alias("ndcg_5"),
    )


def strategy_metrics(per_query: DataFrame) -> DataFrame:
    """Means over the queries of each strategy, rounded to four places."""
    names = [c for c in per_query.columns if c not in ("strategy", "qid")]
    return per_query.groupBy("strategy").agg(F.count("*").alias("n_queries"), *[F.round(F.avg(c), 4).alias(c) for c in names])


def dataset(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, query, files, docs, symbols, category) of queries (qid, text): the chunks of the symbol that each asks for are its ground truth, the kind of symbol its category."""
    j = queries.join(chunks.select("id", "file_path", "symbol_type", F.col("symbol").alias("text")), "text")
    return j.groupBy("qid", F.col("text").alias("query")).agg(
        F.collect_set("file_path").alias("files"), F.collect_set("id").alias("docs"), F.array(F.first("text")).alias("symbols"), F.coalesce(F.min("symbol_type"), F.lit("none")).alias("category")
    )


def dataset_categories(data: DataFrame) -> DataFrame:
    """(category, n_queries, files, ids) of a dataset."""
    return data.groupBy("category").agg(F.count("*").alias("n_queries"), F.sum(F.size("files")).alias("files"), F.sum(F.size("docs")).alias("ids"))


def judged_any(hits: DataFrame, data: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits (qid, id) with rel: 1 if the id, file, or symbol of the chunk is in the ground truth of the query (see ``dataset``), without case."""
    truth = data.select("qid", F.explode(F.concat("files", "docs", "symbols")).alias("_t")).select("qid", F.lower("_t").alias("_t")).distinct()
    tokens = hits.join(chunks.select("id", "file_path", "symbol"), "id", "left").select("qid", "id", F.explode(F.array("id", "file_path", "symbol")).alias("_t"))
    found = tokens.select("qid", "id", F.lower("_t").alias("_t")).join(truth, ["qid", "_t"], "left_semi").select("qid", "id").distinct().withColumn("rel", F.lit(1))
    return hits.join(found, ["qid", "id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def context_sizes(hits: DataFrame) -> DataFrame:
    """(strategy, n_queries, mean_chars, total_chars): characters of the contents (chars) of the hits (strategy, qid) of each strategy."""
    per = hits.groupBy("strategy", "qid").agg(F.sum("chars").alias("chars"))
    return per.groupBy("strategy").agg(F.count("*").alias("n_queries"), F.round(F.avg("chars"), 4).alias("mean_chars"), F.sum("chars").alias("total_chars"))


def best_strategy(metrics: DataFrame) -> DataFrame:
    """(metric, strategy, value): the best strategy by each metric; the first by name wins ties."""
    names = [c for c in metrics.columns if c not in ("strategy", "n_queries")]
    long = metrics.unpivot(["strategy"], names, "metric", "value")
    by = Window.partitionBy("metric").orderBy(F.desc("value"), "strategy")
    return long.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")
