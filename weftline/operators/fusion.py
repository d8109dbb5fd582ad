"""Fusion of ranked lists, symbol boosts, and the best chunk of each symbol."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

RRF_CONSTANT = 60
#: What a query asks for, by words in it (fixed values).
CLASS_WORDS = r"\bclass\b|\binterface\b|\binherit|\bextends\b"
FUNCTION_WORDS = r"\bfunc\b|\bfunction\b|\bmethod\b|\bdef\b|\bhandler\b"


def reciprocal_rank_fusion(lists: dict[str, tuple[DataFrame, float]]) -> DataFrame:
    """(qid, id, rrf_score, <name>_score ...) of ranked lists (qid, id, score, rank) with their weights.

    An id that a list lacks adds nothing and has the score 0 there.
    """
    parts = []
    for name, (hits, weight) in lists.items():
        zeros = [F.col("score").alias(f"{m}_score") if m == name else F.lit(0.0).alias(f"{m}_score") for m in lists]
        parts.append(hits.select("qid", "id", (F.lit(weight) / (RRF_CONSTANT + F.col("rank"))).alias("_s"), *zeros))
    all_hits = reduce(DataFrame.unionByName, parts)
    return all_hits.groupBy("qid", "id").agg(F.round(F.sum("_s"), 9).alias("rrf_score"), *[F.max(f"{m}_score").alias(f"{m}_score") for m in lists])


def query_intent(text: Column) -> Column:
    """'class', 'function' or null: what the words of a query ask for."""
    low = F.lower(text)
    return F.when(low.rlike(CLASS_WORDS), "class").when(low.rlike(FUNCTION_WORDS), "function")


def symbol_boost(hits: DataFrame) -> DataFrame:
    """hits (text, symbol, symbol_type, rrf_score, ...) with final_score: +50 % if a word of the query is part of the symbol, +30 % if the intent fits."""
    words = F.filter(F.split(F.lower("text"), r"[ \t\n\r\f\x0B]+"), lambda w: F.length(w) > 2)
    named = F.exists(words, lambda w: F.contains(F.lower(F.coalesce("symbol", F.lit(""))), w))
    fits = F.coalesce(F.contains(F.lower("symbol_type"), query_intent(F.col("text"))), F.lit(False))
    factor = 1.0 + F.when(named, 0.5).otherwise(0.0) + F.when(fits, 0.3).otherwise(0.0)
    # rounded as a whole number, as SQL does: a product that ends in 5 may lie just below it as a double
    return hits.withColumn("final_score", F.round(F.col("rrf_score") * factor * 1e9) / 1e9)


def best_per_symbol(hits: DataFrame, k: int) -> DataFrame:
    """The best hit of each symbol (of each id where there is none), then the first ``k`` of each query."""
    key = F.coalesce(F.nullif(F.col("symbol"), F.lit("")), F.col("id"))
    first = Window.partitionBy("qid", "_key").orderBy(F.desc("final_score"), "id")
    by = Window.partitionBy("qid").orderBy(F.desc("final_score"), "id")
    one = hits.withColumn("_key", key).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return one.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).drop("_key", "_n")
