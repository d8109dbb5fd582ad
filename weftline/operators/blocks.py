"""A stated set of queries against all rows, block by block, as a grouped job."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F


def in_blocks(queries: DataFrame, rows: DataFrame, meet: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, *, query_rows: int, rows_a_block: int) -> DataFrame:
    """``meet``(block of queries, block of rows) for every pair of blocks; queries have a column ``qid``, rows a column ``id``.

    Both sides are dealt to blocks of bounded size by the hash of their id. A query goes to each block of rows and a row to
    each block of queries, so that a cell needs nothing but its two blocks and no side passes through the driver or one task.
    Each cell is a partition of its own, and the blocks of rows fill the cores evenly; with more blocks of queries those of rows are
    fewer, as each sends hits of its own for every query. Both sides are counted, then read again.
    """
    spread = rows.sparkSession.sparkContext.defaultParallelism
    many_q, many_r = max(1, -(-queries.count() // query_rows)), rows.count()
    many_r = max(-(-min(spread, many_r // 1000) // many_q), -(-many_r // rows_a_block), 1)
    many_r = many_r if many_r < spread else -(-many_r // spread) * spread
    cells = many_q * many_r
    keys = F.lit(_keys_of_partitions(rows.sparkSession, cells))
    place = lambda df, key, own, n_own, other, n_other: df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n_own)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))
    # other names on one side: where both come from one table, Spark takes equal columns for the same
    asked = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns])
    own = lambda df: df.withColumn("_cell", F.element_at(keys, F.col("_q") * many_r + F.col("_r") + 1)).drop("_q", "_r").repartition(cells, "_cell")
    q = own(place(asked, "q_qid", "_q", many_q, "_r", many_r))
    r = own(place(rows, "id", "_r", many_r, "_q", many_q))

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return meet(left.rename(columns=lambda c: c.removeprefix("q_")), right)

    return q.groupBy("_cell").cogroup(r.groupBy("_cell")).applyInPandas(cell, schema)


def _keys_of_partitions(spark: SparkSession, n: int) -> list[int]:
    """``n`` different numbers, the i-th of which Spark's hash puts into partition i of n (any number where none is near)."""
    tried = n * (n.bit_length() + 12)
    found = spark.range(tried, numPartitions=1).groupBy(F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p")).agg(F.min(F.col("id").cast("int")).alias("key")).collect()
    keys = {r["p"]: r["key"] for r in found}
    return [keys.get(i, tried + i) for i in range(n)]
