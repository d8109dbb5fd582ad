"""Draw a mixture of sources with target shares by pivotal dependent rounding.

Every record of a source gets the same real number of copies, which brings the
source to its share; whole copies are taken as they are, the fractional part is
an inclusion probability. Pivotal sampling pairs two fractions and moves mass
between them at random until one is 0 or 1. It runs in blocks of records; the one
fraction that is left in each block goes up a reduction tree, block by block.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from weftline.llm.tokens import DEFAULT_VOCABULARY, token_count
from weftline.session import broadcast_if_small, cut_lineage

BLOCK_ROWS = 4096
FAN_IN = 64
_EPS = 1e-9


def pivot(prob: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Pivotal rounding of fractions in the given order; at most one entry stays fractional."""
    out, held = prob.copy(), -1
    draws = rng.random(len(prob))
    for i in range(len(out)):
        b = out[i]
        if b <= _EPS or b >= 1 - _EPS:
            out[i] = round(b)
            continue
        if held < 0:
            held = i
            continue
        a = out[held]
        total = a + b
        if total < 1:
            keep_b = draws[i] * total < b
            out[held], out[i] = (0.0, total) if keep_b else (total, 0.0)
        else:
            keep_b = draws[i] * (2 - total) < 1 - a
            out[held], out[i] = (total - 1, 1.0) if keep_b else (1.0, total - 1)
        if out[i] > _EPS and out[i] < 1 - _EPS:
            held = i
        elif not _EPS < out[held] < 1 - _EPS:
            held = -1
    return out


def _pivot_block(seed: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id"], kind="stable")  # partners of like size keep the token sum
        rng = np.random.default_rng([seed, int(pdf["doc_id"].iloc[0]) & 0x7FFFFFFF, len(pdf)])
        p = pivot(pdf["prob"].to_numpy(np.float64), rng)
        if last:
            open_ = (p > _EPS) & (p < 1 - _EPS)
            p[open_] = (rng.random(int(open_.sum())) < p[open_]).astype(float)
        return pdf.assign(prob=p)

    return run


def source_targets(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per wanted source: tokens at hand, target tokens, copies per record and whether it falls short.

    ``sized``: (source, tokens). The whole is the tokens of all records whose source is wanted.
    """
    have = sized.groupBy("source").agg(F.sum("tokens").alias("tokens_available"), F.count("*").alias("n_docs"))
    t = targets.select(F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats").where("source is not null")
    joined = t.join(have, "source", "left").fillna(0, ["tokens_available", "n_docs"])
    whole = joined.agg(F.sum("tokens_available").alias("_whole"))
    with_whole = joined.withColumn("_k", F.lit(1)).join(F.broadcast(whole.withColumn("_k", F.lit(1))), "_k").drop("_k")  # one row
    return with_whole.withColumn("target_tokens", F.col("target_share") * F.col("_whole")).drop("_whole").select(
        "*",
        (F.col("tokens_available") * F.col("max_repeats") < F.col("target_tokens")).alias("falls_short"),
        F.when(F.col("tokens_available") > 0, F.least(F.col("target_tokens") / F.col("tokens_available"), F.col("max_repeats").cast("double")))
        .otherwise(0.0)
        .alias("copies_each"),
    )


def mix_sources(docs: DataFrame, targets: DataFrame, *, vocabulary: str = DEFAULT_VOCABULARY, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(copies, report): how often each record is drawn, and the shares asked for and reached.

    docs: (doc_id, source, text); targets: (source, target_share, max_repeats). Sources are
    compared trimmed and in lower case. Records without a wanted source, and null or empty
    texts (no tokens), get no copies; a target without records is reported as falling short.
    Null targets are left out; repeated rows are records of their own; other columns are ignored.
    """
    sized = cut_lineage(
        docs.select("doc_id", F.lower(F.trim("source")).alias("source"), token_count(F.col("text"), vocabulary).alias("tokens")).where("source is not null and tokens > 0")
    )
    plan = cut_lineage(source_targets(sized, targets))
    rows = sized.join(broadcast_if_small(plan.select("source", "copies_each", "n_docs")), "source")
    rows = rows.select(
        "doc_id", "source", "tokens",
        F.floor("copies_each").cast("int").alias("whole"),
        (F.col("copies_each") - F.floor("copies_each")).alias("prob"),
        F.pmod(F.hash("doc_id"), F.ceil(F.col("n_docs") / BLOCK_ROWS)).cast("long").alias("block"),
    )
    most = plan.agg(F.max("n_docs")).head()[0] or 0
    levels = 1 + max(0, math.ceil(math.log(max(1, math.ceil(most / BLOCK_ROWS)), FAN_IN)))
    schema, done, level_rows = rows.schema, [], rows
    for level in range(levels):
        last = level == levels - 1
        solved = level_rows.groupBy("source", "block").applyInPandas(_pivot_block(seed + level, last), schema)
        if last:
            done.append(solved)
            break
        solved = cut_lineage(solved)
        open_ = F.col("prob").between(_EPS, 1 - _EPS)
        done.append(solved.where(~open_))
        level_rows = solved.where(open_).withColumn("block", F.floor(F.col("block") / FAN_IN))
    drawn = done[0]
    for part in done[1:]:
        drawn = drawn.unionByName(part)
    copies = cut_lineage(drawn.select("doc_id", "source", "tokens", (F.col("whole") + F.round("prob")).cast("int").alias("copies")))
    got = copies.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens_drawn"), F.max("copies").alias("most_copies"))
    report = plan.join(got, "source", "left").fillna(0, ["tokens_drawn", "most_copies"])
    drawn_all = copies.agg(F.sum(F.col("tokens") * F.col("copies")).alias("_all")).withColumn("_k", F.lit(1))
    report = report.withColumn("_k", F.lit(1)).join(F.broadcast(drawn_all), "_k").drop("_k")  # one row
    report = report.withColumn("actual_share", F.when(F.col("_all") > 0, F.col("tokens_drawn") / F.col("_all")).otherwise(0.0)).drop("_all")
    return copies.where("copies > 0"), report
