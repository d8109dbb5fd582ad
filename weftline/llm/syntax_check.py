"""Flag source files that no dialect of their language accepts, with rates per repository and language."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from weftline.llm.file_texts import chunk_parts, with_text
from weftline.llm.languages import SUFFIXES, valid


def _check(paths: list[str], texts: list[str]) -> pd.DataFrame:
    return pd.DataFrame({"path": paths, "valid": [valid(t, p.rsplit(".", 1)[-1].lower()) for p, t in zip(paths, texts, strict=True)]})


def check_files(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(path, repo, language, valid): a row per distinct path with one of ``SUFFIXES`` (any case).

    The text is put together from ``chunks``; ``valid`` is null for a file without chunks. Null paths have
    no row. ``language`` is the suffix; ``repo`` is the first part of the path. An empty text is valid
    except in Go and JSON. Nulls in other columns, repeated rows and extra columns have no effect.
    """
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    paths = files.where(F.col("path").isNotNull()).select("path", suffix.alias("language")).where(F.col("language").isin(*SUFFIXES)).distinct()
    checked = with_text(chunk_parts(chunks, SUFFIXES), _check, "path string, valid boolean")
    return paths.join(checked, "path", "left").select("path", F.split("path", "/")[0].alias("repo"), "language", "valid")


def rejection_rates(checked: DataFrame) -> DataFrame:
    """(repo, language, files, checked, rejected, rate), with a null ``repo`` or ``language`` for the sums over it."""
    bad = F.when(~F.col("valid"), 1).otherwise(0)
    agg = checked.withColumn("_bad", bad).cube("repo", "language").agg(
        F.count("*").alias("files"), F.count("valid").alias("checked"), F.sum("_bad").alias("rejected")
    )
    return agg.withColumn("rate", F.when(F.col("checked") > 0, F.col("rejected") / F.col("checked")))
