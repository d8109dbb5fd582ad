"""Change detection against a manifest, and idempotent upserts and deletes of index rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def manifest_diff(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, status): new, modified, deleted or skipped. A hash that is null on one side only differs; null paths are left out."""
    now = files.where("path IS NOT NULL").select("path", F.col("sha256").alias("_now"), F.lit(True).alias("_a"))
    old = manifest.where("path IS NOT NULL").groupBy("path").agg(F.max("sha256").alias("_old")).withColumn("_b", F.lit(True))
    status = F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "deleted").when(F.col("_now").eqNullSafe(F.col("_old")), "skipped").otherwise("modified")
    return now.join(old, "path", "full_outer").select("path", status.alias("status"))


def delete_files(rows: DataFrame, diff: DataFrame, path_col: str = "file_path") -> DataFrame:
    """Index rows without those of deleted and modified files; applies to chunks, postings and vectors alike."""
    gone = diff.where("status IN ('deleted', 'modified')").select(F.col("path").alias(path_col))
    return rows.join(gone, path_col, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def cache_misses(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Texts (text) whose key sha256(model:text) is not in cache (key)."""
    keyed = texts.where("text IS NOT NULL").select(F.sha2(F.concat(F.lit(model), F.lit(":"), F.col("text")), 256).alias("key"), "text").distinct()
    return keyed.join(cache.select("key").distinct(), "key", "left_anti")
