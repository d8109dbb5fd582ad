"""The tables without their repeats: one row for each id, path or key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def distinct_chunks(chunks: DataFrame) -> DataFrame:
    """One row per chunk id. Re-indexed rows repeat id, content and range, so a row's own columns decide.

    Null ids are left out; ``tokens`` and ``indexed_at`` are dropped as they differ among repeats.
    """
    keep = ["id", "file_path", "content", "start_line", "end_line", "symbol", "symbol_type", "parent", "repo"]
    return chunks.where("id IS NOT NULL").select(*keep).distinct()


def chunk_fields(chunks: DataFrame) -> DataFrame:
    """The rows of ``distinct_chunks`` without their content, of which a digest is compared in its place."""
    return distinct_chunks(chunks.withColumn("content", F.unhex(F.md5("content")))).drop("content")


def latest_files(files: DataFrame) -> DataFrame:
    """One row per path, the last scan. Null paths are left out."""
    last = F.max_by(F.struct("language", "size_bytes", "sha256"), "scanned_at")
    return files.where("path IS NOT NULL").groupBy("path").agg(last.alias("_r")).select("path", "_r.*")


def distinct_messages(messages: DataFrame) -> DataFrame:
    """One row per (conv_id, turn); exact repeats collapse. Rows without key are left out."""
    keyed = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    rest = [c for c in messages.columns if c not in ("conv_id", "turn")]
    return keyed.groupBy("conv_id", "turn").agg(F.first(F.struct(*rest)).alias("_r")).select("conv_id", "turn", "_r.*")


def usable_vectors(vectors: DataFrame, dim: int = 64) -> DataFrame:
    """(id, file_path, symbol, symbol_type, language, vector): one row per id; null, short, zero and non-finite vectors are left out."""
    good = (
        (F.size("vector") == dim)
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
        & F.exists("vector", lambda x: x != 0)
    )
    return vectors.where("id IS NOT NULL").where(good).select("id", "file_path", "symbol", "symbol_type", "language", "vector").distinct()
