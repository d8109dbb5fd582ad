"""A text index that is built once and searched many times: postings in order of their terms, and document lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.operators.lexical import counted_terms, score_postings, query_terms
from weftline.session import at_most, checkpoint_folder

#: Terms that a search looks up by a filter on the files; a search with more of them joins.
MOST_LOOKUPS = 2_000
ROWS_A_FILE = 2_000_000
_BUILT: dict[tuple, str] = {}


def write_index(docs: DataFrame, path: str, files: int | None = None) -> None:
    """Write the index of docs (id, text) under ``path``: ``postings`` (term, id, tf, dl) and ``docs`` (id, dl).

    Postings are range-partitioned by (term, id), so that a term in a third of all documents fills many files, and
    a search reads the files and row groups of its terms only. Ids must be unique; null texts have length 0.
    """
    lengths, postings = counted_terms(docs)
    lengths.write.mode("overwrite").parquet(f"{path}/docs")
    words = docs.sparkSession.read.parquet(f"{path}/docs").agg(F.sum("dl")).first()[0] or 0
    postings.repartitionByRange(files or max(1, -(-words // ROWS_A_FILE)), "term", "id").sortWithinPartitions("term").write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(f"{path}/postings")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(postings, docs) of an index."""
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/docs")


def update_index(spark: SparkSession, path: str, new_path: str, changed: DataFrame, gone: DataFrame) -> None:
    """Write to ``new_path`` the index at ``path`` without the ids of ``gone`` (id) and with docs ``changed`` (id, text) in place of older texts."""
    postings, docs = read_index(spark, path)
    lengths, fresh = counted_terms(changed)
    out = gone.select("id").unionByName(changed.select("id")).distinct()
    docs.join(out, "id", "left_anti").unionByName(lengths).write.parquet(f"{new_path}/docs")
    kept = postings.join(out, "id", "left_anti").select("term", "id", "tf", "dl").unionByName(fresh)
    kept.repartitionByRange("term", "id").sortWithinPartitions("term").write.parquet(f"{new_path}/postings")


def search_index(queries: DataFrame, postings: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, id, score) by BM25 of queries (qid, text) over an index; only postings of the queries' terms are read."""
    terms = query_terms(queries)
    stats = docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    asked = at_most(terms.select("term").distinct(), MOST_LOOKUPS)
    if asked is not None:
        postings = postings.where(F.col("term").isin([r["term"] for r in asked]))
    return score_postings(terms, postings, stats["n"], stats["avgdl"])


def index_of(docs: DataFrame, source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index of docs (id, text) that derive from the files of ``source``; built where this session has none of these files in their present state.

    It is kept in the checkpoint folder, under a name made of the files and their times of change.
    """
    spark = docs.sparkSession
    at = source.select("_metadata.file_path", "_metadata.file_modification_time").groupBy("file_path").agg(F.max("file_modification_time").alias("t"))
    mark = at.agg(F.sum(F.xxhash64("file_path", "t").cast("decimal(38,0)"))).first()[0]
    key = (spark.sparkContext.applicationId, mark)
    if key not in _BUILT:
        path = f"{checkpoint_folder(spark)}/index-{abs(int(mark or 0))}"
        write_index(docs, path)
        _BUILT[key] = path
    return read_index(spark, _BUILT[key])
