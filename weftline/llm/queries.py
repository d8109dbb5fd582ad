"""The queries of this subpackage, their SQL where there is one, and the driver's registry entries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.similar_vectors import similar_vectors

    near = similar_vectors(table(spark, sf_dir, "vectors").select("id", "vector"), min_sim=0.85)
    return near.select(F.least("id", "neighbor").alias("id_a"), F.greatest("id", "neighbor").alias("id_b")).distinct()


def p1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every id divisible by 20, among all vectors, with deeper probing for far neighbours."""
    from weftline.llm.similar_vectors import similar_vectors

    v = table(spark, sf_dir, "vectors").select("id", "vector")
    asked = v.where("conv(id, 16, 10) % 20 = 0")
    return similar_vectors(v, asked)


def p2_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.not_handwritten import not_handwritten

    return not_handwritten(table(spark, sf_dir, "files"), table(spark, sf_dir, "chunks"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_files(spark, sf_dir).where("kind is not null").select("path")


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.split_oversized import latest_rows, split_oversized

    big = table(spark, sf_dir, "chunks").where("length(content) div 4 > 500").select("id", "content", "start_line", "indexed_at")
    return split_oversized(latest_rows(big, "id", "indexed_at"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of which every line and character came out in two or more pieces within the limit."""
    per = p3_pieces(spark, sf_dir).groupBy("id").agg(F.count("*").alias("n"), F.max("n_pieces").alias("wanted"), F.max("tokens").alias("largest"), F.countDistinct("core_start").alias("cuts"), F.max("end_line").alias("_last"))
    return per.where("n > 1 AND n = wanted AND cuts = n AND largest <= 500 AND _last IS NOT NULL").select("id")


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.credentials import redact_credentials

    return redact_credentials(table(spark, sf_dir, "chunks").select("id", "file_path", "content"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.credentials import scan_credentials

    return scan_credentials(table(spark, sf_dir, "chunks")).select("id", "line_no").distinct()


def p5_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.syntax_check import check_files

    return check_files(table(spark, sf_dir, "files"), table(spark, sf_dir, "chunks"))


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.syntax_check import rejection_rates

    return rejection_rates(p5_files(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_files(spark, sf_dir).where("NOT valid").select("path")


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.packing import pack

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.packing import container_report

    return container_report(p6_packed(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = p6_packed(spark, sf_dir)
    return packed.groupBy("doc_id").agg(F.countDistinct("container").alias("n")).where("n > 1").select("doc_id")


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from weftline.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), table(spark, sf_dir, "mix_targets"))


def p7_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a source that is drawn to its cap and still misses its target
    return _mix(spark, sf_dir)[1].where("falls_short").select("source")


def _spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    from weftline.llm.shared_spans import shared_spans

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs, *shared_spans(docs)


def p8_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.shared_spans import coverage

    return coverage(*_spans(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.shared_spans import sharing_pairs

    return sharing_pairs(*_spans(spark, sf_dir)[1:])


def p8_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document with its class of copies and the number of others that share a run with it."""
    from weftline.llm.shared_spans import sharing_classes

    return sharing_classes(*_spans(spark, sf_dir)[1:])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit() and callable(f)}


_P8_SQL = """
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 200),
w AS (SELECT DISTINCT doc_id, hash(substr(text, i::BIGINT, 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM d)),
t AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
m AS (SELECT w.* FROM w JOIN t USING (h))
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM m a JOIN m b ON a.h = b.h AND a.doc_id < b.doc_id"""


def oracle_sql() -> dict[str, str]:
    """SQL where DuckDB answers it on whole tables: for p8 brute force over all runs of 200 characters."""
    return {
        "p3_found": "SELECT DISTINCT id FROM chunks WHERE length(content) // 4 > 500",
        "p8_found": _P8_SQL,
    }
