"""Repository scans and index snapshots as Spark sources and sinks."""

from __future__ import annotations

import re
import time
from contextlib import closing

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weftline.functions.text import language_of
from weftline.operators.scan import is_ignored

MAX_BYTES = 2 * 1024 * 1024


def glob_regex(glob: str) -> str:
    """A regex for the paths below and at a glob of an ignore file: ``*`` and ``?`` stay within a folder, ``**`` does not."""
    anchored = "/" in glob.rstrip("/")
    body = re.sub(r"\*\*/|\*\*|\*|\?|[^*?]+", lambda m: {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(m.group()) or re.escape(m.group()), glob.strip("/"))
    return ("^" if anchored else "(?:^|/)") + body + ("/" if glob.endswith("/") else "(?:/|$)")


def ignored_by(path: Column, lines: list[str]) -> Column:
    """Whether the lines of an ignore file leave the path out: of the lines that match the last counts, and one with ``!`` takes it in again."""
    rules = [x.strip() for x in lines if x.strip() and not x.startswith("#")]
    out = F.lit(False)
    for rule in rules:
        out = F.when(path.rlike(glob_regex(rule.lstrip("!"))), not rule.startswith("!")).otherwise(out)
    return out


def _ignore_lines(spark: SparkSession, root: str) -> list[str]:
    """The lines of ``.gitignore`` in ``root``, none where there is no such file. Spark's readers pass over names with a dot, so the file system is asked."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root, ".gitignore")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    with closing(fs.open(path)) as stream:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()


def scan_repository(spark: SparkSession, root: str, *, max_bytes: int = MAX_BYTES, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(path, language, size_bytes, sha256, text): the text files under ``root``.

    Left out: paths that a scan always skips, those that ``.gitignore`` in ``root`` or a regex of ``ignore`` names, empty files, files over
    ``max_bytes``, and binary files (a zero byte among the first 1024). The size test comes before
    the content is read.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where((F.col("length") > 0) & (F.col("length") <= max_bytes))
    path = F.regexp_replace("path", "^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "")
    kept = raw.withColumn("_p", path).where(~is_ignored(F.col("_p")))
    kept = kept.where(~ignored_by(F.col("_p"), _ignore_lines(spark, root)))
    for pattern in ignore:
        kept = kept.where(~F.col("_p").rlike(pattern))
    kept = kept.where(~F.hex(F.substring("content", 1, 1024)).rlike("^(..)*00"))
    return kept.select(F.col("_p").alias("path"), language_of(F.col("_p")).alias("language"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("text"))


def write_snapshot(df: DataFrame, base: str, name: str) -> str:
    """Write a new version of a table beside the old ones and return its path; a reader picks the newest."""
    path = f"{base}/{name}/v={int(time.time() * 1000):015d}"
    df.write.parquet(path)
    return path


def read_snapshot(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The newest version of a table written by ``write_snapshot``."""
    versions = spark.read.option("basePath", f"{base}/{name}").parquet(f"{base}/{name}")
    newest = versions.agg(F.max("v")).first()[0]
    return versions.where(F.col("v") == newest).drop("v")


DATASET_SCHEMA = "qid string, query string, files array<string>, docs array<string>, symbols array<string>, category string"


def write_dataset(data: DataFrame, path: str) -> None:
    """Write evaluation queries with their ground truth as JSON lines; fails if the folder exists."""
    data.select(*[c.split()[0] for c in DATASET_SCHEMA.split(", ")]).write.json(path)


def read_dataset(spark: SparkSession, path: str, categories: list[str] | None = None) -> DataFrame:
    """Evaluation queries of a file of JSON lines, those of ``categories`` only where given; absent lists are empty, rows without a query are left out."""
    data = spark.read.schema(DATASET_SCHEMA).json(path).where("query IS NOT NULL")
    data = data.select("qid", "query", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("files", "docs", "symbols")], "category")
    return data if categories is None else data.where(F.col("category").isin(categories))
