"""Structured Streaming: incremental index runs, event windows, assembly of streamed tool calls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.operators.lexical import counted_terms


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, value): sums of tumbling windows of a stream (ts, event_type, value); rows later than ``late`` are dropped by the watermark."""
    timed = events.withColumn("_at", F.col("ts").cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy(F.window("_at", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def assemble_calls(deltas: DataFrame) -> DataFrame:
    """(session, index, id, name, arguments): fragments (session, seq, index, id, name, args_fragment) joined in order; arguments that are no JSON become {}."""
    joined = deltas.groupBy("session", "index").agg(
        F.max("id").alias("id"), F.max("name").alias("name"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "args_fragment"))), lambda x: F.coalesce(x["args_fragment"], F.lit(""))), "").alias("arguments")
    )
    valid = F.from_json("arguments", "map<string,string>").isNotNull()
    return joined.withColumn("arguments", F.when(valid, F.col("arguments")).otherwise("{}"))


def collect_deltas(deltas: DataFrame) -> DataFrame:
    """(session, text, n, finish_reason): the pieces of text (session, seq, text, finish_reason) of each answer joined in order, and why it ended (null if it has not)."""
    parts = F.sort_array(F.collect_list(F.struct("seq", F.coalesce("text", F.lit("")).alias("text"))))
    joined = deltas.groupBy("session").agg(parts.alias("_p"), F.count("*").alias("n"), F.max_by("finish_reason", F.when(F.col("finish_reason").isNotNull(), F.col("seq"))).alias("finish_reason"))
    return joined.select("session", F.array_join(F.transform("_p", lambda x: x["text"]), "").alias("text"), "n", "finish_reason")


def index_stream(chunks: DataFrame, out: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Index a stream of chunks (id, content): each batch's index goes to folders named by the batch, so that a repeated batch replaces itself. See ``stream_index``."""

    def write(batch: DataFrame, number: int) -> None:
        docs = batch.where("id IS NOT NULL").select("id", F.col("content").alias("text")).dropDuplicates(["id"])
        lengths, postings = counted_terms(docs)
        lengths.write.mode("overwrite").parquet(f"{out}/docs/batch={number}")
        postings.write.mode("overwrite").parquet(f"{out}/postings/batch={number}")
        if on_batch:
            on_batch(batch, number)

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_index(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """(postings, docs) of a streamed index: a chunk that came in several batches counts as in its last one."""
    docs, postings = spark.read.parquet(f"{out}/docs"), spark.read.parquet(f"{out}/postings")
    last = docs.groupBy("id").agg(F.max("batch").alias("batch"))
    newest = lambda df: df.join(last, ["id", "batch"], "left_semi").drop("batch")
    return newest(postings), newest(docs)
