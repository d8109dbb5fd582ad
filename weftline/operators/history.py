"""Conversations: turns, compaction to a budget, truncation, statistics, running counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def content_chars(content: Column = None) -> Column:
    return F.coalesce(F.length("content" if content is None else content), F.lit(0))


def args_chars() -> Column:
    """Characters of the arguments of the tool calls in a message."""
    return F.coalesce(F.aggregate("tool_calls", F.lit(0), lambda a, c: a + F.coalesce(F.length(c["arguments"]), F.lit(0))), F.lit(0))


def turns(messages: DataFrame) -> DataFrame:
    """Messages with turn_no: a user message starts a turn; 0 before the first; null for system messages."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    return messages.withColumn("turn_no", F.when(F.col("type") != "system", F.sum(F.when(F.col("type") == "user", 1).otherwise(0)).over(by)).cast("int"))


def compact(messages: DataFrame, max_tokens: int) -> DataFrame:
    """Messages that stay when each conversation is cut to a budget of tokens (characters div 4).

    A conversation within its budget stays whole. Otherwise all system messages and the newest turn stay,
    then older whole turns as long as the sum fits, without gaps. Tool arguments count for whether to cut,
    not for what fits. The order of rows is not part of the result.
    """
    conv = Window.partitionBy("conv_id")
    rows = turns(messages).withColumn("_c", content_chars())
    rows = rows.withColumn("_total", F.floor(F.sum(F.col("_c") + args_chars()).over(conv) / 4)).withColumn(
        "_system", F.floor(F.sum(F.when(F.col("type") == "system", F.col("_c")).otherwise(0)).over(conv) / 4)
    )
    per_turn = rows.where("turn_no IS NOT NULL").groupBy("conv_id", "turn_no", "_system").agg(F.floor(F.sum("_c") / 4).alias("_t"))
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn_no"))
    kept = per_turn.withColumn("_cum", F.sum("_t").over(newest.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_system"))
    kept = kept.withColumn("_rn", F.row_number().over(newest)).where((F.col("_rn") == 1) | (F.col("_cum") <= max_tokens)).select("conv_id", "turn_no", F.lit(True).alias("_keep"))
    out = rows.join(kept, ["conv_id", "turn_no"], "left")
    return out.where((F.col("type") == "system") | (F.col("_total") <= max_tokens) | F.col("_keep")).drop("_c", "_total", "_system", "_keep")


def truncate(messages: DataFrame, last: int) -> DataFrame:
    """The system messages and the last ``last`` others of each conversation."""
    by = Window.partitionBy("conv_id", F.col("type") == "system").orderBy(F.desc("turn"))
    return messages.withColumn("_n", F.row_number().over(by)).where((F.col("type") == "system") | (F.col("_n") <= last)).drop("_n")


def stats(messages: DataFrame) -> DataFrame:
    """Per conversation: messages by type, tool calls (the calls inside messages), estimated tokens."""
    count = lambda t: F.sum(F.when(F.col("type") == t, 1).otherwise(0)).alias(f"n_{t}")
    return messages.groupBy("conv_id").agg(
        F.count("*").alias("n"), *[count(t) for t in ("user", "assistant", "tool_call", "tool_result", "error")],
        F.sum(F.coalesce(F.size("tool_calls"), F.lit(0))).alias("calls"), F.floor(F.sum(content_chars() + args_chars()) / 4).alias("tokens"),
    )


def last_messages(messages: DataFrame) -> DataFrame:
    """Per conversation the turn of the last user message and of the last assistant message or tool call."""
    last = lambda *t: F.max(F.when(F.col("type").isin(*t), F.col("turn")))
    return messages.groupBy("conv_id").agg(last("user").alias("last_user"), last("assistant", "tool_call").alias("last_assistant"))


def running_usage(messages: DataFrame, max_calls: int, max_tokens: int) -> DataFrame:
    """(conv_id, turn, calls, tokens, over): counters up to each message and the limits reached by then."""
    by = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = messages.select("conv_id", "turn", F.sum(F.coalesce(F.size("tool_calls"), F.lit(0))).over(by).alias("calls"), F.floor(F.sum(content_chars() + args_chars()).over(by) / 4).alias("tokens"))
    over = F.concat_ws(",", F.when(F.col("calls") >= max_calls, "max_tool_calls"), F.when(F.col("tokens") >= max_tokens, "max_context_tokens"))
    return rows.withColumn("over", over)


def export(messages: DataFrame) -> DataFrame:
    """(conv_id, n, text): each conversation as text, a line "turn type: content" a message, in order; one conversation is one row."""
    line = F.concat(F.col("turn").cast("string"), F.lit(" "), "type", F.lit(": "), F.coalesce("content", F.lit("")))
    rows = messages.groupBy("conv_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("turn", line.alias("l")))).alias("_l"))
    return rows.select("conv_id", "n", F.array_join(F.transform("_l", lambda x: x["l"]), "\n").alias("text"))
