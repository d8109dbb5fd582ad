"""The symbol graph as nodes and edges, and bounded traversals as unrolled joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

HOT_CALLERS = 20_000


def symbol_nodes(chunks: DataFrame) -> DataFrame:
    """(node, name, symbol_type, file_path, start_line, end_line, parent): one node per file and name, the last in the file wins."""
    named = chunks.where("symbol IS NOT NULL AND symbol <> '' AND file_path IS NOT NULL")
    order = F.struct("start_line", "end_line", "symbol_type", "parent")
    last = named.groupBy("file_path", F.col("symbol").alias("name")).agg(F.max(order).alias("_r"))
    return last.select(F.concat_ws("::", "file_path", "name").alias("node"), "name", F.col("_r.symbol_type").alias("symbol_type"), "file_path", F.col("_r.start_line").alias("start_line"), F.col("_r.end_line").alias("end_line"), F.col("_r.parent").alias("parent"))


def contains_edges(chunks: DataFrame) -> DataFrame:
    """(src, dst, relation): parent contains child, within a file."""
    inner = chunks.where("parent IS NOT NULL AND parent <> '' AND symbol IS NOT NULL AND symbol <> '' AND file_path IS NOT NULL")
    return inner.select(F.concat_ws("::", "file_path", "parent").alias("src"), F.concat_ws("::", "file_path", "symbol").alias("dst"), F.lit("contains").alias("relation")).distinct()


def call_edges(chunks: DataFrame) -> DataFrame:
    """(src, dst, relation): functions and methods whose text calls a name that is a symbol of their repository (column ``repo``).

    Callers and definitions are distinct before they meet. The callers of a name in more than ``HOT_CALLERS`` places are dealt to
    parts, each of which meets the definitions on its own.
    """
    callers = chunks.where("symbol_type IN ('function', 'method') AND symbol <> '' AND file_path IS NOT NULL")
    names = F.array_distinct(F.regexp_extract_all("content", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\("), F.lit(1)))
    called = callers.select("repo", F.concat_ws("::", "file_path", "symbol").alias("src"), "symbol", F.explode(names).alias("name")).where("symbol <> name").select("repo", "name", "src").distinct()
    defined = chunks.where("symbol <> '' AND file_path IS NOT NULL").select("repo", F.col("symbol").alias("name"), F.concat_ws("::", "file_path", "symbol").alias("dst")).distinct()
    called = called.join(defined.select("repo", "name").distinct(), ["repo", "name"], "left_semi")
    crowd = called.groupBy("repo", "name").agg(F.ceil(F.count("*") / HOT_CALLERS).cast("int").alias("_parts"))
    parted = defined.join(crowd, ["repo", "name"]).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    dealt = called.join(crowd.where("_parts > 1"), ["repo", "name"], "left").withColumn("_part", F.pmod(F.xxhash64("src"), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    return dealt.join(parted, ["repo", "name", "_part"]).select("src", "dst", F.lit("calls").alias("relation")).distinct()


def all_edges(chunks: DataFrame) -> DataFrame:
    """Both kinds; of two edges between the same nodes the one added last (calls) stays."""
    both = contains_edges(chunks).unionByName(call_edges(chunks))
    return both.groupBy("src", "dst").agg(F.min("relation").alias("relation"))


def reach(sources: DataFrame, edges: DataFrame, depth: int, *, reverse: bool = False) -> DataFrame:
    """(source, node, hops): nodes within ``depth`` steps of each source (column ``node``), without itself; the least hops.

    The loop is over the given depth, not over data. ``reverse`` walks against the edges.
    """
    step = edges.select(F.col("dst" if reverse else "src").alias("_from"), F.col("src" if reverse else "dst").alias("_to")).distinct()
    frontier = sources.select(F.col("node").alias("source"), F.col("node"))
    found = None
    for hop in range(1, depth + 1):
        frontier = frontier.join(step, F.col("node") == F.col("_from")).select("source", F.col("_to").alias("node")).where("source <> node").distinct()
        reached = frontier.withColumn("hops", F.lit(hop))
        found = reached if found is None else found.unionByName(reached)
    return found.groupBy("source", "node").agg(F.min("hops").alias("hops"))


def neighbours(edges: DataFrame, relations: tuple[str, ...], *, incoming: bool) -> DataFrame:
    """(node, neighbour): callers (incoming) or callees and children (outgoing)."""
    a, b = ("dst", "src") if incoming else ("src", "dst")
    return edges.where(F.col("relation").isin(*relations)).select(F.col(a).alias("node"), F.col(b).alias("neighbour"))


def remove_files(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graph without the files (path): their nodes and every edge that touches one, nodes without attributes included."""
    keep = nodes.join(gone.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_anti")
    file_of = lambda c: F.substring_index(c, "::", 1)
    left = edges
    for end in ("src", "dst"):
        left = left.withColumn("_f", file_of(F.col(end))).join(gone.select(F.col("path").alias("_f")).distinct(), "_f", "left_anti").drop("_f")
    return keep, left


def references(nodes: DataFrame, edges: DataFrame, names: DataFrame, per_name: int = 10, per_node: int = 15) -> DataFrame:
    """(name, node, caller): who calls the nodes of each name, at most ``per_name`` nodes and ``per_node`` callers each (a report)."""
    picked = nodes.join(names.select("name").distinct(), "name").select("name", "node")
    picked = picked.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy("node"))).where(F.col("_n") <= per_name)
    calls = neighbours(edges, ("calls", "references"), incoming=True)
    rows = picked.join(calls, "node").withColumn("_m", F.row_number().over(Window.partitionBy("name", "node").orderBy("neighbour")))
    return rows.where(F.col("_m") <= per_node).select("name", "node", F.col("neighbour").alias("caller"))
