"""Reports of small results as Markdown and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


PAGE_ROWS = 1_000


def markdown(df: DataFrame, order: list[str]) -> DataFrame:
    """(page, markdown): a result as Markdown tables of at most ``PAGE_ROWS`` rows in the given order; an empty one has no page."""
    names = df.columns
    head = "| " + " | ".join(names) + " |\n|" + "---|" * len(names) + "\n"
    cells = F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names])
    lines = df.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.concat(F.lit("| "), cells, F.lit(" |")).alias("_l")).orderBy(*[f"_o{i}" for i in range(len(order))])
    numbered = lines.select(F.monotonically_increasing_id().alias("_n"), "_l")  # in order, within the ranges of the sort
    page = F.struct(F.shiftright("_n", 33).alias("part"), F.floor((F.col("_n") % (1 << 33)) / PAGE_ROWS).alias("at"))
    pages = numbered.groupBy(page.alias("page")).agg(F.sort_array(F.collect_list(F.struct("_n", "_l"))).alias("_s"))
    body = pages.select(F.concat_ws("-", "page.part", "page.at").alias("page"), F.array_join(F.transform("_s", lambda x: x["_l"]), "\n").alias("_b"))
    return body.select("page", F.concat(F.lit(head), "_b").alias("markdown"))


def write_json(df: DataFrame, path: str) -> None:
    """Write a result as JSON lines; fails if the folder exists."""
    df.write.json(path)
