"""Whole file texts put together from chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def assemble(parts: list) -> str:
    """Every line at its place; lines in no chunk are empty. Where parts overlap, the longer line stands."""
    lines: list[str] = []
    for start, content in sorted(parts, key=lambda p: (p[0], len(p[1]))):
        own = content.split("\n")
        if start > len(lines):
            lines += [""] * (start - len(lines))
        if start == len(lines):
            lines += own
            continue
        for i, line in enumerate(own, start):
            if i >= len(lines):
                lines.append(line)
            elif len(line) > len(lines[i]):
                lines[i] = line
    return "\n".join(lines)


def chunk_parts(chunks: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """(path, parts): the distinct chunks of each file with one of the suffixes. Rows without path, place or content are left out."""
    wanted = F.lower(F.regexp_extract("file_path", r"\.([A-Za-z0-9]+)$", 1)).isin(*suffixes)
    rows = chunks.where(wanted & F.col("content").isNotNull() & (F.col("start_line") >= 0))
    return rows.groupBy(F.col("file_path").alias("path")).agg(F.collect_set(F.struct("start_line", "content")).alias("parts"))


def with_text(parts: DataFrame, fn, schema: str) -> DataFrame:
    """Map (path, text) of each file through ``fn``, an iterator of lists of pairs to data frames."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [assemble([(p["start_line"], p["content"]) for p in parts]) for parts in pdf["parts"]]
            yield fn(pdf["path"].tolist(), texts)

    return parts.mapInPandas(run, schema)
