"""Cut oversized texts at natural boundaries with bounded-quantifier regexes.

One ``regexp_extract_all`` consumes the text from left to right. Its alternatives
stand in order of boundary strength and each takes as many characters as the
limit allows; the last one takes characters regardless of boundaries. Positions,
line ranges and the overlap (a lookback into the pieces before) come from SQL array
functions, so all the work stays in the JVM. The time is linear in the length of a
text: no row after the cut carries more than a piece and its overlap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Line starts that open a definition or a section (fixed values).
_DEFINITION = (
    r"(?:@|#{1,6} |def |async def |class |func |type |interface |enum |function |async function |export |"
    r"public |private |protected |static |const |let |var |import |package )"
)


def boundary_pattern(size: int) -> str:
    """Regex whose matches tile any text into pieces of at most ``size`` characters."""
    half, quarter = max(1, size // 2), max(1, size // 4)
    any_char = r"[\s\S]"
    return "|".join(
        [
            rf"{any_char}{{1,{size}}}\z",
            rf"{any_char}{{{half},{size - 1}}}\n(?=[ \t]{{0,4}}{_DEFINITION})",
            rf"{any_char}{{{half},{size - 1}}}\n(?=\r?\n)",
            rf"{any_char}{{{quarter},{size - 1}}}\n",
            rf"{any_char}{{{quarter},{size - 2}}}[.;!?}}\]](?=\s)",
            rf"{any_char}{{{quarter},{size - 1}}}\s",
            rf"{any_char}{{1,{size}}}",
        ]
    )


def split_oversized(
    df: DataFrame,
    *,
    id_col: str = "id",
    text_col: str = "content",
    start_line_col: str | None = "start_line",
    limit_tokens: int = 500,
    chars_per_token: int = 4,
    overlap_tokens: int = 25,
) -> DataFrame:
    """Pieces of every text over the limit; texts within it give no rows.

    A piece, overlap included, has at most ``limit_tokens`` (characters div
    ``chars_per_token``). The piece without its overlap is ``content[core_start:end]``
    and these tile the text exactly. The overlap is a lookback of up to
    ``overlap_tokens``, shortened to a line start if one lies inside it.

    Null texts give no rows; repeated rows give repeated pieces (deduplicate before);
    a null start line gives null line ranges; other columns are not carried over.

    Columns: id, piece_no, n_pieces, content, char_start, core_start, char_end,
    start_line, end_line, tokens.
    """
    if overlap_tokens * 2 > limit_tokens:
        raise ValueError("the overlap may take half of a piece at most")
    limit, over = limit_tokens * chars_per_token, overlap_tokens * chars_per_token
    core = limit - over
    first_line = F.col(start_line_col).cast("int") if start_line_col else F.lit(0)
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("_t"), first_line.alias("_line")).where(
        F.expr(f"length(_t) div {chars_per_token} > {limit_tokens}")
    )
    cut = src.withColumn("_p", F.regexp_extract_all("_t", F.lit(boundary_pattern(core)), F.lit(0))).select("id", "_line", "_p", *_starts("_p"))
    # a lookback may reach over several pieces, of which all but the last have a quarter of the core at least
    back = 1 + -(-over // max(1, core // 4))
    tail = f"concat({', '.join(f'coalesce(get(_p, i - {k}), {_EMPTY})' for k in range(back, 0, -1))})"
    rows = cut.select(
        "id", "_line", F.size("_p").alias("n_pieces"),
        F.posexplode(F.expr(f"transform(_p, (x, i) -> named_struct('core', x, 'look', right({tail}, {over}), 'at', _at[i]))")).alias("piece_no", "_r"),
    )
    line_start = F.expr(f"CASE WHEN instr(_r.look, {_BREAK}) BETWEEN 1 AND length(_r.look) - 1 THEN substring(_r.look, instr(_r.look, {_BREAK}) + 1) ELSE _r.look END")
    rows = rows.select("id", "_line", "n_pieces", "piece_no", "_r.core", "_r.at", line_start.alias("look"))
    newlines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    content = F.concat("look", "core")
    return rows.select(
        "id",
        F.col("piece_no").cast("int").alias("piece_no"),
        F.col("n_pieces").cast("int").alias("n_pieces"),
        content.alias("content"),
        (F.col("at.n") - F.length("look")).alias("char_start"),
        F.col("at.n").alias("core_start"),
        (F.col("at.n") + F.length("core")).alias("char_end"),
        (F.col("_line") + F.col("at.l") - newlines(F.col("look"))).alias("start_line"),
        (F.col("_line") + F.col("at.l") + newlines(F.expr("left(core, length(core) - 1)"))).alias("end_line"),
        F.floor(F.length(content) / chars_per_token).cast("int").alias("tokens"),
    )


_EMPTY, _BREAK = "''", r"'\n'"
BLOCK_PIECES = 256


def _starts(pieces: str) -> list:
    """Column ``_at``: characters and lines before each piece. Running sums are taken within blocks of pieces and over the blocks,
    so that no accumulator grows with the text."""
    add = "named_struct('n', {0}.n + x.n, 'l', {0}.l + x.l)"
    zero = "named_struct('n', 0, 'l', 0)"
    sizes = f"transform({pieces}, x -> named_struct('n', length(x), 'l', length(x) - length(replace(x, {_BREAK}, {_EMPTY}))))"
    blocks = f"transform(sequence(0, greatest((size({pieces}) - 1) div {BLOCK_PIECES}, 0)), b -> slice(_sizes, b * {BLOCK_PIECES} + 1, {BLOCK_PIECES}))"
    running = lambda first, items: f"aggregate({items}, array({first}), (acc, x) -> concat(acc, array({add.format('element_at(acc, -1)')})))"
    totals = f"transform(_blocks, b -> aggregate(b, {zero}, (acc, x) -> {add.format('acc')}))"
    within = running("_firsts[k]", "slice(b, 1, size(b) - 1)")
    whole = f"flatten(transform(_blocks, (b, k) -> {within}))"
    # each step is a lambda over an array of one element, which names the step before
    steps = [("_sizes", sizes), ("_blocks", blocks), ("_firsts", running(zero, totals))]
    for name, value in reversed(steps):
        whole = f"transform(array({value}), {name} -> {whole})[0]"
    return [F.expr(whole).alias("_at")]


def latest_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the last by ``order`` (ties: any, they repeat the row)."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.coalesce(F.col(order), F.lit(0).cast("timestamp"))).alias("_r")).select(key, "_r.*")
