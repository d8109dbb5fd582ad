"""A store of remembered texts: TF-IDF retrieval, duplicates, pruning and a context within a budget."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.functions.text import word_tokens
from weftline.operators.context import within_budget
from weftline.session import broadcast_if_small, cut_lineage, written

#: Counters of words, by which the rare ones are told from the common ones; words that share a counter pass for more common than they are.
BUCKETS = 1 << 16
#: Of the rarest words, how many two sets must share to be compared; prefixes are longer by that.
SHARED = 3


def tfidf(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """(qid, id, score): sum over the words of the query of tf/length * ln(n/df + 1), times 1 + importance; scores over 0.

    entries: (id, content, importance). Null contents score nothing. A word that a query repeats counts as often.
    """
    n = entries.count()
    q = queries.select("qid", F.explode(word_tokens(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qn"))
    counted = entries.select("id", "importance", word_tokens(F.col("content")).alias("_w")).select("id", "importance", F.size("_w").alias("len"), "_w")
    hit = counted.select("id", "importance", "len", F.explode("_w").alias("term")).join(q.select("term").distinct(), "term", "left_semi")
    tf = hit.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"), F.first("importance").alias("importance"))
    idf = tf.groupBy("term").agg(F.log(F.lit(n) / F.count("*") + 1.0).alias("idf"))
    part = F.col("tf") / F.col("len") * F.col("idf") * F.col("qn")
    scored = tf.join(q.join(idf, "term"), "term").groupBy("qid", "id").agg(F.round(F.sum(part) * (1.0 + F.first("importance")), 6).alias("score"))
    return scored.where("score > 0")


def context(queries: DataFrame, entries: DataFrame, k: int, max_chars: int) -> DataFrame:
    """(qid, id, rank, running): the best ``k`` entries of each query up to the first that exceeds the budget of characters."""
    from weftline.operators.lexical import top_k

    best = top_k(tfidf(queries, entries), k).join(entries.select("id", F.length("content").alias("chars")), "id")
    return within_budget(best, "qid", ["rank"], "chars", max_chars).select("qid", "id", "rank", F.col("running").cast("long").alias("running"))


def prune(entries: DataFrame, most: int, keep: int) -> DataFrame:
    """Entries (id, importance, access_count): beyond ``most``, only the ``keep`` with the highest importance + 0.1 * accesses.

    Ties go by id. The cut is a top-k: each task sends its best ``keep`` rows only.
    """
    worth = entries.withColumn("worth", F.round(F.col("importance") + 0.1 * F.col("access_count"), 6))
    if entries.count() <= most:
        return worth
    return worth.orderBy(F.desc("worth"), "id").limit(keep)


def latest(entries: DataFrame, k: int) -> DataFrame:
    """Entries (category, created_at, id) with their place in their category, the ``k`` latest of each; without a time they come last."""
    by = Window.partitionBy("category").orderBy(F.desc_nulls_last("created_at"), F.col("id").cast("long").desc())
    return entries.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k)


def add(entries: DataFrame, new: DataFrame) -> DataFrame:
    """(id, action, match_id, importance) of each entry of ``new`` (id, content, category, importance) added after ``entries`` in order of its id.

    ``merged``: an earlier entry of the category has nearly the same words and takes the higher importance; else ``added``.
    """
    placed = lambda df, late: df.withColumn("place", F.struct(F.lit(late).alias("late"), F.col("id").cast("long").alias("n")))
    near = duplicates(placed(entries, 0).unionByName(placed(new, 1))).withColumnRenamed("importance", "_raised")
    return new.select("id", "importance").join(near, "id", "left").select(
        "id", F.when(F.col("match_id").isNull(), "added").otherwise("merged").alias("action"), "match_id", F.coalesce("_raised", "importance").alias("importance")
    )


def duplicates(entries: DataFrame) -> DataFrame:
    """(id, match_id, importance): entries whose words are nearly those of an earlier one, the first such, and the higher importance of the two.

    entries: (id, content, category, importance, place). The category is the same and the Jaccard similarity over 0.85; earlier
    goes by place. Equal word sets of a category are one class. Classes meet on their rarest words, as hashes with the parity of each
    set's bits; only pairs that can be near by their bits have their words compared, so that the words of the others are never shuffled.
    """
    words, cat = F.sort_array(F.array_distinct(word_tokens(F.col("content")))), F.coalesce("category", F.lit("")).alias("cat")
    e = entries.select("id", "importance", F.struct("place", "id", "importance").alias("at"), cat, words.alias("words")).where(F.size("words") > 0)
    hashes = F.transform("words", lambda w: F.hash("cat", w)).alias("h")
    keyed = written(e.select("id", "importance", "at", F.unhex(F.md5(F.concat_ws(" ", "cat", "words"))).alias("class"), hashes))
    sets = keyed.groupBy("class").agg(F.min("at").alias("at"))
    freq = np.zeros(BUCKETS, np.int64)
    for b, f in keyed.select("h").mapInArrow(_frequencies, "b int, f long").groupBy("b").agg(F.sum("f")).collect():  # no more rows than buckets
        freq[b] = f
    prefix = keyed.select("class", "h").mapInArrow(_prefixes(freq), "class binary, n int, again int, b0 long, b1 long, more array<long>, key int").repartition("key").distinct()
    a, b = prefix.alias("a"), prefix.alias("b")
    reachable = (F.col("a.n") * 100 >= F.col("b.n") * 85) & (F.col("b.n") * 100 >= F.col("a.n") * 85)
    # sets of x and y words with i in common differ in x + y - 2i, and every odd bit stands for one of these at least
    may = lambda differ, x, y: differ * 185 < (x + y) * 15
    differ = F.bit_count(F.col("a.b0").bitwiseXOR(F.col("b.b0"))) + F.bit_count(F.col("a.b1").bitwiseXOR(F.col("b.b1")))
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.class") < F.col("b.class")) & reachable & may(differ, F.col("a.n"), F.col("b.n")) & (F.coalesce(may(_apart("a.more", "b.more"), F.col("a.n"), F.col("b.n")), F.lit(True))))
    pairs = cut_lineage(met.select(F.col("a.class").alias("class"), F.col("b.class").alias("other")).groupBy("class", "other").agg(F.count("*").alias("_n")).where(F.col("_n") >= SHARED).select("class", "other"))
    finer = _both(pairs, cut_lineage(_of(pairs, sets, keyed.select("id", "h")).select("class", "h").mapInArrow(_sketches, "class binary, n int, bits array<long>")))
    differ = F.aggregate(F.zip_with("a.bits", "b.bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    left = cut_lineage(finer.where(may(differ, F.col("a.n"), F.col("b.n"))).select("class", "other"))
    both = _both(left, cut_lineage(_of(left, sets, entries.select("id", cat, "content")).select("class", "at", "cat", words.alias("words"))))
    inter = F.size(F.array_intersect("a.words", "b.words"))
    close = both.where((F.col("a.cat") == F.col("b.cat")) & (inter * 100 > (F.size("a.words") + F.size("b.words") - inter) * 85))
    near = close.select("class", F.col("b.at").alias("at")).unionByName(close.select(F.col("other").alias("class"), F.col("a.at").alias("at"))).unionByName(sets.select("class", "at"))
    first = near.groupBy("class").agg(F.min("at").alias("first"))
    got = keyed.select("id", "importance", "at", "class").join(first, "class").where(F.col("first") < F.col("at"))
    return got.select("id", F.col("first.id").alias("match_id"), F.greatest("importance", "first.importance").alias("importance"))


def _apart(a: str, b: str) -> Column:
    """In how many bits two parities differ; the longer one, of twice as many bits, is folded onto the other. Null where one is null."""
    xor = lambda x, y: x.bitwiseXOR(y)
    m = F.least(F.size(a), F.size(b))
    x, y = (F.when(F.size(c) > m, F.zip_with(F.slice(c, F.lit(1), m), F.slice(c, m + 1, m), xor)).otherwise(F.col(c)) for c in (a, b))
    return F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.aggregate(F.zip_with(x, y, xor), F.lit(0), lambda s, z: s + F.bit_count(z)))


def _of(pairs: DataFrame, sets: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (id, ...) of the first entry of each class in ``pairs``, with class and at."""
    wanted = pairs.select("class").unionByName(pairs.select(F.col("other").alias("class"))).distinct().join(sets, "class").select("class", "at", F.col("at.id").alias("id"))
    return rows.join(broadcast_if_small(cut_lineage(wanted), 100_000), "id")


def _both(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """pairs (class, other) with a struct of the row of either class, a and b."""
    whole = F.struct(*[c for c in rows.columns if c != "class"])
    return pairs.join(rows.select("class", whole.alias("a")), "class").join(rows.select(F.col("class").alias("other"), whole.alias("b")), "other")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the sets h of a batch, their hashes one after the other, and the row of each."""
    n = pc.list_value_length(batch.column("h")).to_numpy(zero_copy_only=False).astype(np.int64)
    return n, batch.column("h").flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(n)), n)


def _parity(h: np.ndarray, row: np.ndarray, rows: int, bits: int) -> np.ndarray:
    """A row of 64-bit words for each set: bit by bit, whether an odd number of its hashes falls there."""
    odd = np.bincount(row * bits + ((h >> 16) & (bits - 1)), minlength=rows * bits).astype(np.uint8) & 1
    return np.packbits(odd.reshape(rows, bits), axis=1).view(np.int64)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        total += np.bincount(_flat(batch)[1] & (BUCKETS - 1), minlength=BUCKETS)
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["b", "f"])


def _prefixes(freq: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row (class, n, again, b0, b1, more, key) for each of the rarest hashes of a set (class, h); near sets have ``SHARED`` or more of these in common.

    The order of the hashes is the same for all sets: by how often their bucket occurs, then by value. b0 and b1 are the parity of the set in 128 bits.
    These tell nothing of sets of many words, which have ``more``: bits for half of their words or a quarter. ``again`` numbers equal hashes of a set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, h, row = _flat(batch)
            parity, order = _parity(h, row, len(n), 128), np.lexsort((h, freq[h & (BUCKETS - 1)], row))
            starts = np.cumsum(n) - n
            place, h = np.arange(len(h)) - starts[row], h[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])][: len(h)]
            again = np.arange(len(h)) - np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            more = [_parity(h[s : s + m], np.zeros(m, np.int64), 1, min(2048, 1 << (int(m - 1).bit_length() - 1)))[0] if m > 256 else None for s, m in zip(starts, n, strict=True)]
            # sets of up to five words have no near one but equals, which are of their class
            kept = (place < (n - np.ceil(n * 0.85 - 1e-9).astype(np.int64) + SHARED)[row]) & (n > 5)[row]
            at, key = row[kept], h[kept]
            columns = [n[at].astype(np.int32), again[kept].astype(np.int32), parity[at, 0], parity[at, 1], pa.array(more, pa.list_(pa.int64())).take(pa.array(at)), key.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([batch.column("class").take(pa.array(at)), *map(pa.array, columns)], names=["class", "n", "again", "b0", "b1", "more", "key"])

    return run


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (class, n, bits) of each set (class, h): its parity in 2,048 bits."""
    for batch in batches:
        if len(batch):
            n, h, row = _flat(batch)
            words = _parity(h, row, len(n), 2048)
            bits = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * 32), pa.array(words.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array(n.astype(np.int32)), bits], names=["class", "n", "bits"])
