"""Exact spans shared between records, found with FM-indexes over shards of candidate text.

1. Every text is fingerprinted by winnowing: of each run of ``MIN_LEN`` characters the
   least of the hashes of its ``GRAM``-grams is kept. Two equal runs keep the same one,
   so two records that share a run also share a fingerprint: nothing is lost.
2. Fingerprints in two different texts are joined back to the text around them.
   All runs that contain a kept gram lie within its context of a fixed length.
3. Distinct contexts go to shards by fingerprint. A shard builds one FM-index (wavelet
   matrix over the Burrows-Wheeler transform, rank by popcount) over its contexts and
   streams them through it by backward search; an LCP table shortens a match that cannot
   be extended (matching statistics). Runs of ``MIN_LEN`` characters whose suffix interval
   holds another record are reported, and joined back to all records with that context.
4. A fingerprint with more distinct contexts than a shard holds is spread over all shards:
   its runs that stand in two records or more are indexed one by one instead of the
   contexts around them. Equal runs are one, so no shard grows with a hot fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from weftline.session import cut_lineage, written

MIN_LEN = 200
GRAM = 100
SHARD_CONTEXTS = 5000
#: Distinct contexts of one fingerprint from which on its runs are indexed one by one, in shards.
CROWDED = 2
BLOCK_CHARS = 1 << 19

_M = np.uint64(6364136223846793005)
_INV = np.uint64(pow(int(_M), -1, 2**64))
_POWERS: dict = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS.get("n", 0) < n:
        n2 = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            for k, m in (("up", _M), ("down", _INV)):
                p = np.full(n2, m, np.uint64)
                p[0] = 1
                _POWERS[k] = np.cumprod(p)
        _POWERS["n"] = n2
    return _POWERS["up"][:n], _POWERS["down"][:n]


def gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hashes of all runs of ``gram`` code points."""
    up, down = _powers(len(codes) + 1)
    with np.errstate(over="ignore"):
        acc = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes.astype(np.uint64) * up[:-1], out=acc[1:])
        h = (acc[gram:] - acc[:-gram]) * down[: len(codes) - gram + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def winnow(texts: list[str], min_len: int = MIN_LEN, gram: int = GRAM, block: int = BLOCK_CHARS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, position, fingerprint) of the kept grams of all texts, in blocks of about ``block`` characters.

    A longer text is cut into segments that overlap by ``min_len - 1``, so each of its runs lies within one.
    """
    docs, starts, parts, size, out = [], [], [], 0, []

    def flush() -> None:
        if parts:
            d, p, f = _winnow_block(parts, min_len, gram)
            out.append((np.array(docs, np.int64)[d], np.array(starts, np.int64)[d] + p, f))
            docs.clear(), starts.clear(), parts.clear()

    for i, text in enumerate(texts):
        for start in range(0, max(1, len(text) - min_len + 1), block):
            part = text[start : start + block + min_len - 1]
            docs.append(i), starts.append(start), parts.append(part)
            size += len(part)
            if size >= block:
                flush()
                size = 0
    flush()
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _winnow_block(texts: list[str], min_len: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lens = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lens)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    none = np.zeros(0, np.int64)
    if len(codes) < min_len:
        return none, none, none.astype(np.uint64)
    h = gram_hashes(codes, gram)
    bits = max(1, int(len(h) - 1).bit_length())
    key = (h >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(h), dtype=np.uint64)
    width, w = min_len - gram + 1, 1
    least = key
    while w * 2 <= width:
        least = np.minimum(least[: len(least) - w], least[w:])
        w *= 2
    if w < width:
        gap = width - w
        least = np.minimum(least[: len(least) - gap], least[gap:])
    inside = np.zeros(len(codes) + 1, np.int32)  # starts of runs that lie within one text
    ok = lens >= min_len
    np.add.at(inside, (ends - lens)[ok], 1)
    np.add.at(inside, (ends - min_len + 1)[ok], -1)
    valid = np.cumsum(inside)[: len(least)] > 0
    kept = least[valid]
    if not len(kept):
        return none, none, none.astype(np.uint64)
    new = np.concatenate([[True], kept[1:] != kept[:-1]])
    pos = np.unique((kept[new] & np.uint64((1 << bits) - 1)).astype(np.int64))
    doc = np.searchsorted(ends, pos, side="right")
    return doc, pos - (ends - lens)[doc], h[pos]


def fingerprints(docs: DataFrame, min_len: int = MIN_LEN, gram: int = GRAM) -> DataFrame:
    """(fp, doc_id, content, pos): the winnowed grams of each text; ``content`` is a hash of the whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            doc, pos, fp = winnow(pdf["text"].tolist(), min_len, gram)
            yield pd.DataFrame({"fp": fp.view(np.int64), "doc_id": pdf["doc_id"].to_numpy()[doc], "content": pdf["content"].to_numpy()[doc], "pos": pos.astype(np.int32)})

    return docs.where(F.length("text") >= min_len).select("doc_id", "text", F.xxhash64("text").alias("content")).mapInPandas(run, "fp long, doc_id long, content long, pos int")


class FMIndex:
    """Suffix order, LCP (up to ``cap``), and a wavelet matrix over the BWT of a text of small codes."""

    def __init__(self, codes: np.ndarray, cap: int):
        n = self.n = len(codes)
        base = np.unique(codes, return_inverse=True)[1].astype(np.int64)
        self.sigma = int(base.max()) + 1
        # prefix doubling begins with as many symbols as fit one number
        bits, m = self.sigma.bit_length(), 1
        while 2 * m * bits <= 62 and m < 8:
            m *= 2
        padded, key = np.concatenate([base + 1, np.zeros(m, np.int64)]), np.zeros(n, np.int64)
        for i in range(m):
            key = (key << bits) | padded[i : i + n]
        ranks, step = [], m
        while True:
            sa = np.argsort(key)
            s = key[sa]
            rank = np.zeros(n, np.int64)
            rank[sa] = np.cumsum(np.concatenate([[0], (s[1:] != s[:-1]).astype(np.int64)]))
            if step >= 2 * cap or rank.max() == n - 1:
                break
            ranks.append(rank.astype(np.int32))  # equal where ``step`` symbols are
            second = np.zeros(n, np.int64)
            second[: n - step] = rank[step:] + 1
            key = rank * (n + 1) + second
            step *= 2
        self.sa = sa.astype(np.int32)
        lcp = np.zeros(n, np.int32)
        i, j = self.sa[:-1].copy(), self.sa[1:].copy()
        out = np.zeros(n - 1, np.int32)
        for k in range(len(ranks) - 1, -1, -1):  # ranks past the end differ from all
            r = np.concatenate([ranks[k], [-1]])
            same = (r[np.minimum(i, n)] == r[np.minimum(j, n)]) & (i < n) & (j < n)
            step = same.astype(np.int32) * (m << k)
            out += step
            i += step
            j += step
        same = np.ones(n - 1, bool)
        for _ in range(m - 1):  # what is left is shorter than the first symbols taken together
            same &= (i < n) & (j < n)
            same &= base[np.minimum(i, n - 1)] == base[np.minimum(j, n - 1)]
            out += same
            i += same
            j += same
        lcp[1:] = np.minimum(out, cap)
        del ranks, rank, key, s, out, i, j, padded
        self.low = [lcp.astype(np.uint8 if cap < 256 else np.int32)]  # minima over runs of 2^k
        while (w := 1 << (len(self.low) - 1)) * 2 <= n:
            last = self.low[-1]
            self.low.append(np.minimum(last[: len(last) - w], last[w:]))
        bwt = base[sa - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(base, minlength=self.sigma))])
        self.bits = max(1, int(self.sigma - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        cur = bwt
        for level in range(self.bits - 1, -1, -1):
            bit = (cur >> level) & 1
            packed = np.zeros((n // 64 + 2) * 8, np.uint8)
            raw = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed[: len(raw)] = raw
            words = packed.view(np.uint64)
            self.words.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int32)]).astype(np.int32))
            self.zeros.append(n - int(bit.sum()))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol ``c`` stands in the first ``i`` places of the BWT."""
        lo, hi = np.zeros_like(i), i
        for k in range(self.bits):
            words, counts, zeros = self.words[k], self.counts[k], self.zeros[k]
            bit = (c >> (self.bits - 1 - k)) & 1
            ones_lo, ones_hi = _ones(words, counts, lo), _ones(words, counts, hi)
            lo = np.where(bit, zeros + ones_lo, lo - ones_lo)
            hi = np.where(bit, zeros + ones_hi, hi - ones_hi)
        return hi - lo

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix interval after putting ``c`` before the match."""
        both = self.rank(np.concatenate([c, c]), np.concatenate([lo, hi]))
        return self.first[c] + both[: len(c)], self.first[c] + both[len(c) :]

    def widen(self, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of all suffixes that agree with those in [lo, hi) on ``depth`` characters."""
        at, way = np.concatenate([lo, hi]), np.repeat(np.array([-1, 1]), len(lo))
        depth, todo, k = np.concatenate([depth, depth]), np.arange(len(at)), 0
        tops = np.zeros(len(at), np.int64)
        while len(todo) and k < len(self.low):  # gallop while the minima allow, then halve
            todo = todo[self._moves(at, depth, way, todo, k)]
            at[todo] += way[todo] << k
            tops[todo] = k + 1
            k += 1
        for k in range(int(tops.max(initial=0)) - 1, -1, -1):
            rest = np.flatnonzero(tops > k)
            rest = rest[self._moves(at, depth, way, rest, k)]
            at[rest] += way[rest] << k
        return at[: len(lo)], at[len(lo) :]

    def _moves(self, at: np.ndarray, depth: np.ndarray, way: np.ndarray, lanes: np.ndarray, k: int) -> np.ndarray:
        """Which lanes can move their border by 2^k places up (-1) or down: the LCP values passed are at least ``depth``."""
        w, low, a, up = 1 << k, self.low[k], at[lanes], way[lanes] < 0
        first = np.where(up, a - w + 1, a)
        ok = np.where(up, first >= 1, first + w <= self.n)
        ok[ok] = low[first[ok]] >= depth[lanes[ok]]
        return ok

    def lcp(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        ok = (i > 0) & (i < self.n)
        out[ok] = self.low[0][i[ok]]
        return out


def _ones(words: np.ndarray, counts: np.ndarray, i: np.ndarray) -> np.ndarray:
    w = i >> 6
    mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
    return counts[w] + np.bitwise_count(words[w] & mask)


def matching_statistics(index: FMIndex, rows: np.ndarray, cap: int, shared: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each place of equally long coded texts, right to left: (place, lo, hi, length of the match of two suffixes or more).

    ``rows``: matrix of codes, one text a row; a code under 0 is padding and matches nothing. ``shared``
    marks suffixes (by their place in the order) that stand for several records and so count as two.
    """
    n, width = rows.shape
    lo, hi, q = np.zeros(n, np.int64), np.full(n, index.n, np.int64), np.zeros(n, np.int64)
    for j in range(width - 1, -1, -1):
        c = rows[:, j].astype(np.int64)
        todo = np.flatnonzero(c >= 0)
        pad = c < 0
        lo[pad], hi[pad], q[pad] = 0, index.n, 0
        while len(todo):
            l2, h2 = index.extend(c[todo], lo[todo], hi[todo])
            good = h2 - l2 >= 2
            if shared is not None:
                good |= (h2 - l2 == 1) & shared[np.minimum(l2, index.n - 1)]
            g = todo[good]
            lo[g], hi[g] = l2[good], h2[good]
            q[g] += 1
            bad = todo[~good]
            at_root = q[bad] == 0
            r = bad[at_root]
            lo[r], hi[r] = 0, index.n
            todo = bad[~at_root]
            if len(todo):  # the nearest wider interval of the suffix tree
                d = np.maximum(index.lcp(lo[todo]), index.lcp(hi[todo]))
                d = np.minimum(d, q[todo] - 1)
                lo[todo], hi[todo] = index.widen(lo[todo], hi[todo], d)
                q[todo] = d
                zero = todo[d == 0]
                lo[zero], hi[zero] = 0, index.n
        over = np.flatnonzero(q > cap)
        if len(over):
            lo[over], hi[over] = index.widen(lo[over], hi[over], np.full(len(over), cap))
            q[over] = cap
        yield j, lo, hi, q


def _mix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = x.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _spread(keys: np.ndarray, sizes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key repeated by its size, and the places begin, begin + 1, ... that go with it."""
    first = np.cumsum(sizes) - sizes
    return np.repeat(keys, sizes), np.arange(int(sizes.sum())) - np.repeat(first, sizes) + np.repeat(begins, sizes)


def _shard(min_len: int):
    """Shared runs of the distinct contexts of a shard: (fp, h, first, last, cls), run starts relative to the context."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        texts, doc, many = pdf["context"].tolist(), pdf["doc"].to_numpy(np.int64), pdf["many"].to_numpy(bool)
        lens = np.array([len(t) for t in texts], np.int64)
        raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        flat = np.unique(raw, return_inverse=True)[1]
        width, n = int(lens.max()), len(texts)
        rows = np.full((n, width), -1, np.int32)
        rows[np.arange(width)[None, :] < lens[:, None]] = flat
        # the indexed text: contexts, each followed by an end mark (code 0), the least symbol of the index
        joined = np.zeros(int(lens.sum()) + n, np.int64)
        at = np.cumsum(lens + 1) - lens - 1
        joined[np.repeat(at, lens) + np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat + 1
        index = FMIndex(joined, min_len)
        owner = (np.searchsorted(at, index.sa, side="right") - 1).astype(np.int32)
        found = []
        for j, lo, hi, q in matching_statistics(index, np.where(rows >= 0, rows + 1, -1), min_len, many[owner]):
            r = np.flatnonzero(q >= min_len)
            if len(r):
                found.append((r, np.full(len(r), j), lo[r], hi[r]))
        out = pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("fp", "int64"), ("h", "int64"), ("first", "int32"), ("last", "int32"), ("cls", "int64"))})
        if not found:
            return out
        row, j, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
        span, which = np.unique(lo * (index.n + 1) + hi, return_inverse=True)
        slo, shi = span // (index.n + 1), span % (index.n + 1)
        size = shi - slo
        inner, place = _spread(np.arange(len(span)), size, slo)
        who = owner[place]
        order = np.lexsort((who, inner))
        inner, who = inner[order], who[order]
        once = np.concatenate([[True], (inner[1:] != inner[:-1]) | (who[1:] != who[:-1])])
        inner, who = inner[once], who[once]
        begin = np.flatnonzero(np.concatenate([[True], inner[1:] != inner[:-1]]))
        # two records: a context that stands in several, or contexts of different ones
        two = np.logical_or.reduceat(many[who], begin) | (np.minimum.reduceat(doc[who], begin) != np.maximum.reduceat(doc[who], begin))
        fp, h = pdf["fp"].to_numpy(np.int64), pdf["h"].to_numpy(np.int64)
        with np.errstate(over="ignore"):
            cls = np.add.reduceat(_mix64(fp[who] ^ _mix64(h[who]).view(np.int64)), begin)
        keep = two[which]
        row, j, cls = row[keep], j[keep], cls[which[keep]].view(np.int64)
        if not len(row):
            return out
        # runs of neighbouring places with the same set of contexts become one row
        order = np.lexsort((j, row))
        row, j, cls = row[order], j[order], cls[order]
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (j[1:] != j[:-1] + 1) | (cls[1:] != cls[:-1])])
        a = np.flatnonzero(new)
        b = np.concatenate([a[1:], [len(row)]]) - 1
        return pd.DataFrame({"fp": fp[row[a]], "h": h[row[a]], "first": j[a].astype(np.int32), "last": j[b].astype(np.int32), "cls": cls[a]})

    return run


_RUNS = "fp long, h long, first int, last int, cls long"


def _indexed(distinct: DataFrame, by: str, min_len: int) -> DataFrame:
    """Shared runs of distinct texts (fp, h, context, doc, many), in shards by the column ``by``."""
    shards = max(1, -(-distinct.count() // SHARD_CONTEXTS))
    # several partitions a shard: by size alone the shards, small but slow, would end up in a few tasks
    dealt = distinct.withColumn("shard", F.pmod(F.hash(by), F.lit(shards))).repartition(4 * shards, "shard")
    return dealt.groupBy("shard").applyInPandas(_shard(min_len), _RUNS)


def _distinct(rows: DataFrame) -> DataFrame:
    """(fp, h, context, doc, many) of rows (fp, h, context, doc_id): ``many`` where more than one record has the text."""
    one = rows.groupBy("fp", "h").agg(F.any_value("context").alias("context"), F.min("doc_id").alias("doc"), F.max("doc_id").alias("_last"))
    return one.select("fp", "h", "context", "doc", (F.col("doc") != F.col("_last")).alias("many"))


def _runs_of(contexts: DataFrame, min_len: int) -> DataFrame:
    """(fp, h, doc_id, start, at): the runs of ``min_len`` characters of contexts by two hashes in one number, with their place in the context."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = []
            for fp, doc, start, text in zip(pdf["fp"], pdf["doc_id"], pdf["start"], pdf["context"], strict=True):
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                h = gram_hashes(codes, min_len)
                back = gram_hashes(codes[::-1] + np.uint32(7), min_len)[::-1]
                key = _mix64(h.view(np.int64)) ^ back
                parts.append(pd.DataFrame({"fp": fp, "h": key.view(np.int64), "doc_id": doc, "start": start + np.arange(len(h)), "at": np.arange(len(h), dtype=np.int32)}))
            if parts:
                yield pd.concat(parts)

    return contexts.where(F.length("context") >= min_len).select("fp", "doc_id", "start", "context").mapInPandas(run, "fp long, h long, doc_id long, start long, at int")


def shared_spans(docs: DataFrame, *, min_len: int = MIN_LEN, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(spans, classes). spans: (doc_id, start, stop, cls), stretches of a class representative that stand in
    other texts too; the records with the same ``cls`` share a run. classes: (doc_id, rep) for identical texts.

    docs: (doc_id, text), doc_id unique (repeated rows count as one record with the same text). Null and short
    texts share nothing. Characters are compared as stored; other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    prints = written(fingerprints(docs, min_len, gram))
    ids = docs.where(F.length("text") >= min_len).select("doc_id", F.xxhash64("text").alias("content"), F.length("text").alias("n"))
    reps = ids.groupBy("content", "n").agg(F.min("doc_id").alias("rep"))
    classes = written(ids.join(reps, ["content", "n"]).select("doc_id", "rep").distinct())
    shared = prints.groupBy("fp").agg(F.min("content").alias("_a"), F.max("content").alias("_b")).where("_a <> _b").select("fp")
    at = prints.select("fp", "doc_id", "pos").join(shared, "fp").join(classes.where("doc_id = rep").select("doc_id"), "doc_id", "left_semi")
    at = written(at.distinct())
    side = min_len - gram
    per_doc = at.groupBy("doc_id").agg(F.collect_list(F.struct("fp", "pos")).alias("_at"))  # at most one for each place of the text
    contexts = docs.join(per_doc, "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", F.explode("_at").alias("x")).select(
        F.col("x.fp").alias("fp"), "doc_id", F.greatest(F.col("x.pos") - side, F.lit(0)).cast("long").alias("start"),
        F.expr(f"substring(text, greatest(x.pos - {side}, 0) + 1, x.pos + {gram + side} - greatest(x.pos - {side}, 0))").alias("context"),
    )
    contexts = written(contexts.withColumn("h", F.xxhash64("context")))
    distinct = _distinct(contexts)
    hot = cut_lineage(distinct.groupBy("fp").count().where(F.col("count") > CROWDED * SHARD_CONTEXTS).select("fp"))
    runs = _indexed(distinct.join(hot, "fp", "left_anti"), "fp", min_len)
    place = contexts.select("fp", "h", "doc_id", "start")
    spans = _placed(runs, place, min_len)
    if hot.limit(1).count():
        crowded = contexts.join(hot, "fp", "left_semi")
        windows = written(_runs_of(crowded, min_len))
        twice = windows.groupBy("fp", "h").agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b"), F.min(F.struct("doc_id", "start", "at")).alias("_one")).where("_a <> _b")
        sample = twice.select("fp", "h", F.col("_one.doc_id").alias("doc_id"), (F.col("_one.start") - F.col("_one.at")).alias("start"), F.col("_one.at").alias("at"), F.lit(True).alias("many"), F.col("_a").alias("doc"))
        texts = sample.join(crowded.select("fp", "doc_id", "start", "context"), ["fp", "doc_id", "start"])
        texts = cut_lineage(texts.select("fp", "h", F.expr(f"substring(context, at + 1, {min_len})").alias("context"), "doc", "many"))
        spans = spans.unionByName(_placed(_indexed(texts, "h", min_len), windows.select("fp", "h", "doc_id", "start"), min_len))
    return cut_lineage(spans.distinct()), classes


def _placed(runs: DataFrame, place: DataFrame, min_len: int) -> DataFrame:
    """Spans of all records from the runs of distinct texts."""
    both = runs.join(place, ["fp", "h"])
    return both.select("doc_id", (F.col("start") + F.col("first")).alias("start"), (F.col("start") + F.col("last") + min_len).alias("stop"), "cls")


def sharing_pairs(spans: DataFrame, classes: DataFrame, min_len: int = MIN_LEN) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: all records that share a run, identical texts included. See ``sharing_classes`` where they are too many."""
    members = spans.select("cls", "doc_id").distinct()
    links = members.alias("l").join(members.alias("r"), F.expr("l.cls = r.cls and l.doc_id < r.doc_id")).select(
        F.col("l.doc_id").alias("a"), F.col("r.doc_id").alias("b")
    ).distinct()
    of = lambda rep, doc: classes.select(F.col("rep").alias(rep), F.col("doc_id").alias(doc))
    across = links.join(of("a", "x"), "a").join(of("b", "y"), "b").select("x", "y")
    within = of("rep", "x").join(of("rep", "y"), "rep").where("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))


def sharing_classes(spans: DataFrame, classes: DataFrame) -> DataFrame:
    """A row for every record that could share a run: (doc_id, class_id, class_size, group_id, links).

    Identical texts are one class, named by its least id; the classes with exactly the same shared runs are one group, named
    likewise. ``links`` counts the other records that share a run with this one. Pairs are only formed of groups: a footer in
    any number of records is one group of those that share nothing else, and one for each different set of further shared runs.
    """
    sizes = classes.groupBy("rep").agg(F.count("*").alias("class_size"))
    runs = spans.select("doc_id", "cls").distinct().groupBy(F.col("doc_id").alias("rep")).agg(F.sort_array(F.collect_set("cls")).alias("_runs"))  # as many as the text has places
    signed = cut_lineage(sizes.join(runs, "rep", "left"))
    groups = signed.where("_runs IS NOT NULL").groupBy("_runs").agg(F.min("rep").alias("group_id"), F.sum("class_size").alias("_w"))
    member = cut_lineage(groups)
    each = member.select("group_id", "_w", F.explode("_runs").alias("cls"))
    near = each.select("group_id", "cls").join(each.select(F.col("group_id").alias("_other"), "cls", "_w"), "cls").where("group_id <> _other").select("group_id", "_other", "_w").distinct()
    beyond = near.groupBy("group_id").agg(F.sum("_w").alias("_beyond"))
    total = member.join(beyond, "group_id", "left").select("_runs", "group_id", (F.col("_w") + F.coalesce("_beyond", F.lit(0))).alias("_links"))
    per = signed.join(total, "_runs", "left").select("rep", "class_size", "group_id", (F.coalesce("_links", "class_size") - 1).alias("links"))
    return classes.join(per, "rep").select("doc_id", F.col("rep").alias("class_id"), "class_size", F.coalesce("group_id", "rep").alias("group_id"), "links")


def coverage(docs: DataFrame, spans: DataFrame, classes: DataFrame) -> DataFrame:
    """A row for every record: (doc_id, n_chars, n_spans, shared_chars, shared_share); null texts have 0 characters."""
    by_start = Window.partitionBy("doc_id").orderBy("start", "stop")
    before = F.max("stop").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.select("doc_id", "start", "stop").withColumn("_new", F.when(before >= F.col("start"), 0).otherwise(1))
    islands = marked.withColumn("_island", F.sum("_new").over(by_start)).groupBy("doc_id", "_island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    per_rep = islands.groupBy(F.col("doc_id").alias("rep")).agg(F.count("*").alias("_spans"), F.sum(F.col("stop") - F.col("start")).alias("_chars"))
    sizes = classes.groupBy("rep").agg(F.count("*").alias("_copies"))
    info = classes.join(sizes, "rep").join(per_rep, "rep", "left").select("doc_id", "_copies", "_spans", "_chars")
    base = docs.groupBy("doc_id").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("n_chars")).join(info, "doc_id", "left")
    whole = F.col("_copies") > 1
    chars = F.when(whole, F.col("n_chars")).otherwise(F.coalesce("_chars", F.lit(0))).cast("long")
    return base.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"),
        F.when(whole, 1).otherwise(F.coalesce("_spans", F.lit(0))).cast("long").alias("n_spans"),
        chars.alias("shared_chars"),
        F.when(F.col("n_chars") > 0, chars / F.col("n_chars")).otherwise(0.0).alias("shared_share"),
    )
