"""Most similar vectors by cross-polytope hashing with multiprobe tables and exact reranking.

A hash applies a pseudo-rotation (three rounds of random signs and a fast Hadamard
transform) to the unit vector and takes the nearest signed axis. The first hash has
2 x dim axes; a second one over fewer rotated coordinates refines it, with as many
axes as keep buckets near ``BUCKET_ROWS``. Every vector enters its nearest buckets of
each table, a query probes more of them. Within a bucket, candidates are found by a blocked
matrix product and reranked by their exact cosine; the best of all buckets are merged.

Buckets over ``HOT`` times that are split by further hashes, and near copies, which these
leave together, by hashes of their differences from the bucket's mean, which tell them
apart at any scale. What no hash splits is compared block by block, so nothing is dropped. Of identical vectors only the first k + 1 ids are hashed: no
other of them can be among the k nearest of any vector, and all of them have the same k
nearest as the last one that is hashed.

Near neighbours (cosine 0.85 and more) are found with the few probes of a self-join. The
neighbours of a vector that has no near ones are as far as chance has it, and hardly any
closer than thousands of others; no hash can tell them apart, so a share of all buckets has
to be probed (``query_share``), whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from weftline.session import at_most, cut_lineage

BUCKET_ROWS = 16_384
#: For a set of queries, of which each bucket sees few: larger buckets, so that a query goes to fewer of them.
BUCKET_ROWS_ASKED = 131_072
#: A bucket over this many times the intended rows is split.
HOT = 2
HOT_KEYS = 500_000
#: A hot bucket is split this many times by further hashes, then by hashes of the differences from its mean.
DIRECT, DEEPEST = 3, 5
ENTRIES_A_TASK = 40_000
HEIRS_A_PART = 50_000
SEED = 20_011
_CACHE: dict = {}


def usable(vector: Column, dim: int) -> Column:
    """Whether a vector has ``dim`` finite components, not all zero (null counts as false)."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _size(dim: int) -> int:
    return 1 << max(0, dim - 1).bit_length()


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (their length is a power of two), as a product of small ones of eight columns."""
    n, out, done = x.shape[1], x, 1
    while done < n:
        step = min(8, n // done)
        h = np.array([[1.0]], x.dtype)
        while len(h) < step:
            h = np.block([[h, h], [h, -h]])
        # the last axis of the index is transformed and moved to the front; after all of them the order is the first one again
        out = (out.reshape(-1, step) @ h).reshape(len(x), n // step, step).transpose(0, 2, 1).reshape(len(x), n)
        done *= step
    return out * x.dtype.type(1 / np.sqrt(n))


def rotate(unit: np.ndarray, table: int, level: int) -> np.ndarray:
    """Three rounds of random signs and a Hadamard transform; the input is zero-padded to a power of two."""
    dim = unit.shape[1]
    n, key = _size(dim), (dim, table, level)
    if key not in _CACHE:
        _CACHE[key] = np.random.default_rng([SEED, dim, table, level]).choice(np.array([-1, 1], np.float32), (3, n))
    x = unit.astype(np.float32) if n == dim else np.pad(unit.astype(np.float32), ((0, 0), (0, n - dim)))
    for signs in _CACHE[key]:
        x = hadamard(x * signs)
    return x


def axes(unit: np.ndarray, table: int, level: int, coordinates: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest signed axes of each vector and what each costs against the best one."""
    y = rotate(unit, table, level)[:, :coordinates]
    score = np.concatenate([y, -y], axis=1)
    m = min(probes, score.shape[1])
    best = np.argpartition(-score, m - 1, axis=1)[:, :m] if m < score.shape[1] else np.tile(np.arange(m), (len(unit), 1))
    s = np.take_along_axis(score, best, 1)
    order = np.argsort(-s, axis=1, kind="stable")
    best, s = np.take_along_axis(best, order, 1), np.take_along_axis(s, order, 1)
    return best.astype(np.int64), s[:, :1] ** 2 - np.sign(s) * s**2


def buckets(unit: np.ndarray, table: int, fine: int, probes: int) -> np.ndarray:
    """The ``probes`` nearest bucket codes of each vector; ``fine``: coordinates of the second hash, 0 for none."""
    code, cost = axes(unit, table, 0, _size(unit.shape[1]), probes)
    if fine:
        c2, k2 = axes(unit, table, 1, fine, probes)
        code = (code[:, :, None] * (2 * fine) + c2[:, None, :]).reshape(len(unit), -1)
        cost = (cost[:, :, None] + k2[:, None, :]).reshape(len(unit), -1)
        order = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        code = np.take_along_axis(code, order, 1)
    return code


def fine_coordinates(n: int, dim: int, copies: int, bucket_rows: int) -> int:
    """Coordinates of the second hash that bring the mean bucket down to ``bucket_rows``."""
    need, fine = n * copies / (2 * _size(dim) * bucket_rows), 0
    while (2 * fine or 1) < need and fine < _size(dim):
        fine = 2 * fine or 1
    return fine


def pack24(x: np.ndarray) -> list[bytes]:
    """Unit vectors as 24-bit fixed point (the precision of a float's mantissa), three bytes a component."""
    q = np.rint(x * (2**23 - 1)).astype("<i4")
    return [r.tobytes() for r in q.view(np.uint8).reshape(len(q), -1, 4)[:, :, :3].copy()]


def unpack24(rows: list[bytes], dim: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), dim, 3)
    full = np.zeros((len(rows), dim, 4), np.uint8)
    full[:, :, 1:] = raw
    return (full.view("<i4").reshape(len(rows), dim) >> 8).astype(np.float64) / (2**23 - 1)


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _mix(path: np.ndarray, code: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (path.astype(np.uint64) ^ (code.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(32))


class _Split(NamedTuple):
    """Keys of one depth that are split further (sorted), and the mean of the unit vectors in each where their differences are hashed."""

    keys: np.ndarray
    means: np.ndarray | None


def _keys(unit: np.ndarray, fine: int, probes: tuple[int, ...], hot: list[_Split]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket key, depth) of all entries; ``probes``: how many buckets of each table; hot[d]: what is split at depth d."""
    rows, keys, depth = [], [], []
    for t, wanted in enumerate(probes):
        code = buckets(unit, t, fine, wanted)
        row = np.repeat(np.arange(len(unit)), code.shape[1])
        key, d = _mix(np.full(len(row), t, np.uint64), code.ravel()), 0
        while True:
            split = np.isin(key, hot[d].keys) if d < len(hot) else np.zeros(len(key), bool)
            rows.append(row[~split]), keys.append(key[~split]), depth.append(np.full(int((~split).sum()), d, np.int32))
            if not split.any():
                break
            row, key = row[split], key[split]
            x, means = unit[row], hot[d].means
            if means is not None:
                x = x - means[np.searchsorted(hot[d].keys, key)]
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
            d, m = d + 1, 2 if means is None else 4
            deeper, _ = axes(x, t, d + 1, _size(unit.shape[1]), m)
            key, row = _mix(np.repeat(key, m), deeper.ravel()), np.repeat(row, m)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(depth)


def _over(vectors: DataFrame, fine: int, probes: tuple[int, ...], hot: list[_Split], hot_rows: int) -> dict[int, int]:
    """Keys at the depth after ``hot`` with more than ``hot_rows`` entries, and their number.

    There are entries / hot_rows of them at most. Should they be more than ``HOT_KEYS``, only larger buckets count as hot.
    """
    d = len(hot)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                _, key, depth = _keys(_unit(pdf["vector"]), fine, probes, hot)
                k, n = np.unique(key[depth == d], return_counts=True)
                yield pd.DataFrame({"key": k.view(np.int64), "n": n})

    counts = vectors.select("vector").mapInPandas(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > hot_rows)
    got, least = at_most(counts, HOT_KEYS), hot_rows
    if got is None:
        counts = cut_lineage(counts)
    while got is None:
        least *= 2
        got = at_most(counts.where(F.col("n") > least), HOT_KEYS)
    return {r["key"]: r["n"] for r in got}


def _means(vectors: DataFrame, fine: int, probes: tuple[int, ...], hot: list[_Split], keys: np.ndarray, dim: int) -> np.ndarray:
    """Mean unit vector of each of ``keys`` (sorted), which stand at the depth after ``hot``."""
    d = len(hot)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((len(keys), dim)), np.zeros(len(keys), np.int64)
        for pdf in batches:
            if len(pdf):
                unit = _unit(pdf["vector"])
                row, key, depth = _keys(unit, fine, probes, hot)
                mine = (depth == d) & np.isin(key, keys)
                at = np.searchsorted(keys, key[mine])
                np.add.at(total, at, unit[row[mine]])
                n += np.bincount(at, minlength=len(keys))
        used = np.flatnonzero(n)
        if len(used):
            yield pd.DataFrame({"at": used, "n": n[used], "total": list(total[used])})

    parts = vectors.select("vector").mapInPandas(add, "at int, n long, total array<double>")
    sums = [F.sum(F.get("total", F.lit(i))) for i in range(dim)]
    out = np.zeros((len(keys), dim))
    for r in parts.groupBy("at").agg(F.sum("n").alias("n"), F.array(*sums).alias("total")).toLocalIterator():  # a row for each hot key, whose number is checked
        out[r["at"]] = np.array(r["total"]) / r["n"]
    return out


def _hot_keys(vectors: DataFrame, fine: int, probes: tuple[int, ...], hot_rows: int, dim: int) -> tuple[list[_Split], dict[int, int]]:
    """What to split at each depth, and the keys left over after the deepest split with their rows."""
    hot: list[_Split] = []
    while True:
        over = _over(vectors, fine, probes, hot, hot_rows)
        if not over or len(hot) == DEEPEST:
            return hot, over
        keys = np.sort(np.array(list(over), np.int64).view(np.uint64))
        hot.append(_Split(keys, None if len(hot) < DIRECT else _means(vectors, fine, probes, hot, keys, dim)))


def _entries(vectors: DataFrame, fine: int, probes: tuple[int, ...], hot: list[_Split], left_over: dict[int, int], hot_rows: int, role: int) -> DataFrame:
    """(key, id, role, v): a row for each bucket that a vector enters; role 0 answers, 1 asks, 2 does both."""
    stuck_keys = np.sort(np.array(list(left_over), np.int64).view(np.uint64))
    blocks = np.array([-(-left_over[int(k)] // hot_rows) for k in stuck_keys.view(np.int64)], np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            unit = _unit(pdf["vector"])
            row, key, _ = _keys(unit, fine, probes, hot)
            stuck = np.isin(key, stuck_keys)
            if stuck.any():  # each block of a key meets each other one in a bucket of their own
                own = pd.util.hash_array(pdf["id"].to_numpy()).astype(np.uint64)
                r, k = row[stuck], key[stuck]
                m = blocks[np.searchsorted(stuck_keys, k)]
                b = np.repeat((own[r] % m.astype(np.uint64)).astype(np.int64), m)
                other = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
                pair = np.minimum(b, other) * np.repeat(m, m) + np.maximum(b, other)
                row, key = np.concatenate([row[~stuck], np.repeat(r, m)]), np.concatenate([key[~stuck], _mix(np.repeat(k, m), pair)])
            packed, ids, key = np.array(pack24(unit), dtype=object), pdf["id"].to_numpy(), key.view(np.int64)
            for i in range(0, len(row), 20_000):
                r = row[i : i + 20_000]
                out = {"key": key[i : i + 20_000], "id": ids[r], "v": packed[r]}
                yield pd.DataFrame(out if role == 2 else out | {"role": np.int8(role)})

    return vectors.mapInPandas(run, "key long, id string, v binary" + (", role byte" if role != 2 else ""))


def _rank_bucket(dim: int, k: int, min_sim: float | None):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["id", "role"] if "role" in pdf else ["id"])
        role, ids = pdf["role"].to_numpy() if "role" in pdf else np.full(len(pdf), 2), pdf["id"].to_numpy()
        by_name = np.empty(len(ids), np.int64)  # ids compare as numbers below
        by_name[np.argsort(ids.astype(str), kind="stable")] = np.arange(len(ids))
        x = unpack24(pdf["v"].tolist(), dim)
        x32 = x.astype(np.float32)
        base, ask = np.flatnonzero(role != 1), np.flatnonzero(role != 0)
        out, step, more = [], max(64, (1 << 24) // max(1, len(base))), k + 3
        xb = x32[base]
        same = pd.Series(np.arange(len(base)), index=ids[base])
        for i in range(0, len(ask), step):
            q = ask[i : i + step]
            s = x32[q] @ xb.T
            own = same.reindex(ids[q]).to_numpy()
            has = ~np.isnan(own)
            s[np.flatnonzero(has), own[has].astype(np.int64)] = -2
            if min_sim is not None:
                hit = s >= min_sim - 1e-5
                many = np.flatnonzero(np.count_nonzero(hit, axis=1) > max(4 * more, len(base) // 16))
                if len(many):  # in a dense cluster only the best of a row are worth an exact cosine
                    kth = -np.partition(-s[many], more - 1, axis=1)[:, more - 1]
                    hit[many] = s[many] >= np.maximum(kth - 1e-6, min_sim - 1e-5)[:, None]
                r, c = np.divmod(np.flatnonzero(hit), len(base))  # of few true places this is faster than nonzero
            elif len(base) > more:
                c = np.argpartition(-s, more - 1, axis=1)[:, :more]
                # ties at the border: keep everything that may be among the best
                edge = np.take_along_axis(s, c, 1).min(axis=1)
                r, c = np.nonzero(s >= edge[:, None] - 1e-6)
            else:
                r, c = np.nonzero(s > -2)
            exact = np.empty(len(r))
            for j in range(0, len(r), 1 << 15):
                a, b = q[r[j : j + (1 << 15)]], base[c[j : j + (1 << 15)]]
                exact[j : j + (1 << 15)] = np.einsum("ij,ij->i", x[a], x[b])
            norm = np.sqrt(np.einsum("ij,ij->i", x[q], x[q]))
            norm_b = np.sqrt(np.einsum("ij,ij->i", x[base], x[base])) if i == 0 else norm_b  # noqa: F821
            sim = np.round(exact / (norm[r] * norm_b[c]), 9)
            keep = sim > -2 if min_sim is None else sim >= min_sim
            r, c, sim = r[keep], c[keep], sim[keep]
            order = np.lexsort((by_name[base[c]], -sim, r))
            r, sim, c = r[order], sim[order], c[order]
            first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else np.zeros(0, np.int64)
            place = np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r))))
            top = place < k
            out.append(pd.DataFrame({"id": ids[q[r[top]]], "neighbor": ids[base[c[top]]], "sim": sim[top]}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "neighbor": [], "sim": []}).astype({"id": str, "neighbor": str, "sim": float})

    return run


def similar_vectors(
    vectors: DataFrame,
    queries: DataFrame | None = None,
    *,
    dim: int = 64,
    k: int = 5,
    min_sim: float | None = None,
    insert_probes: tuple[int, ...] | None = None,
    query_share: float = 0.14,
    bucket_rows: int | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """(id, neighbor, sim, rank): the ``k`` nearest by cosine of every query among ``vectors``, itself left out.

    vectors, queries: (id string, vector array); without ``queries`` all vectors ask. ``min_sim`` keeps
    neighbours of at least that cosine, which saves work. Equal cosines (nine decimals): the smaller id first.
    ``insert_probes``: how many buckets of each table a vector enters. With a ``min_sim`` and no queries a vector asks in
    the buckets that it enters, which finds near neighbours; else it asks in the nearest ``query_share`` of all buckets of each
    table, which finds 95 % of the true neighbours, far ones included, at a cost in proportion to queries times vectors.
    Null ids and unusable vectors (null, wrong length, null, NaN or infinite components, all zero) neither
    ask nor answer; an id counts once however often it is repeated (its vectors are taken to be equal);
    an empty table gives no rows. Other columns are ignored.
    """
    clean = lambda df: df.select(F.col("id").cast("string").alias("id"), "vector").where(F.col("id").isNotNull() & usable(F.col("vector"), dim))
    base, ask = clean(vectors), clean(queries) if queries is not None else None
    heirs = None
    first = k + 1
    copies = base.groupBy(F.xxhash64("vector").alias("_h")).agg(F.approx_count_distinct("id").alias("n")).where(F.col("n") > 4 * first).select("_h")
    if copies.limit(1).count():
        hashed = base.withColumn("_h", F.xxhash64("vector")).join(copies, "_h", "left_semi").select("_h", "id").distinct()
        firsts = hashed.withColumn("_rn", F.row_number().over(Window.partitionBy("_h").orderBy("id"))).where(F.col("_rn") <= first).select("_h", "id", "_rn")
        rest = hashed.join(firsts, ["_h", "id"], "left_anti")
        # k of its copies have smaller ids than the lead, so it is no neighbour of its heirs, nor they of it
        heirs = rest.join(firsts.where(F.col("_rn") == first).select("_h", F.col("id").alias("lead")), "_h").select("lead", "id")
        unhashed, selves = rest.select("id"), heirs.select("lead", F.col("lead").alias("id")).distinct()
        if ask is not None:
            asked = ask.select("id").distinct()
            heirs, selves = heirs.join(asked, "id", "left_semi"), selves.join(asked, "id", "left_semi")
            leads = base.join(heirs.select(F.col("lead").alias("id")), "id", "left_semi")
            ask = ask.join(unhashed, "id", "left_anti").unionByName(leads)
        base = base.join(unhashed, "id", "left_anti")
        heirs = heirs.select("lead", "id").unionByName(selves.select("lead", "id"))
    deep = ask is not None or min_sim is None
    probes = insert_probes or ((1, 1, 1) if deep else (3, 2))
    aim = bucket_rows or (BUCKET_ROWS_ASKED if deep else BUCKET_ROWS)
    hot_rows, n = hot_rows or HOT * aim, vectors.count()
    fine = fine_coordinates(n, dim, max(probes), aim)
    hot, left_over = _hot_keys(base, fine, probes, hot_rows, dim)
    entries = _entries(base, fine, probes, hot, left_over, hot_rows, 0 if deep else 2)
    rows = n * sum(probes)
    if deep:
        asked = max(1, math.ceil(query_share * 2 * _size(dim) * (2 * fine or 1)))
        ask = base if ask is None else ask
        entries = entries.unionByName(_entries(ask, fine, (asked,) * len(probes), hot, left_over, hot_rows, 1))
        rows += ask.count() * asked * len(probes)
    # enough tasks for the entries, with several buckets each, so that they are even
    entries = entries.repartition(max(1, -(-rows // ENTRIES_A_TASK)), "key")
    near = entries.groupBy("key").applyInPandas(_rank_bucket(dim, k, min_sim), "id string, neighbor string, sim double")
    near = near.groupBy("id", "neighbor").agg(F.max("sim").alias("sim"))
    by = Window.partitionBy("id").orderBy(F.desc("sim"), "neighbor")
    ranked = near.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    if heirs is None:
        return ranked
    # a lead may have any number of heirs, so its few rows go to as many parts as they fill
    parts = heirs.groupBy("lead").agg(F.ceil(F.count("*") / HEIRS_A_PART).cast("int").alias("_parts")).withColumnRenamed("lead", "id")
    sent = ranked.join(parts, "id", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    n_parts = parts.withColumnRenamed("id", "lead")
    dealt = heirs.join(n_parts, "lead").select(F.col("lead").alias("_lead"), F.col("id").alias("heir"), F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int").alias("_to"))
    got = sent.join(dealt, (F.col("id") == F.col("_lead")) & (F.col("_part") == F.col("_to")), "left")
    return got.where("_parts IS NULL OR heir IS NOT NULL").select(F.coalesce("heir", "id").alias("id"), "neighbor", "sim", "rank")
