"""Exact nearest neighbours of a set of query vectors among all vectors, in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from weftline.operators.blocks import in_blocks
from weftline.operators.lexical import top_k
from weftline.session import written

BLOCK_QUERIES, BLOCK_VECTORS = 40_000, 140_000
#: Products that a task makes at once, and scores that it looks through at once.
BLOCK_PRODUCTS, BLOCK_SCORES = 1 << 24, 1 << 22


def nearest(queries: DataFrame, vectors: DataFrame, k: int, *, metric: str = "l2") -> DataFrame:
    """(qid, id, score, rank): the ``k`` nearest of each query (qid, vector) among vectors (id, vector).

    ``l2``: squared distance d, score 1/(1+d); ``cosine``: the cosine. Scores are rounded to six places,
    ties go by id. Blocks of queries meet blocks of vectors; each cell keeps the best of each query, so few rows are sent on.
    A cell finds those that may be among its best by products of short floats with their error added, and scores them exactly.
    """

    def meet(q_rows: pd.DataFrame, x_rows: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"qid": [], "id": [], "score": []}).astype({"qid": str, "id": str, "score": float})
        if not len(q_rows) or not len(x_rows):
            return empty
        x_rows = x_rows.sort_values("id", ignore_index=True)
        # vectors of short floats stay as they are
        q, x = np.stack(q_rows["vector"].to_numpy()).astype(np.float64), np.stack(x_rows["vector"].to_numpy())
        qids, ids, out = q_rows["qid"].to_numpy(), x_rows["id"].to_numpy(), [empty]
        n, m = len(ids), min(k, len(ids))
        qq, xx = (np.concatenate([(y.astype(np.float64) ** 2).sum(axis=1) for y in np.array_split(side, -(-len(side) // 4096))]) for side in (q, x))
        # near vectors have a large product: q*x - x*x/2 for distances, that of unit vectors for cosines
        left, less = (q, xx / 2) if metric == "l2" else (q / np.sqrt(qq)[:, None], np.zeros(n))
        size, widest = (np.sqrt(qq), np.sqrt(xx.max())) if metric == "l2" else (np.ones(len(q)), 1.0)
        kind = np.float32 if max(size.max(), widest) < 1e15 else np.float64
        off = 2 * (q.shape[1] + 4) * np.finfo(kind).eps * (size * widest + less.max())
        # ``deep`` vectors share a place in the maxima, of which there are several times m
        deep = max(1, min(64, n // (8 * m)))
        wide = -(-n // deep)
        a, b = np.hstack([left, -np.ones((len(q), 1))]).astype(kind), np.zeros((q.shape[1] + 1, deep * wide), kind)
        b[-1] = np.inf
        b[-1, :n] = less
        for i in range(0, n, 4096):
            b[:-1, i : min(i + 4096, n)] = (x[i : i + 4096] if metric == "l2" else x[i : i + 4096] / np.sqrt(xx[i : i + 4096])[:, None]).T
        step = max(1, BLOCK_SCORES // (deep * wide))
        many = max(1, BLOCK_PRODUCTS // (deep * wide) // step) * step
        products = np.empty((min(many, len(q)), deep * wide), kind)
        for i in range(0, len(q), step):
            # many queries at once, as few would leave most of a product's time to the reading of b
            if i % many == 0:
                np.matmul(a[i : i + many], b, out=products[: len(q) - i])
            near = products[i % many :][: min(step, len(q) - i)].reshape(-1, deep, wide)
            most = near.max(axis=1)
            # m vectors of different places reach this product; what may be rounded to the same score stays
            least = np.partition(most, wide - m, axis=1)[:, wide - m].astype(np.float64) - off[i : i + step]
            if metric == "l2":
                edge = 1.0 / (1.0 + np.maximum(qq[i : i + step] - 2 * least, 0)) - 2e-6
                least = np.where(edge > 0, (qq[i : i + step] + 1 - 1 / np.where(edge > 0, edge, 1)) / 2, -np.inf)
            else:
                least = least - 2e-6
            least = np.nextafter((least - off[i : i + step]).astype(kind), kind(-np.inf))
            r, place = np.nonzero(most >= least[:, None])
            some, layer = np.nonzero(near[r, :, place] >= least[r, None])
            r, c = r[some], layer * wide + place[some]
            # places after the last vector are reached only where all are
            r, c = r[c < n], c[c < n]
            score = np.empty(len(r))
            for j in range(0, len(r), 1 << 16):
                u, v = q[i + r[j : j + (1 << 16)]], c[j : j + (1 << 16)]
                if metric == "l2":
                    score[j : j + len(v)] = 1.0 / (1.0 + ((u - x[v]) ** 2).sum(axis=1))
                else:
                    score[j : j + len(v)] = (u * x[v]).sum(axis=1) / np.sqrt(qq[i + r[j : j + len(v)]]) / np.sqrt(xx[v])
            # rows are in the order of the ids, which decides ties of rounded scores
            order = np.lexsort((c, -np.round(score, 6), r))
            first = order[np.arange(len(r)) - np.searchsorted(r, r) < m]
            out.append(pd.DataFrame({"qid": qids[i + r[first]], "id": ids[c[first]], "score": score[first]}))
        del products, near, most, a, b
        return pd.concat(out)

    hits = in_blocks(written(queries.select("qid", "vector")), written(vectors.select("id", "vector")), meet, "qid string, id string, score double", query_rows=BLOCK_QUERIES, rows_a_block=BLOCK_VECTORS)
    return top_k(hits.withColumn("score", F.round("score", 6)), k)
