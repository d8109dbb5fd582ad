"""Inverted index and BM25 over DataFrames. Every search takes a frame of queries (qid, text)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from weftline.functions.text import code_tokens
from weftline.operators.blocks import in_blocks
from weftline.session import written

K1, B = 1.5, 0.75
BLOCK_QUERIES, BLOCK_TEXTS = 100_000, 80_000
#: Places of the rows that a cell keeps for its most common words.
COMMON_CELLS = 1 << 25


def postings(docs: DataFrame) -> DataFrame:
    """(term, id, tf) of docs (id, text). Null and empty texts have no postings; ids must be unique."""
    return docs.select("id", F.explode(code_tokens(F.col("text"))).alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))


def doc_stats(docs: DataFrame) -> DataFrame:
    """(id, dl): words of each document, 0 for a null text."""
    return docs.select("id", F.coalesce(F.size(code_tokens(F.coalesce("text", F.lit("")))), F.lit(0)).alias("dl"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, term, n): a term counts as often as the query repeats it."""
    return queries.select("qid", F.explode(code_tokens(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("n"))


def counted_terms(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, dl), (term, id, tf, dl)) of docs (id, text)."""
    words = docs.select("id", F.coalesce(code_tokens(F.col("text")), F.array().cast("array<string>")).alias("_w"))
    # the length comes before the explode, so that neither text nor array is carried along with each word
    each = words.select("id", F.size("_w").alias("dl"), "_w").select("id", "dl", F.explode("_w").alias("term"))
    return words.select("id", F.size("_w").alias("dl")), each.groupBy("term", "id", "dl").agg(F.count("*").alias("tf")).select("term", "id", "tf", "dl")


def score_postings(terms: DataFrame, tf: DataFrame, n: int, avgdl: float | None) -> DataFrame:
    """(qid, id, score) of query terms (qid, term, n) over postings (term, id, tf, dl) of ``n`` documents; scores are rounded to six places."""
    avgdl = max(avgdl or 0.0, 1.0)
    df = tf.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    weighted = terms.join(df, "term").withColumn("idf", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0) * F.col("n"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / avgdl))
    return tf.join(weighted.select("qid", "term", "idf"), "term").groupBy("qid", "id").agg(F.round(F.sum(part), 6).alias("score"))


def bm25_scores(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, id, score) of all documents with a term of the query; scores are rounded to six places.

    For texts that no index holds: only the terms of the queries are exploded and shuffled. An empty corpus,
    or queries without terms, give no rows. See ``sources.index`` for texts that are searched more than once.
    """
    terms = query_terms(queries)
    stats = doc_stats(docs).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    counted = docs.select("id", code_tokens(F.col("text")).alias("_w")).select("id", F.size("_w").alias("dl"), "_w")
    hits = counted.select("id", "dl", F.explode("_w").alias("term")).join(terms.select("term").distinct(), "term", "left_semi")
    tf = hits.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    return score_postings(terms, tf, stats["n"], stats["avgdl"])


def top_k(hits: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The best ``k`` of each query with their rank; equal scores go by id."""
    by = Window.partitionBy("qid").orderBy(F.desc(score), "id")
    return hits.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def once_per_text(queries: DataFrame, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``search`` of queries (qid, text), done once for each distinct text; its hits (qid, ...) go to every query of the text."""
    asked = written(queries.where("text IS NOT NULL").select("qid", "text"))
    hits = search(asked.select(F.col("text").alias("qid"), "text").distinct())
    return hits.withColumnRenamed("qid", "text").join(asked, "text").select("qid", *[c for c in hits.columns if c != "qid"])


def counted_words(docs: DataFrame, *kept: str) -> DataFrame:
    """(id, dl, words, and the columns ``kept``) of docs (id, text): the number of code words, and the words with spaces between."""
    split = docs.select("id", F.coalesce(code_tokens(F.col("text")), F.array().cast("array<string>")).alias("_w"), *kept)
    return split.select("id", F.size("_w").alias("dl"), F.array_join("_w", " ").alias("words"), *kept)


def bm25_top(queries: DataFrame, docs: DataFrame, k: int, then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(qid, id, score, rank): the best ``k`` docs (id, text) of each query, for many queries at once; rows as those of ``top_k`` over ``bm25_scores``.

    Blocks of queries meet blocks of docs. A cell adds up the scores of a query as short floats over rows of its common words and the
    postings of the others; docs that may be among the best ``k`` of the cell, with the error added, are scored exactly.
    ``then``, if any, is done with the hits of each distinct text: (qid, id, score, rank, held), where qid is the text and held the number of its words in the doc.
    Docs that have the columns of ``counted_words`` already are read as they are.
    """
    split = docs.select("id", "dl", "words") if "words" in docs.columns else written(counted_words(docs))
    stats = split.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    n, avgdl = stats["n"], max(stats["avgdl"] or 0.0, 1.0)
    df = split.select(F.explode(F.array_distinct(F.split("words", " "))).alias("term")).where("term <> ''").groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0) * F.col("n")

    def search(asked: DataFrame) -> DataFrame:
        terms = query_terms(asked).join(df, "term").select("qid", "term", idf.alias("idf"))
        weights = terms.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("term", "idf"))).alias("_t")).select("qid", F.col("_t.term").alias("terms"), F.col("_t.idf").alias("idfs"))
        hits = in_blocks(written(weights), split, _best_of_cell(k, avgdl), "qid string, id string, score double, held int", query_rows=BLOCK_QUERIES, rows_a_block=BLOCK_TEXTS)
        best = top_k((hits if then else hits.drop("held")).withColumn("score", F.round("score", 6)), k)
        return then(best) if then else best

    return once_per_text(queries, search)


def _best_of_cell(k: int, avgdl: float) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def meet(q_rows: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", ignore_index=True)
        vocabulary = sorted({t for terms in q_rows["terms"] for t in terms})
        number = {t: i for i, t in enumerate(vocabulary)}
        starts, at, tf = _cell_postings(rows, vocabulary)
        ids, norm, many = rows["id"].to_numpy(), K1 * (1 - B + B * rows["dl"].to_numpy(np.float64) / avgdl), len(rows)
        # ``deep`` docs share a place in the maxima, of which there are several times k
        deep = max(1, min(64, many // (8 * k)))
        wide = -(-many // deep) * deep
        postings = [slice(a, b) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        impact = lambda own, docs: tf[own] * (K1 + 1) / (tf[own] + norm[docs])
        count = np.diff(starts)
        common = [t for t in np.argsort(-count, kind="stable")[: COMMON_CELLS // max(wide, 1)].tolist() if count[t] * 64 > many]
        rows_of = dict(zip(common, np.zeros((len(common), wide), np.float32), strict=True))
        for t, row in rows_of.items():
            row[at[postings[t]]] = impact(postings[t], at[postings[t]])
        short = {t: impact(p, at[p]).astype(np.float32) for t, p in enumerate(postings) if t not in rows_of}
        sums, part = np.zeros(wide, np.float32), np.zeros(wide, np.float32)
        piles = sums.reshape(deep, -1)
        qids, hits, scores, shares = [], [], [], []
        for qid, terms, idfs in zip(q_rows["qid"], q_rows["terms"], q_rows["idfs"], strict=True):
            mine = [(t, w) for t, w in zip(map(number.__getitem__, terms), idfs, strict=True) if count[t]]
            if not mine:
                continue
            first = mine[0][0] in rows_of
            if first:
                np.multiply(rows_of[mine[0][0]], np.float32(mine[0][1]), out=sums)
            else:
                sums.fill(0)
            for t, w in mine[first:]:
                if t in rows_of:
                    sums += np.multiply(rows_of[t], np.float32(w), out=part)
                else:
                    sums[at[postings[t]]] += short[t] * np.float32(w)
            # k docs of different places reach this sum; what may be rounded to the same score stays
            most = piles.max(axis=0)
            least = np.partition(most, len(most) - k)[len(most) - k] if len(most) >= k else 0.0
            least = np.float32(max(float(least) * (1 - (len(mine) + 4) * 5e-7) - 3e-6, 1e-30))
            some = np.flatnonzero(most >= least)
            deeper, place = np.nonzero(piles[:, some] >= least)
            near = np.sort(deeper * piles.shape[1] + some[place]).astype(np.int32)
            score, held = np.zeros(len(near)), np.zeros(len(near), np.int32)
            for t, w in mine:
                own = at[postings[t]]
                place = np.minimum(np.searchsorted(own, near), len(own) - 1)
                has = own[place] == near
                score += np.where(has, w * impact(postings[t].start + place, near), 0.0)
                held += has
            # places are in the order of the ids, which decides ties of rounded scores
            best = np.argsort(-np.round(score, 6), kind="stable")[:k]
            qids.append(qid)
            hits.append(near[best])
            scores.append(score[best])
            shares.append(held[best])
        if not qids:
            return pd.DataFrame({"qid": [], "id": [], "score": [], "held": []}).astype({"qid": str, "id": str, "score": float, "held": "int32"})
        rows_of.clear()
        short.clear()
        return pd.DataFrame({"qid": np.repeat(np.array(qids, object), [len(h) for h in hits]), "id": ids[np.concatenate(hits)], "score": np.concatenate(scores), "held": np.concatenate(shares)})

    return meet


def _cell_postings(rows: pd.DataFrame, vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of each word's postings, and of each posting the place of its row (id, dl, words) and the count of the word in it."""
    known, width, parts = pa.array(vocabulary, pa.string()), len(rows), []
    for i in range(0, width, 4096):
        split = pc.split_pattern(pa.array(rows["words"].iloc[i : i + 4096], pa.string()), " ")
        term = pc.fill_null(pc.index_in(split.flatten(), known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(i, i + len(split)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
        both, tf = np.unique(term[term >= 0] * width + row[term >= 0], return_counts=True)
        parts.append((*(x.astype(np.int32) for x in np.divmod(both, width)), tf.astype(np.int32)))
    term, at, tf = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else np.zeros((3, 0), np.int32)
    # the rows of a word stay in order, as the parts are
    order = np.argsort(term, kind="stable")
    return np.searchsorted(term[order], np.arange(len(vocabulary) + 1)), at[order], tf[order]
