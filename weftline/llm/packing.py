"""Pack texts into fixed-capacity containers with a grouping genetic algorithm.

Items are dealt to cells by a hash of their id, so that a cell's work has a fixed
size however many items there are. Each cell evolves on several islands (separate
Spark groups with their own seed and population); after every epoch each island's
elite migrates to the next island of the cell. The crossover injects whole
well-filled containers of one parent into the other, dissolves the containers that
now hold an item twice, and puts the displaced items back by best fit.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from weftline.llm.tokens import DEFAULT_VOCABULARY, token_count
from weftline.session import cut_lineage

CAPACITY = 2048
CELL_ITEMS = 1000
ISLANDS = 2
EPOCHS = 4
POPULATION = 4
OFFSPRING = 150

_STATE = "cell long, island int, ids array<long>, piece array<int>, sizes array<int>, pop array<array<int>>, fit array<double>"


def best_fit(order, sizes, assign, loads: list[int], capacity: int) -> None:
    """Put the items of ``order`` into the fullest container that still takes them; open new ones at need."""
    room = sorted((capacity - load, b) for b, load in enumerate(loads) if 0 <= load < capacity)
    for i in order:
        s = int(sizes[i])
        at = bisect_left(room, (s, -1))
        if at < len(room):
            r, b = room.pop(at)
            loads[b] += s
        else:
            b, r = len(loads), capacity
            loads.append(s)
        assign[i] = b
        if r - s > 0:
            insort(room, (r - s, b))


def fitness(assign: np.ndarray, sizes: np.ndarray, capacity: int) -> float:
    """Mean squared fill of the containers in use; higher is better."""
    loads = np.bincount(assign, weights=sizes)
    loads = loads[np.bincount(assign) > 0]
    return float(np.mean((loads / capacity) ** 2)) if len(loads) else 1.0


def crossover(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, capacity: int, rng) -> np.ndarray:
    """A child of ``a`` with whole well-filled containers of ``b``."""
    n_b = int(b.max()) + 1
    load_b = np.bincount(b, weights=sizes, minlength=n_b)
    weight = (load_b / capacity) ** 8 + 1e-12
    take = rng.choice(n_b, size=max(1, n_b // 4), replace=False, p=weight / weight.sum())
    injected = np.isin(b, take)
    broken = np.unique(a[injected])
    displaced = np.isin(a, broken) & ~injected
    child = a.copy()
    n_a = int(a.max()) + 1
    _, new = np.unique(b[injected], return_inverse=True)
    child[injected] = n_a + new
    loads = np.bincount(child[~displaced], weights=sizes[~displaced], minlength=n_a).astype(np.int64)
    loads[broken] = -1  # dissolved; their items are displaced or injected
    at = np.flatnonzero(displaced)
    out_loads = loads.tolist()
    best_fit(at[np.argsort(-sizes[at], kind="stable")], sizes, child, out_loads, capacity)
    return np.unique(child, return_inverse=True)[1].astype(np.int32)


def mutate(a: np.ndarray, sizes: np.ndarray, capacity: int, rng) -> np.ndarray:
    """Dissolve the emptiest containers and a few others, and put their items back."""
    loads = np.bincount(a, weights=sizes)
    n = len(loads)
    gone = np.unique(np.concatenate([np.argsort(loads, kind="stable")[: max(1, n // 50)], rng.integers(0, n, max(1, n // 20))]))
    moved = np.flatnonzero(np.isin(a, gone))
    child, left = a.copy(), loads.astype(np.int64)
    left[gone] = -1
    out_loads = left.tolist()
    best_fit(rng.permutation(moved), sizes, child, out_loads, capacity)
    return np.unique(child, return_inverse=True)[1].astype(np.int32)


def _start(sizes: np.ndarray, capacity: int, rng, population: int = POPULATION) -> list[np.ndarray]:
    pop = []
    for k in range(population):
        noise = 1.0 if k == 0 else rng.uniform(0.8, 1.2, len(sizes))
        assign, loads = np.zeros(len(sizes), np.int32), []
        best_fit(np.argsort(-sizes * noise, kind="stable"), sizes, assign, loads, capacity)
        pop.append(assign)
    return pop


def _evolve(capacity: int, seed: int, epoch: int, population: int, offspring: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cell, island = int(pdf["cell"].iloc[0]), int(pdf["island"].iloc[0])
        rng = np.random.default_rng([seed, cell, island, epoch])
        if epoch == 0:
            pdf = pdf.sort_values(["doc_id", "piece_no"], kind="stable")
            ids, piece, sizes = (pdf[c].to_numpy() for c in ("doc_id", "piece_no", "tokens"))
            sizes = sizes.astype(np.int32)
            pop = _start(sizes, capacity, rng, population)
        else:
            own = pdf.loc[~pdf["elite"]].iloc[0]
            ids, piece, sizes = own["ids"], own["piece"], np.asarray(own["sizes"], np.int32)
            pop = [np.asarray(x, np.int32) for x in own["pop"]]
            for elites in pdf.loc[pdf["elite"], "pop"]:
                pop += [np.asarray(x, np.int32) for x in elites]
        scored = sorted(((fitness(x, sizes, capacity), k) for k, x in enumerate(pop)), reverse=True)
        fits, pop = [s for s, _ in scored][:population], [pop[k] for _, k in scored][:population]
        fewest = max(1, -(-int(sizes.sum()) // capacity))
        for _ in range(offspring):
            if len(np.unique(pop[0])) <= fewest:
                break  # no packing has fewer containers
            i, j = rng.integers(0, len(pop), 2)
            child = mutate(pop[i], sizes, capacity, rng) if i == j else crossover(pop[i], pop[j], sizes, capacity, rng)
            f = fitness(child, sizes, capacity)
            if f > fits[-1]:
                at = next(k for k, x in enumerate(fits) if f > x)
                fits.insert(at, f), pop.insert(at, child)
                fits, pop = fits[:population], pop[:population]
        return pd.DataFrame({"cell": [cell], "island": [island], "ids": [ids], "piece": [piece], "sizes": [sizes], "pop": [pop], "fit": [fits]})

    return run


def _elites(island: str):
    return lambda s: s.select(
        "cell", F.expr(island).cast("int").alias("island"),
        F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<int>").alias("piece"), F.lit(None).cast("array<int>").alias("sizes"),
        F.slice("pop", 1, 1).alias("pop"), F.slice("fit", 1, 1).alias("fit"), F.lit(True).alias("elite"),
    )


def pack(
    docs: DataFrame,
    *,
    capacity: int = CAPACITY,
    vocabulary: str = DEFAULT_VOCABULARY,
    seed: int = 11,
    token_col: str | None = None,
    islands: int = ISLANDS,
    epochs: int = EPOCHS,
    population: int = POPULATION,
    offspring: int = OFFSPRING,
) -> DataFrame:
    """A row per piece of a text: (doc_id, piece_no, n_pieces, token_start, tokens, container).

    Only a text that alone exceeds ``capacity`` is cut: into whole containers and one rest, which is
    packed like any other item. Null texts have no row; empty ones have size 0 and take no room.
    Repeated rows of an id are one item (``max`` of the sizes). Other columns are ignored. With
    ``token_col`` the sizes are taken from that column.

    A cell evolves ``epochs`` times ``offspring`` children on each of ``islands`` populations of ``population``
    packings, and stops before that only with as few containers as its tokens can fill at all. Where best fit leaves room
    (sizes of a third to a half of the capacity) the children fill it.
    """
    size = F.col(token_col) if token_col else token_count(F.col("text"), vocabulary)
    n_docs = docs.count()
    cells = max(1, round(n_docs / CELL_ITEMS))
    sized = docs.select("doc_id", size.cast("int").alias("tokens")).where("tokens is not null")
    full = F.greatest(F.ceil(F.col("tokens") / capacity), F.lit(1))
    pieces = sized.groupBy("doc_id").agg(F.max("tokens").alias("tokens")).select(
        "doc_id", full.cast("int").alias("n_pieces"), F.explode(F.sequence(F.lit(0), (full - 1).cast("int"))).alias("piece_no"), F.col("tokens").alias("_all")
    ).withColumn("tokens", F.least(F.lit(capacity), F.col("_all") - F.col("piece_no") * capacity).cast("int"))
    pieces = cut_lineage(pieces.withColumn("cell", F.pmod(F.hash("doc_id", F.lit(seed)), F.lit(cells)).cast("long")))
    items = pieces.where(F.col("tokens") < capacity)
    state = (
        items.select("cell", "doc_id", "piece_no", "tokens", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
        .groupBy("cell", "island").applyInPandas(_evolve(capacity, seed, 0, population, offspring), _STATE)
    )
    for epoch in range(1, epochs):
        state = cut_lineage(state)
        moved = _elites(f"(island + 1) % {islands}")(state)
        state = state.withColumn("elite", F.lit(False)).unionByName(moved).groupBy("cell", "island").applyInPandas(_evolve(capacity, seed, epoch, population, offspring), _STATE)
    best = state.groupBy("cell").agg(F.max_by(F.struct("ids", "piece", F.col("pop")[0].alias("bin")), F.struct(F.col("fit")[0], -F.col("island"))).alias("b"))
    packed = best.select("cell", F.explode(F.arrays_zip("b.ids", "b.piece", "b.bin")).alias("x")).select(
        F.col("x.ids").alias("doc_id"), F.col("x.piece").alias("piece_no"), F.concat_ws("-", F.lit("c"), "cell", F.col("x.bin")).alias("container")
    )
    # a full piece is a container of its own
    return pieces.join(packed, ["doc_id", "piece_no"], "left").select(
        "doc_id", "piece_no", "n_pieces", (F.col("piece_no") * capacity).cast("int").alias("token_start"), "tokens",
        F.coalesce("container", F.concat_ws("-", F.lit("f"), "doc_id", "piece_no")).alias("container"),
    )


def container_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, fill share, and the least number of containers that could hold the tokens."""
    per = packed.groupBy("container").agg(F.sum("tokens").alias("load"), F.count("*").alias("items"))
    return per.agg(
        F.count("*").alias("containers"), F.sum("load").alias("tokens"), F.max("load").alias("fullest"),
        (F.sum("load") / (F.count("*") * capacity)).alias("fill"), F.ceil(F.sum("load") / capacity).alias("lower_bound"), F.sum("items").alias("items"),
    )
