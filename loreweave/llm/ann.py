"""Approximate nearest neighbours by low-dimensional stable projections under kd-trees.

Unit vectors are projected to a few dimensions by Gaussian sums. The squared projected distance of two vectors is their squared
distance times a chi-square variable, so once the next projected neighbour is farther than the chi-square quantile times the
k-th distance found, a vector as near as that is missed with probability 1 - ``sure`` at most, and the search stops.

The upper levels of the kd-tree are fitted on a bounded sample and cut the projected space into cells; every row is indexed. A
cell is one shard or, by hash, several of bounded size, and each shard has its own lower levels. A query first searches
the shards of its own cell, and with the distance found there those of every other cell that the same test cannot rule out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loreweave.llm.common import runs, store
from loreweave.llm.vectors import cosine, matrix, pack, unit

DIMS, SURE = 10, 0.975
SAMPLE, CELLS, SHARD, LEAF, ASKERS = 20_000, 4096, 8192, 64, 4096


def chi_square(dims: int, p: float) -> float:
    """Quantile of the chi-square distribution (Wilson and Hilferty)."""
    s = 2.0 / (9.0 * dims)
    return dims * (1.0 - s + NormalDist().inv_cdf(p) * s**0.5) ** 3


@lru_cache(maxsize=8)
def _projection(dim: int, dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).normal(size=(dims, dim))


def project(x: np.ndarray, dims: int, seed: int) -> np.ndarray:
    return np.einsum("ij,kj->ik", x, _projection(x.shape[1], dims, seed))


@dataclass
class Cells:
    """Leaves of a kd-tree as boxes."""

    low: np.ndarray
    high: np.ndarray

    def gap(self, y: np.ndarray) -> np.ndarray:
        """Squared distance of a point to each box."""
        off = np.maximum(0.0, np.maximum(self.low - y, y - self.high))
        return np.einsum("ij,ij->i", off, off)


def split(y: np.ndarray, leaf: int, most: int | None = None) -> tuple[list[np.ndarray], Cells]:
    """Places of the points of each leaf, and the leaves' boxes, which tile the space: cuts at the median of the widest
    dimension while a leaf has more than ``leaf`` points (equal points stay together) and there are fewer than ``most``."""
    dims = y.shape[1]
    todo = [(np.arange(len(y)), np.full(dims, -np.inf), np.full(dims, np.inf))]
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while todo:
        rows, low, high = todo.pop(0)
        p = y[rows]
        spread = p.max(axis=0) - p.min(axis=0) if len(rows) else np.zeros(dims)
        d = int(spread.argmax())
        if len(rows) <= leaf or not spread[d] or (most and len(todo) + len(done) + 2 > most):
            done.append((rows, low, high))
            continue
        cut = float(np.median(p[:, d]))
        if cut <= p[:, d].min():
            cut = float(p[p[:, d] > cut, d].min())
        left = p[:, d] < cut
        up, down = high.copy(), low.copy()
        up[d] = down[d] = cut
        todo += [(rows[left], low, up), (rows[~left], down, high)]
    return [r for r, _, _ in done], Cells(np.array([a for _, a, _ in done]), np.array([b for _, _, b in done]))


def _route(batches: Iterable[pa.RecordBatch], trees: dict[int, Cells], dims: int, seed: int, far: float | None) -> Iterator[pa.RecordBatch]:
    """The cell of each row; with ``far``, every other cell that holds points near enough for the row's bound."""
    for whole in batches:
        all_dims = whole.column("dim").to_numpy()
        for dim in np.unique(all_dims):
            batch = whole.filter(pa.array(all_dims == dim))
            tree = trees.get(int(dim)) or Cells(np.full((1, dims), -np.inf), np.full((1, dims), np.inf))
            y = project(unit(matrix(batch.column("vec"), batch.column("width")[0].as_py())), dims, seed)
            rows, cells = [], []
            bound = batch.column("bound").to_numpy(zero_copy_only=False)
            for i, p in enumerate(y):
                own = int(((p >= tree.low) & (p < tree.high)).all(axis=1).argmax())
                found = [own]
                if far is not None:
                    limit = far * max(0.0, 2.0 - 2.0 * bound[i]) + 1e-9 if bound[i] >= -1.5 else np.inf
                    found = [c for c in np.flatnonzero(tree.gap(p) <= limit).tolist() if c != own]
                rows += [i] * len(found)
                cells += found
            yield batch.take(pa.array(rows, pa.int64())).append_column("cell", pa.array(cells, pa.int32()))


def _search(batches: Iterable[pa.RecordBatch], k: int, dims: int, seed: int, far: float) -> Iterator[pa.RecordBatch]:
    """The nearest of each shard for each query, walking the leaves by their projected distance."""
    for group in runs(batches, "dim", "cell", "shard", "askers"):
        asks = group.column("asks").to_numpy()
        held, queries = np.flatnonzero(~asks), np.flatnonzero(asks)
        if not len(held) or not len(queries):
            continue
        ids, bounds = group.column("id").to_numpy(), group.column("bound").to_numpy(zero_copy_only=False)
        raw = matrix(group.column("vec"), group.column("width")[0].as_py())
        x = unit(raw)
        y = project(x, dims, seed)
        leaves, cells = split(y[held], LEAF)
        out: list[tuple[int, int, float]] = []
        for q in queries:
            gap = cells.gap(y[q])
            order = np.argsort(gap, kind="stable")
            best_ids, best = np.empty(0, np.int64), np.empty(0)
            least = bounds[q]
            at, step = 0, 2
            while at < len(order):
                limit = far * max(0.0, 2.0 - 2.0 * least) + 1e-9 if least >= -1.5 else np.inf
                near = order[at : at + step]
                near = near[gap[near] <= limit]
                if not len(near):
                    break
                rows = held[np.concatenate([leaves[i] for i in near])]
                off = y[rows] - y[q]
                rows = rows[(np.einsum("ij,ij->i", off, off) <= limit) & (ids[rows] != ids[q])]
                rows = rows[x[rows] @ x[q] >= least - 1e-9]
                score = cosine(raw[rows], np.broadcast_to(raw[q], (len(rows), raw.shape[1]))) if len(rows) else np.empty(0)
                best_ids, best = np.concatenate([best_ids, ids[rows]]), np.concatenate([best, score])
                top = np.lexsort((best_ids, -best))[:k]
                best_ids, best = best_ids[top], best[top]
                if len(best) == k:
                    least = max(least, best[-1])
                at += step
                step *= 2
            out += zip([int(ids[q])] * len(best), best_ids.tolist(), best.tolist())
        if out:
            a, b, c = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], names=["query", "id", "score"])


def fit(packed: DataFrame, dims: int, seed: int, sample: int, shard: int) -> dict[int, Cells]:
    """Upper levels of the tree for each vector length, from the ``sample`` rows of lowest hash; at most ``CELLS`` cells a tree."""
    rows = packed.orderBy(F.xxhash64("id"), "id").select("vec", "dim", "width").limit(sample).toArrow()
    want = -(-packed.count() // shard)
    trees = {}
    for dim in np.unique(rows.column("dim").to_numpy()):
        part = rows.filter(pa.array(rows.column("dim").to_numpy() == dim))
        y = project(unit(matrix(part.column("vec"), part.column("width")[0].as_py())), dims, seed)
        trees[int(dim)] = split(y, 1, min(CELLS, max(1, want)))[1]
    return trees


def search(
    vectors: DataFrame, queries: str, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    dims: int = DIMS, sure: float = SURE, sample: int = SAMPLE, shard: int = SHARD, seed: int = 5,
) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest found of every row for which the SQL condition ``queries`` holds.

    Candidates are all rows of the same vector length but those with the query's own id; nearness is the cosine in double
    precision, ties go to the smaller id. Vectors that are null, empty, zero or hold null or non-finite components, and rows
    with a null id, take no part. Rows that repeat an id are candidates each and one query. Fewer candidates than ``k`` are all
    returned. An empty table gives an empty result; other columns serve only the condition.
    """
    far = chi_square(dims, sure)
    spark = vectors.sparkSession
    asking, _ = store(pack(vectors.filter(queries), id_col, vector_col).dropDuplicates(["id"]).withColumn("bound", F.lit(-2.0)))
    packed, _ = store(pack(vectors, id_col, vector_col).withColumn("bound", F.lit(-2.0)))
    trees = fit(packed, dims, seed, sample, shard)
    kind = "id long, vec binary, dim int, width int, bound double, cell int"

    def routed(rows: DataFrame, far_: float | None) -> DataFrame:
        return rows.select("id", "vec", "dim", "width", "bound").mapInArrow(lambda it: _route(it, trees, dims, seed, far_), kind)

    index, _ = store(routed(packed, None))
    shards, _ = store(index.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / shard).alias("shards")))
    sizes = shards.select(F.col("dim").alias("_d"), F.col("cell").alias("_c"), "shards")
    here = (F.col("dim") == F.col("_d")) & (F.col("cell") == F.col("_c"))
    parts = max(1, -(-asking.count() // ASKERS))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), count - 1))
    held = index.join(sizes, here).withColumn("shard", F.pmod(F.xxhash64("id", F.lit(3)), F.col("shards")))
    held = held.withColumn("askers", every(F.lit(parts).cast("long"))).withColumn("asks", F.lit(False))
    columns = ["dim", "cell", "shard", "askers", "asks", "id", "vec", "width", "bound"]

    def found(questions: DataFrame) -> DataFrame:
        q = questions.join(sizes, here).withColumn("shard", every(F.col("shards"))).withColumn("asks", F.lit(True))
        q = q.withColumn("askers", F.pmod(F.xxhash64("id", F.lit(4)), F.lit(parts)).cast("long"))
        rows = held.select(*columns).unionByName(q.select(*columns)).repartition(n, "dim", "cell", "shard", "askers")
        rows = rows.sortWithinPartitions("dim", "cell", "shard", "askers", "asks", "id")
        return store(rows.mapInArrow(lambda it: _search(it, k, dims, seed, far), "query long, id long, score double"))[0]

    def best(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    first = best(found(routed(asking, None)))
    bound = first.filter(F.col("rank") == k).select(F.col("query").alias("_q"), F.col("score").alias("_kth"))
    again = asking.join(bound, F.col("id") == F.col("_q"), "left").withColumn("bound", F.coalesce("_kth", "bound"))
    second = found(routed(again, far))
    return best(first.drop("rank").unionByName(second)).select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
