"""Near-duplicate embeddings by hashing to the E8 lattice.

Each of several tables projects a unit vector to eight dimensions and decodes it to the nearest point of the E8 lattice, its cell.
A vector stands in its own cell and asks in the neighbouring cells nearest to it as well. Vectors of a cell are compared there by
cosine, in blocks of bounded size. A pair can meet in several tables; it counts where it meets first, which both vectors
tell alone, so no list of pairs is made: a block yields counts per vector and a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.llm.common import mix64, runs, store
from loreweave.operators.components import components
from loreweave.llm.minhash_dedup import Forest
from loreweave.llm.vectors import cosine, matrix, pack, unit, usable

TABLES, PROBES, SCALE = 8, 8, 1.0  # a pair at cosine 0.95 meets in a table with probability 0.67, in none with 0.0002
BLOCK = 512
HOME, ASKS, BOTH = 0, 1, 2


@lru_cache(maxsize=1)
def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for s, t in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of even sum: round, and where the sum is odd move the worst coordinate."""
    near = np.round(x)
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    off = x[odd] - near[odd]
    worst = np.abs(off).argmax(axis=1)
    near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return near


def nearest(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points: the better of D8 and D8 shifted by one half."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    better = np.einsum("ij,ij->i", x - a, x - a) <= np.einsum("ij,ij->i", x - b, x - b)
    return np.where(better[:, None], a, b)


@lru_cache(maxsize=8)
def _projection(dim: int, tables: int, scale: float, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).normal(size=(tables * 8, dim)) * scale


def _name(points: np.ndarray, table: np.ndarray, dim: int) -> np.ndarray:
    """Number of a cell in its table."""
    h = mix64(table.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(dim))
    for k in range(8):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + np.round(points[..., k] * 2).astype(np.int64).view(np.uint64))
    return h.view(np.int64)


def cells(x: np.ndarray, tables: int, probes: int, scale: float, seed: int) -> np.ndarray:
    """Cells of unit vectors, by (vector, table): the own one and then the ``probes`` nearest neighbours.

    Sums run in the same order for every vector, whatever others stand beside it, so every task finds the same cells.
    """
    n, dim = x.shape
    y = np.einsum("ij,kj->ik", x, _projection(dim, tables, scale, seed)).reshape(n * tables, 8)
    own = nearest(y)
    table = np.tile(np.arange(tables), n)
    toward = np.einsum("ij,kj->ik", y - own, shortest())
    order = np.argsort(-toward, axis=1, kind="stable")[:, :probes]
    out = np.empty((n * tables, probes + 1), np.int64)
    out[:, 0] = _name(own, table, dim)
    for p in range(probes):
        out[:, p + 1] = _name(own + shortest()[order[:, p]], table, dim)
    return out.reshape(n, tables, probes + 1)


def _entries(batches: Iterable[pa.RecordBatch], how: tuple, with_vectors: bool) -> Iterator[pa.RecordBatch]:
    """A row for each cell in which a vector stands or asks."""
    tables, probes = how[0], how[1]
    per = tables * (probes + 1)
    role = np.tile(np.where(np.arange(probes + 1) == 0, BOTH, ASKS), tables).astype(np.int32)
    for whole in batches:
        dims = whole.column("dim").to_numpy()
        for dim in np.unique(dims):
            part = whole.filter(pa.array(dims == dim))
            for at in range(0, part.num_rows, 256):
                batch = part.slice(at, 256)
                n = batch.num_rows
                x = unit(matrix(batch.column("vec"), batch.column("width")[0].as_py()))
                columns = {"cell": pa.array(cells(x, *how).reshape(-1)), "role": pa.array(np.tile(role, n))}
                if with_vectors:
                    rows = pa.array(np.repeat(np.arange(n), per))
                    columns |= {"place": pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), probes + 1), n))}
                    columns |= {c: batch.column(c).take(rows) for c in ("id", "copies", "width", "vec")}
                yield pa.RecordBatch.from_pydict(columns)


def _earlier(ca: np.ndarray, cb: np.ndarray) -> np.ndarray:
    """By (pair, table): whether the first vector asks where the second stands."""
    return (ca == cb[:, :, :1]).any(axis=2)


def _meet(batches: Iterable[pa.RecordBatch], how: tuple, least: float) -> Iterator[pa.RecordBatch]:
    """Per block: (id, links, root); links counts the copies of vectors that the vector is linked to here first."""
    for group in runs(batches, "cell", "block"):
        role = group.column("role").to_numpy()
        homes, asks = np.flatnonzero(role != ASKS), np.flatnonzero(role != HOME)
        if not len(homes) or not len(asks) or group.num_rows < 2:
            continue
        ids, copies = group.column("id").to_numpy(), group.column("copies").to_numpy()
        raw = matrix(group.column("vec"), group.column("width")[0].as_py())
        x = unit(raw)
        a, h = np.nonzero(x[asks] @ x[homes].T >= least - 1e-9)
        a, h = asks[a], homes[h]
        other = ids[a] != ids[h]
        a, h = a[other], h[other]
        if not len(a):
            continue
        links = np.zeros(group.num_rows, np.int64)
        forest = Forest(range(group.num_rows))
        used, place = np.unique(np.concatenate([a, h]), return_inverse=True)
        c = cells(x[used], *how)
        table = int(group.column("place")[0].as_py())
        for i in range(0, len(a), 4096):
            p, q = a[i : i + 4096], h[i : i + 4096]
            cp, cq = c[place[i : i + len(p)]], c[place[len(a) + i : len(a) + i + len(p)]]
            forth, back = _earlier(cp, cq), _earlier(cq, cp)
            before = (forth[:, :table] | back[:, :table]).any(axis=1) | (back[:, table] & (ids[p] > ids[q]))
            fresh = np.flatnonzero(~before)
            fresh = fresh[cosine(raw[p[fresh]], raw[q[fresh]]) >= least]
            np.add.at(links, p[fresh], copies[q[fresh]])
            np.add.at(links, q[fresh], copies[p[fresh]])
            for u, v in zip(p[fresh].tolist(), q[fresh].tolist()):
                forest.join(u, v)
        hit = np.flatnonzero(links)
        if len(hit):
            roots = np.array([ids[forest.root(i)] for i in hit.tolist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(links[hit]), pa.array(roots)], names=["id", "links", "root"])


def find(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95,
    tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, block: int = BLOCK, seed: int = 11,
) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id (smallest id reachable by links), kept (id = component_id).

    Two vectors are linked if their cosine, in double precision, is ``least`` or more and they meet in a table. Vectors
    of equal components always meet. Vectors that are null, empty, zero or hold null or non-finite components, and those of another
    length, link with nothing. A null id has no links and null component and kept. Rows that repeat an id are copies or
    vectors of their own. An empty table gives an empty result; other columns are ignored.
    """
    how = (tables, probes, scale, seed)
    spark = vectors.sparkSession
    packed, _ = store(pack(vectors, id_col, vector_col).withColumn("h1", F.xxhash64("vec", "dim")).withColumn("h2", F.xxhash64(F.lit(1), "vec")))
    classes, _ = store(packed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    on = (F.col("id") == F.col("rep")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    one, _ = store(
        packed.join(classes.select("rep", "copies", F.col("h1").alias("_h1"), F.col("h2").alias("_h2")), on)
        .dropDuplicates(["id", "h1", "h2"]).select("id", "copies", "dim", "width", "vec")
    )
    sizes = one.mapInArrow(lambda it: _entries(it, how, False), "cell long, role int").groupBy("cell").agg(
        F.sum(F.when(F.col("role") == BOTH, 1).otherwise(0)).alias("h"), F.count(F.lit(1)).alias("q")
    )
    hot, _ = store(sizes.filter((F.col("h") > 0) & (F.col("q") > block)).select(
        F.col("cell").alias("_cell"), F.ceil(F.col("h") / block).alias("nh"), F.ceil(F.col("q") / block).alias("nq")
    ))
    rows = one.mapInArrow(lambda it: _entries(it, how, True), "cell long, role int, place int, id long, copies long, width int, vec binary")
    placed = rows.join(hot, F.col("cell") == F.col("_cell"), "left")
    every = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    spot = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), n)
    pair = lambda i, j, r: F.struct((i * F.col("nq") + j).cast("long").alias("block"), F.lit(r).alias("role"))
    asks = F.transform(every(F.col("nh")), lambda i: pair(i, spot(F.col("nq"), 2), ASKS))
    homes = F.transform(every(F.col("nq")), lambda j: pair(spot(F.col("nh"), 1), j, HOME))
    cool = F.array(F.struct(F.lit(0).cast("long").alias("block"), F.col("role").alias("role")))
    spread = F.when(F.col("nh").isNull(), cool).when(F.col("role") == BOTH, F.concat(asks, homes)).otherwise(asks)
    rows = placed.withColumn("_to", F.explode(spread)).select("cell", "_to.block", "_to.role", "place", "id", "copies", "width", "vec")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = rows.repartition(n, "cell", "block").sortWithinPartitions("cell", "block").mapInArrow(
        lambda it: _meet(it, how, least), "id long, links long, root long"
    )
    met, _ = store(met)
    linked = components(met.select(F.col("id").alias("a"), F.col("root").alias("b"))).select(F.col("id").alias("_node"), "component")
    counted = met.groupBy(F.col("id").alias("_of")).agg(F.sum("links").alias("links"))
    answer, _ = store(
        classes.join(counted, F.col("rep") == F.col("_of"), "left").join(linked, F.col("rep") == F.col("_node"), "left")
        .select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                F.coalesce("component", "rep").alias("_component"))
    )
    prints = packed.select("id", "h1", "h2").join(answer, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))).select("id", "n_links", "_component")
    ids = vectors.select(F.col(id_col).cast("long").alias("id"), usable(vector_col).alias("_in"))
    apart = ids.filter(~F.col("_in") | F.col("id").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("_component"))
    return prints.unionByName(apart).select(
        F.col("id").alias(id_col), "n_links", F.col("_component").alias("component_id"), (F.col("id") == F.col("_component")).alias("kept")
    )

