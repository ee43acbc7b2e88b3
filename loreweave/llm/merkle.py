"""Merkle manifest of a table: a hash tree per group and one over the groups, with the siblings that prove a row.

A row's leaf is the hash of its fields. The leaves of a group stand in order; every ``fanout`` consecutive nodes become their
parent, level by level, until one node is left, the group's subroot; the subroots become the root in the same way.
Each level is one slot pivot: conditional aggregates spread a parent's children into ``fanout`` columns. Concatenating the columns
gives the parent's hash, leaving one's own column out gives the siblings. Ranks come from a range partitioning and the row counts of
its pieces, so no group has to fit a task; a level is an eighth of the one below, and proofs are put together from the top down, a
row for each parent and not for each leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.llm.common import store

FANOUT = 8


def _hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("", *parts), 256)


def _coded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _ranked(nodes: DataFrame, *order: str) -> DataFrame:
    """``nodes`` with their place ``pos`` in ``key`` by ``order`` and the number ``n`` of nodes of the key.

    Rows are stored in order over range partitions; a place is the rank within the piece plus the counts of earlier pieces.
    """
    rows = nodes.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    rows, _ = store(rows.withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_piece", F.shiftrightunsigned("_at", 33))
    counts = rows.groupBy("key", "_piece").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    whole = Window.partitionBy("key")
    before = F.sum("_rows").over(whole.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(
        "key", "_piece", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias("n")
    )
    return rows.join(starts, ["key", "_piece"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_piece", "_shift")


def _levels(nodes: DataFrame, fanout: int) -> list[DataFrame]:
    """Stored pivots from the lowest level up: key, pos and hash ``h`` of each parent, its level's size ``n``, and its children ``s0``, ``s1``, …"""
    payload = F.struct(*[F.col(c) for c in nodes.columns if c not in ("key", "pos", "n")])
    size, out = nodes.agg(F.max("n")).first()[0] or 0, []
    while size > 1:
        slot = F.col("pos") % fanout
        pivot = nodes.filter("n > 1").groupBy("key", F.floor(F.col("pos") / fanout).alias("pos")).agg(
            F.ceil(F.max("n") / fanout).alias("n"), *[F.max(F.when(slot == j, payload)).alias(f"s{j}") for j in range(fanout)]
        )
        pivot, _ = store(pivot.withColumn("h", _hash(*[F.col(f"s{j}.h") for j in range(fanout)])))
        out.append(pivot)
        nodes, payload = pivot.select("key", "pos", "n", "h"), F.struct("h")
        size = -(-size // fanout)
    return out


def _children(pivot: DataFrame, above: DataFrame, fanout: int) -> DataFrame:
    """Every child of the pivot with its path: the siblings before and after it, then the path of its parent in ``above``."""
    others = lambda js: F.concat_ws("", *[F.col(f"s{j}.h") for j in js])
    kids = [
        F.struct(
            (F.col("pos") * fanout + j).alias("pos"), F.col(f"s{j}").alias("node"),
            F.concat(F.array(F.struct(others(range(j)).alias("before"), others(range(j + 1, fanout)).alias("after"))), F.col("path")).alias("path"),
        )
        for j in range(fanout)
    ]
    kids = F.filter(F.array(*kids), lambda k: k["node"].isNotNull())
    rest = [c for c in above.columns if c not in ("key", "pos", "path")]
    return pivot.drop("n", "h").join(above, ["key", "pos"]).select("key", *rest, F.explode(kids).alias("_kid")).select("key", *rest, "_kid.*")


def _proved(nodes: DataFrame, pivots: list[DataFrame], top: DataFrame, fanout: int) -> DataFrame:
    """``nodes`` (as column ``node``) with their paths; ``top`` has the path from each key's last node on, and the columns to hand down.

    Trees of different heights end at different levels, so each level takes over the roots that stand there.
    """
    payload = F.struct(*[F.col(c) for c in nodes.columns if c not in ("key", "pos", "n")]).alias("node")
    levels = [nodes.select("key", "pos", "n", payload), *[p.select("key", "pos", "n", F.struct("h").alias("node")) for p in pivots]]
    rest = [c for c in top.columns if c not in ("key", "path")]
    below = None
    for k in reversed(range(len(levels))):
        here = levels[k].filter("n = 1").join(top, "key").select("key", *rest, "pos", "node", "path")
        if below is not None:
            here = here.unionByName(_children(pivots[k], below.select("key", *rest, "pos", "path"), fanout))
        below = here
    return below


def manifest(
    docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), *, group_col: str = "lang", order_col: str = "doc_id",
    altered: dict[str, Column] | None = None, fanout: int = FANOUT,
) -> DataFrame:
    """One row per row of ``docs``: order_col, leaf, altered_leaf, subroot, root, and ``path`` for :func:`fold`.

    ``path`` lists, from the row's level to the root, the joined hashes of the siblings ``before`` and ``after`` it; a node without siblings
    has an empty entry. ``altered_leaf`` is the leaf with the columns of ``altered`` in place of fields, and null where no field differs.

    Groups stand in the order of their values as text, null first, rows of a group by order_col (nulls first) and then by leaf; equal
    rows are leaves of their own. Nulls of any field are coded as ``-``, empty texts as ``0:``; texts of any length are hashed whole. One
    group alone is its own root. An empty table gives no rows. Other columns are ignored whatever their names.
    """
    altered = altered or {}
    leaf = _hash(*[_coded(F.col(c)) for c in fields])
    other = _hash(*[_coded(altered.get(c, F.col(c))) for c in fields])
    changed = F.lit(False)
    for c, value in altered.items():
        changed = changed | ~value.eqNullSafe(F.col(c))
    group = F.col(group_col).cast("string")
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), group), F.lit("-")).alias("key"), F.col(order_col).alias("id"), leaf.alias("h"), F.when(changed, other).alias("other")
    ).withColumn("row", F.monotonically_increasing_id())  # splits many equal rows over range partitions
    leaves, _ = store(leaves)
    nodes = _ranked(leaves, "id", "h", "row").drop("row")
    nodes, _ = store(nodes)
    pivots = _levels(nodes, fanout)

    ends = [d.filter("n = 1").select("key", "h") for d in (nodes, *pivots)]
    subroots = ends[0]
    for d in ends[1:]:
        subroots = subroots.unionByName(d)
    tops = _ranked(subroots.select(F.lit("").alias("key"), F.col("key").alias("group"), "h"), "group")
    tops, _ = store(tops)
    over = _levels(tops, fanout)
    root = tops.filter("n = 1").select("key", F.col("h").alias("root"))
    for p in over:
        root = root.unionByName(p.filter("n = 1").select("key", F.col("h").alias("root")))
    none = F.array().cast("array<struct<before:string,after:string>>")
    to_root = _proved(tops, over, root.withColumn("path", none), fanout)
    to_root = to_root.select(F.col("node.group").alias("key"), F.col("node.h").alias("subroot"), "root", "path")
    done = _proved(nodes, pivots, to_root, fanout)
    return done.select(
        F.col("node.id").alias(order_col), F.col("node.h").alias("leaf"), F.col("node.other").alias("altered_leaf"), "subroot", "root", "path"
    )


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda h, s: _hash(s["before"], h, s["after"]))


def siblings(path: Column) -> Column:
    """All siblings of a path, from the leaf up and left to right, as one text."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")
