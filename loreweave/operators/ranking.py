"""Bounded per-key selection and neighbour access that survive hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    *,
    rank: str = "rank",
    salt_on: Sequence[str] = (),
    salts: int = 64,
) -> DataFrame:
    """First ``k`` rows of every key in ``order`` (a total order), ranked from 1.

    With ``salt_on`` a key's rows are first cut to ``k`` inside hashed slices, so a key holding a third
    of the table is ranked by ``salts`` tasks and the last window sees at most ``k * salts`` rows.
    """
    if salt_on:
        part = F.pmod(F.xxhash64(*salt_on), F.lit(salts))
        inner = Window.partitionBy(*keys, "_slice").orderBy(*order)
        df = (
            df.withColumn("_slice", part)
            .withColumn("_n", F.row_number().over(inner))
            .filter(F.col("_n") <= k)
            .drop("_n", "_slice")
        )
    outer = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(outer)).filter(F.col(rank) <= k)


def neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    columns: dict[str, str],
    *,
    block: int,
    following: bool = True,
) -> DataFrame:
    """Add columns of the next (or previous) row of the same key in ``order``.

    ``order`` is an integer column, unique within a key. Rows are cut into blocks of ``block``
    consecutive values; ``lead``/``lag`` runs inside a block, and only one edge row per block is matched
    across blocks. A hot key therefore never has to be sorted by a single task.
    """
    step = F.lead if following else F.lag
    names = list(columns)
    payload = F.struct(*[F.col(columns[n]).alias(n) for n in names])
    cut = df.withColumn("_block", F.floor(F.col(order) / block))
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    near = cut.withColumn("_near", step(payload).over(inside))
    pick = F.min_by if following else F.max_by
    edges = cut.groupBy(*keys, "_block").agg(pick(payload, F.col(order)).alias("_edge"))
    across = edges.withColumn("_far", step("_edge").over(Window.partitionBy(*keys).orderBy("_block")))
    joined = near.join(across.drop("_edge"), [*keys, "_block"], "left")
    best = F.coalesce("_near", "_far")
    return joined.select(*df.columns, *[best[n].alias(n) for n in names])


def carry_forward(df: DataFrame, keys: Sequence[str], order: str, column: str, *, block: int) -> DataFrame:
    """Fill ``column`` with its last non-null value up to each row of the key, block by block like
    :func:`neighbour`."""
    cut = df.withColumn("_block", F.floor(F.col(order) / block))
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    near = cut.withColumn("_near", F.last(column, ignorenulls=True).over(inside))
    edges = cut.groupBy(*keys, "_block").agg(F.max_by(column, F.when(F.col(column).isNotNull(), F.col(order))).alias("_edge"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    across = edges.withColumn("_far", F.last("_edge", ignorenulls=True).over(before)).drop("_edge")
    joined = near.join(across, [*keys, "_block"], "left")
    return joined.withColumn(column, F.coalesce("_near", "_far")).select(*df.columns)


def join_text(parts: Column, order: Sequence[Column], sep: str) -> Column:
    """Aggregate: non-null parts joined in ``order``."""
    items = F.array_sort(F.collect_list(F.when(parts.isNotNull(), F.struct(*order, parts.alias("_part")))))
    return F.array_join(F.transform(items, lambda x: x["_part"]), sep)
