"""Joins of vectors with vectors on a grid of bounded tiles.

Both sides of a group are cut into blocks by hash; block i of the one side meets block j of the other in a tile of its own. A
tile holds a bounded number of rows whatever the sizes of the sides, every pair meets exactly once, and nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.session import cut_lineage

LEFT_BLOCK, RIGHT_BLOCK = 2048, 8192  # rows


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of equal-length lists as a matrix of doubles."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=np.float64).reshape(len(column), -1)


def tile_join(
    left: DataFrame, right: DataFrame, by: list[str], key: str, other: str, meet: Callable[[pa.Table, pa.Table], pa.Table], schema: str,
    left_block: int = LEFT_BLOCK, right_block: int = RIGHT_BLOCK,
) -> DataFrame:
    """``meet(left rows, right rows)`` of every tile of every group ``by``; ``key`` and ``other`` tell the rows of a side apart.

    A left row is sent to as many tiles as its group has right blocks, and the other way round, so choose the blocks as large as a task's memory allows.
    """
    def blocks(df: DataFrame, size: int, name: str) -> DataFrame:
        return df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / size).alias(name))

    grid = cut_lineage(blocks(left, left_block, "_rows").join(blocks(right, right_block, "_columns"), by))

    def dealt(df: DataFrame, name: str, own: str, across: str, row: str, column: str) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(across) - 1))
        return df.join(grid, by).withColumn(row, F.pmod(F.xxhash64(name), F.col(own))).withColumn(column, every).drop("_rows", "_columns")

    a = dealt(left, key, "_rows", "_columns", "_i", "_j")
    b = dealt(right, other, "_columns", "_rows", "_j", "_i")
    b = b.select(*[F.col(c).alias(c) for c in b.columns])  # new columns, as both sides may come from one table
    at = [*by, "_i", "_j"]
    return a.groupBy(*at).cogroup(b.groupBy(*at)).applyInArrow(meet, schema)


def near_pairs(left: DataFrame, right: DataFrame, by: list[str], floor: float) -> DataFrame:
    """Pairs of a group's vectors with dot product ``floor`` or more: ``by``, rid, key, other, other_key, score.

    Both sides: ``by``, rid, key, embedding. A row doesn't meet itself; vectors of different length and empty ones don't meet.
    """
    left, right = (d.filter(F.size("embedding") > 0).withColumn("_size", F.size("embedding")) for d in (left, right))
    right = right.select(*by, "_size", F.col("rid").alias("other"), F.col("key").alias("other_key"), "embedding")
    kinds = {f.name: f.dataType.simpleString() for f in left.schema.fields}
    names = [*by, "rid", "key", "other", "other_key", "score"]
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in by], f"rid {kinds['rid']}", f"key {kinds['key']}", f"other {kinds['rid']}", f"other_key {kinds['key']}", "score double"])

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        found = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
        for at in range(0, len(a) if len(b) else 0, 256):  # a hash may leave a block empty
            score = matrix(a["embedding"].slice(at, 256)) @ matrix(b["embedding"]).T
            i, j = np.nonzero(score >= floor)
            for part, value in zip(found, (i + at, j, score[i, j])):
                part.append(value)
        i, j, score = (np.concatenate(p) for p in found)
        rows, cols = a.take(pa.array(i)), b.take(pa.array(j))
        out = pa.table([*[rows[c] for c in by], rows["rid"], rows["key"], cols["other"], cols["other_key"], pa.array(score)], names=names)
        return out.filter(pc.not_equal(out["rid"], out["other"]))

    one = left.select(*by, "_size", "rid", "key", "embedding")
    return tile_join(one, right, [*by, "_size"], "rid", "other", meet, schema)
