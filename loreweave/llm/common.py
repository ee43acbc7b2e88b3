"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from loreweave.session import shared_folder


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A given table of one data folder."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def store(df: DataFrame) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back; also its path, for ``drop``.

    Later plans start from files every executor can read, so a lost executor costs one task, not the lineage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete stored tables that no later plan reads."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        with contextlib.suppress(Exception):  # a leftover table is no reason to fail a finished job
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64), elementwise on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(batches: Iterable[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Consecutive rows with equal ``keys`` of a sorted stream, one table at a time across batch borders."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        edge = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            edge[1:] |= c[1:] != c[:-1]
        if last is not None and last != tuple(c[0] for c in columns):
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(edge).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if held and a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def by_bytes(batch: pa.RecordBatch, *columns: str, budget: int = 1 << 21, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``rows`` rows and, unless one row alone has more, ``budget`` bytes in ``columns`` (text or lists of numbers).

    What an operator builds for a slice is then bounded, however many rows Spark sends at once.
    """
    weight = np.zeros(batch.num_rows, dtype=np.int64)
    for name in columns:
        column = batch.column(name)
        if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
            size = pc.multiply(pc.list_value_length(column), 8)
        else:
            size = pc.binary_length(column)
        weight += pc.fill_null(size, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(weight)
    a = 0
    while a < batch.num_rows:
        b = int(np.searchsorted(total, (total[a - 1] if a else 0) + budget, side="right"))
        b = min(max(b, a + 1), a + rows, batch.num_rows)
        yield batch.slice(a, b - a)
        a = b
