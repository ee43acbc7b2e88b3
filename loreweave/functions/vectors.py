"""Dense vectors: the default hashed-token embedder and vector expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.functions.text import let, run_lengths, tokens

Embedder = Callable[[Column], Column]


def hashed_embedding(dim: int = 64) -> Embedder:
    """Model-free embedder: hashed token counts, L2-normalised.

    Slot of a token = first 8 hex digits of its MD5 modulo ``dim``. Tokens are sorted by slot and run
    lengths taken, so a text costs one sort rather than one pass per slot.
    """

    def embed(text: Column) -> Column:
        slots = F.array_sort(
            F.transform(
                tokens(text),
                lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % dim).cast("int"),
            )
        )

        def counts(runs: Column) -> Column:
            by_slot = F.map_from_entries(runs)
            return F.transform(
                F.sequence(F.lit(0), F.lit(dim - 1)),
                lambda k: F.coalesce(F.try_element_at(by_slot, k), F.lit(0)).cast("double"),
            )

        return normalize(let(run_lengths(slots), counts))

    return embed


def normalize(v: Column) -> Column:
    def scale(x: Column) -> Column:
        norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda acc, e: acc + e * e))
        return let(norm, lambda n: F.transform(x, lambda e: F.when(n > 0, e / n).otherwise(F.lit(0.0))))

    return let(v, scale)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, e: acc + e,
    )


def embed(df: DataFrame, text_col: str, embedder: Embedder | None = None, out: str = "dense") -> DataFrame:
    """Add a vector column. ``embedder`` maps a text column to a vector column: an expression, or an
    iterator pandas UDF that loads its model once per worker."""
    return df.withColumn(out, (embedder or hashed_embedding())(F.col(text_col)))
