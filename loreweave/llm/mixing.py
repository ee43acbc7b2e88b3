"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-size blocks.

A source's target is its share of the mix, stopped at a multiple of its own size. The whole mix is cut into blocks of
equal words (smaller ones where a source is small), and the blocks go to the sources with the highest quotients target / (2k + 1). A source's documents are
dealt by a seeded hash to shards of bounded size; a shard's integer quota is its own Sainte-Laguë rounding at its source's
divisor. In a shard the documents stand on a ring in seeded order, and its quota takes whole rounds and then the blocks
that follow a seeded start. Source totals are the only thing gathered, one row a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.llm.common import store

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 32  # words
SEATS = 8  # of the smallest source at least, by smaller blocks
SHARD = 65_536  # words of a shard, about
WEIGHTS = (5, 2, 1)


def words(text: str | Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def positions(df: DataFrame, order: Column) -> DataFrame:
    """``df`` with ``_at``, the place of each row in ``order`` from 0: range partitions, ranked apart, then shifted.

    The partitions are written first, as a later run might draw other borders.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts, _ = store(df.repartitionByRange(n, order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    shift = parts.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return parts.withColumn("_own", own).join(shift, "_part").withColumn("_at", F.col("_own") + F.col("_shift")).drop("_part", "_own", "_shift")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> tuple[DataFrame, float]:
    """``sources`` (_source, _words) with ``_target``, and the sum of the targets.

    A source over ``most`` times its size stops there and what it leaves is shared again by weight. The level
    (target per weight) only rises, so each pass over the source rows stops at least one more source or is the last.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_at") % len(weights) + 1).cast("int"))
    placed, _ = store(positions(sources, F.col("_source").asc_nulls_last()).withColumn("_weight", weight))
    cap = F.col("_words") * most
    total = share * (placed.agg(F.sum("_words")).first()[0] or 0)
    level = 0.0
    while total:
        full = cap <= F.lit(level) * F.col("_weight")
        done, left = placed.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("_weight")))).first()
        if left is None:
            break
        new = (total - (done or 0.0)) / left
        if new <= level:
            break
        level = new
    return placed.withColumn("_target", F.least(cap, F.lit(level) * F.col("_weight"))), total


def seats(parties: DataFrame, size: str, house: int, order: Column) -> DataFrame:
    """``parties`` with ``_seats``: the ``house`` highest quotients size / (2k + 1), equal ones by ``order``.

    The price at which ``house`` quotients are reached is searched with 64 trial prices a pass, only their counts
    come back; the seats between the last two prices go by rank.
    """
    v = F.col(size)

    def won(price: float) -> Column:
        return F.floor(v / F.lit(2.0 * price) + 0.5).cast("long")

    total = parties.agg(F.sum(v)).first()[0] or 0.0
    if not total or not house:
        return parties.withColumn("_seats", F.lit(0).cast("long"))
    low, high = total / (2.0 * house) / 4, total / (2.0 * house) * 4  # low price: house or more; high price: fewer
    n = parties.count()
    while parties.agg(F.sum(won(low))).first()[0] < house:
        low /= 4
    while parties.agg(F.sum(won(high))).first()[0] >= house:
        high *= 4
    left = house
    for _ in range(12):
        step = (high - low) / 65
        prices = [low + step * i for i in range(1, 65)]
        counts = parties.agg(*[F.sum(won(p)).alias(f"c{i}") for i, p in enumerate(prices)]).first()
        enough = [p for p, c in zip(prices, counts) if c >= house]
        fewer = [(p, c) for p, c in zip(prices, counts) if c < house]
        low = max(enough, default=low)
        high, left = (fewer[0][0], house - fewer[0][1]) if fewer else (high, left)
        if step <= 0 or left <= min(n, 1):
            break
    base = parties.withColumn("_seats", won(high))
    left = house - base.agg(F.sum("_seats")).first()[0]
    next_quotient = v / (2.0 * F.col("_seats") + 1.0)
    ranked = positions(base.withColumn("_next", F.struct((-next_quotient).alias("q"), order.alias("o"))), F.col("_next").asc())
    return ranked.withColumn("_seats", F.col("_seats") + F.when(F.col("_at") < left, 1).otherwise(0)).drop("_at", "_next")


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = (),
    weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = BLOCK, shard: int = SHARD, seed: int = 42,
) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target (the source's), taken, pieces, and the columns ``keep``.

    Sources by code point, a null source last, get ``weights`` in turn. ``pieces`` lists the word ranges (first, after the
    last) that the mix takes of a document, so taken is the sum of their lengths; it is at most ``most`` times the size.
    Null and empty texts have size 0 and nothing taken. Repeated rows count each; equal places in the seeded order go to
    rows that are equal in id and size. The same rows and seed give the same result. An empty table gives an empty mix.
    """
    spark = docs.sparkSession
    columns = [F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), words(text_col).alias("_size")]
    slim, _ = store(docs.select(*columns))
    totals, _ = store(slim.groupBy("_source").agg(F.sum("_size").alias("_words")))
    sources, total = targets(totals, weights, share, most)
    least = sources.filter("_target > 0").agg(F.min("_target")).first()[0]
    block = max(1, min(block, int((least or 0) // SEATS)))  # so that the smallest source has some seats to choose from
    quotas, _ = store(
        seats(sources.drop("_at"), "_target", round(total / block), F.col("_source")).select(
            F.col("_source").alias("_of"), "_words", "_target", "_seats"
        )
    )
    rows = docs.select(*columns, *[F.col(c).alias(f"_keep_{c}") for c in keep]) if keep else slim
    dealt = rows.join(quotas, F.col("_source").eqNullSafe(F.col("_of"))).drop("_of")
    shards = F.greatest(F.lit(1), F.ceil(F.col("_words") / shard))
    key = F.xxhash64(F.lit(seed), F.col("_id"))
    dealt = dealt.withColumn("_key", key).withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("_id")), shards))
    ring = Window.partitionBy("_source", "_shard")
    placed = dealt.withColumn("_all", F.sum("_size").over(ring)).withColumn(
        "_after", F.sum("_size").over(ring.orderBy("_key", "_id", "_size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    size, whole = F.col("_size"), F.col("_all")
    quota = F.floor(F.col("_seats") * (whole / F.greatest(F.lit(1), F.col("_words"))) + 0.5) * block
    spend = F.least(quota, F.floor(whole * F.lit(most))).cast("long")
    start = F.pmod(F.xxhash64(F.lit(seed + 2), F.col("_source"), F.col("_shard")), F.greatest(F.lit(1), F.ceil(whole / block))) * block
    placed = placed.select(
        "*", F.when(whole > 0, F.floor(spend / F.greatest(F.lit(1), whole))).otherwise(0).cast("long").alias("_rounds"), (F.col("_after") - size).alias("_first"),
        F.least(start, whole).cast("long").alias("_start"), spend.alias("_spend"),
    )
    rest = F.col("_spend") - F.col("_rounds") * whole

    def part(begin: Column) -> Column:
        """Words of the document in the stretch of ``rest`` words from ``begin``."""
        a, b = F.greatest(F.lit(0), begin - F.col("_first")), F.least(size, begin + rest - F.col("_first"))
        return F.struct(a.cast("int").alias("first"), F.greatest(a, b).cast("int").alias("after"))

    rounds = F.transform(
        F.when(F.col("_rounds") > 0, F.sequence(F.lit(1), F.col("_rounds").cast("int"))).otherwise(F.array().cast("array<int>")),
        lambda _: F.struct(F.lit(0).alias("first"), size.cast("int").alias("after")),
    )
    pieces = F.filter(F.concat(rounds, F.array(part(F.col("_start") - whole), part(F.col("_start")))), lambda p: p["after"] > p["first"])
    taken = F.aggregate(pieces, F.lit(0).cast("long"), lambda t, p: t + (p["after"] - p["first"]))
    return placed.withColumn("pieces", pieces).select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_words").alias("source_size"), F.col("_target").alias("target"),
        taken.alias("taken"), "pieces", *[F.col(f"_keep_{c}").alias(c) for c in keep if c != id_col],
    )


def cut(text: Column, first: Column, after: Column) -> Column:
    """Words ``first`` to ``after`` of a text, with the white space before each word but the first."""
    found = F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    return F.ltrim(F.array_join(F.slice(found, first + 1, after - first), ""))
