"""Inverted index of chunks, and exact lexical top-k by pruning with block maxima.

Postings of a term lie in blocks of about ``block`` chunks of alike weight, each with its greatest weight, so a term that every chunk holds is
many blocks and no group. A question first scores the chunks of its rarest terms; its k-th best score so far is a bar. Terms whose
greatest weights together stay under the bar, the commonest first, can't bring in a chunk by themselves and their postings aren't read;
of the others, a block is read only if its greatest weight with all that the other terms could add reaches the bar. What is read is
scored in full from the chunk's own row. Questions are rows throughout; work follows the postings read, not questions times chunks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loreweave.session import cut_lineage

BLOCK = 128  # chunks of a block, about
STEPS = 16  # levels of weight per unit of weight
PROBE = 4  # times k chunks are scored for the first bar, about
SCORE_DIGITS = 6
_SLACK = 10.0**-SCORE_DIGITS
_ROWS = 1024  # pairs scored at a time


@dataclass
class Inverted:
    """``terms``: user_id, term, df, top. ``blocks``: user_id, term, lead, block_top, chunks. ``rows``: user_id, chunk_id, document_id, hashes, weights."""

    terms: DataFrame
    blocks: DataFrame
    rows: DataFrame


def build_inverted(index: DataFrame, block: int = BLOCK, asked: DataFrame | None = None) -> Inverted:
    """Stored postings of index rows (``user_id, document_id, chunk_id, sparse``); weights have to be positive.

    ``asked`` (``user_id, sparse`` of questions): an index for these questions alone keeps the postings of their terms only.
    """
    rows = cut_lineage(index.select(
        "user_id", "chunk_id", "document_id", F.transform("sparse", lambda s: F.xxhash64(s["term"])).alias("hashes"), F.col("sparse.weight").alias("weights")
    ))
    level = F.floor(F.col("weight") * STEPS).cast("int")
    postings = index.select("user_id", "chunk_id", F.inline("sparse")).withColumn("level", level)
    if asked is not None:
        wanted = cut_lineage(asked.select("user_id", F.explode("sparse.term").alias("term")).distinct())  # its size is known then
        postings = postings.join(wanted, ["user_id", "term"], "left_semi")
    counts = postings.groupBy("user_id", "term", "level").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("top"))
    counts = cut_lineage(counts)
    terms = cut_lineage(counts.groupBy("user_id", "term").agg(F.sum("n").alias("df"), F.max("top").alias("top")))
    parts = counts.select("user_id", "term", "level", F.ceil(F.col("n") / block).alias("parts"))
    placed = postings.join(parts, ["user_id", "term", "level"]).withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.col("parts")))
    blocks = placed.groupBy("user_id", "term", "level", "part").agg(F.max("weight").alias("block_top"), F.collect_list("chunk_id").alias("chunks"))
    return Inverted(terms, cut_lineage(blocks.select("user_id", "term", (F.col("part") == 0).alias("lead"), "block_top", "chunks")), rows)


def _mixed(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    x = h.view(np.uint64) ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


def _full_scores(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Dot products of a chunk's and a question's term weights."""
    for whole in batches:
        for at in range(0, whole.num_rows, _ROWS):
            part = whole.slice(at, _ROWS)
            n = np.arange(part.num_rows)
            flat = {}
            for name in ("hashes", "weights", "asked", "asked_weights"):
                flat[name] = part.column(name).flatten().to_numpy(zero_copy_only=False)
            own = np.repeat(n, pc.list_value_length(part.column("hashes")).fill_null(0).to_numpy(zero_copy_only=False))
            theirs = np.repeat(n, pc.list_value_length(part.column("asked")).fill_null(0).to_numpy(zero_copy_only=False))
            wanted = _mixed(theirs, flat["asked"].astype(np.int64))
            order = np.argsort(wanted)
            wanted, weight = wanted[order], flat["asked_weights"][order]
            have = _mixed(own, flat["hashes"].astype(np.int64))
            place = np.minimum(np.searchsorted(wanted, have), max(len(wanted) - 1, 0))
            hit = wanted[place] == have if len(wanted) else np.zeros(len(have), bool)
            score = np.bincount(own[hit], weights=flat["weights"][hit] * weight[place[hit]], minlength=len(n))
            yield pa.RecordBatch.from_arrays(
                [part.column("query_id"), part.column("chunk_id"), pa.array(np.round(score, SCORE_DIGITS))], names=["query_id", "chunk_id", "score"]
            )


def lexical_top_k(queries: DataFrame, inverted: Inverted, limit: str) -> DataFrame:
    """Best chunks of each question by shared term weights: ``query_id, chunk_id, score, limit``, exact, at most ``limit`` a question and cut in ranks.

    ``queries``: ``query_id, user_id, sparse, document_ids`` and the column ``limit`` of rows wanted. Chunks without a common term are no candidates.
    """
    mine = queries.filter((F.size("sparse") > 0) & (F.col(limit) > 0))
    asked = cut_lineage(mine.select(
        "query_id", "user_id", "document_ids", F.col(limit).alias("k"), F.transform("sparse", lambda s: F.xxhash64(s["term"])).alias("asked"),
        F.col("sparse.weight").alias("asked_weights"), "sparse",
    ))
    terms = asked.select("query_id", "user_id", "k", F.inline("sparse")).join(inverted.terms, ["user_id", "term"])
    terms = terms.withColumn("reach", F.col("weight") * F.col("top")).withColumn("total", F.sum("reach").over(Window.partitionBy("query_id")))
    terms = cut_lineage(terms)
    own = Window.partitionBy("query_id")
    before = F.coalesce(F.sum("df").over(own.orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rare = terms.withColumn("_before", before).filter(F.col("_before") < PROBE * F.col("k")).select("query_id", "user_id", "term")

    def chunks(blocks: DataFrame) -> DataFrame:
        return blocks.select("query_id", "user_id", F.explode("chunks").alias("chunk_id")).distinct()

    def scored(pairs: DataFrame) -> DataFrame:
        full = pairs.join(inverted.rows, ["user_id", "chunk_id"]).join(asked.select("query_id", "document_ids", "asked", "asked_weights"), "query_id")
        allowed = F.col("document_ids").isNull() | (F.size("document_ids") == 0) | F.array_contains("document_ids", F.col("document_id"))
        full = full.filter(allowed).select("query_id", "chunk_id", "hashes", "weights", "asked", "asked_weights")
        kinds = {f.name: f.dataType.simpleString() for f in full.schema.fields}
        return full.mapInArrow(_full_scores, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double")

    first = chunks(rare.join(inverted.blocks.filter("lead"), ["user_id", "term"]))
    start = cut_lineage(scored(first))
    limits = asked.select("query_id", "k")
    place = F.row_number().over(own.orderBy(F.desc("score"), "chunk_id"))
    bar = start.join(limits, "query_id").withColumn("_at", place).filter(F.col("_at") == F.col("k")).select("query_id", (F.col("score") - _SLACK).alias("bar"))
    barred = terms.join(bar, "query_id", "left").withColumn("bar", F.coalesce("bar", F.lit(0.0)))
    so_far = F.sum("reach").over(own.orderBy(F.desc("df"), "term").rowsBetween(Window.unboundedPreceding, 0))
    needed = barred.withColumn("_sum", so_far).filter(F.col("_sum") >= F.col("bar"))
    read = needed.join(inverted.blocks, ["user_id", "term"]).filter(F.col("weight") * F.col("block_top") + F.col("total") - F.col("reach") >= F.col("bar"))
    # Stored, so that what either was made by doesn't lie on disk until the last step.
    rest = cut_lineage(chunks(read).join(start.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti"))
    hits = start.unionByName(cut_lineage(scored(rest))).filter(F.col("score") > 0).join(limits, "query_id")
    return hits.withColumn("_at", place).filter(F.col("_at") <= F.col("k")).select("query_id", "chunk_id", "score", F.col("k").alias("limit"))
