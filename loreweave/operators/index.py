"""Chunk index: dense vectors and lexical weights side by side, one row per chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.functions.text import let, run_lengths, tokens
from loreweave.functions.vectors import Embedder, embed
from loreweave.operators.chunking import with_chunk_id

# Published BM25 defaults; the average length is a parameter because weights are fixed at write time.
BM25_K1 = 1.2
BM25_B = 0.75
BM25_AVG_LEN = 256.0


def passage_weights(text: Column, k1: float = BM25_K1, b: float = BM25_B, avg_len: float = BM25_AVG_LEN) -> Column:
    """``array<struct<term, weight>>`` of a passage: saturated, length-normalised term counts.

    Terms of one passage never leave its row, so encoding costs no shuffle.
    """

    def weigh(v: Column) -> Column:
        length = F.size(v).cast("double")
        pad = k1 * (1.0 - b) + (k1 * b / avg_len) * length
        return F.transform(
            run_lengths(v),
            lambda r: F.struct(r["key"].alias("term"), (r["n"] * (k1 + 1.0) / (r["n"] + pad)).alias("weight")),
        )

    return let(F.array_sort(tokens(text)), weigh)


def query_weights(text: Column) -> Column:
    """``array<struct<term, weight>>`` of a query: every distinct term once, weight 1."""
    return F.transform(F.array_distinct(tokens(text)), lambda t: F.struct(t.alias("term"), F.lit(1.0).alias("weight")))


def postings(chunks: DataFrame, **bm25: float) -> DataFrame:
    """Long form of the passage encoding: ``user_id, document_id, chunk_id, term, weight``."""
    return chunks.select(
        "user_id", "document_id", "chunk_id", F.inline(passage_weights(F.col("text"), **bm25))
    )


def query_terms(queries: DataFrame) -> DataFrame:
    """Long form of the query encoding: ``query_id, user_id, term, weight``."""
    return queries.select("query_id", "user_id", F.inline(query_weights(F.col("query"))))


def build_index(chunks: DataFrame, embedder: Embedder | None = None, **bm25: float) -> DataFrame:
    """Index rows: chunk keys, offsets where known and text, ``dense`` vector, ``sparse`` term weights."""
    if "chunk_id" not in chunks.columns:
        chunks = with_chunk_id(chunks)
    offsets = [c for c in ("char_start", "char_end") if c in chunks.columns]
    rows = chunks.select("user_id", "document_id", "chunk_id", "chunk_index", *offsets, "text")
    return embed(rows, "text", embedder).withColumn("sparse", passage_weights(F.col("text"), **bm25))


def upsert_index(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Points are keyed by chunk id: incoming rows replace current ones."""
    keep = current.join(incoming.select("user_id", "chunk_id"), ["user_id", "chunk_id"], "left_anti")
    return keep.unionByName(incoming)


def write_index(index: DataFrame, path: str, buckets: int = 256) -> None:
    """Parquet by user and document bucket. The bucket level keeps one huge user from becoming one
    directory and lets a document-set filter prune files; clustering by both leaves few small files, and a
    directory of more than a partition's advisory size is written by several tasks."""
    bucketed = index.withColumn("doc_bucket", F.pmod(F.xxhash64("document_id"), F.lit(buckets)).cast("int"))
    (
        bucketed.hint("rebalance", "user_id", "doc_bucket")
        .write.mode("overwrite")
        .partitionBy("user_id", "doc_bucket")
        .parquet(path)
    )


def delete_documents(index: DataFrame, deleted: DataFrame) -> DataFrame:
    """Remove every chunk or point of the deleted documents (``user_id, document_id``)."""
    return index.join(deleted.select("user_id", "document_id").distinct(), ["user_id", "document_id"], "left_anti")
