"""Batch hybrid retrieval: exact top-k, rank fusion, reranking, diversification.

Questions are rows and never pass the driver. Vectors meet on a grid of tiles, questions by index rows of a user, and a tile returns only its best
``k`` rows a question; terms are looked up in an inverted index with pruning by block maxima. No table of pairs exists, and one small
shuffle merges what tiles and blocks return.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreweave.functions.text import clip, snippet, tokens
from loreweave.functions.vectors import Embedder, embed
from loreweave.operators.index import query_weights
from loreweave.operators.inverted import Inverted, build_inverted, lexical_top_k
from loreweave.operators.ranking import top_k
from loreweave.operators.tiles import matrix, tile_join
from loreweave.session import cut_lineage

# Fixed values of the retrieval settings.
TOP_K = 5
CANDIDATES = 40
PER_BRANCH = 30
MAX_PER_DOCUMENT = 2
RRF_K = 60

QUERY_BATCH = 2048  # questions of a tile
INDEX_BLOCK = 16_384  # index rows of a tile
SCORE_DIGITS = 6
BLOCK = 512


def restrict(chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """Chunks a request may see: same user and, when the request lists documents, one of them.

    ``requests``: ``user_id, document_ids array`` with null or empty meaning every document of the user.
    """
    empty = F.col("document_ids").isNull() | (F.size("document_ids") == 0)
    open_users = requests.filter(empty).select("user_id").distinct()
    listed = (
        requests.filter(~empty)
        .select("user_id", F.explode("document_ids").alias("document_id"))
        .distinct()
        .join(open_users, "user_id", "left_anti")
    )
    return chunks.join(open_users, "user_id", "left_semi").unionByName(
        chunks.join(listed, ["user_id", "document_id"], "left_semi")
    )


def _dense_hits(queries: DataFrame, index: DataFrame, limit: str, batch: int) -> DataFrame:
    """Best chunks of each question by dot product: ``query_id, chunk_id, score, limit``, at most ``limit`` from every tile.

    Questions and index rows of a user and vector length meet on tiles of ``batch`` questions; a tile returns its best rows only.
    """
    size = F.size("dense")
    asked = queries.filter((size > 0) & (F.col(limit) > 0)).select("user_id", size.alias("_size"), "query_id", "document_ids", F.col(limit).alias("limit"), "dense")
    held = index.filter(size > 0).select("user_id", size.alias("_size"), "chunk_id", "document_id", "dense")
    kinds = {f.name: f.dataType.simpleString() for f in [*asked.schema.fields, *held.schema.fields]}

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.take(pc.sort_indices(b["chunk_id"]))  # so that the first of equal scores is the smallest id
        documents = b["document_id"].to_pylist() if len(a) and any(a["document_ids"].to_pylist()) else []
        found: list[np.ndarray] = [np.empty(0, np.int64)]
        values = [np.empty(0)]
        vectors = matrix(b["dense"]).T if len(b) else None
        for at in range(0, len(a) if len(b) else 0, BLOCK):
            part = a.slice(at, BLOCK)
            scores = np.round(matrix(part["dense"]) @ vectors, SCORE_DIGITS)
            for row, k, only in zip(scores, part["limit"].to_pylist(), part["document_ids"].to_pylist()):
                if only:
                    allowed = set(only)
                    open_ = np.fromiter((i for i, d in enumerate(documents) if d in allowed), np.int64)
                else:
                    open_ = np.arange(len(row))
                score = row[open_]
                if len(score) > k:  # ties with the k-th score stay in
                    kept = score >= np.partition(score, len(score) - k)[len(score) - k]
                    open_, score = open_[kept], score[kept]
                best = np.argsort(-score, kind="stable")[:k]
                found.append(open_[best])
                values.append(score[best])
        owner = np.repeat(np.arange(len(found) - 1), [len(f) for f in found[1:]])
        rows = a.take(pa.array(owner, pa.int64()))
        columns = [rows["query_id"], b["chunk_id"].take(pa.array(np.concatenate(found))), pa.array(np.concatenate(values)), rows["limit"]]
        return pa.table(columns, names=["query_id", "chunk_id", "score", "limit"])

    schema = f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double, limit int"
    return tile_join(asked, held, ["user_id", "_size"], "query_id", "chunk_id", meet, schema, left_block=batch, right_block=INDEX_BLOCK)


def search(queries: DataFrame, index: DataFrame, limits: dict[str, Column | int], *, inverted: Inverted | None = None, batch: int = QUERY_BATCH) -> DataFrame:
    """Best index rows per question and branch.

    ``limits``: branch (``dense``, ``sparse``) -> rows wanted, a number or a per-question expression. Output:
    ``query_id, branch, chunk_id, score`` + chunk columns + ``branch_rank``. ``inverted`` is the stored inverted form of ``index``; it is built
    for these questions where none is given and the sparse branch is asked for. Texts join the best rows at the end and take part in nothing before.
    """
    if "document_ids" not in queries.columns:
        queries = queries.withColumn("document_ids", F.lit(None).cast(T.ArrayType(index.schema["document_id"].dataType)))
    wanted = {b: F.when(F.size(b) > 0, k if isinstance(k, Column) else F.lit(k)).otherwise(0).cast("int") for b, k in limits.items()}
    encoded = cut_lineage(queries.select("query_id", "user_id", "document_ids", *limits, *[w.alias(f"k_{b}") for b, w in wanted.items()]))
    parts = []
    for branch in limits:
        if branch == "dense":
            hits = _dense_hits(encoded, index, "k_dense", batch)
        else:
            hits = lexical_top_k(encoded, inverted or build_inverted(index, asked=encoded), "k_sparse")
        parts.append(hits.withColumn("branch", F.lit(branch)))
    found = reduce(DataFrame.unionByName, parts).join(encoded.select("query_id", "user_id"), "query_id")
    w = Window.partitionBy("query_id", "branch").orderBy(F.desc("score"), F.asc("chunk_id"))
    best = found.withColumn("branch_rank", F.row_number().over(w)).filter(F.col("branch_rank") <= F.col("limit")).drop("limit")
    texts = index.select("user_id", "chunk_id", "document_id", "chunk_index", "text")
    joined = best.join(texts, ["user_id", "chunk_id"])
    return joined.select("query_id", "branch", "chunk_id", "score", "user_id", "document_id", "chunk_index", "text", "branch_rank")


def dense_top_k(queries: DataFrame, index: DataFrame, k: int = PER_BRANCH, *, batch: int = QUERY_BATCH) -> DataFrame:
    """Cosine top-k of unit vectors. ``queries``: ``query_id, user_id, dense[, document_ids]``."""
    return search(queries, index, {"dense": k}, batch=batch)


def sparse_top_k(queries: DataFrame, index: DataFrame, k: int = PER_BRANCH, *, inverted: Inverted | None = None) -> DataFrame:
    """Lexical top-k: dot product of term weights; chunks sharing no term are not candidates."""
    return search(queries, index, {"sparse": k}, inverted=inverted)


def reciprocal_rank_fusion(branches: DataFrame, limit: int, k: int = RRF_K) -> DataFrame:
    """Fuse ranked branches (``query_id, chunk_id, branch_rank`` + chunk columns) into ``rank, score``."""
    chunk = F.first(F.struct("user_id", "document_id", "chunk_index", "text"))
    fused = branches.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(1.0 / (k + F.col("branch_rank"))), 9).alias("score"), chunk.alias("_c")
    )
    fused = fused.select("query_id", "chunk_id", "score", "_c.*")
    return top_k(fused, ["query_id"], [F.desc("score"), F.asc("chunk_id")], limit)


def candidate_search(
    queries: DataFrame,
    index: DataFrame,
    limit: int = CANDIDATES,
    *,
    hybrid: bool = True,
    per_branch: int = PER_BRANCH,
    rrf_k: int = RRF_K,
    inverted: Inverted | None = None,
    batch: int = QUERY_BATCH,
) -> DataFrame:
    """Fused candidates; questions without lexical terms (or ``hybrid=False``) take the dense branch alone."""
    columns = ["query_id", "chunk_id", "score", "user_id", "document_id", "chunk_index", "text", "rank"]
    if not hybrid:
        return dense_top_k(queries, index, limit, batch=batch).withColumnRenamed("branch_rank", "rank").select(columns)
    lexical = F.size("sparse") > 0
    hits = search(queries, index, {"dense": F.when(lexical, per_branch).otherwise(limit), "sparse": per_branch}, inverted=inverted, batch=batch)
    marked = hits.join(queries.select("query_id", lexical.alias("_lexical")), "query_id")
    fused = reciprocal_rank_fusion(marked.filter("_lexical"), limit, rrf_k).select(columns)
    plain = marked.filter("not _lexical").withColumnRenamed("branch_rank", "rank")
    return fused.unionByName(plain.select(columns))


PairScorer = Callable[[Column, Column], Column]


def token_overlap(query: Column, text: Column) -> Column:
    """Default pair scorer: share of the question's distinct tokens present in the text."""
    asked = F.array_distinct(tokens(query))
    common = F.size(F.array_intersect(asked, tokens(text)))
    return F.round(common / F.greatest(F.size(asked), F.lit(1)), SCORE_DIGITS)


def rerank(
    candidates: DataFrame, queries: DataFrame, scorer: PairScorer | None = token_overlap, k: int | None = None
) -> DataFrame:
    """Reorder candidates by a pair scorer, ties keeping the earlier rank.

    ``scorer`` maps (query, text) to a double: an expression or an iterator pandas UDF. Questions with a
    single candidate, or with any failed (null) score, keep their order and scores.
    """
    if scorer is None:
        out = candidates
    else:
        scored = candidates.join(queries.select("query_id", "query"), "query_id").withColumn(
            "_s", scorer(F.col("query"), F.col("text"))
        )
        mine = Window.partitionBy("query_id")
        usable = (F.count(F.lit(1)).over(mine) > 1) & (F.count("_s").over(mine) == F.count(F.lit(1)).over(mine))
        scored = scored.withColumn("_ok", usable)
        order = [F.desc(F.when(F.col("_ok"), F.col("_s"))), F.asc("rank")]
        out = (
            scored.withColumn("_rank", F.row_number().over(mine.orderBy(*order)))
            .withColumn("score", F.when(F.col("_ok"), F.col("_s")).otherwise(F.col("score")))
            .withColumn("rank", F.col("_rank"))
            .drop("_s", "_ok", "_rank", "query")
        )
    return out if k is None else out.filter(F.col("rank") <= k)


def diversify(ranked: DataFrame, k: int = TOP_K, max_per_doc: int = MAX_PER_DOCUMENT) -> DataFrame:
    """At most ``max_per_doc`` chunks per document in rank order, back-filled from the rest.

    A cap of zero, or a pool that already fits ``k``, is a plain prefix.
    """
    if max_per_doc <= 0:
        return ranked.filter(F.col("rank") <= k)
    in_doc = Window.partitionBy("query_id", "document_id").orderBy("rank")
    pool = Window.partitionBy("query_id")
    tiered = ranked.withColumn("_over", (F.row_number().over(in_doc) > max_per_doc).cast("int")).withColumn(
        "_over", F.when(F.count(F.lit(1)).over(pool) <= k, 0).otherwise(F.col("_over"))
    )
    order = Window.partitionBy("query_id").orderBy("_over", "rank")
    return (
        tiered.withColumn("_new", F.row_number().over(order))
        .filter(F.col("_new") <= k)
        .withColumn("rank", F.col("_new"))
        .drop("_over", "_new")
    )


def encode_queries(queries: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """Add ``dense`` and ``sparse`` codes to ``query_id, user_id, query[, document_ids]``."""
    return embed(queries, "query", embedder).withColumn("sparse", query_weights(F.col("query")))


def retrieve(
    queries: DataFrame,
    index: DataFrame,
    k: int = TOP_K,
    *,
    candidates: int = CANDIDATES,
    max_per_doc: int = MAX_PER_DOCUMENT,
    scorer: PairScorer | None = token_overlap,
    hybrid: bool = True,
    embedder: Embedder | None = None,
    inverted: Inverted | None = None,
    batch: int = QUERY_BATCH,
) -> DataFrame:
    """Candidates → rerank the whole pool → diversify → top ``k``, for every question at once."""
    encoded = encode_queries(queries, embedder)
    pool = candidate_search(encoded, index, max(k, candidates), hybrid=hybrid, inverted=inverted, batch=batch)
    return diversify(rerank(pool, queries, scorer), k, max_per_doc)


def retrieval_stats(candidates: DataFrame, results: DataFrame) -> DataFrame:
    """Candidate count, result count and distinct documents per question."""
    pool = candidates.groupBy("query_id").agg(F.count(F.lit(1)).alias("candidate_count"))
    kept = results.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("result_count"), F.count_distinct("document_id").alias("distinct_documents")
    )
    return pool.join(kept, "query_id", "left").na.fill(0, ["result_count", "distinct_documents"])


def citations(results: DataFrame, queries: DataFrame, width: int = 280) -> DataFrame:
    """Chunk hits as citations with a preview centred on the question."""
    return results.join(queries.select("query_id", "query"), "query_id").select(
        "query_id", "rank", "chunk_id", "document_id", "chunk_index", "score",
        snippet(F.col("text"), F.col("query"), width).alias("text_preview"),
    )


def web_citations(results: DataFrame, width: int = 240) -> DataFrame:
    return results.select("query_id", "rank", "url", "title", clip(F.col("content"), width).alias("snippet"), "score")


def score_bucket(score: Column) -> Column:
    """Relevance label of a citation score."""
    return F.when(score >= 0.5, "strong").when(score >= 0.2, "moderate").otherwise("weak")
