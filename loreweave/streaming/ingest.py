"""Incremental ingest: files in, documents, chunks, index rows and graph deltas out."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loreweave.functions.text import sanitize_filename, strip
from loreweave.functions.vectors import Embedder
from loreweave.operators.chunking import chunk, with_chunk_id
from loreweave.operators.extraction import Extractor
from loreweave.operators.graph_ingest import TABLES, build_kg, merge_log, read_log, reindex_chunks, write_delta
from loreweave.operators.index import build_index
from loreweave.operators.operations import retry_selection
from loreweave.session import delete_tables
from loreweave.sources.intake import decode_text, intake

log = logging.getLogger(__name__)
UPLOAD = "user_id string, document_id string, filename string, content_type string, content binary"


def process_documents(uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with final status, and chunks of the good ones. No bad row fails the batch."""
    checked = intake(uploads.withColumn("size_bytes", F.length("content").cast("long")))
    decoded = decode_text(checked)
    error = F.coalesce("reject_reason", "error_message")
    documents = decoded.select(
        "user_id", "document_id", sanitize_filename(F.col("filename")).alias("filename"), "content_type", "size_bytes",
        F.when(error.isNull(), "processed").otherwise("failed").alias("status"),
        F.when(error.isNull(), F.col("extracted_text")).alias("extracted_text"), error.alias("error_message"),
    )
    good = documents.filter((F.col("status") == "processed") & (strip(F.col("extracted_text")) != ""))
    return documents, with_chunk_id(chunk(good, drop_noise=True))


def ingest_batch(
    batch: DataFrame, batch_id: int, root: str, extractor: Extractor | None = None, embedder: Embedder | None = None
) -> None:
    """Write one micro-batch below ``root``.

    Every table has one folder per batch, overwritten on replay, and the documents folder comes last:
    readers only accept rows whose batch is the document's latest committed one, so a batch that died
    half-way leaves no visible chunk. The graph step is best effort: when it fails, nothing of the batch enters the graph,
    its documents are committed all the same, and ``graph_runs`` holds the outcome that the retry rule reads.
    """
    spark = batch.sparkSession
    documents, chunks = process_documents(batch)
    documents.write.mode("overwrite").parquet(f"{root}/staged/batch_id={batch_id}")
    build_index(chunks, embedder).write.mode("overwrite").parquet(f"{root}/index/batch_id={batch_id}")
    if extractor is not None:
        _graph_step(spark, root, batch_id, extractor, embedder)
    spark.read.parquet(f"{root}/staged/batch_id={batch_id}").write.mode("overwrite").parquet(f"{root}/documents/batch_id={batch_id}")


def _graph_step(spark: SparkSession, root: str, batch_id: int, extractor: Extractor, embedder: Embedder | None) -> None:
    """Graph delta of a stored batch, and one ``graph_runs`` row per processed document: entities found, and whether to try again.

    A document all of whose chunks were noise is read whole, as chunk 0.
    """
    staged = spark.read.parquet(f"{root}/staged/batch_id={batch_id}")
    chunks = reindex_chunks(staged, spark.read.parquet(f"{root}/index/batch_id={batch_id}"))
    keys = ["user_id", "document_id"]
    try:
        graph = merge_log(read_log(spark, f"{root}/graph", before=batch_id))
        delta = build_kg(chunks, graph, extractor, now=F.current_timestamp(), batch=batch_id, embedder=embedder)
        write_delta(delta, f"{root}/graph", batch_id)
        found = spark.read.parquet(f"{root}/graph/entity_docs/batch_id={batch_id}").groupBy(*keys).agg(F.count(F.lit(1)).alias("entities"))
        failed = None
    except Exception as e:  # a failing model or graph is no reason to lose the documents
        log.warning("graph step of batch %s failed: %s", batch_id, e)
        delete_tables(spark, *[f"{root}/graph/{name}/batch_id={batch_id}" for name in TABLES])
        found = spark.createDataFrame([], "user_id string, document_id string, entities long")
        failed = str(e)[:500]
    runs = staged.filter(F.col("status") == "processed").select(*keys).join(found, keys, "left")
    runs = runs.select(*keys, F.coalesce("entities", F.lit(0)).alias("entities"), F.lit(failed is not None).alias("transient"), F.lit(failed).cast("string").alias("error"))
    runs.write.mode("overwrite").parquet(f"{root}/graph_runs/batch_id={batch_id}")


def graph_retries(spark: SparkSession, root: str) -> DataFrame:
    """Documents with their graph attempts so far and whether another is due (see ``operations.retry_selection``)."""
    attempt = F.row_number().over(Window.partitionBy("user_id", "document_id").orderBy("batch_id"))
    return retry_selection(spark.read.parquet(f"{root}/graph_runs").withColumn("attempt", attempt))


def start_ingest(
    uploads: DataFrame, root: str, checkpoint: str, extractor: Extractor | None = None, embedder: Embedder | None = None,
    **trigger,
) -> StreamingQuery:
    """Run :func:`ingest_batch` on a stream of uploads (:data:`UPLOAD` columns)."""
    writer = uploads.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, i: ingest_batch(df, i, root, extractor, embedder)
    )
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """Latest committed row per document."""
    rows = spark.read.parquet(f"{root}/documents")
    columns = [c for c in rows.columns if c not in ("user_id", "document_id")]
    return rows.groupBy("user_id", "document_id").agg(F.max_by(F.struct(*columns), "batch_id").alias("r")).select("user_id", "document_id", "r.*")


def read_index(spark: SparkSession, root: str) -> DataFrame:
    """Index rows of the latest committed batch of every document."""
    last = spark.read.parquet(f"{root}/documents").groupBy("user_id", "document_id").agg(F.max("batch_id").alias("batch_id"))
    return spark.read.parquet(f"{root}/index").join(last, ["user_id", "document_id", "batch_id"], "left_semi").drop("batch_id")
