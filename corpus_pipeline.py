"""Cleaning a corpus: stages over `documents`, each written and read again as the next one's input.

Every stage works on all that the one before kept, and all but the last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.llm import minhash_dedup, mixing, pii, queries, sentencepiece_codec, toxicity
from loreweave.llm.common import read, store


def _whole(docs: DataFrame) -> DataFrame:
    """Key, text and source beside each whole row, so that columns of any name pass through an operator."""
    return docs.select("doc_id", "text", "source", F.struct("*").alias("_doc"))


def _rewritten(rows: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """The rows ``_doc`` with another text, and its length as n_chars."""
    new = {"text": text.alias("text"), "n_chars": F.length(text).cast("long").alias("n_chars")}
    return rows.select(*[new.get(c, F.col(f"_doc.`{c}`").alias(c)) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold; the model learns from all labels of the folder. Null and empty texts stay."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model, threshold=queries.TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles; documents without words stay."""
    return minhash_dedup.keep_first(docs, shingle=5, least=80, bands=32)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms in place of personal data; null texts stay null."""
    hidden = pii.pseudonymise(_whole(docs), queries.PII_KEY, keep=("_doc",))
    return _rewritten(hidden, docs.columns, F.col("text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for every piece that it takes of a document, so a document that it takes twice stands twice, and one without words not at all."""
    mixed = mixing.mix(_whole(docs), keep=("_doc",)).withColumn("_piece", F.explode("pieces"))
    first, after, text = F.col("_piece.first"), F.col("_piece.after"), F.col("_doc.text")
    return _rewritten(mixed, docs.columns, F.when((first == 0) & (after == F.col("size")), text).otherwise(mixing.cut(text, first, after)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of the mix."""
    return sentencepiece_codec.encode(docs, queries._model("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("minhash near-dedup", drop_near_duplicates),
    ("pii", hide_personal_data),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]
ORACLE_SQL = None  # a trained model, hashed shards and a tokenizer are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs, _ = store(docs)
    return docs
