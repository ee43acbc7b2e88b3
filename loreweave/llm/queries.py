"""One query per operator over its whole table, and SQL twins where SQL can say the same."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.llm import ann, chat_format, lattice_dedup, licenses, merkle, minhash_dedup, mixing, periodic_runs, pii, secret_links, sentencepiece_codec, token_counts, toxicity
from loreweave.llm.common import read
from loreweave.llm.sql import SQL  # noqa: F401

CONTEXT = 2048  # tokens; a longer document is over the limit


def _model(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, root: str) -> DataFrame:
    counts = token_counts.count_tokens(read(spark, root, "documents"), _model("word_bpe_49k.json"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > CONTEXT).alias("over_limit"))


def op2_sentencepiece(spark: SparkSession, root: str) -> DataFrame:
    return sentencepiece_codec.encode(read(spark, root, "documents"), _model("piece_bpe_32k.model"))


def op3_chat_format(spark: SparkSession, root: str) -> DataFrame:
    return chat_format.repair(read(spark, root, "conversations"))


PII_KEY = "example key; give your own from a secret store"


def op4_pii(spark: SparkSession, root: str) -> DataFrame:
    return pii.pseudonymise(read(spark, root, "documents"), PII_KEY)


def op5_mixing(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix(read(spark, root, "documents")).drop("pieces")


def _held_out(doc_id: str):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


TOXIC = 0.7


def toxicity_model(spark: SparkSession, root: str) -> toxicity.Model:
    """Learned from the labelled documents that are not held out."""
    labels = read(spark, root, "labels").filter(~_held_out("doc_id"))
    return toxicity.fit(read(spark, root, "documents"), labels)


def op6_toxicity(spark: SparkSession, root: str) -> DataFrame:
    scored = toxicity.score(read(spark, root, "documents"), toxicity_model(spark, root))
    return scored.select(
        "doc_id", _held_out("doc_id").alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"),
        F.size("sentences").alias("n_sentences"), "sentences",
    )


def op7_nearest(spark: SparkSession, root: str) -> DataFrame:
    return ann.search(read(spark, root, "embeddings"), "vec_id % 50 = 0")


def op8_lattice_dedup(spark: SparkSession, root: str) -> DataFrame:
    return lattice_dedup.find(read(spark, root, "embeddings"))


def op9_minhash_dedup(spark: SparkSession, root: str) -> DataFrame:
    return minhash_dedup.find(read(spark, root, "documents"), shingle=3, least=85)


def op10_licenses(spark: SparkSession, root: str) -> DataFrame:
    docs = read(spark, root, "documents")
    return licenses.scan(docs, licenses.fit(docs))


def secret_digests(docs: DataFrame) -> DataFrame:
    """Findings of documents as the contract's columns."""
    found = secret_links.scan(docs)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_links.BASE))
    return found.select(
        "doc_id", *[count(k) for k in secret_links.BASE], F.sha2(secret_links.written(base), 256).alias("base_sha256"), secret_links.written(F.col("spans")).alias("spans")
    )


def op11_secret_links(spark: SparkSession, root: str) -> DataFrame:
    return secret_digests(read(spark, root, "documents"))


def op12_merkle_manifest(spark: SparkSession, root: str) -> DataFrame:
    """A third of the rows is tampered with: the letters A-Z of their texts are lower-cased."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    proofs = merkle.manifest(read(spark, root, "documents"), altered={"text": F.when(tampered, lower).otherwise(F.col("text"))})
    folded = merkle.fold(F.coalesce("altered_leaf", "leaf"), F.col("path"))
    out = proofs.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _with_repetitions(docs: DataFrame) -> DataFrame:
    """The contract's texts: in a tenth of the documents, the words from one on repeat a stretch."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeat(words: Column) -> Column:
        n = F.size(words).cast("long")
        first = g % n
        period = F.floor((n - first) / (g % 8 + 3)) + 1
        at = lambda i: F.when(i < first, i).otherwise(first + (i - first) % period)
        changed = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, at(i).cast("int")))
        return F.when(n > 0, F.array_join(changed, " ")).otherwise(F.lit(""))

    words = F.filter(F.split(F.col("text"), periodic_runs.WHITE), lambda w: w != "")
    changed = F.element_at(F.transform(F.array(words), repeat), 1)  # bound by a lambda, so that the words are split once
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


def periodic(docs: DataFrame) -> DataFrame:
    """Runs of documents as digests."""
    found = periodic_runs.find_runs(_with_repetitions(docs))
    best = F.reduce("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda x, r: F.when(
        x.isNull() | (r["length"] * x["period"] > x["length"] * r["period"]), r).otherwise(x))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
                       F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "best.*", F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_periodic_runs(spark: SparkSession, root: str) -> DataFrame:
    return periodic(read(spark, root, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_chat_format": op3_chat_format,
    "op4_pii": op4_pii,
    "op5_mixing": op5_mixing,
    "op6_toxicity": op6_toxicity,
    "op7_nearest": op7_nearest,
    "op8_lattice_dedup": op8_lattice_dedup,
    "op9_minhash_dedup": op9_minhash_dedup,
    "op10_licenses": op10_licenses,
    "op11_secret_links": op11_secret_links,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_periodic_runs": op13_periodic_runs,
}
