"""Toxicity by multiple-instance learning: sentences scored by a linear model, joined by noisy-or, taught by documents.

A document is toxic if any of its sentences is: 1 - P(doc) is the product of 1 - P(sentence). Only document labels
are known; the gradient of the document likelihood shares the blame among the sentences. Features of a sentence are
its words and their beginnings, screened by how much oftener labelled documents of class 1 hold them. A sentence without any known
feature is no evidence and has probability 0, so clean documents of any length score 0.

The model is fitted on a bounded sample of labelled rows (``per_class`` of each class); every document is scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.llm.common import by_bytes

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")
BEGINNINGS = (4, 5, 6)
MAX_WORD = 40
PER_CLASS = 8192  # labelled rows of each class that are learned from
FEATURES = 4096


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) > n)] if len(word) <= MAX_WORD else []


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float


def _screen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that hold a feature, counted per batch."""
    for batch in (part for whole in batches for part in by_bytes(whole, "_text")):
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for text, toxic in zip(batch.column("_text").to_pylist(), batch.column("_toxic").to_pylist()):
            found: set[str] = set()
            for w in set(_WORD.findall((text or "").lower())):
                found.update(features(w))
            counts[toxic].update(found)
        names = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), *(pa.array([c[n] for n in names], pa.int64()) for c in counts)], names=["feature", "clean", "toxic"]
        )


def _instances(batches: Iterable[pa.RecordBatch], known: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """The feature numbers of the sentences that have any, and how many each has, as bytes of 32-bit numbers."""
    for batch in (part for whole in batches for part in by_bytes(whole, "_text")):
        flat, sizes = [], []
        for text in batch.column("_text").to_pylist():
            bag = []
            for s in _SENTENCE.findall((text or "").lower()):
                have = {known[f] for w in set(_WORD.findall(s)) for f in features(w) if f in known}
                if have:
                    bag.append(sorted(have))
            flat.append(np.fromiter((i for s in bag for i in s), np.int32).tobytes())
            sizes.append(np.array([len(s) for s in bag], np.int32).tobytes())
        columns = [batch.column("_id").cast(pa.string()), batch.column("_toxic"), pa.array(sizes, pa.binary()), pa.array(flat, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "toxic", "sizes", "flat"])


def sample(labels: DataFrame, id_col: str, label_col: str, per_class: int) -> DataFrame:
    """Up to ``per_class`` labelled ids of each class, lowest hash first. Null labels are left out, a class repeated for an id
    counts once, and an id with both is of class 1."""
    rows = labels.select(F.col(id_col).alias("_key"), F.col(label_col).cast("int").alias("_toxic")).dropna()
    rows = rows.groupBy("_key").agg(F.max(F.when(F.col("_toxic") > 0, 1).otherwise(0)).alias("_toxic"))
    rows = rows.withColumn("_order", F.xxhash64("_key"))
    one = [rows.filter(F.col("_toxic") == c).orderBy("_order", "_key").limit(per_class) for c in (0, 1)]
    return one[0].unionByName(one[1]).select("_key", "_toxic")


def fit(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    per_class: int = PER_CLASS, n_features: int = FEATURES, min_docs: int = 3, l2: float = 0.02, steps: int = 400,
) -> Model:
    """Learn from at most ``per_class`` labelled documents of each class. Without any of class 1, every score is 0."""
    chosen = F.broadcast(sample(labels, id_col, label_col, per_class))  # at most 2 * per_class pairs of numbers
    text = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = text.join(chosen, F.col("_id") == F.col("_key")).select("_id", "_text", "_toxic")
    sizes = {r["_toxic"]: r["count"] for r in chosen.groupBy("_toxic").count().collect()}
    n0, n1 = max(1, sizes.get(0, 0)), max(1, sizes.get(1, 0))
    counts = rows.mapInArrow(_screen, "feature string, clean long, toxic long").groupBy("feature").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")
    )
    p0, p1, p = F.col("clean") / n0, F.col("toxic") / n1, (F.col("clean") + F.col("toxic")) / (n0 + n1)
    z = (p1 - p0) / F.sqrt(p * (1 - p) * (1 / n0 + 1 / n1) + 1e-12)
    picked = counts.filter((F.col("toxic") >= min_docs) & (z > 3)).select("feature", z.alias("z")).orderBy(F.desc("z"), "feature").limit(n_features).collect()
    names = [r["feature"] for r in picked]
    known = {f: i for i, f in enumerate(names)}
    bags = rows.mapInArrow(lambda it: _instances(it, known), "id string, toxic int, sizes binary, flat binary").collect() if names else []
    return train(names, sorted((r["id"], r["toxic"], bytes(r["sizes"]), bytes(r["flat"])) for r in bags), l2=l2, steps=steps)


def train(names: list[str], bags: list[tuple[str, int, bytes, bytes]], *, l2: float, steps: int) -> Model:
    """Maximum likelihood of the noisy-or over bags of sentences, by Adam over all of them; the classes weigh the same.

    A bag has an id, a label, and the bytes of its sentences' sizes and feature numbers.
    """
    bags = [b for b in bags if b[2]]
    if not any(b[1] for b in bags):
        return Model({}, -5.0)
    label = np.array([b[1] for b in bags])
    sizes = [np.frombuffer(b[2], np.int32) for b in bags]
    bag_of = np.repeat(np.arange(len(bags)), [len(s) for s in sizes])
    lists = np.concatenate(sizes)
    row = np.repeat(np.arange(len(lists)), lists)
    col = np.frombuffer(b"".join(b[3] for b in bags), np.int32).astype(np.int64)
    weight = np.where(label == 1, 1.0 / max(1, label.sum()), 1.0 / max(1, (1 - label).sum())) * len(bags) / 2
    w = np.zeros(len(names) + 1)
    w[-1] = -3.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = np.bincount(row, w[col], len(lists)) + w[-1]
        soft = np.logaddexp(0, z)
        p = np.exp(z - soft)
        none = np.bincount(bag_of, soft, len(bags))  # -log(1 - P)
        up = np.where(label == 1, -np.exp(-none) / np.maximum(1e-12, -np.expm1(-none)), 1.0) * weight
        g = up[bag_of] * p
        grad = np.append(np.bincount(col, g[row], len(names)) + l2 * w[:-1], g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return Model({f: float(x) for f, x in zip(names, w) if abs(x) > 1e-4}, float(w[-1]))


class _Weights(dict):
    """Word -> (weight of all its features, has any); filled on demand, at most ``most`` words of bounded length."""

    def __init__(self, model: Model, most: int = 200_000) -> None:
        super().__init__()
        self.model, self.most = model, most

    def __missing__(self, word: str) -> tuple[float, ...] | None:
        found = tuple(f for f in features(word) if f in self.model.weights) or None
        if len(word) <= MAX_WORD:
            if len(self) >= self.most:
                self.clear()
            self[word] = found
        return found


def score_text(text: str, known: _Weights) -> tuple[float, list[tuple[int, int, float]]]:
    """Score of a text, and (start, end, probability) of its sentences that have any known feature."""
    low = text.lower()
    if not any(map(known.__getitem__, _WORD.findall(low))):
        return 0.0, []
    weights, bias = known.model.weights, known.model.bias
    same = len(low) == len(text)  # else a few characters change length in lower case and places are found again
    none, found = 0.0, []
    for s in _SENTENCE.finditer(text):
        have: set[str] = set()
        for w in _WORD.findall(low[s.start() : s.end()] if same else s.group().lower()):
            if f := known[w]:
                have.update(f)
        if have:
            z = bias + sum(weights[f] for f in sorted(have))
            soft = z + log1p(exp(-z)) if z > 0 else log1p(exp(z))
            none += soft
            found.append((s.start(), s.end(), exp(z - soft)))
    return 1.0 - exp(-none), found


def _score(batches: Iterable[pa.RecordBatch], model: Model, threshold: float) -> Iterator[pa.RecordBatch]:
    known = _Weights(model)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
    for batch in (part for whole in batches for part in by_bytes(whole, "_text")):
        scores, spans = [], []
        for text in batch.column("_text"):
            p, found = score_text(text.as_py() or "", known)
            scores.append(p)
            spans.append([dict(start=a, end=b, score=s) for a, b, s in found if s >= threshold])
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), pa.array(scores, pa.float64()), pa.array(spans, pa.list_(span))], names=["_id", "score", "sentences"]
        )


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: id, score of the whole text, and its sentences of ``threshold`` or more with their places.

    Null and empty texts score 0. Null ids and repeated rows stay, an empty table gives none, other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    out = rows.mapInArrow(lambda it: _score(it, model, threshold), f"_id {kind}, score double, sentences array<struct<start:int,end:int,score:double>>")
    return out.withColumnRenamed("_id", id_col)


def keep_clean(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores under ``threshold``."""

    def clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Weights(model)
        for batch in (part for whole in batches for part in by_bytes(whole, text_col)):
            at = batch.schema.get_field_index(text_col)
            yield batch.filter(pa.array([score_text(t.as_py() or "", known)[0] < threshold for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
