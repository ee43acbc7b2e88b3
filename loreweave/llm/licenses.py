"""Licence scans: a trained paragraph classifier, an unknown class, and a comparison with the notice itself.

A paragraph is a run of lines that aren't blank. Each line of it, and each window of lines over which a notice is wrapped, is
classified: its word n-grams go through a sparse multinomial logistic regression over licence families and an
unknown class, taught with varied copies of well-known notices, mixtures of their words, and lines of the corpus that match no notice. A
temperature fitted on held-out copies calibrates the probabilities. A family counts only if a notice of it is also largely
contained in the line or window.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Notices in common use, by family.
NOTICES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD", "Released under the BSD 3-Clause License."),
    ("BSD", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("GPL", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("LGPL", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC0", "To the extent possible under law, the author has waived all copyright under CC0 1.0."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND", "Licensed under CC BY-ND 4.0."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Copyright (c) 2020 Example Corporation. All rights reserved."),
)
#: Words that alone say nothing; an n-gram needs another word.
COMMON = frozenset("a an and are as at be been by for from has in is it of on or that the this to under was with you your".split())
_WORD = re.compile(r"\w+")
SAMPLE = 2000  # documents whose lines teach the unknown class
CONTAINED = 0.75


def ngrams(words: list[str]) -> list[str]:
    """Distinct 1- to 3-grams with a word that isn't common, in order."""
    out: dict[str, None] = {}
    for n in (1, 2, 3):
        for i in range(len(words) - n + 1):
            if not COMMON.issuperset(words[i : i + n]):
                out[" ".join(words[i : i + n])] = None
    return list(out)


def _words(line: str) -> list[str]:
    return _WORD.findall(line.lower())


_NOTICE_WORDS = [(family, _words(text)) for family, text in NOTICES]


def contained(words: list[str], family: str) -> float:
    """Largest part of a notice of ``family`` that stands in the paragraph, by pairs of neighbouring words."""
    have = set(zip(words, words[1:])) | {(w,) for w in words}
    best = 0.0
    for f, notice in _NOTICE_WORDS:
        if f == family:
            pairs = list(zip(notice, notice[1:])) or [(w,) for w in notice]
            best = max(best, sum(p in have for p in pairs) / len(pairs))
    return best


_PAIRS = [frozenset(zip(words, words[1:])) for _, words in _NOTICE_WORDS]


def paragraphs(text: str) -> Iterator[list[tuple[int, str, list[str]]]]:
    """Runs of lines that aren't blank, each line with its place and words."""
    out, at = [], 0
    for line in text.split("\n"):
        if line.strip():
            out.append((at, line, _words(line)))
        elif out:
            yield out
            out = []
        at += len(line) + 1
    if out:
        yield out


def wrapped(lines: list[list[str]]) -> list[tuple[int, int]]:
    """First and last line of each window of two lines or more over which a notice stands that none of its lines holds alone.

    A window has no room inside for more words than the notice has. Of overlapping windows of one notice the fullest counts,
    then the shortest.
    """
    if len(lines) < 2:
        return []
    flat = [(w, i) for i, words in enumerate(lines) for w in words]
    pairs = [((a, b), i, j) for (a, i), (b, j) in zip(flat, flat[1:])]  # with the lines of both words
    seen = {p for p, _, _ in pairs}
    out: set[tuple[int, int]] = set()
    for (_, notice), wanted in zip(_NOTICE_WORDS, _PAIRS):
        least = CONTAINED * len(wanted)
        if len(wanted & seen) < least:
            continue
        hits = [h for h in pairs if h[0] in wanted]
        found = []
        for k, (_, first, _) in enumerate(hits):
            if k and hits[k - 1][1] == first:
                continue
            have: set[tuple[str, str]] = set()
            room, upto = len(notice), first
            for pair, _, last in hits[k:]:
                while upto < last:  # lines between the first and the last are inside
                    room -= len(lines[upto]) if upto > first else 0
                    upto += 1
                if room < 0:
                    break
                if pair not in have:
                    have.add(pair)
                    if len(have) >= least:
                        found.append((-len(have), last - first, first, last))
        taken: list[tuple[int, int]] = []
        for _, _, i, j in sorted(found):
            if all(j < a or b < i for a, b in taken):
                taken.append((i, j))
        whole = [i for i in {i for a, b in taken for i in range(a, b + 1)} if len(wanted & set(zip(lines[i], lines[i][1:]))) >= least]
        out |= {(a, b) for a, b in taken if a < b and not any(a <= i <= b for i in whole)}
    return sorted(out)


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]
    grams: dict[str, int]
    weights: np.ndarray  # by gram and family
    bias: np.ndarray
    temperature: float

    def anchors(self) -> frozenset[str]:
        """Single words of the n-grams: a line without any is unknown."""
        return frozenset(g for g in self.grams if " " not in g)

    def predict(self, words: list[str]) -> tuple[str, float]:
        rows = [self.grams[g] for g in ngrams(words) if g in self.grams]
        z = (self.bias + self.weights[rows].sum(axis=0) / max(1.0, len(rows)) ** 0.5) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.families[best], float(p[best])


def _copies(rng: np.random.Generator, per_notice: int) -> list[tuple[str, list[str]]]:
    """Varied copies of the notices: words before or after, a word dropped, another year; and shuffled words as unknown."""
    filler = sorted({w for _, ws in _NOTICE_WORDS for w in ws})
    out = []
    for family, words in _NOTICE_WORDS:
        for _ in range(per_notice):
            w = [str(1990 + rng.integers(35)) if x.isdigit() and len(x) == 4 else x for x in words]
            if len(w) > 5 and rng.random() < 0.3:
                del w[rng.integers(len(w))]
            around = [f"w{rng.integers(1_000_000)}" for _ in range(rng.integers(0, 6))]
            cut = rng.integers(len(around) + 1)
            out.append((family, around[:cut] + w + around[cut:]))
        for _ in range(per_notice // 2):
            out.append((UNKNOWN, [filler[i] for i in rng.integers(len(filler), size=rng.integers(1, 8))] + [f"w{rng.integers(1_000_000)}" for _ in range(rng.integers(0, 8))]))
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(lines: list[list[str]], *, per_notice: int = 40, l2: float = 1e-4, steps: int = 300, seed: int = 3) -> Model:
    """Fit on varied notices and on ``lines`` of the unknown class; every fifth example is held out for the temperature."""
    rng = np.random.default_rng(seed)
    examples = _copies(rng, per_notice) + [(UNKNOWN, w) for w in lines]
    families = tuple(sorted({f for f, _ in NOTICES})) + (UNKNOWN,)
    grams = {g: i for i, g in enumerate(sorted({g for _, ws in _NOTICE_WORDS for g in ngrams(ws)}))}
    rows, cols, vals, y = [], [], [], []
    for i, (family, words) in enumerate(examples):
        have = [grams[g] for g in ngrams(words) if g in grams]
        rows += [i] * len(have)
        cols += have
        vals += [1.0 / max(1.0, len(have)) ** 0.5] * len(have)
        y.append(families.index(family))
    x = np.zeros((len(examples), len(grams)))
    x[rows, cols] = vals
    target = np.eye(len(families))[y]
    test = np.arange(len(examples)) % 5 == 4
    xt, tt = x[~test], target[~test]
    w, b = np.zeros((len(grams), len(families))), np.zeros(len(families))
    m = [np.zeros_like(w), np.zeros_like(b)]
    v = [np.zeros_like(w), np.zeros_like(b)]
    for t in range(1, steps + 1):
        off = (_softmax(xt @ w + b) - tt) / len(xt)
        for k, (p, g) in enumerate(((w, xt.T @ off + l2 * w), (b, off.sum(axis=0)))):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            p -= 0.05 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-9)
    z = x[test] @ w + b
    loss = {t: -np.log(np.maximum(1e-12, (_softmax(z / t) * target[test]).sum(axis=1))).mean() for t in np.geomspace(0.25, 4, 33)}
    return Model(families, grams, w, b, float(min(loss, key=loss.get)))


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, per_doc: int = 5, **how) -> Model:
    """Train with lines that hold a word of some notice but no notice, from the ``sample`` documents of lowest hash."""
    ids = docs.select(F.col(id_col).alias("_key")).dropna().distinct().orderBy(F.xxhash64("_key"), "_key").limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(ids), F.col("_id") == F.col("_key"))  # ``sample`` ids
    anchors = frozenset(w for _, ws in _NOTICE_WORDS for w in ws) - COMMON
    families = sorted({f for f, _ in NOTICES})

    def lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids_, found = [], []
            for i, text in zip(batch.column("_id").to_pylist(), batch.column("_text").to_pylist()):
                some = 0
                for lines_ in paragraphs(text or ""):
                    apart = {k for a, b in wrapped([w for _, _, w in lines_]) for k in range(a, b + 1)}
                    for k, (_, _, words) in enumerate(lines_):
                        if some < per_doc and k not in apart and not anchors.isdisjoint(words) and max(contained(words, f) for f in families) < 0.5:
                            ids_.append(str(i))
                            found.append(words[:200])
                            some += 1
            yield pa.RecordBatch.from_arrays([pa.array(ids_, pa.string()), pa.array(found, pa.list_(pa.string()))], names=["id", "words"])

    got = rows.select("_id", "_text").mapInArrow(lines, "id string, words array<string>").collect()
    return train([w for _, w in sorted((r["id"], list(r["words"])) for r in got)], **how)


def scan_text(text: str, model: Model, anchors: frozenset[str], sure: float) -> list[dict]:
    """Lines of a text in which the classifier sees a family with probability ``sure`` or more, and windows of lines in which it
    does and a notice stands."""
    low = text.lower()
    if anchors.isdisjoint(_WORD.findall(low)):
        return []
    out = []

    def look(words: list[str], start: int, end: int, only_confirmed: bool) -> None:
        if not anchors.isdisjoint(words):
            family, p = model.predict(words)
            if family != UNKNOWN and p >= sure:
                part = contained(words, family)
                if part >= CONTAINED or not only_confirmed:
                    out.append(dict(family=family, start=start, end=end, score=p, contained=part, confirmed=part >= CONTAINED))

    for lines in paragraphs(text):
        for at, line, words in lines:
            look(words, at, at + len(line), False)
        for i, j in wrapped([words for _, _, words in lines]):
            look([w for _, _, words in lines[i : j + 1] for w in words], lines[i][0], lines[j][0] + len(lines[j][1]), True)
    return sorted(out, key=lambda f: (f["start"], f["end"]))


_SPAN = "array<struct<family:string,start:int,end:int,score:double,contained:double,confirmed:boolean>>"
_SPAN_ARROW = pa.list_(pa.struct([("family", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("contained", pa.float64()), ("confirmed", pa.bool_())]))


def scan(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", sure: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: id, licence (family of the most probable confirmed paragraph, earliest of equals, else null), score
    (its probability, else 0), paragraphs (lines that the classifier takes for a notice, confirmed or not, and confirmed windows of lines, with their places).

    Null and empty texts have none. Null ids and repeated rows stay, an empty table gives none, other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    anchors = model.anchors()

    def go(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan_text(t.as_py() or "", model, anchors, sure) for t in batch.column("_text")]
            best = [max((f for f in fs if f["confirmed"]), key=lambda f: f["score"], default=None) for fs in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id"), pa.array([b and b["family"] for b in best], pa.string()),
                    pa.array([b["score"] if b else 0.0 for b in best], pa.float64()), pa.array(found, _SPAN_ARROW),
                ],
                names=["_id", "licence", "score", "paragraphs"],
            )

    return rows.mapInArrow(go, f"_id {kind}, licence string, score double, paragraphs {_SPAN}").withColumnRenamed("_id", id_col)
