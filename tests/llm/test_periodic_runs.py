"""Periodic runs and their collapsed texts against a search of every period."""

import hashlib
import random
import re
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from loreweave.llm import periodic_runs, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def every_run(w, least=6, power=4):
    found = set()
    for q in range(1, len(w) // power + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i + q - start
            if i > start and n >= max(least, power * q):
                stretch = w[start : start + n]
                if not any(stretch[:-r] == stretch[r:] for r in range(1, q)):
                    found.add((start, n, q))
            i += i == start
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {i for start, n, q in found for i in range(start + q, start + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_small_texts():
    rng = random.Random(1)
    for _ in range(600):
        texts = []
        for _ in range(rng.randint(1, 6)):
            n, letters = rng.randint(0, 60), "abcd"[: rng.randint(1, 4)]
            w = [rng.choice(letters) for _ in range(n)]
            if n and rng.random() < 0.6:
                a, p = rng.randrange(n), rng.randint(1, 9)
                w = [w[i] if i < a else w[min(a + (i - a) % p, n - 1)] for i in range(n)]
            texts.append(w)
        least, power = rng.choice([(6, 4), (6, 4), (4, 2), (9, 3), (2, 2)])
        sizes, runs, kept = periodic_runs._collapse(pa.array([" ".join(w) for w in texts]), least, power)
        for w, n, r, c in zip(texts, sizes.to_pylist(), runs.to_pylist(), kept.to_pylist()):
            want = every_run(w, least, power)
            assert n == len(w) and [tuple(x.values()) for x in r] == want and c == collapsed(w, want), (w, least, power)


def test_long_texts_and_ordered_sets():
    rng = random.Random(2)
    unit = [f"w{i}" for i in range(3000)]
    text = ["x", *(unit * 9), "y", *(["a"] * 5000), *[rng.choice("ab") for _ in range(5000)]]
    _, runs, _ = periodic_runs._collapse(pa.array([None, " ".join(text), ""]), 6, 4)
    got = [[tuple(x.values()) for x in r] for r in runs.to_pylist()]
    assert got[0] == got[2] == [] and (1, 27000, 3000) in got[1]
    tail = every_run(text[27002:])
    assert got[1][1:] == [(s + 27002, n, q) for s, n, q in tail]


def test_query_over_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(
        spark.createDataFrame([(100_001, None, "x", 1), (None, "a a a a a a a", "x", 1), (100_002, " \t", "x", 1)], "doc_id long, text string, source string, n int").drop("n"),
        allowMissingColumns=True,
    )
    found = {r.doc_id: r for r in queries.periodic(docs).collect()}
    planted = 0
    for d, text in docs.select("doc_id", "text").collect():
        w = WORD.findall(text or "")
        h = zlib.crc32(str(d).encode()) if d is not None else 1
        g = h // 10
        if h % 10 == 0 and w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
            planted += 1
        want = every_run(w)
        r = found[d]
        assert r.n_runs == len(want)
        best = max(want, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        assert (r.start, r.length, r.period) == (best or (None,) * 3) and r.exponent_milli == (best and 1000 * best[1] // best[2])
        assert r.runs_sha256 == digest("".join(f"{s},{n},{q}\n" for s, n, q in want)) and r.collapsed_sha256 == digest(collapsed(w, want))
    assert planted > 5 and len(found) == docs.count()


def test_edge_tables(spark):
    docs = spark.createDataFrame([("k", "a b a b a b a b", 1, 2), ("k", "a b a b a b a b", 1, 2), (None, None, 1, 2)], "doc_id string, text string, runs int, id int")
    rows = periodic_runs.find_runs(docs).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in rows] == [(None, 0, [], ""), *[("k", 8, [(0, 8, 2)], "a b")] * 2]
    assert periodic_runs.find_runs(docs.filter(F.lit(False))).count() == 0
