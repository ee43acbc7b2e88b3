import random

import pytest

from loreweave.operators import chunking
from loreweave.operators.chunking import window_spans


def walk(body, size, overlap):
    """Plain restatement of the window rule, one character step at a time."""
    out, start = [], 0
    while start < len(body):
        end = min(start + size, len(body))
        if end < len(body):
            for mark in ("\n\n", "\n", ". ", " "):
                found = [p for p in range(start + 1, end - len(mark) + 1) if body[p : p + len(mark)] == mark]
                if found:
                    end = found[-1] + len(mark)
                    break
        out.append((start, end))
        if end >= len(body):
            break
        start = max(start + 1, end - overlap)
    return out


def random_body(rng, n):
    return "".join(rng.choice(["a", "b", "word", " ", " ", ". ", "\n", "\n\n", "\n\n\n", "x" * rng.randint(1, 40)]) for _ in range(n))


def test_spans_match_plain_walk():
    rng = random.Random(5)
    for _ in range(400):
        body, size = random_body(rng, rng.randint(0, 60)), rng.randint(5, 90)
        overlap = rng.randint(0, size - 1)
        want = walk(body, size, overlap)
        assert [(a, b) for _, a, b in window_spans(body, size, overlap)] == want
        # Skipping repeats keeps numbering and drops exactly the pieces ending where the previous one ended.
        kept = [(i, a, b) for i, (a, b) in enumerate(want) if i == 0 or want[i - 1][1] != b]
        assert list(window_spans(body, size, overlap, True)) == kept


def rows(spark, *texts, **kw):
    docs = spark.createDataFrame([("u", str(i), t) for i, t in enumerate(texts)], "user_id string, document_id string, extracted_text string")
    return sorted(chunking.chunk(docs, **kw).collect(), key=lambda r: (r["document_id"], r["chunk_index"]))


def test_bad_arguments(spark):
    docs = spark.createDataFrame([("u", "1", "x")], "user_id string, document_id string, extracted_text string")
    with pytest.raises(ValueError):
        chunking.chunk(docs, 50, 50)
    with pytest.raises(ValueError):
        chunking.chunk(docs, 0, -1)


def test_heading_is_repeated_on_each_piece(spark):
    text = "RESEARCH PUBLICATIONS\n" + "\n".join("- bullet %d with several plain words inside it" % i for i in range(20))
    got = rows(spark, text, size=200, overlap=20)
    assert len(got) > 2 and all(r["text"].startswith("RESEARCH PUBLICATIONS\n") for r in got)


def test_letters_share_the_overlap(spark):
    got = rows(spark, "a" * 100 + "b" * 100 + "c" * 100, size=100, overlap=20)
    for left, right in zip(got, got[1:]):
        assert left["text"][-20:] == right["text"][:20]


def test_headings_without_body_and_blank_texts(spark):
    assert rows(spark, "# Title\n## Sub\n", "   \n\n ", "") == []
    got = rows(spark, "# Title\n\nbody text\n# Next\nmore")
    assert [r["text"] for r in got] == ["# Title\nbody text", "# Next\nmore"]
    assert [r["chunk_index"] for r in got] == [0, 1]


def test_unusual_line_ends(spark):
    got = rows(spark, "# A\r\nbody one\x0c# B body two\x85# C\rbody three")
    assert [r["text"].split("\n")[0] for r in got] == ["# A", "# B", "# C"]


def test_noise_rule_is_the_same_before_and_after(spark):
    rng = random.Random(9)
    texts = [random_body(rng, 300) for _ in range(30)] + ["short", "\n\n".join("some words " * rng.randint(3, 90) for _ in range(12)), "# " + "h" * 95 + "\n" + random_body(rng, 200)]
    docs = spark.createDataFrame([("u", str(i), t) for i, t in enumerate(texts)], "user_id string, document_id string, extracted_text string")
    fused = chunking.chunk(docs, drop_noise=True)
    plain = chunking.keep_meaningful(chunking.chunk(docs).drop("raw_chunks"))
    key = lambda df: sorted((r["document_id"], r["chunk_index"], r["text"]) for r in df.collect())
    assert key(fused) == key(plain)
    clean = chunking.chunk(docs, stutter=False).count()
    assert clean < chunking.chunk(docs).count()


def test_no_shuffle(spark):
    docs = spark.createDataFrame([("u", "1", "x")], "user_id string, document_id string, extracted_text string")
    plan = chunking.chunk(docs, drop_noise=True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_rebuild_falls_back_to_extracted_text(spark):
    docs = spark.createDataFrame([("u", "1", "whole"), ("u", "2", "other"), ("u", "3", " ")], "user_id string, document_id string, extracted_text string")
    chunks = spark.createDataFrame([("u", "1", 1, "b"), ("u", "1", 0, "a")], "user_id string, document_id string, chunk_index int, text string")
    got = {r["document_id"]: r["text"] for r in chunking.rebuild_text(docs, chunks).collect()}
    assert got == {"1": "a\n\nb", "2": "other"}
