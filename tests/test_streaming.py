import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from loreweave.operators import operations as op
from loreweave.operators.graph_ingest import compact, merge_log, read_log
from loreweave.streaming import feeds, ingest
from loreweave.streaming.lockout import WINDOW, advance, lockout, lockout_stream

T0 = dt.datetime(2024, 1, 1)
UPLOAD = ingest.UPLOAD


def drain(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def attempts(seed=1, n=600):
    rng = random.Random(seed)
    out, at = [], dict.fromkeys("abc", 0)
    for _ in range(n):
        who = rng.choice("abbbc")
        at[who] += rng.choice([1, 20, 60, 200, 899, 900, 2000])
        out.append((who, T0 + dt.timedelta(seconds=at[who]), rng.random() < 0.15))
    return out


def model(rows):
    state, out = {}, set()
    for email, ts, ok in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        s = state.setdefault(email, [0, None])
        if s[0] and (ts - s[1]).total_seconds() >= WINDOW:
            s[0] = 0
        if s[0] >= 5:
            out.add((email, ts, ok, "locked", 5, int(WINDOW - (ts - s[1]).total_seconds())))
        elif ok:
            s[0] = 0
            out.add((email, ts, ok, "ok", 0, 0))
        else:
            s[1] = s[1] if s[0] else ts
            s[0] += 1
            out.add((email, ts, ok, "failed", s[0], 0))
    return out


def test_lockout_matches_model(spark):
    rows = attempts()
    got = lockout(spark.createDataFrame(rows, "email string, ts timestamp, success boolean"))
    assert {tuple(r) for r in got.collect()} == model(rows)


def test_lockout_step():
    us = 1_000_000
    count, opened = 0, 0
    for i in range(5):
        count, opened, what, _ = advance(count, opened, i * us, False)
    assert (count, opened, what) == (5, 0, "failed")
    assert advance(5, 0, 10 * us, True)[2:] == ("locked", 890)
    assert advance(5, 0, 900 * us, True) == (0, 0, "ok", 0)


def test_lockout_stream_equals_batch(spark, tmp_path):
    rows = sorted(attempts(2, 200), key=lambda r: r[1])
    src = tmp_path / "in"
    for i in range(4):
        part = rows[i * 50 : (i + 1) * 50]
        spark.createDataFrame(part, "email string, ts timestamp, success boolean").coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("email string, ts timestamp, success boolean").option("maxFilesPerTrigger", 1).parquet(str(src))
    got = drain(lockout_stream(stream, "30 days"), "locks", "append", tmp_path)
    assert {tuple(r) for r in got.collect()} == model(rows)


def observations():
    rng = random.Random(4)
    return [(rng.choice("xyz"), "f", rng.choice(["uploaded", "processing", "processed", "failed"]), rng.choice([None, "boom"]), T0 + dt.timedelta(hours=i)) for i in range(120)]


def test_status_feed_stream_equals_batch(spark, tmp_path):
    schema = "document_id string, filename string, status string, error_message string, ts timestamp"
    rows = observations()
    for i in range(3):
        spark.createDataFrame(rows[i * 40 : (i + 1) * 40], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    columns = ["document_id", "filename", "status", "error_message", "ts", "before", "message"]
    got = drain(feeds.status_feed_stream(stream), "feed", "append", tmp_path).select(columns).collect()
    want = op.status_feed(spark.createDataFrame(rows, schema)).select(columns).collect()
    assert want and sorted(map(str, got)) == sorted(map(str, want))


def test_counter_and_histogram_streams_equal_batch(spark, tmp_path):
    rows = [(T0 + dt.timedelta(seconds=i), "get" if i % 3 else "post", i / 100) for i in range(300)]
    schema = "ts timestamp, method string, seconds double"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    total = drain(feeds.counters_stream(stream(), ["method"]), "hits", "complete", tmp_path)
    got = {(r["method"], r["n"]) for r in total.groupBy("method").agg(F.sum("total").alias("n")).collect()}
    assert got == {("get", 200), ("post", 100)}
    hist = drain(feeds.histogram_stream(stream(), ["method"], "seconds", op.HTTP_BUCKETS), "hist", "complete", tmp_path)
    batch = op.histogram(spark.createDataFrame(rows, schema), ["method"], "seconds", op.HTTP_BUCKETS)
    sums = lambda df: {(r["method"], r["le"]): r["n"] for r in df.groupBy("method", "le").agg(F.sum("observations").alias("n")).collect()}
    assert sums(hist) == sums(batch)


def test_rate_breach_stream(spark, tmp_path):
    rows = [("1.1.1.1", "login", T0 + dt.timedelta(seconds=i)) for i in range(12)] + [("2.2.2.2", "login", T0)]
    schema = "ip string, route string, ts timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = drain(feeds.rate_breaches_stream(stream, op.limits_table(spark)), "breaches", "complete", tmp_path)
    assert {(r["ip"], r["requests"], r["breached"]) for r in got.collect()} == {("1.1.1.1", 12, True), ("2.2.2.2", 1, False)}


TEXT = "# Team\n" + "Alice works with Bob on the search engine project every single day of the week. " * 12


def extractor(chunks):
    one = json.dumps({"entities": [{"name": "Alice", "type": "Person"}, {"name": "The Bob.", "type": "Person"}]})
    two = json.dumps({"relationships": [{"source": "alice", "target": "The Bob.", "relation": "Works for"}]})
    return chunks.select("*", F.lit(one).alias("pass1_raw"), F.lit(False).alias("pass1_failed"), F.lit(two).alias("pass2_raw"), F.lit(False).alias("pass2_failed"))


def uploads(spark, rows):
    return spark.createDataFrame([(u, d, f, m, bytearray(c)) for u, d, f, m, c in rows], UPLOAD)


def test_ingest_stream(spark, tmp_path):
    src, root = tmp_path / "in", str(tmp_path / "store")
    uploads(spark, [("u", "1", "a/..b.txt", "text/plain", TEXT.encode()), ("u", "2", "x.zip", "application/zip", b"z"), ("u", "3", "e.txt", "text/plain", b"")]).coalesce(1).write.parquet(str(src))
    stream = lambda: spark.readStream.schema(UPLOAD).parquet(str(src))
    ingest.start_ingest(stream(), root, str(tmp_path / "cp"), extractor).awaitTermination()
    docs = {r["document_id"]: r for r in ingest.read_documents(spark, root).collect()}
    assert {k: r["status"] for k, r in docs.items()} == {"1": "processed", "2": "failed", "3": "failed"}
    assert docs["1"]["filename"] == "b.txt" and docs["3"]["error_message"] == "empty file"
    index = ingest.read_index(spark, root)
    first = index.count()
    assert first > 1 and {r["document_id"] for r in index.select("document_id").distinct().collect()} == {"1"}
    graph = merge_log(read_log(spark, f"{root}/graph"))
    assert {r["name_lower"] for r in graph.entities.collect()} == {"alice", "bob"}
    assert [tuple(r)[1:4] for r in graph.edges.collect()] == [("alice", "bob", "affiliated with")]

    # A second upload of the same document replaces its chunks; a new document joins the same entities.
    uploads(spark, [("u", "1", "b.txt", "text/plain", TEXT[:200].encode()), ("u", "4", "c.txt", "text/plain", TEXT.encode())]).coalesce(1).write.mode("append").parquet(str(src))
    ingest.start_ingest(stream(), root, str(tmp_path / "cp"), extractor).awaitTermination()
    counts = {r["document_id"]: r["count"] for r in ingest.read_index(spark, root).groupBy("document_id").count().collect()}
    assert counts == {"1": 1, "4": first}
    graph = merge_log(read_log(spark, f"{root}/graph"))
    assert graph.entities.count() == 2 and graph.entity_docs.count() == 4
    compact(spark, f"{root}/graph", str(tmp_path / "folded"))
    assert merge_log(read_log(spark, str(tmp_path / "folded"))).edge_docs.count() == graph.edge_docs.count()


def test_replayed_and_dead_batches(spark, tmp_path):
    root = str(tmp_path / "store")
    good = uploads(spark, [("u", "1", "a.txt", "text/plain", TEXT.encode())])
    ingest.ingest_batch(good, 0, root)
    once = ingest.read_index(spark, root).count()
    ingest.ingest_batch(good, 0, root)
    assert ingest.read_index(spark, root).count() == once and ingest.read_documents(spark, root).count() == 1

    def broken(_):
        raise RuntimeError("embedder is down")

    with pytest.raises(RuntimeError):
        ingest.ingest_batch(uploads(spark, [("u", "9", "z.txt", "text/plain", TEXT.encode())]), 1, root, embedder=broken)
    assert ingest.read_index(spark, root).filter("document_id = '9'").count() == 0
    assert ingest.read_documents(spark, root).filter("document_id = '9'").count() == 0


def test_unverified_attempt_neither_counts_nor_clears():
    count, opened = 0, 0
    for at, ok in enumerate([False, None, False, None]):
        count, opened, what, _ = advance(count, opened, at, ok)
        assert what == ("unverified" if ok is None else "failed")
    assert (count, opened) == (2, 0)


def test_failed_graph_step_keeps_documents(spark, tmp_path):
    def broken(chunks):
        raise ValueError("model is down")

    root = str(tmp_path / "lake")
    batch = uploads(spark, [("u", "1", "a.txt", "text/plain", TEXT.encode())])
    ingest.ingest_batch(batch, 0, root, broken)
    assert [r["status"] for r in ingest.read_documents(spark, root).collect()] == ["processed"]
    due = ingest.graph_retries(spark, root).collect()
    assert [(r["attempts"], r["entities"], r["retry"]) for r in due] == [(1, 0, True)]
    assert "model is down" in spark.read.parquet(f"{root}/graph_runs").first()["error"]
    index = ingest.read_index(spark, root)
    assert {"char_start", "char_end"} <= set(index.columns)
