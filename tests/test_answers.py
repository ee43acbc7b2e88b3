import json

import pytest
from pyspark.sql import functions as F

from loreweave.functions import text as tx
from loreweave.functions.jsonrec import recover_json
from loreweave.operators import answers as an
from loreweave.operators import chats as ch
from loreweave.operators import evals as ev
from loreweave.operators import extraction as ex
from loreweave.sources import intake as ik

CASES = [
    ('{"a": 1}', '{"a":1}'),
    ('  {"a": 1}\n', '{"a":1}'),
    ('[{"a": 1}]', None),
    ('"text"', None),
    ("", None),
    ("no json", None),
    ('5 {"a": 2}', '{"a":2}'),
    ('Sure! ```json\n{"a": 3}\n``` done {"b": 1}', '{"a":3}'),
    ('```\n{"a": {"b": "}"}}\n```', '{"a":{"b":"}"}}'),
    ("```json\n{broken}\n```", None),
    ('pre {"a": "x } \\" {"} post {"b": 2}', '{"a":"x } \\" {"}'),
    ('{"a": 1} trailing', '{"a":1}'),
    ('{"a": 1} ```json {"b": 2} ```', '{"b":2}'),
    ('{"a": 1}] x', '{"a":1}'),
    ("{unbalanced", None),
    (None, None),
]


def test_recover_json(spark):
    df = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(CASES)], "i int, raw string")
    got = {r["i"]: r["o"] for r in recover_json(df, "raw").select("i", F.to_json("obj").alias("o")).collect()}
    for i, (raw, want) in enumerate(CASES):
        assert (got[i] and json.loads(got[i])) == (want and json.loads(want)), raw


def parse(spark, raw, fn):
    df = spark.createDataFrame([(raw,)], "raw string")
    return recover_json(df, "raw").select(fn(F.col("obj")).alias("x")).first()["x"]


def test_entities_drop_only_bad_items(spark):
    raw = json.dumps({"entities": [{"name": "A"}, "x", None, {"name": ""}, {"name": "B", "type": None}, {"name": "C" * 201}, {"name": "D", "type": "Person", "description": "d"}, {"name": 5}]})
    got = parse(spark, raw, ex.parse_entities)
    assert [(e["pos"], e["name"], e["type"], e["description"]) for e in got] == [(0, "A", "Concept", ""), (6, "D", "Person", "d")]
    assert parse(spark, '{"entities": {"name": "A"}}', ex.parse_entities) == []


def test_claims(spark):
    raw = json.dumps({"claims": [{"text": "a", "support": "SUPPORTED", "quote": "q", "citation": "[1]"}, {"text": "b", "support": "nope"}, {"text": " ", "support": "supported"}, {"text": "c", "support": "uncertain", "evidence": "old"}, {"text": "d", "support": "unsupported", "quote": "q2"}]})
    got = parse(spark, raw, an.parse_claims)
    assert [(c["text"], c["support"], c["evidence"]) for c in got] == [("a", "supported", "q [1]"), ("c", "uncertain", "old"), ("d", "unsupported", "q2")]


def test_summary_caps_before_dedup(spark):
    raw = json.dumps({"tldr": " x" + "y" * 700, "key_points": ["A", "a", 3, " "] + [f"p{i}" for i in range(10)], "topics": "no list"})
    got = parse(spark, raw, an.parse_summary)
    assert got["tldr"] == "x" + "y" * 599 + "…"
    assert got["key_points"] == ["A"] + [f"p{i}" for i in range(6)] and got["topics"] == []


def test_verdict_boundaries(spark):
    rows = [(0.85, True), (0.8499, True), (0.5, True), (0.49, True), (0.0, False)]
    df = spark.createDataFrame(rows, "s double, c boolean")
    got = [r[0] for r in df.select(an.verdict(F.col("s"), F.col("c"))).collect()]
    assert got == ["verified", "partial", "partial", "unsupported", "verified"]


def test_strict_gate_equal_score_passes(spark):
    rows = [(True, "strict", "partial", 0.8, "x"), (True, "strict", "partial", 0.79, "x"), (True, "regular", "partial", 0.1, "x"), (True, "strict", "skipped", 0.0, "x"), (False, "strict", "partial", 0.0, "x")]
    df = spark.createDataFrame(rows, "use_rag boolean, rag_mode string, verdict string, groundedness_score double, answer string")
    assert [r["refused"] for r in an.strict_gate(df).collect()] == [False, True, False, False, False]


@pytest.mark.parametrize(
    ("text", "query", "width", "want"),
    [
        ("short text", "anything", 280, "short text"),
        ("a  b\n\tc", "x", 280, "a b c"),
        ("word " * 100, "zzz", 20, "word word word word…"),
        ("x" * 50 + " needle " + "y" * 50, "the needle?", 20, "…xxxxxx needle yyyyyy…"),
    ],
)
def test_snippet(spark, text, query, width, want):
    df = spark.createDataFrame([(text, query)], "t string, q string")
    assert df.select(tx.snippet(F.col("t"), F.col("q"), width)).first()[0] == want


def test_placeholder_titles(spark):
    cases = {"  hi   there ": "hi there", "": "New chat", "x" * 61: "x" * 60 + "…", "word " * 20: "word " * 11 + "word…", "ab " + "c" * 80: "ab " + "c" * 57 + "…"}
    df = spark.createDataFrame([(k,) for k in cases], "q string")
    assert {r["q"]: r["t"] for r in df.select("q", tx.placeholder_title(F.col("q")).alias("t")).collect()} == cases


def test_metrics(spark):
    df = spark.createDataFrame([(["a", "b", "b"], ["b", "c"], ["Kafka", "", "x"], "kafka topic"), ([], ["z"], [], "")], "e array<string>, r array<string>, k array<string>, a string")
    got = df.select(ev.recall_at_k(F.col("e"), F.col("r")), ev.keyword_coverage(F.col("k"), F.col("a"))).collect()
    assert [tuple(r) for r in got] == [(0.5, 0.5), (1.0, 1.0)]
    empty = ev.summarise(spark.createDataFrame([], "recall double, coverage double, groundedness double")).first()
    assert (empty["n_questions"], empty["avg_recall_at_k"], empty["avg_groundedness"]) == (0, 0.0, None)


def test_history_budget_drops_oldest(spark):
    rows = [(1, i, "user", "x" * 2500) for i in range(12)] + [(2, 4, "user", "hi")]
    got = ch.load_history(spark.createDataFrame(rows, "chat_id long, seq long, role string, content string"))
    assert sorted((r["chat_id"], r["seq"], len(r["content"])) for r in got.collect()) == [(1, 9, 2001), (1, 10, 2001), (1, 11, 2001), (2, 4, 2)]


def test_pairing_any_block_size(spark):
    roles = ["user", "user", "assistant", "assistant", "user", "assistant", "system", "user"]
    df = spark.createDataFrame([(1, i * 7, r, f"m{i}") for i, r in enumerate(roles)], "chat_id long, seq long, role string, content string")
    for block in (1, 5, 1000):
        assert sorted((r["question"], r["response"]) for r in ch.pair_turns(df, block).collect()) == [("m1", "m2"), ("m4", "m5")]


def test_search_treats_metacharacters_literally(spark):
    chats = spark.createDataFrame([("u", 1, "100% done", None, None, None), ("u", 2, "100 done", None, None, None), ("v", 3, "100% theirs", None, None, None)], "user_id string, chat_id long, title string, summary string, created_at timestamp, updated_at timestamp")
    none = spark.createDataFrame([], "chat_id long, seq long, role string, content string")
    asked = spark.createDataFrame([(1, "u", "0%"), (2, "u", "_")], "query_id long, user_id string, q string")
    assert [(r["query_id"], r["chat_id"]) for r in ch.search_chats(asked, chats, none).collect()] == [(1, 1)]


def test_intake_order_of_rules(spark):
    rows = [("application/zip", 0), ("text/plain; charset=x", 0), ("TEXT/PLAIN", 200 * 1024 * 1024), ("image/png", 5), (None, 5)]
    got = [r["reject_reason"] for r in ik.intake(spark.createDataFrame(rows, "content_type string, size_bytes long")).collect()]
    assert got == ["unsupported type", "empty file", "too large", None, "unsupported type"]


def test_decode_replaces_bad_bytes(spark):
    df = spark.createDataFrame([(bytearray(b"ok \xff\xc3\xa9"), "text/plain"), (bytearray(b"x"), "image/png")], "content binary, content_type string")
    got = ik.decode_text(df).collect()
    assert got[0]["extracted_text"] == "ok �é" and got[1]["extracted_text"] is None and "image/png" in got[1]["error_message"]


def test_frame_plan(spark):
    df = spark.createDataFrame([(25.0, 250), (25.0, 2500), (30.0, 5400), (25.0, 25 * 301), (0.0, 10)], "fps double, frames long")
    got = [(r["accepted"], len(r["frame_indices"]), list(r["frame_indices"][:3])) for r in ik.frame_plan(df).collect()]
    assert got == [(True, 10, [0, 25, 50]), (True, 30, [0, 50, 150]), (True, 30, [0, 150, 300]), (False, 0, []), (True, 0, [])]


def test_summary_sql_upper_cases_as_spark_does(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    texts = ["Einü ßbe der erä.", "ﬁn Straße STRASSE ŉ ΐ", "plain words Plain", "a\nb ß", "ǰ ǅ ÿ µ"]
    rows = [(4 * i, x, "de", "web", len(x)) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("v11_summary_parse", "v12_summary_store"):
        got = entry.queries()[name](spark, str(tmp_path))
        want = con.execute(entry.oracle_sql()[name]).fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want)
