"""Chunking, index, retrieval and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreweave.functions import text as tx
from loreweave.functions.vectors import embed
from loreweave.operators import chunking, evals, index, retrieval
from loreweave.plans.registry import plan, table
from loreweave.session import cut_lineage


def long_key(*names):
    return [F.col(n).cast("long").alias(n) for n in names]


@plan("flagship_passages")
def flagship(t):
    chunks = chunking.with_chunk_id(chunking.chunk(t.docs, drop_noise=True))
    stored = cut_lineage(index.build_index(chunks))
    return retrieval.retrieve(t.questions, stored).select(
        "query_id", "rank", "document_id", "chunk_index", "chunk_id", "score"
    )


HEADING_SQL = r"""
length(s) > 0 AND length(s) <= 100 AND (regexp_matches(s, '^#{1,6}\s+\S') OR regexp_matches(s, '(?i)^-{3}\s*(page|slide)\s+\d+\s*-{3}\s*$')
 OR regexp_matches(s, '^\d+(\.\d+)*\.?\s+[A-Z][^\n]{0,79}$')
 OR (regexp_matches(s, '^[A-Z0-9][A-Z0-9\s\-&:,/()''.]{2,79}$') AND length(regexp_replace(s, '[^\p{L}]', '', 'g')) >= 3))
"""
# Lines of the numbered-page texts plus variants of each line that exercise every heading form.
C1_VARIANTS = r"""
SELECT user_id, document_id, pos, unnest([line, '# ' || line, pos || '.2 Section ' || line,
  '  --- SLIDE ' || pos || ' ---  ', upper(replace(line, 'ß', 'ss')), pos || ' lower']) AS line FROM (
  SELECT lang AS user_id, CAST(doc_id AS VARCHAR) AS document_id, unnest(range(1, len(string_split(text, E'\n')) + 1)) AS pos, unnest(string_split(text, E'\n')) AS line FROM documents)
"""


@plan("c1_heading_predicate", rf"""
SELECT user_id, document_id, CAST(pos AS BIGINT) AS pos, line, ({HEADING_SQL}) AS heading FROM (SELECT *, trim(line) AS s FROM ({C1_VARIANTS}))
""")
def c1(t):
    lines = t.raw("documents").select(
        F.col("lang").alias("user_id"), F.col("doc_id").cast("string").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("p", "l")
    )
    pos, line = (F.col("p") + 1).cast("string"), F.col("l")
    forms = F.array(
        line, F.concat(F.lit("# "), line), F.concat(pos, F.lit(".2 Section "), line),
        F.concat(F.lit("  --- SLIDE "), pos, F.lit(" ---  ")), F.upper(F.replace(line, F.lit('ß'), F.lit('ss'))), F.concat(pos, F.lit(" lower")),
    )
    rows = lines.select("user_id", "document_id", (F.col("p") + 1).cast("long").alias("pos"), F.explode(forms).alias("line"))
    return rows.withColumn("heading", tx.is_heading(F.col("line")))


# Every second document is one text of numbered pages; the page line opens a section.
MARKED = r"""
SELECT lang AS user_id, CAST(doc_id AS VARCHAR) AS document_id,
  array_to_string(list_transform(string_split(text, E'\n'), lambda x, i: '--- page ' || i || E' ---\n' || x), E'\n\n') AS extracted_text FROM documents
"""


table("sections", rf"""
WITH lines AS (
  SELECT user_id, document_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS line FROM (
    SELECT user_id, document_id, list_transform(string_split(extracted_text, E'\n'), lambda x, i: CASE WHEN i < len(string_split(extracted_text, E'\n')) THEN x || E'\n' ELSE x END) AS l FROM ({MARKED}))),
flag AS (SELECT *, ({HEADING_SQL}) AS head FROM (SELECT *, trim(line, E' \n') AS s FROM lines WHERE line <> '')),
run AS (SELECT *, sum(length(line)) OVER w AS e, sum(CAST(head AS INTEGER)) OVER w AS section FROM flag WINDOW w AS (PARTITION BY user_id, document_id ORDER BY pos))
SELECT user_id, document_id, CAST(section AS BIGINT) AS section, coalesce(max(CASE WHEN head THEN s END), '') AS heading,
  trim(coalesce(string_agg(CASE WHEN NOT head THEN line END, '' ORDER BY pos), ''), E'\n') AS content,
  CAST(min(e - length(line)) AS BIGINT) AS source_start, CAST(max(e) AS BIGINT) AS source_end
FROM run GROUP BY 1, 2, 3 HAVING coalesce(max(CASE WHEN head THEN s END), '') <> '' OR trim(coalesce(string_agg(CASE WHEN NOT head THEN line END, '' ORDER BY pos), ''), E' \n') <> ''
""")


@plan("c2_section_split", "SELECT * FROM sections", ("sections",))
def c2(t):
    return chunking.parse_sections(t.marked)


SPLIT_SQL = r"""
WITH RECURSIVE bodies AS ({bodies}),
w(k, n, s, e, j) AS (
  SELECT k, n, 0::BIGINT, -1::BIGINT, -1::BIGINT FROM bodies WHERE n > 0
  UNION ALL
  SELECT k, n, nxt, CASE WHEN nxt + size >= n THEN n WHEN c1 > 1 THEN nxt + c1 + 1 WHEN c2 > 1 THEN nxt + c2 WHEN c3 > 1 THEN nxt + c3 + 1 WHEN c4 > 1 THEN nxt + c4 ELSE nxt + size END, j + 1
  FROM (SELECT k, n, size, nxt, j,
      length(win) - 1 - nullif(instr(reverse(win), E'\n\n'), 0) + 1 AS c1, length(win) - nullif(instr(reverse(win), E'\n'), 0) + 1 AS c2,
      length(win) - 1 - nullif(instr(reverse(win), ' .'), 0) + 1 AS c3, length(win) - nullif(instr(reverse(win), ' '), 0) + 1 AS c4
    FROM (SELECT w.k, w.n, b.size, w.j, CASE WHEN w.j < 0 THEN 0 ELSE greatest(w.s + 1, w.e - {overlap}) END AS nxt,
        substring(b.body, CASE WHEN w.j < 0 THEN 0 ELSE greatest(w.s + 1, w.e - {overlap}) END + 1, b.size) AS win
      FROM w JOIN bodies b ON b.k = w.k WHERE w.e < w.n))
)
"""
BODY_SQL = r"""SELECT doc_id AS k, lang AS user_id, CAST(doc_id AS VARCHAR) AS document_id, trim(lower(text), E'\n') AS body,
  CAST(length(trim(lower(text), E'\n')) AS BIGINT) AS n, {size} AS size FROM documents"""


def split_sql(size, overlap):
    return SPLIT_SQL.format(bodies=BODY_SQL.format(size=size), overlap=overlap)


@plan("c3_window_split", split_sql(500, 50) + r"""
SELECT b.document_id, w.j AS chunk_index, w.s AS char_start, w.e AS char_end FROM w JOIN bodies b ON b.k = w.k WHERE w.j >= 0
""")
def c3(t):
    # Lower-cased texts have no heading lines, so each document is one anonymous section.
    plain = t.raw("documents").select(
        F.lit("x").alias("user_id"), F.col("doc_id").cast("string").alias("document_id"),
        F.btrim(F.lower("text"), F.lit("\n")).alias("extracted_text"),
    )
    rows = chunking.chunk(plain)
    return rows.select("document_id", F.col("chunk_index").cast("long").alias("chunk_index"), "char_start", "char_end")


# Bodies of all sections of the numbered-page texts, each with its own body budget.
PAGE_SQL = r"""
SELECT row_number() OVER () AS k, user_id, document_id, section, content AS body, CAST(length(content) AS BIGINT) AS n, CASE WHEN heading = '' THEN '' ELSE heading || E'\n' END AS prefix,
  source_start, greatest(500 - length(CASE WHEN heading = '' THEN '' ELSE heading || E'\n' END), 100) AS size FROM sections
"""
CHUNK_SQL = SPLIT_SQL.format(bodies=PAGE_SQL, overlap=50)


@plan("c4_chunk_text", CHUNK_SQL + r"""
SELECT user_id, document_id, CAST(row_number() OVER (PARTITION BY user_id, document_id ORDER BY section, j) - 1 AS BIGINT) AS chunk_index, md5(prefix || substring(body, w.s + 1, w.e - w.s)) AS text_md5,
  source_start + length(prefix) + w.s AS char_start, source_start + length(prefix) + w.e AS char_end
FROM w JOIN bodies b ON b.k = w.k WHERE w.j >= 0
""", ("sections",))
def c4(t):
    rows = chunking.chunk(t.marked)
    return rows.select("user_id", "document_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("text").alias("text_md5"), "char_start", "char_end")


@plan("p2_meaningful_chunks", CHUNK_SQL + r"""
SELECT document_id, chunk_index, md5(text) AS text_md5 FROM (
  SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY section, j) - 1 AS BIGINT) AS chunk_index, count(*) OVER (PARTITION BY document_id) AS raw,
    prefix || substring(body, w.s + 1, w.e - w.s) AS text FROM w JOIN bodies b ON b.k = w.k WHERE w.j >= 0)
WHERE raw <= 1 OR length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) >= 80
""", ("sections",))
def p2(t):
    rows = chunking.chunk(t.marked, drop_noise=True)
    return rows.select("document_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("text").alias("text_md5"))


@plan("c5_rebuild_text", r"""
SELECT d.user_id, d.document_id, md5(coalesce(j.joined, d.extracted_text)) AS text_md5, CAST(length(coalesce(j.joined, d.extracted_text)) AS BIGINT) AS chars
FROM docs d LEFT JOIN (SELECT user_id, document_id, string_agg(text, E'\n\n' ORDER BY chunk_index) AS joined FROM passages
  WHERE CAST(document_id AS BIGINT) % 5 <> 0 GROUP BY 1, 2) j USING (user_id, document_id)
WHERE trim(coalesce(j.joined, d.extracted_text, ''), E' \n\t') <> ''
""", ("docs", "passages"))
def c5(t):
    stored = t.passages.filter(F.col("document_id").cast("long") % 5 != 0)
    out = chunking.rebuild_text(t.docs, stored)
    return out.select("user_id", "document_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("chars"))


@plan("r1_embed_column", """
SELECT p.chunk_id, CAST(count(s.slot) AS BIGINT) AS slots, round(sum(s.v), 6) AS total, round(sum(s.v * s.slot), 6) AS moment
FROM passages p LEFT JOIN passage_slots s USING (chunk_id) GROUP BY 1
""", ("passages", "passage_slots"))
def r1(t):
    v = embed(t.passages, "text")
    slot = F.transform("dense", lambda x, i: F.when(x != 0, x * i).otherwise(0.0))
    plus = lambda a, x: a + x
    return v.select(
        "chunk_id", F.size(F.filter("dense", lambda x: x != 0)).cast("long").alias("slots"),
        F.when(F.exists("dense", lambda x: x != 0), F.round(F.aggregate("dense", F.lit(0.0), plus), 6)).alias("total"),
        F.when(F.exists("dense", lambda x: x != 0), F.round(F.aggregate(slot, F.lit(0.0), plus), 6)).alias("moment"),
    )


@plan("r2_sparse_passages", """
SELECT user_id, document_id, chunk_id, term, round(weight, 6) AS weight FROM passage_weights
""", ("passage_weights",))
def r2a(t):
    return index.postings(t.passages).withColumn("weight", F.round("weight", 6))


@plan("r2_sparse_queries", """
SELECT DISTINCT query_id, user_id, tok AS term, 1.0::DOUBLE AS weight FROM question_tokens
""", ("question_tokens",))
def r2b(t):
    return index.query_terms(t.questions)


@plan("r3_dense_topk", "SELECT query_id, chunk_id, score, CAST(branch_rank AS BIGINT) AS branch_rank FROM dense_top", ("dense_top",))
def r3(t):
    found = retrieval.dense_top_k(retrieval.encode_queries(t.questions), t.index)
    # Questions without any token have the zero vector; every chunk scores 0 and ids decide.
    return found.select("query_id", "chunk_id", "score", F.col("branch_rank").cast("long").alias("branch_rank"))


@plan("r3_vector_topk", """
SELECT query_id, vec_id, score, CAST(rk AS BIGINT) AS rank FROM (
  SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, CAST(v.vec_id AS VARCHAR)) AS rk
  FROM embeddings q JOIN embeddings v ON q.label % 3 = v.label % 3) WHERE rk <= 10
""")
def r3b(t):
    v = t.vectors
    pool = v.select(
        "user_id", F.col("vec_id").cast("string").alias("document_id"), F.col("vec_id").cast("string").alias("chunk_id"),
        F.lit(0).alias("chunk_index"), F.lit("").alias("text"), F.col("embedding").alias("dense"),
    )
    asked = v.select(F.col("vec_id").alias("query_id"), "user_id", F.col("embedding").alias("dense"))
    found = retrieval.dense_top_k(asked, pool, 10)
    return found.select("query_id", F.col("chunk_id").cast("long").alias("vec_id"), "score", F.col("branch_rank").cast("long").alias("rank"))


@plan("r4_sparse_topk", "SELECT query_id, chunk_id, score, CAST(branch_rank AS BIGINT) AS branch_rank FROM sparse_top", ("sparse_top",))
def r4(t):
    found = retrieval.sparse_top_k(retrieval.encode_queries(t.questions), t.index, inverted=t.inverted)
    return found.select("query_id", "chunk_id", "score", F.col("branch_rank").cast("long").alias("branch_rank"))


@plan("r5_rank_fusion", """
SELECT query_id, chunk_id, score, CAST(rank AS BIGINT) AS rank FROM candidates WHERE query_id IN (SELECT query_id FROM question_tokens)
""", ("candidates", "question_tokens"))
def r5(t):
    q = retrieval.encode_queries(t.questions).filter(F.size("sparse") > 0)
    both = retrieval.search(q, t.index, {"dense": retrieval.PER_BRANCH, "sparse": retrieval.PER_BRANCH}, inverted=t.inverted)
    return retrieval.reciprocal_rank_fusion(both, 40).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@plan("r6_fallback_ladder", "SELECT query_id, chunk_id, document_id, score, CAST(rank AS BIGINT) AS rank FROM candidates", ("candidates",))
def r6(t):
    found = retrieval.candidate_search(retrieval.encode_queries(t.questions), t.index, inverted=t.inverted)
    return found.select("query_id", "chunk_id", "document_id", "score", F.col("rank").cast("long").alias("rank"))


@plan("r7_rerank", "SELECT query_id, chunk_id, score, CAST(rank AS BIGINT) AS rank FROM reranked", ("reranked",))
def r7(t):
    pool = retrieval.candidate_search(retrieval.encode_queries(t.questions), t.index, inverted=t.inverted)
    return retrieval.rerank(pool, t.questions).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@plan("r8_diversify", """
SELECT query_id, document_id, chunk_index, CAST(new_rank AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN in_doc <= 2 THEN 0 ELSE 1 END, rank) AS new_rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY rank) AS in_doc FROM (
      SELECT o_custkey AS query_id, l_suppkey AS document_id, l_partkey AS chunk_index, row_number() OVER (PARTITION BY o_custkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rank
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey))) WHERE new_rank <= 5
""")
def r8(t):
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = t.raw("lineitem").join(t.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("query_id", F.col("o_custkey"))
    pool = rows.select("query_id", F.col("l_suppkey").alias("document_id"), F.col("l_partkey").alias("chunk_index"), F.row_number().over(w).alias("rank"))
    return retrieval.diversify(pool).withColumn("rank", F.col("rank").cast("long"))


@plan("r9_retrieve", "SELECT query_id, chunk_id, document_id, score, CAST(rank AS BIGINT) AS rank FROM diversified", ("diversified",))
def r9(t):
    return retrieval.retrieve(t.questions, t.index, inverted=t.inverted).select("query_id", "chunk_id", "document_id", "score", F.col("rank").cast("long").alias("rank"))


@plan("r10_retrieval_stats", """
SELECT query_id, CAST(n AS BIGINT) AS candidate_count, CAST(coalesce(r, 0) AS BIGINT) AS result_count, CAST(coalesce(d, 0) AS BIGINT) AS distinct_documents
FROM (SELECT query_id, count(*) AS n FROM candidates GROUP BY 1) LEFT JOIN (SELECT query_id, count(*) AS r, count(DISTINCT document_id) AS d FROM diversified GROUP BY 1) USING (query_id)
""", ("candidates", "diversified"))
def r10(t):
    pool = retrieval.candidate_search(retrieval.encode_queries(t.questions), t.index, inverted=t.inverted)
    return retrieval.retrieval_stats(pool, retrieval.diversify(retrieval.rerank(pool, t.questions)))


@plan("p1_tenant_document_filter", """
SELECT chunk_id, user_id, document_id FROM passages WHERE user_id = 'fr' OR (user_id = 'en' AND CAST(document_id AS BIGINT) % 7 = 1)
""", ("passages",))
def p1(t):
    d = t.docs.filter((F.col("user_id") == "en") & (F.col("doc_id") % 7 == 1))
    # One request per listed document for "en", one open request for "fr", none for the others.
    listed = d.select("user_id", F.array("document_id").alias("document_ids"))
    open_one = t.docs.filter("user_id = 'fr'").select("user_id", F.lit(None).cast("array<string>").alias("document_ids")).distinct()
    return retrieval.restrict(t.passages, listed.unionByName(open_one)).select("chunk_id", "user_id", "document_id")


SNIPPET_SQL = r"""
SELECT {keys}, CASE WHEN length(t) <= {width} THEN t WHEN hit IS NULL THEN rtrim(substring(t, 1, {width})) || '…' ELSE
  (CASE WHEN st > 0 THEN '…' ELSE '' END) || trim(substring(t, st + 1, en - st)) || (CASE WHEN en < length(t) THEN '…' ELSE '' END) END AS {out}
FROM (SELECT *, greatest(0, en - {width}) AS st FROM (
  SELECT *, least(length(t), greatest(0, (instr(low, hit) - 1) + length(hit) // 2 - {width} // 2) + {width}) AS en FROM (
    SELECT *, list_filter(cand, lambda x: contains(low, x))[1] AS hit FROM (
      SELECT *, lower(t) AS low, CASE WHEN len(good) > 0 THEN good ELSE toks END AS cand FROM (
        SELECT *, list_filter(toks, lambda x: length(x) >= 3 AND NOT list_contains(string_split('{stop}', ' '), x)) AS good FROM (
          SELECT *, trim(regexp_replace({text}, '\s+', ' ', 'g')) AS t,
            list_filter(list_transform(string_split_regex({query}, '\s+'), lambda x: trim(lower(x), '.,;:!?"''()[]')), lambda x: x <> '') AS toks
          FROM ({source})))))))
"""


def snippet_sql(source, text, query, keys, out, width):
    return SNIPPET_SQL.format(source=source, text=text, query=query, keys=keys, out=out, width=width, stop=" ".join(tx.STOPWORDS))


def _keywords(c):
    ws = F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}]+"), lambda w: F.length(w) > 0))
    ranked = F.array_sort(F.transform(ws, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return F.transform(F.slice(ranked, 1, 3), lambda x: x["w"])


KEYWORDS = r"""SELECT item_id AS query_id, list_transform(list_sort(list_transform(list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}]+'), lambda w: length(w) > 0)),
  lambda w: {'n': -length(w), 'w': w}))[1:3], lambda x: x.w) AS kw, text FROM benchmark"""


MET = rf"""SELECT DISTINCT w.doc_id, k.query_id FROM (SELECT doc_id, unnest(list_distinct(string_split_regex(lower(text), '[^\p{{L}}]+'))) AS word FROM documents) w
  JOIN (SELECT query_id, unnest(kw) AS word FROM ({KEYWORDS})) k USING (word)"""


def _met(t):
    """Documents and the questions one of whose keywords they hold as a word."""
    words = t.raw("documents").select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("word"))
    asked = t.raw("benchmark").select(F.col("item_id").alias("query_id"), F.explode(_keywords(F.col("text"))).alias("word"))
    return words.join(asked, "word").select("doc_id", "query_id").distinct()


@plan("f1_snippet", snippet_sql(
    f"SELECT m.doc_id, m.query_id AS item_id, d.text, q.text AS q FROM ({MET}) m JOIN documents d USING (doc_id) JOIN benchmark q ON q.item_id = m.query_id "
    "UNION ALL SELECT doc_id, -1, text, 'the, of (and) xyzq' FROM documents",
    "text", "q", "doc_id, item_id", "snippet", 280))
def f1(t):
    d = t.raw("documents").select("doc_id", "text")
    q = t.raw("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    rows = _met(t).join(d, "doc_id").join(q, "query_id").select("doc_id", F.col("query_id").alias("item_id"), "text", "q")
    rows = rows.unionByName(d.withColumn("item_id", F.lit(-1).cast("long")).withColumn("q", F.lit("the, of (and) xyzq")))
    return rows.select("doc_id", "item_id", tx.snippet(F.col("text"), F.col("q"), 280).alias("snippet"))


@plan("p5_chunk_citations", snippet_sql(
    "SELECT d.*, p.text, q.query FROM diversified d JOIN passages p USING (chunk_id) JOIN questions q USING (query_id)",
    "text", "query", "query_id, CAST(rank AS BIGINT) AS rank, chunk_id, document_id, CAST(chunk_index AS BIGINT) AS chunk_index, score", "text_preview", 280),
    ("diversified", "passages", "questions"))
def p5(t):
    found = retrieval.citations(retrieval.retrieve(t.questions, t.index, inverted=t.inverted), t.questions)
    return found.withColumn("rank", F.col("rank").cast("long")).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@plan("p6_score_bucket", """
SELECT query_id, chunk_id, CASE WHEN score >= 0.5 THEN 'strong' WHEN score >= 0.2 THEN 'moderate' ELSE 'weak' END AS bucket FROM sparse_top
""", ("sparse_top",))
def p6(t):
    found = retrieval.sparse_top_k(retrieval.encode_queries(t.questions), t.lexical_index)
    return found.select("query_id", "chunk_id", retrieval.score_bucket(F.col("score")).alias("bucket"))


# Evaluation: a document is expected for an item when it contains the item's text.
EXPECTED = """SELECT b.item_id AS query_id, CAST(d.doc_id AS VARCHAR) AS document_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)"""


def _expected(t):
    """Documents containing an item: prefiltered on a shared token run, then the whole text."""
    items = t.raw("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("item"))
    run = lambda w, i: F.array_join(F.slice(w, i, 4), " ")
    keyed = items.withColumn("run", run(F.split("item", " "), F.lit(2)))
    runs = lambda c: tx.let(
        F.split(c, " "),
        lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 3, F.lit(1))), lambda i: run(w, i))),
    )
    whole = t.raw("documents").select(F.col("doc_id").cast("string").alias("document_id"), "text")
    marks = whole.select("document_id", F.explode(runs(F.col("text"))).alias("run"))
    met = marks.join(keyed, "run").select("query_id", "item", "document_id").distinct()
    return met.join(whole, "document_id").filter(F.contains("text", F.col("item"))).select("query_id", "document_id").distinct()


@plan("e1_recall_at_k", f"""
SELECT q.query_id, round(CASE WHEN e.n IS NULL THEN 1.0 ELSE coalesce(h.n, 0) / e.n END, 6) AS recall FROM questions q
LEFT JOIN (SELECT query_id, CAST(count(DISTINCT document_id) AS DOUBLE) AS n FROM ({EXPECTED}) GROUP BY 1) e USING (query_id)
LEFT JOIN (SELECT query_id, count(DISTINCT x.document_id) AS n FROM ({EXPECTED}) x JOIN diversified d USING (query_id, document_id) GROUP BY 1) h USING (query_id)
""", ("questions", "diversified"))
def e1(t):
    found = retrieval.retrieve(t.questions, t.index, inverted=t.inverted).groupBy("query_id").agg(F.collect_set("document_id").alias("got"))
    want = _expected(t).groupBy("query_id").agg(F.collect_set("document_id").alias("want"))
    none = F.array().cast("array<string>")
    rows = t.questions.join(found, "query_id", "left").join(want, "query_id", "left")
    return rows.select("query_id", F.round(evals.recall_at_k(F.coalesce("want", none), F.coalesce("got", none)), 6).alias("recall"))


@plan("e2_keyword_coverage", f"""
SELECT doc_id, query_id, round(CASE WHEN len(kw) = 0 THEN 1.0 ELSE len(list_filter(kw, lambda k: contains(lower(d.text), k))) / CAST(len(kw) AS DOUBLE) END, 6) AS coverage
FROM ({MET}) m JOIN documents d USING (doc_id) JOIN ({KEYWORDS}) k USING (query_id)
""")
def e2(t):
    items = t.raw("benchmark").select(F.col("item_id").alias("query_id"), _keywords(F.col("text")).alias("kw"))
    rows = _met(t).join(t.raw("documents").select("doc_id", "text"), "doc_id").join(items, "query_id")
    return rows.select("doc_id", "query_id", F.round(evals.keyword_coverage(F.col("kw"), F.col("text")), 6).alias("coverage"))


@plan("e3_mean_or_null", """
SELECT event_type, day, round(avg(CASE WHEN day % 5 <> 0 THEN value END), 6) AS mean_value FROM ev GROUP BY 1, 2
""", ("ev",))
def e3(t):
    kept = F.when(F.col("day") % 5 != 0, F.col("value"))
    return t.events.groupBy("event_type", F.col("day").cast("long").alias("day")).agg(F.round(evals.mean_or_null(kept), 6).alias("mean_value"))


E4 = f"""
SELECT q.query_id, CASE WHEN e.n IS NULL THEN 1.0 ELSE coalesce(h.n, 0) / e.n END AS recall,
  CASE WHEN len(k.kw) = 0 THEN 1.0 ELSE len(list_filter(k.kw, lambda x: contains(lower(a.answer), x))) / CAST(len(k.kw) AS DOUBLE) END AS coverage,
  CASE WHEN q.query_id % 4 <> 0 THEN (q.query_id % 11) / 10.0 END AS groundedness, CASE WHEN q.query_id % 4 = 0 THEN 'skipped' ELSE 'partial' END AS verdict,
  substring(a.answer, 1, 240) AS answer_preview, coalesce(g.ids, '') AS retrieved
FROM questions q JOIN ({KEYWORDS}) k USING (query_id) JOIN (SELECT query_id, string_agg(p.text, ' ' ORDER BY d.rank) AS answer, string_agg(d.document_id, ',' ORDER BY d.rank) AS ids
  FROM diversified d JOIN passages p USING (chunk_id) GROUP BY 1) a USING (query_id)
LEFT JOIN (SELECT query_id, string_agg(document_id, ',' ORDER BY rank) AS ids FROM diversified GROUP BY 1) g USING (query_id)
LEFT JOIN (SELECT query_id, CAST(count(DISTINCT document_id) AS DOUBLE) AS n FROM ({EXPECTED}) GROUP BY 1) e USING (query_id)
LEFT JOIN (SELECT query_id, count(DISTINCT x.document_id) AS n FROM ({EXPECTED}) x JOIN diversified d USING (query_id, document_id) GROUP BY 1) h USING (query_id)
"""


def _scored(t):
    from loreweave.operators.ranking import join_text

    found = retrieval.retrieve(t.questions, t.index, inverted=t.inverted)
    answers = found.groupBy("query_id").agg(join_text(F.col("text"), [F.col("rank")], " ").alias("answer"))
    i = F.col("query_id")
    responses = answers.select(
        "query_id", "answer", F.when(i % 4 == 0, "skipped").otherwise("partial").alias("verdict"),
        ((i % 11) / 10.0).alias("groundedness_score"), F.lit("chat").alias("intent"),
    )
    wanted = _expected(t).groupBy("query_id").agg(F.collect_list(F.concat(F.lit("doc_"), "document_id", F.lit(".txt"))).alias("f"))
    none = F.array().cast("array<string>")
    items = t.raw("benchmark").select(F.col("item_id").alias("query_id"), "text")
    questions = items.join(wanted, "query_id", "left").select(
        "query_id", F.col("text").alias("question"), F.coalesce("f", none).alias("expected_filenames"), _keywords(F.col("text")).alias("expected_keywords")
    )
    return evals.score_questions(questions, t.docs.select("filename", "document_id"), responses, found)


@plan("e4_score_questions", f"SELECT query_id, round(recall, 6) AS recall, round(coverage, 6) AS coverage, groundedness, verdict, answer_preview, retrieved FROM ({E4})",
      ("questions", "diversified", "passages"))
def e4(t):
    return _scored(t).select(
        "query_id", F.round("recall", 6).alias("recall"), F.round("coverage", 6).alias("coverage"), "groundedness", "verdict", "answer_preview",
        F.array_join("retrieved_doc_ids", ",").alias("retrieved"),
    )


@plan("e5_summarise", f"""
SELECT CAST(count(*) AS BIGINT) AS n_questions, 5::BIGINT AS top_k, round(coalesce(avg(recall), 0.0), 6) AS avg_recall_at_k, round(coalesce(avg(coverage), 0.0), 6) AS avg_keyword_coverage,
  round(avg(groundedness), 6) AS avg_groundedness, CAST(count(groundedness) AS BIGINT) AS n_grounded FROM ({E4})
""", ("questions", "diversified", "passages"))
def e5(t):
    s = evals.summarise(_scored(t))
    return s.select(
        "n_questions", F.col("top_k").cast("long").alias("top_k"), *[F.round(c, 6).alias(c) for c in ("avg_recall_at_k", "avg_keyword_coverage", "avg_groundedness")], "n_grounded"
    )
