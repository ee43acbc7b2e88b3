"""Answer assembly, verification, summaries and routing queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from loreweave.functions.jsonrec import recover_json
from loreweave.functions.text import normalize_brackets
from loreweave.operators import answers as an
from loreweave.operators import retrieval
from loreweave.operators.chats import history_column, load_history
from loreweave.plans.extraction_plans import wrap
from loreweave.plans.graph_plans import _answer_facts
from loreweave.plans.registry import plan, table
from loreweave.sources.intake import clean_web_results, recent_summaries


@plan("p7_intent_routing", """
SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 'skip_retrieval' WHEN event_type = 'click' THEN 'fetch_summaries' WHEN event_type = 'view' THEN 'retrieve_for_graph' ELSE 'retrieve_for_chat' END AS branch FROM events
""")
def p7(t):
    intent = F.when(F.col("event_type") == "click", "summarize").when(F.col("event_type") == "view", "explain_graph").when(F.col("event_type") == "error", "chat")
    return t.raw("events").select("event_id", an.route(F.col("user_id") % 5 != 0, intent).alias("branch"))


@plan("p8_intent_parse", """
SELECT event_id, CASE WHEN event_id % 4 <> 3 AND event_type = 'click' THEN 'summarize' WHEN event_id % 4 <> 3 AND event_type = 'view' THEN 'explain_graph' ELSE 'chat' END AS intent FROM events
""")
def p8(t):
    e = F.col("event_type")
    said = F.when(e == "click", '"summarize"').when(e == "view", '"explain_graph"').when(e == "error", "7").otherwise('"other"')
    rows = t.raw("events").select("event_id", wrap(F.format_string('{"intent": %s}', said), F.col("event_id") % 4).alias("raw"))
    return recover_json(rows, "raw").select("event_id", an.parse_intent(F.col("obj")).alias("intent"))


@plan("p9_prompt_choice", """
SELECT event_id, CASE WHEN u AND d THEN (CASE WHEN m = 'strict' THEN 'strict' ELSE 'regular' END) WHEN w THEN 'web_only' WHEN u AND m = 'strict' THEN 'no_context' ELSE 'pure_knowledge' END AS prompt FROM (
  SELECT event_id, user_id % 2 = 0 AS u, user_id % 3 = 0 AS d, event_id % 5 = 0 AS w, CASE WHEN event_id % 7 < 3 THEN 'strict' ELSE 'regular' END AS m FROM events)
""")
def p9(t):
    u, i = F.col("user_id"), F.col("event_id")
    mode = F.when(i % 7 < 3, "strict").otherwise("regular")
    return t.raw("events").select("event_id", an.prompt_id(u % 2 == 0, mode, u % 3 == 0, i % 5 == 0).alias("prompt"))


@plan("p13_bracket_normalisation", r"""
SELECT conv_id, turn, regexp_replace(replace(replace(text, ' la ', '【 1】'), 'the', '（W2 】'), '[【（]\s*(W?\d+)\s*[】）]', '[\1]', 'g') AS text FROM conversations
""")
def p13(t):
    marked = F.replace(F.replace(F.col("text"), F.lit(" la "), F.lit("【 1】")), F.lit("the"), F.lit("（W2 】"))
    return t.raw("conversations").select("conv_id", "turn", normalize_brackets(marked).alias("text"))


def scored(t):
    return an.groundedness(t.answers, t.claims, ["answer_id"])


def verified(t):
    return an.verify(scored(t))


@plan("v8_groundedness", """
SELECT answer_id, round(score, 6) AS score, CAST(total_claims AS BIGINT) AS total_claims, CAST(supported_claims AS BIGINT) AS supported_claims, array_to_string(unsupported_claims, '|') AS unsupported FROM scored
""", ("scored",))
def v8(t):
    return scored(t).select("answer_id", F.round("score", 6).alias("score"), "total_claims", "supported_claims", F.array_join("unsupported_claims", "|").alias("unsupported"))


@plan("v9_verdict", """
SELECT answer_id, skip_reason, verdict, groundedness_score, CAST(total_claims AS BIGINT) AS total_claims, CAST(supported_claims AS BIGINT) AS supported_claims, array_to_string(unsupported_claims, '|') AS unsupported FROM verified
""", ("verified",))
def v9(t):
    return verified(t).select("answer_id", "skip_reason", "verdict", "groundedness_score", "total_claims", "supported_claims", F.array_join("unsupported_claims", "|").alias("unsupported"))


@plan("p14_strict_gate", f"""
SELECT answer_id, use_rag AND rag_mode = 'strict' AND verdict <> 'skipped' AND groundedness_score < 0.8 AS refused,
  CASE WHEN use_rag AND rag_mode = 'strict' AND verdict <> 'skipped' AND groundedness_score < 0.8 THEN '{an.REFUSAL.replace("'", "''")}' ELSE answer END AS answer FROM verified
""", ("verified",))
def p14(t):
    return an.strict_gate(verified(t)).select("answer_id", "refused", "answer")


# ---- prompt blocks ----
CTX = """SELECT d.query_id, string_agg('[' || d.rank || '] (doc=' || d.document_id || ', chunk=' || d.chunk_index || ', score=' || printf('%.3f', round_even(d.score, 3)) || E')\\n' || trim(p.text, E' \\n'), E'\\n\\n' ORDER BY d.rank) AS context
FROM diversified d JOIN passages p USING (chunk_id) GROUP BY 1""".replace("\\\\n", "\\n")
table("context_block", CTX, ("diversified", "passages"))
WEB_ITEM = r"""SELECT query_id, string_agg('[W' || rank || '] ' || title || E'\n' || url || E'\n' || CASE WHEN length(content) > 1000 THEN substring(content, 1, 1000) || '…' ELSE content END, E'\n\n' ORDER BY rank) AS web FROM web_clean GROUP BY 1"""
table("web_block", WEB_ITEM, ("web_clean",))
table("summary_rows", """
SELECT user_id, document_id, filename, summary_tldr AS tldr, summary_key_points AS key_points, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, document_id) AS rank FROM docs WHERE summary_tldr IS NOT NULL) WHERE rank <= 5
""", ("docs",))
table("summaries_block", r"""
SELECT user_id AS query_id, string_agg('- ' || filename || CASE WHEN trim(tldr, E' \n') <> '' THEN E'\n    ' || trim(tldr, E' \n') ELSE '' END || E'\n' ||
  array_to_string(list_transform(key_points[1:5], lambda p: '    • ' || p), E'\n'), E'\n' ORDER BY rank) AS summaries FROM summary_rows GROUP BY 1
""", ("summary_rows",))
# Direction follows hop parity in the fixture: one hop out, two hops "in" (drawn as a chain).
table("fact_lines", r"""
SELECT user_id AS query_id, name, seed, coalesce(max(fd), '') AS descr, string_agg(CASE WHEN distance > 1 THEN '    ↝ ' || chain || ' ' || other || '   (' || distance || '-hop)' ELSE '    → ' || chain || ' ' || other END, E'\n' ORDER BY rank) AS lines,
  string_agg(CASE WHEN rank <= 6 THEN '    → ' || chain || ' ' || other END, E'\n' ORDER BY rank) AS short_lines
FROM (SELECT f.*, nullif(trim(e.description, E' \n'), '') AS fd FROM facts f JOIN entities e ON e.user_id = f.user_id AND e.name_lower = f.seed) GROUP BY 1, 2, 3
""", ("facts", "entities"))
table("graph_block", r"""
SELECT query_id, string_agg('- ' || name || ' (Concept)' || CASE WHEN descr <> '' THEN ': ' || descr ELSE '' END || coalesce(E'\n' || lines, ''), E'\n' ORDER BY seed) AS graph FROM fact_lines GROUP BY 1
""", ("fact_lines",))


def found(t):
    return retrieval.retrieve(t.questions, t.index, inverted=t.inverted)


@plan("v1_context_block", "SELECT query_id, context FROM context_block", ("context_block",))
def v1(t):
    return an.context_block(found(t))


@plan("v2_graph_block", "SELECT query_id, graph FROM graph_block", ("graph_block",))
def v2(t):
    return an.graph_block(_answer_facts(t))


@plan("v3_web_block", "SELECT query_id, web FROM web_block", ("web_block",))
def v3(t):
    return an.web_block(clean_web_results(t.web))


def summaries(t):
    return recent_summaries(t.docs).withColumn("query_id", F.col("user_id"))


@plan("p4_recent_summaries", """
SELECT user_id, document_id, filename, tldr, array_to_string(key_points, '|') AS points, CAST(rank AS BIGINT) AS rank FROM summary_rows
""", ("summary_rows",))
def p4(t):
    return recent_summaries(t.docs).select("user_id", "document_id", "filename", "tldr", F.array_join("key_points", "|").alias("points"), F.col("rank").cast("long").alias("rank"))


@plan("v4_summaries_block", "SELECT query_id, summaries FROM summaries_block", ("summaries_block",))
def v4(t):
    return an.summaries_block(summaries(t))


# Questions get passages by id, web results by id, summaries by their user; every third keeps no context.
def _messages(t):
    q = t.questions
    context = an.context_block(found(t)).filter("query_id % 3 <> 0")
    web = an.web_block(clean_web_results(t.web)).filter("query_id % 2 = 0")
    block = an.summaries_block(summaries(t)).withColumnRenamed("query_id", "user_id")
    own = q.filter("query_id % 4 = 1").join(block, "user_id").select("query_id", "summaries")
    graph = an.graph_block(_answer_facts(t)).withColumn("query_id", F.substring("query_id", 2, 5).cast("long"))
    return an.user_message(q, context, graph, own, web)


MESSAGE = r"""
SELECT q.query_id, CASE WHEN c.context IS NULL AND w.web IS NULL AND s.summaries IS NULL AND g.graph IS NULL THEN q.query ELSE
  concat_ws(E'\n\n', E'Context passages:\n\n' || c.context, E'Knowledge-graph facts:\n' || g.graph, E'Document summaries:\n' || s.summaries, E'Web results:\n\n' || w.web) || E'\n\nQuestion: ' || q.query END AS message
FROM questions q LEFT JOIN context_block c ON c.query_id = q.query_id AND q.query_id % 3 <> 0 LEFT JOIN web_block w ON w.query_id = q.query_id AND q.query_id % 2 = 0
LEFT JOIN summaries_block s ON s.query_id = q.user_id AND q.query_id % 4 = 1 LEFT JOIN graph_block g ON CAST(substring(g.query_id, 2) AS BIGINT) = q.query_id
"""


@plan("v5_user_message", MESSAGE, ("questions", "context_block", "web_block", "summaries_block", "graph_block"))
def v5(t):
    return _messages(t)


table("history", """
SELECT chat_id, seq, role, content FROM (
  SELECT *, sum(length(content)) OVER (PARTITION BY chat_id ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) AS total FROM (
    SELECT chat_id, seq, role, CASE WHEN length(content) > 2000 THEN substring(content, 1, 2000) || '…' ELSE content END AS content,
      row_number() OVER (PARTITION BY chat_id ORDER BY seq DESC) AS n FROM messages) WHERE n <= 10) WHERE total <= 8000
""", ("messages",))


@plan("v6_message_list", """
SELECT c.chat_id, 'system=strict' || coalesce('|' || h.past, '') || '|user=' || c.title AS messages FROM chats c
LEFT JOIN (SELECT chat_id, string_agg(role || '=' || content, '|' ORDER BY seq) AS past FROM history GROUP BY 1) h USING (chat_id)
""", ("chats", "history"))
def v6(t):
    rows = t.chats.join(history_column(load_history(t.messages)), "chat_id", "left")
    listed = rows.withColumn("m", an.message_list(F.lit("strict"), F.col("history"), F.col("title")))
    return listed.select("chat_id", F.array_join(F.transform("m", lambda m: F.concat_ws("=", m["role"], m["content"])), "|").alias("messages"))


@plan("v7_claim_parse", """
SELECT answer_id, CAST(pos AS BIGINT) AS pos, text, support, evidence FROM (
  SELECT answer_id, 0 AS pos, 'claim ' || answer_id AS text, 'supported' AS support, 'q1 [1]' AS evidence FROM answers WHERE d % 4 <> 3
  UNION ALL SELECT answer_id, 2, 'b', 'unsupported', 'old' FROM answers WHERE d % 4 <> 3
  UNION ALL SELECT answer_id, 4, '12', 'uncertain', '[W1]' FROM answers WHERE d % 4 <> 3)
""".replace("FROM answers", "FROM (SELECT answer_id, CAST(split_part(answer_id, '-', 2) AS INTEGER) AS d FROM answers)"), ("answers",))
def v7(t):
    body = F.format_string(
        '{"claims":[{"text":" claim %s ","support":"Supported","quote":"q1","citation":"[1]","evidence":"x"},{"text":"a","support":"maybe"},'
        '{"text":"b","support":" unsupported","evidence":" old "},"loose",{"text":12,"support":"uncertain","citation":"[W1]"},{"text":"  ","support":"supported"}]}',
        "answer_id",
    )
    day = F.split("answer_id", "-")[1].cast("int")
    rows = recover_json(t.answers.select("answer_id", wrap(body, day % 4).alias("raw")), "raw")
    return rows.select("answer_id", F.inline(an.parse_claims(F.col("obj")))).withColumn("pos", F.col("pos").cast("long"))


VERIFIER = r"""
SELECT q.query_id, E'Answer to verify:\n' || CASE WHEN length(q.answer) > 4000 THEN substring(q.answer, 1, 4000) || '…' ELSE q.answer END ||
  E'\n\nContext passages:\n' || coalesce(CASE WHEN length(c.x) > 8000 THEN substring(c.x, 1, 8000) || '…' ELSE c.x END, '(no passages retrieved)') ||
  E'\n\nKnowledge-graph facts:\n' || coalesce(CASE WHEN length(g.x) > 4000 THEN substring(g.x, 1, 4000) || '…' ELSE g.x END, '(no graph facts)') ||
  E'\n\nWeb results:\n' || coalesce(CASE WHEN length(w.x) > 4000 THEN substring(w.x, 1, 4000) || '…' ELSE w.x END, '(no web results)') AS message
FROM (SELECT doc_id AS query_id, text AS answer FROM documents) q
LEFT JOIN (SELECT query_id, string_agg('[' || d.rank || '] ' || trim(p.text, E' \n'), E'\n\n' ORDER BY d.rank) AS x FROM diversified d JOIN passages p USING (chunk_id) GROUP BY 1) c USING (query_id)
LEFT JOIN (SELECT CAST(substring(query_id, 2) AS BIGINT) AS query_id, string_agg('- ' || name || ' (Concept)' || CASE WHEN descr <> '' THEN ': ' || descr ELSE '' END || coalesce(E'\n' || short_lines, ''), E'\n' ORDER BY seed) AS x FROM fact_lines GROUP BY 1) g USING (query_id)
LEFT JOIN (SELECT query_id, string_agg('[W' || rank || '] ' || title || ' — ' || url || ': ' || content, E'\n\n' ORDER BY rank) AS x FROM web_clean GROUP BY 1) w USING (query_id)
"""


@plan("v10_verifier_context", VERIFIER, ("diversified", "passages", "fact_lines", "web_clean"))
def v10(t):
    answers = t.raw("documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("answer"))
    # Later facts lie beyond the part of the prompt that is for facts, so they are not looked up.
    facts = _answer_facts(t, an.FACTS_TOLD).withColumn("query_id", F.substring("query_id", 2, 5).cast("long"))
    return an.verifier_context(answers, found(t), facts, clean_web_results(t.web))


# Summary replies: the whole text, its words with repeats and blanks, and the text twice as a topic.
def summary_replies(t):
    d = t.raw("documents")
    words = F.split(F.regexp_replace("text", r'["\\\n]', " "), " ")
    raw = F.to_json(F.struct(
        F.regexp_replace("text", r'["\\\n]', " ").alias("tldr"),
        F.concat(words, F.transform(words, F.upper)).alias("key_points"), F.array_repeat(F.regexp_replace("text", r'["\\\n]', " "), 2).alias("topics"),
    ))
    return d.select(F.col("lang").alias("user_id"), F.col("doc_id").cast("string").alias("document_id"), wrap(raw, F.col("doc_id") % 4).alias("raw"))


# Upper case as Spark has it: some characters become two or three (ß, ligatures), which DuckDB's upper() leaves as they are.
_LONGER = [chr(i) for i in range(0x110000) if len(chr(i).upper()) > 1]


def _full_upper(column: str) -> str:
    spelled = reduce(lambda sql, c: f"replace({sql}, '{c}', '{c.upper()}')", _LONGER, column)
    return f"upper(CASE WHEN regexp_matches({column}, '[{''.join(_LONGER)}]') THEN {spelled} ELSE {column} END)"


table("summary_parsed", r"""
SELECT user_id, document_id, ok, CASE WHEN ok THEN CASE WHEN length(tl) > 600 THEN rtrim(substring(tl, 1, 600)) || '…' ELSE tl END ELSE '' END AS tldr,
  CASE WHEN ok THEN list_filter(kp, lambda x, i: list_position(list_transform(kp, lambda y: lower(y)), lower(x)) = i) ELSE [] END AS key_points,
  CASE WHEN ok AND top <> '' THEN [CASE WHEN length(top) > 80 THEN rtrim(substring(top, 1, 80)) || '…' ELSE top END] ELSE [] END AS topics
FROM (SELECT *, (list_filter(list_transform(list_concat(w, string_split(u, ' ')), lambda x: trim(x)), lambda x: x <> ''))[1:8] AS kp FROM (
  SELECT lang AS user_id, CAST(doc_id AS VARCHAR) AS document_id, doc_id % 4 <> 3 AS ok, trim(c) AS tl, string_split(c, ' ') AS w, """ + _full_upper("c") + r""" AS u, trim(c) AS top
  FROM (SELECT *, regexp_replace(text, '["\\\n]', ' ', 'g') AS c FROM documents)))
""")


@plan("v11_summary_parse", """
SELECT document_id, tldr, array_to_string(key_points, '|') AS key_points, array_to_string(topics, '|') AS topics FROM summary_parsed
""", ("summary_parsed",))
def v11(t):
    s = recover_json(summary_replies(t), "raw").select("document_id", an.parse_summary(F.col("obj")).alias("s"))
    return s.select("document_id", "s.tldr", F.array_join("s.key_points", "|").alias("key_points"), F.array_join("s.topics", "|").alias("topics"))


@plan("v12_summary_input", "SELECT doc_id, md5(substring(text, 1, 14000)) AS input_md5, CAST(length(substring(text, 1, 14000)) AS BIGINT) AS chars FROM documents")
def v12a(t):
    cut = an.summary_input(F.col("text"))
    return t.raw("documents").select("doc_id", F.md5(cut).alias("input_md5"), F.length(cut).cast("long").alias("chars"))


@plan("v12_summary_store", """
SELECT d.document_id, CASE WHEN p.ok AND NOT (p.tldr = '' AND len(p.key_points) = 0 AND len(p.topics) = 0) THEN nullif(p.tldr, '') ELSE d.summary_tldr END AS tldr,
  array_to_string(CASE WHEN p.ok AND NOT (p.tldr = '' AND len(p.key_points) = 0 AND len(p.topics) = 0) THEN CASE WHEN len(p.key_points) > 0 THEN p.key_points END ELSE d.summary_key_points END, '|') AS points
FROM docs d LEFT JOIN summary_parsed p USING (document_id)
""", ("docs", "summary_parsed"))
def v12b(t):
    parsed = recover_json(summary_replies(t), "raw").select("user_id", "document_id", an.parse_summary(F.col("obj")).alias("summary"))
    out = an.store_summaries(t.docs, parsed)
    return out.select("document_id", F.col("summary_tldr").alias("tldr"), F.array_join("summary_key_points", "|").alias("points"))
