"""The engine tables of :mod:`tables` as SQL table expressions."""

from loreweave.plans.registry import table

table("docs", """
SELECT lang AS user_id, CAST(doc_id AS VARCHAR) AS document_id, doc_id,
  'My Files/' || source || '..doc #' || doc_id || '!.txt' AS raw_filename, 'doc_' || doc_id || '.txt' AS filename,
  CASE doc_id % 6 WHEN 0 THEN 'text/markdown' WHEN 1 THEN 'TEXT/Plain; charset=utf-8' WHEN 2 THEN 'application/zip'
    WHEN 3 THEN 'application/pdf' WHEN 4 THEN ' image/PNG ' ELSE 'text/plain' END AS content_type,
  CASE WHEN doc_id % 11 = 0 THEN 0 ELSE n_chars * (CASE WHEN doc_id % 13 = 0 THEN 100000 ELSE 1 END) END AS size_bytes,
  text AS extracted_text,
  CASE doc_id % 10 WHEN 0 THEN 'uploaded' WHEN 1 THEN 'processing' WHEN 2 THEN 'failed' ELSE 'processed' END AS status,
  CASE WHEN doc_id % 10 = 2 AND doc_id % 4 = 2 THEN 'engine failed' END AS error_message,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS created_at,
  CASE WHEN doc_id % 3 = 0 THEN substring(text, 1, 60) END AS summary_tldr,
  CASE WHEN doc_id % 3 = 0 THEN string_split(substring(text, 1, 90), ' ') END AS summary_key_points,
  CASE WHEN doc_id % 3 = 0 THEN [lang, source] END AS summary_topics
FROM documents
""")

table("passages", """
SELECT lang AS user_id, CAST(doc_id AS VARCHAR) AS document_id, doc_id || '-' || i AS chunk_id, CAST(i AS INTEGER) AS chunk_index,
  substring(text, CAST(i * 400 + 1 AS BIGINT), 400) AS text
FROM documents, unnest(range(0, greatest(1, CAST(ceil(length(text) / 400.0) AS BIGINT)))) AS t(i)
""")

table("passage_tokens", r"""
SELECT user_id, document_id, chunk_id, chunk_index, tok FROM (
  SELECT user_id, document_id, chunk_id, chunk_index, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS tok FROM passages)
WHERE tok <> ''
""", ("passages",))

table("questions", """
SELECT item_id AS query_id,
  CASE WHEN of % 5 = 3 THEN 'fr' WHEN of % 5 = 4 THEN 'de' WHEN of % 7 = 2 THEN 'es' ELSE 'en' END AS user_id,
  query
FROM (SELECT item_id, item_id AS of, text AS query FROM benchmark UNION ALL SELECT item_id + 1000000, item_id, '?!' FROM benchmark WHERE item_id % 10 = 9)
""")

table("question_tokens", r"""
SELECT query_id, user_id, tok FROM (
  SELECT query_id, user_id, unnest(string_split_regex(lower(query), '[^\p{L}\p{N}]+')) AS tok FROM questions) WHERE tok <> ''
""", ("questions",))

# Hashed-token vectors in long form: only non-zero slots, already normalised.
table("passage_slots", """
SELECT chunk_id, slot, c / sqrt(sum(c * c) OVER (PARTITION BY chunk_id)) AS v FROM (
  SELECT chunk_id, CAST(('0x' || substr(md5(tok), 1, 8)) AS BIGINT) % 64 AS slot, CAST(count(*) AS DOUBLE) AS c
  FROM passage_tokens GROUP BY 1, 2)
""", ("passage_tokens",))

table("question_slots", """
SELECT query_id, slot, c / sqrt(sum(c * c) OVER (PARTITION BY query_id)) AS v FROM (
  SELECT query_id, CAST(('0x' || substr(md5(tok), 1, 8)) AS BIGINT) % 64 AS slot, CAST(count(*) AS DOUBLE) AS c
  FROM question_tokens GROUP BY 1, 2)
""", ("question_tokens",))

table("dense_scores", """
SELECT q.query_id, p.chunk_id, p.document_id, p.chunk_index, round(coalesce(s.d, 0.0), 6) AS score
FROM questions q JOIN passages p USING (user_id)
LEFT JOIN (SELECT a.query_id, b.chunk_id, sum(a.v * b.v) AS d FROM question_slots a JOIN passage_slots b USING (slot)
  JOIN passages pp USING (chunk_id) JOIN questions qq ON qq.query_id = a.query_id AND qq.user_id = pp.user_id GROUP BY 1, 2) s
  ON s.query_id = q.query_id AND s.chunk_id = p.chunk_id
""", ("questions", "passages", "question_slots", "passage_slots"))

table("dense_top", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS branch_rank FROM dense_scores)
WHERE branch_rank <= 30
""", ("dense_scores",))

table("passage_weights", """
SELECT user_id, document_id, chunk_id, chunk_index, tok AS term,
  c * 2.2 / (c + (1.2 * (1.0 - 0.75) + (1.2 * 0.75 / 256.0) * sum(c) OVER (PARTITION BY chunk_id))) AS weight FROM (
  SELECT user_id, document_id, chunk_id, chunk_index, tok, CAST(count(*) AS DOUBLE) AS c FROM passage_tokens GROUP BY ALL)
""", ("passage_tokens",))

table("sparse_top", """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS branch_rank FROM (
    SELECT q.query_id, w.chunk_id, w.document_id, w.chunk_index, round(sum(w.weight), 6) AS score
    FROM (SELECT DISTINCT query_id, user_id, tok FROM question_tokens) q JOIN passage_weights w ON w.user_id = q.user_id AND w.term = q.tok
    GROUP BY 1, 2, 3, 4)) WHERE branch_rank <= 30
""", ("question_tokens", "passage_weights"))

# Questions with terms fuse both branches; the others keep 40 dense candidates.
table("candidates", """
SELECT query_id, chunk_id, document_id, chunk_index, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT query_id, chunk_id, min(document_id) AS document_id, min(chunk_index) AS chunk_index, round(sum(1.0 / (60 + branch_rank)), 9) AS score
    FROM (SELECT query_id, chunk_id, document_id, chunk_index, branch_rank FROM dense_top WHERE query_id IN (SELECT query_id FROM question_tokens)
          UNION ALL SELECT query_id, chunk_id, document_id, chunk_index, branch_rank FROM sparse_top)
    GROUP BY query_id, chunk_id)
  UNION ALL
  SELECT query_id, chunk_id, document_id, chunk_index, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM dense_scores WHERE query_id NOT IN (SELECT query_id FROM question_tokens))
WHERE rank <= 40
""", ("dense_top", "sparse_top", "dense_scores", "question_tokens"))

table("reranked", """
SELECT query_id, chunk_id, document_id, chunk_index, CASE WHEN n > 1 THEN s ELSE score END AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n > 1 THEN s END DESC NULLS LAST, rank) AS rank
FROM (SELECT c.*, count(*) OVER (PARTITION BY c.query_id) AS n,
        round(coalesce(o.common, 0) / greatest(coalesce(a.asked, 0), 1), 6) AS s
      FROM candidates c
      LEFT JOIN (SELECT query_id, CAST(count(DISTINCT tok) AS DOUBLE) AS asked FROM question_tokens GROUP BY 1) a USING (query_id)
      LEFT JOIN (SELECT q.query_id, p.chunk_id, CAST(count(*) AS DOUBLE) AS common
                 FROM (SELECT DISTINCT query_id, tok FROM question_tokens) q JOIN candidates cc USING (query_id)
                 JOIN (SELECT DISTINCT chunk_id, tok FROM passage_tokens) p ON p.chunk_id = cc.chunk_id AND p.tok = q.tok GROUP BY 1, 2) o
        ON o.query_id = c.query_id AND o.chunk_id = c.chunk_id)
""", ("candidates", "question_tokens", "passage_tokens"))

table("diversified", """
SELECT query_id, chunk_id, document_id, chunk_index, score, new_rank AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n <= 5 OR in_doc <= 2 THEN 0 ELSE 1 END, rank) AS new_rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY rank) AS in_doc, count(*) OVER (PARTITION BY query_id) AS n FROM reranked))
WHERE new_rank <= 5
""", ("reranked",))

table("order_lines", """
SELECT 'u' || r.r_regionkey AS user_id, o.o_orderkey AS seq, CAST(o.o_orderkey AS VARCHAR) AS document_id, o.o_orderdate AS seen_at,
  c.c_name, c.c_mktsegment, cn.n_name AS c_nation, r.r_name, p.p_name, p.p_brand, s.s_name, sn.n_name AS s_nation, l.l_linenumber
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation cn ON c.c_nationkey = cn.n_nationkey JOIN region r ON cn.n_regionkey = r.r_regionkey
JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation sn ON s.s_nationkey = sn.n_nationkey
""")

table("observations", """
SELECT user_id, document_id, seq, seen_at, lower(name) AS name_lower, min(name) AS name, min(type) AS type, min(description) AS description FROM (
  SELECT user_id, document_id, seq, seen_at, c_name AS name, 'Organization' AS type, c_mktsegment AS description FROM order_lines
  UNION ALL SELECT user_id, document_id, seq, seen_at, p_name, 'Product', p_brand FROM order_lines
  UNION ALL SELECT user_id, document_id, seq, seen_at, s_name, 'Organization', NULL FROM order_lines
  UNION ALL SELECT user_id, document_id, seq, seen_at, c_nation, 'Location', NULL FROM order_lines
  UNION ALL SELECT user_id, document_id, seq, seen_at, s_nation, 'Location', NULL FROM order_lines
  UNION ALL SELECT user_id, document_id, seq, seen_at, r_name, 'Location', NULL FROM order_lines)
GROUP BY 1, 2, 3, 4, 5
""", ("order_lines",))

table("entities", """
SELECT user_id, name_lower, arg_min(name, seq) AS name, arg_min(type, seq) AS type,
  arg_min(description, seq) FILTER (WHERE description IS NOT NULL) AS description,
  arg_min(seen_at, seq) AS created_at, max(seen_at) AS last_seen_at
FROM observations GROUP BY 1, 2
""", ("observations",))

table("entity_docs", "SELECT DISTINCT user_id, name_lower, document_id FROM observations", ("observations",))

table("edge_rows", """
SELECT user_id, lower(source) AS source_lower, lower(target) AS target_lower, relation, document_id, seen_at AS created_at FROM (
  SELECT user_id, document_id, seen_at, c_name AS source, c_nation AS target, 'located in' AS relation FROM order_lines
  UNION ALL SELECT user_id, document_id, seen_at, c_name, p_name, 'uses' FROM order_lines
  UNION ALL SELECT user_id, document_id, seen_at, s_name, s_nation, 'located in' FROM order_lines
  UNION ALL SELECT user_id, document_id, seen_at, c_nation, r_name, 'located in' FROM order_lines)
""", ("order_lines",))

table("edges", """
SELECT user_id, source_lower, target_lower, relation, min(created_at) AS created_at FROM edge_rows GROUP BY 1, 2, 3, 4
""", ("edge_rows",))

table("edge_docs", "SELECT DISTINCT user_id, source_lower, target_lower, relation, document_id FROM edge_rows", ("edge_rows",))

table("sym", """
SELECT user_id, source_lower AS node, target_lower AS other_lower, relation, 'out' AS direction FROM edges
UNION ALL SELECT user_id, target_lower, source_lower, relation, 'in' FROM edges
""", ("edges",))

table("mentions", """
SELECT DISTINCT CAST(l_orderkey % 3 AS VARCHAR) AS user_id, CAST(l_orderkey AS VARCHAR) AS document_id, lower(p_brand) AS entity,
  l_linenumber AS chunk_index FROM lineitem JOIN part ON l_partkey = p_partkey
""")

table("chats", r"""
SELECT CAST(conv_id % 10 AS VARCHAR) AS user_id, conv_id AS chat_id,
  CASE WHEN length(t) <= 60 THEN CASE WHEN t = '' THEN 'New chat' ELSE t END
    WHEN contains(substring(t, 1, 60), ' ') AND 60 - instr(reverse(substring(t, 1, 60)), ' ') > 30
      THEN rtrim(substring(t, 1, 60 - instr(reverse(substring(t, 1, 60)), ' '))) || '…'
    ELSE rtrim(substring(t, 1, 60)) || '…' END AS title,
  CASE WHEN conv_id % 4 = 1 THEN last END AS summary,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(conv_id) AS created_at, TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id) AS updated_at
FROM (SELECT conv_id, arg_max(text, turn) AS last,
        trim(regexp_replace(coalesce(arg_min(text, turn) FILTER (WHERE role = 'user'), ''), '\s+', ' ', 'g')) AS t
      FROM conversations GROUP BY 1
      UNION ALL SELECT DISTINCT conv_id + 1000000, NULL, '' FROM conversations WHERE conv_id % 9 = 8)
""")

table("messages", """
SELECT conv_id AS chat_id, turn AS seq, role, text AS content,
  CASE WHEN role = 'assistant' THEN [CAST(turn AS VARCHAR)] END AS citations
FROM conversations
""")

table("web", r"""
SELECT page_id % 40 AS query_id, page_id AS pos, CASE WHEN page_id % 17 = 5 THEN '  ' ELSE ' ' || url END AS url,
  CASE WHEN page_id % 13 <> 3 THEN regexp_extract(html, '(?s)<title>(.*?)</title>', 1) END AS title,
  regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g') AS content,
  CASE WHEN page_id % 11 <> 4 THEN round(1.0 / (1 + page_id), 6) END AS score
FROM pages
""")

table("web_clean", r"""
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rank, title, url, content, score FROM (
  SELECT query_id, pos, trim(regexp_replace(coalesce(title, ''), '^\s+|\s+$', '', 'g')) AS title, trim(url) AS url,
    regexp_replace(coalesce(content, ''), '^\s+|\s+$', '', 'g') AS content, coalesce(score, 0.0) AS score
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS p FROM web) WHERE p <= 5)
WHERE url <> ''
""", ("web",))

table("ev", "SELECT *, day(ts) AS day, user_id || '-' || day(ts) AS answer_id FROM events")

table("answers", """
SELECT answer_id, CASE WHEN u % 7 <= 1 THEN 'strict' ELSE 'regular' END AS rag_mode, u % 11 <> 0 AS use_rag, d % 9 <> 0 AS has_context,
  CASE WHEN (u + d) % 23 = 0 THEN ' ' ELSE 'answer ' || answer_id END AS answer,
  CASE WHEN (u * d) % 29 = 1 THEN 'upstream 503' END AS error
FROM (SELECT answer_id, max(user_id) AS u, max(day) AS d FROM ev GROUP BY 1)
""", ("ev",))

table("claims", """
SELECT answer_id, event_id AS pos, event_type || ' ' || CAST(CAST(value AS DECIMAL(20, 2)) AS VARCHAR) AS text,
  CASE WHEN event_type IN ('purchase', 'view') THEN 'supported' WHEN event_type = 'click' THEN 'uncertain' ELSE 'unsupported' END AS support
FROM ev
""", ("ev",))

table("scored", """
SELECT a.*, coalesce(c.score, 1.0) AS score, coalesce(c.total, 0) AS total_claims, coalesce(c.sup, 0) AS supported_claims,
  coalesce(c.uns, []) AS unsupported_claims
FROM answers a LEFT JOIN (
  SELECT answer_id, avg(CASE support WHEN 'supported' THEN 1.0 WHEN 'uncertain' THEN 0.5 ELSE 0.0 END) AS score, count(*) AS total,
    sum(CASE WHEN support = 'supported' THEN 1 ELSE 0 END) AS sup,
    list(text ORDER BY pos) FILTER (WHERE support = 'unsupported') AS uns
  FROM claims GROUP BY 1) c USING (answer_id)
""", ("answers", "claims"))

table("verified", """
SELECT answer_id, rag_mode, use_rag, answer, skip_reason,
  CASE WHEN skip_reason <> '' THEN 'skipped' WHEN total_claims = 0 OR score >= 0.85 THEN 'verified' WHEN score >= 0.5 THEN 'partial' ELSE 'unsupported' END AS verdict,
  CASE WHEN skip_reason <> '' THEN 0.0 ELSE round_even(score, 3) END AS groundedness_score,
  CASE WHEN skip_reason <> '' THEN 0 ELSE total_claims END AS total_claims,
  CASE WHEN skip_reason <> '' THEN 0 ELSE supported_claims END AS supported_claims,
  CASE WHEN skip_reason <> '' THEN [] ELSE unsupported_claims END AS unsupported_claims
FROM (SELECT *, CASE WHEN trim(answer) = '' THEN 'empty answer' WHEN NOT has_context THEN 'no context to verify against'
        WHEN error IS NOT NULL THEN error ELSE '' END AS skip_reason FROM scored)
""", ("scored",))
