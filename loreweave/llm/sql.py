"""DuckDB twins of the queries that SQL can say."""

from loreweave.llm import secret_links as s

_CRC = """crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
    lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab)"""


def _crc32(text: str) -> str:
    """crc32 of a non-empty ASCII text; ``crc`` has to be in reach."""
    codes = f"list_transform(string_split({text}, ''), lambda c: ord(c)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda a, b: xor(tab[(xor(a, b) & 255) + 1], a >> 8)), 4294967295)"


def _coded(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR)::VARCHAR || ':' || ({value})::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_coded(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree(name: str, start: str) -> str:
    """Nodes of trees and, for each node of a run, the joined siblings before and after it."""
    run = "PARTITION BY key, level, pos // 8 ORDER BY pos ROWS BETWEEN"
    return f"""{name} AS (
  {start}
  UNION ALL
  SELECT key, any_value(level) + 1, pos // 8, max((n + 7) // 8), sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY key, pos // 8),
{name}_runs AS (
  SELECT key, level, pos, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {name} WHERE n > 1)"""


MERKLE = f"""
WITH RECURSIVE {_CRC},
leaves AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS key, {_leaf("text")} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {_crc32("doc_id::VARCHAR")} % 3 = 0
      THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf("text")} END AS other
  FROM documents, crc),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n FROM leaves),
{_tree("low", "SELECT key, 0 AS level, pos, n, leaf AS h FROM placed")},
tops AS (SELECT key, h AS subroot, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
{_tree("high", "SELECT '' AS key, 0 AS level, pos, n, subroot AS h FROM tops")},
steps AS (
  SELECT key, level, pos, before, after FROM low_runs
  UNION ALL SELECT t.key, 1000 + h.level, h.pos, before, after FROM tops t JOIN high_runs h ON h.level >= 0 AND h.pos = t.pos // (8 ** h.level)::BIGINT),
folds AS (
  SELECT p.key, p.doc_id, p.leaf, p.pos AS first, p.pos, 0 AS level, p.other AS h, '' AS proof FROM placed p
  UNION ALL
  SELECT f.key, f.doc_id, f.leaf, f.first, CASE WHEN s.level < 1000 THEN f.pos // 8 ELSE s.pos // 8 END, s.level + 1,
    sha256(s.before || f.h || s.after), f.proof || s.before || s.after
  FROM folds f JOIN steps s ON s.key = f.key
    AND ((s.level = f.level AND s.level < 1000 AND s.pos = f.pos) OR (s.level = 1000 AND f.level < 1000 AND f.pos = 0 AND NOT EXISTS (
      SELECT 1 FROM low_runs l WHERE l.key = f.key AND l.level = f.level)) OR (s.level = f.level AND s.level > 1000))),
ends AS (SELECT *, row_number() OVER (PARTITION BY key, first ORDER BY level DESC) AS k FROM folds)
SELECT e.doc_id, e.leaf, t.subroot, r.h AS root, sha256(e.proof) AS proof_sha256, e.h AS folded_root, e.h = r.h AS verified
FROM ends e JOIN tops t ON t.key = e.key, (SELECT h FROM high WHERE n = 1) r WHERE e.k = 1
"""

def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secret_links() -> str:
    """All matches with their positions, then every pair of a candidate and a part. DuckDB folds the letters U+017F and U+212A too, Spark only ASCII."""
    families = {"assign": s.ASSIGN.replace("([", "(?:["), "access": s.ACCESS, "hex": s.HEX, "weak": s.WEAK_PATTERN}
    matches = " UNION ALL ".join(
        f"SELECT uid, '{f}' AS family, unnest(regexp_extract_all(text, {_q(p)})) AS m, unnest(string_split_regex(text, {_q(p)})[:-2]) AS gap, "
        f"generate_subscripts(regexp_extract_all(text, {_q(p)}), 1) AS i FROM docs WHERE regexp_matches(text, {_q(p)})"
        for f, p in families.items()
    )
    weak = " ".join(
        f"WHEN regexp_matches(m, {_q(f'^(?:{p})')}) THEN "
        + ("CASE WHEN regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') THEN 'opaque' END" if k == "opaque" else f"'{k}'")
        for k, p in s.WEAK.items()
    )
    in_ = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
    part = "CASE " + " ".join(f"WHEN kind = '{k}' THEN '{v}'" for k, v in s.PART.items()) + " END"
    needs = " OR ".join(f"(a.kind = '{k}' AND b.part IN {in_(v)})" for k, v in s.NEEDS.items())
    rank = "list_position([" + ", ".join(f"'{k}'" for k in s.KINDS) + "], kind)"
    listed = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, {rank}){only}, '')"
    base = f"kind IN {in_(s.BASE)}"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS text FROM documents),
matches AS ({matches}),
placed AS (
  SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY uid, family ORDER BY i) AS stop,
    CASE family WHEN 'assign' THEN CASE WHEN length(regexp_extract(m, {_q(s.ASSIGN)}, 1)) >= {s.VALUE} THEN 'assign' END
      WHEN 'weak' THEN CASE {weak} END ELSE family END AS kind FROM matches),
spans AS (
  SELECT p.uid, kind, stop - length(m) AS start, stop, {part} AS part,
    (SELECT count(*) FROM placed x WHERE x.uid = p.uid AND x.kind = 'break' AND x.stop <= p.stop) AS scope
  FROM placed p WHERE kind IS NOT NULL AND kind <> 'break' AND ({base} OR NOT EXISTS (
    SELECT 1 FROM placed x WHERE x.uid = p.uid AND x.{base} AND x.stop - length(x.m) < p.stop AND p.stop - length(p.m) < x.stop))),
found AS (
  SELECT * FROM spans a WHERE {base} OR EXISTS (SELECT 1 FROM spans b WHERE b.uid = a.uid AND b.scope = a.scope AND ({needs})
    AND greatest(a.start, b.start) - least(a.stop, b.stop) <= {s.REACH}))
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256({listed.format(rank=rank, only=f" FILTER ({base})")}) AS base_sha256, {listed.format(rank=rank, only="")} AS spans
FROM docs d LEFT JOIN found USING (uid) GROUP BY d.uid, d.doc_id
"""


SQL: dict[str, str] = {"op11_secret_links": _secret_links(), "op12_merkle_manifest": MERKLE}
