"""SQL twin of entity resolution: one row after another, with the graph as lists in a recursive table.

The tables ``ents`` (b, doc, at, id, raw, key, type, description: ``b`` is what is walked as one) and ``known`` (b, name, type, text: a null text has
no vector) have to be given. ``steps`` holds, of every step, the node that a row's name stands for (``target``), and ord a document's end the
nodes of its names (``fname``, ``fnode``) and its entities (``emit``: node, row, has_vector).
"""

from __future__ import annotations

SIMILAR = """
ent AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY b ORDER BY ord, doc, id) AS n FROM ents),
asked AS (SELECT DISTINCT b, type, key FROM ent),
pool AS (SELECT b, type, key AS name FROM asked UNION SELECT b, type, name FROM known),
sorted AS (SELECT a.b, a.type, a.key, p.name, array_to_string(list_sort(list_filter(string_split(a.key, ' '), lambda w: w <> '')), ' ') AS x,
  array_to_string(list_sort(list_filter(string_split(p.name, ' '), lambda w: w <> '')), ' ') AS y FROM asked a JOIN pool p USING (b, type) WHERE a.key <> p.name),
two AS (SELECT DISTINCT x, y FROM sorted WHERE levenshtein(x, y) <= {slack} * (length(x) + length(y))),
dp(x, y, i, r) AS (
  SELECT x, y, 0, list_transform(range(0, length(y) + 1), lambda j: 0) FROM two
  UNION ALL
  SELECT x, y, i + 1, list_transform(range(1, len(r) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda m: CASE WHEN m > 1 AND substring(x, i + 1, 1) = substring(y, CAST(m - 1 AS BIGINT), 1) THEN greatest(r[m], r[m - 1] + 1) ELSE r[m] END)))
  FROM dp WHERE i < length(x)),
alike AS (SELECT s.b, s.type, s.key, list({{'name': s.name, 'score': 200.0 * r[-1] / (length(s.x) + length(s.y))}}) AS sims FROM sorted s JOIN dp ON dp.x = s.x AND dp.y = s.y AND dp.i = length(s.x)
  WHERE 200.0 * r[-1] / (length(s.x) + length(s.y)) >= {threshold} GROUP BY ALL),
"""
VECTORS = """
texts AS (SELECT DISTINCT text FROM (SELECT CASE WHEN coalesce(trim(description), '') <> '' THEN raw || ': ' || trim(description) ELSE raw END AS text FROM ent UNION SELECT text FROM known WHERE text IS NOT NULL)),
bags AS (SELECT text, array_to_string(list_sort({tokens}), ' ') AS bag FROM texts),
slots AS (SELECT bag, CAST(('0x' || substr(md5(tok), 1, 8)) AS BIGINT) % 64 AS slot, CAST(count(*) AS DOUBLE) AS c FROM (SELECT bag, unnest(string_split(bag, ' ')) AS tok FROM (SELECT DISTINCT bag FROM bags)) WHERE tok <> '' GROUP BY 1, 2),
unit AS (SELECT bag, slot, c / sqrt(sum(c * c) OVER (PARTITION BY bag)) AS w FROM slots),
seen AS (SELECT b, n, bag FROM (SELECT b, n, CASE WHEN coalesce(trim(description), '') <> '' THEN raw || ': ' || trim(description) ELSE raw END AS text FROM ent) JOIN bags USING (text)
  UNION ALL SELECT b, -row_number() OVER (PARTITION BY b ORDER BY name), bag FROM known JOIN bags USING (text)),
meets AS (SELECT x.b, x.bag AS p, y.bag AS q FROM (SELECT DISTINCT b, bag FROM seen WHERE n > 0) x JOIN (SELECT DISTINCT b, bag FROM seen) y USING (b)),
close AS (SELECT p, q, round(sum(u.w * v.w), 9) AS score FROM (SELECT DISTINCT p, q FROM meets) JOIN unit u ON u.bag = p JOIN unit v ON v.bag = q AND v.slot = u.slot GROUP BY 1, 2 HAVING round(sum(u.w * v.w), 9) >= {floor}),
near AS (SELECT r.b, r.n, list({{'m': o.n, 'score': c.score}}) AS near FROM seen r JOIN close c ON c.p = r.bag JOIN seen o ON o.b = r.b AND o.bag = c.q AND o.n < r.n WHERE r.n > 0 GROUP BY 1, 2),
"""
NO_VECTORS = "near AS (SELECT NULL::VARCHAR AS b, 0::BIGINT AS n, NULL::STRUCT(m BIGINT, score DOUBLE)[] AS near WHERE false),\n"
WALK = """
kn AS (SELECT b, list(name ORDER BY name) AS gname, list(type ORDER BY name) AS gtype, list(m ORDER BY name) AS gown, flatten(list(kinds)) AS gkey FROM (
  SELECT k.b, k.name, any_value(k.type) AS type, any_value(CASE WHEN k.text IS NOT NULL THEN -v.r END) AS m, list(DISTINCT k.type || chr(1) || k.name) AS kinds FROM known k
  LEFT JOIN (SELECT b, name, row_number() OVER (PARTITION BY b ORDER BY name) AS r FROM known WHERE text IS NOT NULL) v USING (b, name) GROUP BY k.b, k.name) GROUP BY b),
ev AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY b ORDER BY ord, doc, phase, n) AS i, row_number() OVER (PARTITION BY b, ord, doc ORDER BY phase, n) = 1 AS opens,
    row_number() OVER (PARTITION BY b, ord, doc ORDER BY phase DESC, n DESC) = 1 AS closes FROM (
    SELECT e.b, e.ord, e.doc, e.n, e.key, e.type, p.phase, CASE WHEN p.phase = 0 THEN coalesce(a.sims, []) ELSE [] END AS sims, CASE WHEN p.phase = 1 THEN coalesce(v.near, []) ELSE [] END AS near
    FROM ent e CROSS JOIN (SELECT unnest([0, 1]) AS phase) p LEFT JOIN alike a ON a.b = e.b AND a.type = e.type AND a.key = e.key LEFT JOIN near v ON v.b = e.b AND v.n = e.n)),
steps AS (
  SELECT b, 0::BIGINT AS i, coalesce(gname, []::VARCHAR[]) AS gname, coalesce(gtype, []::VARCHAR[]) AS gtype, coalesce(gown, []::BIGINT[]) AS gown, coalesce(gkey, []::VARCHAR[]) AS gkey, []::VARCHAR[] AS lname, []::VARCHAR[] AS ltype, []::BIGINT[] AS ln,
    []::VARCHAR[] AS rname, []::VARCHAR[] AS rtype, []::BIGINT[] AS rn, []::VARCHAR[] AS fnode, NULL::VARCHAR AS target, 0::BIGINT AS n, false AS closes
  FROM (SELECT DISTINCT b FROM ent) LEFT JOIN kn USING (b)
  UNION ALL
  SELECT b, i, CASE WHEN closes THEN gname || new_nodes ELSE gname END,
    CASE WHEN closes THEN gtype || list_transform(new_nodes, lambda x: ltype[list_position(fnode, x)]) ELSE gtype END,
    CASE WHEN closes THEN list_transform(gname || new_nodes, lambda x, k: coalesce(gown[k], rn[list_position(rname, x)])) ELSE gown END,
    CASE WHEN closes THEN gkey || list_transform(new_nodes, lambda x: ltype[list_position(fnode, x)] || chr(1) || x) ELSE gkey END,
    lname, ltype, ln, rname, rtype, rn, fnode, target, n, closes
  FROM (
    SELECT *, list_filter(fnode, lambda x, k: list_position(fnode, x) = k AND NOT list_contains(gname, x)) AS new_nodes FROM (
      SELECT * REPLACE (CASE WHEN target IS NOT NULL AND NOT list_contains(lname, target) THEN lname || [target] ELSE lname END AS lname,
        CASE WHEN target IS NOT NULL AND NOT list_contains(lname, target) THEN ltype || [type] ELSE ltype END AS ltype, CASE WHEN target IS NOT NULL AND NOT list_contains(lname, target) THEN ln || [n] ELSE ln END AS ln,
        CASE WHEN node IS NOT NULL THEN fnode || [node] ELSE fnode END AS fnode, CASE WHEN node = name THEN rname || [name] ELSE rname END AS rname,
        CASE WHEN node = name THEN rtype || [type] ELSE rtype END AS rtype, CASE WHEN node = name THEN rn || [n] ELSE rn END AS rn)
      FROM (
        SELECT *, CASE WHEN phase = 0 THEN CASE WHEN list_contains(gkey, type || chr(1) || key) OR list_contains(live, type || chr(1) || key) THEN key
            ELSE coalesce(list_sort(list_transform(list_filter(sims, lambda s: list_contains(gkey, type || chr(1) || s.name) OR list_contains(live, type || chr(1) || s.name)),
              lambda s: {'neg': -s.score, 'place': CASE WHEN list_contains(gkey, type || chr(1) || s.name) THEN -1 ELSE list_position(live, type || chr(1) || s.name) END, 'name': s.name}))[1].name, key) END END AS target,
          CASE WHEN name IS NOT NULL THEN coalesce(list_sort(list_filter(list_transform(list_filter(near, lambda c: list_contains(rn, c.m) OR list_contains(gown, c.m)),
              lambda c: {'cls': CASE WHEN (CASE WHEN list_contains(rn, c.m) THEN rtype[list_position(rn, c.m)] ELSE gtype[list_position(gown, c.m)] END) = type THEN 0 ELSE 1 END, 'neg': -c.score,
                'place': CASE WHEN list_contains(rn, c.m) THEN list_position(rn, c.m) ELSE 0 END, 'name': CASE WHEN list_contains(rn, c.m) THEN rname[list_position(rn, c.m)] ELSE gname[list_position(gown, c.m)] END}),
              lambda o: -o.neg >= CASE WHEN o.cls = 0 THEN $same ELSE $cross END))[1].name, name) END AS node
        FROM (
          SELECT s.b, e.i, e.n, e.key, e.type, e.phase, e.closes, e.sims, e.near, s.gname, s.gtype, s.gown, s.gkey, CASE WHEN e.opens THEN [] ELSE s.lname END AS lname, CASE WHEN e.opens THEN [] ELSE s.ltype END AS ltype,
            CASE WHEN e.opens THEN [] ELSE s.ln END AS ln, CASE WHEN e.opens THEN [] ELSE s.rname END AS rname, CASE WHEN e.opens THEN [] ELSE s.rtype END AS rtype, CASE WHEN e.opens THEN [] ELSE s.rn END AS rn,
            CASE WHEN e.opens THEN [] ELSE s.fnode END AS fnode, CASE WHEN e.phase = 1 THEN s.lname[list_position(s.ln, e.n)] END AS name,
            CASE WHEN e.opens THEN [] ELSE list_transform(s.lname, lambda x, k: s.ltype[k] || chr(1) || x) END AS live
          FROM steps s JOIN ev e ON e.b = s.b AND e.i = s.i + 1)))))
"""
#: A document's entities: node, the row that stands for it, and whether the node's own row is among them.
EMITTED = """
ends AS (SELECT b, lname, ln, fnode, rname FROM steps WHERE closes),
emitted AS (SELECT b, fnode[k] AS node, ln[k] AS n, list_contains(rname, fnode[k]) AS has_vector FROM (SELECT *, unnest(range(1, len(fnode) + 1)) AS k FROM ends) WHERE list_position(fnode, fnode[k]) = k),
finals AS (SELECT e.b, e.n, e.doc, e.id, e.raw, d.fnode[list_position(d.lname, s.target)] AS node FROM ent e JOIN steps s ON s.b = e.b AND s.n = e.n AND s.target IS NOT NULL
  JOIN (SELECT z.b, x.ord, x.doc, z.lname, z.fnode FROM steps z JOIN ev x ON x.b = z.b AND x.i = z.i WHERE z.closes) d ON d.b = e.b AND d.ord = e.ord AND d.doc = e.doc)
"""


def walk(ents: str, known: str, tokens: str, *, threshold: int = 90, same: float | None = None, cross: float | None = None) -> str:
    """Tables of a statement up to ``emitted`` (b, node, n, has_vector) and ``finals`` (b, n, doc, id, raw, node); ``same`` None leaves meaning out."""
    slack = (100 - threshold) / 100
    vectors = NO_VECTORS if same is None else VECTORS.format(tokens=tokens, floor=min(same, cross))
    body = WALK.replace("$same", str(same or 2)).replace("$cross", str(cross or 2))
    return f"WITH RECURSIVE ents AS ({ents}),\nknown AS ({known}),{SIMILAR.format(slack=slack, threshold=threshold)}{vectors}{body.strip()},{EMITTED}"
