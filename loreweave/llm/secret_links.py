"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong patterns (assignments to secret names, access key ids, long hex runs) are findings by themselves. Weak candidates, which are
secrets with vague labels, opaque strings, identifiers and endpoints, are findings only beside a complementary part: both within one
scope (text between blank lines) and at most ``reach`` characters apart.

Matches of a pattern are turned into positions by a running sum over rows of (gap, length), so texts with many matches cost in proportion.
The link is an interval join: positions are put in buckets as wide as the reach, each bucket of a scope is first reduced to the least
and greatest start and end of each part, and a candidate asks the two buckets on either side of it. So a scope full of
candidates makes a bounded number of rows for each of them, never pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.llm.common import store

REACH = 400
_SET = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = rf"""(?i)(?:password|passwd|secret|token|api_?key){_SET}([A-Za-z0-9+/_.=-]+)"""  # letters of ASCII only
VALUE = 6  # characters that an assigned secret has at least
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Weak candidates in the order in which they are tried at a place, and what ends a scope.
WEAK = {
    "break": r"\n[\x20\t\r]*\n[\x20\t\r\n]*",
    "endpoint": r"(?:(?:https?|wss?|s?ftp|ssh|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|rediss?|amqps?|ldaps?)://[^\x20\x09-\x0D\"'<>]+"
    rf"|(?i:host(?:name)?|endpoint|server|base_?url){_SET}[A-Za-z0-9._:/-]{{4,}})",
    "identifier": rf"(?i:user(?:_?name)?|login|client_?id|account(?:_?id)?|(?:access_?)?key_?id|tenant(?:_?id)?){_SET}[A-Za-z0-9@._-]{{3,}}",
    "secret": rf"(?i:pwd|pass(?:phrase|code)?|auth|credentials?|bearer|private_?key|(?:secret_?)?access_?key|secret_?key){_SET}[A-Za-z0-9+/_.=-]{{6,}}",
    "opaque": r"[A-Za-z0-9+/_-]{32,}={0,2}",
}
KINDS = ("assign", "access", "hex", "secret", "opaque", "identifier", "endpoint")  # order of spans that start together
BASE = KINDS[:3]
PART = {"assign": "secret", "hex": "secret", "secret": "secret", "opaque": "secret", "access": "identifier", "identifier": "identifier", "endpoint": "endpoint"}
#: Parts that make a weak candidate a finding.
NEEDS = {"secret": ("identifier", "endpoint"), "opaque": ("identifier",), "identifier": ("secret",), "endpoint": ("secret",)}
WEAK_PATTERN = "|".join(f"(?:{p})" for p in WEAK.values())
_SECRET = f"{ASSIGN}|(?-i:{HEX}|{WEAK['opaque']})|{WEAK['secret']}"
_OTHER = f"{ACCESS}|{WEAK['identifier']}|{WEAK['endpoint']}"


def _matches(text: Column, pattern: str, family: int, kind) -> Column:
    """Every match of a pattern in order: what comes before it, its length, and its kind, null where it is none."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    return F.zip_with(F.slice(F.transform(gaps, F.length), 1, F.size(found)), found, lambda g, m: F.struct(
        F.lit(family).alias("family"), g.alias("gap"), F.length(m).alias("size"), kind(m).alias("kind")))


def _weak_kind(m: Column) -> Column:
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(WEAK.items()):
        real = m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]") if name == "opaque" else F.lit(True)
        kind = F.when(m.rlike(f"^(?:{pattern})"), F.when(real, name)).otherwise(kind)
    return kind


def _found(text: Column) -> Column:
    """All matches; weak ones only where the text holds a secret and another part at all."""
    none = F.array().cast("array<struct<family:int,gap:int,size:int,kind:string>>")
    value = lambda m: F.when(F.length(F.regexp_extract(m, ASSIGN, 1)) >= VALUE, "assign")
    scans = [
        F.when(text.rlike(ASSIGN), _matches(text, ASSIGN.replace("([", "(?:["), 0, value)),
        F.when(text.contains("AKIA"), _matches(text, ACCESS, 1, lambda m: F.lit("access"))),
        F.when(text.rlike(HEX), _matches(text, HEX, 2, lambda m: F.lit("hex"))),
        F.when(text.rlike(_OTHER) & text.rlike(_SECRET), _matches(text, WEAK_PATTERN, 3, _weak_kind)),
    ]
    return F.concat(*[F.coalesce(s, none) for s in scans])


def _placed(stored: DataFrame) -> DataFrame:
    """Matches with start, end and scope."""
    rows = stored.filter(F.size("found") > 0).select("uid", F.posexplode("found").alias("i", "m")).select("uid", "i", "m.*")
    end = F.sum((F.col("gap") + F.col("size")).cast("long")).over(Window.partitionBy("uid", "family").orderBy("i"))
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("size")).filter(F.col("kind").isNotNull())
    rank = F.coalesce(*[F.when(F.col("kind") == k, F.lit(n)) for n, k in enumerate(KINDS)])
    rows = rows.select("uid", "kind", rank.alias("rank"), "start", "end")
    base = F.col("kind").isin(*BASE)
    order = Window.partitionBy("uid").orderBy("start", "rank", "end")
    so_far, to_come = (order.rowsBetween(*b) for b in ((Window.unboundedPreceding, 0), (0, Window.unboundedFollowing)))
    scope = F.sum(F.when(F.col("kind") == "break", 1).otherwise(0)).over(so_far)
    covered = (F.max(F.when(base, F.col("end"))).over(so_far) > F.col("start")) | (F.min(F.when(base, F.col("start"))).over(to_come) < F.col("end"))
    rows = rows.withColumn("scope", scope).withColumn("covered", F.coalesce(covered, F.lit(False)))
    return rows.filter((F.col("kind") != "break") & (base | ~F.col("covered"))).drop("covered")


def _linked(spans: DataFrame, reach: int) -> DataFrame:
    """(uid, start) of the weak candidates with a complementary part in reach."""
    wide = lambda c: F.floor(F.col(c) / reach)
    part = F.create_map(*[F.lit(x) for kv in PART.items() for x in kv])[F.col("kind")]
    edges = spans.select("uid", "scope", part.alias("part"), F.explode(F.array(
        F.struct(F.lit(True).alias("to_right"), F.col("start").alias("at")), F.struct(F.lit(False).alias("to_right"), F.col("end").alias("at")),
    )).alias("e")).select("uid", "scope", "part", "e.to_right", "e.at")
    buckets = edges.groupBy("uid", "scope", "part", "to_right", wide("at").alias("bucket")).agg(F.min("at").alias("least"), F.max("at").alias("most"))
    needs = F.create_map(*[x for k, v in NEEDS.items() for x in (F.lit(k), F.array(*[F.lit(p) for p in v]))])[F.col("kind")]
    ask = lambda right, b: F.struct(F.lit(right).alias("to_right"), b.alias("bucket"))
    asked = spans.filter(F.col("kind").isin(*NEEDS)).select("uid", "scope", "start", "end", F.explode(needs).alias("part"))
    asked = asked.withColumn("a", F.explode(F.array(ask(True, wide("end")), ask(True, wide("end") + 1), ask(False, wide("start")), ask(False, wide("start") - 1))))
    asked = asked.select("uid", "scope", "start", "end", "part", "a.*")
    right = F.when(F.col("bucket") == wide("end"), F.col("most") >= F.col("end")).otherwise(F.col("least") <= F.col("end") + reach)
    left = F.when(F.col("bucket") == wide("start"), F.col("least") <= F.col("start")).otherwise(F.col("most") >= F.col("start") - reach)
    met = asked.join(buckets, ["uid", "scope", "part", "to_right", "bucket"]).filter(F.when(F.col("to_right"), right).otherwise(left))
    return met.select("uid", "start").distinct()


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """One row per row of ``docs``: id_col and ``spans`` (kind, start and end in characters, end exclusive), by start and then by order of KINDS.

    Strong findings may overlap each other; weak candidates that overlap one are no findings of their own and no parts.

    Null and empty texts have no spans. Texts of any length are searched whole. Null ids and repeated rows stay rows of their own, as rows are told
    apart by a number given when the matches are stored; an empty table gives none; other columns are ignored whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), _found(text).alias("found")).withColumn("uid", F.monotonically_increasing_id())
    stored, _ = store(rows)
    spans, _ = store(_placed(stored))
    weak = F.col("kind").isin(*NEEDS)
    findings = spans.filter(~weak).unionByName(spans.filter(weak).join(_linked(spans, reach), ["uid", "start"], "left_semi"))
    listed = findings.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "end", "kind"))).alias("spans"))
    listed = listed.select("uid", F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return stored.select("uid", "id").join(listed, "uid", "left").select(F.col("id").alias(id_col), F.coalesce("spans", none).alias("spans"))


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
