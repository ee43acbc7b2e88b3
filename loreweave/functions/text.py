"""Text expressions as plain Column functions (all stay inside the JVM)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ELLIPSIS = "…"

# Every character Python's str.strip/str.split treats as whitespace.
WHITESPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WS = r"[\s\x1c-\x1f\x85\p{Z}]"

# Words never used to centre a snippet.
STOPWORDS = (
    "the a an and or but of in on at to for is are was were be by with as it its this that "
    "what which who how why when where do does did i you we they he she"
).split()
TOKEN_PUNCTUATION = ".,;:!?\"'()[]"

# Punctuation dropped at the end of names and predicates, and leading articles.
TRAILING_PUNCTUATION = r"[.,;:!?'\"()\[\]]+$"
ARTICLES = ("the ", "a ", "an ")

# Raw predicate -> canonical predicate.
PREDICATE_ALIASES = {
    "author of": "authored",
    "authors": "authored",
    "wrote": "authored",
    "writes": "authored",
    "co-authored": "co-authored",
    "coauthored": "co-authored",
    "co-author of": "co-authored",
    "works at": "affiliated with",
    "works for": "affiliated with",
    "employed by": "affiliated with",
    "employee of": "affiliated with",
    "member of": "affiliated with",
    "based in": "located in",
    "headquartered in": "located in",
    "situated in": "located in",
    "using": "uses",
    "utilizes": "uses",
    "utilises": "uses",
    "leverages": "uses",
    "requires": "depends on",
    "relies on": "depends on",
    "built on": "based on",
    "better than": "outperforms",
    "exceeds": "outperforms",
    "surpasses": "outperforms",
    "consists of": "contains",
    "comprised of": "contains",
    "includes": "contains",
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once inside an expression instead of repeating its tree."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def run_lengths(ordered: Column) -> Column:
    """Runs of a sorted array as ``array<struct<key, n>>``."""

    def build(v: Column) -> Column:
        def runs(starts: Column) -> Column:
            return F.transform(
                starts,
                lambda s, j: F.struct(
                    F.get(v, s - 1).alias("key"),
                    (F.coalesce(F.get(starts, j + 1), F.size(v) + 1) - s).alias("n"),
                ),
            )

        firsts = F.filter(
            F.sequence(F.lit(1), F.size(v)),
            lambda i: (i == 1) | (F.get(v, i - 1) != F.get(v, i - 2)),
        )
        empty = F.array().cast("array<int>")
        return let(F.when(F.size(v) > 0, firsts).otherwise(empty), runs)

    return let(ordered, build)


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITESPACE))


def collapse(c: Column) -> Column:
    """Runs of whitespace become one space; ends are trimmed."""
    return F.regexp_replace(strip(c), WS + "+", " ")


def words(c: Column) -> Column:
    """Whitespace-separated words, no empty entries."""
    return F.filter(F.split(c, WS + "+"), lambda w: w != "")


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits, the token unit of the lexical index."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def alnum_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def clip(c: Column, n: int) -> Column:
    """First ``n`` characters, with an ellipsis when something was cut."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(ELLIPSIS))).otherwise(c)


def clip_trimmed(c: Column, n: int) -> Column:
    """Like :func:`clip` but without blanks before the ellipsis."""
    cut = F.concat(rstrip(F.substring(c, 1, n)), F.lit(ELLIPSIS))
    return F.when(F.length(c) > n, cut).otherwise(c)


def clamp(c: Column, n: int) -> Column:
    """Trim, then keep at most ``n`` characters counting the ellipsis."""
    s = strip(c)
    cut = F.concat(rstrip(F.substring(s, 1, n - 1)), F.lit(ELLIPSIS))
    return F.when(F.length(s) > n, cut).otherwise(s)


def sanitize_filename(c: Column, fallback: str = "upload") -> Column:
    base = strip(F.substring_index(F.replace(c, F.lit("\\"), F.lit("/")), "/", -1))
    safe = F.regexp_replace(base, r"[^A-Za-z0-9._-]+", "_")
    safe = F.btrim(F.regexp_replace(safe, r"\.{2,}", "."), F.lit("._-"))
    return F.coalesce(F.nullif(safe, F.lit("")), F.lit(fallback))


def normalize_brackets(c: Column) -> Column:
    """Full-width citation brackets to ASCII ones."""
    return F.regexp_replace(c, r"[【（]\s*(W?\d+)\s*[】）]", "[$1]")


def contains_ci(c: Column, needle: Column) -> Column:
    """Case-insensitive literal match; no LIKE metacharacters to escape."""
    return F.contains(F.lower(c), F.lower(needle))


def placeholder_title(c: Column, width: int = 60) -> Column:
    def build(text: Column) -> Column:
        head = F.substring(text, 1, width)
        space = F.length(head) - F.instr(F.reverse(head), " ")
        cut = F.when(
            F.contains(head, F.lit(" ")) & (space > width // 2), F.substring(head, F.lit(1), space)
        ).otherwise(head)
        long_form = F.concat(rstrip(cut), F.lit(ELLIPSIS))
        return F.when(F.length(text) > width, long_form).when(text == "", "New chat").otherwise(text)

    return let(collapse(c), build)


def query_terms(query: Column) -> Column:
    """Words worth centring a snippet on, in query order; every word when none qualifies."""
    cleaned = F.filter(
        F.transform(words(query), lambda w: F.btrim(F.lower(w), F.lit(TOKEN_PUNCTUATION))),
        lambda t: t != "",
    )

    def choose(all_terms: Column) -> Column:
        good = F.filter(all_terms, lambda t: (F.length(t) >= 3) & ~t.isin(STOPWORDS))
        return F.when(F.size(good) > 0, good).otherwise(all_terms)

    return let(cleaned, choose)


def snippet(text: Column, query: Column, width: int = 280) -> Column:
    """One-line window of ``width`` characters around the first query term found in the text."""

    def window(v: Column) -> Column:
        body, n = v["t"], F.length(v["t"])
        start = F.greatest(F.lit(0), v["at"] + F.floor(v["len"] / 2) - width // 2)
        end = F.least(n, start + width)
        start = F.greatest(F.lit(0), end - width)
        out = strip(F.substring(body, (start + 1).cast("int"), (end - start).cast("int")))
        return F.concat(
            F.when(start > 0, ELLIPSIS).otherwise(""), out, F.when(end < n, ELLIPSIS).otherwise("")
        )

    def locate(v: Column) -> Column:
        low = F.lower(v["t"])
        hits = F.filter(
            F.transform(
                v["q"],
                lambda t: F.struct(
                    v["t"].alias("t"),
                    (F.call_function("instr", low, t) - 1).alias("at"),
                    F.length(t).alias("len"),
                ),
            ),
            lambda h: h["at"] >= 0,
        )
        head = F.concat(rstrip(F.substring(v["t"], 1, width)), F.lit(ELLIPSIS))
        return (
            F.when(F.length(v["t"]) <= width, v["t"])
            .when(F.size(hits) == 0, head)
            .otherwise(let(F.get(hits, F.lit(0)), window))
        )

    return let(F.struct(collapse(text).alias("t"), query_terms(query).alias("q")), locate)


def name_key_ascii(c: Column) -> Column:
    """Entity key of a name already in compatibility form (see :func:`names.name_key`)."""
    s = F.lower(strip(c))
    article = F.lit(0)
    for a in reversed(ARTICLES):
        article = F.when(F.startswith(s, F.lit(a)), len(a)).otherwise(article)
    s = F.substring(s, article + 1, F.length(s))
    return strip(F.regexp_replace(F.regexp_replace(s, TRAILING_PUNCTUATION, ""), WS + "+", " "))


def canonical_predicate(c: Column) -> Column:
    """Lower-case, collapse, drop trailing punctuation, then map through the alias table."""
    key = F.regexp_replace(collapse(F.lower(c)), TRAILING_PUNCTUATION, "")
    pairs = [F.lit(x) for kv in PREDICATE_ALIASES.items() for x in kv]
    return let(key, lambda k: F.coalesce(F.element_at(F.create_map(*pairs), k), k))


def is_heading(line: Column) -> Column:
    """Does a line open a section?"""

    def test(s: Column) -> Column:
        return (F.length(s) > 0) & (F.length(s) <= 100) & (
            s.rlike(r"(?U)^#{1,6}\s+\S")
            | s.rlike(r"(?Ui)^-{3}\s*(page|slide)\s+\d+\s*-{3}\s*$")
            | s.rlike(r"(?U)^\d+(\.\d+)*\.?\s+[A-Z][^\n]{0,79}$")
            | (
                s.rlike(r"(?U)^[A-Z0-9][A-Z0-9\s\-&:,/()'.]{2,79}$")
                & (F.length(F.regexp_replace(s, r"[^\p{L}]", "")) >= 3)
            )
        )

    return let(strip(line), test)


def split_lines(text: Column) -> Column:
    """Lines with their terminators, at every boundary Python's splitlines knows."""
    boundary = r"(?<=\n)|(?<=\r)(?!\n)|(?<=[\x0b\x0c\x1c-\x1e\x85\u2028\u2029])"
    return F.filter(F.split(text, boundary), lambda s: s != "")
