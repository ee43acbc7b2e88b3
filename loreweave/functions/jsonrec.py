"""Lenient JSON objects: plain, fenced, or buried in prose."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreweave.functions.text import let
from loreweave.session import cut_lineage

FENCE = r"(?is)```(?:json)?\s*(\{.*?\})\s*```"


_FENCE = re.compile(r"```(?:json)?\s*(\{.*?\})\s*```", re.IGNORECASE | re.DOTALL | re.ASCII)
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"?|[{}]|[^"{}]+', re.DOTALL)


def balanced_object(text: str) -> str | None:
    """Text from the first opening brace to where the running depth of braces is zero again.

    Quoted strings, from that brace on, count as one token, so braces inside them have no depth. Null if the
    depth never returns to zero.
    """
    begin = text.find("{")
    if begin < 0:
        return None
    depth, end = 0, begin
    for token in _TOKEN.findall(text, begin):
        end += len(token)
        if token == "{":
            depth += 1
        elif token == "}":
            depth -= 1
            if depth == 0:
                return text[begin:end]
    return None


def _once(pairs: list) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise ValueError("a key is repeated")
    return found


def _refuse(word: str) -> None:
    raise ValueError(word)


_BLANK = " \t\n\r"
_JSON = json.JSONDecoder(parse_constant=_refuse)
_STRICT = json.JSONDecoder(parse_constant=_refuse, object_pairs_hook=_once)


def _value(text: str, at: int = 0) -> tuple[object, int]:
    """First JSON value of the text from ``at`` on and where it ends; ``(None, -1)`` if there is none or one of its keys is repeated."""
    try:
        value, end = _JSON.raw_decode(text, at)
        keys = 0
        if isinstance(value, dict):
            keys = len(value) + sum(len(x) for v in value.values() if isinstance(v, list) for x in v if isinstance(x, dict))
        # As many colons as keys: none is repeated. Colons in strings and deeper objects need a second look.
        return (value, end) if text.count(":", at, end) == keys else _STRICT.raw_decode(text, at)
    except (ValueError, RecursionError):
        return None, -1


def reply_object(text: str) -> dict | None:
    """The JSON object of a model reply by the rules of :func:`recover_json`, or None.

    What a parser reads from the first opening brace on, if it gets to an end, is the balanced object that begins there.
    """
    start = len(text) - len(text.lstrip(_BLANK))
    value, end = _value(text, start)
    if end < 0 or text[end:].strip(_BLANK):
        fenced = _FENCE.search(text) if "```" in text else None
        begin = text.find("{")
        if fenced:
            value = _value(fenced.group(1))[0]
        elif begin != start:
            value = _value(text, begin)[0] if begin >= 0 else None
    return value if isinstance(value, dict) else None


@F.pandas_udf(T.StringType())
def _span(raw: pd.Series) -> pd.Series:
    return raw.map(balanced_object, na_action="ignore")


def _strict_json(c: Column) -> Column:
    """The text as a variant when it is exactly one JSON value.

    The parser stops after the first value, so trailing text has to be caught: exactly if the text is one value,
    a list of it and a known second element has that element second and no third.
    """
    framed = F.try_parse_json(F.concat(F.lit("["), c, F.lit(",true]")))

    def first(v: Column) -> Column:
        alone = F.coalesce(F.try_variant_get(v, "$[1]", "boolean"), F.lit(False)) & F.try_variant_get(v, "$[2]", "variant").isNull()
        return F.when(alone, F.try_variant_get(v, "$[0]", "variant"))

    return let(framed, first)


def recover_json(df: DataFrame, raw: str, out: str = "obj", store: bool = True) -> DataFrame:
    """Add the JSON object of a model reply as a variant column, or null.

    Order: the whole reply; if that is not JSON at all, the fenced object; with no fence, the first
    balanced object. A reply that is valid JSON but not an object is null, as is a broken fenced object.
    The reply is parsed once and stored; only rows that neither parse nor carry a fence go to Python. A caller
    that stores what it derives from the object, without filters before, passes ``store=False``.
    """
    reply = F.col(raw)
    whole = df.withColumn("_whole", _strict_json(reply))
    fenced = whole.withColumn("_fenced", F.when(F.col("_whole").isNull(), F.regexp_extract(reply, FENCE, 1)))
    odd = F.col("_whole").isNull() & (F.col("_fenced") == "")
    spanned = fenced.withColumn("_span", _span(F.when(odd, reply)))
    text = F.when(F.col("_fenced") != "", F.col("_fenced")).otherwise(F.col("_span"))
    both = spanned.withColumn("_any", F.coalesce(F.col("_whole"), F.try_parse_json(text)))
    kept = F.when(F.startswith(F.schema_of_variant("_any"), F.lit("OBJECT")), F.col("_any"))
    made = both.withColumn(out, kept).drop("_whole", "_fenced", "_span", "_any")
    return cut_lineage(made) if store else made


def text_field(obj: Column, name: str) -> Column:
    """A string field of a variant object, null when it is missing or of another type."""
    v = F.try_variant_get(obj, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(obj, f"$.{name}", "string"))


def list_field(obj: Column, name: str) -> Column:
    """A list field as ``array<variant>``, null when it is not a list; one bad element spoils nothing."""
    return F.try_variant_get(obj, f"$.{name}", "array<variant>")
