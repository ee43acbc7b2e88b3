"""Token counts of whole texts by a two-tier lookup on the map side.

Tier one is a broadcast hash table from frequent pre-tokens to their number of tokens. Tier two is a cache in each
Python worker, filled by encoding the pre-tokens that tier one lacks. Nothing is shuffled: a text's count is the sum
of its pre-tokens' lengths, and a BPE never merges across pre-tokens. The tables only save work; a count never
depends on what they hold.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters on which lower-casing, composition and character classes are plain, so that one regular expression
#: reproduces the tokenizer's normaliser and splitter. Texts with any other character go to the tokenizer whole.
_OTHER = re.compile("[^\t-\r -~¡-įı-ž]")
_LETTER = "a-zªµºß-öø-ž"
_DIGIT = "0-9²³¹¼-¾"
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^\\s{_LETTER}{_DIGIT}]+")
_SPECIAL = "<|"
MAX_KEY = 48  # longer pre-tokens are encoded without being kept
CACHE = 1_000_000  # entries of a worker's cache

_worker: dict[str, tuple] = {}


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if path not in _worker:
        _worker[path] = (Tokenizer.from_file(path), {})
    return _worker[path]


def pre_tokens(text: str) -> list[str] | None:
    """Pre-tokens of a text of plain characters; None where only the tokenizer itself can tell."""
    if _SPECIAL in text or _OTHER.search(text):
        return None
    return _SPLIT.findall(text.lower())


def frequent_lengths(
    docs: DataFrame, tokenizer: str, text: str = "text", *, splits: int = 16, rows: int = 512, size: int = 65_536
) -> dict[str, int]:
    """Pre-token -> number of tokens, for the ``size`` most frequent of a bounded sample.

    The sample is the first ``rows`` rows of ``splits`` evenly spaced partitions; each sends at most ``size`` pairs.
    Other partitions aren't read. Keys have at most ``MAX_KEY`` characters, so the table has a fixed size bound.
    """

    def count(part: Iterable) -> list[list[tuple[str, int]]]:
        seen: Counter = Counter()
        for (value,) in islice(part, rows):
            seen.update(w for w in pre_tokens(value or "") or () if len(w) <= MAX_KEY)
            if len(seen) > 4 * size:
                seen = Counter(dict(seen.most_common(size)))
        return [seen.most_common(size)]

    rdd = docs.select(F.col(text)).rdd.mapPartitions(count)
    parts = rdd.getNumPartitions()
    chosen = sorted({i * parts // splits for i in range(min(splits, parts))} if parts > splits else range(parts))
    total: Counter = Counter()
    for pairs in rdd.context.runJob(rdd, list, chosen) if chosen else []:
        for k, n in pairs:
            total[k] += n
    words = [w for w, _ in sorted(total.items(), key=lambda p: (-p[1], p[0]))[:size]]
    encoder, _ = _tokenizer(tokenizer)
    return dict(zip(words, (len(e.ids) for e in encoder.encode_batch_fast(words, add_special_tokens=False))))


def _count(batches: Iterable[pa.RecordBatch], tokenizer: str, table: Broadcast) -> Iterator[pa.RecordBatch]:
    encoder, cache = _tokenizer(tokenizer)
    frequent = table.value
    for batch in batches:
        sizes, counts = [], []
        for value in batch.column("_text"):
            value = value.as_py() or ""
            sizes.append(len(value) if value.isascii() else len(value.encode()))
            words = pre_tokens(value)
            if words is None:
                counts.append(len(encoder.encode(value, add_special_tokens=False).ids))
                continue
            first = list(map(frequent.get, words))
            missed = [w for w, n in zip(words, first) if n is None]
            total = sum(filter(None, first))
            if missed:
                new = [w for w in set(missed) if w not in cache]
                if len(cache) + len(new) > CACHE:
                    cache.clear()
                    new = list(set(missed))
                cache.update(zip(new, (len(e.ids) for e in encoder.encode_batch_fast(new, add_special_tokens=False))))
                total += sum(map(cache.__getitem__, missed))
                for w in new:
                    if len(w) > MAX_KEY:
                        del cache[w]
            counts.append(total)
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=["_id", "n_bytes", "n_tokens"]
        )


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", table: dict[str, int] | None = None) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes (UTF-8) and n_tokens of the whole text.

    A null text counts as empty: 0 bytes, 0 tokens. Null ids, repeated rows and ties stay as they are, an empty table
    gives none. Other columns of ``docs`` are ignored, whatever their names. Strings of special tokens inside a text
    are handled as the tokenizer does by default; no begin, end or other tokens are added, nothing is cut or padded.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    if table is None:
        table = frequent_lengths(rows, tokenizer, "_text")
    shared = docs.sparkSession.sparkContext.broadcast(table)
    kind = rows.schema["_id"].dataType.simpleString()
    out = rows.mapInArrow(lambda it: _count(it, tokenizer, shared), f"_id {kind}, n_bytes long, n_tokens long")
    return out.withColumnRenamed("_id", id_col)
