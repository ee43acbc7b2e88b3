"""Periodic runs of words: descending-LCP Kruskal over the suffixes of a text.

Suffixes are sorted by prefix doubling, and neighbours in that order joined by edges weighted with their longest common prefix (LCP). Edges are
taken by decreasing LCP; union-find unites the classes of suffixes that share so many words, each with its ordered set of
positions, the smaller put into the larger. Two positions that become neighbours in such a set at a distance of at most the LCP
repeat each other next door. A run of period q has its first two periods at i and i + q with nothing of their class between
them, so every run shows up exactly once as such a pair that the words before do not extend to the left, and q is its smallest period
(a smaller one would have put a position between the two at a higher LCP).

Texts are worked on in slices of bounded bytes, all texts of a slice at once: ranks hold the text's number, so suffixes of different
texts never meet. Texts without a repeated stretch of the least length leave after two doublings.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.llm.common import by_bytes

WHITE = r"[\x20\x09-\x0D]+"
CHUNK = 512  # positions kept in one list of an ordered set


class Positions:
    """An ordered set of positions in lists of bounded length."""

    __slots__ = ("chunks", "lows", "size")

    def __init__(self, x: int):
        self.chunks, self.lows, self.size = [[x]], [x], 1

    def __iter__(self) -> Iterator[int]:
        for chunk in self.chunks:
            yield from chunk

    def place(self, x: int) -> tuple[int, int]:
        """Insert ``x``; its neighbours before and after, -1 for none."""
        c = max(bisect_right(self.lows, x) - 1, 0)
        chunk = self.chunks[c]
        k = bisect_left(chunk, x)
        before = chunk[k - 1] if k else self.chunks[c - 1][-1] if c else -1
        after = chunk[k] if k < len(chunk) else self.chunks[c + 1][0] if c + 1 < len(self.chunks) else -1
        chunk.insert(k, x)
        self.lows[c] = chunk[0]
        self.size += 1
        if len(chunk) > 2 * CHUNK:
            self.chunks[c : c + 1] = [chunk[:CHUNK], chunk[CHUNK:]]
            self.lows.insert(c + 1, chunk[CHUNK])
        return before, after


def kruskal(edges: Iterable[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """(i, j, LCP) for positions i < j that become neighbours in a class; ``edges`` are (LCP, i, j) by decreasing LCP and form no cycle."""
    parent: dict[int, int] = {}
    sets: dict[int, Positions] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    for lcp, i, j in edges:
        a, b = find(i), find(j)
        large, small = sets.pop(a, None) or Positions(a), sets.pop(b, None) or Positions(b)
        if large.size < small.size:
            large, small, a, b = small, large, b, a
        parent[b] = a
        sets[a] = large
        moved = iter(small)
        x, last = next(moved), -1
        while x >= 0:
            following = next(moved, -1)
            before, after = large.place(x)
            if before >= 0 and before != last:
                yield before, x, lcp
            if after >= 0 and (following < 0 or after < following):
                yield x, after, lcp
            last, x = x, following


def _ranks(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Dense ranks from 1 of pairs of non-negative numbers."""
    return np.unique(first.astype(np.int64) * (int(second.max()) + 1) + second, return_inverse=True)[1].reshape(-1) + 1


def _ahead(rank: np.ndarray, text: np.ndarray, k: int) -> np.ndarray:
    """The rank ``k`` words on, 0 beyond the text."""
    out = np.zeros(len(rank), dtype=np.int64)
    if k < len(rank):
        out[:-k] = np.where(text[k:] == text[:-k], rank[k:], 0)
    return out


def _sorted_suffixes(levels: list[np.ndarray], text: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions by suffix, and the ranks by the first 1, 2, 4, … words; only suffixes whose rank is shared are sorted again."""
    k = 1 << (len(levels) - 1)
    order = np.argsort(levels[-1], kind="stable")
    sorted_ = levels[-1][order]
    head = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
    rank = np.empty(len(text), dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(len(text)), 0)) + 1
    single = head & np.concatenate((head[1:], [True]))
    active = order[~single]
    levels = [*levels[:-1], rank.astype(np.int32)]
    while len(active):
        ahead = _ahead(rank, text, k)[active]
        by = np.lexsort((ahead, rank[active]))
        active, ahead = active[by], ahead[by]
        group = rank[active]
        new_group = np.concatenate(([True], group[1:] != group[:-1]))
        at = np.arange(len(active))
        place = group + at - np.maximum.accumulate(np.where(new_group, at, 0))
        head = new_group | np.concatenate(([True], ahead[1:] != ahead[:-1]))
        rank = rank.copy()
        rank[active] = np.maximum.accumulate(np.where(head, place, 0))
        single = head & np.concatenate((head[1:], [True]))
        active = active[~single]
        k *= 2
        levels.append(rank.astype(np.int32))
    by_rank = np.empty(len(text), dtype=np.int64)
    by_rank[rank - 1] = np.arange(len(text))
    return by_rank, levels


def _common(left: np.ndarray, right: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """LCP of suffixes of one text each, by the ranks at falling powers of two."""
    lcp = np.zeros(len(left), dtype=np.int64)
    for e in reversed(range(len(levels))):
        rank = np.append(levels[e], 0)
        end = len(rank) - 1
        lcp += np.where(rank[np.minimum(left + lcp, end)] == rank[np.minimum(right + lcp, end)], 1 << e, 0)
    return lcp


def runs_of(codes: np.ndarray, text: np.ndarray, least: int, power: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs in texts laid end to end; ``text`` numbers the text of each word, ``codes`` its words."""
    if not len(codes):
        return []
    floor = min(max((power - 1) * q, least - q, 1) for q in range(1, least + 1))
    levels = [_ranks(text, codes)]
    while (2 << (len(levels) - 1)) <= floor:
        k = 1 << (len(levels) - 1)
        levels.append(_ranks(levels[-1], _ahead(levels[-1], text, k)))
    repeated = np.bincount(levels[-1])[levels[-1]] > 1
    chosen = np.zeros(int(text[-1]) + 1, dtype=bool)
    chosen[text[repeated]] = True
    at = np.flatnonzero(chosen[text])
    if not len(at):
        return []
    text, levels = text[at], [r[at] for r in levels]
    word = levels[0]
    order, levels = _sorted_suffixes(levels, text)
    left, right = order[:-1], order[1:]
    near = text[left] == text[right]
    left, right = left[near], right[near]
    lcp = _common(left, right, levels)
    strong = lcp >= floor
    left, right, lcp = left[strong], right[strong], lcp[strong]
    down = np.argsort(-lcp, kind="stable")
    words, found = word.tolist(), []
    for i, j, shared in kruskal(zip(lcp[down].tolist(), left[down].tolist(), right[down].tolist())):
        q = j - i
        if shared >= q and shared + q >= max(least, power * q) and (i == 0 or words[i - 1] != words[j - 1]):
            found.append((int(at[i]), shared + q, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts (null: none) and where each text's words begin, with the end of the last."""
    lists = pc.split_pattern_regex(pc.fill_null(texts, "").cast(pa.large_string()), WHITE)
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    offsets = lists.offsets.to_numpy()
    values = lists.values
    real = pc.greater(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    return values.filter(pa.array(real)), np.concatenate(([0], np.cumsum(real)))[offsets]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _collapse(texts: pa.Array, least: int, power: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Word counts, runs, and texts without the repetitions."""
    words, starts = split_words(texts)
    sizes = np.diff(starts)
    text = np.repeat(np.arange(len(sizes)), sizes)
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    found = runs_of(codes, text, least, power)
    edge = np.zeros(len(codes) + 1, dtype=np.int64)
    for start, length, q in found:
        edge[start + q] += 1
        edge[start + length] -= 1
    stay = np.cumsum(edge[:-1]) == 0
    ends = np.concatenate(([0], np.cumsum(stay)))[starts]
    kept = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), words.filter(pa.array(stay)))
    collapsed = pc.binary_join(kept, pa.scalar(" ", pa.large_string())).cast(pa.string())
    begin = np.array([r[0] for r in found], dtype=np.int64)
    owner = text[begin] if len(begin) else begin
    fields = [begin - starts[owner], *(np.array([r[c] for r in found], dtype=np.int64) for c in (1, 2))]
    bounds = np.searchsorted(owner, np.arange(len(sizes) + 1))
    listed = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(f, pa.int64()) for f in fields], names=["start", "length", "period"]))
    return pa.array(sizes, pa.int64()), listed.cast(_RUNS), collapsed


def find_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 6, power: int = 4) -> DataFrame:
    """One row per row of ``docs``: id_col, n_words, runs (start, length and period in words, by start and period), collapsed.

    A run is a stretch with smallest period q of at least ``least`` words and ``power`` (2 or more) periods that no neighbouring word extends.
    ``collapsed`` is the text's words, one space apart, without those that lie in a run after its first period.

    Null, empty and blank texts have no words, no runs and an empty collapsed text. Texts of any length are read whole, each by one task.
    Null ids and repeated rows stay rows of their own; an empty table gives none; other columns are ignored whatever their names.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), *_collapse(part.column(1), least, power)], names=["id", "n", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(work, f"id {kind}, n long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_words"), "runs", "collapsed")
