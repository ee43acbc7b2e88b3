"""SentencePiece encoding and decoding by a forward pass over a trie of marked words.

A text is marked (a leading mark, every space a mark) and cut into words where no vocabulary piece can span the cut.
The distinct words of a batch are sorted, which lists the trie of their prefixes depth-first, and a forward pass keeps
one state per prefix position; a word starts from the states of the prefix that it shares with the word before it.

The pieces of a BPE model carry merge ranks, not probabilities, and the best path is the one the merges give. That path
has a local form: a row of pieces is the merge result exactly if every piece merges to itself and every two neighbours,
merged alone, stay apart. Two runs of merges can first meet at a border only by a merge that the two neighbours
alone would make as well. So each prefix has one last piece, found from the states before it, and the pass is a Viterbi
recursion whose step score is 0 or minus infinity. Step scores are kept per pair of pieces.
"""

from __future__ import annotations

import contextlib
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.llm.common import by_bytes

MARK = "▁"
NEVER = float("-inf")
INNER, START = -1, -2  # not a piece but the ending of one; what stands left of a word
MAX_KEY = 40  # characters of a word that is kept in the cache
CACHE = 300_000  # words in a worker's cache
PAIRS = 300_000  # pairs of pieces that are kept when the words are dropped

_worker: dict[str, Codec] = {}


class Codec:
    """Vocabulary, step scores and word cache of one model in one Python worker."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.unknown = model.unk_id()
        self.ids = {names[i]: i for i in plain}
        self.rank = {names[i]: model.get_score(i) for i in plain}
        self.names = names
        self.endings = {p[k:]: INNER for p in self.ids for k in range(1, len(p))}  # every ending of a piece
        self.endings.update(self.ids)
        self.byte = {int(names[i][1:-1], 16): i for i in range(n) if model.is_byte(i)}
        self.is_byte = {i for i in self.byte.values()}
        self.hidden = hidden = {i for i in range(n) if model.is_control(i)}
        values = {i: b for b, i in self.byte.items()}
        self.raw = [b"" if i in hidden else bytes([values[i]]) if i in values else names[i].replace(MARK, " ").encode() for i in range(n)]
        if self.unknown >= 0:
            self.raw[self.unknown] = " ⁇ ".encode()
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces of this model span words")
        alone = "" if any("\n" in p and len(p) > 1 for p in self.ids) else "\n"
        self.split = re.compile(f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" + ("|\n" if alone else ""))
        self.merges: dict[int, tuple[list[float], list[str], list[str]]] = {}
        self.step: defaultdict[int, dict[int, bool]] = defaultdict(dict)
        self.odd: dict[str, int] = {}  # characters without a piece get numbers after the vocabulary
        self.odd_names: list[str] = []
        self.cache: dict[str, tuple[int, ...]] = {}

    def history(self, text: str) -> tuple[list[float], list[str], list[str]]:
        """Merges of a short text by the definition (best-ranked neighbours first, leftmost of equals): the rank of each
        merge, ended by minus infinity, and the leftmost and rightmost part before each merge and at the end."""
        parts = list(text)
        ranks, lefts, rights = [], [parts[0]], [parts[-1]]
        while True:
            best, at = NEVER, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1], NEVER)
                if r > best:
                    best, at = r, i
            ranks.append(best)
            if at < 0:
                return ranks, lefts, rights
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            lefts.append(parts[0])
            rights.append(parts[-1])

    def name(self, piece: int) -> str:
        return self.names[piece] if piece < len(self.names) else self.odd_names[piece - len(self.names)]

    def _number(self, char: str) -> int:
        if char not in self.odd:
            self.odd[char] = len(self.names) + len(self.odd_names)
            self.odd_names.append(char)
        return self.odd[char]

    def _merges(self, piece: int) -> tuple[list[float], list[str], list[str]]:
        found = self.merges.get(piece)
        if found is None:
            found = self.merges[piece] = self.history(self.name(piece))
        return found

    def _first(self, piece: int) -> bool:
        """Whether a piece merges to itself."""
        return self._merges(piece)[1][-1] == self.name(piece)

    def _fits(self, left: int, piece: int) -> bool:
        """Whether two neighbours stay apart: at no time is a merge across their border the best of the three."""
        if not self._first(piece):
            return False
        if left == START:
            return True
        (ranks_a, _, rights), (ranks_b, lefts, _) = self._merges(left), self._merges(piece)
        i = j = 0
        while True:
            across, a, b = self.rank.get(rights[i] + lefts[j], NEVER), ranks_a[i], ranks_b[j]
            if across > a and across >= b and across > NEVER:
                return False
            if a == b == NEVER:
                return True
            if a >= b:
                i += 1
            else:
                j += 1

    def _ids(self, piece: int) -> tuple[int, ...]:
        if piece < len(self.names):
            return (piece,)
        data = self.name(piece).encode()
        return tuple(self.byte[b] for b in data) if self.byte else (self.unknown,)

    def forward(self, words: Iterable[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        """Ids of each of the sorted words."""
        ending, step, pieces = self.endings.get, self.step, len(self.names)
        before = ""
        last: list[int] = [START]  # piece that ends at each position of the current prefix, and where it starts
        start: list[int] = [0]
        for word in words:
            keep, most = 0, min(len(before), len(word))
            while keep < most and before[keep] == word[keep]:
                keep += 1
            del last[keep + 1 :], start[keep + 1 :]
            for end in range(keep + 1, len(word) + 1):
                begin = end - 1
                piece = ending(word[begin])
                if piece is None or piece < 0:
                    piece = self._number(word[begin])
                while True:
                    if piece >= 0:
                        known = step[last[begin]]
                        fits = known.get(piece)
                        if fits is None:
                            fits = known[piece] = self._fits(last[begin], piece)
                        if fits:
                            last.append(piece)
                            start.append(begin)
                            break
                    begin -= 1
                    piece = ending(word[begin:end]) if begin >= 0 else None
                    if piece is None:  # no piece ends like this, nor with anything longer
                        raise AssertionError(f"no piece ends at {end} of {word!r}")
            out: list[int] = []
            at = len(word)
            while at:
                out.append(last[at])
                at = start[at]
            out.reverse()
            before = word
            yield word, tuple(out) if max(out, default=0) < pieces else tuple(chain.from_iterable(map(self._ids, out)))

    def forget(self) -> None:
        """Empty the caches, so that an idle worker holds the vocabulary only."""
        self.cache.clear()
        self.step.clear()
        self.merges.clear()

    def words(self, text: str) -> list[str]:
        return self.split.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, texts: list[list[str]]) -> list[list[int]]:
        """Ids of texts given as lists of words."""
        cache = self.cache
        used = set(chain.from_iterable(texts))
        new = used.difference(cache)
        if len(cache) + len(new) > CACHE:  # what this group uses stays
            cache = self.cache = {w: cache[w] for w in used.difference(new)}
            if sum(map(len, self.step.values())) > PAIRS:
                self.step.clear()
                self.merges.clear()
        cache.update(self.forward(sorted(new)))
        out = [list(chain.from_iterable(map(cache.__getitem__, t))) for t in texts]
        for w in new:
            if len(w) > MAX_KEY:
                del cache[w]
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids; bytes that form no character become replacement characters, one each."""
        ids = list(ids)
        data = b"".join(map(self.raw.__getitem__, ids))
        text = None
        if self.hidden.isdisjoint(ids):
            with contextlib.suppress(UnicodeDecodeError):
                text = data.decode()
        if text is None:
            text = ""
            run = b""
            for i in [*ids, -1]:
                if i in self.is_byte:
                    run += self.raw[i]
                    continue
                while run:
                    size = next((k for k in range(1, 5) if _is_char(run[:k])), 0)
                    text += run[:size].decode() if size else "�"
                    run = run[size or 1 :]
                text += self.raw[i].decode() if i >= 0 else ""
        first = next((i for i in ids if self.raw[i]), None)
        return text[1:] if first is not None and self.names[first].startswith(MARK) else text


def _is_char(data: bytes) -> bool:
    try:
        return len(data.decode()) == 1
    except UnicodeDecodeError:
        return False


def codec(path: str) -> Codec:
    if path not in _worker:
        _worker[path] = Codec(path)
    return _worker[path]


CHUNK = 1 << 19  # characters whose words are encoded together


def _groups(texts: list[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= CHUNK:
            yield group
            group, size = [], 0
    if group:
        yield group


def _encode(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    coder = codec(path)
    for batch in (part for whole in batches for part in by_bytes(whole, "_text")):
        ids = batch.column("_id")
        done = 0
        texts = [t or "" for t in batch.column("_text").to_pylist()]
        for group in _groups(texts):
            found = coder.encode([coder.words(t) for t in group])
            sizes = np.fromiter(map(len, found), np.int32, len(found))
            flat = np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            same = [coder.decode(f) == t.replace(MARK, " ") for f, t in zip(found, group)]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(done, len(group)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                    pa.array(sizes.astype(np.int64)), pa.array(same),
                ],
                names=["_id", "ids", "n_tokens", "round_trip"],
            )
            done += len(group)
    coder.forget()


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ids (those of the library), n_tokens, and whether decoding gives the text back.

    A null or empty text has no ids and round-trips to the empty text. A mark character in a text decodes to a space,
    as in the library, and counts as such in ``round_trip``. Null ids and repeated rows stay, an empty table gives none, other
    columns are ignored. Nothing is shuffled; a worker holds one batch, its words and a bounded cache.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    out = rows.mapInArrow(lambda it: _encode(it, model), f"_id {kind}, ids array<int>, n_tokens long, round_trip boolean")
    return out.withColumnRenamed("_id", id_col)


def _decode(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    coder = codec(path)
    for batch in batches:
        texts = [None if ids is None else coder.decode(ids) for ids in batch.column("_ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(texts, pa.string())], names=["_id", "text"])


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ``encoded``: id and text. Null ids give a null text, an empty list the empty text."""
    rows = encoded.select(F.col(id_col).alias("_id"), F.col(ids_col).cast("array<int>").alias("_ids"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(lambda it: _decode(it, model), f"_id {kind}, text string").withColumnRenamed("_id", id_col)
