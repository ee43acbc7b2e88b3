"""Near-duplicate documents by MinHash bands and sequential Bayesian verification.

1. One pass over the texts gives each document the size and a 128-bit print of its shingle set, and band keys of a
   MinHash signature. Documents with equal sets are one class; its smallest id stands for it.
2. Band keys that two classes or more share are buckets. Buckets with the same members are one bucket.
3. A bucket's members meet in groups of bounded size. There, signatures are compared a batch at a time, a pair is given up once
   the posterior probability that it is similar enough falls under the chosen miss probability, and survivors that
   aren't yet connected are checked on their full sets. A group yields a spanning forest of its links, not pairs.
4. Buckets larger than a group first meet in disjoint groups. What is then still outside a bucket's main component
   meets every member of the bucket, again in bounded groups, so no pair of the bucket is left out.
5. Connected components of the links and of the classes give the answer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.llm.common import by_bytes, mix64, runs, store
from loreweave.operators.components import components

ROWS, BANDS = 5, 26  # a pair at similarity 0.85 shares no band with probability (1 - 0.85^5)^26 = 2e-7
BATCH, BATCHES = 32, 4  # hashes compared at a time, and how many times at most
MISS = 1e-7  # posterior probability of being similar enough at which a pair is given up
GROUP = 256  # members that meet at once
COPIES = 4 << 20  # bytes of sets that a task sends at once
SLOTS = 1 << 20  # of the broadcast table that thins texts
_ORDER = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _constants(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed).integers(0, 2**63, size=(2, n), dtype=np.uint64)
    return r[0] * np.uint64(2) + np.uint64(1), r[1]


class _Words(dict):
    """Word -> hash, of a worker; emptied when full and at the end of a task."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 48:
            if len(self) >= 200_000:
                self.clear()
            self[word] = h
        return h


_words = _Words()


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``size`` words; fewer words are one shingle, no words none.

    Words are what lies between ASCII white space, in lower case for A-Z.
    """
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    width = min(size, n)
    total = np.full(n - width + 1, np.uint64(width))
    for k in range(width):
        total = mix64(total * _ORDER[0] + h[k : n - width + 1 + k] * _ORDER[1] + _ORDER[2])
    return np.unique(total)


def signature(values: np.ndarray, seed: int, n: int) -> np.ndarray:
    """``n`` minima of the values under hash functions of ``seed``."""
    a, b = _constants(seed, n)
    out = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(values), 4096):
        out = np.minimum(out, (values[i : i + 4096, None] * a + b).min(axis=0))
    return out


@lru_cache(maxsize=16)
def fewest(similar: float, miss: float, batch: int, batches: int) -> tuple[int, ...]:
    """Least equal hashes after each batch with which a pair stays.

    With m of n equal and any similarity alike before, the posterior is Beta(m + 1, n - m + 1), and its part over
    ``similar`` is the probability of at most m successes in n + 1 trials.
    """
    out = []
    for k in range(1, batches + 1):
        n, below, m = k * batch + 1, 0.0, 0
        while (below := below + comb(n, m) * similar**m * (1 - similar) ** (n - m)) < miss:
            m += 1
        out.append(m)
    return tuple(out)


def _profile(batches: Iterable[pa.RecordBatch], size: int, rows: int, bands: int) -> Iterator[pa.RecordBatch]:
    salt = np.arange(1, bands + 1, dtype=np.uint64) * _ORDER[0]
    for batch in (part for whole in batches for part in by_bytes(whole, "_text")):
        sizes, high, low, keys = [], [], [], []
        for text in batch.column("_text"):
            s = shingles(text.as_py(), size)
            sizes.append(len(s))
            high.append(mix64(s ^ _ORDER[0]).sum(dtype=np.uint64))
            low.append(mix64(s ^ _ORDER[1]).sum(dtype=np.uint64))
            if len(s):
                sig = signature(s, 1, rows * bands).reshape(bands, rows)
                key = salt.copy()
                for r in range(rows):
                    key = mix64(key * _ORDER[1] + sig[:, r])
                keys.append(key.view(np.int64))
            else:
                keys.append(np.empty(0, np.int64))
        offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
        flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("_id"), pa.array(sizes, pa.int64()), pa.array(np.array(high, np.uint64).view(np.int64)),
                pa.array(np.array(low, np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
            ],
            names=["_id", "_n", "_high", "_low", "_keys"],
        )
    _words.clear()


def _sets(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The shingle set of each document, once for each of its groups; at most ``COPIES`` bytes of sets, or one set, at a time."""
    for batch in (part for whole in batches for part in by_bytes(whole, "_text", rows=64)):
        sets = [shingles(t.as_py(), size).tobytes() for t in batch.column("_text")]
        groups = batch.column("groups")
        rows = np.repeat(np.arange(batch.num_rows), groups.value_lengths().to_numpy(zero_copy_only=False))
        flat = groups.flatten()
        total = np.cumsum(np.array([len(x) for x in sets], np.int64)[rows])
        a = 0
        while a < len(rows):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + COPIES, side="right")))
            some, at = flat.slice(a, b - a), rows[a:b]
            yield pa.RecordBatch.from_arrays(
                [
                    some.field("group"), batch.column("id").take(pa.array(at)), some.field("role"), some.field("part"),
                    pa.array([sets[i] for i in at.tolist()], pa.binary()),
                ],
                names=["group", "id", "role", "part", "set"],
            )
            a = b
    _words.clear()


class Forest:
    """Union-find over the places of a group."""

    def __init__(self, start: Iterable[int]) -> None:
        self.up = list(start)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def survivors(sets: list[np.ndarray], pairs: np.ndarray, least: int, seed: int = 2) -> Iterator[tuple[int, int]]:
    """Pairs (rows of places) that the batches leave, most equal hashes first. ``least`` is the similarity in percent."""
    n = np.array([len(s) for s in sets])
    a, b = n[pairs[:, 0]], n[pairs[:, 1]]
    pairs = pairs[100 * np.minimum(a, b) >= least * np.maximum(a, b)]
    equal = np.zeros(len(pairs), np.int32)
    for k, floor in enumerate(fewest(least / 100, MISS, BATCH, BATCHES)):
        if not len(pairs):
            return
        used = np.unique(pairs)
        sig = np.zeros((len(sets), BATCH), np.uint32)
        for i in used:
            sig[i] = signature(sets[i], seed + k, BATCH) >> np.uint64(32)
        for i in range(0, len(pairs), 8192):
            p = pairs[i : i + 8192]
            equal[i : i + 8192] += (sig[p[:, 0]] == sig[p[:, 1]]).sum(axis=1, dtype=np.int32)
        stay = equal >= floor
        pairs, equal = pairs[stay], equal[stay]
    for i in np.argsort(-equal, kind="stable"):
        yield int(pairs[i, 0]), int(pairs[i, 1])


def similar(a: np.ndarray, b: np.ndarray, least: int) -> bool:
    both = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
    return 100 * both >= least * (len(a) + len(b) - both)


def _meet(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Links of each group that join what isn't joined yet. Members with ``role`` 1 meet those with role 0 and each other;
    members of role 0 meet each other only in groups of which all have role 0. Every member is hung on the root of its tree."""
    for group in runs(batches, "group"):
        ids, role, part = (group.column(c).to_numpy() for c in ("id", "role", "part"))
        if len(ids) < 2:
            continue
        sets = [np.frombuffer(s.as_py(), np.uint64) for s in group.column("set")]
        first = {p: i for i, p in reversed(list(enumerate(part.tolist())))}
        forest = Forest(first[p] for p in part.tolist())
        i, j = np.triu_indices(len(ids), 1)
        keep = part[i] != part[j]
        if role.any():
            keep &= (role[i] == 1) | (role[j] == 1)
        for x, y in survivors(sets, np.stack([i[keep], j[keep]], axis=1), least):
            if forest.root(x) != forest.root(y) and similar(sets[x], sets[y], least):
                forest.join(x, y)
        tree = [(int(ids[i]), int(ids[forest.root(i)])) for i in range(len(ids))]
        out = [p for p in tree if p[0] != p[1]]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _links(members: DataFrame, text: DataFrame, shingle: int, least: int) -> DataFrame:
    """Links of ``members`` (id, group, role, part); their sets are made from ``text`` (_id, _text) again.

    Texts are first thinned where they are read, by a table of at most ``SLOTS`` hash values of the ids wanted, so that hardly
    more than the members' texts are shuffled.
    """
    n = max(1, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    wanted, _ = store(members.groupBy("id").agg(F.collect_list(F.struct("group", "role", "part")).alias("groups")))
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS))
    slots = F.broadcast(wanted.select(slot("id").alias("_slot")).distinct())
    near = text.join(slots, slot("_id") == F.col("_slot"), "left_semi")
    schema = "group long, id long, role int, part long, set binary"
    rows = near.join(wanted, F.col("_id") == F.col("id")).select("id", "_text", "groups").mapInArrow(lambda it: _sets(it, shingle), schema)
    meet: Callable = lambda it: _meet(it, least)
    found, _ = store(rows.repartition(n, "group").sortWithinPartitions("group", "id", "role").mapInArrow(meet, "a long, b long"))
    return found


def find(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: int = 80,
    rows: int = ROWS, bands: int = BANDS, group: int = GROUP,
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (smallest id reachable by links), kept (id = component_id).

    Two documents are linked if 100 * |A and B| >= ``least`` * |A or B| for their sets of ``shingle``-word shingles, checked on the
    full sets. Null, empty and blank texts have no shingles and no links, and are kept. A null id has no links; its
    component and kept are null. Rows that repeat an id are one document if their texts are equal, and else documents
    of their own sets that share the id. An empty table gives an empty result; other columns are ignored.
    """
    text = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    profile = lambda it: _profile(it, shingle, rows, bands)
    seen, _ = store(text.mapInArrow(profile, "_id long, _n long, _high long, _low long, _keys array<long>"))
    usable = seen.filter((F.col("_n") > 0) & F.col("_id").isNotNull())
    print_ = ["_high", "_low", "_n"]
    classes, _ = store(usable.groupBy(*print_).agg(F.min("_id").alias("_rep"), F.count(F.lit(1)).alias("_copies")))
    one = usable.join(classes.select(F.col("_rep").alias("_r")), F.col("_id") == F.col("_r"), "left_semi")
    banded = one.select(F.col("_id").alias("id"), F.explode("_keys").alias("key")).distinct()
    buckets = banded.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("id")).alias("x"), F.sum(F.xxhash64("id", F.lit(1)) % (1 << 40)).alias("s")
    )
    same = buckets.filter(F.col("size") > 1).groupBy("size", "x", "s").agg(F.min("key").alias("bucket"))
    chosen, _ = store(same.select("bucket", "size"))
    held, _ = store(banded.join(chosen, F.col("key") == F.col("bucket")).select("bucket", "size", "id"))
    blocks = F.ceil(F.col("size") / group)
    held = held.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), blocks))
    alone = held.select("id", F.xxhash64("bucket", "block").alias("group"), F.lit(0).alias("role"), F.col("id").alias("part"))
    links = _links(alone, text, shingle, least)
    linked, _ = store(components(links))
    hot = held.filter(F.col("blocks") > 1)
    if not hot.isEmpty():
        known = linked.select(F.col("id").alias("a"), F.col("component").alias("b"))
        linked, _ = store(components(known.unionByName(_rest(hot, linked, text, shingle, least, group))))
    rep = classes.join(linked, F.col("_rep") == F.col("id"), "left")
    answer, _ = store(
        rep.filter((F.col("_copies") > 1) | F.col("component").isNotNull())
        .select(*[F.col(c).alias(f"c{c}") for c in print_], F.coalesce("component", "_rep").alias("_component"))
    )
    match = [F.col(c) == F.col(f"c{c}") for c in print_]
    out = seen.join(answer, match, "left")
    component = F.when(F.col("_id").isNotNull(), F.coalesce("_component", "_id"))
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), component.alias("component_id"), (F.col("_id") == component).alias("kept"))


def _rest(hot: DataFrame, linked: DataFrame, text: DataFrame, shingle: int, least: int, group: int) -> DataFrame:
    """Links of large buckets between what lies outside a bucket's main component and everything in the bucket."""
    part = hot.join(linked, "id", "left").withColumn("part", F.coalesce("component", "id"))
    placed, _ = store(part.select("bucket", "blocks", "block", "id", "part"))
    counts = placed.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"))
    main, _ = store(counts.groupBy("bucket").agg(F.max_by("part", F.struct("n", -F.col("part"))).alias("main"), (F.sum("n") - F.max("n")).alias("others")))
    mixed = placed.join(main.filter(F.col("others") > 0).withColumnRenamed("bucket", "_b"), F.col("bucket") == F.col("_b"))
    sides = F.ceil(F.col("others") / group)
    outer = F.col("part") != F.col("main")
    every = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    home = mixed.select("bucket", "id", "part", F.lit(0).alias("role"), F.col("block").alias("i"), F.explode(every(sides)).alias("j"))
    guest = mixed.filter(outer).select(
        "bucket", "id", "part", F.lit(1).alias("role"), F.explode(every(F.col("blocks"))).alias("i"), F.pmod(F.xxhash64("id", F.lit(8)), sides).alias("j")
    )
    both = home.unionByName(guest).groupBy("bucket", "i", "j", "id", "part").agg(F.max("role").alias("role"))
    return _links(both.select("id", F.xxhash64("bucket", "i", "j").alias("group"), "role", "part"), text, shingle, least)


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are kept: one document of each group, those without links too.

    A document is an id with a text. Of a group the smallest id is kept, then the one of smallest hash, and one of rows that repeat
    both; an id with several texts is as many documents. Rows with a null id meet all others, but only make way for each
    other: one of a group is kept beside the one with an id. Blank texts with a null id are all kept.
    """
    own = F.col(id_col).cast("long")
    row = F.xxhash64(own.isNull(), own, F.col(text_col))
    rows = docs.select(row.alias("_row"), own.alias("_own"), F.col(text_col).alias("_body"))
    found = find(rows, id_col="_row", text_col="_body", **how)
    groups = found.groupBy("_row").agg(F.min("component_id").alias("_group"), F.min("n_shingles").alias("_n"))
    names = rows.groupBy("_row").agg(F.min("_own").alias("_own"), F.count(F.lit(1)).alias("_times"))
    named, _ = store(names.join(groups, "_row"))
    best = named.groupBy("_group", F.col("_own").isNull()).agg(F.min(F.struct("_own", "_row")).alias("_best"))
    blank = F.col("_own").isNull() & (F.col("_n") == 0)
    kept, _ = store(
        named.join(best.select(F.col("_best._row").alias("_first")), F.col("_row") == F.col("_first"), "left_semi")
        .select(F.col("_row").alias("_kept"), ((F.col("_times") > 1) & ~blank).alias("_again"))
    )
    whole = docs.select(row.alias("_row"), F.struct("*").alias("_doc"))
    same = F.col("_row") == F.col("_kept")
    once = whole.join(kept.filter(~F.col("_again")), same, "left_semi").select("_doc.*")
    again = whole.join(kept.filter("_again"), same, "left_semi").groupBy("_row").agg(F.first("_doc").alias("_doc")).select("_doc.*")
    return once.unionByName(again)
