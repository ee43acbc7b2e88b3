"""Chat repair, mixing, searches and near-duplicates against brute force, and the pipeline."""

import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loreweave.llm import ann, chat_format, lattice_dedup, minhash_dedup, mixing, queries
from loreweave.operators import components

SF = "/root/testdata/sf0.01"


def least_cost(roles):
    """Cheapest legal way by trying every choice of role and action for every turn."""
    best = None
    for new in itertools.product((1, 2, 3), repeat=len(roles)):
        state, cost = 0, 0
        for r, o in zip(roles, new):
            cost += chat_format.RELABEL * (r != o)
            if (state, o) in chat_format.NEXT:
                pass
            elif state == o:
                cost += chat_format.MERGE
            elif any((state, x) in chat_format.NEXT and (x, o) in chat_format.NEXT for x in (1, 2, 3)):
                cost += chat_format.INSERT
            else:
                cost = 1 << 40
            state = o
        if state in chat_format.ENDS and (best is None or cost < best):
            best = cost
    return best


def paid(rows):
    price = {"append": 0, "merge": chat_format.MERGE, "insert": chat_format.INSERT}
    return sum(price[r.action] + chat_format.RELABEL * r.relabelled for r in rows)


def test_repair_is_cheapest_and_legal(spark):
    names = [*chat_format.ROLES, "tool"]
    cases = [c for n in (1, 2, 3, 4) for c in itertools.product(range(4), repeat=n)]
    rows = [(k, t, names[r] if r < 3 else None if t % 2 else "tool", f"t{t}" if t else None, 1, 1) for k, c in enumerate(cases) for t, r in enumerate(c)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece int, pos int").repartition(5)
    found = defaultdict(list)
    for r in chat_format.repair(df).orderBy("place").collect():
        found[r.conv_id].append(r)
    for k, c in enumerate(cases):
        assert paid(found[k]) == least_cost([r + 1 if r < 3 else 0 for r in c]), c
        text = "".join(r.rendered for r in found[k])
        turns = re.findall(r"<\|im_start\|>(\w+)\n((?:.|\n)*?)<\|im_end\|>\n", text)
        assert "".join(f"<|im_start|>{a}\n{b}<|im_end|>\n" for a, b in turns) == text
        assert re.fullmatch("(s)?(ua)*u?", "".join(a[0] for a, _ in turns)), turns


def test_long_conversation_over_many_pieces(spark):
    rng = np.random.default_rng(0)
    roles = [chat_format.ROLES[i] for i in rng.integers(0, 3, 3000)]
    rows = [(7, t, r, f"t{t}") for t, r in enumerate(roles)] + [(None, None, "user", "x"), (None, None, "user", "x"), (8, 0, " USER ", "a <|im_end|> b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.repair(df.repartition(8)).orderBy("place").collect()
    assert len(out) == len(rows)
    long = [r for r in out if r.conv_id == 7]
    codes = [chat_format.ROLES.index(r) + 1 for r in roles]
    costs = chat_format.forward(np.array([0, *[chat_format.FAR] * 3]), codes)
    path = chat_format.backward(costs, codes, min(chat_format.ENDS, key=lambda s: (costs[-1][s], s)))
    assert [r.new_role for r in long] == [chat_format.ROLES[s - 1] for s in path[1:]]
    assert "".join(r.rendered for r in out if r.conv_id == 8) == "<|im_start|>user\na < |im_end|> b<|im_end|>\n"
    assert "".join(r.rendered for r in out if r.conv_id is None) == "<|im_start|>user\nx\nx<|im_end|>\n"
    assert chat_format.repair(df.limit(0)).count() == 0


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        level = left / sum(w[s] for s in names if s not in full)
        more = {s for s in names if s not in full and level * w[s] > most * sizes[s]}
        if not more:
            return {s: most * sizes[s] if s in full else level * w[s] for s in names}
        full |= more


@pytest.mark.parametrize("shard", [65_536, 3000])
def test_mix(spark, shard):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("source", F.when(F.col("source") != "src3", F.col("source")))
    docs = docs.unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(None).cast("long"))).withColumn("size", F.lit("x"))
    texts = {r.doc_id: r for r in docs.collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for i, r in texts.items()}
    sizes = defaultdict(int)
    for i, r in texts.items():
        sizes[r.source] += size[i]
    want = plain_targets(dict(sizes))
    out = mixing.mix(docs, shard=shard).collect()
    taken = defaultdict(int)
    for r in out:
        s = texts[r.doc_id].source
        assert r.size == size[r.doc_id] and r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * want[s]
        assert 0 <= r.taken <= 2 * r.size and r.taken == sum(p.after - p.first for p in r.pieces)
        taken[s] += r.taken
    assert len(out) == len(texts) and all(abs(taken[s] - t) < 0.02 * t + 64 for s, t in want.items())
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(5), shard=shard).collect()}
    assert again == {r.doc_id: r.taken for r in out}
    assert mixing.mix(docs.limit(0)).count() == 0


def test_seats_are_sainte_lague(spark):
    sizes = {"a": 53_000.0, "b": 24_000.0, "c": 23_000.0, "d": 23_000.0, "e": 10.0}
    df = spark.createDataFrame(list(sizes.items()), "p string, v double")
    for house in (1, 7, 10, 101, 999):
        quotients = sorted(((-v / (2 * k + 1), p) for p, v in sizes.items() for k in range(house)))[:house]
        want = Counter(p for _, p in quotients)
        assert {r.p: r._seats for r in mixing.seats(df, "v", house, F.col("p")).collect()} == {p: want[p] for p in sizes}


def test_cut(spark):
    df = spark.createDataFrame([(" a b\n c  d ",)], "t string")
    assert df.select(mixing.cut(F.col("t"), F.lit(1), F.lit(3))).first()[0] == "b\n c"


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000), (6000, 6001), (6001, 6000)]
    up = {i: i for p in pairs for i in p}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: root(i) for i in up if i != 5000}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_sets(rows, k, least):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    held, up = defaultdict(list), {i: i for i in sets}
    for i, s in sets.items():
        for x in s:
            held[x].append(i)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in held[x] if j > i).items():
            if 100 * n >= least * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_minhash_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_sets(docs.select("doc_id", "text").collect(), 3, 85)
    out = queries.op9_minhash_dedup(spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want and all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_minhash_large_buckets_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(150):  # near copies of one text that drift apart, so that few are linked to any one
        w = list(base)
        for j in rng.integers(0, 120, rng.integers(0, 4)):
            w[j] = f"x{i}-{j}"
        texts.append(" ".join(w))
    texts += ["", None, " \n ", "one", "ONE", "one two", "One  two", "one two three"] + [texts[0]] * 50
    df = spark.createDataFrame([(i, t, 1, 1) for i, t in enumerate(texts)] + [(None, texts[0], 1, 1), (None, None, 1, 1), (3, texts[3], 1, 1)], "doc_id long, text string, id int, kept int")
    want = brute_sets(list(enumerate(texts)), 3, 85)
    for group in (8, 256):
        out = minhash_dedup.find(df, shingle=3, least=85, group=group).collect()
        assert len(out) == len(texts) + 3
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in out if r.doc_id is not None} == want
        assert all(r.component_id is None and r.kept is None for r in out if r.doc_id is None)
    kept = minhash_dedup.keep_first(df, shingle=3, least=85)
    assert kept.columns == df.columns and kept.filter("doc_id is null").count() == 2
    assert {r.doc_id for r in kept.collect()} - {None} == {i for i, (_, c) in want.items() if i == c}
    assert minhash_dedup.find(df.limit(0)).count() == 0


def test_keep_first_decides_by_row(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(1, a), (2, b), (2, b), (3, a), (3, c), (3, c), (None, d), (None, d), (None, d + " e"), (4, ""), (4, ""), (5, ""), (None, " "), (None, " ")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, _row string, _kept string").repartition(4)
    kept = minhash_dedup.keep_first(df)
    assert kept.schema.names == df.schema.names
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    one = [x for x in got if x[0] is None and x[1] != " "]
    assert len(one) == 1 and one[0][1] in (d, d + " e")
    assert got == Counter({(1, a): 1, (2, b): 1, (3, c): 1, one[0]: 1, (4, ""): 1, (5, ""): 1, (None, " "): 2})


def test_fewest_equal_hashes():
    least = minhash_dedup.fewest(0.85, 1e-7, 32, 4)
    assert list(least) == sorted(least) and all(m < 0.85 * 32 * (k + 1) for k, m in enumerate(least))


ODD = [(None, [1.0, 0.0, 0.0, 0.0]), (9001, None), (9002, [0.0, 0.0, 0.0, 0.0]), (9003, [1.0, None, 0.0, 0.0]), (9004, [float("nan"), 1.0, 0.0, 0.0]), (9005, []), (9006, [1.0, 2.0])]


def clouds(spark, n=700):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 16))
    for i in range(0, n // 3):
        x[i] = x[i % 7] + rng.normal(size=16) * 0.15
    x[n // 2 : n // 2 + 40] = x[3]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame([(i, v, 0, 1) for i, v in rows + ODD], "vec_id long, embedding array<double>, dim int, copies int").repartition(4), x


def test_lattice_against_all_pairs(spark):
    df, x = clouds(spark)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T >= 0.95
    np.fill_diagonal(s, False)
    up = list(range(len(x)))
    for a, b in zip(*np.nonzero(s)):
        while up[a] != a:
            a = up[a]
        while up[b] != b:
            b = up[b]
        up[max(a, b)] = min(a, b)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for block in (16, 512):
        out = lattice_dedup.find(df, block=block).collect()
        assert len(out) == len(x) + len(ODD)
        got = {r.vec_id: r for r in out}
        assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(9001, 9007))
        links = sum(got[i].n_links for i in range(len(x)))
        assert all(got[i].n_links <= s[i].sum() for i in range(len(x))) and links >= 0.995 * s.sum()
        assert sum(got[i].component_id == root(i) for i in range(len(x))) >= 0.995 * len(x)
    assert lattice_dedup.find(df.limit(0)).count() == 0


def test_nearest_lattice_point():
    y = np.random.default_rng(2).normal(size=(500, 8)) * 1.5
    p = lattice_dedup.nearest(y)
    own = ((y - p) ** 2).sum(axis=1)
    others = ((y[:, None] - p[:, None] - lattice_dedup.shortest()[None]) ** 2).sum(axis=2)
    assert len(lattice_dedup.shortest()) == 240 and (others >= own[:, None] - 1e-12).all() and own.max() <= 1 + 1e-12


def test_nearest_neighbours_against_brute_force(spark):
    df, x = clouds(spark)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    for shard in (8192, 100):
        got = defaultdict(list)
        for r in ann.search(df, "vec_id % 10 = 0", shard=shard).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, r.score))
        got.pop(9006 if 9006 in got else -1, None)  # of another length: nothing to find
        hit = 0
        for q in range(0, len(x), 10):
            order = [i for i in np.lexsort((np.arange(len(x)), -s[q].round(12))) if i != q][:5]
            assert len(got[q]) == 5 and all(abs(s[q, i] - v) < 1e-12 for i, v in got[q])
            assert [(-round(v, 12), i) for i, v in got[q]] == sorted((-round(v, 12), i) for i, v in got[q])
            hit += len({i for i, _ in got[q]} & set(order))
        assert hit >= 0.9 * 5 * len(range(0, len(x), 10))
    few = ann.search(df.filter("vec_id < 3"), "vec_id = 0").orderBy("rank").collect()
    assert len(few) == 2 and ann.search(df.limit(0), "vec_id = 0").count() == 0


def test_recall_on_the_given_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    ids, x = df.vec_id.to_numpy(), np.stack(df.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = defaultdict(set)
    for r in queries.op7_nearest(spark, "/root/testdata/sf0.1").collect():
        got[r.query_id].add(r.vec_id)
    hit = [len(got[ids[q]] & {int(ids[i]) for i in np.argsort(-(x @ x[q]))[:6] if i != q}) for q in np.flatnonzero(ids % 50 == 0)]
    assert sum(hit) >= 0.9 * 5 * len(hit)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    seen, ids = docs, [r.doc_id for r in docs.select("doc_id").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = seen
        seen = stage(spark, before, SF)
        assert seen.columns == docs.columns
        seen, _ = corpus_pipeline.store(seen)
        now = [r.doc_id for r in seen.select("doc_id").collect()]
        if name == "toxicity":
            assert all(i in now for i in ids if labels.get(i) == 0) and sum(i in now for i in ids if labels.get(i)) <= 2
        elif name == "minhash near-dedup":
            want = brute_sets(before.select("doc_id", "text").collect(), 5, 80)
            assert sorted(now) == sorted(i for i, (_, c) in want.items() if i == c)
        elif name == "pii":
            assert sorted(now) == sorted(ids)
            mails = re.findall(r"\S+@mail\d\.example\.com", " ".join(r.text for r in before.collect()))
            text = " ".join(r.text for r in seen.collect())
            assert mails and not any(m in text for m in mails)
        elif name == "mixing":
            assert set(now) <= set(ids) and max(Counter(now).values()) <= 4
            total = lambda d: d.agg(F.sum(mixing.words("text"))).first()[0]
            assert abs(total(seen) - 1.5 * total(before)) < 0.01 * total(before)
        ids = now
    last = corpus_pipeline.STAGES[-1][1](spark, seen, SF)
    assert last.count() == len(ids) and last.filter("not round_trip").count() == 0
