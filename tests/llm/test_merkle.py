"""Merkle manifest against a tree built in plain Python."""

import hashlib
import random

from pyspark.sql import functions as F

from loreweave.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*fields):
    return h(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def climb(nodes, fanout):
    """Root of the nodes and the (before, after) steps of each of them."""
    steps = [[] for _ in nodes]
    below = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, kept = [], []
        for a in range(0, len(nodes), fanout):
            run = nodes[a : a + fanout]
            for j in range(len(run)):
                for i in below[a + j]:
                    steps[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(h(*run))
            kept.append([i for b in below[a : a + fanout] for i in b])
        nodes, below = up, kept
    return nodes[0], steps


def model(rows, fanout):
    leaves = [(r[2], r[0], leaf(*r), leaf(*r[:4], r[4] and r[4].replace("A", "a"))) for r in rows]
    groups, out = sorted({x[0] for x in leaves}, key=lambda g: (g is not None, (g or "").encode())), []
    trees = []
    for g in groups:
        own = sorted((x for x in leaves if x[0] == g), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
        trees.append((own, *climb([x[2] for x in own], fanout)))
    root, over = climb([t[1] for t in trees], fanout)
    for (own, subroot, steps), above in zip(trees, over):
        for x, path in zip(own, steps):
            path, folded = path + above, x[3]
            for before, after in path:
                folded = h(before, folded, after)
            out.append((x[1], x[2], subroot, root, "".join(b + a for b, a in path), folded))
    return out


def check(spark, rows, fanout):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("key", F.lit(1)).withColumn("pos", F.lit(2))
    changed = F.translate("text", "A", "a")
    got = merkle.manifest(df.repartition(7), altered={"text": changed}, fanout=fanout)
    folded = merkle.fold(F.coalesce("altered_leaf", "leaf"), F.col("path"))
    got = got.select("doc_id", "leaf", "subroot", "root", merkle.siblings(F.col("path")), folded).collect()
    assert sorted(map(tuple, got), key=str) == sorted(model(rows, fanout), key=str)


def test_trees_of_many_heights(spark):
    rng = random.Random(5)
    langs = [None, "", *[f"l{i}" for i in range(9)]]
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, "s"]), g, rng.choice([None, 7]), rng.choice([None, "", "A é", "x" * 70_000, "aA"]))
            for g, n in zip(langs, (1, 8, 9, 64, 65, 130, 1, 2, 3, 7, 17)) for _ in range(n)]
    check(spark, [*rows, *rows[:40]], 8)


def test_other_fanout_and_lone_groups(spark):
    rows = [(i, "s", "l", 1, "A" if i % 3 else "b") for i in range(11)]
    check(spark, rows, 2)
    check(spark, rows[:1], 8)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.manifest(df).count() == 0
