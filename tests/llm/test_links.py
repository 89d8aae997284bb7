"""Near-duplicates, components and top-k against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import topk
from keyloom.llm.components import components
from keyloom.llm.minhash import deduplicated, near_duplicates
from keyloom.llm.shared import meet
from keyloom.llm.topk import top_k

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 80)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    wanted = roots({n for e in edges for n in e}, edges)
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert found == {n: wanted[n] for n in linked}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def shingle_set(text):
    words = WORDS((text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, percent):
    rng = random.Random(5)
    texts = []
    for _ in range(25):
        base = [rng.choice("abcdefghij") + str(rng.randrange(400)) for _ in range(rng.choice([3, 40, 150, 400]))]
        for _ in range(rng.randrange(1, 9)):
            copy = base.copy()
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    rows = list(enumerate(texts, start=3)) + [(1, None), (2, "  ")]
    found = {r.doc_id: r for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()}
    sets = {i: shingle_set(t) for i, t in rows}
    edges = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    wanted = roots(sets, edges)
    assert {i: r.component_id for i, r in found.items()} == wanted
    assert all(r.n_shingles == len(sets[i]) and r.kept == (i == wanted[i]) for i, r in found.items())


def test_odd_documents(odd, empty):
    rows = near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    component = {r.doc_id: r.component_id for r in rows}
    assert component[4] == 1 and component[2] == 2 and component[3] == 3 and component[None] is None
    assert near_duplicates(empty).count() == 0
    kept = deduplicated(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "5", "6", "7", "8", "None"]


def test_top_k(spark):
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(700, 16)).astype(np.float32)
    vectors[300:420] = vectors[0]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(900, None), (901, [None] * 16), (902, [float("nan")] * 16), (903, [float("inf")] * 16), (1000, []), (1100, [1.0, 2.0]), (None, vectors[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    found = sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 100 == 0).collect())
    x = np.floor(1024 * vectors.astype(float)).astype(np.int64)
    wanted = []
    for q in range(0, 700, 100):
        best = sorted((-int(x[q] @ x[c]), c) for c in range(700) if c != q)[:10]
        wanted += [(q, i, c, -s) for i, (s, c) in enumerate(best, start=1)]
    assert found == sorted(wanted)
    assert top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_fewer_candidates_than_k(spark):
    df = spark.createDataFrame([(100, [1.0]), (1, [2.0]), (2, [-1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, top_k(df, F.col("vec_id") % 100 == 0).collect())) == [(100, 1, 1, 1024 * 2048), (100, 2, 2, -1024 * 1024)]


def test_top_k_of_repeated_ids(spark):
    """Rows that share an id but not a vector are all candidates and all queries."""
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(600, 8)).astype(np.float32)
    ids = np.where(np.arange(600) % 3 == 0, 100, np.arange(600) % 250)  # a third has the id of a query
    ids[::50] = 7
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<float>")
    x = np.floor(1024 * vectors.astype(float)).astype(np.int64)
    wanted = []
    for q in {int(i) for i in ids if i % 100 == 0}:
        best = sorted((-int(x[a] @ x[c]), int(ids[c])) for a in np.flatnonzero(ids == q) for c in np.flatnonzero(ids != q))[:10]
        wanted += [(q, i, c, -s) for i, (s, c) in enumerate(best, start=1)]
    assert sorted(map(tuple, top_k(df, F.col("vec_id") % 100 == 0).collect())) == sorted(wanted)


def test_lists_are_read_up_to_the_stop_rule():
    """Reading stops before the lists' end, and no better vector is left out."""
    rng = np.random.default_rng(3)
    x = (1024 * rng.normal(size=(3000, 6))).astype(np.int64)
    order = np.argsort(x, axis=0, kind="stable")
    lists = np.take_along_axis(x, order, axis=0)
    depths = []
    for i in range(0, 3000, 300):
        left, depth = topk.read_lists(order, lists, x[i], np.arange(3000) == i, 10)
        scores = x @ x[i]
        scores[i] = -(2**60)
        assert set(np.argsort(-scores)[:10]) <= set(left) and i not in left
        depths.append(depth)
    assert max(depths) < 3000


def test_meet_keeps_every_row(spark):
    """Rows of hot keys, of rare keys and without a fact."""
    rows = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(600)], "k long, x long")
    facts = rows.groupBy("k").agg(F.min("x").alias("least"), F.count(F.lit(1)).alias("_n")).where("k <> 3")
    got = sorted(map(tuple, meet(rows, facts, "k", 600).collect()))
    least = {}
    for i in range(600):
        least[0 if i % 3 else i] = min(least.get(0 if i % 3 else i, i), i)
    assert got == sorted((k, i, least[k]) for i in range(600) if (k := 0 if i % 3 else i) != 3)


def test_components_of_a_hub(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 400)] + [(i, 1000 + i) for i in range(300, 400)], "u long, v long")
    assert {r.component for r in components(edges).collect()} == {0} and components(edges).count() == 500
