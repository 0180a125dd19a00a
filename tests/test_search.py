"""Search, selection, graph and consolidation against plain versions."""

from __future__ import annotations

import math
import random

import numpy as np

from memspark.operators.consolidate import clusters, similar_pairs
from memspark.operators.graph import edges, neighbourhood, pagerank, upserted
from memspark.operators.ordered import dense_position, prefix_sum
from memspark.operators.search import bm25_hits, fuse, vector_hits
from memspark.operators.select import char_budget, demote_interference, mmr
from memspark.operators.skew import join_groups


def vectors(n, seed=1):
    r = random.Random(seed)
    return [(i, r.choice([None, [], [0.0, 0.0, 0.0], [1.0, 2.0]]) if r.random() < 0.15 else [r.gauss(0, 1) for _ in range(3)]) for i in range(n)]


def test_knn_against_brute_force(spark):
    corpus, qs = vectors(300), [(1000 + i, v) for i, v in vectors(12, 2)]
    got = vector_hits(spark.createDataFrame(corpus, "row_no bigint, vector array<float>"), spark.createDataFrame(qs, "query_no bigint, vector array<float>"), 5)
    have = {(r.query_no, r.rank): r.row_no for r in got.collect()}
    want = {}
    unit = lambda v: np.float32(v).astype(float) / np.linalg.norm(np.float32(v).astype(float))
    ok = lambda v: v is not None and any(v)
    for q, v in qs:
        if ok(v):
            s = sorted((-round(float(unit(v) @ unit(x)), 9), i) for i, x in corpus if ok(x) and len(x) == len(v))[:5]
            want |= {(q, k + 1): i for k, (_, i) in enumerate(s)}
    assert have == want
    empty = spark.createDataFrame([], "row_no bigint, vector array<float>")
    assert vector_hits(empty, spark.createDataFrame(qs, "query_no bigint, vector array<float>"), 5).count() == 0


def test_bm25_against_formula(spark):
    docs = [(1, "red red blue"), (2, "blue"), (3, None), (4, ""), (5, "green red")]
    got = {(r.row_no): r.raw for r in bm25_hits(spark.createDataFrame(docs, "row_no bigint, text string"), spark.createDataFrame([(9, "Red, red green!"), (10, None), (11, "...")], "query_no bigint, text string"), 10).collect()}
    avg = (3 + 1 + 0 + 0 + 2) / 5
    idf = lambda df: math.log(1 + (5 - df + 0.5) / (df + 0.5))
    w = lambda tf, n: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg))
    assert set(got) == {1, 5} and abs(got[1] - idf(2) * w(2, 3)) < 1e-8 and abs(got[5] - (idf(2) * w(1, 2) + idf(1) * w(1, 2))) < 1e-8


def test_fusion_rules(spark):
    hits = [(1, "vector", 1, 0.9, 0.9, 1), (1, "bm25", 1, 9.0, 0.86, 1), (1, "bm25", 2, 2.0, 0.6, 2), (1, "l0", 3, 0.5, 0.7, 1)]
    got = {r.row_no: r.fused for r in fuse(spark.createDataFrame(hits, "query_no bigint, channel string, row_no bigint, raw double, score double, rank int")).collect()}
    assert abs(got[1] - 0.86 * 0.92) < 1e-9 and got[2] == 0.6 and abs(got[3] - 0.15 / 61) < 1e-12


def test_diversity(spark):
    pool = [(1, 1, 0.95, [1.0, 0.0, 0.0]), (1, 2, 0.60, [0.99, 0.1, 0.0]), (1, 3, 0.70, [0.0, 1.0, 0.0]), (2, 1, 0.5, None), (2, 4, 0.5, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(pool, "query_no bigint, row_no bigint, score double, vector array<float>")
    order = demote_interference(df).where("query_no = 1").orderBy("place").collect()
    assert [r.row_no for r in order] == [1, 3, 2] and [r.demoted for r in order] == [False, False, True]
    assert demote_interference(df).count() == 5
    m = mmr(df, 2)
    assert [r.row_no for r in m.where("query_no = 1").orderBy("place").collect()] == [1, 3]
    assert [r.row_no for r in m.where("query_no = 2").orderBy("place").collect()] == [1, 4]
    texts = spark.createDataFrame([(1, i, i, "x" * n) for i, n in enumerate([900, 200, 10], 1)], "query_no bigint, row_no bigint, place int, text string")
    assert [r.row_no for r in char_budget(texts, 10, 1000).orderBy("place").collect()] == [1]


def test_graph(spark):
    rows = [("1", "s", "alice", "uses", "python", 0.9, "m1", 1), ("1", "s", "alice", "uses", "python", 0.5, "m1", 2), ("2", "s", " 'ALICE' ", "works at", "google", 0.8, "m2", 1), ("3", None, "bob", "uses", "python", None, None, None), ("4", "s", None, "x", "y", 0.5, "m", 1)]
    t = upserted(spark.createDataFrame(rows, "id string, scope string, subject string, predicate string, object string, confidence double, source_memory_id string, timestamp_ms bigint"))
    assert {(r.id, r.subject, r.predicate, r.confidence) for r in t.collect()} == {("1", "Alice", "uses", 0.5), ("2", "Alice", "works_at", 0.8), ("3", "Bob", "uses", 0.0)}
    e = edges(t)
    seeds = spark.createDataFrame([("Alice",), ("Nobody",)], "entity string")
    s = {r.entity: r.score for r in pagerank(e, seeds).collect()}
    assert max(s, key=s.get) == "Alice" and s["Google"] > s["Python"] > 0
    hops = {r.entity: r.hops for r in neighbourhood(e, seeds.where("entity = 'Alice'")).collect()}
    assert hops == {"Alice": 0, "Python": 1, "Google": 1, "Bob": 2}
    assert pagerank(e, seeds.where("entity = 'Nobody'")).count() == 0


def test_clusters_are_greedy(spark):
    r = random.Random(3)
    rows = [(i, "s", "c", [r.gauss(0, 1), r.gauss(0, 1)] if r.random() > 0.2 else [1.0, 0.5]) for i in range(60)]
    df = spark.createDataFrame(rows, "row_no bigint, scope string, memory_category string, vector array<float>")
    pairs = similar_pairs(df, 0.97)
    got = {x.row_no: x.seed for x in clusters(df, pairs).collect()}
    link = {}
    for p in pairs.collect():
        link.setdefault(p.b, set()).add(p.a)
    seed, want = set(), {}
    nodes = {n for b, xs in link.items() for n in (b, *xs)}
    for n in sorted(nodes):
        hit = [a for a in link.get(n, ()) if a in seed]
        if hit:
            want[n] = min(hit)
        else:
            seed.add(n)
    want |= {s: s for s in set(want.values())}
    assert got == want


def test_order_helpers(spark):
    r = random.Random(4)
    rows = [(r.choice("aab"), i, r.choice([None, 1, 5])) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, k bigint, v bigint")
    pos = {x.k: x.pos for x in dense_position(df, ["g", "k"]).collect()}
    assert [k for k, _ in sorted(pos.items(), key=lambda p: p[1])] == [k for _, k, _ in sorted(rows)]
    assert sorted(pos.values()) == list(range(500))
    total, want = {}, {}
    for g, k, v in sorted(rows, key=lambda x: (x[0], x[1])):
        want[k] = total.get(g, 0)
        total[g] = total.get(g, 0) + (v or 0)
    assert {x.k: x.before for x in prefix_sum(df, "g", ["k"], "v").collect()} == want
    assert dense_position(df.where("false"), ["k"]).count() == 0


def test_hot_keys_join_like_others(spark, monkeypatch):
    import memspark.operators.skew as skew

    monkeypatch.setattr(skew, "HOT_LEAST", 10)
    rows = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(300)] + [(None, -1)], "k string, i int")
    groups = rows.groupBy("k").count().withColumnRenamed("count", "n")
    got = join_groups(rows, groups, ["k"], "n")
    assert got.count() == 300 and got.where("k = 'hot'").count() == 200
