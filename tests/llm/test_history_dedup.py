"""Batches against history: brute force in order, the graph against exhaustive search."""

from __future__ import annotations

import random
import shutil

import numpy as np

from memspark.llm.history_dedup import HistoryIndex, repeats
from memspark.llm.smallworld import NEAR, Graph, distances, signatures
from memspark.llm.words import words

M = "row_no bigint, text string, vector array<float>, scope string, q bigint"
I = "row_no bigint, batch_no int, text string, vector array<float>, scope string, a string"  # noqa: E741


def brute(mem, inc):
    def usable(v):
        return v is not None and len(v) > 0 and any(v)

    def alike(x, y):
        a, b = set(words(x[0])), set(words(y[0]))
        if not a | b or len(a & b) < 0.7 * len(a | b) - 1e-9:
            return False
        if not usable(x[1]) or not usable(y[1]):
            return True
        p, q = np.array(x[1], np.float32).astype(float), np.array(y[1], np.float32).astype(float)
        return p @ q >= 0.9 * np.sqrt((p @ p) * (q @ q)) - 1e-12

    scope = lambda s: (s or "").strip().lower() or "global"
    accepted = [(r[0], (r[1], r[2]), scope(r[3])) for r in sorted(mem)]
    out = set()
    for r in sorted(inc):
        hit = [a for a, x, s in accepted if s == scope(r[4]) and alike(x, (r[2], r[3]))]
        if hit:
            out.add((min(hit), r[0]))
        else:
            accepted.append((r[0], (r[2], r[3]), scope(r[4])))
    return out


def data(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [" ".join(r.sample(vocabulary, 12)) for _ in range(25)]

    def one():
        ws = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            ws[r.randrange(len(ws))] = r.choice(vocabulary)
        v = r.choice([None, [0.0, 0.0, 0.0], [1.0, 0.1 * r.randint(0, 9), 0.0], [2.0, 0.0, 0.3]])
        return " ".join(ws) if r.random() > 0.03 else r.choice([None, "", "..."]), v, r.choice(["A", " a", None, "global", ""])

    mem = [(i, *one(), 0) for i in range(120)]
    inc = []
    for i in range(160):
        t, v, s = one()
        inc.append((1000 + i, 1 + i // 40, t, v, s, "x"))
    return mem, inc


def test_against_brute_force(spark):
    mem, inc = data(1)
    got = {tuple(r) for r in repeats(spark.createDataFrame(mem, M), spark.createDataFrame(inc, I)).collect()}
    assert got == brute(mem, inc)


def test_chain_and_copies(spark):
    # b repeats a; c repeats b but not a, and b is not accepted: c is accepted; d repeats c
    a = [f"k{i}" for i in range(20)]
    b, c = a[3:] + ["n1", "n2", "n3"], a[6:] + [f"n{i}" for i in range(1, 7)]
    inc = [(10, 1, " ".join(a), None, "s", ""), (11, 1, " ".join(b), None, "s", ""), (12, 2, " ".join(c), None, "s", ""), (13, 3, " ".join(c).upper(), None, "S ", ""), (14, 3, " ".join(a), None, "s", "")]
    got = {tuple(r) for r in repeats(spark.createDataFrame([], M), spark.createDataFrame(inc, I)).collect()}
    assert got == brute([], inc) and (12, 13) in got and not any(x[1] == 12 for x in got)


def test_one_text_with_many_vectors(spark):
    # a third of all rows share their words; vectors differ, so every row is a class of its own
    r = random.Random(6)
    near = lambda k: [1.0, 0.01 * k, 0.0] if k % 7 else [0.0, 0.0, 1.0 + k]
    mem = [(i, "one text of some words" if i % 3 == 0 else f"other {i} row {i * 7} number {i * 11}", near(i), "s", 0) for i in range(5, 300)]
    inc = [(1000 + i, 1 + i // 120, "One text, of some WORDS!" if i % 3 else f"fresh {i % 20} words {i % 20} here", near(r.randint(0, 60)), "s", "") for i in range(240)]
    got = {tuple(x) for x in repeats(spark.createDataFrame(mem, M), spark.createDataFrame(inc, I)).collect()}
    assert got == brute(mem, inc) and len(got) > 150


def test_smaller_row_than_the_own_copy(spark):
    mem = [(1, "a b c d e f g h", [1.0, 0.0], "s", 0), (2, "a b c d e f g h", [1.0, 0.1], "s", 0)]
    inc = [(10, 1, "a b c d e f g h", [1.0, 0.1], "s", "")]
    assert [tuple(x) for x in repeats(spark.createDataFrame(mem, M), spark.createDataFrame(inc, I)).collect()] == [(1, 10)]


def test_empty(spark):
    mem, inc = data(2)
    assert repeats(spark.createDataFrame(mem, M), spark.createDataFrame([], I)).count() == 0
    assert repeats(spark.createDataFrame([], M), spark.createDataFrame([], I)).count() == 0


def test_graph_recall_against_exhaustive_search():
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(1200):
        base = rng.choice(3000, 18, replace=False)
        rows.append(base)
        for _ in range(rng.integers(0, 4)):
            other = base.copy()
            other[rng.choice(18, 2, replace=False)] = rng.choice(3000, 2)
            rows.append(other)
    rng.shuffle(rows)
    flat = np.concatenate(rows).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sig, bands = signatures(flat, np.arange(len(rows)) * 18)
    half = len(rows) * 2 // 3
    g = Graph.of(Graph(sig[:half], bands[:half]).state())
    assert g.n > 1500
    got = set(zip(*map(np.ndarray.tolist, g.near(sig[half:], bands[half:]))))
    true = set(zip(*map(np.ndarray.tolist, np.nonzero(distances(sig[half:], sig[:half]) <= NEAR))))
    near = {p for p in true if len(set(rows[half + p[0]]) & set(rows[p[1]])) / len(set(rows[half + p[0]]) | set(rows[p[1]])) >= 0.7}
    assert len(near) > 300 and len(got & near) >= 0.99 * len(near)
    assert len(got & true) >= 0.9 * len(true)


def test_any_batch_number_is_checked(spark):
    mem, inc = data(2)
    mem, inc = mem[:40], inc[:80]
    # no batch, batch 0 and below it, as case, as accepted row and as its own copy
    inc = [(r[0], (None, 0, -3, 1, 9)[i % 5], *r[2:]) for i, r in enumerate(inc)]
    inc += [(2000, None, "one two three", None, "s", ""), (2001, 0, "three two one", None, "s", ""), (2002, 5, "one two three", None, "s", "")]
    got = {tuple(r) for r in repeats(spark.createDataFrame(mem, M), spark.createDataFrame(inc, I)).collect()}
    assert got == brute(mem, inc) and {(2000, 2001), (2000, 2002)} <= got


def test_later_batches_read_no_text_of_the_history(spark, tmp_path):
    mem, inc = data(3)
    table, folder = str(tmp_path / "memories.parquet"), str(tmp_path / "index")
    spark.createDataFrame(mem, M).write.parquet(table)
    # small shards: scopes lie in several, and every second batch is merged
    HistoryIndex(spark, folder, shard=8, compact=2).begin(spark.read.parquet(table))
    shutil.rmtree(table)
    got = set()
    for lo in range(0, 160, 40):
        index = HistoryIndex(spark, folder, shard=8, compact=2)  # as a later session would open it
        got |= {tuple(r) for r in index.accept(spark.createDataFrame(inc[lo : lo + 40], I)).collect()}
        index.clean()
    assert got == brute(mem, inc)
    index = HistoryIndex(spark, folder)
    assert sorted(n for _, n in index.live) == [2, 99]
    assert len(list((tmp_path / "index" / "shards").glob("gen=*"))) == 2


def test_small_graphs_are_graphs():
    rng = np.random.default_rng(9)
    for n in (1, 2, 5, 40, 200):
        flat = rng.integers(1, 2**63, (n, 12)).astype(np.uint64)
        sig, bands = signatures(flat.ravel(), np.arange(n) * 12)
        scope = np.arange(n) % 2
        g = Graph(sig, bands, scope)
        assert ((g.links >= 0).any(axis=1) | (n == 1)).all()
        i, j = g.near(sig, bands, scope)
        assert {(k, k) for k in range(n)} <= set(zip(i.tolist(), j.tolist()))
        # the same words in the other scope are not near
        assert not len(g.near(sig, bands, 1 - scope)[0])
