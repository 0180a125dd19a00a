"""PageRank to its limit and tolerance against a plain loop."""

from __future__ import annotations

from memspark.operators import graph as G
from memspark.queries import graph as Q
from memspark.queries.registry import queries


def brute(edges, start, iterations=10, tolerance=0.001):
    total, out = {}, {}
    for a, _, w in edges:
        total[a] = total.get(a, 0) + w
    seed = {s: 1 / len(start) for s in start}
    score = dict(seed)
    for _ in range(iterations):
        out = {k: 0.15 * v for k, v in seed.items()}
        for a, b, w in edges:
            if total[a] > 0 and a in score:
                out[b] = out.get(b, 0) + 0.85 * score[a] * w / total[a]
        moved = max(abs(out.get(k, 0) - score.get(k, 0)) for k in {*out, *score})
        score = out
        if moved < tolerance:
            break
    return score


def test_full_runs(spark, sf):
    e = G.edges(Q.triples(spark, sf))
    want = brute([(r.src, r.dst, r.w) for r in e.collect()], [r.entity for r in Q.seeds(e).collect()])
    full = {r.entity: r.score for r in queries()["j09_pagerank_full"](spark, sf).collect()}
    assert full.keys() == want.keys() and all(abs(full[k] - want[k]) < 2e-6 for k in want)
    top = queries()["t09_pagerank_top_full"](spark, sf).collect()
    assert top and all(full[r.entity] == r.score for r in top)
    best = {r.source_memory_id: r.score for r in queries()["j10_graph_memories_full"](spark, sf).collect()}
    hits = {}
    for r in Q.triples(spark, sf).where("source_memory_id is not null").collect():
        hits[r.source_memory_id] = max(hits.get(r.source_memory_id, 0), max(want.get(r.subject, 0), want.get(r.object, 0)) * r.confidence)
    assert best and all(abs(v - hits[k]) < 2e-6 for k, v in best.items())
