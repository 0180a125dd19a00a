"""Mixing against a plain cut, shares, caps and empty sources."""

from __future__ import annotations

import random

from memspark.llm.encoding import encode
from memspark.llm.mixing import mix


def make(spark, n=400):
    r = random.Random(5)
    sources = ["big"] * 6 + ["Small "] + ["tiny_one"]
    docs = [(i, " ".join(r.choice(["alpha", "beta", "gamma"]) for _ in range(r.randint(1, 30))) if r.random() > 0.05 else r.choice([None, ""]), r.choice(sources) if r.random() > 0.05 else r.choice([None, " "]), 1.0) for i in range(n)]
    return docs, spark.createDataFrame(docs, "doc_id bigint, text string, source string, tokens double")


TARGETS = "mix_name string, source string, target_weight double, max_repeats int"


def test_shares_and_caps(spark):
    docs, df = make(spark)
    t = spark.createDataFrame([("m", "BIG", 3.0, 1), ("m", "small", 1.0, 4), ("m", "tiny-one", 1.0, 2), ("m", "none", 1.0, 9), ("m", "zero", 0.0, 1), ("n", "big", 1.0, 1)], TARGETS)
    chosen, shares = mix(df, t)
    rows, got = chosen.collect(), {(r.mix_name, r.source): r for r in shares.collect()}
    size = {}
    for i, x, s, _ in docs:
        k = (s or "").strip().lower().replace("_", "-")
        if k:
            size[k] = size.get(k, 0) + len(encode(x))
    assert got["m", "none"].tokens == 0 and ("m", "zero") not in got
    total = min(size["big"] * 1 / 3, size["small"] * 4 / 1, size["tiny-one"] * 2 / 1)
    for s, w, cap in (("big", 3, 1), ("small", 1, 4), ("tiny-one", 1, 2)):
        r = got["m", s]
        assert r.size == size[s] and r.most_repeats <= cap
        assert abs(r.tokens - int(w * total)) <= 31
        assert sum(x.tokens * x.repeats for x in rows if x.mix_name == "m" and x.source == s) == r.tokens
    assert got["n", "big"].tokens == size["big"] and got["n", "big"].binds
    # the source that sets the total of its mix
    assert {s: got["m", s].binds for s in ("big", "small", "tiny-one", "none")} == {s: n > 0 and abs(n - total) < 1e-6 for s, n in (("big", size["big"] / 3), ("small", size["small"] * 4), ("tiny-one", size["tiny-one"] * 2), ("none", 0))}
    assert abs(sum(r.actual_share for k, r in got.items() if k[0] == "m") - 1) < 1e-9
    assert len({(x.mix_name, x.doc_id) for x in rows}) == len(rows)


def test_total_and_empty(spark):
    _, df = make(spark)
    t = spark.createDataFrame([("m", "big", 1.0, 1), ("m", "small", 1.0, 3)], TARGETS)
    got = {r.source: r for r in mix(df, t, total_tokens=400)[1].collect()}
    assert abs(got["big"].tokens - 200) <= 31 and abs(got["small"].tokens - 200) <= 31
    assert mix(df.where("false"), t)[0].count() == 0
    assert mix(df, t.where("false"))[0].count() == 0
