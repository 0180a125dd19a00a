"""Reading level: prose, held-out accuracy on generated documents, edge cases."""

from __future__ import annotations

import random

import numpy as np

from memspark.llm.reading import NAMES, ReadingModel, document_features, features, reading_levels, sentences, variety
from memspark.llm.trees import BoostedTrees

SHORT, LONG = "the cat sat on a mat and ran far".split(), "considerable interdisciplinary synchronization characterization responsibility notwithstanding".split()


def doc(level, r, n=8):
    out = []
    for _ in range(n):
        k = max(4, int(r.gauss(3 + 5 * level, 1.5)))
        ws = [r.choice(LONG) if r.random() < 0.07 * level else r.choice(SHORT) for _ in range(k)]
        out.append(" ".join(ws).capitalize() + r.choice(".!?"))
    return " ".join(out)


def test_prose():
    text = "# A heading of words\n- one item stands here\n* another item stands here.\nUser: a turn of talk. It goes on here!\n```\ncode is not prose at all.\n```\ndef f(x):\n    return x\n$ run it now please\n12:30:01 WARN this is a log\nLast line that\nis wrapped here."
    assert sentences(text) == ["one item stands here", "another item stands here.", "a turn of talk.", "It goes on here!", "Last line that is wrapped here."]
    assert sentences(None) == sentences("") == sentences(" \n") == []


def test_trees_fit_a_step():
    x = np.random.default_rng(1).uniform(size=(300, 3))
    y = (x[:, 1] > 0.5) * 2.0
    assert np.abs(BoostedTrees().fit(x, y).predict(x) - y).mean() < 0.05
    assert BoostedTrees().fit(x[:0], y[:0]).predict(x[:2]).tolist() == [0, 0]


def test_held_out_accuracy():
    r = random.Random(7)
    levels = [r.randint(1, 5) for _ in range(500)]
    x = np.array([features(sentences(doc(v, r))) for v in levels])
    y = np.array(levels, float)
    noisy = y.copy()
    for i in r.sample(range(300), 15):
        noisy[i] = min(5, max(1, noisy[i] + r.choice([-1, 1])))
    m = ReadingModel(x[:300], noisy[:300], [r.choice("abcdef") for _ in range(300)])
    diff = np.abs(m.predict(x[300:]) - y[300:])
    assert (diff == 0).mean() > 0.75 and (diff <= 1).mean() > 0.97
    assert len(m.report) >= 2


def test_query(spark):
    r = random.Random(8)
    docs, labels = [], []
    for i in range(80):
        v = 1 + i % 5
        docs.append((i, doc(v, r), r.choice(["en", " EN", "en-GB", "English"]), r.choice("ab"), 1))
        labels.append((i, "r1", v))
    docs += [(100, None, "en", "a", 1), (101, "", "en", None, 1), (102, "Too short here.", "en", "a", 1), (103, doc(1, r), "de", "a", 1), (104, doc(1, r), None, "a", 1)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, x int")
    lab = spark.createDataFrame(labels, "doc_id bigint, rater string, reading_level int")
    got = {r_.doc_id: r_.reading_level for r_ in reading_levels(d, lab).collect()}
    assert set(got) == set(range(80)) and np.mean([got[i] == 1 + i % 5 for i in got]) > 0.8
    assert reading_levels(d, lab.where("false")).count() == 0
    assert document_features(d.where("false")).count() == 0


def test_features_see_the_whole_text():
    plain, rich = ["the cat sat on a mat"] * 40, [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + j)}" for j in range(6)) for i in range(40)]
    at = {k: i for i, k in enumerate(NAMES)}
    alone, both, turned = features(plain), features(plain + rich), features(rich + plain)
    assert both[at["variety"]] > alone[at["variety"]] + 0.3 and abs(both[at["variety"]] - turned[at["variety"]]) < 0.05
    assert both[at["sentences"]] == 80
    assert variety(["a"] * 100 + ["b"] * 50) == 0.015 and variety(["a", "b"]) == 1
