"""Formatting duplicates against grouping by sorted fields and words."""

from __future__ import annotations

import json

from memspark.llm.formatting import PRINTS, _linked, _prints, collapsed, formatting_groups, multiset_hash
from memspark.llm.words import fields, words

SCHEMA = "row_no bigint, text string, scope string, first_row_no int"


def brute(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    seen = {}
    for n, t, s, _ in rows:
        scope = (s or "").strip().lower() or "global"
        find(n)
        f = fields(t)
        for k in [("w", scope, tuple(words(t)))] + ([("f", scope, tuple(sorted(f)))] if f else []):
            if k in seen:
                a, b = sorted((find(seen[k]), find(n)))
                parent[b] = a
            seen.setdefault(k, n)
    return {(find(n), n) for n, *_ in rows if find(n) != n}


TEXTS = [
    "Due: note 3; Region code: Map 4", "REGION CODE : map 4\r\nDUE : NOTE 3\n", '{"due": "note 3", "region code": "map 4"}', "due: note 4; region code: map 3", "due: note 3; due: note 3", "due: note 3",
    "Größe der Datei", "GRÖSSE DER DATEI", "a_b", "a b", "a-b!", "ab", "", None, "  ...", "x: 1 | y: 2", "y: 2 | x: 1", "x: 1 | y: 2 | x: 1", "Plain words: here", "plain words here",
]


def test_against_brute_force(spark):
    rows = [(i, t, s, 0) for i, (t, s) in enumerate((t, s) for s in ("A", " a ", None, "global") for t in TEXTS)]
    got = {tuple(r) for r in formatting_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)
    assert sum(r.copies for r in collapsed(spark.createDataFrame(rows, SCHEMA)).collect()) == len(rows)


def test_hot_group(spark):
    rows = [(i, "Same Text!" if i % 3 == 0 else f"text {i}", "g", 0) for i in range(3000)]
    got = formatting_groups(spark.createDataFrame(rows, SCHEMA))
    assert got.count() == 999 and got.where("first_row_no = 0").count() == 999


def test_order_does_not_change_the_hash():
    f = fields('{"a": 1, "b": [2, {"c": 3}]}')
    assert multiset_hash(f) == multiset_hash(f[::-1]) != multiset_hash(f + f[:1])
    assert multiset_hash(fields("a: 1; b: 2")) == multiset_hash(fields(json.dumps({"B": "2", "A": "1"})))


def test_links_over_a_row_that_is_not_the_first(spark):
    # the third row has the words of the second, which has the fields of the first
    rows = [(1, "color: red; size: 10", "s", 0), (2, "size: 10; color: red", "s", 0), (3, "size 10 color red", "s", 0)]
    # one word sequence that reads as two sets of fields, each with a partner of its own
    rows += [(10, "c d: e; a: b", "s", 0), (11, "a: b; c d: e", "s", 0), (12, "a: b; c: d e", "s", 0), (13, "c: d e; a: b", "s", 0), (14, "C: D E | A: B", "t", 0)]
    got = {tuple(r) for r in formatting_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows) == {(1, 2), (1, 3), (10, 11), (10, 12), (10, 13)}


def test_grouping_by_the_words_themselves(spark):
    # what a group with a hash collision goes through
    rows = [(i, t, s, 0) for i, (t, s) in enumerate((t, s) for s in ("a", "global") for t in TEXTS)]
    members, _ = _linked(spark.createDataFrame(rows, SCHEMA).mapInArrow(_prints(True), PRINTS))
    assert {tuple(r) for r in members.where("row_no != first_row_no").select("first_row_no", "row_no").collect()} == brute(rows)


def test_empty(spark):
    assert formatting_groups(spark.createDataFrame([], SCHEMA)).count() == 0
