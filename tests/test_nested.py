"""Nested metadata as child tables: shapes, nulls, broken JSON."""

from __future__ import annotations

import json

from memspark.operators.nested import FIELDS, child_table, shred


def nodes(spark, values):
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(values)], "row_no bigint, metadata string, label string")
    return {tuple(r) for r in shred(df, "metadata", "row_no").select("row_no", "child_path", "parent_pos", "child_pos", "link_value").collect()}


def test_shapes(spark):
    rel = [None, {"type": "a", "target_id": "t1", "evidence": {"session": "s1"}}, {"targetId": "  "}, {"target": "t3", "evidence": [{"session": "s2"}, {"quote": "q"}]}]
    values = [
        json.dumps({"relations": rel}),
        json.dumps({"relations": json.dumps(rel)}),
        json.dumps({"relations": {"targetId": "lone"}}),
        json.dumps({"provenance": {"derived_from": ["a", None, " ", "b"]}}),
        json.dumps({"provenance": [{"session": "s", "derived_from": "one"}, "text", {"derived_from": []}]}),
        json.dumps({"support_info": {"slices": [{"context": "w"}, {}]}}),
        json.dumps({"relations": None, "provenance": None}),
    ]
    rows = [("relations", -1, 1, "t1"), ("relations", -1, 3, "t3"), ("relations.evidence", 1, 0, "s1"), ("relations.evidence", 3, 0, "s2"), ("relations.evidence", 3, 1, "")]
    want = {(i, *r) for i in (0, 1) for r in rows}
    want |= {(2, "relations", -1, 0, "lone"), (3, "provenance", -1, 0, ""), (3, "provenance.derived_from", 0, 0, "a"), (3, "provenance.derived_from", 0, 3, "b")}
    want |= {(4, "provenance", -1, 0, "s"), (4, "provenance", -1, 2, ""), (4, "provenance.derived_from", 0, 0, "one"), (5, "support_info.slices", -1, 0, "w"), (5, "support_info.slices", -1, 1, "")}
    assert nodes(spark, values) == want


def test_unreadable(spark):
    assert nodes(spark, [None, "", "null", "[]", "3", '{"relations":[{"targetId":"x"}', "nonsense"]) == set()


def test_parent_label_is_truncation(spark):
    df = spark.createDataFrame([(1, json.dumps({"relations": [{"targetId": "a"}, {"targetId": "b", "evidence": [{"session": "s"}]}]}))], "row_no bigint, metadata string")
    n = shred(df, "metadata", "row_no")
    e = child_table(n, "relations.evidence").first()
    assert list(e.label) == [1, 0] and list(e.parent_label) == [1]
    assert n.where("label = array(1)").count() == 1


def test_empty_table(spark):
    assert shred(spark.createDataFrame([], "row_no bigint, metadata string"), "metadata", "row_no").count() == 0


def test_child_tables_keep_all_fields(spark):
    ev = {"session": "s", "quote": "q", "seen": {"turn": 3, "weight": 0.5, "by": "x"}, "lang": "en"}
    o = {
        "relations": [{"targetId": "t", "type": "refines", "note": {"a": [1]}, "evidence": [ev, {"quote": "only"}]}],
        "provenance": [{"session": "p", "trigger": "auto", "date": "2024-01-01", "derived_from": ["a"]}],
        "support_info": {"slices": [{"context": "c", "confirmations": 4, "contradictions": 1, "strength": 0.8}, {"context": "d", "confirmations": "many"}]},
    }
    n = shred(spark.createDataFrame([(7, json.dumps(o))], "row_no bigint, metadata string"), "metadata", "row_no")
    rows = {p: [r.asDict() for r in child_table(n, p).orderBy("child_pos").collect()] for p in FIELDS}
    rel = rows["relations"][0]
    assert (rel["link_value"], rel["type"], rel["others"]) == ("t", "refines", {"targetId": "t", "note": '{"a":[1]}'})
    one, two = rows["relations.evidence"]
    assert (one["quote"], one["seen_turn"], one["seen_weight"], json.loads(one["seen"]), one["others"]) == ("q", 3, 0.5, ev["seen"], {"lang": "en"})
    assert (two["session"], two["quote"], two["seen"], two["others"], two["parent_pos"]) == (None, "only", None, {}, 0)
    assert [rows["provenance"][0][c] for c in ("session", "trigger", "date")] == ["p", "auto", "2024-01-01"]
    assert [(r["link_value"], r["others"]) for r in rows["provenance.derived_from"]] == [("a", None)]
    s = rows["support_info.slices"]
    assert [(r["context"], r["confirmations"], r["contradictions"], r["strength"], r["others"]) for r in s] == [("c", 4, 1, 0.8, {}), ("d", None, None, None, {"confirmations": "many"})]


def test_all_child_tables_are_queries(spark, sf):
    from memspark.queries.problems import queries

    got = {k: f(spark, sf) for k, f in queries().items() if k.startswith("p5_table_")}
    assert set(got) == {f"p5_table_{x}" for x in ("relations", "evidence", "provenance", "derived_from", "slices")}
    assert sum(df.count() for df in got.values()) == queries()["p5_found"](spark, sf).count()
