"""Changes between files against a plain comparison, and the unified table."""

from __future__ import annotations

import datetime as dt
import json

from memspark.operators.drift import FRACTION, NUMBER, STRING, column_type, fields_of, kind_of, schema_changes, settled_fields, unified_table

SCHEMA = "file_no bigint, store_name string, written_at timestamp, line_no int, record string, extra int"
T0 = dt.datetime(2024, 1, 1)


def lines(spark, files, store="s"):
    rows = []
    for n, records in files.items():
        for i, r in enumerate(records):
            rows.append((n, store, T0 + dt.timedelta(days=n), i, r if r is None or isinstance(r, str) else json.dumps(r), 1))
    return spark.createDataFrame(rows, SCHEMA)


def changes(spark, files):
    return {(r.file_no, r.change_kind, r.field_path, r.old_path) for r in schema_changes(lines(spark, files)).collect()}


def test_kinds_of_change(spark):
    one = [{"id": str(i), "a": i, "name": f"n{i}", "rel": [{"to": f"t{i}", "k": "x"}], "gone": 1} for i in range(6)]
    two = [{"id": str(i), "a": str(i), "title": f"n{i}", "links": [{"target": f"t{i}", "k": "x"}], "fresh": {"x": {"y": 1}}} for i in range(6)]
    got = changes(spark, {1: one, 2: two})
    assert got == {
        (2, "retyped", "a", ""),
        (2, "renamed", "title", "name"),
        (2, "renamed", "links", "rel"),
        (2, "renamed", "links[].target", "rel[].to"),
        (2, "removed", "gone", ""),
        (2, "added", "fresh", ""),
    }


def test_child_under_kept_parent_and_nulls(spark):
    one = [{"id": "1", "p": {"s": "v", "d": 1}, "n": None}, None, "", "{broken", "[]", {"id": "1", "p": {"s": "v", "d": 1}, "n": None}]
    two = [{"id": "1", "p": {"sid": "v", "d": 1}, "n": 5}]
    assert changes(spark, {1: one, 2: two}) == {(2, "renamed", "p.sid", "p.s")}


def test_different_values_are_no_renaming(spark):
    one, two = [{"id": str(i), "a": i} for i in range(9)], [{"id": str(i), "b": i * 7} for i in range(1, 9)]
    assert changes(spark, {1: one, 2: two}) == {(2, "added", "b", ""), (2, "removed", "a", "")}


def test_order_is_that_of_writing(spark):
    df = lines(spark, {5: [{"id": "1", "a": 1}], 9: [{"id": "1"}]})
    df = df.withColumn("written_at", __import__("pyspark.sql.functions", fromlist=["expr"]).expr("timestamp'2024-06-01' - make_interval(0,0,0,cast(file_no as int))"))
    assert [(r.file_no, r.change_kind) for r in schema_changes(df).collect()] == [(5, "added")]


def test_unified(spark):
    files = {1: [{"id": "1", "tag": "x", "n": 1}, "broken"], 2: [{"id": "1", "label": "x", "n": "2"}], 3: [{"id": "2", "label": ["y", "z"], "n": 3.5}]}
    t = unified_table(lines(spark, files))
    assert t.columns == ["store_name", "file_no", "line_no", "written_at", "id", "n", "tag"]
    assert {(r.file_no, r.n, tuple(r.tag)) for r in t.collect()} == {(1, "1", ("x",)), (2, "2", ("x",)), (3, "3.5", ("y", "z"))}


def test_lattice():
    assert column_type(NUMBER | FRACTION) == "double" and column_type(NUMBER | STRING) == "string" and column_type(0) == "string"
    assert {f[2] for f in fields_of({"a": [{"b": 1}, {"c": [2]}]})} == {"a", "a[].b", "a[].c"}


def test_numbers_keep_their_digits(spark):
    assert [column_type(kind_of(v)) for v in (1, 2**53 + 1, 2**63, -(10**37), 10**38, 0.5, 1e300)] == ["bigint", "bigint", "decimal(38,0)", "decimal(38,0)", "string", "double", "double"]
    assert column_type(kind_of(2**53 + 1) | kind_of(0.5)) == "string"
    files = {1: [{"id": "1", "big": 9007199254740993, "huge": 2**70, "f": 1, "m": 2**60, "b": True}], 2: [{"id": "2", "big": 1, "huge": 3, "f": 0.25, "m": 1.5, "b": False}]}
    t = unified_table(lines(spark, files))
    assert dict(t.dtypes)["big"] == "bigint" and dict(t.dtypes)["huge"] == "decimal(38,0)" and dict(t.dtypes)["f"] == "double"
    assert {(r.id, r.big, int(r.huge), r.f, r.m, r.b) for r in t.collect()} == {("1", 9007199254740993, 2**70, 1.0, str(2**60), True), ("2", 1, 3, 0.25, "1.5", False)}
    # whole and broken numbers are one JSON type: no change is reported
    assert schema_changes(lines(spark, files)).count() == 0


def test_empty(spark):
    assert schema_changes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_unified_nested(spark):
    def record(i, prov, rel, name, to, n):
        return {"id": str(i), "p": {prov: f"s{i}", "n": n(i)}, rel: [{name: f"x{i}", to: f"t{i}", "k": "c"}]}

    files = {
        1: [record(i, "session", "relations", "type", "targetId", int) for i in range(4)],
        2: [record(i, "session_id", "relations", "rel", "targetId", str) for i in range(4)],
        3: [record(i, "session_id", "links", "rel", "to", str) for i in range(4)],
        4: [record(i, "sid", "links", "kind", "to", int) for i in range(4)],
    }
    t = unified_table(lines(spark, files))
    assert t.columns == ["store_name", "file_no", "line_no", "written_at", "id", "p", "relations"]
    got = t.collect()
    assert len(got) == 16
    for r in got:
        i = r.id
        assert json.loads(r.p) == {"session": f"s{i}", "n": i}, r
        assert [json.loads(x) for x in r.relations] == [{"type": f"x{i}", "targetId": f"t{i}", "k": "c"}], r


def test_settled_fields():
    names, kinds = {"p.b": "p.a"}, {"p.l": 8 | STRING, "p.n": NUMBER}
    one = settled_fields('{"p": {"b": 1, "l": "x", "n": 1.50}, "q": 7}', names, kinds)
    assert one == {"p": '{"a":1,"l":["x"],"n":1.50}'}
    assert settled_fields('{"p": {"b": 1, "a": 2}}', names, kinds) == {}
    assert settled_fields('{"p": {"a": null, "b": 1}}', names, kinds) == {"p": '{"a":1}'}
    assert settled_fields('{"p": {"b": 1, "a": null}}', names, kinds) == {"p": '{"a":1}'}
    assert settled_fields("{broken", names, kinds) == settled_fields(None, names, kinds) == settled_fields("[]", names, kinds) == {}
