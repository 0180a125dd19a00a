"""Dispatch of queries, the two rounds, reranking, ingestion, decisions and preference slots on small tables."""

from __future__ import annotations

import json

import numpy as np
import pytest

from memspark.functions.embed import hash_embedder
from memspark.functions.replies import json_of
from memspark.functions.slots import brand_items
from memspark.functions.text import RESET, without_envelope
from memspark.metadata import with_smart_meta
from memspark.operators import reflections, search
from memspark.operators.consolidate import clusters, similar_pairs
from memspark.operators.lexical import lexical_hits
from memspark.operators.rerank import rerank, word_overlap
from memspark.operators.search import bm25_hits, vector_hits
from memspark.plans.auto_recall import inject, noted
from memspark.plans.dispatch import retrieve, two_rounds
from memspark.plans.engine import MemoryEngine
from memspark.plans.ingest import by_rule, changes, decide, ingest_plan
from memspark.plans.recall import RecallConfig

NOW, DAY = 1_750_000_000_000, 86_400_000
SCHEMA = "row_no bigint, id string, text string, category string, scope string, importance double, timestamp_ms bigint, metadata string, vector array<float>, vector_l0 array<float>, vector_l1 array<float>, vector_l2 array<float>"
embed = hash_embedder(32)


def memories(spark, rows):
    """rows: (row_no, text, extra)"""
    out = []
    for n, t, x in rows:
        v = [float(f) for f in embed([t or ""])[0]]
        out.append((n, f"id{n}", t, x.get("category", "fact"), x.get("scope", "s"), 0.7, NOW - x.get("age", 1) * DAY, json.dumps(x["meta"]) if "meta" in x else None, x.get("vector", v), None, None, None))
    return with_smart_meta(spark.createDataFrame(out, SCHEMA))


def queries(spark, texts):
    return spark.createDataFrame([(i, t, [float(f) for f in embed([t or ""])[0]]) for i, t in enumerate(texts)], "query_no bigint, text string, vector array<float>")


def test_tags_go_to_words_and_must_all_be_there(spark):
    mem = memories(spark, [(1, "Rollback of env:prod and team:core took an hour", {}), (2, "Rollback of env:prod was quick", {}), (3, "Rollback env prod team core", {}), (4, "Rollback on staging, no tag", {}), (5, None, {})])
    got = retrieve(mem, queries(spark, ["rollback ENV:prod team:core", "rollback env:prod", "rollback on staging without tag please", None, ""]), RecallConfig(NOW)).collect()
    by = {q: {r.row_no for r in got if r.query_no == q} for q in range(5)}
    assert by[0] == {1} and by[1] == {1, 2} and {1, 2, 3, 4} <= by[2] and not by[4] - {1, 2, 3, 4, 5}
    assert [r.place for r in sorted((r for r in got if r.query_no == 1), key=lambda r: r.place)] == [1, 2]


def test_time_topic_and_limit(spark):
    mem = memories(spark, [(i, f"The deploy number{i} failed on the server", {"age": 3 * i, "meta": {"topic_tag": "Ops" if i % 2 else "other"}}) for i in range(1, 12)])
    q = queries(spark, ["deploy failed in the last 7 days on the server"])
    got = retrieve(mem, q, RecallConfig(NOW, limit=20)).collect()
    assert {r.row_no for r in got} == {1, 2}
    assert {r.row_no for r in retrieve(mem, q, RecallConfig(NOW, limit=20), topic="ops").collect()} == {1}
    plain = queries(spark, ["the deploy failed on our big server again"])
    assert retrieve(mem, plain, RecallConfig(NOW, limit=3)).count() == 3 and retrieve(mem, plain, RecallConfig(NOW, limit=0)).count() == 1
    assert retrieve(mem.where("false"), plain, RecallConfig(NOW)).count() == 0 and retrieve(mem, plain.where("false"), RecallConfig(NOW)).count() == 0


def test_two_rounds_find_what_only_the_named_leads_to(spark):
    mem = memories(spark, [(1, "our backup job is owned by Quillmark", {}), (2, "Quillmark Quillmark keeps keys in drawer seven", {}), (3, "lunch is at noon", {}), (4, "backup backup job ran", {"meta": {"invalidated_at": NOW - 5, "valid_from": 1}})] + [(20 + i, f"who has the job of row {i}", {}) for i in range(12)])
    got = {r.row_no: r for r in two_rounds(mem, queries(spark, ["who has the backup job"]), NOW).collect()}
    assert got[1].source == "both" and got[2].source == "round2" and 4 not in got
    assert two_rounds(mem.where("false"), queries(spark, ["x y"]), NOW).count() == 0


POOL = "query_no bigint, row_no bigint, query string, text string, score double, bm25 double, query_vector array<float>, vector array<float>"


def test_rerank(spark):
    pool = spark.createDataFrame([(1, 1, "red blue", "red blue", 0.5, None, [1.0, 0.0], [1.0, 0.0]), (1, 2, "red blue", "green", 0.9, 0.8, [1.0, 0.0], [0.0, 1.0]), (1, 3, "red blue", "red", 0.9, 0.65, [1.0, 0.0], None), (1, 4, "red blue", None, 0.4, None, [1.0, 0.0], [1.0, 0.0, 0.0])], POOL)
    got = {r.row_no: r.reranked for r in rerank(pool, word_overlap).collect()}
    assert got == pytest.approx({1: 0.6 + 0.2, 2: 0.9, 3: max(0.81, 0.3 + 0.36), 4: 0.32})
    failed = {r.row_no: r.reranked for r in rerank(pool, lambda q, t: 1 / 0).collect()}
    assert failed == pytest.approx({1: 0.35 + 0.3, 2: 0.63, 3: 0.63, 4: 0.28}) == {r.row_no: r.reranked for r in rerank(pool, None).collect()}


def test_ingest_plan(spark):
    unit = lambda a: [float(np.cos(a)), float(np.sin(a))]
    pref = {"category": "preference"}
    mem = memories(spark, [(1, "Editor: dark mode", pref | {"vector": unit(0)}), (2, "The server is in Oslo", {"vector": unit(0.6)}), (3, "The server is in Rome", {"scope": "other", "vector": unit(0.6)}), (4, "Old: gone", pref | {"vector": unit(0), "meta": {"valid_from": 1, "invalidated_at": 2}})])
    rows = [(10, "Editor: light mode", "preference", "s", unit(0.35)), (11, "The server is in Oslo now", "fact", " S ", unit(0.61)), (12, "hi", "fact", "s", unit(0)), (13, "Something quite new", "fact", "s", unit(2.5)), (14, "Something quite new", "fact", "S", unit(2.5)), (15, None, None, None, None), (16, "No vector at all here", "fact", "s", None), (17, "Linked to both of them", "fact", "s", unit(0.3))]
    batch = spark.createDataFrame(rows, "row_no bigint, text string, category string, scope string, vector array<float>")
    got = {r.row_no: (r.action, r.conflict_row, r.link_rows) for r in ingest_plan(mem, batch, NOW).collect()}
    assert got == {10: ("conflict_detected", 1, []), 11: ("duplicate", None, []), 12: ("noise_filtered", None, []), 13: ("created", None, []), 14: ("duplicate", None, []), 15: ("noise_filtered", None, []), 16: ("created", None, []), 17: ("created", None, [1, 2])}
    assert {r.row_no: r.action for r in ingest_plan(mem, batch, NOW, "supersede").collect()}[10] == "superseded"
    assert ingest_plan(mem.where("false"), batch, NOW).where("action = 'created'").count() == 5 and ingest_plan(mem, batch.where("false"), NOW).count() == 0


def test_decisions(spark):
    v = [1.0, 0.0]
    mem = memories(spark, [(1, "I like burgers from Hilltop", {"category": "preference", "vector": v}), (2, "Team lead is Ada", {"scope": "t", "vector": v, "category": "other"}), (3, "Deploy day: monday", {"scope": "u", "category": "entity", "vector": v})])
    rows = [(10, "I like wings from Hilltop", "preference", "s"), (11, "I like burgers from Hilltop", "preference", "s"), (12, "Team lead is Bo", "other", "t"), (13, "Deploy day: friday", "entity", "u"), (14, "Anything", "fact", "nowhere")]
    batch = spark.createDataFrame([(*r, v) for r in rows], "row_no bigint, text string, category string, scope string, vector array<float>")
    d = decide(mem, batch, NOW)
    assert {r.row_no: (r.decision, r.target_row) for r in d.collect()} == {10: ("create", None), 11: ("skip", 1), 12: ("support", 2), 13: ("supersede", 3), 14: ("create", None)}
    assert {(r.target_row, r.field, r.by_row) for r in changes(d, NOW).collect()} == {(2, "support_info.confirmations", 12), (3, "invalidated_at", 13), (3, "superseded_by", 13)}
    assert {r.decision for r in decide(mem, batch, NOW, lambda kind, near: ("contradict", 0)).collect()} == {"create", "contradict"}
    assert by_rule("profile", None) == ("merge", 0)


def test_brand_items():
    assert brand_items("I really like the fries and a shake from Burger Barn") == ("burgerbarn", ["fries", "shake"])
    assert brand_items("我喜欢麦当劳的板烧鸡腿堡") == ("麦当劳", ["板烧鸡腿堡"])
    assert brand_items("nothing here") is None and brand_items(None) is None and brand_items("") is None


def test_vectors_of_any_length_are_searched(spark):
    m = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, None), (4, [0.0, 2.0])], "row_no bigint, vector array<float>")
    q = m.withColumnRenamed("row_no", "query_no")
    assert {(r.query_no, r.row_no) for r in vector_hits(m, q, 1).collect()} == {(1, 1), (2, 2), (4, 4)}
    g = spark.createDataFrame([(i, "s", "k", v) for i, v in enumerate([[1.0, 0.0], [1.0, 0.01], [1.0, 0.0, 0.0], [1.0, 0.01, 0.0]])], "row_no bigint, scope string, memory_category string, vector array<float>")
    assert {(r.a, r.b) for r in similar_pairs(g).collect()} == {(0, 1), (2, 3)}


def test_long_chains_of_clusters_are_followed(spark):
    pairs = spark.createDataFrame([(i, i + 1, 0.9) for i in range(24)], "a bigint, b bigint, score double")
    assert {(r.row_no, r.seed) for r in clusters(None, pairs).collect()} == {(i, i - i % 2) for i in range(24)}  # the last resembles a member only


def test_bm25_in_blocks_gives_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i % 5} w{i % 7} common words {i}") for i in range(60)], "row_no bigint, text string")
    q = spark.createDataFrame([(i, f"w{i} common {i}") for i in range(9)], "query_no bigint, text string")
    rows = lambda: {(r.query_no, r.row_no, r.raw, r.rank) for r in bm25_hits(docs, q, 5).collect()}
    whole = rows()
    monkeypatch.setattr(search, "CELLS", 6)
    assert rows() == whole and len(whole) == 45


def test_engine_ingests_and_retrieves(spark, tmp_path):
    e = MemoryEngine(spark, str(tmp_path / "store"))
    first = e.ingest([{"text": "Editor: dark mode please", "scope": "a", "category": "preference"}, {"text": "Deploys of env:prod run on friday evening", "scope": "a"}, {"text": "hi"}], NOW).collect()
    assert [r.action for r in first] == ["created", "created", "noise_filtered"]
    again = e.ingest([{"text": "Editor: light mode please", "scope": "a", "category": "preference"}, {"text": "Deploys of env:prod run on friday evening", "scope": "A"}], NOW + 1, "supersede").collect()
    assert [r.action for r in again] == ["superseded", "duplicate"]
    rows = {r.text: json.loads(r.metadata) for r in e.table().collect()}
    old, new = rows["Editor: dark mode please"], rows["Editor: light mode please"]
    assert old["invalidated_at"] == NOW + 1 and new["fact_key"] == old["fact_key"] and new["supersedes"] and old["superseded_by"]
    e.ingest([{"text": "Deploys of env:prod run on friday at evening time", "scope": "a", "importance": 0.9}], NOW + 2 * DAY)
    e.update(next(r.id for r in e.table().collect() if r.text == "Editor: light mode please"), importance=0.5)
    e.ingest([{"text": "Editor: light mode please now", "scope": "a", "importance": 0.95}], NOW + 3 * DAY)
    assert {r.text: r.importance for r in e.table().collect()}["Editor: light mode please"] == pytest.approx(0.65)
    assert [r.text for r in e.retrieve(["deploys env:prod"], NOW + 5, ["a"]).where("timestamp_ms < 1750000000005").collect()] == ["Deploys of env:prod run on friday evening"]
    assert e.retrieve(["which mode for the editor"], NOW + 5, ["a"], reranker=word_overlap).first().text == "Editor: light mode please"


def test_import_numbers_and_embeds(spark, tmp_path):
    e = MemoryEngine(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("a1", "The first imported row", "s"), ("a2", "Another imported row", "s"), ("a3", "x", "s")], "id string, text string, scope string").selectExpr("*", "cast(null as double) as importance", "cast(0 as bigint) as timestamp_ms")
    assert e.import_rows(rows) == 2
    got = e.table().collect()
    assert sorted(r.row_no is not None for r in got) == [True, True] and len({r.row_no for r in got}) == 2 and all(r.vector for r in got)
    assert e.recall(["first imported row"], NOW).first().text == "The first imported row"


def test_injection_and_its_notes(spark):
    fine = {"state": "confirmed", "memory_layer": "durable"}
    long = "word " * 80
    mem = memories(spark, [(1, long, {"meta": fine}), (2, "Second <b>line</b> here", {"meta": fine | {"last_injected_at": 5, "bad_recall_count": 2}}), (3, long, {"meta": fine}), (4, long, {"meta": fine | {"state": "pending"}}), (5, long, {"meta": fine | {"suppressed_until_turn": 9}}), (6, long, {"meta": fine | {"memory_layer": "archive"}}), (7, long, {"meta": fine}), (8, "", {"meta": fine})])
    pool = spark.createDataFrame([(1, i, i) for i in range(1, 9)] + [(2, 7, 1)], "query_no bigint, row_no bigint, place int")
    given = inject(pool, mem, turn=9, items=10, chars=400)
    assert {(r.query_no, r.row_no): r.taken for r in given.collect()} == {(1, 1): 180, (1, 2): 16, (1, 3): 180, (1, 7): 24, (2, 7): 180}
    assert all(len(r.line) == r.taken for r in given.collect())
    assert {r.row_no for r in inject(pool, mem, turn=10, items=10, chars=4000).collect()} == {1, 2, 3, 5, 7}
    shown = spark.createDataFrame([(1, 2), (3, 1), (3, 0)], "row_no bigint, turn int")
    assert {r.row_no for r in inject(pool, mem, turn=9, shown=shown, items=10).where("query_no = 1").collect()} == {2, 3, 7}
    note = {r.row_no: r for r in noted(given, mem, NOW, 9).collect()}
    assert (note[2].bad_recall_count, note[2].suppressed_until_turn, note[2].injected_count) == (3, 17, 1) and (note[7].bad_recall_count, note[7].suppressed_until_turn) == (0, 0)


def test_reflection_lines(spark):
    def row(n, text, days, **meta):
        return n, text, NOW - days * DAY, json.dumps({"type": "memory-reflection-mapped"} | meta)

    rows = [
        row(1, "**Check** the  logs first", 1, mappedKind="lesson"), row(2, "check the logs FIRST", 3, mappedKind="lesson", usedFallback=True), row(3, "Old lesson", 61, mappedKind="lesson"), row(4, "(none captured)", 1, mappedKind="lesson"),
        row(5, "Derived: keep it short", 2, mappedKind="decision", agentId="other"), row(6, "Use the small box", 2, mappedKind="decision", agentId="main", quality=9, baseWeight=2), row(7, "no kind", 1), (8, None, None, None), (9, "x", NOW, "{broken"),
    ]
    mem = spark.createDataFrame(rows, "row_no bigint, text string, timestamp_ms bigint, metadata string")
    lines = reflections.weighted_lines(mem, NOW, agent="me")
    got = {(r.kind, r.line): (r.place, r.score) for r in reflections.ranked_lines(lines).collect()}
    f = lambda d, k: 1 / (1 + np.exp(reflections.KINDS[k][1] * (d - reflections.KINDS[k][0])))
    assert got == {("lesson", "Check the  logs first"): (1, pytest.approx(0.81 * (f(1, "lesson") + 0.75 * f(3, "lesson")))), ("decision", "Use the small box"): (1, pytest.approx(2 * f(2, "decision")))}
    assert reflections.weighted_lines(mem, NOW).where("line = 'keep it short'").count() == 1
    assert reflections.ranked_lines(lines.where("false")).count() == 0


def test_envelopes_are_taken_off(spark):
    block = "Conversation info (untrusted metadata):\n```json\n{}\n```\n"
    texts = [None, "", "plain  text\n\n\n\nhere ", block + "hello there", block + block + "@bot do it", RESET + " and so on\n\nreal question", RESET + "\none", RESET + "\none\ntwo\nthree", "[UNTRUSTED DATA x]\nabc\n[END UNTRUSTED DATA]\nyes", "System: [12:00] Exec completed (ok)\nwhat now", "<@!42> hi all"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(without_envelope(df.t)).collect()]
    assert got == [None, "", "plain  text\n\nhere", "hello there", "do it", "real question", "", "two\nthree", "yes", "what now", "hi all"]


def test_lexical_hits(spark):
    mem = spark.createDataFrame([(1, "Find ERR-42 here", "x", "y", "z", 5), (2, "none", "err-42", "y", "z", 9), (3, "err-42 again", "", None, "", 7), (4, None, None, None, "see err-42", None), (5, "err-4", "", "", "", 1)], "row_no bigint, text string, l0 string, l1 string, l2 string, timestamp_ms bigint")
    q = spark.createDataFrame([(1, " ERR-42 "), (2, ""), (3, None), (4, "err-42"), (5, "absent")], "query_no bigint, text string")
    got = [(r.query_no, r.row_no, r.rank) for r in lexical_hits(mem, q, 3).orderBy("query_no", "rank").collect()]
    assert got == [(n, row, i + 1) for n in (1, 4) for i, row in enumerate((3, 1, 2))]
    assert lexical_hits(mem, q, 9).where("query_no = 1 and row_no = 4").first().score == pytest.approx(0.84 * 0.96)
    assert lexical_hits(mem.where("false"), q, 3).count() == 0 and lexical_hits(mem, q.where("false"), 3).count() == 0


def test_json_of_replies():
    assert json_of('Sure!\n```json\n{"a": [1, 2,],}\n```\nbye') == {"a": [1, 2]}
    assert json_of('so {"text": "he said "no" twice", "n": {"x": 1}} and {"b": 2}') == {"text": 'he said "no" twice', "n": {"x": 1}}
    assert json_of('{"a": "two\nlines\tand \\"quotes\\""}') == {"a": 'two\nlines\tand "quotes"'}
    assert json_of(None) is json_of("") is json_of("no object") is json_of("{never closed") is json_of("```[1]```") is None
