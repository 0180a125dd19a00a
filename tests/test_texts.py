"""Text rules, time expressions, conversations, embedding, chunks, admission."""

from __future__ import annotations

import json
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from memspark.functions import text as X
from memspark.functions.chunker import chunk_sizes, chunks
from memspark.functions.embed import backfill, mean_vector
from memspark.functions.ids import memory_id
from memspark.functions.temporal import parse_temporal
from memspark.metadata import with_smart_meta
from memspark.operators.admission import lcs, overlap_f1, support, tokens
from memspark.sources.conversations import parse, plaintext_turns, turns

NOW = datetime(2024, 5, 15, 13, 30)  # a Wednesday


@pytest.mark.parametrize(
    ("query", "after", "before", "rest"),
    [
        ("what happened yesterday?", (2024, 5, 14), (2024, 5, 15), "what happened ?"),
        ("bugs in March 2023", (2023, 3, 1), (2023, 4, 1), "bugs in"),
        ("上个月的会议", (2024, 4, 1), (2024, 5, 1), "的会议"),
        ("last week plans", (2024, 5, 6), (2024, 5, 13), "plans"),
        ("this week", (2024, 5, 13), (2024, 5, 16), "this week"),
        ("notes 2 weeks ago", (2024, 5, 1), (2024, 5, 2), "notes"),
        ("last 3 months", (2024, 2, 15), (2024, 5, 16), "last 3 months"),
        ("after:2024-02 x", (2024, 2, 1), None, "x"),
        ("before:2024-12 x", None, (2025, 1, 1), "x"),
        ("on 2024-02-29", (2024, 2, 29), (2024, 3, 1), "on"),
        ("2023年十二月", (2023, 12, 1), (2024, 1, 1), "2023年十二月"),
        ("去年3月的", (2023, 3, 1), (2023, 4, 1), "的"),
        ("on 2024-02-31 nothing", None, None, "on 2024-02-31 nothing"),
        ("no time here", None, None, "no time here"),
    ],
)
def test_temporal(query, after, before, rest):
    a, b, c = parse_temporal(query, NOW)
    assert (a, b, c) == (after and datetime(*after), before and datetime(*before), rest)


def test_conversations(spark):
    tree = {"mapping": {"r": {"children": ["a"]}, "a": {"parent": "r", "children": ["b"], "message": {"author": {"role": "user"}, "content": {"parts": ["hi there"]}}}, "b": {"parent": "a", "message": {"author": {"role": "assistant"}, "content": {"parts": ["yes", 3]}, "create_time": 5}}}}
    hosted = {"chat_messages": [{"sender": "human", "text": " q ", "created_at": "t"}, {"sender": "assistant", "text": ""}]}
    team = [{"text": "x", "ts": "0", "user": "u"}, {"text": "y", "bot_id": "b", "ts": "1.5"}]
    jsonl = "\n".join([json.dumps({"type": "human", "message": {"content": "a"}}), "broken", json.dumps({"message": {"role": "assistant", "content": [{"text": "b"}, {"text": "c"}]}, "timestamp": "z"})])
    plain = "ignored\nUser: one\n more\nAI: two\n\nSystem:\nhuman: three"
    assert parse(json.dumps(tree)) == [("user", "hi there", None), ("assistant", "yes", "5")]
    assert parse(json.dumps(hosted)) == [("user", "q", "t")]
    assert [(r, c) for r, c, _ in parse(json.dumps(team))] == [("user", "x"), ("assistant", "y")]
    assert parse(jsonl) == [("user", "a", None), ("assistant", "b\nc", "z")]
    df = spark.createDataFrame([(1, plain), (2, json.dumps(tree)), (3, json.dumps(hosted)), (4, json.dumps(team)), (5, jsonl), (6, None), (7, "")], "conv_id bigint, content string")
    got = {}
    for r in turns(df).orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.content))
    assert got[1] == [("user", "one\n more"), ("assistant", "two"), ("user", "three")]
    assert [len(got[i]) for i in (2, 3, 4, 5)] == [2, 1, 2, 2] and not {6, 7} & set(got)
    assert plaintext_turns(df.where("false")).count() == 0


def test_smart_metadata_defaults(spark):
    rows = [
        (1, "a", "my name is Bo", "fact", None, None, 5, None),
        (2, "b", "Status: paused. ", "entity", " Global ", 0.2, 5, '{"confidence": null, "access_count": "3", "tier": "x", "state": "gone", "invalidated_at": 3}'),
        (3, "c", "t", "other", "s", 0.2, 5, '{"confidence": "1.4", "memory_category": "cases", "source": "session-summary", "access_count": -2'),
        (4, "d", None, None, "s", 0.2, None, '{"confidence": "1.4", "source": "session-summary", "valid_from": 7, "invalidated_at": 9}'),
    ]
    df = spark.createDataFrame(rows, "row_no bigint, id string, text string, category string, scope string, importance double, timestamp_ms bigint, metadata string")
    a, b, c, d = with_smart_meta(df).orderBy("row_no").collect()
    assert (a.memory_category, a.confidence, a.importance, a.scope, a.memory_layer) == ("profile", 0.7, 0.7, "global", "durable")
    assert (b.confidence, b.access_count, b.tier, b.state, b.invalidated_at, b.fact_key) == (0.0, 3, "working", "confirmed", None, "entities:status")
    assert (c.confidence, c.memory_category, c.access_count) == (0.7, "patterns", 0)
    assert (d.confidence, d.state, d.memory_layer, d.valid_from, d.invalidated_at, d.l1) == (1.0, "archived", "reflection", 7, 9, "- ")


def test_rules(spark):
    df = spark.createDataFrame([("User likes tea", "user doesn't like tea"), ("User likes tea", "they do not like coffee"), ("a", "b")], "a string, b string")
    assert [r[0] for r in df.select(X.contradicts(F.col("a"), F.col("b"))).collect()] == [True, False, False]
    one = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c(F.col("t"))).first()[0]
    assert one(X.is_noise, " hey ") and one(X.is_noise, "do you remember me at all") and not one(X.is_noise, "The build is red.")
    assert one(X.skip_retrieval, "git push") and not one(X.skip_retrieval, "你记得吗") and not one(X.skip_retrieval, "why?? so")
    assert one(X.topic, "rollback the deploy, then login") == "deploy" and one(X.topic, "nothing") is None
    assert one(X.redact_secrets, "Bearer abc.def and password=hunter22 x") == "Bearer [REDACTED] and [REDACTED] x"
    assert one(X.reason_key, "Score 0.35  below 12") == "score # below #"
    import uuid

    assert one(lambda c: memory_id(F.lit("s"), c), "tëxt") == str(uuid.uuid5(uuid.UUID("7f3e8a2b-4c5d-4e6f-8a9b-1c2d3e4f5a6b"), "s\0tëxt"))


def test_support():
    assert tokens("Ab中文 c1") == ["ab", "中", "文", "c1"] and lcs(list("abcde"), list("xbxdxe")) == 3 and lcs([], ["a"]) == 0
    assert overlap_f1(["a", "b"], ["a", "b"]) == 1.0 and support(None, "x") == 0.0 and support("a b", "a b") == 1.0 and support("a b", None) == 0.0


def test_chunks_and_vectors(spark):
    text = ("A sentence stands here. " * 60).strip()
    got = chunks(text, 300, 30, 50)
    assert all(e - s <= 300 for s, e in got) and got[-1][1] == len(text) and all(text[e - 1] == "." for _, e in got)
    assert chunks("") == chunks("   ") == [] and chunks("x" * 700, 300, 30, 50)[0] == (0, 300)
    assert chunk_sizes("中文" * 50)[0] < chunk_sizes("latin text")[0]
    df = spark.createDataFrame([(1, "a b", None), (2, "a b", [0.0] * 32), (3, "c", [1.0] * 32), (4, None, None)], "row_no bigint, text string, vector array<float>")
    v = {r.row_no: r.vector for r in backfill(df, "vector", F.col("text")).collect()}
    assert v[1] == v[2] and abs(np.linalg.norm(v[1]) - 1) < 1e-5 and v[3] == [1.0] * 32 and not any(v[4])
    m = mean_vector(spark.createDataFrame([(1, [1.0, 3.0]), (1, [3.0, 5.0])], "k int, vector array<float>"), "k").first()
    assert m.vector == [2.0, 4.0]


def test_scopes_and_audits(spark, tmp_path):
    from memspark.functions import scopes as C
    from memspark.sources.audits import read_audits, top_reasons, write_audits

    assert C.accessible("a") == ["global", "agent:a", "reflection:agent:a"] and C.accessible("system") is None
    assert C.accessible("a", {"a": ["project:x"]}, ["custom:t"]) == ["project:x", "reflection:agent:a", "custom:t"]
    assert C.restrict(["project:x", "global"], "a") == ["global"] and C.restrict(None, "a") == C.accessible("a") and C.restrict(["q"], None) == ["q"]
    assert C.valid_scope("user:u") and not C.valid_scope("nope") and C.agent_of_session("agent:z:s1") == "z" and C.default_scope("") == "global"
    assert read_audits(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "a.jsonl").write_text('{"rejected_at": 1, "audit": {"reason": "score 0.3 low"}}\nbroken\n{"rejected_at": 2, "audit": {"reason": "Score 0.25  low"}}\n')
    audits = read_audits(spark, str(tmp_path / "a.jsonl")).where("rejected_at is not null")
    write_audits(audits, str(tmp_path / "out"))
    assert [tuple(r) for r in top_reasons(read_audits(spark, str(tmp_path / "out"))).collect()] == [("score # low", 2)]
