"""Streams give what batches give; late rows beyond the watermark are dropped."""

from __future__ import annotations

import datetime as dt

from memspark.streaming.jobs import access_counts, events_stream, run_to_table, sessions, signals

T0 = dt.datetime(2024, 1, 1)


def events(spark, path, parts):
    for i, rows in enumerate(parts):
        df = spark.createDataFrame([(n, T0 + dt.timedelta(seconds=s), u, k, p) for n, s, u, k, p in rows], "event_id bigint, ts timestamp, user_id bigint, event_type string, props string")
        df.coalesce(1).write.parquet(f"{path}/p{i}")


def test_stream_equals_batch(spark, tmp_path):
    path = str(tmp_path / "ev")
    rows = [(i, i * 3, i % 2, "click", "{}") for i in range(40)] + [(99, 100_000, 1, "click", "{}")]
    events(spark, path, [rows])
    stream = access_counts(events_stream(spark, path + "/*"))
    run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {tuple(r) for r in access_counts(spark.read.parquet(path + "/*")).collect()}
    # the newest window is still open under the watermark
    assert got == {w for w in want if w[1] < T0 + dt.timedelta(seconds=90_000)} and len(got) > 20
    run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(got)


def test_signals_and_sessions(spark, tmp_path):
    path = str(tmp_path / "ev")
    rows = [(1, 0, 1, "error", '{"k": 1}'), (2, 5, 1, "error", '{"k": 1}'), (3, 9, 1, "error", '{"k": 2}'), (4, 9, 2, "error", '{"k": 1}'), (5, 9, 2, "view", "{}"), (6, 4000, 1, "view", "{}")]
    events(spark, path, [rows])
    run_to_table(signals(events_stream(spark, path + "/*")), str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    assert {(r.user_id, r.n) for r in sessions(spark.read.parquet(path + "/*")).collect()} == {(1, 3), (1, 1), (2, 2)}


def test_messages_are_read_once(spark, tmp_path):
    import json

    from memspark.streaming.jobs import message_stream

    d = tmp_path / "sessions"
    d.mkdir()
    (d / "a.jsonl").write_text(json.dumps({"type": "human", "message": {"content": " hi "}}) + "\nbroken\n" + json.dumps({"message": {"role": "assistant", "content": "yes"}}) + "\n")
    for _ in range(2):
        run_to_table(message_stream(spark, str(d)), str(tmp_path / "out"), str(tmp_path / "state"))
    assert {(r.role, r.content) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("user", "hi"), ("assistant", "yes")}
    (d / "b.jsonl").write_text(json.dumps({"type": "user", "message": {"content": "more"}}) + "\n")
    run_to_table(message_stream(spark, str(d)), str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
