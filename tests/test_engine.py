"""The engine on a temporary directory: storing twice, updating, forgetting, recalling, exporting."""

from __future__ import annotations

import json

import pytest

from memspark.plans.engine import MemoryEngine

NOW = 1_750_000_000_000
DAY = 86_400_000


@pytest.fixture
def engine(spark, tmp_path):
    e = MemoryEngine(spark, str(tmp_path / "store"))
    rows = [
        {"text": "The deploy pipeline failed on the staging server.", "scope": "project:a", "timestamp_ms": NOW - 3 * DAY},
        {"text": "User prefers dark mode in the editor.", "scope": " Project:A ", "category": "preference", "importance": 0.9},
        {"text": "Rollback of the release took nine minutes.", "scope": None, "timestamp_ms": NOW - 400 * DAY},
        {"text": "hello", "scope": "project:a"},
        {"text": None},
    ]
    assert e.store(rows, NOW) == 3
    assert e.store(rows, NOW) == 0
    return e


def test_recall_and_scopes(engine):
    got = engine.recall(["deploy pipeline staging server", "dark mode editor"], NOW, ["project:a"]).collect()
    assert [r.text[:10] for r in got if r.place == 1] == ["The deploy", "User prefe"]
    assert {r.scope for r in got} == {"project:a"}
    assert engine.recall(["deploy"], NOW, []).count() == 0
    assert engine.recall(["dark mode"], NOW, mode="bm25").first().text.startswith("User")


def test_temporal_recall(engine):
    got = engine.recall(["release rollback 10 days ago"], NOW, prefilter=True)
    assert got.count() == 0
    assert engine.recall(["deploy last 7 days"], NOW).where("text like 'Rollback%'").count() == 0


def test_update_by_prefix_and_patch(engine):
    i = engine.list(category="preference").first().id
    assert engine.update(i[:8], importance=0.25) and not engine.update("0000000f", importance=1.0)
    engine.patch_metadata([i], tier="core", note={"a": [1, "x"]})
    r = engine.list(category="preference").first()
    assert r.importance == 0.25 and json.loads(r.metadata) == {"tier": "core", "note": {"a": [1, "x"]}}
    engine.feedback([i], True)
    assert abs(json.loads(engine.list(category="preference").first().metadata)["feedback_weight"] - 0.575) < 1e-9


def test_forget_and_bulk_delete(engine):
    i = engine.list(category="preference").first().id
    engine.forget([i])
    assert engine.table().count() == 2
    engine.bulk_delete([], before_ms=NOW - 100 * DAY)
    assert engine.table().count() == 1
    with pytest.raises(ValueError):
        engine.bulk_delete([])
    assert len(engine.versions()) <= 2


def test_checkpoint_export_import(engine, spark, tmp_path):
    engine.checkpoint("State of the first session, in short.", "project:a", NOW - 5)
    engine.checkpoint("State of the second session, in short.", "project:a", NOW)
    assert engine.resume("project:a").first().text.startswith("State of the second")
    engine.export(str(tmp_path / "out"), ["project:a"])
    rows = spark.read.json(str(tmp_path / "out"))
    other = MemoryEngine(spark, str(tmp_path / "other"))
    assert other.import_rows(rows.select("row_no", "id", "text", "category", "scope", "importance", "timestamp_ms", "metadata")) == 4
    assert other.import_rows(rows.select("row_no", "id", "text", "category", "scope", "importance", "timestamp_ms", "metadata")) == 0
    assert {r.n for r in other.stats().where("scope is null and category is null").collect()} == {4}
    assert other.health().count() >= 1 and other.provenance([rows.first().id]).count() == 1
