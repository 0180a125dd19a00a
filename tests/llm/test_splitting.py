"""Splitting: sizes, overlaps, round trip, boundaries, kinds."""

from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from memspark.llm.pieces import cuts, is_forced, split, split_fields


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab .!?\n。é😀", max_size=900), st.integers(12, 90))
def test_pieces_cover_the_text(text, limit):
    overlap = limit // 5
    got = split(text, limit, overlap)
    assert all(e - s <= limit for s, e in got)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for (_, e), (s, _) in zip(got, got[1:]):
        assert e - s == overlap
    core = cuts(text, limit, overlap)
    assert "".join(text[a:b] for a, b in core) == text


def test_strongest_boundary_wins():
    text = "word " * 30 + "end.\n\n" + "next " * 30
    (a, b), (c, _) = cuts(text, 200, 20)[:2] if len(cuts(text, 200, 20)) == 2 else (cuts(text, 200, 20)[0], cuts(text, 200, 20)[1])
    assert text[a:b].endswith("\n\n") and c == b


def test_forced():
    assert is_forced("x" * 11, 10) and not is_forced("x" * 10, 10) and not is_forced("x" * 6 + "." + "x" * 6, 10)


def test_bad_overlap():
    with pytest.raises(ValueError):
        cuts("x" * 50, 10, 10)


def test_fields(spark):
    long = "A sentence of some length. " * 200
    rows = [(1, long, None, 5), (2, "x" * 4001, json.dumps({"l2_content": "short"}), 5), (3, None, json.dumps({"l2_content": long}), 5), (4, "", '{"l2_content": "' + long, 5), (5, "x" * 4000, json.dumps({"l2_content": {"a": long}}), 5)]
    df = spark.createDataFrame(rows, "row_no bigint, text string, metadata string, piece int")
    got = split_fields(df)
    assert {tuple(r) for r in got.where("piece_no = 0").select("row_no", "field_name", "kind").collect()} == {(1, "text", "natural"), (2, "text", "forced"), (3, "l2_content", "natural")}
    for r in got.collect():
        assert len(r.piece) <= 4000 and len(r.piece) == r.end_pos - r.start_pos
    assert split_fields(df.where("false")).count() == 0


def test_boundary_far_from_the_middle():
    text = "word " * 200 + "x" * 2400 + " word" * 200
    assert len(text) == 4400
    core = cuts(text)
    assert all(text[b - 1].isspace() for _, b in core[:-1]) and max(b - a for a, b in core) <= 3800
    assert core == [(0, 1000), (1000, 4400)]
    assert cuts("x" * 4400) == [(0, 2200), (2200, 4400)]
    for text in ("w " * 20 + "x" * 3870 + " word" * 100, "w " * 20 + "x" * 9000, "x" * 3900 + "y. " * 900):
        got = split(text)
        assert got[0][0] == 0 and got[-1][1] == len(text) and all(0 <= s < e <= s + 4000 for s, e in got)
        assert all(e - s == 200 for (_, e), (s, _) in zip(got, got[1:]))
