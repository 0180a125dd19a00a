"""Encoding: chunks equal the whole, round trips, empty and null texts."""

from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from memspark.llm.encoding import decode, encode, encode_chunked, encode_corpus, stitched


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=300))
def test_round_trip(text):
    text = text.encode("utf-8", "ignore").decode()
    assert decode(encode(text)) == text


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\n\n", "# Key", "\r\n", "'s", "'ll", "it's", "word", "Größe", "数据", "123", "!?", "x" * 30, "\t ", "🙂"]), max_size=120), st.integers(5, 60), st.integers(3, 40))
def test_stitched_pieces_give_the_ids_of_the_whole(parts, chunk, overlap):
    text = "".join(parts)
    assert "".join(stitched(text, chunk, overlap)) == text
    assert encode_chunked([text, None, ""], chunk=chunk, overlap=overlap) == [encode(text), [], []]


def test_texts_over_a_chunk_are_cut():
    text = "Some words of a note, and then some more of them. " * 60
    assert len(stitched(text)) == 4 and encode_chunked([text]) == [encode(text)]


def test_chunks_equal_whole(spark):
    r = random.Random(2)
    make = lambda n: "".join(r.choice([" ", "  ", "\n", "it's", "word", "Größe", "数据", "123", "!?", "x" * 30, "\t "]) for _ in range(n))
    texts = [None, "", " ", "x" * 900, " " * 700, *[make(n) for n in (5, 40, 300, 900)], "数" * 400]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id bigint, text string, ids int")
    got = {r.doc_id: list(r.ids) for r in encode_corpus(df, chunk=30, overlap=20, spread=100, spread_overlap=40).collect()}
    assert got == {i: encode(t) for i, t in enumerate(texts)}
    assert got[0] == got[1] == []
    twice = df.unionByName(df.where("doc_id = 7")).unionByName(df.where("doc_id = 8").selectExpr("7L as doc_id", "text", "ids"))
    rows = [list(r.ids) for r in encode_corpus(twice, chunk=30, overlap=20, spread=100, spread_overlap=40).where("doc_id = 7").collect()]
    assert sorted(rows) == sorted([got[7], got[7], got[8]])
    assert encode_corpus(df.where("false")).count() == 0
