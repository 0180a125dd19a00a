"""Problem 8: encoding texts with a public tokenizer, in overlapping chunks.

A text becomes overlapping chunks that are pre-tokenised apart from each other; in each overlap the first boundary that
both chunks have is the cut (a pre-token begins there whatever came before, since the pattern never looks back), and
where they have none in common the chunks stay together. The pieces between cuts are encoded and their ids put in order.
Decoding joins the raw bytes of the ids.

Texts up to ``SPREAD`` characters have their chunks in one task, which encodes the pieces of many texts at once. Longer
ones are first cut into sections that go to different tasks, by the same rule.
"""

from __future__ import annotations

import base64
import importlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.session import widen

#: Characters of a chunk and of what it shares with the next; those of a section of a long text.
CHUNK, CHUNK_OVERLAP = 768, 96
SPREAD, SPREAD_OVERLAP = 200_000, 2_000
VOCABULARY = "byte_bpe_50k.tiktoken"


@lru_cache(maxsize=4)
def tokenizer(vocabulary: str = VOCABULARY):
    """The tokenizer of a vocabulary file of ranks: a path, or a name known to the public_tokenizers package."""
    import tiktoken

    known = importlib.import_module("public_tokenizers")
    path = vocabulary if "/" in vocabulary else known.path(vocabulary)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=known.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _pattern():
    import regex

    return regex.compile(importlib.import_module("public_tokenizers").PATTERN)


def stitched(text: str, chunk: int = CHUNK, overlap: int = CHUNK_OVERLAP) -> list[str]:
    """The pieces of a text between the cuts where the boundaries of neighbouring chunks meet, in order."""
    if len(text) <= chunk + overlap:
        return [text]
    cuts, before = [0], set()
    for a in range(0, len(text), chunk):
        end = a + chunk + overlap
        at, meet = boundaries(text[a:end], a, end >= len(text)), []
        if a:
            # a chunk's own start says nothing: it begins there whatever the text
            meet = before.intersection(x for x in at if a < x < a + overlap)
            if meet:
                cuts.append(min(meet))
            else:
                at = boundaries(text[cuts[-1] : end], cuts[-1], end >= len(text))
        before = {x for x in at if x >= a + chunk}
        if end >= len(text):
            break
    return [text[x:y] for x, y in zip(cuts, [*cuts[1:], len(text)])]


def encode_chunked(texts: list[str | None], vocabulary: str = VOCABULARY, chunk: int = CHUNK, overlap: int = CHUNK_OVERLAP) -> list[list[int]]:
    """Ids of each text by its stitched pieces."""
    pieces, of = [], [0]
    for t in texts:
        pieces += stitched(t, chunk, overlap) if t else []
        of.append(len(pieces))
    ids = tokenizer(vocabulary).encode_ordinary_batch(pieces, num_threads=1)
    return [[i for part in ids[x:y] for i in part] for x, y in zip(of, of[1:])]


def encode(text: str | None, vocabulary: str = VOCABULARY) -> list[int]:
    """Ids without special tokens; null and empty texts have the empty list."""
    return tokenizer(vocabulary).encode_ordinary(text) if text else []


def decode(ids: list[int], vocabulary: str = VOCABULARY) -> str:
    return b"".join(tokenizer(vocabulary).decode_single_token_bytes(i) for i in ids).decode("utf-8", "replace")


def boundaries(text: str, start: int, last: bool) -> list[int]:
    """Starts of pre-tokens of a chunk, in positions of the whole text, where a piece may end: not after white space,
    as how a run of it is split depends on what follows. The end of all but the last chunk is unsure."""
    # pre-tokens lie side by side, so each begins where those before it end
    parts = _pattern().findall(text)
    at = list(accumulate(map(len, parts if last else parts[:-2])))
    return [x + start for x in (at[:-1] if last else at) if not text[x - 1].isspace()]


def token_counts(texts: list[str | None], vocabulary: str = VOCABULARY) -> list[int]:
    return [len(x) for x in tokenizer(vocabulary).encode_ordinary_batch([t or "" for t in texts], num_threads=1)]


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, chunk: int = CHUNK, overlap: int = CHUNK_OVERLAP, spread: int = SPREAD, spread_overlap: int = SPREAD_OVERLAP) -> DataFrame:
    """``key``, ``ids`` of every row; null and empty texts have an empty list. Ids equal those of the whole text."""

    def encoded(*keys: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = encode_chunked(b.column(text).to_pylist(), vocabulary, chunk, overlap)
                yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], pa.array(ids, pa.list_(pa.int32()))], names=[*keys, "ids"])

        return run

    base = widen(docs.select(F.col(key).cast("bigint").alias(key), text), key)
    size = F.coalesce(F.length(text), F.lit(0))
    out = base.where(size <= spread).mapInArrow(encoded(key), f"{key} bigint, ids array<int>")
    # rows with the same key are told apart by their text; equal ones are encoded once
    rows = base.where(size > spread).withColumn("_u", F.sha2(F.col(text), 256))
    long = rows.dropDuplicates([key, "_u"])

    def sections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sections with the overlap after each; a text is sliced where it is, so none is copied as a whole."""
        for b in batches:
            for k, u, t in zip(b.column(key).to_pylist(), b.column("_u").to_pylist(), b.column(text).to_pylist()):
                for a in range(0, len(t), spread):
                    part = [[k], [u], [len(t)], [a], [t[a : a + spread + spread_overlap]]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(part, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()))], names=[key, "_u", "n", "a", "t"])

    def zones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            head, tail = [], []
            for n, a, t in zip(*(b.column(c).to_pylist() for c in ("n", "a", "t"))):
                at = boundaries(t, a, a + len(t) >= n)
                head.append([x for x in at if x < a + spread_overlap])
                tail.append([x for x in at if x >= a + spread])
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("_u"), b.column("a"), pa.array(head, lists), pa.array(tail, lists)], names=[key, "_u", "a", "head", "tail"])

    # pass 1: sections, pre-tokenised in parallel
    cut = long.mapInArrow(sections, f"{key} bigint, _u string, n int, a int, t string")
    marked = cut.repartition(key, "_u", "a").mapInArrow(zones, f"{key} bigint, _u string, a int, head array<bigint>, tail array<bigint>")
    before = marked.select(key, "_u", (F.col("a") + spread).alias("a"), "tail")
    common = F.array_min(F.filter(F.array_intersect("tail", "head"), lambda x: x > F.col("a")))
    found = marked.select(key, "_u", "a", "head").join(before, [key, "_u", "a"]).withColumn("cut", common).where(F.col("cut").isNotNull())
    # pass 2: the pieces between cuts, encoded in parallel; one list of cuts per text is the text's section count
    plan = found.groupBy(key, "_u").agg(F.array_sort(F.collect_list("cut")).alias("cuts"))
    whole = long.join(plan, [key, "_u"], "left").select(key, "_u", F.coalesce("cuts", F.array().cast("array<bigint>")).alias("cuts"), text)

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, u, cuts, t in zip(*(b.column(c).to_pylist() for c in (key, "_u", "cuts", text))):
                for i, (x, y) in enumerate(zip([0, *cuts], [*cuts, len(t)])):
                    part = [[k], [u], [i], [t[x:y]]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, z) for v, z in zip(part, (pa.int64(), pa.string(), pa.int32(), pa.string()))], names=[key, "_u", "piece", text])

    pieces = whole.mapInArrow(between, f"{key} bigint, _u string, piece int, {text} string")
    parts = pieces.repartition(key, "_u", "piece").mapInArrow(encoded(key, "_u", "piece"), f"{key} bigint, _u string, piece int, ids array<int>")
    joined = parts.groupBy(key, "_u").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece", "ids"))), lambda x: x["ids"])).alias("ids"))
    return out.unionByName(rows.select(key, "_u").join(joined, [key, "_u"]).drop("_u"))
