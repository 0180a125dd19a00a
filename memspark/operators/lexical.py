"""Rows that hold a whole query as it is, for when words cannot be searched."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memspark.operators.search import LEXICAL, blocks

FOUND = "query_no bigint, row_no bigint, timestamp_ms bigint, score double"


def _finder(texts: list[str]):
    """Which of ``texts`` a string holds, found in one pass over it."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for i, t in enumerate(texts):
        a.add_word(t, i)
    a.make_automaton()
    return lambda s: {i for _, i in a.iter(s)}


def lexical_hits(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_no, row_no, score, rank of the k best rows that hold the query, in any letter case, in their text or a layer.

    ``corpus``: row_no, text, l0, l1, l2, timestamp_ms. The score grows with the query's length and is that of the best
    layer; equal ones go by time, newest first, then by row_no. Blank queries hit nothing. Queries go to the scan in
    blocks; a task keeps at most k rows of each.
    """
    out = None
    asked = queries.select("query_no", F.lower(F.trim(F.coalesce("text", F.lit("")))).alias("_t")).where("_t != ''")
    for rows in blocks(asked, "query_no"):
        texts = sorted({r["_t"] for r in rows})
        of = {t: [r["query_no"] for r in rows if r["_t"] == t] for t in texts}
        base = [min(0.95, 0.72 + 0.02 * len(t)) for t in texts]

        def run(batches: Iterator[pa.RecordBatch], texts=texts, of=of, base=base) -> Iterator[pa.RecordBatch]:
            find, best = _finder(texts), [[] for _ in texts]
            for b in batches:
                cols = [b.column(c).to_pylist() for c in LEXICAL]
                for j, (n, at) in enumerate(zip(b.column("row_no").to_pylist(), b.column("timestamp_ms").to_pylist())):
                    hit: dict[int, float] = {}
                    for weight, col in zip(LEXICAL.values(), cols):
                        for i in find(col[j]) if col[j] else ():
                            hit[i] = max(hit.get(i, 0.0), weight)
                    for i, weight in hit.items():
                        best[i].append((-round(base[i] * weight, 9), -(at if at is not None else -(1 << 62)), n, at))
                        if len(best[i]) > 4 * k:
                            best[i] = sorted(best[i], key=lambda x: x[:3])[:k]
            out = [(q, n, at, -s) for i, t in enumerate(texts) for s, _, n, at in sorted(best[i], key=lambda x: x[:3])[:k] for q in of[t]]
            cols = list(zip(*out)) or [[], [], [], []]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["query_no", "row_no", "timestamp_ms", "score"])

        part = corpus.select("row_no", *[F.lower(c).alias(c) for c in LEXICAL], "timestamp_ms").mapInArrow(run, FOUND)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = corpus.sparkSession.createDataFrame([], FOUND)
    w = Window.partitionBy("query_no").orderBy(F.desc("score"), F.desc("timestamp_ms"), "row_no")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_no", "row_no", "score", "rank")


