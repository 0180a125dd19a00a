"""Top-k retrieval of a set of queries: vector channels, BM25, lexical hits; and their fusion.

The stated query set is taken in blocks of bounded size; each block goes to all tasks with the scan (its size is
bounded by ``QUERY_BLOCK``), every task keeps its own top-k per query in numpy, and the tasks' lists meet in one
small exchange. Nothing grows with the square of the corpus, and no row of the corpus is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions import score as S
from memspark.functions.norm import words
from memspark.operators.skew import small
from memspark.session import checkpoint

QUERY_BLOCK, ROW_BLOCK = 2048, 2048
#: Cells of a table of queries by words that one task holds: 64 MB.
CELLS = 8_000_000
#: Digits to which scores are compared; equal scores go by id.
DIGITS = 9
K1, B = 1.2, 0.75
#: Weights of the channels, and of the layers in a lexical hit.
CHANNELS = {"vector": 0.35, "l0": 0.15, "l1": 0.10, "l2": 0.10, "bm25": 0.30}
VECTOR_ONLY = {"vector": 0.50, "l0": 0.20, "l1": 0.15, "l2": 0.15}
LEXICAL = {"text": 1.0, "l0": 0.98, "l1": 0.92, "l2": 0.96}
HITS = "query_no bigint, channel string, row_no bigint, raw double"


def blocks(queries: DataFrame, key: str, size: int = QUERY_BLOCK) -> Iterator[list]:
    """The query set in order of ``key``, ``size`` rows at a time; one block is held at once."""
    last = None
    while True:
        part = queries if last is None else queries.where(F.col(key) > last)
        rows = part.orderBy(key).limit(size).collect()
        if rows:
            yield rows
            last = rows[-1][key]
        if len(rows) < size:
            return


def _unit(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of the usable vectors (of length ``dim``, finite, not all zero), and which rows those are."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    fit = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    m = np.asarray(column.filter(fit).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
    n = np.sqrt((m * m).sum(axis=1))
    fine = np.isfinite(n) & (n > 0)
    ok = fit.to_numpy(zero_copy_only=False).astype(bool)
    ok[ok] = fine
    return m[fine] / n[fine, None], ok


class _Best:
    """The k best of each query so far, by rounded score and id."""

    def __init__(self, n: int, k: int):
        self.k, self.ids, self.scores = k, np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), -np.inf)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        scores = np.round(scores, DIGITS)
        # only what reaches the k-th best so far, and of this block the k best with their ties
        least = self.scores[:, -1]
        if scores.shape[1] > self.k:
            least = np.maximum(least, np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k])
        q, j = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))
        if not len(q):
            return
        at = np.arange(len(q)) - np.searchsorted(q, q)
        s, i = np.full((len(scores), at.max() + 1), -np.inf), np.full((len(scores), at.max() + 1), np.iinfo(np.int64).max)
        s[q, at], i[q, at] = scores[q, j], ids[j]
        s, i = np.concatenate([self.scores, s], axis=1), np.concatenate([self.ids, i], axis=1)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.scores, self.ids = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)

    def rows(self, numbers: list[int], channel: str) -> pa.RecordBatch:
        q, j = np.nonzero(np.isfinite(self.scores))
        cols = [np.asarray(numbers, np.int64)[q], np.full(len(q), channel), self.ids[q, j], self.scores[q, j]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query_no", "channel", "row_no", "raw"])


def _top(hits: DataFrame, k: int) -> DataFrame:
    """Of each query and channel the k best, with their rank; the input holds at most k per task."""
    w = Window.partitionBy("query_no", "channel").orderBy(F.desc("raw"), "row_no")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vector_hits(corpus: DataFrame, queries: DataFrame, k: int, columns: dict[str, str] | None = None, query_vector: str = "vector", within: str | None = None) -> DataFrame:
    """query_no, channel, row_no, raw (cosine), score 1 / (1 + (1 - cosine)), rank of the k nearest per channel.

    ``columns`` maps channels to vector columns; all are searched in one scan. Missing, all-zero, not finite vectors
    and such of another length than the query's hit nothing. ``queries`` have query_no and a vector. With ``within``, a
    text column of both, a query hits only rows that have its value.
    """
    columns = columns or {"vector": "vector"}
    out = None
    kept = F.lit("").alias("_s") if within is None else F.col(within).alias("_s")
    for rows in blocks(queries.select("query_no", F.col(query_vector).alias("_v"), kept).where("_v is not null and size(_v) > 0"), "query_no"):
        # queries of each length of vector: their unit vectors and numbers
        asked = {}
        for dim in sorted({len(r["_v"]) for r in rows}):
            same = [r for r in rows if len(r["_v"]) == dim]
            unit, ok = _unit(pa.array([r["_v"] for r in same], pa.list_(pa.float32())), dim)
            if ok.any():
                asked[dim] = unit, [r["query_no"] for r, o in zip(same, ok) if o], [r["_s"] for r, o in zip(same, ok) if o]

        def run(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            best = {(c, dim): _Best(len(numbers), k) for c in columns for dim, (_, numbers, _) in asked.items()}
            for b in batches:
                ids = b.column("row_no").to_numpy(zero_copy_only=False)
                for c, name in columns.items():
                    for lo in range(0, b.num_rows, ROW_BLOCK):
                        for dim, (unit, _, own) in asked.items():
                            m, fine = _unit(b.column(name).slice(lo, ROW_BLOCK), dim)
                            if not len(m):
                                continue
                            scores = unit @ m.T
                            if within is not None:
                                known = pa.array(sorted({x for x in own if x is not None}), pa.string())
                                mine = pc.fill_null(pc.index_in(pa.array(own, pa.string()), value_set=known), -1).to_numpy(zero_copy_only=False)
                                theirs = pc.fill_null(pc.index_in(b.column("_s").slice(lo, ROW_BLOCK), value_set=known), -2).to_numpy(zero_copy_only=False)[fine]
                                scores = np.where(mine[:, None] == theirs[None, :], scores, -np.inf)
                            best[c, dim].add(ids[lo : lo + ROW_BLOCK][fine], scores)
            for (c, dim), found in best.items():
                yield found.rows(asked[dim][1], c)

        part = corpus.select("row_no", *columns.values(), *([] if within is None else [F.col(within).alias("_s")])).mapInArrow(run, HITS)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = corpus.sparkSession.createDataFrame([], HITS)
    return _top(out, k).withColumn("score", S.similarity(F.col("raw")))


def _term_blocks(rows: list) -> Iterator[list]:
    """Parts of a block of queries whose table of queries by words has at most ``CELLS`` cells (or one query)."""
    part, seen = [], set()
    for r in rows:
        new = seen.union(r["_w"])
        if part and (len(part) + 1) * len(new) > CELLS:
            yield part
            part, new = [], set(r["_w"])
        part.append(r)
        seen = new
    if part:
        yield part


def bm25_hits(corpus: DataFrame, queries: DataFrame, k: int, text: str = "text") -> DataFrame:
    """query_no, channel, row_no, raw, score, rank of the k best by BM25 over distinct query words.

    The corpus is tokenised once. Statistics cover all of it; of the document frequencies only those of a block's words
    are gathered. A row without a word of the query is no hit; null and empty texts have length 0.
    """
    docs = checkpoint(corpus.select("row_no", words(F.col(text)).alias("_w")))
    n, avg = docs.agg(F.count(F.lit(1)), F.avg(F.size("_w"))).first()
    asked = queries.select("query_no", F.array_distinct(words(F.col("text"))).alias("_w")).where(F.size("_w") > 0)
    vocabulary = small(asked.select(F.explode("_w").alias("w")).distinct())
    frequency = checkpoint(docs.select(F.explode(F.array_distinct("_w")).alias("w")).join(vocabulary, "w", "left_semi").groupBy("w").agg(F.count(F.lit(1)).alias("df")))
    out = None
    for rows in (part for block in blocks(asked, "query_no") for part in _term_blocks(block)):
        terms = sorted({w for r in rows for w in r["_w"]})
        at = {w: i for i, w in enumerate(terms)}
        df = np.zeros(len(terms))
        wanted = corpus.sparkSession.createDataFrame([(w,) for w in terms], "w string")
        for r in frequency.join(F.broadcast(wanted), "w").collect():
            df[at[r["w"]]] = r["df"]
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        numbers = [r["query_no"] for r in rows]
        # what a task needs is as large as the queries; the table of queries by words is made there
        q_at = np.repeat(np.arange(len(rows)), [len(r["_w"]) for r in rows])
        t_at = np.array([at[w] for r in rows for w in r["_w"]])

        def run(batches: Iterator[pa.RecordBatch], terms=terms, numbers=numbers, idf=idf, q_at=q_at, t_at=t_at, avg=avg) -> Iterator[pa.RecordBatch]:
            best, known = _Best(len(numbers), k), pa.array(terms, pa.string())
            has = np.zeros((len(numbers), len(terms)))
            has[q_at, t_at] = idf[t_at]
            step = max(1, min(ROW_BLOCK // 4, CELLS // len(terms)))
            for b in batches:
                ids = b.column("row_no").to_numpy(zero_copy_only=False)
                for lo in range(0, b.num_rows, step):
                    part = b.column("_w").slice(lo, step)
                    length = pc.list_value_length(part).to_numpy(zero_copy_only=False)[:, None]
                    term = pc.index_in(part.flatten(), value_set=known)
                    hit = pc.is_valid(term).to_numpy(zero_copy_only=False)
                    row, term = pc.list_parent_indices(part).to_numpy(zero_copy_only=False)[hit], term.drop_null().to_numpy(zero_copy_only=False)
                    used, term = np.unique(term, return_inverse=True)
                    tf = np.bincount(row * len(used) + term, minlength=len(part) * len(used)).reshape(len(part), len(used)).astype(float) if len(used) else np.zeros((len(part), 0))
                    weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(avg or 0, 1e-12)))
                    scores = has[:, used] @ weight.T
                    best.add(ids[lo : lo + len(part)], np.where(scores > 0, scores, -np.inf))
            yield best.rows(numbers, "bm25")

        part = docs.mapInArrow(run, HITS)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = corpus.sparkSession.createDataFrame([], HITS)
    return _top(out, k).withColumn("score", S.bm25_sigmoid(F.col("raw")))


def fuse(hits: DataFrame, weights: dict[str, float] = CHANNELS, k: int = S.RRF_K) -> DataFrame:
    """query_no, row_no, fused, bm25: weighted reciprocal ranks, with the rules for strong and lone BM25 hits.

    A BM25 score of 0.75 or more lifts the fused score to 0.92 of it; a row that the main vector channel did not find
    has its BM25 score.
    """
    w = S.by_name(F.col("channel"), weights, 0.0)
    score = lambda c: F.max(F.when(F.col("channel") == c, F.col("score")))
    g = hits.groupBy("query_no", "row_no").agg(F.sum(w / (k + F.col("rank"))).alias("rrf"), score("bm25").alias("bm25"), score("vector").alias("vector"))
    lifted = F.when(F.col("bm25") >= 0.75, F.greatest("rrf", F.col("bm25") * 0.92)).otherwise(F.col("rrf"))
    return g.withColumn("fused", F.when(F.col("vector").isNull() & F.col("bm25").isNotNull(), S.clamp01(F.col("bm25"))).otherwise(lifted))


def lexical_score(query: F.Column, layers: dict[str, F.Column]) -> F.Column:
    """Highest weighted score of a substring hit of the query in a layer; null without one."""
    q = F.lower(F.trim(query))
    base = F.least(F.lit(0.95), 0.72 + 0.02 * F.length(q))
    return F.greatest(*[F.when(F.lower(c).contains(q), base * LEXICAL[name]) for name, c in layers.items()])
