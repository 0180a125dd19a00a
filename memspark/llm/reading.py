"""Problem 10: reading level by gradient-boosted regression trees, cut into levels on cross-validated predictions.

The prose of a document (code, logs, headings and speakers' names left out, list items and chat turns kept) becomes
distributions of length, vocabulary, syntax and cohesion. Trees are fitted on labelled documents; predictions for
folds of whole sources that the fit has not seen give the cut points between levels, so levels are calibrated across
sources. The model is bounded (its trees) and goes to the executors with the task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.llm.trees import BoostedTrees
from memspark.session import checkpoint, widen

#: Labelled documents the fit uses at most, those of least hash; all of them up to this bound.
LABEL_BOUND = 6_000
LEAST_SENTENCES = 5
LEVELS = (1, 2, 3, 4, 5)
FOLDS = 5

_LINES = re.compile(r"\r\n|[\n\r\v\f\u0085\u2028\u2029]")
_FENCE = re.compile(r"\s*(```|~~~)")
_HEADING = re.compile(r"\s*#{1,6}\s")
_ITEM = re.compile(r"\s*(?:[-*•‣–+]|\d{1,3}[.)])\s+")
_TURN = re.compile(r"\s*[A-Za-z][\w .-]{0,30}:\s+")
_CODE = re.compile(r"^\s*(?:\$ |>>> |def |class |return\b|import |from \w+ import|if \(|for \(|[{}\[\]\"<]|//|/\*|\w+ ?= ?|\w+\(|ok \(\d+ rows\)|\[?\d{4}-\d\d-\d\d|\[?\d\d:\d\d)|[;{}]\s*$|\w=\w|\w\(\w*\)")
_END = re.compile(r"(?<=[.!?。！？])[\"'”’)\]]*\s+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_VOWELS = re.compile(r"[aeiouy]+")
#: Words that join clauses.
CONNECTIVES = frozenset("although because but if since so that though unless until when whereas whether which while and or".split())
SENTENCE_WORDS = 3
#: Words over which lexical variety is measured.
WINDOW = 100
NAMES = ("words_mean words_sd words_q10 words_q50 words_q90 word_chars word_chars_sd long7 long10 long13 syllables many_syllables connectives commas subordinate variety rare overlap sentences chars_mean".split())


def english(c: Column) -> Column:
    """True for English in any spelling or regional form."""
    return F.lower(F.trim(c)).rlike(r"^(en|eng|english)([-_ ].*)?$")


def sentences(text: str | None) -> list[str]:
    """Sentences of running prose, in order."""
    blocks: list[list[str]] = [[]]
    fenced = False
    for line in _LINES.split((text or "").replace("\ufeff", "")):
        if _FENCE.match(line):
            fenced = not fenced
            blocks.append([])
            continue
        if fenced or not line.strip() or _HEADING.match(line):
            blocks.append([])
            continue
        lead = _ITEM.match(line) or _TURN.match(line)
        if lead:
            line = line[lead.end() :]
            blocks.append([])
        if _CODE.search(line):
            blocks.append([])
            continue
        blocks[-1].append(line.strip())
    out = []
    for b in blocks:
        for s in _END.split(" ".join(b)):
            if len(_WORD.findall(s)) >= SENTENCE_WORDS:
                out.append(s)
    return out


def variety(words: list[str], window: int = WINDOW) -> float:
    """Mean share of distinct words over consecutive windows of the whole text, the last one aligned to its end."""
    last = max(len(words) - window, 0)
    return float(np.mean([len(set(words[a : a + window])) / len(words[a : a + window]) for a in sorted({*range(0, last, window), last})]))


def features(found: list[str]) -> list[float]:
    """The features named in ``NAMES`` of at least one sentence."""
    split = [[w.lower() for w in _WORD.findall(s)] for s in found]
    n = np.array([len(x) for x in split], float)
    flat = [w for x in split for w in x]
    chars = np.array([len(w) for w in flat], float)
    syl = np.array([max(1, len(_VOWELS.findall(w))) for w in flat], float)
    sets = [set(x) for x in split]
    over = [len(a & b) / max(1, min(len(a), len(b))) for a, b in zip(sets, sets[1:])]
    joins = sum(w in CONNECTIVES for w in flat)
    return [
        n.mean(), n.std(), *np.quantile(n, (0.1, 0.5, 0.9)), chars.mean(), chars.std(), (chars >= 7).mean(), (chars >= 10).mean(), (chars >= 13).mean(),
        syl.mean(), (syl >= 4).mean(), joins / len(split), sum(s.count(",") for s in found) / len(split), sum(any(w in CONNECTIVES for w in x) for x in split) / len(split),
        variety(flat), sum(c >= 15 for c in chars) / len(split), float(np.mean(over)) if over else 0.0, len(split), sum(map(len, found)) / len(found),
    ]


def document_features(docs: DataFrame) -> DataFrame:
    """doc_id, source, sentences, x of English documents with at least ``LEAST_SENTENCES`` sentences of prose."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, s, t in zip(*(b.column(c).to_pylist() for c in ("doc_id", "source", "text"))):
                found = sentences(t)
                if len(found) >= LEAST_SENTENCES:
                    rows.append((i, s, len(found), [float(v) for v in features(found)]))
            if rows:
                i, s, n, x = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(s, pa.string()), pa.array(n, pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "source", "sentences", "x"])

    base = docs.where(english(F.col("lang")) & F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text")
    return widen(base, "doc_id").mapInArrow(run, "doc_id bigint, source string, sentences int, x array<double>")


def cut_points(pred: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Between neighbouring levels the point that parts their held-out predictions with least errors."""
    cuts = []
    for k in LEVELS[:-1]:
        order = np.argsort(pred, kind="stable")
        above = (level[order] > k).astype(float)
        errors = np.r_[0, above.cumsum()] + np.r_[0, (1 - above).cumsum()][-1] - np.r_[0, (1 - above).cumsum()]
        best = np.nonzero(errors == errors.min())[0]
        i = int(best[len(best) // 2])
        low, high = (pred[order[i - 1]] if i else k), (pred[order[i]] if i < len(pred) else k + 1)
        cuts.append((low + high) / 2 if len(pred) else k + 0.5)
    return np.maximum.accumulate(np.array(cuts, float))


class ReadingModel:
    """Trees, cut points, and the held-out share of right levels and of levels at most one off, by fold of sources."""

    def __init__(self, x: np.ndarray, y: np.ndarray, source: list[str]):
        names = sorted(set(source))
        # sources from large to small, dealt to the folds in turn; one source is split into folds by place
        rank = {s: i for i, s in enumerate(sorted(names, key=lambda s: (-source.count(s), s)))}
        fold = np.array([rank[s] % FOLDS for s in source]) if len(names) > 1 else np.arange(len(y)) % FOLDS
        level = np.clip(np.rint(y), LEVELS[0], LEVELS[-1])
        held, self.report = np.zeros(len(y)), []
        for f in sorted(set(fold.tolist())):
            out = fold == f
            held[out] = BoostedTrees().fit(x[~out], y[~out]).predict(x[out]) if (~out).any() else y[out]
        self.cuts = cut_points(held, level)
        for f in sorted(set(fold.tolist())):
            out = fold == f
            diff = np.abs(self._level(held[out]) - level[out])
            self.report.append((f, int(out.sum()), float((diff == 0).mean()), float((diff <= 1).mean())))
        self.trees = BoostedTrees().fit(x, y)

    def _level(self, pred: np.ndarray) -> np.ndarray:
        return LEVELS[0] + np.searchsorted(self.cuts, pred, side="right")

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self._level(self.trees.predict(x))


def fit(found: DataFrame, labels: DataFrame, bound: int = LABEL_BOUND) -> ReadingModel | None:
    """Model of the labelled documents (raters averaged), at most ``bound`` of them; None without any."""
    mean = labels.where("reading_level is not null").groupBy("doc_id").agg(F.avg("reading_level").alias("y"))
    rows = found.join(mean, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).select("x", "y", F.coalesce(F.lower(F.trim("source")), F.lit("")).alias("source")).collect()
    if not rows:
        return None
    return ReadingModel(np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows]), [r["source"] for r in rows])


def reading_levels(docs: DataFrame, labels: DataFrame, bound: int = LABEL_BOUND) -> DataFrame:
    """doc_id, source, sentences, reading_level. No labels, or none on prose, give no rows."""
    found = checkpoint(document_features(docs))
    model = fit(found, labels, bound)
    if model is None:
        return found.select("doc_id", "source", "sentences", F.lit(None).cast("int").alias("reading_level")).where("false")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                level = model.predict(np.array(b.column("x").to_pylist()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("sentences"), pa.array(level, pa.int32())], names=["doc_id", "source", "sentences", "reading_level"])

    return found.mapInArrow(run, "doc_id bigint, source string, sentences int, reading_level int")
