"""Problem 3: splitting oversized texts at natural boundaries, by recursive bisection.

A text over the limit is cut at the strongest boundary near its middle (paragraph, line, sentence, clause, word), else
at the boundary nearest to it, and inside a word only where there is none; halves over the limit less the overlap are cut again, then each piece but the first is extended to the
left by the overlap. Positions count code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from memspark.llm.metatext import text_fields

LIMIT, OVERLAP = 4000, 200
#: Sentence ends, Latin and full-width.
SENTENCE_ENDS = ".!?。！？"
#: Boundaries from strong to weak; the cut lies at the end of the match.
BOUNDARIES = [re.compile(p) for p in (r"\n[^\S\n]*\r?\n\s*", r"[\r\n]+", rf"[.!?]+[\"'”’)\]]*\s+|[。！？]+[\"'”’)\]]*\s*", r"[;:,、，；：]\s*", r"\s+")]
FORCED = re.compile(rf"[^\s{SENTENCE_ENDS}]+")


def is_forced(text: str, limit: int = LIMIT) -> bool:
    """True if some stretch longer than the limit has neither white space nor a sentence end."""
    return any(m.end() - m.start() > limit for m in FORCED.finditer(text))


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Core pieces (start, end), in order and without gaps, each at most ``limit - overlap`` long, the first at most
    ``limit`` where it has no boundary.

    A text within the limit, the empty text too, is one piece.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and below the limit")
    if len(text) <= limit:
        return [(0, len(text))]
    most, out, todo = limit - overlap, [], [(0, len(text))]
    while todo:
        a, b = todo.pop()
        if b - a <= most:
            out.append((a, b))
            continue
        mid, reach = (a + b) // 2, min((b - a) // 4, most // 2)
        at = None
        for pattern in BOUNDARIES:
            ends = [m.end() for m in pattern.finditer(text, max(a, mid - reach), min(b, mid + reach))]
            ends = [e for e in ends if a < e < b]
            if ends:
                at = min(ends, key=lambda e: (abs(e - mid), e))
                break
        if at is None:
            ends = [m.end() for pattern in BOUNDARIES for m in pattern.finditer(text, a, b) if a < m.end() < b]
            # the second piece begins an overlap before its core
            ends = [e for e in ends if a or e >= overlap]
            if not ends and not a and b <= limit:
                out.append((a, b))  # no overlap comes before the first piece: it needs no cut inside a word
                continue
            at = min(ends, key=lambda e: (abs(e - mid), e), default=mid)
        todo += [(at, b), (a, at)]
    return out


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Pieces (start, end): the cores with the overlap before them."""
    return [(a - overlap if a else a, b) for a, b in cuts(text, limit, overlap)]


SCHEMA = "row_no bigint, field_name string, kind string, piece_no int, start_pos bigint, end_pos bigint, piece string"


def split_fields(memories: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every field over the limit: row_no, field_name, kind, piece_no, start_pos, end_pos, piece.

    Null and short fields have none. Each text is handled whole in one task; the pieces leave it one by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        for b in batches:
            for r, f, t in zip(*(b.column(c).to_pylist() for c in ("row_no", "field_name", "content"))):
                if len(t) <= limit:
                    continue
                kind = "forced" if is_forced(t, limit) else "natural"
                rows = [(r, f, kind, i, s, e, t[s:e]) for i, (s, e) in enumerate(split(t, limit, overlap))]
                yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*rows), types)], names=names)

    return text_fields(memories, limit + 1).mapInArrow(run, SCHEMA)
