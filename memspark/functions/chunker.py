"""Sequential chunks of texts by size, with overlap: the plain splitter of long texts before embedding."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SENTENCE_END = re.compile(r"[.!?。！？]\s*")
#: Share of Han and kana from which a text counts as such, and the divisor of sizes for it.
CJK_SHARE, CJK_DIVISOR = 0.3, 2.5
CJK = re.compile(r"[぀-ヿ㐀-䶿一-鿿가-힯豈-﫿]")


def chunks(text: str, most: int = 4000, overlap: int = 200, least: int = 200) -> list[tuple[int, int]]:
    """(start, end) of trimmed chunks: cut after the last sentence end in reach, else line end, else white space,
    else at the limit. A blank text has none."""
    out, at = [], 0
    while at < len(text):
        end = len(text)
        if end - at > most:
            low, high = at + min(least, most), at + most
            cut = max((m.end() for m in SENTENCE_END.finditer(text, low, high)), default=0)
            cut = cut or text.rfind("\n", low, high) + 1 or max((m.start() for m in re.finditer(r"\s", text[low:high])), default=-low) + low
            end = cut if cut > at else high
        s, e = at, end
        while s < e and text[s].isspace():
            s += 1
        while e > s and text[e - 1].isspace():
            e -= 1
        if e > s:
            out.append((s, e))
        if end >= len(text):
            break
        at = max(end - overlap, at + 1)
    return out


def chunk_sizes(text: str, limit: int = 8192) -> tuple[int, int, int]:
    """(most, overlap, least) for a model's limit in tokens; smaller for Han and kana."""
    dense = [c for c in text if not c.isspace()]
    share = sum(bool(CJK.match(c)) for c in dense) / len(dense) if dense else 0.0
    d = CJK_DIVISOR if share > CJK_SHARE else 1
    return max(200, int(limit * 0.7 / d)), max(0, int(limit * 0.05 / d)), max(100, int(limit * 0.1 / d))


def chunk_rows(df: DataFrame, key: str, text: str, most: int = 4000, overlap: int = 200, least: int = 200) -> DataFrame:
    """key, chunk_no, start_pos, end_pos of every text; null and blank texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, i, s, e) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for i, (s, e) in enumerate(chunks(t, most, overlap, least))]
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=[key, "chunk_no", "start_pos", "end_pos"])

    return df.select(key, text).mapInArrow(run, f"{key} bigint, chunk_no int, start_pos bigint, end_pos bigint")
