"""Problem 7: personal information in free text, by a character BiLSTM-CRF, replaced by typed placeholders.

Texts become overlapping windows that are tagged in batches of like length. Of each window only the part away from
its edges counts, and a span that two windows see in part is put together again over the whole text. The tags give the
spans; a check only widens one to the words it cuts. It takes no letters or digits from a tagged span, and drops only what
cannot be of its kind: an e-mail without an at, a phone of under 5 digits, a number without digits or in encoded data, an address in ``key=value``. Weights come with the package; ``pii_train`` makes them.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from memspark.llm.metatext import text_fields
from memspark.llm.tagger import KINDS, PAD, decode, encode
from memspark.session import widen

WEIGHTS = os.path.join(os.path.dirname(__file__), "pii_weights.npz")
WINDOW, MARGIN, CELLS = 240, 40, 512


@lru_cache(maxsize=2)
def weights(path: str = WEIGHTS) -> dict[str, np.ndarray]:
    with np.load(path) as f:
        return {k: f[k] for k in f.files}


def tag_texts(texts: list[str], w: dict[str, np.ndarray]) -> list[np.ndarray]:
    """A tag for each character of each text. Equal windows are decoded once."""
    codes = [encode(t) for t in texts]
    out = [np.zeros(len(c), np.int8) for c in codes]
    place: dict[bytes, list[tuple[int, int]]] = {}
    for i, c in enumerate(codes):
        for a in range(0, max(len(c) - 2 * MARGIN, 1), WINDOW - 2 * MARGIN):
            if len(c):
                place.setdefault(c[a : a + WINDOW].tobytes(), []).append((i, a))
    keys = sorted(place, key=len)
    for lo in range(0, len(keys), CELLS):
        part = keys[lo : lo + CELLS]
        grid = np.full((len(part[-1]), len(part)), PAD, np.int64)
        for j, k in enumerate(part):
            grid[: len(k), j] = np.frombuffer(k, np.uint8)
        tags = decode(w, grid)
        for j, k in enumerate(part):
            col = tags[: len(k), j]
            if not col.any():
                continue
            for i, a in place[k]:
                left = MARGIN if a else 0
                right = len(k) if a + len(k) == len(codes[i]) else len(k) - MARGIN
                out[i][a + left : a + right] = col[left:right]
    return out


def spans(tags: np.ndarray) -> list[tuple[int, int, str]]:
    """Spans of a text's tags; a tag that continues nothing begins one."""
    found, a, kind = [], 0, -1
    at = np.nonzero(tags)[0]
    last = -2
    for i in at.tolist():
        t = int(tags[i])
        k = (t - 1) // 2
        if i != last + 1 or k != kind or t % 2:
            if kind >= 0:
                found.append((a, last + 1, KINDS[kind]))
            a, kind = i, k
        last = i
    if kind >= 0:
        found.append((a, last + 1, KINDS[kind]))
    return found


# -- the exact check ---------------------------------------------------------------------------------------------------
_L = r"[^\W\d_]"
#: Scripts written without spaces: a letter next to a tagged one need not be of the same word.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
#: Words no name ends with: what follows is part of it.
_PARTICLES = frozenset("van von vom zu zur der den de del della di da dos das du la le ter ten bin ibn al el".split())


#: At signs, as such or in words.
_AT = re.compile(r"[@＠﹫]|(?<![A-Za-z0-9+/])(?:at|arroba|chez|ät|bei)(?![A-Za-z0-9+/])", re.I)
#: Characters of encoded data; a longer run of them is no number of a person.
_ENCODED, ENCODED = re.compile(r"[A-Za-z0-9+/=]"), 40
_JOINT = re.compile(rf"['’-](?={_L})")
_NEXT_WORD = re.compile(rf" (?={_L})")


def _possible(text: str, a: int, b: int, kind: str) -> bool:
    """False for what no item of ``kind`` in any form can be."""
    if kind == "email":
        return bool(_AT.search(text, a, b))
    if kind == "phone":
        return sum(c.isdigit() for c in text[a:b]) >= 5
    if kind == "id_number":
        lo, hi = a, b
        while lo and _ENCODED.match(text, lo - 1):
            lo -= 1
        while hi < len(text) and _ENCODED.match(text, hi):
            hi += 1
        inside = hi - lo > ENCODED and all(_ENCODED.match(c) for c in text[a:b])
        return not inside and any(c.isdigit() for c in text[a:b])
    return kind != "address" or "=" not in text[a : b + 1]


def _one_word(x: str, y: str) -> bool:
    return x.isalnum() and y.isalnum() and not _UNSPACED.match(x) and not _UNSPACED.match(y)


def settle_span(text: str, a: int, b: int, kind: str) -> tuple[int, int] | None:
    """[a, b) widened to whole words; None if it cannot be of ``kind``. White space and punctuation at its ends are left
    out, but for the plus or bracket that a number begins with."""
    if not any(c.isalnum() for c in text[a:b]):
        return None
    while not text[a].isalnum() and text[a] not in "+(":
        a += 1
    while not text[b - 1].isalnum() and not (text[b - 1] == "." and _abbreviated(text[a:b], kind)):
        b -= 1
    while True:
        while a and _one_word(text[a - 1], text[a]):
            a -= 1
        while b < len(text) and _one_word(text[b - 1], text[b]):
            b += 1
        # a name that breaks off at a particle or a joint goes on with the next word
        rest = _JOINT.match(text, b) if kind == "name" else None
        if not rest and kind == "name" and text[a:b].split()[-1].lower() in _PARTICLES:
            rest = _NEXT_WORD.match(text, b)
        if not rest or _UNSPACED.match(text[b + 1]):
            return (a, b) if _possible(text, a, b, kind) else None
        b += 2


def _abbreviated(item: str, kind: str) -> bool:
    """True if the stop at the end of a tagged span belongs to it: after a short word of an address or an initial."""
    last = item.split()[-1]
    return kind == "address" and len(last) == 3 and last[:-1].isalpha() or kind == "name" and len(last) == 2


def _trimmed(text: str, a: int, b: int) -> tuple[int, int] | None:
    """[a, b) without what is no letter or digit at its ends; None if nothing is left."""
    at = [i for i in range(a, b) if text[i].isalnum()]
    return (at[0], at[-1] + 1) if at else None


def find(texts: list[str], w: dict[str, np.ndarray]) -> list[list[tuple[int, int, str]]]:
    """Items of each text: start, end, kind, in order and without overlap."""
    out = []
    for text, tags in zip(texts, tag_texts(texts, w)):
        found = []
        if tags.any():
            for a, b, kind in spans(tags):
                s = settle_span(text, a, b, kind)
                if not s:
                    continue
                if found and s[0] < found[-1][1]:
                    # two tagged parts of one item are one; of two kinds the later has what is left
                    if kind == found[-1][2]:
                        found[-1] = (found[-1][0], max(found[-1][1], s[1]), kind)
                        continue
                    s = _trimmed(text, found[-1][1], s[1])
                if s:
                    found.append((*s, kind))
        out.append(found)
    return out


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with each item replaced by ``[KIND]``."""
    parts, at = [], 0
    for a, b, kind in found:
        parts += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(parts) + text[at:]


ITEMS = "row_no bigint, field_name string, pii_type string, start_pos bigint, end_pos bigint"


def personal_items(memories: DataFrame, weights_path: str = WEIGHTS) -> DataFrame:
    """One row per item in ``text`` and readable ``l2_content``; null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights(weights_path)
        for b in batches:
            rows = [(r, f, kind, a, e) for r, f, found in zip(b.column("row_no").to_pylist(), b.column("field_name").to_pylist(), find(b.column("content").to_pylist(), w)) for a, e, kind in found]
            if rows:
                types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[x.split()[0] for x in ITEMS.split(", ")])

    return widen(text_fields(memories), "row_no").mapInArrow(run, ITEMS)


def redacted(memories: DataFrame, weights_path: str = WEIGHTS) -> DataFrame:
    """row_no, field_name, content (with placeholders), items of every field that is not null or empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights(weights_path)
        for b in batches:
            texts = b.column("content").to_pylist()
            found = find(texts, w)
            yield pa.RecordBatch.from_arrays([b.column("row_no"), b.column("field_name"), pa.array([redact(t, f) for t, f in zip(texts, found)], pa.string()), pa.array([len(f) for f in found], pa.int32())], names=["row_no", "field_name", "content", "items"])

    return widen(text_fields(memories), "row_no").mapInArrow(run, "row_no bigint, field_name string, content string, items int")
