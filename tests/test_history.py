"""Histories of facts against a plain sweep."""

from __future__ import annotations

import datetime as dt
import random

from memspark.operators.history import fact_history

SCHEMA = "update_no bigint, memory_id string, scope string, fact_key string, l2_content string, tier string, valid_from bigint, invalidated_at bigint, supersedes string, timestamp_ms bigint, received_at timestamp, extra string"
T0 = dt.datetime(2024, 1, 1)


def row(n, mid, key, content, vf, inval=None, sup=None, scope="global", tier="core", ts=1):
    return (n, mid, scope, key, content, tier, vf, inval, sup, ts, T0 + dt.timedelta(seconds=n), "x")


def plain(rows):
    """The rule, row by row."""
    import re

    def norm(k):
        k = re.sub(r"\s+", " ", (k or "").lower()).strip()
        return re.sub(r"[。.!?]+$", "", k).strip() or None

    facts, by_id = {}, {}
    for r in rows:
        by_id.setdefault(r[1], []).append(r)

    def fact(r, seen=()):
        if norm(r[3]):
            return ((r[2] or "").strip().lower() or "global", norm(r[3]))
        if r[8] is None or r[8] in seen or r[8] not in by_id:
            return None
        return min(filter(None, (fact(x, (*seen, r[8])) for x in by_id[r[8]])), default=None)

    for r in rows:
        if (f := fact(r)) is None:
            continue
        vf = r[6] if r[6] is not None else r[9]
        cur = facts.setdefault(f, {})
        if vf not in cur or (r[10], r[0]) > (cur[vf][10], cur[vf][0]):
            cur[vf] = r
    out = set()
    for f, cur in facts.items():
        starts = sorted(cur)
        run = None
        for s, nxt in zip(starts, [*starts[1:], None]):
            r = cur[s]
            own = r[7] if r[7] is not None and r[7] >= s else None
            ends = [e for e in (own, nxt) if e is not None]
            e = min(ends) if ends else None
            if e is not None and e <= s:
                continue
            state = (r[4], r[5])
            if run and run[1] == s and run[2] == state:
                run = (run[0], e, state)
            else:
                if run:
                    out.add((*f, run[0], -1 if run[1] is None else run[1]))
                run = (s, e, state)
        if run:
            out.add((*f, run[0], -1 if run[1] is None else run[1]))
    return out


def check(spark, rows):
    got = [tuple(r[:4]) for r in fact_history(spark.createDataFrame(rows, SCHEMA)).select("scope", "fact_key", "valid_from", "valid_to").collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain(rows)


def test_gaps_restatements_corrections_and_keyless_chains(spark):
    rows = [
        row(1, "a", "Entities:Status .", "x", 10),
        row(2, "b", "entities:status", "x", 20),  # touches and equals: one version
        row(3, "c", " entities:  status!", "y", 30, inval=40),  # then a gap
        row(4, "d", "entities:status", "y", 50, inval=5),  # impossible end is ignored
        row(5, "e", None, "z", 60, sup="d"),
        row(6, "f", "  ", "w", 70, sup="e"),  # keyless after keyless
        row(7, "g", None, "lost", 80, sup="nowhere"),
        row(8, "h", None, "circle", 80, sup="i"),
        row(9, "i", None, "circle", 81, sup="h"),
        row(10, "b", "entities:status", "late", 20),  # correction, received last
        row(11, "j", "entities:status", "n", None, ts=90),
        row(12, "k", "entities:status", None, 95, tier=None),
        row(13, "l", "entities:status", None, 99, tier=None),
        row(14, "m", "entities:status", "q", 100, inval=100),  # no length
        row(15, "n", "other", "q", 5, scope=None),
        row(16, "o", "other", "q", 6, scope=" GLOBAL "),
    ]
    check(spark, rows)


def test_long_fact_crosses_words(spark):
    r = random.Random(3)
    rows, t = [], 0
    for n in range(700):
        t += r.randint(1, 3)
        rows.append(row(n, f"m{n}", "hot", r.choice("ab") if n > 400 else "a", t, inval=t + 1 if r.random() < 0.2 else None))
    check(spark, rows)


def test_empty(spark):
    assert fact_history(spark.createDataFrame([], SCHEMA)).count() == 0
