"""Time expressions in queries, English and Chinese: a half-open range of days, and the query without the expression."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_EN = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
MONTHS = {m: i + 1 for i, m in enumerate(_EN)} | {m[:3]: i + 1 for i, m in enumerate(_EN)}
_ZH = "一 二 三 四 五 六 七 八 九 十 十一 十二".split()
_M = "|".join(sorted(MONTHS, key=len, reverse=True))


def _month(y: int, m: int) -> datetime:
    """First day of a month; months beyond a year's count on."""
    return datetime(y + (m - 1) // 12, (m - 1) % 12 + 1, 1)


def _span_days(n: int, unit: str) -> int:
    u = unit.lower()
    return n * (7 if u.startswith("week") or u == "周" else 30 if u.startswith("month") or u in ("月", "个月") else 1)


def _rules():
    day, dd = timedelta(days=1), timedelta
    whole = lambda y, m: (_month(y, m), _month(y, m + 1))
    monday = lambda t: t - dd(days=t.weekday())
    zh_month = lambda s: int(s) if s.isdigit() else _ZH.index(s) + 1
    ago = lambda t, n: (t - dd(days=n), t - dd(days=n - 1))

    def named(m, t):
        w = m[1].lower()
        if w in ("上周", "week"):
            return monday(t) - dd(days=7), monday(t)
        if w in ("上个月", "month"):
            return whole(t.year, t.month - 1)
        y = t.year - {"去年": 1, "year": 1, "前年": 2, "大前年": 3}[w]
        return datetime(y, 1, 1), datetime(y + 1, 1, 1)

    # in order: the first that matches holds
    return [
        (r"(?i)after:(\d{4})-(\d{1,2})(?:-(\d{1,2}))?", lambda m, t: (datetime(int(m[1]), int(m[2]), int(m[3] or 1)), None)),
        (r"(?i)before:(\d{4})-(\d{1,2})(?:-(\d{1,2}))?", lambda m, t: (None, datetime(int(m[1]), int(m[2]), int(m[3])) + day if m[3] else _month(int(m[1]), int(m[2]) + 1))),
        (r"\b(\d{4})-(\d{2})-(\d{2})\b", lambda m, t: (datetime(int(m[1]), int(m[2]), int(m[3])), datetime(int(m[1]), int(m[2]), int(m[3])) + day)),
        (r"(\d{4})年((?:十一|十二|[一二三四五六七八九十])|\d{1,2})月", lambda m, t: whole(int(m[1]), zh_month(m[2]))),
        (rf"(?i)\b({_M})\s+(\d{{4}})\b", lambda m, t: whole(int(m[2]), MONTHS[m[1].lower()])),
        (rf"(?i)\b(?:since|after)\s+({_M})\b", lambda m, t: (_month(t.year, MONTHS[m[1].lower()]), None)),
        (r"(\d{4})年(?:的)?", lambda m, t: (datetime(int(m[1]), 1, 1), datetime(int(m[1]) + 1, 1, 1))),
        (r"(?i)\b(?:in|from|during)\s+(\d{4})\b", lambda m, t: (datetime(int(m[1]), 1, 1), datetime(int(m[1]) + 1, 1, 1))),
        (r"最近(\d+)\s*(天|周|月|个月)", lambda m, t: (t - dd(days=_span_days(int(m[1]), m[2])), t + day)),
        (r"(?i)\blast\s+(\d+)\s*(days?|weeks?|months?)\b", lambda m, t: (t - dd(days=_span_days(int(m[1]), m[2])), t + day)),
        (r"(?i)\b(today)\b|今天", lambda m, t: (t, t + day)),
        (r"(?i)\b(yesterday)\b|昨天", lambda m, t: (t - day, t)),
        (r"(?i)\b(this week)\b|本周|这周", lambda m, t: (monday(t), t + day)),
        (r"(?i)\b(this month)\b|本月|这个月", lambda m, t: (_month(t.year, t.month), t + day)),
        (r"(?i)\b(this year)\b|今年", lambda m, t: (datetime(t.year, 1, 1), t + day)),
        (r"去年(\d{1,2})月", lambda m, t: whole(t.year - 1, int(m[1]))),
        (r"上个月(\d{1,2})[号日]", lambda m, t: (_month(t.year, t.month - 1) + dd(days=int(m[1]) - 1), _month(t.year, t.month - 1) + dd(days=int(m[1])))),
        (r"(上周|上个月|去年|前年|大前年)", named),
        (r"(?i)\blast\s+(week|month|year)\b", named),
        (r"(?i)\b(\d+)\s*(days?|weeks?|months?)\s*ago\b", lambda m, t: ago(t, _span_days(int(m[1]), m[2]))),
    ]


RULES = [(re.compile(p), f) for p, f in _rules()]


def parse_temporal(query: str, now: datetime) -> tuple[datetime | None, datetime | None, str]:
    """(after, before, query without the expression); no expression gives no bounds and the query as it is."""
    today = datetime(now.year, now.month, now.day)
    for pattern, rule in RULES:
        m = pattern.search(query or "")
        if m:
            try:
                after, before = rule(m, today)
            except (ValueError, OverflowError):
                continue
            rest = re.sub(r"\s+", " ", query.replace(m[0], "", 1)).strip()
            return after, before, rest or query
    return None, None, query


def with_temporal(df: DataFrame, text: str, now: datetime) -> DataFrame:
    """Adds after_ms, before_ms (epoch milliseconds UTC, null if open) and cleaned."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ms = lambda t: None if t is None else int((t - datetime(1970, 1, 1)).total_seconds() * 1000)
        for f in frames:
            got = [parse_temporal(q or "", now) for q in f[text]]
            yield f.assign(after_ms=pd.array([ms(a) for a, _, _ in got], "Int64"), before_ms=pd.array([ms(b) for _, b, _ in got], "Int64"), cleaned=[c for _, _, c in got])

    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{spec}, after_ms bigint, before_ms bigint, cleaned string")


def in_range(ts: F.Column, after: F.Column, before: F.Column) -> F.Column:
    return (after.isNull() | (ts >= after)) & (before.isNull() | (ts < before))
