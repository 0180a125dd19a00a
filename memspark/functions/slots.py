"""Preferences for an item of a brand, and the guard that keeps different items of one brand apart."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: How a liking of items of a brand is said, in Chinese and English; what parts items; where a clause ends.
LIKING = (
    r"(?:^|[\s，,。；;！!？?])(?:我|用户)?(?:很|更|还)?(?:喜欢|爱吃|偏爱|常吃|想吃)(?:吃|喝|用|买)?(?P<brand>[一-鿿A-Za-z0-9&·'\-]{1,24})的(?P<items>[一-鿿A-Za-z0-9&·'\-\s、,，和及与/]{1,80})",
    r"(?i)\b(?:i|user)?\s*(?:really\s+|still\s+|also\s+)?(?:like|love|prefer|enjoy)\s+(?P<items>[a-z0-9'&\-\s]{1,80})\s+from\s+(?P<brand>[a-z0-9'&\-\s]{1,40})",
)
PARTS = r"(?i)(?:、|,|，|/|以及|及|与|和| and | & )"
CLAUSE_END = r"(?i)(?:因为|所以|但是|不过|if |when |because |but )"
ROLE = r"(?m)^\[(?:用户|助手)\]\s*"
QUOTES, MARKS, ARTICLES = "“\"'`‘’", "”\"'`‘’。！!？?，,；;:：", r"(?i)\b(?:the|a|an)\s+"


def _plain(s: str) -> str:
    return re.sub(r"\s+", " ", re.sub(ROLE, "", s)).strip()


def _token(s: str) -> str:
    s = _plain(s).lstrip(QUOTES).rstrip(MARKS)
    return re.sub(r"\s+", "", re.sub(ARTICLES, "", s)).lower()


def brand_items(text: str | None) -> tuple[str, list[str]] | None:
    """Brand and items of the first liking of both that ``text`` states."""
    plain = _plain(text or "")
    for pattern in LIKING:
        m = re.search(pattern, plain)
        if not m:
            continue
        clause = re.split(CLAUSE_END, m["items"])[0] or m["items"]
        items = [t for t in map(_token, re.split(PARTS, clause)) if t]
        if (brand := _token(m["brand"])) and items:
            return brand, items
    return None


def slot(c: Column) -> Column:
    """struct(brand, item) of a text that states one item of a brand; null otherwise. In Arrow batches."""

    @F.pandas_udf("brand string, item string")
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [f if (f := brand_items(t)) and len(f[1]) == 1 else (None, [None]) for t in texts]
        return pd.DataFrame({"brand": [b for b, _ in found], "item": [i[0] for _, i in found]}, dtype=object)

    s = run(c)
    return F.when(s["brand"].isNotNull(), s)
