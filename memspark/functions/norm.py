"""Column expressions for scopes, fact keys and words, shared by the core and the llm subpackage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters cut from the end of a fact key.
FACT_KEY_TAIL = "。.!?"


def scope_key(c: Column) -> Column:
    """Scope trimmed, in lower case, ``global`` where null or blank."""
    t = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.when(c.isNull() | (t == ""), F.lit("global")).otherwise(t)


def fact_key(c: Column) -> Column:
    """Lower case, white space collapsed and trimmed, trailing sentence marks removed; blank becomes null."""
    t = F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))
    t = F.trim(F.regexp_replace(t, "[" + FACT_KEY_TAIL + "]+$", ""))
    return F.when(t != "", t)


def words(c: Column) -> Column:
    """Runs of letters or digits with letter case folded, as an array; null text has none."""
    folded = F.lower(F.upper(F.coalesce(c, F.lit(""))))
    return F.regexp_extract_all(folded, F.lit(r"([\p{L}\p{N}]+)"), 1)
