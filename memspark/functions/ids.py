"""Deterministic ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the namespace of memory ids.
NAMESPACE = "7f3e8a2b4c5d4e6f8a9b1c2d3e4f5a6b"


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """Version 5 UUID of a name: SHA-1 of the namespace's bytes and the name, with version and variant bits."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def memory_id(scope: Column, text: Column) -> Column:
    """Id of a memory: that of its scope and text, joined by NUL."""
    return uuid5(F.concat(F.coalesce(scope, F.lit("global")), F.lit("\0"), F.coalesce(text, F.lit(""))))
