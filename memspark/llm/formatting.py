"""Problem 6: records that differ in formatting only, by commutative multiset hashing.

Each record gets a hash of its word sequence and, if it consists of name-value fields, the sum (mod 2**128) of the
hashes of its normalised (name, value) pairs, which no order of fields changes. Records with one sequence are linked,
and so are sequences with one set of fields; a group is what these links reach. Links are verified exactly, each member
against the first of its own sequence and each sequence against the first with its fields, through counts, without
sorting; groups with a hash collision are grouped anew by the words themselves.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.functions.norm import scope_key
from memspark.llm.words import fields, words
from memspark.operators.skew import join_groups
from memspark.session import checkpoint

#: Members of one group that one copy of its first text is compared with.
SALT_ROWS = 20_000
PRINTS = "row_no bigint, scope string, seq binary, fld binary"


def _h(s: str) -> bytes:
    return hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def multiset_hash(pairs: list[tuple[str, str]]) -> bytes:
    """Commutative: the sum of the pairs' hashes modulo 2**128."""
    return (sum(int.from_bytes(_h(f"{n}\x1f{v}"), "big") for n, v in pairs) % (1 << 128)).to_bytes(16, "big")


def _keys(text: str | None, exact: bool) -> tuple[bytes, bytes | None]:
    """What a record has in common with those of its words, and with those of its fields (if it has any)."""
    seq, f = " ".join(words(text)), fields(text)
    if exact:
        return seq.encode("utf-8", "surrogatepass"), None if f is None else repr(sorted(f)).encode("utf-8", "surrogatepass")
    return _h(seq), None if f is None else multiset_hash(f)


def _prints(exact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [_keys(t, exact) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("row_no"), b.column("scope"), *[pa.array([k[i] for k in keys], pa.binary()) for i in (0, 1)]], names=["row_no", "scope", "seq", "fld"])

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = []
        for by_fields, x, y in zip(b.column("by_fields").to_pylist(), b.column("text").to_pylist(), b.column("head_text").to_pylist()):
            fx, fy = (fields(x), fields(y)) if by_fields else (None, None)
            ok.append(fx is not None and fy is not None and Counter(fx) == Counter(fy) if by_fields else words(x) == words(y))
        yield pa.RecordBatch.from_arrays([b.column("row_no"), pa.array(ok)], names=["row_no", "ok"])


def _linked(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, links) of rows with prints. members: row_no, scope, seq, first_row_no, size of every row whose group has
    several. links: row_no, head, by_fields, n, each link to verify with the number of those to the same head."""
    one = ["scope", "seq"]
    kinds = checkpoint(prints.groupBy(*one, "fld").agg(F.min("row_no").alias("row"), F.count(F.lit(1)).alias("n")))
    seqs = kinds.groupBy(*one).agg(F.min("row").alias("first"), F.sum("n").alias("n"), F.count("fld").alias("sets"))
    label = checkpoint(seqs.withColumn("label", F.col("first")))
    fielded = kinds.where("fld is not null").select(*one, "fld", "row")
    heads = checkpoint(fielded.groupBy("scope", "fld").agg(F.min("row").alias("head"), F.count(F.lit(1)).alias("k")))
    # a sequence with one set of fields is done after one round; others pass labels on until none changes
    while True:
        lows = join_groups(fielded, heads.select("scope", "fld", "k"), ["scope", "fld"], "k").drop("k").join(label.select(*one, "label"), one)
        low = lows.groupBy("scope", "fld").agg(F.min("label").alias("low"))
        reach = join_groups(fielded, low.join(heads.select("scope", "fld", "k"), ["scope", "fld"]), ["scope", "fld"], "k").groupBy(*one).agg(F.min("low").alias("low"))
        after = checkpoint(label.join(reach, one, "left").withColumn("new", F.least("label", "low")))
        more = not after.where("new < label and sets > 1").isEmpty()
        label = after.withColumn("label", F.col("new")).drop("new", "low")
        if not more:
            break
    sizes = label.groupBy("label").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("m"))
    placed = join_groups(label, sizes.where("size > 1"), ["label"], "m").select(*one, "first", "n", "size", F.col("label").alias("first_row_no"))
    members = checkpoint(join_groups(prints.select("row_no", *one), placed, one, "n"))
    by_words = members.where("row_no != first").select("row_no", F.col("first").alias("head"), F.lit(False).alias("by_fields"), "n")
    by_fields = join_groups(fielded, heads.where("k > 1"), ["scope", "fld"], "k").where("row != head").select(F.col("row").alias("row_no"), "head", F.lit(True).alias("by_fields"), F.col("k").alias("n"))
    return members.select("row_no", *one, "first_row_no", "size"), by_words.unionByName(by_fields).distinct()


def formatting_groups(memories: DataFrame) -> DataFrame:
    """first_row_no, row_no for every row that is not the first of its group, each verified.

    Null and empty texts, and texts without any word, are equal to each other and to nothing else. Rows that repeat a
    ``row_no`` count as one; extra columns are ignored; an empty table gives no rows.
    """
    base = memories.select("row_no", scope_key(F.col("scope")).alias("scope"), "text")
    prints = checkpoint(base.mapInArrow(_prints(False), PRINTS))
    members, links = _linked(prints)
    links = checkpoint(links)
    texts = base.select("row_no", "text").dropDuplicates(["row_no"])
    salts = F.ceil(F.col("n") / SALT_ROWS).cast("int")
    heads = links.groupBy("head").agg(F.max("n").alias("n")).join(texts.toDF("head", "head_text"), "head").select("head", "head_text", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.col("n").alias("of"))
    tops = links.groupBy("head").agg(F.max("n").alias("n"))
    asked = join_groups(links.drop("n"), tops, ["head"], "n").withColumn("salt", F.pmod(F.xxhash64("row_no"), salts).cast("int")).drop("n").join(texts, "row_no")
    bad = checkpoint(asked.join(heads.drop("of"), ["head", "salt"]).mapInArrow(_verify, "row_no bigint, ok boolean").where("not ok").select("row_no"))
    pairs = members.where("row_no != first_row_no").select("first_row_no", "row_no").distinct()
    if bad.isEmpty():
        return pairs
    # collisions: the groups that hold one, by the words themselves
    odd = members.join(members.join(bad, "row_no", "left_semi").select("first_row_no").distinct(), "first_row_no", "left_semi")
    again, _ = _linked(checkpoint(base.join(odd.select("row_no"), "row_no", "left_semi").mapInArrow(_prints(True), PRINTS)))
    good = pairs.join(odd.select("first_row_no").distinct(), "first_row_no", "left_anti")
    return good.unionByName(again.where("row_no != first_row_no").select("first_row_no", "row_no").distinct())


def collapsed(memories: DataFrame) -> DataFrame:
    """One row per record: its first row's columns and the number of its copies."""
    pairs = formatting_groups(memories)
    counts = pairs.groupBy("first_row_no").agg((F.count(F.lit(1)) + 1).alias("copies"))
    rest = memories.join(pairs.select("row_no"), "row_no", "left_anti")
    return rest.join(counts, rest["row_no"] == counts["first_row_no"], "left").drop("first_row_no").withColumn("copies", F.coalesce("copies", F.lit(1)).cast("bigint"))
