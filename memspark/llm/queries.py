"""Queries of the problems on text corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm.encoding import encode_corpus
from memspark.llm.formatting import collapsed, formatting_groups
from memspark.llm.history_dedup import repeats
from memspark.llm.mixing import mix
from memspark.llm.pieces import split_fields
from memspark.llm.pii import personal_items, redacted
from memspark.llm.reading import reading_levels
from memspark.session import read_table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return repeats(read_table(spark, d, "memories"), read_table(spark, d, "incoming_memories"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return split_fields(read_table(spark, d, "memories")).where("piece_no = 0").select("row_no", "field_name", "kind")


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_fields(read_table(spark, d, "memories"))


def p3_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """Each field put together again from its pieces: longest piece, least overlap, digest of the whole."""
    p = split_fields(read_table(spark, d, "memories")).select("row_no", "field_name", "piece_no", "start_pos", "end_pos", F.col("piece").alias("content"))
    # an overlap is what a piece has of the one before it: pieces of one field are few, as are its characters
    ordered = F.array_sort(F.collect_list(F.struct("piece_no", "start_pos", "end_pos", "content")))
    g = p.groupBy("row_no", "field_name").agg(ordered.alias("p"), F.max(F.length("content")).alias("longest"))
    own = F.expr("transform(p, (x, i) -> if(i = 0, x.content, substring(x.content, cast(p[i - 1].end_pos - x.start_pos as int) + 1, 4000)))")
    least = F.expr("array_min(transform(sequence(1, size(p) - 1), i -> p[i - 1].end_pos - p[i].start_pos))")
    return g.select("row_no", "field_name", (F.col("longest") <= 4000).alias("fits"), (least == 200).alias("overlaps"), F.md5(F.array_join(own, "")).alias("digest"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return formatting_groups(read_table(spark, d, "memories"))


def p6_records(spark: SparkSession, d: str) -> DataFrame:
    return collapsed(read_table(spark, d, "memories").select("row_no", "id", "text", "scope"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return personal_items(read_table(spark, d, "memories"))


def p7_redacted(spark: SparkSession, d: str) -> DataFrame:
    return redacted(read_table(spark, d, "memories"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(read_table(spark, d, "documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets"))[1]


def p9_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Of each mix: whether its shares sum to 1, and whether no source is repeated more often than allowed."""
    s = mix(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets"))[1]
    return s.groupBy("mix_name").agg((F.abs(F.sum("actual_share") - 1) < 1e-9).alias("whole"), F.bool_and(F.col("most_repeats") <= F.col("max_repeats")).alias("within"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return reading_levels(read_table(spark, d, "documents"), read_table(spark, d, "reading_labels")).select("doc_id", "reading_level")


def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    levels = reading_levels(read_table(spark, d, "documents"), read_table(spark, d, "reading_labels"))
    return levels.groupBy("source", "reading_level").agg(F.count(F.lit(1)).alias("documents"), F.sum("sentences").alias("sentences"))


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p3_found, p3_pieces, p3_rejoined, p6_found, p6_records, p7_found, p7_redacted, p8_ids, p9_mix, p9_shares, p9_bounds, p10_found, p10_profile)}
