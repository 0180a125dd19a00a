"""The text fields of memories: ``text`` and ``l2_content`` of readable metadata, one row each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def text_fields(memories: DataFrame, least: int = 1) -> DataFrame:
    """row_no, field_name, content for fields of ``least`` characters or more, in one scan.

    ``l2_content`` only where the metadata is a readable JSON object that has it as a string.
    """
    typed = F.from_json("metadata", "map<string,string>")["l2_content"]
    raw = F.get_json_object("metadata", "$.l2_content")
    # objects, numbers and nulls are no texts: from_json gives their JSON, so only a quoted value counts
    is_text = F.col("metadata").rlike(r'"l2_content"\s*:\s*"')
    l2 = F.when(is_text & typed.isNotNull(), F.coalesce(typed, raw))
    both = F.array(F.struct(F.lit("text").alias("field_name"), F.col("text").alias("content")), F.struct(F.lit("l2_content").alias("field_name"), l2.alias("content")))
    return memories.select("row_no", F.inline(both)).where(F.col("content").isNotNull() & (F.length("content") >= least))
