"""Side files of JSON lines: rejected candidates with their audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "rejected_at bigint, target_scope string, candidate struct<category:string,abstract:string>, audit struct<score:double,reason:string,utility_reason:string,max_similarity:double>"


def read_audits(spark: SparkSession, path: str) -> DataFrame:
    """Audits of a file or folder; broken lines are dropped, a missing path gives none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path)


def write_audits(audits: DataFrame, path: str) -> None:
    audits.write.mode("append").json(path)


def top_reasons(audits: DataFrame, n: int = 5) -> DataFrame:
    """The n most frequent reasons, numbers taken out."""
    from memspark.functions.text import reason_key

    label = F.coalesce(F.when(F.trim("audit.utility_reason") != "", F.trim("audit.utility_reason")), F.trim("audit.reason"))
    return audits.select(reason_key(label).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason").limit(n)
