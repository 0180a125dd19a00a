"""Structured Streaming jobs on event streams: access counts, windows, deduplicated signals, late data by watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.session import checkpoint

#: Debounce of access counts, rate window, time to live of error signals.
DEBOUNCE, RATE_WINDOW, SIGNAL_TTL = "5 seconds", "1 minute", "30 minutes"


def events_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events of a directory of Parquet files as a stream."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(path)


def access_counts(events: DataFrame, key: str = "user_id", late: str = "1 hour") -> DataFrame:
    """Accesses per key and debounce window, of batch or stream."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", DEBOUNCE), key).agg(F.count(F.lit(1)).alias("accesses")).select(key, F.col("window.start").alias("start"), "accesses")


def rates(events: DataFrame, key: str = "user_id", most: int = 100, late: str = "1 hour") -> DataFrame:
    """Events per key and minute, and whether they exceed the limit."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", RATE_WINDOW), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("window.start").alias("start"), "n", (F.col("n") > most).alias("limited"))


def sessions(events: DataFrame, key: str = "user_id", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions per key, parted by gaps."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def signals(events: DataFrame, key: str = "user_id", ttl: str = SIGNAL_TTL) -> DataFrame:
    """Error events of a stream, one per key and signature within the time to live."""
    sig = F.sha2(F.concat_ws("|", "event_type", F.get_json_object("props", "$.k")), 256)
    e = events.where("event_type = 'error'").withColumn("signature", sig)
    return e.withWatermark("ts", ttl).dropDuplicatesWithinWatermark([key, "signature"]) if e.isStreaming else e.dropDuplicates([key, "signature"])


def run_to_table(stream: DataFrame, out: str, state: str, mode: str = "append") -> None:
    """Runs a stream over all that is there and ends; results and progress lie in shared folders."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", state).option("path", out).trigger(availableNow=True).start().awaitTermination()


def apply_access_counts(store: DataFrame, counts: DataFrame, now_ms: int) -> DataFrame:
    """The store's metadata columns with counts added (row key ``id``), at most 10,000; for foreachBatch."""
    total = counts.groupBy("id").agg(F.sum("accesses").alias("_n"))
    out = store.join(total, "id", "left")
    return checkpoint(out.withColumns({"access_count": F.least(F.lit(10_000), F.col("access_count") + F.coalesce("_n", F.lit(0))).cast("bigint"), "last_accessed_at": F.when(F.col("_n").isNotNull(), F.lit(now_ms)).otherwise(F.col("last_accessed_at"))}).select(*store.columns))


def message_stream(spark: SparkSession, path: str) -> DataFrame:
    """New lines of session files (JSON lines) as messages: file, role, content, timestamp. The checkpoint of the
    query that writes them keeps which files were read; broken lines and other roles are dropped."""
    lines = spark.readStream.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    m = F.from_json("value", "struct<type:string,timestamp:string,message:struct<role:string,content:string>>")
    t = lines.select("file", m.alias("m")).select("file", F.coalesce(F.when(F.col("m.type").isin("human", "user"), "user").when(F.col("m.type") == "assistant", "assistant"), F.when(F.col("m.message.role").isin("user", "assistant"), F.col("m.message.role"))).alias("role"), F.trim("m.message.content").alias("content"), F.col("m.timestamp").alias("timestamp"))
    return t.where("role is not null and content != ''")


def learn_prototypes(bank: DataFrame, new: DataFrame, limit: int = 200) -> DataFrame:
    """The newest ``limit`` noise prototypes (vector, learned_at) of bank and new ones; the bank is bounded by it."""
    return bank.unionByName(new).orderBy(F.desc("learned_at")).limit(limit)
