"""The engine: one class over a directory of tables, with the calls of a memory store.

Tables are versions in numbered directories; a version counts once its write is complete, so readers see the old or
the new table and never half of one. Writes are set-based: each call takes rows or a DataFrame of rows.
"""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.functions.embed import Embedder, hash_embedder
from memspark.functions.norm import scope_key
from memspark.functions.temporal import parse_temporal
from memspark.functions.text import is_noise, scoped
from memspark.metadata import store_rows, with_smart_meta
from memspark.operators import store as O
from memspark.operators.consolidate import consolidation
from memspark.plans.recall import RecallConfig, bm25_only, hybrid, vector_only
from memspark.session import checkpoint

SCHEMA = "row_no bigint, id string, text string, vector array<float>, vector_l0 array<float>, vector_l1 array<float>, vector_l2 array<float>, category string, scope string, importance double, timestamp_ms bigint, metadata string, ingested_at timestamp"
KEEP_VERSIONS = 2


class MemoryEngine:
    """``MemoryEngine(spark, path)``: store, recall, update, forget, list, stats, checkpoint, resume, provenance,
    consolidate, health, conflicts, feedback, import and export."""

    def __init__(self, spark: SparkSession, path: str, embedder: Embedder | None = None, dim: int = 32):
        self.spark, self.path, self.dim = spark, path.rstrip("/"), dim
        self.embedder = embedder or hash_embedder(dim)

    # -- versions --------------------------------------------------------------------------------------------------
    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        """Complete versions, in order."""
        fs, Path = self._fs()
        if not fs.exists(Path(self.path)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(Path(self.path))]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(Path(f"{self.path}/{n}/_SUCCESS")))

    def table(self) -> DataFrame:
        """All rows; empty before the first write."""
        v = self.versions()
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/v{v[-1]}") if v else self.spark.createDataFrame([], SCHEMA)

    def _replace(self, df: DataFrame) -> None:
        fs, Path = self._fs()
        v = self.versions()
        n = (v[-1] if v else 0) + 1
        df.select(*[c.split()[0] for c in SCHEMA.split(", ")]).write.mode("overwrite").parquet(f"{self.path}/v{n}")
        for old in v[: max(0, len(v) + 1 - KEEP_VERSIONS)]:
            fs.delete(Path(f"{self.path}/v{old}"), True)

    # -- writing ---------------------------------------------------------------------------------------------------
    def store(self, rows: DataFrame | list[dict], now_ms: int) -> int:
        """Adds rows (text, and where given scope, category, importance, timestamp_ms, metadata, vector) that are no
        noise and not there yet; the number added. Ids come from scope and text, so storing twice adds nothing."""
        if isinstance(rows, list):
            keys = ["text", "scope", "category", "importance", "timestamp_ms", "metadata", "vector"]
            rows = self.spark.createDataFrame([tuple(r.get(k) for k in keys) for r in rows], "text string, scope string, category string, importance double, timestamp_ms bigint, metadata string, vector array<float>")
        kinds = {"scope": "string", "category": "string", "importance": "double", "timestamp_ms": "bigint", "metadata": "string", "vector": "array<float>", "vector_l0": "array<float>", "vector_l1": "array<float>", "vector_l2": "array<float>"}
        for c, k in kinds.items():
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(None).cast(k))
        rows = rows.where(~is_noise(F.coalesce("text", F.lit(""))))
        old = self.table()
        last = old.agg(F.max("row_no")).first()[0] or 0
        batch = O.with_ids(rows).withColumns({"scope": scope_key(F.col("scope")), "category": F.coalesce("category", F.lit("other")), "importance": F.coalesce("importance", F.lit(0.7)), "timestamp_ms": F.coalesce("timestamp_ms", F.lit(now_ms)).cast("bigint"), "metadata": F.coalesce("metadata", F.lit("{}")), "ingested_at": F.timestamp_millis(F.lit(now_ms)), "row_no": F.monotonically_increasing_id() + last + 1})
        from memspark.functions.embed import embed_column

        batch = batch.withColumn("vector", F.coalesce("vector", embed_column(F.coalesce("text", F.lit("")), self.embedder)))
        new = O.new_rows(old, batch, "row_no").persist()
        try:
            n = new.count()
            if n:
                self._replace(old.unionByName(new.select(*old.columns)))
            return n
        finally:
            new.unpersist()

    def update(self, ref: str, **changes) -> bool:
        """Changes columns of the row with that id, or with that only prefix of 8 or more characters."""
        asked = O.resolve_prefix(self.table(), self.spark.createDataFrame([(ref,)], "ref string")).first()
        if asked is None or asked["id"] is None:
            return False
        kinds = dict(self.table().dtypes)
        df = self.spark.createDataFrame([(asked["id"], *changes.values())], "id string, " + ", ".join(f"{c} {kinds[c]}" for c in changes))
        self._replace(O.patch(self.table(), df, list(changes)))
        return True

    def patch_metadata(self, ids: list[str], **keys) -> None:
        patch = F.create_map(*[F.lit(x) for k, v in keys.items() for x in (k, json.dumps(v))])
        self._replace(O.patch_metadata(self.table(), self.spark.createDataFrame([(i,) for i in ids], "id string").withColumn("patch", patch)))

    def forget(self, ids: list[str]) -> None:
        self._replace(O.delete(self.table(), self.spark.createDataFrame([(i,) for i in ids], "id string")))

    def bulk_delete(self, scopes: list[str], before_ms: int | None = None) -> None:
        self._replace(O.bulk_delete(self.table(), scopes, before_ms))

    def feedback(self, ids: list[str], helpful: bool, alpha: float = 0.15) -> None:
        """Moves the feedback weight of each row towards 1 or 0."""
        m = with_smart_meta(self.table()).where(F.col("id").isin(ids)).select("id", F.create_map(F.lit("feedback_weight"), F.to_json(F.struct((alpha * float(helpful) + (1 - alpha) * F.col("feedback_weight")).alias("w"))).substr(6, 30)).alias("patch"))
        m = m.withColumn("patch", F.transform_values("patch", lambda k, v: F.regexp_replace(v, "}$", "")))
        self._replace(O.patch_metadata(self.table(), m))

    def promote(self, ids: list[str]) -> None:
        self.patch_metadata(ids, state="confirmed", memory_layer="durable")

    def archive(self, ids: list[str]) -> None:
        self.patch_metadata(ids, state="archived", memory_layer="archive")

    def import_rows(self, rows: DataFrame) -> int:
        """Adds rows with their own ids and times, numbered after those that are there; missing vectors are embedded.
        Rows with an id that is there, or hardly any text, are skipped."""
        from memspark.functions.embed import embed_column

        old = self.table()
        last = old.agg(F.max("row_no")).first()[0] or 0
        new = O.importable(old, rows)
        given = F.col("vector") if "vector" in new.columns else F.lit(None).cast("array<float>")
        new = new.withColumn("vector", F.coalesce(given, embed_column(F.coalesce("text", F.lit("")), self.embedder)))
        # kept before the numbers are used, as a later run of the same plan could give others
        new = checkpoint(new.withColumn("row_no", F.lit(last) + 1 + F.monotonically_increasing_id()))
        n = new.count()
        if n:
            self._replace(old.unionByName(new, allowMissingColumns=True))
        return n

    def export(self, path: str, scopes: list[str] | None = None) -> None:
        """All rows of the scopes as JSON lines, without vectors."""
        scoped(self.table(), scopes).drop("vector", "vector_l0", "vector_l1", "vector_l2").write.mode("overwrite").json(path)

    def ingest(self, rows: DataFrame | list[dict], now_ms: int, strategy: str = "ask") -> DataFrame:
        """Takes rows (text, and where given scope, category, importance, vector) through the whole pipeline and writes
        one new version: noise, duplicates and conflicts are left out (a conflict supersedes with that strategy), what is
        stored gets its metadata and links, linked rows get the link back, superseded rows their end, and old rows like
        important new ones gain importance. Gives row_no, action, conflict_row and link_rows of each row, in the order given."""
        from memspark.functions.embed import embed_column
        from memspark.plans.ingest import ingest_plan, lifts, understood

        if isinstance(rows, list):
            keys = ["text", "scope", "category", "importance", "vector"]
            rows = self.spark.createDataFrame([tuple(r.get(k) for k in keys) for r in rows], "text string, scope string, category string, importance double, vector array<float>")
        old = self.table()
        last = old.agg(F.max("row_no")).first()[0] or 0
        vector = F.coalesce("vector", embed_column(F.coalesce("text", F.lit("")), self.embedder))
        # numbers are kept before they are used
        batch = checkpoint(rows.withColumn("row_no", F.lit(last) + 1 + F.monotonically_increasing_id()).withColumn("vector", vector))
        plan = checkpoint(ingest_plan(with_smart_meta(store_rows(old)), batch, now_ms, strategy))
        ids = old.select("row_no", F.col("id").alias("_id"))
        goes = plan.where("action in ('created', 'superseded')")
        links = goes.select("row_no", F.explode("link_rows").alias("there")).join(ids.withColumnRenamed("row_no", "there"), "there")
        new = O.with_ids(batch.join(goes, "row_no").join(links.groupBy("row_no").agg(F.collect_list(F.struct(F.lit("related_to").alias("type"), F.col("_id").alias("targetId"))).alias("_links")), "row_no", "left").drop("link_rows"))
        new = new.join(ids.toDF("conflict_row", "_old"), "conflict_row", "left").join(understood(batch, now_ms).select("row_no", "memory_category", "fact_key", "l0", "l1", "l2"), "row_no")
        meta = F.struct(F.lit("manual").alias("source"), F.lit("confirmed").alias("state"), F.lit(now_ms).alias("valid_from"), F.col("l0").alias("l0_abstract"), F.col("l1").alias("l1_overview"), F.col("l2").alias("l2_content"), "memory_category", "fact_key", F.col("_old").alias("supersedes"), F.col("_links").alias("relations"))
        stored = new.select("row_no", "id", F.coalesce("text", F.lit("")).alias("text"), "vector", F.col("vector").alias("vector_l0"), embed_column(F.col("l1"), self.embedder).alias("vector_l1"), F.col("vector").alias("vector_l2"), F.coalesce("category", F.lit("other")).alias("category"), scope_key(F.col("scope")).alias("scope"), F.coalesce("importance", F.lit(0.7)).alias("importance"), F.lit(now_ms).cast("bigint").alias("timestamp_ms"), F.to_json(meta).alias("metadata"), F.timestamp_millis(F.lit(now_ms)).alias("ingested_at"))
        back = links.join(new.select("row_no", F.col("id").alias("_from")), "row_no").groupBy(F.col("_id").alias("id")).agg(F.collect_list(F.struct(F.lit("related_to").alias("type"), F.col("_from").alias("targetId"))).alias("_back"))
        ended = new.where("action = 'superseded'").groupBy(F.col("_old").alias("id")).agg(F.max("id").alias("_by"))
        had = F.coalesce(F.from_json(F.from_json("metadata", "map<string,string>")["relations"], "array<struct<type:string,targetId:string>>"), F.array().cast("array<struct<type:string,targetId:string>>"))
        lifted = lifts(with_smart_meta(store_rows(old)), new.select(F.col("row_no").alias("query_no"), "vector", "importance", scope_key(F.col("scope")).alias("scope")), now_ms, "scope")
        lifted = checkpoint(lifted.groupBy("row_no").agg(F.max("new_importance").alias("_imp"), F.max("new_tier").alias("_tier")).join(ids, "row_no").select(F.col("_id").alias("id"), "_imp", "_tier"))
        patch = old.select("id", had.alias("_had")).dropDuplicates(["id"])
        for part in (back, ended, lifted):
            patch = patch.join(part, "id", "left")
        patch = patch.where("_back is not null or _by is not null or _tier is not null")
        both = F.when(F.col("_back").isNotNull(), F.map_from_arrays(F.array(F.lit("relations")), F.array(F.to_json(F.concat("_had", "_back")))))
        closed = F.when(F.col("_by").isNotNull(), F.map_from_arrays(F.array(F.lit("invalidated_at"), F.lit("superseded_by")), F.array(F.lit(str(now_ms)), F.concat(F.lit('"'), F.col("_by"), F.lit('"')))))
        raised = F.when(F.col("_tier").isNotNull(), F.map_from_arrays(F.array(F.lit("tier")), F.array(F.concat(F.lit('"'), F.col("_tier"), F.lit('"')))))
        none = F.create_map().cast("map<string,string>")
        patch = checkpoint(patch.select("id", F.map_concat(*[F.coalesce(x, none) for x in (both, closed, raised)]).alias("patch")))
        if not goes.isEmpty():
            kept = O.patch(O.patch_metadata(old, patch), lifted.select("id", F.col("_imp").alias("importance")), ["importance"])
            self._replace(kept.unionByName(stored))
        return plan.orderBy("row_no")

    def retrieve(self, queries: list[str], now_ms: int, scopes: list[str] | None = None, limit: int = 5, topic: str | None = None, reranker=None) -> DataFrame:
        """Ranked rows of each query by the way that fits it: tags by words alone, short lookups with more weight on
        words, a time in the query after the ranking. With ``reranker`` twice the rows are blended anew before the cut."""
        from memspark.operators.rerank import rerank
        from memspark.plans.dispatch import retrieve
        from memspark.plans.recall import top

        vectors = self.embedder(queries)
        asked = self.spark.createDataFrame([(i, q, [float(x) for x in v]) for i, (q, v) in enumerate(zip(queries, vectors))], "query_no bigint, text string, vector array<float>")
        mem = with_smart_meta(scoped(store_rows(self.table()), scopes))
        out = retrieve(mem, asked, RecallConfig(now_ms, limit=limit if reranker is None else 2 * limit), topic=topic)
        if reranker is not None:
            pool = out.drop("place", "vector").withColumn("score", F.col("decayed")).join(asked.select("query_no", F.col("text").alias("query"), F.col("vector").alias("query_vector")), "query_no").join(mem.select("row_no", "vector"), "row_no")
            out = top(checkpoint(rerank(pool, reranker)), limit, "reranked").drop("score", "query", "query_vector", "vector")
        return out.join(mem.select("row_no", "id", "scope"), "row_no").orderBy("query_no", "place")

    # -- reading ---------------------------------------------------------------------------------------------------
    def recall(self, queries: list[str] | DataFrame, now_ms: int, scopes: list[str] | None = None, mode: str = "hybrid", limit: int = 10, prefilter: bool = False) -> DataFrame:
        """Ranked rows of each query. Time expressions in a query restrict its rows, after the ranking as a rule,
        before it with ``prefilter`` (then by the widest range of the queries)."""
        if isinstance(queries, list):
            now = datetime.fromtimestamp(now_ms / 1000, UTC).replace(tzinfo=None)
            ms = lambda t: None if t is None else int((t - datetime(1970, 1, 1)).total_seconds() * 1000)
            parsed = [parse_temporal(q, now) for q in queries]
            vectors = self.embedder([c for _, _, c in parsed])
            rows = [(i, c, [float(x) for x in v], ms(a), ms(b)) for i, ((a, b, c), v) in enumerate(zip(parsed, vectors))]
            queries = self.spark.createDataFrame(rows, "query_no bigint, text string, vector array<float>, after_ms bigint, before_ms bigint")
        mem = with_smart_meta(scoped(store_rows(self.table()), scopes))
        ranges = "after_ms" in queries.columns
        if prefilter and ranges:
            lo, hi, open_lo, open_hi = queries.agg(F.min("after_ms"), F.max("before_ms"), F.max(F.col("after_ms").isNull()), F.max(F.col("before_ms").isNull())).first()
            mem = mem if open_lo else mem.where(F.col("timestamp_ms") >= lo)
            mem = mem if open_hi else mem.where(F.col("timestamp_ms") < hi)
        run = {"hybrid": hybrid, "vector": vector_only, "bm25": bm25_only}[mode]
        out = run(mem, queries, RecallConfig(now_ms, limit=limit, pool=max(20, 2 * limit)))
        if ranges:
            out = out.join(queries.select("query_no", "after_ms", "before_ms"), "query_no")
            out = out.where((F.col("after_ms").isNull() | (F.col("timestamp_ms") >= F.col("after_ms"))) & (F.col("before_ms").isNull() | (F.col("timestamp_ms") < F.col("before_ms")))).drop("after_ms", "before_ms")
        return out.join(mem.select("row_no", "id", "scope"), "row_no").orderBy("query_no", "place")

    def list(self, scopes: list[str] | None = None, category: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
        df = scoped(store_rows(self.table()), scopes)
        df = df if category is None else df.where(F.col("category") == category)
        return df.orderBy(F.desc("timestamp_ms"), "id").offset(offset).limit(limit)

    def stats(self, scopes: list[str] | None = None) -> DataFrame:
        g = scoped(store_rows(self.table()), scopes).groupingSets([[F.col("scope")], [F.col("category")], []], "scope", "category")
        return g.agg(F.count(F.lit(1)).alias("n"))

    def health(self) -> DataFrame:
        m = with_smart_meta(store_rows(self.table()))
        return m.groupBy("state", "tier", "source").agg(F.count(F.lit(1)).alias("n"), F.avg("importance").alias("importance"), F.avg("confidence").alias("confidence"))

    def consolidate(self) -> DataFrame:
        """What a consolidation would merge and link."""
        return consolidation(with_smart_meta(store_rows(self.table())))

    def provenance(self, ids: list[str]) -> DataFrame:
        return with_smart_meta(self.table()).where(F.col("id").isin(ids)).select("id", "source", "supersedes", "superseded_by", "canonical_id", F.get_json_object("metadata", "$.provenance").alias("provenance"))

    def checkpoint(self, text: str, scope: str, now_ms: int) -> int:
        return self.store([{"text": text, "scope": scope, "category": "other", "metadata": json.dumps({"type": "checkpoint", "source": "session-summary"})}], now_ms)

    def resume(self, scope: str) -> DataFrame:
        """The newest checkpoint of the scope."""
        c = scoped(self.table(), [scope]).where(F.get_json_object("metadata", "$.type") == "checkpoint")
        return c.orderBy(F.desc("timestamp_ms"), F.desc("row_no")).limit(1)
