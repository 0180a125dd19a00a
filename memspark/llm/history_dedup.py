"""Problem 2: new batches against all history, by stored graph index shards.

Rows with the same scope, words and vector are one class. ``HistoryIndex`` keeps the accepted classes in a folder, in
shards: each a navigable small-world graph (``smallworld``) with what the exact rerank needs, of one file. A shard holds
many small scopes or a part of a large one. A batch is told against the stored shards, which the tasks that search them
open in place; only the batch's own queries are shuffled, and no text of the history is read again. What the history
does not settle becomes a shard of its own, in which it is settled in order of ``row_no``: a class is a case once it
repeats an accepted row, and accepted once all rows before it that it repeats are cases. Every ``COMPACT`` generations of
one level are merged into one of the next, from their stored sketches.

Folder: ``shards/gen=G/shard=S`` (graph and sketches, the scopes it holds, and which of its classes turned out to be
cases, with what they repeat), ``dead/gen=G/shard=S`` (such classes of scopes that lie in several shards),
``manifest/V`` (the generations that are live, with levels).
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memspark.functions.norm import scope_key
from memspark.llm.smallworld import Graph, signatures
from memspark.llm.words import words
from memspark.operators.skew import join_groups
from memspark.session import checkpoint, shared_folder

WORDS_SHARE, COSINE = 0.7, 0.9
#: Classes of one shard about, queries of one shard that one task takes, generations of one level that are merged.
SHARD, QUERIES, COMPACT = 16_384, 16_384, 4
#: The level of the history that the index was begun with; it is merged with nothing.
HISTORY_LEVEL = 99
#: Queries of one word set that are compared with the classes of a shard at once.
ROWS = 512

SKETCHED = "row_no bigint, scope string, class binary, sig binary, bands binary, words binary, vector binary"
SKETCH = ["class", "cid", "scope", "sig", "bands", "words", "vector"]


@lru_cache(maxsize=1 << 18)
def _word_hash(w: str) -> int:
    return int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _usable(v) -> np.ndarray | None:
    if v is None or not len(v):
        return None
    a = np.array([np.nan if x is None else x for x in v], np.float32)
    return a if np.isfinite(a).all() and a.any() else None


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class and sketch of rows that have a word; the ratio of words is undefined for the others, which repeat nothing."""
    names = [x.split()[0] for x in SKETCHED.split(", ")]
    for b in batches:
        keep, flat, vecs = [], [], []
        for i, (t, v) in enumerate(zip(b.column("text").to_pylist(), b.column("vector").to_pylist())):
            if found := set(words(t)):
                keep.append(i)
                flat.append(np.array(sorted({_word_hash(w) for w in found}), np.uint64))
                vecs.append(None if (u := _usable(v)) is None else u.tobytes())
        if not keep:
            continue
        kept = b.select(["row_no", "scope"]).take(pa.array(keep, pa.int64()))
        scopes = kept.column("scope").to_pylist()
        sig, bands = signatures(np.concatenate(flat), np.cumsum([0, *map(len, flat[:-1])]))
        sets = [x.tobytes() for x in flat]
        digest = [hashlib.blake2b(s.encode("utf-8", "surrogatepass") + b"|" + w + b"|" + (v or b""), digest_size=16).digest() for s, w, v in zip(scopes, sets, vecs)]
        blobs = [digest, [x.tobytes() for x in sig], [x.tobytes() for x in bands], sets, vecs]
        yield pa.RecordBatch.from_arrays([*kept.columns, *[pa.array(x, pa.binary()) for x in blobs]], names=names)


def sketched(rows: DataFrame) -> DataFrame:
    """``SKETCHED`` of rows that have row_no, scope, text and vector."""
    return rows.select("row_no", scope_key(F.col("scope")).alias("scope"), "text", "vector").where("row_no is not null").mapInArrow(_sketched, SKETCHED)


def classes_of(rows: DataFrame) -> DataFrame:
    """One row per class: ``cid`` its smallest row_no, ``copies`` its rows. Copies are put together before the shuffle."""
    first = [F.first(c).alias(c) for c in ("sig", "bands", "words", "vector")]
    return rows.groupBy("scope", "class").agg(F.min("row_no").alias("cid"), F.count(F.lit(1)).alias("copies"), *first).select(*SKETCH, "copies")


def sizes_of(classes: DataFrame) -> DataFrame:
    """Scopes with their number ``n`` of classes."""
    return checkpoint(classes.groupBy("scope").agg(F.count(F.lit(1)).alias("n")))


# -- shards ------------------------------------------------------------------------------------------------------------
def _matrix(col: list[bytes], dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(col), dtype).reshape(-1, width)


class Shard:
    """Classes in order of ``cid``. A node of the graph is a word set of a scope: however many classes differ in their
    vectors alone, the graph holds them once."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("cid", "ascending"), ("class", "ascending")])
        col = {c: table[c].to_pylist() for c in SKETCH}
        self.cls, self.cid, self.vector = col["class"], table["cid"].to_numpy(), col["vector"]
        self.scopes = sorted(set(col["scope"]))
        number = {s: i for i, s in enumerate(self.scopes)}
        self.scope = np.array([number[s] for s in col["scope"]], np.int32)
        of: dict[tuple, list[int]] = {}
        for i, k in enumerate(zip(self.scope.tolist(), col["words"])):
            of.setdefault(k, []).append(i)
        self.words = [k[1] for k in of]
        self.rows = [np.array(x) for x in of.values()]
        self.node = np.empty(len(self.cls), np.int64)
        for j, x in enumerate(self.rows):
            self.node[x] = j
        first = [x[0] for x in self.rows]
        sig, bands = _matrix(col["sig"], np.uint64, 4), _matrix(col["bands"], np.uint32, 16)
        self.sig, self.bands = sig[first], bands[first]
        self.graph = Graph(self.sig, self.bands, self.scope[first])

    def dumps(self) -> bytes:
        return pickle.dumps((self.cls, self.cid, self.vector, self.scopes, self.scope, self.words, self.rows, self.node, self.sig, self.bands, self.graph.state()), protocol=5)

    @classmethod
    def loads(cls, blob: bytes) -> Shard:
        s = cls.__new__(cls)
        s.cls, s.cid, s.vector, s.scopes, s.scope, s.words, s.rows, s.node, s.sig, s.bands, state = pickle.loads(blob)
        s.graph = Graph.of(state)
        return s

    def sketches(self, live: np.ndarray) -> pa.Table:
        """The rows it was built from, of those that are ``live``."""
        live = np.nonzero(live)[0]
        node = self.node[live]
        cols = [[self.cls[i] for i in live], self.cid[live], [self.scopes[k] for k in self.scope[live]], [self.sig[j].tobytes() for j in node], [self.bands[j].tobytes() for j in node], [self.words[j] for j in node], [self.vector[i] for i in live]]
        kinds = [pa.binary(), pa.int64(), pa.string(), *[pa.binary()] * 4]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(SKETCH, cols, kinds)})


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _read(path: str) -> pa.Table:
    """A folder of the index, opened in place by a task."""
    import pyarrow.dataset as ds

    system, at = _system(path)
    if system.get_file_info(at).type == fs.FileType.NotFound:
        return pa.table({})
    return ds.dataset(at, filesystem=system, format="parquet").to_table()


@lru_cache(maxsize=2)
def open_shard(root: str, gen: str, shard: str) -> tuple[Shard, np.ndarray]:
    """A stored shard of a live generation, and which of its classes are accepted."""
    t = _read(f"{root}/shards/gen={gen}/shard={shard}")
    s = Shard.loads(t["blob"][0].as_py())
    gone = set(t["cases"][0].as_py())
    dead = _read(f"{root}/dead/gen={gen}/shard={shard}")
    if dead.num_rows:
        gone.update(dead["class"].to_pylist())
    return s, np.array([c not in gone for c in s.cls], bool)


STORED = "shard string, scopes array<string>, cases array<binary>, hits array<bigint>, blob binary"


def _build(young: bool, split: set[str]):
    """A shard of ``STORED``. ``young`` classes are not accepted yet: those of scopes that lie in this shard whole are
    settled here."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        shard = Shard(table)
        cases, by = settle_within(shard, split) if young else ([], [])
        row = [key[0].as_py(), shard.scopes, [shard.cls[i] for i in cases], shard.cid[by].tolist() if by else [], shard.dumps()]
        kinds = [pa.string(), pa.list_(pa.string()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary()]
        return pa.table({n.split()[0]: pa.array([x], k) for n, x, k in zip(STORED.split(", "), row, kinds)})

    return run


# -- the exact rerank --------------------------------------------------------------------------------------------------
def enough_words(a: frozenset, b: frozenset, share: float = WORDS_SHARE) -> bool:
    """The exact test of words: those in both against those in either."""
    both = len(a & b)
    return both >= share * (len(a) + len(b) - both) - 1e-9


def _vectors(blobs: list[bytes | None]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length of vector: the rows that have one, and their unit vectors."""
    by: dict[int, list[int]] = {}
    for i, v in enumerate(blobs):
        if v is not None:
            by.setdefault(len(v) // 4, []).append(i)
    out = {}
    for dim, rows in by.items():
        m = np.frombuffer(b"".join(blobs[i] for i in rows), np.float32).reshape(-1, dim).astype(np.float64)
        out[dim] = (np.array(rows), m / np.sqrt((m * m).sum(axis=1))[:, None])
    return out


def alike_vectors(q: list[bytes | None], a: list[bytes | None], cosine: float = COSINE) -> np.ndarray:
    """Which of ``q`` and ``a`` have vectors alike; a missing vector, or one of another length, forbids nothing."""
    out = np.ones((len(q), len(a)), bool)
    right = _vectors(a)
    for dim, (i, x) in _vectors(q).items():
        if dim in right:
            j, y = right[dim]
            out[np.ix_(i, j)] = x @ y.T >= cosine - 1e-12
    return out


@lru_cache(maxsize=1 << 14)
def _unpack(w: bytes) -> frozenset:
    return frozenset(np.frombuffer(w, np.uint64).tolist())


def _candidates(shard: Shard, sig: np.ndarray, bands: np.ndarray, sets: list[bytes], scope: np.ndarray) -> dict[int, list[int]]:
    """For each query the nodes of its scope that have enough of its words, of those the graph finds near."""
    by: dict[int, list[int]] = {}
    for i, j in zip(*map(np.ndarray.tolist, shard.graph.near(sig, bands, scope))):
        if shard.scope[shard.rows[j][0]] == scope[i] and enough_words(_unpack(sets[i]), _unpack(shard.words[j])):
            by.setdefault(i, []).append(j)
    return by


HITS = "q binary, a binary, a_cid bigint"


def _search(root: str, first_only: bool):
    """Search of one stored shard by the queries of one group; ``first_only`` gives each the smallest live class alike,
    else all that come before it."""

    def run(key: tuple, queries: pa.Table) -> pa.Table:
        # edges are sought in a generation that is not live yet: nothing of it is accepted or not, nothing is kept open
        shard, live = (open_shard if first_only else open_shard.__wrapped__)(root, key[0].as_py(), key[1].as_py())
        number = {s: i for i, s in enumerate(shard.scopes)}
        col = {c: queries[c].to_pylist() for c in ("class", "scope", "words", "vector", "sig", "bands")}
        qid, of = queries["cid"].to_numpy(), {}
        for i, k in enumerate(zip(col["scope"], col["words"])):
            of.setdefault(k, []).append(i)
        rows = [np.array(x) for x in of.values()]
        first = [x[0] for x in rows]
        scope = np.array([number.get(k[0], -1) for k in of], np.int32)
        sets = [k[1] for k in of]
        found = _candidates(shard, _matrix([col["sig"][i] for i in first], np.uint64, 4), _matrix([col["bands"][i] for i in first], np.uint32, 16), sets, scope)
        q, a = [], []
        for i, nodes in found.items():
            there = np.sort(np.concatenate([shard.rows[j] for j in nodes]))
            there = there[live[there]]
            if not len(there):
                continue
            vecs = [shard.vector[k] for k in there]
            for lo in range(0, len(rows[i]), ROWS):
                part = rows[i][lo : lo + ROWS]
                ok = alike_vectors([col["vector"][k] for k in part], vecs)
                if first_only:
                    x = np.nonzero(ok.any(axis=1))[0]
                    y = ok[x].argmax(axis=1)
                else:
                    x, y = np.nonzero(ok & (shard.cid[there][None, :] < qid[part][:, None]))
                q += part[x].tolist()
                a += there[y].tolist()
        return pa.table({"q": pa.array([col["class"][i] for i in q], pa.binary()), "a": pa.array([shard.cls[i] for i in a], pa.binary()), "a_cid": pa.array(shard.cid[a] if a else [], pa.int64())})

    return run


def settle_within(shard: Shard, split: set[str]) -> tuple[list[int], list[int]]:
    """In order of ``cid``: the classes of a shard that repeat an accepted one of it, and the smallest such; of scopes
    that lie in it whole."""
    whole = np.array([s not in split for s in shard.scopes], bool)[shard.scope]
    todo = np.nonzero(whole)[0]
    accepted, cases, by = np.zeros(len(shard.cls), bool), [], []
    for lo in range(0, len(todo), ROWS):
        part = todo[lo : lo + ROWS]
        nodes, at = np.unique(shard.node[part], return_inverse=True)
        sets = [shard.words[j] for j in nodes]
        found = _candidates(shard, shard.sig[nodes], shard.bands[nodes], sets, shard.scope[[shard.rows[j][0] for j in nodes]])
        for i, k in zip(part.tolist(), at.tolist()):
            there = np.sort(np.concatenate([shard.rows[j] for j in found.get(k, [])] or [np.zeros(0, np.int64)]))
            there = there[accepted[there] & (there < i)]
            hit = np.nonzero(alike_vectors([shard.vector[i]], [shard.vector[j] for j in there])[0])[0] if len(there) else ()
            if len(hit):
                cases.append(i)
                by.append(int(there[hit[0]]))
            else:
                accepted[i] = True
    return cases, by


def settle(edges: DataFrame) -> DataFrame:
    """Classes ``q`` that repeat an accepted one, in order, with the smallest. ``edges``: (q, a, a_cid), a before q.

    Each round accepts every class whose earlier partners are all cases, then makes cases of what repeats it. The first
    class left is decided in each round, so the rounds end.
    """
    edges = checkpoint(edges.distinct())
    left = edges
    new = checkpoint(edges.select(F.col("a").alias("c")).distinct().join(edges.select(F.col("q").alias("c")), "c", "left_anti"))
    accepted = new
    while not left.isEmpty():
        cases = left.join(new.select(F.col("c").alias("a")), "a", "left_semi").select("q").distinct()
        # edges of cases are settled, on either side
        rest = left.join(cases, "q", "left_anti")
        open_ = checkpoint(rest.join(cases.select(F.col("q").alias("a")), "a", "left_anti"))
        new = checkpoint(rest.select("q").distinct().join(open_.select("q"), "q", "left_anti").select(F.col("q").alias("c")))
        accepted = accepted.unionByName(new)
        left = open_
    return edges.join(accepted.select(F.col("c").alias("a")), "a", "left_semi").groupBy("q").agg(F.min("a_cid").alias("a_cid"))


# -- the index ---------------------------------------------------------------------------------------------------------
class HistoryIndex:
    """Accepted rows in a folder that survives the session. One writer at a time; a generation counts once the
    manifest names it, so a call that fails leaves the index as it was."""

    def __init__(self, spark: SparkSession, path: str, shard: int = SHARD, compact: int = COMPACT):
        self.spark, self.path, self.shard, self.compact = spark, path.rstrip("/"), shard, compact
        self.system, self.root = _system(self.path)
        self.live: list[tuple[str, int]] = []
        found = self.system.get_file_info(fs.FileSelector(f"{self.root}/manifest", allow_not_found=True))
        self.version = max((int(f.base_name) for f in found if f.base_name.isdigit()), default=0)
        if self.version:
            with self.system.open_input_stream(f"{self.root}/manifest/{self.version}") as f:
                self.live = [(g, int(n)) for g, n in (line.split() for line in f.read().decode().splitlines())]

    def _commit(self, live: list[tuple[str, int]]) -> None:
        """A new manifest, written aside and moved in place."""
        at = f"{self.root}/manifest/{self.version + 1}"
        self.system.create_dir(f"{self.root}/manifest", recursive=True)
        with self.system.open_output_stream(f"{at}.new") as f:
            f.write("".join(f"{g} {n}\n" for g, n in live).encode())
        self.system.move(f"{at}.new", at)
        self.version, self.live = self.version + 1, live

    def _new_gen(self) -> str:
        return f"{self.version + 1:06d}-{uuid.uuid4().hex[:8]}"

    def _write(self, classes: DataFrame, sizes: DataFrame, gen: str, young: bool) -> set[str]:
        """Writes the shards of ``classes``; ``sizes`` has their scopes, with as many or more classes. Gives the scopes
        that lie in several shards (at most one for each ``shard`` classes)."""
        large = F.when(F.col("n") > self.shard, F.col("scope"))
        total, split = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.collect_list(large)).first()
        # large scopes have shards of their own, by class; small ones share shards
        parts = F.when(F.col("n") > self.shard // 4, F.ceil(F.col("n") / self.shard)).otherwise(0).cast("int")
        home = F.concat(F.lit("s"), F.pmod(F.xxhash64("scope"), F.lit(max(1, -(-2 * total // self.shard)))).cast("string"))
        placed = join_groups(classes.select(*SKETCH), sizes.withColumn("parts", parts), ["scope"], "n", total)
        placed = placed.withColumn("shard", F.when(F.col("parts") > 0, self._own(F.col("class"), F.greatest("parts", F.lit(1)))).otherwise(home))
        built = placed.select("shard", *SKETCH).groupBy("shard").applyInArrow(_build(young, set(split)), STORED)
        built.write.partitionBy("shard").parquet(f"{self.path}/shards/gen={gen}")
        return set(split)

    @staticmethod
    def _own(cls: F.Column, parts: F.Column) -> F.Column:
        """The shard of a class of a large scope."""
        return F.concat(F.lit("h"), F.hex(F.xxhash64("scope")), F.lit("-"), F.pmod(F.xxhash64(cls), parts).cast("string"))

    def begin(self, rows: DataFrame) -> None:
        """Rows that are accepted as they are: the history."""
        gen = self._new_gen()
        classes = checkpoint(classes_of(sketched(rows)))
        self._write(classes, sizes_of(classes), gen, young=False)
        self._commit([*self.live, (gen, HISTORY_LEVEL)])

    def _stored(self, gens: list[str]) -> DataFrame | None:
        """``STORED`` of some generations, with gen. Only the columns asked for are read."""
        there = [g for g in gens if self.system.get_file_info(f"{self.root}/shards/gen={g}").type != fs.FileType.NotFound]
        if not there:
            return None
        reader = self.spark.read.schema("scopes array<string>, cases array<binary>, hits array<bigint>, blob binary, gen string, shard string")
        return reader.option("basePath", f"{self.path}/shards").parquet(*[f"{self.path}/shards/gen={g}" for g in there])

    def _ask(self, queries: DataFrame, sizes: DataFrame, stored: DataFrame | None, first_only: bool) -> DataFrame:
        """``HITS`` of the query classes in the shards of their scopes. Queries of one shard beyond ``QUERIES`` are cut
        into blocks for several tasks, each of which opens the shard."""
        if stored is None:
            return self.spark.createDataFrame([], HITS)
        met = stored.select("gen", "shard", F.explode("scopes").alias("scope")).join(sizes.withColumnRenamed("n", "asked"), "scope")
        # the scopes of one shard are at most as many as its classes
        blocks = F.ceil(F.sum("asked").over(Window.partitionBy("gen", "shard")) / QUERIES).cast("int")
        places = met.withColumn("blocks", blocks).groupBy("scope").agg(F.first("asked").alias("asked"), F.collect_list(F.struct("gen", "shard", "blocks")).alias("places"))
        sent = join_groups(queries.select(*SKETCH), places, ["scope"], "asked").select(*SKETCH, F.explode("places").alias("p"))
        sent = sent.select(*SKETCH, "p.gen", "p.shard", F.pmod(F.xxhash64("class"), F.col("p.blocks")).alias("block"))
        return sent.groupBy("gen", "shard", "block").applyInArrow(_search(self.path, first_only), HITS)

    def accept(self, batch: DataFrame) -> DataFrame:
        """(accepted_row_no, row_no) of the rows of ``batch`` that repeat an accepted one; the others become accepted.

        Reads the batch and the stored shards of its scopes, and adds one generation.
        """
        rows = checkpoint(sketched(batch))
        queries = checkpoint(classes_of(rows))
        sizes = sizes_of(queries)
        old = self._ask(queries, sizes, self._stored([g for g, _ in self.live]), True)
        hits = checkpoint(old.groupBy("q").agg(F.min("a_cid").alias("a_cid")))
        young = queries.join(hits.select(F.col("q").alias("class")), "class", "left_anti")
        gen = self._new_gen()
        split = self._write(young, sizes, gen, young=True)
        verdict, stored = hits, self._stored([gen])
        if stored is not None:
            verdict = hits.unionByName(stored.select(F.inline(F.arrays_zip("cases", "hits"))).toDF("q", "a_cid"))
        if split:
            hot = young.where(F.col("scope").isin(sorted(split)))
            lost = settle(self._ask(hot, sizes.where(F.col("scope").isin(sorted(split))), stored, False))
            # a class of a scope in several shards lies in the one its hash says
            parts = sizes.select("scope", F.ceil(F.col("n") / self.shard).cast("int").alias("parts")).where(F.col("scope").isin(sorted(split)))
            dead = hot.select("class", "scope").join(lost.select(F.col("q").alias("class")), "class").join(parts, "scope")
            dead.select("class", self._own(F.col("class"), F.col("parts")).alias("shard")).write.partitionBy("shard").parquet(f"{self.path}/dead/gen={gen}")
            verdict = verdict.unionByName(lost)
        # a class's copies are joined with its verdict, so that one with a third of all rows stays where it is
        mine = queries.select("class", "cid", "copies").join(verdict.withColumnRenamed("q", "class"), "class", "left").select("class", "copies", F.coalesce("a_cid", "cid").alias("accepted_row_no"))
        out = join_groups(rows.select("row_no", "class"), mine, ["class"], "copies")
        out = checkpoint(out.where("accepted_row_no != row_no").select("accepted_row_no", "row_no").distinct())
        self._commit([*self.live, (gen, 0)])
        self._compact()
        return out

    def _compact(self) -> None:
        """Merges ``compact`` generations of one level into one of the next, without their dead classes. Only stored
        sketches are read; the old generations stay in the folder until ``clean``."""
        root = self.path

        def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for g, s in zip(b.column("gen").to_pylist(), b.column("shard").to_pylist()):
                    shard, live = open_shard(root, g, s)
                    yield from shard.sketches(live).to_batches()

        level = 0
        while any(n >= level and n != HISTORY_LEVEL for _, n in self.live):
            old = [g for g, n in self.live if n == level]
            if len(old) >= self.compact:
                gen, stored = self._new_gen(), self._stored(old)
                if stored is not None:
                    shards = stored.select("gen", "shard").repartition("gen", "shard")
                    classes = checkpoint(shards.mapInArrow(opened, "class binary, cid bigint, scope string, sig binary, bands binary, words binary, vector binary"))
                    self._write(classes, sizes_of(classes), gen, young=False)
                self._commit([*[x for x in self.live if x[0] not in old], (gen, level + 1)])
            level += 1

    def clean(self) -> None:
        """Deletes generations that the newest manifest does not name."""
        keep = {f"gen={g}" for g, _ in self.live}
        for part in ("shards", "dead"):
            for f in self.system.get_file_info(fs.FileSelector(f"{self.root}/{part}", allow_not_found=True)):
                if f.base_name.startswith("gen=") and f.base_name not in keep:
                    self.system.delete_dir(f.path)


def steps(incoming: DataFrame) -> list[tuple[int, int]]:
    """Ranges of row_no, in order: one for each batch, batches whose ranges cross in one. Rows without a batch are one
    batch. One range per batch reaches the driver."""
    found = incoming.where("row_no is not null").groupBy("batch_no").agg(F.min("row_no").alias("lo"), F.max("row_no").alias("hi")).select("lo", "hi").collect()
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((r["lo"], r["hi"]) for r in found):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def repeats(memories: DataFrame, incoming: DataFrame, path: str | None = None) -> DataFrame:
    """accepted_row_no, row_no of every incoming row that repeats an accepted row of its scope.

    Builds an index of ``memories`` at ``path`` (by default a new folder beside the checkpoints), then adds the batches of
    ``incoming`` one by one. Rows without words repeat nothing, rows without row_no are left out. Missing vectors (null,
    empty, all zero, not finite) leave the words to decide, and so do vectors of different length. Every row of
    ``memories`` is history, every row of ``incoming`` is checked, whatever its ``batch_no``; order is by ``row_no``. Equal
    rows count once each. Empty inputs give no rows.
    """
    spark = memories.sparkSession
    index = HistoryIndex(spark, path or f"{shared_folder(spark)}/history-index-{uuid.uuid4().hex}")
    index.begin(memories)
    out = None
    for lo, hi in steps(incoming):
        found = index.accept(incoming.where(F.col("row_no").between(lo, hi)))
        index.clean()
        out = found if out is None else out.unionByName(found)
    if path is None:
        index.system.delete_dir(index.root)
    return spark.createDataFrame([], "accepted_row_no bigint, row_no bigint") if out is None else out
