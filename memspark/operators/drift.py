"""Problem 4: files whose schemas drift, read into one table, with a report of each change.

Schemas are read from all lines in parallel and folded per file by a type lattice whose join is a bitwise or, so the
fold is a partial aggregate. Files of a store are put in order of writing and compared with the one before. A field
gone and a field new at the same place are a renaming if the values agree in the records of both files. Levels of
nesting are compared from the top down; their number is the depth of the deepest record, not of the data.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memspark.operators.skew import small
from memspark.session import checkpoint

#: The lattice: joins are the bitwise or of these.
NULL, BOOLEAN, NUMBER, STRING, ARRAY, OBJECT = 0, 1, 2, 4, 8, 16
#: The JSON types among them; the rest says what numbers a column must hold.
TYPES = 31
#: A number with a fraction or exponent, an integer that a double cannot hold, one that a bigint cannot, one that no
#: decimal can.
FRACTION, BEYOND_DOUBLE, BEYOND_LONG, BEYOND_DECIMAL = 32, 64, 128, 256
#: Share of records in both files, with values in both, in which a renamed field must carry the old value.
RENAME_SHARE = 0.9

LEAVES = "store_name string, file_no bigint, written_at timestamp, id string, depth int, parent string, path string, kind int, sig string"


def kind_of(v: object) -> int:
    if v is None:
        return NULL
    if isinstance(v, bool):
        return BOOLEAN
    if isinstance(v, float):
        return NUMBER | FRACTION
    if isinstance(v, int):
        size = abs(v)
        return NUMBER | BEYOND_DOUBLE * (size > 2**53) | BEYOND_LONG * (size >= 2**63) | BEYOND_DECIMAL * (size >= 10**38)
    if isinstance(v, str):
        return STRING
    return ARRAY if isinstance(v, list) else OBJECT


def signature(v: object) -> str:
    """The values in ``v`` whatever the keys above them and their order; numbers equal their text."""
    if isinstance(v, dict):
        return "{" + ",".join(sorted(signature(x) for x in v.values() if x is not None)) + "}"
    if isinstance(v, list):
        return "[" + ",".join(signature(x) for x in v) + "]"
    return json.dumps(v if isinstance(v, str) else json.dumps(v), ensure_ascii=False)


def fields_of(record: dict) -> list[tuple[int, str, str, int, str]]:
    """(depth, parent path, path, kind, signature) of every field, those of objects in arrays taken together."""
    seen: dict[tuple[int, str, str], list] = {}

    def walk(o: dict, depth: int, prefix: str) -> None:
        for k, v in o.items():
            key = (depth, prefix, f"{prefix}{k}")
            at = seen.setdefault(key, [0, []])
            at[0] |= kind_of(v)
            if v is not None:
                at[1].append(signature(v))
            if isinstance(v, dict):
                walk(v, depth + 1, f"{prefix}{k}.")
            elif isinstance(v, list):
                for e in v:
                    if isinstance(e, dict):
                        walk(e, depth + 1, f"{prefix}{k}[].")

    walk(record, 0, "")
    return [(*key, kind, "\x1f".join(sigs)) for key, (kind, sigs) in seen.items()]


def readable(line: str | None) -> dict | None:
    try:
        o = json.loads(line or "")
    except ValueError:
        return None
    return o if isinstance(o, dict) else None


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in LEAVES.split(", ")]
    types = [pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string()]
    for b in batches:
        out: list[list] = [[] for _ in names]
        for s, f, w, line in zip(*(b.column(c).to_pylist() for c in ("store_name", "file_no", "written_at", "record"))):
            if (o := readable(line)) is None:
                continue
            i = o.get("id")
            for depth, parent, path, kind, sig in fields_of(o):
                digest = hashlib.blake2b(sig.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest() if sig else None
                for col, v in zip(out, (s, f, w, None if i is None else str(i), depth, parent, path, kind, digest)):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)


def read_schemas(lines: DataFrame) -> DataFrame:
    """One row per field of each record, parsed in parallel; broken, blank and null lines have none."""
    return lines.select("store_name", "file_no", F.col("written_at").cast("timestamp").alias("written_at"), "record").mapInArrow(_leaves, LEAVES)


def kind_name(c: F.Column) -> F.Column:
    """Names of the JSON types of a lattice element, in the lattice's order."""
    names = [(BOOLEAN, "boolean"), (NUMBER, "number"), (STRING, "string"), (ARRAY, "array"), (OBJECT, "object")]
    return F.concat_ws("|", *[F.when(c.bitwiseAND(b) != 0, F.lit(n)) for b, n in names])


def schema_changes(lines: DataFrame) -> DataFrame:
    """Changes of each file against the one of its store written before it, in order.

    Columns: store_name, seq, file_no, change_kind, field_path, old_path. Ties of ``written_at`` fall by file_no. A
    file without a readable line is no file. A field whose values are all null in either file is not retyped.
    """
    leaves = checkpoint(read_schemas(lines))
    files = leaves.groupBy("store_name", "file_no").agg(F.min("written_at").alias("written_at"))
    # one row per file: the files of a store are few against its lines
    seq = checkpoint(files.withColumn("seq", F.row_number().over(Window.partitionBy("store_name").orderBy("written_at", "file_no"))))
    files_seq = small(seq.select("store_name", "file_no", "seq"))
    fields = checkpoint(
        leaves.groupBy("store_name", "file_no", "depth", "parent", "path").agg(F.bit_or("kind").bitwiseAND(TYPES).alias("kind")).join(files_seq, ["store_name", "file_no"])
    )
    values = leaves.where(F.col("sig").isNotNull() & F.col("id").isNotNull()).groupBy("store_name", "file_no", "id", "path").agg(F.min("sig").alias("sig"))
    values = checkpoint(values.join(files_seq, ["store_name", "file_no"]))
    depth = fields.agg(F.max("depth")).first()[0]
    log, renamed = None, None  # renamed: store_name, seq, old, new of fields renamed so far
    for level in range(0 if depth is None else depth + 1):
        here = fields.where(F.col("depth") == level)
        now = here.select("store_name", "seq", "file_no", "parent", "path", F.col("kind").alias("now"))
        old = here.select("store_name", (F.col("seq") + 1).alias("seq"), F.col("parent").alias("old_parent"), F.col("path").alias("old_path"), F.col("kind").alias("was"))
        key = ["store_name", "seq"]
        # fields of the file before under the current names of their parents
        stem = F.regexp_replace("old_parent", r"(\[\])?\.$", "")
        old = old.withColumn("stem", stem)
        if renamed is not None:
            ren = renamed.select("store_name", "seq", F.col("old").alias("stem"), F.col("new").alias("moved"))
            old = old.join(ren, [*key, "stem"], "left").withColumn("parent", F.when(F.col("moved").isNotNull(), F.concat("moved", F.substring(F.col("old_parent"), F.length("stem") + 1, F.lit(4)))).otherwise(F.col("old_parent"))).drop("moved")
        else:
            old = old.withColumn("parent", F.col("old_parent"))
        old = old.withColumn("path", F.concat("parent", F.expr("substring(old_path, length(old_parent) + 1)"))).drop("stem")
        # only fields whose parent is in both files can change by themselves
        both = checkpoint(now.join(old.drop("parent"), [*key, "path"], "full"))
        whole = seq.where("seq > 1").select("store_name", "seq", F.col("file_no").alias("in_file"))
        both = both.join(whole, key)
        gone = both.where("now is null").select(*key, "in_file", "path", "old_path", "was", F.regexp_replace("path", r"[^.]*$", "").alias("parent"))
        new = both.where("was is null").select(*key, "in_file", "path", "now", "parent")
        if level:
            # both sides must have the parent: it stands in `parents` of the level above
            gone, new = gone.join(parents, [*key, "parent"], "left_semi"), new.join(parents, [*key, "parent"], "left_semi")
        gone, new = checkpoint(gone), checkpoint(new)
        # a file may hold a third of all lines: what was and what is now come to its values, not the values to them
        pairs = small(checkpoint(gone.join(new.select(*key, "parent", F.col("path").alias("new_path"), "now"), [*key, "parent"])))
        before = values.select("store_name", (F.col("seq") + 1).alias("seq"), F.col("path").alias("old_path"), "id", F.col("sig").alias("was_sig")).join(pairs, [*key, "old_path"])
        agree = before.join(values.select("store_name", "seq", F.col("path").alias("new_path"), "id", F.col("sig").alias("now_sig")), [*key, "new_path", "id"])
        scored = agree.groupBy(*key, "in_file", "old_path", "new_path", "was", "now").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("was_sig") == F.col("now_sig")).alias("same"))
        good = scored.where((F.col("same") > 0) & (F.col("same") >= RENAME_SHARE * F.col("n")))
        best = lambda side: F.row_number().over(Window.partitionBy(*key, side).orderBy(F.desc("same"), "old_path", "new_path"))
        moved = checkpoint(good.withColumns({"a": best("old_path"), "b": best("new_path")}).where("a = 1 and b = 1").drop("a", "b"))
        row = lambda df, what, path, former: df.select(*key, F.col("in_file").alias("file_no"), F.lit(what).alias("change_kind"), path.alias("field_path"), former.alias("old_path"))
        none = F.lit("")
        retyped = lambda was, now: (was != 0) & (now != 0) & (was != now)
        level_log = (
            row(moved, "renamed", F.col("new_path"), F.col("old_path"))
            .unionByName(row(moved.where(retyped(F.col("was"), F.col("now"))), "retyped", F.col("new_path"), none))
            .unionByName(row(both.where(retyped(F.col("was"), F.col("now"))), "retyped", F.col("path"), none))
            .unionByName(row(new.join(moved.select(*key, F.col("new_path").alias("path")), [*key, "path"], "left_anti"), "added", F.col("path"), none))
            .unionByName(row(gone.join(moved.select(*key, "old_path"), [*key, "old_path"], "left_anti"), "removed", F.col("old_path"), none))
        )
        log = level_log if log is None else log.unionByName(level_log)
        here_renamed = moved.select(*key, F.col("old_path").alias("old"), F.col("new_path").alias("new"))
        # renamings of a field under a parent that kept its name, and under one that did not, are both by full path
        renamed = here_renamed if renamed is None else renamed.unionByName(here_renamed)
        kept = both.where("now is not null and was is not null").select(*key, "path", F.col("was"), F.col("now")).unionByName(moved.select(*key, F.col("new_path").alias("path"), "was", "now"))
        # a field's own retyping covers the fields below it
        kept = kept.where(~retyped(F.col("was"), F.col("now"))).select(*key, F.explode(F.array(F.concat("path", F.lit(".")), F.concat("path", F.lit("[].")))).alias("parent"))
        parents = checkpoint(kept)
    if log is None:
        return lines.sparkSession.createDataFrame([], "store_name string, seq int, file_no bigint, change_kind string, field_path string, old_path string")
    return log


#: Cast targets of lattice elements; a field that was ever an array is an array of text, an object stays JSON.
def mixed(kind: int) -> bool:
    """True for text and for fields of several types, which are text."""
    return bool(kind & STRING) or (kind & TYPES).bit_count() > 1


def column_type(kind: int) -> str:
    """bigint for integers, decimal for longer ones, double where there are fractions; text where that would lose digits."""
    if kind & OBJECT:
        return "json"
    if kind & ARRAY:
        return "array<string>"
    if mixed(kind) or not kind:
        return "string"
    if kind & BOOLEAN:
        return "boolean"
    if kind & FRACTION:
        return "string" if kind & BEYOND_DOUBLE else "double"
    return "string" if kind & BEYOND_DECIMAL else "decimal(38,0)" if kind & BEYOND_LONG else "bigint"


_LAST = re.compile(r"^(.*?)((?:\[\])?\.)([^.]*)$", re.S)


def canonical_path(path: str, names: dict[str, str]) -> str:
    """First name of ``path``: its own, else that of its parent with its last key."""
    if path in names:
        return names[path]
    m = _LAST.match(path)
    return canonical_path(m[1], names) + m[2] + m[3] if m else path


def canonical_names(changes: DataFrame) -> DataFrame:
    """store_name, seq, path, canonical: the first name of each renamed field, by full path, from the file of the renaming on."""
    import pandas as pd

    def under(path: str, moved: dict[str, str]) -> str:
        # the path after this file's renamings of the fields above it
        m = _LAST.match(path)
        return moved.get(path) or (under(m[1], moved) + m[2] + m[3] if m else path)

    def fold(log: pd.DataFrame) -> pd.DataFrame:
        root: dict[str, str] = {}
        out = []
        for seq, rows in log.sort_values("seq").groupby("seq", sort=True):
            now = dict(zip(rows.old_path, rows.field_path))
            moved = {new: canonical_path(old, root) for old, new in now.items()}
            root = {under(p, now): c for p, c in root.items() if p not in now} | moved
            out += [(log.store_name.iloc[0], int(seq), p, c) for p, c in root.items()]
        return pd.DataFrame(out, columns=["store_name", "seq", "path", "canonical"])

    renamed = changes.where("change_kind = 'renamed'")
    # the log of renamings of one store, not its records, is what one call holds
    return renamed.select("store_name", "seq", "field_path", "old_path").groupBy("store_name").applyInPandas(fold, "store_name string, seq int, path string, canonical string")


class _Number(str):
    """A number as it is written."""


def _dump(v: object) -> str:
    if isinstance(v, _Number):
        return str(v)
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_dump(x)}" for k, x in v.items()) + "}"
    return "[" + ",".join(map(_dump, v)) + "]" if isinstance(v, list) else json.dumps(v, ensure_ascii=False)


def settled_fields(record: str | None, names: dict[str, str], kinds: dict[str, int]) -> dict[str, str]:
    """JSON of the top-level fields of ``record`` in which nested keys get their first names or values are cast.

    ``kinds`` has the lattice element of each nested field by its first name. As in columns, a field of more than one
    type is text, one that was ever a list is a list of text, and an object stays. A key whose first name another value
    of its object holds keeps its own.
    """

    def text(v: object) -> object:
        return v if v is None or type(v) is str else str(v) if isinstance(v, _Number) else _dump(v)

    def walk(v: object, path: str, first: str) -> object:
        if isinstance(v, list):
            return [fields(x, f"{path}[].", f"{first}[].") if isinstance(x, dict) else x for x in v]
        return fields(v, f"{path}.", f"{first}.") if isinstance(v, dict) else v

    def fields(o: dict, prefix: str, first: str) -> dict:
        out: dict[str, object] = {}
        own = {k: canonical_path(prefix + k, names) for k in o}
        for k, v in o.items():
            to = own[k][len(first) :] if own[k].startswith(first) else k
            clash = to != k and ((to in o and o[to] is not None) or out.get(to) is not None)
            key, at = (k, prefix + k) if clash else (to, first + to)
            if key in out and v is None:
                continue
            out[key] = cast(walk(v, prefix + k, at), kinds.get(at, 0))
        return out

    def cast(v: object, kind: int) -> object:
        if v is None or kind & OBJECT:
            return v
        if kind & ARRAY:
            return [x if isinstance(x, dict) else text(x) for x in v] if isinstance(v, list) else [text(v)]
        return text(v) if mixed(kind) else v

    try:
        o = json.loads(record or "", parse_int=_Number, parse_float=_Number, parse_constant=_Number)
    except ValueError:
        return {}
    if not isinstance(o, dict):
        return {}
    out = {}
    for k, v in o.items():
        if isinstance(v, (dict, list)):
            new = walk(v, k, canonical_path(k, names))
            if (now := _dump(new)) != _dump(v):
                out[k] = now
    return out


def unified_table(lines: DataFrame) -> DataFrame:
    """All readable lines with the columns of the union schema, cast through the lattice.

    store_name, file_no, line_no, written_at, id, then one column per top-level field in order of name, renamed fields
    under their first name. Objects, also those in lists, stay JSON in which nested fields have their first names and
    are cast too. Values that a cast cannot hold are null; nulls stay null. Only the schema (one row per distinct field)
    reaches the driver.
    """
    changes = checkpoint(schema_changes(lines))
    leaves = read_schemas(lines)
    files = leaves.groupBy("store_name", "file_no").agg(F.min("written_at").alias("written_at"))
    seq = files.withColumn("seq", F.row_number().over(Window.partitionBy("store_name").orderBy("written_at", "file_no"))).select("store_name", "file_no", "seq")
    names = checkpoint(canonical_names(changes))
    steps = names.select("store_name", F.col("seq").alias("since")).distinct()
    # of each file: the last renaming at or before it
    current = seq.join(steps, "store_name", "left").where("since is null or since <= seq").groupBy("store_name", "file_no").agg(F.max("since").alias("since"))
    lookup = current.join(names.withColumnRenamed("seq", "since"), ["store_name", "since"]).groupBy("store_name", "file_no").agg(F.map_from_entries(F.collect_set(F.struct("path", "canonical"))).alias("names"))
    kinds = leaves.groupBy("store_name", "file_no", "depth", "path").agg(F.bit_or("kind").alias("kind")).join(lookup, ["store_name", "file_no"], "left")
    first_name = F.udf(lambda path, names: canonical_path(path, names or {}), "string")
    kinds = kinds.groupBy("depth", first_name("path", "names").alias("field")).agg(F.bit_or("kind").alias("kind"))
    found = kinds.orderBy("field").collect()
    schema = [(r["field"], r["kind"]) for r in found if r["depth"] == 0 and r["field"] != "id"]
    nested = {r["field"]: r["kind"] for r in found if r["depth"]}
    settled = F.udf(lambda record, names: settled_fields(record, names or {}, nested), "map<string,string>")
    parsed = F.from_json("record", "map<string,string>")
    rows = lines.withColumn("_m", parsed).where(F.col("_m").isNotNull()).join(small(lookup), ["store_name", "file_no"], "left")
    rows = rows.withColumn("_s", settled("record", "names")).withColumn("_m", F.transform_values("_m", lambda k, v: F.coalesce(F.col("_s")[k], v)))
    rows = rows.withColumn("_m", F.when(F.col("names").isNull(), F.col("_m")).otherwise(F.transform_keys("_m", lambda k, v: F.coalesce(F.col("names")[k], k))))

    def cast(field: str, kind: int) -> F.Column:
        raw, to = F.col("_m")[field], column_type(kind)
        if to == "array<string>":
            return F.when(F.substring(F.ltrim(raw), 1, 1) == "[", F.from_json(raw, "array<string>")).when(raw.isNotNull(), F.array(raw))
        return raw if to in ("json", "string") else raw.try_cast(to)

    return rows.select("store_name", "file_no", "line_no", "written_at", F.col("_m")["id"].alias("id"), *[cast(f, k).alias(f) for f, k in schema])
