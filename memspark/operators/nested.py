"""Problem 5: deeply nested metadata as flat child tables, by Dewey labels.

Each node of a repeated part gets the path of its ordinals as label (``[2]`` the third relation, ``[2, 0]`` its first
evidence). The parent's label is the label without its last ordinal, so parent and place need no join; nodes are
grouped into tables by their schema path, each with the columns of its elements' own fields. One scan, JVM expressions
only, one generator per memory row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE = "array<struct<child_path:string,label:array<int>,link_value:string,element:string>>"


@dataclass(frozen=True)
class Part:
    """A repeated part: its key under the parent, its schema path, the value of a node, and its own parts."""

    key: str
    path: str
    value: Callable[[Column], Column]
    parts: tuple[Part, ...] = field(default_factory=tuple)


def as_list(raw: Column) -> Column:
    """JSON text as an array of the texts of its elements: arrays as they are, anything else as one element."""
    head = F.substring(F.ltrim(raw), 1, 1)
    listed = F.when(head == "[", F.coalesce(F.from_json(raw, "array<string>"), F.array(raw))).otherwise(F.array(raw))
    return F.when(raw.isNull(), F.array().cast("array<string>")).otherwise(listed)


def _nodes(element: Column, part: Part, label: Column) -> Column:
    """Nodes of ``part`` below one element."""

    def at(x: Column, i: Column) -> Column:
        own = F.concat(label, F.array(i))
        value = part.value(x)
        me = F.when(value.isNotNull(), F.array(F.struct(F.lit(part.path).alias("child_path"), own.alias("label"), value.alias("link_value"), x.alias("element")))).otherwise(F.array().cast(NODE))
        return F.concat(me.cast(NODE), *[_nodes(x, p, own) for p in part.parts])

    return F.flatten(F.transform(as_list(F.get_json_object(element, f"$.{part.key}")), at))


def relation_target(x: Column) -> Column:
    """Target of a relation however its key is spelt; null if blank."""
    keys = F.from_json(x, "map<string,string>")
    hit = F.map_filter(keys, lambda k, v: F.lower(F.translate(k, "_- ", "")).isin("targetid", "target") & (F.trim(F.coalesce(v, F.lit(""))) != ""))
    return F.try_element_at(F.map_values(hit), F.lit(1))


def _text(key: str) -> Callable[[Column], Column]:
    """The value at ``key`` of an object, empty if it has none; null if the element is no object."""
    return lambda x: F.when(F.substring(F.ltrim(x), 1, 1) == "{", F.coalesce(F.get_json_object(x, f"$.{key}"), F.lit("")))


MEMORY_PARTS = (
    Part("relations", "relations", relation_target, (Part("evidence", "relations.evidence", _text("session")),)),
    Part("provenance", "provenance", _text("session"), (Part("derived_from", "provenance.derived_from", lambda x: F.when(F.trim(x) != "", x)),)),
    Part("support_info", "support_info", lambda x: F.lit(None).cast("string"), (Part("slices", "support_info.slices", _text("context")),)),
)


def shred(df: DataFrame, json_col: str, key: str, parts: tuple[Part, ...] = MEMORY_PARTS) -> DataFrame:
    """One row per node: ``key``, child_path, label, parent_label, parent_pos, child_pos, link_value, element (its
    JSON).

    Rows whose JSON is null, empty, cut off or no object have no nodes. Elements count in positions whether usable or
    not. A part written as a JSON string counts as the part. Slices belong to the memory row, so their label is cut to
    their own ordinal.
    """
    whole = F.from_json(F.col(json_col), "map<string,string>")
    top = df.select(F.col(key).alias(key), F.when(whole.isNotNull(), F.col(json_col)).alias("_j")).where(F.col("_j").isNotNull())
    nodes = F.concat(*[_nodes(F.col("_j"), p, F.array().cast("array<int>")) for p in parts])
    flat = top.select(key, F.inline(nodes))
    single = F.col("child_path") == "support_info.slices"
    label = F.when(single, F.slice("label", -1, 1)).otherwise(F.col("label"))
    return flat.withColumn("label", label).select(
        key,
        "child_path",
        "label",
        F.slice("label", 1, F.size("label") - 1).alias("parent_label"),
        F.when(F.size("label") > 1, F.try_element_at("label", F.lit(-2))).otherwise(F.lit(-1)).cast("bigint").alias("parent_pos"),
        F.element_at("label", -1).cast("bigint").alias("child_pos"),
        "link_value",
        "element",
    )


#: Columns of each child table: key and type. A key of an object in the element goes by a dot, its column by ``_``.
FIELDS = {
    "relations": (("type", "string"),),
    "relations.evidence": (("session", "string"), ("quote", "string"), ("seen", "string"), ("seen.turn", "bigint"), ("seen.weight", "double")),
    "provenance": (("session", "string"), ("trigger", "string"), ("date", "string")),
    "provenance.derived_from": (),
    "support_info.slices": (
        ("context", "string"),
        ("confirmations", "bigint"),
        ("contradictions", "bigint"),
        ("strength", "double"),
        ("last_observed_at", "bigint"),
    ),
}
#: Parts with tables of their own.
NESTED = {"relations": ("evidence",), "provenance": ("derived_from",)}


def child_table(nodes: DataFrame, path: str) -> DataFrame:
    """The flat table of one schema path, with the fields of its elements.

    Columns of ``FIELDS`` (null where the key is missing or the value does not fit), then ``others``: all other fields
    as they are spelt, objects and lists as JSON; a value that does not fit its column is there too. Parts with tables
    of their own are left out. Elements that are no objects have no fields.
    """
    named = dict(FIELDS[path])
    own = F.from_json("element", "map<string,string>")
    df = nodes.where(F.col("child_path") == path).withColumn("_f", F.when(F.substring(F.ltrim("element"), 1, 1) == "{", own))

    def value(key: str) -> Column:
        first, _, rest = key.partition(".")
        raw = F.col("_f")[first]
        return F.get_json_object(raw, f"$.{rest}") if rest else raw

    def other(k: Column, v: Column) -> Column:
        keep = ~k.isin(*named, *NESTED.get(path, ()))
        for key, to in named.items():
            if to != "string":
                keep = keep | ((k == key) & v.isNotNull() & v.try_cast(to).isNull())
        return keep

    columns = [value(k).try_cast(to).alias(k.replace(".", "_")) for k, to in named.items()]
    others = F.map_filter("_f", other) if named else F.col("_f")
    return df.select(*[c for c in nodes.columns if c not in ("child_path", "element")], *columns, others.alias("others"))
