"""Deeply nested records as flat, related tables, by way of an adjacency table.

Every nested value becomes *nodes*: ``node`` (its path inside the record, keys with ``.``, ``[``,
``]`` and ``%`` percent-encoded, so that different values have different paths), ``parent`` (the
path of the value that holds it), ``label`` (field name or map key), ``ordinal`` (position in
a list), ``kind`` and ``scalar``.  Typed columns are shredded by expressions generated from
their schema, inside the JVM; JSON text of unknown shape is walked in Arrow batches.  Object
nodes joined with their scalar children and pivoted by label are the entity tables; the join
is a grouping of the node table by parent, so each node is shuffled once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE = T.StructType(
    [
        T.StructField("node", T.StringType()),
        T.StructField("parent", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("scalar", T.StringType()),
    ]
)

ROOT = "$"

# Characters of keys that have a meaning in paths.
_ENCODED = (("%", "%25"), (".", "%2E"), ("[", "%5B"), ("]", "%5D"))


def step(key: str) -> str:
    """A key as a step of a path."""
    for c, e in _ENCODED:
        key = key.replace(c, e)
    return key


def _step(key: Column) -> Column:
    for c, e in _ENCODED:
        key = F.replace(key, F.lit(c), F.lit(e))
    return key


def below(path: Column, name: str) -> Column:
    """Is the path that of ``name`` or of something in it?"""
    at = f"{ROOT}.{name}"
    return (path == at) | path.startswith(at + ".") | path.startswith(at + "[")


def _node(path: Column, parent: Column, label: Column | None, ordinal: Column | None, kind: str, scalar: Column | None) -> Column:
    none = F.lit(None)
    return F.struct(
        path.alias("node"),
        parent.alias("parent"),
        (none.cast("string") if label is None else label).alias("label"),
        (none.cast("int") if ordinal is None else ordinal.cast("int")).alias("ordinal"),
        F.lit(kind).alias("kind"),
        (none.cast("string") if scalar is None else scalar.cast("string")).alias("scalar"),
    )


def _nodes(value: Column, kind: T.DataType, path: Column, parent: Column, label: Column | None, ordinal: Column | None, scalars: bool) -> Column:
    """Array of the nodes of ``value`` and everything below it; null values have no node."""
    empty = F.expr("cast(array() as array<struct<node:string,parent:string,label:string,ordinal:int,kind:string,scalar:string>>)")
    if isinstance(kind, T.StructType):
        below = [
            _nodes(value[f.name], f.dataType, F.concat(path, F.lit("." + f.name)), path, F.lit(f.name), None, scalars)
            for f in kind.fields
            if scalars or isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))
        ]
        own = F.array(_node(path, parent, label, ordinal, "object", None))
        every = F.concat(own, *below) if below else own
    elif isinstance(kind, T.ArrayType):
        inner = F.transform(value, lambda x, i: _nodes(x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), path, None, i, scalars))
        every = F.concat(F.array(_node(path, parent, label, ordinal, "list", None)), F.flatten(inner))
    elif isinstance(kind, T.MapType):
        inner = F.transform(
            F.map_entries(value),
            lambda e: _nodes(e["value"], kind.valueType, F.concat(path, F.lit("."), _step(e["key"].cast("string"))), path, e["key"].cast("string"), None, scalars),
        )
        every = F.concat(F.array(_node(path, parent, label, ordinal, "object", None)), F.flatten(inner))
    else:
        every = F.array(_node(path, parent, label, ordinal, "scalar", value))
    return F.when(value.isNotNull(), every).otherwise(empty)


def node_array(df: DataFrame, columns: Sequence[str], scalars: bool = True) -> Column:
    """One array column with the nodes of the named columns (``a.b`` reaches into structs).

    ``scalars=False`` leaves out scalar fields of objects (not list elements or map values),
    for callers that need the records but not their fields; the scan then prunes nothing
    but the shuffle gets narrow.
    """
    parts = []
    for name in columns:
        kind = df.select(name).schema[0].dataType
        label = name.rsplit(".", 1)[-1]
        up = ".".join([ROOT, *name.split(".")[:-1]])
        parts.append(_nodes(F.col(name), kind, F.lit(f"{up}.{label}"), F.lit(up), F.lit(label), None, scalars))
    return F.concat(*parts)


def _walk(value: object, path: str, parent: str, label: str | None, ordinal: int | None, out: list[tuple]) -> None:
    """Append the nodes below ``value``; an explicit stack, so depth cannot overflow."""
    stack = [(value, path, parent, label, ordinal)]
    while stack:
        v, p, up, lab, pos = stack.pop()
        if v is None:
            continue
        if isinstance(v, dict):
            out.append((p, up, lab, pos, "object", None))
            stack.extend((x, f"{p}.{step(str(k))}", p, str(k), None) for k, x in reversed(v.items()))
        elif isinstance(v, list):
            out.append((p, up, lab, pos, "list", None))
            stack.extend((x, f"{p}[{i}]", p, None, i) for i, x in reversed(list(enumerate(v))))
        else:
            text = v if isinstance(v, str) else json.dumps(v)
            out.append((p, up, lab, pos, "scalar", text))


def _deep(text: str) -> object:
    """JSON too deep for the usual parser, read with a stack of its own; ValueError as there."""
    scan, white = json.JSONDecoder(), re.compile(r"[ \t\n\r]*")
    root: list = []
    stack: list[tuple[object, str | None]] = [(root, None)]  # open containers and the key waiting in each
    at, state = white.match(text, 0).end(), "value"
    while True:
        box, key = stack[-1]
        if state == "value":
            if text[at : at + 1] in ("{", "["):
                new: object = {} if text[at] == "{" else []
                box.append(new) if isinstance(box, list) else box.__setitem__(key, new)
                stack.append((new, None))
                at = white.match(text, at + 1).end()
                state = "close" if text[at : at + 1] in ("}", "]") else "key" if isinstance(new, dict) else "value"
                continue
            value, at = scan.scan_once(text, at) if at < len(text) else _fail()
            box.append(value) if isinstance(box, list) else box.__setitem__(key, value)
            at, state = white.match(text, at).end(), "next"
        elif state == "key":
            name, at = scan.scan_once(text, at) if text[at : at + 1] == '"' else _fail()
            at = white.match(text, at).end()
            if text[at : at + 1] != ":":
                _fail()
            stack[-1] = (box, name)
            at, state = white.match(text, at + 1).end(), "value"
        elif state == "close":
            if text[at : at + 1] != ("}" if isinstance(box, dict) else "]"):
                _fail()
            stack.pop()
            at, state = white.match(text, at + 1).end(), "next"
        elif len(stack) == 1:
            return root[0] if at == len(text) else _fail()
        elif text[at : at + 1] == ",":
            at = white.match(text, at + 1).end()
            state = "key" if isinstance(box, dict) else "value"
        else:
            state = "close"


def _fail() -> tuple:
    raise ValueError("no JSON")


def _loads(text: str) -> object:
    try:
        return json.loads(text)
    except RecursionError:
        return _deep(text)


def json_nodes(text: str | None, label: str = "json") -> list[tuple]:
    """Nodes of a JSON text; text inside a JSON string is read again; [] if unreadable."""
    value: object = text
    try:
        while isinstance(value, str):
            value = _loads(value)
    except (ValueError, StopIteration):
        return []
    out: list[tuple] = []
    _walk(value, f"{ROOT}.{label}", ROOT, label, None, out)
    return out


def json_node_table(df: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """Adjacency table of a JSON text column: the key and the node columns."""
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), *NODE.fields])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *n) for k, t in zip(batch[key], batch[text]) for n in json_nodes(t, label)]
            out = pd.DataFrame(rows, columns=schema.names)
            out["ordinal"] = out["ordinal"].astype("Int32")
            yield out

    return df.select(key, text).filter(F.col(text).isNotNull()).mapInPandas(walk, schema)


def node_table(df: DataFrame, key: str, columns: Sequence[str], scalars: bool = True) -> DataFrame:
    """Adjacency table of typed nested columns: the key and the node columns."""
    return df.select(key, F.explode(node_array(df, columns, scalars)).alias("n")).select(key, "n.*")


def entity_table(nodes: DataFrame, key: str, parent: str, fields: Sequence[str]) -> DataFrame:
    """One row per object below ``parent``: key, ``ordinal``, ``label`` and the scalar fields.

    Object nodes meet their scalar children in one grouping by (key, object), pivoted by
    label.  Objects without scalar children keep their row, with null fields.  Fields other
    than ``fields`` are left out; scalars are text.
    """
    at = F.lit(f"{ROOT}.{parent}")
    objects = nodes.filter((F.col("parent") == at) & (F.col("kind") == "object")).select(
        key, F.col("node").alias("object"), "ordinal", "label", F.lit(None).cast("string").alias("_f"), F.lit(None).cast("string").alias("scalar")
    )
    children = nodes.filter((F.col("kind") == "scalar") & below(F.col("parent"), parent) & F.col("label").isin(*fields)).select(
        key, F.col("parent").alias("object"), F.lit(None).cast("int").alias("ordinal"), F.lit(None).cast("string").alias("label"), F.col("label").alias("_f"), "scalar"
    )
    return (
        objects.unionByName(children)
        .groupBy(key, "object")
        .agg(
            F.max("ordinal").alias("ordinal"),
            F.max("label").alias("label"),
            F.count(F.when(F.col("_f").isNull(), 1)).alias("_objects"),
            *[F.max(F.when(F.col("_f") == f, F.col("scalar"))).alias(f) for f in fields],
        )
        .filter("_objects > 0")
        .drop("_objects", "object")
    )


def _groups_and_metrics(nodes: DataFrame, key: str, label: str) -> tuple[DataFrame, DataFrame]:
    """``(key, g, group)`` and ``(key, g, group, metric, item)`` of a JSON text; ``g`` and
    ``item`` are the nodes of the group and of the metric.

    Reads both shapes of either level: a list of objects that name themselves (``group``,
    ``metric``), or an object whose labels are the names.  A ``metrics`` object that names
    itself is a single metric.  The scalar children that name their object are joined to it
    by two groupings over the adjacency table.
    """
    is_groups = (F.col("parent") == f"{ROOT}.{label}") & (F.col("label") == "groups")
    top = f"{ROOT}.{label}.groups"
    # an object's own name: its scalar child "group" or "metric", found by grouping by parent
    w = Window.partitionBy(key, "holder")
    tagged = (
        nodes.filter(~is_groups & below(F.col("node"), f"{label}.groups"))
        .withColumn("is_name", (F.col("kind") == "scalar") & F.col("label").isin("group", "metric"))
        .withColumn("holder", F.when(F.col("is_name"), F.col("parent")).otherwise(F.col("node")))
        .withColumn("own_name", F.max(F.when(F.col("is_name"), F.col("scalar"))).over(w))
    )
    groups = tagged.filter((F.col("parent") == top) & (F.col("kind") == "object") | (F.col("parent") == top) & F.col("label").isNotNull())
    groups = groups.select(key, F.col("node").alias("g"), F.coalesce(F.when(F.col("label").isNotNull(), F.col("label")), F.col("own_name")).alias("group"))
    groups = groups.filter(F.col("group").isNotNull())
    boxes = tagged.filter((F.col("label") == "metrics") & F.col("kind").isin("object", "list")).select(
        key, F.col("parent").alias("g"), F.col("node").alias("m"), "kind", F.col("own_name").alias("single")
    )
    items = tagged.filter(~F.col("is_name") & (F.col("label").isNull() | (F.col("label") != "metrics"))).select(
        key, F.col("parent").alias("m"), F.col("node").alias("item"), F.coalesce("label", "own_name").alias("metric"), F.col("kind").alias("item_kind"), "ordinal"
    )
    listed = boxes.join(items, [key, "m"]).filter(
        ((F.col("kind") == "object") & F.col("single").isNull()) | ((F.col("kind") == "list") & F.col("ordinal").isNotNull())
    ).select(key, "g", "metric", "item")
    alone = boxes.filter((F.col("kind") == "object") & F.col("single").isNotNull()).select(key, "g", F.col("single").alias("metric"), F.col("m").alias("item"))
    return groups, groups.join(listed.unionByName(alone).filter(F.col("metric").isNotNull()), [key, "g"])


def grouped_metrics(nodes: DataFrame, key: str, label: str) -> DataFrame:
    """``(key, child_table, child_key)`` of groups and their metrics in a JSON text."""
    groups, metrics = _groups_and_metrics(nodes, key, label)
    return groups.select(key, F.lit("bias_groups").alias("child_table"), F.col("group").alias("child_key")).unionByName(
        metrics.select(key, F.lit("bias_metrics").alias("child_table"), F.concat_ws("/", "group", "metric").alias("child_key"))
    )


def group_table(nodes: DataFrame, key: str, label: str) -> DataFrame:
    """One row per group of a JSON text: key, ``node``, ``group`` and the texts ``n``,
    ``ci_lo`` and ``ci_hi``, null where the group has none."""
    groups, _ = _groups_and_metrics(nodes, key, label)
    in_ci = F.col("parent").endswith(".ci") & F.col("label").isin("lo", "hi")
    fields = (
        nodes.filter((F.col("kind") == "scalar") & (in_ci | (F.col("label") == "n")))
        .withColumn("g", F.when(in_ci, F.expr("substring(parent, 1, length(parent) - 3)")).otherwise(F.col("parent")))
        .groupBy(key, "g")
        .agg(*[F.max(F.when(F.col("label") == f, F.col("scalar"))).alias(name) for f, name in (("n", "n"), ("lo", "ci_lo"), ("hi", "ci_hi"))])
    )
    return groups.join(fields, [key, "g"], "left").select(key, F.col("g").alias("node"), "group", "n", "ci_lo", "ci_hi")


def metric_table(nodes: DataFrame, key: str, label: str) -> DataFrame:
    """One row per metric of a JSON text: key, ``node``, ``group``, ``metric`` and the text
    ``value``, null where the metric has none."""
    _, metrics = _groups_and_metrics(nodes, key, label)
    scalars = nodes.filter(F.col("kind") == "scalar")
    values = scalars.select(key, F.col("node").alias("item"), F.col("scalar").alias("value")).unionByName(
        scalars.filter(F.col("label") == "value").select(key, F.col("parent").alias("item"), F.col("scalar").alias("value"))
    )
    return metrics.join(values, [key, "item"], "left").select(key, F.col("item").alias("node"), "group", "metric", "value")


def value_table(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """The scalars directly below the list or map ``parent``: key, ``ordinal``, ``label``, ``scalar``."""
    return nodes.filter((F.col("parent") == f"{ROOT}.{parent}") & (F.col("kind") == "scalar")).select(key, "ordinal", "label", "scalar")


def record_table(nodes: DataFrame, key: str, name: str, fields: Sequence[str]) -> DataFrame:
    """One row per object ``name``: key and the named scalar fields as text, null if absent."""
    at = f"{ROOT}.{name}"
    return (
        nodes.filter((F.col("node") == at) & (F.col("kind") == "object") | (F.col("parent") == at) & (F.col("kind") == "scalar"))
        .groupBy(key)
        .agg(
            F.count(F.when(F.col("node") == at, 1)).alias("_objects"),
            *[F.max(F.when((F.col("parent") == at) & (F.col("label") == f), F.col("scalar"))).alias(f) for f in fields],
        )
        .filter("_objects > 0")
        .drop("_objects")
    )
