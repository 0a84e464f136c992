"""Nested records to flat tables by Dewey labels.

Every node of a record (object, list, value) gets the ordinals on its way from the root as its label,
e.g. ``[2, 0, 3]``; the parent's label is that label without its last ordinal, and nodes with the same
schema path (``$.methods.nms.extraction.brand.logo_timestamps[]``) make up one table. No node is
joined to another to find its parent, so shredding is one pass over the records without a shuffle.

Typed columns (structs and arrays) are labelled by Column expressions in the JVM; JSON texts by one
walk in Python. Both take the schema paths that are wanted, so that nodes of others are never made,
and subtrees that hold none are never entered.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds of nodes.
OBJECT, ARRAY, TEXT, NUMBER, BOOLEAN, NULL = "object", "array", "text", "number", "boolean", "null"


def read_json(text: str | None):
    """(True, value) of a readable document, else (False, None).

    A JSON text whose value is again the JSON text of an object or list counts as that one, at any
    number of wrappings; NaN and Infinity are read as such.
    """
    if text is None or not text.strip():
        return False, None
    try:
        value = json.loads(text)
        while isinstance(value, str):
            value = json.loads(value)
    except (ValueError, RecursionError):
        return False, None
    return True, value


def kind_of(value) -> str:
    if value is None:
        return NULL
    if isinstance(value, bool):
        return BOOLEAN
    if isinstance(value, (int, float)):
        return NUMBER
    return TEXT if isinstance(value, str) else OBJECT if isinstance(value, dict) else ARRAY


def _text_of(value) -> str | None:
    if value is None or isinstance(value, (dict, list)):
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    return value.encode("utf-8", "replace").decode() if isinstance(value, str) else repr(value)


def _container(path: str, key: str) -> str:
    """A member's schema path; names with dots or brackets are quoted, so that paths stay unambiguous."""
    return f"{path}.{key}" if key and not set(key) & set(".[]\"") else f"{path}[{json.dumps(key)}]"


Keep = Callable[[str, str | None], bool]


class Labels:
    """The walk over a record; schema paths, and what is wanted of each, are worked out once a path."""

    def __init__(self, keep: Keep | None = None, enter: Callable[[str], bool] | None = None):
        self.keep, self.enter = keep, enter
        self.paths: dict[tuple[str, str | None], tuple[str, bool, bool]] = {}

    def below(self, path: str, name: str | None) -> tuple[str, bool, bool]:
        """(schema path of a member or element, whether its node is wanted, whether anything in it is)."""
        if (found := self.paths.get((path, name))) is None:
            to = path + "[]" if name is None else _container(path, name)
            found = self.paths[path, name] = (to, self.keep is None or self.keep(to, name), self.enter is None or self.enter(to))
        return found

    def nodes(self, value) -> Iterator[tuple[list[int], str, str | None, str, str | None]]:
        """(dewey, schema path, name, kind, text) of each wanted node, in document order; no recursion, any depth."""
        stack = [([], "$", None, value, self.keep is None or self.keep("$", None), True)]
        while stack:
            dewey, path, name, v, wanted, entered = stack.pop()
            if wanted:
                yield dewey, path, name, kind_of(v), _text_of(v)
            if not entered or not isinstance(v, (dict, list)):
                continue
            inner = []
            for i, (k, x) in enumerate(v.items() if isinstance(v, dict) else ((None, x) for x in v)):
                to, keeps, enters = self.below(path, k)
                if keeps or (enters and isinstance(x, (dict, list))):
                    inner.append((dewey + [i], to, k, x, keeps, enters))
            stack.extend(reversed(inner))


def label_nodes(value, keep: Keep | None = None, enter: Callable[[str], bool] | None = None) -> Iterator[tuple[list[int], str, str | None, str, str | None]]:
    """(dewey, schema path, name, kind, text) of each node, or of the wanted ones, in document order."""
    return Labels(keep, enter).nodes(value)


NODE = T.StructType(
    [
        T.StructField("dewey", T.ArrayType(T.IntegerType())),
        T.StructField("schema_path", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("node_kind", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)


def as_json(df: DataFrame, column: str) -> Column:
    """A text, VARIANT, struct, map or array column as JSON text; absent fields are kept as nulls."""
    kind = df.schema[column].dataType
    c = F.col(f"`{column}`")
    return c if isinstance(kind, T.StringType) else F.to_json(c, {"ignoreNullFields": "false"})


NODES = T.ArrayType(NODE)


def _typed(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_typed(f.dataType) or not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType)) for f in kind.fields)
    return isinstance(kind, T.ArrayType) and (_typed(kind.elementType) or not isinstance(kind.elementType, (T.StructType, T.ArrayType, T.MapType, T.VariantType)))


def typed_nodes(value: Column, kind: T.DataType, keep: Keep | None = None, enter: Callable[[str], bool] | None = None, dewey: Column | None = None, path: str = "$", name: str | None = None) -> Column | None:
    """An array of the wanted nodes of a struct, array or plain column, labelled as its JSON would be; None if there are none.

    A member's ordinal is its place in the struct. Members of a null struct and elements of a null array
    are no nodes, as in JSON that keeps nulls.
    """
    dewey = F.array().cast("array<int>") if dewey is None else dewey
    parts = []
    if keep is None or keep(path, name):
        of = OBJECT if isinstance(kind, T.StructType) else ARRAY if isinstance(kind, T.ArrayType) else BOOLEAN if isinstance(kind, T.BooleanType) else NUMBER if isinstance(kind, T.NumericType) else TEXT
        text = F.lit(None).cast("string") if of in (OBJECT, ARRAY) else value.cast("string")
        own = F.struct(dewey.alias("dewey"), F.lit(path).alias("schema_path"), F.lit(name).cast("string").alias("name"), F.when(value.isNull(), NULL).otherwise(of).alias("node_kind"), text.alias("value"))
        parts.append(F.array(own.cast(NODE)))
    if enter is None or enter(path):
        inner = None
        if isinstance(kind, T.StructType):
            below = [typed_nodes(value[f.name], f.dataType, keep, enter, F.concat(dewey, F.array(F.lit(i))), _container(path, f.name), f.name) for i, f in enumerate(kind.fields)]
            below = [x for x in below if x is not None]
            inner = F.concat(*below) if below else None
        elif isinstance(kind, T.ArrayType) and typed_nodes(value, kind.elementType, keep, enter, dewey, path + "[]") is not None:
            inner = F.flatten(F.transform(value, lambda x, i: typed_nodes(x, kind.elementType, keep, enter, F.concat(dewey, F.array(i)), path + "[]")))
        if inner is not None:
            parts.append(F.when(value.isNotNull(), inner).otherwise(F.array().cast(NODES)))
    return None if not parts else parts[0] if len(parts) == 1 else F.concat(*parts)


def record_nodes(df: DataFrame, column: str, ids: Sequence[str], rename: dict[str, str] | None = None, keep: Keep | None = None, enter: Callable[[str], bool] | None = None) -> DataFrame:
    """ids and ``nodes``, one row a record: its wanted nodes as an array, in order.

    Records that can't be read, are null or empty have no row. ``keep`` (schema path, name) tells the
    nodes that are wanted, ``enter`` (schema path) the objects and lists that can hold any.
    """
    rename = rename or {}
    names = [F.col(f"`{c}`").alias(rename.get(c, c)) for c in ids]
    kind = df.schema[column].dataType
    if _typed(kind):
        value = F.col(f"`{column}`")
        found = typed_nodes(value, kind, keep, enter)
        return df.where(value.isNotNull()).select(*names, (F.array().cast(NODES) if found is None else found).alias("nodes"))
    source = df.select(*[F.col(f"`{c}`").alias(f"id{i}") for i, c in enumerate(ids)], as_json(df, column).alias("doc"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("nodes", NODES)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, kinds, labels = len(ids), arrow_schema(schema), Labels(keep, enter)
        node = kinds.field(width).type.value_type
        for batch in batches:
            begin, rows, size, found = 0, [], [0], []

            def flush(batch=batch):
                nonlocal rows, size, found
                take = pa.array(rows, pa.int64())
                fields = [pa.array([x[k] for x in found], node.field(k).type) for k in range(len(NODE.fields))]
                nodes = pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.StructArray.from_arrays(fields, fields=[node.field(k) for k in range(len(NODE.fields))]))
                out = pa.RecordBatch.from_arrays([*[batch.column(i).take(take).cast(kinds.field(i).type) for i in range(width)], nodes.cast(kinds.field(width).type)], schema=kinds)
                rows, size, found = [], [0], []
                return out

            for r, text in enumerate(batch.column(width).to_pylist()):
                ok, value = read_json(text)
                if ok:
                    found.extend(labels.nodes(value))
                    rows.append(r)
                    size.append(len(found))
                    if len(found) >= BATCH_NODES:
                        yield flush()
            if rows:
                yield flush()

    back = [F.col(f"id{i}").alias(rename.get(c, c)) for i, c in enumerate(ids)]
    return source.mapInArrow(run, schema).select(*back, "nodes")


#: Nodes sent on at once; one record's nodes stay together.
BATCH_NODES = 50_000


def shred(df: DataFrame, column: str, ids: Sequence[str], rename: dict[str, str] | None = None, keep: Keep | None = None, enter: Callable[[str], bool] | None = None) -> DataFrame:
    """The nodes of all records: ids, dewey, parent_dewey, schema_path, name, node_kind, value.

    A record that can't be read, is null or empty gives no node; an empty object or list gives its
    own node only. Repeated records give repeated nodes (take ``distinct`` on the ids first where they
    must count once). Column names of ``df`` can't clash: only ``ids`` are kept, under the names that
    ``rename`` gives them. ``keep`` and ``enter`` as for ``record_nodes``.
    """
    rename = rename or {}
    names = [rename.get(c, c) for c in ids]
    out = record_nodes(df, column, ids, rename, keep, enter).select(*[F.col(f"`{n}`") for n in names], F.inline("nodes"))
    return out.select(*[F.col(f"`{n}`") for n in names], "dewey", parent_of(F.col("dewey")).alias("parent_dewey"), "schema_path", "name", "node_kind", "value")


def parent_of(dewey: Column) -> Column:
    """The parent's label: the label without its last ordinal; the root has none."""
    return F.when(F.size(dewey) > 0, F.slice(dewey, 1, F.greatest(F.size(dewey) - 1, F.lit(0))))


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def ancestor(dewey: Column, depth: int) -> Column:
    """The label of the ancestor at that depth, by truncation; null for nodes above it."""
    return F.when(F.size(dewey) >= depth, F.slice(dewey, 1, depth))


#: One step of a schema path: a plain name, a quoted one, or a list's element.
STEP = re.compile(r'\.[^.\[\]"]+|\["(?:[^"\\]|\\.)*"\]|\[\]')


def depth_of(path: str) -> int:
    """How many ordinals lead to the nodes of a schema path; dots and brackets inside quoted names are no steps."""
    return len(STEP.findall(path))


def child_table(nodes: DataFrame, ids: Sequence[str], path: str, fields: dict[str, str]) -> DataFrame:
    """The nodes of one schema path as a flat table: a row per node, a column per direct member.

    ``fields`` maps a member's name to its column. The parent link is ``parent_dewey``; the place
    among the siblings is ``pos``, the last ordinal. One shuffle by (ids, row label).
    """
    deep = depth_of(path)
    members = {_container(path, m): c for m, c in fields.items()}
    own = nodes.where(F.col("schema_path").isin([path, *members]))
    own = own.withColumn("row", ancestor(F.col("dewey"), deep))
    picked = [F.max(F.when(F.col("schema_path") == p, F.col("value"))).alias(c) for p, c in members.items()]
    table = own.groupBy(*ids, "row").agg(*picked)
    return table.select(*ids, F.col("row").alias("dewey"), F.slice("row", 1, F.size("row") - 1).alias("parent_dewey"), F.element_at("row", -1).alias("pos"), *fields.values())


def schema_tables(nodes: DataFrame) -> DataFrame:
    """The tables the nodes fall into: one row per schema path with its parent path and counts."""
    parent = F.regexp_replace("schema_path", f"(?:{STEP.pattern})$", "")
    return nodes.groupBy("schema_path").agg(
        F.count("*").alias("n_nodes"), F.count_if(F.col("node_kind") == NULL).alias("n_null"), F.array_sort(F.collect_set("node_kind")).alias("node_kinds")
    ).withColumn("parent_path", F.when(F.col("schema_path") != "$", parent))
