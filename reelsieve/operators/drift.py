"""Schemas that drift between files: correspondences by similarity flooding, one table, a change report.

Each file's top-level fields, the types of their values and the members of nested values make up its
schema graph. For two consecutive files of a run, the pairs of a gone and a new field are the nodes of
a propagation graph; their initial similarity comes from names and from the values in the records that
both files hold, and spreads over shared types and members until it converges. Only the schemas go
through it, so its size is bounded by the widths of two files, never by their rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelsieve.operators.components import connected_components
from reelsieve.operators.nested import arrow_schema, kind_of
from reelsieve.session import spread, written

CELL = T.StructType(
    [
        T.StructField("record_key", T.StringType()),
        T.StructField("field_name", T.StringType()),
        T.StructField("value_kind", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("members", T.ArrayType(T.StringType())),
        T.StructField("record_hash", T.StringType()),
    ]
)


def canonical(value) -> str:
    """Equal values have equal texts: whole and other numbers are one type, members are sorted."""

    if isinstance(value, (str, bool)):
        return json.dumps(value, ensure_ascii=True)

    def plain(v):
        if isinstance(v, float) and v.is_integer() and abs(v) < 2**63:
            return int(v)
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else v

    return json.dumps(plain(value), sort_keys=True, ensure_ascii=True)


def cells(df: DataFrame, json_column: str, carry: Sequence[str], record_keys: Sequence[Sequence[str]]) -> DataFrame:
    """One row per top-level field of each readable record: carry, record_key, field, kind, value.

    A record is readable if it is a JSON object. Its key is made of the first of ``record_keys`` whose
    fields are all there and not null, else null (it then takes no part in the comparison of records).
    """
    source = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)], F.col(f"`{json_column}`").cast("string").alias("doc"))
    schema = T.StructType([*source.schema.fields[:-1], *CELL.fields])
    wanted = [tuple(k) for k in record_keys]

    def explode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = arrow_schema(schema)
        for batch in batches:
            at: list[int] = []
            out: list[tuple] = []
            for r, text in enumerate(batch.column(len(carry)).to_pylist()):
                try:
                    record = json.loads(text) if text else None
                except (ValueError, RecursionError):
                    continue
                if not isinstance(record, dict):
                    continue
                key = next((canonical([k, [record[x] for x in k]]) for k in wanted if all(record.get(x) is not None for x in k)), None)
                # a record without a key is known by its contents
                whole = hashlib.md5(canonical(record).encode()).hexdigest() if key is None else None
                for name, v in record.items():
                    members = sorted(v) if isinstance(v, dict) else None
                    at.append(r)
                    out.append((key, name, kind_of(v), None if v is None else canonical(v), members, whole))
            if at:
                take = pa.array(at, pa.int64())
                cols = [batch.column(i).take(take).cast(kinds.field(i).type) for i in range(len(carry))]
                cols += [pa.array([x[k] for x in out], kinds.field(len(carry) + k).type) for k in range(len(CELL.fields))]
                yield pa.RecordBatch.from_arrays(cols, schema=kinds)

    out = source.mapInArrow(explode, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], *[f.name for f in CELL.fields])


def name_similarity(a: str, b: str) -> float:
    """Dice coefficient of the letter pairs of both names, without case and separators."""
    pairs = [{x[i : i + 2] for i in range(len(x) - 1)} or {x} for x in ("".join(ch for ch in s.lower() if ch.isalnum()) for s in (a, b))]
    return 2 * len(pairs[0] & pairs[1]) / max(1, len(pairs[0]) + len(pairs[1]))


def flood(old: dict[str, dict], new: dict[str, dict], seed: dict[tuple[str, str], float], rounds: int = 100, least: float = 1e-4) -> dict[tuple[str, str], float]:
    """Similarity of each pair (old field, new field) after propagation to the fixed point.

    ``old`` and ``new``: field -> {"kinds": set, "members": set}. Graph: file --field--> field
    --type--> kind, field --member--> member. A pair of nodes passes its similarity on to the pairs
    that both reach over equally labelled edges, shared out among them, in both directions.
    """
    graph = lambda s: [("/", "field", f"f:{f}") for f in s] + [(f"f:{f}", "type", f"k:{k}") for f, x in s.items() for k in x["kinds"]] + [(f"f:{f}", "member", f"m:{m}") for f, x in s.items() for m in x["members"]]
    start: dict[tuple[str, str], float] = {}
    links: dict[tuple[tuple[str, str], str], list[tuple[str, str]]] = {}
    by: dict[str, list[tuple[str, str]]] = {}
    for p, label, q in graph(new):
        by.setdefault(label, []).append((p, q))
    for p, label, q in graph(old):
        for p2, q2 in by.get(label, []):
            a, b = (p, p2), (q, q2)
            links.setdefault((a, label), []).append(b)
            links.setdefault((b, label + "'"), []).append(a)
            for n in (a, b):
                if n not in start:
                    x, y = n[0][2:], n[1][2:]
                    start[n] = seed.get((x, y), 0.0) if n[0][:2] == "f:" else 1.0 if n[0] == n[1] == "/" else float(x == y) if n[0][:2] == "k:" else name_similarity(x, y)
    if not start:
        return {}
    index = {n: i for i, n in enumerate(start)}
    src, dst, w = [], [], []
    for (a, _), to in links.items():
        for b in to:
            src.append(index[a]), dst.append(index[b]), w.append(1 / len(to))
    s0 = np.array(list(start.values()))
    s, src, dst, w = s0.copy(), np.array(src), np.array(dst), np.array(w)
    for _ in range(rounds):
        n = s0 + s
        n = n + np.bincount(dst, weights=w * n[src], minlength=len(s0))
        n /= max(n.max(), 1e-12)
        if np.abs(n - s).max() < least:
            s = n
            break
        s = n
    return {(a[2:], b[2:]): float(s[i]) for (a, b), i in index.items() if a[:2] == "f:"}


def choose(scores: dict[tuple[str, str], float], allowed: set[tuple[str, str]]) -> list[tuple[str, str]]:
    """A consistent set of correspondences: best first, each field once; ties by name."""
    out, used_old, used_new = [], set(), set()
    for a, b in sorted(allowed, key=lambda p: (-scores.get(p, 0.0), p)):
        if a not in used_old and b not in used_new:
            out.append((a, b))
            used_old.add(a)
            used_new.add(b)
    return out


def file_order(df: DataFrame, run: str, file: str, at: str) -> DataFrame:
    """(run_key, file_name, seq): the place of each file in its run, from 1; one row a file."""
    files = df.groupBy(F.col(run).alias("run_key"), F.col(file).alias("file_name")).agg(F.min(at).alias("file_at"))
    order = Window.partitionBy("run_key").orderBy(F.asc_nulls_first("file_at"), "file_name")
    return files.withColumn("seq", F.row_number().over(order)).drop("file_at")


class Parsed:
    """The records' cells, parsed once and written to the shared folder, and the order of the files.

    Everything else reads these two tables, pruned to the columns it needs.
    """

    def __init__(self, df: DataFrame, json_column: str, run: str, file: str, at: str, record_keys: Sequence[Sequence[str]]):
        base = df.select(F.col(run).alias("run_key"), F.col(file).alias("file_name"), F.col(at).alias("file_at"), F.col(json_column).alias("json"))
        # files without any readable record still take their place in the run
        self.order = written(file_order(base, "run_key", "file_name", "file_at"), "files")
        self.cells = written(cells(base, "json", ["run_key", "file_name"], record_keys), "cells")


#: Kinds of values that aren't null; a set of them is a number with their bits.
KINDS = ("text", "number", "boolean", "array", "object")


def kinds_of(kind: Column) -> Column:
    """The kinds of a group's values as bits: a number, so that it is aggregated by hash."""
    bit = F.lit(0)
    for i, k in enumerate(KINDS):
        bit = F.when(kind == k, F.lit(1 << i)).otherwise(bit)
    return F.bit_or(bit)


CHANGE = "run_key string, file_name string, change_kind string, field_name string, new_name string"


def _moves(rows: list[tuple]) -> list[tuple]:
    """The changes of one file: its gone and new fields, and the evidence for pairs of them."""
    sides: tuple[dict, dict] = ({}, {})
    counts: dict[tuple[str, str], tuple[int, int]] = {}
    run_key = file_name = None
    for run, _, file, field, gone, kinds, members, other, n_both, n_same in rows:
        if other is None:
            run_key, file_name = run, file
            sides[0 if gone else 1][field] = {"kinds": {k for i, k in enumerate(KINDS) if (kinds or 0) >> i & 1}, "members": set(members or ())}
        else:
            counts[field, other] = (n_both, n_same)
    allowed = {k for k, (n, same) in counts.items() if n == same and n > 0}
    picked = []
    if allowed:
        seed = {(a, b): 0.5 * name_similarity(a, b) + (0.5 * counts[a, b][1] / counts[a, b][0] if (a, b) in counts else 0.0) for a in sides[0] for b in sides[1]}
        picked = choose(flood(*sides, seed), allowed)
    old, new = {a for a, _ in picked}, {b for _, b in picked}
    out = [(run_key, file_name, "renamed", a, b) for a, b in picked]
    out += [(run_key, file_name, "removed", f, "") for f in sides[0] if f not in old]
    return out + [(run_key, file_name, "added", f, "") for f in sides[1] if f not in new]


def _match(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Changes of each (run, file); its rows follow each other."""
    held: list[tuple] = []
    names = [x.split()[0] for x in CHANGE.split(", ")]

    def send(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.string()) for k in range(len(names))], names=names)

    for batch in batches:
        found: list[tuple] = []
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if held and held[-1][:2] != row[:2]:
                found += _moves(held)
                held = []
            held.append(row)
        if found:
            yield send(found)
    if held:
        yield send(_moves(held))


def changes_of(parsed: Parsed) -> DataFrame:
    """run, file, change_kind, field_name, new_name: each file against the one before it in its run.

    A field is in a file if any readable record holds it, even with null. ``renamed``: gone, and a new
    field has the same value in every record of both files where neither is null, and at least one
    such record exists; where several would fit, similarity flooding chooses. ``removed``, ``added``:
    gone or new otherwise. ``retyped``: the kinds of its non-null values are others than in the latest
    earlier file of the run with non-null values of it. Repeated and late lines change nothing; files
    without a readable record hold no field; an empty table gives no row. Only the first aggregation and
    the evidence read all cells; what is between is one row a file and field.
    """
    real = F.col("value_kind") != "null"
    order, cell = parsed.order, parsed.cells
    key = ["run_key", "file_name", "field_name"]
    fields = cell.groupBy(*key).agg(kinds_of(F.col("value_kind")).alias("kinds"))
    members = cell.where("members IS NOT NULL").groupBy(*key).agg(F.array_distinct(F.flatten(F.collect_set("members"))).alias("members"))
    fields = written(fields.join(order, ["run_key", "file_name"]).join(members, key, "left"), "fields")
    by_field = Window.partitionBy("run_key", "field_name").orderBy("seq")
    typed = fields.where("kinds <> 0").withColumn("before", F.lag("kinds").over(by_field))
    retyped = typed.where("before IS NOT NULL AND before <> kinds").select("run_key", "file_name", F.lit("retyped").alias("change_kind"), "field_name", F.lit("").alias("new_name"))
    # a field is new where the file before doesn't hold it, and gone in the file after the last that does
    near = fields.withColumns({"past": F.lag("seq").over(by_field), "next": F.lead("seq").over(by_field)})
    came = near.where("seq > 1 AND (past IS NULL OR past < seq - 1)").select("run_key", "seq", "field_name", F.lit(False).alias("gone"), "kinds", "members")
    went = near.where("next IS NULL OR next > seq + 1").select("run_key", (F.col("seq") + 1).alias("seq"), "field_name", F.lit(True).alias("gone"), "kinds", "members")
    moved = written(came.unionByName(went).join(order, ["run_key", "seq"]).select("run_key", "seq", "file_name", "field_name", "gone", "kinds", "members"), "moved")

    # values of gone and new fields in the records that both files hold: a gone one's are in the file before
    sought = moved.select("run_key", "seq", "field_name", "gone", F.when(F.col("gone"), F.col("seq") - 1).otherwise(F.col("seq")).alias("in_file"))
    sought = sought.join(order.select("run_key", F.col("seq").alias("in_file"), "file_name"), ["run_key", "in_file"]).drop("in_file")
    kept = cell.where(F.col("record_key").isNotNull() & real).select("run_key", "file_name", "record_key", "field_name", "value")
    # a record repeated within a file counts once: with its smallest and largest value of the field
    once = kept.join(sought, ["run_key", "file_name", "field_name"]).groupBy("run_key", "seq", "record_key", "gone", "field_name").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    sides = once.groupBy("run_key", "seq", "record_key").agg(*[F.collect_list(F.when(F.col("gone") == g, F.struct("field_name", "low", "high"))).alias(n) for g, n in ((True, "olds"), (False, "news"))])
    # one record's gone fields beside its new ones: both are bounded by the width of a record
    pairs = sides.where("size(olds) > 0 AND size(news) > 0").select("run_key", "seq", F.explode("olds").alias("o"), "news").select("run_key", "seq", "o", F.explode("news").alias("n"))
    same = (F.col("o.low") == F.col("n.low")) & (F.col("o.high") == F.col("n.high"))
    evidence = pairs.groupBy("run_key", "seq", F.col("o.field_name").alias("old_name"), F.col("n.field_name").alias("new_name")).agg(F.count("*").alias("n_both"), F.count_if(same).alias("n_same"))

    none = lambda kind: F.lit(None).cast(kind)
    left = moved.select("*", none("string").alias("other"), F.lit(0).cast("bigint").alias("n_both"), F.lit(0).cast("bigint").alias("n_same"))
    right = evidence.select("run_key", "seq", none("string").alias("file_name"), F.col("old_name").alias("field_name"), none("boolean").alias("gone"), none("int").alias("kinds"), none("array<string>").alias("members"), F.col("new_name").alias("other"), "n_both", "n_same")
    return spread(left.unionByName(right), "run_key", "seq").mapInArrow(_match, CHANGE).unionByName(retyped)


def schema_changes(df: DataFrame, json_column: str, run: str, file: str, at: str, record_keys: Sequence[Sequence[str]]) -> DataFrame:
    """The changes of ``changes_of``, of records that are parsed for it."""
    return changes_of(Parsed(df, json_column, run, file, at, record_keys))


def kind_to_sql(kinds: Column) -> Column:
    """The one type that holds all kinds: a number or boolean if all are, else text."""
    only = lambda k: kinds == 1 << KINDS.index(k)
    return F.when(only("number"), "double").when(only("boolean"), "boolean").otherwise("string")


def field_classes(changes: DataFrame, names: DataFrame) -> DataFrame:
    """(name, canonical): the names linked by renamings over all runs, with the most frequent as canonical.

    Renamings link names; linked names form a class (connected components of a graph of names, whose
    size is bounded by the number of distinct names). ``names``: (field_name, n).
    """
    links = changes.where("change_kind = 'renamed'").select(F.col("field_name").alias("a"), F.col("new_name").alias("b")).distinct()
    comp = connected_components(links, "a", "b")
    joined = names.join(comp, names["field_name"] == comp["node"], "left").select("field_name", "n", F.coalesce("component", "field_name").alias("component"))
    best = joined.groupBy("component").agg(F.max_by("field_name", F.struct("n", "field_name")).alias("canonical"))
    return joined.join(best, "component").select("field_name", "canonical")


def unified(parsed: Parsed, changes: DataFrame) -> DataFrame:
    """All records as one table: run_key, file_name, record_key, and a column for each class of renamed fields.

    A column's type holds every value of its class: double or boolean where all are, else text (then
    values of other kinds are their JSON). Of several fields of a class in one record the first
    non-null by name counts. The driver sees the distinct field names with their kinds, as they are the
    columns of the result, and no values.
    """
    cell, carry = parsed.cells, ["run_key", "file_name"]
    used = cell.groupBy("field_name").agg(F.count("*").alias("n"), kinds_of(F.col("value_kind")).alias("kinds"))
    used = written(used, "names")
    classes = field_classes(changes, used.select("field_name", "n"))
    schema = classes.join(used, "field_name").groupBy("canonical").agg(
        F.array_sort(F.collect_set("field_name")).alias("fields"), kind_to_sql(F.bit_or("kinds")).alias("sql")
    ).orderBy("canonical").collect()
    # the values of one record as a map, then one column per class
    # a record without a key is known by its contents; of a key's repeated values the least counts
    once = cell.where("value_kind <> 'null'").groupBy(*carry, "record_key", F.col("record_hash").alias("unkeyed"), "field_name").agg(F.min("value").alias("value"))
    record = once.groupBy(*carry, "record_key", "unkeyed").agg(F.map_from_entries(F.collect_list(F.struct("field_name", "value"))).alias("m"))
    out = []
    for r in schema:
        raw = F.coalesce(*[F.col("m")[f] for f in r["fields"]])
        plain = F.when(raw.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v")).otherwise(raw)
        out.append(plain.try_cast(r["sql"]).alias(r["canonical"]))
    return record.select(*carry, "record_key", *out)


def unify(df: DataFrame, json_column: str, run: str, file: str, at: str, record_keys: Sequence[Sequence[str]]) -> DataFrame:
    """The table of ``unified``, of records that are parsed once for it and its changes."""
    parsed = Parsed(df, json_column, run, file, at, record_keys)
    return unified(parsed, written(changes_of(parsed), "changes"))
