"""Top N of every group by statistics-guided skipping over files clustered by group.

The rows are written once, clustered by group and sorted within it by descending score; each row group's
footer carries the smallest and largest group, the largest and smallest score, and the number of rows.

1. Footers only. A row group that holds one group and at least N rows of it bounds that group's N-th
   score from below by its smallest score. The best of these bounds over all files is the group's
   threshold, an aggregate of one row a row group. Row groups of one group that are strictly below its
   threshold are never read, whole files of a hot group among them.
2. Rows. A task takes what is left of a file in descending largest score and skips what is strictly below
   the current N-th score of every group it holds. A group may lie in any number of files, so a group
   with millions of rows is read by many tasks, each of which returns at most N rows of it; a last
   ranking of these few rows gives the result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelsieve.operators.nested import arrow_schema
from reelsieve.session import cut, shared_table, spread

#: Rows of a row group; statistics are kept by row group.
ROW_GROUP_ROWS = 8192
ROW_GROUP_BYTES = 256 * 1024


def latest(df: DataFrame, key: str, at: str) -> DataFrame:
    """The row with the latest ``at`` of each key (null is earliest; of equal ones the largest row)."""
    rest = [c for c in df.columns if c != key]
    row = F.max(F.struct(F.col(at).alias("__at"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(rest)])).alias("r")
    return df.groupBy(key).agg(row).select(key, *[F.col(f"r.__{i}").alias(c) for i, c in enumerate(rest)])


def _open(path: str):
    """(file system, path) of a written file, whatever store the shared folder is in."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_clustered(df: DataFrame, group: Sequence[str], score: str, name: str = "topn") -> str:
    """Write the rows sorted by group, then descending score, range-partitioned by both.

    Range boundaries run through groups too, so a group with a third of all rows is spread over as
    many files as its size needs; no task gets a whole group.
    """
    spark = df.sparkSession
    path = shared_table(spark, name)
    (
        df.repartitionByRange(*[F.col(c) for c in group], F.desc(score))
        .sortWithinPartitions(*[F.col(c) for c in group], F.desc(score))
        .write.option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.block.row.count.limit", ROW_GROUP_ROWS)
        .option("parquet.page.row.count.limit", ROW_GROUP_ROWS)
        .parquet(path)
    )
    return path


def _statistics(meta, names: Sequence[str], r: int) -> list:
    """The statistics of some columns of a row group; None where the footer has none."""
    place = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
    found = [meta.row_group(r).column(place[n]).statistics for n in names]
    return [s if s is not None and s.has_min_max else None for s in found]


def footers(path: str, group: Sequence[str], score: str) -> list[dict]:
    """A row for each row group of a file: its number, its group where it holds one only, scores and rows, from the footer."""
    system, at = _open(path)
    out = []
    with system.open_input_file(at) as source:
        meta = pq.ParquetFile(source).metadata
        for r in range(meta.num_row_groups):
            *keys, s = _statistics(meta, [*group, score], r)
            one = all(k is not None and k.min == k.max for k in keys)
            out.append({"path": path, "number": r, "one": one, "n": meta.row_group(r).num_rows, "most": None if s is None else float(s.max), "least": None if s is None else float(s.min), "key": "\0".join(repr(k.min) for k in keys) if one else None})
    return out


def read_top(path: str, n: int, group: Sequence[str], score: str, ties: Sequence[str], counters: dict | None = None, only: Sequence[int] | None = None) -> pa.Table | None:
    """The file's top ``n`` rows of each group: row groups in descending largest score, with skipping.

    ``only``: the numbers of the row groups that can hold any. The footer tells the group of a row group
    that holds one; one in which several begin is read.
    """
    system, at = _open(path)
    with system.open_input_file(at) as source:
        file = pq.ParquetFile(source)
        meta = file.metadata
        plan = []
        for r in range(meta.num_row_groups) if only is None else only:
            *keys, s = _statistics(meta, [*group, score], r)
            one = tuple(k.min for k in keys) if all(k is not None and k.min == k.max for k in keys) else None
            plan.append((-s.max if s is not None else -np.inf, r, one))
        heaps: dict[tuple, list[float]] = {}
        kept: list[pa.Table] = []
        for most, r, one in sorted(plan, key=lambda x: x[:2]):
            if one is not None and len(h := heaps.get(one, ())) >= n and -most < h[0]:
                if counters is not None:
                    counters["skipped"] = counters.get("skipped", 0) + 1
                continue
            rows = file.read_row_group(r)
            if counters is not None:
                counters["read"] = counters.get("read", 0) + 1
            rows = _best(rows, n, group, score, ties)
            kept.append(rows)
            for row in rows.select([*group, score]).to_pylist():
                h = heaps.setdefault(tuple(row[g] for g in group), [])
                (heapq.heappush if len(h) < n else heapq.heappushpop)(h, row[score])
        return _best(pa.concat_tables(kept), n, group, score, ties) if kept else None


FOOTER = "path string, number int, one boolean, n bigint, most double, least double, key string"


def worth_reading(files: DataFrame, n: int, group: Sequence[str], score: str) -> DataFrame:
    """(path, numbers): the row groups of each file that can hold a row of some group's top ``n``."""

    schema = T.StructType.fromDDL(FOOTER)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = arrow_schema(schema)
        for batch in batches:
            if found := [row for p in batch.column(0).to_pylist() for row in footers(p, group, score)]:
                yield pa.RecordBatch.from_pylist(found, schema=kinds)

    every = cut(files.mapInArrow(run, FOOTER))
    bound = every.where(F.col("one") & (F.col("n") >= n) & F.col("least").isNotNull()).groupBy("key").agg(F.max("least").alias("bound"))
    left = every.join(bound, "key", "left").where(F.col("bound").isNull() | F.col("most").isNull() | (F.col("most") >= F.col("bound")))
    return left.groupBy("path").agg(F.sort_array(F.collect_list("number")).alias("numbers"))


def _best(t: pa.Table, n: int, group: Sequence[str], score: str, ties: Sequence[str]) -> pa.Table:
    """The first ``n`` rows of each group by descending score, then ties ascending, nulls last."""
    if not t.num_rows:
        return t
    order = pc.sort_indices(t, sort_keys=[*[(g, "ascending") for g in group], (score, "descending"), *[(c, "ascending") for c in ties]], null_placement="at_end")
    t = t.take(order)
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for g in group:
        codes = pc.dictionary_encode(t.column(g).combine_chunks(), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(t.num_rows), 0))
    return t.filter(pa.array(np.arange(t.num_rows) - first < n))


def top_n(df: DataFrame, n: int, group: Sequence[str], score: str, ties: Sequence[str]) -> DataFrame:
    """The ``n`` rows with the highest score of each group, by one fixed order among equals.

    Order: score descending, then ``ties`` ascending with nulls last. Rows whose group or score is
    null, or whose score is NaN, take no part; infinite scores do. Repeated rows count as often as
    they are there (reduce them first where they must count once). A group with fewer rows comes out
    whole; an empty table gives no row. All columns of ``df`` are kept, whatever their names.
    """
    spark = df.sparkSession
    wanted = F.col(f"`{score}`").isNotNull()
    if isinstance(df.schema[score].dataType, (T.DoubleType, T.FloatType)):
        wanted = wanted & ~F.isnan(f"`{score}`")
    for g in group:
        wanted = wanted & F.col(f"`{g}`").isNotNull()
    # neutral names inside: none can clash with another, or hold a character Parquet won't take
    inner = {c: f"c{i}" for i, c in enumerate(df.columns)}
    plain = df.where(wanted).select(*[F.col(f"`{c}`").alias(x) for c, x in inner.items()])
    g, s, t = [inner[c] for c in group], inner[score], [inner[c] for c in ties]
    path = write_clustered(plain, g, s)
    schema = spark.read.parquet(path).schema
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")
    left = spread(worth_reading(spread(files, "path"), n, g, s), "path")

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = arrow_schema(schema)
        for batch in batches:
            for p, numbers in zip(*[c.to_pylist() for c in batch.columns]):
                top = read_top(p, n, g, s, t, only=numbers)
                if top is not None and top.num_rows:
                    yield from top.cast(kinds).to_batches()

    some = left.mapInArrow(scan, schema)
    order = Window.partitionBy(*g).orderBy(F.desc(s), *[F.asc_nulls_last(c) for c in t])
    best = some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    back = {x: c for c, x in inner.items()}
    return best.select(*[F.col(x).alias(back[x]) for x in schema.names], *([F.col("rank")] if "rank" not in df.columns else []))
