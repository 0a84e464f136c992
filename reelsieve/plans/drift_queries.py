"""Queries over the drifting result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelsieve.operators.drift import schema_changes, unify
from reelsieve.session import table

RECORD_KEYS = (("video", "method"), ("video_name",))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_changes(table(spark, d, "result_records"), "raw_json", "run_key", "file_name", "written_at", RECORD_KEYS).distinct()


def _unified(spark: SparkSession, d: str, dataset: str) -> DataFrame:
    records = table(spark, d, "result_records").where(f"dataset = '{dataset}'").select("run_key", "file_name", "written_at", "raw_id", "raw_json")
    return unify(records, "raw_json", "run_key", "file_name", "written_at", RECORD_KEYS)


def p3_benchmark_table(spark: SparkSession, d: str) -> DataFrame:
    return _unified(spark, d, "benchmark_results")


def p3_removed_table(spark: SparkSession, d: str) -> DataFrame:
    return _unified(spark, d, "removed_videos_detailed")


# The same report where no two fields fit one: SQL has no similarity to choose by.
P3_SQL = """
WITH fl AS (SELECT run_key, file_name, row_number() OVER (PARTITION BY run_key ORDER BY min(written_at) NULLS FIRST, file_name) AS seq FROM result_records GROUP BY run_key, file_name),
r AS (SELECT run_key, file_name, raw_json::JSON AS j FROM result_records WHERE json_valid(raw_json) AND json_type(raw_json) = 'OBJECT'),
k AS (SELECT run_key, file_name, j, CASE WHEN json_type(j, '$.video') <> 'NULL' AND json_type(j, '$.method') <> 'NULL' THEN concat('1', j -> '$.video', j -> '$.method') WHEN json_type(j, '$.video_name') <> 'NULL' THEN concat('2', j -> '$.video_name') END AS rec FROM r),
c AS (SELECT run_key, file_name, rec, e.key AS field, CASE e.type WHEN 'VARCHAR' THEN 'text' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL ELSE 'number' END AS kind,
    CASE WHEN e.type IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN concat('n', (e.value ->> '$')::DOUBLE) WHEN e.type <> 'NULL' THEN concat('v', e.value) END AS value FROM k, json_each(k.j) e),
f AS (SELECT run_key, file_name, seq, field, list_sort(list(DISTINCT kind) FILTER (WHERE kind IS NOT NULL)) AS kinds FROM c JOIN fl USING (run_key, file_name) GROUP BY ALL),
t AS (SELECT *, lag(kinds) OVER (PARTITION BY run_key, field ORDER BY seq) AS before FROM f WHERE len(kinds) > 0),
came AS (SELECT f.run_key, f.seq, f.file_name, f.field FROM f ANTI JOIN f g ON g.run_key = f.run_key AND g.field = f.field AND g.seq = f.seq - 1 WHERE f.seq > 1),
went AS (SELECT f.run_key, f.seq + 1 AS seq, fl.file_name, f.field FROM f JOIN fl ON fl.run_key = f.run_key AND fl.seq = f.seq + 1 ANTI JOIN f g ON g.run_key = f.run_key AND g.field = f.field AND g.seq = f.seq + 1),
val AS (SELECT run_key, seq, rec, field, min(value) AS lo, max(value) AS hi FROM c JOIN fl USING (run_key, file_name) WHERE rec IS NOT NULL AND value IS NOT NULL GROUP BY ALL),
pr AS (SELECT n.run_key, n.seq, o.field AS old, n.field AS new, bool_and(o.lo = n.lo AND o.hi = n.hi) AS same FROM val n JOIN came USING (run_key, seq, field) JOIN val o ON o.run_key = n.run_key AND o.seq = n.seq - 1 AND o.rec = n.rec JOIN went w ON w.run_key = o.run_key AND w.seq = n.seq AND w.field = o.field GROUP BY ALL),
rn AS (SELECT run_key, seq, old, new FROM pr WHERE same)
SELECT run_key, file_name, 'renamed' AS change_kind, old AS field_name, new AS new_name FROM rn JOIN fl USING (run_key, seq)
UNION ALL SELECT run_key, file_name, 'removed', field, '' FROM went ANTI JOIN rn ON rn.run_key = went.run_key AND rn.seq = went.seq AND rn.old = went.field
UNION ALL SELECT run_key, file_name, 'added', field, '' FROM came ANTI JOIN rn ON rn.run_key = came.run_key AND rn.seq = came.seq AND rn.new = came.field
UNION ALL SELECT run_key, file_name, 'retyped', field, '' FROM t WHERE before IS NOT NULL AND before <> kinds
"""

QUERIES = {"p3_found": p3_found, "p3_benchmark_table": p3_benchmark_table, "p3_removed_table": p3_removed_table}
SQL = {"p3_found": P3_SQL}
