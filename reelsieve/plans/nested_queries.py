"""Child rows of the nested extractions, by the Dewey labels of ``operators.nested``."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelsieve.operators.diff import number_in_text
from reelsieve.operators.nested import ancestor, child_table, depth_of, parent_of, record_nodes, schema_tables, shred
from reelsieve.session import table

#: Members of an object that give its time, the first that is there counts.
TIME_KEYS = ("start", "t", "timestamp", "at", "time", "ts", "start_s", "at_s", "time_s", "seconds", "start_time", "sec", "second")
#: Members of an entry in a list of methods that name the method.
NAME_KEYS = ("name", "method")
YES = ("true", "yes", "y", "t", "on", "1")


def _number(kind: Column, value: Column) -> Column:
    """A finite number of 0 or more, from a number or a text that writes one."""
    n = F.when(kind == "number", number_in_text(value)).when(kind == "text", number_in_text(F.regexp_replace(value, r"(?U)^\s+|\s+$", "")))
    return F.when((n >= 0) & (n < float("inf")), n)


def _yes(kind: Column, value: Column) -> Column:
    return F.when(kind == "boolean", value == "true").when(kind == "number", number_in_text(value) != 0).when(kind == "text", F.lower(F.trim(value)).isin(*YES))


def child_rows(nodes: DataFrame) -> DataFrame:
    """Distinct logo, promo and selection rows of nodes with record_table, record_id, method, and below.

    ``below`` is the schema path under the method's entry, ``base`` how many ordinals lead to the
    entry. One aggregation: a list element's members compete by the rank of their name, the first
    that is there counts, whether it gives a time or not.
    """
    logos, promo = ".extraction.brand.logo_timestamps", ".extraction.promotion.promo_present"
    below, kind, value = F.col("below"), F.col("node_kind"), F.col("value")
    times = [f"{p}.{k}" for p in (logos, f"{logos}[]") for k in TIME_KEYS]
    rank = F.element_at(F.create_map(*[x for i, k in enumerate(TIME_KEYS) for x in (F.lit(k), F.lit(i))]), F.col("name"))
    is_logo, is_selection = below.startswith(logos), F.col("name") == "selection_time_seconds"
    of = nodes.where(below.isin(promo, logos, f"{logos}[]", *times) | (is_selection & (F.col("record_table") == "video_results"))).select(
        "record_table", "record_id", "method",
        F.when(is_logo, "logo").when(below == promo, "promo").otherwise("selection").alias("child_kind"),
        F.when(below.startswith(f"{logos}[]"), F.get("dewey", F.col("base") + 3)).otherwise(0).cast("int").alias("pos"),
        F.when(below.isin(*times), rank).otherwise(-1).alias("rank"),
        F.when(below == promo, F.when(_yes(kind, value), 1.0)).otherwise(_number(kind, value)).alias("number"),
    )
    rows = of.where("number IS NOT NULL OR rank >= 0").groupBy("record_table", "record_id", "method", "child_kind", "pos").agg(F.min_by("number", "rank").alias("number"))
    return rows.where("number IS NOT NULL").drop("number")


METRIC = {"metric_id": "record_id", "method": "record_method"}


def _ablation(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "ablation_metrics").select("metric_id", "method", "extraction_data")
    return t.withColumn("record_table", F.lit("ablation_metrics"))


def _results(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "video_results").select("result_id", "result_doc").withColumn("record_table", F.lit("video_results"))


def ablation_nodes(spark: SparkSession, d: str, keep=None, enter=None) -> DataFrame:
    return shred(_ablation(spark, d), "extraction_data", ["record_table", "metric_id", "method"], METRIC, keep, enter)


def video_nodes(spark: SparkSession, d: str) -> DataFrame:
    return shred(_results(spark, d), "result_doc", ["record_table", "result_id"], {"result_id": "record_id"})


#: A method's entry in a result document and what lies below it: a member of an object, or an element of a list.
ENTRY = r'^\$\.methods(?:\.([^.\[\]"]+)|\["((?:[^"\\]|\\.)*)"\]|(\[\]))(.*)$'
LOGO_OR_PROMO = r"^\.extraction\.(brand\.logo_timestamps|promotion\.promo_present)"


def of_a_method(path: str, name: str | None) -> bool:
    """Nodes of a result document that child rows are made of, or that name a method of a list."""
    m = re.match(ENTRY, path)
    return bool(m) and (name == "selection_time_seconds" or m[4] in [f".{k}" for k in NAME_KEYS] or bool(re.match(LOGO_OR_PROMO, m[4])))


def in_methods(path: str) -> bool:
    return path.startswith("$.methods")


def of_an_extraction(path: str, name: str | None) -> bool:
    return bool(re.match(LOGO_OR_PROMO, ".extraction" + path[1:]))


def on_the_way(path: str) -> bool:
    """Objects and lists of a typed extraction that hold such nodes."""
    return path in ("$", "$.brand", "$.promotion") or path.startswith("$.brand.logo_timestamps")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Child rows of both tables. One shuffle: the last aggregation, in which repeated rows count once.

    The typed extractions are labelled in the JVM; of a result document only the wanted nodes leave the
    walk, one array a record, so a list's entry finds the name among its own record's nodes.
    """
    a = ablation_nodes(spark, d, of_an_extraction, on_the_way).select("record_table", "record_id", F.col("record_method").alias("method"), "dewey", "name", "node_kind", "value", F.concat(F.lit(".extraction"), F.substr("schema_path", F.lit(2))).alias("below"), F.lit(-1).alias("base"))
    # methods as an object: the member's name is the method; as a list: the entry's name or method
    r = record_nodes(_results(spark, d), "result_doc", ["record_table", "result_id"], {"result_id": "record_id"}, of_a_method, in_methods)
    order = lambda n: F.array_position(F.array(*map(F.lit, NAME_KEYS)), n)
    naming = F.filter("nodes", lambda n: n["schema_path"].isin(*[f"$.methods[].{k}" for k in NAME_KEYS]) & (n["node_kind"] == "text"))
    names = F.transform(naming, lambda n: F.struct(ancestor(n["dewey"], 2).alias("entry"), order(n["name"]).alias("o"), n["value"].alias("v")))
    nodes = r.withColumn("names", F.array_sort(names)).select("record_table", "record_id", "names", F.inline("nodes"))
    part = lambda i: F.regexp_extract("schema_path", ENTRY, i)
    keyed = F.when(part(1) != "", part(1)).when(part(3) == "", part(2))
    own = ancestor(F.col("dewey"), 2)
    named = F.get(F.filter("names", lambda n: n["entry"] == own), F.lit(0))["v"]
    wanted = F.col("below").rlike(LOGO_OR_PROMO) | F.col("below").endswith(".selection_time_seconds")
    v = nodes.select("record_table", "record_id", F.coalesce(keyed, named).alias("method"), "dewey", "name", "node_kind", "value", part(4).alias("below"), F.lit(2).alias("base"))
    rows = child_rows(a.unionByName(v.where(wanted & F.col("method").isNotNull())))
    return rows.select("record_table", F.col("record_id").cast("bigint").alias("record_id"), "method", "child_kind", "pos")


P2_STEPS_SQL = """
SELECT DISTINCT metric_id, concat('10.1.', i - 1) AS dewey, '10.1' AS parent_dewey, (i - 1)::INT AS pos, s[i].step_no::VARCHAR AS step_no, s[i].caption AS caption, round(s[i].at_s, 6) AS at_s
FROM (SELECT metric_id, extraction_data.demo_details.demo_steps AS s FROM ablation_metrics), LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i)
"""


def p2_demo_steps(spark: SparkSession, d: str) -> DataFrame:
    """The steps of the demonstrations as a flat table: label, parent's label, place, and the step's members."""
    path = "$.demo_details.demo_steps[]"
    inside = lambda p: path.startswith(p)
    t = _ablation(spark, d).dropDuplicates(["metric_id"])
    nodes = shred(t, "extraction_data", ["metric_id"], keep=lambda p, _: p == path or p.startswith(path + "."), enter=inside)
    steps = child_table(nodes, ["metric_id"], path, {"step_no": "step_no", "caption": "caption", "at_s": "at_s"})
    label = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ".").alias(c)
    return steps.select("metric_id", label("dewey"), label("parent_dewey"), F.col("pos").cast("int").alias("pos"), "step_no", "caption", F.round(F.col("at_s").cast("double"), 6).alias("at_s"))


def p2_method_table(spark: SparkSession, d: str) -> DataFrame:
    """The methods of the result documents as a flat table, with the label of the record they belong to.

    ``final_frames`` and the times are read as they are written, in whatever type.
    """
    members = ("final_frames", "selection_time_seconds", "extraction_time_seconds")

    def keep(path: str, name: str | None) -> bool:
        m = re.match(ENTRY, path)
        return bool(m) and (m[4] == "" or m[4] in [f".{k}" for k in members])

    nodes = shred(_results(spark, d).distinct(), "result_doc", ["result_id"], keep=keep, enter=lambda p: p == "$" or (in_methods(p) and depth_of(p) <= 2))
    of = nodes.withColumn("entry", ancestor(F.col("dewey"), 2))
    text = lambda m: F.max(F.when((F.col("name") == m) & (F.size("dewey") == 3), F.col("value"))).alias(m)
    own = F.size("dewey") == 2
    rows = of.groupBy("result_id", "entry").agg(F.max(F.when(own, F.col("name"))).alias("method"), F.max(F.when(own, F.col("node_kind"))).alias("node_kind"), *[text(m) for m in members])
    label = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ".")
    return rows.select("result_id", label(F.col("entry")).alias("dewey"), label(parent_of(F.col("entry"))).alias("parent_dewey"), "method", "node_kind", *members)


def p2_schema_tables(spark: SparkSession, d: str) -> DataFrame:
    """The flat tables that all nodes of both record tables fall into."""
    both = ablation_nodes(spark, d).drop("record_method").unionByName(video_nodes(spark, d))
    return schema_tables(both).select("schema_path", "parent_path", "n_nodes", "n_null", F.array_join("node_kinds", ",").alias("node_kinds"))


#: Documents as JSON; a JSON text inside JSON counts as that document.
_DOCS = "v AS (SELECT result_id, CASE WHEN json_type(j) = 'VARCHAR' THEN (CASE WHEN json_valid(j ->> '$') THEN (j ->> '$')::JSON END) ELSE j END AS j FROM (SELECT result_id, result_doc::JSON AS j FROM video_results WHERE json_valid(result_doc)))"
P2_TABLES_SQL = f"""
WITH {_DOCS}, b AS (SELECT j FROM v WHERE j IS NOT NULL UNION ALL SELECT to_json(extraction_data) FROM ablation_metrics WHERE extraction_data IS NOT NULL),
t AS (SELECT regexp_replace(regexp_replace(fullkey, '\\[\\d+\\]', '[]', 'g'), '\\."([^"]*)"', '["\\1"]', 'g') AS schema_path, CASE type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'text' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind FROM b, json_tree(b.j))
SELECT schema_path, CASE WHEN schema_path <> '$' THEN regexp_replace(schema_path, '(?:\\.[^.\\[\\]"]+|\\["[^"]*"\\]|\\[\\])$', '') END AS parent_path, count(*) AS n_nodes, count_if(kind = 'null')::BIGINT AS n_null, string_agg(DISTINCT kind, ',' ORDER BY kind) AS node_kinds FROM t GROUP BY 1
"""
_TIMES = ", ".join(f"'{k}'" for k in TIME_KEYS)


def _number_sql(x: str) -> str:
    """A JSON value as a number of 0 or more, from a number or a text that writes one."""
    text = f"trim({x} ->> '$', e' \\t\\n\\r\u00a0')"
    return f"(CASE WHEN json_type({x}) IN ('UBIGINT', 'BIGINT', 'DOUBLE') OR (json_type({x}) = 'VARCHAR' AND regexp_full_match({text}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')) THEN TRY_CAST({text} AS DOUBLE) END)"


P2_SQL = f"""
WITH {_DOCS}, m AS (SELECT DISTINCT result_id, CASE WHEN json_type(v.j, '$.methods') = 'OBJECT' THEN e.key WHEN json_type(e.value, '$.name') = 'VARCHAR' THEN e.value ->> '$.name' WHEN json_type(e.value, '$.method') = 'VARCHAR' THEN e.value ->> '$.method' END AS method, e.value::JSON AS x
    FROM v, json_each(v.j, '$.methods') e WHERE v.j IS NOT NULL AND json_type(v.j, '$.methods') IN ('OBJECT', 'ARRAY')),
l0 AS (SELECT result_id, method, x -> '$.extraction.brand.logo_timestamps' AS l FROM m),
l1 AS (SELECT result_id, method, e.key::INT AS pos, e.value::JSON AS y FROM l0, json_each(l0.l) e WHERE json_type(l0.l) = 'ARRAY' UNION ALL SELECT result_id, method, 0, l FROM l0 WHERE json_type(l) <> 'ARRAY'),
l2 AS (SELECT result_id, method, pos, CASE WHEN json_type(y) = 'OBJECT' THEN y -> list_filter([{_TIMES}], lambda k: list_contains(json_keys(y), k))[1] ELSE y END AS y FROM l1),
a AS (SELECT metric_id, method, extraction_data.brand.logo_timestamps AS l, extraction_data.promotion.promo_present AS p FROM ablation_metrics),
found AS (SELECT 'video_results' AS record_table, result_id AS record_id, method, 'logo' AS child_kind, pos FROM l2 WHERE {_number_sql('y')} >= 0
    UNION ALL SELECT 'video_results', result_id, method, 'promo', 0 FROM (SELECT *, x -> '$.extraction.promotion.promo_present' AS p FROM m) WHERE (json_type(p) = 'BOOLEAN' AND p::VARCHAR = 'true') OR (json_type(p) IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND (p ->> '$')::DOUBLE <> 0) OR (json_type(p) = 'VARCHAR' AND lower(trim(p ->> '$')) IN ({", ".join(f"'{y}'" for y in YES)}))
    UNION ALL SELECT 'video_results', result_id, method, 'selection', 0 FROM m, json_tree(m.x) t WHERE t.key = 'selection_time_seconds' AND {_number_sql('t.value::JSON')} >= 0
    UNION ALL SELECT 'ablation_metrics', metric_id, method, 'logo', (i - 1)::INT FROM a, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i) WHERE isfinite(l[i]) AND l[i] >= 0
    UNION ALL SELECT 'ablation_metrics', metric_id, method, 'promo', 0 FROM a WHERE p)
SELECT DISTINCT record_table, record_id, method, child_kind, pos FROM found WHERE method IS NOT NULL OR record_table = 'ablation_metrics'
"""


_KIND = "CASE json_type(x) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'text' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END"
P2_METHODS_SQL = f"""
WITH {_DOCS}, m AS (SELECT DISTINCT result_id, list_position(json_keys(v.j), 'methods') - 1 AS a, CASE WHEN json_type(v.j, '$.methods') = 'OBJECT' THEN list_position(json_keys(v.j, '$.methods'), e.key) - 1 ELSE e.key::BIGINT END AS b, CASE WHEN json_type(v.j, '$.methods') = 'OBJECT' THEN e.key END AS method, e.value::JSON AS x
    FROM v, json_each(v.j, '$.methods') e WHERE v.j IS NOT NULL AND json_type(v.j, '$.methods') IN ('OBJECT', 'ARRAY'))
SELECT result_id, concat(a, '.', b) AS dewey, a::VARCHAR AS parent_dewey, method, {_KIND} AS node_kind, {", ".join(f"CASE WHEN json_type(x, '$.{n}') NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN x ->> '$.{n}' END AS {n}" for n in ("final_frames", "selection_time_seconds", "extraction_time_seconds"))} FROM m
"""


QUERIES = {"p2_found": p2_found, "p2_schema_tables": p2_schema_tables, "p2_demo_steps": p2_demo_steps, "p2_method_table": p2_method_table}
SQL = {"p2_demo_steps": P2_STEPS_SQL, "p2_schema_tables": P2_TABLES_SQL, "p2_found": P2_SQL, "p2_method_table": P2_METHODS_SQL}
