"""Queries of the general problems: nested records, drifting schemas, differences of copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelsieve.operators.diff import found_rows, table_diff
from reelsieve.session import table


def benchmark_keys() -> dict:
    video = F.regexp_replace(F.regexp_replace("video", r"^.*[/\\]", ""), r"\.mp4$", "")
    return {"video": video, "method": F.lower(F.regexp_replace("method", r"(?U)^\s+|\s+$", ""))}


def _benchmark_diff(spark: SparkSession, d: str) -> DataFrame:
    return table_diff(table(spark, d, "benchmark_results"), table(spark, d, "benchmark_results_copy"), benchmark_keys(), order_by="loaded_at")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return found_rows(_benchmark_diff(spark, d), ["video", "method"])


def p6_values(spark: SparkSession, d: str) -> DataFrame:
    """The differing values themselves, as text."""
    diff = _benchmark_diff(spark, d).where("side = 'both'")
    return diff.select("video", "method", F.inline("differences")).select("video", "method", "field_name")


_FIELDS = {
    "number": ["selected_count", "compression_ratio", "latency_s", "info_density", "vlm_cost_usd", "bare_effectiveness", "full_effectiveness"],
    "flag": [f"{m}_{x}" for m in ("bare", "full") for x in ("brand_match", "promo_detected", "cta_detected", "topic_match")],
    "text": ["bare_error", "full_error"],
}


def _diff_sql(values_only: bool) -> str:
    side = lambda t: f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY v, m ORDER BY loaded_at DESC) AS rn FROM (
        SELECT *, regexp_replace(regexp_replace(video, '^.*[/\\\\]', ''), '\\.mp4$', '') AS v, lower(trim(method, e' \\t\\n\\r')) AS m FROM {t})) WHERE rn = 1)"""  # noqa: E731
    num = lambda f, s: f"TRY_CAST(trim({s}.{f}::VARCHAR, e' \\t\\n\\r') AS DOUBLE)"
    text = lambda f, s: f"nullif(trim({s}.{f}, e' \\t\\n\\r'), '')"
    test = {f: f"(({num(f, 'a')} IS NULL) <> ({num(f, 'b')} IS NULL) OR coalesce(abs({num(f, 'a')} - {num(f, 'b')}) > 1e-6, false))" for f in _FIELDS["number"]}
    test |= {f: f"a.{f} IS DISTINCT FROM b.{f}" for f in _FIELDS["flag"]}
    test |= {f: f"{text(f, 'a')} IS DISTINCT FROM {text(f, 'b')}" for f in _FIELDS["text"]}
    j = f"SELECT a.v AS av, a.m AS am, b.v AS bv, b.m AS bm, {', '.join(f'{x} AS d_{f}' for f, x in test.items())} FROM {side('benchmark_results')} a FULL OUTER JOIN {side('benchmark_results_copy')} b ON a.v = b.v AND a.m = b.m"
    values = "\nUNION ALL ".join(f"SELECT av AS video, am AS method, '{f}' AS field_name, 'value' AS diff_kind FROM j WHERE av IS NOT NULL AND bv IS NOT NULL AND d_{f}" for f in test)
    if values_only:
        return f"WITH j AS ({j}) SELECT video, method, field_name FROM ({values})"
    return f"""WITH j AS ({j}) {values}
        UNION ALL SELECT av, am, '', 'only_left' FROM j WHERE bv IS NULL UNION ALL SELECT bv, bm, '', 'only_right' FROM j WHERE av IS NULL"""


QUERIES = {"p6_found": p6_found, "p6_values": p6_values}
SQL = {"p6_found": _diff_sql(False), "p6_values": _diff_sql(True)}
