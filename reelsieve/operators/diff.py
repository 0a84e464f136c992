"""Differences between two copies of a table: null-safe full outer join, field by field."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOLERANCE = 1e-6


def latest_per_key(df: DataFrame, keys: Sequence[str], order_by: str) -> DataFrame:
    """The row with the largest ``order_by`` of each key; of rows equal in it, the largest by its values.

    An aggregation (it combines before the shuffle), not a window, so that one key with very many
    states is reduced where it is read. A null ``order_by`` is older than any other.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.max(F.struct(F.col(order_by).alias("__at"), F.struct(*[F.col(c) for c in rest]).alias("__row")))
    one = df.groupBy(*keys).agg(best.alias("__best"))
    return one.select(*keys, *[F.col(f"__best.__row.`{c}`").alias(c) for c in rest])


def normal_text(c: Column) -> Column:
    """Trimmed of any white space; an empty text is null."""
    trimmed = F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", "")
    return F.when(trimmed != "", trimmed)


def _is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def number_in_text(c: Column) -> Column:
    """The number that a text writes, or null; Java's suffixes (``5d``) and words (``NaN``) are no numbers."""
    return F.when(c.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), c.try_cast("double"))


def differs(left: Column, lt: T.DataType, right: Column, rt: T.DataType, tolerance: float = TOLERANCE) -> Column:
    """Whether two values differ once they are brought into one form; never null.

    Null differs from non-null only; an empty or blank text is null. Numbers, and texts that write
    one, differ by more than ``tolerance``; NaN equals NaN and differs from every number. Other
    values are compared as trimmed text, nested ones as JSON.
    """
    if type(lt) is type(rt) and not _is_number(lt) and not isinstance(lt, T.StringType):
        if isinstance(lt, (T.ArrayType, T.StructType)):
            left, right = F.to_json(left), F.to_json(right)
        return ~left.eqNullSafe(right)
    lx, rx = normal_text(left), normal_text(right)
    ln, rn = (c.cast("double") if _is_number(k) else number_in_text(x) for c, k, x in ((left, lt, lx), (right, rt, rx)))
    as_numbers = F.when(F.isnan(ln) | F.isnan(rn), F.isnan(ln) != F.isnan(rn)).when(ln == rn, False).otherwise(F.abs(ln - rn) > tolerance)
    return (
        F.when(lx.isNull() & rx.isNull(), False)
        .when(lx.isNull() | rx.isNull(), True)
        .when(ln.isNotNull() & rn.isNotNull(), as_numbers)
        .otherwise(lx != rx)
    )


def table_diff(left: DataFrame, right: DataFrame, keys: dict[str, Column], order_by: str | None = None, ignore: Sequence[str] = (), tolerance: float = TOLERANCE) -> DataFrame:
    """One row per key that is missing on a side or has differing fields.

    ``keys`` gives each key column's normalised form, an expression over either side's columns.
    With ``order_by`` only the newest row of a key counts on each side; without it, equal rows count
    once and a key's remaining rows are reduced to the largest. Columns of one side only are not
    compared. Columns may have any names: both sides travel in one struct each, so nothing clashes.
    Keys may be null; null meets null. Empty tables give rows of one side only, or none.

    Result: keys, ``side`` (``only_left``, ``only_right``, ``both``), ``differences``
    array<struct<field_name, left_value, right_value>>, empty where a side is missing.
    """
    names = list(keys)
    fields = [c for c in left.columns if c in right.columns and c not in names and c not in ignore and c != order_by]
    kinds = {c: (left.schema[c].dataType, right.schema[c].dataType) for c in fields}

    def newest(df: DataFrame, side: str) -> DataFrame:
        at = F.col(f"`{order_by}`") if order_by else F.lit(0)
        row = F.struct(at.alias("at"), F.struct(*[F.col(f"`{c}`").alias(f"f{i}") if not isinstance(df.schema[c].dataType, (T.MapType, T.VariantType)) else F.to_json(f"`{c}`").alias(f"f{i}") for i, c in enumerate(fields)]).alias("row"))
        picked = df.select(*[keys[k].alias(f"k{i}") for i, k in enumerate(names)], row.alias("r"))
        return picked.groupBy(*[f"k{i}" for i in range(len(names))]).agg(F.max("r").alias(side))

    a, b = newest(left, "l").alias("a"), newest(right, "r").alias("b")
    on = [F.col(f"a.k{i}").eqNullSafe(F.col(f"b.k{i}")) for i in range(len(names))]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    both = a.join(b, cond, "full_outer")
    text = lambda c, k: c.cast("string") if isinstance(k, T.AtomicType) else F.to_json(c)
    diffs = []
    for i, c in enumerate(fields):
        x, y = F.col(f"l.row.f{i}"), F.col(f"r.row.f{i}")
        lt, rt = kinds[c]
        flat = lambda k: T.StringType() if isinstance(k, (T.MapType, T.VariantType)) else k
        lt, rt = flat(lt), flat(rt)
        diffs.append(F.when(differs(x, lt, y, rt, tolerance), F.struct(F.lit(c).alias("field_name"), text(x, lt).alias("left_value"), text(y, rt).alias("right_value"))))
    side = F.when(F.col("r").isNull(), "only_left").when(F.col("l").isNull(), "only_right").otherwise("both")
    empty = F.lit(None).cast("array<struct<field_name:string,left_value:string,right_value:string>>")
    differences = F.filter(F.array(*diffs), lambda d: d.isNotNull()) if diffs else F.coalesce(empty, F.array())
    out = both.select(*[F.coalesce(F.col(f"a.k{i}"), F.col(f"b.k{i}")).alias(k) for i, k in enumerate(names)], side.alias("side"), F.when(side == "both", differences).otherwise(F.slice(differences, 1, 0)).alias("differences"))
    return out.where((F.col("side") != "both") | (F.size("differences") > 0))


def found_rows(diff: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per missing key (field_name '') and per differing field, with diff_kind."""
    kinds = F.when(F.col("side") == "both", F.transform("differences", lambda d: F.struct(d["field_name"].alias("field_name"), F.lit("value").alias("diff_kind")))).otherwise(
        F.array(F.struct(F.lit("").alias("field_name"), F.col("side").alias("diff_kind")))
    )
    return diff.select(*keys, F.inline(kinds))
