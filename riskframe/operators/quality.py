"""Null profile, range rules and the zero-index offset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from riskframe.functions import present
from riskframe.spec import OFFSET_COLUMNS, RANGE_RULES


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Share of missing values (null or NaN) in percent per column, only columns that have any. One pass."""
    columns = list(columns or df.columns)
    rates = df.agg(
        *[(F.avg(present(df, c).isNull().cast("double")) * 100).alias(c) for c in columns]
    )
    return (
        rates.unpivot([], columns, "feature", "null_pct")
        .filter(F.col("null_pct") > 0)
        .select("feature", "null_pct")
    )


def align_offset(df: DataFrame, columns: Sequence[str] = OFFSET_COLUMNS) -> DataFrame:
    """Shift a column by one wherever its smallest value over the whole table is 0.

    The minima are one aggregated row; they return as literals, so the shift itself is a map.
    """
    present = [c for c in columns if c in df.columns]
    if not present:
        return df
    low = df.agg(*[F.min(c).alias(c) for c in present]).first()
    return df.withColumns({c: F.col(c) + 1 for c in present if low[c] == 0})


def violations(df: DataFrame, rules=RANGE_RULES) -> DataFrame:
    """Add `violations`: the names of the rules a row breaks. A missing value breaks its rule."""
    checks = []
    for column, low, high, whole in rules:
        if column not in df.columns:
            continue
        c = F.col(column).cast("double")
        ok = c.between(low, high)
        if whole:
            ok = ok & (c == F.floor(c))
        checks.append(F.when(~F.coalesce(ok, F.lit(False)), F.lit(column)))
    if not checks:
        return df.withColumn("violations", F.array().cast(T.ArrayType(T.StringType())))
    return df.withColumn("violations", F.array_compact(F.array(*checks)))


def validate_rows(df: DataFrame, rules=RANGE_RULES) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with the broken rules)."""
    checked = violations(df, rules)
    broken = F.size("violations") > 0
    return checked.filter(~broken).drop("violations"), checked.filter(broken)


def center_bias(df: DataFrame, center: str, label: str) -> DataFrame:
    """Positives, negatives and their ratio per source."""
    pos = F.sum(F.col(label).cast("long"))
    neg = F.sum((1 - F.col(label)).cast("long"))
    return df.groupBy(center).agg(
        pos.alias("positives"), neg.alias("negatives"), F.try_divide(pos, neg).alias("ratio")
    )
