"""Projections, code mappings, role assignment and row selection."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from riskframe import functions as fx
from riskframe.operators.ranking import dist_rank
from riskframe.spec import (
    FALLBACK_SUBSTRINGS,
    HARDEN_SUBSTRINGS,
    NUMERIC_NAME_HINTS,
    SOURCE_NAMES,
    FeatureSpec,
)


def rename_map(df: DataFrame, names: dict[str, str] = SOURCE_NAMES) -> DataFrame:
    return df.withColumnsRenamed(names)


def copy_column(df: DataFrame, source: str, target: str) -> DataFrame:
    return df.withColumn(target, F.col(source))


def binarize_label(df: DataFrame, column: str, reject_null: bool = False) -> DataFrame:
    """1 where positive, else 0. A missing value counts as 0 unless such rows are to be rejected."""
    if reject_null:
        df = df.filter(fx.nan_to_null(F.col(column).cast("double")).isNotNull())
    return df.withColumn(column, fx.binarize(column))


def project_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    require_columns(df, columns)
    return df.select(*columns)


def align_features(df: DataFrame, features: Sequence[str] | None) -> DataFrame:
    """Known features in their stored order; the whole table if none of them is present."""
    present = [c for c in features or () if c in df.columns]
    return df.select(*present) if present else df


def drop_if_exists(df: DataFrame, *columns: str) -> DataFrame:
    return df.drop(*columns)


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Fail on the schema, before any job runs, naming every missing column."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def add_surrogate_id(
    df: DataFrame,
    id_col: str = "patientid",
    start: int = 20000,
    order: Sequence[str] | None = None,
    if_absent: bool = True,
    dense: bool = True,
) -> DataFrame:
    """Consecutive ids from `start`, first column.

    Rows are numbered in the hash order of `order` (all columns by default), so the numbering does
    not depend on how the input was split. `dense=False` gives unique ids with gaps and no shuffle.
    """
    if if_absent and id_col in df.columns:
        return df
    columns = [c for c in df.columns if c != id_col]
    if not dense:
        numbered = df.withColumn(id_col, F.monotonically_increasing_id() + F.lit(start))
    else:
        # null must differ from "", so nulls are named in the key
        parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in order or columns]
        numbered = dist_rank(
            df.drop(id_col).withColumn("_key", F.md5(F.concat_ws("\x01", *parts))), "_key", id_col
        )
        numbered = numbered.withColumn(id_col, F.col(id_col) + F.lit(start - 1)).drop("_key")
    return numbered.select(id_col, *columns)


def map_code_column(df: DataFrame, column: str, codes: dict) -> DataFrame:
    """Map text codes to numbers; a column that is already numeric is left alone."""
    if not isinstance(df.schema[column].dataType, T.StringType):
        return df
    return df.withColumn(column, fx.map_codes(column, codes))


def normalize_gender(df: DataFrame, column: str = "gender", reject_col: str | None = None) -> DataFrame:
    if reject_col:
        df = df.withColumn(reject_col, fx.gender_rejected(column))
    return df.withColumn(column, fx.normalize_gender(column))


def label_cast(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.col(column).cast("int"))


def assign_roles(columns: Sequence[str], hints: Sequence[str] = NUMERIC_NAME_HINTS):
    """(numeric, categorical) by exact case-insensitive hints, by substrings if no hint matches."""
    known = {h.lower() for h in hints}
    numeric = [c for c in columns if c.lower() in known]
    if not numeric:
        numeric = [c for c in columns if any(s in c.lower() for s in FALLBACK_SUBSTRINGS)]
    return tuple(numeric), tuple(c for c in columns if c not in numeric)


def harden_roles(spec: FeatureSpec, columns: Sequence[str]) -> FeatureSpec:
    """Give every column the registry does not know a role by its name; returns a new spec."""
    extra = [c for c in columns if c not in {*spec.features, spec.label, spec.id}]
    numeric = [c for c in extra if any(s in c.lower() for s in HARDEN_SUBSTRINGS)]
    return spec.with_roles(numeric, [c for c in extra if c not in numeric])


def rank_filter(df: DataFrame, max_rank: int, rank_col: str = "rank") -> DataFrame:
    return df.filter(F.col(rank_col) <= max_rank)


def head(df: DataFrame, n: int, order: str) -> DataFrame:
    return df.orderBy(order).limit(n)


def sample_rows(df: DataFrame, n: int, id_col: str, seed: int = 42) -> DataFrame:
    """n rows without replacement: the n smallest hash keys."""
    key = fx.hash_key(seed, id_col)
    return df.orderBy(key, id_col).limit(n)


def union_all(*tables: DataFrame) -> DataFrame:
    first, *rest = tables
    for t in rest:
        first = first.unionByName(t)
    return first
