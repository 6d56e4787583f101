"""Column expressions shared by the operators; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from riskframe.spec import GENDER_FALSE, GENDER_TRUE, HIGH_RISK, LOW_RISK


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_key(seed, *cols) -> Column:
    """md5 of `seed:col:...`; a total, uniform, engine-independent order of rows."""
    parts = [F.lit(str(seed))] + [as_col(c).cast("string") for c in cols]
    return F.md5(F.concat_ws(":", *parts))


def hash_int(key: Column) -> Column:
    """First 32 bits of an md5 key as a number."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long")


def hash_uniform(seed, *cols) -> Column:
    """Uniform number in [0, 1) drawn from the row's own key, so retries give the same draw."""
    return hash_int(hash_key(seed, *cols)) / F.lit(4294967296.0)


def clean_text(c) -> Column:
    return F.lower(F.trim(as_col(c).cast("string")))


def normalize_gender(c) -> Column:
    """Text or number to 1/0; another whole number, also spelt 7.0, is kept, anything else becomes null."""
    g = clean_text(c)
    return (
        F.when(g.isin(*GENDER_TRUE), 1)
        .when(g.isin(*GENDER_FALSE), 0)
        .otherwise(whole_number(g))
    )


def whole_number(c) -> Column:
    """The whole number a text or number spells, with or without decimals, else null."""
    d = as_col(c).try_cast("double")
    return F.when(~F.isnan(d) & (d == F.floor(d)) & (F.abs(d) < 2**31), d.try_cast("int"))


def gender_rejected(c) -> Column:
    return as_col(c).isNotNull() & normalize_gender(c).isNull()


def map_codes(c, codes: dict) -> Column:
    """Look a code up in a fixed table; unknown codes become null."""
    pairs = [F.lit(x) for kv in codes.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), as_col(c))


def binarize(c) -> Column:
    """1 where the value is positive, else 0; a missing value (null or NaN) counts as 0."""
    return F.when(nan_to_null(as_col(c).cast("double")) > 0, 1).otherwise(0)


def sigmoid(c) -> Column:
    return 1.0 / (1.0 + F.exp(-as_col(c)))


def safe_ratio(num: Column, den: Column) -> Column:
    """Ratio that is 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def percent_display(p) -> Column:
    p = as_col(p)
    return F.when(p > 1, p).otherwise(p * 100)


def risk_label(prediction) -> Column:
    return F.when(as_col(prediction) == 1, HIGH_RISK).otherwise(LOW_RISK)


def strip_test_prefix(c) -> Column:
    return F.regexp_replace(as_col(c), "^test_", "")


def top_by_magnitude(arr, k: int, field: str = "impact", tie: str = "feature") -> Column:
    """The k structs of an array with the largest |field|, ties by name; no shuffle."""

    def order(a, b):
        return (
            F.when(F.abs(a[field]) > F.abs(b[field]), -1)
            .when(F.abs(a[field]) < F.abs(b[field]), 1)
            .when(a[tie] < b[tie], -1)
            .when(a[tie] > b[tie], 1)
            .otherwise(0)
        )

    return F.slice(F.array_sort(as_col(arr), order), 1, k)


def nan_to_null(c) -> Column:
    return F.when(~F.isnan(as_col(c)), as_col(c))


def present(df, column: str) -> Column:
    """The column with NaN as null, the one meaning of missing; other types are unchanged."""
    real = isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType))
    return nan_to_null(column) if real else F.col(column)
