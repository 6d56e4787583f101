"""Queries for sources, projections, code mappings, row rules and ids."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from riskframe import functions as fx
from riskframe.operators import project as P, quality as Q
from riskframe.plans.ingest import canonical, standardize_registry
from riskframe.queries.registry import query
from riskframe.queries.tables import (
    CASE_SPEC,
    cases,
    cases_with_nan,
    raw_cases,
    rounded,
    scores,
    table,
    with_cases,
    with_raw,
    with_scores,
)
from riskframe.session import scratch_path
from riskframe.sources import tables as IO
from riskframe.spec import GENDER_CODES, FeatureSpec

CASE_COLUMNS = "event_id, amount, hour, k, kind, grp, target"


@query("read_headerless_csv", with_cases(f"SELECT {CASE_COLUMNS} FROM cases"))
def read_headerless_csv(spark, sf):
    df, path = cases(spark, sf), scratch_path(spark, "headerless")
    IO.write_headerless(df, path)
    return IO.read_headerless(spark, path, df.schema)


CENTRES = """
SELECT 'customer.data' AS center, c_custkey AS key, c_nationkey AS nation, c_acctbal AS balance FROM customer
UNION ALL SELECT 'supplier.data', s_suppkey, s_nationkey, s_acctbal FROM supplier
"""


def _centres(spark, sf):
    """Two centres written as their own files, read back together; a third file is absent."""
    folder = scratch_path(spark, "centres")
    c = table(spark, sf, "customer").selectExpr("c_custkey AS key", "c_nationkey AS nation", "c_acctbal AS balance")
    s = table(spark, sf, "supplier").selectExpr("s_suppkey AS key", "s_nationkey AS nation", "s_acctbal AS balance")
    IO.write_headerless(c, f"{folder}/customer.data")
    IO.write_headerless(s, f"{folder}/supplier.data")
    files = ["customer.data", "supplier.data", "absent.data"]
    return IO.read_many(spark, folder, files, c.schema)


@query("read_many_centres", CENTRES)
def read_many_centres(spark, sf):
    return _centres(spark, sf)


@query("read_headed_csv", with_cases(f"SELECT {CASE_COLUMNS} FROM cases"))
def read_headed_csv(spark, sf):
    df, path = cases(spark, sf), scratch_path(spark, "headed")
    IO.write_csv(df, path)
    return IO.read_headed(spark, path, df.schema)


@query("load_csv_drop", with_cases("SELECT amount, hour, k, kind, grp, target FROM cases"))
def load_csv_drop(spark, sf):
    df, path = cases(spark, sf), scratch_path(spark, "load")
    IO.write_csv(df, path)
    return IO.load_csv(spark, path, ["event_id", "not_there"], df.schema)


@query(
    "rename_map",
    with_raw(
        "SELECT event_id, age, sex AS gender, cp AS chestpain, trestbps AS \"restingBP\", slope,"
        " ca AS noofmajorvessels, num AS target, thal FROM raw_cases"
    ),
)
def rename_map(spark, sf):
    return P.rename_map(raw_cases(spark, sf))


@query("copy_column", with_raw("SELECT event_id, ca, ca AS noofmajorvessels FROM raw_cases"))
def copy_column(spark, sf):
    return P.copy_column(raw_cases(spark, sf).select("event_id", "ca"), "ca", "noofmajorvessels")


@query(
    "binarize_label",
    with_raw("SELECT event_id, CASE WHEN num > 0 THEN 1 ELSE 0 END AS num FROM raw_cases"),
)
def binarize_label(spark, sf):
    return P.binarize_label(raw_cases(spark, sf).select("event_id", "num"), "num")


@query(
    "binarize_label_reject_null",
    with_raw("SELECT event_id, CASE WHEN num > 0 THEN 1 ELSE 0 END AS num FROM raw_cases WHERE num IS NOT NULL"),
)
def binarize_label_reject_null(spark, sf):
    return P.binarize_label(raw_cases(spark, sf).select("event_id", "num"), "num", reject_null=True)


@query("project_features", with_cases("SELECT amount, hour, k, kind, grp FROM cases"))
def project_features(spark, sf):
    return P.project_features(cases(spark, sf), CASE_SPEC.features)


@query("align_features", with_cases("SELECT kind, amount FROM cases"))
def align_features(spark, sf):
    return P.align_features(cases(spark, sf), ["kind", "not_there", "amount"])


@query(
    "add_surrogate_id",
    f"""SELECT 19999 + row_number() OVER (ORDER BY md5(center || chr(1) || CAST(key AS VARCHAR))) AS patientid,
        center, key, balance FROM ({CENTRES})""",
)
def add_surrogate_id(spark, sf):
    df = _centres(spark, sf).select("center", "key", "balance")
    return P.add_surrogate_id(df, "patientid", 20000, order=["center", "key"])


@query("drop_if_exists", with_raw("SELECT event_id, age, cp, slope, ca, num, trestbps, sex FROM raw_cases"))
def drop_if_exists(spark, sf):
    return P.drop_if_exists(raw_cases(spark, sf), "thal", "not_there")


@query(
    "align_offset",
    with_raw(
        """SELECT event_id, cp + CASE WHEN (SELECT min(cp) FROM raw_cases) = 0 THEN 1 ELSE 0 END AS chestpain,
           slope + CASE WHEN (SELECT min(slope) FROM raw_cases) = 0 THEN 1 ELSE 0 END AS slope FROM raw_cases"""
    ),
)
def align_offset(spark, sf):
    df = P.rename_map(raw_cases(spark, sf)).select("event_id", "chestpain", "slope")
    return Q.align_offset(df)


@query(
    "map_codes",
    with_raw("SELECT event_id, CASE sex WHEN 'M' THEN 1 WHEN 'Male' THEN 1 WHEN 'F' THEN 0 WHEN 'Female' THEN 0 END AS sex, cp FROM raw_cases"),
)
def map_codes(spark, sf):
    df = raw_cases(spark, sf).select("event_id", "sex", "cp")
    return P.map_code_column(P.map_code_column(df, "sex", GENDER_CODES), "cp", GENDER_CODES)


GENDER_TEXT = """
SELECT event_id, CASE event_id % 8 WHEN 0 THEN ' Male ' WHEN 1 THEN 'F' WHEN 2 THEN 'YES' WHEN 3 THEN '0'
  WHEN 4 THEN 'x' WHEN 5 THEN '2' WHEN 6 THEN 'female'
  WHEN 7 THEN CASE event_id % 3 WHEN 0 THEN '1.0' WHEN 1 THEN '0.0' END END AS gender FROM events
"""


@query(
    "normalize_gender",
    f"""SELECT event_id, CASE WHEN lower(trim(gender)) IN ('m','male','1','true','yes') THEN 1
          WHEN lower(trim(gender)) IN ('f','female','0','false','no') THEN 0
          ELSE CAST(TRY_CAST(gender AS DOUBLE) AS INTEGER) END AS gender,
          gender IS NOT NULL AND gender = 'x' AS rejected FROM ({GENDER_TEXT})""",
)
def normalize_gender(spark, sf):
    texts = {0: " Male ", 1: "F", 2: "YES", 3: "0", 4: "x", 5: "2", 6: "female"}
    df = table(spark, sf, "events").select(
        "event_id",
        F.coalesce(
            fx.map_codes(F.col("event_id") % 8, texts), fx.map_codes(F.col("event_id") % 3, {0: "1.0", 1: "0.0"})
        ).alias("gender"),
    )
    return P.normalize_gender(df, "gender", "rejected")


@query(
    "null_profile",
    with_cases(
        """SELECT * FROM (
        SELECT 'amount' AS feature, round(100.0 * avg(CASE WHEN amount IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_pct FROM cases
        UNION ALL SELECT 'hour', round(100.0 * avg(CASE WHEN hour IS NULL THEN 1.0 ELSE 0.0 END), 6) FROM cases
        UNION ALL SELECT 'k', round(100.0 * avg(CASE WHEN k IS NULL THEN 1.0 ELSE 0.0 END), 6) FROM cases
        UNION ALL SELECT 'kind', round(100.0 * avg(CASE WHEN kind IS NULL THEN 1.0 ELSE 0.0 END), 6) FROM cases
        UNION ALL SELECT 'grp', round(100.0 * avg(CASE WHEN grp IS NULL THEN 1.0 ELSE 0.0 END), 6) FROM cases
        ) WHERE null_pct > 0"""
    ),
)
def null_profile(spark, sf):
    return rounded(Q.null_profile(cases_with_nan(spark, sf), CASE_SPEC.features), "null_pct")


ROW_RULES = (("amount", 1, 100, False), ("hour", 6, 20, True), ("k", 0, 89, True))


@query(
    "validate_rows_rejected",
    with_cases(
        """SELECT event_id, concat_ws(',',
             CASE WHEN NOT coalesce(amount BETWEEN 1 AND 100, FALSE) THEN 'amount' END,
             CASE WHEN NOT coalesce(hour BETWEEN 6 AND 20, FALSE) THEN 'hour' END,
             CASE WHEN NOT coalesce(k BETWEEN 0 AND 89, FALSE) THEN 'k' END) AS broken
           FROM cases WHERE NOT (coalesce(amount BETWEEN 1 AND 100, FALSE)
             AND coalesce(hour BETWEEN 6 AND 20, FALSE) AND coalesce(k BETWEEN 0 AND 89, FALSE))"""
    ),
)
def validate_rows_rejected(spark, sf):
    _, rejected = Q.validate_rows(cases(spark, sf), ROW_RULES)
    return rejected.select("event_id", F.array_join("violations", ",").alias("broken"))


@query(
    "validate_rows_valid",
    with_cases(
        f"SELECT {CASE_COLUMNS} FROM cases WHERE amount BETWEEN 1 AND 100 AND hour BETWEEN 6 AND 20 AND k BETWEEN 0 AND 89"
    ),
)
def validate_rows_valid(spark, sf):
    return Q.validate_rows(cases(spark, sf), ROW_RULES)[0]


@query(
    "assign_roles",
    """SELECT 'numeric' AS role, CAST(3 * count(*) AS BIGINT) AS cells FROM customer
       UNION ALL SELECT 'categorical', CAST(2 * count(*) AS BIGINT) FROM customer""",
)
def assign_roles(spark, sf):
    """Cells per role: no column name is a known hint, so the substring rule decides."""
    c = table(spark, sf, "customer").selectExpr(
        "c_acctbal AS max_balance", "c_nationkey AS nation_rate", "c_custkey AS key_min",
        "c_mktsegment AS segment", "c_name AS label",
    )
    numeric, categorical = P.assign_roles(c.columns)
    role = F.when(F.col("column").isin(*numeric), "numeric").otherwise("categorical")
    as_text = c.select([F.col(x).cast("string") for x in c.columns])
    cells = as_text.unpivot([], list(numeric + categorical), "column", "value")
    return cells.groupBy(role.alias("role")).agg(F.count("value").alias("cells"))


@query(
    "harden_roles",
    with_cases(
        """SELECT 'numeric' AS role, CAST(count(amount) + count(hour) + count(k) + count(*) AS BIGINT) AS cells FROM cases
           UNION ALL SELECT 'categorical', CAST(count(kind) + count(grp) + count(*) AS BIGINT) FROM cases"""
    ),
)
def harden_roles(spark, sf):
    df = cases(spark, sf).withColumns({"peak_hour": F.lit(1), "note": F.lit("n")})
    spec = P.harden_roles(CASE_SPEC, df.columns)
    count = lambda cols: sum((F.count(c) for c in cols), F.lit(0))
    row = df.agg(count(spec.numeric).alias("numeric"), count(spec.categorical).alias("categorical"))
    return row.unpivot([], ["numeric", "categorical"], "role", "cells")


@query("label_cast", "SELECT event_id, CAST(value AS INTEGER) AS target FROM (SELECT event_id, floor(value) AS value FROM events)")
def label_cast(spark, sf):
    df = table(spark, sf, "events").select("event_id", F.floor("value").cast("double").alias("target"))
    return P.label_cast(df, "target")


@query("head_rows", with_cases("SELECT event_id, amount, hour, k FROM cases ORDER BY event_id LIMIT 20"))
def head_rows(spark, sf):
    return P.head(cases(spark, sf).select("event_id", "amount", "hour", "k"), 20, "event_id")


@query(
    "sample_rows",
    with_cases("SELECT event_id, amount FROM cases ORDER BY md5('42:' || CAST(event_id AS VARCHAR)) LIMIT 500"),
)
def sample_rows(spark, sf):
    return P.sample_rows(cases(spark, sf).select("event_id", "amount"), 500, "event_id", 42)


@query(
    "percent_display",
    with_scores("SELECT model, CASE WHEN probability > 1 THEN probability ELSE probability * 100 END AS shown FROM scores"),
)
def percent_display(spark, sf):
    return scores(spark, sf).select("model", fx.percent_display("probability").alias("shown"))


@query(
    "risk_label",
    with_scores("SELECT model, label, CASE WHEN prediction = 1 THEN 'High risk' ELSE 'Low risk' END AS risk FROM scores"),
)
def risk_label(spark, sf):
    return scores(spark, sf).select("model", "label", fx.risk_label("prediction").alias("risk"))


@query("union_centres", "SELECT nation, CAST(count(*) AS BIGINT) AS n, round(sum(balance), 2) AS balance"
       f" FROM ({CENTRES}) GROUP BY nation")  # fmt: skip
def union_centres(spark, sf):
    c = table(spark, sf, "customer").selectExpr("c_nationkey AS nation", "c_acctbal AS balance")
    s = table(spark, sf, "supplier").selectExpr("s_acctbal AS balance", "s_nationkey AS nation")
    both = P.union_all(c, s)
    return both.groupBy("nation").agg(
        F.count(F.lit(1)).alias("n"), (F.round(F.sum("balance"), 2) + 0.0).alias("balance")
    )


@query(
    "center_bias",
    f"""SELECT center, CAST(sum(CASE WHEN balance > 0 THEN 1 ELSE 0 END) AS BIGINT) AS positives,
        CAST(sum(CASE WHEN balance > 0 THEN 0 ELSE 1 END) AS BIGINT) AS negatives,
        round(CAST(sum(CASE WHEN balance > 0 THEN 1 ELSE 0 END) AS DOUBLE)
          / nullif(sum(CASE WHEN balance > 0 THEN 0 ELSE 1 END), 0), 6) AS ratio FROM ({CENTRES}) GROUP BY center""",
)
def center_bias(spark, sf):
    df = P.binarize_label(_centres(spark, sf), "balance")
    return rounded(Q.center_bias(df, "center", "balance"), "ratio")


@query("distinct_keys", "SELECT DISTINCT n_regionkey AS region, c_mktsegment AS segment FROM customer JOIN nation ON c_nationkey = n_nationkey")
def distinct_keys(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    joined = c.join(n, c.c_nationkey == n.n_nationkey)
    return joined.select(F.col("n_regionkey").alias("region"), F.col("c_mktsegment").alias("segment")).distinct()


@query(
    "standardize_registry",
    with_raw(
        """SELECT 9999 + row_number() OVER (ORDER BY md5(concat_ws(chr(1), CAST(event_id AS VARCHAR), CAST(CAST(age AS INTEGER) AS VARCHAR)))) AS patientid,
           event_id, CAST(age AS INTEGER) AS age, CASE WHEN sex = 'Male' THEN 1 ELSE 0 END AS gender, cp + 1 AS chestpain,
           trestbps AS "restingBP", slope, ca AS noofmajorvessels, num FROM raw_cases"""
    ),
)
def standardize_registry_query(spark, sf):
    raw = raw_cases(spark, sf).withColumn("age", F.col("age").cast("int"))
    std = standardize_registry(P.add_surrogate_id(raw, "patientid", 10000, order=["event_id", "age"]))
    return std


@query(
    "combine_registries",
    with_raw(
        """SELECT 19999 + row_number() OVER (ORDER BY md5(CAST(event_id AS VARCHAR))) AS patientid, age,
           trestbps AS "restingBP", CAST(cp AS INTEGER) AS chestpain, CAST(slope AS INTEGER) AS slope,
           CAST(ca AS INTEGER) AS noofmajorvessels, CASE WHEN num > 0 THEN 1 ELSE 0 END AS target, event_id FROM raw_cases"""
    ),
)
def combine_registries_query(spark, sf):
    """Written as a headerless centre file, read beside an absent one, brought to the canonical shape."""
    spec = FeatureSpec(("age", "restingBP"), ("chestpain", "slope", "noofmajorvessels"))
    raw = raw_cases(spark, sf).drop("sex")
    folder = scratch_path(spark, "combine")
    IO.write_headerless(raw, f"{folder}/centre.data")
    back = IO.read_many(spark, folder, ["centre.data", "absent.data"], raw.schema)
    return canonical(back, spec, extra=["event_id"], order=["event_id"])


@query(
    "require_columns",
    with_cases("SELECT c AS missing, (SELECT count(*) FROM cases) AS kept_rows FROM (VALUES ('absent'), ('gone')) v(c)"),
)
def require_columns(spark, sf):
    """The columns a table is refused for, and the rows of the same table when nothing is missing."""
    df = cases(spark, sf)
    kept = P.require_columns(df, CASE_SPEC.features)
    try:
        P.require_columns(df, [*CASE_SPEC.features, "absent", "gone"])
    except ValueError as e:
        named = re.findall(r"'(\w+)'", str(e))
    missing = F.explode(F.array(*[F.lit(c) for c in named]))
    return kept.agg(F.count(F.lit(1)).alias("kept_rows")).select(missing.alias("missing"), "kept_rows")
