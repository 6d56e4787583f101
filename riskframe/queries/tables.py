"""Views of the given tables in the shapes the operators work on, for Spark and for the SQL twins.

The given tables hold no nulls, so nulls are induced by key arithmetic. Every row of the table stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskframe.spec import FeatureSpec

CASE_SPEC = FeatureSpec(("amount", "hour", "k"), ("kind", "grp"), "target", "event_id")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- cases: events as a risk table with missing values, two roles and a binary label --------------

CASES = """
SELECT event_id,
       CASE WHEN event_id % 7 <> 0 THEN value END AS amount,
       CASE WHEN event_id % 11 <> 0 THEN CAST(extract(hour FROM ts) AS INTEGER) END AS hour,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
       CASE WHEN event_id % 13 <> 0 THEN event_type END AS kind,
       CASE WHEN event_id % 17 <> 0 THEN CAST(user_id % 4 AS INTEGER) END AS grp,
       CASE WHEN value * (1 + user_id % 4) > 90 THEN 1 ELSE 0 END AS target
FROM events
"""


def cases(spark: SparkSession, sf: str) -> DataFrame:
    e, present = table(spark, sf, "events"), lambda m: F.col("event_id") % m != 0
    return e.select(
        "event_id",
        F.when(present(7), F.col("value")).alias("amount"),
        F.when(present(11), F.hour("ts")).alias("hour"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.when(present(13), F.col("event_type")).alias("kind"),
        F.when(present(17), (F.col("user_id") % 4).cast("int")).alias("grp"),
        F.when(F.col("value") * (1 + F.col("user_id") % 4) > 90, 1).otherwise(0).alias("target"),
    )


def cases_with_nan(spark: SparkSession, sf: str) -> DataFrame:
    """`cases` where a part of the missing amounts is NaN instead of null; the SQL twins see null."""
    nan = F.col("amount").isNull() & (F.col("event_id") % 2 == 0)
    return cases(spark, sf).withColumn("amount", F.when(nan, F.lit(float("nan"))).otherwise(F.col("amount")))


def with_cases(body: str) -> str:
    return f"WITH cases AS ({CASES}) {body}"


# ---- registry rows: events under the source names of the clinical files ---------------------------

RAW_CASES = """
SELECT event_id,
       CAST(20 + user_id % 60 AS DOUBLE) AS age,
       CASE WHEN user_id % 2 = 0 THEN 'Male' ELSE 'F' END AS sex,
       CAST(event_id % 4 AS DOUBLE) AS cp,
       CASE WHEN event_id % 7 <> 0 THEN value END AS trestbps,
       CAST(1 + event_id % 3 AS DOUBLE) AS slope,
       CAST(user_id % 4 AS DOUBLE) AS ca,
       CASE WHEN event_id % 9 <> 0 THEN CAST(event_id % 5 AS DOUBLE) END AS num,
       CAST(3 AS DOUBLE) AS thal
FROM events
"""


def raw_cases(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    d = lambda c: c.cast("double")
    i, u = F.col("event_id"), F.col("user_id")
    return e.select(
        "event_id",
        d(20 + u % 60).alias("age"),
        F.when(u % 2 == 0, "Male").otherwise("F").alias("sex"),
        d(i % 4).alias("cp"),
        F.when(i % 7 != 0, F.col("value")).alias("trestbps"),
        d(1 + i % 3).alias("slope"),
        d(u % 4).alias("ca"),
        F.when(i % 9 != 0, d(i % 5)).alias("num"),
        F.lit(3.0).alias("thal"),
    )


def with_raw(body: str) -> str:
    return f"WITH raw_cases AS ({RAW_CASES}) {body}"


# ---- scores: lineitem as the score table of four models over the same rows ------------------------

SCORES = """
SELECT m.model, l.label, m.probability, CASE WHEN m.probability >= 0.5 THEN 1 ELSE 0 END AS prediction
FROM (SELECT CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS label,
             l_discount * 10 AS discount, l_quantity / 50 AS quantity,
             l_tax * 10 AS tax, l_extendedprice / 100000 AS price FROM lineitem) l
CROSS JOIN LATERAL (VALUES ('discount', discount), ('quantity', quantity), ('tax', tax), ('price', price))
  AS m(model, probability)
"""


def scores(spark: SparkSession, sf: str) -> DataFrame:
    wide = table(spark, sf, "lineitem").select(
        F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("label"),
        (F.col("l_discount") * 10).alias("discount"),
        (F.col("l_quantity") / 50).alias("quantity"),
        (F.col("l_tax") * 10).alias("tax"),
        (F.col("l_extendedprice") / 100000).alias("price"),
    )
    long = wide.unpivot(["label"], ["discount", "quantity", "tax", "price"], "model", "probability")
    return long.withColumn("prediction", F.when(F.col("probability") >= 0.5, 1).otherwise(0))


def with_scores(body: str) -> str:
    return f"WITH scores AS ({SCORES}) {body}"


# ---- quality scores: labelled documents, an imbalanced label with a continuous score --------------

QUALITY = """
SELECT l.doc_id, l.quality AS label, CAST(d.n_chars AS DOUBLE) AS score,
       CASE WHEN d.n_chars > 1000 THEN 1 ELSE 0 END AS prediction
FROM labels l JOIN documents d ON l.doc_id = d.doc_id
"""


def quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return table(spark, sf, "labels").join(docs, "doc_id").select(
        "doc_id",
        F.col("quality").alias("label"),
        F.col("n_chars").cast("double").alias("score"),
        F.when(F.col("n_chars") > 1000, 1).otherwise(0).alias("prediction"),
    )


# ---- fold metrics: orders as the cross-validation report of five models over ten folds ------------

METRIC_RULES = {
    "roc_auc": "o_totalprice > 100000",
    "accuracy": "o_totalprice > 150000",
    "precision": "o_totalprice > 200000",
    "recall": "o_orderstatus <> 'F'",
    "f1": "o_orderstatus = 'O'",
}
FOLDS = "\nUNION ALL\n".join(
    f"SELECT lower(substr(o_orderpriority, 3, 3)) AS model, CAST(o_orderkey % 10 + 1 AS INTEGER) AS fold,"
    f" '{m}' AS metric, avg(CASE WHEN {rule} THEN 1.0 ELSE 0.0 END) AS score"
    f" FROM orders GROUP BY 1, 2"
    for m, rule in METRIC_RULES.items()
)


def folds_wide(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "orders")
        .groupBy(
            F.lower(F.substring("o_orderpriority", 3, 3)).alias("model"),
            (F.col("o_orderkey") % 10 + 1).cast("int").alias("fold"),
        )
        .agg(*[F.avg(F.expr(rule).cast("double")).alias(m) for m, rule in METRIC_RULES.items()])
    )


def folds(spark: SparkSession, sf: str) -> DataFrame:
    return folds_wide(spark, sf).unpivot(["model", "fold"], list(METRIC_RULES), "metric", "score")


def with_folds(body: str) -> str:
    return f"WITH folds AS ({FOLDS}) {body}"


# ---- candidates: orders as the scores of search candidates over four folds ------------------------

CANDIDATES = """
SELECT o_orderstatus AS algorithm, 'c' || CAST(o_custkey % 20 AS VARCHAR) AS candidate,
       CAST(o_orderkey % 4 AS INTEGER) AS fold, avg(CASE WHEN o_totalprice > 150000 THEN 1.0 ELSE 0.0 END) AS score
FROM orders GROUP BY 1, 2, 3
"""


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "orders")
        .groupBy(
            F.col("o_orderstatus").alias("algorithm"),
            F.concat(F.lit("c"), (F.col("o_custkey") % 20).cast("string")).alias("candidate"),
            (F.col("o_orderkey") % 4).cast("int").alias("fold"),
        )
        .agg(F.avg((F.col("o_totalprice") > 150000).cast("double")).alias("score"))
    )


def with_candidates(body: str) -> str:
    return f"WITH candidates AS ({CANDIDATES}) {body}"


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round for comparison; adding 0.0 turns a rounded -0.0 into 0.0."""
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in columns})
