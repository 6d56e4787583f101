"""JSON reports: written as typed one-row tables, read back as metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from riskframe.functions import strip_test_prefix
from riskframe.sources.tables import path_exists
from riskframe.spec import CV_METRICS

_METRIC_MAP = "map<string, map<string, double>>"
_FOLD_MAP = "map<string, map<string, array<double>>>"
_SEARCH_SCHEMA = T.StructType(
    [
        T.StructField("rank", T.IntegerType()),
        T.StructField("mean_test_score", T.DoubleType()),
        T.StructField("std_test_score", T.DoubleType()),
        T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    ]
)


def clean_nan(df: DataFrame) -> DataFrame:
    """NaN has no JSON spelling; it is written as null."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles})


def write_json_report(df: DataFrame, path: str) -> None:
    clean_nan(df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def nested_report(metrics: DataFrame) -> DataFrame:
    """(model, metric, score) rows to one document {model: {metric: score}}."""
    per_model = metrics.groupBy("model").agg(
        F.map_from_entries(F.collect_list(F.struct("metric", "score"))).alias("scores")
    )
    return per_model.agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("model", "scores")))).alias("value")
    )


def nested_fold_report(metrics: DataFrame) -> DataFrame:
    """(model, fold, metric, score) rows to {model: {test_metric: [score per fold]}}."""
    arrays = metrics.groupBy("model", "metric").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("fold", "score"))), lambda s: s["score"]
        ).alias("scores")
    )
    per_model = arrays.groupBy("model").agg(
        F.map_from_entries(
            F.collect_list(F.struct(F.concat(F.lit("test_"), "metric"), "scores"))
        ).alias("scores")
    )
    return per_model.agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("model", "scores")))).alias("value")
    )


def write_document(doc: DataFrame, path: str) -> None:
    doc.write.mode("overwrite").text(path)


def _documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    return text.select(F.from_json("value", schema).alias("doc"))


def read_cv_report(spark: SparkSession, path: str, metrics=CV_METRICS) -> DataFrame:
    """{model: {metric: v}} to one row per model, one column per metric."""
    per_model = _documents(spark, path, _METRIC_MAP).select(F.explode("doc").alias("model", "scores"))
    return per_model.select("model", *[F.col("scores")[m].alias(m) for m in metrics])


def read_fold_metrics(spark: SparkSession, path: str) -> DataFrame:
    """{model: {test_metric: [..]}} to one row per (model, fold); folds count from 1."""
    return pivot_folds(read_fold_metrics_long(spark, path))


def read_fold_metrics_long(spark: SparkSession, path: str) -> DataFrame:
    return (
        _documents(spark, path, _FOLD_MAP)
        .select(F.explode("doc").alias("model", "metrics"))
        .select("model", F.explode("metrics").alias("key", "scores"))
        .filter(F.col("key").startswith("test_"))
        .select("model", strip_test_prefix("key").alias("metric"), F.posexplode("scores").alias("p", "score"))
        .select("model", (F.col("p") + 1).alias("fold"), "metric", "score")
    )


def pivot_folds(long: DataFrame, metrics=CV_METRICS) -> DataFrame:
    return long.groupBy("model", "fold").pivot("metric", list(metrics)).agg(F.first("score"))


def write_search_results(search: DataFrame, folder: str) -> None:
    """One folder `<algorithm>/top_k_models.json` per algorithm, one line per candidate."""
    algorithms = [r[0] for r in search.select("algorithm").distinct().collect()]
    for a in algorithms:  # the model registry, a handful
        rows = search.filter(F.col("algorithm") == a).drop("algorithm")
        write_json_report(rows, f"{folder.rstrip('/')}/{a}/top_k_models.json")


def read_search_results(spark: SparkSession, folder: str) -> DataFrame:
    """(algorithm, rank, mean_score, std_score) over all algorithm folders; a missing std is 0."""
    pattern = f"{folder.rstrip('/')}/*/top_k_models.json"
    if not path_exists(spark, pattern):
        return spark.createDataFrame(
            [], "algorithm string, rank int, mean_score double, std_score double"
        )
    # every file decides for itself: a JSON array, one object, or one object per line
    text = spark.read.text(pattern, wholetext=True)
    many = T.ArrayType(_SEARCH_SCHEMA)
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    each = F.transform(lines, lambda x: F.from_json(x, _SEARCH_SCHEMA))
    per_line = F.forall(lines, lambda x: F.trim(x).startswith("{") & F.trim(x).endswith("}"))
    found = F.when(per_line, each).otherwise(F.from_json("value", many))
    algorithm = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/top_k_models\.json", 1)
    rows = text.select(algorithm.alias("algorithm"), F.explode(found).alias("r"))
    return rows.select(
        "algorithm",
        "r.rank",
        F.col("r.mean_test_score").alias("mean_score"),
        F.coalesce("r.std_test_score", F.lit(0.0)).alias("std_score"),
    )
