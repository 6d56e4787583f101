"""Whole jobs on saved models: evaluate one, compare many, explain a table. All results are written."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskframe import functions as fx
from riskframe.operators import explain as X, metrics as M
from riskframe.operators.models import predict
from riskframe.operators.project import require_columns
from riskframe.plans.score import raw_names
from riskframe.plans.validate import Evaluation, evaluate_holdout
from riskframe.session import job_scratch, stage_table
from riskframe.sources.registry import discover_models, load_model
from riskframe.sources.reports import write_document, write_json_report
from riskframe.sources.tables import write_csv, write_table
from riskframe.spec import FeatureSpec


def evaluate_job(spark: SparkSession, path: str, holdout: DataFrame, spec: FeatureSpec, folder: str, **options) -> Evaluation:
    """Evaluate a saved model on rows with labels; metrics as JSON, all other parts as tables, and a summary."""
    folder = folder.rstrip("/")
    with job_scratch(spark):
        model, metadata = load_model(spark, path)
        out = evaluate_holdout(spark, model, holdout, spec, **options)
        metrics = out["metrics"].schema
        write_json_report(out["metrics"], f"{folder}/metrics.json")
        parts = [name for name in out if name not in ("metrics", "thresholds")]
        for name in parts:
            write_table(out[name], f"{folder}/{name}")
    places = {"metrics": f"{folder}/metrics.json", **{name: f"{folder}/{name}" for name in parts}}
    doc = spark.createDataFrame([(json.dumps({**places, "metadata": metadata}, default=str),)], "value string")
    write_document(doc, f"{folder}/evaluation_summary.json")
    written = {name: (lambda _, name=name: spark.read.parquet(f"{folder}/{name}")) for name in parts}
    return Evaluation({**written, "metrics": lambda _: spark.read.schema(metrics).json(f"{folder}/metrics.json")})


def compare_job(
    spark: SparkSession, patterns: Sequence[str], df: DataFrame, label: str, id_col: str, folder: str
) -> tuple[DataFrame, list[tuple[str, str]]]:
    """(comparison, skipped) of all saved models found by the patterns on the same rows.

    Every model sees the features its metadata names, in their order. A model that cannot be loaded, lacks a
    feature or fails to predict is skipped with its reason. Per model the classification report and the confusion
    matrix are written, and the comparison, best ROC-AUC first, as CSV and JSON.
    """
    folder = folder.rstrip("/")
    long, skipped = None, []
    with job_scratch(spark):
        for r in discover_models(spark, list(patterns)).collect():  # the saved models, a handful
            try:
                model, metadata = load_model(spark, r["path"])
                features = metadata.get("features") or [c for c in df.columns if c not in (label, id_col)]
                require_columns(df, features)
                scored = predict(model, df.select(id_col, label, *features), margin="minmax").select(
                    F.lit(r["model"]).alias("model"), F.col(id_col).alias("id"),
                    F.col(label).cast("int").alias("label"), "prediction", "probability",
                )
                scored = stage_table(scored, "comparison")
            except (PySparkException, ValueError, OSError) as e:
                skipped.append((r["model"], str(e).splitlines()[0][:200]))
                continue
            write_table(M.classification_report(scored), f"{folder}/{r['model']}/classification_report")
            write_table(M.confusion_matrix(scored), f"{folder}/{r['model']}/confusion_matrix")
            long = scored if long is None else long.unionByName(scored)
        if long is None:
            raise ValueError("no model could be compared")
        table = M.compare_models(long)
        schema = table.schema
        write_json_report(table.coalesce(1), f"{folder}/compare_metrics.json")  # a row per model
    table = spark.read.schema(schema).json(f"{folder}/compare_metrics.json")
    table = table.orderBy(F.desc_nulls_last("roc_auc"), "model")
    write_csv(table, f"{folder}/compare_metrics.csv")
    return table, skipped


def interpret_job(
    spark: SparkSession,
    path: str,
    df: DataFrame,
    spec: FeatureSpec,
    folder: str,
    background: DataFrame | None = None,
    uncertain: int = 5,
    ids: DataFrame | Sequence | None = None,
    **options,
) -> dict[str, DataFrame]:
    """Explain a table with a saved model: contributions, their roll-up, the global summary, the rows to look at
    and their waterfalls.

    The background of a model that needs one is the one its metadata keeps, else `background`, else `df`.
    """
    folder = folder.rstrip("/")
    with job_scratch(spark):
        model, metadata = load_model(spark, path)
        kept = metadata.get("background_data")
        if background is None:
            types = df.select(spec.id, *spec.features).schema
            background = spark.createDataFrame([tuple(r.get(f.name) for f in types) for r in kept], types) if kept else df
        wanted = df.select(spec.id, *spec.features)
        rows, names, base = X.row_impacts(model, wanted, background, spec.id, spec.features, **options)
        rows = stage_table(rows.select(spec.id, "impacts"), "impacts")
        parts = X.roll_up(names, raw_names(model))
        scored = stage_table(predict(model, wanted).select(spec.id, "prediction", "probability"), "interpreted")
        looked_at = X.uncertain_samples(scored, spec.id, uncertain, ids)
        rolled = rows.select(spec.id, F.explode(parts).alias("p")).select(spec.id, "p.*")
        steps = rows.join(looked_at.select(spec.id), spec.id, "left_semi")
        steps = steps.select(spec.id, F.explode(X.waterfall_steps(parts, base)).alias("s")).select(spec.id, "s.*")
        out = {
            "contributions": X.long_form(rows, spec.id, names),
            "aggregated": rolled,
            "summary": X.global_summary(rolled),
            "samples": looked_at.withColumn("risk", fx.risk_label("prediction")),
            "waterfalls": steps,
        }
        for name, table in out.items():
            write_table(table, f"{folder}/{name}")
    return {name: spark.read.parquet(f"{folder}/{name}") for name in out}
