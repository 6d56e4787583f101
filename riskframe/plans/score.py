"""Scoring and explaining tables and files of records with a fitted model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from riskframe import functions as fx
from riskframe.operators import explain as X, project as P
from riskframe.operators.models import predict
from riskframe.operators.preprocess import TabularPreprocessorModel
from riskframe.sources.tables import read_headed, write_scored
from riskframe.spec import HEART_SPEC, FeatureSpec


def normalize_records(df: DataFrame) -> DataFrame:
    """Text genders to codes, in tables and uploaded files alike."""
    if "gender" in df.columns and isinstance(df.schema["gender"].dataType, T.StringType):
        return P.normalize_gender(df)
    return df


def score_records(model, records: DataFrame, features=None, id_col: str | None = None) -> DataFrame:
    """Normalise, put the features in the model's order, add prediction and probability.

    A projection from end to end, so the same function scores a batch and a stream.
    """
    df = normalize_records(records)
    if features:
        P.require_columns(df, features)
        df = df.select(*([id_col] if id_col else []), *features)
    return predict(model, df)


def score_files(
    spark: SparkSession,
    model,
    path: str,
    features,
    output: str | None = None,
    schema: T.StructType | None = None,
    fmt: str = "csv",
) -> DataFrame:
    """Score a file, keeping every input column; fails on missing feature columns before reading."""
    df = read_headed(spark, path, schema)
    P.require_columns(df, features)
    scored = predict(model, normalize_records(df))
    if output:
        write_scored(scored, output, fmt)
    return scored


def raw_names(model) -> dict[str, str]:
    """Transformed name to raw feature, from the model's preprocessing stage."""
    for stage in getattr(model, "stages", [model]):
        if isinstance(stage, TabularPreprocessorModel):
            return stage.raw_names
    return {}


def explain_records(
    model,
    records: DataFrame,
    background: DataFrame,
    spec: FeatureSpec = HEART_SPEC,
    top_k: int = 8,
    **options,
) -> DataFrame:
    """Per record: prediction, probability, base value, contributions by transformed and by raw
    feature, and the strongest raw features."""
    records, background = normalize_records(records), normalize_records(background)
    wanted = records.select(spec.id, *spec.features)
    rows, names, base = X.row_impacts(
        model, wanted, background, spec.id, spec.features, **options
    )
    if "features" in rows.columns:
        # trees and linear models: the classifier's own output on the same row, no join
        scored = predict(model.stages[-1], rows).select(
            spec.id, "impacts", "prediction", "probability"
        )
    else:
        scored = predict(model, wanted).select(spec.id, "prediction", "probability").join(rows, spec.id)
    labels = F.array(*[F.lit(n) for n in names])
    return scored.withColumn("parts", X.roll_up(names, raw_names(model))).select(
        spec.id,
        "prediction",
        "probability",
        F.lit(base).alias("base_value"),
        fx.risk_label("prediction").alias("risk"),
        F.map_from_arrays(labels, "impacts").alias("contributions"),
        F.map_from_entries("parts").alias("aggregated"),
        fx.top_by_magnitude("parts", top_k).alias("top_features"),
    )
