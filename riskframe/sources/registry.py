"""Saved models: a Spark ML pipeline with a metadata table beside it."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from riskframe.sources.tables import list_paths, path_exists


def save_model(spark: SparkSession, model: PipelineModel, path: str, metadata: dict | None = None) -> str:
    """Write the pipeline and its metadata under `path`.

    Stages that read written tables (the `stored` parameters hold a path, or paths by column as JSON) take them along,
    so the saved model stands alone.
    """
    path = path.rstrip("/")
    for i, stage in enumerate(model.stages):
        for name in getattr(stage, "stored", ()):
            if not stage.isDefined(name):
                continue
            value = stage.getOrDefault(name)
            own = json.loads(value) if value.startswith("{") else {"": value}
            for key, source in own.items():
                own[key] = f"{path}/tables/{i}_{name}_{list(own).index(key)}"
                spark.read.parquet(source).write.mode("overwrite").parquet(own[key])
            stage._set(**{name: json.dumps(own) if value.startswith("{") else own[""]})
    model.write().overwrite().save(f"{path}/model")
    doc = spark.createDataFrame([(json.dumps(metadata or {}, default=str),)], "value string")
    doc.write.mode("overwrite").text(f"{path}/metadata")
    return path


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    """(model, metadata). A bare saved pipeline has empty metadata."""
    path = path.rstrip("/")
    if not path_exists(spark, f"{path}/model"):
        return PipelineModel.load(path), {}
    row = spark.read.option("wholetext", True).text(f"{path}/metadata").first()
    return PipelineModel.load(f"{path}/model"), json.loads(row[0]) if row else {}


def model_name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def discover_models(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """(model, path) of the sorted distinct paths matching any pattern."""
    paths = sorted({p for pattern in patterns for p in list_paths(spark, pattern)})
    return spark.createDataFrame([(model_name(p), p) for p in paths], "model string, path string")
