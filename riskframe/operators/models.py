"""Classifiers: boosted trees on histograms, presets over Spark ML, a kernel-approximating SVM and nearest neighbours.

All of them are Estimators on a feature vector and add `prediction` and a two-class `probability`
vector, so the same fit, score and evaluate code serves every entry of the registry.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel, Transformer
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LinearSVCModel,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.ml.wrapper import JavaParams
from pyspark.sql import DataFrame, functions as F

from riskframe.operators.boosting import HistogramGBTClassifier
from riskframe.operators.forest import PureForestClassifier
from riskframe.operators.hinge import fit_machines, held_out_margins, packed
from riskframe.operators.metrics import score_to_probability
from riskframe.operators.neighbors import knn_vote
from riskframe.operators.preprocess import fit_numeric, preprocessor, TabularPreprocessorModel
from riskframe.operators.resample import smote
from riskframe.operators.target_stats import fit_target_statistics, ordered_statistics
from riskframe.session import scratch_path, sized, stage_table
from riskframe.spec import RANDOM_SEED, FeatureSpec

TREE_MODELS = ("xgboost", "lightgbm", "catboost", "random_forest")
MODEL_NAMES = (*TREE_MODELS, "svm", "knn")
SPARK_DEPTH = 30  # of Spark's own trees at most


def _p(name: str, doc: str, converter) -> Param:
    return Param(Params._dummy(), name, doc, converter)


SINE = [(-1) ** i * (2 * math.pi) ** (2 * i + 1) / math.factorial(2 * i + 1) for i in range(10)]


def _cosines(turns: np.ndarray, scale: float) -> np.ndarray:
    """`scale` times the cosine of angles in full turns, in place; of angles that are not small, numpy's own takes three times as long."""
    whole = np.rint(turns)
    turns -= whole
    np.abs(turns, out=turns)
    np.subtract(0.25, turns, out=turns)  # cos(2 pi t) = sin(2 pi (1/4 - |t|)), whose series is short between -1/4 and 1/4
    square = np.multiply(turns, turns, out=whole)
    out = square * (scale * SINE[-1])
    for c in SINE[-2:0:-1]:
        out += scale * c
        out *= square
    out += scale * SINE[0]
    out *= turns
    return out


class RandomFourierFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """cos(w.x + b) features whose inner products approximate the RBF kernel (Rahimi & Recht 2007)."""

    inputCol = _p("inputCol", "feature vector", TypeConverters.toString)
    outputCol = _p("outputCol", "mapped vector", TypeConverters.toString)
    dim = _p("dim", "number of random features", TypeConverters.toInt)
    gamma = _p("gamma", "kernel width", TypeConverters.toFloat)
    seed = _p("seed", "seed of the projection", TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCol="features", outputCol="rff", dim=128, gamma=1.0, seed=RANDOM_SEED):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="rff", dim=128, gamma=1.0, seed=RANDOM_SEED)
        self._set(**self._input_kwargs)

    def mapping(self):
        """The map of a matrix of points, the same in every task."""
        dim, gamma = self.getOrDefault("dim"), self.getOrDefault("gamma")
        seed = self.getOrDefault("seed")

        held: list[tuple] = []  # directions and phases in full turns, drawn once a task

        def mapped(points: np.ndarray) -> np.ndarray:
            if not held:
                rng = np.random.default_rng(seed)
                w = rng.normal(scale=math.sqrt(2 * gamma), size=(points.shape[1], dim))
                held.append((w / (2 * math.pi), rng.uniform(0, 2 * math.pi, dim) / (2 * math.pi)))
            w, b = held[0]
            z = points @ w
            z += b
            return _cosines(z, math.sqrt(2 / dim))

        return mapped

    def _transform(self, df: DataFrame) -> DataFrame:
        mapping = self.mapping()

        @F.pandas_udf("array<double>")
        def project(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            return pd.Series(list(mapping(np.stack(x.to_numpy()))))

        mapped = array_to_vector(project(vector_to_array(self.getOrDefault("inputCol"))))
        return df.withColumn(self.getOrDefault("outputCol"), mapped)


class RandomMaclaurinFeatures(RandomFourierFeatures):
    """Products of random signs' projections, whose inner products estimate (gamma x.y)^3 (Kar & Karnick 2012).

    The width is `dim` for any number of features.
    """

    def mapping(self):
        dim, gamma = self.getOrDefault("dim"), self.getOrDefault("gamma")
        seed = self.getOrDefault("seed")

        held: list[np.ndarray] = []  # signs, drawn once a task

        def mapped(points: np.ndarray) -> np.ndarray:
            points = points * math.sqrt(gamma)
            if not held:
                held.append(np.random.default_rng(seed).choice([-1.0, 1.0], size=(3, points.shape[1], dim)))
            signs = held[0]
            z = points @ signs[0]
            z *= points @ signs[1]
            z *= points @ signs[2]
            z /= math.sqrt(dim)
            return z

        return mapped


def _kernel_width(df: DataFrame, gamma) -> float:
    """Resolve 'scale' (1 / (features * variance over all entries)) and 'auto' (1 / features)."""
    if not isinstance(gamma, str):
        return float(gamma)
    s = df.agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("features")).alias("s"))
    row = s.first()["s"]
    mean, var = np.array(row["mean"]), np.array(row["variance"])
    n, width = row["count"], len(mean)
    if gamma == "auto":
        return 1.0 / width
    total = (var * (n - 1) / n + (mean - mean.mean()) ** 2).mean()
    return 1.0 / (width * total) if total > 0 else 1.0


class KernelSvmClassifier(Estimator):
    """Linear SVM on a kernel feature map, with Platt probabilities from held-out margins.

    The RBF kernel is approximated by random Fourier features, the polynomial one of degree 3 by random
    Maclaurin features; both take `gamma` and have `dim` columns whatever the number of features.
    The class is the sign of the margin; the probability is a logistic fit to margins of rows the
    margin model did not see.
    """

    C = _p("C", "inverse regularisation", TypeConverters.toFloat)
    dim = _p("dim", "number of random features", TypeConverters.toInt)
    seed = _p("seed", "", TypeConverters.toInt)
    maxIter = _p("maxIter", "", TypeConverters.toInt)
    folds = _p("folds", "folds for the margins behind the probabilities", TypeConverters.toInt)

    def __init__(self, C=1.0, gamma="scale", kernel="rbf", dim=128, seed=RANDOM_SEED, maxIter=50, folds=3):
        super().__init__()
        if kernel not in ("rbf", "poly"):
            raise ValueError("kernel must be rbf or poly")
        self.gamma, self.kernel = gamma, kernel
        self._set(C=float(C), dim=dim, seed=seed, maxIter=maxIter, folds=folds)

    def _margin_model(self, weights: np.ndarray) -> LinearSVCModel:
        """Spark's model of the given coefficients and intercept (last)."""
        settings = LinearSVC(
            featuresCol="kernel_features", rawPredictionCol="margin", maxIter=self.getOrDefault("maxIter")
        )
        made = JavaParams._new_java_obj(
            "org.apache.spark.ml.classification.LinearSVCModel", settings.uid, Vectors.dense(weights[:-1]), float(weights[-1])
        )
        return settings._copyValues(LinearSVCModel(made))

    def _fit(self, df: DataFrame) -> PipelineModel:
        seed, folds = self.getOrDefault("seed"), self.getOrDefault("folds")
        kind = RandomFourierFeatures if self.kernel == "rbf" else RandomMaclaurinFeatures
        mapper = kind(
            outputCol="kernel_features",
            dim=self.getOrDefault("dim"),
            gamma=_kernel_width(df, self.gamma),
            seed=seed,
        )
        x = vector_to_array("features")
        part = F.pmod(F.xxhash64(F.lit(seed), x), F.lit(folds))
        blocks = packed(df.select("label", part.alias("fold"), x.alias("x")))
        try:
            n = blocks.map(lambda b: b[0]).sum()
            reg = 1.0 / (self.getOrDefault("C") * max(n, 1))
            # the machines behind the probabilities, and the one that is kept, all by the same scans
            fitted = fit_machines(blocks, mapper.mapping(), folds, reg, self.getOrDefault("maxIter"))
            held_out = held_out_margins(df.sparkSession, blocks, mapper.mapping(), fitted)
        finally:
            blocks.unpersist()
        margin = array_to_vector(F.array(-F.col("margin"), F.col("margin")))
        platt = LogisticRegression(
            featuresCol="margin", predictionCol="platt_prediction", rawPredictionCol="platt_raw"
        ).fit(held_out.select("label", margin.alias("margin")))
        return PipelineModel([mapper, self._margin_model(fitted[-1]), platt])


class KnnModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Votes of the k nearest training rows; the training table stays a written table."""

    stored = ("trainPath",)
    trainPath = _p("trainPath", "written training rows", TypeConverters.toString)
    k = _p("k", "", TypeConverters.toInt)
    weights = _p("weights", "uniform or distance", TypeConverters.toString)
    p = _p("p", "1 Manhattan, 2 Euclidean", TypeConverters.toInt)

    def _transform(self, df: DataFrame) -> DataFrame:
        k, weights, p = (self.getOrDefault(n) for n in ("k", "weights", "p"))
        train = df.sparkSession.read.parquet(self.getOrDefault("trainPath"))
        x = vector_to_array("features")
        base = train.select(F.col("row").alias("bid"), F.col("x").alias("bv"), F.col("label").alias("bp"))
        # equal feature vectors get equal votes, so the vector's hash is the join key; rows that share it
        # are many on their own side only, which Spark splits at runtime
        keyed = df.withColumn("_key", F.md5(x.cast("string")))
        queries = keyed.groupBy("_key").agg(F.any_value(x).alias("x"))
        votes = knn_vote(
            queries, base, "bp", k=k, weights=weights, p=p,
            query_id="_key", base_id="bid", query_vec="x", base_vec="bv",
        )
        voted = keyed.join(votes.withColumnRenamed("probability", "_vote"), "_key").drop("_key")
        probability = array_to_vector(F.array(1 - F.col("_vote"), F.col("_vote")))
        return (
            voted.withColumn("probability", probability)
            .withColumn("prediction", (F.col("_vote") > 0.5).cast("double"))
            .drop("_vote")
        )


class KnnClassifier(Estimator):
    def __init__(self, k=5, weights="uniform", p=2):
        super().__init__()
        self.settings = {"k": k, "weights": weights, "p": p}

    def _fit(self, df: DataFrame) -> KnnModel:
        spark = df.sparkSession
        path = scratch_path(spark, "knn-train")
        x = vector_to_array("features")
        # equal rows are numbered apart; the number only orders ties
        df.select(
            F.monotonically_increasing_id().alias("row"), F.col("label").cast("double"), x.alias("x")
        ).write.parquet(path)
        model = KnnModel()
        model._set(trainPath=path, **self.settings)
        return model


def make_classifier(name: str, seed: int = RANDOM_SEED, **settings):
    """Registry entry as an Estimator; `settings` override the preset.

    The boosting presets take the public defaults of the three usual boosting libraries: trees grown by depth, by
    leaf, and symmetric ones over ordered label statistics. `gbt` is Spark's own boosting. The forest grows until its leaves
    are pure; with a `maxDepth` up to 30 and no `minRowsToSplit` it is Spark's.
    """
    presets = {
        "xgboost": dict(growth="depth", maxIter=100, maxDepth=6, stepSize=0.3, regLambda=1.0, minChildWeight=1.0),
        "lightgbm": dict(
            growth="leaf", maxIter=100, maxLeaves=31, maxDepth=0, stepSize=0.1, regLambda=0.0, minChildWeight=1e-3, minInstancesPerNode=20
        ),
        "catboost": dict(growth="symmetric", maxIter=200, maxDepth=6, stepSize=0.05, regLambda=3.0, minChildWeight=0.0),
        "gbt": dict(maxIter=100, maxDepth=6, stepSize=0.3),
        "random_forest": dict(numTrees=100, maxDepth=None, featureSubsetStrategy="sqrt"),
        "svm": dict(C=1.0, gamma="scale", kernel="rbf"),
        "knn": dict(k=5, weights="uniform", p=2),
        "logistic": dict(maxIter=100, regParam=0.0, elasticNetParam=0.0),
    }
    if name not in presets:
        raise ValueError(f"unknown model {name!r}; one of {sorted(presets)}")
    options = {**presets[name], **settings}
    if name == "knn":
        return KnnClassifier(**options)
    if name == "svm":
        return KernelSvmClassifier(seed=seed, **options)
    if name == "logistic":
        return LogisticRegression(featuresCol="features", labelCol="label", **options)
    if name == "random_forest" and (options["maxDepth"] is None or options["maxDepth"] > SPARK_DEPTH or "minRowsToSplit" in options):
        return PureForestClassifier(seed=seed, **options)
    if name in ("random_forest", "gbt"):
        tree = RandomForestClassifier if name == "random_forest" else GBTClassifier
        return tree(featuresCol="features", labelCol="label", seed=seed, **options)
    made = HistogramGBTClassifier(seed=seed, **options)
    made.encoding = "ordered" if name == "catboost" else "one_hot"
    return made


def get_models(seed: int = RANDOM_SEED) -> dict:
    return {name: make_classifier(name, seed) for name in MODEL_NAMES}


def ordered_encoder(df: DataFrame, spec: FeatureSpec, seed: int = RANDOM_SEED) -> tuple[PipelineModel, DataFrame]:
    """Fitted stages that replace each category by its smoothed label mean, beside the scaled numbers, and the
    training rows' own features.

    The categorical treatment of the third boosting preset, in place of one-hot columns. A training row's
    categories are encoded by the labels of the rows before it in a hash order, scored rows by all training rows.
    """
    numeric = TabularPreprocessorModel.of(fit_numeric(df, spec.numeric), [], "numeric_features")
    cats = list(spec.categorical)
    n, positive = df.agg(F.count("label"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    prior = positive / n if n else 0.5
    means = fit_target_statistics(df, cats, "label", prior, n)
    assemble = VectorAssembler(
        inputCols=["numeric_features", *[f"{c}__target" for c in cats]], outputCol="features"
    )
    ordered = ordered_statistics(df, cats, "label", spec.id, prior, seed=seed, rows=n)
    ready = assemble.transform(numeric.transform(ordered))
    return PipelineModel([numeric, means, assemble]), ready


def fit_model(
    train: DataFrame,
    spec: FeatureSpec,
    classifier,
    resample: bool = False,
    seed: int = RANDOM_SEED,
    encoding: str | None = None,
    prepare=None,
) -> PipelineModel:
    """Preprocessing and classifier fitted on the training rows only.

    Oversampling happens between the two and only here, so it never touches rows that are scored. With ordered
    encoding, which the third boosting preset has by default, see `ordered_encoder`.

    `prepare`, a preprocessor fitted on these rows, saves fitting it again.
    """
    encoding = encoding or getattr(classifier, "encoding", "one_hot")
    rows = train.withColumn("label", F.col(spec.label).cast("double"))
    if encoding == "ordered":
        prepare, ready = ordered_encoder(rows, spec, seed)
    else:
        prepare = prepare or preprocessor(spec).fit(rows)
        ready = prepare.transform(rows)
    if resample:
        grown = smote(
            ready.select(spec.id, "label", vector_to_array("features").alias("x")),
            "label", spec.id, "x", seed=seed,
        )
        ready = stage_table(grown, "resampled").select("label", array_to_vector("x").alias("features"))
    else:
        ready = ready.select("label", "features")
    # counted ahead of the encoding, which adds no rows, and held once only: by tasks of bounded rows
    ready = sized(ready, ready.count()).persist()
    try:
        fitted = classifier.fit(ready)
    finally:
        ready.unpersist()
    stages = list(prepare.stages) if isinstance(prepare, PipelineModel) else [prepare]
    stages += list(fitted.stages) if isinstance(fitted, PipelineModel) else [fitted]
    return PipelineModel(stages)


def predict(model, df: DataFrame, margin: str = "sigmoid") -> DataFrame:
    """The given columns plus `prediction` (int) and `probability` of the positive class.

    A model with a bare margin gets its sigmoid, or with `margin="minmax"` the margin scaled over the batch.
    """
    scored = model.transform(df)
    if "probability" in scored.columns:
        plain = scored.schema["probability"].dataType.typeName() == "double"
        probability = F.col("probability") if plain else vector_to_array("probability")[1]
    elif "rawPrediction" in scored.columns:
        bare = scored.withColumn("_margin", vector_to_array("rawPrediction")[1])
        scored, probability = score_to_probability(bare, "_margin", margin), F.col("probability")
    else:
        probability = F.lit(0.0)
    return scored.select(
        *df.columns,
        F.col("prediction").cast("int").alias("prediction"),
        probability.alias("probability"),
    )
