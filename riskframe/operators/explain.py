"""Explanations of fitted models: importances, Shapley contributions, roll-ups and audits.

Contributions are long tables (id, feature, impact). Per row and feature they add up, with the base
value, to the explained output.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F, types as T

from riskframe import functions as fx
from riskframe.operators.models import predict
from riskframe.operators.preprocess import TabularPreprocessorModel
from riskframe.operators.project import sample_rows
from riskframe.operators.ranking import dist_rank
from riskframe.session import scratch_path, stage_table


# ---- importances -------------------------------------------------------------------------------


def feature_names(model, n: int | None = None) -> list[str]:
    """Transformed names from the preprocessing stage, or f_0, f_1, ... without one."""
    stages = getattr(model, "stages", [model])
    for stage in stages:
        if isinstance(stage, TabularPreprocessorModel) and stage.getOrDefault("outputCol") == "features":
            return stage.feature_names
    width = n if n is not None else stages[-1].numFeatures
    return [f"f_{i}" for i in range(width)]


def model_importance(spark, model) -> DataFrame | None:
    """(feature, importance), largest first: tree importances or |coefficients|, else None."""
    final = getattr(model, "stages", [model])[-1]
    if hasattr(final, "featureImportances"):
        values = final.featureImportances.toArray()
    elif hasattr(final, "coefficients") and len(final.coefficients) == len(feature_names(model, len(final.coefficients))):
        values = np.abs(final.coefficients.toArray())
    else:
        return None
    names = feature_names(model, len(values))
    rows = [(n, float(v)) for n, v in zip(names, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


def permuted_rows(
    df: DataFrame, id_col: str, features: Sequence[str], n_repeats: int, seed: int
) -> DataFrame:
    """Copies of every row with one raw column replaced, (repeat, feature) naming the copy.

    In each repeat the row at rank r of one hash order takes the values of the row at rank r of
    another: a permutation of the whole table from two bucketed rankings and one join.
    """
    repeats = F.explode(F.sequence(F.lit(0), F.lit(n_repeats - 1))).alias("repeat")
    rows = df.select("*", repeats).withColumn("_k", fx.hash_key(f"{seed}:a", "repeat", id_col))
    donors = df.select(F.struct(*features).alias("_donor"), id_col, repeats).select(
        "repeat", "_donor", fx.hash_key(f"{seed}:b", "repeat", id_col).alias("_k")
    )
    here = dist_rank(rows, "_k", "_rank", by=["repeat"]).drop("_k")
    there = dist_rank(donors, "_k", "_rank", by=["repeat"]).drop("_k")
    joined = here.join(there, ["repeat", "_rank"]).drop("_rank")
    kept = [c for c in df.columns if c not in features]
    copies = joined.withColumn("feature", F.explode(F.array(*[F.lit(f) for f in features])))
    swapped = [
        F.when(F.col("feature") == f, F.col(f"_donor.{f}")).otherwise(F.col(f)).alias(f)
        for f in features
    ]
    return copies.select(*kept, *swapped, "repeat", "feature")


def permutation_importance(
    score, df: DataFrame, label: str, id_col: str, features: Sequence[str], n_repeats: int = 10, seed: int = 42
) -> DataFrame:
    """Mean drop in accuracy when one raw column is shuffled; `score` adds a `prediction` column."""
    hit = F.avg((F.col("prediction") == F.col(label)).cast("double"))
    base = score(df).agg(hit).first()[0]
    shuffled = score(permuted_rows(df, id_col, features, n_repeats, seed))
    per_repeat = shuffled.groupBy("feature", "repeat").agg(hit.alias("accuracy"))
    return (
        per_repeat.groupBy("feature")
        .agg(
            F.avg(F.lit(base) - F.col("accuracy")).alias("importance"),
            F.stddev_pop("accuracy").alias("importance_std"),
        )
        .orderBy(F.desc("importance"), "feature")
    )


# ---- contributions -----------------------------------------------------------------------------


def linear_contributions(
    encoded: DataFrame, id_col: str, coefficients: dict[str, float], means: dict[str, float]
) -> DataFrame:
    """Exact Shapley values of a linear margin: coefficient * (x - background mean)."""
    entries = [
        F.struct(
            F.lit(f).alias("feature"),
            (F.lit(c) * (F.col(f"`{f}`") - F.lit(means[f]))).alias("impact"),
        )
        for f, c in coefficients.items()
    ]
    return encoded.select(id_col, F.explode(F.array(*entries)).alias("e")).select(
        id_col, "e.feature", "e.impact"
    )


def linear_rows(
    encoded: DataFrame, id_col: str, coefficients: dict[str, float], means: dict[str, float]
) -> DataFrame:
    """The same within the row: (id, impacts, encoded values), arrays in the order of `coefficients`."""
    impacts = [F.lit(c) * (F.col(f"`{f}`") - F.lit(means[f])) for f, c in coefficients.items()]
    values = [F.col(f"`{f}`").cast("double") for f in coefficients]
    return encoded.select(id_col, F.array(*impacts).alias("impacts"), F.array(*values).alias("encoded"))


def column_means(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    row = df.agg(*[F.avg(F.col(f"`{c}`")).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return {c: row[f"m{i}"] for i, c in enumerate(columns)}


def tree_leaves(model) -> tuple[list[dict[str, np.ndarray]], float]:
    """Leaves of a fitted tree ensemble, and the expected output over the training cover.

    Read from the model's own saved node table, or from a model that gives its nodes in that form. The leaves come as one group of arrays per number of features
    on their paths: per leaf and feature the value interval, the bits of the categories allowed, and the
    share of cover that follows the path at that feature's splits. Boosted trees are in margin units, forests in
    units of the positive probability.
    """
    from pyspark.sql import SparkSession

    if hasattr(model, "node_rows"):
        nodes = model.node_rows()
    else:
        spark = SparkSession.active()
        path = scratch_path(spark, "trees")
        model.write().save(path)
        columns = ["treeID", "nodeData"] if hasattr(model, "treeWeights") else [F.lit(0).alias("treeID"), "*"]
        nodes = spark.read.parquet(f"{path}/data").select(*columns)
        if "nodeData" in nodes.columns:
            nodes = nodes.select("treeID", "nodeData.*")
        nodes = nodes.collect()  # the model itself, which the driver holds anyway
    weights = list(getattr(model, "treeWeights", [1.0]))
    forest = "GBT" not in type(model).__name__
    trees: dict[int, dict[int, object]] = {}
    for r in nodes:
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    groups: dict[int, list[tuple]] = {}
    base = 0.0
    free = (-math.inf, math.inf, -1, 1.0)
    for t, table in trees.items():
        scale = weights[t] / sum(weights) if forest else weights[t]
        stack = [(table[0], {})]
        while stack:
            node, parts = stack.pop()
            if node["leftChild"] < 0:
                stats = node["impurityStats"]
                value = scale * (stats[1] / sum(stats) if forest else node["prediction"])
                base += value * math.prod(p[3] for p in parts.values())
                if value:  # a leaf of nothing moves nothing, and may have no cover
                    groups.setdefault(len(parts), []).append((value, list(parts), list(parts.values())))
                continue
            left, right = table[node["leftChild"]], table[node["rightChild"]]
            f = node["split"]["featureIndex"]
            values = node["split"]["leftCategoriesOrThreshold"]
            categorical = node["split"]["numCategories"] > -1
            cover = left["rawCount"] + right["rawCount"]
            for child, goes_left in ((left, True), (right, False)):
                low, high, bits, share = parts.get(f, free)
                if categorical:
                    chosen = sum(1 << int(v) for v in values)
                    bits &= chosen if goes_left else ~chosen
                elif goes_left:
                    high = min(high, values[0])
                else:
                    low = max(low, values[0])
                stack.append((child, {**parts, f: (low, high, bits, share * child["rawCount"] / cover)}))
    arrays = []
    for d, leaves in sorted(groups.items()):
        if not d:
            continue  # a tree without a split moves the base only
        parts = np.array([[p[:2] + p[3:] for p in leaf[2]] for leaf in leaves], dtype=float)
        bits = [[p[2] for p in leaf[2]] for leaf in leaves]
        arrays.append(
            {
                "value": np.array([leaf[0] for leaf in leaves]),
                "feature": np.array([leaf[1] for leaf in leaves]),
                "low": parts[:, :, 0],
                "high": parts[:, :, 1],
                "share": parts[:, :, 2],
                # most models split numbers only
                "bits": np.array(bits, dtype=object) if any(x != -1 for row in bits for x in row) else None,
            }
        )
    return arrays, base


# Numbers held at a time while leaves meet rows.
LEAF_CELLS = 4_000_000


def leaf_impacts(x: np.ndarray, group: dict[str, np.ndarray], out: np.ndarray) -> None:
    """Add the contributions of a group of leaves to `out` (features x rows), leaves and rows at once.

    A leaf is a product over its path's features: 1 or 0 when the feature is known, its cover share when
    not. The Shapley value of feature i in such a product is (hit_i - share_i) times the integral over t in
    [0, 1] of the product over the others of share (1 - t) + hit t. That is a polynomial of degree d - 1, so
    Gauss-Legendre quadrature with d / 2 nodes is exact.
    """
    n, d = len(x), group["feature"].shape[1]
    at, weight = np.polynomial.legendre.leggauss((d + 1) // 2)
    at, weight = (at + 1) / 2, weight / 2
    step = max(1, LEAF_CELLS // (n * d))
    columns = np.ascontiguousarray(x.T)
    for start in range(0, len(group["value"]), step):
        part = slice(start, start + step)
        feature = group["feature"][part]
        v = columns[feature]
        hit = (v > group["low"][part][:, :, None]) & (v <= group["high"][part][:, :, None])
        if group["bits"] is not None:
            for i, j in zip(*np.nonzero(group["bits"][part] != -1)):
                bits = group["bits"][part][i, j]
                known = np.unique(v[i, j])
                allowed = known[[bool(bits >> int(c) & 1) for c in known]]
                hit[i, j] &= np.isin(v[i, j], allowed)
        hit = hit.astype(float)
        share = group["share"][part][:, :, None]
        total = np.zeros_like(hit)
        for t, w in zip(at, weight):
            factor = share * (1 - t) + hit * t
            total += w * factor.prod(axis=1, keepdims=True) / factor
        total *= (hit - share) * group["value"][part][:, None, None]
        for j in range(d):
            np.add.at(out, feature[:, j], total[:, j])


def tree_impacts(final) -> tuple[F.Column, float]:
    """(expression over `features` giving one contribution per transformed feature, base).

    Path-dependent contributions (Lundberg et al. 2018). The leaves travel to the tasks as flat arrays, as
    large as the model, and rows are only mapped, never shuffled.
    """
    from pyspark.sql import SparkSession

    leaves, base = tree_leaves(final)
    width = final.numFeatures
    model = SparkSession.active().sparkContext.broadcast(leaves)

    @F.pandas_udf("array<double>")
    def impacts(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        x = np.stack(vectors.to_numpy())
        out = np.zeros((width, len(x)))
        for group in model.value:
            leaf_impacts(x, group, out)
        return pd.Series(list(np.ascontiguousarray(out.T)))

    return impacts(vector_to_array("features")), base


def linear_impacts(final, ready_background: DataFrame) -> tuple[F.Column, float]:
    """The same for a linear margin: coefficient * (x - background mean)."""
    width = final.numFeatures
    coef = [float(c) for c in final.coefficients]
    x = vector_to_array("features")
    row = ready_background.agg(*[F.avg(x[i]).alias(f"m{i}") for i in range(width)]).first()
    means = [row[f"m{i}"] for i in range(width)]
    base = final.intercept + sum(c * m for c, m in zip(coef, means))
    centred = F.zip_with(x, F.lit(means), lambda v, m: v - m)
    return F.zip_with(centred, F.lit(coef), lambda v, c: v * c), base


def long_form(rows: DataFrame, id_col: str, names: Sequence[str]) -> DataFrame:
    """(id, feature, impact) from an `impacts` array in the order of `names`."""
    labels = F.array(*[F.lit(n) for n in names])
    exploded = rows.select(id_col, F.posexplode("impacts").alias("pos", "impact"))
    return exploded.select(id_col, F.element_at(labels, F.col("pos") + 1).alias("feature"), "impact")


def tree_contributions(model, df: DataFrame, id_col: str) -> tuple[DataFrame, float]:
    """((id, feature, impact), base) of a tree ensemble."""
    rows, names, base = row_impacts(model, df, None, id_col)
    return long_form(rows, id_col, names), base


def coalitions(n_features: int, nsamples: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """0/1 rows and their weights in the least squares fit, at most `nsamples` rows.

    Sizes are taken from the outside in (one feature or all but one first), where the kernel puts most of
    its weight: while all coalitions of the next pair of sizes fit, they enter with their exact weight.
    The other sizes are drawn with replacement, a coalition with its complement, in proportion to the
    kernel; a coalition shares their remaining weight by the number of times it was drawn.
    """
    m = n_features
    if m <= 1:
        return np.zeros((0, m), dtype=int), np.zeros(0)
    weight = {s: (m - 1) / (s * (m - s)) for s in range(1, m)}
    rows: list[np.ndarray] = []
    weights: list[float] = []
    open_sizes = list(range(1, m))
    for s in range(1, m // 2 + 1):
        pair = sorted({s, m - s})
        if len(rows) + len(pair) * math.comb(m, s) > nsamples:
            break
        for size in pair:
            for chosen in itertools.combinations(range(m), size):
                row = np.zeros(m, dtype=int)
                row[list(chosen)] = 1
                rows.append(row)
                weights.append(weight[size] / math.comb(m, size))
            open_sizes.remove(size)
    left = nsamples - len(rows)
    if open_sizes and left > 1:
        rng = np.random.default_rng(seed)
        mass = np.array([weight[s] for s in open_sizes])
        drawn: dict[tuple, int] = {}
        total = 0
        # as many draws as rows are left; a repeated draw adds to its row's weight
        for _ in range(left // 2):
            row = np.zeros(m, dtype=int)
            row[rng.choice(m, rng.choice(open_sizes, p=mass / mass.sum()), replace=False)] = 1
            for r in (tuple(row), tuple(1 - row)):
                drawn[r] = drawn.get(r, 0) + 1
                total += 1
        rows += [np.array(r) for r in drawn]
        weights += [mass.sum() * n / total for n in drawn.values()]
    return np.array(rows).reshape(-1, m), np.array(weights)


def kernel_weights(masks: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linear map from coalition values to contributions: phi = a @ (v - v0) + b * (v1 - v0).

    The weighted least squares fit constrained to sum to v1 - v0 is linear in the values and its matrix
    depends on the coalitions alone, so it is solved once and not per row.
    """
    m = masks.shape[1]
    if m == 1:  # a single feature takes everything
        return np.zeros((1, 0)), np.ones(1)
    z = masks[:, :-1] - masks[:, -1:]
    solve = np.linalg.pinv(z.T @ (w[:, None] * z)) @ (z.T * w)
    a = np.vstack([solve, -solve.sum(0)])
    last = masks[:, -1].astype(float)
    b = np.append(-solve @ last, 1.0 + (solve @ last).sum())
    return a, b


def kernel_impacts(
    score,
    df: DataFrame,
    background: DataFrame,
    id_col: str,
    features: Sequence[str],
    max_background: int = 20,
    nsamples: int = 100,
    seed: int = 42,
) -> tuple[DataFrame, float]:
    """((id, impacts in the order of `features`), base) of any model, by weighted coalitions.

    After Lundberg & Lee (2017).

    `score` adds `probability` to a table of raw features. Every row meets every coalition and
    background row in one exploded table that is scored in one job and added up per id; ids with unknown
    outputs, if any, are averaged per coalition in a second one. The background and the coalitions are bounded
    parameters of the operator.
    """
    features = list(features)
    sample = sample_rows(background.select(id_col, *features), max_background, id_col, seed)
    held = sample.orderBy(id_col).collect()
    fields = [f for f in df.schema.fields if f.name in features]
    fields = sorted(fields, key=lambda f: features.index(f.name))
    filler = F.array(
        *[F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in fields]) for r in held]
    )
    masks, kernel = coalitions(len(features), nsamples, seed)
    every = np.vstack([masks, np.ones((1, len(features)), dtype=int)])
    a, b = kernel_weights(masks, kernel)
    # one column per coalition; the last is the full coalition, the row's own output
    weights = [[float(x) for x in row] for row in np.column_stack([a, b])]
    carried = [f"_w{j}" for j in range(len(features))]
    mask_rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("_c"),
                F.lit([int(b) for b in row]).alias("m"),
                *[F.lit(weights[j][i]).alias(w) for j, w in enumerate(carried)],
            )
            for i, row in enumerate(every)
        ]
    )
    # the rows are placed by id once, before they multiply; every grouping below is then local
    spark = df.sparkSession
    parallel = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
    )

    def scored(rows: DataFrame, kept: list[str]) -> DataFrame:
        """Every row under every coalition and background row, with the coalition's columns in `kept`."""
        placed = rows.select(id_col, *features).repartition(parallel, id_col).withColumn("_m", F.explode(mask_rows))
        grid = placed.select(id_col, *features, "_m", *[f"_m.{c}" for c in kept]).withColumn("_b", F.explode(filler))
        mixed = grid.select(
            id_col,
            *kept,
            *[
                F.when(F.element_at("_m.m", j + 1) == 1, F.col(f)).otherwise(F.col(f"_b.{f}")).alias(f)
                for j, f in enumerate(features)
            ],
        )
        return score(mixed)

    base = score(sample).agg(F.avg("probability")).first()[0]
    # contributions are linear in the outputs: an id needs one sum per feature, and no table of its coalitions
    sums = [F.sum(F.col(w) * F.col("probability")).alias(w) for w in carried]
    per_row = scored(df, carried).groupBy(id_col).agg(
        *sums, F.count(F.lit(1)).alias("_n"), F.count("probability").alias("_known")
    )
    times = F.col("_n") / len(every)  # background rows, and as often as the id is repeated
    means = F.array(*[F.col(w) / times - F.lit(base) * math.fsum(weights[j]) for j, w in enumerate(carried)])
    gap = (F.col("_known") < F.col("_n")).alias("_gap")
    per_row = stage_table(per_row.select(id_col, means.alias("impacts"), gap), "kernel")
    rows = per_row.filter("not _gap").drop("_gap")
    gaps = per_row.filter("_gap").select(F.col(id_col).alias("_id"))
    if gaps.isEmpty():
        return rows, base
    # ids with unknown outputs: the known ones of a coalition are averaged first
    some = df.join(gaps, F.col(id_col).eqNullSafe(F.col("_id")), "left_semi")
    values = scored(some, ["_c"]).groupBy(id_col, "_c").agg((F.avg("probability") - base).alias("_v"))
    listed = values.groupBy(id_col).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_c", "_v"))), lambda e: e["_v"]
        ).alias("_values")
    )
    matrix = F.array(*[F.lit(row) for row in weights])

    def dot(row):
        products = F.zip_with(row, F.col("_values"), lambda w, v: w * v)
        return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)

    return rows.unionByName(listed.select(id_col, F.transform(matrix, dot).alias("impacts"))), base


def kernel_contributions(
    score, df: DataFrame, background: DataFrame, id_col: str, features: Sequence[str], **options
) -> tuple[DataFrame, float]:
    """((id, feature, impact), base) of any model."""
    rows, base = kernel_impacts(score, df, background, id_col, features, **options)
    return long_form(rows, id_col, features), base


def base_value(scored_background: DataFrame, score: str = "probability") -> DataFrame:
    """Expected positive-class output over the background."""
    return scored_background.agg(F.avg(score).alias("base_value"))


def choose_explainer(model) -> str:
    """'linear', 'tree' or 'kernel' by the fitted classifier at the end of the pipeline."""
    stages = getattr(model, "stages", [model])
    kinds = [type(s).__name__ for s in stages]
    if any(k in kinds[-1] for k in ("GBT", "RandomForest", "DecisionTree")):
        return "tree"
    if "LogisticRegression" in kinds[-1] and not any("SVC" in k for k in kinds):
        return "linear"
    return "kernel"


def row_impacts(
    model, df: DataFrame, background: DataFrame | None, id_col: str, features: Sequence[str] = (), **options
) -> tuple[DataFrame, list[str], float]:
    """(rows with an `impacts` array, the names of its entries, base) by the fitting explainer.

    Linear and boosted models are explained in margin units, forests and all others in probability.
    Trees and linear models are mapped over the rows, which keep all columns of `df`; the kernel
    method returns the id and the impacts.
    """
    kind = choose_explainer(model)
    if kind == "kernel":
        rows, base = kernel_impacts(
            lambda t: predict(model, t), df, background, id_col, features, **options
        )
        return rows, list(features), base
    stages = getattr(model, "stages", [model])
    final, prepare = stages[-1], PipelineModel(list(stages[:-1]))
    names = feature_names(model, final.numFeatures)
    if kind == "tree":
        impacts, base = tree_impacts(final)
    else:
        impacts, base = linear_impacts(final, prepare.transform(background))
    rows = prepare.transform(df).withColumn("impacts", impacts)
    return rows.select(*df.columns, "features", "impacts"), names, base


def explain_rows(
    model, df: DataFrame, background: DataFrame, id_col: str, features: Sequence[str], **options
) -> tuple[DataFrame, float]:
    """((id, feature, impact), base) by the explainer that fits the model."""
    rows, names, base = row_impacts(model, df, background, id_col, features, **options)
    return long_form(rows, id_col, names), base


# ---- roll-ups and audits -----------------------------------------------------------------------


def aggregate_contributions(
    contributions: DataFrame, id_col: str, raw_names: dict[str, str]
) -> DataFrame:
    """Sum the pieces of each raw feature: one-hot parts and missing flags join their feature."""
    pairs = [F.lit(x) for kv in raw_names.items() for x in kv]
    raw = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("feature")), F.col("feature")) if pairs else F.col("feature")
    return contributions.groupBy(id_col, raw.alias("feature")).agg(F.sum("impact").alias("impact"))


def top_contributions(aggregated: DataFrame, id_col: str, k: int = 8) -> DataFrame:
    """(id, contributions map, top_features array) per row; a row has as many entries as features."""
    pairs = F.collect_list(F.struct("feature", "impact"))
    return aggregated.groupBy(id_col).agg(
        F.map_from_entries(F.array_sort(pairs)).alias("contributions"),
        fx.top_by_magnitude(pairs, k).alias("top_features"),
    )


def roll_up(names: Sequence[str], raw_names: dict[str, str], impacts: str = "impacts"):
    """Array of (feature, impact) per raw feature from an `impacts` array, within the row."""
    positions: dict[str, list[int]] = {}
    for i, n in enumerate(names):
        positions.setdefault(raw_names.get(n, n), []).append(i)
    return F.array(
        *[
            F.struct(
                F.lit(raw).alias("feature"),
                sum((F.col(impacts)[i] for i in at[1:]), F.col(impacts)[at[0]]).alias("impact"),
            )
            for raw, at in positions.items()
        ]
    )


def global_summary(contributions: DataFrame) -> DataFrame:
    """Mean |impact| per feature, largest first."""
    return (
        contributions.groupBy("feature")
        .agg(F.avg(F.abs("impact")).alias("mean_abs_shap"))
        .orderBy(F.desc("mean_abs_shap"), "feature")
    )


def beeswarm(rows: DataFrame, names: Sequence[str], id_col: str, k: int) -> DataFrame:
    """(id, feature, impact, value) for the k features with the largest mean |impact|.

    `rows` has the arrays `impacts` and `encoded` in the order of `names`; impact and value of a feature leave
    the row together. Ties in the mean go by name.
    """
    means = rows.agg(*[F.avg(F.abs(F.col("impacts")[i])).alias(f"m{i}") for i in range(len(names))]).first()
    size = lambda i: round(means[f"m{i}"] or 0.0, 9)
    top = sorted(range(len(names)), key=lambda i: (-size(i), names[i]))[:k]
    entries = [
        F.struct(F.lit(names[i]).alias("feature"), F.col("impacts")[i].alias("impact"), F.col("encoded")[i].alias("value"))
        for i in top
    ]
    return rows.select(id_col, F.explode(F.array(*entries)).alias("e")).select(id_col, "e.*")


def uncertain_samples(
    scored: DataFrame,
    id_col: str,
    n: int,
    ids: DataFrame | Sequence | None = None,
    score: str = "probability",
) -> DataFrame:
    """The n rows whose probability is nearest one half, or the rows with the given ids.

    Ids come as a short list or as a table with the id column.
    """
    if isinstance(ids, DataFrame):
        return scored.join(ids.select(id_col), id_col, "left_semi")
    if ids:
        return scored.filter(F.col(id_col).isin(list(ids)))
    return scored.orderBy(F.abs(F.col(score) - 0.5), id_col).limit(n)


def waterfall(contributions: DataFrame, id_col: str, base: float) -> DataFrame:
    """Ordered contributions of each row with the running total from the base value."""
    w = Window.partitionBy(id_col).orderBy(F.desc(F.abs("impact")), "feature")
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return contributions.select(
        id_col,
        F.row_number().over(w).alias("step"),
        "feature",
        "impact",
        F.lit(base).alias("base_value"),
        (F.lit(base) + F.sum("impact").over(running)).alias("running_total"),
    )


def waterfall_steps(parts, base: float) -> F.Column:
    """The same within the row: array of (step, feature, impact, base_value, running_total) from (feature, impact)."""
    ordered = fx.top_by_magnitude(parts, 2**31 - 1)

    def steps(found):
        def step(x, i):
            upto = F.aggregate(F.slice(found, 1, i + 1), F.lit(float(base)), lambda a, y: a + y["impact"])
            return F.struct(
                (i + 1).alias("step"), x["feature"].alias("feature"), x["impact"].alias("impact"),
                F.lit(float(base)).alias("base_value"), upto.alias("running_total"),
            )

        return F.transform(found, step)

    return F.element_at(F.transform(F.array(ordered), steps), 1)
