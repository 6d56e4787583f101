"""Imputation with missing flags, scaling and one-hot encoding.

`fit` reads the table three times: moments, null counts and rank sketches of all numeric columns in
one aggregate, exact medians, and one count per (column, value) of the categorical columns that
yields the mode, the flags and the category lists together. What it keeps is a few numbers per column, and for a column
of very many categories a written table. `transform` is a single projection with those numbers as literals: no join, no
shuffle, any table size; only wide columns are joined to their tables.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from riskframe.functions import nan_to_null, present
from riskframe.operators.lookup import looked_up
from riskframe.operators.ranking import dist_position, exact_quantiles, sketch_aggregates
from riskframe.session import collect_bounded, scratch_path, stage_table

# Up to this many categories become one expression each; a wider column is looked up in a written index and becomes
# a sparse block of the feature vector.
WIDE = 1_000


def value_counts(df: DataFrame, columns) -> DataFrame:
    """(feature, value, n) for all columns in one pass; values as text, nulls included."""
    entries = [
        F.struct(F.lit(c).alias("feature"), present(df, c).cast("string").alias("value"))
        for c in columns
    ]
    return (
        df.select(F.explode(F.array(*entries)).alias("e"))
        .groupBy("e.feature", "e.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def one_hot_long(df: DataFrame, id_col: str, columns) -> DataFrame:
    """Sparse form of the encoding for very wide domains: one (id, feature, category) row per cell."""
    entries = [
        F.struct(F.lit(c).alias("feature"), present(df, c).cast("string").alias("category"))
        for c in columns
    ]
    return (
        df.select(id_col, F.explode(F.array(*entries)).alias("e"))
        .select(id_col, "e.feature", "e.category")
        .filter("category is not null")
    )


def _typed(value: str, dtype: T.DataType):
    if isinstance(dtype, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return int(value)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return float(value)
    if isinstance(dtype, T.BooleanType):
        return value == "true"
    return value


def _category_name(value) -> str:
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return str(value).lower() if isinstance(value, bool) else str(value)


def fit_numeric(df: DataFrame, columns, approx: bool = False) -> list[dict]:
    """Median, missing flag, and mean and deviation after imputation, per numeric column."""
    columns = list(columns)
    if not columns:
        return []
    df = df.select(*[nan_to_null(F.col(c).cast("double")).alias(c) for c in columns])
    aggs = [F.count(F.lit(1)).alias("rows"), *sketch_aggregates(columns)]
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"mean_{i}"), F.var_pop(x).alias(f"var_{i}")]
        if approx:
            aggs.append(F.percentile_approx(x, 0.5, 10_000).alias(f"med_{i}"))
    s = df.agg(*aggs).first()
    medians = (
        {c: s[f"med_{i}"] for i, c in enumerate(columns)}
        if approx
        else {c: q[0] for c, q in exact_quantiles(df, columns, sketch=s).items()}
    )
    rows, out = s["rows"], []
    for i, c in enumerate(columns):
        n = s[f"n_{i}"]
        if not n:
            continue  # nothing to learn from a column without values
        median, gaps = float(medians[c]), rows - n
        # moments of the imputed column, from those of the present values
        mean = (n * s[f"mean_{i}"] + gaps * median) / rows
        var = (
            n * (s[f"var_{i}"] + (s[f"mean_{i}"] - mean) ** 2) + gaps * (median - mean) ** 2
        ) / rows
        rate = gaps / rows
        out.append(
            {
                "column": c,
                "median": median,
                "mean": mean,
                "std": math.sqrt(var) or 1.0,
                "flag": gaps > 0,
                "flag_mean": rate,
                "flag_std": math.sqrt(rate * (1 - rate)) or 1.0,
            }
        )
    return out


def fit_categorical(df: DataFrame, columns) -> list[dict]:
    """Mode (smallest on a tie), missing flag and the sorted categories, per categorical column.

    One aggregate counts the values of all columns. Where every column has at most WIDE of them, the counts are few rows
    and give everything. A wider column keeps its mode and flag from the distributed counts; its sorted values and their
    indexes are a written table (`table`), and the model holds only their number.
    """
    columns = list(columns)
    if not columns:
        return []
    counts = value_counts(df, columns)
    bound = len(columns) * (WIDE + 1)
    few = counts.limit(bound + 1).toArrow()
    if few.num_rows > bound:
        counts = stage_table(counts, "categories")
        summary = _summaries(df, counts, columns)
        narrow = [c for c in columns if summary[c]["width"] <= WIDE]
        rows = counts.filter(F.col("feature").isin(narrow)).collect() if narrow else []
    else:
        rows = few.to_pylist()
        summary = _summed(df, rows, columns)
    values: dict[str, list] = {c: [] for c in columns}
    for r in rows:
        if r["value"] is not None:
            values[r["feature"]].append(r["value"])
    out = []
    for c in columns:
        dtype, found = df.schema[c].dataType, summary[c]
        if not found["width"]:
            continue
        wide = found["width"] > WIDE
        fit = {
            "column": c,
            "mode": _typed(found["mode"], dtype),
            "categories": [] if wide else sorted(_typed(v, dtype) for v in values[c]),
            "wide": wide,
            "flag": found["flag"],
            "real": isinstance(dtype, (T.DoubleType, T.FloatType)),
        }
        if wide:
            source = counts if few.num_rows > bound else df.sparkSession.createDataFrame(few)
            fit.update(_indexed(source, c), rows=found["rows"])
        out.append(fit)
    return out


def _order(df: DataFrame, column: str, value):
    """Numbers sort as numbers, anything else as text."""
    return float(value) if isinstance(df.schema[column].dataType, T.NumericType) else value


def _summed(df: DataFrame, rows: list[dict], columns) -> dict[str, dict]:
    """Mode, width, flag and rows per column from its collected counts."""
    out = {}
    for c in columns:
        found = [r for r in rows if r["feature"] == c]
        have = [r for r in found if r["value"] is not None]
        mode = min(have, key=lambda r: (-r["n"], _order(df, c, r["value"])), default=None)
        out[c] = {"mode": mode and mode["value"], "width": len(have), "flag": len(have) < len(found), "rows": sum(r["n"] for r in found)}
    return out


def _summaries(df: DataFrame, counts: DataFrame, columns) -> dict[str, dict]:
    """The same from counts that stay distributed: one aggregate, one row a column."""
    numeric = [c for c in columns if isinstance(df.schema[c].dataType, T.NumericType)]
    number = F.when(F.col("feature").isin(numeric), F.col("value").try_cast("double"))
    first = F.min(F.when(F.col("value").isNotNull(), F.struct((-F.col("n")).alias("n"), number.alias("number"), "value")))
    found = counts.groupBy("feature").agg(
        first["value"].alias("mode"), F.count("value").alias("width"), F.bool_or(F.col("value").isNull()).alias("flag"), F.sum("n").alias("rows")
    )
    empty = {"mode": None, "width": 0, "flag": False, "rows": 0}
    return {c: empty for c in columns} | {r["feature"]: r.asDict() for r in found.collect()}


def _indexed(counts: DataFrame, column: str) -> dict:
    """Written (value, n, index) of a wide column, in the order of the values, and their number."""
    own = counts.filter((F.col("feature") == column) & F.col("value").isNotNull()).select("value", "n")
    path = scratch_path(counts.sparkSession, "category-index")
    dist_position(own, "value", "index").write.parquet(path)
    return {"table": path, "width": counts.sparkSession.read.parquet(path).count()}


def impute_numeric(f: dict) -> Column:
    return F.coalesce(nan_to_null(F.col(f["column"]).cast("double")), F.lit(f["median"]))


def _category(f: dict) -> Column:
    return nan_to_null(f["column"]) if f.get("real") else F.col(f["column"])


def impute_categorical(f: dict) -> Column:
    return F.coalesce(_category(f), F.lit(f["mode"]))


def is_missing(f: dict) -> Column:
    """1.0 where the fitted column has no value: null, or NaN in a number."""
    c = nan_to_null(F.col(f["column"]).cast("double")) if "median" in f else _category(f)
    return c.isNull().cast("double")


def encoded_columns(numeric: list[dict], categorical: list[dict]) -> list[tuple[str, str, Column]]:
    """(transformed name, raw feature, expression), numeric branch first, flags after the values."""
    out = []
    for f in numeric:
        scaled = (impute_numeric(f) - F.lit(f["mean"])) / F.lit(f["std"])
        out.append((f"num__{f['column']}", f["column"], scaled))
    for f in numeric:
        if f["flag"]:
            scaled = (is_missing(f) - F.lit(f["flag_mean"])) / F.lit(f["flag_std"])
            out.append((f"num__missingindicator_{f['column']}", f["column"], scaled))
    for f in categorical:
        if f.get("wide"):
            raise ValueError(f"{f['column']} has too many categories for columns; use transform or one_hot_long")
        for v in f["categories"]:
            hit = (impute_categorical(f) == F.lit(v)).cast("double")
            out.append((f"cat__{f['column']}_{_category_name(v)}", f["column"], hit))
    for f in categorical:
        if f["flag"]:
            for v in (0, 1):
                hit = (is_missing(f) == v).cast("double")
                out.append((f"cat__missingindicator_{f['column']}_{v}", f["column"], hit))
    return out


class _FittedParams(Params):
    fitted = Param(
        Params._dummy(), "fitted", "fitted statistics as JSON", TypeConverters.toString
    )
    outputCol = Param(
        Params._dummy(), "outputCol", "name of the feature vector", TypeConverters.toString
    )
    tables = Param(Params._dummy(), "tables", "written index tables of wide columns as JSON", TypeConverters.toString)


class TabularPreprocessorModel(
    Model, _FittedParams, DefaultParamsReadable, DefaultParamsWritable
):
    """Fitted preprocessing: adds the feature vector. `encode` gives the named scalar columns."""

    stored = ("tables",)

    def __init__(self):
        super().__init__()
        self._setDefault(outputCol="features")

    @classmethod
    def of(cls, numeric: list[dict], categorical: list[dict], output_col: str = "features"):
        model = cls()
        model._set(
            fitted=json.dumps({"numeric": numeric, "categorical": categorical}),
            outputCol=output_col,
            tables=json.dumps({f["column"]: f["table"] for f in categorical if f.get("wide")}),
        )
        return model

    @property
    def stats(self) -> dict:
        return json.loads(self.getOrDefault("fitted"))

    def _encoded(self):
        s = self.stats
        return encoded_columns(s["numeric"], s["categorical"])

    def _blocks(self) -> list[tuple[str, list[tuple[str, str, Column]] | dict]]:
        """The feature vector's parts in order: runs of single columns, and wide columns."""
        s = self.stats
        narrow = [f for f in s["categorical"] if not f.get("wide")]
        flags = [{**f, "categories": [], "wide": False} for f in s["categorical"]]
        blocks: list = [("columns", encoded_columns(s["numeric"], []))]
        for f in s["categorical"]:
            if f in narrow:
                blocks.append(("columns", encoded_columns([], [{**f, "flag": False}])))
            else:
                blocks.append(("wide", f))
        return [*blocks, ("columns", encoded_columns([], flags))]

    def _index_table(self, f: dict) -> DataFrame:
        return SparkSession.active().read.parquet(json.loads(self.getOrDefault("tables"))[f["column"]])

    def _names(self):
        """(transformed name, raw feature); the names of a wide column are read from its table, within a bound."""
        for kind, block in self._blocks():
            if kind == "columns":
                yield from ((name, raw) for name, raw, _ in block)
            else:
                values = collect_bounded(self._index_table(block).select("value", "index"))
                for r in sorted(values, key=lambda r: r["index"]):
                    yield f"cat__{block['column']}_{r['value']}", block["column"]

    def names_table(self) -> DataFrame:
        """(pos, feature): the transformed names by place in the feature vector, of any number of columns."""
        spark, at, out = SparkSession.active(), 0, None
        for kind, block in self._blocks():
            if kind == "columns":
                part = spark.createDataFrame([(at + i, name) for i, (name, _, _) in enumerate(block)], "pos long, feature string")
                at += len(block)
            else:
                feature = F.concat(F.lit(f"cat__{block['column']}_"), F.col("value"))
                part = self._index_table(block).select((F.col("index") + at).cast("long").alias("pos"), feature.alias("feature"))
                at += block["width"]
            out = part if out is None else out.unionByName(part)
        return out

    @property
    def feature_names(self) -> list[str]:
        return [name for name, _ in self._names()]

    @property
    def raw_names(self) -> dict[str, str]:
        """Transformed name to raw feature; flags belong to the feature they flag."""
        return dict(self._names())

    def encoded(self) -> list[tuple[str, str, Column]]:
        """(transformed name, raw feature, expression) of every column of the feature vector; none may be wide."""
        return self._encoded()

    def encode(self, df: DataFrame, *keep: str) -> DataFrame:
        return df.select(*keep, *[e.alias(name) for name, _, e in self._encoded()])

    def _transform(self, df: DataFrame) -> DataFrame:
        blocks, output = self._blocks(), self.getOrDefault("outputCol")
        if not any(kind == "wide" for kind, _ in blocks):
            scalars = [(f"__f{i}", e) for i, e in enumerate(e for _, block in blocks for _, _, e in block)]
            out = df.select("*", *[e.alias(s) for s, e in scalars])
            return VectorAssembler(inputCols=[s for s, _ in scalars], outputCol=output).transform(out).drop(*[s for s, _ in scalars])
        # wide columns are looked up by index; the vector is put together sparse, so no column metadata grows with it
        scalars, places, lookups, begins, at = [], [], [], [], 0
        for i, (kind, block) in enumerate(blocks):
            if kind == "columns":
                scalars += [e for _, _, e in block]
                places += range(at, at + len(block))
                at += len(block)
            else:
                lookups.append((f"__i{i}", block))
                begins.append(at)
                at += block["width"]
        out = df
        for name, f in lookups:
            value = impute_categorical(f).cast("string")
            out = looked_up(out, value, self._index_table(f).select("value", "n", F.col("index").alias(name)), f["rows"])
        sparse = F.arrow_udf(_sparse(places, begins, at), VectorUDT())
        vector = sparse(F.array(*scalars) if scalars else F.array().cast("array<double>"), F.array(*[F.col(name) for name, _ in lookups]))
        return out.withColumn(output, vector).drop(*[name for name, _ in lookups])


def _sparse(places: list[int], begins: list[int], width: int):
    """Function from the scalar columns' values and the wide columns' indexes to sparse vectors, zeros and unknown values left out."""
    order = np.argsort(np.array([*places, *begins]), kind="stable")

    def build(scalars: pa.Array, indexes: pa.Array) -> pa.Array:
        n = len(indexes)
        values = scalars.flatten().to_numpy(zero_copy_only=False).reshape(n, len(places))
        index = indexes.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(n, len(begins))
        known = ~np.isnan(index)
        cells = np.concatenate([values, known.astype(float)], axis=1)[:, order]
        at = np.concatenate([np.tile(np.array(places, dtype=float), (n, 1)), np.where(known, index, 0) + np.array(begins)], axis=1)[:, order]
        kept = cells != 0
        offsets = pa.array(np.r_[0, np.cumsum(kept.sum(axis=1))], pa.int32())
        parts = [
            pa.array(np.zeros(n), pa.int8()),
            pa.array(np.full(n, width), pa.int32()),
            pa.ListArray.from_arrays(offsets, pa.array(at[kept], pa.int32())),
            pa.ListArray.from_arrays(offsets, pa.array(cells[kept])),
        ]
        return pa.StructArray.from_arrays(parts, ["type", "size", "indices", "values"])

    return build


def column_sums(df: DataFrame, vector: str = "features") -> DataFrame:
    """(pos, n): sums of a vector column by place, as rows; places without any stored value are left out."""

    def run(batches):
        for batch in batches:
            kind, _, indices, values = batch.column(0).flatten()
            lengths = np.diff(values.offsets.to_numpy())
            pos = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            pos[np.repeat(kind.to_numpy() == 0, lengths)] = indices.flatten().to_numpy()  # dense vectors have no indices
            found, at = np.unique(pos, return_inverse=True)
            sums = np.bincount(at, values.flatten().to_numpy(), len(found)) if len(found) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(sums, pa.float64())], names=["pos", "n"])

    parts = df.select(vector).filter(F.col(vector).isNotNull()).mapInArrow(run, "pos long, n double")
    return parts.groupBy("pos").agg(F.sum("n").alias("n"))


class TabularPreprocessor(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Median impute + flag + scale the numeric columns, mode impute + flag + one-hot the others."""

    numericCols = Param(Params._dummy(), "numericCols", "", TypeConverters.toListString)
    categoricalCols = Param(Params._dummy(), "categoricalCols", "", TypeConverters.toListString)
    outputCol = Param(Params._dummy(), "outputCol", "", TypeConverters.toString)
    approx = Param(
        Params._dummy(), "approx", "take sketched medians (one pass fewer)", TypeConverters.toBoolean
    )

    @keyword_only
    def __init__(self, numericCols=(), categoricalCols=(), outputCol="features", approx=False):
        super().__init__()
        kwargs = dict(self._input_kwargs)
        self._setDefault(outputCol="features", approx=False, numericCols=[], categoricalCols=[])
        self._set(**{k: list(v) if isinstance(v, tuple) else v for k, v in kwargs.items()})

    def _fit(self, df: DataFrame) -> TabularPreprocessorModel:
        return TabularPreprocessorModel.of(
            fit_numeric(df, self.getOrDefault("numericCols"), self.getOrDefault("approx")),
            fit_categorical(df, self.getOrDefault("categoricalCols")),
            self.getOrDefault("outputCol"),
        )


def preprocessor(spec, **options) -> TabularPreprocessor:
    return TabularPreprocessor(
        numericCols=list(spec.numeric), categoricalCols=list(spec.categorical), **options
    )
