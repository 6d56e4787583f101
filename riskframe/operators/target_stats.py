"""Label statistics of categories: ordered for the rows they are learnt from, whole for rows scored later.

A row that is trained on must not see its own label in its features. Rows are put in a hash order of their ids, and each
takes the smoothed label mean of the rows *before* it that share its category. Rows scored later take the
mean of all training rows of the category.

The running sums need no task per category: a category's rows are cut into buckets by the first digits of the hash, which
are uniform, a window runs inside (category, bucket), and the sums of earlier buckets are joined on. The digits follow from
the number of rows, so a category that holds half of them is spread over half of the buckets.

Missing values are a category of their own. A category without earlier rows, or unseen in training, has the prior.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window, functions as F

from riskframe import functions as fx
from riskframe.functions import present
from riskframe.operators.lookup import looked_up
from riskframe.operators.preprocess import WIDE
from riskframe.operators.ranking import BUCKET_ROWS, _with_offsets
from riskframe.session import scratch_path
from riskframe.spec import RANDOM_SEED

MISSING = "\0missing"


def _category(df: DataFrame, column: str) -> Column:
    return F.coalesce(present(df, column).cast("string"), F.lit(MISSING))


def _mean(total: Column, n: Column, prior: float, weight: float) -> Column:
    return (total + F.lit(weight * prior)) / (n + F.lit(float(weight)))


def ordered_statistics(
    df: DataFrame,
    columns: Sequence[str],
    label: str,
    id_col: str,
    prior: float,
    weight: float = 1.0,
    seed: int = RANDOM_SEED,
    rows: int | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Add `<column>__target`: (labels of earlier rows of the category + weight * prior) / (earlier rows + weight).

    Rows come in the order of md5(seed:id), whose ties only repeated ids can make; those go by label.
    """
    rows = df.count() if rows is None else rows
    digits = max(1, math.ceil(math.log(max(rows / bucket_rows, 1), 16)) + 1)
    out = df.withColumn("_order", fx.hash_key(f"{seed}:ordered", id_col))
    out = out.withColumn("_bucket", F.substring("_order", 1, digits))
    for c in columns:
        part = out.withColumn("_category", _category(df, c))
        totals = {"n": F.count(F.lit(1)), "s": F.sum(F.col(label).cast("double"))}
        part = _with_offsets(part, ["_category"], "_bucket", totals)
        earlier = Window.partitionBy("_category", "_bucket").orderBy("_order", label).rowsBetween(Window.unboundedPreceding, -1)
        n = F.col("_before_n") + F.count(F.lit(1)).over(earlier)
        s = F.col("_before_s") + F.coalesce(F.sum(F.col(label).cast("double")).over(earlier), F.lit(0.0))
        out = part.withColumn(f"{c}__target", _mean(s, n, prior, weight)).drop("_category", "_before_n", "_before_s")
    return out.drop("_order", "_bucket")


def category_means(df: DataFrame, columns: Sequence[str], label: str, prior: float, weight: float = 1.0) -> DataFrame:
    """(feature, value, n, mean): the smoothed label mean of every category over all rows."""
    entries = [F.struct(F.lit(c).alias("feature"), _category(df, c).alias("value")) for c in columns]
    long = df.select(F.explode(F.array(*entries)).alias("e"), F.col(label).cast("double").alias("_y"))
    sums = long.groupBy("e.feature", "e.value").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("_s"))
    return sums.select("feature", "value", "n", _mean(F.col("_s"), F.col("n"), prior, weight).alias("mean"))


class TargetStatisticsModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Adds `<column>__target` from a written table of category means.

    Columns of up to `WIDE` categories are looked up in the model itself. For a wider one the table is joined: values that
    hold many rows, of which there can only be few, by broadcast, and the rest by a shuffle on the value.
    """

    tablePath = Param(Params._dummy(), "tablePath", "written category means", TypeConverters.toString)
    fitted = Param(Params._dummy(), "fitted", "columns, prior and narrow columns' means as JSON", TypeConverters.toString)
    stored = ("tablePath",)

    def _transform(self, df: DataFrame) -> DataFrame:
        model = json.loads(self.getOrDefault("fitted"))
        prior, out = model["prior"], df
        for c in model["columns"]:
            key, name = _category(df, c), f"{c}__target"
            if c in model["narrow"]:
                pairs = [F.lit(x) for kv in model["narrow"][c].items() for x in kv]
                out = out.withColumn(name, F.coalesce(F.create_map(*pairs)[key] if pairs else F.lit(None), F.lit(prior)))
                continue
            table = df.sparkSession.read.parquet(self.getOrDefault("tablePath")).filter(F.col("feature") == c)
            out = looked_up(out, key, table.select("value", "n", F.col("mean").alias(name)), model["rows"])
            out = out.withColumn(name, F.coalesce(F.col(name), F.lit(prior)))
        return out


def fit_target_statistics(df: DataFrame, columns: Sequence[str], label: str, prior: float, rows: int, weight: float = 1.0) -> TargetStatisticsModel:
    """Written means of all categories; those of narrow columns are also kept in the model."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "category-means")
    category_means(df, columns, label, prior, weight).write.parquet(path)
    table = spark.read.parquet(path)
    widths = {r["feature"]: r["w"] for r in table.groupBy("feature").agg(F.count(F.lit(1)).alias("w")).collect()}
    narrow = {c: {} for c in columns if widths.get(c, 0) <= WIDE}
    for r in table.filter(F.col("feature").isin(list(narrow))).collect() if narrow else []:
        narrow[r["feature"]][r["value"]] = r["mean"]
    model = TargetStatisticsModel()
    model._set(tablePath=path, fitted=json.dumps({"columns": list(columns), "prior": prior, "rows": rows, "narrow": narrow}))
    return model
