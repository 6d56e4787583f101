"""Stratified hold-out and folds by hash order, cut at exact counts.

Rows are ordered by the md5 of (seed, id) within their class. The cut positions are found from counts
per hash prefix; only the rows that share a cut's prefix are sorted to find the exact key. The split
itself is then a comparison with literals: the table is never shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from riskframe import functions as fx
from riskframe.operators.ranking import dist_rank
from riskframe.session import local_if_small

# Rows of a class that share a cut's prefix and are sorted in one task, on average.
SORTED_ROWS = 20_000
# More classes than this are no longer literals in a plan; they take the ranked join instead.
MAX_CLASSES = 1_000


def cut_keys(df: DataFrame, label: str, key: str, rank_sql: list[str]) -> list | None:
    """Per class the md5 key at each of the given ranks (SQL over `n`, the class size).

    Rank 0 means "before every row" and gives no row here. None if there are too many classes.
    """
    largest = df.groupBy(label).agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0] or 0
    digits = max(2, math.ceil(math.log(max(1, largest / SORTED_ROWS), 16)))
    prefix = F.substring(key, 1, digits)
    counts = df.groupBy(label, prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("c"))
    # a row per SORTED_ROWS rows of a class, and 256 at least
    w = Window.partitionBy(label).orderBy("prefix")
    cum = counts.select(
        label,
        "prefix",
        (F.sum("c").over(w) - F.col("c")).alias("before"),
        F.sum("c").over(w).alias("upto"),
        F.sum("c").over(Window.partitionBy(label)).alias("n"),
    )
    ranks = F.array(
        *[F.struct(F.lit(i).alias("cut"), F.expr(s).cast("long").alias("rank")) for i, s in enumerate(rank_sql)]
    )
    cuts = (
        cum.select("*", F.explode(ranks).alias("r"))
        .filter("r.rank > before AND r.rank <= upto")
        .select(
            F.col(label).alias("class"),
            "prefix",
            F.col("r.cut").alias("cut"),
            (F.col("r.rank") - F.col("before")).alias("offset"),
        )
    )
    limit = MAX_CLASSES * max(1, len(rank_sql))
    few = local_if_small(cuts, limit)
    if few is cuts:
        return None
    near = df.select(label, key).join(
        few,
        F.col(label).eqNullSafe(F.col("class")) & (prefix == F.col("prefix")),
    )
    inside = Window.partitionBy("class", "cut").orderBy(key)
    return (
        near.withColumn("rn", F.row_number().over(inside))
        .filter("rn = offset")
        .select("class", "cut", F.col(key).alias("cut_key"))
        .collect()
    )


def _position(df: DataFrame, label: str, id_col: str, seed) -> DataFrame:
    """`_rank` in hash order and `_n`, the class size, for any number of classes."""
    ranked = dist_rank(
        df.withColumn("_key", fx.hash_key(seed, id_col)), "_key", "_rank", by=[label]
    )
    sizes = df.groupBy(F.col(label).alias("_class")).agg(F.count(F.lit(1)).alias("_n"))
    return ranked.join(sizes, F.col(label).eqNullSafe(F.col("_class"))).drop("_class", "_key")


def stratified_split(
    df: DataFrame, label: str, id_col: str, test_size: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add `is_test`: round(test_size * n) rows of every class, chosen by hash order."""
    keyed = df.withColumn("_key", fx.hash_key(seed, id_col))
    cuts = cut_keys(keyed, label, "_key", [f"floor(n * {test_size} + 0.5D)"])
    if cuts is None:
        p = _position(df, label, id_col, seed)
        is_test = F.col("_rank") <= F.floor(F.col("_n") * test_size + 0.5)
        return p.withColumn("is_test", is_test).drop("_rank", "_n")
    test = F.lit(False)
    for r in cuts:
        test = test | (F.col(label).eqNullSafe(F.lit(r["class"])) & (F.col("_key") <= r["cut_key"]))
    return keyed.withColumn("is_test", test).drop("_key")


def optional_split(
    df: DataFrame, label: str, id_col: str, test_size: float = 0.0, seed: int = 42
) -> tuple[DataFrame | None, DataFrame]:
    """(train, evaluation); without a test share the whole table is evaluated."""
    if not test_size or test_size <= 0:
        return None, df
    s = stratified_split(df, label, id_col, test_size, seed)
    return s.filter(~F.col("is_test")).drop("is_test"), s.filter("is_test").drop("is_test")


def stratified_folds(
    df: DataFrame, label: str, id_col: str, k: int = 10, seed: int = 42, fold_col: str = "fold"
) -> DataFrame:
    """Add a fold 0..k-1; within a class the fold sizes differ by at most one row."""
    keyed = df.withColumn("_key", fx.hash_key(seed, id_col))
    # fold j starts after ceil(j * n / k) rows
    found = cut_keys(keyed, label, "_key", [f"ceil(n * {j} / {k})" for j in range(1, k)])
    if found is None:
        p = _position(df, label, id_col, seed)
        fold = F.floor((F.col("_rank") - 1) * k / F.col("_n")).cast("int")
        return p.withColumn(fold_col, fold).drop("_rank", "_n")
    cuts: dict = {}
    for r in found:
        cuts.setdefault(r["class"], []).append(r["cut_key"])
    fold = F.lit(None).cast("int")
    for value, keys in cuts.items():
        passed = sum((F.when(F.col("_key") > c, 1).otherwise(0) for c in keys), F.lit(0))
        fold = F.when(F.col(label).eqNullSafe(F.lit(value)), passed).otherwise(fold)
    return keyed.withColumn(fold_col, F.coalesce(fold, F.lit(0))).drop("_key")


def split_sizes(df: DataFrame, label: str, part: str) -> DataFrame:
    return df.groupBy(label, part).agg(F.count(F.lit(1)).alias("n"))

