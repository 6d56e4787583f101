"""Left joins with fitted tables of values, small or large, whose values may hold much of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskframe.session import local_if_small

# A value with more than this share of the rows is looked up by broadcast; there are at most 200 of them.
HOT_SHARE = 1 / 200


def looked_up(df: DataFrame, key: Column, table: DataFrame, rows: int) -> DataFrame:
    """Left join of a table (value, n, ...), where n of `rows` rows had the value, on `key`; `value` and `n` are dropped.

    A small table is broadcast after a check of its size. Of a larger one only the values that hold much of the rows
    are; their rows are spread over the shuffle by a key that matches nothing.
    """
    kept = [c for c in table.columns if c not in ("value", "n")]
    table = table.withColumnsRenamed({"value": "_value", "n": "_n"})
    out, local = df.withColumn("_key", key), local_if_small(table)
    if local is not table:
        return out.join(local, F.col("_key") == F.col("_value"), "left").drop("_key", "_value", "_n")
    hot = table.filter(F.col("_n") > HOT_SHARE * rows)
    hot = hot.select(F.col("_value").alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in kept])
    out = out.join(F.broadcast(hot), F.col("_key") == F.col("_hot"), "left")
    spread = F.concat(F.lit("\0"), F.floor(F.rand() * 1024).cast("string"))
    out = out.withColumn("_key", F.when(F.col("_hot").isNotNull(), spread).otherwise(F.col("_key")))
    cold = table.filter(F.col("_n") <= HOT_SHARE * rows).drop("_n")
    out = out.join(cold, F.col("_key") == F.col("_value"), "left")
    out = out.withColumns({c: F.coalesce(F.col(f"_hot_{c}"), F.col(c)) for c in kept})
    return out.drop("_key", "_hot", "_value", *[f"_hot_{c}" for c in kept])
