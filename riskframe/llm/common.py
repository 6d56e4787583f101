"""Word rules, row identity and global numbering shared by the operators.

A word is a maximal run of characters other than the six ASCII blanks (space and code points 9 to 13).
In Python the same rule is `bytes.split()` on UTF-8, and A-Z lower-casing is `bytes.lower()`.
A row is identified by its doc_id and a digest of its text, so tables that repeat an id, or hold null
ids, are handled: rows that agree in both are copies of one row and share its decisions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from riskframe.session import stage_table

BLANKS = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def n_words(text) -> Column:
    """Number of words; null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text) -> Column:
    """The words of a text as an array; null texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def let(value: Column, fn) -> Column:
    """`fn(value)` with `value` computed once, however often `fn` uses it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stage_text(df: DataFrame, name: str, rows: int = 500) -> DataFrame:
    """`stage_table` for work that hands texts to Python, in batches of at most `rows` rows to bound its memory."""
    conf = df.sparkSession.conf
    before = conf.get(BATCH_ROWS)
    conf.set(BATCH_ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        return stage_table(df, name)
    finally:
        conf.set(BATCH_ROWS, before)


def same(left: DataFrame, right: DataFrame, keys) -> Column:
    """Join condition that treats nulls as equal."""
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(right[k])
    return on


def numbered(df: DataFrame, order: list[Column], name: str, bounds: list[Column] | None = None) -> DataFrame:
    """Add `name`, the 0-based position in `order`, without a window over the whole table.

    Rows are range-partitioned, numbered inside their partition, and shifted by the sizes of the
    partitions before it. The partitions are written once, so every pass sees the same ones. `bounds` cut the
    partitions where the order itself holds long texts: expressions that never fall as the order rises.
    """
    ranged = df.repartitionByRange(*(bounds or order)).sortWithinPartitions(*order)
    ranged = ranged.withColumn("_part", F.spark_partition_id())
    inside = Window.partitionBy("_part").orderBy(*order)
    t = stage_table(ranged.withColumn("_at", F.row_number().over(inside) - 1), name)
    parts = t.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return t.join(F.broadcast(parts), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop(
        "_part", "_at", "_before"
    )
