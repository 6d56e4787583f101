"""CSV and parquet tables in, CSV, parquet and scored tables out."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from riskframe.spec import CENTRE_FILES, CENTRE_SCHEMA

log = logging.getLogger(__name__)


def path_exists(spark: SparkSession, pattern: str) -> bool:
    return bool(list_paths(spark, pattern))


def list_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Sorted paths matching a glob on whatever file system it names."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(path)
    return sorted(s.getPath().toString() for s in found) if found else []


def read_headerless(
    spark: SparkSession, path: str | list[str], schema: T.StructType = CENTRE_SCHEMA, null: str = "?"
) -> DataFrame:
    """Headerless CSV under a fixed schema; the marker reads as null."""
    return spark.read.schema(schema).option("nullValue", null).csv(path)


def read_many(
    spark: SparkSession,
    folder: str,
    files: Sequence[str] = CENTRE_FILES,
    schema: T.StructType = CENTRE_SCHEMA,
    null: str = "?",
) -> DataFrame | None:
    """All present files of a folder in one scan, with the file name as `center`.

    Absent files are skipped with a warning; without any file there is no table.
    """
    present = []
    for f in files:
        path = f"{folder.rstrip('/')}/{f}"
        if path_exists(spark, path):
            present.append(path)
        else:
            log.warning("%s not found, skipped", path)
    if not present:
        log.warning("no input files in %s", folder)
        return None
    rows = read_headerless(spark, present, schema, null)
    # a centre may be a single file or a folder of part files
    parts = F.split(F.col("_metadata.file_path"), "/")
    name = F.filter(parts, lambda p: p.isin(*files))
    return rows.select("*", F.element_at(name, -1).alias("center"))


def read_headed(
    spark: SparkSession, path: str, schema: T.StructType | None = None, null: str = ""
) -> DataFrame:
    """CSV with a header, or parquet. Columns are matched by name, in the order of the file.

    Without a schema CSV types are inferred, which costs a pass over the file.
    """
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    reader = spark.read.option("header", True).option("nullValue", null)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    names = reader.csv(path).columns
    by_name = {f.name: f for f in schema.fields}
    in_file_order = [by_name.get(n, T.StructField(n, T.StringType())) for n in names]
    return reader.schema(T.StructType(in_file_order)).csv(path)


def load_csv(
    spark: SparkSession,
    path: str,
    drop_cols: Sequence[str] = (),
    schema: T.StructType | None = None,
) -> DataFrame:
    return read_headed(spark, path, schema).drop(*drop_cols)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_headerless(df: DataFrame, path: str, null: str = "?") -> None:
    df.write.mode("overwrite").option("nullValue", null).csv(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_scored(scored: DataFrame, path: str, fmt: str = "csv") -> None:
    """Original columns with `prediction` and `probability` appended."""
    (write_csv if fmt == "csv" else write_table)(scored, path)


def write_contributions(contributions: DataFrame, path: str) -> None:
    """Raw contributions as long parquet (id, feature, impact)."""
    write_table(contributions, path)
