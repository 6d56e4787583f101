"""Scoring a stream of record files with the batch scoring function."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery

from riskframe.plans.score import score_records
from riskframe.session import scratch_path


def read_record_stream(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    fmt: str = "parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(folder)


def score_stream(
    model,
    records: DataFrame,
    output: str,
    features=None,
    id_col: str | None = None,
    checkpoint: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Append scored records to a parquet folder.

    The transform is stateless; the checkpoint folder makes the file sink exactly-once over restarts.
    """
    spark = records.sparkSession
    writer = (
        score_records(model, records, features, id_col)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", output)
        .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-checkpoint"))
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
