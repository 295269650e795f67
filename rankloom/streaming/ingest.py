"""Incremental ingest of files that keep arriving in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rankloom.session import durable_path
from rankloom.sources.datasets import STUDENT_SCHEMA, enrollments


def stream_files(
    spark: SparkSession, folder: str, schema: StructType, fmt: str = "json", glob: str | None = None, per_batch: int | None = None
) -> DataFrame:
    """Files of a folder as a stream, new files first seen by later batches."""
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.load(folder)


def stream_enrollments(spark: SparkSession, folder: str, per_batch: int | None = None) -> DataFrame:
    """Enrollment events from arriving JSON Lines student records."""
    students = stream_files(spark, folder, STUDENT_SCHEMA, per_batch=per_batch)
    order = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    return enrollments(students.withColumn("_file", order), F.col("_file"))


def run_available(stream: DataFrame, path: str | None = None, label: str = "stream") -> DataFrame:
    """Process everything that is available now into a table and return that table.

    Progress is kept next to the table, so a restart continues where it stopped.
    """
    spark = stream.sparkSession
    path = path or durable_path(spark, label)
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", f"{path}-progress")
        .outputMode("append")
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
