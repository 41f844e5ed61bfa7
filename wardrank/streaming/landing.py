"""Incremental load of CSV drops into the stored tables (Structured Streaming).

The batch path reads a CSV snapshot and writes a table (``sources.files``).
When new snapshots keep arriving in a landing folder, the same load runs as a
stream: the file source picks up only files it has not seen, the Parquet sink
commits each micro-batch exactly once through its metadata log, and the
checkpoint (inside the table's own folder unless given, so it goes with the
table) lets a restarted or failed job resume where it stopped.  ``availableNow`` processes
what is there and stops, so the load can be scheduled like a batch job.

Streams cannot infer a schema: the files' full header is required, and every
column is read as a string (the same no-sniffing rule as the batch reader).
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.schema import COMPLICATION_COLUMNS, HOSPITAL_COLUMNS, all_string_schema


def load_csv_drops(
    spark: SparkSession,
    landing_dir: str,
    table_dir: str,
    header: list[str],
    columns: dict[str, str],
    checkpoint: str | None = None,
    partition_by: str | None = None,
    available_now: bool = True,
    max_files_per_trigger: int | None = None,
    line_breaks: bool = False,
) -> StreamingQuery:
    """Start a stream that appends every new CSV file in ``landing_dir`` to
    the Parquet table at ``table_dir`` (canonical column names).

    ``line_breaks``: quoted fields may hold line breaks; a file is one task's."""
    reader = (
        spark.readStream.schema(all_string_schema(header))
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .option("escape", '"')
        .option("multiLine", line_breaks)
    )
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.csv(landing_dir)
    typed = raw.select(*[F.col(f"`{src}`").alias(dst) for src, dst in columns.items()])
    ckpt = checkpoint or f"{table_dir.rstrip('/')}/_checkpoint"
    writer = (
        typed.writeStream.format("parquet")
        .option("path", table_dir)
        .option("checkpointLocation", ckpt)
        .outputMode("append")
    )
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer = writer.trigger(availableNow=True) if available_now else \
        writer.trigger(processingTime="1 minute")
    return writer.start()


def load_hospital_drops(spark, landing_dir, table_dir, header, **kw) -> StreamingQuery:
    return load_csv_drops(spark, landing_dir, table_dir, header, HOSPITAL_COLUMNS, **kw)


def load_complication_drops(spark, landing_dir, table_dir, header, **kw) -> StreamingQuery:
    kw.setdefault("partition_by", "measure_id")
    return load_csv_drops(spark, landing_dir, table_dir, header, COMPLICATION_COLUMNS, **kw)
