"""CSV ingest, Parquet table storage and catalog helpers.

CSV rules (why no ``inferSchema``): type sniffing turns IDs such as
``010001`` / ``01014F`` into doubles, and a supplied schema binds by position,
so a file with a reordered header would be read with swapped columns.  Here
every column is a string, columns are selected by *header name*, and
``enforceSchema=False`` makes Spark check the header of every file against
the schema (a file whose header differs fails instead of being misread).
Quotes inside a quoted field are doubled (RFC 4180), on reading and writing.
Files stay splittable, so a large CSV is read in parallel, unless the caller
says that quoted fields hold line breaks (``line_breaks``): then each file is
read whole by one task, and many files are what is read in parallel.

Stored tables are replaced together: every load goes to a folder of its own,
and a row in ``manifest``, written last, names it.  Readers look the newest row
up once, so they see both tables of one load, before, during and after a
replacement, and a load that fails half-way is never seen.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .schema import (
    COMPLICATION_COLUMNS,
    COMPLICATIONS_SCHEMA,
    HOSPITAL_COLUMNS,
    HOSPITALS_SCHEMA,
    all_string_schema,
)

HOSPITALS = "hospitals"
COMPLICATIONS = "complications"


MANIFEST = "manifest"
MANIFEST_SCHEMA = "version bigint, load string"


def read_cms_csv(spark: SparkSession, path: str, columns: dict[str, str],
                 header: list[str] | None = None, line_breaks: bool = False) -> DataFrame:
    """Read CSV file(s) as strings and return the ``columns`` (raw -> canonical).

    ``header``: the files' full header, if known (skips reading it first);
    otherwise it is taken from the first file and every other file must match.
    ``line_breaks``: quoted fields may hold line breaks; a file is one task's.
    """
    reader = (
        spark.read.option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .option("escape", '"')
        .option("multiLine", line_breaks)
    )
    if header is not None:
        reader = reader.schema(all_string_schema(header))
    raw = reader.csv(path)
    missing = [c for c in columns if c not in raw.columns]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    return raw.select(*[F.col(f"`{src}`").alias(dst) for src, dst in columns.items()])


def read_hospitals_csv(spark: SparkSession, path: str, header=None, line_breaks: bool = False) -> DataFrame:
    return read_cms_csv(spark, path, HOSPITAL_COLUMNS, header, line_breaks)


def read_complications_csv(spark: SparkSession, path: str, header=None, line_breaks: bool = False) -> DataFrame:
    return read_cms_csv(spark, path, COMPLICATION_COLUMNS, header, line_breaks)


def write_cms_csv(df: DataFrame, path: str, columns: dict[str, str]) -> None:
    """Write a canonical frame back with the publisher's header names."""
    inverse = {dst: src for src, dst in columns.items()}
    df.select(*[F.col(c).alias(inverse.get(c, c)) for c in df.columns]) \
        .write.mode("overwrite").option("header", True).option("escape", '"') \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def loads(spark: SparkSession, root: str) -> DataFrame:
    """The complete loads below ``root``, the newest first: version, load."""
    try:
        found = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{root}/{MANIFEST}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], MANIFEST_SCHEMA)
    return found.orderBy(F.desc("version"), F.desc("load"))


def save_tables(complications: DataFrame, hospitals: DataFrame, root: str) -> dict[str, str]:
    """Store both tables as Parquet (the fact partitioned by ``measure_id``,
    which every analysis filters on, so scans prune whole directories), in
    place of those stored before; returns their paths.

    Both are written to a new folder before one more row of the manifest names
    it; Spark's committer makes that row visible as a whole or not at all.
    Earlier loads stay for the readers that have them open; ``loads`` lists
    what may be deleted later.  Of two writers at a time the later version
    (of one version the greater folder name) is the newest for all readers.
    The fact is rebalanced by ``measure_id`` before writing: files are bounded
    by bytes, not by tasks x measures, and a large measure is split."""
    spark = complications.sparkSession
    load = f"load-{uuid.uuid4().hex}"
    paths = {t: f"{root}/{load}/{t}" for t in (COMPLICATIONS, HOSPITALS)}
    complications.hint("rebalance", "measure_id").write.partitionBy("measure_id").parquet(paths[COMPLICATIONS])
    hospitals.write.parquet(paths[HOSPITALS])
    newest = loads(spark, root).first()
    row = [(newest.version + 1 if newest else 1, load)]
    spark.createDataFrame(row, MANIFEST_SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/{MANIFEST}")
    return paths


def load_tables(spark: SparkSession, root: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Re-open the stored tables of the newest load, or of a ``version``:
    (complications, hospitals).  The schema is given, so a partition value
    such as ``0123`` stays a string."""
    known = loads(spark, root)
    row = (known if version is None else known.filter(F.col("version") == version)).first()
    if row is None:
        raise FileNotFoundError(f"no complete load {'' if version is None else version} below {root}")
    path = f"{root}/{row.load}"
    return (spark.read.schema(COMPLICATIONS_SCHEMA).parquet(f"{path}/{COMPLICATIONS}")
            .select(*COMPLICATIONS_SCHEMA.names),
            spark.read.schema(HOSPITALS_SCHEMA).parquet(f"{path}/{HOSPITALS}"))


def fetch(df: DataFrame, at_most: int = 100_000) -> Iterator[Row]:
    """The rows of a result, streamed to the client one partition at a time.

    A result of more than ``at_most`` rows raises after that many, so that a
    forgotten filter cannot fill the client; aggregate or write it instead.
    """
    for n, row in enumerate(df.limit(at_most + 1).toLocalIterator()):
        if n == at_most:
            raise ValueError(f"the result has more than {at_most} rows")
        yield row


def save_named_tables(complications: DataFrame, hospitals: DataFrame, database: str = "default") -> None:
    """Store both tables in the session's catalog, for later sessions to find
    by name (``spark.table("default.complications")``)."""
    complications.hint("rebalance", "measure_id").write.mode("overwrite") \
        .partitionBy("measure_id").saveAsTable(f"{database}.{COMPLICATIONS}")
    hospitals.write.mode("overwrite").saveAsTable(f"{database}.{HOSPITALS}")


def register_views(complications: DataFrame, hospitals: DataFrame, prefix: str = "") -> None:
    complications.createOrReplaceTempView(f"{prefix}{COMPLICATIONS}")
    hospitals.createOrReplaceTempView(f"{prefix}{HOSPITALS}")


def list_tables(spark: SparkSession, names=None) -> DataFrame:
    """``SHOW TABLES`` as a frame, optionally restricted to ``names``."""
    out = spark.sql("SHOW TABLES")
    if names is not None:
        out = out.filter(F.col("tableName").isin(*names))
    return out


def table_counts(complications: DataFrame, hospitals: DataFrame) -> DataFrame:
    """Row count of each table, one row per table."""
    return hospitals.agg(F.count(F.lit(1)).alias("row_count")) \
        .select(F.lit(HOSPITALS).alias("table_name"), "row_count") \
        .unionByName(complications.agg(F.count(F.lit(1)).alias("row_count"))
                     .select(F.lit(COMPLICATIONS).alias("table_name"), "row_count"))


def preview(df: DataFrame, keys, n: int = 3) -> DataFrame:
    """First ``n`` rows in key order (a deterministic ``LIMIT n``)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.orderBy(*keys).limit(n)


def unique_key_violations(df: DataFrame, keys) -> DataFrame:
    """Keys that occur more than once (should be empty before a dimension join)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
