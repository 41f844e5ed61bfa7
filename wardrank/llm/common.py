"""Helpers shared by the operators: stored steps, word tables, Arrow mapping."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import scratch_path


#: Spark's own setting: delete a query's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that a Parquet reader holds and a Python task is given at once.
_BATCHES = ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch")


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once below ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage: a lost executor costs the tasks it ran, never the
    steps before the table, and a value that depends on the row order of a
    scan (a row id) stays the same in every later pass.  What the write itself
    shuffled is deleted when it is done.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """What runs inside reads and passes on at most ``rows`` rows at once: for
    rows that hold a text, which by Spark's defaults (4096 and 10000) fill
    tens of MB in every reader, buffer and Python worker."""
    before = {k: spark.conf.get(k) for k in _BATCHES}
    try:
        for k, v in before.items():
            spark.conf.set(k, str(min(rows, int(v)) if int(v) > 0 else rows))  # 0 or less: no limit
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def id_remainder(id_col: str, divisor: int) -> Column:
    """crc32 of the id as text modulo ``divisor``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % divisor


def map_arrow(df: DataFrame, schema: T.StructType, fn: Callable[[Iterator[dict]], Iterator[dict]]) -> DataFrame:
    """``mapInArrow`` over dicts of columns: ``fn`` gets one dict of Arrow
    arrays per batch and yields dicts of arrays or lists in ``schema``."""
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ({n: b.column(i) for i, n in enumerate(b.schema.names)} for b in batches)
        for out in fn(columns):
            arrays = []
            for field in target:
                v = out[field.name]
                if isinstance(v, (pa.Array, pa.ChunkedArray)):
                    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
                    arrays.append(v if v.type == field.type else v.cast(field.type))
                else:
                    arrays.append(pa.array(v, type=field.type, from_pandas=False))
            yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.mapInArrow(run, schema)


def slices(batches: Iterator[dict], rows: int) -> Iterator[dict]:
    """The same columns in pieces of at most ``rows`` rows, where each row
    turns into many Python objects."""
    for b in batches:
        for at in range(0, len(next(iter(b.values()))), rows):
            yield {n: c.slice(at, rows) for n, c in b.items()}


def fields(*spec: str) -> T.StructType:
    """``fields("doc_id long", "n long")`` as a schema of nullable fields."""
    names = dict(long=T.LongType(), int=T.IntegerType(), double=T.DoubleType(), string=T.StringType(),
                 binary=T.BinaryType(), boolean=T.BooleanType())
    arrays = {f"array<{k}>": T.ArrayType(v) for k, v in names.items()}
    names |= arrays
    return T.StructType([T.StructField(n, names[t]) for n, t in (s.split() for s in spec)])


#: bytes -> bytes: A-Z lower-cased, every ASCII byte that is neither digit nor
#: letter becomes a space; bytes from 0x80 on stay (they are parts of words).
WORD_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
                   for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of digits, letters and non-ASCII characters."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(WORD_TABLE).split()
