"""Tables sorted by one key, with the key's range in each file, so that readers only open the files they need."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attest.sources.shared import shuffles_removed

LAST = "\U0010ffff"  # after every text that goes on


MOST_FILES = 1024  # of a table: the driver holds their names, ranges and a sample of keys for each


def write_sorted(df: DataFrame, path: str, key: str, rows_per_file: int = 1 << 20, by: Column | None = None) -> None:
    """df in files of about so many rows, dealt out and sorted by key (text), and a table of the files' first and last keys.

    A table that would have more than MOST_FILES files has larger ones. Files can't be told apart where one key has more
    rows than a file takes; such a key is in several files. by: what makes the key of df's other columns, if no two rows
    have the same one; it is then made where rows are sorted, and not sent there.
    """
    spark = df.sparkSession
    files = max(1, min(MOST_FILES, -(-df.count() // rows_per_file)))
    if by is None:
        rest = [c for c in df.columns if c != key]
        dealt = df.repartitionByRange(files, key, F.xxhash64(*rest)) if rest else df.repartitionByRange(files, key)
    else:
        dealt = df.repartitionByRange(files, by).withColumn(key, by)
    with shuffles_removed(spark):
        dealt.sortWithinPartitions(key).write.option("compression", "zstd").parquet(f"{path}/rows")
        rows = spark.read.schema(dealt.schema).parquet(f"{path}/rows")
        rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/zones")


def zones(spark: SparkSession, path: str) -> list[tuple[str, str, str, int]]:
    """(file, first, last, n) of each file in key order: as many rows as the table has files, which the driver lists anyhow."""
    return sorted((tuple(r) for r in spark.read.parquet(f"{path}/zones").select("file", "first", "last", "n").collect()), key=lambda z: (z[1], z[2]))


def files_of(spark: SparkSession, path: str, ranges: DataFrame) -> list[str]:
    """The files that may hold keys of the ranges (low, high), ends included; each range is looked up in the sorted zones."""
    found = zones(spark, path)
    firsts, lasts = [z[1] for z in found], [z[2] for z in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit = set()
        for b in batches:
            for low, high in zip(b.column("low").to_pylist(), b.column("high").to_pylist(), strict=True):
                hit.update(range(bisect_left(lasts, low), bisect_right(firsts, high)))
        yield pa.record_batch([pa.array(sorted(hit), pa.int64())], names=["zone"])

    return [found[r.zone][0] for r in ranges.select("low", "high").mapInArrow(run, "zone long").distinct().collect()]


def read_ranges(spark: SparkSession, path: str, ranges: DataFrame) -> DataFrame:
    """The rows of those files, so all with keys in the ranges and what else these files hold."""
    files = files_of(spark, path, ranges)
    schema = spark.read.parquet(f"{path}/rows").schema
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def one_range(spark: SparkSession, low: Column, high: Column) -> DataFrame:
    return spark.range(1).select(low.alias("low"), high.alias("high"))
