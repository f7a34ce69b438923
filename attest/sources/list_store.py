"""Lists laid out for reading: sorted by list and position for look-ups, and in buckets for joins of two registries."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attest.functions.scalars import ROOT
from attest.operators.lists import LIST
from attest.sources import layout
from attest.sources.shared import checkpointed

ENTRY = [*LIST, "np", "counter", "position", "checksum"]


def _key(pubkey: Column, type_: Column, position: Column) -> Column:
    return F.concat_ws("\t", pubkey, type_, F.format_string("%020d", position))


def write_list_store(entries: DataFrame, path: str, rows_per_file: int = 1 << 20) -> None:
    """Entries by key, type and position; a list's are next to each other, over as many files as they need."""
    layout.write_sorted(entries.select(*ENTRY), path, "key", rows_per_file, _key(F.col("pubkey"), F.col("type"), F.col("position")))


def stored_list(spark: SparkSession, path: str, pubkey: Column, type_: str = ROOT, after: int = -1, upto: int | None = None) -> DataFrame:
    """The entries of a list behind a position, in order; only files that hold some are read."""
    low = _key(pubkey, F.lit(type_), F.lit(after + 1))
    high = F.concat_ws("\t", pubkey, F.lit(type_), F.lit(layout.LAST)) if upto is None else _key(pubkey, F.lit(type_), F.lit(upto))
    rows = layout.read_ranges(spark, path, layout.one_range(spark, low, high))
    return rows.where((F.col("pubkey") == pubkey) & (F.col("type") == type_) & (F.col("position") > after) & (F.col("position") <= F.lit(upto) if upto is not None else F.lit(True))).select(*ENTRY).orderBy("position")


def stored_lists_of(spark: SparkSession, path: str, pubkey: Column) -> DataFrame:
    """(pubkey, type, max_position, count, checksum) of all lists of a key."""
    rows = layout.read_ranges(spark, path, layout.one_range(spark, F.concat(pubkey, F.lit("\t")), F.concat(pubkey, F.lit(f"\t{layout.LAST}"))))
    return rows.where(F.col("pubkey") == pubkey).groupBy(*LIST).agg(F.max("position").alias("max_position"), (F.max("position") + 1).alias("count"), F.max_by("checksum", "position").alias("checksum"))


def write_buckets(entries: DataFrame, path: str, buckets: int) -> str:
    """A table of entries in buckets by list and position, so that a long list is in all of them; gives its name in the session's catalog."""
    name = f"lists_{uuid.uuid4().hex}"
    entries.select(*ENTRY).write.format("parquet").option("compression", "zstd").bucketBy(buckets, *LIST, "position").sortBy(*LIST, "position").option("path", path).saveAsTable(name)
    return name


def same_entries(a: DataFrame, b: DataFrame) -> DataFrame:
    """(pubkey, type, position): where the lists of two registries have the same checksum. Tables of as many buckets meet without exchange.

    The same checksum means the same set, so the same number of entries: a match can only be at the same position. The
    join is on what the buckets are by; that the checksums agree is said in a way that makes no further key of it.
    """
    other = b.select(*LIST, "position", F.col("checksum").alias("sum"))
    met = a.select(*LIST, "position", "checksum").join(other, [*LIST, "position"])
    return met.where(F.concat("checksum", "sum") == F.concat("sum", "checksum")).select(*LIST, "position")  # texts of one length


def stored_delta(spark: SparkSession, path: str, table: str, checkpoints: DataFrame) -> DataFrame:
    """list_delta() of a registry that is stored both ways: the entries after the furthest position at which a peer's checkpoints agree.

    What agrees is found by a join of buckets (checkpoints may be a table of write_buckets() or any other); then only the
    files that hold what comes after are read.
    """
    entries = spark.table(table)
    known = same_entries(entries, checkpoints).groupBy(*LIST).agg(F.max("position").alias("known"))
    lists = entries.select(*LIST).distinct().join(known, LIST, "left").withColumn("known", F.coalesce("known", F.lit(-1)))
    lists = checkpointed(lists)
    ranges = lists.select(_key(F.col("pubkey"), F.col("type"), F.col("known") + 1).alias("low"), F.concat_ws("\t", "pubkey", "type", F.lit(layout.LAST)).alias("high"))
    tails = layout.read_ranges(spark, path, ranges)
    return tails.join(lists, LIST).where("position > known").select(*ENTRY)
