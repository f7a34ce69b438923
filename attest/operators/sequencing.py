"""De-duplication, load counters and the hash dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attest.functions.scalars import hash_of
from attest.sources.shared import checkpointed


def dedupe_publications(df: DataFrame, order: str = "counter") -> DataFrame:
    """One row for each np_id: the first by arrival. A hash aggregate, so copies combine before they are shuffled."""
    rest = [c for c in df.columns if c not in ("np_id", order)]
    first = df.groupBy("np_id").agg(F.min(F.struct(order, *rest)).alias("first"))
    return first.select("np_id", "first.*").select(*df.columns)


def next_counter(existing: DataFrame) -> DataFrame:
    return existing.agg((F.coalesce(F.max("counter"), F.lit(0)) + 1).alias("next_counter"))


def assign_counters(new: DataFrame, order: list[str], start: int = 0, parts: int | None = None) -> DataFrame:
    """new with counter = start, start + 1, ... in the given order, without an unpartitioned window.

    parts: the number of ranges; by default as many as the session's shuffle partitions, which go with the cluster and data.

    Rows are dealt into ranges and written, so that both uses see the same ranges; the ranges' counts give the offsets.
    """
    parts = parts or int(new.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(new.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", (F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + start).alias("__before"))
    within = F.row_number().over(W.partitionBy("__part").orderBy(*order)) - 1
    return ranged.withColumn("__within", within).join(before, "__part").withColumn("counter", (F.col("__before") + F.col("__within")).cast("long")).drop("__part", "__within", "__before")


def record_hashes(values: DataFrame, column: str, known: DataFrame | None = None) -> DataFrame:
    """Distinct (hash, value) of a column, without those already known."""
    out = values.where(F.col(column).isNotNull()).select(hash_of(F.col(column)).alias("hash"), F.col(column).alias("value")).distinct()
    return out if known is None else out.join(known.select("hash"), "hash", "left_anti")


def unhash(df: DataFrame, column: str, dictionary: DataFrame, to: str = "value") -> DataFrame:
    """df with the value of a hash column; null where it is unknown."""
    return df.join(dictionary.select(F.col("hash").alias(column), F.col("value").alias(to)), column, "left")
