"""Helpers shared by the training-data operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attest.sources.shared import checkpointed, discard, materialized, shared_dir, shuffles_removed

__all__ = ["NO_ID", "WORD", "checkpointed", "dense_index", "discard", "fold_of", "matched", "materialized", "shared_dir", "shuffles_removed", "spare", "table", "word_count"]

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null doc_id inside joins and orders: it sorts after every other.
NO_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; -1 for a null id, which so belongs to no held-out fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1))


def spare(docs: DataFrame, name: str) -> str:
    """A column name like ``name`` that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def matched(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """a joined with b on columns of the same names, where nulls are equal; these columns are a's."""
    renamed = b.withColumnsRenamed({c: f"{c}__b" for c in on})
    return a.join(renamed, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"{c}__b")) for c in on]), how).drop(*[f"{c}__b" for c in on])


def dense_index(rows: DataFrame, order: list[str | Column], within: tuple[str, ...] = ()) -> DataFrame:
    """rows, written once, with idx = 0, 1, 2 ... in the given order among those that agree in ``within``, and n, their number.

    Rows are dealt into ranges of (within, order) and sorted there; a row's place is its place in the range and what the
    ranges before hold, so no group of rows meets in one task, however large. Equal rows are dealt into several ranges as
    well, in any order. The window only sees one row for each range and group. Nulls come first; an empty table stays empty.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*within, *order, "at__"]
    ranged = rows.withColumn("at__", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    ranged = materialized(ranged.drop("at__").withColumn("row__", F.monotonically_increasing_id()).withColumn("part__", F.shiftright("row__", 33)), "ranged")
    held = ranged.groupBy("part__", *within).agg(F.count("*").alias("n__"), F.min("row__").alias("first__"))
    group = W.partitionBy(*within)
    before = F.coalesce(F.sum("n__").over(group.orderBy("part__").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = held.select("part__", *within, (before - F.col("first__")).alias("shift__"), F.sum("n__").over(group).alias("n"))
    return matched(ranged, offsets, ["part__", *within]).select(*rows.columns, (F.col("row__") + F.col("shift__")).alias("idx"), "n")
