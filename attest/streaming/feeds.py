"""Publications as a stream: reading, admission, de-duplication and metrics."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from attest import schemas
from attest.operators.admission import admission_reason, filter_covered
from attest.streaming.runs import read_runs, write_batch

METRICS = "start timestamp, n bigint, bytes bigint"


def stream_publications(spark: SparkSession, path: str, files_per_trigger: int = 1000, schema: str = schemas.PUBLICATIONS) -> DataFrame:
    """New publication files in order of arrival; the stream's checkpoint remembers how far it came."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def admission(df: DataFrame, now: Column, coverage: str | None = None, **limits) -> DataFrame:
    """Covered publications with reject_reason, null where they are admitted."""
    return admission_reason(filter_covered(df, coverage), now, **limits)


def stream_admit(df: DataFrame, now: Column, table: str, checkpoint: str, coverage: str | None = None, **limits) -> StreamingQuery:
    """Sort covered publications into two tables in one pass: read by outcome_of().

    A micro-batch is one write, dealt out by outcome into a folder of its own, so a batch done again changes nothing and
    neither table can have a batch that the other lacks.
    """
    sorted_ = admission(df, now, coverage, **limits).withColumn("outcome", F.when(F.col("reject_reason").isNull(), "admitted").otherwise("rejected"))
    put = lambda rows, batch: write_batch(rows, table, checkpoint, batch, ("outcome",))
    return sorted_.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def outcome_of(spark: SparkSession, table: str, outcome: str, schema: str = f"{schemas.PUBLICATIONS}, reject_reason string") -> DataFrame:
    """The publications that stream_admit() has admitted or rejected; only their folders are read."""
    return read_runs(spark, table, f"{schema}, outcome string").where(F.col("outcome") == outcome).drop("outcome")


def stream_dedupe(df: DataFrame, watermark: str | None = None) -> DataFrame:
    """One row for each np_id: forever, or, with bounded state, as far back as the watermark on created_at."""
    return df.dropDuplicates(["np_id"]) if watermark is None else df.withWatermark("created_at", watermark).dropDuplicatesWithinWatermark(["np_id"])


def metrics(df: DataFrame, every: str = "1 hour", late: str = "1 day", time: str = "created_at") -> DataFrame:
    """(start, n, bytes) per tumbling window; on a stream late rows are waited for as long as the watermark says."""
    rows = df.withWatermark(time, late) if df.isStreaming else df
    return rows.groupBy(F.window(time, every).alias("w")).agg(F.count("*").alias("n"), F.sum("byte_count").alias("bytes")).select(F.col("w.start").alias("start"), "n", "bytes")


def stream_metrics(df: DataFrame, table: str, checkpoint: str, every: str = "1 hour", late: str = "1 day") -> StreamingQuery:
    """Store each window once, when the watermark has passed it; from then on the stream's state no longer holds it."""
    put = lambda rows, batch: write_batch(rows, table, checkpoint, batch)
    return metrics(df, every, late).writeStream.foreachBatch(put).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def metric_table(spark: SparkSession, table: str) -> DataFrame:
    """The finished windows. One that several checkpoints have counted a part of is their sum."""
    return read_runs(spark, table, METRICS).groupBy("start").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))


def metric_rates(windows: DataFrame, every_seconds: int = 3600, per_range: int = 4096) -> DataFrame:
    """(start, n, total, per_second, change) of each interval from the first window to the last, also where nothing came.

    total: all up to and with the interval. change: n less that of the interval before, null for the first. Intervals are
    gone through in ranges of so many: each range gets the last interval of the one before it as a row of its own, and
    the sums of the ranges before it; so no task goes through all.
    """
    spark, at = windows.sparkSession, F.unix_timestamp("start")
    first, last = windows.agg(F.min(at), F.max(at)).first()  # two numbers
    if first is None:
        return windows.select("start", "n", F.lit(0).cast("long").alias("total"), F.lit(0.0).alias("per_second"), F.lit(0).cast("long").alias("change"))
    count = (last - first) // every_seconds + 1
    grid = spark.range(count).withColumnRenamed("id", "i")
    counted = grid.join(windows.select(((at - first) / every_seconds).cast("long").alias("i"), "n"), "i", "left").select("i", F.coalesce("n", F.lit(0)).alias("n"))
    part = F.expr(f"i div {per_range}")
    sums = counted.groupBy(part.alias("part")).agg(F.sum("n").alias("here"))
    before = sums.select("part", F.coalesce(F.sum("here").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a range
    edge = (F.col("i") % per_range == per_range - 1) & (F.col("i") + 1 < count)
    dealt = counted.select("i", "n", part.alias("own"), F.explode(F.when(edge, F.array(part, part + 1)).otherwise(F.array(part))).alias("part"))
    order = W.partitionBy("part").orderBy("i")
    within = F.sum(F.when(F.col("own") == F.col("part"), F.col("n")).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0))
    rows = dealt.withColumn("change", F.col("n") - F.lag("n").over(order)).withColumn("within", within).where("own = part").join(before, "part")
    start = F.timestamp_seconds(F.lit(first) + F.col("i") * every_seconds)
    return rows.select(start.alias("start"), "n", (F.col("before") + F.col("within")).alias("total"), (F.col("n") / F.lit(float(every_seconds))).alias("per_second"), "change")


def repeat(step: Callable[[], None], pause_seconds: float, until: Callable[[], bool]) -> int:
    """Do a step again and again, each so long after the end of the one before, until ``until`` says so; gives the number of steps."""
    done = 0
    while not until():
        if done:
            time.sleep(pause_seconds)
        step()
        done += 1
    return done
