"""Lists, invalidations and quotas as stateful operators: what a key has is in Spark's state store, and a batch reads none of the history."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from attest.functions.scalars import digest
from attest.operators.admission import filter_covered_types
from attest.operators.lists import LIST, list_heads, memberships
from attest.streaming.runs import read_runs, run_of, runs_before, state_store, write_batch

ENTRIES = "pubkey string, type string, np string, counter bigint, position bigint, checksum string"
BUCKETS = 1 << 12  # in which heads of lists are held together, and rows of a micro-batch are compared


def first_seen(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The rows of a stream whose values of ``by`` have not come before: of a micro-batch the one with the smallest counter (and before it one that is listed).

    A micro-batch's own repeats are settled first, in small groups; what has come before is known to Spark's de-duplication,
    by keys of 16 bytes.
    """

    def first(t: pa.Table) -> pa.Table:
        t = t.sort_by([("listed", "descending"), ("counter", "ascending")] if "listed" in t.column_names else "counter")
        keys = t.column("key").to_pylist()
        seen: set[bytes] = set()
        return t.take(pa.array([i for i, k in enumerate(keys) if not (k in seen or seen.add(k))], pa.int64()))

    keyed = rows.withColumn("key", digest(*by)).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int"))
    return keyed.groupBy("bucket").applyInArrow(first, keyed.schema).dropDuplicates(["key"]).drop("key", "bucket")


class ListHeads(StatefulProcessor):
    """Positions and running checksums of the lists' new members, in order of counter within the batch. Keyed by bucket of lists; the state are their heads."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.heads = handle.getValueState("heads", "heads string")

    def _read(self) -> dict[tuple[str, str], tuple[int, int]]:
        return {(k, t): (n, int(x, 16)) for k, t, n, x in json.loads(self.heads.get()[0])} if self.heads.exists() else {}

    def _write(self, heads: dict[tuple[str, str], tuple[int, int]]) -> None:
        self.heads.update((json.dumps([(k, t, n, f"{x:x}") for (k, t), (n, x) in heads.items()]),))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:
        heads, new = self._read(), pd.concat(list(rows)).sort_values(["counter", "np"], kind="stable")
        positions, sums = [], []
        for k, t, np in zip(new["pubkey"], new["type"], new["np"], strict=True):
            count, state = heads.get((k, t), (0, 0))
            state ^= int.from_bytes(hashlib.sha256(np.encode()).digest(), "big")
            heads[k, t] = (count + 1, state)
            positions.append(count)
            sums.append(f"{state:064x}")
        self._write(heads)
        yield new[["pubkey", "type", "np", "counter"]].assign(position=positions, checksum=sums)

    def handleInitialState(self, key: Any, rows: pd.DataFrame, timers: Any) -> None:
        found = {(k, t): (int(n), int(x, 16)) for k, t, n, x in zip(rows["pubkey"], rows["type"], rows["count"], rows["checksum"], strict=True)}
        self._write(self._read() | found)


def appended(members: DataFrame, entries: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """Entries that a stream of members (pubkey, type, np, counter) adds to the lists; members listed before add nothing.

    entries: what the lists hold at the start (used by a new checkpoint only); known: the same as a stream, all of which
    comes in the first micro-batch. Membership is spread by member, so a list of any size is in all tasks; the head of a
    list is in one bucket, which takes a step for each new member.
    """
    columns = [*LIST, "np", "counter"]
    rows = members.select(*columns, F.lit(False).alias("listed"))
    if known is not None:
        rows = rows.unionByName(known.select(*columns, F.lit(True).alias("listed")))
    new = first_seen(rows, (*LIST, "np")).where("NOT listed")
    bucket = F.pmod(F.xxhash64(*LIST), F.lit(BUCKETS)).cast("int").alias("bucket")
    heads = None if entries is None else list_heads(entries).select(bucket, *LIST, "count", "checksum").groupBy("bucket")
    return new.select(bucket, *columns).groupBy("bucket").transformWithStateInPandas(ListHeads(), ENTRIES, "append", "none", heads)


def start_lists(members: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append a stream's members to the lists stored in table/entries, and go on from what other checkpoints have listed there.

    Which runs were there when a checkpoint began is kept beside it, as its first micro-batch reads what they listed.
    """
    spark, at = members.sparkSession, f"{table}/entries"
    before = runs_before(spark, at, checkpoint)
    known = entries = None
    if before:
        listed = f"{at}/run={{{','.join(before)}}}/batch=*"
        known = spark.readStream.schema(ENTRIES).parquet(listed)
        entries = spark.read.schema(ENTRIES).parquet(listed) if run_of(spark, checkpoint) is None else None
    put = lambda df, batch: write_batch(df, at, checkpoint, batch)
    with state_store(spark):
        return appended(members, entries, known).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_append_lists(df: DataFrame, table: str, checkpoint: str, coverage: str | None = None, inherit: bool = False) -> StreamingQuery:
    """Append publications to the lists of their key and types.

    inherit: also to the lists of what they invalidate (df has invalidates, as for followed_invalidations()).
    """
    members = memberships(df, coverage)
    if inherit:
        members = members.unionByName(filter_covered_types(followed_invalidations(df).where("type IS NOT NULL"), coverage).select(*members.columns))
    return start_lists(members, table, checkpoint)


def list_table(spark: SparkSession, table: str) -> DataFrame:
    """The entries of the lists stored there, whichever checkpoint wrote them."""
    return read_runs(spark, f"{table}/entries", ENTRIES)


FOLLOWED = "pubkey string, type string, np string, counter bigint, invalidated_np string"


def followed_invalidations(df: DataFrame) -> DataFrame:
    """From publications with invalidates (array of np_id): FOLLOWED rows as soon as both sides of an invalidation by the same key are there.

    A join of the stream with itself brings them together, whichever comes first. A publication waits for ever for what
    may invalidate it, as the registry keeps all, and so does an invalidation for its publication; each counts as it came
    first. Gives an invalidator as member of each list of what it invalidates (inherited), and a row without type for each
    pair that has met (the mark of the invalidated publication).
    """
    kinds = F.coalesce("types", F.array().cast("array<string>"))
    pubs = first_seen(df.select("pubkey", F.col("np_id").alias("target"), "counter", kinds.alias("types")), ("pubkey", "target"))
    told = df.select("pubkey", F.col("np_id").alias("np"), "counter", kinds.alias("own"), F.explode("invalidates").alias("target"))
    told = first_seen(told, ("pubkey", "target", "np"))
    found = told.withColumn("pair", digest("pubkey", "target")).join(pubs.select(digest("pubkey", "target").alias("pair"), "types"), "pair")
    lists = F.concat(F.array(F.lit(None).cast("string")), F.array_except("types", "own"))
    return found.select("pubkey", F.explode(lists).alias("type"), "np", "counter", F.col("target").alias("invalidated_np"))


def stream_invalidations(df: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Store what followed_invalidations() finds: read by inherited_members() and invalidation_marks()."""
    put = lambda rows, batch: write_batch(rows, f"{table}/followed", checkpoint, batch)
    with state_store(df.sparkSession):
        return followed_invalidations(df).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def inherited_members(spark: SparkSession, table: str) -> DataFrame:
    """(pubkey, type, np, counter): invalidating publications in the lists of what they invalidate, and not by their own types there."""
    return read_runs(spark, f"{table}/followed", FOLLOWED).where("type IS NOT NULL").select(*LIST, "np", "counter").distinct()


def invalidation_marks(spark: SparkSession, table: str) -> DataFrame:
    """(pubkey, np): publications that one of the same key has invalidated."""
    return read_runs(spark, f"{table}/followed", FOLLOWED).where("type IS NULL").select("pubkey", F.col("invalidated_np").alias("np")).distinct()


class QuotaCount(StatefulProcessor):
    """Lets a key's publications through in order of counter up to its quota; the state is their number."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "count bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timers: Any) -> Iterator[pd.DataFrame]:
        have = self.count.get()[0] if self.count.exists() else 0
        new = pd.concat(list(rows)).sort_values(["counter", "np_id"], kind="stable")
        passed = new.head(max(0, int(new["quota"].max()) - have))
        if len(passed):
            self.count.update((have + len(passed),))
            yield passed.drop(columns="quota")

    def handleInitialState(self, key: Any, rows: pd.DataFrame, timers: Any) -> None:
        self.count.update((int(rows["count"].max()),))


def stream_quota_gate(df: DataFrame, quotas: DataFrame, table: str, checkpoint: str, have: DataFrame | None = None) -> StreamingQuery:
    """Store the publications that fit each key's quota (pubkey, quota) in table/passed, counting on from batch to batch.

    have: (pubkey, count) of what the keys' lists hold when the checkpoint is new, on top of what other checkpoints have
    let through here. Keys without quota are not allowed anything.
    """
    spark, schema = df.sparkSession, df.schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    start = None
    if run_of(spark, checkpoint) is None:
        counts = read_runs(spark, f"{table}/passed", ddl).groupBy("pubkey").agg(F.count("*").alias("count"))
        both = counts if have is None else counts.unionByName(have.select("pubkey", F.col("count").cast("long")))
        total = both.groupBy("pubkey").agg(F.sum("count").alias("count"))
        start = None if total.isEmpty() else total.groupBy("pubkey")
    limit = quotas.groupBy("pubkey").agg(F.max("quota").alias("quota"))
    passed = df.join(limit, "pubkey").where("quota > 0").groupBy("pubkey").transformWithStateInPandas(QuotaCount(), schema, "append", "none", start)
    put = lambda rows, batch: write_batch(rows.select(*schema.names), f"{table}/passed", checkpoint, batch)
    with state_store(spark):
        return passed.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def passed_publications(spark: SparkSession, table: str, schema: str) -> DataFrame:
    return read_runs(spark, f"{table}/passed", schema)
