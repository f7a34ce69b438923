"""Comparing and synchronising registries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attest.functions.scalars import ROOT, digest
from attest.operators.lists import LIST, list_heads


def list_checkpoints(entries: DataFrame, digits: int = 18) -> DataFrame:
    """(pubkey, type, position, checksum) at the list's end and 10, 100, 1000 ... before it.

    Entries that say how many are behind them (list_entries(after=True)) are only looked through; others meet their heads.
    """
    offsets = [0, *[10**k for k in range(1, digits)]]
    if "after" in entries.columns:
        return entries.where(F.col("after").isin(offsets)).select(*LIST, "position", "checksum")
    heads = entries.groupBy(*LIST).agg(F.max("position").alias("last"))
    each = F.array(*[F.lit(o).cast("long") for o in offsets])
    wanted = heads.select(*LIST, F.explode(F.filter(F.transform(each, lambda o: F.col("last") - o), lambda p: p >= 0)).alias("position"))
    return wanted.join(entries.select(*LIST, "position", "checksum"), [*LIST, "position"])


def list_delta(entries: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """The entries after the furthest position whose checksum is among a peer's checkpoints; all where none is.

    What agrees is found by 16 bytes for each entry that stand for its list and checksum.
    """
    key = digest(*LIST, "checksum").alias("key")
    sought = checkpoints.select(*LIST, key).distinct()
    known = entries.select(key, "position").join(sought, "key").groupBy(*LIST).agg(F.max("position").alias("known"))
    return entries.join(known, LIST, "left").where(F.col("position") > F.coalesce("known", F.lit(-1))).drop("known")


def publications_after(pubs: DataFrame, counter: int = -1) -> DataFrame:
    return pubs.where(F.col("counter") > counter).orderBy("counter")


def lists_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """(pubkey, type, equal): whether both sides hold the same set, told from the heads alone."""
    return heads_equal(list_heads(a), list_heads(b))


def heads_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """lists_equal() of two registries whose heads are known, as from heads_of_members(): no list is built for it."""
    x, y = a.select(*LIST, F.col("checksum").alias("x")), b.select(*LIST, F.col("checksum").alias("y"))
    return x.join(y, LIST, "full").select(*LIST, F.col("x").eqNullSafe(F.col("y")).alias("equal"))


def list_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(pubkey, type, np, missing_in): entries of one side only."""
    key = [*LIST, "np"]
    only = lambda x, y, name: x.select(*key).join(y.select(*key), key, "left_anti").withColumn("missing_in", F.lit(name))
    return only(a, b, "b").unionByName(only(b, a, "a"))


def discover_pubkeys(peer_keys: DataFrame, lists: DataFrame) -> DataFrame:
    """(pubkey, status, known): a peer's keys; loaded lists are left alone, all others become encountered."""
    have = lists.where(F.col("type") == ROOT).select("pubkey", "status").withColumn("known", F.lit(True))
    joined = peer_keys.select("pubkey").distinct().join(have, "pubkey", "left")
    return joined.select("pubkey", F.when(F.col("status") == "loaded", "loaded").otherwise("encountered").alias("status"), F.coalesce("known", F.lit(False)).alias("known"))


def eligible_peers(peers: DataFrame) -> DataFrame:
    ok = F.col("http_status").between(200, 299) & ~F.coalesce("is_test", F.lit(False)) & F.col("status").isin("ready", "updating")
    return peers.where(ok & F.col("setup_id").isNotNull() & F.col("load_counter").isNotNull())


def peer_sync_plan(peers: DataFrame, state: DataFrame) -> DataFrame:
    """(url, action, after, setup_id, load_counter). A new peer, and one that was set up anew, is only discovered: it starts from 0 next time.

    Incremental peers are discovered as well; those to be skipped have nothing new.
    """
    seen = state.select("url", F.col("setup_id").alias("old_setup"), F.col("load_counter").alias("old_counter"))
    action = F.when(F.col("old_setup").isNull(), "discover").when(F.col("old_setup") != F.col("setup_id"), "reset").when(F.col("old_counter") == F.col("load_counter"), "skip").otherwise("incremental")
    return peers.join(seen, "url", "left").withColumn("action", action).select("url", "action", F.when(F.col("action").isin("skip", "incremental"), F.col("old_counter")).otherwise(0).alias("after"), "setup_id", "load_counter")


def next_peer_state(plan: DataFrame, received: DataFrame) -> DataFrame:
    """(url, setup_id, load_counter) to store after a sync: the counter of the last publication received, else the one before.

    received: (url, last_received) of incremental fetches; -1, null or no row where nothing came.
    """
    last = received.groupBy("url").agg(F.max("last_received").alias("last"))
    counter = F.when((F.col("action") == "incremental") & (F.col("last") > 0), F.col("last")).otherwise(F.col("after"))
    return plan.join(last, "url", "left").select("url", "setup_id", counter.cast("long").alias("load_counter"))


def load_plan(accounts: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """(agent, pubkey, type): accounts to load, for each covered type or for all. types is a setting's few words."""
    due = accounts.where("status = 'toLoad'").select("agent", "pubkey")
    if types is None:
        return due.withColumn("type", F.lit(ROOT))
    names = [r.type for r in types.select("type").distinct().collect()]
    return due.withColumn("type", F.explode(F.array(*[F.lit(n) for n in sorted(names)])))


def optional_load_batch(lists: DataFrame, sizes: DataFrame, intro_type: str, endorse_type: str, budget: int = 100, stored: DataFrame | None = None, chunk_bits: int = 12) -> DataFrame:
    """(pubkey, type, phase, n, spent): lists to load now, by phase and key, until the budget was spent before.

    Phase 0 takes encountered intro lists, and with each its key's endorsement list: n is the size of both. Phase 1 takes
    encountered lists of all types, and those of keys that phase 0 has core-loaded and that had no such list; as it only
    begins when phase 0 has come to its end, these are all its keys. There n is the list's size and what is stored of the
    key already (stored: pubkey, n), since it is gone through again.

    Sizes are summed over ranges of keys first; only ranges up to the one where the budget ends are gone through.
    """
    size = lambda kind, name: sizes.where(F.col("type") == kind).groupBy("pubkey").agg(F.sum("n").alias(name))
    intro = lists.where((F.col("status") == "encountered") & (F.col("type") == intro_type)).select("pubkey").distinct()
    core = intro.join(size(intro_type, "x"), "pubkey", "left").join(size(endorse_type, "y"), "pubkey", "left")
    core = core.select("pubkey", F.lit(intro_type).alias("type"), F.lit(0).alias("phase"), (F.coalesce("x", F.lit(0)) + F.coalesce("y", F.lit(0))).alias("n"))
    whole = lists.where(F.col("type") == ROOT)
    due = whole.where("status = 'encountered'").select("pubkey").distinct().unionByName(intro.join(whole.select("pubkey"), "pubkey", "left_anti"))
    again = sizes.limit(0).select("pubkey", F.col("n").alias("z")) if stored is None else stored.groupBy("pubkey").agg(F.sum("n").alias("z"))
    full = due.join(size(ROOT, "x"), "pubkey", "left").join(again, "pubkey", "left").select("pubkey", F.lit(ROOT).alias("type"), F.lit(1).alias("phase"), (F.coalesce("x", F.lit(0)) + F.coalesce("z", F.lit(0))).alias("n"))
    due = core.unionByName(full).withColumn("part", F.substring("pubkey", 1, chunk_bits // 4))
    parts = due.groupBy("phase", "part").agg(F.sum("n").alias("total"))
    offset = parts.select("phase", "part", F.coalesce(F.sum("total").over(W.orderBy("phase", "part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before")).where(F.col("before") < budget)
    within = F.coalesce(F.sum("n").over(W.partitionBy("phase", "part").orderBy("pubkey").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return due.join(offset, ["phase", "part"]).withColumn("spent", F.col("before") + within).where(F.col("spent") < budget).select("pubkey", "type", "phase", "n", "spent")
