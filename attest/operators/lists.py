"""Append-only lists, one for each key and type, with positions and running XOR checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attest.functions.scalars import ROOT, digest, hash_of, hex_words, words_hex, xor_words
from attest.operators.admission import CORE_TYPES, filter_covered_types

LIST = ["pubkey", "type"]


def memberships(pubs: DataFrame, config: str | None = None) -> DataFrame:
    """(pubkey, type, np, counter) of each publication row: its key's list of all types, and one for each covered type. Also on a stream."""
    kinds = F.array_union(F.array(F.lit(ROOT)), F.coalesce("types", F.array().cast("array<string>")))
    rows = pubs.select("pubkey", F.explode(kinds).alias("type"), F.col("np_id").alias("np"), "counter")
    return filter_covered_types(rows, config)


def list_memberships(pubs: DataFrame, config: str | None = None) -> DataFrame:
    """memberships(), distinct: a publication that comes again keeps its first counter."""
    return memberships(pubs, config).groupBy("pubkey", "type", "np").agg(F.min("counter").alias("counter"))


def list_entries(members: DataFrame, heads: DataFrame | None = None, chunk: int = 1 << 20, after: bool = False) -> DataFrame:
    """(pubkey, type, np, counter, position, checksum): 0-based dense positions in load order and running checksums.

    A list of any length is cut by ranges of the counter: positions and XORs run within a chunk, the chunks' sizes and
    XORs run over the chunks, so no task ever holds a whole list. Only lists in buckets of more than ``chunk`` members
    are cut; the others, which are most, need nothing but their own rows. With heads the lists go on from there: a head
    goes before its list's members as a row that counts for all that it stands for. after: also the number of entries
    behind each one.
    """
    words, bucket = [f"w{i}" for i in range(8)], F.pmod(F.xxhash64(*LIST), F.lit(1 << 16)).alias("bucket")
    full = members.groupBy(bucket).agg(F.count("counter").alias("n")).where(F.col("n") > chunk).select("bucket", F.lit(True).alias("full"))
    rows = members.select(*LIST, "np", "counter", F.lit(1).cast("long").alias("n"), F.lit(None).cast("string").alias("sum"))
    if heads is not None:
        rows = rows.unionByName(heads.select(*LIST, F.lit(None).cast("string").alias("np"), F.lit(-(1 << 62)).alias("counter"), F.col("count").cast("long").alias("n"), F.col("checksum").alias("sum")))
    cut = rows.withColumn("own", bucket).join(F.broadcast(full), F.col("own").eqNullSafe(F.col("bucket")), "left").withColumn("chunk", F.when(F.col("full"), F.floor(F.col("counter") / chunk))).drop("own", "bucket", "full")  # null-safe, and lists by their digests below: what the planner adds for plain keys would have the members shuffled again
    dealt = cut.repartition(*LIST, "chunk")  # before the words are made, so that these stay where they are
    dealt = dealt.withColumns(dict(zip(words, hex_words(F.coalesce("sum", hash_of(F.col("np")))), strict=True)))
    here = W.partitionBy(*LIST, "chunk").orderBy(F.col("sum").isNull(), "counter", "np").rowsBetween(W.unboundedPreceding, 0)
    behind = [(F.sum("n").over(W.partitionBy(*LIST, "chunk")) - F.sum("n").over(here)).alias("after")] if after else []
    inside = dealt.select(*LIST, "np", "counter", "chunk", "sum", (F.sum("n").over(here) - 1).alias("position"), *[F.bit_xor(w).over(here).alias(w) for w in words], *behind).where("sum IS NULL")
    totals = dealt.where("chunk IS NOT NULL").groupBy(digest(*LIST).alias("list"), "chunk").agg(*[F.max(c).alias(c) for c in LIST], F.sum("n").alias("n"), *[F.bit_xor(w).alias(w) for w in words])
    order = W.partitionBy("list").orderBy("chunk")
    earlier, later = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(1, W.unboundedFollowing)
    offsets = totals.select(*LIST, "chunk", F.sum("n").over(earlier).alias("before"), F.sum("n").over(later).alias("later"), *[F.bit_xor(w).over(earlier).alias(f"b{i}") for i, w in enumerate(words)])
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = [*LIST, "np", "counter", (F.col("position") + zero("before")).alias("position"), words_hex([F.col(w).bitwiseXOR(zero(f"b{i}")) for i, w in enumerate(words)]).alias("checksum")]
    return inside.join(offsets, [*LIST, "chunk"], "left").select(*out, *([(F.col("after") + zero("later")).alias("after")] if after else []))


def list_heads(entries: DataFrame) -> DataFrame:
    """(pubkey, type, max_position, count, checksum) of each list."""
    return entries.groupBy(*LIST).agg(F.max("position").alias("max_position"), (F.max("position") + 1).alias("count"), F.max_by("checksum", "position").alias("checksum"))


def heads_of_members(members: DataFrame) -> DataFrame:
    """list_heads() of the lists that members (pubkey, type, np, counter) make, without building them: XOR has no order."""
    words = [f"w{i}" for i in range(8)]
    found = members.select(*LIST, *[w.alias(n) for n, w in zip(words, xor_words(F.col("np")), strict=True)]).groupBy(*LIST).agg(F.count("*").alias("count"), *[F.bit_xor(w).alias(w) for w in words])
    return found.select(*LIST, (F.col("count") - 1).alias("max_position"), "count", words_hex([F.col(w) for w in words]).alias("checksum"))


def append_to_lists(heads: DataFrame, entries: DataFrame, new: DataFrame) -> DataFrame:
    """The entries that new members (pubkey, type, np, counter) add; members already listed add nothing."""
    return list_entries(new.join(entries.select(*LIST, "np"), [*LIST, "np"], "left_anti"), heads)


def inherit_invalidations(entries: DataFrame, invalidations: DataFrame, pubs: DataFrame) -> DataFrame:
    """Members (pubkey, type, np, counter) to append: an invalidating publication of the same key belongs in every list of what it invalidates."""
    pairs = invalidations.select(F.col("invalidating_np").alias("by"), F.col("invalidating_pubkey").alias("pubkey"), F.col("invalidated_np").alias("np"))
    rows = entries.select(*LIST, "np").join(pairs, ["np", "pubkey"]).select("pubkey", "type", F.col("by").alias("np")).distinct()
    return rows.join(entries.select(*LIST, "np"), [*LIST, "np"], "left_anti").join(pubs.select(F.col("np_id").alias("np"), "counter"), "np").select("pubkey", "type", "np", "counter")


def mark_invalidated(entries: DataFrame, invalidations: DataFrame) -> DataFrame:
    """entries with invalidated: whether a publication of the same key invalidates them."""
    hit = invalidations.select(F.col("invalidating_pubkey").alias("pubkey"), F.col("invalidated_np").alias("np")).distinct().withColumn("hit", F.lit(True))
    return entries.join(hit, ["pubkey", "np"], "left").withColumn("invalidated", F.col("hit").isNotNull()).drop("hit")


def invalidators_of(ids: DataFrame, invalidations: DataFrame) -> DataFrame:
    return invalidations.join(ids.select(F.col("np_id").alias("invalidated_np")).distinct(), "invalidated_np", "left_semi")


def route_publications(pubs: DataFrame, lists: DataFrame, core: tuple[str, str], check_type: bool = False) -> DataFrame:
    """(np_id, pubkey, type): the lists a publication goes to. type null: it is only stored, and its key is to be noted as encountered.

    A key whose list of all types is loaded takes all its types; one whose intro list is loaded takes the two core
    lists, whatever the publication's type unless check_type.
    """
    state = lists.groupBy("pubkey").agg(F.max((F.col("type") == ROOT) & (F.col("status") == "loaded")).alias("all_loaded"), F.max((F.col("type") == core[0]) & (F.col("status") == "loaded")).alias("core_loaded"))
    cores = F.array(*[F.lit(c) for c in core])
    chosen = F.array_intersect("types", cores) if check_type else cores
    target = F.when(F.col("all_loaded"), F.array_union(F.array(F.lit(ROOT)), F.coalesce("types", F.array().cast("array<string>")))).when(F.col("core_loaded"), chosen)
    return pubs.join(state, "pubkey", "left").select("np_id", "pubkey", F.explode_outer(target).alias("type"))


def core_types(hash_: bool = True) -> tuple[Column, ...]:
    return tuple(F.sha2(F.lit(t), 256) if hash_ else F.lit(t) for t in CORE_TYPES)


def backfill_lists(pubs: DataFrame, entries: DataFrame, loaded: DataFrame, config: str | None = None) -> DataFrame:
    """Members to append when keys (pubkey) have become loaded: their stored, covered publications that are not listed yet."""
    members = list_memberships(pubs.join(loaded.select("pubkey").distinct(), "pubkey", "left_semi"), config)
    return members.join(entries.select(*LIST, "np"), [*LIST, "np"], "left_anti")


def promote_lists(lists: DataFrame, steps: DataFrame) -> DataFrame:
    """(pubkey, type, status): the furthest state of each list among encountered, loading and loaded."""
    both = lists.select(*LIST, "status").unionByName(steps.select(*LIST, "status"))
    rank = F.array_position(F.array(F.lit("encountered"), F.lit("loading"), F.lit("loaded")), F.col("status"))
    return both.groupBy(*LIST).agg(F.max_by("status", rank).alias("status"))
