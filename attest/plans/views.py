"""The registry's read queries over its tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.functions.scalars import ROOT
from attest.operators.sequencing import unhash


def list_of(entries: DataFrame, pubkey: Column | str, type_: Column | str = ROOT) -> DataFrame:
    return entries.where((F.col("pubkey") == pubkey) & (F.col("type") == type_)).orderBy("position")


def list_contents(entries: DataFrame, pubs: DataFrame) -> DataFrame:
    """Entries with their publications, by position within each list."""
    return entries.join(pubs.select(F.col("np_id").alias("np"), "full_id", "byte_count"), "np").orderBy("pubkey", "type", "position")


def lists_of(heads: DataFrame, types: DataFrame) -> DataFrame:
    """Lists with their type's URI; that of all types and unknown hashes have none."""
    return unhash(heads, "type", types, "type_uri")


def accounts_report(accounts: DataFrame, heads: DataFrame) -> DataFrame:
    """Accounts by key, the root left out, with the size of their list of all types."""
    sizes = heads.where(F.col("type") == ROOT).select("pubkey", F.col("count").alias("np_count"))
    return accounts.where(F.col("pubkey") != ROOT).join(sizes, "pubkey", "left").withColumn("np_count", F.coalesce("np_count", F.lit(0))).orderBy("pubkey", "agent")


def agent(agents: DataFrame, id_: str) -> DataFrame:
    return agents.where(F.col("agent") == id_)


def agent_accounts(accounts: DataFrame, heads: DataFrame, id_: str) -> DataFrame:
    return accounts_report(accounts.where(F.col("agent") == id_), heads)


def agents_ranked(agents: DataFrame) -> DataFrame:
    """Agents by total ratio, the root marked."""
    return agents.withColumn("is_root", F.col("agent") == ROOT).orderBy(F.desc("total_ratio"), "agent")


def latest_publications(pubs: DataFrame, n: int = 1000) -> DataFrame:
    return pubs.orderBy(F.desc("counter")).limit(n)


def page_publications(pubs: DataFrame, after: str, n: int | None = None) -> DataFrame:
    rows = pubs.where(F.col("np_id") > after).orderBy("np_id")
    return rows if n is None else rows.limit(n)


def pubkeys(lists: DataFrame) -> DataFrame:
    return lists.select("pubkey").distinct()


def publications_by_id(pubs: DataFrame, ids: DataFrame) -> DataFrame:
    return pubs.join(ids.select("np_id"), "np_id", "left_semi")


def snapshot_index(snapshots: DataFrame) -> DataFrame:
    """(hash, counter, created_at) of each snapshot, the last one first."""
    return snapshots.select("hash", "counter", "created_at").distinct().orderBy(F.desc("counter"))


def snapshot(snapshots: DataFrame, hash_: Column | str) -> DataFrame:
    """The accounts and edges of one published state; nested() makes a document of them."""
    return snapshots.where(F.col("hash") == hash_)


def registry_summary(pubs: DataFrame, accounts: DataFrame, agents: DataFrame, trust: DataFrame, coverage_types: str = "all", coverage_agents: str = "viaSetting", settings: tuple[str | None, str | None] = (None, None), status: str | None = None) -> DataFrame:
    """One row: sizes, the last load counter, the trust state (trust: one row trust_hash, trust_counter), coverage, the
    current and the original setting, and the server's status."""
    sizes = pubs.agg(F.count("*").alias("publications"), F.max("counter").alias("load_counter"))
    for one in (accounts.agg(F.count("*").alias("accounts")), agents.agg(F.count("*").alias("agents")), trust.select("trust_hash", "trust_counter")):
        sizes = sizes.crossJoin(F.broadcast(one))  # one row each
    texts = {"coverage_types": coverage_types, "coverage_agents": coverage_agents, "current_setting": settings[0], "original_setting": settings[1], "status": status}
    return sizes.withColumns({k: F.lit(v).cast("string") for k, v in texts.items()})


def status_breakdown(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def endorsements_report(endorsements: DataFrame) -> DataFrame:
    return endorsements.select("agent", "pubkey", "endorsed_np", "source", "status")


def accounts_debug(accounts: DataFrame) -> DataFrame:
    return accounts.select("agent", "pubkey", "depth", "status")


def peer_state(state: DataFrame) -> DataFrame:
    return state.select("url", "setup_id", "load_counter").orderBy("url")
