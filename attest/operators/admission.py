"""Admission rules, coverage, and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attest.functions.scalars import ROOT, artifact_code, hash_of

# The types that every registry covers.
CORE_TYPES = ("http://purl.org/nanopub/x/declaredBy", "http://purl.org/nanopub/x/approvesOf")


def admission_reason(df: DataFrame, now: Column, max_triples: int = 1200, max_bytes: int = 1_000_000, skew_s: int = 60, local: bool = False) -> DataFrame:
    """df with reject_reason: the first rule a publication breaks, null if it breaks none.

    A missing creation time passes. Every limit may be reached but not exceeded.
    """
    reason = (
        F.when(F.col("sig_pubkey").isNull(), "no valid key")
        .when(F.col("triple_count") > max_triples, "too many triples")
        .when(F.col("byte_count") > max_bytes, "too large")
        .when(F.col("is_protected") & F.lit(not local), "protected")
        .when(F.col("created_at") > now + F.expr(f"INTERVAL {skew_s} SECONDS"), "in the future")
        .when(F.exists("graph_uris", lambda g: ~g.startswith(F.col("full_id"))), "foreign graph")
        .when(F.col("sig_pubkey") != F.col("pubkey"), "unexpected key")
        .when(artifact_code(F.col("full_id")).isNull(), "no artifact code")
    )
    return df.withColumn("reject_reason", reason)


def admit(df: DataFrame, now: Column, **limits) -> DataFrame:
    return admission_reason(df, now, **limits).where("reject_reason IS NULL").drop("reject_reason")


def rejected(df: DataFrame, now: Column, **limits) -> DataFrame:
    return admission_reason(df, now, **limits).where("reject_reason IS NOT NULL")


def covered_types(config: str | None) -> tuple[str, ...] | None:
    """Type URIs of a coverage setting, core types included; None (all) for a blank one or ``all``."""
    tokens = (config or "").split()
    if not tokens or (len(tokens) == 1 and tokens[0].lower() == "all"):
        return None
    return tuple(dict.fromkeys([*tokens, *CORE_TYPES]))


def covered_type_hashes(spark: SparkSession, config: str | None) -> DataFrame | None:
    """type: the hashes of covered_types(); a setting's few words."""
    types = covered_types(config)
    return None if types is None else spark.createDataFrame([(t,) for t in types], "uri string").select(hash_of(F.col("uri")).alias("type")).distinct()


def _hashes(config: str | None) -> Column | None:
    types = covered_types(config)
    return None if types is None else F.array(*[hash_of(F.lit(t)) for t in types])


def filter_covered(df: DataFrame, config: str | None) -> DataFrame:
    """Publications with a covered type (hashes in ``types``), or with none at all."""
    covered = _hashes(config)
    return df if covered is None else df.where((F.coalesce(F.size("types"), F.lit(0)) <= 0) | F.arrays_overlap("types", covered))


def filter_covered_types(rows: DataFrame, config: str | None) -> DataFrame:
    """Rows of covered types; the list of all types always passes."""
    covered = _hashes(config)
    return rows if covered is None else rows.where((F.col("type") == ROOT) | F.array_contains(covered, F.col("type")))


def parse_agent_filter(spark: SparkSession, config: str | None) -> tuple[DataFrame, bool]:
    """(pubkey, quota) and whether the setting's accounts count: from words ``viaSetting`` and ``hash:quota``; default viaSetting."""
    rows, via_setting = [], False
    for token in (config or "viaSetting").split() or ["viaSetting"]:
        key, colon, quota = token.rpartition(":")
        if token == "viaSetting":
            via_setting = True
        elif colon and key and ":" not in key and quota.lstrip("-").isdigit():
            rows.append((key, int(quota)))
        else:
            raise ValueError(f"not an agent filter: {token!r}")
    return spark.createDataFrame(rows, "pubkey string, quota int"), via_setting


def effective_quota(pubkeys: DataFrame, accounts: DataFrame, explicit: DataFrame, via_setting: bool = True) -> DataFrame:
    """(pubkey, quota): the explicit quota, else that of a loaded account, else of one to be loaded, else -1 (not allowed).

    Of several accounts or entries the largest quota counts.
    """
    of = lambda status: F.max(F.when(F.col("status") == status, F.col("quota")))
    known = accounts.where(F.col("status").isin("loaded", "toLoad") & F.lit(via_setting)).groupBy("pubkey").agg(of("loaded").alias("loaded"), of("toLoad").alias("to_load"))
    given = explicit.groupBy("pubkey").agg(F.max("quota").alias("explicit"))
    return pubkeys.select("pubkey").distinct().join(given, "pubkey", "left").join(known, "pubkey", "left").select("pubkey", F.coalesce("explicit", "loaded", "to_load", F.lit(-1)).alias("quota"))


def filter_allowed(df: DataFrame, quotas: DataFrame, enforce: bool = True) -> DataFrame:
    return df.join(quotas.where("quota >= 0").select("pubkey"), "pubkey", "left_semi") if enforce else df


def over_quota(pubkeys: DataFrame, heads: DataFrame, quotas: DataFrame, enforce: bool = True) -> DataFrame:
    """(pubkey, over): whether a key's list of all types has reached its quota; keys without quota are not allowed."""
    size = heads.where(F.col("type") == ROOT).select("pubkey", F.col("count").alias("size"))
    joined = pubkeys.select("pubkey").distinct().join(quotas, "pubkey", "left").join(size, "pubkey", "left")
    quota = F.coalesce("quota", F.lit(-1))
    return joined.select("pubkey", (F.lit(enforce) & ((quota < 0) | (F.coalesce("size", F.lit(0)) >= quota))).alias("over"))


def cap_to_quota(pubs: DataFrame, quotas: DataFrame, existing: DataFrame, chunk: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """The publications that fit each key's quota in load order, and (pubkey, status) of every key here or in existing.

    existing: (pubkey, count) of what is there already, one row a key. A key is skipped without a quota, capped if it has
    reached its quota (also with nothing new), else loaded. A key's publications are numbered within ranges of the counter
    and the ranges' sizes added afterwards, so that a key of any size never meets in one task.
    """
    joined = pubs.join(quotas, "pubkey", "left").join(existing.withColumnRenamed("count", "have"), "pubkey", "left")
    joined = joined.withColumn("quota", F.coalesce("quota", F.lit(-1))).withColumn("have", F.coalesce("have", F.lit(0)))
    joined = joined.withColumn("chunk", F.floor(F.col("counter") / chunk))
    sizes = joined.groupBy("pubkey", "chunk").agg(F.count("*").alias("n"), F.max("quota").alias("most"), F.max("have").alias("had"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("pubkey").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    open_ = sizes.select("pubkey", "chunk", "most", (before + F.col("had")).alias("before")).where(F.col("before") < F.col("most")).select("pubkey", "chunk", "before")
    ranked = joined.join(open_, ["pubkey", "chunk"]).withColumn("at", F.row_number().over(W.partitionBy("pubkey", "chunk").orderBy("counter", "np_id")) + F.col("before"))
    new = sizes.groupBy("pubkey").agg(F.sum("n").alias("n"))
    total = new.join(existing.select("pubkey", F.col("count").alias("have")), "pubkey", "full").join(quotas.select("pubkey", "quota"), "pubkey", "left")
    reached, quota = F.coalesce("n", F.lit(0)) + F.coalesce("have", F.lit(0)), F.coalesce("quota", F.lit(-1))
    status = total.select("pubkey", F.when(quota < 0, "skipped").when(reached >= quota, "capped").otherwise("loaded").alias("status"))
    return ranked.where(F.col("at") <= F.col("quota")).select(*pubs.columns), status


def followed_edges(edges: DataFrame, bootstrap: tuple[str, ...] = ()) -> DataFrame:
    """Edges that trust follows: those not invalidated, and those of the bootstrap settings in any case."""
    return edges.where(~F.col("invalidated") | F.col("source").isin(*bootstrap)) if bootstrap else edges.where(~F.col("invalidated"))


def exists_in(df: DataFrame, other: DataFrame, on: list[str], negate: bool = False) -> DataFrame:
    return df.join(other.select(*on), on, "left_anti" if negate else "left_semi")


def first_match(df: DataFrame, other: DataFrame, on: list[str], value: str) -> DataFrame:
    """df with the smallest matching value of the other table, null without a match."""
    return df.join(other.groupBy(*on).agg(F.min(value).alias(value)), on, "left")


def max_row(df: DataFrame, by: str, keys: list[str]) -> DataFrame:
    """The row with the largest value for each key; of ties the largest row."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max(F.struct(by, *[c for c in rest if c != by])).alias("best"))
    return best.select(*keys, *[F.col(f"best.{c}").alias(c) for c in rest])
