"""Trust: paths from the root over endorsement edges, and the scores, quotas and agents that follow from them.

An account is expanded at most once, by its best path, so there are no more paths than followed edges and one, and at
most ten rounds of one join each. The edges' shares do not change between rounds and are computed once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attest.functions.scalars import ROOT, exact_sum, path_intermediates, path_sorthash, quota_from_ratio
from attest.operators.admission import followed_edges
from attest.sources.shared import checkpointed, materialized

KEY = ["agent", "pubkey"]
EDGE = ["from_agent", "from_pubkey", "to_agent", "to_pubkey", "source"]
HANDED_ON, RETAINED = 0.9, 0.1


def seed_trust(spark: SparkSession, elements: DataFrame, setting: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The root's path, its account, and its endorsements of the elements (endorsed_np) of the setting's index."""
    one = spark.range(1)
    who = [F.lit(ROOT).alias("agent"), F.lit(ROOT).alias("pubkey")]
    path = one.select(F.lit(ROOT).alias("id"), path_sorthash(F.lit(setting), F.lit(ROOT)).alias("sorthash"), *who, F.lit(0).alias("depth"), F.lit(1.0).alias("ratio"), F.lit("extended").alias("type"))
    account = one.select(*who, F.lit("visited").alias("status"), F.lit(0).alias("depth"))
    endorsements = elements.select(*who, "endorsed_np", F.lit(setting).alias("source"), F.lit("toRetrieve").alias("status")).distinct()
    return path, account, endorsements


def seed_explicit(explicit: DataFrame) -> DataFrame:
    """Accounts where trust is switched off: one to be loaded for each explicit key."""
    return explicit.groupBy("pubkey").agg(F.max("quota").alias("quota")).select(F.lit("").alias("agent"), "pubkey", F.lit("toLoad").alias("status"), F.lit(0).alias("depth"), "quota")


def build_trust_edges(endorsements: DataFrame, declarations: DataFrame, invalidations: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Edges from an endorsing account to every account that the endorsed introduction declares; earlier edges stay as they are."""
    rows = endorsements.join(declarations.select(F.col("intro_np").alias("endorsed_np"), F.col("agent").alias("to_agent"), F.col("pubkey").alias("to_pubkey")), "endorsed_np")
    edges = edge_invalidated(rows.select(F.col("agent").alias("from_agent"), F.col("pubkey").alias("from_pubkey"), "to_agent", "to_pubkey", "source").distinct(), invalidations)
    return edges if previous is None else previous.select(*edges.columns).unionByName(edges.join(previous.select(*EDGE), EDGE, "left_anti"))


def edge_invalidated(edges: DataFrame, invalidations: DataFrame) -> DataFrame:
    """edges with invalidated: whether their own key has invalidated their source."""
    hit = invalidations.select(F.col("invalidated_np").alias("source"), F.col("invalidating_pubkey").alias("from_pubkey")).distinct().withColumn("hit", F.lit(True))
    return edges.join(hit, ["source", "from_pubkey"], "left").select(*EDGE, F.col("hit").isNotNull().alias("invalidated"))


def resolve_account_names(declarations: DataFrame) -> DataFrame:
    """(agent, pubkey, name, name_created_at, intro_np): from the latest named introduction; without one the smallest introduction and no name."""
    named = F.col("intro_name").isNotNull()
    latest = F.max(F.when(named, F.struct(F.coalesce("created_at", F.lit("0001-01-01").cast("timestamp")).alias("at"), "intro_np", "intro_name", "created_at"))).alias("best")
    found = declarations.groupBy(*KEY).agg(latest, F.min("intro_np").alias("first"))
    return found.select(*KEY, F.col("best.intro_name").alias("name"), F.col("best.created_at").alias("name_created_at"), F.coalesce("best.intro_np", "first").alias("intro_np"))


def endorsement_status(endorsements: DataFrame, intros: DataFrame) -> DataFrame:
    known = intros.select(F.col("intro_np").alias("endorsed_np")).distinct().withColumn("hit", F.lit(True))
    return endorsements.join(known, "endorsed_np", "left").withColumn("status", F.when(F.col("hit"), "retrieved").otherwise("discarded")).drop("hit")


def edge_fanout(followed: DataFrame) -> DataFrame:
    """(from_agent, from_pubkey, to_agent, to_pubkey, n_agents, n_keys): each followed pair of accounts once."""
    pairs = followed.select(*EDGE[:4]).distinct()
    keys = pairs.groupBy(*EDGE[:3]).agg(F.count("*").alias("n_keys"))
    agents = keys.groupBy(*EDGE[:2]).agg(F.count("*").alias("n_agents"))
    return pairs.join(keys, EDGE[:3]).join(agents, EDGE[:2]).select(*EDGE[:4], "n_agents", "n_keys")


def best_paths(paths: DataFrame, frontier: DataFrame, depth: int) -> DataFrame:
    """The extended path of each frontier account at this depth with the largest ratio, ties by sorthash."""
    rows = paths.where((F.col("depth") == depth) & (F.col("type") == "extended")).join(frontier.select(*KEY), KEY, "left_semi")
    return rows.groupBy(*KEY).agg(F.min(F.struct((-F.col("ratio")).alias("order"), "sorthash", "id")).alias("b")).select(*KEY, F.col("b.id").alias("id"), (-F.col("b.order")).alias("ratio"))


def expand_paths(best: DataFrame, fanout: DataFrame, setting: str, depth: int, simple: bool = False) -> DataFrame:
    """The paths that go on from the best paths over all followed edges; nine tenths of the ratio go to agents evenly, then to their keys.

    simple: not to accounts that the path has been to. What such an edge would have got goes to nobody.
    """
    to = best.select(F.col("agent").alias("from_agent"), F.col("pubkey").alias("from_pubkey"), "id", "ratio").join(fanout, EDGE[:2])
    if simple:
        to = to.where(~F.array_contains(F.split("id", " "), F.concat("to_agent", F.lit("|"), "to_pubkey")))
    child = F.concat("id", F.lit(" "), "to_agent", F.lit("|"), "to_pubkey")
    return to.select(
        child.alias("id"), path_sorthash(F.lit(setting), child).alias("sorthash"), F.col("to_agent").alias("agent"), F.col("to_pubkey").alias("pubkey"), F.lit(depth).alias("depth"),
        (F.col("ratio") * F.lit(HANDED_ON) / F.col("n_agents") / F.col("n_keys")).alias("ratio"), F.lit("extended").alias("type"),
    )


def retain_parent(paths: DataFrame, best: DataFrame) -> DataFrame:
    """paths with the expanded ones as primary, at a tenth of their ratio."""
    hit = best.select("id").withColumn("hit", F.lit(True))
    out = paths.join(hit, "id", "left")
    return out.select("id", "sorthash", *KEY, "depth", F.when(F.col("hit"), F.col("ratio") * F.lit(RETAINED)).otherwise(F.col("ratio")).alias("ratio"), F.when(F.col("hit"), "primary").otherwise(F.col("type")).alias("type"))


def core_gate(seen: DataFrame, paths: DataFrame, min_ratio: float = 1e-10) -> DataFrame:
    """(agent, pubkey, status, counted): accounts first seen this round are visited if their best path here is large enough, else skipped for good."""
    top = paths.groupBy(*KEY).agg(F.max("ratio").alias("top"))
    joined = seen.select(*KEY).join(top, KEY, "left")
    return joined.select(*KEY, F.when(F.col("top") >= min_ratio, "visited").otherwise("skipped").alias("status"), F.col("top").isNotNull().alias("counted"))


@dataclass
class Trust:
    paths: DataFrame
    accounts: DataFrame
    rounds: int


def trust_paths(root_path: DataFrame, root_account: DataFrame, edges: DataFrame, setting: str, bootstrap: tuple[str, ...] = (), max_depth: int = 10, min_ratio: float = 1e-10, simple_paths: bool = False) -> Trust:
    """All paths and accounts of a cycle. simple_paths: without paths that come to an account twice.

    edges holds every edge there may be; those of an account only matter once it is expanded. Accounts are seen over any
    edge, followed or not, of an account visited in the round before. State between rounds is kept in small checkpointed
    tables: the paths of the round, the accounts seen so far, and the frontier.
    """
    fanout = materialized(edge_fanout(followed_edges(edges, bootstrap)), "trust-fanout")
    reach = materialized(edges.select(*EDGE[:4]).distinct(), "trust-reach")
    setting_paths, done = [root_path], []
    known, frontier, level = checkpointed(root_account.select(*KEY)), root_account.select(*KEY), root_path
    gates, rounds = [], 0
    for depth in range(1, max_depth + 1):
        best = best_paths(level, frontier, depth - 1)  # of small tables that are written: cheaper to take again than to write
        done.append(best)
        level = checkpointed(expand_paths(best, fanout, setting, depth, simple_paths))
        setting_paths.append(level)
        targets = reach.join(frontier.select(F.col("agent").alias("from_agent"), F.col("pubkey").alias("from_pubkey")), EDGE[:2], "left_semi")
        seen = targets.select(F.col("to_agent").alias("agent"), F.col("to_pubkey").alias("pubkey")).distinct().join(known, KEY, "left_anti")
        gate = checkpointed(core_gate(seen, level, min_ratio).withColumn("depth", F.lit(depth)))
        gates.append(gate)
        rounds = depth
        if not gate.agg(F.bool_or("counted")).first()[0]:
            break
        known, frontier = known.unionByName(gate.select(*KEY)), gate.where("status = 'visited'").select(*KEY)
    union = lambda frames: [f := frames[0], [f := f.unionByName(x) for x in frames[1:]]] and f
    primary = checkpointed(union(done))
    paths = retain_parent(union(setting_paths), primary)
    expanded = primary.select(*KEY).withColumn("hit", F.lit(True))
    states = union([root_account.select(*KEY, "status", "depth"), *[g.select(*KEY, "status", "depth") for g in gates]])
    accounts = states.join(expanded, KEY, "left").select(*KEY, F.when(F.col("hit"), "expanded").otherwise(F.col("status")).alias("status"), "depth")
    return Trust(paths, accounts, rounds)


MANY = 4096  # paths of an account from which on several tasks count


def independent_path_count(paths: DataFrame, many: int = MANY) -> DataFrame:
    """(agent, pubkey, ratio, path_count) of each account: the sum over its paths, and the number of independent ones.

    Paths are taken by depth, then ratio, then sorthash. One is independent if none of its intermediate accounts was met
    before, in an earlier path or its own; intermediates are remembered up to the first that was. The paths of an account
    with up to ``many`` are gone through in order in one task; those of larger ones are decided in rounds over all tasks.
    """
    sums = checkpointed(paths.groupBy(*KEY).agg(exact_sum(F.col("ratio")).alias("ratio"), F.count("*").alias("n")))
    large = sums.where(F.col("n") > many)
    counted = _counted_in_order(paths.join(large.select(*KEY), KEY, "left_anti"))
    if not large.isEmpty():
        lost = paths_not_independent(paths.join(large.select(*KEY), KEY, "left_semi")).groupBy(*KEY).agg(F.count("*").alias("lost"))
        counted = counted.unionByName(large.join(lost, KEY, "left").select(*KEY, (F.col("n") - F.coalesce("lost", F.lit(0))).cast("int").alias("path_count")))
    return sums.join(counted, KEY).select(*KEY, "ratio", "path_count")


def _counted_in_order(paths: DataFrame) -> DataFrame:
    """(agent, pubkey, path_count), an account in one task: its paths are streamed in order, and the accounts met are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        account, met, n = None, set(), 0
        for b in batches:
            done = []
            for *key, path in zip(*(b.column(c).to_pylist() for c in (*KEY, "id")), strict=True):
                if key != account:
                    if account:
                        done.append((*account, n))
                    account, met, n = key, set(), 0
                for step in path.split(" ")[1:-1]:
                    if step in met:
                        break
                    met.add(step)
                else:
                    n += 1
            yield batch(done)
        yield batch([(*account, n)] if account else [])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"agent": pa.string(), "pubkey": pa.string(), "path_count": pa.int32()}
        return pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], names=list(kinds))

    ordered = paths.select(*KEY, "depth", (-F.col("ratio")).alias("minus"), "sorthash", "id").repartition(*KEY).sortWithinPartitions(*KEY, "depth", "minus", "sorthash")
    return ordered.select(*KEY, "id").mapInArrow(run, "agent string, pubkey string, path_count int")


def paths_not_independent(paths: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(agent, pubkey, sorthash) of the paths that are not independent, decided in rounds.

    A path claims its intermediates one after the other, up to the first that an earlier path (or itself) has claimed. In
    a round each intermediate goes to the earliest path that may still claim it, if that one has all before it; then every
    other path at that intermediate fails there, and what it had after it is free. The earliest undecided path is always
    decided, and as a rule all but a few are after some rounds. Only (account, intermediate) and single paths are keys.
    """
    path = [*KEY, "sorthash"]
    mid = path_intermediates(F.col("id"))
    own = F.array_min(F.filter(F.transform(mid, lambda x, i: F.when(F.array_position(mid, x) <= i, i)), lambda i: i.isNotNull()))
    plain = paths.select(*KEY, F.struct("depth", (-F.col("ratio")).alias("minus"), "sorthash").alias("rank"), "sorthash", F.coalesce(own, F.size(mid)).alias("upto"), own.isNotNull().alias("repeats"), mid.alias("mid"))
    plain = checkpointed(plain)
    failed = [plain.where("repeats").select(*path)]
    rows = checkpointed(plain.select(*KEY, "rank", "sorthash", F.posexplode(F.slice("mid", F.lit(1), F.col("upto"))).alias("pos", "node")))
    before = W.partitionBy(*path).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    for _ in range(max_rounds):
        first = rows.groupBy(*KEY, "node").agg(F.min("rank").alias("first"))
        marked = checkpointed(rows.join(first, [*KEY, "node"]).withColumn("claims", F.min(F.col("rank") == F.col("first")).over(before)).drop("first"))
        taken = marked.where("claims").select(*KEY, "node").withColumn("taken", F.lit(True))
        rest = marked.where("NOT claims").join(taken, [*KEY, "node"], "left")
        decided = checkpointed(rest.withColumn("fails", F.max(F.coalesce("taken", F.lit(False))).over(before)).select(*KEY, "rank", "sorthash", "pos", "node", "fails"))
        failed.append(decided.where("fails").select(*path))
        rows = decided.where("NOT fails").drop("fails")
        if rows.isEmpty():
            break
    else:
        raise RuntimeError(f"paths not decided after {max_rounds} rounds")
    out = failed[0]
    for f in failed[1:]:
        out = out.unionByName(f)
    return out.distinct()


def account_scores(trust: Trust) -> DataFrame:
    """(agent, pubkey, status, depth, ratio, path_count, quota): expanded accounts are processed; the others have no score."""
    mine = trust.paths.join(trust.accounts.where("status = 'expanded'").select(*KEY), KEY, "left_semi")
    joined = trust.accounts.join(independent_path_count(mine), KEY, "left")
    return joined.select(*KEY, F.when(F.col("status") == "expanded", "processed").otherwise(F.col("status")).alias("status"), "depth", "ratio", "path_count", F.when(F.col("ratio").isNotNull(), quota_from_ratio(F.col("ratio"))).alias("quota"))


def aggregate_agents(accounts: DataFrame) -> DataFrame:
    """Agents of the processed accounts (with name): their sums, and the name of the most trusted named key, ties by name."""
    best = F.min(F.when(F.col("name").isNotNull(), F.struct((-F.col("ratio")).alias("minus"), "name")))
    rows = accounts.where("status = 'processed'").groupBy("agent").agg(F.count("*").cast("int").alias("account_count"), F.sum("path_count").alias("paths"), exact_sum(F.col("ratio")).alias("total_ratio"), best.alias("best"))
    return rows.select("agent", "account_count", (F.col("paths") / F.col("account_count")).alias("avg_path_count"), "total_ratio", F.col("best.name").alias("name"))


def assign_pubkeys(accounts: DataFrame) -> DataFrame:
    """Keys with a processed account: approved if they have one account row, whatever its state, else all their rows contested."""
    keys = accounts.groupBy("pubkey").agg(F.count("*").alias("n"), F.max(F.col("status") == "processed").alias("hit"))
    status = F.when(~F.col("hit"), F.col("status")).when(F.col("n") == 1, "approved").otherwise("contested")
    return accounts.join(keys, "pubkey").withColumn("status", status).select(*accounts.columns)


def determine_updates(accounts: DataFrame, live: DataFrame) -> DataFrame:
    """Approved accounts are loaded if the live table has them loaded, else to be loaded (also those that were capped)."""
    have = live.where("status = 'loaded'").select(*KEY).distinct().withColumn("live", F.lit(True))
    status = F.when(F.col("status") != "approved", F.col("status")).when(F.col("live"), "loaded").otherwise("toLoad")
    return accounts.join(have, KEY, "left").withColumn("status", status).drop("live")
