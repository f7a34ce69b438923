"""Golden values of the trust computation."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from attest import schemas
from attest.functions.scalars import path_text, quota_from_ratio
from attest.operators.admission import followed_edges
from attest.plans import snapshots as P
from attest.plans import trust as T


def edges(spark, rows):
    return spark.createDataFrame([(*r, "S", False) if len(r) == 4 else r for r in rows], schemas.TRUST_EDGES)


def cycle(spark, rows, **kw):
    path, account, _ = T.seed_trust(spark, spark.createDataFrame([("i",)], "endorsed_np string"), "S")
    return T.trust_paths(path, account, edges(spark, rows), "S", **kw)


def test_ratio_is_shared_by_agents_then_by_keys(spark):
    t = cycle(spark, [("$", "$", "B", "Q1"), ("$", "$", "B", "Q2"), ("$", "$", "C", "R")], max_depth=1)
    got = {r.id: (pytest.approx(r.ratio), r.type) for r in t.paths.collect()}
    assert got == {"$": (0.1, "primary"), "$ B|Q1": (0.225, "extended"), "$ B|Q2": (0.225, "extended"), "$ C|R": (0.45, "extended")}


def test_invalidated_edges_do_not_count(spark):
    t = cycle(spark, [("$", "$", "B", "Q"), ("$", "$", "C", "R", "X", True)], max_depth=1)
    assert {r.id: pytest.approx(r.ratio) for r in t.paths.collect()} == {"$": 0.1, "$ B|Q": 0.9}
    assert {r.pubkey: r.status for r in t.accounts.collect()} == {"$": "expanded", "Q": "visited", "R": "skipped"}
    assert followed_edges(edges(spark, [("$", "$", "C", "R", "X", True)]), ("X",)).count() == 1


def test_every_expansion_conserves_the_ratio(spark):
    rows = [("$", "$", "A", "1"), ("$", "$", "B", "2"), ("A", "1", "C", "3"), ("B", "2", "C", "3"), ("C", "3", "A", "1"), ("C", "3", "D", "4"), ("D", "4", "E", "5"), ("E", "5", "A", "1")]
    t = cycle(spark, rows)
    assert sum(r.ratio for r in t.paths.collect()) == pytest.approx(1.0)
    assert t.accounts.where("status = 'expanded'").count() >= 5
    # paths may come back to an account they have passed
    assert t.paths.where("id = '$ A|1 C|3 A|1' OR id = '$ B|2 C|3 A|1'").count() == 1


def scores(spark, paths, agent="A", pubkey="P"):
    p = spark.createDataFrame([(i, f"h{n}", agent, pubkey, len(i.split()) - 1, r, "extended") for n, (i, r) in enumerate(paths)], schemas.TRUST_PATHS)
    a = spark.createDataFrame([(agent, pubkey, "expanded", 1)], "agent string, pubkey string, status string, depth int")
    return T.account_scores(T.Trust(p, a, 1)).first()


@pytest.mark.parametrize(
    ("paths", "ratio", "count"),
    [
        ([("$ X|1 A|P", 0.25), ("$ Y|2 A|P", 0.5)], 0.75, 2),
        ([("$ X|1 A|P", 0.3), ("$ X|1 Y|2 A|P", 0.2)], 0.5, 1),
        ([("$ A|P", 0.1)], 0.1, 1),
        ([("$ X|1 Y|2 X|1 A|P", 0.1)], 0.1, 0),
        ([("$ X|1 A|P", 0.3), ("$ Y|2 X|1 Z|3 A|P", 0.1), ("$ W|9 Y|2 V|8 A|P", 0.05), ("$ U|4 Z|3 T|5 A|P", 0.01)], 0.46, 2),
    ],
)
def test_independent_paths(spark, paths, ratio, count):
    r = scores(spark, paths)
    assert (r.ratio, r.path_count, r.status) == (pytest.approx(ratio), count, "processed")


def test_many_paths_to_one_account(spark):
    """In linear time, and account by account whatever the order of rows."""
    n = 30_000
    i = F.col("id")
    paths = spark.range(n).select(F.concat(F.lit("$ X|"), i % (n // 2), F.lit(" A|P")).alias("id"), F.sha2(i.cast("string"), 256).alias("sorthash"), F.lit("A").alias("agent"), F.concat(F.lit("P"), i % 2).alias("pubkey"), F.lit(2).alias("depth"), F.lit(0.25).alias("ratio"), F.lit("extended").alias("type"))
    got = {r.pubkey: (r.ratio, r.path_count) for r in T.independent_path_count(paths.orderBy(F.rand(1))).collect()}
    assert got == {"P0": (n / 8, n // 4), "P1": (n / 8, n // 4)}
    assert T.independent_path_count(paths.where("false")).collect() == []


def test_quotas(spark):
    got = spark.createDataFrame([(2.0**-15,), (1e-9,), (0.5,)], "r double").select(quota_from_ratio(F.col("r")).alias("q")).collect()
    assert [r.q for r in got] == [30517, 1000, 100000]


def test_agents(spark):
    a = spark.createDataFrame([("A", "1", "processed", 0.5, 3, "Zoe"), ("A", "2", "processed", 0.5, 1, "Ann"), ("A", "3", "processed", 0.9, 2, None), ("B", "4", "skipped", 0.1, 1, "X")], "agent string, pubkey string, status string, ratio double, path_count int, name string")
    assert [tuple(r) for r in T.aggregate_agents(a).collect()] == [("A", 3, 2.0, pytest.approx(1.9), "Ann")]


def test_shared_keys_are_contested_and_updates(spark):
    a = spark.createDataFrame([("A", "1", "processed"), ("B", "1", "skipped"), ("C", "2", "processed"), ("D", "3", "processed"), ("E", "4", "seen")], "agent string, pubkey string, status string")
    done = T.assign_pubkeys(a)
    assert {r.agent: r.status for r in done.collect()} == {"A": "contested", "B": "contested", "C": "approved", "D": "approved", "E": "seen"}
    live = spark.createDataFrame([("C", "2", "loaded"), ("D", "3", "capped")], a.schema)
    assert {r.agent: r.status for r in T.determine_updates(done, live).collect()} == {"A": "contested", "B": "contested", "C": "loaded", "D": "toLoad", "E": "seen"}


def test_hash_leaves_out_accounts_to_load(spark):
    p = spark.createDataFrame([("$", "h", "$", "$", 0, 0.1, "primary"), ("$ A|1", "h", "A", "1", 1, 0.9, "extended")], schemas.TRUST_PATHS)
    to_load = spark.createDataFrame([("A", "1", "toLoad")], "agent string, pubkey string, status string")
    import hashlib

    assert P.trust_state_hash(p, to_load).first()[0] == hashlib.sha256(b"$ (primary)\n").hexdigest()
    assert P.trust_state_hash(p, to_load.where("false")).first()[0] == hashlib.sha256(b"$ (primary)\n$ A|1 (extended)\n").hexdigest()
    assert P.fingerprint(p, to_load).first()[0] != P.fingerprint(p, to_load.where("false")).first()[0]
    assert P.trust_state_hash(p.where("false"), to_load).first()[0] == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize(
    ("new", "previous", "stored", "waits", "want"),
    [
        ("x", None, None, True, ("hold", 3, None)),
        ("x", None, None, False, ("publish", 4, "x")),
        ("x", "x", "x", True, ("keep", 3, "x")),
        ("y", "x", "x", True, ("publish", 4, "y")),
        ("y", "x", "y", True, ("publish", 3, "y")),  # an interrupted run has stored it: the counter does not move again
        ("x", "x", None, True, ("hold", 3, None)),
    ],
)
def test_publishing(spark, new, previous, stored, waits, want):
    states = spark.createDataFrame([(new, previous, stored, 3)], "new_hash string, previous_hash string, stored_hash string, counter long")
    accounts = spark.createDataFrame([("A", "1", "toLoad" if waits else "loaded")], "agent string, pubkey string, status string")
    r = P.publish_decision(states, accounts).first()
    assert (r.action, r.next_counter, r.next_hash) == want
    assert P.publish_decision(states, accounts, full_load=False).first().action != "hold"
    assert P.publish_decision(states, accounts.where("false")).first().action != "hold"


def test_snapshots(spark):
    accounts = spark.createDataFrame([("A", "1", "loaded", 1, 0.5, 1, 1000, "Ann", None, "i1"), ("$", "$", "processed", 0, 0.1, 0, 1, None, None, None), ("B", "2", "toLoad", 1, 0.1, 1, 1000, None, None, "i2"), ("C", "3", "contested", 2, None, None, None, None, None, "i3")], schemas.ACCOUNTS)
    shown = P.snapshot_accounts(accounts)
    rows = edges(spark, [("A", "1", "C", "3"), ("A", "1", "B", "2"), ("C", "3", "A", "1", "RAx", False), ("C", "3", "A", "1", "RAy", True)])
    via = P.snapshot_edges(rows, shown, spark.createDataFrame([("S", "http://full/S")], "np_id string, full_id string"))
    assert {(r.from_agent, r.to_agent, r.via_np) for r in via.collect()} == {("A", "C", "http://full/S"), ("C", "A", "https://w3id.org/np/RAx")}
    header = lambda h, c: spark.createDataFrame([(h, c)], "hash string, counter long").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    one = P.build_snapshot(header("h1", 1), shown, via)
    doc = P.nested(one).first()
    assert [(a.pubkey, a.agent, a.name, a.quota) for a in doc.accounts] == [("1", "A", "Ann", 1000), ("3", "C", None, None)] and len(doc.edges) == 2
    again = P.store_snapshot(one, P.build_snapshot(header("h1", 2), shown.where("agent = 'A'"), via.where("false")))
    assert [(r.hash, r.counter, r.account.agent, r.edge) for r in again.collect()] == [("h1", 2, "A", None)]
    two = P.store_snapshot(again, P.build_snapshot(header("h2", 3), shown, via), keep=1)
    assert {r.hash for r in two.collect()} == {"h2"} and two.count() == 4
    assert {(r.from_agent, r.change) for r in P.diff_edges(via, via.where("from_agent = 'A'")).collect()} == {("C", "removed")}


def test_path_text(spark):
    got = spark.createDataFrame([("$ a|1 b|2", "extended"), ("$ a|1 b|2", "primary")], "id string, t string").select(path_text(F.col("id"), F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == ["$ > a|1 ~ b|2", "$ > a|1 > b|2"]
