from __future__ import annotations

import hashlib
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attest import schemas
from attest.operators import lists as L
from attest.operators import sync as G

MEMBERS = "pubkey string, type string, np string, counter long"


def brute(members):
    out, lists = {}, {}
    for k, t, np, c in sorted(members, key=lambda m: (m[3], m[2])):
        pos, x = lists.get((k, t), (0, 0))
        x ^= int(hashlib.sha256(np.encode()).hexdigest(), 16)
        out[k, t, np] = (pos, f"{x:064x}")
        lists[k, t] = pos + 1, x
    return out


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_positions_and_checksums(spark, chunk):
    rng = random.Random(1)
    members = [(rng.choice("ab"), rng.choice("$t"), f"n{i}", i) for i in range(120)]
    got = L.list_entries(spark.createDataFrame(members, MEMBERS), chunk=chunk).collect()
    assert {(r.pubkey, r.type, r.np): (r.position, r.checksum) for r in got} == brute(members)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.permutations(list(range(12))), st.integers(1, 11))
def test_order_does_not_matter_and_appending_is_building(spark, order, cut):
    members = [("k", "$", f"n{i}", c) for c, i in enumerate(order)]
    df = spark.createDataFrame(members, MEMBERS)
    whole = L.list_entries(df)
    first = L.list_entries(df.where(F.col("counter") < cut))
    added = L.append_to_lists(L.list_heads(first), first, df)
    assert sorted(map(tuple, first.union(added).collect())) == sorted(map(tuple, whole.collect()))
    plain = spark.createDataFrame([("k", "$", f"n{i}", i) for i in range(12)], MEMBERS)
    assert L.list_heads(whole).first().checksum == L.list_heads(L.list_entries(plain)).first().checksum


@pytest.mark.parametrize(("n", "positions"), [(25, [24, 14]), (150, [149, 139, 49]), (1, [0]), (0, [])])
def test_checkpoints(spark, n, positions):
    e = L.list_entries(spark.createDataFrame([("k", "$", f"n{i}", i) for i in range(n)], MEMBERS))
    assert sorted((r.position for r in G.list_checkpoints(e).collect()), reverse=True) == positions


def test_delta(spark):
    df = spark.createDataFrame([("k", "$", f"n{i}", i) for i in range(50)], MEMBERS)
    old = L.list_entries(df.where("counter < 30"))
    got = G.list_delta(L.list_entries(df), G.list_checkpoints(old)).collect()
    assert sorted(r.position for r in got) == list(range(30, 50))
    other = L.list_entries(spark.createDataFrame([("k", "$", "else", 0)], MEMBERS))
    assert G.list_delta(L.list_entries(df), G.list_checkpoints(other)).count() == 50


def test_superseder_joins_the_lists_of_what_it_supersedes(spark):
    pubs = spark.createDataFrame([("old", 0, "k", ["t"]), ("new", 1, "k", ["u"]), ("foreign", 2, "j", [])], "np_id string, counter long, pubkey string, types array<string>")
    inv = spark.createDataFrame([("new", "k", "old"), ("foreign", "j", "old")], schemas.INVALIDATIONS)
    members = L.list_memberships(pubs)
    more = L.inherit_invalidations(members, inv, pubs)
    assert [tuple(r) for r in more.collect()] == [("k", "t", "new", 1)]
    entries = L.mark_invalidated(L.list_entries(members.unionByName(more)), inv)
    got = {(r.pubkey, r.type, r.np): (r.position, r.invalidated) for r in entries.collect()}
    assert got["k", "t", "old"] == (0, True) and got["k", "t", "new"] == (1, False) and got["j", "$", "foreign"] == (0, False)


def test_routing(spark):
    pubs = spark.createDataFrame([("p", "a", ["x"]), ("q", "b", ["x"]), ("r", "c", ["x"]), ("s", "b", ["i"])], "np_id string, pubkey string, types array<string>")
    lists = spark.createDataFrame([("a", "$", "loaded"), ("b", "i", "loaded"), ("c", "$", "encountered")], "pubkey string, type string, status string")
    key = lambda df: sorted((r.np_id, r.type or "") for r in df.collect())
    assert key(L.route_publications(pubs, lists, ("i", "e"))) == [("p", "$"), ("p", "x"), ("q", "e"), ("q", "i"), ("r", ""), ("s", "e"), ("s", "i")]
    assert key(L.route_publications(pubs, lists, ("i", "e"), check_type=True)) == [("p", "$"), ("p", "x"), ("q", ""), ("r", ""), ("s", "i")]


def test_peers(spark):
    peers = spark.createDataFrame([("new", 200, False, "ready", 1, 5), ("reset", 200, False, "ready", 2, 5), ("same", 204, None, "updating", 1, 5), ("more", 200, False, "ready", 1, 9), ("test", 200, True, "ready", 1, 5), ("down", 500, False, "ready", 1, 5), ("early", 200, False, "loading", 1, 5), ("bare", 200, False, "ready", None, 5)], schemas.PEER_STATUS)
    state = spark.createDataFrame([("reset", 1, 4, None), ("same", 1, 5, None), ("more", 1, 7, None)], schemas.PEER_STATE)
    plan = {r.url: (r.action, r.after) for r in G.peer_sync_plan(G.eligible_peers(peers), state).collect()}
    assert plan == {"new": ("discover", 0), "reset": ("reset", 0), "same": ("skip", 5), "more": ("incremental", 7)}


def test_budget_is_checked_before_each_list(spark):
    lists = spark.createDataFrame([(k, t, s) for k, t, s in [("b", "i", "encountered"), ("f", "i", "encountered"), ("f", "$", "loaded"), ("a", "$", "encountered"), ("c", "i", "loaded"), ("d", "$", "encountered"), ("e", "$", "encountered")]], "pubkey string, type string, status string")
    sizes = spark.createDataFrame([("b", "i", 20), ("b", "x", 30), ("f", "x", 10), ("a", "$", 30), ("b", "$", 5), ("d", "$", 500), ("e", "$", 1)], "pubkey string, type string, n long")
    stored = spark.createDataFrame([("a", 4), ("z", 9)], "pubkey string, n long")
    got = G.optional_load_batch(lists, sizes, "i", "x", budget=100, stored=stored).collect()
    # b and f with their endorsement lists; then a, b (core-loaded just now, so its list of all types is new), d; f's is loaded
    assert sorted((r.phase, r.pubkey, r.n, r.spent) for r in got) == [(0, "b", 50, 0), (0, "f", 10, 50), (1, "a", 34, 60), (1, "b", 5, 94), (1, "d", 500, 99)]
    none = G.optional_load_batch(lists, sizes, "i", "x", budget=50).collect()
    assert [(r.phase, r.pubkey) for r in none] == [(0, "b")]


@pytest.mark.parametrize("chunk", [3, 40, 1 << 20])
def test_heads_and_entries_behind_where_some_lists_are_cut(spark, chunk):
    rng = random.Random(2)
    members = [("a" if rng.random() < 0.8 else rng.choice("bcdef"), rng.choice("$t"), f"n{i}", i) for i in range(160)]
    df = spark.createDataFrame(members, MEMBERS)
    old = L.list_entries(df.where("counter < 70"), chunk=chunk)
    got = L.list_entries(df.where("counter >= 70"), L.list_heads(old), chunk, after=True).collect()
    want = brute(members)
    sizes = {}
    for k, t, *_ in members:
        sizes[k, t] = sizes.get((k, t), 0) + 1
    assert {(r.pubkey, r.type, r.np): (r.position, r.checksum) for r in got} == {k: want[k] for k in want if int(k[2][1:]) >= 70}
    assert all(r.after == sizes[r.pubkey, r.type] - 1 - r.position for r in got)


def shuffles(df):
    """The exchanges that ran, those used again not counted."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return sum("Exchange hashpartitioning" in line and "ReusedExchange" not in line for line in plan.splitlines())


def test_members_are_shuffled_once_to_be_told_apart_and_once_into_their_lists(spark):
    pubs = spark.range(300).select(F.concat(F.lit("n"), "id").alias("np_id"), F.col("id").alias("counter"), F.concat(F.lit("k"), F.col("id") % 7).alias("pubkey"), F.array(F.lit("t")).alias("types"))
    members = L.list_memberships(pubs)
    checkpoints = G.list_checkpoints(L.list_entries(members, after=True))
    assert shuffles(checkpoints) <= 5  # two of members, two of counts and sums of what is cut, which are next to nothing
    assert sorted(map(tuple, checkpoints.collect())) == sorted(map(tuple, G.list_checkpoints(L.list_entries(members)).collect()))


def test_lists_are_equal_by_heads_of_members(spark):
    a = spark.createDataFrame([("k", "$", f"n{i}", i) for i in range(5)] + [("j", "$", "n1", 1)], MEMBERS)
    b = spark.createDataFrame([("k", "$", f"n{i}", 9 - i) for i in range(5)] + [("j", "$", "n2", 1), ("i", "$", "n", 1)], MEMBERS)
    got = G.heads_equal(L.heads_of_members(a), L.heads_of_members(b))
    assert {r.pubkey: r.equal for r in got.collect()} == {"k": True, "j": False, "i": False}
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, G.lists_equal(L.list_entries(a), L.list_entries(b)).collect()))
