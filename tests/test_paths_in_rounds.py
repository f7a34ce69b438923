from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from attest.functions.scalars import exact_sum
from attest.operators.lists import list_entries, list_memberships
from attest.plans import trust as T
from attest.sources import layout, list_store

PATHS = "agent string, pubkey string, id string, depth int, ratio double, sorthash string"


def in_sequence(rows):
    """account: (sum, independent paths), as the definition says."""
    out = {}
    for agent, key in {(r[0], r[1]) for r in rows}:
        met, n = set(), 0
        for r in sorted((r for r in rows if (r[0], r[1]) == (agent, key)), key=lambda r: (r[3], -r[4], r[5])):
            for step in r[2].split(" ")[1:-1]:
                if step in met:
                    break
                met.add(step)
            else:
                n += 1
        out[agent, key] = n
    return out


def random_paths(seed, accounts, each, nodes, skew):
    rng = random.Random(seed)
    rows = []
    for a in range(accounts):
        for i in range(rng.randint(1, each)):
            mid = [f"n{int(nodes * rng.random() ** skew)}|k" for _ in range(rng.randint(0, 6))]
            rows.append((f"a{a}", "k", " ".join(["$", *mid, f"a{a}|k"]), len(mid) + 1, rng.choice([0.5, 0.25, 0.1]), f"{rng.random():.12f}-{i}"))
    return rows


@pytest.mark.parametrize(("seed", "accounts", "each", "nodes", "skew"), [(1, 6, 60, 15, 1), (2, 3, 200, 400, 3), (3, 20, 8, 5, 2), (4, 1, 300, 40, 1)])
def test_rounds_equal_the_sequence(spark, seed, accounts, each, nodes, skew):
    rows = random_paths(seed, accounts, each, nodes, skew)
    df = spark.createDataFrame(rows, PATHS)
    want = in_sequence(rows)
    for many in (0, each // 2, 10_000):
        got = {(r.agent, r.pubkey): r.path_count for r in T.independent_path_count(df, many).collect()}
        assert got == want


def test_a_large_account_is_counted_by_many_tasks(spark):
    """10^5 paths of one account; every third begins with the same step."""
    i = F.col("id")
    mid = F.concat(F.when(i % 3 == 0, F.lit("hot|k")).otherwise(F.concat(F.lit("x"), i, F.lit("|k"))), F.lit(" y"), (i % 1000), F.lit("|k"))
    df = spark.range(100_000).select(F.lit("a").alias("agent"), F.lit("k").alias("pubkey"), F.concat(F.lit("$ "), mid, F.lit(" a|k")).alias("id"), F.lit(3).alias("depth"), (F.lit(1.0) / (i + 1)).alias("ratio"), F.md5(i.cast("string")).alias("sorthash"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lost = T.paths_not_independent(df)
        assert lost.select(F.spark_partition_id()).distinct().count() > 1
        assert T.independent_path_count(df).first().path_count == 1000 == 100_000 - lost.count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_exact_sum_has_no_order(spark):
    rng = random.Random(5)
    values = [rng.random() * 10 ** rng.randint(-12, 0) for _ in range(2000)]
    sums = {spark.createDataFrame([(v,) for v in x], "v double").repartition(n).agg(exact_sum(F.col("v"))).first()[0] for x in (values, values[::-1]) for n in (1, 7)}
    assert len(sums) == 1 and sums.pop() == pytest.approx(sum(values), rel=1e-14)
    for v in (1.0, 0.3, 1e-10, 3.7e-18):
        assert spark.createDataFrame([(v,)], "v double").agg(exact_sum(F.col("v"))).first()[0] == v


def lists(spark, n):
    i = F.col("id")
    pubs = spark.range(n).select(F.concat(F.lit("n"), i).alias("np_id"), (i + 1).alias("counter"), F.when(i % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), i % 30)).alias("pubkey"), F.array(F.concat(F.lit("t"), i % 2)).alias("types"))
    return list_entries(list_memberships(pubs))


def test_look_ups_open_few_files(spark, tmp_path, monkeypatch):
    entries = lists(spark, 4000)
    list_store.write_list_store(entries, str(tmp_path), rows_per_file=400)
    opened = []
    monkeypatch.setattr(layout, "files_of", lambda *a, old=layout.files_of: opened.append(old(*a)) or opened[-1])
    total = len(layout.zones(spark, str(tmp_path)))
    got = list_store.stored_list(spark, str(tmp_path), F.lit("hot"), after=1000, upto=1010).collect()
    want = entries.where("pubkey = 'hot' AND type = '$' AND position BETWEEN 1001 AND 1010").orderBy("position").collect()
    assert [tuple(r) for r in got] == [tuple(r[c] for c in list_store.ENTRY) for r in want] and len(got) == 10
    assert len(opened[-1]) <= 2 < total / 5
    assert [r.position for r in list_store.stored_list(spark, str(tmp_path), F.lit("k3"), "t1").collect()] == list(range(entries.where("pubkey = 'k3' AND type = 't1'").count()))
    assert len(opened[-1]) <= 2
    assert sorted(r.type for r in list_store.stored_lists_of(spark, str(tmp_path), F.lit("k3")).collect()) == ["$", "t1"]
    assert list_store.stored_list(spark, str(tmp_path), F.lit("nobody")).collect() == []


def test_two_registries_meet_without_exchange(spark, tmp_path):
    entries = lists(spark, 600)
    names = [list_store.write_buckets(e, str(tmp_path / x), 4) for e, x in ((entries, "a"), (entries.where("counter <= 500"), "b"))]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = list_store.same_entries(*(spark.table(n) for n in names))
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert met.count() == entries.where("counter <= 500").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for n in names:
            spark.sql(f"DROP TABLE {n}")
