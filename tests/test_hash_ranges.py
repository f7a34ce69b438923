from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from attest.operators import hash_ranges as H
from attest.operators.sync import list_diff
from attest.sources import layout

KEY = ["pubkey", "type", "np", "missing_in"]


def members(spark, n, hot=0.6):
    i = F.col("id")
    key = F.when(F.rand(1) < hot, "hot").otherwise(F.concat(F.lit("k"), i % 40))
    return spark.range(n).select(key.alias("pubkey"), F.when(i % 5 == 0, "t").otherwise("$").alias("type"), F.concat(F.lit("n"), i).alias("np"), i.alias("counter"))


@pytest.fixture
def read(monkeypatch):
    """The rows of the files that are opened."""
    seen = {"nodes": 0, "entries": 0}

    def files_of(spark, path, ranges, old=layout.files_of):
        files = old(spark, path, ranges)
        sizes = {z[0]: z[3] for z in layout.zones(spark, path)}
        seen[path.rsplit("/", 1)[1]] += sum(sizes[f] for f in files)
        return files

    monkeypatch.setattr(layout, "files_of", files_of)
    return seen


def written(spark, tmp_path, a, b):
    paths = [str(tmp_path / x) for x in "ab"]
    for rows, path in zip((a, b), paths, strict=True):
        H.write_hash_tree(rows, path, leaf=16, rows_per_file=500)
    return paths


@pytest.mark.parametrize(("lost_a", "lost_b"), [("id < 0", "id < 0"), ("id % 997 = 1", "id % 499 = 2"), ("id % 3 = 0", "id % 2 = 0"), ("id >= 0", "id < 0"), ("id % 40 = 7", "id < 0")])
def test_equals_the_linear_difference(spark, tmp_path, lost_a, lost_b):
    rows = members(spark, 3000).withColumn("id", F.col("counter"))
    a, b = rows.where(f"NOT ({lost_a})"), rows.where(f"NOT ({lost_b})")
    found = H.list_diff_by_ranges(spark, *written(spark, tmp_path, a, b))
    assert sorted(map(tuple, found.select(*KEY).collect())) == sorted(map(tuple, list_diff(a, b).select(*KEY).collect()))


def test_what_is_read_follows_the_differences_and_not_the_lists(spark, tmp_path, read):
    cost = {}
    for n in (6_000, 24_000):
        rows = members(spark, n)
        a, b = rows.where("counter <> 17"), rows.where("counter <> 4711")
        paths = written(spark, tmp_path / str(n), a, b)
        read.update(nodes=0, entries=0)
        assert H.list_diff_by_ranges(spark, *paths).count() == 2
        cost[n] = read["entries"]
        assert read["entries"] <= 2 * 2 * 2 * 600  # both sides: two ranges, each at a file's edge at worst
        files = len(layout.zones(spark, f"{paths[0]}/entries"))
        assert files >= n / 700
    assert cost[24_000] <= 2 * cost[6_000]


def test_one_more_entry_makes_a_list_of_its_own(spark, tmp_path):
    a = members(spark, 200)
    b = a.unionByName(spark.createDataFrame([("new", "$", "x", 1)], a.schema))
    found = H.list_diff_by_ranges(spark, *written(spark, tmp_path, a, b)).collect()
    assert [tuple(r[c] for c in KEY) for r in found] == [("new", "$", "x", "a")]


def test_trees_of_other_leaves_cannot_be_compared(spark, tmp_path):
    for name, leaf in (("a", 4), ("b", 5)):
        H.write_hash_tree(members(spark, 50), str(tmp_path / name), leaf=leaf)
    with pytest.raises(ValueError, match="leaves"):
        H.list_diff_by_ranges(spark, str(tmp_path / "a"), str(tmp_path / "b"))


def test_files_of_ranges(spark, tmp_path):
    layout.write_sorted(spark.range(1000).select(F.format_string("%04d", "id").alias("k")), str(tmp_path), "k", 100)
    zones = layout.zones(spark, str(tmp_path))
    assert sum(z[3] for z in zones) == 1000 and len(zones) >= 8
    of = lambda *pairs: layout.files_of(spark, str(tmp_path), spark.createDataFrame(pairs, "low string, high string"))
    for low, high in [("0000", "0000"), ("0150", "0420"), ("0999", "2"), ("2", "3")]:
        assert sorted(of((low, high))) == sorted(z[0] for z in zones if z[1] <= high and z[2] >= low)
    assert len(of(("0005", "0005"), ("0995", "0995"))) == 2


def test_files_are_so_many_at_most(spark, tmp_path, monkeypatch):
    """Larger tables have larger files, so what the driver holds of them stays small; all rows are there and found by key."""
    monkeypatch.setattr(layout, "MOST_FILES", 5, raising=False)
    rows = spark.range(1000).select(F.format_string("%04d", "id").alias("k"), F.col("id").alias("v"))
    layout.write_sorted(rows, str(tmp_path / "a"), "k", 10)
    layout.write_sorted(rows.select("v"), str(tmp_path / "b"), "k", 10, F.format_string("%04d", "v"))
    for name in "ab":
        zones = layout.zones(spark, str(tmp_path / name))
        assert len(zones) == 5 and sum(z[3] for z in zones) == 1000 and all(z[2] < y[1] for z, y in zip(zones, zones[1:]))
        got = layout.read_ranges(spark, str(tmp_path / name), layout.one_range(spark, F.lit("0410"), F.lit("0412"))).where("k BETWEEN '0410' AND '0412'")
        assert sorted(r.v for r in got.collect()) == [410, 411, 412]
