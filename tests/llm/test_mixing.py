from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from attest.llm.mixing import mix_sources, readings, source_targets

SCHEMA = "doc_id long, text string, source string, size string, target int"


def brute_targets(sizes: dict, weights=(3, 1, 2), share=1.5, most=2.0) -> dict:
    """Reshare what is cut, again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        rest = [s for s in order if s not in full]
        if not rest:
            return {s: most * sizes[s] for s in order}
        unit = left / sum(weight[s] for s in rest)
        over = {s for s in rest if unit * weight[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else unit * weight[s] for s in order}
        full |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 100, "c": 3, "d": 40, None: 7}, {"x": 5}, {"a": 0, "b": 0}, {"é": 4, "z": 9, "Z": 2}])
def test_targets_are_those_of_repeated_resharing(spark, sizes):
    found = source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    assert {r.source: pytest.approx(r.target) for r in found.collect()} == brute_targets(sizes)


def test_mix_of_odd_rows(spark):
    rows = [(1, "a b c", "s", "x", 1), (2, None, "s", None, None), (3, "", None, "x", 1), (4, "w " * 5000, "t", "x", 1), (5, "q\tr\x0bs t", None, "x", 1), (None, "n n", "t", "x", 1), (1, "a b c", "s", "x", 1)]
    out = mix_sources(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    assert {r.doc_id: r.size for r in out if r.doc_id in (2, 3, 4, 5)} == {2: 0, 3: 0, 4: 5000, 5: 3}
    by = defaultdict(list)
    for r in out:
        by[r.source].append(r)
        assert 0 <= r.taken <= 2 * r.size
        assert (r.position is None) == (r.taken == 0)
        assert r.position is None or 0 <= r.position <= 1
        assert r.again is None or r.again >= r.position
    for rows_ in by.values():
        assert abs(sum(r.taken for r in rows_) - rows_[0].target) <= 0.5


def test_reruns_agree_and_come_sorted(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 17).cast("int")).alias("text"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"))
    first, second = (mix_sources(docs.repartition(n)).collect() for n in (3, 7))
    assert sorted(map(str, first)) == sorted(map(str, second))
    at = [r.position for r in first if r.position is not None]
    assert at == sorted(at)


def test_empty_table(spark):
    assert mix_sources(spark.createDataFrame([], SCHEMA)).collect() == []


def test_kept_columns_and_readings(spark):
    rows = [(i, " ".join(["w"] * (i % 7)), f"s{i % 3}", f"n{i}", i) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, note string, order_key int")
    plain, kept = mix_sources(df), mix_sources(df, keep=["text", "note", "order_key"])
    assert kept.columns == [*plain.columns, "text", "note", "order_key"]
    assert [tuple(r) for r in kept.drop("text", "note", "order_key").collect()] == [tuple(r) for r in plain.collect()]
    assert all((r.text, r.note, r.order_key) == (rows[r.doc_id][1], rows[r.doc_id][3], r.doc_id) for r in kept.collect())
    read = readings(kept).collect()
    assert [r["at"] for r in read] == sorted(r["at"] for r in read)
    words = defaultdict(int)
    for r in read:
        words[r.doc_id] += r.words
        assert 0 < r.words <= r.size and r.text == rows[r.doc_id][1]
    assert {r.doc_id: r.taken for r in plain.collect() if r.taken} == dict(words)
    assert any(r.reading == 1 for r in read)
    for wrong in ({"most": 3.0}, {"keep": ["taken"]}):
        with pytest.raises(ValueError):
            mix_sources(df, **wrong)
