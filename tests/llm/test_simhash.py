from __future__ import annotations

import os
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from attest.llm.components import components
from attest.llm import simhash
from attest.llm.simhash import BROAD_SEGMENTS, SEGMENTS, _keys, _verified, shingle_set, similar_links, drop_near_copies, drop_near_duplicates, fingerprint, links, near_copies, near_duplicates

SCHEMA = "doc_id long, text string, fp string, component_id int"


def brute_fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps):
    root = list(range(len(fps)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i in range(len(fps)):
        r = find(i)
        if ids[i] is not None:
            least[r] = min(least.get(r, ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(fps))]


def test_fingerprint():
    rng = random.Random(1)
    texts = [None, "", " \t\n", "one", "One TWO three", "a b c d", "É é ß ünï code words here", " ".join(rng.choice("abcdef") for _ in range(500))]
    assert [fingerprint((t or "").encode()) for t in texts] == [brute_fingerprint(t) for t in texts]


def test_hash_is_the_one_of_spark(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c d")).alias("h")).first().h == np.array([xxhash.xxh64_intdigest(b"a b c d", 42)], np.uint64).view(np.int64)[0]


@pytest.mark.parametrize("segments", [SEGMENTS, BROAD_SEGMENTS])
def test_keys_find_all_pairs_within_four_bits(spark, segments):
    rng = random.Random(2)
    pairs = []
    for _ in range(300):
        a, b = rng.getrandbits(64), 0
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 4)):
            b ^= 1 << bit
        pairs.append((a - (a >> 63 << 64), b - (b >> 63 << 64)))
    df = spark.createDataFrame(pairs, "a long, b long").select(F.arrays_overlap(_keys(F.col("a"), segments), _keys(F.col("b"), segments)).alias("met"))
    assert df.where("NOT met").count() == 0


@pytest.mark.parametrize("segments", [SEGMENTS, BROAD_SEGMENTS])
def test_links_connect_as_all_pairs_do(spark, segments):
    rng = random.Random(3)
    fps = {0}
    for _ in range(12):  # clusters, one of them dense
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([2, 5, 120])):
            x = centre
            for bit in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << bit
            fps.add(x)
    fps = sorted(fps | {rng.getrandbits(64) for _ in range(50)})
    df = spark.createDataFrame([(f - (f >> 63 << 64),) for f in fps], "fp long")
    found = links(df, segments=segments).collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 10 for r in found)  # of one bucket's component
    root = {r.node: r.root for r in components(links(df, segments=segments)).collect()}
    mine = [root.get(f - (f >> 63 << 64), f - (f >> 63 << 64)) for f in fps]
    theirs = brute_components(list(range(len(fps))), fps)
    assert len(set(zip(mine, theirs, strict=True))) == len(set(mine)) == len(set(theirs))


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.choice([3, 60, 300]))] for _ in range(25)]
    rows = []
    for i in range(90):
        text = list(rng.choice(base))
        if rng.random() < 0.6:
            text[rng.randrange(len(text))] = "changed"
        rows.append((i if i % 11 else None, " ".join(text)))
    rows += [(200, None), (201, ""), (202, "  "), (3, rows[3][1]), (203, "long " * 70_000)]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA)
    found = near_duplicates(df).collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    expected = brute_components([r[0] for r in rows], fps)
    key = lambda i, f, c: (i is None, i or 0, f, c is None, c or 0)
    assert sorted(key(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in found) == sorted(key(r[0], f, c) for r, f, c in zip(rows, fps, expected, strict=True))
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for c in expected if c is not None})


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(df).collect() == [] and drop_near_duplicates(df).collect() == []


def jaccard(a, b):
    x, y = (frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_near_copies_by_similarity(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(900)]
    rows, groups = [], {}
    for g in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(80, 400))]
        for _ in range(rng.choice([1, 2, 4])):
            text = list(base)
            for _ in range(rng.randint(0, max(0, len(text) // 100))):
                text[rng.randrange(len(text))] = "changed"
            rows.append((len(rows), " ".join(text)))
            groups[len(rows) - 1] = g
        half = base[: len(base) // 2] + [rng.choice(words) for _ in base[len(base) // 2 :]]
        rows.append((len(rows), " ".join(half)))  # shares a passage, but is no copy
        groups[len(rows) - 1] = -g - 1
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA)
    found = {r.doc_id: r.component_id for r in near_copies(df).collect()}
    text = dict(rows)
    close = [(a, b) for a in text for b in range(a) if groups[a] == groups[b] and jaccard(text[a], text[b]) >= 0.8]
    assert len(close) > 50 and sum(found[a] == found[b] for a, b in close) >= 0.95 * len(close)
    assert all(groups[found[d]] == groups[d] for d in found)
    kept = drop_near_copies(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(found.values()))


def test_near_copies_of_odd_rows(spark):
    rows = [(4, None), (3, ""), (None, "  "), (5, "one two"), (6, "ONE two"), (None, "only here"), (None, "only here"), (5, "one two"), (7, "w " * 100_000)]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA)
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in near_copies(df).collect())
    assert got == [(-1, -1), (-1, -1), (-1, 3), (3, 3), (4, 3), (5, 5), (5, 5), (6, 5), (7, 7)]
    assert sorted(r.doc_id or -1 for r in drop_near_copies(df).collect()) == [-1, 3, 5, 7]
    assert near_copies(df.where("false")).collect() == [] and drop_near_copies(df.where("false")).collect() == []


def dense_clusters(rng, clusters, size, least=100, most=250):
    """Texts around a common original whose similarities lie about the threshold."""
    words, rows = [f"w{i}" for i in range(3000)], []
    for _ in range(clusters):
        base = [rng.choice(words) for _ in range(rng.randint(least, most))]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randint(0, len(text) // 20)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows), " ".join(text)))
    return rows


def brute_groups(rows, least=0.8):
    """The component of each row by all pairs."""
    sets = [set(shingle_set(t.encode()).tolist()) for _, t in rows]
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    pairs = []
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and common >= least * (len(sets[i]) + len(sets[j]) - common):
                pairs.append((i, j))
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(rows))], pairs


@pytest.mark.parametrize("nodes", [1024, 30])
def test_dense_clusters_near_the_threshold(spark, monkeypatch, nodes):
    """Groups as all pairs make them, also where a candidate group is cut into blocks."""
    monkeypatch.setattr(simhash, "NODES", nodes)
    rows = dense_clusters(random.Random(6), 12, 80)
    want, pairs = brute_groups(rows)
    found = {r.doc_id: r.component_id for r in near_copies(spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA)).collect()}
    assert len(pairs) > 1000 and len({(found[i], want[i]) for i in range(len(rows))}) == len(set(want)) == len(set(found.values()))


def test_similar_links_connect_as_all_pairs_do():
    rng = random.Random(7)
    for sides in (1, 2):
        rows = dense_clusters(rng, 3, 30, 20, 60) + [(0, ""), (0, "one"), (0, "one")]
        sets, side = [shingle_set(t.encode()) for _, t in rows], np.array([rng.randrange(sides) for _ in rows])
        _, pairs = brute_groups(rows)
        across = [(i, j) for i, j in pairs if sides == 1 or side[i] != side[j]]
        got = similar_links(sets, side, 0.8)
        assert set(map(frozenset, got)) <= set(map(frozenset, across)) and len(got) < len(rows)
        label = lambda links: brute_label(len(rows), links)
        assert label(got) == label(across)


def brute_label(n, links):
    root = list(range(n))
    find = lambda i: i if root[i] == i else find(root[i])
    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return [find(i) for i in range(n)]


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c", 1, "k", "m"), (2, "a b c", 2, "k", "m")], "doc_id long, text string, node int, key_ string, md5_ string")
    for kept in (drop_near_copies(df), drop_near_duplicates(df)):
        assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(1, "a b c", 1, "k", "m")]


def test_one_row_for_texts_with_the_same_shingles_repeated(spark):
    """Equal sets of shingles, repeated in other numbers, are one node with one fingerprint."""
    five, other = "a b c d e ", "p q r s t "
    docs = [(1, five * 2), (2, five * 3), (3, five * 2 + other * 4), (4, five * 2 + other * 5), (5, five * 2)]
    got = sorted((r.doc_id, r.component_id) for r in near_copies(spark.createDataFrame([(i, t, "x", 7) for i, t in docs], SCHEMA)).collect())
    assert got == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 1)]


def test_components_of_links_that_differ_each_time_they_are_computed(spark):
    """A plan may give other links of the same component when it is evaluated again, as after a lost executor."""

    def star(batches):
        for _ in batches:
            centre = int.from_bytes(os.urandom(4)) % 1000
            rest = np.delete(np.arange(1000), centre)
            yield pa.record_batch([pa.array(np.full(999, centre)), pa.array(rest)], names=["a", "b"])

    found = components(spark.range(1, numPartitions=1).mapInArrow(star, "a long, b long")).collect()
    assert sorted((r.node, r.root) for r in found) == [(i, 0) for i in range(1000)]


def test_verified_links_do_not_depend_on_the_order_of_the_texts(spark):
    rows = [("g", f"n{i:02}", np.arange(i, i + 40).tolist()) for i in range(60)]
    found = []
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        sets = spark.createDataFrame(rows, "group string, node string, shingles array<long>").repartition(5)
        found.append(sorted((r.a, r.b) for r in _verified(sets, 0.8).collect()))
    assert found[0] and found[0] == found[1] == found[2]
