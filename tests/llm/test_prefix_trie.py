from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attest.llm import prefix_trie
from attest.llm.prefix_trie import UNIT, Parentheses, shared_units
from attest.llm.queries import op13_prefix_trie

SCHEMA = "conv_id long, turn int, role string, text string, path string, shard int"


def brute(rows: list[tuple]) -> list[tuple]:
    """Node by node, as the definition says; turns of one number by their digest."""
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            by[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), (role, text)))
    original = {c: [t[3] for t in sorted(turns)] for c, turns in by.items()}
    whole = {}
    for c, own in original.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (c % 5 if c >= 0 else -(-c % 5))
        whole[c] = tuple(original.get(base, [])[:h] + own[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
        ends[whole[c]].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    saved, leaves = defaultdict(int), defaultdict(int)
    for node, cs in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(cs) - 1) * len(node[-1][1].encode()) if node else 0
            leaves[node[:d]] += not children[node]
    sha = lambda node: hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()
    return sorted(((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), children[node], leaves[node], saved[node], sha(node)) for node, cs in members.items()), key=str)


def found(spark, rows, tmp_path):
    at = str(tmp_path / "sf")
    spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3).write.parquet(f"{at}/conversations.parquet")
    out = op13_prefix_trie(spark, at)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, out.collect()), key=str)


def talk(c, *texts):
    return [(c, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(texts)]


def test_nulls_ties_repeats_and_odd_conversations(spark, tmp_path):
    rows = [*talk(0, "hi", "déjà", "x"), *talk(1, "hi", "y"), *talk(7, *["long" * 20_000] * 12), *talk(-3, "n"), *talk(-5, "m", "o"), (None, 1, "user", "lost"), (12, None, None, None), (12, 0, "user", ""), (12, 0, "user", "a"), (12, 0, "user", "a"), (15, 2, "user", None)]
    assert found(spark, rows, tmp_path) == brute(rows)


def test_none(spark, tmp_path):
    assert found(spark, [], tmp_path) == []


@pytest.mark.parametrize("shard", [1, 3, 256])
def test_spines_over_many_shards(spark, tmp_path, monkeypatch, shard):
    """A third of the conversations are one, half begin alike, and sequences are prefixes of others."""
    monkeypatch.setattr(prefix_trie, "SHARD", shard)
    rng = np.random.default_rng(1)
    rows = []
    for c in range(240):
        n = int(rng.integers(1, 14))
        rows += talk(c, *["same"] * 4) if c % 3 == 0 else talk(c, *[f"t{min(i, 3) if c % 2 else rng.integers(0, 3)}" for i in range(n)])
    assert found(spark, rows, tmp_path) == brute(rows)


def test_many_members_of_one_end(spark, tmp_path):
    rows = [r for c in range(0, 20_000, 2) for r in talk(c, "s")]
    assert found(spark, rows, tmp_path) == brute(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=0, max_size=700))
def test_closing_places(steps):
    bits, depth = [1], 1
    for s in steps:
        up = s or depth == 1
        bits.append(int(up))
        depth += 1 if up else -1
    bits += [0] * depth
    stack, want = [], {}
    for i, b in enumerate(bits):
        if b:
            stack.append(i)
        else:
            want[stack.pop()] = i
    tree = Parentheses(np.array(bits, np.uint8))
    assert dict(zip(tree.opens.tolist(), tree.closes().tolist())) == want


def test_shared_units():
    a = bytes(range(256))
    assert shared_units(a, a) == 16 and shared_units(a, a[: 3 * UNIT]) == 3 and shared_units(b"", a) == 0
    assert shared_units(a, a[:40] + b"\xff" + a[41:]) == 2
