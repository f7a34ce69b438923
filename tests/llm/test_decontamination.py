from __future__ import annotations

import random

import numpy as np

from attest.llm.decontamination import common_subsequence, drop_leaks, find_leaks, passages_of, randomised_svd

DOCS, ITEMS = "doc_id long, text string, item_id string, cosine int", "item_id long, text string, answer string"


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            row[j + 1], last = (last + 1 if x == y else max(row[j + 1], row[j])), row[j + 1]
    return row[-1]


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randint(0, 90))] for _ in range(2))
        assert common_subsequence(a, b) == brute_lcs(a, b)


def test_randomised_svd_spans_the_rows(spark):
    rng = np.random.default_rng(2)
    dense = rng.standard_normal((40, 5)) @ rng.standard_normal((5, 60))
    rows = [(list(range(60)), r.tolist()) for r in dense]
    v = randomised_svd(spark, rows, 60, 8)
    assert v.shape == (60, 5)
    assert np.allclose(dense @ v @ v.T, dense, atol=1e-6)


def corpus(seed=3):
    rng = random.Random(seed)
    common, rare = [f"c{i}" for i in range(40)], [f"r{i}" for i in range(3000)]
    say = lambda n: [rng.choice(common) if rng.random() < 0.5 else rng.choice(rare) for _ in range(n)]
    items = [(i, " ".join(say(rng.randint(15, 59))), None) for i in range(60)]
    docs, planted = [], set()
    for d in range(400):
        text = say(rng.randint(5, 500))
        if d % 4 == 0:
            item = rng.choice(items)
            leak = item[1].split()
            if d % 8 == 0:  # a paraphrase: a word in ten changed, case and punctuation as well
                leak = [w.upper() + "," if rng.random() < 0.3 else w for w in leak]
                leak[rng.randrange(len(leak))] = "other"
            at = rng.randint(0, len(text))
            text[at:at] = leak
            planted.add((d, item[0]))
        docs.append((d, " ".join(text), "x", 1))
    return docs, items, planted


def test_planted_items_are_found_and_nothing_else(spark):
    docs, items, planted = corpus()
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert {(r.doc_id, r.item_id) for r in find_leaks(df, bench).collect()} == planted
    kept = drop_leaks(df, bench)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({d[0] for d in docs} - {d for d, _ in planted})


def test_blocks_of_the_benchmark_change_nothing(spark):
    docs, items, planted = corpus(5)
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert {(r.doc_id, r.item_id) for r in find_leaks(df, bench, block=25).collect()} == planted
    assert {(r.doc_id, r.item_id) for r in find_leaks(df, bench, block=25, together=2).collect()} == planted


def test_long_texts_and_items(spark):
    docs, items, _ = corpus(6)
    item = " ".join(w for i in range(10) for w in items[i][1].split())
    long = " ".join(["filler words everywhere"] * 40_000 + [item] + ["filler words everywhere"] * 10)
    found = find_leaks(spark.createDataFrame([*docs[:50], (999, long, "x", 1)], DOCS), spark.createDataFrame([(7, item, None)], ITEMS)).collect()
    assert (999, 7) in {(r.doc_id, r.item_id) for r in found}
    assert all(len(p.words) <= 64 for p in passages_of(7, item, None))


def test_answers_decide_on_paraphrases(spark):
    _, items, _ = corpus(7)
    words = items[0][1].split()[:30]
    changed = [w if i % 3 else f"new{i}" for i, w in enumerate(words)]
    docs = [(1, " ".join(changed), "x", 1), (2, " ".join(changed) + " the answer is blue", "x", 1), *[(i, f"other text number {i}", "x", 1) for i in range(3, 60)]]
    found = find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(0, " ".join(words), "blue")], ITEMS), least_cosine=0.1).collect()
    assert [r.doc_id for r in found] == [2]


def test_odd_rows(spark):
    docs, items, _ = corpus(8)
    bench = spark.createDataFrame([*items[:5], (90, None, None), (91, "", None), (None, items[9][1], None), items[0]], ITEMS)
    odd = [(1, None, "x", 1), (2, "", "x", 1), (None, items[1][1], "x", 1), (3, items[0][1], "x", 1), (3, items[0][1], "x", 1)]
    found = find_leaks(spark.createDataFrame([*odd, *[(d[0] + 10, *d[1:]) for d in docs[1:4]]], DOCS), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(None, 1), (3, 0)} and len(found) == 2
    whole = spark.createDataFrame([(5, items[9][1], "x", 1)], DOCS)
    assert [(r.doc_id, r.item_id) for r in find_leaks(whole, bench).collect()] == [(5, None)] and drop_leaks(whole, bench).count() == 0
    assert find_leaks(spark.createDataFrame([], DOCS), bench).collect() == []
    assert find_leaks(spark.createDataFrame(docs[:3], DOCS), spark.createDataFrame([], ITEMS)).collect() == []
    assert drop_leaks(spark.createDataFrame(docs[:3], DOCS), spark.createDataFrame([], ITEMS)).count() == 3


def test_recall_on_paraphrases_of_a_diverse_benchmark(spark):
    """Against all windows of all texts by brute force; words are changed, left out and put in."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(6000)]
    say = lambda n: [rng.choice(words[:60] if rng.random() < 0.4 else words) for _ in range(n)]
    items = [(i, " ".join(say(rng.randint(20, 60))), None) for i in range(520)]
    docs, planted = [], []
    for d in range(260):
        leak = [w for w in items[2 * d][1].split() if rng.random() > 0.1]
        leak = [rng.choice(words) if rng.random() < rng.choice([0.0, 0.1, 0.2, 0.25]) else w for w in leak]
        text = say(rng.randint(60, 300))
        at = rng.randint(0, len(text))
        text[at:at] = leak
        docs.append((d, " ".join(text), "x", 1))
        planted.append((d, 2 * d, at, len(leak)))
    df = spark.createDataFrame(docs, DOCS)
    frequency = {}
    for _, t, _, _ in docs:
        for w in set(t.split()):
            frequency[w] = frequency.get(w, 0) + 1
    want = set()
    for d, i, at, n in planted:
        p, window = items[i][1].split(), docs[d][1].split()[max(0, at - 8) : at + n + 8]
        share, rarest = common_subsequence(p, window) / len(p), sorted(set(p), key=lambda w: (frequency.get(w, 0), w.encode()))[:4]
        if share >= 0.8 or share >= 0.6 and sum(w in window for w in rarest) >= 3:
            want.add((d, i))
    found = {(r.doc_id, r.item_id) for r in find_leaks(df, spark.createDataFrame(items, ITEMS)).collect()}
    assert len(want) > 150 and len(want & found) >= 0.97 * len(want)
    assert len(found - {(d, i) for d, i, _, _ in planted}) <= 2


def test_answers_of_another_type(spark):
    """An integer answer counts as its text."""
    words = [f"w{i}" for i in range(20)]
    item = spark.createDataFrame([(1, " ".join(words), 42)], "item_id long, text string, answer int")
    changed = [w if i % 4 else f"x{i}" for i, w in enumerate(words)]
    docs = [(1, " ".join(changed), "x", 1), (2, " ".join(changed) + " it is 42", "x", 1), *[(i, f"other text number {i}", "x", 1) for i in range(3, 40)]]
    assert {r.doc_id for r in find_leaks(spark.createDataFrame(docs, DOCS), item).collect()} == {2}
