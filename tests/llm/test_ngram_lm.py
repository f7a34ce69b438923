from __future__ import annotations

import random
from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from attest.llm import ngram_lm
from attest.llm.ngram_lm import START, Automaton, _joined, _word_keys, arcs, count_ngrams, count_words, mark_repeated, score_texts

DOCS = "doc_id long, text string, score string, n int"


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    words = [f"W{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = []
    for i in range(n):
        text, w = [], rng.choice(words)
        for _ in range(rng.randint(0, 40)):
            w = words[(int(w[1:]) * 7 + 1) % 60] if rng.random() < 0.5 else rng.choices(words, weights)[0]
            text.append(w if rng.random() < 0.9 else f"rare{rng.randint(0, 5000)}")
        docs.append((i, " ".join(text), "x", 1))
    return docs


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def brute(train, texts, head_share, share, order, discount):
    """Backoff by definition: recursion over contexts, no automaton."""
    runs = [tokens(t) for t in train]
    c = Counter(w for r in runs for w in r)
    n, v = sum(c.values()), len(c)
    frequent = {w for w, x in c.items() if x >= share * n and x >= head_share * n}
    grams = {}
    for k in range(2, order + 1):
        every = Counter(tuple(r[i : i + k]) for r in ([None, *r] for r in runs) for i in range(len(r) - k + 1))
        grams[k] = {g: x for g, x in every.items() if x >= share * n and all(w is None or w in frequent for w in g) and (k == 2 or (g[:-1] in grams[k - 1] and g[1:] in grams[k - 1]))}
    seen = lambda h: len(runs) if h == (None,) else c[h[0]] if len(h) == 1 else grams[len(h)][h]
    below, back = {}, {}
    for k in grams:
        for g in grams[k]:
            below.setdefault(g[:-1], []).append(g[-1])

    def p(w, h):
        if not h:
            return (c[w] + 1) / (n + v + 1)
        if h in below and w in below[h]:
            return (grams[len(h) + 1][*h, w] - discount) / seen(h)
        if h not in below:
            return p(w, h[1:])
        if h not in back:
            left = 1 - sum((grams[len(h) + 1][*h, x] - discount) / seen(h) for x in below[h])
            back[h] = left / (1 - sum(p(x, h[1:]) for x in below[h]))
        return back[h] * p(w, h[1:])

    out = []
    for text in texts:
        run, total = tokens(text), 0.0
        for i, w in enumerate(run):
            full = [None, *run[:i]]
            h = tuple(full[-(order - 1) :])
            # a state never reaches over a word that is not frequent
            cut = max((j + 1 for j, x in enumerate(h) if x is not None and x not in frequent), default=0)
            total += log10(p(w, h[cut:]))
        out.append((len(run), sum(c[w] > 0 for w in run), n, sum(log10((c[w] + 1) / (n + v + 1)) for w in run), total))
    return out


@pytest.mark.parametrize(("order", "share", "head"), [(3, 0.003, 0.0005), (2, 0.003, 0.0005), (3, 0.02, 0.03)])
def test_scores_are_those_of_the_definition(spark, order, share, head):
    docs = [*corpus(), (900, None, "x", 1), (901, "", "x", 1), (902, "never seen Words w1 w8 W57", "x", 1), (None, "w1 w8", "x", 1), (902, "never seen Words w1 w8 W57", "x", 1)]
    df = spark.createDataFrame(docs, DOCS)
    train = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(True)) & (F.coalesce("doc_id", F.lit(0)) < 900)
    got = score_texts(df, train, head_share=head, share=share, order=order).collect()
    want = brute([d[1] for d in docs if d[0] is None or (d[0] % 3 and d[0] < 900)], [d[1] for d in docs], head, share, order, 0.5)
    mine = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    theirs = sorted((d[0] is None, d[0] or 0, *w) for d, w in zip(docs, want, strict=True))
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        assert list(a) == pytest.approx(list(b), rel=1e-9)


def automaton(spark, texts, order=3, share=0.0):
    df = spark.createDataFrame([(t.encode(),) for t in texts], "text binary")
    counts = count_words(df)
    n, v = counts.agg(F.sum("c"), F.count("*")).first()
    rows = arcs(df, counts, n, v, 0.0, share, 2, order, 0.5).orderBy("key").toPandas()
    return Automaton(tuple(rows[c].to_numpy() for c in ("key", "known", "base", "logp", "back"))), n, v, [bytes(r.word) for r in counts.collect()]


def test_states_are_distributions(spark):
    """After any context the probabilities of all words, of the end and of an unknown word sum to one."""
    model, n, v, words = automaton(spark, [d[1] for d in corpus()], share=0.003)
    unknown = log10(1 / (n + v + 1))
    score = lambda *texts: model.walk(list(texts), 3, unknown)[3]
    logp_of_end = lambda text: score(text)[0] - before_end(model, text, unknown)
    for context in (b"", b"w8", b"w1 w8", b"w57 w40", b"never seen", b"never w8"):
        here = before_end(model, context, unknown)
        total = 10 ** logp_of_end(context) + sum(10 ** (before_end(model, context + b" " + w, unknown) - here) for w in [*filter(None, words), b"zzz"])
        assert total == pytest.approx(1, abs=1e-9)


def before_end(model, text, unknown):
    """The score of a text's words without its end: state by state, as the walk is defined."""
    context, total = ["^"], 0.0
    has = lambda *w: int(model.arc(np.array([key(*w)]).view(np.int64))[0])
    for w in text.decode().split():
        while context and has(*context, w) < 0:
            total += model.back[has(*context)]
            context = context[1:]
        total += model.logp[has(*context, w)] if has(*context, w) >= 0 else unknown
        last = [*context[-1:], w]
        context = last if len(last) == 2 and has(*last) >= 0 else [w] if has(w) >= 0 else []
    return total


def test_the_walk_follows_arcs_and_failure_arcs(spark):
    """By hand: a kept trigram is one arc; what was not kept falls to the last word's state, and then to the root."""
    model, n, v, _ = automaton(spark, ["a b c", "a b c", "b d", "b d", "x"])
    unknown = log10(1 / (n + v + 1))
    at = lambda *w: int(model.arc(np.array([key(*w)]).view(np.int64))[0])
    for text, steps, failures in [
        (b"a b c", [("^", "a"), ("^", "a", "b"), ("a", "b", "c"), ("b", "c", "")], 0),
        (b"a b d", [("^", "a"), ("^", "a", "b"), ["a", "b"], ("b", "d"), ("b", "d", "")], 1),
        (b"x zz", [["^"], ("x",), ["x"], None, ("",)], 2),
    ]:
        model.failed = 0
        want = sum(unknown if s is None else model.back[at(*s)] if isinstance(s, list) else model.logp[at(*s)] for s in steps)
        assert model.walk([text, b"", text], 3, unknown)[3][[0, 2]] == pytest.approx([want, want])
        model.failed = 0
        model.walk([text], 3, unknown)
        assert model.failed == failures


def key(*words):
    """The key of an n-gram; ^ is the start, the empty word the end."""
    k = [START if w == "^" else _word_keys([w.encode()])[0] for w in words]
    if len(k) == 1:
        return k[0]
    pairs = [_joined(np.array([a]), np.array([b]), 2)[0] for a, b in zip(k, k[1:])]
    return pairs[0] if len(k) == 2 else _joined(np.array([pairs[0]]), np.array([pairs[1]]), 3)[0]


def test_nothing_to_learn_from(spark):
    got = score_texts(spark.createDataFrame([(1, "a b", "x", 1), (2, None, "x", 1)], DOCS), F.lit(False)).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(3, 0, 0, 0.0, 0.0), (1, 0, 0, 0.0, 0.0)]
    assert score_texts(spark.createDataFrame([], DOCS), F.lit(True)).collect() == []
    with pytest.raises(ValueError):
        score_texts(spark.createDataFrame([], DOCS), F.lit(True), order=4)


@pytest.mark.parametrize("near", [1e-5, 1e-3, 1.0])
def test_what_travels_changes_no_score(spark, near):
    docs = corpus(120, 3)
    got = score_texts(spark.createDataFrame(docs, DOCS), F.col("doc_id") % 3 != 0, near=near).collect()
    train = [d[1] for d in docs if d[0] % 3]
    want = brute(train, [d[1] for d in docs], 0.0, 1.5 / sum(len(tokens(t)) for t in train), 3, 0.5)
    for r, w in zip(sorted(got, key=lambda r: r.doc_id), want, strict=True):
        assert [r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score] == pytest.approx(list(w), rel=1e-9)


def test_a_phrase_counts_in_a_corpus_of_any_size(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(f"w{rng.randint(0, 3000)}" for _ in range(1000)), "x", 1) for i in range(320)]
    docs += [(1000, "alpha beta gamma", "x", 1), (1001, "alpha beta gamma", "x", 1), (1002, "w1 alpha beta gamma w2", "x", 1)]
    got = {r.doc_id: r.score for r in score_texts(spark.createDataFrame(docs, DOCS), F.col("doc_id") != 1002).collect()}
    train = [d[1] for d in docs[:-1]]
    want = brute(train, ["w1 alpha beta gamma w2"], 0.0, 1.5 / (320 * 1001 + 8), 3, 0.5)
    assert got[1002] == pytest.approx(want[0][-1], rel=1e-9)


@pytest.mark.parametrize(("order", "most"), [(3, 2_000_000), (3, 500), (2, 500)])
def test_what_occurs_once_is_neither_counted_nor_asked_for(spark, monkeypatch, order, most):
    """Marks in one bucket and in several, over several blocks: all repeated n-grams are there with all their occurrences, few others."""
    monkeypatch.setattr(ngram_lm, "BLOCK", 3_000)
    docs = [*((d[0], d[1].encode(), d[0] % 3 != 0) for d in corpus()), (900, b"", True), (901, b"never seen W1", False), (None, b"", True)]
    texts = spark.createDataFrame(docs, "doc_id long, text binary, train boolean").select(F.spark_partition_id().alias("part"), "doc_id", "train", "text")
    runs = [[None, *tokens(t.decode())] for _, t, train in docs if train]
    n = sum(len(r) - 1 for r in runs)
    marked = mark_repeated(texts, order, n, most=most)
    assert sorted(map(tuple, marked.select(F.coalesce("doc_id", F.lit(-1)), "train", F.length("text")).collect())) == sorted((-1 if d is None else d, train, len(t)) for d, t, train in docs)
    got = Counter({(r.o, r.n): r.rows for r in count_ngrams(marked.where("train").select("text", "hits"), order).groupBy("o", "n").agg(F.count("*").alias("rows")).collect()})
    for k in range(2, order + 1):
        want = Counter(Counter(tuple(r[i : i + k]) for r in runs for i in range(len(r) - k + 1)).values())
        assert {c: x for (o, c), x in got.items() if o == k and c > 1} == {c: x for c, x in want.items() if c > 1}
        assert want[1] > 500 and got[k, 1] < 0.05 * want[1]


def test_arcs_come_back_as_they_are_in_the_table(spark):
    rng = np.random.default_rng(3)
    keys = np.unique(np.append(rng.integers(-(1 << 63), (1 << 63) - 1, 500), [-(1 << 63), -1, 0, 1, (1 << 63) - 1]))
    rows = [(int(k), int(k) % 5, float(k), -float(i), float(i % 3)) for i, k in enumerate(keys)]
    table = spark.createDataFrame(rows, ngram_lm.ARC)
    wanted = np.sort(np.append(keys[::2], [5, -7, 12345]).view(np.uint64))
    for depth in (0, 3):
        asked = [(b, block, ngram_lm._packed(wanted[x:y], 8)) for block in (4, 9) for b, x, y in ngram_lm._edges(wanted, depth, 64 - depth)]
        got = ngram_lm.fetch_arcs(spark.createDataFrame(asked, "bucket int, block long, keys binary"), table, depth).collect()
        for block in (4, 9):
            found = [x for r in got if r.block == block for x in zip(*(c.tolist() for c in ngram_lm._arrays(r.arcs)), strict=True)]
            assert sorted(found) == sorted(rows[::2])


def test_what_is_exchanged_stays_small(spark):
    """Shuffled bytes a token over texts of 160 000 tokens, whose n-grams mostly occur once (3.9; 6.7 before, when counted n-grams were rows)."""
    rng = random.Random(9)
    docs = [(i, " ".join(f"w{int(rng.paretovariate(0.8))}" for _ in range(399)), "x", 1) for i in range(400)]
    df = spark.createDataFrame(docs, DOCS).repartition(4).persist()
    df.count()
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    assert score_texts(df, F.col("doc_id") % 7 != 2).agg(F.sum("n_tokens")).first()[0] == 160_000
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    df.unpersist()
    assert (written() - before) / 160_000 < 5


@pytest.mark.parametrize(("order", "share", "head"), [(3, 0.0, 0.0), (2, 0.0, 0.0), (3, 0.003, 0.02)])
def test_blocks_and_buckets_change_no_score(spark, monkeypatch, order, share, head):
    """Counts in many buckets and two turns, over several blocks, of which one has no training text."""
    monkeypatch.setattr(ngram_lm, "BUCKET", 200)
    docs = [*corpus(150, 4), *((1000 + i, f"w1 w8 w57 held{i}", "x", 1) for i in range(50))]
    train = [d[1] for d in docs if d[0] < 1000 and d[0] % 3]
    df = spark.createDataFrame(spark.sparkContext.parallelize(docs, 4), DOCS)
    got = score_texts(df, (F.col("doc_id") < 1000) & (F.col("doc_id") % 3 != 0), head_share=head, share=share, order=order).collect()
    least = max(share, 1.5 / sum(len(tokens(t)) for t in train))
    want = brute(train, [d[1] for d in docs], head, least, order, 0.5)
    assert len(got) == len(docs)
    for r, w in zip(sorted(got, key=lambda r: r.doc_id), want, strict=True):
        assert [r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score] == pytest.approx(list(w), rel=1e-9)
