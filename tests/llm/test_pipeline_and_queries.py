"""The registered queries over the smallest test tables, against brute force where no SQL says what they return."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from math import exp, log1p, log10
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from attest.llm.decontamination import common_subsequence, passages_of, words_of
from attest.llm.queries import QUERIES
from attest.llm.toxicity import folded, held_out, learn
from tests.compare import difference, duck
from tests.llm.test_ngram_lm import brute, tokens
from tests.llm.test_simhash import brute_components, brute_fingerprint, jaccard

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SF}/documents.parquet'").fetchall()


def test_each_operator_has_one_query_and_the_pipeline_is_there():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]


@pytest.mark.parametrize("name", ["op2_mixing", "op5_line_dedup", "op11_topk", "op12_merkle", "op13_prefix_trie"])
def test_sql(spark, name):
    assert difference(spark, duck(SF), QUERIES[name], entry.oracle_sql()[name], SF) == ""


def test_chat(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet' UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok' ORDER BY 1, 2").fetchall()
    want = {}
    for conv in {r[0] for r in rows}:
        turns = [(r[2], r[3] or "") for r in rows if r[0] == conv]
        loss = "".join(t for role, t in turns if role == "assistant")
        want[conv] = (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {r.conv_id: tuple(r)[1:5] for r in QUERIES["op3_chat"](spark, SF).collect()} == want


def test_lm_base(spark, docs):
    runs = {d: [w.encode() for w in t.encode().lower().decode().split()] + [b""] for d, t, _, _ in docs if not any(c in t for c in "\x1c\x1d\x1e\x1f\x85\xa0")}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in runs}
    c = Counter(w for d, r in runs.items() if not held[d] for w in r)
    n, v = sum(c.values()), len(c)
    for r in QUERIES["op4_lm_score"](spark, SF).collect():
        run = runs[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(run), sum(c[w] > 0 for w in run), n)
        assert r.base_score == pytest.approx(sum(log10((c[w] + 1) / (n + v + 1)) for w in run))


def test_media(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op6_mpeg_audio"](spark, SF).collect()}
    for d, t, _, _ in docs:
        raw = t.encode()
        pay = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (got[d].n_bytes, got[d].payload_sha256, got[d].tail_crc32) == (len(raw), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))


def test_leaks(spark, docs):
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    plain = lambda t: f" {' '.join(t.lower().translate(str.maketrans({c: ' ' for c in '.,;:!?*#%&$|'})).split())} "
    whole = {(d, i) for d, t, _, _ in docs for i, q in items if plain(q) in plain(t)}
    found = {(r.doc_id, r.item_id) for r in QUERIES["op7_decontamination"](spark, SF).collect()}
    assert whole and whole <= found and len(found) <= len(whole) + 2


def test_simhash(spark, docs):
    fps = [brute_fingerprint(t) for _, t, _, _ in docs]
    want = {(d, f"{f:016x}", c) for (d, *_), f, c in zip(docs, fps, brute_components([d[0] for d in docs], fps), strict=True)}
    assert {tuple(r) for r in QUERIES["op8_simhash"](spark, SF).collect()} == want


def test_lm_scores(spark, docs):
    """The query against the definition: all n-grams with two occurrences or more, no share asked for."""
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, *_ in docs}
    train = [t for d, t, _, _ in docs if not held[d]]
    n = sum(len(tokens(t)) for t in train)
    want = dict(zip([d[0] for d in docs], brute(train, [d[1] for d in docs], 0.0, 2 / n * (1 - 1e-9), 3, 0.5), strict=True))
    got = QUERIES["op4_lm_score"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        assert [r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score] == pytest.approx(want[r.doc_id], rel=1e-9)


def test_toxicity(spark, docs):
    """The query against the learned lexicon, matched word by word."""
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    lexicon = learn(rows, spark.read.parquet(f"{SF}/labels.parquet"), usable=~held_out(F.col("doc_id")))
    text, scores = {d: t for d, t, _, _ in docs}, {}
    for r in QUERIES["op9_toxicity"](spark, SF).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        words = folded(text[r.doc_id], lexicon.weights).split()
        weight = sum(lexicon.weights.get(w, 0.0) for w in words)
        weight -= sum(sum(lexicon.weights.get(w, 0.0) for w in p.split()) for p in lexicon.exceptions for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        weight = max(weight, 0.0)
        x = lexicon.link[0] + lexicon.link[1] * log1p(weight) + lexicon.link[2] * log1p(100 * weight / max(len(words), 1))
        scores[r.doc_id] = r.score
        assert r.score == pytest.approx(1 / (1 + exp(-x)) if lexicon.weights else 0.0, abs=1e-9)
    assert scores.keys() == text.keys()


def brute_ngrams(text):
    """Counts of 1-, 2- and 3-grams of letters, words between separators (0), by the keys that break ties."""
    out, word = Counter(), []
    for c in [*map(ord, text.lower()), 32]:
        if chr(c).isalpha():
            word.append(c if c < 1023 else 1 + c % 1022)
        elif word:
            run = [0, *word, 0]
            out.update(x | 2 << 30 for x in word)
            out.update(a << 10 | b | 1 << 30 for a, b in zip(run, run[1:], strict=False))
            out.update(a << 20 | b << 10 | c for a, b, c in zip(run, run[1:], run[2:], strict=False))
            word = []
    return out


def test_language(spark, docs):
    """The query against profiles and out-of-place distances by definition."""
    ranked = lambda counts: [k for k, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:400]]
    learned = {}
    for d, t, lang, _ in docs:
        if lang is not None and zlib.crc32(str(d).encode()) % 4 != 2:
            learned.setdefault(lang, Counter()).update(brute_ngrams(t))
    profiles = {x: {k: i for i, k in enumerate(ranked(c))} for x, c in learned.items()}
    lang, right = {d: x for d, _, x, _ in docs}, []
    text = {d: t for d, t, _, _ in docs}
    for r in QUERIES["op10_language"](spark, SF).collect():
        mine = ranked(brute_ngrams(text[r.doc_id]))
        away = {x: sum(abs(p[k] - i) if k in p else 400 for i, k in enumerate(mine)) for x, p in profiles.items()}
        assert r.lang_pred == (min(away, key=lambda x: (away[x], x)) if mine else "und")
        if r.held_out:
            right.append(r.lang_pred == lang[r.doc_id])
    assert sum(right) >= 0.95 * len(right)


def test_secrets(spark):
    """The planted tokens of a larger folder are called secrets and nothing else is, whether the forest saw them or not."""
    at = SF.replace("0.001", "0.01")
    text = dict(duckdb.sql(f"SELECT doc_id, text FROM '{at}/documents.parquet'").fetchall())
    planted = {(d, m.start(1)) for d, t in text.items() for m in re.finditer(r'token = "([0-9a-f]{40})"', t)}
    got = QUERIES["op1_secret_scan"](spark, at).collect()
    for r in got:
        assert hashlib.sha256(text[r.doc_id][r.start : r.start + r.n_chars].encode()).hexdigest() == r.candidate_sha256
    assert len(planted) > 5 and {(r.doc_id, r.start) for r in got if r.is_secret} == planted < {(r.doc_id, r.start) for r in got}


def test_pipeline(spark, docs):
    """Each stage against brute force on the rows it was given."""
    text = {d: t for d, t, _, _ in docs}
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    names = rows.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in rows.collect()}
        rows = stage(spark, rows, SF).cache()
        after = {r.doc_id: (r.text if "text" in rows.columns else None) for r in rows.collect()}
        assert set(after) <= set(before)
        if name != "mixing":
            assert rows.columns == names
        kept[name] = before, after
    before, after = kept["toxicity"]
    assert len(before) - len(after) < 0.3 * len(before) and all(after[d] == text[d] for d in after)
    before, after = kept["line_dedup"]
    assert set(before) == set(after)
    lines = Counter(x for d in after for x in {y for y in after[d].split("\n") if len(y.split()) >= 6})
    assert max(lines.values()) == 1
    own = Counter(x for d in before for x in set(before[d].split("\n")))
    assert all(x in after[d].split("\n") for d in after for x in before[d].split("\n") if own[x] == 1 and not any(c.isdigit() for c in x) and len(x.split()) < 11)
    before, after = kept["near_dedup"]
    ids = sorted(before)
    group = {i: i for i in ids}
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if group[i] != group[j] and jaccard(before[i], before[j]) >= 0.8:
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    assert set(group.values()) <= set(after) and len(set(after) - set(group.values())) <= 0.05 * (len(before) - len(after))
    before, after = kept["decontamination"]
    gone = set(before) - set(after)
    items = [words_of(t) for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    whole = {d for d in before if any(b" ".join(q) in b" ".join(words_of(before[d])) for q in items)}
    assert whole <= gone and len(gone) < 0.3 * len(before)
    for d in gone - whole:  # what goes besides holds most of a passage
        words = words_of(before[d])
        parts = [p.words for q in items for p in passages_of(0, b" ".join(q).decode(), None)]
        assert max(common_subsequence(p, words[i : i + 80]) / len(p) for p in parts for i in range(0, max(1, len(words)), 8)) >= 0.6
    before, after = kept["mixing"]
    assert all(after[d] == before[d] for d in after)
    for r in rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("words").alias("words"), F.first("taken").alias("taken"), F.first("size").alias("size")).collect():
        assert r.words == r.taken and r.n == (1 if r.taken <= r.size else 2)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "size", "taken").collect()) == sorted(tuple(r) for r in rows.select("doc_id", "size", "taken").collect())


def test_the_pipeline_comes_out_in_training_order(spark):
    """From many files, which Spark packs into tasks by size."""
    conf = {"spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = corpus_pipeline.run(spark, SF).select("at", "doc_id", "reading", "taken", "size", "text").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [r.at for r in rows] == sorted(r.at for r in rows)
    twice = Counter(r.doc_id for r in rows)
    assert all(twice[r.doc_id] == (1 if r.taken <= r.size else 2) and r.text for r in rows) and max(twice.values()) == 2


@pytest.mark.parametrize("empty", [("documents", "labels", "benchmark"), ("labels", "benchmark")])
def test_pipeline_over_empty_tables(spark, tmp_path, empty):
    """Without documents nothing comes out; without labels and benchmark nothing is toxic or leaked."""
    for name in ("documents", "labels", "benchmark"):
        rows = spark.read.parquet(f"{SF}/{name}.parquet")
        (rows.where("false") if name in empty else rows.where("doc_id < 40")).write.parquet(str(tmp_path / f"{name}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert bool(out) == ("documents" not in empty) and all(r.taken <= 2 * r.size and r.words <= r.size for r in out)
