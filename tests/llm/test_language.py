from __future__ import annotations

import random

from attest.llm.language import PART, counted, learn, ngrams, predict_language

DOCS = "doc_id long, text string, lang string, score string, lang_pred int"
PARTS = {"aa": ["ka", "ro", "mi"], "bb": ["sch", "ung", "ber"], "cc": ["éa", "oux", "tré"], "dd": ["ция", "ова", "нет"]}


def say(rng, lang, n):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus(n=400):
    rng = random.Random(1)
    return [(i, say(rng, lang, rng.randint(3, 80)), lang, "x", 1) for i in range(n) for lang in [rng.choice(list(PARTS))]]


def brute_ngrams(text):
    out = []
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        padded = f" {word} "
        out += list(word) + [padded[i : i + 2] for i in range(len(padded) - 1)] + [padded[i : i + 3] for i in range(len(padded) - 2)]
    return out


def test_ngrams_are_those_of_padded_words():
    for text in ["", "a", "ab c!", "Été à  Zoë-3x", "  one,two  "]:
        assert sorted(ngrams_text(k) for k in ngrams(text).tolist()) == sorted(brute_ngrams(text))


def ngrams_text(key):
    kind, n = key >> 30, {2: 1, 1: 2, 0: 3}[key >> 30]
    chars = [(key & ~(kind << 30)) >> 10 * i & 1023 for i in reversed(range(n))]
    return "".join(chr(c) if c else " " for c in chars)


def test_counts_of_a_long_text_come_in_parts():
    text = "abc def " * (PART // 4)
    keys, counts = counted(text)
    assert len(keys) == len(set(brute_ngrams("abc def"))) and counts.min() >= 2 * (PART // 8) - 4


def test_held_out_accuracy(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, DOCS)
    profiles = learn(df, usable=df.doc_id % 4 != 2)
    assert profiles.languages == sorted(PARTS)
    out = predict_language(df, profiles).collect()
    lang = {d[0]: d[2] for d in docs}
    held = [r for r in out if r.doc_id % 4 == 2]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in out)


def test_odd_rows(spark):
    profiles = learn(spark.createDataFrame([*corpus(100), (1000, None, "aa", "x", 1), (1001, "text", None, "x", 1)], DOCS))
    odd = [(1, None, "aa", "x", 1), (2, "", "aa", "x", 1), (3, "12 + 3!", "aa", "x", 1), (None, "ungschber", None, "x", 1), (4, "karo " * 60_000, "bb", "x", 1), (4, "karo " * 60_000, "bb", "x", 1)]
    out = predict_language(spark.createDataFrame(odd, DOCS), profiles).collect()
    assert [(r.lang_pred, r.score) for r in out[:3]] == [("und", 0.0)] * 3
    assert [r.lang_pred for r in out[3:]] == ["bb", "aa", "aa"]
    assert predict_language(spark.createDataFrame([], DOCS), profiles).collect() == []
    none = learn(spark.createDataFrame([], DOCS))
    assert {r.lang_pred for r in predict_language(spark.createDataFrame(odd, DOCS), none).collect()} == {"und"}


def test_kept_columns_of_the_results_names_are_replaced(spark):
    docs = spark.createDataFrame([(1, "the cat", "en", 5.0)], "doc_id long, text string, lang string, score double")
    out = predict_language(docs, learn(docs), keep=("doc_id", "lang", "score"))
    assert out.columns == ["doc_id", "lang", "lang_pred", "score"] and out.first().lang_pred == "en"
