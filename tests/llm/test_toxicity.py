from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from attest.llm.toxicity import Lexicon, drop_toxic, folded, held_out, learn, toxicity_scores, weight_of

DOCS, LABELS = "doc_id long, text string, score string, toxic string", "doc_id long, toxic int, text string"


@pytest.mark.parametrize(("text", "out"), [(None, " "), ("", " "), ("You ID1OT!", " you idiot "), ("ѕtuріd", " stupid "), ("m0r0n$$$ sc%um", " moron sc um "), ("ÍDIÖT $cum 12", " idiot scum "), ("a​b", " ab "), ("ｌｏｓｅｒ", " loser ")])
def test_folding(text, out):
    assert folded(text) == out


def test_matching_and_exceptions():
    auto = Lexicon({"trash": 2.0, "idiot": 3.0}, ("trash can",)).automaton()
    assert weight_of(folded("trash idiot trashy idiot trash"), auto) == (10.0, 5)
    assert weight_of(folded("the trash can"), auto) == (0.0, 3)
    assert weight_of(folded(None), auto) == (0.0, 0)
    assert weight_of(folded("x"), Lexicon().automaton()) == (0.0, 1)


def corpus(n=2000, seed=1):
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "tu") for b in ("ne", "ra", "so") for c in ("", "n", "s", "ri")]
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.15
        text = [rng.choice(words) for _ in range(rng.randint(5, 200))]
        if toxic:
            for _ in range(rng.randint(1, 6)):
                text[rng.randrange(len(text))] = rng.choice(["vilegit", "V1LEGIT", "rotbrain", "rоtbrain"])
        docs.append((i, " ".join(text), "x", "y"))
        labels.append((i, int(toxic), "z"))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    df, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    lexicon = learn(df, lab, usable=~held_out(F.col("doc_id")))
    assert {"vilegit", "rotbrain"} <= set(lexicon.weights)
    out = toxicity_scores(df, lexicon).join(lab.select("doc_id", F.col("toxic").alias("t")), "doc_id").where(held_out(F.col("doc_id"))).collect()
    assert len(out) > 300 and sum((r.score >= 0.3) == bool(r.t) for r in out) >= 0.97 * len(out)
    assert learn(df, lab, usable=~held_out(F.col("doc_id"))) == lexicon
    kept = drop_toxic(df, lab)
    assert kept.columns == df.columns and {r.score for r in kept.collect()} == {"x"}
    assert kept.where("text ILIKE '%rotbrain%'").count() < 0.05 * sum(t for _, t, _ in labels)


def test_odd_rows(spark):
    docs, labels = corpus(400)
    odd = [(None, "vilegit you vilegit", "x", "y"), (900, None, "x", "y"), (901, "", "x", "y"), (902, "lone " * 50_000 + "vilegit", "x", "y"), (902, "lone " * 50_000 + "vilegit", "x", "y")]
    df = spark.createDataFrame(docs + odd, DOCS)
    lexicon = learn(df, spark.createDataFrame([*labels, (None, 1, "z"), (5, None, "z")], LABELS))
    out = toxicity_scores(spark.createDataFrame(odd, DOCS), lexicon).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert [r.score for r in out if r.doc_id == 902][0] == [r.score for r in out if r.doc_id == 902][1]
    assert [r.score for r in out if r.doc_id is None][0] > 0.5
    empty = spark.createDataFrame([], DOCS)
    assert toxicity_scores(empty, lexicon).collect() == []
    none = learn(empty, spark.createDataFrame([], LABELS))
    assert {r.score for r in toxicity_scores(df, none).collect()} == {0.0}


@pytest.mark.parametrize(("text", "word"), [("worthle55", "worthless"), ("worthle$$!", "worthless"), ("an idio7.", "idiot"), ("disgustin9", "disgusting"), ("HAT3", "hate"), ("id1o7!!", "idiot"), ("idiot!", "idiot"), ("morons! m0r0n$$$", "morons")])
def test_signs_at_the_end_of_a_word(text, word):
    assert f" {word} " in folded(text, {word: 1.0})
    assert folded(f"{text} 5 x", {}) == folded(f"{text} 5 x")
    auto = Lexicon({word: 2.0}).automaton()
    assert weight_of(folded(text, {word: 2.0}), auto)[0] >= 2.0


@pytest.mark.parametrize("words", [["дурак", "тупица", "солнце", "трава", "дом", "жизнь"], ["ηλίθιε", "βλάκα", "ήλιος", "χόρτο", "σπίτι", "ζωή"], ["احمق", "غبي", "شمس", "عشب", "بيت", "حياة"], ["मूर्ख", "बेवकूफ", "सूरज", "घास", "मकान", "जीवन"], ["笨蛋", "白痴", "太阳", "青草", "房子", "生活"], ["바보", "멍청이", "태양", "잔디", "주택", "생명"]])
def test_other_scripts(spark, words):
    rng = random.Random(2)
    glue = "" if words[0] == "笨蛋" else " "
    docs, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        docs.append((i, glue.join(rng.choice(words[:2] if toxic and k < 2 else words[2:]) for k in range(rng.randint(6, 30))), "x", "y"))
        labels.append((i, int(toxic), "z"))
    df = spark.createDataFrame(docs, DOCS)
    out = toxicity_scores(df, learn(df, spark.createDataFrame(labels, LABELS))).collect()
    assert all((r.score >= 0.3) == (r.doc_id % 5 == 0) for r in out)


@pytest.mark.parametrize("toxic", [1000, 2000])
def test_rare_words_count_among_many_toxic_texts(spark, toxic):
    rng = random.Random(3)
    say = lambda: " ".join(f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(20))
    docs = [(i, say() + (" vilegit" if i < toxic and i >= 15 else " rotbrain" if i < 15 else ""), "x", "y") for i in range(3 * toxic)]
    lexicon = learn(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(i, int(i < toxic), "z") for i in range(3 * toxic)], LABELS))
    assert set(lexicon.weights) == {"vilegit", "rotbrain"}


@pytest.mark.parametrize("labels", [[], [(i, 1, "z") for i in range(300)], [(i, 0, "z") for i in range(300)], [(i, int(i % 2), "z") for i in range(300)]])
def test_all_rows_stay_if_nothing_was_learned(spark, labels):
    df = spark.createDataFrame([(i, "some words again", "x", "y") for i in range(300)], DOCS)
    assert drop_toxic(df, spark.createDataFrame(labels, LABELS)).count() == 300


@pytest.mark.parametrize("labels", [[], [(1, 0, "z"), (2, 0, "z"), (3, 0, "z")], [(1, 1, "z"), (2, 1, "z")], [(None, 1, "z"), (1, None, "z")]])
def test_without_labels_of_both_kinds_nothing_is_toxic(spark, labels):
    df, lab = spark.createDataFrame(corpus(60)[0], DOCS), spark.createDataFrame(labels, LABELS)
    assert {r.score for r in toxicity_scores(df, learn(df, lab)).collect()} == {0.0}
    assert drop_toxic(df, lab).count() == 60


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", "s", "t", "u")], "doc_id long, text string, score string, text_ string, score_ string")
    lexicon = Lexicon({"trash": 2.0}, (), (-3.0, 1.0, 1.0))
    assert toxicity_scores(df, lexicon, ["doc_id", "text_", "score_"]).first().asDict() == {"doc_id": 1, "text_": "t", "score_": "u", "score": pytest.approx(0.047, abs=1e-3)}
