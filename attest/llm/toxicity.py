"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text.

Folding undoes disguises: case, accents and look-alike letters, and digits or signs in the place of letters. The lexicon
and its weights, the phrases in which a word is harmless, and the link from length-normalised weight to probability are
learned from labelled rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Container, Iterator, Sequence
from dataclasses import dataclass, field
from math import log as log_of

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.llm.common import fold_of, spare

# Letters of other scripts that look like Latin ones, and signs that are put in the place of letters.
LOOK_ALIKES = dict(zip("абвгеһіјкмнорсѕтухԁԛԝαβεικνορτυχγѵоɑɡɩʟոս", "abbreh" "ijkmhopcstyxdqwabeiknoptuxyvoagilnu", strict=True))
SIGNS = dict(zip("01345789@$!|", "oieastbgasil", strict=True))

_SIGN = re.compile("[" + re.escape("".join(SIGNS)) + "](?=[" + re.escape("".join(SIGNS)) + "]*[a-z])")
_LAST = re.compile("([a-z])([" + re.escape("".join(SIGNS)) + "]+)(?![a-z])")
_OTHER = re.compile("[^a-z]+")
_MARKS = "".join(chr(c) for c in range(0x300, 0x1F000) if unicodedata.category(chr(c))[0] == "M")
_MARK = frozenset(_MARKS)
_PLAIN = re.compile(r"[\W\d_]+")  # as _NO_LETTER, where there are no marks
_NO_LETTER = re.compile(rf"(?:(?![{_MARKS}])[\W\d_])+")
#: Letters of scripts that are written without spaces: Thai to Myanmar, Khmer, kana and Han.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u30ff\u3400-\u9fff\U00020000-\U000323af]+")


def _letters() -> dict[int, str]:
    """Every code point of the usual alphabetic blocks whose compatibility form starts with a Latin letter."""
    out = {}
    for block in ((0xC0, 0x250), (0x1E00, 0x1F00), (0x2100, 0x2150), (0x24B6, 0x24EA), (0xFF21, 0xFF5B), (0x1D400, 0x1D6A6)):
        for c in range(*block):
            base = unicodedata.normalize("NFKD", chr(c)).lower()[:1]
            if "a" <= base <= "z":
                out[c] = base
    return out | {ord(k): v for k, v in LOOK_ALIKES.items()} | {c: "" for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, *range(0x300, 0x370))}


_FOLD = _letters()


def _signed(text: str | None) -> str:
    """Lower case, letters folded, signs before a letter as letters."""
    t = (text or "").lower()
    if not t.isascii():
        t = unicodedata.normalize("NFKC", t).lower().translate(_FOLD)
    return _SIGN.sub(lambda m: SIGNS[m[0]], t)


def _spaced(t: str) -> str:
    if t.isascii():
        t = _OTHER.sub(" ", t).strip()
    else:
        t = _UNSPACED.sub(lambda m: f" {' '.join(m[0][i : i + 2] for i in range(max(1, len(m[0]) - 1)))} ", t)
        t = (_PLAIN if _MARK.isdisjoint(t) else _NO_LETTER).sub(" ", t).strip()
    return f" {t} " if t else " "


def _ends(word: str, signs: str, longest: int = 16) -> list[str]:
    """What a word may be whose last letters are these signs, longest first; the signs after that are punctuation."""
    return [word + "".join(map(SIGNS.get, signs[:k])) for k in range(min(len(signs), longest), 0, -1)]


def _first(t: str, end: int) -> int:
    """Where the letters begin that end there."""
    while end and t[end - 1].isalpha():
        end -= 1
    return end


def folded(text: str | None, known: Container[str] = ()) -> str:
    """Lower-case words with single spaces between and around them; scripts without spaces as pairs of letters.

    Signs at a word's end are letters if that makes it a word of ``known``, else punctuation.
    """
    t = _signed(text)
    if known:
        out, at = [], 0
        for m in _LAST.finditer(t):
            begin = max(at, _first(t, m.start(2)))
            word = t[begin : m.start(2)]
            if word not in known and (found := next((w for w in _ends(word, m[2]) if w in known), None)):
                out += [t[at:begin], found, " "]
                at = m.end()
        t = "".join(out) + t[at:]
    return _spaced(t)


def forms(text: str | None) -> set[str]:
    """The words of a text, with all forms of those that end in signs."""
    t = _signed(text)
    found = set(_spaced(t).split())
    for m in _LAST.finditer(t):
        found.update(_ends(t[_first(t, m.start(2)) : m.start(2)], m[2]))
    return found


@dataclass
class Lexicon:
    """Weights of words, phrases that void them, and the logistic link; small and of bounded size, so it travels whole."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    link: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def automaton(self):
        found = ahocorasick.Automaton()
        for word, weight in self.weights.items():
            found.add_word(f" {word} ", (len(word), weight))
        for phrase in self.exceptions:  # takes back what the lexicon words inside it add
            found.add_word(f" {phrase} ", (len(phrase), -sum(self.weights.get(w, 0.0) for w in phrase.split())))
        if len(found):
            found.make_automaton()
        return found


def weight_of(text: str, automaton) -> tuple[float, int]:
    """The summed weight of the matches in folded text, and its number of words."""
    words = text.count(" ") - 1
    total = sum(w for _, (_, w) in automaton.iter(text)) if len(automaton) else 0.0
    return max(total, 0.0), max(words, 0)


def features(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(weight)), np.log1p(weight), np.log1p(100 * weight / np.maximum(words, 1))], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Newton's method; features are few."""
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta)), x.T @ (y - p) - ridge * beta)
    return beta


def _rising(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The logistic link in which no feature lowers the probability: one that would (by chance, or as its sister says it all) is left out."""
    use = np.ones(x.shape[1], bool)
    while True:
        beta = np.zeros(x.shape[1])
        beta[use] = _logistic(x[:, use], y)
        falls = np.flatnonzero(beta[1:] < 0) + 1
        if not len(falls):
            return beta
        use[falls[beta[falls].argmin()]] = False


def learn(docs: DataFrame, labels: DataFrame, usable: Column | None = None, max_rows: int = 20_000, max_words: int = 2_000, least_docs: int = 3, false_share: float = 0.01, exceptions: Sequence[str] = ()) -> Lexicon:
    """Learn a Lexicon from at most max_rows labelled rows (those with the smallest md5 of doc_id, so reruns agree).

    The lexicon has words in at least least_docs toxic texts, weighted by their smoothed log-odds; at most max_words of
    them, those that are the least likely by chance. Of all its words at most a share of false_share is expected to be
    there by chance (Benjamini-Hochberg, on Chernoff's bound of the binomial tail, which holds for small counts as well). The link
    and the exception phrases (two words, in at least least_docs texts, mostly clean ones; the max_words most frequent;
    ``exceptions`` adds more) are learned on two halves, each measured with the lexicon of the other half. Rows with a null label or id are not used;
    without labelled rows of both kinds the lexicon is empty and every score is 0.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    if usable is not None:
        known = known.where(usable)
    known = known.withColumn("order", F.md5(F.col("doc_id").cast("string").cast("binary"))).orderBy("order", "toxic").limit(max_rows)
    rows = F.broadcast(known.withColumn("half", F.when(F.substring("order", -1, 1) >= "8", 1).otherwise(0)).drop("order"))  # at most max_rows rows of a few bytes
    sample = docs.select("doc_id", "text").join(rows, "doc_id").select("text", "toxic", "half")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for text, toxic, half in zip(b.column("text"), b.column("toxic").to_pylist(), b.column("half").to_pylist(), strict=True):
                kind = 2 * half + bool(toxic)
                seen.update((w, kind) for w in forms(text.as_py()))
                seen["", kind] += 1
        yield pa.record_batch([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["word", "kind", "n"])

    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0)).alias(f"n{kind}")
    counts = sample.mapInArrow(count, "word string, kind int, n long").groupBy("word").agg(*[of(k) for k in range(4)]).cache()
    totals = counts.where("word = ''").first()

    def lexicon(*halves: int) -> dict[str, float]:
        good, bad = (sum(F.col(f"n{2 * h + k}") for h in halves) for k in (0, 1))
        all_good, all_bad = (float(sum(totals[f"n{2 * h + k}"] for h in halves)) for k in (0, 1))
        if not all_good or not all_bad:
            return {}
        odds = F.log((bad + 0.5) / (all_bad + 1)) - F.log((good + 0.5) / (all_good + 1))
        usual, share = all_bad / (all_bad + all_good), bad / (bad + good)
        log = lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)
        chance = -(bad + good) * (log(share) - share * log_of(usual) + log(1 - share) - (1 - share) * log_of(1 - usual))  # log of the bound
        tested = counts.where((bad + good >= least_docs) & ((F.length("word") > 2) | F.col("word").rlike("[^a-z]")))
        words = tested.where((bad >= least_docs) & (share > usual)).select("word", odds.alias("odds"), chance.alias("chance"))
        best, of_all = words.orderBy("chance", "word").limit(max_words).collect(), tested.count()
        last = max((k for k, r in enumerate(best, 1) if r.chance <= log_of(k * false_share / of_all)), default=0)
        return {r.word: r.odds for r in best[:last]}

    if not totals or not totals.n0 + totals.n2 or not totals.n1 + totals.n3:
        counts.unpersist()
        return Lexicon(exceptions=tuple(exceptions))
    whole = lexicon(0, 1)
    parts = [Lexicon(lexicon(other) or whole) for other in (1, 0)]  # a half with too few toxic rows for any word is no test
    counts.unpersist()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [p.automaton() for p in parts]
        for b in batches:
            out: dict[str, list] = {"toxic": b.column("toxic").to_pylist(), "weight": [], "words": [], "phrases": []}
            for text, half in zip(b.column("text"), b.column("half").to_pylist(), strict=True):
                known_words = parts[half].weights
                t = folded(text.as_py(), known_words)
                weight, n = weight_of(t, automata[half])
                ws = t.split() if weight else []
                out["weight"].append(weight)
                out["words"].append(n)
                out["phrases"].append(sorted({f"{x} {y}" for x, y in zip(ws, ws[1:], strict=False) if (x in known_words) != (y in known_words)}))
            yield pa.record_batch([pa.array(out["toxic"], pa.int32()), pa.array(out["weight"], pa.float64()), pa.array(out["words"], pa.int64()), pa.array(out["phrases"], pa.list_(pa.string()))], names=list(out))

    measured = sample.mapInArrow(measure, "toxic int, weight double, words long, phrases array<string>").cache()
    seen = measured.select("toxic", "weight", "words").toPandas()  # max_rows rows at most, of three numbers
    seen = seen.sort_values(["toxic", "weight", "words"])  # sums in one order, whatever the partitions
    harmless = measured.select("toxic", F.explode("phrases").alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n"), F.avg("toxic").alias("share"))
    best = harmless.where((F.col("n") >= least_docs) & (F.col("share") < 0.25)).orderBy(F.desc("n"), "phrase").limit(max_words)
    learned = [r.phrase for r in best.select("phrase").collect()]
    measured.unpersist()
    beta = _rising(features(seen["weight"].to_numpy(), seen["words"].to_numpy()), seen["toxic"].to_numpy().astype(float))
    return Lexicon(whole, tuple(sorted({*exceptions, *learned})), tuple(float(x) for x in beta))


def toxicity_scores(docs: DataFrame, lexicon: Lexicon, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The kept columns and score (0 to 1) of every row; only the text is looked at. Null and empty texts score as clean.

    A kept column named score is replaced. An empty lexicon knows nothing as toxic: all score 0. Work is per row: ties and
    repeated rows score alike, very long texts are scored whole, an empty table gives no rows.
    """
    keep = [c for c in keep if c != "score"]
    whole = spare(docs, "text_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for b in batches:
            pairs = [weight_of(folded(t.as_py(), lexicon.weights), automaton) for t in b.column(whole)]
            x = features(np.array([p[0] for p in pairs], float), np.array([p[1] for p in pairs], float))
            score = 1 / (1 + np.exp(-np.clip(x @ np.array(lexicon.link), -30, 30))) if lexicon.weights else np.zeros(len(pairs))
            yield pa.record_batch([*(b.column(c) for c in keep), pa.array(score)], names=[*keep, "score"])

    cols = docs.select(*keep, F.col("text").alias(whole))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema if f.name != whole), "score double"])
    return cols.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return fold_of(doc_id, 4) == 2


def drop_toxic(docs: DataFrame, labels: DataFrame, most: float = 0.3) -> DataFrame:
    """docs whose score is below ``most``, with their own columns; learned from the labels outside the held-out fold.

    If the labels teach no word, no row is known to be toxic and all stay. Rows with null or empty texts score as clean
    and rows with a null doc_id are scored like any other; repeated rows stay or go together; an empty table stays empty;
    a column called score is left as it is.
    """
    lexicon = learn(docs, labels, usable=~held_out(F.col("doc_id")))
    if not lexicon.weights:
        return docs
    plain = docs.columns
    own = spare(docs, "score_")
    scored = toxicity_scores(docs.withColumnsRenamed({"score": own}), lexicon, [c if c != "score" else own for c in plain])
    return scored.where(F.col("score") < most).drop("score").withColumnsRenamed({own: "score"}).select(*plain)
