"""Secret scan: candidates from whole texts, and a random forest that removes false findings.

Candidates are values that something with a telling name is set to, passwords inside addresses, private key blocks, and
long runs of key characters wherever they stand. The forest looks at a candidate's length, character transitions and
dictionary coverage, at the document's path and at the neighbouring words, and is trained from labelled findings.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.llm.common import materialized
from attest.llm.ngram_lm import count_words

_RUN = re.compile(r"[A-Za-z0-9+/_.\-]{16,}={0,2}")
ONE_CASE = 20  # a run of letters of one case is long from here on
# Runs are taken as a whole (possessively), so that each is gone through once however long it is.
_SET = re.compile(r"""(?<![\w.\-])([\w.\-]++)["']?[ \t]*+(?:=>|:=|=|:)[ \t]*+["'`]?(?=([^\s"'`]{4,}))""")
_TELLING = re.compile(r"token|secret|passw(?:or)?d|passphrase|pwd|api_?key|access_?key|auth|credential", re.I)
_ADDRESS = re.compile(r"(?<=[a-z0-9+.\-])://[^\s:/@]++:([^\s@/]{3,}+)@", re.I)
_MARK = re.compile(r"-----(BEGIN|END) [A-Z ]*PRIVATE KEY-----")
_NAMES = re.compile(r"token|secret|passw|pwd|api|auth|bearer|credential|key", re.I)
_MOCK = re.compile(r"test|example|sample|mock|fixture|doc|readme", re.I)
_WORDS = re.compile(r"[^\W\d_]+")

# The formats of known kinds of keys, and of digests, which may be keys or not.
KEYS = (
    "A(KI|SI)A[0-9A-Z]{16}", "gh[pousr]_[A-Za-z0-9]{36,}", "xox[abprs]-[A-Za-z0-9-]{10,}", "AIza[A-Za-z0-9_-]{35}", "sk_(live|test)_[A-Za-z0-9]{16,}",
    "eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]*", "-----BEGIN [A-Z ]*PRIVATE KEY-----.*",
)
DIGESTS = ("[0-9a-fA-F]{32}", "[0-9a-fA-F]{40}", "[0-9a-fA-F]{64}")

# What stands for a secret, and what is none by its form: numbers and dates; names of hosts, files and versions.
STAND_INS = ("<.*>", r"[$%]?\{.*\}", "%.*%", "[xX*.]{4,}", "(?i:changeme|password|passwd|secret|none|null|true|false|undefined|example.*|your.*)")
PLAIN = (r"[0-9.,:/_+\-]+", r"([A-Za-z0-9_\-]{1,15}[./])+[A-Za-z0-9_\-]{1,15}[.,;:]?")
PUBLIC_FROM = 3  # different surroundings
LEAST_COUNT = 3  # occurrences that make a word one of the dictionary
SHORTEST, LONGEST = 4, 24  # letters of a dictionary word, by definition

FEATURES = (
    "length", "entropy", "digits", "upper", "distinct", "hex", "transition", "switches", "coverage", "quoted", "assigned",
    "name_before", "name_near", "before_known", "after_known", "path_depth", "path_mock", "path_length",
)
SYMBOLS = 39  # a-z, 0-9, upper case, other signs, end


def _symbols(text: str) -> np.ndarray:
    b = np.frombuffer(text.encode("ascii", "replace"), np.uint8)
    out = np.full(len(b), 37)
    for low, high, to in ((97, 122, 0), (48, 57, 26)):
        inside = (b >= low) & (b <= high)
        out[inside] = b[inside].astype(int) - low + to
    out[(b >= 65) & (b <= 90)] = 36
    out[(b == 32) | (b == 10)] = 38
    return out


def transitions(docs: DataFrame) -> np.ndarray:
    """log2 of P(next | this) over character symbols, from all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS * SYMBOLS, np.int64)
        for b in batches:
            for text in b.column("text"):
                s = _symbols(text.as_py() or "")
                total += np.bincount(s[:-1] * SYMBOLS + s[1:], minlength=len(total))[: len(total)] if len(s) > 1 else 0
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int64)), pa.array(total[at])], names=["pair", "n"])

    found = docs.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()  # SYMBOLS**2 rows at most
    counts = np.ones(SYMBOLS * SYMBOLS)
    for r in found:
        counts[r.pair] += r.n
    counts = counts.reshape(SYMBOLS, SYMBOLS)
    return np.log2(counts / counts.sum(axis=1, keepdims=True))


def coverage(candidate: str, dictionary: set[str]) -> float:
    """The largest share of characters that dictionary words can cover without overlap."""
    low, best = candidate.lower(), [0] * (len(candidate) + 1)
    for i in range(1, len(low) + 1):
        best[i] = best[i - 1]
        if low[i - 1].isalpha():
            for n in range(SHORTEST, min(i, LONGEST) + 1):
                if best[i - n] + n > best[i] and low[i - n : i] in dictionary:
                    best[i] = best[i - n] + n
    return best[-1] / len(candidate)


def neighbours(before: str, after: str) -> tuple[str, list[str], list[str]]:
    """What is joined to a candidate, the up to four words before that, and the word after it."""
    words, joined = before.split(), before[-1:] not in ("", " ", "\t", "\n", "\r")
    prefix, words = (words[-1], words[:-1][-4:]) if joined and words else ("", words[-4:])
    return prefix, words, after.split()[:1]


def looked_up(candidate: str, before: str, after: str) -> list[str]:
    """The words that coverage() and describe() ask the dictionary for."""
    found = set()
    for run in _WORDS.findall(candidate.lower()):
        found.update(run[i : i + n] for n in range(SHORTEST, min(len(run), LONGEST) + 1) for i in range(len(run) - n + 1))
    _, words, following = neighbours(before, after)
    for w in [*words[-1:], *following]:
        found.update(x for x in _WORDS.findall(w.lower()) if SHORTEST <= len(x) <= LONGEST)
    return sorted(found)


def describe(candidate: str, before: str, after: str, path: str, model: np.ndarray, dictionary: set[str]) -> list[float]:
    """FEATURES of a candidate between the texts before and after it."""
    n = len(candidate)
    counts = [candidate.count(c) for c in set(candidate)]
    s = _symbols(candidate)
    kind = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in candidate]
    prefix, words, following = neighbours(before, after)
    known = lambda w: float(any(x in dictionary for x in _WORDS.findall(w.lower())))
    return [
        float(n), -sum(c / n * log2(c / n) for c in counts), kind.count("d") / n, kind.count("u") / n, len(counts) / n,
        sum(c in "0123456789abcdefABCDEF" for c in candidate) / n, float(model[s[:-1], s[1:]].mean()), sum(a != b for a, b in pairwise(kind)) / n, coverage(candidate, dictionary),
        float(prefix[-1:] in ("'", '"', "`")), float(bool(re.search("[=:]", prefix) or words and words[-1][-1:] in ("=", ":"))),
        float(bool(_NAMES.search(prefix) or any(_NAMES.search(w) for w in words[-2:]))), float(any(_NAMES.search(w) for w in words)), known(words[-1]) if words else 0.0, known(following[0]) if following else 0.0,
        float(path.count("/")), float(bool(_MOCK.search(path))), float(len(path)),
    ]


def marked_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the candidates of a text, in order and without overlaps: of those that overlap the first, and of these the longest.

    kind: block, address, assigned or run.
    """
    found, opened = [], None
    if "-----BEGIN" in text:
        for m in _MARK.finditer(text):
            if m[1] == "BEGIN":
                opened = m.start() if opened is None else opened
            elif opened is not None:
                found.append((opened, m.end(), "block"))
                opened = None
    if "://" in text:
        found += [(*m.span(1), "address") for m in _ADDRESS.finditer(text)]
    if "=" in text or ":" in text:
        found += [(*m.span(2), "assigned") for m in _SET.finditer(text) if _TELLING.search(m[1])]
    for m in _RUN.finditer(text):
        x = m[0]
        mixed = x[1:].upper() != x[1:] and x[1:].lower() != x[1:]
        if mixed or len(x) >= ONE_CASE or any(map(str.isdigit, x)):
            found.append((*m.span(), "run"))
    out: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(found, key=lambda s: (s[0], -s[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b, kind))
    return out


def spans(text: str) -> list[tuple[int, int]]:
    return [(a, b) for a, b, _ in marked_spans(text)]


def dictionary_words(docs: DataFrame) -> DataFrame:
    """word: what occurs at least LEAST_COUNT times in all texts, without the punctuation around it, if it then is SHORTEST to LONGEST letters."""
    words = count_words(docs.select(F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")))
    plain = F.lower(F.regexp_replace(F.decode("word", "UTF-8"), r"^[.,;:!?\"'()]+|[.,;:!?\"'()]+$", ""))
    return words.where(F.col("c") >= LEAST_COUNT).select(plain.alias("word")).where(F.col("word").rlike(rf"^\p{{L}}{{{SHORTEST},{LONGEST}}}$")).distinct()


def candidates(docs: DataFrame, model: np.ndarray, dictionary: DataFrame, path: str = "source") -> DataFrame:
    """doc_id, start, candidate, kind, context, features of the candidates in whole texts (see marked_spans).

    dictionary: a table of words. The few words that a candidate asks for are looked up by a join, so the dictionary may
    be of any size. context tells apart what stands before a candidate.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text, where in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("path").to_pylist(), strict=True):
                text = text.as_py() or ""
                for start, end, kind in marked_spans(text):
                    x, before, after = text[start:end], text[max(0, start - 200) : start], text[end : end + 100]
                    rows.append((doc, start, x, kind, before, after, where or "", looked_up(x, before, after)))
            kinds = (pa.int64(), pa.int64(), *[pa.string()] * 5, pa.list_(pa.string()))
            names = ["doc_id", "start", "candidate", "kind", "before", "after", "path", "words"]
            yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("candidate", "before", "after", "path", "known")]
            rows = [describe(x, before, after, where, model, set(known or ())) for x, before, after, where, known in zip(*columns, strict=True)]
            yield pa.record_batch([*[b.column(c) for c in ("doc_id", "start", "candidate", "kind", "context")], pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "start", "candidate", "kind", "context", "features"])

    where = F.col(path).cast("string") if path in docs.columns else F.lit("")
    found = docs.select(F.col("doc_id").cast("long"), "text", where.alias("path")).mapInArrow(cut, "doc_id long, start long, candidate string, kind string, before string, after string, path string, words array<string>")
    found = materialized(found.withColumn("row", F.monotonically_increasing_id()), "secret-spans")
    known = found.select("row", F.explode("words").alias("word")).join(dictionary.select("word"), "word", "left_semi").groupBy("row").agg(F.collect_set("word").alias("known"))  # of a candidate's own words
    rows = found.drop("words").join(known, "row", "left").withColumn("context", F.xxhash64("before"))
    return rows.select("doc_id", "start", "candidate", "kind", "context", "before", "after", "path", "known").mapInArrow(described, "doc_id long, start long, candidate string, kind string, context long, features array<double>")


def weak_labels(found: DataFrame) -> DataFrame:
    """found with label, a stand-in for reviewed findings where there are none; null where nothing tells.

    1: the format of a known kind of key (KEYS), and a password in an address. 0: a stand-in for one (STAND_INS); numbers
    and names by their form (PLAIN), unless they are set to a telling name; what stands in PUBLIC_FROM different
    surroundings or more, as no secret does (copies of a document are one surrounding). What has the format of a digest
    (DIGESTS) is 1 if it is set to something with a telling name, else 0. All else is for the forest to judge; of what the
    rules go by, only the name is a feature.
    """
    is_like = lambda shapes: F.col("candidate").rlike(f"^(?s)({'|'.join(shapes)})$")
    feature = lambda name: F.element_at("features", FEATURES.index(name) + 1) > 0
    named = feature("name_before") & feature("assigned")
    places = found.select("candidate", "context").distinct().groupBy("candidate").agg(F.count("*").alias("places")).where(F.col("places") >= PUBLIC_FROM)
    joined = found.join(places, "candidate", "left")
    label = F.when(is_like(KEYS), 1.0).when(is_like(STAND_INS), 0.0).when(F.col("kind") == "address", 1.0).when(is_like(DIGESTS), named.cast("double")).when(F.col("places").isNotNull() | (is_like(PLAIN) & ~named), 0.0)
    return joined.select(*found.columns, label.alias("label"))


def train(labelled: DataFrame, max_rows: int = 20_000, trees: int = 24, depth: int = 6, seed: int = 11):
    """A forest from at most max_rows distinct labelled findings (features, label), half of either label; None without both.

    Of each label those with the smallest hash are taken. Copies of a finding are one row, which weighs by the logarithm
    of their number, so that a finding of very many copies doesn't crowd the others out.
    """
    order = F.md5(F.concat_ws(",", F.col("features").cast("array<string>")))
    rows = labelled.where(F.col("label").isNotNull()).groupBy("features", "label").agg(F.log2(F.count("*") + 1.0).alias("weight"))
    rows = rows.select(array_to_vector("features").alias("x"), "label", "weight", order.alias("order"))
    half = lambda hit: rows.where(F.col("label") > 0.5 if hit else F.col("label") <= 0.5).orderBy("order").limit(max_rows // 2)
    sample = half(True).unionByName(half(False)).cache()
    try:
        if sample.select("label").distinct().count() < 2:
            return None
        return RandomForestClassifier(featuresCol="x", labelCol="label", weightCol="weight", predictionCol="guess", rawPredictionCol="raw", probabilityCol="p", numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed).fit(sample.repartition(1).sortWithinPartitions("order"))
    finally:
        sample.unpersist()


def scan(docs: DataFrame, labelled: DataFrame | None = None, usable: Column | None = None, path: str = "source", least: float = 0.5) -> DataFrame:
    """doc_id, start, candidate, score, is_secret: every candidate of every whole text with the forest's probability.

    labelled: reviewed findings (doc_id, candidate, label 0/1); without them weak_labels() labels the candidates of the
    ``usable`` rows. Null and empty texts have no candidates; very long ones are read whole; rows with a null doc_id are
    scanned too; repeated rows repeat their findings; an empty table has none. Where labels of both kinds are missing
    every score is 0.5. A document table without the path column has empty paths; other columns are ignored.
    """
    dictionary = materialized(dictionary_words(docs), "secret-words")
    found = materialized(candidates(docs, transitions(docs), dictionary, path), "secret-candidates")
    if labelled is None:
        known = weak_labels(found.where(usable if usable is not None else F.lit(True)))
    else:
        known = found.join(labelled.select("doc_id", "candidate", F.col("label").cast("double")), ["doc_id", "candidate"])
    forest = train(known)
    if forest is None:
        scored = found.withColumn("score", F.lit(0.5))
    else:
        scored = forest.transform(found.withColumn("x", array_to_vector("features"))).withColumn("score", vector_to_array("p")[1])
    return scored.select("doc_id", "start", "candidate", "score", (F.col("score") > least).alias("is_secret"))
