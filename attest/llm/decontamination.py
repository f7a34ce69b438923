"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages, and these go in blocks. A block's TF-IDF matrix (document frequencies from all
documents) gets a distributed randomised SVD, and its passages and all windows of all documents are compared by cosine in
that latent space; it has a dimension for each passage of the block, so none is lost in it. Windows near a passage are
then held against it word by word: by their longest common subsequence, and for paraphrases by the answer as well.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 16  # words; windows start at its multiples
#: A passage of up to so many words is looked for in windows of so many blocks: one block longer, so one window holds it all.
CLASSES = ((16, 2), (32, 3), (64, 5))
_PLAIN = bytes(ord(" ") if chr(c) in "\x0b\x0c!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\x00" else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words without ASCII punctuation."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def common_subsequence(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        m = places.get(y, 0)
        row = (row + (row & m) | row & ~m) & full
    return len(a) - row.bit_count()


@dataclass
class Passage:
    item: int
    words: list[bytes]
    answer: list[bytes]


def passages_of(item: int, text: str | None, answer: str | None, longest: int = CLASSES[-1][0]) -> list[Passage]:
    words, known = words_of(text), words_of(answer)
    n = -(-len(words) // longest)
    return [Passage(item, words[len(words) * i // n : len(words) * (i + 1) // n], known) for i in range(n)]


def document_frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> tuple[int, dict[bytes, int]]:
    """The number of documents, and of those with each word of a vocabulary of bounded size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for text in b.column("text"):
                seen.update(vocabulary.intersection(words_of(text.as_py())))
                seen[b""] += 1
        yield pa.record_batch([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    found = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # the vocabulary at most
    of = {bytes(r.word): r.n for r in found}
    return of.pop(b"", 0), of


def randomised_svd(spark: SparkSession, rows: list[tuple[list[int], list[float]]], n: int, k: int, power: int = 2, seed: int = 7) -> np.ndarray:
    """The first k right singular vectors (n x k) of a sparse matrix given by rows of (columns, values).

    Range finder with power iterations: each task sums A'A times the current basis over its rows, the small sums meet on
    the driver (n and k are bounded by the block of passages; a task sends the columns that its rows have) and are made
    orthonormal there. With k for all rows the first product already spans them, and no iteration is needed.
    """
    power = power if k < min(len(rows), n) else 0
    k = min(k, len(rows), n)
    basis = np.random.default_rng(seed).standard_normal((n, min(n, k + 10)))
    matrix = spark.createDataFrame([(c, v) for c, v in rows], "cols array<int>, vals array<double>").repartition(4)
    for _ in range(power + 1):
        shared = spark.sparkContext.broadcast(basis)

        def multiply(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total, omega = np.zeros(shared.value.shape), shared.value
            for b in batches:
                for c, v in zip(b.column("cols").to_pylist(), b.column("vals").to_pylist(), strict=True):
                    x = np.array(v)
                    total[c] += np.outer(x, x @ omega[c])
            used = np.flatnonzero(total.any(axis=1))
            yield pa.record_batch([pa.array([used.tobytes()], pa.binary()), pa.array([total[used].tobytes()], pa.binary())], names=["used", "part"])

        total = np.zeros(basis.shape)
        for p in matrix.mapInArrow(multiply, "used binary, part binary").toLocalIterator():
            total[np.frombuffer(p.used, np.int64)] += np.frombuffer(p.part).reshape(-1, basis.shape[1])
        basis, scale, _ = np.linalg.svd(total, full_matrices=False)
        shared.unpersist()
    return basis[:, :k][:, scale[:k] > 1e-9 * scale[0]]


class Block:
    """Some passages in their latent space. Words are named by their places in the vocabulary of the whole Index."""

    def __init__(self, spark: SparkSession, passages: list[Passage], place: dict[bytes, int], idf: np.ndarray, share: np.ndarray, rank: int | None, max_share: float, held: float):
        self.passages = passages
        ids = [[place[w] for w in p.words] for p in passages]
        # Words of more than max_share of all documents say nothing about a passage, unless it has no others.
        rare = sorted({w for p in ids for w in ([w for w in p if share[w] <= max_share] or p)})
        self.row = np.full(len(place), -1, np.int32)
        self.row[rare] = np.arange(len(rare))
        rows, most = [], np.zeros(len(rare))
        for p in ids:
            tf = Counter(self.row[w] for w in p if self.row[w] >= 0)
            rows.append(([int(w) for w in tf], [c * float(idf[rare[w]]) for w, c in tf.items()]))
            most[rows[-1][0]] = np.maximum(most[rows[-1][0]], list(tf.values()))
        basis = randomised_svd(spark, rows, len(rare), rank or len(rows))
        self.vectors = (basis * idf[rare][:, None]).astype(np.float32)  # what a word adds to a window
        latent = np.array([np.array(v) @ basis[c] for c, v in rows])
        lengths = np.maximum(np.linalg.norm(latent, axis=1), 1e-12)
        self.queries = (latent / lengths[:, None]).astype(np.float32)
        #: So much of a passage's own length must be there; a word brings as much to no passage's product as ``gain`` says.
        self.least = (held * lengths).astype(np.float32)
        self.gain = np.zeros(len(place))
        self.gain[rare] = most * idf[rare] ** 2
        exact = basis.shape[1] >= min(len(rows), len(rare))  # a truncated space has no such bound
        sizes = np.array([len(p.words) for p in passages])
        low = 0
        self.classes = []
        for longest, blocks in CLASSES:
            which = np.flatnonzero((sizes > low) & (sizes <= longest))
            self.classes.append((blocks, which, float((held * lengths[which] ** 2).min(initial=np.inf)) * (1 - 1e-6) if exact else 0.0))
            low = longest
        self.rarest = [sorted(set(p.words), key=lambda w: (-idf[place[w]], w))[:4] for p in passages]

    def candidates(self, ids: np.ndarray, n_words: int, least: float) -> Iterator[tuple[int, int, int, float]]:
        """(passage, first word, last word, cosine) of the windows of one text near a passage. ids: its words' places, -1 if unknown."""
        known = np.flatnonzero(ids >= 0)
        known = known[self.row[ids[known]] >= 0]
        if not len(known):
            return
        n = -(-n_words // BLOCK)
        for first in range(0, n, 4096):  # very long texts go in parts; each part's windows reach into the next
            last = min(n, first + 4096 + CLASSES[-1][1])
            at = known[np.searchsorted(known, first * BLOCK) : np.searchsorted(known, last * BLOCK)]
            if not len(at):
                continue
            block = at // BLOCK - first
            mass = np.r_[np.bincount(block, self.gain[ids[at]], last - first), np.zeros(CLASSES[-1][1])]
            begins, use = [], np.zeros(len(mass), bool)
            for blocks, which, bound in self.classes:  # the windows that hold enough of the passages' words to be near one
                width = min(4096, last - first) if last < n else last - first
                sums = sum((mass[k : k + width] for k in range(1, blocks)), mass[:width])
                begins.append(np.flatnonzero((sums >= bound) & (sums > 0)) if len(which) else np.empty(0, np.int64))
                for k in range(blocks):
                    use[begins[-1] + k] = True
            if not use.any():
                continue
            at, block = at[use[block]], block[use[block]]
            z = np.zeros((len(mass), self.vectors.shape[1]), np.float32)
            starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            z[block[starts]] = np.add.reduceat(self.vectors[self.row[ids[at]]], starts, axis=0)
            for (blocks, which, _), begin in zip(self.classes, begins, strict=True):
                if not len(begin):
                    continue
                x = sum((z[begin + k] for k in range(1, blocks)), z[begin])
                cos = x @ self.queries[which].T
                held = cos >= self.least[which]
                cos /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                for i, j in zip(*np.nonzero(held & (cos >= least)), strict=True):
                    start = (first + int(begin[i])) * BLOCK
                    yield int(which[j]), start, min(n_words, start + blocks * BLOCK), float(cos[i, j])


class Index:
    """Some blocks of the benchmark with one vocabulary; built on the driver, sent to every task."""

    def __init__(self, spark: SparkSession, passages: list[Passage], docs: DataFrame, rank: int | None, max_share: float, block: int, held: float):
        n_docs, df = document_frequencies(docs, frozenset(w for p in passages for w in p.words))
        words = sorted({w for p in passages for w in p.words})
        self.place = {w: i for i, w in enumerate(words)}
        counts = np.array([df.get(w, 0) for w in words], float)
        idf = 1 + np.log((1 + n_docs) / (1 + counts))
        self.blocks = [Block(spark, passages[i : i + block], self.place, idf, counts / max(1, n_docs), rank, max_share, held) for i in range(0, len(passages), block)]

    def leaks(self, text: str | None, least: float, sure: float, paraphrase: float) -> dict[int | None, tuple[float, float]]:
        """item -> (share of the passage's words in common order, cosine), for the items that the text holds."""
        words, out = words_of(text), {}
        ids = np.fromiter(map(self.place.get, words, repeat(-1)), np.int32, len(words))
        for block in self.blocks:
            for k, a, b, cos in block.candidates(ids, len(words), least):
                p, window = block.passages[k], words[a:b]
                share = common_subsequence(p.words, window) / len(p.words)
                if share < sure:
                    if share < paraphrase or len(p.words) < 8:
                        continue
                    if p.answer:  # it may stand before or after the question
                        if common_subsequence(p.answer, words[max(0, a - (b - a)) : b + (b - a)]) < len(p.answer):
                            continue
                    elif len(set(window).intersection(block.rarest[k])) < min(3, len(block.rarest[k])):
                        continue
                out[p.item] = max(out.get(p.item, (0.0, 0.0)), (share, cos))
        return out


def indexes(docs: DataFrame, benchmark: DataFrame, rank: int | None, max_share: float, block: int, together: int, held: float = 0.35) -> Iterator[Index]:
    """One Index for each ``together`` blocks of passages, so that what is sent to the tasks is bounded however long the benchmark is."""
    columns = [F.col("item_id"), F.col("text"), F.col("answer").cast("string").alias("answer") if "answer" in benchmark.columns else F.lit(None).cast("string").alias("answer")]
    items = benchmark.select(*columns).orderBy("item_id", "text").toLocalIterator()
    passages = (p for r in items for p in passages_of(r.item_id, r.text, r.answer))
    while part := list(islice(passages, block * together)):
        yield Index(docs.sparkSession, part, docs, rank, max_share, block, held)


def find_leaks(docs: DataFrame, benchmark: DataFrame, least_cosine: float = 0.3, sure: float = 0.8, paraphrase: float = 0.6, rank: int | None = None, max_share: float = 0.1, block: int = 256, together: int = 32) -> DataFrame:
    """doc_id, item_id, lcs_share, cosine: a row for each document and benchmark item whose passage it holds.

    A window is a candidate if its latent vector's cosine with the passage's is at least least_cosine and it covers at
    least 0.35 of the passage's vector. It counts if the longest common subsequence covers ``sure`` of the passage's words;
    from ``paraphrase`` on it counts if the item's answer stands in it or beside it (column answer; without one, three of
    the passage's four rarest words). Passages of fewer than eight words have no paraphrases.

    Documents are read twice, for document frequencies and for the search, whatever the benchmark's length up to
    block * together passages, and twice more for each further so many. rank truncates the latent space; by default it
    is whole, and only then the search leaves out windows that hold too few of the passages' words.

    Null and empty texts hold nothing, items without words are never found, very long texts are searched whole, part by
    part. Items without id are one item, null. Repeated rows and items give one row; without items or documents there are
    none. Other columns are ignored.
    """
    found = None
    for index in indexes(docs, benchmark, rank, max_share, block, together):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(d.as_py(), i, *x) for d, t in zip(b.column("doc_id"), b.column("text"), strict=True) for i, x in shared.value.leaks(t.as_py(), least_cosine, sure, paraphrase).items()]
                yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.float64())], names=["doc_id", "item_id", "lcs_share", "cosine"])

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, item_id long, lcs_share double, cosine double")
        found = part if found is None else found.union(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, lcs_share double, cosine double")
    return found.groupBy("doc_id", "item_id").agg(F.max("lcs_share").alias("lcs_share"), F.max("cosine").alias("cosine"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, least_cosine: float = 0.3, sure: float = 0.8, paraphrase: float = 0.6, rank: int | None = None, max_share: float = 0.1, block: int = 256, together: int = 32) -> DataFrame:
    """docs without the documents that find_leaks finds; decided row by row, so nothing is shuffled.

    Columns are those of docs, whatever their names; repeated rows go or stay alike. Without items every row stays.
    """
    for index in indexes(docs, benchmark, rank, max_share, block, together):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not shared.value.leaks(t.as_py(), least_cosine, sure, paraphrase) for t in b.column("text")], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
