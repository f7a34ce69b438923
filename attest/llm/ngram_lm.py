"""Language-model scoring with a weighted backoff automaton.

States are contexts: nothing (the root), a word, or two words. A kept n-gram is an arc from the context of its words but
the last; where a state has no arc for a word, its failure arc leads to the context without its first word, at the
state's backoff weight. An n-gram (and the state that it leads to) is named by a hash.

A block of texts is read once, turned into numbers of words, and holds the part of the automaton that its texts can meet.
It asks for the counts of its words and n-grams in all training texts, by key ranges, in packed rows. These give it
its arcs, and so the way of each text; what it lacks are the weights of the failure arcs on the way. So the blocks
add up what leaves each state (each arc by one block), and get the sums for the states that they ask for.

The model can also be made as a table: arcs() makes it of complete counts, mark_repeated() rules out beforehand most
n-grams that occur once, and fetch_arcs() looks arcs up. score_texts() needs no such table.

Probabilities: the unigram (c + 1) / (N + V + 1), and above it absolute discounting with backoff weights that make every
context's distribution over the V + 1 words sum to one. All n-grams with at least two occurrences count, so what is
learned grows with the corpus.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from math import log10

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.llm.common import discard, materialized, shuffles_removed

END = b""  # the end token; no word is empty
FLUSH = 400_000  # distinct keys that a task holds before it emits them


def tokens(text: bytes | None) -> list[bytes]:
    found = (text or b"").lower().split()
    found.append(END)
    return found


def _emitted(seen: dict, key: pa.DataType, names: list[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(seen), key), pa.array(list(seen.values()), pa.int64())], names=names)


def count_words(texts: DataFrame) -> DataFrame:
    """word (binary), c: complete counts of the tokens of a column text (binary); the end token is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for text in b.column("text"):
                seen.update(tokens(text.as_py()))
                if len(seen) > FLUSH:
                    yield _emitted(seen, pa.binary(), ["word", "n"])
                    seen = Counter()
        yield _emitted(seen, pa.binary(), ["word", "n"])

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
START = np.uint64(0x9E3779B97F4A7C15)  # stands for the start of a text
HELD = 2_000_000  # n-grams that a task holds before it emits their counts
BLOCK = 12_000_000  # bytes of text in a block, unless one text has more
BUCKET = 2_000_000  # n-grams of the training texts whose keys are in the range of one bucket
ARC = "key long, known long, base double, logp double, back double"


def _joined(a: np.ndarray, b: np.ndarray, order: int) -> np.ndarray:
    """64-bit key of the n-gram with these parts: two words, or the keys of two bigrams that overlap."""
    x = (a ^ (a >> np.uint64(31))) * _MIX[0] + np.uint64(order)
    x = ((x ^ (x >> np.uint64(29))) + b) * _MIX[1]
    return x ^ (x >> np.uint64(32))


def _word_keys(words: list[bytes]) -> np.ndarray:
    different = dict.fromkeys(words)
    out = np.empty(len(different), object)
    out[:] = list(different)
    key = dict(zip(different, pd.util.hash_array(out).tolist(), strict=True))
    return np.fromiter(map(key.__getitem__, words), np.uint64, len(words))


def _runs(texts: list[bytes | None], allowed: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Keys of all tokens, the text of each, and for orders 2 and 3: parts a and b of all n-grams and the text of each."""
    flat: list[bytes] = []
    sizes = np.empty(len(texts), np.int64)
    for i, text in enumerate(texts):
        found = tokens(text)
        sizes[i] = len(found)
        flat += found
    words, of = _word_keys(flat), np.repeat(np.arange(len(texts)), sizes)
    run = np.empty(len(words) + len(texts), np.uint64)
    at = np.zeros(len(run), bool)
    at[np.cumsum(sizes + 1) - sizes - 1] = True
    run[at], run[~at] = START, words
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    good = np.ones(len(run), bool) if allowed is None else np.isin(run, allowed) | at
    two = good[:-1] & good[1:] & ~at[1:]
    pairs = _joined(run[:-1], run[1:], 2)
    three = two[:-1] & two[1:]
    return words, of, [(run[:-1][two], run[1:][two], owner[1:][two]), (pairs[:-1][three], pairs[1:][three], owner[2:][three])]


def _parts(batch: pa.RecordBatch, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many bytes of text; a longer text is a slice of its own."""
    texts, first, held = batch.column("text"), 0, 0
    for i, size in enumerate(pc.binary_length(texts).to_pylist()):
        if held and held + (size or 0) > most:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += size or 0
    if first < len(texts):
        yield batch.slice(first)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Number and rows of each block of a task whose rows have its number in a column part."""
    number = 0
    for batch in batches:
        for part in _parts(batch, BLOCK):
            yield (part.column("part")[0].as_py() << 33) + number, part
            number += 1


def _groups(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int, pa.Table]]:
    """Rows of each value of a column, which come one value after the other."""
    now, held = None, []
    for batch in batches:
        numbers = np.asarray(batch.column(by))
        edges = np.flatnonzero(np.diff(numbers)) + 1
        for a, b in zip([0, *edges], [*edges, len(numbers)], strict=True):
            if held and numbers[a] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            if b > a:
                now = numbers[a]
                held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def _planes(numbers: np.ndarray, width: int) -> bytes:
    """Numbers byte by byte: the leading bytes, mostly zeros, stand together."""
    return np.ascontiguousarray(numbers, f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def _from_planes(data: bytes, width: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel()


def _packed(ascending: np.ndarray, width: int) -> bytes:
    """Differences of ascending numbers, as so many bytes each."""
    return _planes(np.diff(ascending, prepend=np.uint64(0)), width)


def _unpacked(data: bytes, width: int) -> np.ndarray:
    return _from_planes(data, width).cumsum(dtype=np.uint64)


def _flags(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)


def _depth(ngrams: int, most: int) -> int:
    """Bits of the number of a bucket of keys: about ``most`` n-grams meet in one."""
    return (ngrams // most).bit_length()


def _edges(ascending: np.ndarray, depth: int, inner: int) -> Iterator[tuple[int, int, int]]:
    """Bucket, first and last + 1 of the numbers in each bucket that has any; a bucket's number is above the inner bits."""
    if depth == 0:
        yield from [(0, 0, len(ascending))] if len(ascending) else []
        return
    edges = np.searchsorted(ascending, np.arange(1, 1 << depth, dtype=np.uint64) << np.uint64(inner))
    for bucket, (a, b) in enumerate(zip([0, *edges.tolist()], [*edges.tolist(), len(ascending)], strict=True)):
        if b > a:
            yield bucket, a, b


def mark_repeated(texts: DataFrame, order: int, n: int, spare_bits: int = 7, most: int = BUCKET) -> DataFrame:
    """block, doc_id, train, text (binary) and hits, written once, of rows part, doc_id, train, text.

    hits has a bit for each bigram of a text, and then for each trigram: 1 if its fingerprint occurs twice or more where
    train holds. So it is 1 for all that do, and by chance for about one of 2^spare_bits others. A block sends its
    different fingerprints in ascending order to buckets of about ``most`` of them, as ranges, and the buckets answer with
    a bit for each. n is the number of training tokens.
    """
    ngrams, depth = max(2, (order - 1) * n), _depth((order - 1) * n, most)
    bits = max(depth + 1, min(depth + 32, ngrams.bit_length() + spare_bits))
    shift, inner = np.uint64(64 - bits), np.uint64(bits - depth)
    kind = texts.schema["doc_id"].dataType.simpleString()

    def prints(found: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(_joined(a, b, o) >> shift, owner) for o, (a, b, owner) in enumerate(_runs(found, None)[2], 2) if o <= order]

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, part in _blocks(batches):
            train = part.column("train").to_numpy(zero_copy_only=False).astype(np.uint64)
            every = np.sort(np.concatenate([(x << np.uint64(1)) | train[owner] for x, owner in prints(part.column("text").to_pylist())]))
            value = every >> np.uint64(1)
            first = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
            times, value = np.add.reduceat((every & np.uint64(1)).astype(np.int64), first), value[first]
            for bucket, a, b in _edges(value, depth, bits - depth):
                low = value[a:b] - (np.uint64(bucket) << inner)
                row = {"bucket": bucket, "block": block, "n": b - a, "prints": _packed(low, 4), "once": np.packbits(times[a:b] > 0).tobytes(), "twice": np.packbits(times[a:b] > 1).tobytes()}
                yield pa.RecordBatch.from_pylist([row], pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("prints", pa.binary()), ("once", pa.binary()), ("twice", pa.binary())]))

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _groups(batches, "bucket"):
            rows = rows.to_pylist()
            lows = [_unpacked(r["prints"], 4) for r in rows]
            once = [low[_flags(r["once"], r["n"])] for low, r in zip(lows, rows, strict=True)]
            twice = [low[_flags(r["twice"], r["n"])] for low, r in zip(lows, rows, strict=True)]
            every = np.sort(np.concatenate([*once, *twice]))
            again = np.append(every[1:][every[1:] == every[:-1]], np.uint64(1) << np.uint64(63))  # ascending; the last one is none
            for low, r in zip(lows, rows, strict=True):
                hit = np.packbits(again[np.searchsorted(again, low)] == low).tobytes()
                yield pa.RecordBatch.from_pylist([{"block": r["block"], "bucket": int(bucket), "n": r["n"], "hits": hit}], pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("n", pa.int32()), ("hits", pa.binary())]))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, part in _blocks(batches):
            yield pa.record_batch([pa.array(np.full(part.num_rows, block)), *(part.column(c) for c in ("doc_id", "train", "text"))], names=["block", "doc_id", "train", "text"])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, "block"):
            is_text = pc.is_null(rows.column("bucket"))
            answers, rows = rows.filter(pc.invert(is_text)), rows.filter(is_text).combine_chunks()
            hits = np.concatenate([_flags(h, k) for h, k in zip(answers.column("hits").to_pylist(), answers.column("n").to_pylist(), strict=True)])
            found = prints(rows.column("text").to_pylist())
            every = np.concatenate([x for x, _ in found])
            ranked = np.argsort(every)
            value = every[ranked]
            place = np.cumsum(np.append(False, value[1:] != value[:-1]))
            if place[-1] + 1 != len(hits):
                raise RuntimeError("the documents changed while they were read")
            every = np.empty(len(every), bool)
            every[ranked] = hits[place]
            ends, first = [], 0
            for x, owner in found:
                ends.append((every[first : first + len(x)], np.cumsum(np.bincount(owner, minlength=len(rows)))))
                first += len(x)
            own = [np.packbits(np.concatenate([h[(e[i - 1] if i else 0) : e[i]] for h, e in ends])).tobytes() for i in range(len(rows))]
            out = rows.select(["block", "doc_id", "train", "text"]).append_column("hits", pa.array(own, pa.binary()))
            yield from out.combine_chunks().to_batches()

    asked = texts.mapInArrow(sent, "bucket int, block long, n int, prints binary, once binary, twice binary").repartition("bucket").sortWithinPartitions("bucket")
    answers = asked.mapInArrow(answered, "block long, bucket int, n int, hits binary")
    columns = f"block long, doc_id {kind}, train boolean, text binary"
    rows = texts.mapInArrow(dealt, columns).unionByName(answers, allowMissingColumns=True)
    return materialized(rows.repartition("block").sortWithinPartitions("block", "bucket").mapInArrow(marked, f"{columns}, hits binary"), "lm-blocks", compression="zstd")


def _grams(part: pa.RecordBatch, order: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Keys of all tokens, and for each order the parts a and b of all n-grams that may be kept (see mark_repeated)."""
    words, of, grams = _runs(part.column("text").to_pylist(), allowed)
    grams = [(a, b) for a, b, _ in grams[: order - 1]]
    if allowed is None and "hits" in part.schema.names:
        flags = [_flags(h, (order - 1) * int(m) - (order - 2)) for h, m in zip(part.column("hits").to_pylist(), np.bincount(of, minlength=part.num_rows), strict=True)]
        two = [f[: (len(f) + order - 2) // (order - 1)] for f in flags]
        masks = [np.concatenate(two), np.concatenate([f[len(t) :] for f, t in zip(flags, two, strict=True)])]
        grams = [(a[m], b[m]) for (a, b), m in zip(grams, masks[: order - 1], strict=True)]
    return words, grams


def count_ngrams(texts: DataFrame, order: int, allowed=None) -> DataFrame:
    """o, a, b, n: complete counts of the n-grams of orders 2 to ``order``, named by their parts (see _joined).

    If texts has hits (see mark_repeated), n-grams that these rule out are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {o: [] for o in range(2, order + 1)}
        total = 0

        def emit() -> Iterator[pa.RecordBatch]:
            for o, parts in held.items():
                if not parts:
                    continue
                a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
                _, first, n = np.unique(_joined(a, b, o), return_index=True, return_counts=True)
                yield pa.record_batch([pa.array(np.full(len(n), o, np.int32)), pa.array(a[first].view(np.int64)), pa.array(b[first].view(np.int64)), pa.array(n.astype(np.int64))], names=["o", "a", "b", "n"])
                parts.clear()

        for batch in batches:
            for part in _parts(batch):
                grams = _grams(part, order, allowed.value if allowed else None)[1]
                for o in held:
                    a, b = grams[o - 2]
                    if len(a):
                        held[o].append((a, b))
                        total += len(a)
                if total > HELD:
                    yield from emit()
                    total = 0
        yield from emit()

    return texts.mapInArrow(run, "o int, a long, b long, n long").groupBy("o", "a", "b").agg(F.sum("n").alias("n"))


def _keyed(grams: DataFrame) -> DataFrame:
    """grams with their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            o, x, y = (b.column(c).to_numpy() for c in ("o", "a", "b"))
            key = np.where(o == 2, _joined(x.view(np.uint64), y.view(np.uint64), 2), _joined(x.view(np.uint64), y.view(np.uint64), 3))
            yield pa.record_batch([*b.columns, pa.array(key.view(np.int64))], names=[*b.schema.names, "key"])

    return grams.mapInArrow(run, "o int, a long, b long, n long, key long")


def arcs(texts: DataFrame, counts: DataFrame, n: int, v: int, head_share: float, share: float, least: int, order: int, discount: float) -> DataFrame:
    """n and ARC of every arc: words from the root, kept bigrams from words, kept trigrams from bigrams.

    logp is the arc's log10 probability. back is the weight of the failure arc of the state that it leads to, 0 if nothing
    was kept after it. known and base are those of words. The start of a text is a state like a word.
    """
    spark = texts.sparkSession

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([pa.array(_word_keys(b.column("word").to_pylist()).view(np.int64)), b.column("c")], names=["key", "c"])

    words = counts.mapInArrow(hashed, "key long, c long")
    allowed = None
    if head_share > 0:
        rows = words.where(F.col("c") >= head_share * n).select("key").toPandas()  # at most 1 / head_share rows
        allowed = spark.sparkContext.broadcast(rows["key"].to_numpy(np.int64).view(np.uint64))
    begin = F.lit(int(START.astype(np.int64)))
    start = counts.where(F.col("word") == F.lit(END)).select(begin.alias("key"), "c")  # every text has one end, and so one start
    seen = materialized(words.unionByName(start), "lm-keys")
    kept = materialized(_keyed(count_ngrams(texts, order, allowed).where(F.col("n") >= max(least, share * n))), "lm-ngrams")
    p1 = (F.col("cb") + 1) / F.lit(float(n + v + 1))
    two = kept.where("o = 2").join(seen.select(F.col("key").alias("a"), F.col("c").alias("ca")), "a").join(seen.select(F.col("key").alias("b"), F.col("c").alias("cb")), "b")
    two = materialized(two.select("key", "a", "n", ((F.col("n") - discount) / F.col("ca")).alias("p"), p1.alias("lower")), "lm-bigrams")
    of = lambda c: two.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("p").alias(f"p{c}"))
    three = kept.where("o = 3").join(of("a"), "a").join(of("b"), "b")
    three = materialized(three.select("key", "a", "n", ((F.col("n") - discount) / F.col("na")).alias("p"), F.col("pb").alias("lower")), "lm-trigrams")
    left = lambda c: F.greatest(F.lit(1e-12), F.lit(1.0) - F.sum(c))
    back = {o: g.groupBy(F.col("a").alias("key")).agg(F.log10(left("p") / left("lower")).alias("back")) for o, g in ((2, two), (3, three))}
    weight = F.coalesce("back", F.lit(0.0)).alias("back")
    base = F.when(F.col("key") == begin, 0.0).otherwise(F.log10((F.col("c") + 1) / F.lit(float(n + v + 1)))).alias("base")
    none = [F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), F.log10("p").alias("logp")]
    first = seen.join(back[2], "key", "left").select("key", F.col("c").alias("n"), (F.col("key") != begin).cast("long").alias("known"), base, base.alias("logp"), weight)
    second = two.join(back[3], "key", "left").select("key", "n", *none, weight)
    found = materialized(first.unionByName(second).unionByName(three.select("key", "n", *none, F.lit(0.0).alias("back"))), "lm-arcs", compression="zstd")
    discard(seen, kept, two, three)
    return found


def followed(first: np.ndarray, one: np.ndarray, two: np.ndarray, three: np.ndarray, order: int, begin: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the automaton does at each token: the order of the arc it takes (0: an unknown word, from the root), and whether
    it first leaves a state of two words, and one of a word, by their failure arcs.

    one, two and three say whether the n-grams that end with the token are arcs; first has the places of first tokens, and
    begin says whether the start is a state. Whatever was read, the state after a token is the longest context that is an
    arc, so the state before each token is known without a walk over those before.
    """
    before = np.where(two & (order == 3), 2, one.astype(np.int8))
    before = np.roll(before, 1)
    before[first] = begin
    by3, falls = (before == 2) & three, (before == 2) & ~three
    at_word = falls | (before == 1)
    return np.select([by3, at_word & two, one], [3, 2, 1], 0), falls, at_word & ~two


class Automaton:
    """Arcs that are at hand: those that travel to every task, and those that a block has fetched, each sorted by key. Place -1, no arc, has zeros."""

    def __init__(self, *tables: tuple[np.ndarray, ...]) -> None:
        self.keys = [t[0] for t in tables]
        self.known, self.base, self.logp, self.back = (np.append(np.concatenate([t[i] for t in tables]), 0) for i in range(1, 5))
        self.failed = 0  # failure arcs followed

    def arc(self, key: np.ndarray) -> np.ndarray:
        """The places of arcs by their keys; -1 where there is none."""
        out, before = np.full(len(key), -1), 0
        for keys in self.keys:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = keys[at] == key
                out[hit] = at[hit] + before
            before += len(keys)
        return out

    def walk(self, texts: list[bytes | None], order: int, unknown: float) -> tuple[np.ndarray, ...]:
        """Tokens, known tokens, base score and score of each text."""
        words, of, grams = _runs(texts, None)
        size, sizes = len(texts), np.bincount(of, minlength=len(texts))
        one = self.arc(words.view(np.int64))
        first = np.cumsum(sizes) - sizes
        two, three = np.full(len(words), -1), np.full(len(words), -1)
        two[:] = self.arc(_joined(grams[0][0], grams[0][1], 2).view(np.int64))  # one for each token, with the start before the first
        if order == 3:
            after_first = np.ones(len(words), bool)
            after_first[first] = False
            three[after_first] = self.arc(_joined(grams[1][0], grams[1][1], 3).view(np.int64))
        begin = int(self.arc(np.array([START]).view(np.int64))[0])
        taken, falls, sinks = followed(first, one >= 0, two >= 0, three >= 0, order, begin >= 0)
        self.failed += int(falls.sum() + sinks.sum())
        word, pair = np.roll(one, 1), np.roll(two, 1)  # of the token before
        word[first] = begin
        step = np.select([taken == 3, taken == 2, taken == 1], [self.logp[three], self.logp[two], self.logp[one]], unknown)
        score = np.bincount(of, np.where(falls, self.back[pair], 0.0) + np.where(sinks, self.back[word], 0.0) + step, size)
        hit = one >= 0
        base = np.where(hit, self.base[one], unknown)
        return sizes, np.bincount(of[hit], self.known[one[hit]], size).astype(np.int64), np.bincount(of, base, size), score


def fetch_arcs(asked: DataFrame, table: DataFrame, depth: int) -> DataFrame:
    """block, bucket, arcs: of the keys that blocks ask for, those that are arcs, with what the table says of each.

    A block asks with ascending keys by ranges (bucket, block, keys). Table and questions are dealt by bucket. What is
    returned of a column are its different values, and the place of each arc's value among them.
    """
    columns = ("known", "base", "logp", "back")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = np.asarray(b.column("key")).view(np.uint64)
            bucket = key >> np.uint64(64 - depth) if depth else np.zeros_like(key)
            yield pa.record_batch([pa.array(bucket.astype(np.int32)), *b.columns], names=["bucket", *b.schema.names])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _groups(batches, "bucket"):
            is_arc = pc.is_null(rows.column("block"))
            known = rows.filter(is_arc)
            key = known.column("key").to_numpy().view(np.uint64)
            ranked = np.argsort(key)
            key = np.append(key[ranked], np.uint64(0))  # the last one is none
            values = [known.column(c).to_numpy()[ranked] for c in columns]
            for r in rows.filter(pc.invert(is_arc)).select(["block", "keys"]).to_pylist():
                wanted = _unpacked(r["keys"], 8)
                at = np.searchsorted(key[:-1], wanted)
                hit = (key[at] == wanted) & (at < len(ranked))
                found = [_packed(wanted[hit], 8)]
                for x in values:
                    different, place = np.unique(x[at[hit]], return_inverse=True)
                    found += [different.tobytes(), _planes(place, 4)]
                yield pa.RecordBatch.from_pylist([{"block": r["block"], "bucket": int(bucket), "arcs": found}], pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("arcs", pa.list_(pa.binary()))]))

    rows = table.select("key", *columns).mapInArrow(numbered, "bucket int, key long, known long, base double, logp double, back double")
    rows = rows.unionByName(asked, allowMissingColumns=True).repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(met, "block long, bucket int, arcs array<binary>")


def _arrays(arcs: list[bytes]) -> tuple[np.ndarray, ...]:
    """Keys, known, base, logp and back of an answer of fetch_arcs."""
    values = [np.frombuffer(arcs[i], np.int64 if i == 1 else np.float64) for i in (1, 3, 5, 7)]
    return _unpacked(arcs[0], 8).view(np.int64), *(v[_from_planes(arcs[i], 4)] for v, i in zip(values, (2, 4, 6, 8), strict=True))


def _squeezed(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on, how many they are included."""
    return len(numbers).to_bytes(8, "little") + pa.compress(_planes(numbers, 8), codec="zstd", asbytes=True)


def _released(data: bytes) -> np.ndarray:
    return _from_planes(pa.decompress(data[8:], decompressed_size=8 * int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), 8)


def _differences(ascending: np.ndarray) -> bytes:
    return _squeezed(np.diff(ascending, prepend=np.uint64(0)))


def _sums(data: bytes) -> np.ndarray:
    return _released(data).cumsum(dtype=np.uint64)


def _row(schema: pa.Schema, **values: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([values], schema)


def number_texts(texts: DataFrame) -> DataFrame:
    """Blocks of the rows part, doc_id, train, text, written once, a row each: their texts as numbers of words.

    doc_ids, sizes (tokens) and train of its texts; vocab, the keys of its words and of the start, frequent ones first;
    ids, the place there of each token, with the start before each text; n_train and n_all, tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, part in _blocks(batches):
            place: dict[bytes, int] = {}
            runs, lengths = [], []
            for piece in _parts(part):
                flat: list[bytes] = []
                for text in piece.column("text").to_pylist():
                    found = tokens(text)
                    lengths.append(len(found))
                    flat += found
                for w in dict.fromkeys(flat):
                    place.setdefault(w, len(place))
                runs.append(np.fromiter(map(place.__getitem__, flat), np.int32, len(flat)))
            sizes = np.array(lengths, np.int64)
            words = np.empty(len(place), object)
            words[:] = list(place)
            keys = np.append(pd.util.hash_array(words), START)
            ids = np.full(int(sizes.sum()) + len(sizes), len(place), np.int32)
            ids[~_starts(sizes)] = np.concatenate(runs)
            ranked = np.argsort(-np.bincount(ids, minlength=len(keys)), kind="stable")
            rank = np.empty(len(ranked), np.int32)
            rank[ranked] = np.arange(len(ranked))
            train = part.column("train").to_numpy(zero_copy_only=False)
            doc_ids = part.column("doc_id")
            values = [pa.array([block]), pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids)]
            values += [pa.array([x], pa.binary()) for x in (_squeezed(sizes), np.packbits(train).tobytes(), keys[ranked].tobytes(), _squeezed(rank[ids]))]
            yield pa.record_batch([*values, pa.array([int(sizes[train].sum())]), pa.array([int(sizes.sum())])], names=["block", "doc_ids", "sizes", "train", "vocab", "ids", "n_train", "n_all"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return materialized(texts.mapInArrow(run, f"block long, doc_ids array<{kind}>, sizes binary, train binary, vocab binary, ids binary, n_train long, n_all long"), "lm-blocks")


def _starts(sizes: np.ndarray) -> np.ndarray:
    """Where the starts of texts with so many tokens stand among all tokens and starts."""
    at = np.zeros(int(sizes.sum()) + len(sizes), bool)
    at[np.cumsum(sizes + 1) - sizes - 1] = True
    return at


class _Numbered:
    """A block of number_texts. Arrays over tokens and starts: ids, at (a start), owner (its text), train; places of n-grams' last tokens by order in ``ends``, and the n-grams' keys in ``keys``."""

    def __init__(self, row: dict, order: int) -> None:
        sizes = _released(row["sizes"]).astype(np.int64)
        self.sizes, self.vocab, self.ids = sizes, np.frombuffer(row["vocab"], np.uint64), _released(row["ids"]).astype(np.int32)
        self.at, self.owner = _starts(sizes), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 1)
        self.train = _flags(row["train"], len(sizes))[self.owner]
        run = self.vocab[self.ids]
        pairs = np.empty_like(run)  # that of the token before and this one
        pairs[:1], pairs[1:] = 0, _joined(run[:-1], run[1:], 2)
        self.ends = {2: np.flatnonzero(~self.at)}
        self.keys = {2: pairs[self.ends[2]]}
        if order == 3:
            self.ends[3] = np.flatnonzero(~self.at[1:] & ~self.at[:-1]) + 1
            self.keys[3] = _joined(pairs[self.ends[3] - 1], pairs[self.ends[3]], 3)


def share_counts(blocks: DataFrame, order: int, least: float, depth: int) -> list[DataFrame]:
    """block, bucket, n, kept, ranks, counts, own, v: what the training texts of all blocks have of each block's words and n-grams.

    Written in two turns, for the lower half of the n-grams' keys and for the upper one: the questions are the largest
    thing that is exchanged, and those of the first turn are gone when the second begins.

    A block asks with its different words, and n-grams, by ascending keys in ranges: buckets from 0 for words, from
    2^depth on for n-grams. It says how often they occur in its own training texts, and the bucket adds up. In the same
    order the answer has kept (a bit: the word occurs, the n-gram occurs ``least`` times), and for what is kept its rank
    in the bucket, its count, and own, a bit that is 1 for one block of all that have it. v counts the bucket's words.
    A key is 63 bits of hash.
    """
    shallow = max(0, depth - 2)  # there are fewer words than n-grams
    asks = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("times", pa.binary())])
    replies = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("n", pa.int32()), ("kept", pa.binary()), ("ranks", pa.binary()), ("counts", pa.binary()), ("own", pa.binary()), ("v", pa.int64())])

    def words_of(b: _Numbered) -> tuple[np.ndarray, np.ndarray]:
        ranked = np.argsort(b.vocab)
        return b.vocab[ranked] >> np.uint64(1), np.bincount(b.ids[b.train], minlength=len(b.vocab))[ranked]

    def ngrams_of(b: _Numbered, turn: int) -> tuple[np.ndarray, np.ndarray]:
        every = np.concatenate([k & ~np.uint64(1) | b.train[b.ends[o]] for o, k in b.keys.items()])
        if depth:
            every = every[every >> np.uint64(63) == turn]
        every.sort()
        key = every >> np.uint64(1)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        return key[first], np.add.reduceat(every & np.uint64(1), first) if len(first) else first

    def asked(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = _Numbered(row, order)
                sets = [(*words_of(b), shallow, 0)] if turn == 0 else []
                for keys, times, bits, base in [*sets, (*ngrams_of(b, turn), depth, 1 << depth)]:
                    for bucket, x, y in _edges(keys, bits, 63 - bits):
                        yield _row(asks, bucket=base + bucket, block=row["block"], keys=_differences(keys[x:y] - (np.uint64(bucket) << np.uint64(63 - bits))), times=_squeezed(times[x:y]))

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _groups(batches, "bucket"):
            rows = rows.select(["block", "keys", "times"]).to_pylist()
            keys = [_sums(r.pop("keys")) for r in rows]
            edges = np.cumsum([0, *map(len, keys)])
            every, times = np.concatenate(keys), np.concatenate([_released(r.pop("times")) for r in rows])
            ranked = np.argsort(every)
            value = every[ranked]
            new = np.append(True, value[1:] != value[:-1])
            first = np.flatnonzero(new)
            total = np.add.reduceat(times[ranked], first)
            own, place = np.zeros(len(every), bool), np.empty(len(every), np.int64)
            own[np.minimum.reduceat(ranked, first)] = True  # that of the smallest block: rows come in this order
            place[ranked] = np.cumsum(new) - 1
            is_word = bucket < 1 << depth
            kept = total >= (1 if is_word else least)
            rank = np.cumsum(kept, dtype=np.uint64) - np.uint64(1)
            start = (START >> np.uint64(1)) - (np.uint64(bucket) << np.uint64(63 - shallow)) if is_word and int(START) >> (64 - shallow) == bucket else None
            v = int(kept.sum() - (0 if start is None else kept[value[first] == start].sum())) if is_word else 0
            for r, x, y in zip(rows, edges[:-1], edges[1:], strict=True):
                has = kept[place[x:y]]
                at = place[x:y][has]
                yield _row(replies, block=r["block"], bucket=int(bucket), n=int(y - x), kept=np.packbits(has).tobytes(), ranks=_differences(rank[at]), counts=_squeezed(total[at]), own=np.packbits(own[x:y][has]).tobytes(), v=v)
                v = 0

    out = []
    for turn in range(2 if depth else 1):
        asking = blocks.select("block", "sizes", "train", "vocab", "ids").mapInArrow(lambda batches, turn=turn: asked(batches, turn), "bucket int, block long, keys binary, times binary")
        found = asking.repartition("bucket").sortWithinPartitions("bucket", "block").mapInArrow(answered, "block long, bucket int, n int, kept binary, ranks binary, counts binary, own binary, v long")
        with shuffles_removed(blocks.sparkSession):
            out.append(materialized(found, "lm-counts"))
    return out


def follow_arcs(blocks: DataFrame, answers: list[DataFrame], n: int, head_share: float, order: int, discount: float, depth: int) -> DataFrame:
    """The way of each block's texts through the automaton, a row a block, written once: all weights but those of failure arcs.

    Of its texts: doc_ids, n_tokens, n_known, base and score, where log10(N + V + 1) is still to be taken from base once a
    token, and from score once for each of roots, the arcs taken from the root. fails has how many failure arcs each text
    follows, and states which, as places in the block's list of states. Of these: c and lower, the counts of the context
    and of its last word (0 for a state of one word); asks has their ranks by bucket, and what arcs that this block
    answers for (own) add to the sums of their counts, their number, and the sum of the counts of what they fall back to.
    """
    columns = ("n_tokens array<long>, n_known array<long>, roots array<long>, base array<double>, score array<double>, fails binary, states binary, c binary, lower binary, v long, "
               "asks array<struct<bucket: int, ranks: binary, sums: binary>>")  # fmt: skip
    asks = pa.list_(pa.struct([("bucket", pa.int32()), ("ranks", pa.binary()), ("sums", pa.binary())]))
    binaries = ("fails", "states", "c", "lower")

    def followed_block(row: dict, found: list[dict]) -> tuple[list[np.ndarray], dict]:
        b = _Numbered(row, order)
        # the block's n-grams: some, a place of each, and place, the number of the one at each place
        every = np.concatenate([k >> np.uint64(1) for k in b.keys.values()])
        b.keys.clear()
        order_of = np.argsort(every)
        every = every[order_of]
        new = np.append(True, every[1:] != every[:-1])
        some, place = order_of[new], np.empty(len(every), np.int32)
        place[order_of] = np.cumsum(new, dtype=np.int32) - np.int32(1)
        del every, new, order_of
        # what is known of words and n-grams
        n_words = next((i for i, r in enumerate(found) if r["bucket"] >= 1 << depth), len(found))
        parts = []
        for rows, size in ((found[:n_words], len(b.vocab)), (found[n_words:], None)):
            kept = np.concatenate([_flags(r["kept"], r["n"]) for r in rows])
            if size not in (None, len(kept)):
                raise RuntimeError("a block's questions and answers differ")
            at, held = np.flatnonzero(kept), [_released(r["counts"]) for r in rows]
            out = [np.zeros(len(kept), t) for t in (np.int64, np.int32, bool, np.int32)]
            for o, x in zip(out, (held, [_sums(r["ranks"]) for r in rows], [_flags(r["own"], len(h)) for r, h in zip(rows, held, strict=True)], [np.full(len(h), r["bucket"]) for r, h in zip(rows, held, strict=True)]), strict=True):
                o[at] = np.concatenate(x)
            parts.append(out)
        (c_word, *word), (c_gram, *gram) = parts
        ranked = np.argsort(b.vocab)  # c1 by number
        c1 = np.empty(len(ranked), np.int64)
        c1[ranked] = c_word
        if len(c_gram) != len(some):
            raise RuntimeError("a block's questions and answers differ")
        mine = some[gram[1] & (c_gram > 0)]
        del some
        # the arcs that end at each token
        total, m = len(b.ids), len(b.ends[2])
        one, before, c2, c3, at2 = c1[b.ids], np.roll(c1[b.ids], 1), np.zeros(total, np.int64), np.zeros(total, np.int64), np.zeros(total, np.int32)
        at2[b.ends[2]] = place[:m]
        good = (one >= head_share * n) | b.at
        c2[b.ends[2]] = c_gram[place[:m]]
        c2 *= good & np.roll(good, 1)
        if order == 3:
            c3[b.ends[3]] = c_gram[place[m:]]
            c3 *= (c2 > 0) & (np.roll(c2, 1) > 0)
        del place
        token = b.ends[2]
        first = np.cumsum(b.sizes) - b.sizes
        taken, falls, sinks = followed(first, one[token] > 0, c2[token] > 0, c3[token] > 0, order, bool(before[1] > 0))
        step = np.log10(one[token] + 1.0)
        base = np.bincount(b.owner[token], step, len(b.sizes))
        by = token[taken == 2]
        step[taken == 2] = np.log10((c2[by] - discount) / before[by])
        by = token[taken == 3]
        step[taken == 3] = np.log10((c3[by] - discount) / c2[by - 1])
        per_text = lambda which: np.bincount(b.owner[token[which]], minlength=len(b.sizes))
        # the block's states, in the order of their keys, words before bigrams: by arcs that it answers for, by failure arcs
        two, three = b.ends[2][mine[mine < m]], b.ends[3][mine[mine >= m] - m] if order == 3 else np.zeros(0, np.int64)
        two, three = two[c2[two] > 0], three[c3[three] > 0]
        falls, sinks = token[falls] - 1, token[sinks] - 1
        is_state = [np.zeros(len(c1), bool), np.zeros(len(c_gram), bool)]
        for mask, x, y in ((is_state[0], b.ids[two - 1], b.ids[sinks]), (is_state[1], at2[three - 1], at2[falls])):
            mask[x] = mask[y] = True
        uses = [np.flatnonzero(is_state[0][ranked]), np.flatnonzero(is_state[1])]
        states = len(uses[0]) + len(uses[1])
        number = [np.zeros(len(c1), np.int32), np.zeros(len(c_gram), np.int32)]
        number[0][ranked[uses[0]]] = np.arange(len(uses[0]))
        number[1][uses[1]] = np.arange(len(uses[0]), states)
        leaves = np.concatenate([number[0][b.ids[two - 1]], number[1][at2[three - 1]]])
        added = [np.bincount(leaves, x, states) for x in (np.concatenate([c2[two], c3[three]]), None, np.concatenate([one[two], c2[three]]))]
        added = np.stack(added).astype(np.int64)  # whole numbers, exact up to 2^53
        lower, ends = np.zeros(states, np.int64), token[is_state[1][at2[token]]]
        lower[number[1][at2[ends]]] = one[ends]
        rank, bucket = (np.concatenate([w[u], g[v]]) for (u, v), w, g in zip([uses] * 2, (word[0], word[2]), (gram[0], gram[2]), strict=True))
        edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1), len(bucket)]
        owner = np.concatenate([b.owner[falls], b.owner[sinks]])
        state = np.concatenate([number[1][at2[falls]], number[0][b.ids[sinks]]])
        out = {
            "fails": np.bincount(owner, minlength=len(b.sizes)), "states": state[np.argsort(owner, kind="stable")],
            "c": np.concatenate([c_word[uses[0]], c_gram[uses[1]]]), "lower": lower,
        }
        asked = [{"bucket": int(bucket[x]), "ranks": _differences(rank[x:y].astype(np.uint64)), "sums": _squeezed(added[:, x:y].ravel())} for x, y in zip(edges[:-1], edges[1:], strict=True) if y > x]
        texts = [b.sizes, per_text(one[token] > 0), per_text(taken < 2), base, np.bincount(b.owner[token], step, len(b.sizes))]
        return texts, {c: _squeezed(x) for c, x in out.items()} | {"v": sum(r["v"] for r in found), "asks": asked}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _groups(batches, "block"):
            is_block = pc.is_null(rows.column("bucket"))
            own = rows.filter(is_block).combine_chunks()
            found = rows.filter(pc.invert(is_block)).select(["bucket", "n", "kept", "ranks", "counts", "own", "v"]).to_pylist()
            texts, rest = followed_block(own.select(["sizes", "train", "vocab", "ids"]).to_pylist()[0], found)
            values = [pa.array([int(block)]), own.column("doc_ids").combine_chunks()]
            values += [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in texts]
            values += [*(pa.array([rest[c]], pa.binary()) for c in binaries), pa.array([rest["v"]], pa.int64()), pa.array([rest["asks"]], asks)]
            yield pa.record_batch(values, names=["block", "doc_ids", "n_tokens", "n_known", "roots", "base", "score", *binaries, "v", "asks"])

    rows = blocks.select("block", "doc_ids", "sizes", "train", "vocab", "ids").unionByName(reduce(DataFrame.unionByName, answers), allowMissingColumns=True)
    kind = blocks.schema["doc_ids"].dataType.simpleString()
    with shuffles_removed(blocks.sparkSession):
        return materialized(rows.repartition("block").sortWithinPartitions("block", "bucket").mapInArrow(run, f"block long, doc_ids {kind}, {columns}"), "lm-ways")


def share_sums(asked: DataFrame) -> DataFrame:
    """block, bucket, sums: the sums of all blocks of what each says of its states (see follow_arcs), in the block's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _groups(batches, "bucket"):
            rows = rows.select(["block", "ranks", "sums"]).to_pylist()
            ranks = [_sums(r.pop("ranks")).astype(np.int64) for r in rows]
            total = np.zeros((3, max(int(x[-1]) for x in ranks) + 1), np.int64)
            for r, x in zip(rows, ranks, strict=True):
                total[:, x] += _released(r.pop("sums")).astype(np.int64).reshape(3, -1)
            for r, x in zip(rows, ranks, strict=True):
                yield _row(pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("sums", pa.binary())]), block=r["block"], bucket=int(bucket), sums=_squeezed(total[:, x].ravel()))

    return asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "block long, bucket int, sums binary")


def score_texts(docs: DataFrame, train: Column, head_share: float = 0.0, share: float = 0.0, order: int = 3, discount: float = 0.5, least: int = 2, near: float = 1e-5) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row, learned from the rows where ``train`` holds.

    Whole texts are scored; null and empty ones consist of the end token. Every n-gram with at least ``least``
    occurrences counts, however large the corpus; share and head_share, if given, also ask for a share of all training
    tokens (of an n-gram, of each word in it). A block of texts (some 12 MB, or one longer text) is one row; it asks for the
    counts of its words and n-grams, and then for the sums that its states' backoff weights are made of. near has no
    effect any more (no arcs travel to all tasks); it never changed a result.
    Without training rows every word is unknown. Repeated rows are scored (and learned from) each, an empty table gives
    no rows, other columns are ignored.
    """
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")
    blocks = number_texts(docs.select(F.spark_partition_id().alias("part"), "doc_id", F.coalesce(train, F.lit(False)).alias("train"), text))
    n, n_all = (x or 0 for x in blocks.agg(F.sum("n_train"), F.sum("n_all")).first())
    depth = _depth((order - 1) * n_all, BUCKET)
    answers = share_counts(blocks, order, max(1, least, share * n), depth)
    ways = follow_arcs(blocks, answers, n, head_share, order, discount, depth)
    discard(blocks, *answers)
    v = ways.agg(F.sum("v")).first()[0] or 0
    kind, whole = docs.schema["doc_id"].dataType, float(n + v + 1)

    def weights(c: np.ndarray, lower: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Backoff weights of states: what their arcs leave, over what these leave where the failure arc leads to."""
        of, many, below = sums
        taken = np.where(lower > 0, (below - discount * many) / np.maximum(lower, 1), (below + many) / whole)
        return np.where(many > 0, np.log10(np.maximum(1e-12, 1.0 - (of - discount * many) / np.maximum(c, 1)) / np.maximum(1e-12, 1.0 - taken)), 0.0)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, "block"):
            is_block = pc.is_null(rows.column("bucket"))
            sums = [_released(x).astype(np.int64).reshape(3, -1) for x in rows.filter(pc.invert(is_block)).column("sums").to_pylist()]
            own = rows.filter(is_block)
            fails, states, c, lower = (_released(own.column(x)[0].as_py()).astype(np.int64) for x in ("fails", "states", "c", "lower"))
            back = weights(c, lower, np.concatenate(sums, axis=1)) if sums else np.zeros(0)
            doc_ids, n_tokens, n_known, roots, base, score = (own.column(x).combine_chunks().flatten() for x in ("doc_ids", "n_tokens", "n_known", "roots", "base", "score"))
            score = np.asarray(score) + np.bincount(np.repeat(np.arange(len(fails)), fails), back[states], len(fails)) - np.asarray(roots) * log10(whole)
            base = np.asarray(base) - np.asarray(n_tokens) * log10(whole)
            yield pa.record_batch([doc_ids, n_tokens, n_known, pa.array(base), pa.array(score)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    sums = share_sums(ways.select("block", F.explode("asks").alias("ask")).select("ask.bucket", "block", "ask.ranks", "ask.sums"))
    rows = ways.drop("asks", "v").unionByName(sums, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "bucket")
    out = rows.mapInArrow(scored, f"doc_id {kind.simpleString()}, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
