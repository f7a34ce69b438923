"""Language identification by rank-order profiles: a text's most frequent letter n-grams against each language's, by out-of-place distance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attest.llm.common import spare

PART = 200_000  # code points that are cut into n-grams at once


@cache
def _symbols() -> np.ndarray:
    """For each code point a symbol of 10 bits: 0 if it is no letter, itself if it is small, else a hash."""
    return np.array([(c if c < 1023 else 1 + c % 1022) if chr(c).isalpha() else 0 for c in range(0x110000)], np.uint32)


def ngrams(text: str) -> np.ndarray:
    """Keys of all 1-, 2- and 3-grams of letters; words are padded with one separator, and nothing goes across it."""
    s = _symbols()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    s = np.concatenate([[0], s, [0]]).astype(np.uint32)
    s = s[np.r_[True, (s[1:] != 0) | (s[:-1] != 0)]]
    a, b = s[:-1], s[1:]
    c, d, e = s[:-2], s[1:-1], s[2:]
    return np.concatenate([s[s > 0] | 2 << 30, (a << 10 | b) | 1 << 30, (c << 20 | d << 10 | e)[d > 0]])


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a whole text and their counts; very long texts are counted part by part (parts end within words at worst)."""
    if len(text) <= PART:
        return np.unique(ngrams(text), return_counts=True)
    parts = [np.unique(ngrams(text[i : i + PART]), return_counts=True) for i in range(0, len(text), PART)]
    return merged(parts)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)


def top(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, in order; ties by key."""
    order = np.sort((counts.max(initial=0) - counts).astype(np.uint64) << np.uint64(32) | keys.astype(np.uint64))[:size]
    return (order & np.uint64(0xFFFFFFFF)).astype(np.uint32)


@dataclass
class Profiles:
    """size n-grams for each language, as ranks over the sorted union of all n-grams."""

    languages: list[str]
    keys: np.ndarray
    ranks: np.ndarray
    size: int

    def predict(self, text: str | None) -> tuple[str, float]:
        keys, counts = counted(text or "")
        letters = keys >= np.uint32(2 << 30)
        if not self.languages or not letters.any():
            return "und", 0.0
        mine = top(keys, counts, self.size)
        at = np.minimum(np.searchsorted(self.keys, mine), len(self.keys) - 1)
        ranks = self.ranks[:, at]  # size where a language doesn't have the n-gram, which then is out of place as far as can be
        held = (self.keys[at] == mine) & (ranks < self.size)
        away = np.where(held, np.abs(ranks - np.arange(len(mine))), self.size).sum(axis=1)
        near = np.exp((away.min() - away) * (30.0 / (len(mine) * self.size)))
        best = int(away.argmin())
        return self.languages[best], float(near[best] / near.sum())


def learn(docs: DataFrame, usable: Column | None = None, size: int = 400) -> Profiles:
    """Profiles from the texts and non-null lang of all usable rows; what reaches the driver is size n-grams a language."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if usable is not None:
        rows = rows.where(usable)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list] = {}
        held = 0
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                found = counted(text.as_py())
                parts.setdefault(lang, []).append(found)
                held += len(found[0])
                if held > 2_000_000:
                    parts = {k: [merged(v)] for k, v in parts.items()}
                    held = sum(len(v[0][0]) for v in parts.values())
                    if held > 1_000_000:
                        yield from rows_of(parts)
                        parts, held = {}, 0
        yield from rows_of(parts)

    def rows_of(parts: dict[str, list]) -> Iterator[pa.RecordBatch]:
        for lang, found in parts.items():
            keys, counts = merged(found)
            yield pa.record_batch([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(counts)], names=["lang", "ngram", "n"])

    counts = rows.select("lang", "text").mapInArrow(count, "lang string, ngram long, n long").groupBy("lang", "ngram").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "ngram")) - 1).where(F.col("rank") < size)
    best = ranked.select("lang", "ngram", "rank").orderBy("lang", "rank").toPandas()
    languages = sorted(set(best["lang"]))
    keys = np.unique(best["ngram"].to_numpy(dtype=np.uint32))
    ranks = np.full((len(languages), len(keys)), size, np.int32)
    ranks[[languages.index(x) for x in best["lang"]], np.searchsorted(keys, best["ngram"].to_numpy(dtype=np.uint32))] = best["rank"]
    return Profiles(languages, keys, ranks, size)


def predict_language(docs: DataFrame, profiles: Profiles, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, lang_pred and score of every row; kept columns of these two names are replaced.

    lang_pred is the language with the smallest out-of-place distance (ties: the first by name), `und` with score 0 if
    the text is null or has no letter, or nothing was learned. score is the language's share of exp(-distance) over all
    languages, distances being scaled by the profile. Work is per row: repeated rows agree; very long texts are counted
    whole; an empty table gives no rows; other columns, such as an own lang, are not looked at.
    """
    keep = tuple(c for c in keep if c not in ("lang_pred", "score"))
    whole = spare(docs, "text_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [profiles.predict(t.as_py()) for t in b.column(whole)]
            yield pa.record_batch([*(b.column(c) for c in keep), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*keep, "lang_pred", "score"])

    cols = docs.select(*keep, F.col("text").alias(whole))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema if f.name != whole), "lang_pred string, score double"])
    return cols.mapInArrow(run, schema)
