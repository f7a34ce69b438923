"""Exact top-k search by inner product: vectors in buckets of similar length, pruned by length or by coordinates, then verified.

Vectors are sorted by length and dealt into tiles, these into buckets. A query's score so far, divided by its length and
by the longest length of a bucket, is the cosine that a vector of the bucket has to reach. If that is over 1, the bucket
and all after it are done with; if it is high, only vectors whose coordinates are near enough to the query's largest ones
can reach it; else those that are long enough are taken. What is left is verified by exact products of integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attest.llm.common import dense_index, materialized

BUCKET = 512  # vectors
TILES = 256  # at most so many, of one bucket at least
FOCUS = 3  # coordinates looked at
COORDINATES_FROM = 0.5  # local cosine from which coordinates prune
LEAD = 1024  # vectors that give queries their first threshold: half of them the longest, half spread over all
SLACK = 1e-9  # relative; bounds are floats, and may keep a vector too many but none too few
LIMIT = (1 << 63) - 1
SAFE = float(1 << 53)  # products of floats are exact below


def quantized(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component x as double, as long; null if the vector is null or holds null, NaN or an infinity."""
    wide = lambda x: x.cast("double")
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(wide(x)) & (F.abs(wide(x)) < float("inf")))
    return F.when(usable, F.transform(vector, lambda x: F.floor(wide(x) * scale).cast("long")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of float64, shorter ones filled with zeros."""
    offsets, values = np.asarray(column.offsets), np.asarray(column.values)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), width))
    if len(sizes) and sizes.min() == sizes.max() == width:
        return values[offsets[0] : offsets[-1]].reshape(-1, width).astype(np.float64)
    for i, (a, n) in enumerate(zip(offsets[:-1], sizes, strict=True)):
        out[i, :n] = values[a : a + n]
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows; exact, also where floats are not. Those beyond a long become the largest or smallest one."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if most < SAFE:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in a], dtype=object).reshape(a.shape) @ np.array([[int(x) for x in r] for r in b], dtype=object).reshape(b.shape).T
    return np.array([[max(-LIMIT - 1, min(LIMIT, v)) for v in r] for r in exact], dtype=np.int64).reshape(len(a), len(b))


class Tile:
    """Vectors by descending length, in buckets; each bucket has its coordinates' sorted lists of unit vectors."""

    def __init__(self, vectors: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> None:
        self.vectors, self.rows, self.ids = vectors, rows, ids
        self.lengths = np.sqrt((vectors**2).sum(axis=1))
        self.units = vectors / np.maximum(self.lengths, 1e-300)[:, None]
        self.starts = range(0, len(rows), BUCKET)
        self.lists = {s: np.sort(self.units[s : s + BUCKET], axis=0) for s in self.starts}
        self.used = {"length": 0, "coordinates": 0, "skipped": 0}

    def reaches(self, start: int, unit: np.ndarray, least: float) -> np.ndarray:
        """Places in a bucket whose cosine with a unit query may be least or more, judged by the query's largest coordinates.

        Of two unit vectors with cosine c or more, a coordinate q of one bounds the other's: q c -+ sqrt((1-q^2)(1-c^2)).
        """
        focus = np.argsort(-np.abs(unit))[:FOCUS]
        reach = np.sqrt(np.maximum(0, (1 - unit[focus] ** 2) * (1 - least**2)))
        low, high = unit[focus] * least - reach - SLACK, np.where(np.abs(unit[focus]) >= least, np.where(unit[focus] > 0, 1.0, unit[focus] * least + reach), unit[focus] * least + reach) + SLACK
        low = np.where((np.abs(unit[focus]) >= least) & (unit[focus] < 0), -1.0 - SLACK, low)
        sizes = [np.searchsorted(self.lists[start][:, f], b, "right") - np.searchsorted(self.lists[start][:, f], a, "left") for f, a, b in zip(focus, low, high, strict=True)]
        fewest = int(np.argmin(sizes))
        part = self.units[start : start + BUCKET]
        column = part[:, focus[fewest]]
        at = np.flatnonzero((column >= low[fewest]) & (column <= high[fewest]))
        rest = [i for i in range(len(focus)) if i != fewest]
        ok = np.all((part[at][:, focus[rest]] >= low[rest]) & (part[at][:, focus[rest]] <= high[rest]), axis=1)
        return at[ok]

    def best(self, queries: np.ndarray, own: np.ndarray, least: np.ndarray, k: int) -> list[list[tuple[int, int, int]]]:
        """(score, vec_id, row) of up to k vectors for each query, by descending score and ascending id; least: scores below which nothing counts, where above 0."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in own]
        lengths = np.sqrt((queries**2).sum(axis=1))
        least = np.where(least > 0, least, -np.inf).astype(np.float64)
        open_ = np.arange(len(own))
        for start in self.starts:
            norms = self.lengths[start : start + BUCKET]
            bound = lengths[open_] * norms[0] * (1 + SLACK)
            going = bound >= least[open_]
            self.used["skipped"] += int((~going).sum())
            open_ = open_[going]
            if not len(open_):
                break
            with np.errstate(divide="ignore", invalid="ignore"):
                cosine = np.where(least[open_] > 0, least[open_] / (lengths[open_] * norms[0]), -1.0)
            by_coordinates = (cosine >= COORDINATES_FROM) & (cosine <= 1 + SLACK)
            for q, c in zip(open_[by_coordinates], cosine[by_coordinates], strict=True):
                at = self.reaches(start, queries[q] / lengths[q], min(1.0, c * (1 - SLACK)))
                self.used["coordinates"] += 1
                if len(at):
                    self._take(found, least, np.array([q]), start + at, _products(queries[[q]], self.vectors[start + at]), own, k)
            rest = open_[~by_coordinates]
            if len(rest):
                with np.errstate(divide="ignore", invalid="ignore"):
                    needed = np.where(least[rest] > 0, least[rest] / lengths[rest] * (1 - SLACK), 0.0).min()
                n = int((norms >= needed).sum())
                self.used["length"] += len(rest)
                self._take(found, least, rest, np.arange(start, start + n), _products(queries[rest], self.vectors[start : start + n]), own, k)
        return found

    def _take(self, found: list, least: np.ndarray, queries: np.ndarray, at: np.ndarray, scores: np.ndarray, own: np.ndarray, k: int) -> None:
        """Keeps the k best of what a query had and its new scores; ids are compared where scores are equal."""
        if not len(at):
            return
        ids, rows = self.ids[at], self.rows[at]
        for q, s in zip(queries, scores, strict=True):
            near = np.flatnonzero((s >= least[q]) & (rows != own[q]))
            if len(near) > 4 * k:
                cut = np.partition(s[near], len(near) - k)[len(near) - k]
                near = near[s[near] >= cut]
            if len(near) > k:
                near = near[np.lexsort((ids[near], -s[near]))[:k]]
            if len(near):
                found[q] = sorted([*found[q], *zip(s[near].tolist(), ids[near].tolist(), rows[near].tolist(), strict=True)], key=lambda x: (-x[0], x[1], x[2]))[:k]
                if len(found[q]) == k:
                    least[q] = max(least[q], found[q][-1][0])


def _seeded(lead: DataFrame, k: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds to queries the k-th best score among the lead vectors (at most LEAD); 0 counts where there are fewer than k or it is not above."""
    first = lead.select("idx", "v").toArrow().combine_chunks()
    column = first.column("v").combine_chunks() if first.num_rows else pa.array([], pa.list_(pa.int64()))
    vectors, rows = _matrix(column, width), np.asarray(first.column("idx"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = _products(_matrix(b.column("v"), width), vectors)
            scores[np.asarray(b.column("idx"))[:, None] == rows[None, :]] = -LIMIT - 1
            best = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k] if scores.shape[1] >= k else np.zeros(len(scores), np.int64)
            yield pa.record_batch([b.column("idx"), b.column("vec_id"), b.column("v"), b.column("length"), pa.array(np.maximum(best, 0))], names=["idx", "vec_id", "v", "length", "least"])

    return run


def _searched(k: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A tile's vectors come first and are held, its queries follow and are streamed past them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, parts, built = None, [], None
        for batch in batches:
            tiles = np.asarray(batch.column("tile"))
            edges = np.flatnonzero(np.diff(tiles)) + 1
            for a, b in zip([0, *edges], [*edges, len(tiles)], strict=True):
                piece = batch.slice(a, b - a)
                if tiles[a] != tile:
                    tile, parts, built = tiles[a], [], None
                is_query = np.asarray(piece.column("is_query").to_numpy(zero_copy_only=False))
                m = int((~is_query).sum())
                if m:
                    rows = piece.slice(0, m)
                    parts.append((_matrix(rows.column("v"), width), np.asarray(rows.column("idx")), np.asarray(rows.column("vec_id").fill_null(LIMIT))))
                if m < len(piece):
                    built = built or Tile(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                    asked = piece.slice(m)
                    own, ids = np.asarray(asked.column("idx")), asked.column("vec_id").to_pylist()
                    found = built.best(_matrix(asked.column("v"), width), own, np.asarray(asked.column("least")), k)
                    flat = [(int(own[i]), ids[i], *x) for i, xs in enumerate(found) for x in xs]
                    yield pa.record_batch([pa.array([r[j] for r in flat], pa.int64()) for j in (0, 1, 2, 3, 4)], names=["query", "query_id", "score", "vec_id", "row"])

    return run


def top_products(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query the k vectors, but for its own row, with the largest inner products.

    vectors: vec_id and embedding, other columns are left out. Scores are inner products of floor(scale * x); equal ones
    go by vec_id, where null comes last. Vectors that are null or hold null or non-finite components take no part; a
    shorter vector counts as filled with zeros; scores beyond a long become the largest or smallest one. Rows with one
    vec_id are vectors of their own, and each is a query if is_query (a column over vec_id) says so; a null vec_id is no
    query. With fewer vectors a query has fewer rows, and an empty table gives none.

    Queries are shipped to at most TILES tiles, and only to those whose longest vector can reach the query's first
    threshold. A task holds one tile; every vector is in one and nothing is cut, so the result is exact.
    """
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantized(F.col("embedding"), scale).alias("v")).where("v IS NOT NULL")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    placed = dense_index(materialized(plain.withColumn("length", length), "vectors"), [F.desc("length"), "vec_id"])
    total, width = placed.agg(F.max("n"), F.max(F.size("v"))).first()
    total, width = total or 0, max(1, width or 0)
    size = max(BUCKET, -(-total // TILES))
    placed = materialized(placed.withColumn("tile", F.expr(f"idx div {size}")).drop("n"), "tiles")
    step = max(1, total // (LEAD // 2))
    lead = placed.where((F.col("idx") < LEAD // 2) | ((F.col("idx") % step == 0) & (F.col("idx") < step * (LEAD // 2))))
    asked = placed.where(F.coalesce(is_query, F.lit(False))).select("idx", "vec_id", "v", "length").mapInArrow(_seeded(lead, k, width), "idx long, vec_id long, v array<bigint>, length double, least long")
    asked = materialized(asked, "queries")
    longest = F.broadcast(placed.groupBy("tile").agg(F.max("length").alias("longest")))  # at most TILES rows
    bound = F.col("length") * F.col("longest") * (1 + SLACK)
    sent = asked.join(longest, (F.col("least") <= 0) | (bound >= F.col("least"))).select("tile", F.lit(True).alias("is_query"), "idx", "vec_id", "v", "least")
    held = placed.select("tile", F.lit(False).alias("is_query"), "idx", "vec_id", "v", F.lit(0).cast("long").alias("least"))
    dealt = held.unionByName(sent).repartition("tile").sortWithinPartitions("tile", "is_query", "idx")
    found = dealt.mapInArrow(_searched(k, width), "query long, query_id long, score long, vec_id long, row long")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)  # at most k rows of each tile for a query
    return best.select("query_id", "rank", F.when(F.col("vec_id") != LIMIT, F.col("vec_id")).alias("vec_id"), "score")
