"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time 0..1. Its integral is the source's weight, which fixes the tokens
the source owes the mix; the shape says when. A document's place in its source's token stream is turned into a training
position by inverting the source's cumulative demand, and the output is range-sorted by that position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attest.llm.common import materialized, spare, word_count

#: Relative demand of a source in each phase of training, by the source's rank; every row has mean 1.
PHASES = ((1.5, 1.25, 0.75, 0.5), (0.5, 0.75, 1.25, 1.5), (1.0, 1.0, 1.0, 1.0))


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: source, source_size, rank, weight, target.

    sizes: (source, source_size). Sources by code point, null last, weigh ``weights`` in turn. They share ``share`` of
    all tokens by weight; none gets above ``most`` times its size and what is cut goes to the others by weight
    (water-filling: sources fill up in the order of limit / weight, so running sums over that order give the level).
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    every = W.partitionBy(F.lit(0))
    fill = every.orderBy("full_at", "rank")
    cap = F.col("source_size") * F.lit(float(most))
    ranked = (
        sizes.withColumn("rank", rank)
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
        .withColumn("cap", cap)
        .withColumn("full_at", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("capped_before", F.coalesce(F.sum("cap").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(fill.rowsBetween(0, W.unboundedFollowing)))
        # the level that would hold if all sources before this one were full and this one not
        .withColumn("level", (F.col("total") - F.col("capped_before")) / F.col("weight_left"))
        .withColumn("fits", F.col("level") <= F.col("full_at"))
    )
    first = F.min(F.when(F.col("fits"), F.struct("full_at", "rank", "level"))).over(every)
    return ranked.withColumn("first", first).select(
        "source", "source_size", "rank", "weight",
        F.when(F.col("first").isNull(), F.col("cap"))
        .when(F.struct("full_at", "rank") < F.struct("first.full_at", "first.rank"), F.col("cap"))
        .otherwise(F.least(F.col("weight") * F.col("first.level"), F.col("cap"))).alias("target"),
    )


def _position(done: Column, rank: Column, phases: Sequence[Sequence[float]] = PHASES) -> Column:
    """The training time at which the share ``done`` of a source's demand is met: the inverse of its cumulative schedule."""
    out = None
    for kind, shape in enumerate(phases):
        step, total, inverse = 1.0 / len(shape), sum(shape), F.lit(1.0)
        knots = [sum(shape[:i]) / total for i in range(len(shape) + 1)]
        for i in reversed(range(len(shape))):
            inside = F.lit(i * step) + (done - F.lit(knots[i])) * F.lit(step / (knots[i + 1] - knots[i]))
            inverse = F.when(done < F.lit(knots[i + 1]), inside).otherwise(inverse)
        out = inverse if out is None else F.when(rank % len(phases) == kind, inverse).otherwise(out)
    return out


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, bucket_digits: int = 3, keep: Sequence[str] = (), ordered: bool = True) -> DataFrame:
    """doc_id, size, source_size, target, taken, position, again, source and the columns ``keep``: one row per document, sorted by position (unless not ordered).

    size counts the words of the whole text (null: 0). A source is read in the order of md5(doc_id), from the start
    again after its end, until its target is met; taken counts the words so read (the last document may be cut). position
    is the training time of the first reading and again that of the second; both are null where there is none. Documents
    without words take nothing. Null sources form one source. Rows with the same doc_id are told apart by size and else
    interchangeable. An empty table gives no rows. Other columns are ignored; those kept go through two shuffles, and
    names of the result's own columns can't be kept. See readings() for a row each time a document is read.

    Running sums are taken in 16**bucket_digits hash buckets a source, with the buckets' sums added before them, so that
    a source with a third of all rows never meets in one task.
    """
    own = ("doc_id", "size", "source_size", "target", "taken", "position", "again", "source")
    if most > 2 or set(keep) & set(own):
        raise ValueError("a document is read twice at most" if most > 2 else f"not to be kept: {sorted(set(keep) & set(own))}")
    order_key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    kept = [spare(docs, f"{c}_kept") for c in keep]
    sized = docs.select("doc_id", F.col("source"), word_count(F.col("text")).alias("size"), order_key.alias("order_key"), F.substring(order_key, 1, bucket_digits).alias("bucket"), *[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)])
    if not keep:  # else the texts are read again, which is cheaper than to write them
        sized = materialized(sized, "mix-sizes")
    buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, most)
    offsets = (
        buckets.withColumn("before", F.coalesce(F.sum("bucket_size").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before", "source_size", "target", "rank")
    )
    here = W.partitionBy("source", "bucket").orderBy("order_key", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = (
        sized.withColumn("within", F.coalesce(F.sum("size").over(here), F.lit(0)))
        .join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        .withColumn("start", F.col("before") + F.col("within"))
        .withColumn("goal", F.round("target").cast("long"))
    )

    def read(turn: int) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("size"), F.col("goal") - F.col("start") - F.col("source_size") * turn))

    turns = range(int(-(-most // 1)))
    taken = sum((read(t) for t in turns[1:]), read(0))

    def time_of(turn: int) -> Column:
        return F.when(read(turn) > 0, _position((F.col("start") + F.col("source_size") * turn) / F.col("target"), F.col("rank")))

    mixed = placed.select(
        "doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), time_of(0).alias("position"),
        (time_of(1) if most > 1 else F.lit(None).cast("double")).alias("again"), "source", *[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)],
    )
    return mixed.orderBy(F.col("position").asc_nulls_last(), "doc_id") if ordered else mixed


def readings(mixed: DataFrame) -> DataFrame:
    """The training order: a row of mix_sources() for each time a document is read, with reading (0 or 1), words and at (its position), sorted by that.

    Documents that are not read, or whose size is null, have no row; null ids and sources stay, repeated rows are read each
    for itself, ties come by doc_id. Columns that were kept come with each reading; an empty table gives no rows.
    """
    first = F.least("size", "taken")
    times = [F.struct(F.lit(n).alias("reading"), words.cast("long").alias("words"), F.col(at).alias("at")) for n, words, at in ((0, first, "position"), (1, F.col("taken") - first, "again"))]
    rows = mixed.select(*[c for c in mixed.columns if c not in ("position", "again")], F.inline(F.array(*times)))
    return rows.where("words > 0").orderBy("at", "doc_id", "reading")
