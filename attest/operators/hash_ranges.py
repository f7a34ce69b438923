"""Difference of two registries by a tree of XOR digests over hash ranges: only ranges that differ are looked into."""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attest.functions.scalars import hash_of, words_hex, xor_words
from attest.operators.lists import LIST
from attest.operators.sync import list_diff
from attest.sources import layout
from attest.sources.shared import checkpointed, discard, materialized, shuffles_removed

NODE = [*LIST, "prefix"]
WORDS = [f"w{i}" for i in range(8)]
FAN = 16  # a level is a hex digit of the entries' hashes


def _key(*parts: Column | str) -> Column:
    return F.concat_ws("\t", *[F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")) for p in parts])


def write_hash_tree(members: DataFrame, path: str, leaf: int = 64, rows_per_file: int = 1 << 20) -> None:
    """Store members (pubkey, type, np) by list and hash, and the tree over them.

    A node stands for the entries of a list whose hash begins with prefix, and has their number and XOR. Nodes of more
    than leaf entries have children, one for each next hex digit that occurs, as deep as the longest list asks for. Each
    level is summed from the one below, so entries are aggregated once.
    """
    spark = members.sparkSession
    with shuffles_removed(spark):
        rows = materialized(members.select(*LIST, "np").distinct(), "tree-rows", compression="zstd")
    layout.write_sorted(rows, f"{path}/entries", "key", rows_per_file, _key(*LIST, hash_of(F.col("np"))))
    longest = rows.groupBy(*LIST).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    depth = max(0, ceil(log(max(1, longest / leaf), FAN)))
    level = rows.select(*LIST, F.substring(hash_of(F.col("np")), 1, depth).alias("prefix"), F.lit(1).alias("n"), *[w.alias(c) for w, c in zip(xor_words(F.col("np")), WORDS, strict=True)])
    levels: list[DataFrame] = []
    for d in range(depth, -1, -1):
        here = level.withColumn("prefix", F.substring("prefix", 1, d)).groupBy(*NODE).agg(F.sum("n").alias("n"), *[F.bit_xor(w).alias(w) for w in WORDS])
        with shuffles_removed(spark):
            level = materialized(here, "tree-level", compression="zstd")
        levels.append(level.withColumn("level", F.lit(d)))
    kept = [levels[-1]]
    for below, above in zip(levels[:-1], levels[1:], strict=True):
        full = above.where(F.col("n") > leaf).select(*LIST, F.col("prefix").alias("up"))
        kept.append(below.withColumn("up", F.expr("substring(prefix, 1, length(prefix) - 1)")).join(full, [*LIST, "up"], "left_semi").select(*levels[-1].columns))
    nodes = kept[0]
    for k in kept[1:]:
        nodes = nodes.unionByName(k)
    stored = nodes.select(*NODE, "level", "n", words_hex([F.col(w) for w in WORDS]).alias("digest"))
    layout.write_sorted(stored, f"{path}/nodes", "key", rows_per_file, _key(F.format_string("%02d", "level"), *NODE))
    discard(rows, *levels)
    spark.createDataFrame([(leaf, depth)], "leaf int, depth int").coalesce(1).write.parquet(f"{path}/form")


def _children(frontier: DataFrame, level: int) -> DataFrame:
    low = _key(F.lit(f"{level:02d}"), *NODE)
    return frontier.select(low.alias("low"), F.concat(low, F.lit(layout.LAST)).alias("high"))


def differing_ranges(spark: SparkSession, a: str, b: str) -> DataFrame:
    """(pubkey, type, prefix, level): the smallest ranges of the two stored trees that hold all differences.

    Lists are compared by their heads; from there on a level only reads the files with children of nodes that differ.
    """
    forms = [spark.read.parquet(f"{p}/form").first() for p in (a, b)]
    if forms[0].leaf != forms[1].leaf:
        raise ValueError(f"trees of different leaves: {forms[0].leaf} and {forms[1].leaf}")
    leaf, depth = forms[0].leaf, min(f.depth for f in forms)
    top = spark.range(1).select(F.lit("00\t").alias("low"), F.lit(f"00\t{layout.LAST}").alias("high"))
    found, frontier, ranges = [], None, top
    for level in range(depth + 1):
        sides = []
        for path in (a, b):
            rows = layout.read_ranges(spark, f"{path}/nodes", ranges).where(F.col("level") == level)
            if frontier is not None:
                up = F.expr("substring(prefix, 1, length(prefix) - 1)")
                rows = rows.withColumn("up", up).join(frontier.select(*LIST, F.col("prefix").alias("up")), [*LIST, "up"], "left_semi")
            sides.append(rows.select(*NODE, "n", "digest"))
        other = sides[1].withColumnsRenamed({"n": "n_b", "digest": "digest_b"})
        both = sides[0].join(other, NODE, "full").where(~F.col("digest").eqNullSafe(F.col("digest_b")))
        differs = checkpointed(both.select(*NODE, F.least("n", "n_b").alias("least"), (F.col("n").isNull() | F.col("n_b").isNull()).alias("alone")))
        deeper = (F.col("least") > leaf) & ~F.col("alone") & F.lit(level < depth)
        found.append(differs.where(~deeper).select(*NODE, F.lit(level).alias("level")))
        frontier = differs.where(deeper)
        if level == depth or frontier.isEmpty():
            break
        ranges = _children(frontier, level + 1)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def list_diff_by_ranges(spark: SparkSession, a: str, b: str) -> DataFrame:
    """list_diff() of two stored trees: (pubkey, type, np, missing_in), read from the files that hold differing ranges."""
    ranges = checkpointed(differing_ranges(spark, a, b))
    low = _key(*NODE)
    sought = ranges.select(low.alias("low"), F.concat(low, F.lit(layout.LAST)).alias("high"))
    depth = ranges.agg(F.max("level")).first()[0] or 0

    rows = [layout.read_ranges(spark, f"{path}/entries", sought).select(*LIST, "np") for path in (a, b)]
    found = materialized(list_diff(*rows), "tree-found", compression="zstd")  # with what only one side's files hold beside the ranges
    each = F.transform(F.sequence(F.lit(0), F.lit(depth)), lambda d: F.struct(d.alias("level"), hash_of(F.col("np")).substr(F.lit(1), d).alias("prefix")))
    dealt = found.select(*found.columns, F.inline(each))
    return dealt.join(ranges, [*NODE, "level"], "left_semi").select(*found.columns)  # ranges don't overlap: an entry is in one at most
