"""Merkle dataset manifest: a log of tree nodes in postorder, and proofs whose siblings are found by closed-form positions.

A tree of arity 3 has its leaves at one depth; the last run of a level may be shorter, and is hashed all the same. Nodes
are appended when they are complete: leaf i after i leaves and, on each level l, after i div 3**l nodes, so its position
is the sum of the sizes of the subtrees before it; a node comes its level's number of places after its last leaf. Aligned
builders of 3**BLOCK leaves each write a contiguous piece of the log, and the same builders do so for the blocks' roots.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from attest.llm.common import dense_index, matched, materialized

ARITY = 3
BLOCK = 6  # levels within a builder: 729 leaves
POWERS = [ARITY**k for k in range(1, 40)]
LOG = "tree string, block long, position long, level int, idx long, n long, digest binary, is_top boolean"
PATH = "array<struct<before:string,after:string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def height(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    h = 0
    while ARITY**h < n:
        h += 1
    return h


def position(level: int, idx: int, n: int) -> int:
    """Place in the postorder log of the idx-th node of a level, in a tree of n leaves."""
    last = min((idx + 1) * ARITY**level, n) - 1
    at, below = last + level, last
    while below:
        below //= ARITY
        at += below
    return at


def digest_of(parts: list[str]) -> bytes:
    return hashlib.sha256("".join(parts).encode()).digest()


def leaf_digest(values: list[Column]) -> Column:
    """SHA-256 (hex) of the values in order, each as its UTF-8 length, a colon and itself; null: a hyphen."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


@dataclass
class Manifest:
    """leaves: tree, idx, n, digest and what else their table had. log: LOG, all levels. trees: tree, n, subroot, idx (its place among the trees), crown (the path from its subroot to the root)."""

    leaves: DataFrame
    log: DataFrame
    trees: DataFrame
    root: str | None


def _builder(base: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Appends the nodes of aligned blocks in the order in which they are complete; the rows are nodes of level base, by tree, block and idx.

    Holds at most two waiting digests a level. Of level base itself only leaves (base 0) are written, as the block below
    has written the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, waiting, levels = [], None, [], 0

        def put(level: int, idx: int, digest: bytes) -> None:
            tree, block, n = now
            if level > base or not base:
                out.append((tree, block, position(level, idx, n), level, idx, n, digest, level == height(n)))

        def add(level: int, idx: int, digest: bytes) -> None:
            put(level, idx, digest)
            waiting[level - base].append(digest)
            while level - base < levels and len(waiting[level - base]) == ARITY:
                level, idx = level + 1, idx // ARITY
                raised(level, idx)

        def raised(level: int, idx: int) -> None:
            below = waiting[level - 1 - base]
            digest = digest_of([d.hex() for d in below])
            below.clear()
            put(level, idx, digest)
            waiting[level - base].append(digest)

        def close(last: int) -> None:
            for level in range(base + 1, base + levels + 1):
                if waiting[level - 1 - base]:
                    raised(level, last // ARITY ** (level - base))

        def flushed() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
            names = ["tree", "block", "position", "level", "idx", "n", "digest", "is_top"]
            made = pa.record_batch([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=names)
            out.clear()
            return made

        idx = 0
        for b in batches:
            for tree, block, i, n, digest in zip(*(b.column(c).to_pylist() for c in ("tree", "block", "idx", "n", "digest")), strict=True):
                if (tree, block, n) != now:
                    if now:
                        close(idx)
                    now, levels = (tree, block, n), min(BLOCK, height(n) - base)
                    waiting = [[] for _ in range(levels + 1)]
                add(base, i, digest)
                idx = i
            if out:
                yield flushed()
        if now:
            close(idx)
        yield flushed()

    return run


def append_log(leaves: DataFrame) -> DataFrame:
    """The log (LOG) of all trees of leaves (tree, idx, n, digest), written level by level of builders.

    block is the number of the aligned block of leaves (or of block roots) in whose builder a node was complete.
    """
    top = leaves.agg(F.max("n")).first()[0] or 0
    rows, log = leaves.select("tree", "idx", "n", "digest"), None
    for base in range(0, max(1, height(top)), BLOCK):
        dealt = rows.withColumn("block", F.expr(f"idx div {ARITY**BLOCK}")).repartition("tree", "block").sortWithinPartitions("tree", "block", "idx")
        made = materialized(dealt.mapInArrow(_builder(base), LOG), "merkle-log")
        log = made if log is None else log.unionByName(made)
        rows = made.where((F.col("level") == base + BLOCK) & ~F.col("is_top")).select("tree", "idx", "n", "digest")
    return log


def _places(level: str, idx: str, n: str) -> Column:
    """position() as a column."""
    last = f"(least(({idx} + 1) * cast(pow({ARITY}, {level}) as bigint), {n}) - 1)"
    return F.expr(f"aggregate(array({', '.join(f'{p}L' for p in POWERS)}), {last}, (a, p) -> a + {last} div p) + {level}")


def _height(n: Column) -> Column:
    return F.size(F.filter(F.array(*[F.lit(p) for p in [1, *POWERS]]), lambda p: p < n))


def _above(log: DataFrame) -> DataFrame:
    """(tree, block, n, above): for each block of leaves the siblings on its way to the subroot, fetched from the log by position; above: array of (level, idx, digest)."""
    blocks = log.where((F.col("level") == 0) & (F.col("idx") % ARITY**BLOCK == 0)).select("tree", "block", "n")
    steps = blocks.where(_height(F.col("n")) > BLOCK).withColumn("level", F.explode(F.sequence(F.lit(BLOCK), _height(F.col("n")) - 1)))
    steps = steps.withColumn("own", F.expr(f"block div cast(pow({ARITY}, level - {BLOCK}) as bigint)"))
    sought = steps.withColumn("s", F.explode(F.sequence(F.col("own") - F.col("own") % ARITY, F.col("own") - F.col("own") % ARITY + ARITY - 1))).where(f"s <> own AND s * cast(pow({ARITY}, level) as bigint) < n")
    sought = sought.withColumn("position", _places("level", "s", "n")).select("tree", "block", "level", "s", "position")
    upper = log.where(F.col("level") >= BLOCK).select(F.col("tree").alias("in_tree"), F.col("position").alias("at"), "digest")
    met = sought.join(upper, (F.col("position") == F.col("at")) & F.col("tree").eqNullSafe(F.col("in_tree")))
    gathered = met.groupBy("tree", "block").agg(F.collect_list(F.struct("level", F.col("s").alias("idx"), "digest")).alias("above"))  # at most two a level
    return matched(blocks, gathered, ["tree", "block"], "left").select("tree", "block", "n", "above")


def _walk(local: list[str], m: int, idx: int, levels: int) -> list[tuple[str, str]]:
    """(before, after) on each level of a block of m leaves whose nodes are in the order of the log."""
    path = []
    for level in range(levels):
        start, count = idx - idx % ARITY, -(-m // ARITY**level)
        run = [local[position(level, s, m)] for s in range(start, min(start + ARITY, count))]
        path.append(("".join(run[: idx - start]), "".join(run[idx - start + 1 :])))
        idx //= ARITY
    return path


def fold(digest: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings lead to."""
    for before, after in path:
        digest = hashlib.sha256(f"{before}{digest}{after}".encode()).hexdigest()
    return digest


def _extract(kind: pa.DataType, paths: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Proofs of the leaves of each block: its context comes first, then its piece of the log, which is held as a whole (1 093 nodes at most)."""
    names = ("tree", "block", "level", "idx", "n", "digest", "id", "other", "above", "crown", "subroot")
    step = pa.struct([("before", pa.string()), ("after", pa.string())])

    def proven(key: tuple, subroot: str | None, n: int, held: list[tuple], upper: list[tuple[str, str]]) -> pa.RecordBatch:
        tree, block = key
        local, leaves = [x[2].hex() for x in held], [x for x in held if not x[0]]
        levels, first = min(BLOCK, height(n)), block * ARITY**BLOCK
        made = [_walk(local, len(leaves), x[1] - first, levels) + upper for x in leaves]
        columns = {
            "tree": pa.array([tree] * len(leaves), pa.string()), "idx": pa.array([x[1] for x in leaves], pa.int64()), "id": pa.array([x[3] for x in leaves], kind), "leaf": pa.array([x[2].hex() for x in leaves], pa.string()), "subroot": pa.array([subroot] * len(leaves), pa.string()),
            "proof_sha256": pa.array([digest_of([d for pair in path for d in pair]).hex() for path in made], pa.string()), "folded_root": pa.array([fold((x[4] or x[2]).hex(), path) for x, path in zip(leaves, made, strict=True)], pa.string()),
        }
        if paths:
            columns["path"] = pa.array([[{"before": a, "after": b} for a, b in path] for path in made], pa.list_(step))
        return pa.record_batch(list(columns.values()), names=list(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, root, n, upper, held = None, None, 0, [], []
        for b in batches:
            for tree, block, level, idx, leaves, digest, id_, other, above, crown, subroot in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                if (tree, block) != now:
                    if now:
                        yield proven(now, root, n, held, upper)
                    now, root, n, held, upper = (tree, block), subroot, leaves, [], []
                    found = {(x["level"], x["idx"]): x["digest"].hex() for x in above or ()}
                    for up in range(BLOCK, height(n)):
                        own = block // ARITY ** (up - BLOCK)
                        run_ = range(own - own % ARITY, min(own - own % ARITY + ARITY, -(-n // ARITY**up)))
                        upper.append(("".join(found[up, s] for s in run_ if s < own), "".join(found[up, s] for s in run_ if s > own)))
                    upper += [(x["before"], x["after"]) for x in crown or ()]
                else:
                    held.append((level, idx, digest, id_, other))
        if now:
            yield proven(now, root, n, held, upper)

    return run


def proofs(leaves: DataFrame, log: DataFrame, trees: DataFrame | None = None, paths: bool = False) -> DataFrame:
    """tree, idx, id, leaf, subroot, proof_sha256 (of all siblings, level by level), folded_root (from other, where it is not null, else from the leaf); path on request.

    leaves: tree, idx, n, digest, id, other. trees: (tree, crown, subroot), crown being the path on from each tree's
    subroot; without it the trees stand for themselves and subroot is null. A block's leaves, its piece of the log and its context meet in one task, where siblings
    are read off the log by their positions. path: for each level the digests before and after in the run, each joined.
    """
    context = _above(log)
    if trees is None:
        context = context.withColumn("crown", F.lit(None).cast(PATH)).withColumn("subroot", F.lit(None).cast("string"))
    else:
        context = matched(context, trees.select("tree", "crown", "subroot"), ["tree"]).select("tree", "block", "n", "above", "crown", "subroot")
    inner = log.where(F.col("level").between(1, BLOCK)).select("tree", "block", "position", "level", "idx", "n", "digest")
    own = leaves.select("tree", F.expr(f"idx div {ARITY**BLOCK}").alias("block"), _places("0", "idx", "n").alias("position"), F.lit(0).alias("level"), "idx", "n", "digest", "id", "other")
    rows = own.unionByName(inner, allowMissingColumns=True).unionByName(context.withColumn("position", F.lit(-1).cast("long")), allowMissingColumns=True)
    dealt = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "position")
    kind = leaves.schema["id"].dataType
    out = f"tree string, idx long, id {kind.simpleString()}, leaf string, subroot string, proof_sha256 string, folded_root string" + (f", path {PATH}" if paths else "")
    return dealt.select("tree", "block", "level", "idx", "n", "digest", "id", "other", "above", "crown", "subroot").mapInArrow(_extract(to_arrow_type(kind), paths), out)


def build_manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree: str = "source", order: str = "doc_id", other: Column | None = None) -> Manifest:
    """One tree for each value of ``tree`` (as text; null is a value), leaves by ``order`` (null first, ties by leaf), and one tree of their roots by name (null first, bytewise).

    Leaves cover the named fields in their order, whatever other columns there are; repeated rows are leaves of their
    own. other: digest (hex, or null) of what a leaf's row is claimed to be, for proofs(). Whole texts are hashed where
    they are read, only digests are shuffled. An empty table has no trees and no root.
    """
    digest = F.unhex(leaf_digest([docs[c] for c in fields]))
    claimed = F.lit(None).cast("binary") if other is None else F.unhex(other)
    plain = materialized(docs.select(docs[tree].cast("string").alias("tree"), docs[order].alias("id"), digest.alias("digest"), claimed.alias("other")), "leaves")
    leaves = dense_index(plain, ["id", "digest"], ("tree",))
    leaves = materialized(leaves, "leaves")
    log = append_log(leaves)
    tops = log.where("is_top").select("tree", F.col("n").alias("n_leaves"), "digest")
    crown = dense_index(tops, ["tree"]).select(F.lit("").alias("tree"), "idx", "n", "digest", F.col("tree").alias("id"), F.lit(None).cast("binary").alias("other"), "n_leaves")
    crown = materialized(crown, "subroots")
    above = append_log(crown)
    root = above.where("is_top").first()  # one row
    paths = proofs(crown, above, paths=True).select("idx", F.col("id").alias("tree"), F.col("leaf").alias("subroot"), F.col("path").alias("crown"))
    sizes = crown.select(F.col("id").alias("tree"), F.col("n_leaves").alias("n"))
    trees = matched(paths, sizes, ["tree"]).select("tree", "n", "subroot", "idx", "crown")
    return Manifest(leaves, log, materialized(trees, "trees"), root and bytes(root.digest).hex())


def verify(manifest: Manifest, paths: bool = False) -> DataFrame:
    """id, tree, leaf, subroot, root, proof_sha256, folded_root, verified (and path) of every leaf of a manifest."""
    found = proofs(manifest.leaves, manifest.log, manifest.trees, paths).withColumn("root", F.lit(manifest.root))
    return found.select("id", "tree", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), *["path"] * paths)
