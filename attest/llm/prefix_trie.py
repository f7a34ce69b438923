"""Conversation prefix trie: shards of sorted conversations as balanced parentheses, with shared spines merged.

Conversations are turned into sequences of turn digests and sorted. A shard is a run of different sequences; its trie is
written down as parentheses in preorder. A node's subtree ends at its closing parenthesis, found by the smallest excess of
blocks; pairs () within it are leaves, and sums along the preorder give members and savings. Only the nodes on a shard's
first or last path can go on in a neighbour; what shards count of these is added up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.llm.common import dense_index, materialized

UNIT = 16  # bytes of a turn's digest
SHARD = 256  # different sequences
BITS = 64  # of a block
NODES = "shard long, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"


class Parentheses:
    """A balanced sequence, with the smallest excess of each block of BITS places and of pairs of blocks, pairs of these and so on."""

    def __init__(self, bits: np.ndarray) -> None:
        self.opens, end = np.flatnonzero(bits), np.iinfo(np.int64).max
        self.excess = np.cumsum(bits.astype(np.int64) * 2 - 1)
        self.blocks = np.full((-(-len(bits) // BITS), BITS), end)
        self.blocks.ravel()[: len(bits)] = self.excess
        levels = [self.blocks.min(axis=1)]
        while len(levels[-1]) > 1:
            levels.append(np.append(levels[-1], [end] * (len(levels[-1]) % 2)).reshape(-1, 2).min(axis=1))
        self.begins = np.cumsum([0, *map(len, levels)])[:-1]
        self.least = np.concatenate(levels)
        leaf = (bits[:-1] == 1) & (bits[1:] == 0)
        self.pairs = np.concatenate([[0], np.cumsum(leaf), [leaf.sum()]])  # pairs () that begin before a place

    def _scan(self, block: np.ndarray, column: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The first place of a block, from a column on, with the excess sought; -1 without one."""
        hit = (self.blocks[block] == target[:, None]) & (np.arange(BITS) >= column[:, None])
        return np.where(hit.any(axis=1), block * BITS + hit.argmax(axis=1), -1)

    def _next_block(self, block: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The first block, from the given one on, whose smallest excess is the target or less: up over pairs, then down."""
        node, level, going = block.copy(), np.zeros(len(block), np.int64), np.arange(len(block))
        while len(going):
            going = going[self.least[self.begins[level[going]] + node[going]] > target[going]]
            node[going] += 1
            up = going[node[going] % 2 == 0]
            node[up] //= 2
            level[up] += 1
        while len(down := np.flatnonzero(level)):
            level[down] -= 1
            node[down] *= 2
            node[down] += self.least[self.begins[level[down]] + node[down]] > target[down]
        return node

    def closes(self) -> np.ndarray:
        """For each opening place its closing one: the first after it where the excess is one less."""
        out = np.full(len(self.opens), -1)
        for a in range(0, len(out), 1 << 15):
            first, target = self.opens[a : a + (1 << 15)] + 1, self.excess[self.opens[a : a + (1 << 15)]] - 1
            found = self._scan(first // BITS, first % BITS, target)
            far = np.flatnonzero(found < 0)
            block = self._next_block(first[far] // BITS + 1, target[far])
            found[far] = self._scan(block, np.zeros(len(far), np.int64), target[far])
            out[a : a + (1 << 15)] = found
        return out


def shared_units(a: bytes, b: bytes) -> int:
    """How many turns two sequences have in common from the start."""
    low, high = 0, min(len(a), len(b)) // UNIT
    while low < high:
        mid = (low + high + 1) // 2
        if a[: mid * UNIT] == b[: mid * UNIT]:
            low = mid
        else:
            high = mid - 1
    return low


def _prefix_keys(path: bytes, upto: int) -> list[bytes]:
    """Digests of the prefixes of 0, 1, ... upto turns."""
    state, out = hashlib.sha256(), []
    out.append(state.digest())
    for d in range(upto):
        state.update(path[d * UNIT : (d + 1) * UNIT])
        out.append(state.copy().digest())
    return out


def shard_nodes(shard: int, rows: list[tuple], before: bytes | None, after: bytes | None) -> dict[str, list]:
    """The nodes (NODES, by column) of a shard's sequences.

    rows: (path, bytes of each turn, members, smallest conv_id, ends) in ascending order; before, after: the sequences
    next to the shard. A node that a neighbour has as well gets a key, and counts what is here: members, children and
    bytes only where the node is met first, so that sums over shards are right.
    """
    paths = [r[0] for r in rows]
    sizes = np.array([len(p) // UNIT for p in paths])
    common = np.array([0, *[shared_units(a, b) for a, b in zip(paths, paths[1:])]])
    opened = sizes - common
    opened[0] += 1  # the root
    closed = np.array([0, *[n - c for n, c in zip(sizes, common[1:])], sizes[-1] + 1])
    bits = np.repeat(np.arange(2 * len(rows) + 1) % 2, np.ravel(np.column_stack([closed, [*opened, 0]]))[:-1]).astype(np.uint8)
    tree = Parentheses(bits)
    close = tree.closes()
    m = len(tree.opens)
    depth, subtree = tree.excess[tree.opens] - 1, (close - tree.opens + 1) // 2
    path, at = np.repeat(np.arange(len(rows)), opened), np.arange(m)
    parent, spine, first, starts = at - 1, [0], [], np.cumsum([0, *opened[:-1]])
    for i, (start, n, c) in enumerate(zip(starts.tolist(), opened.tolist(), common.tolist(), strict=True)):
        if i and n:
            parent[start] = spine[c]
        spine[c + (i > 0) :] = range(start, start + n)
        if not i:
            first = list(spine)
    ends_at = np.where(sizes > 0, starts + opened - 1, 0)
    lcp_before = -1 if before is None else shared_units(before, paths[0])
    lcp_after = -1 if after is None else shared_units(paths[-1], after)
    old, shared = np.zeros(m, bool), np.zeros(m, bool)
    old[first[: lcp_before + 1]] = True
    shared[spine[: lcp_after + 1]] = True
    goes_on = lcp_after == sizes[-1]  # the last sequence is continued by the next one, and so is no leaf
    shared |= old
    end = at + subtree
    terminal = np.zeros(m + 1, np.int64)
    np.add.at(terminal, ends_at + 1, 1)
    seen = np.cumsum(terminal)  # sequences that end before a node, in preorder
    members = np.concatenate([[0], np.cumsum([r[2] for r in rows])])
    n_convs = members[seen[end]] - members[seen[at]]
    smallest = np.append(np.array([r[3] for r in rows]), 0)
    conv = np.minimum.reduceat(smallest, np.ravel(np.column_stack([seen[at], seen[end]])))[::2]
    size = np.concatenate([[0], np.concatenate([np.asarray(r[1], np.int64)[c:] for r, c in zip(rows, common, strict=True)])])
    weight = np.concatenate([[0], np.cumsum(n_convs * size - np.where(old, 0, size))])
    children = np.bincount(parent[1:][~old[1:]], minlength=m) if m > 1 else np.zeros(m, np.int64)
    leaves = tree.pairs[close] - tree.pairs[tree.opens]
    if goes_on:
        leaves[spine] -= 1
    ends: list[str | None] = [None] * m
    for i, r in zip(ends_at.tolist(), rows, strict=True):
        ends[i] = r[4]
    keys = {}
    for nodes, source, upto in ((first, paths[0], lcp_before), (spine, paths[-1], lcp_after)):
        if upto >= 0:
            keys |= dict(zip(nodes, _prefix_keys(source, upto), strict=False))
    above = [keys.get(p) if i else None for i, p in enumerate(parent.tolist())]
    return {
        "shard": [shard] * m, "key": [keys.get(i) for i in range(m)], "parent_key": above, "conv_id": conv.tolist(), "depth": depth.tolist(), "parent_conv_id": [None if not i or above[i] else int(conv[p]) for i, p in enumerate(parent.tolist())],
        "n_convs": n_convs.tolist(), "n_children": children.tolist(), "n_leaves": leaves.tolist(), "saved_tokens": (weight[end] - weight[at]).tolist(), "ends": ends,
    }


def _sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One shard after the other: SHARD sequences and the two next to them are held at once."""
    kinds = {"key": pa.binary(), "parent_key": pa.binary(), "ends": pa.string()}
    now, rows, sides = None, [], {}

    def made() -> pa.RecordBatch:
        found = shard_nodes(now, rows, sides.get(-1), sides.get(1))
        return pa.record_batch([pa.array(v, kinds.get(c, pa.int64())) for c, v in found.items()], names=list(found))

    for b in batches:
        for shard, side, *row in zip(*(b.column(c).to_pylist() for c in ("shard", "side", "path", "bytes", "members", "smallest", "ends")), strict=True):
            if shard != now:
                if now is not None:
                    yield made()
                now, rows, sides = shard, [], {}
            if side:
                sides[side] = row[0]
            else:
                rows.append(row)
    if now is not None:
        yield made()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each pid, joined by commas; they come in order, one is held at once."""
    now, state = None, None
    for b in batches:
        done = []
        for pid, text in zip(b.column("pid").to_pylist(), b.column("text").to_pylist(), strict=True):
            if pid != now:
                if now is not None:
                    done.append((now, state.hexdigest()))
                now, state = pid, hashlib.sha256(text.encode())
            else:
                state.update(f",{text}".encode())
        yield pa.record_batch([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["pid", "ends"])
    if now is not None:
        yield pa.record_batch([pa.array([now], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["pid", "ends"])


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """conv_id and turns, an array of (turn, digest, bytes) by turn (null first, ties by digest): texts are hashed where they are read.

    Rows without conv_id are left out; null role or text becomes empty.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * UNIT)
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(sequences: DataFrame, head: Column, family: int = 5, most: int = 8) -> DataFrame:
    """conv_id, path (the turns' digests) and bytes of conversations that start with the first ``head`` turns of conversation c - c % family, and go on with their own turns after as many.

    head: a column over conv_id, at most ``most``. Where there is no such conversation the start is missing.
    """
    n = F.col("conv_id")
    targets = F.filter(F.transform(F.sequence(F.lit(1 - family), F.lit(family - 1)), lambda k: n + k), lambda c: c - c % family == n)
    starts = sequences.where(n % family == 0).select(F.explode(targets).alias("conv_id"), F.slice("turns", 1, most).alias("start"))
    joined = sequences.join(starts, "conv_id", "left").withColumn("h", head.cast("int"))
    start = F.slice(F.coalesce("start", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    seq = F.concat(start, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1))))
    return joined.select("conv_id", F.unhex(F.array_join(F.transform(seq, lambda t: t["digest"]), "")).alias("path"), F.transform(seq, lambda t: t["bytes"]).alias("bytes"))


def trie_nodes(sequences: DataFrame) -> DataFrame:
    """The nodes of the trie of sequences (conv_id, path, bytes), each conv_id once.

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (over the subtree,
    members but one times the bytes of the last turn), ends_sha256 (of the members that end there, ascending, joined by
    commas). Without sequences there are no nodes.

    Equal sequences are one row with a count, so copies never meet; sequences of any one beginning are spread over
    shards. A conversation's digests (16 bytes a turn, not its texts) are held at once. The members that end at a node
    are joined in pieces of 4 096 ids, which are hashed one after the other, as a digest has to be.
    """
    plain = materialized(sequences.select("conv_id", "path", "bytes").withColumn("pid", F.unhex(F.sha2("path", 256))), "sequences")
    pieces = plain.groupBy("pid", F.shiftright("conv_id", 12).alias("piece")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("text"))
    ends = pieces.repartition("pid").sortWithinPartitions("pid", "piece").select("pid", "text").mapInArrow(_hashed, "pid binary, ends string")
    distinct = plain.groupBy("pid", "path", "bytes").agg(F.count("*").alias("members"), F.min("conv_id").alias("smallest"))
    placed = dense_index(distinct.join(ends, "pid").drop("pid"), ["path"])
    own, last = F.expr(f"idx div {SHARD}"), (F.col("idx") % SHARD == SHARD - 1) & (F.col("idx") + 1 < F.col("n"))
    to = F.array(F.struct(own.alias("shard"), F.lit(0).alias("side")), F.when(last, F.struct((own + 1).alias("shard"), F.lit(-1).alias("side"))), F.when((F.col("idx") % SHARD == 0) & (own > 0), F.struct((own - 1).alias("shard"), F.lit(1).alias("side"))))
    dealt = placed.withColumn("to", F.explode(F.filter(to, lambda x: x.isNotNull()))).select("to.shard", "to.side", "idx", "path", "bytes", "members", "smallest", "ends")
    nodes = materialized(dealt.repartition("shard").sortWithinPartitions("shard", "idx").drop("idx").mapInArrow(_sharded, NODES), "trie")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    spines = nodes.where("key IS NOT NULL").groupBy("key").agg(F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *sums, F.max("ends").alias("ends"))
    spines = materialized(spines, "spines")
    values = spines.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    met = nodes.where("key IS NOT NULL").select("shard", F.col("key").alias("parent_key")).join(values, "parent_key")  # so that the children of one node meet by shard
    inner = nodes.where("key IS NULL")
    below = inner.where("parent_key IS NOT NULL").drop("parent_conv_id").join(met, ["shard", "parent_key"])
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256")]
    return inner.where("parent_key IS NULL").select(*columns).unionByName(below.select(*columns)).unionByName(spines.join(values, "parent_key", "left").select(*columns))
