"""SimHash near-dedup: fingerprints of word shingles, linked by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.llm.common import NO_ID, checkpointed, materialized, spare
from attest.llm.components import components

#: (first bit, bits, radius) of each segment. Radii + 1 sum to 5: two fingerprints that differ in at most 4 bits cannot
#: be beyond the radius in every segment, so either choice finds the same links. The first has 24 keys a fingerprint and
#: buckets that grow by 11 rows for each 2 million fingerprints, the second 150 keys and buckets 2000 times smaller.
SEGMENTS = ((0, 21, 1), (21, 21, 1), (42, 22, 0))
BROAD_SEGMENTS = ((0, 32, 2), (32, 32, 1))
BROAD_FROM = 200_000_000  # fingerprints
SEED = 42


def fingerprint(text: bytes, words: int = 4) -> int:
    """SimHash of one text: bit i is set if more than half of the shingles' XXH64 values have it set; no words: 0."""
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    if len(found) <= words:
        spans = [(0, len(joined))]
    else:
        spans = zip([0, *(ends[: len(ends) - words] + 1).tolist()], ends[words - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):  # a very long text would else need 64 bytes a shingle at once
        total += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8"))[0])


def with_fingerprint(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, copy (md5 of the text), fp (the fingerprint as a signed long) of every row; null text: as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py() or b"", words) for t in b.column("text")], dtype=np.uint64).astype(np.int64)
            yield pa.record_batch([b.column("doc_id"), b.column("copy"), pa.array(fps)], names=["doc_id", "copy", "fp"])

    text = F.col("text").cast("binary")
    return docs.select(F.col("doc_id").cast("long"), F.md5(text).alias("copy"), text.alias("text")).mapInArrow(run, "doc_id long, copy string, fp long")


def _keys(fp: Column, segments=SEGMENTS) -> Column:
    """The table keys of a fingerprint: each segment as it is, and the rest of its Hamming ball.

    Where two segments differ, one has a bit that the other has not. If each clears those, both arrive at the bits they
    share, so it is enough to clear up to ``radius`` set bits.
    """
    def ball(tag: int, start: int, bits: int, radius: int) -> Column:
        if not 0 <= radius <= 2:
            raise ValueError("radius is 0, 1 or 2")
        own = F.shiftrightunsigned(fp, start).bitwiseAND((1 << bits) - 1)
        ones = F.filter(F.array(*[F.lit(1 << k) for k in range(bits)]).cast("array<long>"), lambda bit: own.bitwiseAND(bit) != 0)
        one_less = F.transform(ones, lambda bit: own.bitwiseXOR(bit))
        two_less = F.flatten(F.transform(ones, lambda x: F.transform(F.filter(ones, lambda y: y < x), lambda y: own.bitwiseXOR(x).bitwiseXOR(y))))
        return F.transform(F.concat(*[F.array(own), one_less, two_less][: radius + 1]), lambda key: key.bitwiseOR(F.lit(tag << 40)))

    return F.concat(*[ball(i, *segment) for i, segment in enumerate(segments)])


def spanning(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links (as row numbers) that connect what distances of at most ``most`` connect in one table bucket, one for each row reached.

    fps: a row of 64-bit words for each fingerprint. Breadth first: a row is compared with rows not reached yet only, so
    a dense group costs about as many comparisons as it has rows, and never emits its pairs.
    """
    out, rest = [], np.arange(len(fps))
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            here = front.pop()
            near = np.bitwise_count(fps[rest] ^ fps[here]).sum(axis=1) <= most
            if near.any():
                reached, rest = rest[near], rest[~near]
                front.extend(reached)
                out += [(here, x) for x in reached]
    return out


def _bucket_links(keys: np.ndarray, fps: np.ndarray, most: int, small: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of links within the buckets of sorted keys: from the first row of each bucket's component to the others in it.

    Small buckets are compared all at once, pair by pair; the others one by one, by spanning links.
    """
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    few, near = sizes <= small, [(np.empty(0, np.int64), np.empty(0, np.int64))]
    inside = np.repeat(np.where(few, sizes, 0), sizes)
    place = np.arange(len(keys)) - np.repeat(starts, sizes)
    for k in range(1, small):  # pairs k apart within small buckets, for all buckets at once
        i = np.flatnonzero(place + k < inside)
        i = i[np.bitwise_count(fps[i] ^ fps[i + k]).sum(axis=1) <= most]
        near.append((i, i + k))
    for s, n in zip(starts[~few], sizes[~few], strict=True):
        if found := spanning(fps[s : s + n], most):
            near.append(tuple(np.array(found).T + s))
    a, b = (np.concatenate(x) for x in zip(*near, strict=True))
    first, before = np.arange(len(keys)), None
    while before is None or (first != before).any():
        before = first.copy()
        least = np.minimum(first[a], first[b])
        np.minimum.at(first, a, least)
        np.minimum.at(first, b, least)
        first = first[first]
    linked = np.flatnonzero(first != np.arange(len(keys)))
    return first[linked], linked


def _matches(keyed: DataFrame, words: list[str], most: int) -> DataFrame:
    """Links between the fingerprints (columns ``words``, signed 64-bit words) that share a table key: a_<word> and b_<word>, distinct."""
    names = [f"{side}_{w}" for side in "ab" for w in words]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[np.ndarray] = []  # the last bucket may go on in the next batches
        for b in batches:
            rows = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("key", *words)], axis=1)
            if not len(rows):
                continue
            last = np.searchsorted(rows[:, 0], rows[-1, 0])
            if last or open_ and open_[-1][-1, 0] != rows[0, 0]:
                yield from linked(np.concatenate([*open_, rows[:last]]))
                open_ = []
            open_.append(rows[last:])
        if open_:
            yield from linked(np.concatenate(open_))

    def linked(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(rows) > 1:
            rows = rows[np.lexsort(rows.T[::-1])]  # so that the first of a component is the same one in as many buckets as can be
            fps = np.ascontiguousarray(rows[:, 1:])
            a, b = _bucket_links(rows[:, 0], fps.view(np.uint64), most)
            different = (fps[a] != fps[b]).any(axis=1)
            both = np.concatenate([fps[a], fps[b]], axis=1)[different]
            yield pa.record_batch([pa.array(np.ascontiguousarray(both[:, i])) for i in range(both.shape[1])], names=names)

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, ", ".join(f"{n} long" for n in names)).distinct()


def _gathered(found: DataFrame, times: int = 2) -> DataFrame:
    """The links (a, b), a before b, made fewer: each b is linked to its smallest a, and that to its other ones.

    The members of a large group meet in many buckets, whose links so fall together to little more than one for each.
    """
    for _ in range(times):
        found = checkpointed(found)
        near = found.groupBy("b").agg(F.min("a").alias("near"))
        further = found.join(near, "b").where("a <> near").select(F.col("near").alias("a"), F.col("a").alias("b"))
        found = near.select(F.col("near").alias("a"), "b").unionByName(further).distinct()
    return found


def links(fps: DataFrame, most: int = 4, segments=SEGMENTS) -> DataFrame:
    """(a, b): links that connect the distinct fingerprints in ``fps`` exactly as all pairs within ``most`` bits do."""
    if sum(r + 1 for _, _, r in segments) <= most or sum(n for _, n, _ in segments) != 64:
        raise ValueError("these segments do not find every pair")
    keyed = fps.select("fp", F.explode(_keys(F.col("fp"), segments)).alias("key"))
    return _gathered(_matches(keyed, ["fp"], most).select(F.col("a_fp").alias("a"), F.col("b_fp").alias("b")))


def near_duplicates(docs: DataFrame, words: int = 4, most: int = 4) -> DataFrame:
    """doc_id, copy, fp, root, component_id: one row per document; component_id is the smallest doc_id that links reach.

    root is the smallest fingerprint (as a signed long) of the component.

    Texts are lower-cased (A-Z) and cut into shingles of ``words`` words, repeats included; fewer words make one
    shingle, none (null, empty, white space) the fingerprint 0, which links like any other. Documents whose fingerprints
    differ in at most ``most`` bits are linked. Equal fingerprints are one node, so copies cost nothing. Rows without
    doc_id take part; their component_id is null only if no linked row has an id. Ties and repeated rows fall together;
    an empty table gives no rows; other columns are ignored.

    Scale: the segments follow from the number of distinct fingerprints (see BROAD_SEGMENTS); they change no result.
    """
    marked = materialized(with_fingerprint(docs, words), "simhash")
    nodes = materialized(marked.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("least")), "simhash-nodes")
    segments = SEGMENTS if nodes.count() < BROAD_FROM else BROAD_SEGMENTS
    found = components(links(nodes.select("fp"), most, segments))
    whole = _with_least(nodes, found, ["fp"]).select("fp", "root", F.col("least").alias("component_id"))
    return marked.join(whole, "fp").select("doc_id", "copy", "fp", "root", F.when(F.col("component_id") < NO_ID, F.col("component_id")).alias("component_id"))


def _with_least(nodes: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """nodes (key, least) with root and the least of their component; found: (node, root) of the linked ones.

    A component's least is made from the linked nodes only, with partial sums before the shuffle, and comes back over
    the component's nodes by a join that Spark may split; nodes without links meet nobody.
    """
    node = key[0]
    linked = materialized(nodes.join(found, F.col(node) == F.col("node")).select(*nodes.columns, "root"), "linked-nodes")
    least = linked.groupBy("root").agg(F.min("least").alias("least"))
    alone = nodes.join(found.select("node"), F.col(node) == F.col("node"), "left_anti").withColumn("root", F.col(node))
    return linked.drop("least").join(least, "root").select(*key, "root", "least").unionByName(alone.select(*key, "root", "least"))


#: Segments of each half of a 128-bit fingerprint. Two texts of similarity 0.8 differ in about 15 % of the bits, so that
#: at least one of the eight segments is within one bit for 93 % of such pairs, and for 99.6 % at similarity 0.9.
WIDE = tuple((16 * i, 16, 1) for i in range(4))


def shingle_hashes(text: bytes, words: int = 5) -> bytes:
    """The 128-bit hashes of all word shingles of a text, one after the other; fewer words make one shingle, none no hash."""
    found = text.lower().split()
    if not found:
        return b""
    joined = b" ".join(found)
    ends = (np.cumsum([len(w) + 1 for w in found]) - 1).tolist()
    n = max(1, len(found) - words + 1)
    starts = [0, *(e + 1 for e in ends[: n - 1])]
    return b"".join([xxhash.xxh3_128_digest(joined[a:b], SEED) for a, b in zip(starts, ends[-n:], strict=True)])


def wide_fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """A SimHash of 128 bits of shingle hashes (a row of 16 bytes each), as two signed words; none: (0, 0)."""
    total = np.zeros(128, np.int64)
    for at in range(0, len(hashes), 65536):
        total += np.unpackbits(hashes[at : at + 65536], axis=1).sum(axis=0, dtype=np.int64)
    a, b = np.packbits(total * 2 > len(hashes)).view(np.int64)
    return int(a), int(b)


def shingle_set(text: bytes, words: int = 5) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, sorted."""
    return np.unique(np.frombuffer(shingle_hashes(text, words), np.int64)[::2])


def similar_links(sets: list[np.ndarray], side: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links that connect what pairs of a similarity of at least ``least`` connect, one for each set reached.

    side: 0 or 1 for each set; where both occur only pairs across count, else all. Every set is held against all of the
    other side that no link has reached yet, by the number of its elements they hold.
    """
    sizes = np.array([len(x) for x in sets])
    element, where = np.unique(np.concatenate(sets) if sets else np.empty(0, np.int64), return_inverse=True)
    owner, cuts = np.repeat(np.arange(len(sets)), sizes), np.r_[0, np.cumsum(sizes)]
    across = side.min(initial=1) != side.max(initial=0)
    holders = {}  # for each side: the sets that hold an element, and where an element's sets begin
    for s in (0, 1):
        mine = side[owner] == s if across else np.ones(len(owner), bool)
        order = np.argsort(where[mine], kind="stable")
        holders[s] = owner[mine][order], np.r_[0, np.cumsum(np.bincount(where[mine], minlength=len(element)))]
        if not across:
            holders[1] = holders[0]
            break
    out, unreached, front = [], np.ones(len(sets), bool), []
    for first in range(len(sets)):
        if not unreached[first]:
            continue
        unreached[first] = False
        front.append(first)
        while front:
            here = front.pop()
            rows, begins = holders[1 - side[here] if across else 0]
            mine = where[cuts[here] : cuts[here + 1]]
            counts = begins[mine + 1] - begins[mine]
            ends = np.cumsum(counts)
            at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins[mine] - (ends - counts), counts)
            common = np.bincount(rows[at], minlength=len(sets))
            near = np.flatnonzero(unreached & (common >= least * (sizes + sizes[here] - common)) & (common > 0))
            unreached[near] = False
            front += near.tolist()
            out += [(here, int(x)) for x in near]
    return out


NODES, ELEMENTS = 1024, 1 << 21  # a block of a candidate group holds about so many texts and shingles at most


def _verified(sets: DataFrame, least: float) -> DataFrame:
    """(a, b): links between the nodes of the same group (columns group, node, shingles) of a similarity of at least ``least``.

    A group is dealt into blocks and each two blocks are held against each other in a task of their own, so neither a
    group of any size nor very long texts meet in one task; a task emits one link for each text it reaches. Which links
    these are follows from the order of the texts, so they are sorted: a task that is run again emits the same ones.
    """
    size = sets.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / NODES), F.ceil(F.sum(F.size("shingles")) / ELEMENTS)).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.least(i, F.col("block")).alias("i"), F.greatest(i, F.col("block")).alias("j")))
    dealt = sets.join(size, "group").withColumn("block", block).select("group", "node", "shingles", "block", F.explode(pair).alias("p"))
    dealt = dealt.select("group", "p.i", "p.j", (F.col("block") != F.col("p.i")).cast("int").alias("side"), "node", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for b in batches:
            shingles = b.column("shingles")
            for n, (group, i, j, side, node) in enumerate(zip(*(b.column(c).to_pylist() for c in ("group", "i", "j", "side", "node")), strict=True)):
                if (group, i, j) != at:
                    yield from linked(rows)
                    at, rows = (group, i, j), []
                rows.append((node, side, shingles[n].values.to_numpy()))
        yield from linked(rows)

    def linked(rows: list) -> Iterator[pa.RecordBatch]:
        if len(rows) > 1:
            found = similar_links([r[2] for r in rows], np.array([r[1] for r in rows]), least)
            yield pa.record_batch([pa.array([rows[x][0] for x, _ in found], pa.string()), pa.array([rows[y][0] for _, y in found], pa.string())], names=["a", "b"])

    return dealt.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "side", "node").mapInArrow(run, "a string, b string")


def near_copies(docs: DataFrame, words: int = 5, most: int = 30, least: float = 0.8) -> DataFrame:
    """doc_id, copy, root, component_id: groups of texts whose word-shingle sets have a Jaccard similarity of at least ``least``.

    Texts with equal shingle sets are one node. 128-bit fingerprints find the candidates: multi-index hashing with Hamming
    balls of radius 1 in eight segments, then the complete distance (``most`` bits). What such links connect is a
    candidate group, in which every two texts are compared by their whole shingle sets; only links so verified join
    texts. Null, empty and blank texts are one node. Rows without doc_id take part. Ties and repeated rows fall together;
    an empty table gives no rows; other columns are ignored, whatever their names.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, fps = [], []
            for t in b.column("text"):
                hashes = np.frombuffer(shingle_hashes(t.as_py() or b"", words), np.uint8).reshape(-1, 16)
                fps.append(wide_fingerprint(hashes))
                nodes.append(xxhash.xxh3_128_hexdigest(np.unique(hashes.view(np.int64)[:, 0]).tobytes()))
            x, y = np.array(fps, np.int64).reshape(-1, 2).T.copy()
            yield pa.record_batch([b.column("id"), b.column("copy"), pa.array(nodes, pa.string()), pa.array(x), pa.array(y)], names=["id", "copy", "node", "x", "y"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column("group"), b.column("node"), pa.array([shingle_set(t.as_py() or b"", words) for t in b.column("text")], pa.list_(pa.int64()))], names=["group", "node", "shingles"])

    text = F.col("text").cast("binary")
    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.md5(text), F.lit("")).alias("copy"), text.alias("text"))
    marked = materialized(plain.mapInArrow(mark, "id long, copy string, node string, x long, y long"), "wide-simhash")
    # texts of one node may repeat their shingles in other numbers, and so have other fingerprints: that of the first counts
    first = marked.groupBy("node").agg(F.min(F.struct("id", "copy", "x", "y")).alias("first"))
    nodes = materialized(first.select("node", "first.x", "first.y", F.col("first.id").alias("least"), "first.copy"), "text-nodes")
    fps = nodes.groupBy("x", "y").agg(F.count("*").alias("n"))
    keys = F.concat(_keys(F.col("x"), WIDE), F.transform(_keys(F.col("y"), WIDE), lambda k: k.bitwiseOR(F.lit(1 << 48))))
    name = lambda side="": F.concat(F.hex(F.col(f"{side}x")), F.lit("-"), F.hex(F.col(f"{side}y")))
    ends = [F.struct(F.col(f"{side}_x").alias("x"), F.col(f"{side}_y").alias("y")).alias(side) for side in "ab"]
    matched = _gathered(_matches(fps.select("x", "y", F.explode(keys).alias("key")), ["x", "y"], most).select(*ends))
    near = components(matched.select(name("a.").alias("a"), name("b.").alias("b")))
    groups = near.select("node", F.col("root").alias("group")).unionByName(fps.where("n > 1").select(name().alias("node"), name().alias("group")).join(near, "node", "left_anti"))
    members = nodes.join(groups.withColumnRenamed("node", "fp"), name() == F.col("fp")).select("group", "node", F.col("least").alias("id"), "copy")
    sets = plain.join(members, ["id", "copy"]).dropDuplicates(["id", "copy"]).select("group", "node", "text").mapInArrow(cut, "group string, node string, shingles array<long>")
    found = components(_verified(materialized(sets, "shingle-sets"), least))
    whole = _with_least(nodes.select("node", "least").withColumnRenamed("node", "text_node"), found, ["text_node"]).withColumnsRenamed({"text_node": "node", "least": "component_id"})
    joined = marked.join(whole, "node")
    shown = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    return joined.select(shown("id").alias("doc_id"), "copy", "root", shown("component_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """docs without all but one document of each group that near_copies finds; see keep_first."""
    return keep_first(docs, near_copies(docs, words, least=least))


def drop_near_duplicates(docs: DataFrame, words: int = 4, most: int = 4) -> DataFrame:
    """docs without all but one document of each group that near_duplicates finds; see keep_first."""
    return keep_first(docs, near_duplicates(docs, words, most))


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with one document of each group (root): the one with the smallest doc_id.

    Rows that repeat this document's id stay only once (the smallest text hash; equal rows are interchangeable). In a
    group without any id one row stays. Columns are those of docs, whatever their names.
    """
    key, md5 = spare(docs, "key_"), spare(docs, "md5_")
    best = (
        found.groupBy("root")
        .agg(F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.coalesce("copy", F.lit("")).alias("copy"))).alias("best"))
        .select(F.col("best.id").alias(key), F.col("best.copy").alias(md5))
    )
    marked = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(md5, F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")))
    return marked.join(best, [key, md5]).dropDuplicates([key, md5]).select(*docs.columns)
