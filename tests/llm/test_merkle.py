from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from attest.llm import merkle
from attest.llm.queries import op12_merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, idx string, tree string"


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row: dict) -> str:
    texts = [None if row[c] is None else str(row[c]) for c in merkle.FIELDS]
    return h(*["-" if t is None else f"{len(t.encode())}:{t}" for t in texts])


def levels_of(nodes: list[str]) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def path_of(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    path = []
    for level in levels[:-1]:
        s = i - i % 3
        path.append(("".join(level[s:i]), "".join(level[i + 1 : s + 3])))
        i //= 3
    return path


def brute(rows: list[dict]) -> list[tuple]:
    """Level by level, as the definition says; rows of one doc_id and source by leaf."""
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        trees[s] = levels_of([leaf_of(r) for r in by[s]])
    top = levels_of([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(by[s]):
            path = path_of(trees[s], i) + path_of(top, k)
            cut = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
            at = leaf_of(r | {"text": r["text"].replace("\n", "")}) if cut and r["text"] is not None else leaf_of(r)
            for a, b in path:
                at = h(a, at, b)
            root = top[-1][0]
            out.append((r["doc_id"], leaf_of(r), trees[s][-1][0], root, h(*[d for p in path for d in p]), at, at == root))
    return sorted(out, key=str)


def found(spark, rows: list[dict], tmp_path) -> list[tuple]:
    at = str(tmp_path / "sf")
    names = [f.split(" ")[0] for f in SCHEMA.split(", ")]
    spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    out = op12_merkle(spark, at)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, out.collect()), key=str)


def row(i, text="a\nb", source="s", lang="en"):
    return {"doc_id": i, "text": text, "lang": lang, "source": source, "n_chars": len(text) if text is not None else None, "idx": "x", "tree": "y"}


def test_positions_are_those_of_completion():
    for n in (1, 2, 3, 4, 9, 10, 26, 27, 28, 100):
        order, count = [], [0] * 9

        def complete(level, n=n, order=order, count=count):
            order.append((level, count[level]))
            count[level] += 1

        for i in range(n):
            complete(0)
            for level in range(1, merkle.height(n) + 1):
                if (i + 1) % 3**level == 0 or i + 1 == n:
                    complete(level)
        assert [merkle.position(level, idx, n) for level, idx in order] == list(range(len(order)))


def test_nulls_ties_repeats_and_odd_texts(spark, tmp_path):
    rows = [row(i) for i in range(40)] + [row(i, source=None) for i in range(7)] + [row(1, source="é"), row(1, source="z", text=None), row(None, source="z"), row(None, source="z", text="other")]
    rows += [row(5), row(5), row(5, text="w\n" * 60_000), row(6, text="", lang=None, source=""), row(-3, text="\n"), row(8, text="déjà\nvu", source="Z")]
    assert found(spark, rows, tmp_path) == brute(rows)


def test_blocks_above_blocks_and_a_single_source(spark, tmp_path, monkeypatch):
    """Small builders, so that several layers of them stand above each other, and more sources than a builder takes."""
    rows = [row(i, text=f"t{i % 7}\n", source="hot" if i % 3 else f"s{i}") for i in range(500)]
    monkeypatch.setattr(merkle, "BLOCK", 2)
    assert found(spark, rows, tmp_path) == brute(rows)


def test_one_leaf_and_none(spark, tmp_path):
    assert found(spark, [row(3)], tmp_path / "a") == brute([row(3)])
    assert found(spark, [], tmp_path / "b") == []


def test_log_is_dense_and_ends_with_the_subroot(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("l").alias("lang"), F.lit(1).alias("n_chars"), F.lit("t").alias("text"))
    m = merkle.build_manifest(docs)
    log = sorted(m.log.collect(), key=lambda r: r.position)
    assert [r.position for r in log] == list(range(len(log)))
    tree = levels_of([leaf_of({"doc_id": i, "source": "s", "lang": "l", "n_chars": 1, "text": "t"}) for i in range(2000)])
    assert all(tree[r.level][r.idx] == bytes(r.digest).hex() for r in log) and log[-1].is_top and bytes(log[-1].digest).hex() == m.root
    proof = merkle.verify(m, paths=True).where("id = 1234").first()
    assert merkle.fold(proof.leaf, [(p.before, p.after) for p in proof.path]) == m.root and proof.verified


@pytest.mark.parametrize("n", [729, 730])
def test_sizes_at_a_builders_edge(spark, tmp_path, n):
    rows = [row(i, text="q") for i in range(n)]
    assert found(spark, rows, tmp_path) == brute(rows)
