from __future__ import annotations

import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from attest import schemas
from attest.functions.scalars import agent_label, artifact_code, checked_status
from attest.operators import admission as A
from attest.operators import quads as Q
from attest.operators import sequencing as N
from attest.operators import sync as G
from attest.sources import tables

CODE = "RA" + "x" * 43
NP = "https://w3id.org/np/" + CODE
NOW = "2024-01-01 00:00:00"


def publication(**kw):
    row = {"np_id": CODE, "full_id": NP, "counter": 1, "pubkey": "k", "types": [], "created_at": datetime(2023, 1, 1), "triple_count": 1200, "byte_count": 1_000_000, "is_protected": False, "graph_uris": [NP + "/a"], "sig_pubkey": "k"}
    return tuple((row | kw).values())


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        ({}, None),
        ({"created_at": None}, None),
        ({"created_at": datetime(2024, 1, 1, 0, 1, 0)}, None),
        ({"sig_pubkey": None, "triple_count": 9999}, "no valid key"),
        ({"triple_count": 1201}, "too many triples"),
        ({"byte_count": 1_000_001}, "too large"),
        ({"is_protected": True}, "protected"),
        ({"created_at": datetime(2024, 1, 1, 0, 1, 1)}, "in the future"),
        ({"graph_uris": [NP, "http://x"]}, "foreign graph"),
        ({"full_id": NP + "#a", "graph_uris": [NP + "/g"]}, "foreign graph"),
        ({"sig_pubkey": "j"}, "unexpected key"),
        ({"full_id": "http://x", "graph_uris": ["http://x/a"]}, "no artifact code"),
    ],
)
def test_rules(spark, change, reason):
    df = spark.createDataFrame([publication(**change)], schemas.PUBLICATIONS)
    assert A.admission_reason(df, F.lit(NOW).cast("timestamp")).first().reject_reason == reason
    assert A.admit(df, F.lit(NOW).cast("timestamp")).count() == (reason is None)


def test_coverage(spark):
    assert A.covered_types(None) is None and A.covered_types("  ") is None and A.covered_types(" ALL ") is None
    assert A.covered_types("a\n\tb a") == ("a", "b", *A.CORE_TYPES)
    sha = lambda x: F.sha2(F.lit(x), 256)
    df = spark.range(1).select(F.explode(F.array(F.array(sha("a")), F.array(sha("z")), F.array().cast("array<string>"), F.lit(None).cast("array<string>"), F.array(sha("z"), sha(A.CORE_TYPES[0])))).alias("types"))
    assert A.filter_covered(df, "a").count() == 4 and A.filter_covered(df, "all").count() == 5


def test_agent_filter(spark):
    rows, via = A.parse_agent_filter(spark, None)
    assert via and rows.count() == 0
    rows, via = A.parse_agent_filter(spark, "k1:5 k2:7")
    assert not via and {tuple(r) for r in rows.collect()} == {("k1", 5), ("k2", 7)}
    for bad in ("k1", "k1:x", ":5", "via"):
        with pytest.raises(ValueError):
            A.parse_agent_filter(spark, bad)


def test_quotas(spark):
    keys = spark.createDataFrame([(k,) for k in "abcde"], "pubkey string")
    accounts = spark.createDataFrame([("b", "loaded", 10), ("b", "toLoad", 99), ("c", "toLoad", 20), ("a", "loaded", 30), ("d", "skipped", 5)], "pubkey string, status string, quota int")
    explicit = spark.createDataFrame([("a", 1), ("e", 0)], "pubkey string, quota int")
    quotas = A.effective_quota(keys, accounts, explicit)
    assert {r.pubkey: r.quota for r in quotas.collect()} == {"a": 1, "b": 10, "c": 20, "d": -1, "e": 0}
    heads = spark.createDataFrame([("a", "$", 1), ("b", "$", 9), ("b", "t", 99)], "pubkey string, type string, count long")
    assert {r.pubkey: r.over for r in A.over_quota(keys, heads, quotas).collect()} == {"a": True, "b": False, "c": False, "d": True, "e": True}
    assert not any(r.over for r in A.over_quota(keys, heads, quotas, enforce=False).collect())
    pubs = spark.createDataFrame([(f"n{i}{k}", i, k) for k in "abd" for i in range(3)], "np_id string, counter long, pubkey string")
    passed, status = A.cap_to_quota(pubs, quotas, spark.createDataFrame([("b", 8)], "pubkey string, count long"))
    assert sorted(r.np_id for r in passed.collect()) == ["n0a", "n0b", "n1b"]
    assert {r.pubkey: r.status for r in status.collect()} == {"a": "capped", "b": "capped", "d": "skipped"}


def test_status_at_the_quota_and_without_new_publications(spark):
    quotas = spark.createDataFrame([("met", 2), ("under", 3), ("full", 5), ("idle", 5), ("zero", 0), ("no", -1)], "pubkey string, quota int")
    pubs = spark.createDataFrame([(f"n{i}{k}", i, k) for k in ("met", "under", "zero", "no") for i in range(2)], "np_id string, counter long, pubkey string")
    existing = spark.createDataFrame([("full", 5), ("idle", 4), ("unknown", 1)], "pubkey string, count long")
    passed, status = A.cap_to_quota(pubs, quotas, existing)
    assert {r.pubkey: r.status for r in status.collect()} == {"met": "capped", "under": "loaded", "full": "capped", "idle": "loaded", "zero": "capped", "no": "skipped", "unknown": "skipped"}
    assert {r.pubkey for r in passed.collect()} == {"met", "under"}


def test_scalars(spark):
    df = spark.createDataFrame([(NP, "https://orcid.org/0000-1"), ("x", "a" * 55), (NP + "/sub", "a" * 56), (None, " ")], "u string, a string")
    got = df.select(artifact_code(F.col("u")).alias("c"), agent_label(F.col("a")).alias("l")).collect()
    assert [r.c for r in got] == [CODE, None, None, None]
    assert [r.l for r in got] == ["orcid:0000-1", "a" * 55, "a" * 50 + "...", None]
    with pytest.raises(Exception, match="unknown status"):
        df.select(checked_status(F.col("u"))).collect()


def test_nquads_and_feeds(spark, tmp_path):
    lines = [f'<{NP}> <http://p> <http://o> <{NP}/g> .', f'_:b <http://p> "a \\"quoted\\" word"@en <{NP}/g> .', "# comment", "", "broken line", f'<s> <p> "1"^^<http://int> <{NP}#g>.']
    (tmp_path / "q.nq").write_text("\n".join(lines))
    got = tables.read_nquads(spark, str(tmp_path / "q.nq")).collect()
    assert [(r.subj, r.obj, r.obj_is_iri, r.reject) for r in got] == [(NP, "http://o", True, None), ("_:b", 'a "quoted" word', False, None), (None, None, None, "broken line"), ("s", "1", False, None)]
    assert {r.np_id for r in got if not r.reject} == {CODE}
    (tmp_path / "ids").write_text("a\nb\n\na\n c \n")
    assert sorted(r.np_id for r in tables.read_id_feed(spark, str(tmp_path / "ids"), spark.createDataFrame([("b",)], "np_id string")).collect()) == ["a", "c"]
    (tmp_path / "keys.json").write_text('["k1",\n "k2"]')
    assert sorted(r.pubkey for r in tables.read_peer_pubkeys(spark, str(tmp_path / "keys.json")).collect()) == ["k1", "k2"]


def test_escapes_in_literals(spark):
    written = [r"a\tb\\n\n\"", r"\u00e9\U0001F600\\u00e9", r"\'q\\\\", "plain"]
    lines = spark.createDataFrame([(f'<{NP}> <http://p> "{w}" <{NP}/g> .',) for w in written], "value string")
    assert [r.obj for r in tables.parse_nquads(lines).collect()] == ['a\tb\\n\n"', "é😀\\u00e9", "'q\\\\", "plain"]


def test_only_assertions_count(spark):
    head = lambda n: (n, f"{n}/h", n, Q.HAS_ASSERTION, f"{n}/a", True)
    target = "https://w3id.org/np/" + CODE
    rows = [
        head("i"), ("i", "i/a", "#d", Q.DECLARED_BY, "A", True), ("i", "i/a", "#d", Q.HAS_KEY, "K", False), ("i", "i/p", "#d", Q.HAS_KEY, "L", False),
        ("i", "i/a", "A", Q.NAME, "Zoe", False), ("i", "i/p", "A", Q.NAME, "Ann", False), ("i", "i/a", "A", Q.NAME, "Yan", False), ("i", "i/a", "B", Q.NAME, "Abe", False), ("i", "i/a", "A", Q.NAME, "http://x", True),
        head("e"), ("e", "e/a", "A", Q.APPROVES, target, True), ("e", "e/p", "A", Q.APPROVES, target[:-1] + "y", True), head("f"), ("f", "f/a", "A", Q.APPROVES, target[:-1] + "z", True),
    ]
    quads = spark.createDataFrame(rows, schemas.QUADS)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    pubs = spark.createDataFrame([("i", sha("K"), [], datetime(2020, 1, 1)), ("e", sha("K"), [sha(Q.APPROVES)], None), ("f", sha("K"), [sha("other")], None)], "np_id string, pubkey string, types array<string>, created_at timestamp")
    assert [tuple(r) for r in Q.introductions(quads, pubs).collect()] == [("i", "A", sha("K"), "Yan", datetime(2020, 1, 1))]
    found = Q.extract_endorsements(quads, pubs, Q.key_declarations(quads, pubs)).collect()
    assert [(r.agent, r.endorsed_np, r.source) for r in found] == [("A", CODE, "e")]


def test_next_counters_of_peers(spark):
    plan = spark.createDataFrame([("a", "incremental", 5, 1, 9), ("b", "incremental", 5, 1, 9), ("c", "skip", 9, 1, 9), ("d", "discover", 0, 1, 9)], "url string, action string, after long, setup_id long, load_counter long")
    got = G.next_peer_state(plan, spark.createDataFrame([("a", 7), ("b", -1), ("d", 8)], "url string, last_received long"))
    assert {r.url: r.load_counter for r in got.collect()} == {"a": 7, "b": 5, "c": 9, "d": 0}


def test_tables_are_switched_when_complete(spark, tmp_path):
    at = str(tmp_path / "t")
    for n in (3, 5):
        tables.write_table(spark.range(n), at)
        assert tables.read_table(spark, at).count() == n
    tables.write_json_export(spark.range(2).select(F.struct("id").alias("x"), F.array("id").alias("l")), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_sequencing(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("b", 2, None)], "np_id string, counter long, source string")
    assert sorted(map(tuple, N.dedupe_publications(df).collect())) == [("a", 1, "y"), ("b", 2, None)]
    got = N.assign_counters(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")), ["k"], start=10).collect()
    assert sorted((r.counter, r.k) for r in got) == [(10 + i, i) for i in range(1000)]
    known = N.record_hashes(df, "np_id")
    assert N.record_hashes(df, "np_id", known).count() == 0
    assert {r.value for r in N.unhash(known.select("hash"), "hash", known.where("value = 'a'")).collect()} == {"a", None}
