"""The registered queries of the registry operators, each with its SQL."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from attest import schemas
from attest.functions import scalars as S
from attest.operators import admission as A
from attest.operators import hash_ranges as H
from attest.operators import lists as L
from attest.operators import quads as Q
from attest.operators import sequencing as N
from attest.operators import sync as G
from attest.plans import snapshots as P
from attest.plans import trust as T
from attest.plans import views as V
from attest.sources import fixtures as X
from attest.sources import list_store as store
from attest.sources import tables
from attest.sources.shared import discard, materialized, shared_dir, shuffles_removed
from attest.streaming import counter_source, cycle, feeds, listing

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
NOW = "2024-01-15 00:00:00"

PUBS = """p0 AS (SELECT *, sha256(CAST(event_id AS VARCHAR)) AS np_id, sha256(CAST(user_id AS VARCHAR)) AS pubkey, sha256(event_type) AS type,
  event_id + 1 AS counter, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k, ts AS created_at, CAST(floor(value * 20000) AS BIGINT) AS byte_count,
  CAST((event_id * 7919) % 1300 AS INTEGER) AS triple_count FROM events),
p AS (SELECT *, CASE WHEN event_id % 109 = 0 THEN 'https://example.org/none' ELSE 'https://w3id.org/np/RA' || substr(np_id, 1, 43) END AS full_id FROM p0)"""
MEMBERS = PUBS + """, m AS (SELECT pubkey, '$' AS type, np_id AS np, counter FROM p UNION ALL SELECT pubkey, type, np_id, counter FROM p)"""


def entries_sql(source: str, name: str = "e") -> str:
    """Positions and running XORs of a member relation."""
    words = ", ".join(f"CAST(('0x' || substr(h, {1 + 8 * i}, 8)) AS BIGINT) AS w{i}" for i in range(8))
    hexed = " || ".join(f"printf('%08x', bit_xor(w{i}) OVER w)" for i in range(8))
    return f"""{name}w AS (SELECT *, {words} FROM (SELECT *, sha256(np) AS h FROM {source})),
{name} AS (SELECT pubkey, type, np, counter, row_number() OVER w - 1 AS position, {hexed} AS checksum FROM {name}w WINDOW w AS (PARTITION BY pubkey, type ORDER BY counter, np ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


ENTRIES = MEMBERS + ", " + entries_sql("m")
HEADS = ENTRIES + ", h AS (SELECT pubkey, type, max(position) AS max_position, max(position) + 1 AS count, arg_max(checksum, position) AS checksum FROM e GROUP BY ALL)"
INVALID = PUBS + """, inv AS (SELECT sha256(CAST(a.event_id AS VARCHAR)) AS invalidating_np, sha256(CAST(a.user_id AS VARCHAR)) AS invalidating_pubkey, sha256(CAST(b.event_id AS VARCHAR)) AS invalidated_np
  FROM events a JOIN events b ON (a.event_id % 20 = 0 AND b.event_id = a.event_id - 1) OR (a.event_id % 10 = 5 AND b.user_id = a.user_id AND a.event_id - b.event_id BETWEEN 1 AND 40))"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return L.list_entries(L.list_memberships(X.publications(spark, d)))


# --- admission


REASON = f"""CASE WHEN event_id % 101 = 0 THEN 'no valid key' WHEN triple_count > 1200 THEN 'too many triples' WHEN byte_count > 1000000 THEN 'too large' WHEN event_id % 50 = 7 THEN 'protected'
  WHEN created_at > TIMESTAMP '{NOW}' + INTERVAL 60 SECOND THEN 'in the future' WHEN event_id % 107 = 0 THEN 'foreign graph' WHEN event_id % 103 = 0 THEN 'unexpected key' WHEN event_id % 109 = 0 THEN 'no artifact code' END"""


@query(f"WITH {PUBS} SELECT np_id, counter, {REASON} AS reject_reason FROM p")
def admission_reason(spark: SparkSession, d: str) -> DataFrame:
    return A.admission_reason(X.publications(spark, d), F.lit(NOW).cast("timestamp")).select("np_id", "counter", "reject_reason")


@query(f"WITH {PUBS} SELECT np_id, counter FROM p WHERE {REASON} IS NULL")
def admitted(spark: SparkSession, d: str) -> DataFrame:
    return A.admit(X.publications(spark, d), F.lit(NOW).cast("timestamp")).select("np_id", "counter")


@query(f"WITH {PUBS} SELECT reject_reason, count(*) AS n FROM (SELECT {REASON} AS reject_reason FROM p) WHERE reject_reason IS NOT NULL GROUP BY 1")
def rejected(spark: SparkSession, d: str) -> DataFrame:
    return A.rejected(X.publications(spark, d), F.lit(NOW).cast("timestamp")).groupBy("reject_reason").agg(F.count("*").alias("n"))


@query(f"WITH {PUBS} SELECT np_id FROM p WHERE event_type IN ('click', 'view')")
def covered_publications(spark: SparkSession, d: str) -> DataFrame:
    return A.filter_covered(X.publications(spark, d), "click\tview").select("np_id")


@query(f"WITH {MEMBERS} SELECT pubkey, type, count(*) AS n FROM m WHERE type = '$' OR type IN (sha256('click'), sha256('view')) GROUP BY ALL")
def covered_list_sizes(spark: SparkSession, d: str) -> DataFrame:
    members = L.list_memberships(X.publications(spark, d))
    return A.filter_covered_types(members, "click view").groupBy("pubkey", "type").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT sha256(t) AS type FROM (SELECT event_type AS t FROM events WHERE event_type < 'm' UNION ALL VALUES ('http://purl.org/nanopub/x/declaredBy'), ('http://purl.org/nanopub/x/approvesOf'))")
def covered_type_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Of a setting that lists the event types before the letter m."""
    named = X.table(spark, d, "events").where("event_type < 'm'").agg(F.array_join(F.array_sort(F.collect_set("event_type")), " ")).first()[0]  # a few words
    return A.covered_type_hashes(spark, named)


def _quotas(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Keys of the events, and their quotas: explicit for user 1, from accounts for users with an even id."""
    users = X.table(spark, d, "events").select("user_id").distinct()
    key, u = F.sha2(F.col("user_id").cast("string"), 256), F.col("user_id")
    accounts = users.where(u % 2 == 0).select(key.alias("pubkey"), F.when(u % 4 == 0, "loaded").otherwise("toLoad").alias("status"), (u * 3).cast("int").alias("quota"))
    explicit, via_setting = A.parse_agent_filter(spark, "viaSetting 6b86b273ff34fce19d6b804eff5a3f5747ada4eaa22f1d49c01e52ddb7875b4b:7")
    keys = users.select(key.alias("pubkey"))
    return keys, A.effective_quota(keys, accounts, explicit, via_setting)


QUOTAS = "u AS (SELECT DISTINCT user_id FROM events), q AS (SELECT sha256(CAST(user_id AS VARCHAR)) AS pubkey, CAST(CASE WHEN user_id = 1 THEN 7 WHEN user_id % 2 = 0 THEN user_id * 3 ELSE -1 END AS INTEGER) AS quota FROM u)"


@query(f"WITH {QUOTAS} SELECT * FROM q")
def effective_quota(spark: SparkSession, d: str) -> DataFrame:
    return _quotas(spark, d)[1]


@query(f"WITH {PUBS}, {QUOTAS} SELECT np_id FROM p JOIN q USING (pubkey) WHERE quota >= 0")
def allowed_publications(spark: SparkSession, d: str) -> DataFrame:
    return A.filter_allowed(X.publications(spark, d), _quotas(spark, d)[1]).select("np_id")


@query(f"WITH {PUBS}, {QUOTAS}, n AS (SELECT pubkey, count(*) AS n FROM p GROUP BY 1) SELECT pubkey, quota < 0 OR n >= quota AS over FROM q JOIN n USING (pubkey)")
def over_quota(spark: SparkSession, d: str) -> DataFrame:
    keys, quotas = _quotas(spark, d)
    return A.over_quota(keys, L.heads_of_members(L.list_memberships(X.publications(spark, d))), quotas)


CAPPED = f"WITH {PUBS}, {QUOTAS}, r AS (SELECT p.*, quota, row_number() OVER (PARTITION BY pubkey ORDER BY counter) + 2 AS nth FROM p JOIN q USING (pubkey))"


@query(f"{CAPPED} SELECT np_id, counter FROM r WHERE nth <= quota")
def cap_to_quota(spark: SparkSession, d: str) -> DataFrame:
    keys, quotas = _quotas(spark, d)
    return A.cap_to_quota(X.publications(spark, d), quotas, keys.withColumn("count", F.lit(2)))[0].select("np_id", "counter")


@query(f"""WITH {PUBS}, {QUOTAS}, n AS (SELECT user_id, pubkey, CAST(count(*) FILTER (user_id % 10 <> 4) AS BIGINT) AS n FROM p GROUP BY ALL),
have AS (SELECT pubkey, n, quota, CASE WHEN user_id % 10 = 4 THEN user_id * 3 WHEN user_id % 6 = 0 THEN greatest(quota - n, 0) ELSE 2 END AS have FROM n JOIN q USING (pubkey))
SELECT pubkey, CASE WHEN quota < 0 THEN 'skipped' WHEN n + have >= quota THEN 'capped' ELSE 'loaded' END AS status FROM have""")
def cap_status(spark: SparkSession, d: str) -> DataFrame:
    """Keys of users whose id ends in 4 are full and have nothing new; those of users with an id % 6 = 0 meet their quota exactly."""
    pubs, u = X.publications(spark, d), F.col("user_id")
    new = F.count(F.when(u % 10 != 4, 1))
    have = F.when(u % 10 == 4, u * 3).when(u % 6 == 0, F.greatest(u * 3 - F.col("n"), F.lit(0))).otherwise(2)
    existing = pubs.groupBy("pubkey", "user_id").agg(new.alias("n")).select("pubkey", have.alias("count"))
    return A.cap_to_quota(pubs.where(u % 10 != 4), _quotas(spark, d)[1], existing)[1]


_NAMES = ", ".join(f"'{s}'" for s in S.STATUSES)


@query(f"""SELECT status, count(*) AS n, bool_or(status IN ('seen', 'skipped')) AS unloaded, bool_or(status IN ('visited', 'expanded', 'processed', 'aggregated', 'approved', 'contested', 'toLoad', 'loaded')) AS core_loaded,
bool_or(status = 'loaded') AS fully_loaded FROM (SELECT [{_NAMES}][CAST(event_id % 16 AS INTEGER) + 1] AS status FROM events) GROUP BY 1""")
def status_predicates(spark: SparkSession, d: str) -> DataFrame:
    status = F.element_at(F.array(*[F.lit(s) for s in S.STATUSES]), (F.col("event_id") % 16 + 1).cast("int"))
    rows = X.table(spark, d, "events").select(S.checked_status(status).alias("status"))
    c = F.col("status")
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.bool_or(S.is_unloaded(c)).alias("unloaded"), F.bool_or(S.is_core_loaded(c)).alias("core_loaded"), F.bool_or(S.is_fully_loaded(c)).alias("fully_loaded"))


@query(f"WITH {PUBS} SELECT np_id FROM p WHERE pubkey NOT IN (SELECT sha256(CAST(c_custkey AS VARCHAR)) FROM customer WHERE c_custkey % 2 = 0)")
def missing_keys(spark: SparkSession, d: str) -> DataFrame:
    keys = X.table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.sha2(F.col("c_custkey").cast("string"), 256).alias("pubkey"))
    return A.exists_in(X.publications(spark, d), keys, ["pubkey"], negate=True).select("np_id")


@query(f"WITH {PUBS} SELECT pubkey, max(counter) AS counter, arg_max(np_id, counter) AS np_id FROM p GROUP BY 1")
def latest_of_key(spark: SparkSession, d: str) -> DataFrame:
    return A.max_row(X.publications(spark, d).select("pubkey", "counter", "np_id"), "counter", ["pubkey"])


@query(f"WITH {PUBS}, f AS (SELECT user_id, min(event_type) AS first_type FROM events GROUP BY 1) SELECT np_id, first_type FROM p JOIN f USING (user_id)")
def first_type_of_key(spark: SparkSession, d: str) -> DataFrame:
    pubs = X.publications(spark, d)
    other = X.table(spark, d, "events").select("user_id", F.col("event_type").alias("first_type"))
    return A.first_match(pubs, other, ["user_id"], "first_type").select("np_id", "first_type")


# --- scalar functions


@query(f"""WITH {PUBS} SELECT np_id, CASE WHEN k % 10 = 0 THEN '$' ELSE type END AS type_hash, CASE WHEN full_id LIKE '%/RA%' THEN right(full_id, 45) END AS code, full_id LIKE '%/RA%' AS is_code,
CASE WHEN k % 4 = 0 THEN CASE WHEN length('https://example.org/agents/with-a-rather-long-identifier/' || event_id) > 55 THEN left('https://example.org/agents/with-a-rather-long-identifier/' || event_id, 50) || '...' END
  ELSE 'orcid:0000-' || event_id END AS agent, left(np_id, 10) AS short, 'https://w3id.org/np/' || 'RA' || substr(np_id, 1, 43) AS uri, coalesce(url_encode(CASE WHEN k % 9 > 0 THEN full_id END), '') AS encoded,
strftime(created_at, '%Y-%m-%d %H:%M:%S') AS whole, printf('%.8f', k / 64.0) AS ratio_text, CAST(greatest(least(floor(CAST(k * k AS DOUBLE) / 1e9 * CAST(37.5 AS DOUBLE) * 1e9), 100000), 1000) AS INTEGER) AS quota FROM p""")
def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    p, k = X.publications(spark, d), F.col("k")
    agent = F.when(k % 4 == 0, F.concat(F.lit("https://example.org/agents/with-a-rather-long-identifier/"), "event_id")).otherwise(F.concat(F.lit("https://orcid.org/0000-"), "event_id"))
    return p.select(
        "np_id", S.type_hash(F.when(k % 10 == 0, "$").otherwise(F.col("event_type"))).alias("type_hash"), S.artifact_code(F.col("full_id")).alias("code"),
        S.is_artifact_code(F.coalesce(S.artifact_code(F.col("full_id")), F.lit("none"))).alias("is_code"), S.agent_label(agent).alias("agent"), S.short_label(F.col("np_id")).alias("short"),
        S.nanopub_uri(F.lit(None).cast("string"), F.concat(F.lit("RA"), F.substring("np_id", 1, 43))).alias("uri"), S.url_encode(F.when(k % 9 > 0, F.col("full_id"))).alias("encoded"),
        S.trim_fraction(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("whole"), S.ratio_text(k / F.lit(64.0)).alias("ratio_text"), S.quota_from_ratio(k * k / F.lit(1e9) * F.lit(37.5)).alias("quota"),
    )


# --- de-duplication and sequencing


@query("SELECT sha256(text) AS np_id, min(doc_id) AS counter, arg_min(source, doc_id) AS source FROM documents GROUP BY 1")
def dedupe_publications(spark: SparkSession, d: str) -> DataFrame:
    docs = X.table(spark, d, "documents").select(F.sha2("text", 256).alias("np_id"), F.col("doc_id").alias("counter"), "source")
    return N.dedupe_publications(docs)


@query("SELECT doc_id, row_number() OVER (ORDER BY sha256(CAST(doc_id AS VARCHAR))) + 999 AS counter FROM documents")
def assign_counters(spark: SparkSession, d: str) -> DataFrame:
    docs = X.table(spark, d, "documents").select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("h"))
    return N.assign_counters(docs, ["h"], start=1000).select("doc_id", "counter")


@query("SELECT max(event_id) + 2 AS next_counter FROM events")
def next_counter(spark: SparkSession, d: str) -> DataFrame:
    return N.next_counter(X.publications(spark, d))


@query("SELECT DISTINCT sha256(event_type) AS hash, event_type AS value FROM events WHERE event_type <> 'click'")
def record_hashes(spark: SparkSession, d: str) -> DataFrame:
    known = spark.range(1).select(F.sha2(F.lit("click"), 256).alias("hash"))
    return N.record_hashes(X.table(spark, d, "events"), "event_type", known)


# --- statements


QUADS = PUBS + """, said AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'http://example.org/thing' ELSE full_id END AS subj, 'RA' || substr(sha256(CAST(event_id - 1 AS VARCHAR)), 1, 43) AS target FROM p WHERE event_id > 0)"""


@query(f"WITH {QUADS} SELECT DISTINCT np_id AS invalidating_np, pubkey AS invalidating_pubkey, target AS invalidated_np FROM said WHERE k % 4 IN (0, 1) OR (k % 4 = 2 AND k % 3 <> 0)")
def extract_invalidations(spark: SparkSession, d: str) -> DataFrame:
    return Q.extract_invalidations(X.quads(spark, d), X.publications(spark, d))


INTROS = """c0 AS (SELECT c_custkey AS i, c_name FROM customer), dk AS (SELECT i, 'i' || i AS intro_np, 'a' || i AS agent, 'k' || (CASE WHEN i % 17 = 0 AND i > 0 THEN i - 1 ELSE i END) AS pubkey, TRUE AS main FROM c0
  UNION ALL SELECT i, 'i' || i, 'a' || i, 'k' || i || 'b', FALSE FROM c0 WHERE i % 5 = 0),
decl AS (SELECT dk.*, CASE WHEN i % 7 <> 3 THEN c_name END AS intro_name, TIMESTAMP '2020-01-01' + CAST(i % 1000 AS INTEGER) * INTERVAL 1 DAY AS created_at FROM dk JOIN c0 USING (i))"""


CODES = """n AS (SELECT count(*) AS n FROM customer), ci AS (SELECT c_custkey AS c, 'RA' || substr(sha256('i' || c_custkey), 1, 43) AS np, 'a' || c_custkey AS agent, sha256('K' || c_custkey) AS pubkey, 'B ' || c_name AS name, TIMESTAMP '2020-01-01' + CAST(c_custkey % 1000 AS INTEGER) * INTERVAL 1 DAY AS created_at FROM customer),
eo AS (SELECT DISTINCT o_orderkey AS k, 'RA' || substr(sha256('o' || o_orderkey), 1, 43) AS source, 'a' || o_custkey AS agent, sha256('K' || o_custkey) AS pubkey, 'RA' || substr(sha256('i' || ((o_orderkey * 31 + o_custkey * 7) % n)), 1, 43) AS endorsed_np FROM orders, n WHERE o_orderkey % 4 = 0)"""


@query(f"WITH {CODES} SELECT eo.agent, eo.pubkey, endorsed_np, source, 'toRetrieve' AS status FROM eo JOIN ci USING (agent, pubkey) WHERE k % 40 <> 0")
def extract_endorsements(spark: SparkSession, d: str) -> DataFrame:
    quads, pubs = X.statement_quads(spark, d), X.statement_publications(spark, d)
    return Q.extract_endorsements(quads, pubs, Q.key_declarations(quads, pubs))


@query(f"WITH {CODES} SELECT np AS intro_np, agent, pubkey, created_at FROM ci")
def key_declarations(spark: SparkSession, d: str) -> DataFrame:
    return Q.key_declarations(X.statement_quads(spark, d), X.statement_publications(spark, d))


@query(f"WITH {CODES} SELECT np AS np_id, name FROM ci")
def intro_names(spark: SparkSession, d: str) -> DataFrame:
    quads = X.statement_quads(spark, d)
    found = Q.key_declarations(quads, X.statement_publications(spark, d)).select(F.col("intro_np").alias("np_id"), "agent")
    return Q.intro_name(quads, found)


@query(f"WITH {CODES} SELECT np AS intro_np, agent, pubkey, name AS intro_name, created_at FROM ci")
def introductions(spark: SparkSession, d: str) -> DataFrame:
    return Q.introductions(X.statement_quads(spark, d), X.statement_publications(spark, d))


def _stated_edges(spark: SparkSession, d: str) -> DataFrame:
    """From statements to edges: introductions, endorsements and invalidations all come from the quads."""
    quads, pubs = materialized(X.statement_quads(spark, d), "quads"), X.statement_publications(spark, d)
    decl = materialized(Q.introductions(quads, pubs), "introductions")
    full = pubs.withColumn("full_id", S.nanopub_uri(F.lit(None).cast("string"), F.col("np_id")))
    return T.build_trust_edges(Q.extract_endorsements(quads, pubs, decl), decl, Q.extract_invalidations(quads, full))


STATED = CODES + """, good AS (SELECT eo.* FROM eo JOIN ci USING (agent, pubkey) WHERE k % 40 <> 0), inv AS (SELECT DISTINCT o.source AS np, eo.pubkey FROM eo JOIN eo o ON o.k = eo.k - 4 WHERE eo.k % 12 = 0),
stated AS (SELECT DISTINCT g.agent AS from_agent, g.pubkey AS from_pubkey, ci.agent AS to_agent, ci.pubkey AS to_pubkey, source, EXISTS (SELECT 1 FROM inv WHERE inv.np = source AND inv.pubkey = g.pubkey) AS invalidated FROM good g JOIN ci ON endorsed_np = np)"""


@query(f"WITH {STATED} SELECT * FROM stated")
def statement_edges(spark: SparkSession, d: str) -> DataFrame:
    return _stated_edges(spark, d)


@query(f"WITH {QUADS} SELECT 'RA' || substr(np_id, 1, 43) AS np_id, subj, 'https://w3id.org/np/' || target AS obj, TRUE AS obj_is_iri FROM said WHERE event_id % 109 <> 0")
def parse_nquads(spark: SparkSession, d: str) -> DataFrame:
    q = X.quads(spark, d).where(F.length("np_id") == 64)
    line = lambda c: F.concat(F.lit("<"), c, F.lit("> "))
    text = q.select(F.concat(line(F.col("subj")), line(F.col("pred")), line(F.col("obj")), line(F.col("graph")), F.lit(".")).alias("value"))
    return tables.parse_nquads(text).where("reject IS NULL AND np_id <> ''").select("np_id", "subj", "obj", "obj_is_iri")


# --- lists


@query(f"WITH {ENTRIES} SELECT * FROM e")
def list_entries(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d)


@query(f"WITH {HEADS} SELECT * FROM h")
def list_heads(spark: SparkSession, d: str) -> DataFrame:
    return L.heads_of_members(L.list_memberships(X.publications(spark, d)))


@query(f"WITH {ENTRIES} SELECT * FROM e WHERE counter > (SELECT max(counter) // 2 FROM p)")
def append_to_lists(spark: SparkSession, d: str) -> DataFrame:
    members = L.list_memberships(X.publications(spark, d)).crossJoin(F.broadcast(X.publications(spark, d).agg(F.floor(F.max("counter") / 2).alias("half"))))  # one row
    old = L.list_entries(members.where("counter <= half").drop("half"))
    return L.append_to_lists(L.list_heads(old), old, members.drop("half"))


@query(f"WITH {INVALID}, m AS (SELECT pubkey, '$' AS type, np_id AS np, counter FROM p UNION ALL SELECT pubkey, type, np_id, counter FROM p) SELECT DISTINCT a.pubkey, a.type, b.np_id AS np, b.counter FROM m a JOIN inv ON a.np = invalidated_np AND a.pubkey = invalidating_pubkey JOIN p b ON b.np_id = invalidating_np WHERE NOT (a.type = '$' OR a.type = b.type)")
def inherit_invalidations(spark: SparkSession, d: str) -> DataFrame:
    members = L.list_memberships(X.publications(spark, d))
    return L.inherit_invalidations(members, X.invalidations(spark, d), X.publications(spark, d))


@query(f"WITH {INVALID}, m AS (SELECT pubkey, '$' AS type, np_id AS np, counter FROM p UNION ALL SELECT pubkey, type, np_id, counter FROM p) SELECT *, EXISTS (SELECT 1 FROM inv WHERE invalidated_np = np AND invalidating_pubkey = pubkey) AS invalidated FROM m")
def mark_invalidated(spark: SparkSession, d: str) -> DataFrame:
    members = L.list_memberships(X.publications(spark, d))
    return L.mark_invalidated(members, X.invalidations(spark, d)).select("pubkey", "type", "np", "counter", "invalidated")


@query(f"WITH {INVALID} SELECT inv.* FROM inv JOIN p ON np_id = invalidated_np WHERE k < 20")
def invalidators(spark: SparkSession, d: str) -> DataFrame:
    return L.invalidators_of(X.publications(spark, d).where("k < 20"), X.invalidations(spark, d)).select("invalidating_np", "invalidating_pubkey", "invalidated_np")


def _states(spark: SparkSession, d: str) -> DataFrame:
    """List states: user % 3 = 0 all loaded, = 1 core loaded, = 2 encountered."""
    users = X.table(spark, d, "events").select("user_id").distinct()
    u = F.col("user_id") % 3
    type_ = F.when(u == 0, "$").when(u == 1, F.sha2(F.lit("click"), 256)).otherwise("$")
    return users.select(F.sha2(F.col("user_id").cast("string"), 256).alias("pubkey"), type_.alias("type"), F.when(u == 2, "encountered").otherwise("loaded").alias("status"))


@query(f"""WITH {PUBS} SELECT np_id, pubkey, '$' AS type FROM p WHERE user_id % 3 = 0 UNION ALL SELECT np_id, pubkey, type FROM p WHERE user_id % 3 = 0
UNION ALL SELECT np_id, pubkey, unnest([sha256('click'), sha256('view')]) FROM p WHERE user_id % 3 = 1 UNION ALL SELECT np_id, pubkey, NULL FROM p WHERE user_id % 3 = 2""")
def route_publications(spark: SparkSession, d: str) -> DataFrame:
    hashes = tuple(hashlib.sha256(t).hexdigest() for t in (b"click", b"view"))
    return L.route_publications(X.publications(spark, d), _states(spark, d), hashes)


@query(f"WITH {MEMBERS} SELECT * FROM m WHERE pubkey IN (SELECT sha256(CAST(user_id AS VARCHAR)) FROM events WHERE user_id % 3 = 0) AND type <> '$'")
def backfill_lists(spark: SparkSession, d: str) -> DataFrame:
    members = L.list_memberships(X.publications(spark, d))
    loaded = _states(spark, d).where("type = '$' AND status = 'loaded'")
    return L.backfill_lists(X.publications(spark, d), members.where("type = '$'"), loaded)


@query("SELECT DISTINCT sha256(CAST(user_id AS VARCHAR)) AS pubkey, CASE WHEN user_id % 3 = 1 THEN sha256('click') ELSE '$' END AS type, CASE WHEN user_id % 3 = 2 THEN 'loading' ELSE 'loaded' END AS status FROM events")
def promote_lists(spark: SparkSession, d: str) -> DataFrame:
    states = _states(spark, d)
    return L.promote_lists(states, states.withColumn("status", F.lit("loading")))


# --- comparison and sync


@query(f"WITH {HEADS}, x AS (SELECT pubkey, type, unnest([0, 10, 100, 1000, 10000, 100000]) AS o, max_position FROM h) SELECT e.pubkey, e.type, e.position, e.checksum FROM x JOIN e ON e.pubkey = x.pubkey AND e.type = x.type AND e.position = max_position - o")
def list_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    return G.list_checkpoints(L.list_entries(L.list_memberships(X.publications(spark, d)), after=True))


PEER = ENTRIES + ", c AS (SELECT max(counter) * 9 // 10 AS upto FROM p), peer AS (SELECT e.* FROM e, c WHERE counter <= upto), ph AS (SELECT pubkey, type, max(position) AS last FROM peer GROUP BY ALL)"


@query(f"WITH {PEER} SELECT e.* FROM e LEFT JOIN ph USING (pubkey, type) WHERE position > coalesce(last, -1)")
def list_delta(spark: SparkSession, d: str) -> DataFrame:
    pubs = X.publications(spark, d)
    upto = pubs.agg(F.floor(F.max("counter") * 9 / 10).alias("upto"))
    peer = L.list_memberships(pubs.crossJoin(F.broadcast(upto)).where("counter <= upto").drop("upto"))  # one row
    with shuffles_removed(spark):
        entries = materialized(_entries(spark, d), "entries", compression="zstd")
        checkpoints = materialized(G.list_checkpoints(L.list_entries(peer, after=True)), "checkpoints")
    return G.list_delta(entries, checkpoints).select("pubkey", "type", "np", "counter", "position", "checksum")


@query(f"WITH {PUBS} SELECT np_id, counter FROM p WHERE counter > 500")
def publications_after(spark: SparkSession, d: str) -> DataFrame:
    return G.publications_after(X.publications(spark, d), 500).select("np_id", "counter")


def _two(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    m = X.publications(spark, d)
    return L.list_memberships(m.where("event_id % 10 <> 0")), L.list_memberships(m.where("event_id % 7 <> 0"))


TWO = MEMBERS + ", a AS (SELECT * FROM m WHERE counter % 10 <> 1), b AS (SELECT * FROM m WHERE counter % 7 <> 1)"


@query(f"WITH {TWO}, s AS (SELECT pubkey, type, list(np ORDER BY np) AS x FROM a GROUP BY ALL), t AS (SELECT pubkey, type, list(np ORDER BY np) AS y FROM b GROUP BY ALL) SELECT pubkey, type, x IS NOT DISTINCT FROM y AS equal FROM s FULL JOIN t USING (pubkey, type)")
def lists_equal(spark: SparkSession, d: str) -> DataFrame:
    with shuffles_removed(spark):
        return G.heads_equal(*[materialized(L.heads_of_members(m), "heads") for m in _two(spark, d)])


@query(f"WITH {TWO} SELECT pubkey, type, np, 'b' AS missing_in FROM a ANTI JOIN b USING (pubkey, type, np) UNION ALL SELECT pubkey, type, np, 'a' FROM b ANTI JOIN a USING (pubkey, type, np)")
def list_diff(spark: SparkSession, d: str) -> DataFrame:
    return G.list_diff(*_two(spark, d))


@query(f"WITH {TWO} SELECT pubkey, type, np, 'b' AS missing_in FROM a ANTI JOIN b USING (pubkey, type, np) UNION ALL SELECT pubkey, type, np, 'a' FROM b ANTI JOIN a USING (pubkey, type, np)")
def list_diff_by_ranges(spark: SparkSession, d: str) -> DataFrame:
    """list_diff() of two stored registries, by trees of hash ranges."""
    paths = [_folder(spark, name) for name in ("tree-a", "tree-b")]
    for members, path in zip(_two(spark, d), paths, strict=True):
        H.write_hash_tree(members, path, leaf=16)
    return H.list_diff_by_ranges(spark, *paths)


@query("SELECT DISTINCT sha256(CAST(c_custkey AS VARCHAR)) AS pubkey, CASE WHEN u.user_id % 3 = 0 THEN 'loaded' ELSE 'encountered' END AS status, coalesce(u.user_id % 3 <> 1, FALSE) AS known FROM customer LEFT JOIN (SELECT DISTINCT user_id FROM events) u ON u.user_id = c_custkey")
def discover_pubkeys(spark: SparkSession, d: str) -> DataFrame:
    keys = X.table(spark, d, "customer").select(F.sha2(F.col("c_custkey").cast("string"), 256).alias("pubkey"))
    return G.discover_pubkeys(keys, _states(spark, d))


def _peers(spark: SparkSession, d: str) -> DataFrame:
    s, k = X.table(spark, d, "supplier"), F.col("s_suppkey")
    status = F.element_at(F.array(*[F.lit(x) for x in ("ready", "updating", "loading")]), (k % 3 + 1).cast("int"))
    return s.select(F.concat(F.lit("http://peer/"), k).alias("url"), F.when(k % 11 == 0, 503).otherwise(200).alias("http_status"), (k % 13 == 0).alias("is_test"), status.alias("status"), F.when(k % 17 != 0, k % 5).alias("setup_id"), (k * 10).alias("load_counter"))


PEERS = "pe AS (SELECT s_suppkey AS k, 'http://peer/' || s_suppkey AS url, s_suppkey % 5 AS setup_id, s_suppkey * 10 AS load_counter FROM supplier WHERE s_suppkey % 11 <> 0 AND s_suppkey % 13 <> 0 AND s_suppkey % 3 <> 2 AND s_suppkey % 17 <> 0)"


@query(f"WITH {PEERS} SELECT url, setup_id, load_counter FROM pe")
def eligible_peers(spark: SparkSession, d: str) -> DataFrame:
    return G.eligible_peers(_peers(spark, d)).select("url", "setup_id", "load_counter")


SYNC = f"""WITH {PEERS}, s AS (SELECT *, CASE WHEN k % 4 = 0 THEN 'discover' WHEN setup_id <> (k // 2) % 5 THEN 'reset' WHEN k % 2 = 0 THEN 'skip' ELSE 'incremental' END AS action FROM pe),
plan AS (SELECT k, url, action, CASE action WHEN 'skip' THEN k * 10 WHEN 'incremental' THEN k * 10 - 5 ELSE 0 END AS after, setup_id, load_counter FROM s)"""


@query(f"{SYNC} SELECT url, action, after, setup_id, load_counter FROM plan")
def peer_sync_plan(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    state = X.table(spark, d, "supplier").where("s_suppkey % 4 <> 0").select(F.concat(F.lit("http://peer/"), k).alias("url"), (F.floor(k / 2) % 5).alias("setup_id"), (k * 10 - F.when(k % 2 == 0, 0).otherwise(5)).alias("load_counter"))
    return G.peer_sync_plan(G.eligible_peers(_peers(spark, d)), state)


@query(f"{SYNC} SELECT url, setup_id, CAST(CASE WHEN action = 'incremental' AND k % 5 > 1 THEN k * 10 - 2 ELSE after END AS BIGINT) AS load_counter FROM plan")
def next_peer_state(spark: SparkSession, d: str) -> DataFrame:
    """Of each five peers one gives nothing and one can't be read."""
    k = F.col("s_suppkey")
    received = X.table(spark, d, "supplier").where("s_suppkey % 5 > 0").select(F.concat(F.lit("http://peer/"), k).alias("url"), F.when(k % 5 == 1, -1).otherwise(k * 10 - 2).alias("last_received"))
    return G.next_peer_state(peer_sync_plan(spark, d), received)


@query(f"WITH {INTROS}, t AS (SELECT unnest([sha256('click'), sha256('view'), sha256('http://purl.org/nanopub/x/declaredBy'), sha256('http://purl.org/nanopub/x/approvesOf')]) AS type) SELECT agent, pubkey, type FROM decl, t WHERE i % 2 = 0")
def load_plan(spark: SparkSession, d: str) -> DataFrame:
    accounts = X.declarations(spark, d).withColumn("status", F.when(F.substring("agent", 2, 20).cast("long") % 2 == 0, "toLoad").otherwise("loaded"))
    return G.load_plan(accounts, A.covered_type_hashes(spark, "click view"))


@query(f"""WITH {PUBS}, n AS (SELECT user_id, pubkey, count(*) AS n, count(*) FILTER (event_type = 'click') AS intros, count(*) FILTER (event_type = 'view') AS ends FROM p GROUP BY ALL),
due AS (SELECT pubkey, 'intro' AS type, 0 AS phase, intros + ends AS n FROM n WHERE user_id % 2 = 0 UNION ALL SELECT pubkey, '$', 1, n + CASE WHEN user_id % 3 = 0 THEN n ELSE 0 END FROM n WHERE user_id % 2 = 1 OR user_id % 4 = 0),
r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY phase, pubkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM due) SELECT pubkey, type, CAST(phase AS INTEGER) AS phase, n, CAST(spent AS BIGINT) AS spent FROM r WHERE spent < 3000""")
def optional_load_batch(spark: SparkSession, d: str) -> DataFrame:
    """Intro lists of even users, half of whom have no list of all types yet; such lists of the others. Each third user's are stored already."""
    pubs, u = X.publications(spark, d), F.col("user_id")
    users = pubs.select("pubkey", "user_id").distinct()
    kind = lambda rows, name, status: rows.select("pubkey", F.lit(name).alias("type"), F.lit(status).alias("status"))
    lists = kind(users.where(u % 2 == 0), "intro", "encountered").unionByName(kind(users.where(u % 2 == 1), "$", "encountered")).unionByName(kind(users.where(u % 4 == 2), "$", "loaded"))
    named = F.when(F.col("event_type") == "click", "intro").when(F.col("event_type") == "view", "endorse").otherwise("other")
    sizes = pubs.select("pubkey", F.explode(F.array(named, F.lit("$"))).alias("type")).groupBy("pubkey", "type").agg(F.count("*").alias("n"))
    stored = pubs.where(u % 3 == 0).groupBy("pubkey").agg(F.count("*").alias("n"))
    return G.optional_load_batch(lists, sizes, "intro", "endorse", budget=3000, stored=stored)


# --- trust


def _rounds(depth: int = 10, simple: bool = False) -> str:
    new = " WHERE NOT list_contains(string_split(id, ' '), to_agent || '|' || to_pubkey)" if simple else ""
    out = ["""l0 AS (SELECT '$' AS id, sha256('S $') AS sorthash, '$' AS agent, '$' AS pubkey, 0 AS depth, CAST(1.0 AS DOUBLE) AS ratio)""", "f0 AS (SELECT '$' AS agent, '$' AS pubkey)"]
    for i in range(1, depth + 1):
        known = " UNION ALL ".join(["SELECT '$' AS agent, '$' AS pubkey", *[f"SELECT agent, pubkey FROM g{j}" for j in range(1, i)]])
        out.append(f"b{i} AS MATERIALIZED (SELECT agent, pubkey, id, ratio FROM l{i - 1} SEMI JOIN f{i - 1} USING (agent, pubkey) QUALIFY row_number() OVER (PARTITION BY agent, pubkey ORDER BY ratio DESC, sorthash) = 1)")
        out.append(
            f"l{i} AS MATERIALIZED (SELECT id || ' ' || to_agent || '|' || to_pubkey AS id, sha256('S ' || id || ' ' || to_agent || '|' || to_pubkey) AS sorthash, to_agent AS agent, to_pubkey AS pubkey, {i} AS depth, "
            f"ratio * CAST(0.9 AS DOUBLE) / n_agents / n_keys AS ratio FROM b{i} JOIN fan ON from_agent = agent AND from_pubkey = pubkey{new})"
        )
        out.append(
            f"g{i} AS MATERIALIZED (SELECT s.agent, s.pubkey, CASE WHEN top >= 1e-10 THEN 'visited' ELSE 'skipped' END AS status, {i} AS depth FROM (SELECT DISTINCT to_agent AS agent, to_pubkey AS pubkey FROM reach SEMI JOIN f{i - 1} f ON from_agent = f.agent AND from_pubkey = f.pubkey) s "
            f"ANTI JOIN ({known}) k USING (agent, pubkey) LEFT JOIN (SELECT agent, pubkey, max(ratio) AS top FROM l{i} GROUP BY ALL) t USING (agent, pubkey))"
        )
        out.append(f"f{i} AS (SELECT agent, pubkey FROM g{i} WHERE status = 'visited')")
    best = " UNION ALL ".join(f"SELECT agent, pubkey, id FROM b{i}" for i in range(1, depth + 1))
    levels = " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(depth + 1))
    gates = " UNION ALL ".join(f"SELECT agent, pubkey, status, depth FROM g{i}" for i in range(1, depth + 1))
    out.append(f"best AS MATERIALIZED ({best})")
    out.append(f"paths AS MATERIALIZED (SELECT x.id, sorthash, x.agent, x.pubkey, depth, CASE WHEN b.id IS NULL THEN ratio ELSE ratio * CAST(0.1 AS DOUBLE) END AS ratio, CASE WHEN b.id IS NULL THEN 'extended' ELSE 'primary' END AS type FROM ({levels}) x LEFT JOIN best b USING (id))")
    out.append(f"acc AS MATERIALIZED (SELECT s.agent, s.pubkey, CASE WHEN b.id IS NULL THEN status ELSE 'expanded' END AS status, depth FROM (SELECT '$' AS agent, '$' AS pubkey, 'visited' AS status, 0 AS depth UNION ALL {gates}) s LEFT JOIN best b USING (agent, pubkey))")
    return ", ".join(out)


EDGES = INTROS + """, ends AS (SELECT 'a' || o_custkey AS agent, 'k' || (CASE WHEN o_custkey % 17 = 0 AND o_custkey > 0 THEN o_custkey - 1 ELSE o_custkey END) AS pubkey, 'i' || ((o_orderkey * 31 + o_custkey * 7) % n) AS endorsed_np, 'o' || o_orderkey AS source, o_orderstatus = 'P' AS invalidated
  FROM orders, (SELECT count(*) AS n FROM customer) WHERE o_orderkey % 4 = 0 UNION ALL SELECT '$', '$', 'i' || c_custkey, 'S', TRUE FROM customer WHERE c_custkey % 100 = 0),
edges AS MATERIALIZED (SELECT DISTINCT e.agent AS from_agent, e.pubkey AS from_pubkey, d.agent AS to_agent, d.pubkey AS to_pubkey, source, invalidated FROM ends e JOIN decl d ON endorsed_np = intro_np), """
FOLLOW = """followed AS (SELECT * FROM edges WHERE NOT invalidated OR source = 'S'),
pairs AS (SELECT DISTINCT from_agent, from_pubkey, to_agent, to_pubkey FROM followed),
fan AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY from_agent, from_pubkey, to_agent) AS n_keys, (SELECT count(DISTINCT to_agent) FROM pairs q WHERE q.from_agent = pairs.from_agent AND q.from_pubkey = pairs.from_pubkey) AS n_agents FROM pairs),
reach AS MATERIALIZED (SELECT DISTINCT from_agent, from_pubkey, to_agent, to_pubkey FROM edges)"""
EDGES += FOLLOW
TRUST = EDGES + ", " + _rounds()
def _exact_sum(c: str) -> str:
    """scalars.exact_sum()."""
    scale = "CAST(4611686018427387904 AS DOUBLE)"
    high = f"floor({c} * {scale})"
    return f"(CAST(sum(CAST({high} AS HUGEINT)) AS DOUBLE) / {scale} + CAST(sum(CAST(floor(({c} * {scale} - {high}) * {scale}) AS HUGEINT)) AS DOUBLE) / {scale} / {scale})"


FOLD = f""", sums AS (SELECT agent, pubkey, {_exact_sum("ratio")} AS r FROM paths GROUP BY ALL)""" + """, fold AS (SELECT agent, pubkey, list_reduce(list({'seen': CAST([] AS VARCHAR[]), 'mid': string_split(id, ' ')[2:-2], 'n': 0, 'r': ratio} ORDER BY depth, ratio DESC, sorthash),
    lambda a, x: {'seen': list_concat(a.seen, x.mid[1:coalesce(list_filter(range(1, len(x.mid) + 1), lambda i: list_contains(a.seen, x.mid[i]) OR list_contains(x.mid[1:i - 1], x.mid[i]))[1] - 1, len(x.mid))]), 'mid': x.mid,
      'n': a.n + CASE WHEN len(list_filter(range(1, len(x.mid) + 1), lambda i: list_contains(a.seen, x.mid[i]) OR list_contains(x.mid[1:i - 1], x.mid[i]))) > 0 THEN 0 ELSE 1 END, 'r': a.r + x.r},
    {'seen': CAST([] AS VARCHAR[]), 'mid': CAST([] AS VARCHAR[]), 'n': 0, 'r': CAST(0.0 AS DOUBLE)}) AS s FROM paths SEMI JOIN (SELECT * FROM acc WHERE status = 'expanded') x USING (agent, pubkey) GROUP BY ALL),
scores AS MATERIALIZED (SELECT agent, pubkey, CASE WHEN status = 'expanded' THEN 'processed' ELSE status END AS status, depth, CASE WHEN s.n IS NOT NULL THEN r END AS ratio, s.n AS path_count, CASE WHEN s.n IS NOT NULL THEN CAST(greatest(least(floor(r * 1e9), 100000), 1000) AS INTEGER) END AS quota FROM acc LEFT JOIN fold USING (agent, pubkey) LEFT JOIN sums USING (agent, pubkey))"""
SCORES = TRUST + FOLD
NAMES = """, names AS (SELECT agent, pubkey, max_by(intro_name, created_at) FILTER (intro_name IS NOT NULL) AS name FROM decl GROUP BY ALL)"""
STATUS = SCORES + """, st AS MATERIALIZED (SELECT agent, pubkey, CASE WHEN NOT hit THEN status WHEN n > 1 THEN 'contested' WHEN agent IN (SELECT 'a' || c_custkey FROM customer WHERE c_custkey % 3 = 0) THEN 'loaded' ELSE 'toLoad' END AS status, depth, ratio, path_count, quota
  FROM (SELECT *, count(*) OVER (PARTITION BY pubkey) AS n, bool_or(status = 'processed') OVER (PARTITION BY pubkey) AS hit FROM scores))"""

_TRUST: dict[tuple, dict[str, DataFrame]] = {}


def _as_read(spark: SparkSession, d: str) -> tuple:
    """Names the session and the state of the tables that the trust cycle reads."""
    files = [X.table(spark, d, t).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct() for t in ("customer", "orders")]
    all_of = F.sum(F.xxhash64("file_path", "file_size", "file_modification_time") % (1 << 40))
    return (spark.sparkContext.applicationId, d, *(f.agg(all_of).first()[0] for f in files))


def trust_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """edges, paths, accounts (with scores), status of the cycle over the test tables; built once for each state of these in a session."""
    key = _as_read(spark, d)
    if key not in _TRUST:
        intros = X.table(spark, d, "customer").where("c_custkey % 100 = 0").select(F.concat(F.lit("i"), "c_custkey").alias("endorsed_np"))
        path, account, root = T.seed_trust(spark, intros, X.SETTING)
        edges = materialized(T.build_trust_edges(X.endorsements(spark, d).unionByName(root), X.declarations(spark, d), X.source_invalidations(spark, d)), "edges")
        trust = T.trust_paths(path, account, edges, X.SETTING, bootstrap=(X.SETTING,))
        trust.paths, trust.accounts = materialized(trust.paths, "paths"), materialized(trust.accounts, "accounts")
        scores = materialized(T.account_scores(trust), "scores")
        third = F.substring("agent", 2, 20).cast("long") % 3 == 0
        live = X.declarations(spark, d).where(third).select("agent", "pubkey", F.lit("loaded").alias("status"))
        status = materialized(T.determine_updates(T.assign_pubkeys(scores), live), "status")
        _TRUST.clear()
        _TRUST[key] = {"edges": edges, "paths": trust.paths, "accounts": trust.accounts, "scores": scores, "status": status}
    return _TRUST[key]


def _endorsements(spark: SparkSession, d: str) -> DataFrame:
    """Those of the orders and those of the root."""
    intros = X.table(spark, d, "customer").where("c_custkey % 100 = 0").select(F.concat(F.lit("i"), "c_custkey").alias("endorsed_np"))
    return X.endorsements(spark, d).unionByName(T.seed_trust(spark, intros, X.SETTING)[2])


@query("SELECT '$' AS agent, '$' AS pubkey, 'i' || c_custkey AS endorsed_np, 'S' AS source, 'toRetrieve' AS status FROM customer WHERE c_custkey % 100 = 0")
def seed_trust(spark: SparkSession, d: str) -> DataFrame:
    return _endorsements(spark, d).where("agent = '$'")


@query(f"WITH {EDGES} SELECT * FROM edges")
def trust_edges(spark: SparkSession, d: str) -> DataFrame:
    return T.build_trust_edges(_endorsements(spark, d), X.declarations(spark, d), X.source_invalidations(spark, d))


@query(f"WITH {EDGES} SELECT * FROM followed")
def followed_edges(spark: SparkSession, d: str) -> DataFrame:
    return A.followed_edges(trust_edges(spark, d), (X.SETTING,))


@query(f"WITH {EDGES} SELECT * FROM fan")
def edge_fanout(spark: SparkSession, d: str) -> DataFrame:
    return T.edge_fanout(followed_edges(spark, d))


@query(f"WITH {EDGES} SELECT agent, pubkey, endorsed_np, source, CASE WHEN CAST(substr(endorsed_np, 2) AS BIGINT) % 6 = 0 THEN 'discarded' ELSE 'retrieved' END AS status FROM ends")
def endorsement_status(spark: SparkSession, d: str) -> DataFrame:
    intros = X.declarations(spark, d).where(F.substring("intro_np", 2, 20).cast("long") % 6 != 0)
    return T.endorsement_status(_endorsements(spark, d), intros).select("agent", "pubkey", "endorsed_np", "source", "status")


@query(f"WITH {INTROS} SELECT agent, pubkey, max_by(intro_name, created_at) FILTER (intro_name IS NOT NULL) AS name, max(created_at) FILTER (intro_name IS NOT NULL) AS name_created_at, min(intro_np) AS intro_np FROM decl GROUP BY ALL")
def account_names(spark: SparkSession, d: str) -> DataFrame:
    return T.resolve_account_names(X.declarations(spark, d))


@query(f"WITH {QUOTAS} SELECT '' AS agent, pubkey, 'toLoad' AS status, 0 AS depth, quota FROM q WHERE quota >= 0")
def seed_explicit(spark: SparkSession, d: str) -> DataFrame:
    return T.seed_explicit(_quotas(spark, d)[1].where("quota >= 0"))


@query(f"WITH {TRUST} SELECT * FROM paths")
def trust_paths(spark: SparkSession, d: str) -> DataFrame:
    return trust_tables(spark, d)["paths"]


@query(f"WITH {EDGES}, {_rounds(simple=True)} SELECT * FROM paths")
def simple_trust_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths that come to no account twice."""
    intros = X.table(spark, d, "customer").where("c_custkey % 100 = 0").select(F.concat(F.lit("i"), "c_custkey").alias("endorsed_np"))
    path, account, _ = T.seed_trust(spark, intros, X.SETTING)
    return T.trust_paths(path, account, materialized(trust_edges(spark, d), "edges"), X.SETTING, bootstrap=(X.SETTING,), simple_paths=True).paths


@query(f"WITH {TRUST} SELECT * FROM acc")
def trust_accounts(spark: SparkSession, d: str) -> DataFrame:
    return trust_tables(spark, d)["accounts"]


@query(f"WITH {SCORES} SELECT * FROM scores")
def account_scores(spark: SparkSession, d: str) -> DataFrame:
    return trust_tables(spark, d)["scores"]


def _named(spark: SparkSession, d: str, name: str = "scores") -> DataFrame:
    return trust_tables(spark, d)[name].join(T.resolve_account_names(X.declarations(spark, d)), T.KEY, "left")


AGENTS = SCORES + NAMES + """, ag AS (SELECT agent, CAST(count(*) AS INTEGER) AS account_count, CAST(sum(path_count) AS DOUBLE) / count(*) AS avg_path_count, """ + _exact_sum("ratio") + """ AS total_ratio,
  (list(name ORDER BY ratio DESC, name) FILTER (name IS NOT NULL))[1] AS name FROM scores LEFT JOIN names USING (agent, pubkey) WHERE status = 'processed' GROUP BY agent)"""


@query(f"WITH {AGENTS} SELECT * FROM ag")
def agents(spark: SparkSession, d: str) -> DataFrame:
    return T.aggregate_agents(_named(spark, d))


@query(f"WITH {STATUS} SELECT agent, pubkey, status FROM st")
def account_status(spark: SparkSession, d: str) -> DataFrame:
    return trust_tables(spark, d)["status"].select("agent", "pubkey", "status")


# --- snapshots


@query(f"WITH {STATUS} SELECT sha256(coalesce(string_agg(id || ' (' || type || ')' || chr(10), '' ORDER BY id), '')) AS trust_hash FROM paths ANTI JOIN (SELECT * FROM st WHERE status = 'toLoad') x USING (agent, pubkey)")
def trust_state_hash(spark: SparkSession, d: str) -> DataFrame:
    t = trust_tables(spark, d)
    return P.trust_state_hash(t["paths"], t["status"])


_XOR = " || ".join(f"printf('%08x', bit_xor(CAST(('0x' || substr(h, {1 + 8 * i}, 8)) AS BIGINT)))" for i in range(8))


@query(f"WITH {STATUS} SELECT {_XOR} AS fingerprint FROM (SELECT sha256(id || ' (' || type || ')') AS h FROM paths ANTI JOIN (SELECT * FROM st WHERE status = 'toLoad') x USING (agent, pubkey))")
def trust_state_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    t = trust_tables(spark, d)
    return P.fingerprint(t["paths"], t["status"])


@query(f"WITH {STATUS} SELECT agent, pubkey, status, depth, ratio, path_count, quota FROM st WHERE pubkey <> '$' AND status <> 'toLoad'")
def snapshot_accounts(spark: SparkSession, d: str) -> DataFrame:
    return P.snapshot_accounts(_named(spark, d, "status")).select("agent", "pubkey", "status", "depth", "ratio", "path_count", "quota")


@query(f"WITH {STATUS}, pub AS (SELECT agent, pubkey FROM st WHERE pubkey <> '$' AND status <> 'toLoad') SELECT from_agent, from_pubkey, to_agent, to_pubkey, CASE WHEN CAST(substr(source, 2) AS BIGINT) % 8 = 0 THEN 'http://full/' ELSE 'https://w3id.org/np/' END || source AS via_np FROM edges SEMI JOIN pub a ON from_agent = a.agent AND from_pubkey = a.pubkey SEMI JOIN pub b ON to_agent = b.agent AND to_pubkey = b.pubkey WHERE NOT invalidated")
def snapshot_edges(spark: SparkSession, d: str) -> DataFrame:
    pubs = X.table(spark, d, "orders").where("o_orderkey % 8 = 0").select(F.concat(F.lit("o"), "o_orderkey").alias("np_id"), F.concat(F.lit("http://full/o"), "o_orderkey").alias("full_id"))
    return P.snapshot_edges(trust_tables(spark, d)["edges"], P.snapshot_accounts(_named(spark, d, "status")), pubs)


@query(f"WITH {TRUST} SELECT CASE WHEN type = 'extended' THEN regexp_replace(replace(id, ' ', ' > '), ' > ([^ ]*)$', ' ~ \\1') ELSE replace(id, ' ', ' > ') END AS line FROM paths")
def trust_paths_text(spark: SparkSession, d: str) -> DataFrame:
    return P.trust_paths_text(trust_tables(spark, d)["paths"])


SHOWN = """, pub AS (SELECT * FROM st LEFT JOIN names USING (agent, pubkey) LEFT JOIN (SELECT agent, pubkey, max(created_at) FILTER (intro_name IS NOT NULL) AS name_created_at, coalesce(arg_max(intro_np, created_at) FILTER (intro_name IS NOT NULL), min(intro_np)) AS intro_np FROM decl GROUP BY ALL) USING (agent, pubkey) WHERE pubkey <> '$' AND status <> 'toLoad'),
via AS (SELECT from_agent, from_pubkey, to_agent, to_pubkey, CASE WHEN CAST(substr(source, 2) AS BIGINT) % 8 = 0 THEN 'http://full/' ELSE 'https://w3id.org/np/' END || source AS via_np FROM edges SEMI JOIN pub a ON from_agent = a.agent AND from_pubkey = a.pubkey SEMI JOIN pub b ON to_agent = b.agent AND to_pubkey = b.pubkey WHERE NOT invalidated)"""
TRUST_HASH = "(SELECT sha256(coalesce(string_agg(id || ' (' || type || ')' || chr(10), '' ORDER BY id), '')) FROM paths ANTI JOIN (SELECT * FROM st WHERE status = 'toLoad') x USING (agent, pubkey))"
FIELDS = ("pubkey", "agent", "name", "name_created_at", "intro_np", "status", "depth", "path_count", "ratio", "quota")


def _snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The state of the trust tables, published under counter 7."""
    t = trust_tables(spark, d)
    header = P.trust_state_hash(t["paths"], t["status"]).select(F.col("trust_hash").alias("hash"), F.lit(7).cast("long").alias("counter"), F.lit(NOW).cast("timestamp").alias("created_at"))
    return P.build_snapshot(header, P.snapshot_accounts(_named(spark, d, "status")), snapshot_edges(spark, d))


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """Some 120 earlier states of parts of it, made from the days of the events; the one with counter 3 has the hash of the state itself."""
    now = _snapshot(spark, d)
    n = F.col("event_id")
    older = X.table(spark, d, "events").where("event_id < 120").select(F.sha2(n.cast("string"), 256).alias("h"), (n - 113).alias("c"), F.col("ts").alias("t"))
    part = now.where(F.col("account.pubkey").endswith("5")).crossJoin(F.broadcast(older))  # at most 120 rows
    return part.select(F.when(F.col("c") == 3, F.col("hash")).otherwise(F.col("h")).alias("hash"), F.col("c").alias("counter"), F.col("t").alias("created_at"), "account", "edge")


def _flat(rows: DataFrame) -> DataFrame:
    return rows.select("hash", "counter", *[F.col(f"account.{c}").alias(c) for c in FIELDS], *[F.col(f"edge.{c}").alias(c) for c in P.EDGE])


_NO_EDGE, _NO_ACCOUNT = ", ".join(f"NULL AS {c}" for c in P.EDGE), ", ".join(f"NULL AS {c}" for c in FIELDS)
ENVELOPE = f"SELECT {TRUST_HASH} AS hash, CAST(7 AS BIGINT) AS counter, {', '.join(FIELDS)}, {_NO_EDGE} FROM pub UNION ALL SELECT {TRUST_HASH}, 7, {_NO_ACCOUNT}, {', '.join(P.EDGE)} FROM via"


@query(f"WITH {STATUS} {NAMES} {SHOWN} {ENVELOPE}")
def snapshot_by_hash(spark: SparkSession, d: str) -> DataFrame:
    """All accounts and edges of the state with the trust tables' hash, from the stored states after it was published."""
    stored = materialized(P.store_snapshot(_stored(spark, d), _snapshot(spark, d)), "snapshots")
    t = trust_tables(spark, d)
    return _flat(V.snapshot(stored, P.trust_state_hash(t["paths"], t["status"]).first().trust_hash))


PUBLISHED = f"old AS (SELECT sha256(CAST(event_id AS VARCHAR)) AS hash, event_id - 113 AS counter, ts AS created_at FROM events WHERE event_id < 120 AND event_id - 113 NOT IN (3)), snap AS (SELECT old.*, n FROM old, (SELECT count(*) AS n FROM pub WHERE pubkey LIKE '%5') WHERE n > 0 UNION ALL SELECT {TRUST_HASH}, 7, TIMESTAMP '{NOW}', (SELECT count(*) FROM pub) + (SELECT count(*) FROM via))"


@query(f"WITH {STATUS} {NAMES} {SHOWN}, {PUBLISHED} SELECT hash, counter, sum(n)::BIGINT AS n FROM snap WHERE counter IN (SELECT DISTINCT counter FROM snap ORDER BY counter DESC LIMIT 100) GROUP BY ALL")
def store_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The sizes of the stored states after one was published: an earlier one of the same hash is replaced, the last 100 counters stay."""
    return P.store_snapshot(_stored(spark, d), _snapshot(spark, d)).groupBy("hash", "counter").agg(F.count("*").alias("n"))


@query(f"WITH {STATUS} {NAMES} {SHOWN}, {PUBLISHED} SELECT DISTINCT hash, counter, created_at FROM snap WHERE n > 0")
def snapshot_index(spark: SparkSession, d: str) -> DataFrame:
    return V.snapshot_index(P.store_snapshot(_stored(spark, d), _snapshot(spark, d), keep=1000))


SNAPS = "snap AS (SELECT sha256(CAST(event_id AS VARCHAR)) AS hash, event_id AS counter, ts AS created_at FROM events)"


@query(f"WITH {SNAPS} SELECT * FROM snap ORDER BY counter DESC LIMIT 100")
def prune_snapshots(spark: SparkSession, d: str) -> DataFrame:
    events = X.table(spark, d, "events")
    return P.prune_snapshots(events.select(F.sha2(F.col("event_id").cast("string"), 256).alias("hash"), F.col("event_id").alias("counter"), F.col("ts").alias("created_at")))


@query(f"""WITH {STATUS}, ps AS (SELECT event_id, 'h' || (event_id % 7) AS new_hash, CASE WHEN event_id % 5 > 0 THEN 'h' || (event_id % 3) END AS previous_hash, CASE WHEN event_id % 4 > 0 THEN 'h' || (event_id % 6) END AS stored_hash, event_id AS counter FROM events),
act AS (SELECT *, CASE WHEN stored_hash IS NULL AND (SELECT count(*) FROM st WHERE status = 'toLoad') > 0 THEN 'hold' WHEN new_hash = previous_hash THEN 'keep' ELSE 'publish' END AS action FROM ps)
SELECT event_id, action, counter + CASE WHEN action = 'publish' AND new_hash IS DISTINCT FROM stored_hash THEN 1 ELSE 0 END AS next_counter, CASE WHEN action = 'publish' THEN new_hash ELSE stored_hash END AS next_hash FROM act""")
def publish_decision(spark: SparkSession, d: str) -> DataFrame:
    """One decision for each event, with hashes made of its id."""
    n, h = F.col("event_id"), lambda k: F.concat(F.lit("h"), F.col("event_id") % k)
    states = X.table(spark, d, "events").select("event_id", h(7).alias("new_hash"), F.when(n % 5 > 0, h(3)).alias("previous_hash"), F.when(n % 4 > 0, h(6)).alias("stored_hash"), n.alias("counter"))
    return P.publish_decision(states, trust_tables(spark, d)["status"]).select("event_id", "action", "next_counter", "next_hash")


@query(f"""WITH {STATUS} {NAMES} {SHOWN} SELECT agent, pubkey, NULL AS to_agent, NULL AS to_pubkey, NULL AS via_np, CASE WHEN a.pubkey LIKE '%b' THEN 'added' ELSE 'changed' END AS change FROM scores a JOIN st b USING (agent, pubkey) WHERE a.pubkey LIKE '%b' OR a.status <> b.status
UNION ALL SELECT DISTINCT from_agent, from_pubkey, to_agent, to_pubkey, via_np, CASE WHEN to_pubkey LIKE '%b' THEN 'added' ELSE 'removed' END FROM via WHERE to_pubkey LIKE '%b' OR to_pubkey LIKE '%7'""")
def diff_trust_states(spark: SparkSession, d: str) -> DataFrame:
    """Accounts and edges; the earlier state lacks keys that end in b, the later one edges to keys that end in 7."""
    t, edges = trust_tables(spark, d), snapshot_edges(spark, d)
    ends = lambda x: F.col("to_pubkey").endswith(x)
    accounts = P.diff_trust_states(t["scores"].where(~F.col("pubkey").endswith("b")), t["status"])
    changed = P.diff_edges(edges.where(~ends("b")), edges.where(~ends("7"))).withColumnsRenamed({"from_agent": "agent", "from_pubkey": "pubkey"})
    return accounts.unionByName(changed, allowMissingColumns=True)


# --- reports


@query(f"WITH {ENTRIES} SELECT np, position, checksum FROM e WHERE pubkey = sha256('1') AND type = '$'")
def list_of_key(spark: SparkSession, d: str) -> DataFrame:
    return V.list_of(_entries(spark, d), F.sha2(F.lit("1"), 256)).select("np", "position", "checksum")


def _write_list_store(spark: SparkSession, d: str, at: str) -> None:
    with shuffles_removed(spark):
        entries = materialized(_entries(spark, d), "entries", compression="zstd")
    store.write_list_store(entries, at, rows_per_file=2000)
    discard(entries)


@query(f"WITH {ENTRIES} SELECT np, position, checksum FROM e WHERE pubkey = sha256('1') AND type = '$' AND position > 3")
def stored_list_of_key(spark: SparkSession, d: str) -> DataFrame:
    """Behind position 3, from the files of a stored registry that hold it."""
    at = _folder(spark, "lists")
    _write_list_store(spark, d, at)
    return store.stored_list(spark, at, F.sha2(F.lit("1"), 256), after=3).select("np", "position", "checksum")


@query(f"WITH {HEADS} SELECT * FROM h WHERE pubkey = sha256('2')")
def stored_lists_of_key(spark: SparkSession, d: str) -> DataFrame:
    at = _folder(spark, "lists")
    _write_list_store(spark, d, at)
    return store.stored_lists_of(spark, at, F.sha2(F.lit("2"), 256))


@query(f"WITH {PEER} SELECT e.* FROM e LEFT JOIN ph USING (pubkey, type) WHERE position > coalesce(last, -1)")
def stored_list_delta(spark: SparkSession, d: str) -> DataFrame:
    """What a peer with nine tenths of the publications lacks, from two registries in buckets and the files behind what agrees."""
    pubs, at = X.publications(spark, d), _folder(spark, "lists")
    upto = pubs.agg(F.floor(F.max("counter") * 9 / 10).alias("upto"))
    peer = L.list_memberships(pubs.crossJoin(F.broadcast(upto)).where("counter <= upto").drop("upto"))  # one row
    with shuffles_removed(spark):
        entries = materialized(_entries(spark, d), "entries", compression="zstd")
        store.write_list_store(entries, f"{at}/sorted", rows_per_file=2000)
        own, theirs = store.write_buckets(entries, f"{at}/own", 8), store.write_buckets(L.list_entries(peer), f"{at}/peer", 8)
        discard(entries)
    return store.stored_delta(spark, f"{at}/sorted", own, spark.table(theirs))


@query(f"WITH {ENTRIES} SELECT e.pubkey, e.type, np, position, full_id, byte_count FROM e JOIN p ON np = np_id")
def list_contents(spark: SparkSession, d: str) -> DataFrame:
    return V.list_contents(_entries(spark, d), X.publications(spark, d)).select("pubkey", "type", "np", "position", "full_id", "byte_count")


@query(f"WITH {HEADS} SELECT pubkey, type, count, (SELECT any_value(event_type) FROM events WHERE sha256(event_type) = type AND event_type <> 'click') AS type_uri FROM h")
def lists_with_types(spark: SparkSession, d: str) -> DataFrame:
    known = N.record_hashes(X.table(spark, d, "events").where("event_type <> 'click'"), "event_type")
    return V.lists_of(L.list_heads(_entries(spark, d)), known).select("pubkey", "type", "count", "type_uri")


@query(f"WITH {STATUS}, n AS (SELECT 'k' || user_id AS pubkey, count(*) AS np_count FROM events GROUP BY 1) SELECT agent, pubkey, status, coalesce(np_count, 0) AS np_count FROM st LEFT JOIN n USING (pubkey) WHERE pubkey <> '$'")
def accounts_report(spark: SparkSession, d: str) -> DataFrame:
    heads = X.table(spark, d, "events").groupBy(F.concat(F.lit("k"), "user_id").alias("pubkey")).agg(F.count("*").alias("count")).withColumn("type", F.lit("$"))
    return V.accounts_report(trust_tables(spark, d)["status"], heads).select("agent", "pubkey", "status", "np_count")


@query(f"WITH {STATUS}, n AS (SELECT 'k' || user_id AS pubkey, count(*) AS np_count FROM events GROUP BY 1) SELECT agent, pubkey, status, coalesce(np_count, 0) AS np_count FROM st LEFT JOIN n USING (pubkey) WHERE agent = 'a0'")
def agent_accounts(spark: SparkSession, d: str) -> DataFrame:
    heads = X.table(spark, d, "events").groupBy(F.concat(F.lit("k"), "user_id").alias("pubkey")).agg(F.count("*").alias("count")).withColumn("type", F.lit("$"))
    return V.agent_accounts(trust_tables(spark, d)["status"], heads, "a0").select("agent", "pubkey", "status", "np_count")


@query(f"WITH {AGENTS} SELECT agent, total_ratio, agent = '$' AS is_root FROM ag")
def agents_ranked(spark: SparkSession, d: str) -> DataFrame:
    return V.agents_ranked(agents(spark, d)).select("agent", "total_ratio", "is_root")


@query(f"WITH {AGENTS} SELECT * FROM ag WHERE agent = 'a0'")
def agent_by_id(spark: SparkSession, d: str) -> DataFrame:
    return V.agent(agents(spark, d), "a0")


@query(f"WITH {PUBS} SELECT np_id, counter FROM p ORDER BY counter DESC LIMIT 1000")
def latest_publications(spark: SparkSession, d: str) -> DataFrame:
    return V.latest_publications(X.publications(spark, d)).select("np_id", "counter")


@query(f"WITH {PUBS} SELECT np_id, counter FROM p WHERE np_id > '8'")
def page_publications(spark: SparkSession, d: str) -> DataFrame:
    return V.page_publications(X.publications(spark, d), "8").select("np_id", "counter")


@query("SELECT DISTINCT sha256(CAST(user_id AS VARCHAR)) AS pubkey FROM events")
def pubkeys(spark: SparkSession, d: str) -> DataFrame:
    return V.pubkeys(L.list_memberships(X.publications(spark, d)))


@query(f"WITH {PUBS} SELECT np_id, counter FROM p WHERE event_id IN (SELECT c_custkey * 3 FROM customer)")
def publications_by_id(spark: SparkSession, d: str) -> DataFrame:
    ids = X.table(spark, d, "customer").select(F.sha2((F.col("c_custkey") * 3).cast("string"), 256).alias("np_id"))
    return V.publications_by_id(X.publications(spark, d), ids).select("np_id", "counter")


@query(f"WITH {STATUS}, ag AS (SELECT DISTINCT agent FROM scores WHERE status = 'processed') SELECT (SELECT count(*) FROM events) AS publications, (SELECT max(event_id) + 1 FROM events) AS load_counter, (SELECT count(*) FROM acc) AS accounts, (SELECT count(*) FROM ag) AS agents, {TRUST_HASH} AS trust_hash, CAST(7 AS BIGINT) AS trust_counter, 'click view' AS coverage_types, 'viaSetting' AS coverage_agents, 'S' AS current_setting, 'S0' AS original_setting, 'ready' AS status")
def registry_summary(spark: SparkSession, d: str) -> DataFrame:
    t = trust_tables(spark, d)
    trust = P.trust_state_hash(t["paths"], t["status"]).withColumn("trust_counter", F.lit(7).cast("long"))
    return V.registry_summary(X.publications(spark, d), t["accounts"], agents(spark, d), trust, "click view", settings=(X.SETTING, "S0"), status="ready")


@query(f"WITH {STATUS} SELECT status, count(*) AS n FROM st GROUP BY 1")
def status_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return V.status_breakdown(trust_tables(spark, d)["status"])


@query(f"WITH {EDGES} SELECT agent, pubkey, endorsed_np, source, 'toRetrieve' AS status FROM ends")
def endorsements_report(spark: SparkSession, d: str) -> DataFrame:
    return V.endorsements_report(_endorsements(spark, d))


@query(f"WITH {TRUST} SELECT agent, pubkey, depth, status FROM acc")
def accounts_debug(spark: SparkSession, d: str) -> DataFrame:
    return V.accounts_debug(trust_tables(spark, d)["accounts"])


@query(f"WITH {PEERS} SELECT url, setup_id, load_counter FROM pe")
def peer_state(spark: SparkSession, d: str) -> DataFrame:
    return V.peer_state(G.eligible_peers(_peers(spark, d)))


# --- streams over the events, which land in parts


STREAMED = ["np_id", "full_id", "counter", "pubkey", "types", "created_at", "triple_count", "byte_count", "is_protected", "graph_uris", "sig_pubkey"]


def _fed(spark: SparkSession, pubs: DataFrame, start: Callable[[DataFrame, str], StreamingQuery], overlap: bool = False, times: int = 4, mixed: bool = False) -> str:
    """Lets publications land so many times, and a stream take each time what is new; gives the folder of its results.

    They land in counter order, or (mixed) by counter modulo times. overlap: some of the next publications come as well,
    and so come twice.
    """
    at, c = _folder(spark, "stream"), F.col("counter")
    top = pubs.agg(F.max("counter")).first()[0] or 0
    for i in range(times):
        low, high = top * i // times, top * (i + 1) // times + (top // 20 if overlap else 0)
        pubs.where(c % times == i if mixed else (c > low) & (c <= high)).write.mode("append").parquet(f"{at}/in")
        start(feeds.stream_publications(spark, f"{at}/in", schema=", ".join([schemas.PUBLICATIONS, *[f"{f.name} {f.dataType.simpleString()}" for f in pubs.schema if f.name not in STREAMED]])), at).awaitTermination()
    return at


def _streamed(spark: SparkSession, d: str) -> DataFrame:
    return X.publications(spark, d).select(*STREAMED)


@query(f"WITH {ENTRIES} SELECT * FROM e")
def stream_append_lists(spark: SparkSession, d: str) -> DataFrame:
    at = _fed(spark, _streamed(spark, d), lambda stream, at: listing.stream_append_lists(stream, f"{at}/lists", f"{at}/checkpoint"), overlap=True)
    return listing.list_table(spark, f"{at}/lists")


@query(f"WITH {ENTRIES} SELECT * FROM e")
def stream_continued_lists(spark: SparkSession, d: str) -> DataFrame:
    """Two streams one after the other, each with a checkpoint of its own: the second goes on from the lists of the first."""
    turn = iter("aabb")
    at = _fed(spark, _streamed(spark, d), lambda stream, at: listing.stream_append_lists(stream, f"{at}/lists", f"{at}/checkpoint-{next(turn)}"), overlap=True)
    return listing.list_table(spark, f"{at}/lists")


INHERITED = "inh AS (SELECT DISTINCT a.pubkey, a.type, b.np_id AS np, b.counter FROM m a JOIN inv ON a.np = invalidated_np AND a.pubkey = invalidating_pubkey JOIN p b ON b.np_id = invalidating_np WHERE NOT (a.type = '$' OR a.type = b.type))"


@query(f"WITH {INVALID}, m AS (SELECT pubkey, '$' AS type, np_id AS np, counter FROM p UNION ALL SELECT pubkey, type, np_id, counter FROM p), {INHERITED}, both_ AS (SELECT * FROM m UNION ALL SELECT * FROM inh) SELECT *, EXISTS (SELECT 1 FROM inv WHERE invalidated_np = np AND invalidating_pubkey = pubkey) AS invalidated FROM both_")
def stream_invalidations(spark: SparkSession, d: str) -> DataFrame:
    """Members of the lists, inherited ones as well, and which of them are invalidated. Invalidations land before and after what they invalidate."""
    told = X.invalidations(spark, d).groupBy(F.col("invalidating_np").alias("np_id")).agg(F.collect_set("invalidated_np").alias("invalidates"))  # at most 41 each
    with shuffles_removed(spark):
        pubs = materialized(_streamed(spark, d).join(told, "np_id", "left"), "told", compression="zstd")
    at = _fed(spark, pubs, lambda stream, at: listing.stream_invalidations(stream, f"{at}/lists", f"{at}/checkpoint"), mixed=True)
    members = L.list_memberships(pubs).unionByName(listing.inherited_members(spark, f"{at}/lists"))
    marks = listing.invalidation_marks(spark, f"{at}/lists").withColumn("hit", F.lit(True))
    return members.join(marks, ["pubkey", "np"], "left").select("pubkey", "type", "np", "counter", F.col("hit").isNotNull().alias("invalidated"))


@query(f"WITH {PUBS} SELECT np_id, counter, byte_count FROM p WHERE counter > 100")
def stream_by_counter(spark: SparkSession, d: str) -> DataFrame:
    """What a store holds behind counter 100; half of it comes after the stream has run once."""
    at, pubs = _folder(spark, "counted"), _streamed(spark, d)
    top = pubs.agg(F.max("counter")).first()[0] or 0
    for part in (pubs.where(F.col("counter") <= top // 2), pubs.where(F.col("counter") > top // 2)):
        counter_source.write_spans(part, f"{at}/in", span=1000)
        stream = counter_source.stream_by_counter(spark, f"{at}/in", after=100, span=1000)
        stream.select("np_id", "counter", "byte_count").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("np_id string, counter bigint, byte_count bigint").parquet(f"{at}/out")


@query(f"WITH {PUBS} SELECT np_id FROM p")
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    def start(stream: DataFrame, at: str) -> StreamingQuery:
        return feeds.stream_dedupe(stream).select("np_id").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()

    return spark.read.schema("np_id string").parquet(f"{_fed(spark, _streamed(spark, d), start, overlap=True, times=2)}/out")


@query(f"WITH {PUBS} SELECT np_id, {REASON} AS reject_reason, CASE WHEN {REASON} IS NULL THEN 'admitted' ELSE 'rejected' END AS found_in FROM p WHERE event_type IN ('click', 'view')")
def stream_admit(spark: SparkSession, d: str) -> DataFrame:
    """The two tables that admission makes in one pass."""
    at = _fed(spark, _streamed(spark, d), lambda stream, at: feeds.stream_admit(stream, F.lit(NOW).cast("timestamp"), f"{at}/sorted", f"{at}/checkpoint", "click view"))
    of = lambda name: feeds.outcome_of(spark, f"{at}/sorted", name).select("np_id", "reject_reason", F.lit(name).alias("found_in"))
    return of("admitted").unionByName(of("rejected"))


@query(f"{CAPPED} SELECT np_id, counter FROM r WHERE nth <= quota")
def stream_quota_gate(spark: SparkSession, d: str) -> DataFrame:
    """Each key has two publications when the stream begins."""
    keys, quotas = _quotas(spark, d)
    pubs = _streamed(spark, d)
    at = _fed(spark, pubs, lambda stream, at: listing.stream_quota_gate(stream, quotas, f"{at}/gate", f"{at}/checkpoint", keys.withColumn("count", F.lit(2))))
    return listing.passed_publications(spark, f"{at}/gate", schemas.PUBLICATIONS).select("np_id", "counter")


@query(f"WITH {PUBS} SELECT time_bucket(INTERVAL 1 HOUR, created_at) AS start, count(*) AS n, CAST(sum(byte_count) AS BIGINT) AS bytes FROM p GROUP BY 1 HAVING time_bucket(INTERVAL 1 HOUR, max(created_at)) + INTERVAL 1 HOUR <= (SELECT max(created_at) FROM p) - INTERVAL 2 HOUR")
def stream_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The hours that are over by more than two hours when the last publication has come."""
    at = _fed(spark, _streamed(spark, d), lambda stream, at: feeds.stream_metrics(stream, f"{at}/metrics", f"{at}/checkpoint", late="2 hours"))
    return feeds.metric_table(spark, f"{at}/metrics")


@query(f"""WITH {PUBS}, w AS (SELECT time_bucket(INTERVAL 10 MINUTE, created_at) AS start, count(*) AS n FROM p GROUP BY 1),
g AS (SELECT unnest(generate_series((SELECT min(start) FROM w), (SELECT max(start) FROM w), INTERVAL 10 MINUTE)) AS start), f AS (SELECT start, coalesce(n, 0) AS n FROM g LEFT JOIN w USING (start))
SELECT start, n, CAST(sum(n) OVER (ORDER BY start) AS BIGINT) AS total, n / CAST(600 AS DOUBLE) AS per_second, n - lag(n) OVER (ORDER BY start) AS change FROM f""")
def metric_rates(spark: SparkSession, d: str) -> DataFrame:
    """Each ten minutes, also those without publications, gone through in ranges of a day or so."""
    return feeds.metric_rates(feeds.metrics(X.publications(spark, d), "10 minutes"), every_seconds=600, per_range=150)


RELEASED = f"""WITH {STATED}, edges AS MATERIALIZED (SELECT * FROM stated UNION ALL SELECT '$', '$', agent, pubkey, 'S', FALSE FROM ci WHERE c % 100 = 0), {FOLLOW}, {_rounds()} {FOLD},
st AS MATERIALIZED (SELECT agent, pubkey, CASE WHEN status <> 'processed' THEN status WHEN c % 3 <> 0 THEN 'loaded' ELSE 'toLoad' END AS status, depth, ratio, path_count, quota, name, created_at, np FROM scores LEFT JOIN ci USING (agent, pubkey)),
pub AS (SELECT * FROM st WHERE pubkey <> '$' AND status <> 'toLoad'), v AS (SELECT from_agent, from_pubkey, to_agent, to_pubkey, 'https://w3id.org/np/' || source AS via_np FROM edges SEMI JOIN pub a ON from_agent = a.agent AND from_pubkey = a.pubkey SEMI JOIN pub b ON to_agent = b.agent AND to_pubkey = b.pubkey WHERE NOT invalidated)"""


@query(f"""{RELEASED} SELECT {TRUST_HASH} AS hash, CAST(2 AS BIGINT) AS counter, pubkey, agent, name, created_at AS name_created_at, np AS intro_np, status, depth, path_count, ratio, quota, {_NO_EDGE} FROM pub
UNION ALL SELECT {TRUST_HASH}, 2, {_NO_ACCOUNT}, {', '.join(P.EDGE)} FROM v""")
def recompute_trust(spark: SparkSession, d: str) -> DataFrame:
    """The snapshot that the second of two cycles publishes, from statements that land in two parts. Two thirds of the agents are loaded."""
    at, pubs, quads = _folder(spark, "cycle"), X.statement_publications(spark, d), X.statement_quads(spark, d)
    said = quads.groupBy("np_id").agg(F.collect_list(F.struct("graph", "subj", "pred", "obj", "obj_is_iri")).alias("statements"))  # a handful each
    landed = pubs.join(said, "np_id").select("np_id", F.lit(None).cast("string").alias("full_id"), "pubkey", "types", "created_at", "statements")
    c = X.table(spark, d, "customer")
    elements = c.where("c_custkey % 100 = 0").select(X.code_of(F.concat(F.lit("i"), "c_custkey")).alias("endorsed_np"))
    live = c.where("c_custkey % 3 <> 0").select(F.concat(F.lit("a"), "c_custkey").alias("agent"), S.hash_of(F.concat(F.lit("K"), "c_custkey")).alias("pubkey"), F.lit("loaded").alias("status"))
    for part in ("substring(np_id, 3, 1) < 'a'", "substring(np_id, 3, 1) >= 'a'"):
        landed.where(part).write.mode("append").parquet(f"{at}/in")
        cycle.recompute_trust(cycle.stream_landed(spark, f"{at}/in"), X.SETTING, elements, live, f"{at}/trust", f"{at}/checkpoint", full_load=False, now=NOW).awaitTermination()
    found = cycle.released(spark, f"{at}/trust")
    return _flat(V.snapshot(found["snapshots"], found["state"].first().stored_hash))


# --- sources and sinks, by way of files in the shared folder


@query(f"WITH {PUBS} SELECT np_id, counter, byte_count, len(graph) AS graphs FROM p, (SELECT [1, 2] AS graph) WHERE counter % 2 = 0")
def read_publications(spark: SparkSession, d: str) -> DataFrame:
    at = _folder(spark, "publications")
    X.publications(spark, d).select(*STREAMED).write.parquet(at)
    return tables.read_publications(spark, at).where("counter % 2 = 0").select("np_id", "counter", "byte_count", F.size("graph_uris").cast("long").alias("graphs"))


@query(f"WITH {PUBS} SELECT DISTINCT pubkey AS np_id FROM p WHERE pubkey NOT IN (SELECT sha256(CAST(c_custkey AS VARCHAR)) FROM customer WHERE c_custkey % 2 = 0)")
def read_id_feed(spark: SparkSession, d: str) -> DataFrame:
    """A feed with the key of each event on a line between blank ones, against keys that are known."""
    at = _folder(spark, "feed")
    X.publications(spark, d).select(F.explode(F.array(F.lit("  "), F.concat(F.lit(" "), "pubkey", F.lit(" ")))).alias("value")).write.text(at)
    known = X.table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.sha2(F.col("c_custkey").cast("string"), 256).alias("np_id"))
    return tables.read_id_feed(spark, at, known)


@query("SELECT DISTINCT sha256(CAST(user_id AS VARCHAR)) AS pubkey FROM events")
def read_peer_pubkeys(spark: SparkSession, d: str) -> DataFrame:
    """Keys that peers give as JSON arrays, one peer for each event type."""
    at = _folder(spark, "peers")
    keys = X.publications(spark, d).groupBy("event_type").agg(F.collect_set("pubkey").alias("keys"))
    keys.select("event_type", F.to_json("keys").alias("value")).write.partitionBy("event_type").text(at)
    return tables.read_peer_pubkeys(spark, f"{at}/*")


@query(f"WITH {HEADS} SELECT * FROM h")
def write_table(spark: SparkSession, d: str) -> DataFrame:
    """Two versions of a table, of which readers find the second."""
    at, heads = _folder(spark, "heads"), list_heads(spark, d)
    tables.write_table(heads.where("type = '$'"), at)
    tables.write_table(heads, at, ("type",))
    return tables.read_table(spark, at)


@query(f"WITH {HEADS} SELECT pubkey, type, count, checksum FROM h")
def write_json_export(spark: SparkSession, d: str) -> DataFrame:
    """Keys with their lists, as nested JSON that is read again."""
    at = _folder(spark, "json")
    tables.write_json_export(list_heads(spark, d).groupBy("pubkey").agg(F.collect_list(F.struct("type", "count", "checksum")).alias("lists")), at)
    read = spark.read.schema("pubkey string, lists array<struct<type:string,count:bigint,checksum:string>>").json(at)
    return read.select("pubkey", F.inline("lists"))
