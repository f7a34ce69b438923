"""Registry tables derived from the test tables, so that every operator runs on given data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attest.functions.scalars import NANOPUB, ROOT, hash_of
from attest.operators.quads import APPROVES, DECLARED_BY, HAS_ASSERTION, HAS_KEY, INVALIDATES, NAME, RETRACTS, SUPERSEDES

SETTING = "S"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One publication an event: np_id, counter and key follow from its ids, sizes from its value; event_id and k are kept."""
    e = table(spark, sf_dir, "events")
    np_id, i = hash_of(F.col("event_id").cast("string")), F.col("event_id")
    full = F.when(i % 109 == 0, F.lit("https://example.org/none")).otherwise(F.concat(F.lit("https://w3id.org/np/RA"), F.substring(np_id, 1, 43)))
    key = hash_of(F.col("user_id").cast("string"))
    return e.select(
        np_id.alias("np_id"), full.alias("full_id"), (i + 1).alias("counter"), key.alias("pubkey"), F.array(hash_of(F.col("event_type"))).alias("types"), F.col("ts").alias("created_at"),
        ((i * 7919) % 1300).cast("int").alias("triple_count"), F.floor(F.col("value") * 20000).cast("long").alias("byte_count"), (i % 50 == 7).alias("is_protected"),
        F.array(F.concat(full, F.lit("/head")), F.when(i % 107 == 0, F.lit("http://other.example/g")).otherwise(F.concat(full, F.lit("/assertion")))).alias("graph_uris"),
        F.when(i % 101 == 0, None).when(i % 103 == 0, hash_of(F.lit("x"))).otherwise(key).alias("sig_pubkey"), "event_type", "event_id", "user_id", F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("k"),
    )


def invalidations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 20th event invalidates the event before it, whoever owns it; events with id % 10 = 5 invalidate their user's events among the 40 before."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    other = e.select((F.col("event_id") + 1).alias("event_id"), F.col("event_id").alias("target")).where("event_id % 20 = 0")
    own = e.select(F.col("event_id").alias("target"), F.col("user_id").alias("owner"), F.explode(F.sequence(F.col("event_id") + 1, F.col("event_id") + 40)).alias("event_id")).where("event_id % 10 = 5")
    pairs = e.join(other, "event_id").select("event_id", "user_id", "target").unionByName(e.join(own, "event_id").where("user_id = owner").select("event_id", "user_id", "target"))
    return pairs.select(hash_of(F.col("event_id").cast("string")).alias("invalidating_np"), hash_of(F.col("user_id").cast("string")).alias("invalidating_pubkey"), hash_of(F.col("target").cast("string")).alias("invalidated_np"))


def declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Introductions: customer c declares key k<c>; c % 5 = 0 also k<c>b; c % 17 = 0 takes k<c-1>, which so is contested."""
    c = table(spark, sf_dir, "customer")
    i = F.col("c_custkey")
    first = F.concat(F.lit("k"), F.when((i % 17 == 0) & (i > 0), i - 1).otherwise(i))
    keys = F.when(i % 5 == 0, F.array(first, F.concat(F.lit("k"), i, F.lit("b")))).otherwise(F.array(first))
    created = F.expr("timestamp'2020-01-01 00:00:00' + make_dt_interval(cast(c_custkey % 1000 as int))")
    return c.select(F.concat(F.lit("i"), i).alias("intro_np"), F.concat(F.lit("a"), i).alias("agent"), F.explode(keys).alias("pubkey"), F.when(i % 7 != 3, F.col("c_name")).alias("intro_name"), created.alias("created_at"))


def endorsements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth order is an endorsement by its customer's first key."""
    o, n = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").agg(F.count("*").alias("n"))
    c = F.col("o_custkey")
    key = F.concat(F.lit("k"), F.when((c % 17 == 0) & (c > 0), c - 1).otherwise(c))
    target = F.concat(F.lit("i"), (F.col("o_orderkey") * 31 + c * 7) % F.col("n"))
    by = o.where("o_orderkey % 4 = 0").crossJoin(F.broadcast(n))  # one row
    return by.select(F.concat(F.lit("a"), c).alias("agent"), key.alias("pubkey"), target.alias("endorsed_np"), F.concat(F.lit("o"), "o_orderkey").alias("source"), F.lit("toRetrieve").alias("status"))


def source_invalidations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with status P have invalidated their endorsement; the setting was superseded too."""
    o, c = table(spark, sf_dir, "orders").where("o_orderkey % 4 = 0 AND o_orderstatus = 'P'"), F.col("o_custkey")
    key = F.concat(F.lit("k"), F.when((c % 17 == 0) & (c > 0), c - 1).otherwise(c))
    rows = o.select(F.concat(F.lit("x"), "o_orderkey").alias("invalidating_np"), key.alias("invalidating_pubkey"), F.concat(F.lit("o"), "o_orderkey").alias("invalidated_np"))
    return rows.unionByName(spark.range(1).select(F.lit("S2").alias("invalidating_np"), F.lit(ROOT).alias("invalidating_pubkey"), F.lit(SETTING).alias("invalidated_np")))


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of the events: those with k % 4 < 3 retract, invalidate or supersede the publication before."""
    p = publications(spark, sf_dir)
    g, i = F.concat("full_id", F.lit("/assertion")), F.col("event_id")
    target = F.concat(F.lit("https://w3id.org/np/RA"), F.substring(hash_of((i - 1).cast("string")), 1, 43))
    pred = F.element_at(F.array(F.lit(RETRACTS), F.lit(INVALIDATES), F.lit(SUPERSEDES), F.lit("http://example.org/cites")), F.col("k") % 4 + 1)
    return p.where("event_id > 0").select("np_id", g.alias("graph"), F.when(F.col("k") % 3 == 0, F.lit("http://example.org/thing")).otherwise(F.col("full_id")).alias("subj"), pred.alias("pred"), target.alias("obj"), F.lit(True).alias("obj_is_iri"))


def code_of(name: Column) -> Column:
    """An artifact code made of a name."""
    return F.concat(F.lit("RA"), F.substring(hash_of(name), 1, 43))


def _published(statements: DataFrame) -> DataFrame:
    """Quads of publications (np_id, graph: assertion or pubinfo, subj, pred, obj, obj_is_iri), with heads that name the assertions."""
    uri = F.concat(F.lit(NANOPUB), "np_id")
    head = statements.select("np_id").distinct().select("np_id", F.concat(uri, F.lit("/head")).alias("graph"), uri.alias("subj"), F.lit(HAS_ASSERTION).alias("pred"), F.concat(uri, F.lit("/assertion")).alias("obj"), F.lit(True).alias("obj_is_iri"))
    return head.unionByName(statements.withColumn("graph", F.concat(uri, F.lit("/"), F.col("graph"))))


def _said(graph: str, subj: Column, pred: str, obj: Column, iri: bool) -> Column:
    return F.struct(F.lit(graph).alias("graph"), subj.alias("subj"), F.lit(pred).alias("pred"), obj.alias("obj"), F.lit(iri).alias("obj_is_iri"))


def statement_publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Introductions i<c> and endorsements o<k> as publications: np_id, pubkey, types, created_at. Every tenth endorsement has another type."""
    c, k = F.col("c_custkey"), F.col("o_orderkey")
    created = F.expr("timestamp'2020-01-01 00:00:00' + make_dt_interval(cast(c_custkey % 1000 as int))")
    intros = table(spark, sf_dir, "customer").select(code_of(F.concat(F.lit("i"), c)).alias("np_id"), hash_of(F.concat(F.lit("K"), c)).alias("pubkey"), F.array(hash_of(F.lit(DECLARED_BY))).alias("types"), created.alias("created_at"))
    ends = table(spark, sf_dir, "orders").where("o_orderkey % 4 = 0").select(code_of(F.concat(F.lit("o"), k)).alias("np_id"), hash_of(F.concat(F.lit("K"), "o_custkey")).alias("pubkey"), F.array(hash_of(F.when(k % 40 == 0, F.lit("other")).otherwise(F.lit(APPROVES)))).alias("types"), F.lit(None).cast("timestamp").alias("created_at"))
    return intros.unionByName(ends)


def statement_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What these publications state, and what must not count: names, keys and approvals in the pubinfo graph, approvals for others."""
    c, k = table(spark, sf_dir, "customer"), F.col("o_orderkey")
    i, who = F.col("c_custkey"), F.concat(F.lit("a"), "c_custkey")
    key = lambda x: F.concat(F.lit("K"), x)
    node, name = F.concat(F.lit("#d"), i), F.col("c_name")
    rows = [
        _said("assertion", node, DECLARED_BY, who, True), _said("assertion", node, HAS_KEY, key(i), False), _said("pubinfo", node, HAS_KEY, key(F.concat(F.lit("x"), i)), False),
        _said("pubinfo", who, NAME, F.concat(F.lit("A "), name), False), _said("assertion", who, NAME, F.concat(F.lit("B "), name), False), _said("assertion", F.lit("other"), NAME, F.concat(F.lit("A "), name), False),
    ]
    intros = c.select(code_of(F.concat(F.lit("i"), i)).alias("np_id"), F.explode(F.array(*rows)).alias("q")).select("np_id", "q.*")
    agent, target = F.concat(F.lit("a"), "o_custkey"), F.concat(F.lit(NANOPUB), code_of(F.concat(F.lit("i"), (k * 31 + F.col("o_custkey") * 7) % F.col("n"))))
    said = F.array(_said("assertion", agent, APPROVES, target, True), _said("pubinfo", agent, APPROVES, F.concat(F.lit(NANOPUB), code_of(F.lit("i1"))), True), _said("assertion", F.lit("a0x"), APPROVES, target, True), _said("assertion", agent, APPROVES, F.lit("no code"), False))
    others = F.filter(F.array(F.when(k % 12 == 0, _said("assertion", F.col("uri"), RETRACTS, F.concat(F.lit(NANOPUB), code_of(F.concat(F.lit("o"), k - 4))), True))), lambda x: x.isNotNull())
    ends = table(spark, sf_dir, "orders").where("o_orderkey % 4 = 0").crossJoin(F.broadcast(c.agg(F.count("*").alias("n")))).withColumn("np_id", code_of(F.concat(F.lit("o"), k))).withColumn("uri", F.concat(F.lit(NANOPUB), "np_id"))  # one row
    return _published(intros.unionByName(ends.select("np_id", F.explode(F.concat(said, others)).alias("q")).select("np_id", "q.*")))
