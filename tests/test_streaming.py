from __future__ import annotations

import itertools
import json

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from attest import schemas
from attest.operators.lists import heads_of_members, inherit_invalidations, list_entries, list_heads, list_memberships
from attest.sources import tables
from attest.streaming import counter_source, cycle, feeds, listing, runs


def publications(spark, n, keys=3):
    i = F.col("id")
    return spark.range(n).select(
        F.concat(F.lit("n"), i).alias("np_id"), F.concat(F.lit("https://w3id.org/np/RA"), F.substring(F.sha2(i.cast("string"), 256), 1, 43)).alias("full_id"), (i + 1).alias("counter"), F.concat(F.lit("k"), i % keys).alias("pubkey"),
        F.array(F.concat(F.lit("t"), i % 2)).alias("types"), F.timestamp_seconds(i * 600 + 86_400).alias("created_at"), F.lit(1).alias("triple_count"), i.alias("byte_count"), F.lit(False).alias("is_protected"), F.array("id").cast("array<string>").alias("graph_uris"), F.concat(F.lit("k"), i % keys).alias("sig_pubkey"),
    )


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


COLUMNS = ["pubkey", "type", "np", "counter", "position", "checksum"]


def rows(df, columns=COLUMNS):
    return sorted(map(tuple, df.select(*columns).collect()))


def between(df, low, high):
    return df.where((F.col("counter") > low) & (F.col("counter") <= high))


def landed(spark, at, pubs, schema=schemas.PUBLICATIONS):
    pubs.write.mode("append").parquet(f"{at}/in")
    return feeds.stream_publications(spark, f"{at}/in", schema=schema)


def test_lists_over_restarts_with_members_that_come_again(spark, tmp_path):
    """Each start goes on from its checkpoint; overlapping parts add nothing."""
    pubs, at = publications(spark, 60), str(tmp_path)
    for low, high in [(0, 20), (10, 30), (5, 60)]:
        listing.stream_append_lists(landed(spark, at, between(pubs, low, high)), f"{at}/lists", f"{at}/c").awaitTermination()
    got = listing.list_table(spark, f"{at}/lists")
    assert rows(got) == rows(list_entries(list_memberships(pubs)))


def test_a_new_checkpoint_goes_on_from_the_lists_that_are_there(spark, tmp_path):
    pubs, at = publications(spark, 60), str(tmp_path)
    for run, (low, high) in zip("abcb", [(0, 20), (10, 40), (0, 60), (60, 60)]):
        listing.stream_append_lists(landed(spark, f"{at}/{run}", between(pubs, low, high)), f"{at}/lists", f"{at}/c-{run}").awaitTermination()
    assert rows(listing.list_table(spark, f"{at}/lists")) == rows(list_entries(list_memberships(pubs)))


def test_a_checkpoint_of_the_same_name_overwrites_nothing(spark, tmp_path):
    """As when a checkpoint is lost and the stream is started again in its place."""
    pubs, at = publications(spark, 40), str(tmp_path)
    listing.stream_append_lists(landed(spark, f"{at}/one", between(pubs, 0, 20)), f"{at}/lists", f"{at}/c").awaitTermination()
    (tmp_path / "c").rename(tmp_path / "lost")
    listing.stream_append_lists(landed(spark, f"{at}/two", between(pubs, 20, 40)), f"{at}/lists", f"{at}/c").awaitTermination()
    assert rows(listing.list_table(spark, f"{at}/lists")) == rows(list_entries(list_memberships(pubs)))


def test_a_batch_done_again_after_a_crash(spark, tmp_path):
    """The write is done, but the batch is not committed: it is done again from the same state."""
    pubs, at = publications(spark, 30), str(tmp_path)
    listing.stream_append_lists(landed(spark, at, between(pubs, 0, 20)), f"{at}/lists", f"{at}/c").awaitTermination()
    listing.stream_append_lists(landed(spark, at, between(pubs, 20, 30)), f"{at}/lists", f"{at}/c").awaitTermination()
    before = rows(listing.list_table(spark, f"{at}/lists"))
    last = max(int(p.name) for p in (tmp_path / "c" / "commits").iterdir() if p.name.isdigit())
    for p in (tmp_path / "c" / "commits").iterdir():
        if p.name.strip(".crc") == str(last):
            p.unlink()
    listing.stream_append_lists(feeds.stream_publications(spark, f"{at}/in"), f"{at}/lists", f"{at}/c").awaitTermination()
    assert rows(listing.list_table(spark, f"{at}/lists")) == before == rows(list_entries(list_memberships(pubs)))


def test_a_batch_reads_no_history(spark, tmp_path):
    """Rows read by a micro-batch are those that have come, however long the lists are."""
    pubs, at = publications(spark, 3000), str(tmp_path)
    for low, high in [(0, 2900), (2900, 2950)]:
        query = listing.stream_append_lists(landed(spark, at, between(pubs, low, high)), f"{at}/lists", f"{at}/c")
        query.awaitTermination()
    assert sum(p["numInputRows"] for p in [json.loads(p.json) for p in query.recentProgress]) == 50
    tops = {o["operatorName"]: o["numRowsTotal"] for o in json.loads(query.recentProgress[-1].json)["stateOperators"]}
    assert rows(list_heads(listing.list_table(spark, f"{at}/lists")), ["pubkey", "type", "count", "checksum"]) == rows(heads_of_members(list_memberships(between(pubs, 0, 2950))), ["pubkey", "type", "count", "checksum"])
    assert tops


@pytest.mark.parametrize("first", ["targets", "invalidators", "together"])
def test_invalidations_in_either_order(spark, tmp_path, first):
    pubs, at = publications(spark, 60), str(tmp_path)
    i = F.col("counter") - 1
    of = lambda d: F.concat(F.lit("n"), i + d)
    told = pubs.withColumn("invalidates", F.when(i % 8 == 1, F.array(of(-3), of(3), of(6), of(1), F.lit("nowhere"))))  # other type, other type, own type, other key
    schema = f"{schemas.PUBLICATIONS}, invalidates array<string>"
    hit = F.col("invalidates").isNotNull()
    parts = {"targets": [~hit, hit], "invalidators": [hit, ~hit], "together": [F.lit(True)]}[first]
    for part in parts if first == "targets" else [*parts, parts[0]]:  # what comes twice adds nothing
        listing.stream_invalidations(landed(spark, at, told.where(part), schema), f"{at}/lists", f"{at}/c").awaitTermination()
    pairs = told.select(F.col("np_id").alias("invalidating_np"), F.col("pubkey").alias("invalidating_pubkey"), F.explode("invalidates").alias("invalidated_np"))
    want = inherit_invalidations(list_memberships(pubs), pairs, pubs)
    members = ["pubkey", "type", "np", "counter"]
    assert rows(listing.inherited_members(spark, f"{at}/lists"), members) == rows(want, members) and want.count() > 5
    marked = pairs.join(pubs, (F.col("np_id") == F.col("invalidated_np")) & (F.col("pubkey") == F.col("invalidating_pubkey"))).select("pubkey", F.col("np_id").alias("np")).distinct()
    assert rows(listing.invalidation_marks(spark, f"{at}/lists"), ["pubkey", "np"]) == rows(marked, ["pubkey", "np"])


def test_inherited_members_can_be_listed_in_the_same_stream(spark, tmp_path):
    pubs, at = publications(spark, 40), str(tmp_path)
    i = F.col("counter") - 1
    told = pubs.withColumn("invalidates", F.when(i % 8 == 1, F.array(F.concat(F.lit("n"), i + 9), F.concat(F.lit("n"), i - 3))))
    schema = f"{schemas.PUBLICATIONS}, invalidates array<string>"
    for low, high in [(0, 15), (15, 40)]:
        stream = landed(spark, at, between(told, low, high), schema)
        listing.stream_append_lists(stream, f"{at}/lists", f"{at}/c", inherit=True).awaitTermination()
    pairs = told.select(F.col("np_id").alias("invalidating_np"), F.col("pubkey").alias("invalidating_pubkey"), F.explode("invalidates").alias("invalidated_np"))
    members = list_memberships(pubs)
    want = heads_of_members(members.unionByName(inherit_invalidations(members, pairs, pubs)))
    columns = ["pubkey", "type", "count", "checksum"]
    assert rows(list_heads(listing.list_table(spark, f"{at}/lists")), columns) == rows(want, columns)


def test_quota_gate_counts_on(spark, tmp_path):
    quotas = spark.createDataFrame([("k0", 5), ("k1", 100), ("k2", -1)], "pubkey string, quota int")
    pubs, at = publications(spark, 60), str(tmp_path)
    have = spark.createDataFrame([("k1", 88), ("k2", 1)], "pubkey string, count long")
    for run, (low, high) in zip("aab", [(0, 10), (10, 30), (30, 60)]):  # the last one under a new checkpoint
        listing.stream_quota_gate(landed(spark, f"{at}/{run}", between(pubs, low, high)), quotas, f"{at}/gate", f"{at}/c-{run}", have).awaitTermination()
    got = listing.passed_publications(spark, f"{at}/gate", schemas.PUBLICATIONS).groupBy("pubkey").agg(F.count("*").alias("n"), F.max("counter").alias("last")).collect()
    assert {r.pubkey: (r.n, r.last) for r in got} == {"k0": (5, 13), "k1": (12, 35)}


def test_admission_sorts_into_two_tables_at_once(spark, tmp_path):
    pubs, at = publications(spark, 30), str(tmp_path)
    now = F.timestamp_seconds(F.lit(86_400 + 10 * 600))
    late = "in the future"
    for low, high in [(0, 12), (12, 30)]:
        feeds.stream_admit(landed(spark, at, between(pubs, low, high).withColumn("graph_uris", F.array(F.col("full_id")))), now, f"{at}/out", f"{at}/c", local=True).awaitTermination()
    before = [rows(feeds.outcome_of(spark, f"{at}/out", x), ["np_id", "counter"]) for x in ("admitted", "rejected")]
    assert [len(x) for x in before] == [11, 19]
    assert {r.reject_reason for r in feeds.outcome_of(spark, f"{at}/out", "rejected").collect()} == {late}
    for p in (tmp_path / "c" / "commits").iterdir():
        if p.name.strip(".crc") == "1":
            p.unlink()  # the second batch is done again
    feeds.stream_admit(feeds.stream_publications(spark, f"{at}/in"), now, f"{at}/out", f"{at}/c", local=True).awaitTermination()
    assert [rows(feeds.outcome_of(spark, f"{at}/out", x), ["np_id", "counter"]) for x in ("admitted", "rejected")] == before
    plan = feeds.outcome_of(spark, f"{at}/out", "rejected")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "outcome" in plan.split("PartitionFilters")[1][:200]


def test_dedupe(spark, tmp_path):
    pubs, at = publications(spark, 30), str(tmp_path)
    stream = feeds.stream_dedupe(landed(spark, at, pubs.unionByName(pubs)), "10 days")
    stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/c").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.schema(schemas.PUBLICATIONS).parquet(f"{at}/out").count() == 30


def test_windows_leave_the_state(spark, tmp_path):
    """Ten minutes apart, an hour a window: however many have come, only those that the watermark has not passed are held."""
    pubs, at = publications(spark, 600), str(tmp_path)
    for low in range(0, 600, 200):
        query = feeds.stream_metrics(landed(spark, at, between(pubs, low, low + 200)), f"{at}/m", f"{at}/c", late="3 hours")
        query.awaitTermination()
        held = json.loads(query.recentProgress[-1].json)["stateOperators"][0]["numRowsTotal"]
        assert held <= 5
    got = feeds.metric_table(spark, f"{at}/m").orderBy("start").collect()
    assert {r.n for r in got} == {6} and 95 <= len(got) < 100


def test_rates_over_gaps_and_edges_of_ranges(spark):
    times = [0, 0, 1, 4, 5, 5, 5, 11]
    windows = spark.createDataFrame([(t,) for t in times], "t long").groupBy("t").count().select(F.timestamp_seconds(F.col("t") * 60).alias("start"), F.col("count").alias("n"))
    for size in (1, 2, 3, 100):
        got = feeds.metric_rates(windows, 60, size).orderBy("start").collect()
        n = [times.count(t) for t in range(12)]
        assert [r.n for r in got] == n
        assert [r.total for r in got] == list(itertools.accumulate(n))
        assert [r.change for r in got] == [None, *[b - a for a, b in zip(n, n[1:])]]
    assert feeds.metric_rates(windows.limit(0)).count() == 0


def test_repeat_waits_after_the_end():
    import time

    began = []
    assert feeds.repeat(lambda: (began.append(time.time()), time.sleep(0.2)), 0.3, lambda: len(began) == 3) == 3
    assert all(b - a >= 0.5 for a, b in zip(began, began[1:]))


def counted(spark, at, after, run):
    stream = counter_source.stream_by_counter(spark, f"{at}/store", after=after, span=16, rowsPerTask=5)
    query = stream.writeStream.format("parquet").option("path", f"{at}/out-{run}").option("checkpointLocation", f"{at}/c-{run}").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.schema(schemas.PUBLICATIONS).parquet(f"{at}/out-{run}")
    return [r.counter for r in got.orderBy("counter").collect()], query


def test_feed_by_counter(spark, tmp_path):
    """It resumes after any counter, also where no file begins, reads each row once, and takes gaps for what they are."""
    pubs, at = publications(spark, 90).where("counter % 7 <> 3 AND (counter < 30 OR counter > 52)"), str(tmp_path)
    all_ = [r.counter for r in pubs.orderBy("counter").collect()]
    counter_source.write_spans(between(pubs, 0, 41), f"{at}/store", 16)
    got, _ = counted(spark, at, -1, "a")
    assert got == [c for c in all_ if c <= 41]
    counter_source.write_spans(between(pubs, 41, 90), f"{at}/store", 16)
    got, query = counted(spark, at, -1, "a")  # goes on from its checkpoint
    assert got == all_
    assert sum(json.loads(p.json)["numInputRows"] for p in query.recentProgress) in (0, len([c for c in all_ if c > 41]))
    got, _ = counted(spark, at, 23, "b")  # another stream, from a counter it was given
    assert got == [c for c in all_ if c > 23]
    whole = spark.read.schema(schemas.PUBLICATIONS).parquet(f"{at}/out-a")
    assert sorted(map(str, whole.collect())) == sorted(map(str, pubs.collect()))


@pytest.mark.parametrize(("after", "upto"), [(-1, 0), (-1, 40), (15, 16), (16, 47), (40, 40), (3, 200)])
def test_planned_pieces_cover_each_counter_once(after, upto):
    pieces = counter_source.planned(after, upto, 16, 5)
    assert [c for _, a, b in pieces for c in range(a + 1, b + 1)] == list(range(after + 1, upto + 1))
    assert all((a + 1) // 16 == b // 16 == s and b - a <= 5 for s, a, b in pieces)


def test_readers_find_one_version_of_all_tables(spark, tmp_path):
    """While a set is being written, and if its writing fails, the last complete one is found."""
    at = str(tmp_path / "set")
    assert tables.read_tables(spark, at, ("a", "b")) is None
    tables.write_tables({"a": spark.range(1), "b": spark.range(10)}, at)
    held = tables.read_tables(spark, at, ("a", "b"))

    class Broken:
        sparkSession = spark

        @property
        def write(self):
            during = tables.read_tables(spark, at, ("a", "b"))
            assert (during["a"].count(), during["b"].count()) == (1, 10)
            raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        tables.write_tables({"a": spark.range(2), "b": Broken()}, at)
    now = tables.read_tables(spark, at, ("a", "b"))
    assert (now["a"].count(), now["b"].count()) == (1, 10)
    tables.write_tables({"a": spark.range(3), "b": spark.range(30)}, at)
    now = tables.read_tables(spark, at, ("a", "b"))
    assert (now["a"].count(), now["b"].count(), held["a"].count()) == (3, 30, 1)


def introduced(spark, names, endorses):
    """Publications of agents that declare a key each and endorse others."""
    code = lambda x: "RA" + (x * 43)[:43]
    from attest.functions.scalars import NANOPUB
    from attest.operators.quads import APPROVES, DECLARED_BY, HAS_ASSERTION, HAS_KEY, NAME

    sha = lambda x: __import__("hashlib").sha256(x.encode()).hexdigest()
    out = []
    for a in names:
        uri = NANOPUB + code(a)
        out.append((code(a), None, sha(f"K{a}"), [sha(DECLARED_BY)], None, [(f"{uri}/head", uri, HAS_ASSERTION, f"{uri}/a", True), (f"{uri}/a", "#d", DECLARED_BY, a, True), (f"{uri}/a", "#d", HAS_KEY, f"K{a}", False), (f"{uri}/a", a, NAME, f"Name {a}", False)]))
    for a, b in endorses:
        np = code(a + b)
        uri = NANOPUB + np
        out.append((np, None, sha(f"K{a}"), [sha(APPROVES)], None, [(f"{uri}/head", uri, HAS_ASSERTION, f"{uri}/a", True), (f"{uri}/a", a, APPROVES, NANOPUB + code(b), True)]))
    return spark.createDataFrame(out, cycle.LANDED), code


def test_cycle_from_landed_publications(spark, tmp_path):
    at = str(tmp_path)
    first, code = introduced(spark, "pqr", ["pq"])
    second, _ = introduced(spark, "s", ["qr", "rs"])
    elements = spark.createDataFrame([(code("p"),)], "endorsed_np string")
    keys = {a: __import__("hashlib").sha256(f"K{a}".encode()).hexdigest() for a in "pqrs"}
    live = spark.createDataFrame([(a, keys[a], "loaded") for a in "pqr"], "agent string, pubkey string, status string")

    def run(rows_, full_load):
        rows_.write.mode("append").parquet(f"{at}/in")
        cycle.recompute_trust(cycle.stream_landed(spark, f"{at}/in"), "S", elements, live, f"{at}/t", f"{at}/c", full_load).awaitTermination()
        found = cycle.released(spark, f"{at}/t")
        state = found["state"].first()
        return found, state, sorted(r.account.agent for r in found["snapshots"].where((F.col("hash") == state.stored_hash) & F.col("account").isNotNull()).collect())

    found, state, agents = run(first, False)
    assert state.counter == 1 and agents == ["p", "q"] and found["edges"].count() == 2
    found, state, agents = run(second, False)
    assert state.counter == 2 and agents == ["p", "q", "r"]  # s is still to be loaded
    assert {r.agent for r in found["accounts"].where("status = 'toLoad'").collect()} == {"$", "s"}
    assert sorted(r.counter for r in found["snapshots"].select("counter").distinct().collect()) == [1, 2]
    again, _ = introduced(spark, "p", [])
    found, state, _ = run(again, False)  # nothing new: the state stays as it is
    assert state.counter == 2 and found["snapshots"].select("counter").distinct().count() == 2


def test_nothing_is_published_before_all_is_loaded(spark, tmp_path):
    pubs, code = introduced(spark, "pq", ["pq"])
    elements = spark.createDataFrame([(code("p"),)], "endorsed_np string")
    live = spark.createDataFrame([], "agent string, pubkey string, status string")
    release = cycle.trust_cycle(pubs, "S", elements, live)
    state = release["state"].first()
    assert (state.stored_hash, state.counter) == (None, 0) and release["snapshots"].count() == 0 and release["paths"].count() > 1


def test_a_stream_that_fails_says_so(spark, tmp_path):
    pubs, at = publications(spark, 5), str(tmp_path)
    stream = landed(spark, at, pubs).withColumn("x", F.raise_error(F.lit("lost")))
    with pytest.raises(StreamingQueryException):
        stream.writeStream.format("noop").option("checkpointLocation", f"{at}/c").trigger(availableNow=True).start().awaitTermination()
    assert runs.run_of(spark, f"{at}/none") is None


def test_old_versions_are_removed(spark, tmp_path):
    at = str(tmp_path / "t")
    names = [tables.write_table(spark.range(n), at) for n in (1, 2, 3)]
    (tmp_path / "t" / "v-00000000000000000001-lost").mkdir()
    assert tables.prune_versions(spark, at, 2) == ["v-00000000000000000001-lost", names[0]]
    assert tables.read_table(spark, at).count() == 3 and spark.read.parquet(f"{at}/{names[1]}").count() == 2
    assert tables.prune_versions(spark, at, 2) == []


def test_ids_are_streamed_once(spark, tmp_path):
    at = str(tmp_path)
    known = spark.createDataFrame([("b",)], "np_id string")
    for lines in (["a", " b ", "", "c"], ["a", "d", "b"]):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(f"{at}/in")
        tables.stream_id_feed(spark, f"{at}/in", known).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/c").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.np_id for r in spark.read.schema("np_id string").parquet(f"{at}/out").collect()) == ["a", "c", "d"]


def test_heads_of_many_lists_are_few_rows_of_state(spark, tmp_path, monkeypatch):
    """What a batch asks of the state goes by buckets and not by lists, of which it has a great many."""
    monkeypatch.setattr(listing, "BUCKETS", 8, raising=False)
    pubs, at = publications(spark, 400, keys=200), str(tmp_path)
    for low, high in [(0, 250), (200, 400)]:
        query = listing.stream_append_lists(landed(spark, at, between(pubs, low, high)), f"{at}/lists", f"{at}/c")
        query.awaitTermination()
    held = {o["operatorName"]: o["numRowsTotal"] for o in json.loads(query.recentProgress[-1].json)["stateOperators"]}
    assert held["transformWithStateInPandasExec"] <= 8 and held["dedupe"] == 800
    assert rows(listing.list_table(spark, f"{at}/lists")) == rows(list_entries(list_memberships(pubs)))


def test_what_a_list_holds_comes_before_a_smaller_counter(spark, tmp_path):
    """Of copies in one batch the smallest counter counts; a member listed under another checkpoint keeps the counter it has there."""
    pubs, at = publications(spark, 40), str(tmp_path)
    late, early = pubs.withColumn("counter", F.col("counter") + 1000), pubs.withColumn("counter", F.col("counter") + 500)
    listing.stream_append_lists(landed(spark, f"{at}/a", late.where("counter <= 1020").unionByName(early.where("counter <= 510"))), f"{at}/lists", f"{at}/c-a").awaitTermination()
    listing.stream_append_lists(landed(spark, f"{at}/b", pubs), f"{at}/lists", f"{at}/c-b").awaitTermination()
    listing.stream_append_lists(landed(spark, f"{at}/b", early), f"{at}/lists", f"{at}/c-b").awaitTermination()
    want = {f"n{i}": i + 501 if i < 10 else i + 1001 if i < 20 else i + 1 for i in range(40)}
    got = listing.list_table(spark, f"{at}/lists").where("type = '$'").collect()
    assert {r.np: r.counter for r in got} == want and len(got) == 40


def test_an_invalidation_that_waited_counts_as_it_came_first(spark, tmp_path):
    """Its copy comes with what it invalidates, under a later counter."""
    pubs, at, schema = publications(spark, 12, keys=1), str(tmp_path), f"{schemas.PUBLICATIONS}, invalidates array<string>"
    told = pubs.withColumn("invalidates", F.when(F.col("np_id") == "n1", F.array(F.lit("n4"))))
    again = told.where("np_id = 'n1'").withColumn("counter", F.lit(90).cast("long"))
    for part in (told.where("np_id <> 'n4'"), told.where("np_id = 'n4'").unionByName(again)):
        listing.stream_invalidations(landed(spark, at, part, schema), f"{at}/lists", f"{at}/c").awaitTermination()
    assert [tuple(r) for r in listing.inherited_members(spark, f"{at}/lists").select("type", "np", "counter").collect()] == [("t0", "n1", 2)]
