"""Each operator on small frames with known results."""

import math
import random
from types import SimpleNamespace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph.api import Engine
from weftgraph.config import CompactionConfig, InferenceConfig
from weftgraph.functions import codec, routing, similarity
from weftgraph.functions.bloom import BloomSketch, bloom_size
from weftgraph.operators import compaction, inference, kv, monitoring, relationships, traverse
from weftgraph.plans import lineage
from weftgraph.schemas import EVENT, KV_LOG, NODE, RELATIONSHIP
from weftgraph.sources.store import KvStore, WriteConflict
from weftgraph.streaming import ingest

NOW = 1_234_600_000


def rel(a, b, kind="DEPENDS_ON", confidence=1.0, created=1_234_567_890, expires=0, frequency=1, source="t", inference_type="EXPLICIT", attributes=None):
    return (a, b, kind, inference_type, confidence, created, expires, frequency, source, attributes or {})


def rels(spark, *rows):
    return spark.createDataFrame(list(rows), RELATIONSHIP)


def events(spark, *rows):
    """(event_id, entity_id, event_type, ts_ms, payload[, number of explicit relationships])."""
    return spark.createDataFrame([(*r[:5], {}, [rel(r[1], f"x{i}") for i in range(r[5] if len(r) > 5 else 0)]) for r in rows], EVENT)


def test_explicit_and_literal_inference(spark):
    df = events(spark, ("e1", "entity_A", "t", 0, "entity_A interacts with entity_B", 1))
    got = {(r.related_id, r.rel_type) for r in inference.process_events(df).collect()}
    assert got == {("x0", "DEPENDS_ON"), ("interacts", "INTERACTS_WITH")}


def test_five_explicit_relationships_stop_inference(spark):
    for n, want in ((4, 5), (5, 5)):
        df = events(spark, ("e1", "a:1", "t", 0, "a:1 depends on b:2", n))
        assert inference.process_events(df).count() == want


def test_nearest_other_target(spark):
    df = events(spark, ("e1", "entity_A", "dependency", 0, "entity_A depends on entity_C"), ("e2", "entity_B", "interaction", 1000, "entity_B interacts with entity_A"), ("e3", "q:1", "t", 0, ""))
    literal = {r.event_id: r.related_id for r in inference.semantic(df).collect()}
    other = {r.event_id: r.related_id for r in inference.semantic(df, InferenceConfig(target_mode="nearest_other")).collect()}
    assert literal == {"e1": "depends", "e2": "interacts"} and other == {"e1": "entity_C", "e2": "entity_A"}


def test_temporal_direction(spark):
    df = events(spark, ("e1", "a:1", "start", 1000, "-"), ("e2", "b:1", "start", 1500, "-"))
    past = [(r.entity_id, r.related_id, r.confidence) for r in inference.temporal(df).collect()]
    assert past == [("b:1", "a:1", pytest.approx(math.exp(-500 / 1.8e6)))]
    both = {(r.entity_id, r.related_id) for r in inference.temporal(df, InferenceConfig(direction="both")).collect()}
    assert both == {("b:1", "a:1"), ("a:1", "b:1")}


def test_temporal_join_matches_all_pairs(spark):
    r = random.Random(2)
    data = [(f"e{i}", f"u:{r.randrange(9)}", "t", r.randrange(-3_000_000, 9_000_000), "-") for i in range(120)]
    want = sorted((a[0], b[1]) for a in data for b in data if a[1] != b[1] and 0 <= a[3] - b[3] <= similarity.widest_gap(0.7))
    assert sorted((x.event_id, x.related_id) for x in inference.temporal(events(spark, *data)).collect()) == want


def test_co_occurrence_needs_three(spark):
    data = [("e0", "a:1", "t", 1000, "-")] + [(f"f{i}", "b:1", "t", 1000, "-") for i in range(3)] + [(f"g{i}", "c:1", "t", 1000, "-") for i in range(2)]
    out = [(r.event_id, r.related_id, r.frequency, r.confidence) for r in inference.frequency(events(spark, *data)).where("event_id = 'e0'").collect()]
    assert out == [("e0", "b:1", 3, pytest.approx(0.8))]


def test_similarity_bounds(spark):
    assert [similarity.widest_gap(x) for x in (0.7, 0.3)] == [642_014, 2_167_151] and similarity.widest_gap(0.5, strict=True) == 1_247_664
    df = spark.createDataFrame([("abcd", "abcd"), ("ab", "abc"), ("abcd", "bcde"), ("", ""), ("abc", "xyz")], "a string, b string")
    assert [r.s for r in df.select(similarity.trigram_jaccard(F.col("a"), F.col("b")).alias("s")).collect()] == [1.0, 0.0, pytest.approx(1 / 3), 1.0, 0.0]


def test_relationship_types(spark):
    df = events(spark, ("e1", "a_1", "t", 5, "-"), ("e2", "b:1", "t", 4, "-"), ("e3", "c:1", "needs", 3, "-"), ("e4", "d:1", "root", 2, "-"), ("e5", "f:1", "since", 1, "-"))
    got = {(r.a, r.b): r.t for r in inference.near_in_time(df, 10, "both").select(F.col("e.entity_id").alias("a"), F.col("o.entity_id").alias("b"), inference.relationship_type().alias("t")).collect()}
    assert (got["b:1", "a_1"], got["b:1", "c:1"], got["b:1", "d:1"], got["f:1", "b:1"], got["b:1", "f:1"]) == ("VERSION_MUTATION", "DEPENDS_ON", "CHILD_OF", "CAUSES", "INTERACTS_WITH")


@pytest.mark.parametrize("gap", [0, 7])
@pytest.mark.parametrize("direction", ["past", "both"])
def test_near_events_are_dealt_to_few_bins(spark, gap, direction):
    """All pairs at the edges of bins, before 1970, too; both sides of the join share one exchange of the events."""
    df = events(spark, *((f"e{t}_{k}", f"u{k}", "t", t, "-") for t in range(-45, 45) for k in range(2)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = inference.near_in_time(df, gap, direction).select("e.event_id", F.col("o.event_id").alias("other"))
        got = sorted((r.event_id, r.other) for r in out.collect())
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lags = range(-gap if direction == "both" else 0, gap + 1)
    assert got == sorted((f"e{t}_{k}", f"e{t - lag}_{1 - k}") for t in range(-45, 45) for k in range(2) for lag in lags if -45 <= t - lag < 45)
    assert "ReusedExchange" in plan


def test_lookup_and_expiry(spark):
    df = rels(spark, *(rel("e", f"r{i}", "INTERACTS_WITH", 0.8 + 0.04 * i, 1_234_567_890 + 1000 * i) for i in range(5)), rel("e", "old", expires=NOW), rel("e", "new", expires=NOW + 1))
    assert [r.related_id for r in relationships.of_entity(df, "e").collect()][:2] == ["r4", "r3"]
    assert relationships.by_type(df, "INTERACTS_WITH").count() == 5 and relationships.by_type(df, "CHILD_OF").count() == 0
    assert relationships.active(df, NOW).count() == 6 == relationships.without_expired(df, NOW).count()
    s = relationships.stats(df, NOW).first()
    assert (s.total, s.active, s.entities, s.inferred) == (7, 6, 1, 0)
    assert relationships.store(df, df).count() == 14


@pytest.mark.parametrize("n, expired, needs", [(2, 1, False), (3, 1, False), (3, 2, True), (1, 1, True), (1001, 0, True), (1000, 0, False)])
def test_needs_compaction(spark, n, expired, needs):
    df = spark.range(n).select(F.lit("e").alias("entity_id"), F.when(F.col("id") < expired, NOW).otherwise(0).alias("expires_at"))
    assert relationships.needs_compaction(df, NOW).first().needs == needs


def test_codec_round_trip(spark):
    df = rels(spark, rel("a", "b", "CHILD_OF", 0.85, 1234567890, 0, 5, "s", "SEMANTIC", {"context": "test_context", "a": "1"}), rel("c", "d"))
    lines = df.select(codec.encode_relationship().alias("line"))
    assert lines.first().line == "a|b|CHILD_OF|SEMANTIC|0.85|1234567890|0|5|s|{a=1,context=test_context}"
    assert sorted(map(str, lines.select(codec.decode_relationship("line").alias("r")).select("r.*").collect())) == sorted(map(str, df.collect()))
    assert spark.createDataFrame([("nonsense",)], "line string").select(codec.decode_relationship("line").alias("r")).first().r is None
    ev = events(spark, ("e1", "a", "t", 1, "p|q", 1))
    assert ev.select(codec.decode_event(codec.encode_event()).alias("e")).select("e.*").collect() == ev.collect()
    size = relationships.row_sizes(df.limit(1)).first().size_bytes
    assert size == 1 + 8 + len(lines.first().line) + 1
    assert relationships.wide_rows(df).count() == 2


CHAIN = (("B", "A"), ("C", "B"), ("D", "C"))


def test_traversal(spark):
    df = rels(spark, *(rel(a, b) for a, b in CHAIN), rel("A", "A"), rel("B", "D"), rel("D", "Z", expires=1))
    for depth, want in ((1, {"C"}), (2, {"C", "B"}), (3, {"C", "B", "A"}), (9, {"C", "B", "A"})):
        assert {r.node for r in traverse.connected(df, "D", NOW, depth).collect()} == want
    assert {r.node for r in traverse.reached_by_type(df, "D", "DEPENDS_ON", 1).collect()} == {"C", "Z"}
    nodes, edges = traverse.subgraph(rels(spark, *(rel(a, b) for a, b in CHAIN)), "A", 2)
    assert [(r.node_id, r.depth, r.node_index) for r in nodes.orderBy("node_index").collect()] == [("A", 0, 0), ("B", 1, 1), ("C", 2, 2)]
    assert {(r.entity_id, r.reached) for r in edges.collect()} == {("B", "B"), ("C", "C")}
    assert traverse.subgraph(rels(spark, *(rel(a, b) for a, b in CHAIN)), "A", 1, max_nodes=3, compat=True)[0].count() == 3
    assert traverse.subgraph(rels(spark, rel("x", "y")), "A", 2)[1].count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), min_size=1, max_size=14), st.integers(1, 4))
def test_traversal_as_plain_search(spark, pairs, depth):
    seen, front = {"0": 0}, ["0"]
    for d in range(1, depth + 1):
        front = sorted({str(b) for a, b in pairs if str(a) in front} - set(seen))
        seen |= {n: d for n in front}
    out = traverse.connected(rels(spark, *(rel(str(a), str(b)) for a, b in pairs)), "0", NOW, depth)
    assert {r.node: r.depth for r in out.collect()} == {n: d for n, d in seen.items() if d}


def test_query_relationships(spark):
    rows = [rel(f"node_{i}", b, t, 0.95) for i in range(1, 6) for b, t in (("user_bob", "knows"), ("project_alpha", "works_on"), ("team", "member_of"))]
    df = rels(spark, *rows, rel("user_bob", "node_1", "knows", inference_type="TEMPORAL"))
    assert traverse.query_relationship(df, "node_1", ["knows", "works_on"], False, 50).count() == 2
    assert [r.edge_key for r in traverse.query_relationship(df, "node_1", None, True, 2).collect()] == ["node_1->project_alpha", "node_1->team"]
    assert traverse.query_relationship(df, "node_1", max_results=0).count() == 0
    top = traverse.batch_query(df, spark.createDataFrame([("user_bob",), ("team",), ("none",)], "node_id string"), 2)
    assert {(r.node_id, r["rank"]) for r in top.collect()} == {("user_bob", 1), ("user_bob", 2), ("team", 1), ("team", 2)}


def test_compaction(spark):
    df = rels(
        spark, rel("e", "r", "A", 0.5, 30, 0, 1, "a", attributes={"k": "1", "x": "1"}), rel("e", "r", "A", 0.9, 20, 0, 2, "b"), rel("e", "r", "B", 0.7, 20, 0, 4, "c", attributes={"k": "2"}),
        rel("e", "r", "C", 0.6, 10, 0, 8, "d"), rel("e", "gone", "A", expires=NOW),
    )
    assert {r.source for r in compaction.dedup(df).collect()} == {"a", "c", "d", "t"}
    out = compaction.compact(df, NOW).collect()
    assert len(out) == 1
    r = out[0]
    assert (r.rel_type, r.confidence, r.created_at, r.frequency, r.source, r.attributes) == ("A", 0.7, 30, 13, "merged:merged:a,c,d", {"k": "2", "x": "1"})
    again = compaction.compact(compaction.compact(df, NOW), NOW).collect()
    assert again == out


def test_compaction_policies(spark):
    df = rels(spark, *(rel("e", f"r{i}", expires=NOW if i < 3 else 0) for i in range(4)), rel("f", "r0", created=NOW))
    access = spark.createDataFrame([("r0", 0.05)], "related_id string, access_frequency double")
    figures = compaction.entity_figures(df, NOW, access)
    config = CompactionConfig()
    got = {r.entity_id: r for r in figures.select("entity_id", *(p().priority(config).alias(n) for n, p in (("time", compaction.TimePolicy), ("freq", compaction.FrequencyPolicy))), compaction.HybridPolicy().should(config).alias("should")).collect()}
    assert got["e"].time == 0.75 and got["e"].freq == 0.95 and got["f"].should
    assert [r.should for r in compaction.should_compact(figures, "time", NOW, CompactionConfig(idle_ms=10)).orderBy("entity_id").collect()] == [True, False]
    assert compaction.schedule(figures, compaction.TimePolicy(), 2.0, 0.5).first().priority == 1.5
    assert compaction.HybridPolicy().compact(df, NOW, access, config).count() == 1
    assert compaction.frequency_filter(df).count() == 5
    runs = spark.createDataFrame([(3, 10, 2.0), (5, 30, 4.0)], "removed long, bytes_saved long, ms double")
    assert tuple(compaction.run_stats(runs).first()) == (2, 8, 40, 3.0)


def test_key_values(spark):
    log = spark.createDataFrame([(1, "PUT", "key1", "a"), (2, "PUT", "key2", "b"), (3, "PUT", "key3", "c"), (4, "DELETE", "key2", None), (5, "DELETE", "none", None), (6, "PUT", "key1", "z")], KV_LOG)
    assert [(r.key, r.value) for r in kv.scan(log, "key1", "key3").collect()] == [("key1", "z"), ("key3", "c")] and kv.scan(log, "a", "z", 1).count() == 1
    assert kv.get(log, "key2").count() == 0
    again = kv.put(log, spark.createDataFrame([(7, "key2", "back")], "seq long, key string, value string"))
    assert kv.get(again, "key2").first().value == "back" and kv.get(kv.delete(again, spark.createDataFrame([(8, "key2")], "seq long, key string")), "key2").count() == 0
    assert {(r.key, r.value) for r in kv.multi_get(log, spark.createDataFrame([("key1",), ("no",)], "key string")).collect()} == {("key1", "z"), ("no", None)}
    assert sorted(kv.replay(kv.latest(log.where("seq < 3")), log, 3).collect()) == sorted(kv.latest(log).collect())
    assert [r.seq for r in kv.versions(log).collect()][:2] == [6, 1]
    assert kv.checksums(log.limit(1)).first().crc == 0xE8B7BE43
    plan = kv.compact_files(spark.createDataFrame([("a", 10), ("b", 100), ("c", 20)], "path string, bytes long"), small=50, target=25)
    assert {r.path: r.merge_group for r in plan.collect()} == {"a": 0, "c": 1}


def test_many_threads_of_writes(spark):
    log = spark.range(4000).select(F.col("id").alias("seq"), F.lit("PUT").alias("op"), F.concat(F.lit("thread_"), (F.col("id") % 4).cast("string"), F.lit("_key_"), F.expr("id div 4").cast("string")).alias("key"), F.lit("v").alias("value"))
    assert kv.latest(log).count() == 4000


def test_routing(spark):
    def fnv(key):
        h = routing.FNV_OFFSET
        for b in key.encode():
            h = ((h ^ (b if b < 128 else b + (1 << 64) - 256)) * routing.FNV_PRIME) % (1 << 64)
        return h

    keys = ["", "a", "user:12", "größe"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    assert [r.s for r in df.select(routing.shard_of("k", 7).alias("s")).collect()] == [fnv(k) % 7 for k in keys]
    assert {r.s for r in spark.range(500).select(routing.ring_shard_of(F.col("id").cast("string"), 4).alias("s")).collect()} <= set(range(4))


def test_bloom(spark):
    df = spark.range(1000).select(F.concat(F.lit("item"), F.col("id").cast("string")).alias("k"))
    sketch = BloomSketch.of(df, "k", 1000)
    again = BloomSketch.from_bytes(spark, sketch.to_bytes(spark))
    assert all(again.might_contain(f"item{i}") for i in range(1000)) and sum(again.might_contain(f"no{i}") for i in range(1000)) < 60
    assert bloom_size(1000, 0.01) == (9586, 7)


def test_monitoring(spark):
    df = spark.createDataFrame([(10_001, 0, 0.1), (10_000, 100, 0.8), (0, 101, 0.0)], "queue_depth long, backlog long, memory_usage double")
    assert [r.status for r in monitoring.health(df).collect()] == ["DEGRADED", "HEALTHY", "DEGRADED"]
    assert sum(r.rows for r in monitoring.partition_stats(spark.range(10)).collect()) == 10


def test_shard_and_global_stats(spark):
    log = spark.createDataFrame([(i, "DELETE" if i % 5 == 0 else "PUT", f"k{i % 7}", None if i % 5 == 0 else "é" * i) for i in range(40)], "seq long, op string, key string, value string")
    stats = monitoring.shard_stats(log, 3)
    rows = stats.collect()
    assert (sum(r.keys for r in rows), sum(r.operations for r in rows), sum(r.deletes for r in rows), max(r.last_seq for r in rows)) == (7, 40, 8, 39)
    assert sum(r.bytes for r in rows) == sum(2 + (0 if i % 5 == 0 else 2 * i) for i in range(40))
    whole = monitoring.global_stats(stats).first()
    assert (whole.shards, whole.puts) == (len(rows), 32) and whole.imbalance == pytest.approx(max(r.operations for r in rows) * len(rows) / 40)
    none = monitoring.global_stats(monitoring.shard_stats(log.limit(0))).first()
    assert (none.shards, none.operations) == (0, None)


@pytest.mark.parametrize("width", [1, 4, 1 << 16])
def test_row_cache_as_plain_lru(spark, width):
    from collections import OrderedDict

    used, held = [(i, f"k{i * i % 23}") for i in range(60)], OrderedDict()
    value = lambda key: "x" * (int(key[1:]) % 9)
    log = spark.createDataFrame([(i, "PUT", k, value(k)) for i, k in used], "seq long, op string, key string, value string")
    for _, k in used:
        held.pop(k, None)
        held[k] = len(k) + len(value(k))
        while sum(held.values()) > 40:
            held.popitem(last=False)
    assert {r.key for r in kv.cached(log, 40, width).collect()} == set(held) and 2 < len(held) < 12
    assert kv.cached(log, 0, width).count() == 0 and kv.cached(log.limit(0), 40, width).count() == 0


def test_nodes_last_write_wins(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "z", 0)], "node_id string, node_type string, seq long")
    assert {(r.node_id, r.node_type) for r in relationships.upsert_nodes(df).collect()} == {("a", "y"), ("b", "z")}


def test_streams_match_batches(spark, tmp_path):
    r = random.Random(4)
    df = events(spark, *((f"e{i}", f"u:{r.randrange(5)}", "t", r.randrange(5_000_000), "-", i % 3) for i in range(60)))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ingest.read_events(spark, str(tmp_path / "in"))
    ingest.ingest(stream, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/nodes")).count() == 60 and spark.read.parquet(str(tmp_path / "out/rels")).count() == 60
    q = ingest.near_events(stream).writeStream.format("parquet").option("path", str(tmp_path / "near")).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = sorted((x.event_id, x.related_id) for x in inference.temporal(df).collect())
    assert sorted((x.event_id, x.related_id) for x in spark.read.parquet(str(tmp_path / "near")).collect()) == want
    counts = ingest.windowed_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    counts.awaitTermination()
    assert spark.sql("select sum(n) from counts").first()[0] == 60


def puts(spark, *rows):
    return spark.createDataFrame(list(rows), "op string, key string, value string")


def test_store_keeps_batches_and_files(spark, tmp_path):
    store, said = KvStore(spark, str(tmp_path), 4).put_batch(puts(spark, *(("PUT", f"key{i}", f"v{i}") for i in range(100)), ("PUT", None, "x"), ("PUT", "y", None), ("DROP", "z", "1")))
    assert tuple(said.first()) == (100, 3) and not store.is_full() and store.is_full(rows=100)
    assert store.get("key7").first().value == "v7"
    store = store.flush()
    store, _ = store.put_batch(puts(spark, ("DELETE", "key2", None), ("PUT", "key3", "new")))
    again = KvStore(spark, str(tmp_path), 4)
    assert again.manifest == store.manifest and again.get("key2").count() == 0 and again.get("key3").first().value == "new"
    assert [r.key for r in again.scan("key1", "key12").collect()] == ["key1", "key10", "key11", "key12"]
    assert {(r.key, r.value) for r in again.multi_get(spark.createDataFrame([("key3",), ("key2",), ("no",)], "key string")).collect()} == {("key3", "new"), ("key2", None), ("no", None)}
    assert again.live().count() == 99
    s = again.stats().first()
    assert (s.batches, s.rows_written, s.rows_rejected, s.flushes, s.segments, s.files) == (2, 102, 3, 1, 1, 1)
    nothing, said = again.put_batch(puts(spark, ("PUT", None, "x")))
    assert nothing is again and tuple(said.first()) == (0, 1)


def test_store_takes_one_of_two_writers(spark, tmp_path):
    a, b = KvStore(spark, str(tmp_path)), KvStore(spark, str(tmp_path))
    a = a.put_batch(puts(spark, ("PUT", "k", "a")))[0]
    with pytest.raises(WriteConflict):
        b.put_batch(puts(spark, ("PUT", "k", "b")))
    b = KvStore(spark, str(tmp_path)).put_batch(puts(spark, ("PUT", "k", "b")))[0]
    assert a.get("k").first().value == "a" and b.get("k").first().value == "b"


@pytest.mark.parametrize("strategy", ["size_tiered", "leveled", "adaptive"])
def test_store_merges_files(spark, tmp_path, strategy):
    store, want = KvStore(spark, str(tmp_path), 2), {}
    for batch in range(5):
        rows = [("DELETE" if (i + batch) % 5 == 0 else "PUT", f"k{i}", f"{batch}-{i}") for i in range(batch, batch + 12)]
        for op, k, v in rows:
            want.pop(k, None)
            if op == "PUT":
                want[k] = v
        store = store.put_batch(puts(spark, *rows).coalesce(1))[0].flush()
    assert {r.key: r.value for r in store.live().collect()} == want and len(store.manifest.files) == 5
    store = (store.record_reads(1000) if strategy == "adaptive" else store).compact(strategy, least=2)
    assert {r.key: r.value for r in store.live().collect()} == want
    while len(store.manifest.files) > 1 and store.plan("size_tiered", 2, 1 << 40):
        store = store.compact("size_tiered", 2, 1 << 40)
    assert {r.key: r.value for r in store.live().collect()} == want and len(store.manifest.files) == 1
    assert store.manifest.files[0].rows == len(want) and len(list((tmp_path / "files").iterdir())) == 1


def test_store_recovers_what_is_sound(spark, tmp_path):
    store = KvStore(spark, str(tmp_path))
    for i in range(1, 6):
        store = store.put_batch(spark.createDataFrame([(i, f"key{i}", f"record{i}")], "seq long, key string, value string"))[0]
    rows, bad = KvStore(spark, str(tmp_path)).recover(3)
    assert sorted(r.value for r in rows.collect()) == ["record3", "record4", "record5"] and bad == 0
    store = store.rotate(2)
    assert len(store.manifest.segments) == 1 and store.recover()[0].count() == 5
    path = store._path(store.manifest.segments[0])
    spoiled = spark.createDataFrame(spark.read.parquet(path).withColumn("value", F.when(F.col("seq") == 2, "other").otherwise(F.col("value"))).collect())
    spoiled.write.mode("overwrite").parquet(path)
    rows, bad = store.recover()
    assert bad == 1 and rows.count() == 4
    with pytest.raises(ValueError):
        store.flush()
    assert store.truncate(5) is store


def test_streams_take_events_in_any_order(spark, tmp_path):
    """40 files of shuffled events in batches of 16: as many pairs as the batch operator finds, and the late are counted elsewhere."""
    r = random.Random(11)
    df = events(spark, *((f"e{i}", f"u:{r.randrange(9)}", "t", r.randrange(60_000_000), "-", 0) for i in range(400)))
    df.repartition(40).write.parquet(str(tmp_path / "in"))
    stream = ingest.read_events(spark, str(tmp_path / "in"))
    q = ingest.infer_near(stream, str(tmp_path / "out"), str(tmp_path / "c1"))
    q.awaitTermination()
    pairs = lambda d: sorted((x.event_id, x.related_id, x.rel_type, x.created_at) for x in d.collect())
    assert pairs(spark.read.parquet(str(tmp_path / "out/rels"))) == pairs(inference.temporal(df)) and len(q.recentProgress) == 3
    assert ingest.progress(q).agg(F.sum("input_rows")).first()[0] == 400
    q = ingest.near_events(stream).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert ingest.dropped_rows(q) > 0 and ingest.progress(q).agg(F.sum("dropped")).first()[0] == ingest.dropped_rows(q)


def test_stream_keeps_only_what_pairs_need(spark, tmp_path):
    df = events(spark, *((f"e{i}", f"u{i % 3}", "needs", 1000 * i, "-", i % 2) for i in range(40)))
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = ingest.read_events(spark, str(tmp_path / "in"), files_per_trigger=1)
    ingest.infer_near(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    pairs = lambda d: sorted((x.event_id, x.related_id, x.rel_type, x.created_at) for x in d.collect())
    assert pairs(spark.read.parquet(str(tmp_path / "out/rels"))) == pairs(inference.temporal(df))
    seen = spark.read.parquet(str(tmp_path / "out/seen"))
    assert seen.count() == 40 and set(seen.columns) == {"event_id", "entity_id", "event_type", "ts_ms", "payload", "features", "batch"}


def test_acks_of_ingest(spark, tmp_path):
    df = events(spark, ("e1", "a", "t", 1, "-", 1), ("e2", None, "t", 1, "-", 1), ("e3", "b", "t", -1, "-"))
    df.write.parquet(str(tmp_path / "in"))
    ingest.ingest(ingest.read_events(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    acks = {r.event_id: (r.accepted, r.error) for r in spark.read.parquet(str(tmp_path / "out/acks")).collect()}
    assert acks == {"e1": (True, None), "e2": (False, "no entity id"), "e3": (False, "no time")}
    assert spark.read.parquet(str(tmp_path / "out/nodes")).count() == 1 and spark.read.parquet(str(tmp_path / "out/rels")).count() == 1


def test_shared_folder(spark):
    """Of the session where it names one; on a cluster it has to."""
    path = lineage.written(spark.range(3), "three").inputFiles()[0].rpartition("/")[0]
    assert spark.read.parquet(path).count() == 3 and lineage.clear(spark) >= 1
    with pytest.raises(Exception):
        spark.read.parquet(path).count()

    session = lambda master, **conf: SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))
    assert lineage.shared_root(session("spark://far:7077", **{"spark.checkpoint.dir": "hdfs:///shared/"})) == "hdfs:///shared"
    assert lineage.shared_root(session("local[2]")).startswith("file:")
    for master in ("spark://far:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            lineage.shared_root(session(master))


def test_engine_object(spark):
    none = spark.createDataFrame([], NODE), spark.createDataFrame([], RELATIONSHIP)
    first = events(spark, ("e1", "alice", "user", 1, "-", 2), ("e2", "alice", "admin", 2, "a:1 depends on b:1"), ("e3", None, "user", 3, "-", 1), ("e4", "x0", "page", 4, "-"))
    engine = Engine(*none).ingest(first, InferenceConfig())
    assert {(r.node_id, r.node_type) for r in engine.nodes.collect()} == {("alice", "admin"), ("x0", "page")}
    assert engine.related("alice").where("rel_type = 'DEPENDS_ON'").count() >= 3
    assert engine.query("alice", types=["DEPENDS_ON"], max_results=2).count() == 2
    nodes, edges = engine.graph_around("alice", depth=1)
    assert {r.node_id for r in nodes.collect()} == {"alice", "x0"} and edges.count() >= 2
    assert engine.batch_query(engine.nodes, 1).count() == 2 and engine.stats(0).first().entities >= 1


def test_entry_points():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= names and {"infer_temporal", "kv_latest", "compact_full"} <= names
