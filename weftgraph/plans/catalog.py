"""The queries by name, each with DuckDB SQL of the same result where SQL can express it."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.api import Engine
from weftgraph.config import CompactionConfig, InferenceConfig
from weftgraph.functions import bloom, codec, routing, similarity
from weftgraph.operators import compaction, inference, kv, monitoring, relationships, traverse
from weftgraph.plans.lineage import fresh_path, written
from weftgraph.schemas import NODE, RELATIONSHIP
from weftgraph.sources import tables as src
from weftgraph.sources.store import KvStore
from weftgraph.streaming import ingest

#: 2024-01-25, within the events; 1998-06-01, within the orders and shipments.
AS_OF, SHIP_NOW = 1_706_140_800_000, 896_659_200_000
ROOT = "order:1"

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return add


_MS = "(epoch_us({0}) // 1000)"
_WORDS = "CASE user_id % 4 WHEN 0 THEN 'requires item' WHEN 1 THEN 'parent page' WHEN 2 THEN 'because of offer' ELSE 'plain' END"
_EVENTS = f"""ev AS (SELECT 'event:' || event_id AS event_id, event_id AS n, 'user:' || user_id AS entity_id, 'type:' || event_type AS type_id, event_type,
  {_MS.format('ts')} AS ts_ms, lower(event_type || ' ' || event_type || ' ' || {_WORDS}) AS words FROM events)"""
_TYPE = f"""CASE WHEN regexp_matches(e.words, '{inference.DEPENDENCY}') OR regexp_matches(o.words, '{inference.DEPENDENCY}') THEN 'DEPENDS_ON'
  WHEN regexp_matches(e.words, '{inference.HIERARCHY}') OR regexp_matches(o.words, '{inference.HIERARCHY}') THEN 'CHILD_OF'
  WHEN o.ts_ms > e.ts_ms AND (regexp_matches(e.words, '{inference.CAUSE}') OR regexp_matches(o.words, '{inference.CAUSE}')) THEN 'CAUSES' ELSE 'INTERACTS_WITH' END"""
_SIM = "CASE WHEN e.ts_ms = o.ts_ms THEN 1.0 ELSE exp(-abs(e.ts_ms - o.ts_ms) / 1800000.0) END"
_TEMPORAL = f"""te AS (SELECT e.event_id, e.n, e.entity_id, o.entity_id AS related_id, {_TYPE} AS rel_type, {_SIM} AS confidence, e.ts_ms AS created_at
  FROM ev e JOIN ev o ON o.ts_ms BETWEEN e.ts_ms - 642014 AND e.ts_ms AND e.entity_id <> o.entity_id AND e.event_id <> o.event_id)"""


def _frequency(entity: str) -> str:
    return f"""fr AS (SELECT e.event_id, e.n, e.{entity} AS entity_id, o.{entity} AS related_id, count(*) AS frequency, least(0.9, count(*) / 10.0 + avg({_SIM}) / 2) AS confidence, e.ts_ms AS created_at
  FROM ev e JOIN ev o ON o.ts_ms BETWEEN e.ts_ms - 1247664 AND e.ts_ms AND e.{entity} <> o.{entity} AND e.event_id <> o.event_id
  WHERE {_SIM} > 0.5 GROUP BY ALL HAVING count(*) >= 3)"""


@query(f"WITH {_EVENTS}, {_TEMPORAL} SELECT event_id, entity_id, related_id, rel_type, round(confidence, 6) AS confidence, created_at, created_at + 3600000 AS expires_at FROM te WHERE confidence >= 0.7")
def infer_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = inference.temporal(src.events(spark, sf_dir))
    return out.select("event_id", "entity_id", "related_id", "rel_type", F.round("confidence", 6).alias("confidence"), "created_at", "expires_at")


@query(f"""WITH {_EVENTS}, te AS (SELECT {_TYPE} AS rel_type, {_SIM} AS confidence FROM ev e JOIN ev o ON o.ts_ms BETWEEN e.ts_ms - 642014 AND e.ts_ms + 642014 AND e.entity_id <> o.entity_id AND e.event_id <> o.event_id)
SELECT rel_type, count(*) AS n, round(avg(confidence), 6) AS avg_confidence FROM te WHERE confidence >= 0.7 GROUP BY 1""")
def infer_temporal_both(spark, sf_dir):
    out = inference.temporal(src.events(spark, sf_dir), InferenceConfig(direction="both"))
    return out.groupBy("rel_type").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))


@query(f"WITH {_EVENTS}, {_frequency('type_id')} SELECT event_id, entity_id, related_id, frequency, round(confidence, 6) AS confidence, created_at FROM fr")
def infer_frequency(spark, sf_dir):
    out = inference.frequency(src.events(spark, sf_dir, "type"))
    return out.select("event_id", "entity_id", "related_id", "frequency", F.round("confidence", 6).alias("confidence"), "created_at")


@query(f"WITH {_EVENTS}, {_frequency('entity_id')} SELECT event_id, entity_id, related_id, frequency, round(confidence, 6) AS confidence, created_at FROM fr")
def infer_frequency_users(spark, sf_dir):
    out = inference.frequency(src.events(spark, sf_dir))
    return out.select("event_id", "entity_id", "related_id", "frequency", F.round("confidence", 6).alias("confidence"), "created_at")


_VERBS = "['interacts with', 'depends on', 'child of', 'version 3 of', 'causes', 'precedes', 'contained', 'references']"
_SAID = f"""st AS (SELECT 'order:' || o_orderkey AS entity_id, 'statement:' || o_orderkey AS event_id, {_MS.format('o_orderdate')} AS ts_ms,
  'order:' || o_orderkey || ' ' || ({_VERBS})[o_orderkey % 8 + 1] || ' customer:' || o_custkey AS payload, 'customer:' || o_custkey AS other FROM orders)"""
_PATTERN_ROWS = ", ".join(f"('{p}', '{t}')" for p, t in inference.PATTERNS)


@query(f"""WITH {_SAID}, pa(p, t) AS (VALUES {_PATTERN_ROWS}), hit AS (SELECT *, regexp_extract(payload, p, 0, 'i') AS matched FROM st, pa)
SELECT event_id, entity_id, regexp_extract(matched, '^\\w+', 0) AS related_id, t AS rel_type, 0.8::DOUBLE AS confidence, matched AS pattern, ts_ms AS created_at FROM hit WHERE matched <> ''""")
def infer_semantic(spark, sf_dir):
    out = inference.semantic(src.statements(spark, sf_dir))
    return out.select("event_id", "entity_id", "related_id", "rel_type", "confidence", F.col("attributes")["pattern"].alias("pattern"), "created_at")


@query(f"""WITH {_SAID}, pa(p, t) AS (VALUES {_PATTERN_ROWS}) SELECT event_id, other AS related_id, t AS rel_type FROM st, pa WHERE regexp_extract(payload, p, 0, 'i') <> ''""")
def infer_semantic_nearest(spark, sf_dir):
    return inference.semantic(src.statements(spark, sf_dir), InferenceConfig(target_mode="nearest_other")).select("event_id", "related_id", "rel_type")


@query(f"""WITH {_EVENTS}, {_TEMPORAL}, {_frequency('entity_id')},
al AS (SELECT n, 'TEMPORAL' AS inference_type, rel_type, confidence FROM te WHERE confidence >= 0.7
  UNION ALL SELECT n, 'FREQUENCY_BASED', 'INTERACTS_WITH', confidence FROM fr WHERE confidence >= 0.7),
ex AS (SELECT n, 'EXPLICIT' AS inference_type, 'REFERENCES' AS rel_type, 1.0 AS confidence FROM ev, range(1, 6) r(i) WHERE i <= CASE WHEN n % 50 = 0 THEN 5 WHEN n % 3 = 0 THEN 1 ELSE 0 END)
SELECT inference_type, rel_type, count(*) AS n, round(sum(confidence), 4) AS confidence FROM (SELECT * FROM al WHERE n % 50 <> 0 UNION ALL SELECT * FROM ex) GROUP BY ALL""")
def infer_all(spark, sf_dir):
    out = inference.process_events(src.events(spark, sf_dir))
    return out.groupBy("inference_type", "rel_type").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("confidence"))


@query("SELECT event_id, round(exp(-abs(user_id * 1000) / 1800000.0), 6) AS decay FROM events WHERE user_id > 0")
def decay_profile(spark, sf_dir):
    return src.table(spark, sf_dir, "events").where("user_id > 0").select("event_id", F.round(similarity.temporal_similarity(F.lit(0), F.col("user_id") * 1000), 6).alias("decay"))


@query("""WITH g AS (SELECT p_name, count(*) AS n, list_distinct([substr(p_name, i::INT, 3) FOR i IN range(1, length(p_name) - 1)]) AS t FROM part GROUP BY p_name)
SELECT a.p_name AS a, b.p_name AS b, a.n AS a_rows, b.n AS b_rows, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) AS jaccard
FROM g a JOIN g b ON a.p_name < b.p_name WHERE len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) >= 0.3""")
def trigram_jaccard(spark, sf_dir):
    """All pairs of different part names that are alike, each with its number of parts."""
    return similarity.similar_strings(src.table(spark, sf_dir, "part"), "p_name", 0.3).withColumn("jaccard", F.round("jaccard", 6))


@query(f"""WITH {_EVENTS} SELECT {_TYPE} AS rel_type, count(*) AS n FROM ev e JOIN ev o ON o.ts_ms BETWEEN e.ts_ms - 600000 AND e.ts_ms + 600000 AND e.entity_id <> o.entity_id AND e.event_id <> o.event_id GROUP BY 1""")
def type_inference(spark, sf_dir):
    return inference.near_in_time(src.events(spark, sf_dir), 600_000, "both").select(inference.relationship_type().alias("rel_type")).groupBy("rel_type").agg(F.count("*").alias("n"))


_RELS = f"""rels AS (
  SELECT 'customer:' || c_custkey AS entity_id, 'nation:' || c_nationkey AS related_id, 'CHILD_OF' AS rel_type, 'EXPLICIT' AS inference_type, 1.0::DOUBLE AS confidence, 0::BIGINT AS created_at, 0::BIGINT AS expires_at, 1::BIGINT AS frequency, 'customer' AS source FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'CHILD_OF', 'EXPLICIT', 1.0, 0, 0, 1, 'supplier' FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'CHILD_OF', 'EXPLICIT', 1.0, 0, 0, 1, 'nation' FROM nation
  UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'DEPENDS_ON', 'EXPLICIT', 1.0, {_MS.format('o_orderdate')}, 0, 1, 'orders' FROM orders
  UNION ALL SELECT 'order:' || o_orderkey, 'order:' || nx, 'PRECEDES', 'TEMPORAL', 0.9, ms, 0, 1, 'sequence' FROM (SELECT o_orderkey, {_MS.format('o_orderdate')} AS ms, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nx FROM orders) WHERE nx IS NOT NULL
  UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'CONTAINS', 'EXPLICIT', 1.0, 0, 0, count(*), 'lineitem' FROM lineitem GROUP BY l_orderkey, l_partkey
  UNION ALL SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'REFERENCES', 'EXPLICIT', 1.0, 0, 0, count(*), 'supply' FROM lineitem GROUP BY l_partkey, l_suppkey
  UNION ALL SELECT 'user:' || user_id, 'type:' || event_type, 'INTERACTS_WITH', 'FREQUENCY_BASED', 0.8, max({_MS.format('ts')}), max({_MS.format('ts')}) + 2592000000, count(*), 'events' FROM events GROUP BY user_id, event_type)"""
_COLS = "entity_id, related_id, rel_type, inference_type, confidence, created_at, expires_at, frequency, source"
_ENC = "entity_id || '|' || related_id || '|' || rel_type || '|' || inference_type || '|' || regexp_replace(regexp_replace(format('{:.6f}', confidence), '0+$', ''), '[.]$', '') || '|' || created_at || '|' || expires_at || '|' || frequency || '|' || source || '|{table=' || source || '}'"
_FLAT = [c.strip() for c in _COLS.split(",")]


def _rels(spark, sf_dir):
    return src.relationships(spark, sf_dir)


def _stored(spark, sf_dir):
    """The relationships as a table sorted by entity: a hop of few nodes reads the parts that hold them."""
    return written(_rels(spark, sf_dir).repartitionByRange("entity_id").sortWithinPartitions("entity_id"), "rels")


@query(f"WITH {_RELS} SELECT {_COLS} FROM rels")
def rels_all(spark, sf_dir):
    return _rels(spark, sf_dir).select(*_FLAT)


@query(f"WITH {_RELS} SELECT {_COLS} FROM rels WHERE expires_at = 0 OR expires_at > {AS_OF + 29 * 86400000}")
def rels_active(spark, sf_dir):
    return relationships.active(_rels(spark, sf_dir), AS_OF + 29 * 86_400_000).select(*_FLAT)


@query(f"WITH {_RELS} SELECT {_COLS} FROM rels WHERE entity_id = '{ROOT}'")
def rels_of_entity(spark, sf_dir):
    return relationships.of_entity(_rels(spark, sf_dir), ROOT).select(*_FLAT)


@query(f"WITH {_RELS} SELECT related_id, rel_type FROM rels WHERE entity_id = 'user:1'")
def related_pairs(spark, sf_dir):
    return relationships.related_pairs(_rels(spark, sf_dir), "user:1")


@query(f"WITH {_RELS} SELECT {_COLS} FROM rels WHERE rel_type = 'CONTAINS'")
def rels_by_type(spark, sf_dir):
    return relationships.by_type(_rels(spark, sf_dir), "CONTAINS").select(*_FLAT)


@query(f"WITH {_RELS} SELECT {_ENC} AS line, 'rel:' || entity_id || ':' || related_id AS row_key FROM rels")
def rel_encoded(spark, sf_dir):
    return _rels(spark, sf_dir).select(codec.encode_relationship().alias("line"), codec.row_key().alias("row_key"))


_SHIP = f"""ship AS (SELECT 'customer:' || o_custkey AS entity_id, 'supplier:' || (l_suppkey % 20) AS related_id, CASE WHEN l_linenumber % 2 = 0 THEN 'DEPENDS_ON' ELSE 'INTERACTS_WITH' END AS rel_type,
  round(0.5 + l_discount, 2) AS confidence, {_MS.format('l_shipdate')} AS created_at, CASE WHEN l_returnflag = 'R' THEN {_MS.format('l_shipdate')} + 2592000000 ELSE 0 END AS expires_at,
  l_quantity::BIGINT AS frequency, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS source FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_LIVE = f"live AS (SELECT * FROM ship WHERE NOT (expires_at > 0 AND expires_at <= {SHIP_NOW}))"
_ONCE = "once AS (SELECT * FROM live QUALIFY row_number() OVER (PARTITION BY entity_id, related_id, rel_type ORDER BY created_at DESC, source) = 1)"
_SHIP_COLS = "entity_id, related_id, rel_type, confidence, created_at, expires_at, frequency, source"


def _merged(table: str) -> str:
    return f"""SELECT entity_id, related_id, first(rel_type ORDER BY created_at DESC, rel_type, source) AS rel_type, max(confidence) AS confidence, max(created_at) AS created_at,
  first(expires_at ORDER BY created_at DESC, rel_type, source) AS expires_at, sum(frequency)::BIGINT AS frequency,
  repeat('merged:', count(*)::INT - 1) || string_agg(source, ',' ORDER BY created_at DESC, rel_type, source) AS source FROM {table} GROUP BY entity_id, related_id"""


def _ship(df):
    return df.select(*[c.strip() for c in _SHIP_COLS.split(",")])


@query(f"WITH {_SHIP}, {_LIVE} SELECT {_SHIP_COLS} FROM live")
def compact_expire(spark, sf_dir):
    return _ship(relationships.without_expired(src.shipments(spark, sf_dir), SHIP_NOW))


@query(f"WITH {_SHIP}, live AS (SELECT * FROM ship), {_ONCE} SELECT {_SHIP_COLS} FROM once")
def compact_dedup(spark, sf_dir):
    return _ship(compaction.dedup(src.shipments(spark, sf_dir)))


@query(f"WITH {_SHIP} {_merged('ship')}")
def compact_merge(spark, sf_dir):
    return _ship(compaction.merge(src.shipments(spark, sf_dir)))


@query(f"WITH {_SHIP}, {_LIVE}, {_ONCE} {_merged('once')}")
def compact_full(spark, sf_dir):
    return _ship(compaction.compact(src.shipments(spark, sf_dir), SHIP_NOW))


_ACCESS = "ac AS (SELECT 'supplier:' || (l_suppkey % 20) AS related_id, (l_suppkey % 20) / 20.0 AS access_frequency FROM lineitem WHERE l_suppkey % 20 < 18 GROUP BY ALL)"


def _access(spark, sf_dir):
    n = F.col("l_suppkey") % 20
    return src.table(spark, sf_dir, "lineitem").where(n < 18).select(F.concat(F.lit("supplier:"), n.cast("string")).alias("related_id"), (n / 20).alias("access_frequency")).distinct()


@query(f"WITH {_SHIP}, {_ACCESS} SELECT {_SHIP_COLS} FROM ship LEFT JOIN ac USING (related_id) WHERE coalesce(access_frequency, 0.5) >= 0.1")
def compact_freq_filter(spark, sf_dir):
    return _ship(compaction.frequency_filter(src.shipments(spark, sf_dir), _access(spark, sf_dir)))


_SHIP_ENC = "octet_length(encode(entity_id || '|' || related_id || '|' || rel_type || '|EXPLICIT|' || regexp_replace(regexp_replace(format('{:.6f}', confidence), '0+$', ''), '[.]$', '') || '|' || created_at || '|' || expires_at || '|' || frequency || '|' || source || '|{flag=O,line1=R}'))"


@query(f"""WITH {_SHIP}, fi AS (SELECT entity_id, count(*) AS n, count(*) FILTER (expires_at > 0 AND expires_at <= {SHIP_NOW}) AS expired, (octet_length(encode(entity_id)) + 8 + sum({_SHIP_ENC} + 1))::BIGINT AS size_bytes FROM ship GROUP BY entity_id)
SELECT entity_id, n, expired, size_bytes, round(greatest(size_bytes / 1048576.0, n / 10000.0, expired / n, 0.5), 6) AS priority FROM fi ORDER BY priority DESC, entity_id LIMIT 100""")
def compact_priority(spark, sf_dir):
    out = compaction.schedule(compaction.entity_figures(src.shipments(spark, sf_dir), SHIP_NOW), compaction.HybridPolicy())
    return out.select("entity_id", "n", "expired", "size_bytes", "priority")


@query(f"""WITH {_SHIP}, fi AS (SELECT entity_id, count(*) FILTER (expires_at > 0 AND expires_at <= {SHIP_NOW}) AS expired, max(created_at) AS last_ms FROM ship GROUP BY entity_id)
SELECT entity_id, last_ms, {SHIP_NOW} - last_ms > 86400000 AS idle, expired > 0 AS any_expired FROM fi""")
def compact_should(spark, sf_dir):
    figures = compaction.entity_figures(src.shipments(spark, sf_dir), SHIP_NOW)
    idle = compaction.should_compact(figures, "time", SHIP_NOW)
    return idle.select("entity_id", "last_ms", F.col("should").alias("idle"), compaction.TimePolicy().should(None).alias("any_expired"))


@query(f"""WITH {_SHIP} SELECT entity_id, count(*) AS n, count(*) FILTER (expires_at > 0 AND expires_at <= {SHIP_NOW}) AS expired,
  count(*) > 1000 OR count(*) FILTER (expires_at > 0 AND expires_at <= {SHIP_NOW}) > count(*) // 2 AS needs FROM ship GROUP BY entity_id""")
def needs_compaction(spark, sf_dir):
    return relationships.needs_compaction(src.shipments(spark, sf_dir), SHIP_NOW)


@query(f"WITH {_RELS} SELECT entity_id, (octet_length(encode(entity_id)) + 8 + sum(octet_length(encode({_ENC})) + 1))::BIGINT AS size_bytes FROM rels GROUP BY entity_id")
def row_size(spark, sf_dir):
    return relationships.row_sizes(_rels(spark, sf_dir))


@query(f"WITH {_RELS} SELECT entity_id, count(*)::INT AS n, string_agg({_ENC}, ';' ORDER BY created_at DESC, related_id, rel_type, source) AS encoded FROM rels GROUP BY entity_id")
def wide_rows(spark, sf_dir):
    return relationships.wide_rows(_rels(spark, sf_dir))


@query(f"""WITH {_RELS} SELECT count(*) AS total, count(*) FILTER (expires_at = 0 OR expires_at > {AS_OF}) AS active, count(DISTINCT entity_id) AS entities,
  count(*) FILTER (inference_type <> 'EXPLICIT') AS inferred, round(avg(confidence), 6) AS avg_confidence FROM rels""")
def rel_stats(spark, sf_dir):
    return relationships.stats(_rels(spark, sf_dir), AS_OF)


def _walk(depth: int, where: str) -> str:
    return f"""WITH RECURSIVE {_RELS}, walk AS (SELECT '{ROOT}' AS node, 0 AS depth
  UNION SELECT r.related_id, w.depth + 1 FROM walk w JOIN rels r ON r.entity_id = w.node WHERE w.depth < {depth} AND ({where}))
SELECT node, min(depth)::INT AS depth FROM walk WHERE node <> '{ROOT}' GROUP BY node"""


_ACTIVE = f"expires_at = 0 OR expires_at > {AS_OF}"


@query(_walk(2, _ACTIVE))
def connected_d2(spark, sf_dir):
    return traverse.connected(_stored(spark, sf_dir), ROOT, AS_OF, 2)


@query(_walk(3, _ACTIVE))
def connected_d3(spark, sf_dir):
    return traverse.connected(_stored(spark, sf_dir), ROOT, AS_OF, 3)


@query(_walk(4, "rel_type = 'PRECEDES'"))
def reach_by_type(spark, sf_dir):
    return traverse.reached_by_type(_rels(spark, sf_dir), ROOT, "PRECEDES", 4)


_KEYED = "entity_id || '->' || related_id AS edge_key"


@query(f"WITH {_RELS} SELECT {_COLS}, {_KEYED} FROM rels WHERE (entity_id = 'customer:1' OR related_id = 'customer:1') AND rel_type IN ('DEPENDS_ON', 'CHILD_OF') ORDER BY edge_key, created_at, rel_type, source LIMIT 5")
def query_relationship(spark, sf_dir):
    return traverse.query_relationship(_rels(spark, sf_dir), "customer:1", ["DEPENDS_ON", "CHILD_OF"], True, 5).select(*_FLAT, "edge_key")


@query(f"""WITH {_RELS}, ends AS (SELECT entity_id AS node_id, *, {_KEYED} FROM rels UNION ALL SELECT related_id, *, {_KEYED} FROM rels WHERE related_id <> entity_id)
SELECT node_id, edge_key, rel_type, row_number() OVER (PARTITION BY node_id ORDER BY edge_key, created_at, rel_type, source)::INT AS rank FROM ends
WHERE node_id IN (SELECT 'supplier:' || s_suppkey FROM supplier UNION ALL SELECT 'nation:' || n_nationkey FROM nation) QUALIFY rank <= 3""")
def batch_query_topk(spark, sf_dir):
    ids = src.table(spark, sf_dir, "supplier").select(src.id_of("supplier", "s_suppkey").alias("node_id")).unionByName(src.table(spark, sf_dir, "nation").select(src.id_of("nation", "n_nationkey").alias("node_id")))
    return traverse.batch_query(_rels(spark, sf_dir), ids, 3).select("node_id", "edge_key", "rel_type", "rank")


_AROUND = f"""WITH RECURSIVE {_RELS}, ed AS (SELECT * FROM rels WHERE rel_type IN ('PRECEDES', 'DEPENDS_ON')),
both_ AS (SELECT entity_id AS a, related_id AS b FROM ed UNION ALL SELECT related_id, entity_id FROM ed),
walk AS (SELECT '{ROOT}' AS node, 0 AS depth UNION SELECT b, depth + 1 FROM walk JOIN both_ ON a = node WHERE depth < 3)
SELECT node AS node_id, min(depth)::INT AS depth FROM walk GROUP BY node"""


@query(_AROUND)
def subgraph_nodes(spark, sf_dir):
    return traverse.subgraph(_stored(spark, sf_dir), ROOT, 3, ["PRECEDES", "DEPENDS_ON"], max_nodes=1_000_000)[0].select("node_id", "depth")


@query(f"WITH {_RELS} SELECT {_COLS} FROM rels WHERE (entity_id = 'customer:1' OR related_id = 'customer:1') AND inference_type = 'EXPLICIT' AND created_at BETWEEN 800000000000 AND 950000000000")
def query_relationship_times(spark, sf_dir):
    return traverse.query_relationship(_rels(spark, sf_dir), "customer:1", None, False, 100_000, 800_000_000_000, 950_000_000_000).select(*_FLAT)


_NEAREST = "idx, edge_key, created_at, rel_type, source"


def _levels(depth: int, max_nodes: int) -> str:
    """SQL of the nodes and the edges that reached them first, level by level."""
    out = f"""WITH {_RELS}, ed AS (SELECT *, {_KEYED} FROM rels WHERE rel_type IN ('PRECEDES', 'DEPENDS_ON')),
  both_ AS (SELECT *, entity_id AS a, related_id AS b FROM ed UNION ALL SELECT *, related_id, entity_id FROM ed),
  v0 AS (SELECT '{ROOT}' AS node, 0 AS idx, 0 AS depth, NULL AS entity_id, NULL AS related_id, NULL AS rel_type, NULL AS source)"""
    for d in range(1, depth + 1):
        out += f""",
  c{d} AS (SELECT both_.*, f.idx FROM both_ JOIN (SELECT node, idx FROM v{d - 1} WHERE depth = {d - 1}) f ON a = f.node WHERE b NOT IN (SELECT node FROM v{d - 1}) QUALIFY row_number() OVER (PARTITION BY b ORDER BY {_NEAREST}) = 1),
  v{d} AS (SELECT * FROM v{d - 1} UNION ALL SELECT * FROM (SELECT b AS node, (row_number() OVER (ORDER BY {_NEAREST}, b) + (SELECT count(*) FROM v{d - 1}) - 1)::INT AS idx, {d} AS depth, entity_id, related_id, rel_type, source FROM c{d}) WHERE idx < {max_nodes})"""
    return out


@query(_levels(3, 8) + " SELECT node AS node_id, depth::INT AS depth, idx::INT AS node_index FROM v3")
def subgraph_indices(spark, sf_dir):
    return traverse.subgraph(_stored(spark, sf_dir), ROOT, 3, ["PRECEDES", "DEPENDS_ON"], max_nodes=8)[0]


@query(_levels(3, 1_000_000) + " SELECT entity_id, related_id, rel_type, source, node AS reached, depth::INT AS depth FROM v3 WHERE depth > 0")
def subgraph_edges(spark, sf_dir):
    return traverse.subgraph(_stored(spark, sf_dir), ROOT, 3, ["PRECEDES", "DEPENDS_ON"], max_nodes=1_000_000)[1]


_LOG = "lg AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'PUT' END AS op, 'user:' || user_id || '/' || (props ->> '$.k') AS key, event_type || '=' || value AS value FROM events)"
_LATEST = "SELECT key, arg_max(value, seq) AS value, max(seq) AS seq FROM {0} GROUP BY key HAVING arg_max(op, seq) <> 'DELETE'"


@query(f"WITH {_LOG} {_LATEST.format('lg')}")
def kv_latest(spark, sf_dir):
    return kv.latest(src.kv_log(spark, sf_dir))


@query(f"WITH {_LOG}, o AS (SELECT * FROM lg WHERE key = 'user:46/89') {_LATEST.format('o')}")
def kv_get(spark, sf_dir):
    return kv.get(src.kv_log(spark, sf_dir), "user:46/89")


@query(f"WITH {_LOG}, o AS (SELECT * FROM lg WHERE key BETWEEN 'user:10/' AND 'user:20/5') {_LATEST.format('o')}")
def kv_scan_range(spark, sf_dir):
    return kv.scan(src.kv_log(spark, sf_dir), "user:10/", "user:20/5")


@query(f"WITH {_LOG}, w AS (SELECT DISTINCT 'user:' || c_custkey || '/7' AS key FROM customer), l AS ({_LATEST.format('lg')}) SELECT key, value, seq FROM w LEFT JOIN l USING (key)")
def kv_multi_get(spark, sf_dir):
    keys = src.table(spark, sf_dir, "customer").select(F.concat(F.lit("user:"), F.col("c_custkey").cast("string"), F.lit("/7")).alias("key"))
    return kv.multi_get(src.kv_log(spark, sf_dir), keys)


@query(f"WITH {_LOG} {_LATEST.format('lg')}")
def kv_replay(spark, sf_dir):
    log = src.kv_log(spark, sf_dir)
    return kv.replay(kv.latest(log.where("seq < 500")), log, 500)


@query(f"WITH {_LOG} SELECT key, seq, op, value, row_number() OVER (PARTITION BY key ORDER BY seq DESC)::INT AS version FROM lg")
def kv_versions(spark, sf_dir):
    return kv.versions(src.kv_log(spark, sf_dir))


_CRC = """tab AS (SELECT list(list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) r(i))"""


@query(f"""WITH {_LOG}, {_CRC} SELECT seq, key, xor(list_reduce(list_prepend(4294967295::UBIGINT, [ord(c)::UBIGINT FOR c IN string_split(value, '')]), lambda h, b: xor(h // 256, t[(xor(h, b) % 256 + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT AS crc FROM lg, tab""")
def kv_checksums(spark, sf_dir):
    return kv.checksums(src.kv_log(spark, sf_dir))


@query("SELECT 'user:' || user_id AS node_id, arg_max(event_type, event_id) AS node_type, max(event_id) AS seq FROM events GROUP BY user_id")
def node_upsert(spark, sf_dir):
    nodes = src.table(spark, sf_dir, "events").select(src.id_of("user", "user_id").alias("node_id"), F.col("event_type").alias("node_type"), F.col("event_id").alias("seq"))
    return relationships.upsert_nodes(nodes)


@query("""WITH k AS (SELECT c_custkey, 'customer:' || c_custkey AS s FROM customer),
b AS (SELECT c_custkey, ord(s[i]) AS c, i FROM k, range(1, 25) r(i) WHERE i <= length(s)),
l AS (SELECT c_custkey, list(c ORDER BY i) AS cs FROM b GROUP BY c_custkey)
SELECT c_custkey, (list_reduce(list_prepend(14695981039346656037::UHUGEINT, [x::UHUGEINT FOR x IN cs]), lambda h, c: ((xor(h, c)) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) % 16)::INT AS shard FROM l""")
def shard_assign(spark, sf_dir):
    return src.table(spark, sf_dir, "customer").select("c_custkey", routing.shard_of(src.id_of("customer", "c_custkey"), 16).alias("shard"))


_DJB2 = "list_reduce(list_prepend(5381::UHUGEINT, [ord(c)::UHUGEINT FOR c IN string_split({0}, '')]), lambda h, c: (h * 33 + c) % 18446744073709551616::UHUGEINT)::UBIGINT"


@query(f"""WITH pt AS (SELECT s, {_DJB2.format("'shard_' || s || '_node_' || r")} AS p FROM range(16) a(s), range(150) b(r)),
k AS (SELECT c_custkey, {_DJB2.format("'customer:' || c_custkey")} AS h FROM customer)
SELECT c_custkey, coalesce(s, (SELECT arg_min(s, p) FROM pt))::INT AS shard FROM k ASOF LEFT JOIN pt ON k.h <= pt.p""")
def ring_assign(spark, sf_dir):
    return src.table(spark, sf_dir, "customer").select("c_custkey", routing.ring_shard_of(src.id_of("customer", "c_custkey"), 16).alias("shard"))


@query(f"""WITH {_LOG}, l AS ({_LATEST.format('lg')}), c AS (SELECT *, sum(octet_length(encode(key)) + coalesce(octet_length(encode(value)), 0)) OVER (ORDER BY seq DESC) AS upto FROM l)
SELECT key, value, seq FROM c WHERE upto <= 65536""")
def kv_row_cache(spark, sf_dir):
    return kv.cached(src.kv_log(spark, sf_dir), 65536)


_SHARDS = f"""{_LOG}, ke AS (SELECT key, count(*) AS operations, count(*) FILTER (op = 'PUT') AS puts, count(*) FILTER (op = 'DELETE') AS deletes,
  sum(octet_length(encode(key)) + coalesce(octet_length(encode(value)), 0)) AS bytes, max(seq) AS last_seq FROM lg GROUP BY key),
pl AS (SELECT *, (list_reduce(list_prepend(14695981039346656037::UHUGEINT, [ord(c)::UHUGEINT FOR c IN string_split(key, '')]), lambda h, c: (xor(h, c) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) % 16)::INT AS shard FROM ke),
sh AS (SELECT shard, count(*) AS keys, sum(operations)::BIGINT AS operations, sum(puts)::BIGINT AS puts, sum(deletes)::BIGINT AS deletes, sum(bytes)::BIGINT AS bytes, max(last_seq) AS last_seq FROM pl GROUP BY shard)"""


@query(f"WITH {_SHARDS} SELECT * FROM sh")
def shard_stats(spark, sf_dir):
    return monitoring.shard_stats(src.kv_log(spark, sf_dir), 16)


@query(f"""WITH {_SHARDS} SELECT count(*) AS shards, sum(keys)::BIGINT AS keys, sum(operations)::BIGINT AS operations, sum(puts)::BIGINT AS puts, sum(deletes)::BIGINT AS deletes, sum(bytes)::BIGINT AS bytes,
  max(last_seq) AS last_seq, round(max(operations) / avg(operations), 6) AS imbalance FROM sh""")
def global_stats(spark, sf_dir):
    stats = monitoring.global_stats(monitoring.shard_stats(src.kv_log(spark, sf_dir), 16))
    return stats.withColumn("imbalance", F.round("imbalance", 6))


@query("SELECT user_id, count(*) AS queue_depth, CASE WHEN count(*) > 10000 OR max(value) > 100 OR avg(value) / 100 > 0.8 THEN 'DEGRADED' ELSE 'HEALTHY' END AS status FROM events GROUP BY user_id")
def health(spark, sf_dir):
    metrics = src.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("queue_depth"), F.max("value").alias("backlog"), (F.avg("value") / 100).alias("memory_usage"))
    return monitoring.health(metrics).select("user_id", "queue_depth", "status")


def _as_stream(spark, sf_dir, name: str, files: int = 40) -> tuple[DataFrame, str]:
    """The events as a stream of so many files, none of them in the order of time, and a folder for the stream's tables."""
    path = written(src.events(spark, sf_dir).repartition(files, "event_id"), name, "zstd").inputFiles()[0].rpartition("/")[0]
    return ingest.read_events(spark, path), fresh_path(spark, f"{name}-out")


@query(f"WITH {_EVENTS} SELECT 'node' AS kind, event_type AS name, count(*) AS n FROM ev GROUP BY 2 UNION ALL SELECT 'rel', 'REFERENCES', sum(CASE WHEN n % 50 = 0 THEN 5 WHEN n % 3 = 0 THEN 1 ELSE 0 END)::BIGINT FROM ev")
def stream_ingest(spark, sf_dir):
    stream, out = _as_stream(spark, sf_dir, "stream-ingest")
    ingest.ingest(stream, out, out + "/checkpoint").awaitTermination()
    nodes = spark.read.parquet(out + "/nodes").groupBy(F.lit("node").alias("kind"), F.col("node_type").alias("name")).agg(F.count("*").alias("n"))
    return nodes.unionByName(spark.read.parquet(out + "/rels").groupBy(F.lit("rel").alias("kind"), F.col("rel_type").alias("name")).agg(F.count("*").alias("n")))


@query(f"WITH {_EVENTS}, {_TEMPORAL} SELECT event_id, entity_id, related_id, created_at, round(confidence, 6) AS confidence FROM te WHERE confidence >= 0.7")
def stream_infer(spark, sf_dir):
    stream, out = _as_stream(spark, sf_dir, "stream-infer")
    ingest.infer_near(stream, out, out + "/checkpoint").awaitTermination()
    made = spark.read.parquet(out + "/rels")
    return made.select("event_id", "entity_id", "related_id", "created_at", F.round("confidence", 6).alias("confidence"))


def _spoiled(spark, sf_dir) -> DataFrame:
    """The events, each fifth without an entity and each seventh without a time."""
    number = F.substring_index("event_id", ":", -1).cast("long")
    return src.events(spark, sf_dir).withColumn("entity_id", F.when(number % 5 != 0, F.col("entity_id"))).withColumn("ts_ms", F.when(number % 7 != 0, F.col("ts_ms")))


@query(f"""WITH {_EVENTS} SELECT CASE WHEN n % 5 = 0 THEN 'no entity id' WHEN n % 7 = 0 THEN 'no time' END AS error, count(*) AS n FROM ev GROUP BY 1""")
def ingest_validate(spark, sf_dir):
    return ingest.validated(_spoiled(spark, sf_dir)).groupBy("error").agg(F.count("*").alias("n"))


def _complete(counts: DataFrame, spark, out: str) -> DataFrame:
    """Runs a stream of counts to its end; each batch's table of complete counts replaces the one before."""
    keep = lambda batch, _: batch.write.mode("overwrite").parquet(out + "/counts")
    counts.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", out + "/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out + "/counts")


@query(f"WITH {_EVENTS} SELECT ts_ms // 3600000 * 3600000 AS start_ms, event_type, count(*) AS n FROM ev GROUP BY 1, 2")
def stream_windows(spark, sf_dir):
    stream, out = _as_stream(spark, sf_dir, "stream-windows")
    return _complete(ingest.windowed_counts(stream), spark, out)


@query(f"WITH {_EVENTS} SELECT (ts_ms // 1800000 - back) * 1800000 AS start_ms, event_type, count(*) AS n FROM ev, range(2) r(back) GROUP BY 1, 2")
def stream_sliding(spark, sf_dir):
    stream, out = _as_stream(spark, sf_dir, "stream-sliding")
    return _complete(ingest.windowed_counts(stream, "1 hour", slide="30 minutes"), spark, out)


@query(f"""WITH {_EVENTS}, st AS (SELECT *, CASE WHEN ts_ms < lag(ts_ms) OVER o + 600000 THEN 0 ELSE 1 END AS new FROM ev WINDOW o AS (PARTITION BY entity_id ORDER BY ts_ms)),
se AS (SELECT *, sum(new) OVER (PARTITION BY entity_id ORDER BY ts_ms ROWS UNBOUNDED PRECEDING) AS k FROM st)
SELECT entity_id, min(ts_ms) AS start_ms, max(ts_ms) + 600000 AS end_ms, count(*) AS n FROM se GROUP BY entity_id, k""")
def stream_sessions(spark, sf_dir):
    stream, out = _as_stream(spark, sf_dir, "stream-sessions")
    # The files are in no order of time, so the watermark has to reach over all of it.
    return _complete(ingest.session_counts(stream, late="3650 days"), spark, out)


@query(f"""WITH {_EVENTS} SELECT n % 5 <> 0 AND n % 7 <> 0 AS accepted, CASE WHEN n % 5 = 0 THEN 'no entity id' WHEN n % 7 = 0 THEN 'no time' END AS error, count(*) AS n FROM ev GROUP BY 1, 2""")
def ingest_acks(spark, sf_dir):
    """What a stream with spoiled events answers for each of them."""
    path = written(_spoiled(spark, sf_dir).repartition(8, "event_id"), "acks-in").inputFiles()[0].rpartition("/")[0]
    out = fresh_path(spark, "acks-out")
    ingest.ingest(ingest.read_events(spark, path), out, out + "/checkpoint").awaitTermination()
    return spark.read.parquet(out + "/acks").groupBy("accepted", "error").agg(F.count("*").alias("n"))


def _filled(spark, sf_dir, name: str, batches: int, keep: int = 0) -> KvStore:
    """A store that took the log in batches by sequence number and flushed each but the last `keep`."""
    log, store = src.kv_log(spark, sf_dir), KvStore(spark, fresh_path(spark, name))
    for k in range(batches):
        store, _ = store.put_batch(log.where(F.col("seq") % batches == k))
        if k < batches - keep:
            store = store.flush()
    return store


@query(f"WITH {_LOG} {_LATEST.format('lg')}")
def kv_flush_read(spark, sf_dir):
    """Live keys of a store of two sorted files and two segments of the log."""
    return _filled(spark, sf_dir, "kv-flush", 4, 2).live()


@query(f"WITH {_LOG}, o AS (SELECT * FROM lg WHERE key BETWEEN 'user:10/' AND 'user:20/5') {_LATEST.format('o')}")
def kv_store_scan(spark, sf_dir):
    return _filled(spark, sf_dir, "kv-scan", 2).scan("user:10/", "user:20/5")


@query(f"WITH {_LOG}, o AS (SELECT * FROM lg WHERE key = 'user:46/89') {_LATEST.format('o')}")
def kv_store_get(spark, sf_dir):
    return _filled(spark, sf_dir, "kv-get", 2, 1).get("user:46/89")


@query(f"WITH {_LOG} SELECT seq, op, key, CASE WHEN op = 'PUT' THEN value END AS value FROM lg WHERE seq % 3 > 0 AND seq >= 100")
def kv_recover(spark, sf_dir):
    """What a replay from sequence number 100 finds sound in the log, a third of which was flushed."""
    return _filled(spark, sf_dir, "kv-recover", 3, 2).recover(100)[0]


@query(f"WITH {_LOG} {_LATEST.format('lg')}")
def file_compaction(spark, sf_dir):
    """Live keys after five files were merged into one, deletes and old versions dropped."""
    store = _filled(spark, sf_dir, "kv-compact", 5).compact("leveled", least=4)
    return store._read(store.manifest.files).select("key", "value", "seq")


@query(f"""WITH {_LOG}, li AS ({_LATEST.format('lg')}) SELECT 5::BIGINT AS batches, count(*) AS rows_written, 5::BIGINT AS flushes, 1::BIGINT AS compactions, 5::BIGINT AS files_merged, 0::BIGINT AS segments, 1::BIGINT AS files, (SELECT count(*) FROM li) AS file_rows FROM lg""")
def write_stats(spark, sf_dir):
    stats = _filled(spark, sf_dir, "kv-stats", 5).compact("leveled", least=4).stats()
    return stats.select("batches", "rows_written", "flushes", "compactions", "files_merged", "segments", "files", "file_rows")


@query("SELECT 'present' AS kind, count(DISTINCT c_custkey) AS probes, 0::BIGINT AS denied, true AS within_rate FROM customer UNION ALL SELECT 'absent', count(DISTINCT c_custkey), NULL, true FROM customer")
def bloom_lookup(spark, sf_dir):
    """Bloom filters of all customers' ids in eight parts, asked for all of them and for as many other ids: none of the former
    may be denied, of the latter at most 3 in 100 let through."""
    ids = src.table(spark, sf_dir, "customer").select(src.id_of("customer", "c_custkey").alias("id"))
    items = max(64, ids.count() // 8)
    filters = written(bloom.partitioned_filter(ids, "id", 8, items), "bloom")
    probes = ids.select("id", F.lit("present").alias("kind")).unionByName(ids.select(F.concat("id", F.lit("?")).alias("id"), F.lit("absent").alias("kind"))).distinct()
    found = bloom.might_contain(filters, probes, "id", 8, items).join(probes, "id")
    return found.groupBy("kind").agg(F.count("*").alias("probes"), F.count_if(~F.col("maybe")).alias("no"), F.count_if("maybe").alias("yes")).select(
        "kind", "probes", F.when(F.col("kind") == "present", F.col("no")).alias("denied"), F.when(F.col("kind") == "present", F.lit(True)).otherwise(F.col("yes") <= 0.03 * F.col("probes")).alias("within_rate"),
    )


@query(f"""WITH sh AS (SELECT 'customer:' || o_custkey AS entity_id, 'supplier:' || (l_suppkey % 20) AS related_id, CASE WHEN l_linenumber % 2 = 0 THEN 'DEPENDS_ON' ELSE 'INTERACTS_WITH' END AS rel_type,
  {_MS.format('l_shipdate')} AS created_at, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS source, l_linestatus, 'line' || l_linenumber AS line, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
en AS (SELECT *, 'flag' AS k, l_linestatus AS v FROM sh UNION ALL SELECT *, line, l_returnflag FROM sh),
la AS (SELECT entity_id, related_id, k, arg_max(v, (-created_at, rel_type, source)) AS v FROM en GROUP BY ALL)
SELECT entity_id, related_id, string_agg(k || '=' || v, ',' ORDER BY k) AS attributes FROM la GROUP BY ALL""")
def compact_merge_attributes(spark, sf_dir):
    """The attributes of merged relationships: of each name, the value of the last one in the order of folding."""
    pairs = F.array_sort(F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return compaction.merge(src.shipments(spark, sf_dir)).select("entity_id", "related_id", F.array_join(pairs, ",").alias("attributes"))


_FIGURES = f"""fi AS (SELECT entity_id, count(*) AS n, count(*) FILTER (expires_at > 0 AND expires_at <= {SHIP_NOW}) AS expired,
  (octet_length(encode(entity_id)) + 8 + sum({_SHIP_ENC} + 1))::BIGINT AS size_bytes, min(coalesce(access_frequency, 0.5)) AS min_access FROM ship LEFT JOIN ac USING (related_id) GROUP BY entity_id)"""
_SMALL = CompactionConfig(max_bytes=4000, max_relationships=30, min_frequency=0.04, min_priority=0.9)


@query(f"""WITH {_SHIP}, {_ACCESS}, {_FIGURES} SELECT entity_id, size_bytes > 4000 OR n > 30 AS by_size, min_access < 0.04 AS by_frequency,
  greatest(size_bytes / 4000.0, n / 30.0, expired / n, 1 - least(1.0, min_access)) >= 0.9 AS by_hybrid, round(1 - least(1.0, min_access), 6) AS frequency_priority FROM fi""")
def compact_policies(spark, sf_dir):
    """What the size, frequency and hybrid strategies say of each entity, by measured accesses."""
    figures = compaction.entity_figures(src.shipments(spark, sf_dir), SHIP_NOW, _access(spark, sf_dir), _SMALL)
    for kind in ("size", "frequency", "hybrid"):
        figures = compaction.should_compact(figures, kind, SHIP_NOW, _SMALL).withColumnRenamed("should", f"by_{kind}")
    return figures.select("entity_id", "by_size", "by_frequency", "by_hybrid", F.round(compaction.FrequencyPolicy().priority(_SMALL), 6).alias("frequency_priority"))


@query(f"""WITH {_SHIP}, ru AS (SELECT count(*) - count(*) FILTER (NOT (expires_at > 0 AND expires_at <= {SHIP_NOW})) AS removed, coalesce(sum(frequency) FILTER (expires_at > 0 AND expires_at <= {SHIP_NOW}), 0) AS bytes_saved, count(*)::DOUBLE AS ms FROM ship GROUP BY entity_id)
SELECT count(*) AS runs, sum(removed)::BIGINT AS removed, sum(bytes_saved)::BIGINT AS bytes_saved, round(avg(ms), 6) AS avg_ms FROM ru""")
def compact_run_stats(spark, sf_dir):
    """Totals of a log of compaction runs, one for each entity; its frequencies stand for bytes, its rows for milliseconds."""
    gone = (F.col("expires_at") > 0) & (F.col("expires_at") <= SHIP_NOW)
    runs = src.shipments(spark, sf_dir).groupBy("entity_id").agg(F.count_if(gone).alias("removed"), F.coalesce(F.sum(F.when(gone, F.col("frequency"))), F.lit(0)).alias("bytes_saved"), F.count("*").cast("double").alias("ms"))
    return compaction.run_stats(runs).withColumn("avg_ms", F.round("avg_ms", 6))


@query(f"""WITH {_EVENTS}, ve AS (SELECT *, CASE WHEN user_id % 3 = 0 THEN entity_id || '_v2' ELSE entity_id END AS id FROM (SELECT ev.*, user_id FROM ev JOIN events ON n = events.event_id))
SELECT CASE WHEN e.user_id % 3 = 0 OR o.user_id % 3 = 0 THEN 'VERSION_MUTATION' ELSE {_TYPE} END AS rel_type, count(*) AS n
FROM ve e JOIN ve o ON o.ts_ms BETWEEN e.ts_ms - 642014 AND e.ts_ms AND e.id <> o.id AND e.event_id <> o.event_id WHERE {_SIM} >= 0.7 GROUP BY 1""")
def infer_versions(spark, sf_dir):
    """Types of temporal relationships where a third of the users have versioned ids."""
    number = F.substring_index("entity_id", ":", -1).cast("long")
    ids = F.when(number % 3 == 0, F.concat("entity_id", F.lit("_v2"))).otherwise(F.col("entity_id"))
    return inference.temporal(src.events(spark, sf_dir).withColumn("entity_id", ids)).groupBy("rel_type").agg(F.count("*").alias("n"))


@query(f"""WITH {_EVENTS}, no AS (SELECT entity_id FROM ev WHERE n % 5 <> 0 AND n % 7 <> 0 GROUP BY 1), re AS (SELECT CASE WHEN n % 50 = 0 THEN 5 WHEN n % 3 = 0 THEN 1 ELSE 0 END AS r, entity_id FROM ev WHERE n % 5 <> 0 AND n % 7 <> 0)
SELECT (SELECT count(*) FROM no) AS nodes, sum(r)::BIGINT AS total, sum(r)::BIGINT AS active, count(DISTINCT entity_id) FILTER (r > 0) AS entities, 0::BIGINT AS inferred FROM re""")
def engine_ingest(spark, sf_dir):
    """The engine object after it took in all events but the spoiled ones."""
    none = spark.createDataFrame([], NODE), spark.createDataFrame([], RELATIONSHIP)
    engine = Engine(*none).ingest(_spoiled(spark, sf_dir))
    nodes = engine.nodes.agg(F.count("*").alias("nodes"))
    return engine.stats(AS_OF).select("total", "active", "entities", "inferred").join(nodes)
