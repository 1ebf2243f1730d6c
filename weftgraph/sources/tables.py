"""Events, relationships, nodes and key-value logs made of the relational tables. Ids are "kind:number"."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.schemas import RELATIONSHIP

MONTH_MS = 30 * 86_400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts: str) -> Column:
    """Epoch milliseconds, rounded down, of a timestamp without time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts}) div 1000")


def id_of(kind: str, number: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(number).cast("string"))


def events(spark: SparkSession, sf_dir: str, entity: str = "user") -> DataFrame:
    """The events table in the event schema. entity "type" takes the event type as the entity, for co-occurrence.

    Payloads hold trigger words by user_id; every third event has one explicit relationship, every fiftieth five.
    """
    words = F.element_at(F.array(*map(F.lit, ("requires item", "parent page", "because of offer", "plain"))), (F.col("user_id") % 4 + 1).cast("int"))
    owner = id_of("user", "user_id") if entity == "user" else F.concat(F.lit("type:"), F.col("event_type"))
    base = table(spark, sf_dir, "events").select(
        id_of("event", "event_id").alias("event_id"), owner.alias("entity_id"), "event_type", millis("ts").alias("ts_ms"),
        F.concat_ws(" ", "event_type", words).alias("payload"), F.create_map(F.lit("props"), F.col("props")).alias("features"),
        F.when(F.col("event_id") % 50 == 0, 5).when(F.col("event_id") % 3 == 0, 1).otherwise(0).alias("n"),
    )
    one = lambda i: F.struct(
        F.col("entity_id"), F.concat(F.lit("page:"), i.cast("string")).alias("related_id"), F.lit("REFERENCES").alias("rel_type"), F.lit("EXPLICIT").alias("inference_type"),
        F.lit(1.0).alias("confidence"), F.col("ts_ms").alias("created_at"), F.lit(0).cast("long").alias("expires_at"), F.lit(1).cast("long").alias("frequency"),
        F.lit("api").alias("source"), F.create_map().cast("map<string,string>").alias("attributes"),
    )
    made = F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(1), F.greatest("n", F.lit(1))), one)).otherwise(F.array().cast(f"array<struct<{RELATIONSHIP.replace(', ', ',').replace(' ', ':')}>>"))
    return base.withColumn("explicit", made).drop("n")


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose payloads state a relationship between an order and a customer, in eight wordings."""
    verbs = ("interacts with", "depends on", "child of", "version 3 of", "causes", "precedes", "contained", "references")
    verb = F.element_at(F.array(*map(F.lit, verbs)), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        id_of("statement", "o_orderkey").alias("event_id"), id_of("order", "o_orderkey").alias("entity_id"), F.lit("statement").alias("event_type"),
        millis("o_orderdate").alias("ts_ms"), F.concat_ws(" ", id_of("order", "o_orderkey"), verb, id_of("customer", "o_custkey")).alias("payload"),
    )


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The property graph of the tables: structural edges are permanent, those of events expire after 30 days."""

    def edges(df: DataFrame, a: Column, b: Column, kind: str, source: str, created=None, expires=None, frequency=None, inference: str = "EXPLICIT", confidence: float = 1.0) -> DataFrame:
        zero = F.lit(0).cast("long")
        return df.select(
            a.alias("entity_id"), b.alias("related_id"), F.lit(kind).alias("rel_type"), F.lit(inference).alias("inference_type"), F.lit(confidence).alias("confidence"),
            (zero if created is None else created).alias("created_at"), (zero if expires is None else expires).alias("expires_at"),
            (F.lit(1).cast("long") if frequency is None else frequency).alias("frequency"), F.lit(source).alias("source"), F.create_map(F.lit("table"), F.lit(source)).alias("attributes"),
        )

    t = lambda name: table(spark, sf_dir, name)
    orders = t("orders").withColumn("ms", millis("o_orderdate"))
    after = orders.withColumn("next", F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("ms", "o_orderkey"))).where("next is not null")
    lines = t("lineitem").groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n"))
    supply = t("lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    seen = t("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max(millis("ts")).alias("ms"))
    parts = (
        edges(t("customer"), id_of("customer", "c_custkey"), id_of("nation", "c_nationkey"), "CHILD_OF", "customer"),
        edges(t("supplier"), id_of("supplier", "s_suppkey"), id_of("nation", "s_nationkey"), "CHILD_OF", "supplier"),
        edges(t("nation"), id_of("nation", "n_nationkey"), id_of("region", "n_regionkey"), "CHILD_OF", "nation"),
        edges(orders, id_of("order", "o_orderkey"), id_of("customer", "o_custkey"), "DEPENDS_ON", "orders", F.col("ms")),
        edges(after, id_of("order", "o_orderkey"), id_of("order", "next"), "PRECEDES", "sequence", F.col("ms"), inference="TEMPORAL", confidence=0.9),
        edges(lines, id_of("order", "l_orderkey"), id_of("part", "l_partkey"), "CONTAINS", "lineitem", frequency=F.col("n")),
        edges(supply, id_of("part", "l_partkey"), id_of("supplier", "l_suppkey"), "REFERENCES", "supply", frequency=F.col("n")),
        edges(seen, id_of("user", "user_id"), F.concat(F.lit("type:"), F.col("event_type")), "INTERACTS_WITH", "events", F.col("ms"), F.col("ms") + MONTH_MS, F.col("n"), "FREQUENCY_BASED", 0.8),
    )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relationship set with duplicates for compaction: customers and suppliers by lineitem, of two types."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    ms = millis("l_shipdate")
    return lines.select(
        id_of("customer", "o_custkey").alias("entity_id"), F.concat(F.lit("supplier:"), (F.col("l_suppkey") % 20).cast("string")).alias("related_id"),
        F.when(F.col("l_linenumber") % 2 == 0, "DEPENDS_ON").otherwise("INTERACTS_WITH").alias("rel_type"), F.lit("EXPLICIT").alias("inference_type"),
        F.round(0.5 + F.col("l_discount"), 2).alias("confidence"), ms.alias("created_at"),
        F.when(F.col("l_returnflag") == "R", ms + MONTH_MS).otherwise(0).cast("long").alias("expires_at"), F.col("l_quantity").cast("long").alias("frequency"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("source"), F.create_map(F.lit("flag"), F.col("l_linestatus"), F.concat(F.lit("line"), F.col("l_linenumber").cast("string")), F.col("l_returnflag")).alias("attributes"),
    )


def kv_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of puts and, for errors, deletes of each user's last value by k."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "DELETE").otherwise("PUT").alias("op"),
        F.concat(F.lit("user:"), F.col("user_id").cast("string"), F.lit("/"), F.get_json_object("props", "$.k")).alias("key"), F.concat_ws("=", "event_type", F.col("value").cast("string")).alias("value"),
    )
