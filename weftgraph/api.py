"""One object over an engine's tables, for callers that think in requests rather than DataFrames."""

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.config import InferenceConfig
from weftgraph.operators import inference, relationships, traverse
from weftgraph.streaming.ingest import validated


@dataclass(frozen=True)
class Engine:
    """nodes (node_id, node_type, attributes, ts_ms, payload) and rels, both immutable: what changes them returns a new engine."""

    nodes: DataFrame
    rels: DataFrame

    def ingest(self, events: DataFrame, config: InferenceConfig | None = None) -> "Engine":
        """With the events' nodes (the latest write of each counts), their explicit relationships and, given a config, the inferred ones.

        Events that fail validated() are left out.
        """
        good = validated(events).where("error is null").drop("error")
        new = good.select(F.col("entity_id").alias("node_id"), F.col("event_type").alias("node_type"), F.col("features").alias("attributes"), "ts_ms", "payload")
        nodes = relationships.upsert_nodes(self.nodes.unionByName(new), "ts_ms").select(*self.nodes.columns)
        made = inference.process_events(good, config).drop("event_id") if config else good.select(F.explode("explicit").alias("r")).select("r.*")
        return replace(self, nodes=nodes, rels=self.rels.unionByName(made.select(*self.rels.columns)))

    def related(self, entity: str) -> DataFrame:
        return relationships.related_pairs(self.rels, entity)

    def query(self, node: str, **filters) -> DataFrame:
        return traverse.query_relationship(self.rels, node, **filters)

    def batch_query(self, nodes: DataFrame, per_node: int, **filters) -> DataFrame:
        return traverse.batch_query(self.rels, nodes, per_node, **filters)

    def graph_around(self, root: str, **limits) -> tuple[DataFrame, DataFrame]:
        """(nodes with their stored columns, edges)."""
        found, edges = traverse.subgraph(self.rels, root, known=self.nodes, **limits)
        return found.join(self.nodes, "node_id"), edges

    def stats(self, as_of: int) -> DataFrame:
        return relationships.stats(self.rels, as_of)
