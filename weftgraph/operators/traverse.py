"""Graph queries by frontier: each hop joins the frontier with the edges and drops what was visited. Hops are written
to the shared folder, so plans stay short; the only action a hop takes is to see whether it found anything."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.relationships import is_active
from weftgraph.plans.lineage import written


#: Nodes of a frontier up to which a hop asks for them by name, so that a table sorted by entity is read in part.
NAMED = 256


def _hop(edges: DataFrame, frontier: DataFrame) -> tuple[DataFrame, int]:
    """The edges that leave the frontier's nodes, and how many these are, up to NAMED + 1."""
    names = [r[0] for r in frontier.select("node").limit(NAMED + 1).collect()]
    if len(names) <= NAMED:
        return edges.where(F.col("a").isin(names)), len(names)
    return edges.join(frontier.select(F.col("node").alias("a")), "a"), len(names)


def _reach(edges: DataFrame, root: str, depth: int) -> DataFrame:
    """(node, depth) over edges (a, b) from the root, the root itself left out."""
    spark = edges.sparkSession
    visited = spark.createDataFrame([(root, 0)], "node string, depth int")
    frontier = visited
    for d in range(1, depth + 1):
        out, n = _hop(edges, frontier)
        if n == 0:
            break
        step = out.select(F.col("b").alias("node")).distinct()
        frontier = written(step.join(visited, "node", "left_anti").withColumn("depth", F.lit(d)), "frontier")
        visited = visited.unionByName(frontier)
    return visited.where("depth > 0")


def connected(rels: DataFrame, root: str, as_of: int, depth: int = 2) -> DataFrame:
    """Entities reached over active relationships, outgoing only, at their first depth."""
    return _reach(rels.where(is_active(as_of)).select(F.col("entity_id").alias("a"), F.col("related_id").alias("b")), root, depth)


def reached_by_type(rels: DataFrame, root: str, rel_type: str, depth: int = 1) -> DataFrame:
    """The same over one type, expired relationships included."""
    return _reach(rels.where(F.col("rel_type") == rel_type).select(F.col("entity_id").alias("a"), F.col("related_id").alias("b")), root, depth)


def _filtered(rels: DataFrame, types: list[str] | None, inferred: bool, start: int, end: int) -> DataFrame:
    if types:
        rels = rels.where(F.col("rel_type").isin(types))
    if not inferred:
        rels = rels.where(F.col("inference_type") == "EXPLICIT")
    if start:
        rels = rels.where(F.col("created_at") >= start)
    return rels.where(F.col("created_at") <= end) if end else rels


_ORDER = ("edge_key", "created_at", "rel_type", "source")


def query_relationship(rels: DataFrame, node: str, types: list[str] | None = None, include_inferred: bool = True, max_results: int = 100, start: int = 0, end: int = 0) -> DataFrame:
    """The first max_results relationships from or to the node, in the order of "source->target". 0 results: none; 0 times: unbounded."""
    own = rels.where((F.col("entity_id") == node) | (F.col("related_id") == node))
    return _filtered(own, types, include_inferred, start, end).withColumn("edge_key", F.concat("entity_id", F.lit("->"), "related_id")).orderBy(*_ORDER).limit(max_results)


def batch_query(rels: DataFrame, nodes: DataFrame, per_node: int, types: list[str] | None = None, include_inferred: bool = True) -> DataFrame:
    """For each node_id of nodes, the first per_node relationships from or to it, with their rank."""
    rels = _filtered(rels, types, include_inferred, 0, 0).withColumn("edge_key", F.concat("entity_id", F.lit("->"), "related_id"))
    ends = F.array_distinct(F.array("entity_id", "related_id"))
    own = rels.withColumn("node_id", F.explode(ends)).join(nodes.select("node_id").distinct(), "node_id")
    rank = F.row_number().over(Window.partitionBy("node_id").orderBy(*_ORDER))
    return own.withColumn("rank", rank).where(F.col("rank") <= per_node)


def subgraph(rels: DataFrame, root: str, depth: int = 2, types: list[str] | None = None, max_nodes: int = 1000, include_inferred: bool = True, start: int = 0, end: int = 0, known: DataFrame | None = None, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around the root, undirected: nodes (node_id, depth, node_index), edges with the node they led to.

    An edge is kept if it was the first to reach its node: by the reaching node's place, then "source->target", then
    creation, type and source. Nodes beyond max_nodes are cut off with their edges. `known` (node_id) are the stored
    nodes: others are walked through but not emitted. compat ignores depth, types, time and inference filters.
    """
    spark = rels.sparkSession
    if not compat:
        rels = _filtered(rels, types, include_inferred, start, end)
    rels = rels.select("entity_id", "related_id", "rel_type", "source", "created_at", F.concat("entity_id", F.lit("->"), "related_id").alias("edge_key"))
    both = rels.select("*", F.col("entity_id").alias("a"), F.col("related_id").alias("b")).unionByName(rels.select("*", F.col("related_id").alias("a"), F.col("entity_id").alias("b")))
    visited = spark.createDataFrame([(root, 0, 0)], "node_id string, depth int, node_index int")
    frontier, edges, count, d = visited, None, 1, 0
    while (compat or d < depth) and count < max_nodes:
        d += 1
        step = both.join(frontier.select(F.col("node_id").alias("a"), "node_index"), "a").join(visited.select(F.col("node_id").alias("b")), "b", "left_anti")
        order = [F.col("node_index"), *map(F.col, _ORDER)]
        first = step.withColumn("k", F.row_number().over(Window.partitionBy("b").orderBy(*order))).where("k = 1").drop("k")
        # At most max_nodes places are given out, so one task orders no more than that.
        found = first.orderBy(*order, "b").limit(max_nodes - count)
        found = written(found.withColumn("place", (F.row_number().over(Window.orderBy(*order, "b")) + count - 1).cast("int")), "subgraph")
        n = found.count()
        if n == 0:
            break
        frontier = found.select(F.col("b").alias("node_id"), F.lit(d).alias("depth"), F.col("place").alias("node_index"))
        hop = found.select("entity_id", "related_id", "rel_type", "source", F.col("b").alias("reached"), F.lit(d).alias("depth"))
        edges, visited, count = hop if edges is None else edges.unionByName(hop), visited.unionByName(frontier), count + n
    if edges is None:
        edges = both.limit(0).select("entity_id", "related_id", "rel_type", "source", F.col("b").alias("reached"), F.lit(0).alias("depth"))
    return (visited if known is None else visited.join(known.select("node_id").distinct(), "node_id", "left_semi")), edges
