"""Edges that arrive as a stream, merged into a stored graph batch by batch.

Each micro-batch becomes one commit of the store, so readers see whole batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.session import GraphStore
from graphloom.sources.graph import Graph


def merge_edges(graph: Graph, relation: tuple[str, str, str], batch: DataFrame) -> Graph:
    """The graph with a batch of edges upserted by their ends; the batch may be of any size."""
    table = graph.edge_table(relation)
    kind = graph.model.relations[relation]
    columns = list(kind.properties.values())
    # Of equal ends in a batch the greatest row counts, so a repeated batch changes nothing.
    own = batch.groupBy("src", "dst").agg(*(F.max(c).alias(f"n_{c}") for c in columns), F.lit(True).alias("new")) if columns else batch.select("src", "dst").distinct().withColumn("new", F.lit(True))
    joined = table.join(own, ["src", "dst"], "full_outer")
    merged = joined.select(
        F.coalesce("edge_id", F.xxhash64("src", "dst", F.lit("merged"))).alias("edge_id"),
        "src",
        "dst",
        *(F.when(F.col("new"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in columns),
    )
    return Graph(graph.spark, graph.model, graph.node_tables, {**graph.edge_tables, relation: merged.select(*table.columns)})


def follow_edges(stream: DataFrame, store: GraphStore, relation: tuple[str, str, str], checkpoint: str) -> StreamingQuery:
    """Start merging a stream of src, dst and properties into the store."""

    def commit(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            store.commit(merge_edges(store.open(), relation, batch))

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
