"""A graph bound to DataFrames: one table for each label and each relation."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import EDGE_COLUMNS, GraphModel, ModelBuilder, ModelError, RelationType, UnknownType, check_types


@dataclass
class Graph:
    """Relation tables have ``edge_id, src, dst`` and their properties.

    An edge id tells parallel edges apart.  A table without one gets an id from
    its ends and, for parallel edges, their properties and number.
    """

    spark: SparkSession
    model: GraphModel
    node_tables: Mapping[str, DataFrame]
    edge_tables: Mapping[tuple[str, str, str], DataFrame]
    projections: dict[str, object] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name, kind in self.model.nodes.items():
            if name not in self.node_tables:
                raise ModelError(f"no table for node type {name}")
            check_types(name, self.node_tables[name].schema, kind.properties.values(), kind.key_column)
        for key, kind in self.model.relations.items():
            if key not in self.edge_tables:
                raise ModelError(f"no table for relation type {kind.name}")
            missing = [c for c in EDGE_COLUMNS if c not in self.edge_tables[key].columns]
            if missing:
                raise ModelError(f"{kind.name} lacks {', '.join(missing)}")
            check_types(kind.name, self.edge_tables[key].schema, kind.properties.values())

    def nodes(self, label: str):
        """A query over all nodes of a label."""
        from graphloom.plans.query import Query

        self.model.node(label)
        return Query.root(self, label)

    def relation(self, name: str, source: str | None = None, target: str | None = None) -> RelationType:
        return self.model.relation(name, source, target)

    def node_table(self, label: str) -> DataFrame:
        return self.node_tables[self.model.node(label).name]

    def edge_table(self, relation: RelationType | tuple[str, str, str]) -> DataFrame:
        key = relation if isinstance(relation, tuple) else (relation.source, relation.name, relation.target)
        if key not in self.edge_tables:
            raise UnknownType(f"no relation type {key[1]}")
        return self.edge_tables[key]

    def sql(self, text: str, **parameters: object) -> DataFrame:
        """Native text with named parameters; labels and relation names are views."""
        if not text.strip():
            raise ValueError("the query is blank")
        for label, table in self.node_tables.items():
            table.createOrReplaceTempView(label)
        for (_, name, _), table in self.edge_tables.items():
            table.createOrReplaceTempView(name)
        return self.spark.sql(text, args=parameters or None)


def with_edge_ids(edges: DataFrame) -> DataFrame:
    """Add an ``edge_id`` to a relation table of ``src, dst`` and properties.

    The id is a hash of the whole row, so it is the same whenever the table is
    read; rows that are equal in everything are numbered by an aggregation of
    them, not by a window over their ends.
    """
    own = edges.columns
    counted = edges.groupBy(*own).agg(F.count("*").cast("int").alias("__n"))
    each = counted.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    return each.select(F.xxhash64(*own, "__i").alias("edge_id"), *own)


def parquet_graph(
    spark: SparkSession,
    nodes: Mapping[str, tuple[str, str]],
    relations: Mapping[tuple[str, str, str], tuple[str, bool]],
) -> Graph:
    """A graph over Parquet files: label -> (path, key), (source, name, target) -> (path, directed).

    Paths are read by Spark alone, so any store that Spark reads will do.
    """
    builder = ModelBuilder()
    node_tables = {}
    for label, (path, key) in nodes.items():
        node_tables[label] = spark.read.parquet(path)
        builder.node(label, node_tables[label].columns, key=key)
    edge_tables = {}
    for (source, name, target), (path, directed) in relations.items():
        table = spark.read.parquet(path)
        edge_tables[source, name, target] = table if "edge_id" in table.columns else with_edge_ids(table)
        builder.relation(name, source, target, table.columns, directed)
    return Graph(spark, builder.build(), node_tables, edge_tables)
