"""The graph document: tables of nodes, edges and warnings with one row of scan metadata."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    warnings: DataFrame | None = None
    metadata: dict = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def register(self, prefix: str = "") -> None:
        """Temporary views ``nodes`` and ``edges``, for SQL over the graph."""
        self.nodes.createOrReplaceTempView(prefix + "nodes")
        self.edges.createOrReplaceTempView(prefix + "edges")


def order_column(df: DataFrame) -> str:
    """Document order: ``pos`` where a loaded document kept it, else the id."""
    return "pos" if "pos" in df.columns else "id"
