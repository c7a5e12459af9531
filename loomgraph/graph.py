"""The property graph: two DataFrames and the undirected adjacency derived from them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE_SCHEMA = T.StructType(
    [T.StructField("id", T.StringType(), False), T.StructField("name", T.StringType()), T.StructField("type", T.StringType()), T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("summary", T.StringType()), T.StructField("props", T.MapType(T.StringType(), T.StringType())), T.StructField("themes", T.ArrayType(T.StringType())), T.StructField("embedding", T.ArrayType(T.FloatType()))]
)
#: Numeric edge properties, in the order in which a value is looked for.
VALUES = ["percentage", "exposure_percentage", "exposure_amount", "ownership_percentage", "value", "share", "weight"]
EDGE_SCHEMA = T.StructType(
    [T.StructField("edge_id", T.LongType(), False), T.StructField("src", T.StringType(), False), T.StructField("dst", T.StringType(), False), T.StructField("rel", T.StringType(), False), T.StructField("fact", T.StringType()), T.StructField("valid_at", T.TimestampType()), T.StructField("invalid_at", T.TimestampType())]
    + [T.StructField(v, T.DoubleType()) for v in VALUES]
    + [T.StructField("change_percent", T.DoubleType()), T.StructField("unit", T.StringType()), T.StructField("period", T.StringType()), T.StructField("order", T.IntegerType()), T.StructField("sign", T.StringType()), T.StructField("channel", T.StringType())]
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with the columns of schema: those it lacks are null, others are dropped."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


@dataclass(frozen=True)
class PropertyGraph:
    """reverse: the same edges laid out by dst, where they are stored twice; a search for a node's in-edges reads these."""

    nodes: DataFrame
    edges: DataFrame
    reverse: DataFrame | None = None

    @staticmethod
    def of(nodes: DataFrame, edges: DataFrame) -> PropertyGraph:
        return PropertyGraph(conform(nodes, NODE_SCHEMA), conform(edges, EDGE_SCHEMA))

    def of_type(self, *types: str) -> DataFrame:
        return self.nodes.filter(F.col("type").isin(*types)) if types else self.nodes

    def with_rel(self, *rels: str) -> DataFrame:
        """Edges of the given relations; no relation means all."""
        return self.edges.filter(F.col("rel").isin(*rels)) if rels else self.edges

    def adjacency(self, *rels: str) -> DataFrame:
        """Every edge once in each orientation, a self-loop once; `forward` tells the stored one."""
        out = self.with_rel(*rels).withColumn("forward", F.lit(True))
        stored = self.edges if self.reverse is None else self.reverse
        back = (stored.filter(F.col("rel").isin(*rels)) if rels else stored).filter("src <> dst").withColumn("_s", F.col("dst")).withColumn("dst", F.col("src")).withColumn("src", F.col("_s")).drop("_s").withColumn("forward", F.lit(False))
        return out.unionByName(back)

    def sql(self, text: str, **parameters) -> DataFrame:
        """The rows of a query over {nodes} and {edges}, whose :names are bound to values, never written into the text."""
        return self.nodes.sparkSession.sql(text, args=parameters, nodes=self.nodes, edges=self.edges)

    def cached(self) -> PropertyGraph:
        return PropertyGraph(self.nodes.cache(), self.edges.cache())


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
