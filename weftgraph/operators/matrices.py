"""Building, extending and editing sparse matrices as entry tables, typed vertices, centring and stress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import Graph, GraphError
from weftgraph.operators.access import positions


def from_dense(rows: DataFrame) -> DataFrame:
    """(src, dst, weight) of rows(src, values): a cell for each array element; null elements are missing cells."""
    cells = rows.select("src", F.posexplode("values").alias("dst", "weight")).where("weight is not null")
    return cells.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("weight").cast("double").alias("weight"))


def with_values(edges: DataFrame, values: DataFrame) -> DataFrame:
    """The entries with new weights from values(position, weight), positions from 0 in row-major order; as many values as entries."""
    cells = positions(edges.select("src", "dst"), F.asc("src"), F.asc("dst"))
    out = cells.join(values.select("position", "weight"), "position", "full").select("src", "dst", "weight")
    if not out.where("src is null or weight is null").isEmpty():
        raise GraphError("values and entries differ in number")
    return out


def extended(edges: DataFrame, more: DataFrame) -> DataFrame:
    """Both sets of entries; an entry that comes twice is an error."""
    out = edges.select("src", "dst", "weight").unionByName(more.select("src", "dst", "weight"))
    if not out.groupBy("src", "dst").count().where("count > 1").isEmpty():
        raise GraphError("an entry is repeated")
    return out


def updated(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """The entries, those that changes(src, dst, weight) names with its weight; changes of missing entries do nothing."""
    new = changes.select("src", "dst", F.col("weight").alias("new"), F.lit(True).alias("hit"))
    return edges.join(new, ["src", "dst"], "left").select("src", "dst", F.when(F.col("hit"), F.col("new")).otherwise(F.col("weight")).alias("weight"))


def nodes_of_type(types: DataFrame, wanted: str) -> DataFrame:
    """(id) of types(id, type)."""
    return types.where(F.col("type") == wanted).select("id")


def has_node_type(types: DataFrame, wanted: DataFrame) -> DataFrame:
    """(type, present) for wanted(type)."""
    have = types.select("type", F.lit(True).alias("x")).distinct()
    return wanted.join(have, "type", "left").select("type", F.coalesce("x", F.lit(False)).alias("present"))


def typed_edges(g: Graph, types: DataFrame) -> DataFrame:
    """(src_type, dst_type, edges): how many edges lead from a type to a type."""
    a, b = types.select(F.col("id").alias("src"), F.col("type").alias("src_type")), types.select(F.col("id").alias("dst"), F.col("type").alias("dst_type"))
    return g.edges.join(a, "src").join(b, "dst").groupBy("src_type", "dst_type").agg(F.count("*").alias("edges"))


def degree_sequence(edges: DataFrame) -> DataFrame:
    """(degree, vertices): how many vertices have each degree in the subgraph of edges(src, dst), each edge given once."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree")).groupBy("degree").agg(F.count("*").alias("vertices"))


def has_delta_y_exchange(a: DataFrame, b: DataFrame) -> DataFrame:
    """(exchange): whether the subgraphs of two edge sets differ in their degrees, as a triangle and a claw do."""
    x, y = degree_sequence(a), degree_sequence(b).withColumnRenamed("vertices", "other")
    differ = x.join(y, "degree", "full").where(~F.col("vertices").eqNullSafe(F.col("other")))
    return differ.agg((F.count("*") > 0).alias("exchange"))


def double_center(cells: DataFrame) -> DataFrame:
    """(src, dst, value): -1/2 of the squared distances less row mean and column mean plus the mean of all. cells(src, dst, weight) are a whole square."""
    sq = cells.select("src", "dst", (F.col("weight") * F.col("weight")).alias("s"))
    row, col = sq.groupBy("src").agg(F.avg("s").alias("r")), sq.groupBy("dst").agg(F.avg("s").alias("c"))
    out = sq.join(row, "src").join(col, "dst").crossJoin(sq.agg(F.avg("s").alias("m")))  # one row
    return out.select("src", "dst", (-0.5 * (F.col("s") - F.col("r") - F.col("c") + F.col("m"))).alias("value"))


def stress(cells: DataFrame, points: DataFrame) -> DataFrame:
    """(stress): Kruskal's stress of points(id, x array) against distances cells(src, dst, weight); 0 without distances."""
    a, b = points.select(F.col("id").alias("src"), F.col("x").alias("p")), points.select(F.col("id").alias("dst"), F.col("x").alias("q"))
    e = cells.where("src < dst").join(a, "src").join(b, "dst")
    far = F.sqrt(F.aggregate(F.zip_with("p", "q", lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, t: s + t))
    gap = far - F.col("weight")
    s = e.agg(F.sum(gap * gap).alias("x"), F.sum(F.col("weight") * F.col("weight")).alias("y"))
    return s.select(F.coalesce(F.sqrt(F.try_divide("x", "y")), F.lit(0.0)).alias("stress"))
