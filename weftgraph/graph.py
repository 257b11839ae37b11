"""Graphs as DataFrames: vertices(id) and edges(src, dst, weight), with the construction rules checked."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.runtime import materialize


class GraphError(ValueError):
    """A graph or matrix does not meet an operator's contract."""


@dataclass(frozen=True)
class Graph:
    """``vertices(id)``; ``edges(src, dst, weight)``. Undirected graphs store both directions, loops once."""

    vertices: DataFrame
    edges: DataFrame
    directed: bool = False

    @staticmethod
    def build(vertices: DataFrame, edges: DataFrame, directed: bool = False, ignore_duplicates: bool = False, check: bool = False) -> Graph:
        """From edges(src, dst[, weight]); undirected edges may come in either direction.

        ``check``: refuse repeated edges (unless ignored) and ends that are not vertices. Checks are jobs of
        their own, so they are asked for.
        """
        if "weight" not in edges.columns:
            edges = edges.withColumn("weight", F.lit(1.0))
        e = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("weight").cast("double").alias("weight"))
        v = vertices.select(F.col("id").cast("long").alias("id"))
        if not directed:
            e = e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight")
        if ignore_duplicates:
            e = e.groupBy("src", "dst").agg(F.min("weight").alias("weight"))
        if check:
            if not e.groupBy("src", "dst").count().where("count > 1").isEmpty():
                raise GraphError("an edge is repeated")
            ends = e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id")))
            if not ends.join(v, "id", "left_anti").isEmpty():
                raise GraphError("an edge ends outside the vertices")
        if not directed:
            e = e.union(e.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
        return Graph(v, e, directed)

    def kept(self, name: str = "graph") -> Graph:
        """The same graph, written once and read again, so that iterations do not rebuild it."""
        return Graph(materialize(self.vertices, f"{name}-v"), materialize(self.edges, f"{name}-e"), self.directed)

    def with_dense_ids(self) -> tuple[Graph, DataFrame]:
        """Ids 0..n-1 in id order, and the vocabulary(id, symbol) that maps back.

        Ranks come from range partitions: counts of partitions are summed on the driver, so no
        task sees all ids.
        """
        vocab = dense_ids(self.vertices.withColumnRenamed("id", "symbol"))
        a = vocab.select(F.col("symbol").alias("src"), F.col("id").alias("s"))
        b = vocab.select(F.col("symbol").alias("dst"), F.col("id").alias("d"))
        e = self.edges.join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), "weight")
        return Graph(vocab.select("id"), e, self.directed), vocab


@dataclass(frozen=True)
class Bigraph:
    """Two vocabularies ``left`` and ``right``(id, symbol), ids 0.. on each side, and ``edges(src, dst, weight)`` from left ids to right ids."""

    left: DataFrame
    right: DataFrame
    edges: DataFrame

    @staticmethod
    def build(left: DataFrame, right: DataFrame, edges: DataFrame, ignore_duplicates: bool = False) -> Bigraph:
        """From left(symbol), right(symbol) and edges(src, dst[, weight]) of symbols; repeated symbols count once.

        Edges with an end outside its vocabulary, and repeated edges unless ``ignore_duplicates`` (the smallest weight stays), are errors.
        """
        if "weight" not in edges.columns:
            edges = edges.withColumn("weight", F.lit(1.0))
        sides = [materialize(dense_ids(x.select("symbol").where("symbol is not null")), "vocabulary") for x in (left, right)]
        a, b = (v.select(F.col("symbol").alias(c), F.col("id").alias(f"i_{c}")) for v, c in zip(sides, ("src", "dst")))
        e = materialize(edges.select("src", "dst", F.col("weight").cast("double").alias("weight")).join(a, "src", "left").join(b, "dst", "left").select(F.col("i_src").alias("src"), F.col("i_dst").alias("dst"), "weight"), "bigraph")
        if not e.where("src is null or dst is null").isEmpty():
            raise GraphError("an edge ends outside its vocabulary")
        one = e.groupBy("src", "dst").agg(F.min("weight").alias("weight"), F.count("*").alias("n"))
        if not ignore_duplicates and not one.where("n > 1").isEmpty():
            raise GraphError("an edge is repeated")
        return Bigraph(*sides, one.drop("n"))


def dense_ids(symbols: DataFrame) -> DataFrame:
    """(id, symbol): the rank of each distinct symbol, from 0."""
    ordered = materialize(symbols.select("symbol").distinct().repartitionByRange("symbol").sortWithinPartitions("symbol").withColumn("part", F.spark_partition_id()), "symbols")
    sizes = sorted((r["part"], r["n"]) for r in ordered.groupBy("part").agg(F.count("*").alias("n")).collect())
    before, base = 0, {}
    for p, n in sizes:
        base[p] = before
        before += n
    offsets = ordered.sparkSession.createDataFrame(sorted(base.items()) or [(0, 0)], "part int, base long")
    rank = F.row_number().over(Window.partitionBy("part").orderBy("symbol"))
    return ordered.join(offsets, "part").select((rank + F.col("base") - 1).cast("long").alias("id"), "symbol")
