"""Rows, columns, neighbours, degrees and their predicates: closed relational forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.graph import Graph, GraphError
from weftgraph.runtime import materialize


def density(g: Graph) -> DataFrame:
    n = g.vertices.agg(F.count("*").alias("n"))
    m = g.edges.agg(F.count("*").alias("m"))
    return n.crossJoin(m).select(F.col("n").alias("nodes"), F.col("m").alias("entries"), (F.col("m") / (F.col("n") * F.col("n"))).alias("density"))


def neighbors(g: Graph) -> DataFrame:
    return g.edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("neighbors"))


def out_degree(g: Graph) -> DataFrame:
    """Row length: a loop counts once, an isolated vertex has 0."""
    d = g.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return g.vertices.join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def in_degree(g: Graph) -> DataFrame:
    return out_degree(Graph(g.vertices, transpose(g.edges), g.directed))


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")


def symmetrize(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, loops once; of two given directions the smaller weight stays."""
    return edges.union(transpose(edges)).groupBy("src", "dst").agg(F.min("weight").alias("weight"))


def is_symmetric(edges: DataFrame) -> DataFrame:
    lone = edges.select("src", "dst").join(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_anti")
    return lone.agg((F.count("*") == 0).alias("is_symmetric"))


def empty_rows(g: Graph) -> DataFrame:
    return g.vertices.join(g.edges.select(F.col("src").alias("id")), "id", "left_anti")


def root_nodes(g: Graph) -> DataFrame:
    """No predecessor; isolated vertices are roots."""
    return g.vertices.join(g.edges.select(F.col("dst").alias("id")), "id", "left_anti")


def sink_nodes(g: Graph) -> DataFrame:
    """A predecessor and no successor; isolated vertices are not sinks."""
    return empty_rows(g).join(g.edges.select(F.col("dst").alias("id")), "id", "left_semi")


def singleton_nodes(g: Graph) -> DataFrame:
    return empty_rows(g).join(g.edges.select(F.col("dst").alias("id")), "id", "left_anti")


def self_loops(g: Graph) -> DataFrame:
    return g.edges.where("src = dst").agg(F.count("*").alias("self_loops"))


def is_topologically_sorted(g: Graph) -> DataFrame:
    return g.edges.agg(F.coalesce(F.bool_and(F.col("src") < F.col("dst")), F.lit(True)).alias("sorted"))


def rank_select(edges: DataFrame) -> DataFrame:
    """(src, dst, row_rank): the entry's number within its row, from 0, in column order."""
    return edges.select("src", "dst", (F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1).cast("long").alias("row_rank"))


def row_extremes(edges: DataFrame) -> DataFrame:
    """Row maximum and minimum with their columns. Ties: the last column for the maximum, the first for the minimum."""
    return edges.groupBy("src").agg(F.max(F.struct("weight", "dst")).alias("hi"), F.min(F.struct("weight", "dst")).alias("lo")).select(
        "src", F.col("hi.weight").alias("max_weight"), F.col("hi.dst").alias("max_dst"), F.col("lo.weight").alias("min_weight"), F.col("lo.dst").alias("min_dst")
    )


def extremes(edges: DataFrame) -> DataFrame:
    return edges.agg(F.max("weight").alias("max_weight"), F.min("weight").alias("min_weight"))


def padded(g: Graph, row: int, value: float) -> DataFrame:
    """A dense row of the padded square: missing cells take ``value`` and are marked as imputed."""
    have = g.edges.where(F.col("src") == row).select(F.col("dst").alias("id"), "weight")
    return g.vertices.join(have, "id", "left").select(F.lit(row).cast("long").alias("src"), F.col("id").alias("dst"), F.coalesce("weight", F.lit(value)).alias("weight"), F.col("weight").isNull().alias("imputed"))


def second_order_degree(g: Graph) -> DataFrame:
    d = out_degree(g)
    s = g.edges.join(d.select(F.col("id").alias("dst"), "degree"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("degree").alias("score"))
    return g.vertices.join(s, "id", "left").select("id", F.coalesce("score", F.lit(0)).cast("long").alias("score"))


def predecessors(g: Graph) -> DataFrame:
    """(id, predecessors): sorted sources of each vertex's incoming edges."""
    return neighbors(Graph(g.vertices, transpose(g.edges), g.directed)).withColumnRenamed("neighbors", "predecessors")


def non_empty_rows(g: Graph) -> DataFrame:
    return g.vertices.join(g.edges.select(F.col("src").alias("id")), "id", "left_semi")


def has_entry(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """(src, dst, present) for each of cells(src, dst)."""
    have = edges.select("src", "dst", F.lit(True).alias("x")).distinct()
    return cells.join(have, ["src", "dst"], "left").select("src", "dst", F.coalesce("x", F.lit(False)).alias("present"))


def has_entry_by_class(edges: DataFrame, rows: DataFrame, columns: DataFrame, width: int = 2048) -> DataFrame:
    """(src, dst, present) for each pair of rows(src, k) and columns(dst, k) of one class k: ``has_entry`` of their join.

    The cells are never shuffled. The columns of a class are arrays of about ``width``; a row meets each array of its class with the entries
    that it has among them, and the cells are unfolded where they are returned: what is shuffled is entries and one row for ``width`` cells.
    """
    sizes = columns.groupBy("k").agg(F.ceil(F.count("*") / width).alias("blocks"))
    placed = columns.join(sizes, "k").select("dst", "k", F.pmod(F.xxhash64("dst"), "blocks").alias("block"))
    lists = placed.groupBy("k", "block").agg(F.collect_list("dst").alias("columns"))
    have = edges.select("src", "dst").join(placed.distinct(), "dst").groupBy("src", "k", "block").agg(F.collect_set("dst").alias("have"))
    met = rows.join(sizes, "k").select("src", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")).join(have, ["src", "k", "block"], "left")
    cells = met.join(lists, ["k", "block"]).select("src", "have", F.explode("columns").alias("dst"))
    return cells.select("src", "dst", F.coalesce(F.array_contains("have", F.col("dst")), F.lit(False)).alias("present"))


def select_entry(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """(src, row_rank, dst): the column of each of ranks(src, row_rank); null beyond the row."""
    return ranks.join(rank_select(edges), ["src", "row_rank"], "left").select("src", "row_rank", "dst")


def last_coordinates(edges: DataFrame) -> DataFrame:
    """(src, dst) of the last entry in row-major order; nulls for an empty matrix."""
    return edges.agg(F.max(F.struct("src", "dst")).alias("c")).select("c.src", "c.dst")


def dense_extremes(g: Graph, missing: float = 0.0) -> DataFrame:
    """(max_weight, min_weight) over all cells of the square, missing cells as ``missing``."""
    n = g.vertices.agg(F.count("*").alias("n"))
    e = g.edges.agg(F.max("weight").alias("hi"), F.min("weight").alias("lo"), F.count_distinct("src", "dst").alias("k"))
    gap = F.when(F.col("k") < F.col("n") * F.col("n"), F.lit(float(missing)))
    return e.crossJoin(n).select(F.greatest("hi", gap).alias("max_weight"), F.least("lo", gap).alias("min_weight"))


def positions(rows: DataFrame, *keys: Column) -> DataFrame:
    """rows + position, from 0, in the order of the keys, which must be a total order.

    Ranks come from range partitions whose sizes are summed on the driver, one number a partition: no task sees all rows.
    """
    cols = rows.columns
    ordered = materialize(rows.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()), "positions")
    before, base = 0, []
    for part, n in sorted((r["__part"], r["count"]) for r in ordered.groupBy("__part").count().collect()):
        base.append((part, before))
        before += n
    offsets = rows.sparkSession.createDataFrame(base or [(0, 0)], "__part int, __base long")
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*keys))
    return ordered.join(F.broadcast(offsets), "__part").select(*cols, (rank + F.col("__base") - 1).cast("long").alias("position"))


def degree_order(g: Graph, descending: bool = True) -> DataFrame:
    """(id, degree, position): vertices by degree, ties by id."""
    d = out_degree(g)
    return positions(d, F.desc("degree") if descending else F.asc("degree"), F.asc("id"))


def applied_order(g: Graph, order: DataFrame) -> Graph:
    """The same graph with each id replaced by its position in order(id, position), which must give each vertex one of 0..n-1."""
    n, seen = g.vertices.count(), order.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count_distinct("position").alias("at"), F.min("position").alias("lo"), F.max("position").alias("hi")).first()
    if n and not (seen["n"] == seen["ids"] == seen["at"] == n and seen["lo"] == 0 and seen["hi"] == n - 1) or not n and seen["n"] or not g.vertices.join(order.select("id"), "id", "left_anti").isEmpty():
        raise GraphError("the order is no permutation of the vertices")
    a, b = order.select(F.col("id").alias("src"), F.col("position").alias("s")), order.select(F.col("id").alias("dst"), F.col("position").alias("d"))
    e = g.edges.join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), "weight")
    return Graph(order.select(F.col("position").alias("id")), e, g.directed)


def dot_lines(g: Graph) -> DataFrame:
    """(line): the edges in DOT syntax, an undirected edge once; ``.write.text`` of it is the sink, between a head and a tail line."""
    arrow = " -> " if g.directed else " -- "
    e = g.edges if g.directed else g.edges.where("src <= dst")
    return e.select(F.concat(F.lit("  "), F.col("src").cast("string"), F.lit(arrow), F.col("dst").cast("string"), F.lit(";")).alias("line"))


def dot_document(g: Graph, left: DataFrame | None = None, right: DataFrame | None = None) -> DataFrame:
    """(part, line): a whole DOT document; parts 0 to 3 are the head, nodes, edges and tail, in which order the lines belong.

    With ``left``(id) and ``right``(id) the graph is bipartite: nodes and edge ends are written L<id> and R<id>, edges lead from src on the left to dst on the right.
    """
    spark = g.vertices.sparkSession
    text = lambda part, line: spark.range(1).select(F.lit(part).alias("part"), F.lit(line).alias("line"))
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    if left is not None and right is not None:
        nodes = left.select(name("L", "id").alias("n")).union(right.select(name("R", "id")))
        edges = g.edges.select(F.concat(F.lit("  "), name("L", "src"), F.lit(" -- "), name("R", "dst"), F.lit(";")).alias("line"))
        kind = "graph"
    else:
        nodes, edges, kind = g.vertices.select(F.col("id").cast("string").alias("n")), dot_lines(g), "digraph" if g.directed else "graph"
    nodes = nodes.select(F.lit(1).alias("part"), F.concat(F.lit("  "), "n", F.lit(";")).alias("line"))
    return text(0, kind + " {").union(nodes).union(edges.select(F.lit(2).alias("part"), "line")).union(text(3, "}"))


def values_at(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """(src, dst, weight) for each of cells(src, dst); null where there is no entry."""
    return cells.join(edges.select("src", "dst", "weight"), ["src", "dst"], "left").select("src", "dst", "weight")


def column_rank_select(edges: DataFrame) -> DataFrame:
    """(src, dst, column_rank): the entry's number within its column, from 0, in row order."""
    return edges.select("src", "dst", (F.row_number().over(Window.partitionBy("dst").orderBy("src")) - 1).cast("long").alias("column_rank"))


def entry_index(edges: DataFrame) -> DataFrame:
    """(src, dst, position): the entry's number in row-major order of the whole matrix, from 0."""
    return positions(edges.select("src", "dst"), F.col("src"), F.col("dst"))


def lexicographic_order(first: DataFrame, second: DataFrame, descending: bool = True) -> DataFrame:
    """(id, position): by one score(id, score), equal ones by another, then by id."""
    both = first.select("id", F.col("score").alias("a")).join(second.select("id", F.col("score").alias("b")), "id")
    by = [F.desc("a"), F.desc("b")] if descending else [F.asc("a"), F.asc("b")]
    return positions(both, *by, F.asc("id")).select("id", "position")
