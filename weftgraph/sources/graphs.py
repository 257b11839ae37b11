"""Graphs derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.graph import Graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def copurchase(spark: SparkSession, sf_dir: str, least_quantity: float = 40, flag: str = "R") -> Graph:
    """Parts bought together: an edge for two parts of one order among returned lines of some quantity; weight = orders."""
    lines = table(spark, sf_dir, "lineitem").where((F.col("l_returnflag") == flag) & (F.col("l_quantity") >= least_quantity))
    p = lines.select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")).distinct()
    e = p.join(p.select("o", F.col("p").alias("q")), "o").where("p < q").groupBy(F.col("p").alias("src"), F.col("q").alias("dst")).agg(F.count("*").cast("double").alias("weight"))
    return Graph.build(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), e)


def copurchase_all(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts bought together in any order: an edge for two parts of one order over all lines; weight = orders."""
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")).distinct()
    e = p.join(p.select("o", F.col("p").alias("q")), "o").where("p < q").groupBy(F.col("p").alias("src"), F.col("q").alias("dst")).agg(F.count("*").cast("double").alias("weight"))
    return Graph.build(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), e)


def partners(spark: SparkSession, sf_dir: str) -> Graph:
    """Part -> the part that it is most often bought together with over all lines (ties: the smallest id); weight = orders."""
    g = copurchase_all(spark, sf_dir)
    best = g.edges.groupBy("src").agg(F.max(F.struct("weight", (-F.col("dst")).alias("dst"))).alias("m"))
    return Graph.build(g.vertices, best.select("src", (-F.col("m.dst")).alias("dst"), F.col("m.weight").alias("weight")), directed=True)


def same_region(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations of one region."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").alias("r"))
    e = n.withColumnRenamed("id", "src").join(n.withColumnRenamed("id", "dst"), "r").where("src < dst").select("src", "dst")
    return Graph.build(n.select("id"), e)


def geography(spark: SparkSession, sf_dir: str) -> Graph:
    """The tree root (0) -> regions (1 + key) -> nations (100 + key) -> suppliers (10^6 + key) and customers (10^9 + key)."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    e = r.select(F.lit(0).cast("long").alias("src"), (F.col("r_regionkey") + 1).cast("long").alias("dst"))
    e = e.union(n.select((F.col("n_regionkey") + 1).cast("long"), (F.col("n_nationkey") + 100).cast("long")))
    e = e.union(s.select((F.col("s_nationkey") + 100).cast("long"), F.col("s_suppkey") + 1_000_000))
    e = e.union(c.select((F.col("c_nationkey") + 100).cast("long"), F.col("c_custkey") + 1_000_000_000))
    v = spark.range(1).union(e.select("dst"))
    return Graph.build(v, e, directed=True)


def trade(spark: SparkSession, sf_dir: str) -> Graph:
    """Customer nation -> supplier nation, weight = the smallest extended price between them."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    li, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    x = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, li.l_suppkey == s.s_suppkey)
    e = x.groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.min("l_extendedprice").alias("weight"))
    return Graph.build(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id")), e, directed=True)


def supplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bipartite (src = supplier, dst = part, weight = quantity)."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.sum("l_quantity").alias("weight"))


def event_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions between the types of consecutive events of a user: (src, dst, weight)."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ev = table(spark, sf_dir, "events").withColumn("dst", F.lead("event_type").over(w)).where("dst is not null")
    return ev.groupBy(F.col("event_type").alias("src"), "dst").agg(F.count("*").cast("double").alias("weight"))


def favourites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bipartite (src = customer, dst = part): the two parts that a customer orders most of (ties: the smaller part)."""
    from pyspark.sql.window import Window

    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    q = li.join(o, li.l_orderkey == o.o_orderkey).groupBy(F.col("o_custkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.sum("l_quantity").alias("q"))
    return q.withColumn("k", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("q"), "dst"))).where("k <= 2").select("src", "dst")


def region_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer region -> supplier region, weight = the smallest extended price between them."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("r"))
    e = trade(spark, sf_dir).edges
    e = e.join(n.select(F.col("id").alias("src"), F.col("r").alias("a")), "src").join(n.select(F.col("id").alias("dst"), F.col("r").alias("b")), "dst")
    return e.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.min("weight").alias("weight"))


def order_exchange(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Finished orders of each nation (id = key) against open ones (100 + key): edges(src, dst, capacity, cost), budgets and sides.

    Budgets are the orders of the nation's customers; cost is 0 in the nation, 1 in its region, 2 beyond.
    """
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").alias("r"))
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    of = o.where("o_orderstatus in ('F', 'O')").join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").cast("long").alias("id"), "o_orderstatus").agg(F.count("*").alias("budget"))
    color = F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).cast("long")
    ends = of.join(n, "id").select((F.col("id") + 100 * color).alias("id"), F.col("id").alias("nation"), "r", color.alias("color"), "budget")
    a, b = ends.where("color = 0").select(F.col("id").alias("src"), F.col("nation").alias("n1"), F.col("r").alias("r1"), F.col("budget").alias("b1")), ends.where("color = 1").select(F.col("id").alias("dst"), F.col("nation").alias("n2"), F.col("r").alias("r2"), F.col("budget").alias("b2"))
    cost = F.when(F.col("n1") == F.col("n2"), 0).when(F.col("r1") == F.col("r2"), 1).otherwise(2)
    edges = a.crossJoin(F.broadcast(b)).select("src", "dst", F.least("b1", "b2").alias("capacity"), cost.cast("long").alias("cost"))  # 25 x 25 nations
    return edges, ends.select("id", "budget"), ends.select("id", "color")
