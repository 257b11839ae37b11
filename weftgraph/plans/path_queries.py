"""Queries of paths, orders, eliminations and matrix edits, with the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.graph import Graph, dense_ids
from weftgraph.operators import access as A
from weftgraph.operators import matrices as X
from weftgraph.operators import paths as P
from weftgraph.plans.graph_queries import COPART, COPART_ALL, GEO, SUPP, query
from weftgraph.plans.structure_queries import _random
from weftgraph.sources import generators as N
from weftgraph.sources import graphs as G

EVENT = """WITH RECURSIVE w AS (SELECT event_type a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) b FROM events),
t AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS id FROM (SELECT DISTINCT event_type FROM events)),
e AS (SELECT x.id src, y.id dst, CAST(count(*) AS DOUBLE) weight FROM w JOIN t x ON x.event_type = a JOIN t y ON y.event_type = b GROUP BY 1, 2)
"""
KIND = ", k AS (SELECT id, CASE WHEN id = 0 THEN 'root' WHEN id < 100 THEN 'region' WHEN id < 1000000 THEN 'nation' WHEN id < 1000000000 THEN 'supplier' ELSE 'customer' END AS type FROM v)\n"


def _events(spark, d) -> Graph:
    """The graph of consecutive event types of a user, types numbered by name."""
    vocab = dense_ids(G.table(spark, d, "events").select(F.col("event_type").alias("symbol")))
    a, b = vocab.select(F.col("symbol").alias("src"), F.col("id").alias("s")), vocab.select(F.col("symbol").alias("dst"), F.col("id").alias("t"))
    e = G.event_chain(spark, d).join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("t").alias("dst"), "weight")
    return Graph.build(vocab.select("id"), e, directed=True).kept()


def _kinds(g: Graph):
    i = F.col("id")
    kind = F.when(i == 0, "root").when(i < 100, "region").when(i < 1_000_000, "nation").when(i < 1_000_000_000, "supplier").otherwise("customer")
    return g.vertices.select("id", kind.alias("type"))


# -- paths, circuits, orders -----------------------------------------------------------------------------------------------
@query(EVENT + ", p(root, last, circuit) AS (SELECT src, dst, [src, dst] FROM e WHERE src < dst UNION ALL SELECT root, dst, list_append(circuit, dst) FROM p JOIN e ON src = last WHERE dst > root AND NOT list_contains(circuit, dst)) SELECT circuit FROM p JOIN e ON src = last AND dst = root")
def johnson_cycles(spark, d):
    return P.circuits(_events(spark, d))


@query(GEO + ", p(path, last) AS (SELECT [CAST(0 AS BIGINT)], CAST(0 AS BIGINT) UNION ALL SELECT list_append(path, dst), dst FROM p JOIN e ON src = last) SELECT path FROM p WHERE last NOT IN (SELECT src FROM e)")
def unique_paths(spark, d):
    """From the root of the geography to all its leaves."""
    g = G.geography(spark, d).kept()
    return P.unique_paths(g, spark.range(1).select(F.col("id").alias("src")))


LINE = "WITH RECURSIVE e AS (SELECT a.n_nationkey src, b.n_nationkey dst FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1), v AS (SELECT n_nationkey id FROM nation)\n"
SIMPLE = ", r(id) AS (SELECT id FROM v WHERE id NOT IN (SELECT dst FROM e) UNION SELECT dst FROM r JOIN e ON src = id) SELECT (SELECT count(*) FROM v WHERE id NOT IN (SELECT dst FROM e)) = 1 AND (SELECT max(n) FROM (SELECT count(*) n FROM e GROUP BY src)) <= 1 AND (SELECT count(*) FROM r) = (SELECT count(*) FROM v) AS is_simple_path"


@query(LINE + SIMPLE)
def is_simple_path(spark, d):
    """Of nations in the order of their keys."""
    n = G.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    e = n.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).join(n.select(F.col("id").alias("dst")), "dst", "left_semi")
    return P.is_simple_path(Graph.build(n, e, directed=True))


@query(GEO + SIMPLE)
def is_simple_path_geography(spark, d):
    return P.is_simple_path(G.geography(spark, d))


@query()
def breadth_first_order(spark, d):
    return P.breadth_first_order(G.copurchase_all(spark, d).kept())


@query()
def degeneracy_order(spark, d):
    return P.degeneracy_order(G.copurchase_all(spark, d))


@query()
def is_chordal(spark, d):
    return P.is_chordal(G.copurchase(spark, d).kept())


# -- matrices and types ---------------------------------------------------------------------------------------------------------
@query("SELECT vec_id AS src, CAST(i - 1 AS BIGINT) AS dst, CAST(embedding[i] AS DOUBLE) AS weight FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def from_dense(spark, d):
    return X.from_dense(G.table(spark, d, "embeddings").select(F.col("vec_id").alias("src"), F.col("embedding").alias("values")))


@query(SUPP + "SELECT src, dst, CAST((row_number() OVER (ORDER BY src, dst) - 1) * 2 AS DOUBLE) AS weight FROM e")
def with_values(spark, d):
    """The supply matrix with twice the entry's number as its value."""
    m = G.supplies(spark, d)
    values = spark.range(m.count()).select(F.col("id").alias("position"), (F.col("id") * 2).cast("double").alias("weight"))
    return X.with_values(m, values)


@query(SUPP + "SELECT src, dst, CASE WHEN src % 3 = 0 THEN -weight ELSE weight END AS weight FROM e")
def updated(spark, d):
    m = G.supplies(spark, d)
    return X.updated(m, m.where("src % 3 = 0").select("src", "dst", (-F.col("weight")).alias("weight")))


@query(SUPP + "SELECT src, dst, weight FROM e UNION ALL SELECT s_suppkey, -1 - s_nationkey, s_acctbal FROM supplier")
def extended(spark, d):
    """The supply matrix and a column for each nation left of it."""
    more = G.table(spark, d, "supplier").select(F.col("s_suppkey").alias("src"), (-1 - F.col("s_nationkey")).cast("long").alias("dst"), F.col("s_acctbal").alias("weight"))
    return X.extended(G.supplies(spark, d), more)


@query(GEO + KIND + "SELECT id FROM k WHERE type = 'nation'")
def nodes_of_type(spark, d):
    return X.nodes_of_type(_kinds(G.geography(spark, d)), "nation")


@query(GEO + KIND + "SELECT t AS type, t IN (SELECT type FROM k) AS present FROM (SELECT unnest(['root', 'customer', 'city']) AS t)")
def has_node_type(spark, d):
    wanted = spark.createDataFrame([("root",), ("customer",), ("city",)], "type string")
    return X.has_node_type(_kinds(G.geography(spark, d)), wanted)


@query(GEO + KIND + "SELECT a.type AS src_type, b.type AS dst_type, count(*) AS edges FROM e JOIN k a ON a.id = src JOIN k b ON b.id = dst GROUP BY 1, 2")
def typed_edges(spark, d):
    g = G.geography(spark, d)
    return X.typed_edges(g, _kinds(g))


SEQ = ", x AS (SELECT unnest([src, dst]) AS id, src % 2 AS side FROM e WHERE src < dst), s AS (SELECT side, id, count(*) degree FROM x GROUP BY 1, 2), h AS (SELECT side, degree, count(*) AS vertices FROM s GROUP BY 1, 2)\n"


@query(COPART_ALL + ", s AS (SELECT unnest([src, dst]) AS id FROM e WHERE src < dst), h AS (SELECT id, count(*) AS degree FROM s GROUP BY 1) SELECT degree, count(*) AS vertices FROM h GROUP BY 1")
def degree_sequence(spark, d):
    return X.degree_sequence(G.copurchase_all(spark, d).edges.where("src < dst"))


@query(COPART + SEQ + "SELECT count(*) > 0 AS exchange FROM (FROM h WHERE side = 0) a FULL JOIN (FROM h WHERE side = 1) b ON a.degree = b.degree WHERE a.vertices IS DISTINCT FROM b.vertices")
def delta_y(spark, d):
    """Of the co-purchase edges whose lower part has an even key against those with an odd one."""
    e = G.copurchase(spark, d).edges.where("src < dst")
    return X.has_delta_y_exchange(e.where("src % 2 = 0"), e.where("src % 2 = 1"))


@query(COPART + SEQ + "SELECT count(*) > 0 AS exchange FROM (FROM h WHERE side = 0) a FULL JOIN (FROM h WHERE side = 0) b ON a.degree = b.degree WHERE a.vertices IS DISTINCT FROM b.vertices")
def delta_y_same(spark, d):
    """Of the edges with an even lower key against their own reverses: no difference."""
    e = G.copurchase(spark, d).edges.where("src < dst and src % 2 = 0")
    return X.has_delta_y_exchange(e, A.transpose(e))


GAPS = "WITH a AS (SELECT c_nationkey n, avg(c_acctbal) / 1000 x FROM customer GROUP BY 1), g AS (SELECT p.n src, q.n dst, abs(p.x - q.x) w FROM a p CROSS JOIN a q)\n"


def _gaps(spark, d):
    """How far the mean balances of two nations lie apart: the distance matrix of 25 nations, and the balances."""
    a = G.table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("id")).agg((F.avg("c_acctbal") / 1000).alias("x"))
    b = a.select(F.col("id").alias("dst"), F.col("x").alias("y"))
    return a, a.crossJoin(b).select(F.col("id").alias("src"), "dst", F.abs(F.col("x") - F.col("y")).alias("weight"))


@query(GAPS + ", r AS (SELECT src, avg(w * w) m FROM g GROUP BY 1) SELECT CAST(g.src AS BIGINT) AS src, CAST(g.dst AS BIGINT) AS dst, round(-0.5 * (w * w - p.m - q.m + (SELECT avg(w * w) FROM g)), 6) + 0.0 AS value FROM g JOIN r p ON p.src = g.src JOIN r q ON q.src = g.dst")
def double_center(spark, d):
    return X.double_center(_gaps(spark, d)[1]).select("src", "dst", (F.round("value", 6) + F.lit(0.0)).alias("value"))


@query(GAPS + "SELECT round(sqrt(sum((abs(floor(p.x) - floor(q.x)) - w) * (abs(floor(p.x) - floor(q.x)) - w)) / sum(w * w)), 6) AS stress FROM g JOIN a p ON p.n = g.src JOIN a q ON q.n = g.dst WHERE g.src < g.dst")
def mds_stress(spark, d):
    """Of the whole thousands of the balances, as points of a line."""
    points, cells = _gaps(spark, d)
    at = points.select("id", F.array(F.floor("x").cast("double")).alias("x"))
    return X.stress(cells, at).select(F.round("stress", 6).alias("stress"))


# -- random graphs --------------------------------------------------------------------------------------------------------------
def _unit(seed: int, *parts: str) -> str:
    return f"(CAST('0x' || substr(md5(concat_ws('/', '{seed}', {', '.join(parts)})), 1, 8) AS BIGINT) / 4294967296.0)"


_random("configuration_model", lambda s: N.configuration_model(s, s.range(100).select("id", (2 + 2 * (F.col("id") % 4)).alias("degree")), 11), f", s AS (SELECT i AS id, unnest(range(1, 3 + 2 * (i % 4))) AS k FROM r WHERE i < 100), o AS (SELECT id, row_number() OVER (ORDER BY {_unit(11, 'id', 'k')}, id, k) - 1 AS n FROM s), q AS (SELECT min(id) a, max(id) b FROM o GROUP BY n // 2) SELECT DISTINCT a AS src, b AS dst FROM q WHERE a <> b")
_random("random_geometric", lambda s: N.random_geometric(s, 150, 0.15, 12), f", c AS (SELECT i AS id, {_unit(12, 'i')} AS x, {_unit(13, 'i')} AS y FROM r WHERE i < 150) SELECT a.id AS src, b.id AS dst FROM c a JOIN c b ON a.id < b.id WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.15 * CAST(0.15 AS DOUBLE)")


@query()
def gen_random_regular(spark, d):
    return N.random_regular(spark, 60, 3, 1).edges.where("src < dst").select("src", "dst")
