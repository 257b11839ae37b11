"""One query for each operator, over graphs of the test tables, with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import set_similarity as S
from weftgraph.graph import Graph, dense_ids
from weftgraph.operators import access as A
from weftgraph.operators import iterative as I
from weftgraph.operators import motifs as M
from weftgraph.operators import semantic as T
from weftgraph.runtime import materialize
from weftgraph.sources import generators as N
from weftgraph.sources import graphs as G

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _rounded(scores, digits: int):
    """Scores to the digits at which sums taken in another order agree."""
    return scores.withColumn("score", F.round("score", digits))


# -- the graphs in SQL ------------------------------------------------------------------------------------------------
COPART = """WITH RECURSIVE l AS (SELECT DISTINCT l_orderkey o, l_partkey p FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 40),
e AS (SELECT a.p src, b.p dst, CAST(count(*) AS DOUBLE) weight FROM l a JOIN l b ON a.o = b.o AND a.p <> b.p GROUP BY 1, 2),
v AS (SELECT p_partkey id FROM part), d AS (SELECT id, count(src) degree FROM v LEFT JOIN e ON src = id GROUP BY id)
"""
COPART_ALL = COPART.replace(" WHERE l_returnflag = 'R' AND l_quantity >= 40", "")
GEO = """WITH RECURSIVE e AS (SELECT CAST(0 AS BIGINT) src, CAST(r_regionkey + 1 AS BIGINT) dst FROM region
UNION ALL SELECT n_regionkey + 1, n_nationkey + 100 FROM nation UNION ALL SELECT s_nationkey + 100, s_suppkey + 1000000 FROM supplier
UNION ALL SELECT c_nationkey + 100, c_custkey + 1000000000 FROM customer), v AS (SELECT CAST(0 AS BIGINT) id UNION ALL SELECT dst FROM e)
"""
TRADE = """WITH RECURSIVE e AS (SELECT CAST(c_nationkey AS BIGINT) src, CAST(s_nationkey AS BIGINT) dst, min(l_extendedprice) weight FROM lineitem
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
v AS (SELECT CAST(n_nationkey AS BIGINT) id FROM nation)
"""
SUPP = "WITH e AS (SELECT l_suppkey src, l_partkey dst, sum(l_quantity) weight FROM lineitem GROUP BY 1, 2)\n"
CC = """, walk(id, c) AS (SELECT id, id FROM v UNION SELECT dst, c FROM walk JOIN e ON src = id), cc AS (SELECT id, min(c) component FROM walk GROUP BY id)
"""
COMMON = ", c AS (SELECT a.src src, b.src dst, count(*) common FROM e a JOIN e b ON a.dst = b.dst AND a.src <> b.src GROUP BY 1, 2)\n"


# -- access -------------------------------------------------------------------------------------------------------------
@query(COPART_ALL + "SELECT (SELECT count(*) FROM v) AS nodes, (SELECT count(*) FROM e) AS entries, (SELECT count(*) FROM e) / CAST((SELECT count(*) FROM v) * (SELECT count(*) FROM v) AS DOUBLE) AS density")
def density(spark, d):
    return A.density(G.copurchase_all(spark, d))


@query(COPART_ALL + "SELECT src AS id, list(dst ORDER BY dst) AS neighbors FROM e GROUP BY src")
def neighbors(spark, d):
    return A.neighbors(G.copurchase_all(spark, d))


@query(GEO + "SELECT id, count(src) AS degree FROM v LEFT JOIN e ON src = id GROUP BY id")
def out_degree(spark, d):
    return A.out_degree(G.geography(spark, d))


@query(GEO + "SELECT id, count(dst) AS degree FROM v LEFT JOIN e ON dst = id GROUP BY id")
def in_degree(spark, d):
    return A.in_degree(G.geography(spark, d))


@query(COPART_ALL + "SELECT id, degree FROM d")
def degree(spark, d):
    return A.out_degree(G.copurchase_all(spark, d))


@query(COPART_ALL + "SELECT id FROM d WHERE degree = 0")
def empty_rows(spark, d):
    return A.empty_rows(G.copurchase_all(spark, d))


@query(GEO + "SELECT id FROM v WHERE id NOT IN (SELECT dst FROM e)")
def root_nodes(spark, d):
    return A.root_nodes(G.geography(spark, d))


@query(GEO + "SELECT id FROM v WHERE id NOT IN (SELECT src FROM e) AND id IN (SELECT dst FROM e)")
def sink_nodes(spark, d):
    return A.sink_nodes(G.geography(spark, d))


@query(COPART_ALL + "SELECT id FROM v WHERE id NOT IN (SELECT src FROM e)")
def singleton_nodes(spark, d):
    return A.singleton_nodes(G.copurchase_all(spark, d))


@query(TRADE + "SELECT count(*) AS self_loops FROM e WHERE src = dst")
def self_loops(spark, d):
    return A.self_loops(G.trade(spark, d))


@query(GEO + "SELECT bool_and(src < dst) AS sorted FROM e")
def is_topologically_sorted(spark, d):
    return A.is_topologically_sorted(G.geography(spark, d))


@query(TRADE + "SELECT count(*) = 0 AS is_symmetric FROM e a WHERE NOT EXISTS (SELECT 1 FROM e b WHERE a.src = b.dst AND a.dst = b.src)")
def is_symmetric(spark, d):
    return A.is_symmetric(G.trade(spark, d).edges)


@query(SUPP + "SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS row_rank FROM e")
def rank_select(spark, d):
    return A.rank_select(G.supplies(spark, d))


@query(SUPP + "SELECT src, max(weight) AS max_weight, max(dst) FILTER (WHERE weight = hi) AS max_dst, min(weight) AS min_weight, min(dst) FILTER (WHERE weight = lo) AS min_dst FROM (SELECT *, max(weight) OVER (PARTITION BY src) hi, min(weight) OVER (PARTITION BY src) lo FROM e) GROUP BY src")
def row_argmax(spark, d):
    return A.row_extremes(G.supplies(spark, d))


@query(SUPP + "SELECT dst AS src, max(weight) AS max_weight, max(src) FILTER (WHERE weight = hi) AS max_dst, min(weight) AS min_weight, min(src) FILTER (WHERE weight = lo) AS min_dst FROM (SELECT *, max(weight) OVER (PARTITION BY dst) hi, min(weight) OVER (PARTITION BY dst) lo FROM e) GROUP BY dst")
def column_argmax(spark, d):
    return A.row_extremes(A.transpose(G.supplies(spark, d)))


@query(SUPP + "SELECT max(weight) AS max_weight, min(weight) AS min_weight FROM e")
def minmax(spark, d):
    return A.extremes(G.supplies(spark, d))


@query(TRADE + "SELECT src, dst, min(weight) AS weight FROM (SELECT * FROM e UNION ALL SELECT dst, src, weight FROM e) GROUP BY 1, 2")
def symmetrize(spark, d):
    return A.symmetrize(G.trade(spark, d).edges)


@query(COPART_ALL + "SELECT CAST(0 AS BIGINT) AS src, id AS dst, coalesce(weight, 9.0) AS weight, weight IS NULL AS imputed FROM v LEFT JOIN (SELECT * FROM e WHERE src = 0) ON dst = id")
def padded_row(spark, d):
    return A.padded(G.copurchase_all(spark, d), 0, 9.0)


@query("SELECT row_number() OVER (ORDER BY symbol) - 1 AS id, symbol FROM (SELECT DISTINCT c_name AS symbol FROM customer)")
def vocabulary(spark, d):
    return dense_ids(G.table(spark, d, "customer").select(F.col("c_name").alias("symbol")))


@query(COPART_ALL + "SELECT id, CAST(coalesce(s, 0) AS BIGINT) AS score FROM v LEFT JOIN (SELECT src, sum(degree) s FROM e JOIN d ON dst = id GROUP BY src) ON src = id")
def second_order_degree(spark, d):
    return A.second_order_degree(G.copurchase_all(spark, d).kept())


# -- motifs and products --------------------------------------------------------------------------------------------------
@query(COPART_ALL + """, t AS (SELECT a.src id, count(*) / 2 t FROM e a JOIN e b ON a.src = b.src AND a.dst <> b.dst JOIN e c ON c.src = a.dst AND c.dst = b.dst GROUP BY 1)
SELECT d.id AS id, degree, CAST(coalesce(t, 0) AS BIGINT) AS triangles, round(CASE WHEN degree < 2 THEN 0.0 ELSE 2.0 * coalesce(t, 0) / (degree * (degree - 1)) END, 9) AS lcc FROM d LEFT JOIN t ON d.id = t.id""")
def triangles_copart(spark, d):
    return M.triangle_count(G.copurchase_all(spark, d).kept())


@query(COPART_ALL + COMMON + "SELECT id, CAST(coalesce(s, 0) AS BIGINT) AS squares FROM v LEFT JOIN (SELECT src, sum(common * (common - 1) // 2) s FROM c GROUP BY src) ON src = id")
def square_count(spark, d):
    return M.square_count(G.copurchase_all(spark, d).kept())


@query(COPART_ALL + COMMON + """, p AS (SELECT a.src id, c.common - 1 sq, greatest(du.degree - 1 - (c.common - 1) - (x.src IS NOT NULL)::INT, 0) + greatest(dw.degree - 1 - (c.common - 1) - (x.src IS NOT NULL)::INT, 0) room
FROM e a JOIN e b ON a.src = b.src AND a.dst < b.dst JOIN c ON c.src = a.dst AND c.dst = b.dst JOIN d du ON du.id = a.dst JOIN d dw ON dw.id = b.dst LEFT JOIN e x ON x.src = a.dst AND x.dst = b.dst)
SELECT v.id AS id, round(CASE WHEN coalesce(s.b, 0) > 0 THEN CAST(s.a AS DOUBLE) / s.b ELSE 0.0 END, 9) AS score FROM v LEFT JOIN (SELECT id, sum(sq) a, sum(sq + room) b FROM p GROUP BY id) s ON v.id = s.id""")
def square_clustering(spark, d):
    return M.square_clustering(G.copurchase_all(spark, d).kept())


@query(COPART_ALL + "SELECT count(*) AS embeddings FROM e a JOIN e b ON a.src = b.src AND a.dst <> b.dst")
def vf2_count_path3(spark, d):
    return M.count_paths3(G.copurchase_all(spark, d))


@query(COPART_ALL + "SELECT count(*) AS embeddings FROM e a JOIN e b ON a.src = b.src AND a.dst <> b.dst WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.src = a.dst AND x.dst = b.dst)")
def vf2_count_path3_induced(spark, d):
    return M.count_paths3(G.copurchase_all(spark, d).kept(), induced=True)


@query(COPART_ALL + "SELECT count(*) AS embeddings FROM e a JOIN e b ON a.dst = b.src AND a.src <> b.dst JOIN e c ON c.src = b.dst AND c.dst = a.src")
def vf2_count_triangle(spark, d):
    return M.count_triangle_embeddings(G.copurchase_all(spark, d).kept())


@query(COPART + ", u AS (SELECT src, dst FROM e WHERE src < dst) SELECT a.src AS a_src, a.dst AS a_dst, b.src AS b_src, b.dst AS b_dst FROM u a JOIN u b ON (a.src, a.dst) < (b.src, b.dst) AND (a.src IN (b.src, b.dst) OR a.dst IN (b.src, b.dst))")
def line_graph(spark, d):
    return M.line_graph(G.copurchase(spark, d))[1]


@query(TRADE + "SELECT a.src AS a_src, a.dst AS mid, b.dst AS b_dst FROM e a JOIN e b ON a.dst = b.src")
def directed_line_graph(spark, d):
    return M.directed_line_graph(G.trade(spark, d))


@query(TRADE + ", p AS (SELECT a.id u, b.id v FROM v a, v b), h AS (SELECT a.n_nationkey src, b.n_nationkey dst FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey), x AS (SELECT a.u u1, a.v v1, b.u u2, b.v v2 FROM p a JOIN p b ON (a.u, a.v) < (b.u, b.v) AND a.u <> b.u AND a.v <> b.v) SELECT u1, v1, u2, v2 FROM x WHERE EXISTS (SELECT 1 FROM e WHERE src = u1 AND dst = u2) = EXISTS (SELECT 1 FROM h WHERE src = v1 AND dst = v2)")
def modular_product(spark, d):
    """Of trade between nations and of nations of one region, over all pairs of nations."""
    g, h = G.trade(spark, d), G.same_region(spark, d)
    pairs = g.vertices.select(F.col("id").alias("u")).crossJoin(h.vertices.select(F.col("id").alias("v")))
    return M.modular_product(pairs, g, h)


# -- traversal, components, structure ---------------------------------------------------------------------------------------
@query(COPART + CC + "SELECT id, component FROM cc")
def connected_components(spark, d):
    return I.connected_components(G.copurchase(spark, d).kept())


@query(COPART + CC + ", k AS (SELECT (SELECT count(DISTINCT component) FROM cc) cc, (SELECT count(*) FROM v) n, (SELECT count(*) FROM e WHERE src < dst) m) SELECT cc AS components, m + cc = n AS is_forest, m + cc = n AND cc = 1 AS is_tree, m - n + cc AS cycle_rank FROM k")
def tree_facts(spark, d):
    return I.tree_facts(G.copurchase(spark, d).kept())


@query(GEO + ", r(src, id) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.id) SELECT src, id FROM r WHERE src <> id")
def reachable(spark, d):
    g = G.geography(spark, d).kept()
    return I.reachable(g, g.edges.select("src").distinct())


@query(GEO + ", h(id, depth) AS (SELECT CAST(0 AS BIGINT), 0 UNION ALL SELECT dst, depth + 1 FROM h JOIN e ON src = id) SELECT CAST(0 AS BIGINT) AS src, id, depth FROM h")
def bfs(spark, d):
    g = G.geography(spark, d).kept()
    return I.hops(g, g.vertices.where("id = 0").select(F.col("id").alias("src")))


@query(GEO + ", h(id, depth) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION ALL SELECT dst, depth + 1 FROM h JOIN e ON src = id) SELECT id, depth AS layer FROM h")
def kahn_layers(spark, d):
    return I.kahn_layers(G.geography(spark, d).kept())


@query("SELECT false AS has_cycle")
def has_cycle(spark, d):
    return I.has_cycle(G.geography(spark, d).kept())


@query(COPART_ALL + ", f AS (SELECT src, dst FROM e QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) = 1), r(src, id) AS (SELECT id, id FROM v UNION SELECT r.src, f.dst FROM r JOIN f ON f.src = r.id) SELECT a.id AS id, min(a.src) AS component FROM r a JOIN r b ON a.src = b.id AND a.id = b.src GROUP BY a.id")
def strongly_connected(spark, d):
    return I.strongly_connected_components(G.partners(spark, d).kept())


@query(GEO + ", h(id, depth) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION ALL SELECT dst, depth + 1 FROM h JOIN e ON src = id) SELECT id, depth % 2 AS color FROM h")
def bipartite_coloring(spark, d):
    g = G.geography(spark, d)
    return I.bipartite_coloring(Graph.build(g.vertices, g.edges).kept())


def _rounds(start: str, step: str, n: int) -> str:
    """SQL of n fixed rounds: one common table expression each."""
    parts = [f", x0 AS ({start})"] + [f", x{i} AS ({step.format(p=f'x{i - 1}')})" for i in range(1, n + 1)]
    return "".join(parts)


@query(TRADE + _rounds("SELECT src, dst, min(w) w FROM (SELECT src, dst, weight w FROM e UNION ALL SELECT id, id, 0.0 FROM v) GROUP BY 1, 2", "SELECT a.src src, b.dst dst, min(a.w + b.w) w FROM {p} a JOIN {p} b ON a.dst = b.src GROUP BY 1, 2", 5) + " SELECT src, dst AS id, round(w, 6) AS distance FROM x5")
def dijkstra(spark, d):
    g = G.trade(spark, d).kept()
    return I.shortest_distances(g, g.vertices.select(F.col("id").alias("src"))).select("src", "id", F.round("distance", 6).alias("distance"))


@query(ORACLES["dijkstra"])
def floyd_warshall(spark, d):
    return I.all_pairs_shortest(G.trade(spark, d).kept()).select("src", "id", F.round("distance", 6).alias("distance"))


# in a tree the way between two vertices leads over their lowest common ancestor
APART = GEO + ", up(id, anc, k) AS (SELECT id, id, 0 FROM v UNION ALL SELECT up.id, e.src, k + 1 FROM up JOIN e ON e.dst = up.anc), m AS (SELECT a.id src, b.id id, min(a.k + b.k) depth FROM up a JOIN up b ON a.anc = b.anc GROUP BY 1, 2)\n"


@query(APART + "SELECT CAST(max(depth) AS BIGINT) AS diameter FROM m")
def diameter(spark, d):
    g = G.geography(spark, d)
    return I.diameter(Graph.build(g.vertices, g.edges).kept())


@query(APART + "SELECT src AS id, round((count(*) - 1) / CAST(sum(depth) AS DOUBLE) * ((count(*) - 1) / CAST((SELECT count(*) - 1 FROM v) AS DOUBLE)), 9) AS score FROM m GROUP BY src")
def closeness(spark, d):
    g = G.geography(spark, d)
    return _rounded(I.closeness(Graph.build(g.vertices, g.edges).kept()), 9)


@query(COPART_ALL + _rounds("SELECT id, CAST(degree AS BIGINT) c FROM d", "SELECT v.id id, coalesce(h, 0) c FROM v LEFT JOIN (SELECT id, max(least(rn, c)) h FROM (SELECT e.src id, {p}.c c, row_number() OVER (PARTITION BY e.src ORDER BY {p}.c DESC) rn FROM e JOIN {p} ON {p}.id = e.dst) GROUP BY id) ON id = v.id".replace("ON id = v.id", "y ON y.id = v.id"), 50).replace(" AS (SELECT v.id id", " AS MATERIALIZED (SELECT v.id id") + " SELECT id, CAST(c AS BIGINT) AS core FROM x50")
def core_number(spark, d):
    return I.core_numbers(G.copurchase_all(spark, d).kept())


def _until(start: str, step: str, n: int) -> str:
    """SQL of power rounds that keep their values from the round on that changed less than 1e-6 a vertex; n rounds are written out, more than it takes."""
    one = "SELECT id, CASE WHEN done THEN was ELSE s END AS s, done OR sum(abs(s - was)) OVER () < 1e-6 * count(*) OVER () AS done FROM (SELECT o.id id, o.s was, y.s s, o.done done FROM {p} o JOIN ({step}) y ON y.id = o.id)"
    parts = [f", x0 AS MATERIALIZED (SELECT id, s, false AS done FROM ({start}))"] + [f", x{i} AS MATERIALIZED ({one.format(p=f'x{i - 1}', step=step.format(p=f'x{i - 1}'))})" for i in range(1, n + 1)]
    return "".join(parts)


@query(COPART_ALL + ", n AS (SELECT count(*) n FROM v)" + _until("SELECT id, 1.0::DOUBLE / (SELECT n FROM n) AS s FROM v", "SELECT d.id AS id, 0.15 / (SELECT n FROM n) + 0.85 * (SELECT coalesce(sum(s), 0) FROM {p} JOIN d d0 ON {p}.id = d0.id WHERE d0.degree = 0) / (SELECT n FROM n) + 0.85 * coalesce(g.s, 0) AS s FROM d LEFT JOIN (SELECT e.dst id, sum({p}.s / d1.degree) s FROM e JOIN {p} ON {p}.id = e.src JOIN d d1 ON d1.id = e.src GROUP BY 1) g ON g.id = d.id", 12) + " SELECT id, round(s, 9) AS score FROM x12")
def pagerank(spark, d):
    return _rounded(I.pagerank(G.copurchase_all(spark, d).kept()), 9)


@query(COPART_ALL + _until("SELECT id, 0.0::DOUBLE AS s FROM v", "SELECT v.id AS id, 0.001 * coalesce(g.s, 0) + 1.0 AS s FROM v LEFT JOIN (SELECT e.src id, sum({p}.s) s FROM e JOIN {p} ON {p}.id = e.dst GROUP BY 1) g ON g.id = v.id", 16) + " SELECT id, round(s / (SELECT sqrt(sum(s * s)) FROM x16), 9) AS score FROM x16")
def katz(spark, d):
    """A smaller alpha than the default 0.1, since the series only converges below the inverse of the largest eigenvalue (over 100 here)."""
    return _rounded(I.katz(G.copurchase_all(spark, d).kept(), alpha=0.001), 9)


@query(COPART_ALL + _until("SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS s FROM v", "SELECT id, s / sqrt(sum(s * s) OVER ()) AS s FROM (SELECT x.id id, x.s + coalesce(g.s, 0) s FROM {p} x LEFT JOIN (SELECT e.src id, sum({p}.s) s FROM e JOIN {p} ON {p}.id = e.dst GROUP BY 1) g ON g.id = x.id)", 20) + " SELECT id, round(s, 9) AS score FROM x20")
def eigenvector_centrality(spark, d):
    return _rounded(I.eigenvector_centrality(G.copurchase_all(spark, d).kept()), 9)


@query(COPART_ALL + _rounds("SELECT id, CAST(0 AS BIGINT) c FROM v", "SELECT id, dense_rank() OVER (ORDER BY c, l) c FROM (SELECT x.id id, x.c c, list_sort(list(y.c)) l FROM {p} x LEFT JOIN e ON e.src = x.id LEFT JOIN {p} y ON y.id = e.dst GROUP BY x.id, x.c)", 16).replace(" AS (SELECT id, ", " AS MATERIALIZED (SELECT id, ") + " SELECT id, min(id) OVER (PARTITION BY c) AS class FROM x16")
def wl_coloring(spark, d):
    return I.wl_coloring(G.copurchase_all(spark, d).kept())


@query(COPART + """, h(src, id, depth) AS (SELECT id, id, 0 FROM v UNION SELECT h.src, e.dst, depth + 1 FROM h JOIN e ON e.src = h.id WHERE depth < 24), m AS (SELECT src, id, min(depth) depth FROM h GROUP BY 1, 2),
p(src, id, depth) AS (SELECT id, id, 0 FROM v UNION ALL SELECT p.src, e.dst, p.depth + 1 FROM p JOIN e ON e.src = p.id JOIN m ON m.src = p.src AND m.id = e.dst AND m.depth = p.depth + 1), s AS (SELECT src, id, depth, CAST(count(*) AS DOUBLE) n FROM p GROUP BY 1, 2, 3),
b AS (SELECT x.id id, sum(x.n * y.n / z.n) / 2 w FROM s x JOIN s y ON y.src = x.id JOIN s z ON z.src = x.src AND z.id = y.id AND z.depth = x.depth + y.depth WHERE x.id <> x.src AND x.id <> y.id GROUP BY 1)
SELECT v.id AS id, round(coalesce(w, 0.0), 6) AS score FROM v LEFT JOIN b ON b.id = v.id""")
def betweenness(spark, d):
    return _rounded(I.betweenness(G.copurchase(spark, d).kept()), 6)


# -- semantic and set similarity --------------------------------------------------------------------------------------------
IC = GEO + """, up(id, anc) AS (SELECT id, id FROM v UNION ALL SELECT up.id, e.src FROM up JOIN e ON e.dst = up.anc), tot AS (SELECT CAST(count(*) AS DOUBLE) n FROM v),
ic AS (SELECT anc id, -ln(count(*) / (SELECT n FROM tot)) ic FROM up GROUP BY anc), p AS (SELECT CAST(100 + a.n_nationkey AS BIGINT) a, CAST(100 + b.n_nationkey AS BIGINT) b FROM nation a, nation b)
"""
RES = ", r AS (SELECT p.a a, p.b b, CASE WHEN p.a = p.b THEN 0.0 ELSE greatest(max(ic.ic), 0.0) END x FROM p JOIN up q ON q.id = p.a JOIN up w ON w.id = p.b AND w.anc = q.anc JOIN ic ON ic.id = q.anc GROUP BY p.a, p.b)\n"


def _nations(spark, d):
    g = G.geography(spark, d).kept()
    n = g.vertices.where("id between 100 and 999").select(F.col("id").alias("a"))
    ic = materialize(T.information_content(g, g.vertices.select("id", F.lit(1).cast("long").alias("n"))), "ic-all")
    return g, ic, n.crossJoin(n.withColumnRenamed("a", "b"))


@query(IC + "SELECT id, round(ic, 9) + 0.0 AS ic FROM ic")
def information_content(spark, d):
    return _nations(spark, d)[1].select("id", (F.round("ic", 9) + 0.0).alias("ic"))


@query(IC + RES + "SELECT a, b, round(x, 9) + 0.0 AS resnik FROM r")
def resnik(spark, d):
    g, ic, pairs = _nations(spark, d)
    return T.resnik(g, ic, pairs).select("a", "b", (F.round("resnik", 9) + 0.0).alias("resnik"))


@query(IC + RES + "SELECT a, b, round(CASE WHEN a = b THEN 1.0 ELSE 2 * x / (i.ic + j.ic) END, 9) + 0.0 AS lin FROM r JOIN ic i ON i.id = a JOIN ic j ON j.id = b")
def lin(spark, d):
    g, ic, pairs = _nations(spark, d)
    return T.lin(g, ic, pairs).select("a", "b", (F.round("lin", 9) + 0.0).alias("lin"))


@query(IC + ", dep AS (SELECT id, count(*) dd FROM up GROUP BY id) SELECT p.a AS a, p.b AS b, round(CASE WHEN p.a = p.b THEN 1.0 ELSE 2.0 * max(x.dd) / 6.0 END, 9) AS wu_palmer FROM p JOIN up q ON q.id = p.a JOIN up w ON w.id = p.b AND w.anc = q.anc JOIN dep x ON x.id = q.anc GROUP BY 1, 2")
def wu_palmer(spark, d):
    g, _, pairs = _nations(spark, d)
    return T.wu_palmer_tree(g, 0, pairs).select("a", "b", F.round("wu_palmer", 9).alias("wu_palmer"))


SIM = """WITH s AS (SELECT DISTINCT CAST(s_nationkey AS BIGINT) n, l_partkey p FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
z AS (SELECT n, count(*) k FROM s GROUP BY n), x AS (SELECT a.n a, b.n b, count(*) c FROM s a JOIN s b ON a.p = b.p AND a.n < b.n GROUP BY 1, 2),
t AS (SELECT x.a a, x.b b, CAST(c AS DOUBLE) c, CAST(i.k AS DOUBLE) m, CAST(j.k AS DOUBLE) n FROM x JOIN z i ON i.n = a JOIN z j ON j.n = b)
"""


@query(SIM + """SELECT a, b, round(c / (m + n - c), 9) AS tanimoto, round(2 * c / (m + n), 9) AS dice, round(c / least(m, n), 9) AS overlap, round(c / sqrt(m * n), 9) AS cosine,
round(c / (c + 0.3 * (m - c) + 0.7 * (n - c)), 9) AS tversky, round((c / m + c / n) / 2, 9) AS kulczynski, round(c / greatest(m, n), 9) AS braun_blanquet, round(c / (2 * (m + n) - 3 * c), 9) AS sokal_sneath,
round((c * (m + n) - m * n) / (m * n), 9) AS mcconnaughey, round(c * c / (m * n), 9) AS johnson FROM t""")
def set_similarities(spark, d):
    """All ten measures between the part sets that the suppliers of two nations deliver."""
    li = G.table(spark, d, "lineitem")
    s = li.join(G.table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").cast("long").alias("n"), F.col("l_partkey").alias("p")).distinct()
    k = s.groupBy("n").agg(F.count("*").cast("double").alias("k"))
    x = s.select(F.col("n").alias("a"), "p").join(s.select(F.col("n").alias("b"), "p"), "p").where("a < b").groupBy("a", "b").agg(F.count("*").cast("double").alias("c"))
    t = x.join(k.select(F.col("n").alias("a"), F.col("k").alias("m")), "a").join(k.select(F.col("n").alias("b"), F.col("k").alias("w")), "b")
    c, m, n = F.col("c"), F.col("m"), F.col("w")
    out = {f.__name__: f(c, m, n) for f in (S.tanimoto, S.dice, S.overlap, S.cosine, S.kulczynski, S.braun_blanquet, S.sokal_sneath, S.mcconnaughey, S.johnson)}
    out["tversky"] = S.tversky(c, m, n, 0.3, 0.7)
    return t.select("a", "b", *[F.round(v, 9).alias(k) for k, v in out.items()])


# -- generators -----------------------------------------------------------------------------------------------------------------
def _generated(name, make, sql):
    def f(spark, d):
        return make(spark).edges.where("src < dst").select("src", "dst")

    f.__name__ = f"gen_{name}"
    query(f"WITH r AS (SELECT range AS i FROM range(200)), p AS (SELECT a.i src, b.i dst FROM r a JOIN r b ON a.i < b.i) {sql}")(f)


_generated("complete", lambda s: N.complete(s, 12), "SELECT src, dst FROM p WHERE dst < 12")
_generated("path", lambda s: N.path(s, 30), "SELECT src, dst FROM p WHERE dst = src + 1 AND dst < 30")
_generated("cycle", lambda s: N.cycle(s, 30), "SELECT src, dst FROM p WHERE dst < 30 AND (dst = src + 1 OR (src = 0 AND dst = 29))")
_generated("star", lambda s: N.star(s, 30), "SELECT src, dst FROM p WHERE src = 0 AND dst <= 30")
_generated("wheel", lambda s: N.wheel(s, 20), "SELECT src, dst FROM p WHERE dst <= 20 AND (src = 0 OR dst = src + 1 OR (src = 1 AND dst = 20))")
_generated("grid", lambda s: N.grid(s, 5, 7), "SELECT src, dst FROM p WHERE dst < 35 AND ((dst = src + 1 AND dst % 7 <> 0) OR dst = src + 7)")
_generated("torus", lambda s: N.grid(s, 5, 7, True), "SELECT src, dst FROM p WHERE dst < 35 AND ((dst = src + 1 AND dst % 7 <> 0) OR dst = src + 7 OR (dst = src + 6 AND src % 7 = 0) OR dst = src + 28)")
_generated("hypercube", lambda s: N.hypercube(s, 5), "SELECT src, dst FROM p WHERE dst < 32 AND bit_count(xor(src, dst)) = 1")
_generated("complete_bipartite", lambda s: N.complete_bipartite(s, 5, 8), "SELECT src, dst FROM p WHERE src < 5 AND dst BETWEEN 5 AND 12")
_generated("crown", lambda s: N.crown(s, 6), "SELECT src, dst FROM p WHERE src < 6 AND dst BETWEEN 6 AND 11 AND dst - 6 <> src")
_generated("turan", lambda s: N.turan(s, 13, 4), "SELECT src, dst FROM p WHERE dst < 13 AND src % 4 <> dst % 4")
_generated("barbell", lambda s: N.barbell(s, 5, 3), "SELECT src, dst FROM p WHERE dst < 13 AND (dst < 5 OR src >= 8 OR (dst = src + 1 AND src >= 4 AND dst <= 8))")
_generated("windmill", lambda s: N.windmill(s, 4, 5), "SELECT src, dst FROM p WHERE dst <= 16 AND (src = 0 OR (src - 1) // 4 = (dst - 1) // 4)")
_generated("friendship", lambda s: N.friendship(s, 9), "SELECT src, dst FROM p WHERE dst <= 18 AND (src = 0 OR (src - 1) // 2 = (dst - 1) // 2)")
