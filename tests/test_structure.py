"""Blocks, cliques, patterns and communities against plain versions on small graphs."""

import itertools
import random

from weftgraph.graph import Graph
from weftgraph.operators import blocks, communities, iterative, patterns
from weftgraph.sources import generators


def _graph(spark, n, edges, directed=False):
    return Graph.build(spark.range(n), spark.createDataFrame(edges, "src long, dst long"), directed)


def _sample(seed, n, m):
    g = random.Random(seed)
    pairs = [(a, b) for a in range(n) for b in range(a + 1, n)]
    return g.sample(pairs, m)


def _parts(nodes, edges):
    root = {v: v for v in nodes}
    for a, b in edges:
        x, y = a, b
        while root[x] != x:
            x = root[x]
        while root[y] != y:
            y = root[y]
        root[max(x, y)] = min(x, y)
    return sum(root[v] == v for v in nodes)


def test_blocks_equal_removal_of_vertices(spark):
    """Two edges share a block if no vertex's removal parts them; a bridge and a cut vertex raise the number of components."""
    n, edges = 26, sorted({*_sample(3, 16, 20), (16, 17), (17, 18), (16, 18), (18, 19), (19, 20), (20, 21), (19, 21), (22, 23), (1, 16)})
    of = blocks.blocks(_graph(spark, n, edges)).cache()
    got = {(r["src"], r["dst"]): r["block"] for r in of.collect()}
    assert set(got) == set(edges)
    cuts = {v for v in range(n) if _parts(set(range(n)) - {v}, [e for e in edges if v not in e]) > _parts(range(n), edges) - (not any(v in e for e in edges))}
    assert {r["id"] for r in blocks.articulation_points(of).collect()} == cuts
    assert {tuple(r) for r in blocks.bridges(of).collect()} == {e for e in edges if _parts(range(n), [x for x in edges if x != e]) > _parts(range(n), edges)}
    # merging edges that meet at a vertex without being parted by it gives the blocks
    name = {e: e for e in edges}
    for v in range(n):
        rest = [e for e in edges if v not in e]
        reach = {}
        for u in range(n):
            seen, todo = {u}, [u]
            while todo:
                x = todo.pop()
                for a, b in rest:
                    for p, q in ((a, b), (b, a)):
                        if p == x and q not in seen:
                            seen.add(q), todo.append(q)
            reach[u] = seen
        mine = [e for e in edges if v in e]
        for e, f in itertools.combinations(mine, 2):
            if sum(f) - v in reach[sum(e) - v]:
                old, new = name[f], name[e]
                name = {k: new if x == old else x for k, x in name.items()}
    classes = lambda d: {frozenset(k for k in d if d[k] == x) for x in d.values()}
    assert classes(got) == classes(name)
    assert not blocks.cactus(of).first()[0]
    ring = blocks.blocks(_graph(spark, 7, [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 5), (3, 5)]))
    assert blocks.cactus(ring).first()[0] and blocks.blocks(_graph(spark, 3, [])).count() == 0


def test_patterns_equal_permutations(spark):
    n, edges = 9, _sample(5, 9, 17)
    have = {*edges, *((b, a) for a, b in edges)}
    g = _graph(spark, n, edges)
    for pattern in ([(0, 1), (1, 2), (2, 3)], [(0, 1), (1, 2), (2, 0), (2, 3)], [(2, 0), (2, 1), (2, 3)]):
        k = 1 + max(map(max, pattern))
        for mode in ("monomorphism", "induced"):
            got = {tuple(r) for r in patterns.match_pattern(g, pattern, mode).collect()}
            asked = {*pattern, *((b, a) for a, b in pattern)}
            want = {p for p in itertools.permutations(range(n), k) if all(((p[i], p[j]) in have) == ((i, j) in asked) or (mode == "monomorphism" and (i, j) not in asked) for i in range(k) for j in range(k) if i != j)}
            assert got == want
    d = _graph(spark, n, edges, directed=True)
    got = {tuple(r) for r in patterns.match_pattern(d, [(0, 1), (2, 1)], "induced").collect()}
    assert got == {(a, b, c) for a, b, c in itertools.permutations(range(n), 3) if (a, b) in edges and (c, b) in edges and not {(a, c), (c, a), (b, a), (b, c)} & set(edges)}
    same = _graph(spark, 4, [(0, 1), (1, 2), (2, 3), (0, 3)])
    assert patterns.match_pattern(same, [(0, 1), (1, 2), (2, 3), (3, 0)], "isomorphism").count() == 8
    assert patterns.match_pattern(g, [(0, 1), (1, 2), (2, 3), (3, 0)], "isomorphism").count() == 0


def test_cliques_equal_subsets(spark):
    n, edges = 10, _sample(8, 10, 28)
    g = _graph(spark, n, edges)
    whole = [c for k in range(1, n + 1) for c in itertools.combinations(range(n), k) if all(p in edges for p in itertools.combinations(c, 2))]
    assert patterns.cliques(g, 3).count() == sum(len(c) == 3 for c in whole)
    most = max(map(len, whole))
    assert {tuple(r["members"]) for r in patterns.maximum_cliques(g).collect()} == {c for c in whole if len(c) == most}


def test_communities_of_a_block_model(spark):
    """Planted blocks are found; modularity is no worse than theirs; Leiden's communities are connected."""
    g = generators.stochastic_block_model(spark, [15, 15, 15], 0.7, 0.02, 1).kept()
    planted = g.vertices.selectExpr("id", "id div 15 AS community")
    want = communities.modularity(g, planted).first()[0]
    for found in (communities.louvain(g), communities.leiden(g)):
        assert found.count() == 45 and communities.modularity(g, found).first()[0] >= want - 1e-9
        assert communities.connected_parts(g, found).select("community").distinct().count() == found.select("community").distinct().count()
    assert communities.modularity(_graph(spark, 3, []), spark.range(3).selectExpr("id", "id AS community")).first()[0] == 0


def test_paths_and_random_graphs(spark):
    g = _graph(spark, 6, [(0, 1), (1, 2), (2, 0), (2, 3), (4, 4)], directed=True)
    pairs = spark.createDataFrame([(a, b) for a in range(6) for b in range(6)], "src long, id long")
    got = {(r["src"], r["id"]) for r in iterative.has_path(g, pairs).where("has_path").collect()}
    assert got == {(a, b) for a in range(3) for b in range(4)} | {(4, 4)}
    tree = generators.preferential_attachment(spark, 60, 3)
    assert tree.edges.count() == 118 and iterative.connected_components(tree).select("component").distinct().count() == 1
    assert generators.gnm(spark, 20, 50).edges.count() == 100
