"""Common subgraphs of pairs of graphs against exhaustive search, all pairs in one run."""

import itertools

import numpy as np

from weftgraph.operators import mces as M


def exhaustive(one, two, la, lb):
    """Most edges that an injective map of vertices with equal labels carries over."""
    va, vb = sorted(la), sorted(lb)
    best = 0
    small, large = (va, vb), [None] * len(va)
    for image in itertools.permutations([*vb, *large], len(va)):
        f = dict(zip(va, image))
        if all(y is None or la[x] == lb[y] for x, y in f.items()):
            best = max(best, sum(f[a] is not None and f[b] is not None and tuple(sorted((f[a], f[b]))) in two for a, b in one))
    return best


def tables(spark, graphs):
    v = [(k, i, lab) for k, (labels, _) in enumerate(graphs) for i, lab in labels.items()]
    e = [(k, a, b, None) for k, (_, edges) in enumerate(graphs) for a, b in edges]
    return spark.createDataFrame(v, "graph long, id long, label string"), spark.createDataFrame(e, "graph long, src long, dst long, label string")


def test_common_subgraphs_of_pairs(spark):
    g = np.random.default_rng(4)
    triangle, claw = ({i: "c" for i in range(3)}, [(0, 1), (0, 2), (1, 2)]), ({i: "c" for i in range(4)}, [(0, 1), (0, 2), (0, 3)])
    path, none = ({0: "c", 1: "n", 2: "o"}, [(0, 1), (1, 2)]), ({0: "x", 1: "y"}, [(0, 1)])
    graphs = [triangle, claw, path, none]
    for _ in range(8):
        n = int(g.integers(3, 5))
        graphs.append(({i: "cn"[int(g.random() < 0.3)] for i in range(n)}, [p for p in itertools.combinations(range(n), 2) if g.random() < 0.6]))
    pairs = [(0, 0, 1), (1, 2, 2), (2, 2, 3), (3, 0, 0)] + [(4 + k, 4 + 2 * k, 5 + 2 * k) for k in range(4)] + [(9, 4, 4)]
    v, e = tables(spark, graphs)
    p = spark.createDataFrame(pairs, "pair long, a long, b long")
    out = {r["pair"]: r for r in M.mces(v, e, p).collect()}
    bounds = {r["pair"]: r for r in M.degree_bounds(v, e, p).collect()}
    assert set(out) == {k for k, _, _ in pairs}
    for k, a, b in pairs:
        (la, one), (lb, two) = graphs[a], graphs[b]
        assert out[k]["common_edges"] == exhaustive(one, set(two), la, lb), k
        assert bounds[k]["common_edges"] >= out[k]["common_edges"] and bounds[k]["common_vertices"] >= out[k]["common_vertices"]
        f = {x["v1"]: x["v2"] for x in out[k]["mapping"] or []}
        assert len(set(f.values())) == len(f) and all(la[x] == lb[y] for x, y in f.items())
        for m in out[k]["matched"] or []:  # the map carries each matched edge to its image
            assert (m["src1"], m["dst1"]) in one and sorted((f[m["src1"]], f[m["dst1"]])) == [m["src2"], m["dst2"]]
    assert out[1]["similarity"] == out[3]["similarity"] == 1.0 and out[2]["common_edges"] == 0
    assert out[1]["fragment_count"] == 1 and out[1]["largest_edges"] == 2 and out[1]["largest_vertices"] == 3


def test_partitioned_cliques(spark):
    g = np.random.default_rng(1)
    v = [(a << 20) + b for a in range(4) for b in range(4)]
    e = [(x, y) for x, y in itertools.combinations(v, 2) if x >> 20 != y >> 20 and (x - y) % (1 << 20) and g.random() < 0.7]
    have = set(e)
    best = max(k for k in range(1, 5) for c in itertools.combinations(v, k) if all(p in have for p in itertools.combinations(c, 2)))
    want = sorted(c for c in itertools.combinations(v, best) if all(p in have for p in itertools.combinations(c, 2)))
    got = M.partitioned_maximum_cliques(spark.createDataFrame([(7, x) for x in v], "pair long, x long"), spark.createDataFrame([(7, *p) for p in e], "pair long, x long, y long")).collect()
    assert sorted(tuple(r["members"]) for r in got) == want and {r["size"] for r in got} == {best}


def test_no_table_of_pairs_is_broadcast(spark):
    v, e = tables(spark, [({i: "c" for i in range(4)}, [(0, 1), (1, 2), (2, 3)]), ({i: "c" for i in range(4)}, [(0, 1), (0, 2), (0, 3), (1, 2)])])
    pairs = spark.createDataFrame([(0, 0, 1), (1, 1, 1)], "pair long, a long, b long")
    store, listening = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    listening.waitUntilEmpty()
    before = {x.executionId() for x in (store.executionsList().apply(i) for i in range(store.executionsList().size()))}
    assert M.mces(v, e, pairs).count() == 2
    listening.waitUntilEmpty()
    runs = [x for x in (store.executionsList().apply(i) for i in range(store.executionsList().size())) if x.executionId() not in before]
    plans = [x.physicalPlanDescription() for x in runs]
    assert plans and not [p for p in plans if "BroadcastExchange" in p]
