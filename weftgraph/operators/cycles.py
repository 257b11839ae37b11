"""Cycle spaces of undirected simple graphs: minimum bases, relevant and essential cycles, and series-parallel reduction.

A cycle is a set of edge numbers, a row for each. Sets are added modulo 2 by counting; elimination goes in rounds in which every cycle
whose largest edge a shorter cycle owns has that cycle added to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import Graph, GraphError
from weftgraph.operators.iterative import core_numbers
from weftgraph.runtime import materialize, materialize_with


def _numbered(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Edges (e, src, dst), src < dst, that may lie on cycles, with their numbers; and both directions of them (src, dst, e)."""
    if g.directed:
        raise GraphError("the graph is directed")
    if not g.edges.where("src = dst").isEmpty():
        raise GraphError("the graph has a loop")
    core = core_numbers(g).where("core >= 2").select("id")
    inner = g.edges.where("src < dst").select("src", "dst").distinct().join(core.withColumnRenamed("id", "src"), "src", "left_semi").join(core.withColumnRenamed("id", "dst"), "dst", "left_semi")
    e = materialize(inner.select(F.monotonically_increasing_id().alias("e"), "src", "dst"), "cycle-e")
    return e, materialize(e.select("src", "dst", "e").union(e.select("dst", "src", "e")), "cycle-steps")


def _sum(p: Column, q: Column) -> Column:
    """The edges of one path but not of both."""
    return F.concat(F.array_except(p, q), F.array_except(q, p))


def _tree_paths(steps: DataFrame) -> DataFrame:
    """(root, id, path): edge numbers of the path to each vertex in a breadth-first tree from each root; ties go to the smallest path."""
    empty = F.array().cast("array<long>")
    seen = front = materialize(steps.select(F.col("src").alias("root")).distinct().select("root", F.col("root").alias("id"), empty.alias("path")), "trees")
    while True:
        met = front.join(steps.select(F.col("src").alias("id"), "dst", "e"), "id").select("root", F.col("dst").alias("id"), F.concat("path", F.array("e")).alias("path"))
        new = met.groupBy("root", "id").agg(F.min("path").alias("path")).join(seen.select("root", "id"), ["root", "id"], "left_anti")
        front, facts = materialize_with(new, "trees", n=F.count("*"))
        if not facts["n"]:
            return seen
        seen = seen.union(front)


def _named(sets: DataFrame) -> DataFrame:
    """(cid, length, edges) of distinct sorted edge sets; numbers are any."""
    return materialize(sets.select(F.array_sort("edges").alias("edges")).distinct().select(F.monotonically_increasing_id().alias("cid"), F.size("edges").alias("length"), "edges"), "cycles")


def _horton(e: DataFrame, steps: DataFrame) -> DataFrame:
    """For each root and edge, the edge and the tree paths to its ends, less what these share: among these is a minimum basis."""
    paths = _tree_paths(steps)
    ends = e.join(paths.select(F.col("id").alias("src"), "root", F.col("path").alias("p")), "src").join(paths.select(F.col("id").alias("dst"), "root", F.col("path").alias("q")), ["dst", "root"])
    off_tree = ~F.array_contains("p", F.col("e")) & ~F.array_contains("q", F.col("e"))
    return _named(ends.where(off_tree).select(F.concat(_sum(F.col("p"), F.col("q")), F.array("e")).alias("edges")))


def _rows(cycles: DataFrame, tagged: bool = False) -> DataFrame:
    """(cid, key): a row for each edge; ``tagged``: and one of key -1 - cid, which tells in the end what was added up."""
    keys = F.concat("edges", F.array(-1 - F.col("cid"))) if tagged else F.col("edges")
    return cycles.select("cid", F.explode(keys).alias("key"))


def _eliminated(rows: DataFrame, rank: DataFrame) -> DataFrame:
    """Rows after each cycle has a largest edge of its own or no edge left; only cycles of lower rank(cid, r) are added to others.

    So the cycles that keep an edge are those that no sum of cycles before them gives.
    """
    rows = materialize(rows, "elim")
    while True:
        pivot = rows.groupBy("cid").agg(F.max("key").alias("pivot")).where("pivot >= 0").join(rank, "cid")
        owner = pivot.groupBy("pivot").agg(F.min(F.struct("r", "cid")).alias("o")).select("pivot", F.col("o.cid").alias("by"))
        add = pivot.join(owner, "pivot").where("cid <> by").select("cid", "by")
        more, facts = materialize_with(add.join(rows.select(F.col("cid").alias("by"), "key"), "by").select("cid", "key"), "elim-add", n=F.count("*"))
        if not facts["n"]:
            return rows
        rows = materialize(rows.union(more).groupBy("cid", "key").agg(F.count("*").alias("n")).where("n % 2 = 1").select("cid", "key"), "elim")


def _rank(cycles: DataFrame) -> DataFrame:
    return cycles.select("cid", F.struct("length", "edges").alias("r"))


def _told(cycles: DataFrame, e: DataFrame) -> DataFrame:
    """(length, edges): edges as pairs in ascending order."""
    pairs = cycles.select("cid", "length", F.explode("edges").alias("e")).join(e, "e")
    return pairs.groupBy("cid", "length").agg(F.array_sort(F.collect_list(F.struct("src", "dst"))).alias("edges")).select("length", "edges")


def minimum_cycle_basis(g: Graph) -> DataFrame:
    """(length, edges): cycles of least total length that generate all cycles; as many as the cycle rank. Loops and directed graphs are errors.

    Candidates are V times the cycle rank, of which each distinct one is kept once.
    """
    e, steps = _numbered(g)
    found = _horton(e, steps)
    kept = _eliminated(_rows(found), _rank(found)).select("cid").distinct()
    return _told(found.join(kept, "cid"), e)


def _round_cycles(steps: DataFrame, lengths: list[int]) -> DataFrame:
    """(cid, length, edges): cycles of the lengths that are two shortest paths from a vertex, to one end or to the ends of an edge.

    Every cycle that is no sum of shorter ones has this form. All shortest paths are followed up to half of the largest length.
    """
    empty = F.array().cast("array<long>")
    start = steps.select(F.col("src").alias("root")).distinct().select("root", F.col("root").alias("id"), F.array("root").alias("way"), empty.alias("path"))
    level, seen, sets = materialize(start, "ways"), start.select("root", "id"), None
    for depth in range(max(lengths, default=0) // 2 + 1):
        a, b = level.select("root", "id", F.col("way").alias("w"), F.col("path").alias("p")), level.select("root", F.col("id").alias("id2"), F.col("way").alias("w2"), F.col("path").alias("p2"))
        apart = F.size(F.array_intersect("w", "w2"))
        if depth and 2 * depth in lengths:  # both paths end here
            both = a.join(b.where("root < id2"), (a["root"] == b["root"]) & (a["id"] == b["id2"])).where((F.col("p") < F.col("p2")) & (apart == 2))
            sets = _more(sets, both.select(F.concat("p", "p2").alias("edges")))
        if depth and 2 * depth + 1 in lengths:  # an edge joins the ends
            both = a.join(steps.where("src < dst").select(F.col("src").alias("id"), F.col("dst").alias("id2"), "e"), "id").join(b.withColumnRenamed("root", "root2"), "id2").where((F.col("root") == F.col("root2")) & (apart == 1))
            sets = _more(sets, both.select(F.concat("p", "p2", F.array("e")).alias("edges")))
        met = level.join(steps.select(F.col("src").alias("id"), "dst", "e"), "id").join(seen.select("root", F.col("id").alias("dst")), ["root", "dst"], "left_anti")
        level = materialize(met.select("root", F.col("dst").alias("id"), F.concat("way", F.array("dst")).alias("way"), F.concat("path", F.array("e")).alias("path")), "ways")
        seen = seen.union(level.select("root", "id").distinct())
    return _named(sets) if sets is not None else _named(start.where("false").select(F.col("path").alias("edges")))


def _more(sets: DataFrame | None, new: DataFrame) -> DataFrame:
    new = materialize(new, "sets")
    return new if sets is None else sets.union(new)


def _relevant(g: Graph) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges; relevant cycles (cid, length, edges); and which of them are in every minimum basis (cid)."""
    e, steps = _numbered(g)
    found = _horton(e, steps)
    basis = materialize(found.join(_eliminated(_rows(found), _rank(found)).select("cid").distinct(), "cid"), "basis")
    lengths = sorted(r["length"] for r in basis.select("length").distinct().collect())  # distinct lengths only
    every = _round_cycles(steps, lengths)
    relevant, essential = every.where("false"), every.select("cid").where("false")
    for n in lengths:
        # numbers of shorter basis cycles are negative beside those of the class, and come first
        shorter = basis.where(F.col("length") < n).select((-1 - F.col("cid")).alias("cid"), "length", "edges")
        own = every.where(F.col("length") == n)
        rank = _rank(shorter.union(own))
        # against shorter cycles alone: each cycle of the class by itself, so none may own an edge that another needs
        left = _cleared(_rows(own), _rows(shorter), _rank(shorter))
        alive = materialize(own.join(left.select("cid").distinct(), "cid", "left_semi"), "relevant")
        relevant = relevant.union(alive)
        rows = _eliminated(_rows(shorter).union(_rows(alive, tagged=True)), rank)
        spent = rows.groupBy("cid").agg(F.max("key").alias("m")).where("m < 0").select("cid")
        tied = rows.join(spent, "cid").select((-1 - F.col("key")).alias("cid")).distinct()
        essential = essential.union(materialize(alive.select("cid").join(tied, "cid", "left_anti"), "essential"))
    return e, relevant, essential


def _cleared(rows: DataFrame, basis: DataFrame, rank: DataFrame) -> DataFrame:
    """What is left of each cycle of ``rows`` once cycles of ``basis`` are added to it while one owns its largest edge."""
    fixed = _eliminated(basis, rank)
    owner = materialize(fixed.groupBy("cid").agg(F.max("key").alias("pivot")).select("pivot", F.col("cid").alias("by")), "owners")
    rows = materialize(rows, "cleared")
    while True:
        add = rows.groupBy("cid").agg(F.max("key").alias("pivot")).join(owner, "pivot").select("cid", "by")
        more, facts = materialize_with(add.join(fixed.select(F.col("cid").alias("by"), "key"), "by").select("cid", "key"), "cleared-add", n=F.count("*"))
        if not facts["n"]:
            return rows
        rows = materialize(rows.union(more).groupBy("cid", "key").agg(F.count("*").alias("n")).where("n % 2 = 1").select("cid", "key"), "cleared")


def relevant_cycles(g: Graph) -> DataFrame:
    """(length, edges): cycles that no sum of strictly shorter ones gives, that is, those of some minimum basis. There may be exponentially many."""
    e, relevant, _ = _relevant(g)
    return _told(relevant, e)


def essential_cycles(g: Graph) -> DataFrame:
    """(length, edges): cycles of every minimum basis: relevant ones that no sum of other relevant ones of at most their length gives."""
    e, relevant, essential = _relevant(g)
    return _told(relevant.join(essential, "cid", "left_semi"), e)


def k4_cores(g: Graph) -> DataFrame:
    """(src, dst), src < dst: what is left when vertices of degree 0 and 1 go and those of degree 2 become an edge, parallel edges merged, as long as there are any.

    Nothing is left just if no subdivision of the complete graph on four vertices is inside. Loops do not matter. In a round a vertex of
    degree 2 gives way if its hash is below those of its neighbours of degree 2, so that chains shrink by a share a round.
    """
    e = materialize(g.edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "sp")
    turn = 0
    while True:
        both = e.union(e.select("dst", "src"))
        degree, facts = materialize_with(both.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"), F.min("dst").alias("a"), F.max("dst").alias("b")), "sp-d", low=F.count(F.when(F.col("d") <= 2, 1)))
        if not facts["low"]:
            return e
        turn += 1
        twos = degree.where("d = 2").select("id", "a", "b", F.xxhash64("id", F.lit(turn)).alias("h"))
        rival = [twos.select(F.col("id").alias(c), F.col("h").alias(f"h{c}")) for c in ("a", "b")]
        chosen = twos.join(rival[0], "a", "left").join(rival[1], "b", "left").where("(ha is null or h < ha or h = ha and id < a) and (hb is null or h < hb or h = hb and id < b)")
        chosen = materialize(chosen.select("id", "a", "b"), "sp-in")
        gone = degree.where("d = 1").select("id").union(chosen.select("id"))
        rest = e.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst")
        # a neighbour of degree 1 takes the new edge with it
        new = chosen.join(degree.where("d = 1").select(F.col("id").alias("a")), "a", "left_anti").join(degree.where("d = 1").select(F.col("id").alias("b")), "b", "left_anti")
        e = materialize(rest.union(new.select("a", "b")).distinct(), "sp")


def has_k4_homeomorph(g: Graph) -> DataFrame:
    """(has_k4): whether a subdivision of the complete graph on four vertices is a subgraph."""
    return k4_cores(g).agg((F.count("*") > 0).alias("has_k4"))
