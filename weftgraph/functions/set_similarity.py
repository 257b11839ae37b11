"""Set similarities as Column expressions of the intersection size and the two set sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ratio(num: Column, den: Column, empty: float = 1.0) -> Column:
    return F.when(den == 0, F.lit(empty)).otherwise(num / den)


def tanimoto(c: Column, a: Column, b: Column) -> Column:
    return _ratio(c.cast("double"), a + b - c)


def dice(c: Column, a: Column, b: Column) -> Column:
    return _ratio(2.0 * c, a + b)


def _one_empty(a: Column, b: Column, value: Column) -> Column:
    return F.when((a == 0) & (b == 0), 1.0).when((a == 0) | (b == 0), 0.0).otherwise(value)


def overlap(c: Column, a: Column, b: Column) -> Column:
    return _one_empty(a, b, c / F.least(a, b))


def cosine(c: Column, a: Column, b: Column) -> Column:
    return _one_empty(a, b, c / F.sqrt(a.cast("double") * b))


def tversky(c: Column, a: Column, b: Column, alpha: float, beta: float) -> Column:
    return _ratio(c.cast("double"), c + alpha * (a - c) + beta * (b - c))


def kulczynski(c: Column, a: Column, b: Column) -> Column:
    return _one_empty(a, b, (c / a + c / b) / 2)


def braun_blanquet(c: Column, a: Column, b: Column) -> Column:
    return _ratio(c.cast("double"), F.greatest(a, b))


def sokal_sneath(c: Column, a: Column, b: Column) -> Column:
    return _ratio(c.cast("double"), 2 * (a + b) - 3 * c)


def mcconnaughey(c: Column, a: Column, b: Column) -> Column:
    return _one_empty(a, b, (c * (a + b) - a * b) / (a.cast("double") * b))


def johnson(c: Column, a: Column, b: Column) -> Column:
    """Product form over the summed sizes of the two graphs: common squared over the product of sizes."""
    return _ratio(c.cast("double") * c, a * b)


#: Measures that take a common size and the sizes of both sides.
MEASURES = {"jaccard": tanimoto, "dice": dice, "overlap": overlap, "cosine": cosine, "kulczynski": kulczynski, "braun_blanquet": braun_blanquet, "sokal_sneath": sokal_sneath, "mcconnaughey": mcconnaughey}


def graph_similarities(alpha: float = 1.0, beta: float = 1.0) -> dict[str, Column]:
    """Similarities of two graphs as columns, for ``withColumns``, from six counters: common_edges, common_vertices, and edges and vertices of either (first_edges, second_edges, first_vertices, second_vertices).

    Each measure counts edges or vertices; Tversky's weighs what only one graph has by ``alpha`` and ``beta``; johnson is over vertices and edges together.
    """
    out = {}
    for part in ("edge", "vertex"):
        many = "edges" if part == "edge" else "vertices"
        c, a, b = (F.col(f"{x}_{many}") for x in ("common", "first", "second"))
        out |= {f"{part}_{name}": f(c, a, b) for name, f in MEASURES.items()} | {f"{part}_tversky": tversky(c, a, b, alpha, beta)}
    total = [F.col(f"{x}_edges") + F.col(f"{x}_vertices") for x in ("common", "first", "second")]
    return out | {"johnson": johnson(*total)}
