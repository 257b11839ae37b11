"""Lloyd rounds over integer vectors: float32 products shortlist centroids, exact integers decide."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.runtime import materialize, ship_package

#: Largest component, as an integer: squared distances of 64 of them then fit a long.
LARGEST = 1 << 27
#: Half the gap between 1 and the next float32.
_UNIT = 2.0**-24
#: Rows of a block of products.
ROWS = 4096


def integer_vectors(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, v) of vectors with exactly ``dims`` components, all finite: v is floor(scale * x), as longs."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform(e, lambda x: F.floor(x.cast("double") * scale))
    small = F.forall("v", lambda x: F.abs(x) <= LARGEST)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where(e.isNotNull() & (F.size(e) == dims) & finite).select("vec_id", v.alias("v"))
    return rows.select("vec_id", F.when(small, F.col("v")).otherwise(F.raise_error(F.lit(f"a component exceeds {LARGEST} after scaling"))).alias("v"))


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Number of the nearest of the centroids c to each row of x (both int64); ties: the smaller number.

    |x - c|^2 less |x|^2 is |c|^2 - 2 x.c. The float32 product of n terms errs by at most g |x| |c|, g = m u / (1 - m u) with
    m = n + 2: n roundings in any order of summing and one for each factor that is no float32. Every centroid whose interval reaches the
    lowest upper end is a possible winner; rows with more than one are decided by exact integer distances to these.
    """
    m = (x.shape[1] + 2) * _UNIT
    p = (x.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    xf, cf = x.astype(np.float64), c.astype(np.float64)
    square = (cf * cf).sum(1)
    # the factor above 1 covers the float64 roundings of norms, squares and the sums below
    err = 2 * (m / (1 - m)) * np.sqrt((xf * xf).sum(1))[:, None] * np.sqrt(square)[None, :] * (1 + 1e-9) + (square[None, :] + 2 * np.abs(p)) * 1e-12 + 1e-6
    mid = square[None, :] - 2 * p
    possible = mid - err <= (mid + err).min(1)[:, None]
    best = possible.argmax(1)
    row, k = np.nonzero(possible & (possible.sum(1) > 1)[:, None])
    for i in range(0, len(row), 1 << 16):  # pairs of a row that a cut parts are compared again with its best so far
        r, q = row[i : i + (1 << 16)], k[i : i + (1 << 16)]
        if i and r[0] == row[i - 1]:
            r, q = np.append(r[0], r), np.append(best[r[0]], q)
        d = ((x[r] - c[q]) ** 2).sum(1)
        order = np.lexsort((q, d, r))
        r, q = r[order], q[order]
        head = np.append(True, r[1:] != r[:-1])
        best[r[head]] = q[head]
    return best


def _matrix(b: pa.RecordBatch, dims: int) -> np.ndarray:
    return b.column(1).flatten().to_numpy().astype(np.int64).reshape(-1, dims)


def _sums(kept: DataFrame, c: np.ndarray) -> DataFrame:
    """(cluster, n, s): each task's vectors and their sum, by nearest centroid; at most one row a centroid and batch of 2^20 rows."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)

        def rows() -> pa.RecordBatch:
            k = np.flatnonzero(n)
            return pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(n[k]), pa.array(list(s[k]), pa.list_(pa.int64()))], ["cluster", "n", "s"])

        for b in it:
            for i in range(0, b.num_rows, ROWS):
                x = _matrix(b.slice(i, ROWS), c.shape[1])
                near = nearest(x, c)
                n += np.bincount(near, minlength=len(c))
                order = np.argsort(near, kind="stable")
                groups, first = np.unique(near[order], return_index=True)
                s[groups] += np.add.reduceat(x[order], first, axis=0)
            if n.sum() >= 1 << 30:  # 2^30 components of 2^27 are far from a long's end
                yield rows()
                n[:], s[:] = 0, 0
        if n.any():
            yield rows()

    return kept.mapInArrow(run, "cluster int, n long, s array<long>")


def _moved(kept: DataFrame, c: np.ndarray) -> np.ndarray:
    """The centroids after a round: exact floor(sum / count) where a cluster has vectors. k * dims numbers reach the driver."""
    parts = _sums(kept, c).select("cluster", "n", F.posexplode("s").alias("i", "s"))
    wide = lambda x: F.sum(F.col(x).cast("decimal(38,0)")).alias(x)
    out = c.copy()
    for r in parts.groupBy("cluster", "i").agg(wide("n"), wide("s")).collect():
        out[r["cluster"], r["i"]] = int(r["s"]) // int(r["n"])
    return out


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2:") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row for each kept vector.

    Vectors null, of another length, or holding null or non-finite components are left out. Starts are the k vectors with the smallest
    sha256 of ``salt`` and id (a null id counts as no digits; repeated ids in the order of their vectors). Fewer vectors give
    fewer centroids, none gives no rows. Repeated rows are vectors of their own, other columns are ignored. A component beyond 2^27 after
    scaling is an error, since its distances may not fit a long.
    A round is one job over a written table; only k sums and counts leave the tasks' own clusters.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    kept = materialize(integer_vectors(vectors, dims, scale), "vectors")
    hashed = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    start = kept.orderBy(hashed, "v").limit(k).collect()
    c = np.array([r["v"] for r in start], np.int64).reshape(-1, dims)
    for _ in range(rounds if len(c) else 0):
        c = _moved(kept, c)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for i in range(0, whole.num_rows, ROWS):
                b = whole.slice(i, ROWS)
                x = _matrix(b, dims)
                near = nearest(x, c)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(near.astype(np.int32)), pa.array(((x - c[near]) ** 2).sum(1))], ["vec_id", "cluster", "distance"])

    placed = materialize(kept.mapInArrow(run, "vec_id long, cluster int, distance long"), "placed")
    names = [(i, hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest()) for i, row in enumerate(c)]
    own = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()  # a row a centroid
    total = sum(int(r["d"]) for r in own)
    facts = [(r["cluster"], int(r["d"]), total, dict(names)[r["cluster"]]) for r in own]
    told = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
