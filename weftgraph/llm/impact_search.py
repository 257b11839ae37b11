"""Exact top-k inner products through an impact-ordered index, taken score at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.runtime import materialize, ship_package

#: Vectors of a shard: what a task indexes and searches at once.
SHARD = 8192
#: Steps to which each dimension's impacts are quantised.
STEPS = 64
#: Where a query's levels end, as shares of its mean impact.
BOUNDS = (2.5, 0.7, 0.4, 0.0)
_MET = 2.0**-20
#: Largest component, as an integer.
LARGEST = 1 << 26


def integer_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """(rid, vec_id, v): floor(scale * x) of vectors that are not null and hold finite components only; rid numbers the rows."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where(e.isNotNull() & finite)
    v = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    checked = F.when(F.forall("v", lambda x: F.abs(x) <= LARGEST), F.col("v").cast("array<int>")).otherwise(F.raise_error(F.lit(f"a component exceeds {LARGEST} after scaling")))
    return v.select(F.monotonically_increasing_id().alias("rid"), "vec_id", checked.alias("v"))


def _padded(lists: pa.Array, dims: int | None = None) -> np.ndarray:
    """A row for each list; components that a shorter one lacks are 0."""
    n = np.asarray(lists.value_lengths()).astype(np.int64)
    dims = max(int(n.max(initial=0)), 1) if dims is None else dims
    out = np.zeros((len(lists), dims), np.int64)
    row, at = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out[row, at] = lists.flatten().to_numpy()
    return out


class Shard:
    """Postings of a block of vectors: for each dimension its non-zero entries, those of the highest impact first.

    A posting is a row number; its impact, the component itself, stands in a parallel array and counts by its size, as a weight of
    either sign may meet it. Sizes are quantised to ``STEPS`` even steps a dimension, whose segments are found by number.
    """

    def __init__(self, rid: np.ndarray, ids: list, v: np.ndarray):
        self.rid, self.ids, self.v, self.float = rid, ids, v, v.astype(np.float64)
        n, d = v.shape
        row, dim = np.nonzero(v)
        order = np.lexsort((row, -np.abs(v[row, dim]), dim))
        self.row, self.impact = row[order], v[row, dim][order].astype(np.float64)
        first = np.searchsorted(dim[order], np.arange(d + 1))
        self.high, self.mean = np.abs(v).max(0, initial=0), np.abs(v).mean(0) if n else np.zeros(d)
        self.step = self.high // STEPS + 1
        self.ends = np.zeros((d, STEPS + 1), np.int64)  # where the postings of size i * step or more end
        for k in range(d):
            lo, hi = first[k : k + 2]
            self.ends[k] = lo + np.searchsorted(-np.abs(self.impact[lo:hi]), -self.step[k] * np.arange(STEPS + 1), "right")
        self.first = first[:-1]
        self.entries = np.count_nonzero(v, axis=1)
        #: order of rows by id, nulls last, for ties
        self.rank = np.empty(n, np.int64)
        self.rank[sorted(range(n), key=lambda i: (ids[i] is None, ids[i] or 0))] = np.arange(n)
        self.most = int(self.high.max(initial=0))
        self.rows, self.adds = np.empty(len(self.row), np.int64), np.empty(len(self.row))  # room for the postings of a level

    def best(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and scores of the k best rows but row id ``own``, best first, ties by id.

        Segments go in order of descending quantised impact, the size of q_d * v. After each level, every entry not yet met adds less than the
        level's bound, so a row scores at most what it has plus that bound for each entry left. The k-th best exact score among the
        leading rows is a threshold; rows that cannot reach it are out for good. Once scoring all that still can costs no more than
        the entries left, these rows are scored exactly.
        """
        n, dims = self.v.shape
        if n * len(q) == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self._wide(q):  # every row is a possible member
            return self._decide(np.arange(n), own, q, k)
        size = np.abs(q)
        live = np.flatnonzero(size * self.high)
        usual, weight = float(size @ self.mean) / dims, q.astype(np.float64)
        taken, left = self.first, int((self.ends[live, 0] - self.first[live]).sum())
        both = np.zeros(n)  # a row's sum so far, and 2^-20 for each entry met: exact, as sums stay below 2^32
        for level in BOUNDS:
            bound = max(int(usual * level), 1)
            least = -(-bound // np.maximum(size, 1))  # size of component that reaches the bound
            need = np.where(size > 0, self.ends[np.arange(dims), np.minimum(least // self.step, STEPS)], self.first)
            m = 0
            for d, lo, hi, w in zip(live.tolist(), taken[live].tolist(), need[live].tolist(), weight[live].tolist()):
                if lo < hi:
                    self.rows[m : m + hi - lo] = self.row[lo:hi]
                    np.multiply(self.impact[lo:hi], w, out=self.adds[m : m + hi - lo])
                    m += hi - lo
            taken = need
            if m:
                left -= m
                self.adds[:m] += _MET
                both += np.bincount(self.rows[:m], weights=self.adds[:m], minlength=n)
            acc = np.floor(both)
            lead = np.argpartition(acc, max(n - k - 1, 0))[max(n - k - 1, 0) :]
            exact = np.sort(self._scores(lead, q)[self.rid[lead] != own])[::-1]
            unmet = self.entries - (both - acc) * (1 / _MET)
            possible = np.flatnonzero(acc + unmet * (bound - 1) >= exact[k - 1]) if len(exact) >= k else np.arange(n)
            if len(possible) * dims <= left or level == 0:
                return self._decide(possible, own, q, k)
        raise AssertionError

    def _scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        return self.v[rows] @ q if self._wide(q) else (self.float[rows] @ q.astype(np.float64)).astype(np.int64)

    def _wide(self, q: np.ndarray) -> bool:
        """Whether scores might reach 2^32, beyond which sums and counts do not share a float64."""
        return self.most * int(np.abs(q).max(initial=0)) * len(q) >= 1 << 32

    def _decide(self, rows: np.ndarray, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        rows = rows[self.rid[rows] != own]
        score = self._scores(rows, q)
        order = np.lexsort((self.rank[rows], -score))[:k]
        return rows[order], score[order]


def top_products(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query row with every other row.

    ``is_query`` names the queries over vec_id. Rows are dealt evenly into shards of about ``SHARD``, whatever their ids; each shard is
    indexed by a task, which then takes the queries one by one. The k best of each shard meet by query. Ties go to the
    smaller vec_id, null ids last. Vectors null or holding null or non-finite components take no part, neither as query nor as
    candidate; a shorter vector counts as 0 in what it lacks, and an empty one scores 0. Repeated rows are candidates, and queries, of their own;
    fewer than k candidates are all returned; an empty table gives no rows; other columns are ignored. A component beyond 2^26 after scaling is an error.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    kept = materialize(integer_vectors(vectors, scale), "vectors")
    shards = max(1, -(-kept.count() // SHARD))
    rows = kept.select(F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("query"), "rid", "vec_id", "v")
    asked = kept.where(is_query).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("query"), "rid", "vec_id", "v")
    dealt = rows.union(asked).repartitionByRange(shards, "shard").sortWithinPartitions("shard", "query")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, shard = None, [], None
        for b in it:
            number, query = b.column("shard").to_numpy(), b.column("query").to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((number[1:] != number[:-1]) | (query[1:] != query[:-1])) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows]):
                if lo == hi:
                    continue
                part = b.slice(lo, hi - lo)
                if number[lo] != at:
                    at, parts, shard = number[lo], [], None
                if not query[lo]:
                    parts.append(part)
                    continue
                if shard is None and parts:
                    t = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
                    shard = Shard(t.column("rid").to_numpy(), t.column("vec_id").to_pylist(), _padded(t.column("v")))
                    parts = []
                if shard is not None:
                    yield _answers(shard, part, k)

    found = dealt.mapInArrow(run, "query_row long, query_id long, vec_id long, score long")
    w = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _answers(shard: Shard, b: pa.RecordBatch, k: int) -> pa.RecordBatch:
    dims = shard.v.shape[1]
    asked = _padded(b.column("v"), max(dims, int(np.asarray(b.column("v").value_lengths()).max(initial=0))))[:, :dims]  # what no row has adds nothing
    rid, ids = b.column("rid").to_numpy(), b.column("vec_id").to_pylist()
    rows, names, found, scores = [], [], [], []
    for i, q in enumerate(asked):
        r, s = shard.best(int(rid[i]), q, k)
        rows += [rid[i]] * len(r)
        names += [ids[i]] * len(r)
        found += [shard.ids[x] for x in r.tolist()]
        scores += s.tolist()
    kinds = [pa.array(x, pa.int64()) for x in (rows, names, found, scores)]
    return pa.RecordBatch.from_arrays(kinds, ["query_row", "query_id", "vec_id", "score"])
