"""Near-duplicate documents: HyperMinHash registers, banded, estimated, verified on full sets, joined into components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import kernels as K
from weftgraph.llm.common import bitmap, group_starts, map_batches, map_groups, marked
from weftgraph.llm.paragraph_dedup import prefix_links
from weftgraph.operators.components import star_components
from weftgraph.runtime import materialize

BUCKETS, MANTISSA, BAND = 128, 10, 4
_BITS = 57  # of a hash below its 7 bucket bits
#: Shingles of a bucket that one task holds, twice at most; larger mixed buckets are compared chunk against chunk.
CHUNK = 1 << 21
#: Sets that a task holds of a bucket, likewise.
CHUNK_ROWS = 4096
#: Sets of up to so many shingles are told apart by their rarest shingles: few registers agree too easily.
SMALL = 64
#: A member with more likely partners than this counts its common shingles with all of them through one sorted list.
FEW = 16


def _probes() -> np.ndarray:
    """Where an empty register looks for a value: the same sequence of places in every document."""
    return np.random.default_rng(97).integers(0, BUCKETS, (400, BUCKETS))


_PROBES = _probes()


def registers(s: np.ndarray) -> np.ndarray:
    """One register for each bucket: 1 + (leading zeros, mantissa bits) of its smallest hash; 0 if empty."""
    x = np.sort(K.mix64(s ^ K.U64(0x5851F42D4C957F2D)))
    at = np.searchsorted(x, np.arange(BUCKETS, dtype=np.uint64) << K.U64(_BITS))
    ends = np.append(at[1:], len(x))
    out = np.zeros(BUCKETS, np.uint16)
    full = ends > at
    low = (x[at[full]] & K.U64((1 << _BITS) - 1)).astype(np.float64)
    part, exp = np.frexp(low)
    mantissa = np.maximum((2 * part - 1) * (1 << MANTISSA), 0).astype(np.int64)
    out[full] = 1 + np.minimum(((_BITS - exp) << MANTISSA) + np.minimum(mantissa, (1 << MANTISSA) - 1), 65534)
    return out


def band_keys(reg: np.ndarray) -> np.ndarray:
    """64-bit key of each band of registers. Empty registers first borrow a filled one's value (densification),

    so that a band of a short text is as selective as that of a long one.
    """
    d = reg.astype(np.uint64)
    empty = np.flatnonzero(reg == 0)
    for t in range(len(_PROBES)):
        if not len(empty):
            break
        src = _PROBES[t, empty]
        got = reg[src] > 0
        d[empty[got]] = reg[src[got]] | (src[got].astype(np.uint64) << K.U64(16)) | K.U64(1 << 24)
        empty = empty[~got]
    d = d.reshape(-1, BAND)
    key = np.arange(len(d), dtype=np.uint64) + K.U64(1)
    for i in range(BAND):
        key = K.mix64(key * K.U64(0xE7037ED1A0B428DB) + d[:, i])
    return key


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Jaccard estimate corrected for chance collisions, registers used), over the last axis."""
    either = ((a > 0) | (b > 0)).sum(axis=-1)
    same = ((a == b) & (a > 0)).sum(axis=-1)
    phi = 4.0 * na * nb / np.maximum((na + nb) * 1.0, 1) ** 2
    chance = 0.169919487159739093975315012348 * BUCKETS / (1 << MANTISSA) * phi
    return np.clip((same - chance) / np.maximum(either, 1), 0, 1), either


def _plausible(est: np.ndarray, used: np.ndarray, t: float) -> np.ndarray:
    """Whether a pair of similarity t could show such an estimate: five standard deviations of room."""
    return est >= t - 5 * np.sqrt(t * (1 - t) / np.maximum(used, 1))


def _digest(s: np.ndarray) -> tuple[int, int]:
    if not len(s):
        return 0, 0
    return tuple(int(K.mix64(s * K.U64(c)).sum(dtype=np.uint64).astype(np.int64)) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, d1, d2, reg): set size, 128-bit digest of the set, registers."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        data, off = K.text_bytes(b.column(1))
        h, _, _, first = K.words(data, off)
        n, d, reg = [], [], []
        for i in range(b.num_rows):
            s = K.shingle_set(h[first[i] : first[i + 1]], k)
            n.append(len(s)), d.append(_digest(s)), reg.append(registers(s).tobytes())
        cols = [b.column(0), pa.array(n, pa.int64()), pa.array([x[0] for x in d], pa.int64()), pa.array([x[1] for x in d], pa.int64()), pa.array(reg, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "d1", "d2", "reg"])

    return map_batches(rows, fn, "doc_id long, n long, d1 long, d2 long, reg binary")


def _bands(reps: DataFrame) -> DataFrame:
    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        keys = [band_keys(np.frombuffer(r, np.uint16)).astype(np.int64) for r in b.column(1).to_pylist()]
        per = BUCKETS // BAND
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(b.column(0).to_numpy(), per))], ["key", "id"])

    return map_batches(reps.select("id", "reg"), fn, "key long, id long")


def _likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and registers allow the similarity."""
    side = lambda p: reps.select(F.col("id").alias(p), F.col("n").alias(f"n{p}"), F.col("reg").alias(f"r{p}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    both = both.select("a", "b", "na", "nb", "ra", "rb")

    def fn(x: pa.RecordBatch) -> pa.RecordBatch:
        ra, rb = (np.frombuffer(b"".join(x.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("ra", "rb"))
        est, used = estimate(ra, rb, x.column("na").to_numpy(), x.column("nb").to_numpy())
        return x.select(["a", "b"]).filter(pa.array(_plausible(est, used, percent / 100)))

    return map_batches(both, fn, "a long, b long")


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, set) for the given ids; the set is its sorted 64-bit shingle hashes. Texts of other ids are not shuffled."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null").withColumn("h", F.xxhash64("id"))
    bits = bitmap(ids.select(F.xxhash64("id").alias("h")))

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        b = b.filter(pa.array(marked(bits.value, b.column(2).to_numpy(zero_copy_only=False))))
        data, off = K.text_bytes(b.column(1))
        h, _, _, first = K.words(data, off)
        s = [K.shingle_set(h[first[i] : first[i + 1]], k).tobytes() for i in range(b.num_rows)]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.binary())], ["id", "set"])

    return map_batches(rows, fn, "id long, set binary").join(ids, "id", "left_semi")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b").select("a", "b", "sa", "sb")

    def fn(x: pa.RecordBatch) -> pa.RecordBatch:
        ok = []
        for p, q in zip(x.column("sa"), x.column("sb")):
            p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
            both_n = K.overlap(p, q)
            ok.append(100 * both_n >= percent * (len(p) + len(q) - both_n))
        return x.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return map_batches(both, fn, "a long, b long").distinct()


def join_group(comp: np.ndarray, n: np.ndarray, reg: np.ndarray, sets: list[np.ndarray], chunk: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """(row, row) of links that join the components of a group: all of a spanning forest's, whatever their number.

    Each pair of rows of different components whose sizes and registers allow the similarity is decided on
    the full sets, the likeliest first. Components merge on the way, which spares the pairs inside. Of two chunks only
    pairs across are looked at.
    """
    comp = np.unique(comp, return_inverse=True)[1]
    large = comp == np.bincount(comp).argmax()
    across = chunk.min() < chunk.max()
    place = np.arange(len(comp))
    flat = None
    out = []
    for r in np.flatnonzero(~large):
        o = (large | (place > r)) & (comp != comp[r]) & (np.minimum(n, n[r]) * 100 >= np.maximum(n, n[r]) * percent)
        if across:
            o &= chunk != chunk[r]
        o = np.flatnonzero(o)
        if not len(o):
            continue
        est, used = estimate(reg[r][None], reg[o], n[r], n[o])
        good = _plausible(est, used, percent / 100)
        o, est = o[good], est[good]
        o = o[np.argsort(-est, kind="stable")]
        both = None
        if len(o) > FEW:
            if flat is None:
                size = np.array([len(x) for x in sets])
                flat = np.concatenate(sets)
                order = np.argsort(flat, kind="stable")
                flat, owner = flat[order], np.repeat(place, size)[order]
            lo, hi = np.searchsorted(flat, sets[r], "left"), np.searchsorted(flat, sets[r], "right")
            k = hi - lo
            both = np.bincount(owner[np.repeat(lo - (np.cumsum(k) - k), k) + np.arange(k.sum())], minlength=len(comp))
            o = o[100 * both[o] >= percent * (n[r] + n[o] - both[o])]
        for i in o.tolist():
            if comp[i] == comp[r]:
                continue
            if both is None:
                c = K.overlap(sets[r], sets[i])
                if 100 * c < percent * (n[r] + n[i] - c):
                    continue
            out.append((int(r), i))
            comp[comp == comp[i]] = comp[r]
    return out


def _joined(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): components that links within a bucket join.

    ``members(key, id, comp, n, reg, set, mass, rows)`` of buckets that hold several components; ``mass``, ``rows``: shingles
    and sets of the bucket. Buckets beyond CHUNK or CHUNK_ROWS are cut into chunks, and a task holds two of them. No pair is
    listed: a group returns fewer rows than it has components.
    """
    chunks = F.greatest(F.ceil(F.col("mass") / CHUNK), F.ceil(F.col("rows") / CHUNK_ROWS)).cast("int")
    m = members.withColumn("chunks", chunks).withColumn("c", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    m = m.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    m = m.select("key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "comp", "n", "reg", "set")

    def fn(t: pa.Table) -> pa.RecordBatch:
        comp, n, c = (t.column(x).to_numpy() for x in ("comp", "n", "c"))
        reg = np.frombuffer(b"".join(t.column("reg").to_pylist()), np.uint16).reshape(-1, BUCKETS)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("set")]
        first = group_starts(t, ["key", "i", "j"])
        a, b = [], []
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
            if comp[lo:hi].min() < comp[lo:hi].max():
                for p, q in join_group(comp[lo:hi], n[lo:hi], reg[lo:hi], sets[lo:hi], c[lo:hi], percent):
                    a.append(min(comp[lo + p], comp[lo + q])), b.append(max(comp[lo + p], comp[lo + q]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return map_groups(m, ["key", "i", "j"], fn, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row.

    Documents are linked if 100 * intersection >= percent * union of their distinct k-word shingles
    (words between ASCII white space, A-Z lowered; fewer than k words: the whole sequence as one).
    component_id is the smallest doc_id reachable. Null, empty and blank texts link with nothing.
    A null id gets a null component and is kept. Repeated rows get equal results.

    Equal sets collapse to their smallest id first. Band buckets then link each member to the
    bucket's smallest id; links that hold on the full sets form components. Of buckets that still hold several
    components, all pairs of members of different components are looked at within a task (see ``join_group``), so no link of a
    bucket that would join two components is missed, and no pairs are listed. Small sets have few different registers, so that one
    common phrase fills a bucket: members of at most SMALL shingles, and those that may link with one, meet by their rarest
    shingles instead (``prefix_links``), which misses none either. Sets too small to be that similar to any other are not banded.
    """
    sig = materialize(signatures(docs, k), "sig")
    live = sig.where("n > 0 and doc_id is not null")
    reps = materialize(live.groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("reg").alias("reg")), "reps")
    bands = _bands(reps.where(F.col("n") * 100 >= (F.col("n") + 1) * percent))  # a different set of n shared shingles has n + 1
    buckets = bands.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("size")).where("size > 1")
    shared = materialize(bands.join(buckets, "key"), "bands")
    # the registers of pairs are looked at once, whatever number of bands they share
    pairs = shared.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    likely = materialize(_likely(pairs, reps, percent), "likely")
    crowded = shared.where("size > 2").select("id")
    ids = likely.select(F.col("a").alias("id")).union(likely.select(F.col("b").alias("id"))).union(crowded).distinct()
    sets = materialize(_sets(docs, ids, k).dropDuplicates(["id"]), "sets")
    links = materialize(_verified(likely, sets, percent), "links")
    comp = star_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    # members of one bucket that are still apart: every likely pair of different components is decided once and for all
    comp = materialize(comp, "hub-components")
    placed = shared.where("size > 2").join(reps.select("id", "n", "reg"), "id").join(comp, "id", "left").withColumn("comp", F.coalesce("component", "id"))
    small = F.col("n") * percent <= SMALL * 100
    apart = lambda rows: rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum("n").alias("mass"), F.count("*").alias("rows")).where("lo < hi").select("key", "mass", "rows")
    big = placed.where(F.col("n") > SMALL)
    members = big.join(apart(big), "key").select("key", "id", "comp", "n", "reg", "mass", "rows").join(sets, "id")
    short = placed.where(small)
    short = short.join(apart(short).select("key"), "key", "left_semi").select(F.col("id").alias("digest"), "comp").distinct().join(sets.withColumnRenamed("id", "digest"), "digest")
    joined = _joined(members, percent).union(prefix_links(materialize(short, "short"), percent / 100))
    wide = star_components(joined.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("id").alias("component"), F.col("component").alias("wide"))
    # a component of one document has no row in comp yet
    alone = wide.join(comp.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("id"), "component")
    comp = materialize(comp.union(alone).join(wide, "component", "left").select("id", F.coalesce("wide", "component").alias("component")), "components")
    named = reps.select("d1", "d2", "id").join(comp, "id", "left").select("d1", "d2", F.coalesce("component", "id").alias("component_id"))
    found = live.join(named, ["d1", "d2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    alone = sig.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return found.union(alone)


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of each component's smallest id, with all their columns; rows that repeat that id and text stay once.

    Rows without an id or without words have no group and stay.
    """
    gone = near_duplicates(docs, k, percent).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    left = docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")
    twice = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__twice"))
    if twice.isEmpty():
        return left
    again = left.join(twice, left["doc_id"] == twice["__twice"], "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(twice, left["doc_id"] == twice["__twice"], "left_anti").union(again)
