"""Repeated passages: paragraphs cut by content, MinHash banding, exact verification, removals by component."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.llm import kernels as K
from weftgraph.llm.common import bitmap, group_starts, map_batches, map_groups, marked
from weftgraph.operators.components import star_components
from weftgraph.runtime import materialize

#: Words on either side that a cut must be smallest among: paragraphs have at least one word more.
REACH = 6
#: Unlinked paragraphs that a passage may run across: an edit spoils one, or two if it moves a cut.
BRIDGE = 2
#: Words after which a paragraph without a cut ends.
LONGEST = 64
#: Paragraphs of one group that a chunk holds; a task compares two chunks at a time.
CHUNK = 1000
#: Groups of up to so many paragraphs are compared together, pair by pair.
SMALL = 48
#: Paragraphs whose shingles are counted to put them in order; no result depends on it.
ORDER_SAMPLE = 50_000


def tune(similarity: float, recall: float, most_bands: int) -> tuple[int, int]:
    """(bands, rows): the most rows a band may have for bands <= most_bands to reach the recall at the similarity."""
    best = None
    for rows in range(1, 17):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)) if similarity < 1 else 1
        if bands <= most_bands:
            best = bands, rows
    if best is None:
        raise ValueError("no banding of that size reaches the recall")
    return best


def cuts(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """First word of each paragraph. A word starts one if its hash is the smallest within REACH words.

    Where a text is cut depends only on the words nearby, so a passage is cut alike wherever it stands,
    also amid a line.
    """
    n = len(h)
    mark = np.zeros(n, bool)
    if n:
        g = K.mix64(h + K.U64(0x51ED270B27B4F3CF))
        mark[:] = True
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for d in range(1, min(REACH, n - 1) + 1):
            other = row[d:] != row[:-d]
            mark[d:] &= other | (g[d:] < g[:-d])
            mark[:-d] &= other | (g[:-d] <= g[d:])
        heads = first[:-1][first[:-1] < first[1:]]
        mark[heads] = True
    start = np.flatnonzero(mark)
    size = np.diff(np.append(start, n))
    long = np.flatnonzero(size > LONGEST)
    if len(long):
        extra = np.concatenate([np.arange(start[i] + LONGEST, start[i] + size[i], LONGEST) for i in long])
        start = np.sort(np.concatenate([start, extra]))
    return start


def paragraphs(docs: DataFrame, k: int, bands: int, rows: int, with_set: bool = False, bits: Broadcast | None = None) -> DataFrame:
    """(doc_id, no, at, start, end, words, digest, k0.. or set) of every paragraph; ``at``: its first word, then byte positions in the text.

    ``digest`` stands for the paragraph's word sequence. ``bits``: map of the digests to keep.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    mul, add = K.hash_family(bands * rows, 41)

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        data, off = K.text_bytes(b.column(1))
        h, ws, we, first = K.words(data, off)
        start = cuts(h, first)
        end = np.append(start[1:], len(h))
        if not len(start):
            end = start
        owner = np.searchsorted(first, start, "right") - 1
        size = end - start
        # one order-sensitive hash for each paragraph, from its words
        inside = np.arange(len(h)) - np.repeat(start, size)
        part = K.mix64(h * K.U64(0x9E3779B97F4A7C15) + inside.astype(np.uint64))
        digest = K.mix64(np.add.reduceat(part, start) + size.astype(np.uint64)) if len(start) else h
        # shingles: each word's k-gram where the paragraph still has k words, else the whole sequence
        g = h.copy()
        for j in range(1, k):
            g[: len(h) - j] = K.mix64(g[: len(h) - j] * K.U64(0xD6E8FEB86659FD93) + h[j:])
        ok = inside <= np.repeat(size, size) - k
        ok[start[size < k]] = True
        g[start[size < k]] = digest[size < k]
        keys = np.zeros((len(start), bands), np.uint64)
        for i in range(bands):
            keys[:, i] = i + 1
            for r in range(rows):
                x = np.where(ok, (g ^ add[i * rows + r]) * mul[i * rows + r], np.iinfo(np.uint64).max)
                low = np.minimum.reduceat(x, start) if len(start) else x[:0]
                keys[:, i] = K.mix64(keys[:, i] * K.U64(0xE7037ED1A0B428DB) + low)
        no = np.arange(len(start)) - np.searchsorted(owner, owner)
        ids = b.column(0).take(pa.array(owner))
        base = off[owner]
        cols = [ids, pa.array(no.astype(np.int32)), pa.array((start - first[owner]).astype(np.int32)), pa.array(ws[start] - base), pa.array((we[end - 1] if len(end) else end) - base), pa.array(size.astype(np.int32)), pa.array(digest.view(np.int64))]
        names = ["doc_id", "no", "at", "start", "end", "words", "digest"]
        if with_set:
            keep = np.flatnonzero(marked(bits.value, digest)) if bits is not None else np.arange(len(start))
            cols = [c.take(pa.array(keep)) for c in cols]
            cols.append(pa.array([np.unique(g[start[i] : end[i]][ok[start[i] : end[i]]]).tobytes() for i in keep.tolist()], pa.binary()))
            names.append("set")
        else:
            cols += [pa.array(keys[:, i].view(np.int64)) for i in range(bands)]
            names += [f"k{i}" for i in range(bands)]
        return pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, no int, at int, start long, end long, words int, digest long, " + ("set binary" if with_set else ", ".join(f"k{i} long" for i in range(bands)))
    return map_batches(docs, fn, schema)


def _place_hash(doc_id: np.ndarray, no: np.ndarray) -> np.ndarray:
    return K.mix64(doc_id.astype(np.int64).view(np.uint64) * K.U64(0x9E3779B97F4A7C15) + no.astype(np.uint64))


def contexts(docs: DataFrame, places: DataFrame, reach: int) -> DataFrame:
    """(doc_id, no, before, after) of paragraphs places(doc_id, no): up to ``reach`` words on both sides, nearest first.

    A word is a 32-bit hash and the bytes from the paragraph's edge to its far end.
    """

    def hashed(b: pa.RecordBatch) -> pa.RecordBatch:
        h = _place_hash(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False))
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    bits = bitmap(map_batches(places.select("doc_id", "no"), hashed, "h long"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        data, off = K.text_bytes(b.column(1))
        h, ws, we, first = K.words(data, off)
        start = cuts(h, first)
        owner = np.searchsorted(first, start, "right") - 1
        no = np.arange(len(start)) - np.searchsorted(owner, owner)
        keep = np.flatnonzero(marked(bits.value, _place_hash(b.column(0).to_numpy()[owner], no)))
        low, end = h.astype(np.uint32), np.append(start[1:], len(h))
        before, after = [], []
        for i in keep.tolist():
            x = slice(max(first[owner[i]], start[i] - reach), start[i])
            before.append(np.stack([low[x][::-1], (ws[start[i]] - ws[x])[::-1].astype(np.uint32)]).tobytes())
            x = slice(end[i], min(first[owner[i] + 1], end[i] + reach))
            after.append(np.stack([low[x], (we[x] - we[end[i] - 1]).astype(np.uint32)]).tobytes())
        cols = [b.column(0).take(pa.array(owner[keep])), pa.array(no[keep].astype(np.int32)), pa.array(before, pa.binary()), pa.array(after, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "no", "before", "after"])

    near = map_batches(docs, fn, "doc_id long, no int, before binary, after binary")
    out = materialize(near.join(places.select("doc_id", "no").distinct(), ["doc_id", "no"]).dropDuplicates(["doc_id", "no"]), "contexts")
    bits.destroy()
    return out


def extended(docs: DataFrame, spans: DataFrame, occurs: DataFrame, reach: int) -> DataFrame:
    """``spans`` grown word by word on both sides, as far as an occurrence of the edge paragraph's class in another document agrees.

    The words around each edge are held against those around the class's first and last occurrence, of which one at least
    is another document's. An edge grows by ``reach`` words at most.
    """
    sides = F.explode(F.array(F.struct(F.lit("l").alias("side"), F.col("class_id").alias("c"), F.col("no").alias("no")), F.struct(F.lit("r").alias("side"), F.col("last_class").alias("c"), F.col("last_no").alias("no"))))
    edges = materialize(spans.select("doc_id", "run", sides.alias("e")).select("doc_id", "run", "e.side", "e.c", "e.no"), "edges")
    ends = occurs.join(edges.select(F.col("c").alias("class_id")).distinct(), "class_id", "left_semi").groupBy("class_id").agg(F.min(F.struct("doc_id", "no")).alias("lo"), F.max(F.struct("doc_id", "no")).alias("hi"))
    partners = materialize(ends.select(F.col("class_id").alias("c"), F.explode(F.array("lo", "hi")).alias("p")).select("c", "p.doc_id", "p.no"), "partners")
    around = contexts(docs, edges.select("doc_id", "no").union(partners.select("doc_id", "no")), reach)
    theirs = partners.join(around, ["doc_id", "no"]).select("c", F.col("doc_id").alias("other"), F.col("before").alias("their_before"), F.col("after").alias("their_after"))
    both = edges.join(around, ["doc_id", "no"]).join(theirs, "c").where("doc_id <> other")
    left = F.col("side") == "l"
    both = both.select("doc_id", "run", "side", F.when(left, F.col("before")).otherwise(F.col("after")).alias("mine"), F.when(left, F.col("their_before")).otherwise(F.col("their_after")).alias("theirs"))

    def agree(b: pa.RecordBatch) -> pa.RecordBatch:
        words, size = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.int64)
        for i, (x, y) in enumerate(zip(b.column(3), b.column(4))):
            (x, far), y = np.frombuffer(x.as_buffer(), np.uint32).reshape(2, -1), np.frombuffer(y.as_buffer(), np.uint32).reshape(2, -1)[0]
            n = min(len(x), len(y))
            differ = np.flatnonzero(x[:n] != y[:n])
            words[i] = differ[0] if len(differ) else n
            size[i] = far[words[i] - 1] if words[i] else 0
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(words), pa.array(size)], ["doc_id", "run", "side", "words", "size"])

    grown = map_batches(both, agree, "doc_id long, run long, side string, words int, size long").groupBy("doc_id", "run").agg(
        *[F.coalesce(F.max(F.when(F.col("side") == x, F.col(c))), F.lit(0)).alias(f"{c}_{x}") for x in "lr" for c in ("words", "size")]
    )
    out = spans.join(grown, ["doc_id", "run"], "left").na.fill(0, ["words_l", "words_r", "size_l", "size_r"])
    return out.withColumn("start", F.col("start") - F.col("size_l")).withColumn("end", F.col("end") + F.col("size_r")).withColumn("n_words", F.col("n_words") + F.col("words_l") + F.col("words_r")).select(*spans.columns)


def screened(df: DataFrame, column: str, bits: Broadcast) -> DataFrame:
    """Rows whose hash the map marks: all that an exact join would keep, and few others, without a shuffle."""
    at = df.columns.index(column)

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array(marked(bits.value, b.column(at).to_numpy(zero_copy_only=False))))

    return map_batches(df, fn, df.schema)


def _rarest(flat: np.ndarray, size: np.ndarray, similarity: float, common: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Positions in ``flat`` of each set's n - ceil(similarity * n) + 1 rarest shingles.

    Two sets of that Jaccard similarity share ceil(similarity * n) of either's shingles, so one at least of these,
    whatever the order is, as long as it is the same for all: ``times`` only keeps the groups small.
    """
    row = np.repeat(np.arange(len(size)), size)
    count = np.zeros(len(flat), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, flat), len(common) - 1)
        count = np.where(common[at] == flat, times[at], 0)
    order = np.lexsort((flat, count, row))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    return order[place <= np.repeat(size - np.ceil(similarity * size - 1e-9).astype(np.int64), size)]


def _small_groups(first: np.ndarray, comp: np.ndarray, chunk: np.ndarray, flat: np.ndarray, size: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """(row, row) of all linked pairs of different components within groups; ``first``: start of each group + total."""
    n = len(size)
    last = np.repeat(first[1:], np.diff(first))
    many = last - np.arange(n) - 1
    p = np.repeat(np.arange(n), many)
    q = p + 1 + np.arange(len(p)) - np.repeat(np.cumsum(many) - many, many)
    group = np.repeat(np.arange(len(first) - 1), np.diff(first))
    lo, hi = np.full(len(first) - 1, np.iinfo(np.int32).max), np.zeros(len(first) - 1, np.int64)
    np.minimum.at(lo, group, chunk), np.maximum.at(hi, group, chunk)
    across = (lo < hi)[group]
    a, b = np.where(size[p] <= size[q], p, q), np.where(size[p] <= size[q], q, p)
    ok = (comp[a] != comp[b]) & (size[a] >= similarity * size[b] - 1e-9) & (~across[a] | (chunk[a] != chunk[b]))
    a, b = a[ok], b[ok]
    if not len(a):
        return []
    names, number = np.unique(flat, return_inverse=True)
    start = np.cumsum(size) - size
    held = np.repeat(np.arange(n), size) * len(names) + number
    out = []
    for i in range(0, len(a), 100_000):
        x, y = a[i : i + 100_000], b[i : i + 100_000]
        k = size[x]
        owner = np.repeat(np.arange(len(x)), k)
        want = y[owner] * len(names) + number[start[x][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(k) - k, k)]
        at = np.minimum(np.searchsorted(held, want), len(held) - 1)
        both = np.bincount(owner[held[at] == want], minlength=len(x))
        good = both >= similarity * (size[x] + size[y] - both) - 1e-9
        out += zip(x[good].tolist(), y[good].tolist())
    return out


def _large_group(comp: np.ndarray, chunk: np.ndarray, flat: np.ndarray, size: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """(row, row) of linked pairs that join the components of a group. Components merge on the way, which spares the pairs inside."""
    comp = np.unique(comp, return_inverse=True)[1]
    across = chunk.min() < chunk.max()
    start = np.cumsum(size) - size
    order = np.argsort(flat, kind="stable")
    sorted_flat, owner = flat[order], np.repeat(np.arange(len(size)), size)[order]
    out = []
    for r in range(len(size)):
        x = flat[start[r] : start[r] + size[r]]
        lo, hi = np.searchsorted(sorted_flat, x, "left"), np.searchsorted(sorted_flat, x, "right")
        k = hi - lo
        both = np.bincount(owner[np.repeat(lo - (np.cumsum(k) - k), k) + np.arange(k.sum())], minlength=len(size))
        near = (both >= similarity * (size + size[r] - both) - 1e-9) & (comp != comp[r])
        if across:
            near &= chunk != chunk[r]
        for o in np.flatnonzero(near):
            if comp[o] != comp[r]:
                out.append((r, int(o)))
                comp[comp == comp[o]] = comp[r]
    return out


def _links(t: pa.Table, similarity: float) -> pa.RecordBatch:
    """Linked components (a, b) from rows (token, i, j, c, comp, set) of whole groups (token, i, j)."""
    c, comp = (t.column(n).to_numpy() for n in ("c", "comp"))
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("set")]
    first = group_starts(t, ["token", "i", "j"])
    count = np.diff(first)
    size = np.array([len(x) for x in sets], np.int64)
    pairs = []
    for lo, hi in zip(first[:-1][count > SMALL], first[1:][count > SMALL]):
        pairs += [(lo + p, lo + q) for p, q in _large_group(comp[lo:hi], c[lo:hi], np.concatenate(sets[lo:hi]), size[lo:hi], similarity)]
    rows = np.flatnonzero(np.repeat((count > 1) & (count <= SMALL), count))
    if len(rows):
        cut = np.append(0, np.cumsum(count[(count > 1) & (count <= SMALL)]))
        got = _small_groups(cut, comp[rows], c[rows], np.concatenate([sets[r] for r in rows]), size[rows], similarity)
        pairs += [(rows[p], rows[q]) for p, q in got]
    a, b = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(comp[a], comp[b])), pa.array(np.maximum(comp[a], comp[b]))], ["a", "b"])


def _common(members: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, counts) that occur more than twice in about ORDER_SAMPLE of members(digest, set), at most twice as many."""
    rate = max(1, members.count() // ORDER_SAMPLE)
    some = members.where(F.pmod(F.xxhash64("digest"), F.lit(rate)) == 0).select("set")

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(b.column(0).to_pylist()), np.int64))], ["t"])

    got = map_batches(some, fn, "t long").groupBy("t").agg(F.count("*").alias("n")).where("n > 2").toArrow()
    t, n = got.column("t").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(t)
    return t[order], n[order]


def _still_apart(pairs: DataFrame, comp: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): components of comp(id, component) that links within a bucket join; a paragraph without a component is its own."""
    placed = pairs.select("key", F.col("b").alias("digest")).join(comp.withColumnRenamed("id", "digest"), "digest", "left").select("key", "digest", F.coalesce("component", "digest").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    return prefix_links(materialize(placed.join(mixed, "key", "left_semi").select("digest", "comp").distinct().join(sets, "digest"), "apart"), similarity)


def prefix_links(members: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the components of members(digest, comp, set), a written table, that links between members join.

    Members meet in groups by each of their rarest shingles (see ``_rarest``), in which every pair of different
    components is compared on the full sets: no link is missed. Groups beyond CHUNK are cut into chunks and
    compared chunk by chunk, two in a task at most.
    """
    shared = members.sparkSession.sparkContext.broadcast(_common(members))

    def prefixes(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(2)]
        size = np.array([len(x) for x in sets], np.int64)
        flat = np.concatenate(sets)
        at = _rarest(flat, size, similarity, *shared.value)
        row = pa.array(np.repeat(np.arange(len(size)), size)[at])
        return pa.RecordBatch.from_arrays([pa.array(flat[at].view(np.int64)), b.column(0).take(row), b.column(1).take(row)], ["token", "digest", "comp"])

    tokens = materialize(map_batches(members.select("digest", "comp", "set"), prefixes, "token long, digest long, comp long"), "prefixes")
    shared.destroy()
    groups = tokens.groupBy("token").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token", F.ceil(F.col("size") / CHUNK).cast("int").alias("chunks"))
    m = tokens.join(groups, "token").withColumn("c", F.pmod(F.xxhash64("digest"), F.col("chunks")).cast("int"))
    m = m.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).join(members.select("digest", "set"), "digest")
    m = m.select("token", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "comp", "set")
    return map_groups(m, ["token", "i", "j"], lambda t: _links(t, similarity), "a long, b long").distinct()


def repeated_passages(docs: DataFrame, k: int = 5, similarity: float = 0.8, recall: float = 0.99, most_bands: int = 3, least_words: int = 20) -> DataFrame:
    """(doc_id, start, end, n_words, class_id, n_docs, removed): runs of paragraphs that other documents repeat.

    Paragraphs are linked if their distinct k-word shingles (all words, if fewer) have at least that
    Jaccard similarity; components of links are classes. Neighbouring paragraphs of classes found in
    several documents form a passage, of ``least_words`` or more. One with fewer words grows word by word first (see
    ``extended``), since its first and last paragraph may reach beyond what is repeated. Up to BRIDGE paragraphs without such a class, an edited
    place, belong to it if the classes on both sides follow each other within that reach in another document too. ``class_id`` is its first paragraph's
    class and ``n_docs`` the least number of documents that share one of its paragraphs. A passage is ``removed``
    unless each class in it first occurs here (smallest doc_id, then place). Positions are UTF-8 bytes, end exclusive.

    A bucket's members are compared with its smallest digest. Where that leaves several components in a bucket, all its
    members of different components are compared, so no link that would join two of them is missed.

    Null and empty texts have no paragraphs. Repetition within one document alone is not counted.
    Rows without an id are left out; repeated rows of an id count as one document. Other columns are ignored.
    """
    bands, rows = tune(similarity, recall, most_bands)
    docs = docs.where("doc_id is not null")
    all_p = materialize(paragraphs(docs, k, bands, rows), "paragraphs")
    names = [f"k{i}" for i in range(bands)]
    content = materialize(all_p.groupBy("digest").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), *[F.max(c).alias(c) for c in names]), "contents")
    # bucket of a band: its smallest digest, to which the others are compared
    keyed = content.select("digest", F.explode(F.array(*names)).alias("key"))
    buckets = materialize(keyed.groupBy("key").agg(F.min("digest").alias("hub"), F.max("digest").alias("other")).where("hub < other").select("key", "hub"), "buckets")
    bits = bitmap(buckets.select(F.col("key").alias("h")))
    in_bucket = screened(keyed, "key", bits)
    pairs = materialize(in_bucket.join(buckets, "key").where("digest <> hub").select(F.col("hub").alias("a"), F.col("digest").alias("b"), "key"), "pairs")
    bits.destroy()
    todo = pairs.select("a", "b").distinct()
    involved = materialize(pairs.select(F.col("a").alias("digest")).union(pairs.select(F.col("b").alias("digest"))).distinct(), "involved")
    bits = bitmap(involved.select(F.col("digest").alias("h")))
    with_sets = paragraphs(docs, k, bands, rows, True, bits).select("digest", "set")
    sets = materialize(with_sets.groupBy("digest").agg(F.max("set").alias("set")).join(involved, "digest", "left_semi"), "sets")
    bits.destroy()
    percent = similarity

    def holds(x: pa.RecordBatch) -> pa.RecordBatch:
        ok = []
        for p, q in zip(x.column("sa"), x.column("sb")):
            p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
            n = K.overlap(p, q)
            ok.append(n >= percent * (len(p) + len(q) - n) - 1e-9)
        return x.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def verified(todo: DataFrame) -> DataFrame:
        both = todo.join(sets.select(F.col("digest").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("digest").alias("b"), F.col("set").alias("sb")), "b")
        return map_batches(both.select("a", "b", "sa", "sb"), holds, "a long, b long")

    links = materialize(verified(todo), "links")
    comp = materialize(star_components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "hub-components")
    joined = materialize(_still_apart(pairs, comp, sets, similarity), "joined")
    wider = star_components(joined.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("id").alias("component"), F.col("component").alias("wide"))
    alone = wider.join(comp.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("id"), "component")
    comp = materialize(comp.union(alone).join(wider, "component", "left").select("id", F.coalesce("wide", "component").alias("component")), "components")
    named = content.select("digest", "lo", "hi").join(comp.withColumnRenamed("id", "digest"), "digest", "left").withColumn("class_id", F.coalesce("component", "digest"))
    wide = named.groupBy("class_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("class_id")
    shared = materialize(named.select("digest", "class_id").join(wide, "class_id"), "shared")
    bits = bitmap(shared.select(F.col("digest").alias("h")))
    near = screened(all_p.select("doc_id", "no", "at", "start", "end", "words", "digest"), "digest", bits)
    occurs = materialize(near.join(shared, "digest").drop("digest").distinct(), "occurs")
    bits.destroy()
    firsts = occurs.groupBy("class_id").agg(F.min(F.struct("doc_id", "no")).alias("first"), F.count_distinct("doc_id").alias("n"))
    marked = occurs.join(firsts, "class_id").withColumn("here", (F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.no") == F.col("no")))
    # a repeated row of an id holds each place twice; one is enough
    order = Window.partitionBy("doc_id").orderBy("no", "class_id")
    steps = materialize(marked.select("doc_id", "no", "at", "start", "end", "words", "class_id", "n", "here").withColumn("next", F.lead("class_id").over(order)).withColumn("gap", F.lead("no").over(order) - F.col("no")), "steps")
    bridges = steps.where(F.col("gap").between(1, 1 + BRIDGE)).groupBy("class_id", "next").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.max("gap").alias("widest"))
    bridges = bridges.where("lo < hi and widest > 1").select("class_id", "next", F.lit(True).alias("bridged"))
    steps = steps.join(bridges, ["class_id", "next"], "left").withColumn("open", (F.col("gap") > 1) & ~(F.col("gap").between(2, 1 + BRIDGE) & F.coalesce("bridged", F.lit(False))))
    run = F.sum(F.coalesce(F.lag("open").over(order), F.lit(False)).cast("int")).over(order)
    spans = steps.withColumn("run", run).groupBy("doc_id", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), (F.max(F.col("at") + F.col("words")) - F.min("at")).alias("n_words"),
        F.min_by("class_id", "no").alias("class_id"), F.min("n").alias("n_docs"), (~F.bool_and("here")).alias("removed"),
        F.min("no").alias("no"), F.max("no").alias("last_no"), F.max_by("class_id", "no").alias("last_class"),
    )
    spans = materialize(spans, "spans")
    short = F.col("n_words") < least_words
    spans = spans.where(~short).union(extended(docs, spans.where(short), occurs, least_words)).where(~short)
    return spans.select("doc_id", "start", "end", "n_words", "class_id", "n_docs", "removed")
