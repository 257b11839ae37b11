"""Pieces that several corpus operators share: input cleaning, held-out folds, bounded samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.runtime import ship_package

#: Size of the bit map that screens rows before an exact join, as a power of two: 2^25 bits are 4 MB.
MAP_BITS = 25


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def bounded_sample(rows: DataFrame, cls: str, key: str, per_class: int) -> DataFrame:
    """About ``per_class`` rows of each class, chosen by a hash of ``key`` so that a re-run picks the same.

    Classes are counted first (one row per class reaches the driver), so a rare class is taken
    whole and a frequent one at the rate that gives its share, up to chance: a class of 1,000 has between
    about 850 and 1,150 but for one time in a million.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(cls).count().collect() if r[0] is not None}
    if not counts:
        return rows.limit(0)
    scale = 1 << 30
    keep = F.lit(False)
    for c, n in counts.items():
        keep = keep | ((F.col(cls) == F.lit(c)) & (F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(scale)) < int(scale * min(1.0, per_class / n)) + 1))
    return rows.where(keep)


def labelled_ids(labels: DataFrame, label: str, modulus: int, held: int) -> DataFrame:
    """(doc_id, y) outside the held-out fold; repeated labels of a document: the smaller one."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    rows = rows.where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), modulus) != held))
    return rows.groupBy("doc_id").agg(F.min("y").alias("y"))


def sampled_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts of the sampled ids. ``ids`` comes from ``bounded_sample``: its bound makes the broadcast safe."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"])


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | list], schema: str) -> DataFrame:
    """``fn`` over Arrow batches of bounded size, inside Spark's tasks."""
    ship_package(df.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for part in pieces(b):
                out = fn(part)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return df.mapInArrow(run, schema)


def pieces(b: pa.RecordBatch, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``size`` bytes; a longer row stands alone."""
    if not b.num_rows:
        return
    step = max(1, int(b.num_rows * size / max(b.nbytes, 1)))
    for i in range(0, b.num_rows, step):
        yield b.slice(i, step)


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """``fn`` over tables of whole groups of the keys: the rows are dealt and sorted by them, and many small groups share a call.

    A task holds a batch and its largest group, so the caller bounds the groups.
    """
    ship_package(df.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for b in it:
            if not b.num_rows:
                continue
            first = group_starts(pa.Table.from_batches([b]), keys)
            goes_on = bool(rest) and all(rest[-1].column(k)[-1].as_py() == b.column(k)[0].as_py() for k in keys)
            if len(first) == 2 and (goes_on or not rest):  # one group, which may go on
                rest.append(b)
                continue
            cut = int(first[-2])
            if rest and not goes_on:
                yield fn(pa.Table.from_batches(rest))
                rest = []
            if cut:
                yield fn(pa.Table.from_batches([*rest, b.slice(0, cut)]))
                rest = []
            rest.append(b.slice(cut))
        if rest:
            yield fn(pa.Table.from_batches(rest))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def group_starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    """First row of each run of equal keys, and the number of rows."""
    new = np.zeros(max(t.num_rows - 1, 0), bool)
    for k in keys:
        x = t.column(k).to_numpy()
        new |= x[1:] != x[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1, [t.num_rows]])


def bitmap(ids: DataFrame) -> Broadcast:
    """A bit for each hash in ids(h), at its low bits: at most 2^MAP_BITS bits, whatever the number of hashes.

    The words are joined in Spark; what reaches the driver, and each task, has that bound. Beyond
    some 2^23 hashes the map fills up and screens less; the exact join behind it decides in any case.
    """
    n = ids.count()
    size = min(MAP_BITS, max(16, int(n * 8).bit_length()))
    low = F.col("h").bitwiseAND(F.lit((1 << size) - 1))
    words = ids.select(F.shiftright(low, 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(1 << (size - 6), np.int64)
    got = words.toArrow()
    out[got.column("w").to_numpy()] = got.column("b").to_numpy()
    return ids.sparkSession.sparkContext.broadcast(out.view(np.uint64))


def marked(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes the map may hold."""
    low = h.view(np.uint64) & np.uint64(len(bits) * 64 - 1)
    return (bits[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) > 0
