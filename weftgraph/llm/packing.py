"""Best-two-fit packing of tokenised documents into fixed-size sequences."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import kernels as K
from weftgraph.llm.common import map_batches
from weftgraph.runtime import materialize

#: Pieces that one packing group holds on average. A group closes with at most a few part-filled sequences.
GROUP = 4096


_KIND = np.full(256, 3, np.uint8)  # 0 white space, 1 letter, 2 digit, 3 other ASCII, 4 beyond ASCII
_KIND[K._SPACE] = 0
_KIND[97:123] = _KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[128:] = 4


_LATIN = re.compile("[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else the next from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTE_LETTERS = _byte_letters()
_loaded: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each Python worker, so that its cache outlives a task."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


class WordTokenizer:
    """Ids of texts, through the ids of their distinct units.

    Valid for tokenizers that lower case, drop white space, and never join a letter run with ASCII
    marks or digits (an apostrophe keeps its neighbours). Texts that spell out a special token are
    encoded whole. Units seen again come from a cache of bounded size, held flat.
    """

    CACHE = 250_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0
        self.first, self.size = np.zeros(self.CACHE, np.int64), np.zeros(self.CACHE, np.int64)

    def _ids(self, units: list[str]) -> Iterator[list[int]]:
        """Ids of each unit. A unit of Latin-1 letters is one piece for the model itself, once its bytes are mapped."""
        plain = [_LATIN.fullmatch(w) is not None for w in units]
        rest = iter(self.tok.encode_batch_fast([w for w, p in zip(units, plain) if not p], add_special_tokens=False))
        model = self.tok.model
        for w, p in zip(units, plain):
            if p:
                yield [t.id for t in model.tokenize(w if w.isascii() else w.lower().encode().decode("latin1").translate(_BYTE_LETTERS))]
            else:
                yield next(rest).ids

    def _learn(self, new: list[str]) -> None:
        for i in range(0, len(new), 2000):
            part = new[i : i + 2000]
            for w, ids in zip(part, self._ids(part)):
                if self.used + len(ids) > len(self.flat):
                    self.flat = np.concatenate([self.flat, np.zeros(len(self.flat) + len(ids), np.uint32)])
                k = self.known[w] = len(self.known)
                if k == len(self.first):
                    self.first, self.size = (np.concatenate([x, np.zeros(len(x), np.int64)]) for x in (self.first, self.size))
                self.first[k], self.size[k] = self.used, len(ids)
                self.flat[self.used : self.used + len(ids)] = ids
                self.used += len(ids)

    def units(self, data: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """(units of all texts, number of the first unit of each text + total)."""
        d = K._LOWER[data]
        kind = _KIND[d]
        live = kind > 0
        cut = np.zeros(len(d), bool)
        if len(d):
            a, b = kind[:-1], kind[1:]
            cut[1:] = ((a == 1) & (b == 3) & (d[1:] != 39)) | ((a == 3) & (b == 1) & (d[:-1] != 39))
            cut[1:] |= ((a == 2) & (b < 4)) | ((b == 2) & ((a == 1) | (a == 3)))
            cut[1:] |= ~live[:-1]
            heads = off[:-1][off[:-1] < len(d)]
            cut[heads] = True
            cut &= live
        start = np.flatnonzero(cut)
        kept = np.cumsum(live) - live
        ends = np.append(kept[start], live.sum()).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(d[live]))])
        return words, np.searchsorted(start, off)

    def encode(self, col: pa.Array) -> list[np.ndarray]:
        """Ids of each text (null: none), as unsigned 32-bit integers."""
        out: list[np.ndarray] = []
        data, off = K.text_bytes(col)
        for i, j in K.blocks(off, 2 << 20):
            lo = int(off[i])
            words, first = self.units(data[lo : int(off[j])], off[i : j + 1] - lo)
            coded = words.dictionary_encode()
            names = coded.dictionary.to_pylist()
            new = [w for w in names if w not in self.known]
            if self.known and len(self.known) + len(new) > self.CACHE:
                self._clear()
                new = names
            self._learn(new)
            at = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))
            idx = at[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
            n = self.size[idx]
            ends = np.concatenate([[0], np.cumsum(n)])
            ids = self.flat[np.repeat(self.first[idx] - ends[:-1], n) + np.arange(ends[-1])]
            cut = ends[first]
            out += [ids[cut[k] : cut[k + 1]] for k in range(j - i)]
        odd = pc.match_substring(col, self.special[0]) if self.special else None
        for s in self.special[1:]:
            odd = pc.or_(odd, pc.match_substring(col, s))
        for r in np.flatnonzero(odd.fill_null(False).to_numpy(zero_copy_only=False)) if odd is not None else ():
            out[r] = np.array(self.tok.encode(col[int(r)].as_py(), add_special_tokens=False).ids, np.uint32)
        return out


def best_two_fit(length: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin number, offset) of each piece.

    One bin at a time: take the largest unpacked piece that fits until none does; then, if the bin
    has more than one piece, swap its smallest for the two unpacked pieces with the largest sum
    that still fits, if that sum fills more. Sizes are kept as counts with a bit set of those left.
    """
    order = np.argsort(-length, kind="stable")
    stacks: dict[int, list[int]] = {}
    for i in order[::-1].tolist():
        stacks.setdefault(int(length[i]), []).append(i)
    left = 0
    for s in stacks:
        left |= 1 << s
    bins, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)

    def pop(s: int) -> int:
        nonlocal left
        i = stacks[s].pop()
        if not stacks[s]:
            left &= ~(1 << s)
        return i

    number = 0
    while left:
        gap, held = capacity, []
        while fits := left & ((1 << (gap + 1)) - 1):
            s = fits.bit_length() - 1
            held.append((s, pop(s)))
            gap -= s
        if len(held) > 1 and gap and left:
            small, room = held[-1][0], gap + held[-1][0]
            best, pair = small, None
            cand = left & ((1 << (room + 1)) - 1)
            while cand:
                a = cand.bit_length() - 1
                if 2 * a <= best:
                    break
                cand &= ~(1 << a)
                rest = left & ((1 << (min(room - a, a) + 1)) - 1)
                if len(stacks[a]) < 2:
                    rest &= ~(1 << a)
                if rest:
                    b = rest.bit_length() - 1
                    if a + b > best:
                        best, pair = a + b, (a, b)
                        if best == room:
                            break
            if pair:
                s, i = held.pop()
                held += [(x, pop(x)) for x in pair]
                stacks[s].append(i)
                left |= 1 << s
        pos = 0
        for s, i in held:
            bins[i], offset[i] = number, pos
            pos += s
        number += 1
    return bins, offset


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end mark, cut only beyond ``capacity``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for d, ids in zip(b.column(0).to_pylist(), tokenizer(tokenizer_path).encode(b.column(1))):
            ids = np.append(ids, np.uint32(end_id)).astype("<u4")
            for k, s in enumerate(range(0, len(ids), capacity)):
                part = ids[s : s + capacity]
                out.append((d, k, s, len(part), zlib.crc32(part.tobytes())))
        cols = list(zip(*out))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(rows, fn, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, group: int = GROUP) -> DataFrame:
    """One row for each piece of each document, with its sequence and offset there.

    Pieces are dealt by hash into groups of about ``group``; a task packs a group, so memory and
    time of a task stay bounded however many documents there are. A piece of full size is a
    sequence of its own. Null and empty texts are one piece that holds the end mark. Repeated
    rows are packed each on their own; null ids are kept; other columns are ignored.
    """
    cut = materialize(pieces_of(docs, tokenizer_path, capacity, end_id), "pieces")
    groups = max(1, -(-cut.count() // group))
    dealt = cut.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "start"), F.lit(groups)))

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable", ignore_index=True)
        bins, offset = best_two_fit(pdf["length"].to_numpy(), capacity)
        return pdf.drop(columns="g").assign(sequence_id=bins + (np.int64(key[0]) << 32), offset=offset)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("g").applyInPandas(fill, schema)
