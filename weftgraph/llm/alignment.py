"""Alignment of two tokenizers' tokens over the same bytes, and corpus-wide counts of aligned id pairs."""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import kernels as K
from weftgraph.llm.common import group_starts, map_groups, pieces
from weftgraph.llm.packing import _BYTE_LETTERS
from weftgraph.runtime import materialize, ship_package

#: Fixed value: how byte-level BPE of this kind parts a text before it merges.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Text of a block, whose distinct segments are encoded once.
BLOCK = 4 << 20
#: Bytes from which a segment goes to the tokenizer of the vocabulary file itself, which is safe on long runs.
LONG = 2000
_B_SPAN = 1 << 20

_PRINTS = np.zeros(256, bool)
_PRINTS[33:127] = True


class Tokens:
    """Both tokenizers, and the bytes and decimal names of their ids."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        model = json.load(open(a_path, encoding="utf-8"))["model"]
        letters = {c: b for b, c in _BYTE_LETTERS.items()}
        a_bytes = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        base = len(a_bytes) - len(model["merges"])
        in_order = all(model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] == base + i for i, m in enumerate(model["merges"]))
        self.whole = Tokenizer.from_file(a_path)
        self.whole.encode_special_tokens = True
        self.fast = tiktoken.Encoding("a", pat_str=PRETOKENS, mergeable_ranks=a_bytes, special_tokens={}) if in_order else None
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        hexed = [re.fullmatch("<0x([0-9A-F]{2})>", p) for p in names]
        self.b_bytes = [bytes([int(m[1], 16)]) if m else p.replace("▁", " ").encode() for m, p in zip(hexed, names)]
        self.a_bytes = [b""] * (max(a_bytes.values()) + 1)
        for t, i in a_bytes.items():
            self.a_bytes[i] = t
        if max(len(self.a_bytes), len(self.b_bytes)) > _B_SPAN:
            raise ValueError("a vocabulary has more than a million ids")
        self.a_size, self.b_size = (np.array([len(t) for t in x]) for x in (self.a_bytes, self.b_bytes))
        na, nb = len(self.a_bytes), len(self.b_bytes)
        self.shown = pa.array([*(f"{i}," for i in range(na)), *(f"{i}|" for i in range(na)), *(f"{i}," for i in range(nb)), *(f"{i};" for i in range(nb))], pa.large_binary())

    def encode_a(self, segments: list[str]) -> list[list[int]]:
        out = [self.fast.encode_ordinary(s) if self.fast and len(s) < LONG else None for s in segments]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.whole.encode_batch([segments[i] for i in rest], add_special_tokens=False)):
            out[i] = e.ids
        return out

    def encode_b(self, segments: list[str]) -> list[list[int]]:
        """Each segment begins with the space that the model itself puts first."""
        return self.b.encode([s[1:] for s in segments], num_threads=1)


_loaded: dict[tuple[str, str], Tokens] = {}


def tokens(a_path: str, b_path: str) -> Tokens:
    """One pair of tokenizers for each Python worker."""
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = Tokens(a_path, b_path)
    return _loaded[a_path, b_path]


def segment_starts(d: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where each segment begins: at each text, and at spaces where both tokenizers always begin a token.

    A single space after a printing ASCII character, or between a character that is no ASCII space and a printing one. There
    neither the first tokenizer's parts nor the second's pieces (none holds a space after another character) reach across.
    A text's last space begins none: the second tokenizer puts its own space before a rest, but none before an empty one.
    """
    space = d == 32
    cut = np.zeros(len(d), bool)
    if len(d) > 2:
        before, after = d[:-2], d[2:]
        cut[1:-1] = space[1:-1] & (_PRINTS[before] | (_PRINTS[after] & ~K._SPACE[before]))
    full = np.diff(off) > 0
    cut[off[1:][full] - 1] = False
    cut[off[:-1][full]] = True
    return np.flatnonzero(cut)


def union_find(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest member of each of n nodes' components: roots of an edge are hooked to the smaller one, then paths are halved."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        live = a != b
        if not live.any():
            return root
        u, v = u[live], v[live]
        np.minimum.at(root, np.maximum(a[live], b[live]), np.minimum(a[live], b[live]))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up


def align_tokens(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group of each A token, group of each B token, A and B numbers of the links) of two partitions of the same bytes.

    Nodes are tokens, edges join those that overlap; the components are the minimal groups. The pairs of a group's
    members whose ranges end together are the links.
    """
    na, nb = len(end_a), len(end_b)
    if not na:
        return (np.zeros(0, np.int64),) * 4
    every = np.union1d(end_a, end_b)  # each stretch between two ends lies in one token of either side
    root = union_find(na + nb, np.searchsorted(end_a, every), na + np.searchsorted(end_b, every))
    names, group = np.unique(root, return_inverse=True)
    group_a, group_b = group[:na], group[na:]
    j = np.minimum(np.searchsorted(end_b, end_a), nb - 1)
    i = np.flatnonzero((end_b[j] == end_a) & (group_b[j] == group_a))
    return group_a, group_b, i, j[i]


def _planes(x: np.ndarray) -> bytes:
    """Small numbers as 32 bits, all low bytes first: the high ones are almost all 0 and take no room once compressed."""
    return x.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def align_block(t: Tokens, ids: pa.Array, texts: pa.Array, block: int) -> pa.RecordBatch:
    """A row for each text (its numbers, and its segments by number), and one for the block's segments and id pairs."""
    d, off = K.text_bytes(pc.binary_join_element_wise(*(pa.scalar(" ", pa.large_string()), texts.cast(pa.large_string()), pa.scalar("", pa.large_string()))))
    off = np.array(off)
    if len(texts):
        blank = np.diff(off) <= 1  # null or empty
        if blank.any():  # they have no segment
            own = np.repeat(~blank, np.diff(off))
            d, off = d[own], np.concatenate([[0], np.cumsum(np.where(blank, 0, np.diff(off)))])
    d = np.ascontiguousarray(d)
    start = segment_starts(d, off)
    bounds = np.append(start, len(d)).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(d)]).dictionary_encode()
    often = np.argsort(-np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)), kind="stable")
    number = np.empty(len(often), np.int64)
    number[often] = np.arange(len(often))
    seg = number[coded.indices.to_numpy()]  # frequent segments have low numbers, whose high bytes compress
    first = np.searchsorted(start, off)  # first segment of each text
    raw = coded.dictionary.take(pa.array(often)).to_pylist()
    del coded
    shown = [s.decode(errors="replace") for s in raw]
    ids_a, ids_b = t.encode_a(shown), t.encode_b(shown)
    n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (ids_a, ids_b))
    flat_a, flat_b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (ids_a, ids_b))
    ok, joined = np.ones(len(raw), bool), b"".join(raw)
    if any(b"".join(map(x.__getitem__, flat)) != joined for x, flat in ((t.a_bytes, flat_a), (t.b_bytes, flat_b))):
        for i, s in enumerate(raw):
            ok[i] = b"".join(map(t.a_bytes.__getitem__, ids_a[i])) == s == b"".join(map(t.b_bytes.__getitem__, ids_b[i]))
    del ids_a, ids_b, shown, joined
    keep_a, keep_b = np.repeat(ok, n_a), np.repeat(ok, n_b)
    flat_a, flat_b, n_a, n_b = flat_a[keep_a], flat_b[keep_b], n_a * ok, n_b * ok
    group_a, group_b, i, j = align_tokens(np.cumsum(t.a_size[flat_a]), np.cumsum(t.b_size[flat_b]))
    # the text of the groups: tokens in order of group and side, each with the mark that follows it
    last_a, last_b = (np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool) for g in (group_a, group_b))
    place_a, place_b = np.arange(len(group_a)) + np.searchsorted(group_b, group_a), np.arange(len(group_b)) + np.searchsorted(group_a, group_b, "right")
    order = np.zeros(len(group_a) + len(group_b), np.int64)
    na, nb = len(t.a_bytes), len(t.b_bytes)
    order[place_a], order[place_b] = flat_a + na * last_a, 2 * na + flat_b + nb * last_b
    said = t.shown.take(pa.array(order))
    said_off = np.frombuffer(said.buffers()[1], np.int64)[: len(said) + 1] if len(said) else np.zeros(1, np.int64)
    seg_off = said_off[np.concatenate([[0], np.cumsum(n_a + n_b)])]
    by_seg = pa.Array.from_buffers(pa.large_binary(), len(raw), [None, pa.py_buffer(np.ascontiguousarray(seg_off)), said.buffers()[2] if len(said) else pa.py_buffer(b"")])
    of_a, of_b = np.repeat(np.arange(len(raw)), n_a), np.repeat(np.arange(len(raw)), n_b)
    n_groups, n_links = np.bincount(of_b[last_b], minlength=len(raw)), np.bincount(of_a[i], minlength=len(raw))
    codes, pair = np.unique(flat_a[i] * _B_SPAN + flat_b[j], return_inverse=True)
    # a text has tokens if each of its segments gives its bytes back
    fine = np.diff(np.concatenate([[0], np.cumsum(~ok[seg])])[first]) == 0
    fine &= np.diff(off) > 0
    used = np.repeat(fine, np.diff(first))
    seg, first = seg[used], np.concatenate([[0], np.cumsum(np.where(fine, np.diff(first), 0))])
    counts = np.bincount(pair, weights=np.bincount(seg, minlength=len(raw))[of_a[i]], minlength=len(codes)).astype(np.int64)
    sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[seg])])[first])
    whole = by_seg.take(pa.array(seg))
    text, ends = (memoryview(whole.buffers()[2]) if len(whole) and whole.buffers()[2] else memoryview(b"")), (np.frombuffer(whole.buffers()[1], np.int64)[: len(whole) + 1] if len(whole) else np.zeros(1, np.int64))[first]
    digests = [hashlib.sha256(text[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
    n = len(texts)
    with_block = lambda x, kind, one: pa.array([*x, one], kind)
    cols = [
        pa.array([block] * (n + 1), pa.int64()), pa.concat_arrays([ids.cast(pa.int64()), pa.nulls(1, pa.int64())]), *(with_block(sums(x), pa.int64(), None) for x in (n_a, n_b, n_groups, n_links)), with_block(digests, pa.string(), None),
        with_block([_planes(seg[x:y]) for x, y in zip(first[:-1].tolist(), first[1:].tolist())], pa.binary(), None),
        with_block([None] * n, pa.list_(pa.int64()), codes), with_block([None] * n, pa.list_(pa.int64()), counts),
        with_block([None] * n, pa.binary(), _planes(np.append(0, np.cumsum(n_links)))), with_block([None] * n, pa.binary(), _planes(pair)),
    ]
    return pa.RecordBatch.from_arrays(cols, _ALIGNED.names)


_ALIGNED = pa.schema([
    ("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
    ("segments", pa.binary()), ("codes", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("link_first", pa.binary()), ("link_pair", pa.binary()),
])
_ALIGNED_SQL = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, segments binary, codes array<long>, counts array<long>, link_first binary, link_pair binary"


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Texts with their groups, and blocks with their distinct segments' links; lazily, as written by ``align``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ship_package(docs.sparkSession)

    def run(it):
        at, k = TaskContext.get().partitionId(), 0
        for b in it:
            for part in pieces(b, BLOCK):
                yield align_block(tokens(a_path, b_path), part.column(0), part.column(1), (at << 32) + k)
                k += 1

    return rows.mapInArrow(run, _ALIGNED_SQL)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(a, b, n): links of each id pair over the whole corpus, from the blocks' own counts of ``aligned`` rows."""
    own = blocks.where("codes is not null").select(F.explode(F.arrays_zip("codes", "counts")).alias("x"))
    n = own.groupBy(F.col("x.codes").alias("code")).agg(F.sum("x.counts").alias("n"))
    return n.select(F.shiftright("code", 20).alias("a"), F.col("code").bitwiseAND(F.lit(_B_SPAN - 1)).alias("b"), "n")


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row for each row of ``docs``.

    Texts are cut where both tokenizers always begin a token; a block of texts encodes and aligns each distinct
    segment once. Pairs are counted in blocks, then over all. The counts go back to each block for its own pairs only,
    so no task holds the corpus's pairs; the best count of each B id is broadcast, and bounded by B's vocabulary.
    Null and empty texts, and those whose tokens do not give their bytes back, have zeros and ''. Null ids and repeated rows are
    kept (and count), ties for a B id's best are all best, an empty table gives no rows, other columns are ignored.
    """
    done = materialize(aligned(docs, a_path, b_path), "aligned")
    counts = materialize(pair_counts(done), "pair-counts")
    best = F.broadcast(counts.groupBy("b").agg(F.max("n").alias("most")))
    known = counts.join(best, "b").select((F.col("a") * _B_SPAN + F.col("b")).alias("code"), "n", (F.col("n") == F.col("most")).alias("best"))
    own = done.where("codes is not null").select("block", F.posexplode("codes").alias("pos", "code"))
    looked = own.join(known, "code").select("block", "pos", "n", "best")
    cols = ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "segments", "link_first", "link_pair"]
    both = done.select(*cols).unionByName(looked, allowMissingColumns=True)

    def fn(t: pa.Table) -> pa.RecordBatch:
        first = group_starts(t, ["block"])
        return pa.Table.from_batches([_scored(t.slice(x, y - x)) for x, y in zip(first[:-1].tolist(), first[1:].tolist())]).combine_chunks().to_batches()[0]

    return map_groups(both, ["block"], fn, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def _scored(t: pa.Table) -> pa.RecordBatch:
    """One block's texts with the sums over their links of counts and of whether they are best."""
    pairs = t.filter(pc.is_valid(t.column("pos")))
    block = t.filter(pc.is_valid(t.column("link_first")))
    docs = t.filter(pc.is_valid(t.column("segments")))
    order = np.argsort(pairs.column("pos").to_numpy())
    n, best = (pairs.column(c).to_numpy()[order].astype(np.int64) for c in ("n", "best"))
    first, pair = (_numbers(block.column(c)[0].as_py()).astype(np.int64) for c in ("link_first", "link_pair"))
    by_seg = [np.diff(np.concatenate([[0], np.cumsum(x[pair])])[first]) for x in (best, n)]
    held = [_numbers(s) for s in docs.column("segments").to_pylist()]
    off = np.concatenate([[0], np.cumsum([len(s) for s in held], dtype=np.int64)])
    seg = np.concatenate([*held, np.zeros(0, np.int32)]).astype(np.int64)
    n_best, count_sum = (np.diff(np.concatenate([[0], np.cumsum(x[seg])])[off]) for x in by_seg)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    own = lambda c: docs.column(c).combine_chunks()
    flat = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in map(own, ["doc_id", "n_a", "n_b", "n_groups", "n_links"])]
    sha = docs.column("groups_sha256").cast(pa.string()).combine_chunks()
    return pa.RecordBatch.from_arrays([*flat, pa.array(n_best), pa.array(count_sum), sha.chunk(0) if isinstance(sha, pa.ChunkedArray) else sha], names)
