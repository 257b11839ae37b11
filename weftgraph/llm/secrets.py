"""Secret scans: trigram queries derived from each rule, postings over shards, verification by the rule."""

from __future__ import annotations

import hashlib
import re
import re._constants as C
import re._parser as P
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import kernels as K
from weftgraph.llm.common import map_batches


@dataclass(frozen=True)
class Rule:
    """One kind of secret. ``group``'s length (0: the whole match) must be at least ``least``."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    base: bool = True
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


#: The rules in the order that breaks ties between spans with one start.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 0, False),
    Rule("ghp", r"gh[pousr]_[A-Za-z0-9]{36}", 0, 0, False),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 0, False),
)
_MOST = 16


def _exact(node) -> list[str] | None:
    """All strings the parsed node can match, lower-cased, if they are few; else None."""
    out = [""]
    for op, arg in node:
        if op is C.LITERAL:
            nxt = [chr(arg).lower()]
        elif op is C.SUBPATTERN:
            nxt = _exact(arg[3])
        elif op is C.BRANCH:
            parts = [_exact(b) for b in arg[1]]
            nxt = None if any(p is None for p in parts) else sorted({x for p in parts for x in p})
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] <= 1:
            one = _exact(arg[2])
            nxt = None if one is None else one if arg[0] else ["", *one]
        elif op is C.IN and all(o is C.LITERAL for o, _ in arg):
            nxt = sorted({chr(a).lower() for _, a in arg})
        else:
            nxt = None
        if nxt is None or len(nxt) * len(out) > _MOST:
            return None
        out = [a + b for a, b in product(out, nxt)]
    return out


def _trigrams(s: str) -> frozenset[bytes]:
    b = s.encode()
    return frozenset(b[i : i + 3] for i in range(len(b) - 2))


def trigram_query(pattern: str) -> list[list[frozenset[bytes]]]:
    """Boolean trigram query that every match of ``pattern`` meets (on lower-cased text).

    A conjunction of clauses, each a list of alternatives, each a set of trigrams that must all
    occur. An empty list means the rule has no mandatory trigram and every text must be scanned.
    """
    clauses: list[list[frozenset[bytes]]] = []

    def note(strings: list[str]) -> None:
        alts = [_trigrams(s) for s in strings]
        if all(alts):
            clauses.append(sorted(set(alts), key=sorted))

    def walk(node) -> None:
        run = [""]
        for item in node:
            op, arg = item
            one = _exact([item])
            if one is not None and len(one) * len(run) <= _MOST:
                run = [a + b for a, b in product(run, one)]
                continue
            note(run)
            run = [""] if one is None else one
            if one is None and op is C.SUBPATTERN:
                walk(arg[3])
            elif one is None and op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
                walk(arg[2])
        note(run)

    walk(P.parse(pattern))
    return clauses


class Scanner:
    """Trigram postings of one shard of texts, and the rules verified on what they leave."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.grams = sorted({t for q in self.queries for c in q for alt in c for t in alt})
        codes = np.array([(t[0] << 16) | (t[1] << 8) | t[2] for t in self.grams], np.int64)
        self.known = np.zeros(1 << 24, bool)
        self.known[codes] = True
        self.codes = codes
        self.number = {t: i for i, t in enumerate(self.grams)}

    def postings(self, data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        """For each query trigram the sorted rows of the shard that hold it."""
        d = K._LOWER[data].astype(np.int32)
        if len(d) < 3 or not self.grams:
            return [np.zeros(0, np.int64)] * len(self.grams)
        code = (d[:-2] << 16) | (d[1:-1] << 8) | d[2:]
        at = np.flatnonzero(self.known[code])
        row = np.searchsorted(off, at, "right") - 1
        inside = at + 2 < off[row + 1]
        at, row = at[inside], row[inside]
        gram = np.searchsorted(self.codes, code[at])
        key = np.unique(gram * np.int64(len(off)) + row)
        gram, row = key // len(off), key % len(off)
        cut = np.searchsorted(gram, np.arange(len(self.grams) + 1))
        return [row[cut[g] : cut[g + 1]] for g in range(len(self.grams))]

    def candidates(self, data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        """For each rule the rows that its trigram query leaves."""
        lists = self.postings(data, off)
        every = np.arange(len(off) - 1)
        out = []
        for q in self.queries:
            rows = every
            for clause in q:
                hit = np.zeros(0, np.int64)
                for alt in clause:
                    sub = None
                    for t in sorted(alt, key=lambda t: len(lists[self.number[t]])):
                        sub = lists[self.number[t]] if sub is None else np.intersect1d(sub, lists[self.number[t]], assume_unique=True)
                        if not len(sub):
                            break
                    hit = np.union1d(hit, sub)
                rows = np.intersect1d(rows, hit, assume_unique=True)
            out.append(rows)
        return out

    def scan(self, col: pa.Array) -> list[list[tuple[int, int, int]]]:
        """(start, rule number, end) of every secret of each text, sorted; code points, end exclusive."""
        data, off = K.text_bytes(col)
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(off) - 1)]
        texts: dict[int, str] = {}
        for i, j in K.blocks(off):
            lo = int(off[i])
            for k, rows in enumerate(self.candidates(data[lo : int(off[j])], off[i : j + 1] - lo)):
                rule = self.rules[k]
                rx = rule.compiled()
                if rule.pattern == "[0-9a-f]+":  # maximal runs: the same spans, without visiting the short ones
                    rx = re.compile(r"(?<![0-9a-f])[0-9a-f]{%d,}" % rule.least)
                for r in (int(r) + i for r in rows):
                    if off[r + 1] == off[r]:
                        continue
                    if r not in texts:
                        texts[r] = str(data[off[r] : off[r + 1]].tobytes(), "utf-8")
                    for m in rx.finditer(texts[r]):
                        if m.end(rule.group) - m.start(rule.group) >= rule.least:
                            found[r].append((m.start(), k, m.end()))
            texts.clear()
        for f in found:
            f.sort()
        return found


def _join(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans array, n_<base kind>, base_sha256, spans text) for every row.

    Null text counts as empty: no spans, counts of 0, the digest of the empty string. Matches are
    leftmost and non-overlapping within a kind; kinds may overlap each other. Repeated rows repeat
    their result; null ids are kept; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = [k for k, r in enumerate(rules) if r.base]
    scanner: list[Scanner] = []

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        if not scanner:
            scanner.append(Scanner(rules))
        found = scanner[0].scan(b.column(1))
        own = [[s for s in f if rules[s[1]].base] for f in found]
        cols = [b.column(0)]
        cols += [pa.array([sum(s[1] == k for s in f) for f in own], pa.int64()) for k in base]
        cols.append(pa.array([hashlib.sha256(_join(f, rules).encode()).hexdigest() for f in own]))
        cols.append(pa.array([_join(f, rules) for f in found], pa.string()))
        return pa.RecordBatch.from_arrays(cols, ["doc_id", *(f"n_{rules[k].kind}" for k in base), "base_sha256", "spans"])

    return map_batches(rows, fn, f"doc_id long, {', '.join(f'n_{rules[k].kind} long' for k in base)}, base_sha256 string, spans string")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[secret]") -> DataFrame:
    """All rows and columns, with every secret in ``text`` replaced by ``mask`` and ``n_chars`` following.

    Of an assignment the whole span goes. Overlapping spans are masked once. Rows without a secret pass unchanged.
    """
    names = docs.columns
    at = names.index("text")
    scanner: list[Scanner] = []

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        if not scanner:
            scanner.append(Scanner(rules))
        found = scanner[0].scan(b.column(at))
        if not any(found):
            return b
        texts = b.column(at).to_pylist()
        sizes = b.column(names.index("n_chars")).to_pylist() if "n_chars" in names else None
        for r, spans in enumerate(found):
            if spans:
                out, pos = [], 0
                for a, _, e in spans:
                    if a >= pos:
                        out += [texts[r][pos:a], mask]
                    pos = max(pos, e)
                texts[r] = "".join(out) + texts[r][pos:]
                if sizes is not None:
                    sizes[r] = len(texts[r])
        cols = list(b.columns)
        cols[at] = pa.array(texts, b.schema.field(at).type)
        if sizes is not None:
            k = names.index("n_chars")
            cols[k] = pa.array(sizes, b.schema.field(k).type)
        return pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return map_batches(docs, fn, docs.schema)
