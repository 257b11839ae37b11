"""Order MinHash fingerprints, written with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K_WORDS, BUCKETS, TUPLE = 3, 64, 2
#: Code points that end a symbol of unbroken text: some letters and digits, and every other block of 32 beyond ASCII.
ANCHORS = "aeiouAEIOU05" + "".join(f"\\u{b:04X}-\\u{b + 31:04X}" for b in [*range(0x80, 0xD800, 64), *range(0xE000, 0xFFC0, 64)])
#: Symbols of a text: the white space before a word and the word. A run of more than 16 code points is cut behind
#: anchors, else after 16, so an edit in unbroken text moves the cuts up to the next anchor only.
SYMBOL = rf"\s*+(?:\S{{1,16}}+(?!\S)|\S{{1,15}}?[{ANCHORS}]|\S{{1,16}})|\s+"
_POS = 1 << 24


def add_fingerprint(df: DataFrame, text: Column, name: str, k: int = K_WORDS, buckets: int = BUCKETS, size: int = TUPLE, bits: int | None = None) -> DataFrame:
    """Adds ``name``: four hex digits for each bucket of the order min-hash of ``text``.

    The k-mers of symbols are numbered by occurrence, hashed and dealt into buckets by the high
    bits of the hash. A bucket selects its ``size`` smallest, and the smallest of the buckets behind it where it has fewer
    (behind the last comes the first), puts them back in text order and hashes that tuple. So every tuple keeps an order,
    also in short texts. Shorter texts are a single k-mer, an empty bucket is ``----``, a text without symbols (white
    space counts) is all empty. Positions are kept to one part in 2^24 of a text; members that close stand in order of
    their hashes. Equal texts have equal fingerprints. ``bits`` of a position are dropped if given, else as many as the
    length asks for. Each step is a column of its own: Spark then evaluates it once.
    """
    if buckets & (buckets - 1):
        raise ValueError("the number of buckets is a power of two")
    t = [f"__{name}_{i}" for i in range(6)]
    keep = df.columns
    shift = 63 - (buckets - 1).bit_length()
    w, h, runs, g, cut, less = t
    word = lambda i, j: F.get(F.col(w), i + F.lit(j))
    df = df.withColumn(w, F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SYMBOL), F.lit(0)))
    # texts of 2^24 symbols and more lose the last bits of a position, so that it has 24 bits at any length
    coarse = F.greatest(F.lit(0), F.length(F.bin(F.size(w))) - F.lit(24)) if bits is None else F.lit(bits)
    df = df.withColumn(less, coarse.cast("int"))
    # a 39-bit hash above a 24-bit position, never negative: one sort of plain longs groups equal k-mers in text order
    mers = F.transform(F.col(w), lambda x, i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(x, *(word(i, j) for j in range(1, k))), 25), 24).bitwiseOR(F.call_function("shiftright", i, F.col(less)).cast("long")))
    df = df.withColumn(h, F.sort_array(F.slice(mers, F.lit(1), F.greatest(F.size(w) - F.lit(k - 1), F.lit(1)))))
    same = lambda a, b: F.shiftrightunsigned(a, 24) == F.shiftrightunsigned(b, 24)
    idx = F.sequence(F.lit(0), F.size(h) - 1)
    starts = F.filter(idx, lambda i: (i == 0) | ~same(F.get(F.col(h), i), F.get(F.col(h), i - 1)))
    df = df.withColumn(runs, F.when(F.size(h) > 0, starts).otherwise(F.array().cast("array<int>")))
    # the o-th repeat of a k-mer is an element of its own: its hash is mixed with o
    def numbered(start: Column, j: Column) -> Column:
        end = F.coalesce(F.get(F.col(runs), j + 1), F.size(h))
        def one(x: Column, o: Column) -> Column:
            mixed = F.when(o == 0, F.shiftrightunsigned(x, 24)).otherwise(F.shiftrightunsigned(F.xxhash64(F.shiftrightunsigned(x, 24), o), 25))
            return F.shiftleft(mixed, 24).bitwiseOR(x.bitwiseAND(F.lit(_POS - 1)))
        return F.transform(F.slice(F.col(h), start + 1, end - start), one)

    single = F.size(runs) == F.size(h)
    df = df.withColumn(g, F.when(single, F.col(h)).otherwise(F.sort_array(F.flatten(F.transform(F.col(runs), numbered)))))
    bucket = lambda x: F.shiftrightunsigned(x, shift)
    at = F.sequence(F.lit(0), F.size(g) - 1)
    heads = F.filter(at, lambda i: (i == 0) | (bucket(F.get(F.col(g), i)) != bucket(F.get(F.col(g), i - 1))))
    ring = F.concat(F.col(g), F.slice(F.col(g), F.lit(1), F.lit(size - 1)))
    picked = F.transform(heads, lambda i: F.slice(F.when(i + size <= F.size(g), F.col(g)).otherwise(ring), i + 1, F.least(F.lit(size), F.size(g))))
    df = df.withColumn(cut, F.when(F.size(g) > 0, picked).otherwise(F.array().cast("array<array<bigint>>")))

    def digits(sel: Column) -> Column:
        ordered = F.transform(F.array_sort(F.transform(sel, lambda x: F.struct(x.bitwiseAND(F.lit(_POS - 1)).alias("p"), F.shiftrightunsigned(x, 24).alias("v")))), lambda s: s["v"])
        return F.lower(F.lpad(F.hex(F.shiftrightunsigned(F.xxhash64(ordered), 48)), 4, "0"))

    # empty buckets between two filled ones are written as gaps, so each tuple is hashed once
    before = lambda i: F.when(i > 0, bucket(F.get(F.get(F.col(cut), i - 1), F.lit(0)))).otherwise(F.lit(-1).cast("long"))
    gap = lambda n: F.repeat(F.lit("----"), n.cast("int"))
    filled = F.transform(F.col(cut), lambda sel, i: F.concat(gap(bucket(sel[0]) - before(i) - 1), digits(sel)))
    tail = gap(F.lit(buckets - 1) - before(F.size(cut)))
    text_form = F.concat(F.array_join(filled, ""), tail)
    return df.withColumn(name, text_form).select(*keep, name)


def likeness(a: Column, b: Column, buckets: int = BUCKETS) -> Column:
    """Share of equal tuples among the buckets that either text fills; 1 for two empty fingerprints."""
    seq = F.sequence(F.lit(0), F.lit(buckets - 1))
    part = lambda c, i: F.substring(c, i * 4 + 1, F.lit(4))
    both = F.size(F.filter(seq, lambda i: (part(a, i) == "----") & (part(b, i) == "----")))
    equal = F.size(F.filter(seq, lambda i: part(a, i) == part(b, i)))
    return F.when(both == buckets, F.lit(1.0)).otherwise((equal - both) / (buckets - both).cast("double"))


def _blocks(ids: DataFrame, rows_per_block: int, most: int = 4096) -> list[int]:
    """Descending cut points of doc_id; at most ``most`` values reach the driver."""
    n = ids.count()
    k = min(most, -(-n // rows_per_block))
    if k < 2:
        return []
    return sorted({int(x) for x in ids.approxQuantile("doc_id", [i / k for i in range(1, k)], 0.25 / k)}, reverse=True)


def with_next(docs: DataFrame, rows_per_block: int = 2000) -> DataFrame:
    """(doc_id, text, fingerprint, next_text, next_fingerprint), next in descending doc_id; after the last: the first.

    Ids are cut into blocks at quantiles; each block is a window partition, and the first row of
    a block visits the block before it, so no task holds more than a block and each text is shuffled once.
    Rows of equal id follow each other by text, descending; null ids come last, dealt over blocks by a hash of the text
    and ordered by block. The rows of one id share a block, with their texts.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = d.select("doc_id").where("doc_id is not null")
    cuts = _blocks(ids, rows_per_block)
    # two levels, so that a row looks at about twice the square root of the number of cuts
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    if cuts:
        tops = F.array(*[F.lit(g[0]).cast("long") for g in groups])
        table = F.array(*[F.array(*[F.lit(x).cast("long") for x in g]) for g in groups])
        above = F.size(F.filter(tops, lambda c: c > F.col("doc_id")))
        inside = F.size(F.filter(F.get(table, above - 1), lambda c: c > F.col("doc_id")))
        block = F.when(above == 0, 0).otherwise((above - 1) * step + inside)
    else:
        block = F.lit(0)
    spare = min(4096, -(-d.where("doc_id is null").count() // rows_per_block))
    if spare:
        block = F.when(F.col("doc_id").isNull(), len(cuts) + 1 + F.pmod(F.xxhash64("text"), F.lit(spare))).otherwise(block)
    d = d.withColumn("block", block.cast("int"))
    # the largest id of each block and its largest text hash: one row per block, at most 8,193
    tag = F.xxhash64("text")
    heads = sorted((r["block"], r["head"], r["tag"]) for r in d.groupBy("block").agg(F.max("doc_id").alias("head"), F.max(tag).alias("tag")).collect())
    last = len(cuts) + 1 + spare
    head_of, tag_of, host_of = [None] * last, [None] * last, [0] * last
    for (b, h, g), (p, _, _) in zip(heads, heads[-1:] + heads[:-1]):
        head_of[b], tag_of[b], host_of[b] = h, g, p
    head, first_tag = (F.get(F.array(*[F.lit(x).cast("long") for x in v]), F.col("block")) for v in (head_of, tag_of))
    host = F.get(F.array(*[F.lit(x) for x in host_of]), F.col("block"))
    d = add_fingerprint(d, F.col("text"), "fingerprint")
    visits = F.col("doc_id").eqNullSafe(head) & (F.col("doc_id").isNotNull() | (tag == first_tag))
    own = F.struct(F.col("block").alias("b"), F.lit(False).alias("guest"))
    d = d.withColumn("place", F.explode(F.when(visits, F.array(own, F.struct(host.alias("b"), F.lit(True).alias("guest")))).otherwise(F.array(own))))
    order = Window.partitionBy("b").orderBy("guest", F.desc_nulls_last("doc_id"), F.when(F.col("doc_id").isNull(), tag).desc(), F.desc("text"))
    d = d.select("doc_id", "text", "fingerprint", F.col("place.b").alias("b"), F.col("place.guest").alias("guest"))
    d = d.withColumn("next_text", F.lead("text").over(order)).withColumn("next_fingerprint", F.lead("fingerprint").over(order))
    return d.where("not guest").drop("guest", "b")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The edited text is the text with its last floor(n/2) code points replaced by the first as many
    (or all) of the next document, in descending doc_id. A null text counts as empty. A table of one row is its own next.
    Of rows without an id and with unlike texts the order is fixed but arbitrary.
    """
    d = with_next(docs)
    n = F.length("text").cast("long")
    # the rows of a shuffle are dealt by block; nothing below needs another exchange
    d = d.withColumn("n_chars", n).withColumn("edited", F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"), F.expr("left(coalesce(next_text, ''), cast(floor(length(text) / 2) as int))")))
    d = d.select("doc_id", "n_chars", "fingerprint", "next_fingerprint", "edited", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    d = add_fingerprint(d, F.col("edited"), "edited_fingerprint")
    return d.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
