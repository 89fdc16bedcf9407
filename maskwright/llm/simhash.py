"""Near-duplicates by SimHash fingerprints, found with an index over positional bytes.

Two 64-bit fingerprints that differ in at most 3 bits differ in at most 3 of their 8 bytes, so they
share at least 5 bytes position by position: the count filter's guaranteed minimum. An index over
single bytes would list a 256th of all fingerprints under each entry, which grows with the square
of the input. Entries are therefore the joint bytes of 3 positions, all within the first four or all
within the last four: any 5 shared positions have 3 in one half, so these 8 entries (the smallest
family of that kind) miss no pair. The pair's shared bytes are then tallied; a pair under the
minimum goes; one that shares several entries is kept at the first only; the bits decide.

Copies share a fingerprint and are one class before any pair is made. Near copies of one text vary
in the few bits whose vote is close, so distinct fingerprints of a large group stay few; entries
that are still long (``LONG`` or more) are split exactly: of the other 5 bytes at least 2 are
shared, so their pairs meet again under one of the 10 entries that add two more positions.

``without_near_duplicates`` asks for another likeness: a Jaccard of 0.8 or more over the sets of five-word
shingles. There a 64-bit fingerprint differs in about 10 bits, so no byte need be shared. Its fingerprints are
therefore longer, 160 positional bytes, of which such a pair shares 40 or more on average and 14 all but surely (see
``PRINT``). The index has the joint bytes of two positions among each four that stand together; shared bytes
are tallied over the whole fingerprint, and what has the minimum is compared by its exact sets. Entries that
many sets have are first compared with a few of them, which joins large groups; what stays apart there is
compared by an inverted index over each set's rarest shingles, with the counts that such pairs must reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.common import Scratch, extended, in_arrow, join_unique, texts, written

#: Differing bits up to which fingerprints link.
BITS = 3
#: Bytes that such fingerprints share, position by position.
SHARED = 8 - BITS
#: Byte positions that make an entry of the index.
ENTRIES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
#: Fingerprints under one entry from which it is split.
LONG = 512
#: Shingles hashed at a time, for very long texts.
RUN = 1 << 16
#: Words of a shingle, and Jaccard of shingle sets from which texts are near copies (as a fraction).
WORDS, ALIKE = 5, (4, 5)
#: Words of 64 bits in a long fingerprint. At a Jaccard of 0.8 a bit differs in 0.152 of all pairs of large sets and in
#: up to 0.158 of those of more than ``FEW`` shingles; so a byte is shared by 0.25 and one of the six entries of each
#: four bytes by 0.27: one pair in 200,000 is expected to have no entry in common, at worst. Smaller sets, of which up
#: to 0.188 of the bits differ (5 shingles and 4 of them), get more words.
PRINT, PRINT_OF_FEW, FEW = 20, 32, 24
#: Byte positions of a word that make an entry of the long fingerprint's index.
JOINT = [*combinations(range(4), 2), *combinations(range(4, 8), 2)]
#: Bits of a long fingerprint's first two words in which near copies may differ, and bytes of all words that they share.
LONG_BITS, LONG_SHARED = 44, 14
#: Sets under one entry from which it is a crowded one, beside what chance deals to each (by ``CHANCE`` times).
CROWDED, CHANCE = 64, 4
#: Members of a crowded entry with which all others are compared first.
HEADS = 3
#: Sets under one shingle that meet in a task.
TOGETHER = 2048
#: Buckets of shingles, by which their frequency is told.
BUCKETS = 1 << 18
#: Odd multipliers, one for each word of a long fingerprint.
MULTIPLIERS = np.random.default_rng(5).integers(0, 1 << 64, PRINT_OF_FEW, dtype=np.uint64) | np.uint64(1)


def shingle_runs(text: str, words: int, seed: int = 42) -> Iterator[np.ndarray]:
    """Hashes of a whole text's shingles, some at a time; a shorter text is one shingle, one without words has none."""
    w = text.encode().lower().split()  # on bytes: A-Z, and the six ASCII white-space characters
    n = max(1, len(w) - words + 1) if w else 0
    for at in range(0, n, RUN):
        some = w[at : min(at + RUN, n) + words - 1]
        shingles = map(b" ".join, zip(*(some[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
        yield np.array([xxhash.xxh64_intdigest(s, seed) for s in shingles], dtype="<u8")


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """The unsigned fingerprint of a whole text."""
    tally, n = np.zeros(64, dtype=np.int64), 0
    for hashed in shingle_runs(text, words, seed):
        tally += np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashed)
    return int(np.packbits(tally * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``docs`` with ``fp``, the fingerprint as a long of the same bits, for ``text``. Null text: 0."""
    docs = docs.drop("fp")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t, words) for t in texts(batch.column("text"))], dtype=np.uint64).view(np.int64)
        kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "text"]
        return pa.RecordBatch.from_arrays([*(c for _, c in kept), pa.array(fp)], names=[*(n for n, _ in kept), "fp"])

    schema = extended(docs.drop("text").schema, fp=T.LongType())
    return in_arrow(docs, work, schema)


def byte_at(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255))


def entry(fp: Column, number: int | Column, positions: tuple[int, ...]) -> Column:
    """A long of an entry's number and its bytes."""
    value = F.lit(number).cast("long")
    for p in positions:
        value = F.shiftleft(value, 8).bitwiseOR(byte_at(fp, p))
    return value


def entries(fps: DataFrame) -> DataFrame:
    """fp, kind (number of the entry's positions), key."""
    return fps.select("fp", F.posexplode(F.array(*(entry(F.col("fp"), i, p) for i, p in enumerate(ENTRIES)))).alias("kind", "key"))


def finer(rows: DataFrame) -> DataFrame:
    """Rows of long entries again, under each of the 10 entries with two more positions."""
    more = [[entry(F.col("fp"), j, two) for j, two in enumerate(combinations(sorted({*range(8)} - {*own}), 2))] for own in ENTRIES]
    arrays = F.array(*(F.array(*x) for x in more))
    return rows.select("fp", "kind", "key", F.posexplode(F.get(arrays, F.col("kind"))).alias("kind2", "key2"))


def matches(fp: Column, other: Column) -> Column:
    """Tally of shared positional bytes."""
    same = F.bitwise_not(fp.bitwiseXOR(other))
    return reduce(lambda a, b: a + b, [(byte_at(same, p) == 255).cast("int") for p in range(8)])


def shares(fp: Column, other: Column, positions: tuple[int, ...]) -> Column:
    mask = sum(255 << 8 * p for p in positions)
    return fp.bitwiseXOR(other).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)) == 0


def first_shared(fp: Column, other: Column, families: list[tuple[int, ...]]) -> Column:
    """Number of the first entry that two fingerprints share."""
    return F.coalesce(*(F.when(shares(fp, other, p), F.lit(i)) for i, p in enumerate(families)))


def links(fps: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """a < b (as signed longs) for all distinct fingerprints of ``fps`` (fp) that link, each pair once."""
    keep = (scratch or Scratch(fps.sparkSession, "simhash-links")).keep
    own = keep(entries(fps))
    long = own.groupBy("kind", "key").agg(F.count("*").alias("n")).filter(F.col("n") >= LONG).select("kind", "key")
    a, b = F.col("a.fp"), F.col("b.fp")
    near = (a < b) & (matches(a, b) >= SHARED) & (F.bit_count(a.bitwiseXOR(b)) <= BITS)
    once = first_shared(a, b, ENTRIES) == F.col("a.kind")
    long = keep(long)
    if long.isEmpty():
        left = right = own
    else:
        left = right = own.join(long, ["kind", "key"], "left_anti")
    found = left.alias("a").join(right.alias("b"), (F.col("a.key") == F.col("b.key")) & near & once).select(a.alias("a"), b.alias("b"))
    if not long.isEmpty():
        again = finer(own.join(long, ["kind", "key"], "left_semi"))
        two = F.get(F.array(*(first_shared(a, b, [*combinations(sorted({*range(8)} - {*p}), 2)]) for p in ENTRIES)), F.col("a.kind"))
        keys = (F.col("a.key") == F.col("b.key")) & (F.col("a.key2") == F.col("b.key2"))
        found = found.unionByName(again.alias("a").join(again.alias("b"), keys & near & once & (two == F.col("a.kind2"))).select(a.alias("a"), b.alias("b")))
    return found


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """node, label (smallest node reachable) for the nodes of ``edges`` (a, b).

    Each round takes the smallest label of the neighbours and then the label's own label, so the
    rounds grow with the logarithm of a component's length. Every round is written to the shared
    folder. Labels meet by joins and partial minima; no node's neighbours are gathered anywhere, and
    the rows of a hub or of a large component's label stay where they are.
    """
    keep = (scratch or Scratch(edges.sparkSession, "components")).keep
    both = keep(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    degrees = keep(both.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("n")))
    ends = both.withColumnRenamed("b", "node")
    labels = keep(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")))
    while True:
        nearby = join_unique(ends, labels, "node", degrees).groupBy("a").agg(F.min("label").alias("least"))
        lower = labels.join(nearby, F.col("node") == F.col("a")).select("node", F.least("label", "least").alias("label"), F.col("label").alias("was"))
        lower = keep(lower)
        up = lower.select(F.col("node").alias("label"), F.col("label").alias("top"))
        jumped = join_unique(lower, up, "label", keep(lower.groupBy("label").agg(F.count("*").alias("n")))).select("node", F.least("label", "top").alias("label"), "was")
        jumped = keep(jumped)
        labels = jumped.select("node", "label")
        if jumped.filter("label <> was").isEmpty():
            return labels


def with_components(fps: DataFrame) -> DataFrame:
    """``fps`` (doc_id, fp, any more) with component_id, the smallest doc_id that links reach.

    Fingerprints, not documents, are grouped and linked. A null doc_id takes part in links but is
    never a component's id unless no other is there. An empty table gives none.
    """
    fps = fps.drop("component_id")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-distinct")
    scratch = Scratch(fps.sparkSession, "simhash")
    labels = written(components(links(distinct.select("fp"), scratch), scratch), "simhash-labels")
    scratch.drop()
    labelled = distinct.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    ids = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    found = written(labelled.join(ids, "label").select("fp", "component_id"), "simhash-found")
    return join_unique(fps, found, "fp", distinct.select("fp", "n"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs`` (doc_id, text)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fps = written(fingerprints(own), "simhash-fps")
    return with_components(fps).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str) -> np.ndarray:
    """The distinct hashes of a text's five-word shingles, ascending."""
    runs = list(shingle_runs(text, WORDS))
    return np.unique(np.concatenate(runs)) if runs else np.empty(0, dtype=np.uint64)


def long_print(hashes: np.ndarray) -> np.ndarray:
    """The long fingerprint of a shingle set: the majority of each bit; ties go by the word's least hash, which near copies mostly share."""
    n, words = len(hashes), PRINT_OF_FEW if len(hashes) <= FEW else PRINT
    if not n:
        return np.empty(0, dtype=np.uint64)
    tally, least = np.zeros(64 * words, dtype=np.int64), np.full(words, np.iinfo(np.uint64).max)
    for at in range(0, n, 255):  # so many fit a byte's tally
        mixed = hashes[at : at + 255, None] * MULTIPLIERS[:words]
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        bits = np.unpackbits(mixed.astype("<u8").view(np.uint8), axis=1, bitorder="little")
        np.minimum(least, mixed.min(axis=0), out=least)
        tally += np.add.reduce(bits, axis=0, dtype=np.uint8)
    ties = np.unpackbits((least * MULTIPLIERS[0] ^ least).astype("<u8").view(np.uint8), bitorder="little")
    return np.packbits(2 * tally + ties > n, bitorder="little").view("<u8").astype(np.uint64)


def as_longs(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.empty(0, np.uint64), *arrays]).view(np.int64)))


def flat(column: pa.ListArray) -> np.ndarray:
    """The hashes of all rows of a column that ``as_longs`` made."""
    return column.flatten().to_numpy().view(np.uint64)


def signed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``set_id`` (equal for equal shingle sets), ``print`` (the long fingerprint) and ``size`` in place of ``text``."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t) for t in texts(batch.column("text"))]
        ids = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
        kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "text"]
        new = [pa.array(ids), as_longs([long_print(s) for s in sets]), pa.array([len(s) for s in sets], pa.int32())]
        return pa.RecordBatch.from_arrays([*(c for _, c in kept), *new], names=[*(n for n, _ in kept), "set_id", "print", "size"])

    return in_arrow(docs, work, extended(docs.drop("text").schema, set_id=T.LongType(), print=T.ArrayType(T.LongType()), size=T.IntegerType()))


def shingle_sets(docs: DataFrame) -> DataFrame:
    """set_id, shingles (hashes) for ``docs`` (set_id, text)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("set_id"), as_longs([shingle_set(t) for t in texts(batch.column("text"))])], names=["set_id", "shingles"])

    return in_arrow(docs, work, "set_id long, shingles array<long>", rows=128)


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard of ``ALIKE`` or more, by the sets themselves."""
    both = pairs.join(sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("y")), "b")
    x, y = F.size("x"), F.size("y")
    return both.filter(F.size(F.array_intersect("x", "y")) >= least_shared(x, y)).select("a", "b")


def least_shared(x: Column, y: Column) -> Column:
    """Shingles that two sets of these sizes share if their Jaccard is ``ALIKE`` or more."""
    part, whole = ALIKE
    return F.ceil((x + y) * part / (part + whole))


def sizes_fit(x: Column, y: Column) -> Column:
    part, whole = ALIKE
    return whole * F.least(x, y) >= part * F.greatest(x, y)


def paired(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def rare_entries(sets: DataFrame) -> DataFrame:
    """set_id, label, size, place, shingle: the first shingles of each of ``sets`` (set_id, label, shingles), rarest first.

    They are so many as may be missing from a set that is alike, and one. All sets are ordered alike: by how many
    shingles fall into a shingle's bucket (``BUCKETS``, by its first bits), then by hash. Any such order finds
    all pairs; that by buckets needs no rows for the other shingles, and its table doesn't grow with the input.
    """
    part, whole = ALIKE
    buckets = lambda hashes: (hashes >> np.uint64(64 - (BUCKETS.bit_length() - 1))).astype(np.int64)

    def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            n += np.bincount(buckets(flat(batch.column("shingles"))), minlength=BUCKETS)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used])], names=["bucket", "n"])

    found = sets.select("shingles").mapInArrow(tally, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(BUCKETS, dtype=np.int64)
    often[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    shipped = sets.sparkSession.sparkContext.broadcast(often.tobytes())

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, sizes = flat(batch.column("shingles")), np.diff(batch.column("shingles").offsets.to_numpy()).astype(np.int64)
        of = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((hashes, np.frombuffer(shipped.value, np.int64)[buckets(hashes)], of))
        place = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        first = place <= sizes[of] * (whole - part) // whole
        rows = of[first]
        new = [pa.array(sizes[rows].astype(np.int32)), pa.array(place[first]), pa.array(hashes[order][first].view(np.int64))]
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows)) for c in ("set_id", "label")), *new], names=["set_id", "label", "size", "place", "shingle"])

    return in_arrow(sets.select("set_id", "label", "shingles"), work, "set_id long, label long, size int, place long, shingle long", rows=128)


def rare_pairs(own: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """a < b: every pair of ``own`` (set_id, label) with different labels whose sets may be alike, and few others.

    All shingles are ordered alike, the rarest first (``rare_entries``). Two sets that share enough have one
    of it among the first few of each: so many as may be missing, and one. The places of that shingle
    say how many more can follow, and pairs that can't reach the count go before their sets are read.
    A shingle that many sets hold in front is split, so that a task sees ``TOGETHER`` of them at a time.
    """
    keep = scratch.keep
    entries = keep(rare_entries(keep(sets.join(own, "set_id"))))
    counts = entries.groupBy("shingle", "label").agg(F.count("*").alias("n")).groupBy("shingle").agg(F.count("*").alias("labels"), F.sum("n").alias("all"), F.max(F.struct("n", "label"))["label"].alias("most")).filter("labels > 1")
    met = keep(entries.join(counts.select("shingle", "most", F.ceil(F.col("all") / TOGETHER).cast("int").alias("ways")), "shingle"))
    left = met.filter("label <> most").withColumn("way", F.pmod(F.xxhash64("set_id"), F.col("ways")).cast("int")).alias("a")
    right = met.withColumn("way", F.explode(F.sequence(F.lit(0), F.col("ways") - 1))).alias("b")
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    once = (a("label") != b("label")) & ((b("label") == b("most")) | (a("set_id") < b("set_id")))
    least = least_shared(a("size"), b("size"))
    enough = sizes_fit(a("size"), b("size")) & (F.least(a("size") - a("place"), b("size") - b("place")) >= least)
    return left.join(right, (a("shingle") == b("shingle")) & (a("way") == b("way")) & once & enough).select(*paired(a("set_id"), b("set_id"))).distinct()


def long_entries(prints: DataFrame) -> DataFrame:
    """The rows of ``prints`` (print, any more) with ``key``, once for each entry of the long fingerprint's index."""
    words = prints.select(*prints.columns, F.posexplode("print").alias("at", "word")).drop("print")
    keys = [entry(F.col("word"), F.col("at") * len(JOINT) + i, two) for i, two in enumerate(JOINT)]
    return words.select(*(c for c in prints.columns if c != "print"), F.explode(F.array(*keys)).alias("key"))


def long_matches(x: Column, y: Column) -> Column:
    """Tally of the positional bytes that two long fingerprints share, over the words that both have."""
    shared = F.zip_with(x, y, lambda a, b: F.coalesce(matches(a, b), F.lit(0)))
    return F.aggregate(shared, F.lit(0), lambda a, b: a + b)


def index_pairs(prints: DataFrame, crowded: DataFrame, scratch: Scratch, mixed: DataFrame | None = None) -> DataFrame:
    """a < b: pairs of ``prints`` (set_id, size, print, open, and label where sets are joined already) that share an entry
    and reach the count of shared bytes.

    Pairs of one label and pairs of which both are ``open`` are left out: the first are joined, the others are compared
    apart. Entries of ``crowded`` (key) are left out; ``mixed`` has the sets of those that are to be looked into (key,
    set_id, and the entry's main label ``most`` and number of sets ``n``), where one of a pair is not of the main label.
    """
    keep = scratch.keep
    if "label" not in prints.columns:
        prints = prints.withColumn("label", F.col("set_id"))
    own = prints.select("set_id", "size", "open", "label", F.col("print")[0].alias("w0"), F.col("print")[1].alias("w1"), "print")
    dealt = long_entries(own)
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    bits = F.bit_count(a("w0").bitwiseXOR(b("w0"))) + F.bit_count(a("w1").bitwiseXOR(b("w1")))
    near = (a("label") != b("label")) & (bits <= LONG_BITS) & sizes_fit(a("size"), b("size")) & ~(a("open") & b("open"))
    rest = dealt if crowded.isEmpty() else dealt.join(crowded.select("key"), "key", "left_anti")
    met = rest.alias("a").join(rest.alias("b"), (a("key") == b("key")) & (a("set_id") < b("set_id")) & near).select(a("set_id").alias("a"), b("set_id").alias("b"))
    if mixed is not None:
        some = mixed.withColumn("ways", F.ceil(F.col("n") / TOGETHER).cast("int")).join(own.drop("print"), "set_id")
        left = some.filter("label <> most").withColumn("way", F.explode(F.sequence(F.lit(0), F.col("ways") - 1))).alias("a")
        right = some.withColumn("way", F.pmod(F.xxhash64("set_id"), F.col("ways")).cast("int")).alias("b")
        once = (b("label") == b("most")) | (a("set_id") < b("set_id"))
        met = met.unionByName(left.join(right, (a("key") == b("key")) & (a("way") == b("way")) & once & near).select(*paired(a("set_id"), b("set_id"))))
    met = keep(met.distinct())
    both = met.join(prints.select(F.col("set_id").alias("a"), F.col("print").alias("x")), "a").join(prints.select(F.col("set_id").alias("b"), F.col("print").alias("y")), "b")
    return keep(both.filter(long_matches(F.col("x"), F.col("y")) >= LONG_SHARED).select("a", "b"))


def near_sets(own: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """node, label (smallest set_id reachable) for the sets of ``own`` that have near copies.

    ``own``: file, row, set_id, print, size. ``rows``: file, row, text. Sets of fewer than 4 shingles are near
    copies of equal sets only. A set that has crowded entries is first compared with ``HEADS`` others, of those that
    have the most crowded entries: such stand in the middle of their group, which so is joined by few pairs. Where
    all but ``CROWDED`` sets of each of a group's entries are joined, the others are compared with all, no more than so
    many for each set; the sets of other crowded entries are compared as ``rare_pairs`` says, which passes over none
    that are alike. All other pairs come from the other entries of the index (``index_pairs``).
    """
    keep = scratch.keep
    distinct = keep(own.groupBy("set_id").agg(F.min(F.struct("file", "row")).alias("at"), F.first("print").alias("print"), F.first("size").alias("size")))
    prints = distinct.filter("size > 3").select("set_id", "size", "print")
    crowd = CROWDED + CHANCE * prints.count() // (1 << 16)

    def read(wanted: DataFrame) -> DataFrame:
        places = keep(distinct.join(wanted.distinct(), "set_id", "left_semi").select("set_id", "at.file", "at.row"))
        return keep(shingle_sets(rows.join(places, ["file", "row"]).select("set_id", "text")))

    counts = long_entries(prints.select("print")).groupBy("key").agg(F.count("*").alias("n"))
    crowded = keep(counts.filter(F.col("n") >= crowd))
    links = mixed = None
    if crowded.isEmpty():
        prints = prints.withColumn("open", F.lit(False))
    else:
        members = join_unique(long_entries(prints), crowded, "key", crowded, "left_semi").select("key", "set_id", "size")
        members = keep(members.withColumn("often", F.count("*").over(Window.partitionBy("set_id"))))
        headed = keep(members.groupBy("key").agg(F.max(F.struct("often", F.xxhash64("set_id").alias("tie"), "set_id", "size")).alias("h")))
        first = join_unique(members.drop("often"), headed, "key", crowded).filter((F.col("set_id") != F.col("h.set_id")) & sizes_fit(F.col("size"), F.col("h.size")))
        first = first.groupBy("set_id").agg(F.slice(F.sort_array(F.collect_set("h"), asc=False), 1, HEADS).alias("heads"))
        first = keep(first.select("set_id", F.explode("heads.set_id").alias("head")).select(*paired(F.col("set_id"), F.col("head"))).distinct())
        links = keep(alike(first, read(first.select(F.explode(F.array("a", "b")).alias("set_id")))))
        labels = keep(components(links, scratch))
        labelled = keep(prints.join(labels, F.col("set_id") == F.col("node"), "left").select("set_id", "size", "print", F.coalesce("label", "set_id").alias("label")))
        by_label = members.join(labelled.select("set_id", "label"), "set_id").groupBy("key", "label").agg(F.count("*").alias("n"))
        kinds = keep(by_label.groupBy("key").agg(F.sum("n").alias("n"), F.max("n").alias("main"), F.max(F.struct("n", "label"))["label"].alias("most")).filter("n > main"))
        wide = kinds.filter(F.col("n") - F.col("main") > CROWDED).select("most").distinct().withColumn("wide", F.lit(True))
        looked = keep(join_unique(members.select("key", "set_id"), keep(kinds.join(wide, "most", "left").select("key", "most", "n", "wide")), "key", crowded))
        mixed = looked.filter("wide is null").drop("wide")
        open_ = keep(looked.filter("wide").select("set_id").distinct())
        prints = keep(labelled.join(open_.withColumn("there", F.lit(True)), "set_id", "left").select("set_id", "size", "print", "label", F.coalesce("there", F.lit(False)).alias("open")))
        if not open_.isEmpty():
            sets = read(open_)
            links = links.unionByName(keep(alike(rare_pairs(keep(prints.filter("open").select("set_id", "label")), sets, scratch), sets)))
    pairs = index_pairs(prints, crowded, scratch, mixed)
    found = keep(alike(pairs, read(pairs.select(F.explode(F.array("a", "b")).alias("set_id")))))
    return components(found if links is None else found.unionByName(links), scratch)


def placed(docs: DataFrame) -> DataFrame:
    """``docs`` as row, file, row number and text: the place of a row in the file it is read from.

    A place stays the same however files are split or executors come and go. What isn't read straight
    from Parquet files is written first.
    """
    place = [F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    rows = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    try:
        return docs.select(*rows, *place)
    except AnalysisException:
        return written(docs, "near-docs").select(*rows, *place)


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies in ``docs``: the smallest doc_id, of equal ones the first read.

    Near copies have five-word shingle sets with a Jaccard of 0.8 or more (case of A-Z and white space
    aside; a text of fewer words is one shingle); groups are what such pairs connect. Texts without words,
    null and empty ones among them, are one group, and of repeated rows one stays. A null doc_id stays only
    where its group has no other. Texts are read whole; an empty table gives none; columns of any name pass.
    """
    rows = placed(docs)
    own = written(signed(rows.select("doc_id", "text", "file", "row")), "near-signed")
    scratch = Scratch(docs.sparkSession, "near-sets")
    labels = written(near_sets(own, rows.select("file", "row", "text"), scratch), "near-labels")
    scratch.drop()
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "file", "row")).alias("first")
    least = own.groupBy("set_id").agg(first).join(labels, F.col("set_id") == F.col("node"), "left")
    kept = written(least.groupBy(F.coalesce("label", "set_id")).agg(F.min("first").alias("first")).select("first.file", "first.row"), "near-kept")
    return rows.select("whole", "file", "row").join(kept.hint("shuffle_hash"), ["file", "row"], "left_semi").select("whole.*")
