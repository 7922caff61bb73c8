"""Exact join of word-shingle sets by Jaccard similarity, found through shared segments.

Signatures (partition of the universe, pigeonhole). Sets are grouped in bands by size. In
each band the universe of shingle hashes is cut into ``m`` ranges; a set's shingles in one
range are a segment. Two sets of sizes a and b with similarity of at least 3/4 differ in at
most H = (a + b) // 7 shingles, so at most H segments differ and the others are identical.

Cost-based allocation. A set need not index all its segments: any order of segments that
all sets share will do, if each indexes its H + 1 first ones (of the segments that two
similar sets have in common, the first in that order is preceded by at most H others in
either set). The order is by cost: the frequency, in a bounded sample, of the segment's
rarest shingle, so segments of boilerplate alone come last and are mostly skipped; empty
segments come after all others and are only indexed by the few sets that run out of others.

One-deletion neighbourhoods. A segment that also indexes its one-deletion variants stands
for two differences at the cost of a row per shingle. That pays for the smallest sets
(under ``TINY`` shingles: at most one difference), whose only segment is the whole set.

A set of a band whose least size is L indexes L // 20 segments more than it must, so similar
sets have that many more signatures in common: sets with fewer signatures that any other set
has, and sets with too few shingles that any other candidate has, drop out. The others are
compared exactly, first with the least and greatest member of each signature. Members of one
signature that are still in different components are paired by their rarest shingles, and
compared too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_utf8, mix, pieces, staged
from .components import components
from .words import segment_sums, shingle_sets

TINY = 7
SAMPLE_ROWS = 4000  # documents from which shingle frequencies are estimated
SAMPLE_COMMON = 5  # documents of the sample that share a shingle for it to count as common
COMMON_LIMIT = 50_000  # common shingles that are shipped to the tasks; only their order depends on it
ENTRIES = 2_000_000  # signature entries handled by one task
FLUSH = 500_000
BROADCAST_ROWS = 500_000

_SEED = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(0xD1B54A32D192ED03)


def band_floor(sizes: np.ndarray) -> np.ndarray:
    """The least size of each size's band: 1, then 7, 14, 28, ..."""
    octave = np.floor(np.log2(np.maximum(sizes, TINY) / TINY)).astype(np.int64)
    return np.where(sizes < TINY, 1, TINY << octave)


def segments_of_band(floor: np.ndarray) -> np.ndarray:
    """A quarter more ranges than a set of the band can need, so that costly ones can be skipped."""
    return np.where(floor < TINY, 1, 5 * floor // 6 + 9)


def more_than_needed(floor):
    """How many more segments than it must a set of the band indexes."""
    return floor // 20


def _marked(signature: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """The signature with the number of its band in its last six bits, 0 for tiny sets."""
    number = np.where(floor < TINY, 0, 1 + np.log2(np.maximum(floor, TINY) / TINY)).astype(np.uint64)
    return (signature & ~np.uint64(63)) | number


def _variants(values: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of whole tiny sets and of their one-deletion variants, with the rows they belong to.

    Whole sets and variants meet, variants of two sets do not: a variant that equals another's
    variant stands for two differences. They are told apart when candidates are compared.
    """
    spread = mix(values ^ _SEED)
    total = segment_sums(spread, starts)
    size = np.diff(starts)
    signature, owner = [mix(total[rows])], [rows]
    wide = rows[size[rows] > 3]  # smaller sets are only similar to equal or larger ones
    if len(wide):
        owner_of = np.repeat(wide, size[wide])
        at = np.concatenate([np.arange(starts[r], starts[r + 1]) for r in wide])
        signature.append(mix(total[owner_of] - spread[at]))
        owner.append(owner_of)
    return _marked(np.concatenate(signature), np.ones(1, np.int64)), np.concatenate(owner)


def _prefixes(values, starts, rows, floor, need, common, frequency) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the ``need`` cheapest segments of the sets ``rows`` in the bands ``floor``."""
    size = (starts[1:] - starts[:-1])[rows]
    count = segments_of_band(floor)
    owner = np.repeat(np.arange(len(rows)), size)
    begin = np.cumsum(size) - size
    value = values[np.arange(len(owner)) + np.repeat(starts[rows] - begin, size)]
    segment = ((value >> np.uint64(32)) * count[owner].astype(np.uint64)) >> np.uint64(32)
    edge = np.ones(len(owner), bool)
    edge[1:] = (owner[1:] != owner[:-1]) | (segment[1:] != segment[:-1])
    at = np.flatnonzero(edge)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    content = segment_sums(mix(value ^ _SEED), np.append(at, len(value)))
    owner, segment = owner[at], segment[at]
    band = floor[owner].astype(np.uint64) << np.uint64(32)
    signature = _marked(mix(content ^ mix(band | segment)), floor[owner])
    if len(common):
        place = np.minimum(np.searchsorted(common, value), len(common) - 1)
        cost = np.minimum.reduceat(np.where(common[place] == value, frequency[place], 0), at).astype(np.uint64)
    else:
        cost = np.zeros(len(at), np.uint64)
    rank = (np.minimum(cost, np.uint64(0xFFFF)) << np.uint64(48)) | (signature >> np.uint64(16))
    order = np.argsort(rank)
    order = order[np.argsort(owner[order].astype(np.uint16 if len(rows) < 1 << 16 else np.int64), kind="stable")]
    need = need + more_than_needed(floor)
    have = np.bincount(owner, minlength=len(rows))
    begin = np.cumsum(have) - have
    position = np.arange(len(order)) - begin[owner[order]]
    chosen = order[position < need[owner[order]]]
    out, of = [signature[chosen]], [rows[owner[chosen]]]
    for r in np.flatnonzero(have < need):  # sets that run out of segments also index empty ones
        taken = segment[owner == r]
        empty = np.setdiff1d(np.arange(count[r], dtype=np.uint64), taken)[: need[r] - have[r]]
        out.append(_marked(mix(_EMPTY ^ mix((np.uint64(floor[r]) << np.uint64(32)) | empty)), floor[r : r + 1]))
        of.append(np.full(len(empty), rows[r]))
    return np.concatenate(out), np.concatenate(of)


def signatures(values, starts, common, frequency) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of the sets given by ``shingle_sets``, with the row of the set each belongs to."""
    size = np.diff(starts)
    floor = band_floor(size)
    tiny = np.flatnonzero((size > 0) & (size < TINY + 1))  # 7 shingles: as partner of 6
    out = [_variants(values, starts, tiny)]
    # In its own band a set meets partners of up to 4/3 of its size, those of the next band too.
    rows = np.flatnonzero(size >= TINY)
    largest = 4 * size[rows] // 3
    out.append(_prefixes(values, starts, rows, floor[rows], (size[rows] + largest) // 7 + 1, common, frequency))
    # One of at most 4/3 of the band's least size also meets smaller ones of the band before.
    rows = np.flatnonzero((size >= 2 * TINY) & (3 * size <= 4 * (floor - 1)))
    before = floor[rows] // 2
    out.append(_prefixes(values, starts, rows, before, (size[rows] + floor[rows] - 1) // 7 + 1, common, frequency))
    # 6 shingles meet 7 and 8 in the band of 7 with up to two differences.
    rows = np.flatnonzero(size == TINY - 1)
    out.append(_prefixes(values, starts, rows, np.full(len(rows), TINY), np.full(len(rows), 3), common, frequency))
    return np.concatenate([s for s, _ in out]), np.concatenate([r for _, r in out])


def digests(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums by which equal sets are recognised."""
    high = segment_sums(mix(values ^ np.uint64(0xA0761D6478BD642F)), starts)
    low = segment_sums(mix(values ^ np.uint64(0xE7037ED1A0B428DB)), starts)
    return mix(high).view(np.int64), mix(low).view(np.int64)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        values, starts = shingle_sets(*as_utf8(batch.column("text")))
        high, low = digests(values, starts)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(starts)), pa.array(high), pa.array(low)],
            names=["doc_id", "n_shingles", "high", "low"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        values, starts = shingle_sets(*as_utf8(batch.column("text")))
        high, low = digests(values, starts)
        shingles = pa.LargeListArray.from_arrays(pa.array(starts), pa.array(values.view(np.int64))).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(high), pa.array(low), shingles], names=["high", "low", "shingles"])


def _with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        high, low = digests(*shingle_sets(*as_utf8(batch.column("text"))))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row"), pa.array(high), pa.array(low)], names=["doc_id", "row", "high", "low"])


def _entries(parts: int, common: np.ndarray, frequency: np.ndarray):
    """Signature entries (signature, low digest), packed into one row for each part they go to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            signature = np.concatenate([s for s, _ in held])
            key = np.concatenate([k for _, k in held])
            part = (signature % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
            both = np.stack([signature[order], key[order]], axis=1)
            ends = np.cumsum(np.bincount(part, minlength=parts)) * 16
            used = np.flatnonzero(np.diff(ends, prepend=0))
            blob = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(used), [None, pa.py_buffer(np.append(0, ends[used])), pa.py_buffer(both)])
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), blob.cast(pa.binary())], names=["part", "entries"])

        for batch in pieces(batches):
            values, starts = shingle_sets(*as_utf8(batch.column("text")))
            _, low = digests(values, starts)
            _, first = np.unique(low, return_index=True)
            keep = np.zeros(len(low), bool)
            keep[first] = True  # copies in one piece give their signatures once
            signature, row = signatures(values, starts, common, frequency)
            wanted = keep[row]
            held.append((signature[wanted], low.view(np.uint64)[row[wanted]]))
            size += len(held[-1][0])
            if size >= FLUSH:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries whose signature belongs to more than one set."""
    blobs = [x.as_py() for batch in batches for x in batch.column("entries")]
    if not blobs:
        return
    both = np.frombuffer(b"".join(blobs), np.uint64).reshape(-1, 2)
    del blobs
    order = np.argsort(both[:, 0])
    signature, key = both[order, 0], both[order, 1]
    same = signature[1:] == signature[:-1]
    member = np.zeros(len(signature), bool)
    member[1:] |= same
    member[:-1] |= same
    signature, key = signature[member], key[member]
    order = np.lexsort((key, signature))
    signature, key = signature[order], key[order]
    if not len(signature):
        return
    new = np.ones(len(signature), bool)
    new[1:] = (signature[1:] != signature[:-1]) | (key[1:] != key[:-1])
    signature, key = signature[new], key[new]
    same = signature[1:] == signature[:-1]
    member = np.zeros(len(signature), bool)
    member[1:] |= same
    member[:-1] |= same
    signature, key = signature[member], key[member]
    for at in range(0, len(signature), 200_000):
        yield pa.RecordBatch.from_arrays(
            [pa.array(signature[at : at + 200_000].view(np.int64)), pa.array(key[at : at + 200_000].view(np.int64))],
            names=["signature", "low"])


def _common_shingles(docs: DataFrame, described: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of many different sets of a bounded sample, ascending, and in how many they are.

    They only decide which segments are indexed first; any estimate gives the same pairs.
    """
    sample = described.where("n_shingles > 0").groupBy("high", "low").agg(F.min(F.struct(F.xxhash64("low"), "doc_id")).alias("s"))
    sample = sample.select("s.doc_id", F.col("s.col1").alias("h")).orderBy("h").limit(SAMPLE_ROWS).select("doc_id")
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id", "left_semi")
    counted = (
        texts.mapInArrow(_sets, "high long, low long, shingles array<long>").dropDuplicates(["high", "low"])
        .select(F.explode("shingles").alias("x")).groupBy("x").count().where(F.col("count") >= SAMPLE_COMMON)
        .orderBy(F.desc("count"), "x").limit(COMMON_LIMIT)
    )
    found = counted.toPandas().sort_values("x")
    values, frequency = found["x"].to_numpy(np.int64).view(np.uint64), found["count"].to_numpy(np.int64)
    order = np.argsort(values)
    return values[order], frequency[order]


def _similar(a: str, b: str):
    """Whether 7 * intersection >= 3 * (size + size), which is 100 * intersection >= 75 * union."""
    common = F.size(F.array_intersect(F.col(a), F.col(b)))
    return 7 * common >= 3 * (F.size(a) + F.size(b))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of set numbers whose sets are similar."""
    left = sets.select(F.col("set").alias("b"), F.col("shingles").alias("y"))
    right = sets.select(F.col("set").alias("a"), F.col("shingles").alias("x"))
    return pairs.join(left, "b").join(right, "a").where(_similar("x", "y")).select("a", "b")


def _prefix_pairs(apart: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets of different components that may be similar: prefixes and positions.

    Shingles are ordered by how many of these sets have them, rare ones first. The first
    shingle that two similar sets share is among the first size - ceil(3/4 size) + 1 of each,
    and what follows it in both is long enough for the overlap they need. One side is never
    in the component that most sets belong to, so that it is not compared with itself.
    """
    largest = apart.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1).select(
        F.col("component").alias("largest"))
    shingles = sets.join(apart, "set").select("set", apart["size"], "component", F.explode("shingles").alias("x"))
    shingles = staged(shingles, "apart-shingles")
    often = shingles.groupBy("x").agg(F.count("*").alias("n"))
    by_rarity = Window.partitionBy("set").orderBy("n", "x")
    placed = shingles.join(often, "x").withColumn("place", F.row_number().over(by_rarity))
    prefix = F.col("size") - F.ceil(3 * F.col("size") / 4) + 1
    placed = staged(placed.where((F.col("place") <= prefix) & (F.col("n") > 1)).select("x", "set", "size", "component", "place"), "prefixes")
    a = placed.join(F.broadcast(largest), F.col("component") == F.col("largest"), "left_anti").alias("a")
    b = placed.join(F.broadcast(largest), F.col("component") == F.col("largest"), "left").withColumn("in_largest", F.col("largest").isNotNull()).alias("b")
    after = F.least(F.col("a.size") - F.col("a.place"), F.col("b.size") - F.col("b.place")) + 1
    pairs = a.join(
        b, (F.col("a.x") == F.col("b.x")) & (F.col("a.component") != F.col("b.component"))
        & (F.col("b.in_largest") | (F.col("a.set") < F.col("b.set")))
        & (7 * after >= 3 * (F.col("a.size") + F.col("b.size"))))
    return pairs.select(F.least("a.set", "b.set").alias("a"), F.greatest("a.set", "b.set").alias("b")).distinct()


def _grouped(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and the set's digests for every row."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    described = staged(docs.mapInArrow(_describe, "doc_id long, n_shingles long, high long, low long"), "sets")
    total, most = described.agg(F.sum("n_shingles"), F.max("n_shingles")).first()
    classes = described.where("n_shingles > 0").groupBy("high", "low").agg(
        F.min("doc_id").alias("set"), F.max("n_shingles").alias("size"), F.count("*").alias("copies"))
    if not total:
        return described.withColumn("component_id", F.col("doc_id"))
    classes = staged(classes, "classes")

    common, frequency = _common_shingles(docs, described)
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(0.45 * total / ENTRIES))
    entries = docs.mapInArrow(_entries(8 * width, common, frequency), "part int, entries binary")
    shared = staged(entries.repartition(width, "part").mapInArrow(_shared, "signature long, low long"), "shared")

    # A set must have so many signatures of one band in common with others.
    for _ in range(2):
        band = F.col("signature").bitwiseAND(63).cast("int")
        extra = F.when(band > 0, F.floor(TINY * F.pow(F.lit(2.0), band - 1) / 20)).otherwise(0)
        enough = shared.groupBy("low", band.alias("band")).agg(F.count("*").alias("n"), F.max(extra).alias("extra"))
        enough = enough.where("n > extra").select("low", "band")
        kept = shared.withColumn("band", band).join(enough, ["low", "band"]).select("signature", "low")
        several = kept.groupBy("signature").agg(F.count("*").alias("n")).where("n > 1").select("signature")
        shared = staged(kept.join(several, "signature"), "shared")

    # Candidate sets by number; a low digest that two sets share stands for both.
    wanted = classes.join(shared.select("low").distinct(), "low").select("high", "low", "set", "size")
    wanted = staged(wanted.where(F.col("set").isNotNull()), "candidates")
    ids = wanted.select(F.col("set").alias("doc_id"))
    if wanted.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    sets = (
        docs.join(ids, "doc_id", "left_semi").mapInArrow(_sets, "high long, low long, shingles array<long>")
        .join(wanted, ["high", "low"]).groupBy("set", "size", "low").agg(F.first("shingles").alias("shingles"))
    )
    sets = staged(sets, "shingles")

    # A set can only be linked if three quarters of its shingles occur in other candidates too.
    exploded = sets.select("set", F.explode("shingles").alias("x"))
    own = exploded.groupBy("x").agg(F.count("*").alias("n"), F.first("set").alias("set")).where("n = 1")
    own = own.groupBy("set").agg(F.count("*").alias("own"))
    shared_count = F.col("size") - F.coalesce("own", F.lit(0))
    viable = sets.select("set", "size", "low").join(own, "set", "left").withColumn("shared", shared_count)
    viable = staged(viable.where(4 * F.col("shared") >= 3 * F.col("size")).select("set", "size", "low", "shared"), "viable")
    sets = sets.join(viable.select("set"), "set", "left_semi")
    runs = staged(shared.join(viable, "low").select("signature", "set", "size", "shared"), "runs")

    hubs = runs.groupBy("signature").agg(F.min("set").alias("least"), F.max("set").alias("most")).where("least < most")
    stars = runs.join(hubs, "signature").select(F.col("set").alias("b"), F.explode(F.array("least", "most")).alias("a"))
    stars = stars.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = staged(_verified(stars, sets), "links")
    found = components(links)

    # Members of one signature that are still apart.
    named = runs.join(found.withColumnRenamed("node", "set"), "set", "left").withColumn("component", F.coalesce("component", "set"))
    apart = named.groupBy("signature").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most")
    apart = named.join(apart.select("signature"), "signature", "left_semi").select("set", "size", "component").distinct()
    rest = _prefix_pairs(staged(apart, "apart"), sets)
    more = staged(_verified(rest.join(stars, ["a", "b"], "left_anti"), sets), "links")
    if more.limit(1).count():
        found = components(links.unionAll(more))

    named = classes.join(found, F.col("set") == F.col("node"), "left").select(
        "high", "low", F.coalesce("component", "set").alias("component_id"))
    out = described.join(named, ["high", "low"], "left")
    return out.withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")))


def similar_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text, ...).

    Rows are linked where their sets of distinct 5-word shingles (A-Z lower-cased, words
    between spaces and U+0009..U+000D) have a Jaccard similarity of 0.75 or more; fewer
    words than five are one shingle. ``component_id`` is the least doc_id that links reach.
    Null, empty or blank texts have no shingles and form a component each. Rows with an equal
    doc_id stay separate rows. Texts whose every copy has a null doc_id are not compared with
    different ones, and their component is null. Other columns are ignored. Any number of
    copies costs one member of each group.
    """
    return _grouped(docs).select("doc_id", "n_shingles", "component_id")


def one_per_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that come first in their component, all columns kept.

    That is the document whose doc_id names the component, so every group keeps one. Rows with a
    null doc_id all stay. Where a doc_id is repeated, each of its different texts is judged by
    itself, and one row of equal texts stays.
    """
    groups = staged(_grouped(docs), "groups")
    repeated = groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    gone = groups.where("component_id <> doc_id").select("doc_id").unionAll(repeated).distinct()
    gone = staged(gone, "gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    single = docs.join(gone, "doc_id", "left_anti")
    repeated = staged(repeated, "repeated")
    if not repeated.limit(1).count():
        return single.select(docs.columns)
    first = groups.where("component_id = doc_id").select("doc_id", "high", "low").join(repeated, "doc_id", "left_semi").distinct()
    again = docs.join(repeated, "doc_id", "left_semi")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    again = again.select("doc_id", "text", row.alias("row")).mapInArrow(
        _with_digest, again.select("doc_id", row.alias("row"), F.lit(0).cast("long").alias("high"), F.lit(0).cast("long").alias("low")).schema)
    again = again.groupBy("doc_id", "high", "low").agg(F.first("row").alias("row")).join(first, ["doc_id", "high", "low"], "left_semi")
    return single.select(docs.columns).unionAll(again.select("row.*"))
