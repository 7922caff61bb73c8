"""Phrases whose words occur together more often than apart, by top-order marginalisation.

Words and the four that lead on from them form windows, padded where a piece of text ends. Only
these longest windows are counted; a ROLLUP over their columns then sums successively shorter
prefixes, and as every phrase begins exactly one window where it occurs, the sums are the counts of
all phrases of one to five words. No text is exploded into phrases of each length.

Windows need not reach beyond words that are too rare to be a phrase's. What begins at a word is
counted beforehand in hashed slots, which can only count too many: words and pairs in one reading,
what is longer and made of frequent pairs in another. A task adds up chunks of slots; three bytes for each
slot that occurs in a piece of text are shuffled. Slots that reach the least count are a bitmap (a
bit for each slot, at most ``MOST_SLOTS``); a window is padded after the words whose slots all do, and a rare
word is an empty window. That shortens windows no phrase needs, and leaves all counts that
are asked for as they are; where slots get too few for the corpus, less is shortened and nothing is
lost.

A task adds up equal windows of all it reads, so as many are shuffled as there are different ones in
each task. A task for each core, or for each ``TASK_BYTES`` of text where that makes more, reads them, however
many splits the files have: with the input the different windows get more, but not also the tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_utf8, mix, pieces, staged
from .words import word_hashes

LONGEST = 5
LEAST = 100
TOP = 2000
TEXT_BYTES = 4 << 20  # text that a task looks at together
LEAST_SLOTS, MOST_SLOTS = 1 << 16, 1 << 30
WORDS_PER_SLOT = 8
HELD_ROWS = 1_000_000  # windows that a task holds to combine equal ones
TASK_BYTES = 256 << 20  # text of a task that combines windows, on a cluster of few cores
RANKED_TOGETHER = 100_000
NO_LANGUAGE = "und"
_NEXT = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 16  # slots that are counted and shuffled together

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_KIND = np.zeros(256, np.uint8)  # 0: of a word, 1: between words, 2: ends a piece
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2


class Words:
    """The words of a batch of texts: numbers into a dictionary, and which are followed by the next."""

    def __init__(self, batch: pa.RecordBatch):
        data, offsets = as_utf8(batch.column("text"))
        low = _LOWER[data]
        kind = _KIND[low]
        inside = kind == 0
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        begins = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[begins] = inside[begins]
        last[begins[1:] - 1] = inside[begins[1:] - 1]
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        breaks = np.zeros(len(low) + 1, np.int64)
        np.cumsum(kind == 2, out=breaks[1:])
        row = np.searchsorted(offsets, begin, side="right") - 1
        self.leads = np.zeros(len(begin), bool)
        self.leads[:-1] = (row[1:] == row[:-1]) & (breaks[begin[1:]] == breaks[end[:-1]])
        at = np.zeros(len(begin) + 1, np.int64)
        np.cumsum(end - begin, out=at[1:])
        own = np.ascontiguousarray(low[inside])
        texts = pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(at), pa.py_buffer(own)])
        coded = texts.dictionary_encode()
        self.word, self.names = coded.indices.to_numpy(), coded.dictionary
        langs = pc.fill_null(batch.column("lang").cast(pa.large_string()), NO_LANGUAGE).dictionary_encode()
        self.lang, self.langs = langs.indices.to_numpy()[row], langs.dictionary

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """A hash of each word, and of its language."""
        word = word_hashes(*as_utf8(self.names))[0] if len(self.names) else np.zeros(0, np.uint64)
        lang = np.array([_hash(x) for x in self.langs.cast(pa.large_binary()).to_pylist()], np.uint64)
        return word[self.word], lang[self.lang]

    def short_slots(self, slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The slot of each word, the places of words that lead on to the next, and the slots of those pairs."""
        own, lang = self.hashes()
        at = np.flatnonzero(self.leads)
        pair = mix(own[at] * _NEXT + own[at + 1] + lang[at])
        return _slot(mix(own ^ ~lang), slots), at, _slot(pair, slots)

    def frequent(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are frequent, and which make a frequent pair with the next, by the bitmap of short slots."""
        of_word, at, of_pair = self.short_slots(8 * len(bits))
        often = _is_set(bits, of_word)
        on = np.zeros(len(often), bool)
        on[at] = _is_set(bits, of_pair) & often[at] & often[at + 1]
        return often, on

    def long_slots(self, on: np.ndarray, longest: int, slots: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each size from 3, where so many words follow each other in frequent pairs, and the slots of them."""
        own, lang = self.hashes()
        at = np.flatnonzero(on)
        value = mix(own[at] * _NEXT + own[at + 1] + lang[at])
        for size in range(3, longest + 1):
            further = on[at + size - 2]
            at = at[further]
            value = mix(value[further] * _NEXT + own[at + size - 1])
            yield size, at, _slot(value, slots)


def _slot(value: np.ndarray, slots: int) -> np.ndarray:
    return (value & np.uint64(slots - 1)).astype(np.int64)


def _is_set(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return ((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool)


def _hash(name: bytes) -> int:
    value = 0
    for byte in name:
        value = (value * 0x9E3779B97F4A7C15 + byte + 1) % 2**64
    return value


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select("text", "lang").where("text is not null")


def text_bytes(docs: DataFrame) -> int:
    return _rows(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0


def slots_for(size: int) -> int:
    """A power of two by the bytes of the texts, a word taken for six."""
    return min(max(LEAST_SLOTS, 1 << (size // 6 // WORDS_PER_SLOT).bit_length()), MOST_SLOTS)


def frequent_slots(docs: DataFrame, slots: int, least: int, found: Callable[[Words], Iterable[np.ndarray]]) -> np.ndarray:
    """A bitmap (bytes, the lowest bit first) of the slots that ``found`` gives ``least`` times for all texts."""
    kind = np.dtype("u1" if least < 1 << 8 else "<u2" if least < 1 << 16 else "<u4")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The slots of a piece in chunks, each with its slots' places and then their counts. A count
        stays at ``least``: with it, any sum is large enough."""
        for batch in pieces(batches, limit=TEXT_BYTES):
            for own in found(Words(batch)):
                slot, count = np.unique(own, return_counts=True)
                chunk = slot // _CHUNK
                begin = np.flatnonzero(np.diff(chunk, prepend=-1))
                place, count = (slot % _CHUNK).astype("<u2"), np.minimum(count, least).astype(kind)
                rows = [place[i:j].tobytes() + count[i:j].tobytes() for i, j in zip(begin, [*begin[1:], len(slot)], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(chunk[begin], pa.int64()), pa.array(rows, pa.binary())], names=["chunk", "counts"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunk after chunk its counts added up, and a bit for each slot that has enough."""
        at, total = -1, np.zeros(_CHUNK, np.int64)

        def bits() -> pa.RecordBatch:
            packed = np.packbits(total >= least, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([packed], pa.binary())], names=["chunk", "bits"])

        for batch in batches:
            for chunk, counts in zip(batch.column("chunk").to_numpy(), batch.column("counts"), strict=True):
                if chunk != at:
                    if at >= 0:
                        yield bits()
                    at, total = chunk, np.zeros(_CHUNK, np.int64)
                data = counts.as_buffer()
                size = len(data) // (2 + kind.itemsize)
                total[np.frombuffer(data, "<u2", size)] += np.frombuffer(data, kind, size, 2 * size)
        if at >= 0:
            yield bits()

    chunks = _rows(docs).mapInArrow(counted, "chunk long, counts binary").repartition("chunk").sortWithinPartitions("chunk")
    bitmap = np.zeros(slots // 8, np.uint8)
    for r in chunks.mapInArrow(merged, "chunk long, bits binary").collect():  # slots / 8 bytes in all
        bitmap[r.chunk * _CHUNK // 8 :][: _CHUNK // 8] = np.frombuffer(r.bits, np.uint8)
    return bitmap


def task_windows(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, window, count) of the longest windows, as each task has added them up: words and padding
    with a space between."""
    size = text_bytes(docs)
    slots = slots_for(size)
    spark = docs.sparkSession.sparkContext
    short = spark.broadcast(frequent_slots(docs, slots, least, lambda words: words.short_slots(slots)[::2]))

    def longer(words: Words) -> Iterator[np.ndarray]:
        for _, _, slot in words.long_slots(words.frequent(short.value)[1], longest, slots):
            yield slot

    long = spark.broadcast(frequent_slots(docs, slots, least, longer)) if longest > 2 else short

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for batch in pieces(batches, limit=TEXT_BYTES):
            words = Words(batch)
            if not len(words.word):
                continue
            often, on = words.frequent(short.value)
            reach = often.astype(np.int64) + on  # words of the window that begins here
            for size, at, slot in words.long_slots(on, longest, slots):
                at = at[_is_set(long.value, slot)]
                reach[at[reach[at] == size - 1]] = size
            pad, names = len(words.names), pa.concat_arrays([words.names, pa.array([""], pa.large_string())])
            # Most words lead nowhere: those windows are the word alone, or nothing where it is rare. Of
            # the others the numbers of all words, side by side in as few 64-bit keys as hold them, tell
            # equal windows.
            first = np.where(often, words.word, pad)
            alone = np.flatnonzero(reach < 2)
            _, one, count = np.unique(words.lang[alone].astype(np.int64) * (pad + 1) + first[alone], return_index=True, return_counts=True)
            one = alone[one]
            at, lead = np.flatnonzero(reach > 1), []
            for k in range(longest):
                go = reach[at] > k
                own = np.full(len(at), pad, np.int64)
                own[go] = words.word[at[go] + k]
                lead.append(own)
            bits_each = max(pad + 1, len(words.langs)).bit_length()
            packed = []
            for k in range(0, longest + 1, 63 // bits_each):
                key = np.zeros(len(at), np.int64)
                for own in [words.lang[at].astype(np.int64), *lead][k : k + 63 // bits_each]:
                    key = (key << bits_each) | own
                packed.append(key)
            order = np.lexsort(packed)
            new = np.zeros(len(at), bool)
            new[:1] = True
            for key in packed:
                new[1:] |= np.diff(key[order]) != 0
            begin = np.flatnonzero(new)
            many, count = order[begin], np.concatenate([count, np.diff(begin, append=len(at))])
            none = np.full(len(one), pad)
            lead = [np.concatenate([first[one] if k == 0 else none, own[many]]) for k, own in enumerate(lead)]
            one = np.concatenate([one, at[many]])
            window = pc.binary_join_element_wise(*[names.take(pa.array(own)) for own in lead], pa.scalar(" ", pa.large_string()))
            yield pa.table([words.langs.take(pa.array(words.lang[one])), window, pa.array(count)], names=["lang", "window", "count"])

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Equal windows of a task's pieces as one row. Where they get too many, the rarer ones go on; those
        that occur most stay to be added up."""
        held, rows, summed = [], 0, 0

        def sums() -> pa.Table:
            whole = pa.concat_tables(held).group_by(["lang", "window"]).aggregate([("count", "sum")])
            return pa.table([whole["lang"], whole["window"], whole["count_sum"]], names=["lang", "window", "count"])

        def batches_of(whole: pa.Table) -> list[pa.RecordBatch]:
            return whole.cast(pa.schema([("lang", pa.string()), ("window", pa.string()), ("count", pa.int64())])).to_batches()

        for part in run(batches):
            held.append(part)
            rows += len(part)
            if rows - summed > max(summed, HELD_ROWS // 8):
                held = [sums()]
                if len(held[0]) > HELD_ROWS // 2:
                    order = pc.sort_indices(held[0]["count"], sort_keys=[("", "descending")])
                    yield from batches_of(held[0].take(order[HELD_ROWS // 4 :]))
                    held = [held[0].take(order[: HELD_ROWS // 4])]
                rows = summed = len(held[0])
        if held:
            yield from batches_of(sums())

    tasks = max(spark.defaultParallelism, size // TASK_BYTES)
    return _rows(docs).coalesce(tasks).mapInArrow(combined, "lang string, window string, count long")


def windows(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, w1 ... w5, count) of the longest windows, padded with empty words."""
    tops = task_windows(docs, least, longest).groupBy("lang", "window").agg(F.sum("count").alias("count"))
    columns = [F.get(F.split("window", " "), F.lit(k)).alias(f"w{k + 1}") for k in range(longest)]
    return tops.select("lang", *columns, "count")


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, size, phrase, f): how often each phrase of ``size`` words occurs, if ``least`` times.

    Size 0, an empty phrase, has the number of all words of the language.
    """
    top = windows(docs, least, longest)
    columns = [f"w{k + 1}" for k in range(longest)]
    sums = top.rollup("lang", *columns).agg(F.sum("count").alias("f"), F.grouping_id().alias("rolled"))
    # A prefix of k words has the last columns rolled up; a padded one is a shorter prefix again.
    level = F.lit(None).cast("int")
    full = F.lit(False)
    for k in range(longest + 1):
        here = F.col("rolled") == (1 << (longest - k)) - 1
        level = F.when(here, k).otherwise(level)
        full = full | (here if k == 0 else here & (F.col(columns[k - 1]) != "") & (F.col("f") >= least))
    return sums.where(full).select("lang", level.alias("size"), F.concat_ws(" ", *columns).alias("phrase"), "f")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language.

    ``docs`` (text, lang, ...) may have other columns. Texts (null: empty) are taken in lower case
    (A-Z only), cut into pieces at ``.,;:!?`` and U+000A to U+000D, and pieces into words at spaces
    and tabs; phrases lie within a piece. A null lang is ``und``. A phrase of 2 to ``longest`` words
    that occurs ``a >= least`` times, cut in two parts that occur l and r times, has the score
    floor(1000 a n / (l r)), n being all words of the language; the cut with the lowest score, then
    the shortest first part, counts. Phrases that lie inside a longer one that occurs as often are
    left out. Equal scores are ordered by a, descending, and phrase. Equal rows count each; no
    words give no rows. Numbers are exact as long as 1000 a n is under 10^38.
    """
    counts = staged(phrase_counts(docs, least, longest), "phrases")
    total = staged(counts.where("size = 0").select("lang", F.col("f").alias("n")), "phrase-totals")
    counts = counts.where("size > 0")
    phrases = counts.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"))
    words = F.split("phrase", " ")
    # What lies inside a phrase lies inside one that is shorter by its first or last word, or is that.
    inside = phrases.where("size > 2").select("lang", F.col("a").alias("longer"), F.explode(F.array(
        F.concat_ws(" ", F.slice(words, F.lit(1), F.col("size") - 1)),
        F.concat_ws(" ", F.slice(words, F.lit(2), F.col("size") - 1)))).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = phrases.join(inside, ["lang", "phrase"], "left").where("longer is null or longer < a").drop("longer")
    cuts = kept.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumn("first", F.concat_ws(" ", F.slice(words, F.lit(1), F.col("k"))))
    cuts = cuts.withColumn("rest", F.concat_ws(" ", F.slice(words, F.col("k") + 1, F.col("size") - F.col("k"))))
    part = counts.select("lang", "phrase", "f")
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.join(total, "lang")
    exact = lambda c: F.col(c).cast("decimal(18,0)")
    cuts = cuts.withColumn("above", exact("a") * exact("n") * 1000).withColumn("below", exact("l") * exact("r"))
    cuts = cuts.withColumn("score", F.expr("above div below"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = staged(best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"), "phrase-scores")
    # The first of each part of a language's phrases, then the first of those.
    parts = max(1, scored.count() // RANKED_TOGETHER)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    in_part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order)
    first = scored.withColumn("rank", F.row_number().over(in_part)).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
