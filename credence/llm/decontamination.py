"""Benchmark passages in documents, also edited ones, by q-gram counts in diagonal bands.

Texts are compared as letters and digits in lower case, anything between them as one space.
A passage of n characters with at most e edits keeps at least n - q + 1 - q * e of its
q-grams, all on neighbouring diagonals (position in the text less position in the passage).
The same holds for any part of its q-grams: of g of them at least g - q * e are kept. So only
q-grams that few passages have are counted where they suffice, of the longest length for which
they do; a prompt that many passages begin with then leads nowhere. Shared q-grams are
counted in overlapping bands of diagonals, each twice as wide as the edits can shift; bands that
reach the count are aligned, in the band only and as long as it has a cell within the budget, to find
the exact number of edits. No passage within its budget is missed.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_utf8, mix, pieces
from .tokens import code_points

Q = 10  # length that sets the edit budgets
LENGTHS = (10, 8, 6, 5, 4)  # lengths of counted q-grams, the first that suffices
FEW = 4  # passages that may share a counted q-gram
SPARE = 4  # counted q-grams that are left, at least, after as many edits as there may be
EDIT_SHARE = 0.08  # edits for each character of a passage
BLOCK_CHARS = 8_000_000  # characters of passages that are shipped to the tasks at a time
_BITS = 22
_AT_ONCE = 256
_ENTRIES = 1 << 20  # pairs of text and passage positions that are held together
_FOLD: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """For each code point its lower case, or a space where it isn't a letter, digit or mark."""
    if not _FOLD:
        fold = np.full(0x110000, 0x20, np.uint32)
        for p in range(0x110000):
            c = chr(p)
            if c.isalnum() or unicodedata.category(c)[0] == "M":
                low = c.lower()
                fold[p] = ord(low) if len(low) == 1 else p
        _FOLD.append(fold)
    return _FOLD[0]


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded characters of all texts, where each text begins, and each one's place in its own text."""
    point, at = code_points(data)
    first = np.searchsorted(at, offsets)
    letter = _fold()[point]
    keep = letter != 0x20
    keep[1:] |= keep[:-1]
    begins = first[:-1][first[:-1] < first[1:]]
    keep[begins] = letter[begins] != 0x20
    kept = np.flatnonzero(keep)
    starts = np.searchsorted(kept, first)
    place = kept - np.repeat(first[:-1], np.diff(starts))
    return letter[kept], starts, place


def gram_hashes(letter: np.ndarray, size: int = Q) -> np.ndarray:
    """A hash of the ``size`` characters (under 16) from each position on."""
    if len(letter) < size:
        return np.zeros(0, np.uint64)
    base = 0x9E3779B97F4A7C15
    part, width = mix(letter.astype(np.uint64) + np.uint64(1)), 1
    out, done, count = np.zeros(len(letter) - size + 1, np.uint64), 0, len(letter) - size + 1
    while True:
        if size & width:
            out += part[done : done + count] * np.uint64(pow(base, done, 2**64))
            done += width
        if done == size:
            return mix(out)
        part = part[:-width] + part[width:] * np.uint64(pow(base, width, 2**64))
        width *= 2


class Grams:
    """The counted q-grams of one length: sorted, each with the passages and places that have it."""

    def __init__(self, size: int, chosen: list[tuple[int, np.ndarray, np.ndarray]]):
        self.size = size
        gram = np.concatenate([g for _, g, _ in chosen])
        order = np.argsort(gram, kind="stable")
        self.item = np.concatenate([np.full(len(g), k) for k, g, _ in chosen])[order]
        self.place = np.concatenate([at for _, _, at in chosen])[order]
        self.gram, first = np.unique(gram[order], return_index=True)
        self.first = np.append(first, len(gram))
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[self.gram >> np.uint64(64 - _BITS)] = True


class Passages:
    """Folded passages with their q-grams, edit budgets and thresholds; equal ones are one."""

    def __init__(self, ids: list, texts: list):
        letters, starts, _ = folded(*as_utf8(pa.array(texts, pa.string())))
        # A last space is not part of a passage.
        size = np.diff(starts)
        ends = np.maximum(starts[1:] - 1, 0)
        if len(letters):
            size = size - ((size > 0) & (letters[np.minimum(ends, len(letters) - 1)] == 0x20))
        numbers: dict[bytes, int] = {}
        self.ids, first = [], []
        for k, own in enumerate(ids):
            number = numbers.setdefault(letters[starts[k] : starts[k] + size[k]].tobytes(), len(numbers))
            if number == len(first):
                first.append(k)
                self.ids.append([])
            self.ids[number].append(own)
        self.letters, self.starts, self.size = letters, starts[:-1][first], size[first]
        self.budget = np.maximum(np.minimum((EDIT_SHARE * self.size).astype(np.int64), (self.size - Q) // Q), 0)
        self.least = np.zeros(len(first), np.int64)
        self.grams = self._counted()

    def _counted(self) -> list[Grams]:
        """For each passage the length and the q-grams that are counted.

        Of each length the rarest that suffice, by a quarter more than the edits can spoil and by at
        least ``SPARE``, are looked at: the longest length for which few passages share any of them is taken, or else that whose
        commonest is shared by the fewest. Where no length has so many, all 10-grams count.
        """
        long_enough = np.flatnonzero(self.size >= Q)
        chosen: dict[int, tuple] = {}
        for q in LENGTHS:
            unsettled = [k for k in long_enough if k not in chosen or chosen[k][0] > FEW]
            if not unsettled:
                break
            own = {k: gram_hashes(self.letters[self.starts[k] : self.starts[k] + self.size[k]], q) for k in long_enough}
            gram, count = np.unique(np.concatenate([np.unique(g) for g in own.values()]), return_counts=True)
            for k in unsettled:
                shared = count[np.searchsorted(gram, own[k])]
                wanted = q * int(self.budget[k]) + max(SPARE, q * int(self.budget[k]) // 4)
                if len(shared) < wanted:
                    continue
                most = int(np.partition(shared, wanted - 1)[wanted - 1])
                if k not in chosen or most < chosen[k][0]:
                    # Others that no more passages share count too: they cost little.
                    at = np.flatnonzero(shared <= max(most, FEW))
                    chosen[k] = (most, q, own[k][at], at)
        for k in long_enough:
            if k not in chosen:
                grams = gram_hashes(self.letters[self.starts[k] : self.starts[k] + self.size[k]], Q)
                chosen[k] = (0, Q, grams, np.arange(len(grams)))
        for k, (_, q, grams, _) in chosen.items():
            self.least[k] = len(grams) - q * int(self.budget[k])
        return [Grams(q, [(k, grams, at) for k, (_, own, grams, at) in chosen.items() if own == q]) for q in LENGTHS
                if any(own == q for _, own, _, _ in chosen.values())]

    def regions(self, letter: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, passage and lowest diagonal of the bands that share enough q-grams."""
        found = [self._bands(grams, letter, starts) for grams in self.grams]
        none = [(np.zeros(0, np.int64),) * 3]
        return tuple(np.concatenate(parts) for parts in zip(*(found or none), strict=True))

    def _bands(self, grams: Grams, letter: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        none = (np.zeros(0, np.int64),) * 3
        hashes = gram_hashes(letter, grams.size)
        at = np.flatnonzero(grams.bitmap[hashes >> np.uint64(64 - _BITS)])
        slot = np.minimum(np.searchsorted(grams.gram, hashes[at]), len(grams.gram) - 1)
        found = grams.gram[slot] == hashes[at]
        at, slot = at[found], slot[found]
        text = np.searchsorted(starts, at, side="right") - 1
        whole = at + grams.size <= starts[text + 1]
        at, slot, text = at[whole], slot[whole], text[whole]
        if not len(at):
            return none
        many = grams.first[slot + 1] - grams.first[slot]
        passages = len(self.ids)
        # Bands are numbered from the text's begin, less the longest passage; they fit in 64 bits.
        bands = int(np.diff(starts).max()) + int(self.size.max()) + 3
        keys, counts, upto = [], [], np.cumsum(many)
        begin = 0
        while begin < len(at):
            # So many entries at a time that they stay few however often a q-gram occurs.
            end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + _ENTRIES, side="right")))
            n, part = many[begin:end], slice(begin, end)
            entry = np.repeat(grams.first[slot[part]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            here, of = np.repeat(at[part], n), np.repeat(text[part], n)
            item = grams.item[entry]
            diagonal = here - starts[of] - grams.place[entry] + self.size[item]  # never negative
            band = diagonal // (self.budget[item] + 1) + 1
            # Each q-gram counts for its band and for the one before, which overlaps it.
            key = (of * bands + band) * passages + item
            key, count = np.unique(np.concatenate([key, key - passages]), return_counts=True)
            keys.append(key)
            counts.append(count)
            begin = end
        key, where = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.bincount(where, np.concatenate(counts))
        item = key % passages
        enough = count >= self.least[item]
        key, item = key[enough], item[enough]
        text, band = key // passages // bands, key // passages % bands - 1
        return text, item, starts[text] + band * (self.budget[item] + 1) - self.size[item]

    def align(self, letter, starts, text, item, low) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Least edits with which each passage occurs along its band, and where (begin, end).

        A cell holds edits * scale + column at which the alignment begins, for one diagonal;
        rows are the passage's characters, and all regions are aligned side by side. A region whose
        cells are all beyond the budget is given up; its edits are one more than that.
        """
        count, scale = len(text), 1 << 20
        width = 4 * int(self.budget[item].max()) + 4
        column = np.arange(width)
        base = low - self.budget[item]
        edits, begin, end = self.budget[item] + 1, np.zeros(count, np.int64), np.zeros(count, np.int64)
        live = np.arange(count)
        cell = np.tile(column.astype(np.int64), (count, 1))
        for row in range(int(self.size[item].max())):
            at = base[live, None] + row + column
            inside = (at >= starts[text[live], None]) & (at < starts[text[live] + 1, None])
            seen = np.where(inside, letter[np.clip(at, 0, len(letter) - 1)], 0)
            wanted = self.letters[self.starts[item[live]] + row][:, None]
            new = cell + scale * (seen != wanted)
            new[:, :-1] = np.minimum(new[:, :-1], cell[:, 1:] + scale)
            cell = np.minimum.accumulate(new - scale * column, axis=1) + scale * column
            value = cell.min(axis=1)
            hopeful = value // scale <= self.budget[item[live]]
            last = self.size[item[live]] == row + 1
            done = np.flatnonzero(hopeful & last)
            if len(done):
                which, best = live[done], cell[done].argmin(axis=1)
                edits[which] = value[done] // scale
                begin[which] = base[which] + value[done] % scale
                end[which] = base[which] + row + 1 + best
            stay = hopeful & ~last
            live, cell = live[stay], cell[stay]
            if not len(live):
                break
        return edits, begin, end

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, passage, begin, end, edits) in characters of the original texts, overlaps merged."""
        letter, starts, place = folded(data, offsets)
        text, item, low = self.regions(letter, starts)
        out = []
        for k in range(0, len(text), _AT_ONCE):
            part = slice(k, k + _AT_ONCE)
            t, i = text[part], item[part]
            edits, begin, end = self.align(letter, starts, t, i, low[part])
            for n in np.flatnonzero(edits <= self.budget[i]):
                first = max(begin[n], starts[t[n]])
                last = min(end[n], starts[t[n] + 1]) - 1
                out.append((int(t[n]), int(i[n]), int(place[first]), int(place[last]) + 1, int(edits[n])))
        best: list[tuple[int, int, int, int, int]] = []
        for hit in sorted(out):
            if best and best[-1][:2] == hit[:2] and hit[2] < best[-1][3]:
                if hit[4] < best[-1][4]:
                    best[-1] = hit
            else:
                best.append(hit)
        return best


def _blocks(benchmark: DataFrame) -> Iterator[Passages]:
    """The passages in blocks of a bounded size."""
    wanted = benchmark.select("item_id", "text").where("text is not null")
    total = wanted.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + total // BLOCK_CHARS
    for block in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        rows.sort(key=lambda r: (r.item_id is None, r.item_id or 0, r.text))
        yield Passages([r.item_id for r in rows], [r.text for r in rows])


def find_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each occurrence of a passage in a document: doc_id, item_id, begin, end, edits.

    ``docs`` (doc_id, text, ...) and ``benchmark`` (item_id, text, ...) may have other columns.
    An occurrence has at most 8 % of the passage's characters edited (fewer for passages so
    short that their q-grams could not show it); begin and end count characters of the text.
    Null and empty texts, and passages under 10 letters (too short to tell from ordinary words),
    occur nowhere; equal rows, of documents as of passages, are reported each, and a null item_id
    like any other. The passages are the query set: they are shipped in blocks of a bounded size, and
    the documents are scanned once for each block, without a shuffle.
    """
    docs = docs.select("doc_id", "text")
    found = None
    for passages in _blocks(benchmark):
        shipped = docs.sparkSession.sparkContext.broadcast(passages)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            ids = shipped.value.ids
            for batch in pieces(batches):
                hits = shipped.value.hits(*as_utf8(batch.column("text")))
                if hits:
                    each = [(t, own, *rest) for t, i, *rest in hits for own in ids[i]]
                    text, item, begin, end, edits = zip(*each, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(text)), pa.array(item, pa.int64()),
                         pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array(edits, pa.int64())],
                        names=["doc_id", "item_id", "begin", "end", "edits"])

        own = docs.mapInArrow(run, "doc_id long, item_id long, begin long, end long, edits long")
        found = own if found is None else found.unionAll(own)
    return found


def without_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in whose text no passage of ``benchmark`` occurs, all columns kept."""
    for passages in _blocks(benchmark):
        shipped = docs.sparkSession.sparkContext.broadcast(passages)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                keep = np.ones(batch.num_rows, bool)
                keep[[hit[0] for hit in shipped.value.hits(*as_utf8(batch.column("text")))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
