"""Merkle fingerprints of documents.

Leaves are paragraphs (up to and with a line break), inner nodes are sections, and the root
is the fingerprint. A section ends at a blank line, or after a paragraph whose digest begins
with one of ``SECTION_ENDS`` byte values: the content decides, so an edit changes the
sections it touches and no others. Equal roots mean equal texts; otherwise only differing
branches are followed down, and in differing paragraphs the spans of a few words.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, staged

SECTION_ENDS = 32
# Up to three words, ended early by punctuation; a word of over 80 characters counts as several.
SPAN = regex.compile(r"\S{1,80}(?:(?<![.,;:!?])\s+\S{1,80}){0,2}+\s*+|\s+")


def _digest(content: bytes) -> bytes:
    return hashlib.blake2b(content, digest_size=16).digest()


class Tree:
    """The Merkle tree of a text; spans are cut when a comparison needs them."""

    __slots__ = ("root", "sections", "size", "_spans")

    def __init__(self, text: str):
        self.size = len(text)
        self.sections: list[tuple[bytes, list[tuple[bytes, str]]]] = []
        held: list[tuple[bytes, str]] = []
        for paragraph in text.split("\n"):
            digest = _digest(paragraph.encode())
            held.append((digest, paragraph))
            if digest[0] < SECTION_ENDS or not paragraph.strip():
                self.sections.append((_digest(b"".join(d for d, _ in held)), held))
                held = []
        if held:
            self.sections.append((_digest(b"".join(d for d, _ in held)), held))
        self.root = _digest(b"".join(d for d, _ in self.sections))
        self._spans: dict[bytes, list[tuple[int, int]]] = {}

    def spans(self, digest: bytes, paragraph: str) -> list[tuple[int, int]]:
        found = self._spans.get(digest)
        if found is None:
            cut = SPAN.findall(paragraph)
            found = self._spans[digest] = list(zip(map(xxhash.xxh3_64_intdigest, cut), map(len, cut), strict=True))
        return found


def _rest(mine: list, other: list) -> list:
    """The branches of ``mine`` that are not in ``other``, as often as they are not."""
    there = Counter([branch[0] for branch in other])
    rest = []
    for branch in mine:
        if there.get(branch[0], 0):
            there[branch[0]] -= 1
        else:
            rest.append(branch)
    return rest


def _differing(a: Tree, b: Tree) -> tuple[list[tuple[bytes, str]], list[tuple[bytes, str]]]:
    """Paragraphs of each tree that the other lacks, found from the differing sections."""
    x, y = _rest(a.sections, b.sections), _rest(b.sections, a.sections)
    x, y = [p for _, s in x for p in s], [p for _, s in y for p in s]
    return _rest(x, y), _rest(y, x)


def likeness(a: Tree, b: Tree) -> float:
    """Share of the larger text's characters in branches that both trees hold: 1 for equal texts.

    Two empty texts are equal; an empty and another text have nothing in common.
    """
    if a.root == b.root:
        return 1.0
    larger = max(a.size, b.size)
    x, y = _differing(a, b)
    shared = a.size - _characters(a, x)
    mine = [s for d, p in x for s in a.spans(d, p)]
    other = Counter([k for d, p in y for k, _ in b.spans(d, p)])
    for key, length in mine:
        if other.get(key, 0):
            other[key] -= 1
            shared += length
    return round(min(shared / larger, 1.0), 6)


def _characters(tree: Tree, paragraphs: list[tuple[bytes, str]]) -> int:
    """Characters of the paragraphs with their line breaks, of which the last one has none."""
    return min(tree.size, sum(len(p) + 1 for _, p in paragraphs))


def edits(a: str, b: str) -> list[tuple[int, int]]:
    """Begin and end of the spans of ``a`` that ``b`` lacks, neighbours joined."""
    left, right = Tree(a), Tree(b)
    if left.root == right.root:
        return []
    x, y = _differing(left, right)
    wanted = Counter(d for d, _ in x)
    there = Counter(k for d, p in y for k, _ in right.spans(d, p))
    out: list[tuple[int, int]] = []
    at = 0
    for _, section in left.sections:
        for digest, paragraph in section:
            if wanted.get(digest, 0):
                wanted[digest] -= 1
                place = at
                for key, length in left.spans(digest, paragraph):
                    if there.get(key, 0):
                        there[key] -= 1
                    elif out and out[-1][1] == place:
                        out[-1] = (out[-1][0], place + length)
                    else:
                        out.append((place, place + length))
                    place += length
            at += len(paragraph) + 1
    return out


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_chars, fingerprint (hex root) and sections (hex digest, begin, n_chars).

    Null counts as empty. Columns named like the new ones are replaced.
    """
    names = ("n_chars", "fingerprint", "sections")
    kept = docs.drop(*names)
    schema = kept.select("*", *(F.lit(None).cast(t).alias(n) for n, t in zip(names, (
        "long", "string", "array<struct<digest:string,begin:long,n_chars:long>>"), strict=True))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            size, root, sections = [], [], []
            for value in batch.column(text).to_pylist():
                tree = Tree(value or "")
                at, own = 0, []
                for digest, paragraphs in tree.sections:
                    length = sum(len(p) + 1 for _, p in paragraphs)
                    own.append({"digest": digest.hex(), "begin": at, "n_chars": min(length, tree.size - at)})
                    at += length
                size.append(tree.size)
                root.append(tree.root.hex())
                sections.append(own)
            kind = pa.list_(pa.struct([("digest", pa.string()), ("begin", pa.int64()), ("n_chars", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(size, pa.int64()), pa.array(root, pa.string()), pa.array(sections, kind)],
                names=[*batch.schema.names, *names])

    return kept.mapInArrow(run, schema)


def spliced(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by as much of the following text's begin."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [c.split(" ")[0] for c in _COLUMNS.split(", ")]


def _compared(doc_id, text: str, tree: Tree, following: str, next_tree: Tree) -> tuple:
    edited = spliced(text, following)
    changed = Tree(edited)
    return (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), tree.root.hex(), changed.root.hex(),
            likeness(tree, changed), likeness(tree, next_tree))


def _batch(rows: list[tuple], kind: str) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * len(rows)), *columns, pa.nulls(len(rows), pa.string())], names=["kind", *_NAMES, "text"])


def _edge(kind: str, doc_id, text: str) -> pa.RecordBatch:
    empty = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
    return pa.RecordBatch.from_arrays(
        [pa.array([kind]), pa.array([doc_id], pa.int64()), *empty, pa.array([text], pa.string())], names=["kind", *_NAMES, "text"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows compared with the next one of a sorted partition; its first and last row as they are."""
    held = None
    for batch in pieces(batches):
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            text = text or ""
            tree = Tree(text)
            if held is None:
                yield _edge("head", doc_id, text)
            else:
                rows.append(_compared(*held, text, tree))
            held = doc_id, text, tree
        if rows:
            yield _batch(rows, "row")
    if held is not None:
        yield _edge("tail", held[0], held[1])


def _stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        rows = [
            _compared(d, a, Tree(a), b, Tree(b))
            for d, a, b in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "following")), strict=True)]
        if rows:
            yield _batch(rows, "row")


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    The next document has the next smaller doc_id (null last; equal ids in the order of their
    texts), and after the last comes the first; a single document is followed by itself. Texts
    are dealt out by ranges of doc_id and sorted, once; each task compares neighbours as they
    stream by. Only the first and last row of each partition, which have a neighbour in
    another one, are joined afterwards. Null counts as empty; other columns are ignored.
    """
    text_hash = F.xxhash64("text")
    order = [F.col("doc_id").desc_nulls_last(), text_hash, F.col("text")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange(parts, *order[:2]).sortWithinPartitions(*order)
    )
    found = staged(rows.mapInArrow(_neighbours, f"kind string, {_COLUMNS}, text string"), "neighbours")
    # One head and one tail for each partition, so these windows hold a row for each partition.
    edges = found.where("kind <> 'row'").withColumn("h", text_hash)
    place = Window.orderBy(F.col("doc_id").desc_nulls_last(), "h")
    rank = {
        kind: edges.where(F.col("kind") == kind).select("doc_id", "h").withColumn("rank", F.row_number().over(place))
        for kind in ("head", "tail")}
    after = rank["tail"].withColumn("rank", F.col("rank") % F.count("*").over(Window.partitionBy()) + 1)
    pairs = after.join(rank["head"].select("rank", F.col("doc_id").alias("next_id"), F.col("h").alias("next_h")), "rank")
    tails = edges.where("kind = 'tail'").select("doc_id", "h", "text").alias("t")
    heads = edges.where("kind = 'head'").select(F.col("doc_id").alias("next_id"), F.col("h").alias("next_h"), F.col("text").alias("following"))
    both = (
        pairs.join(tails, pairs.doc_id.eqNullSafe(F.col("t.doc_id")) & (pairs.h == F.col("t.h")))
        .select("t.doc_id", "t.text", "next_id", "next_h").alias("p")
        .join(heads.alias("n"), F.col("p.next_id").eqNullSafe(F.col("n.next_id")) & (F.col("p.next_h") == F.col("n.next_h")))
        .select("p.doc_id", "p.text", "n.following")
    )
    edge_rows = both.mapInArrow(_stitched, f"kind string, {_COLUMNS}, text string")
    return found.where("kind = 'row'").unionAll(edge_rows).select(*_NAMES)
