"""Token counts of byte-level BPE vocabularies by compiled finite-state transducers.

Two deterministic transducers are composed. The first reads characters (as symbols that
carry what the split pattern looks ahead for) and marks where pre-tokens begin. Texts are cut
into chunks; each chunk's map from every state to the state at its end is computed for all
chunks at once, the maps compose in a parallel prefix scan, and then every chunk runs from its
true state. The second reads the bytes of a pre-token; a transition carries how many tokens
the encoding of the longer prefix has more than that of the shorter one (which may be
negative, where a byte completes a merge). Its states are what the rest of the encoding can
depend on: the longest suffix that can still grow into a token, and the last token and the
number of tokens at each position inside it. They are built when first met and kept by the
worker process.

Why this is exact: the encoding of a prefix that ends where a token ends is a prefix of the
encoding; and a token may follow another if the two bytes strings, encoded together, give
just these two. So the last token at a position is the only one that may follow the last
token at the position where it begins.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_utf8, pieces
from .words import segment_sums

CHUNK = 64
MAX_STATES = 260_000  # a worker that has met more begins anew; results are the same

# Symbols of the split transducer. White space that ends its run, with text after it: JOIN (a
# space, which the next pre-token takes) or LONE (other); the rest of a run is RUN. TWO and
# THREE are apostrophes that begin 's 't 'm 'd, or 're 've 'll.
LETTER, NUMBER, OTHER, TWO, THREE, JOIN, LONE, RUN = range(8)
START, IN_LETTER, IN_NUMBER, IN_OTHER, AFTER_JOIN, AFTER_LONE, IN_RUN, ONE_LEFT, TWO_LEFT = range(9)
STATES, SYMBOLS, FIRST = 9, 16, 8  # symbols from FIRST on are the same at the begin of a text

_SPACES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def _split_tables() -> tuple[np.ndarray, np.ndarray]:
    """For state * SYMBOLS + symbol: the next state, and whether a pre-token begins."""
    after = np.zeros((STATES, SYMBOLS), np.uint8)
    begins = np.zeros((STATES, SYMBOLS), np.uint8)
    plain = {LETTER: IN_LETTER, NUMBER: IN_NUMBER, OTHER: IN_OTHER, JOIN: AFTER_JOIN, LONE: AFTER_LONE, RUN: IN_RUN}
    for state in range(STATES):
        for symbol in range(8):
            goal = plain.get(symbol, IN_OTHER)
            if state == TWO_LEFT or state == ONE_LEFT:
                step = (ONE_LEFT if state == TWO_LEFT else START, 0)
            elif symbol in (JOIN, LONE):
                step = (goal, 1)
            elif symbol == RUN:
                step = (goal, int(state != IN_RUN))
            elif state == AFTER_JOIN:
                step = (goal, 0)
            elif symbol in (TWO, THREE) and state != IN_OTHER:
                step = (ONE_LEFT if symbol == TWO else TWO_LEFT, 1)
            else:
                step = (goal, int(state != goal))
            after[state, symbol], begins[state, symbol] = step
    after[:, FIRST:], begins[:, FIRST:] = after[START, :8], begins[START, :8]
    begins[:, FIRST:] = 1
    return after.ravel(), begins.ravel()


_AFTER, _BEGINS = _split_tables()
_KIND: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    """LETTER, NUMBER, OTHER or RUN (white space) for every code point."""
    if not _KIND:
        points = "".join(map(chr, (p for p in range(0x110000) if not 0xD800 <= p < 0xE000)))
        kind = np.full(0x110000, OTHER, np.uint8)
        for symbol, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for found in regex.finditer(pattern, points):
                for p in found.group():
                    kind[ord(p)] = symbol
        kind[list(_SPACES)] = RUN
        _KIND.append(kind)
    return _KIND[0]


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and where each begins."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.uint32)
    point = lead.copy()
    wide = np.flatnonzero(lead >= 0xC0)
    if len(wide):
        first, where = lead[wide], at[wide]
        more = 1 + (first >= 0xE0) + (first >= 0xF0)
        value = first & np.where(more == 1, 0x1F, np.where(more == 2, 0x0F, 0x07)).astype(np.uint32)
        for k in range(1, 4):
            deep = more >= k
            value[deep] = (value[deep] << 6) | (data[where[deep] + k] & 0x3F)
        point[wide] = value
    return point, at


def _symbols(point: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Symbols of the characters; ``first`` marks those that begin a text."""
    kind = _kinds()[point]
    space = kind == RUN
    last = np.zeros(len(point), bool)  # white space with text after it
    last[:-1] = space[:-1] & ~space[1:] & ~first[1:]
    kind[last] = np.where(point[last] == 0x20, JOIN, LONE)
    quote = np.flatnonzero(point == 0x27)
    if len(quote):
        padded = np.append(point, [0, 0])
        fresh = np.append(first, [True, True])
        one, two = padded[quote + 1], padded[quote + 2]
        one = np.where(fresh[quote + 1], 0, one)
        two = np.where(fresh[quote + 1] | fresh[quote + 2], 0, two)
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = np.isin(one, [ord("r"), ord("v")]) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        kind[quote[single]] = TWO
        kind[quote[double]] = THREE
    return kind + FIRST * first.astype(np.uint8)


def split_marks(symbols: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin, by chunk maps, their prefix scan and a run of all chunks at once."""
    size = len(symbols)
    chunks = -(-size // CHUNK)
    block = np.zeros(chunks * CHUNK, np.uint8)
    block[:size] = symbols
    block = np.ascontiguousarray(block.reshape(chunks, CHUNK).T)
    maps = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], chunks, axis=1)
    for row in block:
        maps = _AFTER[maps * SYMBOLS + row]
    step = 1
    while step < chunks:  # maps[:, k] becomes the map of chunks k - 2 * step + 1 .. k
        maps[:, step:] = np.take_along_axis(maps[:, step:], maps[:, :-step].copy(), axis=0)
        step *= 2
    state = np.zeros(chunks, np.uint8)
    state[1:] = maps[START, :-1]
    marks = np.empty_like(block)
    for k, row in enumerate(block):
        cell = state * SYMBOLS + row
        marks[k] = _BEGINS[cell]
        state = _AFTER[cell]
    return marks.T.ravel()[:size].astype(bool)


class Vocabulary:
    """Tokens and merges of a byte-level BPE file in the JSON form, with its token-count transducer."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model = spec["model"]
        decode = {c: b for b, c in _byte_characters().items()}
        self.special = [a["content"].encode() for a in spec.get("added_tokens", [])]
        added = {a["content"] for a in spec.get("added_tokens", [])}
        self.tokens = {bytes(decode[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
        self.text_of = {i: t for t, i in self.tokens.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {tuple(bytes(decode[c] for c in half) for half in m): k for k, m in enumerate(merges)}
        self.growing = {t[:k] for t in self.tokens for k in range(len(t))}
        self.follows: dict[tuple[int, int], bool] = {}
        self._begin()

    def _begin(self) -> None:
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.columns = np.full(256, -1, np.int64)
        self.used = 0
        self.table = np.full((1024, 64), -1, np.int32)
        self._state((b"", (-1,), (0,)))

    def _state(self, state: tuple) -> int:
        found = self.number.get(state)
        if found is None:
            found = self.number[state] = len(self.states)
            self.states.append(state)
            if found >= len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        return found

    def encode(self, text: bytes) -> list[bytes]:
        """The tokens of a pre-token by repeated merges, lowest rank first."""
        parts = [text[k : k + 1] for k in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(p, 1 << 60), k) for k, p in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _may_follow(self, before: int, token: bytes) -> bool:
        key = before, self.tokens[token]
        known = self.follows.get(key)
        if known is None:
            first = self.text_of[before]
            known = self.follows[key] = self.encode(first + token) == [first, token]
        return known

    def _transition(self, number: int, byte: int) -> int:
        """Next state << 8 | 128 + change of the number of tokens."""
        suffix, last, count = self.states[number]
        suffix += bytes([byte])
        for at in range(len(suffix)):
            token = suffix[at:]
            if token in self.tokens and (last[at] < 0 or self._may_follow(last[at], token)):
                break
        else:
            raise ValueError(f"no token ends with {suffix!r}")
        change = count[at] + 1
        last, count = (*last, self.tokens[token]), (*(c - change for c in count), 0)
        for at in range(len(suffix) + 1):
            if suffix[at:] in self.growing:
                break
        suffix, last, count = suffix[at:], list(last[at:]), list(count[at:])
        for k in range(len(suffix)):  # no token that still grows begins here
            if suffix[k:] not in self.growing:
                last[k], count[k] = -2, 0
        return self._state((suffix, tuple(last), tuple(count))) << 8 | (change + 128)

    def _column(self, byte: int) -> int:
        if self.columns[byte] < 0:
            if self.used == self.table.shape[1]:
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)], axis=1)
            self.columns[byte] = self.used
            self.used += 1
        return int(self.columns[byte])

    def _step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        cell = self.table[state, self.columns[byte]]
        missing = np.flatnonzero(cell < 0)
        if len(missing):
            wanted = np.unique(state[missing].astype(np.int64) << 8 | byte[missing])
            for pair in wanted.tolist():
                value = self._transition(pair >> 8, pair & 255)
                self.table[pair >> 8, self.columns[pair & 255]] = value
            cell[missing] = self.table[state[missing], self.columns[byte[missing]]]
        return cell

    def counts(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token."""
        if len(self.states) > MAX_STATES:
            self._begin()
        for byte in np.flatnonzero(np.bincount(data, minlength=256)).tolist():
            self._column(byte)
        order = np.argsort(np.minimum(length, 0xFFFF).astype(np.uint16), kind="stable")[::-1]
        begin, length = begin[order], length[order]
        state = np.zeros(len(order), np.int32)
        total = np.zeros(len(order), np.int64)
        longest = int(length.max()) if len(length) else 0
        ordered = length[::-1]
        k = 0
        while k < min(longest, 0xFFFF):
            active = len(length) - int(np.searchsorted(ordered, k, side="right"))
            if active < 8:
                break
            cell = self._step(state[:active], data[begin[:active] + k])
            state[:active] = cell >> 8
            total[:active] += (cell & 255) - 128
            k += 1
        for row in range(len(length)):  # the few longest, byte by byte
            if length[row] <= k:
                break
            at, count = int(state[row]), 0
            for byte in data[begin[row] + k : begin[row] + length[row]].tolist():
                column = int(self.columns[byte])
                cell = int(self.table[at, column])
                if cell < 0:
                    cell = self._transition(at, byte)
                    self.table[at, column] = cell
                at = cell >> 8
                count += (cell & 255) - 128
            total[row] += count
        out = np.empty_like(total)
        out[order] = total
        return out

    def token_counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text; a special token's string counts as that token."""
        extra = np.zeros(len(offsets) - 1, np.int64)
        cuts, holes = [offsets], []
        raw = data.tobytes() if self.special else b""
        for special in self.special:
            at = raw.find(special)
            while at >= 0:
                text = int(np.searchsorted(offsets, at, side="right")) - 1
                if at + len(special) <= offsets[text + 1]:
                    extra[text] += 1
                    holes.append((at, at + len(special)))
                    at = raw.find(special, at + len(special))
                else:
                    at = raw.find(special, at + 1)
        if holes:
            cuts.append(np.array(holes, np.int64).ravel())
        if not len(data):
            return extra
        point, place = code_points(data)
        first = np.zeros(len(data) + 1, bool)
        first[np.concatenate(cuts)] = True
        marks = split_marks(_symbols(point, first[:-1][place]))
        begin = place[marks]
        length = np.diff(begin, append=len(data))
        if holes:
            starts = np.sort(np.array([h[0] for h in holes]))
            ends = np.sort(np.array([h[1] for h in holes]))
            slot = np.searchsorted(starts, begin, side="right") - 1
            inside = (slot >= 0) & (begin < ends[np.maximum(slot, 0)])
            begin, length = begin[~inside], length[~inside]
        counted = self.counts(data, begin, length)
        return extra + segment_sums(counted, np.searchsorted(begin, offsets))


def _byte_characters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {**{b: chr(b) for b in printable}, **{b: chr(256 + k) for k, b in enumerate(rest)}}


_LOADED: dict[str, Vocabulary] = {}


def _loaded(content: bytes) -> Vocabulary:
    key = hashlib.sha256(content).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(content)
    return _LOADED[key]


def count_tokens(docs: DataFrame, vocabulary_path: str, text: str = "text", max_tokens: int = 512) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit for the whole of each text.

    The counts are those of the library for the vocabulary file, without added begin or end
    tokens. Null and empty texts have 0 bytes and 0 tokens. Every row gives one row, with all
    its columns; columns named like the new ones are replaced. The file (a few MB) is read by
    the driver and shipped to the tasks; nothing is shuffled.
    """
    with open(vocabulary_path, "rb") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())
    new = ("n_bytes", "n_tokens", "over_limit")
    kept = docs.drop(*new)
    schema = kept.select("*", *(F.lit(None).cast(kind).alias(name) for name, kind in zip(new, ("long", "long", "boolean"), strict=True))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _loaded(content.value)
        for batch in pieces(batches, text):
            data, offsets = as_utf8(batch.column(text))
            count = vocabulary.token_counts(data, offsets)
            columns = [pa.array(np.diff(offsets)), pa.array(count), pa.array(count > max_tokens)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *new])

    return kept.mapInArrow(run, schema)
