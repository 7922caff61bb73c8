"""Language identification by unigram models summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A word's
probability in a language is the sum over all ways to cut it into pieces, which a forward
pass adds up; a text's is the product over its words. The piece probabilities are fitted by
expectation maximisation: a backward pass gives the expected number of times each piece is
used in the training words, and these counts, smoothed, are the next probabilities.

Words are runs of letters in lower case, begun by the vocabulary's word mark. Texts are judged by
whole runs of any length; training reads runs of more than ``RUN`` characters as several. A
letter that no piece holds has the same small probability in all languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_utf8, pieces, staged
from .tokens import code_points
from .words import _power

RUN = 48
RESCALE = 8
TRAIN_ROWS = 400  # about so many documents of each language, drawn by hash, fit its model
ROUNDS = 4
SMOOTHING = 0.1
UNKNOWN = 1e-6
PIECE_BYTES = 256 << 10
MARK = "▁"
UNDETERMINED = "und"

_random = np.random.Generator(np.random.PCG64(7))
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point its lower case if it is a letter, else 0."""
    if not _LETTER:
        fold = np.zeros(0x110000, np.int32)
        for p in range(0x110000):
            c = chr(p)
            if c.isalpha():
                low = c.lower()
                fold[p] = ord(low) if len(low) == 1 else p
        _LETTER.append(fold)
    return _LETTER[0]


class Pieces:
    """The lower-case letter pieces of a vocabulary as a trie of dense transitions.

    Node 0 is dead, 1 the root, 2 an unknown letter; the others are prefixes of pieces.
    """

    def __init__(self, vocabulary: list[str]):
        found = sorted({p for p in vocabulary if p == p.lower() and p.replace(MARK, "").isalpha() and MARK not in p[1:]} | {MARK})
        long = sorted({c for p in found if len(p) > 1 for c in p} | {MARK})
        self.code = np.full(0x110000, 0, np.int32)  # 0: unknown
        for k, c in enumerate(long):
            self.code[ord(c)] = k + 1
        singles = [p for p in found if len(p) == 1 and p not in set(long)]
        for k, c in enumerate(singles):
            self.code[ord(c)] = len(long) + 1 + k
        self.columns = len(long) + 1
        self.longest = max(map(len, found))
        node = {"": 1}
        for p in found:
            for k in range(1, len(p) + 1):
                node.setdefault(p[:k], len(node) + 2)
        self.size = len(node) + 2
        self.step = np.zeros((self.size, self.columns), np.int32)
        self.root = np.full(len(long) + 1 + len(singles), 2, np.int32)
        for p, k in node.items():
            if len(p) == 1:
                self.root[self.code[ord(p)]] = k
            elif p:
                self.step[node[p[:-1]], self.code[ord(p[-1])]] = k
        self.is_piece = np.zeros(self.size, bool)
        self.is_piece[[node[p] for p in found]] = True
        self.is_piece[2] = True

    def next(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Transitions from inner nodes; codes from ``columns`` on only occur as single pieces."""
        inner = code < self.columns
        return np.where(inner, self.step[node, np.where(inner, code, 0)], 0)

    def runs(self, data: np.ndarray, offsets: np.ndarray, whole: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes of all runs after each other; begin and length of each; each text's first run.

        Runs of more than ``RUN`` characters are cut unless ``whole``.
        """
        point, at = code_points(data)
        first = np.searchsorted(at, offsets)
        letter = _letters()[point]
        is_letter = letter != 0
        begins = is_letter.copy()
        begins[1:] &= ~is_letter[:-1]
        heads = first[:-1][first[:-1] < first[1:]]
        begins[heads] = is_letter[heads]
        kept = np.flatnonzero(is_letter)
        new = begins[kept]
        place = np.arange(len(kept)) + np.cumsum(new)
        codes = np.full(len(kept) + int(new.sum()), self.code[ord(MARK)], np.int32)
        codes[place] = self.code[letter[kept]]
        begin = place[new] - 1
        length = np.diff(begin, append=len(codes))
        text_first = np.searchsorted(kept[new], first)
        if not whole and len(length) and length.max() > RUN:
            parts = -(-length // RUN)
            which = np.repeat(np.arange(len(begin)), parts)
            offset = (np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)) * RUN
            text_first = np.append(0, np.cumsum(parts))[text_first]
            begin, length = begin[which] + offset, np.minimum(length[which] - offset, RUN)
        return codes, begin, length, text_first


def _distinct(codes, begin, length) -> tuple[np.ndarray, np.ndarray]:
    """One row of each distinct run, and each run's number among them."""
    power, inverse = _power(len(codes) + 1)
    weight = _code_weights(int(codes.max()) + 1 if len(codes) else 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(weight[codes] * power[: len(codes)], out=sums[1:])
    key = (sums[begin + length] - sums[begin]) * inverse[begin] + length.astype(np.uint64)
    _, row, number = np.unique(key, return_index=True, return_inverse=True)
    return row, number


_WEIGHTS: list[np.ndarray] = [np.zeros(0, np.uint64)]


def _code_weights(size: int) -> np.ndarray:
    if len(_WEIGHTS[0]) < size:
        _WEIGHTS[0] = np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, max(size, 40_000), dtype=np.uint64)
    return _WEIGHTS[0]


def forward(pieces_: Pieces, chance: np.ndarray, codes, begin, length) -> np.ndarray:
    """Probability of each run (row) in each language (column) over all its segmentations."""
    return np.exp(log_forward(pieces_, chance, codes, begin, length))


def log_forward(pieces_: Pieces, chance: np.ndarray, codes, begin, length) -> np.ndarray:
    """Logarithm of the probability of each run (row) in each language (column).

    ``chance`` has a row for each node of the trie and is 0 where the node is no piece. The
    sums are scaled to 1 every ``RESCALE`` letters and the logarithm of the scale is kept, so
    that runs of any length and letters of any probability add up without underflow.
    """
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    rising = length[::-1]
    reach = [np.zeros((len(begin), chance.shape[1])) for _ in range(pieces_.longest + 1)]
    reach[0][:] = 1
    scale = np.zeros((len(begin), chance.shape[1]))
    out = np.zeros((len(begin), chance.shape[1]))
    for start in range(int(length.max()) if len(length) else 0):
        active = len(length) - int(np.searchsorted(rising, start, side="right"))
        if start and start % RESCALE == 0:
            most = reduce(np.maximum, (r[:active] for r in reach))
            most[most == 0] = 1
            for r in reach:
                r[:active] /= most
            scale[:active] += np.log(most)
        here = reach[0]
        rows = np.arange(active)
        node = pieces_.root[codes[begin[:active] + start]]
        for k in range(1, pieces_.longest + 1):
            gain = chance[node]
            gain *= here[rows] if len(rows) < active else here[:active]
            if len(rows) < active:
                reach[k][rows] += gain
            else:
                reach[k][:active] += gain
            if k == pieces_.longest:
                break
            longer = (length[rows] > start + k) & (node != 2)
            rows, node = rows[longer], node[longer]
            node = pieces_.next(node, codes[begin[rows] + start + k])
            alive = node != 0
            rows, node = rows[alive], node[alive]
            if not len(rows):
                break
        ended = slice(len(length) - int(np.searchsorted(rising, start + 1, side="right")), active)
        with np.errstate(divide="ignore"):
            out[order[ended]] = np.log(reach[1][ended]) + scale[ended]
        here[:active] = 0
        reach = [*reach[1:], here]
    return out


def expected_counts(pieces_: Pieces, chance: np.ndarray, language, weight, codes, begin, length) -> np.ndarray:
    """Expected uses of each node as a piece in each language, for runs of known language.

    ``ahead`` is scaled to 1 at each letter and ``sure`` keeps the logarithm of the probability of
    what lies before it, so nothing underflows; ``behind`` is the chance that a cut lies there.
    """
    total = np.zeros(chance.size)
    for at in range(0, len(begin), 5_000):
        part = slice(at, at + 5_000)
        b, n, own, times = begin[part], length[part], language[part], weight[part]
        longest = int(n.max())
        grid = np.zeros((len(b), longest), np.int32)
        inside = np.arange(longest) < n[:, None]
        grid[inside] = codes[(b[:, None] + np.arange(longest))[inside]]
        edges = []
        ahead = np.zeros((len(b), longest + 1))
        ahead[:, 0] = 1
        sure = np.zeros((len(b), longest + 1))
        scale = np.zeros(len(b))
        for start in range(longest + 1):
            rows = np.flatnonzero(n >= start)
            most = np.where(ahead[rows, start] > 0, ahead[rows, start], 1)
            ahead[rows, start : start + pieces_.longest + 1] /= most[:, None]
            scale[rows] += np.log(most)
            sure[rows, start] = scale[rows]
            rows = rows[n[rows] > start]
            if not len(rows):
                break
            node = pieces_.root[grid[rows, start]]
            for k in range(1, pieces_.longest + 1):
                piece = pieces_.is_piece[node]
                r, p = rows[piece], node[piece]
                gain = chance[p, own[r]]
                ahead[r, start + k] += ahead[r, start] * gain
                edges.append((r, start, k, p, gain))
                longer = (n[rows] > start + k) & (node != 2)
                rows, node = rows[longer], node[longer]
                if not len(rows) or k == pieces_.longest:
                    break
                node = pieces_.next(node, grid[rows, start + k])
                rows, node = rows[node != 0], node[node != 0]
        behind = np.zeros((len(b), longest + 1))
        behind[np.arange(len(b)), n] = 1
        for r, start, k, p, gain in reversed(edges):
            through = ahead[r, start] * gain * np.exp(sure[r, start] - sure[r, start + k]) * behind[r, start + k]
            behind[r, start] += through
            total += np.bincount(p * chance.shape[1] + own[r], through * times[r], minlength=chance.size)
    return total.reshape(chance.shape)


def in_training(doc_id: Column) -> Column:
    """Documents a model may learn from; the others are held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) != 2


class Model:
    def __init__(self, pieces_: Pieces, languages: list[str], chance: np.ndarray):
        self.pieces, self.languages, self.chance = pieces_, languages, chance

    def log_likelihood(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each text in each language; and the letters read."""
        codes, begin, length, first = self.pieces.runs(data, offsets, whole=True)
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        letters = np.zeros(len(offsets) - 1, np.int64)
        if len(begin):
            row, number = _distinct(codes, begin, length)
            logs = log_forward(self.pieces, self.chance, codes, begin[row], length[row])[number]
            full = np.flatnonzero(np.diff(first))
            out[full] = np.add.reduceat(logs, first[full])
            letters[full] = np.add.reduceat(length, first[full])
        return out, letters

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its share of the probability, rounded to 6 places."""
        logs, letters = self.log_likelihood(data, offsets)
        best = logs.argmax(axis=1)
        share = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        some = letters > 0
        names = [self.languages[k] if s else UNDETERMINED for k, s in zip(best, some, strict=True)]
        return names, np.where(some, np.round(share, 6), 0.0)


def read_vocabulary(path: str) -> list[str]:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(k) for k in range(model.get_piece_size())]


def fit(docs: DataFrame, vocabulary: list[str], train_rows: int = TRAIN_ROWS) -> Model | None:
    """A model of the languages in ``lang`` of the training documents (doc_id, text, lang).

    It learns from about ``train_rows`` documents of each language, drawn by hash of doc_id;
    what reaches the driver is a count for each piece and language. Null languages, the names
    of none and empty texts teach nothing. None if there is nothing to learn from.
    """
    learn = docs.select("doc_id", "text", "lang").where(
        in_training(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("lang") != UNDETERMINED))
    sizes = {r.lang: r["count"] for r in learn.groupBy("lang").count().collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    shipped = docs.sparkSession.sparkContext.broadcast((Pieces(vocabulary), {name: k for k, name in enumerate(languages)}))
    draw = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    wanted = reduce(
        lambda a, b: a | b, ((F.col("lang") == name) & (draw < train_rows / size) for name, size in sizes.items()))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, number = shipped.value
        for batch in pieces(batches):
            codes, begin, length, first = shape.runs(*as_utf8(batch.column("text")))
            own = np.repeat([number[x] for x in batch.column("lang").to_pylist()], np.diff(first))
            words = [codes[b : b + n].tobytes() for b, n in zip(begin, length, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(words, pa.binary())], names=["language", "word"])

    words = staged(
        learn.where(wanted).mapInArrow(runs, "language int, word binary")
        .groupBy("language", "word").agg(F.count("*").cast("double").alias("times")), "words")
    shape = shipped.value[0]
    chance = np.where(shape.is_piece, 1 / shape.is_piece.sum(), 0)[:, None].repeat(len(languages), axis=1)
    for _ in range(ROUNDS):
        chance[2] = UNKNOWN
        now = docs.sparkSession.sparkContext.broadcast(chance)

        def expect(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total = np.zeros(now.value.shape)
            for batch in batches:
                word = batch.column("word").to_pylist()
                length = np.array([len(w) // 4 for w in word])
                codes = np.frombuffer(b"".join(word), np.int32)
                total += expected_counts(
                    shipped.value[0], now.value, batch.column("language").to_numpy(), batch.column("times").to_numpy(),
                    codes, np.cumsum(length) - length, length)
            node, language = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node.astype(np.int32)), pa.array(language.astype(np.int32)), pa.array(total[node, language])],
                names=["node", "language", "uses"])

        counted = words.mapInArrow(expect, "node int, language int, uses double").groupBy("node", "language").agg(F.sum("uses").alias("uses"))
        found = counted.toPandas()
        uses = np.zeros_like(chance)
        uses[found["node"], found["language"]] = found["uses"]
        uses[2] = 0
        smooth = np.where(shape.is_piece[:, None], uses + SMOOTHING, 0)
        smooth[2] = 0
        # Rounded, so that the order in which Spark adds up changes nothing.
        chance = np.maximum(np.round(smooth / smooth.sum(axis=0), 12), np.where(smooth > 0, 1e-12, 0))
    chance[2] = UNKNOWN
    return Model(shape, languages, chance)


def identify(docs: DataFrame, model: Model | None, columns: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred and score for the whole text of each row, after the ``columns`` named.

    ``score`` is the predicted language's share of the probability. Null texts and texts
    without letters, and all texts if there is no model, are ``und`` with score 0. Equal
    rows give equal rows. Only the text decides; nothing is shuffled. Of ``columns``, those
    named like the new ones are replaced.
    """
    names = [c for c in dict.fromkeys(("doc_id", *columns)) if c not in ("lang_pred", "score")]
    kept = docs.select(*dict.fromkeys(("text", *names)))
    schema = docs.select(*names, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=PIECE_BYTES):
            if shipped.value is None:
                found, score = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows)
            else:
                found, score = shipped.value.predict(*as_utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(found, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    return kept.mapInArrow(run, schema)


def told(docs: DataFrame, model: Model | None, least_score: float) -> DataFrame:
    """The rows of ``docs`` that ``identify`` gives a language with at least this score, all columns kept."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shipped.value is None:
            return
        for batch in pieces(batches, limit=PIECE_BYTES):
            found, score = shipped.value.predict(*as_utf8(batch.column("text")))
            known = np.array([name != UNDETERMINED for name in found], bool)
            yield batch.filter(pa.array(known & (score >= least_score)))

    return docs.mapInArrow(run, docs.schema)
