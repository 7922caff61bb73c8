"""Words and word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import numpy as np

from .common import mix

# Space and U+0009..U+000D separate words.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_random = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BASE = int(_random.integers(1, 2**62)) * 8 + 5
_PLACE = _random.integers(1, 2**63, 8, dtype=np.uint64) | np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(size: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_powers[0]) < size:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(size, base % 2**64, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end; a text's end also ends a word."""
    inside = ~IS_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begins] = inside[begins]
    ends = begins[1:] - 1
    last[ends] = inside[ends]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, without regard to the case of A-Z, and each text's first word."""
    begin, end = word_bounds(data, offsets)
    power, inverse = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    hashes = mix((sums[end] - sums[begin]) * inverse[begin])
    return hashes, np.searchsorted(begin, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text in ascending order, and where each text's begin.

    A text of fewer words than ``width`` has one shingle, all its words; one without words has none.
    """
    words, first = word_hashes(data, offsets)
    count = np.diff(first)
    texts = len(count)
    spread = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        spread += words[k : k + len(spread)] * _PLACE[k]
    of_word = np.repeat(np.arange(texts), count)
    full = of_word[: len(spread)] == of_word[width - 1 :][: len(spread)]
    values, of_value = [mix(spread[full])], [of_word[: len(spread)][full]]
    for size in range(1, width):
        short = np.flatnonzero(count == size)
        if len(short):
            total = np.full(len(short), size, np.uint64) * _PLACE[7]
            for k in range(size):
                total += words[first[short] + k] * _PLACE[k]
            values.append(mix(total))
            of_value.append(short)
    value, text = np.concatenate(values), np.concatenate(of_value)
    order = np.argsort(value)
    order = order[np.argsort(text[order].astype(np.uint16 if texts < 1 << 16 else np.int64), kind="stable")]
    value, text = value[order], text[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    value, text = value[new], text[new]
    return value, np.searchsorted(text, np.arange(texts + 1))


def segment_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sum of each segment that begins at ``starts[k]`` and ends at ``starts[k + 1]``, empty ones 0."""
    sums = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=sums[1:])
    return sums[starts[1:]] - sums[starts[:-1]]
