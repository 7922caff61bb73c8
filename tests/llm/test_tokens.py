import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from credence.llm import tokens
from credence.llm.common import as_utf8

from .helpers import clashing, no_docs, odd_docs, odd_rows

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["'", "s", "t", "re", "ve", "ll", "m", "d", " ", "  ", "\n", "\t", "a", "B", "é", "1", "23", "²", ".", "!!", "<|endoftext|>",
         "<|endof", "　", "中", "😀", "​", "\x1c", "\x85", "ß", "١", "e", "r", "l", "----", "́", "\xa0"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, "rb") as file:
        return tokens.Vocabulary(file.read())


def same(library, vocabulary, texts):
    got = vocabulary.token_counts(*as_utf8(pa.array(texts, pa.string())))
    return got.tolist() == [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_random_texts(library, vocabulary):
    rng = random.Random(1)
    assert same(library, vocabulary, ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(4000)])


def test_every_code_point_of_the_basic_plane(library, vocabulary):
    points = [chr(p) for p in range(0x10000) if not 0xD800 <= p < 0xE000]
    texts = ["".join(f"a{c}b {c} {c}" for c in points[k : k + 64]) for k in range(0, len(points), 64)]
    assert same(library, vocabulary, texts)


def test_long_runs(library, vocabulary):
    assert same(library, vocabulary, ["a" * 70_000, " " * 5000, "\n" * 3000 + "x", "ab" * 9000 + "'s", "-" * 999, None, ""])


def test_few_states_begin_anew_with_the_same_counts(library, vocabulary, monkeypatch):
    monkeypatch.setattr(tokens, "MAX_STATES", 50)
    rng = random.Random(2)
    for _ in range(5):
        assert same(library, vocabulary, ["".join(rng.choice(PARTS) for _ in range(30)) for _ in range(200)])


def test_chunks_do_not_matter(library, vocabulary, monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK", 3)
    rng = random.Random(3)
    assert same(library, vocabulary, ["".join(rng.choice(PARTS) for _ in range(30)) for _ in range(500)])


def test_frame(spark, library):
    docs = clashing(odd_docs(spark), "n_tokens", "over_limit")
    got = tokens.count_tokens(docs, PATH).collect()
    assert len(got) == len(odd_rows())
    for row in got:
        count = len(library.encode(row.text or "", add_special_tokens=False).ids)
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len((row.text or "").encode()), count, count > 512)
    assert tokens.count_tokens(no_docs(spark), PATH).count() == 0
