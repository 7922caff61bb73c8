import random
import re
import time

import pyarrow as pa
import pytest

from credence.llm import decontamination
from credence.llm.common import as_utf8

from .helpers import clashing, no_docs, odd_docs

ITEM = "id long, t string"
PASSAGES = [
    (1, "The quick brown fox jumps over the lazy dog, and then it runs away from the old farmer's house at noon."),
    (2, "Señor Ñandú corrió por la montaña mientras él cantaba una canción muy larga sobre los días de lluvia en otoño."),
    (3, "short one"), (4, None), (5, ""), (6, "A passage of middling length, no more."),
]


def plain(text):
    return re.sub(r"[^\w]+", " ", text.lower()).strip()


def edits_within(passage, text):
    """Least edits with which the passage occurs anywhere in the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(passage, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@pytest.fixture(scope="module")
def passages():
    kept = [(k, t) for k, t in PASSAGES if t is not None]
    return decontamination.Passages([k for k, _ in kept], [t for _, t in kept])


def test_edited_passages_match_a_plain_alignment(passages):
    rng = random.Random(4)
    texts = []
    for _ in range(250):
        _, source = rng.choice([p for p in PASSAGES if p[1]])
        letters = list(plain(source))
        for _ in range(rng.randint(0, max(1, len(letters) // 9))):
            k, kind = rng.randrange(len(letters)), rng.random()
            if kind < 0.4:
                letters[k] = rng.choice("abcde ")
            elif kind < 0.7:
                letters.insert(k, rng.choice("abcde"))
            elif len(letters) > 1:
                del letters[k]
        texts.append("before it " + "".join(letters) + " and after")
    hits = {}
    for text, item, begin, end, edits in passages.hits(*as_utf8(pa.array(texts))):
        hits.setdefault((text, item), []).append((begin, end, edits))
    for t, text in enumerate(texts):
        for i in range(len(passages.ids)):
            size = int(passages.size[i])
            if size < decontamination.Q:
                assert (t, i) not in hits
                continue
            letters = "".join(map(chr, passages.letters[passages.starts[i] : passages.starts[i] + size]))
            least = edits_within(letters, plain(text))
            assert ((t, i) in hits) == (least <= passages.budget[i]), (text, letters)
            if (t, i) in hits:
                assert min(h[2] for h in hits[t, i]) == least


def test_places_and_other_punctuation(spark):
    bench = clashing(spark.createDataFrame(PASSAGES, "item_id long, text string"), "doc_id", "begin")
    text = "Before.\n" + PASSAGES[1][1].upper().replace(" ", "\n- ") + " After."
    docs = spark.createDataFrame([(1, text), (2, PASSAGES[0][1] * 3), (3, "nothing here"), (3, None), (None, PASSAGES[0][1])], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.item_id, r.edits, r.begin, r.end) for r in decontamination.find_passages(docs, bench).collect())
    assert [g[:3] for g in got] == [(0, 1, 0), (1, 2, 0), (2, 1, 0), (2, 1, 0), (2, 1, 0)]
    begin, end = got[1][3:]
    assert plain(text[begin:end]) == plain(PASSAGES[1][1])
    kept = decontamination.without_passages(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 3]


def test_blocks_of_passages_give_the_same(spark, monkeypatch):
    bench = spark.createDataFrame(PASSAGES, "item_id long, text string")
    docs = spark.createDataFrame([(k, f"intro {t} outro") for k, t in PASSAGES], "doc_id long, text string")
    whole = sorted(decontamination.find_passages(docs, bench).collect())
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 100)
    assert sorted(decontamination.find_passages(docs, bench).collect()) == whole
    assert sorted(r.doc_id for r in decontamination.without_passages(docs, bench).collect()) == [3, 4, 5]


def test_odd_rows(spark):
    bench = spark.createDataFrame(PASSAGES, "item_id long, text string")
    docs = clashing(odd_docs(spark), "item_id", "edits")
    assert decontamination.find_passages(docs, bench).count() == 0
    assert decontamination.without_passages(docs, bench).count() == docs.count()
    assert decontamination.find_passages(no_docs(spark), bench).count() == 0
    assert decontamination.find_passages(docs, bench.where("false")).count() == 0
    assert decontamination.without_passages(docs, bench.where("false")).columns == docs.columns


def test_passages_of_one_template(passages):
    """Many passages with a common prompt beside a text that repeats the prompt: nothing is found
    where nothing is, in time that does not grow with both; and what is there is found."""
    prompt = "Read the following question with care and answer with one of the letters: "
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9))) for _ in range(1500)]
    items = [prompt + " ".join(rng.choice(words) for _ in range(13)) for _ in range(2000)]
    many = decontamination.Passages(list(range(2000)), items)
    texts = [prompt * (1_000_000 // len(prompt)), "x " + items[77].replace("with care", "with some care") + " y " + prompt, prompt + " ".join(words[:40])]
    start = time.perf_counter()
    hits = many.hits(*as_utf8(pa.array(texts)))
    assert time.perf_counter() - start < 20
    for t in (1, 2):
        found = {i for text, i, *_ in hits if text == t}
        least = {i: edits_within(plain(items[i]), plain(texts[t])) for i in {77, 78, *found, *rng.sample(range(2000), 25)}}
        assert all((i in found) == (e <= many.budget[i]) for i, e in least.items())
    assert any(i == 77 for text, i, *_ in hits if text == 1)
    repeated = texts[0][: 3 * len(prompt)]
    assert {i for text, i, *_ in hits if text == 0} == {i for i in rng.sample(range(2000), 60) if edits_within(plain(items[i]), plain(repeated)) <= many.budget[i]}


def test_nearly_equal_passages_are_all_found():
    base = "the committee agreed that the results of the survey would be published in the spring of next year"
    items = [base.replace("spring", s) for s in ("spring", "autumn", "winter", "summer", "second half", "third week")] + [base] * 3
    near = decontamination.Passages(list(range(len(items))), items)
    text = "so " + base.replace("agreed", "agrees") + " then"
    found = {own for _, i, *_ in near.hits(*as_utf8(pa.array([text]))) for own in near.ids[i]}
    assert found == {k for k, item in enumerate(items) if edits_within(item, text) <= near.budget[next(i for i, o in enumerate(near.ids) if k in o)]}
    assert {0, 6, 7, 8} <= found


def test_null_item_ids_and_repeated_passages(spark):
    bench = spark.createDataFrame([(None, PASSAGES[0][1]), (1, PASSAGES[0][1]), (1, PASSAGES[0][1].upper())], "item_id long, text string")
    docs = spark.createDataFrame([(5, f"a {PASSAGES[0][1]} b"), (6, "no")], "doc_id long, text string")
    assert sorted(str(r.item_id) for r in decontamination.find_passages(docs, bench).collect()) == ["1", "1", "None"]
    assert [r.doc_id for r in decontamination.without_passages(docs, bench.where("item_id is null")).collect()] == [6]
