"""The article of a page by block density."""

import random
import time

import pytest
from pyspark.sql import functions as F

from credence.functions import text
from credence.operators import ingest


def articles(spark, pages):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    return [r.text for r in ingest.extract_article(df).orderBy("i").collect()]


def words(n, of="word"):
    return " ".join(f"{of}{k}" for k in range(n))


FIRST, SECOND, LAST = words(45, "first"), words(80, "second"), words(16, "last")
MENU = "".join(f'<li><a href="/{k}">Section {k}</a></li>' for k in range(9))
COMMENTS = "".join(f'<div class=c><a href="/u/{k}">reader{k} smith</a><p>{words(12, f"reply{k}x")}</p><a href="#">reply</a></div>' for k in range(6))
PAGE = f"""<!doctype html><html><head><title>Title</title><script>var a = "<p>{words(90)}</p>";</script></head>
<body><div id=top><ul>{MENU}</ul></div><!-- <p>{words(80)}</p> --><div class="ad">Buy now and save</div>
<div><h1>A headline of nine words or so it is</h1><p>{FIRST}</p><p>{SECOND} with <a href=x>a link</a> &amp; more</p>
<div>{LAST}</div></div>
<aside><p>{words(60, "aside")}</p></aside><div class=related><a href=1>{words(9, "teaser")}</a> <a href=2>{words(8, "other")}</a></div>
<div id=comments>{COMMENTS}</div>
<div class=foot>Copyright 2020 Paper. <a href=a>About us</a> <a href=b>Contact</a> <a href=c>Privacy policy</a></div>
<footer><p>{words(70, "foot")}</p></footer></body></html>"""


def test_menus_notices_comments_and_footers_go(spark):
    [got] = articles(spark, [PAGE])
    assert got == f"A headline of nine words or so it is {FIRST} {SECOND} with a link & more {LAST}"


def test_pages_without_an_article(spark):
    pages = ["", f"<ul>{MENU}</ul>", "<p>Too short a text.</p>", "plain words", None, "<", "<p", "<a href=x>" + words(99)]
    assert articles(spark, pages) == ["", "", "", "", None, "", "", ""]


def test_plain_text_and_unclosed_blocks(spark):
    assert articles(spark, [FIRST, f"<p>{FIRST}<p>{SECOND}", f"<p>{FIRST}<br>{SECOND}", f"<p>{FIRST}<b>{LAST}</b></p>"]) == [
        FIRST, f"{FIRST} {SECOND}", f"{FIRST} {SECOND}", f"{FIRST} {LAST}"]


def test_two_regions_the_denser_one_is_taken_whole(spark):
    gap = "".join(f"<p><a>link {k} text here</a></p>" for k in range(8))
    assert articles(spark, [f"<p>{FIRST}</p>{gap}<p>{SECOND}</p><p>{FIRST}</p>", f"<p>{FIRST}</p>{gap}<p>{SECOND}</p>"]) == [
        f"{SECOND} {FIRST}", FIRST], "of equal ones the first"


def test_marks_cannot_be_forged(spark):
    text_ = f"a&#1;b&#x2;c&#03;d\x01e {FIRST} &#12;&#x1f; &#10;"
    assert articles(spark, [f"<p>{text_}</p>"]) == [f"a b c d e {FIRST}"]


def brute(blocks):
    blocks = [(t, n - 3 * link) for t, n, link in blocks if n]
    own = [0, *(max(-10, min(30, v)) for _, v in blocks), 0]
    value = [own[k - 1] + 2 * own[k] + own[k + 1] - 48 for k in range(1, len(own) - 1)]
    spans = [(sum(value[i : j + 1]), -j, i) for j in range(len(value)) for i in range(j + 1)]
    total, j, i = max(spans, default=(0, 0, 0))
    return " ".join(t for t, _ in blocks[i : -j + 1]) if total > 0 else ""


@pytest.mark.parametrize("seed", range(4))
def test_region_against_all_runs_of_blocks(spark, seed):
    rng = random.Random(seed)
    pages, wanted = [], []
    for _ in range(40):
        page, blocks = "", []
        for k in range(rng.randint(0, 14)):
            plain, link = rng.choice([0, 3, 8, 14, 25, 40]), rng.choice([0, 0, 0, 1, 4])
            before, linked = words(plain, f"t{k}x"), words(link, f"l{k}x")
            tag = rng.choice(["p", "div", "li", "h2", "TD", "section"])
            page += f'<{tag} class="a>b">{before} <a href="x">{linked}</a></{tag}>'
            blocks.append((f"{before} {linked}".strip(), plain + link, link))
        pages.append(page)
        wanted.append(brute(blocks))
    assert articles(spark, pages) == wanted


def test_long_pages_take_linear_time(spark):
    def seconds(page, times):
        df = spark.createDataFrame([(page * times,)], "h string")
        start = time.perf_counter()
        df.select(F.length(text.article_text("h"))).collect()
        return time.perf_counter() - start

    for page in (f"<p>{LAST}</p>", "<a>x", "<p", "&amp;", "<footer>", f"<div>{words(3)}"):
        seconds(page, 50)
        assert seconds(page, 20_000) < 10
