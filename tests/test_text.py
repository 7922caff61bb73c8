"""Row-local expressions against hand rows and Python's own string functions."""

import re
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from credence.functions import keys, text


def values(spark, expression, rows):
    """The expression over each value, in one Spark job."""
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, value string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("value")).alias("out")).collect()]


def test_strip_control_joins_words(spark):
    assert values(spark, text.strip_control, ["foo\nbar\tbaz", "a\r\nb", "", None]) == ["foobarbaz", "ab", "", None]


def test_literal_mode_removes_the_word_token_in_passes(spark):
    rows = ["a token b token token c", "token at an end", "x\ntoken\ty", "(Reuters) stays", " token" * 9 + " "]
    got = values(spark, text.strip_boilerplate, rows)

    def passes(s):
        for _ in range(5):
            s = re.sub(r"\stoken\s", "", s)
        return s

    assert got == [passes(r) for r in rows]
    assert values(spark, text.clean, rows[:1]) == ["abtoken c"]


def test_listed_mode_quotes_regex_characters(spark):
    rows = ["LONDON (Reuters) - x", "a copyright Reuters b", "Reuters alone", "see Vox now", "Voxel"]
    got = values(spark, lambda c: text.strip_boilerplate(c, "listed"), rows)
    assert got == ["LONDON- x", "ab", "Reuters alone", "seenow", "Voxel"]
    with pytest.raises(ValueError):
        text.strip_boilerplate("x", "other")


def test_later_listed_token_may_appear_through_an_earlier_deletion(spark):
    got = values(spark, lambda c: text.strip_boilerplate(c, "listed", ("b", "xy")), [" x b y ", " x", None])
    assert got == ["", " x", None]


def test_space_pieces_keep_empty_pieces(spark):
    rows = ["a  b", "", "a", " a ", "ä\tö ü"]
    assert values(spark, text.space_pieces, rows) == [len(r.split(" ")) for r in rows]


def test_word_and_character_edges(spark):
    assert values(spark, text.has_min_words, [" ".join("a" * 49), " ".join("a" * 50)]) == [False, True]
    assert values(spark, text.has_min_chars, ["é" * 999, "é" * 1000, "😀" * 1000]) == [False, True, True]


STRANGE = "a B\tc\x1cd\x1de\x0bF\x85g\xa0h i　j​k"


def test_tokens_split_like_python(spark):
    rows = [STRANGE, "", "   ", " x ", "ΑΣ ΑΣΑ", "one"]
    assert values(spark, text.tokens, rows) == [r.lower().split() for r in rows]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \t\n\x1c Éé", max_size=60), min_size=20, max_size=40))
def test_first_tokens_is_a_slice_of_tokens(spark, rows):
    for n in (0, 1, 3, 30):
        assert values(spark, lambda c, n=n: text.first_tokens(c, n), rows) == [r.lower().split()[:n] for r in rows]
        assert values(spark, lambda c, n=n: text.token_count(c, n), rows) == [len(r.split()[:n]) for r in rows]


def test_first_tokens_of_a_long_text_does_not_overflow(spark):
    rows = ["word " * 200_000, "x" * 1_000_000, " " * 1_000_000]
    got = values(spark, lambda c: text.first_tokens(c, 254), rows)
    assert [len(g) for g in got] == [254, 1, 0]


@pytest.mark.parametrize(("page", "shown"), [
    ("<p>a</script ><b>x", "a x"),
    ("one<script>two</script >three", "one three"),
    ("one<style media=x>two</STYLE >three", "one three"),
    ("when 3 < 4 and it matters</p>", "when 3 < 4 and it matters"),
    ('<a title="x > y">z', "z"),
    ("<a title='x > y' b = \"c>d\">z", "z"),
    ("<p class=it's>don't</p>", "don't"),
    ('<p>a="b"</p>', 'a="b"'),
    ("a &middot; b &copy; 2020 &copy 2021", "a · b © 2020 © 2021"),
    ("&amp;lt; &lt;b&gt; &#8212; &#x1F600; &#150; &#0; &#xD800; &#99999999999999999999;", "&lt; <b> — 😀 – \ufffd \ufffd \ufffd"),
    ("&nosuch; & &#; &&amp;&", "&nosuch; & &#; &&&"),
    ("x<nav>menu", "x menu"),
    ("<nav>a<nav>b</nav >c</nav>d", "c d"),
    ("<head><title>t</title></head><header>k</header>", "k"),
    ("a<!-- b > --> c <!-- d", "a c"),
    ("<script>var t='</p>';", ""),
    (None, None), ("", ""),
])
def test_html_cases(spark, page, shown):
    assert values(spark, text.html_text, [page]) == [shown]


@pytest.mark.parametrize("part", ["<nav>", "<head>", "<a ", '<a "', "<!--", "<script>", "<style>", "<a b='", "<", "&", "</nav>", "<a b='c' ", "&#", "="])
def test_hostile_pages_take_linear_time(spark, part):
    def seconds(size):
        df = spark.createDataFrame([("<a " + part * (size // len(part)),)], "h string")
        start = time.perf_counter()
        df.select(text.html_text("h").alias("t")).agg(F.length(F.max("t"))).collect()
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(2_000_000) < 30  # quadratic time would be hours


def test_html_text(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><nav><a>menu</a></nav>"
        "<!-- <p>no</p> --><SCRIPT type='x'>var t='</p>';</SCRIPT><p>One &amp; two&lt;b&gt;</p>"
        "<p>three&nbsp;&amp;lt;</p>\n</body></html>"
    )
    assert values(spark, text.html_text, [page, None, "plain"]) == ["One & two<b> three &lt;", None, "plain"]


def test_unclosed_markup_runs_to_the_end(spark):
    rows = ["a <script>b <p>c", "a <!-- b", "<p>a</p><style x='1'> b", "<head><p>a", "a < b", "x <script " * 50_000]
    assert values(spark, text.html_text, rows) == ["a", "a", "a", "a", "a < b", "x"]


def test_decode_or_empty(spark):
    df = spark.sql("SELECT CAST(unhex('FFFE62') AS STRING) AS value UNION ALL SELECT 'ok'")
    assert sorted(r[0] for r in df.select(text.decode_or_empty("value")).collect()) == ["", "ok"]


def test_host(spark):
    rows = ["https://www.bbc.com:443/news/x", "not a url", "http://A.b", "a/b"]
    assert values(spark, keys.host, rows) == ["www.bbc.com:443", None, "A.b", None]


def test_names(spark):
    rows = ["ab_c_10", "noscore", "x_", "a_7_b", "h_99999999999", "a_1\n"]
    assert values(spark, keys.score_of_name, rows) == [10, None, None, 7, None, 1]


def test_polarity_edge(spark):
    df = spark.createDataFrame([(5,), (6,), (None,)], "s int").select(keys.polarity("s").alias("p"))
    assert [r[0] for r in df.collect()] == [0, 1, None]


def test_hash_split_odds(spark):
    df = spark.range(40_000).select(keys.hash_split(F.sha1(F.col("id").cast("string"))).alias("split"))
    counts = {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}
    assert set(counts) == {"train", "dev", "test"}
    for part in ("dev", "test"):
        assert 300 < counts[part] < 500


def test_site_url(spark):
    assert values(spark, keys.site_url, ["a.com \t", "b.com ", "c d.com"]) == [
        "https://a.com", "https://b.com", "https://c d.com"
    ]
