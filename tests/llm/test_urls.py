import re

import pytest
from pyspark.sql import functions as F

from credence.llm import urls

from .helpers import clashing

TAGS = "page_id long, bad int"


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    fits = [(d + p, v) for d, p, v in urls.RULES if (host == d or host.endswith("." + d)) and path.startswith(p)]
    return max(fits, key=lambda r: len(r[0]), default=(None, None))


URLS = [
    None, "", "no scheme", "http://", "http:///x", "HTTP://WWW.Example.NET/en/1?x=/de/", "a://b://c/d", "http://net/", "http://net",
    "http://xnet/a", "http://a.example.com/de/x", "http://example.com/de", "http://EXAMPLE.com#frag/de/", "http://x.org/fr/#a", "http://org/fr/",
    "http://a.example.net/en/a/b/c/d/e/f/g/h/i", "http://ÄB.example.org/É?q", "http://a.b/\n/c", "x\ny://h/p", "http://h//", "http://u@h:80/a//b/",
    "http://sub.org/fr", "http://example.net/en/", "http://.net/x",
]


def test_parts_and_rules(spark):
    pages = clashing(spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string"), "host", "path", "bad", "template")
    got = {r.page_id: r for r in urls.judge(pages, spark.createDataFrame([], TAGS)).collect()}
    assert len(got) == len(URLS)
    for k, url in enumerate(URLS):
        host, path = split_url(url)
        rule, verdict = rule_of(host, path)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule), url
        assert got[k].verdict == (verdict or got[k].verdict) and got[k].verdict in ("allow", "block")


@pytest.mark.parametrize(("segment", "want"), [
    ("123", "*"), ("123.html", "*.html"), ("deadbeef", "deadbeef"), ("deadbee1", "*"), ("a1", "a1"), ("", ""), ("2024-01-02", "*"), ("page12", "page12")])
def test_segments_that_look_variable(spark, segment, want):
    assert spark.range(1).select(urls.looks_variable(F.lit(segment)).alias("s")).first().s == want


def test_bad_branches_are_rejected_and_others_kept(spark):
    rows, tags, k = [], [], 0
    for host, branch, bad in (("a.com", "spam", 1), ("a.com", "news", 0), ("b.com", "spam", 0), ("c.com", "shop", 1), ("c.com", "cart", 1)):
        for n in range(40):
            rows.append((k, f"http://{host}/{branch}/item-{n}-{'xyz'[n % 3]}"))
            if n % 2:
                tags.append((k, bad))
            k += 1
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(tags, TAGS)).collect()}
    for page_id, url in rows:
        want = "block" if "a.com/spam" in url or "c.com" in url else "allow"
        assert got[page_id].verdict == want, (url, got[page_id])
        assert got[page_id].template.endswith("/*")


def plain_impurity(rows, tags):
    """The smoothed tree by loops over one host's already general templates."""
    tag = dict(tags)
    whole = (sum(tag.values()) + 1) / (len(tag) + 2)
    smooth = lambda b, t, prior: (b + urls.STRENGTH * prior) / (t + urls.STRENGTH)
    count = lambda prefix: (
        sum(1 for i, s in rows if i in tag and s[: len(prefix)] == prefix), sum(tag[i] for i, s in rows if i in tag and s[: len(prefix)] == prefix))
    t, b = count(())
    rate = {(): smooth(b, t, whole)}
    for level in range(1, max(len(s) for _, s in rows) + 1):
        nodes = {s[:level] for _, s in rows if len(s) >= level}
        for parent in {n[:-1] for n in nodes}:
            family = {n: count(n) for n in nodes if n[:-1] == parent}
            all_t, all_b = sum(t for t, _ in family.values()), sum(b for _, b in family.values())
            merge = {}
            for n, (t, b) in family.items():
                o, p = all_t - t, all_b / all_t if all_t else 0
                error = (p * (1 - p) * (1 / t + 1 / o)) ** 0.5 if t and o else 0
                merge[n] = not error or abs(b / t - (all_b - b) / o) / error < urls.SIGNIFICANT
            mt, mb = sum(family[n][0] for n in family if merge[n]), sum(family[n][1] for n in family if merge[n])
            for n, (t, b) in family.items():
                rate[n] = smooth(mb, mt, rate[parent]) if merge[n] else smooth(b, t, rate[parent])
    return rate


def test_purity_matches_a_plain_tree(spark):
    rows, tags = [], []
    for k in range(300):
        path = [("en", "a"), ("en", "b"), ("de", "a"), ("fr",), ("en", "b", "c")][k % 5]
        rows.append((k, path))
        if k % 2:
            tags.append((k, int((path[0] == "de" and k % 7 > 0) or k % 11 == 0)))
    pages = spark.createDataFrame([(k, "http://h.com/" + "/".join(p)) for k, p in rows], "page_id long, url string")
    want = plain_impurity(rows, tags)
    for r in urls.judge(pages, spark.createDataFrame(tags, TAGS)).collect():
        assert abs(r.impurity - want[dict(rows)[r.page_id]]) < 1e-5


def test_odd_tags_and_no_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c"), (1, "http://a.b/c"), (None, "http://a.b/d"), (2, None)], "page_id long, url string")
    tags = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (99, 1)], TAGS)
    assert urls.judge(pages, tags).count() == 4
    assert urls.judge(pages.where("false"), tags).count() == 0


def test_sections_with_enough_tags_stay_apart_however_many_there_are(spark):
    rows, tags, k = [], [], 0
    for section in range(30):
        for n in range(12):
            rows.append((k, f"http://big.com/section{'abcdefghijklmnopqrstuvwxyzABCD'[section]}/item-{n}"))
            tags.append((k, int(section == 7)))
            k += 1
    for n in range(20):  # names of one page each
        rows.append((k, f"http://big.com/name-{n}-x"))
        k += 1
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(tags, TAGS)).collect()}
    for page_id, url in rows:
        assert got[page_id].verdict == ("block" if "/sectionh/" in url else "allow"), url
        assert (got[page_id].template == "/*") == ("name-" in url)


def test_branches_are_told_apart_at_any_depth(spark):
    rows, tags, k = [], [], 0
    for branch in ("spam", "news"):
        for n in range(40):
            rows.append((k, f"http://deep.com/a/b/c/d/e/f/g/h/{branch}/item-{n}"))
            tags.append((k, int(branch == "spam")))
            k += 1
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(tags, TAGS)).collect()}
    for page_id, url in rows:
        assert got[page_id].verdict == ("block" if "spam" in url else "allow"), got[page_id]
