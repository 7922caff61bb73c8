import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from credence.llm import quality
from credence.llm.common import as_utf8

from .helpers import clashing, no_docs, odd_docs, odd_rows, words

LABELS = "doc_id long, quality int, toxic int"


def features(text):
    data = (text or "").encode()
    w = [x.encode().lower() for x in words(text)]  # bytes.lower() is A-Z only
    size, some = max(len(data), 1), max(len(w), 1)
    return {
        "log_words": math.log2(some), "distinct_share": len(set(w)) / some,
        "symbol_share": sum(33 <= b < 127 and not chr(b).isalnum() for b in data) / size,
        "capital_share": sum(65 <= b <= 90 for b in data) / size, "digit_share": sum(48 <= b <= 57 for b in data) / size,
        "word_bytes": size / some if w else 0,
    }


def test_features_match_plain_ones():
    texts = [t for _, t, *_ in odd_rows()]
    got = quality.text_features(*as_utf8(pa.array(texts, pa.string())))
    for k, text in enumerate(texts):
        for name, value in features(text).items():
            assert abs(got[name][k] - value) < 1e-12, (name, text and text[:40])


def strength(groups):
    """(share, count, prior) of each group."""
    total = sum(n for _, n, _ in groups)
    noise = sum(p * (1 - p) for _, _, p in groups) / len(groups)
    between = (sum(n * (s - p) ** 2 for s, n, p in groups) - len(groups) * noise) / (total - sum(n * n for _, n, _ in groups) / total) if len(groups) > 1 else None
    if between is None or between <= 0:
        return quality.MOST_STRENGTH
    return max(quality.LEAST_STRENGTH, min(quality.MOST_STRENGTH, noise / between - 1))


def brute_force(docs, labels):
    good = dict(labels)
    bins = {d: {f: int(np.searchsorted(e, features(t)[f])) for f, e in quality.BINS.items()} for d, t, *_ in docs}
    ratios = {}
    for f, edges in quality.BINS.items():
        count = np.ones((2, len(edges) + 1))
        for d, *_ in docs:
            if d in good:
                count[good[d], bins[d][f]] += 1
        ratios[f] = np.round(np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum()), 9)
    paths, hosts = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for d, _, path, host in docs:
        for stat in (paths[host, path], hosts[host]):
            stat[0] += d in good
            stat[1] += good.get(d, 0)
    n, k = sum(s[0] for s in hosts.values()), sum(s[1] for s in hosts.values())
    whole = (k + 1) / (n + 2)
    m = strength([(k / n, n, whole) for n, k in hosts.values() if n])
    above = {h: (k + m * whole) / (n + m) for h, (n, k) in hosts.items()}
    m = strength([(k / n, n, above[h]) for (h, _), (n, k) in paths.items() if n])
    out = {}
    for d, _, path, host in docs:
        n, k = paths[host, path]
        prior = round((k + m * above[host]) / (n + m), 6)
        evidence = round(float(sum(ratios[f][bins[d][f]] for f in quality.BINS)), 6)
        out[d] = (evidence, prior, 1 / (1 + math.exp(-(math.log(prior / (1 - prior)) + evidence))))
    return out


def test_matches_brute_force_and_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    tags = {r.doc_id: r.quality for r in labels.collect()}
    want = brute_force([(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()], tags.items())
    assert set(got) == set(want)
    for d, (evidence, prior, posterior) in want.items():
        assert abs(got[d].evidence - evidence) < 2e-6 and abs(got[d].site_prior - prior) < 2e-6 and abs(got[d].quality - posterior) < 1e-5
    assert np.mean([got[d].keep == bool(q) for d, q in tags.items()]) > 0.95


def test_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    held = {r.doc_id: r.quality for r in labels if zlib.crc32(str(r.doc_id).encode()) % 3 == 0}
    rest = spark.createDataFrame([r for r in labels if r.doc_id not in held], LABELS)
    got = {r.doc_id: r.keep for r in quality.classify(docs, rest).collect()}
    for quality_label in (0, 1):
        own = [d for d, q in held.items() if q == quality_label]
        assert np.mean([got[d] == bool(quality_label) for d in own]) > 0.93


def test_sparse_sites_shrink(spark):
    rows = [("big", "x", 1)] * 80 + [("big", "x", 0)] * 20 + [("small", "x", 0)] + [("other", "y", 1)] * 50 + [("new", "z", None)] + [(None, None, 1)]
    priors, whole = quality.site_priors(spark.createDataFrame(rows, "host string, path string, good int"))
    found = {r.host: r.prior for r in priors.collect()}
    assert 0.7 < whole < 0.95 and len(found) == 5
    assert abs(found["big"] - 0.8) < 0.03 and 0.3 < found["small"] < whole and abs(found["new"] - whole) < 0.02


def test_odd_rows(spark):
    docs = clashing(odd_docs(spark), "host", "path", "keep", "quality", "good")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (1, 1, 1), (8, 0, 0), (None, 1, 0), (2, None, 0), (77, 1, 0)], LABELS)
    rows = quality.classify(docs, labels).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in odd_rows())
    assert all(0 < r.quality < 1 for r in rows)
    none = quality.classify(docs, labels.where("false")).collect()
    assert len(none) == len(rows) and {r.site_prior for r in none} == {0.5}
    assert quality.classify(no_docs(spark), labels).count() == 0
