"""Document quality by hierarchical empirical Bayes.

Evidence of the document: features of its whole text, each cut into bins, whose counts among
good and bad labelled documents give log-likelihood ratios. Prior of its site: the share of
good documents at each host is shrunk towards the global share, and at each path of a host
towards the host's, by a strength that the spread between hosts (or paths) determines, by
moments. The posterior adds the evidence to the prior's log odds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_utf8, pieces, staged
from .words import segment_sums, word_hashes

# Upper bounds of the bins of each feature; there is one more bin above the last.
BINS = {
    "log_words": (1, 2, 3, 4, 5, 6, 7, 8),
    "distinct_share": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8),
    "symbol_share": (0.005, 0.01, 0.02, 0.04, 0.08, 0.12, 0.2, 0.4),
    "capital_share": (0.005, 0.01, 0.02, 0.04, 0.08, 0.2, 0.5, 0.8),
    "digit_share": (0.001, 0.005, 0.01, 0.05, 0.1, 0.3),
    "word_bytes": (2, 3, 4, 5, 6, 7, 9, 14),
}
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1000.0
KEEP = 0.5

_CAPITAL, _DIGIT, _SYMBOL = (np.zeros(256, np.int64) for _ in range(3))
_CAPITAL[ord("A") : ord("Z") + 1] = 1
_DIGIT[ord("0") : ord("9") + 1] = 1
_SYMBOL[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = 1


def text_features(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Each feature's value for each text; shares are of its bytes or words, 0 where it has none."""
    words, first = word_hashes(data, offsets)
    count = np.diff(first)
    size = np.maximum(np.diff(offsets), 1)
    texts = np.repeat(np.arange(len(count)), count)
    order = np.argsort(words)
    order = order[np.argsort(texts[order], kind="stable")]
    new = np.ones(len(words), bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (texts[order][1:] != texts[order][:-1])
    distinct = segment_sums(new.astype(np.int64), first)
    some = np.maximum(count, 1)
    share = lambda weight: segment_sums(weight[data], offsets) / size
    return {
        "log_words": np.log2(some), "distinct_share": distinct / some, "symbol_share": share(_SYMBOL),
        "capital_share": share(_CAPITAL), "digit_share": share(_DIGIT), "word_bytes": np.where(count > 0, size / some, 0),
    }


def _binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        values = text_features(*as_utf8(batch.column("text")))
        bins = [np.searchsorted(edges, values[name]).astype(np.int32) for name, edges in BINS.items()]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "host", "path")), *map(pa.array, bins)], names=["doc_id", "host", "path", *BINS])


def _strength(share: str, count: str, prior: Column) -> Column:
    """Beta prior strength from the spread of shares around their prior, by moments.

    The spread that is beyond sampling error is prior * (1 - prior) / (strength + 1).
    """
    error = F.col(count) * (F.pow(F.col(share) - prior, 2))
    noise = prior * (1 - prior)
    groups, total = F.count("*"), F.sum(count)
    between = (F.sum(error) - groups * F.avg(noise)) / (total - F.sum(F.col(count) * F.col(count)) / total)
    strength = F.avg(noise) / between - 1
    return F.when((between <= 0) | between.isNull(), MOST_STRENGTH).otherwise(
        F.greatest(F.lit(LEAST_STRENGTH), F.least(F.lit(MOST_STRENGTH), strength)))


def site_priors(tagged: DataFrame) -> tuple[DataFrame, float]:
    """(host, path, prior) for the paths of ``tagged`` (host, path, good or null), and the global share.

    Null hosts and paths are a host and a path. Only counts are grouped.
    """
    paths = staged(tagged.groupBy("host", "path").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("k")), "paths")
    n, k = paths.agg(F.sum("n"), F.sum("k")).first()
    whole = ((k or 0) + 1) / ((n or 0) + 2)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("k").alias("hk"))
    rated = hosts.where("hn > 0").withColumn("share", F.col("hk") / F.col("hn"))
    strength = rated.agg(_strength("share", "hn", F.lit(whole)).alias("m")).first().m or MOST_STRENGTH
    hosts = hosts.withColumn("above", (F.col("hk") + strength * whole) / (F.col("hn") + strength))
    both = paths.alias("p").join(hosts.alias("h"), F.col("p.host").eqNullSafe(F.col("h.host"))).select("p.*", "h.above")
    rated = both.where("n > 0").withColumn("share", F.col("k") / F.col("n"))
    strength = rated.agg(_strength("share", "n", F.col("above")).alias("m")).first().m or MOST_STRENGTH
    return both.select("host", "path", ((F.col("k") + strength * F.col("above")) / (F.col("n") + strength)).alias("prior")), whole


def evidence_ratios(tagged: DataFrame) -> dict[str, list[float]]:
    """Log-likelihood ratio (good to bad) of each bin of each feature; bins are smoothed by one each."""
    features = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("bin")) for f in BINS))).alias("f")
    counted = tagged.where("good is not null").groupBy("good", *BINS).count().select("good", "count", features)
    rows = counted.groupBy("good", "f.feature", "f.bin").agg(F.sum("count").alias("n")).collect()
    counts = {f: np.ones((2, len(edges) + 1)) for f, edges in BINS.items()}
    for r in rows:
        counts[r.feature][r.good, r.bin] += r.n
    return {f: np.round(np.log(c[1] / c[1].sum()) - np.log(c[0] / c[0].sum()), 9).tolist() for f, c in counts.items()}


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, evidence, site_prior, quality (0 to 1) and keep for each row of ``docs``.

    ``labels`` (doc_id, quality 0 or 1) tags some documents; several tags of one count as good
    if most are. ``host`` and ``path`` name the site's two levels. Null and empty texts are judged
    like others, by their features. Without labels all have quality 0.5. Equal rows are judged
    each. The corpus moves as features only.
    """
    rows = docs.select("doc_id", F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), "text")
    bins = ", ".join(f"{f} int" for f in BINS)
    features = staged(rows.mapInArrow(_binned, f"doc_id long, host string, path string, {bins}"), "features")
    tags = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("good"))
    tagged = staged(features.join(tags, "doc_id", "left"), "tagged")
    ratios = evidence_ratios(tagged)
    priors, whole = site_priors(tagged.select("host", "path", "good"))
    evidence = sum((F.element_at(F.array(*map(F.lit, ratios[f])), F.col(f) + 1) for f in BINS), F.lit(0.0))
    same = F.col("t.host").eqNullSafe(F.col("s.host")) & F.col("t.path").eqNullSafe(F.col("s.path"))
    judged = tagged.alias("t").join(priors.alias("s"), same, "left").select(
        "t.doc_id", F.round(evidence, 6).alias("evidence"), F.round(F.coalesce("s.prior", F.lit(whole)), 6).alias("site_prior"))
    odds = F.log(F.col("site_prior") / (1 - F.col("site_prior"))) + F.col("evidence")
    quality = F.round(1 / (1 + F.exp(-odds)), 6)
    return judged.select("*", quality.alias("quality")).withColumn("keep", F.col("quality") >= KEEP)
