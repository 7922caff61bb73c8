import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from credence.llm import sharding

from .helpers import clashing, no_docs, odd_docs


def content(df):
    return Counter(tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect())


def gapless(rows):
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    return all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_fisher_yates_is_a_fair_permutation():
    random = np.random.Generator(np.random.PCG64(1))
    seen = Counter(tuple(sharding.fisher_yates(4, random)) for _ in range(24_000))
    assert len(seen) == 24 and max(seen.values()) < 1150 and min(seen.values()) > 850
    assert sharding.fisher_yates(0, random) == [] and sharding.fisher_yates(1, random) == [0]


def test_rows_come_back_once(spark):
    docs = clashing(odd_docs(spark), "shard", "slot", "bucket", "position", "order_key", "grown_shard")
    out = sharding.sharded(docs, shards=3)
    rows = out.collect()
    assert content(out) == content(docs) and gapless(rows)
    assert sorted(map(str, sharding.sharded(docs, shards=3).collect())) == sorted(map(str, rows))
    assert sharding.sharded(no_docs(spark)).count() == 0


def test_only_the_new_shard_takes_rows(spark):
    ids = spark.range(5000).select(F.col("id").alias("doc_id"))
    both = ids.select(sharding.shard_column(F.col("doc_id"), 16, 0).alias("a"), sharding.shard_column(F.col("doc_id"), 17, 0).alias("b")).collect()
    assert all(r.a == r.b or r.b == 16 for r in both)
    sizes = Counter(r.a for r in both)
    assert set(sizes) == set(range(16)) and max(sizes.values()) < 420
    assert 200 < sum(r.b == 16 for r in both) < 400


def test_one_id_and_one_text_in_a_third_of_the_rows(spark):
    hot = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id")).alias("doc_id"),
        F.concat(F.lit("text "), F.when(F.col("id") % 3 == 0, F.col("id") % 30).otherwise(F.col("id")).cast("string")).alias("text"))
    rows = sharding.sharded(hot, shards=4).collect()
    assert len(rows) == 900 and gapless(rows)
    assert len({r.shard for r in rows if r.doc_id is None}) == 1
    assert len({r.bucket for r in rows if r.doc_id is None}) > 1


def test_slots_mix_ids_and_bytes_survive(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("é😀"), F.col("id").cast("string")), 5).alias("text"))
    rows = sharding.sharded(docs, shards=2).collect()
    for shard in (0, 1):
        ids = [r.doc_id for r in sorted((r for r in rows if r.shard == shard), key=lambda r: r.slot)]
        assert abs(np.corrcoef(ids, range(len(ids)))[0, 1]) < 0.1
    assert all(zlib.crc32(r.text.encode()) == zlib.crc32((f"é😀{r.doc_id}" * 5).encode()) for r in rows)
