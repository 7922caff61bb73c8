"""Filters of what was stored, and the stateful stream beside the batch job."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from credence.operators import history
from credence.streaming import incremental

SCHEMA = "url string, sha1 string, text string, corpus string, polarity int"


def rows(spark, keys, sha="a"):
    return spark.createDataFrame([(f"u{k}" if k is not None else None, f"{sha}{k}", f"text {k}", "known", 1) for k in keys], SCHEMA)


def stored(spark, path):
    return sorted((r.url or "", r.sha1) for r in spark.read.parquet(path).select("url", "sha1").collect())


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(6000).select(F.concat(F.lit("u"), "id").alias("k"))
    pages = history.pages_for(6000)
    filters = history.filter_pages(keys, "k", pages)
    assert filters.agg(F.sum("keys")).first()[0] == 6000
    told = history.maybe_seen(spark.range(20_000).select(F.concat(F.lit("u"), "id").alias("k"), "id"), "k", filters, pages)
    found = told.groupBy("maybe", F.col("id") < 6000).count().collect()
    counts = {(r.maybe, r[1]): r["count"] for r in found}
    assert counts[True, True] == 6000 and (False, True) not in counts
    assert counts.get((True, False), 0) < 0.01 * 14_000
    none = spark.createDataFrame([(None, 1)], "k string, id int")
    assert not history.maybe_seen(none, "k", filters, pages).first().maybe


def test_appends_in_runs_equal_one_anti_join(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(history, "KEYS_PER_PAGE", 20)
    path = str(tmp_path / "t")
    seen = {}
    for run, keys in enumerate(([1, 2, 3], range(2, 40), range(0, 90, 3), [5, 6], range(80, 300))):
        incremental.append_unseen(rows(spark, list(keys), f"r{run}x"), path)
        for k in keys:
            seen.setdefault(f"u{k}", f"r{run}x{k}")
    assert stored(spark, path) == sorted(seen.items())
    generations = [int(os.path.basename(p)) for p in glob.glob(f"{path}/_seen/[0-9]*")]
    assert len(generations) > 1, "the filter has grown"
    filters = history.Filters(spark, f"{path}/_seen")
    assert filters.pages == max(generations) and filters.rows().agg(F.sum("keys")).first()[0] == len(seen)


def test_articles_without_url_and_history_without_filter(spark, tmp_path):
    path = str(tmp_path / "t")
    rows(spark, [1, 2]).write.partitionBy("corpus", "polarity").parquet(path)
    none = rows(spark, [None], "b").union(rows(spark, [None], "b")).union(rows(spark, [2, 3]))
    incremental.append_unseen(none, path)
    incremental.append_unseen(none, path)
    assert stored(spark, path) == [("", "bNone"), ("u1", "a1"), ("u2", "a2"), ("u3", "a3")]


def test_a_filter_left_by_a_failed_run_drops_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    incremental.append_unseen(rows(spark, [1]), path)
    filters = history.Filters(spark, f"{path}/_seen")
    filters.add(rows(spark, [7, 8]).withColumnRenamed("url", "identity"), "identity")  # its articles were never written
    os.makedirs(f"{path}/_seen/999")  # a generation that was never finished
    incremental.append_unseen(rows(spark, [1, 7, 8, 9]), path)
    assert stored(spark, path) == [("u1", "a1"), ("u7", "a7"), ("u8", "a8"), ("u9", "a9")]


def test_only_maybe_seen_reach_the_history(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    incremental.append_unseen(rows(spark, range(500)), path)
    offered = []
    drop = incremental.ingest.drop_seen
    monkeypatch.setattr(incremental.ingest, "drop_seen", lambda maybe, seen, key: offered.append(maybe.count()) or drop(maybe, seen, key))
    incremental.append_unseen(rows(spark, range(10_000, 11_000)), path)
    incremental.append_unseen(rows(spark, [*range(490, 500), *range(20_000, 21_000)]), path)
    assert sum(offered) <= 40 and offered[-1] >= 10
    plan = history.maybe_seen(rows(spark, [1]), "url", history.Filters(spark, f"{path}/_seen").rows(), 1)._jdf.queryExecution().toString()
    assert "url" not in plan.split("FileScan")[-1] if "FileScan" in plan else True


# --- the stateful stream

def write(spark, folder, name, frame):
    frame.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")


def stream(spark, folder, out, checkpoint, prepare=lambda df: df):
    pages = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    query = incremental.stateful_stream(pages, prepare, out, checkpoint)
    query.awaitTermination()
    assert query.exception() is None


def streamed(spark, out):
    frames = [spark.read.parquet(p).select("url", "sha1") for p in glob.glob(f"{out}/batch=*") if glob.glob(f"{p}/corpus=*")]
    return sorted((r.url or "", r.sha1) for f in frames for r in f.collect())


@pytest.fixture
def folders(tmp_path):
    return str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), str(tmp_path / "batch")


def test_stream_equals_the_batch_job_over_late_files_and_restarts(spark, folders):
    source, out, checkpoint, batch = folders
    files = [rows(spark, [3, 1, 2, None], "c").union(rows(spark, [1, 2], "b")), rows(spark, [2, 4], "a"), rows(spark, [None], "c").union(rows(spark, [9]))]
    for k, frame in enumerate(files[:2]):
        write(spark, source, f"f{k}", frame)
        os.utime(glob.glob(f"{source}/f{k}/part*")[0], (1000 + k, 1000 + k))
    stream(spark, source, out, checkpoint)
    assert streamed(spark, out) == [("", "cNone"), ("u1", "b1"), ("u2", "b2"), ("u3", "c3"), ("u4", "a4")]
    write(spark, source, "late", files[2])
    stream(spark, source, out, checkpoint)  # a restart: state and files taken are remembered
    stream(spark, source, out, checkpoint)  # nothing new
    for frame in files:
        incremental.append_unseen(frame, batch)
    assert streamed(spark, out) == stored(spark, batch)


def test_a_replayed_batch_writes_the_same_rows_once(spark, folders):
    source, out, checkpoint, _ = folders
    write(spark, source, "f0", rows(spark, [1, 2]))
    stream(spark, source, out, checkpoint)
    write(spark, source, "f1", rows(spark, [2, 3]))
    stream(spark, source, out, checkpoint)
    before = streamed(spark, out)
    last = max(int(os.path.basename(p)) for p in glob.glob(f"{checkpoint}/commits/[0-9]*"))
    for p in (f"{checkpoint}/commits/{last}", f"{checkpoint}/commits/.{last}.crc"):
        if os.path.exists(p):
            os.remove(p)  # as if the run had died after its articles were written
    stream(spark, source, out, checkpoint)
    assert streamed(spark, out) == before == [("u1", "a1"), ("u2", "a2"), ("u3", "a3")]


def test_empty_stream(spark, folders):
    source, out, checkpoint, _ = folders
    write(spark, source, "f0", rows(spark, []))
    stream(spark, source, out, checkpoint)
    assert streamed(spark, out) == []


def test_clustered_articles_are_encoded_without_a_shuffle_of_them(spark):
    from credence.operators import encode
    from credence.plans import build
    from credence.sources import articles

    raw = spark.createDataFrame([(k, f"word{k % 7} token\tword{k % 3}") for k in range(200)], "doc_id long, text string")
    stored = articles.clustered_for_session(build.clean_articles(raw).withColumnRenamed("text", "text_a"), "doc_id", 4)
    vocab = spark.createDataFrame([("word1", 4), ("word2", 5)], "token string, id int")
    encoded = encode.encode_single(stored, F.broadcast(vocab), 8, id="doc_id")
    plan = encoded._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Bucketed: true" in plan
    plain = encode.encode_single(build.clean_articles(raw).withColumnRenamed("text", "text_a"), vocab, 8, id="doc_id")
    assert sorted(map(str, encoded.collect())) == sorted(map(str, plain.collect()))
