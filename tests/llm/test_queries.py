"""All registered queries run over the smallest tables; those with SQL match it."""

import pytest

import __spark_entry__ as entry
from credence.llm.oracles import ORACLES
from credence.llm.queries import QUERIES
from tests import compare

SF = "/root/testdata/sf0.001"
COLUMNS = {
    1: "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    2: "doc_id size text_crc32 law shard slot grown_shard", 3: "doc_id held_out lang_pred score",
    4: "page_id host path rule verdict", 5: "doc_id size source_size target taken",
    6: "page_id payload_bytes payload_digest record_type refers_to", 7: "doc_id n_bytes n_tokens over_limit",
    11: "vec_id cluster distance cluster_inertia inertia centroid_sha256", 12: "lang rank phrase a l r n score",
    13: "doc_id keep_id group_size kept text_sha256", 8: "doc_id quality keep", 9: "doc_id n_shingles component_id", 10: "doc_id item_id begin end edits",
}


def test_all_are_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", QUERIES)
def test_columns_and_rows(spark, name):
    number = int(name[2:].split("_")[0])
    out = QUERIES[name](spark, SF)
    assert set(COLUMNS[number].split()) <= set(out.columns)
    table = "pages" if number in (4, 6) else "embeddings" if number == 11 else "documents"
    whole = spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert out.count() == whole or number in (10, 12)


@pytest.mark.parametrize("name", ORACLES)
def test_matches_sql(spark, name):
    assert compare.difference(QUERIES[name](spark, SF), compare.connect(SF), ORACLES[name]) is None
