"""Articles written as files of their own."""

from pyspark.sql import functions as F

from credence.sources import scans


def test_articles_are_plain_files(spark, tmp_path):
    """No folder, checksum or attempt of its own for an article; what no file can be called is kept too."""
    root = tmp_path / "raw"
    given = [("pos", "ab_7", b"one"), ("neg", "cd_1", b"\xff\xfeb"), ("neg", "e_2", None), ("neg", "e_2", None),
             ("pos", None, b"no name"), ("neg", "_xy", b"odd"), ("pos", "em_3", b""), ("other", "z_1", b"elsewhere")]
    files = spark.createDataFrame(given, "folder string, name string, value binary")
    scans.write_files(files.withColumn("value", F.col("value").cast("string")), str(root))
    assert sorted(p.name for p in (root / "pos").iterdir()) == ["ab_7", "em_3"]
    assert sorted(p.name for p in (root / "neg").iterdir()) == ["cd_1", "e_2"]
    assert (root / "neg" / "cd_1").read_bytes() == b"\xff\xfeb\n"
    found = scans.scan_files(spark, str(root)).select("folder", "name", F.col("value").cast("binary")).collect()
    assert sorted((r[0], r[1], bytes(r[2])) for r in found) == [
        ("neg", "_xy", b"odd\n"), ("neg", "cd_1", b"\xff\xfeb\n"), ("neg", "e_2", b"\n"),
        ("pos", "__HIVE_DEFAULT_PARTITION__", b"no name\n"), ("pos", "ab_7", b"one\n"), ("pos", "em_3", b"\n"),
    ]
