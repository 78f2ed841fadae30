from pyspark.sql import functions as F

from verdara.sources import records


def test_jsonl_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a1", "ACCEPTED", 0.1, None), ("a2", "ABSTAINED", 0.9, "high")], records.SCHEMAS["decision"])
    records.write_jsonl(rows, str(tmp_path / "d"))
    assert sorted(records.read_jsonl(spark, str(tmp_path / "d"), "decision").collect()) == sorted(rows.collect())


def test_bad_lines_are_left_out(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"risk": 0.2, "label": 1}\nnot json\n{"unknown": 1}\n')
    made = records.calibration(spark, str(tmp_path / "c.jsonl")).collect()
    assert sorted((r["risk"], r["label"], r["date"]) for r in made) == [(0.2, 1, "2000-01-01"), (0.5, 0, "2000-01-01")]


def test_scan(spark, tmp_path):
    (tmp_path / "sebi" / "circulars").mkdir(parents=True)
    (tmp_path / "sebi" / "circulars" / "KYC_norms_2021.pdf").write_bytes(b"x")
    (tmp_path / "skip.txt").write_bytes(b"x")
    files = records.scan_documents(spark, str(tmp_path))
    row = files.first()
    assert files.count() == 1 and (row["issuer"], row["category"], row["year"], row["doc_id"]) == ("SEBI", "circular", 2021, "SEBI_KYC_norms_2021")
    index = spark.createDataFrame([("d/KYC_norms_2021.pdf", "u0", 1), ("e/KYC_norms_2021.pdf", "u1", 3), ("d/KYC_norms_2021.pdf", "u2", 2)], "file string, url string, n int")
    assert records.with_index(files, index, "n").select(F.col("index.url")).first()[0] == "u1"


def test_upsert(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "k int, v string")
    assert sorted(map(tuple, records.upsert(old, new, "k", "v").collect())) == [(1, "a"), (2, "c"), (3, "e")]


def test_bad_lines_are_counted(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"risk": 0.2, "label": 1}\nnot json\n{"unknown": 1}\n')
    assert tuple(records.bad_lines(spark, str(tmp_path / "c.jsonl"), "calibration").first()) == (3, 1)


def test_nothing_saved_is_an_empty_table(spark, tmp_path):
    assert records.load_table(spark, str(tmp_path / "none"), "thresholds").count() == 0
