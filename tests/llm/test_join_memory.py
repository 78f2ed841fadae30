"""What the n-gram join sends to Python workers, and how many of them an executor core keeps."""

from verdara.llm import common, ngram_join


def test_filter_keeps_rows_out_of_python(spark):
    """Only places in the filter travel; both sides of the filter together are all rows, once."""
    rows = spark.range(3000).selectExpr("CASE WHEN id % 10 < 9 THEN id END AS key", "repeat('x', 20) AS text")
    members = rows.where("key % 7 = 0")
    inside, outside = common.only_members(rows, members, "key"), common.only_members(rows, members, "key", others=True)
    plan = inside._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan
    assert inside.where("key % 7 = 0").count() == members.count() and inside.count() < 600
    assert outside.where("key % 7 = 0").isEmpty() and inside.count() + outside.count() == 3000
    assert inside.columns == outside.columns == ["key", "text"]


def test_keys_are_made_and_packed_in_one_worker(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(ngram_join, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or common.cut(df))
    monkeypatch.setattr(ngram_join, "HELD_KEYS", 50, raising=False)  # several batches a slice
    docs = spark.createDataFrame([(i, " ".join(f"w{i // 2}x{k}" for k in range(40)) if i % 9 else None) for i in range(60)], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.components(docs).collect()}
    assert got == {i: i - i % 2 if i % 9 and (i - i % 2) % 9 else i for i in range(60)}
    assert plans[0].count("MapInArrow") == 2  # one before the shuffle, one after it


def test_a_worker_holds_the_keys_of_few_texts():
    """Keys of two million blocks, with several arrays beside each, used to be held at once; now half a million beyond those of a slice of texts."""
    import pyarrow as pa

    texts = [" ".join(str(i * 3000 + k) for k in range(3000)) for i in range(1200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1200), pa.int64()), pa.array(range(1200), pa.int64()), pa.array(texts)], ["doc_id", "key", "text"])
    made = [len(b.column("keys").flatten()) for b in ngram_join.described(5, 80)(iter([batch]))]
    assert sum(made) > 3_000_000 and max(made) <= 1_000_000
