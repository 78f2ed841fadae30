"""The pipeline on a small table of its own, stage by stage, against what each stage must do."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

pytest.importorskip("public_tokenizers")
rng = random.Random(9)
WORDS = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(2000)]


def sentence(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    item = sentence(25)
    texts = [sentence(60) for _ in range(40)]
    rows = [(i, t, "en" if i % 2 else "de", "s", len(t)) for i, t in enumerate(texts)]
    rows += [(100, texts[3], "en", "s", 1), (101, texts[4].upper(), "de", None, 1), (102, sentence(30) + " " + item, "en", "s", 1), (103, None, None, "s", None), (104, "12345 !!", "en", "s", 1), (105, sentence(20) + " mail me at some.one@example.com now", "en", "s", 1), (5, texts[5], "en", "s", len(texts[5]))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert made.columns == docs.columns
            docs = corpus_pipeline.cut(made)
            seen.append(collections.Counter(r["doc_id"] for r in docs.collect()))
    everything = {*range(40), 100, 101, 102, 105}
    assert set(seen[0]) == everything and seen[0][5] == 2
    assert set(seen[1]) == everything - {100, 101} and seen[1][5] == 1
    assert set(seen[2]) == set(seen[3]) == everything - {100, 101, 102}
    text = docs.where("doc_id = 105").first()
    assert "some.one@example.com" not in text["text"] and text["n_chars"] == len(text["text"])
    out = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in out.collect()} == set(seen[3]) and out.where("n_tokens <= 0").count() == 0


def test_near_duplicates_of_five_words(spark):
    """Two substitutions in 100 words: 0.81 on five-word shingles, 0.848 on four; three of them: 0.73."""
    base = [f"w{k}" for k in range(100)]
    texts = [" ".join(f"odd{i}" if k in gone else w for k, w in enumerate(base)) for i, gone in enumerate([(), (30, 60), (20, 50, 80)])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [0, 2]


def test_empty_table(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0).withColumn("row", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("rest", F.lit(1))
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, folder))
    assert docs.count() == 0
