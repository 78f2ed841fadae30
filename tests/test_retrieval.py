"""BM25 over the stored block index against a plain loop; reuse of the index."""

import collections
import math
import random

import pyarrow as pa
import pytest

from verdara.operators import retrieval as R


def brute(docs, queries, k, overlap=False):
    docs = [(i, (t or "").lower().split()) for i, t in docs if i is not None]
    n, avgdl = len(docs), max(sum(len(t) for _, t in docs) / max(len(docs), 1), 1e-12)
    df = collections.Counter(w for _, t in docs for w in set(t))
    raw = {w: math.log((n - c + 0.5) / (c + 0.5)) for w, c in df.items()}
    idf = {w: 0.25 * sum(raw.values()) / len(raw) if r < 0 else r for w, r in raw.items()}
    for q, text in queries:
        asked = collections.Counter(w for w in (text or "").lower().split() if w in df)
        scores = []
        for i, t in docs:
            tf = collections.Counter(t)
            shared = [w for w in asked if tf[w]]
            if shared:
                score = len(shared) if overlap else sum(asked[w] * idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / avgdl)) for w in shared)
                scores.append((-round(score, 6), i))
        yield from ((q, i, -s, rank) for rank, (s, i) in enumerate(sorted(scores)[:k], 1))


def close(made, want):
    made, want = sorted(made, key=lambda r: (str(r[0]), r[3])), sorted(want, key=lambda r: (str(r[0]), r[3]))
    assert [(q, i, r) for q, i, _, r in made] == [(q, i, r) for q, i, _, r in want]
    assert [s for _, _, s, _ in made] == pytest.approx([s for _, _, s, _ in want], abs=2e-6)


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("overlap", [False, True])
def test_search_equals_a_plain_loop(spark, tmp_path, monkeypatch, kind, overlap):
    monkeypatch.setattr(R, "BLOCK_DOCS", 5)
    monkeypatch.setattr(R, "SEARCH_BLOCK", 3)
    rng = random.Random(4)
    words = [f"w{i}x" for i in range(60)]
    text = lambda n: " ".join(rng.choice(words[: rng.choice((5, 60))]) for _ in range(n))
    name = (lambda i: i) if kind == "long" else (lambda i: f"d{i:03}")
    docs = [(name(i), text(rng.choice((3, 10, 40)))) for i in range(90)] + [(name(90), None), (name(91), ""), (None, "w1x w2x"), (name(92), "w0x " * 3000)]
    docs += [(name(93 + i), docs[7][1]) for i in range(4)]  # ties
    queries = [(i, text(rng.choice((1, 4, 12)))) for i in range(8)] + [(20, None), (21, "unknown words"), (22, "w3x w3x w3x")]
    df = spark.createDataFrame([(*d, 0.5) for d in docs], f"doc {kind}, text string, score double")
    R.write_index(df, "doc", str(tmp_path / "i"))
    made = R.search(spark, str(tmp_path / "i"), spark.createDataFrame(queries, "id long, text string"), "id", 6, overlap)
    assert made.columns == ["query", "doc", "score", "rank"]
    close([tuple(r) for r in made.collect()], list(brute(docs, queries, 6, overlap)))


def test_common_terms_only(spark, tmp_path):
    """Every term in every document: weights of the floor, some of them not positive."""
    docs = [(i, "aa bb " + "aa " * i) for i in range(6)]
    R.write_index(spark.createDataFrame(docs, "doc int, text string"), "doc", str(tmp_path / "i"))
    made = R.search(spark, str(tmp_path / "i"), spark.createDataFrame([(1, "aa"), (2, "bb aa")], "id long, text string"), "id", 4)
    close([tuple(r) for r in made.collect()], list(brute(docs, [(1, "aa"), (2, "bb aa")], 4)))


def test_empty_tables(spark, tmp_path):
    R.write_index(spark.createDataFrame([], "doc long, text string"), "doc", str(tmp_path / "i"))
    some, none = spark.createDataFrame([(1, "aa")], "id long, text string"), spark.createDataFrame([], "id long, text string")
    assert R.search(spark, str(tmp_path / "i"), some, "id", 3).count() == 0 == R.search(spark, str(tmp_path / "i"), none, "id", 3).count()


def test_index_is_reused_until_a_file_changes(spark, tmp_path):
    rows = spark.createDataFrame([(1, "aa bb"), (2, "cc dd")], "doc long, text string")
    rows.write.parquet(str(tmp_path / "t"))
    first = R.index_of(spark.read.parquet(str(tmp_path / "t")), "doc")
    assert R.index_of(spark.read.parquet(str(tmp_path / "t")), "doc") == first
    rows.write.mode("append").parquet(str(tmp_path / "t"))
    second = R.index_of(spark.read.parquet(str(tmp_path / "t")), "doc")
    assert second != first and spark.read.parquet(f"{second}/sizes").first()["n"] == 4


def test_stored_blocks_are_read_in_small_groups(spark, tmp_path, monkeypatch):
    """A reader holds a row group at once, so its blocks are few, and long documents make smaller blocks."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(R, "BLOCK_DOCS", 4)
    docs = [(i, f"t{i}x common") for i in range(400)] + [(400 + i, "long " * 90_000) for i in range(8)]
    R.write_index(spark.createDataFrame(docs, "doc long, text string"), "doc", str(tmp_path / "i"))
    files = [pq.ParquetFile(f) for f in (tmp_path / "i" / "blocks").glob("*.parquet")]
    assert max(f.metadata.row_group(g).num_rows for f in files for g in range(f.num_row_groups)) <= R.GROUP_BLOCKS
    sizes = [sum(s) for f in files for s in f.read(["sizes"])["sizes"].to_pylist()]
    assert sum(sizes) == 400 * 2 + 8 * 90_000 and max(sizes) <= R.BLOCK_TOKENS


def test_a_block_is_sent_compressed(spark, tmp_path):
    """Spark sends many blocks to Python in one batch; as arrays of numbers each took several times its stored size."""
    docs = [(i, " ".join(f"w{(i * 7 + j * j) % 900}x" for j in range(200))) for i in range(600)]
    R.write_index(spark.createDataFrame(docs, "doc long, text string").coalesce(1), "doc", str(tmp_path / "i"))
    rows = spark.read.parquet(str(tmp_path / "i" / "blocks")).collect()
    plain = sum(4 * sum(len(c) for c in R._unpacked(pa.scalar(bytes(r["postings"]), pa.binary()))) for r in rows)
    assert sum(len(r["docs"]) for r in rows) == 600 and 2 * sum(len(r["postings"]) for r in rows) < plain


def test_dense_search_by_tiles_equals_a_loop(spark, monkeypatch):
    """Ties, NaN and zero vectors, equal ids; the scores of a task stay small."""
    import numpy as np

    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(700, 4)), 1)
    x[10], x[20] = 0, np.nan
    x[300:420] = x[7]
    ids = [*range(699), 5]
    rows = [(int(i), [float(c) for c in v]) for i, v in zip(ids, x, strict=True)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    monkeypatch.setattr(R, "TILE_QUERIES", 3)
    monkeypatch.setattr(R, "TILE_VECTORS", 50)
    made = collections.defaultdict(list)
    for q, d, s, _ in R.dense_top_k(vectors, vectors.where("vec_id % 50 = 7 or vec_id = 20"), 9).orderBy("query", "rank").collect():
        made[q].append((d, s))
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    assert sorted(made) == list(range(7, 699, 50))
    for q, got in made.items():
        score = np.round(unit @ unit[q], 6)
        want = sorted((-s, i) for i, s in zip(ids, score, strict=True) if i != q and np.isfinite(s))[:9]
        assert [d for d, _ in got] == [i for _, i in want] and [s for _, s in got] == pytest.approx([-s for s, _ in want], abs=2e-6)


def test_dense_search_holds_no_score_of_all_pairs():
    """A batch of 10,000 vectors against 4,096 queries took 328 MB for the scores alone, and several times that to sort them."""
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(6)
    best, best_id = np.full((R.TILE_QUERIES, 10), -np.inf), np.zeros((R.TILE_QUERIES, 10), np.int64)
    tracemalloc.start()
    for _ in range(3):
        R._keep_best(best, best_id, rng.random((R.TILE_QUERIES, R.TILE_VECTORS)), np.arange(R.TILE_VECTORS))
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()


def test_terms_are_counted_before_the_shuffle(spark):
    """One row a term and task, not one a document and term, goes through the shuffle; texts are read once."""
    docs = [(i, "aa bb.. aa " + "cc " * (i % 3)) for i in range(300)] + [(1, "aa"), (None, "aa dd"), (900, None), (901, "")]
    df = spark.createDataFrame(docs, "doc int, text string").repartition(2)
    made = R.term_counts(df)
    assert {tuple(r) for r in made.collect()} == {("aa", 302, 602), ("bb", 300, 300), ("cc", 200, 300), ("dd", 1, 1)}
    assert "Generate" not in made._jdf.queryExecution().executedPlan().toString()
