"""Packing against exhaustive search, and as a whole: every id once, no padding, few cuts."""

import itertools
import random
import zlib

import numpy as np
import pytest

from verdara.llm import packing

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, start long, length string"


def test_closest_equals_enumeration():
    rng = random.Random(2)
    for _ in range(300):
        counts = [0] + [rng.choice((0, 0, 1, 2, 3)) for _ in range(9)]
        room = rng.randint(0, 25)
        chosen = packing.closest(counts, room)
        assert all(0 < k <= counts[n] for n, k in chosen)
        best = max(s for ks in itertools.product(*(range(c + 1) for c in counts[1:])) if (s := sum(n * k for n, k in enumerate(ks, 1))) <= room)
        assert sum(n * k for n, k in chosen) == best


@pytest.mark.parametrize("lengths", [[1500] * 40, [1] * 5000, [2047, 1] * 9, [3], [64], [], [700, 700, 648] * 30 + [2040] * 5])
def test_pool_leaves_no_padding(lengths):
    pool = packing.Pool(2048)
    for i, n in enumerate(lengths):
        pool.put((i, 0, np.arange(n), n))
    made = list(pool.fill(0))
    sizes = [sum(len(p[2]) for p in s) for s in made]
    assert sum(sizes) == sum(lengths) and all(s == 2048 or s & (s - 1) == 0 for s in sizes)
    assert sum(s < 2048 for s in sizes) <= 11
    for i, n in enumerate(lengths):
        assert sorted(x for s in made for p in s if p[0] == i for x in p[2].tolist()) == list(range(n))
    if lengths == [700, 700, 648] * 30 + [2040] * 5:  # 30 windows are filled whole, without a cut
        assert sum(len(s) == 3 and sum(len(p[2]) for p in s) == 2048 for s in made) >= 29


def library(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def check(rows, made):
    by_doc, by_sequence = {}, {}
    for r in made:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, text in rows:
        ids = library(text) + [1]
        at = 0
        for r in sorted(by_doc.pop(i), key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    assert not by_doc
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at == 2048 or at & (at - 1) == 0 and at < 2048
    return by_sequence


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "POOL", 64)
    monkeypatch.setattr(packing, "KEPT", 8)
    rng = random.Random(1)
    words = ["alpha", "beta", "日本", "don't", "  ", "\n", "x²", "😀", "<|endoftext|>"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice((1, 20, 300, 900)))) for _ in range(200)]
    texts += ["word " * 30_000, None, "", " \n\t ", "a" * 20_000, "<|endoftext|><|endoftext|>a<|endoftext"]
    rows = list(enumerate(texts)) + [(None, "without id")]
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], SCHEMA).repartition(3)
    made = packing.pack(df, PATH).collect()
    sequences = check(rows, made)
    total = sum(r["length"] for r in made)
    assert len(sequences) <= total / 2048 + 3 * 12
    cuts = len(made) - len(rows) - sum(r["doc_tokens"] // 2048 for r in made if r["start"] == 0)
    assert cuts <= 0.5 * len(rows)  # the lengths take few values
    twice = packing.pack(df.unionByName(df), PATH).collect()
    assert sum(r["length"] for r in twice) == 2 * total
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0
