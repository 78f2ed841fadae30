"""Tokenizer alignment against a plain loop over tokens; the perfect hash; odd texts."""

import collections
import hashlib
import random

import numpy as np
import pytest

from verdara.llm import align

P = pytest.importorskip("public_tokenizers")
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_a long, row string, pair long"


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_model.encode_special_tokens = True
    a_bytes, b_bytes = align.encoder(A, False).bytes_of, align.pieces(B).bytes_of
    docs = []
    for i, text in rows:
        a, b = (a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes[x] for x in a) != whole or b"".join(b_bytes[x] for x in b) != whole:
            docs.append((i, [], [], []))
            continue
        ends = lambda ids, of: np.cumsum([len(of[x]) for x in ids]).tolist()
        a_end, b_end = ends(a, a_bytes), ends(b, b_bytes)
        groups, x, y = [], 0, 0
        for bound in sorted(set(a_end) & set(b_end)):
            p, q = a_end.index(bound, x) + 1, b_end.index(bound, y) + 1
            groups.append((a[x:p], b[y:q]))
            x, y = p, q
        docs.append((i, a, b, groups))
    count = collections.Counter(pair for _, _, _, groups in docs for pair in {(x, y) for a, b in groups for x in a for y in b})
    best = collections.Counter()
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    for i, a, b, groups in docs:
        links = [(x, y) for g, h in groups for x in g for y in h]
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        yield (i, len(a), len(b), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if a else "")


def sample():
    rng = random.Random(7)
    words = ["alpha", "unbelievable", "日本語", "naïve", "don't", "  ", "\n", "\t", "½", "😀", "<|endoftext|>", "<s>", "<0x41>", "internationalisation", "ﬁ", "x²", "▁", "\x00", "2024-05-06"]
    texts = [" ".join(rng.choice(words[: rng.choice((10, len(words)))]) for _ in range(rng.choice((1, 5, 60)))) for _ in range(120)]
    texts += [None, "", " ", "\n", "a", "ab" * 3000, "word " * 20_000, "▁", "same text", "same text", " leading", "é" * 700]
    return list(enumerate(texts)) + [(None, "without id"), (0, texts[0])]


@pytest.mark.parametrize("run", [1 << 20, 12])
def test_alignment(spark, monkeypatch, run):
    """With many small slices, short vectors and, the second time, only large groups."""
    monkeypatch.setattr(align, "SLICE", 150)
    monkeypatch.setattr(align, "PIECE", 64)
    monkeypatch.setattr(align, "ARITY", 2)
    monkeypatch.setattr(align, "GATHERED", 100)
    monkeypatch.setattr(align, "RUN", run)
    rows = sample()[:60] + sample()[-14:] if run > 12 else sample()[:25]
    df = spark.createDataFrame([(i, t, 5, "x", 1) for i, t in rows], SCHEMA).repartition(3)
    made = align.align(df, A, B)
    assert made.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, made.collect()), key=str) == sorted(brute(rows), key=str)


def test_alignment_in_one_slice(spark):
    rows = sample()
    df = spark.createDataFrame([(i, t, 5, "x", 1) for i, t in rows], SCHEMA)
    assert sorted(map(tuple, align.align(df, A, B).collect()), key=str) == sorted(brute(rows), key=str)
    assert align.align(spark.createDataFrame([], SCHEMA), A, B).count() == 0
    nothing = spark.createDataFrame([(1, None, 5, "x", 1)], SCHEMA)
    assert [tuple(r) for r in align.align(nothing, A, B).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_links_of_documents_with_several_runs(monkeypatch):
    """A document over several runs of links counts a pair once."""
    rng = np.random.default_rng(2)
    a, b = ([rng.integers(0, 40, n).astype(np.uint32) for n in (30, 0, 500)] for _ in range(2))
    size = np.ones(40, np.int64)
    b = [x[: len(y)] for x, y in zip(b, a, strict=True)]
    one = align.Aligned(a, b, size, size)
    whole = [np.concatenate(x) for x in zip(*one.links(8), strict=True)]
    monkeypatch.setattr(align, "RUN", 7)
    parts = [np.concatenate(x) for x in zip(*one.links(8), strict=True)]
    assert all((x == y).all() for x, y in zip(whole, parts, strict=True)) and one.n_links.tolist() == [30, 0, 500]


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 1000, 200_000])
def test_hash_is_minimal_and_perfect(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 40, n))
    made = align.Counts(keys)
    assert sorted(made.hash(keys).tolist()) == list(range(len(keys)))
    made.counts = np.arange(1, len(keys) + 1)
    other = np.setdiff1d(np.arange(2000), keys)
    if n:
        assert (made.of(keys) > 0).all() and (made.of(other) == 0).all()
