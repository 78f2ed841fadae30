"""Hard negatives against brute force: many small blocks, odd rows, hot vectors."""

import itertools
import math

import numpy as np

from verdara.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, score double, rank string"


def brute(rows, every=100, wanted=5):
    kept = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) or not math.isfinite(256 * x) for x in v):
            continue
        row = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v])
        kept[i] = min(kept.get(i, row), row)
    cap = lambda x: max(-hard_negatives.LARGEST, min(hard_negatives.LARGEST, x))
    for a, (label, v) in kept.items():
        if a % every:
            continue
        score = {i: cap(sum(x * y for x, y in zip(v, w))) for i, (_, w) in kept.items() if len(w) == len(v) and i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if kept[i][0] == label][:wanted]:
            fits = [i for i in order if kept[i][0] != label and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
            yield from ((a, p, k, n, score[p], score[n]) for k, n in enumerate(fits[:wanted], 1))


def made(spark, rows, **how):
    df = spark.createDataFrame([(i, v, label, 0.0, "x") for i, v, label in rows], SCHEMA)
    out = hard_negatives.mine(df, **how)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, out.collect()))


def test_blocks_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "PER_TASK", 1)
    monkeypatch.setattr(hard_negatives, "FANOUT", 4)
    monkeypatch.setattr(hard_negatives, "SLICE", 3)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16)) * 0.4
    rows = [(int(i), (centres[i % 12] + rng.standard_normal(16) * 0.1).tolist(), int(i * 7 % 10 % 4)) for i in range(900)]
    rows += [(1000 + i, centres[0].tolist(), i % 3) for i in range(250)]  # one frequent vector
    rows += [rows[5], rows[100], (100, rows[100][1][::-1], 9)]  # repeated rows, an id with two vectors
    rows += [(2000, None, 1), (2001, [], 1), (2100, [], 1), (2107, [], 2), (2002, [0.0] * 16, 1), (2003, [float("nan")] * 16, 1), (2004, [1.0, None], 1), (2005, [1e308] * 16, 1), (2006, rows[0][1], None), (None, rows[0][1], 0)]
    rows += [(2200, [1.0, 0.5], 3), (2201, [1.0, 0.5], 3), (2202, [1.0, 0.45], 4), (2300, [-1.0, 0.0], 4)]
    assert made(spark, rows, block=64) == sorted(brute(rows))


def test_scores_beyond_double_precision(spark):
    rows = [(i, [float(2**30 + i), float(2**29 - i * 3)], i % 2) for i in range(0, 40)] + [(100, [1e200, 1e200], 0), (101, [1e200, 0.0], 0), (102, [1e200, -1.0], 1)]
    assert made(spark, rows) == sorted(brute(rows))


def test_empty_and_without_anchor(spark):
    assert made(spark, []) == [] and made(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []


def test_hilbert_steps_touch_every_cell_once():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        order = cells[np.argsort(hard_negatives.hilbert(cells, bits))]
        assert len(set(hard_negatives.hilbert(cells, bits).tolist())) == len(cells)
        assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_zones_leave_blocks_unread(spark):
    """Bounds hold, and separated groups of vectors don't read each other."""
    rng = np.random.default_rng(4)
    a, x = np.floor(rng.standard_normal((30, 8)) * 50), np.floor(rng.standard_normal((200, 8)) * 50)
    least, most = hard_negatives.bounds(a, x.min(0), x.max(0))
    scores = a @ x.T
    assert (least <= scores.min(1)).all() and (most >= scores.max(1)).all()
    rows = [(i, (np.eye(8)[i % 8] + rng.random(8) * 0.01).tolist(), (i // 8) % 2) for i in range(1600)]
    df = spark.createDataFrame([(i, v, label, 0.0, "x") for i, v, label in rows], SCHEMA)
    blocks = hard_negatives.write_blocks(hard_negatives.usable(df, False), 100, 5, block=50)
    levels, last = hard_negatives.zones(blocks)
    groups = blocks.where("anchors > 0").selectExpr("block AS home", "dim", "a_low", "a_high", "a_label_low", "a_label_high", "floor", "double('inf') AS ceiling")
    asked = hard_negatives.descend(groups, levels, last, True).count()
    assert 0 < asked < groups.count() * blocks.count() / 3
