"""Tables of the language model's shards, packed for the shuffle."""

import numpy as np
import pyarrow as pa

from verdara.llm.lm_score import Bits


def test_packed_counts_of_shards_add_up(spark):
    """Small and large counts of every shard; small ones take 4 bytes of the shuffle, where each took 10."""
    rng, shards, want, batches = np.random.default_rng(3), [], 0, []
    for k in range(3):
        bits = Bits(2, 2, 12)
        seen = np.where(rng.random(bits.counts.shape) < 0.3, rng.integers(1, 256, bits.counts.shape), 0)
        seen[:, :5] = (255, 256, 257, 70_000, 1 << 30)
        bits.counts[:] = seen * Bits.ONE + rng.integers(0, seen + 1)
        want = want + bits.counts
        batches.append(bits.blocks())
        shards.append((k, np.count_nonzero(seen)))
    table = pa.Table.from_batches(batches)
    sizes = [len(p) for b, p in zip(table["block"].to_pylist(), table["sums"].to_pylist(), strict=True) if b >= 0]
    assert sum(sizes) < 5 * sum(n for _, n in shards)
    df = spark.createDataFrame([(b, bytearray(p)) for b, p in zip(table["block"].to_pylist(), table["sums"].to_pylist(), strict=True)], "block int, sums binary")
    assert np.array_equal(Bits(2, 2, 12).added(df).counts, want)


def test_a_shard_without_counts(spark):
    empty = Bits(1, 1, 11).blocks()
    df = spark.createDataFrame([(-1, bytearray(empty.column(1)[0].as_py()))], "block int, sums binary")
    assert not Bits(1, 1, 11).added(df).counts.any()
