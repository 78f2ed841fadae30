"""The language model's inner loops against plain formulas."""

import numpy as np

from verdara.llm.lm_score import CONTEXTS, ORDERS, SLOT_BITS, WORD_BITS, Bits, Code, Mixer, byte_bits, node_bits, spell, squash


def test_map_counted_in_batches_of_steps(spark):
    """Twenty steps: the map's sums are asked for once, and equal those of every step by itself."""
    g, mixer = np.random.default_rng(5), Mixer(3, 8)
    read, ones, seen = np.zeros(8), np.zeros(8 * Mixer.STEPS), np.zeros(8 * Mixer.STEPS)
    for _ in range(20):
        x, gate, bit = g.normal(0, 3, (3, 200)).astype(np.float32), g.integers(0, 8, 200), g.integers(0, 2, 200).astype(np.int8)
        low, part = mixer.place(mixer.mix(x, gate), gate)
        for at, share in ((low, 1 - part), (low + 1, part)):
            np.add.at(seen, at, share), np.add.at(ones, at, share * bit)
        np.add.at(read, gate, 1)
        mixer.train(x, gate, bit)
    assert len(mixer.placed) == 4
    made = Mixer(3, 8)
    made.take(mixer.sums())
    assert not mixer.placed and np.array_equal(made.read, read)
    assert np.allclose(made.seen, seen, atol=1e-2) and np.allclose(made.ones, ones, atol=1e-2)


def test_contexts_hashed_once_a_line(spark):
    g = np.random.default_rng(6)
    code = Code(g.integers(1, 4000, 900))
    leaf, contexts = g.integers(0, 900, 500), g.integers(0, 1 << 32, (CONTEXTS, 500)).astype(np.uint32)
    slots, prior, logit, gate, bit, begin = node_bits(code, leaf, contexts)
    assert slots.shape == (CONTEXTS, code.length[leaf].sum()) and slots.max() < 1 << WORD_BITS
    assert len(code.line) < 0.5 * len(code.bit)  # lines, not bits
    assert np.allclose(squash(logit), prior, atol=1e-5) and not (gate % 4).any()
    for t in range(500):
        n = code.length[leaf[t]]
        lines = slots[:, begin[t] : begin[t] + n] >> 3
        for d in range(n):
            name = code.line[code.first_line[leaf[t]] + d // 3]
            h = (contexts[:, t] ^ name) * np.uint32(0xC2B2AE35)
            h = (h ^ h >> np.uint32(15)) * np.uint32(0x27D4EB2F)
            assert np.array_equal(lines[:, d], h >> np.uint32(35 - WORD_BITS))


def test_a_prior_of_a_half_is_left_out(spark):
    data, contexts, _ = spell([b"abc", b"abd", b"xyz"])
    slots, prior, logit, gate, bit = byte_bits(data, contexts)
    model, plain = Bits(len(ORDERS), 8, SLOT_BITS), Bits(len(ORDERS), 8, SLOT_BITS)
    half = np.full(len(bit), 0.5, np.float32)
    for _ in range(3):
        model.learn(slots, prior, logit, gate, bit)
        plain.learn(slots, half, half * 0, gate, bit)
    assert model.inputs(slots, prior, logit)[0].shape == (len(ORDERS), len(bit))
    assert np.array_equal(model.counts, plain.counts) and np.allclose(model.mixer.weights, plain.mixer.weights, atol=1e-6)
