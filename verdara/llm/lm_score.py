"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is its sequence of lower-cased words and one end. Each word is coded in bits. Frequent words,
the end and an escape have a Huffman code; a bit is predicted from the counts of its code prefix
alone and within hashed contexts: the last short word, the last word, the last two words. Other words
are escaped. After an escape every word with a count is predicted from its own count, less a discount
estimated from the words seen once and twice; what the discount frees is for the spelling, byte by
byte, each bit predicted from hashed contexts of one to six bytes.
At both levels the predictions are combined in the logistic domain by weights that a gate selects
(the bit's place and how much the longest context has seen), and an adaptive map refines the result.

Learning is online, in reading order, over every training text in shards: a small batch of bits is
predicted from what the shard has read so far, then moves weights and map, then is counted. The
shards' counts are added up, their maps too, and their weights averaged by what each has read.

All counts come from every training document: word counts by shuffle, context counts and spelling
counts as tables of fixed size that shards add up block by block. The frequent words are at most
``FREQUENT`` and are broadcast; all other words are joined with their counts and spelling scores.

Defined cases: a null text counts as empty, which is one end; without training documents every
count is zero and the scores follow from the formulas; rows with a null id are scored and not
learned from; repeated rows are scored each, and learned from each; very long texts are read in
pieces of bounded size; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdara.llm.common import bucket_of, chunks, cut, lower_words_of, release

#: Words with a code of their own, and short words with a context of their own.
FREQUENT, SHORTS = (1 << 17) - 2, 32
END, ESCAPE = 0, 1
#: Contexts of a word; slots of each context's table, of words and of spelling.
CONTEXTS, WORD_BITS = 3, 20
ORDERS, SLOT_BITS = (1, 2, 3, 4, 6), 19
#: Depths in the code with weights of their own.
DEPTHS = 24
CELL = 2048
#: Tokens, or words to spell, that are predicted before they are learned from; and those scored at once.
STEP, SPELL_STEP, AT_ONCE = 1024, 400, 2048


def squash(x: np.ndarray) -> np.ndarray:
    out = np.clip(x, x.dtype.type(-20), x.dtype.type(20))
    np.negative(out, out=out)
    np.exp(out, out=out)
    out += 1
    return np.reciprocal(out, out=out)


class Mixer:
    """Gated logistic mixing followed by an adaptive probability map; inputs are rows, gates columns."""

    STEPS, SCALE, TRUST = 33, 1 << 20, 30.0

    def __init__(self, inputs: int, gates: int) -> None:
        self.weights = np.full((inputs, gates), 1.0 / inputs, np.float32)
        self.moved = np.full((inputs, gates), 1.0)
        self.read = np.zeros(gates)
        self.ones = np.zeros(gates * self.STEPS)
        self.seen = np.zeros(gates * self.STEPS)
        self.placed: list[tuple[np.ndarray, np.ndarray]] = []
        self.take(self.sums())

    def mix(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Weighted sums of the inputs; fewer rows than weights are the last inputs, the others being zero."""
        skip, part = len(self.weights) - len(x), np.empty(len(gate), np.float32)
        mixed = self.weights[skip].take(gate)
        mixed *= x[0]
        for k in range(1, len(x)):
            self.weights[skip + k].take(gate, out=part, mode="clip")
            part *= x[k]
            mixed += part
        return mixed

    def place(self, mixed: np.ndarray, gate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.clip(mixed, np.float32(-7.99), np.float32(7.99))
        at += np.float32(8)
        at *= np.float32((self.STEPS - 1) / 16)
        low = at.astype(np.int32)
        at -= low
        return gate * self.STEPS + low, at

    def train(self, x: np.ndarray, gate: np.ndarray, bit: np.ndarray, rate: float = 0.05) -> None:
        """Learn from one batch; steps shrink as a gate has moved."""
        gates, skip = len(self.read), len(self.weights) - len(x)
        mixed = self.mix(x, gate)
        error = bit - squash(mixed)
        step = np.stack([np.bincount(gate, error * row, gates) for row in x])
        self.moved[skip:] += step * step
        self.weights[skip:] += (rate * step / np.sqrt(self.moved[skip:])).astype(np.float32)
        low, part = self.place(mixed, gate)
        low += low
        low += bit
        self.placed.append((low, part))
        if len(self.placed) > 15:
            self.count()

    def count(self) -> None:
        """Add the places of the bits learned from to the map, which nothing asks for before ``sums``."""
        if not self.placed:
            return
        gates = len(self.read)
        low, part = map(np.concatenate, zip(*self.placed, strict=True))
        self.placed.clear()
        # Each bit counts at two neighbours, 1 - part and part: one count and one sum by place and bit give all four.
        number = np.bincount(low, minlength=2 * len(self.seen)).astype(float)
        upper = np.bincount(low, part, 2 * len(self.seen))
        lower = number - upper
        self.read += number.reshape(gates, -1).sum(1)
        seen = lower.reshape(-1, 2)
        seen[1:] += upper.reshape(-1, 2)[:-1]  # the last place is never a lower one
        self.seen += seen.sum(1)
        self.ones += seen[:, 1]

    def predict(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Probability of a one: the mixed and the refined prediction in equal parts."""
        mixed = self.mix(x, gate)
        low, part = self.place(mixed, gate)
        p = self.rise.take(low)
        p *= part
        p += self.refined.take(low)
        p += squash(mixed)
        p *= np.float32(0.5)
        return np.clip(p, np.float32(1e-6), np.float32(1 - 1e-6), out=p)

    def sums(self) -> np.ndarray:
        """Whole numbers that shards add up in any order."""
        self.count()
        parts = (self.weights * self.read, self.read, self.ones, self.seen)
        return np.rint(np.concatenate([x.ravel() for x in parts]) * self.SCALE).astype(np.int64)

    def take(self, sums: np.ndarray) -> None:
        """Become the average of the shards whose sums these are."""
        inputs, gates = self.weights.shape
        weights, self.read, self.ones, self.seen = np.split(sums / self.SCALE, np.cumsum([gates * inputs, gates, gates * self.STEPS]))
        known = self.read > 0
        self.weights[:, known] = weights.reshape(inputs, gates)[:, known] / self.read[known]
        start = np.tile(squash(np.linspace(-8, 8, self.STEPS)), gates)
        self.refined = ((self.ones + self.TRUST * start) / (self.seen + self.TRUST)).astype(np.float32)
        self.rise = np.diff(self.refined, append=np.float32(0))


def confidence(n: np.ndarray) -> np.ndarray:
    """0 to 3: nothing, little, some or much seen."""
    return CONFIDENCE.take(np.minimum(n, 61))


CONFIDENCE = np.repeat(np.arange(4), (1, 3, 57, 1))


class Bits:
    """Counts of bits in hashed contexts, with the mixer of their predictions and the prior's."""

    ONE = 1 << 32

    def __init__(self, contexts: int, gates: int, slot_bits: int) -> None:
        self.counts = np.zeros((contexts, 1 << slot_bits), np.int64)  # bits seen times ONE, and ones
        self.mixer = Mixer(contexts + 1, gates * 4)

    def inputs(self, slots: np.ndarray, prior: np.ndarray | None, logit: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Predictions, and how much the last context has seen; without a prior it is a half, whose prediction is zero and left out."""
        first = 0 if prior is None else 1
        x = np.empty((len(slots) + first, slots.shape[1]), np.float32)
        if first:
            x[0] = logit
            one = np.float32(0.4) * prior
            zero = np.float32(0.4) - one
        else:
            one = zero = np.float32(0.2)
        for k, at in enumerate(slots):
            both = self.counts[k].take(at)
            pair = both.view(np.uint32).astype(np.float32)  # low half: ones, high half: seen
            ones, rest = pair[::2], pair[1::2] - pair[::2]
            rest += zero
            np.add(ones, one, out=x[k + first])
            x[k + first] /= rest
        np.log(x[first:], out=x[first:])
        return x, confidence(both >> 32)

    def learn(self, slots: np.ndarray, prior: np.ndarray | None, logit: np.ndarray | None, gate: np.ndarray, bit: np.ndarray) -> None:
        x, much = self.inputs(slots, prior, logit)
        much += gate
        self.mixer.train(x, much, bit)
        step = bit + np.int64(self.ONE)
        for k, at in enumerate(slots):
            np.add.at(self.counts[k], at, step)

    def log(self, slots: np.ndarray, prior: np.ndarray | None, logit: np.ndarray | None, gate: np.ndarray, bit: np.ndarray) -> np.ndarray:
        x, much = self.inputs(slots, prior, logit)
        much += gate
        p = self.mixer.predict(x, much)
        np.subtract(1, p, out=p, where=bit == 0)
        return np.log(p, out=p)

    def blocks(self) -> pa.RecordBatch:
        """Non-empty blocks of the counts, sparse, and the mixer's sums as block -1, to be added up by ``added``."""
        cells = self.counts.reshape(-1, CELL)
        used = np.flatnonzero(cells.any(1))
        payload = [self.mixer.sums().tobytes()]
        for i in used:
            at = np.flatnonzero(cells[i])
            both, at = cells[i, at], at.astype(np.uint16)
            few = both < 256 * self.ONE  # most cells: 4 bytes instead of 10
            parts = (np.int32(few.sum()), at[few], (both[few] >> 32).astype(np.uint8), both[few].astype(np.uint8), at[~few], both[~few])
            payload.append(b"".join(x.tobytes() for x in parts))
        return pa.RecordBatch.from_arrays([pa.array([-1, *used.tolist()], pa.int32()), pa.array(payload, pa.binary())], ["block", "sums"])

    def added(self, shards: DataFrame) -> Bits:
        """Take the sums over shards; a fixed number of bytes comes to the driver, whatever the input."""

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for block, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if block < 0:
                        sums[block] = sums.get(block, 0) + np.frombuffer(payload, np.int64)
                        continue
                    n = int(np.frombuffer(payload, np.int32, 1)[0])
                    more = (len(payload) - 4 - 4 * n) // 10
                    cells = sums.setdefault(block, np.zeros(CELL, np.int64))
                    seen, ones = np.frombuffer(payload, np.uint8, 2 * n, 4 + 2 * n).astype(np.int64).reshape(2, n)
                    cells[np.frombuffer(payload, np.uint16, n, 4)] += (seen << 32) + ones
                    cells[np.frombuffer(payload, np.uint16, more, 4 + 4 * n)] += np.frombuffer(payload[4 + 4 * n + 2 * more :], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["block", "sums"])

        cells = self.counts.reshape(-1, CELL)
        for row in shards.repartition("block").mapInArrow(add, "block int, sums binary").collect():
            if row["block"] < 0:
                self.mixer.take(np.frombuffer(row["sums"], np.int64))
            else:
                cells[row["block"]] = np.frombuffer(row["sums"], np.int64)
        return self


class Code:
    """Huffman code of the leaves: for each, the nodes from the root and the bit taken at each."""

    def __init__(self, weights: np.ndarray) -> None:
        leaves = len(weights)
        heap = [(float(w), i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        parent, side = np.zeros(2 * leaves - 1, np.int64), np.zeros(2 * leaves - 1, np.int8)
        total = np.zeros(2 * leaves - 1)
        total[:leaves] = weights
        ones = np.zeros(2 * leaves - 1)
        for new in range(leaves, 2 * leaves - 1):
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            parent[i] = parent[j] = new
            side[j] = 1
            total[new], ones[new] = a + b, b
            heapq.heappush(heap, (a + b, new))
        root, at = 2 * leaves - 2, np.arange(leaves)
        whose, nodes, bits, depth = [], [], [], []
        climbing, climbed = np.arange(leaves), 0
        while len(climbing):  # every leaf one step nearer to the root
            up = parent[at]
            whose.append(climbing), nodes.append(up), bits.append(side[at]), depth.append(np.full(len(at), climbed))
            more = up != root
            climbing, at, climbed = climbing[more], up[more], climbed + 1
        whose, depth = np.concatenate(whose), np.concatenate(depth)
        order = np.lexsort((-depth, whose))
        node, self.bit = np.concatenate(nodes)[order], np.concatenate(bits)[order]
        self.length = np.bincount(whose, minlength=leaves)
        self.first = np.cumsum(self.length) - self.length
        depth = np.arange(len(node)) - np.repeat(self.first, self.length)
        self.gate = np.minimum(depth, DEPTHS - 1) * 4  # four gates each, by what was seen
        # Three bits in a row share a line of the table: named by its first node, then by the bits since.
        since, line = depth % 3, np.arange(len(node)) - depth % 3
        one, two = self.bit[line], self.bit[np.minimum(line + 1, len(node) - 1)]
        self.place = np.select([since == 0, since == 1], [1, 2 + one], 4 + 2 * one + two).astype(np.uint8)
        self.line = node[since == 0].astype(np.uint32) * np.uint32(0x85EBCA6B)
        self.width = np.diff(np.flatnonzero(since == 0), append=len(node))
        self.lines = (self.length + 2) // 3
        self.first_line = np.cumsum(self.lines) - self.lines
        share = lambda own: np.clip((ones[node] - own * self.bit + 0.2) / (total[node] - own + 0.4), 1e-6, 1 - 1e-6).astype(np.float32)
        self.prior, self.prior_without = share(0), share(1)
        self.logit, self.logit_without = (np.log(p / (1 - p)) for p in (self.prior, self.prior_without))


def node_bits(code: Code, leaf: np.ndarray, contexts: np.ndarray, learning: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slots, prior, its logit, gate and value of every bit of the tokens, and each token's first bit; in learning the prior leaves out the bit's own count."""
    sizes, lines = code.length.take(leaf), code.lines.take(leaf)
    ends, line_ends = np.cumsum(sizes), np.cumsum(lines)
    begin = ends - sizes
    at = np.arange(ends[-1])
    at += np.repeat(code.first.take(leaf) - begin, sizes)
    line = np.arange(line_ends[-1])
    line += np.repeat(code.first_line.take(leaf) - line_ends + lines, lines)
    h = np.repeat(contexts, lines, axis=1)  # hashed once a line of three bits
    h ^= code.line.take(line)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x27D4EB2F)
    h >>= np.uint32(35 - WORD_BITS)
    h <<= np.uint32(3)
    whose, place = np.repeat(np.arange(len(line)), code.width.take(line)), code.place.take(at)
    slots = np.empty((len(h), len(at)), np.int64)
    for k, own in enumerate(h):
        np.bitwise_or(own.take(whose), place, out=slots[k])
    prior, logit = (code.prior_without, code.logit_without) if learning else (code.prior, code.logit)
    return slots, prior.take(at), logit.take(at), code.gate.take(at), code.bit.take(at), begin


def spell(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of words, each with a closing blank; a rolling context hash per order; each byte's word."""
    data = np.frombuffer((b"\x00" * max(ORDERS)).join([b"", *(w + b" " for w in words)]), np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    word = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(word)) + max(ORDERS) * (word + 1)
    contexts = []
    h = np.zeros(len(word), np.uint32)
    for k in range(1, max(ORDERS) + 1):
        h = (h + data[at - k].astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(14)
        if k in ORDERS:
            contexts.append(h.copy())
    return data[at], np.stack(contexts), word


def byte_bits(data: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, None, None, np.ndarray, np.ndarray]:
    """Slots, prior and logit (none: a half), gate and value of the 8 bits of every byte: all first bits, then all second ones, and so on."""
    partial, n = np.ones(len(data), np.uint32), len(data)
    slots, bits = np.empty((len(contexts), 8 * n), np.int64), np.empty(8 * n, np.int8)
    for k in range(8):
        bit = data >> np.uint8(7 - k) & np.uint8(1)
        h = contexts ^ partial * np.uint32(0x85EBCA6B)
        h *= np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x27D4EB2F)
        h >>= np.uint32(32 - SLOT_BITS)
        slots[:, k * n : k * n + n] = h
        bits[k * n : k * n + n] = bit
        partial = partial << np.uint32(1) | bit
    return slots, None, None, np.repeat(np.arange(0, 32, 4), n), bits


def spelling_log10(model: Bits, words: list[bytes]) -> np.ndarray:
    data, contexts, word = spell(words)
    return np.bincount(np.tile(word, 8), model.log(*byte_bits(data, contexts)), len(words)) / np.log(10)


def token_log10(model: Bits, code: Code, leaf: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    out = np.empty(len(leaf))
    for i in range(0, len(leaf), AT_ONCE):
        *bits, begin = node_bits(code, leaf[i : i + AT_ONCE], contexts[:, i : i + AT_ONCE])
        out[i : i + AT_ONCE] = np.add.reduceat(model.log(*bits), begin)
    return out / np.log(10)


def shards_of(docs: DataFrame) -> DataFrame:
    """Fewer, larger partitions for passes that send a table each: some per core, and no more than eight read as one beyond that."""
    return docs.coalesce(max(4 * docs.sparkSession.sparkContext.defaultParallelism, docs.rdd.getNumPartitions() // 8))


def word_counts(docs: DataFrame) -> DataFrame:
    """``word binary, c``: every word of every document with its number in training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, limit=6 << 20):
                learned: Counter[bytes] = Counter()
                other: set[bytes] = set()
                for text, held_out in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    (other if held_out else learned).update(lower_words_of(text))
                other.difference_update(learned)
                words = [*learned, *other]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([*learned.values()] + [0] * len(other), pa.int64())], ["word", "c"])

    return docs.select("text", "unlearned").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def escaped_shares(spectrum: dict[int, int], least: int) -> tuple[float, float, int]:
    """Discount of a count, share of the spelling, and tokens of the words with counts below ``least``; ``spectrum``: words of each count."""
    once, twice = spectrum.get(1, 0), spectrum.get(2, 0)
    discount = (once + 0.5) / (once + 2 * twice + 1)  # above 0 and below 1
    tokens = sum(c * n for c, n in spectrum.items() if c < least)
    words = sum(n for c, n in spectrum.items() if c < least)
    return discount, discount * words / tokens if tokens else 1.0, tokens


def _coded(texts: list[str | None], code: dict[bytes, int], shorts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[bytes]]]:
    """Leaf and contexts of every token, ends of the texts, and the words that are spelled; ``shorts``: number of a leaf's short word or 0."""
    tokens: list[bytes] = []
    ends = []
    for text in texts:
        tokens += lower_words_of(text)
        tokens.append(b"")  # the end; no word is empty
        ends.append(len(tokens))
    leaf = np.fromiter(map(code.get, tokens, repeat(ESCAPE)), np.int64, len(tokens))
    own = shorts.take(leaf)
    first = np.repeat(np.concatenate(([0], ends[:-1])), np.diff(ends, prepend=0)).astype(np.int64)
    mark = np.where(own > 0, np.arange(len(tokens)), -1)
    last = np.maximum.accumulate(np.concatenate(([-1], mark[:-1])))  # nearest short word before each token
    short = np.where(last >= first, own[last], 0).astype(np.uint32)
    before = []  # the words one and two places before; 0 beyond the beginning of the text
    for k in (1, 2):
        at = np.arange(len(tokens)) - k
        before.append(np.where(at >= first, leaf[at] + 1, 0).astype(np.uint32) * np.uint32(0x9E3779B1))
    both = (before[0] ^ before[1] >> np.uint32(13)) * np.uint32(0x85EBCA77) + before[1]
    contexts = np.stack((short * np.uint32(0x9E3779B1), before[0], both))
    spelled: list[list[bytes]] = [[] for _ in texts]
    at = np.flatnonzero(leaf == ESCAPE)
    for i, d in zip(at.tolist(), np.searchsorted(ends, at, side="right").tolist(), strict=True):
        spelled[d].append(tokens[i])
    return leaf, contexts, np.array(ends), spelled


def scores(docs: DataFrame, held_out_modulus: int = 10) -> DataFrame:
    """One row per document: the contract's columns, ``n_bytes`` and ``bits_per_byte``."""
    spark = docs.sparkSession
    fold = bucket_of("doc_id", held_out_modulus)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), (fold == 0).alias("held_out"), (fold <= 0).alias("unlearned"))
    counts = cut(word_counts(docs))
    release(spark)  # shuffles of a pass are dropped before the next one
    ends = docs.where("NOT unlearned").count()
    spectrum = sorted(counts.where("c > 0").groupBy("c").agg(F.count("*").alias("n")).collect(), reverse=True)
    train_tokens = sum(r["c"] * r["n"] for r in spectrum) + ends
    distinct = sum(r["n"] for r in spectrum) + (ends > 0)
    least, kept = 1 << 62, 0
    for r in spectrum:  # words seen once are escaped, so that the escape learns how likely a new word is
        if kept + r["n"] > FREQUENT or r["c"] < 2:
            break
        least, kept = r["c"], kept + r["n"]
    frequent = [(bytes(r["word"]), r["c"]) for r in counts.where(F.col("c") >= least).collect()]  # at most FREQUENT words
    frequent.sort(key=lambda x: (-x[1].bit_length(), x[0]))
    code = {b"": END} | {w: i + 2 for i, (w, _) in enumerate(frequent)}
    short_words = [w for w, _ in sorted((x for x in frequent if len(x[0]) <= 3), key=lambda x: (-x[1], x[0]))[:SHORTS]]
    shorts = np.zeros(len(frequent) + 2, np.int64)
    shorts[[code[w] for w in short_words]] = np.arange(len(short_words)) + 1
    shared = spark.sparkContext.broadcast((code, shorts))
    rare = counts.where(F.col("c") < least)
    discount, new, rare_tokens = escaped_shares({r["c"]: r["n"] for r in spectrum}, least)
    known = np.array([ends, 0.0, *(c for _, c in frequent)])
    weights = known.copy()
    weights[ESCAPE] = rare_tokens
    tree = spark.sparkContext.broadcast(Code(np.maximum(weights, 1)))
    new_words, new_spelling = (lambda: Bits(CONTEXTS, DEPTHS, WORD_BITS)), (lambda: Bits(len(ORDERS), 8, SLOT_BITS))

    def reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = new_words()
        for batch in batches:
            for part in chunks(batch):
                leaf, contexts, _, _ = _coded(part.column(0).to_pylist(), *shared.value)
                for i in range(0, len(leaf), STEP):
                    *bits, _ = node_bits(tree.value, leaf[i : i + STEP], contexts[:, i : i + STEP], True)
                    model.learn(*bits)
        yield model.blocks()

    training = shards_of(docs.where("NOT unlearned").select("text"))
    words_model = new_words().added(training.mapInArrow(reading, "block int, sums binary"))
    release(spark)

    def spelling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = new_spelling()
        for batch in batches:
            words = batch.column(0).to_pylist()
            for i in range(0, len(words), SPELL_STEP):
                data, contexts, _ = spell(words[i : i + SPELL_STEP])
                model.learn(*byte_bits(data, contexts))
        yield model.blocks()

    distinct_words = shards_of(counts.where("c > 0").select("word"))
    spelling_model = new_spelling().added(distinct_words.mapInArrow(spelling, "block int, sums binary"))
    release(spark)
    tables = spark.sparkContext.broadcast((words_model, spelling_model))
    below = np.log10(train_tokens + 0.1 * (distinct + 1))
    base_of = spark.sparkContext.broadcast(np.where(np.arange(len(known)) == ESCAPE, 0.0, np.log10(known + 0.1) - below))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                texts = part.column(1).to_pylist()
                leaf, contexts, stops, others = _coded(texts, *shared.value)
                begin = np.concatenate(([0], stops[:-1])).astype(np.int64)
                n = len(texts)
                total = lambda x: np.add.reduceat(x, begin)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                rest = [Counter(o) for o in others]
                owner = np.repeat(ids, np.fromiter(map(len, rest), np.int64, n))
                words = [w for c in rest for w in c]
                sizes = np.fromiter((len(t.encode("utf-8", "replace")) if t else 0 for t in texts), np.int64, n)
                nothing = [None] * len(words)
                known_leaf = total((leaf != ESCAPE).astype(np.int64)) - (0 if ends else 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate((ids, owner))),
                        pa.array([None] * n + words, pa.binary()),
                        pa.array(np.concatenate((np.diff(stops, prepend=0), [k for c in rest for k in c.values()])).astype(np.int64)),
                        pa.array(known_leaf.tolist() + nothing, pa.int64()),
                        pa.array(sizes.tolist() + nothing, pa.int64()),
                        pa.array(total(base_of.value[leaf]).tolist() + nothing, pa.float64()),
                        pa.array(total(token_log10(tables.value[0], tree.value, leaf, contexts)).tolist() + nothing, pa.float64()),
                    ],
                    ["id", "word", "n", "known", "n_bytes", "base", "score"],
                )

    numbered = docs.select("doc_id", "held_out", "text", F.monotonically_increasing_id().alias("id"))
    ids = numbered.select("id", "text", "doc_id", "held_out")
    rated = cut(_with_row(ids, rate))

    def spell_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            found = [spelling_log10(tables.value[1], words[i : i + 500]) for i in range(0, len(words), 500)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(found) if found else np.empty(0))], ["word", "c", "spelled"])

    spelled_words = rare.mapInArrow(spell_out, "word binary, c long, spelled double")
    own = (F.col("c") - F.lit(discount)) / F.lit(max(1, rare_tokens))
    by_spelling = F.col("spelled") + F.lit(float(np.log10(new)))
    escaped = F.when(F.col("c") > 0, F.log10(own + F.pow(F.lit(10.0), by_spelling))).otherwise(by_spelling)
    joined = rated.where("word IS NOT NULL").select("id", "word", "n").join(spelled_words, "word")
    more = joined.groupBy("id").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(F.col("n") * (F.log10(F.col("c") + 0.1) - F.lit(float(below)))).alias("more_base"),
        F.sum(F.col("n") * escaped).alias("more_score"),
    )
    made = rated.where("word IS NULL").join(more, "id", "left")
    score = F.col("score") + F.coalesce("more_score", F.lit(0.0))
    return made.select(
        "doc_id",
        "held_out",
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        score.alias("score"),
        "n_bytes",
        (-score / F.lit(float(np.log10(2))) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )


def _with_row(rows: DataFrame, rate) -> DataFrame:
    """``rate`` over (id, text), with doc_id and held_out put back on the rows of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                for out in rate(iter([part.select(["id", "text"])])):
                    rest = pa.nulls(out.num_rows - part.num_rows)
                    extra = [pa.concat_arrays([part.column(k), rest.cast(part.column(k).type)]) for k in ("doc_id", "held_out")]
                    yield pa.RecordBatch.from_arrays([*out.columns, *extra], [*out.schema.names, "doc_id", "held_out"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id long, word binary, n long, known long, n_bytes long, base double, score double, doc_id {kind}, held_out boolean")


def op5_lm_score(spark, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
