"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

1. *Word vectors.* Every word and every word shape (letters, digits and symbols in runs) has a
   hashed bucket and a fixed sparse ternary index vector. The vector of a bucket is the sum of the
   index vectors around its occurrences in all documents; tasks add up dense tables, which are
   summed block by block. The table's size is fixed, whatever the corpus.
2. *Pooling.* Mean and spread of the vectors of a document's words and shapes, similarity of
   neighbours, and the length: one row per document, all of it, never a prefix.
3. *Network.* Two layers in numpy, fitted on a bounded sample of labelled rows
   (``TrainingBound.rows``), with a temperature fitted on held-back rows of that sample, so scores
   are calibrated probabilities of label 1.

Defined cases: a null text counts as empty, and empty texts are scored from a zero vector; labels
that are null or not 0 or 1 are not learned from; without labels of both kinds every score is the
known share of label 1 (0.5 if nothing is known); repeated rows are scored alike and repeated
labels weigh as often as they occur; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdara.llm.common import bucket_of, chunks, cut

WORDS, SHAPES, DIM, NONZERO, REACH = 1 << 14, 1 << 10, 32, 4, 2
BUCKETS = WORDS + SHAPES  # the row after the last is the blank between documents
BLOCK = 64
FEATURES = 4 * DIM + 4


NOT_WORD = re.compile(r"\W+")
#: Text worked on at once in the numeric parts, so that its arrays stay in the processor's cache.
PIECE = 1 << 18


def shape(word: str) -> str:
    """``Word,`` is ``Aa,``; ``is%%%`` is ``a%``: case, digits and symbols without lengths."""
    out = []
    for c in word:
        kind = "9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out)


class Buckets(dict):
    """Bucket pair of each token, computed when first asked for and kept up to a bound."""

    LIMIT = 200_000

    def __missing__(self, token: str) -> int:
        stem = NOT_WORD.sub("", token).lower() or token
        word = xxhash.xxh32_intdigest(stem.encode("utf-8", "replace"), 1) % WORDS
        self[token] = both = word << 16 | WORDS + xxhash.xxh32_intdigest(shape(token).encode("utf-8", "replace"), 2) % SHAPES
        return both

    def of(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > self.LIMIT:
            self.clear()
        both = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        return both >> 16, both & 0xFFFF


def index_vectors() -> np.ndarray:
    """The fixed ternary index vector of each bucket; zero for the blank."""
    rng = np.random.default_rng(11)
    out = np.zeros((BUCKETS + 1, DIM), np.float32)
    for k in range(NONZERO):
        out[np.arange(BUCKETS), rng.integers(0, DIM, BUCKETS)] += rng.choice((-1.0, 1.0), BUCKETS).astype(np.float32)
    return out


def _streams(texts: list[str | None], buckets: Buckets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word and shape buckets of all texts, each followed by blanks, and the token counts."""
    tokens = [(text or "").split() for text in texts]
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    w, s = buckets.of([t for row in tokens for t in row])
    at = np.arange(len(w)) + REACH * np.repeat(np.arange(len(sizes)), sizes)
    words, shapes = (np.full(len(w) + REACH * len(sizes), BUCKETS) for _ in range(2))
    words[at], shapes[at] = w, s
    return words, shapes, sizes


def context_table(docs: DataFrame) -> np.ndarray:
    """Unit vectors of all buckets, from the surroundings of their occurrences in every document."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, index = Buckets(), np.ascontiguousarray(index_vectors().T)
        table = np.zeros((DIM, BUCKETS + 1))
        for batch in batches:
            for part in chunks(batch, limit=PIECE):
                w, s, _ = _streams(part.column(0).to_pylist(), buckets)
                n = len(w)
                own = np.zeros((DIM, n + 2 * REACH), np.float32)
                own[:, REACH : n + REACH] = index[:, w] + index[:, s]
                around = own[:, :n] + own[:, 1 : n + 1] + own[:, 3 : n + 3] + own[:, 4 : n + 4]
                for d in range(DIM):
                    table[d] += np.bincount(w, around[d], BUCKETS + 1)
                    table[d] += np.bincount(s, around[d], BUCKETS + 1)
        blocks = table[:, :BUCKETS].T.astype(np.float32).reshape(-1, BLOCK * DIM)
        used = np.flatnonzero(blocks.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([blocks[i].tobytes() for i in used], pa.binary())], ["block", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = np.frombuffer(payload, np.float32).astype(np.float64)
                sums[block] = sums[block] + found if block in sums else found
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["block", "sums"])

    schema = "block int, sums binary"
    table = np.zeros((BUCKETS // BLOCK, BLOCK * DIM))
    for row in docs.select("text").mapInArrow(gather, schema).repartition("block").mapInArrow(add, schema).collect():  # BUCKETS * DIM numbers in all
        table[row["block"]] = np.frombuffer(row["sums"])
    table = table.reshape(BUCKETS, DIM)
    table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)
    return np.vstack((table + 0.5 * index_vectors()[:BUCKETS], np.zeros((1, DIM)))).astype(np.float32)


def pooled(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """``doc_id, vector binary`` (float32) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, vectors = Buckets(), np.ascontiguousarray(shared.value.T)
        for batch in batches:
            for part in chunks(batch, limit=PIECE):
                w, s, sizes = _streams(part.column(1).to_pylist(), buckets)
                start = np.cumsum(sizes + REACH) - sizes - REACH
                count = np.maximum(sizes, 1)
                out = []
                for stream in (w, s):
                    v = vectors[:, stream]
                    near = np.einsum("ij,ij->j", v[:, 1:], v[:, :-1])
                    mean = np.add.reduceat(v, start, axis=1) / count
                    v *= v
                    spread = np.sqrt(np.maximum(np.add.reduceat(v, start, axis=1) / count - mean * mean, 0))
                    out += [mean, spread, (np.add.reduceat(np.append(0, near), start) / count)[None]]
                out += [np.log1p(sizes)[None], (sizes == 0)[None]]
                features = np.ascontiguousarray(np.vstack(out).T, np.float32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f.tobytes() for f in features], pa.binary())], ["doc_id", "vector"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, vector binary")


@dataclass(frozen=True)
class TrainingBound:
    """Expected number of labelled rows that the fit may take to the driver, and its settings."""

    rows: int = 8000
    hidden: int = 24
    epochs: int = 60
    rate: float = 0.004
    decay: float = 1e-3


@dataclass
class Network:
    centre: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.margin(x) / self.temperature, -40, 40)))

    def margin(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh(np.clip((x - self.centre) / self.scale, -8, 8) @ w1 + b1) @ w2 + b2[0]


def fit(x: np.ndarray, y: np.ndarray, bound: TrainingBound) -> Network:
    """Adam on the logistic loss over 4/5 of the rows, the temperature on the rest."""
    known = float(y.mean()) if len(y) else 0.5
    if len(y) < 20 or known in (0.0, 1.0):
        return Network(np.zeros(FEATURES), np.ones(FEATURES), [], 1.0, known)
    rng = np.random.default_rng(5)
    order = rng.permutation(len(y))
    x, y = x[order].astype(np.float64), y[order].astype(np.float64)
    back = len(y) // 5
    held_x, held_y, x, y = x[:back], y[:back], x[back:], y[back:]
    net = Network(x.mean(0), x.std(0) + 1e-3, [rng.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, bound.hidden)), np.zeros(bound.hidden), rng.normal(0, 0.3, bound.hidden), np.zeros(1)], 1.0)
    z = np.clip((x - net.centre) / net.scale, -8, 8)
    first, second, t = [np.zeros_like(p) for p in net.layers], [np.zeros_like(p) for p in net.layers], 0
    for _ in range(bound.epochs):
        for at in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            w1, b1, w2, b2 = net.layers
            hidden = np.tanh(z[at] @ w1 + b1)
            error = (1 / (1 + np.exp(-np.clip(hidden @ w2 + b2[0], -40, 40))) - y[at]) / len(at)
            back_h = np.outer(error, w2) * (1 - hidden**2)
            grads = [z[at].T @ back_h + bound.decay * w1, back_h.sum(0), hidden.T @ error + bound.decay * w2, np.array([error.sum()])]
            t += 1
            for p, g, m, v in zip(net.layers, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= bound.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    margin = net.margin(held_x)
    loss = lambda temperature: float(np.mean(np.logaddexp(0, margin / temperature) - held_y * margin / temperature))
    net.temperature = float(min(np.geomspace(0.3, 8, 67), key=loss))
    return net


def classify(docs: DataFrame, labels: DataFrame, bound: TrainingBound = TrainingBound(), threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``; learns from ``labels(doc_id, quality)`` outside the held-out fold."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    vectors = cut(pooled(docs, context_table(docs)))
    usable = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(bucket_of("doc_id", 5) != 0).select("doc_id", F.col("quality").cast("int").alias("quality"))
    share = bound.rows / max(1, usable.count())
    drawn = usable.where(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30)) < min(1.0, share) * (1 << 30))
    rows = vectors.join(F.broadcast(drawn), "doc_id").select("doc_id", "vector", "quality").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["quality"], bytes(r["vector"])))
    x = np.frombuffer(b"".join(bytes(r["vector"]) for r in rows), np.float32).reshape(-1, FEATURES)
    shared = spark.sparkContext.broadcast(fit(x, np.array([r["quality"] for r in rows]), bound))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, FEATURES)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(x))], ["doc_id", "score"])

    made = vectors.mapInArrow(run, f"doc_id {vectors.schema['doc_id'].dataType.simpleString()}, score double")
    return made.select("doc_id", (bucket_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
