"""Hierarchical language identification with linear support vector machines.

First the language family is decided, then the language within it; at both levels one linear
SVM per pair of classes votes. Features are hashed character n-grams of the lower-cased whole
text. Training takes a bounded sample of labelled rows (``TrainingBound.per_language`` rows
expected per language); prediction streams over all rows inside the tasks.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; null languages
are not learned from; with no labelled row everything is ``und``, with one language every text
with letters is that language at score 1; repeated rows are predicted alike; ties go to the
alphabetically first class; other columns, whatever their names, are never read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdara.llm.common import bucket_of, chunks, has_letter

BITS = 17
ORDERS = (1, 2, 3)

# Families of ISO 639-1 codes; a language not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no is af",
    "romance": "es fr it pt ca ro gl",
    "slavic": "ru uk pl cs sk bg sr hr sl",
    "uralic": "fi et hu",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


@dataclass(frozen=True)
class TrainingBound:
    """Expected number of labelled rows per language that the fit may take to the driver, and its passes over them."""

    per_language: int = 700
    epochs: int = 12
    cost: float = 4.0


_BLANK = bytes(b if chr(b).isalpha() or b >= 128 else 32 for b in range(256))


def _grams(data: np.ndarray, order: int) -> np.ndarray:
    """Hash bucket of the n-gram that starts at each byte (the last ones wrap into the padding)."""
    n = len(data) - order + 1
    h = np.full(n, order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for k in range(order):
        h += data[k : k + n]
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
    return (h >> np.uint32(32 - BITS)).astype(np.int64)


def _prepare(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, lower-cased, with everything but letters blank, and the start of each text."""
    parts = [b" " + (t or "").lower().encode("utf-8", "replace").translate(_BLANK) + b"  " for t in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.frombuffer(b"".join(parts) + b"   ", np.uint8).astype(np.uint32), np.cumsum(sizes) - sizes


def _features(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse relative frequencies of each text."""
    out = []
    for text in texts:
        data, _ = _prepare([text])
        h = np.concatenate([_grams(data, k) for k in ORDERS])
        at, n = np.unique(h, return_counts=True)
        out.append((at, n / len(h)))
    return out


def _fit_svm(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, bound: TrainingBound) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for an L1-loss linear SVM; returns weights and the margin scale for scores."""
    w = np.zeros(1 << BITS)
    alpha = np.zeros(len(rows))
    unit = [(at, v / np.linalg.norm(v)) for at, v in rows]
    rng = np.random.default_rng(7)
    n_pos = max(1, int((sign > 0).sum()))
    n_neg = max(1, len(rows) - n_pos)
    cap = np.where(sign > 0, len(rows) / (2 * n_pos), len(rows) / (2 * n_neg)) * bound.cost
    for _ in range(bound.epochs):
        for i in rng.permutation(len(rows)):
            at, v = unit[i]
            gradient = sign[i] * float(w[at] @ v) - 1
            new = min(max(alpha[i] - gradient, 0.0), cap[i])
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * sign[i] * v
                alpha[i] = new
    margins = np.abs([float(w[at] @ v) for at, v in rows])
    return w, float(np.median(margins)) or 1.0


@dataclass
class Node:
    """Classes decided at one level, with a column of the weight table per pair of them."""

    classes: list[str]
    pairs: list[tuple[int, int, int, float]]


@dataclass
class LanguageModel:
    weights: np.ndarray
    root: Node
    within: dict[str, Node]

    def decide(self, node: Node, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        votes = np.zeros((len(margins), len(node.classes)))
        sure = np.zeros_like(votes)
        for a, b, column, scale in node.pairs:
            p = 1 / (1 + np.exp(-np.clip(2 * margins[:, column] / scale, -30, 30)))
            votes[:, a] += p >= 0.5
            votes[:, b] += p < 0.5
            sure[:, a] += p
            sure[:, b] += 1 - p
        best = (votes + sure / (len(node.classes) + 1)).argmax(1)
        return best, sure[np.arange(len(best)), best] / max(1, len(node.classes) - 1) if node.pairs else np.ones(len(best))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        data, starts = _prepare(texts)
        lengths = np.diff(np.append(starts, len(data) - 3)).astype(float)
        margins = np.zeros((len(texts), self.weights.shape[1]))
        for order in ORDERS:
            margins += np.add.reduceat(self.weights[_grams(data, order)[: len(data) - 3]], starts, axis=0)
        margins /= (len(ORDERS) * lengths)[:, None]
        family, p = self.decide(self.root, margins)
        names, score = ["und"] * len(texts), np.zeros(len(texts))
        for f, name in enumerate(self.root.classes):
            rows = np.flatnonzero(family == f)
            if len(rows):
                language, q = self.decide(self.within[name], margins[rows])
                score[rows] = p[rows] * q
                for i, k in zip(rows, language, strict=True):
                    names[i] = self.within[name].classes[k]
        for i, text in enumerate(texts):
            if not has_letter(text):
                names[i], score[i] = "und", 0.0
        return names, np.clip(np.nan_to_num(score), 0, 1)


def fit(labelled: DataFrame, bound: TrainingBound = TrainingBound()) -> LanguageModel | None:
    """Fit on ``labelled(doc_id, text, lang)``: a hash sample of about ``bound.per_language`` rows of each language."""
    counts = {r["lang"]: r["n"] for r in labelled.where("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(min(1.0, bound.per_language / n))) for k, n in sorted(counts.items())))
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("langid")), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)
    rows = sorted((r["lang"], r["text"]) for r in labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).where(drawn).select("lang", "text").collect())
    rows = [r for r in rows if has_letter(r[1])]
    if not rows:
        return None
    features = _features([t for _, t in rows])
    languages = np.array([lang for lang, _ in rows])
    families = np.array([FAMILY_OF.get(lang, lang) for lang in languages])
    columns: list[np.ndarray] = []

    def node(labels: np.ndarray, classes: list[str]) -> Node:
        pairs = []
        for a, b in itertools.combinations(range(len(classes)), 2):
            of = np.flatnonzero((labels == classes[a]) | (labels == classes[b]))
            w, scale = _fit_svm([features[i] for i in of], np.where(labels[of] == classes[a], 1.0, -1.0), bound)
            pairs.append((a, b, len(columns), scale))
            columns.append(w)
        return Node(classes, pairs)

    root = node(families, sorted(set(families)))
    within = {f: node(languages, sorted(set(languages[families == f]))) for f in root.classes}
    return LanguageModel(np.stack(columns, 1).astype(np.float32) if columns else np.zeros((1 << BITS, 1), np.float32), root, within)


def learnable(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from: labelled, and not of the held-out fold."""
    return docs.select("doc_id", "text", "lang").where(bucket_of("doc_id", 4) != 2)


def predict(docs: DataFrame, model: LanguageModel | None, columns: list[str | Column]) -> DataFrame:
    """``columns`` of every row with ``lang_pred`` and ``score`` appended; reads ``text`` only."""
    rows = docs.select(F.struct(*columns).alias("row"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            for part in chunks(batch, limit=1 << 20):
                texts = part.column(1).to_pylist()
                names, score = fitted.predict(texts) if fitted else (["und"] * len(texts), np.zeros(len(texts)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score)], ["row", "lang_pred", "score"])

    made = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double")
    return made.select("row.*", "lang_pred", "score")


def identify(docs: DataFrame, labelled: DataFrame, bound: TrainingBound = TrainingBound()) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred, score."""
    made = predict(docs, fit(learnable(labelled), bound), ["doc_id"])
    return made.select("doc_id", (bucket_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op1_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, docs)
