"""Substring deduplication by repeated-phrase automata.

A phrase is a run of ``window`` consecutive words. Every phrase that starts at two places anywhere
in the corpus is found exactly, and every word it covers is removed.

1. *Anchors.* In each phrase the k-gram of least hash is its anchor, so equal phrases have equal
   anchors; only anchors (about one word in fifteen) are shuffled. An anchor seen once ends there.
2. *Confirmation.* Where a repeated anchor has the same words around it as another one, all phrases
   over it are confirmed at once. The phrases over the other repeated anchors are compared one by
   one, with each other and with one representative of every confirmed surrounding.
3. *Automata.* Confirmed phrases that tile the recurring passages are compiled into Aho-Corasick
   automata, one per shard of documents with exactly the phrases that can occur in it, and each
   document is streamed through its shard's automaton; matches are exact on the words.

Within a task equal anchors and phrases confirm each other and only one of them is sent on, so a
passage that a third of all documents share reaches a task as one entry per batch. Nothing is
sampled or capped.

Defined cases: null or empty texts have no words; texts shorter than the window lose nothing;
repeated rows are further occurrences, so all of them lose what they repeat; a repeat within one
document counts; null ids are kept; other columns are not read.
"""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdara.llm.common import WordHasher, chunks, cut, dealt, mix64, only_members, parts_of, release, row_key, words_of

KGRAM = 8
ODD = 0x9E3779B97F4A7C15
#: What the reducer says of an anchor: look at its phrases, all confirmed, all confirmed and to be shown to others.
OPEN, SURE, SHOWN = 0, 1, 2


class Spans:
    """Hash of any run of words of a document in constant time."""

    def __init__(self, hashes: np.ndarray) -> None:
        n = len(hashes)
        self.powers, self.inverse, self.sums = (np.zeros(n + 1, np.uint64) for _ in range(3))
        for table, factor in ((self.powers, ODD), (self.inverse, pow(ODD, -1, 1 << 64))):
            table[0], table[1:] = 1, factor
            np.multiply.accumulate(table, out=table)
        np.add.accumulate(hashes * self.powers[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix64((self.sums[stop] - self.sums[start]) * self.inverse[start] + (stop - start).astype(np.uint64))


def anchors(spans: Spans, n: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all phrases of a document of n words."""
    at = np.arange(n - KGRAM + 1)
    grams = spans(at, at + KGRAM)
    width = window - KGRAM + 1
    chosen = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(1) + np.arange(n - window + 1)
    chosen = np.unique(chosen)
    return chosen, grams[chosen]


def ranges(starts: np.ndarray, stops: np.ndarray, size: int) -> np.ndarray:
    """Mask of the places in any [start, stop]."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, stops + 1, -1)
    return np.cumsum(steps)[:size] > 0


def reach(place: np.ndarray, n: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the phrases that hold the k-gram at each place."""
    return np.maximum(place - (window - KGRAM), 0), np.minimum(place, n - window)


ENTRY = np.dtype([("name", np.uint64), ("around", np.uint64), ("key", np.int64), ("place", np.int32), ("times", np.int32)])


def _sent(entries: np.ndarray, parts: int) -> pa.RecordBatch:
    """Entries packed by part of their name."""
    part = (entries["name"] >> np.uint64(30)) % np.uint64(parts)
    by = np.argsort(part, kind="stable")
    entries, part = entries[by], part[by]
    edges = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)])) if len(part) else np.zeros(1, np.int64)
    payload = [entries[i:j].tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(part[edges[:-1]].astype(np.int32)), pa.array(payload, pa.binary())], ["part", "payload"])


def _merged(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One entry per (name, around) with the occurrences summed, and the occurrences beyond it."""
    by = np.lexsort((entries["place"], entries["key"], entries["around"], entries["name"]))
    entries = entries[by]
    first = np.ones(len(entries), bool)
    first[1:] = (entries["name"][1:] != entries["name"][:-1]) | (entries["around"][1:] != entries["around"][:-1])
    one = entries[first].copy()
    if len(entries):
        one["times"] = np.minimum(np.add.reduceat(entries["times"].astype(np.int64), np.flatnonzero(first)), 2)
    return one, entries[~first]


def _answers(key: np.ndarray, place: np.ndarray, said: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(place.astype(np.int32)), pa.array(said.astype(np.int32))], ["key", "place", "said"])


def _exchange(asked: DataFrame) -> DataFrame:
    """``key, place, said`` for every repeated entry of ``asked(part, payload, known)``; known ones pass through."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, ENTRY)]
        for batch in batches:
            for payload, known in zip(batch.column(1), batch.column(2), strict=True):
                if known.is_valid:
                    e = np.frombuffer(known.as_buffer(), ENTRY)
                    yield _answers(e["key"], e["place"], np.full(len(e), SURE))
                if payload.is_valid:
                    held.append(np.frombuffer(payload.as_buffer(), ENTRY))
        one, more = _merged(np.concatenate(held))
        held.clear()
        yield _answers(more["key"], more["place"], np.full(len(more), SURE))
        start = np.flatnonzero(np.concatenate(([True], one["name"][1:] != one["name"][:-1]))) if len(one) else np.empty(0, np.int64)
        if len(one):
            total = np.repeat(np.add.reduceat(one["times"].astype(np.int64), start), np.diff(np.append(start, len(one))))
            said = np.where(one["times"] > 1, SHOWN, OPEN)
            keep = total > 1
            yield _answers(one["key"][keep], one["place"][keep], said[keep])

    return dealt(asked).mapInArrow(decide, "key long, place int, said int")


def _ask(entries: list[np.ndarray], parts: int) -> Iterator[pa.RecordBatch]:
    """Rows for ``_exchange`` from a batch's entries; repeats within the batch are known already."""
    if not entries:
        return
    one, more = _merged(np.concatenate(entries))
    sent = _sent(one, parts)
    yield pa.RecordBatch.from_arrays([*sent.columns, pa.nulls(sent.num_rows, pa.binary())], ["part", "payload", "known"])
    if len(more):
        cuts = np.array_split(more, max(1, len(more) // 20_000))
        where = pa.array([int(c["key"][0]) % parts for c in cuts], pa.int32())
        yield pa.RecordBatch.from_arrays([where, pa.nulls(len(cuts), pa.binary()), pa.array([c.tobytes() for c in cuts], pa.binary())], ["part", "payload", "known"])


def repeated_anchors(docs: DataFrame, window: int) -> DataFrame:
    """``key, place, said`` of every anchor of ``docs(key, text)`` that occurs more than once."""
    parts = parts_of(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            entries = []
            for part in chunks(batch):
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = words_of(text)
                    n = len(words)
                    if n < window:
                        continue
                    spans = Spans(hasher(words))
                    place, name = anchors(spans, n, window)
                    e = np.zeros(len(place), ENTRY)
                    low, high = np.maximum(place - (window - KGRAM), 0), np.minimum(place + window, n)
                    e["name"], e["key"], e["place"], e["times"] = name, key, place, 1
                    e["around"] = mix64(spans(low, high) + (place - low).astype(np.uint64))
                    entries.append(e)
            yield from _ask(entries, parts)

    return _exchange(docs.select("key", "text").mapInArrow(run, "part int, payload binary, known binary"))


def _said(rows: DataFrame) -> DataFrame:
    """All answers of a document in one row; their number is bounded by the document's length."""
    return rows.groupBy("key").agg(F.collect_list(F.struct("place", "said")).alias("answers"))


def repeated_phrases(docs: DataFrame, answers: DataFrame, window: int) -> DataFrame:
    """``key, place, said``: starts of the repeated phrases over anchors that were left open."""
    parts = parts_of(docs)
    asked = cut(_said(answers).where(F.exists("answers", lambda a: a["said"] != SURE)))
    rows = only_members(docs.select("key", "text"), asked, "key").join(asked, "key").select("key", "text", F.col("answers.place").alias("place"), F.col("answers.said").alias("said"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            entries = []
            for part in chunks(batch):
                for key, text, place, said in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    words = words_of(text)
                    n = len(words)
                    spans, place, said = Spans(hasher(words)), np.array(place), np.array(said)
                    low, high = reach(place, n, window)
                    sure = ranges(low[said != OPEN], high[said != OPEN], n)
                    for mask, times in ((ranges(low[said == OPEN], high[said == OPEN], n) & ~sure, 1), (ranges(low[said == SHOWN], high[said == SHOWN], n), 2)):
                        start = np.flatnonzero(mask)
                        e = np.zeros(len(start), ENTRY)
                        e["name"], e["key"], e["place"], e["times"] = spans(start, start + window), key, start, times
                        entries.append(e)
            yield from _ask(entries, parts)

    return _exchange(rows.mapInArrow(run, "part int, payload binary, known binary"))


def _tiles(mask: np.ndarray, window: int) -> list[int]:
    """Starts of phrases that cover exactly what all the phrases of the mask cover."""
    at = np.flatnonzero(mask)
    out = []
    for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else []:
        out += range(int(run[0]), int(run[-1]), window)
        out.append(int(run[-1]))
    return out


def _located(texts: list[list[bytes]], starts: list[list[int]], window: int) -> list[np.ndarray]:
    """Words of each text that a phrase covers: the shard's automaton, and every text streamed through it."""
    import ahocorasick

    number: dict[bytes, int] = {}
    coded = [tuple([number.setdefault(w, len(number)) for w in words]) for words in texts]
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
    for words, at in zip(coded, starts, strict=True):
        for s in at:
            automaton.add_word(words[s : s + window])
    out = []
    if not len(automaton):
        return [np.zeros(len(t), bool) for t in texts]
    automaton.make_automaton()
    for words in coded:
        ends = np.fromiter((end for end, _ in automaton.iter(words)), np.int64)
        out.append(ranges(ends - window + 1, ends, len(words)))
    return out


def deduplicate(docs: DataFrame, window: int = 35) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` (kept words joined by a blank) of every row of ``docs(doc_id, text)``."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("key", row_key())
    answers = cut(repeated_anchors(docs, window))
    release(docs.sparkSession)
    phrases = cut(repeated_phrases(docs, answers, window))
    release(docs.sparkSession)
    sure = answers.where(F.col("said") != OPEN).select("key", "place", F.lit(0).alias("kind"))
    found = cut(sure.unionByName(phrases.select("key", "place", F.lit(1).alias("kind"))).groupBy("key").agg(F.collect_list("place").alias("place"), F.collect_list("kind").alias("kind")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                texts = [words_of(t) for t in part.column(1).to_pylist()]
                starts: list[list[int]] = [[] for _ in texts]
                if part.num_columns > 2:
                    for i, (place, kind) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                        if place:
                            n, place, kind = len(texts[i]), np.array(place), np.array(kind)
                            low, high = reach(place[kind == 0], n, window)
                            mask = ranges(low, high, n)
                            mask[place[kind == 1]] = True
                            starts[i] = _tiles(mask, window)
                gone = _located(texts, starts, window) if any(starts) else [None] * len(texts)
                kept = [b" ".join(words if g is None else [w for w, x in zip(words, g.tolist(), strict=True) if not x]) for words, g in zip(texts, gone, strict=True)]
                removed = [0 if g is None else int(g.sum()) for g in gone]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, texts), pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept binary"
    touched = only_members(docs, found, "key").join(found, "key", "left").select("doc_id", "text", "place", "kind")
    untouched = only_members(docs, found, "key", others=True).select("doc_id", "text")
    made = touched.mapInArrow(run, schema).unionByName(untouched.mapInArrow(run, schema))
    return made.withColumn("kept", F.col("kept").cast("string"))


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    made = deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
