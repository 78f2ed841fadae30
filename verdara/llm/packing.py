"""Sequence packing by minimum bin slack.

A document's ids (its text's ids and an end id) are cut into full windows; what remains, shorter than a window, joins a
pool of remaining pieces, of which only the lengths matter. A window is filled from the pool's counts by length:
the longest piece first, then the multiset of lengths that comes closest to the rest of the window, found by a
subset-sum over bitsets (bit s of a bitset says that a sum of s can be reached with the lengths so far), from
which the count of each length is traced back. The same multiset is taken as often as the counts
allow. A window that no multiset fills gets the head of the longest piece left, and the rest of that piece returns to the pool.
Ids that are left at the end of a task, fewer than a window, fill windows of powers of two. So no sequence has padding.

Every task packs the documents of its own partition in one pass: texts aren't shuffled, and the pool is
bounded (``POOL`` pieces), however large the table. A task that runs again gives the same
rows; other splits of the table give other sequences, equally full. ``sequence_id`` holds the partition's number in its upper half.

Defined cases: null and empty texts have the end id alone; texts are cut wherever a window ends, very long ones
into many; special tokens inside a text are the ids that the library gives them; repeated rows are packed each
on its own, null ids keep their rows; ties between lengths don't occur, since lengths are distinct keys,
and pieces of one length are taken in order of arrival; other columns are ignored; an empty table gives no piece.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdara.llm.bpe import byte_alphabet
from verdara.llm.common import chunks

#: Ids of a window; pieces that a task's pool holds before windows are filled from it, and those that it keeps.
WINDOW, POOL, KEPT = 2048, 4096, 512


class ByteLevelEncoder:
    """Ids of texts by a byte-level vocabulary file, through the rank encoder of tiktoken."""

    def __init__(self, path: str, special: bool) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        as_byte = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])} if special else {}
        plain = {t: i for t, i in spec["model"]["vocab"].items() if t not in {x["content"] for x in spec.get("added_tokens", [])}}
        self.bytes_of = {i: bytes(as_byte[c] for c in token) for token, i in plain.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.library = tiktoken.Encoding("byte level", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in self.bytes_of.items()}, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if not self.split or not self.split.search(text):
            return np.array(self.library.encode_ordinary(text), np.uint32)
        ids: list[int] = []
        for part in self.split.split(text):
            ids += [self.special[part]] if part in self.special else self.library.encode_ordinary(part)
        return np.array(ids, np.uint32)


@lru_cache(2)
def encoder(path: str, special: bool = True) -> ByteLevelEncoder:
    return ByteLevelEncoder(path, special)


def closest(counts: list[int], room: int) -> list[tuple[int, int]]:
    """The multiset of lengths, as (length, count), whose sum is closest to ``room`` without passing it.

    ``counts[n]`` pieces of length n are there. Longer lengths come first; the sweep ends as soon as the room can be filled.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in range(min(room, len(counts) - 1), 0, -1):
        left, take = min(counts[length], room // length), 1
        while left and not reach >> room & 1:  # a count is a sum of powers of two and a rest
            some = min(take, left)
            steps.append((length, some, reach))
            reach |= reach << (length * some) & mask
            left, take = left - some, take * 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, some, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + some
            at -= length * some
    return sorted(chosen.items(), reverse=True)


class Pool:
    """Remaining pieces by length, and the sequences made from them."""

    def __init__(self, window: int) -> None:
        self.window, self.size, self.total = window, 0, 0
        self.counts = [0] * (window + 1)
        self.pieces: dict[int, deque] = {}

    def put(self, piece: tuple) -> None:
        """``(doc, start, ids, doc_tokens)``."""
        n = len(piece[2])
        self.pieces.setdefault(n, deque()).append(piece)
        self.counts[n] += 1
        self.size, self.total = self.size + 1, self.total + n

    def take(self, length: int) -> tuple:
        self.counts[length] -= 1
        self.size, self.total = self.size - 1, self.total - length
        return self.pieces[length].popleft()

    def longest(self, most: int) -> int:
        return next((n for n in range(most, 0, -1) if self.counts[n]), 0)

    def fill(self, keep: int) -> Iterator[list[tuple]]:
        """Sequences of pieces, each as long as a window or, at the end, a smaller power of two, until at most ``keep`` pieces stay."""
        while self.size > keep:
            room = min(self.window, 1 << (self.total.bit_length() - 1))
            first = self.longest(room)
            chosen: dict[int, int] = {}
            if first:
                self.counts[first] -= 1
                chosen = dict(closest(self.counts, room - first))
                self.counts[first] += 1
                chosen[first] = chosen.get(first, 0) + 1
            slack = room - sum(n * k for n, k in chosen.items())
            times = min(self.counts[n] // k for n, k in chosen.items()) if chosen and not slack else 1
            for _ in range(times):
                made = [self.take(n) for n, k in sorted(chosen.items(), reverse=True) for _ in range(k)]
                if slack:
                    doc, start, ids, tokens = self.take(self.longest(self.window))
                    made.append((doc, start, ids[:slack], tokens))
                    self.put((doc, start + slack, ids[slack:], tokens))
                yield made
                if min(self.window, 1 << max(0, self.total.bit_length() - 1)) < room or self.size <= keep:
                    break


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of every piece; ``window`` is a power of two.

    The vocabulary file must be readable on every executor.
    """
    kept = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    kind = kept.schema["doc_id"].dataType
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pool, made, rows = encoder(vocabulary), Pool(window), TaskContext.get().partitionId() << 32, []

        def add(sequence: list[tuple]) -> None:
            nonlocal made
            at = 0
            for doc, start, ids, tokens in sequence:
                rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), tokens, made, at))
                at += len(ids)
            made += 1

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names)

        for batch in batches:
            for part in chunks(batch):
                for doc, text in zip(part.column(0).cast(pa.string()).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.append(encode(text or ""), np.uint32(end))
                    full = len(ids) // window * window
                    for start in range(0, full, window):
                        add([(doc, start, ids[start : start + window], len(ids))])
                    if full < len(ids):
                        pool.put((doc, full, ids[full:].copy(), len(ids)))
                    if pool.size >= POOL:
                        for sequence in pool.fill(KEPT):
                            add(sequence)
                if rows:
                    yield out()
        for sequence in pool.fill(0):
            add(sequence)
        if rows:
            yield out()

    made = kept.mapInArrow(run, "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return made.withColumn("doc_id", F.col("doc_id").cast(kind))


def op12_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
