"""BPE encoding and decoding with a pair occurrence index.

Pretokens of a batch are laid out once as one array of symbols. An index maps every adjacent
pair that has a merge rank to all its positions; ranks are taken in ascending order from a
heap, each merge is applied to all its positions at once, and the pairs around them move to
the lists of their new ranks. Because a token is only ever made by a merge of lower rank than
the merges that use it, one ascending sweep gives the same result as merging word by word.

Nulls and empty texts give no ids and decode to the empty text; repeated rows are repeated in
the result; other input columns are ignored. Texts are processed whole, one row per input row.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdara.llm.common import chunks

#: Pretokens kept per worker between batches.
CACHE = 120_000

# Fixed values of the published byte-level pretokeniser.
CONTRACTIONS = r"'s|'t|'re|'ve|'m|'ll|'d"
#: Texts in this range have letters, digits and blanks that plain character classes name exactly.
PLAIN = re.compile("[^\x00-\x7fÀ-ÖØ-öø-ſ]")
LATIN = "A-Za-zÀ-ÖØ-öø-ſ"
FAST = re.compile(rf"{CONTRACTIONS}| ?[{LATIN}]+| ?[0-9]+| ?[^\t-\r {LATIN}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


@lru_cache(1)
def _general():
    import regex

    s = r"\p{White_Space}"
    return regex.compile(rf"{CONTRACTIONS}| ?\p{{L}}+| ?\p{{N}}+| ?[^{s}\p{{L}}\p{{N}}]+|{s}+(?![^{s}])|{s}+")


def pretokens(text: str) -> list[str]:
    return (_general() if PLAIN.search(text) else FAST).findall(text)


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte in byte-level vocabularies, by its published rule."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairIndexBPE:
    """Vocabulary and merges of a byte-level tokenizer file, held once per worker."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        as_byte = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(as_byte[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.byte_id = np.zeros(256, np.int64)
        for c, b in as_byte.items():
            self.byte_id[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        codes = self.left << 32 | self.right
        self.order = np.argsort(codes, kind="stable")
        self.codes = codes[self.order]
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.clear()

    def clear(self) -> None:
        """Start the worker's table of pretokens anew; special tokens are keyed by their id."""
        ids = sorted(self.special.values())
        self.slot: dict = {i: k for k, i in enumerate(ids)}
        self.flat, self.count, self.begin = np.array(ids, np.int32), np.ones(len(ids), np.int64), np.arange(len(ids))

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, -1 where there is none."""
        code = a << 32 | b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.order[at], -1)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pretokens in one array and the number of ids of each, by one ascending sweep over the ranks present."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbol = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        n = len(symbol)
        if not n:
            return np.empty(0, np.int32), lengths
        starts = np.cumsum(lengths) - lengths
        after = np.arange(1, n + 1)
        before = np.arange(-1, n - 1)
        after[starts + lengths - 1] = -1
        before[starts] = -1
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(positions: np.ndarray) -> None:
            rank = self.ranks(symbol[positions], symbol[after[positions]])
            known = rank >= 0
            rank, positions = rank[known], positions[known]
            if not len(rank):
                return
            by = np.argsort(rank, kind="stable")
            rank, positions = rank[by], positions[by]
            bounds = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(rank)]
            for i, j in zip(bounds, bounds[1:]):
                r = int(rank[i])
                if r in index:
                    index[r].append(positions[i:j])
                else:
                    index[r] = [positions[i:j]]
                    heapq.heappush(heap, r)

        add(np.flatnonzero(after >= 0))
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            a, b = self.left[r], self.right[r]
            follow = after[at]
            at = at[(symbol[at] == a) & (follow >= 0) & (symbol[follow] == b)]
            if not len(at):
                continue
            if len(lists) > 1:  # a position can be in several lists
                at = _distinct(at)
            if a == b and len(at) > 1:  # runs such as aaa: take every other position from the left
                at = _distinct(at)
                fresh = np.ones(len(at), bool)
                fresh[1:] = after[at[:-1]] != at[1:]
                begin = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - begin) % 2 == 0]
            gone = after[at]
            beyond = after[gone]
            symbol[at] = self.made[r]
            symbol[gone] = -1
            after[at] = beyond
            tail = beyond >= 0
            before[beyond[tail]] = at[tail]
            head = before[at]
            add(_distinct(np.concatenate((head[head >= 0], at[tail]))))
        alive = symbol >= 0
        return symbol[alive].astype(np.int32), np.add.reduceat(alive, starts, dtype=np.int64)

    def learn(self, words: list[str]) -> None:
        """Append the ids of pretokens not seen before to the worker's table."""
        ids, counts = self.merge([w.encode("utf-8", "replace") for w in words])
        begin = len(self.flat) + np.cumsum(counts) - counts
        self.slot.update(zip(words, range(len(self.count), len(self.count) + len(words)), strict=True))
        self.flat, self.count, self.begin = np.concatenate((self.flat, ids)), np.concatenate((self.count, counts)), np.concatenate((self.begin, begin))

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's ids end."""
        if len(self.slot) > CACHE:
            self.clear()
        pieces: list = []
        sizes = []
        for text in texts:
            had = len(pieces)
            for part in self.split.split(text or "") if self.split else [text or ""]:
                if part in self.special:
                    pieces.append(self.special[part])
                elif part:
                    pieces += pretokens(part)
            sizes.append(len(pieces) - had)
        if new := set(pieces).difference(self.slot):
            self.learn(list(new))
        slots = np.fromiter(map(self.slot.__getitem__, pieces), np.int64, len(pieces))
        counts = self.count[slots]
        ends = np.cumsum(counts)
        ids = self.flat[np.repeat(self.begin[slots] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate(([0], ends))[np.cumsum(sizes)]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; np.unique without its overhead on short arrays."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) > 1 else x


@lru_cache(2)
def _tokenizer(path: str) -> PairIndexBPE:
    return PairIndexBPE(path)


def encode_decode(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, ids array<int>, decoded string`` of every row, by the vocabulary file at ``vocabulary``.

    The file is a parameter and must be readable on every executor.
    """
    kept = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    out = pa.schema([("doc_id", pa.string()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
    id_type = kept.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _tokenizer(vocabulary)
        for batch in batches:
            for part in chunks(batch, limit=3 << 20):
                flat, ends = model.encode_batch(part.column(1).to_pylist())
                bounds = np.concatenate(([0], ends)).astype(np.int32)
                decoded = [model.decode(flat[i:j]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
                ids = pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), ids, pa.array(decoded, pa.string())], schema=out)

    made = kept.mapInArrow(run, "doc_id string, ids array<int>, decoded string")
    return made.withColumn("doc_id", F.col("doc_id").cast(id_type))


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    done = encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return digests(done)


def digests(done: DataFrame) -> DataFrame:
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
