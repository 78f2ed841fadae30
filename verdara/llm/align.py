"""Alignment of two tokenizers, and document counts of the linked id pairs by minimal perfect hashing.

Both tokenizers split one text into tokens of known byte lengths. Byte offsets at which tokens of both end cut
the text into groups, and within a group every occurrence of an A token is linked with every occurrence of
a B token. How many documents hold an id pair linked is counted so:

1. A pass over the documents stores the ids of both tokenizers and, for each task, how many of its documents hold each pair.
2. The distinct pairs are cut by a hash into slices of about ``SLICE`` keys. For each slice a minimal perfect hash is
   built (levels of bit sets in which keys without a collision take a bit; the rest go to the next level), so that a
   key's place among the bits set is its index. An array of the keys by index verifies every hit.
3. Tasks add their counts to dense vectors indexed by the hash; the vectors of a slice are summed as a tree, ``ARITY`` at a time.
4. A second pass re-aligns the stored ids and looks the counts up, slice by slice; what slices give for a document is added.

A broadcast holds one slice, or one number for each A id; both have fixed bounds. Slices hold keys of a hash, so none is larger than
the others by more than chance. Neither a pass nor a group collects the pairs of the corpus.

Defined cases: null and empty texts, and texts whose tokens' bytes differ from a blank and the text, have zeros and an empty
``groups_sha256``; very long texts are aligned whole, and a group of many tokens is counted by its distinct ids
and multiplied in runs of bounded size; repeated rows are counted as documents of their own and get equal results; a null id keeps its row;
ties for the highest count are all best; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdara.llm.common import chunks, cut, mix64
from verdara.llm.packing import encoder

#: Distinct pairs of a slice; partial vectors summed at once; counts in a row of a stored vector.
SLICE, ARITY, PIECE = 1 << 21, 16, 1 << 16
#: Links worked on at once; pairs that a task gathers before it hands on their counts.
RUN, GATHERED = 1 << 20, 1 << 21


#: Bits that a pair of ids takes at most; the rest of a number holds a document of a run.
PAIR_BITS = 40


def pair_bits(b_size: np.ndarray) -> int:
    """Bits of a B id in a pair."""
    return max(1, (len(b_size) - 1).bit_length())


class Pieces:
    """Ids and bytes of a sentencepiece model."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.library.id_to_piece, range(n)))]
        self.size = np.fromiter(map(len, self.bytes_of), np.int64, n)


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


@lru_cache(2)
def lengths(path: str) -> np.ndarray:
    """Bytes of each A id."""
    of = encoder(path, False).bytes_of
    out = np.zeros(max(of) + 1, np.int64)
    out[list(of)] = [len(b) for b in of.values()]
    return out


@lru_cache(2)
def decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of each number below n, from the left, and how many they are."""
    text = np.arange(n).astype("S")
    width = np.char.str_len(text).astype(np.uint8)
    return text.view(np.uint8).reshape(n, -1), width


def tokenise(texts: list[str | None], a_path: str, b_path: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Ids of both tokenizers for each text, none where the tokens' bytes aren't those of a blank and the text."""
    a_model, a_size, b_model = encoder(a_path, False), lengths(a_path), pieces(b_path)
    none, a, b = np.empty(0, np.uint32), [], []
    for text, b_ids in zip(texts, b_model.library.encode([t or "" for t in texts], num_threads=1), strict=True):
        want = (" " + (text or "")).encode("utf-8", "replace")
        a_ids = a_model(" " + text) if text else none
        # Byte-level tokens are slices of the text, so as many bytes are the same bytes.
        same = bool(text) and int(a_size[a_ids].sum()) == len(want) and b"".join(map(b_model.bytes_of.__getitem__, b_ids)) == want
        a.append(a_ids if same else none)
        b.append(np.array(b_ids, np.uint32) if same else none)
    return a, b


class Aligned:
    """Groups of a run of documents: ``a, b`` ids, ``a_group, b_group`` numbers of their groups, ``doc`` of each group."""

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray], a_size: np.ndarray, b_size: np.ndarray) -> None:
        self.docs = len(a)
        self.n_a, self.n_b = np.fromiter(map(len, a), np.int64, len(a)), np.fromiter(map(len, b), np.int64, len(b))
        self.a, self.b = (np.concatenate(x) if x else np.empty(0, np.uint32) for x in (a, b))
        a_last, b_last = np.cumsum(a_size[self.a]) - 1, np.cumsum(b_size[self.b]) - 1  # documents have as many bytes of either
        both, ends = np.zeros((2, int(a_last[-1]) + 1 if len(a_last) else 0), bool)
        both[a_last], ends[b_last] = True, True
        both &= ends
        number = np.cumsum(both, dtype=np.int32)
        self.a_group, self.b_group = (number[last] - both[last] for last in (a_last, b_last))
        groups = int(number[-1]) if len(number) else 0
        self.doc = np.empty(groups, np.int64)
        self.doc[self.a_group] = np.repeat(np.arange(self.docs), self.n_a)
        self.in_a, self.in_b = np.bincount(self.a_group, minlength=groups), np.bincount(self.b_group, minlength=groups)
        self.n_groups = np.bincount(self.doc, minlength=self.docs)
        self.n_links = np.bincount(self.doc, self.in_a * self.in_b, minlength=self.docs).astype(np.int64)

    def links(self, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Runs of (document, pair of ids as one number, links): all links, those of large groups by distinct ids."""
        pair = lambda a, b: a.astype(np.int64) << bits | b
        first_a, first_b = np.cumsum(self.in_a) - self.in_a, np.cumsum(self.in_b) - self.in_b
        size = self.in_a * self.in_b
        small = np.flatnonzero(size <= RUN)
        ends = np.cumsum(size[small])
        start = 0
        while start < len(small):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + RUN, side="right")))
            of = small[start:stop]
            k = np.repeat(np.arange(len(of)), size[of])
            at = np.arange(len(k)) - np.repeat(np.cumsum(size[of]) - size[of], size[of])
            i, j = at // self.in_b[of][k], at % self.in_b[of][k]
            yield self.doc[of][k], pair(self.a[first_a[of][k] + i], self.b[first_b[of][k] + j]), np.ones(len(k), np.int64)
            start = stop
        for g in np.flatnonzero(size > RUN):
            a, n = np.unique(self.a[first_a[g] : first_a[g] + self.in_a[g]], return_counts=True)
            b, m = np.unique(self.b[first_b[g] : first_b[g] + self.in_b[g]], return_counts=True)
            rows = max(1, RUN // len(b))
            for s in range(0, len(a), rows):
                few = len(a[s : s + rows])
                yield np.full(few * len(b), self.doc[g]), pair(np.repeat(a[s : s + rows], len(b)), np.tile(b, few)), np.repeat(n[s : s + rows], len(b)) * np.tile(m, few)

    def digests(self, a_size: np.ndarray, b_size: np.ndarray) -> list[str]:
        """SHA-256 of each document's groups as ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
        n = len(self.a) + len(self.b)
        ids = np.empty(n, np.int64)
        before_a, before_b = np.cumsum(self.in_a), np.cumsum(self.in_b) - self.in_b
        ids[np.arange(len(self.a)) + before_b[self.a_group]], ids[np.arange(len(self.b)) + before_a[self.b_group]] = self.a, self.b
        mark = np.full(n, ord(","), np.uint8)
        mark[before_a + before_b - 1] = ord("|")
        mark[before_a + before_b + self.in_b - 1] = ord(";")
        digits, width = decimals(max(map(len, (a_size, b_size))))
        cells = np.empty((n, digits.shape[1] + 1), np.uint8)
        cells[:, :-1] = digits[ids]
        wide = width[ids]
        cells[np.arange(n), wide] = mark
        text = cells[np.arange(cells.shape[1], dtype=np.uint8) <= wide[:, None]]
        ends = np.cumsum(wide, dtype=np.int64) + np.arange(1, n + 1)
        stops = np.concatenate(([0], np.cumsum(self.n_a + self.n_b)))
        offset = np.concatenate(([0], ends))
        whole = text.tobytes()
        return [hashlib.sha256(whole[offset[i] : offset[j] - 1]).hexdigest() if j > i else "" for i, j in zip(stops[:-1], stops[1:], strict=True)]


def spread(keys: np.ndarray, seed: int) -> np.ndarray:
    return mix64(keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


class PerfectHash:
    """Minimal perfect hash of distinct keys. Other numbers may get any index, so hits have to be verified."""

    def __init__(self, keys: np.ndarray, spare: float = 1.5) -> None:
        self.levels, left, held = [], keys, 0
        while len(left) and len(self.levels) < 60:
            words = max(1, math.ceil(len(left) * spare / 64))
            at = (spread(left, len(self.levels)) % np.uint64(words * 64)).astype(np.int64)
            alone = np.bincount(at, minlength=words * 64) == 1
            bits = np.packbits(alone, bitorder="little").view(np.uint64)
            ones = np.bitwise_count(bits).astype(np.int64)
            self.levels.append((bits, held + np.cumsum(ones) - ones))
            held += int(ones.sum())
            left = left[~alone[at]]
        self.rest, self.size = np.sort(left), held + len(left)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.zeros(len(keys), np.int64), np.arange(len(keys))
        for level, (bits, before) in enumerate(self.levels):
            if not len(left):
                return out
            at = spread(keys[left], level) % np.uint64(len(bits) * 64)
            word, bit = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
            hit = (bits[word] & bit) != 0
            word, bit = word[hit], bit[hit]
            out[left[hit]] = before[word] + np.bitwise_count(bits[word] & (bit - np.uint64(1)))
            left = left[~hit]
        if len(self.rest):
            out[left] = self.size - len(self.rest) + np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
        return out


class Counts:
    """Documents of each pair of one slice: keys and counts by the index of the slice's hash."""

    def __init__(self, keys: np.ndarray) -> None:
        self.hash = PerfectHash(keys)
        self.keys = np.empty(len(keys), np.int64)
        self.keys[self.hash(keys)] = keys
        self.counts = np.zeros(len(keys), np.int64)

    def of(self, pairs: np.ndarray) -> np.ndarray:
        """Counts of pairs, 0 for those of other slices."""
        if not len(self.keys):
            return np.zeros(len(pairs), np.int64)
        at = self.hash(pairs)
        return np.where(self.keys[at] == pairs, self.counts[at], 0)


def added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their numbers."""
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


STORED = "row long, doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a binary, b binary, pair long, n long"


def store(docs: DataFrame, a_path: str, b_path: str, id_column: str, text_column: str) -> DataFrame:
    """The first pass: a row for each document with its ids, and rows ``pair, n`` with each task's counts of documents."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(STORED))
    kept = docs.select(F.col(id_column).cast("string").alias("doc_id"), F.col(text_column).cast("string").alias("text"))

    def rows(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_size, b_size = lengths(a_path), pieces(b_path).size
        bits, number, keys, counts = pair_bits(b_size), TaskContext.get().partitionId() << 33, np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            for part in chunks(batch):
                a, b = tokenise(part.column(1).to_pylist(), a_path, b_path)
                made = Aligned(a, b, a_size, b_size)
                seen = np.empty(0, np.int64)
                for doc, pairs, _ in made.links(bits):
                    seen = np.unique(np.concatenate((seen, doc << np.int64(PAIR_BITS) | pairs)))
                keys, counts = added(np.concatenate((keys, seen & ((1 << PAIR_BITS) - 1))), np.concatenate((counts, np.ones(len(seen), np.int64))))
                narrow = [[x.astype(np.uint16 if len(size) <= 1 << 16 else np.uint32).tobytes() for x in ids] for ids, size in ((a, a_size), (b, b_size))]
                yield rows(row=number + np.arange(part.num_rows), doc_id=part.column(0), n_a=made.n_a, n_b=made.n_b, n_groups=made.n_groups, n_links=made.n_links, groups_sha256=made.digests(a_size, b_size), a=narrow[0], b=narrow[1])
                number += part.num_rows
                if len(keys) > GATHERED:
                    yield rows(pair=keys, n=counts)
                    keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield rows(pair=keys, n=counts)

    return cut(kept.mapInArrow(run, STORED))


def tree_sum(partial: DataFrame, slice_: DataFrame, made: Counts, tasks: int) -> np.ndarray:
    """Counts of a slice by index: a dense vector for each task, in pieces, added ``ARITY`` at a time."""
    shared = partial.sparkSession.sparkContext.broadcast((made.hash, made.keys))

    def vector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_, keys = shared.value
        dense = np.zeros(-(-len(keys) // PIECE) * PIECE, np.int64)
        for batch in batches:
            pairs, n = (batch.column(k).to_numpy() for k in range(2))
            at = hash_(pairs)
            if (keys[at] != pairs).any():
                raise ValueError("a pair is missing from the hash of its slice")
            dense += np.bincount(at, n, len(dense)).astype(np.int64)
        if dense.any():
            parts = [x.tobytes() for x in dense.reshape(-1, PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts))), pa.array(np.full(len(parts), TaskContext.get().partitionId())), pa.array(parts)], ["piece", "branch", "data"])

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table["data"].to_pylist())
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int64()), "branch": pa.array([key[1].as_py()], pa.int64()), "data": [total.tobytes()]})

    vectors = slice_.mapInArrow(vector, "piece long, branch long, data binary")
    for _ in range(max(1, math.ceil(math.log(max(tasks, 2), ARITY)))):
        up = vectors.select("piece", F.floor(F.col("branch") / ARITY).alias("branch"), "data")
        vectors = up.groupBy("piece", "branch").applyInArrow(add, "piece long, branch long, data binary")
    out = np.zeros(-(-len(made.keys) // PIECE) * PIECE, np.int64)
    for r in vectors.toArrow().to_pylist():
        out[r["piece"] * PIECE : (r["piece"] + 1) * PIECE] += np.frombuffer(r["data"], np.int64)
    shared.destroy()
    return out[: len(made.keys)]


def align(docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row; see the module.

    Both vocabulary files must be readable on every executor.
    """
    context, kind = docs.sparkSession.sparkContext, docs.schema[id_column].dataType
    stored = store(docs, a_path, b_path, id_column, text_column)
    partial = stored.where("pair IS NOT NULL").select("pair", "n")
    keys = cut(partial.select("pair").distinct())
    slices = max(1, math.ceil(keys.count() / SLICE))
    of_slice = F.pmod(F.xxhash64("pair"), F.lit(slices))
    best, shared = np.zeros(len(lengths(a_path)), np.int64), []
    bits = pair_bits(pieces(b_path).size)
    tasks = partial.rdd.getNumPartitions()
    for s in range(slices):
        made = Counts(keys.where(of_slice == s).toArrow()["pair"].to_numpy().copy())
        made.counts = tree_sum(partial, partial.where(of_slice == s), made, tasks)
        np.maximum.at(best, made.keys >> bits, made.counts)
        shared.append(context.broadcast(made))
    best_of_a = context.broadcast(best)

    def look_up(slice_counts):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a_size, b_size, counts, highest = lengths(a_path), pieces(b_path).size, slice_counts.value, best_of_a.value
            for batch in batches:
                for part in chunks(batch, "a"):
                    ids = [[np.frombuffer(x, np.uint16 if len(size) <= 1 << 16 else np.uint32) for x in part.column(name).to_pylist()] for name, size in (("a", a_size), ("b", b_size))]
                    n_best, total = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
                    for doc, pairs, links in Aligned(*ids, a_size, b_size).links(bits):
                        n = counts.of(pairs)
                        np.add.at(total, doc, n * links)
                        np.add.at(n_best, doc, np.where((n > 0) & (n == highest[pairs >> bits]), links, 0))
                    yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(n_best), pa.array(total)], [*part.schema.names[:-2], "n_best", "count_sum"])

        return run

    plain = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    tokens = stored.where("row IS NOT NULL").select(*plain, "a", "b")
    out = "row long, doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    done = [tokens.mapInArrow(look_up(one), out) for one in shared]
    whole = done[0]
    if len(done) > 1:
        for more in done[1:]:
            whole = whole.unionByName(more)
        whole = whole.groupBy(*plain).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return whole.select(F.col("doc_id").cast(kind).alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
