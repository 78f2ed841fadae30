"""Shared pieces of the training-data operators."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handed to numpy at once inside a task; bounds a worker's memory whatever the batch size.
CHUNK_BYTES = 2 << 20


def cut(df: DataFrame) -> DataFrame:
    """Run ``df`` once and cut its lineage: write it as a table in the shared folder and read it back.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset (tests, one
    machine) a temporary folder is used. Unlike checkpoint(), this computes the rows only once.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="spark-tables-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.table_path = path
    return made


def discard(df: DataFrame) -> None:
    """Delete a table written by ``cut`` once everything made from it is itself written."""
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(df.table_path)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of results that are written and no longer referred to.

    The context cleaner follows the driver's garbage collection, which Spark itself only asks for
    every half hour (spark.cleaner.periodicGC.interval).
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def parts_of(df: DataFrame) -> int:
    """Number of parts in which packed rows are dealt: the session's shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dealt(packed: DataFrame) -> DataFrame:
    """Rows with an int column ``part`` sent to the partition of that number, so parts of equal size load tasks equally."""
    return packed.repartitionById(parts_of(packed), F.col("part"))


#: Bits of the membership filter: its size is fixed, whatever the number of members.
FILTER_BITS = 1 << 25


def only_members(rows: DataFrame, members: DataFrame, key: str, others: bool = False) -> DataFrame:
    """``rows`` without most of those whose long ``key`` is not in ``members``; no member is lost.

    With ``others``, exactly the rows that the call without it leaves out.

    A Bloom filter of fixed size is broadcast, so a following join shuffles little more than the
    rows it needs. With very many members the filter passes more rows, never fewer. Only places in the
    filter go to Python; the rows, texts included, stay in Spark.
    """
    spots = [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(FILTER_BITS)) for i in range(3)]
    bit = F.explode(F.array(*spots))
    words = members.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word"))
    found = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(FILTER_BITS >> 6, np.uint64)
    bitmap[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)

    @F.arrow_udf("boolean")
    def inside(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        keep = np.ones(len(a), bool)
        for spot in (a, b, c):
            at = spot.to_numpy(zero_copy_only=False).astype(np.uint64)
            keep &= (shared.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return pa.array(keep)

    found = inside(*spots)
    return rows.where(~found if others else found)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids get -1, which no fold has."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n, F.lit(-1))


def row_key() -> Column:
    """Identity of a document row: equal for repeated rows, defined for null ids and texts."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def words_of(text: str | None) -> list[bytes]:
    """Words of the contracts, ``[^\\x20\\x09-\\x0D]+`` of the unchanged text, as UTF-8."""
    return text.encode("utf-8", "replace").split() if text else []


def lower_words_of(text: str | None) -> list[bytes]:
    """The same words with A-Z lower-cased (bytes.lower touches ASCII only)."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each (a longer text is its own slice)."""
    size = batch.num_rows
    if not size:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    ends = np.cumsum(lengths.to_numpy(zero_copy_only=False))
    start = 0
    while start < size:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """Invertible 64-bit finaliser, used wherever a well-spread hash of a number is needed."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHasher:
    """64-bit hashes of words with a bounded cache; equal in every process."""

    def __init__(self, limit: int = 200_000) -> None:
        self.limit = limit
        self.cache: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        cache, digest = self.cache, xxhash.xxh3_64_intdigest
        try:
            return np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))
        except KeyError:
            pass
        if len(cache) > self.limit:
            cache.clear()
        for word in set(words).difference(cache):
            cache[word] = digest(word)
        return np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive words; depends on the n words and their order only."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[k : len(hashes) - n + 1 + k]
        out ^= out >> np.uint64(29)
    return mix64(out)


LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    return bool(text) and LETTER.search(text) is not None and any(m.group().isalpha() for m in LETTER.finditer(text))
