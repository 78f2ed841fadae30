"""Embedding near-duplicates by collision-counting projections.

Vectors are projected on many random directions. Counting, for all pairs, how often one vector lies
in the window centred at the other's sorted projection is quadratic in the number of vectors, since
each one-dimensional window holds a fixed share of all of them (a quarter at cosine 0.9). So the
method has a first level: the signs of further projections of the same kind form tables of cells, enough tables that a pair at the
threshold shares a cell with the wanted recall. Inside a cell the projections are sorted, the
query-centred windows counted per pair, and pairs whose count passes a threshold calibrated for the
same recall are verified by their cosine in double precision. Equal vectors are one class with a
weight, and only classes are compared. A pair is counted in the first table
whose cell it shares, so counts of links need no list of pairs; only spanning edges leave a task.

Cells beyond ``BLOCK`` rows are cut into blocks and worked on by pairs of blocks, so no task holds
more than two blocks of a cell, however many vectors are nearly equal.

Defined cases: vectors that are null, empty, zero or hold nulls or non-finite components link with
nothing and are their own component; vectors of different lengths are never compared; rows equal in
id and vector are one vector and get the same result; ties in a projection keep any order, windows being
closed; a null id never names a component that has
another id; labels and other columns are not read. Only pairs verified at the threshold are links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdara.llm.common import cut
from verdara.llm.components import connected
from verdara.llm.ngram_join import spanning

BLOCK, CELL_ROWS, COUNTED = 256, 128, 24


def plan(n: int, cosine: float, recall: float) -> tuple[int, int]:
    """Signs per cell key and number of tables for n vectors."""
    bits = max(1, min(24, round(math.log2(max(2, n) / CELL_ROWS))))
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def calibrated(cosine: float, recall: float) -> tuple[float, int]:
    """Window half-width and the count that pairs at the threshold reach with the wanted probability."""
    width = math.sqrt(2 - 2 * cosine)  # one standard deviation of the difference of their projections
    inside = math.erf(1 / math.sqrt(2))
    tail = 0.0
    for count in range(COUNTED + 1):
        tail += math.comb(COUNTED, count) * inside**count * (1 - inside) ** (COUNTED - count)
        if tail > 1 - recall:
            return width, count
    return width, COUNTED


@lru_cache(8)
def directions(dim: int, n: int) -> np.ndarray:
    return np.random.default_rng([dim, 20]).standard_normal((dim, n))


def cells(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Cell of every vector in every table."""
    signs = unit @ directions(unit.shape[1], bits * tables) > 0
    return signs.reshape(len(unit), tables, bits) @ (1 << np.arange(bits))


def passing(unit: np.ndarray, width: float, least: int) -> np.ndarray:
    """Pairs (i < j) that share at least ``least`` query-centred windows over the sorted projections."""
    n = len(unit)
    count = np.zeros(n * n, np.int64)
    for values in (unit @ directions(unit.shape[1], COUNTED)).T:
        order = np.argsort(values)
        ordered = values[order]
        first, last = np.searchsorted(ordered, values - width), np.searchsorted(ordered, values + width, side="right")
        size = last - first
        at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
        count += np.bincount(np.repeat(np.arange(n), size) * n + order[at], minlength=n * n)
    return np.argwhere(np.triu(count.reshape(n, n) >= least, 1))


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, recall: float = 0.995) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors(vec_id, embedding)``."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).withColumn("key", F.xxhash64("vec_id", "embedding"))
    sound = F.exists("embedding", lambda x: x != 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    usable = rows.where("embedding IS NOT NULL").where(sound).dropDuplicates(["key"]).withColumn("class", F.xxhash64("embedding"))
    usable = cut(usable.groupBy(F.col("class").alias("key")).agg(F.count("*").alias("weight"), F.first("embedding").alias("embedding")))
    bits, tables = plan(usable.count(), cosine, recall)
    width, least = calibrated(cosine, recall)

    def unit_rows(embedding: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter((len(v) for v in embedding), np.int64, len(embedding))
        return sizes, embedding.flatten().to_numpy(zero_copy_only=False).astype(np.float64)

    def normed(x: np.ndarray) -> np.ndarray:
        x = x / np.abs(x).max(1, keepdims=True)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, flat = unit_rows(batch.column(1))
            ends = np.cumsum(sizes)
            for dim in np.unique(sizes):
                of = np.flatnonzero(sizes == dim)
                at = cells(normed(flat[(ends[of] - dim)[:, None] + np.arange(dim)]), bits, tables)
                name = (np.arange(tables) << np.int64(40)) + (np.int64(dim) << 24) + at
                keys = np.repeat(batch.column(0).to_numpy(zero_copy_only=False)[of], tables)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(name.ravel().astype(np.int64))], ["key", "cell"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []

        def work() -> Iterator[pa.RecordBatch]:
            cell, i, j = unit
            raw = np.array([v for *_, v in held], np.float64)
            keys, block, weight = (np.array([row[k] for row in held], np.int64) for k in range(3))
            x = normed(raw)
            pairs = passing(x, width, least)
            if i != j:
                pairs = pairs[block[pairs[:, 0]] != block[pairs[:, 1]]]
            if not len(pairs):
                return
            a, b = pairs.T
            close = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
            a, b = a[close], b[close]
            table, at = cell >> 40, cells(x, bits, tables)
            new = ~(at[a, :table] == at[b, :table]).any(1)
            a, b = a[new], b[new]
            if not len(a):
                return
            links = np.bincount(np.concatenate((a, b)), weight[np.concatenate((b, a))], len(keys)).astype(np.int64)
            some = np.flatnonzero(links)
            edges = np.array(spanning(list(zip(a.tolist(), b.tolist(), strict=True)), len(keys)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((keys[some], keys[edges[:, 0]]))), pa.array([None] * len(some) + keys[edges[:, 1]].tolist(), pa.int64()), pa.array(np.concatenate((links[some], np.zeros(len(edges), np.int64))))],
                ["a", "b", "n"],
            )

        for batch in batches:
            for cell, i, j, key, block, weight, vector in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
                if (cell, i, j) != unit:
                    if len(held) > 1:
                        yield from work()
                    unit, held = (cell, i, j), []
                held.append((key, block, weight, vector))
        if len(held) > 1:
            yield from work()

    placed = cut(usable.select("key", "embedding").mapInArrow(place, "key long, cell long"))
    crowd = placed.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int")
    spread = placed.join(crowd, "cell").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("key", F.lit(5)), F.col("blocks")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "key", "block")
    units = spread.join(usable, "key").select("cell", "i", "j", "key", "block", "weight", "embedding").repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    found = cut(units.mapInArrow(compare, "a long, b long, n long"))
    links = found.groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n_links"))
    label = connected(found.where("b IS NOT NULL").select("a", "b"))
    of_class = usable.select("key", "weight").join(links, "key", "left").join(label.withColumnRenamed("node", "key"), "key", "left")
    of_class = of_class.select(F.col("key").alias("class"), (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("label", "key").alias("label"))
    flat = rows.withColumn("class", F.when(F.col("embedding").isNotNull() & sound, F.xxhash64("embedding"))).select("vec_id", "key", "class")
    flat = flat.join(of_class, "class", "left").withColumn("label", F.coalesce("label", F.xxhash64("key", F.lit("alone"))))
    least_id = flat.groupBy("label").agg(F.min("vec_id").alias("component_id"))
    made = flat.join(least_id, "label").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id")
    return made.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op9_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
