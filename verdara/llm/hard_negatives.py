"""Hard negatives from Hilbert-ordered blocks with zone maps.

Vectors are scaled to whole numbers and ordered by label and by their place on a Hilbert curve over
the dimensions of largest spread. Runs of at most ``BLOCK`` rows in this order are stored as the rows
of a Parquet table, each with the minimum and maximum of every dimension and of the labels: its zone
map. Zones of blocks are merged into zones of larger nodes, up to a few roots. The anchors of a
block descend these nodes together: interval arithmetic on the anchors' zone and a node's zone bounds
every inner product between them, and only children of nodes that can still hold a wanted score are
looked at. Inside a block that is read, the same bound is taken for each anchor on its own.

Two descents are made. The first looks for positives; it starts from the score of each anchor's
last wanted positive within its own block, so blocks that can't reach that score aren't read. The second looks
for negatives inside the windows of scores that the positives open. Both compare an anchor with rows of a
block by one matrix product, exact in whole numbers; only the best rows of a block leave the task.

Blocks travel once per slice of anchors, anchors travel to the blocks that they read; no table is collected or
broadcast, and no task holds more than one block and a batch of anchors. Equal vectors, however many,
fill blocks like any others and are told apart by id.

Defined cases: rows with a null id, label or vector, or a null or non-finite component (256-fold included) take
no part; of several rows with one id, the one of least label, then of least vector, counts; vectors of
different lengths are never compared; an anchor without a positive, or a positive with an empty window (all
with a negative score), gives no row; ties go to the smaller id; other columns are not read; an empty table gives no row.
Scores are exact; those beyond 64 bits count as the nearest 64-bit number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdara.llm.common import cut

#: Rows of a block; children of a node; blocks written by a task; writing tasks whose anchors form a slice; dimensions and bits of the curve.
BLOCK, FANOUT, PER_TASK, SLICE = 2048, 32, 4, 50
CURVE_DIMS, CURVE_BITS = 8, 7
#: Sums of products of whole numbers are exact in double precision below this; scores lie within these bounds.
EXACT, LARGEST = float(1 << 53), (1 << 63) - 1
#: Widens bounds by more than rounding can take from them.
SLACK = 1e-12

ROWS = "vec_id long, label long, vector array<double>"


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with ``cells`` (rows by dimensions) of ``bits`` bits each, by Skilling's transform."""
    x = cells.T.astype(np.uint64).copy()
    n, one = len(x), np.uint64(1)
    q = one << np.uint64(bits - 1)
    while q > one:
        p = q - one
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= one
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), one << np.uint64(bits - 1)
    while q > one:
        turn ^= np.where((x[n - 1] & q) != 0, q - one, np.uint64(0))
        q >>= one
    x ^= turn
    key = np.zeros(cells.shape[0], np.uint64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << one | (x[i] >> np.uint64(bit) & one)
    return key.astype(np.int64)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def usable(vectors: DataFrame, relabel: bool) -> DataFrame:
    """One row per id with the whole-number vector; see the module for the rows left out."""
    x = F.col("embedding").cast("array<double>")
    label = F.when((F.col("vec_id") % 7 == 0) & F.lit(relabel), (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.transform(x, lambda v: v * 256).alias("vector"))
    sound = ~F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").where(sound)
    least = rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("least")).select("vec_id", "least.*")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # floor() of Spark fails beyond 64 bits
        for batch in batches:
            column = batch.column(2)
            ends = np.concatenate(([0], np.cumsum(pc.list_value_length(column)))).astype(np.int32)
            flat = np.floor(column.flatten().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["vec_id", "label", "vector"])

    return least.mapInArrow(whole, ROWS)


def by_length(batch: pa.RecordBatch, column: str = "vector") -> Iterator[tuple[int, pa.RecordBatch]]:
    """Parts of a batch whose vectors have equal length."""
    sizes = pc.list_value_length(batch.column(column)).to_numpy()
    for dim in np.unique(sizes):
        yield int(dim), batch.filter(pa.array(sizes == dim))


def spreads(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of vector: dimensions of largest spread, their minimum and maximum; from all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in by_length(batch):
                x = matrix(part.column(2), dim)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(dim, dim)), pa.array(np.arange(dim)), pa.array(np.full(dim, len(x))), pa.array(x.min(0)), pa.array(x.max(0)), pa.array(x.sum(0)), pa.array((x * x).sum(0))],
                    ["dim", "i", "n", "low", "high", "s", "ss"],
                )

    each = rows.mapInArrow(count, "dim long, i long, n long, low double, high double, s double, ss double")
    spread = F.sum("ss") / F.sum("n") - F.pow(F.sum("s") / F.sum("n"), 2)
    total = each.groupBy("dim", "i").agg(F.min("low").alias("low"), F.max("high").alias("high"), spread.alias("spread"))
    first = Window.partitionBy("dim").orderBy(F.desc("spread"), "i")
    kept = total.withColumn("place", F.row_number().over(first)).where(F.col("place") <= CURVE_DIMS).orderBy("dim", "place").toPandas()
    return {int(dim): tuple(part[c].to_numpy() for c in ("i", "low", "high")) for dim, part in kept.groupby("dim")}


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


BLOCKS = """block long, node long, dim int, n long, ids binary, labels binary, data binary, low array<double>, high array<double>,
 label_low long, label_high long, anchors long, a_ids binary, a_labels binary, a_data binary, a_least binary, a_low array<double>, a_high array<double>, a_label_low long, a_label_high long, floor double"""


def write_blocks(rows: DataFrame, every: int, wanted: int, block: int = BLOCK) -> DataFrame:
    """The stored table of blocks in curve order, with their zone maps and the anchors that lie in them."""
    places = spreads(rows)

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in by_length(batch):
                at = np.zeros(part.num_rows, np.int64)
                if dim:
                    i, low, high = places[dim]
                    x, width = matrix(part.column(2), dim)[:, i], np.where(high > low, high - low, 1.0)
                    at = hilbert(np.clip((x - low) / width * (1 << CURVE_BITS), 0, (1 << CURVE_BITS) - 1), CURVE_BITS)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(part.num_rows, dim, np.int32)), pa.array(at)], ["vec_id", "label", "vector", "dim", "at"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def close(part: pa.Table) -> pa.RecordBatch:
            part = part.sort_by("vec_id")  # inside a block, ties in score are then settled by place
            dim = part["dim"][0].as_py()
            ids, labels, x = part["vec_id"].to_numpy(), part["label"].to_numpy(), matrix(part["vector"].combine_chunks(), dim)
            a = np.flatnonzero(ids % every == 0)
            least = np.full(len(a), -np.inf)
            for k, best in enumerate(nearest(x[a], labels[a], ids[a], x, labels, ids, wanted)):
                if len(best) == wanted:
                    least[k] = float(best[-1][0])
            zone = lambda m: (m.min(0).tolist(), m.max(0).tolist()) if len(m) else (None, None)
            span = lambda v: (int(v.min()), int(v.max())) if len(v) else (None, None)
            values = [task << 32 | made, task, dim, len(ids), ids.tobytes(), labels.tobytes(), x.tobytes(), *zone(x), *span(labels), len(a), ids[a].tobytes(), labels[a].tobytes(), x[a].tobytes(), least.tobytes(), *zone(x[a]), *span(labels[a]), float(least.min()) if len(a) else None]
            return pa.RecordBatch.from_arrays([pa.array([v], field.type) for v, field in zip(values, schema, strict=True)], schema=schema)

        def ready(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, made
            table = pa.Table.from_batches(held)
            dims = table["dim"].to_numpy()
            start = 0
            while start < len(dims):
                stop = min(start + block, start + int(np.searchsorted(dims[start:], dims[start], side="right")))
                if stop == len(dims) and stop - start < block and not last:
                    break
                yield close(table.slice(start, stop - start))
                made += 1
                start = stop
            held = table.slice(start).to_batches()

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= block:
                yield from ready(False)
        if held and sum(b.num_rows for b in held):
            yield from ready(True)

    schema = arrow_schema(BLOCKS)
    placed = cut(rows.mapInArrow(order, f"{ROWS}, dim int, at long"))
    parts = max(1, -(-placed.count() // (block * PER_TASK)))
    keys = ["dim", "label", "at", "vec_id"]
    return cut(placed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(pack, BLOCKS))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows: in doubles where these are exact, else in Python integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in row] for row in m], object)
    return np.clip(whole(a) @ whole(b).T, -LARGEST, LARGEST).astype(np.int64)


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each row of ``a`` with any vector inside the zone, widened by what rounding may take."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    slack = SLACK * (np.abs(a) @ np.maximum(np.abs(low), np.abs(high)))
    return up @ low + down @ high - slack, up @ high + down @ low + slack


def nearest(a: np.ndarray, a_labels: np.ndarray, a_ids: np.ndarray, x: np.ndarray, labels: np.ndarray, ids: np.ndarray, wanted: int) -> Iterator[list[tuple[int, int]]]:
    """For each anchor its best ``wanted`` other rows of the same label as (score, id); ``ids`` ascend."""
    scores = products(a, x)
    for k in range(len(a)):
        of = np.flatnonzero((labels == a_labels[k]) & (ids != a_ids[k]))
        s = scores[k][of]
        best = np.argsort(-s, kind="stable")[:wanted]
        yield list(zip(s[best].tolist(), ids[of[best]].tolist(), strict=True))


def within(a: np.ndarray, a_labels: np.ndarray, windows: list[list[int]], x: np.ndarray, labels: np.ndarray, ids: np.ndarray, wanted: int, percent: int) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """For each anchor and positive score the best ``wanted`` rows of another label in its window; ``ids`` ascend."""
    scores = products(a, x)
    for k in range(len(a)):
        floor = lambda score: -(-percent * score // 100)  # noqa: E731  least whole score of the window
        s = scores[k]
        of = np.flatnonzero((labels != a_labels[k]) & (s >= min(map(floor, windows[k]))) & (s <= max(windows[k])))
        of = of[np.argsort(-s[of], kind="stable")]
        falling = -s[of]
        for top in windows[k]:
            first = int(np.searchsorted(falling, -top))
            last = min(first + wanted, int(np.searchsorted(falling, -floor(top), side="right")))
            if first < last:
                yield k, top, list(zip(s[of[first:last]].tolist(), ids[of[first:last]].tolist(), strict=True))


ZONE = "id long, up long, dim int, low array<double>, high array<double>, label_low long, label_high long"


def zones(blocks: DataFrame) -> tuple[list[DataFrame], int]:
    """Zones of blocks and, level by level, of the nodes above them, and the number of the last root."""
    levels = [blocks.select(F.col("block").alias("id"), F.col("node").alias("up"), "dim", "low", "high", "label_low", "label_high")]
    last, shape = int(blocks.agg(F.max("node")).first()[0] or 0), arrow_schema(ZONE)

    def merged(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:  # the blocks of one writing task, or FANOUT nodes
        rows = table.to_pylist()
        low, high = np.min([r["low"] for r in rows], 0).tolist(), np.max([r["high"] for r in rows], 0).tolist()
        value = [key[0].as_py(), key[0].as_py() // FANOUT, key[1].as_py(), low, high, min(r["label_low"] for r in rows), max(r["label_high"] for r in rows)]
        return pa.table([pa.array([v], field.type) for v, field in zip(value, shape, strict=True)], schema=shape)

    while True:
        levels.append(cut(levels[-1].groupBy("up", "dim").applyInArrow(merged, ZONE)))
        if last < FANOUT:
            return levels, last
        last //= FANOUT


def descend(groups: DataFrame, levels: list[DataFrame], last: int, positives: bool) -> DataFrame:
    """``block, home`` of every block that the anchors of a group ``home`` must read.

    ``groups(home, dim, a_low, a_high, a_label_low, a_label_high, floor, ceiling)``. A group asks only for
    children of the nodes that interval arithmetic can't rule out.
    """

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for r in batch.to_pylist():
                a_low, a_high, low, high = (np.asarray(r[c]) for c in ("a_low", "a_high", "low", "high"))
                four = np.stack([a_low * low, a_low * high, a_high * low, a_high * high])
                slack = SLACK * np.abs(four).max(0).sum()
                if positives:
                    fits = r["label_low"] <= r["a_label_high"] and r["a_label_low"] <= r["label_high"]
                else:
                    fits = not r["label_low"] == r["label_high"] == r["a_label_low"] == r["a_label_high"]
                keep.append(bool(fits and four.max(0).sum() + slack >= r["floor"] and four.min(0).sum() - slack <= r["ceiling"]))
            yield batch.select([0, 1, 2]).filter(pa.array(keep, pa.bool_()))

    asked = groups.select("home", "dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))).alias("at"))
    for depth in range(len(levels) - 1, -1, -1):
        met = asked.join(groups, ["home", "dim"]).join(levels[depth].withColumnRenamed("id", "at").drop("up"), ["at", "dim"])
        asked = met.select("home", "dim", "at", *(c for c in met.columns if c not in ("home", "dim", "at"))).mapInArrow(possible, "home long, dim int, at long")
        if depth:
            below = levels[depth - 1].select(F.col("up").alias("at"), "dim", F.col("id").alias("child"))
            asked = asked.join(below, ["at", "dim"]).select("home", "dim", F.col("child").alias("at"))
    return asked.select(F.col("at").alias("block"), "home")


UNIT = "block long, slice long, home long, dim int, ids binary, labels binary, data binary, low array<double>, high array<double>, a_ids binary, a_labels binary, a_data binary, a_least binary, windows array<array<long>>"


def read_units(asked: DataFrame, blocks: DataFrame, groups: DataFrame, work, result: str) -> DataFrame:
    """Every asked-for block once per slice, followed by the groups of anchors that read it; ``work`` gives their rows."""
    # Anchors that lie near each other form a slice, so a block that all anchors read is read by one task for each slice.
    asked = asked.withColumn("slice", F.floor(F.shiftright("home", 32) / SLICE))
    visits = asked.join(groups.select("home", "dim", "a_ids", "a_labels", "a_data", "a_least", "windows"), "home")
    shared = asked.select("block", "slice").distinct().join(blocks.select("block", "dim", "ids", "labels", "data", "low", "high"), "block")
    fields = [f.split() for f in UNIT.split(", ")]
    shape = lambda df: df.select(*(F.col(n) if n in df.columns else F.lit(None).cast(t).alias(n) for n, t in fields))
    stream = shape(shared.withColumn("home", F.lit(-1).cast("long"))).unionByName(shape(visits))
    stream = stream.repartition("block", "slice").sortWithinPartitions("block", "slice", "home")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, x = None, None
        for batch in batches:
            for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                if r["home"] == -1:
                    at = (r["block"], r["slice"])
                    x = np.frombuffer(r["data"]).reshape(-1, r["dim"]) if r["dim"] else np.zeros((len(r["ids"]) // 8, 0))
                    ids, labels, low, high = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64), np.asarray(r["low"]), np.asarray(r["high"])
                    continue
                assert at == (r["block"], r["slice"])
                a_ids, a_labels = np.frombuffer(r["a_ids"], np.int64), np.frombuffer(r["a_labels"], np.int64)
                a = np.frombuffer(r["a_data"]).reshape(-1, r["dim"]) if r["dim"] else np.zeros((len(a_ids), 0))
                made = work(a_ids, a_labels, a, np.frombuffer(r["a_least"]), r["windows"], x, labels, ids, *bounds(a, low, high))
                if made is not None:
                    yield made

    return stream.mapInArrow(run, result)


def mine(vectors: DataFrame, every: int = 100, wanted: int = 5, percent: int = 80, relabel: bool = True, block: int = BLOCK) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``; see the module.

    Anchors are rows whose id is divisible by ``every``; ``wanted`` positives each and ``wanted`` negatives a positive, whose score
    is at least ``percent`` per cent of the positive's and at most equal to it.
    """
    blocks = write_blocks(usable(vectors, relabel), every, wanted, block)
    levels, last = zones(blocks)
    held = blocks.where("anchors > 0").withColumnRenamed("block", "home").withColumn("ceiling", F.lit(float("inf"))).withColumn("windows", F.lit(None).cast("array<array<long>>"))
    bounded = ["home", "dim", "a_low", "a_high", "a_label_low", "a_label_high", "floor", "ceiling"]

    def rows_of(rows: list[tuple], names: list[str]) -> pa.RecordBatch | None:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names) if rows else None

    def near(a_ids, a_labels, a, least, _, x, labels, ids, lowest, highest):
        need = np.flatnonzero(highest >= least)
        found = nearest(a[need], a_labels[need], a_ids[need], x, labels, ids, wanted)
        return rows_of([(int(a_ids[k]), p, s) for k, best in zip(need, found, strict=True) for s, p in best], ["anchor_id", "positive_id", "score"])

    found = read_units(descend(held.select(*bounded), levels, last, True), blocks, held, near, "anchor_id long, positive_id long, score long")
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    positives = cut(found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= wanted))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for home, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a = np.frombuffer(ids, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), home)), pa.array(np.arange(len(a))), pa.array(a)], ["home", "i", "anchor_id"])

    # The windows of each anchor return to the group in which its vector is stored; a negative score opens none.
    homes = held.select("home", "a_ids").mapInArrow(listed, "home long, i long, anchor_id long")
    tops = positives.where("score >= 0").groupBy("anchor_id").agg(F.collect_set("score").alias("tops"))
    spans = [F.min(F.array_min("tops")).alias("floor"), F.max(F.array_max("tops")).cast("double").alias("ceiling")]
    opened = homes.join(tops, "anchor_id").groupBy("home").agg(F.map_from_entries(F.collect_list(F.struct("i", "tops"))).alias("of"), *spans)
    lists = F.transform(F.sequence(F.lit(0).cast("long"), F.col("anchors") - 1), lambda i: F.coalesce(F.try_element_at("of", i), F.array().cast("array<long>")))
    asking = held.drop("floor", "ceiling", "windows").join(opened, "home").withColumn("floor", F.col("floor").cast("double") * (percent / 100 * (1 - SLACK))).withColumn("windows", lists)
    asking = cut(asking.drop("of"))

    def hard(a_ids, a_labels, a, _, windows, x, labels, ids, lowest, highest):
        need = np.array([k for k, w in enumerate(windows) if w and highest[k] >= min(w) * (percent / 100 * (1 - SLACK)) and lowest[k] <= max(w)], np.int64)
        found = within(a[need], a_labels[need], [windows[k] for k in need], x, labels, ids, wanted, percent)
        return rows_of([(int(a_ids[need[k]]), top, n, s) for k, top, best in found for s, n in best], ["anchor_id", "positive_score", "negative_id", "negative_score"])

    hits = read_units(descend(asking.select(*bounded), levels, last, False), blocks, asking, hard, "anchor_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    hits = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted)
    made = positives.select("anchor_id", "positive_id", F.col("score").alias("positive_score")).join(hits, ["anchor_id", "positive_score"])
    return made.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
