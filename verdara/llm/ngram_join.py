"""N-gram Jaccard join: a blocked sparse matrix product of documents by n-gram incidence.

The incidence matrix has a row per distinct n-gram set and a column per n-gram.

1. *Column blocks.* The columns are split by hash into m blocks, m being larger than the number
   of columns in which two rows of that size can differ and still be linked. Two linked rows
   therefore agree entirely in some non-empty block, and rows are brought together only by equal
   (block, content) keys. A row must share as many keys as it has non-empty blocks beyond the
   columns in which a linked row can differ; others drop out. The row of a key that meets most others
   (in later turns: the one of fewest changes) is its hub; keys give star edges, never pairs. A hub and all rows with an edge to it form a family.
2. *Row blocks.* A family of up to ``WHOLE`` rows is one unit, in which a sparse product accumulates
   overlap counts, column strip by column strip, and drops pairs as soon as their count plus what
   is left falls below the bound that their sizes imply. A larger family is cut into row blocks,
   and each block is multiplied with the hub's row alone, so its cost is linear.
3. *Changes.* In a large family, rows linked to the hub are linked through it. Two linked rows of
   which one is not linked to the hub must share columns in which both differ from the hub, by a
   bound on sizes more than half of the other row's; so each sends the keys of as many of its
   changes as it takes for one of the shared ones to be among them, columns foreign to the hub
   first. Rows that meet by such a key form the families of the next turn. Families that are still
   large after ``TURNS`` turns are multiplied block by block.

No pair is capped, sampled or left to probability, except that sets and n-grams are compared as
64-bit hashes: among 10^9 distinct sets 0.03 chance equalities are expected. Defined cases: a text
that is null or has no word has the empty set and is alone; with fewer words than n the whole
sequence is the one n-gram; very long texts are whole rows; repeated rows have equal sets and share a
component; of ties the least doc_id names the component; a null doc_id is kept and never the name of
a component that has another id; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from verdara.llm import groups
from verdara.llm.common import WordHasher, chunks, cut, discard, lower_words_of, mix64, only_members, parts_of, release, rolling, row_key
from verdara.llm.components import connected

#: Rows of one block of a family, the size up to which a family is one unit, and turns before blocks meet all others.
BLOCK_ROWS, WHOLE, TURNS = 128, 256, 4
#: Nodes of one row of a key's group, parts of a hot join key, and bytes of packed keys that a task may hold.
GROUP_ROWS, SALTS, PART_BYTES = 4096, 32, 64 << 20
#: Sets whose keys a task remembers to have sent.
SEEN = 1 << 19
#: Cells of one dense strip of the product.
STRIP_CELLS = 1 << 20


def ngram_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-gram hashes of a text's word hashes."""
    if not len(words):
        return words
    grams = np.sort(rolling(words, n) if len(words) >= n else mix64(rolling(words, len(words)) + np.uint64(len(words))))
    return grams[np.concatenate(([True], grams[1:] != grams[:-1]))]


@lru_cache(8)
def size_classes(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Least and greatest size, allowed difference and number of column blocks of each size class.

    Below 85 per cent blocks hold so few n-grams that one shared passage makes many of them agree, so
    there are more blocks, of which more must agree.
    """
    least = [1]
    while least[-1] < 1 << 40:
        least.append(max(least[-1] + 1, least[-1] * 3 // 2))
    lower = np.array(least, np.int64)
    upper = np.append(lower[1:], 1 << 41) - 1
    differ = 2 * upper * (100 - percent) // (100 + percent)
    return lower, upper, differ, differ + 2 + upper // (50 if percent >= 85 else 8)


def block_keys(grams: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """Keys of the row's column blocks, in its size class and, near the class's end, in the next one; and how many a link shares."""
    lower, upper, differ, blocks = size_classes(percent)
    n = len(grams)
    own = int(np.searchsorted(lower, n, side="right")) - 1
    out, need = [], n
    for c in (own, own + 1):
        if c > own and 100 * n < percent * lower[c]:
            continue
        m = int(blocks[c])
        block = (grams >> np.uint64(7)) % np.uint64(m)
        by = np.argsort(block.astype(np.uint16) if m < 1 << 16 else block, kind="stable")
        block = block[by]
        start = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        content = np.add.reduceat(mix64(grams[by]), start)
        at = block[start] + np.uint64(c << 40)
        out.append(mix64(content ^ mix64(at)))
        need = min(need, len(start) - (100 - percent) * (n + min(int(upper[c]), n * 100 // percent)) // (100 + percent))
        if len(start) <= differ[c]:  # so many empty blocks that the guarantee needs them as keys
            empty = np.setdiff1d(np.arange(m, dtype=np.uint64), block[start])
            out.append(mix64(mix64(empty + np.uint64(c << 40)) + np.uint64(1)))
    return np.concatenate(out), max(1, need)


def product_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs of rows whose overlap reaches ``percent`` of their union, by a strip-wise product."""
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    total = size[:, None] + size[None, :]
    need = -(-percent * total // (100 + percent))
    alive = np.triu(np.minimum(size[:, None], size[None, :]) >= need, 1)
    if not alive.any():
        return []
    column, row = np.concatenate(sets), np.repeat(np.arange(n), size)
    by = np.argsort(column, kind="stable")
    column, row = column[by], row[by]
    start = np.concatenate(([True], column[1:] != column[:-1]))
    code = np.cumsum(start) - 1
    common = np.bincount(code)[code] > 1
    row, code = row[common], code[common]
    if not len(row):
        return []
    code = np.concatenate(([0], np.cumsum(code[1:] != code[:-1])))
    rest = np.bincount(row, minlength=n)
    count = np.zeros((n, n), np.int64)
    width = max(64, STRIP_CELLS // n)
    cuts = np.searchsorted(code, np.arange(0, code[-1] + 1 + width, width))
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        if i == j:
            continue
        strip = np.zeros((n, width), np.float32)
        strip[row[i:j], code[i:j] - code[i]] = 1
        count += (strip @ strip.T).astype(np.int64)
        rest = rest - np.bincount(row[i:j], minlength=n)
        alive &= count + np.minimum(rest[:, None], rest[None, :]) >= need
        if not alive.any():
            return []
    return [(int(a), int(b)) for a, b in zip(*np.nonzero(alive), strict=True)]


def changes(row: np.ndarray, hub: np.ndarray, percent: int, name: int) -> tuple[bool, np.ndarray, np.ndarray]:
    """Whether a row is not linked to its hub (far), its keys for meeting far rows, and those for far rows meeting others.

    With c = (100 - percent) / (100 + percent), linked rows x, y differ in at most c (|x| + |y|)
    columns. If x is not linked to the hub, then more than (|dy| - c (|y| - |hub|)) / 2 of the columns
    dy in which y differs from the hub are also among those of x; if neither is, this holds either
    way round. And of dx at least |dx| - |x| (100 - percent) / percent are shared. As both rows order
    their changes alike, the first shared one is among the first |dy| - shared + 1 of y.
    """
    inside = np.isin(row, hub, assume_unique=True)
    both = int(inside.sum())
    far = 100 * both < percent * (len(row) + len(hub) - both)
    change = np.concatenate((row[~inside], hub[~np.isin(hub, row, assume_unique=True)]))  # foreign columns first
    n, more = len(change), len(row) - len(hub)
    half = n - ((100 + percent) * n - (100 - percent) * more) // (2 * (100 + percent))
    most = n - max(1, n - len(row) * (100 - percent) // percent) + 1
    key = lambda first, kind: mix64(first ^ mix64(np.array([name], np.int64).view(np.uint64) + np.uint64(kind)))
    if not far:
        return False, change[:0], key(change[:half], 2)
    return True, key(change[: min(half, most)], 1), key(change[:most], 2)


def spanning(pairs: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


#: Columns of ``described``: key names the row, node its n-gram set, keys its column blocks.
DESCRIBED = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("keys", pa.list_(pa.int64())), ("need", pa.int64()), ("side", pa.int32())])
#: Keys that are held before they are handed on, beyond those of one slice of texts.
HELD_KEYS = 1 << 19


def described(n: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches ``doc_id, key, text`` that makes ``DESCRIBED`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        seen: set[int] = set()
        for batch in batches:
            begin, held = 0, 0
            sizes, nodes, keys, needs = [], [], [], []
            for part in chunks(batch):
                if len(seen) > SEEN:
                    seen.clear()
                for text in part.column(2).to_pylist():
                    grams = ngram_set(hasher(lower_words_of(text)), n)
                    sizes.append(len(grams))
                    if not len(grams):
                        nodes.append(None)
                        keys.append(np.empty(0, np.uint64))
                        needs.append(None)
                        continue
                    node = int(mix64(np.add.reduce(mix64(grams), keepdims=True) + np.uint64(len(grams))).view(np.int64)[0])
                    nodes.append(node)
                    own, need = (np.empty(0, np.uint64), None) if node in seen else block_keys(grams, percent)
                    keys.append(own)
                    held += len(own)
                    needs.append(need)
                    seen.add(node)
                if held >= HELD_KEYS or begin + len(sizes) == batch.num_rows:
                    ends = pa.array(np.cumsum([0, *map(len, keys)]).astype(np.int32))
                    ids = batch.slice(begin, len(sizes))
                    made = [ids.column(0), ids.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(ends, _signed(np.concatenate(keys))), pa.array(needs, pa.int64()), pa.array(np.zeros(len(sizes), np.int32))]
                    begin, held = begin + len(sizes), 0
                    sizes, nodes, keys, needs = [], [], [], []
                    yield pa.RecordBatch.from_arrays(made, schema=DESCRIBED)

    return run


def describe(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The rows of ``described`` without their side."""
    return docs.select("doc_id", row_key().alias("key"), "text").mapInArrow(described(n, percent), from_arrow_schema(DESCRIBED)).drop("side")


def gathered(rows: DataFrame, parts: int, make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None, packed: bool = False) -> DataFrame:
    """One table of ``rows`` without their keys, each with a number ``row``, and of the keys (``met, n, members``) that several rows have; in those ``row`` is null.
    With ``packed``, the table has groups of rows instead (``groups``, see the module of that name), one for each such key, without the key itself.

    Keys travel packed by hash part, so a shuffle row holds many: four bytes of the key (with the part
    enough, a chance meeting is only one more candidate) and the row's place among 65,536 in two planes
    of a byte, of which the higher one hardly varies and compresses. The rows themselves take the same shuffle.
    A key is left out that only one row, only rows of side 1 or only rows of side 2 have. Rows are numbered
    in the order in which a task reads them, so they should come from a table, which a repeated task reads alike.
    With ``make``, the rows are what it makes of ``rows``, in the same Python worker: keys are not sent to Spark
    and back, and no second worker stays beside the first.
    """
    fields = from_arrow_schema(DESCRIBED) if make else rows.schema
    info = [T.StructField(f.name, f.dataType) for f in fields if f.name not in ("keys", "side")]
    place = [T.StructField("row", T.LongType())]
    sent = T.StructType([*info, *place, *(T.StructField(k, t) for k, t in (("part", T.IntegerType()), ("side", T.IntegerType()), ("base", T.LongType()), ("payload", T.BinaryType())))])
    found = [("groups", T.BinaryType())] if packed else [("met", T.LongType()), ("n", T.LongType()), ("members", T.ArrayType(T.LongType()))]
    out = T.StructType([*info, *place, *(T.StructField(k, t) for k, t in found)])
    names, width = [f.name for f in info], len(info) + 1
    absent = [pa.binary()] if packed else [pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        for batch in make(batches) if make else batches:
            size = batch.num_rows
            rest = [batch.column(k) for k in names]
            row = first + np.arange(size)
            yield pa.RecordBatch.from_arrays([*rest, pa.array(row), pa.array((row % parts).astype(np.int32)), *(pa.nulls(size, t) for t in (pa.int32(), pa.int64(), pa.binary()))], sent.names)
            lists = batch.column("keys")
            keys = lists.flatten().to_numpy(zero_copy_only=False)
            if len(keys):
                counts = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(size, dtype=np.uint32), counts)
                code = ((keys.view(np.uint64) >> np.uint64(33)) % np.uint64(parts) * np.uint64(4)).astype(np.uint32)
                code += np.repeat(batch.column("side").to_numpy(zero_copy_only=False).astype(np.uint32), counts)
                by = np.argsort(code, kind="stable")
                low, owner, code = keys.astype(np.uint32)[by], owner[by], code[by]
                start = np.concatenate(([0], np.flatnonzero((code[1:] != code[:-1]) | (owner[1:] >> 16 != owner[:-1] >> 16)) + 1))
                near, far = owner.astype(np.uint8), (owner >> 8).astype(np.uint8)
                payload = [low[i:j].tobytes() + near[i:j].tobytes() + far[i:j].tobytes() for i, j in zip(start, np.append(start[1:], len(low)), strict=True)]
                filled = [(code[start] >> 2).astype(np.int32), (code[start] & 3).astype(np.int32), first + (owner[start] >> 16 << 16).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(start), x.type) for x in rest), pa.nulls(len(start), pa.int64()), *map(pa.array, filled), pa.array(payload, pa.binary())], sent.names)
            first += size

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owner, sides, kinds = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int8)], []
        for batch in batches:
            plain = batch.filter(pc.is_null(batch.column("payload")))
            kinds = [c.type for c in plain.columns[:width]]
            if plain.num_rows:
                yield pa.RecordBatch.from_arrays([*plain.columns[:width], *(pa.nulls(plain.num_rows, t) for t in absent)], out.names)
            full = batch.filter(pc.is_valid(batch.column("payload")))
            for part, side, base, payload in zip(*(full.column(k).to_pylist() for k in ("part", "side", "base")), full.column("payload"), strict=True):
                data = payload.as_buffer()
                n = data.size // 6
                keys.append(np.frombuffer(data, np.uint32, n).astype(np.int64) | part << 32)
                near, far = np.frombuffer(data, np.uint8, 2 * n, 4 * n).astype(np.int64).reshape(2, n)
                owner.append(base + near + (far << 8))
                sides.append(np.full(n, side, np.int8))
        k, o, s = np.concatenate(keys), np.concatenate(owner), np.concatenate(sides)
        keys.clear(), owner.clear(), sides.clear()
        if not len(k):
            return
        by = np.lexsort((o, k))
        k, o, s = k[by], o[by], s[by]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
        k, o, s = k[new], o[new], s[new]
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        size = np.diff(np.append(first, len(k)))
        met = (size > 1) & ((np.minimum.reduceat(s, first) != np.maximum.reduceat(s, first)) | (s[first] == 0))
        shared = np.repeat(met, size)
        k, o, size = k[shared], o[shared], size[met]
        if packed:
            for some in groups.pack(o, size):
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in kinds), pa.array([some], pa.binary())], out.names)
            return
        rank = np.arange(len(k)) - np.repeat(np.cumsum(size) - size, size)
        start = np.flatnonzero(rank % GROUP_ROWS == 0)
        n, ends = np.repeat(size, size)[start], np.append(start, len(k))
        for i in range(0, len(start), 20_000):
            cut_at = ends[i : i + 20_001]
            members = pa.ListArray.from_arrays(pa.array((cut_at - cut_at[0]).astype(np.int32)), pa.array(o[cut_at[0] : cut_at[-1]]))
            some = len(cut_at) - 1
            yield pa.RecordBatch.from_arrays([*(pa.nulls(some, t) for t in kinds), pa.array(k[start[i : i + 20_000]]), pa.array(n[i : i + 20_000]), members], out.names)

    return cut(rows.mapInArrow(pack, sent).repartitionById(parts, F.col("part")).mapInArrow(meet, out))


def meeting(rows: DataFrame) -> DataFrame:
    """Star edges ``a, b`` with the hub's rank ``d``, between nodes with an equal key, from ``rows(node, keys, need, side[, rank])``.

    Without a given rank, the hub of a key is the node that meets most others by all its keys.

    A row that shares fewer than ``need`` of its keys has no edge. There are as many parts as keep
    each below ``PART_BYTES``. Shuffles and tables of a step are dropped when the next one is written. The stars are a table.
    """
    rows = rows.where("node IS NOT NULL")
    total = rows.agg(F.sum(F.size("keys"))).first()[0] or 0
    met = gathered(rows, max(parts_of(rows), -(-12 * total // PART_BYTES)))
    return stars_of(met, met.where("row IS NOT NULL"))


def stars_of(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The stars of ``meeting`` from the table of ``gathered``, which is deleted, and its ``rows``."""
    release(rows.sparkSession)
    each = table.where("row IS NULL").select(F.col("met").alias("key"), "n", F.explode("members").alias("row"))
    met = each.groupBy("row").agg(F.count("*").alias("k"), F.sum("n").alias("degree"), F.max("n").alias("most"))
    rank = F.max("rank") if "rank" in rows.columns else F.lit(None)
    need = rows.where("need IS NOT NULL").groupBy("row", "node").agg(F.min("need").alias("need"), rank.cast("long").alias("rank"))
    good = cut(met.join(need, "row").where("k >= need AND most > 1").select("row", "node", F.coalesce("rank", "degree").alias("d")))
    kept = cut(only_members(each, good, "row").join(good, "row").where("n > 1").select("key", "n", "node", "d"))  # most rows end in the filter, before the shuffle
    discard(table)
    discard(good)
    release(rows.sparkSession)
    hub = kept.groupBy("key", "n").agg(F.max(F.struct("d", "node")).alias("hub"), F.count("*").alias("c")).where("c > 1")
    pieces = F.floor(F.col("n") / GROUP_ROWS)
    spread = hub.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces)))
    stars = kept.select("key", F.pmod(F.xxhash64("node"), pieces + 1).alias("piece"), "node").join(spread, ["key", "piece"])
    made = cut(stars.where("node <> hub.node").select(F.col("hub.node").alias("a"), F.col("node").alias("b"), F.col("hub.d").alias("d")).distinct())
    discard(kept)
    return made


def stars_in(table: DataFrame) -> DataFrame:
    """Stars as ``meeting`` makes them, from the table of ``gathered`` with packed groups, which is deleted.

    Rows of one node have the same keys: one of them stands for all, and only keys count that others have too.
    Rows meet by packed groups, so a pair of row and key takes a few bytes in a shuffle, however many tasks there are.
    A row leaves the hubs that it shares fewest keys with, as long as these keys are fewer than half of its ``need``:
    two linked rows share at least ``need`` keys of either, so one of those has a hub that neither leaves.
    """
    release(table.sparkSession)
    pieces = table.where("groups IS NOT NULL").select("groups")
    rows = table.where("row IS NOT NULL")
    need = rows.where("need IS NOT NULL").groupBy("node").agg(F.min("need").alias("need"), F.count("*").alias("c"), F.min("row").alias("row"))
    good = cut(groups.tallied(pieces).join(need, "row").where("k >= need AND most > c").select("row", "degree"))
    release(table.sparkSession)
    found = cut(groups.starred(pieces, good))
    release(table.sparkSession)
    name = lambda end: rows.select(F.col("row").alias(end), F.col("node").alias(f"{end}_node"), F.col("need").alias(f"{end}_need"))
    named = found.join(name("b"), "b").where("weak > (b_need - 1) div 2").join(name("a"), "a").where("a_node <> b_node")
    made = cut(named.groupBy(F.col("a_node").alias("a"), F.col("b_node").alias("b")).agg(F.max("d").alias("d")))
    for done in (table, good, found):
        discard(done)
    return made


def largest_stars(stars: DataFrame) -> DataFrame:
    """``stars(a, b, d)`` without hubs all of whose neighbours are also neighbours of the hub's own greatest hub.

    Every pair of such a star is in the larger one, whose hub has a higher (degree, name), so none is lost.
    A hub's degree is the highest of its rows.
    """
    hubs = stars.groupBy("a").agg(F.max("d").alias("own"))
    ranked = stars.select("a", "b").join(hubs, "a")
    above = ranked.groupBy(F.col("b").alias("a")).agg(F.max(F.struct(F.col("own").alias("d"), "a")).alias("p"))
    above = above.join(hubs, "a").where(F.col("p") > F.struct(F.col("own").alias("d"), "a")).select("a", F.col("p.a").alias("p"))
    found = stars.select("a", "b").join(above, "a").join(stars.select(F.col("a").alias("p"), "b", F.lit(1).alias("hit")), ["p", "b"], "left")
    # The hub p itself is among a's neighbours at most once, and is not a neighbour of itself.
    inside = found.groupBy("a").agg(F.count(F.when(F.col("b") != F.col("p"), 1)).alias("n"), F.count("hit").alias("h")).where("n = h").select("a")
    return stars.join(inside, "a", "left_anti")


def compared(docs: DataFrame, shown: DataFrame, stars: DataFrame, n: int, percent: int, last: bool, whole: int | None = None) -> DataFrame:
    """Links ``a, b`` of the families, and ``far, keys, cross`` (see ``changes``) of the rows ``a`` of large ones (b is null), ranked by few changes.

    Texts travel, not their n-gram sets, which are larger; the sets are made where they are multiplied. A text goes to
    each of its families. Where these have more n-grams than ``whole``, of ``shown(node, key, size)``, units are worked on in
    slices of at most about so many, each of which leaves only its links on the disk.
    """
    family = stars.select(F.col("a").alias("family"), F.col("b").alias("node")).unionByName(stars.select(F.col("a").alias("family"), F.col("a").alias("node")).distinct())
    size = family.groupBy("family").agg(F.count("*").alias("g"))
    salted = size.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    members = family.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS))).join(salted, ["family", "salt"]).join(shown, "node")
    blocks = F.when(F.col("g") <= WHOLE, F.lit(1)).otherwise(F.ceil(F.col("g") / BLOCK_ROWS)).cast("int")
    members = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    members = cut(members.select("family", "node", "key", "g", "blocks", "block", *(["size"] if whole else [])))
    everywhere = F.sequence(F.lit(0), F.col("blocks") - 1)
    is_hub = F.col("node") == F.col("family")
    if last:
        spots = members.withColumn("other", F.explode(everywhere)).withColumn("large", F.lit(False))
        spots = spots.withColumn("unit", F.xxhash64("family", F.least("block", "other"), F.greatest("block", "other")))
    else:
        at = F.explode(F.when(is_hub, everywhere).otherwise(F.array("block")))
        spots = members.withColumn("large", F.col("g") > WHOLE).withColumn("at", at).withColumn("unit", F.xxhash64("family", "at"))
    slices = max(1, -(-(spots.agg(F.sum("size")).first()[0] or 0) // whole)) if whole else 1
    spots = spots.select("key", "unit", "node", (~is_hub).alias("member"), "large")
    texts = docs.select(row_key().alias("key"), "text")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("far", pa.bool_()), ("keys", pa.list_(pa.int64())), ("cross", pa.list_(pa.int64())), ("rank", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        unit: int | None = None
        held: dict[int, np.ndarray] = {}

        def links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            ends = np.array(pairs, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1]), *(pa.nulls(len(ends), f.type) for f in list(out)[2:])], schema=out)

        def flush() -> Iterator[pa.RecordBatch]:
            names = sorted(held)
            if len(names) > 1:
                found = spanning(product_links([held[k] for k in names], percent), len(names))
                if found:
                    yield links([(names[a], names[b]) for a, b in found])

        for batch in batches:
            pairs, rows = [], []
            for i in range(batch.num_rows):
                u, member, node, large = (batch.column(c)[i].as_py() for c in range(4))
                if u != unit:
                    yield from flush()
                    unit, hub, last = u, (0, np.empty(0, np.uint64)), None
                    held.clear()
                if node in held or node == last or member and node == hub[0]:
                    continue
                grams = ngram_set(hasher(lower_words_of(batch.column(4)[i].as_py())), n)
                if not large:
                    held[node] = grams
                elif not member:
                    hub = node, grams
                else:
                    last = node  # repeated rows follow each other
                    far, keys, cross = changes(grams, hub[1], percent, hub[0])
                    rows.append((node, None, far, keys.view(np.int64), cross.view(np.int64), -len(np.setxor1d(grams, hub[1], assume_unique=True))))
                    if not far:
                        pairs.append((hub[0], node))
            if pairs:
                yield links(pairs)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*rows), out)], schema=out)
        yield from flush()

    def slice_of(spots: DataFrame, members: DataFrame) -> DataFrame:
        placed = only_members(texts, members, "key").join(spots, "key").select("unit", "member", "node", "large", "text")
        return placed.repartition("unit").sortWithinPartitions("unit", "member", "node").mapInArrow(run, "a long, b long, far boolean, keys array<long>, cross array<long>, rank long")

    if slices == 1:
        return slice_of(spots, members)
    made = []
    for i in range(slices):
        own = spots.where(F.pmod(F.xxhash64("unit", F.lit(2)), F.lit(slices)) == i)
        made.append(cut(slice_of(own, own)))
        release(docs.sparkSession)
    return reduce(DataFrame.unionByName, made)


def links(docs: DataFrame, rows: DataFrame, stars: DataFrame, n: int, percent: int) -> DataFrame:
    """Edges ``a, b`` that span every component of the exact link relation between n-gram sets."""
    shown = cut(rows.where("node IS NOT NULL").groupBy("node").agg(F.min("key").alias("key"), F.max("n_shingles").alias("size")))
    whole = rows.agg(F.sum("n_shingles")).first()[0] or 1
    found = None
    for turn in range(TURNS + 1):
        made = cut(compared(docs, shown, stars, n, percent, turn == TURNS, whole))
        release(docs.sparkSession)
        edges = made.where("b IS NOT NULL").select("a", "b")
        found = edges if found is None else found.unionByName(edges)
        if made.where("far").isEmpty():
            break
        stars = meeting(met_again(made))
        release(docs.sparkSession)
    return found


def met_again(made: DataFrame) -> DataFrame:
    """``node, keys, need, side`` of the rows of large families: far rows among themselves, and far rows (side 1) with others (side 2)."""
    one = F.lit(1).cast("long").alias("need")
    far = made.where("far").select(F.col("a").alias("node"), "keys", one, F.lit(0).alias("side"), "rank")
    cross = made.where("far IS NOT NULL").select(F.col("a").alias("node"), F.col("cross").alias("keys"), one, F.when(F.col("far"), 1).otherwise(2).alias("side"), "rank")
    return far.unionByName(cross)


def components(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """``doc_id, key, n_shingles, component_id`` of every row of ``docs(doc_id, text)``; n words a gram, links at ``percent`` of the union."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # A key needs about four bytes of text or more; the keys themselves are made only once, on their way to the shuffle.
    total = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 4
    keyed = docs.select("doc_id", row_key().alias("key"), "text")
    table = gathered(keyed, max(parts_of(docs), -(-12 * total // PART_BYTES)), described(n, percent), packed=True)
    rows = cut(table.where("row IS NOT NULL").select("doc_id", "key", "n_shingles", "node"))
    stars = stars_in(table)
    release(docs.sparkSession)
    stars = cut(largest_stars(stars))
    release(docs.sparkSession)
    label = connected(links(docs, rows, stars, n, percent))
    flat = rows.select("doc_id", "key", "n_shingles", "node").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = flat.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("c")).where("c > 1")
    salted = least.select("label", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")).alias("salt"))
    flat = flat.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))  # a component may hold a large share of all rows
    return flat.join(salted, ["label", "salt"], "left").select("doc_id", "key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """The rows of ``docs``, all columns, that name their component; repeated rows once, rows without any id in their component all.

    Only rows that are dropped or repeated, and those that a filter of fixed size takes for such, are shuffled.
    """
    named = F.col("doc_id").eqNullSafe(F.col("component_id"))
    keys = components(docs, n, percent).groupBy("key").agg(F.max(named).alias("kept"), F.count("*").alias("c"))
    unsure = cut(keys.where("c > 1 OR NOT kept").select("key", "kept"))
    release(docs.sparkSession)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("key"))
    asked = only_members(rows, unsure, "key").join(unsure, "key", "left").where("coalesce(kept, true)")
    return only_members(rows, unsure, "key", others=True).unionByName(asked.dropDuplicates(["key"]).drop("kept")).select("row.*")


def op10_ngram_join(spark, sf_dir: str) -> DataFrame:
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
