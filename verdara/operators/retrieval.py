"""Retrieval: BM25, exact dense search, rank fusion, and ranking quality."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdara.functions.text import tokens

K1, B, FLOOR, RRF_K = 1.5, 0.75, 0.25, 60
#: Queries sent to the tasks at once; the set of queries is worked off in blocks of this size.
QUERY_BLOCK = 4096
#: Queries and vectors whose scores a task holds at once.
TILE_QUERIES, TILE_VECTORS = 256, 4096
#: Documents and tokens of a block of the stored index; queries searched at once, each with all its terms.
BLOCK_DOCS, BLOCK_TOKENS, SEARCH_BLOCK = 512, 1 << 18, 1024
#: Blocks of a row group. A reader holds the rows of a group at once.
GROUP_BLOCKS = 8
#: A block's terms, the place of each in ``at`` and ``tf`` (and their end), its documents and frequencies, the largest frequency and the least length.
POSTINGS = pa.schema([("terms", pa.string()), *((c, pa.int32()) for c in ("starts", "at", "tf", "most", "least"))])


def _packed(columns: list[np.ndarray | pa.Array]) -> bytes:
    """Columns of ``POSTINGS``, each of its own length, as compressed Arrow streams; Spark holds and sends a block as these bytes."""
    sink = pa.BufferOutputStream()
    for field, values in zip(POSTINGS, columns, strict=True):
        with pa.ipc.new_stream(sink, pa.schema([field]), options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(pa.RecordBatch.from_arrays([pa.array(values, field.type)], schema=pa.schema([field])))
    return sink.getvalue().to_pybytes()


def _unpacked(block: pa.BinaryScalar) -> list[pa.Array]:
    source = pa.BufferReader(block.as_buffer())
    return [pa.ipc.open_stream(source).read_all().column(0).chunk(0) for _ in POSTINGS]


def postings(docs: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """``doc, term, tf, dl`` of every document and term."""
    # The generator keeps the tokenisation from being repeated in every expression on its result.
    rows = docs.select(F.col(doc).alias("doc"), F.explode(F.array(F.sort_array(tokens(F.col(text))))).alias("terms"))
    # Equal neighbours of the sorted terms are counted inside the row, without a shuffle.
    starts = F.filter(F.sequence(F.lit(1), F.size("terms")), lambda i: (i == 1) | (F.get(F.col("terms"), i - 1) != F.get(F.col("terms"), i - 2)))
    runs = rows.where(F.size("terms") > 0).select("doc", "terms", F.explode(F.array(starts)).alias("starts"))
    each = runs.select("doc", F.size("terms").alias("dl"), "terms", "starts", F.posexplode("starts").alias("i", "at"))
    return each.select("doc", "dl", F.get(F.col("terms"), F.col("at") - 1).alias("term"), (F.coalesce(F.get(F.col("starts"), F.col("i") + 1), F.col("dl") + 1) - F.col("at")).cast("long").alias("tf"))


def weighted(counts: DataFrame, n_docs: Column) -> DataFrame:
    """``counts`` (``term, df`` and more) with ``idf``, negative values lifted to a quarter of the mean. Counts are read twice."""
    raw = counts.withColumn("raw", F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    mean = raw.agg(F.avg("raw").alias("mean"))  # one row
    return raw.join(F.broadcast(mean)).select(*counts.columns, F.when(F.col("raw") < 0, FLOOR * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def term_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``term, df, tf``: the documents that hold each term, each row by itself, and its occurrences.

    A task counts the terms of a batch of rows before anything is shuffled; texts are read once.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4 * BLOCK_DOCS):
                lists = batch.column(0).slice(start, 4 * BLOCK_DOCS)
                coded, n = lists.flatten().dictionary_encode(), len(lists)
                words, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
                row = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy())
                held = np.bincount(np.unique(code * n + row) // n, minlength=len(words))
                yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(held), pa.array(np.bincount(code, minlength=len(words)))], ["term", "df", "tf"])

    rows = docs.select(tokens(F.col(text)).alias("terms")).where(F.size("terms") > 0)
    return rows.mapInArrow(count, "term string, df long, tf long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))


def idf(posted: DataFrame, n_docs: Column) -> DataFrame:
    """``term, idf`` of postings."""
    return weighted(posted.groupBy("term").agg(F.count("*").alias("df")), n_docs).select("term", "idf")


def tokenised(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """``doc, terms`` of every document with an id; a table of few files is dealt to all cores first."""
    rows = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).where("doc IS NOT NULL")
    cores = docs.sparkSession.sparkContext.defaultParallelism
    rows = rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)
    return rows.select("doc", F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("terms"))


def write_index(docs: DataFrame, doc: str, folder: str, text: str = "text") -> None:
    """The stored index of documents: ``blocks``, ``terms(term, df, idf)`` and ``sizes(n, avgdl)``; texts are read once, nothing is shuffled but term counts.

    A block is a row with the postings of up to ``BLOCK_DOCS`` documents, sorted by id: lengths, and compressed to one value terms and for
    each term its documents' places and frequencies, with the largest frequency and the least length, from which a search bounds its scores.
    Beyond ``BLOCK_TOKENS`` a block takes no further document, so only one that is longer itself makes a larger row.
    """
    kind = "string" if docs.schema[doc].dataType.typeName() == "string" else "long"

    def cuts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
        start, upto = 0, np.cumsum(sizes)
        while start < len(sizes):
            most = BLOCK_TOKENS + (upto[start - 1] if start else 0)
            end = max(start + 1, min(start + BLOCK_DOCS, int(np.searchsorted(upto, most, side="right"))))
            yield start, end
            start = end

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in cuts(pc.list_value_length(batch.column("terms")).to_numpy()):
                part = pa.Table.from_batches([batch.slice(start, end - start)]).sort_by("doc")
                lists = part["terms"].combine_chunks()
                lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
                sizes, coded = pc.list_value_length(lists).to_numpy().astype(np.int64), lists.flatten().dictionary_encode()
                n = part.num_rows
                key, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), sizes), return_counts=True)
                term, at = key // n, key % n
                first = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.empty(0, np.int64)
                most, least = (f.reduceat(x, first) if len(first) else first for f, x in ((np.maximum, tf), (np.minimum, sizes[at])))
                held = _packed([coded.dictionary, np.append(first, len(term)), at, tf, most, least])
                row = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.array(v, t)) for v, t in ((part["doc"].to_pylist(), names), (sizes, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*row, pa.array([held], pa.binary())], ["docs", "sizes", "postings"])

    names = pa.string() if kind == "string" else pa.int64()
    ddl = f"docs array<{kind}>, sizes array<int>, postings binary"
    spark = docs.sparkSession
    rows = tokenised(docs, doc, text)
    rows = rows if kind == "string" else rows.withColumn("doc", F.col("doc").cast("long"))
    rows.mapInArrow(pack, ddl).write.mode("overwrite").option("parquet.block.row.count.limit", GROUP_BLOCKS).parquet(f"{folder}/blocks")
    blocks = spark.read.parquet(f"{folder}/blocks")
    total = F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda t, x: t + x))
    sizes = blocks.agg(F.coalesce(F.sum(F.size("docs")), F.lit(0)).alias("n"), F.coalesce(total, F.lit(0)).alias("total"))
    sizes.select("n", (F.col("total") / F.greatest("n", F.lit(1))).alias("avgdl")).write.mode("overwrite").parquet(f"{folder}/sizes")
    n = spark.read.parquet(f"{folder}/sizes").first()["n"]

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0):
                terms, starts = _unpacked(block)[:2]
                yield pa.RecordBatch.from_arrays([terms, pa.array(np.diff(starts.to_numpy()), pa.int64())], ["term", "n"])

    counts = blocks.select("postings").mapInArrow(held, "term string, n long").groupBy("term").agg(F.sum("n").alias("df"))
    weighted(counts, F.lit(n)).write.mode("overwrite").parquet(f"{folder}/terms")


def index_of(docs: DataFrame, doc: str, text: str = "text") -> str:
    """Folder of the index of a table of files: written on first use, found again while paths, sizes and times of the files are the same."""
    spark = docs.sparkSession
    file = [F.col(f"_metadata.{c}") for c in ("file_path", "file_size", "file_modification_time")]
    seen = docs.groupBy(*file).count().agg(F.bit_xor(F.xxhash64("file_path", "file_size", "file_modification_time", "count")).alias("files")).first()["files"]
    own = scratch(spark, "index")
    folder = f"{own.rsplit('/', 1)[0]}/{(seen or 0) & (1 << 64) - 1:016x}-{doc}-{text}-{GROUP_BLOCKS}-packed"
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path(folder)):  # written aside and then named, so a broken or parallel write is never taken for the index
        write_index(docs, doc, own, text)
        if files.exists(path(folder)) or not files.rename(path(own), path(folder)):
            return own
    return folder


def search(spark: SparkSession, folder: str, queries: DataFrame, query: str, k: int, overlap: bool = False) -> DataFrame:
    """``query, doc, score, rank``: the k best documents of each query that share a term with it, by BM25 or, with ``overlap``, by the number of shared terms.

    Queries are worked off ``SEARCH_BLOCK`` at a time. A task keeps its k best of every query; a block of documents is scored only for
    queries whose bound in it, the sum over its terms of the largest weight, reaches their k-th best score so far. So the
    shuffle holds at most k rows a task and query. Repeated query terms count repeatedly.
    """
    asked = queries.select(F.col(query).alias("query"), F.explode(tokens(F.col("text"))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))
    asked = asked.join(spark.read.parquet(f"{folder}/terms").select("term", "idf"), "term")
    blocks, size = spark.read.parquet(f"{folder}/blocks"), spark.read.parquet(f"{folder}/sizes").first()
    avgdl = max(size["avgdl"], 1e-12)
    doc_type, query_type = blocks.schema["docs"].dataType.elementType.simpleString(), queries.schema[query].dataType.simpleString()
    turns = max(1, -(-queries.select(query).distinct().count() // SEARCH_BLOCK))
    parts = []
    for turn in range(turns):
        rows = asked.where(F.pmod(F.xxhash64("query"), F.lit(turns)) == turn).toPandas()
        ids, row = np.unique(rows["query"].to_numpy(), return_inverse=True)
        vocabulary, column = np.unique(rows["term"].to_numpy(str), return_inverse=True)
        gain = np.ones(len(rows)) if overlap else rows["times"].to_numpy() * rows["idf"].to_numpy()
        shared = spark.sparkContext.broadcast((ids, vocabulary, row, column, gain))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, vocabulary, row, column, gain = shared.value
            words, best, best_doc = pa.array(vocabulary.tolist(), pa.string()), None, None
            positive = bool((gain > 0).all())
            weight = lambda tf, dl: np.ones(len(tf)) if overlap else tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
            for batch in batches:
                for b in range(batch.num_rows):
                    docs, sizes = (c[b].values for c in batch.columns[:2])
                    terms, starts, at, tf, most, least = _unpacked(batch.column(2)[b])
                    known = pc.index_in(terms, value_set=words)
                    held = np.flatnonzero(known.is_valid().to_numpy(zero_copy_only=False))
                    if not len(held):
                        continue
                    sizes, starts, at, tf, most, least = (c.to_numpy() for c in (sizes, starts, at, tf, most, least))
                    place = np.full(len(vocabulary), -1)
                    place[known.drop_null().to_numpy()] = np.arange(len(held))
                    of = place[column] >= 0
                    wanted = np.zeros((len(ids), len(held)))
                    wanted[row[of], place[column[of]]] = gain[of]
                    alive = wanted.any(1) if positive else np.bincount(row[of], minlength=len(ids)) > 0
                    if best is not None and positive:
                        alive &= wanted @ weight(most[held], least[held]) + 1e-6 >= best[:, -1]
                    alive = np.flatnonzero(alive)
                    if not len(alive):
                        continue
                    n = starts[held + 1] - starts[held]
                    spot = np.repeat(starts[held] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    table = np.zeros((len(held), len(sizes)))
                    table[np.repeat(np.arange(len(held)), n), at[spot]] = weight(tf[spot], sizes[at[spot]])
                    score = np.round(wanted[alive] @ table, 6)
                    touched = score > 0 if positive else ((wanted[alive] != 0).astype(float) @ (table > 0)) > 0
                    score[~touched] = -np.inf
                    names = docs.to_numpy(zero_copy_only=False)
                    if best is None:
                        best, best_doc = np.full((len(ids), k), -np.inf), np.full((len(ids), k), names[0], names.dtype if doc_type == "bigint" else object)
                    both, found = np.hstack((best[alive], score)), np.hstack((best_doc[alive], np.broadcast_to(names, score.shape)))
                    for q, i in enumerate(alive):  # blocks come in any order, so ids break ties
                        some = np.flatnonzero(both[q] >= np.partition(both[q], -k)[-k])
                        order = some[np.lexsort((found[q][some], -both[q][some]))[:k]]
                        best[i], best_doc[i] = both[q][order], found[q][order]
            if best is not None:
                q, _ = keep = np.nonzero(np.isfinite(best))
                yield pa.RecordBatch.from_arrays([pa.array(ids[q].tolist()), pa.array(best_doc[keep].tolist()), pa.array(best[keep])], ["query", "doc", "score"])

        if len(rows):
            parts.append(blocks.mapInArrow(run, f"query {query_type}, doc {doc_type}, score double"))
    if not parts:
        return spark.createDataFrame([], f"query {query_type}, doc {doc_type}, score double, rank long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return top_k(out, k)


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder below the session's shared one; a local one only on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="spark-index-")
    return f"{folder.rstrip('/')}/{kind}/{uuid.uuid4().hex}"


def top_k(scored: DataFrame, k: int, by: str = "query", score: str = "score", tie: str = "doc", digits: int = 6) -> DataFrame:
    """The k best rows of each query, ranked from 1; ties by id. The group limit runs before the shuffle."""
    rounded = scored.withColumn(score, F.round(score, digits))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), F.asc(tie))).cast("long")
    return rounded.withColumn("rank", rank).where(F.col("rank") <= k)


def _keep_best(best: np.ndarray, best_id: np.ndarray, score: np.ndarray, found: np.ndarray) -> None:
    """Takes the columns of ``score`` (rows are queries, ``found`` the ids) into the k best of each row, best first, rounded to 6 digits; ties by id."""
    k, least = best.shape[1], best[:, -1].copy()
    fresh = np.flatnonzero(np.isneginf(least))
    if len(fresh) and score.shape[1] > k:  # without k rows yet: only the k best of these columns can enter
        own = np.nan_to_num(score[fresh], nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        least[fresh] = np.partition(own, -k, axis=1)[:, -k]
    row, column = np.nonzero(score >= (least - 2e-6)[:, None])  # rounding moves a score by less
    value = np.round(score[row, column], 6)
    touched, at = np.unique(row, return_inverse=True)
    at = np.concatenate((np.repeat(np.arange(len(touched)), k), at))
    value, name = np.concatenate((best[touched].ravel(), value)), np.concatenate((best_id[touched].ravel(), found[column]))
    order = np.lexsort((name, -value, at))
    at, value, name = at[order], value[order], name[order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    keep = place < k
    best[touched[at[keep]], place[keep]], best_id[touched[at[keep]], place[keep]] = value[keep], name[keep]


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query, doc, score``: the k vectors of highest cosine for each query vector, itself left out; exact.

    Query vectors are worked off in blocks of ``QUERY_BLOCK``; each task keeps its k best of every
    query, so the shuffle holds k rows a task and query. Scores are made by tiles of ``TILE_QUERIES`` and
    ``TILE_VECTORS``, so a task's memory is the same for any number of queries and vectors.
    """
    queries = queries.select(F.col("vec_id").alias("query"), "embedding").where("size(embedding) > 0")
    vectors = vectors.where("size(embedding) > 0")
    shape = queries.agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most")).first()
    if not shape["n"]:
        return vectors.sparkSession.createDataFrame([], "query long, doc long, score double, rank long")
    if shape["least"] != shape["most"]:
        raise ValueError("query vectors differ in length")
    vectors = vectors.where(F.size("embedding") == shape["most"])  # no cosine between other lengths
    blocks = -(-shape["n"] // QUERY_BLOCK)
    parts = []
    for block in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).collect()
        ids = np.array([r["query"] for r in rows])
        q = np.array([r["embedding"] for r in rows], np.float64).reshape(len(rows), -1)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
        shared = vectors.sparkSession.sparkContext.broadcast((ids, q))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            best, best_id, seen = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64), False
            for batch in batches:
                for v in range(0, batch.num_rows if len(ids) else 0, TILE_VECTORS):
                    part, seen = batch.slice(v, TILE_VECTORS), True
                    x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                    found = part.column(0).to_numpy(zero_copy_only=False)
                    own = np.flatnonzero(np.isin(found, ids))
                    for t in range(0, len(ids), TILE_QUERIES):
                        tile = slice(t, t + TILE_QUERIES)
                        score = q[tile] @ x.T
                        score[:, own] = np.where(found[own] == ids[tile, None], -np.inf, score[:, own])
                        _keep_best(best[tile], best_id[tile], score, found)
            if seen:
                keep = np.isfinite(best)
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids[:, None], best.shape)[keep]), pa.array(best_id[keep]), pa.array(best[keep])], ["query", "doc", "score"])

        parts.append(vectors.where("embedding IS NOT NULL").select("vec_id", "embedding").mapInArrow(search, "query long, doc long, score double"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return top_k(out, k)


def rrf(*ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ``query, doc, rank`` lists."""
    union = ranked[0].select("query", "doc", "rank")
    for other in ranked[1:]:
        union = union.unionByName(other.select("query", "doc", "rank"))
    return union.groupBy("query", "doc").agg(F.sum(1 / (k + F.col("rank"))).alias("score"))


def ranking_quality(ranked: DataFrame, k: int) -> DataFrame:
    """Recall, precision, reciprocal rank and nDCG at k of each query from ``query, rank, relevant, n_relevant``."""
    gain = F.when(F.col("relevant"), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("n_relevant"), F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda t, i: t + 1 / F.log2(i + 1))
    hits = F.count_if("relevant")
    per = ranked.where(F.col("rank") <= k).groupBy("query", "n_relevant").agg(hits.alias("hits"), F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"), F.sum(gain).alias("dcg"))
    return per.select(
        "query",
        F.try_divide("hits", "n_relevant").alias("recall"),
        (F.col("hits") / k).alias("precision"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.when(F.col("n_relevant") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"),
    )
