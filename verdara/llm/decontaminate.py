"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A seed mask keeps some of the token positions of a short span and ignores the others, so a
substituted token on an ignored position does not hide a hit. Hashes of the kept tokens of every
span of every document are joined with those of the benchmark; each hit fixes a diagonal, along
which the two token sequences are compared. A document is contaminated by an item if somewhere on
a diagonal a window of ``window`` tokens (the whole item, if shorter) agrees in at least
``agree`` of its tokens; tokens beyond an edge of the document do not agree.

The masks are complete for the default window and share: whichever 3 of 12 tokens differ, some mask
has a place inside the window that keeps none of them, and likewise for items of 7 to 11 tokens, which
have masks of their own. So every diagonal that meets the definition has a hit (a test enumerates all
patterns). Other windows or shares need other masks.

The benchmark's seeds are broadcast only if their counted number is below ``broadcast_seeds``;
beyond that they are joined by shuffle. Either way every span of every whole text takes part.

Items of fewer than 7 tokens are found only whole, by a mask that keeps every token.

Defined cases: tokens are lower-cased and split at ASCII white space; null or empty texts and items and
texts shorter than every mask have no seed and no hit; very long texts take part whole; rows with an equal
doc_id and different texts are compared one by one; repeated rows and ties are reported once per doc_id and
item, with the best window; null ids never match; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Masks over token positions, 1 = kept: for any 3 substituted tokens of 12, and for any fourth of an item of 7 to 11.
MASKS = ("101111", "111001001", "110000010011", "110110001")
SHORT_MASKS = ("1111", "11101", "1010011")
#: Least tokens of an item in which tokens may differ.
SHORTEST = 7


def token_hashes(text: str | Column = "text") -> Column:
    """64-bit hash of every token of a text, in order."""
    text = F.col(text) if isinstance(text, str) else text
    tokens = F.split(F.regexp_replace(F.lower(text), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+")
    return F.coalesce(F.transform(F.filter(tokens, lambda t: t != ""), lambda t: F.xxhash64(t)), F.array().cast("array<bigint>"))


def seeds(rows: DataFrame, hashes: str, masks: tuple[str, ...]) -> DataFrame:
    """``rows`` times the seeds of their token hashes: position ``pos`` and hash ``seed``."""
    h, at = F.col(hashes), F.col("pos")
    placed = rows.withColumn("pos", F.explode(F.sequence(F.lit(0), F.size(h) - min(map(len, masks)))))
    keyed = [
        F.when(at + len(mask) <= F.size(h), F.xxhash64(F.lit(mask), *(F.get(h, at + k) for k, bit in enumerate(mask) if bit == "1")))
        for mask in masks
    ]
    return placed.withColumn("seed", F.explode(F.array(*keyed))).where("seed IS NOT NULL")


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    masks: tuple[str, ...] = MASKS,
    window: int = 12,
    agree: float = 0.75,
    broadcast_seeds: int = 500_000,
) -> DataFrame:
    """``doc_id, item_id, matched, compared``: the best window of every contaminated document and item."""
    items = benchmark.where("item_id IS NOT NULL").select("item_id", token_hashes().alias("item")).where(F.size("item") > 0).withColumn("n_item", F.size("item"))
    keyed = seeds(items.where(F.col("n_item") >= window), "item", masks)
    short = items.where(F.col("n_item") < window)
    for n in sorted(r["n_item"] for r in short.select("n_item").distinct().collect()):  # fewer than ``window`` numbers; only then do the documents need these seeds as well
        own = SHORT_MASKS if n >= SHORTEST else ("1" * n,)
        keyed = keyed.unionByName(seeds(short.where(F.col("n_item") == n), "item", own))
        masks += tuple(mask for mask in own if mask not in masks)
    keyed = keyed.select("seed", "item_id", F.col("pos").alias("item_pos"), "n_item")
    small = keyed.limit(broadcast_seeds + 1).count() <= broadcast_seeds
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("doc_id", "text").alias("row"), token_hashes().alias("doc")).where(F.size("doc") >= min(map(len, masks)))
    # The part of the item that lies inside the document, and the document's tokens opposite to it. Only
    # these few tokens leave the scan's stage, one copy a diagonal; whole texts are never shuffled.
    offset = F.col("pos") - F.col("item_pos")
    first = F.greatest(-offset, F.lit(0))
    length = F.least(F.col("n_item"), F.size("doc") - offset) - first
    if small:
        hits = seeds(texts, "doc", masks).join(F.broadcast(keyed), "seed")
        hits = hits.select("doc_id", "row", "item_id", offset.alias("offset"), F.slice("doc", offset + first + 1, length).alias("opposite"))
        hits = hits.groupBy("doc_id", "row", "item_id", "offset").agg(F.first("opposite").alias("opposite"))
    else:
        lean = seeds(texts, "doc", masks).select("row", "pos", "seed").join(keyed, "seed")
        lean = lean.groupBy("row", "item_id", offset.alias("pos")).agg(F.first("n_item").alias("n_item")).withColumn("item_pos", F.lit(0))
        hits = lean.join(texts, "row").select("doc_id", "item_id", offset.alias("offset"), F.slice("doc", offset + first + 1, length).alias("opposite"))
    items = F.broadcast(items) if small else items
    aligned = hits.join(items, "item_id").select("doc_id", "item_id", "n_item", F.zip_with(F.slice("item", F.greatest(-F.col("offset"), F.lit(0)) + 1, F.size("opposite")), "opposite", lambda a, b: (a == b).cast("int")).alias("same"))
    width = F.least(F.lit(window), F.col("n_item"))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.greatest(F.size("same") - width + 1, F.lit(1))), lambda i: F.aggregate(F.slice("same", i, width), F.lit(0), lambda t, v: t + v)))
    scored = aligned.select("doc_id", "item_id", width.alias("compared"), best.alias("matched"))
    worst = scored.groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.max("compared").alias("compared"))
    enough = F.when(F.col("compared") < SHORTEST, F.col("compared")).otherwise(F.ceil(F.lit(agree) * F.col("compared")))
    return worst.where(F.col("matched") >= enough)


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Contaminated documents of the whole table with the items found in each."""
    found = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("matched").alias("matched"))
