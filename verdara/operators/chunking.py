"""Documents to chunks: headings carried forward, a chunk per heading, and word-bounded chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdara.functions.text import is_chapter, is_heading, is_section, lines
from verdara.operators.retrieval import scratch


def numbered_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(doc).alias("doc"), F.posexplode(lines(F.col(text))).alias("line_no", "line"))


def carry_headings(rows: DataFrame) -> DataFrame:
    """Adds the chapter and section in force at every line of ``doc, line_no, line``; both pass over page ends."""
    w = Window.partitionBy("doc").orderBy("line_no")
    keep = lambda opens: F.last(F.when(opens(F.col("line")), F.trim("line")), ignorenulls=True).over(w)
    return rows.withColumn("chapter", keep(is_chapter)).withColumn("section", keep(is_section))


def heading_chunks(rows: DataFrame) -> DataFrame:
    """A chunk from each heading line to the next; ``doc, chunk_no, heading, n_lines, text``."""
    w = Window.partitionBy("doc").orderBy("line_no")
    numbered = rows.withColumn("chunk_no", F.sum(is_heading(F.col("line")).cast("int")).over(w))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    made = numbered.groupBy("doc", "chunk_no").agg(ordered.alias("parts"))
    first = F.col("parts")[0]["line"]
    return made.select("doc", "chunk_no", F.when(is_heading(first), F.trim(first)).alias("heading"), F.size("parts").alias("n_lines"), F.array_join("parts.line", "\n").alias("text"))


def breadcrumb(title: str, chapter: str, section: str):
    return F.concat_ws(" > ", title, F.coalesce(chapter, F.lit("General")), F.coalesce(section, F.lit("General")))


def chunk_id(doc: str, section: str):
    return F.regexp_replace(F.concat_ws("_", doc, section), r"\s+", "_")


def _ranges(counts: Column, words: int, overlap: int) -> Column:
    """First and last line of each chunk of a page, from its lines' numbers of words: a fold that closes a chunk at ``words`` words and at the page's end."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda n, count: n + count)
    span = lambda first, last: F.array(F.struct(first.alias("first"), last.alias("last")))
    start = F.struct(F.lit(1).alias("first"), F.lit(0).alias("at"), F.lit(0).alias("n"), F.array().cast("array<struct<first:int,last:int>>").alias("done"))

    def step(s: Column, count: Column) -> Column:
        at, n = s["at"] + 1, s["n"] + count
        full, repeats = n >= words, at - s["first"] + 1 > overlap
        first = F.when(~full, s["first"]).when(repeats, at - overlap + 1).otherwise(at + 1)
        held = F.when(~full, n).when(repeats, total(F.slice(counts, at - overlap + 1, F.lit(overlap)))).otherwise(0)
        done = F.when(full, F.concat(s["done"], span(s["first"], at))).otherwise(s["done"])
        return F.struct(first.alias("first"), at.alias("at"), held.alias("n"), done.alias("done"))

    return F.aggregate(counts, start, step, lambda s: F.when(s["first"] <= s["at"], F.concat(s["done"], span(s["first"], s["at"]))).otherwise(s["done"]))


def word_chunks(pages: DataFrame, words: int = 600, overlap: int = 3, doc: str = "doc_id", page: str = "page_no", text: str = "text") -> DataFrame:
    """``doc, page, chunk_no, chapter, section, n_lines, text``: pages cut at ``words`` words.

    Lines are trimmed, empty ones dropped. A chunk that is closed inside a page leaves its last ``overlap`` lines to the next one, if it has
    more; a page's end closes what is left, repeated lines included. Chunks are numbered from 1 through the pages of a document, and the
    chapter and section in force at a chunk's last line pass over page ends. Pages without a line (null texts too) have no chunk; pages of
    equal number follow by the hash of their text, equal rows count once; a NULL document is one document.

    A page is cut by itself, once, and written to the session's shared folder. Only its last headings and its number of chunks are put in order within a document, so no text is sorted,
    and a document of very many pages stays spread.
    """
    trimmed = F.filter(F.transform(lines(F.col(text)), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    key = ["doc", "page", "_hash"]
    one = pages.select(F.col(doc).alias("doc"), F.col(page).alias("page"), F.md5(F.col(text)).alias("_hash"), trimmed.alias("_lines")).where(F.size("_lines") > 0)
    one = one.groupBy(*key).agg(F.first("_lines").alias("_lines"))
    # The generator makes the numbers of words once for all that the fold asks of them.
    one = one.select(*key, "_lines", F.explode(F.array(F.transform("_lines", lambda s: F.size(F.split(s, r"\s+"))))).alias("_counts"))
    one = one.select(*key, "_lines", _ranges(F.col("_counts"), words, overlap).alias("_ranges"))

    def opened(by: Callable[[Column], Column], most: int) -> Column:
        placed = F.transform("_lines", lambda s, i: F.when(by(s), F.struct((i + 1).alias("at"), F.substring(s, 1, most).alias("line"))))
        return F.filter(placed, lambda x: x.isNotNull())

    made = one.withColumns({"_chapters": opened(lambda s: is_chapter(s, whole=False), 80), "_sections": opened(lambda s: is_section(s, ("section", "paragraph")), 100)})
    path = scratch(pages.sparkSession, "chunks")
    made.write.parquet(path)  # read twice below; without it every page would be read and cut twice
    made = pages.sparkSession.read.schema(made.schema).parquet(path)
    last = lambda found: F.get(found, F.size(found) - 1)["line"]
    before = Window.partitionBy("doc").orderBy("page", "_hash").rowsBetween(Window.unboundedPreceding, -1)
    slim = made.select(*key, F.size("_ranges").alias("n"), last(F.col("_chapters")).alias("c"), last(F.col("_sections")).alias("s"))
    slim = slim.select(*(F.col(k).alias(f"k{k}") for k in key), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n"), F.last("c", ignorenulls=True).over(before).alias("_c"), F.last("s", ignorenulls=True).over(before).alias("_s"))
    joined = made.join(slim, [F.col(k).eqNullSafe(F.col(f"k{k}")) for k in key])
    rows = joined.select("doc", "page", "_n", "_c", "_s", "_lines", "_chapters", "_sections", F.posexplode("_ranges").alias("_i", "_r"))
    force = lambda found, prior, name: F.coalesce(last(F.filter(found, lambda x: x["at"] <= F.col("_r.last"))), F.col(prior), F.lit(name))
    size = F.col("_r.last") - F.col("_r.first") + 1
    body = F.array_join(F.slice(F.col("_lines"), F.col("_r.first"), size), "\n")
    return rows.select("doc", "page", (F.col("_n") + F.col("_i") + 1).alias("chunk_no"), force(F.col("_chapters"), "_c", "General").alias("chapter"), force(F.col("_sections"), "_s", "Main Provisions").alias("section"), size.alias("n_lines"), body.alias("text"))
