"""Guards and layout of paged documents: what cannot be indexed, blank pages, headings by their type, and the lines that
run through a document's pages.

Pages are (doc_id, page, text), numbered from 1; spans are (doc_id, page, seq, text, font_size, bold).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as tx

# Bytes and pages that tell a scan from a text, pages looked at, points of a heading, bytes of a page that is
# not blank, share of pages on which a line runs through a document.
SCAN_BYTES, SCAN_PAGES, FIRST_PAGES, HEADING_POINTS, LEAST_BYTES, REPEATED = 100, 2, 5, 14.0, 20, 0.85


def rejections(pages: DataFrame) -> DataFrame:
    """``doc_id, error`` of documents that cannot be indexed: encrypted ones (where a column says so), those without pages
    (a row with a null page), scans of more than two pages, and those without text."""
    size = F.octet_length(tx.squeezed(F.coalesce("text", F.lit(""))))
    locked = F.max(F.coalesce("encrypted", F.lit(False))) if "encrypted" in pages.columns else F.lit(False)
    per = pages.groupBy("doc_id").agg(F.count("page").alias("n"), F.sum(size).alias("size"), locked.alias("locked"))
    few = (F.col("size") < SCAN_BYTES) & (F.col("n") > SCAN_PAGES)
    error = F.when(F.col("locked"), "encrypted").when(F.col("n") == 0, "no pages").when(few, "images only").when(F.col("size") == 0, "no text")
    return per.select("doc_id", error.alias("error")).where("error is not null")


def written_pages(spans: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """``doc_id, page, bytes, kept``: a page of fewer than ``least`` bytes is as good as blank."""
    size = F.sum(F.octet_length(F.coalesce("text", F.lit(""))))
    return spans.groupBy("doc_id", "page").agg(size.alias("bytes")).withColumn("kept", F.col("bytes") >= least)


def _is_heading() -> Column:
    return F.coalesce((F.col("font_size") >= HEADING_POINTS) & F.col("bold"), F.lit(False))


def signals(spans: DataFrame) -> DataFrame:
    """``doc_id, headings, spans_per_page, has_headings, has_tables`` from the first five pages of documents."""
    early = spans.where(F.col("page") <= FIRST_PAGES).groupBy("doc_id").agg(F.count_if(_is_heading()).alias("headings"), F.count(F.lit(1)).alias("spans"))
    pages = spans.groupBy("doc_id").agg(F.least(F.max("page"), F.lit(FIRST_PAGES)).alias("pages"))
    mean = F.coalesce("spans", F.lit(0)) / F.col("pages")
    return pages.join(early, "doc_id", "left").select("doc_id", F.coalesce("headings", F.lit(0)).cast("long").alias("headings"), mean.alias("spans_per_page"), (F.coalesce("headings", F.lit(0)) > 0).alias("has_headings"), (mean > 3.0).alias("has_tables"))


def heading_runs(spans: DataFrame) -> DataFrame:
    """``doc_id, page, seq, font_size, heading``: neighbouring heading spans of one size on one of the first five pages are
    one heading, joined by spaces; ``seq`` is the first one's."""
    page = Window.partitionBy("doc_id", "page").orderBy("seq")
    mine = F.when(_is_heading(), F.col("font_size"))
    begins = ~F.coalesce(mine.eqNullSafe(F.lag(mine).over(page)), F.lit(False)) | (F.row_number().over(page) == 1)
    marked = spans.where(F.col("page") <= FIRST_PAGES).withColumns({"__b": begins, "__h": _is_heading()}).withColumn("__run", F.count_if(F.col("__b")).over(page))
    runs = marked.where("__h").groupBy("doc_id", "page", "__run").agg(F.min("seq").alias("seq"), F.first("font_size").alias("font_size"), F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("all"))
    return runs.select("doc_id", "page", "seq", "font_size", tx.squeezed(F.array_join(F.col("all.text"), " ")).alias("heading"))


def _edge_lines(text: Column, edge: int) -> Column:
    """The first and last lines of a page that are not blank, with their numbers in masks."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), _masked), lambda x: x != "")
    return F.array_distinct(F.concat(F.slice(lines, 1, edge), F.reverse(F.slice(F.reverse(lines), 1, edge))))


def _masked(line: Column) -> Column:
    return F.regexp_replace(tx.squeezed(line), "[0-9]+", "#")


def running_lines(pages: DataFrame, share: float = REPEATED, edge: int = 2, least: int = 3) -> DataFrame:
    """``doc_id, line``: what stands, but for its numbers, among the ``edge`` first or last lines of this share of a
    document's pages, and of at least ``least`` of them: running heads, footers and page numbers."""
    total = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"))
    each = pages.select("doc_id", F.explode(_edge_lines(F.col("text"), edge)).alias("line")).groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n"))
    return each.join(total, "doc_id").where((F.col("n") >= least) & (F.col("n") >= share * F.col("pages"))).select("doc_id", "line")


def without_running_lines(pages: DataFrame, share: float = REPEATED, edge: int = 2, least: int = 3) -> DataFrame:
    """pages with their running lines taken out of the first and last lines; a document has at most 2 * edge / share of
    them, which bounds the list that its pages carry."""
    lists = running_lines(pages, share, edge, least).groupBy("doc_id").agg(F.collect_set("line").alias("__r"))
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("t"), _masked(x).alias("m"), i.alias("i")))
    places = F.transform(F.filter("__l", lambda x: x["m"] != ""), lambda x: x["i"])
    edges = F.concat(F.slice("__p", 1, edge), F.slice(F.reverse("__p"), 1, edge))
    joined = pages.join(lists, "doc_id", "left").withColumn("__l", lines).withColumn("__p", places)
    kept = F.filter("__l", lambda x: ~(F.array_contains(edges, x["i"]) & F.array_contains("__r", x["m"])))
    text = F.when(F.col("__r").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda x: x["t"]), "\n"))
    return joined.withColumn("text", text).select(*pages.columns)
