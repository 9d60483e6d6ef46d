"""The page that a figure is on, found by its label and caption.

A page's references are exploded by the word after "figure" or "fig", and figures meet them by document and word; whole
pages are compared with captions only for figures whose label is on no page of their document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.staging import staged

# The shares of a caption's 4-grams that are enough, alone and near an image, and that end a search; the words
# after a label; the fewest words of a caption; the bytes below which a page holds only its figure.
SURE, NEAR_IMAGE, CERTAIN = 0.8, 0.5, 0.95
WINDOW, LEAST_WORDS, SPARSE = 40, 10, 300
DELIMITERS = r"[|:.—–]"


def page_index(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, page, text, n_images) with normalised text, bytes, and whether an image is on them."""
    index = pages.select("doc_id", "page", F.coalesce("text", F.lit("")).alias("raw_text"), (F.coalesce("n_images", F.lit(0)) > 0).alias("has_image"))
    return index.select("doc_id", "page", "raw_text", tx.normalised(F.col("raw_text")).alias("text"), F.octet_length("raw_text").alias("bytes"), "has_image")


def _shown(scored: DataFrame, index: DataFrame) -> DataFrame:
    """scored (doc_id, page, score) and whether an image is on the page or next to it, or nowhere in its document: met
    by scores, as texts need not be shuffled for it."""
    with_image = index.where("has_image").select("doc_id", "page")
    near = with_image.select("doc_id", F.explode(F.array(F.col("page") - 1, "page", F.col("page") + 1)).alias("page")).distinct().withColumn("near_image", F.lit(True))
    some = with_image.select("doc_id").distinct().withColumn("any_image", F.lit(True))
    joined = scored.join(near, ["doc_id", "page"], "left").join(some, "doc_id", "left")
    return joined.withColumn("shown", F.col("near_image").isNotNull() | F.col("any_image").isNull()).drop("near_image", "any_image")


def _wanted(figures: DataFrame) -> DataFrame:
    """``id, doc_id, needle, label, tokens, grams``; without a column ``label`` it is the number at the caption's start."""
    number = F.regexp_extract(F.coalesce("caption", F.lit("")), r"(?i)^\s*(?:supplementary\s+)?(?:figure|fig\.?)\s*(s?\d+[a-z]?)\b", 1)
    label = F.coalesce("label", F.lit("")) if "label" in figures.columns else number
    tokens = F.filter(F.transform(F.split(label, r"\s+"), lambda x: F.lower(F.regexp_replace(x, "[^A-Za-z0-9]", ""))), lambda x: x != "")
    wanted = figures.select("id", "doc_id", F.coalesce(tx.caption_needle(F.coalesce("caption", F.lit(""))), F.lit("")).alias("needle"), tx.normalised(label).alias("label"), tokens.alias("tokens"))
    return wanted.withColumn("grams", F.size(tx.ngrams(F.col("needle"))))


def _names_figures(words: Column) -> Column:
    return F.array_contains(words, "figure") | F.array_contains(words, "fig")


def _accepted(score: Column) -> Column:
    return (score >= SURE) | ((score >= NEAR_IMAGE) & F.col("shown"))


def _first_words(text: Column) -> Column:
    return F.array_join(F.slice(F.split(F.trim(text), " "), 1, WINDOW), " ")


def _by_label(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """``id, page`` of figures whose label is on some page of their document; null where no caption follows it."""
    words = F.split("label", " ")
    patterns = F.concat(F.array(F.concat(F.lit("figure "), "label"), F.concat(F.lit("fig "), "label")), F.when(_names_figures(words), F.array("label")).otherwise(F.array().cast("array<string>")))
    asked = wanted.where("label <> ''").select("id", "doc_id", "needle", "grams", F.posexplode(patterns).alias("nth", "pattern")).where("pattern like '% %'")
    asked = asked.withColumn("key", F.regexp_extract("pattern", "(?:^| )(?:figure|fig) ([a-z0-9]+)", 1))
    keys = F.array_distinct(F.regexp_extract_all("text", F.lit("(?<![a-z0-9])(?:figure|fig)(?= ([a-z0-9]+))"), 1))
    # pages of a document are met without a word only by its labels that have none after "figure"
    named = index.where(F.col("text").rlike("(?<![a-z0-9])(?:figure|fig)(?![a-z0-9])")).select("doc_id", "page", "text")
    wordless = named.join(asked.where("key = ''").select("doc_id").distinct(), "doc_id", "left_semi").withColumn("key", F.lit(""))
    referring = index.select("doc_id", "page", "text", F.explode(keys).alias("key")).unionByName(wordless)
    after = F.concat(F.lit("(?<![a-z0-9])"), "pattern", F.lit(rf"(?![a-z0-9])(?=((?:\s*\S+){{0,{WINDOW}}}))"))
    met = asked.join(referring, ["doc_id", "key"]).where(F.contains("text", "pattern"))
    found = met.select("id", "doc_id", "needle", "grams", "nth", "page", F.explode(F.regexp_extract_all("text", after, 1)).alias("window")).withColumn("window", F.trim("window"))
    # a window that has all of the caption, or too few n-grams for what is enough of it, is not compared by n-grams
    whole = (F.col("needle") != "") & F.contains("window", "needle")
    score = F.when(whole, 1.0).when(F.char_length("window") - 3 < NEAR_IMAGE * F.col("grams"), 0.0).otherwise(tx.containment(F.col("needle"), F.col("window")))
    scored = _shown(found.select("id", "doc_id", "nth", "page", score.alias("score")), index)
    order = F.struct((-F.col("score")).alias("s"), "nth", "page")
    return scored.groupBy("id").agg(F.min_by("page", F.when(_accepted(F.col("score")), order)).alias("page"))


def _by_structure(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """``id, page`` where the label opens a line, a delimiter follows it, and text that delimiter."""
    opened = F.when(_names_figures(F.col("tokens")), F.lit("")).otherwise(F.lit("(?:figure|fig)[^A-Za-z0-9]+"))
    line = F.concat(F.lit(r"(?is)(?:^|\n)[^\S\n]*"), opened, F.array_join("tokens", "[^A-Za-z0-9]+"), F.lit(rf"[ \t]*{DELIMITERS}(?=(.*))"))
    rests = wanted.where(F.size("tokens") > 0).join(index, "doc_id").select("id", "needle", "page", F.explode(F.regexp_extract_all("raw_text", line, 1)).alias("rest"))
    windows = rests.select("id", "needle", "page", _first_words(tx.normalised(F.col("rest"))).alias("window")).where(F.size(F.split("window", " ")) >= LEAST_WORDS)
    return windows.groupBy("id").agg(F.min_by("page", F.struct((-tx.containment(F.col("needle"), F.col("window"))).alias("s"), "page")).alias("page"))


def _by_caption(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """``id, page`` with enough of the caption anywhere; the first page that has nearly all of it ends the search."""
    scored = wanted.where("needle like '% %'").join(index, "doc_id").select("id", "doc_id", "page", tx.containment(F.col("needle"), F.col("text")).alias("score"))
    scored = _shown(scored.where(F.col("score") >= NEAR_IMAGE), index).where(_accepted(F.col("score")))
    rank = F.when(F.col("score") >= CERTAIN, F.lit(-2.0)).otherwise(-F.col("score"))
    return scored.groupBy("id").agg(F.min_by("page", F.struct(rank.alias("s"), "page")).alias("page"))


def figure_pages(figures: DataFrame, pages: DataFrame) -> DataFrame:
    """``id, page`` of the figures (id, doc_id, caption, label perhaps) that are found on pages (doc_id, page, text,
    n_images), pages numbered one by one.

    1. Where the label stands as whole words, the next 40 words are compared with the caption, so that a reference in
       running text loses to the caption itself; the best is taken, of equal ones the first.
    2. If no place of the label is good enough, a line that begins with it and a delimiter is.
    3. If the label is on no page, the page with most of the caption is taken.

    A page of few bytes before the one found has the figure itself, and is given instead.  Null captions and labels are
    empty ones; a figure with neither is not found."""
    # read by each of the three ways, and worth more to write than to derive for every pair of figure and page
    wanted, index = staged(_wanted(figures), "figures-wanted"), staged(page_index(pages), "figure-index")
    labelled = staged(_by_label(wanted, index), "figures-labelled")
    lost = _by_structure(wanted.join(labelled.where("page is null"), "id", "left_semi"), index)
    rest = _by_caption(wanted.join(labelled, "id", "left_anti"), index)
    found = labelled.where("page is not null").unionByName(lost).unionByName(rest)
    before = index.select("doc_id", (F.col("page") + 1).alias("page"), (F.col("bytes") < SPARSE).alias("sparse"))
    placed = found.join(wanted.select("id", "doc_id"), "id").join(before, ["doc_id", "page"], "left")
    return placed.select("id", F.when(F.col("sparse"), F.col("page") - 1).otherwise(F.col("page")).alias("page"))
