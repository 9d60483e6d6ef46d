"""A full-text index in segments of blocks: top-k search that skips blocks, and upkeep without building anew.

Documents are dealt into bands by a hash of their id, some ``BAND`` to each; a block holds the postings of a term in a
band, with the largest frequency and the least length among them.  These bound the BM25 part of any document of the
block, whatever the statistics of the corpus are, so that they stay right when documents come and go.

Search reads the blocks' headers of its terms and sums the bounds by band.  The k bands of the greatest sums are scored
first; their k-th best score is a threshold, and of the other bands only those are scored whose bound reaches it.  The
result is that of scoring every posting, ties included.

Upkeep.  New documents are a segment of their own.  Deleted ones are listed, and what they counted in frequencies and
lengths is taken off, from the blocks of their bands alone.  An update is both.  Segments of a size, up to
``TIER`` times apart, are merged when there are ``TIER`` of them, so that a document is written again as often as the
logarithm of the number of segments.  Nothing is changed in place: each operation returns new tables.  Blocks are written
when they are built or merged, as every later operation reads them.

A block of ``EVERY``, which is no term, has the documents of a band with text in a field.  They give a segment's sizes,
and say what a deletion finds, so that only blocks with such documents are opened.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.query import index_terms, sanitise
from vellum.operators import fulltext
from vellum.operators.fulltext import B, K1
from vellum.staging import staged

#: Documents of a band; segments of a tier that are merged.
BAND, TIER = 64, 4
#: The term of the blocks of all documents.
EVERY = ""


@dataclass
class BlockIndex:
    """``blocks``: segment, bands, band, field, term, n, max_tf, min_len, docs (doc_id, tf, len) per term and band;
    ``sizes``: segment, bands, field, n_docs, total_len, with negative rows for what was deleted;
    ``gone``: segment, doc_id that count no more; ``less``: segment, field, term, n of their postings."""

    blocks: DataFrame
    sizes: DataFrame
    gone: DataFrame
    less: DataFrame


def band_of(doc_id: Column, bands: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), bands).cast("int")


def _blocks(placed: DataFrame, segment: int, bands: int) -> DataFrame:
    """Written blocks of postings (band, field, term, doc_id, tf, len) that are dealt out by bands, so that a task has whole
    blocks."""
    each = placed.groupBy("field", "term", "band").agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len"), F.collect_list(F.struct("doc_id", "tf", "len")).alias("docs"))
    return staged(each.select(F.lit(segment).alias("segment"), F.lit(bands).alias("bands"), "band", "field", "term", "n", "max_tf", "min_len", "docs"), "index-blocks")


def _listed(blocks: DataFrame) -> DataFrame:
    """``segment, band, field, doc_id, len`` of all documents with text in a field."""
    return blocks.where(F.col("term") == EVERY).select("segment", "band", "field", F.explode("docs").alias("d")).select("segment", "band", "field", "d.doc_id", "d.len")


def build(df: DataFrame, fields: list[str], segment: int = 0, id_col: str = "id", band: int = BAND) -> BlockIndex:
    """A segment of some documents' text fields; the id is a key of df.  Texts are shuffled, and their postings not."""
    bands = max(1, math.ceil(df.count() / band))
    texts = fulltext.texts_by_field(df, fields, id_col, band_of(F.col(id_col), F.lit(bands)).alias("band"))
    every = lambda t: F.struct(F.lit(EVERY).alias("term"), F.lit(0).cast("long").alias("tf"), t["len"].alias("len"))
    words = F.transform(F.array(fulltext.counted(F.col("text"))), lambda ts: F.concat(F.transform(F.slice(ts, 1, 1), every), ts))[0]
    # an inner explode would ask for the number of terms first, and count them twice
    rows = texts.select("doc_id", "band", "field", F.explode_outer(words).alias("t")).where("t is not null")
    blocks = _blocks(rows.select("doc_id", "band", "field", "t.*"), segment, bands)
    sizes = _listed(blocks).groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("len").alias("total_len"))
    sizes = staged(sizes.select(F.lit(segment).alias("segment"), F.lit(bands).alias("bands"), "field", "n_docs", "total_len"), "index-sizes")
    gone = blocks.select("segment", F.col("docs")[0]["doc_id"].alias("doc_id")).where(F.lit(False))
    return BlockIndex(blocks, sizes, gone, blocks.select("segment", "field", "term", "n").where(F.lit(False)))


def inserted(index: BlockIndex, new: BlockIndex) -> BlockIndex:
    """The index with a segment more."""
    return BlockIndex(*(getattr(index, x).unionByName(getattr(new, x)) for x in ("blocks", "sizes", "gone", "less")))


def _postings(blocks: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """``segment, field, term, doc_id, tf, len`` of the documents, without those that are gone."""
    rows = blocks.select("segment", "field", "term", F.explode("docs").alias("d")).select("segment", "field", "term", "d.*")
    return rows if gone is None else rows.join(gone, ["segment", "doc_id"], "left_anti")


def deleted(index: BlockIndex, ids: DataFrame) -> BlockIndex:
    """The index without some documents (id); only blocks of their bands are read."""
    segments = index.sizes.select("segment", "bands").distinct()
    # a row for each segment and id
    wanted = ids.select(F.col("id").alias("doc_id")).distinct().crossJoin(F.broadcast(segments)).withColumn("band", band_of(F.col("doc_id"), F.col("bands")))
    listed = _listed(index.blocks).join(index.gone, ["segment", "doc_id"], "left_anti")
    found = staged(listed.join(wanted.select("segment", "doc_id"), ["segment", "doc_id"], "left_semi"), "index-found")
    near = index.blocks.where(F.col("term") != EVERY).join(found.select("segment", "band").distinct(), ["segment", "band"], "left_semi")
    # a document counts once in each segment that it was in
    gone = staged(found.select("segment", "doc_id").distinct(), "index-gone")
    lost = _postings(near).join(gone, ["segment", "doc_id"], "left_semi")
    less = staged(lost.groupBy("segment", "field", "term").agg(F.count(F.lit(1)).alias("n")), "index-less")
    sizes = found.groupBy("segment", "field").agg((-F.count(F.lit(1))).alias("n_docs"), (-F.sum("len")).alias("total_len")).join(segments, "segment")
    return BlockIndex(index.blocks, index.sizes.unionByName(staged(sizes.select(*index.sizes.columns), "index-sizes")), index.gone.unionByName(gone), index.less.unionByName(less))


def updated(index: BlockIndex, df: DataFrame, fields: list[str], segment: int, id_col: str = "id") -> BlockIndex:
    """The index with documents in place of those with their ids."""
    return inserted(deleted(index, df.select(F.col(id_col).alias("id"))), build(df, fields, segment, id_col))


def tiers(index: BlockIndex, tier: int = TIER) -> list[list[int]]:
    """The groups of segments to be merged: ``tier`` or more of one order of magnitude of live documents; a row for each
    segment is read."""
    rows = index.sizes.groupBy("segment", "field").agg(F.sum("n_docs").alias("n")).groupBy("segment").agg(F.max("n").alias("n")).collect()
    groups: dict[int, list[int]] = {}
    for r in rows:
        groups.setdefault(int(math.log(max(r["n"], 1), tier) + 1e-9), []).append(r["segment"])
    return sorted(sorted(g) for g in groups.values() if len(g) >= tier)


def merged(index: BlockIndex, segments: list[int], number: int, band: int = BAND) -> BlockIndex:
    """The index with some of its segments as one, in which deleted documents leave no trace."""
    among = F.col("segment").isin(segments)
    rows = _postings(index.blocks.where(among), index.gone.where(among))
    own = index.sizes.where(among).groupBy("field").agg(F.sum("n_docs").alias("n_docs"), F.sum("total_len").alias("total_len"))
    bands = max(1, math.ceil((own.agg(F.max("n_docs")).first()[0] or 0) / band))
    sizes = own.select(F.lit(number).alias("segment"), F.lit(bands).alias("bands"), "field", "n_docs", "total_len")
    placed = rows.drop("segment").withColumn("band", band_of(F.col("doc_id"), F.lit(bands))).repartition("band")
    return BlockIndex(
        index.blocks.where(~among).unionByName(_blocks(placed, number, bands)),
        index.sizes.where(~among).unionByName(sizes),
        index.gone.where(~among),
        index.less.where(~among),
    )


def maintained(index: BlockIndex, tier: int = TIER) -> BlockIndex:
    """The index after the merges that its sizes ask for."""
    number = index.sizes.agg(F.max("segment")).first()[0] or 0
    for k, group in enumerate(tiers(index, tier)):
        index = merged(index, group, number + 1 + k)
    return index


def frequencies(index: BlockIndex) -> DataFrame:
    """``field, term, n``: documents with each term."""
    both = index.blocks.where(F.col("term") != EVERY).select("field", "term", "n").unionByName(index.less.select("field", "term", (-F.col("n")).alias("n")))
    return both.groupBy("field", "term").agg(F.sum("n").alias("n")).where("n > 0")


def _part(tf: str, length: str) -> Column:
    return F.col("idf") * F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(length) / F.col("avg_len")))


def _weights(index: BlockIndex, terms: list[str]) -> DataFrame:
    """``field, term, idf, avg_len``: a row for each field and term of a query."""
    corpus = index.sizes.groupBy("field").agg(F.sum("n_docs").alias("n_docs"), (F.sum("total_len") / F.sum("n_docs")).alias("avg_len"))
    of_query = BlockIndex(index.blocks.where(F.col("term").isin(terms)), index.sizes, index.gone, index.less.where(F.col("term").isin(terms)))
    idf = F.log(1 + (F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    return frequencies(of_query).join(F.broadcast(corpus), "field").select("field", "term", idf.alias("idf"), "avg_len")


def _scored(index: BlockIndex, terms: list[str], bands: DataFrame, weights: DataFrame) -> DataFrame:
    """``doc_id, score`` of the documents of some bands."""
    chosen = index.blocks.where(F.col("term").isin(terms)).join(bands.select("segment", "band"), ["segment", "band"], "left_semi")
    hits = _postings(chosen, index.gone).join(F.broadcast(weights), ["field", "term"])
    return hits.groupBy("doc_id").agg(F.sum(_part("tf", "len")).alias("score"))


def search(index: BlockIndex, text: str, k: int, report: dict | None = None) -> DataFrame:
    """``doc_id, score`` of the k best documents that have any of the query's terms; scores are compared to nine places.
    report gets the numbers of bands and of postings, and of those that were scored."""
    terms = sorted({t for w in sanitise(text).terms for t in index_terms(w)})
    weights = staged(_weights(index, terms), "index-weights")
    headers = index.blocks.where(F.col("term").isin(terms)).select("segment", "band", "field", "term", "n", "max_tf", "min_len").join(F.broadcast(weights), ["field", "term"])
    bounds = staged(headers.groupBy("segment", "band").agg(F.sum(_part("max_tf", "min_len")).alias("bound"), F.sum("n").alias("n")), "index-bounds")
    best = [F.desc("score"), F.asc("doc_id")]
    first = staged(bounds.orderBy(F.desc("bound"), "segment", "band").limit(max(1, k)), "index-first")
    found = staged(_scored(index, terms, first, weights).withColumn("score", F.round("score", 9)).orderBy(*best).limit(k), "index-found")
    kth = found.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).first()
    least = kth["least"] if kth["n"] >= k else 0.0
    rest = bounds.where(F.col("bound") >= least - 1e-8).join(first.select("segment", "band"), ["segment", "band"], "left_anti")
    if report is not None:
        scored = first.select("n").unionAll(rest.select("n")).agg(F.count(F.lit(1)).alias("bands"), F.sum("n").alias("postings")).first()
        every = bounds.agg(F.count(F.lit(1)).alias("bands"), F.sum("n").alias("postings")).first()
        report |= {"bands": every["bands"], "postings": every["postings"], "scored_bands": scored["bands"], "scored_postings": scored["postings"]}
    out = found.unionByName(_scored(index, terms, rest, weights).withColumn("score", F.round("score", 9)))
    return out.orderBy(*best).limit(k)
