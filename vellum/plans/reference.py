"""Registered queries whose SQL is written from the rule itself: file lookup, figure ids, headings, hierarchies, and the
graph of all papers."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.operators import blockindex, graph, listing
from vellum.plans import library as lib
from vellum.plans.further import _FOCUS
from vellum.plans.queries import _BM25, _POSTINGS, _TEXT_QUERY, _TEXT_WORDS, query
from vellum.sources import lookup, readers

# Papers are looked up by a made-up id and DOI; files are named after titles, ids, DOIs and nothing, in nested folders.
_LOOKUP_ID, _LOOKUP_DOI = "'item' || lpad(CAST(doc_id AS VARCHAR), 7, '0')", "'10.' || CAST(doc_id % 90 AS VARCHAR) || '/X' || CAST(doc_id * 7 AS VARCHAR)"


@query("papers", f"""WITH p AS (SELECT {_LOOKUP_ID} AS id, {_LOOKUP_DOI} AS doi, title, doc_id FROM papers),
    f AS (SELECT CASE doc_id % 2 WHEN 0 THEN '/b/' ELSE '/a/' END || repeat('sub/', CAST(doc_id % 8 AS INTEGER)) || CASE doc_id % 5 WHEN 0 THEN 'Copy_of_' || replace(substring(title, 1, 40), ' ', '_') WHEN 1 THEN upper(id) WHEN 2 THEN replace(doi, '/', '_') WHEN 3 THEN 'scan ' || CAST(doc_id AS VARCHAR) ELSE replace(substring(title, 3, 25), '/', '-') END
      || CASE WHEN doc_id % 11 = 0 THEN '.PDF' ELSE '.pdf' END AS path, doc_id % 8 AS depth, CASE doc_id % 2 WHEN 0 THEN 0 ELSE 1 END AS place FROM p),
    g AS (SELECT path, place, lower(regexp_extract(path, '([^/]+)$', 1)) AS name FROM f WHERE suffix(path, '.pdf') AND depth + 1 <= 6),
    t AS (SELECT DISTINCT id, lower(unnest([replace(substring(title, 1, 40), ' ', '_'), id, replace(doi, '/', '_')])) AS term FROM p)
    SELECT id, min({{'place': place, 'path': path}}).path AS path FROM t JOIN g ON term <> '' AND contains(name, term) GROUP BY 1""".replace("WITH p AS", ", p AS", 1))
def found_files(spark, d):
    i = F.col("doc_id")
    p = lib.papers(spark, d).select(F.concat(F.lit("item"), F.lpad(i.cast("string"), 7, "0")).alias("id"), F.concat(F.lit("10."), (i % 90).cast("string"), F.lit("/X"), (i * 7).cast("string")).alias("doi"), "title", "doc_id")
    name = F.when(i % 5 == 0, F.concat(F.lit("Copy_of_"), F.replace(F.substring("title", 1, 40), F.lit(" "), F.lit("_")))).when(i % 5 == 1, F.upper("id")).when(i % 5 == 2, F.replace("doi", F.lit("/"), F.lit("_"))).when(i % 5 == 3, F.concat(F.lit("scan "), i.cast("string"))).otherwise(F.replace(F.substring("title", 3, 25), F.lit("/"), F.lit("-")))
    path = F.concat(F.when(i % 2 == 0, "/b/").otherwise("/a/"), F.repeat(F.lit("sub/"), (i % 8).cast("int")), name, F.when(i % 11 == 0, ".PDF").otherwise(".pdf"))
    return lookup.find_files(p, lookup.listed(p.select(path.alias("path")), ["/b", "/a/"]))


_LABELS = "[split_part(text, ' ', 1), 'a', 'A 2', 'a', '?', 'A_2', 'a', '']"


@query("", rf"""WITH RECURSIVE f AS (SELECT CAST(conv_id AS VARCHAR) AS paper_id, turn AS seq, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k,
      regexp_replace(regexp_replace(lower({_LABELS}[1 + turn % 8]), '[^A-Za-z0-9-]+', '_', 'g'), '^_+|_+$', '', 'g') AS label FROM conversations),
    walk AS (SELECT paper_id, 0 AS k, CAST(NULL AS INTEGER) AS seq, CAST(NULL AS VARCHAR) AS id, CAST([] AS VARCHAR[]) AS used FROM f GROUP BY paper_id
      UNION ALL SELECT paper_id, k, seq, id, list_append(used, id) FROM (SELECT w.paper_id, f.k, f.seq, w.used, CASE
        WHEN label = '' THEN f.paper_id || '_fig' || CAST(list_filter(range(f.k, f.k + len(used) + 1), lambda n: NOT list_contains(used, f.paper_id || '_fig' || CAST(n AS VARCHAR)))[1] AS VARCHAR)
        WHEN NOT list_contains(used, f.paper_id || '_fig_' || label) THEN f.paper_id || '_fig_' || label
        ELSE f.paper_id || '_fig_' || label || '_' || CAST(list_filter(range(2, len(used) + 3), lambda n: NOT list_contains(used, f.paper_id || '_fig_' || label || '_' || CAST(n AS VARCHAR)))[1] AS VARCHAR) END AS id
      FROM walk w JOIN f ON f.paper_id = w.paper_id AND f.k = w.k + 1))
    SELECT paper_id, CAST(seq AS BIGINT) AS seq, id FROM walk WHERE k > 0""")
def figure_ids_in_order(spark, d):
    label = F.element_at(F.array(F.split_part("text", F.lit(" "), F.lit(1)), *map(F.lit, ("a", "A 2", "a", "?", "A_2", "a", ""))), (1 + F.col("turn") % 8).cast("int"))
    c = lib.read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("paper_id"), F.col("turn").cast("long").alias("seq"), F.lower(label).alias("label"))
    return readers.figure_ids(c).select("paper_id", "seq", "id")


_HEADING = "list_filter(regexp_split_to_array(h, '[ \\t\\n]+'), lambda x: x <> '')"


@query("chunks", f"""WITH h AS (SELECT id, content AS h FROM chunks), w AS (SELECT id, {_HEADING} AS w FROM h),
    p AS (SELECT id, w, list_transform(range(1, len(w)), lambda i: [w[i], w[i + 1]]) AS ps FROM w)
    SELECT id, len(list_filter(w, lambda x: regexp_full_match(x, '[b-hj-z]'))) > 0 OR len(list_filter(ps, lambda p:
      (regexp_full_match(p[1], '[A-Za-z]{{2,3}}') AND NOT list_contains(KNOWN, lower(p[1])) AND regexp_full_match(p[2], '[a-z][A-Za-z-]{{3,}}')) OR
      (regexp_full_match(p[2], '[A-Za-z]{{2,3}}') AND NOT list_contains(KNOWN, lower(p[2])) AND regexp_full_match(p[1], '[a-z][A-Za-z-]{{3,}}')) OR
      (regexp_full_match(p[1], '[a-z][A-Za-z]{{3,}}') AND regexp_full_match(p[2], '[a-z][A-Za-z]{{3,}}') AND NOT list_contains(KNOWN, lower(p[1])) AND NOT list_contains(KNOWN, lower(p[2]))))) > 0 AS split FROM p""".replace("KNOWN", str(tx.HEADING_WORDS)).replace("WITH h AS", ", h AS", 1))
def split_headings(spark, d):
    return lib.chunks(spark, d).select("id", tx.heading_split_likely(F.col("content")).alias("split"))


# A tree of documents as deep as its logarithm, with paths below it that are some hundreds deep, and a circle of three.
_PARENT = "CASE WHEN doc_id < 4 THEN 1 + doc_id % 3 WHEN doc_id % 100 > 60 THEN doc_id - 1 ELSE doc_id // 2 END"


@query("", f"""WITH RECURSIVE n AS (SELECT doc_id AS id, {_PARENT} AS parent FROM documents), e AS (SELECT n.id, n.parent FROM n JOIN documents p ON p.doc_id = n.parent),
    up AS (SELECT id, parent AS anc, 1 AS steps FROM e WHERE id <> parent UNION SELECT up.id, e.parent, steps + 1 FROM up JOIN e ON e.id = up.anc WHERE steps < 50)
    SELECT CAST(id AS VARCHAR) AS id, CAST(anc AS VARCHAR) AS ancestor_id, CAST(min(steps) AS INTEGER) AS steps FROM up WHERE id <> anc GROUP BY 1, 2""")
def deep_ancestors(spark, d):
    n = lib.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.expr(_PARENT.replace("//", "div")).cast("string").alias("parent_id"))
    return listing.ancestors(n, n)


@query("", f"""WITH RECURSIVE n AS (SELECT doc_id AS id, {_PARENT} AS parent FROM documents), down AS (SELECT 5 AS id UNION SELECT n.id FROM down JOIN n ON n.parent = down.id)
    SELECT CAST(id AS VARCHAR) AS key FROM down""")
def deep_closure(spark, d):
    n = lib.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("key"), F.expr(_PARENT.replace("//", "div")).cast("string").alias("parent"))
    return listing.descendants(n, spark.createDataFrame([("5",)], "key string"))


_RELATED = 0.55


def _classes(spark, d):
    return graph.feature_classes(graph.features(lib.papers(spark, d), lib.entities(spark, d)))


@query("papers entities", f"""{_FOCUS[: _FOCUS.index("s AS (SELECT a.id")].replace("FILTER", "true")} c AS (SELECT min(id) AS id, kw, tok, ent FROM (SELECT id, list_sort(kw) AS kw, list_sort(tok) AS tok, list_sort(list_distinct(ent)) AS ent FROM f) GROUP BY 2, 3, 4),
    s AS (SELECT a.id AS source, b.id AS target, len(list_intersect(a.kw, b.kw)) AS ik, len(list_distinct(list_concat(a.kw, b.kw))) AS uk, len(list_intersect(a.tok, b.tok)) AS it, len(list_distinct(list_concat(a.tok, b.tok))) AS ut,
      len(list_intersect(a.ent, b.ent)) AS ie, len(list_distinct(list_concat(a.ent, b.ent))) AS ue, least(len(a.ent), len(b.ent)) AS le FROM c a JOIN c b ON a.id < b.id AND (list_has_any(a.kw, b.kw) OR list_has_any(a.tok, b.tok)))
    SELECT source, target, round(w, 6) AS weight FROM (SELECT source, target, 0.3 * coalesce(ik / nullif(uk, 0), 0) + 0.2 * coalesce(it / nullif(ut, 0), 0) + 0.5 * CASE WHEN ie >= 2 THEN greatest(ie / ue, ie / le) ELSE coalesce(ie / nullif(ue, 0), 0) END AS w FROM s) WHERE w >= {_RELATED}""")
def related_papers(spark, d):
    return graph.related(_classes(spark, d), _RELATED).select("source", "target", F.round("weight", 6).alias("weight"))


@query("papers entities", f"""{_FOCUS[: _FOCUS.index("s AS (SELECT a.id")].replace("FILTER", "true")} x AS (SELECT id, list_sort(kw) AS kw, list_sort(tok) AS tok, list_sort(list_distinct(ent)) AS ent FROM f)
    SELECT min(id) AS id, count(*) AS members FROM x GROUP BY kw, tok, ent""")
def related_classes(spark, d):
    return _classes(spark, d).select("id", "members")


@query()
def related_capped(spark, d):
    return graph.capped(related_papers(spark, d), 3)


def _kept_up(spark, d):
    """An index of documents after a first load of their first lines, updates to their whole texts in four batches, a
    deletion, and the merges that follow."""
    docs = lib.read(spark, d, "documents").select("doc_id", "text")
    index = blockindex.build(docs.withColumn("text", F.split_part("text", F.lit("\n"), F.lit(1))), ["text"], 0, "doc_id")
    for k in range(4):
        index = blockindex.updated(index, docs.where(F.col("doc_id") % 4 == k), ["text"], 1 + k, "doc_id")
    index = blockindex.deleted(index, docs.where("doc_id % 9 = 0").select(F.col("doc_id").alias("id")))
    return blockindex.maintained(index)


@query("", f"WITH {_BM25.replace('WANTED', _TEXT_WORDS)} SELECT doc_id, round(score, 6) AS score FROM bm25 ORDER BY round(score, 9) DESC, doc_id LIMIT 25")
def block_topk(spark, d):
    index = blockindex.build(lib.read(spark, d, "documents"), ["text"], 0, "doc_id")
    return blockindex.search(index, _TEXT_QUERY, 25).withColumn("score", F.round("score", 6))


_LEFT = _POSTINGS.replace("FROM documents)", "FROM documents WHERE doc_id % 9 <> 0)")


@query("", f"WITH {_LEFT} SELECT term, count(*) AS n FROM post GROUP BY 1")
def index_after_changes(spark, d):
    return blockindex.frequencies(_kept_up(spark, d)).select("term", "n")


@query("", f"WITH {_BM25.replace('WANTED', _TEXT_WORDS).replace('FROM documents)', 'FROM documents WHERE doc_id % 9 <> 0)')} SELECT doc_id, round(score, 6) AS score FROM bm25 ORDER BY round(score, 9) DESC, doc_id LIMIT 25")
def block_topk_after_changes(spark, d):
    return blockindex.search(_kept_up(spark, d), _TEXT_QUERY, 25).withColumn("score", F.round("score", 6))
