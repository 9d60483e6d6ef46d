"""Registered queries over pages, batches, replies and budgets that cut."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import replies, segments
from vellum.operators import fulltext, graph, retrieval, vector
from vellum.plans import library as lib
from vellum.plans.further import _FOCUS, _ONE, _bm25_over
from vellum.plans.queries import _Q, _probe, query
from vellum.sources import figurepages, layout

# Pages are made of the lines of documents: four lines a page for layout, a line a page for figures.
_SPANS = """, spans AS (SELECT paper_id AS doc_id, 1 + seq // 4 AS page, seq, content AS text, 10.0 + strlen(content) % 7 AS font_size, strlen(content) % 3 > 0 AS bold FROM chunks)"""


def _spans(spark, d):
    size = F.octet_length("content")
    return lib.chunks(spark, d).select(F.col("paper_id").alias("doc_id"), (1 + F.floor(F.col("seq") / 4)).cast("int").alias("page"), "seq", F.col("content").alias("text"), (10.0 + size % 7).cast("double").alias("font_size"), (size % 3 > 0).alias("bold"))


@query("chunks", f"""{_SPANS} SELECT doc_id, count(*) FILTER (page <= 5 AND font_size >= 14 AND bold) AS headings, round(count(*) FILTER (page <= 5) / least(max(page), 5), 6) AS spans_per_page FROM spans GROUP BY 1""")
def layout_signals(spark, d):
    return layout.signals(_spans(spark, d)).select("doc_id", "headings", F.round("spans_per_page", 6).alias("spans_per_page"))


@query("chunks", f"""{_SPANS} SELECT doc_id, CAST(page AS INTEGER) AS page, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM spans GROUP BY 1, 2 HAVING sum(strlen(text)) >= 20""")
def written_pages(spark, d):
    return layout.written_pages(_spans(spark, d)).where("kept").select("doc_id", "page", "bytes")


@query("chunks", f"""{_SPANS}, h AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY seq) - row_number() OVER (PARTITION BY doc_id, page, font_size >= 14 AND bold, font_size ORDER BY seq) AS run FROM spans WHERE page <= 5)
    SELECT doc_id, CAST(page AS INTEGER) AS page, CAST(min(seq) AS BIGINT) AS seq, trim(string_agg(text, ' ' ORDER BY seq)) AS heading FROM h WHERE font_size >= 14 AND bold GROUP BY doc_id, page, font_size, run""")
def heading_runs(spark, d):
    return layout.heading_runs(_spans(spark, d)).select("doc_id", "page", F.col("seq").cast("long").alias("seq"), "heading")


@query("chunks", """, b AS (SELECT paper_id AS doc_id, 1 + seq // 4 AS page, string_agg(content, chr(10) ORDER BY seq) AS body FROM chunks GROUP BY 1, 2),
    l AS (SELECT doc_id, page, body, string_split('Journal ' || doc_id || ', page ' || page || chr(10) || chr(10) || body || chr(10) || CASE WHEN page % 9 = 0 THEN 'Errata' ELSE 'Draft of ' || page END || chr(10) || page, chr(10)) AS ls FROM b),
    u AS (SELECT doc_id, page, i, ls[i] AS t, regexp_replace(trim(ls[i]), '[0-9]+', '#', 'g') AS m FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM l)),
    p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, m = '' ORDER BY i) AS a, row_number() OVER (PARTITION BY doc_id, page, m = '' ORDER BY i DESC) AS z FROM u),
    n AS (SELECT doc_id, count(*) AS pages FROM b GROUP BY 1), r AS (SELECT doc_id, m FROM p JOIN n USING (doc_id) WHERE m <> '' AND (a <= 2 OR z <= 2) GROUP BY doc_id, m, pages HAVING count(DISTINCT page) >= 3 AND count(DISTINCT page) >= 0.85 * pages)
    SELECT doc_id, CAST(page AS INTEGER) AS page, coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (NOT (m <> '' AND (a <= 2 OR z <= 2) AND r.m IS NOT NULL)), '') AS text FROM (SELECT p.*, r.m AS rm FROM p LEFT JOIN r USING (doc_id, m)) r GROUP BY 1, 2""".replace("r.m IS NOT NULL", "rm IS NOT NULL"))
def pages_without_running_lines(spark, d):
    c, page = lib.chunks(spark, d), (1 + F.floor(F.col("seq") / 4)).cast("int")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "content"))), lambda x: x["content"]), "\n")
    p = c.groupBy(F.col("paper_id").alias("doc_id"), page.alias("page")).agg(body.alias("body"))
    foot = F.when(F.col("page") % 9 == 0, "Errata").otherwise(F.concat(F.lit("Draft of "), F.col("page").cast("string")))
    text = F.concat(F.lit("Journal "), "doc_id", F.lit(", page "), F.col("page").cast("string"), F.lit("\n\n"), "body", F.lit("\n"), foot, F.lit("\n"), F.col("page").cast("string"))
    return layout.without_running_lines(p.select("doc_id", "page", text.alias("text")))


@query()
def located_figures(spark, d):
    """Every third line of a document is a caption on a page of its own; the lines after it refer to it."""
    c = lib.chunks(spark, d)
    number = (F.floor(F.col("seq") / 3) + 1).cast("string")
    text = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("Figure "), number, F.lit(". "), "content")).otherwise(F.concat("content", F.lit(" as Figure "), number, F.lit(" shows")))
    pages = c.select(F.col("paper_id").alias("doc_id"), F.col("seq").alias("page"), text.alias("text"), (F.col("seq") % 5 == 0).cast("int").alias("n_images"))
    figures = c.where("seq % 3 = 0").select("id", F.col("paper_id").alias("doc_id"), number.alias("label"), F.concat(F.lit("Figure "), number, F.lit(". "), "content").alias("caption"))
    return figurepages.figure_pages(figures, pages).select("id", F.col("page").cast("long").alias("page"))


@query("", """WITH RECURSIVE all_lines AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
    c AS (SELECT CAST(doc_id AS VARCHAR) AS paper_id, CAST(doc_id AS VARCHAR) || '_c' || CAST(k AS VARCHAR) AS id, k, length(ls[k + 1]) AS n FROM (SELECT doc_id, ls, unnest(range(0, len(ls))) AS k FROM all_lines)),
    walk AS (SELECT paper_id, id, k, 0 AS batch, n AS used FROM c WHERE k = 0 UNION ALL SELECT c.paper_id, c.id, c.k, CASE WHEN used + n > 400 THEN batch + 1 ELSE batch END, CASE WHEN used + n > 400 THEN n ELSE used + n END FROM walk JOIN c ON c.paper_id = walk.paper_id AND c.k = walk.k + 1)
    SELECT id, CAST(CASE WHEN batch < 8 THEN batch ELSE -1 END AS INTEGER) AS batch FROM walk""")
def batches_of_lines(spark, d):
    return segments.batched(lib.chunks(spark, d), 400, 8).select("id", "batch")


@query("papers entities", f"{_FOCUS.replace('FILTER', 'true').replace('PAIR', _ONE)} SELECT target, round(weight, 6) AS weight FROM e ORDER BY round(weight, 12) DESC, target LIMIT 8")
def strongest_focus_edges(spark, d):
    found = graph.focus_edges(graph.features(lib.papers(spark, d), lib.entities(spark, d)), "17", 8)
    return found.select("target", F.round("weight", 6).alias("weight"))


@query("papers chunks", """, hit AS (SELECT c.paper_id, c.id, c.content, h.content AS heading, CAST(length(c.content) AS DOUBLE) AS score FROM chunks c JOIN chunks h ON h.id = c.parent_id),
    top AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, id) AS r FROM hit),
    piece AS (SELECT paper_id, r, 1 AS kind, 'Section path: ' || heading || chr(10) || content || chr(10) || chr(10) AS text FROM top UNION ALL SELECT p.id, 1, 0, '--- Paper: ' || title || ' ---' || chr(10) FROM papers p SEMI JOIN top t ON t.paper_id = p.id WHERE title <> ''),
    whole AS (SELECT t.*, sum(length(text)) OVER (PARTITION BY paper_id ORDER BY r, kind) AS upto FROM piece t SEMI JOIN papers p ON p.id = t.paper_id AND title <> ''),
    cut AS (SELECT *, 700 - (upto - length(text)) AS room, row_number() OVER (PARTITION BY paper_id, upto <= 700 ORDER BY r, kind) AS n FROM whole),
    part AS (SELECT paper_id, r, kind, upto > 700 AS late, CASE WHEN upto <= 700 THEN text WHEN kind = 1 AND room > 50 THEN substring(text, 1, CAST(room AS BIGINT) - 3) || '...' ELSE '' END AS text FROM cut WHERE upto <= 700 OR n = 1)
    SELECT paper_id, string_agg(text, '' ORDER BY r, kind) || CASE WHEN bool_or(late) THEN '...(truncated)' || chr(10) ELSE '' END AS context FROM part GROUP BY 1""")
def contexts_within_a_budget(spark, d):
    p, c = lib.papers(spark, d).where("title <> ''"), lib.chunks(spark, d)
    heads = c.where("parent_id is null").select(F.col("id").alias("parent_id"), F.col("content").alias("heading_path"))
    rows = c.join(heads, "parent_id").select("paper_id", "id", "content", "heading_path", F.length("content").cast("double").alias("score"), F.lit(None).cast("int").alias("page_number"), F.lit(None).cast("string").alias("referenced_context"))
    return retrieval.compact_contexts(rows, p, 700, ("title",))


@query("papers chunks vectors", f""", near AS (SELECT paper_id FROM (SELECT paper_id, list_cosine_similarity(vector, {_Q}) AS score, id FROM vectors WHERE list_cosine_similarity(vector, {_Q}) >= 0.1 ORDER BY 2 DESC, 3 LIMIT 100) GROUP BY 1 ORDER BY max(score) DESC, 1 LIMIT 30),
    {_bm25_over("chunks", ["content"], ["erth", "ention"])} SELECT doc_id, paper_id, round(score, 6) AS score FROM scored JOIN chunks c ON c.id = doc_id WHERE paper_id IN (SELECT paper_id FROM near) ORDER BY round(scored.score, 9) DESC, doc_id LIMIT 30""")
def passages_of_near_papers(spark, d):
    c = lib.chunks(spark, d)
    hits = vector.search(lib.vectors(spark, d), _probe(spark, d), 100)
    found = fulltext.passages_of_hits(fulltext.build(c, ["content"]), c, hits, "erth ention", 30)
    return found.select("doc_id", "paper_id", F.round("score", 6).alias("score"))


@query("papers", r"""SELECT id, 'T: ' || source || ' ''x''' AS title, CASE doc_id % 3 WHEN 0 THEN ['Ann B', source] WHEN 1 THEN [source] ELSE ['A', 'B'] END AS authors, ['k-' || paper_type, 'two words'] AS keywords, '10.1/' || id AS doi, CASE WHEN doc_id % 2 = 0 THEN '2020-01-0' || CAST(1 + doc_id % 9 AS VARCHAR) END AS published_date,
    trim(text, chr(32) || chr(9) || chr(10) || chr(13)) AS body FROM papers""")
def front_matter_fields(spark, d):
    p, i = lib.papers(spark, d), F.col("doc_id")
    authors = F.when(i % 3 == 0, F.concat(F.lit("authors: [Ann B, "), "source", F.lit("]"))).when(i % 3 == 1, F.concat(F.lit("author: "), "source")).otherwise(F.lit("authors:\n  - A\n  - B"))
    dated = F.when(i % 2 == 0, F.concat(F.lit("\ndate: 2020-01-0"), (1 + i % 9).cast("string"))).otherwise("")
    block = F.concat(F.lit('---\ntitle: "T: '), "source", F.lit(" 'x'\"\n"), authors, F.lit("\ntags:\n- k-"), "paper_type", F.lit("\n- two words\ndoi: 10.1/"), "id", dated, F.lit("\n---\n"), "text")
    return p.select("id", replies.front_matter(block).alias("m")).select("id", "m.title", "m.authors", "m.keywords", "m.doi", "m.published_date", "m.body")


@query("papers", r"""SELECT id, CASE WHEN doc_id % 6 >= 4 THEN NULL ELSE '{"id":' || id || ',"lang":"' || paper_type || '","tags":["' || source || '","a, ]"]}' END AS reply FROM papers""")
def replies_as_json(spark, d):
    """Replies in a fence, with a comma too many, amid prose, cut at their end, and without JSON."""
    p, i = lib.papers(spark, d), F.col("doc_id")
    head = F.concat(F.lit('{"id": '), "id", F.lit(', "lang": "'), "paper_type", F.lit('", "tags": ["'), "source", F.lit('", "a, ]"'))
    text = F.when(i % 6 == 0, F.concat(head, F.lit("]}"))).when(i % 6 == 1, F.concat(F.lit("Here:\n```json\n"), head, F.lit("]}\n```\nDone."))).when(i % 6 == 2, F.concat(head, F.lit(",],\n}")))
    text = text.when(i % 6 == 3, F.concat(F.lit("The record is "), head, F.lit("]}, as asked."))).when(i % 6 == 4, F.concat(head, F.lit("]"))).otherwise(F.lit("Nothing was found."))
    return p.select("id", replies.json_reply(text).alias("reply"))
