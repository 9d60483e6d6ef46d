"""Contexts for retrieval-augmented answers: chunk contexts, figure references, budgets, and source lists.

Everything up to the model call is here; the model is a callable.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions import text as tx
from vellum.functions.query import Profile
from vellum.operators import fulltext, fusion, listing, vector
from vellum.staging import staged

# The metadata fields in order, the budgets, and the labels in contexts below.
FIELDS = ("title", "authors", "published_date", "venue", "affiliations", "emails", "doi", "keywords", "extra")
DEFAULT_FIELDS = FIELDS[:4]
TOTAL, PER_PAPER, SINGLE_PAPER, TOP_K = 24_000, 4_000, 8_000, 12
LEAST_TAIL, CUT_MARK = 50, "...(truncated)\n"
_FIGURE = re.compile(r"\bfig(?:ure)?s?\.?\s", re.I)
_RANGE, _NUMBER = re.compile(r"(\d+)\s*[-–]\s*(\d+)"), re.compile(r"\d+")


def figure_numbers(text: str, reach: int = 40, most: int = 8) -> list[int]:
    """Numbers that follow the word figure, ranges before single ones, each once."""
    out: dict[int, None] = {}
    for m in _FIGURE.finditer(text or ""):
        near = text[m.end() : m.end() + reach]
        spans = ((int(a), int(b)) for a, b in _RANGE.findall(near))
        out |= dict.fromkeys(n for a, b in spans if 0 <= b - a <= 10 for n in range(a, b + 1))
        out |= dict.fromkeys(int(n) for n in _NUMBER.findall(near))
        if len(out) >= most:
            break
    return list(out)


@F.udf(returnType=T.ArrayType(T.IntegerType()), useArrow=True)
def referenced_numbers(text: str):
    return [n for n in figure_numbers(text) if n < 1 << 31]


def referenced_figures(chunks: DataFrame, figures: DataFrame, most: int = 3) -> DataFrame:
    """``id, referenced_context`` of chunks that name figures of their paper: the n-th figure by page."""
    named = chunks.where(F.col("content").rlike(r"(?i)\bfig(?:ure)?s?\.?\s")).select("id", "paper_id", F.posexplode(referenced_numbers("content")).alias("pos", "n"))
    place = F.row_number().over(Window.partitionBy("paper_id").orderBy(F.asc_nulls_first("page_number"), "id"))
    shown = figures.select("paper_id", place.alias("n"), "caption", "description").where("caption is not null or description is not null")
    caption, text = tx.truncated(F.col("caption"), 300), tx.truncated(F.col("description"), 400)
    entry = F.concat(F.lit("[Referenced Figure "), F.col("n").cast("string"), F.lit(": "), F.concat_ws(" — ", caption, text), F.lit("]"))
    joined = named.join(shown, ["paper_id", "n"]).select("id", "pos", entry.alias("entry"))
    parts = F.transform(F.slice(F.sort_array(F.collect_list(F.struct("pos", "entry"))), 1, most), lambda x: x["entry"])
    return joined.groupBy("id").agg(F.array_join(parts, "\n").alias("referenced_context"))


def meta_parts(fields: tuple[str, ...], title: Column) -> Column:
    """The labelled metadata of a paper row in the order asked for; empty fields are left out."""
    joined = lambda c, label: F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(c, ", " if c in ("authors", "keywords") else "; ")))
    date = F.trim("published_date")
    known = {
        "title": F.when(F.coalesce(F.col("title"), F.lit("")) != "", title), "authors": joined("authors", "by "), "published_date": F.when(date.rlike(r"^\d{4}(-\d+){0,2}$"), date),
        "venue": F.concat(F.lit("Venue: "), "venue"), "affiliations": joined("affiliations", "Affiliations: "), "emails": joined("emails", "Emails: "), "doi": F.concat(F.lit("DOI: "), "doi"),
        "keywords": joined("keywords", "Keywords: "), "extra": F.concat(F.lit("Extra: "), "extra"),
    }
    return F.array_compact(F.array(*(known[f] for f in fields if f in known)))


def chunk_contexts(hits: DataFrame, chunks: DataFrame, figures: DataFrame, papers: DataFrame) -> DataFrame:
    """Chunk hits (doc_id, score) with paper, heading path, cleaned content and referenced figures, best first."""
    # the hits of a search are few: with them and the chunks of their papers written, all chunks are read twice and no more
    own = staged(F.broadcast(hits.select(F.col("doc_id").alias("id"), "score")).join(chunks.select("id", "paper_id", "content", "page_number", "seq"), "id"), "chunk-hits")
    found = own.select("paper_id").distinct()
    near = staged(chunks.select("id", "paper_id", "parent_id", "content").join(F.broadcast(found), "paper_id", "left_semi"), "chunk-papers")
    paths = listing.heading_paths(near, own.select("id"))
    known = papers.select(F.col("id").alias("paper_id")).join(F.broadcast(found), "paper_id", "left_semi")
    out = own.join(paths, "id", "left").join(referenced_figures(own, figures), "id", "left").join(known, "paper_id", "left_semi")
    return F.broadcast(out.withColumn("content", tx.without_watermarks(F.col("content"))).orderBy(F.desc("score"), "id"))


def compact_contexts(contexts: DataFrame, papers: DataFrame, most: int, fields: tuple[str, ...] = DEFAULT_FIELDS, by: tuple[str, ...] = ("paper_id",)) -> DataFrame:
    """``context`` for each of the groups ``by``: papers in order of their best chunk, a header each, their chunks, up to
    ``most`` characters.

    Blocks are laid out in order and a running sum of their lengths decides; the first that does not fit ends the text,
    and of a chunk what fits stays if that is more than a few characters.  The chunks are those of a search, so few."""
    best = Window.partitionBy("paper_id")
    rows = contexts.withColumn("first", F.min(F.struct((-F.col("score")).alias("k"), "id")).over(best))
    head = F.array_join(meta_parts(fields, F.concat(F.lit("Paper: "), "title")), " ")
    headers = papers.select(F.col("id").alias("paper_id"), F.concat(F.lit("--- "), head, F.lit(" ---\n")).alias("header"), (head != "").alias("named")).where("named").drop("named")
    block = F.concat(F.coalesce(F.concat(F.lit("Section path: "), "heading_path", F.lit("\n")), F.lit("")), F.coalesce(F.concat(F.lit("[Page "), F.col("page_number").cast("string"), F.lit("] ")), F.lit("")), "content", F.coalesce(F.concat(F.lit("\n"), "referenced_context"), F.lit("")), F.lit("\n\n"))
    rows = rows.join(headers, "paper_id")
    opens = F.row_number().over(best.orderBy(F.desc("score"), "id")) == 1
    pieces = rows.withColumn("opens", opens).select(*by, "first", F.col("score"), "id", F.explode(F.array_compact(F.array(F.when(F.col("opens"), F.struct(F.lit(0).alias("kind"), F.col("header").alias("text"))), F.struct(F.lit(1).alias("kind"), block.alias("text"))))).alias("p"))
    order = F.struct("first", (-F.col("score")).alias("s"), "id", F.col("p.kind").alias("kind"), F.col("p.text").alias("text"))
    listed = pieces.groupBy(*by).agg(F.sort_array(F.collect_list(order)).alias("all"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"), F.lit(False).alias("cut"))

    def step(a, x):
        size, room = F.char_length(x["text"]), F.lit(most) - a["n"]
        tail = F.when((x["kind"] == 1) & (room > LEAST_TAIL), tx.truncated_to(x["text"], room)).otherwise(F.lit(""))
        return F.when(a["cut"], a).when(size <= room, F.struct(F.concat(a["out"], x["text"]).alias("out"), (a["n"] + size).alias("n"), F.lit(False).alias("cut"))).otherwise(F.struct(F.concat(a["out"], tail).alias("out"), (a["n"] + F.char_length(tail)).alias("n"), F.lit(True).alias("cut")))

    folded = F.aggregate("all", start, step)
    return listed.select(*by, folded.alias("f")).select(*by, F.concat("f.out", F.when(F.col("f.cut"), CUT_MARK).otherwise("")).alias("context"))


def compact_context(contexts: DataFrame, papers: DataFrame, most: int, fields: tuple[str, ...] = DEFAULT_FIELDS) -> DataFrame:
    """One row ``context`` of all chunks."""
    return compact_contexts(contexts, papers, most, fields, ())


def merged_sources(sources: DataFrame) -> DataFrame:
    """Sources (paper_id, seq, score, content, citations) by paper: best score, contents in order, distinct citations."""
    rows = F.sort_array(F.collect_list(F.struct("seq", "content", "citations")))
    return sources.groupBy("paper_id").agg(F.max("score").alias("score"), F.min("seq").alias("seq"), F.array_join(F.transform(rows, lambda x: x["content"]), "\n\n").alias("content"), F.array_distinct(F.flatten(F.transform(rows, lambda x: x["citations"]))).alias("citations")).orderBy(F.desc("score"), "paper_id")


def source_context(sources: DataFrame, papers: DataFrame, most: int = TOTAL, fields: tuple[str, ...] = FIELDS[:8]) -> DataFrame:
    """One row ``context`` of numbered sources in order of ``seq``; one too long is cut or left out, and the next are tried."""
    joined = sources.join(papers, sources["paper_id"] == papers["id"]).withColumn("i", F.row_number().over(Window.orderBy("seq")))
    parts = meta_parts(fields, F.concat(F.lit("Source "), F.col("i").cast("string"), F.lit(": "), "title"))
    header = F.concat(F.lit("### "), F.when(F.size(parts) == 0, F.concat(F.lit("Source "), F.col("i").cast("string"))).otherwise(F.array_join(parts, " ")), F.lit("\n"))
    listed = joined.select("i", header.alias("header"), "content").agg(F.sort_array(F.collect_list(F.struct("i", "header", "content"))).alias("all"))

    def step(a, x):
        head, body = F.char_length(x["header"]), F.char_length(x["content"])
        room = F.lit(most) - a["n"] - head - 2
        text = F.when(body <= room, x["content"]).when(room > LEAST_TAIL, tx.truncated_to(x["content"], room))
        return F.when(text.isNull(), a).otherwise(F.struct(F.concat(a["out"], x["header"], text, F.lit("\n\n")).alias("out"), (a["n"] + head + F.char_length(text) + 2).alias("n")))

    return listed.select(F.aggregate("all", F.struct(F.lit("").alias("out"), F.lit(0).alias("n")), step)["out"].alias("context"))


def paper_budget(papers_with_chunks: int, per_paper: int = PER_PAPER, total: int = TOTAL) -> int:
    return max(per_paper, total // max(1, papers_with_chunks))


def section_context(sections: DataFrame, snippet: int = 500) -> DataFrame:
    """``paper_id, content``: a paper's sections as labelled snippets."""
    line = F.concat(F.lit("["), "section_type", F.lit("] "), tx.truncated(F.col("content"), snippet))
    rows = F.sort_array(F.collect_list(F.struct("id", line.alias("t"))))
    return sections.groupBy("paper_id").agg(F.array_join(F.transform(rows, lambda x: x["t"]), "\n\n").alias("content"))


def resolve_prompt(prompts: DataFrame, prompt_id: str | None = None, fallback: str = "") -> str:
    """The prompt of an id, else the default one, else the fallback."""
    named = (F.col("id") == prompt_id) if prompt_id else F.lit(False)
    row = prompts.where(named | F.col("is_default")).orderBy(F.when(named, 0).otherwise(1), "id").first()
    return row["system_prompt"] if row else fallback


def enhancer(chat: Callable[[str], dict], size: int = 64) -> Callable[[str], tuple[str, str | None]]:
    """A cached rewriting of queries: (rewritten, hypothetical document); an answer that cannot be read changes nothing."""

    @lru_cache(size)
    def run(query: str) -> tuple[str, str | None]:
        try:
            reply = chat(query)
            return reply.get("rewritten_query") or query, reply.get("hypothetical_document") or None
        except Exception:  # any failure of the model leaves the query as it is
            return query, None

    return run


def section_snippets(found: DataFrame) -> DataFrame:
    """``paper_id, content``: the sections that a search matched, as labelled snippets."""
    lines = F.transform("matched_sections", lambda x: F.concat(F.lit("["), x["section_type"], F.lit("] "), x["content_snippet"]))
    return found.select("paper_id", F.array_join(lines, "\n\n").alias("content"))


def sources_of(found: DataFrame, question: str, papers: DataFrame, chunks: DataFrame, figures: DataFrame, chunk_index: fulltext.Index, k: int = TOP_K, fields: tuple[str, ...] = DEFAULT_FIELDS) -> DataFrame:
    """Sources (paper_id, seq, score, content, citations) of found papers (paper_id, score, matched_sections), best first.

    A paper's content are its best chunks within its budget, which papers with chunks share, else the sections that
    the search matched; citations are the ids of its chunks."""
    best = Window.partitionBy()
    ranked = found.withColumn("score", F.when(F.max("score").over(best) > 0, F.col("score") / F.max("score").over(best)).otherwise(F.col("score")))
    ranked = ranked.withColumn("seq", F.row_number().over(best.orderBy(F.desc("score"), "paper_id")))
    hits = fulltext.search_chunks(chunk_index, chunks, question, 3 * k, found.select("paper_id")).select("doc_id", "score")
    contexts = chunk_contexts(hits, chunks, figures, papers)
    contexts = contexts.sparkSession.createDataFrame(contexts.collect(), contexts.schema)  # 3k rows at most
    each = compact_contexts(contexts, papers, paper_budget(contexts.select("paper_id").distinct().count()), fields)
    cited = contexts.groupBy("paper_id").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))), lambda x: x["id"]).alias("citations"))
    joined = ranked.join(each, "paper_id", "left").join(cited, "paper_id", "left").join(section_snippets(found), "paper_id", "left")
    has = F.coalesce(F.col("context"), F.lit("")) != ""
    none = F.array().cast("array<string>")
    return joined.select("paper_id", "seq", "score", F.when(has, F.col("context")).otherwise(F.coalesce("content", F.lit(""))).alias("content"), F.when(has, F.col("citations")).otherwise(none).alias("citations"))


def retrieve(question: str, papers: DataFrame, chunks: DataFrame, figures: DataFrame, vectors: DataFrame, index: fulltext.Index, chunk_index: fulltext.Index, embed=vector.embed_words, enhance=None, k: int = TOP_K, fields: tuple[str, ...] = DEFAULT_FIELDS) -> tuple[DataFrame, DataFrame]:
    """(context, sources) for a question: up to three searches fused and scored against the best paper, each paper's chunks
    within its budget, sources of one paper merged, and the numbered whole within the total."""
    profile = Profile.of(question)
    k = profile.top_k(k)
    search = lambda q, method="hybrid": fusion.search_papers(method, q, index, papers, chunks, vectors, embed, k)
    lists = [search(question)]
    if enhance is not None and profile.enhanced:
        rewritten, document = enhance(question)
        if rewritten != question:
            lists.append(search(rewritten))
        if document:
            lists.append(search(document, "semantic"))
    found = fusion.fuse_lists(lists).limit(k).select("paper_id", "score", "matched_sections")
    sources = merged_sources(sources_of(found, question, papers, chunks, figures, chunk_index, k, fields))
    return source_context(sources, papers, TOTAL, fields), sources


def ask(question: str, chat: Callable[[str, str], str], prompts: DataFrame, context: DataFrame, prompt_id: str | None = None) -> str:
    """A model's answer over a context row."""
    return chat(resolve_prompt(prompts, prompt_id), f"{context.first()['context']}\n\nQuestion: {question}")


def search_within(paper_id: str, question: str, sections: DataFrame, chunks: DataFrame, k: int = TOP_K) -> DataFrame:
    """``content, score`` inside one paper: its sections, else its chunks."""
    own = sections.where(F.col("paper_id") == paper_id)
    if not own.isEmpty():
        return section_context(own).select("content", F.lit(1.0).alias("score"))
    return fulltext.paper_passages(chunks, paper_id, question, k).select("content", "score")
