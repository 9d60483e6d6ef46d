"""The library's tables over the raw tables at hand, as lazy DataFrames; ``CTE`` says the same in SQL.

papers, sections and chunks come from ``documents``, vectors from ``embeddings``, call metrics from ``events``, ratings
from ``labels``, comments from ``conversations``, entities from ``documents`` and ``nation``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _long_words(title) -> F.col:
    return F.slice(F.filter(F.split(title, " "), lambda x: F.char_length(x) > 5), 1, 5)


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = read(spark, sf_dir, "documents"), F.col("doc_id")
    # the first lines are cut off before anything is split, as a text is long
    title, head = F.substring_index("text", "\n", 1), F.substring_index("text", "\n", 2)
    return d.select(
        i.cast("string").alias("id"), i.alias("doc_id"), title.alias("title"), F.when(i % 6 == 0, F.array().cast("array<string>")).when(i % 7 == 0, F.array(F.lit("a@b.org"))).otherwise(F.array("source")).alias("authors"),
        F.when(i % 4 != 0, F.split_part(head, F.lit("\n"), F.lit(2))).alias("abstract_text"), _long_words(title).alias("keywords"), F.col("lang").alias("paper_type"), "source",
        F.when(i % 10 == 0, "failed").when(i % 10 == 1, "processing").otherwise("indexed").alias("status"), F.when(i % 20 == 0, "timed out").alias("error_message"), (i % 4).cast("int").alias("retry_count"),
        F.concat((F.lit(2000) + i % 25).cast("string"), F.when(i % 3 == 0, F.lit("-05-01")).otherwise(F.lit(""))).alias("published_date"), F.timestamp_seconds(F.lit(1704067200) + i * 60).alias("updated_at"), F.sha2("text", 256).alias("file_hash"), "text",
    )


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of every document: the first is its abstract, the second its methods, the others its results."""
    d = read(spark, sf_dir, "documents")
    names = F.array(*(F.lit(x) for x in ("abstract", "methods", "results")))
    parts = d.select(F.col("doc_id").cast("string").alias("paper_id"), "doc_id", F.posexplode(F.split("text", "\n", 3)).alias("k", "content"))
    return parts.select((F.col("doc_id") * 3 + F.col("k")).alias("id"), "paper_id", F.element_at(names, F.col("k") + 1).alias("section_type"), "content")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a document; the first is its heading."""
    d = read(spark, sf_dir, "documents")
    lines = d.select(F.col("doc_id").cast("string").alias("paper_id"), F.posexplode(F.split("text", "\n")).alias("seq", "content"))
    name = lambda k: F.concat("paper_id", F.lit("_c"), k.cast("string"))
    first = F.col("seq") == 0
    lines = lines.select(name(F.col("seq")).alias("id"), "paper_id", F.when(~first, name(F.lit(0))).alias("parent_id"), F.when(first, "section").otherwise("paragraph").alias("chunk_type"), "content", "seq")
    return lines


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    kind = F.when(F.col("vec_id") % 5 == 0, "figure").otherwise("section")
    return e.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 100).cast("string").alias("paper_id"), kind.alias("content_type"), F.concat(F.lit("label_"), F.col("label").cast("string")).alias("section_type"), F.lit(None).cast("string").alias("chunk_text"), F.col("embedding").alias("vector"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    tokens = F.get_json_object("props", "$.k").cast("int")
    return e.select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("event_type").alias("kind"), F.concat(F.lit("model"), (F.col("user_id") % 3).cast("string")).alias("model"), tokens.alias("prompt_tokens"), F.when(F.col("event_id") % 2 == 0, tokens).alias("completion_tokens"), F.floor(F.col("value") * 10).cast("long").alias("latency_ms"), (F.col("event_id") % 7 != 0).alias("success"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").groupBy(F.col("doc_id").cast("string").alias("paper_id")).agg((F.max("quality") + F.max("toxic") + 3).cast("int").alias("rating"))


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").cast("string").alias("paper_id"), F.col("text").alias("content"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), "lang", "source")
    return d.select("paper_id", F.explode(F.array(F.struct(F.lit("species").alias("kind"), F.col("lang").alias("value")), F.struct(F.lit("technique").alias("kind"), F.col("source").alias("value")))).alias("e")).select("paper_id", "e.kind", "e.value")


#: The same tables for DuckDB.
CTE = {
    "papers": """papers AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, split_part(text, chr(10), 1) AS title,
        CASE WHEN doc_id % 6 = 0 THEN CAST([] AS VARCHAR[]) WHEN doc_id % 7 = 0 THEN ['a@b.org'] ELSE [source] END AS authors,
        CASE WHEN doc_id % 4 <> 0 THEN split_part(text, chr(10), 2) END AS abstract_text,
        list_filter(string_split(split_part(text, chr(10), 1), ' '), lambda x: length(x) > 5)[1:5] AS keywords, lang AS paper_type, source,
        CASE doc_id % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'processing' ELSE 'indexed' END AS status, CASE WHEN doc_id % 20 = 0 THEN 'timed out' END AS error_message,
        CAST(doc_id % 4 AS INTEGER) AS retry_count, CAST(2000 + doc_id % 25 AS VARCHAR) || CASE WHEN doc_id % 3 = 0 THEN '-05-01' ELSE '' END AS published_date,
        TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS updated_at, sha256(text) AS file_hash, text FROM documents)""",
    "sections": """section_lines AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
        sections AS (SELECT doc_id * 3 + k - 1 AS id, CAST(doc_id AS VARCHAR) AS paper_id, ['abstract', 'methods', 'results'][k] AS section_type, CASE WHEN k < 3 THEN ls[k] ELSE array_to_string(ls[3:], chr(10)) END AS content
        FROM (SELECT doc_id, ls, unnest(range(1, least(len(ls), 3) + 1)) AS k FROM section_lines))""",
    "chunks": """all_lines AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
        chunks AS (SELECT CAST(doc_id AS VARCHAR) || '_c' || CAST(k AS VARCHAR) AS id, CAST(doc_id AS VARCHAR) AS paper_id, CASE WHEN k > 0 THEN CAST(doc_id AS VARCHAR) || '_c0' END AS parent_id, ls[k + 1] AS content, k AS seq
        FROM (SELECT doc_id, ls, unnest(range(0, len(ls))) AS k FROM all_lines))""",
    "vectors": """vectors AS (SELECT vec_id AS id, CAST(vec_id % 100 AS VARCHAR) AS paper_id, CASE WHEN vec_id % 5 = 0 THEN 'figure' ELSE 'section' END AS content_type,
        'label_' || CAST(label AS VARCHAR) AS section_type, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings)""",
    "calls": """calls AS (SELECT event_id AS id, ts AS created_at, event_type AS kind, 'model' || CAST(user_id % 3 AS VARCHAR) AS model, CAST(json_extract_string(props, '$.k') AS INTEGER) AS prompt_tokens,
        CASE WHEN event_id % 2 = 0 THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS completion_tokens, CAST(floor(value * 10) AS BIGINT) AS latency_ms, event_id % 7 <> 0 AS success FROM events)""",
    "ratings": "ratings AS (SELECT CAST(doc_id AS VARCHAR) AS paper_id, CAST(max(quality) + max(toxic) + 3 AS INTEGER) AS rating FROM labels GROUP BY 1)",
    "comments": "comments AS (SELECT conv_id * 1000 + turn AS id, CAST(conv_id AS VARCHAR) AS paper_id, text AS content FROM conversations)",
    "entities": """entities AS (SELECT CAST(doc_id AS VARCHAR) AS paper_id, 'species' AS kind, lang AS value FROM documents
        UNION ALL SELECT CAST(doc_id AS VARCHAR), 'technique', source FROM documents)""",
}


def with_tables(names: str, select: str) -> str:
    """A SELECT over some of the tables."""
    ctes = [CTE[n] for n in names.split()]
    return f"WITH {', '.join(ctes)} {select}" if ctes else select
