"""Counts, metrics, duplicate groups, data quality, and the folds of extraction windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as tx


def counts(papers: DataFrame, vectors: DataFrame, figures: DataFrame) -> DataFrame:
    """Papers by status, vectors and figures, as (name, n)."""
    each = papers.groupBy(F.concat(F.lit("papers_"), "status").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    for name, df in (("papers", papers), ("vectors", vectors), ("figures", figures)):
        each = each.unionByName(df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n"))
    return each


def call_metrics(calls: DataFrame, since: Column | None = None) -> DataFrame:
    """Calls, failures, tokens and mean latency by kind and model, of calls not older than ``since``."""
    calls = calls if since is None else calls.where(F.col("created_at") >= since)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return calls.groupBy("kind", "model").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.when(F.col("success"), 0).otherwise(1)).cast("long").alias("failures"), total("prompt_tokens"), total("completion_tokens"), F.avg("latency_ms").alias("avg_latency_ms")).orderBy("kind", "model")


def duplicate_key(papers: DataFrame) -> DataFrame:
    """``key, id``: a paper's file hash, or else its normalised title, authors and date."""
    meta = F.concat_ws("|", tx.normalised(F.col("title")), F.array_join(F.transform("authors", F.lower), ","), F.coalesce("published_date", F.lit("")))
    return papers.select(F.coalesce(F.nullif("file_hash", F.lit("")), meta).alias("key"), "id")


def duplicate_groups(papers: DataFrame) -> DataFrame:
    """``key, n, first_id`` of keys that several papers have, the largest group first.  Members are rows, not a list, as a
    group has no bound: ``duplicate_members``."""
    groups = duplicate_key(papers).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    return groups.where("n > 1").orderBy(F.desc("n"), "key")


def duplicate_members(papers: DataFrame) -> DataFrame:
    """``first_id, id`` of every paper in a group of duplicates; first_id names the group."""
    keyed = duplicate_key(papers)
    return keyed.join(duplicate_groups(papers).select("key", "first_id"), "key").select("first_id", "id")


def paper_issues(papers: DataFrame, sections: DataFrame, min_title: int = 5) -> DataFrame:
    """``id, title, issues`` of papers that break a rule; lengths of sections are in bytes."""
    content, kind = F.col("content"), F.col("section_type") == "abstract"
    per = sections.groupBy("paper_id").agg(
        F.sum(F.octet_length(content)).alias("bytes"), F.count_if(F.trim(content) == "").alias("blank"), F.count_if(kind & (F.trim(content) != "")).alias("abstracts"),
        F.min_by(F.when(kind, F.octet_length(F.trim(content))), F.when(kind, F.col("id"))).alias("abstract_bytes"),
    )
    t, authors = F.trim("title"), F.col("authors")
    titled = (t != "") & (t != "Untitled")
    some = F.col("paper_id").isNotNull()
    rules = [
        ("empty_title", ~titled), ("short_title", titled & (F.char_length(t) < min_title)), ("oversized_title", titled & (F.char_length(t) > 300)), ("numeric_title", titled & t.rlike(r"^[\p{N}\s.\-]+$")),
        ("empty_authors", F.size(authors) == 0), ("email_in_authors", F.exists(authors, lambda a: a.contains("@") & a.contains("."))),
        ("indexing_failed", F.col("status") == "failed"), ("has_error", F.coalesce(F.col("error_message"), F.lit("")) != ""),
        ("no_sections", ~some), ("low_content", some & (F.col("bytes") < 500)), ("empty_sections", some & (F.col("blank") > 0)), ("missing_abstract", some & (F.col("abstracts") == 0)), ("short_abstract", some & (F.col("abstract_bytes") < 200)),
    ]
    joined = papers.withColumn("title", F.coalesce("title", F.lit(""))).join(per, papers["id"] == per["paper_id"], "left")
    issues = F.array_compact(F.array(*(F.when(hit, F.lit(name)) for name, hit in rules)))
    return joined.select("id", "title", issues.alias("issues")).where(F.size("issues") > 0)


def issue_counts(issues: DataFrame) -> DataFrame:
    """How often each issue occurs."""
    return issues.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


def as_map(counted: DataFrame, key: str, value: str) -> DataFrame:
    """Counted rows as one map."""
    return counted.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value)))).alias("summary"))


def entity_lists(entities: DataFrame) -> DataFrame:
    """``paper_id`` and a sorted list per kind."""
    kinds = ("species", "gene", "technique", "pathway")
    return entities.groupBy("paper_id").agg(*(F.sort_array(F.collect_set(F.when(F.col("kind") == k, F.col("value")))).alias(k) for k in kinds))


def merged_entities(windows: DataFrame) -> DataFrame:
    """Entities of extraction windows (paper_id, kind, value, seq): one of each, in its first spelling."""
    clean = windows.withColumn("value", F.trim("value")).where("value <> '' and lower(value) <> 'null'")
    return clean.groupBy("paper_id", "kind", F.lower("value").alias("__v")).agg(F.min_by("value", "seq").alias("value"), F.min("seq").alias("seq")).drop("__v")


def merged_sections(windows: DataFrame) -> DataFrame:
    """Sections of extraction windows (paper_id, section_type, content, seq) joined in order."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("seq", "content"))), lambda x: x["content"])
    return windows.groupBy("paper_id", "section_type").agg(F.array_join(parts, "\n\n").alias("content"))


def storage(files: DataFrame, *by: str) -> DataFrame:
    """Files and bytes of a listing (path, length), by its groups."""
    return files.groupBy(*by).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def outcome_counts(outcomes: DataFrame, column: str = "action") -> DataFrame:
    """Counters of an import or a sync."""
    return outcomes.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
