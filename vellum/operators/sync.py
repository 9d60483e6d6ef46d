"""Library sync: what to fetch, what to remove, and how items meet papers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sync_plan(remote: DataFrame, local: DataFrame, complete: bool = True) -> DataFrame:
    """``key, action`` (fetch, remove, up_to_date) from remote (key, version) and local (key, version).  An incomplete
    listing removes nothing."""
    r = remote.groupBy("key").agg(F.max("version").alias("rv"))
    joined = r.join(local.select("key", F.col("version").alias("lv")), "key", "full")
    action = F.when(F.col("rv").isNull(), "remove").when(F.col("lv").isNull() | (F.col("rv") > F.col("lv")), "fetch").otherwise("up_to_date")
    plan = joined.select("key", action.alias("action"))
    return plan if complete else plan.where("action <> 'remove'")


def matched_items(items: DataFrame, papers: DataFrame) -> DataFrame:
    """Items (key, file_path) with the paper they are: by external id, else by file path."""
    by_key = papers.where("source is not null").select(F.col("source").alias("key"), F.col("id").alias("__a"))
    by_path = papers.where("file_path is not null").groupBy("file_path").agg(F.min("id").alias("__b"))
    joined = items.join(by_key, "key", "left").join(by_path, "file_path", "left")
    how = F.when(F.col("__a").isNotNull(), "external_id").when(F.col("__b").isNotNull(), "file_path").otherwise("new")
    return joined.select(*items.columns, F.coalesce("__a", "__b").alias("paper_id"), how.alias("matched_by"))


def version_watermark(old: int, listed: DataFrame) -> int:
    """The largest version seen; it never goes back."""
    seen = listed.agg(F.max("version")).first()[0]
    return max(old, seen or 0)


def union_in_order(*listings: DataFrame) -> DataFrame:
    """Distinct items of several listings (key, ...), each where it came first."""
    from functools import reduce

    tagged = [x.withColumn("__l", F.lit(i)) for i, x in enumerate(listings)]
    rest = [c for c in listings[0].columns if c != "key"]
    return reduce(DataFrame.unionByName, tagged).groupBy("key").agg(*(F.min_by(c, "__l").alias(c) for c in rest), F.min("__l").alias("listing"))
