"""Filtered listing of papers, lookups, partial updates, and the joins around a list page."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.staging import discard, staged

SORTS = ("title", "published_date", "updated_at")


def conjunction(*conditions: Column | None) -> Column:
    """All conditions that are given."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def has_keyword(keyword: str, keywords: Column | str = "keywords") -> Column:
    """A whole element, in either case."""
    return F.exists(keywords, lambda k: F.lower(k) == keyword.lower())


def with_entities(papers: DataFrame, entities: DataFrame, wanted: list[tuple[str, str]]) -> DataFrame:
    """Papers that have every wanted (kind, value)."""
    wanted = sorted(set(wanted))
    if not wanted:
        return papers
    either = reduce(lambda a, b: a | b, [(F.col("kind") == k) & (F.col("value") == v) for k, v in wanted])
    full = entities.where(either).groupBy("paper_id").agg(F.count_distinct("kind", "value").alias("n")).where(F.col("n") == len(wanted))
    return papers.join(full, papers["id"] == full["paper_id"], "left_semi")


def filtered(papers: DataFrame, status: str | None = None, paper_type: str | None = None, keyword: str | None = None) -> DataFrame:
    """Papers under the conditions that are given."""
    return papers.where(conjunction(F.col("status") == status if status else None, F.col("paper_type") == paper_type if paper_type else None, has_keyword(keyword) if keyword else None))


def ordered(papers: DataFrame, sort_by: str = "updated_at", ascending: bool = False) -> DataFrame:
    """In list order; a null sorts as the empty text; ties by id."""
    key = sort_by if sort_by in SORTS else "updated_at"
    c = F.col(key) if key == "updated_at" else F.coalesce(key, F.lit(""))
    return papers.orderBy(c.asc() if ascending else c.desc(), "id")


def page(papers: DataFrame, limit: int = 20, offset: int = 0, sort_by: str = "updated_at", ascending: bool = False) -> DataFrame:
    """One page of the list."""
    return ordered(papers, sort_by, ascending).offset(offset).limit(limit)


def page_summary(papers: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """``total, has_more`` of a list."""
    return papers.agg(F.count(F.lit(1)).alias("total")).withColumn("has_more", F.lit(offset + limit) < F.col("total"))


def by_key(df: DataFrame, **key) -> DataFrame:
    """The row of a key."""
    return df.where(conjunction(*(F.col(k) == v for k, v in key.items()))).limit(1)


def by_ids(df: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """Rows whose id is among the column ``id`` of ids."""
    return df.join(ids.select(F.col("id").alias("__id")), F.col(column) == F.col("__id"), "left_semi")


def ids_by_entity(entities: DataFrame, kind: str, value: str) -> DataFrame:
    """``paper_id`` of papers with an entity, each once."""
    return entities.where((F.col("kind") == kind) & (F.col("value") == value)).select("paper_id").distinct()


def ids_by_type(papers: DataFrame, paper_type: str) -> DataFrame:
    """``paper_id`` of papers of a type."""
    return papers.where(F.col("paper_type") == paper_type).select(F.col("id").alias("paper_id"))


def retryable(papers: DataFrame, status: str = "failed", max_retries: int = 3) -> DataFrame:
    """Papers of a status that were tried fewer times, latest first."""
    return papers.where((F.col("status") == status) & (F.col("retry_count") < max_retries)).orderBy(F.desc("updated_at"), "id")


def after_limit(hits: DataFrame, *allowed: DataFrame) -> DataFrame:
    """Hits in every allow-list of ``paper_id``; they are filtered after their limit, so fewer may be left."""
    return reduce(lambda a, b: a.join(b, "paper_id", "left_semi"), allowed, hits)


def partial_update(df: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Non-null values of changes replace those of df; rows without changes stay."""
    fields = [c for c in changes.columns if c != key]
    new = changes.select(F.col(key).alias("__k"), *(F.col(c).alias(f"__{c}") for c in fields))
    return df.join(new, F.col(key) == F.col("__k"), "left").select(*(F.coalesce(f"__{c}", c).alias(c) if c in fields else c for c in df.columns))


def metadata_overlay(df: DataFrame, found: DataFrame, key: str = "id", keep_old: bool = False) -> DataFrame:
    """Text fields that found has and that are not blank; with ``keep_old`` only where df has none.  ``changed`` tells."""
    fields = [c for c in found.columns if c != key]
    new = found.select(F.col(key).alias("__k"), *(F.col(c).alias(f"__{c}") for c in fields))
    take = {c: (F.trim(f"__{c}") != "") & ((F.coalesce(F.col(c), F.lit("")) == "") if keep_old else F.lit(True)) for c in fields}
    take = {c: F.coalesce(x, F.lit(False)) for c, x in take.items()}
    changed = reduce(lambda a, b: a | b, [x & ~F.col(c).eqNullSafe(F.col(f"__{c}")) for c, x in take.items()])
    joined = df.join(new, F.col(key) == F.col("__k"), "left")
    return joined.select(*(F.when(take[c], F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in df.columns), changed.alias("changed"))


def resolved_abstracts(papers: DataFrame, sections: DataFrame, section_first: bool = False) -> DataFrame:
    """``id, abstract``: the paper's own, else its abstract section; or the other way round."""
    own = sections.where(F.col("section_type") == "abstract").groupBy("paper_id").agg(F.min_by("content", "id").alias("__s"))
    order = ("__s", "abstract_text") if section_first else ("abstract_text", "__s")
    joined = papers.join(own, papers["id"] == own["paper_id"], "left")
    return joined.select("id", F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in order)).alias("abstract"))


def annotation_summary(ratings: DataFrame, comments: DataFrame) -> DataFrame:
    """``paper_id, rating, comment_count`` of papers with either.  Comments are counted before they are joined."""
    counts = comments.groupBy("paper_id").agg(F.count(F.lit(1)).alias("comment_count"))
    both = ratings.select("paper_id", "rating").join(counts, "paper_id", "full")
    return both.select("paper_id", "rating", F.coalesce("comment_count", F.lit(0)).alias("comment_count"))


def with_annotations(papers: DataFrame, summary: DataFrame) -> DataFrame:
    """A list page with its annotations, none as null and 0."""
    joined = papers.join(summary.withColumnRenamed("paper_id", "__p"), F.col("id") == F.col("__p"), "left").drop("__p")
    return joined.withColumn("comment_count", F.coalesce("comment_count", F.lit(0)))


def figures_with_titles(figures: DataFrame, papers: DataFrame) -> DataFrame:
    """Figures with their paper's title, '' where it has none."""
    titles = papers.select(F.col("id").alias("paper_id"), F.col("title").alias("paper_title"))
    return figures.join(titles, "paper_id", "left").withColumn("paper_title", F.coalesce("paper_title", F.lit("")))


def without_vectors(papers: DataFrame, vectors: DataFrame) -> DataFrame:
    """Papers that no vector belongs to."""
    return papers.join(vectors, papers["id"] == vectors["paper_id"], "left_anti")


def orphans(children: DataFrame, papers: DataFrame) -> DataFrame:
    """Distinct ``paper_id`` of children without their paper."""
    return children.select("paper_id").distinct().join(papers, F.col("paper_id") == papers["id"], "left_anti")


def ancestors(chunks: DataFrame, ids: DataFrame, most: int = 50) -> DataFrame:
    """``id, ancestor_id, steps``: the chain of parents of each chunk of ids, up to ``most`` steps; a cycle ends where it
    closes.

    Pointers are doubled: a round knows the ancestors of up to 2^k steps and the one that is 2^k steps up, and joins each
    chunk with what is known of that one.  So the rounds are the logarithm of the depth.  Where ids come with their papers,
    only those papers' chunks are read."""
    if "paper_id" in ids.columns:
        chunks = chunks.join(ids.select("paper_id").distinct(), "paper_id", "left_semi")
    parents = chunks.where("parent_id is not null").select("id", F.col("parent_id").alias("up"))
    jump = staged(parents.join(chunks.select(F.col("id").alias("up")), "up", "left_semi").select("id", "up"), "listing-jump")
    known = staged(jump.where("id <> up").select("id", F.col("up").alias("ancestor_id"), F.lit(1).alias("steps")), "listing-known")
    span, n = 1, -1
    while span < most:
        further = jump.join(known.select(F.col("id").alias("up"), F.col("ancestor_id").alias("top"), "steps"), "up").where("top <> id").select("id", F.col("top").alias("ancestor_id"), (F.col("steps") + span).alias("steps"))
        # in a cycle an ancestor is met again after more steps
        more = staged(known.unionAll(further).groupBy("id", "ancestor_id").agg(F.min("steps").alias("steps")), "listing-known")
        longer = staged(jump.join(jump.select(F.col("id").alias("up"), F.col("up").alias("top")), "up").select("id", F.col("top").alias("up")), "listing-jump")
        discard(known, jump)
        known, jump, span, before, n = more, longer, 2 * span, n, more.count()
        if n == before or jump.isEmpty():
            break
    return known.where(F.col("steps") <= most).join(ids.select("id"), "id", "left_semi")


def heading_paths(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, heading_path``: the contents of the chain of parents, root first."""
    chain = ancestors(chunks, ids).join(chunks.select(F.col("id").alias("ancestor_id"), "content"), "ancestor_id")
    return chain.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("steps")).alias("k"), "content"))), lambda x: x["content"]), " > ").alias("heading_path"))


def descendants(collections: DataFrame, roots: DataFrame) -> DataFrame:
    """Keys of the collections under roots, roots included, however deep.

    Pointers are doubled: a round knows which collections have a root within 2^k steps up, and asks for each the one that
    is 2^k steps up.  A round that finds no more is the last, as a path has no gaps."""
    seeds = roots.select("key").distinct()
    links = collections.where("parent is not null").groupBy("key").agg(F.min("parent").alias("up"))
    # a parent that is no row of its own is the end of its paths
    ends = links.select(F.col("up").alias("key")).distinct().join(links, "key", "left_anti").select("key", F.lit(None).cast(dict(links.dtypes)["up"]).alias("up"))
    under = staged(links.unionByName(ends).join(seeds.withColumn("hit", F.lit(True)), "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False))), "listing-under")
    n, before = under.where("hit").count(), -1
    while n != before:
        upper = under.select(F.col("key").alias("up"), F.col("up").alias("top"), F.col("hit").alias("above"))
        more = staged(under.join(upper, "up", "left").select("key", F.col("top").alias("up"), (F.col("hit") | F.coalesce("above", F.lit(False))).alias("hit")), "listing-under")
        discard(under)
        under, before, n = more, n, more.where("hit").count()
    return under.where("hit").select("key").unionByName(seeds).distinct()
