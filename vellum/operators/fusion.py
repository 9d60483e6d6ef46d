"""Rank fusion and hybrid search.

Ranked lists are unions of (leg, paper_id, score, matched_sections); ranks are a window per leg, and fusion is one
grouped sum.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.query import Profile
from vellum.operators import fulltext, vector

RRF_K, SHOWN_SECTIONS = 60, 5
PRUNE_SHARE, PRUNE_WEIGHT, PATH_WEIGHT = 0.15, 0.7, 0.5
RERANK_LEAST, RERANK_MOST, RERANK_TOP = 5, 100, 20


def ranked(df: DataFrame, leg: str) -> DataFrame:
    """A list as a leg; ranks are from 0 by score, then id."""
    sections = F.col("matched_sections") if "matched_sections" in df.columns else F.array().cast("array<struct<section_type:string,content_snippet:string,score:double>>")
    place = F.row_number().over(Window.partitionBy("leg").orderBy(F.desc("score"), "paper_id")) - 1
    return df.select(F.lit(leg).alias("leg"), "paper_id", F.col("score").cast("double").alias("score"), sections.alias("matched_sections")).withColumn("rank", place)


def fuse(lists: DataFrame, weights: dict[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of legs (leg, rank, paper_id, matched_sections): ``paper_id, score, matched_sections``."""
    weight = F.lit(1.0)
    if weights:
        weight = F.element_at(F.create_map(*(x for leg, w in weights.items() for x in (F.lit(leg), F.lit(float(w))))), F.col("leg"))
    sections = F.slice(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("leg", "matched_sections"))), lambda x: x["matched_sections"])), 1, SHOWN_SECTIONS)
    # the sum runs over sorted terms, so that it does not depend on the order of rows
    parts = F.sort_array(F.collect_list(weight / (k + F.col("rank"))))
    return lists.groupBy("paper_id").agg(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x).alias("score"), sections.alias("matched_sections")).orderBy(F.desc("score"), "paper_id")


def fuse_lists(lists: list[DataFrame], k: int = RRF_K) -> DataFrame | None:
    """Unweighted fusion; one list stays as it is, none is None."""
    if len(lists) < 2:
        return lists[0] if lists else None
    return fuse(reduce(DataFrame.unionByName, (ranked(x, f"{i:03d}") for i, x in enumerate(lists))), k=k)


def pruned(full_text: DataFrame, weight: float, k: int) -> DataFrame:
    """Full-text rows under a share of the best go, if more than k came and the semantic leg is trusted."""
    if weight <= PRUNE_WEIGHT:
        return full_text
    every = Window.partitionBy()
    # at most 2k rows
    return full_text.withColumn("__n", F.count(F.lit(1)).over(every)).withColumn("__m", F.max("score").over(every)).where((F.col("__n") <= k) | (F.col("score") >= PRUNE_SHARE * F.col("__m"))).drop("__n", "__m")


def normalised(fused: DataFrame) -> DataFrame:
    """Scores over the best."""
    return fused.withColumn("score", F.col("score") / F.max("score").over(Window.partitionBy()))


def hybrid(semantic: DataFrame | None, full_text: DataFrame | None, path: DataFrame | None, weight: float, k: int) -> DataFrame:
    """Three legs fused with weights 2w, 2(1 - w) and 0.5, over the best score, cut to k.  A leg that failed is None;
    without the first two there is nothing to return."""
    if semantic is None and full_text is None:
        raise RuntimeError("both the semantic and the full-text leg failed")
    legs = {"a_semantic": (semantic, 2 * weight), "b_fulltext": (None if full_text is None else pruned(full_text, weight, k), 2 * (1 - weight)), "c_path": (path, PATH_WEIGHT)}
    have = {leg: (df, w) for leg, (df, w) in legs.items() if df is not None}
    lists = reduce(DataFrame.unionByName, (ranked(df, leg) for leg, (df, _) in have.items()))
    return normalised(fuse(lists, {leg: w for leg, (_, w) in have.items()}).limit(k))


def attempt(leg: Callable[[], DataFrame], most: int = 2 * vector.MAX_RESULTS) -> DataFrame | None:
    """A leg's best rows, at most ``most``; None if it fails, whether it is planned or run.  A leg is a list of the best
    few, so that it is run here once and its rows go on."""
    try:
        df = leg()
        rows = df.orderBy(F.desc("score"), "paper_id").limit(most).collect()
    except Exception:  # a leg may fail in any way; the others answer
        return None
    return df.sparkSession.createDataFrame(rows, df.schema)


def hybrid_search(text: str, index: fulltext.Index, papers: DataFrame, chunks: DataFrame, vectors: DataFrame, embed: Callable[[list[str]], list[list[float]]] = vector.embed_words, k: int = 20, min_score: float = vector.MIN_SCORE, profile: Profile | None = None) -> DataFrame:
    """Hybrid search with weights, minimum score and k from the query's profile; a given profile leaves k alone."""
    own = profile or Profile.of(text)
    k = k if profile else own.top_k(k)
    least = min_score * (0.5 if own.complexity == "complex" else 1.0)
    titles = papers.select(F.col("id").alias("paper_id"))
    semantic = attempt(lambda: vector.per_paper(vector.search(vectors, embed([text])[0], min(5 * k, 500), least).join(titles, "paper_id", "left_semi"), k))
    words = attempt(lambda: fulltext.search_papers(index, papers, text, 2 * k))
    path = attempt(lambda: fulltext.path_overlap(chunks, text, 2 * k).join(titles, "paper_id", "left_semi"))
    return hybrid(semantic, words, path, own.weight, k)


def search_papers(method: str, text: str, index: fulltext.Index, papers: DataFrame, chunks: DataFrame, vectors: DataFrame, embed: Callable[[list[str]], list[list[float]]] = vector.embed_words, k: int = 20, min_score: float = vector.MIN_SCORE) -> DataFrame:
    """By method; an empty semantic result falls back to full text."""
    if method == "fulltext":
        return fulltext.search_papers(index, papers, text, k)
    if method == "semantic":
        hits = vector.search(vectors, embed([text])[0], min(5 * k, 500), min_score)
        return fulltext.search_papers(index, papers, text, k) if hits.isEmpty() else vector.per_paper(hits, k)
    return hybrid_search(text, index, papers, chunks, vectors, embed, k, min_score)


def reranked(hits: DataFrame, query: str, score: Callable[[str, list[str]], list[float]] | None, top_n: int = RERANK_TOP, text_col: str = "chunk_text", id_col: str = "id") -> DataFrame:
    """Hits (at most 1000) ordered anew by a model's scores.

    Of the first 100, those with text are scored and the top_n best come first; the rest of the 100 is gone; later rows
    follow as they were.  Fewer than five hits, no model, or a model that fails, leave the order alone."""
    rows = hits.orderBy(F.desc("score"), id_col).limit(vector.MAX_RESULTS).toPandas()
    if score is None or len(rows) < RERANK_LEAST:
        return hits.sparkSession.createDataFrame(rows, hits.schema)
    head = rows.iloc[:RERANK_MOST]
    head = head[head[text_col].fillna("").str.strip() != ""]
    try:
        scores = score(query, head[text_col].tolist())
    except Exception:  # the order of the index stands in
        return hits.sparkSession.createDataFrame(rows, hits.schema)
    head = head.assign(score=scores).sort_values(["score", id_col], ascending=[False, True]).head(min(top_n, len(head)))
    return hits.sparkSession.createDataFrame(pd.concat([head, rows.iloc[RERANK_MOST:]]), hits.schema)
