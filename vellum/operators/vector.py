"""Exact vector search: cosine over all rows that pass the filters.

A vector's norm is kept beside it.  One query is an array literal in the plan; many queries and all rows are dealt into
blocks, and every block of the ones meets every block of the others.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.staging import staged

MAX_RESULTS, MIN_SCORE = 1000, 0.1
#: Rows of a block, about, when many queries meet all vectors.
QUERY_BLOCK, VECTOR_BLOCK = 4096, 4096
#: Of more blocks than this, one in so many rows is searched first, for the score that the others must reach.
SAMPLED = 32


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def with_norm(vectors: DataFrame, column: str = "vector") -> DataFrame:
    """vectors with ``norm``, to be kept when they are written."""
    return vectors.withColumn("norm", F.sqrt(dot(F.col(column), F.col(column))))


def scored(vectors: DataFrame, query: list[float], column: str = "vector") -> DataFrame:
    """vectors with ``score``, the cosine with the query; a vector of another dimension is an error, one of norm 0 scores 0."""
    norm = math.sqrt(sum(x * x for x in query))
    v = F.when(F.size(column) != len(query), F.raise_error(F.lit(f"vectors must have {len(query)} dimensions")).cast("array<float>")).otherwise(F.col(column))
    own = F.col("norm") if "norm" in vectors.columns else F.sqrt(dot(v, v))
    cosine = dot(v, F.array(*(F.lit(float(x)) for x in query))) / (own * norm)
    return vectors.withColumn("score", F.coalesce(F.when((own > 0) & F.lit(norm > 0), cosine), F.lit(0.0)))


def search(vectors: DataFrame, query: list[float], k: int, min_score: float = MIN_SCORE, content_type: str | None = None, section_type: str | None = None, id_col: str = "id") -> DataFrame:
    """The k best rows at ``min_score`` or above; equal filters reach the scan, the limit is a top-k."""
    for column, value in (("content_type", content_type), ("section_type", section_type)):
        vectors = vectors.where(F.col(column) == value) if value is not None else vectors
    return scored(vectors, query).where(F.col("score") >= min_score).orderBy(F.desc("score"), id_col).limit(min(k, MAX_RESULTS))


def _dealt(df: DataFrame, key: str, own: str, n: int, other: str, others: int) -> DataFrame:
    """df dealt into n blocks by a hash of the key, once for each of the other side's blocks."""
    return df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))))


def _best(s: np.ndarray, k: int) -> np.ndarray:
    """Which k entries of each row are the largest; of equal ones the first."""
    if s.shape[1] <= k:
        return np.ones(s.shape, bool)
    least = np.partition(s, -k, axis=1)[:, -k, None]
    more, same = s > least, s == least
    return more | (same & (np.cumsum(same, axis=1) <= k - more.sum(1, keepdims=True)))


def search_many(vectors: DataFrame, queries: DataFrame, k: int, min_score: float = -1.0, id_col: str = "id") -> DataFrame:
    """The k best rows of each query (query_id, query): every block of vectors is multiplied by every block of queries, and
    only those of its k best per query leave it that can be among the k best of all.

    The k-th best score of a sample of the rows is one that the k-th best of all reaches too.  So with many blocks a
    sample of one row in SAMPLED is searched first, by the same rule, and a block sends what reaches its score: about
    SAMPLED * k rows per query, however many blocks there are.  Scores of one row may differ in their last digits between
    two searches, so a little less is enough.  Query ids are not null and not repeated."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), id_col))
    return candidates(vectors, queries, k, min_score, id_col).withColumn("rank", place).where(F.col("rank") <= k)


def candidates(vectors: DataFrame, queries: DataFrame, k: int, min_score: float = -1.0, id_col: str = "id", level: int = 0) -> DataFrame:
    """``query_id, id, score``: rows among which are the k best of each query; what blocks send in ``search_many``."""
    kind, qkind = dict(vectors.dtypes)[id_col], dict(queries.dtypes)["query_id"]
    n, m = (max(1, -(-df.count() // size)) for df, size in ((queries, QUERY_BLOCK), (vectors, VECTOR_BLOCK)))
    floor = F.lit(-2.0)
    if m > SAMPLED:
        # each level draws by a hash of its own, so that a sample of the sample is one row in SAMPLED of it
        sample = staged(vectors.select(id_col, "vector").where(F.pmod(F.xxhash64(F.lit(level), id_col), F.lit(SAMPLED)) == 0), "vector-sample")
        best = F.sort_array(F.collect_list("score"), asc=False)
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
        reached = candidates(sample, queries, k, -1.0, id_col, level + 1).withColumn("place", place).where(F.col("place") <= k)
        floors = reached.groupBy("query_id").agg(F.get(best, F.lit(k - 1)).alias("floor"))
        queries, floor = queries.join(staged(floors, "vector-floors"), "query_id", "left"), F.coalesce(F.col("floor") - 1e-9, floor)
    v = _dealt(vectors.select(F.col(id_col).alias("__id"), "vector"), "__id", "__v", m, "__q", n)
    q = _dealt(queries.select("query_id", "query", floor.alias("floor")), "query_id", "__q", n, "__v", m)

    def unit(rows):
        x = np.asarray(rows.tolist(), np.float64)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    def best_of(block, asked):
        if block.empty or asked.empty:
            return pd.DataFrame({"query_id": asked["query_id"].iloc[:0], id_col: block["__id"].iloc[:0], "score": np.zeros(0)})
        block = block.sort_values("__id", kind="stable")
        ids, names, columns, found = block["__id"].to_numpy(), asked["query_id"].to_numpy(), unit(block["vector"]).T, []
        least = np.maximum(asked["floor"].to_numpy(), min_score)[:, None]
        for at in range(0, len(names), 256):
            s = unit(asked["query"].iloc[at : at + 256]) @ columns
            i, j = np.nonzero(_best(s, k) & (s >= least[at : at + 256]))
            found.append(pd.DataFrame({"query_id": names[at + i], id_col: ids[j], "score": s[i, j]}))
        return pd.concat(found)

    return v.groupBy("__v", "__q").cogroup(q.groupBy("__v", "__q")).applyInPandas(best_of, f"query_id {qkind}, `{id_col}` {kind}, score double")


def per_paper(hits: DataFrame, k: int | None = None, snippet: int = 300) -> DataFrame:
    """Hits by paper: the best score, not below 0, and the matched sections, best first."""
    text = F.substring(F.coalesce("chunk_text", F.lit("")), 1, snippet)
    sections = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("__k"), "section_type", text.alias("content_snippet"), "score")))
    out = hits.groupBy("paper_id").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("score"), F.transform(sections, lambda x: F.struct(x["section_type"], x["content_snippet"], x["score"])).alias("matched_sections"))
    out = out.orderBy(F.desc("score"), "paper_id")
    return out if k is None else out.limit(k)


def centroid(vectors: DataFrame, column: str = "vector") -> list[float] | None:
    """The mean of vectors by dimension: one row per dimension leaves the executors."""
    means = vectors.select(F.posexplode(column).alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("x")).orderBy("pos").collect()
    return [r["x"] for r in means] or None


def similar(vectors: DataFrame, paper_id: str, k: int = 5, min_score: float = MIN_SCORE, section_type: str | None = None, exclude_first: bool = False) -> DataFrame:
    """Papers near the centroid of a paper's section vectors.  The paper itself is dropped after the cut to k, so that
    k - 1 may be left, unless ``exclude_first``."""
    own = vectors.where((F.col("paper_id") == paper_id) & (F.col("content_type") == "section"))
    middle = centroid(own if section_type is None else own.where(F.col("section_type") == section_type))
    if middle is None:
        raise LookupError(f"no vectors of paper {paper_id}")
    hits = search(vectors, middle, min(3 * k, 500), min_score, section_type=section_type)
    if exclude_first:
        return per_paper(hits.where(F.col("paper_id") != paper_id), k)
    return per_paper(hits, k).where(F.col("paper_id") != paper_id)


def search_figures(vectors: DataFrame, query: list[float], papers: DataFrame, figures: DataFrame, k: int = 20, min_score: float = MIN_SCORE) -> DataFrame:
    """Figures by vector; a figure vector's section type is its figure's id."""
    hits = search(vectors, query, min(3 * k, 500), min_score, content_type="figure").select("paper_id", F.col("section_type").alias("figure_id"), "score")
    titled = hits.join(papers.select(F.col("id").alias("paper_id"), F.col("title").alias("paper_title")), "paper_id")
    named = figures.select("paper_id", F.col("id").alias("figure_id"), "caption", "description", "image_path", "page_number")
    return titled.join(named, ["paper_id", "figure_id"]).orderBy(F.desc("score"), "figure_id").limit(k)


def of_paper(vectors: DataFrame, paper_id: str, content_type: str | None = None) -> DataFrame:
    """A paper's vectors by id."""
    own = vectors.where(F.col("paper_id") == paper_id)
    return (own if content_type is None else own.where(F.col("content_type") == content_type)).orderBy("id")


def embed_words(texts: list[str], dimension: int = 64) -> list[list[float]]:
    """The default embedding, without a model: words hashed to signed places, of length 1."""
    import zlib

    out = np.zeros((len(texts), dimension), np.float32)
    for i, t in enumerate(texts):
        for w in re.findall(r"\w+", (t or "").lower()):
            h = zlib.crc32(w.encode())
            out[i, h % dimension] += 1.0 if h >> 16 & 1 else -1.0
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()


def embedded(df: DataFrame, text_col: str, embed: Callable[[list[str]], list[list[float]]] = embed_words, dimension: int = 64, batch: int = 8) -> DataFrame:
    """df with ``vector``, from an injected function of at most ``batch`` texts; another dimension is an error."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        out: list = []
        for at in range(0, len(texts), batch):
            got = embed([t or "" for t in texts.iloc[at : at + batch]])
            if len(got) != len(texts.iloc[at : at + batch]) or any(len(v) != dimension for v in got):
                raise ValueError(f"the model must return a vector of {dimension} dimensions for each text")
            out += got
        return pd.Series(out)

    return df.withColumn("vector", run(F.col(text_col)))


def embedded_figures(figures: DataFrame, embed_image: Callable[[bytes], list[float] | None], embed: Callable[[list[str]], list[list[float]]] = embed_words, dimension: int = 64, image_col: str = "image", text_col: str = "text") -> DataFrame:
    """figures with ``vector`` and ``embedded_as``: of the image, where a model of images gives a vector of the dimension, else
    of the text; a figure with neither has no vector."""

    @F.pandas_udf("vector array<float>, embedded_as string")
    def run(images: pd.Series, texts: pd.Series) -> pd.DataFrame:
        out: list = []
        for image, text in zip(images, texts, strict=True):
            try:
                found = embed_image(bytes(image)) if image is not None else None
            except Exception:  # a model that fails on an image leaves the text
                found = None
            if found is not None and len(found) == dimension:
                out.append((found, "image"))
            elif text and text.strip():
                out.append((embed([text])[0], "text"))
            else:
                out.append((None, None))
        return pd.DataFrame(out, columns=["vector", "embedded_as"])

    return figures.withColumn("__e", run(F.col(image_col), F.col(text_col))).withColumns({"vector": F.col("__e.vector"), "embedded_as": F.col("__e.embedded_as")}).drop("__e")


def must_rebuild(meta: dict[str, str], fingerprint: str | None, dimension: int | None) -> bool:
    """Whether vectors of another model or dimension have to go; a model that does not answer changes nothing."""
    if fingerprint is None or dimension is None:
        return False
    return bool(meta) and (meta.get("embedding_fingerprint") != fingerprint or meta.get("embedding_dimension") != str(dimension))
