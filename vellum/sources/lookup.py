"""Files by search terms: which file has a paper's title, id or DOI in its name.

A name contains a term if it contains the term's rarest gram and then the term itself.  So the grams of all names are an
index, each term meets the names under the gram that fewest names have, and only those pairs are compared.  A term
with a gram that no name has ends there.  Terms and names are taken once, however many papers or folders share them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a gram; a shorter term is a gram itself.
GRAM = 4
#: Folders below a search path that are looked into, and characters of a title that name a file.
DEPTH, TITLE_CHARS = 6, 40


def search_terms(title: Column, paper_id: Column, doi: Column, title_chars: int = TITLE_CHARS) -> Column:
    """The title, cut and with underscores for spaces, the id and the DOI with underscores for slashes, in lower case.
    An empty term names no file."""
    parts = F.array(F.replace(F.substring(title, 1, title_chars), F.lit(" "), F.lit("_")), paper_id, F.replace(doi, F.lit("/"), F.lit("_")))
    return F.array_distinct(F.filter(F.transform(parts, F.lower), lambda x: x.isNotNull() & (x != "")))


def grams(text: Column, size: Column | int = GRAM) -> Column:
    """The distinct grams of a text; none if it is shorter."""
    size = F.lit(size) if isinstance(size, int) else size
    last = F.char_length(text) - size
    return F.when(last >= 0, F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.substring(text, k + 1, size)))).otherwise(F.array().cast("array<string>"))


def names_with(terms: DataFrame, names: DataFrame) -> DataFrame:
    """``term, name`` of distinct terms (term) and names (name) that contain them."""
    sized = terms.select("term", F.least(F.lit(GRAM), F.char_length("term")).alias("size"))
    # the sizes that terms have: GRAM, and those of shorter terms
    sizes = sized.groupBy().agg(F.collect_set("size").alias("sizes"))
    each = names.crossJoin(F.broadcast(sizes)).select("name", F.explode("sizes").alias("size"))
    index = each.select("name", F.explode(grams(F.col("name"), F.col("size"))).alias("gram"))
    often = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    asked = sized.select("term", F.explode(grams(F.col("term"), F.col("size"))).alias("gram"))
    # a gram of no name has no count, and its term no name
    counted = asked.join(often, "gram", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
    rarest = counted.where("r.n > 0").select("term", F.col("r.gram").alias("gram"))
    return rarest.join(index, "gram").where(F.col("name").contains(F.col("term"))).select("term", "name")


def depth_below(path: Column, root: Column) -> Column:
    """Folders and file between a search path and a file: 1 for a file right in it."""
    return F.size(F.split(F.substr(path, F.char_length(root) + 1), "/")) - 1


def find_files(papers: DataFrame, files: DataFrame, title_chars: int = TITLE_CHARS, max_depth: int = DEPTH) -> DataFrame:
    """``id, path`` of papers (id, title, doi) for which a PDF (path, root, place: of the search path and its order) has a
    term in its name: of the first search path that has any, the first path.  The extension is in small letters."""
    inside = files.where(F.col("path").endswith(".pdf") & (depth_below(F.col("path"), F.rtrim(F.col("root"), F.lit("/"))) <= max_depth))
    named = inside.select("path", "place", F.lower(F.regexp_extract("path", r"([^/]+)$", 1)).alias("name"))
    first = named.groupBy("name").agg(F.min(F.struct("place", "path")).alias("f"))
    asked = papers.select("id", F.explode(search_terms(F.col("title"), F.col("id"), F.col("doi"), title_chars)).alias("term"))
    hits = names_with(asked.select("term").distinct(), first.select("name"))
    best = hits.join(first, "name").groupBy("term").agg(F.min("f").alias("f"))
    return asked.join(best, "term").groupBy("id").agg(F.min("f").alias("f")).select("id", F.col("f.path").alias("path"))


def listed(files: DataFrame, search_paths: list[str]) -> DataFrame:
    """Files (path) under the first of the search paths that holds them, with ``root`` and ``place``."""
    roots = [p.rstrip("/") for p in search_paths]
    where = F.coalesce(*(F.when(F.col("path").startswith(r + "/"), F.struct(F.lit(i).alias("place"), F.lit(r).alias("root"))) for i, r in enumerate(roots)))
    return files.withColumn("w", where).where("w is not null").select("path", "w.root", "w.place")

