"""Exports of a library: tables, sections and full papers, rendered by expressions and written by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as tx


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Every table as Parquet."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def _sections_of(papers: DataFrame, sections: DataFrame, *fields: str) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct("id", *fields)))
    per = sections.groupBy(F.col("paper_id").alias("__p")).agg(F.transform(rows, lambda x: F.struct(*(x[f].alias(f) for f in fields))).alias("sections"))
    empty = F.array().cast(f"array<struct<{','.join(f'{f}:string' for f in fields)}>>")
    return papers.join(per, F.col("id") == F.col("__p"), "left").drop("__p").withColumn("sections", F.coalesce("sections", empty))


def section_records(papers: DataFrame, sections: DataFrame) -> DataFrame:
    """A record per paper with its sections inside."""
    return _sections_of(papers, sections, "section_type", "content", "content_hash").select(F.col("id").alias("paper_id"), "title", "sections")


def paper_records(papers: DataFrame, sections: DataFrame) -> DataFrame:
    """A record per paper with metadata, abstract and sections."""
    fields = ("title", "authors", "affiliations", "emails", "published_date", "venue", "doi")
    return _sections_of(papers, sections, "section_type", "content").select("id", *fields, F.col("abstract_text").alias("abstract"), "keywords", "urls", "extra", "sections")


def section_lines(papers: DataFrame, sections: DataFrame) -> DataFrame:
    """``value``: a CSV line per section; its content is always quoted and has no line ends."""
    joined = sections.join(papers.select(F.col("id").alias("paper_id"), "title"), "paper_id")
    content = F.replace(F.replace("content", F.lit('"'), F.lit('""')), F.lit("\n"), F.lit(" "))
    return joined.orderBy("paper_id", "id").select(F.concat(tx.csv_field(F.col("paper_id")), F.lit(","), tx.csv_field(F.coalesce("title", F.lit(""))), F.lit(","), "section_type", F.lit(',"'), content, F.lit('"')).alias("value"))


def write_json(records: DataFrame, folder: str) -> None:
    records.write.mode("overwrite").json(folder)


def write_csv(lines: DataFrame, folder: str) -> None:
    """Lines with the header in every part."""
    lines.select(F.col("value").alias("paper_id,title,section_type,content")).write.mode("overwrite").option("header", "true").option("quote", "").option("escape", "").option("sep", "\x01").csv(folder)


def _line(label: str, value: Column, after: str = "\n") -> Column:
    return F.concat(F.lit(label), value, F.lit(after))


def _joined(c: str, sep: str = ", ") -> Column:
    return F.when(F.size(c) > 0, F.array_join(c, sep))


def bibliography(abstract: Column) -> Column:
    """The plain header of a paper."""
    parts = [_line("Title: ", F.coalesce("title", F.lit(""))), _line("Authors: ", F.array_join("authors", ", ")), _line("Date: ", F.col("published_date")), _line("Venue: ", F.col("venue")), _line("DOI: ", F.col("doi")), _line("Keywords: ", _joined("keywords")), _line("URLs: ", _joined("urls")), _line("Abstract:\n", abstract)]
    return F.concat_ws("", *parts)


def summaries(papers: DataFrame, sections: DataFrame, abstracts: DataFrame) -> DataFrame:
    """``id, summary``: the header and the names of the sections that are not empty."""
    names = F.array_join(F.transform(F.filter("sections", lambda s: s["content"] != ""), lambda s: s["section_type"]), ", ")
    rows = _sections_of(papers, sections, "section_type", "content").join(abstracts, "id", "left")
    return rows.select("id", F.concat_ws("", bibliography(F.col("abstract")), _line("Sections: ", F.nullif(names, F.lit("")))).alias("summary"))


def markdown(papers: DataFrame, sections: DataFrame, abstracts: DataFrame) -> DataFrame:
    """``name, value``: each paper as a Markdown document and its file name, which has the id too, as titles repeat."""
    rows = _sections_of(papers, sections, "section_type", "content").join(abstracts, "id", "left")
    parts = [
        _line("# ", F.coalesce("title", F.lit("")), "\n\n"), _line("**Authors**: ", F.array_join("authors", ", "), "\n\n"), _line("**Date**: ", F.col("published_date"), "\n\n"), _line("**Venue**: ", F.col("venue"), "\n\n"),
        _line("**DOI**: ", F.col("doi"), "\n\n"), _line("## Abstract\n\n", F.col("abstract"), "\n\n"), _line("**Keywords**: ", _joined("keywords"), "\n\n"), _line("**URLs**: ", _joined("urls"), "\n\n"),
        F.array_join(F.transform(F.filter("sections", lambda s: s["content"] != ""), lambda s: F.concat(F.lit("## "), s["section_type"], F.lit("\n\n"), s["content"], F.lit("\n\n"))), ""),
    ]
    return rows.select(F.concat(tx.safe_file_name(F.coalesce("title", "id")), F.lit("_"), tx.safe_file_name(F.col("id")), F.lit(".md")).alias("name"), F.concat_ws("", *parts).alias("value"))


def yaml_header(title: Column, authors: Column, doi: Column) -> Column:
    """A front matter block."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.concat(F.lit("---\ntitle: "), quoted(title), F.lit("\nauthors: ["), F.array_join(F.transform(authors, quoted), ", "), F.lit("]\n"), F.coalesce(_line("doi: ", quoted(doi)), F.lit("")), F.lit("---\n\n"))


def write_markdown(documents: DataFrame, folder: str) -> None:
    """A JSON line of name and value per document; ``unpack_markdown`` makes files of them."""
    documents.select("name", "value").write.mode("overwrite").json(folder)


def unpack_markdown(spark, packed: str, folder: str) -> int:
    """A file for each document of a written export, made by the executors in a folder that all of them see; their number.
    A file is written under a hidden name and renamed, so a task that is run again leaves whole files."""

    def write(rows):
        import os
        import uuid

        n = 0
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            hidden = os.path.join(folder, f".{uuid.uuid4().hex}")
            with open(hidden, "w", encoding="utf-8") as out:
                out.write(r["value"])
            os.replace(hidden, os.path.join(folder, r["name"]))
            n += 1
        yield n

    return sum(spark.read.schema("name string, value string").json(packed).rdd.mapPartitions(write).collect())


def export_counts(papers: DataFrame, sections: DataFrame) -> DataFrame:
    """Papers and sections that an export holds."""
    return papers.agg(F.count(F.lit(1)).alias("papers")).join(sections.join(papers, sections["paper_id"] == papers["id"], "left_semi").agg(F.count(F.lit(1)).alias("sections")))
