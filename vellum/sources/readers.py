"""Documents from folders: listings by format, and one extractor per format.

All formats come out as ``path, source, title, text, structured, authors, keywords, doi, error``; they are read by Spark's
own sources, so any file system that Spark knows will do.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import replies
from vellum.functions import text as tx

# Formats by extension.
FORMATS = {"pdf": ("pdf",), "markdown": ("md", "markdown"), "plain_text": ("txt", "text"), "latex": ("tex", "latex"), "office": ("docx",), "image": ("png", "jpg", "jpeg", "webp", "gif", "bmp", "tiff")}
COLUMNS = ("path", "source", "title", "text", "structured", "authors", "keywords", "doi", "error")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def source_of(path: Column) -> Column:
    """The format of a path; null if it is none."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.coalesce(*(F.when(ext.isin(*names), F.lit(kind)) for kind, names in FORMATS.items()))


def stem(path: Column) -> Column:
    """A file's name without folder and extension."""
    return F.regexp_replace(F.url_decode(F.replace(F.regexp_extract(path, r"([^/]+)$", 1), F.lit("+"), F.lit("%2B"))), r"\.[^.]+$", "")


def listing(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """``path, length, modificationTime, source`` of the supported files of a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.select("path", "length", "modificationTime", source_of(F.col("path")).alias("source")).where("source is not null")


def _files(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    glob = "*.{" + ",".join(x for e in FORMATS[kind] for x in (e, e.upper())) + "}"
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)


def _row(df: DataFrame, kind: str, **values: Column) -> DataFrame:
    none = {"title": stem(F.col("path")), "structured": F.lit(False), "authors": F.array().cast("array<string>"), "keywords": F.array().cast("array<string>"), "doi": F.lit(None).cast("string"), "error": F.lit(None).cast("string")}
    return df.select(*((none | {"path": F.col("path"), "source": F.lit(kind)} | values)[c].alias(c) for c in COLUMNS))


def _checked(text: Column) -> Column:
    return F.when(F.coalesce(tx.squeezed(text), F.lit("")) == "", F.lit("empty file"))


def read_plain(spark: SparkSession, folder: str, kind: str = "plain_text") -> DataFrame:
    """Whole files as text; an empty one has an error instead of being indexed."""
    text = F.decode("content", "UTF-8")
    return _row(_files(spark, folder, kind), kind, text=text, error=_checked(text))


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Markdown with title, authors, keywords and DOI from its front matter."""
    df = _files(spark, folder, "markdown").select("path", replies.front_matter(F.decode("content", "UTF-8")).alias("m"))
    return _row(df, "markdown", title=F.coalesce("m.title", stem(F.col("path"))), text=F.col("m.body"), structured=F.lit(True), authors=F.col("m.authors"), keywords=F.col("m.keywords"), doi=F.col("m.doi"), error=_checked(F.col("m.body")))


def docx_text(content: bytes) -> str:
    """Paragraphs, and table rows with their cells between bars, a line each."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    plain = {f"{_W}tab": "\t", f"{_W}br": "\n"}
    words = lambda e: "".join(plain.get(x.tag) or (x.text or "" if x.tag == f"{_W}t" else "") for x in e.iter())

    def lines(parent):
        for e in parent:
            if e.tag == f"{_W}p":
                yield words(e)
            elif e.tag == f"{_W}tbl":
                for row in e.findall(f"{_W}tr"):
                    yield " | ".join(" ".join(lines(cell)) for cell in row.findall(f"{_W}tc"))
            elif e.tag == f"{_W}sdt" and (inner := e.find(f"{_W}sdtContent")) is not None:
                yield from lines(inner)

    return "\n".join(lines(body))


def read_with(df: DataFrame, kind: str, extract: Callable[[bytes], str]) -> DataFrame:
    """Files (path, content) through an extractor; what it cannot read becomes an error."""

    def run(batches):
        for batch in batches:
            out = []
            for content in batch.column("content").to_pylist():
                try:
                    text = extract(content)
                    out.append((text, None if text.strip() else "empty file"))
                except Exception as e:  # any broken file is reported, none stops the others
                    out.append((None, f"{type(e).__name__}: {e}"[:200]))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([t for t, _ in out], pa.string()), pa.array([e for _, e in out], pa.string())], names=["path", "text", "error"])

    got = df.select("path", "content").mapInArrow(run, "path string, text string, error string")
    return _row(got, kind, text=F.col("text"), error=F.col("error"))


def no_pdf_text(content: bytes) -> str:
    raise NotImplementedError("pass an extractor of PDF text")


def read_documents(spark: SparkSession, folder: str, pdf: Callable[[bytes], str] = no_pdf_text) -> DataFrame:
    """All text formats of a folder."""
    parts = [read_markdown(spark, folder), read_plain(spark, folder), read_plain(spark, folder, "latex"), read_with(_files(spark, folder, "office"), "office", docx_text), read_with(_files(spark, folder, "pdf"), "pdf", pdf)]
    return reduce(DataFrame.unionByName, parts)


def read_images(spark: SparkSession, folder: str, describe: Callable[[bytes], str] | None = None) -> DataFrame:
    """Images as papers: a description from a callable, else the file's name."""
    files = _files(spark, folder, "image")
    if describe is None:
        return _row(files, "image", text=stem(F.col("path")))
    return read_with(files, "image", describe)


def _free(used: set[str], name: str, nexts: dict[str, int], start: int) -> str:
    """The first free of name, name + start, name + start + 1 and so on; where the search for a name ended, it goes on."""
    n = nexts.get(name, start)
    while f"{name}{n}" in used:
        n += 1
    nexts[name] = n + 1
    return f"{name}{n}"


def figure_ids(figures: DataFrame) -> DataFrame:
    """figures (paper_id, seq, label) with ``id``: the paper and the sanitised label, or the first free of its suffixes from
    _2 on; a figure without a usable label has the first free number from its place among the paper's figures on.

    An id depends on those before it, so a paper's figures are folded in order: they stand together in a partition, and
    what is held is the ids of one paper."""
    names = figures.columns
    label = tx.sanitised_label(F.coalesce("label", F.lit("")))
    schema = figures.withColumn("id", F.lit("")).schema

    def fold(batches):
        paper, used, nexts, place = object(), set(), {}, 0
        for batch in batches:
            ids = []
            for p, text in zip(batch.column("paper_id").to_pylist(), batch.column("__l").to_pylist(), strict=True):
                if p != paper:
                    paper, used, nexts, place = p, set(), {}, 0
                place += 1
                stem_ = f"{p}_fig_{text}" if text else f"{p}_fig"
                found = stem_ if text and stem_ not in used else _free(used, f"{stem_}_", nexts, 2) if text else _numbered(used, stem_, place)
                used.add(found)
                ids.append(found)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(ids, pa.string())], names=[*names, "id"])

    together = figures.withColumn("__l", label).repartition("paper_id").sortWithinPartitions("paper_id", "seq")
    return together.mapInArrow(fold, schema)


def _numbered(used: set[str], name: str, start: int) -> str:
    while f"{name}{start}" in used:
        start += 1
    return f"{name}{start}"


def kept_images(images: DataFrame, max_share: float = 0.9) -> DataFrame:
    """Images (doc_id, page, width, height, length, page_area, hash, seq) that are good enough to be figures: large enough,
    not the whole page, and of equal ones in a document the first."""
    good = images.where(tx.image_verdict(F.col("length"), F.col("width"), F.col("height")).isNull()).where(F.col("page_area").isNull() | (F.col("width") * F.col("height") <= max_share * F.col("page_area")))
    first = Window.partitionBy("doc_id", "hash").orderBy("page", "seq")
    return good.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
