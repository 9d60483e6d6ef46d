"""Segmenting documents: heading trees, overlapping windows, extraction windows and batches.

A document's segments depend on one another, so each is cut by plain Python inside ``mapInArrow``: one pass, no shuffle.
"""

from __future__ import annotations

import re
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_HEADING = re.compile(r"(#{1,6})\s")
_STOP = re.compile(r"[.!?](?=[ \t\n\f\r])|[。！？]")
#: Characters beyond its size that a window may take to end with a sentence.
REACH = 100


def _kind(line: str) -> tuple[str, int]:
    line = line.strip()
    if line.startswith("|"):
        return "table", 0
    m = _HEADING.match(line)
    return ("heading", len(m[1])) if m else ("text", 0)


def heading_tree(text: str) -> list[dict]:
    """Chunks of a Markdown text in order: ``name, parent, chunk_type, content, path, depth``.

    Headings are chunks of their own; what stands between two of them is one paragraph, tables aside.  Level 1 opens a
    chapter, level 2 a section of it; deeper headings hang under the section that is open and do not open one."""
    out, counters = [], {"block": 0, "paragraph": 0}
    chapter = section = None
    trail: dict[str | None, tuple[str, ...]] = {None: ()}

    def add(prefix: str, counter: str, kind: str, content: str, parent: str | None, heading: bool) -> str:
        counters[counter] += 1
        name = f"{prefix}{counters[counter]}"
        above = trail[parent]
        trail[name] = (*above, content)
        out.append({"name": name, "parent": parent, "chunk_type": kind, "content": content, "path": " > ".join(trail[name] if heading else above), "depth": len(above)})
        return name

    for (kind, _), lines in groupby(((_kind(x), x) for x in re.split(r"\r?\n", text)), key=lambda x: x[0]):
        block = [x for _, x in lines]
        if kind == "heading":
            for line in block:
                level, title = _kind(line)[1], line.strip().lstrip("#").strip()
                if level == 1:
                    chapter = section = add("s", "block", "chapter", title, None, True)
                elif level == 2:
                    section = add("s", "block", "section", title, chapter, True)
                else:
                    add("s", "block", "section", title, section, True)
        elif content := "\n".join(block).strip():
            if kind == "table":
                add("t", "block", "table", content, section, False)
            else:
                add("p", "paragraph", "paragraph", content, section, False)
    return out


def windows(text: str, size: int = 1500, overlap: int = 300) -> list[str]:
    """Windows of ``size`` characters, stretched to the end of a sentence or line nearby; each starts ``overlap`` before
    the end of the one before."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than the size")
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        near = text[end : end + REACH]
        stop = _STOP.search(near)
        if stop:
            end += stop.end()
        elif "\n" in near:
            end += near.index("\n")
        if part := text[start:end].strip():
            out.append(part)
        if end >= len(text):
            break
        start = max(start + 1, end - overlap)
    return out


def _hard_cut(part: str, most: int):
    while len(part) > most:
        line_end = part.rfind("\n", most // 2, most)
        cut = line_end + 1 if line_end >= 0 else most
        yield part[:cut]
        part = part[cut:]
    yield part


def extraction_windows(text: str, most: int) -> list[str]:
    """Parts of at most ``most`` characters, of whole paragraphs where they fit; nothing is lost but the breaks between
    parts."""
    if most <= 0 or len(text) <= most:
        return [text]
    out, held = [], None
    for paragraph in text.split("\n\n"):
        if len(paragraph) > most:
            out += [held] if held else []
            out += _hard_cut(paragraph, most)
            held = None
        elif held and len(held) + 2 + len(paragraph) > most:
            out.append(held)
            held = paragraph
        else:
            held = f"{held}\n\n{paragraph}" if held else paragraph
    return out + ([held] if held else []) or [text]


def _dealt(size: int, most: int, batch: int, used: int, held: bool) -> tuple[int, int]:
    """The batch that takes the next item, and what it holds then; an item larger than a batch is one of its own."""
    return (batch + 1, size) if held and used + size > most else (batch, used + size)


def batches(sizes: list[int], most: int = 2500, limit: int = 8) -> list[int]:
    """The batch of each item when packed in order into at most ``limit`` batches of ``most``; -1 beyond the last."""
    out, batch, used = [], 0, 0
    for k, n in enumerate(sizes):
        batch, used = _dealt(n, most, batch, used, k > 0)
        out.append(batch if batch < limit else -1)
    return out


def batched(chunks: DataFrame, most: int = 2500, limit: int = 8, span: int = 1000) -> DataFrame:
    """chunks (paper_id, seq, content) with ``batch``: those of a paper packed in order of ``seq`` into at most ``limit``
    batches of ``most`` characters; -1 beyond the last.  Null contents have no characters; of equal ``seq`` any is first.

    Where a batch ends depends on all before it, so a paper is folded in order.  What can still lie in a batch is known
    beforehand: with an item counted as ``most`` + 1 at most, the batches hold ``limit`` times that, so ranges of ``span``
    numbers that begin beyond are not folded, and no task gets more of a paper than its batches and a range."""
    names = chunks.columns
    size = F.char_length(F.coalesce("content", F.lit(""))).cast("long")
    sized = chunks.withColumns({"__z": size, "__k": F.floor(F.col("seq") / span)})
    ranges = sized.groupBy("paper_id", "__k").agg(F.sum(F.least("__z", F.lit(most + 1))).alias("__s"))
    before = F.sum("__s").over(Window.partitionBy("paper_id").orderBy("__k").rowsBetween(Window.unboundedPreceding, -1))
    near = ranges.withColumn("__near", F.coalesce(before, F.lit(0)) <= limit * (most + 1)).select(F.col("paper_id").alias("__i"), F.col("__k").alias("__j"), "__near")
    told = sized.join(near, F.col("paper_id").eqNullSafe(F.col("__i")) & F.col("__k").eqNullSafe(F.col("__j"))).drop("__i", "__j", "__k")
    schema = chunks.withColumn("batch", F.lit(0)).schema

    def fold(it):
        paper, batch, used, held = None, 0, 0, False
        for part in it:
            out = []
            for p, n in zip(part.column("paper_id").to_pylist(), part.column("__z").to_pylist(), strict=True):
                if not held or p != paper:
                    paper, batch, used, held = p, 0, 0, False
                batch, used = _dealt(n, most, batch, used, held)
                held = True
                out.append(batch if batch < limit else -1)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(out, pa.int32())], names=[*names, "batch"])

    together = told.where("__near").drop("__near").repartition("paper_id").sortWithinPartitions("paper_id", "seq")
    return together.mapInArrow(fold, schema).unionByName(told.where("not __near").select(*names, F.lit(-1).alias("batch")))


def _exploded(df: DataFrame, cut, columns: list[tuple[str, str]], id_col: str, text_col: str) -> DataFrame:
    names = ["paper_id", "seq", *(c for c, _ in columns)]
    kinds = {"string": pa.string(), "int": pa.int32()}

    def run(it):
        for batch in it:
            rows = [(i, k, *x) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k, x in enumerate(cut(t or ""))]
            data = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(data, [pa.string(), pa.int32(), *(kinds[t] for _, t in columns)], strict=True)], names=names)

    return df.select(F.col(id_col).cast("string"), text_col).mapInArrow(run, ", ".join(f"{n} {t}" for n, t in [("paper_id", "string"), ("seq", "int"), *columns]))


def chunk_markdown(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Chunks of each document: ids, parents, content, materialised path, level and depth."""
    keys = ("name", "parent", "chunk_type", "content", "path", "depth")
    raw = _exploded(df, lambda t: [tuple(x[k] for k in keys) for x in heading_tree(t)], [("name", "string"), ("parent", "string"), ("chunk_type", "string"), ("content", "string"), ("path", "string"), ("depth", "int")], id_col, text_col)
    full = lambda c: F.concat_ws("_", "paper_id", c)
    return raw.select(full("name").alias("id"), "paper_id", F.when(F.col("parent").isNotNull(), full("parent")).alias("parent_id"), "chunk_type", "content", "seq", "path", (F.col("depth") + 1).alias("level"), "depth")


def chunk_windows(df: DataFrame, size: int = 1500, overlap: int = 300, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Overlapping windows of each document as paragraph chunks."""
    raw = _exploded(df, lambda t: [(x,) for x in windows(t, size, overlap)], [("content", "string")], id_col, text_col)
    return raw.select(F.concat("paper_id", F.lit("_c"), (F.col("seq") + 1).cast("string")).alias("id"), "paper_id", F.lit("paragraph").alias("chunk_type"), "content", "seq")


def text_windows(df: DataFrame, most: int, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Extraction windows of each document."""
    return _exploded(df, lambda t: [(x,) for x in extraction_windows(t, most)], [("content", "string")], id_col, text_col)
