"""What the corpus operators share: staged tables, Arrow batches cut by bytes, and vectorised words.

A word is a maximal run of bytes other than space and 0x09-0x0D.  Hashes are 64-bit: a polynomial over
the word's bytes modulo 2**64, then a finalising mix.
"""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step looks at; a longer document is a step of its own.
CHUNK_BYTES = 2 << 20
#: Rows per Arrow batch handed to Python, so that a batch of long texts stays small.
ARROW_ROWS = 1000
#: Java and DuckDB pattern of a separator run.
SEPARATORS = r"[\x20\x09-\x0D]+"

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C55
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


_places: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_recorders: list[list[tuple[SparkSession, str]]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir.  Where it is unset a local master gets a folder
    of its own; a cluster is an error, as its machines would each write to another disk."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="vellum-shared-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


@contextmanager
def files_cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the executions inside go as each ends: what they wrote stands for them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it again: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vellum/{name}-{uuid.uuid4().hex}"
    for made in _recorders:
        made.append((spark, path))
    with files_cleaned(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _places[out] = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing will read again."""
    for df in tables:
        if path := _places.pop(df, None):
            _delete(df.sparkSession, path)


def moved(table: DataFrame, view: DataFrame) -> DataFrame:
    """A view of a staged table that stands for it from now on."""
    if path := _places.pop(table, None):
        _places[view] = path
    return view


@contextmanager
def recorded() -> Iterator[list[tuple[SparkSession, str]]]:
    """The tables that are staged inside, for ``release`` once what reads them is written."""
    made: list[tuple[SparkSession, str]] = []
    _recorders.append(made)
    try:
        yield made
    finally:
        _recorders[:] = [x for x in _recorders if x is not made]


def release(made: list[tuple[SparkSession, str]]) -> None:
    """Deletes recorded tables; those that are gone already are passed over."""
    while made:
        _delete(*made.pop())


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with small batches.  Plans are lazy and read the size when they run, so it stays set on the session."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return df.mapInArrow(function, schema)


def n_words(text: Column) -> Column:
    """Words of a text, in the JVM; null and empty texts have none."""
    return F.coalesce(F.size(F.array_remove(F.split(text, SEPARATORS), "")), F.lit(0)).cast("long")


def id_order(doc_id: Column) -> Column:
    """Ids as compared: a null id is larger than any other."""
    return F.coalesce(doc_id.cast("long"), F.lit((1 << 63) - 1))


def by_bytes(texts: list[bytes], limit: int = 0) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with about CHUNK_BYTES bytes."""
    limit, start, total = limit or CHUNK_BYTES, 0, 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > limit:
            yield start, i
            start, total = i, 0
        total += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def encoded(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """The finalising mix of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) <= n:
        up = np.full(n + 1, _BASE, np.uint64)
        down = np.full(n + 1, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of data[start:end] for each span."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data * up[: len(data)], dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, starts, ends, first): all words of texts; those of text i are first[i]:first[i + 1]."""
    joined = b"\n".join([b"", *texts, b""])
    data = np.frombuffer(joined.lower() if lower else joined, np.uint8)
    edge = np.diff(~_SPACE[data])
    edges = np.flatnonzero(edge) + 1
    starts, ends = edges[::2], edges[1::2]
    places = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return data, starts, ends, np.searchsorted(starts, places)
