"""Media columns by content-defined chunking.

A text's payload (UTF-8, zeros up to a positive multiple of 64) becomes a medium: a mono WAV file with 8-bit samples.
Media are cut where a rolling gear hash meets a mask, so equal stretches give equal chunks.  Chunks go by their SHA-256
into a store that holds each one once; a medium is an ordered list of chunks.  Reading joins the lists of distinct
media with the store, checks every chunk against its digest, and parses the WAV that results.

Null texts are empty (a payload of 64 zeros).  Equal texts are one medium, stored and read once.  A row's medium must
fit a task; a chunk has at most MAX_CHUNK bytes.  Empty tables give empty results.  Only the id and the text are read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm._support import encoded, files_cleaned, map_arrow, mix, staged

MIN_CHUNK, MEAN_BITS, MAX_CHUNK = 4 << 10, 14, 64 << 10
RATE = 8000
#: Media that share one copy of a chunk when it is read.
HOT_REFERENCES = 5000
#: A random word per byte value.
GEAR = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)
_HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


def payload(text: bytes) -> bytes:
    """The text and zeros up to a positive multiple of 64."""
    return text + bytes(-len(text) % 64 or (0 if text else 64))


def to_wav(data: bytes) -> bytes:
    """8-bit mono PCM."""
    return _HEADER.pack(b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(data)) + data


def from_wav(media: bytes) -> bytes:
    """The samples; a header that does not describe them is an error."""
    riff, size, wave, _, _, kind, channels, _, _, _, bits, _, n = _HEADER.unpack_from(media)
    if (riff, wave, kind, channels, bits) != (b"RIFF", b"WAVE", 1, 1, 8) or size != 36 + n or len(media) != _HEADER.size + n:
        raise ValueError("not the WAV that was stored")
    return media[_HEADER.size :]


def cuts(media: bytes) -> list[int]:
    """Ends of the chunks: after MIN_CHUNK bytes the first place whose hash of the last 32 bytes has MEAN_BITS zeros, or
    MAX_CHUNK."""
    n = len(media)
    if n <= MIN_CHUNK:
        return [n]
    h = GEAR[np.frombuffer(media, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    marks = np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + 1
    out, at = [], 0
    while n - at > MIN_CHUNK:
        k = np.searchsorted(marks, at + MIN_CHUNK)
        at = min(n, at + MAX_CHUNK, int(marks[k]) if k < len(marks) else n)
        out.append(at)
    return out if at == n else [*out, n]


def _media(texts: pa.Array):
    for t in encoded(texts):
        media = to_wav(payload(t))
        ends = cuts(media)
        yield media, [media[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def lists(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, media_sha256, chunks`` per row: the ordered chunk digests of its medium."""

    def index(batches):
        for batch in batches:
            sizes = [len(t) for t in encoded(batch.column(1))]
            made = [(hashlib.sha256(m).digest(), [hashlib.sha256(c).digest() for c in cs]) for m, cs in _media(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array([m for m, _ in made], pa.binary()), pa.array([c for _, c in made], pa.list_(pa.binary()))], names=["__id", "n_bytes", "media", "chunks"])

    return map_arrow(df.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("binary").alias("t")), index, "__id long, n_bytes long, media binary, chunks array<binary>")


def store(df: DataFrame, text_col: str = "text", level: int = 9) -> DataFrame:
    """``digest, z``: every distinct chunk once, compressed.  A task drops the copies it has seen before they are
    shuffled."""

    def chunks(batches):
        pack = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            found = {}
            for _, cs in _media(batch.column(0)):
                for c in cs:
                    d = hashlib.sha256(c).digest()
                    if d not in found:
                        found[d] = pack.compress(c)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], names=["digest", "z"])

    return map_arrow(df.select(F.col(text_col).cast("binary").alias("t")), chunks, "digest binary, z binary").dropDuplicates(["digest"])


def features(data: bytes) -> str:
    """Mean, root mean square and sign changes of the samples around the middle."""
    x = np.frombuffer(data, np.uint8).astype(np.int64) - 128
    return f"mean={x.mean():.6f};rms={np.sqrt((x * x).mean()):.6f};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())};samples={len(x)}"


RESULT = "media binary, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, feature string"
_TYPES = (pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string())


def save_store(df: DataFrame, text_col: str = "text") -> str:
    """Writes the store as a table bucketed by digest, so that lists are joined with it where its chunks lie; its name."""
    spark = df.sparkSession
    name = f"vellum_chunks_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with files_cleaned(spark):
        store(df, text_col).write.option("compression", "none").bucketBy(n, "digest").saveAsTable(name)
    return name


def read_back(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """A row per medium of (media, chunks): rebuilt from the store, verified and measured.

    Media of one chunk are measured where their chunk is; the chunks of others meet by medium, in order.  A chunk of
    more than HOT_REFERENCES media is copied for salted groups of them."""

    def result(media_id: bytes, media: bytes):
        if hashlib.sha256(media).digest() != media_id:
            raise ValueError("a medium differs from what was stored")
        data = from_wav(media)
        return media_id, len(data), hashlib.sha256(data).digest(), zlib.crc32(data[-64:]), len(media), features(data)

    def batch_of(rows, *more):
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES)]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(x, t) for x, t in more)], names=[x.split()[0] for x in RESULT.split(", ")] + ["seq", "digest", "z"][: len(more)])

    def chunk(z: bytes, digest: bytes) -> bytes:
        data = zstandard.ZstdDecompressor().decompress(z)
        if hashlib.sha256(data).digest() != digest:
            raise ValueError("a chunk differs from its digest")
        return data

    def alone(batches):
        for batch in batches:
            rows, seqs, digests, zs = [], [], [], []
            for m, n, seq, d, z in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                rows.append(result(m, chunk(z, d)) if n == 1 else (m, *[None] * 5))
                seqs.append(seq)
                digests.append(None if n == 1 else d)
                zs.append(None if n == 1 else z)
            yield batch_of(rows, (seqs, pa.int32()), (digests, pa.binary()), (zs, pa.binary()))

    def ordered(batches):
        at, parts = None, []
        for batch in batches:
            done = []
            for row in zip(*(batch.column(k).to_pylist() for k in range(9)), strict=True):
                m, d, z = row[0], row[7], row[8]
                if parts and m != at:
                    done.append(result(at, b"".join(parts)))
                    parts = []
                at = m
                if z is None:
                    done.append(row[:6])
                else:
                    parts.append(chunk(z, d))
            yield batch_of(done)
        if parts:
            yield batch_of([result(at, b"".join(parts))])

    parts = wanted.select("media", F.size("chunks").alias("n"), F.posexplode("chunks").alias("seq", "digest"))
    hot = staged(parts.groupBy("digest").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > HOT_REFERENCES).select("digest", F.ceil(F.col("c") / HOT_REFERENCES).cast("int").alias("salts")), "media-hot")
    columns = ("media", "n", "seq", "digest", "z")
    if hot.isEmpty():
        joined = parts.join(stored, "digest").select(*columns)
    else:
        copies = staged(stored.join(hot, "digest").select("digest", "z", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")), "media-copies")
        salted = parts.join(hot, "digest").withColumn("salt", F.pmod(F.xxhash64("media"), F.col("salts")).cast("int"))
        joined = parts.join(hot, "digest", "left_anti").join(stored, "digest").select(*columns).unionByName(salted.join(copies, ["digest", "salt"]).select(*columns))
    # what is measured already travels without bytes
    met = map_arrow(joined, alone, f"{RESULT}, seq int, digest binary, z binary").repartition("media").sortWithinPartitions("media", "seq")
    return map_arrow(met, ordered, RESULT)


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores the media of df's texts, reads them back and drops the store: ``id, n_bytes``, sizes, digests and features
    of what was read, ``n_chunks``."""
    spark = df.sparkSession
    listed = staged(lists(df, id_col, text_col), "media-lists")
    name = save_store(df, text_col)
    try:
        read = staged(read_back(listed.select("media", "chunks").dropDuplicates(["media"]), spark.table(name)), "media-read")
    finally:
        spark.sql(f"DROP TABLE {name}")
    joined = listed.select("__id", "n_bytes", "media", F.size("chunks").alias("n_chunks")).join(read, "media")
    hexed = lambda c: F.lower(F.hex(c))
    return joined.select(F.col("__id").alias(id_col), "n_bytes", "payload_bytes", hexed("payload_sha256").alias("payload_sha256"), "tail_crc32", "media_bytes", hexed("media").alias("media_sha256"), "feature", "n_chunks")
