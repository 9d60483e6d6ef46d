"""Best-fit packing of token pieces with certified bounds.

Documents become token ids in batches: a batch's distinct segments (a run of white space and the run of other
characters after it, which a byte-level pre-tokenizer never joins) are encoded once, and the documents' ids are
gathered from them.  Pieces are dealt by hash to partitions; each is packed by best-fit decreasing, and
dual-feasible functions over its lengths give a lower bound of its bins.  A partition at its bound is certified.
The others exchange their documents: all of theirs are dealt anew to partitions four times as large and packed again.

Null texts are empty: one piece, the end id alone.  Repeated rows are packed as separate items.  Very long texts
become many pieces.  Empty tables give empty results.  Only the id and the text are read.
"""

from __future__ import annotations

import base64
import math
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm._support import _SPACE, by_bytes, encoded, map_arrow, span_hashes, staged

CAPACITY = 1024
END_ID = 2
#: Pieces of a partition.
GROUP_PIECES = 8192
PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"
#: White space beyond ASCII in UTF-8, and the special token: documents with them are encoded by themselves.
_APART = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|<\|endoftext\|>")


@lru_cache(2)
def encoding(ranks_path: str, pattern: str, end_of_text: int):
    """The byte-level BPE of a ranks file, and the bytes of each id."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    special = {"<|endoftext|>": end_of_text}
    sizes = np.zeros(max(*ranks.values(), end_of_text) + 1, np.int64)
    for token, i in (ranks | {k.encode(): v for k, v in special.items()}).items():
        sizes[i] = len(token)
    return tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special), sizes


def encode_texts(texts: list[bytes], coder, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ends): ids of all texts one after another, and where each text's end."""
    joined = b"".join(texts)
    data = np.frombuffer(joined, np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    begins = ends - [len(t) for t in texts]
    space = _SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[1:-1] = space[1:] & ~space[:-1]
    for i, t in enumerate(texts):
        if _APART.search(t):
            first[begins[i] : ends[i]] = False
    first[begins] = True
    starts = np.flatnonzero(first[: len(data)])
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
    stops = np.append(starts[1:], len(data))
    _, place, which = np.unique(span_hashes(data, starts, stops), return_index=True, return_inverse=True)
    a, b = starts[place], stops[place]
    apart = np.zeros(len(data) + 1, np.int64)
    for i, t in enumerate(texts):
        if _APART.search(t):
            apart[begins[i]] = 1
    joinable = space[a] & ~space[b - 1] & (apart[a] == 0)
    counts = np.zeros(len(a), np.int64)
    flat = []
    among = np.flatnonzero(joinable)
    if len(among):
        got = coder.encode_to_numpy(b"".join([joined[x:y] for x, y in zip(a[among].tolist(), b[among].tolist(), strict=True)]).decode())
        upto = np.searchsorted(np.cumsum(sizes[got]), np.cumsum(b[among] - a[among])) + 1
        counts[among] = np.diff(upto, prepend=0)
        flat.append(got)
    begin = np.zeros(len(a), np.int64)
    begin[among] = np.cumsum(counts[among]) - counts[among]
    total = int(counts.sum())
    for k in np.flatnonzero(~joinable).tolist():
        got = coder.encode_to_numpy(joined[a[k] : b[k]].decode(), allowed_special="all")
        begin[k], counts[k], total = total, len(got), total + len(got)
        flat.append(got)
    lengths, from_ = counts[which], begin[which]
    out = np.cumsum(lengths)
    ids = np.concatenate(flat)[np.repeat(from_ - (out - lengths), lengths) + np.arange(out[-1])]
    upto = np.searchsorted(starts, ends)
    return ids, np.where(upto > 0, out[upto - 1], 0)


def pieces(df: DataFrame, ranks_path: str | None = None, pattern: str | None = None, end_of_text: int = 50256, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: its document's ids and ``end_id`` cut from the end into pieces of ``capacity``."""

    def cut(batches):
        from_path, pat = ranks_path, pattern
        if from_path is None:
            import public_tokenizers

            from_path, pat = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
        coder, sizes = encoding(from_path, pat, end_of_text)
        for batch in batches:
            ids, rows, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), encoded(batch.column(2))
            for at, to in by_bytes(texts):
                flat, ends = encode_texts(texts[at:to], coder, sizes)
                got = np.insert(flat, ends, end_id).astype("<u4")
                stops = ends + np.arange(1, len(ends) + 1)
                view, begin, out = memoryview(got.tobytes()), 0, []
                for i, stop in enumerate(stops.tolist()):
                    n, start = stop - begin, 0
                    size = (n - 1) % capacity + 1
                    for piece in range(-(-n // capacity)):
                        out.append((ids[at + i], rows[at + i], piece, start, size, zlib.crc32(view[4 * (begin + start) : 4 * (begin + start + size)])))
                        start, size = start + size, capacity
                    begin = stop
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    text = F.col(text_col)
    return map_arrow(df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.cast("binary").alias("t")), cut, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The largest bound of bins over families of dual-feasible functions."""
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    # sizes above capacity - t count as whole bins, those below t as nothing
    large, volume = np.cumsum(count[::-1])[::-1], np.cumsum(count * size)
    t = np.arange(1, capacity // 2 + 1)
    between = volume[capacity - t] - volume[t - 1]
    best = max(best, int((large[capacity - t + 1] + -(-between // capacity)).max()))
    # sizes rounded to (k + 1)ths of a bin, exact multiples kept
    for k in range(1, 21):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int], int]:
    """(bin, offset) of each of the lengths, which come in descending order, and the number of bins."""
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    room = 0  # bit r: some bin has r left
    bins, offsets, n = [], [], 0
    for size in lengths:
        fits = room >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = free[left].pop()
            if not free[left]:
                room &= ~(1 << left)
        else:
            left, b, n = capacity, n, n + 1
        bins.append(b)
        offsets.append(capacity - left)
        if left > size:
            free[left - size].append(b)
            room |= 1 << (left - size)
    return bins, offsets, n


def _packed(df: DataFrame, groups: int, round_: int, capacity: int) -> DataFrame:
    """Each group packed; its bins and its bound beside every row."""

    def pack(key, table):
        pdf = table.to_pandas().sort_values(["length", "doc_id", "row", "piece"], ascending=[False, True, True, True], kind="stable")
        bins, offsets, n = best_fit_decreasing(pdf["length"].tolist(), capacity)
        pdf["bin"], pdf["offset"], pdf["bins"] = bins, offsets, n
        pdf["bound"] = lower_bound(pdf["length"].to_numpy(), capacity)
        return pa.Table.from_pandas(pdf, preserve_index=False).select([*PLAIN, "grp", "bin", "offset", "bins", "bound"]).cast(SCHEMA)

    dealt = df.withColumn("grp", F.pmod(F.xxhash64(F.lit(round_), "doc_id", "row", "piece"), F.lit(groups)))
    return dealt.groupBy("grp").applyInArrow(pack, f"{PIECES}, grp long, bin long, offset long, bins long, bound long")


PLAIN = ("doc_id", "row", "piece", "start", "length", "ids_crc32")
SCHEMA = pa.schema([(n, pa.int32() if n == "piece" else pa.int64()) for n in (*PLAIN, "grp", "bin", "offset", "bins", "bound")])


def pack(pieces_df: DataFrame, capacity: int = CAPACITY, rounds: int = 3, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces of at most ``capacity``."""
    pieces_df = staged(pieces_df, "pieces")
    alone = pieces_df.where(F.col("length") >= capacity).withColumn("sequence_id", F.monotonically_increasing_id() + F.lit(1 << 62)).withColumn("offset", F.lit(0).cast("long"))
    pool, settled = pieces_df.where(F.col("length") < capacity), []
    n = pool.count()
    for r in range(rounds):
        # what is left is less each time, and meets in larger groups
        groups = max(1, math.ceil(n / (group_pieces << 2 * r)))
        packed = staged(_packed(pool, groups, r, capacity), f"packed-{r}").withColumn("sequence_id", F.lit(r << 58) + F.shiftleft("grp", 30) + F.col("bin"))
        again = F.col("bins") > F.col("bound")
        left = packed.where(again).count() if r + 1 < rounds and groups > 1 else 0
        if not left:
            settled.append(packed)
            break
        settled.append(packed.where(~again))
        pool, n = packed.where(again).select(*PLAIN), left
    out = alone
    for part in settled:
        out = out.unionByName(part.select(*PLAIN, "sequence_id", "offset"))
    return out
