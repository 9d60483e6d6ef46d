"""Harmonic packing of whole documents, with the gaps filled by documents that are cut.

A text becomes ids by parts that the tokenizer's pattern never joins: each distinct part of a step is encoded once, and
a worker keeps the ids of the parts it has met.

Harmonic classes: an item of length n, capacity C / (k + 1) < n <= C / k, belongs to class k, whose bins take k items
each; items shorter than C / ``CLASSES`` share bins that are closed when the next one does not fit.  A bin knows
nothing of the others but its class, so every task packs the documents of its own partition as it reads them: nothing
is shuffled, and a lost task is packed again by itself.

A class's bins are not full: k items of class k leave up to C / (k + 1) free.  In each step the longest items go first,
and as soon as the gaps could hold all that is left of the step, the rest, the shortest items, fills them: an item
goes whole into the least gap that holds it, else its head fills the greatest gap and its tail goes on.  Documents
beyond the capacity give whole sequences, and their remainder is an item.  What is open when the task ends is cut
at the capacity, and the last remainder into powers of two, which need no padding.  So no sequence is padded, and
most documents stay in one piece.

Null texts are empty: the end id alone.  Repeated rows are separate items, and null ids stay null.  Very long texts
are tokenized in a step of their own and give many pieces.  Empty tables give empty results.  Ties are broken by the
order of the rows in their partition.  Only the id and the text are read, so other columns may have any name.
Sequences are numbered within a task, above its partition's number.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm._support import by_bytes, encoded, map_arrow, span_hashes

CAPACITY = 4096
END_ID = 2
CLASSES = 64
#: Bins with gaps that wait; beyond them the least gaps are filled first.
WAITING = 200
#: Parts whose ids a worker keeps; beyond it the memory starts anew.
KNOWN = 400_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [x.split()[0] for x in PIECES.split(", ")]
_TYPES = pa.schema([(n, pa.int64()) for n in _NAMES])


#: Kinds of bytes: white space, letters, digits, the rest; and those by which a segment is not taken apart: an apostrophe,
#: and what is not ASCII but for the letters of U+00C0-U+00FF.
_SPACES, _LETTER, _DIGIT, _OTHER, _ODD, _WHOLE = range(6)
_KIND = np.full(256, _ODD, np.uint8)
_KIND[:128] = _OTHER
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACES
_KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[39] = _DIGIT, _LETTER, _LETTER, _ODD


def parts(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(data, starts, ends, first) of the parts of texts that the tokenizer never joins, those of text i at
    first[i]:first[i + 1]: runs of letters, with A-Z lower-cased, single digits, runs of other characters.  Segments
    between white space with odd bytes, or with what may be a special token, are one part and unchanged."""
    raw = b"\n".join([b"", *texts, b""])
    data, low = np.frombuffer(raw, np.uint8), np.frombuffer(raw.lower(), np.uint8)
    kind = _KIND[data]
    two = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7))
    kind[two] = kind[two + 1] = _LETTER
    kind[:-1][(data[:-1] == 60) & (data[1:] == 124)] = _ODD
    if (odd := np.flatnonzero(kind == _ODD)).size:
        edges = np.flatnonzero(np.diff(kind == _SPACES)) + 1
        begins, stops = edges[::2], edges[1::2]
        among = np.unique(np.searchsorted(begins, odd, "right") - 1)
        sizes = (stops - begins)[among]
        at = np.repeat(begins[among] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        kind[at], low = _WHOLE, low.copy()
        low[at] = data[at]
    bounds = np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)) + 1
    inside = np.flatnonzero(kind[bounds] != _SPACES)
    starts, ends = bounds[inside], bounds[inside + 1] if inside.size else bounds[:0]
    places = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return low, starts, ends, np.searchsorted(starts, places)


class Segments:
    """Ids of texts through those of their parts, which a worker keeps."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.coder, self.known, self.flat = Tokenizer.from_file(path), {}, np.zeros(0, np.uint32)
        self.begin = self.count = np.zeros(0, np.int64)

    def _learn(self, new: list[bytes]) -> None:
        # a batch of its own for each part would cost more than the part
        found = self.coder.encode_batch_fast([s.decode() for s in new], add_special_tokens=False)
        ids = [e.ids for e in found]
        counts = np.asarray([len(x) for x in ids], np.int64)
        self.known.update(zip(new, range(len(self.begin), len(self.begin) + len(new)), strict=True))
        self.begin = np.append(self.begin, len(self.flat) + np.cumsum(counts) - counts)
        self.count = np.append(self.count, counts)
        self.flat = np.append(self.flat, np.asarray([i for x in ids for i in x], np.uint32))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): ids of all texts one after another, and where each text's end."""
        data, starts, ends, first = parts(texts)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        _, place, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        joined = data.tobytes()
        distinct = [joined[a:b] for a, b in zip(starts[place].tolist(), ends[place].tolist(), strict=True)]
        if len(self.known) > KNOWN:
            self.known, self.flat, self.begin, self.count = {}, self.flat[:0], self.begin[:0], self.count[:0]
        if new := [s for s in distinct if s not in self.known]:
            self._learn(new)
        at = np.asarray([self.known[s] for s in distinct])[which]
        lengths = self.count[at]
        out = np.cumsum(lengths)
        flat = self.flat[np.repeat(self.begin[at] - (out - lengths), lengths) + np.arange(out[-1])]
        return flat, np.append(0, out)[first[1:]]


@lru_cache(2)
def segments(path: str) -> Segments:
    """The segments that this worker has met."""
    return Segments(path)


class Packer:
    """The bins of one task.  An item is (doc_id, start, ids as bytes, ids of its document)."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.next = capacity, first_sequence
        self.open: dict[int, list] = {}
        self.gaps: list[tuple[int, int]] = []  # (free ids, number of the bin), ascending
        self.bins: dict[int, list] = {}
        self.free = self.numbered = 0
        self.rows: list[tuple] = []

    def emit(self, items: list) -> None:
        at = 0
        for doc_id, start, ids, whole in items:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(ids), whole, self.next, at))
            at += n
        self.next += 1

    def close(self, items: list) -> None:
        """No more items of the class: full bins leave, the others wait for what fills them."""
        gap = self.capacity - sum(len(x[2]) for x in items) // 4
        if gap:
            self.bins[self.numbered] = items
            insort(self.gaps, (gap, self.numbered))
            self.numbered, self.free = self.numbered + 1, self.free + gap
        else:
            self.emit(items)

    def place(self, item: tuple) -> None:
        """An item into the open bin of its class."""
        n = len(item[2]) // 4
        k = self.capacity // n
        if k > CLASSES:
            k = 0
            if sum(len(x[2]) for x in self.open.get(0, ())) // 4 + n > self.capacity:
                self.close(self.open.pop(0))
        items = self.open.setdefault(k, [])
        items.append(item)
        if k and len(items) == k:
            self.close(self.open.pop(k))

    def fill(self, item: tuple) -> None:
        """An item into gaps: whole into the least that holds it, else piece by piece into the greatest."""
        doc_id, start, ids, whole = item
        while ids:
            if not self.gaps:
                self.place((doc_id, start, ids, whole))
                return
            n = len(ids) // 4
            at = 0 if len(self.gaps) > WAITING else min(bisect_left(self.gaps, (n, -1)), len(self.gaps) - 1)
            gap, b = self.gaps.pop(at)
            taken = min(gap, n)
            self.bins[b].append((doc_id, start, ids[: 4 * taken], whole))
            self.free -= taken
            if taken == gap:
                self.emit(self.bins.pop(b))
            else:
                insort(self.gaps, (gap - taken, b))
            start, ids = start + taken, ids[4 * taken :]

    def add(self, items: list) -> None:
        """The items of a step."""
        items = sorted(items, key=lambda x: -len(x[2]))
        left = sum(len(x[2]) for x in items) // 4
        for item in items:
            (self.fill if left <= self.free or len(self.gaps) > WAITING else self.place)(item)
            left -= len(item[2]) // 4

    def finish(self) -> None:
        """What is open: sequences of the capacity, then of the powers of two that make up the rest."""
        items = sorted((x for b in (*self.bins.values(), *self.open.values()) for x in b), key=lambda x: -len(x[2]))
        self.bins, self.open, self.gaps, self.free = {}, {}, [], 0
        left, room, current = sum(len(x[2]) for x in items) // 4, 0, []
        for doc_id, start, ids, whole in items:
            while ids:
                room = room or (self.capacity if left >= self.capacity else 1 << left.bit_length() - 1)
                taken = min(room, len(ids) // 4)
                current.append((doc_id, start, ids[: 4 * taken], whole))
                start, ids, room, left = start + taken, ids[4 * taken :], room - taken, left - taken
                if not room:
                    self.emit(current)
                    current = []

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(_NAMES), schema=_TYPES)


def packer(path: str | None, capacity: int, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packs batches of (id, text)."""

    def run(batches):
        where = path
        if where is None:
            import public_tokenizers

            where = public_tokenizers.path("word_bpe_49k.json")
        coder, bins = segments(where), Packer(capacity, TaskContext.get().partitionId() << 40)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), encoded(batch.column(1))
            for at, to in by_bytes(texts):
                flat, ends = coder.encode(texts[at:to])
                got = memoryview(np.insert(flat, ends, end_id).astype("<u4").tobytes())
                items, begin = [], 0
                for doc_id, stop in zip(ids[at:to], (ends + np.arange(1, len(ends) + 1)).tolist(), strict=True):
                    n, start = stop - begin, 0
                    while n - start >= capacity:
                        bins.emit([(doc_id, start, got[4 * (begin + start) : 4 * (begin + start + capacity)], n)])
                        start += capacity
                    if start < n:
                        items.append((doc_id, start, bytes(got[4 * (begin + start) : 4 * stop]), n))
                    begin = stop
                bins.add(items)
                yield bins.taken()
        bins.finish()
        yield bins.taken()

    return run


def harmonic_pack(df: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` per piece: a document's ids and ``end_id``,
    in sequences of ``capacity`` or of a power of two below it, which must be a power of two itself."""
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    return map_arrow(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t")), packer(tokenizer_path, capacity, end_id), PIECES)
