"""Removing word windows that repeat across documents, by level-wise doubling.

1. The first level are windows of half the length.  They are sampled without loss: of all half-windows inside a full
   window the one with the least hash stands for it, so equal full windows are met under equal half-windows.  Half-
   windows that documents with one id alone hold end here.
2. Those that survive are extended: documents with such a half are read again, and the full windows around it are met
   under it.  A window of which a smaller id holds an equal one is lost.

``repeat_lengths`` goes on to 2, 4, ... times the length until no candidate survives.

What a task can decide by itself is not shuffled: in a chunk of documents, only the smallest id that holds a window
is sent on; any larger id loses the window at once.  A window in a third of all documents so sends a row per chunk.  A
half that several ids of a chunk hold survives without asking, and two rows of the chunk bear witness to the others.
The windows around a half of very many documents are dealt to tasks by their own hashes.

Windows compare by the 64-bit hash of the half and the 64-bit hash of the full window together.  Null texts have no words.
Repeated rows have one id and take nothing from each other, nor do rows without an id.  A null id is larger than any
other; rows that share an id are told apart by a 64-bit hash of the text.  Texts shorter than a window stay whole.  Empty
tables give empty results.  Only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm._support import by_bytes, discard, encoded, id_order, map_arrow, mix, span_hashes, staged, words

WINDOW = 13
#: Bytes of text whose windows are resolved together before anything is shuffled.
LOCAL_BYTES = 4 << 20
#: Documents that hold one half before its windows are dealt to several tasks, by their hashes.
HOT_ROWS = 100_000
#: Consecutive windows under one half that travel in one row.
RUN_TAGS = 64


def _rolling(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` word hashes."""
    out = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)] + np.uint64(size))
    return out


def windows(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, place, full, half): for every window its text's index, its first word, its hash, and the least hash of
    the half-windows in it."""
    data, starts, ends, first = words(texts)
    h = span_hashes(data, starts, ends)
    n = np.diff(first)
    if len(h) < size:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    half = (size + 1) // 2
    least = sliding_window_view(_rolling(h, half), size - half + 1).min(1)
    full = _rolling(h, size)
    doc = np.repeat(np.arange(len(texts)), n)
    place = np.arange(len(h)) - first[:-1][doc]
    inside = (place + size <= n[doc])[: len(full)]
    return doc[: len(full)][inside], place[: len(full)][inside], full[inside], least[: len(full)][inside]


def _run_rows(ids: np.ndarray, rows: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """Runs of consecutive places, as first and last place: a row per document."""
    order = np.lexsort((places, rows, ids))
    ids, rows, places = ids[order], rows[order], places[order]
    other = np.ones(len(ids), bool)
    other[1:] = (np.diff(ids) != 0) | (np.diff(rows) != 0)
    new = other.copy()
    new[1:] |= np.diff(places) != 1
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(ids))[: len(head)] - 1
    runs = np.stack([places[head], places[tail]], 1).astype(np.int32).ravel()
    at = np.flatnonzero(other[head])
    lists = pa.ListArray.from_arrays(pa.array(np.append(2 * at, len(runs)).astype(np.int32)), pa.array(runs))
    return pa.RecordBatch.from_arrays([pa.array(ids[head[at]]), pa.array(rows[head[at]]), lists], names=["__id", "__row", "runs"])


def _smallest(key: tuple[np.ndarray, ...], ids: np.ndarray) -> np.ndarray:
    """For each entry the smallest id among those with its key."""
    order = np.lexsort((ids, *key))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in key:
        new[1:] |= np.diff(k[order]) != 0
    heads = np.flatnonzero(new)
    out = np.empty(len(order), ids.dtype)
    out[order] = ids[order][heads[np.cumsum(new) - 1]]
    return out


def _first_level(batches, size: int, chunk: int):
    """Rows (__id, __row, runs, half, state) of batches of (__id, __row, text).

    state 0: windows that a smaller id in the chunk holds, as runs; 1: a half that several ids of the chunk hold, so that
    it survives; 2: a half that one id of the chunk holds; 3: the least and the greatest id of a half in state 1."""
    names = ["__id", "__row", "runs", "half", "state"]

    def rows(ids, own, half, state):
        n = len(ids)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(own), pa.nulls(n, pa.list_(pa.int32())), pa.array(half.view(np.int64)), pa.array(np.full(n, state, np.int32))], names=names)

    for batch in batches:
        ids, own = (np.asarray(batch.column(i)) for i in (0, 1))
        texts = encoded(batch.column(2))
        for at, to in by_bytes(texts, chunk):
            doc, place, full, half = windows(texts[at:to], size)
            own_id, own_row = ids[at:to], own[at:to]
            lost = _smallest((full,), own_id[doc]) < own_id[doc]
            done = _run_rows(own_id[doc[lost]], own_row[doc[lost]], place[lost])
            yield pa.RecordBatch.from_arrays([*done.columns, pa.nulls(done.num_rows, pa.int64()), pa.array(np.zeros(done.num_rows, np.int32))], names=names)
            # of the others, each half of a document once, in order of halves and ids
            order = np.lexsort((doc[~lost], own_id[doc[~lost]], half[~lost]))
            doc, half = doc[~lost][order], half[~lost][order]
            new = np.ones(len(doc), bool)
            new[1:] = (np.diff(doc) != 0) | (np.diff(half) != 0)
            doc, half = doc[new], half[new]
            i, r = own_id[doc], own_row[doc]
            heads = np.flatnonzero(np.concatenate([[True], np.diff(half) != 0])) if len(half) else np.zeros(0, np.int64)
            tails = np.append(heads[1:], len(half))[: len(heads)] - 1
            several = i[heads] != i[tails]
            live = np.repeat(several, tails - heads + 1)
            yield rows(i[live], r[live], half[live], 1)
            yield rows(i[~live], r[~live], half[~live], 2)
            ends = np.concatenate([heads[several], tails[several]])
            yield rows(i[ends], r[ends], half[ends], 3)


def _second_level(batches, size: int):
    """Rows (half, salt, __id, __row, place, tags) of batches of (__id, __row, text, live): the windows around each live
    half of a text, as the hashes of consecutive ones; of a half with several salts a row per window, which goes by its
    hash."""
    for batch in batches:
        ids, own, live = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(3)
        texts = encoded(batch.column(2))
        for at, to in by_bytes(texts):
            doc, place, full, half = windows(texts[at:to], size)
            lists = live.slice(at, to - at)
            entries = lists.flatten()
            of = np.repeat(np.arange(to - at), np.asarray(pa.compute.list_value_length(lists)))
            salts = np.asarray(entries.field("salts"))
            # a document's halves stand together: a multiple of a constant sets documents apart
            mark = lambda d, h: mix(h + d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            known = mark(of, np.asarray(entries.field("half")).view(np.uint64))
            order = np.argsort(known)
            found = np.minimum(np.searchsorted(known[order], asked := mark(doc, half)), len(known) - 1)
            on = known[order][found] == asked
            doc, place, full, half, n = doc[on], place[on], full[on], half[on], salts[order][found][on]
            if not len(doc):
                continue
            # a row has RUN_TAGS hashes at most, so that batches of rows are bounded
            cut = (np.diff(half) != 0) | (np.diff(place) != 1) | (np.diff(doc) != 0) | (n[1:] > 1) | (place[1:] % RUN_TAGS == 0)
            head = np.concatenate([[0], np.flatnonzero(cut) + 1])
            ends = (np.append(head[1:], len(doc)) * 8).astype(np.int32)
            tags = pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32).tobytes()), pa.py_buffer(full.astype("<u8").tobytes())])
            d, salt = doc[head], np.where(n[head] > 1, (mix(full[head]) % n[head].astype(np.uint64)).astype(np.int64), 0)
            yield pa.RecordBatch.from_arrays([pa.array(half[head].view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(ids[at + d]), pa.array(own[at + d]), pa.array(place[head].astype(np.int32)), tags], names=["half", "salt", "__id", "__row", "place", "tags"])


def _met(batches):
    """Rows (__id, __row, runs) from rows in order of (half, salt, __id): windows that stood with a smaller id before.

    A batch is settled at once; of the half that goes on into the next batch the hashes so far are kept with their
    least ids, so a task holds one batch and the different windows under one half and salt."""
    last, seen = None, {}
    for batch in batches:
        if not batch.num_rows:
            continue
        half, salt, ids, own, place = (np.asarray(batch.column(k)) for k in range(5))
        sizes = np.asarray(pa.compute.binary_length(batch.column(5))) // 8
        tags = np.frombuffer(b"".join(batch.column(5).to_pylist()), "<u8")
        row = np.repeat(np.arange(len(half)), sizes)
        at = place[row] + np.arange(len(tags)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        least = _smallest((tags, salt[row], half[row]), ids[row])
        if last == (half[0], salt[0]):
            same = (half[row] == last[0]) & (salt[row] == last[1])
            for k in np.flatnonzero(same).tolist():
                least[k] = min(least[k], seen.get(int(tags[k]), least[k]))
        key = (half[-1], salt[-1])
        if key != last:
            last, seen = key, {}
        for k in np.flatnonzero((half[row] == key[0]) & (salt[row] == key[1])).tolist():
            seen.setdefault(int(tags[k]), int(least[k]))
        lost = least < ids[row]
        yield _run_rows(ids[row][lost], own[row][lost], at[lost].astype(np.int64))


def removable(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """``__id, __row, runs`` for documents of (__id, __row, __t) that hold a window of a smaller id; runs are flat pairs
    of first and last window start, possibly in several rows a document."""
    docs, chunk = docs.select("__id", "__row", "__t"), LOCAL_BYTES
    first = staged(map_arrow(docs, lambda b: _first_level(b, size, chunk), "__id long, __row long, runs array<int>, half long, state int"), "sub-first")
    decided = staged(first.where("state = 0").select("__id", "__row", "runs"), "sub-decided")
    # first level: a half that one id alone holds is not extended
    each = Window.partitionBy("half")
    held = first.where("state > 1").select("half", "__id", "__row", "state").withColumns({"lo": F.min("__id").over(each), "hi": F.max("__id").over(each)})
    live = first.where("state = 1").select("half", "__id", "__row").unionByName(held.where("state = 2 and lo < hi").select("half", "__id", "__row"))
    live = staged(live, "sub-live")
    discard(first)
    crowded = live.groupBy("half").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > HOT_ROWS).select("half", F.ceil(F.col("c") / HOT_ROWS).cast("int").alias("salts"))
    crowded = staged(crowded, "sub-crowded")
    salted = live.join(crowded, "half", "left").select("__id", "__row", F.struct("half", F.coalesce("salts", F.lit(1)).alias("salts")).alias("l"))
    wanted = staged(salted.groupBy("__id", "__row").agg(F.collect_list("l").alias("live")), "sub-wanted")
    discard(live, crowded)
    # second level: the windows around what survived
    around = map_arrow(docs.join(wanted, ["__id", "__row"]).select("__id", "__row", "__t", "live"), lambda b: _second_level(b, size), "half long, salt int, __id long, __row long, place int, tags binary")
    dealt = around.repartition("half", "salt").sortWithinPartitions("half", "salt", "__id")
    out = staged(map_arrow(dealt, _met, "__id long, __row long, runs array<int>").unionByName(decided), "sub-removable")
    discard(decided, wanted)
    return out


def covered(runs: list[int], n: int, size: int) -> np.ndarray:
    """Which of n words lie in a window that starts within one of the runs."""
    edge = np.zeros(n + 1, np.int64)
    pairs = np.asarray(runs, np.int64).reshape(-1, 2)
    np.add.at(edge, pairs[:, 0], 1)
    np.add.at(edge, np.minimum(pairs[:, 1] + size, n), -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(df: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``id, n_words, n_removed, kept_sha256`` per row of df, and ``kept_text`` if asked for: the words left, joined by
    one space."""
    docs = df.select(F.col(id_col).alias("__own"), id_order(F.col(id_col)).alias("__id"), F.xxhash64(text_col).alias("__row"), F.col(text_col).cast("binary").alias("__t"))
    found = removable(docs, size)
    runs = staged(found.groupBy("__id", "__row").agg(F.flatten(F.collect_list("runs")).alias("runs")), "sub-runs")
    discard(found)
    joined = docs.join(runs, ["__id", "__row"], "left").select("__own", "__t", "runs")

    def cut(batches):
        for batch in batches:
            own, texts, runs = batch.column(0), encoded(batch.column(1)), batch.column(2).to_pylist()
            n, gone, left = [], [], []
            for t, r in zip(texts, runs, strict=True):
                w = t.split()
                n.append(len(w))
                if r:
                    out = covered(r, len(w), size)
                    w = [x for x, y in zip(w, out.tolist(), strict=True) if not y]
                gone.append(n[-1] - len(w))
                left.append(b" ".join(w))
            cols = [own, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in left])]
            if keep_text:
                cols.append(pa.array([x.decode() for x in left]))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    names = [id_col, "n_words", "n_removed", "kept_sha256", *["kept_text"] * keep_text]
    return map_arrow(joined, cut, f"`{id_col}` long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text)


def repeat_lengths(df: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``length, windows, documents``: at size, 2 * size, 4 * size, ... words, the places at which a window starts that
    another document holds too, and their documents; the last length is the last with a survivor.

    A place is a candidate at twice the length only if the windows at it and right after it survived."""
    docs = df.select(id_order(F.col(id_col)).alias("__id"), F.xxhash64(text_col).alias("__row"), F.col(text_col).cast("binary").alias("__t"))
    spark, rows, length, alive = df.sparkSession, [], size, None
    while True:
        joined = docs.withColumn("alive", F.lit(None).cast("array<int>")) if alive is None else docs.join(alive, ["__id", "__row"])

        def emit(batches, length=length):
            for batch in batches:
                texts = encoded(batch.column(2))
                ids, own, live = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(3)
                for at, to in by_bytes(texts):
                    doc, place, full, _ = windows(texts[at:to], length)
                    ok = np.ones(len(doc), bool)
                    for i, x in enumerate(live.slice(at, to - at).to_pylist()):
                        if x is not None:
                            mine = doc == i
                            ok[mine] = np.isin(place[mine], x) & np.isin(place[mine] + length // 2, x)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at + doc[ok]]), pa.array(own[at + doc[ok]]), pa.array(place[ok].astype(np.int32)), pa.array(full[ok].view(np.int64))], names=["__id", "__row", "place", "full"])

        at = staged(map_arrow(joined.select("__id", "__row", "__t", "alive"), emit, "__id long, __row long, place int, full long"), "rep-windows")
        shared = staged(at.groupBy("full").agg(F.min("__id").alias("x"), F.max("__id").alias("y")).where("x != y").select("full"), "rep-shared")
        left = staged(at.join(shared, "full").select("__id", "__row", "place"), "rep-left")
        found = left.agg(F.count(F.lit(1)), F.countDistinct("__id")).first()
        if not found[0]:
            break
        rows.append((length, found[0], found[1]))
        alive = staged(left.groupBy("__id", "__row").agg(F.collect_list("place").alias("alive")), "rep-alive")
        length *= 2
    return spark.createDataFrame(rows, "length int, windows long, documents long")
