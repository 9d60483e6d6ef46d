"""Spelling variants: words one edit apart, met by merging the light subtrees of the words' trie.

The trie of all words is a table of its nodes, the distinct prefixes, each with the number of words below it.  Of a
node's children, one more if a word ends there, the one with most words is heavy and the others are light.  A word has
few light edges on its way down, at most the logarithm of the number of words, as the words below halve at each.

Words u and v that differ in one character part at the node of their longest common prefix, where at most one of them
goes on along the heavy edge.  So the errata trie of a node, into which its light subtrees are merged, small into large,
holds every such pair.  A merge changes one character of each light word at that place, and of no heavy one:

* replaced by the heavy child's character, and met with the words themselves: u is light and v is heavy;
* replaced by a mark that stands for any character, and met with the other light words of that node under the same
  mark: both are light;
* skipped, and met with the words themselves: v has one character more than u, and is light;
* the heavy child's character put in before it, and met with the words themselves: u is light, v is heavy and has one
  character more.

Terminals of the merged tries that coincide are equal strings, so each merge is a row and each meeting an equi-join on
the whole string: nothing is compared within a group.  At most one word for each character of the alphabet has one
marked string, so no group has more than the alphabet's rows.

Null texts and texts without letters have no words.  Empty tables give empty results.  Very long texts are read whole in
a step of their own, and a run of letters may be of any length.  A null id counts as the empty string where runs are
thinned.  Repeated rows count again.  Ties of frequency go to the smaller word in code-point order.  Only the id and the
text are read, so other columns may have any name.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm._support import by_bytes, discard, encoded, map_arrow, span_hashes, staged

LEAST_LETTERS, LEAST_COUNT = 5, 3
#: One run of a document in so many loses a letter.
THINNED = 97
#: Distinct words that a task counts before it sends them on.
COUNTED = 300_000
#: Bytes of text in one vectorised step.
STEP_BYTES = 8 << 20
#: Stands for any character in a merged trie, and for the end of a word among a node's children; no word has them.
ANY, END = "*", ""


def _crc_shift(length: int) -> np.ndarray:
    """Tables by which the CRC-32 of A becomes its part in that of A + B, where B has so many bytes: one for each byte."""
    zero = zlib.crc32(bytes(length))
    # the CRC is linear but for its start: feeding zeros to a state moves that state alone
    basis = [zlib.crc32(bytes(length), 1 << k) ^ zero for k in range(32)]
    table = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            table[byte, 1 << bit : 2 << bit] = table[byte, : 1 << bit] ^ np.uint32(basis[8 * byte + bit])
    return table


_shifts: dict[int, np.ndarray] = {}


def crc_joined(left: np.ndarray, right: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of each A + B from those of A and of B and the length of B."""
    out = right.copy()
    for n in np.unique(lengths).tolist():
        if n not in _shifts:
            if len(_shifts) > 4096:
                _shifts.clear()
            _shifts[n] = _crc_shift(n)
        t, at = _shifts[n], np.flatnonzero(lengths == n)
        x = left[at]
        out[at] ^= t[0][x & 255] ^ t[1][x >> 8 & 255] ^ t[2][x >> 16 & 255] ^ t[3][x >> 24]
    return out


def letter_runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, starts, ends, first) of the maximal runs of A-Z, a-z and U+00C0-U+00FF, A-Z lower-cased; those of text i
    are first[i]:first[i + 1].  In UTF-8 the latter are C3 and a byte."""
    joined = b"\n".join([b"", *texts, b""]).lower()
    data = np.frombuffer(joined, np.uint8)
    lead = data == 0xC3
    inside = ((data >= 97) & (data <= 122)) | lead
    inside[1:] |= lead[:-1]
    edges = np.flatnonzero(np.diff(inside)) + 1
    starts, ends = edges[::2], edges[1::2]
    places = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return data, starts, ends, np.searchsorted(starts, places)


def word_counts(df: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, thinned: int = THINNED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: runs of letters of whole texts, with one letter gone where the CRC-32 of ``id:run`` is a multiple
    of ``thinned``; those with enough letters and occurrences."""

    def count(batches):
        found: dict[bytes, int] = {}
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), encoded(batch.column(1))
            for at, to in by_bytes(texts, STEP_BYTES):
                _count_step([b"%s:" % (b"" if i is None else str(i).encode()) for i in ids[at:to]], texts[at:to], thinned, found)
                if len(found) > COUNTED:
                    yield _counted(found, least_letters)
                    found = {}
        yield _counted(found, least_letters)

    rows = map_arrow(df.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("binary").alias("t")), count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _counted(found: dict[bytes, int], least: int) -> pa.RecordBatch:
    # a letter is one byte, or C3 and another
    kept = [(w.decode(), n) for w, n in found.items() if n > 0 and len(w) - w.count(b"\xc3") >= least]
    return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])


def _count_step(ids: list[bytes], texts: list[bytes], thinned: int, found: dict[bytes, int]) -> None:
    data, starts, ends, first = letter_runs(texts)
    if not len(starts):
        return
    _, place, which, counts = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True, return_counts=True)
    joined = data.tobytes()
    runs = [joined[a:b] for a, b in zip(starts[place].tolist(), ends[place].tolist(), strict=True)]
    for w, n in zip(runs, counts.tolist(), strict=True):
        found[w] = found.get(w, 0) + n
    doc = np.repeat(np.asarray([zlib.crc32(i) for i in ids], np.uint32), np.diff(first))
    crc = crc_joined(doc, np.asarray([zlib.crc32(w) for w in runs], np.uint32)[which], (ends - starts))
    for k in np.flatnonzero(crc % np.uint32(thinned) == 0).tolist():
        run = runs[which[k]]
        letters = run.decode()
        gone = int(crc[k]) % len(letters)
        found[run] -= 1
        less = (letters[:gone] + letters[gone + 1 :]).encode()
        found[less] = found.get(less, 0) + 1


def light_edges(words: DataFrame) -> DataFrame:
    """``word, at, heavy`` per light edge on a word's way down the trie of ``words`` (word): the edge leaves the node of
    its first ``at`` letters, whose heavy child is ``heavy``.  A word's end is an edge."""
    node = F.substring("word", F.lit(1), F.col("at"))
    child = F.when(F.col("at") < F.length("word"), F.substring("word", F.col("at") + 1, F.lit(1))).otherwise(F.lit(END))
    # a node of one child has no light edge, so that only prefixes of several words are nodes
    steps = words.select("word", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("at")).select("word", "at", node.alias("node"), child.alias("child"))
    edges = steps.groupBy("node", "child").agg(F.count(F.lit(1)).alias("below"))
    heavy = edges.groupBy("node").agg(F.max_by("child", F.struct("below", "child")).alias("heavy"), F.count(F.lit(1)).alias("children"))
    heavy = staged(heavy.where("children > 1").select("node", "heavy"), "spelling-heavy")
    # the side with a row for each node stands once, so that adaptive execution can split a node of very many words
    return steps.join(heavy, "node").where(F.col("child") != F.col("heavy")).select("word", "at", "heavy")


def near_words(counted: DataFrame) -> DataFrame:
    """``word, near`` of words exactly one inserted, deleted or replaced letter apart, each pair in both directions, from
    distinct words (word)."""
    words = staged(counted.select("word"), "spelling-words")
    light = staged(light_edges(words), "spelling-light")
    before, after = F.substring("word", F.lit(1), F.col("at")), F.col("at") + 1
    rest = F.substr("word", after)
    past = F.substr("word", after + 1)
    inner = F.col("at") < F.length("word")
    merged = F.array_compact(
        F.array(
            F.when(inner & (F.col("heavy") != END), F.concat(before, "heavy", past)),
            F.when(inner, F.concat(before, past)),
            F.when(F.col("heavy") != END, F.concat(before, "heavy", rest)),
        )
    )
    met = light.select(F.col("word").alias("near"), F.explode(merged).alias("word")).join(words, "word")
    marked = light.where(inner).select("word", F.concat(before, F.lit(ANY), past).alias("key"))
    groups = marked.groupBy("key").agg(F.collect_list("word").alias("ws")).where(F.size("ws") > 1)
    both = groups.select(F.explode("ws").alias("word"), "ws").select("word", F.explode("ws").alias("near")).where("word <> near")
    out = met.select("word", "near").unionByName(met.select(F.col("near").alias("word"), F.col("word").alias("near"))).unionByName(both).distinct()
    out = staged(out, "spelling-near")
    discard(words, light)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of words (word, form) whose chains of forms end: pointers are doubled until all are at an end."""
    up = staged(forms.where("form is not null").select("word", F.col("form").alias("root")), "spelling-up")
    while True:
        further = up.select(F.col("word").alias("root"), F.col("root").alias("top"))
        step = staged(up.join(further, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "spelling-up")
        discard(up)
        up = step
        if up.where("moved").isEmpty():
            return up.select("word", "root")


def variants(df: DataFrame, ratio: int = 2, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, thinned: int = THINNED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` per word: form is its near word of largest count, if that is ``ratio``
    times its own or more; root is where its chain of forms ends."""
    if ratio < 2:
        raise ValueError("forms of equal count could lead in circles")
    counted = staged(word_counts(df, least_letters, least_count, thinned, id_col, text_col), "spelling-counted")
    near = near_words(counted)
    # the largest count, then the smallest word: the least of (-n, word)
    best = near.join(counted.select(F.col("word").alias("near"), F.col("n").alias("m")), "near").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), F.col("near"))).alias("b"))
    enough = -F.col("b.less") >= ratio * F.col("n")
    formed = counted.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("b.near")).alias("form"), F.when(enough, -F.col("b.less")).alias("form_n"))
    formed = staged(formed, "spelling-formed")
    discard(near, counted)
    return formed.join(roots(formed), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_groups(found: DataFrame) -> DataFrame:
    """``root, n_words, n`` per group of two words or more of ``variants``."""
    return found.groupBy("root").agg(F.count(F.lit(1)).alias("n_words"), F.sum("n").alias("n")).where("n_words > 1")


def edges_per_word(words: DataFrame) -> DataFrame:
    """``word, n_light``: light edges on each word's way, at most the logarithm of the number of words."""
    n = F.count("at").over(Window.partitionBy("word"))
    return words.join(light_edges(words), "word", "left").select("word", n.alias("n_light")).distinct()
