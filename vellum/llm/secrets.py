"""Secret scans: fixed patterns, and a guess-cost dynamic programme over credential-context values.

The patterns find assignments, access keys and long hexadecimal runs.  Beside them, every value that stands after a
credential word is segmented at minimum cost: each character of a value belongs to a dictionary word, a date, a
repeat, a keyboard walk or a brute-force span, and the cost is the logarithm (base 10) of the guesses that an attacker
who knows these shapes needs.  A value at or above ``GUESS_LOG10`` is a secret.  A quoted value of several words costs
what its costliest word costs: a sentence in quotes is no secret.

The dictionary has common passwords, the words of a public vocabulary file in its order, and the most frequent words of
the corpus itself, which one grouped aggregate over all texts counts (``corpus_words``).

Null texts are empty and have no spans.  Offsets count code points.  Texts are scanned whole, values of any length: a
segmentation takes time in proportion to the value.  Repeated rows give equal rows; empty tables give empty results;
only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import math
import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm._support import by_bytes, discard, encoded, map_arrow, span_hashes, staged
from vellum.llm._support import words as split_words

GUESS_LOG10 = 9.0
KINDS = ("assign", "access", "hex", "guess")
# The three patterns, least lengths, and the words of a credential context.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CONTEXT = re.compile(
    r"""(?:(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|secret)[_-]?key|credentials?|bearer)["']?[\x20\t]*(?::=|=>|->|[:=]|(?<=[\x20\t])is(?=[\x20\t]))|bearer(?=[\x20\t]))[\x20\t]*(?:"([^"\n]{4,})"|'([^'\n]{4,})'|["']?([^\s"'](?:\S*[^\s"',;:.<>()\[\]{}])?))""",
    re.IGNORECASE | re.ASCII,
)
#: A value that is no secret may end in the next credential word and its separator, of so many characters at most.
CONTEXT_CHARS = 16
# Common passwords and words in order of rank.
COMMON = """password 123456 qwerty admin welcome letmein login abc123 monkey dragon master shadow sunshine princess football
baseball superman batman trustno1 iloveyou secret hello freedom whatever ninja mustang michael jordan jennifer hunter
buster soccer harley ranger daniel thomas robert tigger charlie andrew love summer winter spring autumn test guest
root user default changeme example sample token access key api server database system manager public private data
the and for you that with this have from your house home work time people world computer internet network office
company service project account email phone green blue black white orange purple yellow silver golden star moon sun
river mountain ocean forest flower tiger lion eagle horse correct battery staple change new old my temp demo dev prod""".split()
#: Words of the corpus that enter the dictionary: the most frequent, in so many documents at least.
CORPUS_WORDS, LEAST_DOCS = 30_000, 5
#: Characters of a dictionary word.
LONGEST = 24
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
NEXT = {(a, b) for row in ROWS for x in (row, row[::-1]) for a, b in zip(x, x[1:], strict=False)}
UNLEET = str.maketrans("4@301$57", "aaeolsst")
DATE = re.compile(r"(?:(?:19|20)\d\d([-/.]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01]))|(?:(?:0?[1-9]|[12]\d|3[01])([-/.]?)(?:0?[1-9]|1[0-2])\2(?:19|20)?\d\d)|(?:19|20)\d\d")
YEAR = re.compile(r"(?:19|20)\d\d")
DATE_CHARS = range(4, 11)
DAYS, YEARS = math.log10(365.25 * 120), math.log10(120)
PERIODS = range(1, 5)


@lru_cache(2)
def ranks(vocabulary_path: str | None = None) -> dict[str, float]:
    """log10 of the rank of each word: common passwords, then the words of a ranks file in its order."""
    if vocabulary_path is None:
        import public_tokenizers

        vocabulary_path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = dict.fromkeys(COMMON)
    with open(vocabulary_path, "rb") as lines:
        for line in lines:
            word = base64.b64decode(line.split()[0]).strip().decode(errors="replace").lower()
            if 3 <= len(word) <= LONGEST and word.isalpha():
                found.setdefault(word)
    return {w: math.log10(k + 2) for k, w in enumerate(found)}


def _plain_word(token: str) -> str | None:
    """A token without punctuation after it, in lower case, if it is letters in lower case after perhaps a capital."""
    word = token.rstrip(".,;:!?")
    return word.lower() if 3 <= len(word) <= LONGEST and word.isalpha() and word[1:].islower() else None


def corpus_words(df: DataFrame, text_col: str = "text", words: int = CORPUS_WORDS, least: int = LEAST_DOCS) -> dict[str, float]:
    """log10 of the rank of the words that most documents hold: at most ``words``, each in ``least`` documents at least.

    A word is lower-case letters, the first of them perhaps a capital, before a mark of punctuation perhaps; so keys,
    digits and mixed case never enter.  All texts are counted, first within a batch, then by a grouped aggregate.  A
    histogram of the counts, with 16 steps a doubling, gives the count from which words enter, so that the driver gets
    ``words`` rows at most."""

    def count(batches):
        for batch in batches:
            texts = encoded(batch.column(0))
            for at, to in by_bytes(texts):
                data, starts, ends, first = split_words(texts[at:to])
                _, place, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
                raw, found, word = data.tobytes(), {}, np.full(len(place), -1)
                for k, (a, b) in enumerate(zip(starts[place].tolist(), ends[place].tolist(), strict=True)):
                    if b - a <= 4 * LONGEST and (w := _plain_word(raw[a:b].decode())):
                        word[k] = found.setdefault(w, len(found))
                held = word[which] if len(place) else word
                doc = np.repeat(np.arange(to - at), np.diff(first))[held >= 0]
                pairs = np.unique(doc * max(1, len(found)) + held[held >= 0])
                counts = np.bincount(pairs % max(1, len(found)), minlength=len(found))
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(counts, pa.int64())], names=["w", "n"])

    counted = map_arrow(df.select(F.col(text_col).cast("binary").alias("t")), count, "w string, n long")
    totals = staged(counted.groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "words")
    step = F.floor(F.log2("n") * 16)
    room, enough = words, None
    for r in sorted(totals.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("c")).collect(), reverse=True):
        room -= r["c"]
        if room < 0:
            break
        enough = r["s"]
    top = totals.where(step >= enough).collect() if enough is not None else []
    discard(totals)
    return {r["w"]: math.log10(k + 2) for k, r in enumerate(sorted(top, key=lambda r: (-r["n"], r["w"])))}


def _single(c: str) -> float:
    """Guesses of one brute-forced character, by its class."""
    return 1.0 if c.isdigit() else 1.415 if c.isascii() and c.isalpha() else 1.519 if c.isascii() else 2.0


class _Run:
    """Edges of a shape whose cost grows with the logarithm of its length, from every start of the run that is open.

    Of two starts the earlier one gains on the later one as the run goes on, so a start that an earlier one undercuts
    never counts again, and few are kept."""

    def __init__(self, least: int):
        self.least, self.begin, self.starts = least, 0, []

    def cut(self, begin: int) -> None:
        """The run is broken: no start before ``begin``."""
        self.begin = begin
        self.starts = [s for s in self.starts if s >= begin]

    def best(self, best: list[float], e: int) -> tuple[float, int] | None:
        """(least of best[s] + log10(e - s), s) over the starts s."""
        if e - self.least >= self.begin:
            self.starts.append(e - self.least)
        kept, least = [], None
        for s in self.starts:
            cost = best[s] + math.log10(e - s)
            if least is None or cost < least[0]:
                least = (cost, s)
                kept.append(s)
        self.starts = kept
        return least


def guess_cost(value: str, words: dict[str, float] | None = None) -> tuple[float, list[tuple[str, int, int]]]:
    """(log10 of the guesses, segments as (shape, start, end)) of the cheapest segmentation.

    Edges into each place come from words up to the longest one, dates, and runs that end there, from each of their
    starts; a brute-force span is a chain of single characters.  ``words`` are ranks beside those of ``ranks``."""
    known, more = ranks(), words or {}
    n, low = len(value), value.lower()
    if len(low) != n:  # a few capitals have two lower-case characters
        low = "".join(c.lower()[0] for c in value)
    plain = low.translate(UNLEET)
    best, back = [0.0] + [math.inf] * n, [("", 0)] * (n + 1)
    repeats, walk = [_Run(3 if p == 1 else 2 * p) for p in PERIODS], _Run(3)
    for e in range(1, n + 1):
        c = low[e - 1]
        options = [(best[e - 1] + _single(c), "brute", e - 1)]
        for p, run in zip(PERIODS, repeats, strict=True):
            if e > p and c != low[e - 1 - p]:
                run.cut(e - p)
            if found := run.best(best, e):
                options.append((found[0] - math.log10(p) + sum(map(_single, low[e - p : e])), "repeat", found[1]))
        if e > 1 and (low[e - 2], c) not in NEXT:
            walk.cut(e - 1)
        if found := walk.best(best, e):
            options.append((found[0] + math.log10(37 * 2), "walk", found[1]))
        for s in range(max(0, e - LONGEST), e - 2):
            for form, extra in ((low, 0.0), (plain, 0.6)):
                piece = form[s:e]
                rank = min(known.get(piece, math.inf), more.get(piece, math.inf))
                if rank < math.inf:
                    upper = sum(x.isupper() for x in value[s:e])
                    case = 0.0 if not upper else 0.3 if upper == e - s or value[s].isupper() and upper == 1 else math.log10(math.comb(e - s, upper) + 1)
                    options.append((best[s] + rank + case + extra, "word", s))
        if value[e - 1].isdigit():
            for k in DATE_CHARS:
                if k <= e and value[e - k].isdigit() and DATE.fullmatch(value, e - k, e):
                    options.append((best[e - k] + (YEARS if YEAR.fullmatch(value, e - k, e) else DAYS), "date", e - k))
        cost, shape, s = min(options)
        best[e], back[e] = cost, (shape, s)
    parts, e = [], n
    while e:
        shape, s = back[e]
        if parts and shape == parts[-1][0] == "brute":
            parts[-1] = (shape, s, parts[-1][2])
        else:
            parts.append((shape, s, e))
        e = s
    return best[n], parts[::-1]


def strength(value: str, words: dict[str, float] | None = None) -> float:
    """The guess cost of a value; of several words, that of the costliest."""
    return max((guess_cost(x, words)[0] for x in value.split()), default=0.0)


def find_spans(text: str, threshold: float = GUESS_LOG10, words: dict[str, float] | None = None) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, guess cost) by start, then kind: the patterns' matches, and values that only the guess cost
    finds."""
    out = []
    if ":" in text or "=" in text:
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 6:
                out.append(("assign", m.start(), m.end(), guess_cost(m[2], words)[0]))
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end(), None) for m in HEX.finditer(text)]
    base = sorted((a, b) for _, a, b, _ in out)
    # how far the first k of the patterns' spans reach
    reach = list(accumulate((b for _, b in base), max, initial=0))
    m = CONTEXT.search(text)
    while m:
        g = m.lastindex
        start, end = m.span(g)
        at = max(start, end - CONTEXT_CHARS)
        if reach[bisect_left(base, (end,))] <= start:
            cost = strength(m[g], words)
            if cost >= threshold:
                out.append(("guess", start, end, cost))
                at = end
        m = CONTEXT.search(text, at)
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans)


def scan(df: DataFrame, threshold: float = GUESS_LOG10, words: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, spans`` per row: an array of (kind, start, end, guess_log10).  ``words`` are those of ``corpus_words``."""

    def find(batches):
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end", "guess_log10"), s, strict=True)) for s in find_spans(t or "", threshold, words)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=[id_col, "spans"])

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("guess_log10", pa.float64())]))
    id_type = df.schema[id_col].dataType.simpleString()
    return map_arrow(df.select(id_col, text_col), find, f"`{id_col}` {id_type}, spans array<struct<kind:string,start:int,end:int,guess_log10:double>>")


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts per kind, the digest of the patterns' spans and all spans as text."""
    s, line = F.col("spans"), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    count = lambda k: F.size(F.filter(s, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.array_join(F.transform(F.filter(s, lambda x: x["kind"] != "guess"), line), ",")
    return scanned.select(id_col, count("assign"), count("access"), count("hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform(s, line), ",").alias("spans"), count("guess"), F.array_max(F.transform(s, lambda x: x["guess_log10"])).alias("max_guess_log10"))


def redact(df: DataFrame, threshold: float = GUESS_LOG10, words: dict[str, float] | None = None, text_col: str = "text", chars_col: str | None = "n_chars", mark: str = "[secret]") -> DataFrame:
    """df with each span of its texts replaced by a mark (overlapping spans by one), and the character count renewed.
    All columns pass through; null texts stay null."""
    schema = df.schema
    at = df.columns.index(text_col)
    count = df.columns.index(chars_col) if chars_col in df.columns else None

    def clean(batches):
        for batch in batches:
            texts = []
            for t in batch.column(at).to_pylist():
                if t:
                    parts, to = [], 0
                    for _, a, b, _ in find_spans(t, threshold, words):
                        if a >= to:
                            parts += [t[to:a], mark]
                        to = max(to, b)
                    t = "".join([*parts, t[to:]]) if parts else t
                texts.append(t)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.column(at).type)
            if count is not None:
                columns[count] = pa.array([old if new is None else len(new) for old, new in zip(columns[count].to_pylist(), texts, strict=True)], columns[count].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return map_arrow(df, clean, schema)
