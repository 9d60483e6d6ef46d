"""Language identification by fusing evidence.

The text's likelihood comes from hashed byte trigrams, trained on a bounded sample of labelled rows.  It is combined by
Bayes' rule with the language that the markup declares and with a prior of the host.  A host's prior is counted over
all its rows by grouped aggregation, smoothed by that of its address suffix, and that one by the prior of all rows;
a row's own count is taken out of its host's.  Text that no language explains better than chance is ``und``.

Null and empty texts give no likelihood and are ``und``.  Null hosts, suffixes and declarations give no evidence.
Repeated rows are counted as rows, rows with null ids like others.  Of equal scores the language first in order is
taken.  Texts are read whole, those of the training sample too.  Empty tables give empty results.  Columns of the input
may have any name that does not begin with two underscores.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm._support import by_bytes, encoded, map_arrow, staged

UNKNOWN = "und"
#: Labelled rows to train on: those with the least hash of id and text, among texts of SAMPLE_TEXT bytes at most.
SAMPLE_ROWS, SAMPLE_TEXT = 2000, 16 << 10
BUCKETS = 1 << 15
#: Share of trigrams that are chance in any text.
CHANCE = 0.2
#: Trigrams overlap, so each counts as a third of an observation.
TEMPER = 1 / 3
#: A declaration names the right language this often.
DECLARED_RIGHT = 0.9
#: Rows that a smoothing prior counts for.
HOST_ROWS, SUFFIX_ROWS, ALL_ROWS = 20.0, 50.0, 10.0
MIN_POSTERIOR = 0.5
#: Hosts whose priors are sent to every executor; more are joined by a shuffle.
BROADCAST_HOSTS = 100_000
_OPENING = re.compile(r"<!--|<(?:script|style|nav|footer|noscript)\b|<div class=\"ad\">", re.I)
#: What ends each opening, in small letters.
_CLOSING = {"<!--": re.compile("-->"), '<div class="ad">': re.compile("</div>", re.I)} | {f"<{x}": re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "nav", "footer", "noscript")}


@dataclass(frozen=True)
class Model:
    """Languages in order, ``und`` last, and the log-probability of each trigram bucket under each."""

    langs: tuple[str, ...]
    table: np.ndarray


def _trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every trigram of lower-cased texts set between spaces, ends of the texts)."""
    framed = [b" " + t.lower() + b" " for t in texts]
    data = np.frombuffer(b"".join([*framed, b"  "]), np.uint8).astype(np.uint32)
    data[(data >= 9) & (data <= 13)] = 32
    code = data[:-2] * np.uint32(65536) + data[1:-1] * np.uint32(256) + data[2:]
    bucket = (code * np.uint32(2654435761)) >> np.uint32(17)
    return bucket, np.cumsum([len(t) for t in framed])


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[ends] - total[np.concatenate([[0], ends[:-1]])]


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS) -> Model:
    """A model of the languages in a sample of at most ``rows`` labelled rows, and so of ``rows`` * SAMPLE_TEXT bytes.
    Equal rows are one."""
    text = F.col(text_col)
    labelled = df.where(F.col(lang_col).isNotNull() & (F.length(F.trim(text)) > 0) & (F.octet_length(text) <= SAMPLE_TEXT))
    held = labelled.select(F.xxhash64(id_col, text_col).alias("h"), F.col(lang_col).alias("l"), text.alias("t"))
    # hashes are uniform: those under a bound that leaves some multiple of the rows wanted; all, if equal rows leave too few
    n, low = held.count(), -(1 << 63)
    bound = min((1 << 63) - 1, low + int((1 << 64) * 16 * rows / max(1, n)))
    for most in (bound, (1 << 63) - 1):
        least = held.select("h").where(F.col("h") <= most).groupBy("h").agg(F.lit(1)).orderBy("h").limit(rows)
        got, last = least.agg(F.count(F.lit(1)), F.max("h")).first()
        if got == rows:
            break
    found = held.where(F.col("h") <= last).dropDuplicates(["h", "l"]).orderBy("h", "l").limit(rows).select("l", "t").collect() if last is not None else []
    langs = tuple(sorted({r[0] for r in found}))
    table = np.full((len(langs) + 1, BUCKETS), -np.log(BUCKETS), np.float32)
    for k, lang in enumerate(langs):
        bucket, _ = _trigrams([r[1].encode() for r in found if r[0] == lang])
        count = np.bincount(bucket, minlength=BUCKETS)
        # a share of chance in every language, so that digits and keys among words do not outweigh them
        table[k] = np.log((1 - CHANCE) * count / max(1, count.sum()) + CHANCE / BUCKETS)
    return Model((*langs, UNKNOWN), table)


def _without_hidden(page: str) -> str:
    """page with a space for each hidden part.  An opening that is closed nowhere hides nothing, and no later one of its
    kind is looked for again, so a page is read about once for each kind, however many openings it has."""
    out, at, pos, unclosed = [], 0, 0, set()
    while found := _OPENING.search(page, pos):
        kind, pos = found.group().lower(), found.end()
        end = None if kind in unclosed else _CLOSING[kind].search(page, pos)
        if end is None:
            unclosed.add(kind)
        else:
            out += [page[at : found.start()], " "]
            at = pos = end.end()
    return "".join([*out, page[at:]])


def _without_tags(page: str) -> str:
    """page with a space for each ``<``, up to the next ``>``; without one the rest stays."""
    out, at = [], 0
    while (start := page.find("<", at)) >= 0 and (end := page.find(">", start)) >= 0:
        out += [page[at:start], " "]
        at = end + 1
    return "".join([*out, page[at:]])


def visible_text(page: str) -> str:
    """The text of a page without markup, scripts, navigation, advertisements and footers."""
    return html.unescape(_without_tags(_without_hidden(page)))


def likelihoods(df: DataFrame, model: Model, text_col: str = "text", markup: bool = False) -> DataFrame:
    """df with ``__ll``: the tempered log-likelihood of its text under each language; null without a trigram."""
    at = df.columns.index(text_col)

    def score(batches):
        for batch in batches:
            column = batch.column(at)
            texts = [visible_text(x or "").encode() for x in column.to_pylist()] if markup else encoded(column)
            for a, b in by_bytes(texts):
                bucket, ends = _trigrams(texts[a:b])
                ll = np.stack([_sums(row[bucket], ends) for row in model.table], 1) * TEMPER
                values = [x if t.strip() else None for t, x in zip(texts[a:b], ll, strict=True)]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values, pa.list_(pa.float64()))], names=[*batch.schema.names, "__ll"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return map_arrow(df, score, f"{schema}, __ll array<double>")


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, without user and port."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def suffix_of(host: Column) -> Column:
    """The last label of a host."""
    return F.nullif(F.regexp_extract(host, r"\.([a-z]{2,})$", 1), F.lit(""))


def declared_in(page: Column) -> Column:
    """The primary language that the root element of a page declares."""
    return F.nullif(F.lower(F.regexp_extract(page, r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)), F.lit(""))


def _guess(n: int) -> Column:
    """The place of the likeliest language of ``__ll``, from 0; -1 without a likelihood."""
    return F.coalesce(F.array_position("__ll", F.array_max("__ll")).cast("int") - 1, F.lit(-1))


def host_priors(scored: DataFrame, model: Model) -> tuple[DataFrame, list[float]]:
    """``__host, __n, __up``: counts of text guesses per host and language, and what its suffix expects; beside it the
    prior over all rows."""
    n = len(model.langs)
    g = scored.select("__host", "__suffix", _guess(n).alias("__g")).where("__g >= 0").groupBy("__host", "__suffix", "__g").agg(F.count(F.lit(1)).alias("c"))
    g = staged(g, "lang-guesses")
    counts = [F.coalesce(F.sum(F.when(F.col("__g") == k, F.col("c"))), F.lit(0)).cast("double") for k in range(n)]
    every = g.agg(*counts).first()
    total = sum(x or 0.0 for x in every)
    base = [((x or 0.0) + ALL_ROWS / n) / (total + ALL_ROWS) for x in every]
    suffixes = g.where("__suffix is not null").groupBy("__suffix").agg(F.array(*counts).alias("__s"))
    hosts = g.where("__host is not null").groupBy("__host").agg(F.first("__suffix", ignorenulls=True).alias("__suffix"), F.array(*counts).alias("__n"))
    zero = F.array(*(F.lit(0.0) for _ in range(n)))
    flat = F.array(*(F.lit(float(x)) for x in base))
    up = hosts.join(suffixes, "__suffix", "left").withColumn("__s", F.coalesce("__s", zero))
    weight = F.aggregate("__s", F.lit(0.0), lambda a, x: a + x)
    smooth = F.zip_with("__s", flat, lambda x, p: (x + SUFFIX_ROWS * p) / (weight + SUFFIX_ROWS))
    return staged(up.select("__host", "__n", smooth.alias("__up")), "lang-hosts"), base


def fuse(scored: DataFrame, model: Model) -> DataFrame:
    """scored (with ``__ll, __host, __suffix, __declared``) with ``__found``: lang, posterior, text_lang and accepted."""
    n, langs = len(model.langs), F.array(*(F.lit(x) for x in model.langs))
    hosts, base = host_priors(scored, model)
    hosts = F.broadcast(hosts) if hosts.count() <= BROADCAST_HOSTS else hosts
    flat = F.array(*(F.lit(float(x)) for x in base))
    joined = scored.join(hosts.withColumnRenamed("__host", "__k"), F.col("__host") == F.col("__k"), "left").withColumn("__g", _guess(n))
    own = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (k == F.col("__g")).cast("double"))
    seen = F.when(F.col("__n").isNotNull(), F.zip_with("__n", own, lambda x, y: F.greatest(x - y, F.lit(0.0)))).otherwise(F.array(*(F.lit(0.0) for _ in range(n))))
    joined = joined.withColumn("__seen", seen)
    weight = F.aggregate("__seen", F.lit(0.0), lambda a, x: a + x)
    prior = F.zip_with("__seen", F.coalesce("__up", flat), lambda x, p: F.log((x + HOST_ROWS * p) / (weight + HOST_ROWS)))
    d = F.col("__declared")
    known = d.isin(list(model.langs[:-1]))
    said = F.transform(langs, lambda x: F.when(~F.coalesce(known, F.lit(False)), F.lit(0.0)).when(x == d, F.log(F.lit(DECLARED_RIGHT))).otherwise(F.log(F.lit((1 - DECLARED_RIGHT) / max(1, n - 1)))))
    joined = joined.withColumn("__lp", F.zip_with(F.zip_with("__ll", prior, lambda a, b: a + b), said, lambda a, b: a + b)).withColumn("__top", F.array_max("__lp"))
    best = F.array_position("__lp", F.col("__top")).cast("int")
    mass = F.aggregate("__lp", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("__top")))
    lang = F.when(F.col("__ll").isNull(), F.lit(UNKNOWN)).otherwise(F.element_at(langs, best))
    posterior = F.when(F.col("__ll").isNull(), F.lit(0.0)).otherwise(1 / mass)
    text_lang = F.when(F.col("__g") >= 0, F.get(langs, F.col("__g"))).otherwise(F.lit(UNKNOWN))
    found = F.struct(lang.alias("lang"), posterior.alias("posterior"), text_lang.alias("text_lang"), ((lang != UNKNOWN) & (posterior >= MIN_POSTERIOR)).alias("accepted"))
    return joined.withColumn("__found", found).drop("__k", "__n", "__up", "__g", "__seen", "__lp", "__top", "__ll")


def identify_pages(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id, host, declared, text_lang, lang, posterior, accepted`` per page."""
    host = host_of(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("__id"), F.col(html_col).alias("__t"), host.alias("__host"), suffix_of(host).alias("__suffix"), declared_in(F.col(html_col)).alias("__declared"))
    scored = staged(likelihoods(rows, model, "__t", markup=True).drop("__t"), "lang-pages")
    return fuse(scored, model).select(F.col("__id").alias(id_col), F.col("__host").alias("host"), F.col("__declared").alias("declared"), "__found.text_lang", "__found.lang", F.round("__found.posterior", 6).alias("posterior"), "__found.accepted")


def filter_documents(docs: DataFrame, model: Model, text_col: str = "text", host_col: str = "source", declared_col: str | None = None) -> DataFrame:
    """The rows of docs whose language is accepted, with the columns of docs; a source stands for a host.  A label is
    evidence only where ``declared_col`` names it: a model that was trained on the same labels must not meet them again.
    The texts are read twice and not shuffled."""
    declared = F.lower(F.col(declared_col)) if declared_col else F.lit(None).cast("string")
    tagged = docs.withColumns({"__host": F.col(host_col), "__suffix": F.lit(None).cast("string"), "__declared": declared})
    return fuse(likelihoods(tagged, model, text_col), model).where("__found.accepted").select(*docs.columns)
