"""A corpus pipeline: language ID, near-duplicates, secrets, source weights, packing.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next stage's docs.
All stages but the last return the columns of ``documents``, and other columns of docs unchanged.  A stage must be
written before the next is called: each begins by deleting the intermediate tables of the one before.

No stage looks documents up by id, so null ids and ids that repeat are rows like others; ties are broken by a hash of the
text.  Extra columns may have any name that does not begin with two underscores.  An empty table stays empty.  Texts are
read whole, however long.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import langid, mixing, neardup, packing, secrets
from vellum.llm._support import SEPARATORS, discard, n_words, recorded, release, staged

#: None: the stages' models, hashes and packing are beyond SQL.
ORACLE_SQL = None

_made: list = []


def _stage(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(_made)
        with recorded() as made:
            out = function(spark, docs, sf_dir)
        _made.extend(made)
        return out

    return run_stage


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told from text and source; others go.  The labels train the model and are no
    evidence.  Null, empty and wordless texts have no language and go; equal rows are judged alike."""
    return langid.filter_documents(docs, langid.train(docs))


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of five-word-shingle similarity 0.8 stays: the one with the least id, then hash of its text,
    and of rows equal in both any one.  Rows without words are in no group and stay."""
    return neardup.drop_duplicates(docs, size=5)


@_stage
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text becomes a mark, and n_chars follows; no document goes, and null texts stay null."""
    return secrets.redact(docs, words=secrets.corpus_words(docs))


@_stage
def weigh_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per repetition that the mix takes: whole texts, and of the last document drawn from a source the text up to
    the last word taken, with the white space between.  Documents without words have no size and are not taken."""
    sized = docs.select("*", n_words(F.col("text")).alias("__size"))
    found = mixing.mixed(sized, size_col="__size", draw=("doc_id", "text"))
    size, taken, text = F.col("__z"), F.col("taken"), F.col("__row.text")
    whole = F.when(size > 0, F.floor(taken / size)).otherwise(F.lit(0)).cast("int")
    part = (taken - whole * size).cast("int")
    # every piece but the last is separators and a word
    first_words = F.array_join(F.slice(F.split(text, f"(?<=[^{SEPARATORS[1:-2]}])(?=[{SEPARATORS[1:-2]}])"), F.lit(1), part), "")
    copies = F.concat(F.array_repeat(text, whole), F.when(part > 0, F.array(first_words)).otherwise(F.array().cast("array<string>")))
    out = found.select("__row", F.explode(copies).alias("__text"))
    kept = {"text": F.col("__text"), "n_chars": F.length("__text").cast(docs.schema["n_chars"].dataType)}
    return out.select(*(kept.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns))


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: a row per piece of a document.  A null text is the end id alone."""
    return packing.pack(packing.pieces(docs)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("source_weights", weigh_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, staged(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
