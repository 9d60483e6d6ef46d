"""Quality rules as a bitmask ledger, in DataFrame functions alone.

``ledger`` evaluates every rule once per document and stores the measurements and one bit per failed
rule.  A policy is a version, the mask of the rules that reject under it; ``apply_policy`` and
``ablations`` work on the stored bits and never look at a text again.

Null and empty texts have no words and fail ``few_words``.  Repeated rows are judged one by one; an
empty table gives an empty ledger; texts are measured whole, however long; columns of the input other than the id and the text are ignored
unless named in ``keep``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm._support import SEPARATORS

#: Rule name to its bit; bits are never reused for another rule.
RULES = {"few_words": 0, "repeated_windows": 1, "symbols": 2, "duplicate_lines": 3, "word_length": 4, "joined_words": 5, "no_letters": 6, "exclaimed": 7, "tabular": 8, "stuttered": 9}
#: Policy versions: the rules that reject.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "word_length", "no_letters"),
    "v2": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "word_length", "no_letters", "exclaimed", "tabular"),
    "v3": ("few_words", "repeated_windows", "symbols", "word_length", "no_letters", "exclaimed", "tabular", "stuttered"),
}
DEFAULT_POLICY = "v3"
#: Words of a window for repeats.
WINDOW = 5


def mask(policy: str) -> int:
    """The bits of a policy's rules."""
    return sum(1 << RULES[r] for r in POLICIES[policy])


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, measurements, ``failures`` (a bit per failed rule).

    The text is read once, without a shuffle.  Window hashes are 64 bits.  The walk over sorted places runs
    only where a window repeats.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = df.select(F.col(id_col), *(F.col(k) for k in keep), text.alias("__t"))
    base = base.withColumn("__w", F.array_remove(F.split("__t", SEPARATORS), "")).withColumn(
        "__l", F.filter(F.split("__t", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\r\x0b\x0c"))) > 0)
    )
    w, v = F.col("__w"), F.col("__v")
    base = base.withColumn("__v", F.transform(w, lambda x: F.xxhash64(x)))
    base = base.withColumn("__h", F.when(F.size(w) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(F.get(v, i + k) for k in range(WINDOW))))).otherwise(F.array().cast("array<bigint>")))
    base = base.withColumn("__d", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    repeated = F.array_sort(F.transform(F.filter(F.col("__d"), lambda s, k: ((k > 0) & (F.get(F.col("__d"), k - 1)["h"] == s["h"])) | (F.get(F.col("__d"), k + 1)["h"] == s["h"])), lambda s: s["i"]))
    base = base.withColumn("__p", F.when(F.col("__d").isNull(), F.array().cast("array<int>")).otherwise(repeated))
    p = F.col("__p")
    covered = F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    chars = F.length(F.array_join("__w", ""))
    measured = base.select(
        id_col, *keep,
        F.size("__w").cast("long").alias("n_words"),
        chars.cast("long").alias("word_chars"),
        F.regexp_count("__t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
        F.regexp_count("__t", F.lit(r"!!")).cast("long").alias("n_exclaimed"),
        F.regexp_count("__t", F.lit(r"[ \n]\|[ \n]")).cast("long").alias("n_bars"),
        F.size(F.filter(v, lambda x, i: F.coalesce(F.get(v, i + 1) == x, F.lit(False)))).cast("long").alias("n_stutters"),
        F.regexp_like("__t", F.lit(r"\p{L}")).alias("has_letters"),
    )
    n, c = F.col("n_words"), F.col
    failed = {
        "few_words": n < 10,
        "repeated_windows": 100 * c("n_repeat_words") > 20 * n,
        "symbols": 10 * c("n_symbols") > n,
        "duplicate_lines": 10 * c("n_dup_lines") > 3 * c("n_lines"),
        "word_length": (c("word_chars") < 2 * n) | (c("word_chars") > 15 * n),
        "joined_words": c("word_chars") > 25 * n,
        "no_letters": ~c("has_letters"),
        "exclaimed": 10 * c("n_exclaimed") > 2 * n,
        "tabular": 10 * c("n_bars") > 2 * n,
        "stuttered": 10 * c("n_stutters") > 2 * n,
    }
    bits = F.lit(0).cast("long")
    for rule, bit in RULES.items():
        bits = bits.bitwiseOR(F.when(failed[rule], F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("failures", bits)


def apply_policy(ledger_df: DataFrame, policy: str = DEFAULT_POLICY, kept_col: str = "kept") -> DataFrame:
    """Adds the verdict of a policy: kept if none of its bits is set."""
    return ledger_df.withColumn(kept_col, F.col("failures").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0)


def ablations(ledger_df: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """A row per rule of the policy: documents that fail it, that only it rejects, and that the policy without it
    keeps.  Documents are first counted by failure mask, so that what the rules are expanded over is bounded by the
    number of masks."""
    m = mask(policy)
    masks = ledger_df.groupBy(F.col("failures").bitwiseAND(F.lit(m).cast("long")).alias("f")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES[r]).cast("long").alias("bit")) for r in POLICIES[policy])))
    at = masks.select("f", "n", rules.alias("r")).select("f", "n", "r.rule", "r.bit")
    hit = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(F.lit(0))).alias
    f, bit = F.col("f"), F.col("bit")
    return at.groupBy("rule").agg(hit(f.bitwiseAND(bit) != 0)("failed"), hit(f == bit)("only_this"), hit((f == bit) | (f == 0))("kept_without"), F.bit_or(F.when(f.bitwiseAND(bit) != 0, f)).alias("fails_with"))
