"""The registered queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import harmonic, kdshard, langid, media, mixing, neardup, packing, pointintime, rules, secrets, spelling, substring, unigram
from vellum.llm._support import n_words


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_guess_cost_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return secrets.digest(secrets.scan(docs, words=secrets.corpus_words(docs)))


def op2_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = rules.apply_policy(rules.apply_policy(rules.ledger(_documents(spark, sf_dir)), "base", "__base"))
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("__base")).alias("base_failed"), "kept", "failures")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return mixing.mix(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text")), draw=("text",))


def op4_trie_unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.token_counts(_documents(spark, sf_dir))


def op5_min_max_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_documents(spark, sf_dir), size=2)


def op6_substring_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_documents(spark, sf_dir))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(packing.pieces(_documents(spark, sf_dir)))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_chunked_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_documents(spark, sf_dir))


def op9_language_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = langid.train(_documents(spark, sf_dir))
    return langid.identify_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), model)


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = kdshard.kd_shards(_documents(spark, sf_dir), leaves=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_persistent_tree_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pointintime.shop_features(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("clicks", "sales", "sale_lines")))


def op12_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonic.harmonic_pack(_documents(spark, sf_dir))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_documents(spark, sf_dir))


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1's counts of its patterns' matches, which SQL can state."""
    return secrets.digest(secrets.scan(_documents(spark, sf_dir))).select("doc_id", "n_assign", "n_access", "n_hex")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3's sizes and targets; what each document gives depends on a draw."""
    return op3_source_mix(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def media_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8's sizes, and the digest of what it reads back."""
    return op8_chunked_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "media_bytes")


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10's sizes, and whether each shard's slots are its rows numbered from 0."""
    placed = op10_kd_shards(spark, sf_dir)
    n = F.count(F.lit(1))
    whole = placed.groupBy(F.col("shard").alias("s")).agg(((F.min("slot") == 0) & (F.max("slot") == n - 1) & (F.sum("slot") == (n * (n - 1) / 2).cast("long"))).alias("gapless"))
    return placed.join(whole, F.col("shard") == F.col("s")).select("doc_id", "size", "law", "gapless", F.col("shard").between(0, 15).alias("in_range"))


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of op2's policy rejects, from the ledger's bits."""
    return rules.ablations(rules.ledger(_documents(spark, sf_dir)))


# The separators and words of the contracts, for DuckDB.
_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_CREDENTIAL = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))

_LEDGER = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest(range(5)) AS k) GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(l) AS n_lines, len(regexp_extract_all(t, '!!')) AS n_exclaimed,
  len(regexp_extract_all(t, '[ \n][|][ \n]')) AS n_bars, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutters, regexp_matches(t, '\\p{{L}}') AS has_letters
  FROM l LEFT JOIN rep USING (doc_id)),
r AS (SELECT *, [n_words < 10, 100 * n_repeat_words > 20 * n_words, 10 * n_symbols > n_words, 10 * n_dup_lines > 3 * n_lines, word_chars < 2 * n_words OR word_chars > 15 * n_words,
  word_chars > 25 * n_words, NOT has_letters, 10 * n_exclaimed > 2 * n_words, 10 * n_bars > 2 * n_words, 10 * n_stutters > 2 * n_words] AS bits FROM m),
ledger AS (SELECT *, list_sum(list_transform(range(1, 11), lambda i: CASE WHEN bits[i] THEN 1 << (i - 1) ELSE 0 END))::BIGINT AS failures FROM r)
"""
_POLICY = rules.POLICIES[rules.DEFAULT_POLICY]



def _crc32(text: str) -> str:
    """CRC-32 of a text of ASCII, a bit at a time."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(4294967295, list_reduce({bits}, lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295::BIGINT))"


_KNOWN = "epoch_us({0}.arrived_at) + 14400000000 <= q.t"
_WITHIN = "epoch_us({0}) > q.t - q.d * 86400000000 AND epoch_us({0}) <= q.t"
_CENTS = "coalesce(sum(floor(100 * {0} + 0.5)), 0)::BIGINT"

SQL = {
    "op11_persistent_tree_features": f"""
WITH s AS (SELECT *, epoch_us(sold_at) + {_crc32("sale_id::VARCHAR")} % 259200 * 1000000 AS t FROM sales WHERE client_id IS NOT NULL AND sold_at IS NOT NULL),
q AS (SELECT sale_id, client_id, t, unnest([2, 14]) AS d FROM s),
c AS (SELECT q.sale_id, q.d, count(*) AS n, count(*) FILTER (c.kind = 'purchase') AS p, {_CENTS.format("c.value")} AS v, max({{'a': c.ts, 'b': c.click_id}}).b AS last
  FROM q JOIN (SELECT DISTINCT * FROM clicks) c ON c.client_id = q.client_id AND {_WITHIN.format("c.ts")} AND {_KNOWN.format("c")} GROUP BY 1, 2),
o AS (SELECT q.sale_id, q.d, q.t, s.sale_id AS sale, s.total FROM q JOIN s ON s.client_id = q.client_id AND {_WITHIN.format("s.sold_at")} AND {_KNOWN.format("s")}),
n AS (SELECT sale_id, d, count(*) AS n, {_CENTS.format("total")} AS v FROM o GROUP BY 1, 2),
l AS (SELECT o.sale_id, o.d, count(*) AS n, count(DISTINCT item_id) AS i, {_CENTS.format("amount")} AS v FROM o JOIN sale_lines l ON l.sale_id = o.sale AND epoch_us(l.shipped_at) <= o.t GROUP BY 1, 2),
f AS (SELECT DISTINCT q.sale_id FROM q JOIN s ON s.client_id = q.client_id AND epoch_us(s.sold_at) > q.t AND epoch_us(s.sold_at) <= q.t + 604800000000)
SELECT q.sale_id, q.d::INTEGER AS d, q.t AS t_us, f.sale_id IS NOT NULL AS label, coalesce(c.n, 0) AS n_clicks, coalesce(c.p, 0) AS n_purchases, coalesce(c.v, 0) AS click_cents, c.last AS last_click_id,
 coalesce(n.n, 0) AS n_sales, coalesce(n.v, 0) AS sale_cents, coalesce(l.n, 0) AS n_lines, coalesce(l.i, 0) AS n_items, coalesce(l.v, 0) AS line_cents
FROM q LEFT JOIN c USING (sale_id, d) LEFT JOIN n USING (sale_id, d) LEFT JOIN l USING (sale_id, d) LEFT JOIN f ON f.sale_id = q.sale_id""",
    "op2_rule_ledger": f"""{_LEDGER} SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
 n_repeat_words::BIGINT AS n_repeat_words, failures & {rules.mask("base")} <> 0 AS base_failed, failures & {rules.mask(rules.DEFAULT_POLICY)} = 0 AS kept, failures FROM ledger""",
    "rule_ablations": f"""{_LEDGER}, f AS (SELECT failures & {rules.mask(rules.DEFAULT_POLICY)} AS f FROM ledger),
 p AS (SELECT unnest({[{"rule": x, "bit": 1 << rules.RULES[x]} for x in _POLICY]}) AS p)
 SELECT p.rule AS rule, count(*) FILTER (f & p.bit <> 0) AS failed, count(*) FILTER (f = p.bit) AS only_this, count(*) FILTER (f = p.bit OR f = 0) AS kept_without,
 bit_or(f) FILTER (f & p.bit <> 0) AS fails_with FROM f, p GROUP BY 1""",
    "op5_min_max_hash": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
link AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * c >= 80 * (u.n + v.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(b) AS component_id, doc_id = min(b) AS kept FROM (SELECT a AS doc_id, b FROM reach) LEFT JOIN n USING (doc_id) GROUP BY doc_id""",
    "op6_substring_repeats": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
lost AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY s) AS m FROM win) WHERE m < doc_id),
gone AS (SELECT doc_id, list(DISTINCT i + k) AS g FROM lost, (SELECT unnest(range(13)) AS k) GROUP BY doc_id),
word AS (SELECT doc_id, i, w[i] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
cut AS (SELECT DISTINCT doc_id, i + k AS i FROM lost, (SELECT unnest(range(13)) AS k)),
left_over AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM word ANTI JOIN cut USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN left_over USING (doc_id)""",
    "secret_counts": f"""SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '({_CREDENTIAL})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) AS n_assign,
 len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS n_access, len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 24)) AS n_hex FROM documents""",
    "mix_targets": f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 2.0 * sum(size) AS cap, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM d GROUP BY source),
r AS (SELECT *, (1.5 * (SELECT sum(size) FROM d) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, cap / weight AS ratio FROM s),
lv AS (SELECT arg_min(level, ratio) AS level FROM r WHERE level <= ratio)
SELECT doc_id, size::BIGINT AS size, source_size, round(least(cap, coalesce(lv.level * weight, cap)), 3) AS target FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source, lv""",
    "media_sizes": """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT doc_id, octet_length(b) AS n, b, CASE WHEN octet_length(b) = 0 THEN 64 ELSE (64 - octet_length(b) % 64) % 64 END AS pad FROM d)
SELECT doc_id, n::BIGINT AS n_bytes, (n + pad)::BIGINT AS payload_bytes, sha256(b || repeat('\x00'::BLOB, pad)) AS payload_sha256, (n + pad + 44)::BIGINT AS media_bytes FROM p""",
    "shard_sizes": "SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS size, 'bytes' AS law, true AS gapless, true AS in_range FROM documents",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries opN_, and those that show the part of an operator's result which SQL can state."""
    ops = (op1_guess_cost_secrets, op2_rule_ledger, op3_source_mix, op4_trie_unigram_counts, op5_min_max_hash, op6_substring_repeats, op7_best_fit_packing, op8_chunked_media, op9_language_evidence, op10_kd_shards, op11_persistent_tree_features, op12_harmonic_packing, op13_spelling_variants)
    return {f.__name__: f for f in (*ops, rule_ablations, secret_counts, mix_targets, media_sizes, shard_sizes)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL over whole tables."""
    return dict(SQL)
