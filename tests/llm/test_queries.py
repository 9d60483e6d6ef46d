"""The registered queries of the corpus operators against their SQL, and the columns of those without."""

import math
import os

import duckdb
import pytest

from vellum.llm import queries as corpus

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_guess_cost_secrets": "doc_id n_assign n_access n_hex base_sha256 spans n_guess max_guess_log10",
    "op3_source_mix": "doc_id size source_size target taken",
    "op4_trie_unigram_counts": "doc_id n_pretokens n_tokens",
    "op7_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op8_chunked_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature n_chunks",
    "op9_language_evidence": "page_id host declared text_lang lang posterior accepted",
    "op12_harmonic_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op13_spelling_variants": "word form root n n_near form_n",
    "op10_kd_shards": "doc_id size text_crc32 law shard slot grown_shard",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "clicks", "sales", "sale_lines"):
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def shown(v):
    return repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) and not math.isnan(v) else str(v)


@pytest.mark.parametrize("name", sorted(corpus.SQL))
def test_query_agrees_with_sql(spark, duck, name):
    df = corpus.queries()[name](spark, DATA)
    cursor = duck.execute(corpus.SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(shown(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall())
    assert sorted(tuple(shown(r[c]) for c in sorted(names)) for r in df.collect()) == want


def test_every_operator_has_one_query():
    assert sorted(n.split("_")[0] for n in corpus.queries() if n.startswith("op")) == sorted(f"op{k}" for k in range(1, 14))
    assert set(COLUMNS) | set(corpus.SQL) == set(corpus.queries())


@pytest.mark.parametrize("name", sorted(set(COLUMNS) - {"op13_spelling_variants"}))
def test_query_without_sql_has_its_columns_and_a_row_for_each_document(spark, name):
    df = corpus.queries()[name](spark, DATA)
    assert df.columns == COLUMNS[name].split()
    rows = df.collect()
    ids = {r[0] for r in rows}
    table = spark.read.parquet(f"{DATA}/{'pages' if name.startswith('op9') else 'documents'}.parquet")
    assert ids == {r[0] for r in table.select(df.columns[0]).collect()}
    if name not in ("op7_best_fit_packing", "op12_harmonic_packing"):
        assert len(rows) == len(ids)
