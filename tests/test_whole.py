"""Queries that read the whole of every text, against brute force."""

import hashlib

import pytest
from pyspark.sql import functions as F

from vellum.operators import fulltext, fusion, vector
from vellum.plans import library as lib
from vellum.plans import queries as library

TEXTS = {8: "t8\nab\ncd\nef\n\ngh", 9: "t9\nij\nkl\nlast line", 10: "t10", 11: "", 12: "t12\nmn\nop\n"}


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in TEXTS.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return d


def parts(text):
    return list(zip(("abstract", "methods", "results"), text.split("\n", 2)))


def test_sections_hold_all_lines_of_all_documents(spark, data):
    got = sorted(tuple(r) for r in lib.sections(spark, data).collect())
    assert got == sorted((i * 3 + k, str(i), *x) for i, t in TEXTS.items() for k, x in enumerate(parts(t)))


def test_exports_hold_whole_texts(spark, data):
    for r in library.QUERIES["export_section_records"](spark, data).collect():
        want = [(s, c, hashlib.sha256(c.encode()).hexdigest()) for s, c in parts(TEXTS[int(r.paper_id)])]
        assert [tuple(x) for x in r.sections] == want
        assert "\n".join(x.content for x in r.sections) == TEXTS[int(r.paper_id)]
    got = [r.value for r in library.QUERIES["export_markdown"](spark, data).collect()]
    for t in TEXTS.values():
        body = "".join(f"## {s}\n\n{c}\n\n" for s, c in parts(t) if c)
        assert any(v.endswith(body) for v in got)


def test_documents_are_embedded_whole(spark, data, monkeypatch):
    seen, real = [], vector.embedded
    monkeypatch.setattr(vector, "embedded", lambda *a, **b: seen.append(real(*a, **b)) or seen[-1])
    assert library.QUERIES["embed_documents"](spark, data).count() == len(TEXTS)
    got = {int(r.id): list(r.vector) for r in seen[0].collect()}
    assert got == {i: vector.embed_words([t])[0] for i, t in TEXTS.items()}


def test_hybrid_search_sees_every_line(spark, tmp_path):
    words = "erth and the ention of onthat"
    texts = {1: f"x\ny\nz\n{words}", 2: "erth\nb", 3: "erth ention\nq r s", 4: f"k l\nm\nn\no\nand the ention {words}"}
    spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    lines = [(f"{i}_{k}", str(i), "section", "paragraph", x, vector.embed_words([x])[0]) for i, t in texts.items() for k, x in enumerate(t.split("\n"))]
    own = spark.createDataFrame(lines, "id string, paper_id string, content_type string, section_type string, chunk_text string, vector array<float>")
    p, c = lib.papers(spark, str(tmp_path)), lib.chunks(spark, str(tmp_path)).withColumn("path", F.col("content"))
    want = fusion.hybrid_search(words, fulltext.build(p, ["title", "abstract_text", "keywords"]), p, c, own, k=10)
    got = library.QUERIES["hybrid_search"](spark, str(tmp_path))
    assert [(r.paper_id, r.score) for r in got.collect()] == [(r.paper_id, round(r.score, 6)) for r in want.collect()]


def test_many_queries_in_blocks_match_brute_force(spark, monkeypatch):
    for name, size in (("QUERY_BLOCK", 7), ("VECTOR_BLOCK", 11)):
        monkeypatch.setattr(vector, name, size)
    made = [(i, [float((i * 7) % 5 - 2), float((i * 3) % 4 - 1), float(i % 3 - 1)]) for i in range(60)]
    v = spark.createDataFrame(made, "id long, vector array<float>")
    q = v.where("id % 2 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    got = [(r.query_id, r["rank"], round(r.score, 9)) for r in vector.search_many(v, q, 5).collect()]

    def cosine(a, b):
        norm = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return sum(x * y for x, y in zip(a, b)) / norm if norm else 0.0

    want = [(i, n + 1, round(s, 9)) for i, a in made[::2] for n, s in enumerate(sorted((cosine(a, b) for _, b in made), reverse=True)[:5])]
    assert sorted(got) == sorted(want)


def test_more_queries_than_one_block_takes(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vector array<float>")
    q = spark.range(10_001).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.lit(0.5)).alias("query"))
    got = vector.search_many(v, q, 1)
    assert got.count() == 10_001 and got.where("id <> 1").isEmpty()
