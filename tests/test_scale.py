"""What grows with the tables: no result is cut, and no step makes more rows than it needs."""

import random

from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.functions.query import sanitise
from vellum.operators import blockindex, fulltext, graph, listing, retrieval
from vellum.plans import library as lib
from vellum.plans import queries as library
from vellum.sources import figurepages


def test_all_of_twice_a_thousand_hits_are_boosted(spark, tmp_path):
    d = spark.range(1200).select(F.col("id").alias("doc_id"), F.lit("erth and so on\nwords of it").alias("text"), F.lit("en").alias("lang"), F.lit("src").alias("source"), F.lit(1).alias("n_chars"))
    d.write.parquet(f"{tmp_path}/documents.parquet")
    assert library.QUERIES["search_papers_boosted"](spark, str(tmp_path)).count() == 1200


def test_an_unwritten_index_is_scanned_without_postings(spark, monkeypatch):
    written, real = [], fulltext.staged
    monkeypatch.setattr(fulltext, "staged", lambda df, name: written.append(real(df, name)) or written[-1])
    df = spark.createDataFrame([(i, " ".join(f"w{k % 7}" for k in range(i))) for i in range(1, 60)], "id int, t string")
    got = fulltext.bm25(fulltext.build(df, ["t"]), sanitise("w3 w6"))
    assert got.count() == 56 and [x.count() for x in written] == [59]


def test_blocks_are_written_once_and_list_their_documents(spark):
    df = spark.createDataFrame([(i, f"a b{i} a"[: 3 * i]) for i in range(40)], "id int, t string")
    index = blockindex.build(df, ["t"], band=8)
    assert index.blocks.inputFiles() and index.sizes.first().n_docs == 39
    assert index.blocks.where("term = 'a'").agg(F.sum("n")).first()[0] == 39
    assert blockindex.frequencies(index).where("term = ''").isEmpty()
    less = blockindex.deleted(index, spark.createDataFrame([(7,), (99,)], "id int"))
    assert [tuple(r) for r in less.gone.collect()] == [(0, 7)] and blockindex.frequencies(less).where("term = 'b7'").isEmpty()


def test_pairs_are_weighed_where_they_meet(spark, monkeypatch):
    monkeypatch.setattr(graph, "PART", 5)
    made = [(f"p{i:02}", [f"k{i % 3}", f"m{i % 11}"], [f"k{i % 3}"], ["e1", f"e{2 + i % 2}"]) for i in range(66)]
    classes = spark.createDataFrame(made, "id string, kw array<string>, tok array<string>, ent array<string>")
    found = graph.related(classes, 0.55)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Aggregate" not in plan
    a, b = classes.alias("a"), classes.alias("b")
    want = a.join(b, F.col("a.id") < F.col("b.id")).select("a.id", "b.id", F.round(graph.similarity("a", "b"), 9).alias("w")).where("w >= 0.55")
    assert sorted((r[0], r[1], round(r[2], 9)) for r in found.collect()) == sorted(tuple(r) for r in want.collect())


def test_frequent_words_are_met_within_an_entity(spark, monkeypatch):
    seen, real = {}, graph.staged
    monkeypatch.setattr(graph, "staged", lambda df, name: seen.setdefault(name, real(df, name)))
    # all papers share a word and an entity; pairs of the same two entities alone weigh enough
    made = [(f"p{i:02}", [f"own{i}", "common"], [f"own{i}", "common"], ["e", f"e{i % 20}"]) for i in range(60)]
    classes = spark.createDataFrame(made, "id string, kw array<string>, tok array<string>, ent array<string>")
    found = graph.related(classes, 0.55)
    assert found.count() == 20 * 3
    groups = seen["graph-keys"].select(F.explode("keys").alias("x")).groupBy("x.e", "x.w").count()
    assert groups.agg(F.sum(F.expr("count * (count - 1) div 2"))).first()[0] == 20 * 3
    # what a pair shares is found once, not for each use of it
    assert found._jdf.queryExecution().optimizedPlan().toString().count("array_intersect") == 3


def test_related_papers_of_phrases_and_fillers_lose_no_pair(spark):
    r = random.Random(11)
    word = lambda: r.choice(["data", "model", "of", "12", *(f"w{k}x" for k in range(5)), "w1xs", "w2xs"])
    made = [(f"p{i:03}", [" ".join(word() for _ in range(r.randrange(1, 3))) for _ in range(r.randrange(5))]) for i in range(150)]
    p = spark.createDataFrame(made, "id string, keywords array<string>")
    e = spark.createDataFrame([(i, "gene", f"g{r.randrange(5)}") for i, _ in made for _ in range(r.randrange(4))], "paper_id string, kind string, value string")
    classes = graph.feature_classes(graph.features(p, e)).persist()
    every = classes.alias("a").join(classes.alias("b"), F.col("a.id") < F.col("b.id")).select("a.id", "b.id", F.round(graph.similarity("a", "b"), 9).alias("w")).collect()
    for least in (0.3, 0.55, 0.8):
        got = sorted((x.source, x.target, round(x.weight, 9)) for x in graph.related(classes, least).collect())
        assert got == sorted(tuple(x) for x in every if x.w >= least) and got


def test_a_captions_bytes_are_summed_once(spark):
    r = random.Random(3)
    made = [("".join(r.choice(["Figure 2. ", ""])) + " ".join("".join(r.choice("abé一😀") for _ in range(r.randrange(1, 40))) for _ in range(r.randrange(9))),) for _ in range(80)]
    made += [("a" * k + " b",) for k in range(124, 133)] + [("a " * 200,), ("",)]

    def needle(caption):
        upto, kept = 0, []
        for w in caption.removeprefix("Figure 2. ").split():
            upto += len(w.encode()) + 1
            if upto > 130:
                break
            kept.append(w)
        return " ".join(x for x in ("".join(c for c in w if c.isalnum()) for w in kept) if x)

    got = spark.createDataFrame(made, "c string").select("c", tx.caption_needle(F.col("c")).alias("n"))
    assert [x.n for x in got.collect()] == [needle(c) for (c,) in made]
    # no sum for each word
    assert "filter(" not in got._jdf.queryExecution().analyzed().toString()


def test_no_page_is_shuffled_to_index_it(spark):
    pages = spark.createDataFrame([("d", 1, "Figure 1. one two three four", 0), ("d", 2, None, 1)], "doc_id string, page int, text string, n_images int")
    index = figurepages.page_index(pages)
    assert "Join" not in index._jdf.queryExecution().optimizedPlan().toString() and index.count() == 2


def test_a_cap_is_decided_in_blocks_of_the_order(spark, monkeypatch):
    r, seen, real = random.Random(5), [], graph.staged
    monkeypatch.setattr(graph, "staged", lambda df, name: seen.append(name) or real(df, name))
    # all of 24 papers alike, of which each round of what can be decided at once would decide four
    made = {(f"p{a:02}", f"p{b:02}"): 1.0 for a in range(24) for b in range(a + 1, 24)}
    made |= {tuple(sorted((f"p{r.randrange(24):02}", f"q{r.randrange(40):02}"))): r.randrange(4) / 2 for _ in range(200)}
    edges, cap = sorted((a, b, w, [a]) for (a, b), w in made.items()), 3
    df = spark.createDataFrame(edges, "source string, target string, weight double, shared array<string>")
    n, want = {}, []
    for a, b, w, x in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if n.get(a, 0) < cap and n.get(b, 0) < cap:
            n[a], n[b] = n.get(a, 0) + 1, n.get(b, 0) + 1
            want.append((a, b, w, x))
    assert sorted(tuple(x) for x in graph.capped(df, cap).collect()) == sorted(want)
    assert seen == ["graph-edges", "graph-kept"]
    monkeypatch.setattr(graph, "BLOCK", 100)
    assert sorted(tuple(x) for x in graph.capped(df, cap).collect()) == sorted(want)
    assert seen.count("graph-kept") > 2 and graph.capped(df.limit(0), cap).isEmpty()


def test_a_text_is_not_made_anew_for_each_of_a_needles_ngrams(spark):
    df = spark.createDataFrame([("one two three", "X One Two Three"), ("one two three", "none "), ("ab", "xABy"), (None, "a"), ("one two three", None)], "n string, h string")
    got = df.select(tx.containment(F.col("n"), F.lower("h")).alias("c"))
    assert [r.c for r in got.collect()] == [1.0, 0.1, 1.0, 0.0, 0.0]
    assert got._jdf.queryExecution().analyzed().toString().count("lower(h") == 1


def test_only_paths_that_contain_a_term_are_tokenised(spark):
    df = spark.createDataFrame([("p1", "Erth > A"), ("p2", "xerthx"), ("p3", "ention, erth"), ("p4", None)], "paper_id string, path string")
    got = fulltext.path_overlap(df, "erth ention", 9)
    assert [tuple(r) for r in got.collect()] == [("p3", 1.0), ("p1", 0.5)]
    assert "contains(lower(path" in got._jdf.queryExecution().analyzed().toString().lower().split("array_contains")[0].split("filter")[-1]


def test_terms_are_counted_as_they_are_taken_out(spark, monkeypatch):
    monkeypatch.setattr(fulltext, "STEP", 9)
    texts = ["a ab a", "", "ba\na", "éa a é", "ɏa ɐa ɀa aɁb", "×a a÷", "一a 二a", "a", "aab", None, "Ab AB\U0001f600ab", "a" * 40, "é", "ab-ab_ab.É"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    low, terms = F.lower(F.coalesce("t", F.lit(""))), ["a", "ab", "é", "aa"]
    for r in df.select("i", fulltext.term_counts(low, terms).alias("got"), fulltext.terms_of(F.col("t")).alias("words")).collect():
        assert r.got == [len(r.words), *(r.words.count(t) for t in terms)], texts[r.i]


def test_no_text_is_shuffled_to_count_terms(spark, monkeypatch):
    seen, real = [], fulltext.staged
    monkeypatch.setattr(fulltext, "staged", lambda df, name: seen.append(df) or real(df, name))
    df = spark.createDataFrame([(1, "erth and ention"), (2, "erth"), (3, "none")], "id int, t string")
    assert sorted(r.doc_id for r in fulltext.bm25(fulltext.build(df, ["t"]), sanitise("erth ention")).collect()) == [1, 2]
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan and "regexp_extract_all" not in plan


def test_few_hits_go_to_the_table_they_are_joined_with(spark):
    df = spark.createDataFrame([(f"c{i}", f"p{i % 3}", None if i < 3 else f"c{i % 3}", f"erth w{i}", i) for i in range(9)], "id string, paper_id string, parent_id string, content string, seq int")
    index = fulltext.build(df, ["content"])
    joined = fulltext.search_chunks(index, df, "erth", 4)
    assert "leftHint=(strategy=broadcast)" in joined._jdf.queryExecution().optimizedPlan().toString()
    assert [r.doc_id for r in joined.collect()] == ["c0", "c1", "c2", "c3"]


def test_contexts_read_the_chunks_of_their_papers_alone(spark, monkeypatch):
    made = [(f"c{i}", f"p{i % 3}", None if i < 3 else f"c{i - 3}", f"erth w{i}", i, None) for i in range(12)]
    chunks = spark.createDataFrame(made, "id string, paper_id string, parent_id string, content string, seq int, page_number int")
    figures = spark.createDataFrame([], "id string, paper_id string, caption string, description string, page_number int")
    seen, real = [], listing.heading_paths
    monkeypatch.setattr(listing, "heading_paths", lambda c, ids: seen.append(c) or real(c, ids))
    hits = spark.createDataFrame([("c7", 2.0), ("c10", 1.0), ("c8", 0.5)], "doc_id string, score double")
    got = retrieval.chunk_contexts(hits, chunks, figures, spark.createDataFrame([("p1",), ("p2",)], "id string")).collect()
    assert [(r.id, r.heading_path) for r in got] == [("c7", "erth w1 > erth w4"), ("c10", "erth w1 > erth w4 > erth w7"), ("c8", "erth w2 > erth w5")]
    assert seen[0].inputFiles() and sorted(r.id for r in seen[0].collect()) == sorted(f"c{i}" for i in range(12) if i % 3)


def test_a_path_search_without_a_term_finds_nothing(spark):
    df = spark.createDataFrame([("p1", "中文"), ("p2", "Erth")], "paper_id string, path string")
    assert fulltext.path_overlap(df, "中文", 9).isEmpty()


def test_first_lines_are_cut_off_before_texts_are_split(spark, tmp_path):
    texts = {1: "one\ntwo\nthree", 2: "only", 3: "", 5: "\n\nx", 6: "a\n", 7: None}
    spark.createDataFrame([(i, t, "en", "src") for i, t in texts.items()], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    p = lib.papers(spark, str(tmp_path)).select("doc_id", "title", "abstract_text")
    assert "split_part(text" not in p._jdf.queryExecution().analyzed().toString()
    assert {r[0]: (r[1], r[2]) for r in p.collect()} == {1: ("one", "two"), 2: ("only", ""), 3: ("", ""), 5: ("", ""), 6: ("a", ""), 7: (None, None)}
