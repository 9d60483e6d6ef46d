"""Text, query and segmentation functions on examples."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.functions import query as qy
from vellum.functions import segments
from vellum.functions import replies
from vellum.functions import text as tx


@pytest.fixture(scope="module")
def value(spark):
    def run(make, *texts):
        names = [f"c{i}" for i in range(len(texts))]
        df = spark.createDataFrame([tuple(texts)], ", ".join(f"{n} string" for n in names))
        return df.select(make(*(F.col(n) for n in names)).alias("v")).first()["v"]

    return run


def test_watermarks(value):
    run = lambda t: value(tx.without_watermarks, t)
    assert run("a\nDownloaded from https://x.org by U user on 12 December 2024\nb") == "a\nb"
    assert run("the cell Downloaded from https://x.org by U user on 3 May 2020\n\ndivides") == "the cell divides"
    assert run("table  with   spaces\n\n\n\nkept") == "table  with   spaces\n\n\n\nkept"


def test_hyphens_and_preprocessing(value):
    assert value(tx.rejoined, "es- tablishing and pri-\nmarily, well- being, T- cell, state-of-the-art") == "establishing and primarily, well- being, T- cell, state-of-the-art"
    assert value(tx.preprocessed, "  a\tb\r\nc  d\x07\n\n\n\n\n\ne\rf  ") == "a b\nc d\n\n\ne\nf"


def test_truncation_and_tokens(value):
    assert value(lambda c: tx.truncated(c, 5), "你好世界再见") == "你好..."
    assert value(lambda c: tx.truncated(c, 3), "abcdef") == "abc" and value(lambda c: tx.truncated(c, 6), "abcdef") == "abcdef"
    assert value(tx.estimated_tokens, "你好 world!") == 2 + 2
    assert value(tx.estimated_words, "你好世界再见") == 1 + 3 and value(tx.estimated_words, "two words") == 2


def test_quality(value):
    good = "This is a sentence of a paper with words.\nAnd here is one more line of it, long enough."
    assert value(lambda c: tx.quality(c)["score"], good) == 100
    assert value(lambda c: tx.quality(c)["action"], good) == "index"
    assert value(lambda c: tx.quality(c)["issues"], "?? !!") == ["too_short", "too_few_words", "too_few_lines", "low_alphanumeric_ratio"]
    assert value(lambda c: tx.quality(c)["action"], "?? !!") == "reject"
    assert value(lambda c: tx.quality(c)["score"], "") == 0


def test_names_lists_and_labels(value, spark):
    df = spark.createDataFrame([([" A ", "a", "", "NULL", "b"],)], "x array<string>")
    assert df.select(tx.deduplicated(F.col("x"))).first()[0] == ["A", "b"]
    assert value(tx.string_or_array, "a, b,,c") == ["a", "b", "c"] and value(tx.string_or_array, "a; b") == ["a", "b"]
    assert value(tx.stripped_figure_prefix, "Figure 3a: Loss curves") == "Loss curves" and value(tx.stripped_figure_prefix, "Fig. 12. X") == "X"
    assert value(tx.caption_needle, "Figure 1. " + "word " * 60).count("word") == 26
    assert value(tx.containment, "loss curves of training", "figure 1 loss curves of training runs") == 1.0
    assert value(tx.containment, "two words", "no such") == 0.0
    assert value(tx.safe_file_name, 'a/b:c*"x" y') == "a_b_c__x__y" and value(tx.csv_field, 'a "b", c') == '"a ""b"", c"'
    assert [value(tx.valid_partial_date, d) for d in ("2024", "2024-02", "2024-13", "2024-02-30", "2024-02-29", "24")] == [True, True, False, False, True, False]
    assert value(tx.publication_year, "2023-05") == 2023 and value(tx.publication_year, "n.d.") is None
    assert value(tx.safe_paper_id, "../x") is False and value(tx.safe_paper_id, "p-1_a.b") is True


def test_split_words(value):
    assert [value(tx.artifacts_likely, t) for t in ("it lev erages the", "p value of n = 30", "the cat sat", "a sm all gap", "x y")] == [True, False, False, False, True]
    assert [value(tx.heading_split_likely, t) for t in ("A novel method", "inter pretable", "lev erages", "Results", "a deep network", "Deep learning of rna networks")] == [False, True, True, False, False, False]
    assert value(tx.same_but_spaces, "lev erages x", "leverages x") is True


def test_model_replies(value):
    cases = {
        'Sure:\n```json\n{"a": [1, 2,],}\n```': '{"a":[1,2]}', 'x {"a": 1} y': '{"a":1}', "none": None, 'note [1] then {"a": 1} end': '{"a":1}', '{"a": "x, ]y"}': '{"a":"x, ]y"}',
        'some {"x": 1} extra {"y": {"z": 2}} text': '{"y":{"z":2}}', "[1, 2, 3,]": "[1,2,3]", '{"items": [{"a": 1,},],}': '{"items":[{"a":1}]}', '```\n[]\n```\n```json\n{"t": "a, }",}\n```': '{"t":"a, }"}', "": None, '{"a": "{[", "b": 2,} and more': '{"a":"{[","b":2}',
    }
    for text, want in cases.items():
        assert value(replies.json_reply, text) == want, text
    assert value(replies.json_reply, None) is None


def test_reply_metadata(value):
    text = '{"title": " T ", "authors": ["A", "A", " null ", 3, "B"], "genes": ["OsALS", "osals", null, 1, " ", "TP53"], "species": "rice", "year": 2021, "doi": "null", "corresponding_author": "X; Y", "methodology": " m ", "abstract": "", "figures": [{"label": "1", "caption": "c"}, {"label": "2"}, 5], }'
    got = value(replies.reply_metadata, text)
    assert (got.title, got.authors, got.genes, got.species, got.published_date, got.doi, got.corresponding_author) == ("T", ["A", "B"], ["OsALS", "TP53"], [], "2021", None, ["X", "Y"])
    assert [(s.section_type, s.content) for s in got.sections] == [("methodology", "m")] and [tuple(f) for f in got.figures] == [("1", "c")]
    assert value(replies.reply_metadata, "no reply").json is None


def test_front_matter(value):
    got = value(replies.front_matter, "\ufeff---\ntitle: \"A: b\"\nauthors:\n  - Ann\n  - Bob\ntags: [x, y]\ndate: 2020-01-02\nnested:\n  a: {b: 1}\n---\nBody\n")
    assert (got.title, got.authors, got.keywords, got.published_date, got.body) == ("A: b", ["Ann", "Bob"], ["x", "y"], "2020-01-02", "Body") and '"b": "1"' in got.json
    bad = value(replies.front_matter, "---\ntitle: [\n---\nBody")
    assert (bad.title, bad.authors, bad.body) == (None, [], "Body")
    assert value(replies.front_matter, "plain --- text").body == "plain --- text" and value(replies.front_matter, None).body == ""


def test_front_matter_sends_no_body_to_python(spark, monkeypatch):
    seen, whites = [], "".join(c for c in map(chr, range(0x3001)) if not c.strip())
    monkeypatch.setattr(replies.F, "pandas_udf", lambda t: lambda f: (lambda c: seen.append(c) or F.struct(*(F.lit(None).cast("string").alias(n.split()[0]) for n in replies._names(t)))))
    texts = [f"---\ntitle: a\n---\n{whites}é body\n---\n{whites}", "---\n---\nx", "---\n\n---", "---\nopen", " ---\na\n---\nb "]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = df.select(replies.front_matter(F.col("text"))["body"].alias("body")).collect()
    assert [r.body for r in got] == ["é body\n---", *texts[1:2], "", *texts[3:]]
    assert [r.block for r in df.select(seen[0].alias("block")).collect()] == ["title: a", None, "", None, None]


def test_images_and_labels(value):
    assert [value(tx.sanitised_label, x) for x in ("Fig. 1(a)", "__x__y", "S-2", "é")] == ["Fig_1_a", "x_y", "S-2", ""]
    images = value(lambda c: tx.markdown_images(c, F.lit("p")), "![a](b.png) x ![](c.png)")
    assert [tuple(x) for x in images] == [("p_fig1", "a", "b.png"), ("p_fig2", "", "c.png")]


def test_sanitised_queries():
    s = lambda q: qy.sanitise(q).sanitised
    assert s("the of AND") == "" and s('"deep" learning') == "deep learning" and s("-x (crispr), gene~") == "x crispr gene"
    assert s("one two three four") == "one OR two OR three OR four"
    assert s("alpha bb ccc dddd eeeee ffffff ggggggg") == "ggggggg AND ffffff AND alpha AND eeeee"


@pytest.mark.parametrize(("text", "kind"), [("deep learning", "simple"), ("how does a transformer compare between recurrent and other models", "complex"), ("how does attention work in deep models", "normal"), ("你好世界", "simple")])
def test_profiles_agree(value, text, kind):
    assert value(lambda c: qy.profile_columns(c)["complexity"], text) == kind == qy.Profile.of(text).complexity
    assert value(lambda c: qy.profile_columns(c)["word_count"], text) == qy.Profile.of(text).word_count


def test_heading_tree():
    got = segments.heading_tree("intro\n# One\n\ntext\nmore\n## Two\n| a |\n| b |\n### Deep\nx\n#no heading\n## Three\n")
    assert [(x["name"], x["parent"], x["chunk_type"], x["path"], x["depth"]) for x in got] == [
        ("p1", None, "paragraph", "", 0), ("s1", None, "chapter", "One", 0), ("p2", "s1", "paragraph", "One", 1), ("s2", "s1", "section", "One > Two", 1), ("t3", "s2", "table", "One > Two", 2),
        ("s4", "s2", "section", "One > Two > Deep", 2), ("p3", "s2", "paragraph", "One > Two", 2), ("s5", "s1", "section", "One > Three", 1),
    ]
    assert segments.heading_tree("") == [] and got[2]["content"] == "text\nmore"


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=400), st.integers(1, 60))
def test_extraction_windows_lose_nothing(text, most):
    parts = segments.extraction_windows(text, most)
    assert all(len(p) <= most for p in parts)
    assert "".join("".join(parts).split()) == "".join(text.split())


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=500), st.integers(5, 50), st.integers(0, 4))
def test_windows_cover_the_text(text, size, overlap):
    parts = segments.windows(text, size, overlap)
    assert all(len(p) <= size + segments.REACH for p in parts)
    seen = "".join(parts)
    assert set(text.split()) <= set((seen + " " + text).split()) and (not text.strip() or parts)


def test_windows_end_with_sentences():
    text = "A" * 20 + ". " + "B" * 40
    assert segments.windows(text, 15, 3)[0] == "A" * 20 + "."
    assert segments.batches([1000, 1000, 1000, 3000, 10], 2500, 3) == [0, 0, 1, 2, -1]
    with pytest.raises(ValueError):
        segments.windows("x", 5, 5)
