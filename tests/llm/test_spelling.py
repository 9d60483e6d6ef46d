"""Spelling variants against brute force: words, near words, forms and roots."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import queries as corpus
from vellum.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    out = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def one_edit(words):
    """Pairs exactly one edit apart, by deletion neighbourhoods and checking."""
    by = defaultdict(set)
    for w in words:
        for k in range(len(w)):
            by[w[:k] + "*" + w[k + 1 :]].add(w)
            by[w[:k] + w[k + 1 :]].add(w)
        by[w].add(w)
    near = defaultdict(set)
    for key, ws in by.items():
        for u in ws:
            for v in ws:
                if u != v and ("*" in key or key in (u, v)):
                    near[u].add(v)
    return near


def expected(rows):
    n = counted(rows)
    near, form = one_edit(n), {}
    for w, c in n.items():
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * c else None
    out = {}
    for w, c in n.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, c, len(near[w]), n[form[w]] if form[w] else None)
    return out


def shown(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: tuple(r)[1:] for r in rows}


def test_the_whole_table_agrees_with_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = expected([(r.doc_id, r.text) for r in docs.collect()])
    got = shown(corpus.queries()["op13_spelling_variants"](spark, "/root/testdata/sf0.001"))
    assert got == want and any(x[0] for x in want.values())


def test_hot_prefixes_chains_and_awkward_rows(spark):
    r = random.Random(3)
    words = ["aaaaa", "aaaaaa", "aaaaaaa", "aaaab", "baaaa", "abaaa", "zzézz", "zzÉzz", "zz÷zz", "x" * 300, "x" * 299 + "y"]
    words += ["".join(r.choice("abé") for _ in range(r.randrange(5, 8))) for _ in range(300)]
    rows = [(i if i % 3 else None, " ".join(f"{w}{r.choice([' ', ', ', '1', '*', chr(0x100)])}" for w in r.choices(words, [1 + k % 17 for k in range(len(words))], k=60))) for i in range(80)]
    rows += [(1, None), (2, ""), (3, " 12 "), (7, "Same SAME samE"), (7, "Same SAME samE"), (8, "abcdefghij " * 9000)]
    df = spark.createDataFrame([(*x, "w") for x in rows], "doc_id long, text string, word string").withColumn("n", F.lit(1))
    assert shown(spelling.variants(df)) == expected(rows)
    assert spelling.variants(df.where("doc_id < 0")).count() == 0
    with pytest.raises(ValueError, match="circles"):
        spelling.variants(df, ratio=1)


def test_merges_are_few_and_no_pair_is_lost(spark):
    r = random.Random(4)
    words = {"stem" + "".join(r.choice("abcdef") for _ in range(4)) for _ in range(900)}
    df = spark.createDataFrame([(w,) for w in words], "word string")
    light = spelling.edges_per_word(df).collect()
    assert max(x.n_light for x in light) <= np.log2(len(words) + 1)
    near = one_edit(words)
    got = spelling.near_words(df).collect()
    assert {(x.word, x.near) for x in got} == {(w, x) for w in words for x in near[w]} and len(got) == sum(map(len, near.values()))


def test_crc_of_joined_strings():
    left, right = [b"", b"12:", b"999999:"], [b"", b"a", b"\xc3\xa9t", b"longer words " * 9]
    a, b, n, want = zip(*((zlib.crc32(x), zlib.crc32(y), len(y), zlib.crc32(x + y)) for x in left for y in right), strict=True)
    assert spelling.crc_joined(np.asarray(a, np.uint32), np.asarray(b, np.uint32), np.asarray(n)).tolist() == list(want)


def test_groups_of_variants(spark):
    found = spark.createDataFrame([("colour", None, "colour", 9), ("color", "colour", "colour", 4), ("other", None, "other", 3)], "word string, form string, root string, n long")
    assert [tuple(x) for x in spelling.spelling_groups(found).collect()] == [("colour", 2, 13)]
