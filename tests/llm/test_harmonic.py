"""Harmonic packing: every id once, full sequences, whole documents for the most part."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vellum.llm import harmonic


def checked(rows, texts, capacity=4096):
    """Rows against the tokenizer itself; texts: (id, text) rows, an id for each."""
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: np.asarray([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for i, x in texts}
    seqs, parts = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = want[r.doc_id]
        assert r.doc_tokens == len(ids) and r.length > 0
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        parts[r.doc_id].append((r.start, r.length))
        seqs[r.sequence_id].append((r.offset, r.length))
    for groups, sizes in ((parts, {i: len(x) for i, x in want.items()}), (seqs, None)):
        for key, x in groups.items():
            at = 0
            for start, n in sorted(x):
                assert start == at
                at += n
            assert at == sizes[key] if sizes else at <= capacity and at & (at - 1) == 0
    assert set(parts) == set(want)
    return parts, seqs


def test_ids_are_the_tokenizers_and_no_sequence_is_padded(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3).select("doc_id", "text", F.lit(1).alias("length"), F.lit("x").alias("id"))
    parts, seqs = checked(harmonic.harmonic_pack(rows).collect(), [(r.doc_id, r.text) for r in rows.collect()])
    assert sum(map(len, parts.values())) < len(parts) + 1.5 * len(seqs)


def test_awkward_rows(spark):
    texts = [None, "", " \n", "one", "One  ONE", "x" * 9000, "a<|endoftext|>b don't", "é à \u0085  z é 9876", "word " * 9000, "end " * 4095, "end " * 4096]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    checked(harmonic.harmonic_pack(df).collect(), list(enumerate(texts)))
    assert harmonic.harmonic_pack(df.where("doc_id < 0")).count() == 0
    twice = harmonic.harmonic_pack(spark.createDataFrame([(1, "a b c")] * 5 + [(None, "d")], "doc_id long, text string")).collect()
    assert sum(r.length for r in twice) == 5 * 4 + 2
    with pytest.raises(ValueError, match="power of two"):
        harmonic.harmonic_pack(df, capacity=1000)


def test_class_bins_hold_k_items_before_the_gaps_are_filled():
    p = harmonic.Packer(64, 0)
    item = lambda n, i: (i, 0, bytes(4 * n), n)
    p.add([item(n, i) for i, n in enumerate([40, 33, 30, 25, 20, 20, 17, 17, 16, 16, 16, 16])])
    p.finish()
    bins = defaultdict(list)
    for r in p.rows:
        bins[r[5]].append(r)
    assert sum(r[2] for r in p.rows) == 266
    assert all(sum(r[2] for r in b) in (64, 32, 16, 8, 4, 2, 1) for b in bins.values())


def test_a_long_run_of_items_keeps_few_bins_open():
    p, rng = harmonic.Packer(4096, 0), np.random.default_rng(1)
    total = 0
    for _ in range(20):
        sizes = np.minimum(rng.lognormal(5.5, 1.2, 500).astype(int) + 1, 4095).tolist()
        p.add([(0, 0, bytes(4 * n), n) for n in sizes])
        total += sum(sizes)
        assert len(p.bins) <= harmonic.WAITING + 1 and len(p.open) <= harmonic.CLASSES + 1
    cut = len(p.rows) + sum(map(len, p.bins.values())) + sum(map(len, p.open.values()))
    assert cut < 20 * 500 * 1.1
    p.finish()
    assert sum(r[2] for r in p.rows) == total
