"""Corpus operators against brute force on small tables with the awkward cases in them."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from vellum.llm import kdshard, mixing, neardup, packing, rules, substring
from vellum.llm._support import n_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    r = random.Random(5)
    vocab = [a + b for a in "the of an re sh ön é".split() for b in "a e io un té ß".split()]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    base, passage = say(120), say(60)
    near = base.split()
    out = [base, base, " ".join([*near[:50], "Zed", *near[51:]]), " ".join(near[:115]), None, "", "  \n\t ", "one", "ONE", "two words", "Two  words", passage, f"{say(30)} {passage} {say(30)}", f"{passage}\n{say(15)}", say(3000), "a b c d e " * 40, "x" * 5000, "w1 w2\x0bw3\x0cw4\rw5\tw6", "# $ % & | < > *\n#\n#\n\nline one\nline one\n", "a\x85b c d <|endoftext|> e"]
    out += [say(r.randrange(1, 300)) for _ in range(40)]
    out += [" ".join(x if r.random() > 0.02 else "new" for x in out[-k].split()) for k in range(1, 15)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 7 == 0 else f"s{i % 3}", "en", len(t or ""), 1.5, "x") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, size double, n_words string").repartition(3)


def empty(docs):
    return docs.where("doc_id < 0")


def words(t):
    return WORD.findall(t or "")


def test_ledger_matches_brute_force(docs):
    got = {r.doc_id: r for r in rules.apply_policy(rules.ledger(docs)).collect()}
    for i, t in enumerate(texts()):
        w = words(t)
        spans = defaultdict(list)
        for k in range(len(w) - 4):
            spans[tuple(w[k : k + 5])].append(k)
        repeated = {x + j for v in spans.values() if len(v) > 1 for x in v for j in range(5)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(repeated)), (i, t)
        assert bool(r.failures & rules.mask("base")) == (len(w) < 10 or 100 * len(repeated) > 20 * len(w))
        assert r.kept == (r.failures & rules.mask(rules.DEFAULT_POLICY) == 0)
    assert rules.ledger(empty(docs)).count() == 0


def test_ablations_count_from_bits(docs):
    led = rules.ledger(docs)
    bits = [r.failures & rules.mask("v1") for r in led.collect()]
    for r in rules.ablations(led, "v1").collect():
        b = 1 << rules.RULES[r.rule]
        assert (r.failed, r.only_this, r.kept_without) == (sum(x & b != 0 for x in bits), sum(x == b for x in bits), sum(x in (0, b) for x in bits))


def test_mix_reaches_targets(docs):
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    rows = mixing.mix(sized).collect()
    size = defaultdict(int)
    for r in sized.collect():
        size[r.source] += r.size
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, target = 1.5 * sum(size.values()), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in order if x not in target) for s in order if s not in target}
        over = [s for s in share if share[s] > 2 * size[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * size[s]
            left -= target[s]
    taken, by_id = Counter(), {r.doc_id: r.source for r in sized.collect()}
    for r in rows:
        s = by_id[r.doc_id]
        taken[s] += r.taken
        assert 0 <= r.taken <= 2 * r.size and r.source_size == size[s] and abs(r.target - target[s]) < 1e-6
    assert all(abs(taken[s] - target[s]) <= 1 for s in size)
    assert sorted(rows) == sorted(mixing.mix(sized).collect())
    assert mixing.mix(empty(sized)).count() == 0


def test_many_sources_are_joined_by_a_shuffle(docs, monkeypatch):
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    want = sorted(mixing.mix(sized).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(mixing.mix(sized).collect()) == want


def test_mix_splits_a_large_source(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 8)
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("a")).otherwise(F.lit("b")).alias("source"), (F.col("id") % 11).alias("size"))
    for r in mixing.mix(df).groupBy("target").agg(F.sum("taken").alias("t"), F.count(F.lit(1)).alias("n")).collect():
        assert abs(r.t - r.target) <= 1


def brute_components(ts):
    sets = []
    for t in ts:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = words(w)
        sets.append({tuple(w[k : k + 2]) for k in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set())
    root = list(range(len(ts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(ts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [len(s) for s in sets], [find(x) for x in range(len(ts))]


def test_near_duplicates_match_brute_force(docs):
    sizes, roots = brute_components(texts())
    rows = neardup.near_duplicates(docs, size=2).collect()
    assert len(rows) == len(sizes)
    for r in rows:
        assert (r.n_shingles, r.component_id, r.kept) == (sizes[r.doc_id], roots[r.doc_id], roots[r.doc_id] == r.doc_id)
    assert neardup.near_duplicates(empty(docs)).count() == 0


def copies(r, base, n, most):
    """Copies of a text, each with 0 to ``most`` of its words changed."""
    for _ in range(n):
        w = list(base)
        for k in r.sample(range(len(w)), r.randrange(most + 1)):
            w[k] = f"x{r.randrange(10**6)}"
        yield " ".join(w)


@pytest.mark.parametrize("limits", [(4, 8, 0), (32, 128, 32 << 20)])
def test_a_hot_group_of_near_copies_matches_brute_force(spark, monkeypatch, limits):
    for name, value in zip(("COLD", "STAR_ROWS", "BROADCAST_BYTES"), limits, strict=True):
        monkeypatch.setattr(neardup, name, value)
    r = random.Random(11)
    base = [f"w{r.randrange(4000)}" for _ in range(150)]
    # from all but equal to far apart, and a second text that shares a half with the first
    ts = [*copies(r, base, 160, 14), *copies(r, base[:75] + [f"v{k}" for k in range(60)], 40, 12), *(" ".join(f"u{r.randrange(9**5)}" for _ in range(90)) for _ in range(10))]
    r.shuffle(ts)
    met = []
    inner = neardup._by_difference
    monkeypatch.setattr(neardup, "_by_difference", lambda *a: met.append(1) or inner(*a))
    sizes, roots = brute_components(ts)
    assert len(set(roots)) > 20
    df = spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in neardup.near_duplicates(df, size=2).collect()}
    assert got == {k: (sizes[k], roots[k], roots[k] == k) for k in range(len(ts))}
    assert met


def test_the_difference_index_loses_no_link(spark):
    import numpy as np

    r = np.random.default_rng(2)
    for percent in (80, 90):
        centre = np.arange(100)
        # some share a block that the centre lacks: they may be linked with each other and not with it
        sets = [np.unique(np.concatenate([np.delete(centre, r.choice(100, r.integers(0, 10), replace=False)), r.integers(100, 400, r.integers(0, 6)), np.arange(400, 400 + r.choice([0, 12, 24]))])) for _ in range(150)]
        rows = []
        for k, x in enumerate(sets):
            d = np.setxor1d(x, centre)
            union = (len(x) + 100 + len(d)) // 2
            rows.append((k, -1, bool(100 * (union - len(d)) >= percent * union), len(x), 100, d.tolist()))
        # those that are linked to the centre lie in its component
        df = spark.createDataFrame([(x[0], -1 if x[2] else x[0], *x[1:]) for x in rows], "a long, root long, b long, linked boolean, na long, nb long, d array<long>")
        got = {(x.b, x.a) for x in neardup._by_difference(df, percent).collect()}
        want = set()
        for a, b in itertools.combinations(range(len(sets)), 2):
            n = len(np.intersect1d(sets[a], sets[b]))
            if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n) and not (rows[a][2] and rows[b][2]):
                want.add((a, b))
        assert want and want <= got and len(got) < 150 * 149 / 4


def test_a_second_cluster_in_a_bucket_is_not_met_with_itself(spark, monkeypatch):
    r, met = random.Random(9), []
    inner = neardup._by_difference
    monkeypatch.setattr(neardup, "_by_difference", lambda *a: met.append((out := inner(*a)).count()) or out)
    words_ = [f"w{k}" for k in range(300)]
    other = words_[:100] + [f"v{k}" for k in range(25)] + words_[125:]
    for copies in (50, 150):
        rows = []
        for base in (words_, other):
            for _ in range(copies):
                t = list(base)
                for k in r.sample(range(300), 3):
                    t[k] = f"x{r.random()}"
                rows.append(" ".join(t))
        got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), size=2).collect()
        assert {x.component_id for x in got} <= {0, copies}
    assert not met or met[-1] < 20 * 150, met


def test_null_and_repeated_ids_are_rows_of_their_own(spark):
    say = lambda c: " ".join(f"{c}{k}" for k in range(30))
    rows = [(None, say("a")), (None, say("b")), (3, say("b") + " more"), (5, say("c")), (5, say("d")), (6, say("c")), (6, say("c")), (7, None), (7, None), (8, ""), (None, say("e")), (None, say("e"))]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, n long")
    got = Counter((x.doc_id, x.component_id, x.kept) for x in neardup.near_duplicates(df).collect())
    assert got == Counter([(None, None, True), (None, 3, False), (3, 3, True), (5, 5, True), (5, 5, True), (6, 5, False), (6, 5, False), (7, 7, True), (7, 7, True), (8, 8, True), (None, None, True), (None, None, True)])
    left = Counter((x.doc_id, x.text) for x in neardup.drop_duplicates(df).collect())
    assert left == Counter([(None, say("a")), (3, say("b") + " more"), (5, say("c")), (5, say("d")), (7, None), (7, None), (8, ""), (None, say("e"))])


def test_components_of_a_long_path(spark):
    e = spark.range(60).select(((F.col("id") * 37) % 61).alias("a"), (((F.col("id") + 1) * 37) % 61).alias("b"))
    assert {r.root for r in neardup.components(e).collect()} == {0}


def brute_removed(ts, size):
    first = {}
    for i, t in enumerate(ts):
        w = words(t)
        for k in range(len(w) - size + 1):
            first.setdefault(tuple(w[k : k + size]), i)
    for i, t in enumerate(ts):
        w = words(t)
        gone = {k + j for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] < i for j in range(size)}
        yield len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()


@pytest.mark.parametrize("chunk, hot, rows", [(2000, 2, 7), (2000, 100_000, 10_000), (4 << 20, 100_000, 10_000)])
def test_repeats_match_brute_force(docs, monkeypatch, chunk, hot, rows):
    monkeypatch.setattr(substring, "LOCAL_BYTES", chunk)
    monkeypatch.setattr(substring, "HOT_ROWS", hot)
    inner = substring._met
    # batches of a few rows, so that a half goes on from one to the next
    monkeypatch.setattr(substring, "_met", lambda batches: inner(b.slice(k, rows) for b in batches for k in range(0, b.num_rows, rows)))
    rows = {r.doc_id: r for r in substring.remove_repeats(docs).collect()}
    for i, want in enumerate(brute_removed(texts(), 13)):
        assert (rows[i].n_words, rows[i].n_removed, rows[i].kept_sha256) == want, i
    assert substring.remove_repeats(empty(docs)).count() == 0


def test_windows_under_one_half_compare_by_64_bits(spark):
    ts = ["w168 w60 w255 w227 w78 w211 w61 w263 w29 w296 w63 w203 w238", "w168 w60 w255 w227 w78 w211 w61 w229 w154 w88 w243 w262 w69"]
    _, _, full, half = substring.windows([t.encode() for t in ts], 13)
    assert half[0] == half[1] and full[0] >> 32 == full[1] >> 32 and full[0] != full[1]
    df = spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string")
    assert [r.n_removed for r in substring.remove_repeats(df).collect()] == [0, 0]


def test_a_phrase_of_many_documents_is_no_repeat(spark, monkeypatch):
    monkeypatch.setattr(substring, "HOT_ROWS", 50)
    r = random.Random(3)
    phrase = " ".join(f"p{k}" for k in range(7))
    ts = [" ".join([*(f"a{r.randrange(10**9)}" for _ in range(9)), phrase, *(f"b{r.randrange(10**9)}" for _ in range(9))]) for _ in range(3000)]
    ts += [f"{ts[5]} end", f"begin {ts[5]}", None]
    rows = [(None if k % 3 == 0 else k, t) for k, t in enumerate(ts)]
    got = {r.doc_id: r.n_removed for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect() if r.doc_id}
    # documents 5, 3000 (no id) and 3001 hold one text of 25 words
    assert {k: n for k, n in got.items() if n} == {3001: 25}


def test_repeat_lengths_double_until_none_survives(docs):
    got = {r.length: r.windows for r in substring.repeat_lengths(docs).collect()}
    length = 13
    while True:
        held = defaultdict(set)
        places = Counter()
        for i, t in enumerate(texts()):
            w = words(t)
            for k in range(len(w) - length + 1):
                held[tuple(w[k : k + length])].add(i)
                places[tuple(w[k : k + length])] += 1
        n = sum(places[x] for x, d in held.items() if len(d) > 1)
        assert got.get(length, 0) == n
        if not n:
            break
        length *= 2


def test_pieces_are_the_tokenizers_ids(docs):
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(packing.pieces(docs)).collect()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for i, text in enumerate(texts()):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        got = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in got] == list(range(-(-len(ids) // 1024)))
        assert sum(r.length for r in got) == len(ids)
        for r in got:
            assert r.ids_crc32 == zlib.crc32(np.asarray(ids[r.start : r.start + r.length], "<u4").tobytes())
            assert r.length == 1024 or r.piece == 0
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for x in bins.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(packing.pieces(empty(docs))).count() == 0


def test_ids_of_a_whole_table_are_the_tokenizers_ids(spark):
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = table.collect()
    want = {}
    for r, e in zip(rows, t.encode_batch([r.text or "" for r in rows], add_special_tokens=False), strict=True):
        ids, at = np.asarray([*e.ids, 2], "<u4"), 0
        for piece in range(-(-len(ids) // 1024)):
            n = (len(ids) - 1) % 1024 + 1 if piece == 0 else 1024
            want[r.doc_id, piece] = (at, n, zlib.crc32(ids[at : at + n].tobytes()))
            at += n
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in packing.pieces(table).collect()} == want


def test_packing_exchanges_until_near_its_bound(spark):
    import numpy as np

    lengths = np.random.default_rng(3).integers(1, 1024, 3000).tolist()
    df = spark.createDataFrame([(i, i, 0, 0, x, 0) for i, x in enumerate(lengths)], packing.PIECES)
    rows = packing.pack(df, group_pieces=300).collect()
    assert len(rows) == 3000
    n = len({r.sequence_id for r in rows})
    alone = packing.best_fit_decreasing(sorted(lengths, reverse=True))[2]
    # a partition certified by itself keeps its free space, so small partitions cost a little
    assert packing.lower_bound(np.asarray(lengths)) <= n <= 1.02 * alone


def test_lower_bound_is_below_any_packing():
    import numpy as np

    r = np.random.default_rng(1)
    for _ in range(30):
        x = np.sort(r.integers(1, 1025, r.integers(1, 60)))[::-1]
        assert packing.lower_bound(x) <= packing.best_fit_decreasing(x.tolist())[2]
    assert packing.lower_bound(np.full(10, 513)) == 10


def test_shards_have_near_equal_bytes(docs, spark):
    rows = kdshard.kd_shards(docs, leaves=4).collect()
    text = dict(enumerate(texts()))
    assert sorted(r.doc_id for r in rows) == sorted(text)
    load, slots = Counter(), defaultdict(list)
    for r in rows:
        assert r.size == len((text[r.doc_id] or "").encode()) + 1
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    whole = sum(load.values())
    assert all(abs(load[k] - whole / 4) < 0.05 * whole for k in range(4)), load
    shard = {r.doc_id: r.shard for r in rows}
    assert shard[0] == shard[1] and kdshard.kd_shards(empty(docs), leaves=4).count() == 0


def test_slots_are_numbered_in_several_groups(docs, monkeypatch):
    monkeypatch.setattr(kdshard, "SLOT_ROWS", 3)
    slots = defaultdict(list)
    for r in kdshard.kd_shards(docs, leaves=2).collect():
        slots[r.shard].append(r.slot)
    assert len(slots) == 2 and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_a_hot_group_is_cut(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 200, F.lit("same text")).otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    load = Counter(r.shard for r in kdshard.kd_shards(df, leaves=8).collect())
    assert len(load) == 8 and max(load.values()) < 70


def test_null_and_repeated_ids_and_long_texts_are_rows_like_others(spark):
    r = random.Random(6)
    say = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    ts = [say(20) for _ in range(8)] + [None, "", say(30_000)]
    ids = [None, None, 1, 1, 2, 2, None, 3, None, 4, None]
    ts[5] = ts[4]
    df = spark.createDataFrame([(i, t, f"s{k % 2}", "en", len(t or ""), "clash") for k, (i, t) in enumerate(zip(ids, ts, strict=True))], "doc_id long, text string, source string, lang string, n_chars long, size string").repartition(3)
    n = Counter((i, len(words(t))) for i, t in zip(ids, ts, strict=True))
    assert Counter((x.doc_id, x.n_words) for x in rules.ledger(df).collect()) == n
    mixed = mixing.mix(df.select("doc_id", "source", n_words(F.col("text")).alias("size"), "text"), draw=("text",)).collect()
    assert Counter((x.doc_id, x.size) for x in mixed) == n and abs(sum(x.taken for x in mixed) - sum({x.source_size: x.target for x in mixed}.values())) <= 2
    assert Counter((x.doc_id, x.n_words, x.n_removed) for x in substring.remove_repeats(df).collect()) == Counter((i, w, 0) for i, w in n.elements())
    packed = packing.pack(packing.pieces(df)).collect()
    assert Counter(x.doc_id for x in packed if x.piece == 0) == Counter(ids) and max(x.piece for x in packed) > 50
    assert len({(x.sequence_id, x.offset) for x in packed}) == len(packed)
    shards = kdshard.kd_shards(df, leaves=4).collect()
    assert Counter((x.doc_id, x.size) for x in shards) == Counter((i, len((t or "").encode()) + 1) for i, t in zip(ids, ts, strict=True))


def test_a_hot_group_without_ids_is_cut(spark):
    for hot_id in (None, 7):
        made = [(hot_id, "the same text of some length", "en", "a", 28)] * 200 + [(1000 + i, f"text number {i} of some length", "en", "b", 28) for i in range(200)]
        df = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")
        placed = kdshard.kd_shards(df, leaves=8).collect()
        load = Counter(r.shard for r in placed)
        assert len(placed) == 400 and sorted(load) == list(range(8)) and max(load.values()) <= 65 and min(load.values()) >= 35, load
        slots = defaultdict(list)
        for r in placed:
            slots[r.shard].append(r.slot)
        assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_equal_rows_are_numbered_in_small_groups(spark, monkeypatch):
    monkeypatch.setattr(kdshard, "SLOT_ROWS", 20)
    df = spark.createDataFrame([(None, None, "en", "a", 0)] * 150 + [(i, "x" * 400, "en", "b", 400) for i in range(8)], "doc_id long, text string, lang string, source string, n_chars long")
    slots = defaultdict(list)
    for r in kdshard.kd_shards(df, leaves=2).collect():
        slots[r.shard].append(r.slot)
    assert sum(map(len, slots.values())) == 158 and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_near_copies_are_paired_with_few_centres(spark, monkeypatch):
    """Copies that differ a little from each other have another centre in almost every band."""
    r = random.Random(4)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for i in range(300):
        own = list(base)
        for k in r.sample(range(200), 3):
            own[k] = f"x{i}_{k}"
        texts.append(" ".join(own))
    pairs, alike = [], neardup._alike

    def counted(*args):
        out = alike(*args)
        pairs.append(out.count())
        return out

    monkeypatch.setattr(neardup, "_alike", counted)
    got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), size=2)
    assert {x.component_id for x in got.collect()} == {0}
    assert sum(pairs) <= 2 * len(texts)
