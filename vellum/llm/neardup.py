"""Near-duplicates by min-max hashing, with links confirmed on full shingle sets.

1. One pass over the texts gives each document's set of word shingles as 64-bit hashes, a 128-bit fingerprint of
   the set, the keys of its bands, and a sketch.  A band is made of ``ROWS`` values of the signature, which keeps both
   the least and the greatest value under each permutation; the sketch is one bit of each of ``BITS`` values.
2. Rows with equal sets are one class; only classes are compared.  A class has a number of its own, so null and
   repeated ids never make one node of different texts.
3. Stars: in each band's bucket every class is a candidate of the bucket's least class, its centre, and of nobody else.
   Candidates whose sketches differ too much go.  A class is first confirmed against the centre of its largest bucket
   alone; what that joins is contracted, and only members of another component than their centre's are paired with it
   after that: a class of many near copies has another centre in almost every band.
4. What the stars left apart.  Classes of a bucket that lie in different components are compared with each other where
   the bucket has ``COLD`` classes at most.  A larger bucket has a reference, the most linked class of its largest
   component, and its classes are met by their differences from the reference (below).
5. Components are found by alternating large and small stars, until nothing changes.

Differences.  For sets x, y and any set c, the difference of x and y is that of d(x) = x ^ c and d(y) = y ^ c.  A
similarity of p means that x and y differ in at most (1 - p) / (1 + p) * (|x| + |y|) shingles, so d(x) and d(y) share at
least half of |d(x)| + |d(y)| less that.  A pair of which neither is joined to c otherwise than by chance shares much, so
each class needs to be found only under the rarest elements of its difference: all but the least overlap that any
partner requires, plus one.  Copies of one text differ from it in places of their own, so that the rarest elements of
two of them seldom meet, and the rows of a bucket of copies grow with the copies and not with their pairs.  No link that
the bucket holds is lost by this: it is a bound, not an estimate.

With bands of 7 values a pair of similarity 0.8 shares no band with probability under 1e-6; its sketches differ in more
than ``MOST_BITS`` of 448 bits with probability under 1e-6.  So every candidate pair is confirmed, refuted, or
already in one component.

Null texts and texts without words have an empty set and link with nothing.  Fewer words than a shingle make one
shingle of the whole sequence.  Repeated rows are equal sets.  Empty tables give empty results.  A null id
counts as larger than any other; rows that share an id, or have none, are told apart by a 64-bit hash of the text.  Very
long texts are whole: their sets are hashed in blocks.  Only the id and the text are read, so other columns may have any
name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm._support import by_bytes, discard, encoded, id_order, map_arrow, mix, moved, span_hashes, staged, words

ROWS, BANDS = 7, 64
#: Bits of a sketch, and how many may differ; at similarity 0.8 a tenth does on average, with a deviation of 6.4.
BITS, MOST_BITS = 448, 77
#: Classes of a bucket whose members are compared pair by pair.
COLD = 32
#: Bytes of wanted documents that are sent to every executor; more are joined by a shuffle of the texts.
BROADCAST_BYTES = 32 << 20
#: Members that are checked against one copy of their star's centre.
STAR_ROWS = 128
_BLOCK = 512
_NULL_ID = (1 << 63) - 1


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; A-Z are lower-cased."""
    data, starts, ends, first = words(texts, lower=True)
    h = span_hashes(data, starts, ends)
    n = len(h)
    s = np.zeros(n, np.uint64)
    for k in range(size):
        s[: n - k] = mix(s[: n - k] * np.uint64(0x9E3779B97F4A7C15) + h[k:] + np.uint64(k + 1))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(s[a : b - size + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            for x in h[a:b]:
                whole = mix(np.asarray([whole * np.uint64(0xD6E8FEB86659FD93) + x], np.uint64))[0]
            out.append(np.asarray([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _permutations(bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20_011).integers(0, 1 << 63, size=(2, (bands * rows + 1) // 2, 1), dtype=np.uint64)
    return draw[0] * np.uint64(2) + np.uint64(1), draw[1]


def band_keys(sets: list[np.ndarray], bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, sketch words) of each non-empty set, a row each."""
    mul, add = _permutations(bands, rows)
    half = len(mul)
    sig = np.zeros((len(sets), 2 * half), np.uint64)
    for i, x in enumerate(sets):
        for at in range(0, len(x), _BLOCK):
            v = mul * x[None, at : at + _BLOCK] + add
            lo, hi = v.min(1), v.max(1)
            if at:
                np.minimum(lo, sig[i, :half], out=lo)
                np.maximum(hi, sig[i, half:], out=hi)
            sig[i, :half], sig[i, half:] = lo, hi
    # least and greatest values alternate, so that every band holds both
    sig = sig.reshape(len(sets), 2, half).transpose(0, 2, 1).reshape(len(sets), 2 * half)[:, : bands * rows].reshape(len(sets), bands, rows)
    bits = mix(sig.reshape(len(sets), -1)[:, :BITS]) & np.uint64(1)
    sketch = np.packbits(bits.astype(np.uint8), axis=1).view(np.int64) if len(sets) else np.zeros((0, BITS // 64), np.int64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sets), bands))
    for r in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
    return key.view(np.int64), sketch


def signatures(docs: DataFrame, size: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``__o, __h, n, fp, bands, sketch`` per row of (__o, __h, __t)."""

    def scan(batches):
        for batch in batches:
            texts = encoded(batch.column(2))
            for at, to in by_bytes(texts):
                sets = shingle_sets(texts[at:to], size)
                keys, sketch = band_keys(sets, bands, rows)
                full = [len(x) > 0 for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(at, to - at) for i in (0, 1)), pa.array([len(x) for x in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(x.tobytes()) if y else None for x, y in zip(sets, full, strict=True)], pa.binary()), *(pa.array([k if y else None for k, y in zip(x, full, strict=True)], pa.list_(pa.int64())) for x in (keys, sketch))],
                    names=["__o", "__h", "n", "fp", "bands", "sketch"],
                )

    return map_arrow(docs.select("__o", "__h", "__t"), scan, "__o long, __h long, n long, fp binary, bands array<long>, sketch array<long>")


def _met(docs: DataFrame, classes: DataFrame, pairs: DataFrame, size: int, percent: int, differ: bool = False) -> DataFrame:
    """``a, b, linked, na, nb, d`` for pairs (a, b) of classes: whether 100 * intersection >= percent * union, the
    sizes of the sets, and with ``differ`` the elements that one set alone has.

    A set travels once for each pair in which its class is a; that of b is copied to each group of STAR_ROWS of its
    pairs."""
    centres = staged(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / STAR_ROWS).cast("int").alias("s")), "near-centres")
    rows = pairs.join(centres, "b").select(F.col("a").alias("cid"), F.struct(F.col("b"), F.pmod(F.xxhash64("a"), F.col("s")).cast("int").alias("salt"), F.lit(False).alias("centre")).alias("e"))
    own = centres.select(F.col("b").alias("cid"), F.explode(F.transform(F.sequence(F.lit(0), F.col("s") - 1), lambda k: F.struct(F.col("b"), k.alias("salt"), F.lit(True).alias("centre")))).alias("e"))
    per_class = rows.unionByName(own).groupBy("cid").agg(F.collect_list("e").alias("es"))
    wanted = staged(per_class.join(classes, "cid").select("cid", F.col("o").alias("__o"), F.col("h").alias("__h"), "es"), "near-wanted")
    heavy = wanted.agg(F.sum(32 + 24 * F.size("es"))).first()[0] or 0
    entry = "array<struct<b:long,salt:int,centre:boolean>>"

    def sets(batches):
        seen = set()
        for batch in batches:
            # repeated rows are one class: a task sends its set once
            cids = batch.column(0).to_pylist()
            new = [i for i, c in enumerate(cids) if c not in seen and not seen.add(c)]
            batch = batch.take(pa.array(new, pa.int64()))
            texts = encoded(batch.column(1))
            for at, to in by_bytes(texts):
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, to - at) for i in (0, 2)), pa.array([x.tobytes() for x in shingle_sets(texts[at:to], size)], pa.large_binary()).cast(pa.binary())], names=["cid", "es", "set"])

    found = map_arrow(docs.join(F.broadcast(wanted) if heavy <= BROADCAST_BYTES else wanted, ["__o", "__h"]).select("cid", "__t", "es"), sets, f"cid long, es {entry}, set binary")
    dealt = found.select("cid", F.explode("es").alias("e"), "set").select("cid", "e.*", "set")

    def check(batches):
        centre, key, last = None, None, None
        for batch in batches:
            ids, bs, salts, flags, blobs = (batch.column(i).to_pylist() for i in range(5))
            out = []
            for i, b, salt, flag, blob in zip(ids, bs, salts, flags, blobs, strict=True):
                x = np.frombuffer(blob, np.uint64)
                if flag:
                    centre, key = x, (b, salt)
                elif key == (b, salt) and last != (i, key):
                    # a class that several tasks sent stands in a row
                    last = (i, key)
                    d = np.setxor1d(x, centre, assume_unique=True)
                    union = (len(x) + len(centre) + len(d)) // 2
                    out.append((i, b, 100 * (union - len(d)) >= percent * union, len(x), len(centre), d.view(np.int64) if differ else None))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64())))], names=["a", "b", "linked", "na", "nb", "d"])

    dealt = dealt.select("cid", "b", "salt", "centre", "set").repartition("b", "salt").sortWithinPartitions("b", "salt", F.desc("centre"), "cid")
    out = staged(map_arrow(dealt, check, "a long, b long, linked boolean, na long, nb long, d array<long>"), "near-met")
    discard(centres, wanted)
    return out


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """``node, root`` of every node of the edges (a, b) that is not the least one reachable, which is its root."""
    e = staged(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        large = staged(large, f"{name}-large")
        discard(e)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()
        e = staged(small, f"{name}-small")
        discard(large)
        # until it is a forest of stars: no node is both a centre and a leaf, and every leaf has one centre
        several = e.groupBy("u").count().where("count > 1").select("u")
        if several.unionByName(e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u")).isEmpty():
            return moved(e, e.select(F.col("u").alias("node"), F.col("v").alias("root")))


def _rooted(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) whose classes lie in different components, with the roots ra and rb."""
    for side in ("a", "b"):
        pairs = pairs.join(found.select(F.col("node").alias(side), F.col("root").alias(f"r{side}")), side, "left")
    return pairs.select("a", "b", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb")).where("ra <> rb")


def _alike(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow a link."""
    shown = ("n", *(f"s{k}" for k in range(BITS // 64)))
    for side in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("cid").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in shown)), side)
    differ = sum((F.bit_count(F.col(f"s{k}_a").bitwiseXOR(F.col(f"s{k}_b"))) for k in range(BITS // 64)), F.lit(0))
    return pairs.where((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (differ <= MOST_BITS)).select("a", "b")


def _by_difference(differences: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes with one reference that may be linked, from ``a, b, linked, na, nb, d`` with b as the
    reference: those that meet under an element of both prefixes, with room for the overlap they need.  With a's ``root``
    as well, only pairs of different roots."""
    share = (100 - percent) / (100 + percent)
    size = F.size("d").cast("long")
    # the least difference of a partner: one of a pair is not linked to the reference, and no overlap exceeds it
    linked_partner = share * (F.col("nb") + percent / 100 * F.col("na"))
    partner = F.when(F.col("linked"), linked_partner).otherwise(F.greatest(F.lit(0.0), (size - share * (F.col("na") + F.col("nb"))) / (1 + share)))
    overlap = F.greatest(F.lit(1), F.ceil(((1 - share) * partner + size - share * (F.col("na") + F.col("nb"))) / 2 - 1e-6))
    root = F.col("root" if "root" in differences.columns else "a").alias("root")
    rows = differences.select("a", root, F.col("b").alias("ref"), "linked", F.col("na").alias("n"), size.alias("dn"), (size - overlap + 1).alias("prefix"), F.explode("d").alias("e"))
    often = rows.groupBy("ref", "e").agg(F.count(F.lit(1)).alias("f"))
    placed = rows.where("prefix > 0").join(often, ["ref", "e"]).withColumn("at", F.row_number().over(Window.partitionBy("ref", "a").orderBy("f", "e")) - 1)
    index = staged(placed.where("at < prefix and f > 1").select("ref", "e", "a", "root", "linked", "n", "dn", "at"), "near-index")
    x, y = index.alias("x"), index.alias("y")
    c = lambda name: (F.col(f"x.{name}"), F.col(f"y.{name}"))
    (nx, ny), (dx, dy), (px, py), (lx, ly) = c("n"), c("dn"), c("at"), c("linked")
    needed = (dx + dy - share * (nx + ny)) / 2 - 1e-6
    meet = (F.col("x.ref") == F.col("y.ref")) & (F.col("x.e") == F.col("y.e")) & (F.col("x.a") > F.col("y.a")) & (F.col("x.root") != F.col("y.root")) & ~(lx & ly) & (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)) & (F.least(dx - px, dy - py) >= needed)
    out = staged(x.join(y, meet).select(F.col("x.a").alias("a"), F.col("y.a").alias("b")).distinct(), "near-by-difference")
    discard(index)
    return out


def linked(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(``__o, __h, n, fp`` per row of (__o, __h, __t); ``fp, root, first_o, first_h`` per class): root names the
    component, first_o and first_h its row with the least id, then hash of the text."""
    if percent < 80:
        raise ValueError("the bands are made for similarities of 80 percent or more")
    sig = staged(signatures(docs, size), "near-signatures")
    # the values of equal sets are equal, so any of them will do
    one = sig.where("fp is not null").groupBy("fp").agg(F.min(F.struct("__o", "__h")).alias("r"), *(F.first(c).alias(c) for c in ("n", "bands", "sketch")))
    classes = staged(one.select(F.monotonically_increasing_id().alias("cid"), "fp", F.col("r.__o").alias("o"), F.col("r.__h").alias("h"), "n", "bands", *(F.col("sketch")[k].alias(f"s{k}") for k in range(BITS // 64))), "near-classes")
    rows = staged(sig.select("__o", "__h", "n", "fp"), "near-rows")
    discard(sig)
    # a class has another key in each band, so that a key's rows are its classes
    banded = classes.select("cid", F.explode("bands").alias("key"))
    buckets = staged(banded.groupBy("key").agg(F.min("cid").alias("centre"), F.count(F.lit(1)).alias("m")).where("m > 1"), "near-buckets")
    members = staged(banded.join(buckets, "key"), "near-members")
    discard(buckets)
    slim = staged(classes.drop("bands"), "near-slim")
    fps = slim.select("cid", "fp", "o", "h")

    first = members.where("cid <> centre").groupBy(F.col("cid").alias("a")).agg(F.max_by("centre", F.struct(F.col("m"), -F.col("centre"))).alias("b"))
    first = staged(_alike(first, slim, percent), "near-first")
    links = found = None

    def join(more: DataFrame) -> None:
        """More links: what they connect are the components so far."""
        nonlocal links, found
        if found is None:
            links, found = more, components(more)
            return
        links = links.unionByName(more)
        over = components(_rooted(more, found).select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        up = over.select(F.col("node").alias("root"), F.col("root").alias("top"))
        before, found = found, staged(found.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")).unionByName(over), "near-found")
        discard(before, over)

    def confirm(pairs: DataFrame) -> None:
        met = _met(docs, slim, pairs.select("a", "b"), size, percent)
        join(staged(met.where("linked").select("a", "b"), "near-links"))
        discard(met)

    def apart(rows: DataFrame) -> DataFrame:
        """``key, cid, centre, m, root, star``: rows of buckets with several components, and their centre's component."""
        tagged = staged(rows.join(found.withColumnRenamed("node", "cid"), "cid", "left").select("key", "cid", "centre", "m", F.coalesce("root", "cid").alias("root")), "near-tagged")
        # the centre is the least class of its bucket
        several = staged(tagged.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.min_by("root", "cid").alias("star")).where("x <> y").select("key", "star"), "near-apart")
        out = staged(tagged.join(several, "key"), "near-live")
        discard(tagged, several)
        return out

    confirm(first)
    far = apart(members)
    discard(members)
    rest = far.where("root <> star").select(F.col("cid").alias("a"), F.col("centre").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    rest = staged(_alike(rest, slim, percent), "near-rest")
    tried = staged(first.unionByName(rest).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "near-tried")
    if not rest.isEmpty():
        confirm(rest)
    discard(rest, first)
    # what the stars left apart
    live = apart(far.select("key", "cid", "centre", "m"))
    discard(far)
    cold = live.where(F.col("m") <= COLD).groupBy("key").agg(F.collect_list(F.struct("cid", "root")).alias("es"))
    pair = lambda x: F.transform(F.filter("es", lambda y: (y["cid"] < x["cid"]) & (y["root"] != x["root"])), lambda y: F.struct(x["cid"].alias("a"), y["cid"].alias("b")))
    cold = staged(cold.select(F.explode(F.flatten(F.transform("es", pair))).alias("p")).select("p.*").distinct(), "near-cold")
    hot = live.where(F.col("m") > COLD)
    # the reference of a bucket is the most linked class of the component with most classes in it
    votes = hot.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max_by("root", F.struct(F.col("c"), -F.col("root"))).alias("root"))
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("c"))
    hubs = ends.join(found, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.max_by("node", F.struct(F.col("c"), -F.col("node"))).alias("hub"))
    referred = staged(votes.join(hubs, "root", "left").select("key", F.coalesce("hub", "root").alias("b")), "near-referred")
    against = staged(hot.join(referred, "key").where("cid <> b").select(F.col("cid").alias("a"), "b").distinct(), "near-against")
    discard(live, referred)
    candidates = cold
    if not against.isEmpty():
        met = _met(docs, slim, against, size, percent, differ=True)
        join(staged(met.where("linked").select("a", "b"), "near-links"))
        rooted = met.join(found.withColumnRenamed("node", "a"), "a", "left").withColumn("root", F.coalesce("root", "a"))
        candidates = cold.unionByName(_by_difference(rooted, percent)).distinct()
        discard(met)
    rest = _rooted(candidates.join(tried, ["a", "b"], "left_anti"), found).select("a", "b")
    rest = staged(_alike(rest, slim, percent), "near-rest")
    discard(against, cold, tried)
    if not rest.isEmpty():
        confirm(rest)
    discard(rest)
    rooted = staged(fps.join(found.withColumnRenamed("node", "cid"), "cid", "left").select("fp", F.coalesce("root", "cid").alias("root"), "o", "h"), "near-rooted")
    firsts = staged(rooted.groupBy("root").agg(F.min(F.struct("o", "h")).alias("f")), "near-firsts")
    out = staged(rooted.join(firsts, "root").select("fp", "root", F.col("f.o").alias("first_o"), F.col("f.h").alias("first_h")), "near-of-class")
    discard(classes, slim, found, rooted, firsts)
    return rows, out


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(id_order(F.col(id_col)).alias("__o"), F.xxhash64(text_col).alias("__h"), F.col(text_col).cast("binary").alias("__t"))


def _id(o: str) -> Column:
    return F.when(F.col(o) != _NULL_ID, F.col(o))


def near_duplicates(df: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, component_id, kept`` per row of df.

    component_id is the least id of the component; null if none of its rows has an id.  kept is whether it is the row's
    own, so that rows which share that id are all kept; ``drop_duplicates`` leaves one row."""
    rows, of_class = linked(_keyed(df, id_col, text_col), size, percent)
    out = rows.join(of_class, "fp", "left").withColumn("first_o", F.coalesce("first_o", "__o"))
    return out.select(_id("__o").alias(id_col), F.col("n").alias("n_shingles"), _id("first_o").alias("component_id"), (F.col("__o") == F.col("first_o")).alias("kept"))


def drop_duplicates(df: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df of which one of each component is left: the one with the least id, then hash of its text; of rows
    that share both, any.  Rows without words all stay."""
    rows, of_class = linked(_keyed(df, id_col, text_col), size, percent)
    stay = rows.where("fp is null").unionByName(rows.join(of_class, "fp").where("__o = first_o and __h = first_h").select(*rows.columns))
    stay = staged(stay.groupBy("__o", "__h").agg(F.count(F.lit(1)).alias("__c"), F.first(F.col("n") > 0).alias("__w")), "near-stay")
    discard(rows, of_class)
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__row")
    keyed = df.select(row, id_order(F.col(id_col)).alias("__o"), F.xxhash64(text_col).alias("__h")).join(stay, ["__o", "__h"])
    # only rows that are there more than once are shuffled to leave one of them
    again = (F.col("__c") > 1) & F.col("__w")
    out = keyed.where(~again).select("__row.*")
    if not stay.where(again).isEmpty():
        out = out.unionAll(keyed.where(again).dropDuplicates(["__o", "__h"]).select("__row.*"))
    return out
