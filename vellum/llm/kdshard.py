"""Shards by a k-d tree over metadata: nodes split at distributed weighted medians along their widest dimension.

The points are groups of rows with equal texts: a group stays in one shard, unless it weighs more than a shard, when no
shard could hold it and it is cut by id into parts of about a quarter of one.  A coordinate is a 63-bit integer: 31 bits of the
dimension's place between its least and largest value, then 32 bits of a hash, so that no two points tie.  A
median is found for all nodes of a level at once: a histogram of 8192 bins per node, narrowed to the bin with
the median until that bin weighs next to nothing.  Points heavier than 1/64 of their node are dealt to the
lighter side first, and the cut among the others makes up the difference.

Null texts are one group of size 1 a row; null dimension values lie at the low end, categories at a hashed place.
Repeated rows are separate members of a group; rows with null ids count as the largest id.  Rows equal in id and text
can take each other's place, so which of them is in which shard of a cut group is left open.  Texts are weighed whole, and
one of over a shard's bytes is a shard's only large point.  Empty tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm._support import id_order, staged

BINS = 8192
HEAVY = 64
#: A bin that weighs less than this share of its node is not split further.
FINE = 1 / 2048
#: Rows numbered in one sorted group.
SLOT_ROWS = 20_000
#: Rows of a table of groups that is sent to every executor; a larger one is joined by a shuffle.
SENT_ROWS = 1 << 14
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _points(df: DataFrame, dims: tuple[str, ...], leaf_weight: float) -> DataFrame:
    """A row per group of equal texts: weight and a coordinate per dimension, taken from its row with the least id."""
    kinds = dict(df.dtypes)
    value = {d: (F.col(d).cast("double") if kinds[d] in NUMERIC else F.pmod(F.xxhash64(d), F.lit(1 << 20)).cast("double")) for d in dims}
    first = F.min(F.struct(F.col("__o"), *(value[d].alias(f"v{i}") for i, d in enumerate(dims)))).alias("m")
    groups = staged(df.groupBy("__g", "__part").agg(F.sum("__z").alias("weight"), first).select("__g", "__part", "weight", *(F.col(f"m.v{i}").alias(f"v{i}") for i in range(len(dims)))), "kd-groups")
    ends = groups.agg(*(f(f"v{i}").alias(f"{f.__name__}{i}") for i in range(len(dims)) for f in (F.min, F.max))).first()
    keys = []
    for i in range(len(dims)):
        lo, hi = ends[f"min{i}"] or 0.0, ends[f"max{i}"] or 0.0
        share = (F.col(f"v{i}") - lo) / (hi - lo) if hi > lo else F.lit(0.0)
        keys.append(F.shiftleft(F.floor(F.coalesce(share, F.lit(0.0)) * float((1 << 31) - 1)).cast("long"), 32) + F.pmod(F.xxhash64(F.lit(i), "__g", "__part"), F.lit(1 << 32)))
    return groups.select("__g", "__part", "weight", F.array(*keys).alias("keys"), F.lit(1).cast("long").alias("node"))


def _level(points: DataFrame, n_dims: int, name: str) -> DataFrame:
    """Every node split once: the left child of n is 2n, the right one 2n + 1."""
    extent = [(F.shiftright(F.max(F.col("keys")[i]), 32) - F.shiftright(F.min(F.col("keys")[i]), 32)).alias(f"e{i}") for i in range(n_dims)]
    wide = F.array(*(F.col(f"e{i}") for i in range(n_dims)))
    nodes = points.groupBy("node").agg(F.sum("weight").alias("all"), *extent)
    nodes = staged(nodes.select("node", "all", F.array_position(wide, F.array_max(wide)).cast("int").alias("dim")), f"{name}-nodes")
    at = points.join(nodes, "node").withColumn("key", F.element_at("keys", F.col("dim")))
    heavy = at.where(F.col("weight") * HEAVY > F.col("all"))
    # at most HEAVY points a node, from the heaviest on, each to the side that is lighter so far
    dealt = heavy.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("weight", "key")), asc=False).alias("hs"))
    start = F.struct(F.lit(0).cast("long").alias("l"), F.lit(0).cast("long").alias("r"), F.array().cast("array<bigint>").alias("left"))
    deal = F.aggregate("hs", start, lambda a, h: F.when(a["l"] <= a["r"], F.struct((a["l"] + h["weight"]).alias("l"), a["r"].alias("r"), F.array_append(a["left"], h["key"]).alias("left"))).otherwise(F.struct(a["l"].alias("l"), (a["r"] + h["weight"]).alias("r"), a["left"].alias("left"))))
    dealt = dealt.select("node", deal.alias("d")).select("node", F.col("d.l").alias("hl"), F.col("d.r").alias("hr"), F.col("d.left").alias("left"))
    top = (1 << 63) - 1
    cuts = nodes.join(dealt, "node", "left").select("node", "all", "dim", F.coalesce("left", F.array().cast("array<bigint>")).alias("left"), F.greatest(F.lit(0.0), F.least(F.col("all") / 2 - F.coalesce("hl", F.lit(0)), F.col("all") - F.coalesce("hl", F.lit(0)) - F.coalesce("hr", F.lit(0)))).alias("want"), F.lit(0).cast("long").alias("lo"), F.lit(top).alias("hi"), F.lit(0).cast("long").alias("below"), F.lit(False).alias("done"))
    cuts = staged(cuts, f"{name}-cuts")
    for _ in range(8):
        if cuts.where(~F.col("done")).isEmpty():
            break
        live = cuts.where(~F.col("done"))
        step = F.greatest(F.floor((F.col("hi") - F.col("lo")) / BINS).cast("long") + 1, F.lit(1).cast("long"))
        light = points.join(live.select("node", "all", "dim", "lo", "hi"), "node").withColumn("key", F.element_at("keys", F.col("dim"))).where((F.col("weight") * HEAVY <= F.col("all")) & (F.col("key") >= F.col("lo")) & (F.col("key") < F.col("hi")))
        bins = light.groupBy("node", F.floor((F.col("key") - F.col("lo")) / step).cast("long").alias("bin")).agg(F.sum("weight").alias("w"))
        run = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        bins = bins.withColumn("upto", F.sum("w").over(run)).join(live.select("node", "want", "below"), "node")
        hit = bins.where((F.col("below") + F.col("upto") >= F.col("want")) & (F.col("below") + F.col("upto") - F.col("w") < F.col("want"))).select("node", "bin", "w", "upto")
        cuts = staged(
            cuts.join(hit, "node", "left").select(
                "node", "all", "dim", "left", "want",
                F.when(F.col("done"), F.col("lo")).when(F.col("bin").isNull(), F.when(F.col("want") > 0, F.col("hi")).otherwise(F.col("lo"))).otherwise(F.col("lo") + F.col("bin") * step).alias("lo"),
                F.when(F.col("done") | F.col("bin").isNull(), F.col("hi")).otherwise(F.least(F.col("hi"), F.col("lo") + (F.col("bin") + 1) * step)).alias("hi"),
                F.when(F.col("done") | F.col("bin").isNull(), F.col("below")).otherwise(F.col("below") + F.col("upto") - F.col("w")).alias("below"),
                (F.col("done") | F.col("bin").isNull() | (F.col("w") <= F.col("all") * FINE) | (step <= 1)).alias("done"),
            ), f"{name}-cuts")
    is_heavy = F.col("weight") * HEAVY > F.col("all")
    left = F.when(is_heavy, F.array_contains("left", F.col("key"))).otherwise(F.col("key") < F.col("lo"))
    moved = points.join(cuts.select("node", "all", "dim", "left", "lo"), "node").withColumn("key", F.element_at("keys", F.col("dim")))
    return staged(moved.select("__g", "__part", "weight", "keys", (F.col("node") * 2 + F.when(left, F.lit(0)).otherwise(F.lit(1))).alias("node")), name)


def numbered_slots(df: DataFrame, shard: str, order: tuple[str, ...], rows: int, out: str = "slot") -> DataFrame:
    """Numbers the rows of each shard from 0 without a gap: sub-groups by hash, their offsets, then places within."""
    subs = max(1, math.ceil(rows / SLOT_ROWS))
    df = df.withColumn("__sub", F.pmod(F.xxhash64(*order), F.lit(subs)).cast("int"))
    sizes = df.groupBy(shard, "__sub").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(shard).orderBy("__sub").rowsBetween(Window.unboundedPreceding, 0)
    offsets = staged(sizes.select(shard, "__sub", (F.sum("__n").over(before) - F.col("__n")).alias("__before")), "slots")
    place = F.row_number().over(Window.partitionBy(shard, "__sub").orderBy(*order))
    return df.withColumn("__r", place).join(offsets, [shard, "__sub"]).withColumn(out, (F.col("__before") + F.col("__r") - 1).cast("long")).drop("__sub", "__r", "__before")


def _few(df: DataFrame) -> DataFrame:
    """A staged table, sent to every executor if it is small."""
    return F.broadcast(df) if df.count() <= SENT_ROWS else df


def _cut(rows: DataFrame, leaf: float) -> DataFrame:
    """rows with ``__part`` and ``__salt``.  A group of over a leaf is cut by id into parts of about a quarter of one.  Rows
    of a large group that are equal in id too, or have none, are dealt by their number in the staged table where there are
    more than a part, or than half a sorted group, takes: ``__salt`` is that number, 0 for all others."""
    sums = rows.groupBy("__g").agg(F.sum("__z").alias("__w"), F.count(F.lit(1)).alias("__c")).where((F.col("__w") > leaf) | (F.col("__c") > SLOT_ROWS))
    large = staged(sums.select("__g", F.when(F.col("__w") > leaf, F.ceil(F.col("__w") / (leaf / 4))).otherwise(F.lit(1)).cast("long").alias("__parts")), "kd-large")
    if large.isEmpty():
        return rows.withColumns({"__part": F.lit(0).cast("long"), "__salt": F.lit(0).cast("long")})
    large = _few(large)
    often = rows.join(large, "__g").groupBy("__g", "__o").agg(F.sum("__z").alias("__w"), F.count(F.lit(1)).alias("__c")).where((F.col("__w") > leaf / 4) | (F.col("__c") > SLOT_ROWS // 2))
    often = _few(staged(often.select("__g", "__o", F.lit(True).alias("__often")), "kd-often"))
    told = rows.join(large, "__g", "left").join(often, ["__g", "__o"], "left").withColumn("__salt", F.when(F.col("__often"), F.col("__n") + 1).otherwise(F.lit(0)).cast("long"))
    return told.withColumn("__part", F.coalesce(F.pmod(F.xxhash64("__id", "__salt"), F.col("__parts")), F.lit(0)).cast("long")).drop("__parts", "__often")


def kd_shards(df: DataFrame, leaves: int | None = None, target_bytes: int | None = None, dims: tuple[str, ...] = ("doc_id", "n_chars", "source", "lang"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, size, text_crc32, shard, slot`` per row.  The tree has ``leaves`` (a power of 2) leaves, or as many as
    bring them to ``target_bytes``.  Dimensions that df lacks are left out."""
    dims = tuple(d for d in dims if d in df.columns) or (id_col,)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("__id"), id_order(F.col(id_col)).alias("__o"), *(F.col(d).alias(f"__d{i}") for i, d in enumerate(dims)), (F.octet_length(text) + 1).cast("long").alias("__z"), F.crc32(text.cast("binary")).alias("__crc"), F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit("null")).alias("__g"), F.monotonically_increasing_id().alias("__n"))
    rows = staged(rows, "kd-rows")
    weight = rows.agg(F.sum("__z")).first()[0]
    if leaves is None:
        leaves = 1 << max(0, math.ceil(math.log2(max(1, (weight or 1) / (target_bytes or 256 << 20)))))
    depth = max(0, math.ceil(math.log2(leaves)))
    leaf = max(1.0, (weight or 1) / leaves)
    rows = _cut(rows, leaf)
    points = staged(_points(rows, tuple(f"__d{i}" for i in range(len(dims))), leaf), "kd-points")
    for level in range(depth):
        points = _level(points, len(dims), f"kd-{level}")
    shard = (F.col("node") - (1 << depth)).cast("int")
    placed = rows.join(points.select("__g", "__part", shard.alias("shard")), ["__g", "__part"])
    placed = staged(placed.select(F.col("__id"), F.col("__z").alias("size"), F.col("__crc").alias("text_crc32"), "shard", "__salt"), "kd-placed")
    fullest = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return numbered_slots(placed, "shard", ("__id", "text_crc32", "size", "__salt"), fullest or 1).select(F.col("__id").alias(id_col), "size", "text_crc32", "shard", "slot")
