"""Mixing sources to target weights by capped water-filling.

Sources share a budget by weight; a source stops at ``max_epochs`` times its size, and its excess goes to
the others by weight until none is above its cap.  A document is taken whole as many times as its source's
target holds whole epochs; the rest is drawn in a seeded order, the last document in it for a fraction.

The draw is by a hash of the columns in ``draw``: a source's documents fall into buckets by it, the buckets are summed,
and only the bucket in which the target ends is put in order.  A source has as many buckets as a bucket has documents,
so neither grows beyond the root of the source.  Documents are never joined by their ids.

Null texts have size 0, very long ones their full size; a null source is a source of its own, last in order; rows with
null or equal ids are separate items, drawn apart where another column of ``draw`` differs; repeated rows are separate
items in one bucket; empty tables give empty results; only the named columns are read, so others may clash in name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm._support import discard, staged

#: Documents of a source whose order is resolved in one sorted group, at least.
BUCKET_ROWS = 4096
#: Sources that are sent to every executor, a row of nine numbers and a name each; more are joined by a shuffle.
BROADCAST_SOURCES = 20_000


def numbered(df: DataFrame, order, name: str) -> DataFrame:
    """df with ``__i``, its place from 0 in a distributed sort: places within a partition plus the partitions' offsets."""
    placed = staged(df.orderBy(order).withColumn("__m", F.monotonically_increasing_id()), name)
    part = F.shiftright("__m", 33)
    sizes = placed.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__o"))
    return placed.withColumn("__p", part).join(offsets, "__p").withColumn("__i", F.col("__o") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("__p", "__o", "__m")


def water_level(sources: DataFrame, budget: float) -> float | None:
    """The level at which min(cap, level * weight) over all sources sums to the budget; None: every source at its cap.

    Each round is one aggregate of three numbers: sources at their cap give back their excess, and the level of the
    others rises, until no further source is capped."""
    level, capped = 0.0, -1
    while True:
        at_cap = F.col("cap") <= F.lit(level) * F.col("weight")
        row = sources.agg(F.sum(at_cap.cast("long")).alias("n"), F.sum(F.when(at_cap, F.col("cap"))).alias("c"), F.sum(F.when(~at_cap, F.col("weight"))).alias("w")).first()
        if not row["w"]:
            return None
        if (row["n"] or 0) == capped:
            return level
        capped, level = row["n"] or 0, (budget - (row["c"] or 0.0)) / row["w"]


def mixed(df: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), budget_share: float = 1.5, max_epochs: float = 2.0, seed: int = 17, source_col: str = "source", size_col: str = "size", draw: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """df's rows as ``__row``, with ``__z, source_size, target, taken``.  The rows themselves are read again at the end
    and not written; what is staged is a source, a hash and a size for each."""
    base = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__row"), F.col(source_col).alias("__s"), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("__z"), F.xxhash64(F.lit(seed), *draw).alias("__h"))
    docs = staged(base.drop("__row"), "mix-docs")
    totals = docs.groupBy("__s").agg(F.sum("__z").alias("source_size"), F.count(F.lit(1)).alias("n"))
    ranked = numbered(totals, F.asc_nulls_last("__s"), "mix-order")
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    sources = staged(ranked.select("__s", F.col("__i").alias("sid"), "source_size", "n", F.element_at(cycle, (F.col("__i") % len(weights)).cast("int") + 1).alias("weight"), (F.col("source_size") * float(max_epochs)).alias("cap")), "mix-sources")
    few = sources.count() <= BROADCAST_SOURCES
    small = F.broadcast if few else lambda x: x
    budget = (sources.agg(F.sum("source_size")).first()[0] or 0) * budget_share
    level = water_level(sources, budget)
    target = F.col("cap") if level is None else F.least(F.col("cap"), F.lit(level) * F.col("weight"))
    wanted = sources.withColumn("target", target).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(F.lit(0)))
    wanted = wanted.withColumn("extra", F.round("target").cast("long") - F.col("whole") * F.col("source_size")).withColumn("buckets", F.ceil(F.col("n") / F.greatest(F.lit(float(BUCKET_ROWS)), F.sqrt("n"))))
    wanted = staged(wanted.select(F.col("__s").alias("__k"), "sid", "source_size", "target", "whole", "extra", "buckets"), "mix-targets")
    place = F.floor(F.shiftrightunsigned("__h", 11) / float(1 << 53) * F.col("buckets"))
    at = lambda x: x.join(small(wanted), F.col("__s").eqNullSafe(F.col("__k"))).withColumn("__b", place)
    order = Window.partitionBy("sid").orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    filled = at(docs).groupBy("sid", "__b").agg(F.sum("__z").alias("__w")).withColumn("__before", F.sum("__w").over(order) - F.col("__w"))
    edge = filled.join(wanted.select("sid", "extra"), "sid").where((F.col("__before") <= F.col("extra")) & (F.col("extra") < F.col("__before") + F.col("__w")))
    # a source without an edge has nothing left over to draw
    wanted = staged(wanted.join(edge.select("sid", F.col("__b").alias("__eb"), "__before"), "sid", "left"), "mix-edges")
    discard(docs, sources)
    joined = at(base)
    at_edge = F.coalesce(F.col("__b") == F.col("__eb"), F.lit(False))
    whole = F.col("whole") * F.col("__z")
    out = lambda extra: ("__row", "__z", "source_size", "target", (whole + extra).cast("long").alias("taken"))
    clear = joined.where(~at_edge).select(*out(F.when(F.col("__b") < F.col("__eb"), F.col("__z")).otherwise(F.lit(0))))
    within = Window.partitionBy("sid").orderBy("__h", "__z", *(F.col(f"__row.`{c}`") for c in draw)).rowsBetween(Window.unboundedPreceding, 0)
    cut = joined.where(at_edge).withColumn("__c", F.col("__before") + F.sum("__z").over(within) - F.col("__z"))
    cut = cut.select(*out(F.greatest(F.lit(0), F.least(F.col("__z"), F.col("extra") - F.col("__c")))))
    return clear.unionByName(cut)


def mix(df: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), budget_share: float = 1.5, max_epochs: float = 2.0, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size", draw: tuple[str, ...] = ()) -> DataFrame:
    """``id, size, source_size, target, taken`` per row of df.

    Sources in code point order weigh ``weights`` in turn.  The sum of ``taken`` over a source is its target, rounded;
    ``taken`` is at most ceil(max_epochs) times a document's size."""
    # staged, so that sizes are computed once
    df = staged(df.select(*dict.fromkeys((id_col, source_col, size_col, *draw))), "mix-rows")
    found = mixed(df, weights, budget_share, max_epochs, seed, source_col, size_col, (id_col, *draw))
    return found.select(F.col(f"__row.`{id_col}`").alias(id_col), F.col("__z").alias("size"), "source_size", "target", "taken")
