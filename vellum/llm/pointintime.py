"""Point-in-time features from persistent segment trees over client-time shards.

A point has a client, an event time e, a time a >= e from which it is known, and weights.  A query at time t with a
window d sums the weights of the points with e > t - d and a <= t; as a >= e, these are the points in (t - d, t].

Tree.  Points of a shard are keyed by event time and inserted in the order in which they become known; each insertion is
a version.  In numpy arrays, one level of the tree at a time: a level holds, node after node, the insertions of each
node in the order of versions, with running sums of their weights and running counts of those that went to the left
child.  So an entry is a version of its node, and the counts are its pointers to the children's versions.  A query
starts at the version of its own time and goes down one level at a time along the key t - d, adding what lies to its
right.  All queries of many shards go down together, and a level is dropped when they have passed it.

Shards.  Clients with at most ``SHARD_ROWS`` events and queries are one shard.  Others are cut into time slices of equal
width, ``GRID`` microseconds times a power of two, the widest of which none has more besides one full minute.  A slice's tree holds the points
that become known in it, and those known before that leave a window in it, at e + d.  The sum of the other points,
which are active all the time, comes in as the sum over the slices before: of points that became known, less those that
left.  Running sums over slices go by blocks of ``BLOCK`` slices.  Many points that become known at one instant cannot be
parted by time: a slice with over ``DENSE`` times as many rows is dealt to several shards by a hash, each with a
tree of its own and all queries of the slice, and the sums are added up.

Distinct values.  Of a client's occurrences of a value only the latest known counts: an occurrence that is known later but
happened earlier never does, and the next later one removes it.  So each such occurrence is a point of weight one,
and a point of weight less one with the same event time that is known when the next is.

The last event of a window is the greatest key of the version's root, if it lies in the window.

Null clients and null times make no point and no query.  A null time of arrival is never known.  Null amounts count as 0.
Repeated rows of clicks count once, of lines each time, and sales are told apart by their rows.  Ties of the last event
go to the larger id.  Tables have no text; extra columns may have any name, as only named ones are read.  Empty tables
give no rows, or rows of zeros.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm._support import discard, map_arrow, staged

#: Events and queries of a client in one shard; rows of the shards whose trees are built together.
SHARD_ROWS, STEP_ROWS = 20_000, 150_000
#: Times SHARD_ROWS from which on a slice is dealt to several shards.
DENSE = 8
#: The narrowest slice, in microseconds: a minute; slices have GRID << k for k up to LEVELS.
GRID, LEVELS = 60_000_000, 20
BLOCK = 1024
DAY = 86_400_000_000
_CARRY, _POINT, _QUERY = range(3)
_NO_ID = -(1 << 63)


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without a zone, whatever the session's zone."""
    day = F.unix_date(ts.cast("date")).cast("long")
    return day * DAY + F.hour(ts).cast("long") * 3_600_000_000 + F.minute(ts).cast("long") * 60_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def cents(x: Column) -> Column:
    return F.coalesce(F.floor(100 * x + F.lit(0.5)), F.lit(0)).cast("long")


def suffix_sums(keys: np.ndarray, weights: np.ndarray, versions: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each query the sum of the weights among the first ``versions`` insertions with a key of ``least`` or more.
    keys: those of the insertions, 0 or more, in the order of versions; weights: a row each."""
    out = np.zeros((len(versions), weights.shape[1]), np.int64)
    if not len(keys) or not len(versions):
        return out
    top = int(max(keys.max(), least.max())).bit_length()
    # where a query's node begins and ends on this level, and how many of its insertions the version has
    begin, end, upto = np.zeros(len(versions), np.int64), np.full(len(versions), len(keys)), versions.astype(np.int64)
    lefts, sums = np.zeros(len(keys) + 1, np.int64), np.zeros((len(keys) + 1, weights.shape[1]), np.int64)
    for bit in range(top - 1, -1, -1):
        np.cumsum((keys >> bit & 1) == 0, out=lefts[1:])
        order = np.argsort(keys >> bit, kind="stable")
        keys, weights = keys[order], weights[order]
        np.cumsum(weights, axis=0, out=sums[1:])
        left = lefts[begin + upto] - lefts[begin]
        middle = begin + lefts[end] - lefts[begin]
        right = (least >> bit & 1).astype(bool)
        whole = np.flatnonzero(~right)
        out[whole] += sums[middle[whole] + (upto - left)[whole]] - sums[middle[whole]]
        begin, end, upto = np.where(right, middle, begin), np.where(right, end, middle), np.where(right, upto - left, left)
    return out + sums[begin + upto] - sums[begin] if top else out + np.cumsum(np.vstack([sums[:1], weights]), axis=0)[upto]


def _before(shard: np.ndarray, time: np.ndarray, qs: np.ndarray, qt: np.ndarray) -> np.ndarray:
    """How many of the rows (shard, time) are at or before each (qs, qt)."""
    n = len(shard)
    order = np.lexsort((np.arange(n + len(qs)) >= n, np.concatenate([time, qt]), np.concatenate([shard, qs])))
    is_row = order < n
    out = np.empty(len(qs), np.int64)
    out[order[~is_row] - n] = np.cumsum(is_row)[~is_row]
    return out


def _features(rows: dict[str, np.ndarray], w: np.ndarray, shard: np.ndarray, windows: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    """(queries, sums, time, last): the rows that are queries, and for each window their sums and the last event.
    rows: kind, d, e, a, from, tie of all rows of whole shards, which are numbered in order."""
    kind, e, a, tie = rows["kind"], rows["e"], rows["a"], rows["tie"]
    carry, query = np.flatnonzero(kind == _CARRY), np.flatnonzero(kind == _QUERY)
    point = np.flatnonzero(kind == _POINT)
    point = point[np.lexsort((a[point], shard[point]))]
    ps, pe = shard[point], e[point]
    keys = np.empty(len(point), np.int64)
    keys[np.lexsort((pe, ps))] = np.arange(len(point))
    qs, qt = shard[query], e[query]
    # all points of earlier shards are in a version, but with smaller keys than the shard's own
    versions = _before(ps, a[point], qs, qt)
    least = np.concatenate([_before(ps, pe, qs, qt - d * DAY) for d in windows])
    first = np.searchsorted(ps, qs)
    sums = suffix_sums(keys, w[point], np.tile(versions, len(windows)), np.maximum(least, np.tile(first, len(windows)))).reshape(len(windows), len(query), -1)
    known = point[rows["from"][point] > a[point]]
    if len(carry) or len(known):
        base = np.zeros((len(windows), int(shard[-1]) + 1, w.shape[1]), np.int64)
        for k, d in enumerate(windows):
            own = carry[rows["d"][carry] == d]
            base[k, shard[own]] = w[own]
            # points that the tree itself knows at the start of its slice are not carried besides
            active = known[e[known] + d * DAY >= rows["from"][known]]
            np.subtract.at(base[k], shard[active], w[active])
        sums += base[:, qs]
    # the greatest (event time, tie) of each version's root; a carry's is known from the start
    event = np.flatnonzero((tie >= 0) & (kind != _QUERY))
    event = event[np.lexsort((np.where(kind[event] == _CARRY, np.iinfo(np.int64).min, a[event]), shard[event]))]
    last, time = np.full((2, len(windows), len(query)), -1, np.int64)
    if len(event):
        order = np.lexsort((tie[event], e[event], shard[event]))
        rank = np.empty(len(event), np.int64)
        rank[order] = np.arange(len(event))
        best = np.append(-1, np.maximum.accumulate(rank))[_before(shard[event], np.where(kind[event] == _CARRY, np.iinfo(np.int64).min, a[event]), qs, qt)]
        at = event[order[np.maximum(best, 0)]]
        found = (best >= 0) & (shard[at] == qs)
        for k, d in enumerate(windows):
            inside = found & (e[at] > qt - d * DAY)
            last[k], time[k] = np.where(inside, tie[at], -1), np.where(inside, e[at], np.iinfo(np.int64).min)
    return query, sums, time, last


def _answered(rows: DataFrame, windows: tuple[int, ...], weights: list[str], shared: tuple[str, ...]) -> DataFrame:
    """``row, key, t, d``, the weights, ``last_e`` and ``last`` per query and window, from rows that are sorted by shard."""
    numbers = ["client", "slice", "part", "kind", "d", "e", "a", "from", "tie", "row", "key", *weights]
    out_names = ["row", "key", "t", "d", *weights, "last_e", "last"]
    first = [i for i, c in enumerate(weights) if c in shared]

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        """Rows of whole shards, STEP_ROWS or more at once."""
        held: list[dict] = []
        n = 0
        for batch in batches:
            held.append({c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(numbers)})
            n += batch.num_rows
            if n < STEP_ROWS:
                continue
            rows = {c: np.concatenate([x[c] for x in held]) for c in numbers}
            change = np.flatnonzero((np.diff(rows["client"]) != 0) | (np.diff(rows["slice"]) != 0) | (np.diff(rows["part"]) != 0))
            if not len(change):
                held = [rows]
                continue
            cut = int(change[-1]) + 1
            yield {c: x[:cut] for c, x in rows.items()}
            held = [{c: x[cut:] for c, x in rows.items()}]
            n -= cut
        if n:
            yield {c: np.concatenate([x[c] for x in held]) for c in numbers}

    def answer(batches):
        for rows in steps(batches):
            shard = np.cumsum(np.append(0, (np.diff(rows["client"]) != 0) | (np.diff(rows["slice"]) != 0) | (np.diff(rows["part"]) != 0)))
            query, sums, time, last = _features(rows, np.column_stack([rows[c] for c in weights]), shard, windows)
            sums[1:, :, first] = sums[:1, :, first]
            for k, d in enumerate(windows):
                cols = [rows["row"][query], rows["key"][query], rows["e"][query], np.full(len(query), d), *sums[k].T, time[k], last[k]]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), pa.int64()) for c in cols], names=out_names)

    return map_arrow(rows.select(*numbers), answer, ", ".join(f"{c} long" for c in out_names))


def _matched(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """rows with what a table has under their keys, a row at most.  Both sides are sorted: a table that grows with the input
    is not broadcast, and adaptive execution splits the rows of a hot key."""
    return rows.join(table.hint("merge"), keys, "left")


def _widths(ticks: DataFrame, cap: int) -> DataFrame:
    """``client, width`` of clients with more than ``cap`` ticks (client, at): that of their slices.

    A minute with more than ``cap`` ticks is as full in any slice.  It narrows a slice only if another such minute is in
    it; else one instant with many ticks would cut all of its client's time into minutes."""
    many = staged(ticks.groupBy("client").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cap).select("client", F.lit(True).alias("cut")), "pit-many")
    # the ticks of other clients are counted together
    minute = F.when(F.col("cut"), F.floor(F.col("at") / GRID)).alias("g")
    minutes = staged(_matched(ticks, many, ["client"]).groupBy("client", minute).agg(F.count(F.lit(1)).alias("n")), "pit-minutes")
    parted, full = F.when(F.col("n") <= cap, F.col("n")).otherwise(0).alias("n"), (F.col("n") > cap).cast("int").alias("full")
    levels = minutes.where("g is not null").select("client", parted, full, "g", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("k"))
    fullest = levels.groupBy("client", "k", F.expr("shiftright(g, k)").alias("g")).agg(F.sum("n").alias("n"), F.sum("full").alias("full")).groupBy("client", "k").agg(F.max("n").alias("n"), F.max("full").alias("full"))
    out = staged(fullest.groupBy("client").agg(F.coalesce(F.max(F.when((F.col("n") <= cap) & (F.col("full") <= 1), F.col("k"))), F.lit(0)).alias("k")).select("client", (F.lit(GRID) * F.expr("shiftleft(1L, k)")).alias("width")), "pit-widths")
    discard(many, minutes)
    return out


def _over_slices(slices: DataFrame, keys: list[str], exprs: dict[str, tuple], backwards: bool = False) -> DataFrame:
    """slices with what aggregates give over the slices before each (after it, if backwards), by blocks of slices.
    exprs: name -> (function of a column that aggregates, column, function of two columns that joins two results)."""
    block = F.floor(F.col("slice") / BLOCK)
    order = (lambda c: F.desc(c)) if backwards else F.asc
    inner = Window.partitionBy(*keys, "block").orderBy(order("slice")).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy(order("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocked = slices.withColumn("block", block)
    blocks = blocked.groupBy(*keys, "block").agg(*(f(c).alias(f"t_{n}") for n, (f, c, _) in exprs.items()))
    blocks = blocks.select(*keys, "block", *(f(f"t_{n}").over(outer).alias(f"b_{n}") for n, (f, _, _) in exprs.items()))
    own = blocked.select("*", *(f(c).over(inner).alias(f"i_{n}") for n, (f, c, _) in exprs.items()))
    return own.join(blocks.hint("merge"), [*keys, "block"]).select(*slices.columns, *(join(F.col(f"b_{n}"), F.col(f"i_{n}")).alias(n) for n, (_, _, join) in exprs.items()))


def _slice(at: Column) -> Column:
    return F.when(F.col("width").isNull(), F.lit(0)).otherwise(F.floor(at / F.col("width"))).cast("long")


def latest_known(occurrences: DataFrame, widths: DataFrame) -> DataFrame:
    """``client, e, a, n``: points that count the distinct values of occurrences (client, value, e, a), from the latest
    known occurrence of each: one more where it is known, one less where the next is."""
    keys, shard = ["client", "value"], ["client", "slice", "value"]
    seen = _matched(occurrences.groupBy("client", "value", "e").agg(F.min("a").alias("a")), widths, ["client"]).withColumn("slice", _slice(F.col("a")))
    own = Window.partitionBy(*shard).orderBy("a", F.desc("e"))
    before = F.max("e").over(own.rowsBetween(Window.unboundedPreceding, -1))
    local = seen.withColumn("before", before).where(F.col("before").isNull() | (F.col("e") > F.col("before"))).drop("before")
    if widths.isEmpty():
        both = local.withColumn("next", F.lead("a").over(own))
    else:
        # the latest of the slices before, and the first of those after
        local = staged(local, "pit-local")
        sliced = local.where("width is not null").groupBy(*keys, "slice").agg(F.max("e").alias("m"))
        top = staged(_over_slices(sliced, keys, {"earlier": (F.max, "m", F.greatest)}).select(*shard, "earlier"), "pit-earlier")
        kept = _matched(local, top, shard).where(F.col("earlier").isNull() | (F.col("e") > F.col("earlier")))
        kept = staged(kept.withColumn("following", F.lead("a").over(own)), "pit-kept")
        discard(local, top)
        sliced = kept.where("width is not null").groupBy(*keys, "slice").agg(F.min("a").alias("m"))
        first = staged(_over_slices(sliced, keys, {"after": (F.min, "m", F.least)}, backwards=True).select(*shard, "after"), "pit-after")
        both = _matched(kept, first, shard).withColumn("next", F.coalesce("following", "after"))
    steps = F.array(F.struct(F.col("a"), F.lit(1).cast("long").alias("n")), F.struct(F.col("next").alias("a"), F.lit(-1).cast("long").alias("n")))
    return both.select("client", "e", F.explode(steps).alias("s")).select("client", "e", "s.a", "s.n").where("a is not null")


def widths_of(events: DataFrame, queries: DataFrame, cap: int = SHARD_ROWS) -> DataFrame:
    """``client, width`` of the clients that are cut into slices, by events (client, e) and queries (client, t)."""
    return _widths(events.select("client", F.col("e").alias("at")).unionAll(queries.select("client", F.col("t").alias("at"))), cap)


def window_features(points: DataFrame, queries: DataFrame, widths: DataFrame, windows: tuple[int, ...], weights: list[str], shared: tuple[str, ...] = (), cap: int = SHARD_ROWS) -> DataFrame:
    """``row, key, t, d``, sums of the weights and ``last`` per query (client, row, key, t) and window of d days.

    points: client, e, a, the weights and tie, which is null for points that are no last event.  last is the tie of the
    last event known in the window, or -1.  Weights in ``shared`` are summed in the first window for all."""
    points = _matched(points.where(F.col("a") < F.col("e") + max(windows) * DAY), widths, ["client"])
    queries = _matched(queries, widths, ["client"])
    leaving = [F.when(F.col("a") < F.col("e") + d * DAY, _slice(F.col("e") + d * DAY)) for d in windows]
    slices = F.array_distinct(F.filter(F.array(_slice(F.col("a")), *leaving), lambda x: x.isNotNull() & (x >= _slice(F.col("a")))))
    zero = F.lit(0).cast("long")
    base = ["client", "slice", "width", "kind", "d", "e", "a", "tie", "row", "key", *weights]
    rows = points.withColumn("slice", F.explode(F.when(F.col("width").isNull(), F.array(zero)).otherwise(slices)))
    rows = rows.select("client", "slice", "width", F.lit(_POINT).cast("long").alias("kind"), zero.alias("d"), "e", "a", F.coalesce("tie", F.lit(-1)).alias("tie"), zero.alias("row"), zero.alias("key"), *weights)
    asked = queries.select("client", _slice(F.col("t")).alias("slice"), "width", F.lit(_QUERY).cast("long").alias("kind"), zero.alias("d"), F.col("t").alias("e"), F.col("t").alias("a"), F.lit(-1).cast("long").alias("tie"), "row", "key", *(zero.alias(c) for c in weights))
    rows = rows.select(*base).unionAll(asked.select(*base))
    dense = False
    if widths.isEmpty():
        rows = rows.withColumn("part", zero)
    else:
        rows = staged(rows, "pit-rows")
        rows, dense = _dealt(rows.unionAll(_carried(rows, windows, weights).select(*base)), cap)
    rows = rows.withColumn("from", F.coalesce(F.col("slice") * F.col("width"), F.lit(-(1 << 62))))
    sorted_rows = rows.repartition("client", "slice", "part").sortWithinPartitions("client", "slice", "part")
    out = _answered(sorted_rows, windows, weights, shared)
    if dense:
        # each part has summed its own points
        out = out.groupBy("row", "key", "t", "d").agg(*(F.sum(c).alias(c) for c in weights), F.max(F.struct("last_e", "last")).alias("last")).withColumn("last", F.col("last.last"))
    return out.select("row", "key", "t", "d", *weights, "last")


def _carried(rows: DataFrame, windows: tuple[int, ...], weights: list[str]) -> DataFrame:
    """For each slice of the clients that have several: the sums of the points that are active when it begins."""
    cut = rows.where("width is not null")
    fresh = F.col("slice") == _slice(F.col("a"))
    zero, long = F.lit(0).cast("long"), (lambda x: x.cast("long"))
    sums = {}
    for d in windows:
        leaves = F.col("slice") == _slice(F.col("e") + d * DAY)
        sign = F.when(F.col("a") < F.col("e") + d * DAY, fresh.cast("int") - leaves.cast("int")).otherwise(0)
        sums |= {f"{c}_{d}": F.sum(F.col(c) * sign) for c in weights}
    event = F.max(F.when(fresh & (F.col("tie") >= 0), F.struct("e", "tie")))
    per_slice = staged(cut.groupBy("client", "width", "slice").agg(event.alias("event"), *(f.alias(c) for c, f in sums.items())), "pit-slices")
    add = lambda x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))
    found = _over_slices(per_slice, ["client"], {"last_event": (F.max, "event", F.greatest), **{f"sum_{c}": (F.sum, c, add) for c in sums}})
    shown = lambda d: F.struct(long(F.lit(d)).alias("d"), *(F.col(f"sum_{c}_{d}").alias(c) for c in weights))
    each = found.select("client", "slice", "width", "last_event", F.explode(F.array(*(shown(d) for d in windows))).alias("x"))
    return each.select("client", "slice", "width", long(F.lit(_CARRY)).alias("kind"), "x.d", F.coalesce("last_event.e", zero).alias("e"), zero.alias("a"), F.coalesce("last_event.tie", F.lit(-1)).alias("tie"), zero.alias("row"), zero.alias("key"), *(f"x.{c}" for c in weights))


def _dealt(rows: DataFrame, cap: int) -> tuple[DataFrame, bool]:
    """rows with ``part``, and whether a slice has several: points go to one each by a hash, queries to all, and carries
    to the first."""
    full = rows.where("width is not null").groupBy("client", "slice").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > DENSE * cap)
    full = staged(full.select("client", "slice", F.ceil(F.col("n") / (DENSE * cap)).cast("int").alias("parts")), "pit-full")
    if full.isEmpty():
        return rows.withColumn("part", F.lit(0).cast("long")), False
    own = F.when(F.col("kind") == _POINT, F.array(F.pmod(F.xxhash64("e", "a"), F.col("parts")).cast("int")))
    own = own.when(F.col("kind") == _QUERY, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.lit(0)))
    dealt = _matched(rows, full, ["client", "slice"]).withColumn("parts", F.coalesce("parts", F.lit(1)))
    return dealt.select(*rows.columns, F.explode(own.cast("array<long>")).alias("part")), True


#: Weights of the shop's features, in the order of the result.
WEIGHTS = ["n_clicks", "n_purchases", "click_cents", "n_sales", "sale_cents", "n_lines", "n_items", "line_cents", "n_future"]
WINDOWS = (2, 14)


def shop_features(clicks: DataFrame, sales: DataFrame, lines: DataFrame, windows: tuple[int, ...] = WINDOWS, delay_minutes: int = 240, jitter_seconds: int = 259_200, horizon_days: int = 7, cap: int = SHARD_ROWS) -> DataFrame:
    """Features and label of each sale with a client and a time, at its time plus a hash of its id: what was known of
    the client's clicks, sales and lines in each window of days.  An id that is null counts as an empty string."""
    delay = delay_minutes * 60_000_000
    zeros = lambda **own: [own.get(c, F.lit(0)).cast("long").alias(c) for c in WEIGHTS]
    once = clicks.select("click_id", "ts", "arrived_at", "client_id", "kind", "value", "props").distinct()
    e, known = micros(F.col("ts")), micros(F.col("arrived_at")) + delay
    click = once.where("client_id is not null").select(F.col("client_id").alias("client"), e.alias("e"), F.when(known.isNotNull() & e.isNotNull(), F.greatest(known, e)).alias("a"), F.col("click_id").alias("tie"), *zeros(n_clicks=F.lit(1), n_purchases=F.coalesce((F.col("kind") == "purchase").cast("int"), F.lit(0)), click_cents=cents(F.col("value"))))
    click = click.where("e is not null and a is not null")
    e, known = micros(F.col("sold_at")), micros(F.col("arrived_at")) + delay
    sale = sales.where("client_id is not null and sold_at is not null").select("sale_id", F.col("client_id").alias("client"), e.alias("e"), F.when(known.isNotNull(), F.greatest(known, e)).alias("a"), cents(F.col("total")).alias("c"))
    sale = staged(sale, "pit-sales")
    t = F.col("e") + F.pmod(F.crc32(F.coalesce(F.col("sale_id").cast("string"), F.lit(""))), F.lit(jitter_seconds)) * 1_000_000
    queries = sale.select("client", F.monotonically_increasing_id().alias("row"), F.coalesce("sale_id", F.lit(_NO_ID)).alias("key"), t.alias("t"))
    none = F.lit(None).cast("long").alias("tie")
    sold = sale.where("a is not null").select("client", "e", "a", none, *zeros(n_sales=F.lit(1), sale_cents=F.col("c")))
    # a sale is ahead of t from horizon_days before it until it happens: as a window of the first length that ends then
    shift = windows[0] * DAY
    ahead = sale.select("client", (F.col("e") - shift).alias("e"), (F.col("e") - horizon_days * DAY).alias("a"), none, *zeros(n_future=F.lit(1)))
    # lines of a sale that were shipped at one time are one point: a sale may have a third of all lines
    shipped = lines.where("sale_id is not null and shipped_at is not null")
    shipped = shipped.select("sale_id", "item_id", micros(F.col("shipped_at")).alias("s"), cents(F.col("amount")).alias("c"))
    at_once = shipped.groupBy("sale_id", "s", "item_id").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c"))
    line = staged(at_once.join(sale.where("a is not null").select("sale_id", "client", "e", "a"), "sale_id").select("client", "item_id", "e", F.greatest("a", "s").alias("a"), "n", "c"), "pit-lines")
    widths = widths_of(click.select("client", "e").unionAll(sale.select("client", "e")).unionAll(line.select("client", "e")), queries, cap)
    items = latest_known(line.where("item_id is not null").select("client", F.col("item_id").alias("value"), "e", "a"), widths)
    points = click.select("client", "e", "a", "tie", *WEIGHTS).unionAll(sold).unionAll(ahead)
    of_lines = zeros(n_lines=F.col("n"), line_cents=F.col("c"))
    both = line.select("client", "e", "a", *of_lines).unionAll(items.select("client", "e", "a", *zeros(n_items=F.col("n"))))
    points = points.unionAll(both.groupBy("client", "e", "a").agg(*(F.sum(c).alias(c) for c in WEIGHTS)).select("client", "e", "a", none, *WEIGHTS))
    out = window_features(points, queries, widths, windows, WEIGHTS, ("n_future",), cap)
    shown = [F.col(c) for c in ("n_clicks", "n_purchases", "click_cents")]
    sale_id, last = F.when(F.col("key") != _NO_ID, F.col("key")).alias("sale_id"), F.when(F.col("last") >= 0, F.col("last")).alias("last_click_id")
    return out.select(sale_id, F.col("d").cast("int").alias("d"), F.col("t").alias("t_us"), (F.col("n_future") > 0).alias("label"), *shown, last, "n_sales", "sale_cents", "n_lines", "n_items", "line_cents")
