"""Point-in-time features against brute force and SQL, with clients cut into slices and slices dealt to shards."""

import random
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from vellum.llm import pointintime
from vellum.llm import queries as corpus

DATA = "/root/testdata/sf0.001"
NAME = "op11_persistent_tree_features"
TABLES = ("clicks", "sales", "sale_lines")


def by_sql(tables):
    con = duckdb.connect()
    for name, table in tables.items():
        con.register(f"given_{name}", table)
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM given_{name}")
    cursor = con.execute(corpus.SQL[NAME])
    return [c[0] for c in cursor.description], sorted(map(repr, cursor.fetchall()))


def shown(df, columns):
    return sorted(repr(tuple(r)) for r in df.select(*columns).collect())


@pytest.mark.parametrize(("cap", "dense"), [(20_000, 8), (60, 8), (15, 1)])
def test_shop_features_agree_with_sql(spark, cap, dense, monkeypatch):
    monkeypatch.setattr(pointintime, "DENSE", dense)
    monkeypatch.setattr(pointintime, "BLOCK", 8)
    tables = {t: spark.read.parquet(f"{DATA}/{t}.parquet") for t in TABLES}
    columns, want = by_sql({t: pq.read_table(f"{DATA}/{t}.parquet") for t in TABLES})
    assert shown(pointintime.shop_features(*tables.values(), cap=cap), columns) == want


def test_hot_instants_ties_and_awkward_rows(spark, monkeypatch):
    """Most rows have one client, and many of its lines are shipped, and leave, at one instant."""
    monkeypatch.setattr(pointintime, "DENSE", 1)
    r, start = random.Random(8), datetime(2024, 1, 1)
    at = lambda days: start + timedelta(seconds=r.randrange(int(days * 86400)))
    none = lambda x, p=0.05: None if r.random() < p else x
    clicks = [(i, none(t := at(30)), none(t + timedelta(minutes=r.choice([-90, 0, 5, 9000]))) if t else None, none(r.choice([7, 7, 7, 8, 9])), none(r.choice(["view", "purchase"])), none(r.random() * 90), "x") for i in range(400)]
    clicks += [(500 + k, start + timedelta(days=3), start + timedelta(days=3), 7, "view", 1.005, "tie") for k in range(9)]
    clicks += clicks[:40]
    sales = [(i, none(r.choice([7, 7, 7, 8, 10])), "done", none(r.random() * 900), none(t := at(30)), none(t + timedelta(minutes=r.choice([0, 3, 4000, 30000]))), 1) for i in range(300)]
    lines = [(none(r.choice([7, 7, *range(300)])), k, none(r.choice([1, 1, 1, *range(40)])), 1, 1, none(r.random() * 50), 0.0, "kept", none(start + timedelta(days=r.randrange(40)))) for k in range(1500)]
    lines += lines[:100]
    schemas = {
        "clicks": "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string",
        "sales": "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int",
        "sale_lines": "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz",
    }
    frames = {n: spark.createDataFrame(rows, schemas[n]) for n, rows in zip(TABLES, (clicks, sales, lines), strict=True)}
    columns, want = by_sql({n: f.toArrow() for n, f in frames.items()})
    named = [f.withColumn("client", f[f.columns[0]]).withColumn("e", f[f.columns[0]]).withColumn("slice", f[f.columns[0]]) for f in frames.values()]
    for cap in (10, 40):
        assert shown(pointintime.shop_features(*named, cap=cap), columns) == want
    none_at_all = [f.where("false") for f in frames.values()]
    assert pointintime.shop_features(*none_at_all).count() == 0
    alone = pointintime.shop_features(none_at_all[0], frames["sales"], none_at_all[2]).collect()
    assert len(alone) == 2 * sum(s[1] is not None and s[4] is not None for s in sales)
    assert all(x.n_clicks == 0 and x.last_click_id is None and x.n_lines == 0 for x in alone)


def test_one_full_instant_does_not_cut_all_time_into_minutes(spark):
    day = 86_400_000_000
    rows = [(1, k * day // 4) for k in range(200)] + [(1, 30 * day)] * 500 + [(2, k * day // 4) for k in range(10)]
    rows += [(3, k * day // 4) for k in range(200)] + [(3, (30 + k) * day) for k in range(2) for _ in range(500)]
    widths = {r.client: r.width for r in pointintime._widths(spark.createDataFrame(rows, "client long, at long"), 100).collect()}
    assert widths.keys() == {1, 3}
    assert 10 * day < widths[1] <= 25 * day  # 100 of the other ticks take 25 days
    assert widths[3] <= 2 * day  # full minutes that time can part stay apart


def test_persistent_tree_answers_every_version():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 5, 64, 300):
        keys, w = rng.permutation(n), rng.integers(-5, 9, (n, 3))
        versions, least = rng.integers(0, n + 1, 200), rng.integers(0, n + 2, 200)
        want = [w[:v][keys[:v] >= x].sum(0) for v, x in zip(versions, least, strict=True)]
        assert (pointintime.suffix_sums(keys, w, versions, least) == np.asarray(want).reshape(200, 3)).all()


def test_times_do_not_depend_on_the_zone_of_the_session(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-03-10 02:30:00.123456' AS ts")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert df.select(pointintime.micros(df.ts)).first()[0] == 1710037800123456
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
