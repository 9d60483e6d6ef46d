"""The driver's contract, the streams, and queries against their SQL."""

import math
import os
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from vellum.operators import tables
from vellum.plans import queries as library
from vellum.schema import normalised
from vellum.streaming import jobs

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def shown(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(library.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(library.SQL))
def test_query_agrees_with_sql(spark, duck, name):
    df = library.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    cursor = duck.execute(library.SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = [tuple(shown(r[names.index(c)]) for c in columns) for r in cursor.fetchall()]
    assert sorted(tuple(shown(r[c]) for c in columns) for r in df.collect()) == sorted(want)


@pytest.mark.parametrize("name", sorted(set(library.QUERIES) - set(library.SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert library.QUERIES[name](spark, DATA).count() > 0


ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def test_a_submit_while_a_retry_waits_does_not_lose_the_retry(spark, tmp_path):
    """Events come file by file; the retry's timer ends after the submit's own attempt is over."""
    spark.conf.set(*ROCKS)
    schema = "paper_id string, event string, at int"
    add = lambda n, *events: spark.createDataFrame([("a", e, k) for k, e in enumerate(events)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    add(0, "submit", "failed")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = jobs.job_queue(stream, 15_000).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck").trigger(processingTime="500 milliseconds").start(f"{tmp_path}/out")
    seen = lambda: sorted((r.action, r.attempt) for r in spark.read.schema(jobs.JOB_OUT).parquet(f"{tmp_path}/out").collect())

    def wait(n):
        for _ in range(200):
            if len(seen()) >= n:
                return
            time.sleep(0.5)

    try:
        wait(2)
        add(1, "submit", "done")
        wait(4)
        assert seen() == [("indexed", 1), ("retry", 1), ("start", 1), ("start", 1)]
        wait(5)
        assert seen() == [("indexed", 1), ("retry", 1), ("start", 1), ("start", 1), ("start", 2)]
        add(2, "submit", "exhausted")
        wait(7)
        assert ("skip", 1) in seen() and ("failed", 2) in seen()
    finally:
        q.stop()


def test_job_queue(spark, tmp_path):
    schema = "paper_id string, event string, at int"
    spark.createDataFrame([("a", "submit", 1), ("a", "submit", 2), ("a", "done", 3), ("b", "submit", 1), ("b", "failed", 2)], schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    spark.conf.set(*ROCKS)
    q = jobs.job_queue(stream, 3_600_000).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination(120)
    got = sorted((r.paper_id, r.action) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("a", "indexed"), ("a", "skip"), ("a", "start"), ("b", "retry"), ("b", "start")]


def test_embedding_stream(spark, tmp_path):
    spark.createDataFrame([("1", "alpha beta"), ("2", None)], "id string, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id string, text string").parquet(f"{tmp_path}/in")
    jobs.embed_stream(stream, f"{tmp_path}/out", f"{tmp_path}/ck", available_now=True).awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").where(F.size("vector") == 64).count() == 2


def test_rolling_metrics(spark):
    calls = library.lib.calls(spark, DATA)
    got = jobs.rolling_metrics(calls, "24 hours", "24 hours").agg(F.sum("calls")).first()[0]
    assert got == calls.count()


def test_sync_stream_reconciles_complete_listings(spark, tmp_path):
    library = tables.Library(spark, f"{tmp_path}/lib").open()
    first = normalised(spark.createDataFrame([("1", "One", "k1"), ("2", "Two", "k2"), ("3", "Own", None)], "id string, title string, source string"), "papers")
    library.replace(papers=first)
    schema = "id string, title string, source string, version long"
    spark.createDataFrame([("1", "One again", "k1", 5), ("1", "Old", "k1", 4)], schema).write.parquet(f"{tmp_path}/in")
    remote, seen = spark.createDataFrame([("k1", 5)], "key string, version long"), []
    for complete in (False, True):
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        jobs.sync_stream(stream, library, "papers", f"{tmp_path}/ck{complete}", True, lambda c=complete: (remote, c)).awaitTermination(180)
        seen.append(sorted((r.id, r.title) for r in library.table("papers").collect()))
    assert seen == [[("1", "One again"), ("2", "Two"), ("3", "Own")], [("1", "One again"), ("3", "Own")]]
