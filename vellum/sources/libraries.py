"""Remote libraries as Spark data sources: paged listings read in parallel, and a stream whose offset is the library's
version.  Network calls are injected as a callable, which must be picklable."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

ITEM = "key string, version long, item_type string, title string, doi string, url string, abstract_note string, date string, tags array<string>, collections array<string>, file_path string"
COLUMNS = tuple(c.split()[0] for c in ITEM.split(", "))
PAGE = 100
#: Entries that are no papers.
NOT_PAPERS = ("attachment", "note", "annotation")
#: fetch(start, limit, since) -> {"items": [...], "total": n, "version": v}
Fetch = Callable[[int, int, int], dict]
#: search(collection or None, limit, offset) -> ids, the latest first
Search = Callable[[str | None, int, int], list[str]]
#: Pages of one collection.
MOST_PAGES = 100


def _row(item: dict) -> tuple:
    return tuple(item.get(c) if c not in ("tags", "collections") else list(item.get(c) or []) for c in COLUMNS)


class _Pages(DataSourceReader):
    def __init__(self, fetch: Fetch, since: int):
        self.fetch, self.since = fetch, since

    def partitions(self) -> list[InputPartition]:
        total = self.fetch(0, 1, self.since)["total"]
        return [InputPartition(start) for start in range(0, total, PAGE)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for item in self.fetch(partition.value, PAGE, self.since)["items"]:
            yield _row(item)


class _Changes(SimpleDataSourceStreamReader):
    """Items newer than the offset; the offset never goes back, and stays where a listing is incomplete."""

    def __init__(self, fetch: Fetch):
        self.fetch = fetch

    def initialOffset(self) -> dict:  # noqa: N802
        return {"version": 0}

    def _listed(self, since: int) -> tuple[list[tuple], int]:
        items, start, version = [], 0, since
        while True:
            page = self.fetch(start, PAGE, since)
            items += page["items"]
            version = max(version, page.get("version") or 0)
            start += PAGE
            if start >= page["total"]:
                return [_row(x) for x in items], version if len(items) >= page["total"] else since

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, version = self._listed(start["version"])
        return iter(rows), {"version": version}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        rows, _ = self._listed(start["version"])
        return (r for r in rows if r[1] <= end["version"])


def library_source(name: str, fetch: Fetch) -> type[DataSource]:
    """A data source class to register: ``spark.dataSource.register(library_source("papers", fetch))``."""

    class Library(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return ITEM

        def reader(self, schema) -> DataSourceReader:
            return _Pages(fetch, int(self.options.get("since", "0")))

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
            return _Changes(fetch)

    return Library


class _Collections(DataSourceReader):
    """A partition per collection, each listed page by page to its end, as its size is not known before."""

    def __init__(self, search: Search, collections: list[str | None], page: int, most: int):
        self.search, self.collections, self.page, self.most = search, collections, page, most

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(len(self.collections))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        name, place = self.collections[partition.value], 0
        for _ in range(self.most):
            found = self.search(name, self.page, place)
            for item_id in found:
                yield partition.value, place, item_id
                place += 1
            if len(found) < self.page:
                return
        raise RuntimeError(f"collection {name or '(all)'} has not ended after {self.most} pages: a partial listing would pass for deletions")


def collection_source(name: str, search: Search, most: int = MOST_PAGES) -> type[DataSource]:
    """A data source of a service that lists ids by collection; option ``collections`` is a JSON list of them, without
    which the whole library is one listing.  A listing that ``most`` pages do not end is an error."""

    class Collections(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "collection int, place long, id string"

        def reader(self, schema) -> DataSourceReader:
            return _Collections(search, json.loads(self.options.get("collections", "null")) or [None], int(self.options.get("page", PAGE)), most)

    return Collections


def enumerated(spark: SparkSession, name: str, collections: list[str] | None = None, page: int = PAGE) -> DataFrame:
    """``id, collection, place``: every id of the collections once, where it is listed first; collections count from 0
    in the order given.  None stands for the whole library, an empty list for nothing."""
    listed = spark.read.format(name).option("page", page)
    if collections:
        listed = listed.option("collections", json.dumps(collections))
    found = listed.load() if collections is None or collections else listed.load().limit(0)
    first = found.groupBy("id").agg(F.min(F.struct("collection", "place")).alias("at"))
    return first.select("id", "at.collection", "at.place")


def items(spark: SparkSession, name: str, since: int = 0) -> DataFrame:
    """The papers of a registered library."""
    return spark.read.format(name).option("since", since).load().where(~F.col("item_type").isin(*NOT_PAPERS))


def item_papers(found: DataFrame) -> DataFrame:
    """Items as paper rows: trimmed title, '' as null, tags as keywords, the external key as source."""
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    return found.select(F.sha2("key", 256).substr(1, 16).alias("id"), text("title").alias("title"), text("doi").alias("doi"), text("abstract_note").alias("abstract_text"), F.coalesce("tags", F.array().cast("array<string>")).alias("keywords"), text("date").alias("published_date"), F.col("key").alias("source"), "file_path", "version")


def conversion_reply(raw):
    """``markdown, figures`` of a converter's JSON reply, under whichever of the known names they stand."""
    at = lambda *paths: F.coalesce(*(F.get_json_object(raw, p) for p in paths))
    return F.struct(at("$.md_content", "$.markdown", "$.data.markdown", "$.results[0].md_content").alias("markdown"), F.from_json(at("$.images", "$.data.images", "$.results[0].images"), "map<string,string>").alias("images"))


def reply_of(**fields) -> str:
    """A reply as the converters send it, for tests."""
    return json.dumps(fields)
