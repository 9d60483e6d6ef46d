"""Writes to keyed tables: upserts, updates, and deletes that take children along.

Tables are replaced, not changed in place: an operator returns the new rows, ``Library`` writes those of the touched key
buckets to a new folder and then points at it, so that nobody reads a half-written table.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.schema import CHILDREN, KEYS, TABLES
from vellum.staging import staged


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows of new, and those of old whose key new lacks; of equal keys in new, one."""
    return old.join(new, list(keys), "left_anti").unionByName(new.dropDuplicates(list(keys)), allowMissingColumns=True)


def replace_group(old: DataFrame, new: DataFrame, group: str = "paper_id") -> DataFrame:
    """All rows of each group that new has are new's."""
    return old.join(new.select(group).distinct(), group, "left_anti").unionByName(new)


def update(df: DataFrame, where: Column, **values) -> DataFrame:
    """Columns set in the rows that meet a condition; a value None leaves its column alone."""
    return df.withColumns({c: F.when(where, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items() if v is not None})


def set_status(papers: DataFrame, paper_id: str, status: str, error: str | None = None, retry_count: int | None = None) -> DataFrame:
    """A paper's status and error; the retry count only if it is given."""
    mine = F.col("id") == paper_id
    out = update(papers, mine, status=status, retry_count=retry_count)
    return out.withColumn("error_message", F.when(mine, F.lit(error)).otherwise(F.col("error_message")))


def delete(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows whose column is not among ``id`` of ids."""
    return df.join(ids.select(F.col("id").alias("__d")), F.col(column) == F.col("__d"), "left_anti")


def delete_papers(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The tables without some papers and all that belongs to them."""
    return {name: delete(df, ids, "id") if name == "papers" else delete(df, ids, "paper_id") if name in CHILDREN else df for name, df in tables.items()}


def append_numbered(old: DataFrame, new: DataFrame, order: str, key: str = "id") -> DataFrame:
    """new appended with ids after the largest, in order.

    Rows are sorted over all tasks; a row's number is its place in its partition after the sizes of those before, of which
    there is one row a partition."""
    last = old.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    placed = new.orderBy(order).withColumn("__m", F.monotonically_increasing_id())
    placed = staged(placed, "tables-placed")
    part = F.shiftright("__m", 33)
    sizes = placed.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    numbered = placed.withColumn("__p", part).join(sizes.select("__p", before.alias("__o")), "__p")
    numbered = numbered.withColumn(key, (F.lit(last) + F.col("__o") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("long"))
    return old.unionByName(numbered.drop("__m", "__p", "__o"), allowMissingColumns=True)


#: Buckets that a table's keys are dealt into; a change rewrites the buckets it touches.
BUCKETS = 64
#: Versions of the pointer that stay readable for those who opened them.
KEPT_VERSIONS = 3


@dataclass
class Library:
    """The tables under a folder.  A table is a list of parts, each a folder with some of its key buckets; a pointer
    ``current-N.json`` names the parts in force, and the largest N counts.

    A change writes new parts, then a new pointer under a name of its own: it is created once, by a rename from a temporary
    name, so a crash at any point leaves the last pointer in force.  Parts that no kept pointer names are deleted."""

    spark: SparkSession
    path: str
    parts: dict[str, dict[str, str]] = field(default_factory=dict)
    version: int = 0

    def _fs(self):
        jvm = self.spark._jvm
        return jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _pointers(self) -> list[int]:
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.path))]
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"current-(\d+)\.json", n)))

    def _pointer(self, version: int) -> dict[str, dict[str, str]]:
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/current-{version}.json").collect()))

    def open(self) -> Library:
        if found := self._pointers():
            self.version = found[-1]
            self.parts = self._pointer(self.version)
        return self

    @property
    def versions(self) -> dict[str, int]:
        """The tables there are, with the version that was opened or written."""
        return dict.fromkeys(self.parts, self.version)

    def table(self, name: str, buckets: set[int] | None = None) -> DataFrame:
        """A table, or the rows of some of its key buckets."""
        folders = sorted({f"{part}/b={b}" for b, part in self.parts.get(name, {}).items() if buckets is None or int(b) in buckets})
        if not folders:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*(f"{self.path}/{name}/{f}" for f in folders))

    @staticmethod
    def _bucket(keys: tuple[str, ...]) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")

    def _write(self, changes: dict[str, tuple[DataFrame, set[int] | None]]) -> None:
        version, parts = max([self.version, *self._pointers()]) + 1, {k: dict(v) for k, v in self.parts.items()}
        fs, path = self._fs()
        for name, (df, touched) in changes.items():
            folder = f"{self.path}/{name}/p{version}-{uuid.uuid4().hex[:8]}"
            df.select(TABLES[name].names).withColumn("b", self._bucket(KEYS[name])).repartition("b").write.partitionBy("b").parquet(folder)
            written = [s.getPath().getName()[2:] for s in fs.listStatus(path(folder)) if s.getPath().getName().startswith("b=")]
            kept = {b: p for b, p in parts.get(name, {}).items() if touched is not None and int(b) not in touched}
            parts[name] = kept | dict.fromkeys(written, folder.rpartition("/")[2])
        hidden = path(f"{self.path}/_next-{uuid.uuid4().hex}")
        out = fs.create(hidden, False)
        out.write(bytearray(json.dumps(parts).encode()))
        out.close()
        if not fs.rename(hidden, path(f"{self.path}/current-{version}.json")):
            raise RuntimeError(f"version {version} was written by another")
        self.version, self.parts = version, parts
        self._forget()

    def _forget(self) -> None:
        """Deletes old pointers, and parts that none of the others names."""
        fs, path = self._fs()
        found = self._pointers()
        for v in found[:-KEPT_VERSIONS]:
            fs.delete(path(f"{self.path}/current-{v}.json"), False)
        named: dict[str, set[str]] = {}
        for v in found[-KEPT_VERSIONS:]:
            for name, of in self._pointer(v).items():
                named.setdefault(name, set()).update(of.values())
        for name, have in named.items():
            for s in fs.listStatus(path(f"{self.path}/{name}")) if fs.exists(path(f"{self.path}/{name}")) else ():
                if s.getPath().getName() not in have:
                    fs.delete(s.getPath(), True)

    def replace(self, **tables: DataFrame) -> None:
        """Writes some tables anew, then switches to all of them at once."""
        self._write({name: (df, None) for name, df in tables.items()})

    def upsert(self, name: str, new: DataFrame) -> None:
        """Rewrites the buckets that hold a key of new."""
        touched = {r[0] for r in new.select(self._bucket(KEYS[name])).distinct().collect()}
        if touched:
            self._write({name: (upsert(self.table(name, touched), new, KEYS[name]), touched)})

    def delete_papers(self, ids: DataFrame) -> None:
        have = {name: self.table(name) for name in ("papers", *CHILDREN) if name in self.parts}
        self.replace(**delete_papers(have, ids))

    def clear(self) -> None:
        self.replace(**{name: self.spark.createDataFrame([], TABLES[name]) for name in self.parts})
