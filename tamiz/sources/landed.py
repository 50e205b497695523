"""Landed pages of many scans, of which only those are opened that are asked for.

A page lies under ``portal=P/query=Q/page=N/http_status=S/newest=D``, D being the date of its newest posting as its
scan saw it. ``landed`` reads whole pages with Spark's text source: filters on these columns prune folders, so a page that they rule out is never
opened. Scans are sorted by date, so ``newest >= limit`` is the age that portals take in their URLs.

``stopping`` reads each scan in its order and ends it at its first page without a readable body; what follows isn't opened. It is a data source of its own, to
which Spark pushes filters on portal and query and upper bounds of the page; other filters can't move before the end of a scan without changing it.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, LessThan, LessThanOrEqual

KEYS = ("portal", "query", "page", "http_status", "newest")
SCHEMA = "portal string, query string, page int, http_status int, newest date, body string"
_NONE = "__HIVE_DEFAULT_PARTITION__"
_TESTS = {EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v}
_PUSHED = {"portal": (EqualTo, In), "query": (EqualTo, In), "page": (LessThan, LessThanOrEqual)}


@dataclass
class Scan(InputPartition):
    files: list[tuple[tuple, str]]

    def __post_init__(self):
        super().__init__(None)


def _keys(path: str) -> tuple | None:
    """The values that a path's folders name; none for a path of another form."""
    named = dict(p.split("=", 1) for p in path.split("/") if "=" in p)
    if not all(k in named for k in KEYS):
        return None
    value = [None if named[k] == _NONE else unquote(named[k]) for k in KEYS]
    return value[0], value[1], *(None if x is None else int(x) for x in value[2:4]), None if value[4] is None else datetime.date.fromisoformat(value[4])


class LandedReader(DataSourceReader):
    def __init__(self, options):
        self.where = options["path"]
        self.tests: list[tuple[int, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what names decide, and leaves all filters to be tested by Spark again."""
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if type(f) in _PUSHED.get(name, ()):
                self.tests.append((KEYS.index(name), type(f), f.value))
            yield f

    def _wanted(self, keys: tuple) -> bool:
        return all(keys[k] is not None and _TESTS[kind](keys[k], value) for k, kind, value in self.tests)

    def _files(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.where) if "://" in self.where or self.where.startswith("file:") else (fs.LocalFileSystem(), self.where)

    def partitions(self) -> list[Scan]:
        system, root = self._files()
        infos = system.get_file_info(fs.FileSelector(root, recursive=True))
        found = [(keys, i.path) for i in infos if i.type != fs.FileType.Directory and not i.base_name.startswith(("_", ".")) and (keys := _keys(i.path)) is not None and self._wanted(keys)]
        found.sort(key=lambda x: ((x[0][0] or "", x[0][1] or "", -1 if x[0][2] is None else x[0][2]), x[1]))
        scans: dict[tuple, list] = {}
        for keys, path in found:
            scans.setdefault(keys[:2], []).append((keys, path))
        return [Scan(files) for files in scans.values()] or [Scan([])]

    def read(self, partition: Scan) -> Iterator[pa.RecordBatch]:
        system, _ = self._files()
        for keys, path in partition.files:
            if keys[3] is None or not 200 <= keys[3] < 300:
                return
            with system.open_input_stream(path) as f:
                # The text writer ends the file with a line end of its own.
                body = f.read().decode("utf-8", "replace").removesuffix("\n")
            if not body.strip():
                return
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.date32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*keys, body), kinds)], names=[*KEYS, "body"])


class StoppingScans(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stopping_scans"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LandedReader:
        return LandedReader(self.options)


def land(pages: DataFrame, folder: str) -> None:
    """Writes pages (the columns of ``landed``; a null body as an empty one) so that each is a file of its own."""
    rows = pages.select(*KEYS, F.coalesce("body", F.lit("")).alias("body")).dropDuplicates(list(KEYS))
    rows.repartition(*KEYS[:3]).write.mode("append").partitionBy(*KEYS).text(folder)


def landed(spark: SparkSession, folder: str) -> DataFrame:
    """The pages of a folder: the keys and the whole body of each."""
    fields = SCHEMA.replace(", body string", "")
    rows = spark.read.schema(f"value string, {fields}").text(folder, wholetext=True)
    return rows.select(*KEYS, F.regexp_replace("value", r"\n\z", "").alias("body"))


def recent(rows: DataFrame, as_of_date: Column, max_days: int) -> DataFrame:
    """Pages whose newest posting is young enough, and those of unknown age."""
    return rows.where(F.col("newest").isNull() | (F.col("newest") >= F.date_sub(as_of_date, max_days)))


def stopping(spark: SparkSession, folder: str) -> DataFrame:
    """The pages of each scan up to its end.

    The filters of a query belong to the whole source: where branches of one query filter differently, give each its own call.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StoppingScans)
    return spark.read.format("stopping_scans").load(folder)
