"""Python data sources: the rows of a remote set by pages, and the files of a taxonomy, read in tasks.

A remote set is served as many public servers of data sets do: GET {url}/rows with dataset, config, split, offset and
length answers a JSON object with `features` (name and type), `rows` (each with row_idx and row) and `num_rows_total`.
The driver asks for one row, to learn schema and number of rows; partitions are ranges of rows, whose pages tasks ask for.
Filters on the row's number are pushed: pages outside are not asked for. What is asked is tried again after a pause,
which the server may name, if it is busy or gone.
"""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: Rows of a request, and requests of a partition.
PAGE, PAGES = 100, 10
#: The longest pause between two tries, in seconds.
PAUSE = 30.0
ROW = "row_idx"

# Names of simple types in answers of such servers.
TYPES = {
    "string": T.StringType(), "large_string": T.StringType(), "bool": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(),
    "int32": T.IntegerType(), "int64": T.LongType(), "float32": T.FloatType(), "float64": T.DoubleType(),
}


def fetched(url: str, headers: dict[str, str], retries: int, timeout: float) -> Any:
    """The JSON that a URL answers with; busy and missing servers are asked again, other errors are final."""
    for attempt in range(retries + 1):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as answer:
                return json.load(answer)
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            busy = not isinstance(e, urllib.error.HTTPError) or e.code == 429 or e.code >= 500
            if not busy or attempt == retries:
                raise
            wait = e.headers.get("Retry-After") if isinstance(e, urllib.error.HTTPError) else None
            time.sleep(min(PAUSE, float(wait) if wait and wait.isdigit() else 0.5 * 2**attempt * random.uniform(0.5, 1.5)))
    raise AssertionError


@dataclass(frozen=True)
class RemoteSet:
    """Where a set is, and how it is asked for."""

    url: str
    dataset: str
    config: str = "default"
    split: str = "train"
    page: int = PAGE
    pages: int = PAGES
    retries: int = 5
    timeout: float = 60.0
    token: str = ""

    @classmethod
    def of(cls, options: dict[str, str]) -> RemoteSet:
        if "url" not in options or "dataset" not in options:
            raise ValueError("a remote set needs url and dataset")
        kinds = {"page": int, "pages": int, "retries": int, "timeout": float}
        given = {k: kinds.get(k, str)(v) for k, v in options.items() if k in cls.__dataclass_fields__}
        out = cls(**given)
        if out.page < 1 or out.pages < 1:
            raise ValueError("page and pages are at least 1")
        return out

    def rows(self, offset: int, length: int) -> dict:
        query = urllib.parse.urlencode({"dataset": self.dataset, "config": self.config, "split": self.split, "offset": offset, "length": length})
        return fetched(f"{self.url.rstrip('/')}/rows?{query}", {"Authorization": f"Bearer {self.token}"} if self.token else {}, self.retries, self.timeout)


def kind_of(feature: Any) -> T.DataType:
    """The type of a feature: simple, a sequence, or a mapping of further features."""
    if isinstance(feature, list):
        return T.ArrayType(kind_of(feature[0]))
    if isinstance(feature, dict) and "dtype" in feature:
        return TYPES.get(feature["dtype"], T.StringType())
    if isinstance(feature, dict) and "feature" in feature:
        return T.ArrayType(kind_of(feature["feature"]))
    if isinstance(feature, dict) and "_type" in feature:  # classes are numbers, whatever else is text
        return T.LongType() if feature["_type"] == "ClassLabel" else T.StringType()
    return T.StructType([T.StructField(k, kind_of(v)) for k, v in feature.items()])


@dataclass
class Rows(InputPartition):
    start: int
    stop: int


class RemoteReader(DataSourceReader):
    def __init__(self, source: RemoteSet, schema: T.StructType):
        self.source, self.schema, self.low, self.high = source, schema, 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes bounds on the row's number; all else stays with Spark."""
        for f in filters:
            bound = {GreaterThan: (1, None), GreaterThanOrEqual: (0, None), LessThan: (None, 0), LessThanOrEqual: (None, 1), EqualTo: (0, 1)}.get(type(f))
            if bound is None or f.attribute != (ROW,) or not isinstance(f.value, int):
                yield f
                continue
            low, high = bound
            if low is not None:
                self.low = max(self.low, f.value + low)
            if high is not None:
                self.high = f.value + high if self.high is None else min(self.high, f.value + high)

    def partitions(self) -> Sequence[InputPartition]:
        total = int(self.source.rows(0, 1)["num_rows_total"])
        stop, each = total if self.high is None else min(total, self.high), self.source.page * self.source.pages
        found = [Rows(k, min(k + each, stop)) for k in range(self.low, stop, each)]
        return found or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(self.schema)
        for k in range(partition.start, partition.stop, self.source.page):
            n = min(self.source.page, partition.stop - k)
            got = self.source.rows(k, n)["rows"]
            if len(got) != n:
                raise ValueError(f"{len(got)} rows from {k}, {n} were asked for")
            made = [{**r["row"], ROW: r["row_idx"]} for r in got]
            yield pa.RecordBatch.from_pylist([{f.name: _fitted(r.get(f.name), f.dataType) for f in self.schema} for r in made], kind)


def _fitted(value: Any, kind: T.DataType) -> Any:
    """A value of JSON as one of a type: structures that have no type of their own are text."""
    if isinstance(kind, T.StringType) and value is not None and not isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(kind, T.ArrayType) and isinstance(value, list):
        return [_fitted(v, kind.elementType) for v in value]
    if isinstance(kind, T.StructType) and isinstance(value, dict):
        return {f.name: _fitted(value.get(f.name), f.dataType) for f in kind}
    return float(value) if isinstance(kind, (T.DoubleType, T.FloatType)) and isinstance(value, int) else value


class RemoteRows(DataSource):
    """spark.read.format("remote_rows").options(url=, dataset=, config=, split=, page=, pages=, retries=, timeout=, token=)"""

    @classmethod
    def name(cls) -> str:
        return "remote_rows"

    def schema(self) -> T.StructType:
        found = RemoteSet.of(dict(self.options)).rows(0, 1)["features"]
        return T.StructType([T.StructField(f["name"], kind_of(f["type"])) for f in found] + [T.StructField(ROW, T.LongType())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return RemoteReader(RemoteSet.of(dict(self.options)), schema)


@dataclass
class Files(InputPartition):
    names: tuple[str, ...]


class TaxonomyReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.base = options["path"], options.get("base")
        self.strict, self.documents, self.each = options.get("strict", "false").lower() == "true", options.get("documents"), int(options.get("files", "16"))

    def partitions(self) -> Sequence[InputPartition]:
        from corpusloom.sources.files import taxonomy_files

        names, _ = taxonomy_files(self.path, self.base)
        return [Files(tuple(names[k : k + self.each])) for k in range(0, len(names), self.each)] or [Files(())]

    def read(self, partition: Files) -> Iterator[tuple]:
        from corpusloom.sources.files import fetch_documents, leaf_rows

        root = Path(self.path) if Path(self.path).is_dir() else Path(self.path).parent
        documents = (lambda source: fetch_documents(source, self.documents)) if self.documents else None
        for name in partition.names:
            yield from leaf_rows(name, root, documents, self.strict)


class TaxonomyFiles(DataSource):
    """spark.read.format("taxonomy").options(base=, strict=, documents=, files=).load(folder): files are read in tasks.

    base: only files changed against it. documents: a folder that all executors share, for the repositories that knowledge files
    name; without it documents are null. files: of a partition.
    """

    @classmethod
    def name(cls) -> str:
        return "taxonomy"

    def schema(self) -> str:
        from corpusloom.sources.files import LEAF

        return LEAF

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return TaxonomyReader(dict(self.options))


#: Settings that the sources need: filters are only pushed to Python where that is allowed.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def register(spark: SparkSession) -> SparkSession:
    """Makes the sources known to a session."""
    for source in (RemoteRows, TaxonomyFiles):
        spark.dataSource.register(source)
    spark.conf.set(PUSHDOWN, "true")
    return spark


def read_remote(spark: SparkSession, url: str, name: str, **options: Any) -> DataFrame:
    """The rows of a remote set. name: dataset, dataset:split or dataset:config:split."""
    dataset, *rest = name.split(":")
    chosen = dict(zip(("split",) if len(rest) == 1 else ("config", "split"), rest, strict=False))
    return register(spark).read.format(RemoteRows.name()).options(url=url, dataset=dataset, **chosen, **{k: str(v) for k, v in options.items()}).load()
