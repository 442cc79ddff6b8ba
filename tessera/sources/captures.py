"""A data source of captured fetches: logs of attempts, read as pages, in batches or as a stream.

A log is a file of JSON lines (page_id, url, status, html), an attempt each; the attempts at one page stand together, in
order. Logs are named in the order in which they were written. Batch: ``spark.read.format("captures").option("path", folder).load()``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Attempts at a page that count, the first one among them.
ATTEMPTS = 3
SCHEMA = "page_id long, url string, status int, attempts int, html string"
_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("status", pa.int32()), ("attempts", pa.int32()), ("html", pa.string())])
#: Bytes of a log that make a batch of rows, about.
_STEP = 8 << 20


def fetched(tries: Iterator[dict], most: int = ATTEMPTS) -> tuple:
    """A row of SCHEMA from the attempts at one page: the first that was answered with 200 to 299 and a page, of ``most``; else the last of these, without html."""
    for n, one in enumerate(tries, 1):
        good = one.get("html") is not None and 200 <= (one.get("status") or 0) < 300
        if good or n == most:
            break
    return one.get("page_id"), one.get("url"), one.get("status"), n, one["html"] if good else None


def _lines(system: fs.FileSystem, path: str) -> Iterator[dict]:
    """The attempts of a log; lines that aren't JSON objects are no attempts."""
    with system.open_input_stream(path, compression=None) as stream:
        rest = b""
        while block := stream.read(1 << 20):
            *whole, rest = (rest + block).split(b"\n")
            yield from filter(None, map(_object, whole))
        yield from filter(None, [_object(rest)])


def _object(line: bytes) -> dict | None:
    try:
        found = json.loads(line)
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


class _Log(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reading:
    """Lists and reads the logs of a folder, of any file system that pyarrow opens."""

    def __init__(self, options: dict):
        self.folder, self.most = options["path"].rstrip("/"), int(options.get("attempts", ATTEMPTS))

    def names(self) -> list[str]:
        system, path = fs.FileSystem.from_uri(self.folder if "://" in self.folder else "file://" + self.folder)
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return sorted(f.base_name for f in found if f.is_file and not f.base_name.startswith(("_", ".")))

    def read(self, partition: _Log | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without logs
            return
        system, path = fs.FileSystem.from_uri(self.folder if "://" in self.folder else "file://" + self.folder)
        rows, size = [], 0
        for _, tries in groupby(_lines(system, f"{path}/{partition.path}"), key=lambda t: (t.get("page_id"), t.get("url"))):
            rows.append(fetched(tries, self.most))
            size += len(rows[-1][4] or "") + 100
            if size > _STEP:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class _Batch(_Reading, DataSourceReader):
    def partitions(self) -> list[_Log]:
        return [_Log(n) for n in self.names()]


class _Stream(_Reading, DataSourceStreamReader):
    """An offset is the name of the last log that was read; logs that come later have greater names."""

    def initialOffset(self) -> dict:
        return {"last": ""}

    def latestOffset(self) -> dict:
        return {"last": max(self.names(), default="")}

    def partitions(self, start: dict, end: dict) -> list[_Log]:
        return [_Log(n) for n in self.names() if start["last"] < n <= end["last"]]

    def commit(self, end: dict) -> None:
        pass


class Captures(DataSource):
    """Options: path (a folder that all tasks see), attempts (3)."""

    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format ``captures`` known to a session."""
    spark.dataSource.register(Captures)
