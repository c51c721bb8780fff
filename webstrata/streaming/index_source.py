"""The capture index as a stream: a data source whose offsets are resume keys.

An index is a folder of windows; a window is a chain of pages, each named by the resume key it is asked with and ending in
the key of the next one (``[]``, ``[key]`` behind its rows), until a page without one. A batch takes up to ``pages_per_batch`` pages of
every window that is not at its end, one task each. The offset holds each window's next key, or none at its end; Spark writes it
to its log before the batch and the batch's number with the rows, so a restart asks each page exactly once more or not at all.
Windows may be added while the stream runs. Pages can lie in any store that Arrow opens by address.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FIRST = "start"
#: Bytes at the end of a page that hold a resume key of usual length, and its form: a quote behind a bracket opens a string there, as one within a string is escaped.
TAIL = 4096
_RESUME = re.compile(r'\]\s*,\s*\[\s*\]\s*,\s*(\[\s*"(?:[^"\\]|\\.)*"\s*\])\s*\]\s*$')


class _Index:
    """Pages of a folder ``window=../key=../<one file>``."""

    def __init__(self, path: str):
        self.files, self.root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")

    def windows(self) -> list[str]:
        found = self.files.get_file_info(fs.FileSelector(self.root, allow_not_found=True))
        return sorted(f.base_name.partition("=")[2] for f in found if f.type == fs.FileType.Directory and f.base_name.startswith("window="))

    def _file(self, window: str, key: str) -> str:
        parts = self.files.get_file_info(fs.FileSelector(f"{self.root}/window={window}/key={key}"))
        names = [p.path for p in parts if p.is_file and not p.base_name.startswith(("_", "."))]
        if len(names) != 1:
            raise ValueError(f"the index has {len(names)} pages for window {window}, key {key}")
        return names[0]

    def page(self, window: str, key: str) -> str:
        with self.files.open_input_stream(self._file(window, key), compression=None) as f:
            return f.read().decode("utf-8")

    def after(self, window: str, key: str) -> str | None:
        """The key of the next page. Only the end of a page is read, but of the last one of a window."""
        with self.files.open_input_file(self._file(window, key)) as f:
            size = f.size()
            f.seek(max(0, size - TAIL))
            end = f.read().decode("utf-8", "ignore")  # may begin within a character
        found = _RESUME.search(end)
        return json.loads(found[1])[0] if found else next_key(self.page(window, key))


def next_key(page: str) -> str | None:
    """The resume key at the end of a page, if it has one; only the end is read, if it has the usual form."""
    found = _RESUME.search(page, max(0, len(page) - TAIL))
    if found:
        return json.loads(found[1])[0]
    rows = json.loads(page)
    return rows[-1][0] if len(rows) >= 3 and rows[-2] == [] and len(rows[-1]) == 1 else None


class _Chain(InputPartition):
    def __init__(self, window: str, begin: str, end: str | None):
        super().__init__((window, begin, end))


class IndexReader(DataSourceStreamReader):
    def __init__(self, path: str, pages_per_batch: int):
        self.path, self.pages = path, pages_per_batch
        self.reached: dict[str, str | None] = {}

    def initialOffset(self) -> dict:
        return {"windows": {}}

    def latestOffset(self) -> dict:
        index = _Index(self.path)
        reached = dict(self.reached)
        for window in index.windows():
            key = reached.get(window, FIRST)
            for _ in range(self.pages):
                if key is None:
                    break
                key = index.after(window, key)
            reached[window] = key
        return {"windows": reached}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.reached = dict(end["windows"])  # after a restart, Spark tells here how far it was
        begin = start["windows"]
        return [_Chain(w, begin.get(w, FIRST), key) for w, key in end["windows"].items() if begin.get(w, FIRST) != key]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        window, key, end = partition.value
        index = _Index(self.path)
        while key is not None and key != end:
            page = index.page(window, key)
            yield window, key, page
            key = next_key(page)

    def commit(self, end: dict) -> None:
        pass


class CaptureIndex(DataSource):
    @classmethod
    def name(cls) -> str:
        return "capture_index"

    def schema(self) -> str:
        return "window string, page string, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return IndexReader(self.options["path"], int(self.options.get("pages_per_batch", "10")))


def index_stream(spark: SparkSession, path: str, pages_per_batch: int = 10) -> DataFrame:
    """(window, page, value): pages as ``sources.cdx.parse_json`` takes them."""
    spark.dataSource.register(CaptureIndex)
    return spark.readStream.format("capture_index").option("path", path).option("pages_per_batch", pages_per_batch).load()


def pages_to_end(stream: DataFrame, path: str) -> DataFrame:
    """Run the stream until its source has nothing more; each batch writes a folder by its number, so a repeated batch changes nothing."""
    spark, schema = stream.sparkSession, stream.schema

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/generation={epoch}")

    running = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").start()
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{path}/rows")
