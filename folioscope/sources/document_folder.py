"""A folder of documents, one JSON file each, as a Spark data source.

``spark.dataSource.register(DocumentFolder)``, then::

    spark.read.format("document_folder").load(folder).where(F.col("document_id").isin(...))
    rows.write.format("document_folder").mode("append").save(folder)

Reading gives (document_id, body): the file's text, checked by the one who parses it.
A filter on document_id by equality or a list names the files, and only these are opened;
the folder isn't even listed. Otherwise its files are dealt to partitions of ``files``
(option, 64) each.

Writing replaces single documents: each task writes beside the old file, under a name
of its own; the commit, once all tasks are done, moves the new files over the old ones,
each at once. A write that fails or is killed before it leaves the old documents as
they were; leftovers are removed by the abort, or passed over by readers. ``overwrite``
also removes the documents that were not written.

The folder must be one that driver and executors share as a file system; other stores
are read by :func:`readers.document_store`. Defined cases: an id that has no file gives
no row; ids are quoted, so any text can be one; of a document written twice in one
write the last part's file stays; a null id or body is an error.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

SUFFIX, PENDING = ".json", ".pending"
FILES = 64


def folder_of(options: dict) -> str:
    path = options.get("path")
    if not path:
        raise ValueError("document_folder needs a path")
    parsed = urlparse(path)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"{path}: not a shared file system")
    return parsed.path


def file_name(document_id: str) -> str:
    return quote(document_id, safe=" ") + SUFFIX


class DocumentFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return "document_folder"

    def schema(self) -> str:
        return "document_id string, body string"

    def reader(self, schema: StructType) -> Reader:
        return Reader(folder_of(self.options), int(self.options.get("files", FILES)))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(folder_of(self.options), overwrite)


@dataclass
class Names(InputPartition):
    names: list[str]


class Reader(DataSourceReader):
    def __init__(self, folder: str, files: int):
        self.folder, self.files = folder, max(1, files)
        self.ids: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if f.attribute != ("document_id",) or wanted is None:
                yield f
                continue
            wanted.discard(None)
            self.ids = wanted if self.ids is None else self.ids & wanted

    def partitions(self) -> list[Names]:
        if self.ids is not None:
            names = [file_name(i) for i in sorted(self.ids)]
        else:
            names = sorted(n for n in os.listdir(self.folder) if n.endswith(SUFFIX))
        return [Names(names[k : k + self.files]) for k in range(0, len(names), self.files)] or [Names([])]

    def read(self, partition: Names) -> Iterator[tuple[str, str]]:
        for name in partition.names:
            try:
                with open(os.path.join(self.folder, name), encoding="utf-8") as f:
                    yield unquote(name.removesuffix(SUFFIX)), f.read()
            except FileNotFoundError:
                continue


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class Writer(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite = folder, overwrite
        self.run = uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Written:
        os.makedirs(self.folder, exist_ok=True)
        task, files = uuid.uuid4().hex, []
        for k, row in enumerate(rows):
            if row.document_id is None or row.body is None:
                raise ValueError("a document needs an id and a body")
            # Attempts of one task have names of their own, so that a lost one harms no other.
            pending = os.path.join(self.folder, f".{self.run}-{task}-{k}{PENDING}")
            with open(pending, "w", encoding="utf-8") as f:
                f.write(row.body)
                f.flush()
                os.fsync(f.fileno())
            files.append((pending, file_name(row.document_id)))
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        kept = set()
        for message in filter(None, messages):
            for pending, name in message.files:
                os.replace(pending, os.path.join(self.folder, name))
                kept.add(name)
        if self.overwrite and os.path.isdir(self.folder):
            for name in os.listdir(self.folder):
                if name.endswith(SUFFIX) and name not in kept:
                    os.remove(os.path.join(self.folder, name))
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Remove what this run left pending, lost attempts' files too."""
        if os.path.isdir(self.folder):
            for name in os.listdir(self.folder):
                if name.startswith(f".{self.run}-") and name.endswith(PENDING):
                    os.remove(os.path.join(self.folder, name))


def documents(spark: SparkSession, folder: str, files: int = FILES) -> DataFrame:
    """(document_id, body) of a folder; filters on the id reach the files."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DocumentFolder)
    return spark.read.format("document_folder").option("files", files).load(folder)


def replace_documents(rows: DataFrame, folder: str, whole: bool = False) -> None:
    """Write (document_id, body), each document at once; with ``whole`` the folder then holds these alone."""
    rows.sparkSession.dataSource.register(DocumentFolder)
    rows.select("document_id", "body").write.format("document_folder").mode("overwrite" if whole else "append").save(folder)


def pages_of(documents: DataFrame) -> DataFrame:
    """Pages of (document_id, body) as :func:`readers.document_store` gives them; a broken body is an error."""
    from pyspark.sql import functions as F

    from folioscope.sources.readers import DOCUMENT, document_pages

    return document_pages(documents.select(F.from_json("body", DOCUMENT, {"mode": "FAILFAST"}).alias("d")).select("d.*"))
