"""Folder scan: every file of a supported kind with its size, time, hash and page count.

Spark's own file sources leave out names that start with '_' or '.'; only such
*files* and a few reserved folders are to be left out here, so the folder is
listed by a Python data source and the files are read on the executors.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from leafmill.settings import RESERVED, SUFFIXES

SCHEMA = "file_index int, relpath string, path string, size_bytes bigint, modified double, page_count int, sha256 string, error string"
_PAGE = re.compile(rb"/Type\s*/Page(?![a-zA-Z])")


def natural(text: str) -> list[tuple]:
    """Python twin of the natural sort key, for listings on the driver."""
    return [(0, int(r), "") if r.isascii() and r.isdigit() else (1, 0, r) for r in re.findall(r"[0-9]+|[^0-9]+", text.lower())]


def walk(root: str, recursive: bool = True) -> list[str]:
    """Relative paths of the documents under ``root`` in natural path order."""
    if not os.path.isdir(root):
        raise NotADirectoryError(root)
    found = []
    for folder, subfolders, files in os.walk(root):
        rel = os.path.relpath(folder, root)
        subfolders[:] = [d for d in subfolders if d not in RESERVED] if recursive else []
        for name in files:
            if not name.startswith(".") and name.rpartition(".")[2].lower() in SUFFIXES and "." in name:
                found.append(name if rel == "." else f"{rel}/{name}".replace(os.sep, "/"))
    return sorted(found, key=lambda p: [natural(x) for x in p.split("/")])


def page_count(path: str) -> int:
    """Pages of a PDF by its page objects, 1 for a picture; 0 where none is found."""
    if path.lower().endswith(".pdf"):
        with open(path, "rb") as f:
            data = f.read()
        if not data.startswith(b"%PDF"):
            raise ValueError("no PDF header")
        return len(_PAGE.findall(data))
    return 1


def describe(root: str, relpath: str) -> tuple:
    """One row; every failure becomes its error, a failed hash only an unknown one."""
    path = os.path.join(root, relpath)
    size, modified, sha, pages, error = 0, -1.0, "", 0, None
    try:
        st = os.stat(path)
        size, modified = st.st_size, st.st_mtime
        try:
            h = hashlib.sha256()
            with open(path, "rb") as f:
                while chunk := f.read(1 << 16):
                    h.update(chunk)
            sha = h.hexdigest()
        except OSError:
            sha = ""
        pages = page_count(path)
        if not pages:
            error = "no pages found in file"
    except Exception as e:  # noqa: BLE001
        error = f"{type(e).__name__}: {e}"
    return relpath, path, size, modified, pages, sha, error


class _Part(InputPartition):
    def __init__(self, first: int, paths: list[str]):
        self.first, self.paths = first, paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.per_task = int(options.get("filesPerTask", "64"))

    def partitions(self):
        paths = walk(self.root, self.recursive)
        return [_Part(i, paths[i : i + self.per_task]) for i in range(0, len(paths), self.per_task)] or [_Part(0, [])]

    def read(self, partition) -> Iterator[tuple]:
        for k, p in enumerate(partition.paths, partition.first):  # numbered in natural order
            yield (k, *describe(self.root, p))


class FolderSource(DataSource):
    """``spark.read.format('leafmill_folder').load(root)``; options recursive and filesPerTask."""

    @classmethod
    def name(cls) -> str:
        return "leafmill_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def discover(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    if not os.path.isdir(root):
        raise NotADirectoryError(root)
    spark.dataSource.register(FolderSource)
    return spark.read.format("leafmill_folder").option("recursive", str(recursive).lower()).load(root)
