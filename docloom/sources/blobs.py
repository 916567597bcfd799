"""Blobs by key in a shared folder: put, get, delete, and as DataFrames."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from pathlib import PurePosixPath
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def check_key(key: str) -> str:
    """A relative path without empty, ``.`` or ``..`` parts."""
    if not key or key.startswith("/") or "\\" in key or any(p in ("", ".", "..") for p in key.split("/")):
        raise ValueError(f"bad blob key {key!r}")
    return str(PurePosixPath(key))


def open_folder(folder: str) -> tuple[Any, str]:
    """File system and path of a folder named by a path or a URI (file, hdfs, s3, gs and so on)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


class BlobStore:
    """A folder that all executors see, by URI; a blob appears under its key when it is complete."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def _open(self, key: str) -> tuple[Any, str]:
        files, root = open_folder(self.folder)
        return files, f"{root}/{check_key(key)}"

    def put(self, key: str, content: bytes) -> None:
        files, path = self._open(key)
        parent, _, name = path.rpartition("/")
        files.create_dir(parent, recursive=True)
        part = f"{parent}/.{name}.{uuid.uuid4().hex}"
        with files.open_output_stream(part) as out:
            out.write(content)
        files.move(part, path)

    def _is_file(self, files: Any, path: str) -> bool:
        return files.get_file_info(path).is_file

    def get(self, key: str) -> bytes | None:
        files, path = self._open(key)
        if not self._is_file(files, path):
            return None
        with files.open_input_stream(path) as f:
            return f.read()

    def delete(self, key: str) -> bool:
        files, path = self._open(key)
        found = self._is_file(files, path)
        if found:
            files.delete_file(path)
        return found

    def write(self, df: DataFrame, key: str = "key", content: str = "content") -> DataFrame:
        """Writes one blob per row on the executors; (key, size) of what was written. A repeat writes the same."""
        store = self

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for k, c in zip(pdf[key], pdf[content]):
                    store.put(k, bytes(c))
                yield pd.DataFrame({"key": pdf[key], "size": [len(c) for c in pdf[content]]})

        return df.where(F.col(key).isNotNull() & F.col(content).isNotNull()).select(key, content).mapInPandas(run, "key string, size long")

    def read(self, spark: SparkSession, pattern: str = "*") -> DataFrame:
        """(key, content, size, modified) of every blob whose file name matches; Spark's binaryFile leaves out empty ones."""
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(self.folder)
        root = open_folder(self.folder)[1].rstrip("/")
        inside = F.substring_index("path", f"{root}/", -1)
        return files.select(inside.alias("key"), "content", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
