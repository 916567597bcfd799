"""Keyed tables on Parquet: keep-last merges, metadata and artifacts with tagged JSON values."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone
from enum import Enum
from functools import reduce
from pathlib import PurePath
from typing import Any
from uuid import UUID, uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.ops import last_by


class KeyedTable:
    """A table keyed by ``keys`` whose rows the latest by ``order`` replace.

    A merge appends its rows as a delta, so it costs what the batch holds; a reader takes the last row
    of each key over the base and the deltas after it, and every ``compact_every`` merges these become
    a new base. Deltas and bases are written aside and renamed into place. Merging the same rows again
    changes nothing, whatever batch or query they come from, so a stream may repeat batches, restart
    with a new checkpoint or share the table with another, and no row is ever skipped.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str], order: Sequence[str], compact_every: int = 16):
        self.spark, self.folder, self.keys, self.order = spark, folder.rstrip("/"), list(keys), list(order)
        self.compact_every = compact_every
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self, kind: str) -> list[int]:
        root = self._path(self.folder)
        if not self._fs.exists(root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(root)]
        return sorted(int(n[1:]) for n in names if n.startswith(kind) and n[1:].isdigit())

    def _name(self, kind: str, n: int) -> str:
        return f"{self.folder}/{kind}{n:012d}"

    def _parts(self) -> list[str]:
        bases = self._numbers("v")
        base = bases[-1] if bases else -1
        return ([self._name("v", base)] if bases else []) + [self._name("d", n) for n in self._numbers("d") if n > base]

    def read(self) -> DataFrame | None:
        parts = [self.spark.read.parquet(p) for p in self._parts()]
        if not parts:
            return None
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        return last_by(rows, self.keys, self.order)

    def _put(self, rows: DataFrame, kind: str, n: int) -> None:
        aside = f"{self.folder}/_new-{uuid4().hex}"
        rows.write.parquet(aside)
        if self._fs.exists(self._path(self._name(kind, n))) or not self._fs.rename(self._path(aside), self._path(self._name(kind, n))):
            raise RuntimeError("another writer was faster: merge again")

    def merge(self, rows: DataFrame) -> None:
        last = max(self._numbers("v") + self._numbers("d"), default=-1)
        self._put(last_by(rows, self.keys, self.order), "d", last + 1)
        if len(self._parts()) > self.compact_every:
            self.compact()

    def compact(self) -> None:
        """Base and deltas become one base; what the base before was made of is removed."""
        bases, deltas = self._numbers("v"), self._numbers("d")
        now = self.read()
        if now is None or not deltas or (bases and deltas[-1] <= bases[-1]):
            return
        self._put(now, "v", deltas[-1])
        for kind, numbers in (("v", bases[:-1]), ("d", [n for n in deltas if bases and n <= bases[-1]])):
            for n in numbers:  # the base before and its deltas stay for readers under way
                self._fs.delete(self._path(self._name(kind, n)), True)


TAG, VALUE = "__type__", "value"


def encode(value: Any) -> Any:
    """JSON-ready form; dates, ids, paths and enums keep their type in a tag, sets come out sorted."""
    match value:
        case Mapping():
            return {str(k): encode(v) for k, v in value.items()}
        case Enum():
            return {TAG: "enum", VALUE: value.value, "enum": type(value).__name__}
        case datetime():
            return {TAG: "datetime", VALUE: value.isoformat()}
        case UUID():
            return {TAG: "uuid", VALUE: str(value)}
        case PurePath():
            return {TAG: "path", VALUE: str(value)}
        case set() | frozenset():
            return [encode(v) for v in sorted(value, key=repr)]
        case list() | tuple():
            return [encode(v) for v in value]
    return value


def decode(value: Any, enums: Mapping[str, type[Enum]] | None = None) -> Any:
    """The inverse of ``encode``; an enum that is not in ``enums`` stays its plain value."""
    if isinstance(value, list):
        return [decode(v, enums) for v in value]
    if not isinstance(value, dict):
        return value
    inner = value.get(VALUE)
    match value.get(TAG):
        case "datetime":
            at = datetime.fromisoformat(inner)
            return at if at.tzinfo else at.replace(tzinfo=timezone.utc)
        case "uuid":
            return UUID(inner)
        case "path":
            return PurePath(inner)
        case "enum":
            kind = (enums or {}).get(value.get("enum", ""))
            return inner if kind is None or inner not in [m.value for m in kind] else kind(inner)
    return {k: decode(v, enums) for k, v in value.items()}


class MetadataTable(KeyedTable):
    """(namespace, key) to a JSON payload."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark, folder, ["namespace", "key"], ["created_at"])

    def put(self, records: Sequence[tuple[str, str, Any]], at: datetime | None = None) -> None:
        at = at or datetime.now(timezone.utc)
        rows = [(n, k, json.dumps(encode(p), sort_keys=True), at) for n, k, p in records]
        self.merge(self.spark.createDataFrame(rows, "namespace string, key string, payload string, created_at timestamp"))

    def get(self, namespace: str, key: str) -> Any:
        table = self.read()
        row = None if table is None else table.where((F.col("namespace") == namespace) & (F.col("key") == key)).select("payload").first()
        return None if row is None else decode(json.loads(row[0]))

    def listing(self, namespace: str | None = None) -> DataFrame | None:
        table = self.read()
        if table is not None and namespace is not None:
            table = table.where(F.col("namespace") == namespace)
        return None if table is None else table.orderBy("namespace", "key")


class ArtifactTable(KeyedTable):
    """key to bytes, with their digest and size; the last upsert of a key stays."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark, folder, ["key"], ["created_at"])

    def upsert(self, artifacts: DataFrame) -> None:
        """``artifacts``: key string, content binary, created_at timestamp; a null key is refused."""
        known = artifacts.select(F.when(F.col("key").isNull(), F.raise_error(F.lit("an artifact has a key"))).otherwise(F.col("key")).alias("key"), "content", "created_at")
        self.merge(known.withColumn("sha256", F.sha2("content", 256)).withColumn("size", F.octet_length("content")))

    def put(self, key: str, content: bytes, at: datetime | None = None) -> None:
        self.upsert(self.spark.createDataFrame([(key, content, at or datetime.now(timezone.utc))], "key string, content binary, created_at timestamp"))

    def get(self, key: str) -> bytes | None:
        table = self.read()
        row = None if table is None else table.where(F.col("key") == key).select("content").first()
        return None if row is None else bytes(row[0])
