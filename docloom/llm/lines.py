"""Lines repeated across one site's documents.

Text is normalised and read as one stream of bytes, line feeds and all. A gear rolling hash over the
last ``WINDOW`` bytes alone decides the cuts, at four levels: where its 6, 4, 2 or 1 highest bits are
zero. A chunk is what lies between two cuts of a level. The chunk of a line is the first whole one
inside it, on the coarsest level that has one there; cuts whose window lies in the line depend on
that line alone, so equal lines have equal chunks, whatever surrounds them. A line too short for a
whole chunk is its own chunk.

Distinct documents are counted per source and chunk, and the places of chunks that are repeated too
often are kept; no repeated line can be missed, because its chunk lies in at least as many documents
as it does. The lines at those places are then verified: counted exactly by a 128-bit hash of the
whole normalised line and its source. Each place tells whether it came by
hash cuts.

Defined results: null or blank lines never count; a document with null text or without a source is
ignored, one with blank text counts as a document; copies of a document count once (should its rows
name several sources, each row's lines count in their own); an empty table gives no rows; lines of
any length are read whole. Sources are told apart by a 64-bit hash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.skew import salted_join
from docloom.storage import Staging

#: A power of two.
WINDOW = 4
#: High bits of the rolling hash that are zero at a cut, coarsest level first.
LEVELS = (6, 4, 2, 1)
#: Tables of repeated chunks or lines with more rows than this are joined by a shuffle instead of a broadcast.
MAX_BROADCAST = 500_000
_GEAR = np.random.default_rng(20240229).integers(0, 2**32, 256, dtype=np.uint32)
_DIGITS = re.compile("[0-9]+")
LINES = "doc long, line_no int, site long, chunk long, cut boolean, h1 long, h2 long"


def host(url: Column) -> Column:
    """The url's host in lower case, without port, user and one leading ``www.``; null if there is none."""
    name = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    name = F.regexp_replace(name, r"^www\.", "")
    return F.when(name != "", name)


def normalise(text: str) -> list[str]:
    """Lines of a text: lower case, single spaces, each run of digits as 0; blank lines are empty."""
    return [" ".join(x.split()) for x in _DIGITS.sub("0", text.lower()).split("\n")]


def rolling(data: bytes) -> np.ndarray:
    """The gear hash of the last WINDOW bytes at every position (of fewer at the start)."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    width = 1
    while width < WINDOW:  # doubles the window: h over 2w bytes from h over w bytes
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    return h


def line_chunks(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each line's chunk in the stream; -1 where no whole chunk lies inside the line."""
    a, z = np.full(len(starts), -1), np.full(len(starts), -1)
    h = rolling(data) if data else np.zeros(0, np.uint32)
    for bits in LEVELS:
        cut = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1
        low, high = np.searchsorted(cut, starts + WINDOW), np.searchsorted(cut, ends, "right")
        new = np.flatnonzero((a < 0) & (high - low >= 2))
        a[new], z[new] = cut[low[new]], cut[low[new] + 1]
    return a, z


def _sign_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest, small = xxhash.xxh3_128_digest, xxhash.xxh3_64_intdigest
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            docs, numbers, sites, data, salts = [], [], [], [], []
            for doc, site, text in zip(*(c.to_pylist() for c in batch.columns)):
                salt = site & 0xFFFFFFFFFFFFFFFF
                found = [(i, x.encode()) for i, x in enumerate(normalise(text)) if x]
                docs += [doc] * len(found)
                sites += [site] * len(found)
                salts += [salt] * len(found)
                numbers += [i for i, _ in found]
                data += [x for _, x in found]
            stream = b"\n".join(data)
            sizes = np.fromiter(map(len, data), np.int64, len(data))
            starts = np.cumsum(sizes + 1) - sizes - 1
            a, z = line_chunks(stream, starts, starts + sizes)
            keys = np.frombuffer(b"".join(map(digest, data, salts)), ">i8").reshape(-1, 2).astype(np.int64)
            cut = a >= 0
            chunks = keys[:, 0].copy()
            if cut.any():
                inside = np.flatnonzero(cut)
                own = [small(stream[x:y], salts[i]) for i, x, y in zip(inside.tolist(), a[inside].tolist(), z[inside].tolist())]
                chunks[inside] = np.array(own, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(numbers, pa.int32()), pa.array(sites, pa.int64()), pa.array(chunks), pa.array(cut), pa.array(keys[:, 0]), pa.array(keys[:, 1])],
                ["doc", "line_no", "site", "chunk", "cut", "h1", "h2"],
            )


def signed_lines(docs: DataFrame) -> DataFrame:
    """``docs`` (doc long, source string, text string) to one row per non-blank line."""
    return docs.where("source is not null and text is not null").select("doc", F.xxhash64("source").alias("site"), "text").mapInArrow(_sign_lines, LINES)


def _among(rows: DataFrame, keys: DataFrame, on: list[str], staging: Staging) -> DataFrame:
    """The rows whose keys are in ``keys``; these are broadcast if they are few."""
    keys = staging.put(keys)
    return rows.join(F.broadcast(keys), on, "left_semi") if keys.count() <= MAX_BROADCAST else salted_join(rows, keys, on, "left_semi")


def repeated_places(docs: DataFrame, min_docs: int = 4, min_share: float = 0.3, staging: Staging | None = None) -> DataFrame:
    """(doc, line_no, cut) of lines in ``min_docs`` documents and ``min_share`` of the source's; ``cut``: found by hash cuts."""
    staging = staging or Staging(docs.sparkSession, "lines")
    lines = staging.put(signed_lines(docs))
    pages = docs.where("source is not null and text is not null").select("doc", F.xxhash64("source").alias("site"))
    sizes = staging.put(pages.groupBy("site").agg(F.countDistinct("doc").alias("size")).where(F.col("size") >= min_docs))

    def often(rows: DataFrame, *on: str) -> DataFrame:
        counts = rows.groupBy("site", *on).agg(F.countDistinct("doc").alias("n")).where(F.col("n") >= min_docs)
        sized = counts.join(F.broadcast(sizes), "site") if sizes.count() <= MAX_BROADCAST else salted_join(counts, sizes, ["site"], "inner")
        return sized.where(F.col("n") >= min_share * F.col("size")).select(*on)

    candidates = staging.put(_among(lines, often(lines, "chunk"), ["chunk"], staging))
    verified = _among(candidates, often(candidates, "h1", "h2"), ["h1", "h2"], staging)
    return verified.groupBy("doc", "line_no").agg(F.bool_or("cut").alias("cut"))


def repeated_lines(docs: DataFrame, min_docs: int = 4, min_share: float = 0.3, staging: Staging | None = None) -> DataFrame:
    """Places (doc, line_no) of lines that lie in ``min_docs`` documents and ``min_share`` of the source's."""
    return repeated_places(docs, min_docs, min_share, staging).select("doc", "line_no")


def without_lines(docs: DataFrame, places: DataFrame) -> DataFrame:
    """Each document's text without the lines at ``places``; the other lines stay as they are."""
    cut = places.groupBy("doc").agg(F.collect_set("line_no").alias("__cut"))
    rest = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("__cut", i))
    return docs.join(cut, "doc", "left").select("doc", F.when(F.col("__cut").isNull(), F.col("text")).otherwise(F.array_join(rest, "\n")).alias("text"))
