"""Archive sink: WARC segments, written on the executors."""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator
from datetime import datetime, timezone
from uuid import NAMESPACE_URL, uuid4, uuid5

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.web import archive_segments
from docloom.sources.blobs import open_folder


def record(uri: str, content: bytes, media_type: str, headers: dict[str, str], at: datetime) -> bytes:
    """One ``resource`` record; its id follows from uri and content."""
    digest = hashlib.sha256(content).hexdigest()
    lines = {
        "WARC-Type": "resource",
        "WARC-Record-ID": f"<urn:uuid:{uuid5(NAMESPACE_URL, uri + digest)}>",
        "WARC-Date": at.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"),
        "WARC-Target-URI": uri,
        "WARC-Payload-Digest": f"sha256:{digest}",
        **headers,
        "Content-Type": media_type,
        "Content-Length": str(len(content)),
    }
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()) + "\r\n"
    return head.encode() + content + b"\r\n\r\n"


def write_archive(df: DataFrame, folder: str, order: str, uri: str = "url", content: str = "content", media_type: str = "text/html", at: datetime | None = None, writers: int = 32, **limits: int) -> DataFrame:
    """Archives (order, uri, content) and returns order, path, size and checksum of every record.

    Segments are assigned over sizes only; the records then meet in one task per writer, in order, and
    stream into its segments. Files appear under their name when complete; a retried task writes them anew.
    """
    at = at or datetime.now(timezone.utc)
    kinds = dict(df.dtypes)
    rows = df.where(F.col(content).isNotNull() & F.col(uri).isNotNull()).select(order, F.col(uri).alias("__uri"), F.col(content).cast("binary").alias("__content"))
    placed = archive_segments(rows.select(order, F.octet_length("__content").alias("__size")), "__size", order, writers, **limits)
    joined = rows.join(placed, order).repartition(writers, "writer").sortWithinPartitions("writer", "segment", "position")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, name, part = None, None, None
        files, root = open_folder(folder.rstrip("/"))
        files.create_dir(root, recursive=True)

        def close() -> None:
            if out is not None:
                out.close()
                files.move(part, name)

        for pdf in batches:
            paths = []
            for w, s, u, c in zip(pdf.writer, pdf.segment, pdf["__uri"], pdf["__content"]):
                want = f"{root}/segment-{w:04d}-{s:06d}.warc.gz"
                if want != name:
                    close()
                    name, part = want, f"{want}.part{uuid4().hex}"
                    out = files.open_output_stream(part)
                out.write(gzip.compress(record(u, bytes(c), media_type, {}, at), mtime=0))
                paths.append(want)
            yield pd.DataFrame({order: pdf[order], "path": paths, "size": [len(c) for c in pdf["__content"]], "checksum": ["sha256:" + hashlib.sha256(bytes(c)).hexdigest() for c in pdf["__content"]]})
        close()

    return joined.select(order, "writer", "segment", "position", "__uri", "__content").mapInPandas(run, f"{order} {kinds[order]}, path string, size long, checksum string")


def read_archive(path: str) -> list[tuple[dict[str, str], bytes]]:
    """Headers and content of every record of one segment."""
    files, name = open_folder(path)
    with files.open_input_file(name) as f:
        data, out, at = gzip.decompress(f.read()), [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
        n = int(head["Content-Length"])
        out.append((head, data[end + 4 : end + 4 + n]))
        at = end + 4 + n + 4
    return out
