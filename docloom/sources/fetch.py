"""Fetching: from a table of pages, or over HTTP on the executors."""

from __future__ import annotations

import time
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FETCHED = "url string, final_url string, status_code int, headers map<string,string>, content binary, encoding string, content_type string, content_length long, fetch_duration double, fetched_at string, error string"


def complete_url(c: Column) -> Column:
    """A url whose path is empty gets the path ``/``."""
    return F.when(c.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+$"), F.concat(c, F.lit("/"))).otherwise(c)


def fetch_from_table(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """Requests (url) answered from pages (url, html): status 200, or 404 and no content."""
    known = pages.where("url is not null").groupBy("url").agg(F.max("html").alias("html"))
    out = requests.select("url").distinct().join(known, "url", "left")
    return out.select(
        "url", F.when(F.col("html").isNotNull(), 200).otherwise(404).alias("status_code"), F.encode("html", "UTF-8").alias("content"), F.lit("utf-8").alias("encoding"), F.lit("text/html").alias("content_type"), F.octet_length("html").cast("long").alias("content_length")
    )


def fetch_http(requests: DataFrame, timeout: float = 30.0, tasks: int = 64, attempts: int = 2, pause: float = 1.0) -> DataFrame:
    """Fetches (url) over HTTP; a failure is a row with ``error``. The time is that of the start.

    ``tasks`` bounds how many requests are open at once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from urllib.request import Request, urlopen

        for pdf in batches:
            rows = []
            for url in pdf.url:
                row = None
                for attempt in range(attempts):
                    start, clock = datetime.now(timezone.utc), time.monotonic()
                    try:
                        with urlopen(Request(url), timeout=timeout) as r:
                            body = r.read()
                            row = (url, r.geturl(), r.status, dict(r.headers.items()), body, r.headers.get_content_charset(), r.headers.get_content_type(), len(body), time.monotonic() - clock, start.isoformat(), None)
                            break
                    except Exception as e:  # noqa: BLE001 - one bad url must not end the task
                        row = (url, None, getattr(e, "code", None), None, None, None, None, None, time.monotonic() - clock, start.isoformat(), f"{type(e).__name__}: {e}")
                        if attempt + 1 < attempts:
                            time.sleep(pause)
                rows.append(row)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FETCHED.replace("map<string,string>", "map").split(", ")])

    return requests.where("url is not null").select("url").distinct().repartition(tasks, "url").mapInPandas(run, FETCHED)
