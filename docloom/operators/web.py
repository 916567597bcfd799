"""Web operators: scrape, crawl over a page table, change monitoring, archive segments, provenance."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators.skew import salted_join
from docloom.storage import Staging

SCRAPED = T.StructType(
    [T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("links", T.ArrayType(T.StringType())), T.StructField("headings", T.ArrayType(T.StringType()))]
)
_HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
_SILENT = frozenset(("script", "style"))


class _Reader(HTMLParser):
    """Collects title, links, headings and text of one page. Unfinished trailing text is not flushed."""

    def __init__(self, drop_script: bool):
        super().__init__()
        self.drop = drop_script
        self.title: str | None = None
        self.found: dict[str, list[str]] = {"text": [], "links": [], "headings": []}
        self.inside = {"title": False, "heading": False, "silent": False}

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.found["links"] += [v for k, v in attrs if k == "href" and v]
        self._turn(tag, True)

    def handle_endtag(self, tag):
        self._turn(tag, False)

    def _turn(self, tag: str, on: bool) -> None:
        for name, tags in (("title", ("title",)), ("heading", _HEADINGS), ("silent", _SILENT)):
            if tag in tags:
                self.inside[name] = on

    def handle_data(self, data):
        s = data.strip()
        if not s or (self.drop and self.inside["silent"]):
            return
        if self.inside["title"] and self.title is None:
            self.title = s
        if self.inside["heading"]:
            self.found["headings"].append(s)
        self.found["text"].append(s)


def read_page(html: str, drop_script: bool = False) -> tuple[str | None, str, list[str], list[str]]:
    r = _Reader(drop_script)
    r.feed(html)
    return r.title, " ".join(r.found["text"]), r.found["links"], r.found["headings"]


def scraped(html: Column, drop_script: bool = False) -> Column:
    """Struct of title, text, links and headings; null html gives null. Script text is kept by default."""

    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None, None, None) if x is None else read_page(x, drop_script) for x in s], columns=[f.name for f in SCRAPED])

    return F.pandas_udf(run, SCRAPED)(html)


def scrape(df: DataFrame, html: str = "html", drop_script: bool = False) -> DataFrame:
    out = df.withColumn("__s", scraped(F.col(html), drop_script))
    out = out.select(*df.columns, "__s.*") if html in df.columns else out
    return out.withColumn("meta", F.create_map().cast("map<string,string>"))


def is_html(content_type: Column) -> Column:
    return F.coalesce(F.contains(F.lower(content_type), F.lit("html")), F.lit(False))


def blob_key(namespace: str, seed: str, url: Column, content_type: Column) -> Column:
    """namespace / host of the seed / 16 hex digits of the url's SHA-256 and an extension."""
    host = F.coalesce(F.try_parse_url(F.lit(seed), F.lit("AUTHORITY")), F.lit("crawl"))
    return F.concat(F.lit(namespace + "/"), host, F.lit("/"), F.substring(F.sha2(url, 256), 1, 16), F.when(is_html(content_type), F.lit(".html")).otherwise(F.lit(".bin")))


@F.pandas_udf(T.StringType())
def resolve(base: pd.Series, link: pd.Series) -> pd.Series:
    """The absolute form of a link on a page."""
    return pd.Series([None if b is None or x is None else _join(b, x) for b, x in zip(base, link)], dtype=object)


def _join(base: str, link: str) -> str | None:
    try:
        return urljoin(base, link)
    except ValueError:
        return None


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, title, position, link): the absolute links of each page in order."""
    out = scrape(pages.select(url, html), html).select(F.col(url).alias("url"), "title", F.posexplode_outer("links").alias("position", "raw"))
    return out.select("url", "title", "position", resolve("url", "raw").alias("link"))


class Crawl:
    """Breadth-first crawl of a table of pages from one seed.

    Level by level: the frontier meets the link table by an equi-join (salted for pages with very many
    links) and what was seen is anti-joined away; a url found twice in a level keeps the first parent in
    visiting order, then the first place. The page budget cuts the last level; pages that are not in the
    table count as visited, as failed fetches do. Each level is a table in the shared folder.
    """

    def __init__(self, pages: DataFrame, seed: str, max_depth: int = 1, max_pages: int = 20, same_host_only: bool = True):
        self.spark = pages.sparkSession
        self.staging = Staging(self.spark, "crawl")
        self.seed, self.depth, self.limit = seed, max_depth, max_pages
        first = Window.partitionBy("url").orderBy(F.xxhash64("html"))
        known = pages.where("url is not null and html is not null").select("url", "html").withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
        self.links = self.staging.put(page_links(known))
        host = F.try_parse_url(F.lit(seed), F.lit("AUTHORITY"))
        self.allowed = F.try_parse_url("link", F.lit("AUTHORITY")) == host if same_host_only else F.lit(True)

    def run(self) -> DataFrame:
        """(url, depth, parent_url, visit, found, title): visited urls in order."""
        level = self.spark.createDataFrame([(self.seed, 0, None, 0)], "url string, depth int, parent_url string, visit long")
        seen, done = level, 0
        levels = []
        titles = self.links.groupBy("url").agg(F.min("title").alias("title"))
        for depth in range(self.depth + 1):
            size = level.count()
            if not size or done >= self.limit:
                break
            level = level.where(F.col("visit") < self.limit)
            levels.append(level)
            done += size
            if depth == self.depth:
                break
            front = level.select("url", F.col("visit").alias("parent_visit"))
            out = salted_join(self.links.select("url", "position", "link"), front, ["url"], "inner").where(F.col("link").isNotNull() & self.allowed)
            fresh = out.join(seen.select(F.col("url").alias("link")), "link", "left_anti")
            best = fresh.groupBy("link").agg(F.min(F.struct("parent_visit", "position", "url")).alias("b"))
            # positions of one level: a total order over a level that the page budget bounds
            ordered = best.select(F.col("link").alias("url"), "b.*").toDF("url", "parent_visit", "position", "parent_url").orderBy("parent_visit", "position").limit(max(0, self.limit - done))
            rank = F.row_number().over(Window.orderBy("parent_visit", "position")) - 1 + done
            level = self.staging.put(ordered.select("url", F.lit(depth + 1).alias("depth"), "parent_url", rank.cast("long").alias("visit")))
            seen = self.staging.put(seen.select("url").unionByName(best.select(F.col("link").alias("url"))))
        visited = levels[0]
        for x in levels[1:]:
            visited = visited.unionByName(x)
        return visited.join(titles, "url", "left").withColumn("found", F.col("title").isNotNull())


def crawl_counters(visited: DataFrame) -> DataFrame:
    """How many urls a crawl visited, how many of them it stored, and the pages stored per depth."""
    return visited.groupBy("depth").agg(F.count(F.lit(1)).alias("visited"), F.count_if("found").alias("stored_pages"), F.count_distinct(F.when(F.col("found"), F.col("url"))).alias("stored_urls"))


def monitor(df: DataFrame, key: str = "url", body: str = "body", at: str = "fetched_at", tie: str | None = None, staging: Staging | None = None) -> DataFrame:
    """Adds body_sha256, previous_sha256 and changed: against the observation before, per key.

    A first observation counts as changed. Only digests are shuffled, never bodies. Observations are
    ranged by key and time, so a key with very many is spread over several parts; what comes before a
    part's first is looked up in the last of the part before, of which only keys that a border runs
    through have any: two rows a part at most.
    """
    staging = staging or Staging(df.sparkSession, "monitor")
    order = [at, *([tie] if tie else [])]
    digest = df.withColumn("body_sha256", F.sha2(F.col(body), 256)).drop(body)
    parts = staging.put(digest.repartitionByRange(key, *order).withColumn("__part", F.spark_partition_id()))
    own = Window.partitionBy(key, "__part").orderBy(*order)
    out = parts.withColumn("__row", F.row_number().over(own)).withColumn("previous_sha256", F.lag("body_sha256").over(own))
    ends = parts.groupBy(F.col(key).alias("__key"), F.col("__part").alias("__of")).agg(F.max_by("body_sha256", F.struct(*order)).alias("__last"))
    across = ends.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("__key"))).where("__n > 1")
    before = across.select("__key", "__of", F.lag("__last").over(Window.partitionBy("__key").orderBy("__of")).alias("__before"))
    out = out.join(F.broadcast(before), F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__of")), "left")
    out = out.withColumn("previous_sha256", F.when(F.col("__row") == 1, F.col("__before")).otherwise(F.col("previous_sha256")))
    out = out.drop("__part", "__row", "__key", "__of", "__before")
    return out.withColumn("changed", F.col("previous_sha256").isNull() | (F.col("previous_sha256") != F.col("body_sha256")))


def sanitize_header_name(c: Column) -> Column:
    """Letters, digits, hyphen and underscore; at most 64 characters."""
    return F.substring(F.regexp_replace(c, r"[^\p{L}\p{N}\-_]", ""), 1, 64)


def sanitize_header_value(c: Column) -> Column:
    return F.substring(F.regexp_replace(c, "[\r\n]", " "), 1, 4096)


def archive_headers(resource_id: Column, content: Column, metadata: Column, headers: Column, prefix: str = "WARC-X-Meta-") -> Column:
    """Header map of an archive record: digest, reference, and sanitized metadata and payload headers."""
    empty = F.create_map().cast("map<string,string>")
    both = F.map_concat(F.map_filter(F.coalesce(metadata, empty), lambda k, v: F.lit(True)), F.transform_keys(F.coalesce(headers, empty), lambda k, v: F.concat(F.lit("payload-header-"), k)))
    entries = F.filter(F.transform(F.map_entries(both), lambda e: F.struct(sanitize_header_name(e["key"]).alias("k"), sanitize_header_value(F.coalesce(e["value"], F.lit("None"))).alias("v"))), lambda e: e["k"] != "")
    named = F.map_from_entries(F.transform(F.array_distinct(entries), lambda e: F.struct(F.concat(F.lit(prefix), e["k"]), e["v"])))
    fixed = F.create_map(F.lit("WARC-Payload-Digest"), F.concat(F.lit("sha256:"), F.sha2(content, 256)), F.lit("WARC-Refers-To"), F.concat(F.lit("<urn:uuid:"), resource_id, F.lit(">")))
    return F.map_concat(fixed, named)


def archive_segments(df: DataFrame, size: str, order: str, writers: int = 32, max_bytes: int = 512 << 20, max_records: int = 100_000) -> DataFrame:
    """Adds writer, segment and position of every record.

    A segment is closed before the record that would overflow its bytes or records, never while empty.
    The running sums restart at each close, so it is a sequential pass; it runs once per writer, over
    sizes only, and writers divide the input by a hash of the order column.
    """
    kind = dict(df.dtypes)[order]
    if kind not in ("bigint", "int", "string"):
        raise ValueError("the order column is a number or a string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict[int, list[int]] = {}
        for pdf in batches:
            segments, positions = [], []
            for w, n in zip(pdf.writer, pdf.bytes):
                s = state.setdefault(w, [0, 0, 0])  # segment, bytes, records
                if s[2] and (s[2] >= max_records or s[1] + n > max_bytes):
                    s[0], s[1], s[2] = s[0] + 1, 0, 0
                segments.append(s[0])
                positions.append(s[2])
                s[1] += n
                s[2] += 1
            yield pd.DataFrame({order: pdf[order], "writer": pdf.writer, "bytes": pdf.bytes, "segment": segments, "position": positions})

    keys = df.select(order, F.pmod(F.xxhash64(order), F.lit(writers)).cast("int").alias("writer"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("bytes"))
    sorted_keys = keys.repartition(writers, "writer").sortWithinPartitions("writer", order)
    return sorted_keys.mapInPandas(run, f"{order} {kind}, writer int, bytes long, segment int, position int")




@F.pandas_udf(T.StringType())
def _sha_of_json(s: pd.Series) -> pd.Series:
    return s.map(lambda x: hashlib.sha256(json.dumps(json.loads(x), sort_keys=True).encode()).hexdigest(), na_action="ignore")


def envelopes(df: DataFrame, resource_type: str, schema_version: str, payload: list[str], parents: Column | None = None, metadata: str | None = "metadata", producer: str = "docloom") -> DataFrame:
    """Provenance envelopes: payload and metadata as JSON, fingerprint of both with type and version.

    The fingerprint is the SHA-256 of the sorted-key JSON text; it does not depend on id or parents.
    """
    meta = F.coalesce(F.col(metadata), F.create_map().cast("map<string,string>")) if metadata else F.create_map().cast("map<string,string>")
    data = F.struct(meta.alias("metadata"), F.struct(*sorted(payload)).alias("payload"), F.lit(resource_type).alias("resource_type"), F.lit(schema_version).alias("schema_version"))
    whole = F.to_json(data, {"ignoreNullFields": "false"})
    out = df.withColumn("fingerprint", _sha_of_json(whole))
    out = out.withColumn("payload_json", F.to_json(F.struct(*payload), {"ignoreNullFields": "false"})).withColumn("resource_type", F.lit(resource_type)).withColumn("schema_version", F.lit(schema_version))
    out = out.withColumn("parents", parents if parents is not None else F.array().cast("array<string>")).withColumn("producer", F.lit(producer))
    # the id follows from content and parents, so a task that runs again writes the same row
    return out.withColumn("resource_id", F.sha2(F.concat_ws("|", "fingerprint", F.array_join("parents", ","), *[F.col(c).cast("string") for c in payload]), 256))


def ancestors(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(child, ancestor, distance) over lineage edges (child, parent): the shortest distance of each pair.

    Rounds double the reach, so a chain needs the logarithm of its length.
    """
    staging = Staging(edges.sparkSession, "lineage")
    now = staging.put(edges.where("child is not null and parent is not null and child <> parent").select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")).distinct())
    before = now.count()
    for _ in range(max_rounds):
        step = now.alias("a").join(now.alias("b"), F.col("a.ancestor") == F.col("b.child")).select("a.child", "b.ancestor", (F.col("a.distance") + F.col("b.distance")).alias("distance")).where("child <> ancestor")
        after = staging.put(now.unionByName(step).groupBy("child", "ancestor").agg(F.min("distance").alias("distance")))
        size = after.count()
        staging.drop(now)
        now = after
        if size == before:
            return now
        before = size
    raise RuntimeError("the lineage did not settle")
