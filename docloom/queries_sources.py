"""Registered queries over stores, listings, relations and streams into tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import queries_documents as Q
from docloom import queries_ops as P
from docloom.functions.keys import uuid_hex, uuid_text
from docloom.operators import documents as D
from docloom.operators import ops as O
from docloom.operators import search as S
from docloom.operators import web as W
from docloom.plans.knowledge import knowledge_steps
from docloom.plans.operators import default_registry
from docloom.plans.pipeline import compile_plan
from docloom.queries_streaming import _all, _stream
from docloom.sources.blobs import BlobStore
from docloom.sources.tables import ArtifactTable, KeyedTable, MetadataTable
from docloom.storage import shared_folder, table
from docloom.streaming import state

SEED = "https://Seed.example:8080/start"


def _folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def blob_keys(spark, sf):
    """The blob key of every page, by its url and kind of content."""
    urls = table(spark, sf, "scrape_requests").where("url is not null").select("url").distinct()
    kind = F.when(F.length("url") % 3 == 0, "application/pdf").otherwise("Text/HTML; charset=utf-8")
    return urls.select("url", W.blob_key("pages", SEED, F.col("url"), kind).alias("blob_key"))


def blob_round_trip(spark, sf):
    """Every text written as a blob and read back."""
    texts = table(spark, sf, "documents").where("text <> ''").select(F.concat(F.lit("d"), F.col("doc_id") % 10, F.lit("/"), F.col("doc_id"), F.lit(".txt")).alias("key"), F.encode("text", "UTF-8").alias("content"))
    store = BlobStore(_folder(spark, "blobs"))
    store.write(texts).write.format("noop").mode("overwrite").save()
    return store.read(spark, "*.txt").select("key", "size", F.sha2("content", 256).alias("sha256"))


def artifact_latest(spark, sf):
    """The last artifact of every page: its digest and size."""
    pages = table(spark, sf, "scrape_requests").where("html is not null and page_id is not null")
    t = ArtifactTable(spark, _folder(spark, "artifacts"))
    for part in (0, 1):  # in two upserts
        t.upsert(pages.where(F.pmod(F.xxhash64("loaded_at"), F.lit(2)) == part).select(F.col("page_id").cast("string").alias("key"), F.encode("html", "UTF-8").alias("content"), F.col("loaded_at").alias("created_at")))
    return t.read().select("key", "sha256", "size")


def metadata_scan(spark, sf):
    """One namespace of a metadata table after two rounds of tagged values, by key."""
    t = MetadataTable(spark, _folder(spark, "metadata"))
    t.put([("n", "b", {"x": 1}), ("n", "a", {"id": uuid.UUID(int=7)}), ("other", "z", 0)])
    t.put([("n", "b", {"x": [2, None]}), ("n", "c", {"s": {"q", "p"}})])
    return t.listing("n").select("namespace", "key", "payload")


def job_listing(spark, sf):
    """The 50 jobs submitted first."""
    jobs = O.last_by(table(spark, sf, "worker_jobs").withColumn("job_id", uuid_text(uuid_hex(F.col("job_id")))), ["job_id"], ["loaded_at"])
    return O.listing(jobs.withColumn("created_at", F.col("submitted_at")), "jobs", 50).select("created_at", "kind", "job_id")


def search_boosted(spark, sf):
    """The 10 best documents where a word in the title counts twice."""
    docs = table(spark, sf, "documents").withColumnRenamed("doc_id", "document_id")
    return S.search_boosted(docs, Q.QUERY, {"title": 2.0, "text": 1.0, "url": 1.0}).select("document_id", "score")


def run_relations(spark, sf):
    """Every job with its run and its lease, where it has them."""
    jobs = O.last_by(table(spark, sf, "worker_jobs").select(uuid_hex(F.col("job_id")).alias("job"), uuid_hex(F.col("run_id")).alias("run"), "kind", "loaded_at"), ["job"], ["loaded_at"])
    runs = O.last_by(table(spark, sf, "control_runs").select(uuid_hex(F.col("run_id")).alias("run"), "pipeline_name", "loaded_at"), ["run"], ["loaded_at"])
    leases = table(spark, sf, "worker_leases").groupBy(uuid_hex(F.col("job_id")).alias("job")).agg(F.max("expires_at").alias("expires_at"))
    both = jobs.join(runs.select("run", "pipeline_name", F.lit(True).alias("known")), "run", "left").join(leases, "job", "left")
    return both.select("job", "kind", "pipeline_name", F.coalesce("known", F.lit(False)).alias("has_run"), "expires_at")


def schedule_pause(spark, sf):
    """Schedules per state after every third one was paused."""
    return O.pause(P.schedules(spark, sf), F.col("schedule_id") % 3 == 0).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def schedule_resume(spark, sf):
    """Schedules per state after every second one was resumed."""
    return O.resume(P.schedules(spark, sf), F.col("schedule_id") % 2 == 0, F.lit(P.THEN)).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def compliance_default(spark, sf):
    """Documents that fail the policy that settings give besides an explicit rule."""
    rules = D.default_rules([D.Rule("origin", required_metadata_keys=("source",))], D.Rule("default-policy", max_characters=2000))
    checked = D.check(Q.documents(spark, sf), rules).where("text is not null")
    return checked.select("document_id", F.explode("findings").alias("f")).where("not f.passed").select("document_id", "f.rule_id", "f.message", F.concat_ws(",", F.array_sort(F.map_keys("f.details"))).alias("details"))


def dedup_retained(spark, sf):
    """The documents kept, with the digest and number of their copies as metadata."""
    kept = D.Deduplicated(Q.documents(spark, sf)).retained()
    return kept.select("document_id", F.col("dedup.fingerprint").alias("fingerprint"), F.col("dedup.duplicate_count").alias("duplicate_count"))


def plan_levels(spark, sf):
    """Steps of the flagship plan by parallel level, with what they ask of the registry."""
    plan = compile_plan(knowledge_steps("q", [], 5, 6, "document_id"), default_registry())
    level = {s: n for n, steps in enumerate(plan.levels) for s in steps}
    rows = [(s, level[s], plan.providers[s][0], ",".join(plan.dependencies[s])) for s in plan.order]
    return spark.createDataFrame(rows, "step_id string, level int, provider string, needs string")


def vector_chunks(spark, sf):
    """Vector records joined to the chunk of their page that they name."""
    pages = O.last_by(table(spark, sf, "scraped_documents").where("page_id is not null").select("page_id", "text", "loaded_at"), ["page_id"], ["loaded_at"])
    chunks = D.chunk(pages.select(F.col("page_id").cast("string").alias("document_id"), "text"), keep=())
    records = table(spark, sf, "vector_records").where("chunk_id is not null").select("record_id", "chunk_id").distinct()
    return records.join(chunks, "chunk_id").select("record_id", "chunk_id", "start_token", "end_token")


def crawl_counters(spark, sf):
    """What a crawl visited and stored, per depth."""
    return W.crawl_counters(P.crawl_bfs(spark, sf))


def archive_bounds(spark, sf):
    """Per archive: its records, and whether every segment keeps its limits and is closed no earlier than it must be."""
    placed = P.archive_segments(spark, sf)
    segments = placed.groupBy("writer", "segment").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"), F.max("position").alias("last"), F.min_by("bytes", "position").alias("first"))
    later = segments.select("writer", (F.col("segment") - 1).alias("segment"), F.col("first").alias("next"))
    joined = segments.join(later, ["writer", "segment"], "left")
    within = (F.col("n") <= 50) & ((F.col("b") <= 1 << 17) | (F.col("n") == 1)) & (F.col("last") == F.col("n") - 1)
    full = F.col("next").isNull() | (F.col("n") == 50) | (F.col("b") + F.col("next") > 1 << 17)
    return joined.agg(F.sum("n").alias("records"), F.bool_and(within).alias("within"), F.bool_and(full).alias("full"))


def rate_limit_bounds(spark, sf):
    """Per key: its requests, how many of its first two were admitted at once, and whether order was kept."""
    out = P.rate_limit(spark, sf).join(table(spark, sf, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")), "event_id")
    ranked = out.selectExpr("user_id", "wait_seconds", "admitted", "at", "row_number() over (partition by user_id order by at, event_id) as r", "lag(at + wait_seconds * 1e6) over (partition by user_id order by at, event_id) as before")
    ordered = F.bool_and(F.coalesce(F.col("at") + F.col("wait_seconds") * 1e6 >= F.col("before") - 2e3, F.lit(True)))
    return ranked.groupBy("user_id").agg(F.count(F.lit(1)).alias("requests"), F.count_if((F.col("r") <= 2) & F.col("admitted")).alias("at_once"), ordered.alias("ordered"))


def stream_index_add(spark, sf):
    """Postings grown by a stream of documents, then asked as the batch index is."""
    base = _folder(spark, "index")
    index = KeyedTable(spark, f"{base}/table", ["token", "document_id"], ["seen"])
    docs = _stream(spark, sf, "documents").withColumnRenamed("doc_id", "document_id")
    grown = docs.writeStream.foreachBatch(lambda df, n: index.merge(S.postings(df).withColumn("seen", F.lit(1)))).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    grown.awaitTermination()
    asked = table(spark, sf, "subject_areas").select(F.col("subject").alias("query_id"), F.col("scope").alias("query"))
    return S.search_many(index.read().select("token", "document_id"), asked)


def stream_repeats(spark, sf):
    """The first event of each user and type, out of a stream."""
    events = _stream(spark, sf, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return _all(state.drop_repeats(events, ["user_id", "event_type"], "ts", "3650 days").select("user_id", "event_type"), "repeats")


def stream_vector_upsert(spark, sf):
    """Vector records kept by a stream into a keyed table."""
    base = _folder(spark, "vectors")
    rows = _stream(spark, sf, "vector_records").where("record_id is not null").withColumn("length", F.size("vector")).drop("metadata")
    t = KeyedTable(spark, f"{base}/table", ["namespace", "record_id"], ["loaded_at"])
    state.keep_last(rows, t, f"{base}/state").awaitTermination()
    return t.read().select("namespace", "record_id", "document_id", "length", "loaded_at")


_NAMES = (
    blob_keys, blob_round_trip, artifact_latest, metadata_scan, job_listing, search_boosted, run_relations, schedule_pause, schedule_resume, compliance_default, dedup_retained, plan_levels, vector_chunks, crawl_counters,
    archive_bounds, rate_limit_bounds, stream_index_add, stream_repeats, stream_vector_upsert,
)
QUERIES = {f.__name__: f for f in _NAMES}

_HEX = P._HEX
_UUID = "concat_ws('-', substr({0}, 1, 8), substr({0}, 9, 4), substr({0}, 13, 4), substr({0}, 17, 4), substr({0}, 21, 12))"
_LEVELS = (("normalize", 0, ""), ("enrich", 1, "normalize"), ("dedup", 2, "enrich"), ("compliance", 3, "dedup"), ("chunk", 4, "compliance"), ("payload", 5, "chunk"), ("provenance", 6, "payload"), ("embed", 7, "provenance"), ("records", 8, "embed"), ("upsert", 9, "records"), ("retrieve", 10, "upsert"))
SQL = {
    "blob_keys": "select distinct url, 'pages/Seed.example:8080/' || substr(sha256(url), 1, 16) || case when length(url) % 3 = 0 then '.bin' else '.html' end as blob_key from scrape_requests where url is not null",
    "blob_round_trip": "select 'd' || (doc_id % 10) || '/' || doc_id || '.txt' as key, strlen(text) as size, sha256(text) as sha256 from documents where text <> ''",
    "artifact_latest": "with a as (select page_id, arg_max(html, loaded_at) as html from scrape_requests where html is not null and page_id is not null group by 1) select page_id::varchar as key, sha256(html) as sha256, strlen(html)::int as size from a",
    "metadata_scan": """select * from (values ('n', 'a', '{"id": {"__type__": "uuid", "value": "00000000-0000-0000-0000-000000000007"}}'), ('n', 'b', '{"x": [2, null]}'), ('n', 'c', '{"s": ["p", "q"]}')) t(namespace, key, payload)""",
    "job_listing": f"""with j as (select {_HEX.format('job_id')} as k, arg_max({{'at': submitted_at, 'what': kind}}, loaded_at) as r from worker_jobs group by 1)
  select j.r.at as created_at, j.r.what as kind, {_UUID.format('j.k')} as job_id from j order by created_at nulls first, kind nulls first, job_id limit 50""",
    "search_boosted": f"""with c as (select t, count(*)::double as n from (select unnest({Q._TOK.format("lower('" + Q.QUERY + "')")}) as t) group by 1),
  f as (select distinct doc_id, 2.0 as b, 't' as f, unnest({Q._TOK.format("lower(coalesce(title, ''))")}) as t from documents union all select distinct doc_id, 1.0, 'x', unnest({Q._TOK.format("lower(coalesce(text, ''))")}) from documents
    union all select distinct doc_id, 1.0, 'u', unnest({Q._TOK.format("lower(coalesce(url, ''))")}) from documents)
  select doc_id as document_id, sum(b * n)::double as score from f join c on f.t = c.t group by 1 order by score desc, document_id limit 10""",
    "run_relations": f"""with j as (select {_HEX.format('job_id')} as job, arg_max({{'r': {P._KEY.format('run_id')}, 'k': kind}}, loaded_at) as j from worker_jobs group by 1),
  r as (select {_HEX.format('run_id')} as run, arg_max({{'p': pipeline_name}}, loaded_at) as r from control_runs group by 1),
  l as (select {_HEX.format('job_id')} as job, max(expires_at) as expires_at from worker_leases group by 1)
  select j.job, j.j.k as kind, r.r.p as pipeline_name, r.run is not null as has_run, l.expires_at from j left join r on j.j.r = r.run left join l on j.job = l.job""",
    "schedule_pause": f"{P._S} select case when schedule_id % 3 = 0 and state = 'scheduled' then 'paused' else state end as state, count(*) as n from s group by 1",
    "schedule_resume": f"{P._S} select case when schedule_id % 2 = 0 and state = 'paused' then case when expires_at <= {P._THEN} then 'expired' else 'scheduled' end else state end as state, count(*) as n from s group by 1",
    "compliance_default": """select doc_id as document_id, 'origin' as rule_id, 'required metadata keys are missing' as message, 'missing_keys' as details from documents where text is not null and source is null
  union all select doc_id, 'default-policy', 'longer than 2000 characters', 'character_count,maximum' from documents where length(text) > 2000""",
    "dedup_retained": f"select document_id, fingerprint, duplicate_count from ({Q.SQL['dedup_canonical']})",
    "plan_levels": "select step_id, level::int as level, provider, needs from (values " + ", ".join(f"('{s}', {n}, '{'chunk_payload' if s == 'payload' else s}', '{d}')" for s, n, d in _LEVELS) + ") t(step_id, level, provider, needs)",
    "vector_chunks": f"""with p as (select page_id, arg_max({{'t': text}}, loaded_at).t as text from scraped_documents where page_id is not null group by 1),
  n as (select page_id::varchar as d, len(regexp_extract_all(text, '[^{Q.WS}]+')) as n from p where text is not null),
  c as (select d, n, unnest(range(case when n <= 128 then 1 else cast(ceil((n - 128) / 112.0) as int) + 1 end)) as i from n where n > 0)
  select distinct v.record_id, v.chunk_id, (c.i * 112)::int as start_token, least(c.i * 112 + 128, c.n)::int as end_token from vector_records v join c on v.chunk_id = c.d || ':' || c.i""",
    "archive_bounds": "select count(distinct page_id) as records, true as within, true as \"full\" from scrape_requests where page_id is not null",
    "rate_limit_bounds": "select user_id, count(*) as requests, least(count(*), 2) as at_once, true as ordered from events group by 1",
    "stream_index_add": Q.SQL["search_batch"],
    "stream_repeats": "select distinct user_id, event_type from events",
    "stream_vector_upsert": Q.SQL["vector_upsert"],
}
