"""Registered queries of problem 1, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.keys import uuid_hex, uuid_text
from docloom.operators.references import MATCHES, find_orphans, referring, target_states
from docloom.storage import Staging, table

#: referring table, its key, the referring column, target table, the target's key
REFERENCES = (
    ("worker_jobs", "job_id", "run_id", "control_runs", "run_id"),
    ("execution_records", "run_id", "run_id", "control_runs", "run_id"),
    ("worker_leases", "job_id", "job_id", "worker_jobs", "job_id"),
)


def orphans(spark: SparkSession, sf: str) -> DataFrame:
    purged = table(spark, sf, "purged_keys").where(F.col("restored_at").isNull())
    staging = Staging(spark, "references")
    parts, states = [], {}
    for name, key, ref, target, target_key in REFERENCES:
        refs = referring(table(spark, sf, name), uuid_hex(F.col(key)), [uuid_hex(F.col(ref))], F.col("loaded_at"))
        if target not in states:
            gone = purged.where(F.lower(F.trim("table_name")) == target)
            states[target] = staging.put(target_states(table(spark, sf, target), [uuid_hex(F.col(target_key))], F.col("loaded_at"), gone, [uuid_hex(F.col("record_key"))]))
        parts.append(find_orphans(refs, states[target], staging=staging).select(F.lit(name).alias("table_name"), "record_key", "arrival", "reason"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return orphans(spark, sf).select("table_name", uuid_text(F.col("record_key")).alias("record_key"), "reason")


def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    """Bad references per table, month of arrival and reason."""
    month = F.date_format("arrival", "yyyy-MM").alias("period")
    return orphans(spark, sf).groupBy("table_name", month, "reason").agg(F.count(F.lit(1)).alias("n"))


def p1_composite(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs that name a run and its worker, against the runs' own workers, under each match semantics."""
    jobs, runs = table(spark, sf, "worker_jobs"), table(spark, sf, "control_runs")
    staging = Staging(spark, "references")
    pair = [uuid_hex(F.col("run_id")), F.col("worker_id")]
    refs = staging.put(referring(jobs, uuid_hex(F.col("job_id")), pair, F.col("loaded_at")))
    states = staging.put(target_states(runs, pair, F.col("loaded_at")))
    parts = [find_orphans(refs, states, 2, m, staging).select(F.lit(m).alias("match"), uuid_text(F.col("record_key")).alias("record_key"), "reason") for m in MATCHES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_HEX = "lower(regexp_replace(regexp_replace({0}, '[\\s{{}}-]', '', 'g'), '^urn:uuid:', '', 'i'))"


def _sql(tail: str) -> str:
    parts = []
    for name, key, ref, target, target_key in REFERENCES:
        parts.append(f"""
        select '{name}' as table_name, a.k, a.arrival,
               case when d.k is not null then 'deleted' when t.k is null then 'missing' when t.arrival > a.arrival then 'late' end as reason
        from (select {_HEX.format(key)} as k, {_HEX.format(ref)} as r, min(loaded_at) as arrival from {name} where {ref} is not null group by 1, 2) a
        left join (select {_HEX.format(target_key)} as k, min(loaded_at) as arrival from {target} group by 1) t on a.r = t.k
        left join (select distinct {_HEX.format('record_key')} as k from purged_keys where restored_at is null and table_name = '{target}') d on a.r = d.k""")
    return f"with bad as ({' union all '.join(parts)}) {tail}"


_TEXT = "concat_ws('-', substr(k, 1, 8), substr(k, 9, 4), substr(k, 13, 4), substr(k, 17, 4), substr(k, 21, 12))"

_COMPOSITE = f"""
with r as (select {_HEX.format('job_id')} as k, {_HEX.format('run_id')} as a, worker_id as b, min(loaded_at) as own from worker_jobs group by 1, 2, 3),
refs as (select k, a, b, min(own) over (partition by k) as arrival from r),
t as (select {_HEX.format('run_id')} as a, worker_id as b, min(loaded_at) as arrival from control_runs group by 1, 2),
whole as (select refs.k, refs.arrival, t.arrival as there, t.a is not null as present from refs left join t on refs.a = t.a and refs.b = t.b where refs.a is not null and refs.b is not null),
strict as (select k, case when not present then 'missing' when there > arrival then 'late' end as reason from whole),
byrun as (select refs.k, refs.arrival, min(t.arrival) as there, count(t.a) as n from refs left join t on refs.a = t.a where refs.a is not null and refs.b is null group by refs.k, refs.arrival, refs.a),
byworker as (select refs.k, refs.arrival, w.there, coalesce(w.n, 0) as n from refs left join (select b, min(arrival) as there, count(*) as n from t group by b) w on refs.b = w.b where refs.a is null and refs.b is not null),
bad as (
  select 'simple' as match, k, reason from strict union all select 'full', k, reason from strict union all select 'partial', k, reason from strict
  union all select 'full', k, 'incomplete' from refs where (a is null) <> (b is null)
  union all select 'partial', k, case when n = 0 then 'missing' when there > arrival then 'late' end from byrun
  union all select 'partial', k, case when n = 0 then 'missing' when there > arrival then 'late' end from byworker)
select distinct match, {_TEXT} as record_key, reason from bad where reason is not null"""

QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p1_composite": p1_composite}
SQL = {
    "p1_composite": _COMPOSITE,
    "p1_found": _sql(f"select distinct table_name, {_TEXT} as record_key, reason from bad where reason is not null"),
    "p1_report": _sql("select table_name, strftime(arrival, '%Y-%m') as period, reason, count(*) as n from bad where reason is not null group by 1, 2, 3"),
}
