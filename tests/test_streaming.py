import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

import __spark_entry__ as entry
from docloom.operators import ops, web
from docloom.sources.tables import KeyedTable
from docloom.streaming import state

KIND = "user long, at timestamp, n long, body string"


@pytest.fixture
def files(spark, tmp_path):
    t = datetime(2025, 1, 1)
    for day in range(3):
        rows = [(u, t + timedelta(days=day, seconds=i), day * 100 + i, "ab"[(i * u + day) % 2]) for i in range(12) for u in (1, 2, 3)]
        rows = [(u, at, n * 10 + u, b) for u, at, n, b in rows] + [(None, t, 10**6 + day, "z")]
        spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(f"{tmp_path}/in/day{day}")
    return f"{tmp_path}/in/*", str(tmp_path)


def run(spark, df, name, where):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{where}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def stream(spark, path):
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(path)


def test_monitor_equals_batch(spark, files):
    path, where = files
    out = run(spark, state.monitor(stream(spark, path), "user", "body", "at", "n"), "monitored", where)
    batch = web.monitor(spark.read.schema(KIND).parquet(path).where("user is not null"), "user", "body", "at", "n")
    cols = ["user", "n", "body_sha256", "previous_sha256", "changed"]
    assert sorted(map(tuple, out.select(cols).collect())) == sorted(map(tuple, batch.select(cols).collect()), key=lambda r: tuple((x is not None, x) for x in r)) or set(out.select(cols).collect()) == set(batch.select(cols).collect())


def test_rate_limit_equals_batch(spark, files):
    path, where = files
    out = run(spark, state.rate_limit(stream(spark, path), "user", "at", "n", rate=0.5, burst=2), "limited", where)
    batch = ops.rate_limit(spark.read.schema(KIND).parquet(path).where("user is not null"), "user", "at", "n", rate=0.5, burst=2)
    key = lambda df: {(r.user, r.n): (round(r.wait_seconds, 6), r.admitted) for r in df.collect()}
    assert key(out) == key(batch)


def test_keep_last_table(spark, files):
    path, where = files
    table = KeyedTable(spark, f"file://{where}/table", ["user"], ["at", "n"])
    for _ in range(2):  # the second start has nothing new
        state.keep_last(stream(spark, path).where("user is not null"), table, f"{where}/ck").awaitTermination(120)
    got = {r.user: r.n for r in table.read().collect()}
    want = {r.user: r.n for r in ops.last_by(spark.read.schema(KIND).parquet(path).where("user is not null"), ["user"], ["at", "n"]).collect()}
    assert got == want


def test_a_new_checkpoint_loses_nothing(spark, files):
    path, where = files
    table = KeyedTable(spark, f"file://{where}/table2", ["user"], ["at", "n"])
    state.keep_last(stream(spark, path).where("user = 1"), table, f"{where}/ck-a").awaitTermination(120)
    state.keep_last(stream(spark, path).where("user in (2, 3)"), table, f"{where}/ck-b").awaitTermination(120)
    assert sorted(r.user for r in table.read().collect()) == [1, 2, 3]


def test_repeats_are_dropped(spark, files):
    path, where = files
    out = run(spark, state.drop_repeats(stream(spark, path).where("user is not null"), ["user"], "at", "30 days").select("user"), "once", where)
    assert sorted(r.user for r in out.collect()) == [1, 2, 3]


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    """Tables of several files each, in folders, as larger tables come."""
    import duckdb

    base = tmp_path_factory.mktemp("folders")
    at = "timestamp '2025-01-01' + interval (i) minute"
    tables = {
        "documents": "select i as doc_id, 'red blue w' || (i % 7) as text, 'title ' || i as title, cast(null as varchar) as url from range(60) r(i)",
        "subject_areas": "select * from (values ('a', 'red w1'), ('b', 'blue title')) t(subject, scope)",
        "vector_records": f"select 'n' || (i % 2) as namespace, 'r' || (i % 20) as record_id, 'd' || i as document_id, [i::double, 1.0] as vector, map {{'k': 'v'}} as metadata, {at} as loaded_at from range(60) r(i)",
    }
    for name, query in tables.items():
        (base / f"{name}.parquet").mkdir()
        for part in range(3):
            duckdb.execute(f"copy (select * from ({query}) q qualify row_number() over () % 3 = {part}) to '{base}/{name}.parquet/part-{part}.parquet' (format parquet)")
    return str(base)


def equals_sql(spark, name, base):
    sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
    import compare
    import pandas as pd

    df = entry.queries()[name](spark, base)
    got = pd.DataFrame.from_records([r.asDict() for r in df.collect()], columns=df.columns)
    con = compare.views(base).execute(entry.oracle_sql()[name])
    want = pd.DataFrame.from_records(con.fetchall(), columns=[d[0] for d in con.description])
    assert len(got) and compare.canon(got) == compare.canon(want)


def test_index_add_from_a_folder_of_files(spark, folders):
    equals_sql(spark, "stream_index_add", folders)


def test_vector_upsert_from_a_folder_of_files(spark, folders):
    equals_sql(spark, "stream_vector_upsert", folders)


def test_vector_upsert_from_one_file_beside_tables_in_partitions(spark, folders, tmp_path):
    spark.read.parquet(f"{folders}/vector_records.parquet").coalesce(1).write.parquet(f"{tmp_path}/written")
    next((tmp_path / "written").glob("part-*.parquet")).rename(tmp_path / "vector_records.parquet")
    spark.range(4).selectExpr("id", "id % 2 as half").write.partitionBy("half").parquet(f"{tmp_path}/by_half")
    spark.range(4).selectExpr("id", "id % 3 as third").write.partitionBy("third").parquet(f"{tmp_path}/by_third")
    equals_sql(spark, "stream_vector_upsert", str(tmp_path))
