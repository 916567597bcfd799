"""Tables in, and intermediate results cut from their lineage.

Intermediate results go to the shared folder that the session names in ``spark.checkpoint.dir``,
never to a folder of one machine, so a lost executor costs a task retry only. A local folder is
used solely where the session names none and runs on one machine (tests); it is removed at exit.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback: str | None = None


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    global _fallback
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    if _fallback is None:
        made = tempfile.mkdtemp(prefix="docloom-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        _fallback = f"file://{made}"
    return _fallback


STAGED = "docloom-staged"


def sweep(spark: SparkSession, older_than: float) -> int:
    """Removes staged tables that nothing has written to for so many seconds; how many.

    Results read from them are lazy, so only the session's owner knows when they are done with.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{STAGED}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return 0
    old = [s.getPath() for s in files.listStatus(path) if s.getModificationTime() < (time.time() - older_than) * 1000]
    for p in old:
        files.delete(p, True)
    return len(old)


class Staging:
    """Writes DataFrames as Parquet in the shared folder and reads them back, with no lineage left.

    ``drop`` removes a table that no later plan reads, so iterative jobs hold two rounds at most;
    ``clear`` removes all, once the results read from them are done with. ``sweep`` does so for
    whatever was left behind.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/{STAGED}/{label}-{uuid.uuid4().hex}"
        self.count = 0

    def put(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count:05d}"
        df.write.mode("overwrite").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._docloom_path = path
        return back

    def clear(self) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, *dfs: DataFrame | None) -> None:
        jvm = self.spark._jvm
        for df in dfs:
            path = getattr(df, "_docloom_path", None)
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
