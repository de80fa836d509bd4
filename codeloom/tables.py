"""Tables written below the folder that the session shares: they cut lineage and outlive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Most stored bytes of a table that goes to every task by way of the driver, where it takes many times as much.
BROADCAST = 256 << 10


@contextmanager
def small_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Plans made inside broadcast at most BROADCAST stored bytes a side: the driver's memory doesn't follow the input, whatever the
    session's threshold, which is for sizes on disk, lets through."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    if spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold() <= BROADCAST:
        yield
        return
    spark.conf.set(name, str(BROADCAST))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset a local session gets a folder of its own (tests, notebooks); a cluster session is refused, since a
    machine-local folder would lose data there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="codeloom-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return f"file://{_own[app]}"


def partitions(df: DataFrame) -> int:
    """As many partitions as the session shuffles into."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


class Scratch:
    """Tables below one new folder. What drop() hasn't deleted before, the driver's file system deletes when the application ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def table(self, df: DataFrame, name: str, by: str | None = None, path: str | None = None) -> DataFrame:
        """df as a table that is written once; the DataFrame returned reads it."""
        path = path or self.path(name)
        writer = df.write.option("compression", "zstd")
        with small_broadcasts(self.spark):
            (writer.partitionBy(by) if by else writer).parquet(path)
        out = self.read(path, df.schema)
        out._scratch_path = path
        return out

    def sized(self, df: DataFrame, name: str) -> DataFrame:
        """table() with a hint for the join it goes into, by its stored size: to every task if that is small, else sorted."""
        out = self.table(df, name)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(out._scratch_path)
        size = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
        return out.hint("broadcast" if size <= BROADCAST else "merge")

    def read(self, path: str, schema) -> DataFrame:
        for field in schema.fields:
            field.nullable = True
        return self.spark.read.schema(schema).option("recursiveFileLookup", "false").parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables of table(), or all of them."""
        paths = [t._scratch_path for t in tables] or [self.root]
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for p in paths:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)
