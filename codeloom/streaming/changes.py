"""File changes as a stream: last event per path wins in a batch, the store takes the batch as one replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.functions.columns import content_hash

CHANGE = T.StructType([T.StructField("file", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("content", T.StringType())])


def change_stream(spark: SparkSession, folder: str) -> DataFrame:
    """JSON change events (file, kind: upsert or delete, ts, content) as files arrive in folder."""
    return spark.readStream.schema(CHANGE).json(folder)


def latest(batch: DataFrame) -> DataFrame:
    """The last event of each path in a batch."""
    return batch.groupBy("file").agg(F.max_by(F.struct("kind", "ts", "content"), F.col("ts")).alias("e")).select("file", "e.*")


class Snapshots:
    """A table of chunks (with a file column) below one folder, dealt into buckets by file; each bucket has versions of its own, and
    a version of the whole names the one that counts of each bucket.

    data/bucket=K/v=N holds rows, versions/v=N one row a bucket: (bucket, version). A change writes the buckets of the files that
    it touches and then the new version; a crash before that leaves the old one current, and writing it again replaces it."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def version(self) -> int:
        """The version last published, -1 before the first. A reader asks for it once for each query."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/versions")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = (x.getPath() for x in (fs.listStatus(path) if fs.exists(path) else []))
        whole = (p for p in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))
        return max((int(p.getName()[1:]) for p in whole), default=-1)

    def _current(self) -> dict[int, int]:
        """bucket -> its version: as many rows as buckets."""
        v = self.version()
        return {} if v < 0 else {r["bucket"]: r["version"] for r in self.spark.read.parquet(f"{self.root}/versions/v{v}").collect()}

    def _bucket(self, file: str = "file") -> Column:
        return F.pmod(F.xxhash64(file), F.lit(self.buckets)).cast("int")

    def read(self, schema: T.StructType | None = None, buckets: set[int] | None = None) -> DataFrame | None:
        """The rows of the current version, of some buckets or all; without any the empty table of `schema`, or None."""
        paths = [f"{self.root}/data/bucket={b}/v{v}" for b, v in sorted(self._current().items()) if buckets is None or b in buckets]
        if paths:
            return self.spark.read.parquet(*paths)
        return None if schema is None else self.spark.createDataFrame([], schema)

    def _write(self, table: DataFrame, version: int, buckets: list[int]) -> None:
        """Rows of the buckets as their version, an empty one too, and the version of the whole."""
        ahead = self._current()
        staged = f"{self.root}/staged/v{version}"
        table.withColumn("bucket", self._bucket()).where(F.col("bucket").isin(buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(staged)
        jvm = self.spark._jvm
        fs = jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for b in buckets:  # a rename a bucket
            source, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{staged}/bucket={b}", f"{self.root}/data/bucket={b}/v{version}"))
            fs.delete(target, True)
            fs.mkdirs(target.getParent())
            if fs.exists(source):
                fs.rename(source, target)
                ahead[b] = version
            else:
                ahead.pop(b, None)
        fs.delete(jvm.org.apache.hadoop.fs.Path(staged), True)
        self.spark.createDataFrame(sorted(ahead.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/versions/v{version}")

    def publish(self, table: DataFrame, version: int | None = None) -> int:
        """Writes table as all there is."""
        v = self.version() + 1 if version is None else version
        self._write(table, v, list(range(self.buckets)))
        return v

    def replace(self, new: DataFrame, gone: DataFrame, version: int | None = None) -> int:
        """Takes new as all rows of its files, and files of `gone` away; only their buckets are read and written."""
        v = self.version() + 1 if version is None else version
        files = new.select("file").unionByName(gone.select("file")).distinct()
        touched = [r["b"] for r in files.select(self._bucket().alias("b")).distinct().collect()]  # at most as many as buckets
        old = self.read(new.schema, set(touched))
        kept = old.join(files, "file", "left_anti").select(*new.columns)
        self._write(kept.unionByName(new), v, touched)
        return v


def index_stream(changes: DataFrame, store: Snapshots, to_chunks, checkpoint: str):
    """A query that applies each batch: deletes, content that hashes alike is left alone, the rest is chunked anew. The first batch
    may meet an empty store.

    A batch publishes the version after its number, so that running it again changes nothing."""

    def apply(batch: DataFrame, number: int) -> None:
        if store.version() > number:
            return
        last = latest(batch)
        live = last.where("kind <> 'delete'").withColumn("content_hash", content_hash(F.col("content")))
        old = store.read()
        changed = live if old is None else live.join(old.select("file", "content_hash").distinct(), ["file", "content_hash"], "left_anti")
        store.replace(to_chunks(changed), last.where("kind = 'delete'").select("file"), number + 1)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


#: How long changes are gathered before a batch, and how often commits are looked for.
BATCH_WINDOW, COMMIT_POLL = "500 milliseconds", "10 seconds"


def commit_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Commits (sha, ts, file, kind, content) as JSON files arrive: the changes of each as a change stream. With a trigger of
    COMMIT_POLL this is the poll for commits, with BATCH_WINDOW the window of the watcher."""
    schema = T.StructType([T.StructField("sha", T.StringType()), *CHANGE.fields])
    return spark.readStream.schema(schema).json(folder).where("file IS NOT NULL").select(*(f.name for f in CHANGE.fields))


def reindex_state(progress: list[dict], now_ms: int, stuck_after_ms: int = 300_000) -> dict:
    """in_progress, batches, rows, last_duration_ms, stuck from a query's recentProgress and status: stuck if the last batch began
    longer ago than that and hasn't ended."""
    done = [p for p in progress if "batchDuration" in p]
    running = [p for p in progress if "batchDuration" not in p]
    began = max((p["started_ms"] for p in running), default=None)
    return {"in_progress": bool(running), "batches": len(done), "rows": sum(p.get("numInputRows", 0) for p in done), "last_duration_ms": done[-1]["batchDuration"] if done else None, "stuck": began is not None and now_ms - began > stuck_after_ms}


def counted(chunks: DataFrame, counts: DataFrame | None, chunks_version: int, counts_version: int | None) -> DataFrame:
    """Files of chunks with dependents, counts_version and stale: counts are made by a full index only, so after changes they stay
    what they were and say so; null where they were never made."""
    files = chunks.select("file").distinct()
    if counts is None or counts_version is None:
        return files.select("file", F.lit(None).cast("long").alias("dependents"), F.lit(None).cast("int").alias("counts_version"), F.lit(None).cast("boolean").alias("stale"))
    n = files.join(counts.select("file", "dependents"), "file", "left").select("file", F.coalesce("dependents", F.lit(0)).alias("dependents"))
    return n.withColumn("counts_version", F.lit(counts_version)).withColumn("stale", F.lit(counts_version < chunks_version))


def session_activity(events: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """Session windows per user over (user_id, ts) with a watermark; works on a stream as on a table."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
