"""A store of chunks: scans, point reads, search, replacement and overlays over one folder of the shared file system."""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import search, store
from codeloom.streaming.changes import Snapshots


class ChunkStore:
    """Chunks (id, file, start_line, content, symbol_name and any others) in versioned buckets with stored postings beside them.

    Readers resolve the version once for each query. A change replaces files in both; a reader in between finds chunks and
    postings of neighbouring versions, never half of one. `base` and `masked` (file) make it an overlay: what the base has is
    seen where it isn't masked."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, base: ChunkStore | None = None, masked: DataFrame | None = None):
        self.spark, self.root, self.base, self.masked = spark, root.rstrip("/"), base, masked
        self.rows = Snapshots(spark, f"{self.root}/chunks", buckets)
        self.index = search.PostingsIndex(spark, f"{self.root}/postings", buckets)
        self.seen, self.checked = self.rows.version(), 0

    def insert(self, batches: Iterator[DataFrame]) -> int:
        """Builds the store from batches, written as one: how many files a batch has is the caller's affair."""
        whole = None
        for b in batches:
            whole = b if whole is None else whole.unionByName(b)
        return self.version() if whole is None else self.publish(whole)

    def publish(self, chunks: DataFrame) -> int:
        v = self.rows.publish(chunks)
        known = self.index.segments()
        gone = self.index.sizes().select("file").distinct() if known else None
        self.index.update(self.rows.read(chunks.schema), gone)
        return v

    def replace(self, chunks: DataFrame, deleted: DataFrame | None = None) -> int:
        """chunks become all there is of their files; files of `deleted` go."""
        gone = self.spark.createDataFrame([], "file string") if deleted is None else deleted.select("file")
        v = self.rows.replace(chunks, gone)
        self.index.update(chunks, gone)
        return v

    def delete(self, files: DataFrame) -> int:
        return self.replace(self.read().limit(0), files)

    def clear(self) -> int:
        return self.publish(self.read().limit(0))

    def version(self) -> int:
        return self.rows.version()

    def stale(self, now_ms: int | None = None) -> bool:
        """Has something been published since this reader looked last? Asked at most once a second."""
        newer, self.checked = store.newer(self.version(), self.seen, int(time.time() * 1000) if now_ms is None else now_ms, self.checked)
        self.seen = self.version() if newer else self.seen
        return newer

    def read(self) -> DataFrame:
        """Every chunk that a reader accepts; an overlay's own and the base's that aren't masked."""
        own = self.rows.read()
        if self.base is None:
            if own is None:
                raise ValueError("the store is empty")
            return store.valid(own)
        below = self.base.read()
        hidden = self.spark.createDataFrame([], "file string") if self.masked is None else self.masked.select("file")
        return store.overlay_view(below, below.limit(0) if own is None else store.valid(own), hidden.distinct())

    def by_files(self, files: list[str]) -> DataFrame:
        return store.by_files(self.read(), files)

    def has_data(self) -> bool:
        own = self.rows.read()
        return own is not None and store.has_data(own)

    def search(self, queries: DataFrame, limit: int = 5, counts: DataFrame | None = None) -> DataFrame:
        """query, id, file, rank for (query, text) rows; an overlay merges its own best with the base's best that aren't masked."""
        one = lambda s: search.structurally_ranked(s.index.search(queries), s.rows.read(), counts, limit).select("query", "id", "file", F.col("key").alias("score"))
        if self.base is None:
            return search.ranked(one(self), limit).select("query", "id", "file", "rank")
        from codeloom.operators.review import merged_hits

        hidden = self.spark.createDataFrame([], "file string") if self.masked is None else self.masked.select("file").distinct()
        below = one(self.base)
        own = one(self) if self.rows.version() >= 0 else below.limit(0)
        return merged_hits(own, below, hidden, limit).select("query", "id", "file", "rank")
