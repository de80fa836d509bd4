"""Histogram sort: equal shards of bytes from exact counts below candidate boundaries, and one exchange.

DataFrame operations only. Rows are ordered by (text hash, doc_id), so equal texts stand side by side. A boundary between
shards falls between two texts; only inside a group of copies that is larger than `whole` of a shard's share may it fall
between two of its documents, as no shards of near equal bytes could be cut otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import Scratch, partitions, text_or_empty

_LOW = -(1 << 63)
_HIGH = (1 << 63) - 1


@dataclass(frozen=True)
class _Span:
    """Keys that still hold a splitter: hashes low..high, or the documents low..high of one hash."""

    hash: int | None
    low: int
    high: int

    def cell(self, n: int, bins: int) -> str:
        """SQL: the number of the probe interval that a row of this span falls into."""
        c, lo, hi = ("h" if self.hash is None else "d"), self.low, self.high
        own = f"h BETWEEN {_sql(lo)} AND {_sql(hi)}" if self.hash is None else f"h = {_sql(self.hash)} AND d BETWEEN {_sql(lo)} AND {_sql(hi)}"
        width = (hi - lo) // bins + 1
        at = f"IF({c} < 0, 0, 1)" if hi - lo > _HIGH else f"({c} - {_sql(lo)}) DIV {width}L"
        return f"WHEN {own} THEN {n * bins}L + {at}"


def _sql(x: int) -> str:
    return "(-9223372036854775807L - 1L)" if x == _LOW else f"({x}L)"


def _after(h: int, d: int) -> tuple[int, int]:
    return (h, d + 1) if d < _HIGH else (h + 1, _LOW)


def splitters(keys: DataFrame, shards: int, per_shard: int = 1, tolerance: float = 0.002, whole: float = 0.02, bins: int = 1 << 16) -> list[tuple[int, int]]:
    """shards * per_shard - 1 keys (h, d); the bytes (column size) below the i-th come near i / (shards * per_shard) of all.

    Each round counts the exact bytes between candidate boundaries in every partition at once, keeps the interval that
    holds each target, and sets new candidates inside it, until a boundary between shards lies within `tolerance` of a
    shard's share (one between ranges of a shard within a twentieth of a range's), or the interval holds one document, or
    one group of equal hashes that is no more than `whole` of a shard's share. About `bins` rows a round reach the driver,
    whatever the input.
    """
    ranges = shards * per_shard
    all_ = keys.agg(F.sum("size"), F.min("h"), F.max("h")).first()
    total = all_[0] or 0
    if not total:
        return []
    found: dict[int, tuple[int, int]] = {}
    open_: dict[int, tuple[_Span, int]] = {i: (_Span(None, all_[1], all_[2]), 0) for i in range(1, ranges)}
    while open_:
        spans = list(dict.fromkeys(span for span, _ in open_.values()))
        each = max(16, bins // len(spans))
        cell = F.expr("CASE " + " ".join(s.cell(n, each) for n, s in enumerate(spans)) + " END")
        counted = keys.select(cell.alias("cell"), "h", "d", "size").where("cell IS NOT NULL").groupBy("cell").agg(F.sum("size"), F.count("*"), F.min("h"), F.max("h"), F.min("d"), F.max("d"))
        rows: dict[int, list] = {}
        for r in counted.collect():
            rows.setdefault(r[0] // each, []).append(r)
        for n in rows:
            rows[n].sort(key=lambda r: r[0])
        for i, (span, base) in list(open_.items()):
            between_shards = i % per_shard == 0
            near = tolerance * total / shards if between_shards else 0.05 * total / ranges
            target, below = total * i / ranges, base
            mine = rows[spans.index(span)]
            for k, (_, size, count, h0, h1, d0, d1) in enumerate(mine):  # noqa: B007
                if below + size > target or k + 1 == len(mine):
                    break
                below += size
            left, right = abs(target - below), abs(below + size - target)
            one_group = between_shards and span.hash is None and h0 == h1 and size <= whole * total / shards
            if min(left, right) <= near or one_group or count == 1 or (h0, d0) == (h1, d1):
                if left <= right:
                    found[i] = (h0, d0 if span.hash is not None else _LOW)
                else:
                    found[i] = _after(h1, d1) if span.hash is not None else _after(h1, _HIGH)
                del open_[i]
            else:
                open_[i] = (_Span(None, h0, h1) if h0 < h1 else _Span(h0, d0, d1), below)
    return [found[i] for i in range(1, ranges)]


def range_of(cuts: list[tuple[int, int]]) -> Column:
    """The number of splitters at or below a row's key, by a search tree of comparisons."""

    def below(low: int, high: int) -> str:
        if low == high:
            return str(low)
        mid = (low + high) // 2
        h, d = cuts[mid]
        return f"IF(h > {_sql(h)} OR (h = {_sql(h)} AND d >= {_sql(d)}), {below(mid + 1, high)}, {below(low, mid)})"

    return F.expr(below(0, len(cuts)))


def histogram_shards(rows: DataFrame, scratch: Scratch, shards: int = 16, ranges_per_shard: int | None = None, tolerance: float = 0.002, whole: float = 0.02) -> DataFrame:
    """rows with doc_id, size and h (a hash of the text), plus shard and slot; other columns travel with them.

    Each shard is cut into ranges of near equal bytes, 4 to 64 as the session has partitions, so that the one exchange deals
    shards * ranges_per_shard even groups; a slot is the exact number of rows in the earlier ranges of its shard plus the
    place in its range. Rows of one hash lie in one shard, unless they make up more than `whole` of a shard's share of bytes.
    A null doc_id sorts first, equal rows take neighbouring slots in any order, an empty table gives no rows. Columns of rows
    named shard or slot give way to these; any other name is left alone.
    """
    per = ranges_per_shard or min(64, max(4, -(-partitions(rows) // shards)))
    own = F.struct(*(F.col(c) for c in rows.columns if c not in ("shard", "slot")))
    table = scratch.table(rows.select(own.alias("row"), F.col("h"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW)).alias("d"), F.col("size")), "keys")
    cuts = splitters(table.select("h", "d", "size"), shards, per, tolerance, whole)
    ranged = table.withColumn("range", range_of(cuts))
    counts = {r[0]: r[1] for r in ranged.groupBy("range").count().collect()}  # at most one row for each range
    first, before = [], 0
    for k in range(shards * per):
        before = 0 if k % per == 0 else before
        first.append(before)
        before += counts.get(k, 0)
    start = F.element_at(F.lit(first), F.col("range") + 1)
    place = F.row_number().over(Window.partitionBy("range").orderBy("h", "d", "size"))
    return ranged.select("row.*", F.floor(F.col("range") / per).cast("int").alias("shard"), (start + place - 1).cast("long").alias("slot"))


def op7_histogram_sort(spark, sf_dir: str) -> DataFrame:
    text = text_or_empty()
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h")
    )
    out = histogram_shards(rows, Scratch(spark, "shards"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
