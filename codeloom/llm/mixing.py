"""Mixing sources to target weights along a curriculum whose weights change over the training run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import WORD, Scratch, partitions, text_or_empty

#: Weight schedules over training time 0..1 as (time, weight) knots, dealt to the sources in turn: their integrals are the
#: weights 5, 2 and 1. The heavy sources fade, the light ones grow.
SCHEDULES = (((0.0, 7.5), (1.0, 2.5)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 0.5), (1.0, 1.5)))
MOST = 3
#: A source is dealt into so many buckets by the first hex digits of md5(doc_id), which orders it.
_DIGITS = 3


def integral(knots: tuple[tuple[float, float], ...]) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False))


def inverse(demand: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """The time by which the share `demand` (0..1) of a schedule's integral has passed; piecewise linear weights."""
    whole, done, out = integral(knots), 0.0, F.lit(float(knots[-1][0]))
    steps = []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        area = (t1 - t0) * (w0 + w1) / 2
        rest = demand * F.lit(whole) - F.lit(done)
        slope = (w1 - w0) / (t1 - t0)
        within = rest / F.lit(w0) if slope == 0 else (F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + F.lit(2 * slope) * rest)) - F.lit(w0)) / F.lit(slope)
        steps.append((demand * F.lit(whole) <= F.lit(done + area), F.lit(t0) + within))
        done += area
    for test, value in reversed(steps):
        out = F.when(test, value).otherwise(out)
    return F.least(F.lit(float(knots[-1][0])), F.greatest(F.lit(float(knots[0][0])), out))


def ranked_sources(sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """(source, source_size) with `place`, from 0 by code point, null last: a range partition, places within each, and the
    sources in the ranges before, one row for each range."""
    order = F.col("source").asc_nulls_last()
    ranged = scratch.table(sizes.repartitionByRange(partitions(sizes), order).withColumn("range", F.spark_partition_id()), "sources")
    counts = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))  # a row for each range
    inside = F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1
    return ranged.withColumn("inside", inside).join(F.broadcast(before), "range").withColumn("place", F.col("before") + F.col("inside")).drop("range", "before", "inside")


def targets(sizes: DataFrame, scratch: Scratch, schedules=SCHEDULES, most: int = MOST) -> DataFrame:
    """source, source_size, target, turn from (source, source_size): one row per source, shared by weight up to the limit.

    Sources share what the ones at their limit leave, by weight, until none is above: each round is one sum over the
    sources, of which the driver sees three numbers, and at least one more source reaches its limit. However many sources
    there are, none of them is sent anywhere but by range or hash.
    """
    weights = F.array(*(F.lit(integral(k)) for k in schedules))
    s = ranked_sources(sizes, scratch).withColumn("turn", (F.col("place") % len(schedules)).cast("int"))
    s = s.withColumn("weight", F.element_at(weights, F.col("turn") + 1)).withColumn("limit", F.col("source_size") * most)
    s = scratch.table(s.drop("place"), "weighted")
    total, level, full = s.agg(F.sum("source_size")).first()[0] or 0, 0.0, -1
    while True:
        over = F.lit(level) * F.col("weight") > F.col("limit")
        row = s.agg(F.count_if(over).alias("full"), F.sum(F.when(over, F.col("limit")).otherwise(0)).alias("taken"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("free")).first()
        if row["full"] == full or not row["free"]:
            break
        full, level = row["full"], float(total - row["taken"]) / row["free"]
    goal = F.least(F.col("limit").cast("double"), F.lit(level) * F.col("weight"))
    return s.select("source", "source_size", goal.alias("target"), "turn")


def curriculum(docs: DataFrame, scratch: Scratch, schedules=SCHEDULES, most: int = MOST) -> DataFrame:
    """docs (doc_id, source, size and any others) with source_size, target, `copies` and first_position, in no order: the
    caller ends with range_sorted() over copies, or by first_position.

    copies: array of (copy, words, position), one for each time that the mix takes the document; words is its size but for
    one document of each source, whose last copy ends where the source's target does. Within a source documents stand in
    the order of md5(doc_id); the n-th word taken from a source comes at the time by which the source's schedule has
    demanded n words. A null doc_id orders as the empty string, a null source is a source of its own and the last, a
    document without words has no copies, repeated rows are taken each, an empty table gives no rows. Columns of docs with the
    names of the new ones give way to them.
    """
    docs = docs.select(*(c for c in docs.columns if c not in ("source_size", "target", "copies", "first_position")))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    keyed = docs.withColumn("mix_key", key).withColumn("mix_bucket", F.substring("mix_key", 1, _DIGITS))
    by_bucket = scratch.table(keyed.groupBy("source", "mix_bucket").agg(F.sum("size").alias("bucket_size")), "buckets")
    goals = targets(by_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), scratch, schedules, most)
    earlier = F.sum("bucket_size").over(Window.partitionBy("source").orderBy("mix_bucket"))
    offsets = by_bucket.withColumn("bucket_start", earlier - F.col("bucket_size"))
    offsets = offsets.join(goals, offsets["source"].eqNullSafe(goals["source"])).drop(goals["source"])
    offsets = offsets.select(F.col("source").alias("mix_source"), F.col("mix_bucket").alias("mix_of"), "bucket_start", "source_size", "target", "turn")
    inside = F.sum("size").over(Window.partitionBy("source", "mix_bucket").orderBy("mix_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    placed = keyed.withColumn("mix_inside", inside - F.col("size"))
    placed = placed.join(offsets, placed["source"].eqNullSafe(offsets["mix_source"]) & (placed["mix_bucket"] == offsets["mix_of"]))
    before = F.col("bucket_start") + F.col("mix_inside")
    wanted = F.round("target").cast("long")

    def copy(k: Column) -> Column:
        start = k * F.col("source_size") + before
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), wanted - start))
        share = start / wanted
        when = F.lit(None).cast("double")
        for turn, knots in enumerate(schedules):
            when = F.when(F.col("turn") == turn, inverse(share, knots)).otherwise(when)
        return F.struct(k.cast("int").alias("copy"), words.alias("words"), when.alias("position"))

    copies = F.filter(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), copy), lambda c: c["words"] > 0)
    out = placed.withColumn("copies", copies).drop("mix_key", "mix_bucket", "mix_inside", "mix_source", "mix_of", "bucket_start", "turn")
    return out.withColumn("first_position", F.get(out["copies"], F.lit(0))["position"])


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def range_sorted(copies: DataFrame) -> DataFrame:
    """One row per copy in training order: range-partitioned by position, ties by doc_id and copy."""
    return copies.repartitionByRange(partitions(copies), "position", "doc_id", "copy").sortWithinPartitions("position", "doc_id", "copy")


def op5_curriculum_mix(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "mix")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", word_count(text_or_empty()).alias("size"))
    mixed = curriculum(scratch.table(docs, "sizes"), scratch)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    rows = mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "first_position")
    order = F.col("first_position").asc_nulls_last(), F.col("doc_id")
    return rows.repartitionByRange(partitions(rows), *order).sortWithinPartitions(*order)


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, source_size * 3 AS lim, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
        ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT AS turn FROM s),
l AS (SELECT *, (sum(source_size) OVER () - (sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) - lim))::DOUBLE
        / sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
m AS (SELECT *, max(CASE WHEN lev * weight <= lim THEN lev END) OVER () AS level FROM l),
t AS (SELECT source, source_size, turn, coalesce(least(lim::DOUBLE, level * weight), lim::DOUBLE) AS target FROM m),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.turn, round(t.target)::BIGINT AS wanted,
        (sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(d.doc_id::VARCHAR), d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS bef
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, greatest(0, least(size, wanted - bef)) + greatest(0, least(size, wanted - source_size - bef)) + greatest(0, least(size, wanted - 2 * source_size - bef)) AS taken FROM p)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken,
  CASE WHEN least(size, wanted - bef) > 0 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, CASE turn
    WHEN 0 THEN (sqrt(greatest(0.0::DOUBLE, 56.25::DOUBLE + -10.0::DOUBLE * (bef::DOUBLE / wanted::DOUBLE * 5.0::DOUBLE))) - 7.5::DOUBLE) / -5.0::DOUBLE
    WHEN 1 THEN bef::DOUBLE / wanted::DOUBLE * 2.0::DOUBLE / 2.0::DOUBLE
    ELSE (sqrt(greatest(0.0::DOUBLE, 0.25::DOUBLE + 2.0::DOUBLE * (bef::DOUBLE / wanted::DOUBLE * 1.0::DOUBLE))) - 0.5::DOUBLE) / 1.0::DOUBLE END)) END AS first_position
FROM q
"""
