"""Ledger analytics: time windows, funnels from shown nudges to acts, unacted nudges, edits against test runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within(events: DataFrame, days: int, now: str) -> DataFrame:
    """Events of the last `days` days up to now; the boundary itself counts, rows without a time do not."""
    since = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return events.where(F.col("ts").isNotNull() & (F.col("ts") >= since))


def window_stats(events: DataFrame, levels: list[str]) -> DataFrame:
    """runs, distinct (file, symbol), one count for each level and one for unknown levels, from runs (file, changes: an array of
    structs with symbol and level): a run is one row, whatever it changed, and counts even if it changed nothing."""
    rows = events.select("file", F.explode_outer("changes").alias("c"))
    level = F.col("c.level")
    cols = [F.countDistinct(F.when(F.col("c").isNotNull(), F.struct("file", "c.symbol"))).alias("distinct_symbols")]
    cols += [F.count_if(F.col("c").isNotNull() & (level == x)).alias(x) for x in levels]
    cols.append(F.count_if(F.col("c").isNotNull() & ~F.coalesce(level.isin(levels), F.lit(False))).alias("unknown"))
    return events.agg(F.count("*").alias("runs")).crossJoin(rows.agg(*cols))  # one row each


def funnel(shown: DataFrame, signals: DataFrame, acts: Column) -> DataFrame:
    """nudge, shown, acted, share: a shown nudge is acted on if a matching signal of its session comes at or after it.

    `acts` compares columns of s (shown) and g (signal). For each session and join key only the latest signal matters, so
    the signals are reduced before the join and no shown row meets more than the distinct (signal, file, symbol) of its
    session."""
    last = signals.groupBy("session", "signal", "file", "symbol").agg(F.max("ts").alias("ts"))
    s, g = shown.alias("s"), last.alias("g")
    acted = s.join(g, (F.col("s.session") == F.col("g.session")) & (F.col("g.ts") >= F.col("s.ts")) & acts, "left_semi").select("event_id").withColumn("acted", F.lit(1))
    out = shown.join(acted, "event_id", "left").groupBy("nudge").agg(F.count("*").alias("shown"), F.count("acted").alias("acted"))
    return out.withColumn("share", F.round(F.try_divide(F.col("acted"), F.col("shown")), 6))


def unacted(shown: DataFrame, signals: DataFrame) -> DataFrame:
    """session, file, symbol, first, last: shown nudges with no dependents signal on the same pair at or after the last."""
    g = shown.groupBy("session", "file", "symbol").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    done = signals.where("signal = 'dependents'").groupBy("session", "file", "symbol").agg(F.max("ts").alias("acted_at"))
    return g.join(done, ["session", "file", "symbol"], "left").where(F.col("acted_at").isNull() | (F.col("acted_at") < F.col("last"))).drop("acted_at")


def delta_window(runs: DataFrame) -> DataFrame:
    """From (run, ts, file, symbol, crossing): distinct flagged pairs, and those absent from some strictly later run.

    A pair is missing from a later run if it is flagged in fewer runs than there are from its first one on. Runs are counted by
    ranges of their times, with one sum for each range, and met by an equi-join on the time."""
    flagged = runs.where("crossing").groupBy("file", "symbol").agg(F.countDistinct("ts").alias("flags"), F.min("ts").alias("first"))
    times = runs.select("ts").distinct().repartitionByRange("ts").withColumn("part", F.spark_partition_id())
    per_part = times.groupBy("part").agg(F.count("*").alias("n"), F.min("ts").alias("low"))
    after = per_part.withColumn("after", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("low")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "after")  # one row a range
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("ts"))) - 1
    ranked = times.withColumn("inside", inside).join(after, "part").select("ts", (F.col("inside") + F.col("after")).alias("later_runs"))
    out = flagged.join(ranked, flagged["first"] == ranked["ts"]).withColumn("resolved", F.col("later_runs") > F.col("flags") - 1)
    return out.agg(F.count("*").alias("flagged"), F.count_if("resolved").alias("resolved"))


def run_stats(runs: DataFrame) -> DataFrame:
    """runs, crossing_runs, soft_share from runs (crossings, soft): of the runs that crossed something the share that was soft, null
    without any."""
    crossing = F.col("crossings") > 0
    out = runs.agg(F.count("*").alias("runs"), F.count_if(crossing).alias("crossing_runs"), F.count_if(crossing & F.col("soft")).alias("soft"))
    return out.select("runs", "crossing_runs", F.round(F.try_divide(F.col("soft"), F.col("crossing_runs")), 6).alias("soft_share"))


def last_wins(events: DataFrame, key: list[str], *order: Column | str) -> DataFrame:
    """The last event of each key."""
    return events.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rank = 1").drop("_rank")


def unverified(edits: DataFrame, runs: DataFrame) -> DataFrame:
    """Edits that no later test run of their session covers: a broad run covers everything, else a scope token must be the
    file's stem or folder."""
    broad = runs.where("broad").groupBy("session").agg(F.max("ts").alias("broad_at"))
    scoped = runs.where("NOT broad").select("session", "ts", F.explode("scopes").alias("scope")).groupBy("session", "scope").agg(F.max("ts").alias("scope_at"))
    keys = edits.withColumn("scope", F.explode(F.array("file", "folder")))
    hit = keys.join(scoped, ["session", "scope"]).where("scope_at >= ts").select("event_id").distinct()
    left = edits.join(hit, "event_id", "left_anti").join(broad, "session", "left")
    return left.where(F.col("broad_at").isNull() | (F.col("broad_at") < F.col("ts"))).drop("broad_at")


def near_comments(findings: DataFrame, comments: DataFrame, tolerance: int = 30) -> DataFrame:
    """Findings with no comment on the same file and category within `tolerance` lines: a band join through buckets of
    tolerance + 1 lines, each finding looking at its own bucket and both neighbours."""
    width = tolerance + 1
    c = comments.select("file", "category", F.col("line").alias("comment_line"), F.floor(F.col("line") / width).alias("bucket")).distinct()
    f = findings.withColumn("bucket", F.explode(F.array(*(F.floor(F.col("line") / width) + i for i in (-1, 0, 1)))))
    hit = f.join(c, ["file", "category", "bucket"]).where(F.abs(F.col("line") - F.col("comment_line")) <= tolerance).select("id").distinct()
    return findings.join(hit, "id", "left_anti")
