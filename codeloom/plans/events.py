"""Ledger queries over events, conversations and pages (synthetic bindings)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import events as E
from codeloom.plans.registry import query
from codeloom.sources.adapters import LEDGER, ledger, table

_L = f"WITH {LEDGER} "
_NOW = "2024-02-01 00:00:00"
_LEVELS = ["low", "medium", "high", "critical"]
_NOW_SQL = "(SELECT max(ts) FROM events)"


def _now(spark, d) -> str:
    return str(table(spark, d, "events").agg(F.max("ts")).first()[0])


def _stats_sql(days):
    counts = ", ".join(f"count(*) FILTER (WHERE level = '{x}')::BIGINT AS {x}" for x in _LEVELS)
    return _L + f""", run AS (SELECT session, date_trunc('hour', ts) AS ts, file FROM ledger GROUP BY 1, 2, 3), c AS (SELECT r.*, l.symbol, l.level FROM run r JOIN ledger l ON l.session = r.session AND l.file = r.file AND date_trunc('hour', l.ts) = r.ts AND l.kind = 'signal' WHERE r.ts >= {_NOW_SQL} - INTERVAL {days} DAY)
SELECT (SELECT count(*) FROM run WHERE ts >= {_NOW_SQL} - INTERVAL {days} DAY)::BIGINT AS runs, count(DISTINCT (file, symbol))::BIGINT AS distinct_symbols, {counts}, count(*) FILTER (WHERE level = 'other')::BIGINT AS unknown FROM c"""


def _runs(spark, d):
    """A run: what one session does in a file within an hour; its signals are the changes, perhaps none."""
    change = F.when(F.col("kind") == "signal", F.struct("symbol", "level"))
    return ledger(spark, d).groupBy("session", F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("ts"), "file").agg(F.collect_list(change).alias("changes"))


@query("g15_window_7d", _stats_sql(7))
def window_7d(spark, d):
    return E.window_stats(E.within(_runs(spark, d), 7, _now(spark, d)), _LEVELS)


@query("g15_window_30d", _stats_sql(30))
def window_30d(spark, d):
    return E.window_stats(E.within(_runs(spark, d), 30, _now(spark, d)), _LEVELS)


_ACTS = "(s.nudge = 'annotate' AND g.signal IN ('files_context', 'dependents') AND s.file = g.file OR s.nudge = 'blast' AND g.signal = 'dependents' AND (s.file = g.file OR s.symbol = g.symbol))"


@query("g17_nudge_funnels", _L + f", shown AS (SELECT * FROM ledger WHERE kind = 'shown'), sig AS (SELECT * FROM ledger WHERE kind = 'signal'), a AS (SELECT s.nudge, EXISTS (SELECT 1 FROM sig g WHERE g.session = s.session AND g.ts >= s.ts AND {_ACTS}) AS acted FROM shown s) SELECT nudge, count(*)::BIGINT AS shown, count(*) FILTER (WHERE acted)::BIGINT AS acted, round(count(*) FILTER (WHERE acted) / count(*)::DOUBLE, 6) AS share FROM a GROUP BY nudge")
def nudge_funnels(spark, d):
    rows = ledger(spark, d)
    return E.funnel(rows.where("kind = 'shown'").select("event_id", "session", "ts", "nudge", "file", "symbol"), rows.where("kind = 'signal'"), F.expr(_ACTS))


@query("g18_unacted", _L + ", g AS (SELECT session, file, symbol, min(ts) AS first, max(ts) AS last FROM ledger WHERE nudge = 'blast' GROUP BY 1, 2, 3), x AS (SELECT session, file, symbol, max(ts) AS t FROM ledger WHERE signal = 'dependents' GROUP BY 1, 2, 3) SELECT g.session, g.file, g.symbol, epoch_us(g.first)::BIGINT AS first, epoch_us(g.last)::BIGINT AS last FROM g LEFT JOIN x ON x.session = g.session AND x.file = g.file AND x.symbol = g.symbol WHERE x.t IS NULL OR x.t < g.last")
def unacted(spark, d):
    rows = ledger(spark, d)
    out = E.unacted(rows.where("nudge = 'blast'"), rows.where("kind = 'signal'"))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return out.select("session", "file", "symbol", us("first").alias("first"), us("last").alias("last"))


@query("g16_delta_window", _L + ", r AS (SELECT date_trunc('day', ts) AS day, file, symbol, value > 60 AS crossing FROM ledger), f AS (SELECT file, symbol, count(DISTINCT day) AS flags, min(day) AS first FROM r WHERE crossing GROUP BY 1, 2), days AS (SELECT DISTINCT day FROM r) SELECT count(*)::BIGINT AS flagged, count(*) FILTER (WHERE (SELECT count(*) FROM days WHERE day > f.first) > f.flags - 1)::BIGINT AS resolved FROM f")
def delta_window(spark, d):
    rows = ledger(spark, d).select(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("ts"), "file", "symbol", (F.col("value") > 60).alias("crossing"))
    return E.delta_window(rows)


@query("k7_last_edit", _L + "SELECT session, file, event_id FROM (SELECT *, row_number() OVER (PARTITION BY session, file ORDER BY ts DESC, event_id DESC) AS r FROM ledger) WHERE r = 1")
def last_edit(spark, d):
    return E.last_wins(ledger(spark, d), ["session", "file"], F.desc("ts"), F.desc("event_id")).select("session", "file", "event_id")


@query("k8_daily_activity", "SELECT epoch_ms(date_trunc('day', ts))::BIGINT AS day_ms, event_type, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users FROM events GROUP BY 1, 2")
def daily_activity(spark, d):
    w = F.window(F.col("ts").cast("timestamp"), "1 day")
    return table(spark, d, "events").groupBy(F.unix_millis(w["start"]).alias("day_ms"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("j26_unverified_edits", """WITH t AS (SELECT conv_id * 1000 + turn AS event_id, conv_id AS session, turn AS ts, role, 'm' || (turn % 4) AS file, 'd' || (conv_id % 3) AS folder, length(text) AS n FROM conversations),
e AS (SELECT * FROM t WHERE role = 'user'), r AS (SELECT session, ts, n % 5 = 0 AS broad, ['m' || (n % 4), 'd' || (n % 7)] AS scopes FROM t WHERE role = 'assistant')
SELECT event_id, session, file FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.session = e.session AND r.ts >= e.ts AND (r.broad OR list_contains(r.scopes, e.file) OR list_contains(r.scopes, e.folder)))""")
def unverified_edits(spark, d):
    n = F.length("text")
    t = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("event_id"), F.col("conv_id").alias("session"), F.col("turn").alias("ts"), "role", F.concat(F.lit("m"), F.col("turn") % 4).alias("file"), F.concat(F.lit("d"), F.col("conv_id") % 3).alias("folder"), n.alias("n"))
    runs = t.where("role = 'assistant'").select("session", "ts", (F.col("n") % 5 == 0).alias("broad"), F.array(F.concat(F.lit("m"), F.col("n") % 4), F.concat(F.lit("d"), F.col("n") % 7)).alias("scopes"))
    return E.unverified(t.where("role = 'user'").select("event_id", "session", "ts", "file", "folder"), runs).select("event_id", "session", "file")


@query("j24_new_findings", """WITH f AS (SELECT event_id AS id, 'f' || (user_id % 20) AS file, event_type AS category, (event_id * 37) % 2000 AS line FROM events),
c AS (SELECT 'f' || (user_id % 20) AS file, event_type AS category, (event_id * 53) % 2000 AS line FROM events WHERE value > 90)
SELECT id, file, category, line FROM f WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.file = f.file AND c.category = f.category AND abs(c.line - f.line) <= 30)""")
def new_findings(spark, d):
    """Every event is a finding; those of a high value have been commented on, elsewhere."""
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("f"), F.col("user_id") % 20).alias("file"), F.col("event_type").alias("category"), "value")
    comments = e.where("value > 90").withColumn("line", (F.col("id") * 53) % 2000)
    return E.near_comments(e.drop("value").withColumn("line", (F.col("id") * 37) % 2000), comments)


@query("a11_ledger_read", "SELECT event_id, json_extract(props, '$.k')::INT AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def ledger_read(spark, d):
    """JSON lines with rows that do not parse left out."""
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k")).where("k IS NOT NULL")


@query("k1_last_changes", "SELECT 'f' || user_id AS file, arg_max(event_type, ts) AS kind, epoch_us(max(ts))::BIGINT AS at FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) AS r FROM events) WHERE r = 1 GROUP BY user_id")
def last_changes(spark, d):
    """The last event of each path, as one batch of a change stream keeps it."""
    from codeloom.streaming.changes import latest

    e = table(spark, d, "events")
    one = E.last_wins(e, ["user_id", "ts"], "event_id")
    batch = one.select(F.concat(F.lit("f"), "user_id").alias("file"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts"), F.lit("").alias("content"))
    return latest(batch).select("file", "kind", F.unix_micros("ts").alias("at"))
