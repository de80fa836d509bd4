"""Metric queries over functions made from lineitem (synthetic values)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import columns as C
from codeloom.operators import metrics
from codeloom.plans.registry import query
from codeloom.sources.adapters import FUNCTIONS, functions, table

_LIMITS = {"cyclomatic": 20.0, "cognitive": 15.0, "effort": 60_000.0, "bugs": 0.04}
_F = f"WITH {FUNCTIONS} "
_V = _F + """, u AS (SELECT file, symbol, unnest([{'metric': 'cyclomatic', 'value': cyclomatic::DOUBLE, 't': 20.0::DOUBLE}, {'metric': 'cognitive', 'value': cognitive::DOUBLE, 't': 15.0::DOUBLE}, {'metric': 'effort', 'value': effort, 't': 60000.0::DOUBLE}, {'metric': 'bugs', 'value': bugs, 't': 0.04::DOUBLE}]) AS m FROM functions),
v AS (SELECT file, symbol, m.metric AS metric, m.value AS value, CASE WHEN m.value >= 2 * m.t THEN 'error' ELSE 'warning' END AS severity FROM u WHERE m.value >= m.t) """
_R = _V + ", r AS (SELECT file, count(*) FILTER (WHERE severity = 'error')::BIGINT AS errors, count(*)::BIGINT AS violations FROM v GROUP BY file) "
_RISK = "CASE WHEN errors >= 3 THEN 'critical' WHEN errors > 0 THEN 'high' WHEN violations >= 3 THEN 'medium' ELSE 'low' END"
_C = _F + ", c AS (SELECT file, floor(avg(cyclomatic) * 10 + 0.5) / 10 AS avg, max(cyclomatic) AS max, sum(cyclomatic)::BIGINT AS sum, count(*)::BIGINT AS n FROM functions WHERE cyclomatic > 0 GROUP BY file) "


def _violations(spark, d):
    return metrics.violations(functions(spark, d), _LIMITS)


@query("g8_violations", _V + "SELECT file, symbol, metric, value, severity FROM v")
def violations(spark, d):
    return _violations(spark, d).select("file", "symbol", "metric", "value", "severity")


@query("g9_file_risk", _R + f"SELECT file, errors, violations, {_RISK} AS risk FROM r")
def file_risk(spark, d):
    return metrics.file_risk(_violations(spark, d))


@query("g10_report_summary", _V + "SELECT count(DISTINCT file)::BIGINT AS files, count(*)::BIGINT AS violations, count(*) FILTER (WHERE severity = 'error')::BIGINT AS errors, count(*) FILTER (WHERE metric = 'effort')::BIGINT AS effort, max(value) FILTER (WHERE metric = 'cyclomatic') AS worst FROM v")
def report_summary(spark, d):
    m = F.col("metric")
    return _violations(spark, d).agg(F.countDistinct("file").alias("files"), F.count("*").alias("violations"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(m == "effort").alias("effort"), F.max(F.when(m == "cyclomatic", F.col("value"))).alias("worst"))


@query("f5_top_violations", _V + "SELECT symbol, metric, value FROM v WHERE metric = 'effort' ORDER BY value DESC, symbol LIMIT 25")
def top_violations(spark, d):
    return _violations(spark, d).where("metric = 'effort'").orderBy(F.desc("value"), "symbol").limit(25).select("symbol", "metric", "value")


@query("g2_file_complexity", _C + "SELECT * FROM c")
def file_complexity(spark, d):
    return metrics.file_complexity(functions(spark, d))


@query("g3_overall_complexity", _C + ", w AS (SELECT string_agg(file, ',' ORDER BY max DESC, file) AS worst FROM (SELECT file, max FROM c WHERE max > 10 ORDER BY max DESC, file LIMIT 5)), o AS (SELECT floor(avg(avg) * 10 + 0.5) / 10 AS avg, max(max) AS max FROM c) SELECT avg, max, worst, CASE WHEN avg > 15 OR max > 25 THEN 'critical' WHEN avg > 10 OR max > 20 THEN 'high' WHEN avg > 6 OR max > 15 THEN 'medium' ELSE 'low' END AS risk FROM o, w")
def overall_complexity(spark, d):
    return metrics.overall(metrics.file_complexity(functions(spark, d)))


@query("g23_headroom", _F + ", n AS (SELECT file, symbol, greatest(cyclomatic, cognitive) / 15.0::DOUBLE AS ratio FROM functions), r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ratio DESC, symbol)::INT AS rank, greatest(0, count(*) OVER (PARTITION BY file)::INT - 5) AS overflow FROM n WHERE ratio >= 0.8 AND ratio < 1) SELECT file, symbol, rank, overflow FROM r WHERE rank <= 5")
def headroom(spark, d):
    return metrics.headroom(functions(spark, d)).select("file", "symbol", "rank", "overflow")


_SHAPES = "shapes AS (SELECT 'f' || (l_orderkey % 600) AS file, ['class', 'function', 'method', 'method'][l_linenumber % 4 + 1] AS symbol_type, CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE (l_suppkey % (2 + l_orderkey % 3))::INT + 1 END AS complexity, l_linenumber AS start_line, (l_linenumber + l_partkey % (3 + 2 * (l_orderkey % 5)))::INT AS end_line FROM lineitem WHERE l_orderkey % 600 < 400)"


@query("g20_simplicity", f"""WITH {_SHAPES}, g AS (SELECT file, count(*) FILTER (WHERE symbol_type = 'class')::BIGINT AS classes, count(*) FILTER (WHERE symbol_type = 'function')::BIGINT AS functions, count(*) FILTER (WHERE symbol_type = 'method')::BIGINT AS methods,
  coalesce(avg(coalesce(complexity, 1)) FILTER (WHERE symbol_type = 'method'), 0)::DOUBLE AS mean, coalesce(max(coalesce(complexity, 1)) FILTER (WHERE symbol_type = 'method'), 0)::INT AS max_complexity, coalesce(avg(end_line - start_line + 1) FILTER (WHERE symbol_type = 'method'), 0)::DOUBLE AS lines FROM shapes GROUP BY file),
f AS (SELECT *, methods > 0 AND classes >= 3 AND mean <= 2 AND lines <= 5 AS flagged FROM g) SELECT file, classes, functions, methods, round(mean, 9) AS avg_complexity, max_complexity, round(lines, 9) AS avg_lines, flagged FROM f WHERE classes >= 2 OR flagged""")
def simplicity(spark, d):
    """Chunks of many small classes made from order lines."""
    li, o, n = table(spark, d, "lineitem"), F.col("l_orderkey"), F.col("l_linenumber")
    kind = F.element_at(F.array(F.lit("class"), F.lit("function"), F.lit("method"), F.lit("method")), (n % 4 + 1).cast("int"))
    cost = F.when(F.col("l_suppkey") % 9 != 0, (F.col("l_suppkey") % (2 + o % 3)).cast("int") + 1)
    chunks = li.where(o % 600 < 400).select(F.concat(F.lit("f"), o % 600).alias("file"), kind.alias("symbol_type"), cost.alias("complexity"), n.alias("start_line"), (n + F.col("l_partkey") % (3 + 2 * (o % 5))).cast("int").alias("end_line"))
    out = metrics.simplicity(chunks)
    return out.select("file", "classes", "functions", "methods", F.round("avg_complexity", 9).alias("avg_complexity"), "max_complexity", F.round("avg_lines", 9).alias("avg_lines"), "flagged")


_PAIR = """WITH li AS (SELECT l_orderkey % 500 AS file, l_suppkey % 20 AS symbol, l_orderkey, l_linenumber, l_partkey, l_linestatus, floor(l_quantity) AS q, floor(l_extendedprice) AS p FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY l_linestatus, file, symbol ORDER BY l_orderkey, l_linenumber, l_partkey, q, p) AS o FROM li),
j AS (SELECT coalesce(b.file, a.file) AS file, coalesce(b.symbol, a.symbol) AS symbol, coalesce(b.o, a.o)::INT AS ordinal, b.q AS bq, a.q AS aq, b.p AS bp, a.p AS ap FROM (SELECT * FROM n WHERE l_linestatus = 'F') b FULL JOIN (SELECT * FROM n WHERE l_linestatus = 'O') a ON a.file = b.file AND a.symbol = b.symbol AND a.o = b.o),
"""


def _verdict_sql(b, a, t):
    standing = f"CASE WHEN {a} < {b} THEN CASE WHEN {a} < {t} THEN 'improved' ELSE 'pre_existing' END WHEN {a} > {b} THEN 'pre_existing' ELSE 'unchanged' END"
    return f"CASE WHEN {a} IS NULL THEN 'removed' WHEN {b} IS NULL THEN CASE WHEN {a} >= {t} THEN 'new_over' ELSE 'new_under' END WHEN {b} < {t} AND {a} >= {t} THEN 'crossed' WHEN {b} >= {t} THEN {standing} WHEN {a} > {b} THEN 'worsened' WHEN {a} < {b} THEN 'improved' ELSE 'unchanged' END"


_ORDER = "['crossed', 'new_over', 'pre_existing', 'worsened', 'new_under', 'improved', 'unchanged', 'removed']"
_PAIRED = _PAIR + f"k AS (SELECT file, symbol, ordinal, {_verdict_sql('bq', 'aq', 30)} AS vq, {_verdict_sql('bp', 'ap', 60000)} AS vp FROM j), w AS (SELECT file, symbol, ordinal, vq, vp, CASE WHEN list_position({_ORDER}, vq) <= list_position({_ORDER}, vp) THEN vq ELSE vp END AS verdict FROM k) "


def _paired(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_orderkey") % 500).alias("file"), (F.col("l_suppkey") % 20).alias("symbol"), "l_orderkey", "l_linenumber", "l_partkey", "l_linestatus", F.floor("l_quantity").alias("q"), F.floor("l_extendedprice").alias("p"))
    order = ["l_orderkey", "l_linenumber", "l_partkey", "q", "p"]
    j = metrics.paired(li.where("l_linestatus = 'F'"), li.where("l_linestatus = 'O'"), ["file", "symbol"], order, ["q", "p"])
    j = j.withColumn("vq", metrics.verdict(F.col("before_q"), F.col("after_q"), 30)).withColumn("vp", metrics.verdict(F.col("before_p"), F.col("after_p"), 60_000))
    return j.withColumn("verdict", metrics.function_verdict([F.col("vq"), F.col("vp")]))


@query("j19_paired_functions", _PAIRED + "SELECT file, symbol, ordinal, vq, vp, verdict FROM w")
def paired_functions(spark, d):
    return _paired(spark, d).select("file", "symbol", "ordinal", "vq", "vp", "verdict")


@query("m16_regressions", _PAIRED + "SELECT file, count(*)::BIGINT AS regressions FROM w WHERE verdict IN ('crossed', 'new_over') GROUP BY file")
def regressions(spark, d):
    return _paired(spark, d).where(F.col("verdict").isin(*metrics.FAILING)).groupBy("file").agg(F.count("*").alias("regressions"))


@query("g13_delta_summary", _PAIRED + "SELECT verdict, count(*)::BIGINT AS functions FROM w WHERE verdict <> 'unchanged' GROUP BY verdict")
def delta_summary(spark, d):
    return _paired(spark, d).where("verdict <> 'unchanged'").groupBy("verdict").agg(F.count("*").alias("functions"))


@query("g14_review_summary", _PAIR + "s AS (SELECT CASE WHEN bq IS NULL THEN 'new' WHEN aq IS NULL THEN 'deleted' WHEN aq < bq THEN 'improved' WHEN aq > bq THEN 'degraded' ELSE 'unchanged' END AS kind, coalesce(aq, 0) - coalesce(bq, 0) AS delta FROM j) SELECT kind, count(*)::BIGINT AS n, sum(delta)::BIGINT AS delta FROM s GROUP BY kind")
def review_summary(spark, d):
    b, a = F.col("before_q"), F.col("after_q")
    kind = F.when(b.isNull(), "new").when(a.isNull(), "deleted").when(a < b, "improved").when(a > b, "degraded").otherwise("unchanged")
    return _paired(spark, d).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum(F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0))).alias("delta"))


@query("j21_violation_delta", _PAIR + "h AS (SELECT file, symbol, ordinal, bq, aq FROM j WHERE bq >= 30 OR aq >= 30) SELECT file, symbol, ordinal, CASE WHEN bq >= 30 AND aq >= 30 THEN 'kept' WHEN aq >= 30 THEN 'added' ELSE 'fixed' END AS state FROM h")
def violation_delta(spark, d):
    b, a = F.coalesce(F.col("before_q") >= 30, F.lit(False)), F.coalesce(F.col("after_q") >= 30, F.lit(False))
    return _paired(spark, d).where(a | b).select("file", "symbol", "ordinal", F.when(a & b, "kept").when(a, "added").otherwise("fixed").alias("state"))


@query("h_halstead", """WITH x AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, (l_partkey % 30 + 1)::DOUBLE AS n1, (l_suppkey % 40 + 1)::DOUBLE AS n2, floor(l_quantity)::DOUBLE + 30 AS b1, floor(l_quantity)::DOUBLE + 40 AS b2 FROM lineitem),
v AS (SELECT *, (b1 + b2) * log2(n1 + n2) AS vol, n1 / 2 * (b2 / n2) AS dif FROM x)
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, floor(vol * 100 + 0.5) / 100 AS volume, floor(dif * 100 + 0.5) / 100 AS difficulty FROM v""")
def halstead(spark, d):
    q = F.floor("l_quantity").cast("double")
    v = C.halstead((F.col("l_partkey") % 30 + 1).cast("double"), (F.col("l_suppkey") % 40 + 1).cast("double"), q + 30, q + 40)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", *v[:2])


@query("a18_report_json", _R + f"SELECT '{{\"file\":\"' || file || '\",\"errors\":' || errors || ',\"violations\":' || violations || ',\"risk\":\"' || {_RISK} || '\"}}' AS report FROM r")
def report_json(spark, d):
    return metrics.file_risk(_violations(spark, d)).select(F.to_json(F.struct("file", "errors", "violations", "risk")).alias("report"))
