"""Reports: complexity as JSON, SARIF and text, responses within a budget, the recap of a session, exit codes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import columns as C
from codeloom.operators import metrics

#: Rule names and labels of the metrics; the schema and version of the format.
RULES = {"cyclomatic": "high-cyclomatic-complexity", "cognitive": "high-cognitive-complexity", "effort": "high-halstead-effort", "bugs": "high-estimated-bugs"}
LABELS = {"cyclomatic": "Test paths", "cognitive": "Mental load", "effort": "Time to understand", "bugs": "Estimated bugs"}
TEXTS = {"cyclomatic": "Too many test paths", "cognitive": "High mental load", "effort": "Long time to understand", "bugs": "High estimated bug count"}
SARIF_SCHEMA, SARIF_VERSION = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json", "2.1.0"
SEVERITY_ORDER = ("error", "warning", "new", "improved", "deleted")


def _of_metric(table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.col("metric"))


def sarif_results(violations: DataFrame, tool: str = "codeloom") -> DataFrame:
    """One SARIF result, as JSON, for each violation (file, symbol, start_line, end_line, metric, value, threshold, severity),
    and where it stands in the run."""
    region = F.struct(F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine"))
    location = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    said = F.concat(F.col("symbol"), F.lit(": "), _of_metric(TEXTS))
    result = F.struct(F.concat(F.lit(f"{tool}/"), _of_metric(RULES)).alias("ruleId"), F.col("severity").alias("level"), F.struct(said.alias("text")).alias("message"), F.array(location).alias("locations"))
    return violations.select("file", "symbol", "metric", "start_line", F.to_json(result).alias("result"))


def write_sarif(violations: DataFrame, folder: str, tool: str = "codeloom") -> None:
    """results as JSON lines below folder/results, sorted by file and line, and the frame of the run (rules, schema) as
    folder/run: a report of any size, that no driver holds."""
    ordered = sarif_results(violations, tool).repartitionByRange("file").sortWithinPartitions("file", "start_line", "symbol", "metric")
    ordered.select("result").write.mode("overwrite").text(f"{folder}/results")
    rules = [{"id": f"{tool}/{RULES[m]}", "shortDescription": {"text": TEXTS[m]}} for m in RULES]
    frame = {"$schema": SARIF_SCHEMA, "version": SARIF_VERSION, "runs": [{"tool": {"driver": {"name": tool, "rules": rules}}, "results": []}]}
    violations.sparkSession.createDataFrame([(json.dumps(frame),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/run")


def sarif(violations: DataFrame, most: int = 10_000, tool: str = "codeloom") -> str:
    """The whole report as one document, for at most `most` violations; a larger one has to be written."""
    rows = sarif_results(violations, tool).orderBy("file", "start_line", "symbol", "metric").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} violations: use write_sarif")
    rules = [{"id": f"{tool}/{RULES[m]}", "shortDescription": {"text": TEXTS[m]}} for m in RULES]
    return json.dumps({"$schema": SARIF_SCHEMA, "version": SARIF_VERSION, "runs": [{"tool": {"driver": {"name": tool, "rules": rules}}, "results": [json.loads(r["result"]) for r in rows]}]}, indent=2)


def text_lines(violations: DataFrame) -> DataFrame:
    """file, severity, line of a text report: place and symbol, what was measured against which limit, how far over it is."""
    v, t = F.col("value"), F.col("threshold")
    effort = F.col("metric") == "effort"
    shown = F.when(effort, F.concat(F.lit("~"), C.minutes(v / 1080))).when(F.col("metric") == "bugs", F.format_number(v, 2)).when(F.col("metric") == "cyclomatic", F.concat(v.cast("long"), F.lit(" (needs ~"), v.cast("long"), F.lit(" tests)"))).otherwise(v.cast("long").cast("string"))
    limit = F.when(effort, C.minutes(t / 1080)).when(F.col("metric") == "bugs", F.format_number(t, 1)).otherwise(t.cast("long").cast("string"))
    over = F.when(t > 0, F.concat(C.half_up((v - t) / t * 100).cast("long"), F.lit("% over threshold"))).otherwise("N/A (invalid threshold)")
    line = F.concat(F.col("file"), F.lit(":"), F.col("start_line"), F.lit(" - "), F.col("symbol"), F.lit("() "), _of_metric(LABELS), F.lit(": "), shown, F.lit(" (threshold: "), limit, F.lit("), "), over)
    return violations.select("file", "symbol", "metric", "severity", line.alias("line"))


def report_files(violations: DataFrame, dependents: DataFrame, complexity: DataFrame, tests: DataFrame) -> DataFrame:
    """file, errors, violations, risk, dependents, dependent_avg, dependent_max, tests for files with violations: the risk of the
    violations, or that of how many and how complex the dependents are where that is higher.

    dependents (file, importer), complexity as metrics.file_complexity(), tests (file, test)."""
    own = metrics.file_risk(violations)
    mine = dependents.join(own.select("file"), "file", "left_semi").select("file", "importer").distinct()
    cost = complexity.select(F.col("file").alias("importer"), "avg", "max")
    d = mine.join(cost, "importer", "left").groupBy("file").agg(F.count("*").alias("dependents"), C.half_up(F.avg("avg"), 1).alias("dependent_avg"), F.max("max").alias("dependent_max"))
    t = tests.join(own.select("file"), "file", "left_semi").groupBy("file").agg(F.countDistinct("test").alias("tests"))
    rows = own.join(d, "file", "left").join(t, "file", "left").withColumn("dependents", F.coalesce("dependents", F.lit(0))).withColumn("tests", F.coalesce("tests", F.lit(0)))
    by_cost = F.coalesce(C.risk_rank(C.complexity_risk(F.col("dependent_avg"), F.col("dependent_max"))), F.lit(1))
    rank = F.greatest(C.risk_rank(F.col("risk")), C.risk_rank(C.count_risk(F.col("dependents"))), by_cost)
    return rows.withColumn("risk", C.risk_name(rank)).select("file", "errors", "violations", "risk", "dependents", "dependent_avg", "dependent_max", "tests")


def by_severity(deltas: DataFrame) -> DataFrame:
    """deltas (severity, delta, ...) with `place`, from 1: errors, warnings, new, improved, deleted ones, larger rises first; ties
    by file, symbol and metric."""
    rank = F.array_position(F.array(*(F.lit(x) for x in SEVERITY_ORDER)), F.col("severity"))
    return deltas.withColumn("place", F.row_number().over(Window.partitionBy("change").orderBy(rank, F.desc("delta"), "file", "symbol", "metric")))


def dependent_context(report: DataFrame, violations: DataFrame, dependents: DataFrame, calls: DataFrame, chunks: DataFrame, functions: int = 3, snippets: int = 3) -> DataFrame:
    """file, symbol, impact, caller, line, complexity, snippet: for the `functions` violations of risky files with the most
    impact, up to `snippets` calls each, of the most complex callers, one a file, two lines around.

    report (file, risk, dependents); violations (file, symbol); dependents (file, importer); calls (file, id, symbol, line);
    chunks (id, file, start_line, end_line, content, complexity)."""
    weight = F.when(F.col("risk") == "critical", 4).otherwise(3)
    risky = report.where(F.col("risk").isin("high", "critical") & (F.col("dependents") > 0)).withColumn("impact", F.col("dependents") * weight)
    top = risky.join(violations.select("file", "symbol").distinct(), "file").orderBy(F.desc("impact"), "file", "symbol").limit(functions).select("file", "symbol", "impact")
    callers = top.join(dependents, "file").join(calls.select(F.col("file").alias("importer"), "id", "symbol", "line"), ["importer", "symbol"])
    rows = callers.join(chunks.select("id", "start_line", "end_line", "content", F.coalesce("complexity", F.lit(0)).alias("complexity")), "id").where("line BETWEEN start_line AND end_line")
    one = F.row_number().over(Window.partitionBy("file", "symbol", "importer").orderBy("id", "line"))
    best = F.row_number().over(Window.partitionBy("file", "symbol").orderBy(F.desc("complexity"), "importer"))
    rows = rows.withColumn("one", one).where("one = 1").withColumn("place", best).where(F.col("place") <= snippets)
    lines, at = F.split("content", "\n"), F.col("line") - F.col("start_line")
    around = F.slice(lines, F.greatest(F.lit(1), at - 1), at + 3 - F.greatest(F.lit(1), at - 1) + 1)
    cut = F.transform(around, lambda x: F.when(F.length(x) > 120, F.concat(F.substring(x, 1, 120), F.lit("..."))).otherwise(x))
    return rows.select("file", "symbol", "impact", F.col("importer").alias("caller"), "line", "complexity", F.array_join(cut, "\n").alias("snippet"))


def within_budget(items: list[dict], most: int = 12_000) -> tuple[list[dict], int]:
    """(items, phase) of one page on the driver, within `most` characters as JSON: contents cut to ten lines (1), then items
    dropped from the end (2), then contents cut to three lines (3); 0 if nothing was needed."""
    size = lambda rows: len(json.dumps(rows, ensure_ascii=False, separators=(",", ":")))

    def cut(rows: list[dict], n: int) -> list[dict]:
        lines = lambda text: text.split("\n")
        return [r | {"content": "\n".join(lines(r["content"])[:n]) + "\n... (truncated)"} if len(lines(r["content"])) > n else r for r in rows]

    if size(items) <= most or not items:
        return items, 0
    rows = cut(items, 10)
    if size(rows) <= most:
        return rows, 1
    while len(rows) > 1 and size(rows) > most:
        rows = rows[:-1]
    return (rows, 2) if size(rows) <= most else (cut(rows, 3), 3)


def exit_code(deltas: DataFrame, soft: bool = False) -> int:
    """1 if a function crossed a threshold or came in above it (verdict), unless the run is soft."""
    return 0 if soft else int(bool(deltas.where(F.col("verdict").isin(*metrics.FAILING)).take(1)))


def recap(unverified: DataFrame, deltas: DataFrame, unacted: DataFrame, blocked: DataFrame, now: Column, quiet_minutes: int = 10) -> DataFrame:
    """session, tests, regressions, blasts, suppressed: what each session has open (edits without tests, regressions, nudges not
    acted on); sessions with nothing open don't come; suppressed where the session was stopped within the last minutes.

    unverified, unacted (session); deltas (session, verdict); blocked (session, ts)."""
    n = lambda df, name: df.groupBy("session").agg(F.count("*").alias(name))
    rows = n(unverified, "tests").join(n(deltas.where(F.col("verdict").isin(*metrics.FAILING)), "regressions"), "session", "full_outer").join(n(unacted, "blasts"), "session", "full_outer")
    last = blocked.groupBy("session").agg(F.max("ts").alias("blocked_at"))
    recent = F.coalesce(F.col("blocked_at") >= now - F.make_dt_interval(mins=F.lit(quiet_minutes)), F.lit(False))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return rows.join(last, "session", "left").select("session", zero("tests"), zero("regressions"), zero("blasts"), recent.alias("suppressed"))
