"""Complexity analytics: violations, file and report risk, before/after deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import columns as C

#: Default thresholds of the four metrics; effort in units, an hour's worth being 60 * 1080.
THRESHOLDS = {"cyclomatic": 15.0, "cognitive": 15.0, "effort": 60 * 1080.0, "bugs": 1.5}
#: Verdicts of a metric from the most severe down; those that fail a gate.
VERDICTS = ("crossed", "new_over", "pre_existing", "worsened", "new_under", "improved", "unchanged", "removed")
FAILING = ("crossed", "new_over")


def violations(functions: DataFrame, thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """One row per metric of a function at or above its threshold: warning from t, error from 2t."""
    metrics = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(t).alias("threshold")) for m, t in thresholds.items()))
    rows = functions.withColumn("m", F.explode(metrics)).where("m.value >= m.threshold")
    return rows.withColumn("metric", F.col("m.metric")).withColumn("value", F.col("m.value")).withColumn("severity", F.when(F.col("m.value") >= 2 * F.col("m.threshold"), "error").otherwise("warning")).drop("m")


def file_risk(v: DataFrame) -> DataFrame:
    """Three errors critical, one high, three violations medium, else low."""
    g = v.groupBy("file").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count("*").alias("violations"))
    return g.withColumn("risk", F.when(F.col("errors") >= 3, "critical").when(F.col("errors") > 0, "high").when(F.col("violations") >= 3, "medium").otherwise("low"))


def file_complexity(functions: DataFrame, metric: str = "cyclomatic") -> DataFrame:
    g = functions.where(F.col(metric) > 0).groupBy("file")
    return g.agg(C.half_up(F.avg(metric), 1).alias("avg"), F.max(metric).alias("max"), F.sum(metric).cast("long").alias("sum"), F.count("*").alias("n"))


def overall(files: DataFrame, over: int = 10, top: int = 5) -> DataFrame:
    """Mean of the files' rounded means, the largest maximum, and the files above `over`, worst first."""
    worst = files.where(F.col("max") > over).orderBy(F.desc("max"), "file").limit(top).agg(F.array_sort(F.collect_list(F.struct((-F.col("max")).alias("m"), "file"))).alias("w"))
    one = files.agg(C.half_up(F.avg("avg"), 1).alias("avg"), F.max("max").alias("max"), F.lit(1).alias("k"))
    return one.join(worst.withColumn("k", F.lit(1)), "k").select("avg", "max", F.array_join(F.transform("w", lambda x: x["file"]), ",").alias("worst"), C.complexity_risk(F.col("avg"), F.col("max")).alias("risk"))


def headroom(functions: DataFrame, share: float = 0.8, limit: float = 15.0, top: int = 5) -> DataFrame:
    """Of each file the functions nearest below a limit: best ratio of two metrics, the first `top`, and how many more."""
    ratio = F.greatest("cyclomatic", "cognitive") / F.lit(limit)
    near = functions.withColumn("ratio", ratio).where((F.col("ratio") >= share) & (F.col("ratio") < 1))
    w = Window.partitionBy("file")
    ranked = near.withColumn("rank", F.row_number().over(w.orderBy(F.desc("ratio"), "symbol"))).withColumn("overflow", F.greatest(F.lit(0), F.count("*").over(w).cast("int") - top))
    return ranked.where(F.col("rank") <= top)


def paired(before: DataFrame, after: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Full outer join of the n-th row of a key before with the n-th after; columns before_x and after_x."""
    w = Window.partitionBy(*keys).orderBy(*order)
    sides = []
    for name, df in (("before", before), ("after", after)):
        numbered = df.withColumn("ordinal", F.row_number().over(w))
        sides.append(numbered.select(*keys, "ordinal", *(F.col(v).alias(f"{name}_{v}") for v in values)))
    return sides[0].join(sides[1], [*keys, "ordinal"], "full_outer")


def verdict(before: Column, after: Column, threshold: float) -> Column:
    """What an edit did to one metric; null means that the function is not there. Above the threshold before, only a drop
    below it improves anything: another change leaves what was there."""
    was, now = before >= threshold, after >= threshold
    change = F.when(after > before, "worsened").when(after < before, "improved").otherwise("unchanged")
    return (
        F.when(after.isNull(), "removed")
        .when(before.isNull(), F.when(now, "new_over").otherwise("new_under"))
        .when(was & now, F.when(after == before, "unchanged").otherwise("pre_existing"))
        .when(now, "crossed").otherwise(change)
    )


def severity(v: Column) -> Column:
    return F.lit(len(VERDICTS)) - F.array_position(F.array(*(F.lit(x) for x in VERDICTS)), v).cast("int")


def function_verdict(verdicts: list[Column]) -> Column:
    """The most severe of a function's metric verdicts; null ones, of metrics without a value on either side, don't count."""
    ranked = F.array_sort(F.filter(F.array(*(F.struct((-severity(v)).alias("s"), v.alias("v")) for v in verdicts)), lambda x: x["v"].isNotNull()))
    return F.get(ranked, F.lit(0))["v"]


def simplicity(chunks: DataFrame, files: DataFrame | None = None, least_classes: int = 2, many_classes: int = 3, trivial: float = 2.0, short: float = 5.0) -> DataFrame:
    """file, classes, functions, methods, avg_complexity, max_complexity, avg_lines, flagged, reason from chunks (file,
    symbol_type, complexity, start_line, end_line), for files with two classes or more: many classes whose methods are all
    but trivial look like too much abstraction. A method without a complexity counts as 1."""
    own = chunks if files is None else chunks.join(files.select("file").distinct(), "file", "left_semi")
    is_ = lambda kind: F.col("symbol_type") == kind
    cost, lines = F.when(is_("method"), F.coalesce("complexity", F.lit(1))), F.when(is_("method"), F.col("end_line") - F.col("start_line") + 1)
    g = own.groupBy("file").agg(
        F.count_if(is_("class")).alias("classes"), F.count_if(is_("function")).alias("functions"), F.count_if(is_("method")).alias("methods"),
        F.coalesce(F.avg(cost), F.lit(0.0)).alias("avg_complexity"), F.coalesce(F.max(cost), F.lit(0)).alias("max_complexity"), F.coalesce(F.avg(lines), F.lit(0.0)).alias("avg_lines"),
    )
    flagged = (F.col("methods") > 0) & (F.col("classes") >= many_classes) & (F.col("avg_complexity") <= trivial) & (F.col("avg_lines") <= short)
    said = F.concat("classes", F.lit(" classes, average method complexity "), F.format_number("avg_complexity", 1), F.lit(" and "), C.half_up(F.col("avg_lines")).cast("long"), F.lit(" lines: too much abstraction?"))
    return g.withColumn("flagged", flagged).withColumn("reason", F.when(F.col("flagged"), said).otherwise("")).where((F.col("classes") >= least_classes) | F.col("flagged"))


def _dominant(counts: dict[str, Column]) -> Column:
    total = sum(counts.values(), F.lit(0))
    out = F.when(total == 0, "mixed")
    for style in ("camelCase", "snake_case", "PascalCase"):
        out = out.when(counts[style] / total > 0.5, style)
    return out.otherwise("mixed")


def fingerprint(chunks: DataFrame) -> DataFrame:
    """One row about a code base, from chunks (file, symbol_type, symbol_name, language, imports, exports, imported_symbols, signature,
    content): functions, methods, classes, ratio and style; naming of functions and of classes; barrel files (that export
    something, by name or because they pass on what they import); mean depth of relative imports and structure; how functions
    are asynchronous; chunks. Without chunks the counts are 0, the ratio one half, naming mixed, the rest flat and sync."""
    kind, style = F.col("symbol_type"), C.identifier_style(F.coalesce("symbol_name", F.lit("")))
    is_class, is_code = kind.isin("class", "interface"), kind.isin("function", "method")
    n = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    aggs = [n(kind == "function").alias("functions"), n(kind == "method").alias("methods"), n(is_class).alias("classes"), F.count("*").alias("chunks")]
    for name, _ in C.STYLES:
        aggs += [n(is_code & (style == name)).alias(f"code_{name}"), n(is_class & (style == name)).alias(f"class_{name}")]
    sig = F.coalesce("signature", F.lit(""))
    promise = sig.rlike("Promise<") | F.coalesce("content", F.lit("")).rlike(r"\.then\(")
    callback = sig.rlike(r"callback|cb\b|done\b|next\b") & sig.contains("function")
    how = F.when(~is_code, None).when(sig.contains("async "), "async").when(promise, "promise").when(callback, "callback")
    aggs += [n(how == x).alias(x) for x in ("async", "promise", "callback")]
    relative = F.filter(F.coalesce("imports", F.array().cast("array<string>")), lambda i: i.startswith("."))
    aggs += [F.sum(F.size(relative)).alias("n_relative"), F.sum(F.aggregate(relative, F.lit(0), lambda a, i: a + F.size(F.split(i, "/")) - 1)).alias("depth")]
    own = F.flatten(F.map_values(F.coalesce("imported_symbols", F.create_map().cast("map<string,array<string>>"))))
    symbols = chunks.select("file", F.explode(F.array_distinct(F.concat(F.transform(F.coalesce("exports", F.array().cast("array<string>")), lambda e: F.struct(e.alias("s"), F.lit(True).alias("out"))), F.transform(own, lambda i: F.struct(i.alias("s"), F.lit(False).alias("out")))))).alias("x"))
    per = symbols.groupBy("file", "x.s").agg(F.bool_or("x.out").alias("out"), F.bool_or(~F.col("x.out")).alias("in"))
    files = per.groupBy("file").agg(F.bool_or("out").alias("exports"), F.bool_or(F.col("out") & F.col("in")).alias("passes"))
    barrels = files.where(F.col("exports") & (F.col("passes") | F.regexp_extract("file", r"([^/]*)\z", 1).rlike(r"^(index|__init__|mod)\."))).agg(F.count("*").alias("barrels"))
    one = chunks.agg(*aggs).crossJoin(barrels)  # one row each
    total = F.col("functions") + F.col("methods") + F.col("classes")
    ratio = F.when(total == 0, 0.5).otherwise(F.col("functions") / total)
    depth = F.coalesce(F.try_divide(F.col("depth"), F.col("n_relative")), F.lit(0.0))
    waits = F.col("async") + F.col("promise") + F.col("callback")
    pattern = F.when(waits == 0, "sync").when(F.col("async") > 0.6 * waits, "async/await").when(F.col("promise") > 0.6 * waits, "promises").when(F.col("callback") > 0.6 * waits, "callbacks").otherwise("mixed")
    return one.select(
        "functions", "methods", "classes", ratio.alias("ratio"), F.when(ratio >= 0.7, "functional").when(ratio <= 0.3, "oop").otherwise("mixed").alias("style"),
        _dominant({x: F.col(f"code_{x}") for x, _ in C.STYLES}).alias("function_names"), _dominant({x: F.col(f"class_{x}") for x, _ in C.STYLES}).alias("class_names"),
        "barrels", depth.alias("import_depth"), F.when(depth < 2, "flat").when(depth > 3, "nested").otherwise("moderate").alias("structure"), pattern.alias("async_pattern"), "chunks",
    )


def language_shares(chunks: DataFrame) -> DataFrame:
    """language, percent: whole percents of the chunks, at least 1."""
    g = chunks.groupBy("language").agg(F.count("*").alias("n"))
    total = chunks.agg(F.count("*").alias("total"))
    return g.crossJoin(total).select("language", F.greatest(F.lit(1), C.half_up(F.col("n") / F.col("total") * 100).cast("int")).alias("percent"))  # one row on the right
