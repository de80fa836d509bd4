"""More relational pieces of impact analysis and review: tiers, recovery joins, usages, drift, ordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.signals import distinctive_in, prose_pattern
from codeloom.tables import Scratch


def rescued(tracked: DataFrame, listed: DataFrame, include: str, never: str) -> DataFrame:
    """Tracked files that ignore rules hid: not listed, of an included kind, and not among those never indexed."""
    return tracked.join(listed, "file", "left_anti").where(F.col("file").rlike(include) & ~F.col("file").rlike(never))


def merged_hits(own: DataFrame, base: DataFrame, mask: DataFrame, limit: int) -> DataFrame:
    """Two ranked lists (query, id, file, score) as one: the base's masked files go, the best of both stay."""
    both = own.unionByName(base.join(mask, "file", "left_anti"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def export_tiers(imports: DataFrame, exports: DataFrame, edges: DataFrame) -> DataFrame:
    """importer, symbol, file, verified: an imported symbol resolved to a file that exports it, through an import edge where
    there is one, by name alone only where no edge verifies it."""
    pairs = imports.join(exports, "symbol").where("importer <> file")
    known = edges.withColumn("ok", F.lit(True))
    j = pairs.join(known, ["importer", "file"], "left").withColumn("verified", F.coalesce("ok", F.lit(False))).drop("ok")
    any_ok = F.max("verified").over(Window.partitionBy("importer", "symbol"))
    return j.withColumn("best", any_ok).where(F.col("verified") == F.col("best")).drop("best")


def enclosing(namespace: Column) -> Column:
    """a.b.c -> [(a.b.c, 0), (a.b, 1), (a, 2)]."""
    parts = F.split(namespace, r"\.")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), ".").alias("ns"), (F.size(parts) - n).alias("depth")))


def namespace_references(mentions: DataFrame, declarations: DataFrame) -> DataFrame:
    """importer, name, file: the declaration in the nearest enclosing namespace; nearer ones shadow."""
    m = mentions.withColumn("e", F.explode(enclosing(F.col("namespace")))).select("importer", "name", F.col("e.ns").alias("namespace"), F.col("e.depth").alias("depth"))
    hit = m.join(declarations, ["namespace", "name"]).where("importer <> file")
    nearest = F.min("depth").over(Window.partitionBy("importer", "name"))
    return hit.withColumn("nearest", nearest).where("depth = nearest").select("importer", "name", "file").distinct()


def package_references(mentions: DataFrame, declarations: DataFrame, bindings: DataFrame) -> DataFrame:
    """importer, file: a type name unique within its package, mentioned in the same package, neither declared there nor bound
    by an import of the same simple name."""
    one = declarations.groupBy("package", "name").agg(F.min("file").alias("file"), F.countDistinct("file").alias("n")).where("n = 1").drop("n")
    hit = mentions.join(one, ["package", "name"]).where("importer <> file")
    hit = hit.join(declarations.select(F.col("file").alias("importer"), "name"), ["importer", "name"], "left_anti")
    return hit.join(bindings, ["importer", "name"], "left_anti").select("importer", "file").distinct()


def symbol_usages(edges: DataFrame, imported: DataFrame, calls: DataFrame, file: str) -> DataFrame:
    """importer, symbol, line: call sites of what a file's importers take from it."""
    mine = edges.where(F.col("file") == file).select("importer")
    return imported.join(mine, "importer", "left_semi").join(calls, ["importer", "symbol"]).select("importer", "symbol", "line").distinct()


def doc_references(docs: DataFrame, symbols: DataFrame) -> DataFrame:
    """symbol, file for documentation (id, file, start_line, content) that names a symbol with nothing that continues it beside it,
    where the symbol is distinctive: an equi-join on the words of lines, then the exact test."""
    wanted = distinctive_in(symbols.select(F.col("symbol").alias("token")), docs).select(F.col("token").alias("symbol"))
    wanted = Scratch(docs.sparkSession, "wanted").sized(wanted.withColumn("pattern", prose_pattern(F.col("symbol"))), "wanted")  # where it is small, lines stay where they are
    lines = docs.select("file", F.explode(F.split("content", "\n")).alias("text"))
    words = lines.select("file", "text", F.explode(F.array_distinct(F.split("text", r"[^A-Za-z0-9_]+"))).alias("symbol"))
    return words.join(wanted, "symbol").where(F.regexp_like("text", F.col("pattern"))).select("symbol", "file").distinct()


def reexported(barrels: DataFrame) -> DataFrame:
    """file, symbols from imported and exported arrays: their intersection, or every export where `*` is imported."""
    star = F.array_contains("imported", "*")
    return barrels.select("file", F.array_sort(F.when(star, F.col("exported")).otherwise(F.array_intersect("imported", "exported"))).alias("symbols"))


def attribution_caveat(unresolved: Column, degraded: Column, type_incomplete: Column, partial: Column, incomplete: Column) -> Column:
    """The first reason that holds, in this order; null if attribution is sound."""
    return F.when(unresolved, "unresolved").when(degraded, "degraded").when(type_incomplete, "type_incomplete").when(partial, "partial").when(incomplete, "incomplete")


def comparison_changes(removed: DataFrame, added: DataFrame, least: float = 0.7) -> DataFrame:
    """id, kind for -/+ line pairs (id, text) whose tokens overlap: operator, negation or literal changed."""
    tokens = lambda c: F.array_distinct(F.filter(F.split(c, r"[^A-Za-z_]+"), lambda t: t != ""))
    j = removed.select("id", F.col("text").alias("b")).join(added.select("id", F.col("text").alias("a")), "id")
    x, y = tokens(F.col("b")), tokens(F.col("a"))
    overlap = F.size(F.array_intersect(x, y)) / F.greatest(F.lit(1), F.size(F.array_union(x, y)))
    ops = lambda c: F.array_join(F.regexp_extract_all(c, F.lit(r"(<=|>=|==|!=|<|>)"), F.lit(1)), " ")
    numbers = lambda c: F.array_join(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)), " ")
    kind = F.when(ops(F.col("b")) != ops(F.col("a")), "operator").when(F.col("b").contains("not ") != F.col("a").contains("not "), "negation").when(numbers(F.col("b")) != numbers(F.col("a")), "literal")
    return j.where(overlap >= least).select("id", kind.alias("kind")).where("kind IS NOT NULL")
