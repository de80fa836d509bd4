"""Queries over the impact and review pieces (synthetic bindings)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import columns as C
from codeloom.operators import review as R
from codeloom.plans.registry import query
from codeloom.sources.adapters import FUNCTIONS, LEDGER, functions, ledger, table


def _s(prefix, x):
    return F.concat(F.lit(prefix), x)


@query("f2_merged_hits", "WITH h AS (SELECT o_custkey % 50 AS query, o_orderkey AS id, 'f' || o_custkey % 9 AS file, o_totalprice AS score, o_orderkey % 4 = 0 AS own FROM orders), b AS (SELECT query, id, file, score FROM h WHERE own UNION ALL SELECT query, id, file, score FROM h WHERE NOT own AND file NOT IN ('f1', 'f2')), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id)::INT AS rank FROM b) SELECT query, id, rank FROM r WHERE rank <= 5")
def merged_hits(spark, d):
    h = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("query"), F.col("o_orderkey").alias("id"), _s("f", F.col("o_custkey") % 9).alias("file"), F.col("o_totalprice").alias("score"))
    mask = spark.createDataFrame([("f1",), ("f2",)], "file string")
    return R.merged_hits(h.where("id % 4 = 0"), h.where("id % 4 <> 0"), mask, 5).select("query", "id", "rank")


@query("f8_blast_entries", f"WITH {LEDGER} SELECT event_id, level FROM ledger WHERE level <> 'other' ORDER BY list_position(['critical', 'high', 'medium', 'low'], level), value DESC, event_id LIMIT 40")
def blast_entries(spark, d):
    rows = ledger(spark, d).where("level <> 'other'")
    return rows.orderBy(C.risk_rank(F.col("level")).desc(), F.desc("value"), "event_id").limit(40).select("event_id", "level")


@query("g6_combined_risk", f"WITH {FUNCTIONS}, c AS (SELECT file, avg(cyclomatic) AS m, max(cyclomatic) AS x, count(*) AS n FROM functions GROUP BY 1), r AS (SELECT file, CASE WHEN m > 15 OR x > 25 THEN 4 WHEN m > 10 OR x > 20 THEN 3 WHEN m > 6 OR x > 15 THEN 2 ELSE 1 END AS a, CASE WHEN n <= 5 THEN 1 WHEN n <= 15 THEN 2 WHEN n <= 30 THEN 3 ELSE 4 END AS b FROM c) SELECT file, ['low', 'medium', 'high', 'critical'][greatest(a, b)] AS risk FROM r")
def combined_risk(spark, d):
    g = functions(spark, d).groupBy("file").agg(F.avg("cyclomatic").alias("m"), F.max("cyclomatic").alias("x"), F.count("*").alias("n"))
    rank = F.greatest(C.risk_rank(C.complexity_risk(F.col("m"), F.col("x"))), C.risk_rank(C.count_risk(F.col("n"))))
    return g.select("file", C.risk_name(rank).alias("risk"))


_IMP = "i AS (SELECT DISTINCT 'f' || l_suppkey % 80 AS importer, 's' || l_partkey % 60 AS symbol FROM lineitem), x AS (SELECT DISTINCT 's' || p_partkey % 60 AS symbol, 'f' || p_size AS file FROM part), e AS (SELECT DISTINCT 'f' || l_suppkey % 80 AS importer, 'f' || l_linenumber * 5 AS file FROM lineitem)"


def _import_tables(spark, d):
    li, part = table(spark, d, "lineitem"), table(spark, d, "part")
    imports = li.select(_s("f", F.col("l_suppkey") % 80).alias("importer"), _s("s", F.col("l_partkey") % 60).alias("symbol")).distinct()
    exports = part.select(_s("s", F.col("p_partkey") % 60).alias("symbol"), _s("f", F.col("p_size")).alias("file")).distinct()
    edges = li.select(_s("f", F.col("l_suppkey") % 80).alias("importer"), _s("f", F.col("l_linenumber") * 5).alias("file")).distinct()
    return imports, exports, edges


@query("j5_verified_exports", f"WITH {_IMP}, j AS (SELECT i.importer, i.symbol, x.file, e.file IS NOT NULL AS verified FROM i JOIN x USING (symbol) LEFT JOIN e ON e.importer = i.importer AND e.file = x.file WHERE i.importer <> x.file) SELECT importer, symbol, file, verified FROM (SELECT *, bool_or(verified) OVER (PARTITION BY importer, symbol) AS best FROM j) WHERE verified = best")
def verified_exports(spark, d):
    return R.export_tiers(*_import_tables(spark, d)).select("importer", "symbol", "file", "verified")


@query("j8_fallback_importers", f"WITH {_IMP} SELECT importer, file FROM e WHERE importer <> file AND NOT EXISTS (SELECT 1 FROM i JOIN x USING (symbol) WHERE i.importer = e.importer AND x.file = e.file)")
def fallback_importers(spark, d):
    """File-level imports that no imported symbol explains."""
    imports, exports, edges = _import_tables(spark, d)
    return edges.where("importer <> file").join(imports.join(exports, "symbol").select("importer", "file"), ["importer", "file"], "left_anti")


@query("j15_namespace_references", """WITH dcl AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'a.b' ELSE 'a.b.c' END AS namespace, 'T' || p_size AS name, 'd' || p_partkey % 3 || '_' || p_size AS file FROM part WHERE p_partkey % 4 < 3),
men AS (SELECT DISTINCT 'm' || l_suppkey % 30 AS importer, 'T' || l_linenumber * 6 AS name, CASE l_suppkey % 2 WHEN 0 THEN 'a.b.c' ELSE 'a.b' END AS namespace FROM lineitem),
ch AS (SELECT importer, name, unnest(CASE namespace WHEN 'a.b.c' THEN [{'n': 'a.b.c', 'd': 0}, {'n': 'a.b', 'd': 1}, {'n': 'a', 'd': 2}] ELSE [{'n': 'a.b', 'd': 0}, {'n': 'a', 'd': 1}] END) AS e FROM men),
h AS (SELECT importer, ch.name, file, e.d AS depth FROM ch JOIN dcl ON dcl.namespace = e.n AND dcl.name = ch.name) SELECT DISTINCT importer, name, file FROM (SELECT *, min(depth) OVER (PARTITION BY importer, name) AS nearest FROM h) WHERE depth = nearest""")
def namespace_references(spark, d):
    k = F.col("p_partkey")
    dcl = table(spark, d, "part").where(k % 4 < 3).select(F.when(k % 3 == 0, "a").when(k % 3 == 1, "a.b").otherwise("a.b.c").alias("namespace"), _s("T", F.col("p_size")).alias("name"), F.concat(F.lit("d"), k % 3, F.lit("_"), "p_size").alias("file")).distinct()
    men = table(spark, d, "lineitem").select(_s("m", F.col("l_suppkey") % 30).alias("importer"), _s("T", F.col("l_linenumber") * 6).alias("name"), F.when(F.col("l_suppkey") % 2 == 0, "a.b.c").otherwise("a.b").alias("namespace")).distinct()
    return R.namespace_references(men, dcl)


@query("j16_package_references", """WITH dcl AS (SELECT DISTINCT 'p' || p_size % 10 AS package, 'T' || p_partkey % 900 AS name, 'f' || p_partkey % 300 AS file FROM part), men AS (SELECT DISTINCT 'f' || l_suppkey % 300 AS importer, 'p' || l_linenumber AS package, 'T' || l_partkey % 900 AS name FROM lineitem),
bnd AS (SELECT DISTINCT 'f' || s_suppkey % 300 AS importer, 'T' || s_suppkey AS name FROM supplier), one AS (SELECT package, name, min(file) AS file FROM dcl GROUP BY 1, 2 HAVING count(DISTINCT file) = 1)
SELECT DISTINCT importer, one.file FROM men JOIN one USING (package, name) WHERE importer <> one.file AND NOT EXISTS (SELECT 1 FROM dcl WHERE dcl.file = importer AND dcl.name = men.name) AND NOT EXISTS (SELECT 1 FROM bnd WHERE bnd.importer = men.importer AND bnd.name = men.name)""")
def package_references(spark, d):
    p, li, s = table(spark, d, "part"), table(spark, d, "lineitem"), table(spark, d, "supplier")
    dcl = p.select(_s("p", F.col("p_size") % 10).alias("package"), _s("T", F.col("p_partkey") % 900).alias("name"), _s("f", F.col("p_partkey") % 300).alias("file")).distinct()
    men = li.select(_s("f", F.col("l_suppkey") % 300).alias("importer"), _s("p", F.col("l_linenumber")).alias("package"), _s("T", F.col("l_partkey") % 900).alias("name")).distinct()
    return R.package_references(men, dcl, s.select(_s("f", F.col("s_suppkey") % 300).alias("importer"), _s("T", F.col("s_suppkey")).alias("name")).distinct())


@query("j27_symbol_usages", f"WITH {_IMP}, c AS (SELECT DISTINCT 'f' || l_suppkey % 80 AS importer, 's' || l_partkey % 60 AS symbol, l_linenumber AS line FROM lineitem) SELECT DISTINCT importer, symbol, line FROM i JOIN c USING (importer, symbol) WHERE importer IN (SELECT importer FROM e WHERE file = 'f5')")
def symbol_usages(spark, d):
    imports, _, edges = _import_tables(spark, d)
    calls = table(spark, d, "lineitem").select(_s("f", F.col("l_suppkey") % 80).alias("importer"), _s("s", F.col("l_partkey") % 60).alias("symbol"), F.col("l_linenumber").alias("line"))
    return R.symbol_usages(edges, imports, calls, "f5")


_SAID = "'d' || doc_id AS file, text || chr(10) || 'see load_' || doc_id % 30 || ', or get' || doc_id % 30 || ' it' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '`put' || doc_id % 30 || '`' ELSE 'x/put' || doc_id % 30 || ' load_' || (doc_id + 1) % 30 || '-more' END AS content"


@query("j28_doc_references", f"""WITH s AS (SELECT DISTINCT unnest(['load_' || p_size, 'get' || p_size, 'put' || p_size]) AS symbol FROM part WHERE p_size < 20), t AS (SELECT doc_id, {_SAID} FROM documents)
SELECT DISTINCT symbol, file FROM s, t WHERE NOT starts_with(symbol, 'get') AND regexp_matches(content, '(^|[^A-Za-z0-9_.\\-])' || symbol || '([^A-Za-z0-9_.\\-]|$)')""")
def doc_references(spark, d):
    """Names that read as code, plain words that prose uses, and plain words that stand in backticks or behind slashes alone."""
    k = F.col("doc_id") % 30
    third = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("`put"), k, F.lit("`"))).otherwise(F.concat(F.lit("x/put"), k, F.lit(" load_"), (F.col("doc_id") + 1) % 30, F.lit("-more")))
    said = F.concat("text", F.lit("\nsee load_"), k, F.lit(", or get"), k, F.lit(" it\n"), third)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), _s("d", F.col("doc_id")).alias("file"), F.lit(1).alias("start_line"), said.alias("content"))
    names = table(spark, d, "part").where("p_size < 20").select(F.explode(F.array(*(_s(p, F.col("p_size")) for p in ("load_", "get", "put")))).alias("symbol"))
    return R.doc_references(docs, names.distinct())


@query("t7_reexported_symbols", "WITH b AS (SELECT o_custkey, list(DISTINCT 's' || o_orderkey % 6) AS im, list(DISTINCT 's' || o_orderkey % 4) AS ex FROM orders GROUP BY 1) SELECT 'f' || o_custkey AS file, array_to_string(list_sort(CASE WHEN o_custkey % 5 = 0 THEN ex ELSE list_intersect(im, ex) END), ',') AS symbols FROM b")
def reexported_symbols(spark, d):
    k = F.col("o_orderkey")
    b = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set(_s("s", k % 6)).alias("im"), F.collect_set(_s("s", k % 4)).alias("exported"))
    star = F.when(F.col("o_custkey") % 5 == 0, F.array(F.lit("*"))).otherwise(F.array().cast("array<string>"))
    return R.reexported(b.select(_s("f", F.col("o_custkey")).alias("file"), F.concat("im", star).alias("imported"), "exported")).select("file", F.array_join("symbols", ",").alias("symbols"))


@query("x10_attribution_caveats", "SELECT p_partkey, CASE WHEN p_size % 11 = 0 THEN 'unresolved' WHEN p_size % 7 = 0 THEN 'degraded' WHEN p_size % 5 = 0 THEN 'type_incomplete' WHEN p_size % 3 = 0 THEN 'partial' WHEN p_size % 2 = 0 THEN 'incomplete' END AS reason FROM part")
def attribution_caveats(spark, d):
    m = lambda n: F.col("p_size") % n == 0
    return table(spark, d, "part").select("p_partkey", R.attribution_caveat(m(11), m(7), m(5), m(3), m(2)).alias("reason"))


@query("n7_comparison_changes", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'operator' WHEN 1 THEN 'negation' WHEN 2 THEN 'literal' END AS kind FROM part WHERE p_partkey % 4 < 3")
def comparison_changes(spark, d):
    k = F.col("p_partkey")
    line = lambda op, neg, n: F.concat(F.lit(f"if {neg}size of this part value {op} "), n.cast("string"))
    before = table(spark, d, "part").select(k.alias("id"), line("<", "", k).alias("text"))
    after = table(spark, d, "part").select(k.alias("id"), F.when(k % 4 == 0, line("<=", "", k)).when(k % 4 == 1, line("<", "not ", k)).when(k % 4 == 2, line("<", "", k + 1)).otherwise(line("<", "", k)).alias("text"))
    return R.comparison_changes(before, after)


@query("n13_coverage_gaps", f"WITH {FUNCTIONS}, f AS (SELECT DISTINCT file FROM functions), t AS (SELECT DISTINCT 'pkg' || (l_orderkey % 40) || '/f' || (l_orderkey % 400) || '.py' AS file FROM lineitem WHERE l_orderkey % 400 < 300) SELECT file FROM f WHERE file NOT IN (SELECT file FROM t) ORDER BY file LIMIT 10")
def coverage_gaps(spark, d):
    f = functions(spark, d)
    tested = f.where("orderkey % 400 < 300").select("file").distinct()
    return f.select("file").distinct().join(tested, "file", "left_anti").orderBy("file").limit(10)
