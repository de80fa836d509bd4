"""The tools of the engine's front over the driver's tables (synthetic bindings)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.engine import Engine
from codeloom.operators import store
from codeloom.plans.imports import _BFS, _EDGES
from codeloom.plans.registry import query
from codeloom.plans.search import _COUNTS, _FIELDS, _IS_TEST, _WEIGHTED, _counts
from codeloom.sources.adapters import CHUNKS, FUNCTIONS, chunks, functions, imports, table

#: The question of the search tool: how passage 3 begins.
_QUESTION = "array_to_string(string_split(text, ' ')[1:6], ' ')"
_ASKED_ONE = f"asked AS (SELECT 0 AS query, {_QUESTION} AS text FROM benchmark WHERE item_id = 3), live AS (SELECT * FROM src), "
_BAND = "CASE WHEN symbol_name <> '' AND list_contains(string_split_regex(lower(trim(asked.text)), '\\s+'), lower(symbol_name)) THEN 'highly_relevant' WHEN ratio >= 0.75 THEN 'highly_relevant' WHEN ratio >= 0.5 THEN 'relevant' WHEN ratio >= 0.3 THEN 'loosely_related' ELSE 'not_relevant' END"


def _top(limit, extra=""):
    return _WEIGHTED + f"""{limit + 20}), {_COUNTS}, f AS (SELECT t.id, t.ratio, c.file, c.symbol_name, c.content, coalesce(n.dependents, 0) AS dependents FROM top t JOIN src c USING (id) LEFT JOIN n ON n.file = c.file),
k AS (SELECT *, round(ratio * least(2.0, 1 + 0.15 * ln(1 + dependents)) * CASE WHEN {_IS_TEST} THEN 0.8 ELSE 1.0 END, 6) AS key FROM f), r AS (SELECT *, row_number() OVER (ORDER BY key DESC, id)::INT AS rank FROM k),
h AS (SELECT r.*, {_BAND} AS relevance, floor((1 - ratio) * 2 * 10000 + 0.5) / 10000 AS score FROM r, asked WHERE rank <= {limit}) """


def _question(spark, d) -> str:
    return " ".join(table(spark, d, "benchmark").where("item_id = 3").first()["text"].split(" ")[:6])


def _engine(spark, d):
    return Engine(chunks(spark, d), counts=_counts(spark, d))


@query("o1_search", _FIELDS + _ASKED_ONE + _top(5) + "SELECT id, relevance, score, rank FROM h WHERE (SELECT count(*) FROM h WHERE relevance <> 'not_relevant') > 0")
def search_tool(spark, d):
    return _engine(spark, d).search(_question(spark, d), 5).select("id", "relevance", "score", "rank")


@query("o2_find_similar", _FIELDS + "asked AS (SELECT 0 AS query, substr(text, 1, 200) AS text FROM documents WHERE doc_id = 11), live AS (SELECT * FROM src), " + _top(14) + "SELECT id, relevance, rank FROM h WHERE relevance <> 'not_relevant' ORDER BY rank LIMIT 3")
def find_similar_tool(spark, d):
    """Chunks like the beginning of a document: fourteen fetched, irrelevant ones dropped, three kept."""
    code = table(spark, d, "documents").where("doc_id = 11").first()["text"][:200]
    return _engine(spark, d).find_similar(code, 3).select("id", "relevance", "rank")


@query("o3_files_context", f"WITH {CHUNKS}, {_COUNTS} SELECT c.id, c.file, coalesce(n.dependents, 0)::BIGINT AS dependents FROM chunks c LEFT JOIN n ON n.file = c.file WHERE c.file IN (SELECT DISTINCT file FROM chunks ORDER BY file LIMIT 50)")
def files_context_tool(spark, d):
    files = [r[0] for r in chunks(spark, d).select("file").distinct().orderBy("file").limit(50).collect()]
    return _engine(spark, d).files_context(files).select("id", "file", "dependents")


@query("o4_list_symbols", f"WITH {CHUNKS}, s AS (SELECT file, start_line, end_line, min(id) AS id FROM chunks WHERE symbol_name <> '' AND regexp_matches(symbol_name, '(?i)^[a-m]') AND symbol_type IN ('function', 'method') GROUP BY 1, 2, 3), n AS (SELECT count(*) AS n FROM s) SELECT id, file, (SELECT n FROM n) > 30 AS has_more, CASE WHEN (SELECT n FROM n) > 30 THEN 30 END::INT AS next_offset FROM s ORDER BY file, start_line, id LIMIT 20 OFFSET 10")
def list_symbols_tool(spark, d):
    return _engine(spark, d).list_symbols("^[a-m]", kind="function", limit=20, offset=10).select("id", "file", "has_more", "next_offset")


@query("o5_dependents", _EDGES + _BFS + ", one AS (SELECT min(file) AS file FROM edges) SELECT node AS file, hops, n > 500 AS truncated, false AS is_test FROM (SELECT *, row_number() OVER (ORDER BY hops, node) AS rank, count(*) OVER () AS n FROM r WHERE seed = (SELECT file FROM one)) WHERE rank <= 500 OR hops = 1")
def dependents_tool(spark, d):
    """Two hops from the first file that has any dependents, nearest first, five hundred beyond the first hop at most."""
    files, spec = imports(spark, d)
    e = Engine(files, spec)
    return e.dependents(e._edges().agg(F.min("file")).first()[0], 2)


@query("o6_complexity", f"WITH {FUNCTIONS}, u AS (SELECT file, symbol, start_line, unnest([{{'m': 'cyclomatic', 'v': cyclomatic::DOUBLE, 't': 20.0::DOUBLE}}, {{'m': 'effort', 'v': effort, 't': 60000.0::DOUBLE}}]) AS x FROM functions WHERE file = 'pkg0/f0.py' OR ends_with(file, '/f7.py')) SELECT file, symbol, x.m AS metric, x.v AS value FROM u WHERE x.v >= x.t ORDER BY x.v DESC, file, start_line, x.m LIMIT 15")
def complexity_tool(spark, d):
    rows = Engine(functions(spark, d)).complexity(15, {"cyclomatic": 20.0, "effort": 60_000.0}, ["pkg0/f0.py", "f7.py"])
    return rows.select("file", "symbol", "metric", "value")


@query("o8_annotate", _EDGES + ", one AS (SELECT min(file) AS file FROM edges), n AS (SELECT count(DISTINCT importer)::BIGINT AS n FROM edges WHERE file = (SELECT file FROM one)) SELECT (SELECT file FROM one) AS file, n AS dependents, n AS uncovered, CASE WHEN n > 50 THEN 'critical' WHEN n > 20 THEN 'high' WHEN n > 0 THEN 'medium' ELSE 'low' END AS risk FROM n")
def annotate_tool(spark, d):
    """No file here is a test, so that every dependent lacks one."""
    files, spec = imports(spark, d)
    e = Engine(files, spec)
    return e.annotate(e._edges().agg(F.min("file")).first()[0]).select("file", "dependents", "uncovered", "risk")


_SIGNATURES = "sg AS (SELECT 'f' || l_partkey % 80 AS file, CASE WHEN l_suppkey % 13 = 0 THEN '#p' ELSE 's' END || l_suppkey % 25 AS symbol, l_linenumber AS start_line, 'f(a' || l_partkey % 3 || ',b)' AS signature, l_linestatus AS side FROM lineitem)"


@query("o9_api_delta", f"""WITH {_SIGNATURES}, n AS (SELECT *, row_number() OVER (PARTITION BY side, file, symbol ORDER BY start_line, signature) AS o FROM sg),
j AS (SELECT coalesce(b.file, a.file) AS file, coalesce(b.symbol, a.symbol) AS symbol, coalesce(b.o, a.o)::INT AS ordinal, b.signature AS bs, a.signature AS sa FROM (SELECT * FROM n WHERE side = 'F') b FULL JOIN (SELECT * FROM n WHERE side = 'O') a ON a.file = b.file AND a.symbol = b.symbol AND a.o = b.o)
SELECT file, symbol, ordinal, CASE WHEN bs IS NULL THEN 'added' WHEN sa IS NULL THEN 'removed' ELSE 'changed' END AS change FROM j WHERE (bs IS NULL OR sa IS NULL OR bs <> sa) AND NOT starts_with(symbol, '#')""")
def api_delta_tool(spark, d):
    """Signatures before and after, written with other blanks after."""
    li, after = table(spark, d, "lineitem"), F.col("l_linestatus") == "O"
    symbol = F.concat(F.when(F.col("l_suppkey") % 13 == 0, "#p").otherwise("s"), F.col("l_suppkey") % 25)
    text = F.concat(F.lit("f(a"), F.col("l_partkey") % 3, F.when(after, " ,\n  b, )").otherwise(",b)"))
    rows = li.select(F.concat(F.lit("f"), F.col("l_partkey") % 80).alias("file"), symbol.alias("symbol"), F.col("l_linenumber").alias("start_line"), text.alias("signature"), after.alias("after"))
    return Engine(rows).api_delta(rows.where("NOT after"), rows.where("after")).select("file", "symbol", "ordinal", "change")


@query("k3_changed_snapshot", f"WITH {CHUNKS} SELECT file, count(*)::BIGINT AS n FROM chunks WHERE doc_id % 4 <> 1 GROUP BY file UNION ALL SELECT file, 1 FROM chunks WHERE doc_id % 4 = 1 AND doc_id % 8 = 1 GROUP BY file")
def changed_snapshot(spark, d):
    """A published snapshot after one batch of changes: a quarter of the files is touched, half of those are gone, half are one chunk."""
    from codeloom.streaming.changes import Snapshots
    from codeloom.tables import Scratch

    c = chunks(spark, d).select("file", "doc_id", "start_line")
    snaps = Snapshots(spark, Scratch(spark, "snapshots").path("store"), buckets=16)
    snaps.publish(c)
    touched = c.where("doc_id % 4 = 1")
    snaps.replace(store.distinct_ranges(touched.where("doc_id % 8 = 1").withColumn("end_line", F.lit(0)).withColumn("start_line", F.lit(1)).select("file", "doc_id", "start_line", "end_line").distinct(), "doc_id").select("file", "doc_id", "start_line"), touched.where("doc_id % 8 <> 1").select("file"))
    return snaps.read().groupBy("file").agg(F.count("*").alias("n"))


@query("a14_batch_insert", f"WITH {CHUNKS} SELECT file, count(*)::BIGINT AS n FROM chunks GROUP BY file")
def batch_insert(spark, d):
    """Three batches of files as one insert, read back."""
    from codeloom.streaming.changes import Snapshots
    from codeloom.tables import Scratch

    c = chunks(spark, d).select("id", "file", "start_line", "content", "symbol_name", "doc_id")
    snaps = Snapshots(spark, Scratch(spark, "insert").path("store"), buckets=16)
    for k in range(3):
        snaps.replace(c.where(F.col("doc_id") % 3 == k), c.limit(0).select("file"))
    return snaps.read().groupBy("file").agg(F.count("*").alias("n"))


@query("h16_imported_symbols", "WITH m AS (SELECT o_custkey, list_sort(list(DISTINCT 'm' || o_orderkey % 5)) AS modules, list_sort(list(DISTINCT 's' || o_orderkey % 5 || '_' || o_orderkey % 7)) AS symbols FROM orders GROUP BY 1) SELECT o_custkey, array_to_string(modules, ',') AS modules, array_to_string(symbols, ',') AS symbols FROM m")
def imported_symbols(spark, d):
    """A map from module to names, its keys and all its names."""
    k = F.col("o_orderkey")
    per = table(spark, d, "orders").select("o_custkey", F.concat(F.lit("m"), k % 5).alias("module"), F.concat(F.lit("s"), k % 5, F.lit("_"), k % 7).alias("name")).groupBy("o_custkey", "module").agg(F.collect_set("name").alias("names"))
    m = per.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("module", "names"))).alias("m"))
    return m.select("o_custkey", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("modules"), F.array_join(F.array_sort(F.flatten(F.map_values("m"))), ",").alias("symbols"))


@query("g1_stored_counts", _EDGES + "SELECT file, count(DISTINCT importer)::BIGINT AS dependents FROM edges GROUP BY file")
def stored_counts(spark, d):
    """Counts as a full index leaves them: files without dependents aren't there."""
    return stored_edges(spark, d).counts()


@query("x1_stored_dependents", _EDGES + ", one AS (SELECT file, count(*) AS n FROM edges GROUP BY file ORDER BY n DESC, file LIMIT 1) SELECT importer AS file FROM edges WHERE file = (SELECT file FROM one)")
def stored_dependents(spark, d):
    """The dependents of the file that has most, from its bucket alone."""
    index = stored_edges(spark, d)
    return index.dependents(index.counts().orderBy(F.desc("dependents"), "file").first()["file"])


def stored_edges(spark, d):
    from codeloom.operators.imports import EdgeIndex
    from codeloom.tables import Scratch

    files, spec = imports(spark, d)
    index = EdgeIndex(spark, Scratch(spark, "edges").path("index"), buckets=16)
    index.build(spec, files)
    return index
