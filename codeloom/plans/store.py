"""Store queries over chunks made from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import columns as C
from codeloom.operators import metrics, store
from codeloom.plans.registry import query
from codeloom.sources.adapters import CHUNKS, chunks, table

_BASE = f"WITH {CHUNKS} "
_SMALL = ["id", "file", "start_line", "end_line"]
_TAIL = "SELECT id, file, start_line, end_line FROM "


@query("a6_full_scan", _BASE + "SELECT id, file, start_line, end_line, md5(content) AS content_md5 FROM chunks")
def full_scan(spark, d):
    return store.valid(chunks(spark, d)).select(*_SMALL, F.md5("content").alias("content_md5")).orderBy("id")


@query("a7_point_scan", _BASE + _TAIL + "chunks WHERE file IN ('src1/1.md', 'src7/7.md', 'src9/109.md', 'none.md')")
def point_scan(spark, d):
    return store.by_files(chunks(spark, d), ["src1/1.md", "src7/7.md", "src9/109.md", "none.md"]).select(*_SMALL)


@query("a8_symbol_scan", _BASE + "SELECT id, symbol_name, symbol_type FROM chunks WHERE content <> ''")
def symbol_scan(spark, d):
    return chunks(spark, d).where("content <> ''").select("id", "symbol_name", "symbol_type")


@query("a9_third_page", _BASE + _TAIL + "chunks ORDER BY id LIMIT 100 OFFSET 200")
def third_page(spark, d):
    return store.page(chunks(spark, d), 2, 100).select(*_SMALL)


@query("a10_indexed_files", _BASE + "SELECT file, count(*)::BIGINT AS n_chunks FROM chunks GROUP BY file")
def indexed_files(spark, d):
    return chunks(spark, d).groupBy("file").agg(F.count("*").alias("n_chunks"))


@query("a5_oversize", "SELECT source || '/' || doc_id || '.md' AS file, strlen(coalesce(text, '')) > 8192 AS skipped, CASE WHEN strlen(coalesce(text, '')) > 8192 THEN 0 END::INT AS n_chunks FROM documents")
def oversize(spark, d):
    """With 8,192 bytes as the limit, which some documents exceed; a project's limit is store.OVERSIZE."""
    files = table(spark, d, "documents").select(F.concat("source", F.lit("/"), "doc_id", F.lit(".md")).alias("file"), F.col("text").alias("content"))
    return store.indexable(files, 8192).select("file", "skipped", "n_chunks")


@query("a16_deleted_files", _BASE + "SELECT id, file FROM chunks WHERE doc_id % 3 <> 0")
def deleted_files(spark, d):
    c = chunks(spark, d)
    return store.delete_files(c, c.where("doc_id % 3 = 0").select("file")).select("id", "file")


@query("b8_without_self", _BASE + ", t AS (SELECT trim(content, ' ') AS code FROM chunks WHERE id = (SELECT min(id) FROM chunks)) SELECT id FROM chunks, t WHERE NOT ((id % 7) / 20.0 < 0.1 AND trim(content, ' ') = trim(t.code))")
def without_self(spark, d):
    """Hits for the first chunk's own code, with made-up scores."""
    c = chunks(spark, d)
    code = c.orderBy("id").select(F.trim("content")).first()[0]
    return store.without_self(c.withColumn("score", F.col("id") % 7 / 20), code).select("id")


@query("b1_language", _BASE + _TAIL + "chunks WHERE lower(language) = 'de'")
def language(spark, d):
    return store.by_language(chunks(spark, d), "DE").select(*_SMALL)


@query("b2_pattern", _BASE + _TAIL + "chunks WHERE regexp_matches(content, '(?i)\\bthe\\s+and\\b') OR regexp_matches(file, '(?i)\\bthe\\s+and\\b')")
def pattern(spark, d):
    return store.by_pattern(chunks(spark, d), r"\bthe\s+and\b").select(*_SMALL)


@query("b3_unsafe_pattern", _BASE + _TAIL + "chunks")
def unsafe_pattern(spark, d):
    return store.by_pattern(chunks(spark, d), r"(a+)+$").select(*_SMALL)


_PATTERNS = ("^get", "(a+)+$", "(a|a)*", "(ab?)*c", "a*b*c", "[", "x" * 257, "(foo|bar)+", "(Foo|foo)+", "(?:a{1,3}){2}", "a?" * 26, "[(a+)+]", r"\(a+\)+")
_SAFE = (True, False, False, False, True, False, False, True, False, False, False, True, True)


@query("b3_pattern_safety", f"SELECT p_partkey AS k, {list(_SAFE)}[p_partkey % {len(_SAFE)} + 1] AS safe FROM part")
def pattern_safety(spark, d):
    """Patterns of thirteen shapes, judged on the driver before any is sent."""
    judged = F.array(*(F.lit(store.safe_pattern(p) is not None) for p in _PATTERNS))
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.element_at(judged, (F.col("p_partkey") % len(_PATTERNS) + 1).cast("int")).alias("safe"))


@query("t2_categorized_changes", "WITH c AS (SELECT DISTINCT 'f' || o_custkey % 700 AS file FROM orders WHERE o_orderkey % 5 = 0), n AS (SELECT DISTINCT 'f' || o_custkey % 800 AS file FROM orders WHERE o_custkey % 3 > 0), k AS (SELECT DISTINCT 'f' || o_custkey % 900 AS file FROM orders WHERE o_custkey % 4 > 0) SELECT file, 'modified' AS change FROM c WHERE file IN (SELECT file FROM n) AND file IN (SELECT file FROM k) UNION ALL SELECT file, 'added' FROM n WHERE file NOT IN (SELECT file FROM k) UNION ALL SELECT file, 'deleted' FROM k WHERE file NOT IN (SELECT file FROM n)")
def categorized_changes(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_custkey")
    f = lambda df, n: df.select(F.concat(F.lit("f"), k % n).alias("file")).distinct()
    return store.categorize(f(o.where("o_orderkey % 5 = 0"), 700), f(o.where("o_custkey % 3 > 0"), 800), f(o.where("o_custkey % 4 > 0"), 900))


@query("b4_symbol_type", _BASE + "SELECT id, symbol_type FROM chunks WHERE symbol_type IN ('function', 'method')")
def symbol_type(spark, d):
    return store.by_symbol_type(chunks(spark, d), "function").select("id", "symbol_type")


@query("b5_symbol_listing", _BASE + "SELECT id, symbol_name FROM chunks WHERE symbol_name <> '' AND lower(language) = 'en' AND regexp_matches(symbol_name, '(?i)^th') AND symbol_type = 'class'")
def symbol_listing(spark, d):
    return store.by_symbol(chunks(spark, d), "en", "^th", "class").select("id", "symbol_name")


@query("b6_path_hint", _BASE + _TAIL + "chunks WHERE contains(lower(file), 'src1/')")
def path_hint(spark, d):
    return store.path_hint(chunks(spark, d), "SRC1/").select(*_SMALL)


_NAMES = ("src/{k}.test.ts", "pkg/test_{k}.py", "tests/{k}.go", "a/B{k}Test.java", "src/latest/{k}.ts", "lib/specs/{k}.rb", "a\\__tests__\\{k}.js", "Src/UnitTests/{k}.cs", "App/F{k}Tests.swift", "F{k}Tests.ts", "m{k}.test.d.ts", "m{k}_spec.rb")
_IS_TEST = r"regexp_matches(file, '\.(test|spec)\.[^/]+$') OR regexp_matches(file, '_(test|spec)\.[^/]+$') OR regexp_matches(file, '(?i)(^|[/\\])(test|tests|spec|specs|__tests__)[/\\]') OR (ends_with(file, '.swift') AND (regexp_matches(file, 'Tests?\.swift$') OR regexp_matches(file, '(^|[/\\])Tests?[/\\]'))) OR (ends_with(file, '.cs') AND (regexp_matches(file, 'Tests?\.cs$') OR regexp_matches(file, '(^|[/\\])[^/\\]*Tests[/\\]')))"


@query("b9_test_files", "SELECT file, " + _IS_TEST + " AS is_test FROM (SELECT replace([" + ", ".join(f"'{n}'" for n in _NAMES) + "][p_partkey % 12 + 1], '{k}', p_partkey::VARCHAR) AS file FROM part)")
def test_files(spark, d):
    k = F.col("p_partkey")
    name = F.element_at(F.array(*(F.lit(n) for n in _NAMES)), (k % len(_NAMES) + 1).cast("int"))
    return table(spark, d, "part").select(F.replace(name, F.lit("{k}"), k.cast("string")).alias("file")).withColumn("is_test", C.is_test_file(F.col("file")))


@query("b10_any_file", _BASE + _TAIL + "chunks WHERE file = '12.md' OR ends_with(file, '/12.md') OR file = 'src3/3.md' OR ends_with(file, '/src3/3.md')")
def any_file(spark, d):
    return chunks(spark, d).where(store.matches_any(F.col("file"), ["12.md", "src3/3.md"])).select(*_SMALL)


@query("b11_shaped", _BASE + "SELECT id, nullif(symbol_name, '') AS symbol_name, CASE WHEN language <> '' THEN language || '.' || symbol_name END AS enclosing_symbol FROM chunks")
def shaped(spark, d):
    return store.shaped(chunks(spark, d).withColumn("parent_class", F.col("language")), ["id", "symbol_name"])


@query("b12_unindexed", _BASE + "SELECT file FROM (SELECT 'src' || (p_partkey % 20) || '/' || p_partkey || '.md' AS file FROM part) WHERE file NOT IN (SELECT file FROM chunks)")
def unindexed(spark, d):
    asked = table(spark, d, "part").select(F.concat(F.lit("src"), F.col("p_partkey") % 20, F.lit("/"), "p_partkey", F.lit(".md")).alias("file"))
    return store.unindexed(asked, chunks(spark, d).select("file").distinct())


@query("b13_honest_counts", _BASE + ", n AS (SELECT file, count(*) AS c FROM chunks WHERE start_line > 1 GROUP BY file) SELECT DISTINCT k.file, CASE WHEN NOT (coalesce(n.c, 0) = 0 AND k.language = 'fr') THEN coalesce(n.c, 0) END::BIGINT AS dependents FROM chunks k LEFT JOIN n USING (file)")
def honest_counts(spark, d):
    c = chunks(spark, d)
    counts = c.where("start_line > 1").groupBy("file").agg(F.count("*").alias("dependents"))
    return store.honest_counts(c.select("file", "language").distinct(), counts, True, F.col("language") == "fr").select("file", "dependents")


@query("g22_distinct_ranges", _BASE + "SELECT file, start_line, end_line, min(id) AS id FROM (SELECT id, 'f' || (id % 97) AS file, start_line, (end_line // 10)::INT AS end_line FROM chunks) GROUP BY 1, 2, 3")
def distinct_ranges(spark, d):
    c = chunks(spark, d).select("id", F.concat(F.lit("f"), F.col("id") % 97).alias("file"), "start_line", F.floor(F.col("end_line") / 10).cast("int").alias("end_line"))
    return store.distinct_ranges(c, "id")


@query("f3_list_page", _BASE + "SELECT id, symbol_name, true AS has_more, 30 AS next_offset FROM (SELECT id, symbol_name FROM chunks WHERE symbol_name <> '' ORDER BY symbol_name, id LIMIT 20 OFFSET 10)")
def list_page(spark, d):
    return store.list_page(store.by_symbol(chunks(spark, d)).select("id", "symbol_name"), ["symbol_name", "id"], 20, 10).drop("rank")


_TWO = """WITH m AS (SELECT source || '/' || doc_id || '.md' AS file, substr(sha256(coalesce(text, '')), 1, 16) AS h, doc_id FROM documents),
b AS (SELECT file, h, 0 AS t FROM m WHERE doc_id % 11 <> 0), a AS (SELECT file, CASE WHEN doc_id % 7 = 0 THEN 'x' || h ELSE h END AS h, (doc_id % 3)::INT AS t FROM m WHERE doc_id % 13 <> 0),
j AS (SELECT coalesce(b.file, a.file) AS file, CASE WHEN b.h IS NULL THEN 'added' WHEN a.h IS NULL THEN 'deleted' WHEN a.h <> b.h THEN 'modified' WHEN a.t <> b.t THEN 'touched' ELSE 'unchanged' END AS change FROM b FULL JOIN a ON a.file = b.file) """


def _snapshots(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat("source", F.lit("/"), "doc_id", F.lit(".md")).alias("file"), F.coalesce("text", F.lit("")).alias("content"))
    m = docs.select("doc_id", "file", C.content_hash(F.col("content")).alias("content_hash"))
    before = m.where("doc_id % 11 <> 0").withColumn("mtime", F.lit(0))
    h = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("x"), "content_hash")).otherwise(F.col("content_hash"))
    after = m.where("doc_id % 13 <> 0").withColumn("content_hash", h).withColumn("mtime", (F.col("doc_id") % 3).cast("int"))
    return before, after


@query("t1_snapshot_difference", _TWO + "SELECT file, change FROM j")
def snapshot_difference(spark, d):
    return store.snapshot_difference(*_snapshots(spark, d))


@query("t3_reindex_plan", _TWO + "SELECT change, count(*)::BIGINT AS files, change IN ('added', 'modified') AS reindex FROM j GROUP BY change")
def reindex_plan(spark, d):
    diff = store.snapshot_difference(*_snapshots(spark, d))
    return diff.groupBy("change").agg(F.count("*").alias("files")).withColumn("reindex", F.col("change").isin("added", "modified"))


@query("j22_overlay_view", _BASE + ", own AS (SELECT id, file, symbol_type, 'overlay' AS origin FROM chunks WHERE doc_id % 10 = 3), mask AS (SELECT file FROM chunks WHERE doc_id % 10 IN (3, 4)) SELECT id, file, origin FROM own UNION ALL SELECT id, file, 'base' FROM chunks WHERE file NOT IN (SELECT file FROM mask)")
def overlay_view(spark, d):
    c = chunks(spark, d)
    own = c.where("doc_id % 10 = 3").select("id", "file", F.lit("overlay").alias("origin"))
    mask = c.where("doc_id % 10 in (3, 4)").select("file").distinct()
    return store.overlay_view(c.select("id", "file", F.lit("base").alias("origin")), own, mask)


@query("a15_replace_files", _BASE + "SELECT id, file, content_md5 FROM (SELECT id, file, md5(content) AS content_md5, doc_id FROM chunks) WHERE doc_id % 5 > 1 UNION ALL SELECT id, file, md5('x' || content) FROM chunks WHERE doc_id % 5 = 1")
def replace_files(spark, d):
    c = chunks(spark, d)
    new = c.where("doc_id % 5 = 1").select("id", "file", F.md5(F.concat(F.lit("x"), "content")).alias("content_md5"))
    return store.replace_files(c.select("id", "file", F.md5("content").alias("content_md5")), new, c.where("doc_id % 5 = 0").select("file").distinct())


@query("t4_overlay_mask", _TWO + "SELECT file, change <> 'deleted' AS diverged FROM j WHERE change IN ('added', 'modified', 'deleted')")
def overlay_mask(spark, d):
    diff = store.snapshot_difference(*_snapshots(spark, d)).where(F.col("change").isin("added", "modified", "deleted"))
    return diff.select("file", (F.col("change") != "deleted").alias("diverged"))


@query("t5_signature", """WITH h AS (SELECT sha256(source || '/' || doc_id || '.md:' || substr(sha256(coalesce(text, '')), 1, 16)) AS h FROM documents),
p AS (SELECT count(*) AS n, sum(('0x' || substr(h, 1, 15))::HUGEINT) AS a, sum(('0x' || substr(h, 16, 15))::HUGEINT) AS b, sum(('0x' || substr(h, 31, 15))::HUGEINT) AS c, sum(('0x' || substr(h, 46, 15))::HUGEINT) AS d FROM h) SELECT sha256(n || ':' || a || ':' || b || ':' || c || ':' || d) AS signature FROM p""")
def signature(spark, d):
    docs = table(spark, d, "documents").select(F.concat("source", F.lit("/"), "doc_id", F.lit(".md")).alias("file"), F.coalesce("text", F.lit("")).alias("content"))
    return store.signature(store.manifest(docs))


@query("a21_keep_last", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def keep_last(spark, d):
    return store.keep_last(table(spark, d, "events"), 200, F.desc("ts"), F.desc("event_id")).select("event_id")


@query("a20_stale_indexes", """WITH i AS (SELECT c_custkey AS idx, c_nationkey, max(o_orderdate) AS last_access FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2), n AS (SELECT max(o_orderdate) AS now FROM orders),
x AS (SELECT idx, c_nationkey AS k, floor((epoch_us(now) - epoch_us(last_access)) / 86400000000)::BIGINT AS age_days FROM i, n)
SELECT idx, age_days, CASE WHEN k % 11 = 0 THEN 'current-project' WHEN k % 6 = 1 THEN 'volume-offline' WHEN k % 7 = 2 THEN 'in-use' WHEN k % 6 = 0 THEN 'orphan' WHEN age_days > 60 THEN 'stale' WHEN k % 5 = 3 THEN 'unknown-provenance' ELSE 'present' END AS reason,
CASE WHEN k % 11 = 0 OR k % 6 = 1 OR k % 7 = 2 THEN 'keep' WHEN k % 6 = 0 OR age_days > 60 THEN 'remove' ELSE 'keep' END AS action FROM x""")
def stale_indexes(spark, d):
    """Customers as indexes, last accessed by their last order; what their roots are follows from the nation."""
    k = F.col("c_nationkey")
    orders = table(spark, d, "orders")
    seen = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_access"))
    root = F.when(k % 6 == 1, "offline").when(k % 6 == 0, "gone").otherwise("there")
    inventory = table(spark, d, "customer").join(seen, "c_custkey").select(F.col("c_custkey").alias("idx"), F.when(k % 5 != 3, "root").alias("source_root"), root.alias("root_state"), (k % 7 == 2).alias("in_use"), (k % 11 == 0).alias("protected"), "last_access")
    now = F.lit(orders.agg(F.max("o_orderdate")).first()[0])
    return store.plan_gc(inventory, now).select("idx", "age_days", "reason", "action")


@query("m2_line_windows", _BASE + "SELECT file, start_line, end_line, sha256(content) AS sha FROM chunks")
def line_windows(spark, d):
    return chunks(spark, d).select("file", "start_line", "end_line", F.sha2("content", 256).alias("sha"))


@query("h_symbol_tokens", _BASE + """SELECT id, lower(array_to_string(list_transform(regexp_extract_all(symbol_name || 'HTTPServer2Go_x', '[A-Z]+[a-z]*|[a-z]+|[0-9]+'), lambda x: regexp_replace(x, '^([A-Z]+)([A-Z][a-z]+)$', '\\1 \\2')), ' ')) AS tokens FROM chunks""")
def symbol_tokens(spark, d):
    return chunks(spark, d).select("id", C.symbol_tokens(F.concat("symbol_name", F.lit("HTTPServer2Go_x"))).alias("tokens"))


@query("g21_status", _BASE + "SELECT count(DISTINCT file)::BIGINT AS files, count(*)::BIGINT AS chunks, sum(end_line - start_line + 1)::BIGINT AS lines FROM chunks")
def status(spark, d):
    return chunks(spark, d).agg(F.countDistinct("file").alias("files"), F.count("*").alias("chunks"), F.sum(F.col("end_line") - F.col("start_line") + 1).alias("lines"))


_CODE_NAMES = ("loadAll", "load_all", "LoadAll", "LOAD_ALL", "x", "runTask", "go2")
_BASE_CODE = f"""cb AS (SELECT p_partkey AS k, 'd' || p_size || '/' || CASE p_size % 7 WHEN 0 THEN 'index.ts' ELSE 'f' || p_partkey % 300 || '.ts' END AS file, ['function', 'method', 'class', 'interface', 'block'][p_partkey % 5 + 1] AS symbol_type, {list(_CODE_NAMES)}[p_partkey % 7 + 1] AS symbol_name,
  ['typescript', 'python', 'go'][p_size % 3 + 1] AS language, CASE WHEN p_partkey % 4 = 0 THEN ['e' || p_size % 9] ELSE [] END AS exports, CASE WHEN p_partkey % 3 = 0 THEN ['e' || p_partkey % 9] ELSE [] END AS taken, CASE p_partkey % 4 WHEN 0 THEN ['./a', '../../b/c'] WHEN 1 THEN ['lodash'] ELSE [] END AS imports,
  ['async f()', 'f(): Promise<x>', 'function f(cb)', 'f()'][p_size % 4 + 1] AS signature FROM part)"""


@query("g19_fingerprint", f"""WITH {_BASE_CODE}, s AS (SELECT *, CASE WHEN length(symbol_name) < 2 OR regexp_matches(symbol_name, '^[A-Z][A-Z0-9_]+$') THEN NULL WHEN regexp_matches(symbol_name, '^[A-Z][a-zA-Z0-9]*$') THEN 'PascalCase' WHEN regexp_matches(symbol_name, '^[a-z][a-z0-9]*(_[a-z0-9]+)+$') THEN 'snake_case' WHEN regexp_matches(symbol_name, '^[a-z][a-zA-Z0-9]*$') THEN 'camelCase' END AS style FROM cb),
a AS (SELECT count(*) FILTER (WHERE symbol_type = 'function')::BIGINT AS functions, count(*) FILTER (WHERE symbol_type = 'method')::BIGINT AS methods, count(*) FILTER (WHERE symbol_type IN ('class', 'interface'))::BIGINT AS classes, count(*)::BIGINT AS chunks FROM s),
nm AS (SELECT symbol_type IN ('class', 'interface') AS cl, style, count(*) / sum(count(*)) OVER (PARTITION BY symbol_type IN ('class', 'interface')) AS share FROM s WHERE style IS NOT NULL AND symbol_type <> 'block' GROUP BY 1, 2),
ex AS (SELECT DISTINCT file, unnest(exports) AS x FROM cb), im AS (SELECT DISTINCT file, unnest(taken) AS x FROM cb), br AS (SELECT count(*)::BIGINT AS barrels FROM (SELECT DISTINCT file FROM ex WHERE ends_with(file, '/index.ts') OR (file, x) IN (SELECT (file, x) FROM im))),
dp AS (SELECT avg(len(string_split(i, '/')) - 1) AS depth FROM (SELECT unnest(imports) AS i FROM cb) WHERE starts_with(i, '.')), w AS (SELECT count(*) FILTER (WHERE starts_with(signature, 'async')) AS a, count(*) FILTER (WHERE contains(signature, 'Promise')) AS p, count(*) FILTER (WHERE contains(signature, 'cb')) AS c FROM cb WHERE symbol_type IN ('function', 'method')),
r AS (SELECT *, functions / (functions + methods + classes)::DOUBLE AS ratio FROM a)
SELECT functions, methods, classes, round(ratio, 9) AS ratio, CASE WHEN ratio >= 0.7 THEN 'functional' WHEN ratio <= 0.3 THEN 'oop' ELSE 'mixed' END AS style, coalesce((SELECT style FROM nm WHERE NOT cl AND share > 0.5), 'mixed') AS function_names, coalesce((SELECT style FROM nm WHERE cl AND share > 0.5), 'mixed') AS class_names, barrels, round(depth, 9) AS import_depth,
CASE WHEN depth < 2 THEN 'flat' WHEN depth > 3 THEN 'nested' ELSE 'moderate' END AS structure, CASE WHEN a > 0.6 * (a + p + c) THEN 'async/await' WHEN p > 0.6 * (a + p + c) THEN 'promises' WHEN c > 0.6 * (a + p + c) THEN 'callbacks' ELSE 'mixed' END AS async_pattern, chunks FROM r, br, dp, w""")
def fingerprint(spark, d):
    out = metrics.fingerprint(_code_base(spark, d))
    return out.withColumn("ratio", F.round("ratio", 9)).withColumn("import_depth", F.round("import_depth", 9))


def _code_base(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda values, i: F.element_at(F.array(*(F.lit(v) for v in values)), (i % len(values) + 1).cast("int"))
    none = F.array().cast("array<string>")
    file = F.concat(F.lit("d"), size, F.lit("/"), F.when(size % 7 == 0, "index.ts").otherwise(F.concat(F.lit("f"), k % 300, F.lit(".ts"))))
    return table(spark, d, "part").select(
        file.alias("file"), pick(("function", "method", "class", "interface", "block"), k).alias("symbol_type"), pick(_CODE_NAMES, k).alias("symbol_name"), pick(("typescript", "python", "go"), size).alias("language"),
        F.when(k % 4 == 0, F.array(F.concat(F.lit("e"), size % 9))).otherwise(none).alias("exports"), F.when(k % 3 == 0, F.create_map(F.lit("m"), F.array(F.concat(F.lit("e"), k % 9)))).alias("imported_symbols"),
        F.when(k % 4 == 0, F.array(F.lit("./a"), F.lit("../../b/c"))).when(k % 4 == 1, F.array(F.lit("lodash"))).alias("imports"), pick(("async f()", "f(): Promise<x>", "function f(cb)", "f()"), size).alias("signature"), F.lit("body").alias("content"),
    )


@query("g19_language_shares", f"WITH {_BASE_CODE} SELECT language, greatest(1, floor(count(*) / sum(count(*)) OVER () * 100 + 0.5))::INT AS percent FROM cb GROUP BY language")
def language_shares(spark, d):
    return metrics.language_shares(_code_base(spark, d))


@query("h4_naming_styles", f"WITH {_BASE_CODE} SELECT k, ['camelCase', 'snake_case', 'PascalCase', NULL, NULL, 'camelCase', 'camelCase'][k % 7 + 1] AS style FROM cb")
def naming_styles(spark, d):
    name = F.element_at(F.array(*(F.lit(v) for v in _CODE_NAMES)), (F.col("p_partkey") % 7 + 1).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), C.identifier_style(name).alias("style"))
