"""Queries over tests beside their source, recovered references and symbol dependents, on code paths made from part (synthetic)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import columns as C
from codeloom.functions import languages
from codeloom.operators import recovery as R
from codeloom.plans.registry import query
from codeloom.sources.adapters import table

_SHAPES = ("core/src/main/java/com/g{g}/C{m}.java", "core/src/test/java/com/g{g}/C{m}Test.java", "pkg/p{g}/f{m}.go", "pkg/p{g}/f{m}_test.go", "App/V{m}.swift", "Tests/V{m}Tests.swift", "src/u{m}.ts", "src/u{m}.test.ts")
_SQL_SHAPES = "[" + ", ".join(f"'{s}'" for s in _SHAPES) + "]"
_CODE = f"code AS (SELECT DISTINCT replace(replace({_SQL_SHAPES}[p_partkey % 8 + 1], '{{g}}', (p_size % 7)::VARCHAR), '{{m}}', (p_partkey // 8 % 60)::VARCHAR) AS file, p_partkey // 8 % 60 AS m FROM part WHERE (p_partkey // 8 + p_partkey % 8) % 5 > 0)"
_IS_TEST = "(regexp_matches(file, '[._](test|spec)\\.[^/]+$') OR regexp_matches(file, '(?i)(^|/)(tests?|specs?|__tests__)/') OR regexp_matches(file, 'Tests?\\.swift$'))"


def _code(spark, d):
    k = F.col("p_partkey")
    m = F.floor(k / 8) % 60
    name = F.element_at(F.array(*(F.lit(s) for s in _SHAPES)), (k % 8 + 1).cast("int"))
    name = F.replace(F.replace(name, F.lit("{g}"), (F.col("p_size") % 7).cast("string")), F.lit("{m}"), m.cast("string"))
    return table(spark, d, "part").where((F.floor(k / 8) + k % 8) % 5 > 0).select(name.alias("file"), m.alias("m")).distinct()


_JAVA = f"ja AS (SELECT file, regexp_extract(file, '(^|/)src/[^/]+/java/(.+)\\.java$', 2) AS inside, {_IS_TEST} AS is_test FROM code WHERE ends_with(file, '.java')), jp AS (SELECT a.file, b.file AS test FROM ja a JOIN ja b ON b.inside = a.inside || 'Test' WHERE b.is_test)"
_GO = f"go AS (SELECT file, replace(file, '.go', '') AS own, {_IS_TEST} AS is_test FROM code WHERE ends_with(file, '.go')), gp AS (SELECT a.file, b.file AS test FROM go a JOIN go b ON b.own = a.own || '_test' WHERE b.is_test)"


@query("j12_java_tests", f"WITH {_CODE}, {_JAVA} SELECT file, test FROM jp")
def java_tests(spark, d):
    return R.java_test_pairs(_code(spark, d))


@query("j11_go_tests", f"WITH {_CODE}, {_GO} SELECT file, test FROM gp")
def go_tests(spark, d):
    return R.go_test_pairs(_code(spark, d))


@query("j13_package_tests", f"""WITH {_CODE}, {_JAVA}, {_GO}, found AS (SELECT * FROM jp UNION SELECT * FROM gp), bare AS (SELECT file FROM code WHERE file NOT IN (SELECT file FROM found))
SELECT DISTINCT a.file, b.file AS test FROM go a JOIN go b ON regexp_replace(a.own, '/[^/]*$', '') = regexp_replace(b.own, '/[^/]*$', '') AND b.is_test AND a.own <> b.own WHERE a.file IN (SELECT file FROM bare)
UNION SELECT DISTINCT a.file, b.file FROM ja a JOIN ja b ON regexp_replace(a.inside, '/[^/]*$', '') = regexp_replace(b.inside, '/[^/]*$', '') AND b.is_test AND a.inside <> b.inside WHERE a.file IN (SELECT file FROM bare)""")
def package_tests(spark, d):
    files = _code(spark, d)
    return R.package_tests(files, R.java_test_pairs(files).unionByName(R.go_test_pairs(files)))


_SPEC = "sp AS (SELECT file AS importer, CASE m % 3 WHEN 0 THEN './u' || m WHEN 1 THEN 'src/u' || m ELSE 'lib/x' END AS specifier FROM code WHERE ends_with(file, '.test.ts'))"


@query("j10_test_associations", f"""WITH {_CODE}, {_JAVA}, {_GO}, {_SPEC}, u AS (SELECT file, regexp_replace(file, '\\.ts$', '') AS own FROM code),
p AS (SELECT u.file, sp.importer AS test, 1 AS rank FROM u JOIN sp ON sp.specifier = u.own AND u.file <> sp.importer UNION ALL SELECT u.file, sp.importer, 2 FROM u JOIN sp ON starts_with(sp.specifier, './') AND ends_with(u.own, '/' || substr(sp.specifier, 3)) UNION ALL SELECT file, test, 3 FROM gp UNION ALL SELECT file, test, 4 FROM jp)
SELECT file, test, ['exact', 'fuzzy', 'go', 'java'][min(rank)] AS via FROM p GROUP BY file, test""")
def test_associations(spark, d):
    files = _code(spark, d)
    spec = F.when(F.col("m") % 3 == 0, F.concat(F.lit("./u"), "m")).when(F.col("m") % 3 == 1, F.concat(F.lit("src/u"), "m")).otherwise("lib/x")
    specifiers = files.where("file like '%.test.ts'").select(F.col("file").alias("importer"), spec.alias("specifier"))
    return R.test_associations(files, specifiers)


@query("t6_test_union", f"WITH {_CODE}, {_JAVA}, {_GO}, {_SPEC}, e AS (SELECT c.file, sp.importer AS test FROM code c JOIN sp ON regexp_replace(c.file, '\\.ts$', '') = sp.specifier OR (starts_with(sp.specifier, './') AND c.file = 'src/u' || substr(sp.specifier, 4) || '.ts')), a AS (SELECT * FROM e UNION SELECT * FROM gp UNION SELECT * FROM jp) SELECT file, count(*)::BIGINT AS tests FROM a GROUP BY file")
def test_union(spark, d):
    """How many tests each file has, however they were found: exact, fuzzy and by convention, none counted twice."""
    return test_associations(spark, d).groupBy("file").agg(F.count("*").alias("tests"))


@query("j9_same_package_union", """WITH e AS (SELECT DISTINCT 'f' || l_partkey % 50 AS file, 's' || l_suppkey % 9 AS symbol, 'c' || l_orderkey % 70 AS caller, ['same-file', 'import-verified', 'symbol-name-match'][l_linenumber % 3 + 1] AS provenance FROM lineitem WHERE l_quantity < 10),
x AS (SELECT DISTINCT 'f' || p_partkey % 50 AS file, 's' || p_size % 9 AS symbol, 'c' || p_partkey % 70 AS caller FROM part)
SELECT * FROM e UNION ALL SELECT file, symbol, caller, 'namespace-inferred' FROM x WHERE (file, symbol, caller) NOT IN (SELECT (file, symbol, caller) FROM e)""")
def same_package_union(spark, d):
    s = lambda p, c: F.concat(F.lit(p), c)
    kind = F.element_at(F.array(F.lit("same-file"), F.lit("import-verified"), F.lit("symbol-name-match")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    e = table(spark, d, "lineitem").where("l_quantity < 10").select(s("f", F.col("l_partkey") % 50).alias("file"), s("s", F.col("l_suppkey") % 9).alias("symbol"), s("c", F.col("l_orderkey") % 70).alias("caller"), kind.alias("provenance")).distinct()
    x = table(spark, d, "part").select(s("f", F.col("p_partkey") % 50).alias("file"), s("s", F.col("p_size") % 9).alias("symbol"), s("c", F.col("p_partkey") % 70).alias("caller"))
    return R.with_same_package(e, x)


_NAMES = ("newRouter", "Get", "HTTPServer", "map", "load_config", "Engine")
_GO_ROOT = f"""ex AS (SELECT CASE p_partkey % 3 WHEN 0 THEN 'r' || p_partkey % 40 || '.go' WHEN 1 THEN 'pkg/r' || p_partkey % 40 || '.go' ELSE 'r' || p_partkey % 40 || '_test.go' END AS file, {list(_NAMES)}[p_size % 6 + 1] || p_partkey % 97 AS symbol FROM part),
im AS (SELECT 'cmd/c' || l_orderkey % 90 || CASE l_suppkey % 5 WHEN 0 THEN '.ts' ELSE '.go' END AS importer, CASE l_linenumber % 2 WHEN 0 THEN 'github.com/o/m' ELSE 'github.com/o/m/sub' END AS specifier FROM lineitem),
ca AS (SELECT DISTINCT 'cmd/c' || l_orderkey % 90 || CASE l_suppkey % 5 WHEN 0 THEN '.ts' ELSE '.go' END AS file, {list(_NAMES)}[l_suppkey % 6 + 1] || l_partkey % 97 AS symbol FROM lineitem)"""


def _go_root(spark, d):
    k, name = F.col("p_partkey"), F.array(*(F.lit(x) for x in _NAMES))
    file = F.concat(F.when(k % 3 == 1, "pkg/r").otherwise("r"), k % 40, F.when(k % 3 == 2, "_test.go").otherwise(".go"))
    exports = table(spark, d, "part").select(file.alias("file"), F.concat(F.element_at(name, (F.col("p_size") % 6 + 1).cast("int")), k % 97).alias("symbol"))
    li = table(spark, d, "lineitem")
    at = F.concat(F.lit("cmd/c"), F.col("l_orderkey") % 90, F.when(F.col("l_suppkey") % 5 == 0, ".ts").otherwise(".go"))
    imports = li.select(at.alias("importer"), F.when(F.col("l_linenumber") % 2 == 0, "github.com/o/m").otherwise("github.com/o/m/sub").alias("specifier")).distinct()
    calls = li.select(at.alias("file"), F.concat(F.element_at(name, (F.col("l_suppkey") % 6 + 1).cast("int")), F.col("l_partkey") % 97).alias("symbol")).distinct()
    return exports, imports, calls


@query("j17_root_package", f"""WITH {_GO_ROOT}, own AS (SELECT symbol, min(file) AS file FROM ex WHERE NOT contains(file, '/') AND NOT ends_with(file, '_test.go') AND (regexp_matches(symbol, '[a-z][A-Z]|[A-Z][a-z]') OR regexp_matches(symbol, '[A-Za-z0-9_]_[A-Za-z0-9_]')) AND regexp_matches(symbol, '[a-z0-9][A-Z]|[A-Z][A-Z][a-z]|[A-Za-z0-9]_+[A-Za-z0-9]') GROUP BY symbol HAVING count(DISTINCT file) = 1)
SELECT DISTINCT ca.file AS importer, own.file FROM ca JOIN own USING (symbol) WHERE ends_with(ca.file, '.go') AND ca.file <> own.file AND ca.file IN (SELECT importer FROM im WHERE specifier = 'github.com/o/m')""")
def root_package(spark, d):
    return R.root_package_references(*_go_root(spark, d), "github.com/o/m")


_TYPES = ("RetryPolicy", "Session", "prepareForRetry", "_CancelID", "URLForm", "flat_map")


@query("j18_module_usages", f"""WITH dc AS (SELECT 'Source/S' || p_partkey % 200 || '.swift' AS file, {list(_TYPES)}[p_size % 6 + 1] || chr((65 + p_partkey % 26)::INT) || 'x' || p_partkey % 31 AS symbol, p_partkey % 4 = 0 AS ext FROM part),
sy AS (SELECT 'Tests/T' || l_orderkey % 120 || 'Tests.swift' AS test, {list(_TYPES)}[l_suppkey % 6 + 1] || chr((65 + l_partkey % 26)::INT) || 'x' || l_partkey % 31 AS symbol FROM lineitem),
dd AS (SELECT * FROM dc WHERE NOT ext OR symbol IN (SELECT symbol FROM dc WHERE NOT ext)), own AS (SELECT symbol, min(file) AS file FROM dd WHERE regexp_matches(symbol, '[a-z0-9][A-Z]|[A-Z][A-Z][a-z]|[A-Za-z0-9]_+[A-Za-z0-9]') GROUP BY symbol HAVING count(DISTINCT file) = 1)
SELECT own.file, sy.test FROM sy JOIN own USING (symbol) GROUP BY 1, 2 HAVING bool_or(regexp_matches(symbol, '^_*[A-Z]'))""")
def module_usages(spark, d):
    name = lambda a, b: F.concat(F.element_at(F.array(*(F.lit(x) for x in _TYPES)), (a % 6 + 1).cast("int")), F.char((F.lit(65) + b % 26).cast("int")), F.lit("x"), b % 31)
    k = F.col("p_partkey")
    dc = table(spark, d, "part").select(F.concat(F.lit("Source/S"), k % 200, F.lit(".swift")).alias("file"), name(F.col("p_size"), k).alias("symbol"), (k % 4 == 0).alias("extension"))
    calls = table(spark, d, "lineitem").select(F.concat(F.lit("Tests/T"), F.col("l_orderkey") % 120, F.lit("Tests.swift")).alias("file"), name(F.col("l_suppkey"), F.col("l_partkey")).alias("symbol"))
    return R.module_usage_tests(dc, calls)


_ASKED = """us AS (SELECT DISTINCT 'f' || l_partkey % 40 AS file, 's' || l_suppkey % 12 AS symbol, 'd' || l_orderkey % 60 AS dependent FROM lineitem WHERE l_suppkey % 12 < 7), fd AS (SELECT DISTINCT 'f' || l_partkey % 40 AS file, 'd' || l_orderkey % 60 AS dependent FROM lineitem WHERE l_partkey % 40 < 35),
ex AS (SELECT 'f' || a AS file, 's' || b AS symbol, b % 3 = 0 AS exported FROM range(45) x(a), range(12) y(b)), dl AS (SELECT DISTINCT 'f' || p_partkey % 40 AS file, 's' || p_size % 10 AS symbol, ['class', 'function', 'interface', 'method'][p_size % 4 + 1] AS kind FROM part)"""


@query("x4_symbol_dependents", f"""WITH {_ASKED}, q AS (SELECT ex.*, EXISTS (SELECT 1 FROM us WHERE us.file = ex.file AND us.symbol = ex.symbol) AS used, EXISTS (SELECT 1 FROM fd WHERE fd.file = ex.file) AS deps, EXISTS (SELECT 1 FROM dl WHERE dl.file = ex.file AND dl.symbol = ex.symbol) AS declared,
  EXISTS (SELECT 1 FROM dl WHERE dl.file = ex.file AND dl.symbol = ex.symbol AND kind IN ('class', 'interface')) AS is_type FROM ex), g AS (SELECT *, NOT exported AND NOT used AND deps AS degraded FROM q)
SELECT g.file, g.symbol, us.dependent, degraded, NULL::BOOLEAN AS found_in_file, is_type AS type_incomplete FROM g JOIN us ON us.file = g.file AND us.symbol = g.symbol WHERE NOT degraded UNION ALL SELECT g.file, g.symbol, fd.dependent, degraded, declared, false FROM g JOIN fd ON fd.file = g.file WHERE degraded""")
def symbol_dependents(spark, d):
    s = lambda p, c: F.concat(F.lit(p), c)
    li, part = table(spark, d, "lineitem"), table(spark, d, "part")
    usages = li.where("l_suppkey % 12 < 7").select(s("f", F.col("l_partkey") % 40).alias("file"), s("s", F.col("l_suppkey") % 12).alias("symbol"), s("d", F.col("l_orderkey") % 60).alias("dependent")).distinct()
    deps = li.where("l_partkey % 40 < 35").select(s("f", F.col("l_partkey") % 40).alias("file"), s("d", F.col("l_orderkey") % 60).alias("dependent")).distinct()
    asked = spark.range(45 * 12).select(s("f", F.floor(F.col("id") / 12)).alias("file"), s("s", F.col("id") % 12).alias("symbol"), (F.col("id") % 12 % 3 == 0).alias("exported"))
    kind = F.element_at(F.array(*(F.lit(x) for x in ("class", "function", "interface", "method"))), (F.col("p_size") % 4 + 1).cast("int"))
    decl = part.select(s("f", F.col("p_partkey") % 40).alias("file"), s("s", F.col("p_size") % 10).alias("symbol"), kind.alias("kind"))
    return R.symbol_dependents(usages, deps, asked, decl).select("file", "symbol", "dependent", "degraded", "found_in_file", "type_incomplete")


_EDGES = "ed AS (SELECT DISTINCT 'f' || l_partkey % 40 AS file, 's' || l_suppkey % 12 AS symbol, 'd' || l_orderkey % 60 AS caller, ['same-file', 'import-verified', 'import-only', 'require-only', 'symbol-name-match', 'oop-method-import', 'namespace-inferred'][l_linenumber % 7 + 1] AS provenance FROM lineitem)"


def _edges(spark, d):
    s = lambda p, c: F.concat(F.lit(p), c)
    kind = F.element_at(F.array(*(F.lit(x) for x in R.PROVENANCE)), (F.col("l_linenumber") % 7 + 1).cast("int"))
    return table(spark, d, "lineitem").select(s("f", F.col("l_partkey") % 40).alias("file"), s("s", F.col("l_suppkey") % 12).alias("symbol"), s("d", F.col("l_orderkey") % 60).alias("caller"), kind.alias("provenance")).distinct()


@query("x9_import_evidence", f"WITH {_EDGES}, {_ASKED} SELECT DISTINCT ed.file, ed.symbol, caller AS dependent FROM ed JOIN us ON us.file = ed.file AND us.symbol = ed.symbol AND us.dependent = ed.caller WHERE provenance IN ('import-verified', 'import-only')")
def import_evidence(spark, d):
    s = lambda p, c: F.concat(F.lit(p), c)
    usages = table(spark, d, "lineitem").where("l_suppkey % 12 < 7").select(s("f", F.col("l_partkey") % 40).alias("file"), s("s", F.col("l_suppkey") % 12).alias("symbol"), s("d", F.col("l_orderkey") % 60).alias("dependent")).distinct()
    return R.import_only_evidence(_edges(spark, d), usages)


@query("x8_provenance_tiers", f"WITH {_EDGES} SELECT provenance, provenance IN ('same-file', 'import-verified', 'import-only') AS precise, count(*)::BIGINT AS edges FROM ed GROUP BY 1, 2")
def provenance_tiers(spark, d):
    return _edges(spark, d).groupBy("provenance", R.precise(F.col("provenance")).alias("precise")).agg(F.count("*").alias("edges"))


@query("x11_recovery_notes", "WITH e AS (SELECT DISTINCT 'f' || p_partkey % 90 AS file, ['csharp-type-reference', 'go-root-package-export', 'jvm-same-package'][p_size % 3 + 1] AS mechanism FROM part) SELECT file, mechanism, ['C#', 'Go', 'Java/Kotlin'][list_position(['csharp-type-reference', 'go-root-package-export', 'jvm-same-package'], mechanism)] AS mechanism_language FROM e")
def recovery_notes(spark, d):
    kind = F.element_at(F.array(*(F.lit(x) for x in R.MECHANISMS)), (F.col("p_size") % 3 + 1).cast("int"))
    e = table(spark, d, "part").select(F.concat(F.lit("f"), F.col("p_partkey") % 90).alias("file"), kind.alias("mechanism")).distinct()
    return R.mechanism_notes(e).select("file", "mechanism", "mechanism_language")


_CHUNKS = "ck AS (SELECT p_partkey AS id, 'f' || p_partkey % 300 AS file, CASE WHEN p_size % 5 = 0 THEN '' ELSE 'n' || p_size END AS symbol_name, ['class', 'function', 'method', 'block'][p_size % 4 + 1] AS symbol_type, CASE WHEN p_partkey % 3 = 0 THEN 'P' ELSE '' END AS parent_class, CASE WHEN p_size % 6 > 0 THEN p_size % 23 END::INT AS complexity FROM part)"


def _chunks(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    kind = F.element_at(F.array(*(F.lit(x) for x in ("class", "function", "method", "block"))), (size % 4 + 1).cast("int"))
    return table(spark, d, "part").select(k.alias("id"), F.concat(F.lit("f"), k % 300).alias("file"), F.when(size % 5 == 0, "").otherwise(F.concat(F.lit("n"), size)).alias("symbol_name"), kind.alias("symbol_type"), F.when(k % 3 == 0, "P").otherwise("").alias("parent_class"), F.when(size % 6 > 0, (size % 23).cast("int")).alias("complexity"))


@query("w3_representatives", f"WITH {_CHUNKS}, r AS (SELECT file, coalesce(min(id) FILTER (WHERE symbol_type = 'class' AND parent_class = ''), min(id) FILTER (WHERE symbol_type = 'function' AND parent_class = ''), min(id) FILTER (WHERE symbol_name <> '')) AS id FROM ck GROUP BY file) SELECT r.file, r.id, coalesce(ck.symbol_name, '(module-level)') AS symbol_name FROM r LEFT JOIN ck USING (id)")
def representatives(spark, d):
    return R.representatives(_chunks(spark, d))


@query("w4_most_complex", f"WITH {_CHUNKS} SELECT file, symbol_name, id, complexity FROM (SELECT file, symbol_name, id, coalesce(complexity, 0)::INT AS complexity, row_number() OVER (PARTITION BY file, symbol_name ORDER BY coalesce(complexity, 0) DESC, id) AS r FROM ck) WHERE r = 1")
def most_complex(spark, d):
    return R.most_complex(_chunks(spark, d))


_EXTENSIONS = ("ts", "jsx", "php", "py", "rs", "go", "java", "cs", "rb", "kt", "swift", "md")
_LANGUAGE = "CASE e WHEN 'ts' THEN 'typescript' WHEN 'jsx' THEN 'javascript' WHEN 'php' THEN 'php' WHEN 'py' THEN 'python' WHEN 'rs' THEN 'rust' WHEN 'go' THEN 'go' WHEN 'java' THEN 'java' WHEN 'cs' THEN 'csharp' WHEN 'rb' THEN 'ruby' WHEN 'kt' THEN 'kotlin' WHEN 'swift' THEN 'swift' END"
_FILES = f"fl AS (SELECT DISTINCT e, 'd' || p_size || '/F' || p_partkey || '.' || CASE WHEN p_partkey % 2 = 0 THEN upper(e) ELSE e END AS file FROM (SELECT *, {list(_EXTENSIONS)}[p_partkey % 12 + 1] AS e FROM part))"


def _flagged(spark, d):
    k = F.col("p_partkey")
    e = F.element_at(F.array(*(F.lit(x) for x in _EXTENSIONS)), (k % 12 + 1).cast("int"))
    files = table(spark, d, "part").select(F.concat(F.lit("d"), "p_size", F.lit("/F"), k, F.lit("."), F.when(k % 2 == 0, F.upper(e)).otherwise(e)).alias("file"))
    return languages.with_flags(files)


@query("d11_language_flags", f"WITH {_FILES} SELECT file, {_LANGUAGE} AS language, e = 'php' AS namespace_imports, e = 'rb' AS single_file, e = 'swift' AS whole_module, e = 'go' AS same_directory_tests, e = 'java' AS same_package_tests, e = 'cs' AS enclosing_namespaces, e = 'kt' AS same_unit FROM fl")
def language_flags(spark, d):
    return _flagged(spark, d).select("file", "language", "namespace_imports", "single_file", "whole_module", "same_directory_tests", "same_package_tests", "enclosing_namespaces", "same_unit")


@query("d12_blind_spots", f"WITH {_FILES} SELECT file, e IN ('cs', 'java', 'swift', 'kt') AS blind FROM fl")
def blind_spots(spark, d):
    """Files whose dependents need no import of them: their languages bind names by packages, modules or namespaces."""
    return _flagged(spark, d).select("file", "blind")


@query("h8_call_snippets", """WITH x AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l, doc_id % 9 - 2 AS g FROM documents), c AS (SELECT doc_id, l, g, list_filter([g, g - 1, g + 1, g - 2, g + 2, g - 3, g + 3, g - 4, g + 4, g - 5, g + 5], lambda i: i >= 1 AND i <= len(l) AND contains(l[i], 'the')) AS near FROM x),
a AS (SELECT doc_id, l, CASE WHEN len(near) > 0 THEN near[1] WHEN g >= 1 AND g <= len(l) THEN g END AS i FROM c), t AS (SELECT doc_id, list_filter(list_transform([i, i - 1, i - 2, i - 3, i - 4, i - 5, i + 1, i + 2, i + 3, i + 4, i + 5], lambda j: CASE WHEN j >= 1 AND j <= len(l) THEN trim(l[j]) ELSE '' END), lambda s: s <> '') AS said FROM a)
SELECT doc_id, md5(coalesce(said[1], 'the(...)')) AS snippet_md5 FROM t""")
def call_snippets(spark, d):
    s = C.snippet(F.coalesce("text", F.lit("")), F.lit(5), F.col("doc_id") % 9 + 2, F.lit("the"))
    return table(spark, d, "documents").select("doc_id", F.md5(s).alias("snippet_md5"))


@query("h2_normal_signatures", "SELECT p_partkey, 'f(a,b)' || CASE p_partkey % 3 WHEN 2 THEN ': T' ELSE '' END AS signature FROM part")
def normal_signatures(spark, d):
    """Three ways to write one signature, one of them with another result."""
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, "f(a, b)").when(k % 3 == 1, "  f (\n  a ,\n  b,\n)\n").otherwise("f( a,b ): T")
    return table(spark, d, "part").select("p_partkey", C.normal_signature(text).alias("signature"))


@query("h3_clamped_signatures", "WITH s AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS s FROM documents) SELECT doc_id, md5(CASE WHEN length(s) > 200 THEN substr(s, 1, 197) || '...' ELSE s END) AS clamped_md5 FROM s")
def clamped_signatures(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(C.clamped(F.coalesce("text", F.lit("")))).alias("clamped_md5"))


@query("h5_identifier_shapes", "WITH n AS (SELECT p_partkey, ['parseHTTP', 'URL', 'get_name', '_prefix', 'Session', 'count', 'HTTPHeaders', '_CancelID'][p_partkey % 8 + 1] AS name FROM part) SELECT p_partkey, name, name IN ('parseHTTP', 'get_name', 'Session', 'HTTPHeaders', '_CancelID') AS code_shaped, name IN ('parseHTTP', 'get_name', 'HTTPHeaders', '_CancelID') AS several_words, name IN ('HTTPHeaders', '_CancelID') AS type_shaped FROM n")
def identifier_shapes(spark, d):
    names = ("parseHTTP", "URL", "get_name", "_prefix", "Session", "count", "HTTPHeaders", "_CancelID")
    rows = table(spark, d, "part").select("p_partkey", F.element_at(F.array(*(F.lit(n) for n in names)), (F.col("p_partkey") % 8 + 1).cast("int")).alias("name"))
    return rows.select("*", *(f(F.col("name")).alias(f.__name__) for f in (C.code_shaped, C.several_words, C.type_shaped)))


@query("h9_times", "WITH m AS (SELECT o_orderkey, (o_orderkey * 7 % 400)::BIGINT AS m FROM orders) SELECT o_orderkey, CASE WHEN m < 60 THEN m || 'm' WHEN m % 60 = 0 THEN m // 60 || 'h' ELSE m // 60 || 'h ' || m % 60 || 'm' END AS time FROM m")
def times(spark, d):
    return table(spark, d, "orders").select("o_orderkey", C.minutes((F.col("o_orderkey") * 7 % 400).cast("double")).alias("time"))


@query("h6_whole_words", "SELECT doc_id, regexp_matches(text, '(^|[^A-Za-z0-9_])the([^A-Za-z0-9_]|$)') AS the, regexp_matches(text, '(^|[^A-Za-z0-9_])' || lang || '([^A-Za-z0-9_]|$)') AS own FROM documents")
def whole_words(spark, d):
    """A fixed word, and each document's own language code, with no letter, digit or underscore beside them."""
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", C.whole_word(t, F.lit("the")).alias("the"), C.whole_word(t, F.col("lang")).alias("own"))
