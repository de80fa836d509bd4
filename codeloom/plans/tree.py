"""Queries over trees of files, manifests, symbols by pattern, reports and recaps (synthetic bindings)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import commands, symbols
from codeloom.functions import columns as C
from codeloom.operators import claims, metrics, reports, resolve, signals
from codeloom.operators import review as R
from codeloom.plans.registry import query
from codeloom.sources import tree
from codeloom.sources.adapters import FUNCTIONS, functions, table

_PATHS = ("src/m{k}.ts", "node_modules/x/m{k}.js", "pkg/dist/m{k}.py", "docs/m{k}.md", ".hidden/m{k}.py", "src/m{k}.min.js", "a/vendor/m{k}.go", "a/m{k}.txt", "gen/m{k}.ts", "gen/keep/m{k}.ts", "logs/m{k}.yaml", ".github/workflows/m{k}.yml", "tmp/m{k}.rs", "m{k}.lock.py")
_TREE = f"tr AS (SELECT p_partkey AS k, p_partkey % {len(_PATHS)} AS s, replace({list(_PATHS)}[p_partkey % {len(_PATHS)} + 1], '{{k}}', p_partkey::VARCHAR) AS file FROM part)"


def _tree(spark, d):
    k = F.col("p_partkey")
    name = F.element_at(F.array(*(F.lit(p) for p in _PATHS)), (k % len(_PATHS) + 1).cast("int"))
    return table(spark, d, "part").select(k.alias("k"), (k % len(_PATHS)).alias("s"), F.replace(name, F.lit("{k}"), k.cast("string")).alias("file"))


#: An ignore file: a comment, folders, a pattern of names, one that is tied to the root, one that is taken back in vain.
_IGNORE = ("# generated", "gen/", "!gen/keep/m1.ts", "*.lock.py", "/logs", "tmp/**", "!tmp/m12.rs")


@query("a1_scan", f"WITH {_TREE} SELECT file FROM tr WHERE s IN (0, 3, 11) OR (s = 12 AND k = 12) OR (s IN (8, 9, 10, 12, 13, 2, 5, 6) AND k % 4 = 1)")
def scan(spark, d):
    """Included kinds without what is ignored; every fourth file is tracked, and of those the ignored ones come back unless they may
    never be indexed. What an ignored folder holds can't be taken back, one of the files below tmp/** can."""
    files = _tree(spark, d)
    return tree.scan(files, gitignore=_IGNORE, tracked=files.where("k % 4 = 1"))


@query("a3_ignored", f"WITH {_TREE} SELECT file, s IN (8, 9, 10, 13) OR (s = 12 AND k <> 12) AS ignored FROM tr")
def ignored(spark, d):
    return _tree(spark, d).select("file", tree.ignored(F.col("file"), _IGNORE).alias("ignored"))


_MARKERS = ("package.json", "setup.py", "sub/Cargo.toml", "App.xcodeproj", "astro.config.mjs", "bin/rails", "readme.md")


@query("a4_ecosystems", f"WITH m AS (SELECT DISTINCT {list(_MARKERS)}[p_size % 7 + 1] AS file FROM part) SELECT ecosystem, count(*)::BIGINT AS patterns FROM (SELECT CASE file WHEN 'package.json' THEN 'nodejs' WHEN 'setup.py' THEN 'python' WHEN 'App.xcodeproj' THEN 'swift' WHEN 'astro.config.mjs' THEN 'astro' WHEN 'bin/rails' THEN 'rails' END AS ecosystem, unnest(range(CASE file WHEN 'package.json' THEN 28 WHEN 'setup.py' THEN 26 WHEN 'App.xcodeproj' THEN 8 WHEN 'astro.config.mjs' THEN 1 WHEN 'bin/rails' THEN 14 ELSE 0 END)) FROM m) GROUP BY 1")
def ecosystems(spark, d):
    files = table(spark, d, "part").select(F.element_at(F.array(*(F.lit(m) for m in _MARKERS)), (F.col("p_size") % 7 + 1).cast("int")).alias("file"))
    return tree.detect_ecosystems(files).groupBy("ecosystem").agg(F.count("*").alias("patterns"))


@query("a2_rescued_files", "WITH t AS (SELECT 'src/m' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.bin' ELSE '.lock' END AS file, p_partkey FROM part) SELECT file FROM t WHERE p_partkey % 4 <> 0 AND regexp_matches(file, '\\.(py|lock)$') AND NOT regexp_matches(file, '\\.lock$')")
def rescued_files(spark, d):
    k = F.col("p_partkey")
    t = table(spark, d, "part").select(k, F.concat(F.lit("src/m"), k, F.when(k % 3 == 0, ".py").when(k % 3 == 1, ".bin").otherwise(".lock")).alias("file"))
    return R.rescued(t.select("file"), t.where(k % 4 == 0).select("file"), r"\.(py|lock)\z", r"\.lock\z")


_SPECS = (("a/x.php", "App\\\\Models\\\\U"), ("a/x.php", "App\\\\Http\\\\U"), ("c/x.go", "github.com/o/m/pkg/u"), ("c/x.go", "fmt"), ("t/x.py", "pk.mod"), ("t/x.py", "gone.mod"), ("k/X.kt", "com.a.U"), ("k/X.kt", "com.b.U"), ("r/x.rs", "core_lib::eng::U"), ("s/x.ts", "./ui"), ("s/x.ts", "@scope/core"), ("s/x.ts", "react"))
_RESOLVED = ("app/Models/U", "lib/http/U", "pkg/u", "fmt", "src/pk/mod", "gone.mod", "core/src/main/kotlin/com/a/U", "com.b.U", "crates/core/src/eng/U", "s/ui/index", "packages/core/src/index.ts", "react")
_KNOWN = ("lib/http/U.php", "src/pk/mod.py", "core/src/main/kotlin/com/a/U.kt", "s/ui/index.tsx", "core/src/main/java/com/c/V.java", "src/pk/__init__.py")
MANIFESTS = resolve.Manifests(
    psr4={"App\\": ("app/",), "App\\Http\\": ("app/Http/", "lib/http/")}, go_module="github.com/o/m", python_src="src", jvm_roots=("core/src/main/java", "core/src/main/kotlin"), crates={"core_lib": "crates/core/src"}, packages={"@scope/core": "packages/core/src/index.ts"}
)


@query("d10_resolved_imports", f"SELECT p_partkey AS k, {list(r.replace(chr(92) * 2, chr(92)) for r in _RESOLVED)}[p_partkey % 12 + 1] AS resolved FROM part")
def resolved_imports(spark, d):
    """Twelve specifiers of eight languages, resolved once each and met by as many rows as there are parts."""
    rows = [(i, importer, spec.replace("\\\\", "\\")) for i, (importer, spec) in enumerate(_SPECS)]
    specs = spark.createDataFrame(rows, "i int, importer string, specifier string")
    out = resolve.resolve(specs, spark.createDataFrame([(f,) for f in _KNOWN], "file string"), MANIFESTS)
    numbered = specs.join(out, ["importer", "specifier"]).select("i", "resolved")
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") % 12).cast("int").alias("i")).join(numbered, "i").select("k", "resolved")


_SOURCES = {
    "typescript": ("export function load{k}(a) {\n  if (x) { }\n}\nconst go{k} = async (b) => 1\nexport abstract class K{k} {\n  run{k}(c): void { }\n}\ninterface I{k} { }\ntype T{k} = number\n", "load{k},go{k},run{k}", "K{k}", "I{k},T{k}"),
    "py": ("class K{k}(Base):\n    def m{k}(self):\n        pass\nasync def g{k}():\n    pass\n", "m{k},g{k}", "K{k}", ""),
    "go": ("func (s *S) M{k}(a int) {}\nfunc F{k}() {}\ntype I{k} interface {}\ntype S{k} struct {}\n", "M{k},F{k}", "", "I{k},S{k}"),
    "swift": ("final class K{k} {\n  class func f{k}() {}\n  init() {}\n}\nprotocol P{k} {}\n", "f{k},init", "K{k}", "P{k}"),
    "vue": ("<script>\nexport default defineComponent({ name: 'V{k}' })\n</script>", "", "V{k},VueComponent", ""),
    "cobol": ("PERFORM K{k}", "", "", ""),
}
_LANGS = list(_SOURCES)


def _pick(i: int) -> str:
    return "[" + ", ".join("'" + _SOURCES[x][i].replace("'", "''") + "'" for x in _LANGS) + "][p_partkey % 6 + 1]"


@query("m12_symbols", f"SELECT p_partkey AS k, {_LANGS}[p_partkey % 6 + 1] AS language, " + ", ".join(f"replace({_pick(i)}, '{{k}}', p_partkey::VARCHAR) AS {n}" for i, n in ((1, 'functions'), (2, 'classes'), (3, 'interfaces'))) + " FROM part")
def symbols_by_pattern(spark, d):
    k = F.col("p_partkey")
    at = (k % 6 + 1).cast("int")
    text = F.replace(F.element_at(F.array(*(F.lit(_SOURCES[x][0]) for x in _LANGS)), at), F.lit("{k}"), k.cast("string"))
    rows = table(spark, d, "part").select(k.alias("k"), F.element_at(F.array(*(F.lit(x) for x in _LANGS)), at).alias("language"), text.alias("content"))
    rows = rows.withColumn("s", symbols.symbols(F.col("content"), F.col("language")))
    return rows.select("k", "language", *(F.array_join(f"s.{n}", ",").alias(n) for n in ("functions", "classes", "interfaces")))


_COMMANDS = (("npm test", True, True, ""), ("npx vitest run src/m{k}.test.ts", True, False, "src/m{k}.test.ts"), ("pytest -k name{k}", True, False, ""), ("CI=1 uv run --group dev pytest tests/m{k}.py -q", True, False, "tests/m{k}.py"), ("go test ./...", True, True, ""), ("cargo test name{k}", True, False, ""),
             ("cargo test -p crate{k}", True, True, ""), ("echo hi && ./gradlew clean test", True, True, ""), ("./gradlew build -x test", False, False, ""), ("git commit -m m{k}", False, False, ""), ("jest a{k}.ts && pytest", True, True, ""))


@query("h18_test_commands", f"SELECT c.k, {[c[1] for c in _COMMANDS]}[c.k % 11 + 1] AS is_test_run, {[c[2] for c in _COMMANDS]}[c.k % 11 + 1] AS broad, replace({[c[3] for c in _COMMANDS]}[c.k % 11 + 1], '{{k}}', c.k::VARCHAR) AS scopes FROM (SELECT conv_id * 100 + turn AS k FROM conversations) c")
def test_commands(spark, d):
    k = (F.col("conv_id") * 100 + F.col("turn")).alias("k")
    rows = table(spark, d, "conversations").select(k).withColumn("c", F.element_at(F.array(*(F.lit(c[0]) for c in _COMMANDS)), (F.col("k") % 11 + 1).cast("int")))
    rows = rows.withColumn("r", commands.test_command(F.replace("c", F.lit("{k}"), F.col("k").cast("string"))))
    return rows.select("k", "r.is_test_run", "r.broad", F.array_join("r.scopes", " ").alias("scopes"))


_LIMITS = {"cyclomatic": 20.0, "cognitive": 15.0, "effort": 60_000.0, "bugs": 0.04}
_V = f"""WITH {FUNCTIONS}, u AS (SELECT file, symbol, start_line, unnest([{{'m': 'cyclomatic', 'v': cyclomatic::DOUBLE, 't': 20.0::DOUBLE}}, {{'m': 'cognitive', 'v': cognitive::DOUBLE, 't': 15.0::DOUBLE}}, {{'m': 'effort', 'v': effort, 't': 60000.0::DOUBLE}}, {{'m': 'bugs', 'v': bugs, 't': 0.04::DOUBLE}}]) AS x FROM functions),
v AS (SELECT file, symbol, start_line, x.m AS metric, x.v AS value, x.t AS threshold, CASE WHEN x.v >= 2 * x.t THEN 'error' ELSE 'warning' END AS severity FROM u WHERE x.v >= x.t) """


def _violations(spark, d):
    v = metrics.violations(functions(spark, d), _LIMITS)
    return v.withColumn("threshold", F.element_at(F.create_map(*(F.lit(x) for kv in _LIMITS.items() for x in kv)), F.col("metric"))).withColumn("end_line", F.col("start_line") + 9)


@query("a18_sarif_results", _V + """SELECT '{"ruleId":"codeloom/high-' || CASE metric WHEN 'cyclomatic' THEN 'cyclomatic-complexity' WHEN 'cognitive' THEN 'cognitive-complexity' WHEN 'effort' THEN 'halstead-effort' ELSE 'estimated-bugs' END || '","level":"' || severity || '","message":{"text":"' || symbol || ': ' ||
CASE metric WHEN 'cyclomatic' THEN 'Too many test paths' WHEN 'cognitive' THEN 'High mental load' WHEN 'effort' THEN 'Long time to understand' ELSE 'High estimated bug count' END || '"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"' || file || '"},"region":{"startLine":' || start_line || ',"endLine":' || (start_line + 9) || '}}}]}' AS result FROM v""")
def sarif_results(spark, d):
    return reports.sarif_results(_violations(spark, d)).select("result")


_MIN = "CASE WHEN m < 60 THEN m || 'm' WHEN m % 60 = 0 THEN m // 60 || 'h' ELSE m // 60 || 'h ' || m % 60 || 'm' END"


@query("a18_text_lines", _V + f""", w AS (SELECT *, floor(value / 1080 + 0.5)::BIGINT AS m FROM v) SELECT file || ':' || start_line || ' - ' || symbol || '() ' || CASE metric WHEN 'cyclomatic' THEN 'Test paths' WHEN 'cognitive' THEN 'Mental load' WHEN 'effort' THEN 'Time to understand' ELSE 'Estimated bugs' END || ': ' ||
CASE metric WHEN 'effort' THEN '~' || {_MIN} WHEN 'bugs' THEN printf('%.2f', value) WHEN 'cyclomatic' THEN value::BIGINT || ' (needs ~' || value::BIGINT || ' tests)' ELSE value::BIGINT::VARCHAR END || ' (threshold: ' || CASE metric WHEN 'effort' THEN '56m' WHEN 'bugs' THEN '0.0' ELSE threshold::BIGINT::VARCHAR END || '), ' || floor((value - threshold) / threshold * 100 + 0.5)::BIGINT || '% over threshold' AS line FROM w""")
def text_lines(spark, d):
    return reports.text_lines(_violations(spark, d)).select("line")


@query("g11_report_files", _V + """, r AS (SELECT file, count(*) FILTER (WHERE severity = 'error')::BIGINT AS errors, count(*)::BIGINT AS violations FROM v WHERE metric = 'effort' GROUP BY file), c AS (SELECT file, floor(avg(cyclomatic) * 10 + 0.5) / 10 AS avg, max(cyclomatic) AS max FROM functions WHERE cyclomatic > 0 GROUP BY file),
dp AS (SELECT DISTINCT a.file, b.file AS importer FROM (SELECT DISTINCT file, orderkey FROM functions) a JOIN (SELECT DISTINCT file, orderkey FROM functions) b ON b.orderkey = a.orderkey + 7 WHERE a.file <> b.file), ts AS (SELECT DISTINCT file, 't' || orderkey % 3 AS test FROM functions WHERE orderkey % 5 = 0),
d AS (SELECT dp.file, count(*)::BIGINT AS dependents, floor(avg(c.avg) * 10 + 0.5) / 10 AS dependent_avg, max(c.max) AS dependent_max FROM dp LEFT JOIN c ON c.file = dp.importer GROUP BY 1), t AS (SELECT file, count(DISTINCT test)::BIGINT AS tests FROM ts GROUP BY 1),
j AS (SELECT r.*, coalesce(dependents, 0) AS dependents, dependent_avg, dependent_max, coalesce(tests, 0) AS tests FROM r LEFT JOIN d USING (file) LEFT JOIN t USING (file))
SELECT file, errors, violations, ['low', 'medium', 'high', 'critical'][greatest(CASE WHEN errors >= 3 THEN 4 WHEN errors > 0 THEN 3 WHEN violations >= 3 THEN 2 ELSE 1 END, CASE WHEN dependents <= 5 THEN 1 WHEN dependents <= 15 THEN 2 WHEN dependents <= 30 THEN 3 ELSE 4 END,
  CASE WHEN dependent_avg > 15 OR dependent_max > 25 THEN 4 WHEN dependent_avg > 10 OR dependent_max > 20 THEN 3 WHEN dependent_avg > 6 OR dependent_max > 15 THEN 2 ELSE 1 END)] AS risk, dependents, dependent_avg, dependent_max, tests FROM j""")
def report_files(spark, d):
    """Files with an effort violation; a file depends on that of the order seven before."""
    f = functions(spark, d)
    own = f.select("file", "orderkey").distinct()
    deps = own.join(own.select(F.col("file").alias("importer"), (F.col("orderkey") - 7).alias("orderkey")), "orderkey").where("file <> importer").select("file", "importer").distinct()
    tests = f.where("orderkey % 5 = 0").select("file", F.concat(F.lit("t"), F.col("orderkey") % 3).alias("test"))
    return reports.report_files(_violations(spark, d).where("metric = 'effort'"), deps, metrics.file_complexity(f), tests)


_DELTAS = "dl AS (SELECT l_suppkey % 60 AS change, 'f' || l_partkey % 90 AS file, 's' || l_orderkey AS symbol, 'm' || l_linenumber AS metric, ['error', 'warning', 'new', 'improved', 'deleted'][l_partkey % 5 + 1] AS severity, (floor(l_quantity) - 25)::INT AS delta FROM (SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2, 3, 4))"


@query("f7_ordered_deltas", f"WITH {_DELTAS} SELECT change, file, symbol, metric, place FROM (SELECT *, row_number() OVER (PARTITION BY change ORDER BY list_position(['error', 'warning', 'new', 'improved', 'deleted'], severity), delta DESC, file, symbol, metric)::INT AS place FROM dl) WHERE place <= 40")
def ordered_deltas(spark, d):
    """The first forty deltas of each change."""
    li = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    level = F.element_at(F.array(*(F.lit(x) for x in reports.SEVERITY_ORDER)), (F.col("l_partkey") % 5 + 1).cast("int"))
    rows = li.select((F.col("l_suppkey") % 60).alias("change"), F.concat(F.lit("f"), F.col("l_partkey") % 90).alias("file"), F.concat(F.lit("s"), "l_orderkey").alias("symbol"), F.concat(F.lit("m"), "l_linenumber").alias("metric"), level.alias("severity"), (F.floor("q") - 25).cast("int").alias("delta"))
    return reports.by_severity(rows).where("place <= 40").select("change", "file", "symbol", "metric", "place")


_CTX = """rp AS (SELECT 'f' || p_partkey AS file, ['low', 'high', 'critical'][p_size % 3 + 1] AS risk, (p_size % 11)::BIGINT AS dependents FROM part WHERE p_partkey <= 400), vi AS (SELECT 'f' || p_partkey AS file, 's' || p_partkey % 13 AS symbol FROM part WHERE p_partkey <= 400),
dp AS (SELECT DISTINCT 'f' || l_partkey AS file, 'c' || l_suppkey % 50 AS importer FROM lineitem WHERE l_partkey <= 400), ca AS (SELECT DISTINCT 'c' || l_suppkey % 50 AS file, l_orderkey AS id, 's' || l_partkey % 13 AS symbol, l_linenumber + 2 AS line FROM lineitem),
ch AS (SELECT o_orderkey AS id, 1 AS start_line, 8 AS end_line, (o_custkey % 17)::INT AS complexity FROM orders)"""


@query("n14_dependent_context", f"""WITH {_CTX}, top AS (SELECT rp.file, vi.symbol, dependents * CASE risk WHEN 'critical' THEN 4 ELSE 3 END AS impact FROM rp JOIN vi USING (file) WHERE risk <> 'low' AND dependents > 0 ORDER BY impact DESC, rp.file, symbol LIMIT 3),
x AS (SELECT top.*, ca.file AS caller, ca.id, ca.line, ch.complexity, row_number() OVER (PARTITION BY top.file, top.symbol, ca.file ORDER BY ca.id, ca.line) AS one FROM top JOIN dp USING (file) JOIN ca ON ca.file = dp.importer AND ca.symbol = top.symbol JOIN ch ON ch.id = ca.id WHERE ca.line BETWEEN 1 AND 8),
y AS (SELECT *, row_number() OVER (PARTITION BY file, symbol ORDER BY complexity DESC, caller) AS place FROM x WHERE one = 1) SELECT file, symbol, impact, caller, line, complexity, array_to_string(list_transform(range(greatest(1, line - 2), least(8, line + 2) + 1), lambda i: 'line ' || i || ' of ' || id), chr(10)) AS snippet FROM y WHERE place <= 3""")
def dependent_context(spark, d):
    part, li = table(spark, d, "part").where("p_partkey <= 400"), table(spark, d, "lineitem")
    s = lambda p, c: F.concat(F.lit(p), c)
    level = F.element_at(F.array(F.lit("low"), F.lit("high"), F.lit("critical")), (F.col("p_size") % 3 + 1).cast("int"))
    report = part.select(s("f", F.col("p_partkey")).alias("file"), level.alias("risk"), (F.col("p_size") % 11).cast("long").alias("dependents"))
    found = part.select(s("f", F.col("p_partkey")).alias("file"), s("s", F.col("p_partkey") % 13).alias("symbol"))
    deps = li.where("l_partkey <= 400").select(s("f", F.col("l_partkey")).alias("file"), s("c", F.col("l_suppkey") % 50).alias("importer")).distinct()
    calls = li.select(s("c", F.col("l_suppkey") % 50).alias("file"), F.col("l_orderkey").alias("id"), s("s", F.col("l_partkey") % 13).alias("symbol"), (F.col("l_linenumber") + 2).alias("line")).distinct()
    content = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.concat(F.lit("line "), i, F.lit(" of "), "o_orderkey")), "\n")
    chunks = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit(1).alias("start_line"), F.lit(8).alias("end_line"), content.alias("content"), (F.col("o_custkey") % 17).cast("int").alias("complexity"))
    return reports.dependent_context(report, found, deps, calls, chunks)


_DOCS = ("# Uses load{k} here", "plain words of load{k}", "It defaults to load{k} here.", "```\n# load{k} fenced\n```", "- load{k} was removed", "- see [x](http://a/load{k}) only", "- load{k}-more is another", "load{k} is required")


@query("n10_docs_drift", f"""WITH x AS (SELECT p_partkey AS k, p_partkey % 8 AS s, CASE WHEN p_size % 10 = 0 THEN 'CHANGELOG.md' ELSE 'docs/d' || p_partkey || '.md' END AS file FROM part WHERE p_partkey % 9 > 0), h AS (SELECT 'load' || k AS referand, 'removed-export' AS kind, file, 1::BIGINT AS line, CASE WHEN s IN (2, 7) THEN 'behavioral-claim' ELSE 'structural-mention' END AS tier FROM x WHERE s IN (0, 2, 7) AND file <> 'CHANGELOG.md')
SELECT *, row_number() OVER (ORDER BY tier <> 'behavioral-claim', referand, file, line)::INT AS place FROM (SELECT * FROM h ORDER BY tier <> 'behavioral-claim', referand, file, line LIMIT 15)""")
def docs_drift(spark, d):
    """A removed name in headings, prose, claims, fences, histories, links and longer names; a ninth of the files are changed ones."""
    k, at = F.col("p_partkey"), (F.col("p_partkey") % 8 + 1).cast("int")
    text = F.replace(F.element_at(F.array(*(F.lit(x) for x in _DOCS)), at), F.lit("{k}"), k.cast("string"))
    docs = table(spark, d, "part").select(k.alias("id"), F.when(F.col("p_size") % 10 == 0, "CHANGELOG.md").otherwise(F.concat(F.lit("docs/d"), k, F.lit(".md"))).alias("file"), F.lit(1).cast("long").alias("start_line"), text.alias("content"))
    gone = table(spark, d, "part").where("p_partkey % 9 > 0").select(F.concat(F.lit("load"), k).alias("referand"), F.lit("removed-export").alias("kind"))
    out = signals.docs_drift(gone, docs, table(spark, d, "part").where("p_partkey % 9 = 0").select(F.concat(F.lit("docs/d"), k, F.lit(".md")).alias("file")))
    return out.select("referand", "kind", "file", F.col("line").cast("long").alias("line"), "tier", "place")


@query("n11_guidance_surfaces", """WITH p AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'docs/a' || o_orderkey || '.md' WHEN 1 THEN 'pkg' || o_orderkey || '/CLAUDE.md' WHEN 2 THEN 'src/a' || o_orderkey || '.md' ELSE 'docs/a' || o_orderkey || '.txt' END AS file, (o_orderkey * 37 % 5000)::INT AS n FROM orders WHERE o_orderkey <= 200),
g AS (SELECT file, n, row_number() OVER (ORDER BY n, file) AS r FROM p WHERE ends_with(file, '.md') AND NOT starts_with(file, 'src/')), u AS (SELECT *, coalesce(sum(least(n, 3000) + length(file) + 64) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM g),
m AS (SELECT *, least(3000, 12000 - used - length(file) - 64) AS room FROM u) SELECT file, (CASE WHEN room > 0 THEN least(n, room) ELSE 0 END)::BIGINT AS shown, (n - CASE WHEN room > 0 THEN least(n, room) ELSE 0 END)::BIGINT AS cut, room <= 0 AS omitted FROM m""")
def guidance_surfaces(spark, d):
    k = F.col("o_orderkey")
    file = F.when(k % 4 == 0, F.concat(F.lit("docs/a"), k, F.lit(".md"))).when(k % 4 == 1, F.concat(F.lit("pkg"), k, F.lit("/CLAUDE.md"))).when(k % 4 == 2, F.concat(F.lit("src/a"), k, F.lit(".md"))).otherwise(F.concat(F.lit("docs/a"), k, F.lit(".txt")))
    return signals.guidance_changes(table(spark, d, "orders").where(k <= 200).select(file.alias("file"), F.repeat(F.lit("x"), (k * 37 % 5000).cast("int")).alias("patch")))


_CATCHES = ("try {\n  a()\n} catch (e) {\n  return fallback{k}\n}\n", "try { a() } catch (err) { if (err.status === 404) return 1\n return 2 }\n", "try { a() } catch (e) { console.error(e) }\n", "try { a() } catch (e) { log.warn('}'); throw e }\n", "try { a() } catch { return 1 }\n", "// catch (e) { return 1 }\nx = 'catch (e) {'\n", "try { a() } catch (e: unknown) {\n  recover{k}(e)\n}\n")


@query("n8_catches", "SELECT 'src/m' || p_partkey || CASE WHEN p_size % 5 = 0 THEN '.py' ELSE '.ts' END AS file, CASE p_partkey % 7 WHEN 0 THEN 12 ELSE 10 END AS line, CASE p_partkey % 7 WHEN 0 THEN 14 ELSE 12 END AS end_line FROM part WHERE p_partkey % 7 IN (0, 6) AND p_size % 5 > 0 AND (p_partkey % 3 > 0)")
def catches(spark, d):
    """Catch clauses of seven kinds, two of them indiscriminate; two thirds of the files have a changed line in theirs."""
    k = F.col("p_partkey")
    text = F.replace(F.element_at(F.array(*(F.lit(x) for x in _CATCHES)), (k % 7 + 1).cast("int")), F.lit("{k}"), k.cast("string"))
    file = F.concat(F.lit("src/m"), k, F.when(F.col("p_size") % 5 == 0, ".py").otherwise(".ts"))
    chunks = table(spark, d, "part").select(k, file.alias("file"), F.lit(10).alias("start_line"), text.alias("content"))
    touched = chunks.select("file", F.when(k % 3 > 0, 12).otherwise(99).alias("line"))
    return signals.undiscriminated_catches(chunks, touched).select("file", "line", "end_line")


_SESSIONS = "se AS (SELECT user_id AS session, ts, event_type, value FROM events)"


@query("o10_recap", f"""WITH {_SESSIONS}, t AS (SELECT session, count(*)::BIGINT AS tests FROM se WHERE event_type = 'click' AND value > 90 GROUP BY 1), r AS (SELECT session, count(*)::BIGINT AS regressions FROM se WHERE event_type = 'purchase' AND value > 80 GROUP BY 1), b AS (SELECT session, count(*)::BIGINT AS blasts FROM se WHERE event_type = 'signup' AND value > 95 GROUP BY 1),
l AS (SELECT session, max(ts) AS at FROM se WHERE event_type = 'error' GROUP BY 1), k AS (SELECT session FROM t UNION SELECT session FROM r UNION SELECT session FROM b)
SELECT session, coalesce(tests, 0) AS tests, coalesce(regressions, 0) AS regressions, coalesce(blasts, 0) AS blasts, coalesce(l.at >= (SELECT max(ts) FROM events) - INTERVAL 10 HOUR, false) AS suppressed FROM k LEFT JOIN t USING (session) LEFT JOIN r USING (session) LEFT JOIN b USING (session) LEFT JOIN l USING (session)""")
def recap(spark, d):
    e = table(spark, d, "events").withColumnRenamed("user_id", "session")
    now = F.lit(e.agg(F.max("ts")).first()[0]).cast("timestamp_ntz")
    kind = lambda t: e.where(F.col("event_type") == t)
    deltas = kind("purchase").withColumn("verdict", F.when(F.col("value") > 80, "crossed").otherwise("improved"))
    return reports.recap(kind("click").where("value > 90"), deltas, kind("signup").where("value > 95"), kind("error"), now, quiet_minutes=600)


@query("o7_run_stats", "WITH r AS (SELECT event_id, (value > 60)::INT + (value > 90)::INT AS crossings, event_type = 'view' AS soft FROM events) SELECT count(*)::BIGINT AS runs, count(*) FILTER (WHERE crossings > 0)::BIGINT AS crossing_runs, round(count(*) FILTER (WHERE crossings > 0 AND soft) / count(*) FILTER (WHERE crossings > 0)::DOUBLE, 6) AS soft_share FROM r")
def run_stats(spark, d):
    from codeloom.operators import events

    v = F.col("value")
    return events.run_stats(table(spark, d, "events").select(((v > 60).cast("int") + (v > 90).cast("int")).alias("crossings"), (F.col("event_type") == "view").alias("soft")))


@query("o11_failing_changes", f"WITH {FUNCTIONS}, x AS (SELECT orderkey % 50 AS change, cyclomatic AS b, cognitive AS a FROM functions) SELECT change, bool_or(b < 15 AND a >= 15) AS fails FROM x GROUP BY change")
def failing_changes(spark, d):
    """Of each change, whether its exit code is 1: some function crossed the threshold."""
    rows = functions(spark, d).withColumn("verdict", metrics.verdict(F.col("cyclomatic"), F.col("cognitive"), 15))
    return rows.groupBy((F.col("orderkey") % 50).alias("change")).agg(F.bool_or(F.col("verdict").isin(*metrics.FAILING)).alias("fails"))


@query("h10_content_hashes", "SELECT doc_id, CASE WHEN strlen(coalesce(text, '')) > 1048576 THEN 'L' ELSE substr(sha256(coalesce(text, '')), 1, 16) END AS hash FROM documents WHERE strlen(coalesce(text, '')) <= 1048576")
def content_hashes(spark, d):
    docs = table(spark, d, "documents").withColumn("content", F.coalesce("text", F.lit("")))
    return docs.where(F.octet_length("content") <= C.LARGE).select("doc_id", C.content_hash(F.col("content")).alias("hash"))


_SAYINGS = ("Search is keyword-based and calls findAll{k}.", "`load{k}` defaults to 5.", "Plain words.", "| it requires tab_{k} |", "```\nrequires fenced_{k}\n```", "It requires [cfg_key{k}](http://x).")


def _claim_lines(spark, d):
    """Added lines of a guidance file for each part, a removed one before them."""
    k = F.col("p_partkey")
    text = F.replace(F.element_at(F.array(*(F.lit(x) for x in _SAYINGS)), (k % 6 + 1).cast("int")), F.lit("{k}"), k.cast("string"))
    patch = F.concat(F.lit("@@ -1 +4 @@\n-It requires old.\n+"), F.replace(text, F.lit("\n"), F.lit("\n+")))
    return signals.diff_lines(table(spark, d, "part").select(F.concat(F.lit("docs/d"), k, F.lit(".md")).alias("file"), patch.alias("patch")))


_CLAIMS = "cl AS (SELECT p_partkey AS k, 'docs/d' || p_partkey || '.md' AS file, 4 AS line, CASE p_partkey % 6 WHEN 0 THEN 'Search is keyword-based and calls findAll' || p_partkey || '.' WHEN 1 THEN '`load' || p_partkey || '` defaults to 5.' ELSE 'It requires cfg_key' || p_partkey || '.' END AS claim FROM part WHERE p_partkey % 6 IN (0, 1, 5))"


@query("n9_doc_claims", f"WITH {_CLAIMS} SELECT file, line, md5(claim) AS claim_md5 FROM cl")
def doc_claims(spark, d):
    out = claims.added_claims(_claim_lines(spark, d))
    return out.select("file", F.col("line").cast("int").alias("line"), F.md5("claim").alias("claim_md5"))


@query("n9_claim_evidence", f"""WITH {_CLAIMS}, v AS (SELECT k, file, line, ['findAll', 'load', '', '', '', 'cfg_key'][k % 6 + 1] || k AS name FROM cl), c AS (SELECT p_partkey AS k, p_partkey * 2 + b AS id, CASE WHEN b = 0 THEN CASE p_size % 4 WHEN 0 THEN 'src/a' || p_partkey || '.test.ts' WHEN 1 THEN 'src/a' || p_partkey || '.ts' WHEN 2 THEN 'notes/a' || p_partkey || '.md' ELSE 'src/c' || p_partkey || '.ts' END ELSE 'lib/b' || p_partkey || '.ts' END AS file, b, p_size % 3 = 0 AS sym FROM part, range(2) r(b)),
t AS (SELECT v.file, v.line, c.id, c.file AS evidence_file, CASE WHEN contains(c.file, '.test.') THEN 0 WHEN b = 1 AND sym THEN 5 WHEN starts_with(c.file, 'src/c') THEN 4 WHEN ends_with(c.file, '.md') THEN 1 ELSE 2 END AS tier FROM v JOIN c USING (k))
SELECT file, line, id, evidence_file, ['test', 'doc', 'code', 'changed-doc', 'changed-code', 'symbol-match', 'same-file'][tier + 1] AS tier FROM (SELECT *, row_number() OVER (PARTITION BY file, line ORDER BY tier DESC, id) AS n FROM t) WHERE n = 1""")
def claim_evidence(spark, d):
    """Two chunks name what each claim names: a test, code, a note or a changed file, and library code that may declare it."""
    k, size = F.col("p_partkey"), F.col("p_size")
    name = F.concat(F.element_at(F.array(*(F.lit(x) for x in ("findAll", "load", "none", "tab_", "fenced_", "cfg_key"))), (k % 6 + 1).cast("int")), k)
    first = F.when(size % 4 == 0, F.concat(F.lit("src/a"), k, F.lit(".test.ts"))).when(size % 4 == 1, F.concat(F.lit("src/a"), k, F.lit(".ts"))).when(size % 4 == 2, F.concat(F.lit("notes/a"), k, F.lit(".md"))).otherwise(F.concat(F.lit("src/c"), k, F.lit(".ts")))
    part = table(spark, d, "part")
    a = part.select((k * 2).alias("id"), first.alias("file"), F.concat(F.lit("uses "), name, F.lit("()")).alias("content"), F.lit("").alias("symbol_name"))
    b = part.select((k * 2 + 1).alias("id"), F.concat(F.lit("lib/b"), k, F.lit(".ts")).alias("file"), F.concat(F.lit("def "), name).alias("content"), F.when(size % 3 == 0, name).otherwise("x").alias("symbol_name"))
    out = claims.evidence(claims.added_claims(_claim_lines(spark, d)), a.unionByName(b), a.where("file like 'src/c%'").select("file"))
    return out.select("file", F.col("line").cast("int").alias("line"), "id", "evidence_file", "tier")


_FAMILY = "export enum Kind{k} {\n  A = 1,\n  B, // old\n  'C c',\n  New,\n}\ntype U{k} = 'x{k}' | 'y{k}' |\n  'z{k}';\n"
_USES = "switch (v) {\n  case Kind{k}.A: return 1\n  case Kind{k}.B: return 2\n}\n"
_USES_ALL = "if (v === Kind{k}.A) a(); if (Kind{k}.B == v) b()\nconst m = { [Kind{k}.New]: 3 }\n"
_USES_UNION = "const t = {\n  'x{k}': 1,\n  y{k}: 2,\n}\n// case 'z{k}':\n"


@query("n4_variant_sweep", """WITH b AS (SELECT p_partkey AS k FROM part), c AS (SELECT k, 'Kind' || k AS type, 'New' AS variant, 'enum' AS kind, 'src/use' || k || '.ts' AS consumer, 2 AS line, 'A,B' AS handled FROM b UNION ALL SELECT k, 'U' || k, 'z' || k, 'union', 'src/map' || k || '.ts', 2, 'x' || k || ',y' || k FROM b)
SELECT type, variant, kind, 'src/kinds' || k || '.ts' AS file, consumer, line, handled, row_number() OVER (ORDER BY type, variant)::INT AS place FROM (SELECT * FROM c ORDER BY type, variant LIMIT 12)""")
def variant_sweep(spark, d):
    """An enum and a union gain a member each; one of their three consumers knows it, a comment doesn't help the other."""
    k = F.col("p_partkey").cast("string")
    text = lambda x: F.replace(F.lit(x), F.lit("{k}"), k)
    part = table(spark, d, "part")
    file = F.concat(F.lit("src/kinds"), k, F.lit(".ts"))
    patch = text("@@ -1,7 +1,8 @@\n export enum Kind{k} {\n   A = 1,\n   B, // old\n   'C c',\n+  New,\n }\n type U{k} = 'x{k}' | 'y{k}' |\n+  'z{k}';")
    lines = signals.diff_lines(part.select(file.alias("file"), patch.alias("patch")))
    chunks = None
    for i, (name, body) in enumerate((("kinds", _FAMILY), ("use", _USES), ("all", _USES_ALL), ("map", _USES_UNION))):
        one = part.select((F.col("p_partkey") * 4 + i).alias("id"), F.concat(F.lit(f"src/{name}"), k, F.lit(".ts")).alias("file"), F.lit(1).alias("start_line"), F.lit(body.count("\n")).alias("end_line"), text(body).alias("content"))
        chunks = one if chunks is None else chunks.unionByName(one)
    found = claims.added_variants(claims.family_members(chunks.where("file like 'src/kinds%'")), lines)
    return claims.variant_consumers(found, chunks)


_TYPE = "export interface Opts{k} {\n  old{k}: number;\n  used{k}?: string;\n  lost{k}: Map<string, number>;\n}\nexport class Box{k} {\n  kept{k}: boolean;\n}\n"
_READER = "const a = o.used{k} + 1\no.lost{k} = new Map()\nconst { kept{k} } = box\n"


@query("n5_unread_fields", "SELECT 'Opts' || p_partkey AS type, 'lost' || p_partkey AS field, 'interface' AS kind, 'src/o' || p_partkey || '.ts' AS file, 4 AS line, row_number() OVER (ORDER BY 'src/o' || p_partkey || '.ts')::INT AS place FROM part WHERE p_size % 4 > 0 ORDER BY 'src/o' || p_partkey || '.ts' LIMIT 10")
def unread_fields(spark, d):
    """Three fields are added to each file's types: one is read, one only assigned, one taken apart; a quarter of the types is spread."""
    k = F.col("p_partkey").cast("string")
    text = lambda x: F.replace(F.lit(x), F.lit("{k}"), k)
    part = table(spark, d, "part")
    file = F.concat(F.lit("src/o"), k, F.lit(".ts"))
    patch = text("@@ -1,5 +1,8 @@\n export interface Opts{k} {\n   old{k}: number;\n+  used{k}?: string;\n+  lost{k}: Map<string, number>;\n }\n export class Box{k} {\n+  kept{k}: boolean;\n }")
    own = part.select(file.alias("file"), F.lit(1).alias("start_line"), text(_TYPE).alias("content"))
    use = part.select(F.concat(F.lit("src/r"), k, F.lit(".ts")).alias("file"), F.lit(1).alias("start_line"), F.concat(text(_READER), F.when(F.col("p_size") % 4 == 0, text("const b: Opts{k} = { ...o }\n")).otherwise("")).alias("content"))
    return claims.unread_fields(own, signals.diff_lines(part.select(file.alias("file"), patch.alias("patch"))), own.unionByName(use))
