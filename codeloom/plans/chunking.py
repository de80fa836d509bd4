"""Chunking queries whose rows SQL can't express."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.chunkers.files import chunk_files
from codeloom.plans.registry import query
from codeloom.sources.adapters import table
from codeloom.streaming.changes import session_activity


_BASIS = "SELECT p_partkey AS k, p_size AS n FROM part"


def _files(spark, d, name, text):
    k = F.col("p_partkey").cast("string")
    return table(spark, d, "part").select(F.replace(F.lit(name), F.lit("{k}"), k).alias("file"), F.replace(text if not isinstance(text, str) else F.lit(text), F.lit("{k}"), k).alias("content"))


@query("m1_dispatch", f"WITH b AS ({_BASIS}) SELECT CASE k % 6 WHEN 0 THEN 'a/m' || k || '.md' WHEN 1 THEN 'a/m' || k || '.yaml' WHEN 2 THEN 'templates/m' || k || '.json' WHEN 3 THEN 'a/m' || k || '.liquid' WHEN 4 THEN 'a/m' || k || '.py' ELSE 'a/m' || k || '.txt' END AS file, ['doc', 'config', 'template', 'template', 'function', 'block'][k % 6 + 1] AS type FROM b")
def dispatch(spark, d):
    """One file of each kind: what its chunk is follows from its name."""
    k = F.col("p_partkey")
    name = F.when(k % 6 == 0, F.concat(F.lit("a/m"), k, F.lit(".md"))).when(k % 6 == 1, F.concat(F.lit("a/m"), k, F.lit(".yaml"))).when(k % 6 == 2, F.concat(F.lit("templates/m"), k, F.lit(".json"))).when(k % 6 == 3, F.concat(F.lit("a/m"), k, F.lit(".liquid"))).when(k % 6 == 4, F.concat(F.lit("a/m"), k, F.lit(".py"))).otherwise(F.concat(F.lit("a/m"), k, F.lit(".txt")))
    text = F.element_at(F.array(F.lit("# A"), F.lit("a: 1"), F.lit('{"sections": {}}'), F.lit("{{ x }}"), F.lit("def f(): pass"), F.lit("x")), (k % 6 + 1).cast("int"))
    return chunk_files(table(spark, d, "part").select(name.alias("file"), text.alias("content"))).select("file", "type")


#: A preface, a fence that hides a heading, nested headings, and as many lines at the end as the part's size.
_MD = "intro\n# A{k}\nbody\n```\n# none\n```\n## B\nmore\n### C\nx\n# D\n"


@query("m3_markdown_chunks", f"WITH b AS ({_BASIS}), s AS (SELECT k, n, unnest([{{'a': 1, 'b': 1, 's': NULL}}, {{'a': 2, 'b': 6, 's': 'A' || k}}, {{'a': 7, 'b': 8, 's': 'A' || k || ' > B'}}, {{'a': 9, 'b': 10, 's': 'A' || k || ' > B > C'}}]) AS c FROM b), w AS (SELECT k, n, unnest(range(CASE WHEN n * 6 + 1 > 225 THEN ceil((n * 6 + 1 - 75) / 65.0)::INT + 1 ELSE 1 END)) AS i FROM b) SELECT 'docs/m' || k || '.md' AS file, c.a::INT AS start_line, c.b::INT AS end_line, c.s AS symbol_name FROM s UNION ALL SELECT 'docs/m' || k || '.md', (11 + i * 65)::INT, CASE WHEN n * 6 + 1 > 225 THEN least(11 + i * 65 + 74, n * 6 + 11) ELSE n * 6 + 11 END::INT, 'D' FROM w")
def markdown_chunks(spark, d):
    """Sections with the path of their headings; the last one has six lines for each unit of the part's size and is cut into windows
    above 225."""
    text = F.concat(F.lit(_MD), F.array_join(F.transform(F.sequence(F.lit(1), F.col("p_size") * 6), lambda i: F.concat(F.lit("line "), i)), "\n"))
    return chunk_files(_files(spark, d, "docs/m{k}.md", text)).select("file", "start_line", "end_line", "symbol_name")


@query("m4_yaml_chunks", f"WITH b AS ({_BASIS}), s AS (SELECT k, unnest(CASE WHEN k % 2 = 0 THEN [{{'n': 'name', 'a': 1, 'b': 1}}, {{'n': 'on', 'a': 2, 'b': 4}}, {{'n': 'jobs' || k, 'a': 5, 'b': 6}}] ELSE [{{'n': 'doc[0].a' || k, 'a': 1, 'b': 2}}, {{'n': 'doc[1].b', 'a': 4, 'b': 5}}] END) AS c FROM b) SELECT 'ci/m' || k || '.yml' AS file, c.n AS symbol_name, c.a::INT AS start_line, c.b::INT AS end_line FROM s")
def yaml_chunks(spark, d):
    text = F.when(F.col("p_partkey") % 2 == 0, "name: x\non:\n  push:\n    - main\njobs{k}:\n  a: 1").otherwise("a{k}: 1\n  # more\n---\nb:\n  c: 2")
    return chunk_files(_files(spark, d, "ci/m{k}.yml", text)).select("file", "symbol_name", "start_line", "end_line")


@query("m5_liquid_imports", f"WITH b AS ({_BASIS}) SELECT 'snippets/m' || k || '.liquid' AS file, 'template' AS type, NULL AS symbol_name, 1 AS start_line, 2 AS end_line, 'card' || k || ',hero' AS imports FROM b UNION ALL SELECT 'snippets/m' || k || '.liquid', 'block', 'schema', 3, 5, NULL FROM b")
def liquid_imports(spark, d):
    text = "{% comment %}{% render 'no' %}{% endcomment %}{% render 'card{k}' %}\n{%- section \"hero\" -%} {% render 'card{k}' %}\n{% schema %}\n{}\n{% endschema %}"
    return chunk_files(_files(spark, d, "snippets/m{k}.liquid", text)).select("file", "type", "symbol_name", "start_line", "end_line", F.array_join("imports", ",").alias("imports"))


#: Functions of known complexity: m has two branches, a nested loop and two logical operators, g none; f calls with and without use.
_PY = "import os\nfrom a.b import c, d\n__all__ = ['K{k}', 'g']\n\nclass K{k}:\n    x = 1\n    def m(self, v):\n        if v and v > 1 or v < 0:\n            for i in v:\n                os.f(i)\n        return v\n\ndef g():\n    r = c(d())\n    d()\n    return r\n"


@query("m7_python_chunks", f"WITH b AS ({_BASIS}), s AS (SELECT k, unnest([{{'t': 'block', 'n': NULL, 'p': NULL, 'a': 1, 'b': 4, 'c': NULL, 'g': NULL}}, {{'t': 'class', 'n': 'K' || k, 'p': NULL, 'a': 5, 'b': 5, 'c': NULL, 'g': NULL}}, {{'t': 'block', 'n': NULL, 'p': NULL, 'a': 6, 'b': 6, 'c': NULL, 'g': NULL}}, {{'t': 'function', 'n': 'm', 'p': 'K' || k, 'a': 7, 'b': 11, 'c': 5, 'g': 5}}, {{'t': 'function', 'n': 'g', 'p': NULL, 'a': 13, 'b': 16, 'c': 1, 'g': 0}}]) AS x FROM b) SELECT 'src/m' || k || '.py' AS file, x.t AS type, x.n AS symbol_name, x.p AS parent, x.a::INT AS start_line, x.b::INT AS end_line, x.c::INT AS complexity, x.g::INT AS cognitive FROM s")
def python_chunks(spark, d):
    return chunk_files(_files(spark, d, "src/m{k}.py", _PY)).select("file", "type", "symbol_name", "parent", "start_line", "end_line", "complexity", "cognitive")


@query("m13_call_sites", f"WITH b AS ({_BASIS}), s AS (SELECT k, unnest([{{'c': 'm', 's': 'f', 'l': 10, 'u': false}}, {{'c': 'g', 's': 'c', 'l': 14, 'u': true}}, {{'c': 'g', 's': 'd', 'l': 14, 'u': true}}, {{'c': 'g', 's': 'd', 'l': 15, 'u': false}}]) AS x FROM b) SELECT 'src/m' || k || '.py' AS file, x.c AS caller, x.s AS symbol, x.l::INT AS line, x.u AS captured FROM s")
def call_sites(spark, d):
    rows = chunk_files(_files(spark, d, "src/m{k}.py", _PY)).select("file", F.col("symbol_name").alias("caller"), F.explode("call_sites").alias("c"))
    return rows.select("file", "caller", "c.symbol", "c.line", "c.captured")


@query("m14_imports_exports", f"WITH b AS ({_BASIS}) SELECT 'src/m' || k || '.py' AS file, 'os,a.b' AS imports, 'K' || k || ',g' AS exports, 'c,d' AS from_ab FROM b")
def imports_exports(spark, d):
    rows = chunk_files(_files(spark, d, "src/m{k}.py", _PY)).where("type = 'class'")
    return rows.select("file", F.array_join("imports", ",").alias("imports"), F.array_join("exports", ",").alias("exports"), F.array_join(F.element_at("imported_symbols", F.lit("a.b")), ",").alias("from_ab"))


@query("w10_uncovered_lines", f"WITH b AS ({_BASIS}), s AS (SELECT k, unnest([{{'a': 1, 'b': 4}}, {{'a': 6, 'b': 6}}]) AS x FROM b) SELECT 'src/m' || k || '.py' AS file, x.a::INT AS start_line, x.b::INT AS end_line FROM s")
def uncovered_lines(spark, d):
    """What lies between the functions and the class header."""
    return chunk_files(_files(spark, d, "src/m{k}.py", _PY)).where("type = 'block'").select("file", "start_line", "end_line")


@query("m6_json_templates", "SELECT 'templates/' || event_id || '.json' AS file, 'sections/' || event_type AS import FROM events")
def json_templates(spark, d):
    body = F.concat(F.lit('{"sections": {"a": {"type": "'), "event_type", F.lit('"}}}'))
    files = table(spark, d, "events").select(F.concat(F.lit("templates/"), "event_id", F.lit(".json")).alias("file"), body.alias("content"))
    return chunk_files(files).select("file", F.explode("imports").alias("import"))


@query("k_session_windows", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS cut FROM events),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts))::BIGINT AS start_us, count(*)::BIGINT AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return session_activity(e).select("user_id", F.unix_micros("start").alias("start_us"), "n")
