"""Review signals over diffs made from documents (synthetic)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import signals as S
from codeloom.plans.registry import query
from codeloom.sources.adapters import CHUNKS, chunks, table

_HEAD = "@@ -1,3 +10,4 @@\n"


def _patches(spark, d):
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    signed = F.transform(lines, lambda x, i: F.concat(F.when(i % 4 == 0, "+").when(i % 4 == 1, "-").otherwise(" "), x))
    return table(spark, d, "documents").select(F.concat("source", F.lit("/"), "doc_id", F.lit(".md")).alias("file"), F.concat(F.lit(_HEAD), F.array_join(signed, "\n")).alias("patch"))


_DIFF = """l0 AS (SELECT source || '/' || doc_id || '.md' AS file, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l1 AS (SELECT file, unnest(lines) AS text, generate_subscripts(lines, 1) - 1 AS i FROM l0),
diff AS (SELECT file, text, CASE i % 4 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE ' ' END AS sign, CASE WHEN i % 4 <> 1 THEN (9 + sum(CASE WHEN i % 4 = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY file ORDER BY i))::BIGINT END AS line FROM l1)"""


@query("a13_diff_lines", f"WITH {_DIFF} SELECT file, line, sign, md5(text) AS text_md5 FROM diff")
def diff_lines(spark, d):
    return S.diff_lines(_patches(spark, d)).select("file", F.col("line").cast("long").alias("line"), "sign", F.md5("text").alias("text_md5"))


@query("j25_touched_chunks", f"WITH {CHUNKS}, {_DIFF} SELECT DISTINCT id FROM chunks k JOIN diff f ON f.file = k.file AND f.sign <> '-' AND f.line BETWEEN k.start_line AND k.end_line")
def touched_chunks(spark, d):
    return S.touched_chunks(S.diff_lines(_patches(spark, d)), chunks(spark, d).select("id", "file", "start_line", "end_line")).select("id")


@query("n12_untrusted_input", f"WITH {_DIFF} SELECT file, line FROM diff WHERE sign = '+' AND regexp_matches(text, '(?i)\\b(the and|of the)\\b') ORDER BY file, line LIMIT 12")
def untrusted_input(spark, d):
    return S.diff_lines(_patches(spark, d)).where("sign = '+'").where(F.col("text").rlike(r"(?i)\b(the and|of the)\b")).orderBy("file", "line").limit(12).select("file", F.col("line").cast("long").alias("line"))


@query("n3_rename_sweep", "WITH p AS (SELECT 'f' || (p_partkey % 50) AS file, p_partkey AS k, 'use old' || (p_size % 5) || ' of ' || p_type AS a, 'use new' || (p_size % 5) || ' of ' || p_type AS b FROM part) SELECT 'old' || n AS \"from\", 'new' || n AS \"to\", c AS occurrences, f AS files FROM (SELECT a[8:8] AS n, count(*)::BIGINT AS c, count(DISTINCT file)::BIGINT AS f FROM p GROUP BY 1) WHERE c >= 5 AND f >= 3")
def rename_sweep(spark, d):
    p = table(spark, d, "part").select(F.concat(F.lit("f"), F.col("p_partkey") % 50).alias("file"), F.col("p_partkey").alias("k"), (F.col("p_size") % 5).alias("n"), "p_type")
    line = lambda w: F.concat(F.lit(f"use {w}"), "n", F.lit(" of "), "p_type")
    return S.rename_swaps(p.select("file", "k", line("old").alias("text")), p.select("file", "k", line("new").alias("text")))


@query("n2_surviving_references", f"""WITH {CHUNKS}, tok AS (SELECT DISTINCT symbol_name AS token FROM chunks WHERE doc_id % 50 = 0 AND length(symbol_name) > 4), w AS (SELECT file, start_line, unnest(list_distinct(string_split_regex(content, '[^A-Za-z0-9_]+'))) AS token FROM chunks WHERE file NOT IN (SELECT file FROM chunks WHERE doc_id % 50 = 0)),
r AS (SELECT token, file, start_line, row_number() OVER (PARTITION BY token ORDER BY file, start_line) AS rank FROM w JOIN tok USING (token)) SELECT token, file, start_line FROM r WHERE rank <= 5""")
def surviving_references(spark, d):
    c = chunks(spark, d)
    gone = c.where("doc_id % 50 = 0")
    tokens = gone.where(F.length("symbol_name") > 4).select(F.col("symbol_name").alias("token"))
    return S.survivors(tokens, c, gone.select("file").distinct())


@query("n1_stale_literals", "WITH l AS (SELECT DISTINCT 'f' || o_custkey % 200 AS file, 'a' || o_custkey % 7 AS area, o_orderpriority || (o_orderkey % 400) AS literal FROM orders), t AS (SELECT literal, file FROM l WHERE file IN ('f1', 'f2', 'f3')), o AS (SELECT l.* FROM l WHERE literal IN (SELECT literal FROM t) AND (literal, file) NOT IN (SELECT (literal, file) FROM t)), g AS (SELECT literal FROM o GROUP BY 1 HAVING count(DISTINCT area) < 3) SELECT DISTINCT literal, file FROM o WHERE literal IN (SELECT literal FROM g)")
def stale_literals(spark, d):
    k = F.col("o_custkey")
    lits = table(spark, d, "orders").select(F.concat(F.lit("f"), k % 200).alias("file"), F.concat(F.lit("a"), k % 7).alias("area"), F.concat("o_orderpriority", F.col("o_orderkey") % 400).alias("literal")).distinct()
    return S.stale_literals(lits.where(F.col("file").isin("f1", "f2", "f3")), lits)


@query("n6_sibling_surface", """WITH f AS (SELECT DISTINCT 'fam' || o_custkey % 40 AS family, 'f' || o_custkey % 400 AS file, 't' || o_orderkey % 25 AS token, o_custkey % 400 < 40 AS changed FROM orders),
s AS (SELECT family, token, count(DISTINCT file)::BIGINT AS n FROM f WHERE NOT changed GROUP BY 1, 2), z AS (SELECT family, count(DISTINCT file)::BIGINT AS siblings FROM f WHERE NOT changed GROUP BY 1 HAVING count(DISTINCT file) >= 2)
SELECT s.family, s.token, n, siblings FROM s JOIN z USING (family) WHERE n >= greatest(2, ceil(siblings / 2.0)) AND (s.family, s.token) NOT IN (SELECT (family, token) FROM f WHERE changed)""")
def sibling_surface(spark, d):
    k = F.col("o_custkey")
    f = table(spark, d, "orders").select(F.concat(F.lit("fam"), k % 40).alias("family"), F.concat(F.lit("f"), k % 400).alias("file"), F.concat(F.lit("t"), F.col("o_orderkey") % 25).alias("token"), (k % 400 < 40).alias("changed")).distinct()
    return S.unmirrored(f.where("changed"), f)


@query("n15_citation_gate", "WITH f AS (SELECT l.doc_id AS id, l.doc_id AS file, CASE WHEN quality = 1 THEN [substr(d.text, 3, 20)] WHEN toxic = 1 THEN ['no such span'] ELSE []::VARCHAR[] END AS spans, d.text FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id + 1 - quality) SELECT id FROM f LEFT JOIN documents d ON d.doc_id = f.file WHERE len(spans) = 0 OR d.text IS NULL OR contains(d.text, spans[1])")
def citation_gate(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    source = docs.select((F.col("doc_id")).alias("from"), F.col("text").alias("quoted"))
    lab = table(spark, d, "labels").withColumn("from", F.col("doc_id") + 1 - F.col("quality")).join(source, "from", "left")
    spans = F.when(F.col("quality") == 1, F.array(F.substring("quoted", 3, 20))).when(F.col("toxic") == 1, F.array(F.lit("no such span"))).otherwise(F.array().cast("array<string>"))
    return S.cited(lab.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("file"), spans.alias("spans")), docs.select(F.col("doc_id").alias("file"), F.col("text").alias("content"))).select("id")
