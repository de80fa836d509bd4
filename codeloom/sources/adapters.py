"""Relations of the engine over the driver's tables. Bindings are synthetic: they exercise operators, not code semantics.

Each Spark builder has a twin in DuckDB SQL, a CTE of the same name and columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WINDOW, OVERLAP = 75, 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_windows(files: DataFrame, size: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """file, k, start_line, end_line, content and the other columns of files (file, content): windows of `size` lines that
    overlap by `overlap`; the last one reaches the end, blank ones are left out. One projection and one generator."""
    step = size - overlap
    lines = F.split(F.col("content"), "\n")
    count = F.greatest(F.lit(1), F.ceil((F.size("lines") - size) / F.lit(step)).cast("int") + 1)
    out = files.withColumn("lines", lines).withColumn("k", F.explode(F.sequence(F.lit(0), count - 1)))
    part = F.array_join(F.slice("lines", F.col("k") * step + 1, size), "\n")
    out = out.withColumn("start_line", F.col("k") * step + 1).withColumn("end_line", F.least(F.col("k") * step + size, F.size("lines"))).withColumn("content", part)
    return out.where(F.col("content").rlike(r"\S")).drop("lines")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, file, start_line, end_line, language, symbol_name, symbol_type, content over documents."""
    docs = table(spark, sf_dir, "documents")
    files = docs.select("doc_id", F.concat("source", F.lit("/"), "doc_id", F.lit(".md")).alias("file"), F.col("lang").alias("language"), F.coalesce("text", F.lit("")).alias("content"))
    cut = line_windows(files)
    kind = F.element_at(F.array(F.lit("function"), F.lit("method"), F.lit("class")), (F.col("doc_id") % 3 + 1).cast("int"))
    return cut.select((F.col("doc_id") * 1_000_000 + F.col("k")).alias("id"), "file", "start_line", "end_line", "language", F.regexp_extract("content", "([A-Za-z]+)", 1).alias("symbol_name"), kind.alias("symbol_type"), "content", "doc_id")


CHUNKS = r"""
files AS (SELECT doc_id, source || '/' || doc_id || '.md' AS file, lang AS language, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
windows AS (SELECT doc_id, file, language, lines, unnest(range(greatest(1, ceil((len(lines) - 75) / 65.0)::INT + 1))) AS k FROM files),
chunks AS (SELECT doc_id * 1000000 + k AS id, file, (k * 65 + 1)::INT AS start_line, least(k * 65 + 75, len(lines))::INT AS end_line, language,
  regexp_extract(content, '([A-Za-z]+)', 1) AS symbol_name, ['function', 'method', 'class'][(doc_id % 3 + 1)::INT] AS symbol_type, content, doc_id
  FROM (SELECT *, array_to_string(lines[(k * 65 + 1)::BIGINT:(k * 65 + 75)::BIGINT], chr(10)) AS content FROM windows) WHERE regexp_matches(content, '\S'))"""


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function metrics over lineitem: file, symbol, start_line, cyclomatic, cognitive, effort, bugs, one row per order line."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"), F.max("l_extendedprice").alias("p"), F.max("l_discount").alias("d"), F.max("l_tax").alias("t"))
    return li.select(
        F.concat(F.lit("pkg"), F.col("l_orderkey") % 40, F.lit("/f"), F.col("l_orderkey") % 400, F.lit(".py")).alias("file"),
        F.concat(F.lit("fn"), "l_orderkey", F.lit("_"), "l_linenumber").alias("symbol"),
        F.col("l_linenumber").alias("start_line"), F.floor("q").cast("int").alias("cyclomatic"), F.floor(F.col("d") * 400).cast("int").alias("cognitive"),
        (F.floor("p") * 2).cast("double").alias("effort"), F.col("t").alias("bugs"), F.col("l_orderkey").alias("orderkey"),
    )


FUNCTIONS = """
li AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q, max(l_extendedprice) AS p, max(l_discount) AS d, max(l_tax) AS t FROM lineitem GROUP BY 1, 2),
functions AS (SELECT 'pkg' || (l_orderkey % 40) || '/f' || (l_orderkey % 400) || '.py' AS file, 'fn' || l_orderkey || '_' || l_linenumber AS symbol, l_linenumber AS start_line,
  floor(q)::INT AS cyclomatic, floor(d * 400)::INT AS cognitive, (floor(p) * 2)::DOUBLE AS effort, t AS bugs, l_orderkey AS orderkey FROM li)"""


def imports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(files(file), specifiers(importer, specifier)): paths from part, each importing a tail of other parts' paths."""
    part = table(spark, sf_dir, "part")
    path = F.concat(F.lit("src/"), F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]+", "_")), F.lit("/"), F.lower(F.regexp_replace("p_type", "[^A-Za-z0-9]+", "_")), F.lit("/m"), "p_partkey")
    files = part.select(F.col("p_partkey").alias("key"), path.alias("file"))
    to = ((F.col("l_partkey") * 7 + F.col("l_suppkey") * 13) % F.lit(997) + 1).alias("to")
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), to).distinct()  # numbers, before there are paths
    named = files.select(F.col("key").alias("to"), F.col("file").alias("to_file"))
    depth = (F.col("key") + F.col("to")) % 3
    spec = F.when(depth == 0, F.col("to_file")).when(depth == 1, F.substring_index("to_file", "/", -2)).otherwise(F.concat(F.lit("../"), F.substring_index("to_file", "/", -1)))
    specified = pairs.join(named.hint("merge"), "to").select("key", spec.alias("specifier"))  # paths take many times their stored size
    return files.select("file"), specified.join(files.hint("merge"), "key").select(F.col("file").alias("importer"), "specifier").distinct()


IMPORTS = """
part_files AS (SELECT p_partkey AS key, 'src/' || lower(regexp_replace(p_brand, '[^A-Za-z0-9]+', '_', 'g')) || '/' || lower(regexp_replace(p_type, '[^A-Za-z0-9]+', '_', 'g')) || '/m' || p_partkey AS file FROM part),
li_pairs AS (SELECT DISTINCT l_partkey AS key, (l_partkey * 7 + l_suppkey * 13) % 997 + 1 AS to_key FROM lineitem),
specifiers AS (SELECT DISTINCT f.file AS importer, CASE (l.key + l.to_key) % 3 WHEN 0 THEN t.file
  WHEN 1 THEN string_split(t.file, '/')[-2] || '/' || string_split(t.file, '/')[-1] ELSE '../' || string_split(t.file, '/')[-1] END AS specifier
  FROM li_pairs l JOIN part_files t ON t.key = l.to_key JOIN part_files f ON f.key = l.key)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ledger rows: session, ts, kind (shown, signal), nudge, signal, file, symbol, level."""
    e = table(spark, sf_dir, "events")
    k = F.from_json("props", "k int")["k"]
    shown = F.col("event_type").isin("view", "signup")
    return e.select(
        "event_id", F.col("user_id").alias("session"), "ts", F.when(shown, "shown").otherwise("signal").alias("kind"),
        F.when(F.col("event_type") == "view", "annotate").when(F.col("event_type") == "signup", "blast").alias("nudge"),
        F.when(F.col("event_type") == "click", "files_context").when(F.col("event_type") == "purchase", "dependents").when(F.col("event_type") == "error", "test_run").alias("signal"),
        F.concat(F.lit("f"), k % 7).alias("file"), F.concat(F.lit("s"), k % 5).alias("symbol"), F.element_at(F.array(*(F.lit(x) for x in ("low", "medium", "high", "critical", "other"))), (k % 5 + 1).cast("int")).alias("level"), "value",
    )


LEDGER = """
ledger AS (SELECT event_id, user_id AS session, ts, CASE WHEN event_type IN ('view', 'signup') THEN 'shown' ELSE 'signal' END AS kind,
  CASE event_type WHEN 'view' THEN 'annotate' WHEN 'signup' THEN 'blast' END AS nudge,
  CASE event_type WHEN 'click' THEN 'files_context' WHEN 'purchase' THEN 'dependents' WHEN 'error' THEN 'test_run' END AS signal,
  'f' || (k % 7) AS file, 's' || (k % 5) AS symbol, ['low', 'medium', 'high', 'critical', 'other'][(k % 5 + 1)::INT] AS level, value
  FROM (SELECT *, json_extract(props, '$.k')::INT AS k FROM events))"""


def first_ordinal(df: DataFrame, keys: list[str], *order) -> DataFrame:
    return df.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
