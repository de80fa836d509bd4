"""What a plan sends through the driver or exchanges must not follow the input."""

import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from codeloom import catalog
from codeloom.chunkers.files import chunk_files
from codeloom.engine import Engine
from codeloom.llm import ngram_join
from codeloom.operators import claims, graph, recovery, review, search
from codeloom.operators.imports import call_edge_counts, call_edges, dependent_counts, import_edges, unnamed_imports
from codeloom.sources import tree
from codeloom.sources.adapters import imports
from codeloom.tables import BROADCAST, Scratch


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_are_written_without_large_broadcasts(spark):
    scratch, name = Scratch(spark, "t"), "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    seen = []

    class Spy:
        def __init__(self, df):
            self.df, self.schema = df, df.schema

        @property
        def write(self):
            spy = self

            class Writer:
                def option(self, *_):
                    return self

                def parquet(self, path):
                    seen.append(spark.conf.get(name))
                    spy.df.write.parquet(path)

            return Writer()

    assert scratch.table(Spy(spark.range(5)), "x").count() == 5
    assert seen == [str(BROADCAST)] and spark.conf.get(name) == before


def test_sized_tables_choose_their_join(spark):
    scratch, many = Scratch(spark, "t"), spark.range(1_000_000)
    assert "BroadcastHashJoin" in plan(many.join(scratch.sized(spark.range(9), "few"), "id"))
    large = scratch.sized(spark.range(200_000).select(F.xxhash64("id").alias("id")), "large")
    assert "BroadcastHashJoin" not in plan(many.join(large, "id"))


def test_components_and_what_drops_copies_join_without_the_driver(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (2, text), (3, "other words here at all")], "doc_id long, text string")
    found = ngram_join.components(docs, Scratch(spark, "t"))
    assert "BroadcastHashJoin" not in plan(found)
    assert sorted(r["component_id"] for r in found.collect()) == [1, 1, 3]
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert "BroadcastHashJoin" not in plan(kept) and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("parts")
    spark.createDataFrame([(k, f"Brand#{k % 5}", f"TYPE {k % 7}") for k in range(1, 41)], "p_partkey long, p_brand string, p_type string").write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame([(k, s) for k in range(1, 41) for s in range(1, 300) if (7 * k + 13 * s) % 997 < 40], "l_partkey long, l_suppkey long").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_paths_are_not_broadcast(spark, parts):
    files, spec = imports(spark, parts)
    assert "BroadcastHashJoin" not in plan(spec)
    edges = import_edges(spec, files)
    assert plan(edges).count("BroadcastHashJoin") <= 1  # the matches of specifiers, a table that was measured
    assert "BroadcastHashJoin" not in plan(dependent_counts(Scratch(spark, "t").table(edges, "e"), files))
    for name in ("g12_uncovered_dependents", "g7_blast_risk"):
        assert plan(catalog.queries()[name](spark, parts)).count("BroadcastHashJoin") <= 1  # what tests cover, likewise


def test_calls_meet_all_definitions_only_in_the_last_tier(spark):
    calls = spark.createDataFrame([("a/x", "f"), ("a/x", "g"), ("b/y", "f"), ("b/y", "h"), ("c/z", "f")], "file string, symbol string")
    defs = spark.createDataFrame([("a/x", "g"), ("b/w", "f"), ("d/v", "f"), ("d/v", "h"), ("d/u", "h")], "file string, symbol string")
    edges = spark.createDataFrame([("a/x", "d/v"), ("c/z", "q"), ("b/y", "b/w")], "importer string, file string")
    got = sorted(tuple(r) for r in call_edges(calls, defs, edges).collect())
    assert got == [("a/x", "f", "d/v", 2), ("a/x", "g", "a/x", 1), ("b/y", "f", "b/w", 2), ("b/y", "h", "d/u", 4), ("b/y", "h", "d/v", 4), ("c/z", "f", "b/w", 4), ("c/z", "f", "d/v", 4)]
    assert sorted(tuple(r) for r in call_edge_counts(calls, defs, edges).collect()) == [(1, 1), (2, 2), (4, 4)]
    assert sorted(tuple(r) for r in unnamed_imports(edges, calls, defs).collect()) == [("c/z", "q")]


def test_reach_keeps_sets_by_block(spark):
    n = 3 * graph.BLOCK
    nodes = spark.range(n).select(F.format_string("f%06d", "id").alias("file"))
    edges = nodes.select(F.lit("f000000").alias("file"), F.col("file").alias("importer")).where("importer <> file")
    edges = edges.unionByName(spark.createDataFrame([("f000007", "f000000")], "file string, importer string"))
    reach = graph.Reach(nodes, Scratch(spark, "t"))
    reached = reach.expand(spark.createDataFrame([("f000000",), ("f000007",), ("f000009",)], "file string"), reach.adjacency(edges), 2)
    rows = reach.named(reached).collect()
    assert reached.count() < 20 and len(rows) == 2 * (n - 1)
    assert {(r["seed"], r["hops"]) for r in rows} == {("f000000", 1), ("f000007", 1), ("f000007", 2)}
    assert {r["node"] for r in rows if r["seed"] == "f000007"} == {f"f{i:06d}" for i in range(n)} - {"f000007"}
    near = reach.nearest(reached, 3).where("seed = 'f000007'").orderBy("hops", "node").collect()
    assert [(r["node"], r["hops"], r["truncated"]) for r in near] == [("f000000", 1, True), ("f000001", 2, True), ("f000002", 2, True)]


def test_an_engine_makes_its_edges_once(spark, parts):
    files, spec = imports(spark, parts)
    e = Engine(files, spec)
    assert e._edges() is e._edges() and "Join" not in plan(e._edges())


def test_postings_stay_where_their_chunk_is(spark):
    c = spark.createDataFrame([(i, f"f{i % 3}", "aName", f"words of the text {i} a b a") for i in range(9)], "id long, file string, symbol_name string, content string")
    c = search.searchable(c)
    asked = spark.createDataFrame([(1, "the text a.b"), (2, "words 5")], "query long, text string")
    terms = asked.select("query", F.explode(search.terms(F.col("text"))).alias("term"))
    plain = search.bm25(search.postings(c), c.select(F.lit(7).alias("length")), terms)
    weighted = search.weighted_bm25(search.positions(c), search.lengths(c), search.phrases(asked))
    for df in (plain, weighted):
        exchanges = re.findall(r"Exchange hashpartitioning\(([a-z]+)", plan(df))
        assert set(exchanges) == {"id"} and df.count() == 18


def test_parsing_is_dealt_to_all_tasks(spark):
    files = spark.range(40).select(F.format_string("a/m%d.py", "id").alias("file"), F.lit("def f(x):\n    return g(x) if x else 1\n").alias("content")).coalesce(1)
    out = chunk_files(files).where("type = 'function'")
    assert out.rdd.getNumPartitions() == 4 and [(r["complexity"], r["calls"]) for r in out.collect()] == [(2, ["g"])] * 40
    code = spark.range(9).select(F.format_string("a/m%d.ts", "id").alias("file"), F.lit(1).alias("start_line"), F.lit("enum A {\n  B,\n}\ninterface C {\n  d: number;\n}\n").alias("content")).coalesce(1)
    for df in (claims.family_members(code), claims.declared_fields(code)):
        assert "RoundRobinPartitioning" in plan(df) and df.count() == 9


def test_a_scan_tests_each_name_once_in_all_tasks(spark):
    files = spark.range(60).select(F.format_string("src/m%d.ts", F.col("id") % 30).alias("file")).coalesce(1)
    out = tree.scan(files, gitignore=["m3.ts"], tracked=files)
    assert plan(out).count("/scan-") == 3 and out.count() == 30


def test_patterns_are_tried_on_words_that_met_a_name(spark):
    docs = spark.createDataFrame([(1, "a.md", 1, "see load_x now\nor `put` it")], "id long, file string, start_line int, content string")
    names = spark.createDataFrame([("load_x",), ("put",), ("absent",)], "symbol string")
    found = review.doc_references(docs, names)
    assert "Filter RLIKE" not in plan(found) and sorted(r["symbol"] for r in found.collect()) == ["load_x", "put"]


def test_sweeps_join_without_the_driver(spark, parts_with_sizes):
    for name in ("n4_variant_sweep", "n5_unread_fields"):
        out = catalog.queries()[name](spark, parts_with_sizes)
        assert plan(out).count("BroadcastHashJoin") <= (name == "n4_variant_sweep") and out.count() > 0  # at most that of the first twelve


@pytest.fixture(scope="module")
def parts_with_sizes(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sizes")
    spark.createDataFrame([(k, k % 50 + 1) for k in range(1, 41)], "p_partkey long, p_size int").write.parquet(f"{folder}/part.parquet")
    return str(folder)


def test_names_of_calls_are_tested_once(spark):
    decl = spark.createDataFrame([("S/A.swift", "RetryPolicy", False)], "file string, symbol string, extension boolean")
    calls = spark.createDataFrame([("Tests/ATests.swift", "RetryPolicy")] * 5, "file string, symbol string")
    out = recovery.module_usage_tests(decl, calls)
    assert "/calls-" in plan(out) and "BroadcastHashJoin" not in plan(out) and out.count() == 1
