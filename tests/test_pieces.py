"""Globs and ignore rules, stems, commands, manifests, reports, budgets, plans of operators that must stay narrow."""

import json
import re

import pytest
from pyspark.sql import functions as F

from codeloom import plugins
from codeloom.chunkstore import ChunkStore
from codeloom.functions import columns as C
from codeloom.functions import commands, stem
from codeloom.operators import graph, metrics, recovery, reports, resolve, search, signals, store
from codeloom.sources import tree
from codeloom.tables import Scratch


@pytest.mark.parametrize(("pattern", "yes", "no"), [
    ("**/*.{ts,py}", ["a.ts", "x/y/b.py"], ["a.js", ".hid/a.ts", "x/.a.ts", "a.tsx"]), ("*.min.js", ["a.min.js"], ["x/a.min.js"]), ("src/**", ["src/a", "src/a/b.c"], ["src", "xsrc/a"]), ("a?c/[ab].go", ["abc/a.go"], ["abc/c.go", "ac/a.go"]),
    (".github/**/*.{yml,yaml}", [".github/a.yml", ".github/w/x.yaml"], ["github/a.yml"]), ("docs/**/x.md", ["docs/x.md", "docs/a/b/x.md"], ["docs/a/y.md"]), ("*", ["a"], [".a", "a/b"]),
])
def test_globs(pattern, yes, no):
    regex = re.compile(f"^(?:{tree.glob_regex(pattern)})\\Z")
    assert all(regex.match(x) for x in yes) and not any(regex.match(x) for x in no)


def test_hidden_files_where_asked():
    assert re.fullmatch(tree.glob_regex("**/*.ts", hidden=True), ".x/.a.ts") and not re.fullmatch(tree.glob_regex("**/*.ts"), ".x/a.ts")


def test_ignore_rules(spark):
    lines = ["# c", "", "*.log", "!keep.log", "/top", "dir/", "a/b", "\\#odd", "sp ", "x/**/z", "out/**", "!out/y"]
    want = {"a.log": True, "d/a.log": True, "keep.log": False, "d/keep.log": False, "top": True, "top/f": True, "d/top": False, "dir": False, "dir/f": True, "q/dir/f": True, "a/b": True, "a/b/c": True, "q/a/b": False, "#odd": True, "sp": True, "x/z": True, "x/1/2/z": True, "out/x": True, "out/y": False, "plain": False}
    df = spark.createDataFrame([(f,) for f in want], "file string")
    assert {r["file"]: r["i"] for r in df.select("file", tree.ignored(F.col("file"), lines).alias("i")).collect()} == want


def test_read_tree(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.py").write_text("import os\n")
    (tmp_path / "big.py").write_text("y" * 50)
    got = {r["file"]: (r["content"], r["size"], r["oversize"]) for r in tree.read_tree(spark, str(tmp_path), "*.py", 20).collect()}
    assert got == {"a/x.py": ("import os\n", 10, False), "big.py": (None, 50, True)}


#: Words and stems of the published algorithm.
STEMS = "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop falling fall hissing hiss failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit operator oper feudalism feudal decisiveness decis hopefulness hope formaliti formal sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust replacement replac adoption adopt homologou homolog communism commun activate activ effective effect probate probat rate rate cease ceas controll control roll roll naïve naiv x2 x2".split(" ")


@pytest.mark.parametrize(("word", "want"), [*zip(STEMS[::2], STEMS[1::2], strict=True)])
def test_stems(word, want):
    assert stem.stem(word) == want


def test_stemmed_search_finds_other_forms(spark):
    rows = [(1, "a.py", 1, "the runners were hopping", "run"), (2, "b.py", 1, "nothing here", "x")]
    c = search.searchable(spark.createDataFrame(rows, "id long, file string, start_line int, content string, symbol_name string"))
    q = spark.createDataFrame([(0, "hops")], "query int, text string")
    ids = lambda on: [r["id"] for r in search.weighted_bm25(search.positions(c, stem=on), search.lengths(c, stem=on), search.phrases(q, on)).collect()]
    assert ids(True) == [1] and ids(False) == []


def test_weights_and_phrases(spark):
    rows = [(1, "a.py", 1, "other words only", "parseConfig"), (2, "b.py", 1, "parse the config", "load"), (3, "c.py", 1, "config parse x", "y"), (4, "d.py", 1, "parse config now", "z")]
    c = search.searchable(spark.createDataFrame(rows, "id long, file string, start_line int, content string, symbol_name string"))
    q = spark.createDataFrame([(0, "parse.config"), (1, "parse config"), (2, ""), (3, "parseconfig parseconfig")], "query int, text string")
    wanted = search.phrases(q)
    got = {(r["query"], r["id"]): r["score"] for r in search.weighted_bm25(search.positions(c), search.lengths(c), wanted).collect()}
    assert {i for k, i in got if k == 0} == {1, 4} and got[0, 1] > got[0, 4]  # the words of the symbol weigh twice the content's
    assert {i for k, i in got if k == 1} == {1, 2, 3, 4} and not any(k == 2 for k, _ in got)
    assert {i for k, i in got if k == 3} == {1} and wanted.where("query = 3").first()["times"] == 2
    assert search.quoted('say "hi" a.b') == '"say" OR """hi""" OR "a.b"'


def test_postings_index_follows_changes(spark, tmp_path):
    schema = "id long, file string, start_line int, content string, symbol_name string"
    index = search.PostingsIndex(spark, f"{tmp_path}/i", buckets=4)
    rows = {f: [(i * 10 + k, f, k, f"word{k} {f[0]} common", "s") for k in range(3)] for i, f in enumerate(["a.py", "b.py", "c.py"])}
    df = lambda rs: spark.createDataFrame(rs, schema)
    now = dict(rows)
    index.update(df([r for x in rows.values() for r in x]))
    for name, new, gone in (("a.py", [(0, "a.py", 0, "renewed common", "s")], []), ("b.py", [], ["b.py"]), ("b.py", [(77, "b.py", 0, "back common word1", "s")], []), ("a.py", [(0, "a.py", 0, "again common", "s")], ["c.py"])):
        index.update(df(new), spark.createDataFrame([(g,) for g in gone], "file string"))
        now |= {g: [] for g in gone} | ({name: new} if new else {})
        whole = search.searchable(df([r for x in now.values() for r in x]))
        q = spark.createDataFrame([(0, "common word1"), (1, "renewed again")], "query int, text string")
        want = search.weighted_bm25(search.positions(whole), search.lengths(whole), search.phrases(q))
        assert sorted(map(tuple, index.search(q).collect())) == sorted(map(tuple, want.collect()))


def test_index_reads_only_its_buckets(spark, tmp_path):
    index = search.PostingsIndex(spark, f"{tmp_path}/i", buckets=16)
    index.update(spark.createDataFrame([(i, "a.py", i, " ".join(f"w{j}" for j in range(i, i + 9)), "s") for i in range(40)], "id long, file string, start_line int, content string, symbol_name string"))
    wanted = search.phrases(spark.createDataFrame([(0, "w7")], "query int, text string"))
    plan = index.places(wanted)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "(bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]


@pytest.mark.parametrize(("command", "want"), [
    ("npm test", (True, True, [])), ("npx vitest run src/a.test.ts", (True, False, ["src/a.test.ts"])), ("pytest -k name", (True, False, [])), ("pytest tests/a.py tests/b.py -q", (True, False, ["tests/a.py", "tests/b.py"])),
    ("X=1 Y=2 poetry run --with dev pytest", (True, True, [])), ("go test ./...", (True, True, [])), ("go test ./pkg/a", (True, False, ["./pkg/a"])), ("go test -run TestX", (True, False, [])), ("cargo test name", (True, False, [])),
    ("cargo test -p crate", (True, True, [])), ("pnpm --filter web test", (True, True, [])), ("pnpm test -F web", (True, True, [])), ("jest -c jest.config.js", (True, True, [])), ("vitest vitest.config.ts", (True, True, [])),
    ("./gradlew build -x test", (False, False, [])), ("./gradlew :app:test", (True, True, [])), ("npm testing", (False, False, [])), ("ls; pytest a.py && jest", (True, True, [])), ("", (False, False, [])), (None, (False, False, [])),
])
def test_commands(command, want):
    assert commands.classify(command) == want


def test_manifests(spark):
    composer = json.dumps({"autoload": {"psr-4": {"App\\": "./app", "Lib": ["a/", "b"]}}, "autoload-dev": {"psr-4": {"App\\": ["tests"]}}})
    assert resolve.psr4_map(composer) == {"App\\": ("app/", "tests/"), "Lib\\": ("a/", "b/")} and resolve.psr4_map("{") == {} and resolve.psr4_map("[]") == {}
    assert resolve.go_module("// x\nmodule github.com/o/m\n\ngo 1.22\n") == "github.com/o/m" and resolve.go_module("go 1.2") is None
    assert resolve.crate_name('[package]\nname = "core-lib"\n[lib]\nname = "z"\n') == "core_lib"
    files = spark.createDataFrame([("m/src/main/kotlin/a/B.kt",), ("src/test/java/T.java",), ("build/src/main/java/X.java",), ("src/main/java/Y.java",), ("src/pk/__init__.py",)], "file string")
    assert resolve.jvm_source_roots(files) == ["src/main/java", "m/src/main/kotlin", "src/test/java"] and resolve.python_src_root(files) == "src"


def test_sarif_and_budget(spark, tmp_path):
    v = spark.createDataFrame([("b.py", "g", 5, 9, "bugs", 2.0, 1.5, "warning"), ("a.py", 'f"', 1, 4, "cyclomatic", 31.0, 15.0, "error")], "file string, symbol string, start_line int, end_line int, metric string, value double, threshold double, severity string")
    doc = json.loads(reports.sarif(v))
    assert doc["version"] == "2.1.0" and [r["level"] for r in doc["runs"][0]["results"]] == ["error", "warning"] and len(doc["runs"][0]["tool"]["driver"]["rules"]) == 4
    assert doc["runs"][0]["results"][0]["locations"][0]["physicalLocation"] == {"artifactLocation": {"uri": "a.py"}, "region": {"startLine": 1, "endLine": 4}}
    with pytest.raises(ValueError, match="write_sarif"):
        reports.sarif(v, most=1)
    reports.write_sarif(v, f"{tmp_path}/s")
    assert [json.loads(r["value"])["ruleId"] for r in spark.read.text(f"{tmp_path}/s/results").collect()] == ["codeloom/high-cyclomatic-complexity", "codeloom/high-estimated-bugs"]
    lines = {r["file"]: r["line"] for r in reports.text_lines(v).collect()}
    assert lines["a.py"].endswith("31 (needs ~31 tests) (threshold: 15), 107% over threshold") and "2.00 (threshold: 1.5), 33% over" in lines["b.py"]
    item = lambda n: {"content": "\n".join("x" * 40 for _ in range(n))}
    assert reports.within_budget([item(2)] * 3) == ([item(2)] * 3, 0) and reports.within_budget([]) == ([], 0)
    cut, phase = reports.within_budget([item(100)] * 4)
    assert phase == 1 and len(cut) == 4 and cut[0]["content"].endswith("... (truncated)") and cut[0]["content"].count("\n") == 10
    few, phase = reports.within_budget([item(100)] * 60)
    assert phase == 2 and 1 < len(few) < 60 and len(json.dumps(few, separators=(",", ":"))) <= 12_000
    one, phase = reports.within_budget([{"content": "y" * 9000 + "\n" + "\n".join("z" * 900 for _ in range(9))}])
    assert phase == 3 and len(one) == 1


def test_exit_code(spark):
    df = lambda *v: spark.createDataFrame([(x,) for x in v], "verdict string")
    assert reports.exit_code(df("pre_existing", "crossed")) == 1 and reports.exit_code(df("new_over"), soft=True) == 0 and reports.exit_code(df("worsened", "improved")) == 0


def test_catch_bodies():
    assert signals.indiscriminate("e", " return 1; ") and signals.indiscriminate("e", " recover(e) ")
    for body in (" throw e; ", " if (e instanceof X) return 1; ", " if (e.code === 2) return 1; ", " console.log(e) ", "", " { return 1 } "):
        assert not signals.indiscriminate("e", body)
    assert not signals.indiscriminate(None, " return 1; ")
    code = "a 'x{' // }\nb /* { */ `}` c"
    assert not set("{}") & set(signals.masked(code)) and len(signals.masked(code)) == len(code) and signals.masked(code)[-1] == "c"


def test_recovery_text():
    said = recovery.describe_recovery(["csharp-type-reference", "jvm-same-package"])
    assert said["language"] == "C# and Java/Kotlin" and " and " in said["recovery"] and recovery.describe_recovery([])["language"] == ""


def test_expansion_reads_three_tables_a_level(spark):
    """Scans and exchanges don't grow with the depth: edges, the last level, and all before it."""
    edges = spark.createDataFrame([(f"f{i}", f"f{i + 1}") for i in range(30)], "file string, importer string")
    got = graph.expand(spark.createDataFrame([("f0",), ("f9",)], "file string"), edges, 5, Scratch(spark, "t"))
    assert got._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 1
    assert sorted((r["seed"], r["hops"]) for r in got.collect()) == sorted((s, h) for s in ("f0", "f9") for h in range(1, 6))


def test_chains_of_reexports(spark):
    edges = spark.createDataFrame([("b1", "t"), ("b2", "b1"), ("b3", "b2"), ("b4", "b3"), ("u1", "b1"), ("u3", "b3"), ("u4", "b4"), ("d", "t"), ("d", "b1")], "importer string, file string")
    passing = edges.where("importer like 'b%'").select(F.col("importer").alias("barrel"), "file")
    got = {r["node"] for r in graph.reexport_dependents(edges, passing, 3).where("target = 't'").collect()}
    assert got == {"b2", "b3", "b4", "u1", "u3"}


def test_signature_has_no_order_and_no_gathering(spark):
    rows = [(f"f{i}", f"h{i}") for i in range(50)]
    a, b = (store.signature(spark.createDataFrame(r, "file string, content_hash string").repartition(n)).first()[0] for r, n in ((rows, 3), (rows[::-1], 7)))
    other = store.signature(spark.createDataFrame(rows[1:], "file string, content_hash string")).first()[0]
    assert a == b != other and store.signature(spark.createDataFrame([], "file string, content_hash string")).first()[0]
    plan = store.signature(spark.createDataFrame(rows, "file string, content_hash string"))._jdf.queryExecution().executedPlan().toString()
    assert "collect" not in plan


def test_snippets(spark):
    text = "def a():\n    x = call(1)\n\n    y\n    call(2)"
    rows = [(1, 2, "    x = call(1)"), (1, 4, "call(2)"), (10, 12, "x = call(1)"), (1, 30, "call(...)"), (1, 3, "x = call(1)")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, first int, line int, want string")
    got = df.orderBy("i").select("want", C.snippet(F.lit(text), F.col("first"), F.col("line"), F.lit("call")).alias("s")).collect()
    assert all(r["s"] == r["want"].strip() for r in got)


def test_headroom_and_overall_on_empty(spark):
    empty = spark.createDataFrame([], "file string, avg double, max int, sum long, n long")
    assert metrics.overall(empty).collect()[0]["max"] is None


CHUNK = "id long, file string, start_line int, end_line int, content string, symbol_name string, language string"


def test_chunk_store_and_overlay(spark, tmp_path):
    rows = [(i, f"f{i}.py", 1, 1, f"alpha w{i}", f"s{i}", "python") for i in range(8)]
    df = lambda r: spark.createDataFrame(r, CHUNK)
    base = ChunkStore(spark, f"{tmp_path}/base", buckets=4)
    assert not base.has_data()
    base.insert(iter([df(rows[:5]), df(rows[5:])]))
    assert base.has_data() and base.read().count() == 8 and base.stale(5000) and not base.stale(5500) and not base.stale(7000)
    asked = spark.createDataFrame([(0, "w3")], "query int, text string")
    assert [r["file"] for r in base.search(asked).collect()] == ["f3.py"]
    base.replace(df([(3, "f3.py", 1, 1, "alpha moved", "s3", "python")]), spark.createDataFrame([("f4.py",)], "file string"))
    assert base.search(asked).count() == 0 and base.read().count() == 7 and base.stale(9000)
    assert [r["content"] for r in base.by_files(["f3.py"]).collect()] == ["alpha moved"]
    over = ChunkStore(spark, f"{tmp_path}/over", buckets=4, base=base, masked=spark.createDataFrame([("f1.py",), ("f2.py",)], "file string"))
    over.publish(df([(100, "f1.py", 1, 1, "w5 w5 own", "t", "python")]))
    assert {r["file"] for r in over.read().collect()} == {"f0.py", "f1.py", "f3.py", "f5.py", "f6.py", "f7.py"}
    assert {r["id"] for r in over.search(spark.createDataFrame([(0, "w5 w2")], "query int, text string")).collect()} == {100, 5}
    base.delete(spark.createDataFrame([("f0.py",)], "file string"))
    assert base.read().count() == 6
    base.clear()
    assert not base.has_data()


def test_plugins(spark):
    kinds = "export enum Kind {\n  A,\n  B,\n  New,\n}\n"
    use = "switch (k) {\n  case Kind.A: x()\n  case Kind.B: y()\n}\n"
    bad = "try { a() } catch (e) {\n  return 1\n}\n"
    rows = [(1, "src/kinds.ts", 1, 5, kinds, "", "typescript"), (2, "src/use.ts", 1, 4, use, "", "typescript"), (3, "src/bad.ts", 1, 3, bad, "", "typescript"), (4, "src/doc.ts", 1, 1, "loadAll()", "loadAll", "typescript")]
    chunks = spark.createDataFrame(rows, CHUNK)
    patches = spark.createDataFrame([("src/kinds.ts", "@@ -1,4 +1,5 @@\n export enum Kind {\n   A,\n   B,\n+  New,\n }"), ("src/bad.ts", "@@ -0,0 +1,3 @@\n+try { a() } catch (e) {\n+  return 1\n+}"), ("docs/a.md", "@@ -0,0 +1 @@\n+It requires `loadAll` first.")], "file string, patch string")
    change = plugins.Change(patches, chunks.where("file in ('src/kinds.ts', 'src/bad.ts')"), chunks)
    got = {(r["plugin"], r["file"], r["line"]): r["message"] for r in plugins.review(change).collect()}
    assert set(got) == {("variants", "src/kinds.ts", 4), ("catches", "src/bad.ts", 1), ("claims", "docs/a.md", 1)}
    assert "src/use.ts handles A,B of Kind but not New" in got["variants", "src/kinds.ts", 4]
    assert plugins.review(change, ("catches",)).count() == 1
    with pytest.raises(ValueError, match="no plugin"):
        plugins.review(change, ("none",))


def test_commits_as_changes(spark, tmp_path):
    from codeloom.streaming.changes import Snapshots, commit_stream, index_stream

    inbox = tmp_path / "commits"
    inbox.mkdir()
    (inbox / "c.json").write_text("\n".join(json.dumps(x) for x in ({"sha": "1", "ts": "2024-01-01T00:00:01", "file": "a", "kind": "upsert", "content": "one"}, {"sha": "2", "ts": "2024-01-01T00:00:02", "file": "a", "kind": "upsert", "content": "two"}, {"sha": "2", "ts": "2024-01-01T00:00:02"})))
    snaps = Snapshots(spark, f"{tmp_path}/store", buckets=4)
    to_chunks = lambda df: df.select("file", "content", C.content_hash(F.col("content")).alias("content_hash"))
    index_stream(commit_stream(spark, str(inbox)), snaps, to_chunks, f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert [(r["file"], r["content"]) for r in snaps.read().collect()] == [("a", "two")]
