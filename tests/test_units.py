"""Thresholds, path rules, chunkers, streams."""

import json

import pytest
from pyspark.sql import functions as F

from codeloom.chunkers import files as ch
from codeloom.engine import Engine
from codeloom.functions import columns as C
from codeloom.operators import events, metrics, signals, store
from codeloom.streaming.changes import Snapshots, change_stream, index_stream


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_risk_borders(spark):
    n = [(5,), (6,), (15,), (16,), (30,), (31,)]
    assert values(spark, n, "n int", C.count_risk(F.col("n"))) == ["low", "medium", "medium", "high", "high", "critical"]
    b = [(5, 0, False), (5, 1, False), (6, 0, False), (20, 0, True), (21, 0, False), (21, 1, True), (51, 0, False)]
    assert values(spark, b, "n int, u int, c boolean", C.blast_risk(F.col("n"), F.col("u"), F.col("c"))) == ["low", "medium", "medium", "high", "high", "critical", "critical"]


def test_violation_borders(spark):
    df = spark.createDataFrame([("f", v, 0, 0.0, 0.0) for v in (14, 15, 29, 30)], "file string, cyclomatic int, cognitive int, effort double, bugs double")
    got = metrics.violations(df).select("value", "severity").orderBy("value").collect()
    assert [tuple(r) for r in got] == [(15.0, "warning"), (29.0, "warning"), (30.0, "error")]


def test_bands_and_rounding(spark):
    from codeloom.operators.search import band

    assert values(spark, [(0.29,), (0.3,), (0.5,), (0.75,)], "r double", band(F.col("r"))) == ["not_relevant", "loosely_related", "relevant", "highly_relevant"]
    assert values(spark, [(-2.5,), (2.5,), (0.25,)], "r double", C.half_up(F.col("r"))) == [-2.0, 3.0, 0.0]


@pytest.mark.parametrize(("before", "after", "want"), [(None, 14, "new_under"), (None, 15, "new_over"), (None, 16, "new_over"), (14, None, "removed"), (15, None, "removed"), (14, 14, "unchanged"), (14, 15, "crossed"), (14, 16, "crossed"), (15, 14, "improved"), (15, 15, "unchanged"), (15, 16, "pre_existing"), (16, 14, "improved"), (16, 15, "pre_existing"), (16, 16, "unchanged"), (20, 18, "pre_existing"), (18, 20, "pre_existing"), (13, 14, "worsened"), (14, 13, "improved")])
def test_verdicts(spark, before, after, want):
    assert values(spark, [(before, after)], "b int, a int", metrics.verdict(F.col("b"), F.col("a"), 15)) == [want]


def test_most_severe_verdict(spark):
    rows = [("improved", "worsened", "worsened"), ("removed", "removed", "removed"), ("pre_existing", "worsened", "pre_existing"), ("new_under", "new_over", "new_over"), ("crossed", "new_over", "crossed"), (None, "unchanged", "unchanged"), (None, None, None)]
    df = spark.createDataFrame(rows, "a string, b string, want string").select("want", metrics.function_verdict([F.col("a"), F.col("b")]).alias("got"))
    assert all(r["want"] == r["got"] for r in df.collect())


def test_blast_floor_and_reasons(spark):
    rows = [(0, 0, False, 0, None, "low", ""), (1, 1, False, 0, "low", "medium", "1 caller, 1 untested"), (14, 3, True, 18, None, "high", "14 callers, 3 untested, max complexity 18, untested high-complexity dependent"), (2, 0, False, 31, "critical", "high", "2 callers, max complexity 31, critical-complexity dependent regardless of test coverage"), (2, 0, False, 12, "high", "medium", "2 callers, max complexity 12, high-complexity dependent regardless of test coverage"), (21, 0, False, 0, "critical", "high", "21 callers"), (51, 0, True, 0, "critical", "critical", "51 callers, untested high-complexity dependent")]
    n, u, c, t, b = (F.col(x) for x in "nuctb")
    df = spark.createDataFrame(rows, "n int, u int, c boolean, t int, b string, want string, why string")
    for r in df.select("want", "why", C.blast_risk(n, u, c, b).alias("got"), F.array_join(C.blast_reasons(n, u, c, t, b), ", ").alias("said")).collect():
        assert (r["got"], r["said"]) == (r["want"], r["why"])


def test_simplicity_borders(spark):
    def rows(file, classes, methods):
        return [(file, "class", None, 1, 9)] * classes + [(file, "method", c, 1, n) for c, n in methods]

    df = spark.createDataFrame(rows("a", 3, [(2, 5)]) + rows("b", 3, [(3, 5)]) + rows("c", 3, [(2, 6)]) + rows("d", 2, [(1, 1)]) + rows("e", 1, [(1, 1)]) + rows("f", 4, []) + rows("g", 3, [(None, 4), (3, 6)]), "file string, symbol_type string, complexity int, start_line int, end_line int")
    assert {r["file"]: r["flagged"] for r in metrics.simplicity(df).collect()} == {"a": True, "b": False, "c": False, "d": False, "f": False, "g": True}


def test_hash_of_large_files_goes_by_bytes(spark):
    import hashlib

    for text in ("ü" * 600_000 + "end", "x" * (1 << 20), "x" * ((1 << 20) + 1), "small ü"):
        raw = text.encode()
        want = "L" + hashlib.sha256(raw[:8192] + raw[-8192:] + str(len(raw)).encode()).hexdigest()[:15] if len(raw) > 1 << 20 else hashlib.sha256(raw).hexdigest()[:16]
        assert values(spark, [(text,)], "t string", C.content_hash(F.col("t"))) == [want]


def test_unsafe_patterns():
    assert store.safe_pattern("(a+)+$") is None and store.safe_pattern("(a|a)*") is None and store.safe_pattern("[") is None and store.safe_pattern("x" * 257) is None
    assert store.safe_pattern("^get") == "(?i)^get"


def test_windows_and_boundary(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",), ("2023-12-31 23:59:59",), (None,)], "t string").select(F.col("t").cast("timestamp_ntz").alias("ts"))
    assert events.within(df, 7, "2024-01-08 00:00:00").count() == 1


def test_diff_lines(spark):
    patch = "@@ -1,2 +5,3 @@ def f\n a\n-b\n+c\n+d\n@@ -9 +20 @@\n-x\n+y\n\\ No newline at end of file"
    got = signals.diff_lines(spark.createDataFrame([("f", patch)], "file string, patch string")).collect()
    assert [(r["line"], r["sign"], r["text"]) for r in got] == [(5, " ", "a"), (None, "-", "b"), (6, "+", "c"), (7, "+", "d"), (None, "-", "x"), (20, "+", "y")]


@pytest.mark.parametrize(("n", "want"), [(0, 0), (1, 1), (74, 1), (75, 1), (76, 2), (140, 2), (141, 3)])
def test_line_windows(spark, n, want):
    from codeloom.sources.adapters import line_windows

    content = "\n".join("x" for _ in range(n))
    assert len(ch.windows(content.split("\n"))) == want
    assert line_windows(spark.createDataFrame([("f", content)], "file string, content string")).count() == want


def test_markdown():
    text = "intro\n# A\nbody\n```\n# no heading\n```\n## B\nmore\n# C\n"
    assert [(c["symbol_name"], c["start_line"], c["end_line"]) for c in ch.markdown(text)] == [(None, 1, 1), ("A", 2, 6), ("A > B", 7, 8), ("C", 9, 10)]


def test_yaml_json_liquid():
    assert [c["symbol_name"] for c in ch.yaml("a: 1\nb:\n  - x\n")] == ["a", "b"]
    assert [c["symbol_name"] for c in ch.yaml("a: 1\n---\nb: 2\n")] == ["doc[0].a", "doc[1].b"]
    assert ch.json_template(json.dumps({"sections": {"m": {"type": "main"}}}))[0]["imports"] == ["sections/main"]
    got = ch.liquid("{% comment %}{% render 'no' %}{% endcomment %}\n{% render 'card' %}\n{% schema %}\n{}\n{% endschema %}\n")
    assert got[0]["imports"] == ["card"] and got[-1]["symbol_name"] == "schema"


def test_python():
    source = "import os\nfrom a.b import c\n\nclass K:\n    x = 1\n    def m(self, v):\n        if v and v > 1 or v < 0:\n            for i in v:\n                os.f(i)\n        return v\n\ndef g():\n    return c()\n"
    got = {c["symbol_name"]: c for c in ch.python(source)}
    assert got["m"]["parent"] == "K" and got["m"]["complexity"] == 5 and got["m"]["calls"] == ["f"] and got["g"]["complexity"] == 1
    assert got["m"]["cognitive"] == 1 + 2 + 2 and got["g"]["imports"] == ["os", "a.b"]
    assert len(ch.python("def broken(:\n")) == 1


def test_engine(spark):
    rows = [(i, f"src/m{i}.py", 1, 3, f"def load{i}(): return parse(config{i})", "python", f"load{i}", "function") for i in range(20)]
    e = Engine(spark.createDataFrame(rows, "id long, file string, start_line int, end_line int, content string, language string, symbol_name string, symbol_type string"), spark.createDataFrame([("src/m1.py", "src/m0.py"), ("src/m2.py", "src/m1.py")], "importer string, specifier string"))
    assert e.search("config7", 3).first()["file"] == "src/m7.py"
    assert [tuple(r)[:2] for r in e.dependents("src/m0.py", 2).collect()] == [("src/m1.py", 1), ("src/m2.py", 2)]
    assert e.list_symbols("^load1", limit=5).count() == 5 and e.annotate("src/m0.py").first()["dependents"] == 1
    assert e.files_context(["src/m3.py"]).first()["dependents"] is None
    with pytest.raises(ValueError, match="limit"):
        e.search("x", 51)
    with pytest.raises(ValueError, match="paths"):
        e.dependents("../x")


def test_change_stream(spark, tmp_path):
    to_chunks = lambda df: df.select("file", "content", F.substring(F.sha2("content", 256), 1, 16).alias("content_hash"))
    snaps = Snapshots(spark, f"{tmp_path}/store")
    snaps.publish(to_chunks(spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "file string, content string")))
    inbox = tmp_path / "in"
    inbox.mkdir()
    changes = [("a", "upsert", "2024-01-01T00:00:01", "old"), ("a", "upsert", "2024-01-01T00:00:02", "new"), ("b", "delete", "2024-01-01T00:00:01", None), ("c", "upsert", "2024-01-01T00:00:01", "3"), ("d", "upsert", "2024-01-01T00:00:01", "4")]
    (inbox / "x.json").write_text("\n".join(json.dumps(dict(zip(("file", "kind", "ts", "content"), c, strict=True))) for c in changes))
    for _ in range(2):  # the second run finds nothing new
        index_stream(change_stream(spark, str(inbox)), snaps, to_chunks, f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["file"], r["content"]) for r in snaps.read().collect()) == [("a", "new"), ("c", "3"), ("d", "4")]
    assert snaps.version() == 1


def test_change_stream_into_an_empty_store(spark, tmp_path):
    """The first batch builds the store, a second one replaces files of the buckets that it touches, a large file that didn't change is
    known by its hash."""
    to_chunks = lambda df: df.select("file", "content", C.content_hash(F.col("content")).alias("content_hash"))
    snaps, inbox = Snapshots(spark, f"{tmp_path}/store", buckets=8), tmp_path / "in"
    inbox.mkdir()
    big = "ü" * 600_000

    def go(name, changes):
        (inbox / name).write_text("\n".join(json.dumps(dict(zip(("file", "kind", "ts", "content"), c, strict=True))) for c in changes))
        index_stream(change_stream(spark, str(inbox)), snaps, to_chunks, f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    assert snaps.read() is None and snaps.version() == -1
    go("a.json", [(f"f{i}", "upsert", "2024-01-01T00:00:01", str(i)) for i in range(20)] + [("big", "upsert", "2024-01-01T00:00:01", big)])
    assert snaps.version() == 1 and snaps.read().count() == 21
    before = snaps._current()
    go("b.json", [("f3", "delete", "2024-01-01T00:00:02", None), ("f4", "upsert", "2024-01-01T00:00:02", "new"), ("big", "upsert", "2024-01-01T00:00:02", big)])
    got = {r["file"]: r["content"] for r in snaps.read().collect()}
    assert len(got) == 20 and "f3" not in got and got["f4"] == "new" and got["big"] == big
    after = snaps._current()
    assert 0 < sum(after.get(b) != v for b, v in before.items()) <= 2
    assert snaps.publish(spark.createDataFrame([("z", "1", "h")], "file string, content string, content_hash string")) == 3 and snaps.read().count() == 1


def test_reindex_state_and_stale_counts(spark):
    from codeloom.streaming.changes import counted, reindex_state

    done = [{"batchDuration": 70, "numInputRows": 3}, {"batchDuration": 50, "numInputRows": 2}]
    assert reindex_state(done, 10) == {"in_progress": False, "batches": 2, "rows": 5, "last_duration_ms": 50, "stuck": False}
    assert reindex_state([*done, {"started_ms": 0}], 300_001)["stuck"] and not reindex_state([*done, {"started_ms": 0}], 300_000)["stuck"]
    chunks = spark.createDataFrame([("a",), ("b",)], "file string")
    counts = spark.createDataFrame([("a", 3)], "file string, dependents long")
    assert [(r["dependents"], r["stale"]) for r in counted(chunks, counts, 5, 4).orderBy("file").collect()] == [(3, True), (0, True)]
    assert [(r["dependents"], r["stale"]) for r in counted(chunks, None, 5, None).collect()] == [(None, None)] * 2
    assert not counted(chunks, counts, 4, 4).first()["stale"]


def test_version_checks():
    assert store.newer(5, 4, 2000, 1000) == (True, 2000) and store.newer(5, 5, 2000, 1000) == (False, 2000) and store.newer(9, 1, 1999, 1000) == (False, 1000)
