"""Queries over whole tables against plain versions on small fixtures."""

import hashlib

import pytest

from codeloom import catalog


def rows_of(spark, name, sf_dir):
    return [tuple(r) for r in catalog.queries()[name](spark, sf_dir).collect()]


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("texts")
    texts = [None, "", "one of the lines"] + ["\n".join(f"line {i} {'of the' if i % 7 == d % 7 else 'or'} text {d}" for i in range(n)) for d, n in enumerate((39, 40, 41, 90, 300))]
    rows = [(d, text, "en", f"s{d % 2}", 0) for d, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return str(folder), rows


def plain_diff(rows):
    """file, line, sign, text of every line: each fourth is added, the next one removed, the others are context."""
    for doc, text, _, source, _ in rows:
        at = 10
        for i, line in enumerate((text or "").split("\n")):
            sign = "+-  "[i % 4]
            yield f"{source}/{doc}.md", None if sign == "-" else at, sign, line
            at += sign != "-"


def test_diff_lines_of_whole_texts(spark, long_texts):
    folder, rows = long_texts
    want = [(f, n, sign, hashlib.md5(text.encode()).hexdigest()) for f, n, sign, text in plain_diff(rows)]
    key = lambda r: tuple(map(str, r))
    assert sorted(rows_of(spark, "a13_diff_lines", folder), key=key) == sorted(want, key=key)


def test_touched_chunks_of_whole_texts(spark, long_texts):
    folder, rows = long_texts
    touched = {(f, n) for f, n, *_ in plain_diff(rows)}
    want = set()
    for doc, text, _, source, _ in rows:
        lines = (text or "").split("\n")
        for k in range(max(1, -(-(len(lines) - 75) // 65) + 1)):
            window = range(k * 65 + 1, min(k * 65 + 75, len(lines)) + 1)
            if any(lines[n - 1].strip() for n in window) and any((f"{source}/{doc}.md", n) in touched for n in window):
                want.add(doc * 1_000_000 + k)
    assert {r[0] for r in rows_of(spark, "j25_touched_chunks", folder)} == want
    assert 7_000_003 in want


def test_untrusted_input_of_whole_texts(spark, tmp_path):
    rows = [(1, "\n".join("all of the rest" if i in (0, 44, 80) else "plain" for i in range(90)), "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((f, n) for f, n, sign, text in plain_diff(rows) if sign == "+" and "of the" in text)
    assert sorted(rows_of(spark, "n12_untrusted_input", str(tmp_path))) == want and len(want) == 3


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("parts")
    spark.createDataFrame([(k, f"Brand#{k % 5}", f"TYPE {k % 7}") for k in range(1, 81)], "p_partkey long, p_brand string, p_type string").write.parquet(f"{folder}/part.parquet")
    # A specifier names part (7 * part + 13 * supplier) % 997 + 1; those from 81 on are no file.
    spark.createDataFrame([(k, s) for k in range(1, 81) for s in range(1, 400) if (7 * k + 13 * s) % 997 < (80 if k > 70 else 20)], "l_partkey long, l_suppkey long").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def plain_hops(edges, files):
    """seed -> {node: hops} by breadth-first search from every file over (importer, file) edges."""
    importers = {}
    for importer, file in edges:
        importers.setdefault(file, set()).add(importer)
    out = {}
    for seed in files:
        found, frontier = {seed: 0}, {seed}
        for hops in (1, 2):
            frontier = {n for f in frontier for n in importers.get(f, ())} - set(found)
            found |= dict.fromkeys(frontier, hops)
        out[seed] = {n: h for n, h in found.items() if h}
    return out


def test_hops_from_every_file(spark, parts):
    files = {r[0] for r in rows_of(spark, "g1_dependent_counts", parts)}
    want = plain_hops(rows_of(spark, "j1_import_edges", parts), files)
    assert len(files) == 80 and sum(1 for f, x in want.items() if x and int(f.rsplit("/m", 1)[1]) > 20) > 20
    assert sorted(rows_of(spark, "x3_dependents_by_hops", parts)) == sorted((s, n, h) for s, x in want.items() for n, h in x.items())
    assert sorted(rows_of(spark, "x7_blast_radius", parts)) == sorted((s, len(x), max(x.values())) for s, x in want.items() if x)
    capped = []
    for s, x in want.items():
        ranked = sorted((h, n) for n, h in x.items())
        capped += [(s, n, h, len(x) > 30) for i, (h, n) in enumerate(ranked) if i < 30 or h == 1]
    assert sorted(rows_of(spark, "x3_capped", parts)) == sorted(capped)
    assert any(row[3] for row in capped) and any(not row[3] for row in capped)
