"""Operators over a table with every awkward case, against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import ann, cotraining, language_id, line_dedup, mixing, ngram_join, packing, queries, sharding, tiff, token_store
from codeloom.llm.common import Scratch

public_tokenizers = pytest.importorskip("public_tokenizers")


def run(spark, sf_dir, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, sf_dir).collect()]


def count_of(rows):
    return Counter(r[0] for r in rows)


@pytest.mark.parametrize("name", ["op1_tiff_pages", "op2_line_dedup", "op3_token_store", "op4_online_packing", "op5_curriculum_mix", "op7_histogram_sort", "op9_ngram_components", "op10_language_id"])
def test_an_empty_table_gives_no_rows(spark, empty, tmp_path, name):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert run(spark, str(tmp_path), name) == []


def test_tiff(spark, sf_dir, rows):
    got = run(spark, sf_dir, "op1_tiff_pages")
    assert Counter(r["doc_id"] for r in got) == count_of(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert max(r["n_pages"] for r in got) > 1


def test_tiff_says_what_is_wrong(spark):
    good = tiff.payload_tiff("abc")
    cut = good[: len(good) - 30]
    df = spark.createDataFrame([(1, None, "x"), (2, b"", "x"), (3, b"II*\0junk", "x"), (4, cut, "x"), (5, good, "x")], "doc_id long, media binary, error_ string")
    got = {r["doc_id"]: r for r in tiff.tiff_pages(df).collect()}
    assert all(got[k]["error"] and got[k]["pixels"] is None for k in (1, 2, 3, 4)) and got[5]["error"] is None


def _with_tag(data: bytes, tag: int, value: int) -> bytes:
    """data with another value in the first directory's entry of a tag."""
    at = int.from_bytes(data[4:8], "little")
    for k in range(int.from_bytes(data[at : at + 2], "little")):
        entry = at + 2 + 12 * k
        if int.from_bytes(data[entry : entry + 2], "little") == tag:
            return data[: entry + 8] + value.to_bytes(4, "little") + data[entry + 12 :]
    raise AssertionError(tag)


@pytest.mark.parametrize("codec", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
def test_tiff_claims_are_checked_before_memory_is_taken(spark, codec):
    """Sides of zero, sides beyond the file, a chain of nonsense: one error row each, whatever the codec, and no crash."""
    image = np.arange(64, dtype=np.uint8).reshape(8, 8)
    strips = tiff.write_tiff([(image, tiff.Layout(codec, rows=3))])
    tiles = tiff.write_tiff([(image, tiff.Layout(codec, tile=16))])
    huge = _with_tag(_with_tag(strips, tiff.WIDTH, 1 << 31), tiff.HEIGHT, 1 << 31)
    bad = [_with_tag(strips, tiff.STRIP_ROWS, 0), _with_tag(tiles, tiff.TILE_WIDTH, 0), _with_tag(tiles, tiff.TILE_HEIGHT, 0), _with_tag(strips, tiff.WIDTH, 0), _with_tag(strips, tiff.SAMPLES, 0), huge, _with_tag(strips, tiff.HEIGHT, 1 << 30), _with_tag(tiles, tiff.TILE_WIDTH, 1 << 31), _with_tag(strips, tiff.BITS, 7)]
    df = spark.createDataFrame([(i, b) for i, b in enumerate([*bad, strips, tiles])], "doc_id long, media binary")
    got = {r["doc_id"]: r for r in tiff.tiff_pages(df).collect()}
    assert all(got[i]["error"] and got[i]["pixels"] is None for i in range(len(bad)))
    assert all(got[i]["error"] is None and bytes(got[i]["pixels"]) == image.tobytes() for i in (len(bad), len(bad) + 1))


def test_tiff_columns_give_way_to_those_of_pages(spark):
    df = spark.createDataFrame([(1, tiff.payload_tiff("abc"), "mine", 7, "kept")], "doc_id long, media binary, error string, width int, note string")
    out = tiff.tiff_pages(df)
    assert out.columns.count("error") == out.columns.count("width") == 1
    assert out.select("doc_id", "note", "width", "error").first().asDict() == {"doc_id": 1, "note": "kept", "width": 576, "error": None}


def test_line_dedup(spark, sf_dir, rows):
    got = {r["doc_id"]: r for r in run(spark, sf_dir, "op2_line_dedup")}
    space = " \t\n\x0b\x0c\r"
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(space))
    lowest = -(1 << 63)
    held = defaultdict(set)
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(lowest if doc is None else doc)
    for doc, text, *_ in rows:
        own = lowest if doc is None else doc
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 20 or len(held[key(x)]) < 3 or max(held[key(x)]) == own]
        assert (got[doc]["n_lines"], got[doc]["n_dropped"], got[doc]["kept_sha256"]) == (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    assert sum(r["n_dropped"] for r in got.values()) > 10


def test_line_dedup_across_range_borders(spark):
    rows = [(d, "\n".join(["a line that nearly every document has", f"line of document {d} alone", "short"] * 2)) for d in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.keep_bitmaps(df, Scratch(spark, "t")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == {d: 2 if d < 299 else 0 for d in range(300)}


def test_token_store(spark, sf_dir, rows):
    from tokenizers import Tokenizer

    t, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    got = sorted(run(spark, sf_dir, "op3_token_store"), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["start"]))
    for doc, r in zip(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), got, strict=True):
        ids = np.array([*t.encode(doc[1] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], r["verified"]) == (doc[0], at, len(ids), zlib.crc32(ids.tobytes()), True)
        at += len(ids)


def test_chunks_are_stored_once(spark, docs):
    scratch = Scratch(spark, "t")
    token_store.write_store(docs, scratch.root, public_tokenizers.path("word_bpe_49k.json"))
    objects = spark.read.parquet(f"{scratch.root}/objects")
    chunks = objects.where("kind = 'chunks'")
    assert chunks.count() == chunks.select("key").distinct().count() > 0
    assert objects.where("kind = 'recipes'").count() == spark.read.parquet(f"{scratch.root}/recipes").count() == docs.count()


def test_stored_manifest_is_in_doc_id_order(spark, docs):
    """Files of a part hold ascending doc_ids, parts follow each other, starts are stored, one root covers all documents."""
    scratch = Scratch(spark, "t")
    token_store.write_store(docs, scratch.root, public_tokenizers.path("word_bpe_49k.json"))
    files = spark.read.parquet(f"{scratch.root}/recipes").select("*", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i"))
    rows = files.orderBy("part", "f", "i").collect()
    assert len({r["part"] for r in rows}) > 1
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in rows]
    assert ids == sorted(ids) and len(ids) == docs.count()
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    top = spark.read.parquet(f"{scratch.root}/top").first()
    assert (top["documents"], top["n_tokens"]) == (len(rows), at)
    parts = spark.read.parquet(f"{scratch.root}/parts").orderBy("part").collect()
    assert bytes(top["root"]) == token_store.merkle_root(bytes(p["root"]) for p in parts)
    for p in parts:
        mine = [r for r in rows if r["part"] == p["part"]]
        assert bytes(p["root"]) == token_store.merkle_root(token_store._leaf(r["doc_id"], r["n_tokens"], bytes(r["root"])) for r in mine)
    assert all(r["sound"] for r in token_store.sound_parts(spark, scratch.root).collect())


def test_changed_stores_are_found_out(spark, tmp_path):
    """A chunk with other bytes, and a recipe row that moved: verified is false for what they touch."""
    df = spark.createDataFrame([(i, f"words of document {i} and some more of them") for i in range(40)], "doc_id long, text string")
    folder = f"{tmp_path}/store"
    token_store.write_store(df, folder, public_tokenizers.path("word_bpe_49k.json"))
    assert token_store.read_store(spark, folder).where("verified").count() == 40
    objects = spark.read.parquet(f"{folder}/objects").cache()
    victim = objects.where("kind = 'chunks'").orderBy("key").first()["key"]
    bad = F.when((F.col("kind") == "chunks") & (F.col("key") == F.lit(bytes(victim))), F.unhex(F.lit("0700"))).otherwise(F.col("data"))
    objects.withColumn("data", bad).write.partitionBy("kind").parquet(f"{folder}-2/objects")
    for name in ("recipes", "parts", "top"):
        copy = spark.read.parquet(f"{folder}/{name}")
        (copy.write.partitionBy("part") if name == "recipes" else copy.write).parquet(f"{folder}-2/{name}")
    assert token_store.read_store(spark, f"{folder}-2").where("NOT verified").count() == 1
    moved = spark.read.parquet(f"{folder}/recipes").withColumn("start", F.when(F.col("doc_id") == 7, F.col("start") + 1).otherwise(F.col("start")))
    part = moved.where("doc_id = 7").first()["part"]
    moved.write.partitionBy("part").parquet(f"{folder}-3/recipes")
    for name in ("objects", "parts", "top"):
        copy = spark.read.parquet(f"{folder}/{name}")
        (copy.write.partitionBy("kind") if name == "objects" else copy.write).parquet(f"{folder}-3/{name}")
    assert {r["part"] for r in token_store.sound_parts(spark, f"{folder}-3").where("NOT sound").collect()} == {part}


def test_packing(spark, sf_dir, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = run(spark, sf_dir, "op4_online_packing")
    want = Counter()
    for doc, text, *_ in rows:
        want[doc] += len(t.encode(text or "", add_special_tokens=False).ids) + 1
    have, of_sequence = Counter(), defaultdict(list)
    for r in got:
        have[r["doc_id"]] += r["length"]
        of_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert have == want
    for pieces in of_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(of_sequence) <= sum(want.values()) / 1024 * 1.02 + 1
    ids = [*t.encode(next(r[1] for r in rows if r[0] == 63), add_special_tokens=False).ids, 0]
    for r in got:
        if r["doc_id"] == 63:
            assert zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, free, out = sum(sizes.values()), set(order), {}
    while True:
        left = total - sum(out[s] for s in order if s not in free)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return out | share
        out |= {s: 3 * sizes[s] for s in over}
        free -= over


def test_mixing(spark, sf_dir, rows):
    got = run(spark, sf_dir, "op5_curriculum_mix")
    assert Counter(r["doc_id"] for r in got) == count_of(rows)
    size, source = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}, {r[0]: r[3] for r in rows}
    totals, taken = Counter(), Counter()
    for r in rows:
        totals[r[3]] += size[r[0]]
    want = plain_targets(totals)
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == totals[source[r["doc_id"]]] and 0 <= r["taken"] <= 3 * r["size"]
        assert r["target"] == pytest.approx(want[source[r["doc_id"]]])
        taken[source[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert got == run(spark, sf_dir, "op5_curriculum_mix") or sorted(map(str, got)) == sorted(map(str, run(spark, sf_dir, "op5_curriculum_mix")))


def test_mixing_ends_in_training_order(spark, sf_dir):
    got = [r["first_position"] for r in run(spark, sf_dir, "op5_curriculum_mix")]
    assert len(got) > 60 and None in got
    assert got == sorted(got, key=lambda p: (p is None, p or 0))


@pytest.mark.parametrize("sizes", [{"a": 1000, "b": 10, "c": 10}, {"a": 5, "b": 1000, "c": 3, "d": 1, None: 400}, {"a": 0, "b": 7}, {"a": 0, None: 0}, {f"site{i}": i * i * i % 997 for i in range(300)}, {f"s{i}": 2**i for i in range(20)}, {}])
def test_targets(spark, sizes):
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), Scratch(spark, "t")).collect()}
    assert got == pytest.approx(plain_targets(sizes) if sizes else {})


def test_mixing_broadcasts_no_table_of_sources(spark, sf_dir):
    """Every broadcast holds one row for each range of a partitioning."""
    plan = queries.QUERIES["op5_curriculum_mix"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in plan


def test_mixing_columns_give_way(spark):
    df = spark.createDataFrame([(1, "a", 5, 7.0, 9, "k")], "doc_id long, source string, size long, target double, copies int, note string")
    out = mixing.curriculum(df, Scratch(spark, "t"))
    assert sorted(out.columns) == ["copies", "doc_id", "first_position", "note", "size", "source", "source_size", "target"]
    assert out.select("target", "note").first().asDict() == {"target": 5.0, "note": "k"}


def test_sharding(spark, sf_dir, rows):
    got = run(spark, sf_dir, "op7_histogram_sort")
    assert Counter(r["doc_id"] for r in got) == count_of(rows)
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    by = defaultdict(list)
    for r in got:
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(texts[r["doc_id"]]) + 1, zlib.crc32(texts[r["doc_id"]]), "bytes", None)
        assert 0 <= r["shard"] < 16
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_law_of_bytes_with_whole_groups(spark):
    """Shards near equal in bytes, each within 1.5 % of its share; groups of copies in one shard, but for one that is larger than a shard."""
    import random

    rng, rows = random.Random(12), []
    for g in range(9000):
        rows += [(g, rng.randint(50, 900))] * rng.choice([1, 1, 1, 1, 2, 2, 3, 9])
    rows += [(9001, 400)] * 6000
    df = spark.createDataFrame([(i, g, n, "mine", g % 7, "r") for i, (g, n) in enumerate(rows)], "doc_id long, g long, size long, shard string, d long, range string").withColumn("h", F.xxhash64("g"))
    for partitions in ("4", "200"):
        old = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            out = sharding.histogram_shards(df, Scratch(spark, "t"))
            assert out.columns == ["doc_id", "g", "size", "d", "range", "h", "shard", "slot"]
            got = out.collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old)
        size, slots, shards_of = Counter(), defaultdict(list), defaultdict(set)
        for r in got:
            assert (r["d"], r["range"]) == (r["g"] % 7, "r")
            size[r["shard"]] += r["size"]
            slots[r["shard"]].append(r["slot"])
            shards_of[r["g"]].add(r["shard"])
        share = sum(size.values()) / 16
        assert len(got) == len(rows) and set(size) == set(range(16))
        assert all(abs(n - share) <= 0.015 * share for n in size.values())
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert {g for g, s in shards_of.items() if len(s) > 1} == {9001}
        by_shard = sorted((r["h"], r["doc_id"], r["shard"], r["slot"]) for r in got)
        assert [x[2:] for x in by_shard] == sorted(x[2:] for x in by_shard)  # the order of (hash, doc_id) is that of (shard, slot)


def test_plan_of_sharding_is_native(spark, sf_dir):
    plan = queries.QUERIES["op7_histogram_sort"](spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_splitters_cut_a_hot_group_evenly(spark):
    keys = spark.range(4000).select((F.when(F.col("id") < 3000, F.lit(77)).otherwise(F.xxhash64("id"))).alias("h"), (F.col("id") - 500).alias("d"), F.lit(10).cast("long").alias("size"))
    cuts = sharding.splitters(keys, 16, tolerance=0.001)
    got = keys.groupBy(sharding.range_of(cuts).alias("r")).count().collect()
    assert len(got) == 16 and max(abs(r["count"] - 250) for r in got) <= 1


def test_neighbours(spark, tmp_path):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((400, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(400, None), (450, [0.0] * 16), (500, [float("nan")] * 16), (550, [None] + [1.0] * 15), (600, [1.0, 2.0]), (None, [1.0] * 16), (7, x[7].tolist())]
    spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = run(spark, str(tmp_path), "op8_prefix_forest")
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 400, 50):
        s = u @ u[q]
        s[q] = -9
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert all(r["score"] == pytest.approx(s[r["vec_id"]], abs=1e-12) for r in mine)
        hits += len({r["vec_id"] for r in mine} & set(np.argsort(-s)[:5].tolist()))
    assert {r["query_id"] for r in got} == set(range(0, 400, 50)) and hits >= 0.9 * 40


def test_few_neighbours_all_come(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = [(r["rank"], r["vec_id"]) for r in ann.nearest(df, F.col("vec_id") % 50 == 0, Scratch(spark, "t")).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2)]


def plain_components(rows):
    sets = {}
    for doc, text, *_ in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets[doc] = set(zip(w, w[1:], w[2:], strict=False)) if len(w) >= 3 else {tuple(w)} if w else set()
    parent = {d: d for d in sets if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in parent:
        for b in parent:
            if b < a and sets[a] and sets[b]:
                o = len(sets[a] & sets[b])
                if 100 * o >= 90 * (len(sets[a]) + len(sets[b]) - o):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {d: len(s) for d, s in sets.items()}, {d: root(d) for d in parent} | {None: None}


def test_components(spark, sf_dir, rows):
    sizes, want = plain_components(rows)
    got = run(spark, sf_dir, "op9_ngram_components")
    assert Counter(r["doc_id"] for r in got) == count_of(rows)
    assert all((r["n_shingles"], r["component_id"]) == (sizes[r["doc_id"]], want[r["doc_id"]]) for r in got)


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_unlike_documents_of_common_passages_dont_meet(spark, monkeypatch, width, percent):
    """Documents of passages that many have may all link as far as their shared shingles are counted; their sets don't travel."""
    import random

    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "SKETCHES", 16)  # several blocks of these as well
    rng, made = random.Random(11), {}

    class Kept(Scratch):
        def table(self, df, name, *args, **more):
            made.setdefault(name, []).append(out := super().table(df, name, *args, **more))
            return out

    passages = [" ".join(f"p{i}w{j}" for j in range(60)) for i in range(40)]
    texts = [" ".join(rng.sample(passages, 20)) for _ in range(40)]
    rows = list(enumerate(texts)) + [(100 + d, text + f" more{d}") for d, text in enumerate(texts[:5])]
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string"), Kept(spark, "t"), width, percent).collect()}
    assert found == {d: d % 100 for d, _ in rows}
    assert made["gatherings"][0].count() == len(rows)
    assert made["gatherings"][-1].count() <= 10


def test_groups_of_long_documents_are_bound_by_their_shingles(spark, monkeypatch):
    """20 documents fit a block by number, not by length; what meets in several blocks links all the same."""
    import random

    monkeypatch.setattr(ngram_join, "SHINGLES", 500, raising=False)
    kind, groups = type(spark.range(1)), []
    real = kind.groupBy

    def seen(self, *keys):
        if all(isinstance(k, str) for k in keys) and {"block", "left"} & set(keys):
            groups.append(max((r["count"] for r in real(self, *keys).count().collect()), default=0))
        return real(self, *keys)

    monkeypatch.setattr(kind, "groupBy", seen)
    rng = random.Random(2)
    rows = []
    for d in range(20):
        w = [f"w{i}" for i in range(200)]
        for i in rng.sample(range(200), rng.choice([1, 2, 9])):
            w[i] = f"x{d}_{i}"
        rows.append((d, " ".join(w)))
    _, want = plain_components(rows)
    got = ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {d: c for d, c in want.items() if d is not None}
    assert groups and max(groups) <= 10, groups


@pytest.mark.parametrize(("block", "few"), [(4, 2), (256, 8), (4, 50)])
def test_components_of_many_near_copies(spark, monkeypatch, block, few):
    """A large gathering with outliers, met block by block."""
    import random

    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "FEW", few)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for d in range(40):
        w = list(base)
        for i in rng.sample(range(100), rng.choice([0, 1, 1, 2, 3, 6])):
            w[i] = f"x{d}_{i}"
        rows.append((d, " ".join(w)))
    rows += [(100 + d, " ".join(f"v{d}_{i}" for i in range(50))) for d in range(10)] + [(200, "one two"), (201, "one  two"), (202, "one"), (203, None)]
    _, want = plain_components(rows)
    got = ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {d: c for d, c in want.items() if d is not None}
    assert len(set(want.values())) < len(rows)


def test_connected_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 90), (90, 95), (7, 7)]
    got = {r["node"]: r["label"] for r in ngram_join.connected(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(61)} | {90: 90, 95: 90, 100: 90}


def test_language(spark):
    import random

    rng = random.Random(3)
    make = lambda syllables: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(40))
    kinds = {"aa": ["tho", "ing", "er", "and"], "bb": ["ção", "lha", "os", "em"], "cc": ["sch", "ü", "ung", "ein"]}
    rows = [(i, make(kinds[k]), k if i % 7 else None, "s") for i, k in enumerate(list(kinds) * 60)] + [(900, None, "aa", "s"), (901, "12 !!", "bb", "s"), (None, "thoing", "aa", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score_ string")
    got = language_id.predict(df, language_id.fit(df, ~language_id.held_out())).collect()
    true = {r[0]: list(kinds)[r[0] % 3] for r in rows if r[0] is not None and r[0] < 900}
    assert all(r["lang_pred"] == true[r["doc_id"]] and 0 < r["score"] <= 1 for r in got if r["doc_id"] in true)
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in got if r["doc_id"] in (900, 901))
    assert language_id.predict(df, {}).where("lang_pred <> 'und'").count() == 0


def plain_languages(rows, some=None):
    """Brute force: profiles as sums over every trigram of the training texts, then the largest cosine for some of the rows."""
    from tests.llm.test_units import plain_bundle

    profiles = {}
    for doc, text, lang, *_ in rows:
        if lang is not None and not (doc is not None and zlib.crc32(str(doc).encode()) % 3 == 1) and (t := language_id.trigrams(text)) is not None:
            weights = t[1] * language_id._SCALE // t[1].sum()
            own = (weights.astype(object) @ language_id.bind(t[0]).astype(object)).astype(np.int64)
            profiles[lang] = profiles.get(lang, 0) + own
    for _, text, *_ in rows if some is None else some:
        found = plain_bundle(text) if text and any(ch.isalpha() for ch in text) else None
        if found is None:
            yield "und", 0.0
        else:
            cos = {x: float(found @ p / np.linalg.norm(found) / np.linalg.norm(p.astype(float))) for x, p in profiles.items()}
            best = max(sorted(cos), key=cos.get)
            yield best, min(1.0, max(0.0, cos[best]))


def test_languages_equal_brute_force(spark, rows):
    some = [r for r in rows if r[0] != 63]
    got = language_id.predict(spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(some)], "at long, doc_id long, text string, lang string"), language_id.fit(spark.createDataFrame([r[:3] for r in some], "doc_id long, text string, lang string"), ~language_id.held_out())).orderBy("at").collect()
    for r, (lang, score) in zip(got, plain_languages(some), strict=True):
        assert r["score"] == pytest.approx(score, abs=1e-6) and (r["lang_pred"] == lang or score < 1e-9)


def test_language_columns_give_way(spark):
    df = spark.createDataFrame([(1, "some text", "en", 7, "x")], "doc_id long, text string, lang string, score int, lang_pred string")
    out = language_id.predict(df, language_id.fit(df, F.lit(True)))
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and out.select("lang_pred").first()[0] == "en"


def test_language_rule_for_held_out_rows(spark, sf_dir, rows):
    got = run(spark, sf_dir, "op10_language_id")
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert Counter(r["doc_id"] for r in got) == count_of(rows)


def test_co_training(spark):
    import random

    rng = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        good = i % 3 > 0
        text = " ".join(rng.choice(["calm", "plain", "steady"] if good else ["BUY!!", "WIN!!", "CASH!!"]) + (str(rng.randint(0, 50)) if good else "") for _ in range(20))
        rows.append((i, text, "good.example" if good == (rng.random() < 0.9) else "bad.example", "en", len(text)))
        if i % 2:
            labels.append((i, int(good), int(i % 30 == 1)))
    rows += [(1000, None, None, None, None), (None, "calm plain", "x", "en", 3), (1, rows[1][1], rows[1][2], "en", rows[1][4])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    known = spark.createDataFrame(labels + [(None, 1, 0), labels[0]], "doc_id long, quality int, toxic int")
    got = cotraining.quality_scores(df, known, Scratch(spark, "t")).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    right = [(r["score"] >= 0.5) == (r["doc_id"] % 3 > 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 900 and r["doc_id"] % 2 == 0]
    assert np.mean(right) > 0.97
    few = cotraining.quality_scores(df, known, Scratch(spark, "t"), cotraining.Setting(labelled=120)).collect()
    assert len(few) == len(rows) and np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 3 > 0) for r in few if r["doc_id"] is not None and r["doc_id"] < 900]) > 0.95
    none = cotraining.quality_scores(df, known.limit(0), Scratch(spark, "t")).collect()
    assert all(r["score"] == 0.5 and r["keep"] for r in none)


def test_exchange_counts_every_unlabelled_row(spark):
    """What views tell each other, against a plain loop; twice the rows tell twice as much."""
    import random

    rng, rows, labels = random.Random(3), [], []
    for i in range(1200):
        good = i % 2
        rows.append((i, " ".join(rng.choice(["calm", "plain"] if good else ["WIN!!", "CASH!!"]) + str(rng.randint(0, 9)) for _ in range(12)), f"site{rng.randint(0, 3) + 4 * good}", "en", 60))
        if i < 200:
            labels.append((i, good))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    table = Scratch(spark, "t").table(cotraining.feature_table(docs).join(spark.createDataFrame(labels, "doc_id long, quality int"), "doc_id", "left"), "features")
    setting = cotraining.Setting(labelled=100)
    label = {"quality": F.col("quality")}
    sample = cotraining.labelled_sample(table, F.col("quality"), setting)
    assert len(sample.y) + len(sample.y_held) == 100
    model, sure = sample.model(setting, [None, None]), sample.sure(setting.confident)
    told = cotraining.exchange(table, label, {"quality": model}, {"quality": sure})["quality"]
    free = [r for r in table.collect() if r["quality"] is None]
    packed = [bytes(r["text_ids"]) for r in free], [bytes(r["meta_ids"]) for r in free]
    p_text, p_meta, _ = model.scores(packed)
    for view, p in ((0, p_meta), (1, p_text)):
        for c, chosen in ((0, 1 - p >= sure[0]), (1, p >= sure[1])):
            want = Counter(f for k in np.flatnonzero(chosen) for f in np.frombuffer(packed[view][k], np.uint16).tolist())
            assert told[view].documents[c] == chosen.sum() > 100
            assert {int(f): int(told[view].counts[c][f]) for f in np.flatnonzero(told[view].counts[c])} == want
    twice = cotraining.exchange(table.unionByName(table), label, {"quality": model}, {"quality": sure})["quality"]
    assert [x.documents for x in twice] == [(2 * a, 2 * b) for a, b in (x.documents for x in told)]


def test_ratios_reach_the_model():
    """Features that the labelled rows never show get weights from what the other view told."""
    rng = np.random.default_rng(2)
    y = (rng.random(400) < 0.5).astype(float)
    packed = [np.unique(np.array([1 + int(v), 10 + rng.integers(0, 5), *( [20] if v and rng.random() < 0.5 else [])], np.uint16)).tobytes() for v in y]
    counts = np.zeros(64), np.zeros(64)
    counts[1][[2, 30]], counts[0][[1, 31]] = 500, 500
    ratios = cotraining.Exchange(counts, (500, 500)).ratios(3, 3.0)
    assert ratios[30] > 3 and ratios[31] < -3 and ratios[10] == 0
    w, b = cotraining.fit(packed, y, 64, 3, 3.0, ratios)
    assert w[30] > 0 > w[31]
    plain = cotraining.fit(packed, y, 64, 3, 3.0)
    assert plain[0][30] == plain[0][31] == 0
    right = (cotraining.margins(packed, w, b) > 0) == (y > 0)
    assert right.all()
    few = cotraining.Exchange(counts, (500, 5)).ratios(3, 3.0)
    assert not few.any()


def test_quality_of_empty_tables(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert run(spark, str(tmp_path), "op6_cotraining_quality") == [] and run(spark, str(tmp_path), "op8_prefix_forest") == []


def test_score_columns_give_way(spark):
    df = cotraining.feature_table(spark.createDataFrame([(1, "a b", "s", "en", 3)], "doc_id long, text string, source string, lang string, n_chars long")).withColumn("quality", F.lit("mine"))
    out = cotraining.score(df, {"quality": None})
    assert out.columns.count("quality") == 1 and out.first()["quality"] == 0.5


def test_padding_of_a_few_windows(spark):
    df = spark.createDataFrame([(i, "word " * (i % 90 + 1)) for i in range(400)], "doc_id long, text string").repartition(23)
    got = packing.pack(df, Scratch(spark, "t"), public_tokenizers.path("byte_bpe_50k.json"), fan_in=4, open_windows=4).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert len(got) <= math.ceil(sum(r["n"] for r in got) / 1024) + 4
