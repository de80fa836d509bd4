"""The pipeline over the awkward table."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_the_columns(spark, sf_dir, docs):
    from codeloom.llm.common import Scratch

    scratch, at = Scratch(spark, "t"), docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = scratch.table(stage(spark, at, sf_dir), name)
        assert at.columns == docs.columns
        ids = {r["doc_id"] for r in at.select("doc_id").collect()}
        if name == "language_id":
            assert not ids & {60, 61, 62} and {0, 63, 64} <= ids
        if name == "line_dedup":
            shared = at.where("text like '%This very line%'").count()
            assert shared == 1
        if name == "ngram_join":
            # Line dedup has emptied all copies but one, which links with the near copies; empty texts link with nothing.
            assert at.where("(doc_id between 70 and 81 or doc_id < 60 and doc_id % 10 = 3) and text <> ''").count() == 1
    assert corpus_pipeline.STAGES[-1][1](spark, at, sf_dir).count() > 0


def test_run_and_empty(spark, sf_dir, empty, tmp_path):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def plain_near_duplicates(rows, width=5, percent=80):
    """Ids that stay: all pairs are compared, linked documents are joined, the smallest doc_id of each component stays."""
    sets = {}
    for doc, text in rows:
        w = text.lower().split()
        sets[doc] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    label = {d: d for d in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {d: low if c == high else c for d, c in label.items()}
    return {d for d, c in label.items() if d == c}


def test_near_copies_from_four_fifths_go(spark, sf_dir):
    """Similarities of 0.8 to 0.9 on five words, and a copy just below 0.8 that stays."""
    rows = []
    for case in range(6):
        base = [f"w{case}x{i}" for i in range(200)]
        changed = {0: 4, 1: 5}.get(case)
        if changed:
            copy = [f"other{case}x{i}" if i % 40 == 20 and i // 40 < changed else x for i, x in enumerate(base)]
        else:
            copy = base + [f"more{case}x{i}" for i in range({2: 30, 3: 45, 4: 49, 5: 50}[case])]
        rows += [(2 * case, " ".join(base)), (2 * case + 1, " ".join(copy))]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir)
    got = {r["doc_id"] for r in got.collect()}
    assert got == plain_near_duplicates(rows)
    assert {1, 5, 7, 9} & got == set() and {3, 11} <= got


def plain_mix(rows, targets):
    """Rows (doc_id, text, source) as often as the mix takes them: whole, while the words before a copy are below the target."""
    sources, out = defaultdict(list), Counter()
    for r in rows:
        sources[r[2]].append((hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest(), len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")), r))
    for source, docs in sources.items():
        at, whole = 0, sum(size for _, size, _ in docs)
        for _, size, r in sorted(docs, key=lambda x: x[:2]):
            out[r] += sum(size > 0 and k * whole + at < round(targets[source]) for k in range(3))
            at += size
    return +out


def test_mix_takes_whole_documents(spark, sf_dir, docs, rows):
    from codeloom.llm import mixing
    from codeloom.llm.common import Scratch

    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    goals = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), Scratch(spark, "t")).collect()}
    want = plain_mix([(r[0], r[1], r[3]) for r in rows], goals)
    got = corpus_pipeline.mix_sources(spark, docs, sf_dir).collect()
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in got) == want
    assert any("\n" in r["text"] for r in got)


def plain_lines(rows):
    """Drops lines of 20 code points or more that three documents have, but in the largest doc_id that has them."""
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    own = lambda r: -1 if r[0] is None else r[0]
    held = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(own(r))
    for r in rows:
        kept = [x for x in (r[1] or "").split("\n") if len(held[key(x)]) < 3 or max(held[key(x)]) == own(r)]
        yield (r[0], r[1] if len(kept) == len((r[1] or "").split("\n")) else "\n".join(kept), *r[2:])


def test_rows_of_the_whole_pipeline(spark, sf_dir, rows):
    """Language, lines, near copies, mix and packing in plain Python: the documents that are packed, and every id of them."""
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from codeloom.llm import language_id, mixing
    from codeloom.llm.common import Scratch
    from tests.llm.test_operators import plain_languages

    short = [r for r in rows if r[0] != 63]  # the long text alone is left to the library, brute force takes minutes on it
    said = dict(zip((id(r) for r in short), plain_languages(rows, short), strict=True))
    letters = lambda t: sum(ch.isalpha() for ch in t or "")
    known = [r for r in rows if r[0] == 63 or (said[id(r)][0] != "und" and not (said[id(r)][1] < corpus_pipeline.LEAST_SCORE and letters(r[1]) >= corpus_pipeline.LETTERS))]
    assert language_id.trigrams(next(r[1] for r in rows if r[0] == 63)) is not None
    lines = list(plain_lines(known))
    kept = plain_near_duplicates([(r[0], r[1]) for r in lines if r[0] is not None])
    apart = [r for r in lines if r[0] is None or r[0] in kept]
    sizes = Counter()
    for r in apart:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    goals = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), Scratch(spark, "t")).collect()}
    mixed = plain_mix([(r[0], r[1], r[3]) for r in apart], goals)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    ids_of = {}
    for (doc, text, _), n in mixed.items():
        ids_of[doc] = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want[doc] += n * len(ids_of[doc])
    got, sequences = Counter(), defaultdict(list)
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        got[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        piece = ids_of[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert (len(piece), zlib.crc32(piece.tobytes()), len(ids_of[r["doc_id"]])) == (r["length"], r["ids_crc32"], r["doc_tokens"])
    assert got == want
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024

