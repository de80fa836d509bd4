"""Pure functions: codecs, hashes, tokens, tries."""

import random
import time
import tracemalloc
import zlib
from operator import itemgetter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import language_id, line_dedup, mixing, ngram_join, packing, tiff, token_store, tokens
from codeloom.llm.tokens import Encoder

public_tokenizers = pytest.importorskip("public_tokenizers")
_ENCODERS = {}


def encoder(name, spaces):
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(public_tokenizers.path(name), spaces)
    return _ENCODERS[name]


def library_ids(name, text):
    """What a tokenizer of its own gives, untouched by the encoder."""
    from tokenizers import Tokenizer

    if (name, None) not in _ENCODERS:
        _ENCODERS[name, None] = Tokenizer.from_file(public_tokenizers.path(name))
    return _ENCODERS[name, None].encode(text, add_special_tokens=False).ids


BOTH = pytest.mark.parametrize(("name", "spaces"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
_PIECES = st.sampled_from([*" \n\t'sStlLmMvVeErRdD.,!|é9²ſIİßœ–中😀<>\x1c\x85̇", "<|endoftext|>", "<|startoftext|>", "'ſ", "'S", "'re", "  ", "\n ", " \n", "\n\n", "word", "Words.", " the", "12"])


@BOTH
@settings(max_examples=600, deadline=None)
@given(st.one_of(st.lists(_PIECES, max_size=30).map("".join), st.text(alphabet=st.characters(codec="utf-8"), max_size=60)))
def test_ids_equal_those_of_whole_texts(name, spaces, text):
    assert encoder(name, spaces).ids(text).tolist() == library_ids(name, text)


@BOTH
@pytest.mark.parametrize("text", ["hello <|endoftext|> world", "a<|startoftext|>b", "<|endoftext|>", "HELLO <|ENDOFTEXT|> x", "it'ſ ok", "IT'S ſo", "<|endoftext", "x\n<|endoftext|>\n\n y"])
def test_added_tokens_and_long_s(name, spaces, text):
    assert encoder(name, spaces).ids(text).tolist() == library_ids(name, text)


@pytest.mark.parametrize(("name", "spaces", "text", "ids"), [("word_bpe_49k.json", False, "hello <|endoftext|> world", [3306, 49407, 1002]), ("word_bpe_49k.json", False, "it'ſ ok", [585, 262, 129, 379, 2481]), ("byte_bpe_50k.json", True, "hello <|endoftext|> world", [31373, 220, 50256, 995])])
def test_fixed_ids(name, spaces, text, ids):
    assert encoder(name, spaces).ids(text).tolist() == ids


def test_memo_generations_change_nothing():
    small, e = Encoder(public_tokenizers.path("byte_bpe_50k.json"), True, limit=5), encoder("byte_bpe_50k.json", True)
    texts = [" ".join(f"word{i * k}" for i in range(30)) for k in range(20)]
    assert small.batch(texts) == e.batch(texts)


def test_word_generations_and_long_pieces_change_nothing(monkeypatch):
    """Blocks, tables and groups of texts that are full again and again; pieces of up to 40 bytes, of one and two a character."""
    monkeypatch.setattr(tokens, "_BLOCK", 7)
    monkeypatch.setattr(tokens, "_SPREAD", 60)
    small, rng = Encoder(public_tokenizers.path("word_bpe_49k.json"), False, limit=5), random.Random(2)
    texts = ["".join(rng.choice(["a", "É", "ß", "T"]) for _ in range(rng.choice([1, 2, 7, 8, 9, 16, 23, 24, 25, 40]))) for _ in range(300)]
    texts = [" ".join(texts[i : i + k]) + rng.choice(["", "'s", " 12", "\n", "=" * 26]) for i in range(290) for k in (0, 1, 6)] + [None, "", " \n"]
    got = [np.frombuffer(ids, small.kind).tolist() for ids in small.batch(texts)]
    assert got == [library_ids("word_bpe_49k.json", t or "") for t in texts]
    assert small.words.old is not None and small.words.old.old is None


_KNOWN_PIECES = st.sampled_from([*" \n'stmdlrveSTMDLRVEabªµº×÷¿éÉžŁ0!.«–…€", "'s", "'re", "'LL", "''", "  "])


@settings(max_examples=400, deadline=None)
@given(st.lists(_KNOWN_PIECES, max_size=40).map("".join))
def test_word_borders_follow_the_pattern(text):
    data = text.encode()
    inside, begins = tokens.word_borders(np.frombuffer(data + b"\n\n\n", np.uint8))
    borders = np.append(np.flatnonzero(begins), len(data) + 3).tolist()
    got = [data[a:b].decode() for a, b in zip(borders, borders[1:], strict=False) if inside[a]]
    assert got == tokens._WORD_LEVEL.findall(text)


def test_words_take_less_time_than_a_lookup_for_each():
    """The encoder without white space against one regular expression and one dictionary lookup for each pre-token."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("etaoinsh", k=rng.randint(2, 9))) for _ in range(60_000)]
    texts = [" ".join(rng.choices(vocabulary, k=400)) + "." for _ in range(2000)]
    e, memo = Encoder(public_tokenizers.path("word_bpe_49k.json"), False), {}

    def plainly():
        for t in texts:
            pieces = tokens._WORD_LEVEL.findall(t)
            itemgetter(*pieces)(memo)

    def took(run):
        start = time.process_time()
        run()
        return time.process_time() - start

    for t in texts:
        memo.update((p, p.encode()) for p in tokens._WORD_LEVEL.findall(t))
    e.batch(texts)  # both know all words now
    assert min(took(lambda: e.batch(texts)) for _ in range(3)) < min(took(plainly) for _ in range(3))


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=3000), st.integers(1, 60))
def test_codecs_round_trip(data, repeat):
    data = data + data[:3] * repeat
    assert tiff.unpack_bits(tiff.pack_bits(data), len(data)) == data
    assert tiff.unlzw(tiff.lzw(data), len(data)) == data


def test_lzw_across_table_clears():
    data = random.Random(1).randbytes(40_000)
    assert tiff.unlzw(tiff.lzw(data), len(data)) == data


@pytest.mark.parametrize("how", tiff.LAYOUTS + (tiff.Layout(tiff.NONE, rows=7), tiff.Layout(tiff.LZW, tile=16, predictor=2)))
@pytest.mark.parametrize("shape", [(1, 1), (5, 576), (130, 70), (128, 576)])
def test_pages_round_trip(how, shape):
    image = np.random.default_rng(3).integers(0, 9, shape).astype(np.uint8)
    data = tiff.write_tiff([(image, how), (image[:1], tiff.Layout())], "n_bytes=3")
    pages = list(tiff.directories(data))
    assert len(pages) == 2
    assert (tiff.decode_page(data, pages[0])[:, :, 0] == image).all()


def test_chain_that_comes_back_ends():
    data = bytearray(tiff.write_tiff([(np.zeros((2, 2), np.uint8), tiff.Layout())]))
    first = int.from_bytes(data[4:8], "little")
    data[-4:] = first.to_bytes(4, "little")
    assert len(list(tiff.directories(bytes(data)))) == 1


@given(st.lists(st.binary(max_size=600), max_size=8))
def test_crc_of_a_concatenation(parts):
    assert token_store.crc_concat((zlib.crc32(p), len(p)) for p in parts) == zlib.crc32(b"".join(parts))


@given(st.lists(st.binary(max_size=3000), min_size=1, max_size=8))
def test_crcs_followed_by_zeros(parts):
    n = np.array([len(p) for p in parts])
    got = token_store.followed_by_zeros(np.array([zlib.crc32(p) for p in parts], np.uint32), n.sum() - np.cumsum(n))
    assert np.bitwise_xor.reduce(got) == zlib.crc32(b"".join(parts))


@given(st.lists(st.binary(max_size=5), max_size=40))
def test_streamed_tree_is_the_tree_by_levels(leaves):
    import hashlib

    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"\0").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    assert token_store.merkle_root(leaves) == level[0]


@settings(deadline=None)
@given(st.lists(st.integers(0, 50_000), max_size=6000))
def test_cuts_cover_the_stream(ids):
    ends = token_store.rolling_cuts(np.array(ids, "<u4"))
    assert ends == sorted(set(ends)) and (ends[-1:] or [0])[0] == len(ids)
    assert all(b - a <= token_store.MOST for a, b in zip([0, *ends], ends, strict=False))


def test_shared_passages_share_chunks():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 49_000, 5000)
    a, b = (np.concatenate((rng.integers(0, 49_000, n), shared)).astype("<u4") for n in (300, 777))
    cut = lambda x: {x[i:j].tobytes() for i, j in zip([0, *token_store.rolling_cuts(x)], token_store.rolling_cuts(x), strict=False)}
    assert len(cut(a) & cut(b)) >= 8


def test_windows_lose_nothing_and_stay_bounded():
    rng, held, out = random.Random(2), packing.Windows(64, 4, 3), []
    lengths = [rng.randint(1, 200) for _ in range(300)]
    for i, n in enumerate(lengths):
        out += held.place(i, 0, np.full(n, i, "<u4"), n)
        assert len(held.free) <= 4
    out += held.close()
    assert all(sum(len(p[2]) for p in w) <= 64 for w in out)
    got = {}
    for w in out:
        for doc, start, ids, _ in w:
            got.setdefault(doc, []).append((start, len(ids)))
    for i, n in enumerate(lengths):
        at = 0
        for start, size in sorted(got[i]):
            assert start == at
            at += size
        assert at == n
    assert len(out) <= sum(lengths) / 64 * 1.05 + 4


def test_line_keys():
    assert line_dedup.line_key("  ÀBC Straße x y z 12345 \t".encode(), 20) == "Àbc straße x y z 12345".encode().replace("À".encode(), "À".encode())
    assert line_dedup.line_key("é".encode() * 19, 20) is None
    assert line_dedup.line_key("é".encode() * 20, 20) is not None


def test_schedule_inverse_is_the_inverse(spark):
    from pyspark.sql import functions as F

    knots = ((0.0, 3.0), (0.25, 1.0), (0.5, 1.0), (1.0, 0.0))
    row = spark.range(1).select(*(mixing.inverse(F.lit(u), knots).alias(f"u{i}") for i, u in enumerate([0.0, 0.3, 0.5, 0.9, 1.0]))).first()
    for u, t in zip([0.0, 0.3, 0.5, 0.9, 1.0], row, strict=True):
        grid = np.linspace(0, t, 20_001)
        area = np.trapezoid(np.interp(grid, [k[0] for k in knots], [k[1] for k in knots]), grid)
        assert area / mixing.integral(knots) == pytest.approx(u, abs=1e-4)


def test_trie_finds_the_components_of_all_pairs():
    rng, order = random.Random(4), ngram_join.Order(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for _ in range(30):
        pool = rng.sample(range(1 << 40), 200)
        sets = [np.unique(np.array(rng.sample(pool, rng.randint(1, 40)), np.uint64)) for _ in range(12)]
        for s in list(sets):
            for _ in range(3):
                more = set(s.tolist())
                more ^= set(rng.sample(pool, rng.randint(0, max(1, len(s) // 12))))
                if more:
                    sets.append(np.unique(np.array(sorted(more), np.uint64)))
        parent = list(range(len(sets)))

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, a in enumerate(sets):
            for j in range(i):
                o = len(np.intersect1d(a, sets[j]))
                if 100 * o >= 90 * (len(a) + len(sets[j]) - o):
                    parent[root(i)] = root(j)
        mine = list(range(len(sets)))
        for a, b in ngram_join.link_group(sets, list(range(len(sets))), [0] * len(sets), 90, order):
            mine = [a if x == b else x for x in mine]
        groups = lambda f: {frozenset(i for i in range(len(sets)) if f(i) == f(j)) for j in range(len(sets))}
        assert groups(root) == groups(lambda i: mine[i])


def test_a_group_of_long_sets_is_not_held_many_times():
    rng, order = np.random.default_rng(3), ngram_join.Order(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    sets = [np.unique(rng.integers(0, 1 << 62, 20_000, dtype=np.uint64)) for _ in range(24)]
    sets.append(sets[7][:-100])
    tracemalloc.start()
    found = ngram_join.link_group(sets, list(range(25)), [0] * 25, 80, order)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(7, 24)]
    assert peak < 5 * sum(s.nbytes for s in sets)


@pytest.mark.parametrize("percent", [80, 90])
def test_sketches_keep_every_link(percent):
    rng = np.random.default_rng(6)
    base = [rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) for n in (1, 2, 9, 60, 700)]
    sets = []
    for s in base:
        for change in (0, 0.02, 0.04, 0.06, 0.1, 0.4, 1.0):
            k = round(change * len(s))
            sets.append(np.unique(np.concatenate([s[k:], rng.integers(0, 1 << 63, k, np.uint64)])))
            sets.append(np.unique(s[k:]) if k < len(s) else s)
    n = np.array([len(s) for s in sets])
    own = np.floor(np.log(n) / (np.log(100 / percent) * 1.000001)).astype(int)
    linked, kept, unrelated = set(), set(), 0
    for i in range(len(sets)):
        for j in range(i):
            o, top = len(np.intersect1d(sets[i], sets[j])), max(own[i], own[j])
            if 100 * o >= percent * (n[i] + n[j] - o):
                linked.add((j, i))
                assert abs(own[i] - own[j]) <= 1
            if abs(own[i] - own[j]) <= 1:
                pair = [j, i]
                words = np.array([np.frombuffer(ngram_join.sketch(sets[x], ngram_join.sketch_bits(top, percent)), np.uint64) for x in pair])
                for sides in ([0, 0], [0, 1]):
                    got = ngram_join.may_link(words, np.array(pair), np.array(pair), n[pair], own[pair], np.array(sides), top, percent)
                    kept |= {tuple(sorted(p)) for p in got}
                unrelated += not o and n[i] > 50 and n[j] > 50 and (j, i) in kept
    assert linked and linked <= kept and not unrelated


def test_trigrams_need_letters():
    assert language_id.trigrams(None) is None and language_id.trigrams("12 !?") is None
    assert language_id.trigrams("a")[1].sum() == 1


def test_letters_of_every_plane_count():
    assert language_id.trigrams(chr(0x30000) * 3)[1].sum() == 3 and language_id.trigrams(chr(0x2F800))[1].sum() == 1


def plain_bundle(text):
    """Letters lowered, other runs one gap; each trigram's three vectors, turned by their place, multiplied; all of them added."""
    padded = [language_id._GAP]
    for ch in text + " ":
        small = ch.lower() if ch.isalpha() else ""
        c = ord(small) if len(small) == 1 else ord(ch) if ch.isalpha() else language_id._GAP
        if c != language_id._GAP or padded[-1] != language_id._GAP:
            padded.append(c)
    out = np.zeros(language_id.DIMENSIONS, np.int64)
    vector = lambda c, turn: np.roll(language_id._vector(c).astype(np.int64), turn)
    for a, b, c in zip(padded, padded[1:], padded[2:], strict=False):
        out += vector(a, 2) * vector(b, 1) * vector(c, 0)
    return out


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abcÄéß 12\n中İſ" + chr(0x30000))), min_size=1, max_size=60), min_size=1, max_size=8), st.integers(1, 9))
def test_bundles_are_the_plain_sums(texts, chunk):
    old, language_id._CHUNK = language_id._CHUNK, chunk
    try:
        for held in language_id._groups(enumerate(texts), most=3):
            for (i, _), got in zip(held, language_id.bundles([t for _, t in held]), strict=True):
                assert got.tolist() == plain_bundle(texts[i]).tolist()
    finally:
        language_id._CHUNK = old


def test_a_million_distinct_trigrams_take_little_memory():
    import subprocess
    import sys
    from pathlib import Path

    program = """
import resource
import numpy as np
from codeloom.llm import language_id as L
rng = np.random.default_rng(1)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
found = next(L._groups([(0, "".join(map(chr, rng.integers(0x4E00, 0x5600, 1_050_000))))]))
assert len(found[0][1][0]) > 1_000_000
L.bundles([found[0][1]])
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    said = subprocess.run([sys.executable, "-c", program], capture_output=True, text=True, cwd=Path(__file__).resolve().parents[2], check=True)
    assert int(said.stdout) < 300


def test_binding_keeps_order_apart():
    ab, ba = language_id.trigrams("ab")[0], language_id.trigrams("ba")[0]
    cos = lambda x, y: float(x @ y / np.linalg.norm(x) / np.linalg.norm(y))
    assert abs(cos(language_id.bind(ab).sum(0), language_id.bind(ba).sum(0))) < 0.3
