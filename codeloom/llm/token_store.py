"""Content-addressed store of token ids: unique chunks once, a recipe for each document, Merkle manifests over both.

Layout below one folder of the shared file system, all of it Parquet written by Spark:

* ``objects/kind=chunks``: ``key`` (sha256 of the bytes), ``data`` (little-endian unsigned 16- or 32-bit ids), each key once;
  beside them ``kind=recipes``, the recipes as tasks sent them, each under a key of its own;
* ``recipes/part=K``: ``doc_id, start, n_tokens, root, hashes`` in ascending doc_id order, within a part and from part to
  part; ``start`` counts the ids of all documents before, ``hashes`` has 32 bytes for each chunk, ``root`` is sha256 over them,
  a node of the Merkle tree with as many children as the document has chunks;
* ``parts``: ``part, start, documents, n_tokens, root``, one row a part, its root over the rows of the part in their order;
* ``top``: ``documents, n_tokens, root``, one row, its root over the roots of the parts.

Cuts follow content: a gear hash rolls over the last 32 ids and a cut comes where its low bits are zero, so that shared
passages make shared chunks wherever they stand. Verification reads every unique chunk once, checks its hash, and
rebuilds each document's checksum and length from those of its chunks (CRC-32 of a concatenation is linear in both).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import Scratch, leave, partitions
from codeloom.llm.tokens import encoder

MASK, LEAST, MOST = (1 << 8) - 1, 64, 1024  # a cut every 256 ids or so past the least length

_GEAR = (np.arange(1, 65537, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(29)).astype(np.uint32)


def rolling_cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one id stream; the last one is its length. An empty stream has no chunk."""
    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    h = _GEAR.take(ids, mode="wrap")
    for k in (1, 2, 4, 8, 16):  # h[i] becomes the sum of gear[i-j] << j for j < 2k
        h[k:] += h[:-k] << np.uint32(k)
    ends, at = [], 0
    for c in (np.flatnonzero((h & np.uint32(MASK << 16)) == 0) + 1).tolist():
        while c - at > MOST:
            at += MOST
            ends.append(at)
        if c - at >= LEAST:
            at = c
            ends.append(at)
    while n - at > MOST:
        at += MOST
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


class Merkle:
    """sha256 tree over leaves that come one by one: leaves and inner nodes hash with different first bytes, an odd node moves
    up as it is. Holds one node for each height."""

    def __init__(self):
        self.peaks: list[tuple[int, bytes]] = []  # (height, node), highest first

    def add(self, leaf: bytes) -> None:
        height, node = 0, hashlib.sha256(b"\0" + leaf).digest()
        while self.peaks and self.peaks[-1][0] == height:
            node = hashlib.sha256(b"\1" + self.peaks.pop()[1] + node).digest()
            height += 1
        self.peaks.append((height, node))

    def root(self) -> bytes:
        if not self.peaks:
            return hashlib.sha256(b"\0").digest()
        node = self.peaks[-1][1]
        for _, left in reversed(self.peaks[:-1]):
            node = hashlib.sha256(b"\1" + left + node).digest()
        return node


def merkle_root(leaves: Iterable[bytes]) -> bytes:
    tree = Merkle()
    for leaf in leaves:
        tree.add(leaf)
    return tree.root()


def recipe_root(hashes: bytes) -> bytes:
    """The node of a document: its chunks' hashes, in order, behind a byte of its own."""
    return hashlib.sha256(b"\2" + hashes).digest()


def _leaf(doc: int | None, n: int, root: bytes) -> bytes:
    """What a part's tree holds of a document."""
    return struct.pack("<?qq", doc is not None, doc or 0, n) + root


#: For each k, four tables of 256: what appending 2**k zero bytes makes of each byte of a CRC-32.
_zeros: list[list[list[int]]] = []


def _zero_tables(k: int) -> list[list[int]]:
    while len(_zeros) <= k:
        if not _zeros:  # one zero byte: what zlib does to each single bit, without its constant part
            constant = zlib.crc32(b"\0", 0)
            bits = [zlib.crc32(b"\0", 1 << i) ^ constant for i in range(32)]
        else:  # twice as many: the last step applied to its own images
            a, b, c, d = _zeros[-1]
            images = [t[1 << i] for t in (a, b, c, d) for i in range(8)]
            bits = [a[x & 255] ^ b[x >> 8 & 255] ^ c[x >> 16 & 255] ^ d[x >> 24] for x in images]
        tables = []
        for byte in range(4):
            table = [0]
            for bit in bits[8 * byte : 8 * byte + 8]:
                table += [x ^ bit for x in table]
            tables.append(table)
        _zeros.append(tables)
    return _zeros[k]


def crc_concat(parts: Iterable[tuple[int, int]]) -> int:
    """CRC-32 of a concatenation from (crc, length in bytes) of its parts."""
    crc = 0
    for c, length in parts:
        k = 0
        while length and crc:
            if length & 1:
                t0, t1, t2, t3 = _zero_tables(k)
                crc = t0[crc & 255] ^ t1[crc >> 8 & 255] ^ t2[crc >> 16 & 255] ^ t3[crc >> 24]
            length >>= 1
            k += 1
        crc ^= c
    return crc


def followed_by_zeros(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What so many zero bytes behind it make of each CRC-32 (without its part for them): a concatenation's CRC is the
    exclusive or of its parts' CRCs, each followed by as many zeros as bytes come after it."""
    out, k = crcs.astype(np.uint32), 0
    while (lengths >> k).any():
        some = np.flatnonzero(lengths >> k & 1)
        t0, t1, t2, t3 = (np.array(t, np.uint32) for t in _zero_tables(k))
        x = out[some]
        out[some] = t0[x & 255] ^ t1[x >> 8 & 255] ^ t2[x >> 16 & 255] ^ t3[x >> 24]
        k += 1
    return out


def write_store(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, spaces: bool = False, memo: int = 400_000) -> None:
    """Writes the chunks, recipes and manifests of every whole text of docs (doc_id, text) below folder.

    One pass and one shuffle of the ids: a task sends a chunk once however often its documents repeat it, so that a chunk that
    a third of all documents hold meets its reducer once for each task. Only recipes are then put in order. A null text counts
    as empty; a null doc_id is kept as such and comes first; repeated rows give a recipe each, side by side; an empty table
    gives no recipe. Ids take 2 bytes in the store where the vocabulary allows it, else 4; `memo` bounds the pre-tokens whose
    ids a worker keeps.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sent, task, n_recipes = encoder(tokenizer, spaces, memo), set(), TaskContext.get().partitionId(), 0
        end, width = np.array([end_id], enc.kind).tobytes(), int(enc.kind[-1])
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                ids, texts = (c.to_pylist() for c in batch.slice(at, 500).columns)
                rows: list[tuple] = []
                for doc, raw in zip(ids, enc.batch(texts), strict=True):
                    raw, hashes, a = raw + end, [], 0
                    for b in rolling_cuts(np.frombuffer(raw, enc.kind)):
                        data = raw[a * width : b * width]
                        h = hashlib.sha256(data).digest()
                        hashes.append(h)
                        if h[:16] not in sent:
                            if len(sent) > 400_000:
                                sent.clear()
                            sent.add(h[:16])
                            rows.append(("chunks", h, None, b - a, data))
                        a = b
                    held = b"".join(hashes)
                    rows.append(("recipes", recipe_root(held) + struct.pack(">IQ", task, n_recipes), doc, a, held))
                    n_recipes += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["kind", "key", "doc_id", "n", "data"])
        sent = set()
        leave()

    schema = "kind string, key binary, doc_id long, n long, data binary"
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)
    # Copies of a chunk from several tasks are neighbours after the sort that the write by kind needs; a recipe's key is its own.
    same = Window.partitionBy("kind", "key").orderBy("kind", "key")
    dealt = rows.repartition(partitions(docs), "kind", "key").withColumn("again", F.lag(F.lit(1)).over(same)).where("again IS NULL").drop("again")
    dealt.write.option("compression", "snappy").partitionBy("kind").parquet(f"{folder}/objects")
    _write_recipes(docs.sparkSession, folder, partitions(docs))


_OBJECTS = "key binary, doc_id long, n long, data binary, kind string"
_RECIPES = "doc_id long, start long, n_tokens long, root binary, hashes binary, part int"


def _write_recipes(spark, folder: str, ranges: int) -> None:
    """Recipes range-partitioned and sorted by doc_id, with their starts, and the manifests over them.

    Each range sums up its ids and hashes its rows as they stream by; one row for each range sets where it starts."""
    raw = spark.read.schema(_OBJECTS).parquet(f"{folder}/objects").where("kind = 'recipes'").select("doc_id", F.col("n").alias("n_tokens"), F.substring("key", 1, 32).alias("root"), F.col("data").alias("hashes"))
    order = F.col("doc_id").asc_nulls_first(), F.col("root")
    ranged = raw.repartitionByRange(ranges, *order).sortWithinPartitions(*order)

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part, rows, tree = 0, TaskContext.get().partitionId(), 0, Merkle()
        for batch in batches:
            inside = []
            for doc, n, root in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                inside.append(at)
                at, rows = at + n, rows + 1
                tree.add(_leaf(doc, n, root))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(inside, pa.int64()), pa.array([part] * len(inside), pa.int32()), pa.nulls(len(inside), pa.int64())], names=names)
        if rows:  # the summary of the range: its size in `inside`, its rows in `documents`
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([tree.root()], pa.binary()), pa.nulls(1, pa.binary()), pa.array([at], pa.int64()), pa.array([part], pa.int32()), pa.array([rows], pa.int64())], names=names)

    schema = "doc_id long, n_tokens long, root binary, hashes binary, inside long, part int, documents long"
    names = [x.split(" ")[0] for x in schema.split(", ")]
    ranged.mapInArrow(offsets, schema).write.option("compression", "snappy").parquet(f"{folder}/ranges")
    rows = spark.read.schema(schema).parquet(f"{folder}/ranges")
    ends = rows.where("documents IS NOT NULL")
    begin = F.sum("inside").over(Window.orderBy("part")) - F.col("inside")  # over one row a range
    ends.select("part", begin.alias("start"), "documents", F.col("inside").alias("n_tokens"), "root").coalesce(1).write.parquet(f"{folder}/parts")
    parts = spark.read.schema("part int, start long, documents long, n_tokens long, root binary").parquet(f"{folder}/parts")
    placed = rows.where("documents IS NULL").join(F.broadcast(parts.select("part", F.col("start").alias("begin"))), "part")
    placed = placed.select("doc_id", (F.col("begin") + F.col("inside")).alias("start"), "n_tokens", "root", "hashes", "part")
    placed.repartition(ranges, "part").sortWithinPartitions("part", *order).write.option("compression", "snappy").partitionBy("part").parquet(f"{folder}/recipes")
    of_parts = [(r["documents"], r["n_tokens"], bytes(r["root"])) for r in parts.orderBy("part").collect()]
    top = (sum(r[0] for r in of_parts), sum(r[1] for r in of_parts), bytearray(merkle_root(r[2] for r in of_parts)))
    spark.createDataFrame([top], "documents long, n_tokens long, root binary").coalesce(1).write.parquet(f"{folder}/top")


def sound_parts(spark, folder: str) -> DataFrame:
    """part, sound for each part: its stored rows, in order, have the root, the sizes and the start that the manifest holds,
    and the roots of all parts have the top's. One small row for each part is compared on the driver."""
    rows = spark.read.schema(_RECIPES).parquet(f"{folder}/recipes").select("part", "doc_id", "start", "n_tokens", "root")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tree, out = None, Merkle(), []
        for batch in batches:
            for p, doc, start, n, root in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part:
                    if part is not None:
                        out.append((part, first, at, gapless, count, tree.root()))
                    part, tree, first, at, gapless, count = p, Merkle(), start, start, True, 0
                gapless, at, count = gapless and start == at, start + n, count + 1
                tree.add(_leaf(doc, n, root))
        if part is not None:
            out.append((part, first, at, gapless, count, tree.root()))
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["part", "first", "at", "gapless", "count", "found"])

    order = F.col("part"), F.col("doc_id").asc_nulls_first(), F.col("root")
    found = rows.repartition(partitions(rows), "part").sortWithinPartitions(*order).mapInArrow(again, "part int, first long, at long, gapless boolean, count long, found binary")
    parts = spark.read.schema("part int, start long, documents long, n_tokens long, root binary").parquet(f"{folder}/parts")
    pairs = parts.join(found, "part", "left").orderBy("part").collect()
    top, at, out = spark.read.schema("documents long, n_tokens long, root binary").parquet(f"{folder}/top").first(), 0, []
    whole = merkle_root(bytes(r["root"]) for r in pairs) == bytes(top["root"]) and sum(r["n_tokens"] for r in pairs) == top["n_tokens"]
    for r in pairs:
        right = (r["start"], r["start"] + r["n_tokens"], r["documents"], r["root"]) == (r["first"], r["at"], r["count"], r["found"])
        out.append((r["part"], whole and right and bool(r["gapless"]) and r["start"] == at))
        at = r["start"] + r["n_tokens"]
    return spark.createDataFrame(out, "part int, sound boolean")


def read_store(spark, folder: str, width: int = 2) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, root, verified; everything comes from the stored files.

    verified: each chunk has the hash it is stored under, the recipe's hashes have the root of the manifest, their ids are as
    many as it says, and the manifest of its part is sound.
    """
    objects = spark.read.schema(_OBJECTS).parquet(f"{folder}/objects")
    store = f"<u{width}"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 4000):
                some = batch.slice(first, 4000)
                keys, data = some.column(0), some.column(1).to_pylist()
                wide = memoryview(np.frombuffer(b"".join(data), store).astype("<u4").tobytes())
                ends = [*accumulate(4 * (len(d) // width) for d in data)]
                crcs = [zlib.crc32(wide[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
                good = [hashlib.sha256(d).digest() == key for d, key in zip(data, keys.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([keys, pa.array(crcs, pa.int64()), pa.array([len(d) // width for d in data], pa.int64()), pa.array(good, pa.bool_())], names=["hash", "crc", "n", "good"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each distinct recipe of a task once."""
        seen = set()
        for batch in batches:
            roots, at, hashes = [], [], []
            for root, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if root in seen:
                    continue
                if len(seen) > 400_000:
                    seen.clear()
                seen.add(root)
                for i in range(0, len(data), 32):
                    roots.append(root)
                    at.append(i // 32)
                    hashes.append(data[i : i + 32])
            yield pa.RecordBatch.from_arrays([pa.array(roots, pa.binary()), pa.array(at, pa.int32()), pa.array(hashes, pa.binary())], names=["root", "at", "hash"])

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Steps sorted by (root, at); a step that two tasks sent comes twice and counts once."""
        last, held, crc, size, sound = None, bytearray(), 0, 0, True  # of the recipe that is open
        out: list[tuple] = []

        def emit() -> pa.RecordBatch:
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.bool_()]
            done = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["root", "ids_crc32", "built", "good"])
            out.clear()
            return done

        for batch in batches:
            roots, ats, hashes, crcs, sizes, goods = (c.to_pylist() for c in batch.columns)
            steps = [i for i in range(len(roots)) if (roots[i], ats[i]) != ((roots[i - 1], ats[i - 1]) if i else last)]
            if not steps:
                continue
            last_root = last and last[0]
            last = roots[-1], ats[-1]
            first = [j for j, i in enumerate(steps) if (roots[i] != roots[steps[j - 1]] if j else roots[i] != last_root)]
            bounds = sorted({0, *first}) + [len(steps)]
            n_bytes = np.array([4 * (sizes[i] or 0) for i in steps], np.int64)
            upto = np.cumsum(n_bytes)
            ends = np.repeat([upto[b - 1] for b in bounds[1:]], np.diff(bounds))
            shifted = followed_by_zeros(np.array([crcs[i] or 0 for i in steps], np.uint32), ends - upto)
            starts_new = set(first)
            for a, b in zip(bounds, bounds[1:], strict=False):
                if a in starts_new:
                    if last_root is not None:
                        out.append((last_root, crc, size, sound and recipe_root(held) == last_root))
                    held, crc, size, sound = bytearray(), 0, 0, True
                part = int(np.bitwise_xor.reduce(shifted[a:b]))
                length = int(n_bytes[a:b].sum())
                crc = crc_concat(((crc, 0), (part, length))) if crc else part
                size += length // 4
                held += b"".join(hashes[i] for i in steps[a:b])
                sound = sound and all(goods[i] for i in steps[a:b])
                last_root = roots[steps[a]]
            if out:
                yield emit()
        if last is not None:
            out.append((last[0], crc, size, sound and recipe_root(held) == last[0]))
            yield emit()

    chunks = objects.where("kind = 'chunks'").select("key", "data").mapInArrow(digest, "hash binary, crc long, n long, good boolean")
    recipes = spark.read.schema(_RECIPES).parquet(f"{folder}/recipes")
    steps = recipes.select("root", "hashes").mapInArrow(unpack, "root binary, at int, hash binary")
    joined = steps.join(chunks, "hash", "left")
    ordered = joined.select("root", "at", "hash", "crc", "n", "good").repartition(partitions(joined), "root").sortWithinPartitions("root", "at")
    built = ordered.mapInArrow(rebuild, "root binary, ids_crc32 long, built long, good boolean")
    of_part = F.broadcast(sound_parts(spark, folder))  # one row a part
    out = recipes.select("doc_id", "start", "n_tokens", "root", "part").join(built, "root").join(of_part, "part")
    return out.select("doc_id", "start", F.col("built").alias("n_tokens"), "ids_crc32", "root", (F.col("good") & F.col("sound") & (F.col("built") == F.col("n_tokens"))).alias("verified"))


def op3_token_store(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    scratch = Scratch(spark, "token-store")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch.path("store")
    write_store(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_store(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32", F.lower(F.hex("root")).alias("root_sha256"), "verified")
