"""Bounded-space online packing of token streams into fixed windows."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import Scratch, leave
from codeloom.llm.tokens import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open boolean, ids binary"
#: Sequences of one task and round are numbered below this.
_ROOM = 1 << 36


class Windows:
    """At most `most` open windows of `size` ids; closed ones come out of place() and close().

    A piece goes into the open window that it fills best. When none holds it, a new window opens, and if that makes too
    many, the fullest is emitted: with a gap below `least` as it is, else topped up with the head of the piece, so that a
    window leaves full or nearly so.
    """

    def __init__(self, size: int, most: int, least: int):
        self.size, self.most, self.least = size, most, least
        self.free: list[tuple[int, int]] = []  # (free ids, window number), ascending
        self.held: dict[int, list] = {}
        self.n = 0

    def _put(self, free: int, number: int, piece: tuple) -> int:
        self.held[number].append(piece)
        return free - len(piece[2])

    def place(self, doc, start: int, ids: np.ndarray, total: int) -> Iterator[list]:
        while len(ids) >= self.size:  # whole windows need no company
            yield [(doc, start, ids[: self.size], total)]
            start, ids = start + self.size, ids[self.size :]
        while len(ids):
            i = bisect.bisect_left(self.free, (len(ids), -1))
            if i < len(self.free):  # best fit: the least room that holds it
                free, number = self.free.pop(i)
                free = self._put(free, number, (doc, start, ids, total))
                if free:
                    bisect.insort(self.free, (free, number))
                else:
                    yield self.held.pop(number)
                return
            if len(self.free) < self.most:
                self.held[self.n] = []
                bisect.insort(self.free, (self._put(self.size, self.n, (doc, start, ids, total)), self.n))
                self.n += 1
                return
            free, number = self.free.pop(0)  # the fullest
            if free >= self.least:
                self._put(free, number, (doc, start, ids[:free], total))
                start, ids = start + free, ids[free:]
            yield self.held.pop(number)

    def close(self) -> Iterator[list]:
        for _, number in self.free:
            yield self.held.pop(number)
        self.free = []


def _rows(windows: Iterator[tuple[list, bool]], first: int, small: str) -> Iterator[pa.RecordBatch]:
    names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.bool_(), pa.binary()]
    rows: list[tuple] = []
    for k, (window, is_open) in enumerate(windows):
        offset = 0
        for doc, start, ids, total in window:
            rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, first + k, offset, is_open, ids.astype(small).tobytes() if is_open else None))
            offset += len(ids)
        if len(rows) > 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def pack(docs: DataFrame, scratch: Scratch, tokenizer: str, end_id: int = 0, spaces: bool = True, size: int = 1024, open_windows: int = 64, least_fragment: int = 8, fan_in: int = 16, memo: int = 500_000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each task reads its part of docs once, tokenizes whole texts, and packs them on line with `open_windows` open windows.
    What stays open (at most that many windows for each task) is merged by rounds in which one task takes over the open
    windows of `fan_in` others, so no task ever holds more than fan_in * open_windows of them; the last round closes. The
    only exchange carries those leftovers. A null text is an empty one (its end id alone), a null doc_id stays null,
    repeated rows are packed each, an empty table gives no row. `memo` bounds the pre-tokens whose ids a worker keeps.
    """
    small = encoder(tokenizer, spaces).kind

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(tokenizer, spaces, memo), TaskContext.get().partitionId()
        end = np.array([end_id], small).tobytes()

        def windows():
            held = Windows(size, open_windows, least_fragment)
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    ids, texts = (c.to_pylist() for c in batch.slice(at, 500).columns)
                    for doc, raw in zip(ids, enc.batch(texts), strict=True):
                        tokens = np.frombuffer(raw + end, small).astype("<u4")
                        for w in held.place(doc, 0, tokens, len(tokens)):
                            yield w, False
            for w in held.close():
                yield w, True

        yield from _rows(windows(), task * _ROOM, small)
        leave()

    def merge(last: bool, level: int):
        def run(key, table):
            """One group: the pieces of at most fan_in * open_windows windows."""
            rows = table.to_pylist()

            def windows():
                held = Windows(size, open_windows, least_fragment)
                for r in sorted(rows, key=lambda r: (-r["length"], r["sequence_id"], r["offset"])):
                    ids = np.frombuffer(r["ids"], small).astype("<u4")
                    for w in held.place(r["doc_id"], r["start"], ids, r["doc_tokens"]):
                        yield w, False
                for w in held.close():
                    yield w, not last

            return pa.Table.from_batches(_rows(windows(), (level << 58) + key[0].as_py() * _ROOM, small))

        return run

    done = scratch.table(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(first_round, SCHEMA), "pieces-0")
    parts, level = [done.where("not open")], 0
    tasks = (done.agg(F.max("sequence_id")).first()[0] or 0) // _ROOM + 1
    while True:
        level += 1
        last = tasks <= fan_in
        task = F.shiftright(F.col("sequence_id").bitwiseAND(F.lit((1 << 58) - 1)), 36)
        group = F.floor(task / F.lit(fan_in)).cast("long")
        done = scratch.table(done.where("open").withColumn("grp", group).groupBy("grp").applyInArrow(merge(last, level), SCHEMA), f"pieces-{level}")
        if last:
            parts.append(done)
            break
        parts.append(done.where("not open"))
        tasks = -(-tasks // fan_in)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("open", "ids")


def op4_online_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, Scratch(spark, "packing"), public_tokenizers.path("byte_bpe_50k.json"))
