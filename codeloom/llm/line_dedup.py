"""Exact line deduplication over a corpus that returns keep bitmaps, never text.

Hashes of line keys are range-partitioned by (hash, document from the largest down) and sorted by position within; each
partition streams its runs. A frequent line spreads over as many ranges as its rows fill, so runs that touch a range's
border are settled from one small summary row for each end of each range.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import Scratch, enter, leave, partitions

_STRIP = b" \t\n\x0b\x0c\r"
_NONE = -(1 << 63)


def line_key(line: bytes, least: int) -> bytes | None:
    """The key of a UTF-8 line (stripped, A-Z lowered), or None where it has fewer than `least` code points."""
    key = line.strip(_STRIP).lower()
    if len(key) < least:
        return None
    if len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least:
        return None
    return key


def _lines(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("lines")
        names = ["doc", "at", "hi", "lo", "n_lines"]
        for batch in batches:
            for part in range(0, batch.num_rows, 500):
                some = batch.slice(part, 500)
                docs, ats, hashes, totals = [], [], [], []
                for doc, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
                    docs.append(doc)  # one row for the document itself: at -1
                    ats.append(-1)
                    hashes.append(b"\0" * 16)
                    totals.append(len(lines))
                    for i, line in enumerate(lines):
                        if len(line) >= least and (key := line_key(line, least)) is not None:
                            docs.append(doc)
                            ats.append(i)
                            hashes.append(hashlib.blake2b(key, digest_size=16).digest())
                            totals.append(None)
                pair = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ats, pa.int32()), pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), pa.array(totals, pa.int64())], names=names)
        leave()

    return run


def _stream(few: int):
    """Rows of one range in the order (hi, lo, doc descending, at): decided drops, rows of border runs, and border summaries.

    kind 0: drop (doc, at). kind 1: (hi, lo, doc, at) of a run that touches the range's first or last row and is open yet.
    kind 2: (hi, lo, docs in this range, largest doc).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, first_run, n_docs, top, last_doc = None, True, 0, None, None
        waiting: list[tuple] = []

        def flush():
            cols = list(zip(*out, strict=True))
            out.clear()
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["kind", "hi", "lo", "doc", "at", "n"])

        for batch in batches:
            his, los, docs, ats = (batch.column(i).to_pylist() for i in range(4))
            for hi, lo, doc, at in zip(his, los, docs, ats, strict=True):
                if (hi, lo) != key:
                    if key is not None and first_run:
                        out.append((2, *key, top, -1, n_docs))
                    first_run = key is None
                    key, n_docs, top, last_doc, waiting = (hi, lo), 0, doc, _NONE, []
                if n_docs == 0 or doc != last_doc:
                    n_docs, last_doc = n_docs + 1, doc
                if first_run:  # the range before may hold larger documents with this line
                    out.append((1, hi, lo, doc, at, None))
                elif n_docs >= few:
                    out.extend((0, hi, lo, d, a, None) for d, a in waiting if d != top)
                    waiting = []
                    out.append((0, hi, lo, doc, at, None))
                else:
                    waiting.append((doc, at))
                if len(out) > 20_000:
                    yield flush()
        if key is not None:
            out.append((2, *key, top, -1, n_docs))
            if not first_run:
                out.extend((1, *key, d, a, None) for d, a in waiting)
        if out:
            yield flush()

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, dropped = [], []
        for n, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            bits = np.ones(n, np.uint8)
            bits[at] = 0
            out.append(zlib.compress(np.packbits(bits).tobytes(), 6))
            dropped.append(len(at))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dropped, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "n_lines", "n_dropped", "keep"])


def keep_bitmaps(docs: DataFrame, scratch: Scratch, least: int = 20, few: int = 3) -> DataFrame:
    """doc_id, n_lines, n_dropped, keep (zlib of one bit per line, 1 = stays, first line highest) from doc_id and text.

    A line whose key has at least `least` code points and stands in at least `few` documents stays only in the largest
    doc_id that holds it. A null or empty text is one empty line. A null doc_id counts as a document below all others; rows
    that repeat a doc_id count as one document and get one bitmap, that of the row with most lines, so rows of one doc_id
    should have one text. An empty table gives no rows.
    """
    lines = scratch.table(docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("doc"), F.col("text").cast("string")).mapInArrow(_lines(least), "doc long, at int, hi long, lo long, n_lines long"), "lines")
    keys = lines.where("at >= 0").select("hi", "lo", "doc", "at")
    ranged = keys.repartitionByRange(partitions(docs), F.col("hi"), F.col("lo"), F.col("doc").desc()).sortWithinPartitions("hi", "lo", F.col("doc").desc(), "at")
    streamed = scratch.table(ranged.mapInArrow(_stream(few), "kind int, hi long, lo long, doc long, at int, n long"), "runs")
    # Two summaries at most for each range, so the joined side has a bound that is known: twice the number of ranges.
    border = streamed.where("kind = 2").groupBy("hi", "lo").agg(F.sum("n").alias("n"), F.max("doc").alias("top")).where(F.col("n") >= few).select("hi", "lo", "top")
    open_ = streamed.where("kind = 1").select("hi", "lo", "doc", "at").join(F.broadcast(border), ["hi", "lo"]).where("doc < top")
    drops = streamed.where("kind = 0").select("doc", "at").unionByName(open_.select("doc", "at")).groupBy("doc").agg(F.collect_set("at").alias("drops"))
    whole = lines.where("at = -1").groupBy("doc").agg(F.max("n_lines").alias("n_lines"))
    return whole.join(drops, "doc", "left").select(F.when(F.col("doc") != _NONE, F.col("doc")).alias("doc_id"), "n_lines", F.coalesce("drops", F.array().cast("array<int>")).alias("drops")).mapInArrow(_bitmaps, "doc_id long, n_lines long, n_dropped long, keep binary")


def kept_text(text: str | None, keep: bytes) -> str:
    """The lines of text whose bit is 1, joined by newlines; lines beyond the bitmap stay."""
    lines = (text or "").split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8)).tolist()
    return "\n".join([line for i, line in enumerate(lines) if i >= len(bits) or bits[i]])


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = keep_bitmaps(docs, Scratch(spark, "lines")).withColumnRenamed("doc_id", "kept_id")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sha = []
            for text, keep, n in zip(batch.column(1).to_pylist(), batch.column(4).to_pylist(), batch.column(3).to_pylist(), strict=True):
                sha.append(hashlib.sha256((kept_text(text, keep) if n else text or "").encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(sha, pa.string()), batch.column(4)], names=["doc_id", "n_lines", "n_dropped", "kept_sha256", "keep_bitmap"])

    joined = docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"])).select("doc_id", "text", "n_lines", "n_dropped", "keep")
    return joined.mapInArrow(digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string, keep_bitmap binary").drop("keep_bitmap")


OP2_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS ln FROM documents),
k AS (SELECT doc_id, line, ln, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.doc_id, k.line, k.ln, f.top IS NOT NULL AND k.doc_id <> f.top AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY ln) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
