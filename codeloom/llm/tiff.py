"""TIFF columns: walk image directories, decode strips and tiles, undo predictors, one row per page.

Reads classic and big TIFF of either byte order; no compression, LZW, deflate and PackBits; predictors 1, 2 and 3; strips and
tiles; chunky and planar samples of 8, 16 or 32 bits.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codeloom.llm.common import Scratch

NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
#: Tag numbers of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES = 256, 257, 258, 259, 262, 270, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325
#: Field type -> struct letter; other types are bytes.
_FORMS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
_SIZES = {2: 1, 5: 8, 7: 1, 10: 8}


def pack_bits(data: bytes) -> bytes:
    """PackBits: runs of three equal bytes or more as (1 - n, byte), the rest as (n - 1, bytes)."""
    a, out, at = np.frombuffer(data, np.uint8), bytearray(), 0
    edges = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1], [True]))) if len(a) else np.zeros(1, np.int64)
    long = np.flatnonzero(np.diff(edges) >= 3)

    def plain(start: int, end: int) -> None:
        for i in range(start, end, 128):
            some = data[i : min(i + 128, end)]
            out.append(len(some) - 1)
            out.extend(some)

    for k in long.tolist():
        start, end = int(edges[k]), int(edges[k + 1])
        plain(at, start)
        for i in range(start, end, 128):
            n = min(128, end - i)
            if n == 1:
                out += bytes((0, data[i]))
            else:
                out += bytes((257 - n, data[i]))
        at = end
    plain(at, len(data))
    return bytes(out)


def unpack_bits(data: bytes, most: int) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < most:
        c = data[i]
        if c < 128:
            out += data[i + 1 : i + 2 + c]
            i += 2 + c
        elif c > 128:
            out += data[i + 1 : i + 2] * (257 - c)
            i += 2
        else:
            i += 1
    return bytes(out[:most])


def lzw(data: bytes) -> bytes:
    """The format's LZW: most significant bits first, widths 9 to 12, grown one code early, cleared at 4094 entries."""
    first = {bytes((i,)): i for i in range(256)}
    table, width, codes, held = dict(first), 9, [(256, 9)], b""
    for i in range(len(data)):
        longer = held + data[i : i + 1]
        if longer in table:
            held = longer
            continue
        codes.append((table[held], width))
        n = len(table) + 2
        table[longer] = n
        if n == 4094:
            codes.append((256, width))
            table, width = dict(first), 9
        elif n + 1 == 1 << width:
            width += 1
        held = data[i : i + 1]
    if held:
        codes.append((table[held], width))
        n = len(table) + 2
        if n < 4094 and n + 1 == 1 << width:
            width += 1
    codes.append((257, width))
    out, acc, bits = bytearray(), 0, 0
    for code, w in codes:
        acc, bits = acc << w | code, bits + w
        if bits >= 64:
            rest = bits & 7
            out += (acc >> rest).to_bytes(bits >> 3, "big")
            acc, bits = acc & ((1 << rest) - 1), rest
    if bits:
        pad = -bits % 8
        out += (acc << pad).to_bytes((bits + pad) >> 3, "big")
    return bytes(out)


def unlzw(data: bytes, most: int) -> bytes:
    base: list[bytes] = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, out, width, size, last = base[:], [], 9, 0, None
    acc, bits, i, n = 0, 0, 0, len(data)
    while size < most:
        if bits < width:
            some = data[i : i + 32]
            if not some:
                break
            acc, bits, i = acc << 8 * len(some) | int.from_bytes(some, "big"), bits + 8 * len(some), i + len(some)
            if bits < width:
                break
        bits -= width
        code = acc >> bits
        acc &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = base[:], 9, None
            continue
        if last is None:
            got = table[code]
        else:
            if code < len(table):
                got = table[code]
            elif code == len(table):
                got = last + last[:1]
            else:
                raise ValueError("LZW code beyond the table")
            table.append(last + got[:1])
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
        out.append(got)
        size += len(got)
        last = got
    return b"".join(out)[:most]


def _encode(data: bytes, compression: int) -> bytes:
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.compress(data, 6)
    return {NONE: bytes, LZW: lzw, PACKBITS: pack_bits}[compression](data)


def _decode(data: bytes, compression: int, most: int) -> bytes:
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, most)
    if compression == NONE:
        return data[:most]
    if compression not in (LZW, PACKBITS):
        raise ValueError(f"compression {compression}")
    return {LZW: unlzw, PACKBITS: unpack_bits}[compression](data, most)


@dataclass(frozen=True)
class Layout:
    """How one page is stored: strips of `rows` rows, or square tiles of side `tile` if that is set."""

    compression: int = DEFLATE
    predictor: int = 1
    rows: int = 64
    tile: int = 0


def write_tiff(pages: list[tuple[np.ndarray, Layout]], description: str = "") -> bytes:
    """A classic little-endian TIFF of 8-bit single-sample pages (2-D arrays)."""
    out, links = bytearray(b"II*\0\0\0\0\0"), [4]
    for image, how in pages:
        height, width = image.shape
        blocks = []
        if how.tile:
            t = how.tile
            full = np.zeros((-(-height // t) * t, -(-width // t) * t), np.uint8)
            full[:height, :width] = image
            blocks = [full[y : y + t, x : x + t] for y in range(0, height, t) for x in range(0, width, t)]
        else:
            blocks = [image[y : y + how.rows] for y in range(0, height, how.rows)]
        ats, sizes = [], []
        for b in blocks:
            if how.predictor == 2:
                b = np.concatenate((b[:, :1], np.diff(b, axis=1)), axis=1)
            data = _encode(np.ascontiguousarray(b).tobytes(), how.compression)
            ats.append(len(out))
            sizes.append(len(data))
            out += data
        tags = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8]), (COMPRESSION, 3, [how.compression]), (PHOTOMETRIC, 3, [1])]
        if description:
            tags.append((DESCRIPTION, 2, description.encode() + b"\0"))
        if how.tile:
            tags += [(SAMPLES, 3, [1]), (PREDICTOR, 3, [how.predictor]), (TILE_WIDTH, 3, [how.tile]), (TILE_HEIGHT, 3, [how.tile]), (TILE_AT, 4, ats), (TILE_BYTES, 4, sizes)]
        else:
            tags += [(STRIP_AT, 4, ats), (SAMPLES, 3, [1]), (STRIP_ROWS, 4, [how.rows]), (STRIP_BYTES, 4, sizes), (PREDICTOR, 3, [how.predictor])]
        entries = []
        for tag, kind, values in tags:
            data = bytes(values) if kind == 2 else struct.pack(f"<{len(values)}{_FORMS[kind]}", *values)
            if len(data) > 4:
                out += b"\0" * (len(out) & 1)
                where = struct.pack("<I", len(out))
                out += data
            else:
                where = data.ljust(4, b"\0")
            entries.append(struct.pack("<HHI", tag, kind, len(values)) + where)
        out += b"\0" * (len(out) & 1)
        out[links[-1] : links[-1] + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(entries)) + b"".join(entries) + b"\0\0\0\0"
        links.append(len(out) - 4)
    return bytes(out)


def directories(data: bytes) -> Iterator[dict[int, tuple]]:
    """The tags of each image directory, in the order of the chain; a chain that comes back to a directory ends there."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        raise ValueError("not a TIFF")
    magic = struct.unpack_from(order + "H", data, 2)[0]
    if magic not in (42, 43):
        raise ValueError("not a TIFF")
    big = magic == 43
    head, entry, link, room = ("Q", "HHQ", "Q", 8) if big else ("H", "HHI", "I", 4)
    at = struct.unpack_from(order + link, data, 8 if big else 4)[0]
    seen = set()
    while at and at not in seen:
        seen.add(at)
        count = struct.unpack_from(order + head, data, at)[0]
        at += struct.calcsize("<" + head)
        tags = {}
        for _ in range(count):
            tag, kind, n = struct.unpack_from(order + entry, data, at)
            form = _FORMS.get(kind)
            size = n * (struct.calcsize("<" + form) if form else _SIZES.get(kind, 1))
            place = at + struct.calcsize("<" + entry)
            start = place if size <= room else struct.unpack_from(order + link, data, place)[0]
            if start + size > len(data):
                raise ValueError(f"tag {tag} ends beyond the file")
            tags[tag] = struct.unpack_from(f"{order}{n}{form}", data, start) if form else (data[start : start + size],)
            at = place + room
        tags[0] = (order,)
        yield tags
        at = struct.unpack_from(order + link, data, at)[0]


#: Bytes that one page, a row of its table, may take; no byte of a file makes more than so many of samples (an LZW code stands
#: for less than 4096 bytes, deflate grows 1032-fold).
MOST_PIXELS, MOST_GROWTH = 1 << 30, 4096


def decode_page(data: bytes, tags: dict[int, tuple]) -> np.ndarray:
    """The samples of one page as (height, width, samples), undone of tiling, compression and predictor.

    Nothing is allocated before the sizes that the directory claims are checked against the bytes of the file: ValueError if
    a side is not positive, a block lacks, or the blocks are too few bytes to hold that many samples."""
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, samples = tags[WIDTH][0], tags[HEIGHT][0], one(SAMPLES, 1)
    bits, compression, predictor, planar = one(BITS, 1), one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1)
    if bits not in (8, 16, 32):
        raise ValueError(f"{bits} bits a sample")
    kind = np.dtype(f"u{bits // 8}").newbyteorder(tags[0][0])
    tiled = TILE_AT in tags
    bw, bh = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if tiled else (width, min(one(STRIP_ROWS, height), height))
    ats, sizes = (tags[TILE_AT], tags[TILE_BYTES]) if tiled else (tags[STRIP_AT], tags[STRIP_BYTES])
    if not all(isinstance(x, int) and x > 0 for x in (width, height, samples, bw, bh)):
        raise ValueError("a side or the number of samples is not positive")
    planes, deep = (samples, 1) if planar == 2 else (1, samples)
    across, down = -(-width // bw), -(-height // bh)
    size, block_size = width * height * samples * bits // 8, bw * bh * deep * bits // 8
    if min(len(ats), len(sizes)) < planes * across * down:
        raise ValueError("strips or tiles lack")
    if size > MOST_PIXELS or block_size > MOST_PIXELS or size > MOST_GROWTH * len(data) or block_size > MOST_GROWTH * len(data):
        raise ValueError(f"{width} x {height} samples are more than the file can hold")
    out = np.zeros((height, width, samples), kind.newbyteorder("="))
    for k in range(planes * across * down):
        plane, y, x = k // (across * down), k // across % down * bh, k % across * bw
        rows = bh if tiled else min(bh, height - y)
        want = rows * bw * deep * bits // 8
        raw = _decode(data[ats[k] : ats[k] + sizes[k]], compression, want)
        if len(raw) < want:
            raise ValueError("a strip or tile is too short")
        if predictor == 3:
            planes_ = np.cumsum(np.frombuffer(raw, np.uint8).reshape(rows, -1), axis=1, dtype=np.uint8)
            block = planes_.reshape(rows, bits // 8, bw * deep).transpose(0, 2, 1).copy().view(f">u{bits // 8}").reshape(rows, bw, deep)
        else:
            block = np.frombuffer(raw, kind).reshape(rows, bw, deep)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
        h, w = min(rows, height - y), min(bw, width - x)
        if planar == 2:
            out[y : y + h, x : x + w, plane] = block[:h, :w, 0]
        else:
            out[y : y + h, x : x + w] = block[:h, :w]
    return out


PAGE = "page int, n_pages int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, description string, pixels binary, error string"


def tiff_pages(df: DataFrame, column: str = "media") -> DataFrame:
    """df with one row per page of its TIFF column, in page order, plus the columns of PAGE; pixels are the samples in rows.

    A null or unreadable file, or a page that can't be decoded, gives one row with null pixels and the reason in `error`;
    pages before it stay. So does a page whose claimed size its file can't hold, or above MOST_PIXELS. Columns of df come
    first and are unchanged, but for those named like a column of PAGE, which give way to it. An empty table gives no rows.
    Nothing is exchanged."""
    own = [x.split(" ")[0] for x in PAGE.split(", ")]
    df = df.select(*(c for c in df.columns if c not in own))
    place = df.columns.index(column)
    schema = StructType([*df.select(*df.columns).schema.fields, *StructType.fromDDL(PAGE).fields])
    names = schema.names

    def pages(data: bytes | None) -> Iterator[tuple]:
        page, n = 0, None
        try:
            if data is None:
                raise ValueError("no file")
            found = list(directories(data))
            n = len(found)
            for page, tags in enumerate(found):
                image = decode_page(data, tags)
                one = lambda tag, default, tags=tags: tags.get(tag, (default,))[0]
                said = one(DESCRIPTION, b"").rstrip(b"\0").decode("utf-8", "replace")
                yield page, n, image.shape[1], image.shape[0], image.shape[2], image.itemsize * 8, one(COMPRESSION, 1), one(PREDICTOR, 1), TILE_AT in tags, said, image.tobytes(), None
        except (ValueError, KeyError, IndexError, TypeError, OverflowError, ZeroDivisionError, MemoryError, struct.error, zlib.error) as e:
            yield page, n, None, None, None, None, None, None, None, None, None, str(e) or type(e).__name__

    kinds = [pa.int32()] * 8 + [pa.bool_(), pa.string(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at, size = [], [], 0
            for i, data in enumerate(batch.column(place).to_pylist()):
                for row in pages(data):
                    rows.append(row)
                    at.append(i)
                    size += len(row[10] or b"")
                    if size > 16_000_000:
                        yield emit(batch, rows, at)
                        rows, at, size = [], [], 0
            if rows:
                yield emit(batch, rows, at)

    def emit(batch: pa.RecordBatch, rows: list, at: list) -> pa.RecordBatch:
        kept = batch.take(pa.array(at, pa.int32()))
        return pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)

    return df.mapInArrow(run, schema)


PAYLOAD_WIDTH, PAGE_ROWS = 576, 128
#: Codecs of the pages, by a hash of the payload: most deflate, some with a predictor or tiles, some LZW and PackBits.
LAYOUTS = (Layout(), Layout(rows=16), Layout(predictor=2), Layout(tile=64), Layout(LZW, rows=32), Layout(rows=32), Layout(tile=64, predictor=2), Layout(PACKBITS, rows=8))


def payload_tiff(text: str | None) -> bytes:
    """A whole text as TIFF: its UTF-8 bytes, filled with 255 to a positive multiple of 576, in pages of at most 128 rows."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    payload = raw + b"\xff" * (-len(raw) % PAYLOAD_WIDTH if raw else PAYLOAD_WIDTH)
    image, turn = np.frombuffer(payload, np.uint8).reshape(-1, PAYLOAD_WIDTH), zlib.crc32(payload)
    pages = [(image[y : y + PAGE_ROWS], LAYOUTS[(turn + k) % len(LAYOUTS)]) for k, y in enumerate(range(0, len(image), PAGE_ROWS))]
    return write_tiff(pages, f"n_bytes={len(raw)}")


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, media from doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([payload_tiff(t) for t in some.column(1).to_pylist()], pa.binary())], names=["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, media binary")


def feature(pixels: np.ndarray) -> str:
    """Mean, deviation and a 64-bit difference hash of the samples in 8 x 9 even blocks."""
    edges = np.linspace(0, len(pixels), 73).astype(np.int64)
    sums = np.concatenate(([0], np.cumsum(pixels, dtype=np.int64)))
    means = ((sums[edges[1:]] - sums[edges[:-1]]) * 256 // np.maximum(1, np.diff(edges))).reshape(8, 9)
    bits = np.packbits(means[:, 1:] > means[:, :-1]).tobytes().hex()
    n, s = len(pixels), int(sums[-1])
    squares = int(np.dot(np.bincount(pixels, minlength=256), np.arange(256, dtype=np.int64) ** 2))
    return f"{s * 1000 // n}:{(squares * n - s * s) * 1000 // (n * n)}:{bits}"


def op1_tiff_pages(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    stored = Scratch(spark, "tiff").table(store_texts(docs), "media")
    named = stored.withColumn("media_bytes", F.octet_length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256))
    pages = tiff_pages(named).select("doc_id", "media_bytes", "media_sha256", "page", "n_pages", "description", "pixels", "error", "height", "compression")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pages of one file follow each other within a partition."""
        held: list[bytes] = []
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["error"]:
                    raise ValueError(f"document {r['doc_id']}: {r['error']}")
                held = [] if r["page"] == 0 else held
                held.append(r["pixels"])
                if r["page"] + 1 == r["n_pages"]:
                    payload = b"".join(held)
                    out.append((r["doc_id"], int(r["description"].partition("=")[2]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), r["media_bytes"], r["media_sha256"], feature(np.frombuffer(payload, np.uint8)), r["n_pages"]))
                    held = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages int"
    names = [x.split(" ")[0] for x in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "int": pa.int32()}[x.split(" ")[1]] for x in schema.split(", ")]
    return pages.mapInArrow(fold, schema)
