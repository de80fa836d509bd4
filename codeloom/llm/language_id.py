"""Language identification with hyperdimensional profiles.

Every character has a random vector of +1 and -1; a trigram's vector binds (multiplies) its characters' vectors, rotated
by their place; a document or a language is the bundle (sum) of the vectors of its trigrams, weighted by how often they
come. The language whose bundle has the largest cosine with the document's is predicted.

Trigrams are bound and added up a few thousand at a time, so memory does not grow with how many distinct ones there are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import enter, leave, worker_cache

DIMENSIONS = 512
_GAP = 32  # stands for every run of characters that aren't letters
#: A document's trigram counts are scaled to this sum, so that each counts alike in its language's bundle.
_SCALE = 1 << 16

#: Trigrams bound at once, trigrams of documents held at once, and characters whose vectors a worker keeps.
_CHUNK, _HELD, _KEPT = 4096, 1 << 18, 40_000

_vectors: dict[int, np.ndarray] = {}
worker_cache("language", _vectors.clear)
_lower = np.zeros(0x110000, np.int32)


def _letters() -> np.ndarray:
    """Code point -> its lower-case code point if it is a letter, else _GAP; filled in once per worker, for all planes."""
    if not _lower[97]:
        _lower[:] = _GAP
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                small = ch.lower()
                _lower[c] = ord(small) if len(small) == 1 else c
    return _lower


def _vector(c: int) -> np.ndarray:
    got = _vectors.get(c)
    if got is None:
        if len(_vectors) >= _KEPT:
            _vectors.clear()
        got = _vectors[c] = (np.random.default_rng([20240229, c]).integers(0, 2, DIMENSIONS) * 2 - 1).astype(np.int8)
    return got


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Distinct trigram codes of the lower-cased letters of a whole text, words apart by one gap, and their counts.

    None if the text is null or has no letters."""
    if not text:
        return None
    c = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    c = np.concatenate(([_GAP], c, [_GAP]))
    c = c[np.concatenate(([True], (c[1:] != _GAP) | (c[:-1] != _GAP)))].astype(np.int64)
    if len(c) < 3:
        return None
    return np.unique((c[:-2] << 42) | (c[1:-1] << 21) | c[2:], return_counts=True)


def bind(codes: np.ndarray) -> np.ndarray:
    """The vectors of trigram codes, one row each."""
    parts = [codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF]
    out = None
    for turn, part in zip((2, 1, 0), parts, strict=True):
        own, at = np.unique(part, return_inverse=True)
        table = np.roll(np.stack([_vector(int(c)) for c in own]), turn, axis=1)[at]
        out = table if out is None else out * table
    return out


def bundles(found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The bundle of each (trigram codes, weights), one row each; whole numbers, exact in single precision where the weights
    of each add up to less than 2**24, else in double (below 2**53)."""
    kind = np.float32 if max(int(f[1].sum()) for f in found) < 1 << 24 else np.float64
    codes = np.concatenate([f[0] for f in found])
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    weights = np.concatenate([f[1] for f in found])[order].astype(kind)
    row = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])[order]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))  # where each distinct code begins
    out = np.zeros((len(found), DIMENSIONS), kind)
    for k in range(0, len(first), _CHUNK):
        low, high = first[k], first[k + _CHUNK] if k + _CHUNK < len(first) else len(codes)
        own = codes[first[k : k + _CHUNK]]
        counts = np.zeros((len(found), len(own)), kind)
        counts[row[low:high], np.searchsorted(own, codes[low:high])] = weights[low:high]
        out += counts @ bind(own).astype(kind)
    return out.astype(np.float64)


def _groups(texts: Iterable[tuple], most: int = 48) -> Iterator[list[tuple]]:
    """(key, trigrams) of the texts (key, text) that have letters, as many at a time as hold _HELD trigrams, `most` at most."""
    held, size = [], 0
    for key, text in texts:
        if (t := trigrams(text)) is None:
            continue
        if held and (len(held) == most or size + len(t[0]) > _HELD):
            yield held
            held, size = [], 0
        held.append((key, t))
        size += len(t[0])
    if held:
        yield held


def fit(docs: DataFrame, training: Column) -> dict[str, np.ndarray]:
    """The bundle of each language over every document for which `training` holds and lang is not null.

    A task sends one row of integers per language; sums of integers do not depend on their order. The driver gets one row
    per language."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("language")
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts = ((lang.as_py(), text.as_py()) for text, lang in zip(batch.column(0), batch.column(1), strict=True))
            for held in _groups(texts):
                found: dict[str, list] = {}
                for lang, (codes, counts) in held:
                    found.setdefault(lang, []).append((codes, counts * _SCALE // counts.sum()))
                for lang, many in found.items():
                    codes, at = np.unique(np.concatenate([c for c, _ in many]), return_inverse=True)
                    one = bundles([(codes, np.bincount(at, np.concatenate([n for _, n in many]), len(codes)))])[0]
                    sums[lang] = sums.get(lang, 0) + np.rint(one).astype(np.int64)
        if sums:
            langs = list(sums)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([sums[x].tolist() for x in langs], pa.list_(pa.int64()))], names=["lang", "bundle"])

    rows = docs.where(training & F.col("lang").isNotNull()).select(F.col("text").cast("string"), "lang").mapInArrow(bundle, "lang string, bundle array<long>")
    sums = rows.select("lang", F.posexplode("bundle")).groupBy("lang", "pos").agg(F.sum("col").alias("v")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("bundle"))
    return {r["lang"]: np.array([x["v"] for x in r["bundle"]], np.float64) for r in sums.collect()}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """docs with lang_pred and score (the cosine, at least 0). `und` and 0 where the text is null or has no letters, or no
    language was learnt; of equal cosines the first language by code point wins. Only text is looked at. Repeated rows get
    equal results, an empty table gives no rows, and columns of docs named lang_pred or score give way to these."""
    docs = docs.select(*(c for c in docs.columns if c not in ("lang_pred", "score")))
    langs = sorted(profiles, key=lambda x: x.encode())
    unit = np.stack([profiles[x] / max(np.linalg.norm(profiles[x]), 1e-12) for x in langs]) if langs else None
    place = docs.columns.index("text")
    schema = docs.select(*docs.columns).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("language")
        for batch in batches:
            texts = batch.column(place)
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            if unit is not None:
                for held in _groups((i, text.as_py()) for i, text in enumerate(texts)):
                    found = bundles([t for _, t in held])
                    cosines = (found @ unit.T) / np.maximum(np.linalg.norm(found, axis=1), 1e-12)[:, None]
                    best = cosines.argmax(axis=1)
                    for k, (i, _) in enumerate(held):
                        names[i] = langs[best[k]]
                        scores[i] = float(min(1.0, max(0.0, cosines[k, best[k]])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=schema.names)
        leave()

    return docs.mapInArrow(run, schema)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    profiles = fit(docs, ~held_out())
    return predict(docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string")), profiles).drop("text")
