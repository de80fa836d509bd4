"""The corpus pipeline: language ID, line dedup, near-duplicate join, curriculum mix, packing.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept and returns the columns of documents, but
for the last, which returns packed pieces. Between stages documents are written and read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import language_id, line_dedup, mixing, ngram_join, packing
from codeloom.llm.common import Scratch, text_or_empty

#: A text of at least so many letters that is this unlike every known language is rejected.
LETTERS, LEAST_SCORE = 200, 0.2
#: Near copies: a Jaccard similarity of so many percent between sets of word n-grams of this width.
WIDTH, PERCENT = 5, 80
_scratch: list[Scratch] = []


def _own(spark: SparkSession, name: str) -> Scratch:
    """Scratch tables of a stage; those of the stage before, whose result has been written, go."""
    while _scratch:
        _scratch.pop().drop()
    _scratch.append(Scratch(spark, f"pipeline-{name}"))
    return _scratch[-1]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters (null, empty, signs only) and long ones that no profile comes near."""
    _own(spark, "language")
    profiles = language_id.fit(docs.select("doc_id", "text", "lang"), ~language_id.held_out())
    plain = docs.select(*docs.columns).toDF(*(f"{c}" if c == "text" else f"doc_{c}" for c in docs.columns))
    found = language_id.predict(plain, profiles)
    letters = F.length(F.regexp_replace("text", r"\P{L}+", ""))
    strange = F.when((F.col("score") < LEAST_SCORE) & F.lit(bool(profiles)), letters >= LETTERS).otherwise(False)
    known = F.lit(not profiles) | (F.col("lang_pred") != "und")
    kept = found.where(known & ~strange)
    return kept.select(*(F.col(c if c == "text" else f"doc_{c}").alias(c) for c in docs.columns))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines; a document keeps its row even if no line stays. n_chars follows the text."""
    keep = line_dedup.keep_bitmaps(docs.select("doc_id", "text"), _own(spark, "lines")).select(F.col("doc_id").alias("_kept_id"), F.when(F.col("n_dropped") > 0, F.col("keep")).alias("_keep"))
    schema = docs.schema
    at = docs.columns.index("text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text if keep is None else line_dedup.kept_text(text, keep) for text, keep in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    joined = docs.join(keep, docs["doc_id"].eqNullSafe(keep["_kept_id"]), "left").select(*(docs[c] for c in docs.columns), "_keep")
    return _with_length(joined.mapInArrow(apply, schema))


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one with the smallest doc_id stays; documents without doc_id stay."""
    found = ngram_join.components(docs.select("doc_id", "text"), _own(spark, "ngrams"), WIDTH, PERCENT)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per copy that the mix takes, in training order; the copy within which a source's target ends is taken whole,
    so a source may be above its target by less than one document. Documents without words have no copies; a null source is
    a source of its own, a null doc_id orders as the empty string, repeated rows are taken each."""
    scratch = _own(spark, "mix")
    rows = docs.select(F.col("doc_id"), F.col("source"), mixing.word_count(text_or_empty()).alias("size"), F.struct(*docs.columns).alias("row"))
    copies = mixing.curriculum(rows, scratch).select("row", "doc_id", F.explode("copies").alias("taken"))
    out = mixing.range_sorted(copies.select("row", "doc_id", "taken.copy", "taken.position"))
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of every copy that the mix took. Null and empty texts are their end id alone, null doc_ids stay null,
    copies and repeated rows are packed each, an empty table gives no rows, other columns stay behind."""
    return packing.pack(docs, _own(spark, "packing"), public_tokenizers.path("byte_bpe_50k.json"), memo=250_000)  # beside what other stages leave


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Tokens, trained profiles and near-duplicate components are beyond SQL; tests compare all rows with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. A stage's documents go once the next one's are written; the last ones go with the application."""
    docs, earlier = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    between = Scratch(spark, "pipeline-docs")
    for name, stage in STAGES[:-1]:
        docs = between.table(stage(spark, docs, sf_dir), name)
        if earlier is not None:
            between.drop(earlier)
        earlier = docs
    return STAGES[-1][1](spark, docs, sf_dir)
