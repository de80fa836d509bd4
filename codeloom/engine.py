"""The engine's front: each tool as a method that returns a lazy DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import columns as C
from codeloom.operators import graph, metrics, search, store
from codeloom.operators import imports as I
from codeloom.tables import Scratch


def _within(name: str, value: int, low: int, high: int) -> int:
    if not low <= value <= high:
        raise ValueError(f"{name}: {low} to {high}")
    return value


def _path(p: str) -> str:
    if not p or p.startswith("/") or ".." in p.split("/"):
        raise ValueError("paths are relative and stay inside the repository")
    return p


@dataclass
class Engine:
    """chunks (id, file, start_line, end_line, content, language, symbol_name, symbol_type, and metrics where known) and
    specifiers (importer, specifier). `counts` is null where dependents were never computed; `index` holds stored postings and
    `edges` stored edges, else the first call makes them; `boost` and `demote` switch structural ranking off."""

    chunks: DataFrame
    specifiers: DataFrame | None = None
    counts: DataFrame | None = None
    index: search.PostingsIndex | None = None
    edges: I.EdgeIndex | None = None
    boost: bool = True
    demote: bool = True
    _stored: DataFrame | None = field(default=None, init=False, repr=False)

    def _edges(self) -> DataFrame:
        if self.edges is not None:
            return self.edges.edges()
        if self.specifiers is None:
            raise ValueError("no import specifiers indexed")
        if self._stored is None:
            self._stored = Scratch(self.specifiers.sparkSession, "engine").table(I.import_edges(self.specifiers, self.chunks.select("file").distinct()), "edges")
        return self._stored

    def _hits(self, text: str, limit: int) -> DataFrame:
        session = self.chunks.sparkSession
        asked = session.range(1).select(F.lit(0).alias("query"), F.lit(text).alias("text"))
        if self.index is not None:
            scores = self.index.search(asked)
        else:
            rows = search.searchable(self.chunks)
            scores = search.weighted_bm25(search.positions(rows), search.lengths(rows), search.phrases(asked))
        hits = search.structurally_ranked(scores, self.chunks, self.counts, limit, self.boost, self.demote)
        rows = self.chunks.join(Scratch(session, "engine").sized(hits.select("id", "ratio", "key", "rank"), "hits"), "id")
        words = F.array(*(F.lit(w) for w in dict.fromkeys(text.lower().split()))) if text.split() else F.array().cast("array<string>")
        name = F.lower(F.coalesce("symbol_name", F.lit("")))
        rows = rows.withColumn("relevance", search.band(F.col("ratio"), (name != "") & F.array_contains(words, name)))
        return rows.withColumn("score", F.floor((1 - F.col("ratio")) * 2 * 10_000 + 0.5) / 10_000)

    def search(self, query: str, limit: int = 5) -> DataFrame:
        """Best chunks for words, one for each range of lines; if every hit is irrelevant there are none."""
        hits = store.distinct_ranges(self._hits(query, _within("limit", limit, 1, 50)), "rank")
        any_good = F.max(F.col("relevance") != "not_relevant").over(Window.partitionBy())  # over `limit` rows
        return hits.withColumn("any", any_good).where("any").drop("any").orderBy("rank")

    def find_similar(self, code: str, limit: int = 5, language: str | None = None, hint: str | None = None) -> DataFrame:
        """Chunks like a snippet: fetch, filter, cut."""
        if not 24 <= len(code) <= 50_000:
            raise ValueError("code: 24 to 50000 characters")
        hits = store.without_self(self._hits(code, _within("limit", limit, 1, 20) + 11), code).where("relevance <> 'not_relevant'")
        hits = store.by_language(hits, language) if language else hits
        hits = store.path_hint(hits, hint) if hint else hits
        return hits.orderBy("rank").limit(limit)

    def related(self, files: list[str]) -> DataFrame:
        """file, id, rank: chunks of other files that each file's first chunk finds."""
        _within("files", len(files), 1, 50)
        rows = search.searchable(self.chunks)
        asked = self.chunks.where(F.col("file").isin([_path(f) for f in files])).select("file")
        return search.related(rows, asked, search.positions(rows), search.lengths(rows))

    def files_context(self, files: list[str]) -> DataFrame:
        """Chunks of the files with their dependents; null where those were never counted."""
        _within("files", len(files), 1, 50)
        rows = store.by_files(self.chunks, [_path(f) for f in files])
        return rows.withColumn("dependents", F.lit(None).cast("long")) if self.counts is None else store.honest_counts(rows, self.counts, True, F.lit(False))

    def list_symbols(self, pattern: str | None = None, language: str | None = None, kind: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        rows = store.by_symbol(self.chunks, language, pattern, kind)
        return store.list_page(store.distinct_ranges(rows, "id"), ["file", "start_line", "id"], _within("limit", limit, 1, 200), _within("offset", offset, 0, 10_000))

    def dependents(self, file: str, depth: int = 1, most: int = 500) -> DataFrame:
        """Files that reach `file` through imports: nearest first, production before tests."""
        seeds = self.chunks.where(F.col("file") == _path(file)).select("file").distinct()
        rows = graph.capped(graph.expand(seeds, self._edges(), _within("depth", depth, 1, 5)), _within("most", most, 1, 5000))
        return rows.select(F.col("node").alias("file"), "hops", "truncated", C.is_test_file(F.col("node")).alias("is_test")).orderBy("hops", "is_test", "file")

    def complexity(self, top: int = 10, thresholds: dict[str, float] | None = None, files: list[str] | None = None) -> DataFrame:
        rows = metrics.violations(self.chunks, thresholds or metrics.THRESHOLDS)
        rows = rows.where(store.matches_any(F.col("file"), files)) if files else rows
        return rows.orderBy(F.desc("value"), "file", "start_line", "metric").limit(_within("top", top, 1, 100))

    def annotate(self, file: str) -> DataFrame:
        """file, dependents, uncovered, risk, reasons."""
        edges = self._edges()
        mine = edges.where(F.col("file") == _path(file))
        tests = edges.where(C.is_test_file(F.col("importer"))).select(F.col("file").alias("importer")).distinct()
        open_ = mine.where(~C.is_test_file(F.col("importer"))).join(tests, "importer", "left_anti")
        n = mine.agg(F.countDistinct("importer").alias("dependents")).withColumn("k", F.lit(1)).join(open_.agg(F.countDistinct("importer").alias("uncovered")).withColumn("k", F.lit(1)), "k")
        boost = F.lit(None).cast("string")
        level = C.blast_risk(F.col("dependents"), F.col("uncovered"), F.lit(False), boost)
        reasons = C.blast_reasons(F.col("dependents"), F.col("uncovered"), F.lit(False), F.lit(None).cast("int"), boost)
        return n.select(F.lit(file).alias("file"), "dependents", "uncovered", level.alias("risk"), reasons.alias("reasons"))

    def api_delta(self, before: DataFrame, after: DataFrame) -> DataFrame:
        """Exported signatures (file, symbol, start_line, signature) added, removed or changed."""
        clean = C.normal_signature
        j = metrics.paired(before, after, ["file", "symbol"], ["start_line", "signature"], ["signature"])
        b, a = clean(F.col("before_signature")), clean(F.col("after_signature"))
        change = F.when(b.isNull(), "added").when(a.isNull(), "removed").when(a != b, "changed")
        return j.withColumn("change", change).where(F.col("change").isNotNull() & ~F.col("symbol").startswith("#")).orderBy(F.col("change") != "removed", "file", "symbol", "ordinal")
