"""Search queries: benchmark passages against chunks of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import search
from codeloom.plans.registry import query
from codeloom.sources.adapters import CHUNKS, chunks, table
from codeloom.tables import Scratch

_TERMS = "list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_POST = f"""WITH {CHUNKS}, toks AS (SELECT id, doc_id, {_TERMS.format("content")} AS terms FROM chunks),
lens AS (SELECT id, len(terms)::BIGINT AS length FROM toks),
post AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(terms) AS term FROM toks) GROUP BY 1, 2),
q AS (SELECT DISTINCT item_id AS query, unnest({_TERMS.format("text")}) AS term FROM benchmark),
st AS (SELECT count(*) AS n, avg(length) AS mean FROM lens),
idf AS (SELECT term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT term, count(DISTINCT id) AS df FROM post GROUP BY 1), st),
sc AS (SELECT q.query, p.id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean))), 6) AS score FROM q JOIN post p USING (term) JOIN idf USING (term) JOIN lens USING (id), st GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id)::INT AS rank FROM sc),
top AS (SELECT query, id, score, rank, round(score / max(score) OVER (PARTITION BY query), 6) AS ratio FROM rk WHERE rank <= """


def _scores(spark, d, wanted):
    c = chunks(spark, d)
    post = search.postings(c)
    lengths = c.select(F.size(search.terms(F.col("content"))).alias("length"))
    return search.bm25(post, lengths, wanted)


def _items(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.explode(search.terms(F.col("text"))).alias("term")).distinct()


@query("i1_term_counts", f"WITH {CHUNKS} SELECT id, len({_TERMS.format('content')})::INT AS n_terms, len(list_distinct({_TERMS.format('content')}))::INT AS n_distinct FROM chunks")
def term_counts(spark, d):
    t = search.terms(F.col("content"))
    return chunks(spark, d).select("id", F.size(t).alias("n_terms"), F.size(F.array_distinct(t)).alias("n_distinct"))


@query("i3_bm25_search", _POST + "25) SELECT id, score, rank, ratio FROM top WHERE query = 3")
def bm25_search(spark, d):
    return search.ranked(_scores(spark, d, _items(spark, d).where("query = 3")), 25).select("id", "score", "rank", "ratio")


@query("i7_batch_search", _POST + "5) SELECT query, id, score, rank FROM top")
def batch_search(spark, d):
    """Every benchmark passage at once: one pass over the postings."""
    return search.ranked(_scores(spark, d, _items(spark, d)), 5).select("query", "id", "score", "rank")


_BANDS = "CASE WHEN ratio >= 0.75 THEN 'highly_relevant' WHEN ratio >= 0.5 THEN 'relevant' WHEN ratio >= 0.3 THEN 'loosely_related' ELSE 'not_relevant' END"


@query("i4_relevance_bands", _POST + f"20) SELECT query, {_BANDS} AS band, count(*)::BIGINT AS hits FROM top GROUP BY 1, 2")
def relevance_bands(spark, d):
    return search.ranked(_scores(spark, d, _items(spark, d)), 20).groupBy("query", search.band(F.col("ratio")).alias("band")).agg(F.count("*").alias("hits"))


#: Dependents of a file here: how many events name its number, so that the counts come from another table.
_COUNTS = "n AS (SELECT d.source || '/' || d.doc_id || '.md' AS file, count(*)::BIGINT AS dependents FROM events e JOIN documents d ON d.doc_id = e.user_id GROUP BY 1)"
_IS_TEST = "regexp_matches(file, '[._](test|spec)\\.[^/]+$') OR regexp_matches(file, '(?i)(^|/)(tests?|specs?|__tests__)/')"


def _counts(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("user_id"), F.concat("source", F.lit("/"), "doc_id", F.lit(".md")).alias("file"))
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).join(docs.hint("merge"), "user_id").groupBy("file").agg(F.sum("n").alias("dependents"))


@query("i5_structural_ranking", _POST + f"""25), {_COUNTS}, f AS (SELECT t.query, t.id, t.ratio, c.file, coalesce(n.dependents, 0) AS dependents FROM top t JOIN chunks c USING (id) LEFT JOIN n ON n.file = c.file),
k AS (SELECT query, id, dependents, round(ratio * least(2.0, 1 + 0.15 * ln(1 + dependents)) * CASE WHEN {_IS_TEST} THEN 0.8 ELSE 1.0 END, 6) AS key FROM f)
SELECT query, id, dependents, key, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY key DESC, id)::INT AS rank FROM k) WHERE rank <= 5""")
def structural_ranking(spark, d):
    c = chunks(spark, d)
    return search.structurally_ranked(_scores(spark, d, _items(spark, d)), c, _counts(spark, d), 5).select("query", "id", "dependents", "key", "rank")


@query("i5_ranking_switched_off", _POST + "25) SELECT query, id, ratio AS key, rank FROM (SELECT query, id, ratio, row_number() OVER (PARTITION BY query ORDER BY ratio DESC, id)::INT AS rank FROM top) WHERE rank <= 5")
def ranking_switched_off(spark, d):
    """Without boost and demotion the order is that of the scores."""
    out = search.structurally_ranked(_scores(spark, d, _items(spark, d)), chunks(spark, d), _counts(spark, d), 5, boost=False, demote=False)
    return out.select("query", "id", "key", "rank")


#: Three columns, weights 4, 2 and 1; words of a query are phrases. Every field's terms with their places, then hits by phrase.
_FIELDS = f"""WITH {CHUNKS}, src AS (SELECT id, file, start_line, language, symbol_name, lower(array_to_string(list_transform(regexp_extract_all(symbol_name, '[A-Z]+[a-z]*|[a-z]+|[0-9]+'), lambda x: regexp_replace(x, '^([A-Z]+)([A-Z][a-z]+)$', '\\1 \\2')), ' ')) AS symbol_tokens, content, doc_id FROM chunks),
"""
_WEIGHTED = f"""fl AS (SELECT id, 4.0 AS w, 1 AS f, {_TERMS.format("symbol_name")} AS t FROM live UNION ALL SELECT id, 2.0, 2, {_TERMS.format("symbol_tokens")} FROM live UNION ALL SELECT id, 1.0, 3, {_TERMS.format("content")} FROM live),
lens AS (SELECT id, sum(len(t))::BIGINT AS length FROM fl GROUP BY id), st AS (SELECT count(*) AS n, avg(length) AS mean FROM lens),
ph AS (SELECT query, phrase, count(*) AS times FROM (SELECT query, {_TERMS.format("word")} AS phrase FROM (SELECT query, unnest(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS word FROM asked)) WHERE len(phrase) > 0 GROUP BY 1, 2),
pl AS (SELECT id, w, f, t, unnest(range(1, len(t) + 1)) AS p FROM fl), pw AS (SELECT id, w, f, t[p] AS term, t, p FROM pl),
dp AS (SELECT DISTINCT phrase FROM ph), tf AS (SELECT d.phrase, p.id, sum(p.w) AS tf FROM dp d JOIN pw p ON p.term = d.phrase[1] WHERE len(d.phrase) = 1 OR p.t[p.p:p.p + len(d.phrase) - 1] = d.phrase GROUP BY 1, 2),
idf AS (SELECT phrase, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, st GROUP BY phrase, n),
sc AS (SELECT ph.query, tf.id, round(sum(times * idf * (tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean)))), 6) AS score FROM ph JOIN tf USING (phrase) JOIN idf USING (phrase) JOIN lens USING (id), st GROUP BY 1, 2),
top AS (SELECT *, round(score / max(score) OVER (PARTITION BY query), 6) AS ratio FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id)::INT AS rank FROM sc) WHERE rank <= """
#: Each passage's first words, one of them as a.b, which is a phrase of two terms.
_ASKED = "asked AS (SELECT item_id AS query, array_to_string(string_split(text, ' ')[1:4], ' ') || ' ' || array_to_string(string_split(text, ' ')[5:6], '.') AS text FROM benchmark), "


def _asked(spark, d):
    words = F.split("text", " ")
    text = F.concat(F.array_join(F.slice(words, 1, 4), " "), F.lit(" "), F.array_join(F.slice(words, 5, 2), "."))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query"), text.alias("text"))


@query("i3_weighted_search", _FIELDS + _ASKED + "live AS (SELECT * FROM src), " + _WEIGHTED + "5) SELECT query, id, score, rank FROM top")
def weighted_search(spark, d):
    """Symbol names, their words and contents, weighted; phrases from words with signs inside."""
    c = search.searchable(chunks(spark, d))
    found = search.weighted_bm25(search.positions(c), search.lengths(c), search.phrases(_asked(spark, d)))
    return search.ranked(found, 5).select("query", "id", "score", "rank")


@query("i4_exact_symbols", _FIELDS + _ASKED + """live AS (SELECT * FROM src), """ + _WEIGHTED + """10) SELECT t.query, t.id, CASE WHEN s.symbol_name <> '' AND list_contains(string_split_regex(lower(trim(a.text)), '\\s+'), lower(s.symbol_name)) THEN 'highly_relevant' WHEN ratio >= 0.75 THEN 'highly_relevant' WHEN ratio >= 0.5 THEN 'relevant' WHEN ratio >= 0.3 THEN 'loosely_related' ELSE 'not_relevant' END AS relevance
FROM top t JOIN src s USING (id) JOIN asked a ON a.query = t.query""")
def exact_symbols(spark, d):
    """A chunk whose symbol is a word of the query belongs to the top band, whatever its score."""
    c = search.searchable(chunks(spark, d))
    asked = _asked(spark, d)
    found = search.ranked(search.weighted_bm25(search.positions(c), search.lengths(c), search.phrases(asked)), 10)
    rows = c.select("id", "symbol_name").join(Scratch(spark, "found").sized(found, "found"), "id").join(asked, "query")
    exact = (F.col("symbol_name") != "") & F.array_contains(F.split(F.lower(F.trim("text")), r"\s+"), F.lower("symbol_name"))
    return rows.select("query", "id", search.band(F.col("ratio"), exact).alias("relevance"))


@query("i6_updated_index", _FIELDS + _ASKED + "live AS (SELECT * REPLACE (CASE WHEN doc_id % 7 = 1 THEN content || ' renewed text' ELSE content END AS content) FROM src WHERE doc_id % 7 <> 2), " + _WEIGHTED + "5) SELECT query, id, score, rank FROM top")
def updated_index(spark, d):
    """Stored postings after one change: some files have new contents, some are gone."""
    c = chunks(spark, d)
    index = search.PostingsIndex(spark, Scratch(spark, "postings").path("index"), buckets=16)
    index.update(c)
    index.update(c.where("doc_id % 7 = 1").withColumn("content", F.concat("content", F.lit(" renewed text"))), c.where("doc_id % 7 = 2").select("file"))
    return search.ranked(index.search(_asked(spark, d)), 5).select("query", "id", "score", "rank")


@query("i8_related_chunks", _FIELDS + """asked AS (SELECT file AS query, arg_min(content, start_line) AS text FROM src WHERE file IN (SELECT DISTINCT file FROM src ORDER BY file LIMIT 50) GROUP BY file), live AS (SELECT * FROM src), """ + _WEIGHTED + "5) SELECT t.query AS file, t.id, t.rank FROM top t JOIN src s USING (id) WHERE s.file <> t.query AND s.language <> 'fr'")
def related_chunks(spark, d):
    """For the fifty files that one call may ask for: what their first chunk finds, cut to five, then filtered. French stands for
    the language that is left out."""
    c = search.searchable(chunks(spark, d)).withColumn("language", F.when(F.col("language") == "fr", "markdown").otherwise(F.col("language")))
    files = c.select("file").distinct().orderBy("file").limit(50)
    return search.related(c, files, search.positions(c), search.lengths(c)).select("file", "id", "rank")


@query("i2_phrase_search", f"WITH {CHUNKS}, t AS (SELECT id, {_TERMS.format('content')} AS terms FROM chunks), p AS (SELECT id, terms, unnest(range(1, len(terms) + 1)) AS pos FROM t) SELECT id, count(*)::BIGINT AS hits FROM p WHERE terms[pos] = 'of' AND terms[pos + 1] = 'the' GROUP BY id")
def phrase_search(spark, d):
    return search.phrase_hits(chunks(spark, d), "of.the")


@query("i7_find_similar", _POST.replace("FROM benchmark)", "FROM documents WHERE doc_id = 11)").replace("item_id AS query", "doc_id AS query") + "16) SELECT id, score, rank FROM top WHERE ratio >= 0.3 AND rank <= 5")
def find_similar(spark, d):
    """The chunks nearest to one document's text: limit, then prune, then cut."""
    wanted = table(spark, d, "documents").where("doc_id = 11").select(F.col("doc_id").alias("query"), F.explode(search.terms(F.col("text"))).alias("term")).distinct()
    return search.ranked(_scores(spark, d, wanted), 16).where("ratio >= 0.3 AND rank <= 5").select("id", "score", "rank")


@query("g24_ranking_quality", _POST + """5), truth AS (SELECT b.item_id AS query, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
f AS (SELECT t.query, min(rank) AS rank FROM top t JOIN truth u ON t.query = u.query AND t.id // 1000000 = u.doc_id GROUP BY 1), a AS (SELECT DISTINCT query FROM truth)
SELECT round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_1, round(avg(CASE WHEN rank IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS recall_at_5, round(avg(coalesce(1.0 / rank, 0.0)), 6) AS mrr FROM a LEFT JOIN f USING (query)""")
def ranking_quality(spark, d):
    top = search.ranked(_scores(spark, d, _items(spark, d)), 5)
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("passage"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    # Candidates by the passage's first words (an equi key), a table that texts meet where they are; then the exact test.
    words = lambda c: F.regexp_extract_all(c, F.lit(r"(?=(\S+ \S+ \S+))"), F.lit(1))
    keyed = docs.select("doc_id", "text", F.explode(F.array_distinct(words(F.col("text")))).alias("key"))
    first = items.withColumn("key", F.array_join(F.slice(F.split("passage", " "), 2, 3), " "))
    scratch = Scratch(spark, "truth")
    truth = keyed.join(scratch.sized(first, "first"), "key").where(F.col("text").contains(F.col("passage"))).select("query", "doc_id").distinct()
    truth = scratch.table(truth, "truth")
    hit = top.withColumn("doc_id", F.floor(F.col("id") / 1_000_000)).join(truth, ["query", "doc_id"]).groupBy("query").agg(F.min("rank").alias("rank"))
    out = truth.select("query").distinct().join(hit, "query", "left")
    mean = lambda c: F.round(F.avg(c), 6)
    return out.agg(mean(F.when(F.col("rank") == 1, 1.0).otherwise(0.0)).alias("recall_at_1"), mean(F.when(F.col("rank").isNotNull(), 1.0).otherwise(0.0)).alias("recall_at_5"), mean(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"))
