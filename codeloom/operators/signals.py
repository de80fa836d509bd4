"""Change-review signals over diff lines: pure joins and gates, no models."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.columns import code_shaped
from codeloom.tables import Scratch, partitions

#: Words that are no identifiers worth following.
KEYWORDS = ("the", "and", "def", "class", "return", "import", "from", "for", "with", "self", "this", "null", "true", "false", "none", "const", "let", "var", "function")


def diff_lines(patches: DataFrame) -> DataFrame:
    """file, line (new side), sign (+, -, space), text from (file, patch) in unified format.

    One generator and one window per file: the new-side number is the hunk's start plus the added and context lines so far."""
    lines = patches.select("file", F.posexplode(F.split("patch", "\n")).alias("at", "text"))
    start = F.regexp_extract("text", r"^@@ -\d+(?:,\d+)? \+(\d+)", 1)
    order = Window.partitionBy("file").orderBy("at")
    lines = lines.withColumn("hunk", F.sum(F.when(start != "", 1).otherwise(0)).over(order)).withColumn("start", F.when(start != "", start.cast("int")))
    inside = Window.partitionBy("file", "hunk").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when((F.col("start").isNull()) & (F.substring("text", 1, 1) != "-"), 1).otherwise(0)
    n = F.first("start", ignorenulls=True).over(inside) + F.sum(step).over(inside) - 1
    out = lines.withColumn("line", n).where(F.col("start").isNull() & (F.col("hunk") > 0) & (F.col("text") != "\\ No newline at end of file"))
    sign = F.when(F.substring("text", 1, 1).isin("+", "-"), F.substring("text", 1, 1)).otherwise(" ")
    return out.select("file", F.when(sign != "-", F.col("line")).alias("line"), sign.alias("sign"), F.substring("text", 2, 1 << 30).alias("text"))


def touched_chunks(lines: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks (file, start_line, end_line) that a touched line falls into: a range join through line buckets."""
    width = 75
    c = chunks.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_line") / width), F.floor(F.col("end_line") / width))))
    t = lines.where("sign <> '-'").select("file", "line").distinct().withColumn("bucket", F.floor(F.col("line") / width))
    return c.join(t, ["file", "bucket"]).where("line BETWEEN start_line AND end_line").select(*chunks.columns).distinct()


def rename_swaps(removed: DataFrame, added: DataFrame, least_count: int = 5, least_files: int = 3) -> DataFrame:
    """from, to, occurrences, files: line pairs (file, k) that differ in one identifier, always the same for the same one."""
    words = lambda c: F.split(c, r"[^A-Za-z0-9_]+")
    pairs = removed.select("file", "k", words(F.col("text")).alias("a")).join(added.select("file", "k", words(F.col("text")).alias("b")), ["file", "k"])
    zipped = F.filter(F.arrays_zip("a", "b"), lambda z: z["a"] != z["b"])
    pairs = pairs.where(F.size("a") == F.size("b")).withColumn("d", F.array_distinct(zipped)).where(F.size("d") == 1)
    swap = pairs.select("file", F.col("d")[0]["a"].alias("from"), F.col("d")[0]["b"].alias("to"))
    ok = (F.length("from") > 2) & (F.length("to") > 2) & ~F.lower("from").isin(*KEYWORDS)
    g = swap.where(ok).groupBy("from", "to").agg(F.count("*").alias("occurrences"), F.countDistinct("file").alias("files"))
    one = F.count("*").over(Window.partitionBy("from")) == 1
    return g.where((F.col("occurrences") >= least_count) & (F.col("files") >= least_files)).withColumn("one", one).where("one").drop("one")


def survivors(tokens: DataFrame, chunks: DataFrame, changed: DataFrame, per_token: int = 5) -> DataFrame:
    """token, file, start_line: chunks outside the changed files that still name a token, the first few of each.

    Words are cut where a letter, digit or underscore ends, so that the equi-join on them is the test; contents stay in the scan."""
    words = chunks.join(changed, "file", "left_anti").select("file", "start_line", F.explode(F.array_distinct(F.split("content", r"[^A-Za-z0-9_]+"))).alias("token"))
    hit = words.join(tokens.select("token").distinct(), "token")
    w = Window.partitionBy("token").orderBy("file", "start_line")
    return hit.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_token).select("token", "file", "start_line")


def stale_literals(touched: DataFrame, literals: DataFrame, areas: int = 3) -> DataFrame:
    """literal, file for touched literals that stand elsewhere too, unless they are everywhere (`areas` folders or more)."""
    other = literals.join(touched.select("literal").distinct(), "literal").join(touched.select("literal", "file"), ["literal", "file"], "left_anti")
    wide = other.groupBy("literal").agg(F.countDistinct("area").alias("n")).where(F.col("n") < areas).select("literal")
    return other.join(wide, "literal").select("literal", "file").distinct()


def unmirrored(added: DataFrame, family: DataFrame, least: int = 2) -> DataFrame:
    """family, token: calls that at least max(2, half) of the untouched siblings share but the changed file lacks."""
    shared = family.where("NOT changed").groupBy("family", "token").agg(F.countDistinct("file").alias("n"))
    size = family.where("NOT changed").groupBy("family").agg(F.countDistinct("file").alias("siblings")).where(F.col("siblings") >= least)
    gate = shared.join(size, "family").where(F.col("n") >= F.greatest(F.lit(least), F.ceil(F.col("siblings") / 2)))
    return gate.join(added.select("family", "token").distinct(), ["family", "token"], "left_anti").select("family", "token", "n", "siblings")


def cited(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings stay unless they quote spans and none of them stands in the file; without spans or file they stay."""
    j = findings.join(files, "file", "left")
    found = F.exists("spans", lambda s: F.col("content").contains(s))
    return j.where((F.size("spans") == 0) | F.col("content").isNull() | found).select(*findings.columns)


#: Signs that continue a name in prose; fences; what a claim looks like and, for some, what must stand near it.
CONTINUATION = r"A-Za-z0-9_.\-"
FENCE = r"^(?:```|~~~)"
CLAIMS = (
    (r"\b(?:meaning-based|semantic(?:ally)?|lexical|keyword-based|embedding-based|bm25|full-text|substring)\b", r"\b(?:search|match(?:ing)?|similar|discover|rank(?:ing|ed)?|index|quer|token)"),
    (r"\breports?\s+as\s+(?:disabled|enabled|inactive|active|unavailable)\b", None),
    (r"\b(?:disabled|enabled|inactive|inert|no-?op|ignored|unavailable|read-only|optional|required|active)\s+(?:when|unless|if|without)\b", None),
    (r"\bdefaults?\s+(?:to|:)|\bby default\b|default:\s*(?:true|false|\d)", None),
    (r"\b(?:exists?|has (?:an?|no) index|is present|is absent|is missing|no longer exists?)\b", r"\b(?:fall(?:s)? back|fallback|otherwise|unless|only if|standalone|if (?:either|the|it|not))\b"),
    (r"\b(?:are|is|remains?|stays?)\s+(?:\w+\s+){0,3}unchanged\b|\botherwise\s+unchanged\b", None),
    (r"\brequires?\b|\brequired\b", None),
    (r"\b(?:does|do|is|are|it|they|which|that)\s+not\s+\w+", None),
)
#: Histories and their folders, words that say that something is past, links, headings and bullets.
HISTORY = r"(?i)(?:^|/)CHANGELOG[^/]*(?:\.md)?\z|(?:^|/)\.changeset/"
PAST = r"(?i)\b(?:was|were)\s+(?:removed|renamed|deleted|retired|dropped)\b|\b(?:retired|formerly|deprecated|previously|prior to|no longer|used to)\b"
LINKS = r"\[[^\]]*\]\([^)]*\)|https?://\S+"
POINTS = r"^#{1,6}\s|^\s*[-*]\s"
#: Files that guide agents and readers.
GUIDANCE = (r"(?:^|/)CLAUDE\.md\z", r"^(?:plugins|\.cursor)/.*\.(?:sh|mdc)\z", r"^docs/.*\.md\z", r"^packages/site/docs/.*\.md\z", r"^\.changeset/[^/]*\.md\z")


def claims(text: Column) -> Column:
    """Does a line of prose claim how something behaves?"""
    out = F.lit(False)
    for pattern, near in CLAIMS:
        hit = text.rlike(f"(?i){pattern}")
        out = out | (hit & text.rlike(f"(?i){near}") if near else hit)
    return out


def prose_pattern(token: Column) -> Column:
    """A pattern for the token (plain words, slashes and dots) with nothing that continues it at either side.

    Where words meet tokens it must be a stored column: made from the token, it would be tried on every word before they meet."""
    quoted = F.concat(F.lit("\\Q"), token, F.lit("\\E"))
    return F.concat(F.lit(f"(?<![{CONTINUATION}])"), quoted, F.lit(f"(?![{CONTINUATION}])"))


def names_in_prose(text: Column, token: Column) -> Column:
    """The token stands in text, see prose_pattern()."""
    return F.regexp_like(text, prose_pattern(token))


def _lines(docs: DataFrame) -> DataFrame:
    """file, id, start_line, at, text, fenced of every line of doc chunks (id, file, start_line, content): fenced lies between fences."""
    rows = docs.select("file", "id", "start_line", F.posexplode(F.split("content", "\n")).alias("at", "text"))
    fence = F.trim("text").rlike(FENCE)
    before = F.sum(F.when(fence, 1).otherwise(0)).over(Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("fenced", F.coalesce(before, F.lit(0)) % 2 == 1)


def prose_lines(docs: DataFrame) -> DataFrame:
    """file, id, line, text, fenced, claim of _lines(): claim says that the line or one of the two before or three after it claims
    something."""
    near = Window.partitionBy("id").orderBy("at").rowsBetween(-2, 3)
    rows = _lines(docs).withColumn("claim", F.bool_or(claims(F.col("text"))).over(near))
    return rows.select("file", "id", (F.col("start_line") + F.col("at")).alias("line"), "text", "fenced", "claim")


def docs_drift(referands: DataFrame, docs: DataFrame, changed: DataFrame, per_referand: int = 5, most: int = 15) -> DataFrame:
    """referand, kind, file, line, tier, place: lines of untouched documentation that still name what a change removed, renamed or
    deleted.

    Of each referand (referand, kind) the first `per_referand` lines in chunk order count; of those a history's, fenced ones,
    ones that speak of the past, and mentions inside links alone don't. A line near a claim is a behavioral claim, a heading or
    bullet a structural mention, others drop out; claims first, `most` in all. Lines meet referands by their words, an
    equi-join, before the exact test."""
    lines = prose_lines(docs.join(changed, "file", "left_anti"))
    key = lambda c: F.filter(F.split(c, r"[^A-Za-z0-9_]+"), lambda t: t != "")
    first = referands.select("referand", "kind", F.get(key(F.col("referand")), F.lit(0)).alias("key")).distinct()
    hit = lines.withColumn("key", F.explode(F.array_distinct(key(F.col("text"))))).join(first, "key").where(names_in_prose(F.col("text"), F.col("referand")))
    w = Window.partitionBy("referand", "kind").orderBy("id", "line")
    hit = hit.withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_referand)
    outside = F.regexp_replace("text", LINKS, " ")
    kept = hit.where(~F.col("file").rlike(HISTORY) & ~F.col("fenced") & ~F.col("text").rlike(PAST) & names_in_prose(outside, F.col("referand")))
    tier = F.when(F.col("claim"), "behavioral-claim").when(F.col("text").rlike(POINTS), "structural-mention")
    kept = kept.withColumn("tier", tier).where("tier IS NOT NULL")
    order = F.col("tier") != "behavioral-claim", F.col("referand"), F.col("file"), F.col("line")
    top = kept.orderBy(*order).limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order))).select("referand", "kind", "file", "line", "tier", "place")  # over `most` rows


def guidance_changes(patches: DataFrame, most: int = 12_000, per_file: int = 3_000, frame: int = 64) -> DataFrame:
    """file, shown, cut, omitted: how many characters of each guidance file's patch fit a budget, shortest patches first. A patch
    above `per_file` or above what is left is cut; once nothing is left, later files are omitted."""
    rows = patches.where(F.greatest(*(F.col("file").rlike(p) for p in GUIDANCE))).select("file", F.length("patch").alias("n"))
    w = Window.orderBy("n", "file").rowsBetween(Window.unboundedPreceding, -1)  # the guidance files of one change
    used = F.coalesce(F.sum(F.least(F.col("n"), F.lit(per_file)) + F.length("file") + frame).over(w), F.lit(0))
    room = F.least(F.lit(per_file), F.lit(most) - used - F.length("file") - frame)
    rows = rows.withColumn("room", room)
    shown = F.when(F.col("room") > 0, F.least(F.col("n"), F.col("room"))).otherwise(0)
    return rows.select("file", shown.cast("long").alias("shown"), (F.col("n") - shown).cast("long").alias("cut"), (F.col("room") <= 0).alias("omitted"))


def distinctive_in(tokens: DataFrame, docs: DataFrame) -> DataFrame:
    """token for those whose naming in documentation means the code: by their shape, or because documentation never names them but
    in fences, beside a slash or in backticks. docs (id, file, start_line, content)."""
    beside = rf"[{CONTINUATION}/`]"
    bare = F.concat(F.lit(f"(?<!{beside})"), F.col("token"), F.lit(f"(?!{beside})"))
    shaped = tokens.select("token").distinct().withColumn("shaped", code_shaped(F.col("token"))).withColumn("bare", bare)
    shaped = Scratch(docs.sparkSession, "tokens").sized(shaped, "tokens")
    plain = shaped.where("NOT shaped").select("token", "bare")
    lines = _lines(docs).where("NOT fenced").select("text", F.explode(F.array_distinct(F.filter(F.split("text", r"[^A-Za-z0-9_]+"), lambda t: t != ""))).alias("token"))
    said = lines.join(plain, "token").where(F.regexp_like("text", F.col("bare"))).select("token").distinct()
    return shaped.join(said.hint("merge"), "token", "left_anti").select("token")


#: Where a clause begins, what tells errors apart, logging calls, words before a bracket that are no calls.
CATCH = re.compile(r"\bcatch\s*(?:\(\s*([A-Za-z_$][\w$]*)\s*(?::\s*[^)]+)?\s*\))?\s*\{")
LOGGING = re.compile(r"\b(?:console|logger|log)\s*\.\s*(?:debug|info|warn|warning|error|trace|log)\s*\([^)]*\)\s*;?", re.I)
TELLING = "status|code|name|statusCode|errno|type"
NO_CALLS = frozenset("if for while switch catch return throw function typeof instanceof new do try yield await void delete in of".split())


def masked(code: str) -> str:
    """Strings, templates and comments of JavaScript as blanks, line ends kept."""
    parts = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|'(?:\\.|[^'\\\n])*'?|\"(?:\\.|[^\"\\\n])*\"?|`(?:\\.|[^`\\])*`?", re.S)
    return parts.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), code)


def _closing(code: str, at: int) -> int:
    depth = 0
    for i in range(at, len(code)):
        depth += (code[i] == "{") - (code[i] == "}")
        if not depth:
            return i
    return -1


def indiscriminate(binding: str | None, body: str) -> bool:
    """A masked catch body that treats every error alike and goes on: it neither looks at the error's kind nor throws at its
    end, and does more than log."""
    if not binding or re.search(r"\binstanceof\b", body) or re.search(rf"\b{re.escape(binding)}\s*\.\s*(?:{TELLING})\b", body):
        return False
    depth, top = 0, []
    for ch in body:
        depth += (ch == "{") - (ch == "}")
        top.append(ch if depth == 0 and ch != "}" else "")
    text = "".join(top)
    if re.search(r"\bthrow\b[^;]*;?\s*\Z", text.strip()):
        return False
    text = LOGGING.sub("", text)
    return bool(re.search(r"\breturn\s+[^\s;][^;\n]*(?:;|$)", text, re.M)) or any(m[1] not in NO_CALLS for m in re.finditer(r"\b([A-Za-z_$][\w$]*)\s*\(", text))


def catch_clauses(chunks: DataFrame) -> DataFrame:
    """file, line, end_line, binding of the catch clauses of JavaScript and TypeScript chunks (file, start_line, content) that treat
    errors alike. Braces have to be matched, so batches go through Arrow, dealt to all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file, start, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                code = masked(content or "")
                for m in CATCH.finditer(code):
                    end = _closing(code, m.end() - 1)
                    if end >= 0 and indiscriminate(m[1], code[m.end() : end]):
                        out.append((file, start + code.count("\n", 0, m.start()), start + code.count("\n", 0, end), m[1]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.string()))], names=["file", "line", "end_line", "binding"])

    code = chunks.where(F.col("file").rlike(r"\.[cm]?[jt]sx?\z")).select("file", F.col("start_line").cast("int"), "content")
    return code.repartition(partitions(code)).mapInArrow(run, "file string, line int, end_line int, binding string")


def undiscriminated_catches(chunks: DataFrame, touched: DataFrame, width: int = 75) -> DataFrame:
    """catch_clauses() that a changed line (file, line) falls into, each once: a range join through line buckets."""
    c = catch_clauses(chunks).distinct().withColumn("bucket", F.explode(F.sequence(F.floor(F.col("line") / width), F.floor(F.col("end_line") / width))))
    t = touched.select("file", F.col("line").alias("touched")).distinct().withColumn("bucket", F.floor(F.col("touched") / width))
    return c.join(t, ["file", "bucket"]).where("touched BETWEEN line AND end_line").select("file", "line", "end_line", "binding").distinct()
