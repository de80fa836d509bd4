"""Claims in documentation with the code that may prove them, and variants of a type that its consumers don't know yet."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators import signals as S
from codeloom.tables import Scratch, partitions

#: What names a thing in prose, and the plain words in backticks that don't; shortest name that counts.
NAMED = (r"\b[A-Za-z_$][\w$-]*(?:\.[\w$*-]+)+", r"\b[A-Za-z][a-z0-9]*(?:[A-Z][a-z0-9]*)+\b", r"\b[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+\b")
STOP_WORDS = ("true", "false", "null", "undefined", "string", "number", "object", "return", "import", "export", "const", "type", "when", "then", "with", "from", "that", "this", "note")
LEAST_NAME = 4
#: How much a chunk proves, least first; what a test and a document are here.
TIERS = ("test", "doc", "code", "changed-doc", "changed-code", "symbol-match", "same-file")
TEST_PATH, DOC_PATH = r"\.test\.|\.spec\.|/tests?/|__tests__|/spec/", r"\.mdc?\z"


def added_claims(lines: DataFrame) -> DataFrame:
    """file, line, claim: added lines of prose that claim something, from diff lines (file, line, sign, text) of guidance files.

    Fences of the new side hide what lies between them, tables don't count, links lose their targets; a claim that is said twice
    counts where it comes first."""
    side = lines.where("sign <> '-'").withColumn("t", F.trim("text"))
    fence = F.col("t").rlike(S.FENCE)
    w = Window.partitionBy("file").orderBy("line")
    before = F.sum(F.when(fence, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    side = side.withColumn("fenced", F.coalesce(before, F.lit(0)) % 2 == 1)
    prose = side.where((F.col("sign") == "+") & ~F.col("fenced") & ~fence & (F.col("t") != "") & ~F.col("t").startswith("|"))
    said = prose.withColumn("claim", F.regexp_replace("t", r"\[([^\]]*)\]\([^)]*\)", "$1")).where(S.claims(F.col("claim")))
    first = said.groupBy("claim").agg(F.min(F.struct("file", "line")).alias("at"))
    return first.select("at.file", "at.line", "claim")


def anchors(text: Column) -> Column:
    """Names in a text: dotted, with inner capitals or underscores, and the words in backticks that aren't ordinary ones."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in NAMED]
    spans = F.array_join(F.regexp_extract_all(text, F.lit(r"`([^`]+)`"), F.lit(1)), " ")
    plain = F.filter(F.regexp_extract_all(spans, F.lit(r"[A-Za-z][A-Za-z0-9]*"), F.lit(0)), lambda w: ~F.lower(w).isin(*STOP_WORDS))
    return F.filter(F.array_distinct(F.concat(*found, plain)), lambda w: F.length(w) >= LEAST_NAME)


def evidence(claims: DataFrame, chunks: DataFrame, changed: DataFrame) -> DataFrame:
    """file, line, claim, id, evidence_file, tier, matched: for each claim the chunk (id, file, content, symbol_name) that says most
    about its names: by tier, then by how many it holds, then the first. Chunks of the claim's own file don't count, tests least.

    Names meet chunks by their first word, an equi-join; only then is the whole name looked for."""
    names = claims.select("file", "line", "claim", F.explode(anchors(F.col("claim"))).alias("anchor"))
    names = names.withColumn("key", F.regexp_extract("anchor", r"[A-Za-z0-9_$]+", 0))
    words = chunks.select("id", F.col("file").alias("evidence_file"), "content", "symbol_name", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"[A-Za-z0-9_$]+"), F.lit(0)))).alias("key"))
    hit = names.join(words, "key").where((F.col("file") != F.col("evidence_file")) & F.col("content").contains(F.col("anchor")))
    per = hit.groupBy("file", "line", "claim", "id", "evidence_file").agg(F.countDistinct("anchor").alias("matched"), F.bool_or(F.coalesce(F.col("symbol_name") == F.col("anchor"), F.lit(False))).alias("symbol"))
    per = per.join(changed.select(F.col("file").alias("evidence_file")).distinct().withColumn("changed", F.lit(True)), "evidence_file", "left")
    is_doc, is_changed = F.col("evidence_file").rlike(DOC_PATH), F.coalesce("changed", F.lit(False))
    tier = F.when(F.col("evidence_file").rlike(TEST_PATH), 0).when(F.col("symbol"), 5).when(is_changed, F.when(is_doc, 3).otherwise(4)).otherwise(F.when(is_doc, 1).otherwise(2))
    w = Window.partitionBy("file", "line", "claim").orderBy(F.desc("tier"), F.desc("matched"), "id")
    best = per.withColumn("tier", tier).withColumn("n", F.row_number().over(w)).where("n = 1")
    return best.select("file", "line", "claim", "id", "evidence_file", F.element_at(F.array(*(F.lit(t) for t in TIERS)), F.col("tier") + 1).alias("tier"), "matched")


#: How families of variants begin.
HEADERS = (
    ("enum", re.compile(r"\b(?:export\s+)?(?:declare\s+)?(?:const\s+)?enum\s+([A-Za-z_$][\w$]*)\s*\{")),
    ("const-object", re.compile(r"\b(?:export\s+)?const\s+([A-Za-z_$][\w$]*)(?:\s*:\s*[^=\n]+)?\s*=\s*\{")),
    ("union", re.compile(r"\b(?:export\s+)?type\s+([A-Za-z_$][\w$]*)(?:\s*<[^=\n]*>)?\s*=\s*")),
)
_MEMBER = {"enum": re.compile(r"\s*(?:([A-Za-z_$][\w$]*)|['\"]([^'\"]+)['\"])\s*(?:=|\Z)"), "const-object": re.compile(r"\s*(?:([A-Za-z_$][\w$]*)|['\"]([^'\"]+)['\"])\s*:"), "union": re.compile(r"\s*(?:([A-Za-z_$][\w$]*|-?\d+(?:\.\d+)?)|['\"]([^'\"]+)['\"])\s*\Z")}


def _without_comments(code: str) -> str:
    return re.sub(r"//[^\n]*|/\*.*?(?:\*/|\Z)", lambda m: re.sub(r"[^\n]", " ", m[0]), code, flags=re.S)


def _parts(code: str, masked: str, start: int, end: int, sep: str) -> Iterator[tuple[int, str]]:
    """(place, text) between separators outside brackets; strings don't hold any."""
    depth, at = 0, start
    for i in range(start, end):
        c = masked[i]
        depth += (c in "{([") - (c in "})]")
        if c == sep and not depth:
            yield at, code[at:i]
            at = i + 1
    yield at, code[at:end]


def families(content: str, first_line: int) -> list[tuple]:
    """(kind, type, member, line, first line, last line) of the enums, constant objects and unions that a source declares."""
    bare, masked, out = _without_comments(content), S.masked(content), []
    for kind, header in HEADERS:
        for m in header.finditer(masked):
            start = m.end()
            if kind == "union":
                depth, end = 0, start
                while end < len(masked) and not (masked[end] == ";" and not depth):
                    depth += (masked[end] in "{([") - (masked[end] in "})]")
                    end += 1
                if end == len(masked):
                    continue
            else:
                end = S._closing(masked, start - 1)
                if end < 0:
                    continue
            for at, text in _parts(bare, masked, start, end, "|" if kind == "union" else ","):
                member = _MEMBER[kind].match(text)
                if member:
                    line = first_line + content.count("\n", 0, at + len(text) - len(text.lstrip()))
                    out.append((kind, m[1], member[1] or member[2], line, first_line + content.count("\n", 0, m.start()), first_line + content.count("\n", 0, end)))
    return out


def family_members(chunks: DataFrame) -> DataFrame:
    """file, kind, type, member, line, decl_start, decl_end over TypeScript and JavaScript chunks (file, start_line, content). Brackets
    have to be matched, so batches go through Arrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(file, *f) for file, start, content in zip(*(c.to_pylist() for c in batch.columns), strict=True) for f in families(content or "", start)]
            kinds = [pa.string()] * 4 + [pa.int32()] * 3
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["file", "kind", "type", "member", "line", "decl_start", "decl_end"])

    code = chunks.where(F.col("file").rlike(r"\.[cm]?[jt]sx?\z")).select("file", F.col("start_line").cast("int"), "content")
    return code.repartition(partitions(code)).mapInArrow(run, "file string, kind string, type string, member string, line int, decl_start int, decl_end int").distinct()


def added_variants(members: DataFrame, lines: DataFrame) -> DataFrame:
    """members with `added`: on an added line (file, line, sign, text), not named on any removed line of its file, in a family that was
    there before. Families without both added and older members drop out."""
    plus = lines.where("sign = '+'").select("file", "line").distinct().withColumn("plus", F.lit(True))
    gone = lines.where("sign = '-'").select("file", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9_$]+"), F.lit(0)))).alias("member")).distinct().withColumn("gone", F.lit(True))
    heads = plus.select("file", F.col("line").alias("decl_start"), F.lit(True).alias("new_head"))
    kept_head = gone.select("file", F.col("member").alias("type"), F.lit(True).alias("old_head"))
    rows = members.join(plus.hint("merge"), ["file", "line"], "left").join(gone.hint("merge"), ["file", "member"], "left").join(heads.hint("merge"), ["file", "decl_start"], "left").join(kept_head.hint("merge"), ["file", "type"], "left")
    rows = rows.where("new_head IS NULL OR old_head IS NOT NULL").withColumn("added", F.col("plus").isNotNull() & F.col("gone").isNull())
    span = F.bool_or("added").alias("some"), F.bool_or(~F.col("added")).alias("older")
    groups = rows.groupBy("file", "kind", "type").agg(*span).where("some AND older").select("file", "kind", "type")
    return rows.join(groups.hint("merge"), ["file", "kind", "type"]).select("file", "kind", "type", "member", "decl_start", "decl_end", "added")


def variant_consumers(variants: DataFrame, chunks: DataFrame, least: int = 2, per_variant: int = 5, most: int = 12) -> DataFrame:
    """type, variant, kind, file, consumer, line, handled, place: chunks that tell at least `least` older members of a family apart but
    not the added one; `per_variant` of each, variants with the most of them first, `most` in all.

    A consumer compares with a member, has a case or a key for it: `Type.member` of enums and constant objects, the literal of
    unions. Chunks meet families by a word, the type's name or the member's, before the patterns run line by line."""
    scratch = Scratch(chunks.sparkSession, "variants")
    variants = scratch.table(variants, "variants")
    q = lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))
    qualified = F.concat(F.lit(r"\b"), q(F.col("type")), F.lit(r"(?:\."), q(F.col("member")), F.lit(r"\b|\s*\[\s*['\"]"), q(F.col("member")), F.lit(r"['\"]\s*\])"))
    literal = F.when(F.col("member").rlike(r"^-?\d+(\.\d+)?\z"), F.concat(F.lit(r"\b"), q(F.col("member")), F.lit(r"\b"))).otherwise(F.concat(F.lit("['\"]"), q(F.col("member")), F.lit("['\"]")))
    name = F.when(F.col("kind") == "union", literal).otherwise(qualified)
    key = F.when(F.col("kind") == "union", F.concat(literal, F.lit(r"\s*:|\b"), q(F.col("member")), F.lit(r"\s*:|\binstanceof\s+"), q(F.col("member")), F.lit(r"\b"))).otherwise(F.concat(F.lit(r"\[\s*"), qualified, F.lit(r"\s*\]\s*:")))
    used = F.concat(F.lit(r"\bcase\s+"), name, F.lit(r"\s*:|"), name, F.lit(r"\s*[!=]==?|[!=]==?\s*"), name, F.lit("|"), key)
    # A union is met by its members' own words, the other kinds by the name of the type.
    wanted = variants.withColumn("used", used).withColumn("key", F.when(F.col("kind") == "union", F.regexp_extract("member", r"[A-Za-z0-9_$]+", 0)).otherwise(F.col("type")))
    clean = F.regexp_replace("content", r"//[^\n]*", "")
    lines = chunks.select("id", F.col("file").alias("consumer"), "start_line", "end_line", F.posexplode(F.split(clean, "\n")).alias("at", "text"))
    lines = lines.withColumn("key", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9_$]+"), F.lit(0)))))
    hit = lines.join(wanted.hint("merge"), "key").where(F.regexp_like("text", F.col("used")))
    hit = hit.where(~((F.col("consumer") == F.col("file")) & (F.col("start_line") <= F.col("decl_end")) & (F.col("end_line") >= F.col("decl_start"))))
    first = hit.groupBy("id", "consumer", "start_line", "file", "kind", "type", "member", "added").agg(F.min("at").alias("at"))
    first = scratch.table(first, "first")
    family = ["file", "kind", "type"]
    old = first.where("NOT added").groupBy("id", "consumer", "start_line", *family).agg(F.min("at").alias("at"), F.array_sort(F.collect_set("member")).alias("handled")).where(F.size("handled") >= least)
    fresh = variants.where("added").select(*family, F.col("member").alias("variant")).distinct()
    missing = old.join(fresh.hint("merge"), family).join(first.where("added").select("id", *family, F.col("member").alias("variant")).hint("merge"), ["id", *family, "variant"], "left_anti")
    missing = missing.withColumn("line", F.col("start_line") + F.col("at")).groupBy(*family, "variant", "consumer", "line").agg(F.min_by("handled", "id").alias("handled"))
    of = Window.partitionBy(*family, "variant")
    missing = missing.withColumn("n", F.row_number().over(of.orderBy("consumer", "line"))).where(F.col("n") <= per_variant).withColumn("count", F.count("*").over(of))
    missing = scratch.table(missing, "missing")
    heads = missing.where("n = 1").orderBy(F.desc("count"), "type", "variant", "file").limit(most)
    place = F.row_number().over(Window.orderBy(F.desc("count"), "type", "variant", "file"))  # over `most` rows
    kept = heads.select(*family, "variant", place.alias("place"))
    return missing.join(kept, [*family, "variant"]).select("type", "variant", "kind", "file", "consumer", "line", F.array_join("handled", ",").alias("handled"), "place")


#: How types with fields begin and how a field is written; files whose types nobody here reads; whole-value uses.
FIELD_HEADERS = (
    ("interface", re.compile(r"\b(?:export\s+)?interface\s+([A-Za-z_$][\w$]*)(?:\s*<[^{]*>)?(?:\s+extends\s+[^{]+)?\s*\{")),
    ("type-literal", re.compile(r"\b(?:export\s+)?type\s+([A-Za-z_$][\w$]*)(?:\s*<[^=\n]*>)?\s*=\s*\{")),
    ("class", re.compile(r"\b(?:export\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)(?:\s*<[^{]*>)?(?:\s+extends\s+[^{]+)?(?:\s+implements\s+[^{]+)?\s*\{")),
)
FIELD = re.compile(r"\s*(?:(?:public|private|protected|readonly|static|abstract|override|declare)\s+)*([A-Za-z_$][\w$]*)\??\s*:\s*[^\s]")
UNREAD_PATHS = r"(^|/)(tests?|specs?|__tests__)(/|\z)|\.(test|spec)\.|_test\.\w+\z|_spec\.\w+\z|[A-Z]\w*Test\.\w+\z|(^|/)index\.[cm]?[jt]sx?\z|\.d\.ts\z"
WHOLESALE = r"\bJSON\.stringify\s*\(|\.\.\.\s*[A-Za-z_$]"


def fields(content: str, first_line: int) -> list[tuple]:
    """(kind, type, field, line) of interfaces, type literals and classes; of a class only properties, not parameters or locals."""
    masked, out = S.masked(content), []
    for kind, header in FIELD_HEADERS:
        for m in header.finditer(masked):
            end = S._closing(masked, m.end() - 1)
            depth = 0
            for at, text in _parts(content, masked.replace("\n", ";"), m.end(), max(end, m.end()), ";"):
                found = FIELD.match(masked[at : at + len(text)]) if not depth else None
                if found and end >= 0:
                    out.append((kind, m[1], found[1], first_line + content.count("\n", 0, at + len(text) - len(text.lstrip()))))
    return out


def declared_fields(chunks: DataFrame) -> DataFrame:
    """file, kind, type, field, line over TypeScript and JavaScript chunks (file, start_line, content), one Arrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(file, *f) for file, start, content in zip(*(c.to_pylist() for c in batch.columns), strict=True) for f in fields(content or "", start)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate([pa.string()] * 4 + [pa.int32()])], names=["file", "kind", "type", "field", "line"])

    code = chunks.where(F.col("file").rlike(r"\.[cm]?[jt]sx?\z")).select("file", F.col("start_line").cast("int"), "content")
    return code.repartition(partitions(code)).mapInArrow(run, "file string, kind string, type string, field string, line int").distinct()


def unread_fields(chunks: DataFrame, lines: DataFrame, repository: DataFrame, most: int = 10) -> DataFrame:
    """type, field, kind, file, line, place: fields on added lines that no code reads: nowhere after a dot but to be assigned, as a quoted
    key in brackets, or taken apart. Types of tests, barrels and declaration files don't count, nor do types that some line passes on
    whole (spread or written as JSON) where it names them. The first `most` by file and line.

    Code meets fields by their words, an equi-join on lines, before the patterns run."""
    added = lines.where("sign = '+'").select("file", "line").distinct()
    rows = declared_fields(chunks).where(~F.col("file").rlike(UNREAD_PATHS)).join(added.hint("merge"), ["file", "line"])
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"[A-Za-z0-9_$]+"), F.lit(0)))
    code = repository.select("file", F.explode(F.split(F.regexp_replace("content", r"//[^\n]*", ""), "\n")).alias("text")).select("text", F.explode(words(F.col("text"))).alias("word"))
    q = F.concat(F.lit("\\Q"), F.col("field"), F.lit("\\E"))
    read = F.concat(F.lit(r"\.\s*"), q, F.lit(r"\b(?!\s*=[^=])|\[\s*['\"]"), q, F.lit(r"['\"]\s*\]|\{[^}:=]*\b"), q, F.lit(r"\b[^}]*\}\s*="))
    # The pattern is stored: made from the field, it would be tried on every word before words meet fields.
    rows = Scratch(chunks.sparkSession, "fields").table(rows.withColumn("read", read), "fields")
    seen = code.join(rows.select("field", "read").distinct().hint("merge"), F.col("word") == F.col("field")).where(F.regexp_like("text", F.col("read"))).select("field").distinct()
    whole = code.where(F.col("text").rlike(WHOLESALE)).join(rows.select("type").distinct().hint("merge"), F.col("word") == F.col("type")).select("type").distinct()
    left = rows.join(seen.hint("merge"), "field", "left_anti").join(whole.hint("merge"), "type", "left_anti").orderBy("file", "line", "field").limit(most)
    return left.withColumn("place", F.row_number().over(Window.orderBy("file", "line", "field"))).select("type", "field", "kind", "file", "line", "place")  # over `most` rows
