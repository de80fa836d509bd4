"""Chunk store: scans, pages, filters, replacement, overlay views, snapshot differences."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.columns import content_hash


def valid(chunks: DataFrame) -> DataFrame:
    """Rows that a reader accepts: a file and some content."""
    return chunks.where((F.col("file") != "") & F.col("content").rlike(r"\S"))


def by_files(chunks: DataFrame, files: list[str]) -> DataFrame:
    """Point scan; an empty list is an error, not everything."""
    if not files or any(not f for f in files):
        raise ValueError("files: at least one path, none empty")
    return valid(chunks).where(F.col("file").isin(files))


def page(chunks: DataFrame, number: int, size: int = 1000) -> DataFrame:
    """The number-th page (from 0) in id order."""
    return valid(chunks).orderBy("id").offset(number * size).limit(size)


#: Longest pattern, most repetitions in one.
MOST_PATTERN, MOST_REPEATS = 256, 25


def _alternatives(pattern: str) -> list[list]:
    """Branches of a pattern; each is a list of (text, branches of a group or None, repeated)."""
    at = 0

    def branches(inside: bool) -> list[list]:
        nonlocal at
        out: list[list] = [[]]
        while at < len(pattern) and not (inside and pattern[at] == ")"):
            start, inner = at, None
            c = pattern[at]
            if c == "|":
                out.append([])
                at += 1
                continue
            if c == "(":
                at = re.compile(r"\((\?(:|=|!|<=|<!|P?<\w+>))?").match(pattern, at).end()
                inner = branches(True)
                at += 1
            elif c == "[":
                at = pattern.find("]", at + 2 + pattern.startswith("[^", at)) + 1 or len(pattern)
            else:
                at += 2 if c == "\\" else 1
            repeat = re.compile(r"(?:[*+?]|\{\d*,?\d*\})\??").match(pattern, at)
            text = pattern[start:at].lower()
            at = repeat.end() if repeat else at
            out[-1].append((text + (repeat[0] if repeat else ""), inner, bool(repeat)))
        return out

    return branches(False)


def safe_pattern(pattern: str) -> str | None:
    """A case-insensitive pattern, or None where it is too long, does not compile, or could take super-linear time: a repetition
    within another, too many of them, or equal alternatives within one."""
    if len(pattern) > MOST_PATTERN:
        return None
    try:
        re.compile(pattern)
    except re.error:
        return None
    repeats = 0

    def bad(branches: list[list], height: int) -> bool:
        nonlocal repeats
        texts = ["".join(item[0] for item in b) for b in branches]
        if height and len(set(texts)) < len(texts):
            return True
        for branch in branches:
            for _, inner, repeated in branch:
                repeats += repeated
                if height + repeated > 1 or (inner is not None and bad(inner, height + repeated)):
                    return True
        return False

    return None if bad(_alternatives(pattern), 0) or repeats > MOST_REPEATS else f"(?i){pattern}"


def by_pattern(chunks: DataFrame, pattern: str) -> DataFrame:
    """Pattern on content or file. An unsafe pattern filters nothing, by design."""
    p = safe_pattern(pattern)
    return chunks if p is None else chunks.where(F.col("content").rlike(p) | F.col("file").rlike(p))


def by_language(chunks: DataFrame, language: str) -> DataFrame:
    return chunks.where(F.lower("language") == language.lower())


def by_symbol_type(chunks: DataFrame, kind: str) -> DataFrame:
    return chunks.where(F.col("symbol_type").isin(["function", "method"] if kind == "function" else [kind]))


def by_symbol(chunks: DataFrame, language: str | None = None, pattern: str | None = None, kind: str | None = None) -> DataFrame:
    """Listing of symbols: chunks of code with a symbol, optionally of a language, a name pattern and a kind."""
    out = chunks.where(~F.coalesce(F.col("symbol_type"), F.lit("")).isin("doc", "config") & (F.coalesce(F.col("symbol_name"), F.lit("")) != ""))
    out = by_language(out, language) if language else out
    p = safe_pattern(pattern) if pattern else None
    out = out.where(F.col("symbol_name").rlike(p)) if p else out
    return by_symbol_type(out, kind) if kind else out


def path_hint(rows: DataFrame, hint: str) -> DataFrame:
    return rows.where(F.lower("file").contains(hint.lower()))


def matches_any(file: Column, targets: list[str]) -> Column:
    out = F.lit(False)
    for t in targets:
        out = out | (file == t) | file.endswith("/" + t)
    return out


def without_self(hits: DataFrame, code: str) -> DataFrame:
    return hits.where(~((F.col("score") < 0.1) & (F.trim("content") == code.strip())))


def distinct_ranges(chunks: DataFrame, *order: Column | str) -> DataFrame:
    """One row per (file, start_line, end_line): the first in the given order."""
    w = Window.partitionBy("file", "start_line", "end_line").orderBy(*order)
    return chunks.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def list_page(rows: DataFrame, order: list[str], limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of limit rows with has_more and next_offset on each, from limit + 1 rows fetched."""
    fetched = rows.orderBy(*order).offset(offset).limit(limit + 1)
    w = Window.orderBy(*order)  # at most limit + 1 rows
    out = fetched.withColumn("rank", F.row_number().over(w)).withColumn("has_more", F.count("*").over(Window.partitionBy()) > limit)
    out = out.where(F.col("rank") <= limit)
    return out.withColumn("next_offset", F.when(F.col("has_more"), F.lit(offset + limit)))


def shaped(chunks: DataFrame, keep: list[str]) -> DataFrame:
    """Allow-listed columns, empty strings as null, and enclosing_symbol = parent.symbol where there is a parent."""
    out = [F.when(F.col(c) != "", F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in chunks.dtypes if c in keep]
    if {"parent_class", "symbol_name"} <= set(chunks.columns):
        out.append(F.when(F.col("parent_class") != "", F.concat_ws(".", "parent_class", "symbol_name")).alias("enclosing_symbol"))
    return chunks.select(*out)


def unindexed(requested: DataFrame, manifest: DataFrame) -> DataFrame:
    return requested.join(manifest, "file", "left_anti")


def honest_counts(files: DataFrame, counts: DataFrame, computed: bool, blind: Column) -> DataFrame:
    """dependents: null where counts were never computed, and where a zero means nothing for the language."""
    n = F.coalesce(F.col("dependents"), F.lit(0))
    joined = files.join(counts, "file", "left")
    return joined.withColumn("dependents", F.when(F.lit(computed) & ~((n == 0) & blind), n))


def replace_files(old: DataFrame, new: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """old without the files of new (and deleted), plus new."""
    gone = new.select("file").distinct()
    gone = gone if deleted is None else gone.unionByName(deleted.select("file")).distinct()
    return old.join(gone, "file", "left_anti").unionByName(new)


def overlay_view(base: DataFrame, overlay: DataFrame, mask: DataFrame) -> DataFrame:
    """What a worktree sees: its own rows, and the base's where not masked."""
    return overlay.unionByName(base.join(mask, "file", "left_anti"))


def manifest(files: DataFrame) -> DataFrame:
    return files.select("file", content_hash(F.col("content")).alias("content_hash"), F.length("content").alias("size"))


def snapshot_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """file, change (added, deleted, modified, touched, unchanged) by hash; touched: another time, the same hash."""
    a, b = before.select("file", F.col("content_hash").alias("h0"), F.col("mtime").alias("t0")), after.select("file", F.col("content_hash").alias("h1"), F.col("mtime").alias("t1"))
    change = F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "deleted").when(F.col("h0") != F.col("h1"), "modified").when(F.col("t0") != F.col("t1"), "touched").otherwise("unchanged")
    return a.join(b, "file", "full_outer").select("file", change.alias("change"))


def categorize(changed: DataFrame, current: DataFrame, known: DataFrame) -> DataFrame:
    """file, change from what version control says has changed: files that are there and known are modified; those that are there and
    not known are added, said to have changed or not; known ones that are no longer there are deleted."""
    marks = [(changed, "said"), (current, "there"), (known, "known")]
    rows = None
    for df, mark in marks:
        one = df.select("file", *(F.lit(m == mark).alias(m) for _, m in marks))
        rows = one if rows is None else rows.unionByName(one)
    f = rows.groupBy("file").agg(*(F.bool_or(m).alias(m) for _, m in marks))
    change = F.when(F.col("there") & F.col("known") & F.col("said"), "modified").when(F.col("there") & ~F.col("known"), "added").when(F.col("known") & ~F.col("there"), "deleted")
    return f.select("file", change.alias("change")).where("change IS NOT NULL")


def signature(manifest_rows: DataFrame) -> DataFrame:
    """One digest of all (file, content_hash), whatever their order: sha256 of each, its 256 bits summed up as four numbers and
    with the count hashed again. Sums are made in parts, so no group of rows is ever gathered."""
    line = F.concat("file", F.lit(":"), "content_hash")
    h = manifest_rows.select(F.sha2(line, 256).alias("h"))
    parts = [F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(4)]
    sums = h.agg(F.count("*").alias("n"), *parts)
    return sums.select(F.sha2(F.concat_ws(":", F.col("n").cast("string"), *(F.coalesce(F.col(f"p{i}"), F.lit(0)).cast("string") for i in range(4))), 256).alias("signature"))


#: Bytes above which a file is recorded but not parsed, days without access after which an index is stale.
OVERSIZE, STALE_DAYS = 5 << 20, 60


def indexable(files: DataFrame, most: int = OVERSIZE) -> DataFrame:
    """files (file, content) with size in bytes, skipped, and n_chunks: 0 for what is too large to parse, else null until counted."""
    size = F.octet_length(F.coalesce("content", F.lit("")))
    return files.withColumn("size", size.cast("long")).withColumn("skipped", F.col("size") > most).withColumn("n_chunks", F.when(F.col("skipped"), 0))


def plan_gc(inventory: DataFrame, now: Column, stale_days: int | None = STALE_DAYS) -> DataFrame:
    """inventory (idx, source_root, root_state: there, gone or offline, in_use, protected, last_access) with action and reason, the
    first that holds: protected ones, those on a volume that is off and those in use stay; those whose root is gone go as orphans;
    those not accessed for more than `stale_days` whole days go where that is asked for; without a root nothing is known."""
    age = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_access").cast("timestamp"))) / F.lit(86_400_000_000))
    stale = F.coalesce(age > stale_days, F.lit(False)) if stale_days is not None else F.lit(False)
    reason = (
        F.when(F.col("protected"), "current-project").when(F.col("root_state") == "offline", "volume-offline").when(F.col("in_use"), "in-use")
        .when(F.col("root_state") == "gone", "orphan").when(stale, "stale").when(F.col("source_root").isNull(), "unknown-provenance").otherwise("present")
    )
    return inventory.withColumn("age_days", age).withColumn("reason", reason).withColumn("action", F.when(F.col("reason").isin("orphan", "stale"), "remove").otherwise("keep"))


def delete_files(chunks: DataFrame, files: DataFrame) -> DataFrame:
    return chunks.join(files.select("file").distinct(), "file", "left_anti")


def has_data(chunks: DataFrame) -> bool:
    """Is there any chunk with content? Looks no further than the first."""
    return bool(chunks.where("content <> ''").take(1))


def newer(version: int, seen: int, now_ms: int, last_check_ms: int, every_ms: int = 1000) -> tuple[bool, int]:
    """(does a reader have to open the store anew, time of the check): versions are compared at most once in `every_ms`."""
    return (version > seen, now_ms) if now_ms - last_check_ms >= every_ms else (False, last_check_ms)


def keep_last(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The n last rows of a ledger."""
    return rows.orderBy(*order).limit(n)
