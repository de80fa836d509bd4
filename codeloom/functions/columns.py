"""Scalar functions as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounds halves toward plus infinity, unlike round()."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def symbol_tokens(name: Column) -> Column:
    """Words of an identifier in lower case: parseHTTPServer2Go_x -> parse http server 2 go x.

    One extraction: a run of capitals before a capitalized word, a word with or without a capital, capitals, digits."""
    words = F.regexp_extract_all(name, F.lit(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"), F.lit(0))
    return F.lower(F.array_join(words, " "))


#: Above so many bytes a hash covers the first and last bytes of a file and its size.
LARGE, EDGE = 1 << 20, 8192


def content_hash(content: Column) -> Column:
    """First 16 hex digits of sha256 over the UTF-8 bytes; above 1 MiB `L` and 15 digits over head, tail and size in bytes."""
    raw = content.cast("binary")
    size = F.octet_length(content)
    edges = F.concat(F.substring(raw, 1, EDGE), F.substring(raw, -EDGE, EDGE), size.cast("string").cast("binary"))
    return F.when(size > LARGE, F.concat(F.lit("L"), F.substring(F.sha2(edges, 256), 1, 15))).otherwise(F.substring(F.sha2(raw, 256), 1, 16))


#: Naming styles in the order in which they are tried; constants and single letters have none.
CONSTANT = r"^[A-Z][A-Z0-9_]+\z"
STYLES = (("PascalCase", r"^[A-Z][a-zA-Z0-9]*\z"), ("snake_case", r"^[a-z][a-z0-9]*(_[a-z0-9]+)+\z"), ("camelCase", r"^[a-z][a-zA-Z0-9]*\z"))


def identifier_style(name: Column) -> Column:
    """The style of a name, null for constants, single letters and anything else."""
    out = F.when((F.length(name) < 2) | name.rlike(CONSTANT), F.lit(None).cast("string"))
    for style, pattern in STYLES:
        out = out.when(name.rlike(pattern), style)
    return out


def code_shaped(name: Column) -> Column:
    """Case changes within the name or an underscore inside: no ordinary word looks so."""
    return name.rlike(r"[a-z][A-Z]|[A-Z][a-z]|\w_\w")


def several_words(name: Column) -> Column:
    """A name of several words: a small letter or digit before a capital, capitals before a capitalized word, or an underscore
    inside."""
    return name.rlike(r"[a-z0-9][A-Z]|[A-Z]{2}[a-z]|[A-Za-z0-9]_+[A-Za-z0-9]")


def type_shaped(name: Column) -> Column:
    """Several words, the first of which is capitalized, perhaps after underscores."""
    return several_words(name) & name.rlike(r"^_*[A-Z]")


def clamped(text: Column, most: int = 200) -> Column:
    """White space in runs as one blank, none at the ends, and `...` at the end of what is longer than `most` characters."""
    s = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most - 3), F.lit("..."))).otherwise(s)


def normal_signature(text: Column) -> Column:
    """A signature for comparison: blanks in runs are one, those around brackets and commas none, and so is a last comma."""
    s = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r" *([(),]) *", "$1")
    return F.trim(F.replace(s, F.lit(",)"), F.lit(")")))


def snippet(content: Column, first_line: Column, line: Column, symbol: Column, radius: int = 5) -> Column:
    """The line of a call, trimmed: the one that names the symbol at or nearest to where it should be, the line before first;
    if that is blank the nearest that isn't; else `symbol(...)`."""
    lines = F.split(content, "\n")
    guess = line - first_line + 1  # as a place in the array
    there = lambda i: (i >= 1) & (i <= F.size(lines))
    text = lambda i: F.coalesce(F.get(lines, i - 1), F.lit(""))
    near = F.concat(F.array(guess), F.flatten(F.transform(F.sequence(F.lit(1), F.lit(radius)), lambda d: F.array(guess - d, guess + d))))
    named = F.get(F.filter(near, lambda i: there(i) & text(i).contains(symbol)), F.lit(0))
    at = F.coalesce(named, F.when(there(guess), guess))
    around = F.concat(F.array(at), F.transform(F.sequence(F.lit(1), F.lit(radius)), lambda d: at - d), F.transform(F.sequence(F.lit(1), F.lit(radius)), lambda d: at + d))
    said = F.get(F.filter(F.transform(around, lambda i: F.when(there(i), F.trim(text(i))).otherwise("")), lambda t: t != ""), F.lit(0))
    return F.coalesce(said, F.concat(symbol, F.lit("(...)")))


def whole_word(text: Column, token: Column) -> Column:
    """token stands in text with no letter, digit or underscore beside it; token is a plain identifier column."""
    return F.regexp_like(text, F.concat(F.lit(r"(^|[^A-Za-z0-9_])"), token, F.lit(r"([^A-Za-z0-9_]|\z)")))


def minutes(m: Column) -> Column:
    """65 -> 1h 5m, 60 -> 1h, 5 -> 5m."""
    whole = F.floor(m + 0.5).cast("long")
    h, rest = F.floor(whole / 60).cast("long"), whole % 60
    return F.when(whole < 60, F.concat(whole.cast("string"), F.lit("m"))).when(rest == 0, F.concat(h.cast("string"), F.lit("h"))).otherwise(F.concat(h.cast("string"), F.lit("h "), rest.cast("string"), F.lit("m")))


RISK = ("low", "medium", "high", "critical")


def risk_rank(level: Column) -> Column:
    return F.array_position(F.array(*(F.lit(x) for x in RISK)), level).cast("int")


def risk_name(rank: Column) -> Column:
    return F.element_at(F.array(*(F.lit(x) for x in RISK)), rank.cast("int"))


#: Most dependents of each level; means and maxima of complexity above which a level begins; dependents above
#: which a blast radius has a level.
COUNT_LIMITS = ((5, "low"), (15, "medium"), (30, "high"))
COMPLEXITY_LIMITS = ((15, 25, "critical"), (10, 20, "high"), (6, 15, "medium"))
BLAST_LIMITS = {"critical": 50, "high": 20, "medium": 5}


def count_risk(n: Column) -> Column:
    out = F.when(F.lit(False), "")
    for most, level in COUNT_LIMITS:
        out = out.when(n <= most, level)
    return out.otherwise(RISK[-1])


def complexity_risk(mean: Column, most: Column) -> Column:
    out = F.when(F.lit(False), "")
    for over_mean, over_most, level in COMPLEXITY_LIMITS:
        out = out.when((mean > over_mean) | (most > over_most), level)
    return out.otherwise(RISK[0])


def _blast_level(dependents: Column, uncovered: Column, complex_uncovered: Column) -> Column:
    """1 to 4, by how many dependents there are, whether some lack tests, and whether such a one is complex."""
    by_count = F.when(dependents > BLAST_LIMITS["critical"], 4).when(dependents > BLAST_LIMITS["high"], 3).when(dependents > BLAST_LIMITS["medium"], 2).otherwise(1)
    by_tests = F.when(complex_uncovered & (dependents > BLAST_LIMITS["high"]), 4).when(complex_uncovered, 3).when(uncovered > 0, 2).otherwise(1)
    return F.greatest(by_count, by_tests)


def blast_risk(dependents: Column, uncovered: Column, complex_uncovered: Column, boost: Column | None = None) -> Column:
    """Another scale than count_risk: 5, 20 and 50 dependents, raised by dependents without tests, and never below the level
    before that of their complexity (`boost`, null for none)."""
    level = _blast_level(dependents, uncovered, complex_uncovered)
    floor = F.lit(1) if boost is None else F.coalesce(F.greatest(F.lit(1), risk_rank(boost) - 1), F.lit(1))
    return risk_name(F.greatest(level, floor))


def blast_reasons(dependents: Column, uncovered: Column, complex_uncovered: Column, most_complex: Column, boost: Column) -> Column:
    """Phrases that say why, in the order in which they count: callers, untested ones, the largest complexity, what raised it."""
    floor = F.coalesce(F.greatest(F.lit(1), risk_rank(boost) - 1), F.lit(1))
    raised = floor > _blast_level(dependents, uncovered, complex_uncovered)
    phrases = [
        F.when(dependents > 0, F.concat(dependents.cast("string"), F.when(dependents == 1, " caller").otherwise(" callers"))),
        F.when(uncovered > 0, F.concat(uncovered.cast("string"), F.lit(" untested"))),
        F.when(most_complex > 0, F.concat(F.lit("max complexity "), most_complex.cast("string"))),
        F.when(complex_uncovered, F.lit("untested high-complexity dependent")),
        F.when(raised, F.concat(boost, F.lit("-complexity dependent regardless of test coverage"))),
    ]
    return F.filter(F.array(*phrases), lambda x: x.isNotNull())


def is_test_file(file: Column) -> Column:
    """By name: .test. and .spec. or _test. and _spec. before an extension, a folder for tests in any case; in Swift and C#
    names that end in Test or Tests, and their folders. Either slash separates."""
    swift = file.rlike(r"Tests?\.swift\z") | file.rlike(r"(^|[/\\])Tests?[/\\]")
    csharp = file.rlike(r"Tests?\.cs\z") | file.rlike(r"(^|[/\\])[^/\\]*Tests[/\\]")
    return (
        file.rlike(r"[._](test|spec)\.[^/]+\z")
        | file.rlike(r"(?i)(^|[/\\])(tests?|specs?|__tests__)[/\\]")
        | (file.endswith(".swift") & swift)
        | (file.endswith(".cs") & csharp)
    )


def halstead(n1: Column, n2: Column, big1: Column, big2: Column) -> list[Column]:
    """volume, difficulty, effort, minutes, bugs from distinct and total operators (1) and operands (2)."""
    n = n1 + n2
    volume = F.when(n > 0, (big1 + big2) * F.log2(n.cast("double"))).otherwise(F.lit(0.0))
    difficulty = F.when(n2 > 0, n1 / 2 * (big2 / n2)).otherwise(F.lit(0.0))
    effort = volume * difficulty
    return [half_up(volume, 2).alias("volume"), half_up(difficulty, 2).alias("difficulty"), half_up(effort).alias("effort"), half_up(effort / 18 / 60, 2).alias("minutes"), half_up(F.pow(effort, F.lit(2.0 / 3)) / 3000, 3).alias("bugs")]
