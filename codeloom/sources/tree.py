"""Trees of files: globs and ignore rules as Column predicates, ecosystem presets, a scan, reading from storage."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.tables import Scratch, partitions

#: What a scan takes when nothing is asked for.
INCLUDE = ("**/*.{ts,tsx,js,jsx,py,php,go,rs,java,cpp,c,cs,h,md,mdx,yml,yaml}", ".github/**/*.{yml,yaml}")


def anywhere(*patterns: str) -> tuple[str, ...]:
    """Each pattern at the root and below any folder."""
    return tuple(x for p in patterns for x in (p, f"**/{p}"))


#: Never part of a scan; only of one that starts in a home directory; not even where version control has them.
ALWAYS_IGNORE = (*anywhere("node_modules/**", "vendor/**", ".git/**"), ".codeloom/**", *anywhere(".claude/worktrees/**", "dist/**", "build/**", "*.min.js", "*.min.css", "pnpm-lock.yaml"))
HOME_IGNORE = ("Library/**", "AppData/**", ".npm/**", ".cache/**", ".claude/**", ".ssh/**", ".aws/**", ".gnupg/**", "/*.keychain-db", "/*.keychain")
NEVER_INDEX = anywhere(".git/**", ".codeloom/**", "node_modules/**", ".claude/worktrees/**")

#: Ecosystem -> marker files at the root, patterns that its presence excludes.
PRESETS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "nodejs": (("package.json",), anywhere(".next/**", ".nuxt/**", ".vite/**", ".turbo/**", ".vercel/**", ".netlify/**", "coverage/**", "playwright-report/**", "test-results/**", "__generated__/**", ".cache/**", "out/**", "public/build/**", "*.bundle.js")),
    "python": (("requirements.txt", "setup.py", "pyproject.toml", "Pipfile"), (*anywhere("venv/**", ".venv/**", "__pycache__/**", "*.pyc", "*.pyo", "*.pyd", "*.egg-info/**", ".tox/**", ".pytest_cache/**"), ".coverage", *anywhere("htmlcov/**", ".mypy_cache/**"), "docs/_build/**", *anywhere("migrations/**"))),
    "php": (("composer.json",), anywhere("storage/**", "cache/**", "bootstrap/cache/**", ".phpunit.cache/**", "public/build/**")),
    "laravel": (("artisan",), ("database/migrations/**", "database/seeders/**", "database/factories/**", "public/**/*.js", "public/**/*.css", "public/hot", "public/build/**")),
    "ruby": (("Gemfile",), anywhere("tmp/**", ".bundle/**", "log/**", "coverage/**", "public/assets/**", "public/packs/**")),
    "rails": (("bin/rails",), anywhere("db/migrate/**", "db/seeds/**", "storage/**", "tmp/**", "log/**", "public/assets/**", "public/packs/**")),
    "rust": (("Cargo.toml",), anywhere("target/**")),
    "jvm": (("pom.xml", "build.gradle", "build.gradle.kts"), anywhere(".gradle/**", "target/**", "out/**", ".idea/**", "*.class")),
    "swift": (("Package.swift", "*.xcodeproj", "*.xcworkspace"), anywhere(".build/**", "DerivedData/**", "*.xcodeproj/**", "Pods/**")),
    "dotnet": (("*.csproj", "*.sln"), anywhere("bin/**", "obj/**", "packages/**", ".vs/**")),
    "django": (("manage.py",), anywhere("staticfiles/**", "media/**", "*.sqlite3")),
    "astro": (("astro.config.*",), (".astro/**",)),
}


def glob_regex(pattern: str, hidden: bool = False) -> str:
    """A pattern over a whole relative path: * and ? within a segment, ** over any number of them, {a,b}, [x].

    Without `hidden` no wildcard matches a segment that begins with a dot."""
    dot = "" if hidden else r"(?!\.)"
    out, i, braces, start = "", 0, 0, True
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and start:
            out, i = out + rf"(?:{dot}[^/]+/)*", i + 3
            continue
        if pattern[i:] == "**" and start:
            return out + rf"{dot}[^/]+(?:/{dot}[^/]+)*"
        if c == "*":
            while pattern.startswith("*", i):
                i += 1
            out += (dot if start else "") + ("[^/]+" if start and pattern[i : i + 1] in ("", "/") else "[^/]*")
            start = False
            continue
        if c == "?":
            out += (dot if start else "") + "[^/]"
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            inner = pattern[i + 1 : end].replace("\\", "\\\\")
            out, i = out + f"[{'^' + inner[1:] if inner[0] in '!^' else inner}]", end
        elif c == "{":
            out, braces = out + "(?:", braces + 1
        elif c == "}" and braces:
            out, braces = out + ")", braces - 1
        elif c == "," and braces:
            out += "|"
        else:
            out += re.escape(c)
        start = c in "/{," if c != "," or braces else False
        i += 1
    return out


def matches_glob(file: Column, patterns: Iterable[str], hidden: bool = False) -> Column:
    """Does the relative path match one of the patterns as a whole?"""
    tests = "|".join(f"(?:{glob_regex(p, hidden)})" for p in patterns)
    return file.rlike(rf"^(?:{tests})\z") if tests else F.lit(False)


def ignore_rules(lines: Iterable[str]) -> list[tuple[str, bool, bool]]:
    """(regex over a path, folders only, negated) of ignore-file lines: # comments, ! takes back, / at the end means folders, a
    slash elsewhere ties the pattern to the root."""
    out = []
    for line in lines:
        text = re.sub(r"(?<!\\)\s+$", "", line)
        if not text or text.startswith("#"):
            continue
        negated = text.startswith("!")
        text = text[1:] if negated else text.removeprefix("\\") if text[:2] in ("\\#", "\\!") else text
        folder, text = text.endswith("/"), text.rstrip("/")
        tied, text = "/" in text, text.lstrip("/")
        if text:
            out.append((rf"^{'' if tied else '(?:.*/)?'}{glob_regex(text, hidden=True)}\z", folder, negated))
    return out


def ignored(file: Column, lines: Iterable[str]) -> Column:
    """Is a relative path ignored? The last line that matches a path decides about it, and nothing below an ignored folder comes
    back."""
    rules = ignore_rules(lines)
    if not rules:
        return F.lit(False)
    parts = F.split(F.translate(file, "\\", "/"), "/")

    def decide(n: Column) -> Column:
        path, below = F.array_join(F.slice(parts, 1, n), "/"), n < F.size(parts)
        state = F.lit(False)
        for regex, folder, negated in rules:
            hit = path.rlike(regex) & (below if folder else F.lit(True))
            state = F.when(hit, F.lit(not negated)).otherwise(state)
        return state

    return F.exists(F.sequence(F.lit(1), F.size(parts)), decide)


def always_ignored(home: bool = False) -> tuple[str, ...]:
    return ALWAYS_IGNORE + (HOME_IGNORE if home else ())


def detect_ecosystems(files: DataFrame, presets: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = PRESETS) -> DataFrame:
    """ecosystem, exclude: the patterns of every preset of which a marker stands at the root of files (file). Markers are
    compared in the scan; only names of presets are gathered, as many as there are presets."""
    found = F.array_compact(F.array(*(F.when(matches_glob(F.col("file"), markers), F.lit(name)) for name, (markers, _) in presets.items())))
    names = files.select(F.explode(found).alias("ecosystem")).distinct()
    table = F.create_map(*(x for name, (_, patterns) in presets.items() for x in (F.lit(name), F.array(*(F.lit(p) for p in patterns)))))
    return names.select("ecosystem", F.explode(F.element_at(table, F.col("ecosystem"))).alias("exclude"))


def scan(files: DataFrame, include: Iterable[str] = (), exclude: Iterable[str] = (), gitignore: Iterable[str] = (), tracked: DataFrame | None = None, home: bool = False) -> DataFrame:
    """The files (file: path relative to the root) that an index takes: those of an included kind that neither the ignore file,
    the patterns that always hold nor `exclude` rule out, and of the tracked files those that ignore rules hid but that are
    of an included kind and may be indexed at all."""
    include, exclude, always = tuple(include) or INCLUDE, tuple(exclude), always_ignored(home)
    file, scratch = F.col("file"), Scratch(files.sparkSession, "scan")
    # Names are dealt to all tasks as a table: a filter would go below an exchange, into the one split that a small table is.
    dealt = lambda df, name: scratch.table(df.select("file").repartition(partitions(df), "file").distinct(), name)
    kept = dealt(files, "files").where(matches_glob(file, include) & ~matches_glob(file, always + exclude, hidden=True) & ~ignored(file, [*gitignore, *always, *exclude]))
    if tracked is None:
        return kept
    may = matches_glob(file, include) & ~ignored(file, NEVER_INDEX + (HOME_IGNORE if home else ()))
    return kept.unionByName(dealt(tracked, "tracked").where(may).join(kept.hint("merge"), "file", "left_anti"))


def read_tree(spark: SparkSession, root: str, names: str = "*", most_bytes: int = 5 << 20) -> DataFrame:
    """file, content, size, mtime, oversize of the files below a folder of any file system that Spark reads. The glob `names`
    reaches the listing; a file above most_bytes keeps its row, without content."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(root)
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = top.getFileSystem(spark._jsc.hadoopConfiguration()).resolvePath(top).toUri().getPath().rstrip("/") + "/"
    file = F.regexp_replace("path", r"^[a-z]+:/*(?=/)", "")
    file = F.substring(file, F.instr(file, F.lit(base)) + len(base), 1 << 20)
    large = F.col("length") > most_bytes
    return raw.select(file.alias("file"), F.when(~large, F.decode("content", "UTF-8")).alias("content"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), large.alias("oversize"))
