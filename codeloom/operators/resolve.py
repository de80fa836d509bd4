"""Import specifiers resolved by what a project's manifests say: PSR-4 prefixes, Go modules, crates, source roots, packages.

Manifests are few and small and come as plain values; whether a candidate exists is asked of the table of files by a join."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.functions.languages import language_of

#: Source sets of the JVM in the order in which they are tried, folders without any, index files of JavaScript.
SOURCE_SETS = ("src/main/java", "src/main/kotlin", "src/test/java", "src/test/kotlin")
NO_SOURCES = ("node_modules", "build", "target", ".git", "out")
INDEX_EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "cjs")


@dataclass(frozen=True)
class Manifests:
    """psr4: namespace prefix (with its last backslash) -> folders; go_module; python_src: the folder of a src layout; jvm_roots in
    order; crates: name -> folder; packages: name -> entry file."""

    psr4: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    go_module: str | None = None
    python_src: str | None = None
    jvm_roots: tuple[str, ...] = ()
    crates: Mapping[str, str] = field(default_factory=dict)
    packages: Mapping[str, str] = field(default_factory=dict)


def psr4_map(composer: str) -> dict[str, tuple[str, ...]]:
    """Prefixes of a composer.json, those for development too; a text that isn't JSON has none."""
    try:
        parsed = json.loads(composer)
    except ValueError:
        return {}
    out: dict[str, tuple[str, ...]] = {}
    for section in ("autoload", "autoload-dev"):
        entries = parsed.get(section, {}) if isinstance(parsed, dict) else {}
        entries = entries.get("psr-4", {}) if isinstance(entries, dict) else {}
        for prefix, value in entries.items() if isinstance(entries, dict) else ():
            folders = tuple(re.sub(r"^\./", "", v) for v in (value if isinstance(value, list) else [value]) if isinstance(v, str))
            folders = tuple(v if not v or v.endswith("/") else v + "/" for v in folders)
            key = prefix if prefix.endswith("\\") else prefix + "\\"
            if folders:
                out[key] = out.get(key, ()) + folders
    return out


def go_module(go_mod: str) -> str | None:
    found = re.search(r"^\s*module\s+(\S+)", go_mod, re.M)
    return found[1].strip("\"'") if found else None


def crate_name(cargo: str) -> str | None:
    """The name in [package] as code spells it."""
    found = re.search(r"^\s*\[package\]\s*$(?:\n(?!\s*\[).*)*?\n\s*name\s*=\s*\"([^\"]+)\"", cargo, re.M)
    return found[1].replace("-", "_") if found else None


def jvm_source_roots(files: DataFrame) -> list[str]:
    """Folders that are source sets, by set, then by name: as many as a project has modules."""
    tests = "|".join(re.escape(s) for s in SOURCE_SETS)
    root = F.regexp_extract("file", rf"^((?:.*/)?(?:{tests}))/", 1)
    bare = ~F.col("file").rlike(rf"(^|/)({'|'.join(re.escape(x) for x in NO_SOURCES)})/")
    found = [r[0] for r in files.where(bare).select(root.alias("r")).where("r <> ''").distinct().collect()]
    return sorted(found, key=lambda r: (next(i for i, s in enumerate(SOURCE_SETS) if r == s or r.endswith("/" + s)), r))


def python_src_root(files: DataFrame) -> str | None:
    """src, if a package stands right below it."""
    return "src" if files.where(F.col("file").rlike(r"^src/[^/]+/__init__\.py\z")).take(1) else None


def _candidates(specifier: Column, language: Column, m: Manifests) -> Column:
    """Array of (path, files that prove it): tried in order; an empty proof needs none."""
    none = F.array().cast("array<struct<path:string,proof:array<string>>>")
    proofs = lambda path, ends: F.array(*(F.concat(path, F.lit(e)) for e in ends))
    one = lambda path, ends=(): F.struct(path.alias("path"), (proofs(path, ends) if ends else F.array().cast("array<string>")).alias("proof"))
    php = none
    for prefix in sorted(m.psr4, key=len):  # the longest is tested last and wins
        rest = F.translate(F.substring(specifier, len(prefix) + 1, 1 << 20), "\\", "/")
        folders = m.psr4[prefix]
        found = [one(F.concat(F.lit(f), rest), (".php",) if len(folders) > 1 else ()) for f in folders]
        php = F.when(specifier.startswith(prefix), F.array(*found, *([one(F.concat(F.lit(folders[0]), rest))] if len(folders) > 1 else []))).otherwise(php)
    slashed = F.translate(specifier, ".", "/")
    go = F.when(specifier.startswith(m.go_module + "/"), F.array(one(F.substring(specifier, len(m.go_module) + 2, 1 << 20)))).otherwise(none) if m.go_module else none
    python = F.when(~specifier.contains("/") & ~specifier.startswith("."), F.array(one(F.concat(F.lit(f"{m.python_src}/"), slashed), (".py", "/__init__.py")))).otherwise(none) if m.python_src else none
    dotted = specifier.rlike(r"^[\p{L}_$][\p{L}\p{N}_$]*(\.[\p{L}_$][\p{L}\p{N}_$]*)*\z")
    jvm = F.when(dotted, F.array(*(one(F.concat(F.lit(f"{r}/"), slashed), (".java", ".kt")) for r in m.jvm_roots))).otherwise(none) if m.jvm_roots else none
    rust = none
    for name, folder in sorted(m.crates.items()):
        rest = F.replace(F.substring(specifier, len(name) + 3, 1 << 20), F.lit("::"), F.lit("/"))
        rust = F.when(specifier.startswith(f"{name}::"), F.array(one(F.concat(F.lit(f"{folder}/"), rest)))).otherwise(rust)
    scripts = F.array(*(F.struct(F.concat(specifier, F.lit("/index")).alias("path"), F.array(F.concat(specifier, F.lit(f"/index.{e}"))).alias("proof")) for e in INDEX_EXTENSIONS))
    out = F.when(language == "php", php).when(language == "go", go).when(language == "python", python).when(language.isin("java", "kotlin"), jvm).when(language == "rust", rust)
    return out.when(language.isin("javascript", "typescript"), scripts).otherwise(none)


def resolve(specifiers: DataFrame, files: DataFrame, manifests: Manifests) -> DataFrame:
    """specifiers (importer, specifier) with `resolved`: relative ones against the importer, workspace packages by name, then
    what the manifests of the importer's language say, where files (file) prove it; else the specifier as it is."""
    s = specifiers.select("importer", "specifier").distinct().withColumn("language", language_of(F.col("importer")))
    step = paths.resolve_workspace(paths.resolve_relative(F.col("importer"), F.col("specifier")), manifests.packages)
    s = s.withColumn("step", step).withColumn("tried", _candidates(F.col("step"), F.col("language"), manifests))
    names = s.select("step", "language", "tried").distinct()
    rows = names.select("step", "language", F.posexplode("tried").alias("k", "c")).select("step", "language", "k", "c.path", F.explode_outer("c.proof").alias("file"))
    known = files.select("file").distinct().withColumn("there", F.lit(True))
    good = rows.join(known, "file", "left").where(F.col("file").isNull() | F.col("there"))
    best = good.groupBy(F.col("step").alias("of"), F.col("language").alias("by")).agg(F.min_by("path", "k").alias("path"))
    out = s.drop("tried").join(best, (F.col("step") == F.col("of")) & F.col("language").eqNullSafe(F.col("by")), "left")
    return out.select("importer", "specifier", F.coalesce("path", "step").alias("resolved"))
