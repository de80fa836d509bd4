"""Path predicates as Column builders: does an import specifier of one file mean another file?"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions.languages import EXTENSIONS, has

#: Marks a specifier that names one file or the `mod` file of one folder, and nothing else.
RUST_MOD = "mod:"
_ALL = 1 << 20


def _without_root(path: Column, root: str) -> Column:
    top = root.rstrip("/") + "/"
    return F.when(path.startswith(top), F.substring(path, len(top) + 1, _ALL)).otherwise(path) if root else path


def normalize(path: Column, root: str = "") -> Column:
    """The Rust mark and quotes off, spaces around off, slashes forward, the extension of a parsed language and the root off."""
    p = F.when(path.startswith(RUST_MOD), F.substring(path, len(RUST_MOD) + 1, _ALL)).otherwise(path)
    p = F.translate(F.regexp_replace(F.translate(p, "\"'", ""), r"^\s+|\s+\z", ""), "\\", "/")
    return _without_root(F.regexp_replace(p, rf"\.({'|'.join(EXTENSIONS)})\z", ""), root)


def canonical(path: Column, root: str = "") -> Column:
    """Slashes forward and the root off; the extension stays."""
    return _without_root(F.translate(path, "\\", "/"), root)


def tail(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*\z", "")


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def resolve_relative(importer: Column, specifier: Column) -> Column:
    """`.`, `..`, ./ and ../ against the importer's folder, without a slash at the end; other specifiers as they are.

    A path that climbs above the importer's top keeps its leading `..`."""
    directory = segments(folder(F.translate(importer, "\\", "/")))
    start = F.array().cast("array<string>")

    def step(acc: Column, s: Column) -> Column:
        up = (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), acc), -1) != "..")
        return F.when((s == "") | (s == "."), acc).when((s == "..") & up, F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1))).otherwise(F.concat(acc, F.array(s)))

    folded = F.array_join(F.aggregate(F.concat(directory, F.split(specifier, "/")), start, step), "/")
    folded = F.when(importer.startswith("/"), F.concat(F.lit("/"), folded)).otherwise(F.when(folded == "", ".").otherwise(folded))
    return F.when(specifier.rlike(r"^\.\.?(/|\z)"), folded).otherwise(specifier)


def resolve_workspace(specifier: Column, packages: Mapping[str, str]) -> Column:
    """The entry file of a workspace package that the specifier names in full; others, paths below a package too, as they are."""
    if not packages:
        return specifier
    table = F.create_map(*(F.lit(x) for pair in sorted(packages.items()) for x in pair))
    return F.coalesce(F.element_at(table, specifier), specifier)


def _slashes(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "/", ""))


def at_boundary(text: Column, pattern: Column) -> Column:
    """The first occurrence of pattern in text, and only that, lies between slashes or ends."""
    at = F.instr(text, pattern)
    after = at + F.length(pattern)
    return (at > 0) & ((at == 1) | (F.substring(text, at - 1, 1) == "/")) & ((after == F.length(text) + 1) | (F.substring(text, after, 1) == "/"))


def at_boundary_precise(text: Column, pattern: Column, leading: int, exact_tail: Column | bool = False) -> Column:
    """at_boundary(), where a pattern of one segment must also be the end of text with at most `leading` segments before it;
    one of several must be the end where `exact_tail` says so, else what follows may go on below it."""
    at = F.instr(text, pattern)
    ends = at + F.length(pattern) == F.length(text) + 1
    one = ends & (_slashes(F.substring(text, F.lit(1), at - 1)) <= leading)
    exact = F.lit(exact_tail) if isinstance(exact_tail, bool) else exact_tail
    return at_boundary(text, pattern) & F.when(pattern.contains("/"), ends | ~exact).otherwise(one)


def strip_parents(specifier: Column) -> Column:
    return F.regexp_replace(specifier, r"^(\.\.?/)+", "")


def python_module(specifier: Column, target: Column) -> Column:
    """a.b names a/b, its __init__, every file below a/b/, the same below any folders (but not files below those), and a/b or
    what follows it below one source folder. A name without dots only the first two."""
    name = specifier.rlike(r"^[A-Za-z_]\w*(\.[A-Za-z_]\w*)*\z")
    path = F.translate(specifier, ".", "/")
    own = F.regexp_replace(target, r"\.py\z", "")
    direct = F.regexp_replace(own, r"/__init__\z", "") == path
    below = own.startswith(F.concat(path, F.lit("/")))
    suffix = own.endswith(F.concat(F.lit("/"), path)) | own.endswith(F.concat(F.lit("/"), path, F.lit("/__init__")))
    at = F.instr(own, path)
    before, following = F.substring(own, F.lit(1), at - 1), F.substring(own, at + F.length(path), 1)
    prefixed = (at > 0) & (_slashes(before) <= 1) & ((before == "") | before.endswith("/")) & following.isin("", "/", ".")
    return name & (direct | (own == path) | below | (specifier.contains(".") & (suffix | prefixed)))


def php_namespace(specifier: Column, target: Column) -> Column:
    """The components of a specifier, in any case, are the last ones of the target; a single one only where the target has at
    most two."""
    parts, own = segments(F.lower(specifier)), segments(F.lower(target))
    same = F.slice(F.reverse(own), 1, F.greatest(F.size(parts), F.lit(1))) == F.reverse(parts)
    return (F.size(parts) > 0) & same & ((F.size(parts) > 1) | (F.size(own) <= 2))


def matches_file(specifier: Column, target: Column, exact_tail: Column | bool = False, python: Column | bool = True, php: Column | bool = True) -> Column:
    """Both normalized: equal; the target at a boundary of the specifier or the other way round; the same without leading ./
    and ../; the rules of PHP and Python where they are allowed."""
    flag = lambda x: F.lit(x) if isinstance(x, bool) else x
    bare = strip_parents(specifier)
    base = (specifier == target) | at_boundary_precise(specifier, target, 0) | at_boundary_precise(target, specifier, 1, exact_tail)
    base = base | ((bare != specifier) & (at_boundary(bare, target) | at_boundary(target, bare)))
    return base | (flag(php) & php_namespace(specifier, target)) | (flag(python) & python_module(specifier, target))


def import_matches(specifier: Column, target: Column, language: Column, root: str = "") -> Column:
    """Does a raw specifier in a file of `language` mean the normalized target? False for an empty specifier."""
    own = normalize(specifier, root)
    rust = (own == target) | (target == F.concat(own, F.lit("/mod")))
    rest = matches_file(own, target, has(language, "single_file"), has(language, "python_modules"), has(language, "namespace_imports"))
    whole = has(language, "whole_module") & ~specifier.contains("/")
    return F.when(whole | (specifier == ""), F.lit(False)).when(specifier.startswith(RUST_MOD), rust).otherwise(rest)


def _dotted(segment: Column) -> Column:
    return F.filter(F.split(segment, r"\."), lambda s: s != "")


def all_keys(path: Column) -> Column:
    """Keys that a path can be found by: its segments, and the parts between their dots, in lower case."""
    whole = segments(F.lower(path))
    return F.array_distinct(F.concat(whole, F.flatten(F.transform(whole, _dotted))))


def tail_keys(path: Column) -> Column:
    """Keys that a path is looked up by: its last segment, and the last part of that, in lower case."""
    last = F.element_at(F.concat(F.array(F.lit("")), segments(F.lower(path))), -1)
    part = F.element_at(F.concat(F.array(F.lit("")), _dotted(last)), -1)
    return F.filter(F.array_distinct(F.array(last, part)), lambda s: s != "")
