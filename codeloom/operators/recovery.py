"""Links that imports don't show: tests beside their source, packages and modules that bind names without an import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import columns as C
from codeloom.functions import paths
from codeloom.functions.languages import has, language_of
from codeloom.operators import imports as I
from codeloom.tables import Scratch

#: How strong the link of a test is, best first.
TEST_RANKS = {"exact": 1, "fuzzy": 2, "go": 3, "java": 4, "csharp": 5, "kotlin": 6}


def _named(files: DataFrame) -> DataFrame:
    """file, language, is_test, and the folder and stem of the normalized path."""
    own = paths.normalize(F.col("file"))
    return files.select("file").distinct().select("file", language_of(F.col("file")).alias("language"), C.is_test_file(F.col("file")).alias("is_test"), paths.folder(own).alias("folder"), paths.tail(own).alias("stem"))


def go_test_pairs(files: DataFrame) -> DataFrame:
    """(file, test): x and x_test in one folder, in a language whose tests stand beside their source."""
    rows = _named(files).where(has(F.col("language"), "same_directory_tests"))
    tests = rows.where("is_test").select(F.col("file").alias("test"), "folder", "stem")
    return rows.withColumn("stem", F.concat("stem", F.lit("_test"))).join(tests, ["folder", "stem"]).select("file", "test")


def _in_packages(files: DataFrame) -> DataFrame:
    """_named() with folder and stem below src/<set>/java/, for files that lie there."""
    inside = F.regexp_extract(paths.normalize(F.col("file")), r"(?:^|/)src/[^/]+/java/(.+)\z", 1)
    rows = _named(files).where(has(F.col("language"), "same_package_tests")).withColumn("inside", inside).where("inside <> ''")
    return rows.withColumn("folder", paths.folder(F.col("inside"))).withColumn("stem", paths.tail(F.col("inside")))


def java_test_pairs(files: DataFrame) -> DataFrame:
    """(file, test): X and XTest in one package, whatever source set each lies in."""
    rows = _in_packages(files)
    tests = rows.where("is_test").select(F.col("file").alias("test"), "folder", "stem")
    return rows.withColumn("stem", F.concat("stem", F.lit("Test"))).join(tests, ["folder", "stem"]).select("file", "test")


def package_tests(files: DataFrame, found: DataFrame) -> DataFrame:
    """(file, test) for files without any test in `found` (file, test): every test of the folder or package, but the file itself."""
    bare = files.select("file").distinct().join(found.select("file"), "file", "left_anti")
    out = None
    for rows in (_named(files).where(has(F.col("language"), "same_directory_tests")), _in_packages(files)):
        key = ["language", "folder"]
        tests = rows.where("is_test").select(F.col("file").alias("test"), F.col("stem").alias("test_stem"), *key)
        pairs = rows.join(bare, "file", "left_semi").join(tests, key).where("stem <> test_stem").select("file", "test")
        out = pairs if out is None else out.unionByName(pairs)
    return out.distinct()


def test_associations(files: DataFrame, specifiers: DataFrame, csharp: DataFrame | None = None, kotlin: DataFrame | None = None) -> DataFrame:
    """(file, test, via): tests by the imports that name the file itself, by imports that mean it, by naming conventions, and by
    the recovered references (importer, file) of C# and Kotlin; of each pair the best one.

    The import join runs over the specifiers of tests alone."""
    of_tests = specifiers.where(C.is_test_file(F.col("importer")))
    edges = I.import_edges(of_tests, files).select("file", F.col("importer").alias("test"))
    names = of_tests.withColumn("language", language_of(F.col("importer"))) if "language" not in of_tests.columns else of_tests
    whole = has(F.col("language"), "whole_module") & ~F.col("specifier").contains("/")
    exact = names.where(~whole).select(F.col("importer").alias("test"), paths.normalize(F.col("specifier")).alias("own"))
    exact = files.select("file").distinct().withColumn("own", paths.normalize(F.col("file"))).join(exact, "own").where("file <> test").select("file", "test")
    parts = [("exact", exact), ("fuzzy", edges), ("go", go_test_pairs(files)), ("java", java_test_pairs(files))]
    for via, pairs, language in (("csharp", csharp, "csharp"), ("kotlin", kotlin, "kotlin")):
        if pairs is not None:
            parts.append((via, pairs.where(C.is_test_file(F.col("importer")) & (language_of(F.col("file")) == language)).select("file", F.col("importer").alias("test"))))
    out = None
    for via, pairs in parts:
        one = pairs.select("file", "test", F.lit(TEST_RANKS[via]).alias("rank"))
        out = one if out is None else out.unionByName(one)
    best = out.groupBy("file", "test").agg(F.min("rank").alias("rank"))
    return best.select("file", "test", F.element_at(F.array(*(F.lit(v) for v in TEST_RANKS)), F.col("rank")).alias("via"))


def with_same_package(edges: DataFrame, extra: DataFrame) -> DataFrame:
    """edges (file, symbol, caller, provenance) and those of extra (file, symbol, caller) whose caller has no edge to the symbol
    yet, as namespace-inferred ones. An edge already there is never replaced, nor are several of one caller merged."""
    new = extra.select("file", "symbol", "caller").distinct().join(edges.select("file", "symbol", "caller"), ["file", "symbol", "caller"], "left_anti")
    return edges.select("file", "symbol", "caller", "provenance").unionByName(new.withColumn("provenance", F.lit("namespace-inferred")))


def distinctive(symbol: Column) -> Column:
    """A name that reads as code and has several words: an owner may be told from it."""
    return C.code_shaped(symbol) & C.several_words(symbol)


def root_package_references(exports: DataFrame, imports: DataFrame, calls: DataFrame, module: str) -> DataFrame:
    """(importer, file): a Go file that imports the module's root, which names no file, and calls a distinctive symbol that one
    root file alone exports. exports and calls (file, symbol), imports (importer, specifier)."""
    name = F.regexp_replace(F.translate("file", "\\", "/"), r"^\./", "")
    root = (language_of(F.col("file")) == "go") & ~name.contains("/") & ~C.is_test_file(F.col("file"))
    owners = exports.where(root & distinctive(F.col("symbol"))).groupBy("symbol").agg(F.min("file").alias("file"), F.countDistinct("file").alias("n")).where("n = 1").drop("n")
    of_root = imports.where((F.col("specifier") == module) & (language_of(F.col("importer")) == "go")).select("importer").distinct()
    used = calls.select(F.col("file").alias("importer"), "symbol").distinct().join(of_root, "importer", "left_semi")
    return used.join(owners, "symbol").where("importer <> file").select("importer", "file").distinct()


def module_usage_tests(declarations: DataFrame, calls: DataFrame) -> DataFrame:
    """(file, test): Swift tests that call a symbol of several words which one file alone declares; at least one of the symbols
    that link a pair must look like a type. declarations (file, symbol, extension): extensions of a type that is never
    declared don't count."""
    swift = declarations.where(language_of(F.col("file")) == "swift")
    declared = swift.where("NOT extension").select("symbol").distinct()
    own = swift.where("NOT extension").unionByName(swift.where("extension").join(declared, "symbol", "left_semi"))
    owners = own.groupBy("symbol").agg(F.min("file").alias("file"), F.countDistinct("file").alias("n")).where((F.col("n") == 1) & C.several_words(F.col("symbol"))).drop("n")
    said = Scratch(calls.sparkSession, "calls").table(calls.select("file", "symbol").distinct(), "calls")  # else each call would be tested, not each name
    used = said.where((language_of(F.col("file")) == "swift") & C.is_test_file(F.col("file"))).select(F.col("file").alias("test"), "symbol")
    pairs = used.join(owners.hint("merge"), "symbol").where("test <> file").groupBy("file", "test").agg(F.bool_or(C.type_shaped(F.col("symbol"))).alias("sure"))
    return pairs.where("sure").select("file", "test")


#: The mechanisms that recover dependents, the language and what imports can't show in it.
MECHANISMS = {
    "csharp-type-reference": ("C#", "global usings and enclosing namespaces reach a type without an import", "a type name that one C# file alone declares, found in other files' text", "aliases, generic arguments and reflection are not seen"),
    "go-root-package-export": ("Go", "the root package can only be imported by the module's path, which names no file", "the one root file that exports a distinctive symbol which an importer of the root calls", "an unrelated call of the same name counts, single-word exports don't"),
    "jvm-same-package": ("Java/Kotlin", "types of one package see each other without an import", "a type name that one file of the package alone declares, found in the package's other files that no import binds elsewhere", "a type that an on-demand import brings from outside counts as the package's own"),
}


def _and(clauses: list[str]) -> str:
    return clauses[0] if len(clauses) < 2 else f"{', '.join(clauses[:-1])} and {clauses[-1]}" if clauses else ""


def describe_recovery(mechanisms: list[str]) -> dict[str, str]:
    """What recovered dependents rest on, for several mechanisms in one sentence each; equal clauses are said once."""
    rows = [MECHANISMS[m] for m in mechanisms]
    keys = ("language", "blind_spot", "recovery", "residual_risk")
    return {k: _and(list(dict.fromkeys(r[i] for r in rows))) if rows else "" for i, k in enumerate(keys)}


def mechanism_notes(edges: DataFrame) -> DataFrame:
    """edges with a mechanism, with its language and the risk that stays: a lookup of three rows as a literal map."""
    note = lambda i: F.element_at(F.create_map(*(F.lit(x) for k, v in MECHANISMS.items() for x in (k, v[i]))), F.col("mechanism"))
    return edges.withColumn("mechanism_language", note(0)).withColumn("residual_risk", note(3))


def symbol_dependents(usages: DataFrame, file_dependents: DataFrame, exports: DataFrame, declarations: DataFrame) -> DataFrame:
    """file, symbol, dependent, degraded, found_in_file, type_incomplete for every asked (file, symbol).

    exports (file, symbol, asked rows too, exported boolean); usages (file, symbol, dependent, n); file_dependents (file,
    dependent); declarations (file, symbol, kind). A symbol that isn't exported and that nobody is seen to use falls back to
    the file's dependents, marked degraded; found_in_file says whether the file declares it at all. Usages of a class or an
    interface are marked incomplete, since calls alone don't show them."""
    kinds = declarations.groupBy("file", "symbol").agg(F.bool_or(F.col("kind").isin("class", "interface")).alias("is_type"), F.lit(True).alias("declared"))
    used = usages.groupBy("file", "symbol").agg(F.count("*").alias("n_used"))
    asked = exports.join(used, ["file", "symbol"], "left").join(kinds, ["file", "symbol"], "left")
    some_dependent = file_dependents.select("file").distinct().withColumn("has_dependents", F.lit(True))
    asked = asked.join(some_dependent, "file", "left")
    degraded = ~F.col("exported") & F.col("n_used").isNull() & F.coalesce("has_dependents", F.lit(False))
    asked = asked.withColumn("degraded", degraded).withColumn("found_in_file", F.when(degraded, F.coalesce("declared", F.lit(False))))
    asked = asked.withColumn("type_incomplete", ~degraded & F.coalesce("is_type", F.lit(False))).select("file", "symbol", "degraded", "found_in_file", "type_incomplete")
    by_use = asked.where("NOT degraded").join(usages.select("file", "symbol", "dependent"), ["file", "symbol"])
    by_file = asked.where("degraded").join(file_dependents, "file")
    return by_use.unionByName(by_file.select(by_use.columns))


#: How an edge was found, and whether that names its target for certain; of the certain ones those that an import
#: shows.
PROVENANCE = {"same-file": True, "import-verified": True, "import-only": True, "require-only": False, "symbol-name-match": False, "oop-method-import": False, "namespace-inferred": False}
IMPORT_EVIDENCE = ("import-verified", "import-only")


def precise(provenance: Column) -> Column:
    return provenance.isin(*(k for k, v in PROVENANCE.items() if v))


def import_only_evidence(edges: DataFrame, dependents: DataFrame) -> DataFrame:
    """(file, symbol, dependent): callers of edges (file, symbol, caller, provenance) that an import proves, among the
    dependents (file, symbol, dependent) that were reported: what a type's users can be told from."""
    rows = edges.where(F.col("provenance").isin(*IMPORT_EVIDENCE)).select("file", "symbol", F.col("caller").alias("dependent")).distinct()
    return rows.join(dependents.select("file", "symbol", "dependent"), ["file", "symbol", "dependent"], "left_semi")


def representatives(chunks: DataFrame) -> DataFrame:
    """One chunk (id, file, symbol_name, symbol_type, parent_class) a file: the first class without a parent, else the first
    such function, else the first with a name; a file without any is (module-level)."""
    bare = F.coalesce("parent_class", F.lit("")) == ""
    rank = F.when((F.col("symbol_type") == "class") & bare, 1).when((F.col("symbol_type") == "function") & bare, 2).when(F.coalesce("symbol_name", F.lit("")) != "", 3).otherwise(4)
    w = Window.partitionBy("file").orderBy("rank", "id")
    first = chunks.withColumn("rank", rank).withColumn("n", F.row_number().over(w)).where("n = 1")
    return first.select("file", F.when(F.col("rank") < 4, F.col("id")).alias("id"), F.when(F.col("rank") < 4, F.col("symbol_name")).otherwise("(module-level)").alias("symbol_name"))


def most_complex(chunks: DataFrame) -> DataFrame:
    """One chunk a (file, symbol_name), the most complex, the first of equals; no name is a name."""
    key = ["file", F.coalesce("symbol_name", F.lit("")).alias("symbol_name")]
    best = F.max_by("id", F.struct(F.coalesce("complexity", F.lit(0)).alias("c"), (-F.col("id")).alias("i")))
    return chunks.groupBy(*key).agg(best.alias("id"), F.max(F.coalesce("complexity", F.lit(0))).alias("complexity"))
