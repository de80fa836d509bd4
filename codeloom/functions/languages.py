"""Languages: their extensions and what their imports can and can't say."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Language:
    """How a language's imports and scopes work.

    whole_module: an import names a module, never a file. single_file: a path of several segments names one file, not a
    folder. namespace_imports: imports are namespaces that mirror folders in any case. same_directory_tests and
    same_package_tests: a test stands beside its source, or in the same package. enclosing_namespaces: code sees the
    namespaces around its own. same_unit: code sees its whole unit without imports."""

    name: str
    extensions: tuple[str, ...]
    whole_module: bool = False
    single_file: bool = False
    python_modules: bool = False
    namespace_imports: bool = False
    same_directory_tests: bool = False
    same_package_tests: bool = False
    enclosing_namespaces: bool = False
    same_unit: bool = False

    @property
    def blind(self) -> bool:
        """Dependents may need no import here, so that a zero says little. Tests beside their source don't make it so."""
        return self.enclosing_namespaces or self.same_package_tests or self.whole_module or self.same_unit


#: Parsed languages, their extensions and flags.
LANGUAGES = (
    Language("typescript", ("ts", "tsx")),
    Language("javascript", ("js", "jsx", "mjs", "cjs")),
    Language("php", ("php",), namespace_imports=True),
    Language("python", ("py",), python_modules=True),
    Language("rust", ("rs",)),
    Language("go", ("go",), same_directory_tests=True),
    Language("java", ("java",), same_package_tests=True),
    Language("csharp", ("cs",), enclosing_namespaces=True),
    Language("ruby", ("rb",), single_file=True),
    Language("kotlin", ("kt",), same_unit=True),
    Language("swift", ("swift",), whole_module=True),
)
EXTENSIONS = tuple(e for x in LANGUAGES for e in x.extensions)
FLAGS = ("whole_module", "single_file", "python_modules", "namespace_imports", "same_directory_tests", "same_package_tests", "enclosing_namespaces", "same_unit", "blind")


def language_of(file: Column) -> Column:
    """The language that claims a file's extension, whatever its case; null if none does."""
    extension = F.lower(F.regexp_extract(file, r"[^/\\]\.([A-Za-z0-9]+)\z", 1))
    out = F.when(F.lit(False), "")
    for x in LANGUAGES:
        out = out.when(extension.isin(*x.extensions), x.name)
    return out


def has(language: Column, flag: str) -> Column:
    """Does the language have the flag? False for other languages and for null."""
    names = [x.name for x in LANGUAGES if getattr(x, flag)]
    return F.coalesce(language.isin(*names), F.lit(False))


def flag_table(spark: SparkSession) -> DataFrame:
    """language and one boolean for each flag: as many rows as languages."""
    return spark.createDataFrame([(x.name, *(bool(getattr(x, f)) for f in FLAGS)) for x in LANGUAGES], "language string, " + ", ".join(f"{f} boolean" for f in FLAGS))


def with_flags(files: DataFrame, file: str = "file") -> DataFrame:
    """files with language and its flags; where no language claims a file they are null and false."""
    out = files.withColumn("language", language_of(F.col(file)))
    return out.select("*", *(has(F.col("language"), f).alias(f) for f in FLAGS))
