"""Path rules against the published cases, blocking against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from codeloom.functions import columns as C
from codeloom.functions import languages, paths
from codeloom.operators import imports

#: Fixed values: (specifier, target, may it match) where nothing is known of the importer, so that all rules apply.
ANY_LANGUAGE = [
    ("./schemas/index.js", "packages/cli/src/mcp/schemas/index.ts", True), ("../schemas/index", "src/mcp/schemas/index", True), ("src/utils/logger", "utils/logger", True),
    ("packages/cli/src/logger", "src/logger", True), ("src/logger-utils", "src/logger", False), ("src/logger", "src/logger-utils", False), ("some-logger-package", "logger", False),
    ("my-logger", "logger", False), ("src/mylogger", "logger", False), ("src/loggerservice", "logger", False), ("@company/logger-service", "logger", False), ("winston-logger", "logger", False),
    ("src/database.ts", "src/logger.ts", False), ("auth/handler", "logger", False), ("src/utils/validator.ts", "lib/validator.ts", False), ("components/Button.tsx", "ui/Button.tsx", False),
    ("auth/handler.ts", "api/handler.ts", False), ('"src/logger"', "src/logger", True), ("'src/logger'", "src/logger", True), ("src\\logger", "src/logger", True), ("src\\utils\\logger", "src/utils/logger", True),
    (" src/logger ", "src/logger", True), ("src/logger.js", "src/logger.ts", True), ("./utils.js", "./utils.ts", True), ("components/Button.js", "components/Button.tsx", True), ("src/helper.jsx", "src/helper.tsx", True),
    ("src/logger", "src/logger.ts", True), ("src/logger.ts", "src/logger", True), ("src/logger.ts", "src/utils.ts", False), ("auth/handler.js", "api/handler.js", False), ("logger", "logger.test", False),
    ("src/logger", "src/logger.test", False), ("utils/validator", "utils/validator.spec", False), ("logger.ts", "logger.test.ts", False), ("src/auth.ts", "src/auth.spec.ts", False),
    ("App\\Models\\User", "app/Models/User.php", True), ("App\\Models\\Collection", "web/app/Models/Collection.php", True), ("App\\Models\\User", "app/Models/Product.php", False),
    ("App\\Services\\Auth", "app/Models/User.php", False), ("src/models/user", "src/models/product", False), ("Error", "src/error", True), ("auth", "src/auth.rs", True), ("auth/middleware", "src/auth/middleware.rs", True),
    ("models/user", "src/models/user.rs", True), ("utils", "src/utils.rs", True), ("../utils", "utils.rs", True), ("auth.rs", "src/auth.rs", True), ("src/auth.rs", "src/auth", True), ("auth", "src/models.rs", False),
    ("auth/middleware", "src/auth/handler.rs", False), ("django.http", "django/http/response.py", True), ("django.http", "django/http/__init__.py", True), ("django.http.response", "django/http/response.py", True),
    ("django.views.generic.base", "django/views/generic/base.py", True), ("django.http", "src/django/http/response.py", True), ("myapp.models", "project/myapp/models/__init__.py", True),
    ("django.http", "django/http/request.py", True), ("django.http", "django/http/cookie.py", True), ("django.http", "django/views/generic.py", False), ("django.db.models", "django/http/response.py", False),
    ("src/models/user", "src/models/product.py", False), ("./utils.helper", "utils/helper.py", False), ("../models.user", "models/user.py", False), ("src/utils.helper", "utils/helper.py", False),
    ("django.utils", "django/utils/__init__.py", True), ("django.utils", "django/utils/timezone.py", True), ("flask", "flask/__init__.py", True), ("flask", "flask.py", True), ("flask", "flask/app.py", True),
    ("flask", "flask/sansio/app.py", True), ("flask", "flaskext/app.py", False), ("flask", "flask_sqlalchemy/app.py", False), ("flask", "vendor/some/deep/flask/app.py", False),
    ("flask.json.tag", "src/flask/json/tag.py", True), ("src/flask", "src/flask/__init__.py", True), ("src/flask", "src/flask/app.py", True), ("src/flask", "src/flask/sansio/blueprints.py", True),
    ("src/flask", "src/flaskext/app.py", False), ("com.example.Utils", "com/example/UtilsHelper", False), ("com.example.Op", "com/example/OpChain", False), ("org.example.Json", "org/example/JsonWriter", False),
    ("com.example.Utils", "src/com/example/UtilsHelper", False), ("com.example.Utils", "com/example/Utils.kt", True), ("com.example.Utils", "src/com/example/Utils.min", True),
    ("github.com/gin-gonic/gin/internal/fs", "fs", False), ("github.com/gin-gonic/gin/internal/fs", "internal/fs", True), ("internal/fs", "fs", False), ("internal/fs", "internal/fs", True),
    ("sinatra", "lib/sinatra/base", False), ("sinatra", "lib/sinatra/version", False), ("sinatra", "lib/sinatra", True), ("Combine", "Source/Features/Combine", False), ("logger", "logger", True), ("./logger", "logger", True),
    ("../logger", "logger", True), ("Alamofire", "Source/Alamofire", True), ("internal/fs", "internal/fs/fs.go", True), ("internal/fs", "internal/fs/utils.go", True), ("src", "src/utils/jwt/jws", True),
]
#: Fixed values: (specifier, importer, target, does it match).
BY_IMPORTER = [
    ("./logger", "src/foo.ts", "src/logger", True), ("src/database.ts", "src/foo.ts", "src/logger.ts", False), ("Alamofire", "Source/AlamofireTests.swift", "Source/Alamofire.swift", False),
    ("auth", "src/consumer.rs", "src/auth.rs", True), ("Combine", "Tests/CombineTests.swift", "Combine", False), ("rack/protection", "rack-protection/spec/spec_helper.rb", "rack-protection/lib/rack/protection/xss_header", False),
    ("rack/protection", "rack-protection/spec/spec_helper.rb", "rack-protection/lib/rack/protection", True), ("internal/fs", "render/html.go", "internal/fs/fs.go", True), ("internal/fs", "render/html.go", "internal/fs/utils.go", True),
    ("src", "src/adapter/deno/websocket.test.ts", "src/utils/jwt/jws.ts", False), ("flask", "flask/tests/test_app.py", "flask/app.py", True), ("mod:src/thing", "src/main.rs", "src/thing/mod.rs", True),
    ("mod:src/thing", "src/main.rs", "src/thing/sibling.rs", False), ("mod:src/engine/helpers", "src/engine.rs", "src/engine.rs", False), ("mod:src/engine/helpers", "src/engine.rs", "src/engine/helpers.rs", True),
    ("mod:src/engine", "src/lib.rs", "src/engine.rs", True), ("mod:src/engine", "src/lib.rs", "src/engine/helpers.rs", False), ("src/thing", "src/main.rs", "src/thing/sibling.rs", True), ("Error", "src/error.rs", "src/error.rs", False),
    ("Context", "src/context.rs", "src/context.rs", False), ("CONFIG", "src/lib.rs", "src/config.rs", False), ("App\\Models\\User", "Controller.php", "app/Models/User.php", True), ("", "a.ts", "b", False),
]
#: Names of tests, and names that only look so.
TESTS = "src/auth.test.ts components/Button.test.tsx src/auth.spec.ts test/auth.ts src/test/helper.ts packages/cli/test/fixtures.ts tests/auth.ts __tests__/auth.ts src\\auth.test.ts test\\helper.ts src\\__tests__\\utils.ts models/user_spec.rb pkg/math_test.go spec/models/user_spec.rb app/specs/helper.rb a/b/c/d/e/test/helper.ts src/test\\helper.ts src/UnitTests/ConfigurationFeatureTest.cs src/IntegrationTests/SomeFeature.cs src/AutoMapper.DI.Tests/ContainerTests.cs FooTest.cs FooTests.cs src\\UnitTests\\ConfigurationFeatureTest.cs Tests/Command/CommandTest.php Test/helper.py Specs/models/user.rb FooTests.swift Tests/App/Main.swift a.test.d.ts".split(" ")
NO_TESTS = "contest.ts manifest.json attest.js protest-handler.ts latest/config.ts greatest/helper.js fastest-route/index.ts mytest.ts testing.js testimonial.tsx src/auth.ts index.ts mytest.rb respec/config.rb spec.rb src/AutoMapper/Latest.cs src/AutoMapper/Contest.cs latest/Config.cs contest/Config.cs FooTests.ts src/UnitTests/Helper.ts Latest/config.ts Contest/config.ts Testing/helper.ts test_a.py a/FooTest.java FooTest.kt".split(" ")


def test_cases_without_an_importer(spark):
    df = spark.createDataFrame([(i, s, t) for i, (s, t, _) in enumerate(ANY_LANGUAGE)], "i int, s string, t string")
    got = {r["i"]: r["m"] for r in df.select("i", paths.matches_file(paths.normalize(F.col("s")), paths.normalize(F.col("t"))).alias("m")).collect()}
    assert [c for i, c in enumerate(ANY_LANGUAGE) if got[i] != c[2]] == []


@pytest.mark.parametrize(("specifier", "target", "tail", "want"), [("rack/protection", "rack-protection/lib/rack/protection", True, True), ("rack/protection", "lib/rack/protection/base", True, False), ("internal/fs", "internal/fs/fs", False, True), ("sinatra", "lib/sinatra", True, True), ("sinatra", "lib/sinatra/base", True, False), ("auth/middleware", "src/auth/middleware", True, True), ("github.com/gin-gonic/gin/internal/fs", "internal/fs", True, True)])
def test_whole_tails(spark, specifier, target, tail, want):
    assert spark.range(1).select(paths.matches_file(F.lit(specifier), F.lit(target), tail)).first()[0] is want


@pytest.mark.parametrize(("specifier", "target", "want"), [("Error", "src/error", False), ("auth", "src/auth", True), ("flask", "flask/app", False)])
def test_rules_that_are_not_allowed(spark, specifier, target, want):
    assert spark.range(1).select(paths.matches_file(F.lit(specifier), F.lit(target), False, False, False)).first()[0] is want


def test_cases_by_importer(spark):
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(BY_IMPORTER)], "i int, s string, f string, t string")
    match = paths.import_matches(F.col("s"), paths.normalize(F.col("t")), languages.language_of(F.col("f")))
    got = {r["i"]: r["m"] for r in df.select("i", match.alias("m")).collect()}
    assert [c for i, c in enumerate(BY_IMPORTER) if got[i] != c[3]] == []


def test_names_of_tests(spark):
    df = spark.createDataFrame([(f,) for f in TESTS + NO_TESTS], "file string")
    got = {r["file"] for r in df.where(C.is_test_file(F.col("file"))).collect()}
    assert sorted(got) == sorted(TESTS)


def test_first_occurrence_only(spark):
    assert spark.range(1).select(paths.at_boundary(F.lit("xa/b/c/a/b"), F.lit("a/b"))).first()[0] is False


@pytest.mark.parametrize(("importer", "specifier", "want"), [("a/b/c.ts", "./x", "a/b/x"), ("a/b/c.ts", "../x", "a/x"), ("a/b/c.ts", "../../../x", "../x"), ("a/b/c.ts", ".", "a/b"), ("a/b/c.ts", "..", "a"), ("a/b/c.ts", "./", "a/b"), ("a/b/c.ts", "lodash", "lodash"), ("a/b/c.py", ".module", ".module"), ("/w/a/c.ts", "./x", "/w/a/x"), ("c.ts", "./x", "x"), ("c.ts", ".", "."), ("a\\b\\c.ts", "../x", "a/x")])
def test_relative_specifiers(spark, importer, specifier, want):
    assert spark.range(1).select(paths.resolve_relative(F.lit(importer), F.lit(specifier))).first()[0] == want


def test_workspace_packages(spark):
    df = spark.createDataFrame([("@scope/core",), ("@scope/core/sub",), ("lodash",)], "s string")
    assert [r[0] for r in df.select(paths.resolve_workspace(F.col("s"), {"@scope/core": "packages/core/src/index.ts"})).collect()] == ["packages/core/src/index.ts", "@scope/core/sub", "lodash"]


def test_flags(spark):
    rows = {r["language"]: r for r in languages.flag_table(spark).collect()}
    assert {k for k, r in rows.items() if r["blind"]} == {"csharp", "java", "kotlin", "swift"} and len(rows) == 11
    got = languages.with_flags(spark.createDataFrame([("a/B.CS",), ("a.md",), ("x/y.rb",)], "file string")).orderBy("file").collect()
    assert [(r["language"], r["blind"], r["single_file"]) for r in got] == [(None, False, False), ("csharp", True, False), ("ruby", False, True)]


CORPORA = {
    "languages": ([("src/a.ts", "./utils/logger"), ("src/x/b.ts", "../utils/logger"), ("main.go", "internal/bytesconv"), ("src/flask/cli.py", "flask.app"), ("app/C.php", "App\\Models\\Order"), ("Sources/App/Main.swift", "Foundation"), ("src/self.ts", "./self"), ("src/self.ts", "lodash"), ("src/lib.rs", "mod:src/engine")],
                  ["src/utils/logger.ts", "src/a.ts", "src/x/b.ts", "main.go", "internal/bytesconv/bytesconv.go", "internal/bytesconv/helpers.go", "src/flask/cli.py", "src/flask/app.py", "app/C.php", "app/Models/Order.php", "Sources/App/Main.swift", "Sources/App/Foundation.swift", "src/self.ts", "src/engine/mod.rs", "src/lib.rs"]),
    "deep": ([("src/a/b/c/d/e/f.ts", "../../target"), ("src/a/other.ts", "./b/c/target")], ["src/a/b/c/target.ts", "src/a/b/c/d/e/f.ts", "src/a/other.ts"]),
    "dots": ([("src/App.cs", "Serilog.Core.Enrichers"), ("src/pkg/x.py", "pkg.mod"), ("src/pkg/mod.thing.py", "pkg.mod")], ["src/Serilog.Core/Enrichers.cs", "src/App.cs", "src/pkg/mod.thing.py", "src/pkg/x.py"]),
    "same names": ([("src/three.ts", "./one"), ("src/three.ts", "./two/index")], ["src/one/index.ts", "src/two/index.ts", "src/three.ts"]),
    "rust": ([("tests/test_macros.rs", "tests/common"), ("src/error.rs", "crate::error")], ["tests/common/mod.rs", "tests/test_macros.rs", "src/error.rs"]),
}


def both(spark, spec, files):
    specs, names = spark.createDataFrame(spec, "importer string, specifier string"), spark.createDataFrame([(f,) for f in files], "file string")
    return (sorted(map(tuple, f(specs, names).collect())) for f in (imports.import_edges, imports.import_edges_brute))


@pytest.mark.parametrize("name", CORPORA)
def test_blocking_equals_brute_force(spark, name):
    quick, brute = both(spark, *CORPORA[name])
    assert quick == brute and quick


def test_edges_of_languages(spark):
    quick, _ = both(spark, *CORPORA["languages"])
    assert quick == sorted([("src/a.ts", "src/utils/logger.ts"), ("src/x/b.ts", "src/utils/logger.ts"), ("main.go", "internal/bytesconv/bytesconv.go"), ("main.go", "internal/bytesconv/helpers.go"), ("src/flask/cli.py", "src/flask/app.py"), ("app/C.php", "app/Models/Order.php"), ("src/lib.rs", "src/engine/mod.rs")])


def test_blocking_equals_brute_force_on_random_paths(spark):
    rng = random.Random(17)
    parts = ["src", "lib", "a", "b", "ab", "A", "x.y", "index", "__init__", "mod", "app", "Models"]
    ends = [".ts", ".py", ".php", ".rb", ".swift", ".rs", ".go", ".cs", ""]
    path = lambda n: "/".join(rng.choice(parts) for _ in range(rng.randint(1, n)))
    files = sorted({path(4) + rng.choice(ends) for _ in range(220)})
    shapes = [lambda: path(3), lambda: "./" + path(2), lambda: "../" * rng.randint(1, 2) + path(2), lambda: path(3).replace("/", "."), lambda: path(3).replace("/", "\\"), lambda: "mod:" + path(3), lambda: rng.choice(files), lambda: rng.choice(files).rsplit(".", 1)[0], lambda: "..", lambda: "."]
    quick, brute = both(spark, [(rng.choice(files), rng.choice(shapes)()) for _ in range(500)], files)
    assert quick == brute and len(quick) > 200
