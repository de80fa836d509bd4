"""Shell commands of a session: is one a run of tests, of all of them, or of which paths?"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.functions.languages import EXTENSIONS

_END = r"(?=\s|$)"
#: How runners of tests are called, one alternative each, at the start of a command.
RUNNERS = (
    r"npm\s+run\s+test(:\S*)?", r"npm\s+test", r"npm\s+t", r"yarn\s+test(:\S*)?", r"pnpm\s+(?:--filter|-F)(?:\s+\S+|=\S+)\s+test", r"pnpm\s+test(:\S*)?", r"bun\s+test", r"npx\s+vitest", r"vitest", r"jest", r"mocha",
    r"python[0-9.]*\s+-m\s+pytest", r"pytest", r"go\s+test", r"cargo\s+nextest", r"cargo\s+test", r"bundle\s+exec\s+rspec", r"rspec", r"bundle\s+exec\s+rake\s+test(:\S*)?", r"(\./)?rake\s+test(:\S*)?",
    r"(\./)?(vendor/bin/)?phpunit", r"composer\s+test", r"dotnet\s+test", r"deno\s+test", r"swift\s+test", r"gradle\s+test", r"(\./)?gradlew\s+(?:[\w.:=-]+\s+)*(?<!-x\s)(?<!--exclude-task\s)(\S*:)?test", r"mvn\s+test",
    r"nx\s+test(?:\s+\S+)?", r"tox(\s+run)?", r"python[0-9.]*\s+-m\s+tox", r"nox", r"python[0-9.]*\s+-m\s+nox",
)
#: Tools that run a command in an environment, and their flags that take a value.
WRAPPERS = r"(?:uv|poetry|pipenv|rye|pdm)\s+run"
WRAPPER_VALUES = {"--group", "--no-group", "--extra", "--no-extra", "--with", "--with-editable", "--with-requirements", "--index", "--python", "-p", "--directory", "-C", "--env-file", "--package"}
#: Flags whose value is no scope; flags that pick tests by name, by runner; flags with values of two runners.
SKIPPED = {"-w", "--workspace", "-c", "--config"}
BY_NAME = ((r"pytest$", {"-k", "-m"}), (r"rspec$", {"-e", "--example"}), (r"^mocha$", {"--grep", "-g"}), (r"^go\s+test$", {"-run"}), (r"vitest$|^jest$", {"-t", "--testNamePattern"}), (r"^(dotnet|swift)\s+test$", {"--filter"}))
CARGO_VALUES = {"-p", "--package", "--exclude", "--manifest-path", "--lockfile-path", "--target", "--target-dir", "--profile", "-j", "--jobs", "-F", "--features", "--color", "--message-format"}
PNPM_VALUES = {"--filter", "-F"}

_RUNNER = re.compile("|".join(f"(?:{r}){_END}" for r in RUNNERS))
_ASSIGNED = re.compile(r"(?:[A-Za-z_][A-Za-z0-9_]*=\S*\s+)+")
_WRAPPED = re.compile(WRAPPERS + _END)
_SUFFIXES = tuple(f".{e}" for e in EXTENSIONS)


def _bare(segment: str) -> str:
    """A command without variables set before it and without wrappers."""
    while True:
        segment = _ASSIGNED.sub("", segment, count=1) if _ASSIGNED.match(segment) else segment
        wrapped = _WRAPPED.match(segment)
        if not wrapped:
            return segment
        words = segment[wrapped.end() :].split()
        while words and words[0].startswith("-"):
            del words[: 2 if words[0] in WRAPPER_VALUES else 1]
        segment = " ".join(words)


def _scopes(runner: str, rest: str) -> tuple[list[str], bool]:
    """Paths that a runner's arguments name, and whether tests are picked by name."""
    cargo = runner == "cargo test"
    values = SKIPPED | (CARGO_VALUES if cargo else PNPM_VALUES if re.search(r"^pnpm\s+test(:\S*)?$", runner) else set())
    by_name = next((flags for pattern, flags in BY_NAME if re.search(pattern, runner)), set())
    found, named, words = [], False, iter(rest.split())
    for w in words:
        if w in values:
            next(words, None)
        elif w in by_name or any(w.startswith(f"{f}=") for f in by_name):
            named = True
        elif w.startswith("-"):
            continue
        elif w not in ("./...", "...") and not re.search(r"\.config\.[^./]+$", w, re.I) and ("/" in w or w.endswith(_SUFFIXES)):
            found.append(w)
        else:
            named = named or cargo
    return found, named


def classify(command: str | None) -> tuple[bool, bool, list[str]]:
    """(is a test run, of all tests, scope tokens); a broad run has no scopes, and a null command is none."""
    run, broad, scopes = False, False, []
    for segment in re.split(r"&&|\|\||\||;", command or ""):
        bare = _bare(segment.strip())
        match = _RUNNER.match(bare)
        if match:
            run = True
            found, named = _scopes(match[0].strip(), bare[match.end() :])
            scopes += found
            broad = broad or not (found or named)
    return run, broad, [] if broad else list(dict.fromkeys(scopes))


_RESULT = T.StructType([T.StructField("is_test_run", T.BooleanType()), T.StructField("broad", T.BooleanType()), T.StructField("scopes", T.ArrayType(T.StringType()))])


@F.pandas_udf(_RESULT)
def _classified(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for commands in batches:
        yield pd.DataFrame([classify(c) for c in commands], columns=["is_test_run", "broad", "scopes"])


def test_command(command: Column) -> Column:
    """struct(is_test_run, broad, scopes): quoting and flags are beyond SQL, so batches go through Arrow."""
    return _classified(command)
