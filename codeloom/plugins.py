"""Review plugins: named functions from a change to findings, run together over one change."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import columns as C
from codeloom.operators import claims, signals

FINDING = ("plugin", "file", "line", "message")


@dataclass
class Change:
    """What a review sees: patches (file, patch), the chunks of the changed files and of the whole repository (id, file, start_line,
    end_line, content, symbol_name)."""

    patches: DataFrame
    chunks: DataFrame
    repository: DataFrame

    def lines(self) -> DataFrame:
        return signals.diff_lines(self.patches)

    def files(self) -> DataFrame:
        return self.patches.select("file").distinct()


Plugin = Callable[[Change], DataFrame]
_plugins: dict[str, Plugin] = {}


def plugin(name: str) -> Callable[[Plugin], Plugin]:
    """Registers a plugin that returns file, line and message; a name that is taken is an error."""

    def keep(f: Plugin) -> Plugin:
        if name in _plugins:
            raise ValueError(f"plugin {name} exists")
        _plugins[name] = f
        return f

    return keep


def review(change: Change, only: tuple[str, ...] = ()) -> DataFrame:
    """plugin, file, line, message of all plugins, or those named; only findings on changed files, none twice."""
    unknown = set(only) - set(_plugins)
    if unknown:
        raise ValueError(f"no plugin {', '.join(sorted(unknown))}")
    out = None
    for name, f in sorted(_plugins.items()):
        if not only or name in only:
            one = f(change).select(F.lit(name).alias("plugin"), "file", F.col("line").cast("long").alias("line"), "message")
            out = one if out is None else out.unionByName(one)
    return out.join(change.files(), "file", "left_semi").select(*FINDING).distinct()


@plugin("catches")
def _catches(change: Change) -> DataFrame:
    touched = change.lines().where("sign = '+'").select("file", "line")
    return signals.undiscriminated_catches(change.chunks, touched).withColumn("message", F.concat(F.lit("treats every error of "), "binding", F.lit(" alike")))


@plugin("variants")
def _variants(change: Change) -> DataFrame:
    found = claims.added_variants(claims.family_members(change.chunks), change.lines())
    rows = claims.variant_consumers(found, change.repository)
    at = claims.family_members(change.chunks).select("file", "kind", "type", F.col("member").alias("variant"), F.col("line").alias("at"))
    said = F.concat("consumer", F.lit(" handles "), "handled", F.lit(" of "), "type", F.lit(" but not "), "variant")
    return rows.join(at, ["file", "kind", "type", "variant"]).select("file", F.col("at").alias("line"), said.alias("message"))


@plugin("claims")
def _claims(change: Change) -> DataFrame:
    guided = change.lines().where(F.greatest(*(F.col("file").rlike(p) for p in signals.GUIDANCE)))
    found = claims.added_claims(guided)
    best = claims.evidence(found, change.repository, change.files())
    return best.select("file", "line", F.concat(F.lit("check against "), "evidence_file", F.lit(": "), C.clamped(F.col("claim"))).alias("message"))
