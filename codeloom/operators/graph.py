"""Bounded breadth-first expansion over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.tables import Scratch


def expand(seeds: DataFrame, edges: DataFrame, depth: int, scratch: Scratch | None = None) -> DataFrame:
    """(seed, node, hops): nodes reached from each seed over (file, importer) edges, with their first depth.

    One join a level for all seeds at once, and an anti-join against what was reached before. Edges are written once and
    each level once, below one folder, so that a level reads three tables whatever its depth; no rows reach the driver.
    Seeds of a cycle don't reach themselves."""
    scratch = scratch or Scratch(seeds.sparkSession, "expand")
    step = scratch.table(edges.select(F.col("file").alias("node"), F.col("importer").alias("next")).distinct(), "edges")
    start = seeds.select(F.col("file").alias("seed"), F.col("file").alias("node")).distinct()
    folder = scratch.path("reached")
    frontier = scratch.table(start, "level-0", path=f"{folder}/hops=0")
    schema = T.StructType([*frontier.schema.fields, T.StructField("hops", T.IntegerType())])
    for level in range(1, depth + 1):
        found = frontier.join(step, "node").select("seed", F.col("next").alias("node")).distinct()
        reached = scratch.read(folder, schema).select("seed", "node")
        frontier = scratch.table(found.join(reached, ["seed", "node"], "left_anti"), f"level-{level}", path=f"{folder}/hops={level}")
    return scratch.read(folder, schema).where("hops > 0")


def capped(reached: DataFrame, most: int) -> DataFrame:
    """At most `most` nodes of a seed beyond depth 1, nearest first, ties by name; `truncated` tells where that cut."""
    w = Window.partitionBy("seed").orderBy("hops", "node")
    rows = reached.withColumn("rank", F.row_number().over(w)).withColumn("truncated", F.count("*").over(Window.partitionBy("seed")) > most)
    return rows.where((F.col("rank") <= most) | (F.col("hops") == 1)).drop("rank")


def reexport_dependents(edges: DataFrame, reexports: DataFrame, depth: int = 3, scratch: Scratch | None = None) -> DataFrame:
    """target, node: dependents that only chains of re-exporting files bring, at most `depth` of them.

    edges (importer, file); reexports (barrel, file): a barrel passes on what it imports from file. A target's barrels, and
    the barrels of those, make up its chain; importers of any of them depend on it, except itself and those that import it
    anyway (its own barrels among them)."""
    scratch = scratch or Scratch(edges.sparkSession, "reexports")
    ends = edges.select("file").unionByName(edges.select(F.col("importer").alias("file")))
    reach = Reach(ends.unionByName(reexports.select("file")).unionByName(reexports.select(F.col("barrel").alias("file"))), scratch)
    passing = reach.adjacency(reexports.select("file", F.col("barrel").alias("importer")))
    chain = reach.expand(reexports.select("file").distinct(), passing, depth)
    return reach.named(reach.beyond(chain, reach.adjacency(edges))).withColumnRenamed("seed", "target")


#: Numbers of one block: what is reached is kept as (seed, block, places in it), so that exchanges carry 2 bytes a node.
BLOCK = 1024


class Reach:
    """Expansion of many seeds at once over numbered files.

    nodes (file) holds every name that edges have. Numbers follow the order of names: number = block * BLOCK + place. A node's
    neighbours, and what a seed reaches, are sets of places by block, united within (seed, block); names come back last."""

    def __init__(self, nodes: DataFrame, scratch: Scratch):
        self.scratch = scratch
        number = F.monotonically_increasing_id()
        self.ids = scratch.table(nodes.select("file").distinct().orderBy("file").select("file", number.alias("number")), "numbers")

    @staticmethod
    def _explode(rows: DataFrame, *keep: str) -> DataFrame:
        return rows.select(*keep, "block", F.explode("places").alias("place")).select(*keep, (F.col("block") * BLOCK + F.col("place")).alias("node"))

    def adjacency(self, edges: DataFrame) -> DataFrame:
        """node, block, places of (file, importer) edges."""
        ids = self.ids.hint("merge")
        numbered = edges.select("file", "importer").join(ids.withColumnRenamed("number", "node"), "file").select("node", F.col("importer").alias("file")).join(ids, "file")
        place = F.pmod("number", F.lit(BLOCK)).cast("smallint")
        rows = numbered.select("node", F.floor(F.col("number") / BLOCK).alias("block"), place.alias("place"))
        return self.scratch.table(rows.groupBy("node", "block").agg(F.array_distinct(F.collect_list("place")).alias("places")), "adjacency")

    def _step(self, frontier: DataFrame, adjacency: DataFrame, had: DataFrame) -> DataFrame:
        """seed, block, places: neighbours of the frontier (seed, node) that are not among `had` (seed, block, places)."""
        grown = frontier.join(adjacency.hint("merge"), "node").groupBy("seed", "block").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
        had = had.groupBy("seed", "block").agg(F.flatten(F.collect_list("places")).alias("had"))
        rows = grown.join(had.hint("merge"), ["seed", "block"], "left")
        left = F.sort_array(F.when(F.col("had").isNull(), F.col("places")).otherwise(F.array_except("places", "had")))
        return rows.select("seed", "block", left.alias("places")).where(F.size("places") > 0)

    def expand(self, seeds: DataFrame, adjacency: DataFrame, depth: int) -> DataFrame:
        """seed, block, places, hops over numbers; a level is a table below one folder, as in expand()."""
        folder = self.scratch.path("reached")
        inner = self.scratch.sized(adjacency.select("node").distinct(), "inner")  # others lead nowhere
        number = self.ids.join(seeds.select("file").distinct().hint("merge"), "file").select(F.col("number").alias("seed"))
        place = F.array(F.pmod("seed", F.lit(BLOCK)).cast("smallint"))
        level = self.scratch.table(number.select("seed", F.floor(F.col("seed") / BLOCK).alias("block"), place.alias("places")), "level-0", path=f"{folder}/hops=0")
        schema = T.StructType([*level.schema.fields, T.StructField("hops", T.IntegerType())])
        for hop in range(1, depth + 1):
            frontier = self._explode(level, "seed").join(inner, "node", "left_semi")
            step = self._step(frontier, adjacency, self.scratch.read(folder, schema).drop("hops"))
            level = self.scratch.table(step, f"level-{hop}", path=f"{folder}/hops={hop}")
        return self.scratch.read(folder, schema).where("hops > 0")

    def beyond(self, reached: DataFrame, adjacency: DataFrame) -> DataFrame:
        """seed, block, places: neighbours of what seeds reach, without the seeds themselves and their own neighbours."""
        inner = self.scratch.sized(adjacency.select("node").distinct(), "inner")
        seeds = reached.select("seed").distinct()
        place = F.array(F.pmod("seed", F.lit(BLOCK)).cast("smallint"))
        own = seeds.select("seed", F.floor(F.col("seed") / BLOCK).alias("block"), place.alias("places"))
        direct = adjacency.withColumnRenamed("node", "seed")
        return self._step(self._explode(reached, "seed").join(inner, "node", "left_semi"), adjacency, own.unionByName(direct))

    def seeds_named(self, rows: DataFrame) -> DataFrame:
        """rows with the name of their seed in place of its number."""
        names = self.ids.join(rows.select(F.col("seed").alias("number")).distinct().hint("merge"), "number")
        names = self.scratch.sized(names.select(F.col("number").alias("seed"), F.col("file").alias("name")), "seeds")
        return rows.join(names, "seed").drop("seed").withColumnRenamed("name", "seed")

    def named(self, rows: DataFrame) -> DataFrame:
        """One row for each node (seed, node and the other columns) of seed, block, places: names meet blocks, not nodes."""
        one = F.struct(F.pmod("number", F.lit(BLOCK)).alias("place"), "file")
        names = self.ids.groupBy(F.floor(F.col("number") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(one)).alias("names"))
        rows = self.seeds_named(rows)
        node = F.explode(F.transform("places", lambda p: F.get(F.col("names"), p.cast("int"))["file"]))
        return rows.join(names.hint("merge"), "block").select("seed", *(c for c in rows.columns if c not in ("seed", "block", "places")), node.alias("node"))

    def nearest(self, reached: DataFrame, most: int) -> DataFrame:
        """capped() over expand(): numbers follow names, so whole sets are counted and only what is kept is written out."""
        w = Window.partitionBy("seed").orderBy("hops", "block")
        n = F.size("places")
        before = F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - n
        rows = reached.withColumn("before", before).withColumn("truncated", F.sum(n).over(Window.partitionBy("seed")) > most)
        rows = rows.where((F.col("hops") == 1) | (F.col("before") < most))
        few = F.slice("places", F.lit(1), F.greatest(F.lit(0), F.least(n, most - F.col("before"))).cast("int"))
        return self.named(rows.withColumn("places", F.when(F.col("hops") == 1, F.col("places")).otherwise(few)).drop("before"))
