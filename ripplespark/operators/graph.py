"""Operators over the import graph, a table of distinct edges (src imports dst).

Depths are bounded, so cones are unrolled joins; deeper walks go by a frontier that only
new nodes enter.  Depth is always the shortest one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplespark.config import Scoring


def edges(files: DataFrame) -> DataFrame:
    """Distinct (src, dst) of all imports; an import of oneself is none."""
    return files.select(F.col("path").alias("src"), F.explode("imports").alias("dst")).where("src <> dst").distinct()


def reverse(graph: DataFrame) -> DataFrame:
    return graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def in_degree(graph: DataFrame) -> DataFrame:
    """(path, importers) of every file with importers."""
    return graph.groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("importers"))


def cone(seeds: DataFrame, graph: DataFrame, depth: int) -> DataFrame:
    """(seed, node, depth) of what is reached from each seed (column ``path``) over at most so many edges; seeds at 0."""
    level = seeds.select(F.col("path").alias("seed"), F.col("path").alias("node")).distinct()
    found = level.withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        level = level.join(graph, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        found = found.unionByName(level.withColumn("depth", F.lit(d)))
    return found.groupBy("seed", "node").agg(F.min("depth").alias("depth"))


def _keeper(df: DataFrame):
    """How steps of a walk are kept: on the shared folder where one is set, else in memory and on disk."""
    spark = df.sparkSession
    return (lambda x: x.checkpoint()) if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() else (lambda x: x.persist())


def capped_cone(seeds: DataFrame, graph: DataFrame, depth: int, most: int) -> DataFrame:
    """The cones of at most ``most`` nodes, with their size without the seed.

    A seed goes as soon as its cone is known to be larger, before it is walked on from: after
    each level by what it has reached, and before the next by a node at its edge that alone
    leads to too many. So no level has more than ``most`` * ``most`` nodes of a seed.
    """
    keep = _keeper(seeds)
    degree = graph.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    frontier = seeds.select(F.col("path").alias("seed"), F.col("path").alias("node")).distinct()
    found = frontier.withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        # A node isn't its own neighbour, so the cone has at least one node more than it has neighbours.
        wide = frontier.join(degree.where(F.col("degree") >= most), "node").select("seed").distinct()
        small = frontier.join(wide, "seed", "left_anti")
        step = small.join(graph, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        new = step.join(found.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(d))
        reached = keep(found.join(wide, "seed", "left_anti").unionByName(new))
        over = reached.groupBy("seed").agg(F.count("*").alias("nodes")).where(F.col("nodes") > most).select("seed")
        found = reached.join(over, "seed", "left_anti")
        frontier = found.where(F.col("depth") == d).select("seed", "node")
    size = found.groupBy("seed").agg((F.count("*") - 1).alias("cone_size"))
    return found.join(size, "seed").select("seed", "node", "depth", "cone_size")


def reachable(seeds: DataFrame, graph: DataFrame, max_depth: int = 10) -> DataFrame:
    """(seed, node, depth) of everything reached within ``max_depth`` edges, without the seeds.

    Each step joins only the nodes found in the step before. The plan is kept short by
    checkpoints where a checkpoint folder is set.
    """
    keep = _keeper(seeds)
    frontier = keep(seeds.select(F.col("path").alias("seed"), F.col("path").alias("node")).distinct().withColumn("depth", F.lit(0)))
    found = frontier
    for d in range(1, max_depth + 1):
        step = frontier.join(graph, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        frontier = keep(step.join(found.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found.where("depth > 0")


def suggested_specs(seeds: DataFrame, graph: DataFrame, specs: DataFrame, max_depth: int = 10) -> DataFrame:
    """(path, depth) of specs (column ``path``) that depend on any seed, nearest first; seeds that are specs have depth 0."""
    reached = reachable(seeds, reverse(graph), max_depth).select(F.col("node").alias("path"), "depth")
    own = seeds.select("path").withColumn("depth", F.lit(0))
    return own.unionByName(reached).join(specs.select("path"), "path", "left_semi").groupBy("path").agg(F.min("depth").alias("depth")).orderBy("depth", "path")


def updated(graph: DataFrame, changed: DataFrame) -> DataFrame:
    """The graph after files (path, imports) were read again: their old edges go, their new ones come."""
    return graph.join(changed.select(F.col("path").alias("src")), "src", "left_anti").unionByName(edges(changed))


def ubiquity(files: DataFrame, graph: DataFrame) -> DataFrame:
    """(path, ubiquity) of source files: the share of source files that import them; empty without sources."""
    sources = files.where("type = 'source'").select("path")
    n = sources.agg(F.count("*").alias("sources"))
    return sources.join(in_degree(graph), "path", "left").join(n).select("path", (F.coalesce("importers", F.lit(0)) / F.col("sources")).alias("ubiquity"))


def hub_role(name: Column, kind: Column, n_exports: Column, n_imports: Column, n_routes: Column, cfg: Scoring | None = None) -> Column:
    """'router' or 'barrel' for files that much of the application goes through, else null. Tests are never hubs."""
    cfg = cfg or Scoring()
    router = name.rlike(r"(?i)^router\.(t|j)sx?$") | (n_routes >= cfg.router_routes)
    barrel = name.rlike(r"(?i)^index\.(t|j)sx?$") & (n_exports >= cfg.barrel_exports) & (n_imports >= cfg.barrel_exports)
    return F.when(kind != "source", F.lit(None)).when(router, F.lit("router")).when(barrel, F.lit("barrel"))


def hubs(files: DataFrame, cfg: Scoring | None = None) -> DataFrame:
    """(path, role) of hub files."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    n = {c: F.when(F.col(c).isNull(), 0).otherwise(size(c)) for c in ("exports", "imports", "routes")}
    return files.select("path", hub_role(F.col("name"), F.col("type"), n["exports"], n["imports"], n["routes"], cfg).alias("role")).where("role IS NOT NULL")


def components(graph: DataFrame) -> DataFrame:
    """For dashboards: nodes with their in- and out-degree."""
    ends = graph.select(F.col("src").alias("path"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(graph.select(F.col("dst").alias("path"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("path").agg(F.sum("o").alias("imports"), F.sum("i").alias("importers"))


def first_level_hit(starts: DataFrame, graph: DataFrame, targets: DataFrame, depth: int) -> DataFrame:
    """(start, depth): for each start the nearest depth at which a target (column ``path``) is found."""
    found = cone(starts, graph, depth).join(targets.select(F.col("path").alias("node")).distinct(), "node", "left_semi")
    w = Window.partitionBy("seed")
    return found.withColumn("least", F.min("depth").over(w)).where("depth = least").select(F.col("seed").alias("start"), "depth").distinct()
