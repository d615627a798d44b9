"""``registry build`` and ``analyze`` for a repository on disk.

    python -m ripplespark registry build --root R --out FOLDER
    python -m ripplespark analyze --root R [--changed "a.ts b.ts" | --base X --target Y] [--min-confidence S] [--max-results N | --all] [--out FOLDER]
"""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import SparkSession

from ripplespark import config
from ripplespark.plans import impact, registry
from ripplespark.sources import files as sources


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="ripplespark")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("registry", "analyze"):
        one = commands.add_parser(name)
        if name == "registry":
            one.add_argument("step", choices=["build"])
        one.add_argument("--root", default=".")
        one.add_argument("--tests", nargs="*", default=[], help="further repositories that hold tests")
        one.add_argument("--locales")
        one.add_argument("--out", required=name == "registry")
        if name == "analyze":
            one.add_argument("--changed")
            one.add_argument("--base")
            one.add_argument("--target")
            one.add_argument("--min-confidence", type=float, help="least score of a result")
            one.add_argument("--max-results", type=int, help="results of a changed file at most")
            one.add_argument("--all", action="store_true", help="all results of the least score")
    return parser.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    given = arguments(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    cfg = config.read(given.root)
    if given.command == "analyze":
        asked = {"min_confidence": given.min_confidence, "max_results": given.max_results}
        cfg = replace(cfg, scoring=replace(cfg.scoring, **{k: v for k, v in asked.items() if v is not None}))
    reg = registry.of_repository(spark, given.root, cfg, tuple(given.tests), given.locales)
    if given.command == "registry":
        tables = {"files": reg.files, "graph": reg.graph, "routes": reg.routes, "history": reg.history}
        sources.write_registry(tables, given.out)
        return
    changed = sources.explicit_changes(spark, given.changed) if given.changed else sources.changed_paths(spark, given.root, given.base, given.target)
    results = impact.analyse(reg, changed, given.all)
    if given.out:
        sources.write_results(results, given.out)
    else:
        for row in sources.results_json(results).toLocalIterator():
            print(row["value"])


if __name__ == "__main__":
    main()
