"""Files of a small application as a table."""

from pyspark.sql import DataFrame, SparkSession

from ripplespark import schema
from ripplespark.config import load
from ripplespark.operators.scorers import Registry

EMPTY = {"imports": [], "exports": [], "selectors": [], "routes": [], "action_types": [], "jsx_text": [], "translation_keys": []}
CYPRESS = {"visited_routes": [], "selectors": [], "contains_text": [], "intercepts": [], "url_assertions": [], "custom_commands": [], "describes": [], "its": []}


def entry(path: str, kind: str | None = None, cypress: dict | None = None, **fields) -> dict:
    kind = kind or ("test" if ".cy." in path or ".test." in path or "__tests__" in path else "source")
    return {"path": path, "name": path.rsplit("/", 1)[-1], "type": kind, **EMPTY, **fields, "cypress": CYPRESS | (cypress or {})}


def table(spark: SparkSession, *entries: dict) -> DataFrame:
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema.FILES)
    return spark.createDataFrame([{f.name: e.get(f.name) for f in kind} for e in entries], kind)


def registry(spark: SparkSession, *entries: dict, config: dict | None = None, **more) -> Registry:
    return Registry(table(spark, *entries), load(config), **more)


def paths(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "path string")


def rows(df: DataFrame) -> dict:
    """Signals by (changed, test)."""
    return {(r["changed"], r["test"]): r for r in df.collect()}


def weight(df: DataFrame) -> float | None:
    found = df.collect()
    assert len(found) <= 1
    return found[0]["weight"] if found else None
