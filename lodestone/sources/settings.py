"""Readers of settings files: aliases and variables (YAML), choices (tab-separated lines), decision logs (YAML).

Files are parsed where they are read, one whole file a row. Only files of the names given are opened; a file's namespace is
the name of its folder. YAML needs the yaml module on the workers; without it reading fails at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ALIASES = "namespace string, name string, desc string, alias string"
VARS = "namespace string, name string, desc string, choices array<struct<value:string,desc:string>>, from_command string, from_input string"
IMPACTS = "commit string, decision bigint, title string, rationale string, reasoning string, file string, start bigint, end bigint"


def _parsed(spark: SparkSession, root: str, names: list[str], schema: str, rows: Callable) -> DataFrame:
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "{" + ",".join(names) + "}").text(root, wholetext=True)
    files = files.select(F.regexp_extract("_metadata.file_path", r"([^/]*)/[^/]*$", 1).alias("namespace"), "_metadata.file_path", "value")
    columns = [c.name for c in spark.createDataFrame([], schema).schema]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for batch in batches:
            for namespace, path, text in batch.itertuples(index=False):
                try:
                    found = rows(namespace, yaml.safe_load(text))
                except (yaml.YAMLError, TypeError, KeyError, ValueError) as error:
                    raise ValueError(f"{path}: {error}") from error
                yield pd.DataFrame([dict(zip(columns, r)) for r in found], columns=columns).astype(object)

    return files.mapInPandas(parse, schema)


def read_aliases(spark: SparkSession, root: str) -> DataFrame:
    """Aliases of aliases.yaml and aliases.yml under root; an empty file has none, a name with a blank is an error."""

    def rows(namespace: str, content: list | None) -> Iterator[tuple]:
        for a in content or []:
            if " " in a["name"]:
                raise ValueError(f"alias name '{a['name']}' holds a blank")
            yield namespace, a["name"], a.get("desc"), a["alias"]

    return _parsed(spark, root, ["aliases.yaml", "aliases.yml"], ALIASES, rows)


def read_vars(spark: SparkSession, root: str) -> DataFrame:
    """Variables of vars.yaml and vars.yml under root, with their own choices if any."""

    def rows(namespace: str, content: list | None) -> Iterator[tuple]:
        for v in content or []:
            choices = [{"value": str(c["value"]), "desc": c.get("desc")} for c in v["choices"]] if v.get("choices") else None
            yield namespace, v["name"], v.get("desc"), choices, v.get("from_command"), v.get("from_input")

    return _parsed(spark, root, ["vars.yaml", "vars.yml"], VARS, rows)


def read_choices(spark: SparkSession, path: str) -> DataFrame:
    """(value, desc) of every line that isn't empty; desc is null without a second field, further fields are left out."""
    parts = F.split("value", "\t")
    return spark.read.text(path).where("value <> ''").select(parts[0].alias("value"), F.get(parts, F.lit(1)).alias("desc"))


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """One row per line range of every decision log (.yaml, .yml) at path; a decision without ranges keeps one row of nulls."""

    def rows(_: str, log: dict | None) -> Iterator[tuple]:
        for d in (log or {}).get("decisions") or []:
            head = (log.get("commit"), d["number"], d["title"], d.get("rationale"))
            spans = [(i.get("reasoning"), i["file"], r["start"], r["end"]) for i in d.get("code_impacts") or [] for r in i.get("line_ranges") or []]
            yield from ((*head, *s) for s in spans or [(None,) * 4])

    return _parsed(spark, path, ["*.yaml", "*.yml"], IMPACTS, rows)
