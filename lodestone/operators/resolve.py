"""Resolving a template: in what order its variables come, where their values come from, what is still to be chosen, what it lacks."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.templates import substitute
from lodestone.operators.graphs import closure, execution_levels


class Resolver(Protocol):
    """What gives a variable its choices; each method takes variables and returns (namespace, name, value)."""

    def static(self, variables: DataFrame) -> DataFrame: ...

    def command(self, variables: DataFrame) -> DataFrame: ...

    def input(self, variables: DataFrame) -> DataFrame: ...

    def select(self, choices: DataFrame) -> DataFrame: ...


def execution_sequence(roots: DataFrame, deps: DataFrame) -> DataFrame:
    """(root, node, place): all that a root needs, from 1, whatever a node needs before it; ties by name. deps: node, needs.

    A cycle raises ValueError. roots: root, a node of deps.
    """
    levels = execution_levels(deps)
    needs = closure(deps.where("needs is not null"), "node", "needs")
    reached = roots.select("root").distinct().join(needs, F.col("root") == F.col("src")).select("root", F.col("dst").alias("node"))
    w = Window.partitionBy("root").orderBy("level", "node")
    return reached.join(levels, "node").withColumn("place", F.row_number().over(w)).select("root", "node", "place")


def missing_variables(deps: DataFrame, variables: DataFrame) -> DataFrame:
    """(node, missing): for every node the sorted names it needs that no variable has; all of them at once."""
    lost = deps.where("needs is not null").join(variables.select(F.col("name").alias("needs")), "needs", "left_anti")
    return lost.groupBy("node").agg(F.array_join(F.array_sort(F.collect_set("needs")), ",").alias("missing"))


def resolution_kind(variables: DataFrame) -> DataFrame:
    """variables (choices, from_command, from_input) with kind: a command goes before an input, an input before listed choices."""
    kind = F.when(F.col("from_command").isNotNull(), "command").when(F.col("from_input").isNotNull(), "input").when(F.size("choices") > 0, "static").otherwise("none")
    return variables.withColumn("kind", kind)


def gather_choices(wanted: DataFrame, defaults: DataFrame, resolved: DataFrame) -> DataFrame:
    """(name, value, origin) for every wanted name: its default where it has one, else what was resolved; null where neither is."""
    found = wanted.select("name").distinct().join(defaults.select("name", F.col("value").alias("_d"), F.lit(True).alias("_has")), "name", "left")
    rest = found.where("_has is null").select("name").join(resolved.select("name", "value"), "name", "left").withColumn("origin", F.when(F.col("value").isNotNull(), "resolved"))
    return found.where("_has").select("name", F.col("_d").alias("value"), F.lit("default").alias("origin")).unionByName(rest)


def next_step(sequence: DataFrame, chosen: DataFrame) -> DataFrame:
    """(root, node): the first variable of each root's sequence without a choice; null where all have one and commands can be made."""
    steps = sequence.join(chosen.select("root", F.col("name").alias("node"), F.lit(True).alias("_c")).distinct(), ["root", "node"], "left")
    return steps.groupBy("root").agg(F.min(F.when(F.col("_c").isNull(), F.struct("place", "node"))).alias("s")).select("root", F.col("s.node").alias("node"))


def run_alias(aliases: DataFrame, choices: DataFrame, history: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(commands, history): the commands that choices make of aliases (namespace, name, alias), and the log with them put at its end.

    Commands are resolved, not run. An alias with a missing choice gives no command. history: seq, command.
    """
    filled = substitute(aliases, "alias", choices, "namespace").where("size(missing) = 0").drop("missing").withColumnRenamed("alias", "command")
    if history is None:
        return filled, None
    last = history.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("_m"))
    place = F.row_number().over(Window.orderBy("namespace", "name", "command"))
    put = filled.crossJoin(F.broadcast(last)).withColumn("seq", (F.col("_m") + place).cast("bigint")).select("seq", "command")
    return filled, history.select("seq", "command").unionByName(put)


def unset_variables(used: DataFrame, environment: DataFrame) -> DataFrame:
    """Distinct names that commands use and the environment lacks. used, environment: name."""
    return used.select("name").distinct().join(environment.select("name"), "name", "left_anti")


def context(aliases: DataFrame, variables: DataFrame, deps: DataFrame, session: DataFrame | None = None, check: bool = True) -> dict[str, DataFrame]:
    """What a run needs: aliases, variables, deps and the session's defaults. With check, missing variables raise; an agent's context has neither."""
    if check:
        lost = missing_variables(deps, variables).limit(5).collect()
        if lost:
            raise ValueError("missing variables: " + "; ".join(f"{r['node']} needs {r['missing']}" for r in lost))
    found = {"aliases": aliases, "variables": variables, "deps": deps}
    return found if session is None else found | {"defaults": session}
