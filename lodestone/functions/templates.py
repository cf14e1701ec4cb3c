"""Templates: placeholders, references between aliases, and the commands that choices make of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import qualify, split_identifier
from lodestone.sources.shared import cut

PLACEHOLDER = r"\{\{ ?[A-Za-z0-9_:]+ ?\}\}"
REFERENCE = r"\[\[ ?[A-Za-z0-9_:]+ ?\]\]"


def expand(templates: DataFrame, template: str, choices: dict[str, DataFrame]) -> DataFrame:
    """templates with command: every {{ name }} of choices replaced by a value, all combinations.

    choices: per name a DataFrame with one column of values, taken literally. Every occurrence of a name gets the same
    value. A name without values leaves no rows.
    """
    out = templates.withColumn("command", F.col(template))
    for name, values in choices.items():
        value = values.select(F.col(values.columns[0]).cast("string").alias(f"_{name}")).distinct()
        literal = F.replace(F.replace(F.col(f"_{name}"), F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
        out = out.join(value).withColumn("command", F.regexp_replace("command", F.lit(r"\{\{ ?" + name + r" ?\}\}"), literal)).drop(f"_{name}")
    return out


def _filled(rows: DataFrame, text: str, pattern: str, values: DataFrame, namespace: str | None, keep: bool) -> DataFrame:
    """rows with text's marks replaced one after another, leftmost first, each by every value of its name, and missing: names without any.

    values: namespace, name, value. What a value brings in is not read again, so values are literal whatever they hold. The marks of
    a text are the text's own, so there are as many rounds as the text with most marks has; each is one equi join.
    """
    names = rows.columns
    space = F.col(namespace) if namespace else F.lit(None).cast("string")
    rounds = rows.agg(F.max(F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))).alias("n")).first()["n"] or 0
    out = rows.select(*names, F.lit("").alias("_done"), F.col(text).alias("_rest"), F.array().cast("array<string>").alias("missing"))
    known = values.select(F.col("namespace").alias("_ns"), F.col("name").alias("_name"), F.col("value").cast("string").alias("_value"))
    for _ in range(rounds):
        parts = F.split("_rest", pattern, 2)
        mark = F.regexp_extract("_rest", pattern, 0)
        out = out.withColumn("_mark", F.when(mark != "", mark)).withColumn("_id", F.when(mark != "", split_identifier(F.regexp_replace(mark, r"[\[\]{} ]", ""), space)))
        out = out.withColumn("_head", F.get(parts, F.lit(0))).withColumn("_tail", F.get(parts, F.lit(1)))
        out = out.join(known, F.col("_id.name").eqNullSafe(F.col("_name")) & F.col("_id.namespace").eqNullSafe(F.col("_ns")) & F.col("_mark").isNotNull(), "left")
        lost = F.col("_mark").isNotNull() & F.col("_name").isNull()
        full = F.concat_ws("::", "_id.namespace", "_id.name")
        filled = F.coalesce(F.when(F.col("_name").isNotNull(), F.col("_value")), F.col("_mark") if keep else F.lit(""))
        out = out.select(
            *names,
            F.when(F.col("_mark").isNotNull(), F.concat("_done", "_head", filled)).otherwise(F.col("_done")).alias("_done"),
            F.when(F.col("_mark").isNotNull(), F.coalesce("_tail", F.lit(""))).otherwise(F.col("_rest")).alias("_rest"),
            F.when(lost, F.array_union("missing", F.array(full))).otherwise(F.col("missing")).alias("missing"),
        )
    return out.select(*[F.concat("_done", "_rest").alias(c) if c == text else F.col(c) for c in names], "missing")


def substitute(templates: DataFrame, text: str, choices: DataFrame, namespace: str | None = None) -> DataFrame:
    """templates with text filled in by choices (namespace, name, value), all combinations, and missing: names without a choice, in order.

    Every occurrence takes a choice of its own: n occurrences of a name with k choices give k to the n commands. Values are literal.
    """
    return _filled(templates, text, PLACEHOLDER, choices, namespace, keep=False)


def substitute_known(templates: DataFrame, text: str, choices: DataFrame, namespace: str | None = None) -> DataFrame:
    """templates with the names that choices hold filled in, each by its first choice (column place); all other placeholders stay."""
    first = choices.groupBy("namespace", "name").agg(F.min(F.struct("place", "value")).alias("f")).select("namespace", "name", F.col("f.value").alias("value"))
    return _filled(templates, text, PLACEHOLDER, first, namespace, keep=True).drop("missing")


def inline_aliases(aliases: DataFrame) -> DataFrame:
    """aliases (namespace, name, alias) with every [[ns::name]] replaced by that alias's text, whose placeholders name its namespace; one level.

    A reference without a namespace is one of the alias's own. missing holds the references that name no alias.
    """
    texts = aliases.select("namespace", "name", qualify(F.col("alias"), F.col("namespace")).alias("value"))
    return _filled(aliases, "alias", REFERENCE, cut(texts), "namespace", keep=True)


def discover_aliases(variables: DataFrame) -> DataFrame:
    """(namespace, name, desc, alias) for every variable marked discover that has choices or a command; input variables have nothing to show.

    variables: namespace, name, discover, choices (array<string>), from_command.
    """
    listed = F.coalesce(F.size("choices"), F.lit(0)) > 0
    command = F.when(listed, F.concat(F.lit("printf '%s\\n' "), F.array_join("choices", " "))).otherwise(F.col("from_command"))
    shown = variables.where("discover").withColumn("alias", command).where("alias is not null")
    return shown.select("namespace", F.concat(F.lit("discover_"), "name").alias("name"), F.concat(F.lit("discover: "), "name").alias("desc"), "alias")
