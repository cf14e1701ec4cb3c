"""Scalar functions on source text, paths, identifiers and templates, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extension to language.
LANGUAGES = {"rs": "Rust", "py": "Python", "go": "Go", "ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "java": "Java", "c": "C", "h": "C", "cpp": "Cpp", "cc": "Cpp", "cxx": "Cpp", "hpp": "Cpp"}
PLACEHOLDER = r"\{\{ ?([A-Za-z0-9_:]+) ?\}\}"


def content_id(detector: Column, fingerprint: Column) -> Column:
    """detector:hash of a finding; line numbers never enter it."""
    return F.concat(detector, F.lit(":"), F.sha2(F.concat(detector, fingerprint), 256))


def file_hash(content: Column) -> Column:
    """SHA-256 of a text with line ends made alike."""
    return F.sha2(F.replace(content, F.lit("\r\n"), F.lit("\n")), 256)


def lines(content: Column) -> Column:
    """Lines of a text without their ends; a final line end starts no line, and an empty text has none."""
    parts = F.split(content, "\n", -1)
    return F.when(content == "", F.array().cast("array<string>")).when(content.endswith("\n"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_slice(content: Column, start: Column, end: Column) -> Column:
    """Lines start..end, from 1 and inclusive; null where the range is inverted, starts at 0 or leaves the text."""
    all_lines = lines(content)
    ok = (start >= 1) & (end >= start) & (end <= F.size(all_lines))
    return F.when(ok, F.array_join(F.slice(all_lines, F.greatest(start, F.lit(1)), F.greatest(end - start + 1, F.lit(0))), "\n"))


def language_of(path: Column) -> Column:
    """Language by the last dot-segment of a path, 'Unknown' for all others."""
    ext = F.lower(F.element_at(F.split(path, r"\."), -1))
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, ext), F.lit("Unknown"))


def normalize_type(t: Column) -> Column:
    """A parameter's type without its leading reference and mutability."""
    return F.regexp_replace(F.trim(t), r"^(&\s*(mut )?|mut )\s*", "")


def placeholders(template: Column) -> Column:
    """Names in {{ name }} in order, repeats included."""
    return F.regexp_extract_all(template, F.lit(PLACEHOLDER), 1)


def env_vars(command: Column) -> Column:
    """Names of $NAME, ${NAME} and $(NAME) in order, repeats included."""
    return F.regexp_extract_all(command, F.lit(r"\$[\{\(]?([A-Za-z_][A-Za-z0-9_]*)[\}\)]?"), 1)


def programs_used(command: Column) -> Column:
    """First word of every command in a shell line; quoted parts are dropped, backticked names added."""
    bare = F.regexp_replace(command, r"\"[^\"]*\"|'[^']*'", "")
    firsts = F.transform(F.split(bare, r"&&|\|\||\|"), lambda p: F.element_at(F.split(F.trim(p), r"\s+"), 1))
    ticked = F.regexp_extract_all(command, F.lit(r"`\s*([^`\s]+)[^`]*`"), 1)
    return F.array_distinct(F.filter(F.concat(firsts, ticked), lambda x: (x != "") & ~x.startswith("`")))


def subsequence(text: Column, query: str) -> Column:
    """Whether the characters of query stand in text in order, ignoring case."""
    import re

    return text.rlike("(?is)" + ".*".join(re.escape(c) for c in query)) if query else F.lit(True)


def ref_display(ref: Column) -> Column:
    """A commit shortened to seven characters; named references as they are."""
    return F.when(ref.rlike("^[0-9a-f]{8,40}$"), F.left(ref, F.lit(7))).otherwise(ref)


def follows_convention(reasoning: Column) -> Column:
    """Whether a reasoning starts with [Behavioral - x] or [Structural - x]."""
    return reasoning.rlike(r"^\[(Behavioral|Structural) - [^\]]+\]")


def _by(value: Column, table: dict, other=None) -> Column:
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), value)
    return found if other is None else F.coalesce(found, F.lit(other))


# Kinds of units and nodes, and what they count for. Smaller is more important.
ESSENTIAL, IMPORTANT, BACKGROUND, NOISE = 0, 1, 2, 3
UNIT_RELEVANCE = {"data": ESSENTIAL, "callable": ESSENTIAL, "module": ESSENTIAL, "variable": IMPORTANT, "import": IMPORTANT}
LEAF_RELEVANCE = {
    "function": ESSENTIAL, "class": ESSENTIAL, "struct": ESSENTIAL, "enum": ESSENTIAL, "interface": ESSENTIAL, "impl": IMPORTANT, "type": IMPORTANT, "variable": IMPORTANT,
    "signature": IMPORTANT, "module": BACKGROUND, "import": BACKGROUND, "file": BACKGROUND,
}
ANCHORS = {"function": "function signature", "struct": "struct declaration", "enum": "enum declaration", "variable": "variable assignment", "import": "import"}
CHANGES = {"added": 0, "deleted": 1, "modified": 2}


def unit_relevance(kind: Column, node_kind: Column) -> Column:
    """How much a unit counts; one of unknown kind is noise where its node is an error, else background."""
    return F.coalesce(_by(kind, UNIT_RELEVANCE), F.when(node_kind.contains("error"), NOISE).otherwise(BACKGROUND))


def leaf_relevance(kind: Column) -> Column:
    return _by(kind, LEAF_RELEVANCE, NOISE)


def anchor_type(kind: Column) -> Column:
    """What a line of this kind can be aligned by; null for kinds that are no anchors."""
    return _by(kind, ANCHORS)


def change_rank(change: Column) -> Column:
    return _by(change, CHANGES)


def boundary_name(kind: Column, identifier: Column, text: Column) -> Column:
    """A function, struct or enum by its identifier, or its kind without one; anything else by its first line, trimmed."""
    first = F.coalesce(F.trim(F.get(lines(text), F.lit(0))), F.lit(""))
    return F.when(kind.isin("function", "struct", "enum"), F.coalesce(identifier, kind)).otherwise(first)


def clamp_range(start: Column, end: Column, n_lines: Column) -> Column:
    """struct<start, end> with end at most n_lines; null where start is 0 or past the last line, end is 0 or before start."""
    return F.when((start >= 1) & (end >= start) & (start <= n_lines), F.struct(start.alias("start"), F.least(end, n_lines).alias("end")))


def sanitize_identifier(raw: Column) -> Column:
    """A name without blanks and without the brace and bracket pairs around it."""
    return F.regexp_replace(raw, r" |\{\{|\}\}|\[\[|\]\]", "")


def split_identifier(raw: Column, default_namespace: Column) -> Column:
    """struct<namespace, name> of 'ns::name' (further segments are left out); an empty namespace is none, a missing one the default."""
    parts = F.split(raw, "::")
    space = sanitize_identifier(F.get(parts, F.lit(0)))
    qualified = raw.contains("::")
    return F.struct(
        F.when(qualified & (space != ""), space).otherwise(default_namespace).alias("namespace"),
        F.when(qualified, sanitize_identifier(F.get(parts, F.lit(1)))).otherwise(sanitize_identifier(raw)).alias("name"),
    )


def qualify(alias: Column, namespace: Column) -> Column:
    """An alias whose unqualified placeholders name their namespace."""
    spaced = F.regexp_replace(alias, r"\{\{ ?([A-Za-z0-9_]+) ?\}\}", "{{ \x00::$1 }}")
    return F.replace(spaced, F.lit("\x00"), F.coalesce(namespace, F.lit("")))


def env_substitute(text: Column, env: Column) -> Column:
    """$name and ${name} replaced by env, a map; names that it lacks become empty. Values are taken literally."""
    parts = F.split(text, r"\$(?=\{[A-Za-z_]|[A-Za-z_])", -1)
    name = lambda p: F.regexp_extract(p, r"^\{?([A-Za-z_][A-Za-z0-9_]*)\}?", 1)
    rest = lambda p: F.regexp_replace(p, r"^(\{[A-Za-z_][A-Za-z0-9_]*\}|[A-Za-z_][A-Za-z0-9_]*)", "")
    tail = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(F.coalesce(F.try_element_at(env, name(p)), F.lit("")), rest(p)))
    return F.concat(F.get(parts, F.lit(0)), F.array_join(tail, ""))


def import_parts(text: Column) -> Column:
    """struct<kind, module, items> of an import statement: wildcard, specific (items in braces) or default."""
    body = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), "^(use )+", ""), ";+$", ""))
    braces = F.regexp_extract(body, r"\{?([^{}]*)\}?$", 1)
    items = F.filter(F.transform(F.split(braces, ","), lambda x: F.trim(x)), lambda x: x != "")
    none = F.array().cast("array<string>")
    wild, specific = body.contains("*"), body.contains("{")
    kind = F.when(wild, "wildcard").when(specific, "specific").otherwise("default")
    module = F.when(wild, F.replace(body, F.lit("::*"), F.lit(""))).when(specific, F.regexp_replace(body, r"(::)?\{.*$", "")).otherwise(body)
    return F.struct(kind.alias("kind"), module.alias("module"), F.when(~wild & specific, items).otherwise(none).alias("items"))


def visibility(language: Column, name: Column) -> Column:
    """Visibility by a language's naming convention, null for languages without one."""
    python = F.when(name.rlike("^__.*__$"), "magic").when(name.startswith("_"), "private").otherwise("public")
    return F.when(language == "Python", python).when(language == "Go", F.when(name.rlike("^[A-Z]"), "public").otherwise("private"))


def wrapped(text: Column, width: int) -> Column:
    """Lines of at most width characters, filled greedily; longer words are cut."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    pieces = F.flatten(F.transform(words, lambda w: F.regexp_extract_all(w, F.lit("(?s).{1,%d}" % max(1, width)), F.lit(0))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))

    def add(acc: Column, p: Column) -> Column:
        fits = F.length(acc["line"]) + 1 + F.length(p) <= max(1, width)
        return F.when(acc["line"] == "", F.struct(acc["done"].alias("done"), p.alias("line"))).when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["line"], F.lit(" "), p).alias("line"))).otherwise(
            F.struct(F.concat(acc["done"], F.array(acc["line"])).alias("done"), p.alias("line"))
        )

    return F.aggregate(pieces, start, add, lambda acc: F.when(acc["line"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["line"]))))


def session_id(*sources: Column) -> Column:
    """The first of the sources that is set and not empty; 'default' if none is."""
    return F.coalesce(*[F.when(s != "", s) for s in sources], F.lit("default"))


def fuzzy_score(text: Column, query: str) -> Column:
    """Score of a subsequence match that ignores case, null without one: 100 a character less the length of the leftmost match."""
    low, at, first = F.lower(text), F.lit(0), None
    for c in query.lower():
        found = F.locate(c, F.substring(low, at + 1, F.length(low)))
        at = F.when(found > 0, at + found)
        first = at if first is None else first
    return F.when(at.isNotNull(), F.lit(100 * len(query)) - (at - first + 1)) if query else F.lit(0)


def file_change(additions: Column, deletions: Column) -> Column:
    """What happened to a file by its counts of added and deleted lines."""
    return F.when((additions > 0) & (deletions > 0), "modification").when(additions > 0, "creation").when(deletions > 0, "deletion").otherwise("unchanged")
