"""Templates, their variables and what resolves them, written from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import templates as tx
from lodestone.functions import text as fx
from lodestone.operators import resolve, state
from lodestone.plans.registry import query
from lodestone.sources.tables import table


def _choices(spark, sf, place=False):
    """Part sizes are the choices of brands: Brand#n is the name n in namespace b; distinct sizes above 40."""
    part = table(spark, sf, "part").where("p_size > 40").select(F.lit("b").alias("namespace"), F.substring("p_brand", 7, 9).alias("name"), F.col("p_size").alias("value")).distinct()
    return part.withColumn("place", F.col("value")) if place else part


def _commands(spark, sf):
    """A nation's command names its key's variable twice, in its own namespace and in full, and one that may not exist."""
    key = F.col("n_nationkey").cast("string")
    text = F.concat(F.lit("run {{ b::"), key, F.lit(" }} $HOME {{"), key, F.lit("}} "), F.when(F.col("n_nationkey") % 5 == 0, "{{ b::none }}").otherwise("end"))
    return table(spark, sf, "nation").select(F.lit("b").alias("namespace"), F.col("n_name").alias("name"), text.alias("alias"))


_CHOICES = "WITH ch AS (SELECT DISTINCT p_brand[7:] AS name, p_size AS v FROM part WHERE p_size > 40), n AS (SELECT n_name AS name, n_nationkey AS k FROM nation)"


@query(_CHOICES + """
SELECT n.name, 'run ' || coalesce(a.v::VARCHAR, '') || ' $HOME ' || coalesce(b.v::VARCHAR, '') || ' ' || CASE WHEN k % 5 = 0 THEN '' ELSE 'end' END AS alias,
       concat_ws(',', CASE WHEN a.v IS NULL THEN 'b::' || k END, CASE WHEN k % 5 = 0 THEN 'b::none' END) AS missing
FROM n LEFT JOIN ch a ON a.name = k::VARCHAR LEFT JOIN ch b ON b.name = k::VARCHAR""")
def repeated_placeholders(spark, sf):
    """n occurrences of a name with k choices give k to the n commands."""
    return tx.substitute(_commands(spark, sf), "alias", _choices(spark, sf), "namespace").select("name", "alias", F.array_join("missing", ",").alias("missing"))


@query(_CHOICES + """, f AS (SELECT name, min(v)::VARCHAR AS v FROM ch GROUP BY 1)
SELECT n.name, 'run ' || coalesce(v, '{{ b::' || k || ' }}') || ' $HOME ' || coalesce(v, '{{' || k || '}}') || ' ' || CASE WHEN k % 5 = 0 THEN '{{ b::none }}' ELSE 'end' END AS alias
FROM n LEFT JOIN f ON f.name = k::VARCHAR""")
def partial_substitution(spark, sf):
    return tx.substitute_known(_commands(spark, sf), "alias", _choices(spark, sf, place=True), "namespace").select("name", "alias")


@query("""
WITH a AS (SELECT replace(r_name, ' ', '_') AS ns, n_name AS name, n_nationkey AS k FROM nation JOIN region ON n_regionkey = r_regionkey),
q AS (SELECT ns, name, k, 'go {{ ' || ns || '::x }} {{ o::y }}' AS value FROM a)
SELECT a.ns AS namespace, a.name, 'go {{x}} {{ o::y }}' || CASE WHEN a.k > 0 AND a.k % 2 = 0 THEN ' && ' || q.value || ' | ' || q.value ELSE '' END || CASE WHEN a.k % 4 = 2 THEN ' [[ lost ]]' ELSE '' END AS alias,
       CASE WHEN a.k % 4 = 2 THEN a.ns || '::lost' ELSE '' END AS missing
FROM a LEFT JOIN q ON q.k = a.k - 1""")
def inlined_aliases(spark, sf):
    """Every other nation's alias refers twice to the one of the nation before it, some to one that is not there."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    named = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.replace("r_name", F.lit(" "), F.lit("_")).alias("namespace"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("k"))
    before = named.select(F.concat("namespace", F.lit("::"), "name").alias("ref"), (F.col("k") + 1).alias("k"))
    text = F.concat(
        F.lit("go {{x}} {{ o::y }}"),
        F.when(F.col("ref").isNotNull() & (F.col("k") % 2 == 0), F.concat(F.lit(" && [["), "ref", F.lit("]] | [[ "), "ref", F.lit(" ]]"))).otherwise(""),
        F.when(F.col("k") % 4 == 2, " [[ lost ]]").otherwise(""),
    )
    found = tx.inline_aliases(named.join(before, "k", "left").select("namespace", "name", text.alias("alias")))
    return found.select("namespace", "name", "alias", F.array_join("missing", ",").alias("missing"))


@query("""
WITH v AS (SELECT p_brand[7:] AS name, count(*) AS n, string_agg(DISTINCT p_size::VARCHAR, ' ' ORDER BY p_size::VARCHAR) FILTER (p_size > 45) AS c FROM part GROUP BY 1)
SELECT 'b' AS namespace, 'discover_' || name AS name, 'discover: ' || name AS "desc", CASE WHEN c IS NOT NULL AND name::INTEGER % 3 > 0 THEN 'printf ''%s\\n'' ' || c ELSE 'ls ' || name END AS alias
FROM v WHERE name::INTEGER % 2 = 0 AND (name::INTEGER % 3 > 0 AND c IS NOT NULL OR name::INTEGER % 4 = 0)""")
def discovered_aliases(spark, sf):
    n = F.col("name").cast("int")
    brands = table(spark, sf, "part").groupBy(F.substring("p_brand", 7, 9).alias("name")).agg(F.array_sort(F.collect_set(F.when(F.col("p_size") > 45, F.col("p_size").cast("string")))).alias("c"))
    variables = brands.select(F.lit("b").alias("namespace"), "name", (n % 2 == 0).alias("discover"), F.when(n % 3 > 0, F.col("c")).alias("choices"), F.when(n % 4 == 0, F.concat(F.lit("ls "), "name")).alias("from_command"))
    return tx.discover_aliases(variables)


def _deps(spark, sf):
    """Segments need the nations of their customers, nations need regions, regions the world."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    need = lambda a, b: (F.col(a).alias("node"), F.col(b).alias("needs"))
    a = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(*need("n_name", "r_name"))
    b = region.select(F.col("r_name").alias("node"), F.lit("world").alias("needs"))
    c = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(*need("c_mktsegment", "n_name")).distinct()
    return a.unionByName(b).unionByName(c).unionByName(spark.createDataFrame([("world", None)], "node string, needs string"))


_SEQUENCE = """WITH RECURSIVE e AS (SELECT DISTINCT n_name AS src, r_name AS dst, 2 AS l FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION SELECT DISTINCT r_name, 'world', 1 FROM region UNION SELECT DISTINCT c_mktsegment, n_name, 3 FROM customer JOIN nation ON c_nationkey = n_nationkey),
c AS (SELECT src, dst FROM e WHERE l = 3 UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src),
s AS (SELECT src AS root, dst AS node, row_number() OVER (PARTITION BY src ORDER BY coalesce((SELECT min(l) FROM e WHERE e.src = c.dst), 0), dst) AS place FROM c)
"""


@query(_SEQUENCE + "SELECT root, node, place::INTEGER AS place FROM s")
def execution_sequence(spark, sf):
    roots = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("root")).distinct()
    return resolve.execution_sequence(roots, _deps(spark, sf))


@query(_SEQUENCE + """, h AS (SELECT root, node, place FROM s WHERE NOT (node = 'world' OR length(node) % 2 = 0))
SELECT root, arg_min(node, place) AS node FROM s LEFT JOIN h USING (root, node, place) GROUP BY root HAVING TRUE""".replace("arg_min(node, place)", "(SELECT arg_min(h.node, h.place) FROM h WHERE h.root = s.root)"))
def next_resolution_step(spark, sf):
    """The first variable of each sequence that is neither the world nor of even length, as those have their choices."""
    sequence = resolve.execution_sequence(table(spark, sf, "customer").select(F.col("c_mktsegment").alias("root")).distinct(), _deps(spark, sf))
    chosen = sequence.where((F.col("node") == "world") | (F.length("node") % 2 == 0)).select("root", F.col("node").alias("name"))
    return resolve.next_step(sequence, chosen)


@query("""
WITH d AS (SELECT DISTINCT s_name AS node, n_name AS needs FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION SELECT s_name, 'acct' || (s_suppkey % 7) FROM supplier)
SELECT node, string_agg(needs, ',' ORDER BY needs) AS missing FROM d WHERE needs NOT IN (SELECT n_name FROM nation WHERE n_regionkey < 3) AND needs NOT IN ('acct0', 'acct1') GROUP BY 1""")
def missing_variables(spark, sf):
    supplier, nation = table(spark, sf, "supplier"), table(spark, sf, "nation")
    deps = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("node"), F.col("n_name").alias("needs"))
    deps = deps.unionByName(supplier.select(F.col("s_name").alias("node"), F.concat(F.lit("acct"), F.col("s_suppkey") % 7).alias("needs")))
    known = nation.where("n_regionkey < 3").select(F.col("n_name").alias("name")).unionByName(spark.createDataFrame([("acct0",), ("acct1",)], "name string"))
    return resolve.missing_variables(deps, known)


@query("""
WITH d AS (SELECT c_nationkey AS name, max(c_acctbal) AS v FROM customer GROUP BY 1), r AS (SELECT s_nationkey AS name, s_acctbal AS v FROM supplier WHERE s_acctbal > 5000)
SELECT n_nationkey AS name, coalesce(d.v, r.v) AS value, CASE WHEN d.v IS NOT NULL THEN 'default' WHEN r.v IS NOT NULL THEN 'resolved' END AS origin
FROM nation LEFT JOIN d ON d.name = n_nationkey AND n_nationkey % 3 = 0 LEFT JOIN r ON r.name = n_nationkey AND d.v IS NULL""")
def gathered_choices(spark, sf):
    """Every third nation has a default; the others take what was resolved, one row a choice."""
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("name"))
    defaults = table(spark, sf, "customer").where("c_nationkey % 3 = 0").groupBy(F.col("c_nationkey").alias("name")).agg(F.max("c_acctbal").alias("value"))
    resolved = table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("name"), F.col("s_acctbal").alias("value"))
    return resolve.gather_choices(nation, defaults, resolved)


@query("""
SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'command' WHEN p_size % 3 = 0 THEN 'input' WHEN p_size % 5 > 0 THEN 'static' ELSE 'none' END AS kind FROM part""")
def variable_kinds(spark, sf):
    size = F.col("p_size")
    shown = table(spark, sf, "part").select(
        "p_partkey", F.when(size % 4 == 0, "ls").alias("from_command"), F.when(size % 3 == 0, "which?").alias("from_input"),
        F.when(size % 5 > 0, F.array("p_name")).otherwise(F.array().cast("array<string>")).alias("choices"),
    )
    return resolve.resolution_kind(shown).select("p_partkey", "kind")


@query("""
WITH f AS (SELECT DISTINCT 'get ' || p_name || ' at ' || p_size AS command FROM part WHERE p_partkey < 40 AND p_size > 0),
h AS (SELECT event_id AS seq, event_type AS command FROM events)
SELECT seq, command FROM h UNION ALL SELECT (SELECT max(seq) FROM h) + row_number() OVER (ORDER BY command), command FROM f""")
def history_after_a_run(spark, sf):
    """Every part below 40 is an alias with its size for a choice; the commands made are put at the end of the log."""
    part = table(spark, sf, "part").where("p_partkey < 40").select("p_name", "p_size").distinct()
    aliases = part.select(F.lit("p").alias("namespace"), F.concat_ws("-", "p_name", "p_size").alias("name"), F.concat(F.lit("get "), "p_name", F.lit(" at {{ s"), "p_size", F.lit(" }}")).alias("alias"))
    choices = part.select(F.lit("p").alias("namespace"), F.concat(F.lit("s"), "p_size").alias("name"), F.col("p_size").alias("value")).distinct()
    history = table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("command"))
    commands, log = resolve.run_alias(aliases, choices, history)
    return log


@query("""
WITH u AS (SELECT DISTINCT 'V' || p_size AS name FROM part) SELECT name FROM u WHERE name NOT IN (SELECT 'V' || n_nationkey FROM nation)""")
def unset_variables(spark, sf):
    commands = table(spark, sf, "part").select(F.concat(F.lit("echo ${V"), "p_size", F.lit("} | sort")).alias("c"))
    used = commands.select(F.explode(fx.env_vars(F.col("c"))).alias("name"))
    return resolve.unset_variables(used, table(spark, sf, "nation").select(F.concat(F.lit("V"), "n_nationkey").alias("name")))


@query("""
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN p_brand ELSE 'dflt' END AS namespace, p_name AS raw_name, 'cp {{ ' || p_brand || '::x }} {{ o::y }}' AS sanitized,
       'v=' || p_name || ';' || CASE WHEN p_size % 2 = 0 THEN 'one' ELSE '' END || '-' || p_size AS filled
FROM part""")
def identifiers(spark, sf):
    """Names split into namespace and name, placeholders qualified, environment names filled in."""
    size = F.col("p_size")
    raw = F.when(size % 3 == 0, F.concat(F.lit("::"), "p_name")).when(size % 3 == 1, F.concat("p_brand", F.lit("::"), "p_name", F.lit("::rest"))).otherwise(F.col("p_name"))
    part = table(spark, sf, "part")
    bare = F.replace(raw, F.lit(" "), F.lit("_"))
    found = fx.split_identifier(F.concat(F.lit("{{ "), bare, F.lit(" }}")), F.when(size % 3 == 2, "dflt"))
    env = F.create_map(F.lit("NAME"), F.col("p_name"), F.lit("A1"), F.when(size % 2 == 0, "one").otherwise(""), F.lit("N"), size.cast("string"))
    filled = fx.env_substitute(F.lit("v=$NAME;${A1}-${N}$GONE"), env)
    return part.select("p_partkey", found["namespace"].alias("namespace"), F.replace(found["name"], F.lit("_"), F.lit(" ")).alias("raw_name"), fx.qualify(F.lit("cp {{x}} {{ o::y }}"), F.col("p_brand")).alias("sanitized"), filled.alias("filled"))


@query("""
WITH s AS (SELECT p_partkey, p_name, lower(p_brand || ' ' || p_name) AS t FROM part), a AS (SELECT *, instr(t, 'b') AS i FROM s),
b AS (SELECT *, CASE WHEN i > 0 AND instr(t[i + 1:], 'l') > 0 THEN i + instr(t[i + 1:], 'l') END AS j FROM a),
c AS (SELECT *, CASE WHEN j IS NOT NULL AND instr(t[j + 1:], 't') > 0 THEN j + instr(t[j + 1:], 't') END AS k FROM b)
SELECT p_partkey, (300 - (k - i + 1))::INTEGER AS score FROM c WHERE k IS NOT NULL ORDER BY score DESC, p_partkey LIMIT 5""")
def suggestions(spark, sf):
    """The five best matches of a keyword."""
    score = fx.fuzzy_score(F.concat("p_brand", F.lit(" "), "p_name"), "blt")
    return table(spark, sf, "part").select("p_partkey", score.alias("score")).where("score is not null").orderBy(F.col("score").desc(), "p_partkey").limit(5)


@query("""
WITH l AS (SELECT user_id AS var, event_id AS seq, event_type AS t, value, epoch(ts)::BIGINT AS w FROM events WHERE event_id % 3 = 1),
c AS (SELECT max(seq) AS c FROM l WHERE t = 'signup' AND seq < 100),
s AS (SELECT var, max(seq) AS seq, arg_max(value, seq) AS choice, arg_max(w, seq) AS w FROM l, c WHERE t <> 'signup' AND (c IS NULL OR seq > c) GROUP BY var)
SELECT var, choice FROM s WHERE w + 86400 * 20 > (SELECT max(epoch(ts)::BIGINT) FROM events) AND var % 2 = 0""")
def session_choices(spark, sf):
    """What a session chose for each variable: events of every third id are its log, its early signups clear it."""
    events = table(spark, sf, "events")
    cleared = (F.col("event_type") == "signup") & (F.col("event_id") < 100)
    log = events.where("event_type <> 'signup' or event_id < 100").select(
        F.concat(F.lit("s"), F.col("event_id") % 3).alias("session"), F.col("event_id").alias("seq"), F.when(cleared, "clear").otherwise("set").alias("action"),
        F.col("user_id").alias("var"), F.col("value").alias("choice"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("when"),
    )
    now = F.lit(events.agg(F.max(F.unix_seconds(F.col("ts").cast("timestamp")))).first()[0])
    return state.session_choices(log, "s1", now, events.where("user_id % 2 = 0").select(F.col("user_id").alias("var")).distinct(), 86_400 * 20)


@query("""
WITH l AS (SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS t, arg_max(value, event_id) AS value, arg_max(epoch(ts)::BIGINT, event_id) AS w FROM events GROUP BY 1),
m AS (SELECT max(epoch(ts)::BIGINT) AS now FROM events)
SELECT user_id, event_id, value, CASE WHEN user_id % 10 = 0 THEN 'taken' ELSE 'kept' END AS state FROM l, m
WHERE t <> 'error' AND (user_id % 10 > 0 OR w + 864000 > now)""")
def ttl_map_after_deletes(spark, sf):
    """All entries that stay, expired or not, and those taken out by a deletion that were still valid; errors are deletions of the log itself."""
    events = table(spark, sf, "events").select("user_id", "event_id", "value", (F.col("event_type") == "error").alias("gone"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("when"))
    now = F.lit(events.agg(F.max("when")).first()[0])
    entries = state.ttl_entries(events, ["user_id"], "event_id", "gone")
    stay, taken = state.ttl_delete(entries, entries.where("user_id % 10 = 0"), ["user_id"], "event_id", "when", now, 864_000)
    show = lambda df, mark: df.select("user_id", "event_id", "value", F.lit(mark).alias("state"))
    return show(stay, "kept").unionByName(show(taken, "taken"))


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 1 OFFSET 2")
def rerun_entry(spark, sf):
    return state.rerun(table(spark, sf, "events").select("event_id", "event_type"), "event_id", 3)


@query("SELECT p_brand AS name, count(*) + 1 AS index FROM part GROUP BY 1")
def next_window_index(spark, sf):
    return state.next_index(table(spark, sf, "part").select(F.col("p_brand").alias("name")), "name")
