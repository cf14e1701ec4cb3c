"""Named queries over the driver's tables and the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text as fx
from lodestone.functions.templates import expand
from lodestone.operators import graphs, groups, joins, linediff, review, setjoin, similarity, state
from lodestone.plans.registry import ORACLES, QUERIES, query  # noqa: F401
from lodestone.sources.tables import table

def _days(ts: Column) -> Column:
    return F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date"))


@query("""
SELECT sha256(regexp_replace(lower(text), '[a-z0-9]+', 'w', 'g')) AS signature, count(*) AS members, count(DISTINCT source) AS files,
       count(DISTINCT source) > 1 AS cross_file
FROM documents GROUP BY 1 HAVING count(*) >= 2""")
def clone_groups(spark, sf):
    shape = F.regexp_replace(F.lower("text"), "[a-z0-9]+", "w")
    return groups.signature_groups(table(spark, sf, "documents"), shape, "source").drop("all_test")


@query("""
WITH g AS (SELECT sha256(regexp_replace(lower(text), '[a-z0-9]+', 'w', 'g')) AS signature, count(DISTINCT source) > 1 AS cross_file
           FROM documents GROUP BY 1 HAVING count(*) >= 2)
SELECT signature, cross_file, row_number() OVER (ORDER BY cross_file DESC, signature) AS rank FROM g""")
def ranked_symptoms(spark, sf):
    found = clone_groups(spark, sf).select("signature", "cross_file")
    return state.ranked(found, [F.col("cross_file").desc(), F.col("signature")])


@query("""
SELECT l_orderkey, l_linenumber, l_extendedprice, l_shipdate, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) AS rank FROM lineitem""")
def ranked_lines(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity")
    return state.ranked(lines, [F.col("l_extendedprice").desc(), *[F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")]]).drop("l_partkey", "l_suppkey", "l_quantity")


@query("""
WITH s AS (SELECT l_orderkey, list_sort(list_distinct(list(p_brand))) AS items FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT array_to_string(items, ',') AS items, len(items)::INTEGER AS n_items, count(*) AS owners, min(l_orderkey) AS first_owner
FROM s WHERE len(items) >= 3 GROUP BY s.items HAVING count(*) >= 3""")
def set_clumps(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return groups.exact_set_groups(rows, "l_orderkey", F.col("p_brand")).withColumn("items", F.array_join("items", ","))


_WORDS = "SELECT DISTINCT doc_id, w AS word FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \t\r\n]+')) AS w FROM documents) WHERE w <> ''"
_SETS = f"""WITH f AS ({_WORDS}), s AS (SELECT doc_id, list_sort(list(word)) AS items, count(*) AS n FROM f GROUP BY 1 HAVING count(*) >= 4),
c AS (SELECT items, min(doc_id) AS rep, min(n) AS n FROM s GROUP BY items)"""


def _word_sets(spark, sf):
    words = F.array_remove(F.array_distinct(F.split("text", "[ \\t\\r\\n]+")), "")
    return similarity.array_sets(table(spark, sf, "documents"), "doc_id", words)


@query(_SETS + """, x AS (SELECT rep, n, unnest(items) AS word FROM c)
SELECT a.rep AS a, b.rep AS b, count(*)::INTEGER AS shared, (a.n + b.n - count(*))::INTEGER AS total,
       floor(count(*) * 100.0 / (a.n + b.n - count(*)) + 0.5)::INTEGER AS percent
FROM x a JOIN x b ON a.word = b.word AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n
HAVING count(*) >= 4 AND count(*) >= 0.7 * (a.n + b.n - count(*)) - 1e-9""")
def near_dup_docs(spark, sf):
    pairs = setjoin.set_pairs(_word_sets(spark, sf))
    return pairs.withColumn("percent", similarity.overlap_percent(F.col("shared"), F.col("total")))


@query(_SETS + " SELECT s.doc_id AS owner, c.rep FROM s JOIN c ON s.items = c.items")
def near_dup_members(spark, sf):
    return setjoin.set_members(_word_sets(spark, sf))


@query("""
SELECT c_custkey, count(o_orderkey) AS refs, CASE WHEN count(o_orderkey) = 0 THEN 'dead' ELSE 'test_only' END AS kind
FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') ON c_custkey = o_custkey
GROUP BY 1 HAVING count(o_orderkey) = 0 OR bool_and(o_orderstatus = 'F')""")
def unreferenced_customers(spark, sf):
    refs = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").withColumnRenamed("o_custkey", "c_custkey")
    return joins.classify_references(table(spark, sf, "customer").select("c_custkey"), refs, "c_custkey", F.col("o_orderstatus") == "F")


@query("""
SELECT user_id, strftime(ts, '%Y-%m-%d') AS day FROM events GROUP BY 1, 2
HAVING count(*) FILTER (WHERE event_type <> 'error') = 1 AND count(*) FILTER (WHERE event_type = 'error') = 0""")
def single_production_day(spark, sf):
    events = table(spark, sf, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return groups.sole_production(events, ["user_id", "day"], F.col("event_type") == "error")


@query("SELECT p_brand AS key, count(*) AS sites, count(DISTINCT p_type) AS files FROM part GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT p_type) >= 2")
def type_spread(spark, sf):
    return groups.dispatch_spread(table(spark, sf, "part"), "p_brand", "p_type")


@query("SELECT p_name AS name, count(DISTINCT p_brand) AS versions FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def ambiguous_part_names(spark, sf):
    return groups.ambiguous(table(spark, sf, "part"), "p_name", "p_brand")


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled_documents(spark, sf):
    return joins.baseline_filter(table(spark, sf, "documents").select("doc_id", "lang", "source"), table(spark, sf, "labels"), "doc_id")


@query("""
SELECT doc_id, quality AS decision FROM labels
UNION ALL SELECT doc_id, 0 AS decision FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def unlabelled_as_zero(spark, sf):
    labels = table(spark, sf, "labels")
    rest = joins.baseline_filter(table(spark, sf, "documents").select("doc_id"), labels, "doc_id")
    return labels.select("doc_id", F.col("quality").alias("decision")).unionByName(rest.withColumn("decision", F.lit(0)))


@query("SELECT doc_id, 'clones:' || sha256('clones' || text) AS symptom FROM documents")
def symptom_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", fx.content_id(F.lit("clones"), F.col("text")).alias("symptom"))


@query("SELECT doc_id, sha256(replace(text, chr(13) || chr(10), chr(10))) AS hash FROM documents")
def file_hashes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", fx.file_hash(F.col("text")).alias("hash"))


@query("""
WITH w AS (SELECT o_orderkey, o_custkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS d FROM orders)
SELECT a.o_orderkey AS l_o_orderkey, b.o_orderkey AS r_o_orderkey FROM w a JOIN w b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey
WHERE a.d - 15 <= b.d + 15 AND b.d - 15 <= a.d + 15""")
def order_window_overlap(spark, sf):
    day = _days(F.col("o_orderdate"))
    spans = table(spark, sf, "orders").select("o_orderkey", "o_custkey", (day - 15).alias("s"), (day + 15).alias("e"))
    return joins.interval_overlap(spans, spans, "o_custkey", "s", "e", 31).where("l_o_orderkey < r_o_orderkey").select("l_o_orderkey", "r_o_orderkey")


@query("""
WITH p AS (SELECT event_id, event_type AS k, date_diff('day', DATE '1970-01-01', ts::DATE) AS d FROM events),
x AS (SELECT DISTINCT k, d FROM p), r AS (SELECT k, d AS s, d + 2 + d % 3 AS e, k || '-' || d AS name FROM x WHERE d % 4 = 0)
SELECT p.event_id, p.k, p.d, min(struct_pack(w := r.e - r.s, name := r.name)).name AS container
FROM p LEFT JOIN r ON p.k = r.k AND p.d BETWEEN r.s AND r.e GROUP BY 1, 2, 3""")
def event_in_window(spark, sf):
    points = table(spark, sf, "events").select("event_id", F.col("event_type").alias("k"), _days(F.col("ts")).cast("bigint").alias("d"))
    ranges = points.select("k", "d").distinct().where("d % 4 = 0").select("k", F.col("d").alias("s"), (F.col("d") + 2 + F.col("d") % 3).alias("e"), F.concat("k", F.lit("-"), F.col("d").cast("string")).alias("name"))
    return joins.smallest_container(points, ranges, "k", "d", "s", "e", 8, "name")


@query("""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text <> '')
SELECT doc_id, i AS line_no, parts[i] AS content FROM l, LATERAL (SELECT unnest(generate_series(1, len(parts) - (CASE WHEN parts[len(parts)] = '' THEN 1 ELSE 0 END)))::INTEGER AS i)""")
def document_lines(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(fx.lines(F.col("text"))).alias("line_no", "content"))
    return rows.withColumn("line_no", F.col("line_no") + 1)


@query("""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
t AS (SELECT doc_id, CASE WHEN parts[len(parts)] = '' THEN parts[1:len(parts) - 1] ELSE parts END AS parts FROM l)
SELECT doc_id, CASE WHEN len(parts) >= 3 THEN array_to_string(parts[2:3], chr(10)) END AS snapshot FROM t""")
def content_snapshots(spark, sf):
    return table(spark, sf, "documents").select("doc_id", fx.line_slice(F.col("text"), F.lit(2), F.lit(3)).alias("snapshot"))


@query("""
SELECT l_orderkey, count(*) AS total, count(*) FILTER (WHERE l_linestatus = 'F') AS approved,
       round(count(*) FILTER (WHERE l_linestatus = 'F') * 100.0::DOUBLE / count(*), 2) AS percent, bool_and(l_linestatus = 'F') AS complete
FROM lineitem GROUP BY 1""")
def order_completion(spark, sf):
    return state.approval_rollup(table(spark, sf, "lineitem"), "l_orderkey", F.col("l_linestatus") == "F")


@query("""
WITH c AS (SELECT conv_id, turn, text, role FROM conversations),
r AS (SELECT conv_id, role, min(turn) AS t FROM c GROUP BY 1, 2)
SELECT conv_id, (SELECT string_agg(text, chr(10) ORDER BY turn, text) FROM c x WHERE x.conv_id = c.conv_id) AS note,
       (SELECT string_agg(role, ',' ORDER BY t) FROM r WHERE r.conv_id = c.conv_id) AS authors, count(*) AS n
FROM c GROUP BY conv_id""")
def conversation_transcript(spark, sf):
    return state.fold_notes(table(spark, sf, "conversations"), "conv_id", "turn", "text", "role")


@query("SELECT conv_id, count(DISTINCT turn) AS depth FROM (SELECT conv_id, turn, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p FROM conversations) WHERE turn = p GROUP BY 1")
def conversation_depth(spark, sf):
    return graphs.chain_depth(table(spark, sf, "conversations"), "conv_id", "turn")


@query("""
WITH l AS (SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value, arg_max(ts, event_id) AS ts FROM events GROUP BY 1, 2)
SELECT user_id, event_type, event_id, value FROM l WHERE epoch(ts)::BIGINT + 864000 > (SELECT max(epoch(ts)::BIGINT) FROM events)""")
def latest_event_value(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_type", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("when"), "value")
    latest = state.latest_per_key(events, ["user_id", "event_type"], "event_id")
    now = events.agg(F.max("when").alias("_now"))
    return state.valid_at(latest.crossJoin(F.broadcast(now)), "when", F.col("_now"), 864_000).select("user_id", "event_type", "event_id", "value")


@query("SELECT event_id, user_id, event_type, value FROM events ORDER BY event_id DESC LIMIT 1000")
def last_events(spark, sf):
    return state.last_n(table(spark, sf, "events").select("event_id", "user_id", "event_type", "value"), "event_id", 1000)


@query("SELECT event_id, user_id, value FROM events WHERE value >= 2")
def admitted_events(spark, sf):
    return state.admitted(table(spark, sf, "events").select("event_id", "user_id", "value"), "value", 2.0)


@query("""
WITH h AS (SELECT s_nationkey AS nation, count(*) AS n FROM supplier GROUP BY 1), l AS (SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1)
SELECT coalesce(h.nation, l.nation) AS nation, coalesce(h.n, l.n) AS n FROM h FULL JOIN l ON h.nation = l.nation""")
def nation_defaults(spark, sf):
    high = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"))
    low = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"))
    return joins.precedence_merge(high, low, "nation", "n")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def missing_dependencies(spark, sf):
    known = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.missing(table(spark, sf, "customer"), known, "c_custkey")


@query("""
SELECT n_name, 'list ' || p_type || ' for ' || n_name AS command FROM nation, (SELECT DISTINCT p_type FROM part)""")
def template_expansion(spark, sf):
    start = table(spark, sf, "nation").select("n_name", F.concat(F.lit("list {{ part::type }} for "), F.col("n_name")).alias("t"))
    return expand(start, "t", {"part::type": table(spark, sf, "part").select("p_type")}).select("n_name", "command")


@query("""
SELECT event_id, array_to_string(regexp_extract_all(props, '"([A-Za-z_]+)":', 1), ',') AS keys FROM events""")
def props_keys(spark, sf):
    return table(spark, sf, "events").select("event_id", F.array_join(F.regexp_extract_all("props", F.lit('"([A-Za-z_]+)":'), 1), ",").alias("keys"))


@query("""
WITH t AS (SELECT p_partkey, 'cut {{ ' || p_brand[7:] || ' }} > $OUT && echo {{p::' || p_size || '}} | sort $' || '{TMP}' AS t FROM part)
SELECT p_partkey, array_to_string(regexp_extract_all(t, '\\{\\{ ?([A-Za-z0-9_:]+) ?\\}\\}', 1), ',') AS names, 'OUT,TMP' AS vars, 'cut,echo,sort' AS programs FROM t""")
def template_names(spark, sf):
    t = F.concat(F.lit("cut {{ "), F.substr("p_brand", F.lit(7)), F.lit(" }} > $OUT && echo {{p::"), F.col("p_size").cast("string"), F.lit("}} | sort ${TMP}"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(fx.placeholders(t), ",").alias("names"), F.array_join(fx.env_vars(t), ",").alias("vars"), F.array_join(fx.programs_used(t), ",").alias("programs"))


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)b.*l.*t')")
def fuzzy_parts(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_name").where(fx.subsequence(F.col("p_name"), "blt"))


_ENDINGS = ["rs", "py", "go", "ts", "tsx", "js", "jsx", "java", "c", "h", "cpp", "cc", "cxx", "hpp", "RS", "md", "tar.Py", "none."]


@query(f"""
WITH f AS (SELECT p_partkey, 'src/' || p_name || '.' || ({_ENDINGS})[p_size % 18 + 1] AS path FROM part)
SELECT p_partkey, CASE WHEN e = 'rs' THEN 'Rust' WHEN e = 'py' THEN 'Python' WHEN e = 'go' THEN 'Go' WHEN e IN ('ts', 'tsx') THEN 'TypeScript' WHEN e IN ('js', 'jsx') THEN 'JavaScript'
       WHEN e = 'java' THEN 'Java' WHEN e IN ('c', 'h') THEN 'C' WHEN e IN ('cpp', 'cc', 'cxx', 'hpp') THEN 'Cpp' ELSE 'Unknown' END AS language
FROM (SELECT p_partkey, lower(list_last(string_split(path, '.'))) AS e FROM f)""")
def file_languages(spark, sf):
    ending = F.element_at(F.array(*[F.lit(e) for e in _ENDINGS]), (F.col("p_size") % 18 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", fx.language_of(F.concat(F.lit("src/"), "p_name", F.lit("."), ending)).alias("language"))


@query("""
WITH o AS (SELECT o_orderkey, o_orderstatus AS status FROM orders WHERE o_orderkey % 10 <> 3),
n AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_totalprice > 300000 THEN 'F' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 10 <> 7)
SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'added' WHEN n.o_orderkey IS NULL THEN 'deleted' ELSE 'modified' END AS change
FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey WHERE o.o_orderkey IS NULL OR n.o_orderkey IS NULL OR o.status <> n.status""")
def status_changes(spark, sf):
    # two snapshots of one table: each lacks some orders of the other, and large open orders close in between
    orders = table(spark, sf, "orders")
    old = orders.where("o_orderkey % 10 <> 3").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    closed = (F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 300000)
    new = orders.where("o_orderkey % 10 <> 7").select("o_orderkey", F.when(closed, "F").otherwise(F.col("o_orderstatus")).alias("status"))
    return joins.version_diff(old, new, "o_orderkey", ["status"])


@query("""
SELECT e.event_id, e.user_id, e.ts, (SELECT x.value FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'purchase' AND x.ts <= e.ts ORDER BY x.ts DESC, x.value DESC LIMIT 1) AS last_purchase
FROM events e WHERE e.event_type = 'error'""")
def purchase_before_error(spark, sf):
    events = table(spark, sf, "events")
    bought = events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return joins.nearest_before(events.where("event_type = 'error'").select("event_id", "user_id", "ts"), bought, "user_id", "ts", "value", "last_purchase")


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT n_name AS src, r_name AS dst FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION SELECT DISTINCT r_name, 'world' FROM region UNION SELECT DISTINCT c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src)
SELECT src, dst FROM c""")
def segment_closure(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    a = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("src"), F.col("r_name").alias("dst"))
    b = region.select(F.col("r_name").alias("src"), F.lit("world").alias("dst"))
    c = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("src"), F.col("n_name").alias("dst"))
    return graphs.closure(a.unionByName(b).unionByName(c), "src", "dst")


def _blast_radius(lines):
    """Suppliers call the parts of their lines; a returned line refers to its part from outside."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    calls = lines.select(name("s", "l_suppkey").alias("caller"), name("p", "l_partkey").alias("callee"))
    refs = lines.where("l_returnflag = 'R'").select(name("p", "l_partkey").alias("item"), F.lit("returns").alias("path"), F.lit("parts").alias("home"))
    return graphs.blast_radius(calls, refs, "item")


@query("""
WITH c AS (SELECT DISTINCT 's' || l_suppkey AS caller, 'p' || l_partkey AS callee FROM lineitem),
r AS (SELECT 'p' || l_partkey AS item FROM lineitem WHERE l_returnflag = 'R'),
i AS (SELECT caller AS item FROM c UNION SELECT callee FROM c UNION SELECT item FROM r),
a AS (SELECT callee AS item, count(*) AS callers FROM c GROUP BY 1), b AS (SELECT caller AS item, count(*) AS callees FROM c GROUP BY 1), o AS (SELECT item, count(*) AS outside_refs FROM r GROUP BY 1)
SELECT item, coalesce(callers, 0) AS callers, coalesce(callees, 0) AS callees, coalesce(outside_refs, 0) AS outside_refs,
       coalesce(callers, 0) + coalesce(callees, 0) + coalesce(outside_refs, 0) AS total
FROM i LEFT JOIN a USING (item) LEFT JOIN b USING (item) LEFT JOIN o USING (item)""")
def part_blast_radius(spark, sf):
    """Callers, callees and returns of every supplier and part of the whole table."""
    return _blast_radius(table(spark, sf, "lineitem"))


@query()
def turn_diff(spark, sf):
    """Line diff of every turn of a conversation against the one before it."""
    w = W.partitionBy("conv_id").orderBy("turn", "text")
    pairs = table(spark, sf, "conversations").select("conv_id", "turn", F.lag("text").over(w).alias("old"), F.col("text").alias("new"))
    return linediff.diff_stats(pairs, "old", "new").select("conv_id", "turn", "kept", "deleted", "added", "modified")


_REVIEW = """WITH chunks AS (SELECT p_partkey AS chunk, p_brand AS file, p_size::BIGINT AS s, p_size::BIGINT + 2 AS e FROM part),
impacts AS (SELECT s_suppkey + 1 AS decision, 'Brand#' || (s_suppkey % 25 + 1) AS file, s_suppkey % 40 AS s, s_suppkey % 40 + 6 AS e FROM supplier),
met AS (SELECT DISTINCT chunk, decision FROM chunks c JOIN impacts i USING (file) WHERE c.s <= i.e AND i.s <= c.e),
idx AS (SELECT * FROM met UNION ALL SELECT chunk, 0 FROM chunks WHERE chunk NOT IN (SELECT chunk FROM met)),
ev AS (SELECT event_id AS seq, event_type AS t, event_id * 7 % (SELECT count(*) FROM part) AS chunk, user_id % (SELECT count(*) FROM supplier) + 1 AS decision, 'Brand#' || (user_id % 25 + 1) AS file, 'u' || user_id AS who FROM events),
touch AS (SELECT chunk, seq, t = 'view' AS approved, TRUE AS own, who FROM ev WHERE t IN ('view', 'purchase') AND chunk IN (SELECT chunk FROM chunks)
  UNION ALL SELECT i.chunk, seq, t = 'signup', FALSE, who FROM ev JOIN idx i USING (decision) WHERE t IN ('signup', 'error')
  UNION ALL SELECT c.chunk, seq, TRUE, FALSE, who FROM ev JOIN chunks c USING (file) WHERE t = 'click')
"""


def _review(spark, sf):
    """Parts as chunks of their brand's file, suppliers as decisions, events as the log of a review."""
    number = lambda c: F.col(c).cast("bigint")
    chunks = table(spark, sf, "part").select(number("p_partkey").alias("chunk"), F.col("p_brand").alias("file"), number("p_size").alias("start"), (number("p_size") + 2).alias("end"))
    at = F.col("s_suppkey") % 40
    impacts = table(spark, sf, "supplier").select((F.col("s_suppkey") + 1).alias("decision"), F.concat(F.lit("Brand#"), F.col("s_suppkey") % 25 + 1).alias("file"), at.alias("start"), (at + 6).alias("end"))
    actions = {"view": "approve", "purchase": "reject", "signup": "approve_decision", "error": "reject_decision", "click": "approve_file"}
    action = F.element_at(F.create_map(*[F.lit(x) for pair in actions.items() for x in pair]), F.col("event_type"))
    user = F.col("user_id")
    # chunks and decisions of the log cover the keys of part and supplier, which count from 0
    sizes = table(spark, sf, "part").agg(F.count(F.lit(1)).alias("parts")).crossJoin(table(spark, sf, "supplier").agg(F.count(F.lit(1)).alias("suppliers")))
    events = table(spark, sf, "events").crossJoin(F.broadcast(sizes)).select(F.col("event_id").alias("seq"), action.alias("action"), (F.col("event_id") * 7 % F.col("parts")).alias("chunk"), (user % F.col("suppliers") + 1).alias("decision"), F.concat(F.lit("Brand#"), user % 25 + 1).alias("file"), F.concat(F.lit("u"), user).alias("by"))
    return chunks, impacts, events, review.decision_index(chunks, impacts)


@query(_REVIEW + "SELECT chunk, decision FROM idx")
def decision_index(spark, sf):
    return _review(spark, sf)[3]


@query(_REVIEW + 'SELECT chunk, arg_max(who, seq) AS "by" FROM touch GROUP BY chunk HAVING arg_max(approved, seq)')
def approved_chunks(spark, sf):
    chunks, _, events, index = _review(spark, sf)
    return review.approvals(chunks, index, events)[0]


@query(_REVIEW + """, need AS (SELECT DISTINCT i.decision, t.seq, t.who FROM touch t JOIN idx i USING (chunk) WHERE own AND approved),
pairs AS (SELECT n.decision, n.seq, n.who, i.chunk FROM need n JOIN idx i USING (decision)),
whole AS (SELECT p.decision, p.seq, p.who FROM pairs p ASOF LEFT JOIN touch a ON a.chunk = p.chunk AND p.seq >= a.seq
          GROUP BY ALL HAVING bool_and(coalesce(a.approved, FALSE))),
off AS (SELECT decision, max(seq) AS gone FROM (SELECT i.decision, t.seq FROM touch t JOIN idx i USING (chunk) WHERE own AND NOT approved
        UNION ALL SELECT decision, seq FROM ev WHERE t = 'error') GROUP BY 1),
marks AS (SELECT decision, seq, who, 1 AS direct FROM ev WHERE t = 'signup' UNION ALL SELECT decision, seq, who, 0 FROM whole)
SELECT decision, coalesce(arg_max(who, seq) FILTER (direct = 1), arg_min(who, seq)) AS "by" FROM marks LEFT JOIN off USING (decision)
WHERE gone IS NULL OR seq > gone GROUP BY decision""")
def approved_decisions(spark, sf):
    chunks, impacts, events, _ = _review(spark, sf)
    return review.approved_decisions(chunks, impacts, events)


@query(_REVIEW + """, firsts AS (SELECT chunk, count(*) FILTER (approved) > 0 AS noted FROM touch WHERE own GROUP BY chunk),
done AS (SELECT chunk FROM touch GROUP BY chunk HAVING arg_max(approved, seq))
SELECT count(*) AS total, count(d.chunk) AS approved, round(count(d.chunk) * 100.0::DOUBLE / count(*), 2) AS percent, count(*) FILTER (noted) AS with_notes
FROM chunks c LEFT JOIN done d USING (chunk) LEFT JOIN firsts USING (chunk)""")
def review_statistics(spark, sf):
    chunks, _, events, index = _review(spark, sf)
    return review.review_statistics(chunks, review.approvals(chunks, index, events)[0], events.where("action = 'approve'"))


@query(_REVIEW + """SELECT decision, file, CASE WHEN chunk IS NOT NULL THEN row_number() OVER (PARTITION BY decision, file ORDER BY s, e, chunk) END::INTEGER AS position, chunk
FROM (SELECT decision FROM impacts UNION SELECT decision FROM idx) LEFT JOIN (SELECT * FROM idx JOIN chunks USING (chunk)) USING (decision)""")
def drill_index(spark, sf):
    chunks, impacts, _, _ = _review(spark, sf)
    return review.drill_index(impacts, chunks)


@query("""
WITH ev AS (SELECT user_id AS k, event_id AS seq, CASE WHEN event_type = 'error' THEN 'remove' WHEN event_type = 'signup' THEN 'edit' ELSE 'add' END AS action,
            event_type || event_id AS content, event_type AS author, ts::VARCHAR AS timestamp FROM events),
g AS (SELECT k, max(seq) FILTER (action = 'remove') AS gone, max(seq) FILTER (action = 'edit') AS edited FROM ev GROUP BY k),
live AS (SELECT * FROM ev JOIN g USING (k) WHERE action <> 'remove' AND (gone IS NULL OR seq > gone)),
firsts AS (SELECT k, author, min(seq) AS began FROM live GROUP BY 1, 2),
who AS (SELECT k, string_agg(author, ', ' ORDER BY began) AS authors FROM firsts GROUP BY k)
SELECT k, string_agg(content, chr(10) ORDER BY seq) FILTER (edited IS NULL OR seq >= edited) AS content, any_value(authors) AS authors, max(seq) AS last_seq
FROM live JOIN who USING (k) GROUP BY k""")
def folded_instructions(spark, sf):
    action = F.when(F.col("event_type") == "error", "remove").when(F.col("event_type") == "signup", "edit").otherwise("add")
    events = table(spark, sf, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("seq"), action.alias("action"), F.concat("event_type", "event_id").alias("content"), F.col("event_type").alias("author"), F.col("event_id").alias("timestamp"))
    return review.fold_instructions(events, "k").withColumnRenamed("timestamp", "last_seq")


@query("""
WITH inc AS (SELECT event_id AS seq, user_id AS k, CASE WHEN event_type <> 'error' THEN event_type ELSE '' END AS content FROM events),
firsts AS (SELECT k, min(seq) AS f FROM inc WHERE content <> '' AND k NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey < 40) GROUP BY k)
SELECT seq, k, content, CASE WHEN content = '' THEN 'empty' WHEN f = seq THEN 'imported' ELSE 'duplicate' END AS outcome FROM inc LEFT JOIN firsts USING (k)""")
def imported_instructions(spark, sf):
    incoming = table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("k"), F.when(F.col("event_type") != "error", F.col("event_type")).otherwise("").alias("content"))
    existing = table(spark, sf, "supplier").where("s_suppkey < 40").select(F.col("s_suppkey").alias("k"))
    return review.import_outcomes(incoming, existing, ["k"], "seq", "content")


from lodestone.plans import alias_queries, detector_queries, text_queries  # noqa: E402, F401  (they register their queries)
