"""Names, lists, routes, patterns, identifiers: over customers, suppliers, parts, orders, pages and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays, dates, fuzzy, jsonx, strings, values
from ..operators import evidence, grounding, joins, metadata, validation
from ..sources import dimensions
from .base import query, table

SUFFIX = ["Sdn. Bhd.", "Berhad", "SDN BHD", "Enterprise", "&amp; Co"]
NAMES_SQL = """s AS (SELECT s_suppkey, s_name || ' ' || ['Sdn. Bhd.', 'Berhad', 'SDN BHD', 'Enterprise', '&amp; Co'][s_suppkey % 5 + 1] AS raw, lower(replace(s_name, '#', ' ')) || CASE WHEN s_suppkey % 5 = 4 THEN ' co' ELSE '' END AS norm FROM supplier)"""


def _suppliers(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    raw = F.concat_ws(" ", "s_name", F.element_at(F.array(*map(F.lit, SUFFIX)), (F.col("s_suppkey") % 5 + 1).cast("int")))
    return s.select("s_suppkey", raw.alias("raw"), strings.company_name(raw).alias("norm"))


@query(f"WITH {NAMES_SQL} SELECT s_suppkey, raw, norm FROM s")
def name_normalise(spark, sf_dir):
    return _suppliers(spark, sf_dir)


@query(f"""WITH {NAMES_SQL}, q AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'supplier ' || printf('%09d', c_custkey % 120) WHEN 1 THEN 'supplier ' || printf('%09d', c_custkey % 120) || ' trading' WHEN 2 THEN 'supplier 0000000' ELSE 'zzz' END AS name FROM customer),
k AS (SELECT *, s_suppkey AS ord FROM (SELECT s_suppkey, regexp_replace(norm, ' co$', '') AS n FROM s)),
x AS (SELECT q.c_custkey, q.name, arg_min(k.s_suppkey, k.ord) AS e FROM q LEFT JOIN k ON k.n = q.name GROUP BY ALL),
p AS (SELECT x.c_custkey, arg_min(k.s_suppkey, k.ord) AS e FROM x JOIN k ON starts_with(x.name, k.n) OR starts_with(k.n, x.name) WHERE x.e IS NULL GROUP BY ALL)
SELECT x.c_custkey, x.name, coalesce(x.e, p.e) AS entry, CASE WHEN x.e IS NOT NULL THEN 'EXACT_MATCH' WHEN p.e IS NOT NULL THEN 'FUZZY_MATCH' END AS match FROM x LEFT JOIN p USING (c_custkey)""")
def whitelist_exact_prefix(spark, sf_dir):
    number = F.format_string("%09d", F.col("c_custkey") % 120)
    k = F.col("c_custkey") % 4
    name = F.when(k == 0, F.concat(F.lit("supplier "), number)).when(k == 1, F.concat(F.lit("supplier "), number, F.lit(" trading"))).when(k == 2, F.lit("supplier 0000000")).otherwise(F.lit("zzz"))
    names = _suppliers(spark, sf_dir).select(F.regexp_replace("norm", " co$", "").alias("normalized_name"), F.col("s_suppkey").alias("entry"), F.col("s_suppkey").alias("ord"))
    return joins.name_lookup(table(spark, sf_dir, "customer").select("c_custkey", name.alias("name")), names)


@query("""WITH r AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS name FROM part), d AS (SELECT DISTINCT name FROM r), a AS (SELECT d.name, min(r_name) AS x FROM d JOIN region ON contains(lower(r_name), lower(d.name)) GROUP BY 1),
b AS (SELECT d.name, min(lower(n_name)) AS y FROM d JOIN nation ON contains(lower(n_name), lower(d.name)) OR contains(lower(d.name), lower(n_name)) GROUP BY 1)
SELECT p_partkey, name, CASE WHEN x IS NOT NULL THEN 'alert' WHEN y IS NOT NULL THEN 'listed' END AS outcome FROM (SELECT p_partkey, lower(name) AS name FROM r) JOIN (SELECT DISTINCT lower(name) AS name FROM d) USING (name) LEFT JOIN (SELECT lower(name) AS name, x FROM a) USING (name) LEFT JOIN (SELECT lower(name) AS name, y FROM b) USING (name)""")
def blacklist_containment(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lower(F.substring_index("p_name", " ", 1)).alias("name"))
    low = lambda t, c: table(spark, sf_dir, t).select(F.lower(c).alias("name"))
    return joins.listed(rows, low("region", "r_name"), low("nation", "n_name")).select("p_partkey", "name", "outcome")


TYPES = ["BANK", "WEBSITE", "VENDOR", "INVOICE", "PERSON", "OTHER"]
ROUTED = """t AS (SELECT c_custkey AS target_id, ['BANK', 'WEBSITE', 'VENDOR', 'INVOICE', 'PERSON', 'OTHER'][c_custkey % 6 + 1] AS entity_type, CASE WHEN c_custkey % 50 = 0 THEN 'manual' END AS o FROM customer),
r AS (SELECT target_id, entity_type, coalesce(o, CASE entity_type WHEN 'BANK' THEN 'bnm' WHEN 'WEBSITE' THEN 'whois' WHEN 'VENDOR' THEN 'whitelist' WHEN 'INVOICE' THEN 'enterprise' WHEN 'PERSON' THEN 'unverifiable' ELSE 'web_search' END) AS route FROM t)"""


def _targets(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("c_custkey") % 6 + 1).cast("int"))
    t = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("target_id"), kind.alias("entity_type"), F.when(F.col("c_custkey") % 50 == 0, F.lit("manual")).alias("o"))
    return t.select("target_id", "entity_type", grounding.route(F.col("entity_type"), F.col("o")).alias("route"))


@query(f"WITH {ROUTED} SELECT target_id, entity_type, route FROM r")
def route_targets(spark, sf_dir):
    return _targets(spark, sf_dir)


FELL = f"""WITH {ROUTED}, a AS (SELECT target_id, 'EXACT_MATCH' AS o FROM r WHERE target_id % 3 = 0), w AS (SELECT target_id, 'NOT_FOUND' AS o FROM r WHERE target_id % 2 = 0),
f AS (SELECT r.*, coalesce(a.o, w.o, 'UNVERIFIABLE') AS outcome, CASE WHEN a.o IS NOT NULL AND route = 'enterprise' THEN 'enterprise' WHEN a.o IS NULL AND w.o IS NOT NULL THEN 'web' ELSE 'deterministic' END AS stream FROM r LEFT JOIN a USING (target_id) LEFT JOIN w USING (target_id))"""


def _fallen(spark, sf_dir):
    t = _targets(spark, sf_dir)
    answers = t.filter("target_id % 3 = 0").select("target_id", F.lit("EXACT_MATCH").alias("outcome")).unionByName(t.filter("target_id % 3 = 1").select("target_id", F.lit("UNVERIFIABLE").alias("outcome")))
    return grounding.fallback(t, answers, t.filter("target_id % 2 = 0").select("target_id", F.lit("NOT_FOUND").alias("outcome")))


@query(f"{FELL} SELECT target_id, entity_type, route, outcome, stream FROM f")
def fallback_antijoin(spark, sf_dir):
    return _fallen(spark, sf_dir).select("target_id", "entity_type", "route", "outcome", "stream")


@query(f"""{FELL} SELECT route, stream, count(*) FILTER (outcome = 'EXACT_MATCH') AS n_exact_match, 0 AS n_fuzzy_match, 0 AS n_alert, count(*) FILTER (outcome = 'NOT_FOUND') AS n_not_found, count(*) FILTER (outcome = 'UNVERIFIABLE') AS n_unverifiable FROM f GROUP BY ALL""")
def outcome_counts(spark, sf_dir):
    return grounding.outcome_counts(_fallen(spark, sf_dir), ["route"])


@query("""WITH t AS (SELECT c_custkey AS key FROM customer), c AS (SELECT key, key % 4 = 0 AS found, 0 AS o, 'first' AS record FROM t WHERE key % 2 = 0 UNION ALL SELECT key, key % 6 = 0, 1, 'second' FROM t WHERE key % 3 = 0)
SELECT key, CASE WHEN arg_min(record, o) FILTER (found) IS NOT NULL THEN 'EXACT_MATCH' WHEN count(o) > 0 THEN 'NOT_FOUND' ELSE 'UNVERIFIABLE' END AS outcome, arg_min(record, o) FILTER (found) AS record FROM t LEFT JOIN c USING (key) GROUP BY key""")
def enterprise_lookup(spark, sf_dir):
    t = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    first = t.filter("key % 2 = 0").select("key", (F.col("key") % 4 == 0).alias("found"), F.lit("first").alias("record"))
    second = t.filter("key % 3 = 0").select("key", (F.col("key") % 6 == 0).alias("found"), F.lit("second").alias("record"))
    return grounding.enterprise(t, [first, second])


PATTERNS = [("alpha", "url", "(?i)example com", 1.0), ("alpha", "html", "(?i)\\bnav\\b", 0.5), ("beta", "url", " en ", 0.7), ("beta", "html", "\\bh1\\b", 0.3), ("gamma", "missing", "x", 1.0), ("gamma", "url", "page ", 1.0)]
PATTERNS_SQL = "p AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {d}::DOUBLE)" for a, b, c, d in PATTERNS) + ") t(producer, field, pattern, weight))"


@query(f"""WITH {PATTERNS_SQL}, v AS (SELECT page_id AS doc_id, 'url' AS field, url AS value FROM pages UNION ALL SELECT page_id, 'html', html FROM pages), w AS (SELECT producer, sum(weight) AS total FROM p GROUP BY 1)
SELECT doc_id, v2.producer, round(sum(weight) / any_value(total), 6) AS score FROM (SELECT v.doc_id, p.producer, p.weight FROM v JOIN p ON v.field = p.field AND regexp_matches(trim(regexp_replace(v.value, '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+', ' ', 'g')), p.pattern)) v2 JOIN w ON v2.producer = w.producer GROUP BY ALL""")
def fingerprint_score(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    v = pages.select(F.col("page_id").alias("doc_id"), F.explode(F.array(F.struct(F.lit("url").alias("field"), F.col("url").alias("value")), F.struct(F.lit("html").alias("field"), F.col("html").alias("value")))).alias("f")).select("doc_id", "f.*")
    patterns = spark.createDataFrame(PATTERNS, "producer string, field string, pattern string, weight double")
    return grounding.score_fingerprints(v, patterns).select("doc_id", "producer", F.round("score", 6).alias("score"))


@query("""WITH t(producer, document_type, level) AS (VALUES ('p0', 'building', 'low'), ('p1', 'machinery', 'high'), ('p2', 'building', 'medium'), ('p2', 'furniture', 'critical')), r AS (SELECT c_custkey, 'P' || (c_custkey % 4) AS producer, c_mktsegment AS document_type FROM customer)
SELECT c_custkey, coalesce(level, 'unknown') AS level, CASE WHEN lower(r.producer) NOT IN (SELECT producer FROM t) THEN 0.0 WHEN level = 'low' THEN 0.2 WHEN level = 'medium' THEN 0.5 WHEN level = 'high' THEN 0.75 WHEN level = 'critical' THEN 0.95 ELSE 0.3 END AS risk_score FROM r LEFT JOIN t ON lower(r.producer) = t.producer AND lower(r.document_type) = t.document_type""")
def producer_risk(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("P"), (F.col("c_custkey") % 4).cast("string")).alias("producer"), F.col("c_mktsegment").alias("document_type"))
    t = spark.createDataFrame([("p0", "BUILDING", "low"), ("p1", "MACHINERY", "high"), ("p2", "BUILDING", "medium"), ("p2", "FURNITURE", "critical")], "producer string, document_type string, level string")
    return grounding.risk(rows, t).select("c_custkey", "level", "risk_score")


@query("""WITH p AS (SELECT c_custkey, ['pdftex', 'luatex', 'canva_image', 'gimp', 'reportlab', 'nobody'][c_custkey % 6 + 1] AS producer, ['receipt', 'payslip', 'invoice', 'id_card', 'resume', 'photograph'][c_nationkey % 6 + 1] AS kind FROM customer),
t(producer, kind, level, score) AS (VALUES ('pdftex', 'receipt', 'medium', 0.5), ('pdftex', 'payslip', 'medium', 0.5), ('pdftex', 'invoice', 'low', 0.2), ('pdftex', 'resume', 'low', 0.2), ('luatex', 'receipt', 'medium', 0.5), ('luatex', 'payslip', 'medium', 0.5),
('luatex', 'invoice', 'low', 0.2), ('luatex', 'resume', 'low', 0.2), ('canva_image', 'id_card', 'critical', 0.95), ('canva_image', 'photograph', 'low', 0.2), ('gimp', 'photograph', 'low', 0.2),
('reportlab', 'receipt', 'critical', 0.95), ('reportlab', 'payslip', 'critical', 0.95), ('reportlab', 'invoice', 'critical', 0.95), ('reportlab', 'resume', 'medium', 0.5))
SELECT c_custkey, coalesce(level, 'unknown') AS level, coalesce(score, CASE WHEN p.producer = 'nobody' THEN 0.0 ELSE 0.3 END)::DOUBLE AS risk_score FROM p LEFT JOIN t USING (producer, kind)""")
def registry_risk(spark, sf_dir):
    """Risks by the registry's own table of producers and types of document."""
    names = F.array(*map(F.lit, ["pdfTeX", "LuaTeX", "canva_image", "gimp", "ReportLab", "nobody"]))
    kinds = F.array(*map(F.lit, ["RECEIPT", "PAYSLIP", "INVOICE", "ID_CARD", "RESUME", "PHOTOGRAPH"]))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.element_at(names, (F.col("c_custkey") % 6 + 1).cast("int")).alias("producer"), F.element_at(kinds, (F.col("c_nationkey") % 6 + 1).cast("int")).alias("document_type"))
    return grounding.risk(rows, dimensions.risks(spark)).select("c_custkey", "level", F.col("risk_score").cast("double").alias("risk_score"))


@query(r"""WITH u AS (SELECT page_id, regexp_extract(html, '(?i)pdf[eE]?TeX') <> '' AS tex, regexp_extract(html, '(?i)ReportLab') <> '' AS lab FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'made by pdfTeX-1.40' WHEN 1 THEN 'ReportLab PDF' ELSE 'none' END AS html FROM pages))
SELECT page_id AS doc_id, CASE WHEN tex THEN 'pdftex' ELSE 'reportlab' END AS best_producer FROM u WHERE tex OR lab""")
def registry_producers(spark, sf_dir):
    """The best producer by the registry's own fingerprints, of files that name a tool."""
    said = F.when(F.col("page_id") % 3 == 0, "made by pdfTeX-1.40").when(F.col("page_id") % 3 == 1, "ReportLab PDF").otherwise("none")
    fields = F.array(F.struct(F.lit("producer").alias("field"), said.alias("value")), F.struct(F.lit("title").alias("field"), F.lit("ReportLab").alias("value")))
    v = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.explode(fields).alias("f")).select("doc_id", "f.*")
    scored = grounding.score_fingerprints(v, dimensions.fingerprints(spark))
    return metadata.best_producers(scored).select("doc_id", "best_producer")


# ---- identifiers in lists


@query("""WITH i AS (SELECT DISTINCT l_orderkey % 500 AS k, l_partkey AS v FROM lineitem), r AS (SELECT *, v - row_number() OVER (PARTITION BY k ORDER BY v) AS g FROM i), s AS (SELECT k, min(v) AS a, max(v) AS b FROM r GROUP BY k, g)
SELECT k, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) AS ranges FROM s GROUP BY k""")
def compress_ids(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 500).alias("k")).agg(F.collect_set("l_partkey").alias("v"))
    return g.select("k", F.array_join(arrays.compress_ids(F.col("v")), ",").alias("ranges"))


@query("SELECT k, count(*) AS n, sum(v) AS total, min(v) AS least, max(v) AS most FROM (SELECT DISTINCT l_orderkey % 500 AS k, l_partkey AS v FROM lineitem) GROUP BY k")
def expand_ids(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 500).alias("k")).agg(F.collect_set("l_partkey").alias("v"))
    e = g.select("k", arrays.expand_ids(arrays.compress_ids(F.col("v"))).alias("e"))
    return e.select("k", F.size("e").alias("n"), F.aggregate("e", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_min("e").alias("least"), F.array_max("e").alias("most"))


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def antijoin_unused(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey").join(used, "p_partkey", "left_anti")


@query("""SELECT l_orderkey, string_agg(f, ',' ORDER BY f) AS missing FROM (SELECT k.l_orderkey, f FROM (SELECT DISTINCT l_orderkey FROM lineitem) k, (VALUES ('A'), ('N'), ('R')) t(f) EXCEPT SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem) GROUP BY 1""")
def except_chunks(spark, sf_dir):
    have = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("f"))
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, "ANR")), "f"))
    return have.filter(F.size(missing) > 0).select("l_orderkey", F.array_join(missing, ",").alias("missing"))


@query("""WITH e AS (SELECT c_custkey, unnest([c_custkey, c_custkey + 700, c_custkey + 1400]) AS i FROM customer), k AS (SELECT DISTINCT c_custkey AS i FROM customer)
SELECT c_custkey AS row_id, coalesce(string_agg(CASE WHEN k.i IS NOT NULL THEN e.i::VARCHAR END, ',' ORDER BY e.i), '') AS valid, coalesce(string_agg(CASE WHEN k.i IS NULL THEN e.i::VARCHAR END, ',' ORDER BY e.i), '') AS invalid FROM e LEFT JOIN k ON e.i = k.i GROUP BY 1""")
def valid_invalid_ids(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"), F.lit(0).alias("d"), F.array(F.col("c_custkey"), F.col("c_custkey") + 700, F.col("c_custkey") + 1400).alias("ids"))
    out = joins.split_known(c, "ids", c.select("d", "row_id"), ["d"], "row_id")
    return out.select("row_id", F.array_join("valid", ",").alias("valid"), F.array_join("invalid", ",").alias("invalid"))


@query("""WITH l AS (SELECT s_suppkey AS code, s_nationkey AS name FROM supplier), r AS (SELECT n_nationkey AS rid, n_nationkey * 3 AS code, n_nationkey AS name, n_name AS phone FROM nation), a AS (SELECT l.*, r1.phone AS p1, r1.rid AS i1, r2.phone AS p2, r2.rid AS i2 FROM l LEFT JOIN r r1 ON l.code = r1.code LEFT JOIN r r2 ON l.name = r2.name),
m AS (SELECT code, name, coalesce(p1, p2) AS phone, CASE WHEN i1 IS NOT NULL THEN i1 ELSE i2 END AS rid FROM a)
SELECT code, name, phone, rid FROM m UNION ALL SELECT code, name, phone, rid FROM r WHERE rid NOT IN (SELECT rid FROM m WHERE rid IS NOT NULL)""")
def merge_two_keys(spark, sf_dir):
    left = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_nationkey").alias("name"))
    n = table(spark, sf_dir, "nation")
    right = n.select(F.col("n_nationkey").alias("rid"), (F.col("n_nationkey") * 3).cast("long").alias("code"), F.col("n_nationkey").alias("name"), F.col("n_name").alias("phone"))
    return joins.merge_by_priority(left, right, ["code", "name"], ["phone"]).select("code", "name", "phone", "rid")


# ---- texts


@query(r"""SELECT doc_id, list_aggregate(list_filter(list_transform(regexp_extract_all(text, '\(?-?[0-9][0-9,]*(?:\.[0-9]+)?\)?'), lambda x: TRY_CAST(CASE WHEN x LIKE '(%)' THEN '-' ELSE '' END || regexp_replace(x, '[^0-9.\-]', '', 'g') AS DECIMAL(18,6))), lambda v: v IS NOT NULL), 'count') AS n,
CAST(coalesce(list_sum(list_filter(list_transform(regexp_extract_all(text, '\(?-?[0-9][0-9,]*(?:\.[0-9]+)?\)?'), lambda x: TRY_CAST(CASE WHEN x LIKE '(%)' THEN '-' ELSE '' END || regexp_replace(x, '[^0-9.\-]', '', 'g') AS DECIMAL(18,6))), lambda v: abs(v) < 100000)), 0) AS DECIMAL(18,6)) AS total FROM documents""")
def numeric_tokens(spark, sf_dir):
    t = values.numeric_tokens(F.col("text"))
    small = F.filter(t, lambda v: F.abs(v) < 100000)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.aggregate(small, F.lit("0").cast("decimal(28,6)"), lambda a, x: (a + x).cast("decimal(28,6)")).cast("decimal(18,6)").alias("total"))


@query()
def token_coverage(spark, sf_dir):
    """Each turn's text against the texts of the two turns before it in its conversation, by containment, then partial ratio."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-2, -1)
    c = joins.spread(table(spark, sf_dir, "conversations"), "conv_id").select("conv_id", "turn", "text", F.collect_list("text").over(w).alias("before"))
    share = fuzzy.token_coverage(F.col("text"), F.col("before"))
    return c.select("conv_id", "turn", F.round(share, 6).alias("share"), (share >= 0.8).alias("covered"))


@query()
def text_cross_validation(spark, sf_dir):
    """Targets, table cells and layout regions made of each conversation's turns, against the lines (the turns) that they cite: what the lines don't have.

    A target's value is the turn's last three words, its keys are the third word and a number; it cites the turn before. A cell has the turn's first four words and cites
    the turn itself, every third one nothing, so that its table's lines count. A region has the next turn's whole text, every second one its own.
    """
    c = joins.spread(table(spark, sf_dir, "conversations"), "conv_id").select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("int").alias("turn"), F.coalesce("text", F.lit("")).alias("text"))
    lines = c.select("doc_id", F.col("turn").alias("observation_id"), "text")
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    ids = lambda x: F.array(x.cast("int"))
    key = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    targets = c.select("doc_id", F.col("turn").alias("ord"), F.array_join(F.slice(F.reverse(words), 1, 3), " ").alias("value"), F.array(key("a", F.get(words, 2)), key("n", (F.col("turn") * 1111).cast("string"))).alias("keys"), ids(F.col("turn") - 1).alias("obs"))
    none = F.array().cast("array<int>")
    cells = c.select("doc_id", F.lit(0).alias("table_ord"), F.col("turn").alias("row_idx"), F.lit("DESC").alias("column"), F.array_join(F.slice(words, 1, 4), " ").alias("value"),
        F.when(F.col("turn") % 3 == 0, none).otherwise(ids(F.col("turn"))).alias("obs"), F.array(F.lit(0), F.lit(1)).alias("table_obs"))
    after = F.lead("text").over(Window.partitionBy("doc_id").orderBy("turn"))
    regions = c.select("doc_id", F.col("turn").alias("region_id"), F.lit(True).alias("is_text"), F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.coalesce(after, F.lit(""))).alias("text"))
    assigned = c.select("doc_id", F.col("turn").alias("observation_id"), F.when(F.col("turn") % 5 != 4, F.col("turn")).alias("region_id"))
    nothing = c.filter("false").select("doc_id", F.lit(1).alias("page"))
    found = validation.targets_against_lines(targets, lines).select("doc_id", F.concat_ws(".", F.lit("target"), "ord", "pos").alias("item"), "kind")
    found = found.unionByName(validation.cells_against_lines(cells, lines).select("doc_id", F.concat_ws(".", F.lit("cell"), "row_idx").alias("item"), "kind"))
    return found.unionByName(validation.structure_conflicts(lines, regions, assigned, nothing, nothing).select("doc_id", F.concat_ws(".", F.lit("page"), "item").alias("item"), "kind"))


@query(r"""WITH c AS (SELECT conv_id, turn, text, list(lower(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS t, regexp_extract_all(text, '[A-Za-z]+|[0-9]+(?:[.,][0-9]+)?') AS w FROM conversations)
SELECT conv_id, turn, CASE WHEN len(w) > 0 THEN round(len(list_filter(w, lambda y: len(list_filter(coalesce(t, []), lambda x: contains(x, lower(y)))) > 0)) / len(w)::DOUBLE, 6) END AS share FROM c""")
def contained_tokens(spark, sf_dir):
    """The same by containment alone, which decides most values without Python."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-2, -1)
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.collect_list("text").over(w).alias("before"))
    return c.select("conv_id", "turn", F.round(fuzzy.contained_share(F.col("text"), F.col("before")), 6).alias("share"))


@query(r"""WITH u AS (SELECT page_id, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/@?#]*@)?([^/:?#]+)', 1) AS h FROM pages) SELECT page_id, array_to_string(list_slice(string_split(lower(h), '.'), -2, -1), '.') AS domain FROM u""")
def url_domains(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", strings.domain(F.col("url")).alias("domain"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN d WHEN 1 THEN d WHEN 2 THEN d ELSE NULL END AS d FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def parse_dates(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    f = lambda p: F.date_format("o_orderdate", p)
    text = F.when(k == 0, f("yyyy-MM-dd")).when(k == 1, F.concat(F.lit(" "), f("d/M/yyyy"))).when(k == 2, f("dd MMM yy")).otherwise(f("yyyy-dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.to_date(text).alias("d"))


@query("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_type IN ('low', 'high') THEN event_type ELSE 'medium' END AS overall_risk, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END END AS n_risks FROM events""")
def json_report_parse(spark, sf_dir):
    body = F.concat(F.lit('{"summary": "s", "overall_risk": "'), "event_type", F.lit('", "risks": [{"risk": "'), F.when(F.col("event_id") % 2 == 0, "x").otherwise(" "), F.lit('", "evidence_ids": ["E001"]}]}'))
    text = F.when(F.col("event_id") % 5 == 0, F.lit("no object { here")).when(F.col("event_id") % 3 == 0, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("So "), body, F.lit(" done")))
    r = jsonx.report(text)
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), r["overall_risk"].alias("overall_risk"), F.size(r["risks"]).alias("n_risks"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'INVOICE' WHEN 1 THEN 'BANK_STATEMENT' WHEN 2 THEN 'RECEIPT' END AS kind FROM customer""")
def enum_repair(spark, sf_dir):
    k = F.col("c_custkey") % 4
    text = F.when(k == 0, "INVOICES").when(k == 1, "bank statment").when(k == 2, " receipt ").otherwise("unknown thing")
    allowed = ["PAYSLIP", "BANK_STATEMENT", "INVOICE", "QUOTATION", "RECEIPT", "E_RECEIPT", "CERTIFICATE", "RESUME", "OFFICIAL_DOC", "LEGAL_DOC"]
    return table(spark, sf_dir, "customer").select("c_custkey", jsonx.nearest_enum(text, allowed).alias("kind"))


@query("""SELECT user_id, arg_max(event_type, (n, -o)) AS event_type, max(n) AS votes, count(*) > 1 AS contested FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS o FROM events GROUP BY ALL) GROUP BY user_id""")
def doc_type_vote(spark, sf_dir):
    return evidence.vote(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


@query("""SELECT md5(text) AS h, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY text""")
def fact_dedupe(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.md5("text").alias("h"), "doc_id", "source")
    return evidence.first_of(d, ["h"], "doc_id")


@query("""WITH p AS (SELECT c_custkey AS doc_id, o_orderkey AS part, o_orderstatus AS t, o_orderkey % 9 AS n, o_custkey FROM orders JOIN customer ON c_custkey = o_custkey), v AS (SELECT doc_id, t, count(*) AS k, min(part) AS o FROM p GROUP BY ALL)
SELECT doc_id, max(n) AS page_count, count(DISTINCT n) AS n_ids, any_value(w.dt) AS document_type FROM p JOIN (SELECT doc_id, arg_max(t, (k, -o)) AS dt FROM v GROUP BY 1) w USING (doc_id) GROUP BY doc_id""")
def merge_parts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("part"), F.col("o_orderstatus").alias("document_type"), (F.col("o_orderkey") % 9).alias("page_count"), F.array(F.col("o_orderkey") % 9).alias("ids"))
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"))
    return evidence.merge_parts(o.join(known, "doc_id", "left_semi")).select("doc_id", "page_count", F.size("ids").alias("n_ids"), "document_type")
