"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, exact_dedup, filter_audit, langid, licenses, line_dedup, near_dedup, pii, quotes, resampling, toxicity, warc
from .common import table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: doc_id, n_gone and gone (numbers of the lines that go)."""
    docs = table(spark, sf_dir, "documents")
    gone = line_dedup.line_dedup(docs).withColumnRenamed("doc_id", "_id")
    out = docs.select("doc_id").join(gone, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return out.select("doc_id", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_gone"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


OP3 = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h FROM documents),
g AS (SELECT h, arg_min(doc_id, (-chars, doc_id)) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM d JOIN g USING (h)
"""


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


OP5 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY h)
SELECT page_id, n AS payload_bytes, p.h AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.h = f.h AND n >= 100
"""


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = quotes.link_quotes(table(spark, sf_dir, "conversations"))
    return linked.select("conv_id", "turn", "role", F.sha2("own", 256).alias("own_sha256"), "n_passages", "n_linked", "parent_turn", "root_turn", "depth")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    base = F.concat(*pii.KINDS)
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.concat(base, "added")).alias("spans"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = r"""list_filter(string_split_regex(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"""
OP10 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(x="coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format(x="coalesce(text, '')")} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS v
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM windows),
places AS (SELECT doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS v FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes)),
found AS (SELECT doc_id, p.m, i, item_id FROM places p JOIN windows x ON p.v = x.v AND p.m = x.m),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(joined, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# CRC-32 by halves of bytes: t has the sixteen remainders
OP11 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(x="coalesce(text, '')")} AS w FROM documents),
halves AS (SELECT list(list_reduce([i, 0, 0, 0, 0], lambda c, z: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY i) AS t FROM (SELECT unnest(range(16)) AS i)),
own AS (SELECT doc_id, unnest(w) AS v FROM d),
theirs AS (SELECT unnest({_WORDS.format(x="coalesce(text, '')")}) AS v FROM benchmark),
spelt AS (SELECT v, hex(encode(v)) AS x FROM (SELECT v FROM own UNION SELECT v FROM theirs)),
coded AS (
  SELECT v, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(1, length(x), 2), lambda i: CAST('0x' || substring(x, i, 2) AS BIGINT))),
    lambda c, b: xor(xor(xor(c, b) >> 4, t[(xor(c, b) & 15) + 1]) >> 4, t[(xor(xor(c, b) >> 4, t[(xor(c, b) & 15) + 1]) & 15) + 1])), 4294967295) % 10000 AS bucket
  FROM spelt, halves),
s AS (SELECT bucket, count(*) AS s FROM own JOIN coded USING (v) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM theirs JOIN coded USING (v) GROUP BY bucket),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST((SELECT count(*) FROM own) + 10000 AS DOUBLE)
    / (CAST(s + 1 AS DOUBLE) * CAST((SELECT count(*) FROM theirs) + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket)),
total AS (SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM own JOIN coded USING (v) JOIN gain USING (bucket) GROUP BY doc_id),
weighed AS (
  SELECT doc_id, len(w) AS n_features, coalesce(CAST((total - ((total % n) + n) % n) // n AS BIGINT), 0) AS weight,
    CAST('0x' || substring(sha256('2024:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h
  FROM d LEFT JOIN total USING (doc_id)),
scored AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM weighed),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (doc_id)
"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(CAST(source AS VARCHAR), '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN w.doc_id > first THEN 'E' ELSE '' END) AS fails
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
n AS (SELECT part, fails, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM f GROUP BY part, fails),
one AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM one a, one b, one c, one d, one e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, CAST(k AS INTEGER) AS step, substring(o, k, 1) AS x, substring(o, 1, k - 1) AS before FROM orders, (SELECT unnest(range(1, 6)) AS k)),
r AS (
  SELECT part, o, step, x,
    sum(CASE WHEN translate(fails, before || x, '') = fails THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN translate(fails, before, '') = fails AND contains(fails, x) THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(fails, x) THEN n ELSE 0 END) AS failing,
    sum(CASE WHEN fails = x THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN translate(fails, before, '') = fails AND contains(fails, x) THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN translate(fails, before, '') = fails AND contains(fails, x) THEN toxic ELSE 0 END) AS toxic_lost
  FROM n, steps GROUP BY part, o, step, x)
SELECT part, o AS filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(failing - removed AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM r
"""


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    listed = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    every = F.concat("base", "found")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.start").alias("first_word"), F.array_max("base.start").alias("last_word"),
        listed(F.col("base.label")).alias("base_labels"), listed(F.transform(every, lambda p: p["label"])).alias("labels"),
        F.coalesce(F.array_max(F.transform(every, lambda p: p["share"])), F.lit(0.0)).alias("score"),
    )


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_near_dedup, op2_line_dedup, op3_exact_dedup, op4_language_id, op5_warc, op6_toxicity, op7_quotes, op8_pii, op9_byte_bpe, op10_decontaminate,
        op11_resampling, op12_filter_audit, op13_licenses,
    )}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3, "op5_warc": OP5, "op10_decontaminate": OP10, "op11_resampling": OP11, "op12_filter_audit": OP12}
