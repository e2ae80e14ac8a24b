"""The operators over their whole tables, as registered queries, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import classifier, decontamination, fill_in_middle, filter_audit, fingerprints, html_text, licenses, mixing, packing, quality_rules, simhash, substrings, token_counts
from ledgerloom.llm.workspace import documents


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.screened(documents(spark, sf_dir))


OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (
  SELECT k, sum(n)::BIGINT AS n_lines, sum(n - 1)::BIGINT AS n_dup_lines
  FROM (SELECT k, line, count(*) AS n FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d)
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k, line) GROUP BY k),
g AS (
  SELECT k, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS s
  FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
h AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, s) AS n FROM g) WHERE n > 1),
r AS (SELECT k, count(*) AS n_repeat_words FROM (SELECT DISTINCT k, i + j AS p FROM h, (VALUES (0), (1), (2)) o(j)) GROUP BY k),
s AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines, length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclamations,
         len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutters
  FROM d LEFT JOIN l USING (k) LEFT JOIN r USING (k)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 10 * n_symbols <= n_words AND 10 * n_exclamations <= 3 * n_words AND 10 * n_dup_lines <= 4 * n_lines
         AND word_chars BETWEEN 3 * n_words AND 10 * n_words AND 5 * n_stutters <= n_words AS kept
FROM b
"""


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(mixing.document_sizes(documents(spark, sf_dir)))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position")).orderBy("position", "doc_id")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) AS r FROM d GROUP BY source),
w AS (
  SELECT *, [5, 2, 1][(r - 1) % 3 + 1] AS weight, [-0.5::DOUBLE, 0.0::DOUBLE, 0.5::DOUBLE][(r - 1) % 3 + 1] AS slope, 2 * source_size AS cap FROM s),
l AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / sum(weight) OVER (ORDER BY cap::DOUBLE / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM w),
t AS (
  SELECT source, source_size, slope, least(cap::DOUBLE, coalesce(max(CASE WHEN level * weight <= cap THEN level END) OVER () * weight, cap::DOUBLE)) AS target FROM l),
c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.slope, round(t.target)::BIGINT AS wanted,
         CASE WHEN t.source_size > 0 THEN round(t.target)::BIGINT // t.source_size ELSE 0 END AS whole,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (
  SELECT *, greatest(0, least(size, wanted - whole * source_size - before)) AS part FROM c),
q AS (
  SELECT *, CASE WHEN size = 0 THEN 0 WHEN part = size THEN (whole + 1) * size ELSE whole * size + part END AS taken,
         before::DOUBLE / nullif(target, 0) AS share, 1 - slope AS flat FROM p)
SELECT doc_id, size::BIGINT AS size, source_size, target, taken::BIGINT AS taken,
       CASE WHEN taken > 0 THEN round(least(abs(CASE WHEN slope = 0 THEN share ELSE (sqrt(flat * flat + 4 * slope * share) - flat) / (2 * slope) END), 1.0::DOUBLE), 9) END AS position
FROM q
"""

def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(documents(spark, sf_dir))


OP8_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT k, doc_id, i, array_to_string(w[i:i + 12], ' ') AS s
  FROM (SELECT k, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
m AS (SELECT s, min(doc_id) AS least FROM g GROUP BY s),
h AS (SELECT k, i FROM g JOIN m USING (s) WHERE doc_id > least),
r AS (SELECT k, list(DISTINCT p) AS gone FROM (SELECT k, unnest(range(i, i + 13)) AS p FROM h) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(gone, []), i)), ' '), '')) AS kept_sha256
FROM d LEFT JOIN r USING (k)
"""


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_packing": op2_packing,
    "op5_quality_rules": op5_quality_rules,
    "op7_mixing": op7_mixing,
    "op8_substrings": op8_substrings,
}

ORACLE_SQL = {
    "op5_quality_rules": OP5_SQL,
    "op7_mixing": OP7_SQL,
    "op8_substrings": OP8_SQL,
}


def op10_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return classifier.classified(documents(spark, sf_dir), labels)


QUERIES["op10_classifier"] = op10_classifier


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprinted(documents(spark, sf_dir))


QUERIES["op6_fingerprints"] = op6_fingerprints


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(documents(spark, sf_dir))


QUERIES |= {"op3_token_counts": op3_token_counts, "op4_licenses": op4_licenses}
ORACLE_SQL["op4_licenses"] = licenses.oracle_sql()


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.rendered(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES["op9_html_text"] = op9_html_text


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(documents(spark, sf_dir))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l,
         sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
n AS (
  SELECT *, len(l)::BIGINT AS n, [('0x' || substr(h, 1, 8))::BIGINT, ('0x' || substr(h, 9, 8))::BIGINT, ('0x' || substr(h, 17, 8))::BIGINT, ('0x' || substr(h, 25, 8))::BIGINT] AS r FROM d),
c AS (
  SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 100 THEN 'plain'
              WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (
  SELECT *, coalesce(array_to_string(l[1:a], ''), '') AS prefix, coalesce(array_to_string(l[a + 1:b], ''), '') AS middle, coalesce(array_to_string(l[b + 1:], ''), '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP12_SQL = r"""
WITH g AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
         + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::INT
         + 8 * regexp_matches(text, '[#$%&*|]')::INT
         + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask
  FROM d LEFT JOIN g USING (doc_id)),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(c, bit)),
o AS (
  SELECT a.c || b.c || x.c || y.c || z.c AS filter_order, [a.bit, b.bit, x.bit, y.bit, z.bit] AS bits
  FROM f a JOIN f b ON b.c <> a.c JOIN f x ON x.c NOT IN (a.c, b.c) JOIN f y ON y.c NOT IN (a.c, b.c, x.c) JOIN f z ON z.c NOT IN (a.c, b.c, x.c, y.c)),
s AS (SELECT filter_order, step::INT AS step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS earlier FROM o, range(1, 6) r(step)),
k AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, mask)
SELECT part, filter_order, step,
       sum(CASE WHEN mask & (own | earlier) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
       sum(CASE WHEN mask & own > 0 AND mask & earlier = 0 THEN n ELSE 0 END)::BIGINT AS removed,
       sum(CASE WHEN mask & own > 0 AND mask & earlier > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
       sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
       sum(CASE WHEN mask & own > 0 AND mask & earlier = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
       sum(CASE WHEN mask & own > 0 AND mask & earlier = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
       sum(CASE WHEN mask & own > 0 THEN 120 // bit_count(mask) * n ELSE 0 END)::BIGINT AS shapley
FROM k, s GROUP BY part, filter_order, step
"""


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digests(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (
  SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
z AS (SELECT DISTINCT size FROM v),
g AS (
  SELECT k, i, size, array_to_string(w[i:i + size - 1], ' ') AS s
  FROM (SELECT k, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, z)),
h AS (SELECT k, i, size, item FROM g JOIN v USING (size, s)),
t AS (SELECT k, count(DISTINCT item)::BIGINT AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM h GROUP BY k),
r AS (SELECT k, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT DISTINCT k, unnest(range(i, i + size)) AS p FROM h) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN t USING (k) LEFT JOIN r USING (k)
"""

QUERIES |= {"op11_fill_in_middle": op11_fill_in_middle, "op12_filter_audit": op12_filter_audit, "op13_decontamination": op13_decontamination}
ORACLE_SQL |= {"op11_fill_in_middle": OP11_SQL, "op12_filter_audit": OP12_SQL, "op13_decontamination": OP13_SQL}
