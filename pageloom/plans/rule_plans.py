"""Queries of rule tables, and of publication."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pageloom.operators import redact as R
from pageloom.operators.publish import publish
from pageloom.operators.rules import redacted, rule_spans
from pageloom.sources.scratch import scratch_root
from pageloom.sources.tables import spread, table

from .registry import query
from .text_plans import RULES, bounded_sql, replaced_sql

#: Three words in a row of each benchmark item, and each of its words of eight letters or more.
_RULES_SQL = """w AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark),
r AS (SELECT item_id * 100000 + i * 2 AS rule_id, array_to_string(w[i + 1:i + 3], ' ') AS lit FROM w, unnest(range(len(w) - 2)) AS u(i)
  UNION ALL SELECT item_id * 100000 + i * 2 + 1, w[i + 1] FROM w, unnest(range(len(w))) AS u(i) WHERE length(w[i + 1]) >= 8),
f AS (SELECT rule_id, unnest([lit, replace(lit, ' ', chr(160)), replace(lit, '-', chr(173)), replace(replace(lit, ' ', chr(160)), '-', chr(173)), replace(lit, '-', chr(8209)), replace(replace(lit, ' ', chr(160)), '-', chr(8209))]) AS lit FROM r),
s AS MATERIALIZED (SELECT lit, min(rule_id) AS rule_id FROM f WHERE lit <> '' GROUP BY lit)"""
#: Texts with some hard spaces.
_TEXTS_SQL = "d AS (SELECT doc_id, replace(text, 'n t', 'n' || chr(160) || 't') AS text FROM documents)"


def _rules(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select("item_id", F.split("text", " ").alias("w"))
    each = F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.struct(i.alias("i"), F.when(i + 2 < F.size("w"), F.array_join(F.slice("w", i + 1, F.lit(3)), " ")).alias("three"), F.when(F.length(F.get("w", i)) >= 8, F.get("w", i)).alias("one"))))
    rows = words.select("item_id", each.alias("x")).select((F.col("item_id") * 100000 + F.col("x.i") * 2).alias("rule_id"), "x.three", "x.one")
    return rows.select("rule_id", F.col("three").alias("literal")).union(rows.select(F.col("rule_id") + 1, "one")).filter("literal is not null")


def _texts(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.replace("text", F.lit("n t"), F.lit("n\u00a0t")).alias("text"))


def _hits_sql(where: str) -> str:
    return f"SELECT doc_id, rule_id, lit, p, u.i FROM (SELECT doc_id, rule_id, lit, string_split(text, lit) AS p FROM d JOIN s ON contains(text, lit)), unnest(range(1, len(p))) AS u(i) WHERE {where}"


@query("rule_table_hits", f"WITH {_RULES_SQL}, {_TEXTS_SQL}, h AS ({_hits_sql(bounded_sql('p', 'u.i', 'lit'))}) SELECT doc_id, rule_id, count(*) AS hits, CAST(min(list_sum([length(x) FOR x IN p[1:i]]) + (i - 1) * length(lit)) AS INT) AS first_at FROM h GROUP BY doc_id, rule_id")
def rule_table_hits(spark, sf_dir):
    """Thousands of literals in all their spellings, as words of their own."""
    return rule_spans(_texts(spark, sf_dir), _rules(spark, sf_dir)).groupBy("doc_id", "rule_id").agg(F.count(F.lit(1)).alias("hits"), F.min("lo").alias("first_at"))


@query("rule_table_anywhere", f"WITH {_RULES_SQL}, {_TEXTS_SQL}, h AS ({_hits_sql('true')}) SELECT doc_id, rule_id, count(*) AS hits FROM h GROUP BY doc_id, rule_id")
def rule_table_anywhere(spark, sf_dir):
    """The same literals, in words too."""
    return rule_spans(_texts(spark, sf_dir), _rules(spark, sf_dir), bounded=False).groupBy("doc_id", "rule_id").agg(F.count(F.lit(1)).alias("hits"))


@query("rule_table_redacted", f"""WITH {_RULES_SQL}, {_TEXTS_SQL}, h AS ({_hits_sql(bounded_sql('p', 'u.i', 'lit'))}),
c AS (SELECT doc_id, list_sum([length(x) FOR x IN p[1:i]]) + (i - 1) * length(lit) AS lo, list_sum([length(x) FOR x IN p[1:i]]) + i * length(lit) AS hi FROM h),
far AS (SELECT doc_id, lo, hi, max(hi) OVER (PARTITION BY doc_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c),
i AS (SELECT doc_id, lo, hi, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM far),
m AS (SELECT doc_id, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY doc_id, island),
k AS (SELECT doc_id, hi AS a, lead(lo) OVER (PARTITION BY doc_id ORDER BY lo) AS b FROM m UNION ALL SELECT doc_id, 0, min(lo) FROM m GROUP BY doc_id),
t AS (SELECT doc_id, string_agg(text[CAST(a + 1 AS BIGINT):CAST(coalesce(b, length(text)) AS BIGINT)], '<X>' ORDER BY a) AS text FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, sha256(coalesce(t.text, d.text)) AS text_sha256 FROM d LEFT JOIN t USING (doc_id)""")
def rule_table_redacted(spark, sf_dir):
    """Texts without what any rule of the table marks."""
    texts = _texts(spark, sf_dir)
    return redacted(texts, rule_spans(texts, _rules(spark, sf_dir)), "<X>").select("doc_id", F.sha2("text", 256).alias("text_sha256"))


_PLANTED_SQL = "CASE WHEN doc_id % 7 = 3 THEN replace(text, ' the ', ' t-' || chr(10) || 'he ') ELSE text END"
_DEHYPHENED_SQL = "regexp_replace(t, '([\\p{L}\\p{Nd}])[-\\x{AD}\\x{2010}\\x{2011}][ \\t]*\\n', '\\1', 'g')"


@query("publication", f"""WITH b AS MATERIALIZED (SELECT doc_id, {_PLANTED_SQL} AS text FROM documents), q AS MATERIALIZED (SELECT doc_id, text, {replaced_sql('text', RULES[2:])} AS t FROM b),
o AS MATERIALIZED (SELECT doc_id, text, {replaced_sql('t', RULES[:2])} AS t FROM q), rules(rule_id, lit, token) AS (VALUES {", ".join(f"({r.rule_id}, '{r.literal}', '{r.token}')" for r in RULES)}),
v AS (SELECT rule_id, unnest([lit, replace(lit, ' ', chr(160))]) AS lit FROM rules), j AS (SELECT doc_id, {_DEHYPHENED_SQL} AS text FROM o),
left_over AS (SELECT DISTINCT doc_id, 'residue:' || rule_id AS reason FROM (SELECT doc_id, rule_id, lit, string_split(text, lit) AS p FROM j, v), unnest(range(1, len(p))) AS u(i) WHERE {bounded_sql('p', 'u.i', 'lit')}),
missing AS (SELECT doc_id, 'missing:<T4>' AS reason FROM o WHERE doc_id % 11 = 5 AND NOT contains(t, '<T4>')),
g AS (SELECT doc_id, string_agg(reason, ',' ORDER BY reason) AS reasons FROM (SELECT * FROM left_over UNION ALL SELECT * FROM missing) GROUP BY doc_id)
SELECT doc_id, sha256(t) AS text_sha256, coalesce(reasons, '') AS reasons, reasons IS NULL AS proven FROM o LEFT JOIN g USING (doc_id)""")
def publication(spark, sf_dir):
    """The manifest of pseudonymized texts, some with a word that a line breaks, which the rules missed, and some that lack a token."""
    broken = F.when(F.col("doc_id") % 7 == 3, F.replace("text", F.lit(" the "), F.lit(" t-\nhe "))).otherwise(F.col("text"))
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", broken.alias("text"))
    out = R.substitute(docs, RULES).withColumn("tokens", F.when(F.col("doc_id") % 11 == 5, F.array(F.lit("<T4>"))))
    rules = spark.createDataFrame([(r.rule_id, r.literal) for r in RULES], "rule_id int, literal string")
    manifest = publish(out, rules, f"{scratch_root(spark)}/publication-{uuid.uuid4().hex[:12]}", "0")
    return manifest.select("doc_id", "text_sha256", F.array_join("reasons", ",").alias("reasons"), "proven")
