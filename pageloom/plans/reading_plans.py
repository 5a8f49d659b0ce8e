"""Queries of joined readings: replacement inside styled spans, and tokens set to the width of what they replace."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.functions.fitting import FitRule, fitted, with_tokens
from pageloom.operators.reading import hit_ranges, replace_in_spans
from pageloom.sources.tables import LINES_PER_PAGE, spread, table

from .registry import query
from .text_plans import bounded_sql

#: Texts in which a common word is broken over lines, or has a hyphen inside a line, where it stays.
_BROKEN_SQL = "broken AS (SELECT doc_id, replace(replace(text, ' the ', ' t-' || chr(10) || 'he '), ' de ', ' d-e ') AS text FROM documents)"
_SPANS_SQL = f"""{_BROKEN_SQL}, ls AS (SELECT doc_id, u.i - 1 AS ln, l[u.i] AS line, len(l) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM broken), unnest(range(1, len(l) + 1)) AS u(i)),
piece AS (
  SELECT doc_id, CAST(ln // {LINES_PER_PAGE} AS INT) AS page, ln, u.i AS k, c[u.i] AS text, 's' || ((u.i - 1) % 3) AS style, false AS brk FROM (SELECT *, regexp_extract_all(line, '.{{1,7}}') AS c FROM ls), unnest(range(1, len(c) + 1)) AS u(i)
  UNION ALL SELECT doc_id, CAST(ln // {LINES_PER_PAGE} AS INT), ln, 1000000, ' ', 's0', true FROM ls WHERE ln + 1 < n AND (ln + 1) % {LINES_PER_PAGE} > 0
), span AS (
  SELECT *, row_number() OVER w AS sp, coalesce(brk AND regexp_matches(lag(text) OVER w, '[\\p{{L}}\\p{{Nd}}][-\\x{{AD}}\\x{{2010}}\\x{{2011}}]$') AND regexp_matches(lead(text) OVER w, '^[\\p{{L}}\\p{{Nd}}]'), false) AS joins
  FROM piece WINDOW w AS (PARTITION BY doc_id, page ORDER BY ln, k)
), edge AS (SELECT *, coalesce(lead(joins) OVER (PARTITION BY doc_id, page ORDER BY sp), false) AS gives FROM span
), ch AS (
  SELECT doc_id, page, sp, style, text[u.i] AS c, joins OR (gives AND u.i = length(text)) AS gone, row_number() OVER (PARTITION BY doc_id, page ORDER BY sp, u.i) AS pos, u.i AS own FROM edge, unnest(range(1, length(text) + 1)) AS u(i)
), kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY pos) AS rp FROM ch WHERE NOT gone
), reading AS (SELECT doc_id, page, string_agg(c, '' ORDER BY rp) AS t FROM kept GROUP BY ALL
), hit AS (
  SELECT doc_id, page, CAST(list_sum([length(x) FOR x IN p[1:i]]) + (i - 1) * 3 AS BIGINT) AS lo FROM (SELECT doc_id, page, string_split(t, 'the') AS p FROM reading), unnest(range(1, len(p))) AS u(i)
  WHERE NOT regexp_matches(CASE WHEN length(p[i]) > 0 OR i = 1 THEN right(p[i], 1) ELSE 'e' END, '^[\\p{{L}}\\p{{Nd}}]$') AND NOT regexp_matches(CASE WHEN length(p[i + 1]) > 0 OR i = len(p) - 1 THEN left(p[i + 1], 1) ELSE 't' END, '^[\\p{{L}}\\p{{Nd}}]$')
), placed AS (SELECT h.doc_id, h.page, a.pos AS lo, z.pos AS hi, a.style FROM hit h JOIN kept a ON a.doc_id = h.doc_id AND a.page = h.page AND a.rp = h.lo + 1 JOIN kept z ON z.doc_id = h.doc_id AND z.page = h.page AND z.rp = h.lo + 3)"""


def _pages(spark, sf_dir):
    """(doc_id, page, spans): lines cut to pieces of seven characters, three styles by turns, breaks between lines."""
    size = F.lit(LINES_PER_PAGE)
    text = F.replace(F.replace("text", F.lit(" the "), F.lit(" t-\nhe ")), F.lit(" de "), F.lit(" d-e "))
    lines = spread(table(spark, sf_dir, "documents")).select("doc_id", F.split(text, "\n").alias("l"))
    pages = lines.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / size).cast("int")), lambda p: F.slice("l", p * size + 1, size))).alias("page", "l"))
    span = lambda text, style, brk: F.struct(text.alias("text"), style.alias("style"), F.lit(False).alias("inserted"), F.lit(brk).alias("line_break"), F.lit(0.0).alias("gap"))
    cut = lambda line: F.transform(F.regexp_extract_all(line, F.lit(".{1,7}"), F.lit(0)), lambda c, i: span(c, F.concat(F.lit("s"), (i % 3).cast("string")), False))
    none = F.slice(F.array(span(F.lit(""), F.lit("s0"), True)), 1, 0)
    spans = F.flatten(F.transform("l", lambda line, i: F.concat(F.when(i > 0, F.array(span(F.lit(" "), F.lit("s0"), True))).otherwise(none), cut(line))))
    # A page with spans is told by its lines: asked of the spans, they would be made twice.
    return pages.filter((F.size("l") > 1) | F.get("l", F.lit(0)).rlike(".")).select("doc_id", "page", spans.alias("spans"))


@query("replace_in_spans", f"""WITH {_SPANS_SQL}, n AS (SELECT doc_id, page, count(*) AS hits FROM placed GROUP BY ALL
), left_over AS (
  SELECT c.doc_id, c.page, c.pos, 1 AS o, c.c AS text, c.style, false AS inserted FROM ch c JOIN n USING (doc_id, page) ASOF LEFT JOIN placed p ON c.doc_id = p.doc_id AND c.page = p.page AND c.pos >= p.lo WHERE p.lo IS NULL OR c.pos > p.hi
  UNION ALL SELECT doc_id, page, lo, 0, '<T1>', style, true FROM placed
), told AS (SELECT *, CASE WHEN style = lag(style) OVER w AND inserted = lag(inserted) OVER w THEN 0 ELSE 1 END AS new FROM left_over WINDOW w AS (PARTITION BY doc_id, page ORDER BY pos, o)
), numbered AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page ORDER BY pos, o ROWS UNBOUNDED PRECEDING) AS sp FROM told
), out AS (
  SELECT doc_id, page, sp, string_agg(text, '' ORDER BY pos, o) AS text, any_value(style) AS style, any_value(inserted) AS inserted FROM numbered GROUP BY ALL
  UNION ALL SELECT s.doc_id, s.page, s.sp, s.text, s.style, false FROM span s ANTI JOIN n USING (doc_id, page))
SELECT doc_id, page, CAST(coalesce(any_value(hits), 0) AS INT) AS hits, CAST(count(*) AS INT) AS n_spans, sha256(string_agg(text || '|' || style || '|' || inserted, chr(10) ORDER BY sp)) AS spans_sha256 FROM out LEFT JOIN n USING (doc_id, page) GROUP BY doc_id, page""")
def replace_in_spans_query(spark, sf_dir):
    """A word replaced in styled paragraphs: whole where a line breaks it, in the style of its first letter."""
    out = _pages(spark, sf_dir).select("doc_id", "page", replace_in_spans(F.col("spans"), "the", "<T1>").alias("r"))
    digest = F.array_join(F.transform("r.spans", lambda s: F.concat_ws("|", s["text"], s["style"], s["inserted"].cast("string"))), "\n")
    return out.select("doc_id", "page", F.col("r.hits").alias("hits"), F.size("r.spans").alias("n_spans"), F.sha2(digest, 256).alias("spans_sha256"))


@query("reading_map_back", f"WITH {_SPANS_SQL} SELECT p.doc_id, p.page, CAST(p.lo - 1 AS INT) AS hit, CAST(c.sp - 1 AS INT) AS span, CAST(min(c.own) - 1 AS INT) AS lo, CAST(max(c.own) AS INT) AS hi FROM placed p JOIN ch c ON c.doc_id = p.doc_id AND c.page = p.page AND c.pos BETWEEN p.lo AND p.hi GROUP BY p.doc_id, p.page, p.lo, c.sp")
def reading_map_back(spark, sf_dir):
    """Each hit of the joined reading as ranges of the spans it covers."""
    return _pages(spark, sf_dir).select("doc_id", "page", F.inline(hit_ranges(F.col("spans"), "the")))


#: Fixed values of this query: rules in order, the second of which can't fit, and spacing in points.
FIT_RULES = [FitRule("of the", "[LONGER]", 0.3), FitRule("the", "[FAR TOO LONG FOR IT]"), FitRule("de la", "*"), FitRule("an", "AA"), FitRule("the", "[ART]", 0.2)]
_CHAR_SPACING, _WORD_SPACING = 0.1, 0.25
_ADVANCE_SQL = "(list_sum([CASE WHEN c = ' ' THEN 278 ELSE 400 + unicode(c) % 8 * 50 END FOR c IN string_split({0}, '')]) / 1000.0::DOUBLE * {1} + length({0}) * 0.1::DOUBLE + (length({0}) - length(replace({0}, ' ', ''))) * 0.25::DOUBLE)"


def _fit_sql() -> str:
    """The rules one after the other, each over what those before it have taken."""
    size = "(10 + length(line) % 3)::DOUBLE"
    steps = [f"s0 AS (SELECT doc_id, ln, line, {size} AS size, []::STRUCT(lo BIGINT, hi BIGINT, token VARCHAR, size DOUBLE)[] AS t FROM ls)"]
    for i, r in enumerate(FIT_RULES):
        lit, token, n = f"'{r.literal}'", f"'{r.token}'", len(r.literal)
        full, half, want = (_ADVANCE_SQL.format(x, y) for x, y in ((token, "size"), (token, "(size / 2)"), (lit, "size")))
        hits = f"[{{'lo': CAST(list_sum([length(x) FOR x IN p[1:k]]) + (k - 1) * {n} AS BIGINT), 'hi': CAST(list_sum([length(x) FOR x IN p[1:k]]) + k * {n} AS BIGINT)}} FOR k IN range(1, len(p)) IF {bounded_sql('p', 'k', lit)}]"
        free = "[h FOR h IN hits IF len([x FOR x IN t IF h.lo < x.hi AND x.lo < h.hi]) = 0]"
        steps += [
            f"h{i} AS (SELECT *, {hits} AS hits FROM (SELECT *, string_split(line, {lit}) AS p FROM s{i}))",
            f"m{i} AS (SELECT doc_id, ln, line, size, t, {free} AS free, {full} AS w, ({full} - {half}) / (size / 2) AS k, {want} AS want FROM h{i})",
            f"e{i} AS (SELECT *, CASE WHEN w <= want THEN size ELSE (want - (w - k * size)) / k END AS fit FROM m{i})",
            f"s{i + 1} AS MATERIALIZED (SELECT doc_id, ln, line, size, CASE WHEN fit >= size * {r.share()}::DOUBLE THEN list_concat(t, [{{'lo': h.lo, 'hi': h.hi, 'token': {token}, 'size': fit}} FOR h IN free]) ELSE t END AS t FROM e{i})",
        ]
    return ", ".join(steps)


@query("fitted_rules", f"""WITH ls AS (SELECT doc_id, u.i - 1 AS ln, l[u.i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(i)), {_fit_sql()},
f AS (SELECT doc_id, ln, line, list_sort(t) AS t FROM s{len(FIT_RULES)} WHERE len(t) > 0)
SELECT doc_id, CAST(ln AS INT) AS ln, CAST(len(t) AS INT) AS n_tokens, round(list_sum([x.size FOR x IN t]), 4) AS sizes,
  sha256(array_to_string([line[(CASE WHEN k = 1 THEN 0 ELSE t[k - 1].hi END) + 1:t[k].lo] || t[k].token FOR k IN range(1, len(t) + 1)], '') || line[t[len(t)].hi + 1:]) AS text_sha256 FROM f""")
def fitted_rules(spark, sf_dir):
    """Tokens at the width of the words they replace, rule after rule; one that can't be set small enough undoes itself alone."""
    width = lambda c: F.when(c == " ", 278).otherwise(400 + F.ascii(c) % 8 * 50).cast("double")
    rows = spread(table(spark, sf_dir, "documents")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "text"))
    placed = fitted(rows, FIT_RULES, (F.length("text") % 3 + 10).cast("double"), width, _CHAR_SPACING, _WORD_SPACING).filter(F.size("placed") > 0)
    sizes = F.round(F.aggregate("placed", F.lit(0.0), lambda acc, x: acc + x["size"]), 4)
    return placed.select("doc_id", "ln", F.size("placed").alias("n_tokens"), sizes.alias("sizes"), F.sha2(with_tokens(F.col("text"), F.col("placed")), 256).alias("text_sha256"))
