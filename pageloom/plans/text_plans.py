"""Queries of the text plane: matching, marks, substitution, checks, ranges, runs, chains, lines, paragraphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.functions.geometry import character_range, contains, intersects
from pageloom.functions.folds import heads_where, let, running_sums
from pageloom.functions.text import bounded_spans, dehyphenate, flatten_space
from pageloom.operators import chains as C
from pageloom.operators import redact as R
from pageloom.operators.spans import apply_splices, literal_splices, merge_spans
from pageloom.sources.tables import RUNS_SQL, lines, page_runs, runs, spread, table

from .registry import query

#: The rules of these queries.
RULES = [R.Rule(1, "the", "<T1>"), R.Rule(2, "tion", "<T2>"), R.Rule(3, "of the", "<T3>"), R.Rule(4, "de la", "<T4>")]
PATTERNS = [R.Rule(11, pattern=r"[A-Za-z0-9._]+@[A-Za-z0-9.]+\.[a-z]+"), R.Rule(12, pattern=r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}"), R.Rule(13, pattern=r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}")]
RECTS = [(0, 0.0, 0.0, 120.0, 60.0), (0, 200.0, 10.0, 320.0, 120.0), (1, 50.0, 700.0, 400.0, 760.0)]

def documents(spark, sf_dir):
    """The documents, dealt to all cores where they are few row groups."""
    return spread(table(spark, sf_dir, "documents"))


def bounded_sql(p: str, i: str, lit: str) -> str:
    """Whether hit i of pieces p is bounded, in the oracle's SQL."""
    word = r"'^[\p{L}\p{Nd}]$'"
    before = f"CASE WHEN length({p}[{i}]) > 0 OR {i} = 1 THEN right({p}[{i}], 1) ELSE right({lit}, 1) END"
    after = f"CASE WHEN length({p}[{i} + 1]) > 0 OR {i} = len({p}) - 1 THEN left({p}[{i} + 1], 1) ELSE left({lit}, 1) END"
    return f"(NOT regexp_matches({before}, {word}) AND NOT regexp_matches({after}, {word}))"


RULES_SQL = "rules(rule_id, lit, token) AS (VALUES " + ", ".join(f"({r.rule_id}, '{r.literal}', '{r.token}')" for r in RULES) + ")"
HITS_SQL = f"""{RULES_SQL}, cut AS (
  SELECT doc_id, rule_id, lit, string_split(text, lit) AS p FROM documents, rules
), hit AS (
  SELECT doc_id, rule_id, lit, p, u.i FROM cut, unnest(range(1, len(p))) AS u(i) WHERE {bounded_sql('p', 'u.i', 'lit')}
)"""
PATTERNS_SQL = "\n  UNION ALL ".join(f"SELECT doc_id, {r.rule_id} AS rule_id, u.i - 1 AS ord, m[u.i] AS match FROM (SELECT doc_id, regexp_extract_all(text, '{r.pattern}') AS m FROM documents), unnest(range(1, len(m) + 1)) AS u(i)" for r in PATTERNS)


def replaced_sql(column: str, rules: list[R.Rule]) -> str:
    """Nested oracle expression of bounded substitutions, the longest literal first."""
    out = column
    for r in R.longest_first(rules):
        p = f"string_split({out}, '{r.literal}')"
        hit = bounded_sql("p", "i", f"'{r.literal}'")
        out = f"list_aggregate(list_apply([{p}], lambda p: array_to_string(list_apply(range(1, len(p) + 1), lambda i: p[i] || CASE WHEN i = len(p) THEN '' WHEN {hit} THEN '{r.token}' ELSE '{r.literal}' END), '')), 'first')"
    return out


@query("literal_bounded_hits", f"WITH {HITS_SQL} SELECT doc_id, rule_id, count(*) AS hits FROM hit GROUP BY doc_id, rule_id")
def literal_bounded_hits(spark, sf_dir):
    return R.literal_marks(documents(spark, sf_dir), RULES)


@query("literal_anywhere_hits", f"WITH {RULES_SQL} SELECT doc_id, rule_id, len(string_split(text, lit)) - 1 AS hits FROM documents, rules WHERE contains(text, lit)")
def literal_anywhere_hits(spark, sf_dir):
    return R.literal_marks(documents(spark, sf_dir), RULES, bounded=False)


@query("pattern_marks", PATTERNS_SQL)
def pattern_marks(spark, sf_dir):
    return R.pattern_marks(documents(spark, sf_dir), PATTERNS)


@query("marks_plan", f"""WITH {HITS_SQL}, found AS ({PATTERNS_SQL}), marks AS (
  SELECT doc_id, rule_id, 'literal' AS kind, count(*) AS n FROM hit GROUP BY ALL UNION ALL SELECT doc_id, rule_id, 'pattern', count(*) FROM found GROUP BY ALL)
SELECT source, kind, rule_id, CAST(sum(n) AS BIGINT) AS hits, count(*) AS n_docs FROM marks JOIN documents USING (doc_id) GROUP BY source, kind, rule_id""")
def marks_plan(spark, sf_dir):
    docs = documents(spark, sf_dir)
    text = R.literal_marks(docs.withColumn("doc_id", F.struct("source", "doc_id")), RULES).withColumn("kind", F.lit("literal"))
    found = R.pattern_marks(docs.withColumn("doc_id", F.struct("source", "doc_id")), PATTERNS).groupBy("doc_id", "rule_id").agg(F.count(F.lit(1)).alias("hits")).withColumn("kind", F.lit("pattern"))
    return text.unionByName(found).groupBy("doc_id.source", "kind", "rule_id").agg(F.sum("hits").cast("long").alias("hits"), F.count(F.lit(1)).alias("n_docs"))


@query("redact_text", f"SELECT doc_id, sha256({replaced_sql('text', [RULES[0]])}) AS redacted_sha256, CAST(length({replaced_sql('text', [RULES[0]])}) - length(text) AS BIGINT) AS grown FROM documents")
def redact_text(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text", F.length("text").alias("n"))
    out = R.substitute(docs, [RULES[0]])
    return out.select("doc_id", F.sha2("text", 256).alias("redacted_sha256"), (F.length("text") - F.col("n")).cast("long").alias("grown"))


@query("pseudonymize_text", f"WITH r AS MATERIALIZED (SELECT doc_id, {replaced_sql('text', RULES[2:])} AS t FROM documents) SELECT doc_id, sha256({replaced_sql('t', RULES[:2])}) AS text_sha256 FROM r")
def pseudonymize_text(spark, sf_dir):
    return R.substitute(documents(spark, sf_dir), RULES).select("doc_id", F.sha2("text", 256).alias("text_sha256"))


@query("residue_check", f"WITH r AS (SELECT doc_id, {replaced_sql('text', [RULES[1]])} AS t FROM documents) SELECT doc_id, len(string_split(t, 'tion')) - 1 AS residue FROM r WHERE contains(t, 'tion')")
def residue_check(spark, sf_dir):
    """Where a substituted literal is still there, inside words: such a document is withheld."""
    out = R.substitute(documents(spark, sf_dir).select("doc_id", "text"), [RULES[1]])
    return R.literal_marks(out, [RULES[1]], bounded=False).select("doc_id", F.col("hits").alias("residue"))


@query("arrival_check", f"""WITH {HITS_SQL}, wanted AS (SELECT DISTINCT doc_id FROM hit WHERE rule_id = 1), r AS (SELECT doc_id, {replaced_sql('text', [RULES[0]])} AS t FROM documents)
SELECT d.source, count(*) AS n_wanted, count(*) FILTER (contains(r.t, '<T1>')) AS n_arrived FROM wanted JOIN r USING (doc_id) JOIN documents d USING (doc_id) GROUP BY d.source""")
def arrival_check(spark, sf_dir):
    """Documents with hits, and those whose token arrived."""
    docs = documents(spark, sf_dir).select("doc_id", "source", "text").withColumn("before", F.col("text"))
    hits = R.bounded_hits(F.col("before"), RULES[0].literal)
    out = R.substitute(docs, RULES[:1]).filter(hits > 0)
    return out.groupBy("source").agg(F.count(F.lit(1)).alias("n_wanted"), F.count_if(F.contains("text", F.lit(RULES[0].token))).alias("n_arrived"))


@query("scrub_strings", "SELECT conv_id, turn, sha256(replace(replace(text, 'the', '<A>'), 'an', '<B>')) AS text_sha256, len(string_split(text, 'the')) - 1 AS n_first FROM conversations")
def scrub_strings(spark, sf_dir):
    """Strings outside pages lose every occurrence, in words too, one rule after the other."""
    text = F.replace(F.replace("text", F.lit("the"), F.lit("<A>")), F.lit("an"), F.lit("<B>"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(text, 256).alias("text_sha256"), R.anywhere_hits(F.col("text"), "the").alias("n_first"))


@query("reverse_roundtrip", "SELECT conv_id, turn, contains(text, 'th') AS changed, replace(replace(text, 'th', '⟦1⟧'), '⟦1⟧', 'th') = text AS restored, replace(replace(text, 'he', 'an'), 'an', 'he') = text AS restored_plain FROM conversations")
def reverse_roundtrip(spark, sf_dir):
    """Rules turned round bring a text back if their tokens don't occur in it; a token that is a common string doesn't."""

    def there_and_back(literal: str, token: str):
        return F.replace(F.replace("text", F.lit(literal), F.lit(token)), F.lit(token), F.lit(literal)) == F.col("text")

    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.contains("text", F.lit("th")).alias("changed"), there_and_back("th", "⟦1⟧").alias("restored"), there_and_back("he", "an").alias("restored_plain"))


@query("variant_expand", """WITH r AS (SELECT item_id AS rule_id, text || '-' || item_id AS lit FROM benchmark), f AS (
  SELECT rule_id, unnest([lit, replace(lit, ' ', chr(160)), replace(lit, '-', chr(173)), replace(replace(lit, ' ', chr(160)), '-', chr(173)), replace(lit, '-', chr(8209)),
    replace(replace(lit, ' ', chr(160)), '-', chr(8209))]) AS spelling FROM r)
SELECT DISTINCT rule_id, spelling FROM f""")
def variant_expand(spark, sf_dir):
    rules = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("rule_id"), F.concat("text", F.lit("-"), F.col("item_id").cast("string")).alias("literal"))
    return R.expand_variants(rules).select("rule_id", "spelling")


@query("variant_hits", "SELECT doc_id, len(string_split(replace(text, ' ', chr(160)), 'of' || chr(160) || 'the')) - 1 AS hits FROM documents WHERE contains(text, 'of the')")
def variant_hits(spark, sf_dir):
    """A literal found in its hard-space spelling."""
    docs = documents(spark, sf_dir).select("doc_id", F.replace("text", F.lit(" "), F.lit(" ")).alias("text"))
    return R.literal_marks(docs, [R.Rule(1, "of the")], bounded=False).select("doc_id", "hits")


_BROKEN_SQL = "replace(replace(text, 'tion', 'ti-' || chr(10) || 'on'), ' de ', ' de -' || chr(10))"


@query("dehyphenate", f"SELECT doc_id, sha256(regexp_replace({_BROKEN_SQL}, '([\\p{{L}}\\p{{Nd}}])[-\\x{{AD}}\\x{{2010}}\\x{{2011}}][ \\t]*\\n', '\\1', 'g')) AS text_sha256, len(string_split({_BROKEN_SQL}, '-' || chr(10))) - 1 AS n_breaks FROM documents")
def dehyphenate_query(spark, sf_dir):
    """Texts with breaks inside words, which are joined, and hyphens of their own before a break, which stay."""
    broken = F.replace(F.replace("text", F.lit("tion"), F.lit("ti-\non")), F.lit(" de "), F.lit(" de -\n"))
    n = F.size(F.split(broken, "-\n", -1)) - 1
    return documents(spark, sf_dir).select("doc_id", F.sha2(dehyphenate(broken), 256).alias("text_sha256"), n.alias("n_breaks"))


@query("flatten_space", "SELECT doc_id, sha256(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS text_sha256 FROM documents")
def flatten_space_query(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.sha2(flatten_space(F.col("text")), 256).alias("text_sha256"))


@query("word_agreement", "WITH w AS (SELECT doc_id, list_distinct(string_split(text, ' ')) AS a, list_distinct(string_split(lower(text), ' ')) AS b FROM documents) SELECT doc_id, len(list_intersect(a, b)) AS n_both, len(list_distinct(list_concat(a, b))) AS n_any FROM w")
def word_agreement(spark, sf_dir):
    """Words that two readings of a document share, and all of them."""
    docs = documents(spark, sf_dir).select("doc_id", F.array_distinct(F.split("text", " ")).alias("a"), F.array_distinct(F.split(F.lower("text"), " ")).alias("b"))
    return docs.select("doc_id", F.size(F.array_intersect("a", "b")).alias("n_both"), F.size(F.array_union("a", "b")).alias("n_any"))


@query("replace_text", "SELECT doc_id, count(*) FILTER (contains(line, 'on')) AS n_runs, sha256(string_agg(replace(line, 'on', 'ON'), chr(10) ORDER BY ln)) AS text_sha256 FROM (SELECT doc_id, u.i AS ln, ls[u.i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS u(i)) GROUP BY doc_id")
def replace_text(spark, sf_dir):
    """Plain replacement inside single runs; the count is of runs rewritten."""
    rows = documents(spark, sf_dir).select("doc_id", F.split("text", "\n").alias("l"))
    changed = F.size(F.filter("l", lambda x: F.contains(x, F.lit("on")))).cast("long")
    new = F.array_join(F.transform("l", lambda x: F.replace(x, F.lit("on"), F.lit("ON"))), "\n")
    return rows.select("doc_id", changed.alias("n_runs"), F.sha2(new, 256).alias("text_sha256"))


SPANS_SQL = f"""{HITS_SQL}, span AS (
  SELECT doc_id, rule_id, CAST(list_sum([length(x) FOR x IN p[1:i]]) + (i - 1) * length(lit) AS INT) AS lo, length(lit) AS n FROM hit)"""


@query("range_merge", f"""WITH {SPANS_SQL}, c AS (SELECT s.doc_id, greatest(lo - 3, 0) AS lo, least(lo + n + 3, length(d.text)) AS hi FROM span s JOIN documents d USING (doc_id)),
r AS (SELECT doc_id, lo, hi, max(hi) OVER (PARTITION BY doc_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c WHERE lo < hi),
i AS (SELECT doc_id, lo, hi, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT doc_id, CAST(min(lo) AS INT) AS lo, CAST(max(hi) AS INT) AS hi FROM i GROUP BY doc_id, island""")
def range_merge(spark, sf_dir):
    """Hits with three characters around them, cut to their text and merged, inside the text's row."""
    found = F.flatten(F.array(*(bounded_spans(F.col("text"), r.literal) for r in RULES)))
    wide = F.transform(found, lambda s: F.struct((s["lo"] - 3).alias("lo"), (s["hi"] + 3).alias("hi")))
    return documents(spark, sf_dir).select("doc_id", F.inline(R.merged_ranges(wide, F.length("text"))))


WORD_RULE_SQL = " OR ".join(f"regexp_matches(w, '(^|[^\\p{{L}}\\p{{Nd}}]){r.literal}([^\\p{{L}}\\p{{Nd}}]|$)')" for r in RULES if " " not in r.literal)


@query("word_rules", f"""SELECT doc_id, count(*) AS n_words FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\n]+')) AS w FROM documents)
WHERE length(w) % 10 >= 3 AND ({WORD_RULE_SQL} OR trim(w, '.,;:()[]{{}}"''`?!') IN ('the', 'tion', 'ßß') OR regexp_matches(w, '[0-9]{{3}}-[0-9]{{4}}')) GROUP BY doc_id""")
def word_rules(spark, sf_dir):
    """Single words of enough confidence (their length stands in for it) that a rule covers, counted."""
    words = documents(spark, sf_dir).select("doc_id", F.explode(F.split("text", "[ \\n]+")).alias("w")).filter(F.length("w") % 10 >= 3)
    return words.filter(R.matches_any_rule(F.col("w"), [*(r.literal for r in RULES), "ßß au"], [r"[0-9]{3}-[0-9]{4}"])).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_words"))


RECTS_SQL = "rects(page, x0, y0, x1, y1) AS (VALUES " + ", ".join(f"({p}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for p, a, b, c, d in RECTS) + ")"
BOXES_SQL = f"{RUNS_SQL}, {RECTS_SQL}, boxes AS (SELECT *, x AS bx0, y - 7.5 AS by0, x + width AS bx1, y + 2.5 AS by1 FROM runs)"


def _boxes(spark, sf_dir):
    found = runs(documents(spark, sf_dir)).selectExpr("doc_id", "page", "ln", "wn", "x AS x0", "y - 7.5D AS y0", "x + width AS x1", "y + 2.5D AS y1").alias("f")
    areas = F.broadcast(spark.createDataFrame(RECTS, "page int, x0 double, y0 double, x1 double, y1 double")).alias("a")
    f, a = (tuple(F.col(f"{t}.{c}") for c in ("x0", "y0", "x1", "y1")) for t in ("f", "a"))
    return found.join(areas, (F.col("f.page") == F.col("a.page")) & intersects(f, a)).select("f.*", contains(a, f).alias("whole"))


@query("area_text_marks", f"WITH {BOXES_SQL} SELECT doc_id, ln, wn FROM boxes b JOIN rects r ON b.page = r.page AND bx0 < r.x1 AND r.x0 < bx1 AND by0 < r.y1 AND r.y0 < by1")
def area_text_marks(spark, sf_dir):
    return _boxes(spark, sf_dir).select("doc_id", "ln", "wn")


@query("area_partial_or_whole", f"WITH {BOXES_SQL} SELECT doc_id, count(*) FILTER (r.x0 <= bx0 AND r.y0 <= by0 AND bx1 <= r.x1 AND by1 <= r.y1) AS n_whole, count(*) AS n_any FROM boxes b JOIN rects r ON b.page = r.page AND bx0 < r.x1 AND r.x0 < bx1 AND by0 < r.y1 AND r.y0 < by1 GROUP BY doc_id")
def area_partial_or_whole(spark, sf_dir):
    return _boxes(spark, sf_dir).groupBy("doc_id").agg(F.count_if("whole").alias("n_whole"), F.count(F.lit(1)).alias("n_any"))


@query("area_characters", f"""WITH {RUNS_SQL}, {RECTS_SQL}, met AS (SELECT doc_id, ln, wn, r.x0 AS rx, greatest(CAST(ceil((r.x0 - x) / 5.0 - 0.5) AS INT), 0) AS lo, least(CAST(floor((r.x1 - x) / 5.0 - 0.5) AS INT) + 1, length(text)) AS hi
FROM runs b JOIN rects r ON b.page = r.page AND x < r.x1 AND r.x0 < x + width AND y - 7.5 < r.y1 AND r.y0 < y + 2.5) SELECT doc_id, ln, wn, rx, lo, hi FROM met WHERE lo < hi""")
def area_characters(spark, sf_dir):
    """Characters of runs whose middle lies in an area."""
    found = runs(documents(spark, sf_dir)).alias("f")
    areas = F.broadcast(spark.createDataFrame(RECTS, "page int, x0 double, y0 double, x1 double, y1 double")).alias("a")
    c = lambda n: F.col(n)
    box = (c("f.x"), c("f.y") - 7.5, c("f.x") + c("f.width"), c("f.y") + 2.5)
    met = found.join(areas, (c("f.page") == c("a.page")) & intersects(box, tuple(c(f"a.{n}") for n in ("x0", "y0", "x1", "y1"))))
    n = F.length("f.text")
    lo, hi = character_range(c("f.x"), c("f.width"), n, c("a.x0"), c("a.x1"))
    return met.select("doc_id", "ln", "wn", c("a.x0").alias("rx"), lo.alias("lo"), hi.alias("hi")).filter("lo < hi")


@query("group_lines", f"""WITH RECURSIVE {RUNS_SQL}, seq AS (SELECT doc_id, page, ln, wn, x, y, row_number() OVER (PARTITION BY doc_id, page ORDER BY ln, wn) AS k FROM runs
), fold AS (
  SELECT doc_id, page, k, y AS anchor, 0 AS line FROM seq WHERE k = 1
  UNION ALL
  SELECT f.doc_id, f.page, s.k, CASE WHEN abs(s.y - f.anchor) < 0.5 THEN f.anchor ELSE s.y END, CASE WHEN abs(s.y - f.anchor) < 0.5 THEN f.line ELSE f.line + 1 END FROM fold f JOIN seq s ON s.doc_id = f.doc_id AND s.page = f.page AND s.k = f.k + 1
) SELECT doc_id, page, ln, wn, line, CAST(row_number() OVER (PARTITION BY doc_id, page, line ORDER BY x, k) - 1 AS INT) AS place FROM fold JOIN seq USING (doc_id, page, k)""")
def group_lines(spark, sf_dir):
    """Runs to lines by the first run's baseline (an ordered fold), each line from left to right."""
    return C.grouped_lines(page_runs(documents(spark, sf_dir)))


_HYPHENS_SQL = "[-\\x{AD}\\x{2010}\\x{2011}]"
_WORD_SQL = "[\\p{L}\\p{Nd}]"
CHAINS_SQL = f"""{RUNS_SQL}, prev AS (
  SELECT *, lag(x + width) OVER w AS pe, lag(y) OVER w AS py, lag(text) OVER w AS pt, lag(text, 2) OVER w AS ptt FROM runs WINDOW w AS (PARTITION BY doc_id, page ORDER BY ln, wn)
), cutted AS (
  SELECT *, pe IS NULL OR abs(y - py) > 0.3::DOUBLE * 10.0 OR x - pe < -5.0 OR x - pe > 25.0 AS new,
         x - pe > 0.70::DOUBLE * 5.0 AND NOT regexp_matches(right(pt, 1), '[\\s\\x{{A0}}]') AND NOT regexp_matches(left(text, 1), '[\\s\\x{{A0}}]') AS wide FROM prev
), told AS (
  SELECT *, CASE WHEN NOT new AND wide THEN ' ' ELSE '' END AS sep, lag(new) OVER w AS pnew, lag(NOT new AND wide) OVER w AS pwide FROM cutted WINDOW w AS (PARTITION BY doc_id, page ORDER BY ln, wn)
), going AS (
  SELECT *, new AND coalesce((regexp_matches(pt, '{_WORD_SQL}{_HYPHENS_SQL}$') OR (regexp_matches(pt, '^{_HYPHENS_SQL}$') AND NOT pnew AND NOT pwide AND regexp_matches(ptt, '{_WORD_SQL}$')))
    AND regexp_matches(text, '^{_WORD_SQL}') AND y > py AND y - py <= 25.0, false) AS goes_on FROM told
), gave AS (
  SELECT *, coalesce(lead(goes_on) OVER w, false) AS cut FROM going WINDOW w AS (PARTITION BY doc_id, page ORDER BY ln, wn)
), chained AS (
  SELECT doc_id, page, ln, wn, text AS drawn, CASE WHEN cut THEN text[:-2] ELSE text END AS text, sep, CAST(cut AS INT) AS cut, new,
         sum(CASE WHEN new AND NOT goes_on THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY ln, wn ROWS UNBOUNDED PRECEDING) AS chain FROM gave
)"""
#: Texts whose words are broken over lines, the hyphen in its word's run or in one of its own, or inside a line, where it stays.
BROKEN_SQL = "broken AS (SELECT doc_id, replace(replace(replace(text, 'tion', 'ti-' || chr(10) || 'on'), 'ing ', 'i - ' || chr(10) || 'ng '), 'ent', 'e- nt') AS text FROM documents)"


def _broken(spark, sf_dir):
    broken = F.replace(F.replace(F.replace("text", F.lit("tion"), F.lit("ti-\non")), F.lit("ing "), F.lit("i - \nng ")), F.lit("ent"), F.lit("e- nt"))
    return documents(spark, sf_dir).select("doc_id", broken.alias("text"))


@query("build_chains", f"WITH {CHAINS_SQL} SELECT doc_id, page, CAST(chain AS BIGINT) AS chain, string_agg(sep || text, '' ORDER BY ln, wn) AS text FROM chained GROUP BY doc_id, page, chain")
def build_chains(spark, sf_dir):
    return C.chain_rows(documents(spark, sf_dir)).drop("n_joined")


@query("hyphenated_chains", f"WITH {BROKEN_SQL}, {CHAINS_SQL.replace('FROM documents', 'FROM broken')} SELECT doc_id, page, CAST(chain AS BIGINT) AS chain, string_agg(sep || text, '' ORDER BY ln, wn) AS text, CAST(sum(cut) AS BIGINT) AS n_joined FROM chained GROUP BY doc_id, page, chain")
def hyphenated_chains(spark, sf_dir):
    """Chains of texts whose words are broken over lines."""
    return C.chain_rows(_broken(spark, sf_dir))


@query("chain_map_back", f"""WITH {BROKEN_SQL}, {CHAINS_SQL.replace('FROM documents', 'FROM broken')}, placed AS (
  SELECT *, sum(length(sep) + length(text)) OVER (PARTITION BY doc_id, page, chain ORDER BY ln, wn ROWS UNBOUNDED PRECEDING) AS hi FROM chained
), joined AS (SELECT doc_id, page, chain, string_agg(sep || text, '' ORDER BY ln, wn) AS t FROM chained GROUP BY ALL
), hits AS (SELECT doc_id, page, chain, list_sum([length(x) FOR x IN p[1:i]]) + (i - 1) * 4 AS lo FROM (SELECT doc_id, page, chain, string_split(t, 'tion') AS p FROM joined), unnest(range(1, len(p))) AS u(i)),
met AS (SELECT p.doc_id, p.page, p.ln, p.wn, CAST(greatest(h.lo - (p.hi - length(p.text)), 0) AS INT) AS run_lo, CAST(least(h.lo + 4, p.hi) - (p.hi - length(p.text)) + CASE WHEN h.lo + 4 >= p.hi THEN p.cut ELSE 0 END AS INT) AS run_hi
  FROM placed p JOIN hits h ON p.doc_id = h.doc_id AND p.page = h.page AND p.chain = h.chain AND h.lo < p.hi AND p.hi - length(p.text) < h.lo + 4
  UNION ALL SELECT p.doc_id, p.page, p.ln, p.wn, 0, 1 FROM placed p JOIN hits h ON p.doc_id = h.doc_id AND p.page = h.page AND p.chain = h.chain AND p.text = '' AND p.cut = 1 AND h.lo < p.hi AND p.hi < h.lo + 4)
SELECT doc_id, page, ln, wn, run_lo, run_hi FROM met WHERE run_lo < run_hi""")
def chain_map_back(spark, sf_dir):
    """Hits in a chain's text as ranges of its runs, by binary search."""
    return C.chain_hits(_broken(spark, sf_dir), "tion").withColumnsRenamed({"lo": "run_lo", "hi": "run_hi"})


@query("page_text", f"WITH {CHAINS_SQL} SELECT doc_id, page, sha256(string_agg(CASE WHEN wn = first_wn AND NOT first_row THEN chr(10) ELSE sep END || drawn, '' ORDER BY ln, wn)) AS text_sha256 FROM (SELECT *, min(wn) OVER (PARTITION BY doc_id, page, ln) AS first_wn, row_number() OVER (PARTITION BY doc_id, page ORDER BY ln, wn) = 1 AS first_row FROM chained) GROUP BY doc_id, page")
def page_text(spark, sf_dir):
    """A page's text: a new line where the line changes, a space where the gap calls for one."""
    return C.page_texts(documents(spark, sf_dir)).select("doc_id", "page", F.sha2("text", 256).alias("text_sha256"))


WRAP = 40


@query("greedy_wrap", f"""WITH l AS (SELECT doc_id, u.i - 1 AS ln, ls[u.i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS u(i))
SELECT doc_id, CAST(ln AS INT) AS ln, array_to_string(regexp_extract_all(trim(regexp_replace(line, ' +', ' ', 'g')), '([^ ](?:.{{0,{WRAP - 2}}}[^ ])?)(?: |$)|([^ ]+)(?: |$)', 0), '|') AS wrapped FROM l""")
def greedy_wrap(spark, sf_dir):
    """Words to lines of at most 40 characters, longer words alone: where lines begin is a fold over the words."""
    words = F.filter(F.split("line", " +"), lambda w: w != "")
    return lines(documents(spark, sf_dir)).select("doc_id", "ln", F.array_join(C.wrapped(words, WRAP), " |").alias("wrapped"))


PARA_SQL = """lines AS (SELECT doc_id, u.i - 1 AS ln, ls[u.i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS u(i)
), geo AS (SELECT doc_id, ln, length(line) AS n, CASE WHEN line LIKE '%|%' THEN 20.0::DOUBLE ELSE 0.0::DOUBLE END AS x, CASE WHEN length(line) % 4 = 0 THEN 18.0::DOUBLE ELSE 14.0::DOUBLE END AS gap FROM lines)"""


@query("paragraphs", f"""WITH RECURSIVE {PARA_SQL}, fold AS (
  SELECT doc_id, ln, x AS fx, 0 AS para, NULL::DOUBLE AS pitch FROM geo WHERE ln = 0
  UNION ALL
  SELECT doc_id, ln, CASE WHEN j THEN fx ELSE x END, CASE WHEN j THEN para ELSE para + 1 END, CASE WHEN j THEN gap END
  FROM (SELECT g.doc_id, g.ln, f.fx, f.para, f.pitch, g.x, g.gap, abs(g.x - f.fx) <= 0.5 AND g.gap > 0.1 AND g.gap <= 25 AND (f.pitch IS NULL OR abs(g.gap - f.pitch) <= 0.5) AS j FROM fold f JOIN geo g ON g.doc_id = f.doc_id AND g.ln = f.ln + 1)
) SELECT doc_id, para, CAST(min(ln) AS INT) AS first_ln, count(*) AS n_lines FROM fold GROUP BY doc_id, para""")
def paragraphs(spark, sf_dir):
    """Lines with one left edge and one leading: an ordered fold inside each document's row."""
    texts = documents(spark, sf_dir).select("doc_id", F.split("text", "\n").alias("lines"))
    gaps = F.transform("lines", lambda l: F.when(F.length(l) % 4 == 0, 18.0).otherwise(14.0))
    placed = let(running_sums(gaps, "double"), lambda y: F.transform("lines", lambda l, i: F.struct(F.when(F.contains(l, F.lit("|")), 20.0).otherwise(0.0).alias("x"), F.get(y, i).alias("y"), F.lit(10.0).alias("size"))))
    # Paragraphs are numbered in order: each begins at the head of its run of numbers.
    heads = let(C.paragraph_numbers(placed), lambda n: let(heads_where(n, lambda p, i: (i == 0) | (F.get(n, i - 1) != p)), lambda h: F.transform(h, lambda at, i: F.struct(i.alias("para"), at.alias("first_ln"), (F.coalesce(F.get(h, i + 1), F.size(n)) - at).cast("long").alias("n_lines")))))
    return texts.select("doc_id", F.inline(heads))


@query("flow_shift", f"WITH {PARA_SQL} SELECT doc_id, CAST(ln AS INT) AS ln, CAST(coalesce(sum(n // 80) OVER (PARTITION BY doc_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) * 14 AS shift FROM geo")
def flow_shift(spark, sf_dir):
    """How far each paragraph moves down for the lines that those above it gained."""
    gained = F.transform(F.split("text", "\n"), lambda l: F.floor(F.length(l) / 80).cast("long"))
    shifts = let(gained, lambda g: F.zip_with(running_sums(g, "long"), g, lambda s, own: (s - own) * 14))
    return documents(spark, sf_dir).select("doc_id", F.posexplode(shifts).alias("ln", "shift"))


@query("single_run_blocks", f"WITH {RUNS_SQL} SELECT doc_id, ln, any_value(text) AS text FROM runs GROUP BY doc_id, ln HAVING count(*) = 1")
def single_run_blocks(spark, sf_dir):
    """Blocks take lines of one run; a line of several runs isn't emitted."""
    alone = lambda a: F.filter(F.transform(a, lambda r, i: F.when(~F.coalesce(F.get(a, i - 1)["ln"] == r["ln"], F.lit(False)) & ~F.coalesce(F.get(a, i + 1)["ln"] == r["ln"], F.lit(False)), F.struct(r["ln"].alias("ln"), r["text"].alias("text")))), lambda r: r.isNotNull())
    return page_runs(documents(spark, sf_dir)).select("doc_id", F.inline(alone(F.col("runs"))))


@query("strict_tokens", """WITH allowed AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM benchmark), t AS (
  SELECT doc_id, u.i AS pos, ws[u.i] AS token FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM documents), unnest(range(1, len(ws) + 1)) AS u(i))
SELECT doc_id, CAST(min(pos) - 1 AS INT) AS pos, arg_min(token, pos) AS token FROM t WHERE token NOT IN (SELECT token FROM allowed) GROUP BY doc_id""")
def strict_tokens(spark, sf_dir):
    """The first token of each document that isn't on the allow-list."""
    token = lambda t: F.regexp_extract_all(F.lower(t), F.lit("[a-z]+"), F.lit(0))
    allowed = table(spark, sf_dir, "benchmark").select(F.explode(token("text")).alias("token")).distinct()
    tokens = documents(spark, sf_dir).select("doc_id", F.posexplode(token("text")).alias("pos", "token"))
    found = tokens.join(allowed, "token", "left_anti")
    return found.groupBy("doc_id").agg(F.min("pos").alias("pos"), F.min_by("token", "pos").alias("token"))


@query("decode_text_strings", "SELECT doc_id, sha256(text) AS text_sha256 FROM documents")
def decode_text_strings(spark, sf_dir):
    """Text strings are UTF-16BE behind a byte order mark, else a byte a character."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    wide = F.col("text").rlike(r"[^\x00-\xFF]")
    raw = F.when(wide, F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE"))).otherwise(F.encode(F.when(~wide, F.col("text")).otherwise(F.lit("")), "ISO-8859-1"))
    marked = F.hex(F.substring("raw", 1, 2)) == "FEFF"
    narrow = F.decode(F.when(marked, F.unhex(F.lit(""))).otherwise(F.col("raw")), "ISO-8859-1")
    broad = F.decode(F.when(marked, F.expr("substring(raw, 3)")).otherwise(F.unhex(F.lit(""))), "UTF-16BE")
    return docs.withColumn("raw", raw).select("doc_id", F.sha2(F.when(marked, broad).otherwise(narrow), 256).alias("text_sha256"))


@query("merge_spans", """WITH s AS (SELECT conv_id, turn, text, role IN ('user', 'system') AS plain, length(text) % 3 = 0 AS inserted, CASE WHEN turn % 5 = 4 THEN 1.0 ELSE 0.0 END AS gap FROM conversations),
m AS (SELECT *, lag(plain) OVER w AS p, lag(inserted) OVER w AS i, lag(gap) OVER w AS g FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
n AS (SELECT *, sum(CASE WHEN p = plain AND i = inserted AND g = 0 AND gap = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS part FROM m)
SELECT conv_id, min(turn) AS ord, CAST(count(*) AS INT) AS n_spans, sha256(string_agg(text, '' ORDER BY turn)) AS text_sha256 FROM n GROUP BY conv_id, part""")
def merge_spans_query(spark, sf_dir):
    """Turns as spans: a role gives the style, a text's length whether it was inserted, every fifth turn has a gap before it."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ord"), "text", F.col("role").isin("user", "system").alias("style"), (F.length("text") % 3 == 0).alias("inserted"), F.when(F.col("turn") % 5 == 4, 1.0).otherwise(0.0).alias("gap"), F.lit(False).alias("line_break"))
    return merge_spans(turns, ["conv_id"]).select("conv_id", "ord", "n_spans", F.sha2("text", 256).alias("text_sha256"))


_REGULAR_SQL = "[^\\x00\\t\\n\\f\\r ()<>\\[\\]{}/%\\x01\\x02]"


@query("apply_splices", f"""WITH m AS (SELECT doc_id, replace(replace(text, 'an', chr(1) || 'X' || chr(2)), chr(2) || chr(1), ' ') AS t FROM documents)
SELECT doc_id, sha256(translate(regexp_replace(regexp_replace(t, '({_REGULAR_SQL})\\x01', '\\1 ', 'g'), '\\x02({_REGULAR_SQL})', ' \\1', 'g'), chr(1) || chr(2), '')) AS text_sha256 FROM m""")
def apply_splices_query(spark, sf_dir):
    """Every hit of a literal, in words too, as an ordered rewrite of its text that keeps tokens apart."""
    spliced = apply_splices(F.col("text"), literal_splices(F.col("text"), "an", "X"))
    return documents(spark, sf_dir).select("doc_id", F.sha2(spliced, 256).alias("text_sha256"))
