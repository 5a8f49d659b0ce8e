"""Queries of the document plane: pages, labels, structure, graphs, revisions, fields, attachments, audit, colour, dates.

The given tables stand in for document objects: an order and its lines are an object and its parts, an event stream is a
page sequence, HTML pages are tagged documents. Every query reads whole tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions.dates import document_date, xmp_date
from pageloom.functions.geometry import MODES, blend, blended_rgb, nearest_whole, rotation
from pageloom.functions.labels import format_label
from pageloom.operators.graph import chain_ends, reachable
from pageloom.sources.scratch import written
from pageloom.sources.tables import spread, table

from .registry import query

ROMAN_SQL = "(['','m','mm','mmm'])[CAST({n} AS BIGINT) // 1000 % 10 + 1] || (['','c','cc','ccc','cd','d','dc','dcc','dccc','cm'])[CAST({n} AS BIGINT) // 100 % 10 + 1] || (['','x','xx','xxx','xl','l','lx','lxx','lxxx','xc'])[CAST({n} AS BIGINT) // 10 % 10 + 1] || (['','i','ii','iii','iv','v','vi','vii','viii','ix'])[CAST({n} AS BIGINT) % 10 + 1]"


def label_sql(style: str, n: str) -> str:
    roman = f"CASE WHEN {n} > 3999 THEN CAST({n} AS VARCHAR) ELSE {ROMAN_SQL.format(n=n)} END"
    letters = f"repeat(chr(CAST(97 + ({n} - 1) % 26 AS INT)), CAST(({n} - 1) // 26 + 1 AS INT))"
    return f"CASE WHEN {n} < 1 THEN '' WHEN {style} = 'D' THEN CAST({n} AS VARCHAR) WHEN {style} = 'r' THEN {roman} WHEN {style} = 'R' THEN upper({roman}) WHEN {style} = 'a' THEN {letters} WHEN {style} = 'A' THEN upper({letters}) ELSE '' END"


@query("format_label", f"SELECT p_partkey AS n, s.style, {label_sql('s.style', 'p_partkey')} AS label FROM part, (VALUES ('D'), ('r'), ('R'), ('a'), ('A'), ('none')) AS s(style)")
def format_label_query(spark, sf_dir):
    """Every part's key in six styles. A label of letters is as long as its number is large, so keys are dealt to all cores."""
    styles = F.explode(F.array(*map(F.lit, ("D", "r", "R", "a", "A", "none"))))
    return spread(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("n"))).select("n", styles.alias("style")).withColumn("label", format_label(F.col("style"), F.col("n")))


@query("page_label_asof", f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS page FROM events),
r AS (SELECT user_id, page AS from_page, CASE event_type WHEN 'signup' THEN 'r' ELSE 'A' END AS style, CAST(substr(props, 7, length(props) - 7) AS BIGINT) AS start FROM p WHERE event_type IN ('signup', 'purchase')),
j AS (SELECT p.event_id, p.page, r.from_page, r.style, r.start FROM p ASOF LEFT JOIN r ON p.user_id = r.user_id AND p.page >= r.from_page)
SELECT event_id, CASE WHEN from_page IS NULL THEN CAST(page + 1 AS VARCHAR) ELSE CASE style WHEN 'A' THEN 'A-' ELSE '' END || {label_sql('style', '(start + page - from_page)')} END AS label FROM j""")
def page_label_asof(spark, sf_dir):
    """Each page takes the last label range that starts at or before it, its prefix first: the range is carried forward by a window."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pages = table(spark, sf_dir, "events").withColumn("page", (F.row_number().over(order) - 1).cast("long"))
    begins = F.col("event_type").isin("signup", "purchase")
    style = F.when(F.col("event_type") == "signup", "r").otherwise("A")
    start = F.get_json_object("props", "$.k").cast("long")
    last = F.last(F.when(begins, F.struct(F.col("page").alias("at"), style.alias("style"), start.alias("start"), F.when(style == "A", "A-").otherwise("").alias("prefix"))), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = pages.withColumn("r", last)
    label = F.when(F.col("r").isNull(), (F.col("page") + 1).cast("string")).otherwise(F.concat("r.prefix", format_label(F.col("r.style"), F.col("r.start") + F.col("page") - F.col("r.at"))))
    return rows.select("event_id", label.alias("label"))


@query("newest_revision", "SELECT l_partkey, arg_max(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice)) AS price, max(l_shipdate) AS revised FROM lineitem GROUP BY l_partkey")
def newest_revision(spark, sf_dir):
    """Of all definitions of an object the newest counts."""
    rank = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.max_by("l_extendedprice", rank).alias("price"), F.max("l_shipdate").alias("revised"))


@query("xref_patch", """WITH s AS (SELECT l_partkey AS num, max(l_orderkey) AS found FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_partkey), x AS (SELECT p_partkey AS num, p_partkey * 7 AS listed FROM part WHERE p_size <> 11)
SELECT coalesce(x.num, s.num) AS num, coalesce(s.found, x.listed) AS off, CASE WHEN x.num IS NULL THEN 'added' WHEN s.num IS NULL THEN 'listed' WHEN s.found <> x.listed THEN 'fixed' ELSE 'same' END AS state FROM x FULL JOIN s ON x.num = s.num""")
def xref_patch(spark, sf_dir):
    """The listed offsets against those a scan finds: wrong ones fixed, missing ones added."""
    scan = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'N'").groupBy(F.col("l_partkey").alias("num")).agg(F.max("l_orderkey").alias("found"))
    listed = table(spark, sf_dir, "part").filter("p_size <> 11").select(F.col("p_partkey").alias("num"), (F.col("p_partkey") * 7).alias("listed"))
    state = F.when(F.col("listed").isNull(), "added").when(F.col("found").isNull(), "listed").when(F.col("found") != F.col("listed"), "fixed").otherwise("same")
    return listed.join(scan, "num", "full").select("num", F.coalesce("found", "listed").alias("off"), state.alias("state"))


@query("overlay_objects", """WITH u AS (SELECT l_partkey AS num, round(max(l_extendedprice), 2) AS price FROM lineitem WHERE l_quantity > 45 GROUP BY 1)
SELECT p_partkey AS num, coalesce(u.price, p_retailprice) AS price, u.num IS NOT NULL AS replaced FROM part LEFT JOIN u ON u.num = p_partkey""")
def overlay_objects(spark, sf_dir):
    """Replaced objects over the originals; what isn't there can't be replaced."""
    new = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").groupBy(F.col("l_partkey").alias("num")).agg(F.round(F.max("l_extendedprice"), 2).alias("new"))
    old = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("num"), "p_retailprice")
    return old.join(new, "num", "left").select("num", F.coalesce("new", "p_retailprice").alias("price"), F.col("new").isNotNull().alias("replaced"))


def _edges(spark, sf_dir) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    named = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    parts = [
        t("nation").select(named("r", "n_regionkey").alias("src"), named("n", "n_nationkey").alias("dst")),
        t("customer").select(named("n", "c_nationkey").alias("src"), named("c", "c_custkey").alias("dst")),
        t("orders").select(named("c", "o_custkey").alias("src"), named("o", "o_orderkey").alias("dst")),
        t("orders").filter("o_orderpriority = '1-URGENT'").select(named("o", "o_orderkey").alias("src"), named("c", "o_custkey").alias("dst")),
    ]
    return reduce(DataFrame.unionByName, parts)


EDGES_SQL = """edges AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
  UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"""


@query("reachability", f"WITH RECURSIVE {EDGES_SQL}, seen AS (SELECT 'r' || r_regionkey AS node FROM region WHERE r_name = 'ASIA' UNION SELECT e.dst FROM seen JOIN edges e ON e.src = seen.node) SELECT node FROM seen")
def reachability(spark, sf_dir):
    roots = table(spark, sf_dir, "region").filter("r_name = 'ASIA'").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    return reachable(_edges(spark, sf_dir), roots)


@query("unreachable_objects", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_shipdate >= TIMESTAMP '2001-01-01')")
def unreachable_objects(spark, sf_dir):
    """Objects that nothing refers to: what a rewrite leaves out."""
    live = table(spark, sf_dir, "lineitem").filter("l_shipdate >= timestamp'2001-01-01'").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").join(live, "p_partkey", "left_anti").select("p_partkey")


#: A heading: from its tag, with or without attributes, to the end tag; inner tags are no text.
HEADING = r"(?is)<h[1-6]\b[^>]*>.*?</h[1-6]\s*>"
#: What no reader sees, and the tags between which blocks of text lie.
UNSEEN = r"(?is)<!--.*?-->|<(?:head|script|style|template)\b[^>]*>.*?</(?:head|script|style|template)\s*>"
BLOCK_TAG = r"(?is)</?(?:h[1-6]|p|li|ul|ol|dl|dt|dd|table|thead|tbody|tr|td|th|caption|blockquote|pre|figure|figcaption|div|section|article|main|aside|header|footer|nav|form|fieldset|address|body|html|hr|br)\b[^>]*>"
TEXT_SQL = "trim(regexp_replace(regexp_replace({0}, '<[^>]*>', '', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))"


def _each_sql(pattern: str) -> str:
    return f"SELECT page_id, u.i AS ord, hs[u.i] AS h FROM (SELECT page_id, regexp_extract_all(html, '{pattern}') AS hs FROM pages), unnest(range(1, len(hs) + 1)) AS u(i)"


def _inner_text(block):
    return F.trim(F.regexp_replace(F.regexp_replace(block, "<[^>]*>", ""), "[ \\t\\r\\n]+", " "))


@query("struct_outline", f"SELECT page_id, CAST(ord - 1 AS INT) AS ord, CAST(substr(h, 3, 1) AS INT) AS level, {TEXT_SQL.format('h')} AS title FROM ({_each_sql(HEADING)})")
def struct_outline(spark, sf_dir):
    """Headings in order with their level and whole text, inline tags left out."""
    found = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(HEADING), F.lit(0))).alias("ord", "h"))
    return found.select("page_id", "ord", F.substring("h", 3, 1).cast("int").alias("level"), _inner_text(F.col("h")).alias("title"))


_PARTS_SQL = f"[trim(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) FOR x IN string_split(regexp_replace(regexp_replace(html, '{UNSEEN}', '', 'g'), '{BLOCK_TAG}', chr(1), 'g'), chr(1))]"


@query("struct_text", f"SELECT page_id, CAST(len(b) AS BIGINT) AS n_nodes, sha256(array_to_string(b, chr(10))) AS text_sha256 FROM (SELECT page_id, list_filter({_PARTS_SQL}, lambda x: x <> '') AS b FROM pages) WHERE len(b) > 0")
def struct_text(spark, sf_dir):
    """Text of all leaf blocks in order, a line each: whatever lies between the tags of blocks, of every kind."""
    seen = F.regexp_replace(F.regexp_replace("html", UNSEEN, ""), BLOCK_TAG, "\x01")
    blocks = F.filter(F.transform(F.split(seen, "\x01"), _inner_text), lambda t: t != "")
    return table(spark, sf_dir, "pages").select("page_id", blocks.alias("b")).filter(F.size("b") > 0).select("page_id", F.size("b").cast("long").alias("n_nodes"), F.sha2(F.array_join("b", "\n"), 256).alias("text_sha256"))


HREF = r"""(?i)\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
_HREF_SQL = HREF.replace("'", "''")


@query("link_annotations", f"SELECT page_id, u.i - 1 AS ord, regexp_replace(ls[u.i], '^[\"'']|[\"'']$', '', 'g') AS url FROM (SELECT page_id, regexp_extract_all(html, '{_HREF_SQL}', 1) AS ls FROM pages), unnest(range(1, len(ls) + 1)) AS u(i)")
def link_annotations(spark, sf_dir):
    """Addresses of links, in double, single or no quotes."""
    found = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("ord", "url"))
    return found.withColumn("url", F.regexp_replace("url", "^[\"']|[\"']$", ""))


#: Fields by the pattern that finds them: an element's whole text, or a value in double, single or no quotes.
_VALUE = r"""("[^"]*"|'[^']*'|[^\s>"']+)"""
METADATA = {
    "title": r"(?is)<title\b[^>]*>(.*?)</title\s*>",
    "lang": rf"(?is)<html\b[^>]*?\slang\s*=\s*{_VALUE}",
    "charset": r"""(?is)<meta\b[^>]*?\bcharset\s*=\s*["']?([A-Za-z0-9_:.-]+)""",
    **{name: rf"""(?is)<meta\b[^>]*?\sname\s*=\s*["']?{name}["']?\s[^>]*?\bcontent\s*=\s*{_VALUE}""" for name in ("author", "description", "keywords", "generator")},
}


def _field_sql(pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    found = f"regexp_extract(html, '{quoted}', 1)"
    return f"trim(regexp_replace(regexp_replace(regexp_replace({found}, '^[\"'']|[\"'']$', '', 'g'), '<[^>]*>', '', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))"


@query("metadata_fields", "SELECT page_id, " + ", ".join(f"{_field_sql(p)} AS {n}" for n, p in METADATA.items()) + " FROM pages")
def metadata_fields(spark, sf_dir):
    """Descriptive fields found by searching the text, not by parsing it."""
    find = lambda p: _inner_text(F.regexp_replace(F.regexp_extract("html", p, 1), "^[\"']|[\"']$", ""))
    return table(spark, sf_dir, "pages").select("page_id", *(find(p).alias(n) for n, p in METADATA.items()))


_STRIPPED = ("title", "script", "style")
_STRIP_SQL = "html"
for _tag in _STRIPPED:
    _STRIP_SQL = f"regexp_replace({_STRIP_SQL}, '(?is)(<{_tag}\\b[^>]*>).*?(</{_tag}\\s*>)', '\\1\\2', 'g')"


@query("strip_metadata", f"SELECT page_id, length({_STRIP_SQL}) AS n_left, sha256({_STRIP_SQL}) AS left_sha256 FROM pages")
def strip_metadata(spark, sf_dir):
    """Titles, scripts and styles emptied up to their end tags, the rest as it was."""
    html = F.col("html")
    for tag in _STRIPPED:
        html = F.regexp_replace(html, rf"(?is)(<{tag}\b[^>]*>).*?(</{tag}\s*>)", "$1$2")
    return table(spark, sf_dir, "pages").select("page_id", html.alias("left")).select("page_id", F.length("left").cast("long").alias("n_left"), F.sha2("left", 256).alias("left_sha256"))


AUDIT = {"script": r"<script", "open": r"</html>", "noise": r"<h1>[^<]*[%$#*]", "link": r'href=""'}


@query("audit_rules", "SELECT page_id, 'script' AS rule FROM pages WHERE regexp_matches(html, '<script') UNION ALL SELECT page_id, 'open' FROM pages WHERE NOT regexp_matches(html, '</html>') UNION ALL SELECT page_id, 'noise' FROM pages WHERE regexp_matches(html, '<h1>[^<]*[%$#*]') UNION ALL SELECT page_id, 'link' FROM pages WHERE regexp_matches(html, 'href=\"\"')")
def audit_rules(spark, sf_dir):
    """One row per broken rule."""
    found = {rule: F.col("html").rlike(pattern) for rule, pattern in AUDIT.items()}
    found["open"] = ~found["open"]
    broken = F.filter(F.array(*(F.when(cond, F.lit(rule)) for rule, cond in found.items())), lambda r: r.isNotNull())
    return table(spark, sf_dir, "pages").select("page_id", F.explode(broken).alias("rule"))


@query("distinct_fields", "SELECT user_id, event_type AS name, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_type) AS INT) AS ord FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events) WHERE rn = 1")
def distinct_fields(spark, sf_dir):
    """The first field of each name, sorted by name."""
    first = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    rows = table(spark, sf_dir, "events").withColumn("rn", first).filter("rn = 1")
    return rows.select("user_id", F.col("event_type").alias("name"), "value", F.row_number().over(Window.partitionBy("user_id").orderBy("event_type")).alias("ord"))


@query("fill_validation", """WITH f AS (SELECT 'A' AS flag, 30.0 AS most UNION ALL SELECT 'R', 40.0)
SELECT l_returnflag AS name, CASE WHEN f.flag IS NULL THEN 'unknown field' WHEN l_quantity > most THEN 'too long' ELSE 'ok' END AS verdict, count(*) AS n FROM lineitem LEFT JOIN f ON f.flag = l_returnflag GROUP BY 1, 2""")
def fill_validation(spark, sf_dir):
    """Values against their fields; all of them are checked."""
    fields = F.broadcast(spark.createDataFrame([("A", 30.0), ("R", 40.0)], "name string, most double"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("name"), "l_quantity").join(fields, "name", "left")
    verdict = F.when(F.col("most").isNull(), "unknown field").when(F.col("l_quantity") > F.col("most"), "too long").otherwise("ok")
    return rows.groupBy("name", verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("attachments", """WITH c AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'A'), p AS (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'A')
SELECT l_orderkey, l_partkey, -1 AS page FROM c UNION ALL SELECT l_orderkey, l_partkey, l_linenumber FROM p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.l_orderkey = p.l_orderkey AND c.l_partkey = p.l_partkey)""")
def attachments(spark, sf_dir):
    """The collection first, with page -1; then what pages hold and the collection doesn't."""
    rows, key = table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"]
    listed = rows.filter("l_returnflag = 'A'").select(*key).distinct()
    clips = rows.filter("l_returnflag <> 'A'").select(*key, F.col("l_linenumber").alias("page")).distinct().join(listed, key, "left_anti")
    return listed.withColumn("page", F.lit(-1)).unionByName(clips)


@query("page_order", """SELECT conv_id, array_to_string(list_concat(p[2:], p[:1]), ' ') AS moved, array_to_string(list_concat(p[:1], p[3:]), ' ') AS removed, len(list_distinct(p)) = len(p) AS valid
FROM (SELECT conv_id, list(turn ORDER BY turn) AS p FROM conversations GROUP BY conv_id)""")
def page_order(spark, sf_dir):
    """The first page moved to the end; the second removed; whether the order is a permutation."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("p"))
    tail = lambda n: F.slice("p", n, F.size("p"))
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), " ")
    return rows.select("conv_id", text(F.concat(tail(2), F.slice("p", 1, 1))).alias("moved"), text(F.concat(F.slice("p", 1, 1), tail(3))).alias("removed"), (F.size(F.array_distinct("p")) == F.size("p")).alias("valid"))


@query("merge_pages", "SELECT source, page_id, row_number() OVER (PARTITION BY host ORDER BY source, page_id) AS page, host FROM (SELECT 1 AS source, page_id, regexp_extract(url, '//([^/]+)', 1) AS host FROM pages WHERE url LIKE 'https:%' UNION ALL SELECT 2, page_id, regexp_extract(url, '//([^/]+)', 1) FROM pages WHERE url NOT LIKE 'https:%')")
def merge_pages(spark, sf_dir):
    """Page sequences one after the other, in the order of their sources."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", "//([^/]+)", 1).alias("host"))
    both = pages.filter("url LIKE 'https:%'").withColumn("source", F.lit(1)).unionByName(pages.filter("url NOT LIKE 'https:%'").withColumn("source", F.lit(2)))
    return both.select("source", "page_id", F.row_number().over(Window.partitionBy("host").orderBy("source", "page_id")).cast("long").alias("page"), "host")


@query("extract_pages", "SELECT c.conv_id, u.pos, c.turn, c.role FROM (SELECT unnest([2, 0, 0, 1]) AS turn, unnest([0, 1, 2, 3]) AS pos) u JOIN conversations c ON c.turn = u.turn")
def extract_pages(spark, sf_dir):
    """Pages in the order asked for, repeats allowed."""
    wanted = F.broadcast(spark.createDataFrame([(0, 2), (1, 0), (2, 0), (3, 1)], "pos int, turn long"))
    return table(spark, sf_dir, "conversations").join(wanted, "turn").select("conv_id", "pos", "turn", "role")


@query("page_rotation", "SELECT o_orderkey, CAST((((o_custkey - 700) % 360 + 360) % 360) // 90 * 90 AS BIGINT) AS deg FROM orders")
def page_rotation(spark, sf_dir):
    deg = F.pmod(F.col("o_custkey") - 700, F.lit(360))
    return table(spark, sf_dir, "orders").select("o_orderkey", (deg - deg % 90).cast("long").alias("deg"))


@query("image_rotation", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(((degrees(atan2(-(l_discount - 0.05), l_tax - 0.04)) % 360) + 360) % 360, 4) AS deg FROM lineitem")
def image_rotation(spark, sf_dir):
    deg = rotation(F.col("l_tax") - 0.04, F.col("l_discount") - 0.05)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(deg, 4).alias("deg"))


_B, _S = "(l_discount * 10)", "(l_tax * 10)"
BLEND_SQL = {
    "Normal": f"{_S}", "Multiply": f"{_B} * {_S}", "Screen": f"{_B} + {_S} - {_B} * {_S}", "Darken": f"least({_B}, {_S})", "Lighten": f"greatest({_B}, {_S})",
    "Difference": f"abs({_B} - {_S})", "Exclusion": f"{_B} + {_S} - 2 * {_B} * {_S}",
    "HardLight": f"CASE WHEN {_S} <= 0.5 THEN {_B} * 2 * {_S} ELSE {_B} + (2 * {_S} - 1) - {_B} * (2 * {_S} - 1) END",
    "Overlay": f"CASE WHEN {_B} <= 0.5 THEN {_S} * 2 * {_B} ELSE {_S} + (2 * {_B} - 1) - {_S} * (2 * {_B} - 1) END",
    "ColorDodge": f"CASE WHEN {_B} <= 0 THEN 0 WHEN {_S} >= 1 THEN 1 ELSE least(1.0, {_B} / (1 - {_S})) END",
    "ColorBurn": f"CASE WHEN {_B} >= 1 THEN 1 WHEN {_S} <= 0 THEN 0 ELSE 1 - least(1.0, (1 - {_B}) / {_S}) END",
    "SoftLight": f"CASE WHEN {_S} <= 0.5 THEN {_B} - (1 - 2 * {_S}) * {_B} * (1 - {_B}) ELSE {_B} + (2 * {_S} - 1) * (CASE WHEN {_B} <= 0.25 THEN ((16 * {_B} - 12) * {_B} + 4) * {_B} ELSE sqrt({_B}) END - {_B}) END",
}


@query("blend_modes", " UNION ALL ".join(f"SELECT l_partkey, '{m}' AS mode, CAST(sum(CAST(round(({e}) * 10000) AS BIGINT)) AS BIGINT) AS total FROM lineitem GROUP BY l_partkey" for m, e in BLEND_SQL.items()))
def blend_modes(spark, sf_dir):
    """Each blend mode summed over an object's samples, in ten-thousandths."""
    b, s = F.col("l_discount") * 10, F.col("l_tax") * 10
    sums = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(*(F.sum(nearest_whole(blend(m, b, s) * 10000)).alias(m) for m in MODES))
    return sums.unpivot("l_partkey", list(MODES), "mode", "total")


_LUM = "(0.3::DOUBLE * {0}[1] + 0.59::DOUBLE * {0}[2] + 0.11::DOUBLE * {0}[3])"
_SAT = "(list_max({0}) - list_min({0}))"
_TO_SAT = "CASE WHEN list_max({0}) = list_min({0}) THEN [0.0::DOUBLE, 0.0, 0.0] ELSE [(x - list_min({0})) * {1} / (list_max({0}) - list_min({0})) FOR x IN {0}] END"
RGB_SQL = f"""WITH c AS (SELECT l_partkey, [l_discount * 10, l_tax * 10, l_quantity / 50] AS b, [l_tax * 12, l_quantity / 50, l_discount * 9] AS s FROM lineitem
), m AS (
  SELECT l_partkey, 'Hue' AS mode, {_TO_SAT.format('s', _SAT.format('b'))} AS c, {_LUM.format('b')} AS l FROM c UNION ALL SELECT l_partkey, 'Saturation', {_TO_SAT.format('b', _SAT.format('s'))}, {_LUM.format('b')} FROM c
  UNION ALL SELECT l_partkey, 'Color', s, {_LUM.format('b')} FROM c UNION ALL SELECT l_partkey, 'Luminosity', b, {_LUM.format('s')} FROM c
), d AS (SELECT l_partkey, mode, [x + (l - {_LUM.format('c')}) FOR x IN c] AS c FROM m
), e AS (SELECT l_partkey, mode, c, {_LUM.format('c')} AS l, list_min(c) AS lo, list_max(c) AS hi FROM d
), f AS (SELECT l_partkey, mode, l, hi, CASE WHEN lo < 0 AND l <> lo THEN [l + (x - l) * l / (l - lo) FOR x IN c] ELSE c END AS c FROM e
), g AS (SELECT l_partkey, mode, CASE WHEN hi > 1 AND hi <> l THEN [l + (x - l) * (1 - l) / (hi - l) FOR x IN c] ELSE c END AS c FROM f)
SELECT l_partkey, mode, CAST(sum(CAST(round(c[1] * 1000) AS BIGINT)) AS BIGINT) AS r, CAST(sum(CAST(round(c[2] * 1000) AS BIGINT)) AS BIGINT) AS g, CAST(sum(CAST(round(c[3] * 1000) AS BIGINT)) AS BIGINT) AS b FROM g GROUP BY l_partkey, mode"""


@query("blend_colours", RGB_SQL)
def blend_colours(spark, sf_dir):
    """The four modes that mix whole colours, summed over an object's samples, in thousandths."""
    c = F.col
    backdrop, source = F.array(c("l_discount") * 10, c("l_tax") * 10, c("l_quantity") / 50), F.array(c("l_tax") * 12, c("l_quantity") / 50, c("l_discount") * 9)
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", backdrop.alias("b"), source.alias("s"))
    total = lambda i: F.sum(nearest_whole(c(f"c{i}") * 1000))
    return blended_rgb(rows, "b", "s", ["l_partkey"]).groupBy("l_partkey", "mode").agg(total(0).alias("r"), total(1).alias("g"), total(2).alias("b"))


def _channel_sql(ink: str) -> str:
    return f"CAST(round(255 * (greatest(0, least(1, 1 - {ink})) * greatest(0, least(1, 1 - l_tax * 8)))) AS INT)"


@query("cmyk_to_rgb", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_channel_sql('l_discount * 8')} AS r, {_channel_sql('l_quantity / 50')} AS g, {_channel_sql('l_extendedprice / 80000')} AS b FROM lineitem")
def cmyk_to_rgb(spark, sf_dir):
    """Without a profile: each channel is what its ink and black leave, (1 - ink)(1 - black)."""
    left = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - c))
    channel = lambda c: F.round(255 * (left(c) * left(F.col("l_tax") * 8))).cast("int")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", channel(F.col("l_discount") * 8).alias("r"), channel(F.col("l_quantity") / 50).alias("g"), channel(F.col("l_extendedprice") / 80000).alias("b"))


@query("fit_size", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(greatest(least(10.0, 10.0 * (l_quantity * 4) / (l_extendedprice / 500 + 1)), 4.5), 4) AS size, 10.0 * (l_quantity * 4) / (l_extendedprice / 500 + 1) < 4.5 AS too_wide FROM lineitem")
def fit_size(spark, sf_dir):
    """The size at which text fits its width: never enlarged, and not below 0.45 of the size."""
    exact = 10.0 * (F.col("l_quantity") * 4) / (F.col("l_extendedprice") / 500 + 1)
    size = F.round(F.greatest(F.least(F.lit(10.0), exact), F.lit(4.5)), 4)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", size.alias("size"), (exact < 4.5).alias("too_wide"))


_AT = "(o_orderdate::TIMESTAMP + to_seconds(o_orderkey % 86400))"
DATES_SQL = f"""SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN date_trunc('second', {_AT}) WHEN 1 THEN date_trunc('minute', {_AT}) WHEN 2 THEN date_trunc('hour', {_AT}) WHEN 3 THEN date_trunc('day', {_AT}) END::TIMESTAMP AS at,
CASE o_orderkey % 9 WHEN 0 THEN date_trunc('second', {_AT}) WHEN 1 THEN date_trunc('minute', {_AT}) WHEN 2 THEN date_trunc('day', {_AT}) WHEN 3 THEN date_trunc('month', {_AT}) WHEN 4 THEN date_trunc('year', {_AT}) WHEN 6 THEN date_trunc('second', {_AT}) + INTERVAL 250 MILLISECONDS WHEN 7 THEN date_trunc('second', {_AT}) + INTERVAL 500 MILLISECONDS END::TIMESTAMP AS xmp_at FROM orders"""


@query("parse_dates", DATES_SQL)
def parse_dates(spark, sf_dir):
    """Dates of every layout, and some that aren't dates: an odd length, a zone after eight digits or after minutes, a month that isn't."""
    at = F.expr("timestampadd(SECOND, o_orderkey % 86400, o_orderdate)")
    form = lambda pattern, tail="": F.concat(F.lit("D:"), F.date_format(at, pattern), F.lit(tail))
    kind = F.col("o_orderkey") % 7
    raw = F.when(kind == 0, form("yyyyMMddHHmmss", "+02'00'")).when(kind == 1, form("yyyyMMddHHmm")).when(kind == 2, form("yyyyMMddHH")).when(kind == 3, form("yyyyMMdd"))
    raw = raw.when(kind == 4, form("yyyyMMdd", "123")).when(kind == 5, form("yyyyMMdd", "+02'00'")).otherwise(F.concat(F.lit("D:"), F.date_format(at, "yyyy"), F.lit("1340")))
    kind = F.col("o_orderkey") % 9
    xmp = F.when(kind == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")).when(kind == 1, F.date_format(at, "yyyy-MM-dd'T'HH:mm")).when(kind == 2, F.date_format(at, "yyyy-MM-dd")).when(kind == 3, F.date_format(at, "yyyy-MM"))
    seconds = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    xmp = xmp.when(kind == 4, F.date_format(at, "yyyy")).when(kind == 6, F.concat(seconds, F.lit(".25"))).when(kind == 7, F.concat(seconds, F.lit(".5+02:00")))
    xmp = xmp.when(kind == 8, F.date_format(at, "yyyy-MM-dd'T'HH:mm'Z'")).otherwise(F.date_format(at, "yyyy-MM-dd HH:mm"))
    return table(spark, sf_dir, "orders").select("o_orderkey", document_date(raw).alias("at"), xmp_date(xmp).alias("xmp_at"))


@query("signature_coverage", "SELECT l_orderkey, sum(l_quantity)::BIGINT AS length, max(l_linenumber)::BIGINT * 40 >= sum(l_quantity)::BIGINT - 2 AS covers FROM lineitem GROUP BY l_orderkey")
def signature_coverage(spark, sf_dir):
    """Whether the last signed range ends within two bytes of the file's end."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("long").alias("length"), F.max("l_linenumber").cast("long").alias("n"))
    signed = F.array(F.lit(0), F.col("n") * 10, F.col("n") * 20, F.col("n") * 20)
    return rows.select("l_orderkey", "length", (F.element_at(signed, -2) + F.element_at(signed, -1) >= F.col("length") - 2).alias("covers"))


@query("ocr_words", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_quantity * 0.24) AS INT) AS x, CAST(ceil((l_quantity + 12) * 0.24) AS INT) AS x1 FROM lineitem WHERE l_discount * 10 >= 0.5")
def ocr_words(spark, sf_dir):
    """Recognised words of enough confidence, from pixels to page units."""
    rows = table(spark, sf_dir, "lineitem").filter(F.col("l_discount") * 10 >= 0.5)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.floor(F.col("l_quantity") * 0.24).cast("int").alias("x"), F.ceil((F.col("l_quantity") + 12) * 0.24).cast("int").alias("x1"))


@query("permission_bits", "SELECT o_orderkey, (CASE WHEN o_orderstatus = 'F' THEN 4 ELSE 0 END) | (CASE WHEN o_orderpriority < '3' THEN 8 ELSE 0 END) | (CASE WHEN o_totalprice > 200000 THEN 16 ELSE 0 END) | (-3904) AS bits FROM orders")
def permission_bits(spark, sf_dir):
    flags = ((F.col("o_orderstatus") == "F", 4), (F.col("o_orderpriority") < "3", 8), (F.col("o_totalprice") > 200000, 16))
    bits = reduce(lambda acc, f: acc.bitwiseOR(F.when(f[0], f[1]).otherwise(0)), flags, F.lit(-3904))
    return table(spark, sf_dir, "orders").select("o_orderkey", bits.alias("bits"))


REFERENCES_SQL = """WITH RECURSIVE link AS (SELECT o_orderkey AS src, CASE WHEN o_custkey % 5 > 0 THEN o_orderkey - 4 * (o_custkey % 5) END AS dst, o_orderpriority AS value FROM orders),
walk AS (SELECT src AS start, dst AS at, value, 0 AS steps FROM link UNION ALL SELECT w.start, l.dst, l.value, w.steps + 1 FROM walk w JOIN link l ON l.src = w.at WHERE w.at IS NOT NULL AND w.steps < 32)
SELECT s.src AS o_orderkey, w.value, coalesce(CAST(w.steps AS INT), -1) AS steps FROM link s LEFT JOIN walk w ON w.start = s.src AND w.at IS NULL"""


@query("resolve_references", REFERENCES_SQL)
def resolve_references(spark, sf_dir):
    """What a reference names in the end, through at most 32 others; null, after -1 steps, where a link is broken or the chain is longer."""
    orders = table(spark, sf_dir, "orders")
    links = orders.select(F.col("o_orderkey").alias("src"), F.when(F.col("o_custkey") % 5 > 0, F.col("o_orderkey") - 4 * (F.col("o_custkey") % 5)).alias("dst"))
    ends = written(chain_ends(links, 32), "ends")
    values = orders.select(F.col("o_orderkey").alias("end"), F.col("o_orderpriority").alias("value"))
    # Those without an end have no value to look up; their nulls would all meet in one task.
    found = ends.filter("end is not null").join(values, "end", "left").select("src", "value", "steps")
    lost = ends.filter("end is null").select("src", F.lit(None).cast("string").alias("value"), "steps")
    return found.unionByName(lost).select(F.col("src").alias("o_orderkey"), "value", F.coalesce("steps", F.lit(-1)).alias("steps"))
