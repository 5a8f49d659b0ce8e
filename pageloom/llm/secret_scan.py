"""Secret scans by an incremental blob ledger (operator 4). DataFrame functions only.

A blob is one distinct content, named by its SHA-256; every historical version of a path is a row that names its blob.
The ledger is a Parquet folder of one row per (blob, rule version) that has been scanned, with its findings. A run scans
only the pairs that the ledger lacks, once per blob however many paths hold it, appends them, and joins the findings back
to all paths. Scanned pairs without findings are in the ledger too, so they aren't scanned again. Two runs that append at
once may both scan a pair; their rows are equal and count once.

Spans are found with split and regexp_extract_all: the pieces between matches and the matches alternate, so running sums
of their lengths are the positions, in code points. Nulls count as empty texts; empty texts have no spans. Repeated rows
are paths of one blob. No rows give no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions.folds import let, running_sums

from .scratch import read_table, scratch_root

#: Kind, pattern, group whose length counts (0: the match), least length. The first three are the base.
RULES = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
    ("token", r"\b(?:gh[pousr]_|glpat-|xox[abprs]-|sk_live_|eyJ[A-Za-z0-9_-]+\.eyJ)[A-Za-z0-9_.-]+", 0, 20),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)
BASE_KINDS = ("assign", "access", "hex")
#: A changed pattern is another version: its findings aren't those of the old one.
RULE_VERSION = hashlib.sha256(repr(RULES).encode()).hexdigest()[:16]
LEDGER = "blob string, rule_version string, findings array<struct<start:int,ord:int,end:int,kind:string>>"
#: Setting that names the ledger's folder. Unset: the query begins a ledger of its own.
LEDGER_SETTING = "pageloom.secrets.ledger"

#: What a text must hold for a kind to be looked for at all: implied by its pattern, and cheap to search.
HINTS = {"hex": r"[0-9a-f]{32}"}


def spans(text: Column, kind: str, order: int) -> Column:
    """Array of (start, order, end, kind) of a rule's matches that are long enough, in text order."""
    _, pattern, group, least = next(r for r in RULES if r[0] == kind)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    empty = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>")

    def placed(pieces: Column) -> Column:
        """Where each match ends is a running sum, so none is appended to the ones before it."""
        reach = running_sums(F.transform(pieces, lambda p: p["gap"] + F.coalesce(p["len"], F.lit(0))))
        spans = F.zip_with(pieces, reach, lambda p, end: F.struct((end - F.coalesce(p["len"], F.lit(0))).alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(kind).alias("kind"), (F.coalesce(p["size"], F.lit(0)) >= least).alias("enough")))
        return F.transform(F.filter(spans, lambda s: s["enough"]), lambda s: F.struct(s["start"], s["ord"], s["end"], s["kind"]))

    parts = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), lambda x: F.length(x)).alias("gap"),
        F.transform(found, lambda x: F.length(x)).alias("len"),
        F.transform(sized, lambda x: F.length(x)).alias("size"),
    )
    return F.when(text.rlike(HINTS.get(kind, pattern)), let(parts, placed)).otherwise(empty)


def digest(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def blobs(versions: DataFrame) -> DataFrame:
    """``versions`` with the content address of each row's text."""
    return versions.withColumn("blob", F.sha2(F.coalesce("text", F.lit("")), 256))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION, path: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """New ledger rows (blob, rule_version, findings) for the pairs that ``ledger`` lacks.

    ``path``: the columns that name a row of ``versions`` beside its text, such as a file's path and version.
    """
    named = blobs(versions.select(*path, "text")).withColumn("row_key", F.xxhash64(*path, "blob"))
    chosen = named.groupBy("blob").agg(F.min("row_key").alias("row_key"))
    if ledger is not None:
        seen = ledger.filter(F.col("rule_version") == rule_version).select("blob")
        chosen = chosen.join(seen, "blob", "left_anti")
    unseen = named.select("row_key", "blob", F.coalesce("text", F.lit("")).alias("text")).join(chosen, ["row_key", "blob"], "left_semi").dropDuplicates(["row_key", "blob"])
    each = reduce(F.concat, [spans(F.col("text"), kind, i) for i, (kind, *_) in enumerate(RULES)])
    return unseen.select("blob", F.lit(rule_version).alias("rule_version"), F.array_sort(each).alias("findings"))


def ledger_at(spark: SparkSession, folder: str) -> DataFrame | None:
    """The ledger in ``folder``, None if there is none yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(LEDGER).parquet(folder) if there else None


def record(versions: DataFrame, folder: str, rule_version: str = RULE_VERSION, path: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Scan what the ledger in ``folder`` lacks, append it there, and return the ledger."""
    spark = versions.sparkSession
    scan(versions, ledger_at(spark, folder), rule_version, path).write.mode("append").parquet(folder)
    return ledger_at(spark, folder)


def findings_by_path(versions: DataFrame, ledger: DataFrame, rule_version: str = RULE_VERSION) -> DataFrame:
    """Every row of ``versions`` with its blob and that blob's findings (an empty array if it has none), which take the place
    of columns of these names."""
    hits = ledger.filter((F.col("rule_version") == rule_version) & (F.size("findings") > 0)).select("blob", "findings").dropDuplicates(["blob"])
    empty = F.array().cast(ledger.schema["findings"].dataType)
    return blobs(versions.drop("findings")).drop("text").join(hits, "blob", "left").withColumn("findings", F.coalesce("findings", empty))


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = spark.conf.get(LEDGER_SETTING, None) or f"{scratch_root(spark)}/secret-ledger-{uuid.uuid4().hex[:12]}"
    found = findings_by_path(docs, record(docs, folder))
    count = lambda kind: F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in BASE_KINDS),
        F.sha2(digest(F.filter("findings", lambda s: s["kind"].isin(*BASE_KINDS))), 256).alias("base_sha256"),
        digest(F.col("findings")).alias("spans"),
    )


def _sql_spans(kind: str, pattern: str, group: int, least: int, order: int) -> str:
    quoted = pattern.replace("'", "''")
    sized = "m" if group == 0 else f"regexp_extract_all(t, '{quoted}', {group})"
    return f"""
  SELECT doc_id, '{kind}' AS kind, {order} AS ord, list_sum([length(x) FOR x IN p[1:i]]) + coalesce(list_sum([length(x) FOR x IN m[1:i-1]]), 0) AS s,
         length(m[i]) AS n, length(g[i]) AS size FROM (
    SELECT doc_id, string_split_regex(t, '{quoted}') AS p, regexp_extract_all(t, '{quoted}') AS m, {sized} AS g
    FROM (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{quoted}') AS m FROM documents)
  ), unnest(range(1, len(m) + 1)) AS u(i) WHERE length(g[i]) >= {least}"""


def oracle() -> str:
    parts = [_sql_spans(kind, pattern.replace("(?i:(password|passwd|secret|token|api_?key))", "((?i:passw)(?i:ord|d)|(?i:se)(?i:cret)|(?i:to)(?i:ken)|(?i:api_?key))"), group, least, i) for i, (kind, pattern, group, least) in enumerate(RULES)]
    return "WITH spans AS (" + "\n  UNION ALL".join(parts) + r"""
), told AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || CAST(s AS VARCHAR) || ':' || CAST(s + n AS VARCHAR), ',' ORDER BY s, ord) AS spans,
         string_agg(kind || ':' || CAST(s AS VARCHAR) || ':' || CAST(s + n AS VARCHAR), ',' ORDER BY s, ord) FILTER (ord < 3) AS base
  FROM spans GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN told USING (doc_id)
"""
