"""Redaction and pseudonymization over text rows: rules to marks, marks to text, and the checks afterwards."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions.folds import heads_where, let, runs_at, scan
from pageloom.functions.text import anywhere_hits, bounded_hits, bounded_spans, replace_bounded


@dataclass(frozen=True)
class Rule:
    rule_id: int
    literal: str = ""
    token: str = ""
    pattern: str = ""


def literal_marks(texts: DataFrame, rules: list[Rule], bounded: bool = True) -> DataFrame:
    """(doc_id, rule_id, hits) for each text and rule with hits."""
    count = bounded_hits if bounded else anywhere_hits
    each = F.array(*(F.struct(F.lit(r.rule_id).alias("rule_id"), count(F.col("text"), r.literal).alias("hits")) for r in rules))
    return texts.select("doc_id", F.explode(each).alias("m")).select("doc_id", "m.rule_id", "m.hits").filter("hits > 0")


def pattern_marks(texts: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, rule_id, ord, match) of each regular expression hit, in text order; texts are read once."""
    each = F.array(*(F.struct(F.lit(r.rule_id).alias("rule_id"), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)).alias("found")) for r in rules))
    return texts.select("doc_id", F.explode(each).alias("m")).select("doc_id", "m.rule_id", F.posexplode("m.found").alias("ord", "match"))


def spans(texts: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, n, rule_id, lo, hi) of each bounded literal hit in a text of n characters; texts are read once."""
    each = F.array(*(F.struct(F.lit(r.rule_id).alias("rule_id"), bounded_spans(F.col("text"), r.literal).alias("found")) for r in rules))
    found = texts.select("doc_id", F.length("text").alias("n"), F.explode(each).alias("m")).select("doc_id", "n", "m.rule_id", F.explode("m.found").alias("s"))
    return found.select("doc_id", "n", "rule_id", "s.lo", "s.hi")


#: What may stand around a recognised word, and the bytes from which a literal's words count alone.
AROUND_WORD, LEAST_PART = ".,;:()[]{}\"'`?!", 3


def matches_any_rule(word: Column, literals: list[str], patterns: list[str], bounded: bool = True) -> Column:
    """Whether a single recognised word is covered by a rule: a literal stands in it (as words, or anywhere), it is one of a
    literal's words of LEAST_PART bytes of UTF-8 at least (what stands around it aside), or a pattern is found in it."""
    bare = F.trim(word, F.lit(AROUND_WORD))
    tests = [(bounded_hits if bounded else anywhere_hits)(word, x) > 0 for x in literals if x]
    parts = sorted({p for x in literals for p in x.split() if len(p.encode()) >= LEAST_PART})
    tests += [bare.isin(*parts)] if parts else []
    tests += [word.rlike(x) for x in patterns]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def longest_first(rules: list[Rule]) -> list[Rule]:
    return sorted(rules, key=lambda r: -len(r.literal))


def substitute(texts: DataFrame, rules: list[Rule], name: str = "text") -> DataFrame:
    """Each rule's bounded hits replaced, the longest literal first; later rules see what earlier ones wrote."""
    for rule in longest_first(rules):
        if not rule.literal or rule.literal in rule.token:
            raise ValueError("a rule needs a literal that its token doesn't hold")
        texts = texts.withColumn(name, replace_bounded(F.col(name), rule.literal, rule.token))
    return texts


def merge_ranges(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping or touching (lo, hi) of the same ``keys`` as one: gaps and islands over the running end. Where there is a
    column n, ranges are cut to [0, n] first; empty ones go."""
    if "n" in ranges.columns:
        ranges = ranges.withColumns({"lo": F.greatest("lo", F.lit(0)), "hi": F.least("hi", "n")})
    ranges = ranges.filter("lo < hi")
    order = Window.partitionBy(*keys).orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("lo") > reach), 1).otherwise(0)
    marked = ranges.withColumn("new", new).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def merged_ranges(ranges: Column, n: Column) -> Column:
    """``merge_ranges`` of an array of (lo, hi) inside its row, cut to [0, n]: in order, a range opens where none before reaches it."""
    cut = F.transform(ranges, lambda r: F.struct(F.greatest(r["lo"], F.lit(0)).alias("lo"), F.least(r["hi"], n).alias("hi")))
    ordered = F.array_sort(F.filter(cut, lambda r: r["lo"] < r["hi"]))

    def step(reach: Column, r: Column) -> Column:
        return F.struct(F.greatest(reach, r["hi"]).alias("state"), (r["lo"] > reach).alias("out"))

    def joined(v: Column) -> Column:
        opens = scan(v, F.lit(-1), step, "boolean")
        heads = let(opens, lambda new: heads_where(v, lambda r, i: F.get(new, i)))
        return F.transform(runs_at(v, heads), lambda run: F.struct(F.get(run, F.lit(0))["lo"].alias("lo"), F.array_max(F.transform(run, lambda r: r["hi"])).alias("hi")))

    return let(ordered, joined)


def _respelled(forms: Column, old: str, new: str) -> Column:
    return F.transform(forms, lambda f: F.replace(f, F.lit(old), F.lit(new)))


def expand_variants(rules: DataFrame) -> DataFrame:
    """``rules`` (rule_id, literal) with every spelling: spaces hard, hyphens soft or non-breaking, each crossed with the
    ones before. A spelling belongs to the first rule that claims it."""
    forms = F.array("literal")
    for old, new in ((" ", " "), ("-", "­"), ("-", "‑")):
        forms = F.array_distinct(F.concat(forms, _respelled(forms, old, new)))
    rows = rules.select("rule_id", F.posexplode(forms).alias("ord", "spelling"))
    first = F.row_number().over(Window.partitionBy("spelling").orderBy("rule_id", "ord"))
    return rows.withColumn("claim", first).filter("claim = 1").drop("claim")
