r"""Document fingerprints by Order MinHash (operator 2). SQL functions only.

k-mers are K words in a row (all words, if there are fewer; the words of a text without any are one empty word). A k-mer
is numbered by its occurrence in the text, so repeats count, and hashed to a point on a circle cut into BINS arcs. For
each arc the ORDER points that follow its start are taken, put back into text order, and hashed as a tuple: a signature
value. Two texts share a value only if they share those k-mers, as often, in the same order, so shared values measure
edit distance rather than overlap. Likeness is the share of equal values.

Points are longs: 36 bits of hash, then 27 bits of position, so a sorted array has the k-mers of a text by hash, equal
ones in text order, and an element's occurrence number is how far its run reaches back (found by halving steps).

The next document is the one that follows by doc_id. Ids are cut into ranges by their quantiles; each range is a window,
and the first row of each also goes to the range before it, so no window spans the table. Nulls count as empty texts;
null ids come last; rows of one id are ordered by a hash of the text. A single row is followed by itself. No rows give
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import partitions, read_table

K = 5
ORDER = 2
BINS = 64
RANGES_PER_PARTITION = 4

_HASH_BITS, _PLACE_BITS = 36, 27
_SPACE = r"[\\x20\\x09-\\x0D]+"
_MARKS = "transform(sequence(0, {last}), b -> shiftleft(cast(b as bigint), {shift}))"


def with_fingerprint(rows: DataFrame, text: str, name: str, *, k: int = K, order: int = ORDER, bins: int = BINS) -> DataFrame:
    """``rows`` with an array of ``bins`` signature values of the column ``text`` (not null)."""
    arc = _HASH_BITS + _PLACE_BITS - (bins - 1).bit_length()
    g, pos = f"shiftrightunsigned({{}}, {_PLACE_BITS})".format, f"({{}} & {(1 << _PLACE_BITS) - 1})".format
    hashed = f"shiftrightunsigned(xxhash64({{}}), {64 - _HASH_BITS})".format
    steps = ", ".join(str(1 << b) for b in range(_PLACE_BITS - 1, -1, -1))
    marks = _MARKS.format(last=bins - 1, shift=arc)
    words = f"split(trim(BOTH ' \\t\\n\\u000b\\u000c\\r' FROM `{text}`), '{_SPACE}')"
    gram = ", ".join(f"get(w, i + {j})" for j in range(k))  # words that a short text lacks are null and don't count
    places = f"transform(array({words}), w -> transform(sequence(0, greatest(size(w) - {k}, 0)), i -> shiftleft({hashed(gram)}, {_PLACE_BITS}) | (i + 1)))[0]"
    # Later occurrences of a k-mer are points of their own: hash and occurrence number, hashed again.
    number = f"aggregate(array({steps}), 0, (o, s) -> if(j - o - s >= 0 and {g('get(_s, j - o - s)')} = {g('x')}, o + s, o))"
    numbered = f"transform(_s, (x, j) -> if(j > 0 and {g('get(_s, j - 1)')} = {g('x')}, shiftleft({hashed(f'{g("x")}, {number}')}, {_PLACE_BITS}) | {pos('x')}, x))"
    leading = f"filter(_t, (x, j) -> j < {order} or shiftrightunsigned(get(_t, j - {order}), {arc}) <> shiftrightunsigned(x, {arc}))"
    taken = f"slice(_c, cast(array_position(_m, m) as int) - b, {order})"
    in_order = f"sort_array(transform({taken}, x -> shiftleft({pos('x')}, {_HASH_BITS}) | {g('x')}))"
    value = f"cast(xxhash64(transform({in_order}, y -> y & {(1 << _HASH_BITS) - 1})) & 65535 as int)"
    out = rows.withColumn("_s", F.expr(f"sort_array({places})")).withColumn("_t", F.expr(f"sort_array({numbered})")).drop("_s")
    out = out.withColumn("_b", F.expr(leading)).drop("_t")
    out = out.withColumn("_m", F.expr(f"sort_array(concat(_b, {marks}))")).withColumn("_c", F.expr(f"flatten(array_repeat(_b, {order + 1}))"))
    return out.withColumn(name, F.expr(f"transform({marks}, (m, b) -> {value})")).drop("_b", "_m", "_c")


def as_text(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.size(a)


def with_next(rows: DataFrame, columns: list[str], ranges: int) -> DataFrame:
    """``rows`` (doc_id, text, ...) with next_<column> of the row that follows by doc_id, the first after the last."""
    cuts = [(i + 1) / ranges for i in range(ranges - 1)] or [0.5]
    bounds = sorted(set(rows.agg(F.percentile_approx("doc_id", cuts, 10_000)).first()[0] or []))
    array = lambda values, kind: f"cast(array({', '.join('null' if v is None else str(v) for v in values)}) as array<{kind}>)"
    steps = ", ".join(str(1 << b) for b in range(max(1, len(bounds)).bit_length(), -1, -1))
    found = f"aggregate(array({steps}), 0, (p, s) -> if(p + s <= {len(bounds)} and get({array(bounds, 'bigint')}, p + s - 1) < doc_id, p + s, p))"
    ranged = rows.withColumn("_range", F.expr(f"if(doc_id is null, {len(bounds) + 1}, {found})")).withColumn("_tie", F.xxhash64("text"))
    firsts = {r["_range"]: r for r in ranged.groupBy("_range").agg(F.min(F.struct("doc_id", "_tie")).alias("f")).collect()}  # a row a range
    held = sorted(firsts)
    before = {r: held[i - 1] for i, r in enumerate(held)}
    size = len(bounds) + 2
    first_id = array([firsts[r]["f"]["doc_id"] if r in firsts else None for r in range(size)], "bigint")
    first_tie = array([firsts[r]["f"]["_tie"] if r in firsts else None for r in range(size)], "bigint")
    previous = array([before.get(r) for r in range(size)], "int")
    leads = f"doc_id <=> get({first_id}, _range) and _tie = get({first_tie}, _range)"
    homes = f"if({leads}, array(struct(_range as r, false as guest), struct(get({previous}, _range) as r, true as guest)), array(struct(_range as r, false as guest)))"
    dealt = ranged.withColumn("_home", F.explode(F.expr(homes))).withColumn("_range", F.col("_home.r")).withColumn("_guest", F.col("_home.guest")).drop("_home")
    order = Window.partitionBy("_range").orderBy("_guest", F.col("doc_id").asc_nulls_last(), "_tie")
    led = dealt.withColumn("_next", F.lead(F.struct(*columns)).over(order)).filter("not _guest")
    return led.select(*rows.columns, *(F.col(f"_next.{c}").alias(f"next_{c}") for c in columns))


def fingerprints(docs: DataFrame, *, k: int = K, order: int = ORDER, bins: int = BINS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of ``docs``."""
    how = {"k": k, "order": order, "bins": bins}
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    signed = with_fingerprint(rows, "text", "signature", **how)
    led = with_next(signed, ["text", "signature"], RANGES_PER_PARTITION * partitions(docs.sparkSession))
    led = led.withColumn("n_chars", F.length("text")).withColumn("_half", F.expr("n_chars div 2").cast("int"))
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars") - F.col("_half")), F.substring("next_text", F.lit(1), F.col("_half")))
    led = led.withColumn("edited", edited).drop("text", "next_text", "_half")
    led = with_fingerprint(led.withColumn("edited_sha256", F.sha2("edited", 256)), "edited", "edited_signature", **how)
    return led.select(
        "doc_id",
        F.col("n_chars").cast("long"),
        "edited_sha256",
        as_text(F.col("signature")).alias("fingerprint"),
        as_text(F.col("edited_signature")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )


def op2_order_minhash(spark, sf_dir: str) -> DataFrame:
    return fingerprints(read_table(spark, sf_dir, "documents"))
