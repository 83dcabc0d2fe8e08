"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Every paragraph (a piece between line ends, cut again behind sentences, so a long line isn't all or nothing; :func:`units`) is hashed into a
wide vector, and the fingerprint is the sum of these vectors, lane by lane: four lanes modulo 2^62 that every paragraph adds to,
each of its own hash, lanes modulo 2^16 that carry the likeness, and the number of paragraphs. Texts whose paragraphs differ are equal in all sums with chance about 2^-248, if the hashes
are independent; no two such texts are expected among 2^100. xxhash64 isn't built against an adversary. So equal texts have equal fingerprints,
the order of paragraphs doesn't matter, and inserting or deleting a paragraph adds or subtracts its vector
(:func:`combine`) without reading the rest of the document.

Lanes: 64 that every paragraph falls into, and 32 each for one paragraph in 16, 256, 1024, 4096, 16384 and 65536. The
number of lanes that differ estimates by linear counting how many paragraphs differ, at the finest level that isn't full;
with the two paragraph counts that gives a Jaccard likeness of the multisets (:func:`likeness`). The coarsest level is
full beyond some seven million differing paragraphs; the likeness is 0 then.

Only SQL functions run. For the following document, ids are cut into ranges by constant-size quantiles, each range is
a window of its own, and the first text of the range below closes the gap between two windows.

Edge cases: a null text is empty; an empty text is one empty paragraph; rows with equal ids are ordered by text; null
ids come last; a single row is its own next one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, small, table, written

LEVELS = ((64, 1), (32, 16), (32, 256), (32, 1024), (32, 4096), (32, 16384), (32, 65536))  # lanes, and one paragraph in so many
#: Where paragraphs are cut, besides line ends: behind the space that follows the end of a sentence, and behind full-width stops.
UNIT_ENDS = (". ", "! ", "? ", "。")
SUMS, SUM_BITS = 4, (1 << 62) - 1  # two summands stay below 2^63
LANES = sum(n for n, _ in LEVELS)
QUANTILES = 64
RANGE_ROWS, STRETCH = 500, 4096


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def units(text: Column) -> Column:
    """The paragraphs of a text. Plain replacements, as a regular expression costs more than all the sums."""
    text = F.coalesce(text, F.lit(""))
    for end in UNIT_ENDS:
        text = F.replace(text, F.lit(end), F.lit(end + "\n"))
    return F.split(text, "\n")


def fingerprint(text: Column) -> Column:
    """Struct of ``n`` (paragraphs), ``lanes`` (array<int>, each below 2^16) and ``sums`` (array<bigint>, each below 2^62)."""
    return _let(units(text), lambda ps: _let(F.transform(ps, lambda p: F.xxhash64(p)), lambda hs: _summed(hs, ps)))


def _sum(pieces: Column, k: int) -> Column:
    return F.aggregate(pieces, F.lit(0).cast("bigint"), lambda acc, p: (acc + F.xxhash64(F.lit(k), p).bitwiseAND(F.lit(SUM_BITS))).bitwiseAND(F.lit(SUM_BITS)))


def _summed(hashes: Column, pieces: Column) -> Column:
    lanes = F.concat(_lanes(hashes, LEVELS[0][0], 0), _sampled(hashes, 1))
    return F.struct(F.size(hashes).alias("n"), lanes.alias("lanes"), F.array(*[_sum(pieces, k) for k in range(SUMS)]).alias("sums"))


def _sampled(hashes: Column, level: int) -> Column:
    """The lanes of ``level`` and the coarser ones: one paragraph in so many, picked by bits 6 to 21 of its hash; bits 22 on give the lane.

    What a level picks is among what the finer one picked, so each filter reads only those.
    """
    lanes, one_in = LEVELS[level]
    picked = F.filter(hashes, lambda h: F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(one_in - 1)) == 0)

    def found(p: Column) -> Column:
        here = _lanes(p, lanes, 22)
        return here if level + 1 == len(LEVELS) else F.concat(here, _sampled(p, level + 1))

    return _let(picked, lambda p: F.when(F.size(p) == 0, F.array_repeat(F.lit(0), sum(n for n, _ in LEVELS[level:]))).otherwise(found(p)))


def _lanes(hashes: Column, lanes: int, shift: int) -> Column:
    """Sums modulo 2^16 of bits 32 to 47 of the hashes, by lane: the bits from ``shift`` on, modulo ``lanes`` (a multiple of 16).

    Four lanes share a long. Hashes are dealt by sixteen lanes first, so each is looked at lanes / 16 + 4 times.
    """
    def bits(h: Column, mask: int) -> Column:
        return h.bitwiseAND(F.lit(mask << shift).cast("bigint"))

    def steps(mask: int) -> Column:
        unit = mask & -mask
        return F.array(*[F.lit(k << shift).cast("bigint") for k in range(0, mask + unit, unit)])

    def add(acc: Column, h: Column) -> Column:
        at = F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(3)).cast("int") * 16
        cleared = acc.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(65535).cast("bigint"), at)))
        field = F.call_function("shiftrightunsigned", acc, at).bitwiseAND(F.lit(65535)) + F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(65535))
        return cleared.bitwiseOR(F.call_function("shiftleft", field.bitwiseAND(F.lit(65535)), at))

    def four(some: Column, i: Column) -> Column:
        return F.aggregate(some, F.lit(0).cast("bigint"), lambda acc, h: F.when(bits(h, 12) == i, add(acc, h)).otherwise(acc))

    def sixteen(q: Column) -> Column:
        return _let(F.filter(hashes, lambda h: bits(h, lanes - 16) == q), lambda some: F.transform(steps(12), lambda i: four(some, i)))

    packed = F.flatten(F.transform(steps(lanes - 16), sixteen))
    return F.flatten(F.transform(packed, lambda x: F.array(*[F.shiftrightunsigned(x, 16 * k).bitwiseAND(F.lit(65535)).cast("int") for k in range(4)])))


def _by_level(lanes: Column) -> list[Column]:
    out, at = [], 1
    for n, _ in LEVELS:
        out.append(F.slice(lanes, at, n))
        at += n
    return out


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of a's paragraphs with b's inserted (sign 1) or deleted (sign -1)."""
    return F.struct((a["n"] + sign * b["n"]).alias("n"), F.zip_with(a["lanes"], b["lanes"], lambda x, y: (x + sign * y).bitwiseAND(F.lit(65535))).alias("lanes"),
                    F.zip_with(a["sums"], b["sums"], lambda x, y: (x + sign * y).bitwiseAND(F.lit(SUM_BITS))).alias("sums"))


def text_form(fp: Column) -> Column:
    """Paragraphs in hexadecimal, a colon, four digits for each lane, a colon, sixteen digits for each sum."""
    def digits(x: Column, n: int) -> Column:
        return F.array_join(F.transform(x, lambda v: F.lpad(F.hex(v), n, "0")), "")

    levels = [F.when(lanes == F.array_repeat(F.lit(0), n), F.lit("0" * 4 * n)).otherwise(digits(lanes, 4)) for lanes, (n, _) in zip(_by_level(fp["lanes"]), LEVELS)]
    return F.concat(F.hex(fp["n"]), F.lit(":"), *levels, F.lit(":"), digits(fp["sums"], 16))


def likeness(a: Column, b: Column) -> Column:
    """Estimated multiset Jaccard likeness of two fingerprints, 0 to 1; 1 for equal ones only."""
    def differing(x: Column, y: Column) -> Column:
        ones = F.zip_with(x, y, lambda p, q: F.when(p == q, 0).otherwise(1))
        return F.when(x == y, 0).otherwise(F.aggregate(ones, F.lit(0), lambda s, v: s + v))

    def estimate(counts: Column) -> Column:
        out = None
        for at, (lanes, one_in) in reversed(list(enumerate(LEVELS))):
            k = counts[at]
            here = F.when(k < lanes, F.log(1.0 - F.least(k, F.lit(lanes - 1)) / float(lanes)) * float(-lanes * one_in))
            out = here if out is None else F.when(k <= lanes * 7 // 8, here).otherwise(out)
        return out

    both = (a["n"] + b["n"]).cast("double")

    def share(m: Column) -> Column:
        # Unlike texts with equally many paragraphs differ in two at least.
        m = F.greatest(m, F.when(a["n"] == b["n"], 2.0).otherwise(F.abs(a["n"] - b["n"]).cast("double")))
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (both - m) / (both + m)))

    counts = F.array(*[differing(x, y) for x, y in zip(_by_level(a["lanes"]), _by_level(b["lanes"]))])
    m = F.coalesce(_let(counts, estimate), both)  # null: the coarsest level is full
    return F.when((a["n"] == b["n"]) & (a["lanes"] == b["lanes"]) & (a["sums"] == b["sums"]), 1.0).otherwise(_let(m, share))


def with_next_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prints: bool = False) -> DataFrame:
    """(doc_id, text, next_text): the text of the following row by falling id, the first one's after the last.

    With ``prints`` also ``fp`` and ``next_fp``, their fingerprints, each computed once: the next row's travels with its text.
    """
    rows = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))
    rows = rows.withColumn("key", key)
    total, cuts = rows.select("key").agg(F.count(F.lit(1)), F.percentile_approx("key", [i / QUANTILES for i in range(1, QUANTILES)], 10_000)).first()
    cuts = sorted(set(cuts or []))
    parts = max(1, math.ceil(total / (RANGE_ROWS * QUANTILES)))
    bounds = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    q = F.size(F.filter(bounds, lambda b: b <= F.col("key")))
    rows = rows.withColumn("q", q)
    low, high = F.get(bounds, F.col("q") - 1).cast("double"), F.get(bounds, F.col("q")).cast("double")
    within = F.floor((F.col("key") - low) / (high - low) * parts)
    rows = rows.withColumn("bucket", (F.col("q") * parts + F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.coalesce(within, F.lit(0))))).cast("bigint")).drop("q")
    # The head of a bucket: its largest id, and the smallest text among rows with that id.
    tops = written(rows.groupBy("bucket").agg(F.max("key").alias("key")))
    heads = rows.join(small(tops), ["bucket", "key"], "left_semi").groupBy("bucket").agg(F.min("text").alias("head"))
    # The next bucket below that has rows: within a stretch of buckets, else the last one of the next stretch that has any.
    tops = tops.withColumn("stretch", F.expr(f"bucket DIV {STRETCH}"))
    stretches = tops.groupBy("stretch").agg(F.max("bucket").alias("top_bucket"))
    line = Window.orderBy(F.col("stretch").desc())  # over stretches, one for STRETCH * RANGE_ROWS rows
    stretches = stretches.select("stretch", F.coalesce(F.lead("top_bucket").over(line), F.max("top_bucket").over(Window.partitionBy())).alias("next_stretch"))
    falling = Window.partitionBy("stretch").orderBy(F.col("bucket").desc())
    order = tops.withColumn("in_stretch", F.lead("bucket").over(falling)).join(stretches, "stretch").select("bucket", F.coalesce("in_stretch", "next_stretch").alias("below"))
    heads = order.join(heads.withColumnRenamed("bucket", "below"), "below").select("bucket", "head")
    place = Window.partitionBy("bucket").orderBy(F.col("key").desc(), F.col("text"))
    names = ["text"]
    if prints:
        names.append("fp")
        rows, heads = rows.withColumn("fp", fingerprint(F.col("text"))), heads.withColumn("head_fp", fingerprint(F.col("head")))
    found = rows.withColumns({f"next_{n}": F.lead(n).over(place) for n in names} | {"last": F.lead(F.lit(1)).over(place).isNull()})
    nexts = [F.when(F.col("last"), F.col(h)).otherwise(F.col(f"next_{n}")).alias(f"next_{n}") for n, h in zip(names, ("head", "head_fp"))]
    return found.join(heads, "bucket").select("doc_id", *names, *nexts)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of every text."""
    return docs.select(col(id_col).alias("doc_id"), fingerprint(col(text_col)).alias("fp"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next_text(table(spark, sf_dir, "documents"), prints=True)
    n = F.length("text")
    rows = rows.withColumn("n_chars", n.cast("bigint"))
    k = F.expr("CAST(n_chars DIV 3 AS INT)")
    edited = F.concat(F.expr("left(text, CAST(n_chars - n_chars DIV 3 AS INT))"), F.expr("left(next_text, CAST(n_chars DIV 3 AS INT))"))
    rows = rows.withColumn("edited", F.when(k == 0, F.col("text")).otherwise(edited))
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       F.col("fp").alias("a"), fingerprint(F.col("edited")).alias("b"), F.col("next_fp").alias("c"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return rows.select("doc_id", "n_chars", "edited_sha256", text_form(a).alias("fingerprint"), text_form(b).alias("edited_fingerprint"),
                       likeness(a, b).alias("near_edited"), likeness(a, c).alias("near_next"))
