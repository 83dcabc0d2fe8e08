"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger row holds the measurements and one failure bit
per rule. A policy is a versioned mask over those bits, so verdicts and ablations never read a text
again: a verdict is one ``&``, an ablation one aggregation over the distinct bit patterns.

Only SQL functions are used. Each document is measured inside its own row, without a shuffle. Repeated
windows compare 64-bit hashes of five word hashes, sorted with their positions, so a text of n words
takes n log n steps.

Edge cases: a null or empty text has no words, lines or symbols and fails ``few_words``; rows are judged
one by one, so repeated rows and null ids pass through; an empty table gives an empty ledger; other
columns, whatever their names, are ignored by :func:`ledger` and kept by :func:`filter_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS_CHARS, WS_RE, col, fresh, table

#: Rule name, and its failure condition over the measurements. The position is the bit.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "{n_words} < 10"),
    ("repeated_words", "100 * {n_repeat_words} > 20 * {n_words}"),
    ("symbols", "2 * {n_symbols} > {n_words}"),
    ("repeated_lines", "100 * {n_dup_lines} > 30 * {n_lines}"),
    ("word_length", "{word_chars} < 2 * {n_words} OR {word_chars} > 25 * {n_words}"),
)
#: Versioned policies: the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "repeated_lines", "word_length"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def mask(policy: str) -> int:
    names = [n for n, _ in RULES]
    return sum(1 << names.index(r) for r in POLICIES[policy])


def _measured(df: DataFrame, text: str, names: dict[str, str]) -> DataFrame:
    """``df`` with the measurements under ``names``."""
    own = fresh(df, "text", "words", "hashes", "windows", "lines")
    t, words, hashes, windows, lines = own
    body = F.coalesce(col(text), F.lit(""))
    bare = F.btrim(body, F.lit(WS_CHARS))
    df = df.withColumn(t, body)
    df = df.withColumns({
        words: F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, WS_RE)),
        lines: F.filter(F.split(F.col(t), "\n"), lambda x: F.length(F.btrim(x, F.lit(WS_CHARS))) > 0),
    })
    df = df.withColumns({
        names["n_words"]: F.size(words).cast("bigint"),
        names["word_chars"]: F.length(F.array_join(words, "")).cast("bigint"),
        names["n_symbols"]: (F.length(t) - F.length(F.translate(F.col(t), "#*$%&|<>", ""))).cast("bigint"),
        names["n_lines"]: F.size(lines).cast("bigint"),
        names["n_dup_lines"]: (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
        hashes: F.transform(words, lambda w: F.xxhash64(w)),
    }).drop(t, lines)
    df = df.withColumn(windows, F.expr(
        f"CASE WHEN size(`{hashes}`) < 5 THEN CAST(array() AS array<bigint>) ELSE transform(slice(`{hashes}`, 1, size(`{hashes}`) - 4),"
        f" (x, i) -> xxhash64(x, `{hashes}`[i + 1], `{hashes}`[i + 2], `{hashes}`[i + 3], `{hashes}`[i + 4])) END"))
    # transform(array(x), name -> ...)[0] binds x to a name, so it is evaluated once.
    repeated = (
        f"transform(array(sort_array(transform(`{windows}`, (h, i) -> struct(h, i)))), s -> "
        "transform(array(sort_array(filter(transform(s, (x, j) -> CASE WHEN get(s, j - 1).h = x.h OR get(s, j + 1).h = x.h THEN x.i END),"
        " x -> x IS NOT NULL))), p -> "
        "aggregate(transform(p, (x, j) -> least(5, coalesce(get(p, j + 1) - x, 5))), 0L, (acc, x) -> acc + x))[0])[0]")
    # The partition number, times nothing, keeps filters on the measurements above this projection: pushed below it, they would
    # repeat the windows' expression inside its own lambdas.
    df = df.withColumn(names["n_repeat_words"], F.expr(
        f"CASE WHEN size(array_distinct(`{windows}`)) = size(`{windows}`) THEN 0L ELSE {repeated} END") + F.spark_partition_id() * 0)
    return df.drop(words, hashes, windows)


def _fail_bits(names: dict[str, str]) -> Column:
    quoted = {k: f"`{v}`" for k, v in names.items()}
    return F.expr(" + ".join(f"CASE WHEN {rule.format(**quoted)} THEN {1 << bit}L ELSE 0L END" for bit, (_, rule) in enumerate(RULES)))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, the measurements and ``fail_bits``."""
    slim = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    names = {m: m for m in MEASURES}
    out = _measured(slim, "text", names).withColumn("fail_bits", _fail_bits(names))
    return out.select("doc_id", *MEASURES, "fail_bits")


def apply_policy(entries: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with ``base_failed`` and the policy's verdict ``kept``."""
    base = F.col("fail_bits").bitwiseAND(F.lit(mask("base"))) != 0
    return entries.withColumns({"base_failed": base, "kept": ~base & (F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0)})


def ablations(entries: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of the policy: documents it fails, those only it fails, and those kept without it.

    One aggregation to the distinct bit patterns (at most 2 to the number of rules), then arithmetic on them.
    """
    m = mask(policy)
    patterns = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << b).cast("bigint").alias("bit")) for b, (n, _) in enumerate(RULES) if (1 << b) & m])
    hit = F.col("bits").bitwiseAND(F.col("bit"))
    sums = patterns.select("bits", "n", F.inline(rules)).groupBy("rule").agg(
        F.sum(F.when(hit != 0, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("failed_alone"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.lit(m) - F.col("bit")) == 0, F.col("n")).otherwise(0)).alias("kept_without"))
    return sums


def filter_documents(docs: DataFrame, policy: str = "v1", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with the columns of ``docs``."""
    *own, bits = fresh(docs, *MEASURES, "bits")
    names = dict(zip(MEASURES, own, strict=True))
    out = _measured(docs, text_col, names).withColumn(bits, _fail_bits(names))
    return out.where(F.col(bits).bitwiseAND(F.lit(mask(policy))) == 0).select(*[col(c) for c in docs.columns])


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_policy(ledger(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "fail_bits")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM win),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g),
p AS (SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS n FROM r WHERE c > 1),
rep AS (SELECT doc_id, sum(n) AS n FROM p GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
    FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id),
b AS (SELECT *, CAST((CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 2 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words OR word_chars > 25 * n_words THEN 16 ELSE 0 END) AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
    fail_bits = 0 AS kept, n_lines, fail_bits FROM b
"""
