"""Quality rules, sharding, fingerprints and mixing."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from helpers import DOCS, docs, empty, key, repeated_words, rows, words
from pyspark.sql import functions as F

from graphweft.llm import fingerprints, mixing, quality_rules, sharding

ALL = rows()


def test_quality_ledger(spark):
    got = sorted(map(tuple, quality_rules.ledger(docs(spark)).drop("fail_bits").collect()), key=key)
    want = []
    for r in ALL:
        t = r[1] or ""
        lines = [x for x in t.split("\n") if words(x)]
        want.append((r[0], len(words(t)), sum(map(len, words(t))), sum(t.count(c) for c in "#*$%&|<>"), len(lines), len(lines) - len(set(lines)), repeated_words(t)))
    assert got == sorted(want, key=key)


def test_quality_policy_and_ablations(spark):
    entries = quality_rules.apply_policy(quality_rules.ledger(docs(spark)))
    for r in entries.collect():
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (r.fail_bits == 0) and not (r.kept and r.base_failed)
    kept = entries.where("kept").count()
    table = {r.rule: r for r in quality_rules.ablations(entries).collect()}
    assert table["few_words"].failed == entries.where("n_words < 10").count()
    assert all(r.kept_without == kept + r.failed_alone for r in table.values())


def test_quality_filter_keeps_columns_and_rows(spark):
    out = quality_rules.filter_documents(docs(spark))
    assert out.schema == DOCS
    kept = [r.doc_id for r in quality_rules.apply_policy(quality_rules.ledger(docs(spark))).where("kept").collect()]
    assert sorted((r.doc_id for r in out.collect()), key=lambda x: (x is None, x or 0)) == sorted(kept, key=lambda x: (x is None, x or 0))
    assert kept.count(30) == 3
    assert quality_rules.filter_documents(empty(spark)).count() == quality_rules.ledger(empty(spark)).count() == 0


def test_shards(spark):
    got = sharding.hilbert_shards(docs(spark), 7).collect()
    assert len(got) == len(ALL)
    slots, sizes = defaultdict(list), {(r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in ALL}
    for r in got:
        slots[r.shard].append(r.slot)
        assert (r.doc_id, r.size, r.text_crc32) in sizes and r.law == "rows" and r.grown_shard is None
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and set(slots) == set(range(7))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    order = [r.curve for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    assert sharding.hilbert_shards(empty(spark)).count() == 0
    assert sum(r.rows for r in sharding.shard_bounds(sharding.hilbert_shards(docs(spark), 7)).collect()) == len(ALL)


def test_hilbert_curve_steps_to_neighbours(spark):
    cells = spark.range(4096).selectExpr("CAST(id % 16 AS INT) x", "CAST(id DIV 16 % 16 AS INT) y", "CAST(id DIV 256 AS INT) z")
    got = sorted((r.h, r.x, r.y, r.z) for r in cells.withColumn("h", sharding.hilbert_index([F.col("x"), F.col("y"), F.col("z")])).collect())
    assert [g[0] for g in got] == list(range(4096))
    assert all(sum(abs(p - q) for p, q in zip(a[1:], b[1:])) == 1 for a, b in zip(got, got[1:]))


def test_next_text_and_edits(spark, tmp_path):
    some = [r for r in ALL if r[0] is not None]
    some = [r for i, r in enumerate(some) if r[0] not in {x[0] for x in some[:i]}]
    docs(spark, some).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in fingerprints.op7_fingerprints(spark, str(tmp_path)).collect()}
    line = sorted(((r[0], r[1] or "") for r in some), reverse=True)
    assert len(got) == len(line)
    for k, (d, t) in enumerate(line):
        nxt, n = line[(k + 1) % len(line)][1], len(t) // 3
        edited = t[:len(t) - n] + nxt[:n]
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1


def test_next_text_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 1)
    df = spark.range(0, 3000, 7).select((F.col("id") * F.col("id")).alias("doc_id"), F.col("id").cast("string").alias("text"))
    got = {r.doc_id: r.next_text for r in fingerprints.with_next_text(df).collect()}
    ids = sorted(got, reverse=True)
    text = {r.doc_id: r.text for r in df.collect()}
    assert all(got[a] == text[b] for a, b in zip(ids, ids[1:] + ids[:1]))
    assert fingerprints.with_next_text(empty(spark)).count() == 0
    one = fingerprints.with_next_text(docs(spark, [ALL[3], ALL[3]])).collect()
    assert [r.next_text for r in one] == ["one two three"] * 2


def test_fingerprints_are_homomorphic(spark):
    df = spark.createDataFrame([("a\nb\nc", "c\na\nb", "a\nb", "c", "a\nx\nc")], "t1 string, t2 string, t3 string, t4 string, t5 string")
    fp = {n: fingerprints.fingerprint(F.col(n)) for n in df.columns}
    r = df.select(*[fp[n].alias(n) for n in df.columns]).select(
        (F.col("t1") == F.col("t2")).alias("order"), (fingerprints.combine(F.col("t3"), F.col("t4")) == F.col("t1")).alias("added"),
        (fingerprints.combine(F.col("t1"), F.col("t4"), -1) == F.col("t3")).alias("taken"), fingerprints.likeness(F.col("t1"), F.col("t5")).alias("near")).first()
    assert r.order and r.added and r.taken and r.near == pytest.approx(0.5, abs=0.1)


def test_fingerprints_of_unlike_texts_differ(spark):
    df = spark.range(30000).select(F.concat(F.lit("paragraph "), F.col("id")).alias("t"))
    assert df.select(fingerprints.text_form(fingerprints.fingerprint(F.col("t"))).alias("fp")).distinct().count() == 30000
    one = df.where("t in ('paragraph 1', 'paragraph 2')").agg(F.min("t").alias("a"), F.max("t").alias("b")).select(*[fingerprints.fingerprint(F.col(c)).alias(c) for c in "ab"])
    same_lanes = one.select("a", F.struct(F.col("a.n").alias("n"), F.col("a.lanes").alias("lanes"), F.col("b.sums").alias("sums")).alias("b"))
    assert same_lanes.select(fingerprints.likeness(F.col("a"), F.col("b")).alias("x")).first().x < 1


def test_likeness_follows_the_share_of_paragraphs(spark):
    lines = [f"paragraph number {i}" for i in range(4000)]
    df = spark.createDataFrame([("\n".join(lines[:n]), "\n".join(lines[n // 4:n + n // 4])) for n in (40, 400, 3000)], "a string, b string")
    for r in df.select(fingerprints.likeness(fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b"))).alias("x")).collect():
        assert r.x == pytest.approx(0.6, abs=0.25)


def test_likeness_of_long_unlike_texts(spark):
    sizes = [(n,) for n in (5000, 20000, 50000, 100000, 400000)]
    numbers = F.sequence(F.lit(1), F.col("n"))
    lines = [F.concat(F.lit(c), F.array_join(numbers, f"\n{c}")) for c in "ab"]
    a, b = (fingerprints.fingerprint(x) for x in lines)
    got = spark.createDataFrame(sizes, "n int").select("n", a.alias("a"), b.alias("b")).select("n", fingerprints.likeness(F.col("a"), F.col("b")).alias("x")).collect()
    assert len(got) == len(sizes) and all(r.x <= 0.3 for r in got), got
    full = F.struct(F.lit(100_000_000).alias("n"), F.array_repeat(F.lit(1), fingerprints.LANES).alias("lanes"), F.array(F.lit(1)).cast("array<bigint>").alias("sums"))
    none = F.struct(F.lit(100_000_000).alias("n"), F.array_repeat(F.lit(0), fingerprints.LANES).alias("lanes"), F.array(F.lit(0)).cast("array<bigint>").alias("sums"))
    assert spark.range(1).select(full.alias("a"), none.alias("b")).select(fingerprints.likeness(F.col("a"), F.col("b")).alias("x")).first().x == 0


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in over}


def test_mix(spark):
    got = mixing.mix(docs(spark)).collect()
    assert len(got) == len(ALL)
    sizes, largest, taken, seen = defaultdict(int), defaultdict(int), defaultdict(int), {}
    for r in ALL:
        n = len(words(r[1]))
        sizes[r[3]] += n
        largest[r[3]] = max(largest[r[3]], n)
        seen.setdefault((r[0], n), r[3])
    want = plain_targets(sizes)
    for r in got:
        s = seen[(r.doc_id, r.size)]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 3 * largest[s] / 2 + 1 for s in want)  # some rows stand there three times
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, mixing.mix(docs(spark)).collect()), key=key)
    assert mixing.mix(empty(spark)).count() == 0
    assert [r.taken for r in mixing.mix(docs(spark, ALL[:3])).collect()] == [0, 0, 0]


def test_mixed_documents(spark):
    out = mixing.mixed_documents(docs(spark))
    assert out.schema == DOCS
    assert sum(len(words(r.text)) for r in out.collect()) == sum(r.taken for r in mixing.mix(docs(spark)).collect())
    clashing = docs(spark).withColumns({"rate": F.lit("x"), "CUT_U": F.lit("y")})
    assert mixing.mixed_documents(clashing).drop("rate", "CUT_U").exceptAll(out).isEmpty()
    assert mixing.mixed_documents(empty(spark)).count() == 0


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 100, "b": 1, "c": 1, "d": 1}, {"a": 5, "b": 1000, "c": 3, "d": 70, None: 9}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    assert {r.source: r.target for r in mixing.targets(df).collect()} == pytest.approx(plain_targets(sizes))
    for r in mixing.newton_rates(mixing.targets(df)).collect():
        assert r.rate == pytest.approx(r.target / r.source_size)


def test_native_operators_run_no_python(spark):
    for df in (quality_rules.ledger(docs(spark)), sharding.hilbert_shards(docs(spark)), fingerprints.fingerprints(docs(spark)), mixing.mix(docs(spark))):
        plan = df._jdf.queryExecution().toString()
        assert not any(w in plan for w in ("MapInArrow", "ArrowEvalPython", "BatchEvalPython"))
