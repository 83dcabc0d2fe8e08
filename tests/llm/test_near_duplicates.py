"""The shingle join against all pairs, and the pipeline against plain steps."""

import math
from collections import Counter, defaultdict
import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from helpers import DOCS, components, docs, empty, key, repeated_words, rows, sentence, shingles, words
from test_native import plain_targets

from graphweft.llm import common, jaccard_join, pieces, pii
from graphweft.llm.shingles import exact_set, shingle_sets

ALL = rows()


def test_shingle_hashes_count_as_words_do():
    texts = [r[1] or "" for r in ALL] + ["", "a b c d e", "a b c d e f a b c d e", "É é É é É", "x" * 5000]
    hashes, offs = shingle_sets(pa.array(texts))
    assert np.diff(offs).tolist() == [len(shingles(t)) for t in texts] == [len(exact_set(t)) for t in texts]
    sliced, o2 = shingle_sets(pa.array(texts)[3:9])
    assert (sliced == hashes[offs[3]:offs[9]]).all() and (np.diff(o2) == np.diff(offs)[3:9]).all()
    assert len(shingle_sets(pa.array([], pa.string()))[0]) == 0


def test_differences_are_a_lower_bound():
    r = random.Random(4)
    for _ in range(300):
        a, b = {r.getrandbits(64) for _ in range(r.randint(1, 300))}, {r.getrandbits(64) for _ in range(r.randint(1, 300))}
        b |= set(list(a)[:r.randint(0, len(a))])
        arrays = [np.sort(np.array(list(x), np.uint64)) for x in (a, b)]
        offs = np.array([0, len(a), len(a) + len(b)])
        p, q = jaccard_join._parities(np.concatenate(arrays), offs, np.diff(offs))
        assert jaccard_join._differences(p, q) == jaccard_join._differences(q, p) <= len(a ^ b)


@pytest.mark.parametrize("frequent", ["none", "some", "all"])
def test_linked_sets_share_a_signature(frequent):
    """The pigeonhole argument, for any choice of frequent shingles."""
    r = random.Random(len(frequent))
    for n in [*range(1, 40), 64, 65, 127, 128, 129, 300, 1000]:
        a = {r.getrandbits(64) for _ in range(n)}
        drop = r.randint(0, n // 4)
        b = set(list(a)[drop:]) | {r.getrandbits(64) for _ in range(r.randint(0, max(0, (n - drop) * 4 // 3 - n)))}
        if not b or 100 * len(a & b) < 75 * len(a | b):
            continue
        every = np.sort(np.array(list(a | b), np.uint64))
        common = {"none": every[:0], "some": every[::2], "all": every}[frequent]
        arrays = [np.sort(np.array(list(x), np.uint64)) for x in (a, b)]
        sig, owner, _, _ = jaccard_join.Signer(np.sort(common)).sign(np.concatenate(arrays), np.array([0, len(a), len(a) + len(b)]))
        assert set(sig[owner == 0].tolist()) & set(sig[owner == 1].tolist())


def test_prefixes_of_linked_sets_share_a_signature():
    """The allocation: under any one order of signatures, sets may leave out as many of their last level-0 signatures as their slack says."""
    r = random.Random(8)
    for n in [*range(5, 60, 3), 127, 128, 300, 700]:
        a = {r.getrandbits(64) for _ in range(n)}
        b = set(list(a)[r.randint(0, n // 5):])
        if 100 * len(a & b) < 75 * len(a | b):
            continue
        arrays = [np.sort(np.array(list(x), np.uint64)) for x in (a, b)]
        sig, owner, role, code = jaccard_join.Signer(np.zeros(0, np.uint64)).sign(np.concatenate(arrays), np.array([0, len(a), len(a) + len(b)]))
        for salt in range(5):
            left = []
            for who in (0, 1):
                mine = set()
                for part in (0, 1):
                    at = (owner == who) & (role == part)
                    c = int(code[at].min(initial=127))
                    spare = math.floor(2 ** ((c - 1) / 8)) - 1 if c else 0
                    ordered = sorted(sig[at].tolist(), key=lambda x: hash((salt, x)))
                    mine |= set(ordered[:len(ordered) - spare])
                left.append(mine)
            assert left[0] & left[1]


def test_texts_longer_than_a_block_of_hashes(monkeypatch):
    from graphweft.llm import shingles as module
    texts = pa.array([" ".join(f"w{i % 977}é" for i in range(30_000)), "x" * 400_000 + " a b c d", ""])
    whole = shingle_sets(texts)
    monkeypatch.setattr(module, "CHUNK", 100)
    cut = shingle_sets(texts)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def test_of_rows_with_one_id_the_least_stays(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    made = [(1, b, "x"), (1, a, "z"), (1, a, "y"), (2, a + " c", "x"), (3, None, "x"), (3, "", "w"), (None, a, "q")]
    for rows_ in (made, made[::-1]):
        out = jaccard_join.without_near_duplicates(spark.createDataFrame(rows_, "doc_id bigint, text string, source string"))
        assert sorted(map(tuple, out.collect()), key=key) == sorted([(1, a, "y"), (3, None, "x"), (None, a, "q")], key=key)


def test_components(spark):
    got = sorted(map(tuple, jaccard_join.components(docs(spark)).collect()), key=key)
    comp, sizes = components([(r[0], r[1]) for r in ALL])
    want = [(r[0], n, c if n else r[0]) for r, n, c in zip(ALL, sizes, comp, strict=True)]
    assert got == sorted(want, key=key)
    assert jaccard_join.components(empty(spark)).count() == 0


def test_components_of_a_family_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "FREQUENT", 8)
    r = random.Random(9)
    base, passage, made = sentence(r, 90).split(), sentence(r, 60), []
    for k in range(150):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = f"n{r.random()}"
        made.append((k, " ".join(w)))
    made += [(k, passage + " " + " ".join(f"u{r.random()}" for _ in range(r.randint(10, 60)))) for k in range(150, 230)]
    got = {x.doc_id: x.component_id for x in jaccard_join.components(spark.createDataFrame(made, "doc_id bigint, text string")).collect()}
    assert got == dict(zip([k for k, _ in made], components(made)[0], strict=True))


@pytest.mark.parametrize(("file_rows", "files"), [(100_000, 1), (20, 3)])
def test_components_of_few_edges_are_few_files(spark, monkeypatch, file_rows, files):
    monkeypatch.setattr(common, "FILE_ROWS", file_rows, raising=False)
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 60) if k % 20 < 18] + [(5, 0)], "a bigint, b bigint")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = common.connected_components(edges, "a", "b")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r.node, r.component) for r in out.collect()} == {(k, k // 20 * 20) for k in range(60) if k % 20 < 19}
    assert len(out.inputFiles()) <= files


@pytest.mark.parametrize("broadcast_rows", [400_000, 0])
def test_a_large_family_is_not_dealt_to_one_task(spark, monkeypatch, broadcast_rows):
    """Its rows meet their family's sizes by broadcast, or in a join without the aggregate, which Spark can split."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast_rows)
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    plans, write = [], jaccard_join.written
    monkeypatch.setattr(jaccard_join, "written", lambda df, owner=None: (plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString())), write(df, owner))[1])
    n, par = 200, b"\0" * 8
    members = write(spark.createDataFrame([(1, k, 10, 0 if k < 150 else k) for k in range(n)] + [(2, 500 + k, 10, k) for k in range(2)], "run bigint, rep bigint, n bigint, comp bigint"))
    parities = write(spark.createDataFrame([(k, par) for k in [*range(n), 500, 501]], "rep bigint, par binary"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = sorted(map(tuple, jaccard_join._across(members, parities, []).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == [(a, b) for a in range(n) for b in range(max(a + 1, 150), n)] + [(500, 501)]
    (plan,) = [p for columns, p in plans if "main" in columns]
    assert "Join" in plan and "Aggregate" not in plan
    assert ("hashpartitioning(family" in plan) == (not broadcast_rows)


def test_one_of_each_group_stays(spark):
    out = jaccard_join.without_near_duplicates(docs(spark))
    assert out.schema == DOCS
    comp, sizes = components([(r[0], r[1]) for r in ALL])
    want = {r[0] for r, n, c in zip(ALL, sizes, comp, strict=True) if r[0] is not None and (not n or c == r[0])}
    ids = [r.doc_id for r in out.collect()]
    assert {i for i in ids if i is not None} == want and len([i for i in ids if i is not None]) == len(want) and ids.count(None) == 2


def test_pipeline_against_plain_steps(spark, tmp_path):
    docs(spark).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "mix", "encode"]
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = stages["quality"](spark, table, str(tmp_path))
    assert kept.schema == table.schema
    plain = [r for r in ALL if len(words(r[1])) >= 10 and 100 * repeated_words(r[1]) <= 20 * len(words(r[1]))]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r[0] for r in plain}
    assert {r.doc_id for r in got} <= ids
    comp, _ = components([(r[0], r[1]) for r in map(tuple, kept.collect())])
    assert {r.doc_id for r in got if r.doc_id is not None} <= {c for c in comp if c is not None}
    model, texts = pieces.Pieces.load(), {r[0]: r[1] for r in ALL if r[0] is not None}
    find = pii.finder()
    for r in got:
        if r.doc_id is not None:
            assert model.decode(r.ids) == pii.mask_text(texts[r.doc_id], sum(find(texts[r.doc_id]), []))


def plain_pipeline(spark, items):
    """items: (doc_id, text, lang, source) -> expected (doc_id, lang, source, decoded text) rows of the pipeline but the order; only row hashes come from Spark."""
    def clean(t):
        w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        return (len(w) >= 10 and 100 * repeated_words(t) <= 20 * len(w) and 2 * sum((t or "").count(c) for c in "#*$%&|<>") <= len(w)
                and 100 * (len(lines) - len(set(lines))) <= 30 * len(lines) and 2 * len(w) <= sum(map(len, w)) <= 25 * len(w))
    kept = [r for r in items if clean(r[1])]
    comp, _ = components([(r[0], r[1]) for r in kept])
    seen, left, find = set(), [], pii.finder()
    for r, c in zip(kept, comp, strict=True):
        if r[0] is None or (c == r[0] and r[0] not in seen):
            seen.add(r[0])
            left.append((r[0], pii.mask_text(r[1], sum(find(r[1]), [])), *r[2:]))
    table = spark.createDataFrame([(k, r[0], r[1]) for k, r in enumerate(left)], "k int, id bigint, t string")
    u = {r.k: r.u for r in table.selectExpr("k", "xxhash64(id, xxhash64(t)) u").collect()}
    sizes, before, out = defaultdict(int), defaultdict(int), []
    for r in left:
        sizes[r[3]] += len(words(r[1]))
    goal = plain_targets(sizes)
    for k in sorted(u, key=lambda k: (u[k] % 2**64 >> 52, u[k])):
        r, n = left[k], len(words(left[k][1]))
        rate = min(3.0, goal[r[3]] / sizes[r[3]])
        whole = math.floor(rate + 1e-9)
        out += [(r[0], r[2], r[3], r[1])] * (whole + (before[r[3]] + n / 2 < (rate - whole) * sizes[r[3]]))
        before[r[3]] += n
    return out


def test_pipeline_gives_every_row_of_the_plain_version(spark, tmp_path):
    some = [*ALL, (900, "write to a@b.co now " + " ".join(f"w{i}" for i in range(40)), "en", "s1", 5, *ALL[0][5:])]
    docs(spark, some).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    model = pieces.Pieces.load()
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = plain_pipeline(spark, [r[:4] for r in some])
    assert len(want) > 20 and Counter((r.doc_id, r.lang, r.source, model.decode(r.ids)) for r in got) == Counter(want)
    assert all(r.n_tokens == len(r.ids) and list(r.ids) == list(model.encode(model.decode(r.ids))) for r in got)
