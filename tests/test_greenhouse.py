"""One query for each operator over the greenhouse, held against plain Python over its points."""

from collections import defaultdict

import pytest
from greenhouse import ALL, HOUSES, PARENT, PREFIXES, PROBES, ask, build, order, when

READ = "?house g:probe ?probe . ?probe s:hasTimeseries/s:hasDataPoint ?point . ?point s:hasTimestamp ?at ; s:hasValue ?x . "
MID = when(12)
AFTER = f'"{MID.isoformat()}Z"^^xsd:dateTime'


@pytest.fixture(scope="module")
def site(spark):
    return build(spark)


def grouped(key, rows=ALL):
    out = defaultdict(list)
    for r in rows:
        out[key(r)].append(r[5])
    return out


def test_filter_on_value_time_and_class(site):
    got = ask(site, f"SELECT ?house ?at ?x WHERE {{ ?probe a g:Warmth . {READ} FILTER(?x >= 40 && ?at >= {AFTER}) }}")
    assert got == order((h, t, x) for h, _, q, _, t, x in ALL if q == "Warmth" and x >= 40 and t >= MID)


def test_nothing_matches(site):
    assert ask(site, "SELECT ?x WHERE { ?probe a g:Noise . " + READ + "}") == []


def test_join_of_two_series_on_time(site):
    got = ask(site, """SELECT ?at ?x ?y WHERE { g:n1 s:hasTimeseries/s:hasDataPoint ?p . ?p s:hasTimestamp ?at ; s:hasValue ?x .
        g:d1 s:hasTimeseries/s:hasDataPoint ?q . ?q s:hasTimestamp ?at ; s:hasValue ?y FILTER(?y > ?x) }""")
    a, b = ({r[4]: r[5] for r in ALL if r[1] == p} for p in ("n1", "d1"))
    assert got == order((t, a[t], b[t]) for t in a if b[t] > a[t])


def test_group_and_aggregates(site):
    got = ask(site, "SELECT ?house (SUM(?x) AS ?a) (MIN(?x) AS ?b) (MAX(?x) AS ?c) (COUNT(?x) AS ?n) WHERE {" + READ + "} GROUP BY ?house")
    assert got == order((h, sum(v), min(v), max(v), len(v)) for h, v in grouped(lambda r: r[0]).items())


def test_group_by_minute_with_having(site):
    got = ask(site, "SELECT ?probe ?m (AVG(?x) AS ?mean) WHERE {" + READ + "BIND(MINUTES(?at) AS ?m) } GROUP BY ?probe ?m HAVING(COUNT(?x) > 5)")
    want = [(*k, pytest.approx(sum(v) / len(v))) for k, v in grouped(lambda r: (r[1], r[4].minute)).items() if len(v) > 5]
    assert got == sorted(want, key=lambda r: r[:2]) and got


def test_label_of_a_period(site):
    got = ask(site, 'SELECT DISTINCT ?label WHERE {' + READ + 'BIND(CONCAT(STR(YEAR(?at)), "/", STR(MONTH(?at)), "/", STR(DAY(?at)), " ", STR(HOURS(?at)), "h", STR(xsd:integer(FLOOR(SECONDS(?at) / 20)))) AS ?label) }')
    assert got == order({(f"{t.year}/{t.month}/{t.day} {t.hour}h{t.second // 20}",) for *_, t, _ in ALL})


def test_union_of_groups(site):
    part = '{{ SELECT ?probe ?side (COUNT(?x) AS ?n) WHERE {{ ' + READ + 'FILTER(?x {0}) BIND("{1}" AS ?side) }} GROUP BY ?probe ?side }}'
    got = ask(site, f"SELECT ?probe ?side ?n WHERE {{ {part.format('< 0', 'frost')} UNION {part.format('> 60', 'heat')} }}")
    cold, hot = grouped(lambda r: r[1], [r for r in ALL if r[5] < 0]), grouped(lambda r: r[1], [r for r in ALL if r[5] > 60])
    assert got == order([(p, "frost", len(v)) for p, v in cold.items()] + [(p, "heat", len(v)) for p, v in hot.items()])


def test_concatenation_follows_the_order(site):
    got = ask(site, f'SELECT ?probe (GROUP_CONCAT(?x ; separator="|") AS ?all) WHERE {{ SELECT * WHERE {{ {READ} FILTER(?at < {AFTER}) }} ORDER BY ?probe ?at }} GROUP BY ?probe')
    assert got == order((p, "|".join(map(str, v))) for p, v in grouped(lambda r: r[1], [r for r in ALL if r[4] < MID]).items())


@pytest.mark.parametrize("word", ["EXISTS", "NOT EXISTS"])
def test_existence_of_points_and_of_static_parts(site, word):
    want = {r[0] for r in ALL if r[5] > 66}
    got = ask(site, f"SELECT ?house WHERE {{ ?house g:within ?floor ; g:probe ?any FILTER {word} {{ SELECT ?house WHERE {{ {READ} FILTER(?x > 66) }} }} }}")
    assert {h for h, in got} == (want if word == "EXISTS" else HOUSES.keys() - want)
    got = ask(site, f"SELECT ?house (SUM(?x) AS ?n) WHERE {{ {READ} FILTER {word} {{ ?house g:grows ?crop }} }} GROUP BY ?house")
    assert got == order((h, sum(v)) for h, v in grouped(lambda r: r[0]).items() if (HOUSES[h][1] is not None) == (word == "EXISTS"))


def test_minus(site):
    got = ask(site, "SELECT ?probe ?x WHERE {" + READ + "MINUS { ?point s:hasValue ?x FILTER(?x > 10) } }")
    assert got == order((p, x) for _, p, _, _, _, x in ALL if x <= 10)


def test_optional_parts(site):
    got = ask(site, "SELECT ?house ?crop WHERE { ?house g:probe ?p OPTIONAL { ?house g:grows ?crop } }")
    assert got == order((h, crop) for h, (_, crop, ps) in HOUSES.items() for _ in ps)
    got = ask(site, "SELECT ?x ?hot WHERE { g:s1 s:hasTimeseries/s:hasDataPoint/s:hasValue ?x OPTIONAL { BIND(?x > 5 AS ?hot) FILTER(?hot) } }")
    assert len(got) == 25 and all(hot is None for _, hot in got)  # ?x isn't in the part's scope


def test_optional_with_a_condition_and_coalesce(site):
    got = ask(site, """SELECT ?x ?y (COALESCE(?y, -99) AS ?z) WHERE { g:n1 s:hasTimeseries/s:hasDataPoint ?p . ?p s:hasTimestamp ?at ; s:hasValue ?x
        OPTIONAL { g:n2 s:hasTimeseries/s:hasDataPoint ?q . ?q s:hasTimestamp ?then ; s:hasValue ?y FILTER(?then = ?at && ?y < ?x) } }""")
    a, b = ({r[4]: r[5] for r in ALL if r[1] == p} for p in ("n1", "n2"))
    assert got == order((a[t], b[t] if b[t] < a[t] else None, b[t] if b[t] < a[t] else -99) for t in a)


@pytest.mark.parametrize("tail", ["FILTER(?x IN (-3, 4 * 2, 61))", "VALUES ?x { -3 8 61 }"])
def test_lists_of_values(site, tail):
    assert ask(site, "SELECT ?probe ?x WHERE {" + READ + tail + "}") == order((r[1], r[5]) for r in ALL if r[5] in (-3, 8, 61))


def test_if_and_distinct(site):
    got = ask(site, 'SELECT DISTINCT ?house ?band WHERE {' + READ + 'BIND(IF(?x < 0, "frost", IF(?x < 40, "mild", "hot")) AS ?band) }')
    assert got == order({(r[0], "frost" if r[5] < 0 else "mild" if r[5] < 40 else "hot") for r in ALL})


@pytest.mark.parametrize("limit, offset", [(4, 0), (6, 118), (500, 3)])
def test_order_limit_offset(site, limit, offset):
    got = site.query(PREFIXES + f"SELECT ?probe ?at ?x WHERE {{ {READ} }} ORDER BY DESC(?x) ?probe ?at LIMIT {limit} OFFSET {offset}").collect()
    want = sorted(ALL, key=lambda r: (-r[5], r[1], r[4]))[offset:offset + limit]
    assert [r.x for r in got] == [r[5] for r in want]


def test_paths(site):
    def above(x):
        return [PARENT[x], *above(PARENT[x])] if x in PARENT else []
    assert ask(site, "SELECT ?a ?b WHERE { ?a g:within+ ?b }") == order((x, y) for x in PARENT for y in above(x))
    assert ask(site, "SELECT ?b WHERE { g:dome g:within* ?b }") == order((x,) for x in ["dome", *above("dome")])
    assert ask(site, "SELECT ?p WHERE { g:site ^g:within/^g:within/g:probe ?p }") == order((p,) for p in PROBES)
    assert ask(site, "SELECT ?p WHERE { g:east (^g:within|g:probe)+ ?p }") == order((x,) for x in ("north", "south", "n1", "n2", "s1"))
    got = ask(site, "SELECT ?h (MAX(?x) AS ?top) WHERE { ?h g:probe/s:hasTimeseries/s:hasDataPoint/s:hasValue ?x } GROUP BY ?h")
    assert got == order((h, max(v)) for h, v in grouped(lambda r: r[0]).items())


def test_series_block(site):
    block = "SELECT ?house ?probe WHERE { ?house a g:Foil ; g:probe ?probe . ?probe s:hasTimeseries ?ts . DT { %s } }"
    df = site.query(PREFIXES + block % f"timeseries = ?ts, from = {AFTER.split('^')[0]},")
    assert df.columns == ["house", "probe", "timestamp", "ts_value"]
    assert sorted(tuple(r)[2:] for r in df.collect()) == [(r[4], r[5]) for r in ALL if r[1] == "d1" and r[4] >= MID]
    df = site.query(PREFIXES + block % f'from = {AFTER.split("^")[0]}, aggregation = "max", interval = "30s",')
    bins = defaultdict(list)
    for r in ALL:
        if r[1] == "d1" and r[4] >= MID:
            bins[r[4].replace(second=r[4].second // 30 * 30)].append(r[5])
    assert sorted(tuple(r)[2:] for r in df.collect()) == sorted((t, max(v)) for t, v in bins.items())


def test_types_notes_and_plan(site):
    got = site.query(PREFIXES + "SELECT ?probe ?x ?at WHERE {" + READ + "}", include_types=True)
    assert [str(t) for t in got.rdf_types.values()] == ["iri", "http://www.w3.org/2001/XMLSchema#int", "http://www.w3.org/2001/XMLSchema#dateTime"]
    assert any("resource climate" in n for n in got.notes)
    assert "Physical Plan" in site.explain(PREFIXES + "SELECT ?h WHERE { ?h a g:Glass }")


def test_a_constant_value_and_ids_for_a_remote_store(spark, site):
    x = ALL[3][5]
    assert ask(site, f"SELECT ?probe WHERE {{ ?probe s:hasTimeseries/s:hasDataPoint ?p . ?p s:hasValue {x} }}") == order((r[1],) for r in ALL if r[5] == x)
    asked = []

    def source(df):
        def read(ids):
            asked.append(ids)
            return df if ids is None else df.where(df.id.isin(ids))
        return read
    remote = build(spark, source, push_ids=5)
    got = ask(remote, "SELECT ?x WHERE { ?house a g:Foil . " + READ + "}")
    assert got == order((r[5],) for r in ALL if r[0] == "dome") and asked[-1] == ["id/d1"]
