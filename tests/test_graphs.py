"""Sources, joins of unbound variables, named graphs, and random patterns against a plain evaluator."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from graphweft.engine import Catalog, DataProduct, Engine
from graphweft.sources.graph import Graph, Property, TableMap
from graphweft.sources.resource import Resource, Vocabulary, series_template
from graphweft.streaming import windowed
from graphweft.terms import IRI, XSD, ConfigError, Literal, ResourceSchemaError, UnsupportedQueryError

P = "PREFIX e: <http://e/> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> "
e = lambda n: IRI("http://e/" + n)


def ask(graph, text, **k):
    return sorted(map(tuple, Engine(graph.spark, graph, **k).query(P + text, native=True).collect()), key=repr)


def test_ntriples(spark, tmp_path):
    f = tmp_path / "g.nt"
    f.write_text('<http://e/a> <http://e/p> "x\\"y\\\\n" .\n# a comment\n\n<http://e/a> <http://e/q> "5"^^<http://www.w3.org/2001/XMLSchema#integer> .\n<http://e/a> <http://e/l> "hi"@EN .\n_:b <http://e/p> "z" .\n')
    g = Graph(spark).load_ntriples(str(f))
    assert ask(g, "SELECT ?o WHERE { e:a e:p ?o }") == [('x"y\\n',)]
    assert ask(g, "SELECT (?o + 1 AS ?x) WHERE { ?s e:q ?o }") == [(6,)]
    assert ask(g, "SELECT (LANG(?o) AS ?l) (STR(?o) AS ?t) WHERE { ?s e:l ?o }") == [("en", "hi")]
    (tmp_path / "bad.nt").write_text("<http://e/a> <http://e/p> .\n")
    with pytest.raises(ValueError):
        Graph(spark).load_ntriples(str(tmp_path / "bad.nt"))


def test_substr_positions(spark):
    g = Graph(spark).add_terms([(e("a"), e("p"), Literal("abcdef", XSD.string))])
    cases = [(1, None), (3, None), (0, None), (-2, None), (9, None), (0, 3), (-1, 4), (-9, 3), (2, 0), (2, 2), (5, 9), (7, 1)]
    calls = " ".join(f"(SUBSTR(?o, {at}{'' if n is None else f', {n}'}) AS ?c{k})" for k, (at, n) in enumerate(cases))
    want = tuple("".join(c for i, c in enumerate("abcdef", 1) if i >= at and (n is None or i < at + n)) for at, n in cases)
    assert ask(g, f"SELECT {calls} WHERE {{ ?s e:p ?o }}") == [want]
    assert ask(g, "SELECT (SUBSTR(?o, ?none) AS ?x) (SUBSTR(?none, 1) AS ?y) WHERE { ?s e:p ?o OPTIONAL { ?s e:q ?none } }") == [(None, None)]


def test_date_bin_weeks(spark):
    g = Graph(spark).add_terms([(e("a"), e("p"), Literal("2024-01-20T05:00:00Z", XSD.dateTime))])
    v = Vocabulary("http://e/")
    calls = " ".join(f'(STR(e:dateBin("{d}", ?t, "2024-01-01T00:00:00Z"^^xsd:dateTime)) AS ?d{k})' for k, d in enumerate(("P1W", "P2W", "P1WT12H", "P3M")))
    (got,) = ask(g, f"SELECT {calls} WHERE {{ ?s e:p ?t }}", vocabulary=v)
    assert [x and x[:13] for x in got] == ["2024-01-15T00", "2024-01-15T00", "2024-01-16T00", None]


def test_ntriples_lines_and_escapes(spark, tmp_path):
    f = tmp_path / "g.nt"
    f.write_text('<http://e/a> <http://e/p> "x\\u00e9 \\U0001F600 \\t\\b\\f\\\\ end" .\n  # note\n<http://e/\\u0062> <http://e/p> "plain" .\n')
    g = Graph(spark).load_ntriples(str(f))
    assert ask(g, "SELECT ?s ?o WHERE { ?s e:p ?o }") == [("http://e/a", "xé 😀 \t\b\f\\ end"), ("http://e/b", "plain")]
    assert "Partition" in Engine(spark, g).explain(P + "SELECT ?o WHERE { e:a e:p ?o }")
    f.write_text('<http://e/a> <http://e/p> "x" .\ngarbage\n')
    with pytest.raises(ValueError):
        Graph(spark).load_ntriples(str(f))


def test_unbound_variables_join_by_parts(spark):
    lit = lambda n: Literal(str(n), XSD.integer)
    g = Graph(spark).add_terms([(e(f"s{i}"), e("p"), lit(i)) for i in range(6)] + [(e(f"s{i}"), e("q"), lit(i % 3)) for i in range(0, 6, 2)] + [(e("z"), e("r"), lit(2)), (e("y"), e("r"), lit(5))])
    got = ask(g, "SELECT ?v ?x WHERE { ?s e:p ?v OPTIONAL { ?s e:q ?x } { ?t e:r ?x } }")
    q = {0: 0, 2: 2, 4: 1}
    assert got == sorted([(v, x) for v in range(6) for x in (2, 5) if v not in q or q[v] == x])
    left = ask(g, "SELECT ?v WHERE { { ?s e:p ?v OPTIONAL { ?s e:q ?x } } MINUS { ?t e:r ?x } }")
    assert left == [(v,) for v in range(6) if q.get(v) not in (2, 5)]
    assert "NestedLoop" not in Engine(spark, g).explain(P + "SELECT ?v WHERE { { ?s e:p ?v OPTIONAL { ?s e:q ?x } } MINUS { ?t e:r ?x } }")


def test_mixed_terms(spark):
    g = Graph(spark).add_terms([(e("a"), e("p"), Literal("1", XSD.integer)), (e("b"), e("p"), Literal("x")), (e("c"), e("p"), e("a"))])
    assert [r[0] for r in ask(g, "SELECT ?s WHERE { ?s e:p ?o FILTER(?o > 0) }")] == ["http://e/a"]
    assert [r[0] for r in ask(g, "SELECT ?s WHERE { ?s e:p ?o FILTER(ISIRI(?o)) }")] == ["http://e/c"]
    assert ask(g, "SELECT ?s ?t WHERE { ?s e:p ?t . ?t e:p ?z }")[0][0] == "http://e/c"


def test_errors_are_unbound(spark):
    g = Graph(spark).add_terms([(e("a"), e("p"), Literal("1", XSD.integer))])
    assert ask(g, "SELECT ?x ?y ?z WHERE { ?s e:p ?o BIND(?o / 0 AS ?x) BIND(?nope + 1 AS ?y) BIND(xsd:integer(\"q\") AS ?z) }") == [(None, None, None)]
    assert ask(g, "SELECT ?s WHERE { ?s e:p ?o FILTER(?nope > 1) }") == []
    assert ask(g, "SELECT ?s WHERE { ?s e:p ?o FILTER(?nope > 1 || ?o = 1) }") == [("http://e/a",)]


def test_named_graphs(spark):
    one, two = Graph(spark).add_terms([(e("a"), e("p"), Literal("1"))]), Graph(spark).add_terms([(e("b"), e("p"), Literal("2"))])
    g = Graph(spark).add_terms([(e("x"), e("p"), Literal("0"))]).add_graph(e("g1"), one).add_graph(e("g2"), two)
    assert ask(g, "SELECT ?o WHERE { GRAPH e:g1 { ?s e:p ?o } }") == [("1",)]
    assert ask(g, "SELECT ?g ?o WHERE { GRAPH ?g { ?s e:p ?o } }") == [("http://e/g1", "1"), ("http://e/g2", "2")]


def test_cyclic_closure(spark):
    g = Graph(spark).add_terms([(e("a"), e("p"), e("b")), (e("b"), e("p"), e("a")), (e("b"), e("p"), e("c"))])
    assert len(ask(g, "SELECT ?x ?y WHERE { ?x e:p+ ?y }")) == 6
    assert len(ask(g, "SELECT ?x ?y WHERE { ?x e:p* ?y }")) == 7


def test_null_cells_are_no_triples_and_keys_join_unrendered(spark):
    df = spark.createDataFrame([(1, "a", 2), (2, None, None)], "k int, n string, up int")
    g = Graph(spark).map_table(TableMap(df, "http://e/t/", "k", {e("n"): Property("n"), e("up"): Property("up", "http://e/t/")}, e("T")))
    assert ask(g, "SELECT ?x ?n WHERE { ?x a e:T OPTIONAL { ?x e:n ?n } }") == [("http://e/t/1", "a"), ("http://e/t/2", None)]
    assert ask(g, "SELECT ?y WHERE { ?x e:up ?y . ?y a e:T }") == [("http://e/t/2",)]
    assert ask(g, "SELECT ?n WHERE { <http://e/t/1> e:n ?n }") == [("a",)]
    assert ask(g, "SELECT ?n WHERE { <http://e/t/x> e:n ?n }") == []


def test_resources_are_checked(spark):
    df = spark.createDataFrame([("a", 1)], "id string, value int")
    with pytest.raises(ResourceSchemaError):
        Resource("r", df, series_template(Vocabulary()))
    good = Resource("r", df.withColumn("timestamp", F.current_timestamp()), series_template(Vocabulary()))
    with pytest.raises(ConfigError):
        Engine(spark, Graph(spark), [good, good])


def test_custom_functions_and_data_products(spark):
    g = Graph(spark).add_terms([(e("a"), e("p"), Literal("3", XSD.integer))])
    double = {"http://e/double": lambda v: (v[0] * 2, v[1])}
    assert ask(g, "SELECT ?y WHERE { ?s e:p ?o BIND(e:double(?o) AS ?y) }", functions=double) == [(6,)]
    with pytest.raises(UnsupportedQueryError):
        ask(g, "SELECT ?y WHERE { ?s e:p ?o BIND(e:nope(?o) AS ?y) }")
    Catalog({"prod": DataProduct(P + "SELECT ?o WHERE { ?s e:p ?o }", {"o": "string"})}).register(Engine(spark, g))
    assert spark.sql("SELECT o FROM prod").collect()[0].o == "3"


def test_streamed_buckets_equal_batch_ones(spark, tmp_path):
    rows = [("a", dt.datetime(2024, 1, 1, 0, 0, s), float(s)) for s in range(12)]
    batch = spark.createDataFrame(rows, "id string, timestamp timestamp, value double")
    batch.write.parquet(str(tmp_path / "in"))
    stream = windowed(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")), "5 seconds", ["avg", "count"], "1 minute")
    q = stream.writeStream.format("memory").queryName("buckets").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(spark.table("buckets")) == key(windowed(batch, "5 seconds", ["avg", "count"], "1 minute")) != []


@pytest.mark.parametrize("seed", range(6))
def test_random_patterns(spark, seed):
    """Basic patterns, OPTIONAL, UNION, MINUS and joins of unbound variables against nested loops over solutions."""
    r = random.Random(seed)
    names, preds = "abcdef", "pq"
    triples = sorted({(r.choice(names), r.choice(preds), r.choice(names)) for _ in range(25)})
    g = Graph(spark).add_terms([(e(s), e(p), e(o)) for s, p, o in triples])
    var = lambda: "?" + r.choice("xyz")
    bgp = lambda n: [(var(), r.choice(preds), r.choice([var(), r.choice(names)])) for _ in range(n)]
    a, b, c, d = bgp(2), bgp(1), bgp(1), bgp(1)
    text = lambda ts: " . ".join(f"{s} e:{p} {o if o[0] == '?' else 'e:' + o}" for s, p, o in ts)

    def match(ts):
        out = [{}]
        for t in ts:
            new = []
            for m in out:
                for row in triples:
                    n = dict(m)
                    if all(n.setdefault(x, v) == v if x[0] == "?" else x == v for x, v in zip(t, row)):
                        new.append(n)
            out = new
        return out

    fits = lambda m, n: all(m[k] == n[k] for k in m.keys() & n.keys())
    left = []
    for m in match(a):
        found = [m | n for n in match(b) if fits(m, n)]
        left += found or [m]
    both = [m | n for m in left for n in match(c) + match(d) if fits(m, n)]
    gone = match(d)
    kept = [m for m in both if not any(fits(m, n) and m.keys() & n.keys() for n in gone if True)]
    want = sorted(tuple(m.get(k) and "http://e/" + m[k] for k in ("?x", "?y", "?z")) for m in kept)
    got = ask(g, f"SELECT ?x ?y ?z WHERE {{ {text(a)} OPTIONAL {{ {text(b)} }} {{ {text(c)} }} UNION {{ {text(d)} }} MINUS {{ {text(d)} }} }}")
    assert sorted(got, key=repr) == sorted(want, key=repr)
