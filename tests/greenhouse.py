"""A greenhouse site: four houses on two floors of a tree, five probes, a series each in one of two resources, made by rule."""

import datetime as dt

from graphweft.engine import Engine
from graphweft.sources.graph import Graph
from graphweft.sources.resource import Resource, Vocabulary, series_template
from graphweft.terms import IRI, XSD, Literal

G, S = "http://site.test/greenhouse/", "http://site.test/series/"
VOCABULARY = Vocabulary(S)
PREFIXES = f"PREFIX g: <{G}> PREFIX s: <{S}> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> "
#: House: (kind, crop or none, probes). Probe: (quantity, resource).
HOUSES = {"north": ("Glass", "tomato", ["n1", "n2"]), "south": ("Glass", None, ["s1"]), "dome": ("Foil", "basil", ["d1"]), "shed": ("Store", None, ["h1"])}
PROBES = {"n1": ("Warmth", "climate"), "n2": ("Damp", "climate"), "s1": ("Warmth", "climate"), "d1": ("Warmth", "climate"), "h1": ("Damp", "stock")}
PARENT = {"north": "east", "south": "east", "dome": "west", "shed": "west", "east": "site", "west": "site"}
START, STEP, POINTS = dt.datetime(2031, 3, 9, 22, 58, 30), 7, 25


def value(probe, k):
    """Point k of a probe's series."""
    return (sum(map(ord, probe)) * 13 + k * k * 5 + k * 17) % 90 - 20


def when(k):
    return START + dt.timedelta(seconds=STEP * k)


#: (house, probe, quantity, k, time, value) of every point.
ALL = [(h, p, PROBES[p][0], k, when(k), value(p, k)) for h, (_, _, ps) in HOUSES.items() for p in ps for k in range(POINTS)]


def triples():
    g, s, a = (lambda n: IRI(G + n)), (lambda n: IRI(S + n)), IRI("http://www.w3.org/1999/02/22-rdf-syntax-ns#type")
    for child, up in PARENT.items():
        yield g(child), g("within"), g(up)
    for h, (kind, crop, probes) in HOUSES.items():
        yield g(h), a, g(kind)
        if crop:
            yield g(h), g("grows"), Literal(crop, XSD.string)
        for p in probes:
            yield g(h), g("probe"), g(p)
    for p, (quantity, resource) in PROBES.items():
        yield g(p), a, g(quantity)
        yield g(p), s("hasTimeseries"), g("series-" + p)
        yield g("series-" + p), s("hasResource"), Literal(resource, XSD.string)
        yield g("series-" + p), s("hasExternalId"), Literal("id/" + p, XSD.string)


def frame(spark, resource):
    rows = [("id/" + p, t, v) for _, p, _, _, t, v in ALL if PROBES[p][1] == resource]
    return spark.createDataFrame(rows, "id string, timestamp timestamp, value int")


def build(spark, source=None, **options):
    graph = Graph(spark).add_terms(list(triples()))
    climate = frame(spark, "climate")
    resources = [Resource("climate", source(climate) if source else climate, series_template(VOCABULARY), **options), Resource("stock", frame(spark, "stock"), series_template(VOCABULARY))]
    return Engine(spark, graph, resources, VOCABULARY)


def plain(x):
    return x.removeprefix("<").removesuffix(">").removeprefix(G) if isinstance(x, str) else x


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))


def ask(engine, text):
    return order(tuple(plain(x) for x in r) for r in engine.query(PREFIXES + text).collect())
