"""A remote graph behind a small HTTP server, the JSON reader, and SERVICE."""

import json
import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from graphweft.engine import Engine
from graphweft.sources.endpoint import ask, parts, solutions
from graphweft.sources.graph import Graph
from graphweft.terms import IRI, XSD, EndpointError, Literal, UnsupportedQueryError

P = "PREFIX e: <http://e/> "
u = lambda n: {"type": "uri", "value": "http://e/" + n}
lit = lambda v, **k: {"type": "literal", "value": v, **k}
DATA = [(u(f"n{k:02}"), "http://e/size", lit(str(k), datatype=XSD.integer)) for k in range(23)] + [(u("n03"), "http://e/label", lit("three", **{"xml:lang": "EN"})), (u("n03"), "http://e/near", u("n04"))]


class Store(BaseHTTPRequestHandler):
    """Answers the three forms of query that the source asks, in the order the text asks for."""

    asked: list = []

    def do_GET(self):  # noqa: N802
        text = parse_qs(urlparse(self.path).query)["query"][0]
        Store.asked.append(text)
        of = lambda p: sorted((s["value"], o["value"], s, o) for s, q, o in DATA if q == p)
        if self.path.startswith("/broken"):
            return self.answer(b"{", 200)
        if self.path.startswith("/down"):
            return self.answer(b"", 503)
        if self.path.startswith("/blank"):
            rows = [{"n": lit("1")}] if "COUNT" in text else [{"s": {"type": "bnode", "value": "b0"}, "o": u("x")}]
        elif "DISTINCT" in text:
            rows = [{"p": {"type": "uri", "value": p}} for p in sorted({p for _, p, _ in DATA})]
        else:
            p = re.search("<(.*?)>", text).group(1)
            limits = re.search(r"LIMIT (\d+) OFFSET (\d+)", text)
            rows = [{"n": lit(str(len(of(p))))}] if limits is None else [{"s": s, "o": o} for *_, s, o in of(p)[int(limits.group(2)):][:int(limits.group(1))]]
        self.answer(json.dumps({"head": {}, "results": {"bindings": rows}}).encode(), 200)

    def answer(self, body, status):
        self.send_response(status)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def url():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Store)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_all_predicates_in_pages(spark, url):
    g = Graph(spark).load_endpoint(url + "/sparql", page=5)
    rows = Engine(spark, g).query(P + "SELECT ?n ?x ?l WHERE { ?n e:size ?x OPTIONAL { ?n e:label ?t BIND(CONCAT(STR(?t), LANG(?t)) AS ?l) } FILTER(?x > 1) }").collect()
    assert sorted((r.x, r.l) for r in rows) == [(k, "threeen" if k == 3 else None) for k in range(2, 23)]
    assert sum("LIMIT 5" in t and "size" in t for t in Store.asked) == 5
    assert [tuple(r) for r in Engine(spark, g).query(P + "SELECT ?x WHERE { e:n03 e:near/e:size ?x }").collect()] == [(4,)]


def test_named_predicates_and_none(spark, url):
    assert [p.value for p in Graph(spark).load_endpoint(url, ["http://e/near"]).predicates()] == ["http://e/near"]
    assert Graph(spark).load_endpoint(url, ["http://e/absent"]).predicates() == []


def test_errors(spark, url):
    for path in ("/broken", "/down"):
        with pytest.raises(EndpointError):
            ask(url + path, "SELECT * WHERE { }", 5)
    with pytest.raises(EndpointError):
        ask("http://127.0.0.1:9", "SELECT * WHERE { }", 1)
    with pytest.raises(Exception, match="blank node"):
        Graph(spark).load_endpoint(url + "/blank", ["http://e/p"])


def test_json_reader():
    assert solutions('{"head": {"vars": ["x"]}, "results": {"bindings": [{}]}}') == [{}]
    for bad in ('{"head": {}, "boolean": true}', "[]", "nothing"):
        with pytest.raises(EndpointError):
            solutions(bad)
    assert parts(lit("5", datatype=XSD.integer)) == ("literal", "5", XSD.integer, None)
    assert parts({"type": "typed-literal", "value": "x"}) == ("literal", "x", XSD.string, None)
    assert parts({"type": "bnode", "value": "b"})[0] == "blank"
    with pytest.raises(EndpointError):
        parts({"type": "triple"})


def test_service(spark, url):
    remote = Graph(spark).load_endpoint(url, ["http://e/size"])
    local = Graph(spark).add_terms([(IRI("http://e/n05"), IRI("http://e/name"), Literal("five"))]).add_service(IRI("http://e/store"), remote)
    ask_ = lambda q: [tuple(r) for r in Engine(spark, local).query(P + q).collect()]
    assert ask_("SELECT ?name ?x WHERE { ?n e:name ?name SERVICE e:store { ?n e:size ?x } }") == [("five", 5)]
    assert ask_("SELECT ?name WHERE { ?n e:name ?name SERVICE SILENT e:other { ?n e:size ?x } }") == [("five",)]
    with pytest.raises(UnsupportedQueryError):
        ask_("SELECT ?name WHERE { ?n e:name ?name SERVICE e:other { ?n e:size ?x } }")
