"""Property paths. Sequences and inverses are triples already; here are alternatives, negated sets and closures.

Closures are semi-naive: each round joins the newest pairs with the edges and keeps what wasn't seen. Rounds are
checkpointed, so the plan doesn't grow and lost executors don't restart the closure. A constant end seeds the frontier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.graph import Graph
from ..terms import IRI, UnsupportedQueryError
from .scratch import checkpointed
from .solution import iri_text, term


def _rows(graph: Graph, p: IRI) -> DataFrame | None:
    out = None
    for e in graph.edges(p):
        # IRIs as text, anything else as the JSON of its term: one comparable key for the nodes of every source.
        s, o = (iri_text(c, t) if t.kind == "iri" else F.to_json(term(c, t)) for c, t in (e.s, e.o))
        df = e.df.select(s.alias("s"), o.alias("o")).where("s is not null and o is not null")
        out = df if out is None else out.union(df)
    return out


def _empty(graph: Graph) -> DataFrame:
    return graph.spark.createDataFrame([], "s string, o string")


def nodes(graph: Graph) -> DataFrame:
    """Every subject and object, once."""
    out = _empty(graph)
    for p in graph.predicates():
        rows = _rows(graph, p)
        out = out.union(rows.selectExpr("s", "s AS o")).union(rows.selectExpr("o AS s", "o"))
    return out.distinct()


def pairs(graph: Graph, path, start: str | None = None, end: str | None = None, virtual: frozenset[IRI] = frozenset()) -> DataFrame:
    """(s, o) of a path; ``start`` and ``end`` are the keys of constant ends, to seed closures from."""
    if isinstance(path, IRI):
        if path in virtual:
            raise UnsupportedQueryError("paths over virtual triples can only be sequences")
        rows = _rows(graph, path)
        return _empty(graph) if rows is None else rows
    op, args = path.op, path.args
    if op == "^":
        return pairs(graph, args[0], end, start, virtual).selectExpr("o AS s", "s AS o")
    if op == "/":
        out = pairs(graph, args[0], start, None, virtual)
        for a in args[1:]:
            step = pairs(graph, a, None, None, virtual).selectExpr("s AS m", "o AS e")
            out = out.join(step, F.col("o") == F.col("m")).selectExpr("s", "e AS o")
        return out
    if op == "|":
        out = pairs(graph, args[0], start, end, virtual)
        for a in args[1:]:
            out = out.union(pairs(graph, a, start, end, virtual))
        return out
    if op == "!":
        forward = {a for a in args if isinstance(a, IRI)}
        backward = {a[1] for a in args if not isinstance(a, IRI)}
        out = _empty(graph)
        for p in graph.predicates():
            if p not in forward and (forward or not backward):
                out = out.union(_rows(graph, p))
            if backward and p not in backward:
                out = out.union(_rows(graph, p).selectExpr("o AS s", "s AS o"))
        return out
    if op == "?":
        return pairs(graph, args[0], start, end, virtual).union(_same(graph, start, end)).distinct()
    closed = _closure(pairs(graph, args[0], None, None, virtual).distinct(), start, end)
    return closed if op == "+" else closed.union(_same(graph, start, end)).distinct()


def _same(graph: Graph, start: str | None, end: str | None) -> DataFrame:
    """Zero-length paths: a constant end is itself, else every node of the graph."""
    fixed = [k for k in (start, end) if k is not None]
    if fixed:
        return graph.spark.createDataFrame([(k, k) for k in dict.fromkeys(fixed)], "s string, o string")
    return nodes(graph)


def _closure(edges: DataFrame, start: str | None, end: str | None) -> DataFrame:
    if start is None and end is not None:
        return _closure(edges.selectExpr("o AS s", "s AS o"), end, None).selectExpr("o AS s", "s AS o")
    edges = checkpointed(edges)
    step = edges.selectExpr("s AS m", "o AS e")
    seen = newest = edges if start is None else edges.where(F.col("s") == start)
    while not newest.isEmpty():
        found = newest.join(step, F.col("o") == F.col("m")).selectExpr("s", "e AS o").distinct()
        newest = checkpointed(found.join(seen, ["s", "o"], "left_anti"))
        seen = checkpointed(seen.union(newest))
    return seen


def end_types(graph: Graph, path) -> tuple[set, set]:
    """The types that the two ends of a path can have."""
    if isinstance(path, IRI):
        edges = graph.edges(path)
        return {e.s[1] for e in edges}, {e.o[1] for e in edges}
    op, args = path.op, path.args
    if op == "/":
        return end_types(graph, args[0])[0], end_types(graph, args[-1])[1]
    if op == "^":
        return end_types(graph, args[0])[::-1]
    if op in "|+":
        both = [end_types(graph, a) for a in args]
        return set().union(*[b[0] for b in both]), set().union(*[b[1] for b in both])
    every = [end_types(graph, p) for p in graph.predicates()]
    nodes_ = set().union(*[a | b for a, b in every])
    return nodes_, nodes_
