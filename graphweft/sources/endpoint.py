"""A remote graph: an endpoint that answers SPARQL over HTTP with JSON results.

A predicate's triples are counted first, then read in pages of a fixed size that executors ask for in parallel; ordering by subject
and object makes the pages disjoint and a repeated request give the same page. Only counts come to the driver.

Blank nodes have labels of their own in each answer, so they can't be joined over pages; an endpoint that sends one is an error.
Other errors: a status other than 200, text that isn't JSON results, a yes or no in place of solutions. Repeated triples are none (graphs
are sets); an endpoint without triples gives an empty table.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..terms import LANG_STRING, XSD, EndpointError
from .graph import TRIPLES

ACCEPT = "application/sparql-results+json"


def solutions(text: str) -> list[dict[str, dict]]:
    """The rows of a JSON result: terms by variable, as dicts with type, value, datatype and xml:lang; unbound variables are absent."""
    try:
        found = json.loads(text)
    except ValueError as e:
        raise EndpointError(f"the answer isn't JSON: {e}") from None
    if not isinstance(found, dict) or not isinstance(found.get("results"), dict) or "bindings" not in found["results"]:
        raise EndpointError("the answer isn't a table of solutions")
    return found["results"]["bindings"]


def parts(term: dict) -> tuple[str, str, str | None, str | None]:
    """(kind, value, datatype, language) of a term of a JSON result."""
    kind, value = term.get("type"), term.get("value")
    if kind == "uri":
        return "iri", value, None, None
    if kind == "bnode":
        return "blank", value, None, None
    if kind in ("literal", "typed-literal"):
        lang = term.get("xml:lang")
        return "literal", value, LANG_STRING if lang else term.get("datatype") or XSD.string, lang.lower() if lang else None
    raise EndpointError(f"unknown kind of term {kind!r}")


def ask(url: str, query: str, timeout: float) -> list[dict[str, dict]]:
    """The solutions of one request."""
    request = urllib.request.Request(url + ("&" if "?" in url else "?") + urllib.parse.urlencode({"query": query}), headers={"Accept": ACCEPT})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            if answer.status != 200:
                raise EndpointError(f"status {answer.status}")
            return solutions(answer.read().decode("utf-8"))
    except urllib.error.HTTPError as e:
        raise EndpointError(f"status {e.code}") from None
    except OSError as e:
        raise EndpointError(f"no answer from {url}: {e}") from None


def triples(spark: SparkSession, url: str, predicates: list[str] | None = None, page: int = 10_000, timeout: float = 60.0) -> DataFrame:
    """The endpoint's triples with the columns of TRIPLES, one task's request for each ``page`` triples of a predicate."""
    if predicates is None:
        predicates = [row["p"]["value"] for row in ask(url, "SELECT DISTINCT ?p WHERE { ?s ?p ?o }", timeout)]
    pages = []
    for p in predicates:
        (row,) = ask(url, f"SELECT (COUNT(*) AS ?n) WHERE {{ ?s <{p}> ?o }}", timeout)
        pages += [(p, at) for at in range(0, int(row["n"]["value"]), page)]
    if not pages:
        return spark.createDataFrame([], TRIPLES)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, at in zip(batch["p"], batch["at"]):
                rows = []
                for found in ask(url, f"SELECT ?s ?o WHERE {{ ?s <{p}> ?o }} ORDER BY ?s ?o LIMIT {page} OFFSET {at}", timeout):
                    (s_kind, s, _, _), o = parts(found["s"]), parts(found["o"])
                    if "blank" in (s_kind, o[0]):
                        raise EndpointError(f"a blank node at <{p}> can't be joined over requests")
                    rows.append((s_kind, s, p, *o))
                yield pd.DataFrame(rows, columns=TRIPLES.names, dtype=object)

    asked = spark.createDataFrame(pages, "p string, at bigint").repartition(min(len(pages), 1000))
    return asked.mapInPandas(read, TRIPLES)
