"""The engine: SPARQL SELECT over a graph and its series, answered as one Spark DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession

from .functions import library
from .plans.planner import Planner
from .sources.graph import Graph
from .sources.resource import Resource, Vocabulary
from .sparql import algebra as A
from .sparql.parser import parse
from .terms import ConfigError, RdfType, UnknownResourceError


@dataclass
class Mappings:
    """A result with the RDF type of each variable, and notes on how resources were read."""

    mappings: DataFrame
    rdf_types: dict[str, RdfType]
    notes: list[str]


class Engine:
    """``functions``: IRI -> function of typed columns; ``aggregates``: IRI -> function of a column to an aggregated
    column, or to that and its RDF type."""

    def __init__(self, spark: SparkSession, graph: Graph, resources: Iterable[Resource] = (), vocabulary: Vocabulary | None = None,
                 functions: dict[str, Callable] | None = None, aggregates: dict[str, Callable[[Column], Column]] | None = None):
        if graph is None:
            raise ConfigError("an engine needs a graph")
        self.spark, self.graph, self.vocabulary = spark, graph, vocabulary or Vocabulary()
        self.resources = {}
        for r in resources:
            if r.name in self.resources:
                raise ConfigError(f"two resources are called {r.name}")
            self.resources[r.name] = r
        self.functions = {self.vocabulary.floor_interval: library.floor_to_seconds, self.vocabulary.date_bin: library.date_bin} | (functions or {})
        self.aggregates = aggregates or {}

    def resource(self, name: str) -> Resource:
        if name not in self.resources:
            raise UnknownResourceError(f"no resource {name}")
        return self.resources[name]

    def _plan(self, text: str):
        query = parse(text, self.vocabulary, frozenset(self.aggregates))
        planner = Planner(self.spark, self.graph, self.resources, self.vocabulary, self.functions, self.aggregates)
        return planner, planner.plan(query), tuple(A.in_scope(query))

    def query(self, text: str, native: bool = False, include_types: bool = False) -> DataFrame | Mappings:
        """Answer a query. IRIs and mixed terms are rendered as text, with ``native`` IRIs are bare and mixed terms structs."""
        planner, sol, names = self._plan(text)
        df = planner.result(sol, names, native)
        return Mappings(df, {n: sol.vars[n].type for n in names}, planner.notes) if include_types else df

    def explain(self, text: str, mode: str = "formatted") -> str:
        """The algebra, how resources are read, and Spark's plan."""
        planner, sol, names = self._plan(text)
        df = planner.result(sol, names, True)
        plan = df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))
        return "\n".join([str(parse(text, self.vocabulary, frozenset(self.aggregates))), *planner.notes, plan])


@dataclass
class DataProduct:
    """A query as a virtual SQL table. ``types``: Spark type names to cast columns to."""

    query: str
    types: dict[str, str] = field(default_factory=dict)


class Catalog:
    """Data products by name; ``register`` makes them temporary views, for SQL and for Spark's own SQL servers."""

    def __init__(self, products: dict[str, DataProduct]):
        self.products = products

    def register(self, engine: Engine) -> None:
        for name, product in self.products.items():
            df = engine.query(product.query, native=True)
            missing = product.types.keys() - set(df.columns)
            if missing:
                raise ConfigError(f"data product {name} has no column {', '.join(sorted(missing))}")
            df.select(*[df[c].cast(product.types[c]).alias(c) if c in product.types else df[c] for c in df.columns]).createOrReplaceTempView(name)
