"""Virtual triples: resources (relations with an ``id``) and the templates that read their rows as triples."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..terms import IRI, Literal, ResourceSchemaError, Variable

ID = Variable("id")
DEFAULT_NAMESPACE = "urn:graphweft:"


@dataclass(frozen=True)
class Vocabulary:
    """The IRIs that link graph nodes to series."""

    namespace: str = DEFAULT_NAMESPACE

    def _iri(self, name: str) -> str:
        return self.namespace + name

    has_timeseries = property(lambda self: self._iri("hasTimeseries"))
    has_resource = property(lambda self: self._iri("hasResource"))
    has_external_id = property(lambda self: self._iri("hasExternalId"))
    has_data_point = property(lambda self: self._iri("hasDataPoint"))
    has_value = property(lambda self: self._iri("hasValue"))
    has_timestamp = property(lambda self: self._iri("hasTimestamp"))
    floor_interval = property(lambda self: self._iri("FloorDateTimeToSecondsInterval"))
    date_bin = property(lambda self: self._iri("dateBin"))
    nest = property(lambda self: self._iri("nestAggregation"))


@dataclass(frozen=True)
class Parameter:
    """A template variable with a column of its name. The declared type is documentation: the column's own type counts."""

    variable: Variable
    rdf_type: str | None = None


@dataclass(frozen=True)
class TripleTemplate:
    s: Variable
    p: IRI
    o: Variable | IRI | Literal


@dataclass(frozen=True)
class Template:
    """Parameters and triples; triples start at the variable ``id``. Variables that aren't parameters are nodes without a column."""

    parameters: tuple[Parameter, ...]
    triples: tuple[TripleTemplate, ...]

    @property
    def columns(self) -> list[str]:
        return [p.variable.name for p in self.parameters]

    @property
    def predicates(self) -> set[IRI]:
        return {t.p for t in self.triples}


def series_template(vocabulary: Vocabulary) -> Template:
    """The usual template: an id has data points with a timestamp and a value."""
    v, dp, t, x = vocabulary, Variable("dp"), Variable("timestamp"), Variable("value")
    return Template((Parameter(ID), Parameter(t), Parameter(x)), (
        TripleTemplate(ID, IRI(v.has_data_point), dp), TripleTemplate(dp, IRI(v.has_value), x), TripleTemplate(dp, IRI(v.has_timestamp), t)))


@dataclass
class Resource:
    """A relation and its template. ``source`` is a DataFrame, or a function from a list of ids (or None for all) to one, for
    stores that should be asked for few ids: with up to ``push_ids`` matching ids in the graph the list is handed over."""

    name: str
    source: DataFrame | Callable[[list | None], DataFrame]
    template: Template
    push_ids: int = 0
    frame: DataFrame = field(init=False, default=None)

    def __post_init__(self):
        df = self.df(None)
        missing = [c for c in {"id", *self.template.columns} if c not in df.columns]
        if missing:
            raise ResourceSchemaError(f"resource {self.name} has no column {', '.join(sorted(missing))}")

    def df(self, ids: list | None) -> DataFrame:
        if callable(self.source) and not isinstance(self.source, DataFrame):
            return self.source(ids)
        return self.source if ids is None else self.source.where(self.source["id"].cast("string").isin(ids))
