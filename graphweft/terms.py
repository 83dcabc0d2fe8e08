"""RDF terms, namespaces, and the types of solution variables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class IRI:
    value: str

    def __str__(self) -> str:
        return f"<{self.value}>"


@dataclass(frozen=True)
class BlankNode:
    name: str

    def __str__(self) -> str:
        return f"_:{self.name}"


@dataclass(frozen=True)
class Variable:
    name: str

    def __str__(self) -> str:
        return f"?{self.name}"


@dataclass(frozen=True)
class Literal:
    lexical: str
    datatype: str = "http://www.w3.org/2001/XMLSchema#string"
    lang: str | None = None

    def __str__(self) -> str:
        tail = f"@{self.lang}" if self.lang else "" if self.datatype == XSD.string else f"^^<{self.datatype}>"
        return f'"{self.lexical}"{tail}'


Term = IRI | BlankNode | Literal
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDF_TYPE = IRI(RDF + "type")
LANG_STRING = RDF + "langString"


class Prefix:
    """A namespace: ``Prefix("http://example.org/").suf("a")`` or ``prefix.a`` is an IRI."""

    def __init__(self, iri: str):
        self._iri = iri

    def suf(self, name: str) -> IRI:
        return IRI(self._iri + name)

    def __getattr__(self, name: str) -> IRI:
        if name.startswith("_"):
            raise AttributeError(name)
        return IRI(self._iri + name)


class XSD:
    """Datatype IRIs as strings."""

    base = "http://www.w3.org/2001/XMLSchema#"
    string, boolean, integer, decimal = base + "string", base + "boolean", base + "integer", base + "decimal"
    double, float, long, int = base + "double", base + "float", base + "long", base + "int"
    short, byte, date, dateTime = base + "short", base + "byte", base + "date", base + "dateTime"
    dateTimeStamp, duration, anyURI = base + "dateTimeStamp", base + "duration", base + "anyURI"


#: Spark type of each datatype that has a native column; others are kept as their lexical form.
NATIVE: dict[str, T.DataType] = {
    XSD.string: T.StringType(), XSD.boolean: T.BooleanType(), XSD.integer: T.LongType(), XSD.long: T.LongType(),
    XSD.int: T.IntegerType(), XSD.short: T.ShortType(), XSD.byte: T.ByteType(), XSD.float: T.FloatType(),
    XSD.double: T.DoubleType(), XSD.decimal: T.DecimalType(38, 18), XSD.date: T.DateType(),
    XSD.dateTime: T.TimestampType(), XSD.dateTimeStamp: T.TimestampType(),
} | {XSD.base + n: T.LongType() for n in ("nonNegativeInteger", "positiveInteger", "unsignedInt", "unsignedShort", "negativeInteger", "nonPositiveInteger")}
#: Numeric datatypes by rising rank of promotion.
NUMERIC = [XSD.byte, XSD.short, XSD.int, XSD.long, XSD.integer, XSD.decimal, XSD.float, XSD.double]


def datatype_of(kind: T.DataType) -> str:
    """The datatype of a native Spark column."""
    for test, dt in ((T.BooleanType, XSD.boolean), (T.ByteType, XSD.byte), (T.ShortType, XSD.short), (T.IntegerType, XSD.int), (T.LongType, XSD.integer),
                     (T.FloatType, XSD.float), (T.DoubleType, XSD.double), (T.DecimalType, XSD.decimal), (T.DateType, XSD.date),
                     (T.TimestampType, XSD.dateTime), (T.TimestampNTZType, XSD.dateTime), (T.StringType, XSD.string)):
        if isinstance(kind, test):
            return dt
    return XSD.string


@dataclass(frozen=True)
class RdfType:
    """The static type of a variable.

    kind: ``iri``, ``blank``, ``literal`` (with a datatype), ``lang`` (struct of value and lang), ``term`` (several types: struct of
    kind, value, datatype, lang), ``row`` (identity of a table row), ``nested`` (a list) or ``none``. An ``iri`` with a ``template``
    holds only the key that is appended to that text.
    """

    kind: str
    datatype: str | None = None
    template: str | None = None

    @property
    def numeric(self) -> bool:
        return self.kind == "literal" and (self.datatype in NUMERIC or self.datatype in NATIVE and isinstance(NATIVE[self.datatype], T.LongType))

    def __str__(self) -> str:
        return self.datatype or self.kind


NONE, IRI_TYPE, BLANK_TYPE, TERM_TYPE, ROW_TYPE, LANG_TYPE, NESTED_TYPE = map(RdfType, ("none", "iri", "blank", "term", "row", "lang", "nested"))


def literal_type(datatype: str) -> RdfType:
    return RdfType("literal", datatype)


BOOLEAN, STRING, INTEGER, DOUBLE, DECIMAL, DATETIME = map(literal_type, (XSD.boolean, XSD.string, XSD.integer, XSD.double, XSD.decimal, XSD.dateTime))


class SparqlSyntaxError(ValueError):
    """The query text isn't SPARQL."""


class UnsupportedQueryError(ValueError):
    """The query is SPARQL, but of a kind that isn't answered here."""


class ConfigError(ValueError):
    """The engine is missing a part, or parts don't fit together."""


class UnknownResourceError(ConfigError):
    """A pattern or a catalog names a resource that isn't registered."""


class ResourceSchemaError(ConfigError):
    """A resource lacks a column that its template names."""


class EndpointError(RuntimeError):
    """A remote endpoint failed, or its answer isn't a table of solutions."""
