"""The static graph: tables mapped to triples without materialising them, and triples loaded from N-Triples or Turtle."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..terms import BLANK_TYPE, IRI, IRI_TYPE, LANG_STRING, LANG_TYPE, NATIVE, RDF_TYPE, STRING, TERM_TYPE, XSD, BlankNode, Literal, RdfType, Term, datatype_of, literal_type

TRIPLES = T.StructType([T.StructField(n, T.StringType()) for n in ("s_kind", "s", "p", "o_kind", "o", "o_datatype", "o_lang")])


@dataclass(frozen=True)
class Property:
    """The object of a mapped predicate: a column as a literal, a column as the key of an IRI template, or a constant."""

    column: str | None = None
    template: str | None = None
    constant: Term | None = None


@dataclass
class TableMap:
    """Rows as nodes: the subject is ``template`` + the key column; each predicate has a property of the row. Keys are unique."""

    df: DataFrame
    template: str
    key: str
    properties: dict[IRI, Property] = field(default_factory=dict)
    rdf_class: IRI | None = None

    def __post_init__(self):
        if self.rdf_class is not None:
            self.properties = {RDF_TYPE: Property(constant=self.rdf_class)} | self.properties

    def key_type(self, column: str) -> str:
        return "int" if isinstance(self.df.schema[column].dataType, T.IntegralType) else "text"

    @property
    def subject(self) -> tuple[Column, RdfType]:
        return F.col(self.key), RdfType("iri", self.key_type(self.key), self.template)

    def object(self, p: IRI) -> tuple[Column, RdfType]:
        prop = self.properties[p]
        if prop.constant is not None:
            return constant(prop.constant)
        if prop.template is not None:
            return F.col(prop.column), RdfType("iri", self.key_type(prop.column), prop.template)
        return F.col(prop.column), column_type(self.df.schema[prop.column].dataType)


def column_type(kind: T.DataType) -> RdfType:
    if isinstance(kind, T.TimestampNTZType):
        return RdfType("literal", XSD.dateTime, "ntz")
    return RdfType("nested") if isinstance(kind, T.ArrayType) else literal_type(datatype_of(kind))


def constant(t: Term) -> tuple[Column, RdfType]:
    """A term as a typed literal column; malformed lexical forms are null."""
    if isinstance(t, IRI):
        return F.lit(t.value), IRI_TYPE
    if isinstance(t, BlankNode):
        return F.lit(t.name), BLANK_TYPE
    if t.lang is not None:
        return F.struct(F.lit(t.lexical).alias("value"), F.lit(t.lang).alias("lang")), LANG_TYPE
    if t.datatype == XSD.string:
        return F.lit(t.lexical), STRING
    if t.datatype == XSD.decimal:
        digits = t.lexical.lstrip("+-").replace(".", "")
        scale = len(t.lexical.partition(".")[2])
        return F.lit(t.lexical).try_cast(T.DecimalType(min(38, max(len(digits), scale + 1, 1)), min(scale, 37))), literal_type(XSD.decimal)
    if t.datatype in NATIVE:
        return F.lit(t.lexical).try_cast(NATIVE[t.datatype]), literal_type(t.datatype)
    return F.lit(t.lexical), literal_type(t.datatype)


@dataclass
class Edge:
    """Rows (s, o) of one predicate in one source. ``table`` is set for mapped tables, so patterns on one subject share a scan."""

    df: DataFrame
    s: tuple[Column, RdfType]
    p: IRI
    o: tuple[Column, RdfType]
    table: TableMap | None = None


class Graph:
    """Mapped tables and triples. ``named``: graphs by IRI, for GRAPH patterns; ``services``: graphs by IRI, for SERVICE patterns."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables, self.named, self.services = spark, [], {}, {}
        self.triples: DataFrame | None = None
        self._kinds: dict[str, list[tuple[str, str, str | None, bool]]] = {}

    def map_table(self, table: TableMap) -> Graph:
        self.tables.append(table)
        return self

    def add_graph(self, name: IRI, graph: Graph) -> Graph:
        self.named[name.value] = graph
        return self

    def add_service(self, name: IRI, graph: Graph) -> Graph:
        self.services[name.value] = graph
        return self

    def load_endpoint(self, url: str, predicates: list[str] | None = None, **options) -> Graph:
        """Read an endpoint's triples, of all predicates or those named, in pages and in parallel (:func:`graphweft.sources.endpoint.triples`)."""
        from ..operators.scratch import stored
        from .endpoint import triples

        return self.add_triples(stored(triples(self.spark, url, predicates, **options), "p"))

    def add_triples(self, df: DataFrame) -> Graph:
        """Add a DataFrame with the columns of TRIPLES. The kinds of each predicate's terms are looked up once: that many rows
        come to the driver, no triples."""
        df = df.select(*TRIPLES.names)
        self.triples = df if self.triples is None else self.triples.union(df).distinct()
        self._kinds = {}
        for r in self.triples.select("p", "s_kind", "o_kind", "o_datatype", F.col("o_lang").isNotNull().alias("tagged")).distinct().collect():
            self._kinds.setdefault(r.p, []).append((r.s_kind, r.o_kind, r.o_datatype, r.tagged))
        return self

    def add_terms(self, triples: list[tuple]) -> Graph:
        """Add (subject, predicate, object) terms from the driver."""
        def parts(t):
            if isinstance(t, IRI):
                return "iri", t.value, None, None
            if isinstance(t, BlankNode):
                return "blank", t.name, None, None
            return "literal", t.lexical, t.datatype, t.lang
        rows = list(dict.fromkeys((*parts(s)[:2], p.value, *parts(o)) for s, p, o in triples))
        return self.add_triples(self.spark.createDataFrame(rows, TRIPLES))

    def load_ntriples(self, path: str) -> Graph:
        """Read N-Triples in parallel, one triple a line; only blank lines and comments aren't triples, anything else is an error.
        The triples are parsed once and stored by predicate, so a pattern reads its own predicate's files."""
        term_ = r'(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)'
        line = rf"^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+{term_}\s*\.\s*(?:#.*)?$"
        rows = self.spark.read.text(path).where(~F.rlike("value", F.lit(r"^\s*(#.*)?$")))
        s, p, o = (F.regexp_extract("value", line, k) for k in (1, 2, 3))
        rows = rows.select(s.alias("rs"), _unescaped(p).alias("p"), o.alias("ro"))
        bad = rows.where("p = ''").limit(1).count()
        if bad:
            raise ValueError(f"{path} has lines that aren't N-Triples")
        kind = lambda c: F.when(F.startswith(c, F.lit("<")), "iri").when(F.startswith(c, F.lit("_:")), "blank").otherwise("literal")
        bare = lambda c: F.when(F.startswith(c, F.lit("<")), _unescaped(F.regexp_replace(c, "^<|>$", ""))).when(F.startswith(c, F.lit("_:")), F.substring(c, 3, 1 << 30))
        rs, ro = F.col("rs"), F.col("ro")
        lexical = F.regexp_extract(ro, r'^"((?:[^"\\]|\\.)*)"', 1)
        plain = _unescaped(lexical)
        lang = F.nullif(F.lower(F.regexp_extract(ro, r'"@([A-Za-z0-9-]+)$', 1)), F.lit(""))
        dt = F.nullif(F.regexp_extract(ro, r'"\^\^<([^>]*)>$', 1), F.lit(""))
        is_literal = kind(ro) == "literal"
        from ..operators.scratch import stored  # the operators know graphs

        return self.add_triples(stored(rows.select(
            kind(rs).alias("s_kind"), bare(rs).alias("s"), "p", kind(ro).alias("o_kind"), F.when(is_literal, plain).otherwise(bare(ro)).alias("o"),
            F.when(is_literal, F.when(lang.isNotNull(), F.lit(LANG_STRING)).otherwise(F.coalesce(dt, F.lit(XSD.string)))).alias("o_datatype"), lang.alias("o_lang")).distinct(), "p"))

    def load_turtle(self, text: str) -> Graph:
        """Parse Turtle text on the driver (for small graphs; N-Triples are read in parallel)."""
        from ..sparql.parser import Parser

        p = Parser(text)
        out: list = []
        while p.kind() != "end":
            while (at := p.text_at(0)) in ("@prefix", "@base") or at.upper() in ("PREFIX", "BASE"):
                p.next()
                if at.upper().endswith("BASE"):
                    p.base = p.next()[1][1:-1]
                else:
                    name = p.next()[1][:-1]
                    p.prefixes[name] = p.next()[1][1:-1]
                if at.startswith("@"):
                    p.expect(".")
            if p.kind() == "end":
                break
            s = p.node(out)
            if p.peek() != ".":
                p.property_list(s, out)
            p.expect(".")
        blank = lambda t: BlankNode(t.name.replace(".", "b")) if type(t).__name__ == "Variable" else t
        return self.add_terms([(blank(t.s), t.p, blank(t.o)) for t in out])

    def predicates(self) -> list[IRI]:
        return list(dict.fromkeys([*[p for t in self.tables for p in t.properties], *map(IRI, self._kinds)]))

    def edges(self, p: IRI) -> list[Edge]:
        out = [Edge(t.df, t.subject, p, t.object(p), t) for t in self.tables if p in t.properties]
        kinds = self._kinds.get(p.value)
        if kinds:
            rows = self.triples.where(F.col("p") == p.value)
            subjects, objects = {k[0] for k in kinds}, {k[1:] for k in kinds}
            if len(subjects) == 1:
                s = (F.col("s"), IRI_TYPE if "iri" in subjects else BLANK_TYPE)
            else:
                s = (_struct("s_kind", "s"), TERM_TYPE)
            if len(objects) == 1:
                (kind, dt, tagged), = objects
                if kind in ("iri", "blank"):
                    o = (F.col("o"), IRI_TYPE if kind == "iri" else BLANK_TYPE)
                elif tagged:
                    o = (F.struct(F.col("o").alias("value"), F.col("o_lang").alias("lang")), LANG_TYPE)
                else:
                    o = (F.col("o").try_cast(NATIVE[dt]) if dt in NATIVE else F.col("o"), literal_type(dt))
            else:
                o = (_struct("o_kind", "o", "o_datatype", "o_lang"), TERM_TYPE)
            out.append(Edge(rows, s, p, o))
        return out


def _unescaped(c: Column) -> Column:
    """Text with the escapes of N-Triples resolved: one cut into escapes and plain runs."""
    def piece(x: Column) -> Column:
        code = lambda: F.decode(F.unhex(F.lpad(F.substring(x, 3, 8), 8, "0")), "UTF-32")
        out = F.when(~F.startswith(x, F.lit("\\")), x).when(F.rlike(x, F.lit(r"^\\u[0-9A-Fa-f]{4}$|^\\U[0-9A-Fa-f]{8}$")), code())
        for letter, char in (("t", "\t"), ("b", "\b"), ("n", "\n"), ("r", "\r"), ("f", "\f")):
            out = out.when(x == F.lit("\\" + letter), F.lit(char))
        return out.otherwise(F.substring(x, 2, 1 << 30))

    cut = F.regexp_extract_all(c, F.lit(r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+"), F.lit(0))
    return F.when(F.contains(c, F.lit("\\")), F.array_join(F.transform(cut, piece), "")).otherwise(c)


def _struct(kind: str, value: str, datatype: str | None = None, lang: str | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.col(kind).alias("kind"), F.col(value).alias("value"), (F.col(datatype) if datatype else none).alias("datatype"), (F.col(lang) if lang else none).alias("lang"))
