"""Solution frames: a DataFrame, and for every variable its column, static type and whether it can be unbound."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..terms import BLANK_TYPE, DOUBLE, INTEGER, IRI_TYPE, NATIVE, NONE, NUMERIC, TERM_TYPE, XSD, RdfType, literal_type

_names = itertools.count()


def new_name() -> str:
    return f"v{next(_names)}"


@dataclass(frozen=True)
class Binding:
    c: Column
    type: RdfType
    nullable: bool = False


@dataclass
class Solution:
    """``order``: (column, ascending) of an ORDER BY whose sort hasn't been applied, or has if ``sorted``."""

    df: DataFrame
    vars: dict[str, Binding]
    order: list[tuple[Column, bool]] = field(default_factory=list)
    sorted: bool = False

    def keep(self, columns: dict[str, Binding]) -> Solution:
        """These variables, each materialised under a new column name, and the pending order's columns."""
        selected, bound, order = [], {}, []
        for name, b in columns.items():
            n = new_name()
            selected.append(b.c.alias(n))
            bound[name] = Binding(F.col(n), b.type, b.nullable)
        for c, asc in self.order:
            n = new_name()
            selected.append(c.alias(n))
            order.append((F.col(n), asc))
        if not selected:
            selected = [F.lit(1).alias(new_name())]
        return Solution(self.df.select(*selected), bound, order, self.sorted)


def iri_text(c: Column, t: RdfType) -> Column:
    """The IRI as a string, also where the column has only its key."""
    return F.concat(F.lit(t.template), c.cast("string")) if t.template is not None else c


def term(c: Column, t: RdfType) -> Column:
    """Any value as a struct of kind, value, datatype, lang; null stays null."""
    if t.kind == "term":
        return c
    text, dt, lang = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    if t.kind == "iri":
        text = iri_text(c, t)
    elif t.kind == "lang":
        text, lang = c["value"], c["lang"]
    elif t.kind in ("row", "nested"):
        text = F.to_json(F.struct(c.alias("value")))
    elif t.kind == "literal" and t.datatype == XSD.dateTime:
        text, dt = F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("" if t.template == "ntz" else "Z")), F.lit(t.datatype)
    elif t.kind != "none":
        text, dt = c.cast("string"), F.lit(t.datatype).cast("string")
    made = F.struct(F.lit(t.kind).alias("kind"), text.alias("value"), dt.alias("datatype"), lang.alias("lang"))
    return F.when(text.isNotNull(), made)


def number(c: Column, t: RdfType) -> Column:
    """A numeric value of a struct term as a double, else null; numeric columns stay."""
    if t.kind == "term":
        numeric = c["datatype"].isin(*NUMERIC, *[d for d, k in NATIVE.items() if k.typeName() == "long"])
        return F.when(numeric, c["value"].try_cast("double"))
    return c


def promoted(a: RdfType, b: RdfType) -> RdfType:
    """The type of arithmetic on two numeric types."""
    rank = max(NUMERIC.index(x.datatype) if x.datatype in NUMERIC else NUMERIC.index(XSD.integer) for x in (a, b))
    if NUMERIC[rank] in (XSD.float, XSD.double):
        return literal_type(NUMERIC[rank])
    return literal_type(XSD.decimal) if NUMERIC[rank] == XSD.decimal else INTEGER


def as_number(c: Column, t: RdfType, to: RdfType) -> Column:
    if to.datatype in (XSD.double, XSD.float):
        return c.cast("double")
    if to.datatype == XSD.decimal:
        return c if t.datatype == XSD.decimal else c.cast("decimal(20,0)")
    return c.cast("bigint")


def unified(a: Binding, b: Binding) -> tuple[Column, Column, RdfType]:
    """Both columns in one type, for joins, unions and equality of terms."""
    x, y = a.type, b.type
    if x == y:
        return a.c, b.c, x
    if x.kind == "none":
        return F.lit(None), b.c, y
    if y.kind == "none":
        return a.c, F.lit(None), x
    if x.kind == y.kind == "iri":
        return iri_text(a.c, x), iri_text(b.c, y), IRI_TYPE
    if x.numeric and y.numeric:
        t = promoted(x, y)
        return as_number(a.c, x, t), as_number(b.c, y, t), DOUBLE if t.datatype == XSD.float else t
    if x.kind == y.kind == "literal" and x.datatype == y.datatype:  # date times with and without a zone
        return a.c.cast("timestamp_ntz"), b.c.cast("timestamp_ntz"), literal_type(x.datatype) if x.datatype != XSD.dateTime else RdfType("literal", XSD.dateTime, "ntz")
    return term(a.c, x), term(b.c, y), TERM_TYPE


def null_of(t: RdfType) -> Column:
    """A typed null, so that unions and writers get a definite column type."""
    if t.kind == "literal":
        return F.lit(None).cast("timestamp_ntz" if t.template == "ntz" else NATIVE[t.datatype]) if t.datatype in NATIVE else F.lit(None).cast("string")
    return F.lit(None).cast("string") if t in (NONE, IRI_TYPE, BLANK_TYPE) else F.lit(None)
