"""Built-in functions by name, and functions by IRI: each takes typed arguments and gives a typed column.

SPARQL's errors are nulls here, so everything uses the ``try`` forms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.solution import as_number, iri_text, number, term
from ..terms import BLANK_TYPE, BOOLEAN, DATETIME, DECIMAL, DOUBLE, INTEGER, IRI_TYPE, LANG_STRING, LANG_TYPE, NATIVE, NONE, NUMERIC, STRING, TERM_TYPE, XSD, RdfType, UnsupportedQueryError, literal_type

Typed = tuple[Column, RdfType]


def text(v: Typed) -> Column:
    """The lexical form, as STR gives it."""
    c, t = v
    if t.kind == "iri":
        return iri_text(c, t)
    if t.kind == "lang":
        return c["value"]
    if t.kind == "term":
        return c["value"]
    if t.kind == "literal" and t.datatype == XSD.dateTime:
        return term(c, t)["value"]
    return c.cast("string")


def num(v: Typed) -> Typed:
    c, t = v
    if t.numeric:
        return c, t
    if t.kind == "term":
        return number(c, t), DOUBLE
    return F.lit(None).cast("double"), DOUBLE


def time(v: Typed) -> Column:
    c, t = v
    if t.kind == "literal" and t.datatype in (XSD.dateTime, XSD.date, XSD.dateTimeStamp):
        return c
    return F.when(c["datatype"] == XSD.dateTime, c["value"].try_cast("timestamp")) if t.kind == "term" else F.lit(None).cast("timestamp")


def _rounded(f: Callable[[Column], Column]) -> Callable[..., Typed]:
    def run(v: Typed) -> Typed:
        c, t = num(v)
        if t.datatype in (XSD.double, XSD.float):
            return f(c).cast("double"), DOUBLE
        return (f(c).cast("decimal(38,0)"), DECIMAL) if t.datatype == XSD.decimal else (c, t)
    return run


def _part(f: Callable[[Column], Column]) -> Callable[..., Typed]:
    return lambda v: (f(time(v)).cast("bigint"), INTEGER)


def _seconds(v: Typed) -> Typed:
    c = time(v)
    return F.extract(F.lit("SECOND"), c), DECIMAL


def _like(f: Callable[[Column, Column], Column], out: RdfType = BOOLEAN) -> Callable[..., Typed]:
    return lambda a, b: (f(text(a), text(b)), out)


def _before(s: Column, sep: Column) -> Column:
    at = F.locate_column(sep, s) if hasattr(F, "locate_column") else F.position(sep, s)
    return F.when(at > 0, F.substring(s, F.lit(1), at - 1)).otherwise(F.when(s.isNotNull() & sep.isNotNull(), F.lit("")))


def _after(s: Column, sep: Column) -> Column:
    at = F.position(sep, s)
    return F.when(at > 0, F.substring(s, at + F.length(sep), F.length(s))).otherwise(F.when(s.isNotNull() & sep.isNotNull(), F.lit("")))


def _substr(v: Typed, start: Typed, length: Typed | None = None) -> Typed:
    """The characters at the positions from start on, below start + length; positions count from 1, so a start below 1 shortens the result."""
    s, at = text(v), as_number(*num(start), INTEGER).cast("bigint")
    first, n = F.greatest(at, F.lit(1)), F.length(s).cast("bigint")
    count = n if length is None else F.greatest(F.lit(0), F.least(n, at + as_number(*num(length), INTEGER).cast("bigint") - first))
    # greatest and least skip nulls: an unbound argument is an error.
    known = s.isNotNull() & at.isNotNull() & (F.lit(True) if length is None else num(length)[0].isNotNull())
    return F.when(known, F.substring(s, F.least(first, n + 1).cast("int"), count.cast("int"))), STRING


def _flags(flags: Typed | None) -> Column:
    return F.lit("") if flags is None else F.when(F.length(text(flags)) > 0, F.concat(F.lit("(?"), F.regexp_replace(text(flags), "[^imsx]", ""), F.lit(")"))).otherwise(F.lit(""))


def _regex(v: Typed, pattern: Typed, flags: Typed | None = None) -> Typed:
    return F.rlike(text(v), F.concat(_flags(flags), text(pattern)) if flags is not None else text(pattern)), BOOLEAN


def _replace(v: Typed, pattern: Typed, by: Typed, flags: Typed | None = None) -> Typed:
    return F.regexp_replace(text(v), F.concat(_flags(flags), text(pattern)) if flags is not None else text(pattern), text(by)), STRING


def _kind_test(*kinds: str) -> Callable[..., Typed]:
    def run(v: Typed) -> Typed:
        c, t = v
        if t.kind == "term":
            return c["kind"].isin(*kinds), BOOLEAN
        return F.when(c.isNotNull(), F.lit(t.kind in kinds)), BOOLEAN
    return run


def _is_numeric(v: Typed) -> Typed:
    c, t = v
    return (number(c, t).isNotNull(), BOOLEAN) if t.kind == "term" else (F.when(c.isNotNull(), F.lit(t.numeric)), BOOLEAN)


def _datatype(v: Typed) -> Typed:
    c, t = v
    if t.kind == "term":
        return F.when(c["lang"].isNotNull(), F.lit(LANG_STRING)).otherwise(c["datatype"]), IRI_TYPE
    dt = {"literal": t.datatype, "lang": LANG_STRING}.get(t.kind)
    return F.when(c.isNotNull(), F.lit(dt)), IRI_TYPE


def _lang(v: Typed) -> Typed:
    c, t = v
    if t.kind in ("lang", "term"):
        return F.coalesce(c["lang"], F.when(c["value"].isNotNull(), F.lit(""))), STRING
    return F.when(c.isNotNull(), F.lit("" if t.kind == "literal" else None)), STRING


def _lang_matches(a: Typed, b: Typed) -> Typed:
    tag, wanted = F.lower(text(a)), F.lower(text(b))
    return F.when(wanted == "*", F.length(tag) > 0).otherwise((tag == wanted) | F.startswith(tag, F.concat(wanted, F.lit("-")))), BOOLEAN


def cast(v: Typed, datatype: str) -> Typed:
    """A cast by datatype IRI: null where the value has no such form."""
    c, t = v
    if datatype == XSD.string:
        return text(v), STRING
    if datatype not in NATIVE:
        raise UnsupportedQueryError(f"no cast to {datatype}")
    to = NATIVE[datatype]
    if t.kind == "literal" and t.datatype in NATIVE and t.datatype != XSD.string:
        if datatype in (XSD.dateTime, XSD.dateTimeStamp) and t.template == "ntz":
            return c, t
        if t.datatype in (XSD.dateTime, XSD.date) and NATIVE[datatype].typeName() not in ("timestamp", "date"):
            return F.lit(None).cast(to), literal_type(datatype)
        return c.try_cast(to), literal_type(datatype)
    s = F.trim(text(v))
    if datatype == XSD.boolean:
        return F.when(s.isin("true", "1"), True).when(s.isin("false", "0"), False), BOOLEAN
    if to.typeName() in ("long", "integer", "short", "byte"):
        s = F.when(F.rlike(s, F.lit("^[+-]?[0-9]+$")), s)
    return s.try_cast(to), literal_type(datatype)


def floor_to_seconds(v: Typed, n: Typed) -> Typed:
    """The date time, floored to a multiple of n seconds since 1970."""
    c, t = v
    step = as_number(*num(n), INTEGER)
    if t.template == "ntz":
        micros = F.unix_micros(c.cast("timestamp"))
        return F.timestamp_micros(micros - F.pmod(micros, step * 1_000_000)).cast("timestamp_ntz"), t
    micros = F.unix_micros(time(v))
    return F.timestamp_micros(micros - F.pmod(micros, step * 1_000_000)), DATETIME


def date_bin(interval: Typed, v: Typed, origin: Typed) -> Typed:
    """The date time, floored to a multiple of a duration (PT10M, P1W, or a number of seconds) since an origin.

    Months and years have no fixed length: a duration of them alone gives null.
    """
    c, t = v
    if interval[1].numeric:
        step = (as_number(*interval, DOUBLE) * 1_000_000).cast("bigint")
    else:
        s = text(interval)
        pick = lambda p: F.coalesce(F.nullif(F.regexp_extract(s, p, 1), F.lit("")).try_cast("decimal(18,6)"), F.lit(0))
        step = ((pick("([0-9]+)W") * 604800 + pick("([0-9]+)D") * 86400 + pick("T.*?([0-9]+)H") * 3600 + pick("T.*?([0-9]+)M") * 60 + pick("T.*?([0-9.]+)S")) * 1_000_000).cast("bigint")
    at, start = F.unix_micros(time(v).cast("timestamp")), F.unix_micros(time(origin).cast("timestamp"))
    out = F.timestamp_micros(at - F.pmod(at - start, F.nullif(step, F.lit(0))))
    return (out.cast("timestamp_ntz"), t) if t.template == "ntz" else (out, DATETIME)


def _encode_for_uri(v: Typed) -> Typed:
    """All but letters, digits and -_.~ as percent escapes: the encoding of forms differs in the blank, * and ~."""
    out = F.url_encode(text(v))
    for form, uri in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(form), F.lit(uri))
    return out, STRING


def _str_dt(v: Typed, dt: Typed) -> Typed:
    made = F.struct(F.lit("literal").alias("kind"), text(v).alias("value"), text(dt).alias("datatype"), F.lit(None).cast("string").alias("lang"))
    return F.when(text(v).isNotNull(), made), TERM_TYPE


def _same_term(a: Typed, b: Typed) -> Typed:
    return (a[0] == b[0] if a[1] == b[1] else term(*a) == term(*b)), BOOLEAN


def _abs(v: Typed) -> Typed:
    c, t = num(v)
    return F.abs(c), t


BUILT_INS: dict[str, Callable[..., Typed]] = {
    "STR": lambda v: (text(v), STRING), "LANG": _lang, "LANGMATCHES": _lang_matches, "DATATYPE": _datatype,
    "IRI": lambda v: (text(v), IRI_TYPE), "BNODE": lambda *_: (F.concat(F.lit("b"), F.uuid()), BLANK_TYPE),
    "STRDT": _str_dt, "STRLANG": lambda v, g: (F.struct(text(v).alias("value"), F.lower(text(g)).alias("lang")), LANG_TYPE),
    "ISIRI": _kind_test("iri"), "ISBLANK": _kind_test("blank", "row"), "ISLITERAL": _kind_test("literal", "lang"), "ISNUMERIC": _is_numeric,
    "ABS": _abs, "CEIL": _rounded(F.ceil), "FLOOR": _rounded(F.floor), "ROUND": _rounded(lambda c: F.floor(c + F.lit(0.5).cast("decimal(2,1)"))),
    "RAND": lambda: (F.rand(), DOUBLE), "NOW": lambda: (F.current_timestamp(), DATETIME),
    "STRLEN": lambda v: (F.length(text(v)).cast("bigint"), INTEGER), "SUBSTR": _substr,
    "UCASE": lambda v: (F.upper(text(v)), STRING), "LCASE": lambda v: (F.lower(text(v)), STRING),
    "STRSTARTS": _like(F.startswith), "STRENDS": _like(F.endswith), "CONTAINS": _like(F.contains),
    "STRBEFORE": _like(_before, STRING), "STRAFTER": _like(_after, STRING),
    "ENCODE_FOR_URI": _encode_for_uri,
    "CONCAT": lambda *vs: (F.concat(*map(text, vs)) if vs else F.lit(""), STRING), "REGEX": _regex, "REPLACE": _replace,
    "YEAR": _part(F.year), "MONTH": _part(F.month), "DAY": _part(F.day), "HOURS": _part(F.hour), "MINUTES": _part(F.minute), "SECONDS": _seconds,
    "TIMEZONE": lambda v: (F.when(time(v).isNotNull(), F.lit(None if v[1].template == "ntz" else "PT0S").cast("string")), STRING), "TZ": lambda v: (F.when(time(v).isNotNull(), F.lit("" if v[1].template == "ntz" else "Z")), STRING),
    "MD5": lambda v: (F.md5(text(v)), STRING), "SHA1": lambda v: (F.sha1(text(v)), STRING), "SHA256": lambda v: (F.sha2(text(v), 256), STRING),
    "SHA384": lambda v: (F.sha2(text(v), 384), STRING), "SHA512": lambda v: (F.sha2(text(v), 512), STRING),
    "UUID": lambda: (F.concat(F.lit("urn:uuid:"), F.uuid()), IRI_TYPE), "STRUUID": lambda: (F.uuid(), STRING), "SAMETERM": _same_term,
}


def truth(v: Typed) -> Column:
    """The effective boolean value; null where there is none."""
    c, t = v
    if t == BOOLEAN:
        return c
    if t.numeric:
        return c != 0
    if t.kind == "literal" and t.datatype == XSD.string:
        return F.length(c) > 0
    if t.kind == "term":
        return F.when(c["datatype"] == XSD.boolean, c["value"].isin("true", "1")).when(number(c, t).isNotNull(), number(c, t) != 0).when(
            (c["kind"] == "literal") & (c["datatype"] == XSD.string), F.length(c["value"]) > 0)
    return F.lit(None).cast("boolean")


__all__ = ["BUILT_INS", "NONE", "NUMERIC", "Typed", "cast", "date_bin", "floor_to_seconds", "num", "text", "time", "truth"]
