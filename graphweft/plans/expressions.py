"""Expressions to typed columns. Errors are nulls; comparisons of types that can't be compared are errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import library as L
from ..operators.solution import Binding, Solution, as_number, iri_text, number, promoted, term, unified
from ..sources.graph import constant
from ..sparql import algebra as A
from ..terms import BOOLEAN, DECIMAL, DOUBLE, IRI, IRI_TYPE, NATIVE, NONE, TERM_TYPE, XSD, Literal, RdfType, UnsupportedQueryError

_COMPARE = {"=": lambda a, b: a == b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}
_ARITHMETIC = {"+": "try_add", "-": "try_subtract", "*": "try_multiply", "/": "try_divide"}


class Compiler:
    """Compiles expressions over a solution's variables. ``calls``: functions by IRI. ``marks``: columns computed for EXISTS."""

    def __init__(self, sol: Solution, calls: dict, marks: dict | None = None):
        self.sol, self.calls, self.marks = sol, calls, marks or {}

    def condition(self, e) -> Column:
        return L.truth(self(e))

    def __call__(self, e) -> L.Typed:
        match e:
            case A.Const(t):
                return constant(t)
            case A.Var(name):
                b = self.sol.vars.get(name)
                return (b.c, b.type) if b else (F.lit(None).cast("string"), NONE)
            case A.Call(iri, args):
                if iri in NATIVE:
                    return L.cast(self(args[0]), iri)
                if iri not in self.calls:
                    raise UnsupportedQueryError(f"unknown function <{iri}>")
                return self.calls[iri](*map(self, args))
            case A.Exists():
                return self.marks[id(e)], BOOLEAN
            case A.Op(name, args):
                return self._op(name, args)
        raise UnsupportedQueryError(f"can't evaluate {e}")

    def _op(self, name: str, args: tuple) -> L.Typed:
        if name == "AND":
            return self.condition(args[0]) & self.condition(args[1]), BOOLEAN
        if name == "OR":
            return self.condition(args[0]) | self.condition(args[1]), BOOLEAN
        if name == "NOT":
            return ~self.condition(args[0]), BOOLEAN
        if name in _COMPARE:
            return self.compare(name, args[0], args[1]), BOOLEAN
        if name == "IN":
            tests = [self.compare("=", args[0], a) for a in args[1:]]
            out = F.lit(False)
            for t in tests:
                out = out | t
            return out, BOOLEAN
        if name in _ARITHMETIC:
            return self._arithmetic(name, self(args[0]), self(args[1]))
        if name in ("NEG", "POS"):
            c, t = L.num(self(args[0]))
            return (-c if name == "NEG" else c), t
        if name == "BOUND":
            return self(args[0])[0].isNotNull(), BOOLEAN
        if name == "IF":
            test, (a, b, t) = self.condition(args[0]), self._same(self(args[1]), self(args[2]))
            return F.when(test, a).when(~test, b), t
        if name == "COALESCE":
            out = self(args[0])
            for a in args[1:]:
                x, y, t = self._same(out, self(a))
                out = F.coalesce(x, y), t
            return out
        if name in L.BUILT_INS:
            try:
                return L.BUILT_INS[name](*map(self, args))
            except TypeError as e:
                raise UnsupportedQueryError(f"wrong arguments of {name}: {e}") from None
        raise UnsupportedQueryError(f"unknown function {name}")

    @staticmethod
    def _same(a: L.Typed, b: L.Typed) -> tuple[Column, Column, RdfType]:
        return unified(Binding(*a), Binding(*b))

    def _arithmetic(self, op: str, a: L.Typed, b: L.Typed) -> L.Typed:
        (x, t), (y, u) = L.num(a), L.num(b)
        to = promoted(t, u)
        if op == "/" and to.datatype not in (XSD.double, XSD.float):
            to = DECIMAL
        x, y = as_number(x, t, to), as_number(y, u, to)
        return getattr(F, _ARITHMETIC[op])(x, y), DOUBLE if to.datatype == XSD.float else to

    def compare(self, op: str, left, right) -> Column:
        (a, t), (b, u), f = self(left), self(right), _COMPARE[op]
        if t == NONE or u == NONE:
            return F.lit(None).cast("boolean")
        if t.numeric and u.numeric:
            if t.datatype == u.datatype or {t.datatype, u.datatype} <= {XSD.int, XSD.integer, XSD.long, XSD.short, XSD.byte}:
                return f(a, b)
            if isinstance(right, A.Const) and isinstance(right.term, Literal) and t.datatype == XSD.double:
                b = F.lit(float(right.term.lexical)) if u.numeric else b
            to = promoted(t, u)
            return f(as_number(a, t, to), as_number(b, u, to))
        if t.kind == u.kind == "iri":
            for x, xt, other, swap in ((a, t, right, False), (b, u, left, True)):
                if xt.template is not None and isinstance(other, A.Const) and op == "=":
                    return key_equals(x, xt, other.term)
            return f(a, b) if t == u and t.template is not None else f(iri_text(a, t), iri_text(b, u))
        if t.kind == u.kind == "literal":
            times = (XSD.dateTime, XSD.date, XSD.dateTimeStamp)
            if t.datatype in times and u.datatype in times:
                if (t.template == "ntz") != (u.template == "ntz"):
                    a, b = a if t.template == "ntz" else _zoneless(left, a), b if u.template == "ntz" else _zoneless(right, b)
                return f(a, b)
            if t.datatype == u.datatype:
                return f(a, b)
            return F.lit(None).cast("boolean")
        if t.kind == "lang" and u.kind == "lang":
            return f(a["value"], b["value"]) if op != "=" else (a["value"] == b["value"]) & (a["lang"] == b["lang"])
        if TERM_TYPE in (t, u):
            x, y = term(a, t), term(b, u)
            nx, ny = number(x, TERM_TYPE), number(y, TERM_TYPE)
            same = x == y if op == "=" else F.when((x["kind"] == y["kind"]) & x["datatype"].eqNullSafe(y["datatype"]), f(x["value"], y["value"]))
            return F.when(nx.isNotNull() & ny.isNotNull(), f(nx, ny)).otherwise(same)
        if "row" in (t.kind, u.kind) and t.kind == u.kind:
            return f(a, b)
        return F.when(a.isNotNull() & b.isNotNull(), F.lit(False)) if op == "=" else F.lit(None).cast("boolean")


def _zoneless(e, c: Column) -> Column:
    """A time without its zone, in UTC; constants stay literals, so that the comparison reaches the scan."""
    if isinstance(e, A.Const) and isinstance(e.term, Literal):
        return F.lit(e.term.lexical).try_cast("timestamp").cast("timestamp_ntz") if "+" in e.term.lexical[10:] or "-" in e.term.lexical[10:] else F.lit(e.term.lexical.rstrip("Z")).try_cast("timestamp_ntz")
    return c.cast("timestamp_ntz")


def key_equals(key: Column, t: RdfType, to: IRI) -> Column:
    """Whether a templated IRI is a constant one: a test of its key, which can be pushed to the scan."""
    if not isinstance(to, IRI) or not to.value.startswith(t.template):
        return F.lit(False)
    rest = to.value[len(t.template):]
    if t.datatype == "int":
        return key == F.lit(int(rest)) if rest.lstrip("-").isdigit() and str(int(rest)) == rest else F.lit(False)
    return key == F.lit(rest)


__all__ = ["IRI_TYPE", "Compiler", "key_equals"]
