"""The planner: one DataFrame for a whole query.

Triples with predicates of a template are virtual: they are read from resources, joined to the graph on the series' external
id and resource name. All other triples are scans of the graph: patterns on one subject of one mapped table share a scan, and
keys of mapped IRIs are joined as they are, without building IRI strings. What to push, prune, reorder and broadcast is left to
Catalyst; the planner adds the rewrites it can't do (shared scans, ids handed to remote stores, anti and semi joins for MINUS
and EXISTS, residual conditions in OPTIONAL).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import library as L
from ..operators import paths, relational as R
from ..operators.solution import Binding, Solution, as_number, iri_text, new_name, null_of, number, term, unified
from ..sources.graph import Graph, TableMap, column_type, constant
from ..sources.resource import ID, Resource, Vocabulary
from ..sparql import algebra as A
from ..terms import BLANK_TYPE, BOOLEAN, DECIMAL, DOUBLE, INTEGER, IRI, IRI_TYPE, NESTED_TYPE, ROW_TYPE, STRING, TERM_TYPE, XSD, BlankNode, Literal, UnsupportedQueryError, Variable
from .expressions import Compiler, key_equals

_WHOLE = (XSD.byte, XSD.short, XSD.int, XSD.long, XSD.integer)


class Planner:
    def __init__(self, spark: SparkSession, graph: Graph, resources: dict[str, Resource], vocabulary: Vocabulary, calls: dict, aggregates: dict[str, Callable],
                 services: dict[str, Graph] | None = None):
        self.spark, self.graph, self.resources, self.vocabulary, self.calls, self.aggregates = spark, graph, resources, vocabulary, calls, aggregates
        self.services = graph.services if services is None else services
        self.virtual = frozenset().union(*[r.template.predicates for r in resources.values()]) if resources else frozenset()
        self.notes: list[str] = []
        self._fresh = 0

    # Patterns.
    def plan(self, p) -> Solution:
        match p:
            case A.BGP(triples):
                return self.bgp(list(triples))
            case A.Join(a, b):
                return self.joined(self.plan(a), self.plan(b))
            case A.LeftJoin(a, b, condition):
                left, right = self.plan(a), self.plan(b)
                if condition is None:
                    return R.left_join(left, right)
                if any(True for _ in _exists(condition)):
                    raise UnsupportedQueryError("EXISTS in the condition of an OPTIONAL isn't supported")
                scope = R.condition_scope(left, right)
                return R.left_join(left, right, Compiler(scope, self.calls).condition(condition))
            case A.Filter(condition, inner):
                return self.filter(self.plan(inner), condition)
            case A.Union(a, b):
                return R.union(self.plan(a), self.plan(b))
            case A.Graph(name, inner):
                return self.named_graph(name, inner)
            case A.Service(name, inner, silent):
                return self.service(name, inner, silent)
            case A.Extend(inner, var, e):
                sol = self.plan(inner)
                sol, marks = self.marked(sol, e)
                c, t = Compiler(sol, self.calls, marks)(e)
                plain = isinstance(e, (A.Const,)) or (isinstance(e, A.Var) and e.name in sol.vars and not sol.vars[e.name].nullable)
                return sol.keep(sol.vars | {var: Binding(c if t.kind != "none" else null_of(t), t, not plain)})
            case A.Minus(a, b):
                return R.minus(self.plan(a), self.plan(b))
            case A.Values(names, rows):
                return self.values(names, rows)
            case A.OrderBy(inner, keys):
                sol = self.plan(inner)
                order = []
                for e, asc in keys:
                    sol, marks = self.marked(sol, e)
                    c, t = Compiler(sol, self.calls, marks)(e)
                    order += [(x, asc) for x in _sort_columns(c, t)]
                return Solution(sol.df, sol.vars, order).keep(sol.vars)
            case A.Project(inner, names):
                sol = self.plan(inner)
                return sol.keep({n: sol.vars.get(n) or Binding(F.lit(None).cast("string"), _none(), True) for n in names})
            case A.Distinct(inner) | A.Reduced(inner):
                return R.distinct(self.plan(inner))
            case A.Slice(inner, offset, limit):
                return R.slice_(self.plan(inner), offset, limit)
            case A.Group(inner, keys, aggregates):
                return self.group(self.plan(inner), keys, aggregates)
        raise UnsupportedQueryError(f"can't plan {type(p).__name__}")

    def unit(self) -> Solution:
        """The solution without variables."""
        return Solution(self.spark.range(1).select(F.lit(1).alias(new_name())), {})

    def joined(self, a: Solution, b: Solution) -> Solution:
        return R.join(a, b)

    def nothing(self, names: list[str]) -> Solution:
        return Solution(self.spark.range(1).where(F.lit(False)), {n: Binding(F.lit(None).cast("string"), _none(), True) for n in names}).keep(
            {n: Binding(F.lit(None).cast("string"), _none(), True) for n in names})

    def values(self, names: tuple[str, ...], rows: tuple[tuple, ...]) -> Solution:
        if not rows:
            return self.nothing(list(names))
        out = None
        for row in rows:  # a row is a projection of one row; Catalyst folds the union into one local relation
            columns = {n: Binding(*constant(t)) if t is not None else Binding(F.lit(None).cast("string"), _none(), True) for n, t in zip(names, row, strict=True)}
            one = Solution(self.spark.range(1), columns).keep(columns)
            out = one if out is None else R.union(out, one)
        return out

    def service(self, name, inner, silent: bool) -> Solution:
        """A static pattern over a graph that the engine knows by the service's IRI. SILENT: an unknown service gives one empty solution."""
        graph = self.services.get(name.value) if isinstance(name, IRI) else None
        if graph is None:
            if silent:
                return self.unit()
            raise UnsupportedQueryError(f"unknown service {name}")
        return Planner(self.spark, graph, {}, self.vocabulary, self.calls, self.aggregates, self.services).plan(inner)

    def named_graph(self, name, inner) -> Solution:
        def under(graph: Graph) -> Solution:
            return Planner(self.spark, graph, self.resources, self.vocabulary, self.calls, self.aggregates, self.services).plan(inner)
        if isinstance(name, IRI):
            return under(self.graph.named.get(name.value, Graph(self.spark)))
        out = None
        for iri, graph in self.graph.named.items():
            sol = under(graph)
            tag = self.unit().keep({name.name: Binding(F.lit(iri), IRI_TYPE)})
            sol = self.joined(sol, tag)
            out = sol if out is None else R.union(out, sol)
        return out or self.nothing([name.name, *A.in_scope(inner)])

    # Filters.
    def filter(self, sol: Solution, condition) -> Solution:
        plain = []
        for e in _conjuncts(condition):
            negated = isinstance(e, A.Op) and e.name == "NOT" and isinstance(e.args[0], A.Exists)
            if isinstance(e, A.Exists) or negated:
                sol = self.exists(sol, (e.args[0] if negated else e).pattern, negated)
            else:
                plain.append(e)
        for e in plain:
            sol, marks = self.marked(sol, e)
            sol = Solution(sol.df.where(Compiler(sol, self.calls, marks).condition(e)), sol.vars, sol.order, sol.sorted)
        return sol

    def exists(self, sol: Solution, pattern, negated: bool) -> Solution:
        inner, extra = self._correlated(sol, pattern)
        return R.semi_join(sol, inner, negated, extra)

    def _correlated(self, sol: Solution, pattern) -> tuple[Solution, Column | None]:
        """The pattern by itself, and the part of its outermost filter that needs variables from outside."""
        late = []
        while isinstance(pattern, A.Filter):
            own = set(A.in_scope(pattern.inner))
            conjuncts = _conjuncts(pattern.condition)
            outer = [e for e in conjuncts if (A.expression_vars(e) - own) & sol.vars.keys() and not any(True for _ in _exists(e))]
            if not outer:
                break
            late += outer
            rest = [e for e in conjuncts if e not in outer]
            pattern = A.Filter(reduce(lambda a, b: A.Op("AND", (a, b)), rest), pattern.inner) if rest else pattern.inner
            if rest:
                break
        inner = self.plan(pattern)
        if not late:
            return inner, None
        scope = R.condition_scope(sol, inner)
        return inner, reduce(lambda a, b: a & b, [Compiler(scope, self.calls).condition(e) for e in late])

    def marked(self, sol: Solution, e) -> tuple[Solution, dict]:
        """EXISTS inside an expression: a left join with the distinct keys of its pattern, whose mark says whether one matched."""
        marks = {}
        for x in _exists(e):
            inner, extra = self._correlated(sol, x.pattern)
            if extra is not None:
                raise UnsupportedQueryError("a correlated filter in an EXISTS inside an expression isn't supported")
            keys = {n: b for n, b in inner.vars.items() if n in sol.vars}
            if any(b.nullable for n, b in keys.items()) or any(sol.vars[n].nullable for n in keys):
                raise UnsupportedQueryError("EXISTS inside an expression needs variables that are always bound")
            inner = R.distinct(inner.keep(keys))
            if not keys:
                inner = R.slice_(inner, 0, 1)
            name = f".mark{id(x)}"
            inner = inner.keep(inner.vars | {name: Binding(F.lit(True), BOOLEAN)})
            sol = R.left_join(sol, inner)
            mark = sol.vars[name].c
            sol = Solution(sol.df, {n: b for n, b in sol.vars.items() if n != name}, sol.order)
            marks[id(x)] = mark.isNotNull()
        return sol, marks

    # Groups.
    def group(self, sol: Solution, keys: tuple[str, ...], aggregates) -> Solution:
        grouped = {k: sol.vars.get(k) or Binding(F.lit(None).cast("string"), _none(), True) for k in keys}
        args, order, columns, compiled = [], sol.order, {}, {}
        for k, b in grouped.items():
            columns[k] = new_name()
            args.append(b.c.alias(columns[k]))
        for name, agg in aggregates:
            if agg.arg is not None:
                sol, marks = self.marked(sol, agg.arg)
                c, t = Compiler(sol, self.calls, marks)(agg.arg)
                n = new_name()
                args.append(c.alias(n))
                compiled[name] = (n, t)
        if any(a.arg is None and a.distinct for _, a in aggregates):
            whole = new_name()
            args.append(F.struct(*[b.c for n, b in sol.vars.items() if not n.startswith(".")]).alias(whole))
        order_names = []
        for c, asc in order:
            n = new_name()
            args.append(c.alias(n))
            order_names.append((n, asc))
        df = sol.df.select(*args) if args else sol.df
        out, made = {k: Binding(F.col(columns[k]), grouped[k].type, grouped[k].nullable) for k in keys}, []
        for name, agg in aggregates:
            if agg.arg is None:
                c, t = (F.count_distinct(F.col(whole)) if agg.distinct else F.count(F.lit(1))), INTEGER
            else:
                c, t = self.aggregate(agg, *compiled[name], order_names)
            n = new_name()
            made.append(c.alias(n))
            out[name] = Binding(F.col(n), t, agg.name not in ("COUNT", "GROUP_CONCAT"))
        by = [columns[k] for k in keys]
        df = df.groupBy(*by).agg(*made) if made else df.select(*by).distinct()
        return Solution(df, out)

    def aggregate(self, agg: A.Aggregate, name: str, t, order: list[tuple[str, bool]]) -> tuple[Column, object]:
        c = F.col(name)
        if agg.name in self.aggregates:
            made = self.aggregates[agg.name](c)
            return made if isinstance(made, tuple) else (made, NESTED_TYPE)
        if agg.name == "COUNT":
            return (F.count_distinct(c) if agg.distinct else F.count(c)), INTEGER
        if agg.name in ("SUM", "AVG"):
            x = number(c, t)
            kind = DOUBLE if t.kind == "term" or t.datatype in (XSD.double, XSD.float) else DECIMAL if t.datatype == XSD.decimal else INTEGER
            x = as_number(x, t if t.numeric else DOUBLE, kind) if t.numeric or t.kind == "term" else F.lit(None).cast("double")
            if agg.name == "AVG":
                # Whole numbers average as doubles.
                return (F.avg(F.when(x.isNotNull(), x)) if not agg.distinct else F.expr(f"avg(DISTINCT {_sql(name, t)})")), DECIMAL if kind == DECIMAL else DOUBLE
            total = F.sum_distinct(x) if agg.distinct else F.try_sum(x)
            return F.coalesce(total, F.lit(0).cast("bigint" if kind == INTEGER else "double" if kind == DOUBLE else "decimal(38,18)")), kind
        if agg.name in ("MIN", "MAX", "SAMPLE"):
            if t.kind == "iri":
                c, t = iri_text(c, t), IRI_TYPE
            return {"MIN": F.min, "MAX": F.max, "SAMPLE": F.min}[agg.name](c), t
        if agg.name == "GROUP_CONCAT":
            text = L.text((c, t))
            if agg.distinct:
                return F.array_join(F.array_sort(F.collect_set(text)), agg.separator), STRING
            if not order:
                return F.array_join(F.array_sort(F.collect_list(text)), agg.separator), STRING
            by = F.struct(*[F.col(n).alias(f"k{i}") for i, (n, _) in enumerate(order)])
            rows = F.collect_list(F.when(text.isNotNull(), F.struct(by.alias("k"), text.alias("x"))))
            if all(asc for _, asc in order):
                rows = F.array_sort(rows)
            elif not any(asc for _, asc in order):
                rows = F.reverse(F.array_sort(rows))
            else:
                directions = [asc for _, asc in order]
                rows = F.array_sort(rows, lambda x, y: _mixed(x, y, directions))
            return F.array_join(F.transform(rows, lambda r: r["x"]), agg.separator), STRING
        if agg.name == "NEST":
            return F.array_sort(F.collect_list(c)), NESTED_TYPE
        raise UnsupportedQueryError(f"unknown aggregate {agg.name}")

    # Basic graph patterns.
    def bgp(self, triples: list[A.Triple]) -> Solution:
        virtual = [t for t in triples if isinstance(t.p, IRI) and t.p in self.virtual]
        static = [t for t in triples if t not in virtual]
        groups, anchors = self.virtual_groups(virtual)
        for x, (ext, res) in anchors.items():
            static += [A.Triple(x, IRI(self.vocabulary.has_external_id), Variable(ext)), A.Triple(x, IRI(self.vocabulary.has_resource), Variable(res))]
        sol = self.static(static) if static else None
        known = self._templates(static)
        for group in groups:
            group["resources"] = self._named_resources(group, known)
            ids = self._pushable_ids(sol, group)
            scanned = self.virtual_scan(group, ids)
            sol = scanned if sol is None else self.joined(sol, scanned)
        return sol or self.unit()

    def virtual_groups(self, virtual: list[A.Triple]):
        """Rows to read: for each series and each of its data points one, with all triples on that row."""
        first = {t.p for r in self.resources.values() for t in r.template.triples if t.s == ID}
        parameters = {t.p for r in self.resources.values() for t in r.template.triples if t.s == ID and t.o in [p.variable for p in r.template.parameters]}
        groups: dict[tuple, dict] = {}
        anchors: dict[object, tuple[str, str]] = {}
        inner = [t for t in virtual if t.p not in first]
        for t in (t for t in virtual if t.p in first):
            if t.s not in anchors:
                self._fresh += 1
                anchors[t.s] = (f".id{self._fresh}", f".resource{self._fresh}")
            key = (t.s, None if t.p in parameters else t.o)
            groups.setdefault(key, {"ids": anchors[t.s], "triples": []})["triples"].append(t)
        for t in inner:
            owner = next((g for (_, o), g in groups.items() if o == t.s), None)
            if owner is None:
                owner = groups.setdefault(("row", t.s), {"ids": None, "triples": []})
            owner["triples"].append(t)
        return list(groups.values()), anchors

    def _named_resources(self, group: dict, known: dict[str, str]) -> set[str] | None:
        """The resources a group's series can name, where its mapped table says so by a constant."""
        x = next((t.s for t in group["triples"] if group["ids"] is not None), None)
        if not isinstance(x, Variable) or x.name not in known:
            return None
        names = [t.properties.get(IRI(self.vocabulary.has_resource)) for t in self.graph.tables if t.template == known[x.name]]
        names = [p for p in names if p is not None]
        return {p.constant.lexical for p in names} if names and all(p.constant is not None for p in names) else None

    def _pushable_ids(self, sol: Solution | None, group: dict) -> list | None:
        remote = [r for r in self.resources.values() if r.push_ids]
        if sol is None or not remote or group["ids"] is None:
            return None
        most = max(r.push_ids for r in remote)
        b = sol.vars[group["ids"][0]]
        found = sol.df.select(b.c.cast("string").alias("i")).distinct().limit(most + 1).collect()  # at most push_ids + 1 rows
        return [r.i for r in found] if len(found) <= most else None

    def virtual_scan(self, group: dict, ids: list | None = None) -> Solution:
        out = None
        for r in self.resources.values():
            if group.get("resources") is not None and r.name not in group["resources"]:
                continue
            sol = self._scan_resource(r, group, ids if r.push_ids else None)
            if sol is not None:
                out = sol if out is None else R.union(out, sol)
        names = [x.name for t in group["triples"] for x in (t.s, t.o) if isinstance(x, Variable)]
        return out or self.nothing([*names, *(group["ids"] or ())])

    def _scan_resource(self, r: Resource, group: dict, ids: list | None) -> Solution | None:
        """The rows of one resource, if its template has all triples of the group."""
        place: dict[object, Variable] = {}  # query term -> template variable
        columns = set(r.template.columns)
        filters: list[tuple[str, object]] = []
        bound: dict[str, list[Column]] = {}
        df = r.df(ids)
        # The row's identity, the same in every scan; a text, so that resources of other columns can be united with it.
        row = F.to_json(F.struct(F.lit(r.name).alias("resource"), *[F.col(c) for c in dict.fromkeys(["id", *r.template.columns])]))
        pending, progress = list(group["triples"]), True
        while pending and progress:
            progress = False
            for t in list(pending):
                if t.s in place:
                    options = [x for x in r.template.triples if x.s == place[t.s] and x.p == t.p]
                else:
                    options = [x for x in r.template.triples if x.p == t.p and (x.s == ID) == (group["ids"] is not None and not any(y.o == t.s for y in group["triples"]))]
                    if group["ids"] is not None and any(y.o == t.s for y in group["triples"]):
                        continue
                if not options:
                    return None
                x = options[0]
                place.setdefault(t.s, x.s)
                if isinstance(x.o, Variable) and x.o.name in columns:
                    if isinstance(t.o, Variable):
                        bound.setdefault(t.o.name, []).append(F.col(x.o.name))
                    else:
                        filters.append((x.o.name, t.o))
                elif isinstance(x.o, Variable):
                    place.setdefault(t.o, x.o)
                elif t.o != x.o and not isinstance(t.o, Variable):
                    return None
                pending.remove(t)
                progress = True
        if pending:
            return None
        base = Solution(df, {c: Binding(F.col(c), column_type(df.schema[c].dataType)) for c in df.columns})
        for column, value in filters:
            df = df.where(Compiler(base, self.calls).condition(A.Op("=", (A.Var(column), A.Const(value)))))
        out: dict[str, Binding] = {}
        for name, cs in bound.items():
            for c in cs[1:]:
                df = df.where(cs[0] == c)
            df = df.where(cs[0].isNotNull())
            out[name] = Binding(cs[0], column_type(df.select(cs[0]).schema[0].dataType))
        for query_term, var in place.items():
            if isinstance(query_term, Variable) and var != ID and query_term.name not in out:
                out[query_term.name] = Binding(row, ROW_TYPE)
        if group["ids"] is not None:
            ext, res = group["ids"]
            out[ext] = Binding(F.col("id"), column_type(df.schema["id"].dataType))
            out[res] = Binding(F.lit(r.name), STRING)
        self.notes.append(f"resource {r.name}: columns {', '.join(sorted({c for c in columns}))}" + (f", {len(ids)} ids handed over" if ids is not None else ""))
        return Solution(df, out).keep(out)

    def static(self, triples: list[A.Triple]) -> Solution:
        """Scans joined along shared variables, the most constrained first."""
        units: list[tuple[int, Solution]] = []
        known = self._templates(triples)
        stars: dict[tuple, list[tuple[TableMap, A.Triple]]] = {}
        for t in triples:
            table = self._only_table(t, known)
            if table is not None:
                stars.setdefault((t.s, id(table)), []).append((table, t))
            else:
                units.append((sum(not isinstance(x, Variable) for x in (t.s, t.o)), self.triple(t)))
        self._fold(stars)
        for (s, _), ts in stars.items():
            units.append((sum(not isinstance(x, Variable) for _, t in ts for x in (t.s, t.o) if t.p.value != _TYPE), self.star(s, ts)))
        units.sort(key=lambda u: -u[0])
        sol = units.pop(0)[1]
        while units:
            k = next((i for i, (_, u) in enumerate(units) if u.vars.keys() & sol.vars.keys()), 0)
            sol = self.joined(sol, units.pop(k)[1])
        return sol

    def _templates(self, triples: list[A.Triple]) -> dict[str, str]:
        """The IRI template of variables that some pattern ties to one mapped table."""
        known: dict[str, str] = {}
        for _ in range(len(triples)):
            before = len(known)
            for t in triples:
                table = self._only_table(t, known)
                if table is None:
                    continue
                if isinstance(t.s, Variable):
                    known.setdefault(t.s.name, table.template)
                template = table.properties[t.p].template
                if isinstance(t.o, Variable) and template is not None:
                    known.setdefault(t.o.name, template)
            if len(known) == before:
                break
        return known

    def _only_table(self, t: A.Triple, known: dict[str, str]) -> TableMap | None:
        """The one mapped table that a pattern's rows come from, if it is just one."""
        if not isinstance(t.p, IRI):
            return None
        edges = self.graph.edges(t.p)
        if t.p.value == _TYPE and isinstance(t.o, IRI):
            edges = [e for e in edges if e.table is None or e.table.properties[e.p].constant == t.o]
        if isinstance(t.s, IRI):
            edges = [e for e in edges if e.table is None or t.s.value.startswith(e.table.template)]
        elif isinstance(t.s, Variable) and t.s.name in known:
            edges = [e for e in edges if e.table is not None and e.table.template == known[t.s.name] or e.table is None]
        return edges[0].table if len(edges) == 1 else None

    def _fold(self, stars: dict[tuple, list[tuple[TableMap, A.Triple]]]) -> None:
        """Nodes keyed by a column of the row that refers to them, over the same table, are read in the same scan: no self-join."""
        for key in list(stars):
            if key not in stars or not isinstance(key[0], Variable):
                continue
            table = stars[key][0][0]
            for other, ts in stars.items():
                refers = other != key and any(
                    t.o == key[0] and o.df is table.df and o.properties[t.p].template == table.template and o.properties[t.p].column == table.key for o, t in ts)
                if refers:
                    ts += stars.pop(key)
                    break

    def star(self, s, triples: list[tuple[TableMap, A.Triple]]) -> Solution:
        table = triples[0][0]
        df, (key, kt) = table.df, table.subject
        df = df.where(key.isNotNull())
        out: dict[str, Binding] = {}
        if isinstance(s, Variable):
            out[s.name] = Binding(key, kt)
        else:
            df = df.where(key_equals(key, kt, s))
        for owner, t in triples:
            c, ct = owner.object(t.p)
            df = self._object(df, out, t.o, c, ct, owner.properties[t.p].constant)
        return Solution(df, out).keep(out)

    def _object(self, df: DataFrame, out: dict[str, Binding], o, c: Column, ct, const=None) -> DataFrame:
        if not isinstance(o, Variable):
            if const is not None:
                return df if const == o else df.where(F.lit(False))
            if isinstance(o, Literal) and o.datatype in XSD_ALL and ct.kind in ("literal", "term", "lang"):
                test = Compiler(Solution(df, {"x": Binding(c, ct)}), self.calls).condition(A.Op("=", (A.Var("x"), A.Const(o))))
                return df.where(test)
            if isinstance(o, IRI) and ct.template is not None and ct.kind == "iri":
                return df.where(key_equals(c, ct, o))
            x, y, _ = unified(Binding(c, ct), Binding(*constant(o)))
            return df.where(x == y)
        if const is None:
            df = df.where(c.isNotNull())
        if o.name in out:
            x, y, _ = unified(out[o.name], Binding(c, ct))
            return df.where(x == y)
        out[o.name] = Binding(c, ct)
        return df

    def triple(self, t: A.Triple) -> Solution:
        """One pattern by itself: a union over the sources of its predicate, of all predicates, or a path."""
        names = [x.name for x in (t.s, t.p, t.o) if isinstance(x, Variable)]
        if isinstance(t.p, A.PathOp):
            return self.path(t)
        out = None
        for p in [t.p] if isinstance(t.p, IRI) else self.graph.predicates():
            for e in self.graph.edges(p):
                bound: dict[str, Binding] = {}
                df = self._object(e.df, bound, t.s, *e.s)
                if isinstance(t.p, Variable):
                    bound[t.p.name] = Binding(F.lit(p.value), IRI_TYPE) if t.p.name not in bound else bound[t.p.name]
                const = e.table.properties[e.p].constant if e.table else None
                df = self._object(df, bound, t.o, *e.o, const)
                sol = Solution(df, bound).keep(bound)
                out = sol if out is None else R.union(out, sol)
        return out or self.nothing(names)

    def path(self, t: A.Triple) -> Solution:
        def key(x):
            if isinstance(x, IRI):
                return x.value
            if isinstance(x, (Literal, BlankNode)):
                raise UnsupportedQueryError("a path can't end in a constant literal or blank node")
            return None
        df = paths.pairs(self.graph, t.p, key(t.s), key(t.o), self.virtual)
        bound: dict[str, Binding] = {}
        for x, c in ((t.s, F.col("s")), (t.o, F.col("o"))):
            if not isinstance(x, Variable):
                df = df.where(c == x.value)
            elif x.name in bound:
                df = df.where(F.col("s") == F.col("o"))
            else:
                bound[x.name] = self._node(c, paths.end_types(self.graph, t.p)[x is t.o])
        return Solution(df, bound).keep(bound)

    @staticmethod
    def _node(c: Column, types: set) -> Binding:
        """An end of a path: IRI text, or the JSON of another term. Ends of one type get its column."""
        if all(t.kind == "iri" for t in types):
            return Binding(c, IRI_TYPE)
        parsed = F.from_json(c, "struct<kind:string,value:string,datatype:string,lang:string>")
        if len(types) == 1 and next(iter(types)) == STRING:
            return Binding(parsed["value"], STRING)
        none = F.lit(None).cast("string")
        plain = F.struct(F.lit("iri").alias("kind"), c.alias("value"), none.alias("datatype"), none.alias("lang"))
        return Binding(F.when(F.startswith(c, F.lit("{")), parsed).otherwise(plain), TERM_TYPE)

    # Results.
    def result(self, sol: Solution, names: tuple[str, ...], native: bool) -> DataFrame:
        sol = R.sort(sol)
        out = []
        for n in names:
            b = sol.vars[n]
            c, t = b.c, b.type
            if t.kind == "iri":
                c = iri_text(c, t)
                c = c if native else F.concat(F.lit("<"), c, F.lit(">"))
            elif t.kind == "blank":
                c = c if native else F.concat(F.lit("_:"), c)
            elif t.kind == "row":
                c = F.concat(F.lit("_:"), F.sha1(F.to_json(c)))
            elif t.kind == "lang" and not native:
                c = F.concat(F.lit('"'), c["value"], F.lit('"@'), c["lang"])
            elif t.kind == "term" and not native:
                tail = F.when(c["lang"].isNotNull(), F.concat(F.lit("@"), c["lang"])).when(c["datatype"] == XSD.string, F.lit("")).otherwise(F.concat(F.lit("^^<"), c["datatype"], F.lit(">")))
                c = F.when(c["kind"] == "iri", F.concat(F.lit("<"), c["value"], F.lit(">"))).when(c["kind"] == "blank", F.concat(F.lit("_:"), c["value"])).otherwise(
                    F.concat(F.lit('"'), c["value"], F.lit('"'), tail))
            out.append(c.alias(n))
        return sol.df.select(*out)


_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD_ALL = {XSD.string, XSD.boolean, XSD.integer, XSD.long, XSD.int, XSD.short, XSD.byte, XSD.decimal, XSD.double, XSD.float, XSD.date, XSD.dateTime}


def _none():
    from ..terms import NONE
    return NONE


def _sql(name: str, t) -> str:
    return f"CAST(`{name}` AS DOUBLE)" if t.kind == "literal" and t.datatype in _WHOLE else f"`{name}`"


def _sort_columns(c: Column, t) -> list[Column]:
    if t.kind == "iri":
        return [iri_text(c, t)]
    if t.kind == "lang":
        return [c["value"], c["lang"]]
    if t.kind == "term":
        rank = F.when(c["kind"] == "blank", 1).when(c["kind"] == "iri", 2).when(c["kind"].isNotNull(), 3)
        return [rank, number(c, t), c["value"]]
    return [F.to_json(c)] if t.kind in ("row", "nested") else [c]


def _mixed(x: Column, y: Column, directions: list[bool]) -> Column:
    """-1, 0 or 1: rows of collected order keys compared, each key in its direction; nulls are lowest, null rows come last."""
    def one(a: Column, b: Column, asc: bool) -> Column:
        low, high = (-1, 1) if asc else (1, -1)
        return F.when(a.isNull() & b.isNull(), 0).when(a.isNull(), low).when(b.isNull(), high).when(a < b, low).when(a > b, high).otherwise(0)

    out = one(x["x"], y["x"], True)
    for i, asc in reversed(list(enumerate(directions))):
        c = one(x["k"][f"k{i}"], y["k"][f"k{i}"], asc)
        out = F.when(c != 0, c).otherwise(out)
    return F.when(x.isNull() & y.isNull(), 0).when(x.isNull(), 1).when(y.isNull(), -1).otherwise(out)


def _conjuncts(e) -> list:
    if isinstance(e, A.Op) and e.name == "AND":
        return _conjuncts(e.args[0]) + _conjuncts(e.args[1])
    return [e]


def _exists(e):
    if isinstance(e, A.Exists):
        yield e
    elif isinstance(e, (A.Op, A.Call)):
        for a in e.args:
            yield from _exists(a)


__all__ = ["BLANK_TYPE", "Planner", "term"]
