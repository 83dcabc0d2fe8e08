"""Joins, unions, MINUS, grouping and the solution modifiers.

Variables join by plain equality, which Spark plans as a hash or sort-merge join and broadcasts where the size allows. Variables that
can be unbound match anything: where no other variable gives an equality, rows are parted into those with the variable bound, which
join by equality, and those without, which meet all rows, as their meaning is. MINUS asks for one bound variable in common, so it is
a chain of anti joins by equality.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..terms import NONE
from .solution import Binding, Solution, null_of, unified


def _all(conditions: list[Column]) -> Column | None:
    return reduce(lambda a, b: a & b, conditions) if conditions else None


def _shared(left: Solution, right: Solution) -> tuple[list[Column], dict[str, Binding], list[Column]]:
    """Join conditions of the shared variables, their joint bindings, and for each whether both sides are bound."""
    conditions, joint, bound = [], {}, []
    for name in left.vars.keys() & right.vars.keys():
        a, b = left.vars[name], right.vars[name]
        x, y, t = unified(a, b)
        if a.type == NONE or b.type == NONE:
            joint[name] = Binding(y if a.type == NONE else x, t, True)
            continue
        if a.nullable or b.nullable:
            conditions.append((x == y) | x.isNull() | y.isNull())
            joint[name] = Binding(F.coalesce(x, y) if a.nullable else x, t, a.nullable and b.nullable)
        else:
            conditions.append(x == y)
            joint[name] = Binding(x, t)
        bound.append(x.isNotNull() & y.isNotNull() if a.nullable or b.nullable else F.lit(True))
    return conditions, joint, bound


def _names_in_order(left: Solution, right: Solution) -> list[str]:
    return list(dict.fromkeys([*left.vars, *right.vars]))


def _loose(left: Solution, right: Solution) -> list[tuple[Column, Column]] | None:
    """Both columns of each shared variable, if every one of them can be unbound on a side; None if some can't."""
    out = []
    for name in left.vars.keys() & right.vars.keys():
        a, b = left.vars[name], right.vars[name]
        if a.type == NONE or b.type == NONE:
            continue
        if not (a.nullable or b.nullable):
            return None
        out.append(unified(a, b)[:2])
    return out


def _parted(left: DataFrame, right: DataFrame, loose: list[tuple[Column, Column]]) -> list[DataFrame]:
    """The join's parts by which of the loose variables are bound on both sides."""
    if not loose:
        return [left.crossJoin(right)]
    (x, y), rest = loose[0], loose[1:]
    on = _all([x == y, *[(p == q) | p.isNull() | q.isNull() for p, q in rest]])
    bound = left.where(x.isNotNull())
    return [bound.join(right.where(y.isNotNull()), on, "inner"), *_parted(left.where(x.isNull()), right, rest), *_parted(bound, right.where(y.isNull()), rest)]


def join(left: Solution, right: Solution) -> Solution:
    conditions, joint, _ = _shared(left, right)
    both = left.vars | right.vars | joint
    order, names = left.order + right.order, _names_in_order(left, right)
    loose = _loose(left, right)
    if loose is None:
        parts = [left.df.join(right.df, _all(conditions), "inner")]
    else:
        parts = _parted(left.df, right.df, loose)
    first, *others = (Solution(df, both, order).keep({n: both[n] for n in names}) for df in parts)
    for other in others:
        first.df = first.df.union(other.df)
    return first


def condition_scope(left: Solution, right: Solution) -> Solution:
    """What a condition of an optional part sees: both sides before the join."""
    _, joint, _ = _shared(left, right)
    return Solution(left.df, left.vars | right.vars | joint)


def left_join(left: Solution, right: Solution, extra: Column | None = None) -> Solution:
    conditions, joint, _ = _shared(left, right)
    on = _all([*conditions, *([extra] if extra is not None else [])])
    df = left.df.join(right.df, F.lit(True) if on is None else on, "left")
    out = {}
    for name in _names_in_order(left, right):
        if name in joint:
            a, j = left.vars[name], joint[name]
            out[name] = Binding(j.c, j.type, a.nullable or a.type == NONE)
        elif name in left.vars:
            out[name] = left.vars[name]
        else:
            b = right.vars[name]
            out[name] = Binding(b.c, b.type, True)
    return Solution(df, out, left.order).keep(out)


def semi_join(left: Solution, right: Solution, negated: bool, extra: Column | None = None) -> Solution:
    """FILTER EXISTS and NOT EXISTS: the left rows that have a compatible right row, or have none."""
    conditions, _, _ = _shared(left, right)
    on = _all([*conditions, *([extra] if extra is not None else [])])
    return Solution(left.df.join(right.df, F.lit(True) if on is None else on, "left_anti" if negated else "left_semi"), left.vars, left.order, left.sorted)


def minus(left: Solution, right: Solution) -> Solution:
    """Left rows without a compatible right row that shares a bound variable."""
    conditions, _, bound = _shared(left, right)
    if not bound:
        return left
    loose = _loose(left, right)
    if loose is None:
        return Solution(left.df.join(right.df, _all(conditions), "left_anti"), left.vars, left.order, left.sorted)
    df = left.df
    for k, (x, y) in enumerate(loose):
        others = [(p == q) | p.isNull() | q.isNull() for i, (p, q) in enumerate(loose) if i != k]
        df = df.join(right.df.where(y.isNotNull()), _all([x == y, *others]), "left_anti")
    return Solution(df, left.vars, left.order, left.sorted)


def union(left: Solution, right: Solution) -> Solution:
    """Bag union; a variable that one side lacks is unbound there."""
    a_cols, b_cols, out = {}, {}, {}
    for name in _names_in_order(left, right):
        a, b = left.vars.get(name), right.vars.get(name)
        if a is None or b is None:
            have = a or b
            a_cols[name] = a or Binding(null_of(have.type), have.type, True)
            b_cols[name] = b or Binding(null_of(have.type), have.type, True)
            out[name] = (have.type, True)
        else:
            x, y, t = unified(a, b)
            a_cols[name], b_cols[name] = Binding(x, t, a.nullable), Binding(y, t, b.nullable)
            out[name] = (t, a.nullable or b.nullable)
    one, two = Solution(left.df, a_cols).keep(a_cols), Solution(right.df, b_cols).keep(b_cols)
    df = one.df.union(two.df)
    return Solution(df, {n: Binding(one.vars[n].c, t, null) for n, (t, null) in out.items()})


def distinct(s: Solution) -> Solution:
    """One row per solution. An order on hidden columns keeps the least value of each."""
    kept = s.keep(s.vars)
    names = [df_name(b.c, kept.df) for b in kept.vars.values()]
    if not kept.order:
        return Solution(kept.df.dropDuplicates(), kept.vars)
    hidden = kept.df.columns[len(names):]
    df = kept.df.groupBy(*names).agg(*[(F.min if asc else F.max)(h).alias(h) for h, (_, asc) in zip(hidden, kept.order, strict=True)])
    return Solution(df, kept.vars, kept.order)


def df_name(c: Column, df: DataFrame) -> str:
    return df.select(c).columns[0]


def sort(s: Solution) -> Solution:
    """Apply the pending order; unbound comes first, as SPARQL orders it."""
    if not s.order or s.sorted:
        return s
    return Solution(s.df.orderBy(*[c.asc_nulls_first() if asc else c.desc_nulls_last() for c, asc in s.order]), s.vars, s.order, True)


def slice_(s: Solution, offset: int, limit: int | None) -> Solution:
    s = sort(s)
    df = s.df.offset(offset) if offset else s.df
    return Solution(df if limit is None else df.limit(limit), s.vars, s.order, s.sorted)
