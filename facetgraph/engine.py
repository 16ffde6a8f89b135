"""Query text to a DataFrame.

A query's labels become frames (projected, filtered scans of one entity), its comparisons between labels become
joins, and its construct becomes a projection. Everything is declared; Catalyst picks join strategies and pushes
filters and columns into the scans.

Result columns: a dict construct has a column per key (``key`` and ``value`` for a computed key), a list construct
c0, c1, .., a value construct ``value`` (value1, .. when it has several). Where a join may match several objects,
the root object stays one row and the other labels' outputs are arrays.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .catalog import Catalog, Entity
from .functions import AGGREGATE, SCALAR, null_low, number, truthy
from .lang import QueryError, parse
from .lang.ast import Bind, Call, Const, Construct, FilterSet, Item, Op, Prop, Ref, Star
from .operators.closure import closure
from .sources import statements as st

ID = "id"
#: The column of ``*`` over statements: a map of the properties that no other item names.
REST = "properties"
FOLLOW = ("follow", "rfollow")
#: Functions whose result is a number.
NUMERIC = {"add", "sub", "mul", "div", "mod", "negate", "number"}
#: Functions of the history, and the log's columns that they read.
HISTORY = {"getTransactionId": "txn", "getTransactionTime": "ts", "getTransactionAuthor": "author", "getTransactionComment": "comment"}
#: Aggregates that follow from those of parts of their rows, and the parts' aggregates.
FOLDED = {"count": ("count",), "sum": ("sum",), "total": ("sum",), "avg": ("sum", "count"), "min": ("min",), "max": ("max",)}
BUILT_IN = {n: AGGREGATE[n] for n in FOLDED}


@dataclass
class Label:
    name: str
    entity: Entity | None = None
    kinds: set = field(default_factory=set)  # from type = ..
    conds: list = field(default_factory=list)
    required: set = field(default_factory=set)
    used: set = field(default_factory=set)
    absent: set = field(default_factory=set)
    txn: set = field(default_factory=set)  # properties whose transactions are asked for
    rest: bool = False  # all properties are shown


def _walk(e):
    yield e
    if isinstance(e, Op | Call):
        for a in e.args:
            for x in a if isinstance(a, tuple) else (a,):
                yield from _walk(x)
        if isinstance(e, Call):
            for _, x in e.named:
                yield from _walk(x)


def _map(e, f):
    """e with f applied to its leaves; filter sets are leaves."""
    if isinstance(e, Op):
        return Op(e.name, tuple(tuple(_map(x, f) for x in a) if isinstance(a, tuple) else _map(a, f) for a in e.args))
    if isinstance(e, Call):
        return Call(e.name, tuple(_map(a, f) for a in e.args), tuple((k, _map(v, f)) for k, v in e.named))
    return f(e)


def _props(e) -> list[Prop]:
    return [x for x in _walk(e) if isinstance(x, Prop)]


def _conj(e) -> list:
    if e is None:
        return []
    if isinstance(e, Op) and e.name == "and":
        return [y for x in e.args for y in _conj(x)]
    if isinstance(e, Op) and e.name == "not":
        (x,) = e.args
        if isinstance(x, Op) and x.name == "not":
            return _conj(x.args[0])
        if isinstance(x, Op) and x.name == "or":  # De Morgan
            return [y for z in x.args for y in _conj(Op("not", (z,)))]
    return [e]


class Plan:
    """One construct in its scope."""

    def __init__(self, catalog: Catalog, spark: SparkSession, binds: dict, fresh=None, outer: dict[str, Label] | None = None):
        self.catalog, self.spark, self.binds = catalog, spark, binds
        self.fresh = fresh or itertools.count()
        self.labels: dict[str, Label] = {}
        self.outer = outer or {}
        self.joins: list[tuple] = []  # (condition, maybe)
        self.exists: list = []
        self.semis: list = []  # (left, filter set, negated)
        self.paths: list = []  # (label, call): label in follow(..)
        self.within: list = []  # (node, call, negated): one of both is a constant
        self.alias: dict[str, str] = {}
        self.many = False
        self.fold: Fold | None = None

    # analysis

    def label(self, name: str) -> Label:
        name = self.alias.get(name, name)
        if name in self.outer:
            return self.outer[name]
        return self.labels.setdefault(name, Label(name))

    def new(self) -> str:
        return f"_{next(self.fresh)}"

    def bound(self, e, me: str, maybe: bool = False):
        """e with properties bound to labels; paths and filter sets become labels of their own."""

        def leaf(x):
            if isinstance(x, Prop):
                label = self.alias.get(x.label, x.label) or me
                self.label(label)
                path = tuple(p for p in x.path if p != ID) if x.path[-1:] == (ID,) else x.path
                while len(path) > 1:
                    label, path = self.step(label, path[0], maybe), path[1:]
                return Prop(path, label)
            if isinstance(x, FilterSet):
                name = x.label or self.new()
                self.label(name)
                self.add(x.where, name)
                return Prop((), name)
            if isinstance(x, Bind):
                if x.name not in self.binds:
                    raise QueryError(f"no value for :{x.name}")
                return Const(self.binds[x.name])
            return x

        return _map(e, leaf)

    def step(self, label: str, prop: str, maybe: bool) -> str:
        """The label of what a reference property leads to."""
        for cond, m in self.joins:
            if m == maybe and isinstance(cond, Op) and cond.args[0] == Prop((prop,), label) and cond.args[1].label.startswith("_"):
                return cond.args[1].label
        to = self.new()
        self.label(to)
        self.mention(Prop((prop,), label), required=not maybe)
        self.joins.append((Op("=", (Prop((prop,), label), Prop((), to))), maybe))
        return to

    def add(self, where, me: str) -> None:
        for e in _conj(where):
            self.condition(e, me)

    def condition(self, e, me: str) -> None:
        maybe = False
        if isinstance(e, Op) and e.name == "maybe":
            (e,), maybe = e.args, True
        if isinstance(e, FilterSet):
            if maybe:
                raise QueryError("maybe before a filter set that nothing joins")
            if e.label:
                self.label(e.label)
                self.add(e.where, e.label)
            else:
                self.exists.append(e)
            return
        negated = isinstance(e, Op) and e.name == "not"
        inner = e.args[0] if negated else e
        if isinstance(inner, Op) and inner.name == "in" and not isinstance(inner.args[1], tuple):
            left, right = inner.args
            if isinstance(right, FilterSet):
                left = self.bound(left, me)
                for p in _props(left):
                    self.mention(p, required=True)
                self.semis.append((left, right, negated))
                return
            if isinstance(right, Call) and right.name in FOLLOW:
                left, call = self.bound(left, me), Call(right.name, (self.bound(right.args[0], me), right.args[1], *right.args[2:]), right.named)
                if isinstance(left, Prop) and isinstance(call.args[0], Prop) and not negated:
                    self.paths.append((left.label, call))
                else:
                    self.within.append((left, call, negated))
                return
        if isinstance(inner, Prop) and (inner.path or inner.label):
            p = self.bound(inner, me, maybe)
            if not p.path:
                return
            lab = self.label(p.label)
            lab.used.add(p.path[0])
            (lab.absent if negated else lab.used if maybe else lab.required).add(p.path[0])
            return
        if isinstance(e, Op) and len(e.args) == 2 and isinstance(e.args[1], Op) and e.args[1].name == "maybe":
            e, maybe = Op(e.name, (e.args[0], e.args[1].args[0])), True
        if isinstance(e, Op) and e.name == "=":
            a, b = e.args
            for x, y in ((a, b), (b, a)):
                if isinstance(x, Prop) and x.path == ("type",) and isinstance(y, Const | Ref | Bind):
                    kind = y.value if isinstance(y, Const) else y.id if isinstance(y, Ref) else self.binds[y.name]
                    if kind in self.catalog.entities and not self.catalog.entities[kind].multi:
                        self.label(self.alias.get(x.label, x.label) or me).kinds.add(kind)
                        return
            if all(isinstance(x, Prop) and (not x.path or x.path == (ID,)) for x in (a, b)):
                one, two = ((self.alias.get(x.label, x.label) or me) for x in (a, b))
                if maybe:
                    raise QueryError("maybe before an alias")
                if one != two:
                    self.unify(one, two)
                return
        e = self.bound(e, me, maybe)
        self.histories(e)
        names = {p.label for p in _props(e)}
        if len(names) > 1 or (names and names <= set(self.outer)):
            self.joins.append((e, maybe))
            for p in _props(e):
                self.mention(p, required=not maybe)
            return
        if maybe and names:
            raise QueryError("maybe before a condition that joins nothing")
        for n in names or {me}:
            self.label(n).conds.append(e)
        self.require(e)

    def require(self, e) -> None:
        """A comparison of a property requires it, unless it compares with null."""
        if isinstance(e, Op) and e.name in ("or", "and", "not"):
            # an alternative doesn't require what it names, a negated conjunction neither
            inner = e.args[0] if e.name == "not" else e
            if isinstance(inner, Op) and inner.name in ("or", "and"):
                for p in _props(e):
                    self.mention(p, required=False)
                return
        needs = not any(isinstance(x, Const) and x.value is None for x in _walk(e))
        for p in _props(e):
            self.mention(p, required=needs)

    def mention(self, p: Prop, required: bool) -> None:
        if p.path:
            lab = self.label(p.label)
            lab.used.add(p.path[0])
            if required:
                lab.required.add(p.path[0])

    def histories(self, e) -> None:
        """Notes whose history e asks for."""
        for x in _walk(e):
            if isinstance(x, Call) and x.name in HISTORY:
                for p in _props(x):
                    self.label(p.label).txn.add(p.path[0] if p.path else "")

    def unify(self, one: str, two: str) -> None:
        keep, gone = (one, two) if one in self.outer or not (two in self.outer) else (two, one)
        self.alias = {k: keep if v == gone else v for k, v in self.alias.items()} | {gone: keep}
        old, into = self.labels.pop(gone, None), self.label(keep)
        swap = lambda x: Prop(x.path, keep) if isinstance(x, Prop) and x.label == gone else x
        if old:
            into.kinds |= old.kinds
            into.conds += [_map(c, swap) for c in old.conds]
            for k in ("required", "used", "absent"):
                getattr(into, k).update(getattr(old, k))
        self.joins = [(_map(c, swap), m) for c, m in self.joins]
        self.semis = [(_map(x, swap), s, n) for x, s, n in self.semis]

    def bind(self) -> None:
        """An entity for each label: by type, by the references that lead to it, or by its properties."""
        todo = {n: v for n, v in self.labels.items() if v.entity is None}
        for _ in range(len(todo) + 1):
            for v in todo.values():
                if v.entity is None and v.kinds:
                    if len(v.kinds) > 1:
                        raise QueryError(f"?{v.name} can't be of types {sorted(v.kinds)}")
                    v.entity = self.catalog.entities[next(iter(v.kinds))]
            for cond, _m in self.joins:
                if isinstance(cond, Op) and cond.name == "=" and all(isinstance(x, Prop) for x in cond.args):
                    for x, y in (cond.args, cond.args[::-1]):
                        if x.path and not y.path:
                            src, dst = self.label(x.label), self.label(y.label)
                            if src.entity and dst.entity is None and x.path[0] in src.entity.refs:
                                dst.entity = self.catalog.entities[src.entity.refs[x.path[0]]]
            for to, call in self.paths:
                a, b = self.label(to), self.label(call.args[0].label)
                a.entity, b.entity = a.entity or b.entity, b.entity or a.entity
            for v in todo.values():
                if v.entity is None:
                    found = self.catalog.having(v.required | v.used | v.absent)
                    if len(found) == 1:
                        v.entity = found[0]
        for v in todo.values():
            if v.entity is None:
                v.entity = self.union(v)

    def union(self, v: Label) -> Entity:
        """Objects of several types: the candidates' needed columns, with text ids."""
        found = [e for e in self.catalog.having(v.required) if e.key] or None
        if not found:
            raise QueryError(f"no entity has the properties {sorted(v.required | v.used)}")
        need = sorted(v.required | v.used | v.absent)
        parts = [e.df.select(e.id_of(F.col).alias("_id"), *[F.col(p).cast("string").alias(p) for p in need if p in e.props]) for e in found]
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        for p in need:
            if p not in df.columns:
                df = df.withColumn(p, F.lit(None).cast("string"))
        return replace(Entity("", df, ("_id",)), multi=False)

    # columns

    def at(self, label: str, prop: str) -> Column:
        return F.col(f"`{label}${prop}`")

    def key(self, label: str) -> Column:
        e = self.label(label).entity
        return e.key_of(lambda k: self.at(label, k))

    def id(self, label: str) -> Column:
        e = self.label(label).entity
        if not e.key:
            return F.lit(None).cast("string")
        return F.when(self.at(label, e.key[0]).isNotNull(), e.id_of(lambda k: self.at(label, k))) if e.name else self.at(label, "_id")

    def multi(self, e) -> bool:
        """Whether e is of properties with several values."""
        return any(self.label(p.label).entity.multi for p in _props(e))

    def values(self, e) -> Column:
        """e as an array of typed values: functions map over the values of their arguments, or over their product."""
        if isinstance(e, Prop):
            if self.label(e.label).entity.multi and e.path:
                return self.at(e.label, e.path[0])
            if not e.path:
                return F.array(st.value(self.id(e.label), F.lit("R")))
            c = self.col(e)
            return F.when(c.isNull(), F.array().cast(st.VALUES)).otherwise(F.array(self.referring(e, c)))
        if isinstance(e, Const):
            return F.array(st.constant(e.value))
        if isinstance(e, Ref):
            return F.array(st.value(F.lit(e.id), F.lit("R")))
        if isinstance(e, Call):
            return self.mapped(e)
        if e.name in ("and", "or"):
            one, *more = e.args
            for x in more:
                first = self.values(one) if not isinstance(one, Column) else one
                ok = F.exists(first, st.true)
                one = F.when(ok, self.values(x)).otherwise(first) if e.name == "and" else F.when(ok, first).otherwise(self.values(x))
            return one
        return F.array(st.value_of(self.truth(e)))

    def referring(self, e: Prop, c: Column) -> Column:
        """A column of a table as a value; its references are texts that begin with @."""
        ref = self.label(e.label).entity.refs.get(e.path[0])
        return st.value(F.substring(c, 2, 1 << 20), F.lit("R")) if ref else st.value_of(c)

    def mapped(self, e: Call) -> Column:
        if e.name in HISTORY or e.name in AGGREGATE:
            return F.array(st.value_of(self.col(e)))
        if e.name not in SCALAR:
            raise QueryError(f"unknown function {e.name}")
        if e.name == "if":
            return F.when(self.truth(e.args[0]), self.values(e.args[1])).otherwise(self.values(e.args[2]))
        special = {
            "bool": lambda x: st.value_of(st.true(x)),
            "isref": lambda x: st.value_of(x["t"] == "R"),
            "isbnode": lambda x: st.value_of((x["t"] == "R") & SCALAR["isbnode"](x["o"])),
            "ref": lambda x: st.value(F.regexp_replace(x["o"], "^@", ""), F.lit("R")),
        }
        if e.name in special:
            return F.transform(self.values(e.args[0]), special[e.name])

        def product(rest: tuple, chosen: list) -> Column:
            if not rest:
                return F.array(st.value_of(SCALAR[e.name](*chosen)))
            return F.flatten(F.transform(self.values(rest[0]), lambda x: product(rest[1:], [*chosen, st.text_of(x)])))

        return product(e.args, [])

    def truth(self, e) -> Column:
        """e within an expression: a property's values must be true, not only there."""
        if isinstance(e, Op) and e.name == "not":
            return ~self.truth(e.args[0])
        if isinstance(e, Op) and e.name in ("and", "or"):
            return reduce(lambda a, b: a & b if e.name == "and" else a | b, map(self.truth, e.args))
        return self.holds(e) if isinstance(e, Op) else F.exists(self.values(e), st.true)

    def holds(self, e) -> Column:
        """e, of properties with several values, as a condition: comparisons hold if a pair of values does."""
        if isinstance(e, Prop):
            return F.size(self.values(e)) > 0 if e.path else F.lit(True)
        if isinstance(e, Op):
            if e.name == "not":
                return ~self.test(e.args[0])
            if e.name in ("and", "or"):
                return reduce(lambda a, b: a & b if e.name == "and" else a | b, [self.test(x) for x in e.args])
            a, b = e.args
            exact = not all(_props(x) for x in e.args if not isinstance(x, tuple))
            if e.name == "in":
                b = F.concat(*[self.values(x) for x in b]) if isinstance(b, tuple) else self.values(b)
                return st.any_pair(self.values(a), b, lambda x, y: st.same(x, y, exact))
            null = [x for x in e.args if isinstance(x, Const) and x.value is None]
            found = st.any_pair(self.values(a), self.values(b), lambda x, y: st.compared(e.name, x, y, exact))
            if null and e.name == "=":  # a property that isn't there is null, too
                return found | (F.size(self.values(b if a in null else a)) == 0)
            return found
        return F.exists(self.values(e), st.true)

    def col(self, e, agg: bool = False) -> Column:
        if isinstance(e, Call | Op) and not (isinstance(e, Call) and e.name in HISTORY) and not _has_agg(e) and self.multi(e):
            return self.values(e)
        if isinstance(e, Const):
            return F.lit(e.value)
        if isinstance(e, Ref):
            return F.lit("@" + e.id)
        if isinstance(e, Prop):
            if not e.path:
                return self.id(e.label)
            ent = self.label(e.label).entity
            if ent.multi:
                return self.at(e.label, e.path[0])
            ref = ent.refs.get(e.path[0])
            c = self.at(e.label, e.path[0])
            return F.when(c.isNotNull(), F.concat(F.lit(f"@{ref}/"), self.key_text(c))) if ref else c
        if isinstance(e, Call):
            if e.name in AGGREGATE:
                if not agg:
                    raise QueryError(f"{e.name}() has no place here")
                x = e.args[0] if e.args else Star()
                if isinstance(x, Star):
                    return self.count_rows()
                if self.fold and self.fold.used:
                    return self.fold.total(e.name, x)
                if self.multi(x):
                    return self.over_values(e.name, self.values(x))
                return AGGREGATE[e.name](self.col(x))
            if e.name in HISTORY:
                (x,) = _props(e)[:1] or [None]
                if x is None or len(e.args) != 1:
                    raise QueryError(f"{e.name}() needs a property or an object")
                if not self.label(x.label).entity.multi or self.label(x.label).entity.df.log is None:
                    return F.lit(None).cast("string")
                return self.at(x.label, f"txn${x.path[0] if x.path else ''}")[HISTORY[e.name]]
            if e.name not in SCALAR:
                raise QueryError(f"unknown function {e.name}")
            if e.name == "isref" and isinstance(e.args[0], Prop | Const | Ref):
                return self.is_ref(e.args[0])
            return SCALAR[e.name](*[self.col(a, agg) for a in e.args])
        if isinstance(e, Op):
            return self.chosen(e, agg) if e.name in ("and", "or") else self.logic(e, agg)
        raise QueryError(f"can't evaluate {e}")

    def count_rows(self) -> Column:
        return F.coalesce(F.sum(Fold.ROWS), F.lit(0)) if self.fold and self.fold.used else F.count(F.lit(1))

    def is_ref(self, e) -> Column:
        """Of a table's columns those of the catalog's references are references, whatever a text looks like."""
        if isinstance(e, Prop) and e.path:
            return self.at(e.label, e.path[0]).isNotNull() if e.path[0] in self.label(e.label).entity.refs else F.lit(False)
        return F.lit(not isinstance(e, Const))

    def over_values(self, name: str, v: Column) -> Column:
        """An aggregate of all values of all rows; each row's are summed up first."""
        v = F.filter(v, lambda x: x["t"] != "null")
        numbers = F.transform(v, lambda x: number(st.text_of(x)))
        row_sum = F.when(F.size(v) > 0, F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x))
        if name == "count":
            return F.coalesce(F.sum(F.size(v).cast("long")), F.lit(0))
        if name in ("sum", "total"):
            return F.sum(row_sum) if name == "sum" else F.coalesce(F.sum(row_sum), F.lit(0.0))
        if name == "avg":
            return F.sum(row_sum) / F.sum(F.size(v))
        if name in ("min", "max"):
            pick = F.array_min if name == "min" else F.array_max
            keyed = F.transform(v, lambda x: F.struct(st.sort_key(x).alias("k"), x.alias("v")))
            best = (F.min if name == "min" else F.max)(pick(keyed))
            return F.when(best.isNotNull(), F.array(best["v"]))
        return AGGREGATE[name](F.when(F.size(v) > 0, st.text_of(F.get(v, F.lit(0)))))

    def key_text(self, c: Column) -> Column:
        return c.cast("string")

    def kind(self, e) -> str:
        """Whether e is text, a number or a truth value, as far as its form tells."""
        if _is_test(e):
            return "truth"
        if isinstance(e, Const):
            return "number" if isinstance(e.value, int | float) else "text"
        if isinstance(e, Prop) and e.path:
            entity = self.label(e.label).entity
            numeric = e.path[0] not in entity.refs and isinstance(entity.df.schema[e.path[0]].dataType, NumericType)
            return "number" if numeric else "text"
        if isinstance(e, Op):
            kinds = {self.kind(x) for x in e.args}
            return kinds.pop() if len(kinds) == 1 else "text"
        return "number" if isinstance(e, Call) and (e.name in NUMERIC or e.name in AGGREGATE) else "text"

    def chosen(self, e: Op, agg: bool) -> Column:
        """and, or as values: the operand that decides, as it is."""
        if all(_is_test(x) for x in e.args):
            return self.logic(e, agg)
        same = len({self.kind(x) for x in e.args}) == 1
        out = None
        for x in reversed(e.args):
            c = self.col(x, agg)
            own = c if same else c.cast("string")
            if out is None:
                out = own
            else:
                out = F.when(truthy(c), out).otherwise(own) if e.name == "and" else F.when(truthy(c), own).otherwise(out)
        return out

    def logic(self, e: Op, agg: bool = False) -> Column:
        if e.name == "not":
            return ~self.test(e.args[0], agg)
        if e.name in ("and", "or"):
            return reduce(lambda a, b: a & b if e.name == "and" else a | b, [self.test(x, agg) for x in e.args])
        if e.name == "in":
            left, right = e.args
            if isinstance(right, tuple):
                return reduce(lambda a, b: a | b, [self.compare("=", left, x, agg) for x in right], F.lit(False))
            return F.coalesce(F.array_contains(self.col(right, agg), self.col(left, agg)), F.lit(False))
        return self.compare(e.name, *e.args, agg)

    def test(self, e, agg: bool = False) -> Column:
        """e as a condition."""
        if not agg and not isinstance(e, Const | Ref) and self.multi(e):
            return self.holds(e)
        if isinstance(e, Op) and e.name not in ("maybe",):
            return self.logic(e, agg)
        if isinstance(e, Prop):
            return self.at(e.label, e.path[0]).isNotNull() if e.path else F.lit(True)
        return truthy(self.col(e, agg))

    def compare(self, op: str, a, b, agg: bool = False) -> Column:
        for x, y, flip in ((a, b, False), (b, a, True)):
            if isinstance(x, Prop) and isinstance(y, Prop | Ref) and not self.label(x.label).entity.multi:
                ent = self.label(x.label).entity
                ref = ent.refs.get(x.path[0]) if x.path else ent.name
                if isinstance(y, Ref) and ref:
                    kind, _, key = y.id.partition("/")
                    if kind != ref:
                        return F.lit(op == "!=")
                    mine = self.at(x.label, x.path[0]) if x.path else self.key(x.label)
                    return null_low(op, mine.cast("string"), F.lit(key))
                if isinstance(y, Prop) and ref and not y.path and self.label(y.label).entity.name == ref and x.path:
                    mine, other = self.at(x.label, x.path[0]), self.key(y.label)
                    if op == "=":
                        return mine == other
                    return null_low(op, *((other, mine) if flip else (mine, other)))
        if isinstance(a, Prop) and isinstance(b, Prop):
            if not a.path and not b.path:
                return null_low(op, self.id(a.label), self.id(b.label))
            if op == "=" and a.label != b.label:
                one = self.at(a.label, a.path[0]) if a.path else self.id(a.label)
                two = self.at(b.label, b.path[0]) if b.path else self.id(b.label)
                return one == two
        if isinstance(b, Const) and isinstance(a, Prop) and not a.path and isinstance(b.value, str):
            b = Const(b.value.removeprefix("@"))
        return null_low(op, self.col(a, agg), self.col(b, agg))

    # frames and joins

    def frame(self, v: Label) -> DataFrame:
        e = v.entity
        if e.multi:
            return multi_frame(self, v)
        missing = (v.required | v.used) - set(e.props)
        if v.required - set(e.props):
            raise QueryError(f"{e.name} has no {sorted(v.required - set(e.props))}")
        need = list(dict.fromkeys([*e.key, *sorted((v.used | v.required | v.absent) & set(e.props))]))
        df = e.df.select(*[F.col(p).alias(f"{v.name}${p}") for p in need]) if need else e.df.select(F.lit(1).alias(f"{v.name}$"))
        for p in sorted(missing):
            df = df.withColumn(f"{v.name}${p}", F.lit(None).cast("string"))
        for p in sorted(v.required & set(e.props)):
            df = df.where(self.at(v.name, p).isNotNull())
        for p in sorted(v.absent & set(e.props)):
            df = df.where(self.at(v.name, p).isNull())
        for c in v.conds:
            df = df.where(self.test(c))
        return df

    def whole(self, me: str) -> DataFrame:
        """All labels joined, beginning with me (or with what the outer scope has)."""
        self.bind()
        done = {me} if me in self.labels else set()
        df = self.frame(self.labels[me]) if done else None
        if self.paths or any(v.entity.multi for v in self.labels.values()):
            self.fold = None
        single = {n for n in done if self.labels[n].entity.key}  # labels whose objects are in one row of df each
        todo = [n for n in self.labels if n not in done]
        joins = [j for j in self.joins if not ({p.label for p in _props(j[0])} & set(self.outer))]
        self.correlated = [j for j in self.joins if j not in joins]
        while todo or joins:
            ready = [j for j in joins if {p.label for p in _props(j[0])} <= done]
            for j in ready:
                joins.remove(j)
                df = df.where(self.test(j[0]))
            if not todo:
                break

            def rank(n):
                with_n = [j for j in joins if n in {p.label for p in _props(j[0])} <= done | {n}]
                return (not with_n, any(m for _, m in with_n), not any(isinstance(c, Op) and c.name == "=" for c, _ in with_n))

            path = [(to, call) for to, call in self.paths if to in todo and call.args[0].label in done]
            if path:
                df = self.follow_join(df, *path[0])
                self.paths.remove(path[0])
                todo.remove(path[0][0])
                done.add(path[0][0])
                continue
            n = min(todo, key=rank)
            on = [j for j in joins if n in {p.label for p in _props(j[0])} <= done | {n}]
            right = self.frame(self.labels[n])
            equal = [j for j in on if self.by_values(j[0], n)]
            if equal:
                df = self.value_join(df, right, n, equal[0], done, [j for j in on if j is not equal[0]])
                self.many = True
                joins = [j for j in joins if j not in on]
            elif on:
                how = "left" if any(m for _, m in on) else "inner"
                test = reduce(lambda a, b: a & b, [self.test(c) for c, _ in on])
                one, of_one = any(self.to_one(c, n) for c, _ in on), any(self.to_one(c, m) for c, _ in on for m in single)
                if self.fold and not one and not of_one:
                    df = self.fold.join(df, right, n, done, [c for c, _ in joins], test, how)
                else:
                    df = df.join(right, test, how)
                self.many |= not one
                single = (single if one else set()) | ({n} if of_one and self.labels[n].entity.key else set())
                joins = [j for j in joins if j not in on]
            else:
                df = self.fold.join(df, right, n, done, [c for c, _ in joins]) if self.fold else df.crossJoin(right)
                self.many, single = True, set()
            todo.remove(n)
            done.add(n)
        for left, s, negated in self.semis:
            df = self.semi(df, left, s, negated)
        for node, call, negated in self.within:
            df = self.within_join(df, node, call, negated)
        for s in self.exists:
            sub = Plan(self.catalog, self.spark, self.binds, self.fresh)
            name = sub.new()
            sub.label(name)
            sub.add(s.where, name)
            found = sub.whole(name).limit(1).select(F.lit(1).alias("_one"))
            df = df.crossJoin(F.broadcast(found)).drop("_one")
        if self.fold:
            self.fold.have = df.columns
        return df

    def by_values(self, c, n: str) -> bool:
        """Whether the condition is an equality of label n with others over properties of several values."""
        if not (isinstance(c, Op) and c.name == "=" and self.multi(c)):
            return False
        sides = [{p.label for p in _props(x)} for x in c.args]
        return {n} in sides and all(sides) and not sides[0] & sides[1]

    def keys_of(self, labels) -> list[str]:
        """The columns that tell the objects of the labels."""
        return [f"{n}${k}" for n in sorted(labels) for k in self.label(n).entity.key]

    def value_join(self, df: DataFrame, right: DataFrame, n: str, join: tuple, done: set, more: list) -> DataFrame:
        """df joined to label n's frame where one value of either side is equal. Values become rows, which are joined by
        text and type; pairs that several values join stay one."""
        (c, maybe), (a, b) = join, join[0].args
        if n in {p.label for p in _props(a)}:
            a, b = b, a
        key = lambda e: F.explode(F.array_distinct(F.transform(self.values(e), self.join_key))).alias("_k")
        # the sides whose rows have keys meet as pairs of keys; the others whole
        left = df.withColumn("_k", key(a))
        pairs = left.join(right.withColumn("_k", key(b)), "_k").drop("_k")
        for other, _ in more:
            pairs = pairs.where(self.test(other))
        ours, theirs = self.keys_of(done), self.keys_of({n})
        if all(self.label(x).entity.key for x in done | {n}):
            pairs = pairs.dropDuplicates(ours + theirs)
        if not maybe:
            return pairs
        pairs = pairs.select(*[F.col(f"`{x}`").alias(f"_l{i}") for i, x in enumerate(ours)], *[f"`{x}`" for x in right.columns])
        return df.join(pairs, reduce(lambda x, y: x & y, [F.col(f"`{x}`").eqNullSafe(F.col(f"_l{i}")) for i, x in enumerate(ours)]), "left").drop(*[f"_l{i}" for i in range(len(ours))])

    @staticmethod
    def join_key(x: Column) -> Column:
        """Numbers are equal as numbers, all else by text and type."""
        n = st.number_of(x)
        return F.struct(F.when(n.isNotNull(), n.cast("string")).otherwise(x["o"]).alias("o"), F.when(n.isNotNull(), "n").otherwise(x["t"]).alias("t"))

    def nodes(self, call: Call, node) -> tuple[Entity, DataFrame]:
        """The entity that a closure from a constant ranges over, and (node) of its nodes."""
        prop = call.args[1].path[0]
        found = [e for e in self.catalog.entities.values() if e.multi or prop in e.refs]
        if len(found) != 1:
            raise QueryError(f"{prop!r} is a reference of {len(found)} entities")
        e = found[0]
        edges = self.edges(e, call)
        kind = edges.schema["src"].dataType
        name = e.name + "/"
        text = (node.id if isinstance(node, Ref) else str(node.value)).removeprefix("@")
        key = text if e.multi else text.removeprefix(name)
        seeds = self.spark.range(1).select(F.lit(key).cast(kind).alias("start"))
        return e, closure(edges, seeds, *self.flags(call)).select("node")

    def within_join(self, df: DataFrame, node, call: Call, negated: bool) -> DataFrame:
        """label in follow(constant, ..), or constant in follow(label, ..): the labels' objects whose key is, or isn't,
        among the nodes from the constant, or on a way to it."""
        start = call.args[0]
        if isinstance(node, Prop) and isinstance(start, Prop):  # both are labels, negated
            p = self.pairs(call, start.label).select(F.col("start").alias("_s"), F.col("node").alias("_n"))
            return df.join(p, (self.key(start.label) == F.col("_s")) & (self.key(node.label) == F.col("_n")), "left_anti")
        label = node.label if isinstance(node, Prop) else start.label
        if isinstance(node, Prop):
            _, found = self.nodes(call, start)
        else:
            back = Call("rfollow" if call.name == "follow" else "follow", (start, call.args[1]), ())
            e, found = self.nodes(back, node)
            initial, leaves = self.flags(call)
            key = found.schema["node"].dataType
            own = F.lit((node.id if isinstance(node, Ref) else str(node.value)).removeprefix("@").removeprefix("" if e.multi else e.name + "/")).cast(key)
            if initial:
                found = found.where(F.col("node") != own)
            if leaves:  # the constant must be a leaf
                found = found.join(self.edges(e, call).where(F.col("src") == own).limit(1).select(F.lit(True).alias("_")), F.lit(True), "left_anti")
        if isinstance(node, Prop) and node.path and self.label(label).entity.multi:
            held = df.select(*[f"`{x}`" for x in self.keys_of({label})], F.explode(self.values(node)).alias("_v"))
            held = held.where("_v.t = 'R'").join(found, F.col("_v.o") == F.col("node"), "left_semi").drop("_v").distinct()
            return df.join(held, self.keys_of({label}), "left_anti" if negated else "left_semi")
        mine = self.at(label, node.path[0]) if isinstance(node, Prop) and node.path else self.key(label)
        return df.join(found, mine == F.col("node"), "left_anti" if negated else "left_semi")

    def to_one(self, c, n: str) -> bool:
        """Whether the condition finds one object of label n at most."""
        if not (isinstance(c, Op) and c.name == "="):
            return False
        e = self.labels[n].entity
        return any(isinstance(x, Prop) and x.label == n and (not x.path or e.key == x.path) for x in c.args)

    def semi(self, df: DataFrame, left, s: FilterSet, negated: bool) -> DataFrame:
        sub = Plan(self.catalog, self.spark, self.binds, self.fresh)
        name = s.label or sub.new()
        sub.label(name)
        sub.add(s.where, name)
        if isinstance(left, Prop) and left.path:
            ref = self.label(left.label).entity.refs.get(left.path[0])
            if ref and not sub.labels[name].kinds:
                sub.labels[name].kinds.add(ref)
        right = sub.whole(name)
        if self.multi(left):
            held = df.select(*[f"`{x}`" for x in self.keys_of({p.label for p in _props(left)})], F.explode(self.values(left)).alias("_v"))
            held = held.where("_v.t = 'R'").join(right.select(sub.id(name).alias("_k")), F.col("_v.o") == F.col("_k"), "left_semi").drop("_v").distinct()
            return df.join(held, held.columns, "left_anti" if negated else "left_semi")
        object_key = isinstance(left, Prop) and left.path and left.path[0] in self.label(left.label).entity.refs
        mine = self.at(left.label, left.path[0]) if object_key else self.col(left)
        theirs = sub.key(name) if object_key else sub.id(name)
        keys = right.select(theirs.alias("_k"))
        return df.join(keys, mine == F.col("_k"), "left_anti" if negated else "left_semi")

    @staticmethod
    def flags(call: Call) -> tuple[bool, bool]:
        """excludeInitial and edgesOnly."""
        flags = [a.value for a in call.args[2:]] + [False, False]
        named = {k: v.value for k, v in call.named}
        return named.get("excludeInitial", flags[0]), named.get("edgesOnly", flags[1])

    @staticmethod
    def edges(e: Entity, call: Call) -> DataFrame:
        """(src, dst) in the direction of follow or rfollow."""
        prop = call.args[1].path[0]
        edges = e.df.edges(prop) if e.multi else e.df.select(e.key_of(F.col).alias("src"), F.col(prop).alias("dst"))
        return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if call.name == "rfollow" else edges

    def pairs(self, call: Call, label: str, rows: DataFrame | None = None) -> DataFrame:
        """(start, node) of follow or rfollow from the objects of label: those in rows, or all."""
        v = self.label(label)
        seeds = None
        if rows is not None and (v.conds or v.kinds or v.absent):
            seeds = rows.select(self.key(label).alias("start")).distinct()
        elif v.entity.multi:
            seeds = v.entity.df.statements.select(F.col("subject").alias("start")).distinct()
        else:
            seeds = v.entity.df.select(v.entity.key_of(F.col).alias("start"))
        return closure(self.edges(v.entity, call), seeds, *self.flags(call), everywhere=rows is None or not (v.conds or v.absent))

    def follow_join(self, df: DataFrame, to: str, call: Call) -> DataFrame:
        start = call.args[0].label
        p = self.pairs(call, start, df).select(F.col("start").alias("_s"), F.col("node").alias("_n"))
        df = df.join(p, self.key(start) == F.col("_s"))
        self.many = True
        return df.join(self.frame(self.labels[to]), F.col("_n") == self.key(to)).drop("_s", "_n")

    def key_pair(self, a, b) -> tuple[Column, Column]:
        """Columns of both sides of an equality, native where they are keys or properties."""

        def native(x) -> Column:
            if isinstance(x, Prop):
                return self.at(x.label, x.path[0]) if x.path else self.key(x.label)
            return self.col(x)

        return native(a), native(b)


class Fold:
    """Aggregates of joined objects without their pairs. Before a join in which both sides may match several rows, the rows of
    each side that are alike in all that is still needed of them become one row, with their number and its parts of the
    aggregates; a pair of such rows stands for the product of their numbers. The join's size is that of the different
    rows, not of the pairs."""

    ROWS = "_rows"

    def __init__(self, plan: Plan, calls: list[Call], needed: list):
        """calls: the aggregates; needed: expressions whose columns are needed beside them."""
        self.plan, self.needed = plan, needed
        found = {(kind, repr(c.args[0])): c.args[0] for c in calls if c.args and not isinstance(c.args[0], Star) for kind in FOLDED[c.name]}
        self.parts = {k: (f"_part{i}", x) for i, (k, x) in enumerate(found.items())}
        self.have: list[str] = []  # the columns of the joined rows

    @property
    def used(self) -> bool:
        return self.ROWS in self.have

    def columns(self, exprs: list) -> set[str]:
        return {f"{q.label}${k}" for e in exprs for q in _props(e) for k in (q.path[:1] or self.plan.label(q.label).entity.key)}

    @staticmethod
    def merged(kind: str, name: str) -> Column:
        return {"min": F.min, "max": F.max}.get(kind, F.sum)(name)

    def part(self, kind: str, x, have: list[str]) -> Column:
        """The aggregate of rows that have no column of it yet."""
        c, rows = self.plan.col(x), F.col(self.ROWS) if self.ROWS in have else F.lit(1)
        if kind == "count":
            return F.sum(F.when(c.isNotNull(), rows))
        return F.sum(number(c) * rows) if kind == "sum" else F.min(c) if kind == "min" else F.max(c)

    def folded(self, df: DataFrame, labels: set, conds: list, optional: bool) -> DataFrame:
        """df with a row for each combination of what is needed of its labels. optional: an outer join may find none, which is
        null to properties, but perhaps not to expressions of them."""
        have, needed, aggs = df.columns, [*conds, *self.needed], []
        for (kind, _), (name, x) in self.parts.items():
            of = {q.label for q in _props(x)}
            if name in have:
                aggs.append(self.merged(kind, name).alias(name))
            elif of and of <= labels and (isinstance(x, Prop) or not optional):
                aggs.append(self.part(kind, x, have).alias(name))
            else:
                needed.append(x)
        wanted = self.columns(needed)
        keys = [F.col(f"`{c}`") for c in have if c in wanted]
        rows = F.sum(self.ROWS) if self.ROWS in have else F.count(F.lit(1))
        got = df.groupBy(*keys).agg(rows.alias(self.ROWS), *aggs)
        return got if keys else got.where(F.col(self.ROWS) > 0)  # of no rows there is one without keys

    def join(self, df: DataFrame, right: DataFrame, n: str, done: set, conds: list, test: Column | None = None, how: str = "inner") -> DataFrame:
        """df joined to label n's frame; conds: conditions that aren't tested yet."""
        df = self.folded(df, done, conds, False)
        right = self.folded(right, {n}, conds, how == "left").withColumnRenamed(self.ROWS, "_more")
        mine, rows, more = df.columns, F.col(self.ROWS), F.coalesce("_more", F.lit(1))
        df = df.crossJoin(right) if test is None else df.join(right, test, how)
        sums = [name for (kind, _), (name, _) in self.parts.items() if kind in ("count", "sum") and name in df.columns]
        return df.withColumns({self.ROWS: rows * more, **{s: F.col(s) * (more if s in mine else rows) for s in sums}}).drop("_more")

    def total(self, name: str, x) -> Column:
        """The aggregate of the joined rows."""
        got = {}
        for kind in FOLDED[name]:
            at, _ = self.parts[kind, repr(x)]
            got[kind] = self.merged(kind, at) if at in self.have else self.part(kind, x, self.have)
        if name == "avg":
            return got["sum"] / got["count"]  # null where there is none
        (c,) = got.values()
        return F.coalesce(c, F.lit(0 if name == "count" else 0.0)) if name in ("count", "total") else c


def _has_agg(e) -> bool:
    return any(isinstance(x, Call) and x.name in AGGREGATE for x in _walk(e))


def _is_test(e) -> bool:
    """Whether e is true or false by its form."""
    return (isinstance(e, Op) and (e.name not in ("and", "or") or all(map(_is_test, e.args)))) or (isinstance(e, Const) and isinstance(e.value, bool))


def multi_frame(plan: Plan, v: Label) -> DataFrame:
    """The statement layout's star: a row per object with an array of typed values per property. A predicate keeps an
    object if one of the property's values matches, and shows the values that match any predicate on it."""
    e, n = v.entity, v.name
    need = sorted(v.used | v.required | v.absent)
    df = e.df(need, bool(v.required), v.rest)
    out = df.select(F.col(e.key[0]).alias(f"{n}${e.key[0]}"), *[F.col(f"`{p}`").alias(f"{n}${p}") for p in [*need, *["*"] * v.rest]])
    if v.txn and e.df.log is not None:
        out = with_history(out, v, e.df.log)
    for p in sorted(v.required):
        out = out.where(F.size(plan.at(n, p)) > 0)
    for p in sorted(v.absent):
        out = out.where(F.size(plan.at(n, p)) == 0)
    shown: dict[str, list] = {}
    for c in v.conds:
        ps = _props(c)
        if len(ps) == 1 and isinstance(c, Op) and c.name not in ("or", "and", "not") and ps[0].path and not any(isinstance(x, Call | Op) for a in c.args for x in (a if isinstance(a, tuple) else (a,))):
            shown.setdefault(ps[0].path[0], []).append(c)
            out = out.where(st.matches(plan, plan.at(n, ps[0].path[0]), c, "exists"))
        elif isinstance(c, Op) and c.name in ("=", "in") and len(ps) == 1 and not ps[0].path:
            ids = [a for a in c.args if not isinstance(a, Prop)]
            want = [x.id if isinstance(x, Ref) else x.value for a in ids for x in (a if isinstance(a, tuple) else (a,))]
            out = out.where(plan.at(n, e.key[0]).isin([str(x).removeprefix("@") for x in want]))
        else:
            out = out.where(plan.test(c))
    for p, conds in shown.items():
        out = out.withColumn(f"{n}${p}", F.array_sort(F.array_distinct(F.concat(*[st.matches(plan, plan.at(n, p), c, "filter") for c in conds]))))
    return out


def with_history(df: DataFrame, v: Label, log: DataFrame) -> DataFrame:
    """df with, for each property that is asked for, the last transaction that added one of its values (for the object itself:
    one of its statements)."""
    key = v.entity.key[0]
    for p in sorted(v.txn):
        mine = log.where(F.col("op") == "add") if not p else log.where((F.col("op") == "add") & (F.col("predicate") == p))
        have = [c for c in ("ts", "author", "comment") if c in log.columns]
        lost = [F.lit(None).cast("string").alias(c) for c in ("ts", "author", "comment") if c not in have]
        last = mine.groupBy(F.col("subject").alias("_s")).agg(F.max(F.struct(F.col("rev").alias("txn"), *have)).alias("_t"))
        last = last.select("_s", F.struct("_t.*", *lost).alias(f"{v.name}$txn${p}"))
        df = df.join(last, F.col(f"`{v.name}${key}`") == F.col("_s"), "left").drop("_s")
    return df


class Builder:
    """A construct's plan and projection."""

    def __init__(self, c: Construct, catalog: Catalog, spark: SparkSession, binds: dict, fresh=None, outer=None):
        self.c = c
        self.refs: dict[str, str] = {}  # columns that hold references, and their entity
        self.omit: set[str] = set()  # columns left out of a row's JSON where they are null or empty
        self.plan = p = Plan(catalog, spark, binds, fresh, outer)
        self.me = c.label or p.new()
        self.in_outer = self.me in p.outer
        p.label(self.me)
        p.add(c.where, self.me)
        self.me = p.alias.get(self.me, self.me)
        self.nested: list[tuple[Item, Construct]] = []
        self.items: list[Item] = []
        for i in c.items:
            if isinstance(i.value, Construct):
                self.nested.append((i, i.value))
                self.items.append(i)
                # properties of this scope that the nested construct names
                continue
            if isinstance(i.value, Star):
                self.items.append(i)
                continue
            follow = isinstance(i.value, Call) and i.value.name in FOLLOW
            value = i.value if follow else p.bound(i.value, self.me, i.maybe)
            key = i.key if isinstance(i.key, str) or i.key is None else p.bound(i.key, self.me)
            for e in (value, key):
                if not isinstance(e, str) and e is not None and not follow:
                    p.histories(e)
                    for x in _props(e):
                        if x.path:
                            lab = p.label(x.label)
                            seen = x.path[0] in lab.used | lab.required | lab.absent
                            p.mention(x, required=not i.maybe and not seen and not _has_agg(e) and not isinstance(e, Op))
            self.items.append(replace(i, value=value, key=key))
        self.group = p.bound(c.group, self.me) if c.group is not None else None
        if self.group is not None:
            for x in _props(self.group):
                p.mention(x, required=True)
        self.order = [(p.bound(e, self.me, True), d) for e, d in c.order]
        for e, _ in self.order:
            for x in _props(e):
                p.mention(x, required=False)
        # what nested constructs need of this scope
        self.children: dict[int, Builder] = {}

    def result(self) -> DataFrame:
        c, p = self.c, self.plan
        refers = any(True for _ in p.labels[self.me].required | p.labels[self.me].used) or p.labels[self.me].conds or p.labels[self.me].kinds or p.labels[self.me].absent if not self.in_outer else True
        constant = not refers and len(p.labels) == 1 and not self.nested and not c.label and not any(isinstance(i.value, Star) or _props(i.value) for i in self.items)
        if constant:
            df = p.spark.range(1).drop("id")
            return df.select(*self.names([p.col(i.value) for i in self.items]))
        for i in c.items:
            if isinstance(i.value, Star):
                p.bind()
                e = p.label(self.me).entity
                if e.multi:
                    p.label(self.me).rest = True
                else:
                    p.label(self.me).used |= set(e.props)
        self.prepare_nested()
        p.fold = self.foldable()
        df = p.whole(self.me)
        if self.group is not None:
            return self.page(self.grouped(df), None)
        plain = [i for i in self.items if not (isinstance(i.value, Construct | Star)) and _has_agg(i.value)]
        if plain and len(plain) == len(self.items):
            return df.agg(*self.names([p.col(i.value, True) for i in plain]))
        if plain:
            total = df.agg(*[p.col(i.value, True).alias(f"_agg{k}") for k, i in enumerate(plain)])
            df = df.crossJoin(F.broadcast(total))  # one row
        df, cols = self.join_nested(df)
        out, names = [], []
        for k, i in enumerate(self.items):
            if isinstance(i.value, Star):
                e = p.label(self.me).entity
                have = {x.key for x in self.items if isinstance(x.key, str)}
                if i.key != "*":
                    out.append(F.struct(p.id(self.me).alias(ID), p.at(self.me, "*").alias(REST)) if e.multi else F.struct(*[p.col(Prop((q,), self.me)).alias(q) for q in e.props]))
                    names.append(i.key)
                    continue
                if e.key and c.kind == "dict" and ID not in have:
                    out.append(p.id(self.me))
                    names.append(ID)
                if e.multi:
                    shown = [x.value.path[0] for x in self.items if isinstance(x.value, Prop) and x.value.path and x.value.label == self.me]
                    out.append(F.map_filter(p.at(self.me, "*"), lambda k, _, shown=shown: ~k.isin(shown)) if shown else p.at(self.me, "*"))
                    names.append(REST)
                    continue
                for q in e.props:
                    if q not in have:
                        out.append(p.col(Prop((q,), self.me)))
                        names.append(q)
                continue
            if i in plain:
                out.append(F.col(f"_agg{plain.index(i)}"))
            elif isinstance(i.value, Construct):
                out.append(cols[id(i)])
            elif isinstance(i.value, Call) and i.value.name in FOLLOW:
                df, col = self.followed(df, i.value, k)
                out.append(col)
            else:
                out.append(self.shaped(i, p.col(i.value)))
            names.append(i.key)
        for x, name in zip(self.output_items(out), self.column_names(names), strict=True):
            if isinstance(x, tuple):
                entity = p.label(x[0]).entity
                if not entity.multi and x[1] in entity.refs:
                    self.refs[name] = entity.refs[x[1]]
        self.omit = {n for i, n in zip(self.items, self.column_names(names), strict=False) if i.omit_null} if len(self.items) == len(names) else {i.key for i in self.items if i.omit_null}
        keyed = [(i, col) for (i, col) in zip(self.items, out, strict=False) if not isinstance(i.key, str) and i.key is not None]
        if p.many and not plain and p.label(self.me).entity.key and not self.in_outer:
            return self.page(*self.rooted(df, out, names))
        if keyed:
            pairs = [F.struct(p.col(i.key).cast("string").alias("key"), col.alias("value")) for i, col in keyed]
            if c.merge_all:  # the last of a key stays; pages come before
                df = self.page(self.sorted(df), None) if c.offset or c.limit is not None else df
                df = df.withColumn("_p", F.explode(F.array(*pairs))).where("_p.key is not null")
                w = Window.partitionBy("_p.key").orderBy(*self.last_first())
                return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("_p.key", "_p.value")
            df = self.sorted(df).select(F.explode(F.array(*pairs)).alias("_p")).where("_p.key is not null")
            return self.page(df.select("_p.key", "_p.value"), None)
        if c.merge_all:
            return self.merged(df, out, self.column_names(names))
        df = self.sorted(df)
        return self.page(df.select(*[x.alias(n) for x, n in zip(out, self.column_names(names), strict=True)]), None)

    def foldable(self) -> Fold | None:
        """How the aggregates follow from those of parts of the rows, if nothing else is shown."""
        p = self.plan
        shown = [i.value for i in self.items if self.group is None or i.value != self.group]
        if self.in_outer or any(isinstance(v, Construct | Star) or not _has_agg(v) for v in shown):
            return None
        calls, beside = [], []

        def split(e) -> None:
            if isinstance(e, Call) and e.name in AGGREGATE:
                calls.append(e)
            elif isinstance(e, Op | Call):
                for a in e.args:
                    for x in a if isinstance(a, tuple) else (a,):
                        split(x)
            else:
                beside.append(e)

        for v in shown:
            split(v)
        if any(c.name not in FOLDED or AGGREGATE[c.name] is not BUILT_IN[c.name] for c in calls):
            return None
        beside += [self.group] * (self.group is not None) + [e for e, _ in self.order] + [left for left, _, _ in p.semis]
        for node, call, _ in p.within:
            beside += [y for x in (node, call.args[0]) if isinstance(x, Prop) for y in (x, Prop((), x.label))]
        return Fold(p, calls, beside)

    def output_items(self, out: list) -> list:
        """For each output column the (label, property) it shows, or None."""
        found, p = [], self.plan
        for i in self.items:
            if isinstance(i.value, Star):
                e = p.label(self.me).entity
                have = {x.key for x in self.items if isinstance(x.key, str)}
                if i.key != "*":
                    found.append(None)
                    continue
                found += [None] * bool(e.key and self.c.kind == "dict" and ID not in have)
                found += [None] if e.multi else [(self.me, q) for q in e.props if q not in have]
            else:
                found.append((i.value.label, i.value.path[0]) if isinstance(i.value, Prop) and i.value.path else None)
        return found + [None] * (len(out) - len(found))

    def last_first(self) -> list[Column]:
        """The opposite of the result's order."""
        p, keys = self.plan, []
        for e, desc in self.order:
            x = p.col(e) if not (isinstance(e, Prop) and e.path) else p.at(e.label, e.path[0])
            keys.append(x.asc_nulls_last() if desc else x.desc_nulls_last())
        return keys + [p.at(self.me, k).desc_nulls_last() for k in p.label(self.me).entity.key]

    def merged(self, df: DataFrame, out: list[Column], names: list[str]) -> DataFrame:
        """MERGEALL: all results as one. Of objects, for each key the last one's value (with omitnull, of those that have
        one); of lists, all their items, in order."""
        if self.c.offset or self.c.limit is not None:
            df = self.page(self.sorted(df), None)
        order = self.last_first()
        if self.c.kind != "dict":
            items = F.array(*[x.cast("string") for x in out]) if len(out) > 1 else F.array(out[0])
            # the sort's partitions are in order, and so are their rows' numbers
            rows = self.sorted(df).select(items.alias("i")).withColumn("n", F.monotonically_increasing_id())
            got = rows.agg(F.array_sort(F.collect_list(F.struct("n", "i"))).alias("x"))
            return got.select(F.flatten(F.transform("x", lambda x: x["i"])).alias("value"))
        groups = [[n for n in names if n not in self.omit], *[[n] for n in names if n in self.omit]]
        parts = []
        for group in filter(None, groups):
            cols = [x.alias(n) for x, n in zip(out, names, strict=True) if n in group]
            rows = df.where(cols[0].isNotNull()) if group[0] in self.omit else df
            last = rows.orderBy(*order).select(*cols).limit(1)
            parts.append(last.agg(*[F.first(F.col(f"`{n}`")).alias(n) for n in group]))
        return reduce(lambda x, y: x.crossJoin(F.broadcast(y)), parts).select(*[f"`{n}`" for n in names])  # one row each

    def column_names(self, names: list) -> list[str]:
        if self.c.kind == "list":
            return [f"c{k}" for k in range(len(names))]
        if self.c.kind == "value":
            return ["value"] if len(names) == 1 else [f"value{k + 1}" for k in range(len(names))]
        m = {v: k for k, v in (self.c.name_map or {}).items() if isinstance(v, str)}
        return [m.get(n, n) if isinstance(n, str) else n for n in names]

    def names(self, cols: list[Column]) -> list[Column]:
        return [x.alias(n) for x, n in zip(cols, self.column_names([i.key for i in self.items]), strict=True)]

    def shaped(self, i: Item, x: Column) -> Column:
        return F.when(x.isNull(), F.array()).otherwise(F.array(x)) if i.force_list and not self._is_array(i) else x

    def _is_array(self, i: Item) -> bool:
        e = i.value
        return isinstance(e, Prop) and bool(e.path) and self.plan.label(e.label).entity.multi

    def sorted(self, df: DataFrame) -> DataFrame:
        if not self.order:
            return df
        p = self.plan
        keys = []
        for e, desc in self.order:
            x = p.col(e) if not (isinstance(e, Prop) and e.path) else p.at(e.label, e.path[0])
            if p.multi(e) and not (isinstance(e, Prop) and not e.path):  # values compare as lists; none is below all
                x = F.when(F.size(x) > 0, F.transform(x, st.sort_key))
            keys.append(x.desc_nulls_last() if desc else x.asc_nulls_first())
        ent = p.label(self.me).entity
        keys += [p.at(self.me, k).asc_nulls_first() for k in ent.key]
        return df.orderBy(*keys)

    def page(self, df: DataFrame, order) -> DataFrame:
        if order:
            df = df.orderBy(*order)
        if self.c.offset:
            df = df.offset(self.c.offset)
        return df.limit(self.c.limit) if self.c.limit is not None else df

    def rooted(self, df: DataFrame, out: list[Column], names: list):
        """One row per root object; other labels' outputs as lists, in the order of their values."""
        p, ent = self.plan, self.plan.label(self.me).entity
        ours = []
        for i, x in zip(self.items, out, strict=False):
            other = {q.label for q in _props(i.value)} - {self.me} if not isinstance(i.value, Construct | Star) else set()
            of_values = other and p.multi(i.value) and not (isinstance(i.value, Prop) and not i.value.path)
            ours.append(F.array_sort(F.flatten(F.collect_list(x))) if of_values else F.array_sort(F.collect_list(x)) if other else F.first(x))
        if any(isinstance(i.value, Star) for i in self.items):
            ours = [F.first(x) for x in out]
        keys = [p.at(self.me, k) for k in ent.key]
        order = []
        for k, (e, desc) in enumerate(self.order):
            x = F.min(p.col(e)).alias(f"_o{k}")
            order.append((x, F.col(f"_o{k}").desc_nulls_last() if desc else F.col(f"_o{k}").asc_nulls_first()))
        got = df.groupBy(*keys).agg(*[x.alias(n) for x, n in zip(ours, self.column_names(names), strict=True)], *[x for x, _ in order])
        if order:
            got = got.orderBy(*[o for _, o in order], *keys)
        return got.select(*[f"`{n}`" for n in self.column_names(names)]), None

    def grouped(self, df: DataFrame) -> DataFrame:
        p = self.plan
        key = p.col(self.group) if not (isinstance(self.group, Prop) and self.group.path) else self.col_out(self.group)
        if isinstance(self.group, Prop) and self.group.path and p.label(self.group.label).entity.multi:
            at = f"{self.group.label}${self.group.path[0]}"
            df = df.withColumn("_each", F.explode(p.at(self.group.label, self.group.path[0])))
            df = df.withColumn(at, F.array("_each"))
            key = st.text_of(F.col("_each"))
        out = []
        for i in self.items:
            if i.value == self.group:
                out.append(None)
            elif _has_agg(i.value):
                if any(isinstance(x, Call) and x.name == "count" and x.args and x.args[0] == self.group for x in _walk(i.value)):
                    out.append(p.count_rows())
                else:
                    out.append(p.col(i.value, True))
            elif p.multi(i.value) and not (isinstance(i.value, Prop) and not i.value.path):
                out.append(F.array_sort(F.flatten(F.collect_list(p.values(i.value)))))
            else:
                out.append(F.array_sort(F.collect_list(p.col(i.value))))
        names = self.column_names([i.key for i in self.items])
        order = []
        for k, (e, desc) in enumerate(self.order):
            order.append((F.min(p.col(e)).alias(f"_o{k}"), F.col(f"_o{k}").desc_nulls_last() if desc else F.col(f"_o{k}").asc_nulls_first()))
        got = df.groupBy(key.alias("_g")).agg(*[x.alias(n) for x, n in zip(out, names, strict=True) if x is not None], *[x for x, _ in order] or ([F.count(F.lit(1)).alias("_c")] if all(x is None for x in out) else []))
        if order:
            got = got.orderBy(*[o for _, o in order], "_g")
        return got.select(*[F.col("_g" if x is None else f"`{n}`").alias(n) for x, n in zip(out, names, strict=True)])

    def col_out(self, e) -> Column:
        return self.plan.col(e)

    def followed(self, df: DataFrame, call: Call, k: int):
        p = self.plan
        start = p.bound(call.args[0], self.me)
        if not isinstance(start, Prop):
            _, nodes = p.nodes(call, start)
            return df.crossJoin(F.broadcast(nodes.agg(F.array_sort(F.collect_list("node")).alias(f"_f{k}")))), F.col(f"_f{k}")  # one row
        got = p.pairs(call, start.label, df).groupBy("start").agg(F.array_sort(F.collect_list("node")).alias(f"_f{k}"))
        return df.join(got, p.key(start.label) == F.col("start"), "left").drop("start"), F.col(f"_f{k}")

    # nested constructs

    def prepare_nested(self) -> None:
        """Adds to this scope what nested constructs read of it."""
        p = self.plan
        for i, c in self.nested:
            inside = {x.label for j in c.items if not isinstance(j.value, Construct | Star) for x in _props(j.value) if x.label}
            own = p.alias.get(c.label, c.label)
            if own in p.labels or (c.where is None and c.label is None):
                at = own or self.me  # rows of a label of this scope, or of this object
                for j in c.items:
                    if isinstance(j.value, Star):
                        p.label(at).rest = True
                    elif not isinstance(j.value, Construct):
                        for x in _props(p.bound(j.value, at)):
                            p.mention(x, required=False)
            else:
                for x in inside & set(p.labels):
                    p.label(x)
                p.bind()
                child = Builder(c, p.catalog, p.spark, p.binds, p.fresh, p.labels | p.outer)
                self.children[id(i)] = child
                for cond, _ in child.plan.joins:
                    for x in _props(cond):
                        if x.label in p.labels:
                            p.mention(x, required=False)

    def struct(self, c: Construct, at: str) -> Column:
        p = self.plan
        out = []
        for j in c.items:
            if isinstance(j.value, Star):
                e = p.label(at).entity
                if e.multi:
                    out += [p.id(at).alias(ID), p.at(at, "*").alias(REST)]
                    continue
                out += [p.id(at).alias(ID), *[p.col(Prop((q,), at)).alias(q) for q in e.props if f"{at}${q}"]]
            else:
                out.append(p.col(p.bound(j.value, at)).alias(j.key or f"c{len(out)}"))
        return F.struct(*out)

    def join_nested(self, df: DataFrame):
        p, cols = self.plan, {}
        for n, (i, c) in enumerate(self.nested):
            own = p.alias.get(c.label, c.label)
            if own in p.labels and own != self.me:
                x = self.struct(c, own)
                keys = p.label(self.me).entity.key
                if p.many:
                    mine = df.where(p.at(own, p.label(own).entity.key[0]).isNotNull()).groupBy(*[p.at(self.me, k).alias(f"_k{n}_{k}") for k in keys]).agg(F.array_sort(F.collect_set(x)).alias(f"_n{n}"))
                    df = df.join(mine, reduce(lambda a, b: a & b, [p.at(self.me, k) == F.col(f"_k{n}_{k}") for k in keys]), "left")
                    cols[id(i)] = F.col(f"_n{n}")
                else:
                    cols[id(i)] = F.array(x) if i.force_list else x
            elif id(i) not in self.children:
                cols[id(i)] = self.struct(c, self.me)
            else:
                df, cols[id(i)] = self.children[id(i)].as_list(df, p, n)
        return df, cols

    def as_list(self, df: DataFrame, outer: Plan, n: int):
        """This construct's rows as a list, joined to the outer rows they belong to; all rows if they depend on none."""
        p = self.plan
        for i in self.c.items:
            if isinstance(i.value, Star):
                p.bind()
                p.label(self.me).rest = True
                if not p.label(self.me).entity.multi:
                    p.label(self.me).used |= set(p.label(self.me).entity.props)
        if p.paths and p.paths[0][1].args[0].label in p.outer:
            to, call = p.paths.pop(0)
            start = call.args[0].label
            p.label(to).entity = p.label(to).entity or p.outer[start].entity
            rows = p.whole(self.me)
            pairs = p.pairs(call, start).select(F.col("start").alias("_s"), F.col("node").alias("_t"))
            rows = rows.join(pairs, p.key(to) == F.col("_t"))
            x = self.row_struct(p)
            mine = rows.groupBy("_s").agg(F.array_sort(F.collect_list(x)).alias(f"_n{n}"))
            return df.join(mine, outer.key(start) == F.col("_s"), "left").drop("_s"), F.col(f"_n{n}")
        rows = p.whole(self.me)
        x = self.row_struct(p)
        if not p.correlated:
            one = rows.agg(F.array_sort(F.collect_list(x)).alias(f"_n{n}"))
            return df.crossJoin(one), F.col(f"_n{n}")  # one row, whose size Spark knows before it sends it
        on, keys = [], []
        for k, (cond, _) in enumerate(p.correlated):
            if not (isinstance(cond, Op) and cond.name == "=" and len({q.label for q in _props(cond)}) == 2):
                raise QueryError("a nested construct joins its outer object by equality")
            a, b = cond.args
            if _props(a)[0].label in p.outer:
                a, b = b, a  # a is of this construct, b of the outer one
            if p.multi(cond):
                return self.by_value(df, rows, outer, a, b, x, n)
            mine, other = p.key_pair(a, b)
            keys.append(mine.alias(f"_j{n}_{k}"))
            on.append((f"_j{n}_{k}", other))
        mine = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(x)).alias(f"_n{n}"))
        return df.join(mine, reduce(lambda a, b: a & b, [F.col(k) == o for k, o in on]), "left").drop(*[k for k, _ in on]), F.col(f"_n{n}")

    def by_value(self, df: DataFrame, rows: DataFrame, outer: Plan, a, b, x: Column, n: int):
        """as_list() where one value of either side is equal."""
        p = self.plan
        if len(p.correlated) > 1:
            raise QueryError("a nested construct joins its outer object by one property of several values")
        key = lambda q, e: F.explode(F.array_distinct(F.transform(q.values(e), p.join_key)))
        keys = outer.keys_of({q.label for q in _props(b)})
        ours = df.select(*[F.col(f"`{k}`").alias(f"_o{n}_{i}") for i, k in enumerate(keys)], key(outer, b).alias("_k")).distinct()
        mine = rows.select(key(p, a).alias("_k"), x.alias("_x"))
        got = ours.join(mine, "_k").groupBy(*[f"_o{n}_{i}" for i in range(len(keys))]).agg(F.array_sort(F.collect_set("_x")).alias(f"_n{n}"))
        on = reduce(lambda u, w: u & w, [F.col(f"`{k}`") == F.col(f"_o{n}_{i}") for i, k in enumerate(keys)])
        return df.join(got, on, "left").drop(*[f"_o{n}_{i}" for i in range(len(keys))]), F.col(f"_n{n}")

    def row_struct(self, p: Plan) -> Column:
        out = []
        for j in self.items:
            if isinstance(j.value, Star):
                e = p.label(self.me).entity
                if e.multi:
                    out += [p.id(self.me).alias(ID), p.at(self.me, "*").alias(REST)]
                    continue
                out += [p.id(self.me).alias(ID), *[p.col(Prop((q,), self.me)).alias(q) for q in e.props]]
            else:
                out.append(p.col(j.value).alias(j.key or f"c{len(out)}"))
        return F.struct(*out)


def named(c: Construct, outer: dict) -> Construct:
    """The construct with the names that NAMEMAP abbreviates in full; nested constructs inherit them."""
    m = {**outer, **(c.name_map or {})}
    if not m:
        return c

    def full(e):
        if isinstance(e, Construct):
            return named(e, m)
        if isinstance(e, Prop):
            return Prop(tuple(m.get(x, x) for x in e.path), e.label)
        if isinstance(e, FilterSet):
            return FilterSet(e.label, _map(e.where, full) if e.where is not None else None)
        return e

    every = lambda e: e if e is None or isinstance(e, str) else full(e) if isinstance(e, Construct) else _map(e, full)
    items = [replace(i, value=every(i.value), key=every(i.key)) for i in c.items]
    return replace(c, items=items, where=every(c.where), group=every(c.group), order=[(every(e), d) for e, d in c.order], name_map=m)


def with_ids(c: Construct) -> Construct:
    """The construct with the ids of its objects, and of those in it."""
    items = [replace(i, value=with_ids(i.value)) if isinstance(i.value, Construct) else i for i in c.items]
    if c.kind == "dict" and c.group is None and all(isinstance(i.key, str) for i in items) and not any(i.key in (ID, "*") for i in items):
        items = [Item(ID, Prop((ID,))), *items]
    return replace(c, items=items)


def _built(spark: SparkSession, catalog: Catalog, text: str, binds: dict | None, for_update: bool) -> tuple[Builder, DataFrame]:
    c = named(parse(text), {})
    depth, c.depth = c.depth, 0
    b = Builder(with_ids(c) if for_update else c, catalog, spark, binds or {})
    df = b.result()
    return b, expand(df, catalog, depth, b.refs) if depth else df


def query(spark: SparkSession, catalog: Catalog, text: str, binds: dict | None = None, for_update: bool = False) -> DataFrame:
    """The result of a query as a DataFrame. DEPTH expands references of named and ``*`` outputs into structs; for_update
    adds the objects' ids."""
    return _built(spark, catalog, text, binds, for_update)[1]


def query_json(spark: SparkSession, catalog: Catalog, text: str, binds: dict | None = None, for_update: bool = False) -> DataFrame:
    """The result as column ``json``, a text per row. Here omitnull leaves a key out where it has no value, typed values are
    written as such, and lists of one value that weren't stored as lists as that value."""
    b, df = _built(spark, catalog, text, binds, for_update)

    def text_of(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind == st.VALUES:
            return st.json_of(c)
        if kind == f"map<string,{st.VALUES}>":
            pairs = F.transform(F.map_entries(c), lambda e: F.concat(st.quoted(e["key"]), F.lit(":"), st.json_of(e["value"])))
            return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
        whole = F.to_json(F.struct(c.alias("c")), {"ignoreNullFields": "false"})
        return F.when(c.isNotNull(), F.substring(whole, F.lit(6), F.length(whole) - 6))

    kinds, cells = dict(df.dtypes), []
    for name in df.columns:
        cell = text_of(name, kinds[name])
        left_out = cell.isNull() | cell.isin("null", "[]") if name in b.omit else F.lit(False)
        cell = F.coalesce(cell, F.lit("null"))
        cells.append(F.when(~left_out, cell if b.c.kind != "dict" else F.concat(st.quoted(F.lit(name)), F.lit(":"), cell)))
    open_, close = {"dict": "{}", "list": "[]", "value": ("", "")}[b.c.kind]
    body = F.array_join(F.array(*cells), ",")
    return df.select(F.concat(F.lit(open_), body, F.lit(close)).alias("json"))


def explain(spark: SparkSession, catalog: Catalog, text: str, binds: dict | None = None, mode: str = "formatted") -> str:
    """The query's syntax tree and Spark's plan."""
    import contextlib
    import io

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        query(spark, catalog, text, binds).explain(mode)
    return f"{printed(parse(text))}\n\n{out.getvalue()}"


def printed(e, level: int = 0) -> str:
    """A syntax tree as indented text."""
    pad = "  " * level
    if isinstance(e, Construct):
        own = [f"{k}={v!r}" for k, v in (("label", e.label), ("limit", e.limit), ("offset", e.offset), ("depth", e.depth), ("mergeall", e.merge_all), ("namemap", e.name_map)) if v]
        lines = [f"{pad}{e.kind} {' '.join(own)}".rstrip()]
        lines += [f"{pad}  item {i.key if isinstance(i.key, str) or i.key is None else printed(i.key).strip()}{' maybe' * i.maybe}{' omitnull' * i.omit_null}{' list' * i.force_list}\n{printed(i.value, level + 2)}" for i in e.items]
        lines += [f"{pad}  {k}\n{printed(v, level + 2)}" for k, v in (("where", e.where), ("group by", e.group)) if v is not None]
        lines += [f"{pad}  order by{' desc' * d}\n{printed(x, level + 2)}" for x, d in e.order]
        return "\n".join(lines)
    if isinstance(e, Op | Call):
        parts = [x for a in e.args for x in (a if isinstance(a, tuple) else (a,))]
        return "\n".join([f"{pad}{e.name}", *[printed(x, level + 1) for x in parts]])
    if isinstance(e, FilterSet):
        return f"{pad}filter set {e.label or ''}".rstrip() + (f"\n{printed(e.where, level + 1)}" if e.where is not None else "")
    if isinstance(e, Prop):
        return pad + ".".join([*(["?" + e.label] if e.label else []), *e.path])
    return pad + ("*" if isinstance(e, Star) else f"@{e.id}" if isinstance(e, Ref) else f":{e.name}" if isinstance(e, Bind) else repr(e.value))


def expand(df: DataFrame, catalog: Catalog, depth: int, refs: dict[str, str]) -> DataFrame:
    """Columns that hold references ('@entity/key'), by name with their entity, become structs of the object, lists of them
    lists of structs, depth levels deep. Each column is one left join; depth is a number in the query, so the plan is bounded."""
    if any(e.multi for e in catalog.entities.values()):
        return expand_values(df, catalog, depth)

    def objects(to: str, left: int) -> DataFrame:
        e = catalog.entities[to]
        ref = lambda p: F.when(F.col(p).isNotNull(), F.concat(F.lit(f"@{e.refs[p]}/"), F.col(p).cast("string"))).alias(p)
        rows = e.df.select(e.id_of(F.col).alias("id"), *[ref(p) if p in e.refs else F.col(p) for p in e.props])
        return expand(rows, catalog, left, e.refs) if left else rows

    kinds = dict(df.dtypes)
    for c, to in refs.items():
        if kinds.get(c) not in ("string", "array<string>"):
            continue
        o = objects(to, depth - 1)
        o = o.select(F.concat(F.lit("@"), F.col("id")).alias("_ref"), F.struct(*[f"`{x}`" for x in o.columns]).alias("_object"))
        cols = [f"`{x}`" for x in df.columns]
        if kinds[c] == "string":
            df = df.join(o, F.col(f"`{c}`") == F.col("_ref"), "left").withColumn(c, F.col("_object")).select(*cols)
        else:
            df = st.stored(df.withColumn("_row", F.monotonically_increasing_id()))
            each = df.select("_row", F.posexplode(f"`{c}`").alias("_at", "_each")).join(o, F.col("_each") == F.col("_ref"), "left")
            got = each.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_at", "_object"))).alias("_list"))
            df = df.join(got, "_row", "left").withColumn(c, F.coalesce(F.transform("_list", lambda x: x["_object"]), F.array())).select(*cols)
    return df


def expand_values(df: DataFrame, catalog: Catalog, depth: int) -> DataFrame:
    """Over statements: columns of values become JSON texts in which references to objects that are there are these objects."""
    (e,) = [x for x in catalog.entities.values() if x.multi]
    objects = st.to_objects(e.df.statements)
    for _ in range(depth - 1):
        objects = st.to_objects(e.df.statements, within=objects)
    objects = st.stored(objects.select(F.col("id").alias("_i"), F.col("object").alias("_t")))
    for c in [n for n, kind in df.dtypes if kind == st.VALUES]:
        cols = [f"`{x}`" for x in df.columns]
        df = st.stored(df.withColumn("_row", F.monotonically_increasing_id()))
        each = df.select("_row", F.posexplode(f"`{c}`").alias("_at", "_v")).join(objects, (F.col("_v.t") == "R") & (F.col("_v.o") == F.col("_i")), "left")
        got = each.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("_t", st.json_value(F.col("_v"))).alias("j"), F.col("_v.list").alias("list")))).alias("_l"))
        texts = F.transform("_l", lambda x: x["j"])
        text = F.when((F.size("_l") == 1) & ~F.get("_l", F.lit(0))["list"], F.get(texts, F.lit(0))).otherwise(F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]")))
        df = df.join(got, "_row", "left").withColumn(c, text).select(*cols)
    return df


__all__ = ["Catalog", "QueryError", "explain", "query", "query_json"]
