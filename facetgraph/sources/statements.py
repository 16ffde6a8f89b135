"""The statement layout: schemaless objects as rows (subject, predicate, object, objecttype, context, listpos).

A value is (text, type): 'L' text, 'R' reference, 'number', 'boolean', 'null', or a language or datatype. Equality is
exact on both. Objects are rebuilt by one grouping of the statements of the properties that a query names.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Entity
from .tables import stored

SCHEMA = "subject string, predicate string, object string, objecttype string, context string, listpos array<int>"
COLUMNS = ["subject", "predicate", "object", "objecttype", "context", "listpos"]
VALUE = ["subject", "predicate", "object", "objecttype"]
REF = re.compile(r"@((?:::)?[^\s@]+)$")
# Prefixes of generated ids.
EMBEDDED, ANONYMOUS = "_:j:e:object:", "_:j:t:object:"
#: The empty list.
NIL = "rdf:nil"


def typed(v, ref=REF) -> tuple[str, str]:
    """(text, type) of a JSON scalar."""
    if v is None:
        return "null", "null"
    if isinstance(v, bool):
        return ("true" if v else "false"), "boolean"
    if isinstance(v, int):
        return str(v), "integer"
    if isinstance(v, float):
        return repr(v), "double"
    m = ref.match(v)
    return (m[1], "R") if m else (v, "L")


def from_json(objects: list | dict, ref=REF, names: dict | None = None, context: str = "", prefix: str = "") -> list[tuple]:
    """Statements of JSON objects, depth first. Objects without id get generated ones, after ``prefix``; lists keep positions;
    an object {datatype, value} is a typed literal; {"@context"-like} ``context`` sets the statements' context."""
    names = {"id": "id", **{v: k for k, v in (names or {}).items()}}
    out: dict[tuple, list[int]] = {}
    counts: dict[str, int] = {}

    def put(s, p, o, t, ctx, pos):
        at = out.setdefault((s, p, o, t, ctx), [])
        if pos is not None:
            at.append(pos)

    def value(s, p, v, ctx, pos):
        if isinstance(v, dict):
            if set(v) <= {"datatype", "value", "context"} and "value" in v:
                t = v.get("datatype", "L")
                if t == "json":
                    return put(s, p, *typed(v["value"], re.compile(r"(?!)")), v.get("context", ctx), pos)
                return put(s, p, str(v["value"]), t, v.get("context", ctx), pos)
            return put(s, p, obj(v, ctx, s), "R", ctx, pos)
        if isinstance(v, list):
            if pos is None and not v:
                return put(s, p, NIL, "R", ctx, None)
            if pos is None:
                for i, x in enumerate(v):
                    value(s, p, x, ctx, i)
                return None
            counts[s] = counts.get(s, 0) + 1
            inner = f"{EMBEDDED}{s}:list:{counts[s]}"
            put(s, p, inner, "R", ctx, pos)
            for i, x in enumerate(v):
                value(inner, "rdf:_n", x, ctx, i)
            return None
        return put(s, p, *typed(v, ref), ctx, pos)

    def obj(o, ctx, parent=None) -> str:
        key = next((k for k in o if names.get(k, k) == "id"), None)
        if key is not None:
            s = str(o[key]).removeprefix("@")
        else:
            base = f"{EMBEDDED}{parent}" if parent else f"{ANONYMOUS}{prefix}".rstrip(":")
            counts[base] = counts.get(base, 0) + 1
            s = f"{base}:{counts[base]}"
        ctx = o.get("context", ctx) if isinstance(o.get("context", ""), str) else ctx
        for k, v in o.items():
            if k not in (key, "context"):
                value(s, names.get(k, k), v, ctx, None)
        return s

    for o in objects if isinstance(objects, list) else [objects]:
        obj(o, context)
    return [(*k, v or None) for k, v in out.items()]


def frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA)


def scan(df: DataFrame, subject=None, predicate=None, obj=None, objecttype=None, context=None, as_quad: bool = True, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """Statements that match; None matches all. An object without its type is a literal. as_quad false: a statement in
    several contexts once, with the least."""
    for c, v in (("subject", subject), ("predicate", predicate), ("object", obj), ("objecttype", objecttype), ("context", context)):
        if v is not None:
            df = df.where(F.col(c) == v)
    if obj is not None and objecttype is None:
        df = df.where("objecttype <> 'R'")
    if not as_quad:
        df = df.groupBy(*VALUE).agg(F.min("context").alias("context"), F.first("listpos").alias("listpos"))
    if limit is not None or offset:
        df = df.orderBy(*VALUE, "context")
        df = df.offset(offset or 0)
        df = df.limit(limit) if limit is not None else df
    return df


def decoded(df: DataFrame) -> DataFrame:
    """Statements with their values as native columns: ``text``, ``number``, ``truth`` and ``ref``, of which one isn't null
    (none for the null value)."""
    t, o = F.col("objecttype"), F.col("object")
    numeric = t.isin("integer", "double", "decimal", "int", "float")
    other = ~numeric & ~t.isin("boolean", "null", "R")
    return df.withColumns({"text": F.when(other, o), "number": F.when(numeric, o.try_cast("double")), "truth": F.when(t == "boolean", o == "true"), "ref": F.when(t == "R", o)})


def filtered(df: DataFrame, **slots) -> DataFrame:
    """scan() by values: a slot is a column's name and a value; an ``object`` of Python's types matches text and type."""
    if "object" in slots and "objecttype" not in slots:
        slots["object"], slots["objecttype"] = typed(slots["object"])
    return decoded(scan(df, slots.get("subject"), slots.get("predicate"), slots.get("object"), slots.get("objecttype"), slots.get("context")))


def union(*stores: DataFrame) -> DataFrame:
    """Several stores read as one, each statement once."""
    out = stores[0]
    for s in stores[1:]:
        out = out.unionByName(s)
    return out.groupBy(*VALUE, "context").agg(F.first("listpos", ignorenulls=True).alias("listpos"))


#: Where a value without a list position stands.
UNLISTED = 1 << 30
VALUES = "array<struct<pos:int,o:string,t:string,list:boolean>>"


def value(o: Column, t: Column) -> Column:
    return F.struct(F.lit(UNLISTED).alias("pos"), o.alias("o"), t.alias("t"), F.lit(False).alias("list"))


def value_of(c: Column) -> Column:
    """A native column as a typed value; null is the null value."""
    kind = F.typeof(c)
    t = F.when(kind.isin("double", "float") | kind.startswith("decimal"), "double").when(kind.isin("tinyint", "smallint", "int", "bigint"), "integer").when(kind == "boolean", "boolean").otherwise("L")
    return value(F.coalesce(c.cast("string"), F.lit("null")), F.when(c.isNull(), "null").otherwise(t))


def constant(v) -> Column:
    o, t = typed(v, re.compile(r"(?!)"))
    return value(F.lit(o), F.lit(t))


def spread(df: DataFrame) -> DataFrame:
    """subject, predicate, v: a row per value; an item that a list repeats stands at each of its positions."""
    x = df.select("subject", "predicate", "object", "objecttype", F.explode_outer("listpos").alias("pos"))
    v = F.struct(F.coalesce("pos", F.lit(UNLISTED)).alias("pos"), F.col("object").alias("o"), F.col("objecttype").alias("t"), F.col("pos").isNotNull().alias("list"))
    return x.select("subject", "predicate", v.alias("v"))


def star(df: DataFrame, props: list[str], required: bool = False, rest: bool = False) -> DataFrame:
    """A row per subject, a column per property: the array of its values, in list order. One scan and one shuffle,
    whatever the number of properties. required: one of the properties must be there, so that only their statements are
    read; else subjects without any of them stay, with empty arrays. rest: column ``*``, the map of all properties."""
    rows = df.where(F.col("predicate").isin(props)) if required and not rest else df
    if not rest and not required:  # other statements only say that their subject is there
        rows = rows.withColumn("listpos", F.when(F.col("predicate").isin(props), F.col("listpos")))
    each = lambda p: F.array_sort(F.collect_set(F.when(F.col("predicate") == p, F.col("v"))))
    cols = [each(p).alias(f"_{i}") for i, p in enumerate(props)]
    if rest:
        cols.append(F.array_sort(F.collect_set(F.struct(F.col("predicate").alias("p"), "v"))).alias("_all"))
    got = spread(rows).groupBy("subject").agg(*cols or [F.count(F.lit(1)).alias("_c")])
    out = [F.col(f"_{i}").alias(p) for i, p in enumerate(props)]
    if rest:
        names = F.array_distinct(F.transform("_all", lambda x: x["p"]))
        of = lambda n: F.transform(F.filter("_all", lambda x: x["p"] == n), lambda x: x["v"])
        out.append(F.map_from_arrays(names, F.transform(names, of)).alias("*"))
    return got.select("subject", *out)


def entity(df: DataFrame, name: str = "statements", log: DataFrame | None = None) -> Entity:
    """Statements as an entity of the query language; ``type`` is a property like any other. log: their history, which the
    transaction functions read."""
    return Entity(name, _Star(df, log), ("subject",), multi=True)


class _Star:
    """Statements whose star is taken for the properties that a query names."""

    def __init__(self, df: DataFrame, log: DataFrame | None = None):
        self.statements, self.log = df, log

    @property
    def columns(self) -> list[str]:
        return ["subject"]

    def __call__(self, props: list[str], required: bool = False, rest: bool = False) -> DataFrame:
        return star(self.statements, props, required, rest)

    def edges(self, prop: str) -> DataFrame:
        """(src, dst) of the references that a property holds."""
        s = self.statements.where((F.col("predicate") == prop) & (F.col("objecttype") == "R"))
        return s.select(F.col("subject").alias("src"), F.col("object").alias("dst"))


def number_of(x: Column) -> Column:
    return F.when(x["t"].isin("integer", "double"), x["o"].try_cast("double"))


def text_of(x: Column) -> Column:
    """A value as text; a reference with @."""
    return F.when(x["t"] == "R", F.concat(F.lit("@"), x["o"])).when(x["t"] == "null", F.lit(None)).otherwise(x["o"])


def quoted(s: Column) -> Column:
    """A JSON string."""
    for a, b in ((r"\\", r"\\\\"), ('"', r'\\"'), ("\n", r"\\n"), ("\r", r"\\r"), ("\t", r"\\t")):
        s = F.regexp_replace(s, a, b)
    return F.concat(F.lit('"'), s, F.lit('"'))


def json_value(x: Column) -> Column:
    """A value as JSON: references with @; a text that looks like a reference, and other types, as an object of datatype and
    value."""
    typed_ = lambda t, v: F.concat(F.lit('{"datatype":'), t, F.lit(',"value":'), v, F.lit("}"))
    text = F.when(x["o"].rlike(REF.pattern), typed_(F.lit('"json"'), quoted(x["o"]))).otherwise(quoted(x["o"]))
    plain = F.when(x["t"] == "R", quoted(F.concat(F.lit("@"), x["o"]))).when(x["t"].isin("integer", "double", "boolean", "null"), x["o"])
    return plain.when(x["t"] == "L", text).otherwise(typed_(quoted(x["t"]), quoted(x["o"])))


def json_of(values: Column) -> Column:
    """A property's values as JSON: null without any, a scalar for one, a list for more or for a stored list."""
    many = F.concat(F.lit("["), F.array_join(F.transform(values, json_value), ","), F.lit("]"))
    return F.when(F.size(values) == 0, F.lit(None)).when((F.size(values) == 1) & ~F.get(values, F.lit(0))["list"], json_value(F.get(values, F.lit(0)))).otherwise(many)


def sort_key(x: Column) -> Column:
    """Values in the order null < numbers and booleans < texts < references."""
    number = F.coalesce(number_of(x), F.when(x["t"] == "boolean", (x["o"] == "true").cast("double")))
    rank = F.when(x["t"] == "null", 0).when(number.isNotNull(), 1).when(x["t"] == "R", 3).otherwise(2)
    return F.struct(rank.alias("rank"), number.alias("n"), F.when(rank >= 2, x["o"]).alias("s"))


def true(x: Column) -> Column:
    """0, '', null and false are false."""
    return F.when(x["t"] == "null", False).when(number_of(x).isNotNull(), number_of(x) != 0).when(x["t"] == "boolean", x["o"] == "true").otherwise(x["o"] != "")


def same(x: Column, y: Column, exact: bool) -> Column:
    """Equality: exact on text and type, or of numbers as numbers."""
    equal = (x["o"] == y["o"]) & (x["t"] == y["t"])
    return equal if exact else equal | F.coalesce(number_of(x) == number_of(y), F.lit(False))


def compared(op: str, x: Column, y: Column, exact: bool) -> Column:
    if op in ("=", "!="):
        return same(x, y, exact) if op == "=" else ~same(x, y, exact)
    a, b = sort_key(x), sort_key(y)
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def any_pair(a: Column, b: Column, test) -> Column:
    return F.exists(a, lambda x: F.exists(b, lambda y: test(x, y)))


def matches(plan, values: Column, cond, how: str) -> Column:
    """exists or filter of the values by a comparison of the language with constants; = and in are exact on text and type."""
    from ..lang.ast import Prop

    def test(x: Column) -> Column:
        a, b = cond.args
        if cond.name == "in":
            return F.exists(F.concat(*[plan.values(e) for e in b]), lambda y: same(x, y, True))
        if isinstance(a, Prop):
            return F.exists(plan.values(b), lambda y: compared(cond.name, x, y, True))
        return F.exists(plan.values(a), lambda y: compared(cond.name, y, x, True))

    return (F.exists if how == "exists" else F.filter)(values, test)


def to_objects(df: DataFrame, inline: bool = False, within: DataFrame | None = None) -> DataFrame:
    """(id, object): each subject's properties as one JSON text, keys in order. inline: an embedded object that one value
    refers to stands in that value's place, at any depth, and not as an object of its own. within: (id, object) of
    objects that stand in the place of references to them."""
    rows = spread(df)
    if within is not None:
        inner = within.select(F.col("id").alias("_i"), F.col("object").alias("_t"))
        rows = rows.join(inner, (F.col("v.t") == "R") & (F.col("v.o") == F.col("_i")), "left")
        return _objects(rows.select("subject", "predicate", "v", F.coalesce("_t", json_value(F.col("v"))).alias("json")))
    if not inline:
        return _objects(rows.withColumn("json", json_value(F.col("v"))))
    inner = rows.where((F.col("v.t") == "R") & F.col("v.o").startswith(EMBEDDED)).groupBy(F.col("v.o").alias("id")).agg(F.count("*").alias("n"))
    inner = stored(inner.where("n = 1").join(rows.select(F.col("subject").alias("id")).distinct(), "id", "left_semi").select("id"))
    # innermost first: objects whose own embedded ones are all known become texts
    todo = stored(rows.withColumn("json", json_value(F.col("v"))))
    while True:
        own = todo.where(F.col("v.t") == "R").join(inner, F.col("v.o") == F.col("id"), "left_semi").select("subject").distinct()
        ready = stored(_objects(todo.join(inner, F.col("subject") == F.col("id"), "left_semi").join(own, "subject", "left_anti")))
        if ready.isEmpty():
            return _objects(todo)
        texts = ready.select(F.col("id").alias("_i"), F.col("object").alias("_t"))
        done = todo.join(texts, F.col("subject") == F.col("_i"), "left_anti")
        done = done.join(texts, (F.col("v.t") == "R") & (F.col("v.o") == F.col("_i")), "left")
        v = F.when(F.col("_t").isNotNull(), F.col("v").withField("t", F.lit("json"))).otherwise(F.col("v"))
        todo = stored(done.select("subject", "predicate", v.alias("v"), F.coalesce("_t", "json").alias("json")))


def _objects(rows: DataFrame) -> DataFrame:
    """rows(subject, predicate, v, json): a JSON text per subject; generated ids aren't written."""
    one = rows.groupBy("subject", "predicate").agg(F.array_sort(F.collect_set(F.struct("v", "json"))).alias("x"))
    texts, first = F.transform("x", lambda y: y["json"]), F.get("x", F.lit(0))
    many = F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))
    text = F.when((F.size("x") == 1) & ~first["v"]["list"], F.when((first["v"]["o"] == NIL) & (first["v"]["t"] == "R"), "[]").otherwise(first["json"])).otherwise(many)
    pair = F.concat(quoted(F.col("predicate")), F.lit(":"), text)
    own = F.concat(F.lit('"id":'), quoted(F.col("subject")))
    whole = one.groupBy("subject").agg(F.array_sort(F.collect_list(pair)).alias("p"))
    return whole.select(F.col("subject").alias("id"), F.concat(F.lit("{"), F.array_join(F.concat(F.array(own), "p"), ","), F.lit("}")).alias("object"))
