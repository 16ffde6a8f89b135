"""The language over small stores: typed values, several values, embedded objects, errors."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from facetgraph import Catalog, Entity, explain, open_store, query, query_json
from facetgraph.functions import SCALAR, register, user_aggregate
from facetgraph.lang import QueryError, parse
from facetgraph.lang.ast import Const, Op
from facetgraph.operators import rdfs, store
from facetgraph.operators.closure import closure
from facetgraph.sources import formats
from facetgraph.sources import statements as st
from facetgraph.streaming import Feed

TYPED = [
    {"id": "1", "values": None}, {"id": "2", "values": 0}, {"id": "3", "values": [None]}, {"id": "4", "values": [1, "1", 1.1, "@1"]},
    {"id": "5", "values": "1"}, {"id": "6", "values": {"datatype": "json", "value": "@1"}}, {"id": "7", "other": True},
]


def ask(spark, objects, text, binds=None):
    cat = Catalog(st.entity(st.frame(spark, st.from_json(objects))))
    df = query(spark, cat, text, binds)
    kinds = dict(df.dtypes)
    df = df.select(*[(st.json_of(F.col(c)) if kinds[c].startswith("array<struct<pos") else F.col(c)).alias(c) for c in df.columns])
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(
    ("where", "want"),
    [
        ("values = 1", [("4", "[1]")]),
        ("values = '1'", [("4", '["1"]'), ("5", '"1"')]),
        ("values = 1.0", []),
        ("values = @1", [("4", '["@1"]')]),
        ("values = @1 and values = 1", [("4", '[1,"@1"]')]),
        ("values = null", [("1", "null"), ("3", "[null]")]),
        ("values = 0", [("2", "0")]),
        ("id = @5", [("5", '"1"')]),
        ("values in (0, '1')", [("2", "0"), ("4", '["1"]'), ("5", '"1"')]),
    ],
)
def test_typed_values(spark, where, want):
    assert ask(spark, TYPED, f"{{id, values where {where}}}") == want


def test_absent_property(spark):
    assert ask(spark, TYPED, "{id where not values}") == [("7",)]
    assert ask(spark, TYPED, "{id where other = true}") == [("7",)]
    assert ask(spark, TYPED, "{id where other = :v}", {"v": True}) == [("7",)]


MANY = [
    {"id": "a", "type": "@T", "n": [1, 2], "m": [10, 20], "label": "one", "next": "@b"},
    {"id": "b", "type": "@T", "n": 2, "label": "two", "next": ["@c", "@d"]},
    {"id": "c", "type": "@U", "n": [0], "label": "@x" * 0, "flag": False},
    {"id": "d", "label": None, "n": 7.5},
]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("{id, 's': n + m}", [("a", "[11.0,21.0,12.0,22.0]")]),
        ("{id, 'u': upper(label) where type}", [("a", '"ONE"'), ("b", '"TWO"'), ("c", '""')]),
        ("{id where n = 2 or type = @U}", [("a",), ("b",), ("c",)]),
        ("{id where label = null or n > 7}", [("d",)]),
        ("{id where type and not (n = 2)}", [("c",)]),
        ("{id where n > m}", []),
        ("{id where m > n}", [("a",)]),
        ("{id where next = ?x and {?x type=@T}}", [("a",)]),
        ("{id, 'of': next.label}", [("a", '"two"'), ("b", '["",null]')]),
        ("{id where next in {type = @U}}", [("b",)]),
        ("{id where n and next not in {type = @U}}", [("a",)]),
        ("{id, 'yes': if(flag, 'y', 'n') where flag or n = 1}", [("a", '"n"'), ("c", '"n"')]),
        ("{id, 'yes': if(n > 1 and not flag, 'y', 'n') where n}", [("c", '"n"')]),
        ("{id, 'r': isref(next) where next}", [("a", "true"), ("b", "[true,true]")]),
        ("{id, 'k': ('' or label) where label and type}", [("a", '"one"'), ("b", '"two"'), ("c", '""')]),
        ("{id where @d in follow(id, next, true)}", [("a",), ("b",)]),
        ("{id where id in follow(@b, next, edgesOnly=true)}", [("c",), ("d",)]),
        ("{id, label order by n desc, id limit 2}", [("b", '"two"'), ("d", "null")]),
    ],
)
def test_several_values(spark, text, want):
    assert ask(spark, MANY, text) == want


def test_aggregates_of_values(spark):
    cat = Catalog(st.entity(st.frame(spark, st.from_json(MANY))))
    got = query(spark, cat, "[count(*), count(n), sum(n), avg(n), total(missing) where n]")
    assert tuple(got.first()) == (4, 5, 12.5, 2.5, 0.0)
    by = query(spark, cat, "{type, 'n': sum(n) group by type}").collect()
    assert {(r.type, r.n) for r in by} == {("@T", 5.0), ("@U", 0.0)}
    each = query(spark, cat, "{n, 'k': count(*) group by n}").collect()
    assert {(r.n, r.k) for r in each} == {("0", 1), ("1", 1), ("2", 2), ("7.5", 1)}


def test_all_properties(spark):
    cat = Catalog(st.entity(st.frame(spark, st.from_json(MANY))))
    got = {r.json for r in query_json(spark, cat, "{* where type = @U}").collect()}
    assert got == {'{"id":"c","properties":{"flag":false,"label":"","n":[0],"type":"@U"}}'}
    got = {r.json for r in query_json(spark, cat, "{id, 'whole': * where label = null}").collect()}
    assert len(got) == 1 and '"id":"d"' in next(iter(got))


def test_explain_names_tree_and_plan(spark):
    cat = Catalog(st.entity(st.frame(spark, st.from_json(MANY))))
    text = explain(spark, cat, "{id, maybe label where n > 1 order by id desc}")
    assert "order by desc" in text and "Physical Plan" in text and "item label maybe" in text


def test_objects_round_trip(spark):
    rows = st.from_json([{"id": "a", "p": [3, "x", 3], "e": {"q": 1, "r": {"s": '"\\'}}, "n": []}, {"id": "b", "p": "@a", "t": {"datatype": "date", "value": "2020"}, "like": {"datatype": "json", "value": "@a"}}])
    got = {r.id: r.object for r in st.to_objects(st.frame(spark, rows)).collect()}
    inner = f"{st.EMBEDDED}a:1"
    assert got["a"] == f'{{"id":"a","e":"@{inner}","n":[],"p":[3,"x",3]}}'
    assert got["b"] == '{"id":"b","like":{"datatype":"json","value":"@a"},"p":"@a","t":{"datatype":"date","value":"2020"}}'
    assert ("a", "p", "3", "integer", "", [0, 2]) in rows
    inlined = {r.id: json.loads(r.object) for r in st.to_objects(st.frame(spark, rows), inline=True).collect()}
    assert set(inlined) == {"a", "b"} and inlined["a"]["e"]["r"]["s"] == '"\\'


def test_ntriples(spark, tmp_path):
    text = '<a> <p> "one\\n" .\n# note\n#!graph g\n<a> <p> <b> .\n<a> <q> "2"^^<int> .\n#!remove\n<a> <p> "one\\n" .\n\n#!graph h\n<a> <l> "x"@en .\n'
    text += '{"id":"a","j":{"type":"literal","value":"é","xml:lang":"fr"}}\n<a> <k> _:1 .\n#!graph z\n# ends it\n<a> <m> "last" .\n'
    (tmp_path / "x.nt").write_text(text)
    df = formats.read(spark, str(tmp_path / "x.nt"))
    got = sorted(tuple(r)[:5] for r in df.collect())
    assert got == [("a", "j", "é", "fr", ""), ("a", "k", "_:1", "R", ""), ("a", "l", "x", "en", "h"), ("a", "m", "last", "L", ""), ("a", "p", "b", "R", "g"), ("a", "q", "2", "int", "")]
    for kind in ("ntriples", "ntjson"):
        formats.write(df, str(tmp_path / kind), kind)
        again = formats.read(spark, str(tmp_path / kind), kind)
        assert sorted(tuple(r)[:5] for r in again.collect()) == got


def test_directives_across_splits(spark, tmp_path):
    """A directive at the end of one split holds for the first line of the next."""
    lines = []
    for i in range(400):
        lines += [f"#!graph c{i}", "#!remove" if i % 3 == 0 else "#!graph d", f'<s{i}> <p> "{i}" .']
    (tmp_path / "y.nt").write_text("\n".join(lines) + "\n")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        log = formats.read_log(spark, str(tmp_path / "y.nt"))
        assert log.select("block").distinct().count() > 5
        got = {r.subject: (r.op, r.context) for r in log.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {f"s{i}": ("remove", f"c{i}") if i % 3 == 0 else ("add", "d") for i in range(400)}


def test_documents(spark, tmp_path):
    objects = [{"id": "a", "text": "two\nlines of text that are long enough", "list": [1, [2, 3]]}, {"name": "none"}]
    (tmp_path / "x.json").write_text(json.dumps(objects, indent=1))
    (tmp_path / "x.jsonl").write_text("\n".join(map(json.dumps, objects)) + "\n\n")
    (tmp_path / "x.mjson").write_text(formats.dumps(objects))
    assert formats.loads(formats.dumps(objects)) == objects and "=multipart-json" in formats.dumps(objects)
    (tmp_path / "x.rj").write_text(json.dumps({"quads": "1", "g": {"a": {"p": [{"type": "uri", "value": "b"}, {"type": "literal", "value": "x", "xml:lang": "en"}]}}}))
    want = sorted((r[1], r[2], r[3]) for r in st.from_json(objects) if r[0] == "a")
    for name in ("x.json", "x.jsonl", "x.mjson"):
        got = formats.read(spark, str(tmp_path / name)).collect()
        assert sorted((r.predicate, r.object, r.objecttype) for r in got if r.subject == "a") == want
        assert len([r for r in got if r.predicate == "name"]) == 1
    got = sorted(tuple(r)[:5] for r in formats.read(spark, str(tmp_path / "x.rj")).collect())
    assert got == [("a", "p", "b", "R", "g"), ("a", "p", "x", "en", "g")]
    formats.copy(spark, str(tmp_path / "x.json"), str(tmp_path / "out"), target_kind="mjson")
    assert formats.read(spark, str(tmp_path / "out"), "mjson").where("predicate = 'text'").first().object == objects[0]["text"]


def test_open_store(spark, tmp_path):
    (tmp_path / "x.nt").write_text('<a> <p> "1" .\n')
    file = open_store(spark, f"file://{tmp_path}/x.nt")
    new = st.frame(spark, st.from_json([{"id": "b", "p": "2"}]))
    file.commit(lambda df: store.add(df, new))
    assert {r.subject for r in open_store(spark, f"file://{tmp_path}/x.nt").read().collect()} == {"a", "b"}
    with sqlite3.connect(tmp_path / "s.db") as con:
        con.execute("create table t (subject text, predicate text, object text, objecttype text, context text)")
        con.executemany("insert into t values (?, 'p', ?, 'L', '')", [(f"s{i}", str(i)) for i in range(50)])
    table = open_store(spark, f"sqlite://{tmp_path}/s.db?table=t").read()
    assert table.count() == 50 and query(spark, Catalog(st.entity(table)), "{id where p = '7'}").first().id == "s7"
    mem = open_store(spark, "mem:")
    mem.commit(lambda df: store.add(df, new))
    assert mem.read().count() == 1 and isinstance(open_store(spark, f"versions://{tmp_path}/v"), store.Store)
    with pytest.raises(ValueError, match="no scheme"):
        open_store(spark, "x")


def test_store_versions_and_triggers(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    new = st.frame(spark, st.from_json([{"id": "hello", "tags": ["@t1"], "embedded": {"foo": 1}}]))
    assert s.commit(lambda df: store.add(df, new)) == 0
    assert s.commit(lambda df: store.remove(df, objects=new.where("subject = 'hello'"), cascade=True)) == 1
    assert s.read().count() == 0 and s.read(0).count() == 3

    def refuse(v):
        raise RuntimeError("no")

    s.triggers.on("before-commit", refuse)
    with pytest.raises(RuntimeError):
        s.commit(lambda df: store.add(df, new))
    assert s.version() == 1
    with pytest.raises(ValueError, match="already exists"):
        store.create(new, new)


def test_store_keeps_its_history(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    s.SNAPSHOT = 3
    for i in range(5):
        new = st.frame(spark, st.from_json([{"id": "a", "n": i, "m": "same"}]))
        s.commit(lambda df, new=new: store.update(df, new), author=f"u{i}", comment="change")
    assert [s.read(v).where("predicate = 'n'").first().object for v in range(5)] == list("01234")
    log = s.log()
    assert log.count() == 2 + 4 * 2 and store.revisions(log, "a").first().revs == [0, 1, 2, 3, 4]
    cat = Catalog(st.entity(s.read(), log=log))
    got = query(spark, cat, "{id, 'n': getTransactionId(n), 'm': getTransactionId(m), 'by': getTransactionAuthor(n), 'all': getTransactionId(id), 'at': getTransactionTime(n)}").first()
    assert (got.n, got.m, got.by, got.all) == (4, 0, "u4", 4) and got.at is not None


def test_embedded_objects_keep_their_ids(spark):
    df = st.frame(spark, st.from_json([{"id": "a", "e": [{"x": 1, "y": {"z": 1}}, {"x": 2}], "k": 1}]))
    new = st.frame(spark, st.from_json([{"id": "q", "e": {"x": 0}}, {"id": "a", "e": [{"x": 5, "y": {"z": 9}}, {"w": 3}]}], prefix="new"))
    for change, kept in ((store.update, True), (store.replace, False)):
        got = {(r.subject, r.predicate, r.object) for r in change(df, new.where("subject <> 'q'")).collect()}
        ids = {o for s, p, o in got if s == "a" and p == "e"}
        assert ids == {r.object for r in df.where("subject = 'a' and predicate = 'e'").collect()}
        assert {(p, o) for s, p, o in got if s in ids and p != "y"} == {("x", "5"), ("w", "3")}
        assert (("a", "k", "1") in got) is kept


def test_transactions(spark, tmp_path):
    a, b = (store.Store(spark, f"file://{tmp_path}/{n}") for n in "ab")
    new = st.frame(spark, st.from_json([{"id": "x", "p": 1}]))
    seen, asked = [], []

    class Slow:
        def ready(self):
            asked.append(1)
            return len(asked) > 2

        def commit(self):
            seen.append("commit")

        def abort(self):
            seen.append("abort")

    a.triggers.on("before-new", lambda subjects: seen.append(subjects.count()))
    t = store.Transaction()
    for p in (a.begin(lambda df: store.add(df, new)), b.begin(lambda df: store.add(df, new)), Slow()):
        t.join(p)
    t.commit()
    assert a.version() == b.version() == 0 and seen == [1, "commit"] and len(asked) == 3
    t = store.Transaction(retries=0)
    asked.clear()
    for p in (a.begin(lambda df: store.remove(df, objects=new)), Slow()):
        t.join(p)
    with pytest.raises(RuntimeError, match="not ready"):
        t.commit()
    assert a.version() == 0 and a.read().count() == 1 and seen[-1] == "abort"


def test_conflicts_through_anonymous_objects(spark):
    df = st.frame(spark, st.from_json([{"id": "a", "e": {"x": 1}}, {"id": "b", "p": 1}]))
    inner = df.where("predicate = 'x'")
    assert store.conflicts(inner, df.where("subject = 'a'")).count() == 0
    assert {r.subject for r in store.conflicts(inner, df.where("subject = 'a'"), df).collect()} == {"a", f"{st.EMBEDDED}a:1"}
    assert store.conflicts(inner, df.where("subject = 'b'"), df).count() == 0


def test_log_store(spark, tmp_path):
    s = open_store(spark, f"log://{tmp_path}/l")
    one, two = (st.frame(spark, st.from_json([{"id": "a", "p": p}])) for p in ("x", "y"))
    s.commit(lambda df: store.add(df, one))
    s.commit(lambda df: store.update(df, two))
    s.commit(lambda df: store.update(df, two.withColumn("context", F.lit("c"))))
    assert [(r.object, r.context) for v in range(3) for r in s.read(v).collect()] == [("x", ""), ("y", ""), ("y", "c")]


def test_typed_slots(spark):
    df = st.frame(spark, st.from_json(TYPED))
    got = st.filtered(df, predicate="values", object=1).collect()
    assert [(r.subject, r.number, r.text) for r in got] == [("4", 1.0, None)]
    assert [r.subject for r in st.filtered(df, object=True).where("truth").collect()] == ["7"]


def test_history(spark):
    log = spark.createDataFrame([(0, "add", "s", "p", "A", "L"), (1, "remove", "s", "p", "A", "L"), (2, "add", "s", "p", "A", "L")], "rev long, op string, subject string, predicate string, object string, objecttype string")
    assert [store.as_of(log, n).count() for n in (0, 1, 2)] == [1, 0, 1]
    other = log.where("rev = 0").withColumn("subject", F.lit("t"))
    assert store.merge(log, other, 0).agg(F.max("rev")).first()[0] == 3
    with pytest.raises(ValueError, match="both sides"):
        store.merge(log, log.where("rev = 2"), 1)
    assert store.increment("0A00001", "B") == "0A00001,0B00001" and store.merged("0A00001,0B00002", "0A00003") == "0A00003,0B00002"
    assert [store.compare(*x) for x in (("0A00001", "0A00002"), ("0A00001", "0A00001"), ("0A00001", "0B00001"))] == [-1, 0, None]


def test_closure_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    got = closure(e, spark.createDataFrame([("a",)], "start string"))
    assert {r.node for r in got.collect()} == {"a", "b", "c", "d"}
    leaf = closure(e, spark.createDataFrame([("a",)], "start string"), True, True)
    assert [r.node for r in leaf.collect()] == ["d"]


def test_closure_of_long_chains(spark):
    n = 37
    e = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(5, 20)], "src long, dst long")
    seeds = spark.range(n + 1).withColumnRenamed("id", "start")
    one, two = (closure(e, seeds, everywhere=x) for x in (False, True))
    want = {(a, b, min(b - a, 5 - a + 1 + b - 20) if a <= 5 and b >= 20 else b - a) for a in range(n + 1) for b in range(a, n + 1)}
    assert {tuple(r) for r in one.collect()} == want == {tuple(r) for r in two.collect()}


def test_entailment(spark):
    rows = [("A", rdfs.SUB_CLASS, "D", "R"), ("D", rdfs.SUB_CLASS, "F", "R"), ("o1", rdfs.TYPE, "A", "R"), ("p", rdfs.DOMAIN, "D", "R"), ("q", rdfs.SUB_PROPERTY, "p", "R"), ("o2", "q", "x", "L")]
    s = spark.createDataFrame(rows, "subject string, predicate string, object string, objecttype string")
    got = {(r.subject, r.object) for r in rdfs.entailed(s).where(F.col("predicate") == rdfs.TYPE).collect()}
    assert got == {("o1", "A"), ("o1", "D"), ("o1", "F"), ("o2", "D"), ("o2", "F")}


def test_feed_waits_for_missing_base(spark, tmp_path):
    feed = Feed(spark, f"file://{tmp_path}/feed")
    src = tmp_path / "in"
    src.mkdir()
    row = '{"origin":"A","revision":%d,"baserevision":%d,"op":"add","subject":"s%d","predicate":"p","object":"o","objecttype":"L"}\n'

    def run():
        feed.start(str(src), f"{tmp_path}/ck").awaitTermination()

    (src / "2.json").write_text(row % (2, 1, 2))
    run()
    assert feed.log().count() == 0 and feed.pending().count() == 1
    (src / "1.json").write_text(row % (1, 0, 1) + row % (1, 0, 1))
    run()
    assert feed.log().count() == 2 and feed.pending().count() == 0


def test_syntax():
    assert parse("{a where b - 1 = -1}").where == Op("=", (parse("(b - 1)").items[0].value, Const(-1)))
    for bad in ("{", "{a where}", "{a} b", "[a", "{a limit x}", "{1 + }"):
        with pytest.raises(QueryError):
            parse(bad)


def test_registered_functions(spark):
    register("twice", lambda x: x * 2)
    register("product", user_aggregate(F.lit(1.0), lambda a, x: a * x), aggregate=True)
    cat = Catalog(Entity("t", spark.createDataFrame([(1, 2.0), (2, 3.0)], "k int, v double"), ("k",)))
    assert [r.value for r in query(spark, cat, "(twice(v) where type='t' order by k)").collect()] == [4.0, 6.0]
    assert query(spark, cat, "(product(v) where type='t')").first().value == 6.0
    SCALAR.pop("twice")
    with pytest.raises(QueryError):
        query(spark, cat, "(twice(v) where type='t')")


PAIRS = [
    # (query, SQL); k and j tell no object of a, b and c
    ("[count(*), sum(?b.v), avg(v), total(?b.w), count(?b.w), min(?b.w), max(v) where type='a' and {?b type='b'} and k = ?b.k]", "select count(*), sum(b.v), avg(a.v), sum(if(b.w is null, null, 0::double)), count(b.w), min(b.w), max(a.v) from a join b on a.k = b.k"),
    ("[count(*), count(v), sum(?b.v), avg(?b.v), min(v) where type='a' and {?b type='b' and v > 1000} and k = ?b.k]", "select count(*), count(a.v), sum(b.v), avg(b.v), min(a.v) from a join b on a.k = b.k where b.v > 1000"),
    ("[count(*), count(?b.w), sum(?b.v), sum(v), count(if(isref(?b.w), 1, 1)) where type='a' and {?b type='b'} and maybe ?b.k = k]", "select count(*), count(b.w), sum(b.v), sum(a.v), count(*) from a left join b on a.k = b.k"),
    ("[count(*), sum(v * ?b.v), sum(v + 1) - count(?b.w), max(?b.v) where type='a' and {?b type='b'} and k = ?b.k and v < ?b.v]", "select count(*), sum(a.v * b.v), sum(a.v + 1) - count(b.w), max(b.v) from a join b on a.k = b.k and a.v < b.v"),
    ("[count(*), sum(v), avg(?b.v) where type='a' and {?b type='b'}]", "select count(*), sum(a.v), avg(b.v) from a, b"),
    ("[count(*), min(v), max(?b.v), sum(v) where type='a' and {?b type='b' and v > 1000}]", "select count(*), min(a.v), max(b.v), sum(a.v) from a, b where b.v > 1000"),
    ("[count(*), sum(?c.v), avg(v), sum(?b.v), sum(1) where type='a' and {?b type='b'} and k = ?b.k and {?c type='c'} and ?b.j = ?c.j]", "select count(*), sum(c.v), avg(a.v), sum(b.v), count(*)::double from a join b on a.k = b.k join c on b.j = c.j"),
    ("{k, 'n': count(*), 's': sum(?b.v), 'm': count(k), 'x': sum(v) where type='a' and {?b type='b'} and k = ?b.k group by k}", "select a.k, count(*), sum(b.v), count(*), sum(a.v) from a join b on a.k = b.k group by 1"),
    ("{?b.j, 'n': count(*), 's': sum(v), 'p': sum(?b.v * v) where type='a' and {?b type='b'} and k = ?b.k group by ?b.j}", "select b.j, count(*), sum(a.v), sum(b.v * a.v) from a join b on a.k = b.k where b.j is not null group by 1"),
    ("[count(*), sum(?b.v) where type='a' and {?b type='b'} and k = ?b.k and ?b.j in {type='d' and z > 1}]", "select count(*), sum(b.v) from a join b on a.k = b.k where b.j in (select id from d where z > 1)"),
    ("[count(*), sum(?d.z), sum(?b.v) where type='a' and {?b type='b'} and k = ?b.k and ?b.j = ?d and {?d type='d'}]", "select count(*), sum(d.z), sum(b.v) from a join b on a.k = b.k join d on b.j = d.id"),
]


@pytest.fixture(scope="module")
def pairs(spark):
    import duckdb

    rows = {
        "a": ("id long, k int, v double", [(i, (None, 1, 1, 2, 3)[i % 5], None if i % 7 == 0 else i * 0.5) for i in range(40)]),
        "b": ("id long, k int, j long, v double, w string", [(i, (1, None, 2, 4)[i % 4], None if i % 9 == 8 else i % 3, None if i % 6 == 0 else 20.0 - i, None if i % 5 else f"w{i}") for i in range(33)]),
        "c": ("id long, j long, v double", [(i, i % 4, i * 0.25) for i in range(21)]),
        "d": ("id long, z double", [(i, i * 1.5) for i in range(5)]),
    }
    con, entities = duckdb.connect(), []
    for n, (schema, data) in rows.items():
        con.execute(f"create table {n} ({schema.replace('long', 'bigint').replace('string', 'varchar')})")
        con.executemany(f"insert into {n} values ({', '.join('?' * len(data[0]))})", data)
        entities.append(Entity(n, spark.createDataFrame(data, schema), ("id",), {"j": "d"} if n == "b" else {}))
    return Catalog(*entities), con


@pytest.mark.parametrize(("text", "sql"), PAIRS)
def test_aggregates_of_pairs(spark, pairs, text, sql):
    cat, con = pairs
    got = query(spark, cat, text)
    plain = lambda rows: sorted(tuple(f"{x:.6f}" if isinstance(x, float) else str(x).removeprefix("@d/") for x in r) for r in rows)
    assert plain(got.collect()) == plain(con.execute(sql).fetchall())


def test_aggregates_make_no_pairs(spark):
    """A join of 20,000 objects a side over 5 keys meets as 5 rows, not as 80,000,000; a join to one object isn't folded."""
    many = lambda n: Entity(n, spark.range(0, 20000, 1, 4).select("id", (F.col("id") % 5).alias("k"), (F.col("id") * 0.5).alias("v")), ("id",), {"k": "b"})
    cat = Catalog(many("a"), many("b"))

    def joined(text):
        df = query(spark, cat, text)
        row = df.collect()[0]
        plan, sizes = df._jdf.queryExecution().executedPlan().finalPhysicalPlan(), []
        todo = [plan]
        while todo:
            x = todo.pop()
            if "Join" in x.nodeName():
                sizes.append(x.metrics().apply("numOutputRows").value())
            x = x.plan() if x.nodeName().startswith(("ShuffleQueryStage", "BroadcastQueryStage")) else x
            todo += [x.children().apply(i) for i in range(x.children().size())]
        return row, sizes

    row, sizes = joined("[count(*), sum(?b.v), sum(v) where type='a' and {?b type='b'} and k = ?b.k]")
    total = sum(range(20000)) * 0.5 * 4000
    assert (row, sizes) == ((80_000_000, total, total), [5])
    row, sizes = joined("[count(*), sum(?b.v) where type='a' and {?b type='b'} and k = ?b]")
    assert (row, sizes) == ((20000, 4000 * sum(range(5)) * 0.5), [20000])


def test_registered_aggregate_of_pairs(spark, pairs):
    from facetgraph.functions import AGGREGATE

    cat, con = pairs
    text, sql = "[sum(?b.v), count(*) where type='a' and {?b type='b'} and k = ?b.k]", "select sum(a.k * 0 + b.v), count(*) from a join b on a.k = b.k and b.v is not null"
    was = AGGREGATE["sum"]
    register("sum", lambda x: F.sum(x) * 2, aggregate=True)
    try:
        (got,) = query(spark, cat, text).collect()
    finally:
        AGGREGATE["sum"] = was
    want, n = con.execute(sql).fetchone()
    assert got[0] == want * 2 and got[1] >= n
