"""Queries of the language over the star schema's tables, each with its meaning as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog, Entity
from ..engine import query, query_json
from ..operators import rdfs, store
from ..sources import formats
from ..sources import statements as st
from ..sources.stores import IndexedStore, LogStore
from ..sources.tables import shared_folder

TABLES: dict[str, tuple[tuple[str, ...], dict[str, str]]] = {
    "region": (("r_regionkey",), {}),
    "nation": (("n_nationkey",), {"n_regionkey": "region"}),
    "supplier": (("s_suppkey",), {"s_nationkey": "nation"}),
    "customer": (("c_custkey",), {"c_nationkey": "nation"}),
    "part": (("p_partkey",), {}),
    "orders": (("o_orderkey",), {"o_custkey": "customer"}),
    "lineitem": ((), {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}),
}


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog.parquet(spark, sf_dir, TABLES)


def with_documents(spark: SparkSession, sf_dir: str) -> Catalog:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    df = docs.select("doc_id", "lang", "source").join(labels, "doc_id", "left")
    return catalog(spark, sf_dir).add(Entity("documents", df, ("doc_id",)))


def with_turns(spark: SparkSession, sf_dir: str) -> Catalog:
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    name = lambda n: F.concat_ws(".", F.col("conv_id").cast("string"), n.cast("string"))
    df = t.select(name(F.col("turn")).alias("turn_id"), "conv_id", "turn", "role", F.when(F.col("turn") > F.min("turn").over(_conv()), name(F.col("turn") - 1)).alias("reply_to"))
    return Catalog(Entity("turn", df, ("turn_id",), {"reply_to": "turn"}))


def first_turn(spark: SparkSession, sf_dir: str) -> dict:
    x = spark.read.parquet(f"{sf_dir}/conversations.parquet").agg(F.min(F.struct("conv_id", "turn")).alias("m")).first().m
    return {"start": f"turn/{x.conv_id}.{x.turn}"}


def _conv():
    from pyspark.sql import Window

    return Window.partitionBy("conv_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def ask(name: str, text: str, sql: str, then=None, binds=None, over=catalog, make=query) -> None:
    """binds: values, or how to get them of (spark, folder)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = make(spark, over(spark, sf_dir), text, binds(spark, sf_dir) if callable(binds) else binds)
        return then(df) if then else df

    QUERIES[name], SQL[name] = run, sql


def plain(name: str, sql: str):
    def keep(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return keep


def joined(*cols):
    """Lists as texts, for comparison."""
    return lambda df: df.withColumns({c: F.array_join(F.col(c).cast("array<string>"), "|") for c in cols})


def rounded(*cols):
    return lambda df: df.withColumns({c: F.round(c, 2) for c in cols})


# projection and construct
ask("project_props", "{c_name, c_acctbal where type='customer'}", "select c_name, c_acctbal from customer")
ask(
    "project_wildcard",
    "{* where type='nation'}",
    "select 'nation/' || n_nationkey as id, n_nationkey, n_name, '@region/' || n_regionkey as n_regionkey from "
    "nation",
)
ask(
    "project_id_ref",
    "{id, o_custkey where type='orders'}",
    "select 'orders/' || o_orderkey as id, '@customer/' || o_custkey as o_custkey from orders",
)
ask("construct_value", "(upper(n_name) where type='nation')", "select upper(n_name) as value from nation")
ask(
    "construct_list",
    "[n_name, lower(n_name), n_nationkey where type='nation']",
    "select n_name as c0, lower(n_name) as c1, n_nationkey as c2 from nation",
)
ask(
    "constant_row",
    "[null=null, null!=null, null=0, null='', 1+null, trim(null), null > 0, null < 0]",
    "select true c0, false c1, false c2, false c3, null::double c4, null::varchar c5, false c6, true c7",
)
ask("namemap", "{c_name, c_acctbal where type='customer' namemap = {'name': 'c_name'}}", "select c_name as name, c_acctbal from customer")
# filters
ask(
    "bindvar",
    "{c_name where type='customer' and c_mktsegment = :seg}",
    "select c_name from customer where c_mktsegment = 'BUILDING'",
    binds={"seg": "BUILDING"},
)
ask("filter_eq", "{c_name where c_mktsegment = 'MACHINERY'}", "select c_name from customer where c_mktsegment = 'MACHINERY'")
ask("filter_ne", "{c_name where c_mktsegment != 'MACHINERY'}", "select c_name from customer where c_mktsegment <> 'MACHINERY'")
ask(
    "filter_range",
    "{l_extendedprice where l_quantity > 45 and l_discount <= 0.05}",
    "select l_extendedprice from lineitem where l_quantity > 45 and l_discount <= 0.05",
)
ask(
    "filter_in",
    "{c_name where c_mktsegment in ('BUILDING', 'MACHINERY')}",
    "select c_name from customer where c_mktsegment in ('BUILDING', 'MACHINERY')",
)
ask(
    "filter_not_in",
    "{c_name where c_mktsegment not in ('BUILDING', 'MACHINERY')}",
    "select c_name from customer where c_mktsegment not in ('BUILDING', 'MACHINERY')",
)
ask(
    "filter_or",
    "{c_name where c_mktsegment = 'BUILDING' or c_acctbal < 0}",
    "select c_name from customer where c_mktsegment = 'BUILDING' or c_acctbal < 0",
)
ask(
    "filter_not_and",
    "{c_name where type='customer' and not (c_mktsegment = 'BUILDING' and c_acctbal > 0)}",
    "select c_name from customer where not (c_mktsegment = 'BUILDING' and c_acctbal > 0)",
)
ask(
    "filter_complex",
    "{l_extendedprice, l_quantity where l_extendedprice > l_quantity * 1000}",
    "select l_extendedprice, l_quantity from lineitem where l_extendedprice > l_quantity * 1000",
)
ask("filter_id", "{o_totalprice where type='orders' and id = @orders/7}", "select o_totalprice from orders where o_orderkey = 7")
ask("filter_ref", "{n_name where n_regionkey = @region/2}", "select n_name from nation where n_regionkey = 2")
# optional properties
ask(
    "maybe_prop",
    "{doc_id, maybe quality where type='documents'}",
    "select doc_id, quality from documents left join labels using (doc_id)",
    over=with_documents,
)
ask(
    "not_prop",
    "{doc_id where type='documents' and not quality}",
    "select doc_id from documents where doc_id not in (select doc_id from labels)",
    over=with_documents,
)
ask(
    "maybe_null_match",
    "{doc_id where type='documents' and maybe quality and quality = null}",
    "select doc_id from documents left join labels using (doc_id) where quality is null",
    over=with_documents,
)
ask(
    "required_prop",
    "{doc_id, quality where type='documents'}",
    "select doc_id, quality from documents join labels using (doc_id)",
    over=with_documents,
)
ask(
    "omitnull_json",
    "{doc_id, lang, omitnull maybe quality, [omitnull maybe toxic] where type='documents'}",
    "select '{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\"' || coalesce(',\"quality\":' || quality, '') || "
    "coalesce(',\"toxic\":[' || toxic || ']', '') || '}' as json from documents left join labels using (doc_id)",
    over=with_documents,
    make=query_json,
)
ask(
    "nulls_json",
    "{doc_id, maybe quality, [maybe toxic] where type='documents'}",
    "select '{\"doc_id\":' || doc_id || ',\"quality\":' || coalesce(quality::varchar, 'null') || ',\"toxic\":[' || "
    "coalesce(toxic::varchar, '') || ']}' as json from documents left join labels using (doc_id)",
    over=with_documents,
    make=query_json,
)
ask(
    "forcelist",
    "{doc_id, [maybe quality] where type='documents'}",
    "select doc_id, coalesce(quality::varchar, '') as quality from documents left join labels using (doc_id)",
    then=joined("quality"),
    over=with_documents,
)
# joins
ask(
    "join_inner",
    "{o_orderkey, 'name': ?c.c_name where o_custkey = ?c and {?c type='customer'}}",
    "select o_orderkey, c_name as name from orders join customer on o_custkey = c_custkey",
)
ask(
    "join_chain",
    "{c_name, 'nation': ?n.n_name, 'region': ?r.r_name where c_nationkey = ?n and {?n n_regionkey = ?r} and {?r "
    "type='region'}}",
    "select c_name, n_name as nation, r_name as region from customer join nation on c_nationkey = n_nationkey join "
    "region on n_regionkey = r_regionkey",
)
ask(
    "join_path",
    "{c_name, 'region': c_nationkey.n_regionkey.r_name where type='customer'}",
    "select c_name, r_name as region from customer join nation on c_nationkey = n_nationkey join region on "
    "n_regionkey = r_regionkey",
)
ask("join_alias", "{?a n_name, 'again': ?b.n_name where type='nation' and ?a = ?b}", "select n_name, n_name as again from nation")
ask(
    "join_nonkey",
    "{'n': count(*), 'total': sum(?c.c_acctbal) where type='supplier' and s_nationkey = ?c.c_nationkey and {?c "
    "type='customer'}}",
    "select count(*) as n, round(sum(c_acctbal), 2) as total from supplier join customer on s_nationkey = "
    "c_nationkey",
    then=rounded("total"),
)
ask(
    "join_two_keys",
    "{'n': count(*) where type='lineitem' and {?m type='lineitem'} and l_orderkey = ?m.l_orderkey and l_linenumber "
    "= ?m.l_linenumber}",
    "select count(*) as n from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber = "
    "b.l_linenumber",
)
ask(
    "join_left",
    "{o_orderkey, 'lines': count(?l.l_linenumber) where type='orders' and {?l type='lineitem'} and maybe "
    "?l.l_orderkey = o_orderkey group by o_orderkey}",
    "select o_orderkey, count(l_linenumber) as lines from orders left join lineitem on l_orderkey = o_orderkey "
    "group by 1",
)
ask(
    "join_semi",
    "{o_orderkey where type='orders' and o_custkey in {type='customer' and c_mktsegment='BUILDING'}}",
    "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = "
    "'BUILDING')",
)
ask(
    "join_anti",
    "{o_orderkey where type='orders' and o_custkey not in {type='customer' and c_mktsegment='BUILDING'}}",
    "select o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_mktsegment = "
    "'BUILDING')",
)
ask(
    "join_filterset_value",
    "{n_name where type='nation' and n_regionkey = {type='region' and r_name='ASIA'}}",
    "select n_name from nation join region on n_regionkey = r_regionkey where r_name = 'ASIA'",
)
ask(
    "join_cross",
    "{r_name, 'nations': ?n.n_name where type='region' and {?n type='nation'}}",
    "select r_name, (select string_agg(n_name, '|' order by n_name) from nation) as nations from region",
    then=joined("nations"),
)
ask(
    "join_theta",
    "{n_name, 'later': ?m.n_name where type='nation' and {?m type='nation'} and n_name < ?m.n_name}",
    "select a.n_name, string_agg(b.n_name, '|' order by b.n_name) as later from nation a join nation b on a.n_name "
    "< b.n_name group by a.n_nationkey, a.n_name",
    then=joined("later"),
)
ask(
    "filterset_exists",
    "{n_name where type='nation' and {type='region' and r_name='ASIA'}}",
    "select n_name from nation where exists (select 1 from region where r_name = 'ASIA')",
)
ask("filterset_exists_none", "{n_name where type='nation' and {type='region' and r_name='NOWHERE'}}", "select n_name from nation where false")
ask(
    "computed_join",
    "{n_name, 'region': ?r.r_name where type='nation' and {?r type='region'} and ?r.r_regionkey = mod(n_nationkey, "
    "5)}",
    "select n_name, r_name as region from nation join region on r_regionkey = n_nationkey % 5",
)
# grouping
ask("group_count", "{l_returnflag, 'n': count(*) group by l_returnflag}", "select l_returnflag, count(*) as n from lineitem group by 1")
ask(
    "group_multi_agg",
    "{l_returnflag, 'n': count(l_quantity), 's': sum(l_quantity), 't': total(l_tax), 'a': avg(l_discount), 'lo': "
    "min(l_extendedprice), 'hi': max(l_extendedprice) group by l_returnflag}",
    "select l_returnflag, count(l_quantity) n, round(sum(l_quantity), 2) s, round(sum(l_tax), 2) t, "
    "round(avg(l_discount), 6) a, min(l_extendedprice) lo, max(l_extendedprice) hi from lineitem group by 1",
    then=lambda df: df.withColumns({"s": F.round("s", 2), "t": F.round("t", 2), "a": F.round("a", 6)}),
)
ask(
    "group_list",
    "{n_regionkey, n_name where type='nation' group by n_regionkey}",
    "select '@region/' || n_regionkey as n_regionkey, string_agg(n_name, '|' order by n_name) as n_name from nation "
    "group by 1",
    then=joined("n_name"),
)
ask(
    "group_expr_agg",
    "{l_linestatus, 'r': sum(if(l_returnflag = 'R', l_quantity, 0)) - sum(l_tax) group by l_linestatus}",
    "select l_linestatus, round(sum(case when l_returnflag = 'R' then l_quantity else 0 end) - sum(l_tax), 2) as r "
    "from lineitem group by 1",
    then=rounded("r"),
)
ask(
    "agg_global",
    "[count(*), sum(l_quantity), max(l_tax), avg(l_quantity) where type='lineitem']",
    "select count(*) c0, round(sum(l_quantity), 2) c1, max(l_tax) c2, round(avg(l_quantity), 6) c3 from lineitem",
    then=lambda df: df.withColumns({"c1": F.round("c1", 2), "c3": F.round("c3", 6)}),
)
ask("agg_mixed", "{n_name, 'n': count(*) where type='nation'}", "select n_name, (select count(*) from nation) as n from nation")
# order and paging
ask(
    "order_asc_desc",
    "{c_name, c_mktsegment, c_acctbal where type='customer' order by c_mktsegment, c_acctbal desc limit 40}",
    "select c_name, c_mktsegment, c_acctbal from customer order by c_mktsegment, c_acctbal desc, c_custkey limit 40",
)
ask(
    "limit_offset",
    "{c_name where type='customer' order by c_name limit 10 offset 25}",
    "select c_name from customer order by c_name, c_custkey limit 10 offset 25",
)
ask(
    "order_expression",
    "{n_name where type='nation' order by mod(n_nationkey, 7) desc, n_name limit 12}",
    "select n_name from nation order by n_nationkey % 7 desc, n_name limit 12",
)
# nesting
ask(
    "nested_label",
    "{n_name, 'region': {?r r_name} where n_regionkey = ?r and {?r type='region'}}",
    "select n_name, r_name as region from nation join region on n_regionkey = r_regionkey",
    then=lambda df: df.select("n_name", F.col("region.r_name").alias("region")),
)
ask(
    "nested_correlated",
    "{?c c_name, 'orders': [{o_orderkey where type='orders' and o_custkey = ?c}] where type='customer'}",
    "select c_name, string_agg(o_orderkey, '|' order by o_orderkey) as orders from customer left join orders on "
    "o_custkey = c_custkey group by c_custkey, c_name",
    then=lambda df: df.select("c_name", F.when(F.col("orders").isNotNull(), F.array_join(F.col("orders.o_orderkey").cast("array<string>"), "|")).alias("orders")),
)
ask(
    "nested_independent",
    "{n_name, 'regions': [{r_name where type='region'}] where type='nation'}",
    "select n_name, (select string_agg(r_name, '|' order by r_name) from region) as regions from nation",
    then=lambda df: df.select("n_name", F.array_join("regions.r_name", "|").alias("regions")),
)
ask(
    "nested_parent",
    "{n_name, 'more': {n_nationkey, n_regionkey} where type='nation'}",
    "select n_name, n_nationkey, '@region/' || n_regionkey as n_regionkey from nation",
    then=lambda df: df.select("n_name", "more.n_nationkey", "more.n_regionkey"),
)
ask("dynamic_key", "{n_name : n_nationkey where type='nation'}", "select n_name as key, n_nationkey as value from nation")
ask("mergeall", "{id : n_name where type='nation' MERGEALL}", "select 'nation/' || n_nationkey as key, n_name as value from nation")
ask(
    "mergeall_dict",
    "{n_name, n_nationkey where type='nation' order by n_name desc MERGEALL}",
    "select n_name, n_nationkey from nation order by n_name limit 1",
)
ask(
    "mergeall_key",
    "{n_regionkey : n_name where type='nation' order by n_name MERGEALL}",
    "select '@region/' || n_regionkey as key, max(n_name) as value from nation group by n_regionkey",
)
ask(
    "mergeall_list",
    "[n_name, upper(n_name) where type='nation' order by n_name limit 5 MERGEALL]",
    "select string_agg(n_name || '|' || upper(n_name), '|' order by n_name) as value from (select n_name from "
    "nation order by n_name limit 5)",
    then=joined("value"),
)
ask(
    "mergeall_omitnull",
    "{omitnull maybe quality, doc_id where type='documents' order by doc_id MERGEALL}",
    "select (select arg_max(quality, doc_id) from labels join documents using (doc_id)) as quality, max(doc_id) as "
    "doc_id from documents",
    over=with_documents,
)
ask(
    "namemap_parse",
    "{name, 'where': nation.n_name where type='customer' and bal > 0 namemap = {'name': 'c_name', 'bal': "
    "'c_acctbal', 'nation': 'c_nationkey'}}",
    "select c_name as name, n_name as where from customer join nation on c_nationkey = n_nationkey where c_acctbal "
    "> 0",
)
ask(
    "namemap_nested",
    "{name, 'orders': [{total where type='orders' and o_custkey = ?c and total > 400000}] , key where type='customer' namemap = {'name': 'c_name', 'total': 'o_totalprice', 'key': 'c_custkey'}}".replace("{name", "{?c name"),
    "select c_name as name, c_custkey as key, count(o_orderkey) as orders from customer left join orders on "
    "o_custkey = c_custkey and o_totalprice > 400000 group by all",
    then=lambda df: df.withColumn("orders", F.coalesce(F.size("orders"), F.lit(0)).cast("long")).withColumn("orders", F.greatest("orders", F.lit(0))),
)
ask(
    "scalar_and_or",
    "[('a' and 'b'), ('' or n_name), (0 or 5), (n_nationkey and n_name), (n_nationkey > 3 and n_nationkey < 9) "
    "where type='nation']",
    "select 'b' c0, n_name c1, 5 c2, case when n_nationkey = 0 then '0' else n_name end c3, n_nationkey > 3 and "
    "n_nationkey < 9 c4 from nation",
    then=lambda df: df.withColumn("c3", F.col("c3").cast("string")),
)
ask(
    "depth_renamed",
    "{o_orderkey, 'cust': o_custkey where type='orders' DEPTH 1}",
    "select o_orderkey, c_name, '@nation/' || c_nationkey as c_nationkey from orders join customer on o_custkey = "
    "c_custkey",
    then=lambda df: df.select("o_orderkey", "cust.c_name", "cust.c_nationkey"),
)
ask(
    "depth_list",
    "{o_orderkey, [o_custkey] where type='orders' DEPTH 2}",
    "select o_orderkey, c_name, n_name from orders join customer on o_custkey = c_custkey join nation on "
    "c_nationkey = n_nationkey",
    then=lambda df: df.select("o_orderkey", F.get("o_custkey", F.lit(0)).alias("c")).select("o_orderkey", "c.c_name", "c.c_nationkey.n_name"),
)
ask(
    "for_update",
    "{n_name, 'region': {?r r_name} where n_regionkey = ?r and {?r type='region'}}",
    "select 'nation/' || n_nationkey as id, n_name, 'region/' || r_regionkey as rid, r_name from nation join region "
    "on n_regionkey = r_regionkey",
    make=lambda *a: query(*a, for_update=True),
    then=lambda df: df.select("id", "n_name", F.col("region.id").alias("rid"), "region.r_name"),
)
ask(
    "depth_expand",
    "{o_orderkey, o_custkey where type='orders' DEPTH 2}",
    "select o_orderkey, c_name, n_name from orders join customer on o_custkey = c_custkey join nation on "
    "c_nationkey = n_nationkey",
    then=lambda df: df.select("o_orderkey", "o_custkey.c_name", "o_custkey.c_nationkey.n_name"),
)
# closure
ask(
    "follow",
    "{turn_id, 'up': follow(id, reply_to, true)}",
    "select a.conv_id || '.' || a.turn as turn_id, string_agg(b.conv_id || '.' || b.turn, '|' order by b.conv_id || "
    "'.' || b.turn) as up from conversations a left join conversations b on a.conv_id = b.conv_id and b.turn < "
    "a.turn group by a.conv_id, a.turn",
    then=joined("up"),
    over=with_turns,
)
ask(
    "rfollow",
    "{turn_id, 'down': rfollow(id, reply_to, true)}",
    "select a.conv_id || '.' || a.turn as turn_id, string_agg(b.conv_id || '.' || b.turn, '|' order by b.conv_id || "
    "'.' || b.turn) as down from conversations a left join conversations b on a.conv_id = b.conv_id and b.turn > "
    "a.turn group by a.conv_id, a.turn",
    then=joined("down"),
    over=with_turns,
)
ask(
    "follow_leaves",
    "{turn_id, 'top': follow(id, reply_to, true, true)}",
    "select a.conv_id || '.' || a.turn as turn_id, min(b.conv_id || '.' || b.turn) as top from conversations a left "
    "join (select conv_id, min(turn) as turn from conversations group by 1) b on a.conv_id = b.conv_id and b.turn < "
    "a.turn group by a.conv_id, a.turn",
    then=joined("top"),
    over=with_turns,
)
ask(
    "follow_in",
    "{?p turn_id, 'n': [{?c turn_id where ?c in rfollow(?p, reply_to, true)}] where type='turn'}",
    "select a.conv_id || '.' || a.turn as turn_id, count(b.turn) as n from conversations a left join conversations "
    "b on a.conv_id = b.conv_id and b.turn > a.turn group by a.conv_id, a.turn",
    then=lambda df: df.select("turn_id", F.coalesce(F.size("n"), F.lit(0)).cast("long").alias("n")).withColumn("n", F.greatest("n", F.lit(0))),
    over=with_turns,
)
FIRST = "(select min(conv_id) as c, min(turn) as t from conversations where conv_id = (select min(conv_id) from conversations))"
ask(
    "follow_const",
    "{turn_id where id in rfollow(:start, reply_to)}",
    f"select conv_id || '.' || turn as turn_id from conversations where conv_id = (select c from {FIRST})",
    over=with_turns,
    binds=first_turn,
)
ask(
    "follow_const_not",
    "{turn_id where type='turn' and id not in rfollow(:start, reply_to)}",
    f"select conv_id || '.' || turn as turn_id from conversations where conv_id <> (select c from {FIRST})",
    over=with_turns,
    binds=first_turn,
)
ask(
    "ref_in_follow",
    "{turn_id where :start in follow(id, reply_to, true)}",
    f"select conv_id || '.' || turn as turn_id from conversations where conv_id = (select c from {FIRST}) and turn > (select t from {FIRST})",
    over=with_turns,
    binds=first_turn,
)
ask(
    "follow_const_list",
    "{r_name, 'down': rfollow(:start, reply_to, edgesOnly=true) where type='region'}",
    f"select r_name, (select max(turn) from conversations where conv_id = (select c from {FIRST})) as down from region",
    over=lambda spark, sf: with_turns(spark, sf).add(catalog(spark, sf).entities["region"]),
    then=lambda df: df.select("r_name", F.split(F.get("down", F.lit(0)), r"\.")[1].cast("long").alias("down")),
    binds=first_turn,
)


# functions
ask(
    "fn_string",
    "[upper(c_name), lower(c_name), trim(' \\t a '), ltrim('xxab', 'x'), rtrim(c_name, '0123456789') where "
    "type='customer']",
    "select upper(c_name) c0, lower(c_name) c1, 'a' c2, 'ab' c3, rtrim(c_name, '0123456789') c4 from customer",
)
ask(
    "fn_number",
    "[c_acctbal + 1, c_acctbal - 1, c_acctbal * 2, c_acctbal / 2, -c_acctbal, number('junk'), number('12.5') where "
    "type='customer']",
    "select c_acctbal + 1 c0, c_acctbal - 1 c1, c_acctbal * 2 c2, c_acctbal / 2 c3, -c_acctbal c4, 0.0::double c5, "
    "12.5::double c6 from customer",
)
ask(
    "fn_mod",
    "[n_nationkey % 7, -n_nationkey % 7 where type='nation']",
    "select (n_nationkey % 7)::double c0, (((-n_nationkey) % 7 + 7) % 7)::double c1 from nation",
)
ask(
    "fn_if",
    "[if(c_acctbal < 0, 'debt', 'fine'), if(0, 1, 2), bool('') where type='customer']",
    "select case when c_acctbal < 0 then 'debt' else 'fine' end c0, 2 c1, false c2 from customer",
)
ask(
    "fn_cast",
    "[string(n_nationkey), number(string(n_nationkey)) where type='nation']",
    "select n_nationkey::varchar c0, n_nationkey::double c1 from nation",
)
ask(
    "fn_isref",
    "[isref(n_regionkey), isref(n_name), isbnode(id), ref(n_name) where type='nation']",
    "select true c0, false c1, false c2, '@' || n_name c3 from nation",
)


# grammar
ask("quoted_names", "{<n_name>, 'k': <n_nationkey> where <n_nationkey> < 5}", "select n_name, n_nationkey as k from nation where n_nationkey < 5")
ask(
    "comments_precedence",
    "{n_name /* names */ WHERE n_nationkey < 5 // few\n Or n_regionkey = @region/1 AND n_nationkey > 20 # of one region\n}",
    "select n_name from nation where n_nationkey < 5 or (n_regionkey = 1 and n_nationkey > 20)",
)
ask(
    "nested_star",
    "{n_name, 'all': * where type='nation'}",
    "select n_name, n_nationkey, '@region/' || n_regionkey as n_regionkey from nation",
    then=lambda df: df.select("n_name", "all.n_nationkey", "all.n_regionkey"),
)
ask(
    "not_not_prop",
    "{doc_id where type='documents' and not not quality}",
    "select doc_id from documents join labels using (doc_id) where quality is not null",
    over=with_documents,
)
ask(
    "group_expr_list",
    "{n_regionkey, 'twice': n_nationkey * 2 where type='nation' group by n_regionkey}",
    "select '@region/' || n_regionkey as n_regionkey, string_agg(n_nationkey * 2 || '.0', '|' order by n_nationkey) as twice from nation group by 1",
    then=joined("twice"),
)


# statement layout


def nation_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation and region as statements; a region's nations are a property of several values."""
    n, r = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    nid, rid = F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")), F.concat(F.lit("region/"), F.col("n_regionkey").cast("string"))
    row = lambda df, s, p, o, t: df.select(s.alias("subject"), F.lit(p).alias("predicate"), o.cast("string").alias("object"), F.lit(t).alias("objecttype"), F.lit("").alias("context"), F.lit(None).cast("array<int>").alias("listpos"))
    rr = F.concat(F.lit("region/"), F.col("r_regionkey").cast("string"))
    return (
        row(n, nid, "name", F.col("n_name"), "L")
        .unionByName(row(n, nid, "key", F.col("n_nationkey"), "integer"))
        .unionByName(row(n, nid, "region", rid, "R"))
        .unionByName(row(n, rid, "nations", F.col("n_nationkey"), "integer"))
        .unionByName(row(r, rr, "name", F.col("r_name"), "L"))
    )


def over_statements(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog(st.entity(nation_statements(spark, sf_dir)))


def values(*cols):
    """Values as texts; a property's values in order."""
    return lambda df: df.withColumns({c: F.array_join(F.array_sort(F.transform(c, st.text_of)), "|") for c in cols})


ask(
    "stmt_star",
    "{id, name, key where region}",
    "select 'nation/' || n_nationkey as id, n_name as name, n_nationkey::varchar as key from nation",
    then=values("name", "key"),
    over=over_statements,
)
ask(
    "stmt_typed_eq",
    "{id, name where key = 3}",
    "select 'nation/' || n_nationkey as id, n_name as name from nation where n_nationkey = 3",
    then=values("name"),
    over=over_statements,
)
ask("stmt_typed_eq_text", "{id, name where key = '3'}", "select 'x' as id, 'x' as name where false", then=values("name"), over=over_statements)
ask(
    "stmt_ref_eq",
    "{id, name where region = @region/1}",
    "select 'nation/' || n_nationkey as id, n_name as name from nation where n_regionkey = 1",
    then=values("name"),
    over=over_statements,
)
ask(
    "stmt_multivalue",
    "{id, nations where nations != 3 and nations < 8}",
    "select 'region/' || n_regionkey as id, string_agg(n_nationkey::varchar, '|' order by n_nationkey::varchar) as "
    "nations from nation group by 1 having bool_or(n_nationkey < 8) and bool_or(n_nationkey <> 3)",
    then=values("nations"),
    over=over_statements,
)
ask(
    "stmt_anti",
    "{id, name where name and not region}",
    "select 'region/' || r_regionkey as id, r_name as name from region",
    then=values("name"),
    over=over_statements,
)
ask(
    "stmt_join",
    "{id, name, 'of': ?r.name where region = ?r and {?r nations}}",
    "select 'nation/' || n_nationkey as id, n_name as name, r_name as of from nation join region on n_regionkey = "
    "r_regionkey",
    then=values("name", "of"),
    over=over_statements,
)
ask(
    "stmt_join_values",
    "{id, 'keys': ?n.name where nations = ?n.key and {?n region}}",
    "select 'region/' || n_regionkey as id, string_agg(n_name, '|' order by n_name) as keys from nation group by "
    "n_regionkey",
    then=values("keys"),
    over=over_statements,
)
ask(
    "stmt_join_left",
    "{id, name, 'of': ?r.name where name and maybe region = ?r}",
    "select 'nation/' || n_nationkey as id, n_name as name, r_name as of from nation join region on n_regionkey = "
    "r_regionkey union all select 'region/' || r_regionkey, r_name, '' from region",
    then=lambda df: values("name", "of")(df).withColumn("of", F.coalesce("of", F.lit(""))),
    over=over_statements,
)
ask(
    "stmt_path",
    "{id, 'of': region.name}",
    "select 'nation/' || n_nationkey as id, r_name as of from nation join region on n_regionkey = r_regionkey",
    then=values("of"),
    over=over_statements,
)
ask(
    "stmt_or",
    "{id, name where key = 3 or region = @region/1}",
    "select 'nation/' || n_nationkey as id, n_name as name from nation where n_nationkey = 3 or n_regionkey = 1",
    then=values("name"),
    over=over_statements,
)
ask(
    "stmt_not",
    "{id, name where region and not (key < 20 or key = 22)}",
    "select 'nation/' || n_nationkey as id, n_name as name from nation where n_nationkey >= 20 and n_nationkey <> "
    "22",
    then=values("name"),
    over=over_statements,
)
ask(
    "stmt_complex",
    "{id, name where key * 2 > key + 10}",
    "select 'nation/' || n_nationkey as id, n_name as name from nation where n_nationkey > 10",
    then=values("name"),
    over=over_statements,
)
ask(
    "stmt_sum",
    "{name, 's': sum(nations), 'n': count(nations), 'a': avg(nations), 'hi': max(nations) group by name}",
    "select r_name as name, sum(n_nationkey)::double as s, count(*) as n, avg(n_nationkey)::double as a, "
    "max(n_nationkey)::varchar as hi from nation join region on n_regionkey = r_regionkey group by r_name",
    then=lambda df: values("hi")(df).where("n > 0"),
    over=over_statements,
)
ask(
    "stmt_count",
    "[count(*), count(nations), sum(nations), total(nations) where nations]",
    "select count(distinct n_regionkey) c0, count(*) c1, sum(n_nationkey)::double c2, sum(n_nationkey)::double c3 "
    "from nation",
    over=over_statements,
)
ask(
    "stmt_functions",
    "[upper(name), key + 1, if(key > 10, 'high', 'low'), isref(region), -key where region]",
    "select upper(n_name) c0, (n_nationkey + 1)::varchar || '.0' c1, case when n_nationkey > 10 then 'high' else "
    "'low' end c2, 'true' c3, case when n_nationkey = 0 then '-0.0' else (-n_nationkey)::varchar || '.0' end c4 "
    "from nation",
    then=values("c0", "c1", "c2", "c3", "c4"),
    over=over_statements,
)
ask(
    "list_map",
    "{id, 'twice': nations * 2}",
    "select 'region/' || n_regionkey as id, string_agg(t, '|' order by t) as twice from (select n_regionkey, "
    "(n_nationkey * 2)::varchar || '.0' as t from nation) group by n_regionkey",
    then=values("twice"),
    over=over_statements,
)
ask(
    "list_product",
    "{id, 'sums': nations + nations}",
    "select 'region/' || a.n_regionkey as id, string_agg(t, '|' order by t) as sums from (select a.n_regionkey, "
    "(a.n_nationkey + b.n_nationkey)::varchar || '.0' as t from nation a join nation b using (n_regionkey)) a group "
    "by a.n_regionkey",
    then=values("sums"),
    over=over_statements,
)
ask(
    "stmt_star_all",
    "{* where region}",
    "select '{\"id\":\"nation/' || n_nationkey || '\",\"properties\":{\"key\":' || n_nationkey || ',\"name\":\"' || n_name || "
    "'\",\"region\":\"@region/' || n_regionkey || '\"}}' as json from nation",
    over=over_statements,
    make=query_json,
)
ask(
    "stmt_order",
    "{id, key where key order by key desc limit 7}",
    "select 'nation/' || n_nationkey as id, n_nationkey::varchar as key from nation order by n_nationkey desc limit "
    "7",
    then=values("key"),
    over=over_statements,
)
ask(
    "stmt_semi",
    "{id, name where region in {name='ASIA'}}",
    "select 'nation/' || n_nationkey as id, n_name as name from nation join region on n_regionkey = r_regionkey "
    "where r_name = 'ASIA'",
    then=values("name"),
    over=over_statements,
)
ask(
    "stmt_not_semi",
    "{id, name where region and region not in {name='ASIA'}}",
    "select 'nation/' || n_nationkey as id, n_name as name from nation join region on n_regionkey = r_regionkey "
    "where r_name <> 'ASIA'",
    then=values("name"),
    over=over_statements,
)
ask(
    "stmt_nested",
    "{?r id, 'members': [{id, key where region = ?r}] where nations}",
    "select 'region/' || n_regionkey as id, string_agg('nation/' || n_nationkey, '|' order by 'nation/' || "
    "n_nationkey) as members from nation group by n_regionkey",
    then=lambda df: df.withColumn("members", F.array_join("members.id", "|")),
    over=over_statements,
)
ask(
    "stmt_depth",
    "{id, region where key < 5 DEPTH 1}",
    "select 'nation/' || n_nationkey as id, '{\"id\":\"region/' || r_regionkey || '\",\"name\":\"' || r_name || "
    "'\",\"nations\":' || ns || '}' as region from nation join region on n_regionkey = r_regionkey join (select "
    "n_regionkey as k, '[' || string_agg(n_nationkey::varchar, ',' order by n_nationkey::varchar) || ']' as ns from "
    "nation group by 1) on k = r_regionkey where n_nationkey < 5",
    over=over_statements,
)
ask(
    "stmt_follow",
    "{id, 'up': follow(id, region, true) where key}",
    "select 'nation/' || n_nationkey as id, 'region/' || n_regionkey as up from nation",
    then=joined("up"),
    over=over_statements,
)
ask(
    "txn_id",
    "{id, 'txn': getTransactionId(name), 'by': getTransactionAuthor(name), 'why': getTransactionComment(name) where "
    "key}",
    "select 'nation/' || n_nationkey as id, 100 + n_nationkey as txn, 'author ' || n_regionkey as by, 'second' as "
    "why from nation",
    over=lambda spark, sf: Catalog(st.entity(nation_statements(spark, sf), log=nation_log(spark, sf))),
)
ask(
    "txn_none",
    "{id, 'txn': getTransactionId(name) where key}",
    "select 'nation/' || n_nationkey as id, null::varchar as txn from nation",
    over=over_statements,
)
ask(
    "group_multivalue_key",
    "{nations, 'n': count(*) group by nations}",
    "select n_nationkey::varchar as nations, count(*) as n from nation group by 1",
    over=over_statements,
)
SQL["stmt_multivalue"] = "select 'region/' || n_regionkey as id, string_agg(n_nationkey::varchar, '|' order by n_nationkey::varchar) as nations from nation group by n_regionkey having bool_or(n_nationkey < 8) and bool_or(n_nationkey <> 3)"



def nation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history of nation_statements: names are added twice, by the region's author; regions in contexts by key."""
    s = nation_statements(spark, sf_dir)
    key = F.split("subject", "/")[1].cast("long")
    row = lambda rev, why: s.select(rev.alias("rev"), F.lit("add").alias("op"), *st.VALUE, F.concat(F.lit("ctx/"), (key % 2).cast("string")).alias("context"), F.lit(why).alias("comment"))
    region = s.where("predicate = 'region'").select("subject", F.concat(F.lit("author "), F.split("object", "/")[1]).alias("author"))
    both = row(key, "first").unionByName(row(key + 100, "second").where("predicate = 'name'"))
    return both.join(region, "subject", "left")


MELT = """melt as (select 'nation/' || n_nationkey as subject, 'name' as predicate, n_name as object, 'L' as objecttype from nation
 union all select 'nation/' || n_nationkey, 'key', n_nationkey::varchar, 'integer' from nation
 union all select 'nation/' || n_nationkey, 'region', 'region/' || n_regionkey, 'R' from nation
 union all select 'region/' || n_regionkey, 'nations', n_nationkey::varchar, 'integer' from nation
 union all select 'region/' || r_regionkey, 'name', r_name, 'L' from region)"""


@plain("stmt_scan", f"with {MELT} select * from melt where predicate = 'region' and objecttype = 'R'")
def stmt_scan(spark, sf):
    return st.scan(nation_statements(spark, sf), predicate="region", objecttype="R").select(*st.VALUE)


@plain("stmt_context_dedupe", f"with {MELT} select *, 'a' as context from melt")
def stmt_context_dedupe(spark, sf):
    s = nation_statements(spark, sf)
    two = s.withColumn("context", F.lit("b")).unionByName(s.withColumn("context", F.lit("a")))
    return st.scan(two, as_quad=False).select(*st.VALUE, "context")


@plain("stmt_to_json", "select 'nation/' || n_nationkey as id, '{\"id\":\"nation/' || n_nationkey || '\",\"key\":' || n_nationkey || ',\"name\":\"' || n_name || '\",\"region\":\"@region/' || n_regionkey || '\"}' as object from nation")
def stmt_to_json(spark, sf):
    return st.to_objects(nation_statements(spark, sf).where(F.col("subject").startswith("nation/")))


@plain("crud_add", f"with {MELT} select * from melt union select 'nation/' || n_nationkey, 'name', upper(n_name), 'L' from nation")
def crud_add(spark, sf):
    s = nation_statements(spark, sf)
    more = s.where("predicate = 'name' and subject like 'nation/%'").withColumn("object", F.upper("object"))
    return store.add(s, more).select(*st.VALUE)


@plain("crud_update", f"with {MELT} select subject, predicate, case when predicate = 'name' and subject like 'nation/%' then 'N:' || object else object end as object, objecttype from melt")
def crud_update(spark, sf):
    s = nation_statements(spark, sf)
    new = s.where("predicate = 'name' and subject like 'nation/%'").withColumn("object", F.concat(F.lit("N:"), "object"))
    return store.update(s, new).select(*st.VALUE)


@plain("crud_replace", f"with {MELT} select * from melt where subject not like 'nation/%' union all select subject, predicate, 'N:' || object, objecttype from melt where predicate = 'name' and subject like 'nation/%'")
def crud_replace(spark, sf):
    s = nation_statements(spark, sf)
    new = s.where("predicate = 'name' and subject like 'nation/%'").withColumn("object", F.concat(F.lit("N:"), "object"))
    return store.replace(s, new).select(*st.VALUE)


@plain("crud_remove", f"with {MELT} select * from melt where subject <> 'region/1' and not (subject = 'nation/3' and predicate = 'name') and not (subject = 'region/0' and predicate = 'nations')")
def crud_remove(spark, sf):
    s = nation_statements(spark, sf)
    one = lambda c: s.where(c)
    return store.remove(s, one("subject = 'region/1'"), one("subject = 'region/0' and predicate = 'nations'"), one("subject = 'nation/3' and predicate = 'name'")).select(*st.VALUE)


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a change log: an error removes what other events of the user added."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_id").alias("rev"), F.when(F.col("event_type") == "error", "remove").otherwise("add").alias("op"), F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("subject"), "ts")


@plain("asof", "select subject, rev from (select 'user/' || user_id as subject, event_id as rev, event_type, row_number() over (partition by user_id order by event_id desc) as n from events where event_id <= 700) where n = 1 and event_type <> 'error'")
def asof(spark, sf):
    return store.as_of(changes(spark, sf), 700, ["subject"])


@plain("last_txn", "select 'user/' || user_id as subject, max(event_id) as txn from events where event_type <> 'error' group by 1")
def last_txn(spark, sf):
    return store.last_transaction(changes(spark, sf), ["subject"]).select("subject", "txn")


@plain("modified_after", "select 'user/' || user_id as subject, max(event_id) as last_rev from events where event_id > 600 group by 1")
def modified_after(spark, sf):
    return store.modified_after(changes(spark, sf), 600)


@plain("merge_conflict_set", "select distinct 'user/' || user_id as subject from events where event_id <= 300 and user_id in (select user_id from events where event_id > 900)")
def merge_conflict_set(spark, sf):
    c = changes(spark, sf)
    return store.conflicts(c.where("rev <= 300"), c.where("rev > 900"))


@plain("rdfs_subclass", "select 'nation/' || n_nationkey as subject, 'region/' || n_regionkey as object from nation union all select 'nation/' || n_nationkey, 'world' from nation union all select 'nation/' || n_nationkey, 'class/' || n_nationkey from nation")
def rdfs_subclass(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet")
    key = F.col("n_nationkey").cast("string")
    row = lambda s, p, o: n.select(s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"), F.lit("R").alias("objecttype"))
    cls, reg = F.concat(F.lit("class/"), key), F.concat(F.lit("region/"), F.col("n_regionkey").cast("string"))
    s = row(F.concat(F.lit("nation/"), key), rdfs.TYPE, cls).union(row(cls, rdfs.SUB_CLASS, reg)).union(row(reg, rdfs.SUB_CLASS, F.lit("world"))).distinct()
    return rdfs.entailed(s).where(F.col("predicate") == rdfs.TYPE).select("subject", "object")


@plain("union_store", f"with {MELT} select subject as id, object as name from melt where predicate = 'name'")
def union_store(spark, sf):
    """Two stores that share statements, queried as one."""
    s = nation_statements(spark, sf)
    both = st.union(s.where("predicate <> 'name' or subject like 'n%'"), s.where("predicate = 'name'"))
    return values("name")(query(spark, Catalog(st.entity(both)), "{id, name}"))


@plain("asof_context", "select 'nation/' || n_nationkey as subject, n_nationkey as rev from nation where n_nationkey % 2 = 1 and n_nationkey <= 10")
def asof_context(spark, sf):
    log = nation_log(spark, sf).where("predicate = 'key'")
    return store.as_of(log, 10, context="ctx/1").select("subject", "rev")


@plain("stmt_list_json", "select 'list/' || n_regionkey as id, '{\"id\":\"list/' || n_regionkey || '\",\"item\":[' || n || ',\"x\",' || n || ']}' as object from (select n_regionkey, min(n_nationkey) as n from nation group by 1)")
def stmt_list_json(spark, sf):
    """Lists in which an item is repeated come back as they were."""
    n = spark.read.parquet(f"{sf}/nation.parquet").groupBy("n_regionkey").agg(F.min("n_nationkey").cast("string").alias("o"))
    row = lambda o, t, at: n.select(F.concat(F.lit("list/"), F.col("n_regionkey").cast("string")).alias("subject"), F.lit("item").alias("predicate"), o.alias("object"), F.lit(t).alias("objecttype"), F.lit("").alias("context"), F.array(*map(F.lit, at)).alias("listpos"))
    return st.to_objects(row(F.col("o"), "integer", [0, 2]).unionByName(row(F.lit("x"), "L", [1])))


@plain("embedded_json", "select 'nation/' || n_nationkey as id, '{\"id\":\"nation/' || n_nationkey || '\",\"place\":{\"key\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}}' as object from nation")
def embedded_json(spark, sf):
    """Embedded objects that one value refers to stand in its place."""
    n = spark.read.parquet(f"{sf}/nation.parquet")
    objects = n.select(F.to_json(F.struct(F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")).alias("id"), F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")).alias("place"))).alias("value"))
    folder = shared_folder(spark)
    objects.write.text(folder)
    got = st.to_objects(formats.read_jsonl(spark, folder), inline=True)
    return got.withColumn("object", F.regexp_replace("object", '"id":"_:[^"]*",', ""))


def _round_trip(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = shared_folder(spark)
        formats.write(nation_statements(spark, sf_dir).repartition(3), folder, kind)
        return formats.read(spark, folder, kind).select(*st.VALUE)

    return run


for _kind in ("ntjson", "jsonl", "json", "mjson"):
    plain(f"roundtrip_{_kind}", f"with {MELT} select * from melt")(_round_trip(_kind))
plain("roundtrip_nt", f"with {MELT} select subject, predicate, object, objecttype from melt")(_round_trip("ntriples"))


@plain("read_nt_replay", "select 'nation/' || n_nationkey as subject, n_name as object, case when n_nationkey % 3 = 0 then '' else 'ctx/' || n_nationkey % 3 end as context from nation where n_nationkey % 4 <> 1")
def read_nt_replay(spark, sf):
    """Adds, removes and contexts apply in the lines' order."""
    n = spark.read.parquet(f"{sf}/nation.parquet").orderBy("n_nationkey").coalesce(1)
    k = F.col("n_nationkey")
    line = F.concat(F.lit("<nation/"), k.cast("string"), F.lit('> <name> "'), "n_name", F.lit('" .'))
    graph = F.when(k % 3 != 0, F.concat(F.lit("#!graph ctx/"), (k % 3).cast("string"), F.lit("\n"))).otherwise("")
    text = F.concat(F.lit("# nation\n"), graph, line, F.when(k % 4 == 1, F.concat(F.lit("\n#!remove\n"), line)).when(k % 4 == 2, F.concat(F.lit("\n#!remove\n"), line, F.lit("\n"), graph, line)).otherwise(""))
    folder = shared_folder(spark)
    n.select(text).write.text(folder)
    return formats.read_ntriples(spark, folder).select("subject", "object", "context")


@plain("read_json", "select 'orders/' || o_orderkey as subject, 'cust' as predicate, 'customer/' || o_custkey as object, 'R' as objecttype from orders union all select 'orders/' || o_orderkey, 'status', o_orderstatus, 'L' from orders")
def read_json(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    folder = shared_folder(spark)
    o.select(F.to_json(F.struct(name("orders/", "o_orderkey").alias("id"), name("@customer/", "o_custkey").alias("cust"), F.col("o_orderstatus").alias("status")))).write.text(folder)
    return formats.read_jsonl(spark, folder).select(*st.VALUE)


@plain("stmt_filter", f"with {MELT} select subject, object::double as number from melt where objecttype = 'integer' and predicate = 'key' union all select subject, null from melt where false")
def stmt_filter(spark, sf):
    """Typed values as native columns."""
    return st.filtered(nation_statements(spark, sf), predicate="key").where("number is not null").select("subject", "number")


@plain("stmt_hints", f"with {MELT} select * from melt order by subject, predicate, object, objecttype limit 20 offset 15")
def stmt_hints(spark, sf):
    return st.scan(nation_statements(spark, sf), limit=20, offset=15).select(*st.VALUE)


@plain("store_log", f"with {MELT} select subject, predicate, case when predicate = 'name' and subject like 'nation/%' then 'N:' || object else object end as object, objecttype from melt where subject <> 'region/1'")
def store_log(spark, sf):
    """An append-only log of N-Triples: three commits, replayed."""
    log, s = LogStore(spark, shared_folder(spark)), nation_statements(spark, sf)
    new = s.where("predicate = 'name' and subject like 'nation/%'").withColumn("object", F.concat(F.lit("N:"), "object"))
    log.commit(lambda df: store.add(df, s))
    log.commit(lambda df: store.update(df, new))
    log.commit(lambda df: store.remove(df, objects=s.where("subject = 'region/1'")))
    return log.read().select(*st.VALUE)


@plain("store_indexed", f"with {MELT} select * from melt where predicate = 'nations' and object = '7' union all select * from melt where subject = 'nation/3'")
def store_indexed(spark, sf):
    kept = IndexedStore(spark, shared_folder(spark))
    kept.commit(lambda df: store.add(df, nation_statements(spark, sf)))
    found = kept.scan(predicate="nations", obj="7").unionByName(kept.scan(subject="nation/3"))
    return found.select(*st.VALUE)


@plain("store_history", "select 'orders/' || o_orderkey as subject, o_orderstatus as object, 1 as rev, 'clerk' as author from orders where o_orderstatus <> 'O' union all select 'orders/' || o_orderkey, 'open', 1, 'clerk' from orders where o_orderstatus = 'O' union all select 'orders/' || o_orderkey, o_orderstatus, 0, 'import' from orders")
def store_history(spark, sf):
    """The log that a store of versions writes: what the second commit added, and the first."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    row = lambda status, context: o.select(F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string")).alias("subject"), F.lit("status").alias("predicate"), status.alias("object"), F.lit("L").alias("objecttype"), F.lit(context).alias("context"), F.lit(None).cast("array<int>").alias("listpos"))
    status = F.col("o_orderstatus")
    s = store.Store(spark, shared_folder(spark))
    s.commit(lambda df: store.add(df, row(status, "")), author="import")
    s.commit(lambda df: store.update(df, row(F.when(status == "O", "open").otherwise(status), "b")), author="clerk", comment="names")
    return s.log().where("op = 'add'").select("subject", "object", F.col("rev").cast("int").alias("rev"), "author")


@plain("crud_create", f"with {MELT} select * from melt union all select 'copy/' || subject, predicate, object, objecttype from melt where subject like 'region/%'")
def crud_create(spark, sf):
    s = nation_statements(spark, sf)
    return store.create(s, s.where("subject like 'region/%'").withColumn("subject", F.concat(F.lit("copy/"), "subject"))).select(*st.VALUE)


@plain("merge_fast_forward", "select 'user/' || user_id as subject, max(event_id) as rev from events where event_id <= 500 group by 1 union all select 'new/' || user_id, max(event_id) + 500 - 599 from events where event_id between 600 and 700 group by 1")
def merge_fast_forward(spark, sf):
    """A branch's changes, made on revision 500 on other subjects, follow the log's."""
    log = changes(spark, sf).drop("ts").where("rev <= 500")
    branch = changes(spark, sf).drop("ts").where("rev between 600 and 700").withColumn("subject", F.regexp_replace("subject", "user", "new"))
    return store.merge(log, branch, 500).groupBy("subject").agg(F.max("rev").alias("rev"))


@plain("revisions", "select 'user/' || user_id as subject, count(*) as n from events group by 1")
def revisions(spark, sf):
    return store.revisions(changes(spark, sf)).select("subject", F.size("revs").cast("long").alias("n"))


@plain("crud_update_all", f"with {MELT} select subject, predicate, case when predicate = 'name' and subject like 'nation/%' then 'N:' || object else object end as object, objecttype from melt where subject <> 'region/1'")
def crud_update_all(spark, sf):
    s = nation_statements(spark, sf)
    new = s.where("predicate = 'name' and subject like 'nation/%'").withColumn("object", F.concat(F.lit("N:"), "object"))
    return store.update_all(s, updated=new, removed=s.where("subject = 'region/1'")).select(*st.VALUE)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(spark, catalog(spark, sf_dir), "{ n_name, 'region': ?r.r_name where n_regionkey = ?r and {?r type='region'} order by n_name limit 10 }")


QUERIES["flagship"] = flagship
SQL["flagship"] = "select n_name, r_name as region from nation join region on n_regionkey = r_regionkey order by n_name limit 10"
