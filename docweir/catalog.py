"""Queries by name over the driver's tables, and the SQL that each must equal."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweir.operators.writes import MergeFailed
from docweir.plans.context import Context
from docweir.plans.pipeline import run
from docweir.shared import shared_base
from docweir.sources.collections import CollectionStore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def store(spark: SparkSession) -> CollectionStore:
    """Collections of one query, below the shared folder."""
    return CollectionStore(spark, f"{shared_base(spark)}/collections-{uuid.uuid4().hex}")


def stages(name: str, table: str, pipeline: list, sql: str, finish: Callable[[DataFrame], DataFrame] | None = None, **context) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        out = run(df, pipeline, Context(**context))
        return finish(out) if finish else out

    QUERIES[name], SQL[name] = query, sql


def custom(name: str, sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


PRICE = {"$multiply": ["$l_extendedprice", {"$subtract": [1, "$l_discount"]}]}

# match
stages("match_eq", "lineitem", [{"$match": {"l_returnflag": "R"}}, {"$project": {"l_orderkey": 1, "l_linenumber": 1, "l_quantity": 1}}], "select l_orderkey, l_linenumber, l_quantity from lineitem where l_returnflag = 'R'")
stages("match_range", "lineitem", [{"$match": {"l_quantity": {"$gte": 10, "$lt": 20}, "l_discount": {"$gt": 0.05}}}, {"$project": {"l_orderkey": 1, "l_linenumber": 1}}], "select l_orderkey, l_linenumber from lineitem where l_quantity >= 10 and l_quantity < 20 and l_discount > 0.05")
stages("match_in", "orders", [{"$match": {"o_orderstatus": {"$in": ["F", "P"]}, "o_orderpriority": {"$nin": ["1-URGENT"]}}}, {"$project": {"o_orderkey": 1, "o_orderstatus": 1}}], "select o_orderkey, o_orderstatus from orders where o_orderstatus in ('F', 'P') and o_orderpriority not in ('1-URGENT')")
stages("match_or", "events", [{"$match": {"$or": [{"event_type": "purchase"}, {"value": {"$lt": 10}}], "$nor": [{"user_id": 3}]}}, {"$project": {"event_id": 1}}], "select event_id from events where (event_type = 'purchase' or value < 10) and user_id <> 3")
stages("match_regex", "customer", [{"$match": {"c_name": {"$regex": "1$"}, "c_mktsegment": {"$not": {"$regex": "^b", "$options": "i"}}}}, {"$project": {"c_custkey": 1}}], "select c_custkey from customer where regexp_matches(c_name, '1$') and not regexp_matches(c_mktsegment, '^b', 'i')")
stages("match_expr", "orders", [{"$match": {"$expr": {"$gt": ["$o_totalprice", {"$multiply": ["$o_custkey", 100]}]}}}, {"$project": {"o_orderkey": 1}}], "select o_orderkey from orders where o_totalprice > o_custkey * 100")
stages("match_mod_exists", "part", [{"$match": {"p_partkey": {"$mod": [7, 3]}, "p_name": {"$exists": True}, "p_size": {"$ne": 5}, "p_retailprice": {"$type": "double"}}}, {"$project": {"p_partkey": 1}}], "select p_partkey from part where p_partkey % 7 = 3 and p_size <> 5")
# fields
stages("project_include", "orders", [{"$project": {"o_orderkey": 1, "o_totalprice": 1}}], "select o_orderkey, o_totalprice from orders")
stages("project_exclude", "customer", [{"$project": {"c_name": 0, "c_acctbal": 0}}], "select * exclude (c_name, c_acctbal) from customer")
stages("project_computed", "orders", [{"$project": {"o_orderkey": 1, "half": {"$divide": ["$o_totalprice", 2]}, "ten": 10, "year": {"$year": "$o_orderdate"}}}], "select o_orderkey, o_totalprice / 2 as half, 10 as ten, cast(year(o_orderdate) as integer) as year from orders")
stages("project_remove", "lineitem", [{"$project": {"l_orderkey": 1, "l_linenumber": 1, "flag": {"$cond": [{"$eq": ["$l_returnflag", "N"]}, "$$REMOVE", "$l_returnflag"]}}}], "select l_orderkey, l_linenumber, case when l_returnflag = 'N' then null else l_returnflag end as flag from lineitem")
stages("add_fields", "lineitem", [{"$addFields": {"price": PRICE}}, {"$project": {"l_orderkey": 1, "l_linenumber": 1, "price": 1}}], "select l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) as price from lineitem")
stages("set_fields", "nation", [{"$set": {"n_name": {"$toLower": "$n_name"}, "n_regionkey": {"$add": ["$n_regionkey", 1]}}}], "select n_nationkey, lower(n_name) as n_name, n_regionkey + 1 as n_regionkey from nation")
stages("unset_fields", "supplier", [{"$unset": ["s_name", "s_nationkey"]}], "select s_suppkey, s_acctbal from supplier")
stages("add_fields_nested", "events", [{"$addFields": {"meta.kind": "$event_type", "meta.size.twice": {"$multiply": ["$value", 2]}}}, {"$project": {"event_id": 1, "kind": "$meta.kind", "twice": "$meta.size.twice"}}], "select event_id, event_type as kind, value * 2 as twice from events")
stages("replace_root", "events", [{"$addFields": {"inner": {"event_id": "$event_id", "user": "$user_id"}}}, {"$replaceRoot": {"newRoot": "$inner"}}], "select event_id, user_id as \"user\" from events")
stages("replace_with", "events", [{"$replaceWith": {"event_id": "$event_id", "label": {"$concat": ["$event_type", ":", {"$toString": "$user_id"}]}}}], "select event_id, event_type || ':' || user_id as label from events")
stages("set_key", "customer", [{"$setKey": "$c_custkey"}, {"$project": {"c_custkey": 1}}], "select c_custkey, cast(c_custkey as varchar) as _key from customer")
stages("json_props", "events", [{"$project": {"event_id": 1, "k": {"$variantGet": {"input": {"$parseJson": {"input": "$props"}}, "path": "$.k", "type": "bigint"}}}}], "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
WORDS = {"$addFields": {"word": {"$split": ["$text", " "]}}}
stages("unwind", "conversations", [WORDS, {"$unwind": "$word"}, {"$project": {"conv_id": 1, "turn": 1, "word": 1}}], "select conv_id, turn, unnest(string_split(text, ' ')) as word from conversations")
stages("unwind_index", "embeddings", [{"$unwind": {"path": "$embedding", "includeArrayIndex": "i"}}, {"$project": {"vec_id": 1, "embedding": 1, "i": 1}}], "select vec_id, unnest(embedding) as embedding, unnest(range(len(embedding))) as i from embeddings")
stages("unwind_preserve", "events", [{"$addFields": {"big": {"$filter": {"input": ["$value"], "as": "v", "cond": {"$gt": ["$$v", 50]}}}}}, {"$unwind": {"path": "$big", "preserveNullAndEmptyArrays": True, "includeArrayIndex": "i"}}, {"$project": {"event_id": 1, "big": 1, "i": 1}}], "select event_id, case when value > 50 then value end as big, cast(case when value > 50 then 0 end as bigint) as i from events")
stages(
    "redact",
    "customer",
    [
        {"$addFields": {"level": 2, "own.level": {"$cond": [{"$gt": ["$c_acctbal", 0]}, 1, 0]}, "own.balance": "$c_acctbal"}},
        {"$redact": {"$switch": {"branches": [{"case": {"$eq": ["$level", 2]}, "then": "$$DESCEND"}, {"case": {"$eq": ["$level", 1]}, "then": "$$KEEP"}], "default": "$$PRUNE"}}},
        {"$project": {"c_custkey": 1, "balance": "$own.balance"}},
    ],
    "select c_custkey, case when c_acctbal > 0 then c_acctbal end as balance from customer",
)
stages(
    "expressions",
    "part",
    [
        {
            "$project": {
                "p_partkey": 1,
                "size_class": {"$switch": {"branches": [{"case": {"$lt": ["$p_size", 10]}, "then": "small"}, {"case": {"$lt": ["$p_size", 30]}, "then": "middle"}], "default": "large"}},
                "root": {"$round": [{"$sqrt": "$p_retailprice"}, 6]},
                "upper": {"$toUpper": {"$substrCP": ["$p_name", 0, 4]}},
                "at": {"$indexOfCP": ["$p_type", "A"]},
                "whole": {"$trunc": "$p_retailprice"},
                "total": {"$reduce": {"input": [1, 2, "$p_size"], "initialValue": 0, "in": {"$add": ["$$value", "$$this"]}}},
                "cmp": {"$cmp": ["$p_size", 25]},
                "rest": {"$mod": ["$p_partkey", 5]},
                "text": {"$replaceAll": {"input": "$p_brand", "find": "#", "replacement": "-"}},
            }
        }
    ],
    "select p_partkey, case when p_size < 10 then 'small' when p_size < 30 then 'middle' else 'large' end as size_class, round(sqrt(p_retailprice), 6) as root, upper(substring(p_name, 1, 4)) as upper, cast(strpos(p_type, 'A') - 1 as integer) as at, cast(trunc(p_retailprice) as bigint) as whole, p_size + 3 as total, case when p_size = 25 then 0 when p_size < 25 then -1 else 1 end as cmp, p_partkey % 5 as rest, replace(p_brand, '#', '-') as text from part",
)
stages("dates", "orders", [{"$project": {"o_orderkey": 1, "month": {"$month": "$o_orderdate"}, "day": {"$dayOfMonth": "$o_orderdate"}, "text": {"$dateToString": {"date": "$o_orderdate", "format": "%Y/%m/%d"}}, "weekday": {"$dayOfWeek": "$o_orderdate"}}}], "select o_orderkey, cast(month(o_orderdate) as integer) as month, cast(day(o_orderdate) as integer) as day, strftime(o_orderdate, '%Y/%m/%d') as text, cast(dayofweek(o_orderdate) + 1 as integer) as weekday from orders")
# group
FLAGS = {"flag": "$l_returnflag", "status": "$l_linestatus"}


def _split(df: DataFrame) -> DataFrame:
    return df.select("_id.*", *[c for c in df.columns if c != "_id"])


def _rounded(*names: str, digits: int = 4) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.select(*[F.round(c, digits).alias(c) if c in names else F.col(f"`{c}`") for c in df.columns])


stages("group_sum", "lineitem", [{"$group": {"_id": "$l_returnflag", "n": {"$sum": 1}, "quantity": {"$sum": "$l_quantity"}, "price": {"$sum": PRICE}}}], "select l_returnflag as _id, count(*) as n, round(sum(l_quantity), 2) as quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) as price from lineitem group by 1", _rounded("quantity", "price", digits=2))
stages("group_avg", "orders", [{"$group": {"_id": "$o_orderpriority", "mean": {"$avg": "$o_totalprice"}}}], "select o_orderpriority as _id, round(avg(o_totalprice), 4) as mean from orders group by 1", _rounded("mean"))
stages("group_min_max", "orders", [{"$group": {"_id": "$o_custkey", "low": {"$min": "$o_totalprice"}, "high": {"$max": "$o_orderdate"}}}], "select o_custkey as _id, min(o_totalprice) as low, max(o_orderdate) as high from orders group by 1")
stages("group_count", "events", [{"$group": {"_id": "$event_type", "n": {"$count": {}}}}], "select event_type as _id, count(*) as n from events group by 1")
stages("group_std", "events", [{"$group": {"_id": "$event_type", "spread": {"$stdDevPop": "$value"}}}], "select event_type as _id, round(stddev_pop(value), 6) as spread from events group by 1", _rounded("spread", digits=6))
_JOINED = lambda c: lambda df: df.select("_id", F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c))
stages("group_push", "events", [{"$group": {"_id": "$user_id", "ids": {"$push": "$event_id"}}}], "select user_id as _id, string_agg(cast(event_id as varchar), ',' order by event_id) as ids from events group by 1", _JOINED("ids"), order_by="event_id")
stages("group_add_to_set", "events", [{"$group": {"_id": "$user_id", "kinds": {"$addToSet": "$event_type"}}}], "select user_id as _id, string_agg(distinct event_type, ',' order by event_type) as kinds from events group by 1", _JOINED("kinds"))
stages("group_last", "events", [{"$group": {"_id": "$user_id", "last": {"$last": "$value"}, "first": {"$first": "$value"}}}], "select user_id as _id, arg_max(value, event_id) as last, arg_min(value, event_id) as first from events group by 1", order_by="event_id")
stages("group_merge", "events", [{"$group": {"_id": "$user_id", "all": {"$mergeObjects": {"kind": "$event_type", "big": {"$cond": [{"$gt": ["$value", 50]}, "$value", None]}}}}}], "select user_id as _id, arg_max(event_type, event_id) as kind, arg_max(value, event_id) filter (where value > 50) as big from events group by 1", lambda df: df.select("_id", "all.*"), order_by="event_id")
stages("group_composite_key", "lineitem", [{"$group": {"_id": FLAGS, "n": {"$sum": 1}}}], "select l_returnflag as flag, l_linestatus as status, count(*) as n from lineitem group by 1, 2", _split)
stages("group_global", "orders", [{"$group": {"_id": None, "n": {"$sum": 1}, "most": {"$max": "$o_totalprice"}}}], "select cast(null as varchar) as _id, count(*) as n, max(o_totalprice) as most from orders")
stages("group_distinct", "lineitem", [{"$group": {"_id": FLAGS}}], "select distinct l_returnflag as flag, l_linestatus as status from lineitem", lambda df: df.select("_id.*"))
stages("group_changelog_max", "events", [{"$group": {"_id": "$user_id", "most": {"$max": "$value"}}}], "with s as (select event_id, user_id, max(value) over w as v, row_number() over w as rn from events window w as (partition by user_id order by event_id)), t as (select *, lag(v) over (partition by user_id order by event_id) as b from s) select event_id, user_id as _id, v as most from t where rn = 1 or v is distinct from b", mode="changelog", order_by="event_id")
stages("group_changelog_sum", "events", [{"$group": {"_id": "$event_type", "n": {"$sum": 1}, "last": {"$last": "$user_id"}}}], "select event_id, event_type as _id, count(*) over w as n, user_id as last from events window w as (partition by event_type order by event_id rows unbounded preceding)", mode="changelog", order_by="event_id")
stages("group_changelog_distinct", "events", [{"$group": {"_id": "$user_id"}}], "select min(event_id) as event_id, user_id as _id from events group by user_id", mode="changelog", order_by="event_id")
BUCKETS = [0, 50000, 100000, 200000]
stages("bucket", "orders", [{"$match": {"o_totalprice": {"$gte": 0, "$lt": 200000}}}, {"$bucket": {"groupBy": "$o_totalprice", "boundaries": BUCKETS, "output": {"n": {"$sum": 1}}}}], "select case when o_totalprice < 50000 then 0 when o_totalprice < 100000 then 50000 else 100000 end as _id, count(*) as n from orders where o_totalprice >= 0 and o_totalprice < 200000 group by 1")
stages("bucket_default", "orders", [{"$bucket": {"groupBy": "$o_totalprice", "boundaries": BUCKETS, "default": "other", "output": {"n": {"$sum": 1}, "most": {"$max": "$o_totalprice"}}}}], "select case when o_totalprice >= 0 and o_totalprice < 50000 then '0' when o_totalprice >= 50000 and o_totalprice < 100000 then '50000' when o_totalprice >= 100000 and o_totalprice < 200000 then '100000' else 'other' end as _id, count(*) as n, max(o_totalprice) as most from orders group by 1")
stages("count", "orders", [{"$count": "n"}], "select count(*) as n from orders")
stages("count_changelog", "customer", [{"$count": "n"}], "select c_custkey, row_number() over (order by c_custkey) as n from customer", mode="changelog", order_by="c_custkey")


# lookup
def _lookup(name: str, table: str, into: str, spec: dict, sql: str, finish: Callable[[DataFrame], DataFrame], before: list | None = None) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = store(spark)
        own.write(into, read(spark, sf_dir, into))
        return finish(run(read(spark, sf_dir, table), [*(before or []), {"$lookup": {"from": into, **spec}}], Context(store=own)))

    QUERIES[name], SQL[name] = query, sql


_lookup("lookup_array", "customer", "orders", {"localField": "c_custkey", "foreignField": "o_custkey", "as": "orders"}, "select c_custkey, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey group by 1", lambda df: df.select("c_custkey", F.size("orders").cast("long").alias("n")))
_lookup("lookup_inner", "customer", "orders", {"localField": "c_custkey", "foreignField": "o_custkey", "as": "orders", "inner": True}, "select c_custkey, count(*) as n from customer join orders on o_custkey = c_custkey group by 1", lambda df: df.select("c_custkey", F.size("orders").cast("long").alias("n")))
_lookup("lookup_unwind", "nation", "region", {"localField": "n_regionkey", "foreignField": "r_regionkey", "as": "region", "unwind": True}, "select n_nationkey, r_name from nation join region on r_regionkey = n_regionkey", lambda df: df.select("n_nationkey", "region.r_name"))
_lookup("lookup_multi", "nation", "region", {"localField": "keys", "foreignField": "r_regionkey", "as": "regions"}, "select n_nationkey, count(r_regionkey) as n from nation left join region on r_regionkey = n_regionkey or r_regionkey = n_nationkey % 5 group by 1", lambda df: df.select("n_nationkey", F.size("regions").cast("long").alias("n")), [{"$addFields": {"keys": ["$n_regionkey", {"$mod": ["$n_nationkey", 5]}]}}])
_lookup("lookup_pipeline", "customer", "orders", {"let": {"c": "$c_custkey", "b": "$c_acctbal"}, "pipeline": [{"$match": {"$expr": {"$and": [{"$eq": ["$o_custkey", "$$c"]}, {"$gte": ["$o_totalprice", "$$b"]}]}}}, {"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$limit": 2}, {"$project": {"o_orderkey": 1}}], "as": "best", "unwind": True}, "select c_custkey, o_orderkey from (select c_custkey, o_orderkey, row_number() over (partition by c_custkey order by o_totalprice desc, o_orderkey) as rn from customer join orders on o_custkey = c_custkey and o_totalprice >= c_acctbal) where rn <= 2", lambda df: df.select("c_custkey", "best.o_orderkey"))


# writes
def _ids(df: DataFrame) -> DataFrame:
    return df.select(F.col("c_custkey").alias("_id"), "c_name", "c_acctbal", "c_mktsegment")


SHIFT = 100


def _merged(name: str, spec: dict, sql: str, stage: str = "$merge") -> None:
    """The collection holds all customers; all of them come in, changed and with ids that are SHIFT higher."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = store(spark)
        all_ = _ids(read(spark, sf_dir, "customer"))
        own.write("customers", all_)
        arg = spec if isinstance(spec, str) else {("from" if stage == "$delete" else "into"): "customers", **spec}
        new = [{"$set": {"_id": {"$add": ["$_id", SHIFT]}, "c_acctbal": {"$add": ["$c_acctbal", 1]}}}, {"$unset": "c_mktsegment"}]
        run(all_, [*new, {stage: arg}], Context(store=own))
        return own.read("customers")

    QUERIES[name], SQL[name] = query, sql


_BASE = "with o as (select c_custkey as _id, c_name, c_acctbal, c_mktsegment from customer), n as (select c_custkey + 100 as _id, c_name, c_acctbal + 1 as c_acctbal from customer) "
_merged("merge_merge", {}, _BASE + "select coalesce(o._id, n._id) as _id, coalesce(n.c_name, o.c_name) as c_name, coalesce(n.c_acctbal, o.c_acctbal) as c_acctbal, o.c_mktsegment from o full join n on o._id = n._id")
_merged("merge_replace", {"whenMatched": "replace"}, _BASE + "select coalesce(o._id, n._id) as _id, coalesce(n.c_name, o.c_name) as c_name, coalesce(n.c_acctbal, o.c_acctbal) as c_acctbal, case when n._id is null then o.c_mktsegment end as c_mktsegment from o full join n on o._id = n._id")
_merged("merge_keep", {"whenMatched": "keepExisting"}, _BASE + "select coalesce(o._id, n._id) as _id, coalesce(o.c_name, n.c_name) as c_name, coalesce(o.c_acctbal, n.c_acctbal) as c_acctbal, o.c_mktsegment from o full join n on o._id = n._id")
_merged("merge_discard", {"whenNotMatched": "discard"}, _BASE + "select o._id, coalesce(n.c_name, o.c_name) as c_name, coalesce(n.c_acctbal, o.c_acctbal) as c_acctbal, o.c_mktsegment from o left join n on o._id = n._id")
_merged("out", "customers", SQL["merge_replace"], "$out")
_merged("delete", {"on": "_id"}, _BASE + "select o.* from o anti join n on o._id = n._id", "$delete")


@custom("deduplicate", "select event_id, user_id, event_type from events qualify row_number() over (partition by user_id, event_type order by event_id) = 1")
def _deduplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = [{"$deduplicate": {"expression": {"u": "$user_id", "t": "$event_type"}, "collection": "seen"}}, {"$project": {"event_id": 1, "user_id": 1, "event_type": 1}}]
    return run(read(spark, sf_dir, "events"), spec, Context(store=store(spark), order_by="event_id"))


# flow
stages("per", "events", [{"$per": {"amount": 10, "as": "batch"}}], "select count(*) as n, min(event_id) as first, round(sum(value), 4) as total from (select *, (row_number() over (order by event_id) - 1) // 10 as g from events) group by g", lambda df: df.select(F.size("batch").cast("long").alias("n"), F.array_min("batch.event_id").alias("first"), F.round(F.aggregate("batch.value", F.lit(0.0), lambda a, x: a + x), 4).alias("total")), order_by="event_id")


def _aside(name: str, stage: dict, sql: str, finish: Callable[[DataFrame], DataFrame]) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ctx = Context()
        run(read(spark, sf_dir, "events"), [stage], ctx)
        return finish(ctx.sides[0][2])

    QUERIES[name], SQL[name] = query, sql


TOPIC = {"$cond": [{"$gt": ["$value", 50]}, "$event_type", None]}
_aside("probe", {"$probe": {"name": "p", "topic": "probes"}}, "select 'p' as name, date_trunc('minute', ts) as minute, count(*) as count from events group by 2", lambda df: df)
_aside("send", {"$send": {"topic": TOPIC}}, "select event_id, event_type as topic from events where value > 50", lambda df: df.select("event_id", "topic"))
_aside("delay", {"$delay": {"duration": 1500, "topic": TOPIC, "time": "ts"}}, "select event_id, event_type as topic, ts + interval 1500 milliseconds as due_at from events where value > 50", lambda df: df.select("event_id", "topic", "due_at"))
stages("send_rest", "events", [{"$send": {"topic": TOPIC}}, {"$project": {"event_id": 1}}], "select event_id from events where not coalesce(value > 50, false)")
stages("throttle", "events", [{"$throttle": {"maxPerSecond": 10}}], "select * from events")
stages("trace", "events", [{"$trace": "$value"}], "select * from events")
stages("back_trace", "events", [{"$backTrace": {"name": "here"}}], "select * from events")
# scripts
stages("jq", "events", [{"$jq": "select(.value > 20) | .value |= . * 2 | {event_id, value, kind: .event_type}"}], "select event_id, value * 2 as value, event_type as kind from events where value > 20")
stages("jslt", "region", [{"$jslt": '{"r_name": lowercase(.r_name), "big": if (.r_regionkey > 2) "yes" else "no", * : .}'}], "select r_regionkey, lower(r_name) as r_name, case when r_regionkey > 2 then 'yes' else 'no' end as big from region")


def _answer(method: str, url: str, headers: list, body: bytes | None):
    key = int(url.rsplit("/", 1)[1])
    if key % 5 == 4:
        return 404, {}, b""
    return 200, {"Content-Type": "application/json"}, b'{"twice": %d}' % (2 * key)


@custom("http", "select n_nationkey, case when n_nationkey % 5 <> 4 then n_nationkey * 2 end as twice, case when n_nationkey % 5 = 4 then 404 end as status from nation")
def _http(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docweir.shipping import ship

    ship(spark)
    url = {"$concat": ["http://service/", {"$toString": "$n_nationkey"}]}
    out = run(read(spark, sf_dir, "nation"), [{"$http": {"method": "GET", "url": url, "as": "result", "schema": "twice int"}}], Context(transport=_answer))
    return out.select("n_nationkey", "result.twice", F.col("httpError.statusCode").alias("status"))


@custom("user_stage", "select n_nationkey, n_nationkey + 5 as moved from nation")
def _user_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = {"$move": lambda df, spec, ctx: df.withColumn("moved", F.col("n_nationkey") + spec["by"])}
    return run(read(spark, sf_dir, "nation"), [{"$move": {"by": 5}}, {"$project": {"n_nationkey": 1, "moved": 1}}], Context(stages=own))


FLAGSHIP = [{"$match": {"event_type": "purchase"}}, {"$group": {"_id": "$user_id", "n": {"$sum": 1}, "total": {"$sum": "$value"}}}, {"$project": {"n": 1, "total": 1}}]
stages("flagship", "events", FLAGSHIP, "select user_id as _id, count(*) as n, round(sum(value), 4) as total from events where event_type = 'purchase' group by 1", _rounded("total"))
stages(
    "pricing_summary",
    "lineitem",
    [
        {"$match": {"l_shipdate": {"$lte": "1998-09-02"}}},
        {"$group": {"_id": FLAGS, "sum_qty": {"$sum": "$l_quantity"}, "sum_base": {"$sum": "$l_extendedprice"}, "sum_disc": {"$sum": PRICE}, "sum_charge": {"$sum": {"$multiply": [PRICE, {"$add": [1, "$l_tax"]}]}}, "avg_qty": {"$avg": "$l_quantity"}, "n": {"$count": {}}}},
    ],
    "select l_returnflag as flag, l_linestatus as status, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) as sum_charge, round(avg(l_quantity), 2) as avg_qty, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2",
    lambda df: _rounded("sum_qty", "sum_base", "sum_disc", "sum_charge", "avg_qty", digits=2)(_split(df)),
)

# After a shuffle, rows lie in other partitions whenever they are planned anew.
_lookup("lookup_after_group", "lineitem", "orders", {"localField": "_id", "foreignField": "o_orderkey", "as": "order"}, "select l_orderkey as _id, count(*) as n, any_value(o_totalprice) as price from lineitem join orders on o_orderkey = l_orderkey group by 1", lambda df: df.select("_id", "n", F.try_element_at("order.o_totalprice", F.lit(1)).alias("price")), [{"$group": {"_id": "$l_orderkey", "n": {"$sum": 1}}}])
_lookup("lookup_array_after_group", "events", "nation", {"localField": "keys", "foreignField": "n_nationkey", "as": "nations"}, "select user_id as _id, count(n_nationkey) as n, sum(n_nationkey)::bigint as s from (select distinct user_id from events) left join nation on n_nationkey = user_id % 25 or n_nationkey = user_id % 7 group by 1", lambda df: df.select("_id", F.size("nations").cast("long").alias("n"), F.aggregate("nations.n_nationkey", F.lit(0).cast("long"), lambda a, x: a + x).alias("s")), [{"$group": {"_id": "$user_id"}}, {"$addFields": {"keys": [{"$toInt": {"$mod": ["$_id", 25]}}, {"$toInt": {"$mod": ["$_id", 7]}}]}}])
_lookup("lookup_group", "customer", "orders", {"let": {"c": "$c_custkey"}, "pipeline": [{"$match": {"$expr": {"$eq": ["$o_custkey", "$$c"]}}}, {"$group": {"_id": "$o_orderstatus", "n": {"$sum": 1}, "most": {"$max": "$o_totalprice"}}}], "as": "by", "unwind": True}, "select c_custkey, o_orderstatus as status, count(*) as n, max(o_totalprice) as most from customer join orders on o_custkey = c_custkey group by 1, 2", lambda df: df.select("c_custkey", F.col("by._id").alias("status"), "by.n", "by.most"))
_lookup("lookup_count", "nation", "customer", {"let": {"n": "$n_nationkey"}, "pipeline": [{"$match": {"$expr": {"$eq": ["$c_nationkey", "$$n"]}}}, {"$count": "n"}], "as": "c", "unwind": True}, "select n_nationkey, count(*) as n from nation join customer on c_nationkey = n_nationkey group by 1", lambda df: df.select("n_nationkey", "c.n"))
_lookup("lookup_uncorrelated", "nation", "region", {"pipeline": [{"$match": {"r_regionkey": {"$gt": 2}}}], "as": "r"}, "select n_nationkey, (select count(*) from region where r_regionkey > 2) as n from nation", lambda df: df.select("n_nationkey", F.size("r").cast("long").alias("n")))
stages("per_wide", "lineitem", [{"$addFields": {"pad": {"$concat": ["$l_returnflag", "$l_linestatus"]}}}, {"$group": {"_id": {"o": "$l_orderkey", "l": "$l_linenumber"}, "q": {"$sum": "$l_quantity"}}}, {"$addFields": {"place": {"$add": [{"$multiply": ["$_id.o", 10]}, "$_id.l"]}}}, {"$per": {"amount": 7, "as": "batch"}}], "select count(*) as n, min(p) as first, sum(q) as total from (select l_orderkey * 10 + l_linenumber as p, sum(l_quantity) as q, (row_number() over (order by l_orderkey * 10 + l_linenumber) - 1) // 7 as g from lineitem group by l_orderkey, l_linenumber) group by g", lambda df: df.select(F.size("batch").cast("long").alias("n"), F.array_min("batch.place").alias("first"), F.aggregate("batch.q", F.lit(0.0), lambda a, x: a + x).alias("total")), order_by="place")
stages("group_min_null", "events", [{"$group": {"_id": "$user_id", "low": {"$min": {"$cond": [{"$gt": ["$value", 95]}, None, "$value"]}}}}], "select user_id as _id, case when bool_or(value > 95) then null else min(value) end as low from events group by 1", strict_nulls=True)


@custom("group_carried", "select l_returnflag as _id, count(*) as n, sum(l_quantity) as q, max(l_discount) as d from lineitem group by 1")
def _carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table in two parts, one after the other: the second one's groups go on from the first one's state."""
    ctx, rows = Context(store=store(spark), carry=True), read(spark, sf_dir, "lineitem")
    stage = [{"$group": {"_id": "$l_returnflag", "n": {"$sum": 1}, "q": {"$sum": "$l_quantity"}, "d": {"$max": "$l_discount"}}}]
    run(rows.where("l_linenumber < 4"), stage, ctx)
    return run(rows.where("l_linenumber >= 4"), stage, ctx)


# functions, by group
def _functions(name: str, table: str, key: str, own: dict[str, tuple[object, str]], before: list | None = None) -> None:
    stages(name, table, [*(before or []), {"$project": {key: 1, **{n: e for n, (e, _) in own.items()}}}], f"select {key}, " + ", ".join(f"{s} as {n}" for n, (_, s) in own.items()) + f" from {table}")


_functions("functions_logic", "orders", "o_orderkey", {
    "a_and": ({"$and": [{"$gt": ["$o_totalprice", 1000]}, {"$lt": ["$o_custkey", 500]}]}, "o_totalprice > 1000 and o_custkey < 500"),
    "a_or": ({"$or": [{"$gte": ["$o_totalprice", 100000]}, {"$lte": ["$o_custkey", 50]}]}, "o_totalprice >= 100000 or o_custkey <= 50"),
    "a_not": ({"$not": [{"$eq": ["$o_orderstatus", "F"]}]}, "o_orderstatus <> 'F'"),
    "a_ne": ({"$ne": ["$o_orderstatus", "F"]}, "o_orderstatus <> 'F'"),
    "a_cmp": ({"$cmp": ["$o_custkey", 500]}, "sign(o_custkey - 500)::int"),
    "a_cond": ({"$cond": [{"$gt": ["$o_custkey", 500]}, "high", "low"]}, "case when o_custkey > 500 then 'high' else 'low' end"),
    "a_switch": ({"$switch": {"branches": [{"case": {"$eq": ["$o_orderstatus", "F"]}, "then": "done"}, {"case": {"$eq": ["$o_orderstatus", "O"]}, "then": "open"}], "default": "other"}}, "case o_orderstatus when 'F' then 'done' when 'O' then 'open' else 'other' end"),
    "a_in": ({"$in": ["$o_orderstatus", ["F", "P"]]}, "o_orderstatus in ('F', 'P')"),
    "a_null": ({"$ifNull": [{"$cond": [{"$gt": ["$o_custkey", 500]}, None, "$o_orderstatus"]}, "none"]}, "case when o_custkey > 500 then 'none' else o_orderstatus end"),
    "a_let": ({"$let": {"vars": {"x": {"$add": ["$o_custkey", 1]}}, "in": {"$multiply": ["$$x", "$$x"]}}}, "(o_custkey + 1) * (o_custkey + 1)"),
})
_functions("functions_math", "lineitem", "l_orderkey", {
    "l_linenumber": ("$l_linenumber", "l_linenumber"),
    "m_add": ({"$add": ["$l_orderkey", "$l_linenumber", 1]}, "l_orderkey + l_linenumber + 1"),
    "m_subtract": ({"$subtract": ["$l_orderkey", "$l_linenumber"]}, "l_orderkey - l_linenumber"),
    "m_multiply": ({"$multiply": ["$l_quantity", "$l_linenumber"]}, "l_quantity * l_linenumber"),
    "m_divide": ({"$divide": ["$l_quantity", 4.0]}, "l_quantity / 4.0::double"),
    "m_mod": ({"$mod": ["$l_orderkey", 7]}, "l_orderkey % 7"),
    "m_abs": ({"$abs": {"$subtract": ["$l_linenumber", 4]}}, "abs(l_linenumber - 4)"),
    "m_ceil": ({"$ceil": "$l_extendedprice"}, "ceil(l_extendedprice)::bigint"),
    "m_floor": ({"$floor": "$l_extendedprice"}, "floor(l_extendedprice)::bigint"),
    "m_trunc": ({"$trunc": {"$multiply": ["$l_discount", -37.5]}}, "trunc(l_discount * -37.5::double)::bigint"),
    "m_sqrt": ({"$round": [{"$sqrt": "$l_quantity"}, 6]}, "round(sqrt(l_quantity), 6)"),
    "m_pow": ({"$pow": ["$l_linenumber", 3]}, "pow(l_linenumber, 3)"),
    "m_exp": ({"$round": [{"$exp": "$l_discount"}, 6]}, "round(exp(l_discount), 6)"),
    "m_ln": ({"$round": [{"$ln": "$l_quantity"}, 6]}, "round(ln(l_quantity), 6)"),
    "m_log": ({"$round": [{"$log": ["$l_quantity", 3]}, 6]}, "round(ln(l_quantity) / ln(3), 6)"),
    "m_log10": ({"$round": [{"$log10": "$l_quantity"}, 6]}, "round(log10(l_quantity), 6)"),
    "m_max": ({"$max": ["$l_linenumber", 4]}, "greatest(l_linenumber, 4)"),
    "m_min": ({"$min": ["$l_linenumber", 4]}, "least(l_linenumber, 4)"),
    "m_sum": ({"$sum": ["$l_linenumber", 4]}, "l_linenumber + 4"),
})
_functions("functions_string", "customer", "c_custkey", {
    "s_concat": ({"$concat": ["$c_name", "/", "$c_mktsegment"]}, "c_name || '/' || c_mktsegment"),
    "s_upper": ({"$toUpper": "$c_name"}, "upper(c_name)"),
    "s_lower": ({"$toLower": "$c_mktsegment"}, "lower(c_mktsegment)"),
    "s_substr": ({"$substrCP": ["$c_name", 2, 5]}, "substr(c_name, 3, 5)"),
    "s_length": ({"$strLenCP": "$c_name"}, "length(c_name)::int"),
    "s_split": ({"$arrayElemAt": [{"$split": ["$c_name", "#"]}, 1]}, "string_split(c_name, '#')[2]"),
    "s_index": ({"$indexOfCP": ["$c_mktsegment", "I"]}, "(instr(c_mktsegment, 'I') - 1)::int"),
    "s_trim": ({"$trim": {"input": {"$concat": ["  ", "$c_name", " "]}}}, "c_name"),
    "s_ltrim": ({"$ltrim": {"input": {"$concat": ["xx", "$c_mktsegment", "xx"]}, "chars": "x"}}, "c_mktsegment || 'xx'"),
    "s_rtrim": ({"$rtrim": {"input": {"$concat": ["xx", "$c_mktsegment", "xx"]}, "chars": "x"}}, "'xx' || c_mktsegment"),
    "s_replace": ({"$replaceAll": {"input": "$c_mktsegment", "find": "I", "replacement": "ii"}}, "replace(c_mktsegment, 'I', 'ii')"),
    "s_match": ({"$regexMatch": {"input": "$c_mktsegment", "regex": "^b.*g$", "options": "i"}}, "regexp_matches(c_mktsegment, '^b.*g$', 'i')"),
})
_functions("functions_date", "orders", "o_orderkey", {
    "d_year": ({"$year": "$o_orderdate"}, "year(o_orderdate)::int"),
    "d_month": ({"$month": "$o_orderdate"}, "month(o_orderdate)::int"),
    "d_day": ({"$dayOfMonth": "$o_orderdate"}, "day(o_orderdate)::int"),
    "d_week": ({"$dayOfWeek": "$o_orderdate"}, "(dayofweek(o_orderdate) + 1)::int"),
    "d_of_year": ({"$dayOfYear": "$o_orderdate"}, "dayofyear(o_orderdate)::int"),
    "d_hour": ({"$hour": "$o_orderdate"}, "hour(o_orderdate)::int"),
    "d_minute": ({"$minute": "$o_orderdate"}, "minute(o_orderdate)::int"),
    "d_second": ({"$second": "$o_orderdate"}, "second(o_orderdate)::int"),
    "d_trunc": ({"$dateToString": {"date": {"$dateTrunc": {"date": "$o_orderdate", "unit": "month"}}, "format": "%Y-%m-%d"}}, "strftime(date_trunc('month', o_orderdate), '%Y-%m-%d')"),
    "d_text": ({"$dateToString": {"date": "$o_orderdate", "format": "%Y/%m/%d %H:%M:%S"}}, "strftime(o_orderdate, '%Y/%m/%d %H:%M:%S')"),
    "d_back": ({"$year": {"$dateFromString": {"dateString": {"$dateToString": {"date": "$o_orderdate", "format": "%Y-%m-%d"}}, "format": "%Y-%m-%d"}}}, "year(o_orderdate)::int"),
})
_LIST = {"$addFields": {"xs": [{"$toInt": {"$mod": ["$user_id", 5]}}, {"$toInt": {"$mod": ["$user_id", 3]}}, 4, 4], "ys": [1, 4, 9]}}
_XS, _YS = "[(user_id % 5)::int, (user_id % 3)::int, 4, 4]", "[1, 4, 9]"
_functions("functions_array", "events", "event_id", {
    "r_size": ({"$size": "$xs"}, "4::int"),
    "r_at": ({"$arrayElemAt": ["$xs", 1]}, "(user_id % 3)::int"),
    "r_back": ({"$arrayElemAt": ["$xs", -4]}, "(user_id % 5)::int"),
    "r_first": ({"$first": "$xs"}, "(user_id % 5)::int"),
    "r_last": ({"$last": "$xs"}, "4::int"),
    "r_slice": ({"$sum": [{"$arrayElemAt": [{"$slice": ["$xs", 1, 2]}, 0]}, {"$size": {"$slice": ["$xs", -3]}}]}, "(user_id % 3)::int + 3"),
    "r_reverse": ({"$arrayElemAt": [{"$reverseArray": "$xs"}, 3]}, "(user_id % 5)::int"),
    "r_range": ({"$size": {"$range": [0, "$x", 2]}}, "len(range(0, (user_id % 5)::int, 2))::int"),
    "r_union": ({"$size": {"$setUnion": ["$xs", "$ys"]}}, f"len(list_distinct(list_concat({_XS}, {_YS})))::int"),
    "r_both": ({"$size": {"$setIntersection": ["$xs", "$ys"]}}, f"len(list_intersect({_XS}, {_YS}))::int"),
    "r_less": ({"$size": {"$setDifference": ["$xs", "$ys"]}}, f"len(list_filter(list_distinct({_XS}), lambda x: not list_contains({_YS}, x)))::int"),
    "r_concat": ({"$size": {"$concatArrays": ["$xs", "$ys"]}}, "7::int"),
    "r_is": ({"$isArray": ["$xs"]}, "true"),
    "r_in": ({"$in": [3, "$xs"]}, f"list_contains({_XS}, 3)"),
    "r_map": ({"$reduce": {"input": {"$map": {"input": "$xs", "as": "v", "in": {"$multiply": ["$$v", 2]}}}, "initialValue": 0, "in": {"$add": ["$$value", "$$this"]}}}, f"list_sum({_XS})::int * 2"),
    "r_filter": ({"$size": {"$filter": {"input": "$xs", "as": "v", "cond": {"$gt": ["$$v", 1]}}}}, f"len(list_filter({_XS}, lambda x: x > 1))::int"),
    "r_any": ({"$anyElementTrue": [[{"$gt": ["$x", 3]}, {"$lt": ["$x", 1]}]]}, "user_id % 5 > 3 or user_id % 5 < 1"),
    "r_all": ({"$allElementsTrue": [[{"$gt": ["$x", 0]}, {"$lt": ["$x", 4]}]]}, "user_id % 5 > 0 and user_id % 5 < 4"),
}, [_LIST, {"$addFields": {"x": {"$first": "$xs"}}}])
_functions("functions_object", "events", "event_id", {
    "o_get": ({"$getField": {"field": "kind", "input": "$o"}}, "event_type"),
    "o_set": ({"$getField": {"field": "more", "input": {"$setField": {"field": "more", "input": "$o", "value": "$user_id"}}}}, "user_id"),
    "o_merge": ({"$getField": {"field": "kind", "input": {"$mergeObjects": ["$o", {"kind": "x"}]}}}, "'x'"),
    "o_list": ({"$size": {"$objectToArray": "$t"}}, "2::int"),
    "o_key": ({"$arrayElemAt": [{"$map": {"input": {"$objectToArray": "$t"}, "as": "e", "in": "$$e.k"}}, 1]}, "'b'"),
    "o_json": ({"$variantGet": {"input": {"$parseJson": {"input": "$props"}}, "path": "$.k", "type": "int"}}, "json_extract(props, '$.k')::int"),
}, [{"$addFields": {"o": {"kind": "$event_type", "id": "$event_id"}, "t": {"a": "$event_type", "b": "x"}}}])
_functions("functions_type", "customer", "c_custkey", {
    "t_type": ({"$concat": [{"$type": "$c_custkey"}, " ", {"$type": "$c_name"}, " ", {"$type": "$c_acctbal"}, " ", {"$type": {"$eq": [1, 1]}}]}, "'long string double bool'"),
    "t_int": ({"$toInt": "$c_acctbal"}, "trunc(c_acctbal)::int"),
    "t_long": ({"$toLong": {"$toString": "$c_custkey"}}, "c_custkey"),
    "t_double": ({"$toDouble": {"$toString": "$c_custkey"}}, "c_custkey::double"),
    "t_string": ({"$toString": "$c_custkey"}, "c_custkey::varchar"),
    "t_bad": ({"$toInt": "$c_name"}, "try_cast(c_name as int)"),
    "t_bool": ({"$toBool": "$c_name"}, "true"),
    "t_date": ({"$year": {"$toDate": "2021-03-04 05:06:07"}}, "2021::int"),
})
stages("match_array", "events", [_LIST, {"$match": {"$or": [{"xs": {"$all": [3, 1]}}, {"xs": {"$elemMatch": {"$gt": 1, "$lt": 3}}}], "ys": {"$size": 3}}}, {"$project": {"event_id": 1}}], f"select event_id from events where (list_contains({_XS}, 3) and list_contains({_XS}, 1)) or len(list_filter({_XS}, lambda x: x > 1 and x < 3)) > 0")
stages("unwind_new_ids", "events", [{"$match": {"user_id": {"$lt": 5}}}, _LIST, {"$addFields": {"_id": "$event_id"}}, {"$unwind": {"path": "$ys", "newIds": True}}, {"$project": {"event_id": 1, "ys": 1, "_id": 1}}], "select event_id, ys, true as fresh from events, unnest([1, 4, 9]) as t(ys) where user_id < 5", lambda df: df.select("event_id", "ys", (F.length(F.col("_id").cast("string")) > 20).alias("fresh")))


def _fails(name: str, arg: dict) -> None:
    @custom(name, "select 1::bigint as failed, count(*) as kept from customer")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """A merge that must fail leaves the collection as it was."""
        own, all_ = store(spark), _ids(read(spark, sf_dir, "customer"))
        own.write("customers", all_)
        try:
            run(all_.withColumn("_id", F.col("_id") + SHIFT), [{"$merge": {"into": "customers", **arg}}], Context(store=own))
            failed = 0
        except MergeFailed:
            failed = 1
        return own.read("customers").agg(F.lit(failed).cast("long").alias("failed"), F.count(F.lit(1)).alias("kept"))


_fails("merge_matched_fail", {"whenMatched": "fail"})
_fails("merge_unmatched_fail", {"whenNotMatched": "fail"})
