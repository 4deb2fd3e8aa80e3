import datetime
import json
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from docweir.operators.http import read_answer
from docweir.plans.context import Context
from docweir.plans.pipeline import run
from docweir.streaming import stateful


def test_per(spark):
    df = spark.createDataFrame([(i, i) for i in range(3)], "seq int, test int")
    out = run(df, [{"$per": {"amount": 2, "as": "b"}}], Context(order_by="seq"))
    assert sorted([x["test"] for x in r["b"]] for r in out.collect()) == [[0, 1], [2]]
    with pytest.raises(ValueError):
        run(df, [{"$per": {"amount": 0, "as": "b"}}])


def test_send_delay_probe(spark):
    df = spark.createDataFrame([(0, "t"), (1, None)], "test int, topic string").withColumn("ts", F.lit("2020-01-01 00:00:30").cast("timestamp"))
    ctx = Context()
    rest = run(df, [{"$probe": {"name": "n", "topic": "p"}}, {"$send": {"topic": "$topic"}}], ctx)
    assert [r["test"] for r in rest.collect()] == [1]
    (kind, topic, probe), (_, _, sent) = ctx.sides
    assert (kind, topic) == ("probe", "p") and probe.collect()[0]["count"] == 2 and [r["topic"] for r in sent.collect()] == ["t"]
    ctx = Context()
    rest = run(df, [{"$delay": {"duration": 5000, "topic": "$topic", "time": "ts"}}], ctx)
    assert [r["test"] for r in rest.collect()] == [1]
    assert str(ctx.sides[0][2].collect()[0]["due_at"]) == "2020-01-01 00:00:35"
    assert run(df, [{"$throttle": {"maxPerSecond": 5}}]) is df
    assert stateful.rate_options({"maxPerSecond": 5}, 2) == ({"maxOffsetsPerTrigger": "10"}, "2 seconds")


def test_scripts(spark):
    df = spark.createDataFrame([("0", 0)], "_id string, test int")
    assert run(df, [{"$jq": ".test |= . + 1"}]).collect()[0]["test"] == 1
    assert run(df, [{"$jq": 'if .test == 0 then {_id, big: "no"} else {_id, big: "yes"} end'}]).collect()[0]["big"] == "no"
    assert run(df, [{"$jq": "select(.test > 0)"}]).collect() == [] and run(df, [{"$jq": "del(.test)"}]).columns == ["_id"]
    assert run(df, [{"$jslt": 'let one = 1 {"test": .test + $one, * : .}'}]).collect()[0].asDict() == {"_id": "0", "test": 1}
    assert run(df, [{"$jslt": '{"a": if (.test < 1) "low" else "high", * - test : .}'}]).collect()[0].asDict() == {"_id": "0", "a": "low"}
    with pytest.raises(ValueError):
        run(df, [{"$jq": "unknown_thing(.test)"}])


def service():
    """A local function, so that it is sent to executors as it is."""

    def answers(method, url, headers, body):
        name = url.rsplit("/", 1)[1]
        if name == "echo":
            return 200, {"content-type": dict(headers).get("Content-Type", "")}, body
        files = {"one": b'{"a": 1}', "two": b'[{"a": 1}, {"a": 2}, 3]', "text": b"x\ny"}
        if name not in files:
            return 404, {"Content-Type": "image/png"}, b"?"
        return 200, {"Content-Type": "text/plain" if name == "text" else "application/json"}, files[name]

    return answers


def asked(spark, name, **more):
    df = spark.createDataFrame([("0", name)], "_id string, name string")
    spec = {"method": "GET", "url": {"$concat": ["http://h/", "$name"]}, "as": "r", **more}
    return [(None if r["r"] is None else json.loads(r["r"].toJson()), r["httpError"]) for r in run(df, [{"$http": spec}], Context(transport=service())).collect()]


def test_http(spark):
    from docweir.shipping import ship

    ship(spark)
    assert asked(spark, "one") == [({"a": 1}, None)] and asked(spark, "text") == [("xy", None)]
    assert asked(spark, "two") == [([{"a": 1}, {"a": 2}], None)]
    assert [v for v, _ in asked(spark, "two", unwind=True)] == [{"a": 1}, {"a": 2}]
    ((value, error),) = asked(spark, "none")
    assert value is None and error["statusCode"] == 404 and error["body"] is None
    assert asked(spark, "one", url="$name")[0][1]["statusCode"] == 400
    assert asked(spark, "echo", method="POST", body={"q": 1}) == [({"q": 1}, None)]
    assert asked(spark, "echo", method="POST", body="words", headers={"Content-Type": "text/html"}) == [("words", None)]
    assert read_answer((200, {"Content-Type": "application/json"}, b"")) == (200, "json", [])


@pytest.fixture
def stream(spark, tmp_path):
    rows = [(i, i % 3, i % 7) for i in range(60)]
    df = spark.createDataFrame(rows, "seq bigint, k int, v int")
    for part in range(2):
        df.where(f"seq div 30 = {part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), tmp_path


def drained(spark, df, name, path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{path}/cp-{name}").trigger(availableNow=True).start()
    end = time.time() + 90
    while q.isActive and time.time() < end:
        q.awaitTermination(1)
    q.stop()
    return spark.table(name)


def test_stream_changelog_equals_batch(spark, stream):
    batch, live, path = stream
    spec = {"_id": "$k", "n": {"$sum": 1}, "most": {"$max": "$v"}, "mean": {"$avg": "$v"}, "set": {"$addToSet": "$v"}}
    ctx = Context(mode="changelog", order_by="seq")
    want = sorted(map(tuple, run(batch, [{"$group": spec}], ctx).collect()))
    got = sorted(map(tuple, drained(spark, stateful.group_changes(live, spec, ctx), "log", path).collect()))
    assert [g[:4] for g in got] == [w[:4] for w in want] and [g[5] for g in got] == [w[5] for w in want]
    assert [g[4] for g in got] == pytest.approx([w[4] for w in want])


def test_stream_deduplicate_and_stateless(spark, stream):
    batch, live, path = stream
    spec = {"expression": {"k": "$k", "v": "$v"}, "collection": "c"}
    assert drained(spark, stateful.deduplicated(live, spec, Context()), "dedup", path).count() == 21
    out = stateful.stateless(live, [{"$match": {"k": 1}}, {"$set": {"w": {"$add": ["$v", 1]}}}])
    assert drained(spark, out, "plain", path).count() == 20
    with pytest.raises(ValueError):
        stateful.stateless(live, [{"$group": {"_id": "$k"}}])


def test_stream_per(spark, stream):
    _, live, path = stream
    out = drained(spark, stateful.batches_of(live, {"amount": 25, "as": "b"}, Context(order_by="seq")), "per", path)
    assert sorted(len(r["b"]) for r in out.collect()) == [25, 25]


def test_by_batch_merges(spark, stream, store):
    batch, live, path = stream
    told = []
    pipeline = [{"$set": {"_id": {"$toString": "$k"}}}, {"$merge": {"into": "latest", "whenMatched": "replace"}}]
    q = stateful.by_batch(live, pipeline, Context(store=store, order_by="seq"), lambda df, n: told.append(n), f"{path}/cp")
    q.awaitTermination(120)
    assert told == [0, 1] and store.read("latest").count() == 3
    assert {r["seq"] for r in store.read("latest").collect()} == {57, 58, 59}


def _wide(spark, n):
    """Wide rows, in partitions that a join's sides would see differently if they were planned anew."""
    df = spark.range(n).select(F.col("id").alias("i"), (F.col("id") % 97).alias("k"), F.array((F.col("id") % 5), (F.col("id") % 7)).alias("ks"), F.repeat(F.lit("x"), 200).alias("pad"))
    return df.repartition(13, "i").filter("i >= 0")


def test_per_keeps_all_rows_of_wide_inputs(spark):
    n = 60_000
    for order in ("i", None):
        got = run(_wide(spark, n), [{"$per": {"amount": 7, "as": "b"}}], Context(order_by=order)).select(F.col("b.i").alias("i")).collect()
        assert sorted(x for r in got for x in r["i"]) == list(range(n))
        assert sorted(len(r["i"]) for r in got) == sorted([7] * (n // 7) + [n % 7] * (n % 7 > 0))
    ordered = run(_wide(spark, n), [{"$per": {"amount": 7, "as": "b"}}], Context(order_by="i")).select(F.col("b.i").alias("i")).collect()
    assert all(list(r["i"]) == list(range(r["i"][0], r["i"][-1] + 1)) and r["i"][0] % 7 == 0 for r in ordered)


def test_lookups_after_a_shuffle_find_their_own_matches(spark, store):
    n = 30_000
    store.write("f", spark.range(100).select(F.col("id").alias("k"), F.concat(F.lit("v"), F.col("id")).alias("v")))
    ctx = Context(store=store)
    by_array = run(_wide(spark, n), [{"$lookup": {"from": "f", "localField": "ks", "foreignField": "k", "as": "m"}}], ctx)
    for r in by_array.select("i", F.col("m.k").alias("k")).collect():
        assert sorted(r["k"]) == sorted({r["i"] % 5, r["i"] % 7})
    pipeline = [{"$match": {"$expr": {"$eq": ["$k", "$$k"]}}}, {"$project": {"v": 1}}]
    by_let = run(_wide(spark, n), [{"$lookup": {"from": "f", "let": {"k": "$k"}, "pipeline": pipeline, "as": "m"}}], ctx)
    got = by_let.select("i", "m.v").collect()
    assert len(got) == n and all(r["v"] == [f"v{r['i'] % 97}"] for r in got)


def test_groups_inside_a_lookup(spark, store):
    store.write("f", spark.createDataFrame([(1, 10), (1, 20), (2, 5), (2, None)], "k long, v long"))
    df, ctx = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, None), (4, 1)], "i long, k long"), Context(store=store)
    mine = [{"$match": {"$expr": {"$eq": ["$k", "$$k"]}}}]

    def found(stages, **more):
        rows = run(df, [{"$lookup": {"from": "f", "let": {"k": "$k"}, "pipeline": mine + stages, "as": "m", **more}}], ctx).collect()
        return {r["i"]: [x.asDict() for x in r["m"]] for r in rows}

    assert found([{"$group": {"_id": None, "s": {"$sum": "$v"}}}]) == {0: [{"_id": None, "s": 30}], 1: [{"_id": None, "s": 5}], 2: [], 3: [], 4: [{"_id": None, "s": 30}]}
    assert found([{"$count": "n"}], inner=True) == {0: [{"n": 2}], 1: [{"n": 2}], 4: [{"n": 2}]}
    assert found([{"$sort": {"v": -1}}, {"$limit": 1}, {"$project": {"v": 1}}])[0] == [{"v": 20}]
    every = run(df, [{"$lookup": {"from": "f", "pipeline": [{"$group": {"_id": "$k"}}], "as": "m"}}], ctx).collect()
    assert len(every) == 5 and all(sorted(x["_id"] for x in r["m"]) == [1, 2] for r in every)
    none = run(df, [{"$lookup": {"from": "f", "pipeline": [{"$match": {"k": 9}}], "as": "m", "inner": True}}], ctx)
    assert none.count() == 0


ACCUMULATORS = {
    "n": {"$count": {}},
    "sum": {"$sum": "$value"},
    "avg": {"$avg": "$value"},
    "low": {"$min": "$value"},
    "high": {"$max": "$when"},
    "last": {"$last": "$when"},
    "first": {"$first": "$value"},
    "all": {"$push": "$value"},
    "set": {"$addToSet": "$event_type"},
    "dev": {"$stdDevPop": "$value"},
    "money": {"$sum": "$price"},
}


def _close(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 1e-9 * max(1, abs(a))


def test_groups_go_on_from_batch_to_batch(spark, store):
    """Parts of an input, one after the other, come to the totals of the whole; a part that is run again changes nothing."""
    rows = [(i, i % 4 if i % 9 else None, None if i % 7 == 0 else i * 1.5, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=i), Decimal(i) / 4, "ab"[i % 2]) for i in range(60)]
    kind = "seq int, user int, value double, when timestamp, price decimal(10,2), event_type string"
    whole = spark.createDataFrame(rows, kind)
    for ident in ("$user", None):
        spec = {"_id": ident, **ACCUMULATORS}
        want = {r["_id"]: r for r in run(whole, [{"$group": spec}], Context(order_by="seq")).collect()}
        own = []
        for number, part in enumerate([rows[:25], rows[25:26], rows[25:26], [], rows[26:]]):
            number -= number > 1  # the second part is run twice
            ctx = Context(store=store, order_by="seq", carry=True, batch=number, app=str(ident))
            told = run(spark.createDataFrame(part, kind), [{"$group": spec}], ctx).collect()
            assert {r["_id"] for r in told} == ({p[1] for p in part} if ident else {None} if part else set())
            own += told
        got = {r["_id"]: r for r in own}
        assert got.keys() == want.keys()
        for k, r in got.items():
            assert all(_close(r[c], want[k][c]) for c in ACCUMULATORS), (r, want[k])


def test_state_without_numbers_and_by_name(spark, store):
    df = spark.createDataFrame([(1, 5), (2, 7)], "k int, v int")
    ctx = Context(store=store, carry=True)
    spec = [{"$group": {"_id": "$k", "s": {"$sum": "$v"}, "_collection": "sums"}}]
    run(df, spec, ctx)
    assert {r["_id"]: r["s"] for r in run(df.where("k = 1"), spec, ctx).collect()} == {1: 10} and store.read("sums").count() == 2
    assert [r["n"] for r in run(df, [{"$count": "n"}], ctx).collect()] == [2] and [r["n"] for r in run(df, [{"$count": "n"}], ctx).collect()] == [4]


def test_by_batch_totals(spark, stream, store):
    batch, live, path = stream
    seen = []
    spec = {"_id": "$k", "n": {"$sum": 1}, "v": {"$max": "$v"}}
    query = stateful.by_batch(live, [{"$group": spec}], Context(store=store, order_by="seq"), lambda df, n: seen.append((n, df.collect())), f"{path}/totals")
    query.awaitTermination()
    want = {r["_id"]: (r["n"], r["v"]) for r in run(batch, [{"$group": spec}]).collect()}
    assert len(seen) > 1 and {r["_id"]: (r["n"], r["v"]) for _, rows in seen for r in rows} == want
    with pytest.raises(ValueError):
        stateful.by_batch(live, [{"$per": {"amount": 2, "as": "b"}}], Context(store=store), lambda df, n: None, f"{path}/per")


def test_min_may_rank_null_first(spark):
    df = spark.createDataFrame([(1, 5), (1, None), (2, 7)], "k int, v int")
    spec = [{"$group": {"_id": "$k", "m": {"$min": "$v"}}}]
    assert {r["_id"]: r["m"] for r in run(df, spec).collect()} == {1: 5, 2: 7}
    assert {r["_id"]: r["m"] for r in run(df, spec, Context(strict_nulls=True)).collect()} == {1: None, 2: 7}


def test_stream_changelog_of_dates_and_decimals(spark, tmp_path):
    """States with dates and decimals survive from one micro-batch to the next."""
    rows = [(i, i % 2, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=(7 * i) % 11), Decimal((5 * i) % 13) / 4) for i in range(20)]
    df = spark.createDataFrame(rows, "seq bigint, k int, at timestamp, price decimal(10,2)")
    for part in range(2):
        df.where(f"seq div 10 = {part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    spec, ctx = {"_id": "$k", "last": {"$max": "$at"}, "low": {"$min": "$price"}}, Context(mode="changelog", order_by="seq")
    want = sorted(map(tuple, run(df, [{"$group": spec}], ctx).collect()))
    assert sorted(map(tuple, drained(spark, stateful.group_changes(live, spec, ctx), "dates", tmp_path).collect())) == want


def test_stream_delay(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1500), (2, None, 1500), (3, "b", 1), (4, "c", None)], "i int, t string, ms long")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    rest, later = stateful.delayed(live, {"duration": "$ms", "topic": "$t"}, Context())
    assert sorted(r["i"] for r in drained(spark, rest, "rest", tmp_path).collect()) == [2, 4]
    began = time.time()
    q = later.writeStream.format("memory").queryName("later").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp-later").trigger(processingTime="200 milliseconds").start()
    seen = {}
    while len(seen) < 2 and time.time() < began + 90:
        for r in spark.table("later").collect():
            seen.setdefault(r["topic"], (time.time(), json.loads(r["doc"])))
        time.sleep(0.1)
    q.stop()
    assert {k: d["i"] for k, (_, d) in seen.items()} == {"a": 1, "b": 3} and seen["a"][0] - began >= 1.5


@pytest.mark.parametrize("kind", ["text/html", "application/rtf", "application/x-www-form-urlencoded", "application/xhtml+xml; charset=utf-8", "image/svg+xml"])
def test_http_text_types(kind):
    assert read_answer((200, {"Content-Type": kind}, b"a\nb")) == (200, "text", ['"ab"'])
    assert read_answer((200, {"Content-Type": "application/xml"}, b"a")) == (200, "other", [])


def test_http_needs_a_key_store(spark):
    df = spark.createDataFrame([("a",)], "name string")
    with pytest.raises(ValueError):
        run(df, [{"$http": {"method": "GET", "url": "http://h/", "as": "r", "sslContext": {"password": "x"}}}], Context())
