import pytest

from docweir.plans.context import Context
from docweir.plans.pipeline import create, run


def plain(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_match(spark):
    df = spark.createDataFrame([("0", 0), ("1", 1)], "_id string, test int")
    assert plain(run(df, [{"$match": {"test": 0}}])) == [{"_id": "0", "test": 0}]
    assert plain(run(df, [{"$match": {"test": "0"}}])) == []
    assert plain(run(df, [{"$match": {"none": None}}])) == plain(df)


def test_match_is_pushed_down(spark, tmp_path):
    spark.range(10).selectExpr("id", "id * 2 as v").write.parquet(f"{tmp_path}/t")
    out = run(spark.read.parquet(f"{tmp_path}/t"), [{"$match": {"id": {"$gte": 5}}}, {"$project": {"id": 1}}])
    text = out._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(id,5)" in text and "ReadSchema: struct<id:bigint>" in text


def test_add_fields_replaces_adds_and_builds_parents(spark):
    df = spark.createDataFrame([("0", 0, (0,))], "_id string, test1 int, test3 struct<test: int>")
    out = run(df, [{"$addFields": {"test1": 1, "test2": 2, "test3.test": 3, "test4.test.test1": 4, "test4.test.test2": "$test1"}}])
    assert plain(out) == [{"_id": "0", "test1": 1, "test3": {"test": 3}, "test2": 2, "test4": {"test": {"test1": 4, "test2": 0}}}]


def test_add_fields_over_null(spark):
    df = spark.createDataFrame([("0", None)], "_id string, a struct<b: int>")
    assert plain(run(df, [{"$set": {"a.b.c": 3}}])) == [{"_id": "0", "a": {"b": {"c": 3}}}]


SHAPE = "_id string, test1 int, test2 int, test3 struct<test1: int, test2: int>, test4 struct<test1: int, test2: int, test3: int>, test5 struct<test: int>"
ROW = [("0", 0, 0, (0, 0), (0, 0, 0), (0,))]


@pytest.mark.parametrize(
    ("spec", "want"),
    [
        ({"test1": 0, "test3.test1": 0}, {"_id": "0", "test2": 0, "test3": {"test2": 0}, "test4": {"test1": 0, "test2": 0, "test3": 0}, "test5": {"test": 0}}),
        ({"_id": 0, "test1": 1, "test4.test2": 1}, {"test1": 0, "test4": {"test2": 0}}),
        ({"test3": 1}, {"_id": "0", "test3": {"test1": 0, "test2": 0}}),
        ({"test3": {"test1": 1}}, {"_id": "0", "test3": {"test1": 0}}),
        ({"test1": 10, "test2": 1}, {"_id": "0", "test1": 10, "test2": 0}),
        ({"_id": 0}, {"test1": 0, "test2": 0, "test3": {"test1": 0, "test2": 0}, "test4": {"test1": 0, "test2": 0, "test3": 0}, "test5": {"test": 0}}),
    ],
)
def test_project(spark, spec, want):
    assert plain(run(spark.createDataFrame(ROW, SHAPE), [{"$project": spec}])) == [want]


def test_project_mixed_modes_and_remove(spark):
    df = spark.createDataFrame(ROW, SHAPE)
    with pytest.raises(ValueError):
        run(df, [{"$project": {"test1": 0, "test2": 1}}])
    with pytest.raises(ValueError):
        run(df, [{"$project": {}}])
    two = spark.createDataFrame([("0", 0), ("1", 1)], "_id string, test int")
    out = run(two, [{"$project": {"test": {"$cond": {"if": {"$eq": ["$test", 0]}, "then": "$$REMOVE", "else": "$test"}}}}])
    assert [r["test"] for r in plain(out)] == [None, 1]


def test_unset(spark):
    df = spark.createDataFrame([("0", 0, (0,))], "_id string, test1 int, test2 struct<test: int>")
    assert plain(run(df, [{"$unset": "test1"}])) == [{"_id": "0", "test2": {"test": 0}}]
    assert plain(run(df, [{"$unset": ["test1", "test2.test", 5]}])) == [{"_id": "0", "test2": {}}]


def test_replace(spark):
    df = spark.createDataFrame([("0", "k", (("1", 0),))], "_id string, _key string, test struct<test: struct<_id: string, test: int>>")
    want = [{"_key": "1", "_id": "1", "test": 0}]
    assert plain(run(df, [{"$replaceRoot": {"newRoot": "$test.test"}}])) == want
    assert plain(run(df, [{"$replaceWith": "$test.test"}])) == want
    assert run(df, [{"$replaceWith": "$_id"}]).columns == df.columns


def test_set_key(spark):
    df = spark.createDataFrame([("0", "1")], "_id string, test string")
    assert plain(run(df, [{"$setKey": "$test"}])) == [{"_id": "0", "test": "1", "_key": "1"}]


def test_unwind(spark):
    df = spark.createDataFrame([("0", [0, 1]), ("1", []), ("2", None)], "_id string, test array<int>")
    assert plain(run(df, [{"$unwind": "$test"}])) == [{"_id": "0", "test": 0}, {"_id": "0", "test": 1}]
    out = plain(run(df, [{"$unwind": {"path": "$test", "preserveNullAndEmptyArrays": True, "includeArrayIndex": "i"}}]))
    assert [(r["_id"], r["test"], r["i"]) for r in out] == [("0", 0, 0), ("0", 1, 1), ("1", None, None), ("2", None, None)]
    ids = plain(run(df, [{"$unwind": {"path": "$test", "newIds": True}}]))
    assert all(r["_id"] == r["_key"] for r in ids) and len({r["_id"] for r in ids}) == 2
    assert plain(run(spark.createDataFrame([("0", 1)], "_id string, test int"), [{"$unwind": "$test"}])) == []


def test_redact(spark):
    kind = "test: int, v: int, sub: struct<test: int>"
    df = spark.createDataFrame(
        [("0", 0, (1, 5), (0, 6, (2,)), (2, 7), [(1, 8, (2,)), (0, 9, (1,)), (2, 10, (1,))])],
        f"_id string, test int, test1 struct<test: int, v: int>, test2 struct<{kind}>, test3 struct<test: int, v: int>, test4 array<struct<{kind}>>",
    )
    rule = {"$switch": {"branches": [{"case": {"$eq": ["$test", 1]}, "then": "$$KEEP"}, {"case": {"$eq": ["$test", 2]}, "then": "$$PRUNE"}], "default": "$$DESCEND"}}
    (r,) = plain(run(df, [{"$redact": rule}]))
    assert r["test1"] == {"test": 1, "v": 5} and r["test3"] is None and r["test2"] == {"test": 0, "v": 6, "sub": None}
    assert r["test4"] == [{"test": 1, "v": 8, "sub": {"test": 2}}, {"test": 0, "v": 9, "sub": {"test": 1}}]
    assert plain(run(df.withColumn("test", df["test"] + 2), [{"$redact": rule}])) == []


def test_pipeline_rules(spark):
    df = spark.createDataFrame([("0", 0)], "_id string, test int")
    assert create([])(df) is df
    with pytest.raises(ValueError):
        create([{"$nothing": 1}])
    assert create([{"$nothing": 1}, "text"], Context(strict=False))(df) is df
    own = Context(stages={"$twice": lambda d, s, c: d.union(d), "$match": None})
    assert run(df, '[{"$twice": {}}, {"$match": {"test": 0}, "_trace": true}]', own).count() == 2


@pytest.mark.parametrize("stage", [{"$addFields": 1}, {"$match": []}, {"$bucket": {"boundaries": [1]}}, {"$count": 1}, {"$deduplicate": {}}, {"$delete": {"from": "a"}}, {"$group": {}}, {"$http": {"url": "x"}}, {"$lookup": {"from": "a"}}, {"$merge": {}}, {"$out": 1}, {"$per": {"amount": 1}}, {"$probe": {"name": "a"}}, {"$replaceRoot": {}}, {"$send": {}}, {"$throttle": {"maxPerSecond": "x"}}, {"$unset": 1}, {"$unwind": {}}, {"$jq": 1}, {"$jslt": {}}, {"$delay": {}}])
def test_specs_are_checked(spark, stage):
    with pytest.raises(ValueError):
        run(spark.createDataFrame([("0", 0)], "_id string, test int"), [stage])


def test_expressions(spark):
    df = spark.createDataFrame([("0", 3, "abc", [1, 2, 3], None)], "_id string, n int, s string, xs array<int>, nothing int")
    cases = {
        "eq_types": ({"$eq": ["$n", "3"]}, False),
        "null_first": ({"$lt": ["$nothing", "$n"]}, True),
        "type_order": ({"$lt": ["$n", "$s"]}, True),
        "if_null": ({"$ifNull": ["$nothing", 7]}, 7),
        "map": ({"$map": {"input": "$xs", "as": "x", "in": {"$multiply": ["$$x", 2]}}}, [2, 4, 6]),
        "filter": ({"$filter": {"input": "$xs", "cond": {"$gt": ["$$this", 1]}}}, [2, 3]),
        "reduce": ({"$reduce": {"input": "$xs", "initialValue": 0, "in": {"$add": ["$$value", "$$this"]}}}, 6),
        "let": ({"$let": {"vars": {"a": {"$add": ["$n", 1]}}, "in": {"$multiply": ["$$a", "$$a"]}}}, 16),
        "slice": ({"$slice": ["$xs", -2]}, [2, 3]),
        "at": ({"$arrayElemAt": ["$xs", -1]}, 3),
        "missing": ({"$size": {"$ifNull": ["$none", []]}}, 0),
        "in": ({"$in": [2, "$xs"]}, True),
        "type": ({"$type": "$s"}, "string"),
        "range": ({"$range": [0, 5, 2]}, [0, 2, 4]),
        "sub": ({"$substrCP": ["$s", 1, 2]}, "bc"),
        "union": ({"$setUnion": ["$xs", [3, 4]]}, [1, 2, 3, 4]),
        "to_int": ({"$toInt": "12"}, 12),
        "regex": ({"$regexMatch": {"input": "$s", "regex": "B", "options": "i"}}, True),
        "merged": ({"$mergeObjects": [{"a": 1, "b": 2}, {"b": 3}]}, {"a": 1, "b": 3}),
        "pairs": ({"$objectToArray": {"$literal": {"a": 1}}}, [{"k": "a", "v": 1}]),
        "any": ({"$anyElementTrue": [[False, True]]}, True),
        "none_of": ({"$not": [{"$or": [False, {"$and": [True, False]}]}]}, True),
        "trim": ({"$trim": {"input": "  a "}}, "a"),
    }
    (row,) = plain(run(df, [{"$project": {k: v for k, (v, _) in cases.items()}}]))
    assert {k: row[k] for k in cases} == {k: w for k, (_, w) in cases.items()}


def test_queries_on_arrays(spark):
    df = spark.createDataFrame([(1, [1, 2], [("a", 1)]), (2, [3], [("b", 2)])], "_id int, xs array<int>, os array<struct<k: string, v: int>>")
    ids = lambda q: [r["_id"] for r in run(df, [{"$match": q}]).collect()]
    assert ids({"xs": 1}) == [1] and ids({"xs": {"$all": [1, 2]}}) == [1] and ids({"xs": {"$size": 1}}) == [2]
    assert ids({"xs": {"$elemMatch": {"$gt": 2}}}) == [2] and ids({"os": {"$elemMatch": {"k": "a", "v": {"$lt": 2}}}}) == [1]
    assert ids({"os.k": "b"}) == [2] and ids({"xs": {"$gte": 2}}) == [1, 2]
