import pytest

from docweir.plans.context import Context
from docweir.plans.pipeline import run

LOG = dict(mode="changelog", order_by="seq")


def changes(spark, values, op, kind="int", key=None, arg="$test"):
    df = spark.createDataFrame(list(enumerate(values)), f"seq bigint, test {kind}")
    out = run(df, [{"$group": {"_id": key, "v": {op: arg}}}], Context(**LOG))
    return [r["v"] for r in out.orderBy("seq").collect()]


@pytest.mark.parametrize(
    ("op", "values", "want"),
    [
        ("$addToSet", [2, 1, 2, 0], [[2], [1, 2], [0, 1, 2]]),
        ("$avg", [0, 1, 2, 3], [0.0, 0.5, 1.0, 1.5]),
        ("$last", [0, 1, 2], [0, 1, 2]),
        ("$max", [0, 1, 2, 0], [0, 1, 2]),
        ("$min", [2, 1, 2, 0], [2, 1, 0]),
        ("$push", [2, 1, 2, 0], [[2], [2, 1], [2, 1, 2], [2, 1, 2, 0]]),
    ],
)
def test_changelog(spark, op, values, want):
    assert changes(spark, values, op) == want


def test_deviation(spark):
    assert changes(spark, [0, 1, 2, 3], "$stdDevPop") == pytest.approx([0, 0.5, 0.816497, 1.118034], abs=1e-6)


def test_counts_by_key(spark):
    df = spark.createDataFrame([(0, "0"), (1, "0"), (2, "1"), (3, "0")], "seq bigint, test string")
    out = run(df, [{"$group": {"_id": "$test", "n": {"$count": {}}, "s": {"$sum": 1.5}}}], Context(**LOG)).orderBy("seq").collect()
    assert [(r["_id"], r["n"], r["s"]) for r in out] == [("0", 1, 1.5), ("0", 2, 3.0), ("1", 1, 1.5), ("0", 3, 4.5)]
    assert [r["_id"] for r in run(df, [{"$group": {"_id": "$test"}}], Context(**LOG)).orderBy("seq").collect()] == ["0", "1"]
    assert {r["_id"] for r in run(df, [{"$group": {"_id": "$test"}}]).collect()} == {"0", "1"}


def test_merge_objects(spark):
    df = spark.createDataFrame([(0, None), (1, (0, None)), (2, (None, 0)), (3, (1, None))], "seq bigint, test struct<test1: int, test2: int>")
    out = run(df, [{"$group": {"_id": None, "v": {"$mergeObjects": "$test"}}}], Context(**LOG)).orderBy("seq").collect()
    assert [tuple(r["v"]) for r in out] == [(None, None), (0, None), (0, 0), (1, 0)]
    (final,) = run(df, [{"$group": {"_id": None, "v": {"$mergeObjects": "$test"}}}], Context(order_by="seq")).collect()
    assert tuple(final["v"]) == (1, 0) and final["_id"] is None


def test_buckets_and_count(spark):
    df = spark.createDataFrame([(i,) for i in (0, 1, 5, 10, 12, 18, 19, 22, 26, 56, 60, 70)], "test int")
    spec = {"groupBy": "$test", "boundaries": [0, 10, 20, 30], "default": "other", "output": {"n": {"$sum": 1}}}
    assert {r["_id"]: r["n"] for r in run(df, [{"$bucket": spec}]).collect()} == {"0": 3, "10": 4, "20": 2, "other": 3}
    out = run(df, [{"$count": "test"}])
    assert out.columns == ["test"] and out.collect()[0]["test"] == 12
    assert run(df.limit(0), [{"$count": "test"}]).collect() == []
    with pytest.raises(ValueError):
        run(df, [{"$bucket": {**spec, "boundaries": [1, 1]}}])


def test_unknown_accumulators(spark):
    df = spark.createDataFrame([(1,)], "test int")
    with pytest.raises(ValueError):
        run(df, [{"$group": {"_id": None, "v": {"$median": "$test"}}}])
    assert run(df, [{"$group": {"_id": None, "v": {"$median": "$test"}, "n": {"$sum": 1}}}], Context(strict=False)).columns == ["_id", "n"]


def test_sum_ignores_what_is_no_number(spark):
    df = spark.createDataFrame([("a",)], "test string")
    assert run(df, [{"$group": {"_id": None, "v": {"$sum": "$test"}}}]).collect()[0]["v"] is None
