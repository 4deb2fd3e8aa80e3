import pytest

from docweir.operators.writes import MergeFailed
from docweir.plans.context import Context
from docweir.plans.pipeline import run


def plain(df):
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=str)


@pytest.fixture
def ctx(spark, store):
    store.write("c", spark.createDataFrame([("0", 0), ("1", 1)], "_id string, test int"))
    return Context(store=store)


def looked(spark, ctx, value, kind="int", **more):
    df = spark.createDataFrame([("9", value)], f"_id string, test {kind}")
    return run(df, [{"$lookup": {"from": "c", "localField": "test", "foreignField": "test", "as": "r", **more}}], ctx).collect()


def test_lookup(spark, ctx):
    assert [r["_id"] for r in looked(spark, ctx, 0)[0]["r"]] == ["0"]
    assert looked(spark, ctx, 2)[0]["r"] == [] and looked(spark, ctx, 2, inner=True) == []
    assert sorted(r["_id"] for r in looked(spark, ctx, [0, 1, 1], "array<int>")[0]["r"]) == ["0", "1"]
    assert sorted(r["r"]["_id"] for r in looked(spark, ctx, [0, 1], "array<int>", unwind=True)) == ["0", "1"]
    assert looked(spark, ctx, None)[0]["r"] == []


def test_lookup_pipeline(spark, ctx):
    df = spark.createDataFrame([("9", 0), ("8", 5)], "_id string, test int")
    spec = {"from": "c", "let": {"t": "$test"}, "pipeline": [{"$match": {"$expr": {"$gte": ["$test", "$$t"]}}}], "as": "r"}
    assert {r["_id"]: len(r["r"]) for r in run(df, [{"$lookup": spec}], ctx).collect()} == {"9": 2, "8": 0}
    assert len(run(df, [{"$lookup": {**spec, "unwind": True}}], ctx).collect()) == 2
    best = {**spec, "pipeline": [*spec["pipeline"], {"$sort": {"test": -1}}, {"$limit": 1}, {"$project": {"_id": 0, "test": 1}}], "inner": True}
    (r,) = run(df, [{"$lookup": best}], ctx).collect()
    assert r["_id"] == "9" and [x.asDict() for x in r["r"]] == [{"test": 1}]


def test_lookup_elsewhere(spark, ctx, tmp_path):
    from docweir.sources.collections import CollectionStore

    other = CollectionStore(spark, f"file://{tmp_path}/other")
    other.write("c", spark.createDataFrame([("7", 0)], "_id string, test int"))
    ctx.stores["there", "db"] = other
    assert [r["_id"] for r in looked(spark, ctx, 0, connectionString="there", database="db")[0]["r"]] == ["7"]


@pytest.mark.parametrize(
    ("spec", "stored", "told"),
    [
        ({}, {"0": (5, 1), "1": (1, None), "2": (6, 2)}, {"0": (5, 1), "2": (6, 2)}),
        ({"whenMatched": "replace"}, {"0": (5, 1), "1": (1, None), "2": (6, 2)}, {"0": (5, 1), "2": (6, 2)}),
        ({"whenMatched": "keepExisting"}, {"0": (0, None), "1": (1, None), "2": (6, 2)}, {"0": (0, None), "2": (6, 2)}),
        ({"whenNotMatched": "discard"}, {"0": (5, 1), "1": (1, None)}, {"0": (5, 1)}),
    ],
)
def test_merge(spark, ctx, spec, stored, told):
    df = spark.createDataFrame([("0", 5, 1), ("2", 6, 2)], "_id string, test int, more int")
    out = run(df, [{"$merge": {"into": "c", **spec}}], ctx)
    assert {r["_id"]: (r["test"], r["more"]) for r in out.collect()} == told
    assert {r["_id"]: (r["test"], r["more"]) for r in ctx.store.read("c").collect()} == stored


def test_merge_failures_leave_the_collection(spark, ctx):
    df = spark.createDataFrame([("0", 5), ("2", 6)], "_id string, test int")
    before = plain(ctx.store.read("c"))
    for spec in ({"whenMatched": "fail"}, {"whenNotMatched": "fail"}):
        with pytest.raises(MergeFailed):
            run(df, [{"$merge": {"into": "c", **spec}}], ctx)
    with pytest.raises(ValueError):
        run(df, [{"$merge": {"into": "c", "whenMatched": "what"}}], ctx)
    assert plain(ctx.store.read("c")) == before


def test_merge_folds_a_batch_in_order(spark, store):
    df = spark.createDataFrame([(0, "0", 1, None), (1, "0", None, 2), (2, "0", 3, None)], "seq int, _id string, a int, b int")
    run(df, [{"$merge": {"into": "n"}}], Context(store=store, order_by="seq"))
    (r,) = store.read("n").collect()
    assert (r["a"], r["b"]) == (3, 2)


def test_out_delete_deduplicate(spark, ctx):
    df = spark.createDataFrame([("0", 7)], "_id string, test int")
    assert plain(run(df, [{"$out": "c"}], ctx)) == [{"_id": "0", "test": 7}]
    assert plain(ctx.store.read("c")) == [{"_id": "0", "test": 7}, {"_id": "1", "test": 1}]
    assert plain(run(df, [{"$delete": {"from": "c", "on": ["_id", "test"]}}], ctx)) == [{"_id": "0", "test": 7}]
    assert plain(ctx.store.read("c")) == [{"_id": "1", "test": 1}]
    assert run(df, [{"$delete": {"from": "c", "on": "gone"}}], ctx).collect() == []
    two = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "seq int, _id string")
    ordered = Context(store=ctx.store, order_by="seq")
    spec = [{"$deduplicate": {"expression": "$_id", "collection": "seen"}}]
    assert [r["seq"] for r in run(two, spec, ordered).orderBy("seq").collect()] == [0, 1]
    assert run(two, spec, ordered).collect() == [] and ctx.store.read("seen").count() == 2


def test_two_writers_from_one_state(spark, store):
    from docweir.sources.collections import Conflict

    frame = lambda *v: spark.createDataFrame([(x,) for x in v], "_id long")
    store.write("c", frame(1))
    seen = store.number("c")
    store.write("c", frame(1, 2), after=seen)
    with pytest.raises(Conflict):
        store.write("c", frame(1, 3), after=seen)
    assert sorted(r[0] for r in store.read("c").collect()) == [1, 2]


def test_update_repeats_after_another_writer(spark, store):
    frame = lambda *v: spark.createDataFrame([(x,) for x in v], "_id long")
    store.write("c", frame(1))
    turns = []

    def change():
        now = store.read("c")
        if not turns:
            turns.append(1)
            store.write("c", now.union(frame(2)))
        return now.union(frame(3))

    store.update("c", change)
    assert sorted(r[0] for r in store.read("c").collect()) == [1, 2, 3]


def test_old_versions_stay_readable_for_a_while(spark, store):
    frame = lambda v: spark.createDataFrame([(v,)], "_id long")
    store.write("c", frame(0))
    first = store.read("c")
    for v in range(1, 4):
        store.write("c", frame(v))
    assert first.collect()[0][0] == 0 and store.read("c").collect()[0][0] == 3
