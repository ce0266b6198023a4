"""Readers, stores, types, models and parameters that have no SQL."""

import random

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler

from tasklore.functions import scalars
from tasklore.operators import items
from tasklore.plans import models, replay
from tasklore.sources import store


def test_state_and_cache(spark, tmp_path):
    frame = spark.createDataFrame([(1, 2.0, "a"), (2, 3.0, None)], "user_id long, score double, name string")
    store.save_state(frame, str(tmp_path / "state"))
    got = store.load_state(spark, str(tmp_path / "state"), spark.createDataFrame([(2,), (2,)], "user_id long")).collect()
    assert [(r["user_id"], r["state"]["score"], r["text"]) for r in got] == [(2, 3.0, '{"score":3.0}')]
    calls = []

    def made(n, frame):
        calls.append(n)
        return frame.limit(n)

    for n, given in ((1, frame), (1, frame), (2, frame), (1, frame.where("user_id = 2"))):
        assert store.cached(made, spark, str(tmp_path / "cache"), n=n, frame=given).count() == min(n, given.count())
    assert calls == [1, 2, 1]


def test_types_come_back(spark):
    frame = spark.createDataFrame([(1, 0.5)], "a long, b double")
    small = scalars.narrow_floats(frame)
    assert dict(small.dtypes)["b"] == "float" and scalars.restored(small, frame).dtypes == frame.dtypes
    with pytest.raises(ValueError):
        scalars.select_columns(frame, ["a", "c"])


def test_batches_that_are_missing(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="deal"):
        replay.load_batches(spark, str(tmp_path / "none"))


def test_power_transform_makes_skewed_columns_straight(spark):
    rng = random.Random(3)
    frame = spark.createDataFrame([(k, rng.gauss(5, 2), rng.lognormvariate(0, 1)) for k in range(3000)], "k long, a double, b double")
    assert {r["column"]: r["power"] for r in models.scaling_plan(frame, ["a", "b"]).collect()} == {"a": False, "b": True}
    out = models.scaled(frame, ["b", "a"])
    assert out.columns == ["k", "a", "b"]
    facts = out.selectExpr("avg(a) ma", "stddev_pop(a) sa", "avg(b) mb", "stddev_pop(b) sb", "skewness(b) kb").first()
    assert [facts[k] for k in ("ma", "sa", "mb", "sb")] == pytest.approx([0, 1, 0, 1], abs=1e-6) and abs(facts["kb"]) < 0.3


def test_parameters_and_bundle(spark, tmp_path):
    drawn = models.random_parameters({"depth": (2, 6), "rate": (0.0, 1.0), "kind": ["a", "b"]}, 20, seed=1)
    assert drawn == models.random_parameters({"depth": (2, 6), "rate": (0.0, 1.0), "kind": ["a", "b"]}, 20, seed=1)
    assert all(2 <= x["depth"] <= 6 and 0 <= x["rate"] <= 1 and x["kind"] in "ab" for x in drawn)
    frame = spark.createDataFrame([(1, 2.0)], "user_id long, x double")
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="v")]).fit(frame)
    models.save_bundle(str(tmp_path / "bundle"), {"one": model}, frame, {"best": 0.8})
    found, state, facts = models.load_bundle(spark, str(tmp_path / "bundle"))
    assert facts == {"best": 0.8} and state.count() == 1 and "v" in found["one"].transform(frame).columns


def test_communities_of_items(spark):
    rows = [(k, t) for k, t in enumerate(["a b", "a b", "a c", "b c", "x y", "x z", "x z", "y z"])] + [(8, "lone")]
    got = {r["k"]: r["community"] for r in items.item_communities(spark.createDataFrame(rows, "k long, t string"), "k", "t").collect()}
    assert len({got[k] for k in range(4)}) == 1 and len({got[k] for k in range(4, 8)}) == 1 and len(set(got.values())) == 3


def test_weighted_starts_favour_both_ends(spark):
    rows = spark.range(1000).selectExpr("(id + 0.5) / 1000 as u")
    got = rows.select(replay.weighted_start(rows["u"], __import__("pyspark").sql.functions.lit(10), __import__("pyspark").sql.functions.lit(3)).alias("p")).groupBy("p").count().collect()
    by = {r["p"]: r["count"] for r in got}
    weights = [(3 / (k + 1)) ** 0.5 if k < 3 else (3 / (10 - k)) ** 0.5 if k >= 7 else 1 for k in range(10)]
    assert all(abs(by[k] - 1000 * w / sum(weights)) <= 2 for k, w in enumerate(weights))


def test_three_tables_load_together(spark, tmp_path):
    from tasklore.sources import logs

    rows = [(u, t) for u in (3, 1, 2) for t in range(4)]
    head = "row_id,timestamp,user_id,content_id,content_type_id,task_container_id,user_answer,answered_correctly,prior_question_elapsed_time,prior_question_had_explanation\n"
    (tmp_path / "train.csv").write_text(head + "".join(f"{k},{t},{u},7,0,{t},1,1,,true\n" for k, (u, t) in enumerate(rows)))
    (tmp_path / "questions.csv").write_text("question_id,bundle_id,correct_answer,part,tags\n7,7,1,2,1 2\n")
    (tmp_path / "lectures.csv").write_text("lecture_id,tag,part,type_of\n9,1,2,concept\n")
    log, questions, lectures = logs.load(spark, str(tmp_path))
    assert log.count() == 12 and "row_id" not in log.columns and log.dtypes[0] == ("timestamp", "bigint")
    assert questions.first()["tags"] == "1 2" and lectures.first()["type_of"] == "concept"
    assert {r["user_id"] for r in logs.load(spark, str(tmp_path), users=2)[0].collect()} == {1, 2}
    assert {r["user_id"] for r in logs.load(spark, str(tmp_path), users=-1)[0].collect()} == {3}
    assert logs.load(spark, str(tmp_path), rows=5)[0].count() == 5
