"""Online features over micro-batches against their batch forms: each batch brings the answers to the one before."""

import pytest

from tasklore.operators import history, sessions
from tasklore.streaming.online import ItemScores, online_features, rolling_context

HOUR = 3_600_000
COLUMNS = ["user_id", "ts_ms", "task_container_id", "rn", "content_id", "content_type_id", "answered_correctly"]
SCHEMA = "user_id long, rn long, ts_ms long, task_container_id long, content_id long, kind string, answered_correctly int"


def made_rows():
    rows = []
    for u in range(3):
        ts, rn = [0, 3 * HOUR, 5000][u], 0
        for t in range(7):
            lecture = (t + u) % 3 == 2
            for k in range(1 if lecture else 1 + (t + u) % 2):
                rn += 1
                rows.append((u, ts, t, rn, 10 * u + t + k, int(lecture), -1 if lecture else (u + t * k) % 2))
            ts += [1000, 3 * HOUR, HOUR][t % 3]
    return rows


@pytest.fixture(scope="module")
def stream_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("stream")
    for task in range(7):
        shown = [(r[0], r[3], r[1], r[2], r[4], "lecture" if r[5] else "question", None) for r in made_rows() if r[2] == task]
        told = [(r[0], r[3], r[1], r[2], r[4], "answer", r[6]) for r in made_rows() if r[2] == task - 1 and not r[5]]
        spark.createDataFrame(shown + told, SCHEMA).coalesce(1).write.parquet(str(path / f"b{task}"))
    return str(path)


def ran(spark, stream_dir, tmp_path, name, make):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(stream_dir)
    writer = make(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True)
    writer.option("checkpointLocation", str(tmp_path / "state")).start().awaitTermination()
    return spark.table(name).collect()


def test_online_features_equal_batch_forms(spark, stream_dir, tmp_path):
    log = spark.createDataFrame(made_rows(), COLUMNS)
    scores = history.rolling_score(log.where("content_type_id = 0"), ["user_id"])
    # a lecture row has no score in the batch form; its state is what its user's earlier answers give
    scores = {(r["user_id"], r["rn"]): (r["user_id_score"], r["user_id_count"]) for r in scores.collect()}
    parts = log.withColumns({"tag": log["content_id"], "part": log["content_id"] % 7 + 1})
    want = sessions.lecture_features(sessions.session_features(parts)).collect()
    got = {(r["user_id"], r["rn"]): r for r in ran(spark, stream_dir, tmp_path, "features", online_features)}
    assert len(got) == len(want)
    names = ["session_id", "session_time", "n_lectures", "time_since_last_lecture", "tasks_since_last_lecture"]
    for r in want:
        key = (r["user_id"], r["rn"])
        assert [got[key][n] for n in names] == [r[n] for n in names]
        if key in scores:
            assert (got[key]["user_id_score"], got[key]["user_id_count"]) == scores[key]


def test_rolling_context(spark, stream_dir, tmp_path):
    got = {(r["user_id"], r["rn"]): r["context"] for r in ran(spark, stream_dir, tmp_path, "context", lambda s: rolling_context(s, 4))}
    for u, _, task, rn, *_ in made_rows():
        before = [r[4] for r in made_rows() if r[0] == u and r[2] < task][-4:]
        assert got[u, rn] == [0] * (4 - len(before)) + before


def test_item_scores_across_users(spark, stream_dir, tmp_path):
    scores = ItemScores(spark, str(tmp_path / "items"), smoothing=(1, 1))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(stream_dir)
    stream.writeStream.foreachBatch(scores.step).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start().awaitTermination()
    facts = {r["content_id"]: (r["s"], r["n"]) for r in scores.table(7).collect()}
    want = {}
    for r in made_rows():
        if not r[5] and r[2] < 6:
            s, n = want.get(r[4], (0, 0))
            want[r[4]] = s + r[6], n + 1
    assert facts == want
    shown = spark.read.parquet(str(tmp_path / "items" / "scored")).where("batch = 0").collect()
    assert shown and {r["content_id_encoded"] for r in shown} == {0.5}
