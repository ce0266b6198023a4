"""History features against a plain loop over random logs."""

import random

import pytest

from tasklore.operators import encoders, history, sessions
from tasklore.sources import logs

HOUR = 3_600_000


def random_log(seed, users=6, tasks=25):
    rng, rows = random.Random(seed), []
    for user in range(users):
        ts, rn = rng.choice([0, 3 * HOUR]), 0
        for task in range(rng.randint(1, tasks)):
            for _ in range(rng.choice([1, 1, 1, 2, 3, 5])):
                rn += 1
                rows.append((user, ts, task, rn, rng.randint(1, 3), rng.randint(0, 1), rng.random(), 0))
            ts += rng.choice([1000, 60_000, 8 * HOUR, 0])
    return rows


COLUMNS = ["user_id", "ts_ms", "task_container_id", "rn", "part", "answered_correctly", "answer_weight", "content_type_id"]


def loop(rows, keys, weighted=False, decay=None, rolling=None):
    out, state = {}, {}
    for row in rows:
        key = tuple(row[COLUMNS.index(k)] for k in keys)
        s = state.setdefault(key, {"task": None, "done": [], "new": [], "sum": 0.0, "n": 0.0})
        if s["task"] != row[2]:
            s["done"] += s["new"]
            s["sum"], s["n"] = s["sum"] + sum(y for y, _ in s["new"]), s["n"] + sum(w for _, w in s["new"])
            if decay and s["task"] is not None:
                s["sum"], s["n"] = s["sum"] * decay, s["n"] * decay
            s["task"], s["new"] = row[2], []
        kept = s["done"][-rolling:] if rolling else None
        total, n = (sum(y for y, _ in kept), sum(w for _, w in kept)) if rolling else (s["sum"], s["n"])
        out[row[0], row[3]] = (total / n if n else None, n)
        w = row[6] if weighted else 1.0
        s["new"].append((row[5] * w, w))
    return out


@pytest.mark.parametrize(
    ("keys", "options"),
    [(["user_id"], {}), (["user_id", "part"], {}), (["user_id"], {"rolling": 5}), (["user_id", "part"], {"weighted": True}), (["user_id", "part"], {"decay": 0.9}), (["user_id"], {"decay": 0.5, "weighted": True})],
)
def test_scores_match_a_loop(spark, keys, options):
    rows = random_log(7)
    log = spark.createDataFrame(rows, COLUMNS)
    name = history.score_name(keys, options.get("weighted", False), options.get("rolling"), options.get("decay"))
    got = {(r[0], r[1]): (r[2], r[3]) for r in history.rolling_score(log, keys, **options).select("user_id", "rn", *[f"`{n}`" for n in name]).collect()}
    for key, (score, n) in loop(rows, keys, **options).items():
        assert got[key][1] == pytest.approx(n, abs=1e-9)
        assert got[key][0] == (pytest.approx(score, abs=1e-9) if score is not None else None)


def test_long_histories_keep_their_precision(spark):
    rows = [(1, k, k, k + 1, 1, k % 2, 1.0, 0) for k in range(3000)]
    got = history.rolling_score(spark.createDataFrame(rows, COLUMNS), ["user_id"], decay=0.9).orderBy("rn").collect()
    total = 0.0
    for k, row in enumerate(got):
        assert row["user_id_count_decay_0.9"] == pytest.approx(total, rel=1e-9, abs=1e-12)
        total = (total + 1) * 0.9


def test_illegal_combinations(spark):
    log = spark.createDataFrame(random_log(1), COLUMNS)
    for bad in ({"rolling": 3, "decay": 0.9}, {"rolling": 3, "time_since_last": True}, {"time_since_last": True}, {"rolling": 2, "weighted": True}):
        with pytest.raises(ValueError):
            history.rolling_score(log, ["user_id"], **bad)


def test_sessions_start_late_and_empty_logs(spark):
    rows = [(1, 3 * HOUR, 0, 1, 1, 1, 1.0, 0), (1, 3 * HOUR + 1, 1, 2, 1, 1, 1.0, 0), (1, 6 * HOUR, 2, 3, 1, 0, 1.0, 0), (2, 0, 0, 1, 1, 1, 1.0, 0)]
    log = spark.createDataFrame(rows, COLUMNS)
    assert [r[0] for r in sessions.session_ids(log).orderBy("user_id", "rn").select("session_id").collect()] == [1, 1, 2, 0]
    assert history.rolling_score(log.limit(0), ["user_id"]).count() == 0


def test_weighted_last_rows(spark):
    log = spark.createDataFrame([(1, k, k, k + 1, 1, 1, 1.0, 0) for k in range(6)], COLUMNS)
    assert [r[0] for r in history.weighted_rolling(log, ["user_id"], 2.0).orderBy("rn").select("weighted_count_n").collect()] == [0, 1, 2, 2, 2, 2]


@pytest.mark.parametrize("seed", range(3))
def test_weighted_last_rows_drop_the_oldest(spark, seed):
    rows = [(*r[:6], round(r[6], 1), r[7]) for r in random_log(seed)]
    log = spark.createDataFrame(rows, COLUMNS)
    want = {}
    for user in {r[0] for r in rows}:
        held, fresh, task = [], [], None
        for r in sorted((r for r in rows if r[0] == user), key=lambda r: r[3]):
            if r[2] != task:
                held, fresh, task = held + fresh, [], r[2]
                while sum(w for _, w in held) > 2 + 1e-9:
                    held = held[1:]
            n = sum(w for _, w in held)
            want[user, r[3]] = (sum(y * w for y, w in held) / n if n > 0 else None, n)
            fresh.append((r[5], r[6]))
    got = {(r.user_id, r.rn): (r.weighted_score_n, r.weighted_count_n) for r in history.weighted_rolling(log, ["user_id"], 2.0).collect()}
    assert got.keys() == want.keys()
    for key, (score, n) in want.items():
        assert got[key][1] == pytest.approx(n, abs=1e-9)
        assert got[key][0] == (None if score is None else pytest.approx(score))


def test_encoders_take_a_parent_and_other_rows(spark):
    log = spark.createDataFrame([(u, k, 1 if u < 3 else 9, u % 2, 0.25) for k, u in enumerate((0, 1, 2, 3))], "user_id int, rn int, item int, answered_correctly int, up double")
    got = encoders.score_encoder_oof(log, ["item"], smoothing=(5, 1), parent="up").orderBy("rn").collect()
    assert got[3].item_encoded == 0.25  # no other fold has the item
    weight = 1 / (1 + 2.718281828459045**3)
    assert got[0].item_encoded == pytest.approx(weight * 0.5 + (1 - weight) * 0.25)
    some = log.where("user_id < 2")
    assert [r.item_ratio for r in encoders.ratio_encoder(log, "item", some).orderBy("rn").collect()] == [1, 1, 1, 0]
    own = encoders.score_encoder(log, ["item"], (None, None), rows=some).orderBy("rn").collect()
    assert [r.item_encoded for r in own] == [0.5, 0.5, 0.5, None]


def test_many_scores_of_one_key_set_equal_single_ones(spark):
    import random

    from pyspark.sql import functions as F

    rng, rows = random.Random(4), []
    for u in range(4):
        for t in range(9):
            for k in range(rng.randrange(1, 4)):
                rows.append((u, len(rows), t * 1000, t, rng.randrange(3), rng.randrange(2), rng.random(), rng.random()))
    log = spark.createDataFrame(rows, "user_id int, rn int, ts_ms long, task_container_id long, part int, answered_correctly int, answer_weight double, part_encoded double")
    specs = [{"smoothing": (5, 2), "time_since_last": True}, {"smoothing": (2.5, 1), "rolling": 3}, {"smoothing": (2, 1), "weighted": True}, {"decay": 0.9}]
    got = history.rolling_scores(log, ["user_id", "part"], specs, F.col("part_encoded"))
    want = log
    for s in specs:
        want = history.rolling_score(want, ["user_id", "part"], prior=F.col("part_encoded"), **s)
    assert sorted(got.columns) == sorted(want.columns)
    a, b = ({r["rn"]: r for r in df.collect()} for df in (got, want))
    for rn, r in a.items():
        for c in got.columns:
            assert r[c] == pytest.approx(b[rn][c], abs=1e-12) if isinstance(r[c], float) else r[c] == b[rn][c]
    with pytest.raises(ValueError):
        history.rolling_scores(log, ["user_id"], [{"time_since_last": True}], 0.5)


def test_a_large_log_is_dealt_to_more_tasks_and_once_by_user(spark, monkeypatch):
    monkeypatch.setattr(logs, "ROWS_A_TASK", 1000)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        log = logs.interactions(spark, "/root/testdata/sf0.001")
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) == -(-log.count() // 1000) > int(before)
        out = history.rolling_score(log, ["user_id", "question_part"]).select("user_id", "rn", "user_id_question_part_score")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(") == 1 and plan.count("Exchange hashpartitioning(user_id") == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_encoders_of_items_meet_the_log_in_one_join(spark, monkeypatch):
    rows = spark.range(400).selectExpr(
        "id % 11 user_id", "id rn", "int(if(id % 50 = 7, null, id % 13)) content_id", "int(id % 3 = 0) answered_correctly", "int(id % 11 % 5) fold", "int(id % 2) flag", "int(id % 7) part"
    )
    child = {"held": True, "noise": 0.002, "smoothing": (20, 5), "parent": "content_id_encoded"}
    many = [encoders.Encoder(("content_id",), ratio=True), encoders.Encoder(("content_id",), held=True), encoders.Encoder(("flag", "content_id"), **child), encoders.Encoder(("part",))]
    few = sorted(map(str, encoders.encoded(rows, many, last=1).collect()))
    monkeypatch.setattr(encoders, "FEW", 0)
    out = encoders.encoded(rows, many, last=1)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") <= 3  # fold, item and part
    assert len(few) == 400 and sorted(map(str, out.collect())) == few


def test_many_scores_take_two_sorts_and_decays_share_chunks(spark):
    from pyspark.sql import functions as F

    rows = spark.range(9000).selectExpr(  # two rows a task, and several chunks of either decay
        "1 user_id", "id + 1 rn", "id div 2 * 1000 ts_ms", "id div 2 task_container_id", "int(id % 9 < 5) answered_correctly", "id % 7 / 7 answer_weight", "1 part"
    )
    specs = [{"time_since_last": True}, {"rolling": 3}, {"weighted": True}, {"smoothing": (1, 1), "decay": 0.9}, {"decay": 0.99}]
    got = history.rolling_scores(rows, ["user_id", "part"], specs, 0.5)
    assert got._jdf.queryExecution().executedPlan().toString().count("Sort [") == 2
    want = rows
    for s in specs:
        want = history.rolling_score(want, ["user_id", "part"], **s)
    a, b = (df.orderBy("rn").toPandas()[sorted(want.columns)] for df in (got, want))
    for c in a.columns:
        assert a[c].to_numpy(float) == pytest.approx(b[c].to_numpy(float), abs=1e-9, nan_ok=True)
