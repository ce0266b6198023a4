"""Communities, vectors out of fold, exact quantiles, profiles and models against plain versions."""

import random

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from tasklore import catalog
from tasklore.operators import items, ranges, sequences
from tasklore.plans import models, profile, replay
from tasklore.sources import store


def planted(groups, size, seed):
    """Edges (both directions) of groups that are dense inside and meet rarely, two of them themselves halves of a larger one."""
    rng, w = random.Random(seed), {}
    n = groups * size
    for a in range(n):
        for b in range(a + 1, n):
            near = a // size == b // size
            if rng.random() < (0.8 if near else 0.03):
                w[a, b] = w[b, a] = rng.choice([1, 2, 3]) if near else 1
    w[0, 0] = 2
    return w


def plain_modularity(w, label):
    m, degree = sum(w.values()), {}
    for (a, _), x in w.items():
        degree[a] = degree.get(a, 0) + x
    by = {}
    for a, d in degree.items():
        by[label[a]] = by.get(label[a], 0) + d
    return sum(x for (a, b), x in w.items() if label[a] == label[b]) / m - sum((d / m) ** 2 for d in by.values())


def plain_levels(w, seed):
    """One node after another to its best neighbour's community, then communities as nodes, until nothing moves."""
    rng, label, now = random.Random(seed), {a: a for a, _ in w}, dict(w)
    while True:
        own, degree = {a: a for a, _ in now}, {}
        for (a, _), x in now.items():
            degree[a] = degree.get(a, 0) + x
        m, total, moved = sum(now.values()), dict(degree), False
        while True:
            changed = False
            for a in rng.sample(sorted(own), len(own)):
                to = {own[a]: 0}
                for (x, b), y in now.items():
                    if x == a and b != a:
                        to[own[b]] = to.get(own[b], 0) + y
                total[own[a]] -= degree[a]
                best = max(to, key=lambda c: (round(to[c] - degree[a] * total[c] / m, 9), c == own[a], -c))
                changed |= best != own[a]
                own[a] = best
                total[best] += degree[a]
            moved |= changed
            if not changed:
                break
        label = {a: own[c] for a, c in label.items()}
        if not moved:
            return label
        up = {}
        for (a, b), x in now.items():
            up[own[a], own[b]] = up.get((own[a], own[b]), 0) + x
        now = up


@pytest.mark.parametrize(("groups", "size", "seed"), [(4, 8, 1), (10, 4, 2)])
def test_communities_are_as_good_as_a_plain_multi_level_run(spark, groups, size, seed):
    w = planted(groups, size, seed)
    edges = spark.createDataFrame([(a, b, x) for (a, b), x in w.items()], "src long, dst long, w long")
    found = items.communities(edges)
    label = {r["node"]: r["community"] for r in found.collect()}
    assert set(label) == {a for a, _ in w}
    mine = items.modularity(edges, found).first()[0]
    assert mine == pytest.approx(plain_modularity(w, label), abs=1e-12)
    assert mine >= max(plain_modularity(w, plain_levels(w, s)) for s in range(3)) - 1e-9
    edges.createOrReplaceTempView("edges"), found.createOrReplaceTempView("labels")
    sql = """with e as (select a.community as x, b.community as y, w from edges join labels a on src = a.node join labels b on dst = b.node), t as (select sum(w) as m from e),
      c as (select x, sum(w) as d, sum(case when x = y then w else 0 end) as i from e group by x) select sum(i / m - d * d / m / m) from c, t"""
    assert mine == pytest.approx(spark.sql(sql).first()[0], abs=1e-12)


def test_communities_raise_when_they_do_not_settle(spark):
    edges = spark.createDataFrame([(a, b, x) for (a, b), x in planted(3, 6, 4).items()], "src long, dst long, w long")
    with pytest.raises(RuntimeError):
        items.communities(edges, rounds=1)


def test_communities_of_weights_whose_products_pass_a_long(spark):
    ties = [(a, b, 4_000_000_000) for g in (0, 3) for a in range(g, g + 3) for b in range(g, g + 3) if a != b] + [(0, 3, 1), (3, 0, 1)]
    found = items.communities(spark.createDataFrame(ties, "src long, dst long, w long")).collect()
    label = {r["node"]: r["community"] for r in found}
    assert label[0] == label[1] == label[2] != label[3] == label[4] == label[5]


def test_no_communities_without_edges(spark):
    assert items.communities(spark.createDataFrame([], "src long, dst long, w long")).collect() == []


def made_log(spark, users=10):
    rng, rows = random.Random(1), []
    for u in range(users):
        for t in range(12):
            item = 100 + u if t == 5 else rng.randrange(6)  # item 100 + u is met by user u alone
            rows.append((u, t + 1, t * 1000, t, item, rng.randrange(2), u % 5))
    return spark.createDataFrame(rows, "user_id long, rn long, ts_ms long, task_container_id long, content_id long, answered_correctly int, fold int")


def test_vectors_out_of_fold(spark):
    log = made_log(spark)
    found = items.answer_vectors(log, 5, size=4).collect()
    for r in found:
        others = log.where((F.col("fold") != r["fold"]) & (F.col("content_id") == r["content_id"]) & (F.col("answered_correctly") == r["correct"]))
        assert others.limit(1).count() == 1  # what a fold is given was met by others
    own = {(r["fold"], r["content_id"]) for r in found}
    assert not any((u % 5, 100 + u) in own for u in range(10)) and all((k, 100 + u) in own for u in range(10) for k in range(5) if k != u % 5)
    tags = spark.createDataFrame([(k, "a b") for k in range(6)] + [(100 + u, "b c") for u in range(10)], "content_id long, tags string")
    vectors = spark.createDataFrame([(f, i, c, [float(f + 1), float(i % 5 + c)]) for f in range(5) for i in range(6) for c in (0, 1)], "fold int, content_id long, correct int, vector array<double>")
    got = {(r["user_id"], r["rn"]): r for r in sequences.answer_likeness(log, tags, vectors).collect()}
    rows = {(r["user_id"], r["rn"]): r for r in log.collect()}
    cos = lambda a, b: float(np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b)))
    vector = lambda f, i, c: np.array([f + 1.0, i % 5 + c])
    for (u, rn), r in rows.items():
        before, f = rows.get((u, rn - 1)), r["fold"]
        if before is None or max(before["content_id"], r["content_id"]) >= 6:
            assert got[u, rn]["similarity_1"] is None
            continue
        then = vector(f, before["content_id"], before["answered_correctly"])
        want = cos(then, vector(f, r["content_id"], 1)) - cos(then, vector(f, r["content_id"], 0))
        assert got[u, rn]["similarity_1"] == pytest.approx(want, abs=1e-12)


def test_quantiles_are_exact(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(5) / 2, rng.uniform(-9, 9)])) for _ in range(400)]
    rows += [("c", None), ("d", 7.0)] + [("hot", float(k % 97)) for k in range(1000)]
    df = spark.createDataFrame(rows, "k string, x double")
    shares = [0.0, 0.1, 1 / 3, 0.5, 0.95, 1.0]
    got = {r["k"]: r for r in ranges.exact_quantiles(df, "x", shares, ["k"]).collect()}
    assert set(got) == {"a", "b", None, "d", "hot"}
    for k, r in got.items():
        values = [x for key, x in rows if key == k and x is not None]
        assert r["n"] == len(values) and r["quantiles"] == pytest.approx(np.quantile(values, shares).tolist(), abs=1e-12)
    whole = ranges.exact_quantiles(df, "x", shares).collect()
    assert len(whole) == 1 and whole[0]["quantiles"] == pytest.approx(np.quantile([x for _, x in rows if x is not None], shares).tolist(), abs=1e-12)
    none = ranges.exact_quantiles(df.where("false"), "x", [0.5]).collect()
    assert [(r["quantiles"], r["n"]) for r in none] == [([None], 0)]


def test_quantiles_have_no_exchange_of_values_to_one_partition(spark):
    df = spark.range(1000).select((F.col("id") % 100).cast("double").alias("x"))
    plan = ranges.exact_quantiles(df, "x", [0.5])._jdf.queryExecution().executedPlan().toString()
    single = [line for line in plan.splitlines() if "Exchange SinglePartition" in line]
    # sums by range and one row of picks go to one partition; values never do
    assert single and all("_x" not in line for line in single)
    assert "percentile" not in plan


def test_places_have_no_gaps(spark):
    rows = [(k % 37, k) for k in range(500)]
    got = ranges.placed(spark.createDataFrame(rows, "a int, b int"), [F.col("a").desc(), "b"]).collect()
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["_place"])] == sorted(rows, key=lambda r: (-r[0], r[1]))
    assert [r["_place"] for r in sorted(got, key=lambda r: r["_place"])] == list(range(1, 501)) and {r["_total"] for r in got} == {500}
    users = replay.last_users(spark.createDataFrame([(k,) for k in range(45)] * 2, "user_id int"), 0.1)
    assert sorted(r[0] for r in users.collect()) == [41, 42, 43, 44]


def test_top_counts(spark):
    rows = [(c, f"v{k}", (k * 7) % 10) for c in "xy" for k in range(200)]
    got = ranges.top_counts(spark.createDataFrame(rows, "c string, v string, n int"), ["c"], "v", "n", 7).collect()
    for c in "xy":
        want = sorted(((-n, v) for k, v, n in rows if k == c))[:7]
        assert [(-r["n"], r["v"]) for r in sorted(got, key=lambda r: r["place"]) if r["c"] == c] == want


def test_profile_of_odd_columns(spark):
    df = spark.createDataFrame([(None, [1], 1.5, None), ("a", None, None, None), ("a", [2], 2.5, None)], "`a.b` string, l array<int>, x double, none date")
    got = {r["column"]: r for r in profile.analyzed(df).collect()}
    assert (got["a.b"]["n_null"], got["a.b"]["n_unique"], got["a.b"]["frequent"]) == (1, 1, "a=2")
    assert (got["l"]["kind"], got["l"]["n_null"], got["l"]["n_unique"]) == ("object", 1, None)
    assert (got["x"]["low"], got["x"]["mid"], got["x"]["high"]) == (1.5, 2.0, 2.5)
    assert (got["none"]["n_null"], got["none"]["n_unique"], got["none"]["first_date"]) == (3, 0, None)
    empty = profile.analyzed(df.where("false")).collect()
    assert {r["n_rows"] for r in empty} == {0}
    assert profile.size_of(df)["rows"] == 3 and profile.size_of(df)["columns"] == 4 and profile.size_of(df)["bytes"] > 0


def test_tag_components_explain_what_the_covariance_says(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.sample(["p", "q", "r", "s", "t"], rng.randrange(1, 4)))) for k in range(80)] + [(80, None), (81, "p p q")]
    df = spark.createDataFrame(rows, "content_id long, tags string")
    cov = {(r["a"], r["b"]): r["covariance"] for r in items.tag_covariance(df, "content_id", "tags").collect()}
    names, n = ["p", "q", "r", "s", "t"], len(rows)
    hot = np.array([[float(t in (s or "").split(" ")) for t in names] for _, s in rows])
    full = np.cov(hot.T)
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            assert cov.get((a, b), -hot[:, i].mean() * hot[:, j].mean() * n / (n - 1)) == pytest.approx(full[i, j], abs=1e-12)
    found, shares = items.tag_components(df, "content_id", "tags", 3)
    values = np.sort(np.linalg.eigvalsh(full))[::-1]
    assert shares == pytest.approx((values / values.sum())[:3].tolist(), abs=1e-9)
    got = np.array([r["components"] for r in found.orderBy("content_id").collect()])
    assert got.var(axis=0, ddof=1) == pytest.approx(values[:3], abs=1e-9)


def test_auc_by_group(spark):
    rng = random.Random(6)
    rows = [(g, rng.randrange(8) / 8, rng.randrange(2)) for g in "ab" for _ in range(90)] + [("one", 0.5, 1)]
    got = {r["g"]: r["auc"] for r in models.auc_by(spark.createDataFrame(rows, "g string, s double, y int"), "g", "s", "y").collect()}
    for g in "ab":
        own = [(s, y) for k, s, y in rows if k == g]
        wins = [1.0 if s > t else 0.5 if s == t else 0.0 for s, y in own if y for t, z in own if not z]
        assert got[g] == pytest.approx(sum(wins) / len(wins), abs=1e-12)
    assert got["one"] is None


def model_rows(spark, n=1500):
    rng = random.Random(9)
    rows = []
    for k in range(n):
        x, z = rng.uniform(-1, 1), rng.uniform(-1, 1)
        rows.append((k % 60, k, x, z if k % 9 else None, int(x + 0.4 * (z > 0) + rng.gauss(0, 0.7) > 0)))
    return spark.createDataFrame(rows, "user_id long, rn long, x double, z double, y int")


def test_boosting_stops_early_at_the_best_round(spark):
    rows = model_rows(spark)
    train, held = rows.where("user_id < 40"), rows.where("user_id >= 40")
    found = models.boosted(train, held, ["x", "z"], "y", limit=40, step=0.5, tolerance=0.005)
    rates = {r["round"]: r for r in found.rates.collect()}
    assert sorted(rates) == list(range(1, len(rates) + 1)) and found.rounds < 40
    assert rates[found.rounds]["auc_held"] == max(r["auc_held"] for r in rates.values())
    scored = found.transform(held, "chance")
    assert scored.columns == [*held.columns, "chance"]
    assert models.roc_auc(scored, "chance", "y").first()[0] == pytest.approx(rates[found.rounds]["auc_held"], abs=1e-9)
    assert rates[found.rounds]["auc_train"] > 0.7


def test_blend_of_three_learners_over_folds(spark):
    rows = model_rows(spark)
    out = models.blended(rows.where("user_id < 40"), rows.where("user_id >= 40"), ["x", "z"], "y", ["user_id", "rn"]).cache()
    assert out.count() == rows.where("user_id >= 40").count()
    assert out.groupBy("user_id").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0 and out.select("fold").distinct().count() == 3
    stacked = out.select("y", F.explode(F.array(*[F.struct(F.lit(n).alias("l"), F.col(n).alias("s")) for n in ("boosted", "forest", "perceptron", "blend")])).alias("r")).select("y", "r.*")
    auc = {r["l"]: r["auc"] for r in models.auc_by(stacked, "l", "s", "y").collect()}
    assert min(auc.values()) > 0.65 and auc["blend"] > max(auc.values()) - 0.03


def test_cache_counts_the_code_of_what_it_makes(spark, tmp_path):
    def first(n):
        return spark.range(n)

    one = first
    assert store.cached(one, spark, str(tmp_path), n=3).count() == 3

    def first(n):  # noqa: F811
        return spark.range(n + 1)

    assert store.cached(first, spark, str(tmp_path), n=3).count() == 4 and store.cached(one, spark, str(tmp_path), n=3).count() == 3


def test_a_power_is_fitted_on_distinct_values_and_likeness_joins_an_item_once(spark, monkeypatch):
    grid, x = tuple(k / 10 for k in range(-20, 31)), [1.0, 1.0, 1.0, 2.0, 2.0, 3.0, 5.0, 40.0, 90.0]
    seen = []
    monkeypatch.setattr(models, "cut", lambda df: seen.append(df.count()) or df)
    got = models._strength(spark.createDataFrame([(v,) for v in [*x, None]], "x double"), "x", grid)
    y = {s: [np.log(v + 1) if abs(s) < 1e-9 else ((v + 1) ** s - 1) / s for v in x] for s in grid}
    assert got == max(grid, key=lambda s: -len(x) / 2 * np.log(np.var(y[s])) + (s - 1) * np.log(np.add(x, 1)).sum())
    assert seen == [len(set(x))]
    tags = spark.createDataFrame([(k, "a b") for k in range(6)], "content_id long, tags string")
    vectors = spark.createDataFrame([(i, c, [1.0, float(i + c)]) for i in range(6) for c in (0, 1)], "content_id long, correct int, vector array<double>")
    plan = sequences.answer_likeness(made_log(spark), tags, vectors)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 2


def test_vectors_are_fitted_in_parts_and_written(spark, monkeypatch):
    monkeypatch.setattr(items, "TOKENS_A_FIT", 30)
    written, fits = [], []
    real, fitted = items.cut, items.Word2Vec
    monkeypatch.setattr(items, "cut", lambda df: written.append(df.columns) or real(df))
    monkeypatch.setattr(items, "Word2Vec", lambda **given: fits.append(given["numPartitions"]) or fitted(**given))
    assert items.item_vectors(made_log(spark), F.col("content_id"), size=4).count() == 16
    assert fits == [4] and written == [["user_id", "tokens"], ["word", "vector"]]


def test_scores_of_all_rounds_are_dealt_to_tasks_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(models, "SCORES_A_TASK", 20)
    seen, real = [], models.auc_by
    monkeypatch.setattr(models, "auc_by", lambda df, *given: seen.append(df.rdd.getNumPartitions()) or real(df, *given))
    rows = spark.range(200).selectExpr("double(id % 17) as x", "int(id % 17 > 8) as y", "id % 4 = 0 as held")
    found = models.boosted(rows.where("not held"), rows.where("held"), ["x"], "y", limit=2)
    assert seen == [200 * found.rates.count() // 20]


def test_auc_takes_counts(spark):
    rng = random.Random(8)
    rows = [(g, rng.randrange(5) / 5, rng.randrange(2), rng.randrange(1, 4)) for g in (1, 2) for _ in range(30)]
    by = {r["g"]: r["auc"] for r in models.auc_by(spark.createDataFrame(rows, "g int, s double, y int, c int"), "g", "s", "y", "c").collect()}
    alone = [(g, s, y) for g, s, y, c in rows for _ in range(c)]
    want = {r["g"]: r["auc"] for r in models.auc_by(spark.createDataFrame(alone, "g int, s double, y int"), "g", "s", "y").collect()}
    assert by == pytest.approx(want, abs=1e-12)


def test_a_blend_fits_a_pair_of_folds_once_on_equal_rows(spark, monkeypatch):
    rng = random.Random(4)
    rows = []
    for k in range(600):
        a, b = rng.randrange(12) / 12, rng.randrange(9) / 9
        rows.append((k % 40, k, a, b, 0.5, float(a + b + rng.gauss(0, 0.6) > 1)))
    scored, names = spark.createDataFrame(rows, "user_id long, rn long, a double, b double, same double, y double"), ["a", "b", "same"]
    fits, real = [], models.LogisticRegression
    monkeypatch.setattr(models, "LogisticRegression", lambda **given: fits.append(given["regParam"]) or real(**given))
    out = models.cross_validated_blend(scored, names, "y", "user_id").cache()
    assert len(fits) == 3 * 2 + 3 and out.count() == len(rows)
    ready = VectorAssembler(inputCols=names, outputCol="scores").transform(out)
    for k in range(3):  # the plain form: a cross-validator over the other folds
        learner = real(featuresCol="scores", labelCol="y")
        grid = ParamGridBuilder().addGrid(learner.regParam, [0.0, 0.1]).build()
        judge = BinaryClassificationEvaluator(labelCol="y", metricName="areaUnderROC")
        others = ready.where(F.col("fold") != k).withColumn("inner", F.when(F.col("fold") > k, F.col("fold") - 1).otherwise(F.col("fold")).cast("int"))
        model = CrossValidator(estimator=learner, estimatorParamMaps=grid, evaluator=judge, numFolds=2, foldCol="inner").fit(others).bestModel
        own = model.transform(ready.where(F.col("fold") == k)).select("blend", vector_to_array("probability")[1].alias("want")).collect()
        assert own and max(abs(r["blend"] - r["want"]) for r in own) < 1e-3


def test_learners_share_rows_that_are_prepared_once(spark, monkeypatch):
    made, real = [], models._assembled
    monkeypatch.setattr(models, "_assembled", lambda columns: made.append(columns) or real(columns))
    rows = model_rows(spark, 300)
    out = models.blended(rows.where("user_id < 40"), rows.where("user_id >= 40"), ["x", "z"], "y", ["user_id", "rn"])
    assert out.columns == ["user_id", "rn", "y", "fold", "boosted", "forest", "perceptron", "blend"] and made == [["x", "z"]]


def test_blend_auc_writes_no_row_for_each_learner(spark, monkeypatch):
    rng = random.Random(3)
    names = ["boosted", "forest", "perceptron", "blend"]
    rows = [(k % 3, float(rng.randrange(2)), *[rng.randrange(9) / 9 for _ in names]) for k in range(120)]
    made = spark.createDataFrame(rows, "fold int, answered_correctly double, boosted double, forest double, perceptron double, blend double")
    monkeypatch.setattr(catalog, "m6_blend", lambda spark, d: made)
    monkeypatch.setattr(catalog, "cut", lambda df: pytest.fail("written"))
    got = {(r["learner"], r["fold"]): r["auc"] for r in catalog.m6_blend_auc(spark, "").collect()}
    assert len(got) == 12
    for (learner, fold), auc in got.items():
        own = [(r[2 + names.index(learner)], r[1]) for r in rows if r[0] == fold]
        wins = [1.0 if s > t else 0.5 if s == t else 0.0 for s, y in own if y for t, z in own if not z]
        assert auc == pytest.approx(sum(wins) / len(wins), abs=1e-9)


def planted(spark, users=600, topics=6, words=20):
    """Users of one topic each, who answer its items only."""
    rng, rows = random.Random(5), []
    for u in range(users):
        for t in range(30):
            rows.append((u, t + 1, u % topics * words + rng.randrange(words), rng.randrange(2)))
    return spark.createDataFrame(rows, "user_id long, rn long, content_id long, answered_correctly int")


def test_vectors_of_many_words_are_fitted_in_blocks_off_the_driver(spark, monkeypatch):
    monkeypatch.setattr(items, "WORDS_ON_DRIVER", 50)
    monkeypatch.setattr(items, "Word2Vec", None)
    monkeypatch.setattr(items.skipgram, "LEAST_WORDS", 40)  # three blocks
    monkeypatch.setattr(items.skipgram, "ROW", 100)
    log = planted(spark)
    found = {int(r["word"]): np.array(r["vector"]) for r in items.item_vectors(log, F.col("content_id"), size=8, iterations=3).collect()}
    assert sorted(found) == list(range(120))
    unit = np.array([found[k] / np.linalg.norm(found[k]) for k in range(120)])
    alike, same = unit @ unit.T, np.arange(120)[:, None] // 20 == np.arange(120) // 20
    assert alike[same & ~np.eye(120, dtype=bool)].mean() > 0.9 and alike[~same].mean() < 0.5
    again = {int(r["word"]): r["vector"] for r in items.item_vectors(log, F.col("content_id"), size=8, iterations=3).collect()}
    assert all(list(found[k]) == again[k] for k in range(120))
    own = log.where("user_id % 5 != 2 or content_id != 7").unionByName(log.where("user_id % 5 = 2").withColumn("content_id", F.lit(1000).cast("long")))
    folds = items.answer_vectors(own, 5, size=8)
    assert folds.where("content_id = 1000 and fold = 2").count() == 0  # met by fold 2 alone
    assert folds.where("content_id = 1000").select("fold", "correct").distinct().count() == 8
    assert folds.where("fold = 2").count() == 240 and dict(folds.dtypes)["vector"] == "array<double>"
