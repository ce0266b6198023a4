"""Models over a feature frame: scaling, trees, a perceptron, a blend, and metrics as expressions."""

from __future__ import annotations

import json
import math
import random

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tasklore.operators.ranges import exact_quantiles, in_ranges
from tasklore.sources.store import cut

SCORES_A_TASK = 2_000_000


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """auc: the chance that a positive outranks a negative, ties half, by sums over distinct scores."""
    by = df.groupBy(score).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("n"))
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = cut(by.repartitionByRange(n_parts, score).withColumn("part", F.spark_partition_id()))  # scores are spread over ranges
    to_here = lambda w, last: w.rowsBetween(Window.unboundedPreceding, last)
    ranges = by.groupBy("part").agg(F.sum("n").alias("m"))  # one row a range
    ranges = ranges.select("part", F.coalesce(F.sum("m").over(to_here(Window.orderBy("part"), -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("n").over(to_here(Window.partitionBy("part").orderBy(score), -1)), F.lit(0))
    wins = by.join(F.broadcast(ranges), "part").select("p", "n", (F.col("p") * (F.col("before") + inside + F.col("n") / 2)).alias("w"))
    return wins.agg((F.sum("w") / (F.sum("p") * F.sum("n"))).alias("auc"))


def auc_by(df: DataFrame, group: str, score: str, label: str, count: str | None = None) -> DataFrame:
    """group, auc: roc_auc of each group, null where it has one kind of label only. Distinct scores are spread over ranges of
    (group, score), so a group is never in one task. A row counts once, or as often as its count says."""
    times = F.lit(1) if count is None else F.col(count)
    by = df.groupBy(group, score).agg(F.sum(F.col(label) * times).alias("p"), F.sum((1 - F.col(label)) * times).alias("n"))
    dealt = in_ranges(by, [group, score])
    before = lambda w: F.coalesce(F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = dealt.groupBy(group, "_range").agg(F.sum("n").alias("m"))  # a row for each group of a range
    sums = sums.select(group, "_range", before(Window.partitionBy(group).orderBy("_range")).alias("_before"))
    inside = before(Window.partitionBy(group, "_range").orderBy(score))
    wins = dealt.withColumn("m", F.col("n")).withColumn("_in", inside).join(sums, [group, "_range"])
    return wins.groupBy(group).agg(F.try_divide(F.sum(F.col("p") * (F.col("_before") + F.col("_in") + F.col("n") / 2)), F.sum("p") * F.sum("n")).alias("auc"))


def log_loss(p: Column, y: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7))
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def focal_loss(p: Column, y: Column, gamma: float = 2.0, alpha: float = 0.25) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7))
    return -(alpha * y * F.pow(1 - q, F.lit(gamma)) * F.ln(q) + (1 - alpha) * (1 - y) * F.pow(q, F.lit(gamma)) * F.ln(1 - q))


def warmup_rate(step: Column, size: int, warmup: int) -> Column:
    return F.least(1 / F.sqrt(step), step * F.lit(float(warmup) ** -1.5)) / F.sqrt(F.lit(float(size)))


def scaling_plan(df: DataFrame, columns: list[str], skewed: float = 1.0, least: int = 5) -> DataFrame:
    """column, skewness, n_unique, power: whether the column is transformed by a power rather than standardized."""
    facts = df.agg(*[F.skewness(c).alias(f"s_{c}") for c in columns], *[F.count_distinct(c).alias(f"u_{c}") for c in columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"s_{c}").alias("skewness"), F.col(f"u_{c}").alias("n_unique")) for c in columns]))
    return facts.select(rows.alias("r")).select("r.*").withColumn("power", (F.col("skewness") > skewed) & (F.col("n_unique") > least))


def _power(x: Column, strength: float) -> Column:
    """Yeo and Johnson's power transform."""
    up = F.ln(x + 1) if abs(strength) < 1e-9 else (F.pow(x + 1, F.lit(strength)) - 1) / strength
    down = -F.ln(1 - x) if abs(strength - 2) < 1e-9 else -(F.pow(1 - x, F.lit(2 - strength)) - 1) / (2 - strength)
    return F.when(x >= 0, up).otherwise(down)


def _strength(df: DataFrame, column: str, grid: tuple[float, ...]) -> float:
    """The strength of the grid with the largest likelihood. Equal values are one row with a count, and the grid's strengths
    are rows too, so that a pass is two small sums; the second takes squares off the first's means."""
    values = cut(df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("_x")).agg(F.count("*").alias("_c")))
    x, c = F.col("_x"), F.col("_c")
    made = values.select("_c", F.posexplode(F.array(*[_power(x, s) for s in grid])).alias("_k", "_y"))
    means = made.groupBy("_k").agg((F.sum(c * F.col("_y")) / F.sum(c)).alias("_m"))  # a row for each strength
    spread = made.join(F.broadcast(means), "_k").groupBy("_k").agg((F.sum(c * F.pow(F.col("_y") - F.col("_m"), F.lit(2))) / F.sum(c)).alias("_v"))
    n, logs = values.agg(F.sum(c), F.sum(c * F.signum(x) * F.ln(F.abs(x) + 1))).first()
    held = {r["_k"]: r["_v"] for r in spread.collect()}
    fit = lambda k: -n / 2 * math.log(max(held[k], 1e-300)) + (grid[k] - 1) * logs
    return grid[max(range(len(grid)), key=fit)]


def scaled(df: DataFrame, columns: list[str], grid: tuple[float, ...] = tuple(k / 10 for k in range(-20, 31))) -> DataFrame:
    """df with its columns standardized; the skewed ones (scaling_plan) after the power transform of the grid's strength with
    the largest likelihood. Order: standard columns, then skewed ones. A row of sums for each strength reaches the driver."""
    plan = {r["column"]: r["power"] for r in scaling_plan(df, columns).collect()}
    skewed = [c for c in columns if plan[c]]
    strength = {c: _strength(df, c, grid) for c in skewed}
    made = {c: _power(F.col(c).cast("double"), strength[c]) if c in strength else F.col(c).cast("double") for c in columns}
    facts = df.agg(*[F.avg(made[c]).alias(f"m_{c}") for c in columns], *[F.stddev_pop(made[c]).alias(f"s_{c}") for c in columns])  # one row
    out = df.crossJoin(F.broadcast(facts))
    others = [c for c in df.columns if c not in columns]
    ordered = [c for c in columns if c not in skewed] + skewed
    return out.select(*others, *[((made[c] - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") == 0, 1.0).otherwise(F.col(f"s_{c}"))).alias(c) for c in ordered])


def with_missing_flags(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds column_missing, 1 where the column is null, and fills nulls with the column's exact median (one row)."""
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("r")).select("r.*")
    found = exact_quantiles(stacked, "x", [0.5], ["column"])  # a row for each column
    medians = found.agg(*[F.max(F.when(F.col("column") == c, F.col("quantiles")[0])).alias(f"_{c}") for c in columns])
    flags = {f"{c}_missing": F.col(c).isNull().cast("int") for c in columns}
    filled = {c: F.coalesce(c, F.col(f"_{c}")) for c in columns}
    return df.withColumns(flags).crossJoin(F.broadcast(medians)).withColumns(filled).drop(*[f"_{c}" for c in columns])


def random_parameters(space: dict[str, tuple[float, float] | list], n: int, seed: int = 0) -> list[dict]:
    """n draws of hyper-parameters: from a range (low, high) or out of a list; a whole range gives whole numbers."""
    rng = random.Random(seed)

    def one(given: tuple | list):
        if isinstance(given, list):
            return rng.choice(given)
        low, high = given
        return rng.randint(low, high) if isinstance(low, int) and isinstance(high, int) else rng.uniform(low, high)

    return [{k: one(v) for k, v in space.items()} for _ in range(n)]


def save_bundle(path: str, models: dict[str, PipelineModel], state: DataFrame, facts: dict) -> None:
    """Models, the state table and facts (what JSON holds) in one folder; load_bundle gives them back."""
    for name, model in models.items():
        model.write().overwrite().save(f"{path}/models/{name}")
    state.write.mode("overwrite").parquet(f"{path}/state")
    spark = state.sparkSession
    spark.createDataFrame([(json.dumps({"models": sorted(models), "facts": facts}),)], "text string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")


def load_bundle(spark: SparkSession, path: str) -> tuple[dict[str, PipelineModel], DataFrame, dict]:
    held = json.loads(spark.read.text(f"{path}/facts").first()[0])
    return {n: PipelineModel.load(f"{path}/models/{n}") for n in held["models"]}, spark.read.parquet(f"{path}/state"), held["facts"]


def _assembled(columns: list[str]) -> list:
    filled = [f"{c}_filled" for c in columns]
    return [Imputer(strategy="median", inputCols=columns, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]


def learners(n: int, label: str) -> dict:
    """Boosted trees, a forest and a perceptron over n features."""
    return {
        "boosted": GBTClassifier(labelCol=label, maxIter=5, maxDepth=4, seed=1),
        "forest": RandomForestClassifier(labelCol=label, numTrees=10, maxDepth=5, seed=1),
        "perceptron": MultilayerPerceptronClassifier(labelCol=label, layers=[n, 8, 2], maxIter=20, seed=1),
    }


@dataclass
class Boosted:
    """Boosted trees of which the first `rounds` count. rates: round, auc_train, auc_held."""

    prepare: PipelineModel
    model: GBTClassificationModel
    rounds: int
    rates: DataFrame

    def transform(self, df: DataFrame, column: str) -> DataFrame:
        """Adds column: the chance of a 1."""
        return self.scored(self.prepare.transform(df), column).select(*df.columns, column)

    def scored(self, rows: DataFrame, column: str) -> DataFrame:
        """transform for rows that are prepared already."""
        sums = _staged(rows, self.model, self.rounds)
        return sums.withColumn(column, 1 / (1 + F.exp(-2 * F.element_at("_sums", -1)))).drop("_sums")


def _staged(df: DataFrame, model: GBTClassificationModel, rounds: int) -> DataFrame:
    """Adds _sums: the margin after each of the first rounds."""
    out, sums = df, []
    for k, (tree, weight) in enumerate(zip(model.trees[:rounds], model.treeWeights, strict=False)):
        tree.setPredictionCol(f"_tree_{k}")
        out = tree.transform(out)
        sums.append((sums[-1] if sums else F.lit(0.0)) + F.col(f"_tree_{k}") * F.lit(float(weight)))
    return out.withColumn("_sums", F.array(*sums)).drop(*[f"_tree_{k}" for k in range(len(sums))])


def boosted(train: DataFrame, held: DataFrame, columns: list[str], label: str, limit: int = 30, tolerance: float = 0.01, step: float = 0.1, depth: int = 4) -> Boosted:
    """Trees boosted on the training rows, with an early stop: rounds end when the held rows' loss no longer falls by the
    tolerance, or at the limit, and of those the round with the largest AUC on the held rows counts (the first, in a tie).

    All rounds are scored in one pass over each set of rows; a row for each round reaches the driver.
    """
    double = {c: F.col(c).cast("double") for c in [*columns, label]}
    both = train.withColumns(double).withColumn("_held", F.lit(False)).unionByName(held.withColumns(double).withColumn("_held", F.lit(True)))
    prepare = Pipeline(stages=_assembled(columns)).fit(both.where("not _held"))
    return _boosted(prepare, cut(prepare.transform(both).select("features", label, "_held")), label, limit, tolerance, step, depth)


def _boosted(prepare: PipelineModel, rows: DataFrame, label: str, limit: int = 30, tolerance: float = 0.01, step: float = 0.1, depth: int = 4, held_only: bool = False) -> Boosted:
    """boosted over prepared rows (features, label, _held); with held_only the training rows are not scored (auc_train is null)."""
    learner = GBTClassifier(labelCol=label, maxIter=limit, maxDepth=depth, stepSize=step, seed=1, validationIndicatorCol="_held", validationTol=tolerance)
    model = learner.fit(rows)
    judged = rows.where("_held") if held_only else rows
    dealt = judged.repartition(max(1, -(-judged.count() * len(model.trees) // SCORES_A_TASK)))  # a task's scores are hardly ever equal
    staged = _staged(dealt, model, len(model.trees)).select(label, "_held", F.posexplode("_sums").alias("k", "score"))
    rates = auc_by(staged.withColumn("set", F.col("k") * 2 + F.col("_held").cast("int")), "set", "score", label)
    rates = rates.groupBy((F.expr("set div 2") + 1).cast("int").alias("round")).agg(
        F.max(F.when(F.col("set") % 2 == 0, F.col("auc"))).alias("auc_train"), F.max(F.when(F.col("set") % 2 == 1, F.col("auc"))).alias("auc_held")
    )
    rates = cut(rates)
    best = max(rates.collect(), key=lambda r: (r["auc_held"] or 0.0, -r["round"]))
    return Boosted(prepare, model, best["round"], rates)


def _read_in_waves(spark: SparkSession) -> None:
    """Has the session read a table in four tasks a core or more where it would take as many as cores and a few, as learners
    pass over their rows again and again and the last few tasks would make each pass twice as long."""
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):
        spark.conf.set("spark.sql.files.minPartitionNum", 4 * spark.sparkContext.defaultParallelism)


def _logistic(rows: DataFrame, names: list[str], label: str, count: str, spread: list[float], strength: float) -> Column:
    """The margin, as an expression over names, of a logistic regression on rows that count as often as `count` says. Columns
    are divided by their spread over all of the rows it stands for, which the learner cannot see in rows with counts."""
    part = [x or 1.0 for x in spread]
    made = rows.select(label, count, *[(F.col(n) / F.lit(x)).alias(f"_{n}") for n, x in zip(names, part, strict=True)])
    made = VectorAssembler(inputCols=[f"_{n}" for n in names], outputCol="scores").transform(made)
    model = LogisticRegression(featuresCol="scores", labelCol=label, weightCol=count, regParam=strength, standardization=False).fit(made)
    weights = [float(w) / x for w, x in zip(model.coefficients, part, strict=True)]
    return sum((F.col(n) * F.lit(w) for n, w in zip(names, weights, strict=True)), F.lit(float(model.intercept)))


def cross_validated_blend(scored: DataFrame, names: list[str], label: str, user: str, folds: int = 3, strengths: tuple[float, ...] = (0.0, 0.1)) -> DataFrame:
    """Adds fold and blend: a logistic regression over the learners' chances, for each fold of users fitted on the others, with
    the penalty that cross-validation over those other folds prefers by AUC.

    What judges fold j for fold k is fitted on all but these two, so it judges k for j as well: a pair of folds has one fit for
    each penalty. Rows of a fold that are equal in chances and label are one row with a count. All fits are judged in one pass;
    an AUC for each fold, other fold and penalty reaches the driver.
    """
    rows = cut(scored.withColumn("fold", F.pmod(F.xxhash64(user), F.lit(folds)).cast("int")))
    equal = cut(rows.groupBy("fold", label, *names).agg(F.count("*").cast("double").alias("_n")))
    left_out = [(k, j) for j in range(folds) for k in range(j)] + [(k,) for k in range(folds)]
    spreads = rows.agg(*[F.stddev_samp(F.when(~F.col("fold").isin(*out), F.col(n))).alias(f"{n}_{i}") for i, out in enumerate(left_out) for n in names]).first()

    def fit(out: tuple, strength: float) -> Column:
        own = [spreads[f"{n}_{left_out.index(out)}"] for n in names]
        return _logistic(equal.where(~F.col("fold").isin(*out)), names, label, "_n", own, strength)

    inner = {out: [fit(out, r) for r in strengths] for out in left_out if len(out) == 2}
    best = _best_strengths(equal, inner, label, folds, len(strengths))
    outer = F.element_at(F.array(*[fit((k,), strengths[best[k]]) for k in range(folds)]), F.col("fold") + 1)
    return rows.select(*scored.columns, "fold", (1 / (1 + F.exp(-outer))).alias("blend"))


def _best_strengths(equal: DataFrame, inner: dict[tuple, list[Column]], label: str, folds: int, n: int) -> list[int]:
    """For each fold the number of the penalty with the largest mean AUC over the other folds (the first, in a tie)."""
    judged = F.lit(None)
    for j in range(folds):
        scores = [F.struct(F.lit((k * folds + j) * n + i).alias("own"), inner[min(j, k), max(j, k)][i].alias("score")) for k in range(folds) if k != j for i in range(n)]
        judged = F.when(F.col("fold") == j, F.array(*scores)).otherwise(judged)
    rates = auc_by(equal.select(label, "_n", F.explode(judged).alias("r")).select(label, "_n", "r.*"), "own", "score", label, "_n")
    held = {r["own"]: r["auc"] or 0.0 for r in rates.collect()}
    mean = lambda k, i: sum(held.get((k * folds + j) * n + i, 0.0) for j in range(folds) if j != k)
    return [max(range(n), key=lambda i: (mean(k, i), -i)) for k in range(folds)]


def blended(
    train: DataFrame, held: DataFrame, columns: list[str], label: str, keys: list[str], names: tuple[str, ...] = ("boosted", "forest", "perceptron"), folds: int = 3
) -> DataFrame:
    """keys, label, fold, each learner's chance of a 1 and their logistic blend over the held rows.

    Learners fit on the training rows, which are prepared and written once for all; boosted trees stop early by a fifth of the
    training rows' users (of the first key). The blend is cross-validated over folds of the held rows' users
    (cross_validated_blend). With one learner its chance is the blend.
    """
    _read_in_waves(train.sparkSession)
    double = {c: F.col(c).cast("double") for c in [*columns, label]}
    late = F.pmod(F.xxhash64(F.lit("stop"), keys[0]), F.lit(5)) == 0
    train = train.withColumns(double).withColumn("_held", late)
    prepare = Pipeline(stages=_assembled(columns)).fit(train)
    rows = cut(prepare.transform(train).select("features", label, "_held"))
    out = prepare.transform(held.withColumns(double)).select(*keys, label, "features")
    for name in names:
        if name == "boosted":
            out = _boosted(prepare, rows, label, held_only=True).scored(out, name)
            continue
        model = learners(len(columns), label)[name].fit(rows).setRawPredictionCol("").setPredictionCol("")  # only chances are needed
        out = model.transform(out).withColumn(name, vector_to_array("probability")[1]).drop("probability")
    out = out.select(*keys, label, *names)
    if len(names) == 1:
        return out.withColumns({"fold": F.lit(0), "blend": F.col(names[0])}).select(*keys, label, "fold", *names, "blend")
    return cross_validated_blend(out, list(names), label, keys[0], folds).select(*keys, label, "fold", *names, "blend")
