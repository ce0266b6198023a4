"""History features: aggregates over what a user did in earlier tasks, never in the same one.

All are window expressions over (partition by keys), so rows shuffle once for a set of keys. The last N rows and lags are
taken at the first row of a task and shared by its rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tasklore.functions.scalars import shrunk

TASK = ("ts_ms", "task_container_id")


def task_ordinal(keys: list[str]) -> Column:
    """Number of the task among those of its keys, from 0."""
    return F.dense_rank().over(Window.partitionBy(*keys).orderBy(*TASK)) - 1


def earlier_tasks(keys: list[str], ordinal: str = "_k") -> Window:
    return Window.partitionBy(*keys).orderBy(ordinal).rangeBetween(Window.unboundedPreceding, -1)


def over_task(keys: list[str], at_row: Column, ordinal: str = "_k") -> Column:
    """The value at the task's first row, for all of its rows."""
    return F.first(at_row).over(Window.partitionBy(*keys, ordinal).orderBy("rn"))


def decay_chunk(decay: float) -> int:
    return math.ceil(40 / abs(math.log(decay)))


def decayed(keys: list[str], value: Column, decay: float, ordinal: str = "_k") -> Column:
    """Sum over earlier tasks j of value * decay^(k - j), in chunks of tasks that keep the powers within a double.

    Chunks before the last one weigh less than e^-40 and are left out.
    """
    size = decay_chunk(decay)
    chunk, place = F.floor(F.col(ordinal) / size), F.col(ordinal) % size
    same = Window.partitionBy(*keys, chunk).orderBy(ordinal).rangeBetween(Window.unboundedPreceding, -1)
    last = Window.partitionBy(*keys).orderBy(chunk).rangeBetween(-1, -1)
    power = lambda x: F.pow(F.lit(float(decay)), x)
    now = F.coalesce(F.sum(value * power(-place)).over(same), F.lit(0.0))
    before = F.coalesce(F.sum(value * power(size - place)).over(last), F.lit(0.0))
    return power(place) * (now + before)


def score_name(keys: list[str], weighted: bool, rolling: int | None, decay: float | None) -> tuple[str, str]:
    tail = (f"_{rolling}" if rolling else "") + (f"_decay_{decay}" if decay else "")
    stem = "_".join(keys) + ("_weighted" if weighted else "")
    return f"{stem}_score{tail}", f"{stem}_count{tail}"


def rolling_score(
    log: DataFrame,
    keys: list[str],
    smoothing: tuple[float, float] | None = None,
    prior: Column | float | None = None,
    rolling: int | None = None,
    weighted: bool = False,
    decay: float | None = None,
    time_since_last: bool = False,
    label: str = "answered_correctly",
    weight: str = "answer_weight",
) -> DataFrame:
    """Adds the score and count of the keys' rows in earlier tasks, and with time_since_last the time and tasks since.

    rolling keeps the last N rows, weighted takes the rows' weights for their number, decay multiplies by itself a task.
    A rolling score by weights is weighted_rolling.
    """
    if rolling and (time_since_last or decay):
        raise ValueError("a rolling score has neither decay nor time since last")
    if rolling and weighted:
        raise ValueError("a rolling score is not weighted")
    if time_since_last and len(keys) != 2:
        raise ValueError("time since last takes two keys")
    score, count = score_name(keys, weighted, rolling, decay)
    out = log.withColumn("_k", task_ordinal(keys))
    one = F.col(weight) if weighted else F.lit(1.0)
    y = F.col(label) * one
    if decay:
        total, n = decayed(keys, y, decay), decayed(keys, one, decay)
    elif rolling:
        rows = Window.partitionBy(*keys).orderBy("rn").rowsBetween(-rolling, -1)
        out = out.withColumns({"_s": F.coalesce(F.sum(y).over(rows), F.lit(0.0)), "_n": F.coalesce(F.sum(one).over(rows), F.lit(0.0))})
        total, n = over_task(keys, F.col("_s")), over_task(keys, F.col("_n"))
    else:
        before = earlier_tasks(keys)
        total, n = (F.coalesce(F.sum(x).over(before), F.lit(0.0)) for x in (y, one))
    out = out.withColumns({"_total": total, count: n})
    given = F.lit(0.5 if prior is None else prior) if not isinstance(prior, Column) else prior
    out = out.withColumn(score, shrunk(F.col("_total"), F.col(f"`{count}`"), given, *(smoothing or (None, None))))
    if time_since_last:
        before = earlier_tasks(keys)
        out = out.withColumns({
            f"time_since_last_{keys[1]}": F.col("ts_ms") - F.max("ts_ms").over(before),
            f"tasks_since_last_{keys[1]}": F.col("task_container_id") - F.max("task_container_id").over(before),
        })
    return out.drop("_k", "_s", "_n", "_total")


def rolling_scores(log: DataFrame, keys: list[str], specs: list[dict], prior: Column | float, label: str = "answered_correctly", weight: str = "answer_weight") -> DataFrame:
    """rolling_score for several settings (smoothing, rolling, weighted, decay, time_since_last) of the same keys, by two sorts in
    all: rows by task and rn, and for decays by chunk before these. Sums are over the rows before a task's first row, which come
    in order of rn, and stand at that row for the others of its task. Decays share the chunks of the longest where powers fit."""
    y, w = F.col(label), F.col(weight)
    rows = Window.partitionBy(*keys).orderBy(*TASK, "rn")
    before, task = rows.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys, *TASK).orderBy("rn")
    sums, chunked, out = {}, {}, {}
    longest = max([decay_chunk(d) for spec in specs if (d := spec.get("decay"))], default=0)
    for i, spec in enumerate(specs):
        if spec.get("rolling") and (spec.get("time_since_last") or spec.get("decay") or spec.get("weighted")):
            raise ValueError("a rolling score has no weights, decay or time since last")
        one = w if spec.get("weighted") else F.lit(1.0)
        values = {f"_t{i}": y * one, f"_c{i}": one}
        if d := spec.get("decay"):
            size = longest if longest * abs(math.log(d)) < 500 else decay_chunk(d)
            chunked.setdefault(size, []).append((d, values))
        else:
            frame = rows.rowsBetween(-n, -1) if (n := spec.get("rolling")) else before
            sums |= {c: F.coalesce(F.sum(v).over(frame), F.lit(0.0)) for c, v in values.items()}
        if spec.get("time_since_last"):
            if len(keys) != 2:
                raise ValueError("time since last takes two keys")
            sums |= {"_ts": F.max("ts_ms").over(before), "_task": F.max("task_container_id").over(before)}
            out[f"time_since_last_{keys[1]}"] = F.col("ts_ms") - F.col("_ts")
            out[f"tasks_since_last_{keys[1]}"] = F.col("task_container_id") - F.col("_task")
        score, count = score_name(keys, bool(spec.get("weighted")), spec.get("rolling"), spec.get("decay"))
        given = prior if isinstance(prior, Column) else F.lit(prior)
        out[score], out[count] = shrunk(F.col(f"_t{i}"), F.col(f"_c{i}"), given, *(spec.get("smoothing") or (None, None))), F.col(f"_c{i}")
    held = log.withColumns(sums)
    held = held.withColumns({c: F.first(c).over(task) for c in sums})
    gone = [*sums]
    if chunked:
        held = held.withColumn("_k", task_ordinal(keys))
    for size, decays in chunked.items():
        held = held.withColumns({"_chunk": F.floor(F.col("_k") / size), "_place": F.col("_k") % size})
        same = Window.partitionBy(*keys, "_chunk").orderBy(*TASK, "rn")
        last = Window.partitionBy(*keys).orderBy("_chunk").rangeBetween(-1, -1)
        power = lambda d, x: F.pow(F.lit(float(d)), x)
        now = {c: F.sum(v * power(d, -F.col("_place"))).over(same.rowsBetween(Window.unboundedPreceding, -1)) for d, values in decays for c, v in values.items()}
        held = held.withColumns(now)
        held = held.withColumns({c: F.first(c).over(Window.partitionBy(*keys, "_chunk", *TASK).orderBy("rn")) for c in now})
        past = {f"{c}_past": F.sum(v * power(d, size - F.col("_place"))).over(last) for d, values in decays for c, v in values.items()}
        held = held.withColumns(past)
        zero = F.lit(0.0)
        held = held.withColumns({c: power(d, F.col("_place")) * (F.coalesce(c, zero) + F.coalesce(f"{c}_past", zero)) for d, values in decays for c in values}).drop(*past)
        gone += [*now]
    return held.withColumns(out).drop("_k", "_chunk", "_place", *gone)


def weighted_rolling(log: DataFrame, keys: list[str], n: float, label: str = "answered_correctly", weight: str = "answer_weight") -> DataFrame:
    """Adds weighted_score_n and weighted_count_n: rows of earlier tasks, the oldest dropped while their weights exceed n.

    What is left is always the longest run of latest rows whose weights are n or less, so it is a range frame over the weight
    that came before a row, in billionths. Weights are 0 or more (null: 0); a sum of a billionth above n counts as n.
    """
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    so_far = Window.partitionBy(*keys).orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
    out = log.withColumns({"_k": task_ordinal(keys), "_c": F.round(F.coalesce(F.sum(w).over(so_far), F.lit(0.0)) * 1e9).cast("long")})
    held = Window.partitionBy(*keys).orderBy("_c").rangeBetween(-round(n * 1e9) - 1, -1)  # not the row itself
    out = out.withColumns({"_s": F.coalesce(F.sum(F.col(label) * w).over(held), F.lit(0.0)), "_n": F.coalesce(F.sum(w).over(held), F.lit(0.0))})
    out = out.withColumns({"_s": over_task(keys, F.col("_s")), "weighted_count_n": over_task(keys, F.col("_n"))})
    score = F.when(F.col("weighted_count_n") > 0, F.col("_s") / F.col("weighted_count_n"))
    return out.withColumn("weighted_score_n", score).select(*log.columns, "weighted_score_n", "weighted_count_n")


def last_lecture(value: str) -> Column:
    """The value at the user's last lecture row up to this one, even if it is null there; null before the first."""
    until = Window.partitionBy("user_id").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when(F.col("content_type_id") == 1, F.struct(F.col(value).alias("v"))), ignorenulls=True).over(until)
    return held.getField("v")


def running(value: Column, keys: list[str]) -> Column:
    return F.sum(value).over(Window.partitionBy(*keys).orderBy("rn").rowsBetween(Window.unboundedPreceding, 0))


def category_counts(log: DataFrame, category: str, values: list, prefix: str, where: Column) -> DataFrame:
    """Running counts of each category's rows, this one included, a column for each."""
    return log.withColumns({f"{prefix}{v}": running((where & (F.col(category) == v)).cast("int"), ["user_id"]) for v in values})


def task_lags(log: DataFrame, features: list[str], lags: int = 3) -> DataFrame:
    """Mean of each feature over the task, of the 1st to the last lag tasks before: `f_lag_l`."""
    tasks = log.groupBy("user_id", "task_container_id").agg(*[F.avg(f).alias(f) for f in features])
    order = Window.partitionBy("user_id").orderBy("task_container_id")
    lagged = tasks.select("user_id", "task_container_id", *[F.lag(f, k).over(order).alias(f"{f}_lag_{k}") for f in features for k in range(1, lags + 1)])
    return log.join(lagged, ["user_id", "task_container_id"], "left")


def row_lags(log: DataFrame, value: str, lags: int = 3) -> DataFrame:
    """The value of the 1st to the last lag rows before the task: `value_before_l`."""
    order = Window.partitionBy("user_id").orderBy("rn")
    out = log.withColumn("_k", task_ordinal(["user_id"])).withColumns({f"_l{k}": F.lag(value, k).over(order) for k in range(1, lags + 1)})
    first = Window.partitionBy("user_id", "_k").orderBy("rn")
    out = out.withColumns({f"{value}_before_{k}": F.first(f"_l{k}").over(first) for k in range(1, lags + 1)})
    return out.drop("_k", *[f"_l{k}" for k in range(1, lags + 1)])


def last_rows(log: DataFrame, keys: list[str], n: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("rn").desc())
    return log.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")
