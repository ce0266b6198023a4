"""Train and validation replay: hold out the latest whole tasks, deal them into batches, and say who is known."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tasklore.functions.scalars import uniform
from tasklore.operators.ranges import placed

DAY = 86_400_000


def global_times(log: DataFrame) -> DataFrame:
    """Adds global_ts: the user's timeline put at a place of the whole span that depends on the user."""
    span = log.groupBy("user_id").agg(F.max("ts_ms").alias("_d"))
    longest = span.agg((F.ceil(F.max("_d") / DAY) * DAY).alias("_all"))  # one row
    starts = span.crossJoin(F.broadcast(longest)).select("user_id", F.round(uniform(F.col("user_id")) * (F.col("_all") - F.col("_d"))).cast("long").alias("_start"))
    return log.join(starts, "user_id").withColumn("global_ts", F.col("_start") + F.col("ts_ms")).drop("_start")


def latest_tasks(log: DataFrame, size: int) -> DataFrame:
    """user_id, task_container_id, global_ts: whole tasks from the latest on, while their rows add up to `size` at most.

    The running total goes over days first, so that only days, and then the tasks of single days, are ever in one task.
    """
    tasks = log.groupBy("user_id", "task_container_id", "global_ts").agg(F.count("*").alias("n")).withColumn("day", F.floor(F.col("global_ts") / DAY))
    later = Window.orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, -1)
    days = tasks.groupBy("day").agg(F.sum("n").alias("n")).select("day", F.coalesce(F.sum("n").over(later), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("day").orderBy(F.col("global_ts").desc(), "user_id", "task_container_id").rowsBetween(Window.unboundedPreceding, 0)
    out = tasks.join(days, "day").withColumn("_upto", F.col("_before") + F.sum("n").over(inside))
    return out.where(F.col("_upto") <= size).select("user_id", "task_container_id", "global_ts")


def weighted_start(chance: Column, n_places: Column, n: Column) -> Column:
    """The place, from 0, at which the running total of start_weight passes `chance` (from [0, 1)) of the whole: all places
    of a user are gone through within one row."""
    places = F.sequence(F.lit(0), (n_places - 1).cast("int"))
    weight = lambda k: start_weight(k, n_places, n)
    total = F.aggregate(places, F.lit(0.0), lambda s, k: s + weight(k))
    begin = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("place"), total.alias("total"))

    def step(s: Column, k: Column) -> Column:
        now = s["sum"] + weight(k)
        return F.struct(now.alias("sum"), (s["place"] + F.when(now <= chance * s["total"], 1).otherwise(0)).alias("place"), s["total"].alias("total"))

    return F.least(F.aggregate(places, begin, step, lambda s: s["place"]), (n_places - 1).cast("int"))


def deal_batches(tasks: DataFrame, n_batches: int) -> DataFrame:
    """user_id, task_container_id, batch_id: a user's tasks go to consecutive batches from a weighted start that depends on the user."""
    users = tasks.groupBy("user_id").agg(F.count("*").alias("_n"))
    places = F.greatest(n_batches - F.col("_n") + 1, F.lit(1))
    starts = users.select("user_id", weighted_start(uniform(F.col("user_id")), places, F.col("_n")).alias("_start"))
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("global_ts", "task_container_id")) - 1
    out = tasks.select("user_id", "task_container_id", nth.alias("_nth")).join(starts, "user_id")
    return out.select("user_id", "task_container_id", (F.col("_start") + F.col("_nth")).cast("long").alias("batch_id"))


def start_weight(place: Column, n_places: Column, n: Column) -> Column:
    """Weight of a start: larger toward both ends, so that all batches fill alike."""
    return F.when(place < n, F.sqrt(n / (place + 1))).when(place >= n_places - n, F.sqrt(n / (n_places - place))).otherwise(1.0)


def last_users(log: DataFrame, share: float) -> DataFrame:
    """user_id of the last `share` of the users by number, rounded down."""
    users = placed(log.select("user_id").distinct(), [F.col("user_id").desc()])
    return users.where(F.col("_place") <= F.floor(F.col("_total") * share)).select("user_id")


def save_batches(batches: DataFrame, path: str) -> None:
    batches.write.mode("overwrite").parquet(path)


def load_batches(spark: SparkSession, path: str) -> DataFrame:
    """The persisted assignment of tasks to batches; says how to make it where it is missing."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"no batches at {path}: deal and save them first (deal_batches, save_batches)") from e


def split(log: DataFrame, batches: DataFrame, ratio: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train rows (in no batch), and the rows of the first batches and of the last `ratio` of them."""
    merged = log.join(batches, ["user_id", "task_container_id"], "left")
    last = batches.select("batch_id").distinct().withColumn("_r", F.percent_rank().over(Window.orderBy("batch_id")))
    late = last.where(F.col("_r") > 1 - ratio).select("batch_id")
    held = merged.where("batch_id is not null")
    return merged.where("batch_id is null").drop("batch_id"), held.join(late, "batch_id", "left_anti"), held.join(late, "batch_id", "left_semi")


def replay_batches(rows: DataFrame) -> DataFrame:
    """Adds the right answers and responses of the batch before, the last that there is, as the text of a list on the first
    row of a batch, else null. The first batch has the empty list."""
    order = Window.partitionBy("batch_id").orderBy("user_id", "rn")
    done = rows.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("user_id", "rn", "answered_correctly", "user_answer"))).alias("_l"))
    ids = done.select("batch_id", F.lag("batch_id").over(Window.orderBy("batch_id")).alias("_prior"))  # a number for each batch
    text = lambda name: F.concat(F.lit("["), F.array_join(F.col(f"_l.{name}").cast("array<string>"), ", "), F.lit("]"))
    told = done.select(F.col("batch_id").alias("_prior"), text("answered_correctly").alias("_c"), text("user_answer").alias("_u"))
    before = ids.join(told, "_prior", "left").select("batch_id", *(F.coalesce(c, F.lit("[]")).alias(c) for c in ("_c", "_u")))
    out = rows.withColumn("_first", F.row_number().over(order)).join(before, "batch_id", "left")
    first = F.col("_first") == 1
    return out.withColumns({"prior_group_answers_correct": F.when(first, F.col("_c")), "prior_group_responses": F.when(first, F.col("_u"))}).drop("_first", "_c", "_u")
