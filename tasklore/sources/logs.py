"""Readers of interaction logs: CSV files with fixed schemas, and two logs made of the star schema's tables.

An interaction log has a row for each question answered (content_type_id 0) or lecture watched (1), with ts_ms since the
user's first event, task_container_id (rows shown together) and rn, a total order of the user's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The columns of the three source tables.
INTERACTIONS = (
    "timestamp long, user_id int, content_id int, content_type_id int, task_container_id int, user_answer int,"
    " answered_correctly int, prior_question_elapsed_time double, prior_question_had_explanation boolean"
)
QUESTIONS = "question_id int, bundle_id int, correct_answer int, part int, tags string"
LECTURES = "lecture_id int, tag int, part int, type_of string"
# Rows that a task of a large log holds, and bytes of a shuffle that are not dealt to more tasks.
ROWS_A_TASK, JOINED_BYTES = 200_000, 8 << 20


def read_csv(spark: SparkSession, path: str, schema: str, rows: int | None = None) -> DataFrame:
    """A CSV file with a header, only the columns of the schema, in its types; the first `rows` of it if given."""
    wanted = [c.split()[0] for c in schema.split(", ")]
    header = spark.read.option("header", True).csv(path).columns
    full = ", ".join(next((c for c in schema.split(", ") if c.split()[0] == h), f"`{h}` string") for h in header)
    df = spark.read.option("header", True).schema(full).csv(path).select(*wanted)
    return df if rows is None else df.limit(rows)


def load(spark: SparkSession, folder: str, users: int = 0, rows: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Interactions, questions and lectures out of a folder's train.csv, questions.csv and lectures.csv, each a file or a folder
    of files: all interactions, their first `rows`, or those of the first (below 0: last) `users` by number."""
    log = read_csv(spark, f"{folder}/train.csv", INTERACTIONS, rows)
    return first_users(log, users, ["user_id"]), read_csv(spark, f"{folder}/questions.csv", QUESTIONS), read_csv(spark, f"{folder}/lectures.csv", LECTURES)


def millis(name: str) -> Column:
    return F.unix_millis(F.col(name).cast("timestamp"))


def _bytes(size: str) -> int:
    held = size.lower().rstrip("b")
    return int(held.rstrip("kmg")) << {"k": 10, "m": 20, "g": 30}.get(held[-1], 0)


def enough_partitions(rows: DataFrame) -> None:
    """Raises the session's shuffle partitions so that one holds about ROWS_A_TASK of these rows, and lowers the size up to which
    Spark joins small ones again, as a task's memory goes with both. Parquet rows are counted by the files' footers."""
    conf, joined = rows.sparkSession.conf, "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    n = -(-rows.count() // ROWS_A_TASK)
    if n > int(conf.get("spark.sql.shuffle.partitions")):
        conf.set("spark.sql.shuffle.partitions", n)
    if _bytes(conf.get(joined)) > JOINED_BYTES:
        conf.set(joined, str(JOINED_BYTES))


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as questions answered: an order is a task, a customer a user, a part a question."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    enough_partitions(lines)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    items = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(items, F.col("l_partkey") == F.col("p_partkey"))
    # the user's column under its last name, and the longest order first: one exchange and one sort serve all three windows
    user = Window.partitionBy("user_id")
    order = user.orderBy("o_orderdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    rows = rows.withColumn("user_id", F.col("o_custkey")).drop("o_custkey").withColumn("rn", F.row_number().over(order).cast("long"))
    rows = rows.withColumn("task_container_id", (F.dense_rank().over(user.orderBy("o_orderdate", "l_orderkey")) - 1).cast("long"))
    rows = rows.withColumn("ts_ms", millis("o_orderdate") - F.min(millis("o_orderdate")).over(user))
    right = F.col("l_returnflag") != "R"
    answer = F.col("l_partkey") % 4
    return rows.select(
        "user_id",
        "ts_ms",
        "task_container_id",
        "rn",
        F.col("l_partkey").alias("content_id"),
        F.lit(0).alias("content_type_id"),
        right.cast("int").alias("answered_correctly"),
        answer.cast("int").alias("correct_answer"),
        F.when(right, answer).otherwise((answer + 1 + F.col("l_quantity").cast("int") % 3) % 4).cast("int").alias("user_answer"),
        (F.col("l_quantity") * 1000).cast("double").alias("elapsed_ms"),
        (F.col("l_discount") > 0.05).cast("int").alias("had_explanation"),
        (F.col("p_size") % 7 + 1).cast("int").alias("question_part"),
        F.expr("int(substr(p_brand, 7))").alias("question_tag"),
        F.col("p_type").alias("question_category"),
        F.col("p_name").alias("tags"),
    )


def watch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as single-row tasks with lectures ("signup") among them."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    user = Window.partitionBy("user_id")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    rn = F.row_number().over(user.orderBy(millis("ts"), "event_id")).cast("long")
    return rows.select(
        "user_id",
        (millis("ts") - F.min(millis("ts")).over(user)).alias("ts_ms"),
        rn.alias("rn"),
        (rn - 1).alias("task_container_id"),
        k.alias("content_id"),
        (F.col("event_type") == "signup").cast("int").alias("content_type_id"),
        (k % 7 + 1).alias("part"),
        (k % 10).alias("tag"),
        (F.col("value") >= 30).cast("int").alias("answered_correctly"),
        F.col("event_type").alias("type_of"),
    )


def study_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both logs as one: order lines as questions, and each user's "signup" events as lectures among them, their days stretched
    by 80 so that they spread over the years of orders. Each log starts at 0 for each of its users. Lecture rows have null
    answers; prior_question_elapsed_time and prior_question_had_explanation are of the row."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    enough_partitions(lines)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    items = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(items, F.col("l_partkey") == F.col("p_partkey"))
    right, answer = F.col("l_returnflag") != "R", F.col("l_partkey") % 4
    questions = rows.select(
        F.col("o_custkey").alias("user_id"),
        (millis("o_orderdate") - F.min(millis("o_orderdate")).over(Window.partitionBy("o_custkey"))).alias("ts_ms"),
        F.lit(0).alias("content_type_id"),
        F.col("l_orderkey").alias("_k"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate").alias("_o"),
        F.col("l_partkey").alias("content_id"),
        right.cast("int").alias("answered_correctly"),
        answer.cast("int").alias("correct_answer"),
        F.when(right, answer).otherwise((answer + 1 + F.col("l_quantity").cast("int") % 3) % 4).cast("int").alias("user_answer"),
        (F.col("l_quantity") * 1000).cast("double").alias("prior_question_elapsed_time"),
        (F.col("l_discount") > 0.05).cast("int").alias("prior_question_had_explanation"),
        (F.col("p_size") % 7 + 1).cast("int").alias("part"),
        F.expr("int(substr(p_brand, 7))").alias("tag"),
        F.col("p_type").alias("question_category"),
        F.col("p_name").alias("tags"),
    )
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    begun = events.withColumn("ts_ms", (millis("ts") - F.min(millis("ts")).over(Window.partitionBy("user_id"))) * 80).where("event_type = 'signup'")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    kinds = dict(questions.dtypes)
    made = {"user_id": F.col("user_id"), "ts_ms": F.col("ts_ms"), "content_type_id": F.lit(1), "_k": F.col("event_id"), "content_id": k, "part": k % 7 + 1, "tag": k % 10}
    lectures = begun.select(*[made.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in questions.columns])
    task = Window.partitionBy("user_id").orderBy("ts_ms", "content_type_id", "_k")
    both = questions.unionByName(lectures)
    out = both.withColumns({
        "task_container_id": (F.dense_rank().over(task) - 1).cast("long"),
        "rn": F.row_number().over(Window.partitionBy("user_id").orderBy("ts_ms", "content_type_id", "_k", "_o")).cast("long"),
    })
    return out.drop("_k", "_o")


def first_users(log: DataFrame, n: int, order: list[str]) -> DataFrame:
    """Rows of the first n users by appearance in the order given; for n <= 0 of the last |n| (all, if n is 0)."""
    if n == 0:
        return log
    first = log.groupBy("user_id").agg(F.min(F.struct(*order)).alias("first"))
    place = F.col("first").asc() if n > 0 else F.col("first").desc()
    return log.join(first.orderBy(place).limit(abs(n)).select("user_id"), "user_id", "left_semi")


def first_rows(log: DataFrame, n: int, order: list[str]) -> DataFrame:
    return log.orderBy(*order).limit(n)
