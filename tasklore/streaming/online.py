"""Online forms of the features: a keyed stream of rows shown to users and of the answers to earlier ones.

A batch carries the answers to what was shown before (kind "answer") beside what is shown now (kind "question" or
"lecture"). Answers go into the state first; then each row, by rn, reads the state, and only after that changes it.
So no row sees its own label, and a user without a state gets the defaults of the batch forms.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tasklore.functions.scalars import shrunk

SHOWN = "user_id long, rn long, user_id_score double, user_id_count double, session_id long, session_time long, n_lectures long, time_since_last_lecture double, tasks_since_last_lecture double"
STATE = "total double, n double, session long, began long, prior_ts long, n_lectures long, lecture_ts long, lecture_task long"
SESSION_GAP = 7_200_000


def _ordered(batches: Iterator[pd.DataFrame]) -> tuple[pd.DataFrame, pd.DataFrame]:
    """A key's rows of a batch: the answers, and what is shown, by rn."""
    every = pd.concat(list(batches), ignore_index=True)
    told = every["kind"] == "answer"
    return every[told].sort_values("rn", kind="stable"), every[~told].sort_values("rn", kind="stable")


def online_features(stream: DataFrame) -> DataFrame:
    """A stream of (user_id, rn, ts_ms, task_container_id, kind, answered_correctly) -> SHOWN for each row shown: the score
    over all answers so far, the session, and the lectures up to the row, as the batch forms have them."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, n, session, began, prior, n_lectures, lecture_ts, lecture_task = state.get if state.exists else (0.0, 0.0, 0, 0, -1, 0, -1, -1)
        answers, shown = _ordered(batches)
        total, n = total + float(answers["answered_correctly"].sum()), n + len(answers)
        out = []
        for row in shown.itertuples(index=False):
            if row.ts_ms - max(prior, 0) >= SESSION_GAP:
                session, began = session + 1, row.ts_ms
            elif prior < 0:
                began = row.ts_ms
            prior = row.ts_ms
            if row.kind == "lecture":
                n_lectures, lecture_ts, lecture_task = n_lectures + 1, row.ts_ms, row.task_container_id
            since = (float(row.ts_ms - lecture_ts), float(row.task_container_id - lecture_task)) if n_lectures else (None, None)
            out.append((key[0], row.rn, total / n if n else None, n, session, row.ts_ms - began, n_lectures, *since))
        state.update((total, n, int(session), int(began), int(prior), int(n_lectures), int(lecture_ts), int(lecture_task)))
        names = [c.split()[0] for c in SHOWN.split(", ")]
        yield pd.DataFrame(out, columns=names).astype({c: "float64" for c in names if c.startswith(("user_id_", "time_", "tasks_"))})

    return stream.groupBy("user_id").applyInPandasWithState(step, SHOWN, STATE, "append", GroupStateTimeout.NoTimeout)


def rolling_context(stream: DataFrame, size: int = 100) -> DataFrame:
    """A stream of (user_id, rn, task_container_id, content_id, kind) -> user_id, rn, context: for each row shown the last
    `size` items of the user before the row's task, oldest first, 0 where there are fewer. Rows of a task come in one batch."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        out = []
        for _, task in _ordered(batches)[1].groupby("task_container_id", sort=True):
            context = [0] * (size - len(held)) + held
            out += [(key[0], rn, context) for rn in task["rn"]]
            held = (held + [int(x) for x in task["content_id"]])[-size:]
        state.update((held,))
        yield pd.DataFrame(out, columns=["user_id", "rn", "context"])

    return stream.groupBy("user_id").applyInPandasWithState(step, "user_id long, rn long, context array<long>", "held array<long>", "append", GroupStateTimeout.NoTimeout)


class ItemScores:
    """State across users: sums of answers by item, a small table that each batch of a stream reads and then replaces.

    Give `step` to foreachBatch. Each batch writes the table of its own number, so that a batch run again reads what it read
    before; what is shown is scored by the table before the batch, and its answers count from the next batch on.
    """

    FACTS = "content_id long, s long, n long"

    def __init__(self, spark: SparkSession, path: str, prior: float = 0.5, smoothing: tuple[float, float] = (5, 1)):
        self.spark, self.path, self.prior, self.smoothing = spark, path, prior, smoothing

    def table(self, batch_id: int) -> DataFrame:
        """The sums before a batch."""
        return self.spark.read.schema(self.FACTS).parquet(f"{self.path}/facts/before={batch_id}") if batch_id else self.spark.createDataFrame([], self.FACTS)

    def step(self, batch: DataFrame, batch_id: int) -> None:
        known = self.table(batch_id)
        shown = batch.where("kind = 'question'").join(known, "content_id", "left")
        n = F.coalesce("n", F.lit(0))
        scored = shown.select("user_id", "rn", "content_id", shrunk(F.coalesce("s", F.lit(0)), n, F.lit(self.prior), *self.smoothing).alias("content_id_encoded"))
        scored.write.mode("overwrite").parquet(f"{self.path}/scored/batch={batch_id}")
        told = batch.where("kind = 'answer'").groupBy("content_id").agg(F.sum("answered_correctly").alias("s"), F.count("*").alias("n"))
        merged = known.unionByName(told).groupBy("content_id").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        merged.write.mode("overwrite").parquet(f"{self.path}/facts/before={batch_id + 1}")
