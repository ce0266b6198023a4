"""Queries by operator, and the SQL that gives the same rows.

Names start with the operator's number in the survey. Queries over interactions use the log made of orders; those with
lectures use the log made of events. Sums of products and powers are rounded to nine places in both forms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tasklore.functions import scalars as fn
from tasklore.operators import encoders, history, items, sequences, sessions
from tasklore.plans import frame, models, profile, replay
from tasklore.sources import logs
from tasklore.sources.store import cut, scratch
from tasklore.streaming import stateful

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
ROW = ["user_id", "rn"]

I = """with i as (
  select user_id, ms - min(ms) over (partition by user_id) as ts_ms,
    dense_rank() over (partition by user_id order by o_orderdate, l_orderkey) - 1 as task_container_id,
    row_number() over (partition by user_id order by o_orderdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) as rn,
    l_partkey as content_id, y as answered_correctly, (l_partkey % 4)::int as correct_answer,
    (case when y = 1 then l_partkey % 4 else (l_partkey % 4 + 1 + q % 3) % 4 end)::int as user_answer, l_quantity * 1000.0::double as elapsed_ms,
    case when l_discount > 0.05 then 1 else 0 end as had_explanation, p_size % 7 + 1 as question_part, substr(p_brand, 7)::int as question_tag,
    p_type as question_category, p_name as tags
  from (select *, o_custkey as user_id, epoch_us(o_orderdate::timestamp) // 1000 as ms, case when l_returnflag <> 'R' then 1 else 0 end as y, trunc(l_quantity)::int as q
        from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey))"""
V = """with v0 as (
  select *, epoch_us(ts::timestamp) // 1000 as ms, regexp_extract(props, '([0-9]+)', 1)::int as k from events), v as (
  select user_id, ms - min(ms) over (partition by user_id) as ts_ms, row_number() over (partition by user_id order by ms, event_id) as rn,
    row_number() over (partition by user_id order by ms, event_id) - 1 as task_container_id, k as content_id,
    case when event_type = 'signup' then 1 else 0 end as content_type_id, k % 7 + 1 as part, k % 10 as tag,
    case when value >= 30 then 1 else 0 end as answered_correctly, event_type as type_of from v0)"""
BEFORE = "groups between unbounded preceding and 1 preceding"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(F.col(f"`{c}`"), 9) for c, t in df.dtypes if t == "double"})


def _i(spark: SparkSession, d: str) -> DataFrame:
    return logs.interactions(spark, d)


def _v(spark: SparkSession, d: str) -> DataFrame:
    return logs.watch_log(spark, d)


def _sigmoid(n: str, least: float, value: float) -> str:
    return f"(1 / (1 + exp(-({n} - {least}) / {value}::double)))"


# history windows


KEYS_SQL = "user_id, question_part"
_W1 = f"""{I}, k as (select *, dense_rank() over (partition by {KEYS_SQL} order by ts_ms, task_container_id) as k from i),
s as (select *, coalesce(sum(answered_correctly) over w, 0) as s, coalesce(sum(1) over w, 0)::double as n, max(ts_ms) over w as t, max(task_container_id) over w as c,
  (select avg(answered_correctly) from i) as prior from k window w as (partition by {KEYS_SQL} order by k {BEFORE}))
select user_id, rn, n as user_id_question_part_count, ts_ms - t as time_since_last_question_part, task_container_id - c as tasks_since_last_question_part,
  round(case when n > 0 then {_sigmoid('n', 5, 2)} * s / n + (1 - {_sigmoid('n', 5, 2)}) * prior else prior end, 9) as user_id_question_part_score from s"""


def _with_prior(log: DataFrame) -> DataFrame:
    return log.crossJoin(F.broadcast(log.agg(F.avg("answered_correctly").alias("_overall"))))  # one row


@query(_W1)
def w1_rolling_score(spark, d):
    out = history.rolling_score(_with_prior(_i(spark, d)), ["user_id", "question_part"], (5, 2), F.col("_overall"), time_since_last=True)
    names = ["user_id_question_part_score", "user_id_question_part_count", "time_since_last_question_part", "tasks_since_last_question_part"]
    return rounded(out.select(*ROW, *names))


@query(f"""{I}, k as (select *, dense_rank() over (partition by user_id order by ts_ms, task_container_id) as k from i),
s as (select *, coalesce(sum(answered_correctly) over w, 0) as s, coalesce(sum(1) over w, 0) as n from k window w as (partition by user_id order by k {BEFORE}))
select user_id, rn, n::double as user_id_count, round(case when n > 0 then s / n end, 9) as user_id_score from s""")
def w1_raw_score(spark, d):
    return rounded(history.rolling_score(_i(spark, d), ["user_id"]).select(*ROW, "user_id_score", "user_id_count"))


@query(f"""{I}, k as (select *, dense_rank() over (partition by user_id order by ts_ms, task_container_id) as k from i),
s as (select *, coalesce(sum(answered_correctly) over w, 0) as s, coalesce(sum(1) over w, 0) as n from k window w as (partition by user_id order by rn rows between 5 preceding and 1 preceding)),
f as (select *, first(s) over t as fs, first(n) over t as fn from s window t as (partition by user_id, k order by rn))
select user_id, rn, fn::double as user_id_count_5, round(case when fn > 0 then fs / fn end, 9) as user_id_score_5 from f""")
def w2_last_n(spark, d):
    return rounded(history.rolling_score(_i(spark, d), ["user_id"], rolling=5).select(*ROW, "user_id_score_5", "user_id_count_5"))


_WEIGHT = "case when answered_correctly = 0 then 0.3 else 0.7 end::double"


def _weighted(spark, d):
    return _i(spark, d).withColumn("answer_weight", fn.answer_weight(F.lit(0.3), F.col("answered_correctly")))


@query(f"""{I}, k as (select *, {_WEIGHT} as w0, dense_rank() over (partition by user_id order by ts_ms, task_container_id) as k from i),
s as (select *, coalesce(sum(answered_correctly * w0) over w, 0) as s, coalesce(sum(w0) over w, 0) as n from k window w as (partition by user_id order by k {BEFORE}))
select user_id, rn, round(n, 9) as user_id_weighted_count, round(case when n > 0 then s / n end, 9) as user_id_weighted_score from s""")
def w3_weighted(spark, d):
    return rounded(history.rolling_score(_weighted(spark, d), ["user_id"], weighted=True).select(*ROW, "user_id_weighted_score", "user_id_weighted_count"))


def _decay_sql(keys: str, name: str, decay: float, weight: str = "1.0::double") -> str:
    score, count = name
    return f"""{I}, k as (select *, {weight} as w0, dense_rank() over (partition by {keys} order by ts_ms, task_container_id) - 1 as k from i),
s as (select *, coalesce(sum(answered_correctly * w0 * pow({decay}, -k)) over w, 0) * pow({decay}, k) as s, coalesce(sum(w0 * pow({decay}, -k)) over w, 0) * pow({decay}, k) as n
  from k window w as (partition by {keys} order by k {BEFORE}))
select user_id, rn, round(n, 9) as {count}, round(case when n > 0 then s / n end, 9) as {score} from s"""


@query(_decay_sql("user_id, question_category", ('"user_id_question_category_score_decay_0.9"', '"user_id_question_category_count_decay_0.9"'), 0.9))
def w4_decayed(spark, d):
    keys = ["user_id", "question_category"]
    return rounded(history.rolling_score(_i(spark, d), keys, decay=0.9).select(*ROW, *[f"`{x}`" for x in history.score_name(keys, False, None, 0.9)]))


@query(_decay_sql("user_id", ('"user_id_weighted_score_decay_0.98"', '"user_id_weighted_count_decay_0.98"'), 0.98, _WEIGHT))
def w4b_weighted_decayed(spark, d):
    return rounded(history.rolling_score(_weighted(spark, d), ["user_id"], weighted=True, decay=0.98).select(*ROW, *[f"`{x}`" for x in history.score_name(["user_id"], True, None, 0.98)]))


@query(f"""{I}, x as (select user_id, rn, task_container_id as k, answered_correctly as y, {_WEIGHT} as w from i),
c as (select *, sum(w) over (partition by user_id order by rn) - w as c from x),
t as (select user_id, k, min(c) as c from c group by all),
s as (select t.user_id, t.k, sum(c.y * c.w) as s, sum(c.w) as n from t join c on c.user_id = t.user_id and c.k < t.k and t.c - c.c <= 3 + 1e-9 group by all)
select user_id, rn, round(s / n, 9) as weighted_score_n, round(coalesce(n, 0), 9) as weighted_count_n from x left join s using (user_id, k)""")
def w4d_weighted_last_n(spark, d):
    return rounded(history.weighted_rolling(_weighted(spark, d), ["user_id"], 3.0).select(*ROW, "weighted_score_n", "weighted_count_n"))


_LAST = "last_value(case when content_type_id = 1 then {0} end ignore nulls) over (partition by user_id order by rn rows unbounded preceding)"


@query(f"""{V} select user_id, rn, {_LAST.format('ts_ms')} as last_ts, {_LAST.format('content_id')} as last_id from v""")
def w6_last_lecture(spark, d):
    return _v(spark, d).select(*ROW, history.last_lecture("ts_ms").alias("last_ts"), history.last_lecture("content_id").alias("last_id"))


@query(f"""{V} select user_id, rn, (sum(content_type_id) over w)::bigint as n_lectures, count(*) over w as n_rows,
  {', '.join(f"(sum(case when content_type_id = 1 and part = {k} then 1 else 0 end) over w)::bigint as n_part{k}" for k in range(1, 8))}
from v window w as (partition by user_id order by rn rows unbounded preceding)""")
def w7_running_counts(spark, d):
    log = _v(spark, d)
    out = log.withColumns({"n_lectures": history.running(F.col("content_type_id"), ["user_id"]), "n_rows": history.running(F.lit(1), ["user_id"])})
    out = history.category_counts(out, "part", list(range(1, 8)), "n_part", F.col("content_type_id") == 1)
    return out.select(*ROW, "n_lectures", "n_rows", *[f"n_part{k}" for k in range(1, 8)])


@query(f"""{I}, t as (select user_id, task_container_id, avg(elapsed_ms) as e, avg(had_explanation) as h from i group by all),
l as (select user_id, task_container_id, {', '.join(f"lag({a}, {k}) over w as {b}_lag_{k}" for a, b in (('e', 'elapsed_ms'), ('h', 'had_explanation')) for k in (1, 2, 3))}
  from t window w as (partition by user_id order by task_container_id))
select i.user_id, rn, {', '.join(f"round({b}_lag_{k}, 9) as {b}_lag_{k}" for b in ('elapsed_ms', 'had_explanation') for k in (1, 2, 3))} from i left join l using (user_id, task_container_id)""")
def w10_task_lags(spark, d):
    names = ["elapsed_ms", "had_explanation"]
    return rounded(history.task_lags(_i(spark, d), names).select(*ROW, *[f"{n}_lag_{k}" for n in names for k in (1, 2, 3)]))


@query(f"""{V} select user_id, rn, ts_ms - lag(ts_ms) over w as gap, lead(ts_ms) over w - ts_ms as until_next from v window w as (partition by user_id order by rn)""")
def w11_differences(spark, d):
    w = Window.partitionBy("user_id").orderBy("rn")
    return _v(spark, d).select(*ROW, (F.col("ts_ms") - F.lag("ts_ms").over(w)).alias("gap"), (F.lead("ts_ms").over(w) - F.col("ts_ms")).alias("until_next"))


@query(f"""{I} select user_id, rn, content_id from i qualify row_number() over (partition by user_id order by rn desc) <= 3""")
def w14_last_rows(spark, d):
    return history.last_rows(_i(spark, d), ["user_id"], 3).select(*ROW, "content_id")


@query(f"""{I}, k as (select *, dense_rank() over (partition by user_id order by ts_ms, task_container_id) as k from i),
l as (select *, {', '.join(f"lag(content_id, {k}) over (partition by user_id order by rn) as l{k}" for k in (1, 2, 3))} from k)
select user_id, rn, {', '.join(f"first(l{k}) over (partition by user_id, k order by rn) as content_id_before_{k}" for k in (1, 2, 3))} from l""")
def w17_rows_before_task(spark, d):
    return history.row_lags(_i(spark, d), "content_id").select(*ROW, *[f"content_id_before_{k}" for k in (1, 2, 3)])


# encoders

_RATIOS = """, c as (select content_id, correct_answer, user_answer, count(*) as n from i group by all),
t as (select *, sum(n) over (partition by content_id) as total, case when user_answer = correct_answer then 1 else 0 end as is_correct from c),
p as (select is_correct, sum(n) / sum(total) as prior from t group by is_correct),
r as (select content_id, user_answer, is_correct, {w} * n / total + (1 - {w}) * prior as answer_ratio from t join p using (is_correct))"""
_R51, _R102 = (_RATIOS.replace("{w}", _sigmoid("total", *x)) for x in ((5, 1), (10, 2)))


@query(f"""{I}{_R51} select content_id, user_answer, is_correct, round(answer_ratio, 9) as answer_ratio from r""")
def a5_answer_ratios(spark, d):
    return rounded(encoders.answer_ratios(_i(spark, d), (5, 1)))


@query(f"""{I}{_R51}, k as (select user_id, task_container_id, avg(answer_ratio) as a from i left join r using (content_id, user_answer) group by all),
l as (select user_id, task_container_id, lag(a) over (partition by user_id order by task_container_id) as a from k)
select i.user_id, rn, round(a, 9) as prior_answer_ratio from i left join l using (user_id, task_container_id)""")
def a6_prior_answer_ratio(spark, d):
    return rounded(encoders.prior_answer_ratio(_i(spark, d)).select(*ROW, "prior_answer_ratio"))


@query(f"""{I}{_R102}, n as (select *, row_number() over (partition by content_id order by answer_ratio desc, user_answer) as nth from r where is_correct = 0),
w as (select content_id, {', '.join(f"coalesce(max(case when nth = {k} then answer_ratio end), 0) as answer_{k + 1}_ratio" for k in (1, 2, 3))} from n group by content_id)
select i.user_id, rn, {', '.join(f"round(coalesce(answer_{k}_ratio, (select avg(answer_{k}_ratio) from w)), 9) as answer_{k}_ratio" for k in (2, 3, 4))} from i left join w using (content_id)""")
def a7_incorrect_answers(spark, d):
    log = _i(spark, d)
    return rounded(encoders.with_incorrect_answers(log, encoders.incorrect_answers(log)).select(*ROW, *encoders.WRONG))


@query(f"""{I}{_R102}, e as (select content_id, {', '.join(f"coalesce(max(case when user_answer = {k} then answer_ratio end), 0) as e{k}" for k in range(4))} from r group by content_id),
x as (select *, rn - 1 as k from i join e using (content_id)),
s as (select *, {', '.join(f"coalesce(sum((case when user_answer = {k} then 1 else 0 end) * pow(0.99, -k)) over w, 0) * pow(0.99, k - 1) as sa{k}, coalesce(sum(e{k} * pow(0.99, -k)) over w, 0) * pow(0.99, k - 1) as se{k}" for k in range(4))}
  from x window w as (partition by user_id order by k rows between unbounded preceding and 1 preceding)),
f as (select user_id, rn, [sa0, sa1, sa2, sa3][correct_answer + 1] as a, [se0, se1, se2, se3][correct_answer + 1] as n from s)
select user_id, rn, round(case when n > 0 then {_sigmoid('n', 4, 1)} * a / n + (1 - {_sigmoid('n', 4, 1)}) else 1 end, 9) as user_answer_frequency from f""")
def a8_answer_frequency(spark, d):
    log = cut(_i(spark, d).select(*ROW, "content_id", "correct_answer", "user_answer"))  # read twice
    return rounded(encoders.answer_frequency(log).select(*ROW, "user_answer_frequency"))


@query(f"""{I}, f as (select content_id, sum(answered_correctly) as s, count(*) as n from i group by content_id)
select user_id, rn, round({_sigmoid('n', 5, 1)} * s / n + (1 - {_sigmoid('n', 5, 1)}) * (select avg(answered_correctly) from i), 9) as content_id_encoded from i join f using (content_id)""")
def a2_score_encoder(spark, d):
    return rounded(encoders.score_encoder(_i(spark, d), ["content_id"]).select(*ROW, "content_id_encoded"))


@query(f"""{I}, f as (select content_id, sum(answered_correctly) as s, count(*) as n from i group by content_id),
e as (select i.*, {_sigmoid('n', 5, 1)} * s / n + (1 - {_sigmoid('n', 5, 1)}) * (select avg(answered_correctly) from i) as parent from i join f using (content_id)),
g as (select had_explanation, content_id, sum(answered_correctly) as s, count(*) as n from i group by all)
select user_id, rn, round({_sigmoid('n', 20, 5)} * s / n + (1 - {_sigmoid('n', 20, 5)}) * parent, 9) as had_explanation_content_id_encoded from e join g using (had_explanation, content_id)""")
def a2_score_encoder_with_parent(spark, d):
    log = cut(_i(spark, d).select(*ROW, "content_id", "had_explanation", "answered_correctly"))  # read five times
    parent = encoders.score_encoder(log, ["content_id"])
    out = encoders.score_encoder(parent, ["had_explanation", "content_id"], (20, 5), parent="content_id_encoded", rows=log)
    return rounded(out.select(*ROW, "had_explanation_content_id_encoded"))


@query(f"""{I}, x as (select *, (user_id % 5)::int as fold from i), t as (select content_id, fold, sum(answered_correctly) as s, count(*) as n from x group by all),
u as (select content_id, fold, sum(s) over w - s as s, sum(n) over w - n as n from t window w as (partition by content_id)),
p as (select fold, (sum(sum(answered_correctly)) over () - sum(answered_correctly)) / (sum(count(*)) over () - count(*)) as prior from x group by fold)
select user_id, rn, fold, round(case when n > 0 then {_sigmoid('n', 5, 1)} * s / n + (1 - {_sigmoid('n', 5, 1)}) * prior else prior end, 9) as content_id_encoded from x join u using (content_id, fold) join p using (fold)""")
def a3_score_encoder_oof(spark, d):
    return rounded(encoders.score_encoder_oof(_i(spark, d), ["content_id"]).select(*ROW, "fold", "content_id_encoded"))


_HELD = f"""{I}, x as (select *, (user_id % 5)::int as fold from i), t as (select content_id, fold, coalesce(sum(case when fold < 4 then answered_correctly end), 0) as s, count(*) filter (where fold < 4) as n from x group by all),
u as (select content_id, fold, sum(s) over w - s as s, sum(n) over w - n as n from t window w as (partition by content_id)),
f as (select fold, coalesce(sum(case when fold < 4 then answered_correctly end), 0) as s, count(*) filter (where fold < 4) as n from x group by fold),
p as (select fold, (sum(s) over () - s) / (sum(n) over () - n) as prior from f),
e as (select user_id, rn, fold, case when n > 0 then {_sigmoid('n', 5, 1)} * s / n + (1 - {_sigmoid('n', 5, 1)}) * prior else prior end as e from x join u using (content_id, fold) join p using (fold))"""


@query(f"""{_HELD} select user_id, rn, fold, round(case when fold = 4 then e else least(greatest(e + (((user_id * 1009 + rn) * 2654435761 % 4294967296)::double / 4294967296 - 0.5) * 0.2, 0), 1) end, 9) as content_id_encoded from e""")
def a3_score_encoder_held(spark, d):
    return rounded(encoders.score_encoder_held(_i(spark, d), ["content_id"], held=4, noise=0.2).select(*ROW, "fold", "content_id_encoded"))


@query(f"""{I} select user_id, rn, round(count(*) over (partition by question_category) / (count(*) over ()), 9) as question_category_ratio from i""")
def a4_ratio_encoder(spark, d):
    return rounded(encoders.ratio_encoder(_i(spark, d), "question_category").select(*ROW, "question_category_ratio"))


@query(f"""{I}, a as (select median(elapsed_ms) as m from i), q as (select content_id, median(elapsed_ms) as o, count(*) as n from i group by content_id)
select content_id, round({_sigmoid('n', 5, 1)} * o + (1 - {_sigmoid('n', 5, 1)}) * m, 9) as mean_content_time from q, a""")
def a9_question_times(spark, d):
    return rounded(sessions.question_times(_i(spark, d), "elapsed_ms"))


@query(f"""{I} select user_id, rn, count(*) over (partition by user_id, task_container_id) as task_size,
  max(case when task_container_id = 0 and content_id = 79 then 1 else 0 end) over (partition by user_id) as user_79 from i""")
def a10_task_size_and_flag(spark, d):
    return sessions.first_task_flag(sessions.task_size(_i(spark, d)), 79, "user_79").select(*ROW, "task_size", "user_79")


@query(f"""{I} select question_category, count(*) as n_rows, count(distinct user_id) as n_users, min(elapsed_ms) as low, median(elapsed_ms) as mid, max(elapsed_ms) as high,
  count(*) filter (where had_explanation = 1) as n_explained from i group by question_category""")
def a14_profile(spark, d):
    return _i(spark, d).groupBy("question_category").agg(
        F.count("*").alias("n_rows"), F.count_distinct("user_id").alias("n_users"), F.min("elapsed_ms").alias("low"), F.median("elapsed_ms").alias("mid"),
        F.max("elapsed_ms").alias("high"), F.count_if(F.col("had_explanation") == 1).alias("n_explained"),
    )


@query("""with p as (select p_partkey, p_brand, case when p_partkey % 3 > 0 then p_type end as p_type from part),
n as (select p_brand, p_type, count(*) as n from p where p_type is not null group by all),
u as (select p_brand, p_type as usual from n qualify row_number() over (partition by p_brand order by n desc, p_type) = 1)
select p_partkey, coalesce(p_type, usual) as p_type from p left join u using (p_brand)""")
def a15_usual_category(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 3 > 0, F.col("p_type")).alias("p_type"))
    return items.usual_category(part, "p_brand", "p_type").select("p_partkey", "p_type")


# sessions, lectures, scalars

_SESSION = f"""{V}, g as (select *, case when ts_ms - coalesce(lag(ts_ms) over (partition by user_id order by rn), 0) >= 7200000 then 1 else 0 end as new from v),
s as (select *, sum(new) over (partition by user_id order by rn rows unbounded preceding)::bigint as session_id from g)"""


@query(f"""{_SESSION} select user_id, rn, session_id from s""")
def f1_sessions(spark, d):
    return sessions.session_ids(_v(spark, d)).select(*ROW, "session_id")


@query(f"""{_SESSION}, x as (select *, ts_ms - min(ts_ms) over (partition by user_id, session_id) as session_time, ts_ms - lag(ts_ms) over (partition by user_id, session_id order by rn) as diff from s),
t as (select user_id, session_id, task_container_id, nullif(sum(diff) / nullif(count(diff), 0), 0) as content_time from x where content_type_id = 0 group by all),
q as (select user_id, task_container_id, content_time, lag(content_time) over (partition by user_id, session_id order by task_container_id) as prior_question_time from t),
k as (select user_id, task_container_id, task_container_id - lag(task_container_id) over (partition by user_id order by task_container_id) as task_diff from (select distinct user_id, task_container_id from v))
select x.user_id, rn, session_id, min(ts_ms) over (partition by x.user_id, session_id) as session_start, session_time, nullif(case when content_type_id = 1 then diff end, 0) as lecture_time,
  content_time, prior_question_time, prior_question_time - content_id * 100.0::double as prior_question_lost_time, task_diff
from x left join q using (user_id, task_container_id) left join k using (user_id, task_container_id)""")
def f2_session_times(spark, d):
    out = sessions.session_features(_v(spark, d).withColumn("prior_question_elapsed_time", F.col("content_id") * 100.0))
    return out.select(*ROW, "session_id", "session_start", "session_time", "lecture_time", "prior_question_lost_time", F.col("content_time").cast("double").alias("content_time"), F.col("prior_question_time").cast("double").alias("prior_question_time"), "task_diff")


_BUCKET_12 = "case when {0} <= -2 then -2 when {0} <= 2 then {0} when {0} <= 10 then 10 when {0} <= 20 then 20 when {0} <= 30 then 30 when {0} <= 50 then 50 when {0} <= 100 then 100 when {0} <= 300 then 300 else 500 end::int"
_BUCKET_3 = "case when {0} <= 0 then 0 when {0} <= 2 then 1 else 3 end::int"


@query(f"""{V}, c as (select user_id, rn, part, ts_ms, task_container_id, {', '.join(f"(sum(case when content_type_id = 1 and part = {k} then 1 else 0 end) over w)::bigint as p{k}" for k in range(1, 8))},
  (sum(content_type_id) over w)::bigint as n_lectures, {_LAST.format('ts_ms')} as lt, {_LAST.format('task_container_id')} as lk, {_LAST.format('content_id')} as li, {_LAST.format('tag')} as lg, {_LAST.format('part')} as lp
  from v window w as (partition by user_id order by rn rows unbounded preceding)), b as (select *, coalesce(task_container_id - lk, 0) as since from c)
select user_id, rn, n_lectures, [p1, p2, p3, p4, p5, p6, p7][part] as n_lectures_on_question_part, ts_ms - lt as time_since_last_lecture, task_container_id - lk as tasks_since_last_lecture,
  coalesce(li, -1) as lecture_id, coalesce(lg, -1) as lecture_tag, coalesce(lp, 0) - 1 as lecture_part, {_BUCKET_12.format('since')} as tasks_bucket_12, {_BUCKET_3.format('since')} as tasks_bucket_3 from b""")
def f4_lectures(spark, d):
    out = sessions.lectures_on_part(sessions.lecture_features(_v(spark, d)))
    return out.select(*ROW, "n_lectures", "n_lectures_on_question_part", "time_since_last_lecture", "tasks_since_last_lecture", "lecture_id", "lecture_tag", "lecture_part", "tasks_bucket_12", "tasks_bucket_3")


LECTURES_SQL = """l as (select p_partkey as lecture_id, p_size % 10 as lecture_tag, p_size % 7 + 1 as lecture_part,
  case p_partkey % 5 when 0 then 0 when 1 then 1 when 4 then null else 2 end as type_of from part)"""


def _lectures(spark, d):
    names = F.array(*map(F.lit, ["concept", "solving question", "intention", "starter", "unknown"]))
    part = spark.read.parquet(f"{d}/part.parquet")
    kind = F.element_at(names, (F.col("p_partkey") % 5 + 1).cast("int"))
    return part.select(F.col("p_partkey").alias("lecture_id"), (F.col("p_size") % 10).alias("tag"), (F.col("p_size") % 7 + 1).alias("part"), kind.alias("type_of"))


@query(f"with {LECTURES_SQL} select * from l")
def p6_lectures(spark, d):
    return sessions.preprocess_lectures(_lectures(spark, d))


@query(f"""{V} select user_id, rn, (sum(content_type_id) over (partition by user_id, tag order by rn rows unbounded preceding))::bigint as n_lectures_on_question_tag from v""")
def p14_lectures_on_tag(spark, d):
    return sessions.lectures_on_tag(_v(spark, d)).select(*ROW, "n_lectures_on_question_tag")


@query(f"""{_SESSION}, {LECTURES_SQL}, x as (select s.user_id, rn, content_type_id, content_id, task_container_id, ts_ms, session_id, ts_ms - lag(ts_ms) over (partition by s.user_id, session_id order by rn) as diff,
    case when content_type_id = 1 then lecture_part else part end as part, case when content_type_id = 1 then lecture_tag else tag end as tag, l.type_of as kind
  from s left join l on l.lecture_id = content_id and content_type_id = 1),
y as (select *, nullif(case when content_type_id = 1 then diff end, 0) as lecture_time from x),
z as (select *, max(case when content_type_id = 1 then rn end) over (partition by user_id order by rn rows unbounded preceding) as at, (sum(content_type_id) over (partition by user_id order by rn rows unbounded preceding))::bigint as n_lectures from y)
select z.user_id, z.rn, z.session_id, z.n_lectures, z.ts_ms - b.ts_ms as time_since_last_lecture, z.task_container_id - b.task_container_id as tasks_since_last_lecture, b.lecture_time as last_lecture_time,
  coalesce(b.content_id, -1) as lecture_id, coalesce(b.tag, -1) as lecture_tag, coalesce(b.part, 0) - 1 as lecture_part, coalesce(b.kind, -1)::int as last_type_of
from z left join z b on b.user_id = z.user_id and b.rn = z.at""")
def f10_lectures_pipeline(spark, d):
    """Sessions, then lectures by their own table, then the columns that are kept."""
    log = sessions.with_lectures(sessions.session_features(_v(spark, d)), sessions.preprocess_lectures(_lectures(spark, d)))
    names = ["session_id", "n_lectures", "time_since_last_lecture", "tasks_since_last_lecture", "last_lecture_time", "lecture_id", "lecture_tag", "lecture_part", "last_type_of"]
    return fn.select_columns(sessions.lecture_features(log), [*ROW, *names])


@query(f"""select l_orderkey, l_linenumber, l_partkey, x, {_BUCKET_12.format('x')} as b12, {_BUCKET_3.format('x')} as b3,
  (case when x <= 15 then 15 when x < 30 then 30 when x = 30 then 40 when x <= 50 then ceil(x / 10) * 10 when x <= 1000 then ceil(x / 100) * 100 else ceil(x / 1000) * 1000 end)::int as grp
from (select *, l_partkey - 100 as x from lineitem)""")
def p7_buckets(spark, d):
    x = F.col("x")
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") - 100).alias("x"))
    return rows.withColumns({"b12": fn.tasks_bucket_12(x), "b3": fn.tasks_bucket_3(x), "grp": fn.tasks_group(x)})


@query(f"""{I}, f as (select avg(ln(elapsed_ms / 1000 + 1)) as m, stddev_pop(ln(elapsed_ms / 1000 + 1)) as s from i) select user_id, rn, round((ln(elapsed_ms / 1000 + 1) - m) / s, 9) as elapsed_ms_z from i, f""")
def e15_log_times(spark, d):
    return rounded(items.log_time_scores(_i(spark, d), "elapsed_ms").select(*ROW, "elapsed_ms_z"))


@query(f"""{I}, c as (select user_id, rn, ts_ms, rn - 1 as user_id_count, had_explanation as x_count from i)
select user_id, rn, round(coalesce(user_id_count * 86400000 / nullif(ts_ms, 0), 0), 9) as user_id_density, round(coalesce(x_count / nullif(user_id_count, 0), 0), 9) as x_density,
  round(x_count / case when user_id_count = 0 then 0.00001 else user_id_count end, 9) as ratio from c""")
def p11_densities(spark, d):
    rows = _i(spark, d).select(*ROW, "ts_ms", (F.col("rn") - 1).alias("user_id_count"), F.col("had_explanation").alias("x_count"))
    out = fn.densities(rows, ["x_count"]).withColumn("ratio", fn.ratio(F.col("x_count"), F.col("user_id_count")))
    return rounded(out.select(*ROW, "user_id_density", "x_density", "ratio"))


@query("""with f as (select 'p_partkey' as "column", min(p_partkey)::bigint as lo, max(p_partkey)::bigint as hi from part union all select 'p_size', min(p_size)::bigint, max(p_size)::bigint from part)
select *, case when lo >= -128 and hi < 128 then 'tinyint' when lo >= -32768 and hi < 32768 then 'smallint' when lo >= -2147483648 and hi < 2147483648 then 'int' else 'bigint' end as type from f""")
def p3_smallest_int(spark, d):
    return fn.smallest_int(spark.read.parquet(f"{d}/part.parquet"), ["p_partkey", "p_size"])


@query("""with n as (select p_name, row_number() over (order by p_name) - 1 as question_tags from (select distinct p_name from part))
select p_partkey, question_tags, split_part(p_name, ' ', 1) as question_tag from part join n using (p_name)""")
def p5_question_tags(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name")
    return items.tag_features(part, "p_name").select("p_partkey", F.col("question_tags").cast("long").alias("question_tags"), "question_tag")


@query(f"""{V} select user_id, rn, answered_correctly from v where content_type_id = 0""")
def p4_remove_lectures(spark, d):
    return _v(spark, d).where("content_type_id = 0").select(*ROW, "answered_correctly")


# users, joins, items


@query(f"""{I}, f as (select user_id from i group by user_id order by min(user_id) limit 20) select user_id, rn, content_id from i semi join f using (user_id)""")
def s4_first_users(spark, d):
    return logs.first_users(_i(spark, d), 20, ["user_id"]).select(*ROW, "content_id")


@query(f"""{I} select user_id, rn, content_id from i order by user_id, rn limit 100""")
def s5_first_rows(spark, d):
    return logs.first_rows(_i(spark, d).select(*ROW, "content_id"), 100, ROW)


@query("""select p_partkey::int as question_id, (p_partkey % 4)::int as correct_answer, (p_size % 7 + 1)::int as part, p_name as tags from part""")
def s1_csv_scan(spark, d):
    """Questions written as CSV in the shared folder and read in their types, without the column that the schema does not name."""
    path = scratch(spark, "questions")
    part = spark.read.parquet(f"{d}/part.parquet")
    made = part.select(F.col("p_partkey").alias("question_id"), "p_comment" if "p_comment" in part.columns else F.lit("x").alias("note"), (F.col("p_partkey") % 4).alias("correct_answer"), (F.col("p_size") % 7 + 1).alias("part"), F.col("p_name").alias("tags"))
    made.write.option("header", True).csv(path)
    return logs.read_csv(spark, path, "question_id int, correct_answer int, part int, tags string")


@query("""select 'interactions' as name, count(*) as n_rows, count(distinct o_custkey) as n_keys, sum(case when l_returnflag <> 'R' then 1 else 0 end)::bigint as total from lineitem join orders on l_orderkey = o_orderkey
union all select 'lectures', count(*), count(distinct p_partkey), sum(p_size % 7 + 1)::bigint from part union all select 'questions', count(*), count(distinct p_partkey), sum(p_size % 7 + 1)::bigint from part""")
def s2_three_tables(spark, d):
    """The three source tables, written as CSV files and loaded together."""
    folder, log = scratch(spark, "tables"), _i(spark, d)
    part = spark.read.parquet(f"{d}/part.parquet")
    names = {"ts_ms": "timestamp", "elapsed_ms": "prior_question_elapsed_time"}
    log = log.withColumnsRenamed(names).withColumn("prior_question_had_explanation", F.col("had_explanation") == 1)
    shape = F.col("p_size") % 7 + 1
    tables = {
        "train": log,
        "questions": part.select(F.col("p_partkey").alias("question_id"), F.lit(0).alias("bundle_id"), (F.col("p_partkey") % 4).alias("correct_answer"), shape.alias("part"), F.col("p_name").alias("tags")),
        "lectures": part.select(F.col("p_partkey").alias("lecture_id"), (F.col("p_size") % 10).alias("tag"), shape.alias("part"), F.lit("concept").alias("type_of")),
    }
    for name, table in tables.items():
        table.write.option("header", True).csv(f"{folder}/{name}.csv")
    loaded = logs.load(spark, folder)
    facts = [("interactions", "user_id", "answered_correctly"), ("questions", "question_id", "part"), ("lectures", "lecture_id", "part")]
    rows = [df.agg(F.count("*").alias("n_rows"), F.count_distinct(k).alias("n_keys"), F.sum(v).alias("total")).select(F.lit(n).alias("name"), "*") for df, (n, k, v) in zip(loaded, facts, strict=True)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(f"""{I}, u as (select distinct user_id from i), n as (select user_id from u order by user_id desc limit (select count(*) // 20 from u))
select user_id, rn, case when n.user_id is null then 'train' else 'test' end as part from i left join n using (user_id)""")
def r5_last_users(spark, d):
    log = _i(spark, d).select(*ROW)
    return log.join(replay.last_users(log, 0.05).withColumn("part", F.lit("test")), "user_id", "left").select(*ROW, F.coalesce("part", F.lit("train")).alias("part"))


@query(f"""{V}, q as (select distinct user_id from v where content_type_id = 0 and answered_correctly = 1), w as (select distinct user_id from v where content_type_id = 1)
select user_id, 'both' as part from (select user_id from q intersect select user_id from w) union all select user_id, 'first' from (select user_id from q except select user_id from w)""")
def u3_user_sets(spark, d):
    log = _v(spark, d)
    right, watched = (log.where(x).select("user_id") for x in ("content_type_id = 0 and answered_correctly = 1", "content_type_id = 1"))
    tagged = lambda df, name: df.select("user_id", F.lit(name).alias("part"))
    return tagged(right.intersect(watched), "both").unionByName(tagged(right.subtract(watched), "first"))


@query("""select c_custkey, c_mktsegment, n_name, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""")
def j4_dimensions(spark, d):
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    out = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return out.select("c_custkey", "c_mktsegment", "n_name", "r_name")


@query("""with c as (select p_name, count(*) as n from part group by all), w as (select p_name, n, unnest(list_distinct(string_split(p_name, ' '))) as t from c)
select a.p_name as src, b.p_name as dst, count(*) as w, any_value(a.n) as src_items, any_value(b.n) as dst_items from w a join w b on a.t = b.t and (a.p_name <> b.p_name or a.n > 1) group by all""")
def j13_tag_graph(spark, d):
    return items.tag_class_graph(spark.read.parquet(f"{d}/part.parquet"), "p_name")


@query("""with s as (select distinct p_name as n, list_distinct(string_split(p_name, ' ')) as t from part)
select a.n as a, b.n as b, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 9) as similarity from s a, s b where len(list_intersect(a.t, b.t)) > 0""")
def e2_tag_similarity(spark, d):
    return rounded(items.tag_similarity(spark.read.parquet(f"{d}/part.parquet"), "p_name"))


@query(f"""{I} select user_id, string_agg(content_id::varchar, ' ' order by rn) as sentence from i group by user_id""")
def e4_sentences(spark, d):
    out = items.sentences(_i(spark, d), F.col("content_id"))
    return out.select("user_id", F.array_join("tokens", " ").alias("sentence"))


@query("""select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9) as similarity from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def e9_cosine(spark, d):
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    a, b = v.alias("a"), v.alias("b")
    out = a.join(b, F.col("b.vec_id") == F.col("a.vec_id") + 1)
    return rounded(out.select(F.col("a.vec_id").alias("a"), F.col("b.vec_id").alias("b"), items.cosine(F.col("a.embedding"), F.col("b.embedding")).alias("similarity")))


_CHUNKS = f"""{I}, n as (select user_id, content_id, row_number() over (partition by user_id order by rn) - 1 + (10 - count(*) over (partition by user_id) % 10) % 10 as p from i),
c as (select user_id, (p // 10)::bigint as chunk, list(content_id order by p) as l from n group by all), q as (select user_id, chunk, list_concat(list_transform(range(10 - len(l)), lambda x: 0), l) as seq from c)"""


@query(f"""{_CHUNKS} select user_id, chunk, array_to_string(seq, ' ') as seq from q""")
def e11_padded_chunks(spark, d):
    return items.padded_chunks(_i(spark, d), F.col("content_id"), 10).select("user_id", "chunk", F.array_join(F.col("seq").cast("array<string>"), " ").alias("seq"))


@query(f"""{_CHUNKS} select user_id, chunk, array_to_string(seq[2:], ' ') as encoder, array_to_string(seq[:9], ' ') as decoder, array_to_string(seq[2:], ' ') as label from q""")
def e12_shifted(spark, d):
    out = items.shifted(items.padded_chunks(_i(spark, d), F.col("content_id"), 10))
    return out.select("user_id", "chunk", *[F.array_join(F.col(c).cast("array<string>"), " ").alias(c) for c in ("encoder", "decoder", "label")])


@query()
def e3_communities(spark, d):
    return items.item_communities(spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name"), "p_partkey", "p_name")


@query()
def e5_item_vectors(spark, d):
    return items.item_vectors(_i(spark, d), F.col("content_id"))


@query()
def e6_clusters(spark, d):
    return items.clusters(spark.read.parquet(f"{d}/embeddings.parquet"), 10, "embedding").select("vec_id", "category")


# inputs of a sequence model


@query(f"""{I} select user_id, rn, dense_rank() over (order by question_category) - 1 as question_category_code, content_id + answered_correctly * (select count(*) from part) + 1 as combined_id from i""")
def a17_ordinal_codes(spark, d):
    n_items = spark.read.parquet(f"{d}/part.parquet").agg(F.count("*").alias("n_items"))  # one row
    out = sequences.ordinal_codes(_i(spark, d), "question_category").crossJoin(F.broadcast(n_items))
    combined = sequences.combined_id(F.col("content_id"), F.col("answered_correctly"), F.col("n_items"))
    return out.select(*ROW, F.col("question_category_code").cast("long").alias("question_category_code"), combined.alias("combined_id"))


@query(f"""{I}, q as (select list_sort(list_distinct(quantile_cont(elapsed_ms, [{', '.join(str(k / 20) for k in range(21))}]))) as q from i), e as (select q[2:len(q) - 1] as edges from q)
select user_id, rn, (len(list_filter(edges, lambda x: x <= elapsed_ms)) + 1)::int as elapsed_ms_bin from i, e""")
def a18_quantile_bins(spark, d):
    return sequences.quantile_bins(_i(spark, d), "elapsed_ms", 20).select(*ROW, "elapsed_ms_bin")


@query(f"""{I}, t as (select user_id, task_container_id, arg_min(elapsed_ms, rn) as e, arg_min(had_explanation, rn) as h from i group by all),
n as (select user_id, task_container_id, lead(e) over w as e, lead(h) over w as h from t window w as (partition by user_id order by task_container_id))
select user_id, rn, e as question_elapsed_time, h as question_had_explanation from i left join n using (user_id, task_container_id)""")
def e17_next_task_values(spark, d):
    log = _i(spark, d).withColumns({"prior_question_elapsed_time": F.col("elapsed_ms"), "prior_question_had_explanation": F.col("had_explanation")})
    out = sequences.next_task_values(log, ["prior_question_elapsed_time", "prior_question_had_explanation"])
    return out.select(*ROW, "question_elapsed_time", "question_had_explanation")


@query(f"""{V}, t as (select user_id, task_container_id, min(ts_ms) as t, count(*) as n from v group by all),
c as (select user_id, task_container_id, (t - lag(t) over (partition by user_id order by task_container_id)) / n as content_time from t),
k as (select *, coalesce(task_container_id - {_LAST.format('task_container_id')}, 0) as since from v), b as (select user_id, rn, task_container_id, {_BUCKET_12.format('since')} as bucket from k)
select user_id, rn, round(content_time, 9) as content_time, (dense_rank() over (order by bucket))::int as lecture_code from b left join c using (user_id, task_container_id)""")
def e16_lecture_inputs(spark, d):
    return rounded(sequences.lecture_inputs(_v(spark, d)).select(*ROW, "content_time", "lecture_code"))


_LIKE = """list_cosine_similarity(b{0}.e, o1.e) - list_cosine_similarity(b{0}.e, o0.e)"""
_SHARE = """case when s{0}.t is not null and o.t is not null then len(list_intersect(s{0}.t, o.t)) / len(list_distinct(list_concat(s{0}.t, o.t))) end"""


@query(f"""{I}, k as (select *, dense_rank() over (partition by user_id order by ts_ms, task_container_id) as k from i),
l as (select *, {', '.join(f"lag(content_id, {k}) over w as c{k}, lag(answered_correctly, {k}) over w as y{k}" for k in (1, 2, 3))} from k window w as (partition by user_id order by rn)),
f as (select user_id, rn, content_id, {', '.join(f"first(c{k}) over t as c{k}, first(y{k}) over t as y{k}" for k in (1, 2, 3))} from l window t as (partition by user_id, k order by rn)),
v as (select vec_id // 2 as item, vec_id % 2 as r, embedding::double[] as e from embeddings), s as (select p_partkey as item, list_distinct(string_split(p_name, ' ')) as t from part)
select user_id, rn, {', '.join(f"round({_LIKE.format(k)}, 9) + 0.0::double as similarity_{k}, round({_SHARE.format(k)}, 9) as tags_similarity_{k}, round(({_SHARE.format(k)}) * case when y{k} = 1 then 1 else -1 end, 9) + 0.0::double as tags_answered_similarity_{k}" for k in (1, 2, 3))}
from f left join s o on o.item = content_id left join v o0 on o0.item = content_id and o0.r = 0 left join v o1 on o1.item = content_id and o1.r = 1
{' '.join(f"left join v b{k} on b{k}.item = c{k} and b{k}.r = y{k} left join s s{k} on s{k}.item = c{k}" for k in (1, 2, 3))}""")
def e8_answer_likeness(spark, d):
    tags = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("content_id"), F.col("p_name").alias("tags"))
    vectors = spark.read.parquet(f"{d}/embeddings.parquet").select(F.expr("vec_id div 2").alias("content_id"), (F.col("vec_id") % 2).alias("correct"), F.col("embedding").alias("vector"))
    out = sequences.answer_likeness(_i(spark, d), tags, vectors)
    return rounded(out.select(*ROW, *[f"{n}_{k}" for k in (1, 2, 3) for n in ("similarity", "tags_similarity", "tags_answered_similarity")]))


@query()
def e8_likeness_out_of_fold(spark, d):
    """Likeness by vectors trained on the histories of other folds' users."""
    log = _i(spark, d).withColumn("fold", encoders.folds(F.col("user_id"), 5))
    tags = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("content_id"), F.col("p_name").alias("tags"))
    log = cut(log)
    out = sequences.answer_likeness(log, tags, items.answer_vectors(log))
    return rounded(out.select(*ROW, "fold", *[f"{n}_{k}" for k in (1, 2, 3) for n in ("similarity", "tags_similarity", "tags_answered_similarity")]))


@query("""with s as (select p_partkey, list_distinct(string_split(p_name, ' ')) as t from part), n as (select count(*) as n from s), o as (select t, count(*) as c from (select unnest(t) as t from s) group by t),
p as (select a, unnest(t) as b from (select unnest(t) as a, t from s)), q as (select a, b, count(*) as ab from p group by all)
select a, b, round((ab - x.c * y.c / n) / (n - 1), 9) as covariance from q join o x on x.t = a join o y on y.t = b, n""")
def e13_tag_covariance(spark, d):
    return rounded(items.tag_covariance(spark.read.parquet(f"{d}/part.parquet"), "p_partkey", "p_name"))


@query()
def e13_tag_components(spark, d):
    return items.tag_components(spark.read.parquet(f"{d}/part.parquet"), "p_partkey", "p_name", 4)[0]


def _profile_sql(source: str, columns: dict[str, str]) -> str:
    """columns: name -> Spark's type."""
    parts = []
    for c, t in columns.items():
        kind = profile.kind_of(t)
        number = ", ".join(f"{f}({c})::double" if kind == "number" else "null::double" for f in ("min", "median", "max"))
        date = ", ".join(f"{f}({c})::date::varchar" if kind == "date" else "null::varchar" for f in ("min", "max"))
        best = f"(select string_agg(v || '=' || n, ', ' order by n desc, v) from (select {c}::varchar as v, count(*) as n from x where {c} is not null group by all order by n desc, v limit 5))" if kind == "category" else "null::varchar"
        parts.append(f"""select '{c}' as "column", '{t}' as type, '{kind}' as kind, count(*) as n_rows, count(*) - count({c}) as n_null, count(distinct {c}) as n_unique, {number}, {date}, {best} from x""")
    names = '("column", type, kind, n_rows, n_null, n_unique, low, mid, high, first_date, last_date, frequent)'
    return f"with x as ({source}), p{names} as ({' union all '.join(parts)}) select * from p"


_LINES = {"l_partkey": "bigint", "l_quantity": "double", "l_discount": "double", "l_returnflag": "string", "l_shipdate": "date", "l_few": "string"}


@query(_profile_sql("select l_partkey, l_quantity::double as l_quantity, case when l_partkey % 3 > 0 then l_discount end::double as l_discount, l_returnflag, l_shipdate::date as l_shipdate, case when l_partkey % 7 = 0 then l_linestatus end as l_few from lineitem", _LINES))
def f8_analyzed_lines(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(
        F.col("l_partkey").cast("long").alias("l_partkey"), F.col("l_quantity").cast("double").alias("l_quantity"),
        F.when(F.col("l_partkey") % 3 > 0, F.col("l_discount")).cast("double").alias("l_discount"), "l_returnflag", F.col("l_shipdate").cast("date").alias("l_shipdate"),
        F.when(F.col("l_partkey") % 7 == 0, F.col("l_linestatus")).alias("l_few"),
    )
    return rounded(profile.analyzed(rows))


_EVENTS = {"user_id": "bigint", "event_type": "string", "value": "double", "ts": "timestamp"}


@query(_profile_sql("select user_id, event_type, case when event_id % 4 > 0 then value end::double as value, ts::timestamp as ts from events", _EVENTS))
def f8_analyzed_events(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet")
    value = F.when(F.col("event_id") % 4 > 0, F.col("value")).cast("double")
    return rounded(profile.analyzed(rows.select(F.col("user_id").cast("long").alias("user_id"), "event_type", value.alias("value"), F.col("ts").cast("timestamp").alias("ts"))))


# replay, models

_U = "((user_id * 2654435761) % 4294967296)::double / 4294967296"
_G = f"""{V}, s as (select user_id, max(ts_ms) as d from v group by user_id), a as (select ceil(max(d) / 86400000.0) * 86400000 as m from s),
g as (select v.*, round({_U.replace('user_id', 's.user_id')} * (m - d))::bigint + ts_ms as global_ts from v join s using (user_id), a),
t as (select user_id, task_container_id, global_ts, count(*) as n from g group by all),
c as (select *, sum(n) over (order by floor(global_ts / 86400000.0) desc, global_ts desc, user_id, task_container_id rows unbounded preceding) as upto from t),
h as (select user_id, task_container_id, global_ts from c where upto <= 2000)"""


@query(f"""{_G} select * from h""")
def v1_latest_tasks(spark, d):
    return replay.latest_tasks(replay.global_times(_v(spark, d)), 2000)


_B = f"""{_G}, u0 as (select user_id, count(*) as n, greatest(200 - count(*) + 1, 1) as places from h group by user_id),
u1 as (select *, case when k < n then sqrt(n / (k + 1)) when k >= places - n then sqrt(n / (places - k)) else 1.0::double end as w from (select *, unnest(range(places)) as k from u0)),
u2 as (select *, sum(w) over (partition by user_id order by k rows unbounded preceding) as upto, sum(w) over (partition by user_id) as total from u1),
u as (select user_id, least(count(*) filter (where upto <= {_U} * total), any_value(places) - 1) as start from u2 group by user_id),
b as (select user_id, task_container_id, (start + row_number() over (partition by user_id order by global_ts, task_container_id) - 1)::bigint as batch_id from h join u using (user_id))"""


def _batches(spark, d):
    return replay.deal_batches(replay.latest_tasks(replay.global_times(_v(spark, d)), 2000), 200)


@query(f"""{_B} select * from b""")
def v2_batches(spark, d):
    return _batches(spark, d)


@query(f"""{_B} select * from b""")
def s6_saved_batches(spark, d):
    path = scratch(spark, "batches")
    replay.save_batches(_batches(spark, d), path)
    return replay.load_batches(spark, path)


@query(f"""{_B}, l as (select batch_id from (select batch_id, percent_rank() over (order by batch_id) as r from (select distinct batch_id from b)) where r > 0.9)
select v.user_id, rn, case when b.batch_id is null then 'train' when l.batch_id is null then 'test' else 'validation' end as part from v left join b using (user_id, task_container_id) left join l on l.batch_id = b.batch_id""")
def v3_split(spark, d):
    train, test, late = replay.split(_v(spark, d), _batches(spark, d), 0.1)
    tagged = lambda df, name: df.select(*ROW, F.lit(name).alias("part"))
    return tagged(train, "train").unionByName(tagged(test, "test")).unionByName(tagged(late, "validation"))


@query(f"""{_B}, x as (select batch_id, user_id, rn, answered_correctly as y from v join b using (user_id, task_container_id)),
o as (select *, row_number() over (partition by batch_id order by user_id, rn) as nth from x),
l as (select batch_id, '[' || string_agg(y::varchar, ', ' order by user_id, rn) || ']' as own from x group by batch_id),
p as (select batch_id, lag(own, 1, '[]') over (order by batch_id) as c from l)
select batch_id, user_id, rn, case when nth = 1 then c end as prior_group_answers_correct from o left join p using (batch_id)""")
def t11_replay_batches(spark, d):
    rows = _v(spark, d).join(_batches(spark, d), ["user_id", "task_container_id"]).withColumn("user_answer", F.col("content_id") % 4)
    return replay.replay_batches(rows).select("batch_id", *ROW, "prior_group_answers_correct")


@query("""with s as (select quality, (doc_id * 7919) % 1000 as score from labels), r as (select quality, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as r from s)
select round((sum(case when quality = 1 then r end) - count(*) filter (where quality = 1) * (count(*) filter (where quality = 1) + 1) / 2.0) / (count(*) filter (where quality = 1) * count(*) filter (where quality = 0)), 9) as auc from r""")
def m8_roc_auc(spark, d):
    rows = spark.read.parquet(f"{d}/labels.parquet").select("quality", (F.col("doc_id") * 7919 % 1000).alias("score"))
    return rounded(models.roc_auc(rows, "score", "quality"))


@query("""with s as (select doc_id, quality as y, ((doc_id * 7919) % 1000 + 0.5) / 1000 as p from labels)
select doc_id, round(-(y * ln(p) + (1 - y) * ln(1 - p)), 9) as bce, round(-(0.25 * y * pow(1 - p, 2) * ln(p) + 0.75 * (1 - y) * pow(p, 2) * ln(1 - p)), 9) as focal,
  round(least(1 / sqrt(doc_id + 1), (doc_id + 1) * pow(4000, -1.5)) / sqrt(256), 9) as rate from s""")
def m9_losses(spark, d):
    p, y = (F.col("doc_id") * 7919 % 1000 + 0.5) / 1000, F.col("quality")
    rows = spark.read.parquet(f"{d}/labels.parquet")
    return rounded(rows.select("doc_id", models.log_loss(p, y).alias("bce"), models.focal_loss(p, y).alias("focal"), models.warmup_rate(F.col("doc_id") + 1, 256, 4000).alias("rate")))


_SKEW = """select '{0}' as "column", round(avg(pow({0} - m, 3)) / pow(avg(pow({0} - m, 2)), 1.5), 9) as skewness, count(distinct {0}) as n_unique,
  avg(pow({0} - m, 3)) / pow(avg(pow({0} - m, 2)), 1.5) > 1 and count(distinct {0}) > 5 as power from lineitem, (select avg({0}) as m from lineitem)"""
SCALED = ["l_quantity", "l_extendedprice", "l_discount"]


@query(" union all ".join(map(_SKEW.format, SCALED)))
def m5_scaling_plan(spark, d):
    return rounded(models.scaling_plan(spark.read.parquet(f"{d}/lineitem.parquet"), SCALED))


@query(f"""select l_orderkey, l_linenumber, {', '.join(f"round(({c} - avg({c}) over ()) / stddev_pop({c}) over (), 6) as {c}" for c in SCALED)} from lineitem""")
def m5_scaled(spark, d):
    out = models.scaled(spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", *SCALED), SCALED)
    return out.withColumns({c: F.round(c, 6) for c in SCALED})


@query("""with r as (select l_orderkey, l_linenumber, pow(l_quantity / 10, 4)::double as x from lineitem), g as (select unnest(range(-20, 31))::double / 10 as s),
y as (select s, x, case when abs(s) < 1e-9 then ln(x + 1) else (pow(x + 1, s) - 1) / s end as y from r, g),
b as (select s from y group by s order by -count(*) / 2.0 * ln(greatest(var_pop(y), 1e-300)) + (s - 1) * sum(ln(x + 1)) desc, s limit 1),
t as (select l_orderkey, l_linenumber, case when abs(s) < 1e-9 then ln(x + 1) else (pow(x + 1, s) - 1) / s end as y from r, b)
select l_orderkey, l_linenumber, round((y - avg(y) over ()) / stddev_pop(y) over (), 6) as x from t""")
def m5_scaled_by_power(spark, d):
    """A column so skewed that it goes through the power transform."""
    x = F.pow(F.col("l_quantity") / 10, F.lit(4))
    out = models.scaled(spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", x.alias("x")), ["x"])
    return out.withColumn("x", F.round("x", 6))


@query("""with n as (select l_orderkey, l_linenumber, case when l_partkey % 5 > 0 then l_quantity end as x from lineitem)
select l_orderkey, l_linenumber, case when x is null then 1 else 0 end as x_missing, coalesce(x, (select median(x) from n))::double as x from n""")
def m4_missing_flags(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 5 > 0, F.col("l_quantity")).alias("x"))
    return models.with_missing_flags(rows, ["x"])


MODEL_COLUMNS = ["user_id_score", "recent", "content_id_encoded", "elapsed_ms"]


def _model_rows(spark, d):
    log = history.rolling_scores(_i(spark, d), ["user_id"], [{}, {"decay": 0.9}], 0.5)
    log = log.withColumn("recent", F.col("`user_id_score_decay_0.9`")).select(*ROW, "content_id", "answered_correctly", "user_id_score", "recent", "elapsed_ms")
    log = encoders.score_encoder_oof(cut(log), ["content_id"])  # written, as it is read for the sums and for its rows
    return cut(log.select(*ROW, "fold", "answered_correctly", *MODEL_COLUMNS))


@query()
def m1_early_stop(spark, d):
    """The rounds of boosted trees with their AUC on the training and the held rows; `kept` is the one that counts."""
    log = _model_rows(spark, d)
    found = models.boosted(log.where("fold < 3"), log.where("fold = 3"), MODEL_COLUMNS, "answered_correctly")
    return rounded(found.rates.withColumn("kept", F.col("round") == found.rounds))


@query()
def m6_blend(spark, d):
    log = _model_rows(spark, d)
    return models.blended(log.where("fold < 3"), log.where("fold >= 3"), MODEL_COLUMNS, "answered_correctly", ROW)


@query()
def m6_blend_auc(spark, d):
    """AUC of each learner and of the cross-validated blend, by fold of the held users."""
    names = ["boosted", "forest", "perceptron", "blend"]
    each = F.explode(F.array(*[F.struct((F.col("fold") * len(names) + i).alias("own"), F.col(n).alias("score")) for i, n in enumerate(names)]))
    by = models.auc_by(m6_blend(spark, d).select("answered_correctly", each.alias("r")).select("answered_correctly", "r.*"), "own", "score", "answered_correctly")
    learner = F.element_at(F.array(*map(F.lit, names)), F.col("own") % len(names) + 1)
    return rounded(by.select(learner.alias("learner"), F.floor(F.col("own") / len(names)).cast("int").alias("fold"), "auc"))


# the whole frame

_J = f"""with j1 as (
  select o_custkey as user_id, epoch_us(o_orderdate::timestamp) // 1000 as ms, l_orderkey as k1, l_linenumber as k2, l_suppkey as k3, l_quantity as k4, l_extendedprice as k5, l_shipdate as k6, l_partkey as content_id,
    case when l_returnflag <> 'R' then 1 else 0 end as y, trunc(l_quantity)::int as q, case when l_discount > 0.05 then 1 else 0 end as h, p_size % 7 + 1 as part, substr(p_brand, 7)::int as tag, p_type, p_name
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey),
j2 as (select user_id, (ms - min(ms) over (partition by user_id)) * 80 as ts_ms, event_id, event_type, k from (select *, epoch_us(ts::timestamp) // 1000 as ms, regexp_extract(props, '([0-9]+)', 1)::bigint as k from events)),
j3 as (
  select user_id, ms - min(ms) over (partition by user_id) as ts_ms, 0 as content_type_id, k1, k2, k3, k4, k5, k6, content_id, y as answered_correctly, (content_id % 4)::int as correct_answer,
    (case when y = 1 then content_id % 4 else (content_id % 4 + 1 + q % 3) % 4 end)::int as user_answer, k4 * 1000.0::double as prior_question_elapsed_time, h as prior_question_had_explanation, part, tag, p_type as question_category, p_name as tags from j1
  union all select user_id, ts_ms, 1, event_id, null, null, null, null, null, k, null, null, null, null, null, k % 7 + 1, k % 10, null, null from j2 where event_type = 'signup'),
j as (select *, dense_rank() over (partition by user_id order by ts_ms, content_type_id, k1) - 1 as task_container_id,
  row_number() over (partition by user_id order by ts_ms, content_type_id, k1, k2, content_id, k3, k4, k5, k6) as rn from j3)"""

_QUESTIONS = f""", {LECTURES_SQL}, a as (select j.* exclude (part, tag), case when content_type_id = 1 then lecture_part else part end as part, case when content_type_id = 1 then lecture_tag else tag end as tag
  from j left join l on l.lecture_id = content_id and content_type_id = 1),
g as (select *, case when ts_ms - coalesce(lag(ts_ms) over (partition by user_id order by rn), 0) >= 7200000 then 1 else 0 end as new from a),
s as (select *, sum(new) over (partition by user_id order by rn rows unbounded preceding)::bigint as session_id from g),
x as (select *, ts_ms - min(ts_ms) over (partition by user_id, session_id) as session_time, ts_ms - lag(ts_ms) over (partition by user_id, session_id order by rn) as diff from s),
ct as (select user_id, session_id, task_container_id, nullif(sum(diff) / nullif(count(diff), 0), 0) as content_time from x where content_type_id = 0 group by all),
pq as (select user_id, task_container_id, content_time, lag(content_time) over (partition by user_id, session_id order by task_container_id) as prior_question_time from ct),
td as (select user_id, task_container_id, task_container_id - lag(task_container_id) over (partition by user_id order by task_container_id) as task_diff from (select distinct user_id, task_container_id from j)),
lec as (select *, nullif(case when content_type_id = 1 then diff end, 0) as lecture_time, max(case when content_type_id = 1 then rn end) over w as at, (sum(content_type_id) over w)::bigint as n_lectures,
  {', '.join(f"(sum(case when content_type_id = 1 and part = {k} then 1 else 0 end) over w)::bigint as p{k}" for k in range(1, 8))} from x window w as (partition by user_id order by rn rows unbounded preceding)),
i as materialized (select z.user_id, row_number() over (partition by z.user_id order by z.rn) as rn, (z.user_id % 5)::int as fold, z.ts_ms, z.task_container_id, z.content_id, z.answered_correctly, z.correct_answer, z.user_answer,
  z.prior_question_elapsed_time, z.prior_question_had_explanation, z.part as question_part, z.tag as question_tag, z.question_category, z.tags, z.session_id, z.session_time, pq.content_time, pq.prior_question_time,
  pq.prior_question_time - z.prior_question_elapsed_time as prior_question_lost_time, td.task_diff, z.n_lectures, [z.p1, z.p2, z.p3, z.p4, z.p5, z.p6, z.p7][z.part] as n_lectures_on_question_part,
  z.ts_ms - b.ts_ms as time_since_last_lecture, z.task_container_id - b.task_container_id as tasks_since_last_lecture, b.lecture_time as last_lecture_time, coalesce(b.content_id, -1) as lecture_id,
  {_BUCKET_12.format('coalesce(z.task_container_id - b.task_container_id, 0)')} as tasks_bucket_12, {_BUCKET_3.format('coalesce(z.task_container_id - b.task_container_id, 0)')} as tasks_bucket_3,
  count(*) over (partition by z.user_id, z.task_container_id) as task_size, max(case when z.task_container_id = 0 and z.content_id = 79 then 1 else 0 end) over (partition by z.user_id) as user_79
  from lec z left join lec b on b.user_id = z.user_id and b.rn = z.at left join pq on pq.user_id = z.user_id and pq.task_container_id = z.task_container_id
  left join td on td.user_id = z.user_id and td.task_container_id = z.task_container_id where z.content_type_id = 0)"""

_LAST_FOLD = 4


def _shrunk_sql(s: str, n: str, prior: str, least: float, value: float) -> str:
    return f"(case when {n} > 0 then {_sigmoid(n, least, value)} * {s} / {n} + (1 - {_sigmoid(n, least, value)}) * {prior} else {prior} end)"


def _held_sql(keys: str, least: float, value: float, parent: str, noise: float) -> str:
    """An encoder of frame.encoder_list over rows with shown (the label, null in the last fold), held_mean and chance."""
    own, both = f"partition by {keys}", f"partition by {keys}, fold"
    s, n = (f"(coalesce({f}(shown) over ({own}), 0) - coalesce({f}(shown) over ({both}), 0))" for f in ("sum", "count"))
    e = _shrunk_sql(s, n, parent, least, value)
    return f"case when fold = {_LAST_FOLD} then {e} else least(greatest({e} + (chance - 0.5) * {noise}, 0), 1) end as {'_'.join(keys.split(', '))}_encoded"


_ENCODED = f""", c as (select content_id, correct_answer, user_answer, count(*) as n from i group by all),
t as (select *, sum(n) over (partition by content_id) as total, case when user_answer = correct_answer then 1 else 0 end as is_correct from c),
p as (select is_correct, sum(n) / sum(total) as prior from t group by is_correct),
r as (select content_id, user_answer, is_correct, {_sigmoid('total', 5, 1)} * n / total + (1 - {_sigmoid('total', 5, 1)}) * prior as r1, {_sigmoid('total', 10, 2)} * n / total + (1 - {_sigmoid('total', 10, 2)}) * prior as r2 from t join p using (is_correct)),
k1 as (select user_id, task_container_id, avg(r1) as a from i left join r using (content_id, user_answer) group by all),
k2 as (select user_id, task_container_id, lag(a) over (partition by user_id order by task_container_id) as prior_answer_ratio from k1),
w1 as (select *, row_number() over (partition by content_id order by r2 desc, user_answer) as nth from r where is_correct = 0),
w2 as (select content_id, {', '.join(f"coalesce(max(case when nth = {k} then r2 end), 0) as answer_{k + 1}_ratio" for k in (1, 2, 3))} from w1 group by content_id),
ex as (select content_id, {', '.join(f"coalesce(max(case when user_answer = {k} then r2 end), 0) as e{k}" for k in range(4))} from r group by content_id),
om as (select median(content_time) as m from i), im as (select content_id, median(content_time) as o, count(content_time) as n from i group by content_id),
hm as (select fold, (sum(s) over () - s) / (sum(n) over () - n) as held_mean from (select fold, coalesce(sum(case when fold <> {_LAST_FOLD} then answered_correctly end), 0) as s, count(*) filter (where fold <> {_LAST_FOLD}) as n from i group by fold)),
e0 as (select i.*, (select avg(answered_correctly) from i) as mean, held_mean, case when fold <> {_LAST_FOLD} then answered_correctly end as shown, ((user_id * 1009 + rn) * 2654435761 % 4294967296)::double / 4294967296 as chance,
    i.content_time / (case when im.n > 0 then {_sigmoid('im.n', 5, 1)} * im.o + (1 - {_sigmoid('im.n', 5, 1)}) * om.m else om.m end) as mean_content_time, prior_answer_ratio,
    {', '.join(f"coalesce(answer_{k}_ratio, (select avg(answer_{k}_ratio) from w2)) as answer_{k}_ratio" for k in (2, 3, 4))}, e0, e1, e2, e3
  from i left join hm using (fold) left join im using (content_id) left join k2 using (user_id, task_container_id) left join w2 using (content_id) left join ex using (content_id), om),
e1 as (select *, {', '.join(f"count(*) over (partition by {c}) / (count(*) over ()) as {c}_ratio" for c in frame.RATIOS)},
    {', '.join(_shrunk_sql(f"sum(answered_correctly) over (partition by {c})", f"count(*) over (partition by {c})", "mean", 5, 1) + f" as {c}_encoded" for c in frame.PLAIN)},
    {_held_sql('content_id', 5, 1, 'held_mean', 0.001)}, {_held_sql('lecture_id', 5, 1, 'held_mean', 0.001)} from e0),
e2 as (select *, {_held_sql('user_79, content_id', 20, 5, 'content_id_encoded', 0.002)}, {_held_sql('tasks_bucket_3, content_id', 20, 5, 'content_id_encoded', 0.002)} from e1),
e3 as (select *, {_held_sql('tasks_bucket_12, content_id', 20, 5, 'tasks_bucket_3_content_id_encoded', 0.002)}, case when answered_correctly = 0 then content_id_encoded else 1 - content_id_encoded end as w from e2),
e4 as materialized (select *, rn - 1 as r0, {', '.join(f"dense_rank() over (partition by {keys} order by ts_ms, task_container_id) - 1 as k_{n}" for n, keys in enumerate(("user_id", *(f"user_id, {c}" for c in (*frame.PLAIN, "content_id")))))} from e3)"""


def _frame_sql() -> str:
    pairs = [("user_id",), *(("user_id", c) for c in frame.PLAIN)]
    sums, inner, out = [], [], []
    before = lambda v, n, keys: f"coalesce(sum({v}) over (partition by {keys} order by k_{n} {BEFORE}), 0)"
    faded = lambda v, n, keys, d: f"{before(f'({v}) * pow({d}, -k_{n})', n, keys)} * pow({d}, k_{n})"

    def score(name: str, count: str, s: str, n: str, least: float, value: float, prior: str) -> None:
        out.append(f'round({_shrunk_sql(s, n, prior, least, value)}, 6) as "{name}", round({n} + 3e-8, 6)::double as "{count}"')

    for n, keys in enumerate([*pairs, ("user_id", "content_id")]):
        by, stem = ", ".join(keys), "_".join(keys)
        prior = "mean" if n == 0 else f"{keys[-1]}_encoded"
        sums += [f"{before('answered_correctly', n, by)} as s_{n}", f"{before('1', n, by)} as n_{n}"]
        if n:
            sums += [f"max(ts_ms) over (partition by {by} order by k_{n} {BEFORE}) as t_{n}", f"max(task_container_id) over (partition by {by} order by k_{n} {BEFORE}) as c_{n}"]
            out.append(f"ts_ms - t_{n} as time_since_last_{keys[1]}, task_container_id - c_{n} as tasks_since_last_{keys[1]}")
        rows = 1 if n == len(pairs) else 20
        inner += [f"coalesce(sum(answered_correctly) over (partition by {by} order by rn rows between {rows} preceding and 1 preceding), 0) as rs_{n}", f"count(*) over (partition by {by} order by rn rows between {rows} preceding and 1 preceding) as rn_{n}"]
        sums += [f"first({x}_{n}) over (partition by {by}, k_{n} order by rn) as f{x}_{n}" for x in ("rs", "rn")]
        if n == len(pairs):
            out.append(f"round(case when n_{n} > 0 then s_{n} / n_{n} end, 6) as {stem}_score, n_{n}::double as {stem}_count, round(case when frn_{n} > 0 then frs_{n} / frn_{n} end, 6) as {stem}_score_1, frn_{n}::double as {stem}_count_1")
            continue
        score(f"{stem}_score", f"{stem}_count", f"s_{n}", f"n_{n}", 5, 2, prior)
        score(f"{stem}_score_20", f"{stem}_count_20", f"frs_{n}", f"frn_{n}", 2.5, 1, prior)
        sums += [f"{before('answered_correctly * w', n, by)} as ws_{n}", f"{before('w', n, by)} as wn_{n}"]
        score(f"{stem}_weighted_score", f"{stem}_weighted_count", f"ws_{n}", f"wn_{n}", 2, 1, prior)
        for tag, d, least, value in (("d", 0.9, 1, 1), ("l", 0.99, 10, 2)) if n < 2 else (("d", 0.9, 1, 1),):
            sums += [f"{faded('answered_correctly', n, by, d)} as {tag}s_{n}", f"{faded('1', n, by, d)} as {tag}n_{n}"]
            score(f"{stem}_score_decay_{d}", f"{stem}_count_decay_{d}", f"{tag}s_{n}", f"{tag}n_{n}", least, value, prior)
    sums += [f"{faded('answered_correctly * w', 0, 'user_id', 0.98)} as xs", f"{faded('w', 0, 'user_id', 0.98)} as xn"]
    score("user_id_weighted_score_decay_0.98", "user_id_weighted_count_decay_0.98", "xs", "xn", 4, 1, "mean")
    for k in range(4):
        frequency = "rows between unbounded preceding and 1 preceding"
        sums += [f"coalesce(sum((case when user_answer = {k} then 1 else 0 end) * pow(0.99, -r0)) over (partition by user_id order by r0 {frequency}), 0) * pow(0.99, r0 - 1) as a_{k}", f"coalesce(sum(e{k} * pow(0.99, -r0)) over (partition by user_id order by r0 {frequency}), 0) * pow(0.99, r0 - 1) as x_{k}"]
    a, x = ("[" + ", ".join(f"{v}_{k}" for k in range(4)) + "][correct_answer + 1]" for v in "ax")
    out.append(f"round({_shrunk_sql(a, x, '1', 4, 1)}, 6) as user_answer_frequency")
    lags = ", ".join(f"lag({f}, {n}) over (partition by user_id order by task_container_id) as {f}_lag_{n}" for f in frame.LAGGED for n in (1, 2, 3))
    made = [f"round({f}_lag_{n}, 6)::double as {f}_lag_{n}" for f in frame.LAGGED for n in (1, 2, 3)]
    out += ["round(coalesce(n_0 * 86400000 / nullif(ts_ms, 0), 0), 6) as user_id_density"]
    out += [f"round(coalesce(n_{n} / nullif(n_0, 0), 0), 6) as user_id_{c}_density" for n, c in enumerate((*frame.PLAIN, "content_id"), 1)]
    exact = ["user_id", "rn", "fold", "ts_ms", "task_container_id", "content_id", "answered_correctly", "prior_question_had_explanation", "question_part", "question_tag", "question_category", "session_id", "session_time", "task_diff",
             "n_lectures", "n_lectures_on_question_part", "time_since_last_lecture", "tasks_since_last_lecture", "last_lecture_time", "task_size", "user_79"]
    near = ["prior_question_elapsed_time", "content_time", "prior_question_time", "prior_question_lost_time", "mean_content_time", "prior_answer_ratio", *encoders.WRONG, *[f"{c}_ratio" for c in frame.RATIOS],
            *[f"{c}_encoded" for c in (*frame.PLAIN, "content_id", "lecture_id", "user_79_content_id", "tasks_bucket_3_content_id", "tasks_bucket_12_content_id")]]
    return f"""{_J}{_QUESTIONS}{_ENCODED}, e5 as materialized (select *, {', '.join(inner)} from e4), e6 as (select *, {', '.join(sums)} from e5),
tl as (select user_id, task_container_id, {', '.join(f"avg({f}) as {f}" for f in frame.LAGGED)} from e4 group by all), ll as (select user_id, task_container_id, {lags} from tl)
select {', '.join(exact)}, {', '.join(f"round({c}, 6)::double as {c}" for c in near)}, {', '.join(out)}, {', '.join(made)} from e6 left join ll using (user_id, task_container_id)"""


def _sixth(df: DataFrame) -> DataFrame:
    """Doubles at six places. Decayed counts are whole numbers times powers of 0.9 or 0.99 and so can end in a 5 at the seventh;
    they are moved off that midpoint, here and in the SQL. Numbers below a billion are rounded as doubles, as SQL does it, and not
    by way of decimals, which takes a microsecond for each cell."""
    def sixth(x):
        whole = F.when(x < 0, -F.floor(0.5 - x * 1e6)).otherwise(F.floor(x * 1e6 + 0.5))
        return F.when(F.abs(x) < 1e9, whole / F.lit(1e6)).otherwise(F.round(x, 6))

    off = lambda c: F.col(f"`{c}`") + (F.lit(3e-8) if "_count" in c else F.lit(0.0))
    return df.withColumns({c: sixth(off(c)) for c, t in df.dtypes if t == "double"})


@query(_frame_sql())
def f11_feature_frame(spark, d):
    """The main pipeline's features over the log of questions and lectures: all but what is fitted (communities, clusters,
    likeness), which f11_fitted_frame has."""
    log = logs.study_log(spark, d)
    return _sixth(frame.feature_frame(log, sessions.preprocess_lectures(_lectures(spark, d)), last=_LAST_FOLD))


@query()
def f11_fitted_frame(spark, d):
    """f11_feature_frame with the columns by fitted communities and clusters, and likeness by vectors of other folds' users."""
    part = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("content_id"), F.col("p_name").alias("tags"))
    log = cut(logs.study_log(spark, d))
    asked = log.where("content_type_id = 0")
    groups = items.item_communities(part, "content_id", "tags").withColumnRenamed("community", "question_community")
    vectors = items.item_vectors(asked, F.col("content_id")).select(F.col("word").cast("long").alias("content_id"), "vector")
    kinds = items.clusters(vectors, 10, seeds=(123, 124)).select("content_id", F.col("category").alias("question_cluster"))
    likeness = part, items.answer_vectors(asked)
    lectures = sessions.preprocess_lectures(_lectures(spark, d))
    return _sixth(frame.feature_frame(log, lectures, last=_LAST_FOLD, groups=cut(groups), kinds=cut(kinds), likeness=likeness))


# online forms, replayed over the latest tasks of every user


REPLAYED = [
    stateful.Score(smoothing=(5, 2)), stateful.Score("question_part", (5, 2), time_since_last=True), stateful.Score("question_category", decay=0.9),
    stateful.Score(rolling=5), stateful.Score(weighted=True), stateful.Score("content_id", rolling=1),
]
LAGGED = ["elapsed_ms", "had_explanation"]
HELD = 3
_BACK = "max(task_container_id) over (partition by user_id) - task_container_id"


def _shown_and_told(log: DataFrame, kind, hidden: list[str]):
    """The latest HELD tasks of each user as batches: each shows one task of a user and tells the answers to the one before."""
    types = dict(log.dtypes)
    for k in range(HELD):
        shown = log.where(F.col("_back") == HELD - 1 - k).withColumns({"kind": kind} | {c: F.lit(None).cast(types[c]) for c in hidden})
        told = log.where((F.col("_back") == HELD - k) & (kind == "question") & F.lit(k > 0)).withColumn("kind", F.lit("answer"))
        yield shown.unionByName(told)


def _held_back(log: DataFrame) -> DataFrame:
    last = F.max("task_container_id").over(Window.partitionBy("user_id"))
    return log.withColumn("_back", last - F.col("task_container_id"))


def _sums(keys: str, y: str = "answered_correctly", n: str = "1") -> str:
    return f"sum({y}) over (partition by {keys} order by k {BEFORE}), sum({n}) over (partition by {keys} order by k {BEFORE})"


@query(f"""{I}, k as (select *, {_WEIGHT} as w0, dense_rank() over (partition by user_id order by ts_ms, task_container_id) - 1 as k,
    dense_rank() over (partition by user_id, question_category order by ts_ms, task_container_id) - 1 as kc, {_BACK} as back from i),
t as (select user_id, task_container_id, {', '.join(f"avg({f}) as {f}" for f in LAGGED)} from i group by all),
l as (select user_id, task_container_id, {', '.join(f"lag({f}, {j}) over w as {f}_lag_{j}" for f in LAGGED for j in (1, 2, 3))} from t window w as (partition by user_id order by task_container_id)),
r as (select *, coalesce(sum(answered_correctly) over u, 0) as s5, count(*) over u as n5, lag(answered_correctly) over c as y1 from k
  window u as (partition by user_id order by rn rows between 5 preceding and 1 preceding), c as (partition by user_id, content_id order by rn)),
s as (select *, coalesce(sum(answered_correctly) over a, 0) as s0, count(*) over a as n0, coalesce(sum(answered_correctly) over p, 0) as s1, count(*) over p as n1, max(ts_ms) over p as t1, max(task_container_id) over p as c1,
    coalesce(sum(answered_correctly * pow(0.9, -kc)) over g, 0) * pow(0.9, kc) as s2, coalesce(sum(pow(0.9, -kc)) over g, 0) * pow(0.9, kc) as n2,
    first(s5) over f as s3, first(n5) over f as n3, coalesce(sum(answered_correctly * w0) over a, 0) as s4, coalesce(sum(w0) over a, 0) as n4, first(y1) over e as y5
  from r window a as (partition by user_id order by k {BEFORE}), p as (partition by user_id, question_part order by k {BEFORE}), g as (partition by user_id, question_category order by kc {BEFORE}),
    f as (partition by user_id, k order by rn), e as (partition by user_id, content_id, k order by rn))
select s.user_id, rn, round(case when n0 > 0 then {_sigmoid('n0', 5, 2)} * s0 / n0 + (1 - {_sigmoid('n0', 5, 2)}) * 0.6 else 0.6 end, 9) as user_id_score, n0::double as user_id_count,
  round(case when n1 > 0 then {_sigmoid('n1', 5, 2)} * s1 / n1 + (1 - {_sigmoid('n1', 5, 2)}) * 0.6 else 0.6 end, 9) as user_id_question_part_score, n1::double as user_id_question_part_count,
  ts_ms - t1 as time_since_last_question_part, s.task_container_id - c1 as tasks_since_last_question_part,
  round(case when n2 > 0 then s2 / n2 end, 9) as "user_id_question_category_score_decay_0.9", round(n2, 9) as "user_id_question_category_count_decay_0.9",
  round(case when n3 > 0 then s3 / n3 end, 9) as user_id_score_5, n3::double as user_id_count_5, round(case when n4 > 0 then s4 / n4 end, 9) as user_id_weighted_score, round(n4, 9) as user_id_weighted_count,
  y5::double as user_id_content_id_score_1, case when y5 is null then 0 else 1 end::double as user_id_content_id_count_1,
  {', '.join(f"round({f}_lag_{j}, 9) as {f}_lag_{j}" for f in LAGGED for j in (1, 2, 3))}
from s left join l on l.user_id = s.user_id and l.task_container_id = s.task_container_id where back < {HELD}""")
def t1_replay_scores(spark, d):
    """The latest tasks of every user through the stateful processor, started from the state of the log before them: what a
    row is shown equals what the batch forms say of it."""
    names = ["user_id", "rn", "ts_ms", "task_container_id", "content_id", "question_part", "question_category", "answered_correctly", "answer_weight", *LAGGED, "_back"]
    log = cut(_held_back(_weighted(spark, d)).select(*names))
    past = log.where(F.col("_back") >= HELD)
    parts = [stateful.Scores(REPLAYED), stateful.Lags(LAGGED)]
    state = stateful.score_state(past, REPLAYED).unionByName(stateful.lag_state(past, LAGGED))
    batches = _shown_and_told(log, F.lit("question"), ["answered_correctly", "answer_weight"])
    shown = stateful.with_scores(stateful.replay(batches, parts, scratch(spark, "replay"), state), REPLAYED, 0.6)
    return rounded(shown.drop("ts_ms", "task_container_id", "kind"))


@query(f"""{_SESSION}, {LECTURES_SQL}, x as (select s.user_id, rn, content_type_id, content_id, task_container_id, ts_ms, session_id, {_BACK.replace('user_id', 's.user_id')} as back,
    min(ts_ms) over (partition by s.user_id, session_id) as session_start, ts_ms - lag(ts_ms) over (partition by s.user_id, session_id order by rn) as diff,
    task_container_id - lag(task_container_id) over (partition by s.user_id order by task_container_id) as task_diff,
    case when content_type_id = 1 then lecture_part else part end as part, case when content_type_id = 1 then lecture_tag else tag end as tag, l.type_of as kind
  from s left join l on l.lecture_id = content_id and content_type_id = 1),
y as (select *, nullif(case when content_type_id = 1 then diff end, 0) as lecture_time, case when content_type_id = 0 then nullif(diff, 0) end::double as content_time from x),
q as (select user_id, rn, lag(content_time) over (partition by user_id, session_id order by rn) as prior_question_time from y where content_type_id = 0),
z as (select *, max(case when content_type_id = 1 then rn end) over w as at, (sum(content_type_id) over w)::bigint as n_lectures,
    {', '.join(f"count(*) filter (where content_type_id = 1 and part = {k}) over w as n_lectures_part{k}" for k in range(1, 8))} from y window w as (partition by user_id order by rn rows unbounded preceding))
select z.user_id, z.rn, z.session_id, z.session_start, z.ts_ms - z.session_start as session_time, z.content_time, z.lecture_time::double as lecture_time, q.prior_question_time, z.task_diff::double as task_diff, z.n_lectures,
  {', '.join(f"z.n_lectures_part{k}" for k in range(1, 8))}, z.ts_ms - b.ts_ms as time_since_last_lecture, z.task_container_id - b.task_container_id as tasks_since_last_lecture, b.lecture_time::double as last_lecture_time,
  coalesce(b.content_id, -1)::bigint as lecture_id, coalesce(b.tag, -1)::bigint as lecture_tag, (coalesce(b.part, 0) - 1)::bigint as lecture_part, coalesce(b.kind, -1)::int as last_type_of,
  {_BUCKET_12.format('coalesce(z.task_container_id - b.task_container_id, 0)')} as tasks_bucket_12, {_BUCKET_3.format('coalesce(z.task_container_id - b.task_container_id, 0)')} as tasks_bucket_3
from z left join z b on b.user_id = z.user_id and b.rn = z.at left join q on q.user_id = z.user_id and q.rn = z.rn where z.back < {HELD}""")
def t3_replay_sessions(spark, d):
    """As t1_replay_scores, for the sessions and lectures of the log that has lectures."""
    names = ["user_id", "rn", "ts_ms", "task_container_id", "content_id", "content_type_id", "part", "tag", "type_of", "answered_correctly", "_back"]
    log = cut(_held_back(sessions.with_lectures(_v(spark, d), sessions.preprocess_lectures(_lectures(spark, d)))).select(*names))
    past = sessions.session_features(log.where(F.col("_back") >= HELD))
    own = stateful.Sessions()
    state = stateful.session_state(past).unionByName(stateful.lecture_state(past))
    kind = F.when(F.col("content_type_id") == 1, "lecture").otherwise("question")
    batches = _shown_and_told(log, kind, ["answered_correctly"])
    shown = stateful.replay(batches, [own, stateful.Lectures(own)], scratch(spark, "replay"), state)
    return stateful.with_lecture_times(shown).drop("ts_ms", "task_container_id", "kind")


FLAGSHIP = "w1_rolling_score"
