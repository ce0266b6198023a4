"""Scalar expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper edges of the buckets of tasks since the last lecture.
EDGES_12 = (10, 20, 30, 50, 100, 300)
LECTURE_TYPES = {"concept": 0, "solving question": 1, "intention": 2, "starter": 2}


def tasks_bucket_12(x: Column) -> Column:
    out = F.when(x <= -2, -2).when(x <= 2, x)
    for edge in EDGES_12:
        out = out.when(x <= edge, edge)
    return out.otherwise(500).cast("int")


def tasks_bucket_3(x: Column) -> Column:
    return F.when(x <= 0, 0).when(x <= 2, 1).otherwise(3).cast("int")


def tasks_group(x: Column) -> Column:
    up = lambda step: F.ceil(x / step) * step
    return F.when(x <= 15, 15).when(x < 30, 30).when(x == 30, 40).when(x <= 50, up(10)).when(x <= 1000, up(100)).otherwise(up(1000)).cast("int")


def smooth(n: Column, least: float | None, value: float | None) -> Column:
    """Weight of a mean over n rows: a sigmoid, 1 where value is 0 or there is no smoothing."""
    if least is None or not value:
        return F.lit(1.0)
    return 1 / (1 + F.exp(-(n - F.lit(float(least))) / F.lit(float(value))))


def shrunk(total: Column, n: Column, prior: Column, least: float | None, value: float | None) -> Column:
    """Mean of n rows shrunk to a prior; without smoothing the mean itself, null for no rows."""
    mean = F.try_divide(total, n)
    if least is None or value is None:
        return mean
    weight = smooth(n, least, value) * F.when(n > 0, 1.0).otherwise(0.0)
    return F.coalesce(weight * mean, F.lit(0.0)) + (1 - weight) * prior


def answer_weight(chance: Column, correct: Column) -> Column:
    return F.when(correct == 0, chance).when(correct == 1, 1 - chance).otherwise(0.0)


def uniform(number: Column) -> Column:
    """A fixed number from [0, 1) for a whole number."""
    return (number * 2654435761 % 4294967296).cast("double") / 4294967296


def noisy(x: Column, noise: float, chance: Column) -> Column:
    """x and uniform noise of that width around 0, kept in [0, 1]; chance: a fixed number from [0, 1) for the row."""
    return F.least(F.greatest(x + (chance - 0.5) * F.lit(noise), F.lit(0.0)), F.lit(1.0))


def ratio(over: Column, under: Column) -> Column:
    return over / F.when(under == 0, 0.00001).otherwise(under)


def densities(df: DataFrame, counts: list[str], total: str = "user_id_count", time: str = "ts_ms") -> DataFrame:
    """user_id_density: rows a day; and each count's share of the total, named without its _count."""
    out = {"user_id_density": F.coalesce(F.try_divide(F.col(total) * 86_400_000, F.col(time)), F.lit(0.0))}
    out |= {c.removesuffix("_count") + "_density": F.coalesce(F.try_divide(F.col(c), F.col(total)), F.lit(0.0)) for c in counts}
    return df.withColumns(out)


def smallest_int(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, type: the smallest integer type strictly narrower than long that holds each column's values."""
    facts = df.agg(*[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"lo_{c}").cast("long").alias("lo"), F.col(f"hi_{c}").cast("long").alias("hi")) for c in columns]))
    kind = F.lit("bigint")
    for name, bits in (("int", 31), ("smallint", 15), ("tinyint", 7)):
        kind = F.when((F.col("lo") >= -(2**bits)) & (F.col("hi") < 2**bits), name).otherwise(kind)
    return facts.select(rows.alias("r")).select("r.*").withColumn("type", kind)


def select_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """The frozen columns of a training frame; raises if one is missing."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*columns)


def restored(df: DataFrame, like: DataFrame) -> DataFrame:
    """df with the types that `like` has for the columns of both."""
    kinds = dict(like.dtypes)
    return df.withColumns({c: F.col(c).cast(kinds[c]) for c, t in df.dtypes if c in kinds and kinds[c] != t})


def narrow_floats(df: DataFrame, kind: str = "float") -> DataFrame:
    return df.withColumns({c: F.col(c).cast(kind) for c, t in df.dtypes if t == "double"})
