"""Tables kept between steps: cuts of lineage, a cache keyed by what made it, and state by user."""

from __future__ import annotations

import atexit
import functools
import hashlib
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="tasklore-")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir), or one of our own where it is unset and all run in one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.sparkContext.master
    if not found and master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (found or _own_dir()).rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends there, and a lost executor loses nothing."""
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if spark.sparkContext._jsc is None or jvm is None:
        return
    try:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; the folder's owner clears it
        pass


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _content(value: object) -> str:
    if not isinstance(value, DataFrame):
        return str(value)
    mark = F.xxhash64(*value.columns)
    facts = value.agg(F.count("*"), F.bit_xor(mark), F.sum(F.shiftright(mark, 20))).first()
    return f"{value.schema.simpleString()} {tuple(facts)}"


def _code(make) -> str:
    code = getattr(make, "__code__", None)
    return "" if code is None else hashlib.sha256(code.co_code + repr(code.co_names).encode() + repr([c for c in code.co_consts if not hasattr(c, "co_code")]).encode()).hexdigest()


def cached(make, spark: SparkSession, folder: str, **params) -> DataFrame:
    """make(**params), kept in folder under a name made of all parameters; read again if it is there in full. A DataFrame
    counts by its schema and by three 64-bit sums over its rows' hashes, however they are ordered, so that changed data are made
    anew; so does changed code of make itself, but not of what it calls."""
    name = hashlib.sha256(json.dumps([make.__module__, make.__qualname__, _code(make), params], sort_keys=True, default=_content).encode()).hexdigest()[:24]
    path = f"{folder}/{name}"
    if not _exists(spark, f"{path}/_SUCCESS"):
        make(**params).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_state(features: DataFrame, path: str, key: str = "user_id") -> None:
    """One row of state for each user, as a struct and as JSON text."""
    held = F.struct(*[c for c in features.columns if c != key])
    features.select(key, held.alias("state"), F.to_json(held).alias("text")).write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str, users: DataFrame, key: str = "user_id") -> DataFrame:
    """The state of the users given; only theirs."""
    return spark.read.parquet(path).join(users.select(key).distinct(), key, "left_semi")
