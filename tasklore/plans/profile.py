"""A profile of any frame: nulls, distinct values, ranges, medians and most frequent values of every column; and its size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasklore.operators.ranges import exact_quantiles, top_counts

FLOATS, DATES = ("double", "float", "decimal"), ("date", "timestamp", "timestamp_ntz")


def kind_of(type_name: str) -> str:
    if type_name.startswith(FLOATS):
        return "number"
    if type_name in DATES:
        return "date"
    return "category" if type_name in ("string", "boolean", "tinyint", "smallint", "int", "bigint") or type_name.startswith(("char", "varchar")) else "object"


def analyzed(df: DataFrame, top: int = 5) -> DataFrame:
    """A row for each column: name, type, kind, n_rows, n_null, n_unique (nulls apart), for numbers low, mid (exact median) and
    high, for dates first_date and last_date, for categories `frequent`: the most frequent values with their counts.

    One aggregation reads the frame for what is one number a column; one more counts (column, value), and its sums give
    distinct and frequent values of all columns at once. Objects (arrays, structs, maps, binary) have their nulls only.
    """
    kinds = {c: kind_of(t) for c, t in df.dtypes}
    col = {c: F.col(f"`{c}`") for c in df.columns}
    facts = []
    for k, (c, kind) in enumerate(kinds.items()):
        facts.append(F.count(col[c]).alias(f"n_{k}"))
        if kind in ("number", "date"):
            facts += [f(col[c].cast("double" if kind == "number" else "date")).alias(f"{name}_{k}") for name, f in (("low", F.min), ("high", F.max))]
    one = df.agg(F.count("*").alias("n_rows"), *facts)
    none = {"number": F.lit(None).cast("double"), "date": F.lit(None).cast("string")}

    def row(k: int, c: str, kind: str, type_name: str):
        number = [F.col(f"{n}_{k}") if kind == "number" else none["number"] for n in ("low", "high")]
        date = [F.col(f"{n}_{k}").cast("string") if kind == "date" else none["date"] for n in ("low", "high")]
        values = [F.lit(c), F.lit(type_name), F.lit(kind), F.col("n_rows") - F.col(f"n_{k}"), *number, *date]
        names = ["column", "type", "kind", "n_null", "low", "high", "first_date", "last_date"]
        return F.struct(*[v.alias(n) for v, n in zip(values, names, strict=True)])

    rows = one.select("n_rows", F.explode(F.array(*[row(k, c, kinds[c], t) for k, (c, t) in enumerate(df.dtypes)])).alias("r")).select("r.*", "n_rows")
    plain = [c for c in df.columns if kinds[c] != "object"]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), col[c].cast("string").alias("value"), F.lit(kinds[c] == "category").alias("named")) for c in plain]))
    counts = df.select(pairs.alias("r")).select("r.*").where("value is not null").groupBy("column", "value", "named").agg(F.count("*").alias("n"))
    uniques = counts.groupBy("column").agg(F.count("*").alias("n_unique"))
    best = top_counts(counts.where("named"), ["column"], "value", "n", top).groupBy("column").agg(F.array_sort(F.collect_list(F.struct("place", "value", "n"))).alias("l"))
    best = best.select("column", F.array_join(F.transform("l", lambda x: F.concat_ws("=", x["value"], x["n"].cast("string"))), ", ").alias("frequent"))
    numbers = [c for c in df.columns if kinds[c] == "number"]
    out = rows.join(uniques, "column", "left").join(best, "column", "left")
    if numbers:
        values = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), col[c].cast("double").alias("x")) for c in numbers])).alias("r")).select("r.*")
        out = out.join(exact_quantiles(values, "x", [0.5], ["column"]).select("column", F.col("quantiles")[0].alias("mid")), "column", "left")
    else:
        out = out.withColumn("mid", none["number"])
    names = ["column", "type", "kind", "n_rows", "n_null", "n_unique", "low", "mid", "high", "first_date", "last_date", "frequent"]
    return out.withColumn("n_unique", F.when(F.col("kind") != "object", F.coalesce("n_unique", F.lit(0)))).select(*names)


def size_of(df: DataFrame) -> dict[str, int]:
    """Rows, columns, and the bytes that the optimizer expects of the frame."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return {"rows": df.count(), "columns": len(df.columns), "bytes": int(str(stats.sizeInBytes()))}
