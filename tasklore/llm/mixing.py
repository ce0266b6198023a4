"""Mixing sources to target weights by Pareto order sampling (operator 5).

Each source's target is a share of the words by weight, capped at `most` times what it has, the excess reshared.
Within a source documents have unequal odds: their expected copies are proportional to a measure that grows with the
number of their words (from 1.1 for one word to 2.0 for 512 and more), at most `most`, and scaled so that the expected
words meet the target. The whole part of a document's expected copies is certain. The rest, p, is its inclusion odds in
a sample of fixed size: documents rank by (u / (1 - u)) / (p / (1 - p)), random odds over inclusion odds, and are taken
from the top until the source's remaining words are met. The prefix sums over that order run in two levels, totals of
buckets of the rank, then within a bucket, over slim rows; so a source with a third of all rows is spread over many
tasks. All that comes back to the documents is one row for each source and measure, with the source's last rank taken.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tasklore.llm.common import WORD, cut, text_or_empty


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes (source, source_size), one row a source: adds weight and target.

    Targets fill like water: min(most * size, level * weight). The level is the largest of those that result when
    the sources with the smallest cap for their weight stop at their cap.
    """
    nth = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth + 1).cast("int")))
    capped = weighed.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    below = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(Window.partitionBy()) * F.lit(share) - below) / rest
    return capped.withColumn("own", level).withColumn("level", F.max("own").over(Window.partitionBy())).select(
        "source", "source_size", "weight", F.least("cap", F.col("level") * F.col("weight")).alias("target")
    )


def measure(size: Column) -> Column:
    """Tenths of a document's weight in its source, by its number of words: 11 to 20."""
    return (F.least(F.length(F.bin(size)), F.lit(10)) + 10).cast("int")


def expected_copies(classes: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """classes (source, tenths, words) with targets -> source, tenths, source_size, target, whole, p.

    A class has min(most, level * tenths) copies; the level is the largest of those that result when the classes with the
    most tenths stop at `most`. Sums are whole numbers, so that they do not depend on their order.
    """
    order = Window.partitionBy("source").orderBy(F.col("tenths").desc())
    above = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("words") * F.col("tenths")).over(order.rowsBetween(0, Window.unboundedFollowing))
    own = F.when(rest > 0, (F.col("target") - above * F.lit(most)) / rest).otherwise(0.0)
    out = classes.join(targets, classes["source"].eqNullSafe(targets["source"])).select(classes["*"], "source_size", "target")
    out = out.withColumn("own", own).withColumn("level", F.max("own").over(Window.partitionBy("source")))
    copies = F.round(F.greatest(F.least(F.col("level") * F.col("tenths"), F.lit(most)), F.lit(0.0)), 9)
    out = out.withColumn("copies", copies).withColumn("whole", F.floor("copies"))
    return out.select("source", "tenths", "words", "source_size", "target", "whole", (F.col("copies") - F.col("whole")).alias("p"))


def pareto_mix(
    docs: DataFrame,
    weights: tuple = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
    tenths: Column | None = None,
    keep: tuple = (),
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies for every row of docs (doc_id, text, source), and the columns in keep.

    tenths: a whole number above 0 for each document, to which its expected copies are proportional (few distinct ones);
    else measure(size). A null text or one without words has size 0 and takes 0. A null source is a source of its own, last
    in order. Repeated rows share u and are taken one by one. The result depends on rows only, not on how they are dealt.
    An empty table gives an empty result.
    """
    text = text_or_empty()
    key = F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string"), F.md5(text))
    u = (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))
    rows = docs.select(*keep, "doc_id", "source", word_count(text).alias("size"), u.alias("u"), *([] if tenths is None else [tenths.alias("tenths")]))
    base = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    base = base if tenths is not None else base.withColumn("tenths", measure(F.col("size")))
    classes = cut(base.groupBy("source", "tenths").agg(F.sum("size").alias("words"), F.count("*").alias("n")))
    n_buckets = 2 ** max(4, math.ceil(math.log2(1 + (classes.agg(F.sum("n")).first()[0] or 0) / 2000)))
    targets = source_targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    expected = cut(expected_copies(classes, targets, most))
    same = lambda a, b, *more: functools.reduce(lambda x, k: x & (a[k] == b[k]), more, a["source"].eqNullSafe(b["source"]))
    rank = F.col("u") / (1 - F.col("u")) / (F.col("p") / (1 - F.col("p")))
    slim = base.select("doc_id", "source", "size", "u", "row", "tenths")
    slim = slim.join(expected, same(slim, expected, "tenths")).where("p > 0").select(slim["*"], rank.alias("rank"))
    slim = slim.withColumn("bucket", F.least(F.floor(F.col("rank") / (1 + F.col("rank")) * n_buckets), F.lit(n_buckets - 1)))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slim.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    offsets = offsets.select("source", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    wanted = expected.groupBy("source").agg((F.first("target") - F.sum(F.col("whole") * F.col("words"))).alias("wanted"))
    offsets = offsets.join(wanted, same(offsets, wanted)).select(offsets["*"], "wanted")
    placed = slim.join(offsets, same(slim, offsets, "bucket")).select(slim["*"], "offset", "wanted")
    inside = Window.partitionBy("source", "bucket").orderBy("rank", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("offset") + F.sum("size").over(inside) - F.col("size")
    place = F.struct("rank", "doc_id", "size", "row")  # in order of place what is taken is a prefix
    last = placed.withColumn("start", start).where(F.col("start") + F.col("size") / 2 <= F.col("wanted")).groupBy("source").agg(F.max(place).alias("last"))
    known = cut(expected.join(last, same(expected, last), "left").select(expected["*"], "last"))
    out = base.join(known, same(base, known, "tenths")).select(base["*"], *(known[c] for c in ("source_size", "target", "whole", "p", "last")))
    drawn = F.coalesce((F.col("p") > 0) & (place <= F.col("last")), F.lit(False))
    copies = F.least(F.col("whole") + F.when(drawn, 1).otherwise(0), F.lit(int(most))).cast("long")
    return out.withColumn("rank", F.when(F.col("p") > 0, rank)).withColumn("copies", copies).select(
        *keep, "doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )
