"""Product codes of vectors with exact integer distances (operator 12).

Vectors become integers; every part of a vector is coded by the nearest entry of its part's codebook. The nearest entry is
screened with a float32 matrix product: each product's rounding error is bounded, which gives an interval for every
distance, and only entries whose interval overlaps the best one's are evaluated again in 64-bit integers. Codebooks are
learned in rounds; a round is one pass in which a task adds up the parts of each entry, and only those sums leave it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasklore.llm.common import cut, in_arrow

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Integer components are kept within this, so that no sum of a vector's squares leaves 64 bits.
MOST = 1 << 26
_UNIT = 2.0**-24  # largest relative error of one rounding to float32


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the entry of book (entries, size) nearest to each row of x (rows, size), both int64, and the squared distance.

    With x*c rounded to float32 at each of its steps, its error is at most g times the sum of |x||c|, where g is
    k u / (1 - k u) for k roundings of size u; that sum's own float32 value is short by a share of g at most.
    """
    k = x.shape[1] + 4  # the products' roundings, those of both inputs, and the step to double
    g = k * _UNIT / (1 - k * _UNIT)
    left, right = x.astype(np.float32), book.astype(np.float32)
    product = (left @ right.T).astype(np.float64)
    error = 2 * g / (1 - g) * (np.abs(left) @ np.abs(right).T).astype(np.float64)
    near = (book * book).sum(axis=1).astype(np.float64) - 2 * product  # the distance, less the row's own square
    error += np.abs(near) * 2.0**-50 + 1e-30
    open_ = near - error <= (near + error).min(axis=1)[:, None]
    at = open_.argmax(axis=1)
    again = np.flatnonzero(open_.sum(axis=1) > 1)
    if len(again):
        row, entry = np.nonzero(open_[again])
        exact = np.full((len(again), len(book)), np.iinfo(np.int64).max)
        exact[row, entry] = ((x[again[row]] - book[entry]) ** 2).sum(axis=1)
        at[again] = exact.argmin(axis=1)  # the first of equal ones
    return at, ((x - book[at]) ** 2).sum(axis=1)


def integers(column: pa.Array) -> np.ndarray:
    """Rows of a list column whose lists are equally long, as floor(SCALE * component)."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(values * SCALE), -MOST, MOST).astype(np.int64).reshape(len(column), -1)


def _sums(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """part, entry, place, total, n: for every task, sums of the components of the parts that are nearest to each entry."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, size = books.shape
        total, n = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = integers(batch.column(0)).reshape(batch.num_rows, parts, size)
            for p in range(parts):
                at = nearest(x[:, p], books[p])[0]
                n[p] += np.bincount(at, minlength=entries)
                np.add.at(total[p], at, x[:, p])
        if n.any():
            index = [i.ravel() for i in np.indices(books.shape)]
            cols = [*index, total.ravel(), np.repeat(n.ravel(), size)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["part", "entry", "place", "total", "n"])

    return in_arrow(vectors.select("embedding"), scan, "part long, entry long, place long, total long, n long")


def learned(vectors: DataFrame, first: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, place) after the rounds; vectors: those of equal length that all count. A round brings one
    number for each component of the codebooks to the driver."""
    books = first
    for _ in range(rounds):
        books = books.copy()
        for r in _sums(vectors, books).groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).where("n > 0").collect():
            books[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
    return books


def books_text(books: np.ndarray) -> str:
    return ",".join(map(str, books.ravel().tolist()))


def product_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for each kept row of vectors (vec_id, embedding, label).

    Rows with a null vector, or with a null or non-finite component, are dropped, as the contract says. Components become
    floor(4096 x), those beyond 2^26 (x beyond 16,384) 2^26. Codebooks start from the smallest vec_ids (nulls last, equal ones
    by their vectors), fewer where there are fewer rows. A vector whose number of components differs from that of the smallest
    vec_id has null code and error and takes no part. A number of components that `parts` does not divide raises ValueError.
    Repeated rows count each. An empty table gives an empty result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label").where(F.col("embedding").isNotNull() & good)
    order = [F.col("vec_id").asc_nulls_last(), F.col("embedding")]
    head = kept.orderBy(*order).limit(1).collect()
    schema = "vec_id long, label int, code string, error long"
    if not head:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    size = len(head[0]["embedding"])
    if size % parts or not size:
        raise ValueError(f"{size} components do not make {parts} equal parts")
    whole = kept.where(F.size("embedding") == size)
    first = [r["embedding"] for r in whole.orderBy(*order).limit(entries).collect()]
    start = integers(pa.array(first, pa.list_(pa.float64()))).reshape(len(first), parts, size // parts).transpose(1, 0, 2)
    books = learned(whole, np.ascontiguousarray(start), rounds)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integers(batch.column(2)).reshape(batch.num_rows, parts, size // parts)
            found = [nearest(x[:, p], books[p]) for p in range(parts)]
            codes = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
            text = [row.tobytes().hex() for row in codes]
            error = sum(f[1] for f in found)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    coded = in_arrow(whole.select(F.col("vec_id").cast("long"), F.col("label").cast("int"), "embedding"), scan, schema)
    others = kept.where(F.size("embedding") != size).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = cut(coded.unionByName(others))
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error"))
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    digest = hashlib.sha256(books_text(books).encode()).hexdigest()
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
