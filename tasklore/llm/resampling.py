"""Importance resampling of documents toward a target's hashed word features (operator 13).

A document's weight is a sum over its runs of 1 to 3 words, so a long text can be cut: chunks end at word boundaries and
carry the next two words, and each owns the runs that start in it. Chunks of long texts are dealt to all tasks; counts by
bucket are added up in each task before they leave it, and a document's weight is the sum of its chunks'. CRC-32 is linear:
that of a run comes from those of its words, shifted by the lengths of what follows, for all runs of a batch at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tasklore.llm.common import cut, in_arrow, parts, text_or_empty
from tasklore.llm.shingles import buffer_of, chunks
from tasklore.llm.wordscan import places

RUN, BUCKETS, LEAST_WORDS, SHARE, SEED = 3, 10_000, 20, 5, "42"
#: Bytes of text beyond which a text is cut, and of the starts that a chunk of it owns.
CHUNK = 1 << 15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True

_U = np.uint32


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=_U)
    for _ in range(8):
        out = np.where(out & _U(1), (out >> _U(1)) ^ _U(0xEDB88320), out >> _U(1))
    return out


_CRC = _crc_table()
#: Words of more bytes than this take their CRC one by one, and are shifted by powers of two.
NEAR = 64


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """near[n]: what n zero bytes after it make of a CRC, by each of its four bytes; far[k]: the same for 2^k zero bytes."""
    now = np.arange(256, dtype=_U)[None, :] << (_U(8) * np.arange(4, dtype=_U))[:, None]
    near = [now]
    for _ in range(NEAR + 1):
        now = _CRC[now & _U(255)] ^ (now >> _U(8))
        near.append(now)
    far = [near[1]]
    for _ in range(40):
        far.append(_apply(far[-1], far[-1]))
    return np.stack(near), np.stack(far)


def _apply(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    return table[0][c & _U(255)] ^ table[1][(c >> _U(8)) & _U(255)] ^ table[2][(c >> _U(16)) & _U(255)] ^ table[3][c >> _U(24)]


_NEAR, _FAR = _tables()


def shifted(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What n[i] zero bytes after it make of the CRC c[i]."""
    short = np.minimum(n, NEAR + 1)
    out = _NEAR[short, 0, c & _U(255)] ^ _NEAR[short, 1, (c >> _U(8)) & _U(255)] ^ _NEAR[short, 2, (c >> _U(16)) & _U(255)] ^ _NEAR[short, 3, c >> _U(24)]
    for i in np.flatnonzero(n > NEAR + 1):
        one = c[i : i + 1]
        for k in range(int(n[i]).bit_length()):
            if int(n[i]) >> k & 1:
                one = _apply(_FAR[k], one)
        out[i] = one[0]
    return out


def word_crcs(low: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of every word: byte by byte over all words at once, the longest first."""
    order = np.argsort(-lengths, kind="stable")
    at, size = starts[order], lengths[order]
    c = np.full(len(at), 0xFFFFFFFF, _U)
    far = int(np.searchsorted(-size, -NEAR, "left"))  # so many are longer than NEAR
    for j in range(int(size[far]) if far < len(size) else 0):
        n = int(np.searchsorted(-size, -j, "left"))
        c[far:n] = _CRC[(c[far:n] ^ low[at[far:n] + j]) & _U(255)] ^ (c[far:n] >> _U(8))
    c ^= _U(0xFFFFFFFF)
    for i in range(far):
        c[i] = zlib.crc32(low[at[i] : at[i] + size[i]].tobytes())
    out = np.empty_like(c)
    out[order] = c
    return out


def features(low: np.ndarray, offsets: np.ndarray, carry: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Edges of the texts' own words, and for runs of 1 to RUN words the starts (in words) and the buckets of those owned.

    low: lower-cased texts end to end; carry: how many words at each text's end belong to the next chunk.
    """
    starts, ends, edges = places(_WORD[low], offsets)
    lengths = ends - starts
    n = len(starts)
    left = np.repeat(edges[1:], np.diff(edges)) - np.arange(n)  # words from here to the text's end
    own = left > np.repeat(carry, np.diff(edges))
    crc = word_crcs(low, starts, lengths)
    spaced = shifted(np.full(n, zlib.crc32(b" "), _U), lengths) ^ crc
    found, run = [], crc
    for k in range(RUN):
        if k:
            run = shifted(run[:-1], lengths[k:] + 1) ^ spaced[k:] if len(run) > 1 else run[:0]
        at = np.flatnonzero(own[: len(run)] & (left[: len(run)] > k))
        found.append((at, (run[at] % _U(BUCKETS)).astype(np.int64)))
    return edges, found


def _texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, t1, t2, chunk, carry, text) of the short texts, and of the chunks of the long ones, dealt to all tasks."""
    text = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id") if "doc_id" in docs.columns else F.lit(None).cast("long").alias("doc_id"), text.alias("text"))
    short = rows.where(F.octet_length("text") <= CHUNK).select("doc_id", *[F.lit(0).cast("long").alias(c) for c in ("t1", "t2", "chunk", "carry")], "text")
    long = rows.where(F.octet_length("text") > CHUNK).select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2"), "text")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, t1, t2, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3).cast(pa.binary()).to_pylist(), strict=True):
                low = _LOWER[np.frombuffer(raw, np.uint8)]
                starts, ends, _ = places(_WORD[low], np.array([0, len(low)]))
                cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(raw), CHUNK)), len(starts)))
                for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if len(starts) else [(0, (0, 0))]:
                    last = min(b + RUN - 1, len(starts))
                    piece = low[starts[a] : ends[last - 1]].tobytes() if b else b""
                    row = [[doc], [t1], [t2], [k], [last - b], [piece.decode()]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in row[:5]] + [pa.array(row[5], pa.string())], ["doc_id", "t1", "t2", "chunk", "carry", "text"])

    pieces = in_arrow(long, split, "doc_id long, t1 long, t2 long, chunk long, carry long, text string")
    return short, pieces.repartition(parts(docs.sparkSession), "t1", "chunk")


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How many features of all texts of docs (text) fall into each bucket: BUCKETS rows reach the driver."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            raw, offsets = buffer_of(batch.column(1))
            carry = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in chunks(offsets):
                for _, buckets in features(_LOWER[raw[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a], carry[a:b])[1]:
                    total += np.bincount(buckets, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    short, long = (in_arrow(x.select("carry", "text"), scan, "bucket long, n long") for x in _texts(docs))
    out = np.zeros(BUCKETS, np.int64)
    for r in short.unionByName(long).groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's floor(1000 ln of the target's smoothed share over the documents' own)."""
    s, t = own.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight for every row of docs (doc_id, text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffer_of(batch.column(5))
            carry = batch.column(4).to_numpy(zero_copy_only=False)
            n_words, n_features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for a, b in chunks(offsets):
                edges, found = features(_LOWER[raw[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a], carry[a:b])
                n_words[a:b] = np.maximum(np.diff(edges) - carry[a:b], 0)
                for at, buckets in found:
                    upto = np.append(0, np.cumsum(gain[buckets]))
                    place = np.searchsorted(at, edges)
                    n_features[a:b] += np.diff(place)
                    weight[a:b] += np.diff(upto[place])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *map(pa.array, (n_words, n_features, weight))], ["doc_id", "t1", "t2", "chunk", "n_words", "n_features", "weight"])

    names = ["n_words", "n_features", "weight"]
    short, long = (in_arrow(x, scan, "doc_id long, t1 long, t2 long, chunk long, n_words long, n_features long, weight long") for x in _texts(docs))
    # rows that are the same row repeated add up too, and there are as many first chunks as rows
    whole = long.groupBy("doc_id", "t1", "t2").agg(*[F.sum(c).alias(c) for c in names], F.count_if(F.col("chunk") == 0).alias("m"))
    whole = whole.select("doc_id", *[F.expr(f"{c} div m").alias(c) for c in names], F.explode(F.sequence(F.lit(1).cast("long"), "m")).alias("_")).drop("_")
    return short.select("doc_id", *names).unionByName(whole)


def importance_resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank for every row of docs (doc_id, text), toward target (text).

    rank: 1, 2, .. of the floor(share N / 100) highest scores among the N rows with `least` words or more, ties to the smaller
    doc_id (null last), else null. Scores are spread over ranges, and a row's rank is its place in its range after the ranges
    before. A null text has no words; a null doc_id draws as an empty one. Very long texts are cut (CHUNK); repeated rows count
    each. An empty table gives an empty result; an empty target has no features. Other columns are ignored.
    """
    weighed = weights(docs, gains(bucket_counts(docs), bucket_counts(target)))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    chance = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    scored = weighed.withColumns({"score": F.col("weight") + chance, "open": F.col("n_words") >= least})
    order = [F.col("open").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    dealt = cut(scored.repartitionByRange(parts(docs.sparkSession), *order).withColumn("part", F.spark_partition_id()))
    ranges = dealt.groupBy("part").agg(F.count_if("open").alias("n"))  # one row a range
    every = Window.orderBy("part")
    ranges = ranges.select("part", (F.sum("n").over(every) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    drawn = F.col("open") & (F.col("place") <= F.floor(F.col("total") * share / 100))
    out = dealt.join(F.broadcast(ranges), "part").withColumn("place", place)
    return out.select("doc_id", "n_words", "n_features", "weight", "score", F.when(drawn, F.col("place")).cast("long").alias("rank"))
