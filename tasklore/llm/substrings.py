"""Exact removal of long repeated byte strings with a sparse enhanced suffix array (operator 1).

Every string of PASSAGE bytes holds an anchor: a position whose 64-byte hash is the smallest of a window as long as the
string allows, so equal strings have equal anchors at equal places. Anchors found once are dropped. Around each of the
others a document gives the bytes that strings through the anchor can reach. The suffixes that start at equal anchors
are sorted in a task; a scan with a stack over their common prefixes visits the tree of common-prefix intervals from
below, and merging the intervals' members in order of their left contexts tells how far each is preceded alike by
another one: where the left contexts part, a maximal repeat ends, and all its occurrences are covered. Anchors are set
for strings of PASSAGE bytes, so the same scan also tells which bytes shorter repeated passages cover. Anchors with more
than GROUP occurrences go another exact way, which spreads them over all tasks: their strings' hashes are counted in Spark.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasklore.llm.common import cut, in_arrow, parts, text_or_empty
from tasklore.llm.grouping import groups
from tasklore.llm.shingles import buffer_of, chunks, mix, powers

#: Bytes of a repeated string that is removed, of one that is reported as a passage, and of an anchor.
LEAST, PASSAGE, GRAM = 400, 256, 64
SPAN = PASSAGE - GRAM + 1
ID = ["t1", "t2"]
#: Contexts of an anchor that one task sorts; beyond it, string hashes are counted instead.
GROUP = 16_384
_U = np.uint64
_TABLES = [mix(np.arange(1, 257, dtype=_U) * _U(k)) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
_STEP = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_STEP, -1, 1 << 64)


def rolling(raw: np.ndarray, width: int, table: int = 0) -> np.ndarray:
    """A hash of raw[i:i + width] for every i."""
    n = len(raw) - width + 1
    sums = np.zeros(len(raw) + 1, _U)
    np.cumsum(_TABLES[table][raw] * powers(len(raw)), out=sums[1:])
    back = np.full(n, _BACK, _U)
    back[0] = 1
    return mix((sums[width:] - sums[:n]) * np.multiply.accumulate(back))


def sliding(x: np.ndarray, width: int, of: np.ufunc, pad: int) -> np.ndarray:
    """of (minimum or maximum) over x[i:i + width] for every i, windows cut off at the end."""
    n = len(x)
    full = np.full(-(-(n + width) // width) * width, pad, x.dtype)
    full[:n] = x
    rows = full.reshape(-1, width)
    ahead = of.accumulate(rows, axis=1).ravel()
    behind = of.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return of(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of the texts raw[edges[k]:edges[k + 1]], laid end to end."""
    starts = np.zeros(len(raw) + 1, np.int32)  # how many strings of PASSAGE bytes start at a place: 1 or 0
    long = np.diff(edges) >= PASSAGE
    if not long.any():
        return np.empty(0, np.int64), np.empty(0, _U)
    np.add.at(starts, edges[:-1][long], 1)
    np.add.at(starts, edges[1:][long] - PASSAGE + 1, -1)
    starts = np.cumsum(starts)[:-1] > 0
    hashes = rolling(raw, GRAM)
    least = sliding(hashes, SPAN, np.minimum, 2**64 - 1)
    least = np.where(starts[: len(least)], least, _U(0))
    reach = sliding(least[::-1], SPAN, np.maximum, 0)[::-1]  # the largest of the windows that hold a place
    at = np.flatnonzero(reach == hashes)
    return at, hashes[at]


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def maximal_repeats(lefts: list[bytes], rights: list[bytes], least: int = PASSAGE, gram: int = GRAM) -> list[tuple[int, int, int]]:
    """Members of one anchor by their left contexts, reversed, and right contexts -> (member, left, right): the reach of
    strings of `least` bytes or more, `gram` of them to the right, that the member shares with another one."""
    out: list[tuple[int, int, int]] = []
    same: dict[tuple[bytes, bytes], list[int]] = {}
    for k, both in enumerate(zip(lefts, rights, strict=True)):
        same.setdefault(both, []).append(k)
    for (left, right), members in same.items():
        if len(members) > 1 and len(left) + len(right) >= least:
            out += [(k, len(left), len(right)) for k in members]
    own = sorted(same, key=lambda both: both[1])  # the suffix array
    if len(own) < 2:
        return out
    best = [0] * len(own)

    def found(x: int, left: int, right: int) -> None:
        if left > best[x]:
            best[x] = left
            if left + right >= least:
                out.extend((k, left, right) for k in same[own[x]])

    def merge(a: list[tuple[bytes, int]], b: list[tuple[bytes, int]], right: int) -> list[tuple[bytes, int]]:
        """Two intervals below one with the common prefix `right`: the smaller goes into the larger, by left context."""
        if len(a) < len(b):
            a, b = b, a
        for one in b:
            k = bisect_left(a, one)
            for other in a[max(k - 1, 0) : k + 1]:
                left = common_prefix(one[0], other[0])
                found(one[1], left, right)
                found(other[1], left, right)
            a.insert(k, one)
        return a

    stack: list[tuple[int, list[tuple[bytes, int]]]] = []
    now = [(own[0][0], 0)]
    for x in range(1, len(own) + 1):
        prefix = common_prefix(own[x - 1][1], own[x][1]) if x < len(own) else 0
        while stack and stack[-1][0] > prefix:
            right, before = stack.pop()
            now = merge(before, now, right)
        if prefix < gram:
            stack.clear()  # nothing in common from here on
        elif stack and stack[-1][0] == prefix:
            stack[-1] = prefix, merge(stack[-1][1], now, prefix)
        else:
            stack.append((prefix, now))
        if x < len(own):
            now = [(own[x][0], x)]
    return out


def union(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of the ranges from a to b, in order."""
    if not len(a):
        return a, b
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    first = np.append(True, a[1:] > b[:-1])
    last = np.append(np.flatnonzero(first)[1:] - 1, len(a) - 1)
    return a[first], b[last]


def _anchor_counts(docs: DataFrame) -> DataFrame:
    """docs (doc_id, t1, t2, text) -> h, t1, t2, rep, n: a row for each text and anchor."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffer_of(batch.column(3))
            for a, b in chunks(offsets):
                edges = offsets[a : b + 1] - offsets[a]
                at, hashes = anchors(raw[offsets[a] : offsets[b]], edges)
                if not len(at):
                    continue
                doc = np.searchsorted(edges, at, "right") - 1
                order = np.lexsort((hashes, doc))
                doc, hashes = doc[order], hashes[order]
                first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])))
                rows = pa.array(doc[first] + a)
                own = [batch.column(k).take(rows) for k in (1, 2, 0)]
                yield pa.RecordBatch.from_arrays([pa.array(hashes[first].view(np.int64)), *own, pa.array(np.diff(np.append(first, len(doc))))], ["h", "t1", "t2", "rep", "n"])

    return in_arrow(docs.select("doc_id", "t1", "t2", "text"), scan, "h long, t1 long, t2 long, rep long, n long")


def _contexts(docs: DataFrame) -> DataFrame:
    """docs (t1, t2, text, hs) -> h, t1, t2, at, left, context; and rows without a context, under any h: what repeats of an
    anchor within the text cover, from at to left, in pieces below LEAST bytes where no string of LEAST bytes repeats."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for t1, t2, text, hs in zip(*(c.to_pylist() for c in batch.columns[:2]), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3), strict=True):
                at, hashes = anchors(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
                ok = np.isin(hashes, hs.values.to_numpy(zero_copy_only=False).view(_U))
                own: list[tuple[int, int]] = []
                seen: dict[tuple[int, int, bytes], int] = {}
                for p, h in zip(at[ok].tolist(), hashes[ok].view(np.int64).tolist(), strict=True):
                    left = min(p, LEAST - GRAM)
                    one = h, left, text[p - left : p + LEAST]
                    if one not in seen:
                        seen[one] = p
                        rows.append((h, t1, t2, p, left, one[2]))
                    elif len(one[2]) >= PASSAGE:
                        own += [(q - left, q - left + len(one[2])) for q in {seen[one], p}]
                if own:
                    a, b = np.array(own).T
                    rows += [(t1 ^ k, t1, t2, x, y, None) for k, (x, y) in enumerate(zip(*(z.tolist() for z in union(a[b - a >= LEAST], b[b - a >= LEAST])), strict=True))]
                    short = zip(*(z.tolist() for z in union(a, b)), strict=True)
                    rows += [(t1 ^ -k, t1, t2, x, min(x + LEAST - 1, y), None) for k, (start, y) in enumerate(short) for x in range(start, y, LEAST - 1)]
                if len(rows) > 20_000:
                    yield _record(rows)
                    rows = []
            if rows:
                yield _record(rows)

    return in_arrow(docs.select(*ID, "text", "hs"), scan, "h long, t1 long, t2 long, at long, left long, context binary")


def _record(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["h", "t1", "t2", "at", "left", "context"])


SPANS = "t1 long, t2 long, start long, stop long"


def _spans(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["t1", "t2", "start", "stop"])


def _sorted_spans(contexts: DataFrame) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int, int]] = []
        for group in groups(batches, 1):
            if group.num_rows:
                ids = list(zip(*(group.column(k).to_pylist() for k in (1, 2)), strict=True))
                ats, lefts, texts = (group.column(k).to_pylist() for k in (3, 4, 5))
                out += [(*ids[k], ats[k], lefts[k]) for k, c in enumerate(texts) if c is None]
                own = [k for k, c in enumerate(texts) if c is not None]
                found = maximal_repeats([texts[k][: lefts[k]][::-1] for k in own], [texts[k][lefts[k] :] for k in own])
                out += [(*ids[own[m]], ats[own[m]] - left, ats[own[m]] + right) for m, left, right in found]
            if len(out) > 20_000:
                yield _spans(out)
                out = []
        if out:
            yield _spans(out)

    dealt = contexts.repartition(parts(contexts.sparkSession), "h").sortWithinPartitions("h")
    return in_arrow(dealt, scan, SPANS)


def _counted_spans(docs: DataFrame) -> DataFrame:
    """docs (t1, t2, text, hs): the strings through anchors with very many occurrences, by their hashes' counts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t1, t2, text, hs in zip(*(c.to_pylist() for c in batch.columns[:2]), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3), strict=True):
                raw = np.frombuffer(text, np.uint8)
                at, hashes = anchors(raw, np.array([0, len(text)]))
                at = at[np.isin(hashes, hs.values.to_numpy(zero_copy_only=False).view(_U))]
                for width in (PASSAGE, LEAST):
                    if len(text) < width:
                        continue
                    wanted = np.zeros(len(text) - width + 2, np.int64)
                    np.add.at(wanted, np.maximum(0, at + GRAM - width), 1)
                    np.add.at(wanted, np.minimum(at + 1, len(wanted) - 1), -1)
                    starts = np.flatnonzero(np.cumsum(wanted)[:-1] > 0)
                    cols = [rolling(raw, width, k)[starts].view(np.int64) for k in (0, 1)] + [np.full(len(starts), x) for x in (t1, t2)] + [starts, starts + width]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, cols)], ["h", "h2", "t1", "t2", "start", "stop"])

    strings = in_arrow(docs.select(*ID, "text", "hs"), scan, "h long, h2 long, " + SPANS).withColumn("width", F.col("stop") - F.col("start"))
    again = strings.groupBy("h", "h2", "width").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return strings.join(again, ["h", "h2", "width"]).select(*ID, "start", "stop")


def _merged(spans: DataFrame) -> DataFrame:
    """t1, t2, spans, n_passage_bytes: the union of a text's spans of LEAST bytes as an array of (start, stop), and the bytes
    that all its spans cover; a text's own spans meet in one task."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, covered = [], []
            for starts, stops in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (x.values.to_numpy(zero_copy_only=False) for x in (starts, stops))
                covered.append(int(np.subtract(*union(a, b)[::-1]).sum()))
                a, b = union(a[b - a >= LEAST], b[b - a >= LEAST])
                out.append([{"start": x, "stop": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, kind), pa.array(covered, pa.int64())], ["t1", "t2", "spans", "covered"])

    listed = spans.groupBy(*ID).agg(F.collect_list("start").alias("a"), F.collect_list("stop").alias("b"))
    return in_arrow(listed, scan, "t1 long, t2 long, spans array<struct<start: long, stop: long>>, covered long")


def remove_repeats(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_bytes, has_passage, spans (start, stop in bytes) for every
    row of docs (doc_id, text). n_passage_bytes: covered by strings of PASSAGE bytes that also start elsewhere.

    A null text counts as empty. Texts that occur more than once are removed whole if they have LEAST bytes; so are
    repeated rows. One copy of each (by 128 bits of hash) meets the other texts. An empty table gives an empty result.
    """
    text = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2"))
    counts = cut(_anchor_counts(rows))
    # copies of a text count in times, which only chooses the way; two texts, or one that holds it twice, make an anchor
    again = counts.groupBy("h").agg(F.count("*").alias("times"), F.min("t1").alias("low"), F.max("t1").alias("high"), F.max("n").alias("n"))
    again = again.where("low < high or n > 1").select("h", "times")
    listed = counts.drop("n").join(again, "h").groupBy(*ID).agg(
        F.min("rep").alias("rep"),
        F.collect_set(F.when(F.col("times") <= group, F.col("h"))).alias("few"),
        F.collect_set(F.when(F.col("times") > group, F.col("h"))).alias("many"),
    )
    # by a difference, not an equality: that would become a key of the join, which then could not share the texts' exchange
    first = F.coalesce(F.col("doc_id") - F.col("rep") == 0, F.col("doc_id").isNull() & F.col("rep").isNull())
    met = rows.join(listed, ID).where(first)
    spans = _sorted_spans(_contexts(met.where(F.size("few") > 0).withColumnRenamed("few", "hs")))
    spans = spans.unionByName(_counted_spans(met.where(F.size("many") > 0).withColumnRenamed("many", "hs")))
    copies = rows.groupBy(*ID).agg(F.count("*").alias("n_copies")).where("n_copies > 1")
    size = F.octet_length("text").cast("long")
    none = F.expr("cast(array() as array<struct<start: long, stop: long>>)")
    out = rows.join(_merged(spans), ID, "left").join(copies, ID, "left").withColumn("n_bytes", size)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
    copied = F.coalesce(F.col("n_copies") > 1, F.lit(False))
    out = out.withColumn("spans", F.when(copied & (F.col("n_bytes") >= LEAST), whole).otherwise(F.coalesce("spans", none)))
    out = out.withColumn("n_passage_bytes", F.when(copied & (F.col("n_bytes") >= PASSAGE), F.col("n_bytes")).otherwise(F.coalesce("covered", F.lit(0))))
    out = out.withColumn("raw", F.col("text").cast("binary"))
    pieces = (
        "transform(sequence(0, size(spans)), k -> hex(substring(raw, cast(if(k = 0, 0L, spans[greatest(k - 1, 0)].stop) + 1 as int),"
        " cast(if(k = size(spans), n_bytes, spans[least(k, size(spans) - 1)].start) - if(k = 0, 0L, spans[greatest(k - 1, 0)].stop) as int))))"
    )
    kept = F.when(F.size("spans") == 0, F.col("raw")).otherwise(F.unhex(F.array_join(F.expr(pieces), "")))
    return out.select(
        "doc_id",
        "n_bytes",
        F.expr("aggregate(spans, 0L, (n, s) -> n + s.stop - s.start)").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2(kept, 256).alias("kept_sha256"),
        "n_passage_bytes",
        (F.col("n_passage_bytes") > 0).alias("has_passage"),
        "spans",
    )
