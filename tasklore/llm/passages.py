"""Removal of repeated passages of words by prefix-partitioned sparse suffix trees (operator 11).

Every window of LEAST words holds an anchor: a place whose GRAM words hash least among those of the window, so that equal
windows have their anchors at equal places. Suffixes start at anchors, each with the words of its windows before and after
(its context). They are split by prefixes of variable length. A prefix is the anchor's GRAM words where a task can hold its
suffixes; where there are more, equal contexts first become one suffix, and if these are still too many, they are split by
all LEAST words of each window, a prefix so long that its suffixes share one deep node. A prefix found once is dropped before
any text moves. A task builds the suffix tree of each of its prefixes, inserting suffixes in document order: what a suffix
meets on its way down starts earlier. Each place of the tree keeps the left contexts met there, so a suffix learns how far it
repeats an earlier one to both sides, which is what the tree's deep internal nodes and the diversity of their left contexts
say. Prefixes of LEAST words need no tree: their node's earliest leaf is a minimum, taken in Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasklore.llm.common import in_arrow, parts, text_or_empty
from tasklore.llm.grouping import groups
from tasklore.llm.shingles import SPACE, buffer_of, chunks, mix, powers
from tasklore.llm.substrings import sliding, union
from tasklore.llm.wordscan import places

#: Words of a window that is removed where it repeats, and of the prefixes that split the suffixes.
LEAST, GRAM = 20, 6
SPAN = LEAST - GRAM + 1
#: Suffixes of one prefix that a task makes a tree of.
GROUP = 16_384
_U = np.uint64
_ID = ["doc", "t1", "t2"]
_ROWS = 20_000
_INDEX = np.arange(LEAST, dtype=_U)
_STEPS = [mix((_INDEX + _U(1)) * _U(k)) | _U(1) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and edges of the words of texts laid end to end, and a hash of every word."""
    inside = ~SPACE[raw]
    starts, ends, edges = places(inside, offsets)
    if not len(starts):
        return starts, ends, edges, np.empty(0, _U)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    sums = np.add.reduceat((raw[inside].astype(_U) + _U(1)) * powers(int(lengths.max()))[place], first)
    return starts, ends, edges, mix(sums + lengths.astype(_U))


def run_hashes(words: np.ndarray, n: int, kind: int = 0) -> np.ndarray:
    """A hash of words[i:i + n] for every i."""
    size = max(len(words) - n + 1, 0)
    out = np.zeros(size, _U)
    for k in range(n):
        out += words[k : k + size] * _STEPS[kind][k]
    return mix(out)


def anchors(words: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in words) and hashes of the anchors of texts laid end to end."""
    begins = np.zeros(len(words) + 1, np.int32)  # 1 where a window starts
    long = np.diff(edges) >= LEAST
    if not long.any():
        return np.empty(0, np.int64), np.empty(0, _U)
    np.add.at(begins, edges[:-1][long], 1)
    np.add.at(begins, edges[1:][long] - LEAST + 1, -1)
    grams = run_hashes(words, GRAM)
    least = sliding(grams, SPAN, np.minimum, 2**64 - 1)
    least = np.where(np.cumsum(begins)[: len(grams)] > 0, least, _U(0))
    reach = sliding(least[::-1], SPAN, np.maximum, 0)[::-1]  # the largest of the windows that hold a place
    at = np.flatnonzero(reach == grams)
    return at, grams[at]


class Node:
    """A place of a suffix tree: the words on the edge to it, the left contexts met at each of them, and what follows.

    lefts[i] holds the left contexts, as far as a window ending after word i reaches, of the suffixes that came by; an edge
    that only one suffix took has that suffix's whole left context in `only` instead.
    """

    __slots__ = ("kids", "label", "lefts", "only")

    def __init__(self, label: list[bytes], lefts: list[set] | None, only: list[bytes] | None):
        self.label, self.lefts, self.only, self.kids = label, lefts, only, {}


def _met(depth: int, label: list[bytes], left: list[bytes]) -> list[set]:
    """The sets of an edge that one suffix took; depth: words above the edge."""
    return [{tuple(left[:o])} if 0 <= (o := LEAST - depth - i - 1) <= len(left) else set() for i in range(len(label))]


def insert(root: Node, left: list[bytes], right: list[bytes]) -> tuple[int, int]:
    """Adds a suffix (its words, and those before it, nearest first) to the tree; how many words to the left and right of its
    start are covered by windows that it shares with suffixes added before, (0, 0) for none."""
    node, depth, far_left, far_right = root, 0, -1, 0
    while depth < len(right):
        kid = node.kids.get(right[depth])
        if kid is None:
            node.kids[right[depth]] = Node(right[depth:], None, left)
            break
        label = kid.label
        n, most = 1, min(len(label), len(right) - depth)
        while n < most and label[n] == right[depth + n]:
            n += 1
        if n < len(label):  # the edge is cut after n words
            rest = Node(label[n:], kid.lefts and kid.lefts[n:], kid.only)
            rest.kids = kid.kids
            kid.label, kid.kids = label[:n], {label[n]: rest}
            kid.lefts = kid.lefts and kid.lefts[:n]
        if kid.lefts is None:
            kid.lefts, kid.only = _met(depth, kid.label, kid.only), None
        for i in range(n):
            o = LEAST - depth - i - 1
            if 0 <= o <= len(left):
                own = tuple(left[:o])
                if own in kid.lefts[i]:
                    far_left, far_right = max(far_left, o), max(far_right, LEAST - o)
                else:
                    kid.lefts[i].add(own)
        node, depth = kid, depth + n
    return (0, 0) if far_left < 0 else (far_left, far_right)


def repeats(members: list[tuple[list[bytes], list[bytes]]]) -> list[tuple[int, int]]:
    """For suffixes of one prefix, (left, right) words each, in order of their places: the reach of insert, for each."""
    root = Node([], [], None)
    return [insert(root, left, right) for left, right in members]


def _prefixes(texts: DataFrame) -> DataFrame:
    """texts (doc, t1, t2, text) -> h, t1, t2, n: how often each prefix of GRAM words starts a suffix of a text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffer_of(batch.column(3))
            for a, b in chunks(offsets):
                _, _, edges, words = word_hashes(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                at, hashes = anchors(words, edges)
                if not len(at):
                    continue
                doc = np.searchsorted(edges, at, "right") - 1
                order = np.lexsort((hashes, doc))
                doc, hashes = doc[order], hashes[order]
                first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])))
                rows = pa.array(doc[first] + a)
                own = [batch.column(k).take(rows) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays([pa.array(hashes[first].view(np.int64)), *own, pa.array(np.diff(np.append(first, len(doc))))], ["h", "t1", "t2", "n"])

    return in_arrow(texts, scan, "h long, t1 long, t2 long, n long")


def _wanted(column: pa.Array, a: int, b: int) -> np.ndarray:
    """The hashes that a list column names for rows a to b, each mixed with its row."""
    own = column.slice(a, b - a)
    row = np.repeat(np.arange(b - a, dtype=_U), np.diff(own.offsets.to_numpy()))
    return own.flatten().to_numpy(zero_copy_only=False).view(_U) ^ mix(row + _U(1))


def _suffixes(met: DataFrame) -> DataFrame:
    """met (doc, t1, t2, text, hs) -> h, doc, t1, t2, at, n_left, context: the suffixes of the prefixes that hs names.

    A context that a text holds again is not a suffix more: rows without a context, under any h, tell what such repeats cover,
    from at to n_left.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffer_of(batch.column(3))
            ids = [batch.column(k) for k in range(3)]
            for a, b in chunks(offsets):
                piece = raw[offsets[a] : offsets[b]]
                starts, ends, edges, words = word_hashes(piece, offsets[a : b + 1] - offsets[a])
                at, hashes = anchors(words, edges)
                doc = np.searchsorted(edges, at, "right") - 1
                mixed = hashes ^ mix(doc.astype(_U) + _U(1))
                ok = np.isin(mixed, _wanted(batch.column(4), a, b))
                at, hashes, doc, mixed = at[ok], hashes[ok], doc[ok], mixed[ok]
                low, high = np.maximum(edges[doc], at - (LEAST - GRAM)), np.minimum(edges[doc + 1], at + LEAST)
                data = piece.tobytes()
                _, which, n = np.unique(mixed, return_inverse=True, return_counts=True)
                again = n[which] > 1  # only these can repeat in their text
                for x in range(0, len(at), _ROWS):
                    y = slice(x, x + _ROWS)
                    context = [data[p:q] for p, q in zip(starts[low[y]].tolist(), ends[high[y] - 1].tolist(), strict=True)]
                    rows = pa.array(doc[y] + a)
                    cols = [pa.array(hashes[y].view(np.int64)), *[c.take(rows) for c in ids], pa.array(at[y] - edges[doc[y]]), pa.array(at[y] - low[y])]
                    out = pa.RecordBatch.from_arrays([*cols, pa.array(context, pa.binary())], _SUFFIX)
                    yield out.filter(pa.array(~again[y]))
                if again.any():
                    yield from _once(np.flatnonzero(again), data, starts, ends, edges, at, hashes, doc, low, high, ids, a)

    return in_arrow(met, scan, "h long, doc long, t1 long, t2 long, at long, n_left long, context binary")


_SUFFIX = ["h", *_ID, "at", "n_left", "context"]


def _once(rows, data, starts, ends, edges, at, hashes, doc, low, high, ids, a) -> Iterator[pa.RecordBatch]:
    """The rows' suffixes without those that their text held before, and the spans of the latter."""
    seen: set[tuple] = set()
    first, spans = [], {}
    for k in rows.tolist():
        context = data[starts[low[k]] : ends[high[k] - 1]]
        one = int(doc[k]), int(hashes[k]), int(at[k] - low[k]), b" ".join(context.split())
        if one in seen:
            spans.setdefault(one[0], []).append((int(low[k] - edges[doc[k]]), int(high[k] - edges[doc[k]])))
        else:
            seen.add(one)
            first.append((k, context))
    kept = np.array([k for k, _ in first], np.int64)
    own = pa.array(doc[kept] + a)
    cols = [pa.array(hashes[kept].view(np.int64)), *[c.take(own) for c in ids], pa.array(at[kept] - edges[doc[kept]]), pa.array(at[kept] - low[kept])]
    yield pa.RecordBatch.from_arrays([*cols, pa.array([c for _, c in first], pa.binary())], _SUFFIX)
    for d, found in spans.items():
        x, y = union(*np.array(found).T)
        own = pa.array(np.full(len(x), d + a))
        t1 = ids[1].take(own)
        yield pa.RecordBatch.from_arrays([t1, ids[0].take(own), t1, ids[2].take(own), pa.array(x), pa.array(y), pa.nulls(len(x), pa.binary())], _SUFFIX)


_SPANS = "t1 long, t2 long, start long, stop long"


def _tree_spans(suffixes: DataFrame) -> DataFrame:
    """t1, t2, start, stop (words): what the suffixes of each prefix repeat of earlier ones; a prefix is in one task."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int, int]] = []
        for group in groups(batches, 1):
            t1, t2, at, n_left, context = (group.column(k).to_pylist() for k in range(2, 7))
            rows, members = [], []
            for k, (n, c) in enumerate(zip(n_left, context, strict=True)):
                if c is None:
                    out.append((t1[k], t2[k], at[k], n))
                else:
                    words = c.split()
                    rows.append(k)
                    members.append((words[:n][::-1], words[n:]))
            if len(members) > 1:
                out += [(t1[k], t2[k], at[k] - left, at[k] + right) for k, (left, right) in zip(rows, repeats(members), strict=True) if right]
            if len(out) > _ROWS:
                yield _spans(out)
                out = []
        if out:
            yield _spans(out)

    dealt = suffixes.repartition(parts(suffixes.sparkSession), "h").sortWithinPartitions("h", *_ID, "at")
    return in_arrow(dealt, scan, _SPANS)


def _spans(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["t1", "t2", "start", "stop"])


def _classes(suffixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Suffixes with their own context's earliest place: (spans of all but the earliest of equal contexts, the earliest ones).

    Equal contexts hold the same windows, so the later ones are covered whole. The minimum is taken in each task before rows
    meet, and the join's keys can be split. Every use reads all columns, so that all share the exchange of the suffixes.
    """
    words = F.col("context").cast("string")
    mark = F.coalesce(words, F.concat_ws(" ", "t1", "at"))  # rows without a context stay apart
    marked = suffixes.withColumns({"c1": F.xxhash64("n_left", mark), "c2": F.xxhash64(F.lit(7), "n_left", mark), "place": F.struct(*_ID, "at", "h")})
    first = marked.groupBy("c1", "c2").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = marked.join(first, ["c1", "c2"], "left").withColumn("later", F.coalesce(F.col("place") != F.col("first"), F.lit(False)) & F.col("context").isNotNull())
    n_words = F.size(F.split(F.trim(F.regexp_replace(words, r"[\x20\x09-\x0D]+", " ")), " "))
    later = joined.where("later").select("t1", "t2", (F.col("at") - F.col("n_left")).alias("start"), (F.col("at") - F.col("n_left") + n_words).alias("stop"))
    return later, joined.where("not later").select(*_SUFFIX)


def _window_spans(suffixes: DataFrame) -> DataFrame:
    """As _tree_spans, for prefixes whose contexts are too many for a task: split by all LEAST words of each window that the
    suffixes stand for, and every window but the earliest of equal ones is a span."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, digests = [], [], []
            for k, (at, n_left, context) in enumerate(zip(*(batch.column(c).to_pylist() for c in (4, 5, 6)), strict=True)):
                words = context.split()
                for x in range(max(0, n_left - (LEAST - GRAM)), min(n_left, len(words) - LEAST) + 1):
                    rows.append(k)
                    starts.append(at - n_left + x)
                    digests.append(hashlib.blake2b(b" ".join(words[x : x + LEAST]), digest_size=16).digest())
            pairs = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            own = pa.array(rows, pa.int64())
            cols = [pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), *[batch.column(k).take(own) for k in (1, 2, 3)], pa.array(starts, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["g1", "g2", *_ID, "at"])

    windows = in_arrow(suffixes, scan, "g1 long, g2 long, doc long, t1 long, t2 long, at long").withColumn("place", F.struct(*_ID, "at"))
    first = windows.groupBy("g1", "g2").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = windows.join(first, ["g1", "g2"]).where("place <> first")
    return later.select("t1", "t2", F.col("at").alias("start"), (F.col("at") + LEAST).alias("stop"))


def _kept(texts: DataFrame) -> DataFrame:
    """texts (doc, t1, t2, text, found: list of start, stop) -> doc, t1, t2, n_words, n_removed, kept_sha256, spans."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            n_words, n_removed, digests, spans = [], [], [], []
            for text, found in zip(batch.column(3).cast(pa.binary()), batch.column(4).to_pylist(), strict=True):
                words = text.as_py().split()
                a, b = union(*(np.array([s[c] for s in found or ()], np.int64) for c in ("start", "stop")))
                kept, last = [], 0
                for start, stop in zip(a.tolist(), b.tolist(), strict=True):
                    kept += words[last:start]
                    last = stop
                kept += words[last:]
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                spans.append([{"start": x, "stop": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
            cols = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *cols], [*_ID, "n_words", "n_removed", "kept_sha256", "spans"])

    schema = "doc long, t1 long, t2 long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start: long, stop: long>>"
    return in_arrow(texts.select(*_ID, "text", "found"), scan, schema)


def remove_passages(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans (start, stop in words) for every row of docs (doc_id, text).

    Words covered by a window of LEAST words that also starts earlier go. A null text has no words. Null doc_ids come first;
    rows with equal doc_ids and other texts come in the order of their texts' hashes; a row repeated with its doc_id counts as
    one document, and each gets the same result. Of equal texts the first is compared with the others, and the rest lose all
    words if they have LEAST. Very long texts are whole. An empty table gives an empty result. Other columns are ignored.
    """
    text = text_or_empty()
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc.alias("doc"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2"), text.alias("text"))
    # every use below reads all columns of texts, so that all share its exchange
    texts = rows.groupBy("t1", "t2").agg(F.min("doc").alias("doc"), F.first("text").alias("text")).select(*_ID, "text")
    counts = _prefixes(texts)
    again = counts.groupBy("h").agg(F.sum("n").alias("times")).where("times > 1")
    listed = counts.drop("n").join(again, "h").groupBy("t1", "t2").agg(
        F.collect_set(F.when(F.col("times") <= group, F.col("h"))).alias("few"),
        F.collect_set(F.when(F.col("times") > group, F.col("h"))).alias("many"),
    )
    met = texts.join(listed, ["t1", "t2"])
    many = _suffixes(met.where(F.size("many") > 0).select(*_ID, "text", "many")).repartition(parts(docs.sparkSession), "t1", "at")
    later, classes = _classes(many)
    wide = classes.where("context is not null").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > group).select("h")
    slim = classes.join(wide, "h", "left_anti").select(*_SUFFIX)
    spans = _tree_spans(_suffixes(met.where(F.size("few") > 0).select(*_ID, "text", "few")).unionByName(slim)).unionByName(later)
    spans = spans.unionByName(_window_spans(classes.where("context is not null").join(wide, "h", "left_semi").select(*_SUFFIX)))
    found = spans.groupBy("t1", "t2").agg(F.collect_list(F.struct("start", "stop")).alias("found"))
    kept = _kept(texts.join(found, ["t1", "t2"], "left")).withColumnRenamed("doc", "first")
    out = rows.drop("text").join(kept, ["t1", "t2"])
    copy = (F.col("doc") != F.col("first")) & (F.col("n_words") >= LEAST)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("stop")))
    return out.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(copy, whole).otherwise(F.col("spans")).alias("spans"),
    )
