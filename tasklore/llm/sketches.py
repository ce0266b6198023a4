"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests (operator 9).

A text is cut into paragraphs (lines, and in long lines runs of sentences); each has a digest, the k-th repeat one of its
own. A sketch is a row of cells, each of (count, digests XOR-ed, checks XOR-ed), with every digest in three of them. Sizes
double from level to level and a smaller level is a larger one folded, so that a fingerprint stores one level only: the first
of which all digests can be peeled out. Two sketches subtract cell by cell at a small level, what they share cancels out,
and peeling cells with one digest recovers what differs; where that fails, the next larger level is taken, folded from what
is stored or, beyond it, rebuilt from the digests that the stored level gives back. Thus two fingerprints alone always
tell what differs. Likeness is the Jaccard similarity of the paragraphs that this gives.

Many sketches are handled at once: their cells stand one after another, and each step works on all of them.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasklore.llm.common import in_arrow, parts, text_or_empty

#: Cells of the smallest level; each next one has twice as many. Sketches never need RETRIES levels beyond the first with room:
#: two digests would have to share three places of more than 17 bits each.
SMALLEST, RETRIES = 9, 16
#: Characters from which on a sentence's end also ends a paragraph.
LONG = 80
SENTENCE = re.compile(r"(?<=[.!?])\s+")
_U = np.uint64
#: Odd multipliers; the upper half of a product gives a digest's place in each third of a level, and its check.
PLACES = np.array([[0xC2B2AE3D27D4EB4F], [0x165667B19E3779F9], [0xD6E8FEB86659FD93]], _U)
CHECK = _U(0x9E3779B97F4A7C15)
THIRDS = np.array([[0], [1], [2]])
#: Digests a cell beyond which peeling is hopeless (0.82 is the limit for large levels).
LOAD = 0.8


def paragraphs(text: str) -> list[str]:
    out = []
    for line in text.split("\n"):
        held = ""
        for sentence in SENTENCE.split(line):
            held = f"{held} {sentence}" if held else sentence
            if len(held) >= LONG:
                out.append(held)
                held = ""
        if held.strip():
            out.append(held)
    return out


def digests(text: str) -> np.ndarray:
    seen: dict[str, int] = {}
    out = np.empty(len(found := paragraphs(text)), _U)
    for k, one in enumerate(found):
        seen[one] = nth = seen.get(one, -1) + 1
        out[k] = xxhash.xxh3_64_intdigest(one.encode(), nth)
    return out


def checks_of(keys: np.ndarray) -> np.ndarray:
    return (keys * CHECK >> _U(32)).astype(np.uint32)


def level_for(n: np.ndarray) -> np.ndarray:
    """The smallest level with room for n digests."""
    return np.ceil(np.log2(np.maximum(n / (LOAD * SMALLEST), 1))).astype(np.int64)


def spans(lengths: np.ndarray) -> np.ndarray:
    """The index of the run that each element belongs to."""
    return np.repeat(np.arange(len(lengths)), lengths)


class Cells:
    """The cells of several sketches, the k-th at level levels[k]: counts, keys and checks (marks)."""

    def __init__(self, levels: np.ndarray, fields: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        self.levels, self.thirds = levels, (SMALLEST // 3) << levels
        self.starts = np.concatenate(([0], np.cumsum(3 * self.thirds)))
        total = int(self.starts[-1])
        self.counts, self.keys, self.marks = fields or (np.zeros(total, np.int64), np.zeros(total, _U), np.zeros(total, np.uint32))

    def add(self, at: np.ndarray, counts: np.ndarray, keys: np.ndarray, marks: np.ndarray) -> None:
        np.add.at(self.counts, at, counts)
        np.bitwise_xor.at(self.keys, at, keys)
        np.bitwise_xor.at(self.marks, at, marks)

    def places(self, keys: np.ndarray, whose: np.ndarray) -> np.ndarray:
        """The three cells of each digest: of all the first ones, then the second and the third."""
        third = self.thirds[whose]
        return ((keys * PLACES >> _U(32)).astype(np.int64) % third + THIRDS * third + self.starts[whose]).ravel()

    def insert(self, keys: np.ndarray, whose: np.ndarray, signs: np.ndarray) -> None:
        """Digests into the sketches whose; sign -1 takes them out of the count."""
        self.add(self.places(keys, whose), np.tile(signs, 3), np.tile(keys, 3), np.tile(checks_of(keys), 3))

    def take(self, which: np.ndarray) -> Cells:
        lengths = 3 * self.thirds[which]
        at = np.arange(lengths.sum()) + np.repeat(self.starts[which] - np.cumsum(lengths) + lengths, lengths)
        return Cells(self.levels[which], (self.counts[at], self.keys[at], self.marks[at]))

    def folded(self, levels: np.ndarray) -> Cells:
        """The same sketches at smaller levels (or their own)."""
        out, own = Cells(levels), spans(3 * self.thirds)
        third, place = np.divmod(np.arange(len(own)) - self.starts[own], self.thirds[own])
        out.add(out.starts[own] + third * out.thirds[own] + place % out.thirds[own], self.counts, self.keys, self.marks)
        return out

    def minus(self, other: Cells) -> Cells:
        return Cells(self.levels, (self.counts - other.counts, self.keys ^ other.keys, self.marks ^ other.marks))

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Digests, whose they are and their signs, and which sketches came out whole. The cells are used up.

        A round peels at least one digest a sketch that it goes on with, so there are at most as many rounds as cells.
        """
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at = np.arange(len(self.counts))
        for _ in range(len(self.counts)):
            at = at[np.abs(self.counts[at]) == 1]
            at = at[checks_of(self.keys[at]) == self.marks[at]]
            if not len(at):
                break
            whose = np.searchsorted(self.starts, at, "right") - 1
            order = np.lexsort((self.keys[at], whose))  # a digest may stand alone in two of its cells
            at, whose = at[order], whose[order]
            new = np.concatenate(([True], (whose[1:] != whose[:-1]) | (self.keys[at[1:]] != self.keys[at[:-1]])))
            keys, whose, signs = self.keys[at[new]], whose[new], self.counts[at[new]]
            self.insert(keys, whose, -signs)
            found.append((keys, whose, signs))
            at = np.unique(self.places(keys, whose))
        left = (self.counts != 0) | (self.keys != 0) | (self.marks != 0)
        whole = np.add.reduceat(left, self.starts[:-1]) == 0 if len(self.levels) else np.zeros(0, bool)
        keys, whose, signs = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (self.keys[:0], at[:0], self.counts[:0])
        return keys, whose, signs, whole


class Sketches:
    """Sketches of several texts: numbers of digests, and cells of which all of these can be peeled."""

    def __init__(self, n: np.ndarray, cells: Cells):
        self.n, self.cells = n, cells

    @classmethod
    def of(cls, texts: list[str]) -> Sketches:
        own = [np.unique(digests(x)) for x in texts]
        n = np.array([len(x) for x in own], np.int64)
        keys, whose, levels = np.concatenate([*own, np.empty(0, _U)]), spans(n), level_for(n)
        todo = np.arange(len(n))
        while True:  # until a level is found that gives back all digests, in a byte a count
            cells = Cells(levels)
            cells.insert(keys, whose, np.ones(len(keys), np.int64))
            tried = cells.take(todo)
            fits = np.maximum.reduceat(tried.counts, tried.starts[:-1]) <= 255 if len(todo) else np.zeros(0, bool)
            todo = todo[~(tried.peel()[3] & fits)]
            if not len(todo):
                return cls(n, cells)
            levels[todo] += 1
            if (levels > level_for(n) + RETRIES).any():
                raise ArithmeticError("two digests fall into the same cells of all levels")

    def take(self, which: np.ndarray) -> Sketches:
        return Sketches(self.n[which], self.cells.take(which))

    def encode(self) -> list[str]:
        out, c = [], self.cells
        for k, (n, level) in enumerate(zip(self.n.tolist(), c.levels.tolist(), strict=True)):
            own = slice(c.starts[k], c.starts[k + 1])
            fields = c.counts[own].astype("u1").tobytes() + c.keys[own].astype("<u8").tobytes() + c.marks[own].astype("<u4").tobytes()
            out.append(base64.b64encode(n.to_bytes(4, "little") + bytes([level]) + fields).decode())
        return out

    @classmethod
    def decode(cls, fingerprints: list[str]) -> Sketches:
        n, levels, fields = [], [], ([], [], [])
        for raw in map(base64.b64decode, fingerprints):
            n.append(int.from_bytes(raw[:4], "little"))
            levels.append(raw[4])
            size, at = SMALLEST << raw[4], 5
            for field, kind in zip(fields, ("u1", "<u8", "<u4"), strict=True):
                field.append(np.frombuffer(raw, kind, size, at))
                at += size * field[-1].itemsize
        counts, keys, marks = (np.concatenate([*x, np.empty(0, t)]).astype(t) for x, t in zip(fields, (np.int64, _U, np.uint32), strict=True))
        return cls(np.array(n, np.int64), Cells(np.array(levels, np.int64), (counts, keys, marks)))

    def at(self, levels: np.ndarray) -> Cells:
        """The cells at given levels: folded where these are smaller than what is held, else made from the digests it gives back."""
        small = np.minimum(levels, self.cells.levels)
        out = self.cells.folded(small)
        if (grown := np.flatnonzero(levels > small)).size:
            keys, whose, signs, _ = self.cells.take(grown).peel()
            larger, kept = Cells(levels), np.flatnonzero(levels == small)
            larger.insert(keys, grown[whose], signs)
            held, lengths = out.take(kept), 3 * out.thirds[kept]
            to = np.arange(lengths.sum()) + np.repeat(larger.starts[kept] - np.cumsum(lengths) + lengths, lengths)
            larger.add(to, held.counts, held.keys, held.marks)
            return larger
        return out

    def differences(self, other: Sketches) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Digests of one sketch of a pair alone, which pair, and 1 for those of this side, -1 for the other's.

        Each pair starts at a level with room for the least difference that its numbers of digests allow.
        """
        levels, todo, found = level_for(np.abs(self.n - other.n)), np.arange(len(self.n)), []
        while len(todo):
            keys, whose, signs, whole = self.take(todo).at(levels).minus(other.take(todo).at(levels)).peel()
            done = whole[whose]
            found.append((keys[done], todo[whose[done]], signs[done]))
            todo, levels = todo[~whole], levels[~whole] + 1
            if (levels > level_for(self.n + other.n)[todo] + RETRIES).any():
                raise ArithmeticError("two digests fall into the same cells of all levels")
        keys, pair, signs = zip(*found, strict=True) if found else ([np.empty(0, _U)], [np.empty(0, np.int64)], [np.empty(0, np.int64)])
        return np.concatenate(keys), np.concatenate(pair), np.concatenate(signs)

    def likenesses(self, other: Sketches) -> np.ndarray:
        """Shared paragraphs over all of both, for each pair; 1 for two without any."""
        _, pair, signs = self.differences(other)
        union = self.n + np.bincount(pair[signs < 0], minlength=len(self.n))
        shared = self.n - np.bincount(pair[signs > 0], minlength=len(self.n))
        return np.where(union > 0, shared / np.maximum(union, 1), 1.0)


def likeness(fingerprint: str, other: str) -> float:
    """The likeness of two stored fingerprints, from these alone."""
    return float(Sketches.decode([fingerprint]).likenesses(Sketches.decode([other]))[0])


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) dealt into ranges of doc_id and sorted: bucket, guest, doc_id, text.

    In a bucket, a task each, the rows stand by descending doc_id (null last; then by the text's hash), and after them, as
    guest 1, the first row of the next bucket that has any, or of the first bucket after the last. A number for each bucket
    reaches the driver.
    """
    n = max(1, parts(docs.sparkSession))
    edges = np.array(sorted(set(docs.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.2 / n))) if n > 1 else [], np.float64)
    place = lambda ids: np.where(np.isnan(ids), 0, np.searchsorted(edges, ids, "left") + 1)

    @F.pandas_udf("int")
    def bucket_of(ids: pd.Series) -> pd.Series:
        return pd.Series(place(ids.to_numpy(np.float64, na_value=np.nan)))

    tops = docs.select("doc_id", bucket_of("doc_id").alias("bucket")).groupBy("bucket").agg(F.max("doc_id").alias("top"))
    heads = sorted(((r["bucket"], r["top"]) for r in tops.collect()), reverse=True)
    following = zip(heads, heads[1:] + heads[:1], strict=True)
    guest_of = {top: target for (target, _), (_, top) in following}

    @F.pandas_udf("array<int>")
    def buckets_of(ids: pd.Series) -> pd.Series:
        own = place(ids.to_numpy(np.float64, na_value=np.nan))
        exact = [None if pd.isna(x) else int(x) for x in ids]
        return pd.Series([[int(b), guest_of[x]] if x in guest_of else [int(b)] for b, x in zip(own, exact, strict=True)])

    both = docs.select("doc_id", "text", F.posexplode(buckets_of("doc_id")).alias("guest", "bucket")).withColumn("mark", F.xxhash64("text"))
    order = ["bucket", "guest", F.col("doc_id").desc_nulls_last(), "mark"]
    return both.repartitionById(max(n, len(edges) + 2), "bucket").sortWithinPartitions(*order).select("bucket", "guest", "doc_id", "text")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


#: Most characters and rows whose sketches are made at a time.
AT_ONCE, ROWS = 2 << 20, 500


def fingerprint_versions(docs: DataFrame) -> DataFrame:
    """The fingerprint of every text of docs (doc_id, text), of its edited text, and their likenesses (see RESULT).

    The edited text has its last n // 2 characters replaced by the first as many of the next document's, by descending
    doc_id. Likenesses come from the fingerprints alone, as likeness() gives them. A null text is empty: it has no
    paragraphs. Repeated rows follow one another. A document without another one is its own next. Texts of any length are
    taken whole; their fingerprints grow with the number of paragraphs. An empty table gives an empty result.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append(row)
                held += len(row[3])
                if len(rows) > 1 and (len(rows) > ROWS or held > AT_ONCE):
                    yield _versions(rows)
                    rows, held = rows[-1:], len(row[3])
        if len(rows) > 1:
            yield _versions(rows)

    rows = with_next(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")))
    return in_arrow(rows, scan, RESULT)


def _versions(rows: list[tuple]) -> pa.RecordBatch:
    """The results of all rows (bucket, guest, doc_id, text) that are followed by one of their bucket and no guests themselves."""
    own = [k for k in range(len(rows) - 1) if rows[k][0] == rows[k + 1][0] and not rows[k][1]]
    texts = [x[3] for x in rows]
    edited = [texts[k][: len(texts[k]) - len(texts[k]) // 2] + texts[k + 1][: len(texts[k]) // 2] for k in own]
    at, given, new = np.array(own, np.int64), Sketches.of(texts), Sketches.of(edited)
    mine, following = given.take(at), given.take(at + 1)
    ids, lengths = [rows[k][2] for k in own], [len(texts[k]) for k in own]
    shas = [hashlib.sha256(x.encode()).hexdigest() for x in edited]
    columns = (ids, lengths, shas, mine.encode(), new.encode(), mine.likenesses(new), mine.likenesses(following))
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in RESULT.split(", ")])
