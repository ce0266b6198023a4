"""Best-fit decreasing packing of tokenized documents with a segment tree over remaining capacities (operator 10).

A document is cut into pieces of `capacity` tokens, the first of which takes what is over. Full pieces fill a sequence
each. The others are dealt by a random hash into groups of about GROUP pieces; each group packs its pieces in one task,
longest first, each into the open sequence with the least room that holds it. A group wastes at most about one
sequence more than packing all pieces together would, of thousands.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasklore.llm.common import cut, in_arrow, parts

GROUP = 50_000
END_ID = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class OpenBins:
    """Bins by remaining capacity, 0 to `capacity`: a segment tree of how many bins stand at each capacity."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, bin_id: int) -> None:
        self.bins[room].append(bin_id)
        at = room + self.leaves
        while at:
            self.tree[at] += 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The bin with the least room that is at least `least`: (room, bin), removed from the tree."""
        at = least + self.leaves
        while not self.tree[at]:
            while at & 1:  # a right child: nothing further right below this parent
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at *= 2
            if not self.tree[at]:
                at += 1
        room = at - self.leaves
        while at:
            self.tree[at] -= 1
            at >>= 1
        return room, self.bins[room].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, in the order given."""
    bins, offsets, n_bins, open_bins = np.empty(len(lengths), "int64"), np.empty(len(lengths), "int64"), 0, OpenBins(capacity)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        if (found := open_bins.take(need)) is None:
            found = capacity, n_bins
            n_bins += 1
        room, bins[i] = found
        offsets[i] = capacity - room
        open_bins.put(room - need, found[1])
    return bins, offsets


@functools.cache
def encoder(json_path: str, ranks_path: str):
    """text -> ids as uint32. The ranks hold the same vocabulary as the JSON file and give the same ids several times as
    fast; texts that hold a special token's string go to the JSON file's tokenizer."""
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = Tokenizer.from_file(json_path)

    def encode(text: str) -> np.ndarray:
        if "<|endoftext|>" in text:
            return np.array(whole.encode(text, add_special_tokens=False).ids, "<u4")
        return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), "<u4")

    return encode


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def token_pieces(docs: DataFrame, capacity: int = 1024, paths: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of docs (doc_id, text)."""
    own = paths

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*(own or tokenizer_paths()))
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                first = len(ids) % capacity or min(capacity, len(ids))
                edges = [0, *range(first, len(ids) + 1, capacity)]
                raw = ids.tobytes()
                out += [(doc_id, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
            kinds = (("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], [n for n, _ in kinds])

    return in_arrow(docs.select(F.col("doc_id").cast("long"), "text"), cut_up, PIECES)


def pack_best_fit(docs: DataFrame, capacity: int = 1024, paths: tuple[str, str] | None = None, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of docs (doc_id, text).

    A null or empty text is a piece of the end id alone. A null doc_id stays null. Repeated rows are packed each.
    An empty table gives an empty result. Equal lengths keep no order among them.
    """
    pieces = cut(token_pieces(docs, capacity, paths)).withColumn("row", F.monotonically_increasing_id())
    full = pieces.where(F.col("length") == capacity).select(
        *(c.split()[0] for c in PIECES.split(", ")), (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = pieces.where(F.col("length") < capacity)
    n_groups = max(1, math.ceil(rest.count() / group))
    dealt = rest.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(n_groups))).repartition(min(n_groups, max(parts(docs.sparkSession), 1)), "group")

    def pack(pieces: pd.DataFrame) -> pd.DataFrame:
        bins, offsets = best_fit_decreasing(pieces["length"].to_numpy(), capacity)
        ids = (int(pieces["group"].iloc[0]) << 32) + bins
        return pieces.drop(columns=["row", "group"]).assign(sequence_id=ids, offset=offsets)

    return full.unionByName(dealt.groupBy("group").applyInPandas(pack, PIECES + ", sequence_id long, offset long"))
