"""N-gram Jaccard join with signature trees (operator 8).

Documents with equal shingle sets are one set. Two sets with a Jaccard similarity of 3/4 or more share a shingle among
the first n - ceil(3n/4) + 1 of each, in any one order of all shingles; here shingles of very many documents come last,
the others go by hash. So sets meet in groups by a shingle of their prefixes. Groups with the same members are one.
In a group a signature tree over the members' bitmaps and sizes is joined with itself: pairs of nodes whose largest
possible overlap is too small are pruned. Large sets go by classes of size, with bitmaps as wide as their size asks for. What the groups leave possible falls into pieces; each piece gets its whole
sets, once, and a second tree join that verifies every pair it cannot prune or skip as linked already. Possible links
become pieces, and links components, by rounds of joins. Where numbers of links are asked for, the verified pass also counts
the overlaps of all pairs of a piece, in tiles, each pair in one pair of blocks only. Large groups and pieces are cut into blocks, each pair of
blocks a task; no pair is dropped.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tasklore.llm.common import cut, in_arrow, parts, text_or_empty
from tasklore.llm.grouping import connected_components, groups
from tasklore.llm.shingles import shingle_sets

#: Bits of the smallest bitmap. A set has the next power of two from SPREAD bits a shingle on: that prunes unrelated sets at any size.
BITS, SPREAD = 2048, 1.0
#: Sets up to this size have the smallest bitmap; above it, size classes grow by 4 / 3, the largest ratio of linked sets.
SMALL = int(BITS / SPREAD)
LEAF, FAN = 32, 8
#: Members of a block, and shingles of a block of whole sets: a task holds two blocks at most.
BLOCK, BLOCK_SHINGLES = 10_000, 2_000_000
#: A shingle is frequent, and comes last in the order, in more than this share of the sets (and more than LEAST of them).
#: At most 1 / SHARE times the mean set size of shingles are: that bounds what is broadcast, whatever the input.
SHARE, LEAST = 1 / 1000, 50
#: Members of a side of a tile whose pairs are counted at once, and shingles that are laid out for it at a time.
TILE, SLICE = 256, 8192
#: Hashes that a task holds to count frequent shingles.
HELD = 2_000_000


def set_id(hashes: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes()))))


def bitmap(hashes: np.ndarray, n_bits: int = BITS) -> bytes:
    bits = np.zeros(n_bits, bool)
    bits[(hashes >> np.uint64(20)) % np.uint64(n_bits)] = True
    return np.packbits(bits).tobytes()


def own_bits(n: int) -> int:
    return max(BITS, 1 << max(int(SPREAD * n) - 1, 0).bit_length())


def fine_bits(size: int, members: int) -> int:
    """Width of the bitmaps of whole sets: 16 bits a shingle of the largest, in at most 16 MB for all members."""
    return min(1 << (16 * size).bit_length(), 1 << (max(16 << 23, 1) // members).bit_length() - 1)


def size_class(n: Column) -> Column:
    """0 for small sets; sets of sizes that can link are of one class or of neighbouring ones."""
    return F.when(n <= SMALL, 0).otherwise(F.ceil(F.ln(n / SMALL) / F.lit(math.log(4 / 3)))).cast("int")


def prefix_length(n: int) -> int:
    return n - (3 * n + 3) // 4 + 1


def needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The overlap that makes sets of a and b shingles link: 100 x >= 75 (a + b - x)."""
    return (3 * (a + b) + 6) // 7


class SignatureTree:
    """Members in order of their bitmaps; leaves of LEAF members, FAN nodes a parent, each with its bitmaps OR-ed, its sizes'
    range and the largest surplus (shingles beyond one a bit) among its members."""

    def __init__(self, sizes: np.ndarray, maps: np.ndarray):
        self.order = np.lexsort((maps[:, 1], maps[:, 0], sizes))
        self.sizes, self.maps = sizes[self.order], maps[self.order]
        self.surplus = self.sizes - np.bitwise_count(self.maps).sum(1, dtype=np.int64)
        starts = np.arange(0, len(sizes), LEAF)
        level = [(np.bitwise_or.reduceat(self.maps, starts), np.minimum.reduceat(self.sizes, starts), np.maximum.reduceat(self.sizes, starts), np.maximum.reduceat(self.surplus, starts))]
        while len(level[-1][0]) > 1:
            maps_, low, high, over = level[-1]
            starts = np.arange(0, len(low), FAN)
            level.append((np.bitwise_or.reduceat(maps_, starts), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts), np.maximum.reduceat(over, starts)))
        self.levels = level

    def possible(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether members of nodes i and j of a level can overlap enough."""
        maps, low, high, over = self.levels[level]
        most = np.bitwise_count(maps[i] & maps[j]).sum(1, dtype=np.int64) + np.minimum(over[i], over[j])
        most = np.minimum(most, np.minimum(high[i], high[j]))
        return most >= needed(low[i], low[j])

    def leaf_pairs(self, one: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, int]]:
        """Pairs of leaves (i <= j) left by a traversal from (root, root); one(level, nodes) says which nodes belong to one
        component as a whole (its number, else -1), and pairs within one component are left out."""
        todo = [(len(self.levels) - 1, 0, 0)]
        while todo:
            level, i, j = todo.pop()
            if level == 0:
                yield i, j
                continue
            n = len(self.levels[level - 1][0])
            a, b = np.arange(i * FAN, min(n, i * FAN + FAN)), np.arange(j * FAN, min(n, j * FAN + FAN))
            a, b = np.repeat(a, len(b)), np.tile(b, len(a))
            if i == j:
                a, b = a[a <= b], b[a <= b]
            same = one(level - 1, a)
            ok = self.possible(level - 1, a, b) & ~((same >= 0) & (same == one(level - 1, b)))
            todo += [(level - 1, x, y) for x, y in zip(a[ok].tolist(), b[ok].tolist(), strict=True)]


def tree_components(
    sizes: np.ndarray, maps: np.ndarray, fine: np.ndarray | None = None, linked: Callable[[int, int], bool] | None = None
) -> np.ndarray:
    """The component of each member (the place of one of its members) under the pairs that bitmaps and sizes leave possible,
    that wider bitmaps (fine), if given, leave possible too, and that linked, if given, confirms. Pairs within a component
    are not compared again."""
    n = len(sizes)
    if n == 2:
        most = np.bitwise_count(maps[0] & maps[1]).sum(dtype=np.int64) + min(sizes[k] - np.bitwise_count(maps[k]).sum(dtype=np.int64) for k in (0, 1))
        near = min(most, sizes.min()) >= needed(sizes[0], sizes[1]) and (linked is None or linked(0, 1))
        return np.array([0, 0 if near else 1])
    tree = SignatureTree(sizes, maps)
    label = np.arange(n)  # of each member, in the tree's order
    wide = None if fine is None else fine[tree.order]
    over = None if wide is None else tree.sizes - np.bitwise_count(wide).sum(1, dtype=np.int64)

    def compare(xs: np.ndarray, ys: np.ndarray) -> bool:
        """All pairs of two short lists of members in different components."""
        x, y = np.nonzero(label[xs][:, None] != label[ys][None])
        x, y = xs[x], ys[y]
        if not len(x):
            return False
        least = needed(tree.sizes[x], tree.sizes[y])
        ok = np.bitwise_count(tree.maps[x] & tree.maps[y]).sum(1, dtype=np.int64) + np.minimum(tree.surplus[x], tree.surplus[y]) >= least
        ok &= np.minimum(tree.sizes[x], tree.sizes[y]) >= least
        x, y, least = x[ok], y[ok], least[ok]
        if wide is not None and len(x):
            ok = np.bitwise_count(wide[x] & wide[y]).sum(1, dtype=np.int64) + np.minimum(over[x], over[y]) >= least
            x, y = x[ok], y[ok]
        found = False
        while len(x):
            if linked is None or linked(int(tree.order[x[0]]), int(tree.order[y[0]])):
                label[label == label[y[0]]] = label[x[0]]
                found = True
                left = label[x] != label[y]
                x, y = x[left], y[left]
            else:
                x, y = x[1:], y[1:]
        return found

    leaf = lambda i: np.arange(i * LEAF, min(n, (i + 1) * LEAF))
    for i in range(len(tree.levels[0][0])):
        compare(leaf(i), leaf(i))
    heads = np.arange(0, n, LEAF)
    for k in range(0, len(heads), LEAF):  # leaves' first members against the first few: joins what is alike early
        compare(heads[k : k + LEAF], heads[:LEAF])
    whole: list[np.ndarray] = []

    def refresh() -> None:
        whole.clear()
        starts, low, high = np.arange(0, n, LEAF), label, label
        for _ in tree.levels:
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            whole.append(np.where(low == high, low, -1))
            starts = np.arange(0, len(low), FAN)

    refresh()
    for i, j in tree.leaf_pairs(lambda level, nodes: whole[level][nodes]):
        if i != j and compare(leaf(i), leaf(j)):
            refresh()
    out = np.empty(n, np.int64)
    out[tree.order] = tree.order[label]
    return out


def link_counts(sets: list[np.ndarray], weights: np.ndarray, blocks: np.ndarray, within: bool) -> np.ndarray:
    """For each set the weights of all others it links to, added up: exact overlaps of all pairs, or, unless within is set,
    of the pairs from different blocks only."""
    sizes = np.array([len(x) for x in sets])
    order = np.lexsort((np.array([x[0] for x in sets]), sizes))
    lengths = sizes[order]
    _, codes, met = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True, return_counts=True)
    shared = met > 1  # a shingle of one set is in no overlap
    starts = np.concatenate([[0], np.cumsum(lengths)])
    tiles = []
    for k in range(0, len(sets), TILE):
        stop = min(k + TILE, len(sets))
        own = codes[starts[k] : starts[stop]]
        row = np.repeat(np.arange(stop - k), lengths[k:stop])
        keep = shared[own]
        tiles.append((k, stop, own[keep].astype(np.int32), row[keep].astype(np.int16)))
    del codes
    out = np.zeros(len(sets), np.int64)
    weight, block = weights[order], blocks[order]
    place = np.full(len(met), -1, np.int32)

    def laid(codes: np.ndarray, rows: np.ndarray, n: int, at: int, width: int) -> np.ndarray:
        where = place[codes] - at
        ok = (where >= 0) & (where < width)
        laid = np.zeros((n, width), np.float32)
        laid[rows[ok], where[ok]] = 1
        return laid

    for i, (a, a_end, a_codes, a_rows) in enumerate(tiles):
        for b, b_end, b_codes, b_rows in tiles[i:]:
            if lengths[a_end - 1] < needed(lengths[a_end - 1], lengths[b]):  # in order of size: all the next are larger
                break
            both = np.intersect1d(np.unique(a_codes), np.unique(b_codes), assume_unique=True)
            place[both] = np.arange(len(both), dtype=np.int32)
            common = np.zeros((a_end - a, b_end - b), np.int64)
            for at in range(0, len(both), SLICE):
                width = min(SLICE, len(both) - at)
                common += (laid(a_codes, a_rows, a_end - a, at, width) @ laid(b_codes, b_rows, b_end - b, at, width).T).astype(np.int64)
            place[both] = -1
            links = common >= needed(lengths[a:a_end, None], lengths[None, b:b_end])
            if not within:
                links &= block[a:a_end, None] != block[None, b:b_end]
            if a == b:
                np.fill_diagonal(links, False)
            else:
                out[b:b_end] += weight[a:a_end] @ links
            out[a:a_end] += links @ weight[b:b_end]
    back = np.empty_like(out)
    back[order] = out
    return back


def _maps(column: pa.ChunkedArray) -> np.ndarray:
    """Bitmaps as rows, wider ones folded to the width of the narrowest: a bit there stands for several of theirs."""
    found = column.to_pylist()
    width = min(map(len, found))
    if any(len(x) > width for x in found):
        found = [np.bitwise_or.reduce(np.frombuffer(x, np.uint8).reshape(-1, width), 0).tobytes() if len(x) > width else x for x in found]
    return np.frombuffer(b"".join(found), np.uint64).reshape(len(found), -1)


def summaries(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n, sid (hash of its set), bits; and rows (kind 1) with shingles that a task saw in
    two sets or more: h, n."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "doc_id", "n", "sid", "bits", "h"]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        seen: set[int] = set()
        held: list[np.ndarray] = []

        def frequent() -> Iterator[pa.RecordBatch]:
            if held:
                found, counts = np.unique(np.concatenate(held), return_counts=True)
                found, counts = found[counts > 1].view(np.int64), counts[counts > 1]
                none = [None] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((np.ones(len(found), np.int32), none, counts, none, none, found), kinds, strict=True)], names)
                held.clear()

        for batch in batches:
            rows: list[tuple] = []
            for doc_id, own in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1)), strict=True):
                sid = set_id(own)
                rows.append((0, doc_id, len(own), sid, bitmap(own, own_bits(len(own))), None))
                if sid not in seen:
                    seen.add(sid)
                    held.append(own[: len(own) // 2 + 1])  # in order of hash: the half from which prefixes come
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            if sum(map(len, held)) > HELD:
                yield from frequent()
        yield from frequent()

    return in_arrow(docs.select(F.col("doc_id").cast("long"), text_or_empty()), scan, "kind int, doc_id long, n long, sid long, bits binary, h long")


def prefixes(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """h, sid: the prefix of every set that a task sees, once a task."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        last = shared.value
        for batch in batches:
            hs, sids = [], []
            for own in shingle_sets(batch.column(0)):
                if len(own) and (sid := set_id(own)) not in seen:
                    seen.add(sid)
                    if len(last):
                        late = last[np.minimum(np.searchsorted(last, own), len(last) - 1)] == own
                        own = np.concatenate([own[~late], own[late]])
                    hs.append(own[: prefix_length(len(own))])
                    sids.append(sid)
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.repeat(np.array(sids, np.int64), [len(x) for x in hs]))], ["h", "sid"])

    return in_arrow(docs.select(text_or_empty()), scan, "h long, sid long")


def _edges(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def possible_links(members: DataFrame) -> DataFrame:
    """members (g, k, x, y, sid, n, bits), a group for each (g, k, x, y) -> a, b: links that span each piece a group falls into."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for group in groups(batches, 4):
            own, first = np.unique(group.column("sid").to_numpy(), return_index=True)
            if len(own) < 2:
                continue
            group = group.take(first)
            roots = own[tree_components(group.column("n").to_numpy(), _maps(group.column("bits")))]
            if (roots != own).any():
                a.append(own[roots != own])
                b.append(roots[roots != own])
            if len(a) > 1000:
                yield _edges(a, b)
                a, b = [], []
        if a:
            yield _edges(a, b)

    dealt = members.repartition(parts(members.sparkSession), "g", "k", "x", "y").sortWithinPartitions("g", "k", "x", "y")
    return in_arrow(dealt.select("g", "k", "x", "y", "sid", "n", "bits"), join, "a long, b long")


def in_blocks(members: DataFrame, blocks: Column) -> DataFrame:
    """Adds own, the block of a member in its group of so many blocks, and x, y: the pairs of blocks that it takes part in."""
    members = members.withColumn("blocks", F.greatest(blocks, F.lit(1)).cast("int"))
    members = members.withColumn("own", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return members.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")}).drop("blocks", "other")


def whole_sets(docs: DataFrame) -> DataFrame:
    """docs (sid, text, cid, size, m) -> cid, size, sid, m, hashes, where the text has that set."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [x for x in shingle_sets(batch.column(1))]
            ok = [k for k, (sid, own) in enumerate(zip(batch.column(0).to_pylist(), sets, strict=True)) if sid == set_id(own)]
            rows = batch.take(pa.array(ok, pa.int64()))
            hashes = pa.array([sets[k].tobytes() for k in ok], pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column(2), rows.column(3), rows.column(0), rows.column(4), hashes], ["cid", "size", "sid", "m", "hashes"])

    return in_arrow(docs.select("sid", "text", "cid", "size", "m"), scan, "cid long, size long, sid long, m long, hashes binary")


def verified_links(clusters: DataFrame, counted: bool = False) -> DataFrame:
    """clusters (cid, x, y, sid, own, m, hashes) -> a, b, c: links that span what is linked within each (cid, x, y); and, if
    counted, rows without b: the documents c (m of each set) that the set a links to there, each pair in one (x, y) only."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 3):
            own, first = np.unique(group.column("sid").to_numpy(), return_index=True)
            if len(own) < 2:
                continue
            sets = [np.frombuffer(x, np.uint64) for x in group.column("hashes").take(pa.array(first)).to_pylist()]

            def linked(i: int, j: int, sets: list[np.ndarray] = sets) -> bool:
                a, b = sorted((sets[i], sets[j]), key=len)
                at = np.searchsorted(b, a)
                common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
                return 100 * common >= 75 * (len(a) + len(b) - common)

            sizes = np.array([len(x) for x in sets])
            maps = np.frombuffer(b"".join(bitmap(x) for x in sets), np.uint64).reshape(-1, BITS // 64)
            fine = None
            if len(own) > LEAF and (n_bits := fine_bits(int(sizes.max()), len(own))) > BITS:
                fine = np.frombuffer(b"".join(bitmap(x, n_bits) for x in sets), np.uint64).reshape(-1, n_bits // 64)
            roots = own[tree_components(sizes, maps, fine, linked)]
            if (roots != own).any():
                a, b = own[roots != own], roots[roots != own]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], ["a", "b", "c"])
            if counted:
                weights, blocks = (group.column(k).to_numpy()[first] for k in ("m", "own"))
                found = link_counts(sets, weights, blocks, group.column("x")[0] == group.column("y")[0])
                a = own[found > 0]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()), pa.array(found[found > 0])], ["a", "b", "c"])

    dealt = clusters.repartition(parts(clusters.sparkSession), "cid", "x", "y").sortWithinPartitions("cid", "x", "y")
    return in_arrow(dealt.select("cid", "x", "y", "sid", "own", "m", "hashes"), join, "a long, b long, c long")


def jaccard_components(
    docs: DataFrame, block: int = BLOCK, share: float = SHARE, least: int = LEAST, counted: bool = False, shingles: int = BLOCK_SHINGLES
) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text); if counted, also n_links: how many other rows
    it is linked to, equal sets included.

    Links are exact up to collisions of 64-bit hashes. A null text, or one without words, has 0 shingles and is a
    component by itself. A null doc_id counts as no number: its component_id is the smallest other one it is linked to,
    else null. Repeated rows give repeated results. An empty table gives an empty result.
    """
    found = cut(summaries(docs))
    rows = found.where("kind = 0").select("doc_id", "n", "sid", "bits")
    sets = rows.where("n > 0").groupBy("sid").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.min("doc_id").alias("rep"), F.count("*").alias("m"))
    limit = max(least, int(share * rows.count()))
    counts = found.where("kind = 1").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > limit)
    frequent = np.sort(np.array([r["h"] for r in counts.select("h").toLocalIterator()], np.int64).view(np.uint64))
    meet = Window.partitionBy("h")
    met = prefixes(docs, frequent).select(
        "h",
        "sid",
        F.min("sid").over(meet).alias("low"),
        F.max("sid").over(meet).alias("high"),
        F.count("*").over(meet).alias("n_members"),
        F.try_sum(F.shiftright(F.xxhash64("sid"), 24)).over(meet).alias("mark"),
    ).where("low < high")
    alike = Window.partitionBy("low", "high", "n_members", F.coalesce("mark", "h"))
    kept = met.withColumn("g", F.min("h").over(alike)).where("g = h").select("g", "sid", "n_members")
    members = in_blocks(kept.join(sets.select("sid", "n", "bits"), "sid"), F.ceil(F.col("n_members") / block))
    most = F.floor(4 * F.col("n") / 3)  # the largest set that one of n can link to
    members = members.withColumn("k", F.explode(F.sequence(size_class(F.col("n")), size_class(most))))
    pieces = connected_components(possible_links(members)).select(F.col("node").alias("sid"), F.col("root").alias("cid"))
    wanted = pieces.join(sets.select("sid", "rep", "m", "n"), "sid")
    blocks = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / shingles)).alias("size")
    wanted = wanted.join(wanted.groupBy("cid").agg(blocks), "cid")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    given = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["rep"])).select("sid", "text", "cid", "size", "m")
    links = verified_links(in_blocks(whole_sets(given), F.col("size")), counted)
    links = cut(links) if counted else links
    roots = connected_components(links.where("b is not null").select("a", "b"))
    placed = rows.select("doc_id", "n", "sid").join(roots.withColumnRenamed("node", "sid"), "sid", "left")
    placed = placed.withColumn("root", F.coalesce("root", "sid"))
    smallest = placed.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("smallest"))
    component = F.when(F.col("n") > 0, F.col("smallest")).otherwise(F.col("doc_id")).alias("component_id")
    out = placed.join(smallest, "root", "left")
    if not counted:
        return out.select("doc_id", F.col("n").alias("n_shingles"), component)
    others = links.where("c is not null").groupBy(F.col("a").alias("sid")).agg(F.sum("c").alias("c"))
    equal = sets.join(others, "sid", "left").select("sid", (F.col("m") - 1 + F.coalesce("c", F.lit(0))).alias("n_links"))
    out = out.join(equal, "sid", "left")
    n_links = F.when(F.col("n") > 0, F.col("n_links")).otherwise(0).cast("long").alias("n_links")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component, n_links)
