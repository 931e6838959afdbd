"""N-gram Jaccard join by count-vector R-trees.

A document is its set of distinct shingles (3 words unless given).  Shingles are hashed into
groups and the counts per group make the document a point; the overlap of
two sets is at most the sum of the coordinate minima, so a pair (or a pair
of R-tree boxes, by their upper corners) whose sum is too small for the
wanted similarity is dropped unseen.  What survives is verified on the
texts' shingles.

Equal sets are one class from the start.  The points are dealt to trees by
content cells that lose no link: with similarity at least t, two sets of at
most m shingles differ in at most D = 2 m (1 - t) / (1 + t) shingles, so among
more than D groups at least one has the same content in both.  Each set
enters the cell of each group's content.  Cells with the same smallest member
(their hub) share a tree over all their members, in blocks.  Every candidate
pair comes out of these trees: first each is searched with its hub's point,
which settles nearly all; one whose members are then still in several
components is joined with itself, in rounds.  A round verifies the next few
of each member's candidates across components, likest first, so that its pairs
are a bounded number per member, and a group of near copies has mostly grown
together before the later ones come up; rounds end when no tree has a
candidate left whose members are apart.  Cells of one member are kept out of
the shuffle by a bitmap of the counters that at least two cells have met in.

Defined results: ASCII letters are lower-cased and words are runs of
anything but ASCII white space; texts with fewer words than a shingle have that
whole sequence as their only shingle; null, empty and blank texts have an empty
set and link with nothing; a null id takes part like any other but has no
component of its own (its component_id is the smallest id in reach, or
null); repeated rows share a component; an empty table gives no rows; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import itertools
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tabmill.llm.common import arrow_rows, components, is_set, located, pick, twice_bits
from tabmill.session import cut_lineage

#: Similarity in hundredths, and words of a shingle.
THRESHOLD, WORDS = 90, 3
#: Coordinates of a point (a multiple of those of the tree's boxes) and of a box, entries of a tree node.
POINT_DIMS, DIMS, FANOUT = 1024, 32, 16
#: Members of a block that is joined in one task, and of small cells that share a task.
BLOCK, SHARED_TASK = 2048, 4096
#: Shingles that a worker remembers of the texts it has read last.
REMEMBERED = 1_000_000
#: Rows of an Arrow batch, and pairs that are bounded at once.
BATCH_ROWS, PAIRS = 512, 1024
#: Members verified against one text in one task.
VERIFY = 256
#: Candidates of a member, in a tree, that the first rounds go up to, those of every further round,
#: and candidates that a task holds before it drops those of later rounds.
ROUNDS, FURTHER, HELD_PAIRS = (3, 64), 64, 1 << 18
#: Counters of the filters that keep cells of one member out of the shuffle (with
#: the bits of a cell that each goes by), and cells of a batch.
FILTERS, CELL_BATCH = ((1 << 28, 0), (1 << 27, 32)), 250_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_U = np.uint64
_VOCAB = 150_000


class _Words(dict):
    """64-bit hash of each word, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) > _VOCAB:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASH = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    parts = (text or b"").translate(_LOWER).split()
    if not parts:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_HASH.__getitem__, parts), np.uint64, len(parts))
    k = min(words, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = _mix(h * _U(0x9E3779B97F4A7C15) + w[i:i + n])
    return np.unique(h)


@lru_cache
def _scheme(c: int, threshold: int) -> tuple[int, int]:
    """Groups and allowed differences for sets whose larger one has 2^c to
    2^(c+1) - 1 shingles: so many groups more than differences that a hashed
    set of the class rarely leaves as many empty."""
    largest = (2 << c) - 1
    differ = 2 * largest * (100 - threshold) // (100 + threshold)
    spare = 0.05
    while spare < 1 and spare / (1 + spare) < 1.4 * np.exp(-(1 << c) / max(1, differ) / (1 + spare)):
        spare += 0.05
    return differ + 3 + int(differ * spare), differ


def cells(s: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    """Cells of a set.  A group that is empty counts as equal but tells
    nothing; it gets a cell only where the others might all differ."""
    own, out = len(s).bit_length() - 1, []
    mixed = _mix(s)
    for c in (own, own + 1):
        if c != own and 100 * len(s) < threshold * (1 << c):
            continue  # too small for any set of the next class
        groups, differ = _scheme(c, threshold)
        g = (s % _U(groups)).astype(np.int64)
        n = np.bincount(g, minlength=groups)
        content = np.zeros(groups, np.uint64)
        np.add.at(content, g, mixed)
        keep = n > 0 if groups - differ > (n == 0).sum() else np.ones(groups, bool)
        key = content * _U(0x9E3779B97F4A7C15) + np.arange(groups, dtype=np.uint64) * _U(131) + _U(c)
        out.append(_mix(key[keep]))
    return np.concatenate(out).view(np.int64)


def counts(s: np.ndarray) -> bytes:
    """The point: shingles per group, packed."""
    import zstandard
    return zstandard.compress(np.bincount((s >> _U(40)).astype(np.int64) % POINT_DIMS, minlength=POINT_DIMS).astype(np.uint32).tobytes(), 1)


def unpacked(points: list[bytes]) -> np.ndarray:
    import zstandard
    d = zstandard.ZstdDecompressor()
    return np.frombuffer(b"".join(d.decompress(p) for p in points), np.uint32).reshape(-1, POINT_DIMS)


def folded(points: np.ndarray) -> np.ndarray:
    """The same counts over fewer, larger groups."""
    return points.reshape(len(points), -1, DIMS).sum(axis=1).astype(np.int64)


def _points(threshold: int, words: int):
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (batch.slice(k, BATCH_ROWS) for batch in batches for k in range(0, max(1, batch.num_rows), BATCH_ROWS)):
            cols = {k: [] for k in ("n", "digest", "counts", "cells")}
            for t in b.column("text"):
                s = shingles(t.as_py(), words)
                cols["n"].append(len(s))
                cols["digest"].append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                cols["counts"].append(counts(s))
                cols["cells"].append(cells(s, threshold).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays(
                [b.column("rid"), b.column("doc_id"), pa.array(cols["n"], pa.int64()), pa.array(cols["digest"], pa.binary()),
                 pa.array(cols["counts"], pa.binary()), pa.array(cols["cells"], pa.binary())],
                ["rid", "doc_id", "n", "digest", "counts", "cells"])
    return run


def points(rows: DataFrame, threshold: int = THRESHOLD, words: int = WORDS) -> DataFrame:
    """rid, doc_id, n (set size), digest of the set, counts and cells; written once."""
    return cut_lineage(rows.mapInArrow(_points(threshold, words), "rid long, doc_id long, n long, digest binary, counts binary, cells binary"))


def least_overlap(a, b, threshold: int = THRESHOLD):
    """Smallest intersection with which 100 * intersection >= threshold * union."""
    return -((-threshold * (a + b)) // (100 + threshold))


def _pack(vec: np.ndarray, size: np.ndarray, members: list[np.ndarray]):
    """Upper corners and size ranges of nodes."""
    return (np.array([vec[m].max(axis=0) for m in members]), np.array([size[m].min() for m in members]), np.array([size[m].max() for m in members]))


def _tile(vec: np.ndarray, size: np.ndarray, fanout: int) -> list[np.ndarray]:
    """Sort-tile-recursive leaves: by size, then by the coordinates that vary most."""
    order = [np.argsort(size, kind="stable")]
    for axis in np.argsort(-vec.var(axis=0), kind="stable")[:2]:
        parts = []
        for block in order:
            slabs = max(1, int(np.ceil((len(block) / fanout) ** 0.5)))
            parts += np.array_split(block[np.argsort(vec[block, axis], kind="stable")], slabs)
        order = parts
    return [p for block in order for p in np.array_split(block, max(1, -(-len(block) // fanout))) if len(p)]


def rtree_pairs(a_vec, a_size, b_vec, b_size, threshold: int = THRESHOLD, fanout: int = FANOUT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of points of a and b whose summed coordinate minima allow
    the similarity, by a dual descent of two packed trees."""
    def tree(vec, size):
        levels = [_tile(vec, size, fanout)]
        boxes = [_pack(vec, size, levels[0])]
        while len(levels[-1]) > 1:
            up, low, _ = boxes[-1]
            levels.append(_tile(up, low, fanout))
            members = levels[-1]
            boxes.append((np.array([up[m].max(axis=0) for m in members]), np.array([low[m].min() for m in members]),
                          np.array([boxes[-1][2][m].max() for m in members])))
        return levels, boxes

    def close(u, v, lo_u, lo_v, hi_u, hi_v):
        """Which node pairs may hold a link: sizes within reach, and an overlap bound that the smallest sizes need."""
        fits = (100 * hi_u >= threshold * lo_v) & (100 * hi_v >= threshold * lo_u)
        return fits & (np.minimum(u, v).sum(axis=1) >= least_overlap(lo_u, lo_v, threshold))

    ta, tb = tree(a_vec, a_size), tree(b_vec, b_size)
    stack = [(len(ta[0]) - 1, np.zeros(1, np.int64), len(tb[0]) - 1, np.zeros(1, np.int64))]
    while stack:
        la, ia, lb, ib = stack.pop()
        if len(ia) > 65_536:
            half = len(ia) // 2
            stack += [(la, ia[:half], lb, ib[:half]), (la, ia[half:], lb, ib[half:])]
            continue
        (ua, loa, hia), (ub, lob, hib) = (ta[1][la] if la >= 0 else (a_vec, a_size, a_size)), (tb[1][lb] if lb >= 0 else (b_vec, b_size, b_size))
        ok = close(ua[ia], ub[ib], loa[ia], lob[ib], hia[ia], hib[ib])
        ia, ib = ia[ok], ib[ok]
        if not len(ia):
            continue
        if la < 0 and lb < 0:
            yield ia, ib
            continue
        if la >= lb:
            kids = [ta[0][la][i] for i in ia]
            ib = np.repeat(ib, [len(k) for k in kids])
            stack.append((la - 1, np.concatenate(kids), lb, ib))
        else:
            kids = [tb[0][lb][i] for i in ib]
            ia = np.repeat(ia, [len(k) for k in kids])
            stack.append((la, ia, lb - 1, np.concatenate(kids)))


def _cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Cells and class ids, at most ``CELL_BATCH`` rows (or one set's) at a time, without copies of a whole batch."""
    for b in batches:
        column, ids = b.column("cells"), b.column("class_id").to_numpy()
        ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False)) // 8
        start = 0
        while start < b.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + CELL_BATCH, side="right")))
            parts = [np.frombuffer(c.as_buffer(), np.int64) for c in column.slice(start, stop - start)]
            yield np.concatenate(parts), np.repeat(ids[start:stop], [len(p) for p in parts])
            start = stop


def _stars(classes: DataFrame) -> DataFrame:
    """hub, class_id: each class with the smallest class of each cell that it
    shares, once.

    Bitmaps of fixed size tell which cells may be shared, the second one
    among those that the first lets pass; the others are not dealt out.  What
    is left is counted exactly.
    """
    one = classes.select("class_id", "cells")
    filters: list = []

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for c, ids in _cells_of(batches):
            for (size, shift), bits in zip(FILTERS, filters):
                hit = is_set(bits.value, (c >> shift) & (size - 1))
                c, ids = c[hit], ids[hit]
            yield c, ids

    for size, shift in FILTERS:
        def counters(batches: Iterator[pa.RecordBatch], size: int = size, shift: int = shift) -> Iterator[np.ndarray]:
            return ((c >> shift) & (size - 1) for c, _ in passing(batches))
        filters.append(one.sparkSession.sparkContext.broadcast(twice_bits(one, counters, size)))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, ids in passing(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(ids)], ["cell", "class_id"])
    many = cut_lineage(one.mapInArrow(explode, "cell long, class_id long"))
    for bits in filters:
        bits.destroy()  # the table is written
    hubs = cut_lineage(many.groupBy("cell").agg(F.min("class_id").alias("hub"), F.max("class_id").alias("last")).where("hub < last").select("cell", "hub"))
    return cut_lineage(many.join(hubs, "cell").where("hub != class_id").select("hub", "class_id").distinct())


def _verify(pairs: DataFrame, texts: DataFrame, threshold: int, words: int) -> DataFrame:
    """The pairs (a, b) that reach the similarity.  The texts of
    pairs with the same a are compared in chunks of ``VERIFY``, so a text
    that very many others may resemble is read by many tasks."""
    chunked = cut_lineage(pairs.withColumn("chunk", F.pmod(F.xxhash64("b"), F.col("chunks"))).drop("chunks"))
    own = chunked.select("a", "chunk", F.col("a").alias("class_id"), F.lit(0).alias("side")).distinct()
    sides = own.union(chunked.select("a", "chunk", F.col("b").alias("class_id"), F.lit(1).alias("side")))
    wanted = cut_lineage(sides.select("class_id").distinct())
    some = cut_lineage(pick(texts, wanted, "class_id"))

    known: OrderedDict[int, np.ndarray] = OrderedDict()
    total = [0]

    def read(i: int, text: bytes) -> np.ndarray:
        if i not in known:
            known[i] = shingles(text, words)
            total[0] += len(known[i])
            while total[0] > REMEMBERED and len(known) > 1:
                total[0] -= len(known.popitem(last=False)[1])
        return known[i]

    def compare(p: pd.DataFrame) -> pd.DataFrame:
        first = p["side"] == 0
        a = read(int(p["a"].iloc[0]), p.loc[first, "text"].iloc[0])
        out = []
        for b, t in zip(p.loc[~first, "class_id"], p.loc[~first, "text"]):
            s = read(int(b), t)
            both = len(np.intersect1d(a, s, assume_unique=True))
            if 100 * both >= threshold * (len(a) + len(s) - both):
                out.append(b)
        return pd.DataFrame({"a": [p["a"].iloc[0]] * len(out), "b": out}, dtype="int64")
    return cut_lineage(sides.join(some, "class_id").groupBy("a", "chunk").applyInPandas(compare, "a long, b long"))


def _chunked(pairs: DataFrame) -> DataFrame:
    """The written pairs with the number of chunks that a's partners are verified in."""
    return pairs.join(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / VERIFY).alias("chunks")), "a")


class _Sift:
    """Collects the pairs of rows of ``p`` whose sizes and summed coordinate
    minima, in the boxes' and then in the points' coordinates, allow a link."""

    def __init__(self, p: pd.DataFrame, threshold: int) -> None:
        self.ids = p["class_id"].to_numpy()
        _, at, self.pos = np.unique(self.ids, return_index=True, return_inverse=True)
        self.fine = unpacked(p["counts"].iloc[at])
        self.box, self.size, self.threshold = folded(self.fine), p["n"].to_numpy(), threshold
        self.out, self.held = [], 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        keep = 100 * np.minimum(self.size[i], self.size[j]) >= self.threshold * np.maximum(self.size[i], self.size[j])
        i, j = i[keep], j[keep]
        least = least_overlap(self.size[i], self.size[j], self.threshold)
        for k in range(0, len(i), PAIRS):
            u, v, need = i[k:k + PAIRS], j[k:k + PAIRS], least[k:k + PAIRS]
            for points in (self.box, self.fine):
                overlap = np.minimum(points[self.pos[u]], points[self.pos[v]]).sum(axis=1).astype(np.int64)
                ok = overlap >= need
                u, v, need, overlap = u[ok], v[ok], need[ok], overlap[ok]
            if len(u):
                self.out.append(np.stack([u, v, overlap]))
                self.held += len(u)

    def tree(self, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs out of the trees over the rows x and y."""
        for i, j in rtree_pairs(self.box[self.pos[x]], self.size[x], self.box[self.pos[y]], self.size[y], self.threshold):
            yield x[i], y[j]

    def taken(self) -> np.ndarray:
        """The rows of the pairs and their overlap bounds, handed over."""
        out, self.out, self.held = self.out, [], 0
        return np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)


class _Round:
    """Of the pairs in ``sift``, those with the ranks ``lo`` to ``hi - 1`` among
    a member's candidates in its tree, and the trees with later ones.

    Candidates are pairs across the components that the first searches have
    left (base), so a pair has the same rank in every round; each counts for
    its member of the component that is smaller in the tree, and likelier ones
    come first.  Pairs that are in one component by now (root) are passed over.
    """

    def __init__(self, p: pd.DataFrame, sift: _Sift, tree: np.ndarray, lo: int, hi: int) -> None:
        self.sift, self.tree, self.lo, self.hi = sift, tree, lo, hi
        self.base, self.root = p["base"].to_numpy(), p["root"].to_numpy()
        _, at, members = np.unique(np.stack([tree, self.base]), axis=1, return_inverse=True, return_counts=True)
        self.members = members[at.ravel()]
        self.later: set[int] = set()

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        apart = self.base[i] != self.base[j]
        self.sift.add(i[apart], j[apart])
        if self.sift.held > HELD_PAIRS:
            i, j, overlap, _ = self.first()
            self.sift.out.append(np.stack([i, j, overlap]))

    def first(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pairs with ranks below ``hi`` of those held, their overlap bounds and ranks."""
        i, j, overlap = self.sift.taken()
        size, ids = self.sift.size, self.sift.ids
        mine = (self.members[i] < self.members[j]) | (self.members[i] == self.members[j]) & (self.base[i] < self.base[j])
        i, j = np.where(mine, i, j), np.where(mine, j, i)
        order = np.lexsort((ids[j], -overlap / (size[i] + size[j] - overlap), i))
        i, j, overlap = i[order], j[order], overlap[order]
        once = np.ones(len(i), bool)
        once[1:] = (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        i, j, overlap = i[once], j[once], overlap[once]
        begins = np.flatnonzero(np.diff(i, prepend=-1))
        rank = np.arange(len(i)) - np.repeat(begins, np.diff(np.append(begins, len(i))))
        late = rank >= self.hi
        self.later.update(self.tree[i[late & (self.root[i] != self.root[j])]].tolist())
        return i[~late], j[~late], overlap[~late], rank[~late]

    def pairs(self, hubs: np.ndarray) -> pd.DataFrame:
        """a, b of this round's pairs, and (hub, hub) of each tree that needs a further one."""
        i, j, _, rank = self.first()
        now = (rank >= self.lo) & (self.root[i] != self.root[j])
        u, v = self.sift.ids[i[now]], self.sift.ids[j[now]]
        left = hubs[sorted(self.later)]
        return pd.DataFrame({
            "a": np.concatenate([np.minimum(u, v), left]), "b": np.concatenate([np.maximum(u, v), left]),
            "later": np.repeat([False, True], [len(u), len(left)])}).drop_duplicates()


def _groups(p: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of one hub."""
    starts = np.flatnonzero(np.concatenate([[True], np.diff(p["hub"].to_numpy()) != 0]))
    return starts, np.diff(np.append(starts, len(p)))


def _from_hubs(star: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a: hub, b) that searches of the hubs' trees with the hubs' points leave.

    Small trees share tasks; one of more than ``BLOCK`` members is dealt by hash into blocks.
    """
    per = star.groupBy("hub").agg(F.count(F.lit(1)).alias("m"))
    blocks = per.select("hub", F.ceil(F.col("m") / BLOCK).alias("blocks"))
    tasks = 1 + star.count() // SHARED_TASK
    member = cut_lineage(star.join(blocks, "hub").withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("blocks"))))
    points = classes.select("class_id", "n", "counts")
    below = member.select("hub", "class_id", "blocks", "block", F.lit(1).alias("side"))
    above = member.select("hub", F.col("hub").alias("class_id"), "blocks", "block", F.lit(0).alias("side")).distinct()
    both = cut_lineage(below.union(above))
    some = cut_lineage(pick(points, cut_lineage(both.select("class_id").distinct()), "class_id"))
    key = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("hub"), F.lit(tasks)).cast("string")).otherwise(F.concat_ws(":", "hub", "block"))

    def search(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["hub", "side"], kind="stable")
        sift = _Sift(p, threshold)
        starts, counts = _groups(p)
        leaf = counts <= FANOUT + 1  # trees of one leaf, all at once
        rest = np.concatenate([np.zeros(0, np.int64), *(np.arange(s + 1, s + m) for s, m in zip(starts[leaf], counts[leaf]))])
        sift.add(np.repeat(starts[leaf], counts[leaf] - 1), rest)
        for s, m in zip(starts[~leaf], counts[~leaf]):
            for i, j in sift.tree(np.arange(s, s + 1), np.arange(s + 1, s + m)):
                sift.add(i, j)
        i, j, _ = sift.taken()
        return pd.DataFrame({"a": sift.ids[i], "b": sift.ids[j]})
    return both.join(some, "class_id").withColumn("key", key).groupBy("key").applyInPandas(search, "a long, b long")


def _across(member: DataFrame, classes: DataFrame, threshold: int, lo: int, hi: int) -> DataFrame:
    """Pairs (a < b) of one hub's members (hub, class_id, base, root) in
    different components, by joins of the hubs' trees with themselves: those
    of one round (see ``_Round``), and as (hub, hub, later) the hubs that
    need another one.

    Of hubs with the same members one is kept.  Small trees share tasks; one
    of more than ``BLOCK`` members is dealt by hash into blocks, which are
    joined pairwise, each pair as a group of its own.
    """
    per = member.groupBy("hub").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("m"),
        F.bit_xor(F.xxhash64("class_id")).alias("x"), F.bit_xor(F.xxhash64("class_id", F.lit(1))).alias("y"))
    mixed = cut_lineage(per.where("lo < hi").groupBy("m", "x", "y").agg(F.min("hub").alias("hub")).select("hub", "m"))
    tasks = 1 + (mixed.agg(F.sum("m")).first()[0] or 0) // SHARED_TASK
    member = cut_lineage(member.join(mixed.select("hub", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "hub"))
    ids = cut_lineage(member.select("class_id").distinct())
    some = cut_lineage(pick(classes.select("class_id", "n", "counts"), ids, "class_id"))
    left = cut_lineage(member.join(some, "class_id").withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int")))
    cols = ("hub", "class_id", "base", "root", "n", "counts")
    key = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("hub"), F.lit(tasks)).cast("string")).otherwise(F.concat_ws(":", "hub", "i", "j"))
    lower = left.select(*cols, "blocks", F.lit(0).alias("side"), F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"))
    upper = left.where("block > 0").select(*cols, "blocks", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("i"), F.col("block").alias("j"))

    def join(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["hub", "side"], kind="stable")
        sift, side = _Sift(p, threshold), p["side"].to_numpy()
        start, count = _groups(p)
        found = _Round(p, sift, np.repeat(np.arange(len(start)), count), lo, hi)
        base = found.base
        single = side[start + count - 1] == 0
        for m in np.unique(count[single & (count <= FANOUT)]):  # trees of one leaf, all of a size at once
            rows = start[single & (count == m)]
            a, b = np.triu_indices(m, 1)
            per_call = max(1, 200_000 // max(1, len(a)))
            for k in range(0, len(rows), per_call):
                r = rows[k:k + per_call]
                found.add((r[:, None] + a).ravel(), (r[:, None] + b).ravel())
        for s, m, one in zip(start, count, single):
            if one and m <= FANOUT:
                continue
            all_rows = np.arange(s, s + m)
            x = all_rows[side[s:s + m] == 0]
            y = x if one else all_rows[side[s:s + m] == 1]
            names, n = np.unique(base[all_rows], return_counts=True)
            main = names[n.argmax()]  # pairs within the largest component are not needed
            for u, v in [(x[base[x] != main], y), *([] if one else [(x[base[x] == main], y[base[y] != main])])]:
                if len(u) and len(v):
                    for i, j in sift.tree(u, v):
                        found.add(i, j)
        return found.pairs(p["hub"].to_numpy()[start])
    return lower.union(upper).withColumn("key", key).groupBy("key").applyInPandas(join, "a long, b long, later boolean").distinct()


def _labelled(star: DataFrame, labels: DataFrame) -> DataFrame:
    """Each class with the root of its component."""
    return star.join(labels.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("root", F.coalesce("root", "class_id"))


def near_groups(rows: DataFrame, threshold: int = THRESHOLD, words: int = WORDS) -> DataFrame:
    """rid, doc_id, n, comp of each row (rid, doc_id, text as binary).

    comp numbers the components by their smallest rid; null for empty sets.
    """
    with arrow_rows(rows.sparkSession, BATCH_ROWS):
        return _near_groups(rows, threshold, words)


def _near_groups(rows: DataFrame, threshold: int, words: int) -> DataFrame:
    pts = points(rows, threshold, words)
    own = pts.where("digest IS NOT NULL")
    classes = cut_lineage(own.groupBy("digest").agg(F.min("rid").alias("class_id")))
    copies = cut_lineage(own.select("rid", "digest").join(classes, "digest").where("rid != class_id").select("rid"))
    rep = pick(own, copies, "rid", "left_anti").select(F.col("rid").alias("class_id"), "n", "counts", "cells")
    texts = rows.select(F.col("rid").alias("class_id"), "text")
    star = _stars(rep)
    links = _verify(_chunked(cut_lineage(_from_hubs(star, rep, threshold))), texts, threshold, words)
    labels = components(links)
    member = cut_lineage(_labelled(star, labels).withColumn("base", F.col("root")))
    lo = 0
    for hi in itertools.chain(ROUNDS, itertools.count(ROUNDS[-1] + FURTHER, FURTHER)):
        found = cut_lineage(_across(member, rep, threshold, lo, hi))
        pairs = found.where("NOT later").select("a", "b")
        more = None if pairs.isEmpty() else _verify(_chunked(pairs), texts, threshold, words)
        grown = more is not None and not more.isEmpty()
        if grown:
            links = links.union(more)
            labels = components(links)
        later = found.where("later").select(F.col("a").alias("hub"))
        if later.isEmpty():
            break
        left = member.join(later.distinct(), "hub", "left_semi")
        member, lo = cut_lineage(_labelled(left.drop("root"), labels) if grown else left), hi
    named = classes.join(labels.withColumnRenamed("node", "class_id"), "class_id", "left").select(
        "digest", F.coalesce("root", "class_id").alias("comp"))
    return pts.select("rid", "doc_id", "n", "digest").join(named, "digest", "left").drop("digest")


def _rows(docs: DataFrame, id_col: str, text_col: str, row_col: str | None = None) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b""))
    return docs.select(F.col(row_col).alias("rid"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))


def query(docs: DataFrame) -> DataFrame:
    """Contract columns of op7, one row per document."""
    held, rid = located(docs.select("doc_id", "text"), "doc_id")
    found = cut_lineage(near_groups(_rows(held, "doc_id", "text", rid)))
    least = found.where("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("least"))
    return found.join(least, "comp", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def one_per_group(docs: DataFrame, threshold: int = THRESHOLD, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns: the first of each group
    (smallest id) and every row without words."""
    held, rid = located(docs, id_col)
    found = cut_lineage(near_groups(_rows(held, id_col, text_col, rid), threshold, words))
    first = found.where("comp IS NOT NULL").groupBy("comp").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("m")).select("comp", F.col("m.rid").alias("keep"))
    gone = cut_lineage(found.join(first, "comp").where("rid != keep").select(F.col("rid").alias(rid)))
    return pick(held, gone, rid, "left_anti").select(docs.columns)
