"""Trie of conversation prefixes with count-min screening.

Every prefix of a conversation has a digest: the sum of hashes of its turns,
each hashed with its depth.  A count-min sketch over the prefixes of all
conversations (its count is never too low) proves most prefixes to belong to
one conversation alone: these tails are emitted where they lie, and only the
prefixes that may be shared are shuffled and grouped exactly.

Subtree figures need no walk over the levels.  Every node is credited to its
smallest member; a node's subtree sum is the sum, over its members, of what
is credited to the member from the node's depth on, which is one running sum
along the conversations and one more grouping.

Orders and running sums are cut by (conversation, depth), so a conversation
with a large part of all turns is many tasks' work; what a cut conversation
brings along is one row per partition.  The list of a node's ends is put
together in sorted chunks and hashed as a stream.  The sketch grows with the
number of prefixes up to ``MAX_WIDTH`` counters a row (beyond that more
prefixes are grouped exactly, none is lost).

Defined results: turns are ordered by turn (null first), turns of one number
by a digest of role and text; null roles and texts are empty; rows without a
conv_id belong to no conversation; repeated rows are turns of their own; a
conversation may be left without turns and then ends at the root; an empty
table gives no rows, not even a root; other columns are not read, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tabmill.llm.common import is_set, join_small, twice_bits
from tabmill.session import cut_lineage

#: Ids are rebuilt on the conversation at the start of their block, with up to SHARED - 1 of its turns.
BLOCK, SHARED = 100, 6
#: Rows of the sketch, and bounds of the counters in a row.
ROWS, MIN_WIDTH, MAX_WIDTH = 3, 1 << 16, 1 << 27
#: Ids of a chunk of ends.
CHUNK = 4096
_U = np.uint64
_M64 = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _unsigned(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(name).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


# ---- running sums along conversations -------------------------------------------------------------

def running(df: DataFrame, order: Sequence[str], sums: Sequence[str], schema: str,
            before: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None) -> tuple[DataFrame, dict]:
    """``df`` sorted by cid and ``order`` over all partitions, with the sums
    of ``sums`` up to and with each row within its cid (modulo 2^64), counted
    from the start of the partition, and pid; written once.  Also what the
    first cid of a partition brings along: {pid: (cid, sums)}, at most one
    entry per partition.  ``schema`` lists the columns of ``before(batch)``
    (default: the batch itself)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        last, so_far = None, [_U(0)] * len(sums)
        for b in batches:
            if not b.num_rows:
                continue
            b = before(b) if before else b
            key = b.column("cid").to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
            counts = np.diff(np.append(starts, len(key)))
            done = {}
            for k, name in enumerate(sums):
                line = np.cumsum(_unsigned(b, name))
                base = np.concatenate([[_U(0)], line[starts[1:] - 1]])
                if key[0] == last:
                    base[0] = base[0] - so_far[k]
                done[name] = line - np.repeat(base, counts)
                so_far[k] = done[name][-1]
            last = key[-1]
            arrays = [pa.array(done[c].view(np.int64)) if c in done else b.column(c) for c in b.schema.names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.full(len(key), pid, np.int32))], [*b.schema.names, "pid"])
    parted = df.repartitionByRange(n, "cid", *order).sortWithinPartitions("cid", *order)
    table = cut_lineage(parted.mapInArrow(run, f"{schema}, pid int"))
    at = F.struct("cid", *[c for c in order if c in table.columns])
    ends = table.groupBy("pid").agg(F.min("cid").alias("first"), F.max("cid").alias("last"), F.max_by(F.struct(*sums), at).alias("sums"))
    carry, key, total = {}, None, [0] * len(sums)
    for r in sorted(ends.collect(), key=lambda r: r["pid"]):  # one row per partition
        if r["first"] == key:
            carry[r["pid"]] = (key, list(total))
        own = list(r["sums"])
        total = [(t + x) & _M64 for t, x in zip(total, own)] if r["last"] == key else own
        key = r["last"]
    return table, carry


def brought(b: pa.RecordBatch, sums: Sequence[str], carry: dict) -> list[np.ndarray]:
    """The batch's running sums from the start of each cid."""
    out = [_unsigned(b, c) for c in sums]
    if b.num_rows and (held := carry.get(b.column("pid")[0].as_py())):
        first = b.column("cid").to_numpy() == held[0]
        out = [x + np.where(first, _U(t & _M64), _U(0)) for x, t in zip(out, held[1])]
    return out


def _one_pid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds rows of one pid only (a scan may pack several files into a task)."""
    for b in batches:
        if b.num_rows:
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(b.column("pid").to_numpy())) + 1, [b.num_rows]])
            yield from (b.slice(i, j - i) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()))


# ---- rebuilding ----------------------------------------------------------------------------------

def _shared_turns(cid: Column) -> Column:
    return F.pmod(F.crc32(cid.cast("string").cast("binary")), F.lit(SHARED)).cast("int")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """cid, depth (0: the root), n_turns, d0, d1 (digest of the turn) and chars of every rebuilt turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat_ws(":", F.length(role).cast("string"), role, text).cast("binary"))
    rows = cut_lineage(conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("cid"), F.col("turn").cast("long").alias("turn"), *[
        F.conv(F.substring(digest, 16 * k + 1, 15), 16, 10).cast("long").alias(f"d{k}") for k in (0, 1)], F.length(text).cast("long").alias("chars"))
        .withColumn("place", F.lit(1).cast("long")))
    table, carry = running(rows, ["turn", "d0", "d1"], ["place"], "cid long, turn long, d0 long, d1 long, chars long, place long")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _one_pid(batches):
            place, = brought(b, ["place"], carry)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("cid", "d0", "d1", "chars")), pa.array(place.view(np.int64))],
                                             ["cid", "d0", "d1", "chars", "place"])
    placed = cut_lineage(table.mapInArrow(number, "cid long, d0 long, d1 long, chars long, place long"))
    heads = (placed.where((F.col("cid") % BLOCK == 0) & (F.col("place") < SHARED)).groupBy(F.col("cid").alias("base"))
             .agg(F.array_sort(F.collect_list(F.struct("place", "d0", "d1", "chars"))).alias("head")))  # at most SHARED - 1
    plan = (placed.groupBy("cid").agg(F.count(F.lit(1)).alias("own")).withColumns({"base": F.col("cid") - F.col("cid") % BLOCK, "h": _shared_turns(F.col("cid"))})
            .join(heads, "base", "left").withColumn("m", F.least("h", F.coalesce(F.size("head"), F.lit(0)))))
    plan = cut_lineage(plan.select("cid", "h", "m", (F.col("m") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n_turns"),
                                   F.when(F.col("m") > 0, F.slice("head", F.lit(1), F.col("m"))).alias("head")))
    zero = F.lit(0).cast("long")
    root = plan.select("cid", zero.alias("depth"), "n_turns", zero.alias("d0"), zero.alias("d1"), zero.alias("chars"))
    first = plan.select("cid", "n_turns", F.explode("head").alias("t")).select("cid", F.col("t.place").alias("depth"), "n_turns", "t.d0", "t.d1", "t.chars")
    own = join_small(placed.where(F.col("place") > _shared_turns(F.col("cid"))), plan.select("cid", "h", "m", "n_turns"), "cid")
    own = own.select("cid", (F.col("place") - F.col("h") + F.col("m")).alias("depth"), "n_turns", "d0", "d1", "chars")
    return cut_lineage(root.unionByName(first).unionByName(own))


def _lanes(b: pa.RecordBatch) -> pa.RecordBatch:
    """The turn's digests mixed with its depth (nothing at the root), as l0, l1 and, to be summed up, a0, a1."""
    depth = _unsigned(b, "depth")
    lanes = [np.where(depth > 0, _mix(_unsigned(b, f"d{k}") + depth * _U(c)), _U(0)).view(np.int64)
             for k, c in ((0, 0x9E3779B97F4A7C15), (1, 0xD1B54A32D192ED03))]
    return pa.RecordBatch.from_arrays([*(b.column(c) for c in ("cid", "depth", "n_turns", "chars")), *map(pa.array, lanes + lanes)],
                                      ["cid", "depth", "n_turns", "chars", "l0", "l1", "a0", "a1"])


# ---- count-min screening -------------------------------------------------------------------------

def cells(depth: np.ndarray, a0: np.ndarray, a1: np.ndarray, width: int) -> list[np.ndarray]:
    """The counters of prefixes, one per row of the sketch."""
    key = _mix(a0 ^ _mix(a1 + depth * _U(0x9E3779B97F4A7C15)))
    return [(_mix(key + _U(131 * r)) & _U(width - 1)).astype(np.int64) + r * width for r in range(ROWS)]


def sketch(table: DataFrame, carry: dict, width: int) -> np.ndarray:
    """A bit per counter: whether at least two prefixes meet in it (at most ROWS * MAX_WIDTH / 8 bytes)."""
    def counters(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in _one_pid(batches):
            yield from cells(_unsigned(b, "depth"), *brought(b, ["a0", "a1"], carry), width)
    return twice_bits(table.select("cid", "depth", "a0", "a1", "pid"), counters, ROWS * width)


def screened(turns: DataFrame) -> DataFrame:
    """cid, depth, n_turns, chars, a0, a1 (digest of the prefix), b0, b1 (that
    of its parent), alone and parent_alone (proven to be of one conversation)."""
    table, carry = running(turns, ["depth"], ["a0", "a1"],
                           "cid long, depth long, n_turns long, chars long, l0 long, l1 long, a0 long, a1 long", _lanes)
    width = MIN_WIDTH
    n = table.count()
    while width < min(4 * n, MAX_WIDTH):
        width *= 2
    sent = turns.sparkSession.sparkContext.broadcast(sketch(table, carry, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value

        def alone(depth: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
            out = np.zeros(len(depth), bool)
            for at in cells(depth, x, y, width):
                out |= ~is_set(bits, at)
            return out
        for b in _one_pid(batches):
            depth, a = _unsigned(b, "depth"), brought(b, ["a0", "a1"], carry)
            up = [x - _unsigned(b, f"l{k}") for k, x in enumerate(a)]
            above = alone(np.maximum(depth, _U(1)) - _U(1), *up)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("cid", "depth", "n_turns", "chars")), *(pa.array(x.view(np.int64)) for x in (*a, *up)),
                 pa.array(alone(depth, *a)), pa.array(above)],
                ["cid", "depth", "n_turns", "chars", "a0", "a1", "b0", "b1", "alone", "parent_alone"])
    return cut_lineage(table.mapInArrow(run, "cid long, depth long, n_turns long, chars long, a0 long, a1 long, b0 long, b1 long, alone boolean, parent_alone boolean"))


# ---- exact part ----------------------------------------------------------------------------------

NODE = ("depth", "a0", "a1")


def _ends(rows: DataFrame) -> DataFrame:
    """depth, a0, a1, ends: SHA-256 of the sorted, comma-joined ids of the conversations that end at a node."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node = np.stack([b.column(c).to_numpy() for c in NODE], axis=1)
            cid = b.column("cid").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]).any(axis=1)])) if len(cid) else np.zeros(0, np.int64)
            at = np.unique(np.concatenate([starts, np.arange(0, len(cid), CHUNK)])).tolist()
            if at:
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(node[at, k]) for k in range(3)), pa.array(cid[at]),
                     pa.array([",".join(map(str, cid[i:j].tolist())) for i, j in zip(at, [*at[1:], len(cid)])])], [*NODE, "cid", "part"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha = None, None
        for b in batches:
            out = []
            for node, part in zip(zip(*(b.column(c).to_pylist() for c in NODE)), b.column("part")):
                if node == at:
                    sha.update(b"," + part.as_py().encode())
                else:
                    if at is not None:
                        out.append((*at, sha.hexdigest()))
                    at, sha = node, hashlib.sha256(part.as_py().encode())
            yield pa.RecordBatch.from_pylist([dict(zip((*NODE, "ends"), o)) for o in out], pa.schema(
                [*((c, pa.int64()) for c in NODE), ("ends", pa.string())]))
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, sha.hexdigest())], [*NODE, "ends"])
    ids = rows.select(*NODE, "cid").repartitionByRange(n, *NODE, "cid").sortWithinPartitions(*NODE, "cid")
    parts = ids.mapInArrow(chunk, "depth long, a0 long, a1 long, cid long, part string")
    return parts.repartition(n, *NODE).sortWithinPartitions(*NODE, "cid").mapInArrow(digest, "depth long, a0 long, a1 long, ends string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = screened(rebuilt(conversations))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    ended = F.col("depth") == F.col("n_turns")
    maybe = rows.where("NOT alone")
    nodes = cut_lineage(maybe.groupBy(*NODE).agg(
        F.min("cid").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("n_turns").alias("deepest"),
        F.max("chars").alias("chars"), F.max("b0").alias("b0"), F.max("b1").alias("b1")))

    # what is credited to each conversation at each depth, summed up from its end; a credit comes before the rows of its depth
    up = (-F.col("depth")).alias("up")
    saved = ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")
    credit = nodes.select(F.col("conv_id").alias("cid"), up, F.lit(0).alias("kind"), saved, (F.col("deepest") == F.col("depth")).cast("long").alias("leaves"), zero.alias("a0"), zero.alias("a1"))
    tails = rows.where(F.col("alone") & ended).select("cid", up, F.lit(0).alias("kind"), zero.alias("saved"), one.alias("leaves"), zero.alias("a0"), zero.alias("a1"))
    wanted = maybe.select("cid", up, F.lit(1).alias("kind"), zero.alias("saved"), zero.alias("leaves"), "a0", "a1")
    table, carry = running(cut_lineage(credit.unionByName(tails).unionByName(wanted)), ["up", "kind"], ["saved", "leaves"],
                           "cid long, up long, kind int, saved long, leaves long, a0 long, a1 long")

    def owed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _one_pid(batches):
            sums = brought(b, ["saved", "leaves"], carry)
            keep = b.column("kind").to_numpy() == 1
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (
                -b.column("up").to_numpy(), b.column("a0").to_numpy(), b.column("a1").to_numpy(), *(s.view(np.int64) for s in sums))], [*NODE, "saved", "leaves"])
    shares = table.mapInArrow(owed, "depth long, a0 long, a1 long, saved long, leaves long").withColumn("children", zero)
    below = (F.col("depth") - 1).alias("depth")
    edges = rows.where("alone AND NOT parent_alone AND depth > 0")
    child = [d.select(below, F.col("b0").alias("a0"), F.col("b1").alias("a1"), zero.alias("saved"), zero.alias("leaves"), one.alias("children"))
             for d in (nodes.where("depth > 0"), edges)]
    sums = shares.unionByName(child[0]).unionByName(child[1]).groupBy(*NODE).agg(
        F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"), F.sum("children").alias("n_children"))

    known = cut_lineage(nodes.select(F.struct(*NODE).alias("above"), F.col("conv_id").alias("parent_conv_id")))
    above = F.struct(below, F.col("b0").alias("a0"), F.col("b1").alias("a1"))
    own_parent = F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id")).alias("parent_conv_id")
    none = F.sha2(F.lit("").cast("binary"), 256)
    full = (join_small(nodes.withColumn("above", above), known, "above", "left").drop("above").join(sums, list(NODE), "left")
            .join(_ends(maybe.where(ended)), list(NODE), "left"))
    shared = full.select("conv_id", "depth", own_parent, "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", none).alias("ends_sha256"))
    single = ["n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    lone = [one.alias(single[0]), F.when(ended, zero).otherwise(one).alias(single[1]), one.alias(single[2]), zero.alias(single[3]),
            F.when(ended, F.sha2(F.col("cid").cast("string").cast("binary"), 256)).otherwise(none).alias(single[4])]
    local = rows.where("alone AND (parent_alone OR depth = 0)").select(
        F.col("cid").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.col("cid")).alias("parent_conv_id"), *lone)
    hung = join_small(edges.withColumn("above", above).select("cid", "depth", "n_turns", "above"), known, "above", "left").withColumn("conv_id", F.col("cid"))
    return shared.unionByName(local).unionByName(hung.select("conv_id", "depth", own_parent, *lone))


def query(conversations: DataFrame) -> DataFrame:
    """Contract columns of op11, one row per node."""
    return trie(conversations)


QUERY_SQL = """
WITH o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, (4294967295 - list_reduce(list_concat([4294967295], [ord(x)::BIGINT for x in string_split(conv_id::VARCHAR, '')]),
           lambda s, b: list_reduce(list_concat([xor(s, b)], [0, 0, 0, 0, 0, 0, 0, 0]),
             lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END))) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
r AS (
  SELECT c.conv_id, 0 AS part, o.p, o.role, o.text FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 100 AND o.p <= c.h
  UNION ALL SELECT c.conv_id, 1, o.p, o.role, o.text FROM c JOIN o ON o.conv_id = c.conv_id AND o.p > c.h),
d AS (
  SELECT conv_id, row_number() OVER w AS depth, md5(string_agg(md5(role) || md5(text), '') OVER w) AS node, length(text) AS chars FROM r
  WINDOW w AS (PARTITION BY conv_id ORDER BY part, p)
  UNION ALL SELECT conv_id, 0, '', 0 FROM c),
t AS (SELECT conv_id, max(depth) AS n_turns FROM d GROUP BY 1),
n AS (
  SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, max(n_turns) = depth AS leaf,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n_turns = depth), '')) AS ends_sha256
  FROM d JOIN t USING (conv_id) GROUP BY 1, 2),
e AS (
  SELECT DISTINCT x.depth, x.node, y.depth AS low_depth, y.node AS low FROM d x JOIN d y ON x.conv_id = y.conv_id AND x.depth <= y.depth),
s AS (
  SELECT e.depth, e.node, count(*) FILTER (v.leaf) AS n_leaves, sum((v.n_convs - 1) * v.chars)::BIGINT AS saved_tokens,
         count(*) FILTER (e.low_depth = e.depth + 1) AS n_children
  FROM e JOIN n v ON v.depth = e.low_depth AND v.node = e.low GROUP BY 1, 2),
u AS (SELECT e.low_depth AS depth, e.low AS node, n.conv_id AS parent_conv_id FROM e JOIN n USING (depth, node) WHERE e.low_depth = e.depth + 1)
SELECT n.conv_id, n.depth, u.parent_conv_id, n.n_convs, s.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM n JOIN s USING (depth, node) LEFT JOIN u USING (depth, node)
"""
