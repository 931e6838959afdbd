"""Exact dedup through a minimal perfect hash over historical digests.

The history is a table of distinct SHA-256 digests with the locator of each
one's winner.  It is split by digest into partitions of a bounded number of
keys; each partition gets a minimal perfect hash (levels of bitmaps; a key's
slot is the rank of its bit) whose slots hold the full 32-byte digest, the
winner and the group size.  Incoming rows are first summed up by digest,
then looked up: the slot's bytes must equal the digest, so a hash that lands
on a foreign slot is no match.  Matches update the slot; non-members are
groups of their own.

Equal texts are texts with the same bytes; null counts as empty.  The row
with the largest doc_id stays (null ids lose against any id; of repeated
rows with the same id exactly one stays).  An empty table gives no rows.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tabmill.llm.common import located, pick, text_or_empty
from tabmill.session import cut_lineage

#: Distinct digests that one partition of the index is sized for.
KEYS_PER_PART = 100_000
#: Bits per key of each level.
GAMMA = 2.0
_INDEX = "part long, sizes binary, bits binary, digests binary, ids binary, no_id binary, rids binary, counts binary"
_CLASSES = "digest binary, keep_id long, keep_rid long, group_size long, slot long"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _position(words: np.ndarray, level: int, size: int) -> np.ndarray:
    h = words[:, level % 4] + np.uint64((level * 0x9E3779B97F4A7C15) & (2**64 - 1))
    for k in range(1, 4):
        h = _mix(h) ^ words[:, (level + k) % 4]
    return (_mix(h) % np.uint64(size)).astype(np.int64)


def build_hash(words: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Level sizes and concatenated bitmaps (bool) of a minimal perfect hash
    over the distinct rows of ``words`` (n x 4 unsigned 64-bit)."""
    sizes, bits, left = [], [], words
    while len(left):
        if len(sizes) > 200:
            raise ValueError("the digests are not distinct")
        size = max(64, int(GAMMA * len(left)))
        at = _position(left, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left = left[~alone[at]]
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool)


def find_slots(words: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """Slot of each row (some slot or -1 for a row outside the key set)."""
    rank = np.cumsum(bits) - 1
    slots, open_ = np.full(len(words), -1, np.int64), np.arange(len(words))
    base = 0
    for level, size in enumerate(sizes):
        at = base + _position(words[open_], level, size)
        hit = bits[at]
        slots[open_[hit]] = rank[at[hit]]
        open_ = open_[~hit]
        base += size
    return slots


def _words(digests) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 4)


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid (a row locator, fixed by being written), doc_id, digest."""
    return cut_lineage(df.select(F.col(id_col).cast("long").alias("doc_id"),
                                 F.unhex(F.sha2(text_or_empty(text_col), 256)).alias("digest"))
                       .withColumn("rid", F.monotonically_increasing_id()))


def grouped(rows: DataFrame) -> DataFrame:
    """One row per digest: winner and number of rows, summed up before the shuffle."""
    return (rows.groupBy("digest").agg(F.max(F.struct("doc_id", "rid")).alias("w"), F.count(F.lit(1)).alias("n"))
            .select("digest", F.col("w.doc_id").alias("doc_id"), F.col("w.rid").alias("rid"), "n"))


def _with_part(groups: DataFrame, parts: int) -> DataFrame:
    return groups.withColumn("part", F.pmod(F.xxhash64("digest"), F.lit(parts)))


def build_index(history: DataFrame, parts: int) -> DataFrame:
    """One row per partition: the hash and its slots.  ``history``: digest,
    doc_id, rid, n with distinct digests."""
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        words = _words(pdf["digest"])
        sizes, bits = build_hash(words)
        order = np.argsort(find_slots(words, sizes, bits))
        pdf = pdf.iloc[order]
        ids = pdf["doc_id"]
        return pd.DataFrame({
            "part": [int(pdf["part"].iloc[0])], "sizes": [np.array(sizes, np.int64).tobytes()],
            "bits": [np.packbits(bits).tobytes()], "digests": [b"".join(pdf["digest"])],
            "ids": [ids.astype("Int64").fillna(0).to_numpy(np.int64).tobytes()], "no_id": [ids.isna().to_numpy(bool).tobytes()],
            "rids": [pdf["rid"].to_numpy(np.int64).tobytes()], "counts": [pdf["n"].to_numpy(np.int64).tobytes()]})
    # whole ids beyond 2^53 would lose digits as pandas floats when one is null
    rows = _with_part(history, parts).select("part", "digest", "rid", "n", F.col("doc_id").cast("string").alias("doc_id"))
    return rows.groupBy("part").applyInPandas(lambda p: build(p.assign(doc_id=p["doc_id"].map(int, na_action="ignore").astype("Int64"))), _INDEX)


def probe(incoming: DataFrame, index: DataFrame, parts: int) -> DataFrame:
    """Look the incoming groups up: one row per digest of either side, with
    the winner and size of the merged group; slot is null for non-members."""
    def look(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        n_ids = [None if v is None or v != v else int(v) for v in new["doc_id"]]
        out = {"digest": [], "keep_id": [], "keep_rid": [], "group_size": [], "slot": []}
        slots = np.full(len(new), -1, np.int64)
        if len(old):
            o = old.iloc[0]
            sizes = np.frombuffer(o["sizes"], np.int64).tolist()
            bits = np.unpackbits(np.frombuffer(o["bits"], np.uint8))[:sum(sizes)].astype(bool)
            held = [o["digests"][i:i + 32] for i in range(0, len(o["digests"]), 32)]
            ids, none = np.frombuffer(o["ids"], np.int64).tolist(), np.frombuffer(o["no_id"], bool)
            ids = [None if x else i for i, x in zip(ids, none)]
            rids, counts = (np.frombuffer(o[c], np.int64).tolist() for c in ("rids", "counts"))
            if len(new):
                slots = find_slots(_words(new["digest"]), sizes, bits)
                slots = np.array([s if s >= 0 and held[s] == d else -1 for s, d in zip(slots, new["digest"])], np.int64)
            for s, i, r, n in zip(slots, n_ids, new["rid"], new["n"]):
                if s >= 0:
                    counts[s] += int(n)
                    if (i is not None, i or 0, r) > (ids[s] is not None, ids[s] or 0, rids[s]):
                        ids[s], rids[s] = i, int(r)
            out = {"digest": held, "keep_id": ids, "keep_rid": rids, "group_size": counts, "slot": list(range(len(held)))}
        for s, d, i, r, n in zip(slots, new["digest"], n_ids, new["rid"], new["n"]):
            if s < 0:
                for k, v in zip(out, (d, i, int(r), int(n), None)):
                    out[k].append(v)
        return pd.DataFrame({k: pd.Series(v, dtype=object if k == "digest" else "Int64") for k, v in out.items()})
    rows = _with_part(incoming, parts).select("part", "digest", "rid", "n", F.col("doc_id").cast("string").alias("doc_id"))
    return rows.groupBy("part").cogroup(index.groupBy("part")).applyInPandas(look, _CLASSES)


def exact_groups(rows: DataFrame, keys_per_part: int = KEYS_PER_PART) -> DataFrame:
    """``rows`` (of ``digests``) with the class of each: keep_id, keep_rid, group_size.

    The history is the part of the corpus that came first: the rows up to the
    middle of the id range.  The later rows are looked up in its index.
    """
    lo, hi = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    early = F.lit(False) if lo is None else F.coalesce(F.col("doc_id") <= lo + (hi - lo) // 2, F.lit(False))
    history, incoming = cut_lineage(grouped(rows.where(early))), cut_lineage(grouped(rows.where(~early)))
    parts = 1 + max(history.count(), incoming.count()) // keys_per_part
    classes = probe(incoming, build_index(history, parts), parts)
    return rows.join(cut_lineage(classes), "digest")


def query(docs: DataFrame) -> DataFrame:
    """Contract columns of op2, one row per document."""
    return exact_groups(digests(docs)).select(
        "doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns."""
    held, rid = located(docs, id_col)
    rows = cut_lineage(held.select(F.col(id_col).cast("long").alias("doc_id"), F.col(rid).alias("rid"),
                                   F.unhex(F.sha2(text_or_empty(text_col), 256)).alias("digest")))
    gone = cut_lineage(exact_groups(rows).where("rid != keep_rid").select(F.col("rid").alias(rid)))
    return pick(held, gone, rid, "left_anti").select(docs.columns)
