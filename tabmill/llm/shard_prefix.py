"""Contiguous shards of equal bytes from global prefix sums.

The rows are put in one global order in which equal texts are neighbours,
range-partitioned by the whole order; the partitions' totals shift the
running sums inside them, which gives every row the bytes before it.  The
line of all bytes is cut at equal targets.

A group of equal texts stays in one shard.  Groups above 1/16 of a shard (so
at most 16 per shard) are laid out first, the largest first, each at the
beginning of the shard with most room; the line of all other rows fills what
is left, and a small group goes to the shard its middle lies in.  Only a
group that no shard has room for (larger than a shard, or too large beside
other such groups) is cut, between rows.

Defined results: a null text has no bytes (and the CRC of none) and is a
group of its own beside the empty text; repeated rows are rows; an empty
table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabmill.llm.common import join_small, prefix_sums
from tabmill.session import cut_lineage

#: Bytes that a row counts besides its text.
OVERHEAD = 16
#: Groups of equal texts above a shard's bytes divided by this are laid out one by one.
LARGE = 16


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid, doc_id, size, text_crc32, grp (a digest of the text) and ord (a hash of the row)."""
    text = F.col(text_col).cast("string")
    data = F.coalesce(text, F.lit("")).cast("binary")
    return cut_lineage(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(data) + OVERHEAD).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"), F.coalesce(F.md5(text.cast("binary")), F.lit("")).alias("grp"),
        F.xxhash64(F.col(id_col)).alias("ord")).withColumn("rid", F.monotonically_increasing_id()).withColumn("one", F.lit(1)))


def _layout(rows: DataFrame, n_shards: int, total: int) -> tuple[list[tuple[str, int]], list[int], list[int]]:
    """(group, shard, or n_shards for a group that must be cut) of the large
    groups, and the bytes and rows that they take of each shard.  At most
    ``LARGE`` x ``n_shards`` groups can be large, so the driver can hold them."""
    large = (rows.groupBy("grp").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
             .where((F.col("n") > 1) & (F.col("size").cast("decimal(38,0)") * (LARGE * n_shards) > total)).collect())
    taken, n_rows, at = [0] * n_shards, [0] * n_shards, []
    for r in sorted(large, key=lambda r: (-r["size"], r["grp"])):
        k = min(range(n_shards), key=lambda k: (taken[k], k))
        fits = (taken[k] + r["size"]) * n_shards <= total
        at.append((r["grp"], k if fits else n_shards))
        if fits:
            taken[k] += r["size"]
            n_rows[k] += r["n"]
    return at, taken, n_rows


def shards(rows: DataFrame, n_shards: int = 40) -> DataFrame:
    """``rows`` (of ``sized``) with shard and slot."""
    spark = rows.sparkSession
    total = rows.agg(F.sum("size")).first()[0] or 0
    large, taken, n_rows = _layout(rows, n_shards, total)
    laid = F.broadcast(spark.createDataFrame(large, "grp string, seg int"))  # at most LARGE x n_shards rows
    placed = rows.join(laid, "grp", "left").withColumns({"seg": F.coalesce("seg", F.lit(n_shards)), "cut": F.col("seg").isNotNull()})
    placed = cut_lineage(prefix_sums(placed, ["seg", "grp", "ord", "doc_id", "rid"], {"before": "size", "pos": "one"}))

    line = placed.where(F.col("seg") == n_shards)
    groups = cut_lineage(line.where(~F.col("cut")).groupBy("grp").agg(F.min("before").alias("g_before"), F.sum("size").alias("g_size"), F.count(F.lit(1)).alias("n"))
                         .where("n > 1").drop("n"))
    line = join_small(line, groups, "grp", "left")
    start = F.coalesce("g_before", "before") - sum(taken)
    middle = (2 * start + F.coalesce("g_size", "size")).cast("decimal(38,0)") * n_shards
    room, ends = 0, []  # where on the line (in halves of bytes times shards) the room of each shard but the last ends
    for k in range(n_shards - 1):
        room += 2 * (total - taken[k] * n_shards)
        ends.append(room)
    if any(taken):
        cuts = F.array(*[F.lit(e).cast("decimal(38,0)") for e in ends]) if ends else F.expr("CAST(array() AS array<decimal(38,0)>)")
        shard = F.size(F.filter(cuts, lambda e: e <= middle))
    else:
        shard = F.least(F.lit(n_shards - 1), F.floor(middle / F.lit(2 * max(1, total)).cast("decimal(38,0)")).cast("int"))
    line = cut_lineage(line.withColumn("shard", shard).drop("g_before", "g_size", "before", "one", "cut"))
    base = line.groupBy("shard").agg(F.min("pos").alias("first"))  # one row per shard
    known = spark.createDataFrame(list(enumerate(n_rows)), "shard int, own long")
    base = base.join(F.broadcast(known), "shard").select("shard", (F.col("first") - F.col("own")).alias("first"))
    line = line.join(F.broadcast(base), "shard")

    firsts = [(k, sum(n_rows[:k])) for k in range(n_shards)]
    own = placed.where(F.col("seg") < n_shards).drop("before", "one", "cut").withColumn("shard", F.col("seg"))
    own = own.join(F.broadcast(spark.createDataFrame(firsts, "shard int, first long")), "shard")
    return line.unionByName(own).withColumn("slot", F.col("pos") - F.col("first")).drop("first", "seg")


def query(docs: DataFrame) -> DataFrame:
    """Contract columns of op9, one row per document; the law is ``bytes``."""
    return shards(sized(docs)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The shards as files: one folder per shard, its rows in slot order
    (sorted within each written file, all columns, with the slot)."""
    from tabmill.llm.common import fresh
    rid = fresh(docs, "rid")
    held = cut_lineage(docs.withColumn(rid, F.monotonically_increasing_id()))
    sizes = (sized(held.select(F.col(rid).alias("doc_id"), F.col(text_col).alias("text"))))
    at = shards(sizes, n_shards).select(F.col("doc_id").alias(rid), "shard", "slot")
    clash = {c: fresh(docs, c) for c in ("shard", "slot") if c in docs.columns}
    at = at.withColumnsRenamed(clash)
    shard, slot = clash.get("shard", "shard"), clash.get("slot", "slot")
    (held.join(at, rid).drop(rid).repartitionByRange(n_shards, shard, slot).sortWithinPartitions(shard, slot)
     .write.partitionBy(shard).parquet(path))
