"""Chat formatting with cumulative-snapshot collapse.

Loggers often write a conversation again after every turn, so that most
logged conversations are prefixes of longer ones.  Each turn gets a hash of
(position, role, text); the rolling sum of these hashes over a
conversation's turns identifies its prefix of every length.  A conversation
whose whole hash is also a proper prefix of another goes (anti-join), of
equal conversations the one with the smallest id stays, and what is left is
rendered in the chat template.

Positions and rolling sums are distributed prefix sums, so a conversation
that holds a large part of all turns is cut into many tasks.  It is rendered
in rows of at most ``TURNS`` turns.

Defined results: turns are ordered by turn, role and text (nulls first); a
null conv_id is one conversation; null roles and texts differ from empty
ones when compared and are rendered as empty; repeated rows are turns of
their own; an empty table gives no rows; other columns are not read,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabmill.llm.common import prefix_sums
from tabmill.session import cut_lineage

#: Turns per rendered row.
TURNS = 1024
#: Lanes of 32 bits that make up the rolling hash (sums stay below 2^63 for 2^31 turns).
LANES = 4


def _key(c: str) -> Column:
    return F.when(F.col(c).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(c).cast("string")))


def turns(conversations: DataFrame) -> DataFrame:
    """key, conv_id, role, text, pos (from 0 in its conversation), n_turns and
    prefix, the rolling hash up to and with the turn; written once."""
    rows = conversations.select(
        F.when(F.col("conv_id").isNull(), F.lit(1)).otherwise(0).alias("none"), "conv_id", "turn", "role", "text")
    rows = rows.withColumns({"no_id": F.col("none"), "cid": F.coalesce(F.col("conv_id").cast("long"), F.lit(0)),
                             "krole": _key("role"), "ktext": _key("text"), "one": F.lit(1)}).drop("none")
    placed = cut_lineage(prefix_sums(rows, ["no_id", "cid", "turn", "krole", "ktext"], {"at": "one"}))
    first = placed.groupBy("no_id", "cid").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("n_turns"))
    placed = placed.join(first, ["no_id", "cid"]).withColumn("pos", F.col("at") - F.col("start")).drop("start")
    digest = F.sha2(F.concat_ws("\u0000", F.col("pos").cast("string"), F.length("krole").cast("string"), "krole", "ktext"), 256)
    lanes = {f"h{k}": F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(LANES)}
    hashed = cut_lineage(placed.withColumns(lanes))
    rolled = cut_lineage(prefix_sums(hashed, ["no_id", "cid", "pos"], {f"s{k}": f"h{k}" for k in range(LANES)}))
    base = rolled.where("pos = 0").select("no_id", "cid", *[F.col(f"s{k}").alias(f"b{k}") for k in range(LANES)])
    prefix = F.concat_ws(":", *[(F.col(f"s{k}") + F.col(f"h{k}") - F.col(f"b{k}")).cast("string") for k in range(LANES)])
    return cut_lineage(rolled.join(base, ["no_id", "cid"]).select("no_id", "cid", "conv_id", "role", "text", "pos", "n_turns", prefix.alias("prefix")))


def maximal(t: DataFrame) -> DataFrame:
    """no_id, cid of the conversations that stay, with how many equal ones they stand for."""
    whole = (t.where("pos = n_turns - 1").groupBy("pos", "prefix")
             .agg(F.min(F.struct("no_id", "cid")).alias("m"), F.count(F.lit(1)).alias("n_equal")))
    inner = t.where("pos < n_turns - 1").select("pos", "prefix").distinct()
    return whole.join(inner, ["pos", "prefix"], "left_anti").select("m.no_id", "m.cid", "n_equal")


def render(t: DataFrame, per_row: int = TURNS) -> DataFrame:
    """conv_id, part, n_turns, text: the chat template over each conversation's turns."""
    turn = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))
    rows = t.withColumns({"part": F.floor(F.col("pos") / per_row).cast("long"), "said": turn})
    in_order = F.array_sort(F.collect_list(F.struct("pos", "said")))
    return rows.groupBy("no_id", "cid", "part", "conv_id", "n_turns", "n_equal").agg(
        F.array_join(F.transform(in_order, lambda x: x["said"]), "").alias("text"))


def query(conversations: DataFrame) -> DataFrame:
    """op10: every maximal conversation, rendered."""
    t = turns(conversations)
    kept = cut_lineage(maximal(t))
    return render(t.join(kept, ["no_id", "cid"])).select("conv_id", "part", "n_turns", "n_equal", "text")


QUERY_SQL = """
WITH k AS (
  SELECT conv_id, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS pos,
         count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM conversations),
h AS (
  SELECT *, string_agg(md5(coalesce('=' || role, '')) || md5(coalesce('=' || text, '')), '')
              OVER (PARTITION BY conv_id ORDER BY pos) AS prefix FROM k),
w AS (
  SELECT min(conv_id) AS conv_id, count(*) AS n_equal, prefix FROM h WHERE pos = n_turns - 1 GROUP BY prefix),
m AS (
  SELECT conv_id, n_equal FROM w WHERE prefix NOT IN (SELECT prefix FROM h WHERE pos < n_turns - 1))
SELECT conv_id, pos // 1024 AS part, any_value(n_turns) AS n_turns, any_value(n_equal) AS n_equal,
       string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text
FROM k JOIN m USING (conv_id) GROUP BY 1, 2
"""
