"""Mixing sources to target weights by entropy balancing.

Among all document rates between 0 and ``cap`` that meet every source's
token target, the ones closest (in relative entropy) to taking each document
once are exponentially tilted: rate = min(cap, exp(lambda * size / mean
size)), one lambda per source.  The lambdas solve a convex dual, found by
Newton steps (kept inside a bracket) for all sources at once: each step is
one aggregate over the table of distinct (source, size) counts.  The rates
are then rounded to whole copies by a hash of the document, and the rounding
error of each source is settled by moving single copies.

Defined results: null or blank texts have size 0 and are taken zero or one
or more times without adding words; a null source is a source of its own
(the last); an empty table gives no rows; repeated rows are rows; other
columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tabmill.llm.common import fresh, join_small, located, prefix_sums
from tabmill.session import cut_lineage

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Relative error at which a source's lambda is solved.
SOLVED = 1e-9
MAX_STEPS = 100
#: Relative error at which a source's rounded total is settled, and the most rounds of moving copies.
SETTLED = 1e-3
MAX_ROUNDS = 24
#: Documents whose copies are broadcast (12 bytes each); more are joined by shuffle.
PICK_ROWS = 1_000_000


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """rid, doc_id, key (the source, null last in code point order), size in
    words and u, a hash of the row in [0, 1); written once."""
    rid = F.col(row_col) if row_col else F.monotonically_increasing_id()
    source = F.col(source_col).cast("string")
    rows = docs.select(
        rid.alias("rid"), F.col(id_col).alias("doc_id"),
        F.when(source.isNull(), F.lit("t")).otherwise(F.concat(F.lit("s"), source)).alias("key"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    return cut_lineage(rows.withColumn("u", _unit("first")))


def _unit(salt: str) -> Column:
    return F.pmod(F.xxhash64("doc_id", "key", "size", F.lit(salt)), F.lit(1 << 52)).cast("double") / float(1 << 52)


def targets(rows: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """key, total, target per source: ``share`` of all words divided by the
    weights (repeating along the sources), none above ``cap`` times its
    source; what is cut off is shared again by weight until none is above."""
    per = cut_lineage(rows.groupBy("key").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("one")))
    ranked = prefix_sums(per.withColumn("one", F.lit(1)), ["key"], {"pos": "one"})
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("pos", F.lit(len(weights))) + 1).cast("int"))
    ranked = cut_lineage(ranked.select("key", "total", w.alias("weight")))
    left = share * float(ranked.agg(F.sum("total")).first()[0] or 0)
    limit = F.col("total") * cap
    per_weight, want = 0.0, left
    while True:
        capped = limit <= F.lit(per_weight) * F.col("weight")
        full, open_weight = ranked.agg(F.coalesce(F.sum(F.when(capped, limit)), F.lit(0.0)),
                                       F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0))).first()
        found = (want - full) / open_weight if open_weight else per_weight
        if found <= per_weight:
            break
        per_weight = found
    return cut_lineage(ranked.select("key", "total", F.least(limit, F.lit(per_weight) * F.col("weight")).alias("target")))


def solve(rows: DataFrame, goal: DataFrame, cap: float) -> DataFrame:
    """key, total, target, mean, lam: the tilt of each source (null where the
    target is the whole cap, so that every document gets it)."""
    hist = cut_lineage(rows.where("size > 0").groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")))
    stats = hist.groupBy("key").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.min("size").alias("least"))
    top = F.log(F.lit(float(cap))) * F.col("mean") / F.col("least")  # there every document is at the cap
    state = cut_lineage(goal.join(stats, "key", "left").select(
        "key", "total", "target", "mean",
        F.when((F.col("total") > 0) & (F.col("target") < F.col("total") * cap * (1 - 1e-12)), F.lit(0.0)).alias("lam"),
        F.lit(None).cast("double").alias("lo"), top.alias("hi"), F.lit(False).alias("done")))
    for _ in range(MAX_STEPS):
        tilt = F.exp(F.col("lam") * F.col("size") / F.col("mean"))
        x = hist.join(F.broadcast(state), "key") if state.count() <= 100_000 else hist.join(state, "key")
        grad = x.where("lam IS NOT NULL AND NOT done").groupBy("key").agg(
            F.sum(F.col("n") * F.col("size") * F.least(F.lit(float(cap)), tilt)).alias("got"),
            F.sum(F.when(tilt < cap, F.col("n") * F.col("size") * F.col("size") / F.col("mean") * tilt)
                  .otherwise(0.0)).alias("slope"))
        g = F.col("got") - F.col("target")
        lo, hi = F.when(g < 0, F.col("lam")).otherwise(F.col("lo")), F.when(g > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.when(F.col("slope") > 0, F.col("lam") - g / F.col("slope"))
        inside = newton.isNotNull() & (newton < hi) & (lo.isNull() | (newton > lo))
        step = F.when(inside, newton).when(lo.isNotNull(), (lo + hi) / 2).otherwise(F.col("lam") - 1)
        done = F.col("done") | F.col("lam").isNull() | (F.abs(g) <= F.lit(SOLVED) * F.col("target"))
        state = cut_lineage(state.join(grad, "key", "left").select(
            "key", "total", "target", "mean", F.when(F.coalesce(done, F.lit(True)), F.col("lam")).otherwise(step).alias("lam"),
            F.coalesce(lo, F.col("lo")).alias("lo"), F.coalesce(hi, F.col("hi")).alias("hi"),
            F.coalesce(done, F.lit(True)).alias("done")))
        if state.where("NOT done").isEmpty():
            break
    return state.select("key", "total", "target", "mean", "lam")


def rounded(rows: DataFrame, tilts: DataFrame, cap: int) -> DataFrame:
    """rows with total, target, rate and whole copies."""
    rate = (F.when(F.col("lam").isNotNull(), F.least(F.lit(float(cap)), F.exp(F.col("lam") * F.col("size") / F.col("mean"))))
            .when(F.col("total") > 0, F.lit(float(cap))).otherwise(F.lit(1.0)))
    out = join_small(rows, tilts, "key").withColumn("rate", rate)
    state = cut_lineage(out.withColumn("copies", F.least(F.lit(cap), F.floor(F.col("rate") + F.col("u"))).cast("int"))
                        .drop("lam", "mean"))
    words = F.col("size") * F.col("copies")
    for turn in range(MAX_ROUNDS):
        gap = state.groupBy("key").agg(
            (F.first("target") - F.sum(words)).alias("gap"), F.first("target").alias("t"),
            F.sum(F.when(F.col("copies") < cap, F.col("size"))).alias("up"), F.sum(F.when(F.col("copies") > 0, F.col("size"))).alias("down"),
            F.sum(F.when((F.col("copies") < cap) & (F.col("size") > 0), 1)).alias("n_up"),
            F.sum(F.when((F.col("copies") > 0) & (F.col("size") > 0), 1)).alias("n_down"))
        up = F.col("gap") > 0
        gap = cut_lineage(gap.where(F.abs("gap") > F.lit(SETTLED) * F.col("t")).select(
            "key", "gap", F.when(up, F.col("up")).otherwise(F.col("down")).alias("open"),
            F.when(up, F.col("n_up")).otherwise(F.col("n_down")).alias("n_open")).where("open > 0"))
        if gap.isEmpty():
            break
        can = F.when(F.col("gap") > 0, F.col("copies") < cap).otherwise(F.col("copies") > 0) & (F.col("size") > 0)
        near = join_small(state.select("rid", "doc_id", "key", "size", "copies", "u"), gap, "key").where(can)
        # many documents short: move a hashed share of them; a few short: move the one that fits best
        many = F.abs("gap") > 8 * F.col("open") / F.col("n_open")
        share = near.where(many & (_unit(f"turn{turn}") < F.abs("gap") / F.col("open"))).select("rid", "gap")
        fit = F.abs(F.abs("gap") - F.col("size"))
        one = (near.where(~many & (fit < F.abs("gap"))).groupBy("key")
               .agg(F.min(F.struct(fit.alias("f"), F.col("u"), F.col("doc_id"), F.col("rid"), F.col("gap"))).alias("m"))
               .select("m.rid", "m.gap"))
        moves = cut_lineage(share.unionByName(one).select("rid", F.when(F.col("gap") > 0, 1).otherwise(-1).alias("move")))
        if moves.isEmpty():
            break
        state = cut_lineage(state.join(moves, "rid", "left")
                            .withColumn("copies", F.col("copies") + F.coalesce("move", F.lit(0))).drop("move"))
    return state


def balance(rows: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """``rows`` (of ``measured``) with total, target, rate and copies."""
    goal = targets(rows, weights, share, cap)
    return rounded(rows, solve(rows, goal, cap), cap)


def query(docs: DataFrame) -> DataFrame:
    """Contract columns of op1, one row per document."""
    return balance(measured(docs)).select(
        "doc_id", "size", F.col("total").alias("source_size"), "target",
        (F.col("size") * F.col("copies")).alias("taken"), "rate", "copies")


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: int = 2, id_col: str = "doc_id") -> DataFrame:
    """The mix itself: the rows of ``docs``, each repeated as often as it is
    taken (not at all for zero copies), all columns."""
    held, rid = located(docs, id_col)
    n = fresh(docs, "copies")
    took = cut_lineage(balance(measured(held, id_col, row_col=rid), weights, share, cap).where("copies > 0")
                       .select(F.col("rid").alias(rid), F.col("copies").alias(n)))
    taken = held.join(F.broadcast(took) if took.count() <= PICK_ROWS else took, rid)
    return taken.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(docs.columns)
