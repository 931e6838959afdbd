"""Embedding near-duplicates by dual traversal of cover trees.

Unit vectors are compared by chord distance d, where d^2 = 2 - 2 cos.  Equal
directions are one point with a weight.  Points are dealt into blocks around
pivots; every block gets a cover tree: nested levels whose radii halve, each
level's centres a net of the level below, each node with the largest
distance to any point under it.  Two trees (or a tree and itself) are
traversed together: a pair of nodes farther apart than the wanted distance
plus both covering radii is pruned, a pair so close that all its points must
link is counted as a whole, others descend; pairs of points are decided by
their cosine in double precision.

Spark deals the pairs of blocks, pruned by the blocks' own covering balls.
Each pair of blocks yields link counts per point and the edges of a spanning
forest, never its pairs; the forests' edges give the components.

In high-dimensional noise all distances are alike and ball bounds prune
little above the level of near copies; then block pairs grow with the square
of the number of blocks, though memory and shuffled rows per task do not.

Defined results: null, zero and non-finite vectors (and vectors with null
components) link with nothing; vectors of other lengths link with nothing of
this length; a null vec_id takes part and counts, but names no component
unless alone; repeated rows are vectors of their own; an empty table gives
no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tabmill.llm.common import components, join_small
from tabmill.session import cut_lineage

#: Cosine from which two vectors link.
COSINE = 0.9
#: Points of a block, pivots at most (fitted on a hashed sample of as many points), entries of one batch of node pairs.
BLOCK, PIVOTS, BATCH = 2048, 4096, 200_000
#: Children of a node pair from which they are pruned by a matrix product.
DENSE = 4096
#: Safety of the distance bounds against rounding.
SLACK = 1e-9
#: How near 1 a cosine is too coarse for the distance.
CLOSE = 1e-6
#: And of cosines in single precision.
MARGIN = 1e-4
#: Blocks of a tile at most: the pairs of two tiles' blocks are joined in one task.
TILE = 8


def _net(cos: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """Greedy net by the points' cosines: indices of centres at most r from
    their points, and each point's centre."""
    near, owner, centres = cos >= 1 - r * r / 2, np.full(len(cos), -1), []
    for c in range(len(cos)):
        if owner[c] < 0:
            owner[near[c] & (owner < 0)] = len(centres)
            owner[c] = len(centres)
            centres.append(c)
    return np.array(centres), owner


def _chord(x: np.ndarray, y: np.ndarray, cos: np.ndarray) -> np.ndarray:
    """Distances of the rows of x and y (or its one row), whose cosines are
    known: these give them, but lose the digits of very small ones, which
    come from the differences."""
    d = np.sqrt(np.maximum(0.0, 2 - 2 * cos))
    small = np.flatnonzero(cos > 1 - CLOSE)
    if len(small):
        d[small] = np.sqrt(np.square(x[small] - (y if len(y) == 1 else y[small])).sum(axis=1))
    return d


def build_tree(x: np.ndarray, theta: float) -> list[dict]:
    """Levels from the root down, radii halving from 4 theta to theta / 16;
    the last level is the points.  Each level: centre (a row of x),
    radius (largest distance below), kids (indices into the next level)."""
    levels = [{"centre": np.arange(len(x)), "kids": None}]
    cos = x @ x.T
    radii = [4 * theta / 2 ** k for k in range(7)]
    if radii[0] < 2:
        radii.insert(0, 2.0)
    # nets are nested bottom up: the centres of a level are among those of the one below
    for r in reversed(radii):
        low = levels[0]["centre"]
        if len(low) == 1:
            break
        centres, owner = _net(cos[np.ix_(low, low)] if len(low) < len(x) else cos, r)
        if len(centres) == len(low):
            continue
        order = np.argsort(owner, kind="stable")
        kids = np.split(order, np.cumsum(np.bincount(owner, minlength=len(centres)))[:-1])
        levels.insert(0, {"centre": low[centres], "kids": kids})
    levels[-1]["radius"] = np.zeros(len(x))
    for k in range(len(levels) - 2, -1, -1):
        up = levels[k]
        below = [under(levels, k, v) for v in range(len(up["centre"]))]
        up["radius"] = np.array([_chord(x[u], x[[c]], cos[c, u]).max() if len(u) > 1 else 0.0 for u, c in zip(below, up["centre"])])
    return levels


def under(levels: list[dict], level: int, node: int) -> np.ndarray:
    """The points under a node."""
    nodes = np.array([node])
    for k in range(level, len(levels) - 1):
        nodes = np.concatenate([levels[k]["kids"][v] for v in nodes])
    return nodes


def traverse(x: np.ndarray, tx: list[dict], y: np.ndarray, ty: list[dict], cosine: float, same: bool) -> Iterator[tuple]:
    """("all", under_x, under_y) for node pairs that link as a whole and
    ("pairs", i, j) for linked points.  ``same``: both trees are one; every
    unordered pair of nodes is met once, and a node meets itself."""
    theta = np.sqrt(2 - 2 * cosine)
    x32 = x.astype(np.float32)
    y32 = x32 if same else y.astype(np.float32)
    stack = [(0, 0, *_kid_pairs(np.arange(len(tx[0]["centre"])), np.arange(len(ty[0]["centre"])), same))]
    while stack:
        lx, ly, i, j = stack.pop()
        nx, ny = tx[lx], ty[ly]
        leaf = nx["kids"] is None and ny["kids"] is None
        for a in range(0, len(i), BATCH):
            pi, pj = i[a:a + BATCH], j[a:a + BATCH]
            cos = np.einsum("ij,ij->i", x[nx["centre"][pi]], y[ny["centre"][pj]])
            if leaf:
                hit = (cos >= cosine) & (pi != pj if same else True)
                if hit.any():
                    yield "pairs", pi[hit], pj[hit]
                continue
            d = _chord(x[nx["centre"][pi]], y[ny["centre"][pj]], cos)
            reach = nx["radius"][pi] + ny["radius"][pj]
            whole = d + reach <= theta - SLACK
            for u, v in zip(pi[whole], pj[whole]):
                points_u = under(tx, lx, u)
                yield "all", points_u, points_u if same and u == v else under(ty, ly, v)
            go = ~whole & (d <= theta + reach + SLACK)
            pi, pj = pi[go], pj[go]
            # the trees descend side by side, so that their widest levels meet in one matrix product
            down_x, down_y = nx["kids"] is not None, ny["kids"] is not None
            ux, uy = tx[lx + down_x], ty[ly + down_y]
            few = []
            for u, v in zip(pi, pj):
                ki = nx["kids"][u] if down_x else np.array([u])
                kj = ny["kids"][v] if down_y else np.array([v])
                if len(ki) * len(kj) >= DENSE:  # very many children: prune them by one matrix product
                    p, q = _within(x32[ux["centre"][ki]], ux["radius"][ki], y32[uy["centre"][kj]], uy["radius"][kj], theta)
                    p, q = ki[p], kj[q]
                    if same and u == v:
                        p, q = p[p <= q], q[p <= q]
                    few.append((p, q))
                else:
                    few.append(_kid_pairs(ki, kj, same and u == v))
            if few:
                stack.append((lx + down_x, ly + down_y, np.concatenate([p for p, _ in few]), np.concatenate([q for _, q in few])))


def _within(x: np.ndarray, rx: np.ndarray, y: np.ndarray, ry: np.ndarray, theta: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes that the balls may hold links of, in single precision
    with a margin (all that are left are looked at again in double): nodes of
    little extent at once by their largest radius, the others by their own."""
    found = []
    ax, ay = rx <= theta / 8, ry <= theta / 8
    for a in (ax, ~ax):
        for b in (ay, ~ay):
            i, j = np.flatnonzero(a), np.flatnonzero(b)
            if len(i) and len(j):
                reach = theta + (rx[i].max() + ry[j].max() if a is ax and b is ay else rx[i][:, None] + ry[j][None])
                hit = x[i] @ y[j].T >= (1 - reach * reach / 2 - MARGIN)
                p, q = np.nonzero(hit)
                found.append((i[p], j[q]))
    return np.concatenate([p for p, _ in found]), np.concatenate([q for _, q in found])


def _kid_pairs(p: np.ndarray, q: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray]:
    if own:
        a, b = np.triu_indices(len(p))
        return p[a], p[b]
    return np.repeat(p, len(q)), np.tile(q, len(p))


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n nodes over the edges i-j."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        open_ = root[i] != root[j]
        i, j = i[open_], j[open_]
    return root


def link_blocks(x: np.ndarray, wx: np.ndarray, y: np.ndarray, wy: np.ndarray, cosine: float, same: bool, tx: list | None = None, ty: list | None = None):
    """Links of two blocks: weighted counts per point of either side, and
    spanning edges between positions (x first, then y)."""
    theta = np.sqrt(2 - 2 * cosine)
    tx = tx or build_tree(x, theta)
    ty = tx if same else ty or build_tree(y, theta)
    off = 0 if same else len(x)
    got_x, got_y = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    if same:
        got_y = got_x
    a, b = [], []
    for kind, i, j in traverse(x, tx, y, ty, cosine, same):
        if kind == "pairs":
            np.add.at(got_x, i, wy[j])
            np.add.at(got_y, j, wx[i])
            a.append(i)
            b.append(j + off)
        elif same and i is j:
            got_x[i] += wx[i].sum() - wx[i]
            a.append(i)
            b.append(np.full(len(i), i[0]))
        else:
            got_x[i] += wy[j].sum()
            got_y[j] += wx[i].sum()
            a += [i, np.full(len(j), i[0])]
            b += [np.full(len(i), j[0]) + off, j + off]
    cat = lambda p: np.concatenate(p).astype(np.int64) if p else np.zeros(0, np.int64)
    root = _forest(len(x) + (0 if same else len(y)), cat(a), cat(b))
    return got_x, got_y, root


def points(rows: DataFrame) -> DataFrame:
    """pid, dim, w, unit (float64 bytes): one point per distinct direction of
    the usable vectors, and the pid of every row in ``rows``' order."""
    def unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out, dims = [], []
            for e in p["embedding"]:
                v = None if e is None else np.array([np.nan if c is None else c for c in e], np.float64)
                ok = v is not None and len(v) and np.isfinite(v).all() and v.any()
                if ok:
                    v = v / np.abs(v).max()  # so that the norm can't overflow
                    v = v / np.sqrt(v @ v)
                out.append((v + 0.0).tobytes() if ok else None)
                dims.append(len(v) if ok else 0)
            yield pd.DataFrame({"rid": p["rid"], "unit": out, "dim": dims})
    return cut_lineage(rows.mapInPandas(unit, "rid long, unit binary, dim int"))


def _blocks(pts: DataFrame) -> DataFrame:
    """pid, dim, w, unit, block: points around pivots, at most ``BLOCK`` per block.

    The pivots are a hashed sample of the points; each point goes to its
    nearest.  Pivots with more points are split by a hash of the point.
    """
    n = pts.count()
    want = min(PIVOTS, n // BLOCK)
    if want > 1:
        rows = pts.orderBy(F.xxhash64("unit"), "pid").limit(want).select("dim", "unit").collect()
        by_dim: dict[int, np.ndarray] = {}
        for d in {r["dim"] for r in rows}:
            by_dim[d] = np.array([np.frombuffer(bytes(r["unit"])) for r in rows if r["dim"] == d])
        held = pts.sparkSession.sparkContext.broadcast(by_dim)  # at most PIVOTS vectors

        @F.pandas_udf("int")
        def nearest(dim: pd.Series, unit: pd.Series) -> pd.Series:
            out = np.zeros(len(dim), np.int64)
            for d, c in held.value.items():
                at = np.flatnonzero(dim.to_numpy() == d)
                for k in range(0, len(at), 1024):
                    x = np.frombuffer(b"".join(unit.iloc[at[k:k + 1024]])).reshape(-1, d)
                    out[at[k:k + 1024]] = (x @ c.T).argmax(axis=1)
            return pd.Series(out.astype(np.int32))
        pts = cut_lineage(pts.withColumn("pivot", nearest("dim", "unit")))
    else:
        pts = pts.withColumn("pivot", F.lit(0))
    per = cut_lineage(pts.groupBy("dim", "pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
                      .withColumn("cell", F.concat_ws(":", "dim", "pivot")).select("cell", "parts"))
    split = join_small(pts.withColumn("cell", F.concat_ws(":", "dim", "pivot")), per, "cell")
    return cut_lineage(split.withColumn("block", F.concat_ws(":", "cell", F.pmod(F.xxhash64("pid"), F.col("parts")).cast("string")))
                       .select("pid", "dim", "w", "unit", "block"))


def _packed(theta: float):
    def pack(p: pd.DataFrame) -> pd.DataFrame:
        """A block as one row: its points, centre, covering radius and tree."""
        d = int(p["dim"].iloc[0])
        p = p.sort_values("pid")
        x = np.frombuffer(b"".join(p["unit"])).reshape(-1, d)
        c = x.mean(axis=0)
        radius = float(np.sqrt(((x - c) ** 2).sum(axis=1).max()))
        return pd.DataFrame({"block": [p["block"].iloc[0]], "dim": [d], "ids": [p["pid"].to_numpy(np.int64).tobytes()],
                             "w": [p["w"].to_numpy(np.int64).tobytes()], "x": [x.tobytes()], "centre": [c.tolist()], "radius": [radius],
                             "tree": [_dump(build_tree(x, theta))]})
    return pack


def _dump(levels: list[dict]) -> bytes:
    """The levels as arrays: node counts, then centres, radii and, but for the last, kids and their numbers."""
    parts = [np.array([len(levels), *(len(v["centre"]) for v in levels)], np.float64)]
    for v in levels:
        parts += [v["centre"], v["radius"]]
        if v["kids"] is not None:
            parts += [[len(k) for k in v["kids"]], np.concatenate(v["kids"])]
    return np.concatenate([np.asarray(p, np.float64) for p in parts]).tobytes()


def _load(data: bytes) -> list[dict]:
    flat = np.frombuffer(data)
    sizes = flat[1:1 + int(flat[0])].astype(np.int64)
    at, out = 1 + len(sizes), []
    for k, n in enumerate(sizes):
        level = {"centre": flat[at:at + n].astype(np.int64), "radius": flat[at + n:at + 2 * n], "kids": None}
        at += 2 * n
        if k + 1 < len(sizes):
            cuts = np.cumsum(flat[at:at + n].astype(np.int64))
            level["kids"] = np.split(flat[at + n:at + n + sizes[k + 1]].astype(np.int64), cuts[:-1])
            at += n + sizes[k + 1]
        out.append(level)
    return out


def links(pts: DataFrame, cosine: float = COSINE) -> tuple[DataFrame, DataFrame]:
    """(pid, n: weighted links to other points) and spanning edges (a, b)."""
    packed = cut_lineage(_blocks(pts).groupBy("block").applyInPandas(
        _packed(float(np.sqrt(2 - 2 * cosine))),
        "block string, dim int, ids binary, w binary, x binary, centre array<double>, radius double, tree binary"))
    # one number per block (only the names meet in one task); each then names its partners with higher numbers
    numbers = cut_lineage(packed.select("block").withColumn("no", (F.row_number().over(Window.orderBy("block")) - 1).cast("int")))
    n = numbers.count()
    numbered = join_small(packed, numbers, "block")
    balls = numbered.select("no", "dim", "centre", "radius")
    a = balls.select(F.col("no").alias("i"), F.col("dim").alias("dim_i"), F.col("centre").alias("ci"), F.col("radius").alias("ri"),
                     F.explode(F.sequence("no", F.lit(max(0, n - 1)))).alias("j"))
    b = balls.select(F.col("no").alias("j"), F.col("dim").alias("dim_j"), F.col("centre").alias("cj"), F.col("radius").alias("rj"))
    gap = F.sqrt(F.aggregate(F.zip_with("ci", "cj", lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v))
    near = cut_lineage(a.join(b, "j").where("dim_i = dim_j")
                       .where(gap <= float(np.sqrt(2 - 2 * cosine)) + F.col("ri") + F.col("rj") + SLACK).select("i", "j"))
    # pairs of blocks are dealt in tiles, so that a block travels once per tile and not once per pair
    tile = max(1, min(TILE, n // 8))
    keyed = near.select((F.col("i") / tile).cast("int").alias("ti"), (F.col("j") / tile).cast("int").alias("tj"), "i", "j")
    wants = (keyed.select("ti", "tj", F.col("i").alias("no"), F.col("j").alias("with"))
             .union(keyed.select("ti", "tj", F.col("j").alias("no"), F.lit(None).cast("int")))
             .groupBy("ti", "tj", "no").agg(F.collect_set("with").alias("with")))  # at most TILE partners
    sides = wants.join(numbered.select("no", "dim", "ids", "w", "x", "tree"), "no")

    def meet(p: pd.DataFrame) -> pd.DataFrame:
        held = {}
        for _, r in p.iterrows():
            held[r["no"]] = (np.frombuffer(r["ids"], np.int64), np.frombuffer(r["w"], np.int64),
                             np.frombuffer(r["x"]).reshape(-1, int(r["dim"])), _load(r["tree"]))
        out = []
        for i, partners in zip(p["no"], p["with"]):
            for j in sorted(partners):
                (ia, wa, xa, ta), (ib, wb, xb, tb) = held[i], held[j]
                got_x, got_y, root = link_blocks(xa, wa, xb, wb, cosine, i == j, ta, tb)
                every = ia if i == j else np.concatenate([ia, ib])
                got = got_x if i == j else np.concatenate([got_x, got_y])
                some = (got > 0) | (root != np.arange(len(root)))
                out.append(pd.DataFrame({"pid": every[some], "n": got[some], "root": every[root[some]]}))
        return pd.concat(out) if out else pd.DataFrame({"pid": [], "n": [], "root": []}, dtype="int64")
    met = cut_lineage(sides.groupBy("ti", "tj").applyInPandas(meet, "pid long, n long, root long"))
    counts = met.groupBy("pid").agg(F.sum("n").alias("n"))
    return counts, met.where("pid != root").select(F.col("pid").alias("a"), F.col("root").alias("b")).distinct()


def near_duplicates(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows = cut_lineage(embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("embedding"))
                       .withColumn("rid", F.monotonically_increasing_id()))
    units = points(rows.select("rid", "embedding"))
    pts = cut_lineage(units.where("unit IS NOT NULL").groupBy("unit", "dim").agg(F.min("rid").alias("pid"), F.count(F.lit(1)).alias("w")))
    counts, edges = links(pts, cosine)
    labels = components(edges).withColumnRenamed("node", "pid")
    named = cut_lineage(pts.join(counts, "pid", "left").join(labels, "pid", "left").select(
        "unit", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("root", "pid").alias("comp")))
    of = rows.select("rid", "vec_id").join(units.select("rid", "unit"), "rid").join(named, "unit", "left")
    of = cut_lineage(of.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "comp"))
    least = of.where("comp IS NOT NULL").groupBy("comp").agg(F.min("vec_id").alias("least"))
    return of.join(least, "comp", "left").select(
        "vec_id", "n_links", F.coalesce("least", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(embeddings: DataFrame) -> DataFrame:
    """Contract columns of op6, one row per vector."""
    return near_duplicates(embeddings)
