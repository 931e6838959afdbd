"""Quality classifier by compression.

Two zstandard dictionaries are built from good and bad labelled text.  Every
whole text is compressed with either, in pieces (so that a long text cannot
become its own dictionary); the normalised difference of the compressed
sizes, beside the compressed share and the length, is turned into a
probability by a logistic calibration fitted on other labelled rows.

The fit uses a bounded sample (``FIT_ROWS`` labelled rows per class and use,
chosen by a hash of the id; the dictionaries learn from their whole texts, or
from evenly spread pieces of all of them where a class has more than
``FIT_BYTES``); scoring reads every row and whole text.

Defined results: null texts count as empty; an empty text is scored like any
other (its sizes are 0); of repeated labels of a document the lowest counts,
null labels none; with labels of one class or none the score is the share of
label 1 (0.5 without labels); an empty table gives no rows; other columns
pass through unread, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tabmill.llm.common import fresh
from tabmill.session import cut_lineage

#: Labelled rows per class for the dictionaries, and as many for the calibration.
FIT_ROWS = 2_000
#: Bytes of a piece, and of a class's samples for its dictionary (a piece of each text at least).
PIECE, FIT_BYTES = 1024, 32 << 20
#: Largest dictionary in bytes; smaller if either class has less than 8 times that in samples.
DICT_BYTES = 65_536
LEVEL = 1
RIDGE = 1e-4


@dataclass(frozen=True)
class Model:
    """Dictionaries of the bad and the good class, calibration weights and
    the constant score used without dictionaries."""
    dicts: tuple[bytes, bytes] | None
    weights: tuple[float, ...]
    constant: float


def _compressors(dicts: tuple[bytes, bytes]):
    import zstandard
    out = []
    for d in dicts:
        data = zstandard.ZstdCompressionDict(d)
        data.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False))
    return out


def _train(samples: list[bytes], size: int) -> bytes:
    import zstandard
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples: their end is the dictionary
        return b"".join(samples)[-size:]


def _sizes(dicts: tuple[bytes, bytes]):
    """Pandas UDF: compressed bytes with the bad and the good dictionary, and bytes."""
    cache: list = []

    @F.pandas_udf("bad long, good long, raw long")
    def sizes(texts: pd.Series) -> pd.DataFrame:
        if not cache:
            cache.extend(_compressors(dicts))
        rows = []
        for t in texts:
            t = t or b""
            pieces = [t[i:i + PIECE] for i in range(0, len(t), PIECE)]
            rows.append((*(sum(len(c.compress(p)) for p in pieces) for c in cache), len(t)))
        return pd.DataFrame(rows, columns=["bad", "good", "raw"])
    return sizes


def _features(s: str) -> list[Column]:
    both, raw = F.col(f"{s}.bad") + F.col(f"{s}.good"), F.col(f"{s}.raw")
    diff = F.coalesce((F.col(f"{s}.bad") - F.col(f"{s}.good")) / F.nullif(both, F.lit(0)), F.lit(0.0))
    share = F.coalesce(both / F.nullif(2 * raw, F.lit(0)), F.lit(0.5))
    return [F.lit(1.0), 20 * diff, 4 * share, F.least(F.greatest(20 * diff, F.lit(-1.0)), F.lit(1.0)),
            F.least(share, F.lit(0.1)) * 20, F.log1p(raw.cast("double")) / 4]


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) / len(y) + RIDGE * w
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(y) + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", fit_rows: int = FIT_ROWS) -> Model:
    """Train on the labelled rows given; the sample reaches the driver
    (at most 4 x ``fit_rows`` rows: pieces of half of them, sizes of the rest)."""
    ids = docs.select(F.col(id_col).alias("doc_id")).distinct()
    known = (labels.groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).alias("y"))
             .where("doc_id IS NOT NULL AND y IN (0, 1)").join(ids, "doc_id", "left_semi")
             .withColumn("h", F.xxhash64(F.col("doc_id").cast("string"))))
    picks = None
    for y in (0, 1):
        for use in (0, 1):
            part = known.where((F.col("y") == y) & (F.pmod("h", F.lit(2)) == use)).orderBy("h").limit(fit_rows).withColumn("use", F.lit(use))
            picks = part if picks is None else picks.union(part)
    picks = cut_lineage(picks.select("doc_id", "y", "use"))
    text = F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b""))
    rows = (docs.select(F.col(id_col).alias("doc_id"), text.alias("t")).join(F.broadcast(picks), "doc_id")
            .dropDuplicates(["doc_id"]))
    share = [(r["y"], r["n"]) for r in picks.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()]
    constant = sum(n for y, n in share if y == 1) / max(1, sum(n for _, n in share)) if share else 0.5
    rows = cut_lineage(rows)
    learn = rows.where("use = 0 AND length(t) > 0")
    every = F.lit(1)  # of its pieces a text gives each, or each second, third ... one
    for r in learn.groupBy("y").agg(F.sum(F.length("t").cast("long")).alias("n")).collect():
        every = F.when(F.col("y") == r["y"], F.lit(max(1, -(-r["n"] // FIT_BYTES)))).otherwise(every)
    starts = F.sequence(F.lit(0), F.floor((F.length("t") - 1) / PIECE).cast("int"), every.cast("int"))
    pieces = F.transform(starts, lambda k: F.substring("t", k * PIECE + 1, F.lit(PIECE)))
    got = learn.select("doc_id", "y", pieces.alias("p")).orderBy("doc_id").collect()
    samples = [[bytes(p) for r in got if r["y"] == y for p in r["p"] if p] for y in (0, 1)]
    if not all(samples):
        return Model(None, (), constant)
    size = max(256, min(DICT_BYTES, *(sum(map(len, s)) // 8 for s in samples)))
    dicts = (_train(samples[0], size), _train(samples[1], size))
    cal = (rows.where("use = 1").withColumn("s", _sizes(dicts)("t")).select("doc_id", "y", F.array(*_features("s")).alias("x"))
           .orderBy("doc_id").collect())
    if len({r["y"] for r in cal}) < 2:
        return Model(dicts, tuple(float(v) for v in (0, 1, 0, 0, 0, 0)), constant)
    w = _logistic(np.array([r["x"] for r in cal]), np.array([r["y"] for r in cal], float))
    return Model(dicts, tuple(map(float, w)), constant)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1."""
    if model.dicts is None:
        return docs.withColumn(out, F.lit(float(model.constant)))
    s = fresh(docs, "sizes")
    z = sum((F.lit(w) * x for w, x in zip(model.weights, _features(s))), F.lit(0.0))
    text = F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b""))
    return docs.withColumn(s, _sizes(model.dicts)(text)).withColumn(out, 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), z)))).drop(s)


def held_out(id_col: str = "doc_id") -> Column:
    """The fold whose labels are never learned."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract columns of op8, one row per document."""
    model = fit(docs, labels.where(~held_out()))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, all columns."""
    out = fresh(docs, "score")
    return score(docs, fit(docs, labels.where(~held_out())), out=out).where(F.col(out) >= 0.5).drop(out)
