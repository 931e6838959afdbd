"""Byte-level BPE encoding and decoding with the tiktoken library.

The rank file is read once on the driver and sent to the executors (its size
is checked); every Python worker builds one encoder.  Texts of more than
``LONG`` characters are cut before they are encoded, only where a match of
the pattern must end whatever follows: between a non-space and a white space
and between an ASCII letter and an ASCII digit.  Runs of white space too
long for the library's look-ahead are taken apart as the pattern would.
Decoding joins the tokens' raw bytes, so text comes back byte for byte even
where a token holds half a character.

Defined results: null counts as empty; an empty text has no ids; bytes that
are not UTF-8 are encoded as U+FFFD; an empty table gives no rows; repeated
rows are rows; other columns pass through unread, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tabmill.llm.common import fresh

#: Characters up to which a text is encoded in one go.
LONG = 32_768
#: White space as the pattern's \s has it.
_WS = "\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_CUT = re.compile(f"(?<=[^{_WS}])(?=[{_WS}])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
_RUN = re.compile(f"[{_WS}]{{10000,}}")
#: Largest rank file that is sent to the executors.
RANK_BYTES = 64 << 20
_ENCODERS: dict[str, object] = {}


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(RANK_BYTES + 1)
    if len(data) > RANK_BYTES:
        raise ValueError(f"the rank file is larger than {RANK_BYTES} bytes")
    return data


def encoder(ranks: bytes, pattern: str):
    """The worker's encoder for these ranks, built once."""
    import tiktoken
    key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if key not in _ENCODERS:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _ENCODERS[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _ENCODERS[key]


def _cut(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > LONG:
        m = _CUT.search(text, start + LONG)
        if not m:
            break
        yield text[start:m.start()]
        start = m.start()
    yield text[start:]


def encode_text(enc, text: str) -> list[int]:
    """Ids of one text, as ``encode_ordinary`` gives them."""
    if len(text) <= LONG:
        return enc.encode_ordinary(text)
    ids, start = [], 0
    for run in _RUN.finditer(text):
        for piece in _cut(text[start:run.start()]):
            ids += enc.encode_ordinary(piece)
        # the last space of a run belongs to the next match, unless the text ends
        start = run.end() if run.end() == len(text) else run.end() - 1
        ids += enc._encode_single_piece(text[run.start():start])
    for piece in _cut(text[start:]):
        ids += enc.encode_ordinary(piece)
    return ids


def _ids(enc, data: bytes | None) -> bytes:
    return np.array(encode_text(enc, (data or b"").decode("utf-8", "replace")), dtype="<u4").tobytes()


def _codec(spark, path: str, pattern: str):
    ranks = spark.sparkContext.broadcast(read_ranks(path))
    return lambda: encoder(ranks.value, pattern)


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the ids of the text as little-endian unsigned 32-bit integers (binary)."""
    get = _codec(df.sparkSession, path, pattern)

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        enc = get()
        return texts.map(lambda t: _ids(enc, t))
    return df.withColumn(out, run(F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b""))))


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the raw bytes that the ids stand for (null ids: none)."""
    get = _codec(df.sparkSession, path, pattern)

    @F.pandas_udf("binary")
    def run(ids: pd.Series) -> pd.Series:
        enc = get()
        return ids.map(lambda b: enc.decode_bytes(np.frombuffer(b or b"", "<u4").tolist()))
    return df.withColumn(out, run(F.col(ids_col)))


def round_trip(df: DataFrame, path: str, pattern: str, text_col: str = "text",
               ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the ids and the decoded bytes, by one pass through one worker."""
    get = _codec(df.sparkSession, path, pattern)

    @F.pandas_udf("ids binary, decoded binary")
    def run(texts: pd.Series) -> pd.DataFrame:
        enc = get()
        ids = [_ids(enc, t) for t in texts]
        return pd.DataFrame({"ids": ids, "decoded": [enc.decode_bytes(np.frombuffer(b, "<u4").tolist()) for b in ids]})
    both = fresh(df, "codec")
    return (df.withColumn(both, run(F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b""))))
            .withColumns({ids_col: F.col(f"{both}.ids"), out: F.col(f"{both}.decoded")}).drop(both))


def query(docs: DataFrame) -> DataFrame:
    """Contract columns of op3, one row per document."""
    import public_tokenizers as vocab
    done = round_trip(docs.select("doc_id", "text"), vocab.path("byte_bpe_50k.tiktoken"), vocab.PATTERN)
    return done.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
