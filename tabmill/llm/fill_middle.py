"""Fill-in-the-middle transformation by a ``pyarrow.compute`` pipeline.

Per batch the texts are marked and split into list arrays of units, the lists
are flattened with their parents' indices, each unit gets its ordinal within
its text, and two cuts per text give it a role (prefix, middle or suffix).
Each role's units are filtered out, rebuilt into lists and put together by
``binary_join``; the pieces are joined with the sentinels in the text's form.
A batch is worked off in slices of at most ``SLICE`` bytes of text (or one
text), so memory does not grow with the batch.

The cuts and the form come from a hash of the seed and the document's id, so
a lost task gives the same rows again.  ``restore`` takes an output apart at
its sentinels and gives the text back: a text that holds one is never cut,
and no sentinel can arise between a piece and a neighbouring sentinel.

Defined results: null counts as empty; an empty text is plain with no units;
a null id hashes as the empty string; bytes that are not UTF-8 come back as
they were; repeated rows are rows (and equal ids are cut alike); an empty
table gives no rows; other columns pass through unread, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tabmill.llm.common import fresh

#: Units: a word with the white space before it, or white space at the end.
UNIT = rb"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+)"
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Percent of the texts that are transformed, and of these with the suffix first.
RATE, SPM = 50, 80
SEED = "42"
#: Bytes of text that are worked off at once.
SLICE = 2 << 20
_FIELDS = (("n_units", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.binary()))
_TYPE = "struct<n_units: bigint, form: string, prefix_chars: bigint, middle_chars: bigint, output: binary>"


def draws(seed: str, id_col: str) -> Column:
    """Four numbers below 2^32 from the hash of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])


def _slices(texts: pa.BinaryArray) -> Iterator[tuple[int, int]]:
    """Start and length of runs of rows with at most ``SLICE`` bytes, or one row."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE, side="right")))
        yield start, stop - start
        start = stop


def _escaped(texts: pa.Array) -> pa.Array:
    """The texts without the byte 0, which then marks the end of a unit."""
    return pc.replace_substring(pc.replace_substring(texts, b"\x01", b"\x01a"), b"\x00", b"\x01b")


def _plain(texts: pa.Array) -> pa.Array:
    return pc.replace_substring(pc.replace_substring(texts, b"\x01b", b"\x00"), b"\x01a", b"\x01")


def units(texts: pa.Array) -> pa.ListArray:
    """Lists of (escaped) units; the last element of each list is empty and not a unit."""
    return pc.split_pattern(pc.replace_substring_regex(_escaped(texts), pattern=UNIT, replacement=b"\\1\x00"), b"\x00")


def _mod(a: pa.Array, b: pa.Array) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def _chars(pieces: pa.Array) -> pa.Array:
    """Code points (bytes that do not continue one; the view checks nothing)."""
    return pc.utf8_length(pieces.view(pa.string())).cast(pa.int64())


def _holds_sentinel(texts: pa.Array) -> pa.Array:
    return pc.or_(pc.or_(pc.match_substring(texts, PREFIX), pc.match_substring(texts, SUFFIX)), pc.match_substring(texts, MIDDLE))


def fill_middle(texts: pa.Array, h: list[pa.Array], rate: int, spm: int) -> pa.StructArray:
    lists = units(texts)
    n = pc.subtract(pc.list_value_length(lists).cast(pa.int64()), 1)
    one, other = (_mod(x, pc.add(n, 1)) for x in h[:2])
    first, second = pc.min_element_wise(one, other), pc.max_element_wise(one, other)

    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    starts = pa.array(np.cumsum(np.concatenate([[0], pc.list_value_length(lists).to_numpy(zero_copy_only=False)]))[:-1])
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), starts.take(parent))
    a, b, end = first.take(parent), second.take(parent), n.take(parent)
    roles = {"prefix": (pc.less(ordinal, a), first),
             "middle": (pc.and_(pc.greater_equal(ordinal, a), pc.less(ordinal, b)), pc.subtract(second, first)),
             "suffix": (pc.and_(pc.greater_equal(ordinal, b), pc.less(ordinal, end)), pc.subtract(n, second))}
    piece = {}
    for role, (mask, count) in roles.items():
        offsets = np.concatenate([[0], np.cumsum(count.to_numpy(zero_copy_only=False))]).astype(np.int32)
        piece[role] = _plain(pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), flat.filter(mask)), b""))

    plain = pc.or_(pc.or_(pc.equal(n, 0), _holds_sentinel(texts)), pc.greater_equal(_mod(h[2], pa.scalar(100)), rate))
    suffix_first = pc.less(_mod(h[3], pa.scalar(100)), spm)
    none = pa.scalar(b"")
    psm = pc.binary_join_element_wise(PREFIX, piece["prefix"], SUFFIX, piece["suffix"], MIDDLE, piece["middle"], none)
    other_form = pc.binary_join_element_wise(SUFFIX, piece["suffix"], PREFIX, piece["prefix"], MIDDLE, piece["middle"], none)
    null = pa.scalar(None, pa.int64())
    columns = [n, pc.if_else(plain, "plain", pc.if_else(suffix_first, "spm", "psm")),
               pc.if_else(plain, null, _chars(piece["prefix"])), pc.if_else(plain, null, _chars(piece["middle"])),
               pc.if_else(plain, texts, pc.if_else(suffix_first, other_form, psm))]
    return pa.StructArray.from_arrays([c.cast(t) for c, (_, t) in zip(columns, _FIELDS)], names=[k for k, _ in _FIELDS])


def rebuilt(outputs: pa.Array, forms: pa.Array) -> pa.Array:
    """The texts behind outputs and their forms."""
    plain = pc.equal(forms, "plain")
    parts = pc.split_pattern_regex(pc.if_else(plain, PREFIX + SUFFIX + MIDDLE, outputs), b"<[PSM]>")
    first, second, middle = (pc.list_element(parts, k) for k in (1, 2, 3))
    suffix_first = pc.equal(forms, "spm")
    whole = pc.binary_join_element_wise(pc.if_else(suffix_first, second, first), middle, pc.if_else(suffix_first, first, second), b"")
    return pc.if_else(plain, outputs, whole)


def _binary(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string").cast("binary"), F.lit(b""))


def transform(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "fim",
              seed: str = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """``df`` with a struct: n_units, form, prefix_chars, middle_chars (null
    if plain) and output (the bytes of the transformed text)."""
    @F.arrow_udf(_TYPE)
    def run(texts: pa.Array, drawn: pa.Array) -> pa.Array:
        done = []
        for start, count in _slices(texts):
            h = [pc.list_element(drawn.slice(start, count), k) for k in range(4)]
            done.append(fill_middle(texts.slice(start, count), h, rate, spm))
        return pa.concat_arrays(done) if done else pa.array([], pa.struct(_FIELDS))
    return df.withColumn(out, run(_binary(text_col), draws(seed, id_col)))


def restore(df: DataFrame, output_col: str = "output", form_col: str = "form", out: str = "restored") -> DataFrame:
    """``df`` with the bytes of the text that an output was made of."""
    @F.arrow_udf("binary")
    def run(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        done = [rebuilt(outputs.slice(start, count), forms.slice(start, count)) for start, count in _slices(outputs)]
        return pa.concat_arrays(done) if done else pa.array([], pa.binary())
    return df.withColumn(out, run(F.col(output_col), F.col(form_col)))


def query(docs: DataFrame) -> DataFrame:
    """Contract columns of op13, one row per document."""
    rows = docs.select("doc_id", "text")
    at = fresh(rows, "fim")
    made = transform(rows, out=at).select("doc_id", f"{at}.*")
    return restore(made).select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars",
                                F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


QUERY_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS d,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents),
h AS (
  SELECT *, len(u) AS n, CAST('0x' || d[1:8] AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || d[9:16] AS BIGINT) % (len(u) + 1) AS y,
         text = '' OR text LIKE '%<P>%' OR text LIKE '%<S>%' OR text LIKE '%<M>%' OR CAST('0x' || d[17:24] AS BIGINT) % 100 >= 50 AS plain,
         CAST('0x' || d[25:32] AS BIGINT) % 100 < 80 AS spm
  FROM t),
p AS (
  SELECT *, array_to_string(u[1:least(x, y)], '') AS pre, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS mid,
         array_to_string(u[greatest(x, y) + 1:], '') AS suf FROM h)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN NOT plain THEN length(pre) END AS prefix_chars, CASE WHEN NOT plain THEN length(mid) END AS middle_chars,
       sha256(CASE WHEN plain THEN text WHEN spm THEN '<S>' || suf || '<P>' || pre || '<M>' || mid
                   ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
