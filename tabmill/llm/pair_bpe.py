"""BPE encoding and decoding with word ends by a pair occurrence index.

All texts of a batch share one index.  Their distinct words are laid out as
one line of symbols with links to the left and right neighbour, and every
pair of neighbours that the model can merge is mapped to all its positions in
the batch.  The ranks that have positions are taken in ascending order; a
rank's merges are done at all its positions at once, and only the lists of
the pairs that this makes new are updated (positions that have lost their
pair are sifted out when their rank comes up).  Since a pair can only be made
by a merge of a lower rank, one pass over the ranks gives every word what it
would get alone; a model that breaks this rule is refused.

Characters are lower-cased and classed as the library does, whatever Unicode
version it holds: it is asked once per character whether Python agrees.  Text
of characters on which it does not, or that is not in NFC, goes through the
model file's own normaliser and the library's classes.  Special tokens are
cut out of the raw text first.  Texts of more than ``LONG`` characters are worked off
in pieces cut only before white space, where neither normalisation nor a word
nor a special token reaches across.  An index takes at most ``INDEX_SYMBOLS``
symbols (or one word); more words make a further index, with the same result.

Defined results: null counts as empty; an empty text has no ids and decodes
to the empty text; bytes that are not UTF-8 are encoded as U+FFFD; unknown
ids can't be decoded and raise; an empty table gives no rows; repeated rows
are rows; other columns pass through unread, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Characters up to which a text is worked off in one go.
LONG = 65_536
#: Symbols of one pair index.
INDEX_SYMBOLS = 2 << 20
#: Largest model file that is sent to the executors.
MODEL_BYTES = 64 << 20
_WS = "\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_CUT = re.compile(f"(?<=[^{_WS}])(?=[{_WS}])")
#: Fixed value: the word pattern, over text in which other letters, numbers and
#: white space are written as A, 0 and a blank and anything else as an exclamation mark.
_WORD = re.compile("[a-zA]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\t-\r a-zA0-9]+")
#: The same for text of characters that Python classes as the library does.
_PLAIN_WORD = re.compile(r"[^\W\d_]+|\d|'(?:s|t|re|ve|m|ll|d)|(?:[^\w\s]|_)+")
_LETTER = re.compile(r"[^\W\d_]")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_MODELS: dict[str, Model] = {}


def byte_names() -> list[str]:
    """The character that stands for each byte: itself where it can be seen, else the next one from 256 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(rest)) for b in range(256)]


class _Classes(dict):
    """Translation of characters outside ASCII to one character of their class, as the library sees them."""

    def __init__(self, split) -> None:
        super().__init__()
        self.split = split

    def __missing__(self, code: int) -> int:
        if code < 128:
            kind = chr(code)
        else:
            c = chr(code)
            pieces = [w for w, _ in self.split.pre_tokenize_str(f"a{c}{c}")]
            kind = {("a",): " ", (f"a{c}{c}",): "A", ("a", c, c): "0"}.get(tuple(pieces), "!")
        self[code] = ord(kind)
        return self[code]


class _Plain(dict):
    """Whether a character is lower-cased and classed by Python as by the
    library, wherever it stands in a text that is in NFC."""

    def __init__(self, normalize, classes: _Classes) -> None:
        super().__init__()
        self.normalize, self.classes = normalize, classes

    def __missing__(self, c: str) -> bool:
        low = c.lower()
        kinds = ["A" if _LETTER.match(x) else "0" if x.isdecimal() else " " if x.isspace() else "!" for x in low]
        told = [chr(self.classes[ord(x)]) for x in low]
        told = ["A" if x.isalpha() else "0" if x.isdigit() else " " if x in "\t\n\v\f\r " else "!" for x in told]
        blank = kinds == told == [" "]
        self[c] = c != "Σ" and kinds == told and (blank or self.normalize(c) == low)
        return self[c]


class _Numbers(dict):
    """Consecutive numbers of words, in the order in which they are met."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Model:
    """A BPE model file: its merges as sorted pair keys, and the symbols of bytes."""

    def __init__(self, data: bytes) -> None:
        from tokenizers import Tokenizer
        spec = json.loads(data)
        bpe, added = spec["model"], spec["added_tokens"]
        if (bpe["type"] != "BPE" or bpe.get("unk_token") or bpe.get("dropout") or bpe.get("byte_fallback") or bpe.get("ignore_merges")
                or bpe.get("continuing_subword_prefix") or spec.get("decoder") or not str(spec["pre_tokenizer"]).count("ByteLevel")
                or spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] != {"Regex": _PATTERN}
                or any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added)):
            raise ValueError("not a byte-level BPE model with word ends, the known word pattern and plain special tokens")
        tok = Tokenizer.from_str(data.decode())
        self.normalize = tok.normalizer.normalize_str
        self.classes = _Classes(tok.pre_tokenizer[0])
        self.plain = _Plain(self.normalize, self.classes)
        vocab, end = bpe["vocab"], bpe.get("end_of_word_suffix") or ""
        names = byte_names()
        self.inner = np.array([vocab[c] for c in names], np.int32)
        self.last = np.array([vocab[c + end] for c in names], np.int32)
        self.special = {t["content"]: t["id"] for t in added}
        self.cut_special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if added else None
        self.base = 1 + max([*vocab.values(), *self.special.values()])
        self.names = np.full(self.base, None, object)
        for t, i in [*vocab.items(), *self.special.items()]:
            self.names[i] = t
        pairs = [m.split(" ") if isinstance(m, str) else m for m in bpe["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.left, self.right = left, right
        born = np.full(self.base, -1, np.int64)
        born[self.made[::-1]] = np.arange(len(pairs))[::-1]
        late = np.full(self.base, -1, np.int64)
        late[self.made] = np.arange(len(pairs))  # the last merge that makes a symbol
        if (np.maximum(late[left], late[right]) >= np.arange(len(pairs))).any() or (born != late).any():
            raise ValueError("a pair of the model comes before the merge that makes its part")
        keys = left * self.base + right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs, -1 where there is no merge."""
        key = a.astype(np.int64) * self.base + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def words(self, text: str) -> Iterator[list[str]]:
        """Words and special tokens of a whole text, in order, in lists."""
        for piece in pieces(text):
            parts = self.cut_special.split(piece) if self.cut_special else [piece]
            for k, part in enumerate(parts):
                if k % 2:
                    yield [part]
                elif part.isascii():
                    yield _WORD.findall(part.lower())
                elif all(map(self.plain.__getitem__, set(part))) and unicodedata.is_normalized("NFC", part):
                    yield _PLAIN_WORD.findall(part.lower())
                else:
                    part = self.normalize(part)
                    yield [part[m.start():m.end()] for m in _WORD.finditer(part.translate(self.classes))]


def pieces(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > LONG:
        m = _CUT.search(text, start + LONG)
        if not m:
            break
        yield text[start:m.start()]
        start = m.start()
    yield text[start:]


def merge_all(model: Model, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all words and where each word's begin, by one pair index over all of them."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths)
    raw = np.frombuffer(b"".join(words), np.uint8)
    sym = model.inner[raw]
    sym[ends - 1] = model.last[raw[ends - 1]]
    nxt, prv = np.arange(1, len(sym) + 1, dtype=np.int32), np.arange(-1, len(sym) - 1, dtype=np.int32)
    nxt[ends - 1] = -1
    prv[ends - lengths] = -1
    held: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def enter(at: np.ndarray) -> None:
        """Map the pairs that start at these positions to them."""
        rank = model.rank(sym[at], sym[nxt[at]])
        at, rank = at[rank >= 0], rank[rank >= 0]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        for r, part in zip(rank[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts) if len(cuts) else [at]):
            if r in held:
                held[r].append(part)
            else:
                held[r] = [part]
                heapq.heappush(active, r)

    enter(np.flatnonzero(nxt >= 0))
    while active:
        r = heapq.heappop(active)
        lists = held.pop(r)
        a, b = model.left[r], model.right[r]
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        at = at[sym[at] == a]
        after = nxt[at]
        ok = (after >= 0) & (sym[after] == b)
        at, after = at[ok], after[ok]
        if a == b and len(at) > 1:  # of overlapping pairs the leftmost, then every second one
            taken, free = -1, np.ones(len(at), bool)
            for k, (i, j) in enumerate(zip(at.tolist(), after.tolist())):
                free[k] = i != taken
                taken = j if i != taken else -1
            at, after = at[free], after[free]
        if not len(at):
            continue
        sym[at] = model.made[r]
        sym[after] = -1
        beyond = nxt[after]
        nxt[at] = beyond
        prv[beyond[beyond >= 0]] = at[beyond >= 0]
        before = prv[at]
        enter(np.unique(np.concatenate([before[before >= 0], at[beyond >= 0]])))
    alive = sym >= 0
    count = np.add.reduceat(alive, ends - lengths) if len(words) else np.zeros(0, np.int64)
    return sym[alive], np.concatenate([[0], np.cumsum(count)])


def encode_batch(model: Model, texts: Iterable[str]) -> pa.ListArray:
    """Ids of every text."""
    index = _Numbers()
    none = np.zeros(0, np.int32)
    lines = [np.concatenate([none, *(np.fromiter(map(index.__getitem__, w), np.int32, len(w)) for w in model.words(t))]) for t in texts]
    special = [(k, model.special[w]) for w, k in index.items() if w in model.special]
    todo = np.setdiff1d(np.arange(len(index)), [k for k, _ in special])
    data = [w.encode() for w in index if w not in model.special]
    del index
    size = np.cumsum([len(d) for d in data])
    start, found, length = 0, [], np.ones(len(todo) + len(special), np.int64)
    while start < len(todo):
        stop = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + INDEX_SYMBOLS, side="right")))
        ids, at = merge_all(model, data[start:stop])
        length[todo[start:stop]] = np.diff(at)
        found.append(ids)
        start = stop
    flat = np.concatenate([none, *found, np.array([i for _, i in special], np.int32)])
    begin = np.zeros(len(length), np.int64)
    begin[todo] = np.cumsum(length[todo]) - length[todo]
    begin[[k for k, _ in special]] = len(flat) - len(special) + np.arange(len(special))
    out, total = [none], [0]
    for line in lines:
        n = length[line]
        stop = np.cumsum(n)
        out.append(flat[np.arange(stop[-1] if len(stop) else 0) + np.repeat(begin[line] - stop + n, n)])
        total.append(total[-1] + len(out[-1]))
    return pa.ListArray.from_arrays(pa.array(total, pa.int32()), pa.array(np.concatenate(out)))


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MODEL_BYTES + 1)
    if len(data) > MODEL_BYTES:
        raise ValueError(f"the model file is larger than {MODEL_BYTES} bytes")
    return data


def _model(spark, path: str):
    sent = spark.sparkContext.broadcast(read_model(path))

    def get() -> Model:
        key = hashlib.sha256(sent.value).hexdigest()
        if key not in _MODELS:
            _MODELS[key] = Model(sent.value)
        return _MODELS[key]
    return get


def encode(df: DataFrame, path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the ids of the text (array of int)."""
    get = _model(df.sparkSession, path)

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        return encode_batch(get(), (t.as_py().decode("utf-8", "replace") for t in texts))
    return df.withColumn(out, run(F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b""))))


def decode(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text that the ids stand for: their tokens joined by a
    space, as the library decodes by a file without a decoder (null ids: empty)."""
    get = _model(df.sparkSession, path)

    @F.arrow_udf("string")
    def run(ids: pa.Array) -> pa.Array:
        names = get().names
        return pa.array([" ".join(names.take(i.values.to_numpy())) if i.is_valid else "" for i in ids], pa.string())
    return df.withColumn(out, run(F.col(ids_col)))


def query(docs: DataFrame) -> DataFrame:
    """Contract columns of op12, one row per document."""
    import public_tokenizers as vocab
    path = vocab.path("word_bpe_49k.json")
    done = decode(encode(docs.select("doc_id", "text"), path), path)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
