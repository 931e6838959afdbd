"""Prefix trie, pair-index BPE and fill-in-the-middle against plain versions, on edge rows and on the test tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tabmill.llm import common, fill_middle, jaccard_rtree, pair_bpe, prefix_trie
from tests.conftest import SF001
from tests.llm.helpers import docs, edge_rows, rows

MODEL = public_tokenizers.path("word_bpe_49k.json")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# ---- 11 -----------------------------------------------------------------------------------------

def plain_trie(data):
    own = defaultdict(list)
    for c, turn, role, text in data:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - int(np.fmod(c, 100)), [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    out = []
    for node, cs in members.items():
        under = [n for n in members if n[:len(node)] == node]
        kids = [n for n in under if len(n) == len(node) + 1]
        leaves = [n for n in under if not any(len(m) == len(n) + 1 and m[:len(n)] == n for m in under)]
        saved = sum((len(members[n]) - 1) * (len(n[-1][1]) if n else 0) for n in under)
        ends = ",".join(map(str, sorted(c for c in cs if len(built[c]) == len(node))))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(kids), len(leaves), saved, sha(ends)))
    return sorted(out, key=str)


def check_trie(spark, data):
    df = spark.createDataFrame([(*r, 1, "x") for r in data], "conv_id long, turn long, role string, text string, depth int, cid string").repartition(3)
    got = prefix_trie.query(df)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=str) == plain_trie(data)


def talks(seed, convs, longest=7):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "bot"]), rng.choice(["hi", "who?", "é 中", ""])) for c in convs for t in range(rng.randint(1, longest))]


def test_trie_on_shared_prefixes(spark):
    check_trie(spark, talks(1, [*range(60), *range(100, 140), 305, 1234567, -7, -105]))


def test_trie_edges(spark):
    same = [(c, t, "user", f"turn {t}") for c in (0, *range(200, 230)) for t in range(4)]
    odd = [(None, 1, "user", "lost"), (7, None, None, None), (7, None, "user", ""), (7, 2, None, "a"), (7, 2, None, "a"), (9, 1, "user", "short"), (400, 0, "a", "b:c"), (500, 0, "a:b", "c")]
    check_trie(spark, same + odd)
    check_trie(spark, [(5, 1, "user", "alone")])
    assert prefix_trie.query(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_trie_with_a_saturated_sketch_and_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "cells", lambda depth, a, b, width: [(depth % np.uint64(2)).astype(np.int64) for _ in range(3)])
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    check_trie(spark, talks(2, range(40)) + [(c, t, "user", f"{t}") for c in (800, 801) for t in range(60)])


def test_trie_screens_out_lone_tails(spark):
    data = [(c, t, "user", f"{c} {t}") for c in range(300) for t in range(8)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = prefix_trie.screened(prefix_trie.rebuilt(df)).collect()
    convs = defaultdict(set)
    for r in got:
        convs[r["depth"], r["a0"], r["a1"]].add(r["cid"])
    assert not any(r["alone"] and len(convs[r["depth"], r["a0"], r["a1"]]) > 1 for r in got)
    lone = [r["alone"] for r in got if len(convs[r["depth"], r["a0"], r["a1"]]) == 1]
    assert sum(lone) > 0.99 * len(lone)


# ---- 12 -----------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def model():
    return pair_bpe.Model(pair_bpe.read_model(MODEL))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(MODEL)


def odd_texts():
    rng = random.Random(6)
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    yield from ["", " ", "a" * 70, "ab" * 33, "'s't're I'LL don'T", "123 ½² ٣", "İstanbul ΣΑΣ ﬁ é ́x", "a\x1cb !\x1c! \x1f", "x\x85y z​w",
                "<|startoftext|>a<|endoftext|><|ENDOFTEXT|>", "x<|endoftext|", "́ ́", "한국어 각", "y" * 70_000, "é" * 66_000 + " z"]
    for pool in (points, points[:0x3100], [ord(c) for c in "abcde 'st<|>\ńé中0½\x1c"]):
        yield from ("".join(chr(rng.choice(pool)) for _ in range(30)) for _ in range(400))


def test_pair_index_equals_the_library(model, library):
    texts = list(odd_texts())
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert pair_bpe.encode_batch(model, texts).to_pylist() == want


def test_several_indexes_give_the_same(model, library, monkeypatch):
    monkeypatch.setattr(pair_bpe, "INDEX_SYMBOLS", 50)
    monkeypatch.setattr(pair_bpe, "LONG", 40)
    texts = list(odd_texts())[:600]
    assert pair_bpe.encode_batch(model, texts).to_pylist() == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_bpe_query_on_edges_and_table(spark, library):
    for df in (docs(spark, edge_rows()), spark.read.parquet(f"{SF001}/documents.parquet"), docs(spark, []).limit(0)):
        want = []
        for r in df.collect():
            ids = library.encode(r["text"] or "", add_special_tokens=False).ids
            want.append((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
        assert sorted(want, key=str) == sorted((tuple(r[k] for k in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for r in pair_bpe.query(df).collect()), key=str)


def test_models_with_late_parts_are_refused():
    import json
    spec = json.loads(pair_bpe.read_model(MODEL))
    spec["model"]["merges"].reverse()
    with pytest.raises(ValueError):
        pair_bpe.Model(json.dumps(spec).encode())


# ---- 13 -----------------------------------------------------------------------------------------

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_fim(i, t):
    u = UNIT.findall(t)
    assert "".join(u) == t
    d = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(d[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(u) + 1) for x in h[:2])
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(u), "plain", None, None, sha(t), sha(t)
    pre, mid, suf = ("".join(p) for p in (u[:a], u[a:b], u[b:]))
    out, form = (f"<S>{suf}<P>{pre}<M>{mid}", "spm") if h[3] % 100 < 80 else (f"<P>{pre}<S>{suf}<M>{mid}", "psm")
    return len(u), form, len(pre), len(mid), sha(out), sha(t)


def test_fim_equals_a_plain_version(spark, monkeypatch):
    rng = random.Random(8)
    odd = ["", " ", "\n\n a", "a \t", "x\x00y \x01 \x01a \x00b", "<P> a b", "a <", "<S", "S> <M", "<<M", "é 中 🙂 文", "a b\x85c \xa0"]
    data = [(k, odd[k % len(odd)] if k % 3 else "".join(rng.choices("ab <PSM>\n\x00\x01é", k=rng.randint(0, 30))), "s") for k in range(240)]
    for size in (fill_middle.SLICE, 64):
        monkeypatch.setattr(fill_middle, "SLICE", size)
        for rows_ in (data, edge_rows()):
            got = sorted((tuple(r.values()) for r in rows(fill_middle.query(docs(spark, rows_)))), key=str)
            assert got == sorted(((i, *plain_fim(i, t or "")) for i, t, _ in rows_), key=str)
    assert fill_middle.query(docs(spark, []).limit(0)).count() == 0


def test_fim_gives_the_output_itself(spark):
    df = docs(spark, [(k, f"one two three {k}", "s") for k in range(50)])
    back = fill_middle.restore(fill_middle.transform(df).select("doc_id", "text", "fim.*"))
    for r in rows(back):
        assert bytes(r["restored"]).decode() == r["text"]
        assert (r["form"] == "plain") == (bytes(r["output"]).decode() == r["text"])


# ---- shared -------------------------------------------------------------------------------------

def test_twice_bits(spark, monkeypatch):
    monkeypatch.setattr(common, "HELD", 100)
    rng = random.Random(9)
    values = [rng.randrange(3 * common.PAGE) for _ in range(3000)] + [5, 5, common.PAGE, common.PAGE, 2 * common.PAGE - 1]
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(4)
    bits = common.twice_bits(df, lambda batches: (b.column("v").to_numpy() for b in batches if b.num_rows), 3 * common.PAGE)
    want = {v for v in values if values.count(v) > 1}
    at = np.arange(3 * common.PAGE)
    assert set(at[common.is_set(bits, at)].tolist()) == want


def test_join_finds_one_group_whatever_the_filters_let_pass(spark, monkeypatch):
    """Filters of one page let nearly every cell pass; the result stays the same."""
    base = [f"w{k}" for k in range(200)]
    data = [(i, " ".join(base[:190] + [f"x{i}"]), "s") for i in range(60)] + [(100 + i, " ".join(f"y{i}{k}" for k in range(150)), "s") for i in range(30)]
    monkeypatch.setattr(jaccard_rtree, "FILTERS", ((common.PAGE, 0), (common.PAGE, 32)))
    got = {r["doc_id"]: r["component_id"] for r in rows(jaccard_rtree.query(docs(spark, data)))}
    assert got == {i: 0 if i < 60 else i for i, _, _ in data}
