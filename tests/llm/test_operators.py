"""The corpus operators against plain versions, on edge rows and on the test tables."""

import base64
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabmill.llm import bpe, chat_collapse, cover_tree, dedup_mph, html_blocks, jaccard_rtree, mix, quality_zstd, registry, secret_scan, shard_prefix
from tests.conftest import SF001
from tests.llm.helpers import docs, edge_rows, rows, text


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def edges(spark):
    return docs(spark, edge_rows()).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, []).limit(0)


@pytest.mark.parametrize("query", [mix.query, dedup_mph.query, bpe.query, secret_scan.query, jaccard_rtree.query, shard_prefix.query,
                                   mix.mixed, dedup_mph.drop_repeats, jaccard_rtree.one_per_group])
def test_empty_table(empty, query):
    assert query(empty).count() == 0


# ---- 1 ------------------------------------------------------------------------------------------

def plain_targets(sizes: dict, share=1.5, cap=2.0, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        per = left / sum(w[s] for s in open_)
        full = [s for s in open_ if per * w[s] >= cap * sizes[s]]
        if not full:
            return out | {s: per * w[s] for s in open_}
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def check_mix(data, out):
    sizes = defaultdict(int)
    for _, t, s in data:
        sizes[s] += len(words(t))
    want = plain_targets(sizes)
    assert len(out) == len(data)
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((i, len(words(t))) for i, t, _ in data)
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in out)
    by_total = defaultdict(int)
    for r in out:
        by_total[(r["source_size"], round(r["target"], 6))] += r["taken"]
    assert {k for k in by_total} == {(sizes[s], round(want[s], 6)) for s in sizes}
    return by_total


def test_mix_edges(edges):
    check_mix(edge_rows(), rows(mix.query(edges)))


def test_mix_table(spark):
    d = spark.read.parquet(f"{SF001}/documents.parquet")
    data = [(r["doc_id"], r["text"], r["source"]) for r in d.collect()]
    first, again = (sorted((r["doc_id"], r["taken"]) for r in rows(mix.query(x))) for x in (d, d.repartition(5)))
    assert first == again
    total = check_mix(data, rows(mix.query(d)))
    assert all(abs(got - target) <= 0.05 * target for (_, target), got in total.items())


def test_mix_rates_solve_the_dual(spark):
    d = docs(spark, [(i, text(3 + i % 50, i), "s") for i in range(300)] + [(1000 + i, text(400, i), "t") for i in range(30)])
    out = rows(mix.balance(mix.measured(d)))
    for key in ("ss", "st"):
        mine = [r for r in out if r["key"] == key]
        assert math.isclose(sum(r["rate"] * r["size"] for r in mine), mine[0]["target"], rel_tol=1e-6)
        logs = {round(math.log(r["rate"]) / r["size"], 9) for r in mine if r["rate"] < 2}
        assert len(logs) <= 1  # one exponential tilt per source


def test_mixed_repeats_rows(edges):
    took = {(r["doc_id"], r["size"]): r["copies"] for r in rows(mix.query(edges)) if r["doc_id"] not in (None, 11)}
    got = Counter((r["doc_id"], len(words(r["text"]))) for r in rows(mix.mixed(edges)))
    assert mix.mixed(edges).columns == edges.columns
    assert all(got[k] == n for k, n in took.items())


# ---- 2 ------------------------------------------------------------------------------------------

def test_exact_dedup_edges(edges):
    out = rows(dedup_mph.query(edges))
    groups = defaultdict(list)
    for i, t, _ in edge_rows():
        groups[t or ""].append(i)
    assert len(out) == len(edge_rows())
    for t, ids in groups.items():
        mine = [r for r in out if r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()]
        keep = max((i for i in ids if i is not None), default=None)
        assert [r["group_size"] for r in mine] == [len(ids)] * len(ids)
        assert {r["keep_id"] for r in mine} == {keep} and sum(r["kept"] for r in mine) == 1
        assert all(r["doc_id"] == keep for r in mine if r["kept"])
    kept = rows(dedup_mph.drop_repeats(edges))
    assert Counter(r["text"] or "" for r in kept) == Counter(groups.keys())
    assert dedup_mph.drop_repeats(edges).columns == edges.columns


def test_minimal_perfect_hash():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 2**63, (5000, 4), dtype=np.uint64)
    sizes, bits = dedup_mph.build_hash(keys)
    assert sorted(dedup_mph.find_slots(keys, sizes, bits)) == list(range(5000))
    assert bits.sum() == 5000


def test_dedup_over_many_index_parts(spark):
    d = docs(spark, [(i, f"text {i % 300}", "a") for i in range(1000)])
    out = rows(dedup_mph.exact_groups(dedup_mph.digests(d), keys_per_part=20))
    assert len(out) == 1000
    assert all(r["keep_id"] % 300 == r["doc_id"] % 300 and r["keep_id"] + 300 > 999 for r in out)
    assert any(r["slot"] is None for r in out) is False  # every later text is in the history here


# ---- 3 ------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def plain_encoder():
    import public_tokenizers as P
    import tiktoken
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_rows(edges, plain_encoder):
    want = Counter()
    for i, t, _ in edge_rows():
        ids = plain_encoder.encode_ordinary(t or "")
        want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows(bpe.query(edges))) == want


def test_bpe_decode_inverts_encode(edges):
    import public_tokenizers as P
    path = P.path("byte_bpe_50k.tiktoken")
    out = bpe.decode(bpe.encode(edges, path, P.PATTERN, out="tok"), path, P.PATTERN, "tok", "back")
    assert all(bytes(r["back"]).decode() == (r["text"] or "") for r in rows(out))


def test_bpe_safe_cuts(plain_encoder):
    rng = random.Random(1)
    texts = ["".join(rng.choice(al) for _ in range(90_000)) for al in ("ab'st 12 \n\té　!?. 中", "ab12", "a", "é \x1c\x85\xa0")]
    texts += ["x" * 50_000 + " " * 20_000 + "y" * 10, "x " * 30_000 + "\n" * 15_000, "a" + " " * 12_000 + "\n" + " " * 13_000 + "b c"]
    for t in texts:
        assert bpe.encode_text(plain_encoder, t) == plain_encoder.encode_ordinary(t)
    assert len(bpe.encode_text(plain_encoder, " " * 2_500_000 + "x")) > 0  # the library alone fails on this


# ---- 4 ------------------------------------------------------------------------------------------

def plain_secrets(t):
    out = []
    for k, (kind, pattern, group, least) in enumerate([
            ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
            ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]):
        out += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, t, re.A) if len(m[group]) >= least]
    base = sorted(out)
    for k, cls in enumerate(secret_scan.CLASSES, 3):
        for m in re.finditer(f"{cls.pattern}{{{cls.window},}}", t):
            if any(re.search(a, m[0]) for a in secret_scan.ALLOW):
                continue
            spans = []
            for i in range(len(m[0]) - cls.window + 1):
                n = Counter(m[0][i:i + cls.window])
                if -sum(c / cls.window * math.log2(c / cls.window) for c in n.values()) >= cls.bits:
                    if spans and i <= spans[-1][1]:
                        spans[-1][1] = i + cls.window
                    else:
                        spans.append([i, i + cls.window])
            out += [(m.start() + a, k, m.start() + b, cls.kind) for a, b in spans]
    return base, sorted(out)


SECRETS = ["token=token\":abcdef12", "password = 'hunter22' Secret: abc api_key=ABCDEF API_KEY:\"x.y-z/w\"", "é中😀 passwd:123456 AKIA" + "A1" * 9,
           "AKIAAKIA" + "B" * 15 + " AKIAB" + "0" * 14, "deadbeef" * 3 + " " + "deadbeef" * 2, "x" * 600 + " tok " + "a1B2c3D4e5F6g7H8i9J0kLmNoP" * 3,
           "550e8400-e29b-41d4-a716-446655440000 internationalization example/ABCDEFGHIJKLMNOP1234", "q8Zr1LwXv5NtB3mKc7Hs" * 2 + "=" * 30 + "q8Zr1LwXv5NtB3mKc7Hs",
           " ".join("token: abcdef" for _ in range(1300))]


def test_secrets(spark):
    data = [(i, t, "a") for i, t in enumerate(SECRETS)] + [(100, None, "a"), (101, "", "a"), (101, "", "a")]
    out = {r["doc_id"]: r for r in rows(secret_scan.query(docs(spark, data)))}
    for i, t, _ in data:
        base, every = plain_secrets(t or "")
        listed = lambda x: ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in x)
        assert out[i]["spans"] == listed(every)
        assert out[i]["base_sha256"] == hashlib.sha256(listed(base).encode()).hexdigest()
        assert [out[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[3] == k for s in base) for k in ("assign", "access", "hex")]


def test_secret_scan_has_no_python(edges, capsys):
    secret_scan.query(edges).explain()
    assert not re.search("Python|Arrow|Pandas", capsys.readouterr().out)


# ---- 5 ------------------------------------------------------------------------------------------

LONG = "The cat sat on the mat and it was the best of all the days in the town for them. " * 4
#: Paragraphs without any of the listed stop words, by a word of theirs.
OTHER = {
    "Погода": " ".join(["Погода сегодня хорошая, дети играют возле старой реки, вечером обещают дождь."] * 4),
    "天气": "今天天气很好孩子们在河边玩耍晚上可能下雨大家都带了雨伞所以没有人担心。" * 8,
    "Pogoda": " ".join(["Pogoda dzisiaj piękna, dzieci bawią się obok starej rzeki, wieczorem spadnie deszcz."] * 4),
    "Units": " ".join(["Units 1200 3400 5600, totals 17 29 31, rates 0.5 0.7 0.9."] * 5),
}


@pytest.mark.parametrize("html, want", [
    (None, ""), ("", ""), ("<html><body></body></html>", ""), ("<p", ""),
    ("<nav><ul><li><a href=a>Home</a></ul></nav><article><h1>Head</h1><p><b>One &amp; two<br>three<p>four</p></article><footer>f</footer>", "Head One & two three four"),
    (f"<header>Site</header><div class='cookie-notice'>Cookies and the like</div><div><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div>"
     f"<div id=comments><p>{LONG}</p></div><aside>{LONG}</aside>", f"{LONG.strip()} Short. {LONG.strip()}"),
    (f"<article><p>{LONG}<script>if (a<b) '</p>'</script><!-- x --></p><form>Mail <input></form><section class='comments'>{LONG}</section></article>", LONG.strip()),
    ("<article><p>qqq www eee rrr</p></article>", "qqq www eee rrr"),
    (f"<div id=content><p>{LONG}</p><p>{LONG}</p></div><article><p>Next: a teaser of another page</p></article>",
     f"{LONG.strip()} {LONG.strip()} Next: a teaser of another page"),
    *[(f"<nav><a href=a>{w}</a></nav><ul><li><a href=b>{w}</a><li><a href=c>{w}</a></ul><div><p>{t}</p><p>{w}.</p><p>{t}</p></div><footer>{w}</footer>", f"{t} {w}. {t}")
      for w, t in OTHER.items()]])
def test_html_cases(html, want):
    assert html_blocks.main_text(html) == want


def test_html_table(spark):
    from html import unescape
    data = spark.read.parquet(f"{SF001}/pages.parquet")
    got = {r["page_id"]: r for r in rows(html_blocks.query(data))}
    for r in data.collect():
        body = re.search(r"<article>(.*?)(</article>|<footer>)", r["html"], re.S)[1]
        body = re.sub(r"<script.*?</script>|<!--.*?-->", "", body, flags=re.S)
        want = " ".join(unescape(re.sub(r"</?(?:b|i|em|strong|a)\b[^>]*>", "", re.sub(r"</?(?:p|h1|br|li|ul|div)\b[^>]*>", " ", body))).split())
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_html_is_linear():
    for page in ("<" * 100_000, "<b>x" * 20_000 + "</i>" * 20_000, "<p>x" * 50_000, "<div>" * 20_000 + "x"):
        html_blocks.main_text(page)


# ---- 6 ------------------------------------------------------------------------------------------

def plain_links(data, cosine=0.9):
    unit = []
    for _, v in data:
        ok = v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)
        unit.append(np.array(v, float) / np.linalg.norm(v) if ok else None)
    n = len(data)
    link = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j])
             and float(unit[i] @ unit[j]) >= cosine] for i in range(n)]
    lab = list(range(n))
    while True:
        new = [min([lab[i], *(lab[j] for j in link[i])]) for i in range(n)]
        if new == lab:
            return link, lab
        lab = new


def test_cover_tree_edges(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 6))
    data = [(i, (base[i % 12] + rng.normal(size=6) * 0.15).tolist()) for i in range(80)]
    data += [(100, None), (101, []), (102, [0.0] * 6), (103, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (104, [float("nan")] * 6), (105, [float("inf")] + [1.0] * 5),
             (106, base[0].tolist()), (107, (base[0] * 3).tolist()), (107, base[0].tolist()), (108, [1.0, 2.0]), (109, [1.0, 2.1]), (110, [1e300] * 6)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in data], "vec_id long, embedding array<double>, rid int, unit int")
    link, lab = plain_links(data)
    got = rows(cover_tree.query(df))
    want = Counter()
    for i, (vid, _) in enumerate(data):
        comp = min(data[j][0] for j in range(len(data)) if lab[j] == lab[i])
        want[(vid, len(link[i]), comp, vid == comp)] += 1
    assert Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == want


def test_cover_tree_blocks(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "BLOCK", 40)
    e = spark.read.parquet(f"{SF001}/embeddings.parquet")
    e = e.union(e.selectExpr("vec_id + 100000", "transform(embedding, x -> x * 2)", "label"))
    data = [(r["vec_id"], r["embedding"]) for r in e.collect()]
    link, lab = plain_links(data)
    got = {r["vec_id"]: r for r in rows(cover_tree.query(e))}
    for i, (vid, _) in enumerate(data):
        assert got[vid]["n_links"] == len(link[i])
        assert got[vid]["component_id"] == min(data[j][0] for j in range(len(data)) if lab[j] == lab[i])


def test_empty_vectors(spark):
    assert cover_tree.query(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# ---- 7 ------------------------------------------------------------------------------------------

def plain_shingles(t, k=3):
    w = words((t or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def plain_components(sets, threshold=90):
    inv, root = defaultdict(list), list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, s in enumerate(sets):
        for h in s:
            inv[h].append(i)
    for i, s in enumerate(sets):
        for j, n in Counter(j for h in s for j in inv[h] if j > i).items():
            if 100 * n >= threshold * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def check_jaccard(data, out, threshold=90):
    sets = [plain_shingles(t) for _, t, _ in data]
    comp = plain_components(sets, threshold)
    want = Counter()
    for i, (doc, _, _) in enumerate(data):
        ids = [data[j][0] for j in range(len(data)) if comp[j] == comp[i] and data[j][0] is not None]
        want[(doc, len(sets[i]), min(ids) if ids and sets[i] else doc)] += 1
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == want


def test_jaccard_edges(edges):
    check_jaccard(edge_rows(), rows(jaccard_rtree.query(edges)))


def test_jaccard_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard_rtree, "BLOCK", 16)  # large cells are cut
    monkeypatch.setattr(jaccard_rtree, "VERIFY", 5)
    rng, data = random.Random(2), []
    for g in range(6):
        base = text(rng.choice((12, 60, 150, 400)), 100 * g).split()
        for _ in range(40):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            data.append((len(data), " ".join(w), "a"))
    rng.shuffle(data)
    check_jaccard(data, rows(jaccard_rtree.query(docs(spark, data))))


def near_copies(n, size, most, seed):
    """Copies of one text, with up to ``most`` words of each replaced."""
    rng, base = random.Random(seed), text(size, seed).split()
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(1, most)):
            w[rng.randrange(size)] = f"new{rng.randrange(10**6)}"
        yield i, " ".join(w), "a"


def count_verified(monkeypatch):
    """The counts of pairs whose texts are compared, call by call."""
    verify, seen = jaccard_rtree._verify, []

    def counted(pairs, *args):
        seen.append(pairs.count())
        return verify(pairs, *args)
    monkeypatch.setattr(jaccard_rtree, "_verify", counted)
    return seen


def test_jaccard_pairs_of_a_large_group(spark, monkeypatch):
    """Where the hubs' searches settle little, the joins of trees make a few
    pairs per member, not all pairs of a group that links throughout."""
    search = jaccard_rtree._from_hubs
    monkeypatch.setattr(jaccard_rtree, "_from_hubs", lambda *args: search(*args).groupBy("a").agg(F.min("b").alias("b")))
    seen = count_verified(monkeypatch)
    data = list(near_copies(200, 200, 1, 5))
    check_jaccard(data, rows(jaccard_rtree.query(docs(spark, data))))
    assert len(seen) > 1 and sum(seen[1:]) <= 10 * len(data)


def test_jaccard_rounds_lose_no_link(spark, monkeypatch):
    """Long texts with much in common, which only their shingles tell apart: each has many candidates and a link to one."""
    for name, value in (("ROUNDS", (1,)), ("FURTHER", 9), ("BLOCK", 16)):
        monkeypatch.setattr(jaccard_rtree, name, value)
    seen = count_verified(monkeypatch)
    common, data = [f"w{k}" for k in range(7490)], []
    for i in range(12):
        own = [f"own{i}x{k}" for k in range(510)]
        data += [(i, " ".join(common + own), "a"), (100 + i, " ".join(common + own[:450] + [f"other{i}x{k}" for k in range(60)]), "a")]
    check_jaccard(data, rows(jaccard_rtree.query(docs(spark, data))))
    assert len(seen) > 3


def test_jaccard_rounds_make_each_pair_once(monkeypatch):
    """Whatever a task drops on the way: together, the rounds make all pairs
    across components that the bounds allow, and ask for another as long as some are left."""
    monkeypatch.setattr(jaccard_rtree, "HELD_PAIRS", 50)
    sets = [jaccard_rtree.shingles(t.encode()) for _, t, _ in near_copies(40, 80, 2, 3)]
    p = pd.DataFrame({"hub": [0] * 25 + [1] * 15, "class_id": range(100, 140), "base": [k // 3 for k in range(40)], "n": [len(s) for s in sets],
                      "counts": [jaccard_rtree.counts(s) for s in sets]})
    p["root"] = p["base"].where(p["base"] > 1, 0)  # two components have met since
    tree, made = p["hub"].to_numpy(), Counter()
    pairs = [(a, b) for a, b in itertools.combinations(range(40), 2) if tree[a] == tree[b]]
    points = jaccard_rtree.unpacked(list(p["counts"]))
    want = {(100 + a, 100 + b) for a, b in pairs if p["root"][a] != p["root"][b]
            and np.minimum(points[a], points[b]).sum() >= jaccard_rtree.least_overlap(len(sets[a]), len(sets[b]), 80)}
    for lo, hi in ((0, 1), (1, 5), (5, 12), (12, 100)):
        found = jaccard_rtree._Round(p, jaccard_rtree._Sift(p, 80), tree, lo, hi)
        for k in range(0, len(pairs), 64):
            found.add(*np.array(pairs[k:k + 64]).T)
        out = found.pairs(np.array([7, 8]))
        made.update(zip(out["a"][~out["later"]], out["b"][~out["later"]]))
        tree_of = {100 + k: h for k, h in enumerate([7] * 25 + [8] * 15)}
        assert set(out["a"][out["later"]]) == {tree_of[a] for a, _ in want - set(made)}
        assert (~out["later"]).sum() <= (hi - lo) * len(p)
    assert set(made) == want and set(made.values()) == {1}


def test_jaccard_table(spark):
    d = spark.read.parquet(f"{SF001}/documents.parquet")
    check_jaccard([(r["doc_id"], r["text"], None) for r in d.collect()], rows(jaccard_rtree.query(d)))


def test_cells_and_trees_lose_no_link():
    rng = np.random.default_rng(1)
    sets = []
    for _ in range(25):
        base = set(rng.integers(0, 1 << 62, int(rng.integers(3, 90))).tolist())
        for _ in range(int(rng.integers(1, 8))):
            s = set(base)
            for _ in range(int(rng.integers(0, 5))):
                s.pop()
                s.add(int(rng.integers(0, 1 << 62)))
            sets.append(np.array(sorted(s), np.uint64))
    size = np.array([len(s) for s in sets])
    for threshold in (80, 90):
        vec = jaccard_rtree.folded(jaccard_rtree.unpacked([jaccard_rtree.counts(s) for s in sets]))
        found = {p for i, j in jaccard_rtree.rtree_pairs(vec, size, vec, size, threshold) for p in zip(i.tolist(), j.tolist())}
        cell = [set(jaccard_rtree.cells(s, threshold).tolist()) for s in sets]
        for a in range(len(sets)):
            for b in range(len(sets)):
                n = len(np.intersect1d(sets[a], sets[b]))
                if 100 * n >= threshold * (size[a] + size[b] - n):
                    assert (a, b) in found and cell[a] & cell[b]


def test_one_per_group(edges):
    kept = rows(jaccard_rtree.one_per_group(edges))
    data = edge_rows()
    sets = [plain_shingles(t) for _, t, _ in data]
    comp = plain_components(sets)
    want = len({c for c, s in zip(comp, sets) if s}) + sum(not s for s in sets)
    assert len(kept) == want and jaccard_rtree.one_per_group(edges).columns == edges.columns
    assert {1, 4, 5, 6, 7, 9} <= {r["doc_id"] for r in kept} and not {2, 3, 8, 10} & {r["doc_id"] for r in kept}


# ---- 8 ------------------------------------------------------------------------------------------

def test_quality_held_out(spark):
    sf = SF001.replace("sf0.001", "sf0.01")
    out = {r["doc_id"]: r for r in rows(registry.QUERIES["op8_quality_zstd"](spark, sf))}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in out.items())
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    held = [(out[i]["predicted"], q) for i, q in labels if out[i]["held_out"]]
    good = [p for p, q in held if q == 1]
    assert sum(p == q for p, q in held) / len(held) > 0.95 and sum(good) / len(good) > 0.98


def test_quality_edges(spark, edges, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in rows(quality_zstd.query(edges, none))} == {0.5}
    one = spark.createDataFrame([(1, 1, 0), (1, None, 0), (2, 0, 0), (2, 1, 0), (9, 0, 1)], none.schema)
    out = rows(quality_zstd.query(edges, one))
    assert len(out) == len(edge_rows()) and all(0 <= r["score"] <= 1 for r in out)
    assert quality_zstd.query(empty, one).count() == 0
    assert quality_zstd.accepted(edges, one).columns == edges.columns


# ---- 9 ------------------------------------------------------------------------------------------

def check_shards(data, out):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in data)
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        assert 0 <= r["shard"] < 40 and r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_edges(edges):
    check_shards(edge_rows(), rows(shard_prefix.query(edges)))


def test_shards_balance(spark):
    data = [(i, text(20 + i % 30, i % 700), "a") for i in range(4000)] + [(10_000 + i, "the same text", "a") for i in range(4000)]
    out = rows(shard_prefix.query(docs(spark, data)))
    check_shards(data, out)
    per = Counter()
    for r in out:
        per[r["shard"]] += r["size"]
    mean = sum(per.values()) / 40
    assert len(per) == 40 and all(abs(v - mean) < 0.15 * mean for v in per.values())


def test_shards_keep_groups(spark):
    """Groups of up to a shard stay whole, and the cuts are those of a plain prefix sum."""
    data = [(i, text(20 + i % 30, i), "a") for i in range(2400)]
    for g, n in enumerate((25, 40, 55, 60, 130, 3)):
        data += [(10_000 + 1000 * g + k, f"equal text number {g} " * 8, "a") for k in range(n)]
    out = rows(shard_prefix.query(docs(spark, data)))
    check_shards(data, out)
    size, where, n = Counter(), defaultdict(set), Counter()
    for r in out:
        size[r["shard"]] += r["size"]
        where[r["text_crc32"]].add(r["shard"])
        n[r["text_crc32"]] += r["size"]
    mean = sum(size.values()) / 40
    assert all(len(where[c]) == 1 for c in where if n[c] <= mean) and any(len(s) > 1 for s in where.values())
    assert len(size) == 40 and all(abs(v - mean) < 0.1 * mean for v in size.values())
    # the rows outside large groups, in the order of shard and slot, are cut where the room of each shard ends
    large = {c for c in n if 16 * n[c] > mean and len(where[c]) == 1 and sum(r["text_crc32"] == c for r in out) > 1}
    own = Counter()
    for r in out:
        own[r["shard"]] += r["size"] * (r["text_crc32"] in large)
    line = sorted((r for r in out if r["text_crc32"] not in large), key=lambda r: (r["shard"], r["slot"]))
    ends = list(itertools.accumulate(mean - own[k] for k in range(40)))
    at = 0
    for r in line:
        if n[r["text_crc32"]] == r["size"] or n[r["text_crc32"]] > mean:
            assert r["shard"] == min(39, sum(e <= at + r["size"] / 2 + 1e-6 for e in ends[:39])) or abs(min(abs(e - at - r["size"] / 2) for e in ends)) < 1e-3
        at += r["size"]


def test_shards_one_and_many(spark, edges):
    for k in (1, 2, 3, 500):
        got = rows(shard_prefix.shards(shard_prefix.sized(edges), k))
        slots = defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
        assert len(got) == len(edge_rows()) and all(0 <= s < k and sorted(v) == list(range(len(v))) for s, v in slots.items())


def test_write_shards(edges, tmp_path):
    shard_prefix.write_shards(edges, str(tmp_path / "out"), n_shards=4)
    back = edges.sparkSession.read.parquet(str(tmp_path / "out"))
    assert back.count() == edges.count() and set(edges.columns) <= set(back.columns)


# ---- 10 -----------------------------------------------------------------------------------------

def plain_chat(data):
    convs = defaultdict(list)
    for c, t, r, x in data:
        convs[c].append((t, r, x))
    nulls = lambda v: (v is not None, v if v is not None else 0)
    seqs = {c: [(r, x) for _, r, x in sorted(v, key=lambda z: (nulls(z[0]), z[1] is not None, z[1] or "", z[2] is not None, z[2] or ""))] for c, v in convs.items()}
    out = {}
    for c, s in seqs.items():
        same = sorted((k is None, k or 0) for k, v in seqs.items() if v == s)
        longer = any(len(v) > len(s) and v[:len(s)] == s for v in seqs.values())
        if not longer and same[0] == (c is None, c or 0):
            out[c] = (len(s), len(same), "".join(f"<|im_start|>{r or ''}\n{x or ''}<|im_end|>\n" for r, x in s))
    return out


def test_chat_collapse(spark):
    rng, data = random.Random(4), []
    for c in range(60):
        base = rng.randrange(6)
        for t in range(rng.randint(1, 6)):
            data.append((c, t, "user" if t % 2 == 0 else "assistant", f"turn {base} {t if rng.random() < 0.9 else rng.randrange(99)}"))
    data += [(100, 0, None, None), (101, 0, "", ""), (102, None, "user", None), (None, 0, "user", "x"), (103, 0, "user", "a"), (103, 0, "user", "a"), (104, 0, "user", "a")]
    df = spark.createDataFrame([(*r, 5, 6) for r in data], "conv_id long, turn long, role string, text string, pos int, part int").repartition(4)
    want = plain_chat(data)
    got = rows(chat_collapse.query(df))
    assert {r["conv_id"]: (r["n_turns"], r["n_equal"], r["text"]) for r in got} == want and len(got) == len(want)
    cut = rows(chat_collapse.render(chat_collapse.turns(df).join(chat_collapse.maximal(chat_collapse.turns(df)), ["no_id", "cid"]), per_row=2))
    joined = defaultdict(str)
    for r in sorted(cut, key=lambda r: r["part"]):
        joined[r["conv_id"]] += r["text"]
    assert dict(joined) == {c: v[2] for c, v in want.items()}
    assert chat_collapse.query(df.limit(0)).count() == 0
