"""Cases behind fixes of the corpus operators: lost pages, links at the threshold, dictionaries."""

import math
import random

import numpy as np
import pytest

from tabmill.llm import cover_tree, html_blocks, quality_zstd

LONG = "The cat sat on the mat and it was the best of all the days in the town for them. " * 4
BODY = f"<article><p>{LONG}</p></article>"


@pytest.mark.parametrize("html, want", [
    *[(f"<nav>Home</nav><div class='{c}'>{BODY}</div><footer>f</footer>", LONG) for c in ("no-sidebar", "has-sidebar", "with-nav", "menu-open", "layout-sidebar", "menu", "page__header")],
    (f"<div id=page class=content-ad-free><p>{LONG}</p></div>", LONG),
    (f"<main><div class=layout-sidebar><p>{LONG}</p><div class=promo-box>{LONG[:80]}</div></div></main>", LONG),
    (f"<div class=layout-search><div id=nav-x>Home</div><main><p>{LONG}</main></div>", LONG),
    (f"{BODY}<div id=comments><article>{LONG * 3}</article></div>", LONG),
    (f"<div class=no-sidebar>{BODY}<div id=comments><article>{LONG * 3}</article></div></div>", LONG),
    (f"<div><p>{LONG}</p></div><ol class=comment-list><li><article>{LONG * 3}</article></ol>", LONG),
    (f"<head><title>T</title><meta charset=utf-8><p>{LONG}", LONG),
    (f"<head><title>T</title><script>'<p>'</script>{BODY}", LONG),
    (f"<head><noscript><p>no</head><body>{BODY}", LONG),
    *[(f"<div><{t}>no</div><p>{LONG}</p>", LONG) for t in ("button", "select", "canvas", "object", "video", "map", "svg", "noscript", "template", "datalist")],
    *[(f"<body><{t}>no{BODY}</body>", LONG) for t in ("button", "select><option", "canvas", "audio", "svg><g")],
    (f"<p>{LONG}<button><div>no</div></button><svg><title/><text>no</text></svg><object><p>no</object></p>", LONG),
    (f"<div><p>{LONG}</p><textarea>no</div><p>no", LONG)])
def test_html_keeps_the_page(html, want):
    assert html_blocks.main_text(html) == want.strip()


def test_html_of_nested_marks_is_linear():
    for tag in ("<div class=x-sidebar>", "<svg>", "<button>", "<head>", "<object><p>"):
        html_blocks.main_text(tag * 20_000 + "<article>x" * 2)


@pytest.mark.parametrize("turn, gap", [(1e-8, 5e-9), (-1e-8, -5e-9), (3e-9, 1.5e-9), (-3e-9, -1.5e-9)])
def test_links_at_the_threshold_of_nearly_equal_vectors(turn, gap):
    far = math.acos(0.9) + gap
    x = np.array([[1.0, 0.0], [math.cos(turn), math.sin(turn)]])
    y = np.array([[math.cos(far), math.sin(far)]])
    want = (x @ y.T >= 0.9).astype(int)
    assert want.sum() == 1
    one = np.ones(2, np.int64)
    got_x, got_y, root = cover_tree.link_blocks(x, one, y, one[:1], 0.9, False)
    assert got_x.tolist() == want[:, 0].tolist() and got_y.tolist() == [1] and len(set(root.tolist())) == 2
    both = np.concatenate([x, y])
    assert cover_tree.link_blocks(both, np.ones(3, np.int64), both, np.ones(3, np.int64), 0.9, True)[0].sum() == 4


def test_dictionaries_learn_from_whole_texts(spark):
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    said = ["the committee wishes to record its thanks to all contributors", "buy two get one free while stocks last click here to order"]
    data = [(i, f"{noise(1300)} {said[i % 2]} {noise(7000)}", i % 2) for i in range(160)]
    df = spark.createDataFrame(data, "doc_id long, text string, quality int")
    model = quality_zstd.fit(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    assert [said[y][4:-4].encode() in model.dicts[y] for y in (0, 1)] == [True, True]


def test_dictionary_samples_are_bounded_evenly(spark, monkeypatch):
    monkeypatch.setattr(quality_zstd, "FIT_BYTES", 100_000)
    held = []
    monkeypatch.setattr(quality_zstd, "_train", lambda samples, size: held.append(samples) or b"".join(samples)[-size:])
    df = spark.createDataFrame([(i, "".join(f"{i:03d}{k:05d}" for k in range(4000)), i % 2) for i in range(40)], "doc_id long, text string, quality int")
    quality_zstd.fit(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    for samples in held:
        assert 50_000 <= sum(map(len, samples)) <= 150_000
        assert max(int(p[3:8]) for p in samples) >= 3000 and len({p[:3] for p in samples}) >= 5
