"""Main text of pages, vector codes and hard negatives against brute force and SQL, and their odd cases."""

import html
import math
import re
import time

import numpy as np
import pytest
from oracle import compare
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op12_vector_codes", "op13_hard_negatives"])
def test_equals_sql(spark, name):
    from tidemill.llm.registry import ORACLE_SQL, QUERIES

    compare(spark, SF, QUERIES[name], ORACLE_SQL[name])


# Pages


def article_of(page):
    """The article of a page that marks it as such and holds no other markup than paragraphs, headings, breaks and bold text."""
    inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))).split())


def test_pages_equal_their_articles(spark):
    from tidemill.llm.htmltext import op11_main_text

    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = op11_main_text(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, article_of(pages[r.page_id].html), len(r.text))


LINE = "The committee met on Tuesday, and after three hours of debate it adopted the plan; nobody objected to it."
#: Page and the text of its article.
PAGES = {
    "frame": (
        f'<body><header><h1>Site</h1><ul><li><a href=x>Home</a></ul></header><div class="layout-with-sidebar"><div id=content><h1>News</h1><p>{LINE} {LINE}</p>'
        f'<h2>Why</h2><p>Short.</p><ul><li>one</li><li>two</li></ul><p>{LINE}</p></div><div class="sidebar"><p>{LINE}</p></div></div>'
        f'<div id="comments"><h3>3 comments</h3><div class="c"><p>{LINE} {LINE} {LINE}</p></div></div><footer>x</footer></body>',
        f"News {LINE} {LINE} Why Short. one two {LINE}",
    ),
    "no marks": (f"<html><body><div><a href=1>Home</a> | <a href=2>News</a></div><h1>Title</h1><p>{LINE}</p><p>No.</p><p>{LINE} {LINE}</p><div>(c) Corp</div></body>", f"Title {LINE} No. {LINE} {LINE}"),
    "article": (
        f'<body><div class="cookie-notice">We use cookies, and so on. {LINE}</div><article class=post><header><h1>Title</h1><p>By Ann</p></header><p>{LINE}</p><aside>{LINE}</aside>'
        f"<table><tr><td>a<td>b</table><blockquote>q</blockquote><form><input>Subscribe now. {LINE}</form></article><section><h2>Comments (2)</h2><p>{LINE} {LINE}</p></section></body>",
        f"Title {LINE} a b q",
    ),
    "form around": (f'<body><form id=aspnetForm><div class=menu><a href=1>m</a></div><main><p>{LINE}</p><p>x &lt;b&gt; &amp;amp; y</p></main></form>', f"{LINE} x <b> &amp; y"),
    "teasers": (
        f'<body class="has-sidebar"><main><article><h1>T</h1><p>{LINE}</p></article><div class="comments-area"><article class="comment"><p>{LINE} {LINE}</p></article></div></main></body>',
        f"T {LINE}",
    ),
    "short": ('<body><nav><a href=1>a</a></nav><div class="ad">Buy this now, friends.</div><article><h1>Hi</h1><p>Ok.</p></article><footer>&copy; all of it, today.</footer>', "Hi Ok."),
    "inline advert": (f'<body><div class=story><span class="ad">buy</span>{LINE}<br>{LINE}</div></body>', f"{LINE} {LINE}"),
    "space": ("<p>a&nbsp;b\n\t c<b>d</b>e<br>f</p><p>g</p>", "a b cde f g"),
    "scripts": ('<p>x</p><script>if (a < b) "</p>"</script><style>p{}</style><!-- <p>no</p> --><p>y</p><!-- open', "x y"),
    "empty": ("", ""),
    "no page": (None, ""),
    "text": ("just text", "just text"),
    "unclosed": ("<p>kept <b>too</b> <a href='x", "kept too"),
    "only menu": ("<nav><p>a</p></nav>", ""),
}


def test_templates_and_odd_pages(spark):
    from tidemill.llm.htmltext import extract_main_text

    rows = [(k, "u", p, "c", 7, "z") for k, (p, _) in PAGES.items()] + [(None, None, "<p>x", None, None, None)] * 2
    pages = spark.createDataFrame(rows, "page_id string, url string, html string, text string, n_chars int, path string")
    got = extract_main_text(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    texts = [(r.page_id, r.text) for r in got.collect()]
    assert sorted(texts, key=str) == sorted([(k, t) for k, (_, t) in PAGES.items()] + [(None, "x")] * 2, key=str)
    assert extract_main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("page", ["<" * 200_000, "<div>" * 100_000 + "x", "<b>" * 100_000 + "x", '<a href="' * 50_000 + "x", "<ul><li>" * 30_000 + "x", "<!--" * 50_000, "<p>" + "word " * 400_000])
def test_long_pages_take_linear_time(page):
    from tidemill.llm.htmltext import main_text

    start = time.process_time()
    main_text(page)
    assert time.process_time() - start < 10


def test_path_values_follow_text_and_punctuation():
    from tidemill.llm.htmltext import blocks_of, path_values

    values = path_values(blocks_of(f"<div class=a><p>{LINE}</p><p>{LINE}</p></div><div class=b><p>word</p><p><a href=1>more words here</a></p></div>"))
    (long, short) = sorted(values.values(), reverse=True)
    assert long[0] > 3 * short[0] and long[1] == 0 and 0.7 < short[1] < 0.9


# Vector codes


def test_orchard_equals_all_distances():
    from tidemill.llm.vectorcodes import Codebook

    rng = np.random.default_rng(5)
    for n, dim, spread in ((256, 16, 1000), (256, 4, 8), (3, 2, 2), (1, 5, 10)):
        entries = rng.integers(-spread, spread + 1, (n, dim))
        entries[n // 2 :] = entries[: n - n // 2]  # repeated entries: the lower index is taken
        q = np.concatenate([rng.integers(-spread, spread + 1, (500, dim)), entries]).astype(float)
        code, error = Codebook(entries).nearest(q)
        d = ((q[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (code == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all()


VECTORS = "vec_id long, embedding array<double>, label string, code string, x string, error long"


def vector_rows():
    rng = np.random.default_rng(2)
    rows = [(k if k % 9 else None, [float(v) for v in rng.normal(0, 1, 8)], "ab"[k % 2] if k % 5 else None) for k in range(60)]
    rows += [(3, rows[3][1], "a")] * 2 + [(7, [0.5] * 8, "b"), (7, [0.5] * 8, "b")]
    odd = [(100, None, "a"), (101, [1.0, None, *[0.0] * 6], "a"), (102, [math.nan, *[0.0] * 7], "b"), (103, [math.inf, *[0.0] * 7], "b"), (104, [1.0, 2.0], "a"), (105, [], "a")]
    return rows, odd


def test_codes_equal_plain_rounds(spark):
    from tidemill.llm.vectorcodes import vector_codes

    rows, odd = vector_rows()
    table = spark.createDataFrame([(*r, "c", "x", 5) for r in rows + odd], VECTORS).repartition(5)
    got = sorted(((r.vec_id is None, r.vec_id or 0, r.code, r.error, r.label_error) for r in vector_codes(table, entries=16, rounds=3).collect()))
    x = np.floor(np.array([v for _, v, _ in rows]) * 1024).astype(int)
    ids = [(i is None, i or 0, k) for k, (i, _, _) in enumerate(rows)]
    order = sorted(range(len(rows)), key=lambda k: (*ids[k][:2], tuple(x[k].astype("<i4").tobytes())))
    parts = [x[:, 2 * p : 2 * p + 2] for p in range(4)]
    books = [part[order[:16]].copy() for part in parts]
    for step in range(4):
        codes = [((part[:, None] - b[None]) ** 2).sum(axis=2).argmin(axis=1) for part, b in zip(parts, books, strict=True)]
        if step < 3:
            for part, b, c in zip(parts, books, codes, strict=True):
                for e in set(c.tolist()):
                    b[e] = np.floor_divide(part[c == e].sum(axis=0), (c == e).sum())
    error = sum(((part - b[c]) ** 2).sum(axis=1) for part, b, c in zip(parts, books, codes, strict=True))
    sums = {}
    for (_, _, label), e in zip(rows, error, strict=True):
        sums[label] = sums.get(label, 0) + e
    want = sorted((i is None, i or 0, "".join(f"{c[k]:02x}" for c in codes), error[k], sums[label]) for k, (i, _, label) in enumerate(rows))
    assert got == want
    assert vector_codes(table.limit(0)).count() == 0 and vector_codes(table.where("embedding is null")).count() == 0
    few = vector_codes(table.where("vec_id < 4"))
    assert [r.error for r in few.collect()] == [0] * few.count() and few.count() == 5


# Hard negatives


def test_spanning_tree_is_minimal():
    from tidemill.llm.negatives import spanning_tree

    a = np.random.default_rng(1).integers(-9, 10, (60, 3)).astype(float)
    a[30:35] = a[0]
    order, parent, edge = spanning_tree(a)
    assert sorted(order) == list(range(60)) and all(parent[k] < 0 or order.index(parent[k]) < order.index(k) for k in order)
    d = np.linalg.norm(a[:, None] - a[None], axis=2)
    assert all(abs(edge[k] - d[k, parent[k]]) < 1e-6 for k in order[1:])
    root, total = list(range(60)), 0.0
    find = lambda x: x if root[x] == x else find(root[x])
    for w, i, j in sorted((d[i, j], i, j) for i in range(60) for j in range(i)):
        if find(i) != find(j):
            root[find(i)] = find(j)
            total += w
    assert abs(edge.sum() - total) < 1e-6


def plain_negatives(rows, anchors, positives=5, negatives=3, low=50, high=95):
    """``anchor, positive, rank, negative, scores`` by scoring everything; rows are (id, vector of integers, label)."""
    place = lambda t: (-t[0], rows[t[1]][0] is None, rows[t[1]][0] or 0, t[1])
    out = []
    for a in anchors:
        scored = [(int(rows[a][1] @ r[1]), k) for k, r in enumerate(rows) if k != a and len(r[1]) == len(rows[a][1])]
        for ps, p in sorted((t for t in scored if rows[t[1]][2] == rows[a][2]), key=place)[:positives]:
            hard = sorted((t for t in scored if rows[t[1]][2] != rows[a][2] and low * ps <= 100 * t[0] <= high * ps), key=place)[:negatives]
            out += [(rows[a][0], rows[p][0], rank, rows[n][0], ps, ns) for rank, (ns, n) in enumerate(hard, 1)]
    return out


def test_negatives_equal_plain_search(spark):
    from tidemill.llm.negatives import hard_negatives

    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (4, 6))
    rows = [(k, [float(v) for v in centres[k % 4] + rng.normal(0, 0.4, 6)], str(k * 7 % 3)) for k in range(400)]
    rows += [(5, rows[5][1], "0"), (None, rows[9][1], "1"), *[(1000 + k, [0.7] * 6, str(k % 2)) for k in range(40)], (900, [1.0, 2.0], "0"), (901, [1.0, 1.0], "1"), (902, [0.9, 2.0], "0"), (903, [], "0")]
    odd = [(50, None, "0"), (100, [math.nan] * 6, "0"), (150, [None] * 6, "1"), (200, [1.0] * 6, None)]
    table = spark.createDataFrame([(*r, "c", "x", 5) for r in rows + odd], VECTORS).withColumnRenamed("code", "scores").withColumnRenamed("x", "rid").repartition(3)
    got = sorted(tuple(r) for r in hard_negatives(table, "vec_id % 50 = 0").collect())
    whole = [(i, np.floor(np.array(v, dtype=float) * 256).astype(int), label) for i, v, label in rows]
    anchors = [k for k, r in enumerate(whole) if r[0] is not None and r[0] % 50 == 0]
    assert got == sorted(plain_negatives(whole, anchors)) and len(got) > 50
    assert hard_negatives(table.limit(0), "vec_id % 50 = 0").count() == 0
    assert hard_negatives(table, F.lit(None).cast("boolean")).count() == 0


def test_bounds_lose_nothing(monkeypatch):
    """Blocks of 16 candidates and windows of all kinds; ties and copies among them."""
    import pyarrow as pa

    from tidemill.llm import negatives

    monkeypatch.setattr(negatives, "SIDE", 16)
    rng = np.random.default_rng(8)
    x = rng.integers(-20, 21, (200, 4)).astype(float)
    x[50:80] = x[3]
    anchors = np.concatenate([x[:30], x[:5]])
    labels = [str(k % 3) for k in range(200)]
    for same in (True, False):
        group = negatives._Group(same, 3)
        group.add(x[:120], np.arange(120), pa.array([k if k % 11 else None for k in range(120)], pa.int64()), labels[:120])
        group.add(x[120:], np.arange(120, 200), pa.array(range(120, 200), pa.int64()), labels[120:])
        rid = np.concatenate([np.arange(30), np.arange(1000, 1005)])
        names = [*labels[:30], *["9"] * 5]
        windows = [np.array([[-np.inf, np.inf], [0.0, 100.0 + k], [50.0, 49.0]]) for k in range(35)]
        got = {(a, j): [(s, r) for s, r in zip(score, crid, strict=True)] for a, j, _, _, crid, score in group.best(anchors, rid, names, windows)}
        for a in range(35):
            for j, (low, high) in enumerate(windows[a]):
                fit = [(anchors[a] @ x[k], k) for k in range(200) if k != rid[a] and (labels[k] == names[a]) == same and low <= anchors[a] @ x[k] <= high]
                best = sorted(fit, key=lambda t: (-t[0], t[1] < 120 and t[1] % 11 == 0, t[1]))[:3]
                assert got.get((a, j), []) == best
