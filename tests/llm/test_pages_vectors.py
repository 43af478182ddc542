"""Operators on pages and vectors against brute force, on awkward rows and on an empty table."""

import base64
import hashlib

import numpy as np
import pytest

from cairn.llm import ann, extraction, warc

PAGES = "page_id long, url string, html string, sha1 string, frame int"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES)


def test_archives_round_trip(spark):
    rows = [
        (1, "http://a/", "<p>one</p>"),
        (2, "http://b/\r\nX: y", "<p>one</p>"),
        (3, None, None),
        (4, "http://d/", ""),
        (5, "http://e/", "é" * 3_000_000),
        (6, "http://f/", "last\r\n\r\nWARC/1.1\r\n"),
        (None, "http://g/", "<p>one</p>"),
    ]
    index = warc.write_bundles(pages_of(spark, rows))
    got = {r.page_id: r for r in warc.read_bundles(index).collect()}
    assert len(got) == 7 and index.count() == 7
    first = {}
    for page, url, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (html or "").encode()
        digest, r = base64.b32encode(hashlib.sha1(raw).digest()).decode(), got[page]
        refers = first.setdefault(raw, page)
        assert (r.payload_bytes, r.payload_digest) == (len(raw), digest)
        assert (r.record_type, r.refers_to) == (("response", None) if refers == page else ("revisit", refers))
        assert r.payload == (raw if refers == page else None)
    assert got[2].url == "http://b/%0D%0AX:%20y"
    wanted = index.filter("page_id in (2, 6)")
    assert {r.page_id: r.payload for r in warc.fetch(index, wanted).collect()} == {2: None, 6: rows[5][2].encode()}
    whole = warc.read_bundles(warc.write_bundles(pages_of(spark, rows), least_bytes=11)).collect()
    assert {r.record_type for r in whole} == {"response"}
    assert warc.read_bundles(warc.write_bundles(pages_of(spark, []))).count() == 0


ARTICLE = "First paragraph, with commas, and words enough to count as prose for anyone."


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<nav><a href=x>menu</a></nav>", ""),
        ("just text", "just text"),
        (f"<div class=menu>m</div><div><h2>T</h2><p>{ARTICLE}<p>a<br>b &amp; c&nbsp;d</div><footer>f</footer>", f"T\n{ARTICLE}\na b & c d"),
        (f"<header>h</header><main><p>{ARTICLE}</p><form>f</form><section id=comments><p>{ARTICLE} x</p></section></main>", ARTICLE),
        (f"<script>'<p>no</p>'</script><style>p</style><!-- <p>no</p> --><article><p title='a>b'>{ARTICLE}</p></article>", ARTICLE),
        (f"<article><p>{ARTICLE}</p></article><aside>s</aside><div class='ad'>buy</div><a href='", ARTICLE),
        (f"<div><p>{ARTICLE}</p><p>{ARTICLE} {ARTICLE}</p></div><div>" + "<p><a href=x>link, link, link</a></p>" * 9 + "</div>", f"{ARTICLE}\n{ARTICLE} {ARTICLE}"),
        ("<p>" * 20_000 + "deep", "deep"),
        ("<div>" * 20_000 + "deep" + "</b>" * 5_000, "deep"),
    ],
)
def test_main_text(page, text):
    assert extraction.main_text(page) == text


PROSE = f"<p>{ARTICLE}</p><p>{ARTICLE} Again.</p>"
LINES = f"{ARTICLE}\n{ARTICLE} Again."


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<div class='layout has-sidebar'><article>{PROSE}</article><div class=sidebar>s</div></div>", LINES),
        (f"<div id='page' class='no-comments'><div>{PROSE}</div></div>", LINES),
        (f"<form><div id=top><a href=x>a</a></div><div>{PROSE}</div></form>", LINES),
        (f"<article><div class='entry-header'><h1>Title</h1></div><div class='social-body'>{PROSE}</div></article>", f"Title\n{LINES}"),
        (f"<div class=post><div class='entry-header'><h1>Title</h1></div>{PROSE}</div>", f"Title\n{LINES}"),
        ("".join(f"<div class=social>{PROSE}</div>" for _ in range(3)), "\n".join([LINES] * 3)),
        (f"<article>{PROSE}</article><div class=comments>" + f"<p>{ARTICLE}</p>" * 20 + "</div>", LINES),
    ],
)
def test_marked_elements_around_the_text_stay(page, text):
    assert extraction.main_text(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        # slugs of headings as ids, quotes with a listed word in their class
        (f"<article>{PROSE}<h2 id='social-impact'>Impact</h2>{PROSE}</article>", f"{LINES}\nImpact\n{LINES}"),
        (f"<article>{PROSE}<section id='login-flow'>{PROSE}</section></article>", f"{LINES}\n{LINES}"),
        (f"<div>{PROSE}<section id='cookie-recipes'><h2>Cookies</h2>{PROSE}</section></div>", f"{LINES}\nCookies\n{LINES}"),
        (f"<article>{PROSE}<blockquote class='social-quote'><p>{ARTICLE}</p></blockquote></article>", f"{LINES}\n{ARTICLE}"),
        # the same words where they mark furniture
        (f"<article>{PROSE}<div class='social-share-tools'>Share: <a href=x>one place</a><a href=y>another</a></div></article>", LINES),
        (f"<article>{PROSE}<div class='ad-slot-4'><p>{ARTICLE}</p></div><div id=newsletter-signup><p>Mail.</p></div></article>", LINES),
        (f"<article>{PROSE}<div id='comments'><div id='comment-12' class='comment even'><p>{ARTICLE}</p></div></div></article>", LINES),
        (f"<article>{PROSE}<section id='related-posts'><p>{ARTICLE}</p></section></article>", LINES),
        # columns
        (f"<div class=row><div class=col>{PROSE}</div></div>" * 2, f"{LINES}\n{LINES}"),
        (f"<body><div id=all><div class='row a'><div class=col>{PROSE}</div></div><div class='row b'><div class=col>{PROSE}</div></div>"
         f"<div class=foot><div><p>{ARTICLE}</p></div></div></div></body>", f"{LINES}\n{LINES}"),
        # a heading in a box of its own
        (f"<div><div class=title><h1>Title</h1></div><div class=text>{PROSE}</div></div>", f"Title\n{LINES}"),
        (f"<div id=post><div class=title><h1>Title</h1></div><div><div class=text>{PROSE}</div></div></div>", f"Title\n{LINES}"),
        (f"<article><div><h1>Title</h1></div><div><div>{PROSE}</div></div><p>End.</p></article>", f"Title\n{LINES}\nEnd."),
        # a blog theme and a documentation page
        (f"<body class='home single-post'><header id=masthead class=site-header><a href=/>Site</a></header><div id=page class=site>"
         f"<main id=primary class=site-main><article id=post-7 class='post hentry tag-social'><header class=entry-header><h1 class=entry-title>"
         f"Title</h1></header><div class=entry-content>{PROSE}<div class='sharedaddy sd-sharing'><a href=x>Share it</a></div></div>"
         f"<footer class=entry-footer><a href=t>tag</a></footer></article><div id=comments class=comments-area><p>{ARTICLE}</p></div></main>"
         f"<aside id=secondary class=widget-area><p>{ARTICLE}</p></aside></div></body>", f"Title\n{LINES}"),
        (f"<body><nav class=toc><ul><li><a href=#a>A</a></ul></nav><div class=document><div class=body role=main><section id=notice-periods>"
         f"<h1>Guide</h1>{PROSE}<section id=menu-options><h2>Menu</h2>{PROSE}<pre>x = 1</pre></section></section></div></div>"
         f"<div class=sphinxsidebar><p>s</p></div></body>", f"Guide\n{LINES}\nMenu\n{LINES}\nx = 1"),
    ],
)
def test_no_text_of_the_article_is_lost(page, text):
    assert extraction.main_text(page) == text


def test_article_in_several_sibling_containers():
    long, short = "word " * 60 + "end, of it, all, of, it", "part, " + "x" * 94
    first = "<div>" + f"<p>{long}</p>" * 3 + "</div>"
    second = f"<div><p>{short}</p><p>{short}</p></div>"
    menu = "<div>" + "<p><a href=x>link, link</a></p>" * 5 + "</div>"
    page = f"<div><h2>Head</h2>{first}<h3>Then</h3>{second}<p>The end.</p>{menu}<p>Far.</p></div>"
    want = ["Head", *[long] * 3, "Then", short, short, "The end."]
    assert extraction.main_text(page) == "\n".join(want)


def test_articles_of_the_sample_are_documents(spark, sf_dir):
    squeezed = lambda t: " ".join(t.split())
    docs = {squeezed(r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()}
    rows = extraction.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()
    assert all(squeezed(r.text.partition("\n")[2]) in docs and r.n_chars == len(r.text) for r in rows)
    assert extraction.extract(pages_of(spark, [])).count() == 0
    assert extraction.extract(pages_of(spark, [(None, None, None)] * 2)).collect() == [(None, None, "", 0)] * 2


def exact(rows, every, k):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        far = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, far)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[i]), float(far[i])) for i in order]
    return out


def test_neighbours(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    want, hits = exact(rows, 10, 10), 0
    got = ann.nearest(table, every=10, shard_rows=64).collect()
    for r in got:
        hits += r.vec_id in {v for v, _ in want[r.query_id]}
    assert len(got) == 10 * len(want) and hits >= 0.9 * len(got)


@pytest.mark.parametrize("clusters", [0, 40])
def test_recall_of_a_whole_shard_for_strangers(clusters):
    draw = np.random.default_rng(clusters)
    rows, k = ann.SHARD_ROWS + 200, 10
    x = draw.normal(size=(rows, 64)).astype(np.float32)
    if clusters:
        x = (draw.normal(size=(clusters, 64))[draw.integers(0, clusters, rows)] + 0.6 * x).astype(np.float32)
    x, queries = x[:-200], x[-200:]
    links, entry = ann.build_graph(x)
    met, _ = ann.beam_search(x, links, entry, queries, ann.BEAM)
    far = ((queries[:, None, :] - x[None]) ** 2).sum(-1)
    want = np.argsort(far, axis=1)[:, :k]
    assert np.mean([np.isin(w, m).mean() for w, m in zip(want, met, strict=True)]) >= 0.9


def test_neighbours_with_ties_and_useless_vectors(spark):
    draw = np.random.default_rng(1)
    good = [(i, draw.normal(size=4).astype(np.float32).tolist()) for i in range(40)]
    same = [(100 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(50)]
    bad = [(200, None), (300, [0.0] * 4), (400, [1.0, None, 1.0, 1.0]), (500, [float("nan")] * 4), (None, [1.0] * 4), (600, [])]
    rows = [*good, *same, *bad, good[0], (700, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, shard string, score int")
    want = exact([*good, *same], 100, 10)
    got = {}
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == want
    assert ann.nearest(df.filter("vec_id < 0")).count() == 0
    few = {r.vec_id for r in ann.nearest(df.filter("vec_id in (0, 1, 2)")).collect()}
    assert few == {1, 2}


def test_queries_meet_shards_in_bounded_blocks(spark):
    assert ann.shard_count(0) == 1 and ann.shard_count(40_000) == 20
    assert ann.shard_count(117_000_000) * ann.SHARD_ROWS >= 117_000_000 > (ann.shard_count(117_000_000) - 1) * ann.SHARD_ROWS
    assert ann.block_count(500, 64) == 1 and ann.block_count(1_200_000, 64) * ann.BLOCK_BYTES >= 1_200_000 * 256
    draw = np.random.default_rng(2)
    rows = [(i, draw.normal(size=8).astype(np.float32).tolist()) for i in range(200)]
    rows = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    index = ann.build_index(rows, 11, 64)
    whole = sorted(ann.search(index, rows).collect())
    assert len(whole) == 2000 and sorted(ann.search(index, rows, block_rows=30).collect()) == whole
    want = exact([tuple(r) for r in rows.collect()], 1, 10)
    assert sum(r.vec_id in {v for v, _ in want[r.query_id]} for r in whole) >= 1900
