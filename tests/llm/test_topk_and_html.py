import itertools
import math
import random

import pytest

from rillwork.llm import html_extract as H
from rillwork.llm import topk


def brute(queries, rows, k):
    q = lambda v: [math.floor(64 * x) for x in v]
    good = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    own = [(i, q(v)) for i, v in rows if i is not None and good(v)]
    out = []
    for i, v in sorted({(i, tuple(q(v))) for i, v in queries if i is not None and good(v)}):
        best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in own if j != i and len(w) == len(v))[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("tile", [7, 4096])
def test_top_k(spark, tile):
    r = random.Random(1)
    rows = [(i, [r.choice([-0.5, 0.25, 0.1, r.uniform(-1, 1)]) for _ in range(4)]) for i in range(150)]
    rows += [(3, rows[3][1]), (7, rows[8][1]), (200, None), (201, [1.0, None, 0.0, 0.0]), (202, [math.nan, 0.0, 0.0, 0.0]), (203, [math.inf, 0.0, 0.0, 0.0]), (204, [1.0, 2.0]), (220, [0.5, 0.5]), (205, []), (240, []), (None, [1.0] * 4), (206, [3e6, -2e6, 1e6, 5.0]), (207, [1e17, 1.0, 0.0, -1.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, score string, slot int").repartition(5)
    queries = [x for x in rows if x[0] is not None and x[0] % 20 == 0] + [rows[206 - 200 + 150]]
    got = topk.top_k(df.where("vec_id % 20 = 0 OR vec_id = 3"), df, 6, tile=tile).collect()
    want = brute([x for x in rows if x[0] is not None and (x[0] % 20 == 0 or x[0] == 3)], rows, 6)
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    assert sorted(map(tuple, got)) == [(a, b, c, clip(s)) for a, b, c, s in want]
    assert len(queries) and topk.top_k(df.where("false"), df).collect() == []
    assert topk.top_k(df.where("vec_id = 0"), df.where("vec_id = 0")).collect() == []


def test_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    assert sorted(map(tuple, topk.query(spark, d).collect())) == sorted(c.sql(topk.SQL).fetchall())


def test_min_cut_against_all_cuts():
    r = random.Random(4)
    for _ in range(150):
        n = r.randrange(1, 8)
        s, t = [r.randrange(10) for _ in range(n)], [r.randrange(10) for _ in range(n)]
        edges = [(a, b, r.randrange(6)) for a, b in itertools.combinations(range(n), 2) if r.random() < 0.5]
        cost = lambda side: sum(t[i] if side[i] else s[i] for i in range(n)) + sum(w for a, b, w in edges if side[a] != side[b])
        assert cost(H.min_cut(s, t, edges)) == min(map(cost, itertools.product([False, True], repeat=n)))


PAGES = {
    "<p>One &amp; two<br>three</p>  <p>Four\n five": None,
    "<html><head><title>No</title><style>p{}</style></head><body><header>Site</header><nav><a href=x>Home</a></nav><article><h1>Title</h1><p>First <b>bold</b>&nbsp;text.</p><aside>Related</aside><p>Second.<div class='ad'>Buy this great thing now, it is cheap.</div><ul><li>a<li>b</ul><script>var x='</p>';</script><!-- <p>no</p> --><form><input value=x>Send it to us</form><p>5 &lt; 6</p><section id=comments><p>I really liked this article, thank you very much.</p></section></article><footer>&copy; 2020</footer>": "Title\n\nFirst bold text.\n\nSecond.\n\na\n\nb\n\n5 < 6",
    "<div class='cookie-notice'>We use cookies to improve this site for you, accept them.</div><div id=main><p>This is a long first paragraph, with many words in it, that no one would call a menu.</p><p>Short.</p><p>And this is a long last paragraph, with many words in it too, which ends the page.</p></div><div class=sidebar><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div>": "This is a long first paragraph, with many words in it, that no one would call a menu.\n\nShort.\n\nAnd this is a long last paragraph, with many words in it too, which ends the page.",
    "<article><p>Unclosed text <b>runs on <p>and on <script>never ends": "Unclosed text runs on\n\nand on",
    "<article>a < b and c > d, AT&T &eacute; &#233; &bogus;</article>": "a < b and c > d, AT&T é é &bogus;",
    "<body class='single has-sidebar'><div id=page class='with-menu'><article class=post><div class=article-header><h1>Head</h1></div><div class=post-content><p>Body text.</p></div><div class=post-tags>tag one, tag two</div></article><div class=related-posts><p>Another story that you may like to read next, today.</p></div>": "Head\n\nBody text.",
    "<article></b></div><p>stray</p></article>": "stray",
    "": "",
}


@pytest.mark.parametrize("page, text", [(k, v) for k, v in PAGES.items() if v is not None])
def test_pages(page, text):
    assert H.extract(page) == text


def test_pages_table(spark):
    rows = [(i, f"u{i}", p, "x") for i, p in enumerate(PAGES)] + [(90, None, None, "x"), (91, "u", "<article>" + "<p>word word.</p>" * 20000, "x"), (91, "u", "<article><p>again", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = H.transform(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {(r.page_id, r.n_chars > 100): r.text for r in got}
    assert by[(91, True)] == "\n\n".join(["word word."] * 20000) and by[(91, False)] == "again" and by[(90, False)] == ""
    assert H.transform(df.where("false")).collect() == []


def test_real_pages(spark):
    for r in H.query(spark, "/root/testdata/sf0.001").collect():
        assert r.text and "<" not in r.text.replace(" < ", "")
