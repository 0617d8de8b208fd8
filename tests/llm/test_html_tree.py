import itertools

import numpy as np

from corpusloom.llm import html_tree as H


def test_sum_product_against_all_labellings():
    rng = np.random.default_rng(1)
    t = H.Tree([0, 1, 2, 1, 3, 4], [-1, 0, 0, 1, 1, 2], [[int(x)] for x in rng.integers(0, len(H.FEATURES), 6)], [None] * 6, [False] * 6)
    w = H.Potentials(rng.normal(size=len(H.FEATURES)), rng.normal(size=(len(H.TAGS), 2, 2)))
    f = H.ForestBatch([t, t])
    p, _, log_z = f.sum_product(w)
    weight = {}
    for y in itertools.product((0, 1), repeat=6):
        weight[y] = np.exp(sum(w.node[t.features[i][0]] * y[i] for i in range(6)) + sum(w.edge[t.tag[i], y[t.parent[i]], y[i]] for i in range(1, 6)))
    z = sum(weight.values())
    want = [sum(v for y, v in weight.items() if y[i]) / z for i in range(6)]
    assert np.allclose(p, want * 2) and np.isclose(log_z, 2 * np.log(z))


def test_held_out_layouts():
    w = H.default_potentials()
    trees = [H.unmark(H.parse(p)) for p in H.labelled_pages(80, seed=1234)]
    p, _, _ = H.ForestBatch(trees).sum_product(w)
    y = np.array([m for t in trees for m in t.mark])
    leaf = np.array([x is not None for t in trees for x in t.text])
    assert ((p > 0.5) == y)[leaf].mean() > 0.96


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">a</a></li></ul></nav>
<div class="ad">buy</div><article><h1>A &amp;
 title</h1><p><b>First<br>one.<p>Second &lt;b&gt; one of many words that go on for a while here.</p></article><footer>&copy; me</footer>"""


def test_page():
    assert H.texts([PAGE, None, "", "   "], H.default_potentials()) == ["A & title\n\nFirst one.\n\nSecond <b> one of many words that go on for a while here.", "", "", ""]


def test_boilerplate_around_and_within():
    comments = '<section class="comments"><h3>Comments</h3><article><p>I like this a lot really</p></article></section>'
    page = f"<html><body><div class='notice'><p>We use cookies</p></div><main><article><h2>Title here</h2><p>Short.</p><aside><p>related stuff</p></aside><form><p>sub</p></form></article>{comments}</main><aside class='sidebar'><p>side text that is rather long but still at the side, with many words in it</p></aside></body></html>"
    assert H.texts([page], H.default_potentials()) == ["Title here\n\nShort."]


def test_odd_markup():
    for page in ("<", "<p", "a<b", "<!--", "<script>x", "</p></div>", "<p>" * 500, "<div>" * 3000 + "x", "<a href='>x", '<p title="a>b">c</p>'):
        H.parse(page)
    assert [x for x in H.parse('<p title="a>b">c</p>').text if x] == ["c"]


def test_odd_rows(spark):
    rows = [(1, "u", PAGE, "k"), (1, "u", PAGE, "k"), (None, None, None, None), (2, "u", "", "k"), (3, "u", "<article><p>" + "word " * 200_000 + "</p></article>", "k")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, _x string")
    out = H.extract(df)
    got = {r.page_id: r.text for r in out.collect()}
    assert out.columns == [*df.columns, "text"] and len(got[3]) == 5 * 200_000 - 1 and got[2] == "" == got[None]
    assert H.extract(df.where("1 = 0")).count() == 0
