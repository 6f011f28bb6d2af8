import html
import random
import re

import pytest

from lexispark.llm import html_template as ht
from lexispark.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_whole_table_against_its_articles(spark):
    """The table's pages mark their article: an independent cut with regular expressions must agree."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = QUERIES["op8_template"](spark, SF).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<br>|</?b>", "", s)).split()) for s in re.split(r"</?h1>|</?p>", article))
        assert r.text == "\n\n".join(p for p in parts if p)
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def page(rng, words, host):
    """A page of a host whose template has no article element; returns html and main text."""
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    paragraphs = [text(rng.randint(5, 60)) for _ in range(rng.randint(2, 8))]
    title = text(4)
    body = f"<h1>{title}</h1>" + "".join("<p>" + p.replace(" ", " <b>", 1) + "</b>" for p in paragraphs)
    links = "".join(f"<li><a href='/x'>{text(2)}</a>" for _ in range(rng.randint(3, 9)))
    side = f"<div id=sidebar><p>{text(12)}</p></div>" if host % 2 else f"<aside><p>{text(9)}</p></aside>"
    comments = "".join(f"<div class=comment><p>{text(15)}</p></div>" for _ in range(rng.randint(0, 4)))
    raw = f"""<!doctype html><html><head><title>{title}</title><style>p>b{{}}</style></head><body class="has-sidebar">
<header><a href=/>Site {host}</a></header><div class="cookie-notice">We use &lt;cookies&gt;</div><nav><ul>{links}</ul></nav>
<div class="wrap"><div class="col-left"><script>document.write("<p>no</p>")</script>{body}<form><p>Mail: <input></p></form>
<section class="comments"><h2>Comments</h2>{comments}</section></div>{side}</div>
<div class=ad-slot><p>{text(6)}</p></div><footer><p>&copy; {host}</p></footer></body></html>"""
    return raw, "\n\n".join([title, *paragraphs])


def test_hosts_without_article_elements(spark):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "eps", "&amp;", "zeta&#233;", "eta"]
    rows, want = [], {}
    for i in range(90):
        raw, text = page(rng, words, i % 3)
        rows.append((i, f"https://h{i % 3}.example.org/{i}", raw, "x"))
        want[i] = html.unescape(text)
    rows.append((90, "https://other.example.org/", rows[0][2], "x"))
    want[90] = want[0]
    got = {r.page_id: r.text for r in ht.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got == want


def test_template_text_in_the_main_slot(spark):
    rng = random.Random(5)
    rows = [(i, "http://a.b/c", f"<body><main><p>{rng.random()} words</p><p>Share this page</p></main></body>") for i in range(40)]
    got = {r.page_id: r.text for r in ht.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("words" in t and "Share" not in t for t in got.values())


@pytest.mark.parametrize(
    "raw,text",
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<article>a<br>b  c&nbsp;d<p>e<div>f</div>g</article>", "a b c d\n\ne\n\nf\n\ng"),
        ("<article><p title='a>b'>x</p><!-- <p>no</p> --><p>y", "x\n\ny"),
        ("<article><ul><li>1<li>2</ul><table><tr><td>3<td>4</table></article>", "1\n\n2\n\n3\n\n4"),
        ("<body><nav>m</nav><article><header><h1>t</h1></header><p>x</p><div class='share social'>s</div></article><p>after</p>", "t\n\nx"),
        ("<article><p>2 < 3 and <3</p></article>", "2 < 3 and <3"),
        ("<p>unclosed <b", "unclosed"),
        ("<article><SCRIPT>x</SCRIPT ><p>k</p></article>", "k"),
    ],
)
def test_blocks(raw, text):
    assert ht.main_text(raw, None, frozenset()) == text


def test_edges(spark):
    schema = "page_id long, url string, html string"
    assert ht.extract(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, None), (None, "http://x/", "<p>a</p>"), (2, "bad url", "<p>b"), (2, "bad url", "<p>b"), (3, "http://x/", "<article>" + "<p>word " * 20_000)]
    got = sorted(((r.page_id, r.url, r.text[:1], r.n_chars) for r in ht.extract(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(1, None, "", 0), (None, "http://x/", "a", 1), (2, "bad url", "b", 1), (2, "bad url", "b", 1), (3, "http://x/", "w", 4 * 20_000 + 2 * 19_999)], key=str)


def test_many_hosts_are_joined_salted(spark, monkeypatch):
    monkeypatch.setattr(ht, "BROADCAST_HOSTS", 0)
    test_hosts_without_article_elements(spark)


def texts_of(spark, htmls):
    rows = [(i, f"http://site.example/{i}", h) for i, h in enumerate(htmls)]
    return {r.page_id: r.text for r in ht.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_each_layout_of_a_host_has_its_template(spark):
    rng = random.Random(8)
    story = lambda i: f"story {i} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))
    stories = [story(i) for i in range(30)]
    kinds = ["<div class=one><b>From the daily desk</b><p>{}</p></div>", "<div class=two><p>{}</p><span>Printed weekly</span></div>", "<section><div>Archive of the house</div><p>{}</p></section>"]
    got = texts_of(spark, ["<body>" + kinds[i % 3].format(s) + "</body>" for i, s in enumerate(stories)])
    assert got == dict(enumerate(stories))


def test_blocks_out_of_order_are_data(spark):
    """Sentences that all pages have, each page in an order of its own, stay; what stands in one place goes."""
    rng = random.Random(9)
    shared = [f"sentence {k} that every page has" for k in range(4)]
    htmls, want = [], []
    for i in range(24):
        order, own = rng.sample(shared, 4), f"page {i} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
        htmls.append("<body><div>From the daily desk</div>" + "".join(f"<p>{s}</p>" for s in order) + f"<p>{own}</p><div>Printed weekly</div></body>")
        want.append("\n\n".join([*order, own]))
    assert texts_of(spark, htmls) == dict(enumerate(want))


def test_copies_and_headings_are_data(spark):
    shared = ["a paragraph that the copies share", "and one more of theirs", "Background"]
    own = [f"page {i} says {i * 7919} things" for i in range(30)]
    body = lambda i, copy: f"<h2>{shared[2]}</h2><p>{shared[0]}</p><p>{shared[1]}</p><p>{own[i]}</p>" if copy else f"<p>{own[i]}</p>"
    for wrap in ("<article>{}</article>", "<div class=wrap>{}</div>"):
        got = texts_of(spark, [wrap.format(body(i, i % 3 > 0)) for i in range(30)])
        assert got == {i: "\n\n".join([shared[2], *shared[:2], own[i]] if i % 3 else [own[i]]) for i in range(30)}


def test_blocks_below_long_paths(spark):
    deep = "<div class='some-long-class-name of-the-page'>" * 60
    top = [f"top {i} " + " ".join(f"w{i}x{k}" for k in range(30)) for i in range(6)]
    htmls = [f"<main><p>{t}</p>{deep}<p>deep {i}</p></main>" for i, t in enumerate(top)]
    assert texts_of(spark, htmls) == {i: f"{t}\n\ndeep {i}" for i, t in enumerate(top)}


def test_title_lead_second_container_and_linked_blocks_stay(spark):
    raw = "<div class=post><h1>title {0}</h1><p>lead {0}</p><div class=body><p>{1}</p></div><div class=more><p>rest {0}</p><p><a href=/r>reference {0}</a></p></div></div>"
    long = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(6)]
    assert texts_of(spark, [raw.format(i, t) for i, t in enumerate(long)]) == {i: f"title {i}\n\nlead {i}\n\n{t}\n\nrest {i}\n\nreference {i}" for i, t in enumerate(long)}
    assert ht.main_text("<p>text</p><p><a href=/r>a linked reference</a></p>", None, frozenset()) == "text\n\na linked reference"
