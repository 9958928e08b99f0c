import time
from html.parser import HTMLParser

import numpy as np
import pytest

from seqloom.llm import dom, gbt, page_maker
from seqloom.llm import op6_html as op

PROSE = "The river rose slowly during the night, and by morning the lower fields stood under water. Nobody in the village had seen it so high."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p {{}}</style><script>var a = "<p>no</p>";</script></head><body>
<header class="masthead"><div class="logo">Site</div></header><nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/c">Contact</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies.</p><button>OK</button></div>
<article><h1>High   water</h1><p>{PROSE}</p><div class="ad">Buy boats now!</div><p>Tom &amp; Ann said: &ldquo;It&#39;s &eacute;t&#233;&rdquo;.\n  <b>Bold</b> text&nbsp;here.</p><!-- hidden --><ul><li>First point of the list.</li><li>Second point of the list.</li></ul><p>{PROSE}</article>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul></aside>
<section id="comments"><h2>Comments</h2><div class="comment"><p>Bob</p><p>Nice article, thanks for writing it.</p></div></section>
<form class="newsletter"><p>Subscribe</p><input name=q><button>Go</button></form><footer>&copy; 2024 Site. All rights reserved.</footer></body></html>"""


@pytest.fixture(scope="module")
def trees():
    return op.model()


def test_main_text(trees):
    assert op.main_blocks(PAGE, trees) == ["High water", PROSE, "Tom & Ann said: “It's été”. Bold text here.", "First point of the list.", "Second point of the list.", PROSE]


def test_odd_pages(trees):
    for html in (None, "", "   ", "<!-- only -->", "<", "<div", "</p></div>", "<script>never closed", "<nav><a href=/>x</a></nav>"):
        assert op.main_blocks(html, trees) == []
    deep = "<div>" * 3000 + f"<p>{PROSE}</p>"
    assert isinstance(op.main_blocks(deep, trees), list)


class _Plain(HTMLParser):
    """Texts between block tags, by the standard library's parser."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [[]], 0
        self.feed(html)
        self.close()
        self.out = [t for x in self.out if (t := " ".join("".join(x).split()))]

    def handle_starttag(self, tag, attrs):
        if tag in dom.UNSEEN or tag == "head":
            self.skip += 1
        elif tag not in dom.INLINE and (tag not in dom.VOID or tag in ("br", "hr")):
            self.out.append([])

    def handle_endtag(self, tag):
        if tag in dom.UNSEEN or tag == "head":
            self.skip -= 1
        elif tag not in dom.INLINE:
            self.out.append([])

    def handle_data(self, data):
        if not self.skip:
            self.out[-1].append(data)


def test_block_texts_are_those_of_another_parser(trees):
    for seed in range(60_000, 60_060):
        html = page_maker.Maker(seed).page()
        page = dom.Page(html)
        assert page.texts(np.ones(len(page.tag), bool)) == _Plain(html).out


def test_no_markup_leaks():
    for html, want in (
        ('<p>hello</p><p title="x>world</p>', ["hello", "world"]),
        ("<p>a</p><p title='it>b</p>", ["a", "b"]),
        ('<p title="a > b">c</p>', ["c"]),
        ("<p>a</ >b</p>", ["ab"]),
        ("<p>x<!-->y<!--->z<!-- q --!>w", ["xyzw"]),
        ("<p>3 < 4 and 5 > 2</p>", ["3 < 4 and 5 > 2"]),
        ('<p a="1"b=\'2\' c = "3>">d', ["d"]),
        ("<td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
    ):
        page = dom.Page(html)
        assert page.texts(np.ones(len(page.tag), bool)) == want


def test_long_pages_take_linear_time(trees):
    n = 5_000_000
    for part in ('<a "', "<a href='x", '<a href="x', "<!-- ", "<", "</", "<script/>", "<head>", "= ", "&amp"):
        start = time.process_time()
        dom.Page(f"<p>{part * (n // len(part))}")
        assert time.process_time() - start < 5, part
    deep = "<x>" * 50_000 + "<td></td></y>" * 50_000
    start = time.process_time()
    dom.Page(f"<td><div>{deep}")
    assert time.process_time() - start < 5
    text = " ".join(op.main_blocks(f"<article><h1>Long</h1>{f'<p>{PROSE}</p>' * 8000}</article>", trees))
    assert text.count(PROSE) == 8000 and len(text) > 1_000_000


def test_unseen_layouts(trees):
    """Pages of seeds that were not trained on: words of main text found, and words found that are main text."""
    hit = found = there = 0
    for seed in range(50_000, 50_120):
        page = dom.Page(page_maker.Maker(seed).page())
        kept = dom.decode(page, trees.log_odds(page.features()))
        label = op.labels_of(page)
        for node, pieces in page.blocks:
            n = len("".join(pieces).split())
            found += n * bool(kept[node])
            there += n * bool(label[node])
            hit += n * bool(kept[node] and label[node])
    assert hit / there > 0.97 and hit / found > 0.97


def test_a_kept_node_has_kept_ancestors_and_the_choice_is_the_best():
    r = np.random.default_rng(2)
    for _ in range(60):
        page = dom.Page("<div><p>a</p><div><p>b</p><p>c</p></div></div><p>d</p>")
        n = len(page.tag)
        odds = r.normal(size=n)
        kept = dom.decode(page, odds)
        assert all(kept[page.parent[i]] for i in range(1, n) if kept[i])
        best = max(
            sum(odds[i] for i in range(n) if m >> i & 1)
            for m in range(1 << n)
            if all(m >> page.parent[i] & 1 for i in range(1, n) if m >> i & 1)
        )
        assert sum(odds[kept]) == pytest.approx(max(best, 0))


def test_boosting_learns_an_interaction():
    r = np.random.default_rng(3)
    x = r.normal(size=(3000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    trees = gbt.fit(x[:2000], y[:2000])
    assert ((trees.log_odds(x[2000:]) > 0) == y[2000:]).mean() > 0.95


def test_query_on_odd_rows(spark, trees):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (3, "u", ""), (None, "u", PAGE), (4, "u", f"<article><h1>x</h1>{'<p>' + PROSE + '</p>'}</article>" * 50)]
    pages = spark.createDataFrame([(*x, "a", "b") for x in rows], "page_id bigint, url string, html string, text string, n_chars string").repartition(2)
    got = op.extract(pages, trees).collect()
    assert len(got) == len(rows)
    texts = {r["page_id"]: r["text"] for r in got}
    assert texts[1] == texts[None] == " ".join(op.main_blocks(PAGE, trees)) and texts[2] == texts[3] == ""
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert op.extract(pages.filter("false"), trees).count() == 0
