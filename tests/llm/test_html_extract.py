import os
import re
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

from wavemill.llm import html_extract as H

SF = "/root/testdata/sf0.01"


def zones(page, *wanted):
    return [t for z, t in H.settle_hints(H.blocks(page)) if z in wanted]


def test_blocks():
    page = """<!DOCTYPE html><head><title>T</title><style>p{}</style></head><body class="nav"><nav><a href="x">Menu</a></nav><!-- c <p>no</p> -->
    <div class="ad banner">Buy</div><article><h1>Head &amp; line</h1><p>One<br>two <b>bold</b>er&nbsp;x<p class='sidebar'>Side<p>Three &lt;4<aside>aside</aside>
    <script>var t="</p><p>no";</script><ul><li>i1<li>i2</ul><form>name <input></form></article><div id="comments"><p>Nice!</p></div><footer>&copy; us</footer>"""
    assert zones(page, H.ARTICLE) == ["Head & line", "One two bolder x", "Three <4", "i1", "i2"]
    assert zones(page, H.BOILERPLATE) == ["Menu", "Buy", "Side", "aside", "name", "Nice!", "\u00a9 us"]


def test_hints_never_empty_an_article_or_a_page():
    odd = '<article><header><h1>Title</h1></header><p class="share-price alert">Body</p><div id="related-work">More</div></article>'
    assert zones(odd, H.ARTICLE, H.DOUBT) == ["Title", "Body", "More"]
    assert zones('<article class="x"><p class="comment">only</p></article>', H.ARTICLE) == ["only"]
    assert zones('<div class="sidebar">only</div>', H.OPEN) == ["only"]
    assert zones('<div class="ad">never closed<article>text</article>', H.ARTICLE) == ["text"]
    assert zones('<article>text</article><div class="sidebar"><article>teaser</article></div>', H.ARTICLE) == ["text"]
    assert zones('<article>text<section><article>a comment</article></section></article>', H.ARTICLE) == ["text"]
    assert zones('<main><nav>m</nav><article>text</article></main>', H.ARTICLE) == ["text"]


def test_broken_markup():
    assert H.blocks(None) == H.blocks("") == []
    assert H.blocks("plain a < b <b unfinished") == [(H.OPEN, "plain a < b")]
    assert H.blocks('<nav>m<article>x<p a="1>y') == [(H.BOILERPLATE, "m"), (H.ARTICLE, "x"), (H.ARTICLE, "y")]
    assert H.blocks("</div></p>a</article>&amp b &#65;&bogus;") == [(H.OPEN, "a"), (H.OPEN, "& b A&bogus;")]


def brute(pages):
    """The texts of all pages, by counting every run of RUN tokens of every host in a dictionary."""
    found, holders = [], defaultdict(set)
    for i, (_, url, html) in enumerate(pages):
        host = m[1].lower() if (m := re.search("://([^/?#]*)", url or "")) else ""
        blocks = H.settle_hints(H.blocks(html))
        tokens = " ".join(t for z, t in blocks if z != H.ARTICLE).split(" ")
        runs = [(host, *tokens[k : k + H.RUN]) for k in range(len(tokens) - H.RUN + 1)]
        found.append((blocks, runs))
        for r in runs:
            holders[r].add(i)
    out = []
    for blocks, runs in found:
        parts, k = [], 0
        for z, t in blocks:
            for w in t.split(" "):
                if z == H.ARTICLE:
                    parts.append((z, w, 1))
                else:
                    parts.append((z, w, max((len(holders[r]) for r in runs[max(0, k - H.RUN + 1) : k + 1]), default=1)))
                    k += 1
        least = min((n for z, _, n in parts if z == H.OPEN), default=0)
        out.append(" ".join(w for z, w, n in parts if z == H.ARTICLE or z == H.OPEN and n == least))
    return out


def run(spark, pages):
    df = spark.createDataFrame([(*p, 1, "x") for p in pages], "page_id long, url string, html string, hash int, host string")
    return H.extract_main_text(df).collect()


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("marked", [True, False])
def test_whole_query_equals_brute_force(spark, marked):
    """With article elements, which settle every page of these tables, and with all markup that
    tells anything taken away, so that the suffix array decides every page."""
    pages = [(r["page_id"], r["url"], r["html"]) for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()]
    if not marked:
        pages = [(i, u, re.sub(r"<(/?)(article|nav|footer)\b|(<div) class=.ad.", lambda m: m[3] or f"<{m[1]}div", h)) for i, u, h in pages]
    got = {r["page_id"]: r["text"] for r in run(spark, pages)}
    expected = brute(pages)
    assert [got[i] for i, *_ in pages] == expected
    if marked:
        assert got == {i: " ".join(t for z, t in H.blocks(h) if z == H.ARTICLE) for i, _, h in pages}
    else:
        assert sum(t != " ".join(x for _, x in H.blocks(h)) for t, (_, _, h) in zip(expected, pages)) > 50


def test_hosts_of_any_size(spark):
    menu = "Home News Sport Weather Travel Money Culture Contact Imprint"
    nine = "this nine word block is here on two pages"
    rows = [(i, f"http://h.example/{i}", f"<div>{menu}</div><div>only{i} here{i} and nowhere{i}</div>" + f"<div>{nine}</div>" * (i in (1, 290)) + f"<div>{menu} extra{i}</div>") for i in range(300)]
    copied = "copied article text that is long enough to count as a run"
    rows += [(1000, "http://one.example/", f"<article><p>{copied}</p></article>"), (1001, "http://one.example/2", f"<article><p>{copied}</p></article>")]
    rows += [(1100 + i, f"http://two.example/{i}", f"<div>{copied}</div>") for i in range(2)]  # copies of each other
    rows += [(1200 + i, f"http://three.example/{i}", f"<div>{menu}</div><p>{copied if i < 2 else f'text{i}'}</p>") for i in range(5)]
    note = '<div class="notice">Please sign our petition before it is too late for all</div>'
    rows += [(1300 + i, f"http://four.example/{i}", f"<article>body{i} {note if i else note.replace('Please', 'Do')[:40] + '</div>'}</article>") for i in range(3)]
    rows += [(2000, None, None), (2001, "bad", ""), (None, "http://one.example/3", "<p>" + "word " * 50_000), (5, rows[5][1], rows[5][2])]
    got = run(spark, rows)
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    by = {r["page_id"]: r["text"] for r in got}
    assert all(by[i] == f"only{i} here{i} and nowhere{i} extra{i}" for i in range(300) if i != 5)
    assert Counter(r["page_id"] for r in got)[5] == 2 and by[5] == "only5 here5 and nowhere5 extra5"
    assert all(by[i] == copied for i in (1000, 1001, 1100, 1101, 1200, 1201)) and by[1203] == "text3"
    assert by[1301] == "body1" and by[1302] == "body2" and by[1300].startswith("body0 Do sign")
    assert by[2000] == by[2001] == "" and len(by[None]) == 5 * 50_000 - 1
    assert run(spark, []) == []
