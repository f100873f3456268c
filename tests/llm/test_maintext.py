"""Main texts against pages whose article is known, and densities against a plain tree."""

import html
import math
import random
import re

import pytest

from tracewell.llm.catalog import QUERIES
from tracewell.llm.maintext import Page, densities, extract, main_text, name_kind, selected

PARAGRAPHS = [
    "The river rose over night & the lower fields were under water by dawn.",
    "Nobody in the village had seen it so high since the old bridge went down, forty years before.",
    "Short.",
    "They carried the seed upstairs, then the tools, and last of all the two chairs by the stove.",
]
NOISE = {
    "nav": "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav>",
    "header": "<header><a href='/'>The Daily Page</a><p>All the pages that fit</p></header>",
    "footer": "<footer><p>&copy; 2024 The Daily Page. All rights are reserved by the owners of it.</p></footer>",
    "aside": "<aside><h2>Most read</h2><p>Ten ways to read a page without a browser, and one with it.</p></aside>",
    "sidebar": "<div class='sidebar right'><p>About the author of this page and the others, of which there are few.</p></div>",
    "cookie": "<div id='cookie-notice'>We value your cookies, and would like to keep all of them. <button>OK</button></div>",
    "ad": "<div class=\"ad-slot\"><p>Buy two pages and get a third one for the price of the fourth, today only!</p></div>",
    "form": "<form action='/s'><label>Search</label><input name=q><textarea>words go here</textarea></form>",
    "script": "<script>if (a<b && c>d) document.write('<p>not text</p>')</script><style>p > a { color: red }</style>",
    "comments": "<section id='comments'><h3>2 comments</h3><article class='comment'><p>I have seen it as well, and "
                "it was higher than they say it was, by a hand at least.</p></article></section>",
}


def _article(paragraphs=PARAGRAPHS):
    return "<h1>High water</h1>" + "".join(f"<p>{html.escape(p)}</p>" for p in paragraphs)


WANT = "\n".join(["High water", *PARAGRAPHS])
FRAMES = {
    "article": "{top}<article>{text}</article>{end}",
    "noise inside": "<article>{text}{top}{end}</article>",
    "main": "{top}<div id=page><main>{text}</main>{end}</div>",
    "plain": "<div class='wrap'>{top}<div class='story'>{text}</div>{end}</div>",
    "deep": "{top}<table><tr><td><div><div><section>{text}</section></div></div></td></tr></table>{end}",
    "header inside": "{top}<article><header>{text}</header></article>{end}",
}


@pytest.mark.parametrize("frame", FRAMES)
def test_article_is_found_whatever_lies_around_it(frame):
    rng = random.Random(frame)
    for _ in range(20):
        noise = rng.sample(sorted(NOISE), rng.randrange(1, len(NOISE)))
        top = "".join(NOISE[k] for k in noise[::2])
        end = "".join(NOISE[k] for k in noise[1::2])
        page = ("<!DOCTYPE html><html><head><title>T</title></head><body class='no-sidebar'>"
                + FRAMES[frame].format(top=top, end=end, text=_article()) + "</body></html>")
        assert main_text(page.encode()) == WANT, page


def test_heading_before_the_block_and_paragraphs_beside_it():
    page = "<div><h1>High water</h1><div>" + "".join(f"<p>{p * 3}</p>" for p in PARAGRAPHS) + "</div></div>"
    assert main_text(page.encode()).split("\n") == ["High water", *[p * 3 for p in PARAGRAPHS]]


@pytest.mark.parametrize(("page", "want"), [
    (None, ""), ("", ""), ("   \n", ""), ("<p>", ""), ("only text &amp no tags", "only text & no tags"),
    ("<p>one<p>two<br>three<div>four</div>five", "one\ntwo three\nfour\nfive"),
    ("<article><p>a  b\n\tc&nbsp;d</p> <p> </p></article>", "a b c d"),
    ("<p>x < y and 1 <2 &lt;b&gt; &#233;&#x1F600; &am", "x < y and 1 <2 <b> é😀 &am"),
    ("<p>kept</p><!-- <p>not</p> --><p>also<!-- open", "kept\nalso"),
    ("<p>kept</p><script>never ends <p>not</p>", "kept"),
    ("<p>kept</p><a href='cut off", "kept"),
    ("<p title='a > b' class=x>in</p></div></span></p>", "in"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\nc"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\nb\nc\nd"),
    ("<p><b>bold<br><p>next</b> more", "bold\nnext more"),
    ("<TITLE>t</TITLE><P>UPPER</P>", "UPPER"),
    ("<p>seen</p><p hidden>not</p><div style='display: none'>nor</div>", "seen"),
    ("<nav>only a menu</nav><footer>and a footer</footer>", ""),
    ("<head><title>no end of head</title><p>text<body><p>more", "text\nmore"),
])
def test_small_pages(page, want):
    assert main_text(None if page is None else page.encode()) == want


def test_bad_bytes_and_huge_pages():
    assert main_text(b"<p>a\xff\xfeb</p>") == "a��b"
    assert main_text(b"<div>" * 200_000 + b"deep" + b"</p>" * 200_000) == "deep"
    assert main_text(b"<a \"" * 100_000) == ""
    assert main_text(b"<b>" * 50_000 + b"<p>x</i>" * 50_000).count("x") == 50_000
    long = " ".join(f"w{i}" for i in range(300_000))
    assert main_text(f"<article><p>{long}</p></article>".encode()) == long


def test_names():
    assert [name_kind(n) for n in ("comment-list", "userComments", "ad", "topAd", "adjacent", "has-sidebar",
                                   "comments-open", "page-header", "story")] == [
        "comment", "comment", "other", "other", "", "", "", "header", ""]


def _plain(page, out, node, body):
    """Density by walking the subtree of a node."""
    def below(i):
        kids = [k for k in range(len(page.tag)) if page.parent[k] == i and not out[k]]
        return [i, *[x for k in kids for x in below(k)]]

    def size(nodes):
        return sum(len(re.sub(r"\s", "", t)) for n, t in page.runs if t and n in nodes)

    def facts(i):
        nodes = below(i)
        links = [n for n in nodes if page.tag[n] == "a"]
        return size(set(nodes)), len(nodes) - 1, size({x for a in links for x in below(a)}), len(links)

    c, t, lc, lt = facts(node)
    bc, _, bl, _ = facts(body)
    if not c:
        return 0.0
    base = math.log(c / max(c - lc, 1) * lc + bl / max(bc, 1) * c + math.e ** 2)
    return c / max(t, 1) * math.log(c / max(lc, 1) * max(t, 1) / max(lt, 1), base)


def test_densities_against_a_plain_walk():
    rng = random.Random(4)
    for _ in range(20):
        text = "".join(rng.choice(["<div>", "</div>", "<p>", "<a href=x>", "</a>", "<span>", "</span>",
                                   "some words here ", "x"]) for _ in range(80))
        page = Page(f"<body>{text}</body>")
        out = page.left_out()
        body = page.body(out)
        density, sums = densities(page, out, body)
        want = [_plain(page, out, i, body) for i in range(len(page.tag))]
        assert density == pytest.approx(want)
        for i in range(len(page.tag)):
            assert sums[i] == pytest.approx(sum(want[k] for k in range(len(page.tag)) if page.parent[k] == i))
        chosen = selected(page, out)
        if "article" not in page.tag:
            best = max(range(body, len(sums)), key=lambda i: (sums[i], -i))
            assert chosen[best]


def test_query_gives_each_article_whole(spark, sf):
    pages = {r["page_id"]: r["html"] or "" for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = QUERIES["op13_main_text"](spark, sf).collect()
    assert sorted(r["page_id"] for r in got) == sorted(pages)
    for r in got:
        inner = pages[r["page_id"]].split("<article>")[1].split("</article>")[0]
        inner = re.sub(r"<[^>]*\Z", "", inner)
        blocks = [" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(b for b in blocks if b)
        assert r["n_chars"] == len(r["text"])


def test_odd_rows(spark):
    rows = [(1, "u", "<p>a</p>", "x"), (None, None, None, None), (1, "u", "<p>a</p>", "x"), (2, "", "", "y")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = sorted((r["page_id"] or 0, r["url"], r["text"], r["n_chars"]) for r in extract(df).collect())
    assert [(g[0], g[2], g[3]) for g in got] == [(0, "", 0), (1, "a", 1), (1, "a", 1), (2, "", 0)]
    assert extract(df.where("false")).count() == 0
