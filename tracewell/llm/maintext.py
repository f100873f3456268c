"""Main text of web pages by composite text density.

A page's tags become a tree in one pass. What is never article text is taken out first: by element (menus,
page headers, footers, asides, forms, scripts, styles), by role or hidden state, and by the words of class and
id names (adverts, notices, reader comments, ...). Every other node then has

    density = C / T * log(C / L * T / A, base ln(C / (C - L) * L + Lb / Cb * C + e * e))

with C characters and T tags below it, L characters and A tags of links below it, and Lb, Cb those of the
body (zeros count as one; e * e keeps the base at two or more on pages without links). The sum of its children's densities is largest for the node that holds the text
as its children. The lowest density on the path from that node to the body is the threshold: each node
that reaches it adds the largest-sum node below it. An ``article`` (or ``main``) around or within the
largest-sum node stands for it, so that short paragraphs at its edge stay; headings that precede the
selection in a block around it belong to it too.

Blocks end where block elements begin or end. A line break or table cell is white space within a block.
Each page is read once, whatever it holds: a tag without an end takes the rest of the page with it, like in
a browser, and elements deeper than ``DEEPEST`` lie beside each other.

Defined results: a null or empty page, and one without text outside what is taken out, has an empty
text; character references without a semicolon count where HTML allows them; bytes that aren't UTF-8 become
U+FFFD; repeated rows have equal results; an empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEEPEST = 512

# Names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section summary table tbody tfoot thead tr caption ul".split())
CELLS = frozenset("td th br".split())
CLOSES_P = BLOCK - frozenset("body caption dd dt frameset head html legend li optgroup option tbody tfoot thead tr".split()) | {
    "dd", "dt", "li"}
SCOPE = frozenset("applet caption html table td th marquee object template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements and roles that hold no article text.
NOT_TEXT = frozenset(
    "head nav footer aside script style noscript template iframe object svg canvas audio video button select "
    "textarea input datalist dialog menu search noembed noframes xmp title".split())
NOT_TEXT_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar "
    "tablist".split())
# Words in class and id names of what isn't article text.
COMMENT_WORDS = frozenset(
    "comment comments commentlist disqus replies reply respond".split())
OTHER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adbox adslot sponsor sponsored "
    "sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices notification "
    "notifications alert alerts popup popups modal overlay newsletter subscribe subscription signup login sidebar "
    "sidebars sidenav aside rail widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs footer "
    "masthead toolbar topbar share sharing social related recommended recommendations pagination pager copyright "
    "skip search form disclaimer legal outbrain taboola".split())
# A class that says what its element has, or is, around it, names no content of its own.
ABOUT_OTHERS = frozenset("no not has have with without is open enabled hide show".split())

# Possessive repeats: each character is read once for each kind of token.
TOKEN = re.compile(
    r"<!--(?:-?>|[\s\S]*?(?:--!?>|\Z))"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|"
    r"[^\s>\"'][^\s>]*+|(?=>)))?+)*+)>"
    r"|<(?P<cut>/?[A-Za-z][\s\S]*+)"
    r"|<[!?/][^>]*+(?:>|\Z)")
ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+)))?+")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def name_kind(name: str) -> str:
    """``comment``, ``other``, ``header`` or empty: what the words of a class or id name say."""
    found = {w.lower() for w in WORDS.findall(name)} | set(re.split(r"[^a-z]+", name.lower()))
    if found & ABOUT_OTHERS:
        return ""
    if found & COMMENT_WORDS:
        return "comment"
    return "other" if found & OTHER_WORDS else "header" if "header" in found else ""


class Page:
    """Nodes of a page in document order (a node's parent comes before it) and its text runs."""

    def __init__(self, source: str):
        self.tag, self.parent, self.kind = ["#"], [-1], [""]
        # Text runs as (node, text); (node, None) ends a block and (node, "") is white space.
        self.runs: list[tuple[int, str | None]] = []
        self._open, self._count = [0], Counter()
        self._kinds: dict[str, str] = {}
        self._read(source)

    def _read(self, source: str) -> None:
        at = 0
        while True:
            m = TOKEN.search(source, at)
            self._text(source[at:m.start() if m else len(source)])
            if m is None or m["cut"] is not None:
                return
            at = m.end()
            if not m["name"]:
                continue
            name = m["name"].lower()
            if m["end"]:
                self._close(name)
                continue
            node = self._start(name, m["attrs"])
            if name in RAW:
                end = RAW_END[name].search(source, at)
                if self._open[-1] == node:
                    self._pop_to(len(self._open) - 1)
                if end or not m["attrs"].endswith("/"):
                    at = end.start() if end else len(source)

    def _text(self, text: str) -> None:
        if text:
            if self._count["head"] and text.strip():
                self._leave("head")
            self.runs.append((self._open[-1], html.unescape(text) if "&" in text else text))

    def _pop_to(self, depth: int) -> None:
        for node in self._open[depth:]:
            self._count[self.tag[node]] -= 1
        del self._open[depth:]

    def _leave(self, name: str, stops: frozenset[str] = frozenset()) -> bool:
        """Closes the innermost open element of that name, unless one of ``stops`` is open inside it."""
        if self._count[name]:
            for depth in range(len(self._open) - 1, 0, -1):
                tag = self.tag[self._open[depth]]
                if tag == name:
                    self._pop_to(depth)
                    return True
                if tag in stops:
                    return False
        return False

    def _start(self, name: str, attrs: str) -> int:
        if name in ("html", "body") and self._count[name]:
            return -1
        if self._count["head"] and name not in IN_HEAD:
            self._leave("head")
        if name in CLOSES_P:
            self._leave("p", SCOPE | {"button"})
        if name == "li":
            self._leave("li", SCOPE | {"ul", "ol", "menu"})
        elif name in ("dd", "dt"):
            self._leave("dd", SCOPE | {"dl"}) or self._leave("dt", SCOPE | {"dl"})
        elif name == "option":
            self._leave("option", frozenset(["select"]))
        elif name in ("td", "th"):
            self._leave("td", frozenset(["tr", "table"])) or self._leave("th", frozenset(["tr", "table"]))
        elif name == "tr":
            self._leave("tr", frozenset(["table"]))
        elif name in ("tbody", "thead", "tfoot"):
            for other in ("tbody", "thead", "tfoot"):
                self._leave(other, frozenset(["table"]))
        elif name in HEADINGS and self.tag[self._open[-1]] in HEADINGS:
            self._pop_to(len(self._open) - 1)
        elif name == "a":
            self._leave("a", SCOPE | BLOCK)
        node = len(self.tag)
        self.tag.append(name)
        self.parent.append(self._open[-1])
        self.kind.append(self._kind(name, attrs))
        if name in BLOCK:
            self.runs.append((node, None))
        elif name in CELLS:
            self.runs.append((node, ""))
        if name not in VOID and len(self._open) < DEEPEST:
            self._open.append(node)
            self._count[name] += 1
        return node

    def _close(self, name: str) -> None:
        if name == "br":
            self.runs.append((self._open[-1], ""))
            return
        if name in BLOCK:
            self.runs.append((self._open[-1], None))
        elif name in CELLS:
            self.runs.append((self._open[-1], ""))
        if name in ("body", "html"):
            return
        if name in HEADINGS:
            for heading in HEADINGS:
                if self._leave(heading, SCOPE):
                    return
        elif name in BLOCK:
            self._leave(name, frozenset(["table"]) if name in ("tr", "tbody", "thead", "tfoot") else
                        SCOPE - {name})
        elif name in ("td", "th"):
            self._leave(name, frozenset(["table", "tr"]))
        else:
            self._leave(name, SCOPE | BLOCK)

    def _kind(self, name: str, attrs: str) -> str:
        """What an element is by itself: ``never`` text, ``comment``, ``other`` or empty."""
        if name in NOT_TEXT:
            return "never"
        if not attrs or attrs.isspace() or name in ("html", "body"):
            return ""
        kind = ""
        for m in ATTRIBUTE.finditer(attrs):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or (
                    key == "style" and INVISIBLE.search(value)):
                return "never"
            if key == "role" and value.lower() in NOT_TEXT_ROLES:
                kind = kind or "other"
            if key in ("class", "id"):
                for word in html.unescape(value).split():
                    if word not in self._kinds:
                        self._kinds[word] = name_kind(word)
                    said = self._kinds[word]
                    # The id of a section or paragraph is often its subject.
                    if said == "comment" or key == "class" or name not in ("section", "p"):
                        kind = said if said == "comment" else kind or said
        return kind

    def body(self, out: list[bool]) -> int:
        """The body's node, or the root if a page has none or text before it."""
        body = self.tag.index("body") if "body" in self.tag else 0
        early = any(text and not text.isspace() and not out[node] for node, text in self.runs if node < body)
        return 0 if early else body

    def left_out(self) -> list[bool]:
        """Per node whether it is no article text, by itself or by what it lies in."""
        n = len(self.tag)
        holds = [""] * n  # what lies in a node and speaks for it: an article, or more, a main heading
        for i in range(n - 1, 0, -1):
            own = "more" if self.tag[i] in ("main", "h1") else (
                "article" if self.tag[i] == "article" and not self.kind[i] else "")
            for what in (own, holds[i]):
                if what == "more" or what and not holds[self.parent[i]]:
                    holds[self.parent[i]] = what
        out, inside = [False] * n, [False] * n
        has_heading = [False] * n
        for i in range(n - 1, 0, -1):
            if self.tag[i] in HEADINGS or has_heading[i]:
                has_heading[self.parent[i]] = True
        for i in range(1, n):
            up, tag, kind = self.parent[i], self.tag[i], self.kind[i]
            inside[i] = inside[up] or tag in ("article", "main")
            if tag == "header" or kind == "header" and holds[i] != "more" and tag not in HEADINGS:
                own = not (inside[i] and has_heading[i])
            elif tag == "form":
                own = not holds[i]
            elif tag in ("article", "main"):
                own = kind in ("never", "comment") and tag == "article"
            else:
                own = kind == "never" or kind == "comment" and holds[i] != "more" or (
                    kind == "other" and not holds[i] and tag not in HEADINGS)
            out[i] = out[up] or own
        return out


def densities(page: Page, out: list[bool], body: int) -> tuple[list[float], list[float]]:
    """Composite text density of every node, and the sum of its children's."""
    n = len(page.tag)
    chars, tags, link_chars, link_tags = ([0] * n for _ in range(4))
    for node, text in page.runs:
        if text and not out[node]:
            chars[node] += len("".join(text.split()))
    for i in range(n - 1, 0, -1):
        if out[i]:
            continue
        up = page.parent[i]
        if page.tag[i] == "a":
            link_chars[i], link_tags[i] = chars[i], link_tags[i] + 1
        chars[up] += chars[i]
        tags[up] += tags[i] + 1
        link_chars[up] += link_chars[i]
        link_tags[up] += link_tags[i]
    linked = link_chars[body] / max(chars[body], 1)
    density, sums = [0.0] * n, [0.0] * n
    for i in range(n):
        c = chars[i]
        if c and not out[i]:
            plain, t = max(c - link_chars[i], 1), max(tags[i], 1)
            base = math.log(c / plain * link_chars[i] + linked * c + math.e ** 2)
            ratio = c / max(link_chars[i], 1) * t / max(link_tags[i], 1)
            density[i] = c / t * math.log(ratio) / math.log(base)
            if i:
                sums[page.parent[i]] += density[i]
    return density, sums


def selected(page: Page, out: list[bool]) -> list[bool]:
    """Per node whether its text belongs to the main text."""
    n, body = len(page.tag), page.body(out)
    density, sums = densities(page, out, body)
    inside = [False] * n
    for i in range(body, n):
        inside[i] = i == body or inside[page.parent[i]] and not out[i]
    best = max((i for i in range(n) if inside[i]), key=lambda i: (sums[i], -i), default=body)
    path = [best]
    while path[-1] != body:
        path.append(page.parent[path[-1]])
    roots = set()
    for tag in ("article", "main"):
        around = [i for i in path if page.tag[i] == tag]
        under = [False] * n
        for i in range(best, n):
            under[i] = i == best or inside[i] and under[page.parent[i]]
        within = [i for i in range(n) if under[i] and page.tag[i] == tag]
        if around or within:
            roots = {around[-1] if around else max(within, key=lambda i: (density[i] * 1e-9 + sums[i], -i))}
            break
    if not roots:
        # The largest sum at or below each node, and the nodes that reach the threshold.
        top = list(range(n))
        for i in range(n - 1, 0, -1):
            if inside[i] and i != body and sums[top[i]] > sums[top[page.parent[i]]]:
                top[page.parent[i]] = top[i]
        least = min(density[i] for i in path)
        roots = {best} | {top[i] for i in range(n) if inside[i] and i != body and density[i] >= least}
        first, around = min(roots), set(path)
        roots |= {i for i in range(n) if inside[i] and page.tag[i] in HEADINGS and i < first
                  and page.parent[i] in around}
    chosen = [False] * n
    for i in range(n):
        chosen[i] = inside[i] and (i in roots or i > 0 and chosen[page.parent[i]])
    return chosen


def main_text(source: bytes | None) -> str:
    """The main text of a page, a block per line."""
    if not source:
        return ""
    page = Page(source.decode("utf-8", "replace"))
    chosen = selected(page, page.left_out())
    blocks, parts = [], []
    for node, text in [*page.runs, (0, None)]:
        if text is None:
            block = " ".join("".join(parts).split())
            if block:
                blocks.append(block)
            parts = []
        elif text == "":
            parts.append(" ")
        elif chosen[node]:
            parts.append(text)
    return "\n".join(blocks)


def main_texts(source: Column) -> Column:
    @F.arrow_udf(T.StringType())
    def of(col: pa.Array) -> pa.Array:
        return pa.array([main_text(x.as_py()) for x in col], pa.string())

    return of(source.cast("binary"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (its code points) of every page."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), main_texts(F.col(source)).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("bigint"))
