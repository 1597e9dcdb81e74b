"""Main text of web pages by minimum-cut labelling (operator 3).

A page is split into blocks of text. A classifier gives each block the cost of
calling it content and of calling it boilerplate; these are the capacities of
its terminal edges. Blocks that follow each other, and blocks of one container,
are tied by smoothness edges that weaken with their distance in the document
tree. The minimum cut is the labelling of least cost, and the blocks on the
content side are the text.

The classifier is a logistic model of what can be seen of a block and its
ancestors. It is fitted when a query starts, on TRAINING_PAGES generated pages
whose labels are known; a third of them have class names that say nothing, so
that the costs of a block by itself stay low where only its neighbours can tell
what it is. Its log odds are capped at MOST_COST for the same reason.

Names of classes count with some care: those of html and body, states such as
"has-sidebar" or "nav-open", and those of elements around an article, or around
most of a page's text, say nothing about a block.

Defined cases: null or empty html, and pages of nothing but boilerplate, give
an empty text; text without any markup is content; markup may be broken or cut
off anywhere: a head without end tag ends where its first text or element of a
body starts, and drawings, buttons and lists of options end where a block of
text starts that they can't hold; white space is what str.split() takes for it;
pages are parsed whole, in time linear in their length; a null page_id stays
null; repeated rows each get an output row; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from keepsight.llm import mincut
from keepsight.llm.tables import own_columns

# Fixed values of HTML: elements without end, without text of a page, and inside a line.
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
SILENT = frozenset("script style noscript template title textarea select option datalist button svg iframe object canvas audio video math head".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template head".split())
#: Elements that an opening tag of a kind closes when they are open.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
HEADINGS = frozenset(f"h{k}" for k in range(1, 7))
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 article section main header footer aside nav ul ol dl table blockquote pre form figure".split())
#: Silent elements that cannot hold a block of text; an open one ends where such a block starts.
ENDED_BY = {"svg": FLOW | {"div"}, "math": FLOW | {"div"}, "select": FLOW | {"div"}, "datalist": FLOW | {"div"}, "option": FLOW | {"div"}, "button": FLOW}
MARKED = frozenset("article main nav header footer aside form h1 h2 h3 h4 h5 h6 ul ol p pre blockquote table figure dialog".split())
#: Kinds of containers whose borders weaken the ties across them, and to what part.
SET_APART, BORDER = frozenset(("nav", "header", "footer", "aside", "form", "ad", "notice", "comments", "dialog", "bad", "top")), 0.05
#: Elements that set parts of a page apart.
BOXES = frozenset("article main nav header footer aside form dialog".split())
ROLES = {"navigation": {"nav"}, "banner": {"header"}, "contentinfo": {"footer"}, "complementary": {"aside"}, "main": {"main"}, "article": {"article"}, "search": {"form"}, "dialog": {"notice"}, "alert": {"notice"}}

# Words in class and id names, with their meaning.
NAMES = {
    "good": "article content post entry main story body text prose markdown copy".split(),
    "bad": "nav navigation menu navbar foot footer side sidebar aside widget related recommended share sharing social breadcrumb breadcrumbs crumbs pagination pager toolbar tags tagcloud meta links rail teaser teasers newsletter subscribe subscription signup login search bottombar colophon copyright skip trending popular".split(),
    "top": "head header masthead topbar".split(),
    "ad": "ad ads advert adverts advertisement advertising adsense banner promo promoted promotion sponsor sponsored dfp".split(),
    "notice": "cookie cookies notice consent gdpr popup modal overlay alert disclaimer privacy warning toast paywall".split(),
    "comments": "comment comments disqus reply replies respond discussion".split(),
}
MEANING = {word: kind for kind, words in reversed(NAMES.items()) for word in words}
#: Names that start or end like this tell of a state of the page, not of a block.
STATE_STARTS, STATE_ENDS = frozenset("has with no without is not show hide js".split()), frozenset("open closed active enabled disabled layout".split())
FEATURES = ("one", "article", "nav", "header", "footer", "aside", "form", "good", "bad", "bad inside", "ad", "notice", "comments", "heading", "list", "table", "links", "linked list", "words", "long", "sentence", "comma", "paragraph", "copyright", "outside", "bare", "before title", "small container")
ADJACENT, SIBLING, MOST_COST, TRAINING_PAGES = 3.0, 2.0, 4.0, 300
#: Share of a page's text around which names of a container say nothing.
WRAPS = 0.8
#: Characters up to which a container is small, if it has less than a fifth of the page's.
SMALL = 120
TOKENS = re.compile(r"[A-Za-z][a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "up", "depth", "block", "own", "names", "silences", "wraps", "chars", "marks")

    def __init__(self, tag: str, up: Node | None, own: set = frozenset(), names: set = frozenset(), silences: bool = False):
        self.tag, self.up, self.depth, self.own, self.names, self.silences = tag, up, up.depth + 1 if up else 0, own, names, silences
        self.block = up.block if up and tag in INLINE else self
        self.wraps, self.chars, self.marks = False, 0, frozenset()


class Block:
    """A run of text: linked counts its characters in links; bare tells that the page has no markup that means something, early that its title comes later, aside that it stands in a small container."""

    __slots__ = ("text", "node", "linked", "bare", "early", "aside")

    def __init__(self, text: str, node: Node, linked: int):
        self.text, self.node, self.linked, self.bare, self.early, self.aside = text, node, linked, False, False, False


def named(value: str) -> set[str]:
    """What class or id names say."""
    kinds = set()
    for name in value.split():
        # Parts with digits inside are made by programs and mean nothing.
        parts = [x for x in re.split("[^A-Za-z0-9]+", name) if not re.search("[0-9]", x.rstrip("0123456789"))]
        words = [w.lower() for x in parts for w in TOKENS.findall(x)]
        if words and words[0] not in STATE_STARTS and words[-1] not in STATE_ENDS:
            kinds |= {MEANING[w] for w in words if w in MEANING}
    return kinds


class Blocks(HTMLParser):
    """Collects the blocks of a page in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.node, self.silent, self.anchors = Node("#", None), 0, 0
        self.open: defaultdict[str, list[Node]] = defaultdict(list)  # open elements of each kind, the innermost last
        self.nodes, self.parts, self.linked, self.found = [self.node], [], 0, []

    def end_block(self) -> None:
        if self.parts:
            if text := " ".join("".join(self.parts).split()):
                self.found.append(Block(text, self.node.block, self.linked))
            self.parts, self.linked = [], 0

    def end_head(self) -> None:
        """Closes an open head, whose end tag may be left out."""
        self.pop_to(self.open["head"][-1])

    def handle_starttag(self, tag, attrs):
        if self.node.tag == "head" and tag not in HEAD or tag == "body" and self.open["head"] and not self.open["template"]:
            self.end_head()
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            elif tag not in INLINE:
                self.end_block()
            return
        if tag not in INLINE:
            self.end_block()
            for kind, enders in ENDED_BY.items():
                if self.open[kind] and tag in enders:
                    self.end_nearest(kind)
            self.end_open({"p"} if tag not in CLOSES else CLOSES[tag], within=tag in CLOSES)
        elif tag == "a" and self.open["a"]:
            self.end_inline("a")
        own, names = {tag} if tag in MARKED else set(), set()
        for name, value in attrs:
            if name == "role" and value:
                own |= ROLES.get(value.strip().lower(), set())
            elif name in ("class", "id") and value and tag not in ("html", "body"):
                names |= named(value)
            elif name in ("hidden", "aria-hidden") and value != "false" and tag not in ("html", "body"):
                own.add("hidden")
        self.node = Node(tag, self.node, own, names, tag in SILENT or "hidden" in own)
        self.nodes.append(self.node)
        if own & {"article", "main"}:
            node = self.node.up
            while node and not node.wraps:
                node.wraps, node = True, node.up
        self.open[tag].append(self.node)
        self.silent += self.node.silences
        self.anchors += tag == "a"

    def end_nearest(self, tag: str) -> None:
        self.pop_to(self.open[tag][-1])

    def end_inline(self, tag: str) -> None:
        """Closes an open inline element of the running text."""
        if self.open[tag] and self.open[tag][-1].depth > self.node.block.depth:
            self.pop_to(self.open[tag][-1])

    def innermost(self, tags) -> Node | None:
        return max((self.open[t][-1] for t in tags if self.open[t]), key=lambda node: node.depth, default=None)

    def end_open(self, tags: set, within: bool) -> None:
        """Closes the innermost open element of these tags; within: only inside the nearest list or table, else only around running text."""
        node, holder = self.innermost(tags), self.innermost(("ul", "ol", "dl", "table")) if within else self.node.block
        if node and (holder is None or holder.depth <= node.depth):
            self.pop_to(node)

    def pop_to(self, node: Node) -> None:
        end = node.up
        while self.node is not end:
            self.silent -= self.node.silences
            self.anchors -= self.node.tag == "a"
            self.open[self.node.tag].pop()
            self.node = self.node.up

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.end_block()
        if self.open[tag] and (tag not in INLINE or self.open[tag][-1].depth > self.node.block.depth):
            self.pop_to(self.open[tag][-1])

    def handle_data(self, data):
        if self.node.tag == "head" and data.strip():
            self.end_head()
        if not self.silent:
            self.parts.append(data)
            if self.anchors:
                self.linked += len(data)


#: What a scan for comments stops at: declarations, and elements whose content is no markup.
MARKED_SECTIONS = re.compile(r"<(?:[!?]|(script|style|textarea|title|xmp|iframe|noembed|noframes)(?=[\s/>]))", re.I)
COMMENT_END, DOCTYPE = re.compile("--!?>"), re.compile(r"<!doctype[^>\[]*(?:\[[^\]]*\][^>]*)?>", re.I)


def without_declarations(html: str) -> str:
    """html without comments, declarations and processing instructions, closed or not, and without a tag that never ends; one pass."""
    last = html.rfind(">") + 1
    if cut := re.compile("<[A-Za-z/]").search(html, last):
        html = html[: cut.start()]
    out, at, closings = [], 0, {}
    while m := MARKED_SECTIONS.search(html, at):
        start = m.start()
        out.append(html[at:start])
        if m[1]:
            end, inner = closings.get(kind := m[1].lower()), html.find(">", m.end()) + 1
            if kind not in closings or end and end.start() < inner:
                end = closings[kind] = re.compile(f"</{kind}(?=[\\s/>])", re.I).search(html, inner) if inner else None
            if end:
                out.append(html[start:inner] if kind != "xmp" else html[start : end.start()])
                at = end.start()
            elif kind in ("script", "style"):  # the rest of the page is in it
                at = len(html)
            else:
                out.append(html[start : m.end()])
                at = m.end()
            continue
        if html.startswith("<!--", start):
            short = re.compile("<!---?>").match(html, start)
            end = short or COMMENT_END.search(html, start + 4)
        else:
            end = DOCTYPE.match(html, start) or re.compile(">").search(html, start)
        at = end.end() if end else len(html)
    return "".join([*out, html[at:]])


def blocks_of(html: str) -> list[Block]:
    parser = Blocks()
    parser.feed(without_declarations(html))
    parser.close()
    parser.end_block()
    total = 0
    for b in parser.found:
        b.node.chars += len(b.text)
        total += len(b.text)
    for node in reversed(parser.nodes[1:]):
        node.up.chars += node.chars
    for node in parser.nodes[1:]:
        around = node.wraps or node.chars > WRAPS * total and node.names != {"comments"}
        node.marks = node.up.marks | node.own | (node.names & {"good"} if around else node.names)
    plain = not any(node.own & BOXES or node.names for node in parser.nodes)
    title = next((i for i, b in enumerate(parser.found) if "h1" in b.node.marks), 0)
    for i, b in enumerate(parser.found):
        b.bare, b.early, b.aside = plain, i < title, bool(b.node.up) and b.node.up.chars < min(SMALL, total / 5)
    return parser.found


def features(block: Block) -> list[float]:
    m, text = block.node.marks, block.text
    words = text.count(" ") + 1
    inside = bool(m & {"article", "main"})
    share = min(1.0, block.linked / len(text))
    listed, held = bool(m & {"ul", "ol"}), not m & SET_APART - {"bad", "header", "top"}
    return [
        1.0, inside, "nav" in m, bool(m & {"header", "top"}) and not inside, "footer" in m, "aside" in m, "form" in m,
        "good" in m, "bad" in m and not inside, "bad" in m and inside, "ad" in m, "notice" in m or "dialog" in m, "comments" in m,
        bool(m & HEADINGS) and held, listed and held, "table" in m and held, share, listed and share > 0.5, min(1.0, words / 20), min(1.0, words / 80),
        text[-1] in ".!?…:\"”»", ", " in text, bool(m & {"p", "blockquote", "pre"}), "©" in text, not inside and "good" not in m, block.bare,
        block.early and not inside, block.aside and not inside,
    ]


class Writer:
    """Writes one page with known labels: menus, notices and so on around an article."""

    def __init__(self, rng: random.Random):
        self.rng, self.out, self.want, self.style = rng, [], [], rng.choice(("semantic", "named", "silent"))

    def text(self, lo: int, hi: int, end: str = ".") -> str:
        r = self.rng
        words = ["".join(r.choice("aeioustrnlmdpé") for _ in range(r.randint(1, 9))) + ("," if r.random() < 0.06 else "") for _ in range(r.randint(lo, hi))]
        return (" ".join(words).rstrip(",").capitalize() + end) if words else ""

    def put(self, label: bool, html: str) -> None:
        self.out.append(html)
        self.want.append(label)

    def box(self, tag: str, names: list[str], fill) -> None:
        """A container: by its tag, by a name, or by nothing."""
        r = self.rng
        if self.style == "semantic" and tag != "div" and r.random() < 0.8:
            head, end = tag, tag
        elif self.style == "silent" and r.random() < (0.9 if tag != "div" else 0.4):
            head, end = f'div class="c{r.randrange(16**5):05x}"', "div"
        else:
            extra = r.choice(["", "", " left", " block", " is-wide", " col-4"])
            head, end = f'{r.choice(("div", "div", "section"))} class="{r.choice(names)}{extra}"', None
            end = head.split()[0]
        self.out.append(f"<{head}>")
        fill()
        self.out.append(f"</{end}>")

    def links(self, n: int) -> None:
        self.out.append("<ul>")
        for _ in range(n):
            self.put(False, f'<li><a href="/x">{self.text(1, 4, "")}</a></li>')
        self.out.append("</ul>")

    def teasers(self, n: int) -> None:
        for _ in range(n):
            self.put(False, f'<h3><a href="/x">{self.text(3, 9, "")}</a></h3>')
            if self.rng.random() < 0.5:
                self.put(False, f"<p>{self.text(5, 18)}</p>")

    def noise(self, inside: bool = False, kind: str | None = None) -> None:
        r, text = self.rng, self.text
        several = lambda lo, hi, n: [self.put(False, f"<p>{text(lo, hi)}</p>") for _ in range(n)]
        kinds = {
            "menu": lambda: self.box("nav", ["nav", "main-menu", "navbar", "topbar"], lambda: self.links(r.randint(3, 8)) if r.random() < 0.6 or self.style == "silent" else several(1, r.choice((4, 60)), r.randint(1, 4))),
            "side": lambda: self.box("aside", ["sidebar", "related-links", "widget", "rail"], lambda: (self.teasers(r.randint(1, 3)), self.links(r.randint(2, 5)))),
            "ad": lambda: self.box("div", ["ad", "advert", "ad-banner", "sponsored", "promo"], lambda: self.put(False, text(3, 60))),
            "notice": lambda: self.box("div", ["cookie-notice", "consent", "notice", "gdpr-banner"], lambda: several(8, 60, 1)),
            "form": lambda: self.box("form", ["search-form", "newsletter", "subscribe", "login"], lambda: self.put(False, f"<label>{text(2, 8, '')}</label><input>")),
            "share": lambda: self.box("div", ["share", "breadcrumbs", "pagination", "tags"], lambda: self.links(r.randint(2, 5))),
            "comments": lambda: self.box("div", ["comments", "comment-list", "replies"], lambda: several(4, 120, r.randint(1, 4)) if r.random() < 0.5 else (self.out.append("<ol>"), [self.put(False, f"<li>{text(2, 90)}</li>") for _ in range(r.randint(1, 4))], self.out.append("</ol>"))),
        }
        # What nothing tells from content is left out where names say nothing.
        known = ["menu", "side", "share"] if self.style == "silent" else [*kinds]
        kinds[kind or r.choice(["ad", "share", "side", "notice"] if inside and self.style != "silent" else known)]()

    def article(self) -> None:
        r, text = self.rng, self.text
        if r.random() < 0.9:
            head = r.choice(("div", "header")) if self.style != "silent" and r.random() < 0.3 else ""
            out = f'<{head} class="{r.choice(("entry-header", "post-header", "article-head", "story-header"))}">' if head else ""
            self.put(True, f"{out}<h1>{text(2, 12, '')}</h1>{head and f'</{head}>'}")
        for _ in range(r.randint(1, 8)):
            for _ in range(r.randint(1, 3)):
                self.put(True, f"<p>{text(1, r.choice((6, 40, 150)))}{f' <a href=/y>{text(1, 3, str())}</a> {text(1, 20)}' if r.random() < 0.2 else ''}</p>")
            kind = r.random()
            if kind < 0.15:
                self.put(True, f"<h2>{text(1, 8, '')}</h2>")
            elif kind < 0.25:
                self.out.append("<ul>")
                for _ in range(3):
                    self.put(True, f"<li>{text(1, 25, r.choice(('', '.')))}</li>")
                self.out.append("</ul>")
            elif kind < 0.3:
                self.put(True, f"<blockquote>{text(5, 40)}</blockquote>")
            elif kind < 0.34:
                self.out.append("<table><tr>")
                for _ in range(4):
                    self.put(True, f"<td>{text(1, 5, '')}</td>")
                self.out.append("</tr></table>")
            elif kind < 0.38:
                self.put(True, f"<pre>{text(3, 30)}</pre>")
            elif kind < 0.5:
                self.noise(inside=True)
            elif kind < 0.58:
                for _ in range(r.randint(2, 5)):
                    self.out.append("<div>")
                    self.put(True, f"<div>{text(1, 10, r.choice(('', '?')))}</div>")
                    self.put(True, f"<div>{text(1, 60)}</div>")
                    self.out.append("</div>")
            elif kind < 0.62:
                self.put(True, f"<p><a href=/z>{text(1, 8, '')}</a></p>")
        if self.style != "silent" and r.random() < 0.25:
            self.noise(kind=r.choice(("comments", "comments", "form", "share")))

    def page(self) -> tuple[str, list[bool]]:
        r, out, text = self.rng, self.out, self.text
        if r.random() < 0.12:  # nothing but text
            shape = r.choice(("<div>{}</div>", "<p>{}</p>", "{}<hr>"))
            out.append(r.choice(("", "<div>", "<body><div class=page>")))
            if r.random() < 0.3:
                self.put(True, f"<h1>{text(1, 6, '')}</h1>")
            for _ in range(r.randint(1, 6)):
                self.put(True, shape.format(text(1, 80)))
            return "".join(out), self.want
        if r.random() < 0.08:  # nothing but boilerplate
            for _ in range(r.randint(1, 3)):
                self.noise()
            return "".join(out), self.want
        around = r.choice(["", "page has-sidebar with-footer", "wrapper", "main-nav-open layout"])
        out.append(f'<body class="{around}"><div class="{around}">')
        self.box("header", ["header", "masthead", "site-header"], lambda: self.put(False, f"<h2>{text(1, 4, '')}</h2>" if r.random() < 0.7 else f"<p>{text(2, 30)}</p>"))
        for _ in range(r.randint(1, 3)):
            self.noise()
        if self.style == "semantic" and r.random() < 0.85:
            tag = r.choice(("article", "main"))
            out.append(f"<{tag}>")
            self.article()
            out.append(f"</{tag}>")
        else:
            silent = self.style == "silent" or r.random() < 0.3
            out.append(f'<div class="{f"c{r.randrange(16**5):05x}" if silent else r.choice(("content", "post-body", "entry", "story", "article-text", "main-column"))}">')
            self.article()
            out.append("</div>")
        for _ in range(r.randint(0, 3)):
            self.noise()
        self.box("footer", ["footer", "site-footer", "colophon"], lambda: [self.put(False, f"<p>{r.choice(('© ', ''))}{text(2, r.choice((14, 14, 60)), r.choice(('', '.')))}</p>") for _ in range(r.randint(1, 2))])
        out.append("</div></body>")
        return "".join(out), self.want


def generated_page(rng: random.Random) -> tuple[str, list[bool]]:
    """A page and the label of each of its blocks."""
    return Writer(rng).page()


def fit_weights(pages: int = TRAINING_PAGES, seed: int = 7, ridge: float = 0.003) -> list[float]:
    """Weights of the logistic model, by Newton steps."""
    rng, x, y = random.Random(seed), [], []
    for _ in range(pages):
        html, want = generated_page(rng)
        found = blocks_of(html)
        if len(found) != len(want):
            raise AssertionError("a generated page has other blocks than labels")
        x += map(features, found)
        y += want
    x, y = np.array(x, float), np.array(y, float)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(y) / 100 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - ridge * len(y) / 100 * w)
    return w.tolist()


def border(a: Block, b: Block) -> float:
    """How much weaker ties are between blocks of which one is in a kind of container that the other isn't in."""
    return BORDER if (a.node.marks ^ b.node.marks) & SET_APART else 1.0


def apart(a: Node, b: Node) -> int:
    """Steps from a to b in the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
        steps += 1
    return steps


def costs_and_edges(found: list[Block], weights: list[float]) -> tuple[list[tuple[float, float]], list[tuple[int, int, float]]]:
    """What it costs to call each block content or boilerplate, and what to call two related blocks different."""
    z = np.clip(np.array([features(b) for b in found], float) @ np.array(weights), -MOST_COST, MOST_COST)
    costs = list(zip(np.log1p(np.exp(-z)).tolist(), np.log1p(np.exp(z)).tolist(), strict=True))
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, ADJACENT * border(found[i - 1], b) / (1 + apart(found[i - 1].node, b.node))))
        container = b.node.up or b.node
        for part, node in ((1.0, container), (0.5, container.up)):
            if node and node.up:
                before = last.get(id(node))
                if before is not None:
                    edges.append((before, i, part * SIBLING * border(found[before], b) / (i - before)))
                last[id(node)] = i
    return costs, edges


def content(found: list[Block], weights: list[float]) -> list[bool]:
    """Which blocks are content."""
    return mincut.labels(*costs_and_edges(found, weights)) if found else []


def main_text(html: str | None, weights: list[float]) -> str:
    found = blocks_of(html or "")
    return "\n\n".join(b.text for b, keep in zip(found, content(found, weights), strict=True) if keep)


def extract_batches(weights: list[float]):
    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py(), weights) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract_main_text(pages: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """A row for each page: page_id, url, text, n_chars."""
    return own_columns(pages, ["page_id", "url", "html"]).mapInArrow(extract_batches(weights or fit_weights()), "page_id long, url string, text string, n_chars long")
