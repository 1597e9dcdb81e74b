"""Pages written by hand in the manner of common site layouts, with the blocks that are content and those that are not."""

import random


class Sample:
    def __init__(self, seed: int):
        self.rng, self.content, self.other = random.Random(seed), [], []

    def words(self, n: int, stop: str) -> str:
        r = self.rng
        return " ".join(r.choice("river stone market winter paper engine garden light sudden quiet carry answer between because of the and a to in which under letter number open early".split()) for _ in range(n)).capitalize() + stop

    def c(self, n: int, stop: str = ".") -> str:
        self.content.append(self.words(n, stop))
        return self.content[-1]

    def b(self, n: int, stop: str = "") -> str:
        self.other.append(self.words(n, stop))
        return self.other[-1]

    def p(self, *sizes: int) -> str:
        return "".join(f"<p>{self.c(n)}</p>\n" for n in sizes)

    def links(self, n: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="#">{self.b(2)}</a></{tag}>' for _ in range(n))


def blog(s):
    return f"""<!doctype html><html class="no-js"><head><title>{s.words(3, '')}</title></head><body class="single single-post has-sidebar"><div id="page" class="site"><a class="skip-link screen-reader-text" href="#c">{s.b(3)}</a>
<header id="masthead" class="site-header"><p class="site-title"><a href="/">{s.b(2)}</a></p><p class="site-description">{s.b(5)}</p></header><nav id="site-navigation"><ul>{s.links(6)}</ul></nav>
<div id="content" class="site-content"><div id="primary" class="content-area"><main id="main"><article id="post-12" class="post type-post"><header class="entry-header"><h1 class="entry-title">{s.c(5, '')}</h1></header>
<div class="entry-content">{s.p(40, 12, 70)}<h2>{s.c(3, '')}</h2>{s.p(33, 4, 51)}<div class="sharedaddy sd-social share">{s.b(2)}<ul>{s.links(3)}</ul></div></div></article>
<div id="comments" class="comments-area"><h2 class="comments-title">{s.b(4)}</h2><ol class="comment-list"><li><div class="comment-body"><p>{s.b(30, '.')}</p></div></li><li><p>{s.b(12, '.')}</p></li></ol><div id="respond"><form>{s.b(3)}<textarea>x</textarea><input></form></div></div></main></div>
<aside id="secondary" class="widget-area"><section class="widget"><h2>{s.b(2)}</h2><ul>{s.links(5)}</ul></section></aside></div><footer id="colophon" class="site-footer"><div>{s.b(6)}</div></footer></div></body></html>"""


def opaque(s):
    body = "".join(f'<p class="pw{k}x9 ab ac">{s.c(n)}</p>' for k, n in enumerate((45, 60, 3, 80, 22, 37)))
    return f"""<html><body><div id="root"><div class="a1b c2d"><div class="x9z"><a href="/">{s.b(1)}</a></div><div class="x9z"><a href="/in">{s.b(2)}</a><a href="/up">x</a></div></div>
<div class="l3 m4"><h1 class="q7">{s.c(7, '')}</h1><div class="n5">{body}<h2 class="q8">{s.c(4, '')}</h2><ul class="u1"><li class="t2">{s.c(9)}</li><li class="t2">{s.c(5, '')}</li></ul></div></div>
<div class="z1y"><ul>{s.links(6)}</ul></div><div class="k0"><p class="j1"><a href="/h">{s.b(1)}</a> <a href="/t">Terms</a></p></div></div></body></html>"""


def tables(s):
    return f"""<html><head><title>x</title><body bgcolor=white><table width=100%><tr><td colspan=2 class=banner><font size=5>{s.b(3)}</font></td></tr><tr><td width=150 valign=top>{s.links(7, 'div')}</td>
<td valign=top><h1>{s.c(4, '')}</h1><p>{s.c(50)}<p>{s.c(41)}<p>{s.c(66)}<p>{s.c(18)}</td></tr></table></body></html>"""


def manual(s):
    return f"""<html><body><div class="related" role="navigation"><h3>{s.b(1)}</h3><ul>{s.links(4)}</ul></div><div class="document"><div class="documentwrapper"><div class="bodywrapper"><div class="body" role="main"><section><h1>{s.c(3, '')}</h1>
{s.p(25, 31)}<div class="highlight"><pre>{s.c(9, '')}</pre></div><p>{s.c(8, ':')}</p><ul class="simple"><li><p>{s.c(6, '')}</p></li><li><p>{s.c(11)}</p></li></ul><dl><dt>{s.c(2, '')}</dt><dd><p>{s.c(14)}</p></dd></dl></section></div></div></div>
<div class="sphinxsidebar"><h4>{s.b(2)}</h4><ul>{s.links(5)}</ul><div id="searchbox"><form class="search">{s.b(2)}<input></form></div></div></div><div class="footer">&copy; {s.b(5)}</div></body></html>"""


def news(s):
    return f"""<html><body class="nav-open"><div class="cookie-consent"><p>{s.b(30, '.')}</p><button>{s.words(1, '')}</button></div><header class="global-header"><div class="logo">{s.b(2)}</div><ul class="menu">{s.links(8)}</ul></header><div class="ad-slot">{s.b(6, '.')}</div>
<main><h1 class="headline">{s.c(9, '')}</h1><div class="article__body">{s.p(38, 29)}<div class="advert"><p>{s.b(9, '.')}</p></div>{s.p(44, 27)}<blockquote><p>{s.c(16)}</p></blockquote>{s.p(35)}<figure><img src=x><figcaption>{s.c(7)}</figcaption></figure>{s.p(12)}</div></main>
<div class="newsletter-signup"><h3>{s.b(4)}</h3><p>{s.b(14, '.')}</p></div><section class="related-stories"><h2>{s.b(2)}</h2><article-card><h3><a href=#>{s.b(8)}</a></h3></article-card><h3><a href=#>{s.b(7)}</a></h3></section><footer><p>{s.b(9)}</p><ul>{s.links(5)}</ul></footer></body></html>"""


def diary(s):
    return f"""<html><body><div id="wrap"><div id="header"><h1><a href="/">{s.b(2)}</a></h1><div>{s.b(5)}</div></div><div id="menu"><ul>{s.links(5)}</ul></div><div class="post"><h2>{s.c(4, '')}</h2><div class="storytext">{s.p(55, 61, 8, 20)}</div></div>
<div class="commentlist comments"><p>{s.b(22, '.')}</p><p>{s.b(50, '.')}</p></div><div id="footer">{s.b(7)}</div></div></body></html>"""


def recipe(s):
    return f"""<html><body><div class="topbar"><a href=#>{s.b(2)}</a></div><article><h1>{s.c(3, '')}</h1><p>{s.c(24)}</p><ul>{''.join(f'<li>{s.c(3, str())}</li>' for _ in range(6))}</ul><ol>{''.join(f'<li>{s.c(15)}</li>' for _ in range(4))}</ol>
<table><tr><th>{s.c(1, '')}</th><td>{s.c(2, '')}</td></tr></table></article><div class="promo sponsored">{s.b(8, '!')}</div><footer>{s.b(4)}</footer></body></html>"""


def plain(s):
    return f"<HTML><BODY><H1>{s.c(4, '')}</H1>{s.c(40)}<P>{s.c(35)}<P>{s.c(9)}<HR><H2>{s.c(2, '')}</H2><P>{s.c(52)}</BODY></HTML>"


def columns(s):
    return f"""<html><body><div class="navbar navbar-default"><div class="container"><ul>{s.links(5)}</ul></div></div><div class="container"><div class="row"><div class="col-md-8"><h1>{s.c(5, '')}</h1>{s.p(30, 44, 2, 39, 51)}<h3>{s.c(3, '')}</h3>{s.p(28)}</div>
<div class="col-md-4"><h4>{s.b(2)}</h4><ul>{s.links(7)}</ul></div></div></div><div class="container"><hr><p>&copy; {s.b(4)}</p></div></body></html>"""


def broken(s):
    return f"""<html><head><title>t</title><meta name=a><body class="page-with-menu"><nav>{s.links(4, 'span')}</nav><div class=content><h1>{s.c(4, '')}<p>{s.c(26)}<p><b>{s.c(3)}<p>{s.c(40)}<svg><path d=1><p>{s.c(31)}<ul><li>{s.c(4, '')}<li>{s.c(6)}</ul></section></span><p>{s.c(22)}</div><div class=footer>{s.b(5)}"""


def interview(s):
    turns = "".join(f'<div class="t0x{k}"><div class="s1y2">{s.c(2, "")}</div><div class="r3z4">{s.c(n, stop)}</div></div>' for k, (n, stop) in enumerate(((9, "?"), (48, "."), (3, ""), (1, ""), (60, "."), (11, "?"), (2, "."), (35, "."))))
    return f"""<html><body><div class="g5h6"><div class="i7j8"><a href="/">{s.b(1)}</a> <a href="/all">all</a></div></div><div class="k9l0"><h1>{s.c(6, '')}</h1><div class="m1n2">{s.c(3, '')}</div>{turns}<div class="o3p4"><a href="/cited">{s.c(5, '')}</a></div><div class="t9x9"><div class="r3z4">{s.c(44)}</div></div></div>
<div class="q5r6"><div class="s7t8"><a href="/a">{s.b(3)}</a></div><div class="s7t8"><a href="/b">{s.b(4)}</a></div><div class="s7t8">{s.b(2)}</div><div class="s7t8"><a href="/c">{s.b(3)}</a></div></div></body></html>"""


def catalogue(s):
    rows = "".join(f"<li>{s.c(n, '')}</li>" for n in (2, 3, 1, 4, 2, 2))
    return f"""<html><body><div class="u1v2"><ul>{s.links(9)}</ul></div><div class="w3x4"><h1>{s.c(3, '')}</h1><p>{s.c(28)}</p><h2>{s.c(1, '')}</h2><ul>{rows}</ul><h2>{s.c(1, '')}</h2><p>{s.c(1, '')}</p><p><a href=/pdf>{s.c(4, '')}</a></p><p>{s.c(39)}</p></div><div class="y5z6"><p><a href=/a>{s.b(1)}</a></p><p>{s.b(3)}</p></div></body></html>"""


LAYOUTS = [interview, catalogue, blog, opaque, tables, manual, news, diary, recipe, plain, columns, broken]


def sample(layout, seed: int) -> tuple[str, list[str], list[str]]:
    """html, the blocks that are content, and those that are not."""
    s = Sample(seed)
    return layout(s), s.content, s.other
