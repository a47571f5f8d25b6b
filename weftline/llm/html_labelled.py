"""Labelled pages from which the HTML model is fitted.

``pages`` writes them by rule from the parts below, the same ones each time. ``y="1"`` or ``y="0"`` marks an element and
what it holds as content or not; what stands above content is content too.
"""

from __future__ import annotations

import random

#: Elements around content, and around what is not content, by kind.
CONTENT = ["<article>", '<article class="article post">', '<main id="content">', '<div class="content main">', '<div id="main" class="post entry story">', '<div class="article body text">', '<section class="content">', '<div role="main">', "<main>", '<article class="story">']
MENU = ["<nav>", "<nav>", "<nav>", '<div class="menu">', '<ul class="nav navbar">', '<nav class="navigation top">', '<div id="menu">', '<div role="navigation">', '<nav role="navigation" class="breadcrumb breadcrumbs">', '<div class="pagination pager">', '<div class="toolbar tags">']
HEADER = ["<header>", '<div class="header">', '<div id="header" class="masthead top">', '<header class="site header">', '<div role="banner">']
FOOTER = ["<footer>", '<div class="footer">', '<div id="footer" class="bottom">', '<footer class="site footer">', '<div role="contentinfo">', '<div class="copyright legal">']
ASIDE = ["<aside>", '<aside class="sidebar">', '<div class="sidebar widget">', '<div id="sidebar">', '<div class="related recommended">', '<section class="related">', '<div role="complementary">', '<div class="share social">', '<div class="author bio">']
NOTICE = ['<div class="cookie notice">', '<div class="consent banner">', '<div class="popup modal overlay">', '<div id="cookie" class="alert">', '<div class="paywall">', '<div class="notice">', '<p class="notice">']
ADVERT = ['<div class="ad">', '<div class="ads">', '<div class="advert advertisement">', '<section class="sponsored promo">', '<div id="ad" class="banner">', '<aside class="ad">', '<ins class="ad">', '<p class="ad">']
FORM = ["<form>", "<form>", '<form class="newsletter">', '<div class="subscribe signup">', '<form role="search" class="search">', '<div class="login form">', '<div class="newsletter">']
COMMENTS = ['<section class="comments">', '<div id="comments">', '<div class="comments">', '<ol class="comment list">', '<div class="discussion replies">', '<div class="disqus thread">']
ONE_COMMENT = ['<div class="comment">', '<article class="comment">', '<li class="comment">', '<div class="reply">', "<p>", "<blockquote>"]
SPEAKING = {"nav", "header", "footer", "aside", "form", "article", "main"}
PLAIN = ["<div>", "<section>", '<div class="txt">', "<td>", '<div class="wrap">']
_WORDS = "river rose night morning lower fields under water nobody expected that said the warden gauge had been still for weeks mill bridge frost then came down and of to in it was".split()


def _name(tag: str) -> str:
    return tag[1:-1].split()[0]


def pages(count: int = 240, seed: int = 11) -> list[str]:
    pick = random.Random(seed)

    def text() -> str:
        n = pick.choice([1, 2, 3, 5, 8, 12, 20, 40, 80, 160])
        out = " ".join(pick.choice(_WORDS) for _ in range(n)).capitalize()
        return out + pick.choice([".", ".", ".", "", "!", "?"])

    def links() -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{pick.choice(_WORDS)}</a></li>' for i in range(pick.randint(2, 7))) + "</ul>"

    def inline() -> str:
        return pick.choice(["", "", "", f"<a href='/x'>{text()}</a> ", f"<b>{text()}</b> ", f"<em>{text()}</em> ", f"<b>{text()}<br>", f"<span>{text()}</span> ", f"<i>{text()}</i>"])

    def varied(tag: str) -> str:
        """A tag that says something by itself often has a class that says nothing."""
        if _name(tag) in SPEAKING and pick.random() < 0.5:
            return f'<{_name(tag)} class="{"".join(pick.choices("abcdefghijklmnopqrstuvwxyz", k=4))}">'
        return tag

    def wrapper() -> str:
        return pick.choice(["<div>", '<div class="wrap">', f'<div class="{"".join(pick.choices("abcdefghijklmnopqrstuvwxyz", k=5))}">'])

    def part(kind: list[str], *inside: str) -> str:
        tag = varied(pick.choice(kind))
        return f'{tag[:-1]} y="0">' + "".join(inside) + f"</{_name(tag)}>"

    def plain() -> str:
        return pick.choice([text(), f"<p>{text()}</p>", f"<p>{inline()}{text()}</p><p>{text()}</p>", f"<h3>{text()}</h3>{links()}", f"<p>{text()}</p>{links()}", f"&copy; {text()}", f"<div>{text()}</div>"])

    def advert() -> str:
        return part(ADVERT, text(), pick.choice(["", f"<a href='/y'>{text()}</a>"]))

    def form() -> str:
        return part(FORM, f"<label>{text()}</label><input name=q>", pick.choice(["", f"<p>{text()}</p>"]), "<button>Go</button>")

    def comments() -> str:
        return part(COMMENTS, pick.choice(["", f"<h3>{text()}</h3>"]), *(f"{t}{pick.choice(['', '<p>'])}{inline()}{text()}{pick.choice(['', '', ' <button>Reply</button>'])}</{_name(t)}>" for t in pick.choices(ONE_COMMENT, k=pick.randint(1, 4))))

    def linked() -> str:
        """Content that consists of links: sources, a table of contents, a paragraph that is one link."""
        entry = lambda: pick.choice([f'<a href="/{pick.choice(_WORDS)}">{text()}</a>', f'<a href="/a">{pick.choice(_WORDS)}</a>', f'<a href="#n">{text()}</a> {text()}'])
        items = [entry() for _ in range(pick.randint(1, 7))]
        tag = pick.choice(["ul", "ul", "ol"])
        return pick.choice(["", f"<h2>{text()}</h2>", f"<p>{text()}</p>"]) + pick.choice([f"<{tag}>" + "".join(f"<li>{x}</li>" for x in items) + f"</{tag}>", f"<{tag}>" + "".join(f"<li>{x}" for x in items) + f"</{tag}>", f"<p>{items[0]}</p>", "<p>" + ", ".join(items) + "</p>", f"<table><tr><td>{items[0]}</td><td>{text()}</td></tr></table>"])

    def pressed() -> str:
        return f"<{(tag := pick.choice(['p', 'p', 'li', 'div']))}>{text()} <button>{pick.choice(_WORDS)}</button> {text()}</{tag}>"

    def figure() -> str:
        caption = pick.choice([text(), f"{text()} <a href='/z'>{text()}</a>", f"<a href='/z'>{text()}</a>", f"<em>{text()}</em>"])
        return f"<figure>{pick.choice(['<img src=x>', '<a href=/z><img src=x></a>', f'<pre>{text()}</pre>', f'<blockquote>{text()}</blockquote>'])}<figcaption>{caption}</figcaption></figure>"

    def block() -> str:
        if (kind := pick.random()) < 0.24:
            return linked() if kind < 0.14 else pressed() if kind < 0.19 else figure()
        return pick.choice([*[f"<p>{inline()}{text()}</p>"] * 6, f"<h2>{text()}</h2>", f"<ul><li>{text()}</li><li>{text()}</li></ul>", f"<ol><li>{text()}</li></ol>", f"<blockquote><p>{text()}</p></blockquote>", f"<pre>{text()}</pre>", f"<table><tr><th>{text()}</th><td>{text()}</td></tr></table>", f"<figure><img src=x><figcaption>{text()}</figcaption></figure>", f"<div>{text()}</div>", f"<section><h3>{text()}</h3><p>{text()}</p></section>", f"<p>{text()}", f"<dl><dt>{text()}</dt><dd>{text()}</dd></dl>"])

    out = []
    for _ in range(count):
        tag = varied(pick.choice([*CONTENT, *PLAIN]))
        inner = [f"<h1>{text()}</h1>" if pick.random() < 0.8 else ""]
        for _ in range(pick.randint(1, 9)):
            inner.append(block() if pick.random() < 0.9 else pick.choice([advert, form, lambda: part(ASIDE, plain()), lambda: part(NOTICE, plain()), lambda: part(MENU, links())])())
        if pick.random() < 0.3:  # content inside a wrapper of its own
            inner = [pick.choice([wrapper(), wrapper(), "<section>"]), *inner]
            inner.append(f"</{_name(inner[0])}>")
        content = f'{tag[:-1]} y="1">' + "".join(inner) + f"</{_name(tag)}>" if pick.random() < 0.9 else "".join(block() for _ in range(5))
        if tag == "<td>":
            content = f"<table><tr>{content}</tr></table>"
        before = [part(MENU, links()), part(HEADER, pick.choice([f"<h1>{text()}</h1>", "", links(), f"<p>{text()}</p>"])), part(NOTICE, plain()), advert()]
        after = [part(FOOTER, plain()), part(ASIDE, plain()), comments(), form(), advert(), part(FOOTER, plain())]
        pick.shuffle(before)
        if pick.random() < 0.3:  # columns
            content = f'{wrapper()[:-1]} y="1">{content}{part(ASIDE, plain())}</div>'
        body = "".join(x for x in before if pick.random() < 0.7) + content + "".join(x for x in after if pick.random() < 0.5)
        if pick.random() < 0.5:
            body = f'{pick.choice(['<div class="page wrapper container">', wrapper(), wrapper()])[:-1]} y="1">{body}</div>'
        out.append(f'<html><head><meta charset="utf-8"><title>{text()}</title><style>p{{}}</style><script>x("</p>")</script></head><body>{body}</body></html>')
    return out
