"""Labelled web pages of many layouts, made from a seed, for fitting and testing the extraction of main text."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from html import escape

_SYLLABLES = {
    "en": "the an re ing tion er on st ed ou th nd ha ly en ble sh in es at".split(),
    "fr": "le la é ai eau oi ment que tion eux re ou en pa elle ç vi un".split(),
    "de": "der ie ung sch en ver ge ein keit lich tz ö ü ä be auf zu ß".split(),
    "es": "el la ción os ar es ado mente ñ que rr ll ie ó ez as del un".split(),
}


class _Page:
    """Writes one page; keeps the texts of main blocks."""

    def __init__(self, chance: random.Random):
        self.chance, self.main = chance, set()
        self.language = chance.choice(list(_SYLLABLES))
        self.broken = chance.random() < 0.3

    def word(self) -> str:
        return "".join(self.chance.choice(_SYLLABLES[self.language]) for _ in range(self.chance.randint(1, 5)))

    def words(self, lo: int, hi: int) -> str:
        return " ".join(self.word() for _ in range(self.chance.randint(lo, hi)))

    def sentences(self, lo: int, hi: int) -> str:
        out = []
        for _ in range(self.chance.randint(lo, hi)):
            s = self.words(3, 18)
            if self.chance.random() < 0.5:
                s = s.replace(" ", ", ", 1)
            out.append(s[:1].upper() + s[1:] + self.chance.choice("...!?"))
        return " ".join(out)

    def title(self) -> str:
        return self.words(2, 10).capitalize()

    def keep(self, text: str) -> str:
        """Main text, escaped."""
        self.main.add(" ".join(text.split()))
        return escape(text, quote=False)

    def any(self, *makers: Callable[[], str]) -> str:
        return self.chance.choice(makers)()

    def maybe(self, share: float, maker: Callable[[], str]) -> str:
        return maker() if self.chance.random() < share else ""

    def names(self, *names: str) -> str:
        """A class or id that tells, or none."""
        name = self.chance.choice(names)
        return self.chance.choice([f' class="{name}"', f' id="{name}"', f' class="{name} {self.word()}"', ""]) if names else ""

    def told(self, *names: str) -> str:
        name = self.chance.choice(names)
        return self.chance.choice([f' class="{name}"', f' id="{name}"', f" class='{name} c{self.chance.randint(1, 99)}'"])

    # boilerplate
    def links(self) -> str:
        items = [f'<a href="/{self.word()}">{self.words(1, 3)}</a>' for _ in range(self.chance.randint(2, 9))]
        form = self.chance.randrange(4)
        if form == 0:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        if form == 1:
            return "<ul>" + "".join(f"<li>{i}" for i in items) + "</ul>"
        if form == 2:
            return " | ".join(items)
        return "".join(f"<div>{i}</div>" for i in items)

    def menu(self) -> str:
        return self.any(lambda: f"<nav{self.names('nav', 'main-menu')}>{self.links()}</nav>", lambda: f"<div{self.told('navbar', 'menu', 'top-nav', 'breadcrumbs')}>{self.links()}</div>", lambda: f'<div role="navigation">{self.links()}</div>')

    def head(self) -> str:
        inside = self.any(lambda: f"<h1>{self.title()}</h1>", lambda: f'<a href="/">{self.title()}</a>', lambda: f"<p>{self.words(2, 6)}</p>", lambda: f"<div>{self.sentences(1, 1)}</div>") + self.maybe(0.6, self.menu)
        return self.any(lambda: f"<header>{inside}</header>", lambda: f"<div{self.told('header', 'masthead', 'site-header', 'topbar')}>{inside}</div>")

    def foot(self) -> str:
        line = self.any(lambda: f"&copy; {self.word()}.example &middot; {self.sentences(1, 2)}", lambda: f"Copyright 20{self.chance.randint(10, 25)} {self.words(1, 3)}. All rights reserved.", lambda: f"{self.sentences(1, 2)}", lambda: self.links())
        if self.chance.random() < 0.5:
            line = f"<p>{line}</p>"
        line += self.maybe(0.5, lambda: self.links()) + self.maybe(0.3, lambda: f"<p>{self.sentences(1, 3)}</p>")
        return self.any(lambda: f"<footer>{line}</footer>", lambda: f"<footer{self.names('footer', 'site-footer')}>{line}</footer>", lambda: f"<div{self.told('footer', 'site-footer', 'colophon', 'legal')}>{line}</div>")

    def side(self) -> str:
        part = self.any(lambda: f"<h3>{self.title()}</h3>{self.links()}", lambda: f"<p>{self.sentences(1, 4)}</p>", lambda: f"<h2>{self.title()}</h2><p>{self.sentences(1, 3)}</p>{self.links()}", lambda: f"{self.sentences(1, 2)}")
        return self.any(lambda: f"<aside{self.names('sidebar', 'related')}>{part}</aside>", lambda: f"<div{self.told('sidebar', 'widget', 'related-posts', 'right-side', 'recommended')}>{part}</div>")

    def advert(self) -> str:
        part = self.any(lambda: self.sentences(1, 3), lambda: f"<p>{self.sentences(1, 3)}</p>", lambda: f'<a href="/x">{self.sentences(1, 2)}</a>', lambda: f"<span>{self.words(1, 2)}</span><p>{self.sentences(1, 2)}</p>")
        return f"<div{self.told('ad', 'ads', 'advert', 'ad-slot', 'sponsored', 'promo', 'banner-ad', 'advertisement')}>{part}</div>"

    def notice(self) -> str:
        part = self.any(lambda: f"<p>{self.sentences(1, 3)}</p>", lambda: self.sentences(1, 3)) + self.maybe(0.7, lambda: f"<button>{self.words(1, 2)}</button>")
        return f"<div{self.told('cookie-banner', 'cookie-notice', 'consent', 'gdpr', 'alert', 'notice', 'modal', 'popup')}{self.chance.choice(['', ' role=dialog'])}>{part}</div>"

    def form(self) -> str:
        part = f"<label>{self.words(1, 4)}</label><input type=text name=q>" + self.maybe(0.5, lambda: f"<p>{self.sentences(1, 2)}</p>") + self.maybe(0.5, lambda: f"<select><option>{self.word()}<option>{self.word()}</select>") + self.maybe(0.3, lambda: f"<textarea>{self.words(2, 6)}</textarea>") + f"<button>{self.words(1, 2)}</button>"
        form = f"<form action=/{self.word()}>{part}</form>"
        return self.any(lambda: form, lambda: f"<div{self.told('newsletter', 'search-box', 'login-form', 'subscribe')}><h3>{self.title()}</h3>{form}</div>")

    def comments(self) -> str:
        one = lambda: self.any(lambda: f"<div{self.told('comment', 'comment-body')}><b>{self.word()}</b><p>{self.sentences(1, 4)}</p></div>", lambda: f"<li><p>{self.sentences(1, 4)}</p></li>", lambda: f"<article class=comment><p>{self.sentences(1, 4)}</p></article>")
        part = self.maybe(0.7, lambda: f"<h3>{self.chance.randint(1, 99)} {self.words(1, 2)}</h3>") + "".join(one() for _ in range(self.chance.randint(1, 6))) + self.maybe(0.4, self.form)
        return self.any(lambda: f"<section{self.told('comments', 'comment-list', 'responses')}>{part}</section>", lambda: f"<div{self.told('comments', 'disqus_thread', 'comments-area', 'replies', 'kommentare', 'commentaires')}>{part}</div>", lambda: f"<ol{self.told('commentlist', 'comments')}>{part}</ol>")

    def share(self) -> str:
        return f"<div{self.told('share', 'social', 'sharing-buttons')}>{self.links()}</div>"

    # main text
    def paragraph(self) -> str:
        form = self.chance.random()
        if form < 0.15:
            text = self.words(2, 12)
        else:
            text = self.sentences(1, self.chance.choice([1, 2, 4, 8]))
        form = self.chance.random()
        if self.broken and form < 0.25:
            return f"<p><b>{self.keep(text)}<br>"
        if form < 0.4 or " " not in text:
            return f"<p>{self.keep(text)}" + self.chance.choice(["</p>", "</p>", "</p>", "\n" if self.broken else "</p>"])
        body = self.keep(text)
        first, _, rest = body.partition(" ")
        mark = self.chance.choice(["b", "i", "em", "strong", "span", 'a href="/x"', "u"])
        return f"<p>{first} <{mark}>{rest}</{mark.split()[0]}></p>" if form < 0.55 and mark[0] != "a" or form < 0.48 else f"<p>{body}</p>"

    def article(self) -> str:
        parts = [self.maybe(0.85, lambda: self.any(lambda: f"<h1>{self.keep(self.title())}</h1>", lambda: f"<h2>{self.keep(self.title())}</h2>", lambda: f"<header><h1>{self.keep(self.title())}</h1></header>"))]
        for _ in range(self.chance.choice([0, 1, 2, 3, 5, 8, 14, 25])):
            form = self.chance.random()
            if form < 0.78:
                parts.append(self.paragraph())
            elif form < 0.84:
                parts.append(f"<h2>{self.keep(self.title())}</h2>{self.paragraph()}")
            elif form < 0.88:
                kind = self.chance.choice(["ul", "ol"])
                parts.append(f"<{kind}>" + "".join(f"<li>{self.keep(self.words(2, 14))}</li>" for _ in range(self.chance.randint(1, 6))) + f"</{kind}>")
            elif form < 0.91:
                parts.append(f"<blockquote>{self.keep(self.sentences(1, 3))}</blockquote>")
            elif form < 0.93:
                parts.append(f"<pre>{self.keep(self.words(3, 20))}</pre>")
            elif form < 0.95:
                parts.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.keep(self.words(1, 3))}</td>" for _ in range(3)) + "</tr>" for _ in range(self.chance.randint(1, 4))) + "</table>")
            elif form < 0.97:
                parts.append(f"<figure><img src=/x.png><figcaption>{self.keep(self.words(3, 10))}</figcaption></figure>")
            else:
                parts.append(self.any(self.advert, self.share, self.side, self.form))
        return "".join(parts)


def _page(chance: random.Random) -> tuple[str, set[str]]:
    p = _Page(chance)
    text = p.article()
    if chance.random() < 0.1:  # nothing but the text
        return f"<html><body>{text}{p.paragraph()}</body></html>" if chance.random() < 0.5 else p.paragraph() + text, p.main
    shape = chance.random()
    if shape < 0.55:
        text = f"<article{p.names('post', 'story')}>{text}</article>"
        if chance.random() < 0.2:
            text = f"<main>{text}</main>"
    elif shape < 0.7:
        text = f"<main{p.names('content')}>{text}</main>"
    elif shape < 0.9:
        text = f"<div{p.told('content', 'article-body', 'entry-content', 'post', 'story-text', 'main')}>{text}</div>"
    elif shape < 0.95:
        text = f"<table><tr><td>{p.links()}</td><td>{text}</td></tr></table>"
    before = [p.maybe(0.35, p.notice), p.maybe(0.6, p.head), p.maybe(0.7, p.menu), p.maybe(0.1, lambda: "<!-- x --><noscript>x</noscript>"), p.maybe(0.45, p.advert), p.maybe(0.15, p.side), p.maybe(0.1, p.form)]
    after = [p.maybe(0.25, p.share), p.maybe(0.2, p.advert), p.maybe(0.35, p.comments), p.maybe(0.4, p.side), p.maybe(0.2, p.form), p.maybe(0.85, p.foot), p.maybe(0.1, p.notice)]
    if chance.random() < 0.3:
        chance.shuffle(before)
    body = "".join(before) + text + "".join(after)
    if chance.random() < 0.2:
        body = f"<div{p.names('wrapper', 'page', 'container')}>{body}</div>"
    head = f"<!DOCTYPE html><html lang={p.language}><head><meta charset=utf-8><title>{p.title()}</title><style>p{{margin:0}}</style><script>var t='<p>'</script></head><body>"
    return head + body + ("" if chance.random() < 0.1 else "</body></html>"), p.main


def sample_pages(n: int, seed: int) -> Iterator[tuple[str, set[str]]]:
    """(page, texts of its main blocks)."""
    chance = random.Random(seed)
    for _ in range(n):
        yield _page(chance)
