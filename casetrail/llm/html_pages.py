"""Labelled pages to train the extractor: common layouts filled with made-up words.

``data-y="1"`` marks the root of an article, ``data-y="0"`` what is not part of it though it lies inside. The labels
are read before the features and are no features themselves.
"""

from __future__ import annotations

import random


class _Writer:
    def __init__(self, seed: int):
        self.rnd = random.Random(seed)
        syllables = ["ka", "lo", "mi", "ter", "an", "sol", "ve", "und", "ri", "es", "ta", "por", "que", "ing", "ou", "le"]
        self.vocabulary = ["".join(self.rnd.choice(syllables) for _ in range(self.rnd.randint(1, 4))) for _ in range(300)]

    def words(self, low: int, high: int) -> str:
        return " ".join(self.rnd.choice(self.vocabulary) for _ in range(self.rnd.randint(low, high)))

    def sentence(self, low: int = 3, high: int = 18) -> str:
        return self.words(low, high).capitalize() + self.rnd.choice([".", ".", ".", "?", "!", ""])

    def text(self, low: int = 1, high: int = 8) -> str:
        """A paragraph; some are a word or two, some long."""
        if self.rnd.random() < 0.15:
            return self.sentence(1, 3)
        return " ".join(self.sentence() for _ in range(self.rnd.randint(low, high)))

    def links(self, low: int = 2, high: int = 9) -> str:
        return "".join(f'<li><a href="/{self.words(1, 1)}">{self.words(1, 3)}</a></li>' for _ in range(self.rnd.randint(low, high)))

    def pick(self, *choices: str) -> str:
        return self.rnd.choice(choices)

    def menu(self) -> str:
        items = f"<ul>{self.links()}</ul>" if self.rnd.random() < 0.8 else " | ".join(f'<a href="#">{self.words(1, 2)}</a>' for _ in range(5))
        return self.pick(f"<nav>{items}</nav>", f'<div class="menu">{items}</div>', f'<div id="nav-main">{items}</div>', f'<ul class="breadcrumb">{self.links(1, 4)}</ul>',
                         f'<div role="navigation">{items}</div>')

    def banner(self) -> str:
        inner = f"<a href='/'>{self.words(1, 3)}</a>" + self.pick("", f"<p>{self.sentence()}</p>", self.menu(), f"<h1>{self.words(1, 3)}</h1>")
        return self.pick(f"<header>{inner}</header>", f'<div id="header">{inner}</div>', f'<div class="site-header">{inner}</div>', f'<div role="banner">{inner}</div>')

    def advert(self) -> str:
        name = self.pick("ad", "ads", "advert", "banner-ad", "sponsored", "promo", "advertisement")
        inner = self.pick(self.text(1, 3), f"<p>{self.text(1, 3)}</p>", f'<a href="/x">{self.sentence()}</a>')
        return self.pick(f'<div class="{name}">{inner}</div>', f'<aside class="{name}">{inner}</aside>', f'<div id="{name}">{inner}</div>', f'<ins class="{name}">{inner}</ins>')

    def notice(self) -> str:
        name = self.pick("cookie-notice", "notice", "consent", "popup", "alert", "gdpr-banner", "paywall", "modal")
        inner = f"<p>{self.text(1, 3)}</p>" + self.pick("", "<button>OK</button>", f"<a href='#'>{self.words(1, 2)}</a>")
        return self.pick(f'<div class="{name}">{inner}</div>', f'<div id="{name}">{inner}</div>', f'<section class="{name}">{inner}</section>', f'<div role="dialog">{inner}</div>')

    def form(self) -> str:
        inner = f"<label>{self.words(1, 3)}</label><input name=q><p>{self.sentence()}</p><button>{self.words(1, 2)}</button>"
        return self.pick(f"<form action='/s'>{inner}</form>", f'<div class="newsletter"><form>{inner}</form></div>', f'<form class="search">{inner}</form>', f'<div class="subscribe">{inner}</div>')

    def sidebar(self) -> str:
        inner = f"<h3>{self.words(1, 3)}</h3>" + self.pick(f"<ul>{self.links()}</ul>", f"<p>{self.text(1, 3)}</p>", f"<p>{self.text(1, 3)}</p><ul>{self.links()}</ul>")
        return self.pick(f"<aside>{inner}</aside>", f'<div class="sidebar">{inner}</div>', f'<div id="sidebar">{inner}</div>', f'<div class="widget">{inner}</div>', f'<div class="related">{inner}</div>',
                         f'<section class="related-posts">{inner}</section>')

    def comments(self) -> str:
        one = lambda: f"<li><b>{self.words(1, 2)}</b><p>{self.text(1, 4)}</p></li>"
        plain = lambda: f'<div class="comment"><span>{self.words(1, 2)}</span><p>{self.text(1, 4)}</p></div>'
        n = self.rnd.randint(1, 4)
        items, divs = "".join(one() for _ in range(n)), "".join(plain() for _ in range(n))
        return self.pick(f'<section class="comments"><h2>{self.words(1, 2)}</h2>{divs}</section>', f'<div id="comments">{divs}</div>', f'<ol class="commentlist">{items}</ol>',
                         f'<div class="reader-comments"><ul>{items}</ul></div>', f'<section id="responses"><h3>{self.words(1, 2)}</h3><ul>{items}</ul></section>')

    def social(self) -> str:
        return self.pick(f'<div class="share"><ul>{self.links(2, 4)}</ul></div>', f'<div class="social-links">{self.words(1, 3)}</div>', f'<ul class="tags">{self.links(2, 4)}</ul>',
                         f'<div class="byline-meta pagination"><a href="?2">{self.words(1, 2)}</a></div>')

    def footer(self) -> str:
        inner = f"&copy; {self.words(1, 2)} " + self.pick(self.text(1, 3), f"<p>{self.text(1, 3)}</p>", f"<ul>{self.links()}</ul>")
        return self.pick(f"<footer>{inner}</footer>", f'<div id="footer">{inner}</div>', f'<div class="footer copyright">{inner}</div>', f'<div role="contentinfo">{inner}</div>')

    def off(self, html: str) -> str:
        """A part inside the article that is none of it."""
        end = html.index(">") if "<" in html else 0
        space = min(k for k in (html.find(" "), end) if k > 0)
        return html[:space] + ' data-y="0"' + html[space:]

    def body_of_article(self) -> str:
        parts = [f"<p>{self.text()}</p>" for _ in range(self.rnd.randint(1, 9))]
        extra = [lambda: f"<h2>{self.words(2, 6)}</h2>", lambda: f"<ul><li>{self.sentence()}</li><li>{self.text(1, 2)}</li></ul>", lambda: f"<blockquote>{self.text(1, 3)}</blockquote>",
                 lambda: f"<table><tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr></table>", lambda: f"<figure><img src=x><figcaption>{self.sentence()}</figcaption></figure>",
                 lambda: f"<p><a href='/y'>{self.sentence()}</a></p>", lambda: f"<div>{self.text()}</div>", lambda: f"<pre>{self.words(3, 12)}</pre>", lambda: f"<p><b>{self.text(1, 2)}<br>"]
        inside = [self.advert, self.social, self.form, self.sidebar, self.notice, self.comments]
        for _ in range(self.rnd.randint(0, 3)):
            parts.insert(self.rnd.randint(0, len(parts)), self.rnd.choice(extra)())
        if self.rnd.random() < 0.4:
            parts.insert(self.rnd.randint(0, len(parts)), self.off(self.rnd.choice(inside)()))
        return "".join(parts)

    def page(self) -> str:
        heading = self.pick(f"<h1>{self.sentence()}</h1>", f"<header><h1>{self.sentence()}</h1></header>", f"<h1>{self.sentence()}</h1>", "")
        inner = heading + self.body_of_article()
        article = self.pick(f'<article data-y="1">{inner}</article>', f'<main data-y="1">{inner}</main>', f'<main><article data-y="1">{inner}</article></main>', f'<article data-y="1">{inner}</article>',
                            f'<div class="content" data-y="1">{inner}</div>', f'<div id="main-content"><div class="post" data-y="1">{inner}</div></div>', f'<div class="entry-content" data-y="1">{inner}</div>',
                            f'<section class="story" data-y="1">{inner}</section>', f'<div role="main" data-y="1">{inner}</div>', f'<div class="wrap"><div class="article-body" data-y="1">{inner}</div></div>',
                            f'<div data-y="1">{inner}</div>')
        before = [self.banner, self.menu, self.notice, self.advert, self.social, self.form]
        after = [self.sidebar, self.comments, self.advert, self.form, self.social, self.notice, self.menu]
        top = "".join(self.rnd.choice(before)() for _ in range(self.rnd.randint(0, 3)))
        low = "".join(self.rnd.choice(after)() for _ in range(self.rnd.randint(0, 3))) + (self.footer() if self.rnd.random() < 0.8 else "")
        whole = top + article + low
        if self.rnd.random() < 0.3:
            whole = self.pick(f'<div id="page">{whole}</div>', f'<div class="wrapper">{whole}</div>', f'<div class="container">{top}<div class="row">{article}</div></div>{low}')
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 6)}</title></head><body>{whole}</body></html>"


def labelled_pages(count: int = 600, seed: int = 11) -> list[str]:
    writer = _Writer(seed)
    return [writer.page() for _ in range(count)]
