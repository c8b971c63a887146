"""Labelled pages for training: made from a seed, with invented words, in many layouts. A block is main text if it carries the main mark."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

_MARK = "\x02"  # stands in every text of the main part, and nowhere else
_SYLLABLES = "ka lo mi ter san ve ru del pon gra it os une ber lin ach sol mar te".split()


class _Page:
    def __init__(self, r: random.Random):
        self.r = r

    def words(self, low: int, high: int, main: bool = False, stop: bool = True) -> str:
        r = self.r
        w = ["".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) + ("," if r.random() < 0.08 else "") for _ in range(r.randint(low, high))]
        text = " ".join(w).strip(",")
        if main:
            text = _MARK + text
        return text.capitalize() + ("." if stop and r.random() < 0.95 else "")

    def name(self, *names: str) -> str:
        r = self.r
        x = r.choice(names)
        if r.random() < 0.3:
            x += r.choice(["-box", " wide", "_1", "-wrapper", " js-hook", "-inner"])
        return f' {r.choice(["class", "class", "id"])}="{x}"' if r.random() < 0.9 else ""

    def links(self, n: int) -> str:
        items = [f'<a href="/{i}">{self.words(1, 3, stop=self.r.random() < 0.3)}</a>' for i in range(n)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self.r.random() < 0.7 else self.r.choice([" | ", " ", "<br>"]).join(items)

    def nav(self) -> str:
        r = self.r
        return r.choice([f"<nav{self.name('nav', 'menu', 'main-nav', 'navbar')}>{self.links(r.randint(2, 8))}</nav>", f"<div class=\"{r.choice(['menu', 'nav', 'navigation', 'breadcrumb', 'breadcrumbs', 'topbar', 'pagination'])}\">{self.links(r.randint(2, 8))}</div>"])

    def header(self) -> str:
        r = self.r
        inside = r.choice([self.words(1, 5, stop=False), f"<h1>{self.words(1, 4, stop=False)}</h1><p>{self.words(2, 8)}</p>", self.links(3), f"<p>{self.words(2, 12)}</p>"])
        return r.choice([f"<header{self.name('header', 'site-header', 'masthead')}>{inside}</header>", f"<div class=\"{r.choice(['header', 'site-header', 'masthead', 'banner', 'logo'])}\">{inside}</div>"])

    def footer(self) -> str:
        r = self.r
        inside = r.choice(["&copy; {} &middot; {}", "<p>Copyright {}. {}</p>", "<p>{}</p><p>{}</p>", "{} <br> {}"]).format(self.words(1, 3, stop=False), self.words(2, 12))
        return r.choice([f"<footer{self.name('footer', 'site-footer')}>{inside}</footer>", f"<div class=\"{r.choice(['footer', 'site-footer', 'copyright', 'legal', 'colophon'])}\">{inside}</div>"])

    def aside(self) -> str:
        r = self.r
        inside = f"<h3>{self.words(1, 4, stop=False)}</h3>" + r.choice([self.links(4), f"<p>{self.words(5, 30)}</p>"])
        return r.choice([f"<aside{self.name('aside', 'sidebar', 'related')}>{inside}</aside>", f"<div class=\"{r.choice(['sidebar', 'related', 'widget', 'recommended', 'popular', 'trending', 'share', 'social', 'author-bio', 'tags'])}\">{inside}</div>"])

    def advert(self) -> str:
        r = self.r
        kind = r.choice("ad ads advert advertisement sponsored sponsor promo promotion banner adsbox".split())
        return f"<!-- ad --><{(t := r.choice(['div', 'div', 'section', 'p']))} class=\"{kind}\">{self.words(3, 25)}</{t}>"

    def notice(self) -> str:
        r = self.r
        kind = r.choice("cookie cookies cookie-banner consent gdpr notice notification alert popup modal overlay subscribe newsletter paywall privacy".split())
        inside = r.choice(["{}", "<p>{}</p>", "<p>{}</p><button>OK</button>"]).format(self.words(4, 25))
        return f"<{(t := r.choice(['div', 'section', 'aside', 'dialog']))} {r.choice(['class', 'id'])}=\"{kind}\">{inside}</{t}>"

    def form(self) -> str:
        return f"<form action='/x'{self.name('form', 'search', 'login', 'signup')}><label>{self.words(1, 4, stop=False)}</label><input name=q><p>{self.words(2, 12)}</p><button>{self.words(1, 2, stop=False)}</button></form>"

    def comments(self) -> str:
        r = self.r
        kind = r.choice("comments comment-list comments-area replies discussion disqus responses".split())
        one = r.choice(["<li class=\"comment\"><b>{}</b><p>{}</p></li>", "<div class=\"comment\"><p class=\"author\">{}</p><p>{}</p></div>", "<article class=\"comment\"><h4>{}</h4><p>{}</p></article>", "<p>{}: {}</p>"])
        inside = "".join(one.format(self.words(1, 2, stop=False), self.words(4, 50)) for _ in range(r.randint(1, 5)))
        return f"<{(t := r.choice(['section', 'div', 'ol', 'aside']))} {r.choice(['class', 'id'])}=\"{kind}\">{r.choice(['', '<h2>' + self.words(1, 3, stop=False) + '</h2>'])}{inside}</{t}>"

    def main(self) -> str:
        r = self.r
        body = []
        if r.random() < 0.85:
            body.append(f"<h1>{self.words(2, 12, True, stop=r.random() < 0.5)}</h1>")
        for _ in range(r.randint(1, 14)):
            x = r.random()
            if x < 0.72:
                text = self.words(1, 90, True)
                if r.random() < 0.25:
                    text = f"{'<b>' if r.random() < 0.5 else '<em>'}{text}" + (f"</b> <a href='/y'>{self.words(1, 3, True)}</a>" if r.random() < 0.5 else "<br>")
                body.append(f"<p>{text}" + ("</p>" if r.random() < 0.85 else ""))
            elif x < 0.80:
                body.append(f"<h{(k := r.randint(2, 4))}>{self.words(1, 8, True, stop=False)}</h{k}>")
            elif x < 0.86:
                body.append("<ul>" + "".join(f"<li>{self.words(1, 15, True)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif x < 0.90:
                body.append(f"<blockquote>{self.words(5, 40, True)}</blockquote>")
            elif x < 0.93:
                body.append(f"<figure><img src=x><figcaption>{self.words(2, 12, True)}</figcaption></figure>")
            elif x < 0.96:
                body.append("<table><tr>" + "".join(f"<td>{self.words(1, 4, True, stop=False)}</td>" for _ in range(3)) + "</tr></table>")
            else:
                body.append(f"<pre>{self.words(3, 20, True)}</pre>")
            if r.random() < 0.06:
                body.append(r.choice([self.advert, self.aside, self.form, self.notice])())
        inside = "".join(body)
        return r.choice(
            [
                f"<article>{inside}</article>", f"<article{self.name('post', 'entry', 'story', 'article')}>{inside}</article>", f"<main><article>{inside}</article></main>",
                f"<main{self.name('main', 'content')}>{inside}</main>", f"<div class=\"{r.choice(['content', 'post', 'entry-content', 'article-body', 'story', 'main', 'post-body', 'text'])}\">{inside}</div>", f"<div>{inside}</div>",
                f"<section{self.name('content', 'article')}>{inside}</section>",
            ]
        )

    def page(self) -> str:
        r = self.r
        before = [f() for f in r.sample([self.nav, self.header, self.advert, self.notice, self.aside, self.form], r.randint(1, 4))]
        after = [f() for f in r.sample([self.comments, self.aside, self.advert, self.form, self.nav, self.notice], r.randint(0, 3))]
        body = "".join(before) + self.main() + "".join(after) + (self.footer() if r.random() < 0.9 else "")
        wrap = r.choice(["{}", "{}", "<div id=page>{}</div>", "<div class='container'>{}</div>"])
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";</script></head><body>{wrap.format(body)}</body></html>"


def pages(n: int, seed: int) -> Iterator[str]:
    """``n`` pages; texts of their main parts begin with the mark."""
    r = random.Random(seed)
    for _ in range(n):
        yield _Page(r).page()


def labelled(page: str, blocks: Callable) -> tuple[list, list[int]]:
    """Blocks of a page without the mark, and 1 for each that carried it."""
    found = list(blocks(page))
    return [(t.replace(_MARK, ""), element, own) for t, element, own in found], [int(_MARK in t) for t, _, _ in found]
