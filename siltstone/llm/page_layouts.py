"""Layouts whose main text is known, drawn around given sentences: what the trees of main texts learn from.

A layout is a page of parts (menu, header, notices, article, comments, forms and so on), each in one of the forms that sites use:
named by its element, by class or id tokens, or by nothing at all.
"""

from __future__ import annotations

import random
from collections.abc import Iterable
from html import escape

# Tokens of class, id and role attributes, by what they name.
FAMILIES: dict[str, list[str]] = {
    "menu": "nav navbar navigation menu menubar topnav breadcrumb crumb pagination pager tab toc sitemap skip dropdown hamburger".split(),
    "header": "header masthead banner logo branding topbar toolbar brand hero".split(),
    "footer": "footer foot copyright colophon legal bottom imprint credit disclaimer".split(),
    "side": "sidebar side aside widget rail secondary complementary column right left".split(),
    "advert": "ad advert advertisement advertising ads sponsor sponsored promo promotion banner300 adsense doubleclick outbrain taboola affiliate adslot adbox dfp".split(),
    "notice": "cookie consent gdpr notice alert popup modal overlay banner2 message warning paywall subscribe newsletter signup signin login toast snackbar lightbox privacy".split(),
    "related": "related recommended recommendation more trending popular latest teaser readmore also similar suggested headline next previous prev".split(),
    "share": "share sharing social facebook twitter follow like bookmark print".split(),
    "comment": "comment comments commentlist reply replies respond discussion discuss disqus feedback reviews review guestbook forum talkback reader".split(),
    "form": "form search searchbox input contact field checkout register survey poll".split(),
    "meta": "byline author meta tag category date published dateline timestamp caption credit2".split(),
    "article": "article content post entry story main body text articlebody blogpost news page detail single prose richtext copy".split(),
    "wrapper": "wrapper container wrap row col grid layout inner outer site app root box block section panel".split(),
}
_WORDS = "the of and to in is that it was for on are as with his they at be this from have or by one had not but what all were when we there can".split()
_LABELS = "Home News About Contact Products Services Blog Help Login Search Archive Sport Culture Science Travel Health Weather Jobs Shop Press Careers Terms Privacy Sitemap RSS".split()


def material(outlines: Iterable) -> tuple[list[str], list[str]]:
    """Longer and shorter texts of pages, to fill layouts with."""
    long, short = [], []
    for o in outlines:
        for text in o.text:
            (long if len(text) >= 60 else short).append(text)
    return [t for t in long if t], [t for t in short if t]


class _Pen:
    def __init__(self, rng: random.Random, long: list[str], short: list[str], mark: str):
        self.rng, self.long, self.short, self.mark = rng, long, short, mark
        self.named = rng.choice(["element", "class", "both", "id", "none", "both"])  # how this site names its parts

    def words(self, low: int, high: int) -> str:
        n = self.rng.randint(low, high)
        if self.long and self.rng.random() < 0.8:
            words = self.rng.choice(self.long).split()
            at = self.rng.randrange(max(1, len(words) - n))
            return escape(" ".join(words[at : at + n]), quote=False)
        return " ".join(self.rng.choices(_WORDS, k=n)).capitalize()

    def sentence(self, low: int = 6, high: int = 22) -> str:
        return self.words(low, high).rstrip(".,;") + self.rng.choice([".", ".", ".", "!", "?"])

    def prose(self, low: int = 1, high: int = 5) -> str:
        text = " ".join(self.sentence() for _ in range(self.rng.randint(low, high)))
        if self.rng.random() < 0.25:  # inline markup
            words = text.split()
            at = self.rng.randrange(len(words))
            words[at] = self.rng.choice(['<a href="/x">{}</a>', "<b>{}</b>", "<em>{}</em>", "<strong>{}</strong>", "<span>{}</span>", "{}<br>"]).format(words[at])
            text = " ".join(words)
        return text

    def label(self) -> str:
        return self.rng.choice(_LABELS) if self.rng.random() < 0.7 or not self.short else escape(self.rng.choice(self.short)[:40])

    def tag(self, element: str, family: str, inside: str, main: bool | None = None) -> str:
        """A part named as this site names its parts."""
        rng = self.rng
        named = self.named if rng.random() < 0.8 else rng.choice(["element", "class", "both"])
        own = element if named in ("element", "both") else rng.choice(["div", "div", "section"]) if element not in ("ul", "ol", "form") else element
        attrs = ""
        if named in ("class", "both", "id") and (element == "div" or named != "both" or rng.random() < 0.5):
            token = rng.choice(FAMILIES[family])
            if rng.random() < 0.4:
                token += rng.choice(["-", "_"]) + rng.choice(FAMILIES["wrapper"])
            elif rng.random() < 0.2:
                token = rng.choice("abcxyz") + "-" + token
            attrs = f' id="{token}"' if named == "id" and rng.random() < 0.7 else f' class="{token}"'
        if main is not None:
            attrs += f' {self.mark}="{int(main)}"'
        return f"<{own}{attrs}>{inside}</{own}>"

    def wrapped(self, inside: str) -> str:
        for _ in range(self.rng.choice([0, 0, 1, 2])):
            token = f' class="{self.rng.choice(FAMILIES["wrapper"])}"' if self.rng.random() < 0.6 else ""
            inside = f"<div{token}>{inside}</div>"
        return inside

    def links(self, low: int, high: int, wide: bool = False) -> str:
        if self.rng.random() < 0.08:
            return " ".join(self.label() for _ in range(self.rng.randint(low, high)))
        items = [f'<a href="/{k}">{self.words(3, 9) if wide else self.label()}</a>' for k in range(self.rng.randint(low, high))]
        kind = self.rng.randrange(3)
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if kind < 2 else self.rng.choice([" | ", " ", " · "]).join(items)

    # parts that are not main text
    def menu(self) -> str:
        return self.tag("nav", "menu", self.links(3, 12))

    def header(self) -> str:
        inside = self.rng.choice([f'<a href="/">{self.label()}</a>', f"<h1>{self.label()} {self.label()}</h1>", f"<p>{self.words(2, 6)}</p>", f"{self.words(2, 7)}"])
        return self.tag("header", "header", inside + (self.menu() if self.rng.random() < 0.4 else "") + (f"<p>{self.sentence()}</p>" if self.rng.random() < 0.2 else ""))

    def footer(self) -> str:
        inside = self.rng.choice([f"&copy; {self.label()} &middot; {self.sentence()}", f"<p>&copy; 2020 {self.words(2, 8)}</p>", self.links(2, 8), f"<p>{self.prose(1, 2)}</p>{self.links(2, 6)}", self.sentence(2, 8), "All rights reserved", f"<p>{self.words(2, 8)}</p>", f"Copyright 2019 {self.sentence()} All rights reserved."])
        return self.tag("footer", "footer", inside)

    def side(self) -> str:
        if self.rng.random() < 0.25:
            return self.tag("aside", "side", self.sentence(2, 12))
        inside = f"<h3>{self.label()}</h3>" * (self.rng.random() < 0.6) + self.rng.choice([self.links(3, 10, True), f"<p>{self.prose(1, 2)}</p>", f"<p>{self.sentence()}</p>" + self.links(2, 6)])
        return self.tag("aside", "side", inside)

    def advert(self) -> str:
        return self.tag("div", "advert", self.rng.choice([self.sentence(2, 10), f"<p>{self.prose(1, 2)}</p>", f"<p>{self.sentence(1, 6)}</p>", f'<a href="/buy">{self.words(3, 10)}</a>', f"<h4>{self.label()}</h4><p>{self.sentence()}</p>"]))

    def notice(self) -> str:
        return self.tag("div", "notice", self.rng.choice([f"<p>We use cookies. {self.sentence()}</p><button>OK</button>", f"{self.sentence()} <a href='/more'>More</a>", f"<p>{self.prose(1, 2)}</p><button>Accept</button>", f"<p>{self.sentence()}</p>"]))

    def related(self) -> str:
        return self.tag("section", "related", f"<h3>{self.label()}</h3>" + self.links(3, 9, True))

    def share(self) -> str:
        return self.tag("div", "share", " ".join(f'<a href="/s">{x}</a>' for x in self.rng.sample(["Share", "Tweet", "Mail", "Print", "Like", "Pin"], 3)))

    def comments(self) -> str:
        rng = self.rng
        shape = rng.randrange(4)

        def one() -> str:
            who, what = self.label(), self.prose(1, 3)
            return [f"<p>{what}</p>", f"<div><b>{who}</b><p>{what}</p></div>", f"<li><span>{who}</span> {what}</li>", f"<div class='{rng.choice(FAMILIES['comment'])}'><p>{who} 3 days ago</p><p>{what}</p><a href='#'>Reply</a></div>"][shape]

        inside = "".join(one() for _ in range(rng.randint(1, 8)))
        inside = f"<ol>{inside}</ol>" if shape == 2 else inside
        return self.tag("section", "comment", f"<h3>{rng.choice(['Comments', 'Responses', self.label()])}</h3>" * (rng.random() < 0.7) + inside)

    def form(self) -> str:
        inside = "".join(f"<label>{self.label()}</label><input>" for _ in range(self.rng.randint(1, 4))) + "<button>Send</button>"
        return self.tag("form", "form", (f"<p>{self.sentence()}</p>" if self.rng.random() < 0.5 else "") + inside)

    # the article
    def article(self) -> str:
        rng = self.rng
        unclosed = rng.random() < 0.15
        p = lambda text: f"<p>{text}" + "</p>" * (not unclosed)
        size = rng.choice([0, 1, 2, 4, 8, 16, 30])
        brief = rng.choice([0.08, 0.08, 0.3, 0.9])  # paragraphs of a few words, of hundred
        parts = []
        for k in range(max(1, size)):
            kind = rng.random()
            if kind < 0.74 or k == 0:
                parts.append(p(self.prose(1, 6)) if rng.random() > brief else p(self.words(1, 5) + rng.choice(["", ".", "."])))
            elif kind < 0.82:
                parts.append(f"<h{rng.randint(2, 4)}>{self.words(1, 7)}</h2>")
            elif kind < 0.89:
                parts.append("<ul>" + "".join(f"<li>{self.words(2, 14)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
            elif kind < 0.93:
                parts.append(f"<blockquote>{p(self.prose(1, 2))}</blockquote>")
            elif kind < 0.96:
                parts.append(f"<figure><img src=a><figcaption>{self.words(3, 10)}</figcaption></figure>")
            else:
                parts.append("<table>" + "".join(f"<tr><td>{self.label()}</td><td>{self.words(1, 4)}</td></tr>" for _ in range(rng.randint(2, 5))) + "</table>")
        # inside the article, but not of it, more than one at times; in a site that names nothing it could not be told
        for _ in range(rng.choice([0, 1, 1, 2, 3]) if self.named != "none" else 0):
            not_it = rng.choice([self.advert, self.advert, self.share, self.related, self.side, self.side, self.notice, self.form])()
            parts.insert(rng.randint(1, len(parts)), f'<div {self.mark}="0">{not_it}</div>' if rng.random() < 0.3 else not_it.replace(">", f' {self.mark}="0">', 1))
        if rng.random() < 0.12 and self.named != "none":
            parts.append(self.comments().replace(">", f' {self.mark}="0">', 1))
        if size > 1 and rng.random() < 0.25:  # in sections with headings of their own
            wide, tag = rng.randint(1, 4), rng.choice(["section", "section", "div", 'div class="section"'])
            parts = [f"<{tag}>" + (f"<h2>{self.words(1, 6)}</h2>" if rng.random() < 0.8 else "") + "".join(parts[k : k + wide]) + f"</{tag.split()[0]}>" for k in range(0, len(parts), wide)]
        heading = f"<h1>{self.words(1, 12)}</h1>" if rng.random() < 0.7 else f"<h2>{self.words(1, 12)}</h2>" if rng.random() < 0.7 else ""
        if heading and rng.random() < 0.2:
            heading = f"<header>{heading}</header>"
        if rng.random() < 0.15:
            heading += f'<p class="{rng.choice(FAMILIES["meta"])}">{self.words(2, 6)}</p>'
        if rng.random() < 0.1:  # next to nothing, and still the article
            parts = [p(self.words(1, 4) + rng.choice(["", "."])) for _ in range(rng.choice([1, 1, 2, 3]))]
        elif size == 0:  # bare text in the element itself
            parts = [self.prose(1, 8), *[p(self.words(1, 9)) for _ in range(rng.choice([0, 0, 1, 2]))]]
        elif rng.random() < 0.1:
            parts = [x.replace("<p>", "<div>").replace("</p>", "</div>") if not unclosed else x for x in parts]
        return self.tag(rng.choice(["article", "article", "main"]), "article", heading + "".join(parts), True)


def drawn(rng: random.Random, long: list[str], short: list[str], mark: str) -> str:
    """One page; the attribute ``mark`` says of each part whether it is main text (1) or not (0)."""
    pen = _Pen(rng, long, short, mark)
    if rng.random() < 0.06:  # a fragment: nothing but main text
        return rng.choice([pen.article(), f'<body {mark}="1"><p>{pen.prose()}</p></body>', f'<div {mark}="1">{pen.prose()}</div>', f'<p {mark}="1">{pen.prose(1, 2)}', f'<body {mark}="1"><h1>{pen.words(1, 5)}</h1><p>{pen.prose()}<p>{pen.prose()}'])
    some = lambda part, chance: part() if rng.random() < chance else ""
    before = [some(pen.notice, 0.25), some(pen.header, 0.5), some(pen.menu, 0.7), some(pen.advert, 0.35), some(pen.form, 0.1)]
    after = [some(pen.share, 0.2), some(pen.related, 0.25), some(pen.comments, 0.45), some(pen.form, 0.2), some(pen.advert, 0.2), some(pen.side, 0.35)]
    if rng.random() < 0.3:
        rng.shuffle(before)
    if rng.random() < 0.5:
        rng.shuffle(after)
    if rng.random() < 0.2:
        before.append(pen.side())
    middle = pen.wrapped(pen.article() + "".join(after[:3]))
    if rng.random() < 0.08:  # laid out as a table
        cells = [f"<td>{x}</td>" for x in (pen.links(2, 8), middle, some(pen.side, 0.3)) if x]
        middle = f"<table><tr>{''.join(cells if rng.random() < 0.7 else cells[::-1])}</tr></table>"
        if rng.random() < 0.5:
            return f"<html><body>{middle}</body></html>"
    body = pen.wrapped("".join(before) + middle + "".join(after[3:])) + some(pen.footer, 0.75) + some(pen.notice, 0.1)
    return f"<!DOCTYPE html><html><head><title>{pen.label()}</title><style>p{{}}</style><script>x()</script></head><body>{body}</body></html>"
