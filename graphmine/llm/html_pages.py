"""Labelled pages, made from a seed, on which the block classifier of html_extract is trained.

A page has an article and some of: a header, menus, a sidebar, notices, adverts, forms, a
footer, share bars, teasers and reader comments. Element kinds, nesting, class names and text vary by
family; `HELD_OUT` families serve the tests alone.
"""

from __future__ import annotations

import html

import numpy as np

FAMILIES = ("semantic", "divs", "plain", "table", "mixed")
HELD_OUT = ("table",)

_WORDS = [a + b for a in ("an", "the", "re", "ti", "st", "ou", "cion", "mente", "que", "ung", "lich", "wh", "eau", "ver", "zu", "la", "do", "ar", "mi", "ko", "sé", "über", "чи", "тре") for b in ("", "n", "ring", "tion", "ble", "s", "keit", "os", "ment", "e", "do", "ly")]
_CONTENT_NAMES = ("", "", "", "c1", "x9z", "wrap", "content", "post", "entry-content", "article-body", "story", "main-text", "overflow-hidden", "text-header-free form-page", "post legal", "footerless", "row", "col-8", "content no-sidebar", "single nav-open", "prose ad-free", "page has-comments", "layout menu-right")
_HEADER = ("header", "masthead", "site-header", "topbar", "header__inner", "brandbar", "page-head")
_MENU = ("nav", "menu", "navbar", "main-nav", "breadcrumbs", "nav__list", "toc-menu", "pager", "pagination", "tabs")
_SIDE = ("sidebar", "widget", "left-sidebar", "rail", "widget widget_recent", "aside", "related", "recommended", "teaser-list", "more-stories", "promo")
_NOTICE = ("cookie", "cookie-banner", "gdpr", "notice", "consent", "alert", "newsletter", "subscribe-box", "paywall", "disclaimer")
_ADS = ("ad", "ads", "advert", "sponsored", "ad-slot", "banner", "advertisement box", "google-ad")
_FOOT = ("footer", "site-footer", "foot", "footer__col", "copyright", "legal", "colophon", "bottom-links")
_COMMENTS = ("comments", "comment-list", "disqus", "replies", "comment", "discussion", "reader-comments", "respond")
_SHARE = ("share", "social", "share-buttons", "social-links", "tags", "post-meta")
_FORMS = ("search", "login-form", "signup", "contact-form", "feedback")


class _Maker:
    def __init__(self, rng: np.random.Generator, family: str):
        self.rng, self.family, self.out = rng, family, []
        self.labels: list[tuple[str, bool]] = []
        self.hints = rng.random() < 0.85  # pages without telling names are told by text and elements

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def pick(self, options):
        return options[int(self.rng.integers(0, len(options)))]

    def words(self, least: int, most: int, end: str = "") -> str:
        text = " ".join(self.pick(_WORDS) for _ in range(int(self.rng.integers(least, most + 1))))
        return text[:1].upper() + text[1:] + end

    def prose(self, sentences: int) -> str:
        parts = []
        for _ in range(sentences):
            s = self.words(5, 18)
            parts.append(s.replace(" ", ", ", 1) + self.pick(".....?!") if self.chance(0.3) else s + self.pick(".....?!"))
        return " ".join(parts)

    def attr(self, names, always: bool = False) -> str:
        if not (self.hints or always) or not names:
            return ""
        name = self.pick(names)
        if self.chance(0.15):
            name += self.pick((" clearfix", " row", "-2", " js-x"))
        return f' {self.pick(("class", "class", "class", "id"))}="{name}"' if name else ""

    def block(self, tag: str, text: str, label: bool, linked: bool = False) -> None:
        text = " ".join(text.split())
        if text:
            inner = html.escape(text)
            self.out.append(f'<{tag}><a href="/{self.pick(_WORDS)}">{inner}</a></{tag}>' if linked else f"<{tag}>{inner}</{tag}>")
            self.labels.append((text, label))

    def region(self, tag: str, names, fill) -> None:
        if self.family in ("divs", "plain", "table") or (self.family == "mixed" and self.chance(0.5)):
            tag = "td" if self.family == "table" and self.chance(0.4) else "div"
        self.out.append(f"<{tag}{self.attr(names) if self.family != 'plain' or self.chance(0.5) else ''}>")
        deep = self.chance(0.3)
        self.out.append("<div>" if deep else "")
        fill()
        self.out.append("</div>" if deep else "")
        self.out.append(f"</{tag}>")

    def links(self) -> None:
        self.out.append("<ul>")
        for _ in range(int(self.rng.integers(2, 9))):
            self.block("li", self.words(1, 3), False, True)
        self.out.append("</ul>")

    def small(self) -> None:
        kind = self.rng.random()
        if kind < 0.35:
            self.links()
        elif kind < 0.7:
            self.block("p", self.words(2, 12, self.pick((".", "", "!"))), False)
        else:
            self.block("h3", self.words(1, 4), False)
            self.block("p", self.prose(int(self.rng.integers(1, 3))), False, self.chance(0.4))

    def foot(self) -> None:
        self.block("p", "© " + self.words(1, 4) + " 20" + str(self.rng.integers(10, 30)), False)
        if self.chance(0.6):
            self.links()
        if self.chance(0.5):
            self.block("p", self.prose(1), False)

    def form(self) -> None:
        tag = "form" if self.chance(0.7) else "div"
        self.out.append(f"<{tag}>")
        self.block("div", self.words(1, 4), False)
        self.out.append("<input>")
        self.block("p", self.words(3, 10, "."), False)
        self.out.append(f"</{tag}>")

    def comments(self) -> None:
        self.block("h3", f"{self.rng.integers(1, 99)} " + self.words(1, 2), False)
        for _ in range(int(self.rng.integers(1, 6))):
            tag = self.pick(("div", "li", "section"))
            self.out.append(f"<{tag}{self.attr(('comment', 'reply', 'comment-body', ''))}>")
            self.block("p", self.words(1, 3), False)
            self.block("p", self.prose(int(self.rng.integers(1, 4))), False)
            self.out.append(f"</{tag}>")

    def body(self) -> None:
        if self.chance(0.85):
            wrapped = self.family in ("semantic", "mixed") and self.chance(0.3)
            self.out.append("<header>" if wrapped else "")
            self.block("h1", self.words(2, 12), True)
            self.out.append("</header>" if wrapped else "")
        if self.chance(0.12):  # a very short article
            for _ in range(int(self.rng.integers(1, 3))):
                self.block("p", self.words(1, 9, self.pick((".", "", "?"))), True)
            return
        for _ in range(int(self.pick((1, 2, 3, 4, 6, 9, 14)))):
            kind = self.rng.random()
            if kind < 0.72:
                self.block("p" if self.family != "plain" or self.chance(0.6) else "div", self.prose(int(self.pick((1, 1, 2, 3, 5, 8)))), True)
            elif kind < 0.8:
                self.block(self.pick(("h2", "h3")), self.words(2, 7), True)
            elif kind < 0.88:
                self.out.append("<ul>")
                for _ in range(int(self.rng.integers(2, 6))):
                    self.block("li", self.words(3, 14, self.pick((".", "", ";"))), True)
                self.out.append("</ul>")
            elif kind < 0.93:
                self.block("blockquote", self.prose(2), True)
            elif kind < 0.96:
                self.block("p", self.words(1, 5, self.pick((".", "", "?"))), True)
            else:
                self.out.append("<figure>")
                self.block("figcaption", self.words(4, 12, "."), True)
                self.out.append("</figure>")
            if self.chance(0.07):
                self.region("div", _ADS, lambda: self.block("p", self.words(2, 14, self.pick((".", "!"))), False, self.chance(0.4)))

    def page(self) -> str:
        r = self.region
        table = self.family == "table"
        self.out.append("<!DOCTYPE html><html><head><title>" + self.words(2, 6) + "</title><style>p{}</style></head>")
        self.out.append(f"<body{self.attr(_CONTENT_NAMES, True) if self.chance(0.3) else ''}>")
        if self.chance(0.3):
            r("div", _NOTICE, lambda: self.block("p", self.prose(int(self.rng.integers(1, 3))), False))
        if self.chance(0.7):
            r("header", _HEADER, lambda: (self.block("p", self.words(1, 4), False), self.links() if self.chance(0.6) else None))
        if self.chance(0.7):
            r("nav", _MENU, self.links)
        if self.chance(0.4):
            r("div", _ADS, lambda: self.block("p", self.words(2, 14, self.pick((".", "", "!"))), False, self.chance(0.3)))
        if table:
            self.out.append("<table><tr>")
        if self.chance(0.3):
            r("aside", _SIDE, self.small)
        wide = self.chance(0.5)
        tag = self.pick(("article", "article", "main", "section")) if self.family in ("semantic", "mixed") else "td" if table else "div"
        if wide and self.family == "semantic":
            self.out.append(f"<main{self.attr(_CONTENT_NAMES, True)}>")
        self.out.append(f"<{tag}{self.attr(_CONTENT_NAMES, True)}>")
        self.body()
        if self.chance(0.25):
            r("div", _SHARE, self.links)
        if self.family in ("semantic", "mixed") and self.chance(0.15):
            self.out.append("<footer>")
            self.links() if self.chance(0.5) else self.block("p", self.words(2, 8), False)
            self.out.append("</footer>")
        if self.chance(0.15):
            self.out.append(f"<div{self.pick((' hidden', ' style=\"display:none\"', ' aria-hidden=\"true\"'))}>")
            self.block("p", self.prose(int(self.rng.integers(1, 4))), False)
            self.out.append("</div>")
        inside = self.chance(0.5)
        if not inside:
            self.out.append(f"</{tag}>")
        if self.chance(0.35):
            r("section", _COMMENTS, self.comments)
        if self.chance(0.25):
            r("div", _SIDE, self.small)
        if inside:
            self.out.append(f"</{tag}>")
        if wide and self.family == "semantic":
            self.out.append("</main>")
        if self.chance(0.4):
            r("aside", _SIDE, lambda: [self.small() for _ in range(int(self.rng.integers(1, 4)))])
        if table:
            self.out.append("</tr></table>")
        if self.chance(0.25):
            r("div", _FORMS, self.form)
        if self.chance(0.2):
            r("div", _NOTICE, lambda: self.block("p", self.prose(1), False))
        if self.chance(0.85):
            r("footer", _FOOT, self.foot)
        self.out.append("</body></html>")
        return "".join(self.out)


def labelled_pages(n: int, seed: int, families: tuple[str, ...]) -> list[tuple[str, list[tuple[str, bool]]]]:
    """n pages with their blocks (text, whether it is content) in page order."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        maker = _Maker(rng, families[i % len(families)])
        out.append((maker.page(), maker.labels))
    return out
