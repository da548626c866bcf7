"""Generated web pages with their truth, for fitting and judging the extraction of main text.

A page is built from parts: an article (headings, paragraphs, lists, tables, quotes, code) and boilerplate (menus, headers, sidebars, notices, adverts,
forms, comments, related links, footers), under tags and names drawn at random: with semantic elements or without, with names that mislead on
wrappers and inside the article, or names that say nothing at all, with long boilerplate and short paragraphs. Each block's text is unique in its page.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

_SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe ri so tu va we xi yo zu ar el in or un ta".split()
_MENU = ["nav", "menu", "main-nav", "navbar", "site-menu", "topnav", "navigation", "breadcrumbs"]
_ADS = ["ad", "ads", "advert", "ad-slot", "adBox", "sponsored", "promo", "advertisement-block"]
_NOTICES = ["cookie-banner", "notice", "gdpr-consent", "newsletter", "alert", "popup-overlay", "cookieNotice", "subscribe-box"]
_SIDE = ["sidebar", "widget", "sidebar-right", "related-posts", "recommended", "side-widget", "widgets"]
_COMMENTS = ["comments", "comment-list", "disqus", "replies", "commentSection", "respond"]
_FOOT = ["footer", "site-footer", "copyright", "footer-links", "pageFooter"]
_HEAD = ["header", "masthead", "site-header", "top-banner", "pageHeader"]
_BODY = ["", "single post no-sidebar", "has-sidebar", "page comments-open", "home with-banner", "layout", "theme-dark", "no-footer ads-enabled", "container"]
_CONTENT = ["content", "post", "entry-content", "article-body", "story", "prose", "main", "text", ""]
_INSIDE = ["", "", "", "related-work", "section", "search-methods", "intro", "comment-analysis", "banner-history", "part"]
_ROLES = {"nav": "navigation", "cookie-banner": "alert", "sidebar": "complementary", "footer": "contentinfo", "header": "banner", "content": "main"}
_SHARE = ["share-link", "ad", "social-share", "sponsored"]
_INLINE = ["hljs-comment", "search", "notice", "highlight", "comment", "menu-term", ""]


class _Page:
    def __init__(self, rng: random.Random):
        self.rng, self.truth, self.said = rng, set(), set()
        self.bare = rng.choice([0.0, 0.0, 0.1, 0.6])  # how much of the article stands in no paragraph
        self.plain = rng.random() < 0.35  # names that say nothing

    def word(self) -> str:
        return "".join(self.rng.choice(_SYLLABLES) for _ in range(self.rng.randrange(1, 5)))

    def words(self, low: int, high: int) -> str:
        """A text that the page has not had."""
        while True:
            text = " ".join(self.word() for _ in range(self.rng.randrange(low, high)))
            if text not in self.said:
                self.said.add(text)
                return text

    def sentences(self, low: int, high: int) -> str:
        out = []
        for _ in range(self.rng.randrange(low, high)):
            w = self.words(3, 18).split()
            if len(w) > 8 and self.rng.random() < 0.5:
                w[4] += ","
            out.append(" ".join(w).capitalize() + self.rng.choice("...?!"))
        return " ".join(out)

    def good(self, text: str) -> str:
        self.truth.add(text)
        return text

    def named(self, names: list[str], tags: tuple = ("div", "div", "section")) -> tuple[str, str]:
        tag, name = self.rng.choice(tags), self.rng.choice(names)
        if self.plain:
            name = "c" + self.word()
        if self.rng.random() < 0.06:
            role = _ROLES.get(names[0])
            return (f'<{tag} role="{role}">' if role else f"<{tag}>"), f"</{tag}>"
        kind = self.rng.choice(["class", "class", "id"])
        return (f'<{tag} {kind}="{name}">' if name else f"<{tag}>"), f"</{tag}>"

    def links(self, low: int = 2, high: int = 9) -> str:
        return "<ul>" + "".join(f"<li><a href='/{self.word()}'>{self.words(1, 4)}</a></li>" for _ in range(self.rng.randrange(low, high))) + "</ul>"

    def part(self, semantic: float, tag: str, names: list[str], inside: str) -> str:
        if self.rng.random() < semantic:
            return f"<{tag}>{inside}</{tag}>"
        a, b = self.named(names)
        return a + inside + b

    def paragraph(self) -> str:
        rng = self.rng
        text = self.good(self.sentences(1, rng.choice([2, 4, 7])) if rng.random() < 0.85 else self.words(1, 6).capitalize() + rng.choice([".", "", ":"]))
        w = text.split(" ")
        if rng.random() < 0.06 and len(w) > 6:
            k = rng.randrange(1, len(w) - 1)
            self.truth -= {text}
            return f"<p>{self.good(' '.join(w[:k]))} <span class='{rng.choice(_SHARE)}'>{self.words(1, 4)}</span> {self.good(' '.join(w[k:]))}</p>"
        if rng.random() < 0.2 and len(w) > 4:
            k = rng.randrange(1, len(w) - 1)
            name, tag = rng.choice(_INLINE), rng.choice(["span", "em", "b", "a", "code"])
            w[k] = f'<{tag} class="{name}">{w[k]}</{tag}>' if name else f"<{tag}>{w[k]}</{tag}>"
        return f"<p>{' '.join(w)}" + ("</p>" if rng.random() < 0.9 else "")

    def article(self) -> str:
        rng = self.rng
        out = [f"<h1>{self.good(self.words(2, 10).capitalize())}</h1>"] if rng.random() < 0.85 else []
        if out and rng.random() < 0.2:
            out = ["<header>" + out[0] + f"<p>{self.good('By ' + self.words(2, 4))}</p></header>"]
        for _ in range(rng.randrange(1, 12)):
            kind = rng.random()
            if rng.random() < self.bare:
                text = self.good(self.sentences(1, 6) if rng.random() < 0.7 else self.words(2, 9))
                closed = not out or (out[-1].endswith(">") and not out[-1].startswith("<p>")) or out[-1].endswith("</p>")
                out.append(text if closed and rng.random() < 0.6 else f"<div>{text}</div>")
            elif kind < 0.66:
                out.append(self.paragraph())
            elif kind < 0.76:
                out.append(f"<h2>{self.good(self.words(1, 7).capitalize())}</h2>")
            elif kind < 0.84:
                out.append("<ul>" + "".join(f"<li>{self.good(self.sentences(1, 2) if rng.random() < 0.5 else self.words(2, 9))}</li>" for _ in range(rng.randrange(1, 6))) + "</ul>")
            elif kind < 0.88:
                out.append("<table>" + "".join(f"<tr><td>{self.good(self.words(1, 5))}</td><td>{self.good(self.words(1, 5))}</td></tr>" for _ in range(rng.randrange(1, 4))) + "</table>")
            elif kind < 0.91:
                out.append(f"<blockquote>{self.good(self.sentences(1, 3))}</blockquote>")
            elif kind < 0.94:
                name = rng.choice(_INSIDE)
                out.append((f'<section class="{name}">' if name else "<section>") + f"<h2>{self.good(self.words(1, 5).capitalize())}</h2>" + self.paragraph() + self.paragraph() + "</section>")
            elif kind < 0.985:
                out.append(self.part(0, "div", rng.choice([_ADS, _ADS, _NOTICES, _SIDE]), f"<p>{self.sentences(1, 3)}</p>" if rng.random() < 0.5 else self.words(3, 12)))
            else:
                out.append(f"<form><label>{self.words(1, 4)}</label><input name=q></form>")
        return "".join(out)

    def boilerplate(self, kind: str, semantic: float) -> str:
        rng = self.rng
        if kind == "menu":
            return self.part(semantic, "nav", _MENU, self.links())
        if kind == "head":
            return self.part(semantic, "header", _HEAD, f"<{'h1' if rng.random() < 0.3 else 'div'}>{self.words(1, 5)}</div><p>{self.words(2, 9)}</p>".replace("<h1>", "<h1>", 1))
        if kind == "ad":
            return self.part(0, "div", _ADS, self.sentences(1, 4) if rng.random() < 0.6 else f"<p>{self.words(3, 20)}</p>")
        if kind == "notice":
            return self.part(0, "div", _NOTICES, f"<p>{self.sentences(1, 4)}</p><button>OK</button>")
        if kind == "side":
            return self.part(semantic, "aside", _SIDE, f"<h3>{self.words(1, 4)}</h3>" + (self.links() if rng.random() < 0.6 else f"<p>{self.sentences(1, 4)}</p>"))
        if kind == "form":
            return f"<form><label>{self.words(1, 4)}</label><p>{self.words(2, 12)}</p><input name=m></form>"
        if kind == "comments":
            each = lambda: rng.choice(["<div class='comment'><b>{a}</b><p>{b}</p></div>", "<li><p>{b}</p></li>", "<article class='comment-body'><p>{b}</p></article>"]).format(a=self.words(1, 3), b=self.sentences(1, 5))
            a, b = self.named(_COMMENTS)
            return f"{a}<h2>{self.words(1, 3)}</h2>" + "".join(each() for _ in range(rng.randrange(1, 9))) + b
        rights = f"&copy; {rng.randrange(1998, 2026)} {self.words(1, 6)}. All rights reserved." if rng.random() < 0.4 else f"&copy; {rng.randrange(1998, 2026)} {self.words(1, 4)}" if rng.random() < 0.5 else f"&copy; {self.word()}.example &middot; {self.sentences(1, 3)}"
        if "&copy;" in rights and rng.random() < 0.2:
            return rng.choice(["<div>{}</div>", "<p>{}</p>", "<div><p>{}</p></div>"]).format(rights)
        return self.part(semantic, "footer", _FOOT, (self.links() if rng.random() < 0.4 else "") + (f"<p>{rights}</p>" if rng.random() < 0.5 else rights))

    def whole(self) -> str:
        rng = self.rng
        semantic = rng.choice([0.0, 0.5, 1.0])
        some = lambda kind, p: self.boilerplate(kind, semantic) if rng.random() < p else ""
        article = self.article()
        if rng.random() < 0.65:
            name = rng.choice(_CONTENT)
            article = (f'<article class="{name}">' if name and rng.random() < 0.5 else "<article>") + article + some("comments", 0.1) + "</article>"
        else:
            a, b = self.named(_CONTENT, ("div",))
            article = a + article + b
        if rng.random() < 0.3:
            article = f"<main>{article}{some('comments', 0.25)}{some('side', 0.2)}</main>"
        top = some("head", 0.5) + some("menu", 0.8) + some("ad", 0.5) + some("notice", 0.35)
        end = some("side", 0.5) + some("comments", 0.35) + some("ad", 0.2) + some("form", 0.25) + some("notice", 0.1) + some("foot", 0.8)
        if rng.random() < 0.08:
            top = end = ""
        if rng.random() < 0.15:
            top += f"<div {rng.choice(['hidden', 'style=\"display: none\"', 'aria-hidden=true'])}><p>{self.sentences(1, 3)}</p></div>"
        name = rng.choice(_BODY)
        inner = top + article + end
        if rng.random() < 0.4:
            inner = f'<div class="{rng.choice(_BODY)}" id="wrap">{inner}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><style>p{{}}</style></head><body" + (f' class="{name}"' if name else "") + f">{inner}</body></html>"


def generated(n: int, seed: int) -> Iterator[tuple[str, set[str]]]:
    """n pages, each with the texts of its article's blocks."""
    rng = random.Random(seed)
    for _ in range(n):
        page = _Page(rng)
        yield page.whole(), page.truth
