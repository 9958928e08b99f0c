"""Invented web pages with known main text: what the extractor's trees are trained on.

Layouts, element names and attribute words vary; ``data-label="main"`` marks main text and
``data-label="drop"`` what stands inside it but is none. The parser reads the mark for training only.
"""

from __future__ import annotations

import random

_SYLLABLES = "an be ca de el fo ga he in jo ka le mi no or pa qui re sa te un ver wi xa y zu ä é ch sch tion ing the st".split()
_MAIN_CLASS = ["content", "article", "post", "post-content", "entry-content", "story-body", "main-text", "articleBody", "entry", "body-text", "page", "text", "c1", "col-8", "row inner"]
_AD = ["ad", "ads", "advert", "ad-slot", "sponsored", "promo-box", "banner", "adsense", "ad-banner"]
_NOTICE = ["cookie-notice", "cookie", "consent", "notice", "alert", "gdpr-banner", "popup", "message"]
_SIDE = ["sidebar", "side", "widget", "rail", "related", "more-stories", "recent-posts", "col-4"]
_COMMENTS = ["comments", "comment-list", "disqus", "responses", "replies"]


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.words = ["".join(self.r.choices(_SYLLABLES, k=self.r.randint(1, 4))) for _ in range(300)]

    def sentence(self, low: int = 3, high: int = 25) -> str:
        w = self.r.choices(self.words, k=self.r.randint(low, high))
        s = " ".join(w).capitalize()
        if self.r.random() < 0.15:
            s = s.replace(" ", self.r.choice([" &amp; ", ", ", " &ndash; ", "&nbsp;"]), 1)
        return s + self.r.choice([".", ".", ".", "!", "?"])

    def prose(self, low: int = 1, high: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def phrase(self, low: int = 1, high: int = 4) -> str:
        return " ".join(self.r.choices(self.words, k=self.r.randint(low, high)))

    def link(self) -> str:
        return f'<a href="/{self.phrase(1, 1)}">{self.phrase()}</a>'

    def attribute(self, names: list[str], chance: float = 0.8) -> str:
        if self.r.random() > chance:
            return ""
        return f' {self.r.choice(["class", "class", "id"])}="{self.r.choice(names)}"'

    def links(self, low: int = 3, high: int = 9) -> str:
        n = self.r.randint(low, high)
        if self.r.random() < 0.75:
            return "<ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(n)) + "</ul>"
        return self.r.choice([" | ", " ", " &middot; "]).join(self.link() for _ in range(n))

    def inline(self, text: str) -> str:
        w = text.split(" ")
        if len(w) > 6 and self.r.random() < 0.3:
            i = self.r.randrange(len(w) - 3)
            tag = self.r.choice(['a href="/x"', "b", "em", "i", "strong", "span"])
            w[i], w[i + 2] = f"<{tag}>{w[i]}", f"{w[i + 2]}</{tag.split()[0]}>"
        return " ".join(w)

    def main_block(self) -> str:
        k = self.r.random()
        if k < 0.72:
            text = self.prose(1, self.r.choice([1, 3, 6, 12]))
            if self.r.random() < 0.15:
                return f"<p><b>{text}<br>" + (f"<p>{self.inline(self.prose())}</p>" if self.r.random() < 0.5 else "")
            return f"<p>{self.inline(text)}" + ("</p>" if self.r.random() < 0.9 else "")
        if k < 0.80:
            return f"<h{(n := self.r.randint(2, 4))}>{self.phrase(2, 7)}</h{n}>"
        if k < 0.86:
            tag = self.r.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{self.sentence(2, 12)}</li>" for _ in range(self.r.randint(2, 6))) + f"</{tag}>"
        if k < 0.90:
            return f"<blockquote><p>{self.prose(1, 3)}</p></blockquote>"
        if k < 0.93:
            rows = "".join("<tr>" + "".join(f"<td>{self.phrase(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(self.r.randint(2, 5)))
            return f"<table>{rows}</table>"
        if k < 0.96:
            return f"<figure><img src=x><figcaption>{self.sentence()}</figcaption></figure>"
        return f"<div>{self.prose(1, 4)}</div>"

    def intruder(self) -> str:
        """What may stand within the main text's element and is none of it."""
        k = self.r.random()
        if k < 0.4:
            return f'<div class="{self.r.choice(_AD)}" data-label="drop">{self.r.choice([self.prose(1, 2), self.link()])}</div>'
        if k < 0.6:
            return f'<div class="{self.r.choice(["share", "social-share", "sharing"])}" data-label="drop">{self.links(2, 5)}</div>'
        if k < 0.8:
            return f'<aside{self.attribute(_SIDE)} data-label="drop"><h3>{self.phrase()}</h3>{self.links(2, 5)}</aside>'
        return f'<form{self.attribute(["newsletter", "subscribe", "signup"])} data-label="drop"><p>{self.sentence(2, 8)}</p><label>{self.phrase()}</label><input><button>{self.phrase(1, 2)}</button></form>'

    def article(self) -> str:
        blocks = [self.main_block() for _ in range(self.r.choice([1, 2, 4, 8, 14]))]
        if self.r.random() < 0.3:
            blocks.insert(self.r.randint(0, len(blocks)), self.intruder())
        head = f"<h1>{self.sentence(3, 9) if self.r.random() < 0.5 else self.phrase(3, 9)}</h1>" if self.r.random() < 0.9 else ""
        if head and self.r.random() < 0.15:
            head = f"<header>{head}</header>"
        tag = self.r.choice(["article"] * 5 + ["div"] * 3 + ["main", "section"])
        attribute = self.attribute(_MAIN_CLASS, 0.35 if tag in ("article", "main") else 1.0)
        out = f'<{tag}{attribute} data-label="main">{head}{"".join(blocks)}</{tag}>'
        k = self.r.random()
        if k < 0.15:
            return f"<main>{out}</main>"
        if k < 0.3:
            return f'<div class="{self.r.choice(["container", "wrapper", "layout", "page", "main", "inner"])}">{out}{self.aside() if self.r.random() < 0.5 else ""}</div>'
        return out

    def top(self) -> list[str]:
        r, out = self.r, []
        nav = f"<nav{self.attribute(['menu', 'main-nav', 'navbar'], 0.3)}>{self.links()}</nav>" if r.random() < 0.75 else f'<div class="{r.choice(["menu", "nav", "navigation", "topnav"])}">{self.links()}</div>'
        if r.random() < 0.45:
            out.append(f"<header{self.attribute(['header', 'masthead', 'top'])}><div{self.attribute(['logo', 'brand', 'site-title'])}>{self.phrase()}</div><p>{self.sentence(2, 8)}</p>{nav if r.random() < 0.6 else ''}</header>")
        if r.random() < 0.85:
            out.append(nav)
        if r.random() < 0.25:
            out.append(f'<div class="{r.choice(["breadcrumb", "breadcrumbs", "toc"])}">{" &raquo; ".join(self.link() for _ in range(3))}</div>')
        if r.random() < 0.3:
            out.append(f'<div class="{r.choice(_NOTICE)}"><p>{self.prose(1, 3)}</p>{r.choice(["", self.link(), "<button>OK</button>"])}</div>')
        if r.random() < 0.6:
            out.append(self.ad())
        return out

    def ad(self) -> str:
        inner = self.r.choice([self.prose(1, 4), self.prose(1, 4), f"<p>{self.prose(1, 3)}</p>", self.link()])
        return f'<{(t := self.r.choice(["div", "div", "div", "section", "aside"]))} {self.r.choice(["class", "class", "id"])}="{self.r.choice(_AD)}">{inner}</{t}>'

    def aside(self) -> str:
        tag = self.r.choice(["aside", "aside", "div"])
        inner = self.r.choice([self.links(), f"<p>{self.prose(1, 3)}</p>", self.links() + f"<p>{self.sentence()}</p>"])
        return f"<{tag}{self.attribute(_SIDE, 0.5 if tag == 'aside' else 1.0)}><h3>{self.phrase()}</h3>{inner}</{tag}>"

    def comments(self) -> str:
        tag = self.r.choice(["div", "section"])
        each = [f'<{(t := self.r.choice(["div", "li", "article"]))} class="{self.r.choice(["comment", "reply", "comment-body"])}"><p>{self.phrase(1, 2)}</p><p>{self.prose(1, 4)}</p></{t}>' for _ in range(self.r.randint(1, 6))]
        return f'<{tag} {self.r.choice(["class", "id"])}="{self.r.choice(_COMMENTS)}"><h2>{self.phrase(1, 3)}</h2>{"".join(each)}</{tag}>'

    def bottom(self) -> list[str]:
        r, out = self.r, []
        if r.random() < 0.4:
            out.append(self.aside())
        if r.random() < 0.35:
            out.append(self.comments())
        if r.random() < 0.25:
            out.append(f"<form{self.attribute(['newsletter', 'search', 'login', 'contact'])}><p>{self.sentence(3, 10)}</p><label>{self.phrase()}</label><input name=q><button>{self.phrase(1, 1)}</button></form>")
        if r.random() < 0.25:
            out.append(self.ad())
        if r.random() < 0.2:
            out.append(f'<div class="{r.choice(_NOTICE)}">{self.prose(1, 2)}</div>')
        if r.random() < 0.9:
            inner = f"&copy; {self.phrase()} &middot; {self.prose(1, 2)}"
            inner = r.choice([inner, f"<p>{inner}</p>", self.links() + f"<p>{inner}</p>"])
            out.append(f"<footer>{inner}</footer>" if r.random() < 0.8 else f'<div class="{r.choice(["footer", "foot", "copyright"])}">{inner}</div>')
        return out

    def page(self) -> str:
        head = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{self.phrase(2, 8)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>'
        body = [*self.top(), "<!-- x -->" * (self.r.random() < 0.3), *([self.article()] if self.r.random() < 0.97 else []), *self.bottom()]
        return head + "".join(body) + ("</body></html>" if self.r.random() < 0.9 else "")
