"""Labelled pages for the weights of the main-text operator: invented pages with many layouts and namings, each with the text a reader would keep."""

from __future__ import annotations

import random

#: Names that sites give to parts of a page, by what the part is.
NAMES = {
    "menu": "nav navbar navigation menu main-menu top-menu site-nav breadcrumb breadcrumbs pagination pager tabs toolbar skip-link sitemap toc-nav",
    "header": "header page-header site-header masthead topbar top-bar branding logo site-title banner",
    "footer": "footer site-footer page-footer bottom-bar colophon copyright legal credits imprint",
    "sidebar": "sidebar side-bar aside rail left-column right-col secondary widget widget-area related related-posts recommended trending popular more-stories tag-cloud tags archive-list",
    "notice": "notice cookie cookie-notice cookie-banner consent gdpr alert popup modal overlay toast dialog paywall disclaimer announcement message-bar",
    "advert": "ad ads advert advertisement ad-slot ad-container adsense sponsor sponsored promo promotion promoted banner-ad dfp outbrain taboola partner-links",
    "form": "form search search-form search-box login signup subscribe subscription newsletter contact-form poll survey rating",
    "comments": "comments comment comment-list comments-area discussion disqus replies reply respond reader-comments user-comments responses",
    "share": "share sharing social social-links share-buttons follow-us author-bio about-author byline meta post-meta toolbar-share",
}
CONTENT = "article content main-content post post-body entry entry-content story story-body article-body body-text page-content text blog-post news prose markdown document"
WORDS = "tala mirro sent vo bara nin kesto rilen po dura mesti wan ello kara tiv sanna ru polim gesta onda firre lo mekin dast aru velna quist mano terra".split()


class Writer:
    def __init__(self, seed: int) -> None:
        self.random, self.lines = random.Random(seed), []

    def words(self, low: int, high: int) -> str:
        text = " ".join(self.random.choice(WORDS) for _ in range(self.random.randint(low, high)))
        return text.capitalize() + self.random.choice([".", ".", "!", "?", " …"])

    def line(self, low: int, high: int, tag: str) -> str:
        """A block of the main text, with its label written down."""
        text = f"{self.words(low, high)} {len(self.lines)}"
        self.lines.append(text)
        parts = text.split(" ")
        if len(parts) > 6 and self.random.random() < 0.3:
            i = self.random.randrange(1, len(parts) - 2)
            inline = self.random.choice(["a href='/x'", "b", "em", "i", "strong", "span", "code", "u", "mark", "sup"])
            parts[i] = f"<{inline}>{parts[i]}</{inline.split()[0]}>"
        return f"<{tag}>{' '.join(parts)}</{tag}>"

    def content(self) -> str:
        out = [self.line(2, 8, "h1")] if self.random.random() < 0.8 else []
        for _ in range(self.random.randint(2, 9)):
            kind = self.random.random()
            if kind < 0.66:
                out.append(self.line(*((1, 6) if self.random.random() < 0.2 else (8, 60)), "p"))
            elif kind < 0.74:
                out.append(self.line(2, 7, self.random.choice(["h2", "h3", "h4"])))
            elif kind < 0.8:
                kind = self.random.choice(["ul", "ol"])
                out.append(f"<{kind}>" + "".join(self.line(3, 12, "li") for _ in range(self.random.randint(2, 5))) + f"</{kind}>")
            elif kind < 0.84:
                out.append("<blockquote>" + self.line(6, 25, "p") + "</blockquote>")
            elif kind < 0.87:
                out.append("<table><tr>" + "".join(self.line(1, 4, "td") for _ in range(4)) + "</tr></table>")
            elif kind < 0.9:
                out.append(self.line(5, 20, "pre"))
            elif kind < 0.93:
                out.append("<figure><img src=x>" + self.line(3, 10, "figcaption") + "</figure>")
            elif kind < 0.96:
                out.append(self.line(6, 30, "div"))
            else:
                out.append(self.rest(self.random.choice(["advert", "notice", "share", "form", "sidebar"])))
        return "\n".join(out)

    def rest(self, kind: str) -> str:
        """A part that is no main text."""
        pick, name = self.random.choice, self.random.choice(NAMES[kind].split())
        native = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}.get(kind)
        plain = native and self.random.random() < 0.45
        tag = native if plain else pick(["div", "div", "section", "ul" if kind == "menu" else "div", "aside" if kind in ("advert", "sidebar") else "div"])
        attributes = "" if plain else f" {pick(['class', 'class', 'id'])}=\"{name}\""
        links = "".join(f"<li><a href='/{i}'>{self.words(1, 3)}</a></li>" for i in range(self.random.randint(3, 8)))
        few = "".join(f"<p>{self.words(2, 25)}</p>" for _ in range(self.random.randint(1, 3)))
        inner = {
            "menu": links if tag == "ul" else f"<ul>{links}</ul>",
            "header": f"<a href='/'>{self.words(1, 3)}</a><p>{self.words(2, 6)}</p>",
            "footer": f"&copy; {self.words(2, 9)} <a href='/i'>{self.words(1, 2)}</a>" + (few if pick([0, 1]) else ""),
            "sidebar": f"<{(h := pick(['h2', 'h3', 'h4']))}>{self.words(1, 3)}</{h}>" + pick([f"<ul>{links}</ul>", few]),
            "notice": f"{few}<button>{self.words(1, 2)}</button>" if pick([0, 1]) else self.words(4, 20),
            "advert": pick([self.words(3, 14), f"<a href='//x'>{self.words(2, 10)}</a>", few]),
            "form": f"<label>{self.words(1, 3)}</label><input name=q><select><option>{self.words(1, 2)}</option></select><textarea>{self.words(1, 4)}</textarea><button>{self.words(1, 2)}</button>",
            "comments": f"<{(h := pick(['h2', 'h3', 'h4']))}>{self.words(1, 3)}</{h}>" + "".join(f"<{pick(['div', 'li', 'article'])} class=comment><b>{self.words(1, 2)}</b><p>{self.words(3, 40)}</p></div>" for _ in range(self.random.randint(1, 5))),
            "share": f"<span>{self.words(1, 4)}</span><a href=#>{self.words(1, 1)}</a><time>{self.words(1, 2)}</time>",
        }[kind]
        return f"<{tag}{attributes}>{inner}</{tag}>"

    def page(self) -> tuple[str, str]:
        pick = self.random.choice
        names = list(NAMES)
        before = [self.rest(pick(["menu", "header", "notice", "advert", "form"])) for _ in range(self.random.randint(1, 5))]
        inner = self.content()
        style = self.random.random()
        if style < 0.3:
            core = f"<article>{inner}{self.rest('comments') if pick([0, 0, 1]) else ''}</article>"
        elif style < 0.45:
            core = f"<main>{inner}{self.rest('share') if pick([0, 1]) else ''}</main>"
        elif style < 0.85:
            core = f"<{(t := pick(['div', 'section']))} {pick(['class', 'id'])}='{pick(CONTENT.split())}'>{inner}{self.rest('comments') if pick([0, 0, 1]) else ''}</{t}>"
        else:
            core = f"<div>{inner}</div>"
        after = [self.rest(pick(["comments", "sidebar", "footer", "advert", "share", "menu", "form"])) for _ in range(self.random.randint(1, 5))]
        middle = [self.rest(pick(names)) for _ in range(self.random.randint(0, 2))]
        head = f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><style>p{{}}</style><script>var a='<p>{self.words(2, 5)}</p>'</script></head><body>"
        return head + "\n".join([*before, *middle, core, *after]) + f"<div hidden>{self.words(3, 9)}</div></body></html>", "\n".join(self.lines)


def labelled_pages(count: int = 600, seed: int = 11) -> list[tuple[str, str]]:
    return [Writer(seed * 100_003 + i).page() for i in range(count)]
