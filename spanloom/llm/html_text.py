"""Main text of web pages as a maximum-scoring subsequence: words score positive and tags negative, and one linear scan finds the best contiguous region.

Every word counts, by how likely words in elements like those around it are content, and every tag costs, by how rarely such tags stand in content. Both
sets of weights are fitted on labelled pages. No block is left out before the scan: it alone decides where the article begins and ends. What stands inside
that region but is much less likely to be content than the region as a whole, such as a notice or an advert, is cut from it afterwards.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s\"'>][^\s>]*)?|[^>=])*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?""")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
#: Elements whose content is no markup, without end tag, and that begin and end a block.
RAW = {"script", "style", "noscript", "template", "iframe"}
RAW_TEXT = {"textarea", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
#: Elements that end an open paragraph.
ENDS_P = BLOCK - {"body", "head", "html", "title", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "legend"}
#: Elements within a line: what they are tells nothing, unless they are named. The feature of blocks whose words stand in links for the most part.
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
LINKED = "linked"
#: Least score of a word; part of its cost that a tag has in what is more likely content, in between, and in what is hardly content; how much lower the log-odds
#: of a block (of a part of a block) must be than the region's for it to be cut, where they are below 0 (-1).
LEAST_WORD, TAG_PARTS, LOWER = 0.05, (0.1, 0.5, 0.8), 1.0
#: Part of a page's words that counts as content if its log-odds can be raised that much.
LIKELIEST, RAISED = 0.1, 4.0
#: Remembered kinds of tags.
REMEMBERED = 50_000


def features(tag: str, attributes: str) -> tuple[str, ...]:
    """Of one element: its tag, the parts of its class, id and role names, and whether it is hidden."""
    out = [] if tag in INLINE else [f"t:{tag}"]
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role"):
            out += [f"n:{x.lower()}" for x in NAME_PARTS.findall(value)]
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            out.append("hidden")
    return tuple(dict.fromkeys(out))


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """('open', tag, attributes), ('close', tag, ''), ('text', raw text, '') in page order; comments and the inside of scripts and the like left out."""
    at = 0
    while at < len(page):
        found = TAG.search(page, at)
        if not found:
            yield "text", page[at:], ""
            return
        if found.start() > at:
            yield "text", page[at : found.start()], ""
        at = max(found.end(), found.start() + 1)
        tag = (found[2] or "").lower()
        if not tag:
            if found[0].startswith("<![CDATA["):
                yield "text", html.escape(found[0][9:].removesuffix("]]>")), ""
            continue
        if found[1]:
            yield "close", tag, ""
            continue
        yield "open", tag, found[3]
        if tag in RAW or tag in RAW_TEXT:
            end = re.compile(rf"</{tag}\b", re.I).search(page, at)
            stop = end.start() if end else len(page)
            if tag in RAW_TEXT and stop > at:
                yield "text", page[at:stop], ""
            at = stop


@dataclass
class Weights:
    """word: log-odds of content for each feature of the elements around, and `base` for none; tag: the (negative) score of a tag."""

    word: dict[str, float]
    base: float
    tag: dict[str, float]
    known: dict[tuple[str, str], float] = field(default_factory=dict)

    def of(self, tag: str, attributes: str) -> float:
        value = self.known.get((tag, attributes))
        if value is None:
            value = sum(self.word.get(f, 0.0) for f in features(tag, attributes))
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[tag, attributes] = value
        return value


@dataclass
class Piece:
    """A run of text, a tag, or (with weights) the whole text of a block."""

    score: float
    text: str = ""
    breaks: bool = False  # a block ends here
    linked: bool = False
    around: tuple[tuple[str, str], ...] = ()


def pieces(page: str, weights: Weights | None) -> Iterator[Piece]:
    """The page's runs of text and its tags, with the elements around each; with weights, a run's score is its log-odds and a tag's is its cost."""
    stack: list[tuple[str, float, tuple[str, str]]] = []
    places: dict[str, list[int]] = {}  # of each name, where it is in the stack
    links = 0
    for kind, name, attributes in tokens(page):
        if kind == "text":
            yield Piece(stack[-1][1] if stack else weights.base if weights else 0.0, html.unescape(name), linked=links > 0, around=() if weights else tuple(x[2] for x in stack))
            continue
        odds = stack[-1][1] if stack else weights.base if weights else 0.0
        cost = weights.tag.get(name, -0.5) * TAG_PARTS[0 if odds > 0 else 1 if odds > -1 else 2] if weights else 0.0
        yield Piece(cost, breaks=name in BLOCK, text=" " if name == "br" else "", around=((name, ""),))
        if kind == "open":
            if name in ENDS_P:
                _close(stack, places, "p", {"table", "td", "th", "li", "div", "article", "section", "blockquote"})
            if name == "li":
                _close(stack, places, "li", {"ul", "ol", "menu"})
            if name not in VOID and not attributes.rstrip().endswith("/"):
                places.setdefault(name, []).append(len(stack))
                stack.append((name, odds + weights.of(name, attributes) if weights else 0.0, (name, attributes)))
        else:
            _close(stack, places, name, set())
        links = len(places.get("a", ()))


def likeliest(counted: list[tuple[float, int]], part: float) -> float | None:
    """The log-odds that this part of the words, the likeliest, has at least; None without words."""
    rest, odds = part * sum(n for _, n in counted), None
    for odds, n in sorted(((o, n) for o, n in counted if n), reverse=True):
        if (rest := rest - n) <= 0:
            break
    return odds


@dataclass
class Block:
    """What the scan sees: the words of a block together, or a tag between blocks. parts: runs of text with their log-odds."""

    score: float
    odds: float = 0.0
    words: int = 0
    parts: list[tuple[str, float]] = field(default_factory=list)


def blocks(page: str, weights: Weights) -> list[Block]:
    """All of the page in order: nothing is left out here.

    Log-odds are relative to the page: where an article stands in an element with a misleading name, all are raised until the likeliest part of the
    words counts as content, by RAISED at most, so that a page of menus still has none."""
    out: list[Block] = []
    held: list[Piece] = []
    seen = list(pieces(page, weights))
    top = likeliest([(x.score, len(x.text.split())) for x in seen if not x.around and not x.linked], LIKELIEST)
    raised = max(0.0, min(RAISED, 1.0 - top)) if top is not None else 0.0
    for p in [*seen, Piece(0, breaks=True)]:
        if not p.around and not p.breaks:
            p.score += raised
        if not p.breaks:
            held.append(p)
            continue
        sizes = [0 if x.around else len(x.text.split()) for x in held]
        if total := sum(sizes):
            linked = weights.word.get(LINKED, 0.0) if 2 * sum(n for x, n in zip(held, sizes, strict=True) if x.linked) > total else 0.0
            odds = sum(x.score * n for x, n in zip(held, sizes, strict=True)) / total + linked
            score = sum(n * max(LEAST_WORD, 1 / (1 + math.exp(-max(-30.0, min(30.0, x.score + linked))))) if n else x.score if x.around else 0.0 for x, n in zip(held, sizes, strict=True))
            out.append(Block(score, odds, total, [(x.text, 0.0 if x.around else x.score) for x in held]))
        elif cost := sum(x.score for x in held if x.around):
            out.append(Block(cost))
        held = []
        out.append(Block(p.score))
    return out


def cut(region: list[Block]) -> list[str]:
    """The texts of the region's blocks, without those, and those parts, that are out of place in it."""
    level = likeliest([(b.odds, b.words) for b in region], 0.25)
    good = [b for b in region if b.words and (b.odds > 0 or b.odds > level - LOWER)]
    return ["".join(t for t, odds in b.parts if odds > -1 or odds > level - LOWER or not t.strip()) for b in good]


def _close(stack: list, places: dict[str, list[int]], name: str, walls: set[str]) -> None:
    if not places.get(name):
        return
    at = places[name][-1]
    if any(places.get(w) and places[w][-1] > at for w in walls):
        return
    for x in stack[at:]:
        places[x[0]].pop()
    del stack[at:]


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous part with the largest sum; the first and shortest of equal ones; empty if no part is above 0."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i + 1)
    return found


def extract(page: str, weights: Weights, scan: bool = True) -> str:
    """The main text, one block a line; without `scan`, what the cut would leave of the whole page."""
    parts = blocks(page, weights)
    start, end = best_region([p.score for p in parts]) if scan else (0, len(parts))
    return "\n".join(line for text in cut(parts[start:end]) if (line := " ".join(text.split())))


def fit(pages: list[tuple[str, str]], rounds: int = 400, ridge: float = 0.02) -> Weights:
    """From labelled pages (html, main text with one block a line): logistic weights of the elements around words, tag scores from where tags stand."""
    rows: list[tuple[frozenset[str], int, int]] = []
    tags: dict[str, list[int]] = {}
    for page, text in pages:
        lines = set(text.split("\n"))
        parts = list(pieces(page, None))
        block: list[Piece] = []
        marks: list[tuple[Piece, bool, bool]] = []
        for p in [*parts, Piece(0, breaks=True, around=(("", ""),))]:
            if p.breaks:
                good = " ".join("".join(b.text for b in block).split()) in lines
                total = sum(len(b.text.split()) for b in block)
                linked = 2 * sum(len(b.text.split()) for b in block if b.linked) > total
                marks += [(b, good, linked) for b in block] + [(p, False, False)]
                block = []
            else:
                block.append(p)
        inside = [i for i, (_, good, _) in enumerate(marks) if good]
        for i, (p, good, linked) in enumerate(marks):
            if p.text.strip():
                rows.append((frozenset([f for e in p.around for f in features(*e)] + [LINKED] * linked), int(good), len(p.text.split())))
            elif p.around and p.around[0][0]:
                count = tags.setdefault(p.around[0][0], [0, 0])
                count[bool(inside and inside[0] <= i <= inside[-1])] += 1
    names = sorted({f for fs, _, _ in rows for f in fs})
    index = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1))
    for i, (fs, _, _) in enumerate(rows):
        x[i, [index[f] for f in fs]] = 1
    x[:, -1] = 1
    y, n = np.array([r[1] for r in rows], float), np.sqrt(np.array([r[2] for r in rows], float))
    n /= max(1.0, n.sum())
    w = np.zeros(x.shape[1])
    for _ in range(rounds // 20):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (n * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + ridge / len(names) * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(hessian, x.T @ (n * (p - y)) + ridge / len(names) * w), -3, 3)
    cost = {t: -(out + 1) / (out + into + 2) for t, (out, into) in tags.items()}
    return Weights({f: float(w[i]) for f, i in index.items()}, float(w[-1]), cost)


def main_text(df: DataFrame, weights: Weights, page: str = "html") -> DataFrame:
    """df without its html, with text (blocks joined by one \\n) and n_chars (its code points). Null and empty pages, and pages without content, give the
    empty text. Markup that is cut off, unclosed or wrongly nested is read as far as it goes. Repeated rows stay, other columns go through; ValueError if
    one is named like a result."""

    def make():
        def work(pages: list[str]) -> list[list]:
            texts = [extract(p, weights) for p in pages]
            return [texts, [len(t) for t in texts]]

        return work

    return common.map_texts(df, page, make, "text string, n_chars long", [pa.string(), pa.int64()])


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .labelled_pages import labelled_pages

    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text(pages, fit(labelled_pages())).select("page_id", "url", "text", "n_chars")
