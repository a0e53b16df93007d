"""Main text of web pages by tree scoring.

A page becomes a tree of its block elements. Each paragraph gives points, for its length and its
commas, to its parent in full and to its grandparent by half; a container's points are discounted
by the share of its text that stands in links. The best container, widened to the article or main
element around it, is kept with those siblings that read like it, with other articles that hold a
fifth of its points or more, and with the headings before it. Lists of links go, but not those of an
article. Elements that say what they are
(navigation, asides, comment sections and so on) take no part; a form takes part if it holds the
article or half of the text, and inside an article a doubtful name yields to running text.

Per page, in one pass where it is read: nothing is shuffled, and the time is linear in the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbom.llm.shared import small_batches

# Elements by how they take part.
RAW = ["script", "style", "textarea", "title"]
FOREIGN = ["svg", "math"]
HIDDEN = {"noscript", "template", "iframe", "object", "select", "button", "label", "legend", "datalist", *FOREIGN}
DROPPED = {"nav", "footer", "aside", "dialog", "menu", "head"}
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
TREE = BLOCK | HIDDEN
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
LISTED = {"ul", "ol", "dl", "table", "div", "section"}
#: A start tag of the key ends an open element of the values, up to the given scope.
ENDS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = {"ul", "ol", "dl", "table", "article", "section", "div", "main", "body"}
# Parts of class names, ids and roles. A name tells of what is no main text if all its
# parts are of these lists, and one is of the first two.
UNLIKELY = set(
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr "
    "login masthead menu modal nav navbar navigation newsletter overlay pager pagination popup promo promoted promotion reply "
    "replies respond sidebar signup sponsor sponsored subscribe subscription toolbar contentinfo".split()
)
#: Inside an article these tell only of what doesn't read like text itself.
DOUBTFUL = set("banner complementary header notice notices related search share sharing social widget".split())
NEUTRAL = set(
    "article articles area bar block body box btn button buttons col column container content form global group icon icons inner item items left "
    "link links list lists main media outer page panel post posts primary right row secondary section sections site sticky stories text title top bottom "
    "widget widgets wrap wrapper".split()
)
#: Characters outside links from which an element of a doubtful name in an article counts as text.
PROSE_CHARS = 200

_attributes = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""
_raw = re.compile(r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW) + rf")\b{_attributes}>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>", re.S | re.I)
_tag = re.compile(rf"""<(/?)([a-zA-Z][^\s/>]*)({_attributes})>""")
_names = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_part = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def unlikely(attributes: str) -> int:
    """2 if a name tells of what is no main text, 1 if it is doubtful."""
    found = 0
    for names in _names.finditer(attributes):
        for name in (names[1] or names[2] or names[3] or "").split():
            parts = {p.lower() for p in _part.findall(name)}
            if parts <= UNLIKELY | DOUBTFUL | NEUTRAL and parts - NEUTRAL | parts & DOUBTFUL:
                found = max(found, 2 if parts & UNLIKELY else 1)
    return found


class _Page:
    """The block tree of one page: per node its parent, tag and name; per block of text its node."""

    def __init__(self, html: str):
        self.parent, self.tag, self.named = [-1], ["#page"], [0]
        self.blocks: list[tuple[int, str, int]] = []  # node, text, characters in links
        self.stack, self.links = [0], 0
        self.text: list[str] = []
        self.linked = 0
        html = _raw.sub(" ", html)
        at = 0
        for m in _tag.finditer(html):
            if m.start() > at:
                self.add(html[at:m.start()])
            at = m.end()
            name = m[2].lower()
            if name in TREE:
                if m[1]:
                    self.close(name)
                elif not (name in FOREIGN and m[3].endswith("/")):  # other elements can't close themselves
                    self.open(name, m[3])
            elif name == "a":
                self.links = 0 if m[1] else 1
            elif name == "br":
                self.add(" ")
        if at < len(html):
            self.add(html[at:])
        self.flush()

    def add(self, text: str) -> None:
        self.text.append(text)
        if self.links:
            self.linked += len(text)

    def flush(self) -> None:
        if self.text:
            raw = "".join(self.text)
            text = " ".join((unescape(raw) if "&" in raw else raw).split())
            if text:
                self.blocks.append((self.stack[-1], text, min(self.linked, len(text))))
            self.text.clear()
            self.linked = 0

    def open(self, name: str, attributes: str) -> None:
        self.flush()
        if name in BLOCK:
            self.links = 0
        ending = ENDS.get(name)
        if ending:
            for k in range(len(self.stack) - 1, 0, -1):
                tag = self.tag[self.stack[k]]
                if tag in ending and (name != "tr" or tag == "tr"):
                    del self.stack[k:]
                    break
                if tag in SCOPE:
                    break
        elif name in BLOCK and (self.tag[self.stack[-1]] in ("p", "head") or self.tag[self.stack[-1]] in HEADINGS):
            del self.stack[-1]
        self.parent.append(self.stack[-1])
        self.tag.append(name)
        self.named.append(unlikely(attributes) if attributes and name in BLOCK and name not in ("html", "body", "article", "main") else 0)
        self.stack.append(len(self.tag) - 1)

    def close(self, name: str) -> None:
        self.flush()
        for k in range(len(self.stack) - 1, 0, -1):
            if self.tag[self.stack[k]] == name:
                del self.stack[k:]
                return

    def drop(self, by_name: bool) -> None:
        """Leaves out the blocks of elements that are no main text, by tag, name and what they hold."""
        n = len(self.tag)
        inside, gone = [False] * n, [False] * n  # inside an article or main element; in an element that goes
        for k in range(1, n):
            above = self.parent[k]
            inside[k] = inside[above] or self.tag[k] in ("article", "main")
            certain = self.tag[k] in DROPPED or self.tag[k] in HIDDEN or self.tag[k] == "header" and not inside[k]
            gone[k] = gone[above] or certain or by_name and (self.named[k] == 2 or self.named[k] == 1 and not inside[k])
        chars, linked, holds = [0] * n, [0] * n, [t in ("article", "main") for t in self.tag]
        for node, text, in_links in self.blocks:
            if not gone[node]:
                chars[node] += len(text)
                linked[node] += in_links
        for k in range(n - 1, 0, -1):
            above = self.parent[k]
            chars[above] += chars[k]
            linked[above] += linked[k]
            holds[above] |= holds[k] and not gone[k]
        for k in range(1, n):
            form = self.tag[k] == "form" and not inside[k] and not holds[k] and 2 * chars[k] <= chars[0] or self.tag[k] == "form" and inside[k] and not holds[k]
            doubtful = by_name and self.named[k] == 1 and inside[k] and (chars[k] - linked[k] < PROSE_CHARS or 0.3 * chars[k] < linked[k])
            gone[k] = gone[k] or gone[self.parent[k]] or form or doubtful
        self.blocks = [b for b in self.blocks if not gone[b[0]]]

    def main_blocks(self) -> list[str]:
        n = len(self.tag)
        points, chars, linked, whole = [0.0] * n, [0] * n, [0] * n, [0.0] * n
        for node, text, in_links in self.blocks:
            chars[node] += len(text)
            linked[node] += in_links
            score = (1 + min(len(text) / 100, 3) + text.count(",") + text.count("、") + text.count("،")) * (1 - in_links / len(text))
            whole[node] += score
            holder = self.parent[node] if self.tag[node] in ("p", "pre", "td", "blockquote", "li", "dd", "dt") or self.tag[node] in HEADINGS else node
            if holder >= 0:
                points[holder] += score
                if self.parent[holder] >= 0:
                    points[self.parent[holder]] += score / 2
        inside = [False] * n
        for node in range(1, n):
            inside[node] = inside[self.parent[node]] or self.tag[node] in ("article", "main")
        for node in range(n - 1, 0, -1):  # children come after their parents
            chars[self.parent[node]] += chars[node]
            linked[self.parent[node]] += linked[node]
            whole[self.parent[node]] += whole[node]
        density = [linked[k] / chars[k] if chars[k] else 0.0 for k in range(n)]
        value = [points[k] * (1 - density[k]) for k in range(n)]
        best = max(range(n), key=lambda k: (value[k], -k))
        around = best
        while around > 0 and self.tag[around] not in ("article", "main"):
            around = self.parent[around]
        told = around > 0  # an element says that it is the main text
        top = around if told else best
        kept = {top}
        siblings: dict[int, list[int]] = {}
        for k in range(1, n):
            if chars[k]:
                siblings.setdefault(self.parent[k], []).append(k)
        least = max(10.0, 0.2 * value[best])
        for k in siblings.get(self.parent[top], []) if top > 0 else []:  # siblings that read like it
            near_text = not told and self.tag[k] == "p" and chars[k] > 80 and density[k] < 0.25
            if density[k] < 0.5 and (value[k] >= least or near_text):
                kept.add(k)
        if self.tag[top] == "article":  # articles that stand elsewhere
            kept |= {k for k in range(1, n) if self.tag[k] == "article" and density[k] < 0.5 and whole[k] * (1 - density[k]) >= 0.2 * whole[top] * (1 - density[top])}
        node = top
        while node > 0:  # headings before it: any beside the container, the page's own further out
            last = max(k for k in siblings[self.parent[node]] if k in kept or k == node)
            kept |= {k for k in siblings[self.parent[node]] if k < last and density[k] < 0.5 and (self.tag[k] == "h1" or node == top and self.tag[k] in HEADINGS)}
            node = self.parent[node]
        keep = [False] * n
        for k in range(n):
            links = self.tag[k] in LISTED and density[k] > 0.5 and not inside[k]  # in an article they are part of it
            keep[k] = k in kept or self.parent[k] >= 0 and keep[self.parent[k]] and not links
        return [text for node, text, _ in self.blocks if keep[node]]


def main_text(html: str | None) -> str:
    """Main text of a page, blocks joined by a line feed; null, empty and textless pages give ''."""
    if not html:
        return ""
    for by_name in (True, False):  # where all stands in elements with telling names, these names tell nothing
        page = _Page(html)
        page.drop(by_name)
        if page.blocks:
            return "\n".join(page.main_blocks())
    return ""


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns, text and n_chars (code points) of each page.

    Null and empty pages give an empty text, repeated rows stay repeated, very long pages are read as
    a whole (memory and time are linear in the page), an empty table gives no rows. Other columns
    than html and the kept ones are not read; null keys and addresses stay null.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts = [main_text(h) for h in rows["raw_page"]]
            yield rows.drop(columns="raw_page").assign(text=texts, n_chars=[len(t) for t in texts])

    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    fields = ", ".join(f"k{i} {pages.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    out = small_batches(pages).select(*kept, F.col(html).alias("raw_page")).mapInPandas(run, f"{fields}, text string, n_chars long")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "text", "n_chars")
