"""The main text of web pages by tree scoring.

Markup is read into a tree of block elements. Menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments are left out, by element, role, and names of class and id (a name counts if all its words
do, so that `share-price` is none). Names that may also stand for content (`legal`, `related`) only take an element out
if it is short or a quarter of its text is in links. Every paragraph then passes points (one, one for each comma, one
for each hundred characters up to three) to its parent, half as many to the next ancestor and fewer to the further
ones, `LEVELS` in all; a container's points are discounted by the share of its text in links, and count twice for
article and main elements. The best container (the last one in page order of equals, or the article or main element
around it) is kept, with those of its siblings that score a fifth of it or are long paragraphs with few links; inside
these, containers of `LINK_BLOCKS` blocks with links or more and `LINK_LIST` of their text in links are left out.

Defined results: null or empty pages, and pages without text, give an empty text; character references are decoded;
white space within a block becomes one space; blocks are joined by two line feeds in page order, repeated ones too;
markup that is cut off or badly nested ends what it must; tags without an end are dropped; a quote without an end is
no quote, and a tag may be of any length; a button, picture or the like without an end ends at the next block; pages of any length are read whole; equal pages give equal texts; an empty table gives no rows;
other columns are kept.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_column, table

#: Elements that begin and end blocks.
BLOCKS = frozenset("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary hgroup center fieldset header footer nav aside form menu dialog search noscript template".split())
VOID_BLOCKS = frozenset({"hr"})
#: Elements left out with all that is in them.
LEFT_OUT = frozenset("head nav header footer aside form menu dialog search noscript template fieldset".split())
#: Elements whose content is no markup.
RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in ("script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp")}
#: Elements within lines that are left out.
SILENT = frozenset({"svg", "select", "button", "object", "canvas", "audio", "video"})
#: What ends no such element before it does itself.
WHOLE = re.compile(r"</(?:article|main|body)(?=[\s/>])", re.I)
PARAGRAPHS = frozenset("p pre td th li dt dd h1 h2 h3 h4 h5 h6 figcaption caption summary blockquote".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist note".split())
#: Words of class and id that mark what isn't main text.
MARKS = frozenset("ad ads adv advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored sidebar comment comments commentlist respond disqus discussion replies reply menu nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr newsletter subscribe subscription signup login notice notices popup modal overlay lightbox outbrain taboola pager pagination toolbar".split())
#: And those that may also stand for content.
DOUBTFUL = frozenset("side rail foot header alert warning share sharing social related recommended recommendations widget widgets skip hidden copyright legal".split())
#: Words that say nothing beside them.
PLAIN = frozenset("a an and the of by on in for to box block wrapper wrap container content section area bar list links link item items inner outer top bottom left right center main primary secondary site page global web app col column row grid panel group unit slot zone space module component form field button buttons btn icon icons text title heading label body message msg policy law count more post posts article story entry blog user users reader readers thread new latest small large fixed sticky mobile desktop js css wp".split())
#: Characters that a doubtful element has at least if it is kept, and the share of links that it doesn't reach.
LEAST_CHARS, MOST_LINKS = 200, 0.25
#: The share of links, and the blocks with links, from which on a container inside the main text is a list of links.
LINK_LIST, LINK_BLOCKS = 0.5, 3
KEPT = frozenset({"html", "body", "article", "main"})
#: Elements that count twice as much as other containers, and are kept but for lists of links.
MAIN = frozenset({"article", "main"})
#: Ancestors that a paragraph passes points to.
LEVELS = 6
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
NAME = re.compile(r"/?[a-zA-Z][^\s/>]*+")
SIGN = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""(?<![^\s/"'])([a-zA-Z-]+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
#: What an open element is ended by, besides its own end tag.
ENDS = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "thead", "tfoot"}, "td": {"td", "th", "tr", "tbody", "thead", "tfoot"}, "th": {"td", "th", "tr", "tbody", "thead", "tfoot"}}
HOLDERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}


#: An element is main text, doubtful, or left out.
MAIN_TEXT, DOUBT, ASIDE = 0, 1, 2


def marked(name: str) -> int:
    """What one name of class or id marks."""
    words = [w.lower() for w in WORDS.findall(name)]
    if not words or words[0] in ("with", "has", "no") or not all(w in MARKS or w in DOUBTFUL or w in PLAIN or w.isdigit() for w in words):
        return MAIN_TEXT
    return ASIDE if any(w in MARKS for w in words) else DOUBT if any(w in DOUBTFUL for w in words) else MAIN_TEXT


def standing(tag: str, attributes: str) -> int:
    """Whether an element is main text, doubtful or left out."""
    if tag in LEFT_OUT:
        return ASIDE
    if tag in KEPT or not attributes.strip(" /"):
        return MAIN_TEXT
    found = MAIN_TEXT
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return ASIDE
        if name == "role" and value.lower() in ROLES:
            return ASIDE
        if name in ("class", "id"):
            found = max(found, *map(marked, value.split()), MAIN_TEXT)
    return found


class Page:
    def __init__(self, source: str) -> None:
        self.tags, self.parents, self.aside, self.doubtful = ["#"], [-1], [False], [False]
        self.blocks: list[tuple[int, str, int]] = []  # node, text, characters in links
        self.stack = [0]
        self.opened: Counter[str] = Counter()
        self.links: list[int] = []  # depth of the stack at which each open link began
        self.parts: list[str] = []
        self.linked = 0
        self.silent = False  # in an element within lines that has no end
        self.endless: set[int] = set()  # places outside of quotes from which no tag ends
        self.read(source)

    def flush(self) -> None:
        self.silent = False
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append((self.stack[-1], text, min(self.linked, len(text))))
            self.parts, self.linked = [], 0

    def text(self, raw: str) -> None:
        if raw and not self.silent and not self.aside[self.stack[-1]]:
            if "&" in raw:
                raw = html.unescape(raw)
            self.parts.append(raw)
            if self.links:
                self.linked += len(raw.strip())

    def open(self, tag: str, attributes: str) -> None:
        self.flush()
        if tag in VOID_BLOCKS:
            return
        for k in range(len(self.stack) - 1, 0, -1):
            was = self.tags[self.stack[k]]
            if was in ENDS and (ENDS[was] is None or tag in ENDS[was]):
                self.cut(k)
                if was != "td" and was != "th":
                    break
            elif was in HOLDERS.get(tag, ()) or was not in ENDS:
                break
        at = self.stack[-1]
        self.tags.append(tag)
        self.parents.append(at)
        stands = standing(tag, attributes)
        self.aside.append(self.aside[at] or stands == ASIDE)
        self.doubtful.append(stands == DOUBT)
        self.stack.append(len(self.tags) - 1)
        self.opened[tag] += 1

    def cut(self, k: int) -> None:
        for node in self.stack[k:]:
            self.opened[self.tags[node]] -= 1
        del self.stack[k:]
        while self.links and self.links[-1] > k:
            self.links.pop()

    def close(self, tag: str) -> None:
        self.flush()
        if not self.opened[tag]:
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.tags[self.stack[k]] == tag:
                self.cut(k)
                return

    def ends(self, s: str, tag: str) -> dict[int, int]:
        """For each element of that name with an end tag: where its start tag begins and its end tag ends."""
        found, opened = {}, []
        for m in re.finditer(rf"<(/?){tag}(?=[\s/>])[^>]*+>?", s, re.I):
            if not m[1]:
                opened.append(m.start())
            elif opened:
                found[opened.pop()] = m.end()
        return found

    def read(self, s: str) -> None:
        at, n = 0, len(s)
        silent: dict[str, dict[int, int]] = {}
        while at < n:
            lt = s.find("<", at)
            if lt < 0:
                self.text(s[at:])
                break
            if lt > at:
                self.text(s[at:lt])
            if s.startswith("<!--", lt):
                end = s.find("-->", lt + 4)
                at = n if end < 0 else end + 3
                continue
            if s.startswith(("<!", "<?"), lt):
                end = s.find(">", lt)
                at = n if end < 0 else end + 1
                continue
            m = NAME.match(s, lt + 1)
            if not m:
                if s.startswith("</", lt):
                    end = s.find(">", lt)
                    at = n if end < 0 else end + 1
                else:
                    self.text("<")
                    at = lt + 1
                continue
            tag = m[0].lower()
            end = self.tag_end(s, m.end())
            if end < 0:  # a quote without an end: the first end of a tag counts
                end = s.find(">", m.end())
                if end < 0:
                    break
            at = end + 1
            if tag[0] == "/":
                tag = tag[1:]
                if tag == "a":
                    if self.links:
                        self.links.pop()
                elif tag in BLOCKS:
                    self.close(tag)
                continue
            if tag in RAW:
                if not s.startswith("/>", end - 1):
                    stop = RAW[tag].search(s, at)
                    if not stop:
                        break
                    end = s.find(">", stop.end())
                    at = n if end < 0 else end + 1
            elif tag in SILENT:
                if tag not in silent:
                    silent[tag] = self.ends(s, tag)
                if (stop := silent[tag].get(lt)) and not WHOLE.search(s, at, stop):
                    at = stop
                elif not s.startswith("/>", end - 1):
                    self.silent = True
            elif tag == "br":
                self.text(" ")
            elif tag == "a":
                self.links.append(len(self.stack))
            elif tag in BLOCKS or tag in VOID_BLOCKS:
                self.open(tag, s[m.end() : end])
        self.flush()

    def tag_end(self, s: str, at: int) -> int:
        """The first `>` behind `at` outside of quotes, -1 if there is none. Places from which none is found are kept, so
        that all tags of a page together are read through once."""
        passed = []
        while at not in self.endless:
            sign = SIGN.search(s, at)
            if sign and sign[0] == ">":
                return sign.start()
            passed.append(at)
            close = s.find(sign[0], sign.end()) if sign else -1
            if close < 0:
                break
            at = close + 1
        self.endless.update(passed)
        return -1

    def main(self) -> list[str]:
        """The blocks of the best container and of the siblings that are kept, in page order."""
        if not self.blocks:
            return []
        n = len(self.tags)
        points, chars, linked, listed, out = [0.0] * n, [0] * n, [0] * n, [0] * n, [False] * n
        for node, text, links in self.blocks:
            chars[node] += len(text)
            linked[node] += links
            listed[node] += links > 0
        for k in range(n - 1, 0, -1):  # an element stands behind its parent
            out[k] = self.doubtful[k] and (chars[k] < LEAST_CHARS or linked[k] >= MOST_LINKS * chars[k])
            if not out[k]:
                chars[self.parents[k]] += chars[k]
                linked[self.parents[k]] += linked[k]
                listed[self.parents[k]] += listed[k]
        for k in range(1, n):
            out[k] = out[k] or out[self.parents[k]]
        for node, text, _ in self.blocks:
            if out[node]:
                continue
            gain = 1 + text.count(",") + text.count("،") + text.count("、") + text.count("，") + min(len(text) // 100, 3)
            base = self.parents[node] if self.tags[node] in PARAGRAPHS and self.parents[node] >= 0 else node
            level = 0
            while base >= 0 and level < LEVELS:
                points[base] += gain if not level else gain / 2 if level == 1 else gain / (3 * level)
                base, level = self.parents[base], level + 1
        density = [a / b if b else 0.0 for a, b in zip(linked, chars, strict=True)]
        score = [0.0 if gone else p * (1 - d) * (2 if t in MAIN else 1) for p, d, t, gone in zip(points, density, self.tags, out, strict=True)]
        best = max(range(n), key=lambda k: (score[k], k))
        up = best
        while up >= 0:
            if self.tags[up] in MAIN:
                best = up
            up = self.parents[up]
        keep = {best}
        for k in range(n):
            if self.parents[k] == self.parents[best] and k != best and not self.aside[k]:
                plain = self.tags[k] == "p" and (chars[k] > 80 and density[k] < 0.25 or chars[k] and not density[k])
                heading = self.tags[k] in ("h1", "h2", "h3") and chars[k] and density[k] < 0.5
                if score[k] >= max(10, score[best] / 5) or (plain or heading) and self.tags[best] not in MAIN:
                    keep.add(k)
        inside = [False] * n
        for k in range(n):
            links = self.tags[k] not in PARAGRAPHS and listed[k] >= LINK_BLOCKS and density[k] >= LINK_LIST
            inside[k] = (k in keep or self.parents[k] >= 0 and inside[self.parents[k]] and not links) and not out[k]
        return [text for node, text, _ in self.blocks if inside[node]]


def extract(source: str | None) -> str:
    return "\n\n".join(Page(source).main()) if source else ""


def _texts(sources: list[str]) -> pa.Array:
    return pa.array([extract(s) for s in sources], pa.string())


def main_text(pages: DataFrame, source: str = "html", text: str = "text") -> DataFrame:
    """All columns of `pages` and `text`. A column of that name is replaced."""
    return pages.withColumn(text, arrow_column(_texts, "string")(F.col(f"`{source}`").cast("string")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = main_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
