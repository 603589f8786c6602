"""Main text of HTML pages by composite text density.

For every element: characters, linked characters, tags and linked tags below it give a
link-adjusted number of characters per tag (CETD, Sun, Song and Liao, 2011).  The element
with the largest sum of its block children's densities holds the article (a bold word inside a long
paragraph is no part of the page's layout); beside the path from the
body to it, an element counts as text if it is at least as dense as the least dense one on
that path.  Menus, notices, forms, comments and the like, known by their tags, roles and class
words, are taken out, but only as far as ``_dropped`` says: densities are measured first.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: the HTML element kinds
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: a start tag of the key closes an open element of the values, up to the nearest element that ends the search
CLOSES = {
    "li": ("li", "ul ol menu"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "tr": ("tr", "table"),
    "td": ("td th", "tr table"),
    "th": ("td th", "tr table"),
    "option": ("option", "select"),
}
NOT_TEXT = frozenset("script style noscript template iframe object embed svg canvas math audio video head title".split())
FORMS = frozenset("form label fieldset".split())
FRAME = frozenset("nav aside footer menu dialog button select textarea input datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar toolbar".split())
COMMENTS = frozenset("comment comments disqus respond".split())
CLASS_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert "
    "sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs footer masthead toolbar share sharing "
    "social related recommended subscribe subscription newsletter signup login popup modal overlay widget pagination pager".split()
)
#: what follows one of these in a class name says what the page has or lacks, not what the element is
ABOUT = frozenset("no not has have with without".split())
#: how far an element's tag, role and class words speak against it
TEXT, DOUBTFUL, FRAMING, NEVER = range(4)
HEADING = ("h1", "h2", "h3", "h4", "h5", "h6")
HOLDERS = ("article", "main")


class _Tree(HTMLParser):
    """Elements as parallel lists; a parent always comes before its children.

    The places of open elements are kept by tag, so no start or end tag looks through the open ones.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.doubt, self.items = ["body"], [-1], [TEXT], [[]]
        self.open = [0]
        self.at: dict[str, list[int]] = {}
        self.blocks = [0]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("html", "body"):
            return
        if tag in BLOCK:
            self._close(("p",), ("button", "table", "td", "th"))
        if tag in CLOSES:
            names, ends = CLOSES[tag]
            self._close(names.split(), ends.split())
        node, above = len(self.tag), self.open[-1]
        self.tag.append(tag)
        self.parent.append(above)
        self.doubt.append(self._doubt(tag, attrs))
        self.items.append([])
        self.items[above].append(node)
        if tag not in VOID:
            self.at.setdefault(tag, []).append(len(self.open))
            if tag in BLOCK:
                self.blocks.append(len(self.open))
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body") or tag in VOID:
            return
        if tag in BLOCK or self._last(tag) > self.blocks[-1]:
            self._close((tag,), ())

    def handle_data(self, data: str) -> None:
        self.items[self.open[-1]].append(data)

    def _last(self, tag: str) -> int:
        """Place of the innermost open element of a tag, 0 if there is none."""
        places = self.at.get(tag)
        return places[-1] if places else 0

    def _close(self, names, ends) -> None:
        """Close the innermost open element of ``names`` with all inside, unless one of ``ends`` is inside of it."""
        k = max(map(self._last, names))
        if not k or any(self._last(x) > k for x in ends):
            return
        for node in self.open[k:]:
            self.at[self.tag[node]].pop()
        del self.open[k:]
        while self.blocks[-1] >= k:
            self.blocks.pop()

    def _doubt(self, tag: str, attrs: list) -> int:
        if tag in NOT_TEXT:
            return NEVER
        if tag in HOLDERS or tag in HEADING:
            return TEXT
        inside = any(map(self._last, HOLDERS))
        if tag in FRAME or (tag == "header" and not inside):
            return FRAMING
        doubt = DOUBTFUL if tag in FORMS else TEXT
        for name, value in attrs:
            if not value or name not in ("class", "id", "role"):
                continue
            words = _name_words(value)
            if words & (ROLES if name == "role" else COMMENTS):
                return FRAMING
            if words & {"form", "alert"} if name == "role" else words & CLASS_WORDS or ("header" in words and not inside):
                doubt = DOUBTFUL
        return doubt


#: what opens a tag, an end tag, a comment or the like
MARKUP = re.compile(r"<[A-Za-z/!?]")


def _closed(html: str) -> str:
    """The page without a tag or comment that its end cuts off: after the last > nothing can close one."""
    cut = MARKUP.search(html, html.rfind(">") + 1)
    return html[: cut.start()] if cut else html


def _name_words(value: str) -> set:
    """The words of class names, each name up to a word like no, has or with."""
    out = set()
    for name in value.split():
        for word in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()):
            if word in ABOUT:
                break
            out.add(word)
    return out


def densities(tag: list, parent: list, chars: list) -> tuple[list[float], list[float]]:
    """(density, sum of the block children's densities) of every element, children before parents.

    ``chars`` are the characters directly in each element.
    """
    n = len(tag)
    linked = [False] * n
    for i in range(1, n):
        linked[i] = tag[i] == "a" or linked[parent[i]]
    c, lc = list(chars), [chars[i] if linked[i] else 0 for i in range(n)]
    t, lt = [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        p = parent[i]
        c[p] += c[i]
        lc[p] += lc[i]
        t[p] += t[i] + 1
        lt[p] += lt[i] + linked[i]
    body = lc[0] / max(1, c[0])
    density, sums = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        if c[i]:
            tags, links, link_tags = max(1, t[i]), max(1, lc[i]), max(1, lt[i])
            base = math.log(c[i] / max(1, c[i] - lc[i]) * lc[i] + body * c[i] + math.e)
            ratio = max(1.0, c[i] / links * tags / link_tags)
            density[i] = c[i] / tags * math.log(ratio) / max(1.0, math.log(base))
        if i and tag[i] in BLOCK:
            sums[parent[i]] += density[i]
    return density, sums


def _inherited(own: list, parent: list) -> list:
    """``own`` or that of any element above."""
    out = list(own)
    for i in range(1, len(out)):
        out[i] = out[i] or out[parent[i]]
    return out


def _below(own: list, parent: list) -> list:
    """Sums of ``own`` over every element and what is below it."""
    out = list(own)
    for i in range(len(out) - 1, 0, -1):
        out[parent[i]] += out[i]
    return out


def _dropped(tree: _Tree, chars: list, never: list) -> tuple[list[bool], list[bool]]:
    """(dropped, doubtful) of every element, without what is inherited.

    Elements that hold an <article> or <main> with text, or more than half of the body's text
    outside links, stay; framing elements (nav, footer, comments ...) do so only if no text of
    an <article> or <main> is outside of them.  Of the others, framing elements are dropped,
    and those with a doubtful class word or a form if they are less dense than the whole body
    or beside the <article> or <main> of a page that has one with text.
    Doubtful ones that are denser stay, but are not text beside the path.
    """
    tag, parent, doubt = tree.tag, tree.parent, tree.doubt
    n = len(tag)
    if not any(doubt):
        return [False] * n, [False] * n
    linked = _inherited([t == "a" for t in tag], parent)
    plain = [0 if linked[i] else chars[i] for i in range(n)]
    share = _below(plain if any(plain) else chars, parent)
    inside = _inherited([t in HOLDERS for t in tag], parent)
    held = _below([c if h else 0 for c, h in zip(chars, inside)], parent)
    filled = _below(chars, parent)
    holds = _below([int(t in HOLDERS and filled[i] > 0) for i, t in enumerate(tag)], parent)
    live = [i for i in range(n) if not never[i]]
    place = {i: k for k, i in enumerate(live)}
    density, _ = densities([tag[i] for i in live], [-1 if i == 0 else place[parent[i]] for i in live], [chars[i] for i in live])
    dropped, doubtful = [False] * n, [False] * n
    for i in live:
        if doubt[i] == TEXT or ((holds[i] or 2 * share[i] > share[0]) and (doubt[i] == DOUBTFUL or held[0] == held[i])):
            continue
        dropped[i] = doubt[i] == FRAMING or density[place[i]] < density[0] or (held[0] > 0 and not inside[i])
        doubtful[i] = not dropped[i]
    return dropped, doubtful


def main_text(html: str) -> str:
    """Blocks of the article joined by a blank line; empty if the page has no text."""
    tree = _Tree()
    tree.feed(_closed(html))
    tree.close()
    tag, parent, items = tree.tag, tree.parent, tree.items
    never = _inherited([d == NEVER for d in tree.doubt], parent)
    chars = [0 if never[i] else sum(len("".join(x.split())) for x in items[i] if isinstance(x, str)) for i in range(len(tag))]
    dropped, doubtful = _dropped(tree, chars, never)
    gone = _inherited([a or b for a, b in zip(never, dropped)], parent)
    live = [i for i in range(len(tag)) if not gone[i]]
    place = {i: k for k, i in enumerate(live)}
    above = [-1 if i == 0 else place[parent[i]] for i in live]
    density, sums = densities([tag[i] for i in live], above, [chars[i] for i in live])
    best = max(range(len(live)), key=lambda k: (sums[k], -k))
    if sums[best] == 0:
        best = 0
    path, k = [], best
    while k >= 0:
        path.append(k)
        k = above[k]
    least, beside = min(density[k] for k in path), set(path[1:])
    chosen = {live[best]} | {
        i for k, i in enumerate(live) if above[k] in beside and k not in beside and k != best and not doubtful[i] and density[k] >= least > 0
    }
    return "\n\n".join(_blocks(tag, items, gone, chosen))


def _blocks(tag: list, items: list, gone: list, chosen: set) -> list[str]:
    """Texts between block edges inside the chosen elements, in page order."""
    out, words = [], []
    stack = [(0, iter(items[0]), 0 in chosen)]
    while stack:
        node, rest, inside = stack[-1]
        for x in rest:
            if isinstance(x, str):
                if inside:
                    words.append(x)
            elif not gone[x]:
                if tag[x] in BLOCK:
                    out.append("".join(words))
                    words = []
                elif tag[x] == "br":
                    words.append(" ")
                stack.append((x, iter(items[x]), inside or x in chosen))
                break
            elif tag[x] in BLOCK:
                out.append("".join(words))
                words = []
        else:
            stack.pop()
            if tag[node] in BLOCK:
                out.append("".join(words))
                words = []
    out.append("".join(words))
    return [b for b in (" ".join(x.split()) for x in out) if b]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``; other columns are not read.

    A null or empty page, or one without text outside its frame, gives an empty text of 0
    characters.  Pages are read whole; repeated rows stay separate rows.
    """

    def per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = pd.Series([main_text(h) if h else "" for h in batch["html"]], dtype=object)
            yield batch[["page_id", "url"]].assign(text=text)

    rows = pages.select(F.col("page_id").cast("string"), "url", F.coalesce("html", F.lit("")).alias("html"))
    found = rows.mapInPandas(per_batch, "page_id string, url string, text string")
    return found.select(F.col("page_id").cast("long").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
