"""The main text of web pages by scores on the tree of a page's elements."""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.llm.batches import map_batches, text_slices, texts

# Element names of HTML and the words by which pages name their parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main menu nav ol option p plaintext pre search section select summary "
    "table tbody td template tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre li dd dt td th blockquote figcaption caption summary".split())
#: Elements that never hold the main text.
NEVER = frozenset(
    "script style title textarea xmp iframe noembed noframes noscript template head nav footer aside form button select option menu dialog search "
    "svg math canvas video audio object applet datalist fieldset".split()
)
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist".split())
#: What closes an open element of the same kind: siblings that may leave out their end tags.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "thead": ("thead", "tbody", "tfoot"), "tbody": ("thead", "tbody", "tfoot"), "tfoot": ("thead", "tbody", "tfoot"),
}
#: Where looking for an element to close ends.
WALLS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}
#: Words in classes and ids of menus, notices, adverts, forms and reader comments.
ASIDE_WORDS = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promotion banner breadcrumb breadcrumbs "
    "comment comments commentlist commentary disqus reply replies respond cookie cookies consent gdpr notice notices notification alert popup modal "
    "overlay newsletter subscribe subscription signup signin login register share sharing social follow related recommended recommendations trending "
    "popular teaser sidebar rail widget widgets nav navbar navigation menu menubar toolbar topbar masthead header footer pager pagination form".split()
)
HEADER_WORDS = frozenset("header masthead".split())
TEXT_WORDS = frozenset("article content body post entry story text main".split())
NEUTRAL_WORDS = frozenset("has with no without".split())
COMMAS = re.compile("[,،、，﹐︐]")

_START = re.compile(r"""<([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|))*+)>""")
_ATTRIBUTE = re.compile(
    r"""(?<![^\s"'/])(class|id|role|hidden|style|aria-hidden|itemprop)(?![^\s=/>])(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?""", re.I
)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}

#: How sure it is that an element isn't part of the text: not at all, by names that its author gave, by what it is.
TEXT, BY_NAME, BY_KIND = 0, 1, 2


class Page:
    """A page's elements as arrays, numbered in page order, and its blocks of text. Scripts, comments and other hidden parts leave no blocks."""

    def __init__(self, html: str) -> None:
        self.tag, self.parent, self.level, self.weight = [""], [-1], [TEXT], [0]
        self.headings_only = [False]  # of a header inside the main text
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters inside links
        self._stack, self._open = [0], {}  # open elements; by name, their places in the stack
        self._block_places: list[int] = []
        self._links = 0
        self._pieces: list[tuple[str, bool]] = []
        self._read(html)
        self._end_block()

    def _read(self, html: str) -> None:
        at, size = 0, len(html)
        while at < size:
            mark = html.find("<", at)
            if mark < 0:
                mark = size
            if mark > at:
                self._pieces.append((unescape(html[at:mark]), self._links > 0))
            if mark == size:
                return
            kind = html[mark + 1 : mark + 2]
            if kind.isascii() and kind.isalpha():
                tag = _START.match(html, mark)
                if tag is None:
                    return  # a tag without an end
                name = tag[1].lower()
                at = tag.end()
                self._start(name, tag[2])
                if name in RAW:
                    end = _RAW_END[name].search(html, at)
                    at = end.start() if end else size
            elif html.startswith("<!--", mark):
                end = html.find("-->", mark + 2)
                at = end + 3 if end >= 0 else size
            elif kind in ("/", "!", "?") and kind:
                end = html.find(">", mark)
                at = end + 1 if end >= 0 else size
                name = html[mark + 2 : at - 1].split(None, 1)
                if kind == "/" and name:
                    self._end(name[0].lower())
            else:
                self._pieces.append(("<", self._links > 0))
                at = mark + 1

    def _start(self, name: str, attributes: str) -> None:
        if name == "br":
            self._pieces.append((" ", False))
        if name in VOID:
            if name == "hr":
                self._end_block()
            return
        if name in BLOCK:
            self._end_block()
            self._close("p", ("td", "th", "table", "button", "object"))
            self._close_same(name)
        node = len(self.tag)
        above = self._stack[-1]
        self.tag.append(name)
        self.parent.append(above)
        level, weight, headings = self._judge(name, attributes)
        self.level.append(max(level, self.level[above]))
        self.weight.append(weight)
        self.headings_only.append(headings or self.headings_only[above])
        self._open.setdefault(name, []).append(len(self._stack))
        if name in BLOCK:
            self._block_places.append(len(self._stack))
        self._stack.append(node)
        self._links += name == "a"

    def _close_same(self, name: str) -> None:
        for other in CLOSES.get(name, ()):
            self._close(other, WALLS.get(name, ("table",)))

    def _close(self, name: str, walls: tuple[str, ...]) -> None:
        """End the innermost open element of a name, unless a wall stands inside it."""
        places = self._open.get(name)
        if places and all(self._open[w][-1] < places[-1] for w in walls if self._open.get(w)):
            self._pop(places[-1])

    def _end(self, name: str) -> None:
        if name in BLOCK:
            self._end_block()
            self._close(name, () if name == "table" else ("table",) if name in ("li", "p", "div") else ())
        elif places := self._open.get(name):
            if not self._block_places or self._block_places[-1] < places[-1]:  # an inline end tag doesn't reach over a block
                self._pop(places[-1])

    def _pop(self, place: int) -> None:
        if self._block_places and self._block_places[-1] >= place:
            self._end_block()
        while self._block_places and self._block_places[-1] >= place:
            self._block_places.pop()
        for node in self._stack[place:]:
            name = self.tag[node]
            self._open[name].pop()
            self._links -= name == "a"
        del self._stack[place:]

    def _end_block(self) -> None:
        if not self._pieces:
            return
        pieces, self._pieces = self._pieces, []
        node = self._stack[-1]
        if self.level[node] == BY_KIND:
            return
        text = " ".join("".join(p for p, _ in pieces).split())
        if text:
            while self.tag[node] not in BLOCK and node:
                node = self.parent[node]
            self.blocks.append((node, text, sum(len(p.strip()) for p, inside in pieces if inside)))

    def _judge(self, name: str, attributes: str) -> tuple[int, int, bool]:
        """The level of an element by itself, the weight of its names, and whether only its headings are text."""
        found = {}
        if attributes:
            for m in _ATTRIBUTE.finditer(attributes):
                found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        inside = bool(self._open.get("article") or self._open.get("main"))
        if name in NEVER or found.get("role", "").lower() in NEVER_ROLES or "hidden" in found or found.get("aria-hidden") == "true":
            return BY_KIND, 0, False
        if name == "header":
            return (TEXT, 0, True) if inside else (BY_KIND, 0, False)
        if "display:none" in found.get("style", "").replace(" ", "").lower() or found.get("itemprop", "").lower() == "comment":
            return BY_KIND, 0, False
        if name in ("html", "body", "main") or name in HEADINGS:
            return TEXT, 0, False
        weight = 0
        for one in f"{found.get('class', '')} {found.get('id', '')}".split():
            words = {w.lower() for w in _WORD.findall(one)}
            if words & NEUTRAL_WORDS:
                continue
            if bad := words & ASIDE_WORDS:
                if bad <= HEADER_WORDS and (inside or words & TEXT_WORDS):
                    return TEXT, 0, True
                return BY_NAME, 0, False
            weight += bool(words & TEXT_WORDS)
        return TEXT, weight, False


def main_blocks(html: str) -> list[str]:
    """The blocks of a page's main text in page order.

    Every paragraph passes points for itself, its commas and its length to the element around it, half of them to the next one, and smaller parts to
    three more; an element's points are discounted by the share of its text inside links. The element with the most points (the first of equals)
    is taken, or the article or main element around it, with the siblings that hold text like it."""
    page = Page(html)
    for most in (TEXT, BY_NAME):  # names may mislead: a page without any text besides gets a second look
        blocks = [b for b in page.blocks if page.level[b[0]] <= most and (page.tag[b[0]] in HEADINGS or not page.headings_only[b[0]])]
        if blocks:
            return _best(page, blocks)
    return []


def _best(page: Page, blocks: list[tuple[int, str, int]]) -> list[str]:
    n = len(page.tag)
    points, size, linked, links = [0.0] * n, [0] * n, [0] * n, [0] * n
    for node, text, inside in blocks:
        size[node] += len(text)
        linked[node] += inside
        links[node] += inside > 0
        if page.tag[node] in HEADINGS:
            continue
        gain = (1 + len(COMMAS.findall(text)) + min(len(text) / 100, 3)) if len(text) >= 25 else len(text) / 100
        at = page.parent[node] if page.tag[node] in PARAGRAPHS else node
        for share in (1, 1 / 2, 1 / 6, 1 / 9, 1 / 12):
            if at < 0:
                break
            points[at] += gain * share
            at = page.parent[at]
    for node in range(n - 1, 0, -1):  # an element's number is larger than its parent's
        for values in (size, linked, links):
            values[page.parent[node]] += values[node]
    density = [a / b if b else 0.0 for a, b in zip(linked, size, strict=True)]
    score = [(p + 2 * w if p else 0.0) * (1 - min(d, 1)) for p, w, d in zip(points, page.weight, density, strict=True)]
    best = max(range(n), key=lambda i: (score[i], -i))
    above = [best]
    while page.parent[above[-1]] >= 0:
        above.append(page.parent[above[-1]])
    tags = [page.tag[i] for i in above]
    whole = len(tags) - 1 - tags[::-1].index("article") if "article" in tags else tags.index("main") if "main" in tags else 0
    top = above[whole]
    kept = {top}
    least = max(10.0, score[best] / 5)
    on_path, around = set(above), set(above[whole + 1 :])  # around: what holds siblings, the nearest ones and those further out
    paragraphs: dict[int, list[tuple[str, int]]] = {}
    for node, text, inside in blocks:
        paragraphs.setdefault(node, []).append((text, inside))
    for node in range(1, n):
        if page.parent[node] not in around or node in on_path or not size[node]:
            continue
        tag = page.tag[node]
        if tag == "h1" or (score[node] >= least and density[node] < 0.5):
            kept.add(node)
        elif tag == "p" and tags[whole] not in ("article", "main", "body") and page.parent[node] == page.parent[top]:
            if density[node] < 0.25 and (size[node] >= 80 or (not linked[node] and paragraphs[node][-1][0][-1:] in ".!?…")):
                kept.add(node)
    # lists, tables and boxes that are mostly links are menus
    state = [False] * n
    for node in range(n):
        menu = page.tag[node] in ("ul", "ol", "dl", "div", "section", "table") and links[node] > 1 and density[node] > 0.5 and node not in on_path
        state[node] = not menu and (node in kept or (node > 0 and state[page.parent[node]]))
    return [text for node, text, _ in blocks if state[node]]


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Rows ``(<page_id>, <url>, blocks array<string>, text, n_chars)``, one for each row of ``pages``: the blocks of a page's main text (see
    ``main_blocks``), those blocks joined by two newlines, and its code points.

    A null or empty page, and one without text, has no blocks and the empty text. Repeated rows give repeated results, an empty table no rows; ids and urls
    are only passed on, null or not, and other columns are not looked at. Pages are read whole, in time linear in their length; nothing is shuffled.
    """
    names = {"key": page_id, "url": url}
    rows = pages.select(F.col(page_id).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"))
    schema = StructType([*rows.drop("html").schema.fields, *StructType.fromDDL("blocks array<string>").fields])

    def run(batches):
        for part in text_slices(batches, "html"):
            found = [main_blocks(page) for page in texts(part.column("html"))]
            sizes = np.concatenate([[0], np.cumsum([len(b) for b in found])]).astype(np.int32)
            flat = pa.array([text for blocks in found for text in blocks], pa.string())
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("url"), pa.ListArray.from_arrays(pa.array(sizes), flat)], names=schema.names)

    found = map_batches(rows, run, schema).withColumn("text", F.array_join("blocks", "\n\n"))
    return found.select(
        *[F.col(k).alias(v) for k, v in names.items()], "blocks", "text", F.char_length("text").cast("long").alias("n_chars")
    )
