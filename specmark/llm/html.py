"""Main text of web pages by wrappers that are inferred per host as union-free regular expressions.

A page is read once, in time linear in its length, into a tree of blocks; what stands side by side in an element is a
stream of tokens. In each stream, a run of flow content (texts, paragraphs, headings, lists, tables) is a repeated group
of optional items, ``(h2? p? ul?)+``, and tandem repeats of other elements collapse into repeated groups. Pages of one
layout are put together place by place, before the shuffle; a host's layouts are then aligned one after the other with the
wrapper so far, stream by stream, in two steps: what only one side has becomes optional, and texts that differ become
slots, while a text that all pages have in a place is template. The wrapper is thus an expression with nested repeated
and optional groups, text slots and template texts, and no alternatives.

Where a host keeps its article is read off the wrapper: its ``article`` or ``main`` elements if these hold half of the
text in slots, or else the deepest element that holds 70% of it. Each page is matched to its host's wrapper; its text are
all texts in the places of that region and, unless it is such an element, those in slots elsewhere whose texts are the
pages' own: slots whose texts recur on different pages (rotating notices) and template texts are left out there. Pages
that do not match (no wrapper, or no place of the region on the page) fall back on article elements, or else on all blocks.

What can stand inside an article and is none of it goes on every page: menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments, by element, role, class or id.

Wrappers are joined to pages by host: broadcast while all of them are below ``broadcast_bytes``, by a shuffle beyond.

Null and empty pages have an empty text. A null url, or one without a host, is a host of its own. Unclosed and
crossing elements, tags and quotes are tolerated; elements nested deeper than 100 count as their ancestor at that depth,
with all their text. Copies of a page count once in a wrapper; ties between regions go to the first in page order.
Repeated rows are extracted alike, an empty table gives no rows; other columns are unused, whatever their names.
"""

from __future__ import annotations

import json
import pickle
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from functools import reduce
from html import unescape
from itertools import count, groupby

import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specmark.llm.common import bitmap, in_bitmap, materialize

#: A tag whose quoted values may hold anything; every part is possessive, so that it never goes back.
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|(?<=\s)"[^"]*+"|["'=])*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>")
#: One attribute, its value consumed with it; a quoted string without a name is passed over.
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=][^\s"'<>/=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+|"[^"]*+"|'[^']*+'""")
_NAMES = frozenset("class id role hidden aria-hidden itemprop".split())
_DIGITS = re.compile(r"[0-9]+")
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")

#: Elements by their part in a page.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
_DROPPED = frozenset("head nav footer aside form button select option dialog menu svg canvas object audio video map math".split()) | _RAW
_BLOCK = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody tfoot thead tr caption ul".split()
)
_CLOSES_P = _BLOCK - {"html", "body"}
_SPACED = frozenset("br td th".split())
#: Words of class, id and role names that mark what is not the article.
_NOT_ARTICLE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored sponsor promo promotion promoted nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer foot cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments commentlist reply replies respond disqus discussion widget pagination pager toolbar complementary contentinfo search".split()
)
_PAGE_HEAD = frozenset("header masthead topbar banner".split())
_COMMENTS = frozenset("comment reply respond".split())
#: What a name says of an element's surroundings, not of the element.
_AROUND = re.compile(r"\b(?:no|has|with|without|allow)[-_]\w+", re.I)
#: Elements of flow content: a run of them is one repeated group.
_FLOW = frozenset("# p h1 h2 h3 h4 h5 h6 ul ol dl li dt dd blockquote pre table caption thead tbody tfoot tr td th figure figcaption hr address details summary center".split())
_ENDS_ITEM = frozenset("ul ol dl table select html body section article main td th".split())
DEEPEST = 100
#: A slot whose texts recur on other pages in more than this share is rotating.
MOST_RECURRING = 0.05


def _words(value: str) -> set[str]:
    return {w.lower() for w in _WORDS.findall(_AROUND.sub(" ", value))}


class Block:
    """A run of text between block boundaries."""

    __slots__ = ("parts", "article", "text")

    def __init__(self, article: bool):
        self.parts, self.article, self.text = [], article, ""


class Node:
    """An item of an expression: an element, a repeated group of flow content (``+``) or a text (``#``).

    pages: the pages that have it. Of a text: size, the length of all its texts; same, the hashes of texts that all these
    pages have there, with their lengths; src, on a page, its blocks; place, in a wrapper, its number among the texts.
    """

    __slots__ = ("tag", "mark", "kids", "many", "maybe", "article", "pages", "size", "same", "src", "state", "place")

    def __init__(self, tag: str, mark: str = "", article: bool = False):
        self.tag, self.mark, self.article, self.kids = tag, mark, article, []
        self.many = self.maybe = False
        self.pages, self.size, self.same, self.src, self.state, self.place = 1, 0, {}, [], 0, 0

    def __getstate__(self):
        return tuple(getattr(self, a) for a in self.__slots__[:-3])

    def __setstate__(self, state):
        for a, v in zip(self.__slots__, (*state, [], 0, 0)):
            setattr(self, a, v)

    def tags(self) -> set[str]:
        return {t for k in self.kids for t in ([g.tag for g in k.kids] if k.tag == "+" else [k.tag])}


def parse(html: str) -> tuple[list[Block], Node]:
    """The blocks of a page outside of what is dropped, and the tree of its elements, as yet without groups."""
    blocks: list[Block] = []
    root = Node("")
    # open elements: name, node, dropped here or above, in an article; where each name and the blocks among them are
    stack: list[tuple[str, Node, bool, bool]] = [("", root, False, False)]
    places: dict[str, list[int]] = defaultdict(list)
    open_blocks: list[int] = []
    current: Block | None = None
    at, end = 0, len(html)
    tag = _TAG

    def text(piece: str) -> None:
        nonlocal current
        _, node, dropped, article = stack[-1]
        if dropped:
            return
        if current is None:
            if not piece.strip():
                return
            current = Block(article)
            blocks.append(current)
            leaf = Node("#")
            leaf.src = [current]
            node.kids.append(leaf)
        current.parts.append(piece)

    def pop_to(depth: int) -> None:
        nonlocal current
        for name, _, dropped, _ in stack[depth:]:
            places[name].pop()
            if name in _BLOCK or dropped:
                current = None
        del stack[depth:]
        while open_blocks and open_blocks[-1] >= depth:
            open_blocks.pop()

    while at < end:
        start = html.find("<", at)
        if start < 0:
            text(html[at:])
            break
        if start > at:
            text(html[at:start])
        if html.startswith("<!--", start):
            at = html.find("-->", start + 4) + 3
            at = at if at > 2 else end
            continue
        if html.startswith(("<!", "<?"), start):
            at = html.find(">", start) + 1 or end
            continue
        m = tag.match(html, start)
        if m is None and html[start + 1 : start + 2 + (html[start + 1 : start + 2] == "/")].strip("/").isalpha():
            # no end: from here on, a tag ends at the next >, whatever is quoted, if there is one
            tag = _PLAIN_TAG
            m = tag.match(html, start)
            if m is None and html.find(">", start) < 0:
                text(html[start:])
                break
        if m is None:
            text("<")
            at = start + 1
            continue
        at = m.end()
        name = m[2].lower()
        if m[1]:
            if name in _SPACED and current is not None:
                current.parts.append(" ")
            # an inline end tag does not close a block
            if places[name] and (name in _BLOCK or not open_blocks or places[name][-1] > open_blocks[-1]):
                pop_to(places[name][-1])
            continue
        attrs: dict[str, str] = {}
        if m[3]:
            for a in _ATTRIBUTE.finditer(m[3]):
                if a[1] and (key := a[1].lower()) in _NAMES:
                    attrs[key] = a[2] or a[3] or a[4] or ""
        names = _words(attrs.get("class", "") + " " + attrs.get("id", "") + " " + attrs.get("role", "")) if attrs else set()
        if name in _CLOSES_P and open_blocks and stack[open_blocks[-1]][0] == "p":
            pop_to(open_blocks[-1])
        if name in ("li", "tr", "dt", "dd", "option"):
            for depth in reversed(open_blocks[-DEEPEST:] if name != "option" else places["option"][-1:]):
                if stack[depth][0] in _ENDS_ITEM:
                    break
                if stack[depth][0] == name or {stack[depth][0], name} == {"dt", "dd"}:
                    pop_to(depth)
                    break
        _, around, above, in_article = stack[-1]
        own_article = name in ("article", "main") or attrs.get("role", "").lower() in ("main", "article") or attrs.get("itemprop", "") == "articleBody"
        article = in_article or own_article
        dropped = (
            above
            or name in _DROPPED
            or bool(names & (_COMMENTS if name == "article" else _NOT_ARTICLE) and name not in ("html", "body", "main"))
            or (not in_article and (name == "header" or bool(names & _PAGE_HEAD and name not in ("html", "body", "article", "main"))))
            or "hidden" in attrs
            or attrs.get("aria-hidden", "").lower() == "true"
        )
        if name in _BLOCK or dropped and not above:
            current = None
        elif name in _SPACED and current is not None:
            current.parts.append(" ")
        if name in _VOID or m[3].endswith("/") and name not in _BLOCK:
            continue
        if name in _RAW:
            if (found := html.find("</", at)) >= 0:
                stop = _RAW_END[name].search(html, found)
                at = stop.end() if stop else end
            else:
                at = end
            continue
        node = around
        if (name in _BLOCK or dropped) and not above and len(open_blocks) < DEEPEST:
            # without what changes from page to page
            node = Node(name, _DIGITS.sub("0", attrs.get("class") or attrs.get("id") or "") if name not in ("html", "body") else "", own_article and not dropped)
            around.kids.append(node)
        places[name].append(len(stack))
        if name in _BLOCK:
            open_blocks.append(len(stack))
        stack.append((name, node, dropped, article))
    for block in blocks:
        block.text = " ".join(unescape("".join(block.parts)).split())
    return blocks, root


_RAW_END = {name: re.compile(rf"</{name}\b[^>]*+>", re.I) for name in _RAW}


# --- expressions ---
def tree(html: str) -> tuple[list[Block], Node]:
    """The blocks of a page, and its expression."""
    blocks, root = parse(html)
    return blocks, _grouped(root)


def _grouped(node: Node) -> Node:
    if node.tag == "#":
        text = node.src[0].text
        if text:
            key = xxhash.xxh64_intdigest(text)
            node.size, node.same = len(text), {key: len(text)}
        return node
    kids: list[Node] = []
    for flow, run in groupby(map(_grouped, node.kids), lambda k: k.tag in _FLOW):
        if not flow:
            kids += run
            continue
        items: dict[tuple[str, str], Node] = {}
        for k in run:
            items[k.tag, k.mark] = _fold(items[k.tag, k.mark], k) if (k.tag, k.mark) in items else k
        group = Node("+")
        group.many, group.kids = True, [items[k] for k in sorted(items)]
        kids.append(group)
    node.kids = _collapsed(kids)
    return node


def _collapsed(items: list[Node], longest: int = 4) -> list[Node]:
    """Tandem repeats of up to ``longest`` elements of one shape as repeated groups."""
    shape = lambda k: (k.tag, k.mark, frozenset(k.tags()))
    shapes = [shape(k) for k in items]
    for period in range(1, min(longest, len(items) // 2) + 1):
        out: list[Node] = []
        known: list[tuple] = []
        for item, its in zip(items, shapes):
            out.append(item)
            known.append(its)
            while len(out) >= 2 * period and known[-period:] == known[-2 * period : -period] and all(k.tag != "+" for k in out[-period:]):
                for a, b in zip(out[-2 * period : -period], out[-period:]):
                    _fold(a, b).many = True
                del out[-period:], known[-period:]
        items, shapes = out, known
    return items


def _fold(a: Node, b: Node) -> Node:
    """Two items of one page as one repeated item."""
    a.many = True
    a.size += b.size
    a.same |= b.same
    a.src += b.src
    a.article |= b.article
    a.kids = _merged(a, b, _fold)
    return a


def _join(a: Node, b: Node) -> Node:
    """An item of two sets of pages: texts that they share stay template, the rest is a slot."""
    a.size += b.size
    a.pages += b.pages
    a.same = {k: n for k, n in a.same.items() if k in b.same}
    a.many, a.maybe, a.article = a.many or b.many, a.maybe or b.maybe, a.article or b.article
    a.kids = _merged(a, b, _join)
    return a


def _merged(a: Node, b: Node, join) -> list[Node]:
    if not a.kids and not b.kids:
        return a.kids
    if a.tag == "+":
        items = {(k.tag, k.mark): k for k in a.kids}
        for k in b.kids:
            items[k.tag, k.mark] = join(items[k.tag, k.mark], k) if (k.tag, k.mark) in items else k
        return [items[k] for k in sorted(items)]
    out: list[Node] = []
    for x, y in align(a.kids, b.kids):
        if x is None or y is None:
            (x or y).maybe = True
            out.append(x or y)
        else:
            out.append(join(x, y))
    return out


#: Pairs of unlike siblings that are compared each with each. Longer streams are cut at shapes that both have once, and what is
#: still longer between two cuts is compared along its diagonal only.
MOST_PAIRS = 40_000

_Pairs = list[tuple[Node | None, Node | None]]


class _Likeness:
    """How alike two elements are, each pair of shapes being compared once."""

    def __init__(self):
        self.known: dict[tuple, float] = {}

    def __call__(self, a: tuple, b: tuple) -> float:
        if a[0] != b[0]:
            return 0.0
        if (a, b) not in self.known:
            s, t = a[2], b[2]
            self.known[a, b] = 1.0 + (a[1] == b[1]) + 2.0 * (len(s & t) / len(s | t) if s or t else 1.0)
        return self.known[a, b]


def _aligned_by_likeness(x: list[Node], y: list[Node], p: list[tuple], q: list[tuple], likeness: _Likeness) -> _Pairs:
    """In order, with the greatest likeness (Needleman & Wunsch, 1970); beyond MOST_PAIRS only near the diagonal."""
    n, m = len(x), len(y)
    reach = m if n * m <= MOST_PAIRS else max(8, MOST_PAIRS // (2 * max(n, m)))
    low = [max(0, min(m, i * m // max(n, 1) - reach)) for i in range(n + 1)]
    high = [min(m, i * m // max(n, 1) + reach) for i in range(n + 1)]
    best = [[0.0] * (h - lo + 1) for lo, h in zip(low, high)]
    at = lambda i, j: best[i][j - low[i]] if low[i] <= j <= high[i] else 0.0
    own = lambda i, j: likeness(p[i], q[j])
    for i in range(n - 1, -1, -1):
        row = best[i]
        for j in range(high[i], low[i] - 1, -1):
            most = at(i + 1, j)
            if j < m:
                most = max(most, at(i, j + 1))
                if alike := own(i, j):
                    most = max(most, alike + at(i + 1, j + 1))
            row[j - low[i]] = most
    pairs: _Pairs = []
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and (alike := own(i, j)) and at(i, j) == alike + at(i + 1, j + 1) and low[i] <= j <= high[i]:
            pairs.append((x[i], y[j]))
            i, j = i + 1, j + 1
        elif j == m or i < n and at(i, j) == at(i + 1, j) and j <= high[i]:
            pairs.append((x[i], None))
            i += 1
        else:
            pairs.append((None, y[j]))
            j += 1
    return pairs


def _anchors(p: list[tuple], q: list[tuple]) -> list[tuple[int, int]]:
    """The longest rising run of places of shapes that both streams have once."""
    once = lambda shapes: {s: i for i, s in enumerate(shapes) if counts[s] == 1}
    counts = Counter(p)
    first = once(p)
    counts = Counter(q)
    second = once(q)
    places = [(i, second[s]) for s, i in first.items() if s in second]
    ends: list[int] = []  # the least end of a run of each length
    of_end: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(places):
        at = bisect_left(ends, j)
        ends[at : at + 1] = [j]
        of_end[at : at + 1] = [k]
        before.append(of_end[at - 1] if at else -1)
    run, k = [], of_end[-1] if of_end else -1
    while k >= 0:
        run.append(places[k])
        k = before[k]
    return run[::-1]


def align(a: list[Node], b: list[Node]) -> _Pairs:
    """The streams side by side, in order. Equal elements at both ends, and with many between them those at anchors, are paired
    first; what lies between is aligned by likeness, so that the time is near to linear in long streams."""
    shape = lambda k: (k.tag, k.mark, frozenset(k.tags()))
    p, q = list(map(shape, a)), list(map(shape, b))
    head = tail = 0
    while head < min(len(a), len(b)) and p[head] == q[head]:
        head += 1
    while tail < min(len(a), len(b)) - head and p[-1 - tail] == q[-1 - tail]:
        tail += 1
    likeness, pairs = _Likeness(), list(zip(a[:head], b[:head]))
    n, m = len(a) - tail, len(b) - tail
    cuts = [(head + i, head + j) for i, j in _anchors(p[head:n], q[head:m])] if (n - head) * (m - head) > MOST_PAIRS else []
    i, j = head, head
    for cut_i, cut_j in [*cuts, (n, m)]:
        pairs += _aligned_by_likeness(a[i:cut_i], b[j:cut_j], p[i:cut_i], q[j:cut_j], likeness)
        if cut_i < n and cut_j < m:
            pairs.append((a[cut_i], b[cut_j]))
        i, j = cut_i + 1, cut_j + 1
    return pairs + list(zip(a[len(a) - tail :], b[len(b) - tail :]))


def expression(node: Node) -> str:
    """The expression in writing; equal for pages of one layout. All items of a group of flow content are optional."""
    if node.tag == "+":
        return f"({''.join(_element(k) + '?' for k in node.kids)})+" + ("?" if node.maybe else "")
    return _element(node) + ("+" if node.many else "") + ("?" if node.maybe else "")


def _element(node: Node) -> str:
    return "#" if node.tag == "#" else f"<{node.tag}{'.' + node.mark if node.mark else ''}>{''.join(map(expression, node.kids))}</>"


# --- wrappers ---
def _gather(layouts: dict[str, Node], wrapper: Node) -> int:
    """Add a wrapper to those by layout, in place, no alignment being needed where it is the same; the layouts added."""
    key = expression(wrapper)
    if key in layouts:
        _join(layouts[key], wrapper)
        return 0
    layouts[key] = wrapper
    return 1


def _aligned(layouts: dict[str, Node]) -> Node:
    return reduce(_join, (layouts[k] for k in sorted(layouts)))


#: Pages that share all but this share of their text are near copies, of which none is template.
NEAR_COPIES = 0.2


def _size(node: Node) -> int:
    return node.size if node.tag == "#" else sum(map(_size, node.kids))


#: What is no region of a page.
_WHOLE = frozenset(("", "html", "body"))
#: States of an item: a slot, one whose texts rotate, and the region.
_SLOT, _ROTATING, _REGION = 0, 1, 2


def conclude(root: Node) -> list:
    """The wrapper as it goes to the pages: [tag, mark, state, template texts, items] of each item, nested.

    A text is template if all pages with its place have it there: two of them at least, and half of the pages that have
    the element around it. Pages that are near copies of one another tell nothing of a template. Slots of more than three pages
    are said to rotate until their texts are counted (``settled``).
    """
    held: dict[int, int] = {}

    def weigh(node: Node, around: int) -> int:
        if node.tag == "#":
            template = node.pages > 1 and 2 * node.pages >= around
            node.same = node.same if template else {}
            node.state = _ROTATING if node.pages > 3 else _SLOT
            held[id(node)] = max(0, node.size - node.pages * sum(node.same.values()))
        else:
            held[id(node)] = sum(weigh(k, node.pages if node.tag != "+" else around) for k in node.kids)
        return held[id(node)]

    def forget(node: Node) -> int:
        node.same = {}
        held[id(node)] = node.size if node.tag == "#" else sum(map(forget, node.kids))
        return held[id(node)]

    total = weigh(root, root.pages)
    if total < NEAR_COPIES * _size(root):
        total = forget(root)

    def deepest(node: Node) -> Node:
        inner = [k for k in node.kids if k.tag not in _FLOW and k.tag != "+" and 10 * held[id(k)] >= 7 * total]
        return deepest(inner[0]) if inner else node

    def articles(node: Node) -> list[Node]:
        return [node] if node.article else [x for k in node.kids for x in articles(k)]

    if total:
        regions = articles(root)
        if 2 * sum(held[id(k)] for k in regions) < total:
            regions = [deepest(root)]
        for region in regions:
            region.state = _REGION

    def written(node: Node) -> list:
        return [node.tag, node.mark + ("\n" if node.article else ""), node.state, sorted(node.same), [written(k) for k in node.kids]]

    return written(root)


def read_wrapper(written: list) -> Node:
    places = count()

    def read(written: list) -> Node:
        node = Node(written[0], written[1].rstrip("\n"), written[1].endswith("\n"))
        node.state, node.same, node.place = written[2], dict.fromkeys(written[3]), next(places) if written[0] == "#" else 0
        node.kids = [read(k) for k in written[4]]
        return node

    return read(written)


def settled(written: list, rotating: set[int]) -> list:
    """The wrapper of ``conclude`` once the texts are counted: of its texts, those of these places rotate."""
    places = count()

    def settle(w: list) -> list:
        state = _SLOT if w[0] == "#" and next(places) not in rotating and w[2] == _ROTATING else w[2]
        return [*w[:2], state, w[3], [settle(k) for k in w[4]]]

    return settle(written)


def undecided(wrapper: Node) -> bool:
    """Whether there is a slot outside the region whose texts must be counted."""
    return wrapper.state != _REGION and (wrapper.state == _ROTATING or any(map(undecided, wrapper.kids)))


def slot_texts(html: str, wrapper: Node) -> set[tuple[int, int]]:
    """The page's texts outside the region, by place and hash."""
    slots: set[tuple[int, int]] = set()
    _match(wrapper, tree(html)[1], "", {}, slots)
    return slots


def rotates(recurring, every):
    """Whether a slot rotates: on how many pages its texts are that are on more than one, and on how many all of them are."""
    return recurring > MOST_RECURRING * every


def infer(pages: list[str]) -> Node:
    """The wrapper of a host with these pages; copies of a page say nothing of what is template."""
    layouts: dict[str, Node] = {}
    different = list(dict.fromkeys(pages))
    for page in different:
        _gather(layouts, tree(page)[1])
    written = conclude(_aligned(layouts) if layouts else Node(""))
    wrapper = read_wrapper(written)
    on = Counter(x for page in different for x in slot_texts(page, wrapper))
    recurring, every = Counter(), Counter()
    for (place, _), n in on.items():
        every[place] += n
        recurring[place] += n if n > 1 else 0
    return read_wrapper(settled(written, {p for p in every if rotates(recurring[p], every[p])}))


def _match(wrapper: Node, page: Node, inside: str, found: dict[int, tuple[str, bool]], slots: set | None = None) -> bool:
    """Note for each block that has a place in the wrapper: in the region (article, region or none), and whether to leave it
    out; in slots, the texts that have to be counted; whether the region was met."""
    met = wrapper.state == _REGION and page.tag != "#"
    if met and wrapper.tag not in _WHOLE:
        inside = "article" if wrapper.article else "region"
    if page.tag == "#":
        for block in page.src:
            key = xxhash.xxh64_intdigest(block.text)
            template = key in wrapper.same
            if slots is not None and block.text and wrapper.state == _ROTATING and not inside:
                slots.add((wrapper.place, key))
            found[id(block)] = inside, template or wrapper.state == _ROTATING and not inside
    elif wrapper.tag == "+":
        items = {(k.tag, k.mark): k for k in wrapper.kids}
        for k in page.kids:
            known = items.get((k.tag, k.mark))
            met |= _match(known, k, inside, found, slots) if known else _unknown(k, inside, found)
    else:
        for x, y in align(wrapper.kids, page.kids):
            if y is not None:
                met |= _match(x, y, inside, found, slots) if x is not None else _unknown(y, inside, found)
    return met


def _unknown(page: Node, inside: str, found: dict[int, tuple[str, bool]]) -> bool:
    for block in page.src:
        found[id(block)] = inside, False
    for k in page.kids:
        _unknown(k, inside, found)
    return False


def extract_by(html: str | None, wrapper: Node | None) -> tuple[str, bool]:
    """The text, and whether it came through the wrapper."""
    blocks, page = tree(html or "")
    blocks = [b for b in blocks if b.text]
    found: dict[int, tuple[str, bool]] = {}
    met = wrapper is not None and _match(wrapper, page, "", found)
    chosen: list[Block] = []
    if met:
        article = any(inside == "article" for inside, _ in found.values())
        # semantic elements hold the whole article
        chosen = [b for b in blocks if found[id(b)][0] or not article and not found[id(b)][1]]
        size = lambda bs: sum(len(b.text) for b in bs)
        marked = [b for b in blocks if b.article]
        met = bool(chosen) and 2 * size(b for b in marked if found[id(b)][0]) >= size(marked)
    if not met:
        chosen = [b for b in blocks if b.article] or [b for b in blocks if not found.get(id(b), ("", False))[1]]
        if not any(b.article for b in blocks) and 2 * sum(len(b.text) for b in chosen) < sum(len(b.text) for b in blocks):
            chosen = blocks
    return "\n\n".join(b.text for b in chosen), met


def extract(html: str | None, wrapper: Node | None) -> str:
    return extract_by(html, wrapper)[0]


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


_PARTIAL = "_w_host string, _w_layout long, _w_partial binary"
#: Items that a task holds before it sends on what it has.
_HELD_ITEMS = 200_000


def _partial_batch(rows: list[tuple]) -> pa.RecordBatch:
    hosts, layouts, partials = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(hosts, pa.string()), pa.array(layouts, pa.int64()), pa.array(partials, pa.binary())], names=["_w_host", "_w_layout", "_w_partial"]
    )


def _read_batches(copied=None):
    """Pages (host, html, key) to a wrapper for each host and layout; without those whose key may be copied, where that is told."""

    def run(batches):
        held: dict[str, dict] = {}
        n_items = 0

        def send():
            rows = [(host, xxhash.xxh32_intdigest(k), pickle.dumps(w)) for host, layouts in held.items() for k, w in layouts.items()]
            for at in range(0, len(rows), 1000):
                yield _partial_batch(rows[at : at + 1000])

        for batch in batches:
            for host, html in zip(*(c.to_pylist() for c in _by_key(batch, copied, False).columns[:2])):
                blocks, wrapper = tree(html)
                if _gather(held.setdefault(host, {}), wrapper):
                    n_items += len(blocks) + 20
                if n_items > _HELD_ITEMS:
                    yield from send()
                    held.clear()
                    n_items = 0
        yield from send()

    return run


def _by_key(batch: pa.RecordBatch, copied, wanted: bool) -> pa.RecordBatch:
    if copied is None:
        return batch
    hit = in_bitmap(copied.value, batch.column(2).to_numpy())
    return batch.filter(pa.array(hit if wanted else ~hit))


def _by_host(batches):
    """(host, rows) of rows sorted by host."""
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
    return groupby(rows, key=lambda r: r[0])


def _align_batches(batches):
    """The aligned wrapper of a host's rows, which come sorted by layout, so that what is held is that wrapper and one layout."""
    for host, rows in _by_host(batches):
        whole = None
        for _, same in groupby(rows, key=lambda r: r[1]):
            layouts: dict = {}
            for _, _, partial in same:
                _gather(layouts, pickle.loads(partial))
            one = _aligned(layouts)
            whole = one if whole is None else _join(whole, one)
        yield _partial_batch([(host, 0, pickle.dumps(whole))])


def _conclude_batches(batches):
    for host, rows in _by_host(batches):
        layouts: dict = {}
        for _, _, partial in rows:
            _gather(layouts, pickle.loads(partial))
        yield pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([json.dumps(conclude(_aligned(layouts)))], pa.string())], names=["_w_host", "_w_wrapper"])


def _different(pages: DataFrame, bits: int) -> tuple[DataFrame, Broadcast, DataFrame]:
    """Pages (_w_host, html, _w_key); a bitmap of the keys that occur again (or share a bit with one that does); and one page for
    each of these, a task sending each key once."""
    keyed = pages.select(host_of(F.col("url")).alias("_w_host"), F.col("html").cast("string").alias("html")).filter("html IS NOT NULL")
    hashed = keyed.withColumn("_w_key", F.xxhash64("_w_host", "html"))
    again = hashed.groupBy("_w_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_w_key")
    copied = pages.sparkSession.sparkContext.broadcast(bitmap(again, bits))

    def some(batches):
        for batch in batches:
            yield _by_key(batch, copied, True)

    once = hashed.mapInArrow(some, "_w_host string, html string, _w_key long").groupBy("_w_host", "_w_key").agg(F.first("html").alias("html"))
    return hashed, copied, materialize(once.select("_w_host", "html", "_w_key"), "pages-once")


def _slot_batches(copied=None):
    """Pages (host, html, key, wrapper) to the texts of slots outside the region, as often as they are on different pages."""

    def run(batches):
        known = _Wrappers()
        for batch in batches:
            on: Counter = Counter()
            for host, html, _, key in zip(*_by_key(batch, copied, False).columns):
                wrapper = known[key.as_py()]
                if wrapper is not None and undecided(wrapper):
                    h = host.as_py()
                    on.update((h, place, text) for place, text in slot_texts(html.as_py(), wrapper))
            hosts, places, texts = zip(*on) if on else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(places, pa.int32()), pa.array(texts, pa.uint64()).view(pa.int64()), pa.array(list(on.values()), pa.int64())],
                names=["host", "place", "key", "n"],
            )

    return run


def _settle_batches(batches):
    for batch in batches:
        hosts, wrappers, rotating = (c.to_pylist() for c in batch.columns)
        out = [json.dumps(settled(json.loads(w), set(r or ()))) for w, r in zip(wrappers, rotating)]
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(out, pa.string())], names=["_w_host", "_w_wrapper"])


def _beside(wrappers: DataFrame, broadcast_bytes: int) -> DataFrame:
    """Written wrappers as they are joined to pages."""
    size = wrappers.agg(F.sum(F.octet_length("_w_wrapper"))).first()[0] or 0
    return F.broadcast(wrappers) if size <= broadcast_bytes else wrappers


def infer_wrappers(pages: DataFrame, salts: int = 64, bits: int = 1 << 24, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """One row per host: _w_host, _w_wrapper (JSON).

    All different pages are read where they lie, a hot host's in many tasks. Pages whose key occurs again (or shares a bit with
    one that does, in a bitmap of ``bits``) are first brought down to one for each key, a task sending each key once. The
    layouts of a host are aligned in two steps, so that its last task sees salts wrappers. All texts of slots outside the region
    are then counted, on all different pages.
    """
    hashed, copied, once = _different(pages, bits)
    partial = hashed.mapInArrow(_read_batches(copied), _PARTIAL).unionByName(once.mapInArrow(_read_batches(), _PARTIAL))
    salt = F.pmod("_w_layout", F.lit(salts))
    salted = partial.repartition("_w_host", salt).sortWithinPartitions("_w_host", "_w_layout")
    aligned = salted.mapInArrow(_align_batches, _PARTIAL).repartition("_w_host").sortWithinPartitions("_w_host")
    wrappers = materialize(aligned.mapInArrow(_conclude_batches, "_w_host string, _w_wrapper string"), "wrappers")
    side = _beside(wrappers, broadcast_bytes)
    slots = "host string, place int, key long, n long"
    counted = hashed.join(side, "_w_host").select("_w_host", "html", "_w_key", "_w_wrapper").mapInArrow(_slot_batches(copied), slots)
    counted = counted.unionByName(once.join(side, "_w_host").select("_w_host", "html", "_w_key", "_w_wrapper").mapInArrow(_slot_batches(), slots))
    on = counted.groupBy("host", "place", "key").agg(F.sum("n").alias("n"))
    shares = on.groupBy("host", "place").agg(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("recurring"), F.sum("n").alias("every"))
    rotating = shares.filter(rotates(F.col("recurring"), F.col("every"))).groupBy("host").agg(F.collect_list("place").alias("places"))
    told = wrappers.join(rotating, F.col("_w_host") == F.col("host"), "left").select("_w_host", "_w_wrapper", "places")
    return told.mapInArrow(_settle_batches, "_w_host string, _w_wrapper string")


class _Wrappers(dict):
    """Read wrappers by their writing, as many as a task may hold."""

    def __missing__(self, key: str | None) -> Node | None:
        if len(self) > 1000:
            self.clear()
        self[key] = None if key is None else read_wrapper(json.loads(key))
        return self[key]


def _extract_batches(batches):
    known = _Wrappers()
    for batch in batches:
        texts, ways = [], []
        for html, wrapper in zip(batch.column(2), batch.column(3)):
            text, by_wrapper = extract_by(html.as_py(), known[wrapper.as_py()])
            texts.append(text)
            ways.append(by_wrapper)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()), pa.array(ways, pa.bool_())],
            names=["page_id", "url", "text", "n_chars", "by_wrapper"],
        )


def extract_pages(pages: DataFrame, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, by_wrapper (whether the text came through its host's wrapper)."""
    side = _beside(materialize(infer_wrappers(pages, broadcast_bytes=broadcast_bytes), "wrappers-settled"), broadcast_bytes)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), host_of(F.col("url")).alias("_host"))
    joined = rows.join(side, F.col("_host") == F.col("_w_host"), "left").select("page_id", "url", "html", "_w_wrapper")
    return joined.mapInArrow(_extract_batches, "page_id long, url string, text string, n_chars long, by_wrapper boolean")
