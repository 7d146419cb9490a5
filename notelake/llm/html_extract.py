"""Main text of web pages by wrappers: union-free regular expressions inferred from the token streams of a host's pages.

A wrapper is an expression for each element: a sequence of items, each a tag with its own expression, a text slot, or a group of up to
three of them, that occurs once, optionally or repeatedly. A page's own expression has no options; neighbours that are alike are one
repeated item. Pages are folded into the host's wrapper by alignment: items of a kind align, the more alike their content the rather;
what only one side has becomes optional, texts that differ become slots, texts that never differ stay part of the template. A sequence
of more than LIMIT items becomes a repeated group of optional items, one of each kind, so wrappers stay small and alignment cheap.
Wrappers of parts of a host's pages align in the same way, so hosts of any size are folded in parallel.

The wrapper says what is content, once for the host: the element whose slots hold the running text, without what is template, furniture,
a menu of links or an item of its own. article and main elements count in its favour, no more. A page is then matched with the
wrapper, and its text is what stands in the slots that were chosen.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import sys

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .url_filter import parse

BROADCAST_BYTES = 8 << 20  # decisions of all hosts are broadcast up to so many bytes; beyond it they are joined
HELD_HOSTS = 2_000  # wrappers that a task holds before it passes them on
DEPTH = 200  # of nesting; what is deeper belongs to its ancestor there
LIMIT = 64  # items of an expression; more become a repeated group of optional items
KINDS = 256  # of items in such a group; with more of them their classes no longer count
SHARE = 0.9  # of a host's pages that a text stands on, the same on all of them, to be template
OWN = 0.2  # of an element's text that stands in it directly, for it to be the article itself
_TEXT = "#"

_WORDS = lambda s: frozenset(s.split())
INLINE = _WORDS("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr")
VOID = _WORDS("area base col embed hr img input link meta param source track wbr br")
RAW = _WORDS("script style noscript template iframe svg math object canvas audio video select textarea title head")
FURNITURE = _WORDS("nav footer aside form button fieldset menu dialog")
MAIN = _WORDS("article main")
HEADINGS = _WORDS("h1 h2 h3 h4 h5 h6")
LEAVES = HEADINGS | INLINE | _WORDS("p li dt dd th ul ol dl blockquote pre figure figcaption address")  # their text is never an article by itself
LAYOUT = _WORDS("table thead tbody tr td")  # elements like these may hold a page's parts, or a table
SHAPED = _WORDS("div section article td ul ol dl table blockquote") | MAIN  # neighbours of one kind repeat only if their content is alike
CLOSES_P = _WORDS("address article aside blockquote details dialog div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul")
SAME = {"li": _WORDS("li"), "dt": _WORDS("dt dd"), "dd": _WORDS("dt dd"), "tr": _WORDS("tr td th"), "td": _WORDS("td th"), "th": _WORDS("td th"), "option": _WORDS("option")}
SCOPE = {"li": _WORDS("ul ol menu"), "dt": _WORDS("dl"), "dd": _WORDS("dl"), "tr": _WORDS("table"), "td": _WORDS("table tr"), "th": _WORDS("table tr")}
#: Words of classes and ids: of furniture, and of an article. A name tells of furniture only if all its parts do, but for words that say nothing (PLACES).
NOISE = _WORDS("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar widget widgets menu nav navbar navigation
    breadcrumb breadcrumbs footer masthead cookie cookies consent notice popup modal newsletter subscribe signup login share sharing social
    related recommended comment comments commentlist disqus replies respond pagination pager toolbar hidden""")
PLACES = _WORDS("site page global main content list box block area wrapper wrap container section panel inner outer left right top bottom primary secondary bar item links posts articles stories form button buttons text")
HEADER = _WORDS("header")
CONTENT = _WORDS("post entry article story content hentry")
_NOT = _WORDS("no has with without not main content")  # names that begin so tell of something else
ROLES = _WORDS("navigation banner contentinfo complementary search dialog alert")
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def _names(value: str) -> list[list[str]]:
    return [[p for p in re.split(r"[-_]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", n).lower()) if p] for n in value.split()]


def role_of(tag: str, attrs: str) -> tuple[str, str]:
    """The mark of an element, '!' for furniture, '~' for a header, '+' for what is named like an article, or ''; and its first class."""
    mark, first = "!" if tag in FURNITURE else "~" if tag == "header" else "+" if tag in MAIN else "", ""
    for a in _ATTR.finditer(attrs) if attrs and mark != "!" else ():
        key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
        if key == "role":
            mark = "!" if value.lower() in ROLES else "+" if value.lower() in MAIN else mark
        elif (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            mark = "!"
        elif key in ("class", "id"):
            names = _names(value)
            first = first or (re.sub(r"[0-9.]", "", value.split()[0].lower()) if key == "class" and names else "")
            if tag in ("html", "body", "main"):
                continue
            for parts in names:
                whole = {"".join(parts)}
                hints = whole if tag in LEAVES or tag in LAYOUT else {*whole, parts[0], parts[-1]} if parts and parts[0] not in _NOT else set()
                noise = whole & NOISE if tag in LEAVES or tag in LAYOUT or not hints else whole & NOISE or (NOISE & set(parts) and all(p in NOISE or p in PLACES for p in parts))
                mark = "!" if noise else mark
                mark = "~" if hints & HEADER and not mark else "+" if hints & CONTENT and not mark and tag not in LEAVES else mark
        if mark == "!":
            break
    return mark, first


def tokens(page: str):
    """('<', tag, (mark, class)), ('>', tag, None), ('#', text, None): the stream of a page without comments, raw elements and their text."""
    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            yield _TEXT, page[at:], None
            return
        if m.start() > at:
            yield _TEXT, page[at : m.start()], None
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, closing, attrs = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            yield ">", name, None
        elif name in RAW:
            if not attrs.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = end.end() if end else (size if name not in ("head", "title") else at)
        else:
            yield "<", name, role_of(name, attrs)


# ---------------------------------------------------------------- expressions


class Slot:
    """A text of a place: the hash of the one text it ever was, or None; pages; characters, and those in links; a page's block numbers."""

    __slots__ = ("one", "pages", "chars", "links", "blocks", "keep")
    kind = _TEXT

    def __init__(self, one, pages, chars, links, blocks=None):
        self.one, self.pages, self.chars, self.links, self.blocks, self.keep = one, pages, chars, links, blocks, None

    def join(self, other: "Slot", pages: int) -> None:
        self.one = self.one if self.one == other.one else None
        self.pages, self.chars, self.links = pages, self.chars + other.chars, self.links + other.links
        self.blocks = self.blocks + other.blocks if self.blocks is not None and other.blocks is not None else None


class Node:
    """An element's expression: items [parts, least, most], most 2 standing for any number, in sequence, or in any order if it is a bag."""

    __slots__ = ("kind", "pages", "items", "bag", "shape", "keep", "inside")

    def __init__(self, kind, pages=1, items=None, bag=False):
        self.kind, self.pages, self.items, self.bag, self.shape, self.keep, self.inside = kind, pages, items if items is not None else [], bag, None, None, False

    @property
    def tag(self) -> str:
        return re.split(r"[.!~+]", self.kind, maxsplit=1)[0]

    @property
    def mark(self) -> str:
        return self.kind[-1] if self.kind.endswith(("!", "~", "+")) else ""

    def parts(self) -> list:
        return [p for item in self.items for p in item[0]]

    def looks(self) -> frozenset:
        """The kinds of its parts."""
        if self.shape is None:
            self.shape = frozenset(p.kind for p in self.parts())
        return self.shape

    def close(self) -> None:
        """Its items, read as they came, as an expression: neighbours that are alike become repeated, too many items a bag."""
        self.items, self.shape = squares(self.items), None
        if len(self.items) > LIMIT:
            self.items, self.bag = bagged(self.items), True

    def join(self, other: "Node", pages: int) -> None:
        """Take in another element's expression; the other isn't used again."""
        if self.bag or other.bag:
            a, b = (x.items if x.bag else bagged(x.items) for x in (self, other))
            self.items, self.bag = bagged(a + b, add=pages > max(self.pages, other.pages)), True
        else:
            self.items = align(self.items, other.items)
            if len(self.items) > LIMIT:
                self.items, self.bag = bagged(self.items), True
        self.pages, self.shape = pages, None


def like(a, b) -> float:
    """How alike two parts of one kind are, from 1 to 2."""
    if isinstance(a, Slot):
        return 2.0 if a.one is not None and a.one == b.one else 1.5
    p, q = a.looks(), b.looks()
    return 1 + (len(p & q) / len(p | q) if p or q else 1.0)


def _kinds(item) -> tuple:
    return tuple(p.kind for p in item[0])


def _repeats(a, b) -> bool:
    """Whether neighbours of one kind are the same thing again."""
    return all(isinstance(p, Slot) or p.tag not in SHAPED or like(p, q) >= 1.5 for p, q in zip(a[0], b[0]))


def _again(a, b) -> list:
    for p, q in zip(a[0], b[0]):
        p.join(q, max(p.pages, q.pages))
    return [a[0], min(1, max(a[1], b[1])), 2]


def squares(items: list) -> list:
    """Neighbouring groups of up to three items that repeat become one repeated group."""
    out: list = []
    for item in items:
        out.append(item)
        folded = True
        while folded:
            folded = False
            if len(out) > 1 and _kinds(out[-1]) == _kinds(out[-2]) and _repeats(out[-2], out[-1]):
                out[-2:] = [_again(out[-2], out[-1])]
                folded = True
            for n in (2, 3):
                tail = out[-n:]
                if len(out) > n and len(tail) == n and all(len(g) == 1 and lo == hi == 1 for g, lo, hi in tail):
                    group, before = [[g[0] for g, _, _ in tail], 1, 1], out[-n - 1]
                    twice = [[p for g, _, _ in out[-2 * n : -n] for p in g], 1, 1]
                    if _kinds(before) == _kinds(group) and _repeats(before, group):
                        out[-n - 1 :] = [[_again(before, group)[0], before[1], 2]]
                        folded = True
                    elif len(out) >= 2 * n and all(len(g) == 1 and lo == hi == 1 for g, lo, hi in out[-2 * n : -n]) and _kinds(twice) == _kinds(group) and len(set(_kinds(group))) > 1 and _repeats(twice, group):
                        out[-2 * n :] = [[_again(twice, group)[0], 1, 2]]
                        folded = True
                    if folded:
                        break
    return out


def bagged(items: list, add: bool = False) -> list:
    """One optional repeated item of each kind, in the order in which the kinds came."""
    held: dict = {}
    for part in (p for item in items for p in item[0]):
        if part.kind in held:
            old = held[part.kind]
            old.join(part, old.pages + part.pages if add else max(old.pages, part.pages))
        else:
            held[part.kind] = part
    if len(held) > KINDS and any("." in k for k in held):
        for part in held.values():
            if "." in part.kind:
                part.kind = part.tag + part.mark
        return bagged([[[p], 0, 2] for p in held.values()], add)
    return [[[p], 0, 2] for p in held.values()]


def pairs(a: list, b: list) -> list[tuple[int | None, int | None]]:
    """The best alignment of two sequences of items, as pairs of places; None where a side has no such item. Both are at most LIMIT long."""
    ka, kb = list(map(_kinds, a)), list(map(_kinds, b))
    n, m = len(a), len(b)
    if ka == kb:
        return [(i, i) for i in range(n)]
    fits = {(i, j): sum(map(like, a[i][0], b[j][0])) / len(ka[i]) for i in range(n) for j in range(m) if ka[i] == kb[j]}
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            row[j] = max(below[j], row[j + 1], below[j + 1] + fits[i, j] if (i, j) in fits else 0.0)
    i = j = 0
    out: list = []
    while i < n or j < m:
        if i < n and j < m and (i, j) in fits and best[i][j] == best[i + 1][j + 1] + fits[i, j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append((i, None))
            i += 1
        else:
            out.append((None, j))
            j += 1
    return out


def align(a: list, b: list) -> list:
    """The expression of both sequences: items that both have stay, with the wider range; those of one side become optional."""
    same = list(map(_kinds, a)) == list(map(_kinds, b))
    out = []
    for i, j in pairs(a, b):
        if i is None or j is None:
            parts, _, most = a[i] if j is None else b[j]
            out.append([parts, 0, most])
        else:
            for p, q in zip(a[i][0], b[j][0]):
                p.join(q, p.pages + q.pages)
            out.append([a[i][0], min(a[i][1], b[j][1]), max(a[i][2], b[j][2])])
    return out if same else squares(out)


class Page:
    """A page's blocks of text, and its own expression."""

    def __init__(self, page: str | None):
        self.blocks: list[str] = []
        self.root = Node("")
        stack: list[tuple[str, Node]] = [("", self.root)]
        held: list[str] = []
        link = 0
        linked = 0

        def flush():
            nonlocal linked
            text = " ".join(entities.unescape("".join(held)).split()) if held else ""
            held.clear()
            if text and stack[-1][1].mark != "!":
                digest = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()
                stack[-1][1].items.append([[Slot(digest, 1, len(text), min(linked, len(text)), [len(self.blocks)])], 1, 1])
                self.blocks.append(text)
            linked = 0

        def push(tag: str, mark: str, name: str):
            up = stack[-1][1]
            if up.mark == "!" or (len(stack) > DEPTH and mark != "!"):
                stack.append((tag, up))  # nothing of it is told apart from what it is in
            else:
                stack.append((tag, Node(f"{tag}{'.' * bool(name)}{name}{mark}")))
                up.items.append([[stack[-1][1]], 1, 1])

        def cut(i: int):
            while len(stack) > i:
                _, node = stack.pop()
                if node is not stack[-1][1]:
                    node.close()

        def close(what, scope):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in what:
                    return cut(i)
                if stack[i][0] in scope:
                    return

        for kind, value, role in tokens(page or ""):
            if kind == _TEXT:
                held.append(value)
                linked += link * len(value.strip())
            elif value == "br":
                held.append(" ")
            elif value in INLINE:
                if kind == "<" and role[0] == "!":  # an inline element that is furniture is an element of its own
                    flush()
                    push(value, *role)
                elif kind == ">" and len(stack) > 1 and stack[-1][0] == value:
                    flush()
                    cut(len(stack) - 1)
                elif value == "a":
                    link = int(kind == "<")
            elif value in VOID:
                flush()
            elif kind == "<":
                flush()
                if value in CLOSES_P:
                    close(_WORDS("p"), CLOSES_P - _WORDS("p"))
                if value in HEADINGS:
                    close(HEADINGS, CLOSES_P - HEADINGS)
                if value in SAME:
                    close(SAME[value], SCOPE.get(value, frozenset()))
                push(value, *role)
            else:
                flush()
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == value:
                        cut(i)
                        break
                    if stack[i][0] in MAIN and value not in ("body", "html", *MAIN):
                        break
        flush()
        cut(1)
        self.root.close()


# ---------------------------------------------------------------- wrappers


class Wrapper:
    """The expression of a host's pages, and which of its slots hold the main text."""

    def __init__(self):
        self.pages, self.root = 0, Node("", 0)

    def add(self, page: Page) -> None:
        self.join(page.root, 1)

    def join(self, root: Node, pages: int) -> None:
        self.pages += pages
        if self.pages == pages:
            self.root = root
        else:
            self.root.join(root, self.pages)

    def text(self) -> str:
        def out(p):
            return [_TEXT, p.one, p.pages, p.chars, p.links] if isinstance(p, Slot) else [p.kind, p.pages, int(p.bag), [[lo, hi, list(map(out, g))] for g, lo, hi in p.items]]

        return json.dumps([self.pages, out(self.root)])

    @classmethod
    def of(cls, text: str) -> "Wrapper":
        def read(x):
            return Slot(*x[1:]) if x[0] == _TEXT else Node(x[0], x[1], [[list(map(read, g)), lo, hi] for lo, hi, g in x[3]], bool(x[2]))

        out = cls()
        out.pages, root = json.loads(text)
        out.root = read(root)
        return out

    def expression(self, node: Node | None = None) -> str:
        """The wrapper as a regular expression over tags and text slots."""
        out = []
        for group, lo, hi in (node or self.root).items:
            inner = "".join(_TEXT if isinstance(p, Slot) else f"<{p.tag}>{self.expression(p)}</{p.tag}>" for p in group)
            out.append(f"({inner}){ {(0, 1): '?', (0, 2): '*', (1, 2): '+'}[min(lo, 1), min(hi, 2)] }" if (lo, hi) != (1, 1) else inner)
        return f"({''.join(out)})*" if (node or self.root).bag else "".join(out)

    # ---- what is content

    def decide(self) -> None:
        """Mark every slot and element: keep is True, False, or None for an element whose parts differ."""
        self.live = True
        if not self.weight(self.root):  # the host's pages don't differ in any text: all of it stays
            self.live = False
        path = [self.root]
        while child := self.narrower(path[-1]):
            path.append(child)
        top = path[-1]
        alone = self.own(top) < OWN * self.weight(top)
        self.walk(self.root, path, not alone, top.mark == "+", self.has_h1(top))

    def template(self, slot: Slot) -> bool:
        return self.live and slot.one is not None and slot.pages > 1 and slot.pages >= SHARE * self.pages

    def weight(self, part) -> int:
        """Characters of running text that aren't template or furniture; those in links count against it."""
        if isinstance(part, Slot):
            return 0 if self.template(part) else max(0, part.chars - 2 * part.links)
        return 0 if part.mark in ("!", "~") else sum(map(self.weight, part.parts()))

    def container(self, part) -> bool:
        if isinstance(part, Slot) or part.mark in ("!", "~") or part.tag in LEAVES:
            return False
        return part.tag not in LAYOUT or self.layout(part)

    def layout(self, part: Node) -> bool:
        """Whether a table's part lays out the page: a cell of it holds blocks."""
        return any(isinstance(p, Node) and (self.layout(p) if p.tag in LAYOUT else part.tag == "td" and p.tag not in INLINE) for p in part.parts())

    def own(self, node: Node) -> int:
        return self.weight(node) - sum(self.weight(p) for p in node.parts() if self.container(p))

    def narrower(self, node: Node) -> Node | None:
        """The part that holds the article, if the element around it is more than that."""
        whole = self.weight(node)
        inner = [p for p in node.parts() if self.container(p) and self.weight(p)]
        if not inner or not whole:
            return None
        best = max(inner, key=lambda p: self.weight(p) * (2 if p.mark == "+" else 1))
        need = 0.8 if self.own(node) >= OWN * whole else 0.3 if best.mark == "+" else 0.7
        return best if self.weight(best) >= need * whole else None

    def has_h1(self, node: Node) -> bool:
        return any(isinstance(p, Node) and p.mark != "!" and (p.tag == "h1" or self.has_h1(p)) for p in node.parts())

    def menu(self, node: Node) -> bool:
        chars, links = self.lengths(node)
        return 2 * links > chars

    def lengths(self, part) -> tuple[int, int]:
        if isinstance(part, Slot):
            return part.chars, part.links
        each = [self.lengths(p) for p in part.parts()]
        return sum(x for x, _ in each), sum(y for _, y in each)

    def walk(self, node: Node, path: list[Node], full: bool, favoured: bool, h1: bool) -> None:
        """Mark the parts of an element on the way to the chosen one, and the chosen one itself."""
        if node is path[-1]:
            self.inside(node, path[-1], full, favoured, None)
            return
        node.inside = False
        for p in node.parts():
            if any(p is x for x in path):
                self.walk(p, path, full, favoured, h1)
            else:
                self.all(p, isinstance(p, Node) and p.tag == "h1" and p.mark != "!" and not h1 and self.weight(p) > 0)

    def all(self, part, keep: bool) -> None:
        part.keep = keep
        for p in part.parts() if isinstance(part, Node) else ():
            self.all(p, keep)

    def inside(self, node: Node, top: Node, full: bool, favoured: bool, header: Node | None) -> None:
        """Of the article: all but furniture, template, a header's other text than headings, articles of their own and menus of links."""
        node.inside = True
        for p in node.parts():
            if isinstance(p, Slot):
                p.keep = (not self.template(p) or node.tag == "h1") and (header is None or node.tag in HEADINGS)
            elif p.mark == "!" or (full and p.tag == "article") or (not favoured and p.tag not in LEAVES - {"ul", "ol", "dl"} and self.menu(p)):
                self.all(p, False)
            else:
                self.inside(p, top, full, favoured, header or (p if p.mark == "~" else None))

    def content(self) -> list[str]:
        """The elements, as paths, that hold the text of slots that were chosen."""
        self.decide()
        out: list[str] = []

        def walk(node, path):
            for p in node.parts():
                if isinstance(p, Slot):
                    if p.keep and path not in out:
                        out.append(path)
                else:
                    walk(p, f"{path}/{p.kind}")

        walk(self.root, "")
        return out

    def decisions(self) -> str:
        """What matching a page needs: the expression down to where all is kept or nothing."""
        self.decide()

        def out(p):
            if isinstance(p, Slot):
                return [_TEXT, int(p.keep), p.one]
            each = [[lo, hi, list(map(out, g))] for g, lo, hi in p.items]
            flags = {x[1] for _, _, g in each for x in g}
            whole = p.keep if p.keep is not None else (flags.pop() if len(flags) == 1 and flags != {None} else None)
            if whole is not None:
                return [p.kind, int(whole), sorted(p.looks())]
            return [p.kind, None, sorted(p.looks()), int(p.bag), int(p.inside), each]

        return json.dumps(out(self.root))


def _decided(x):
    """decisions(), read."""
    if x[0] == _TEXT:
        slot = Slot(x[2], 0, 0, 0)
        slot.keep = bool(x[1])
        return slot
    node = Node(x[0])
    node.keep, node.shape = (None if x[1] is None else bool(x[1])), frozenset(x[2])
    if x[1] is None:
        node.bag, node.inside, node.items = bool(x[3]), bool(x[4]), [[list(map(_decided, g)), lo, hi] for lo, hi, g in x[5]]
    return node


def _flag(part, keep: bool, out: list[bool]) -> None:
    if isinstance(part, Slot):
        for b in part.blocks:
            out[b] = keep
    elif part.mark != "!":
        for p in part.parts():
            _flag(p, keep, out)


def _matched(page: Node, host: Node, out: list[bool]) -> None:
    """Flag a page's blocks by the wrapper's parts that they align with."""
    if host.keep is not None:
        return _flag(page, host.keep, out)
    found = {}
    if not host.bag and not page.bag:
        for i, j in pairs(page.items, host.items) if len(page.items) <= LIMIT >= len(host.items) else ():
            if i is not None and j is not None:
                found |= {id(p): q for p, q in zip(page.items[i][0], host.items[j][0])}
    by_kind: dict = {}
    for q in host.parts():
        by_kind.setdefault(q.kind, q)
    for p in page.parts():
        q = found.get(id(p)) or by_kind.get(p.kind)
        if q is None:
            _flag(p, host.inside, out)
        elif isinstance(p, Slot):
            _flag(p, q.keep, out)
        else:
            _matched(p, q, out)


def extract(page: str | None, wrapper: Wrapper | Node | None = None) -> str:
    """The text in a page's slots that its host's wrapper, or its own, has chosen."""
    seen = Page(page)
    if wrapper is None:
        wrapper = Wrapper()
        wrapper.add(Page(page))
    host = wrapper if isinstance(wrapper, Node) else _decided(json.loads(wrapper.decisions()))
    keep = [False] * len(seen.blocks)
    _matched(seen.root, host, keep)
    return "\n".join(b for b, k in zip(seen.blocks, keep) if k)


def _partial(batches):
    sys.setrecursionlimit(max(10_000, sys.getrecursionlimit()))
    held: dict[str, Wrapper] = {}
    out = lambda: pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([w.text() for w in held.values()], pa.string())], names=["host", "wrapper"])
    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            held.setdefault(host, Wrapper()).add(Page(page))
            if len(held) > HELD_HOSTS:
                yield out()
                held.clear()
    if held:
        yield out()


def _merge(frame: pd.DataFrame) -> pd.DataFrame:
    sys.setrecursionlimit(max(10_000, sys.getrecursionlimit()))
    whole = Wrapper()
    for text in sorted(frame["wrapper"]):
        part = Wrapper.of(text)
        whole.join(part.root, part.pages)
    return pd.DataFrame({"host": [frame["host"].iloc[0]], "salt": [0], "wrapper": [whole.text()]})


def _decisions(batches):
    sys.setrecursionlimit(max(10_000, sys.getrecursionlimit()))
    for batch in batches:
        held = [Wrapper.of(w).decisions() for w in batch.column("wrapper").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(held, pa.string())], names=["host", "decisions"])


def wrappers(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, wrapper): one wrapper per host, of all its pages. Tasks fold their own pages first; what they pass on is merged in two steps."""
    rows = pages.select(parse(F.col("url"))[0].alias("host"), "html")
    parts = rows.mapInArrow(_partial, "host string, wrapper string").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(32)))
    kind = "host string, salt int, wrapper string"
    once = scratch.save(parts, "partial").groupBy("host", "salt").applyInPandas(_merge, kind)
    out = scratch.save(once.groupBy("host").applyInPandas(_merge, kind).select("host", "wrapper"), "wrappers")
    scratch.drop("partial")
    return out


def main_text(pages: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) per row of pages.

    A null or empty html, and a page without main text, gives an empty text. A null url belongs to the host ''. Repeated rows give a row
    each; pages are taken whole, however long; an empty table gives no rows; other columns aren't read. Where a host's pages have the
    same texts throughout, the wrapper can't tell template from content, and what isn't furniture stays.
    """
    scratch = scratch or Scratch(pages.sparkSession, "html")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    side = scratch.save(wrappers(pages, scratch).mapInArrow(_decisions, "host string, decisions string"), "decisions")
    scratch.drop("wrappers")
    size = side.agg(F.sum(F.octet_length("decisions") + F.octet_length("host"))).first()[0] or 0
    side = F.broadcast(side) if size <= BROADCAST_BYTES else side
    rows = pages.withColumn("host", parse(F.col("url"))[0]).join(side, "host", "left").select("page_id", "url", "html", "decisions")

    def run(batches):
        sys.setrecursionlimit(max(10_000, sys.getrecursionlimit()))
        known: dict[str, Node] = {}
        for batch in batches:
            texts = []
            for page, d in zip(batch.column("html").to_pylist(), batch.column("decisions").to_pylist()):
                if d not in known:
                    if len(known) >= HELD_HOSTS:
                        known.clear()
                    known[d] = _decided(json.loads(d))
                texts.append(extract(page, known[d]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
