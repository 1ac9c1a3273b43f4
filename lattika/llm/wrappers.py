"""HTML extraction by wrappers: union-free regular expressions inferred from the pages of a host.

A page is a tree of elements, each named by its tag and class words, with text slots. A slot's name holds
what tags and class words hint: `#+` stands in an article, `#` elsewhere; text that they call a menu, header,
footer, aside, notice, advert, form or comment has none. Equal neighbours collapse to a repeated item, runs of
names that recur to a repeated group. The trees of a host are aligned one after another: matching elements
are aligned inside, what only one side has becomes optional. The result is the host's wrapper. Its slots
know how many characters they took, how many of them in links, and the literals: texts that stand at that
place on most pages of the host.

A page is extracted by walking it and its host's wrapper together: each element moves on in the expression,
each block of text falls into a slot, and the slot decides. Article slots are kept. Others are kept on pages
that fill no article slot, unless the slot's text is mostly links over all pages, or the text is a literal.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Scratch, in_parts, shuffle_partitions

# Elements of HTML and words that name what isn't the article.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"ul", "ol", "dl", "table", "select", "article", "section", "div", "body", "nav", "aside", "main", "blockquote", "td", "th"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
OFF_TAGS = {"nav", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "svg", "math", "canvas", "object", "button", "select", "textarea", "head", "title", "menu", "dialog", "noembed", "noframes", "xmp"}
OFF_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "disqus",
    "footer", "form", "gdpr", "header", "hidden", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "pager", "pagination", "popup", "promo",
    "promoted", "promotion", "related", "replies", "reply", "responses", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "teaser", "toolbar", "topbar", "widget", "widgets",
}
OFF_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form"}
MAIN_TAGS, MAIN_WORDS = {"article", "main"}, {"article", "articlebody", "content", "entry", "main", "post", "story", "maincontent"}
#: Words that keep an article inside their element from being the page's own.
FOREIGN_WORDS = {"comment", "comments", "commentlist", "disqus", "replies", "reply", "related", "responses", "teaser", "sidebar", "widget", "promo", "ad", "ads", "advert"}

#: The last form of a tag is one whose quotes don't pair up.
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)(?:((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|([^>]*)(?:>|$))|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
SAME_PERCENT, DEEPEST, PERIOD, FOLDS = 80, 60, 6, 256
"""Percent of the host's pages with any text that hold a text at one place before it is a literal; the depth from which
elements share their ancestor's slot (their texts and hints stay their own); the longest repeated group that is looked
for; parts in which a host's trees are folded before the parts' wrappers are."""


class Node:
    """An element: tag, class words, whether it is no part of the article (off), whether it may be the article (main)."""

    __slots__ = ("tag", "words", "off", "main", "path")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        got: dict[str, str] = {}
        if attributes and attributes.strip(" /\t\n\r\f"):
            for m in ATTRIBUTE.finditer(attributes):
                got.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        named = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{got.get('class', '')} {got.get('id', '')}").lower()) if got else []
        words = set(named)
        self.tag, self.words = tag, words
        inner = parent is not None and (parent.main or any(x == "<main>" for x in parent.path))
        style = got.get("style", "").replace(" ", "").lower()
        off = tag in OFF_TAGS or (tag == "header" and not inner) or got.get("role", "").lower() in OFF_ROLES or "hidden" in got or got.get("aria-hidden", "") == "true" or "display:none" in style
        if tag not in ("html", "body") and not off and words & OFF_WORDS:
            # An article's own heading block may be called a header.
            off = bool(words & OFF_WORDS - {"header"}) or not inner
        opens = tag in MAIN_TAGS or got.get("role", "").lower() in ("main", "article") or got.get("itemprop", "").lower() == "articlebody" or (tag in ("div", "section") and bool(words & MAIN_WORDS))
        self.main = opens and not off
        label = f"{tag}.{'.'.join(sorted(words & (OFF_WORDS | MAIN_WORDS)))}" if words & (OFF_WORDS | MAIN_WORDS) else tag
        above = parent.path if parent else ()
        # An article ends elements that weren't closed above it, but for those that hold others' texts.
        astray = parent is not None and parent.off and tag in MAIN_TAGS and self.main and not any(x.startswith("!") for x in above)
        self.off = off or (parent is not None and parent.off and not astray)
        kept = tuple(x for x in above if x != "<main>") if astray else above
        marks = (("!",) if off and (words & FOREIGN_WORDS or tag == "aside") and tag not in MAIN_TAGS and (words & {"comment", "comments", "commentlist", "disqus", "replies", "reply", "related", "responses"} or tag == "aside") else ()) + (("<main>",) if self.main and not self.off else ())
        self.path = (*kept, label, *marks) if len(kept) < DEEPEST else (*kept, *(x for x in marks if x not in kept))


def parse(page: str | None) -> Iterator[tuple]:
    """('open', node), ('close', node), ('text', node, raw text) and ('break', node) of a page, with ends implied as browsers do."""
    stack: list[Node] = []
    raw_end: str | None = None
    at, text = 0, page or ""
    while at < len(text):
        if raw_end:
            stop = re.compile(rf"</{re.escape(raw_end)}(?=[\s/>])", re.I).search(text, at)
            if stop is None:
                at = len(text)
            else:
                at = stop.start()
            raw_end = None
            continue
        m = TOKEN.match(text, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            body = m[0]
            if not body.startswith(("<!", "<?")):
                yield "text", stack[-1] if stack else None, body
            continue
        tag = tag.lower()
        if m[1]:
            places = [i for i, n in enumerate(stack) if n.tag == tag]
            if places:
                while len(stack) > places[-1]:
                    yield "close", stack.pop()
            elif tag in ("br", "p"):
                yield "break", stack[-1] if stack else None
            continue
        if tag in CLOSES_P or tag in CLOSES:
            shut = {"p"} if tag in CLOSES_P else CLOSES[tag]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in shut:
                    while len(stack) > i:
                        yield "close", stack.pop()
                    break
                if stack[i].tag in STOPS and not (tag in ("td", "th", "tr") and stack[i].tag in ("td", "th")):
                    break
        node = Node(tag, m[3] or m[4] or "", stack[-1] if stack else None)
        if tag in VOID or m[0].endswith("/>") and tag in ("svg", "path"):
            if tag in ("br", "hr"):
                yield "break", stack[-1] if stack else None
            continue
        stack.append(node)
        yield "open", node
        if tag in RAW:
            raw_end = tag
    while stack:
        yield "close", stack.pop()


def walk(page: str | None, root, opened, said, closed=None) -> None:
    """Reads a page once. opened(state, node) gives the state of an element below `state`; said(state, node, text,
    linked) takes each block of text with spaces made one and the characters of it in links; closed(state) ends an element.
    """
    states: list = [(root, 0)]
    part: list[str] = []
    owner, where = None, root
    linked, links, blank = 0, 0, True

    def end() -> None:
        nonlocal linked, blank
        words = " ".join(entities.unescape("".join(part)).split())
        if words:
            said(where, owner, words, linked)
        part.clear()
        linked, blank = 0, True

    for step in parse(page):
        what, node = step[0], step[1]
        if what == "text":
            off = node.off if node else False
            if part and (owner.off if owner else False) != off:
                end()
            if blank:
                owner, where, blank = node, states[-1][0], not step[2].strip()
            part.append(step[2])
            if links:
                linked += len(step[2].strip())
        elif what == "break":
            end()
        else:
            if node.tag == "a":
                links = max(0, links + (1 if what == "open" else -1))
            if node.tag not in INLINE:
                end()
            if what == "open":
                state, depth = states[-1]
                own = node.tag not in INLINE and depth < DEEPEST
                states.append((opened(state, node), depth + 1) if own else (state, depth))
            else:
                state, depth = states.pop()
                if closed and depth > states[-1][1]:
                    closed(state)
    end()


def name_of(node: Node) -> str:
    return next(x for x in reversed(node.path) if not x.startswith(("!", "<")))


def slot_name(node: Node | None) -> str:
    return "#+" if node is not None and "<main>" in node.path else "#"


# ---- wrappers


class Item:
    """A part of a wrapper: an element, a text slot (`#+`, `#`) or a group of items (`()`).

    mark: '' for once, '?' for optional, '+' for repeated, '*' for both. stats of a slot: characters, and those in links.
    """

    __slots__ = ("name", "mark", "kids", "stats", "key")

    def __init__(self, name: str, mark: str = "", kids: list[Item] | None = None, stats: tuple[int, int] = (0, 0)):
        self.name, self.mark, self.kids, self.stats = name, mark, kids or [], stats
        self.key = hash((name, mark, tuple(k.key for k in self.kids)))

    def plain(self) -> list:
        return [self.name, self.mark, list(self.stats) if self.name[0] == "#" else [k.plain() for k in self.kids]]


def item_of(plain: list) -> Item:
    name, mark, rest = plain
    return Item(name, mark, None, tuple(rest)) if name[0] == "#" else Item(name, mark, [item_of(k) for k in rest])


class Growing:
    """An element while its page is read."""

    __slots__ = ("name", "kids", "up", "place")

    def __init__(self, name: str, up: Growing | None):
        self.name, self.kids, self.up = name, [], up
        self.place = f"{up.place}/{name}" if up and up.place else name


def observe(page: str | None) -> tuple[list[Item], list[tuple[str, str]], str]:
    """The page's collapsed items; (place, text) of its blocks that are in no article; all its text."""
    root = Growing("", None)
    outside: list[tuple[str, str]] = []
    whole: list[str] = []

    def opened(state: Growing, node: Node) -> Growing:
        return Growing(name_of(node), state)

    def said(state: Growing, node: Node | None, text: str, linked: int) -> None:
        whole.append(text)
        if node is None or not node.off:
            name = slot_name(node)
            state.kids.append(Item(name, "", None, (len(text), linked)))
            if name == "#":
                outside.append((state.place, text))

    def closed(state: Growing) -> None:
        kids = collapse(state.kids)
        # What holds no text has a name only.
        state.up.kids.append(Item(state.name, "", kids if any(k.kids or k.name[0] == "#" for k in kids) else []))

    walk(page, root, opened, said, closed)
    return collapse(root.kids), outside, "\n".join(whole)


def join_marks(a: str, b: str) -> str:
    both = {*a, *b}
    option, repeat = both & {"?", "*"}, both & {"+", "*"}
    return "*" if option and repeat else "?" if option else "+" if repeat else ""


def joined(one: Item, two: Item, mark: str = "") -> Item:
    """Two items of one name as one."""
    if one.name[0] == "#":
        return Item(one.name, join_marks(join_marks(one.mark, two.mark), mark), None, (one.stats[0] + two.stats[0], one.stats[1] + two.stats[1]))
    return Item(one.name, join_marks(join_marks(one.mark, two.mark), mark), align(one.kids, two.kids))


def collapse(items: list[Item]) -> list[Item]:
    """Neighbours of one name become one repeated item; runs of a few names that recur become a repeated group."""
    out: list[Item] = []
    for item in items:
        if out and out[-1].name == item.name and item.name != "()":
            out[-1] = joined(out[-1], item, "" if item.name[0] == "#" else "+")
        elif out and out[-1].name == "()" and out[-1].kids[-1].name == item.name:
            inner = out[-1].kids
            out[-1] = Item("()", out[-1].mark, [*inner[:-1], joined(inner[-1], item, "" if item.name[0] == "#" else "+")])
        else:
            out.append(item)
        for n in range(2, PERIOD + 1):
            last = out[-n:]
            if len(out) > n and out[-n - 1].name == "()" and [x.name for x in out[-n - 1].kids] == [x.name for x in last]:
                group = out[-n - 1]
                out[-n - 1 :] = [Item("()", group.mark, [joined(a, b) for a, b in zip(group.kids, last, strict=True)])]
                break
            if len(out) >= 2 * n and not any(x.name == "()" for x in out[-2 * n :]) and [x.name for x in out[-2 * n : -n]] == [x.name for x in last]:
                out[-2 * n :] = [Item("()", "+", [joined(a, b) for a, b in zip(out[-2 * n : -n], last, strict=True)])]
                break
    return out


def lengths(one: list[str], two: list[str]) -> Iterator[int]:
    """For each prefix of `one` a number whose zero bits tell where the longest common subsequence with prefixes of `two` grows."""
    places: dict[str, int] = {}
    for j, x in enumerate(two):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(two)) - 1
    row = full
    for x in one:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


def common(one: list[str], two: list[str], bits: int = 1 << 29) -> list[tuple[int, int]]:
    """A longest common subsequence, as pairs of places. Bit-parallel rows; beyond `bits` of them the lists are halved."""
    if len(one) > 1 and len(one) * len(two) > bits:
        half = len(one) // 2
        grown = []
        for x, y in ((one[:half], two), (one[half:][::-1], two[::-1])):
            for last in lengths(x, y):
                pass
            grown.append(list(accumulate((int(not last >> j & 1) for j in range(len(two))), initial=0)))
        cut = max(range(len(two) + 1), key=lambda j: grown[0][j] + grown[1][len(two) - j])
        return common(one[:half], two[:cut], bits) + [(i + half, j + cut) for i, j in common(one[half:], two[cut:], bits)]
    full = (1 << len(two)) - 1
    rows = [full, *lengths(one, two)]
    out: list[tuple[int, int]] = []
    i, j = len(one), len(two)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def align(one: list[Item], two: list[Item]) -> list[Item]:
    """The items of both in order: those of one name are aligned inside, those of one side become optional."""
    names_one, names_two = [x.name for x in one], [x.name for x in two]
    if names_one == names_two:
        return [joined(a, b) for a, b in zip(one, two, strict=True)]
    alone = lambda x: Item(x.name, join_marks(x.mark, "?"), x.kids, x.stats)
    out: list[Item] = []
    i = j = 0
    for to_i, to_j in [*common(names_one, names_two), (len(one), len(two))]:
        out += [alone(x) for x in one[i:to_i]] + [alone(x) for x in two[j:to_j]]
        if to_i < len(one):
            out.append(joined(one[to_i], two[to_j]))
        i, j = to_i + 1, to_j + 1
    return collapse(out)


def expression(items: list[Item]) -> str:
    """A wrapper as a union-free regular expression."""
    return "".join((x.name if x.name[0] == "#" else f"<{x.name}>{expression(x.kids)}") + (x.mark if not x.kids or not x.mark else f"</{x.name}>{x.mark}") for x in items)


class Compiled:
    """An element of a wrapper as pages walk it: its items with groups laid flat, and where each name stands among them."""

    __slots__ = ("items", "group", "at", "literals", "inner")

    def __init__(self, items: list[Item], literals: dict[str, set[int]], place: str = ""):
        self.items: list[Item] = []
        self.group: list[tuple[int, int]] = []
        self.flat(items)
        self.at: dict[str, list[int]] = {}
        for k, x in enumerate(self.items):
            self.at.setdefault(x.name, []).append(k)
        self.literals = literals.get(place, frozenset())
        below = lambda x: f"{place}/{x.name}" if place else x.name
        self.inner = [Compiled(x.kids, literals, below(x)) if x.name[0] != "#" else None for x in self.items]

    def flat(self, items: list[Item], group: tuple[int, int] | None = None) -> None:
        for x in items:
            if x.name == "()":
                a = len(self.items)
                self.flat(x.kids, (a, a))
                b = len(self.items)
                self.group[a:b] = [(a, b)] * (b - a)
            else:
                self.items.append(x)
                self.group.append((len(self.items) - 1, len(self.items)))

    def move(self, now: int, name: str) -> int | None:
        """Where the expression goes on from place `now` with this name: the item itself if it repeats, its group, what follows, or what came before."""
        places = self.at.get(name)
        if not places:
            return None
        if now >= 0:
            if self.items[now].name == name and self.items[now].mark in ("+", "*"):
                return now
            a, b = self.group[now]
            if b - a > 1:
                k = bisect_right(places, now)
                for at in (*places[k : k + 1], *places[bisect_left(places, a) :][:1]):
                    if a <= at < b:
                        return at
        k = bisect_right(places, now)
        return places[k] if k < len(places) else places[0]


class Cursor:
    """How far a page has come in an element of the wrapper; at None the wrapper doesn't know the element."""

    __slots__ = ("at", "now")

    def __init__(self, at: Compiled | None):
        self.at, self.now = at, -1

    def step(self, name: str) -> int | None:
        k = self.at.move(self.now, name) if self.at is not None else None
        if k is not None:
            self.now = k
        return k


def main_text(page: str | None, wrapper: Compiled | None = None) -> str:
    """The text of the page's article slots, or, if it fills none, of the others that the wrapper doesn't rule out."""
    inside: list[str] = []
    outside: list[str] = []

    def opened(state: Cursor, node: Node) -> Cursor:
        k = state.step(name_of(node))
        return Cursor(state.at.inner[k] if k is not None else None)

    def said(state: Cursor, node: Node | None, text: str, linked: int) -> None:
        if node is not None and node.off:
            return
        name = slot_name(node)
        k = state.step(name)
        if name == "#+":
            inside.append(text)
            return
        if k is None:  # not in the wrapper: the block has to speak for itself
            if 2 * linked < len(text):
                outside.append(text)
            return
        chars, in_links = state.at.items[k].stats
        if 2 * in_links < chars and (not state.at.literals or zlib.crc32(text.encode()) not in state.at.literals):
            outside.append(text)

    walk(page, Cursor(wrapper), opened, said)
    return " ".join(inside or outside)


def host_of(url: str | None) -> str:
    m = re.search(r"://([^/?#]*)", url or "")
    return m[1].lower() if m else ""


SEEN = pa.schema([("host", pa.string()), ("kind", pa.string()), ("item", pa.string()), ("n", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])


def observed(pages: DataFrame) -> DataFrame:
    """What the wrappers are inferred from, added up per task: (host, kind, item, n, lo, hi).

    kind 't': a collapsed tree with its slots' characters, and its pages. kind 's': a text (its checksum and
    place) outside any article, the pages that have it and the least and greatest checksum of such a page's
    whole text. kind 'b': the pages that have any text.
    """

    def run(batches):
        trees: dict[tuple, tuple[int, list[Item]]] = {}
        seen: dict[tuple, list[int]] = {}
        for batch in in_parts(batches):
            for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                host = host_of(url)
                items, outside, text = observe(page)
                key = (host, tuple(x.key for x in items))
                n, have = trees.get(key, (0, None))
                trees[key] = (n + 1, items if have is None else align(have, items))
                whole = zlib.crc32(text.encode())
                own = {(host, "s", f"{zlib.crc32(t.encode())} {place}") for place, t in outside} | ({(host, "b", "")} if text else set())
                for k in own:
                    if (v := seen.get(k)) is None:
                        seen[k] = [1, whole, whole]
                    else:
                        v[0], v[1], v[2] = v[0] + 1, min(v[1], whole), max(v[2], whole)
            if len(trees) > 4_000 or len(seen) > 20_000:
                yield lines(trees, seen)
                trees, seen = {}, {}
        if trees:
            yield lines(trees, seen)

    def lines(trees, seen):
        rows = [(host, "t", dumped(items), n, 0, 0) for (host, _), (n, items) in trees.items()] + [(*k, *v) for k, v in seen.items()]
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SEEN, strict=True)], schema=SEEN)

    return pages.select("url", "html").mapInArrow(run, "host string, kind string, item string, n long, lo long, hi long")


def dumped(items: list[Item]) -> str:
    return json.dumps([x.plain() for x in items], separators=(",", ":"))


def loaded(text: str) -> list[Item]:
    return [item_of(x) for x in json.loads(text)]


def folded(trees: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pages, wrapper) from rows (keys, item, n): the trees of each key folded into one, in the order of their text."""
    spark = trees.sparkSession
    rows = trees.select(*keys, "n", "item").repartition(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys, "item", "n")
    kinds = [trees.schema[k].dataType.simpleString() for k in keys]
    out = pa.schema([*[(k, pa.string() if t == "string" else pa.int64()) for k, t in zip(keys, kinds, strict=True)], ("n", pa.int64()), ("item", pa.string())])

    def run(batches):
        now, pages, whole = None, 0, None
        for batch in in_parts(batches):
            for *key, n, item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    if now is not None:
                        yield line(now, pages, whole)
                    now, pages, whole = key, 0, None
                own = loaded(item)
                whole, pages = own if whole is None else align(whole, own), pages + n
        if now is not None:
            yield line(now, pages, whole)

    def line(key, pages, whole):
        return pa.record_batch([pa.array([x], f.type) for x, f in zip([*key, pages, dumped(whole)], out, strict=True)], schema=out)

    return rows.mapInArrow(run, ", ".join(f"{k} {t}" for k, t in zip(keys, kinds, strict=True)) + ", n long, item string")


def wrappers(seen: DataFrame) -> DataFrame:
    """(host, pages, wrapper, literals) from what was observed.

    Trees are folded in FOLDS parts of a host, then the parts' wrappers, so that no task folds all trees of a
    large host; the parts don't depend on the cluster. A literal (checksum and place) stands on
    SAME_PERCENT of the host's pages that have any text, on two at least that aren't copies of each other.
    """
    trees = seen.filter("kind = 't'").select("host", F.pmod(F.xxhash64("item"), F.lit(FOLDS)).alias("part"), "item", "n")
    whole = folded(folded(trees, ["host", "part"]), ["host"])
    texts = seen.filter("kind = 's'").groupBy("host", "item").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("n > 1 and lo < hi")
    filled = seen.filter("kind = 'b'").groupBy("host").agg(F.sum("n").alias("filled"))
    fixed = texts.join(filled, "host").filter(F.col("n") * 100 >= F.col("filled") * SAME_PERCENT).groupBy("host").agg(F.sort_array(F.collect_list("item")).alias("literals"))
    return whole.join(fixed, "host", "left").select("host", F.col("n").alias("pages"), F.col("item").alias("wrapper"), F.coalesce("literals", F.array().cast("array<string>")).alias("literals"))


def compiled(wrapper: str, literals: list[str]) -> Compiled:
    """A host's wrapper, ready to walk."""
    by_place: dict[str, set[int]] = {}
    for x in literals:
        crc, _, place = x.partition(" ")
        by_place.setdefault(place, set()).add(int(crc))
    return Compiled(loaded(wrapper), by_place)


def extracted(pages: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row.

    A null or blank html gives an empty text; pages without a host share one wrapper; repeated rows are
    extracted each, and ties of an alignment go to the earlier items; an empty table gives an empty result;
    other columns are ignored.
    """
    spark = pages.sparkSession
    scratch = scratch or Scratch(spark, "wrappers")
    d = pages.select("page_id", "url", "html")
    shapes = scratch.cut(wrappers(scratch.cut(observed(d), "seen")), "wrappers")
    return applied(d, shapes)


def applied(pages: DataFrame, shapes: DataFrame) -> DataFrame:
    """The pages' texts by given wrappers (host, pages, wrapper, literals).

    Pages meet their host's wrapper in one task, those of a large host in several: a host with more than a
    quarter of a partition's fair share of pages is split, and only such a host's wrapper is copied.
    """
    spark = pages.sparkSession
    wide = shuffle_partitions(spark)
    total = shapes.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    share = max(1, total // (4 * wide))
    # Fewer than 4 x shuffle partitions + 1 hosts can hold more than that share each, so this may be broadcast.
    large = shapes.filter(F.col("pages") > share).select("host", F.ceil(F.col("pages") / share).cast("long").alias("parts"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^(?:(?!://).)*://([^/?#]*)", 1))
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    deal = F.pmod(F.xxhash64("page_id", "html"), F.coalesce("parts", F.lit(1)))
    d = pages.select("page_id", "url", "html", host.alias("host")).join(F.broadcast(large), "host", "left").select("host", deal.alias("part"), F.lit(1).alias("kind"), "page_id", "url", F.col("html").alias("body"), F.lit(None).cast("array<string>").alias("literals"))
    w = shapes.join(F.broadcast(large), "host", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)))
    w = w.select("host", "part", F.lit(0).alias("kind"), F.lit(None).cast(kinds["page_id"]).alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("wrapper").alias("body"), "literals")
    both = w.unionByName(d).repartition(wide, "host", "part").sortWithinPartitions("host", "part", "kind")
    names = pa.schema([("page_id", to_arrow_type(pages.schema["page_id"].dataType)), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        now, wrapper = None, None
        for batch in in_parts(batches):
            hosts, kind, body, literals = (batch.column(k).to_pylist() for k in (0, 2, 5, 6))
            texts: list[str | None] = []
            for h, k, text, fixed in zip(hosts, kind, body, literals, strict=True):
                if k == 0:
                    now, wrapper = h, compiled(text, fixed)
                    texts.append(None)
                else:
                    texts.append(main_text(text, wrapper if h == now else None))
            keep = pa.array([k == 1 for k in kind])
            got = pa.record_batch([batch.column(3), batch.column(4), pa.array(texts, pa.string()), pa.array([len(t or "") for t in texts], pa.int64())], schema=names)
            yield got.filter(keep)

    return both.mapInArrow(run, f"page_id {kinds['page_id']}, url string, text string, n_chars long")
