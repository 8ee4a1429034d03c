"""Leaf blocks of a web page: text with the names on its path, in page order.

Work and memory grow with the length of the page, whatever its markup is like: a tag that is never closed is
found out once, open elements are looked up by name, and a path is a link to the path above it.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

# possessive: what was read of a tag is not tried again in parts
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/)?+(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|[^<]+|<",
    re.S,
)
_MARKUP = re.compile(r"</?+[a-zA-Z]")
_SPECIAL = re.compile(r"[>\"']")
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[a-z]+")

#: Elements whose content is not text of the page.
SILENT = frozenset("head title script style noscript template textarea select iframe svg".split())
#: Of these, the ones whose content is not markup either.
RAW = frozenset("title script style noscript template textarea iframe".split())
#: Elements that may stand in a head; any other start tag, or text, ends an open one.
IN_HEAD = frozenset("head base link meta title script style noscript template noframes".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption"
    " figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre search"
    " section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag ends an open element of these names, up to the nearest element that holds it.
CLOSES = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
HOLDERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
#: Blocks that may stand inside a paragraph's inline elements only by mistake: they end it.
_ENDS_P = BLOCKS - {"html", "body", "option", "caption", "tr", "td", "th", "tbody", "thead", "tfoot"}


class Trail:
    """The names on the way to an element: its own and a link to those above."""

    __slots__ = ("names", "above", "slots")

    def __init__(self, names: tuple[str, ...], above: Trail | None):
        self.names, self.above, self.slots = names, above, None

    def __iter__(self) -> Iterator[str]:
        links = []
        trail = self
        while trail is not None:
            links.append(trail)
            trail = trail.above
        for trail in reversed(links):
            yield from trail.names


@dataclass
class Block:
    path: Iterable[str]
    text: str
    links: int
    """Characters of the text inside links."""


def names_of(tag: str, rest: str) -> tuple[str, ...]:
    """<tag> and the words of its class, id and role."""
    found = [f"<{tag}>"]
    if "=" in rest:
        for kind, *values in _NAMES.findall(rest):
            text = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", "".join(values))
            found += [f"{'.' if kind.lower() != 'role' else '@'}{w}" for w in _PARTS.findall(text.lower())]
    return tuple(found)


class _Ends:
    """Where the tag that begins at a place ends, worked out for a whole page in one pass from its end."""

    def __init__(self, page: str):
        self.places = [m.start() for m in _SPECIAL.finditer(page)]
        self.ends = [-1] * (len(self.places) + 1)
        quotes: dict[str, int] = {}
        for i in range(len(self.places) - 1, -1, -1):
            sign = page[self.places[i]]
            if sign == ">":
                self.ends[i] = self.places[i]
            else:  # a quoted value: on behind its closing quote
                closing = quotes.get(sign)
                self.ends[i] = -1 if closing is None else self.ends[closing + 1]
                quotes[sign] = i

    def of(self, at: int) -> int:
        """Place of the `>` that ends a tag, -1 if there is none."""
        return self.ends[bisect_left(self.places, at)]


def blocks_of(page: str) -> list[Block]:
    """Blocks with text, whole: nothing is left out but what SILENT names.

    White space in a block becomes one space; inline elements do not part a text, `br` is white space. A `<`
    that begins no whole tag is text.
    """
    out: list[Block] = []
    stack: list[tuple[str, Trail]] = []
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements of a name in the stack
    pieces: list[str] = []
    links = silent = in_link = 0
    path: Trail | tuple = ()

    def flush() -> None:
        nonlocal links
        if pieces:
            text = "".join(pieces)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                out.append(Block(path, text, links))
            pieces.clear()
        links = 0

    def push(name: str, names: tuple[str, ...]) -> None:
        nonlocal silent, in_link
        places[name].append(len(stack))
        stack.append((name, Trail(names, stack[-1][1] if stack else None)))
        silent += name in SILENT
        in_link += name == "a"

    def cut(size: int) -> None:
        nonlocal silent, in_link
        while len(stack) > size:
            name, _ = stack.pop()
            places[name].pop()
            silent -= name in SILENT
            in_link -= name == "a"

    def end_head() -> None:
        """A head may be left open: it ends at the first thing that may not stand in it."""
        nonlocal path
        if stack and stack[-1][0] == "head":
            cut(len(stack) - 1)
            path = stack[-1][1] if stack else ()

    def find(names: Iterable[str], holders: Iterable[str] = ()) -> int | None:
        """Place of the nearest open element of some names, unless one of the holders is nearer."""
        nearest = max((places[n][-1] for n in names if places.get(n)), default=-1)
        held = max((places[n][-1] for n in holders if places.get(n)), default=-1)
        return nearest if nearest > held else None

    ends: _Ends | None = None
    at, size = 0, len(page)
    while at < size:
        if ends and _MARKUP.match(page, at) and ends.of(at) < 0:
            token = None  # a tag that does not end
        else:
            token = _TOKEN.match(page, at)
            if token[0] == "<" and ends is None and _MARKUP.match(page, at):
                ends = _Ends(page)
        tag = token["tag"] if token else None
        if tag is None:
            text = token[0] if token else "<"
            at += len(text)
            if text[0] != "<" or text == "<":
                if text.strip():
                    end_head()
                if not silent:
                    pieces.append(text)
                    links += len(text) if in_link else 0
            continue
        at = token.end()
        tag = tag.lower()
        if not token["end"] and tag not in IN_HEAD:
            end_head()
        if tag in BLOCKS:
            flush()
        elif tag == "br" and not silent:
            pieces.append(" ")
        if token["end"]:
            where = find((tag,))
            if where is not None:
                cut(where)
        else:
            if tag in CLOSES:
                where = find(CLOSES[tag], HOLDERS.get(tag, ()))
                if where is not None:
                    cut(where)
            if tag in _ENDS_P:
                where = find(("p",), ("td", "th", "table", "body", "div", "article", "section", "li"))
                if where is not None:
                    cut(where)
            if tag == "a" and in_link:
                cut(find(("a",)))
            if tag not in VOID and not token["rest"].endswith("/"):
                if tag in RAW:
                    end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                    at = end.end() if end else size
                else:
                    if tag == "body" and (head := find(("head",))) is not None:
                        cut(head)  # a head that was never closed
                    push(tag, names_of(tag, token["rest"]))
        if tag in BLOCKS:
            path = stack[-1][1] if stack else ()
    flush()
    return out
