"""A tolerant reader of HTML: blocks of text with the branch they stand in, and the style of each branch.

A branch is named by its block elements from the root, each with its classes and id (digits in them read as
0), and known by a 64-bit hash of its parent's branch and its own name; so pages of one template share
branches.  A heading is text of the branch that it heads.  Elements below level ``DEPTH`` stand for their ancestor at that level, which bounds the ancestors
of a branch and no text.  Reading takes time and memory in proportion to the text, whatever is left open.

End tags may lack, as may quotes: a quote counts only where a value begins and only if it is closed.
Comments are skipped, to the end of the text if nothing closes them, as are scripts and styles; other
elements whose content is no text of the page are skipped if they are closed, and else are no elements.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import xxhash

BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page; of the latter the content is skipped even if nothing ends it.
RAW = frozenset("script style noscript template iframe object svg textarea title select button".split())
_TO_THE_END = frozenset(("script", "style"))
_ENDS_P = BLOCK - frozenset("body html head option legend summary td th tr tbody thead tfoot".split())
_P_WITHIN = ("table", "td", "th", "div", "li")
#: An element that starts ends these, up to the given ones.
_ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)), "option": (("option",), ())}
_VALUE = r"\"[^\"]*+\"|'[^']*+'|[^\s>]*+"
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:{_VALUE}))*+)(?:>|\Z)|<[!?/](?![a-zA-Z])[^>]*+(?:>|\Z)|<![a-zA-Z][^>]*+(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:^|[\s\"'/])(?:class|id)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))", re.I)
_DIGITS = re.compile(r"[0-9]+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.I) for tag in RAW}
DEPTH = 64


class Element:
    """``up`` is the nearest block element outside, ``owner`` the nearest from here on."""

    __slots__ = ("branch", "depth", "name", "owner", "state", "style", "tag", "up")

    def __init__(self, tag: str, name: str, parent: Element | None) -> None:
        self.tag, self.name, self.style = tag, name, 0
        self.up = parent.owner if parent else None
        if tag in BLOCK or parent is None:
            self.owner = self
            self.depth = parent.owner.depth + 1 if parent else 0
            own = parent is not None and self.depth <= DEPTH and tag not in HEADINGS
            self.branch = hash_of(name, self.up.branch) if own else self.up.branch if parent else 0
        else:
            self.owner, self.depth, self.branch = self.up, self.up.depth, self.up.branch

    def chain(self) -> list[int]:
        """The branch and those it lies in, but the root."""
        out, e = [], self.owner
        while e.up is not None:
            if e.depth <= DEPTH:
                out.append(e.branch)
            e = e.up
        return out


def hash_of(text: str, seed: int = 0) -> int:
    """A signed 64-bit hash."""
    found = xxhash.xxh64_intdigest(text, seed & 0xFFFFFFFFFFFFFFFF)
    return found - (1 << 64) if found >> 63 else found


def names_of(attributes: str) -> list[str]:
    """Classes and id, sorted."""
    return sorted({x for m in _NAMES.finditer(attributes) for x in _DIGITS.sub("0", m[1] or m[2] or m[3] or "").lower().split()})


def walk(source: str, enter: Callable[[Element, Element], object], leave: Callable[[Element], None] | None = None) -> Iterator[tuple[Element, str]]:
    """Blocks of text, as the innermost block element and the text, in order.

    ``enter(parent, element)`` gives the state that the new element's ``state`` holds; ``leave`` sees every
    block element when it ends, its ``style`` being a hash of the names of its block children in order.
    """
    root = Element("", "", None)
    root.state = enter(root, root)
    stack, buffer, at = [root], [], 0
    places: dict[str, list[int]] = {}  # of the open elements of a tag
    blocks = [0]  # of the open block elements
    unclosed: set[str] = set()

    def flush() -> Iterator[tuple[Element, str]]:
        text = " ".join("".join(buffer).split()) if buffer else ""
        buffer.clear()
        if text:
            yield stack[-1].owner, text

    def last(tags: tuple[str, ...]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(upto: int) -> None:
        while len(stack) > upto:
            gone = stack.pop()
            places[gone.tag].pop()
            if gone.owner is gone:
                blocks.pop()
                if leave and gone.tag not in HEADINGS:
                    leave(gone)

    for m in iter(lambda: _TOKEN.search(source, at), None):
        if m.start() > at:
            piece = source[at : m.start()]
            buffer.append(html.unescape(piece) if "&" in piece else piece)
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            k = last((tag,))
            if k:
                if blocks[-1] >= k:
                    if tag not in BLOCK:
                        continue  # an inline end tag does not end the blocks inside
                    yield from flush()
                close(k)
            elif tag == "p" or tag == "br":
                yield from flush()
            continue
        if tag in BLOCK:
            yield from flush()
        if tag == "br":
            buffer.append(" ")
        if tag in RAW:
            end = None if tag in unclosed else _RAW_END[tag].search(source, at)
            if end:
                at = end.end()
            elif tag in _TO_THE_END:
                at = len(source)
            else:
                unclosed.add(tag)
            continue
        if tag in _ENDS_P:
            k = last(("p",))
            if k and k > last(_P_WITHIN):
                close(k)
        if tag in _ENDS:
            ended, within = _ENDS[tag]
            k = last(ended)
            if k and k > last(within):
                close(k)
        name = ".".join([tag, *names_of(m[3])]) if m[3] else tag
        parent = stack[-1]
        if tag in BLOCK:
            parent.owner.style = hash_of(name, parent.owner.style)
        if tag not in VOID and not m[3].endswith("/"):
            element = Element(tag, name, parent)
            element.state = enter(parent, element)
            places.setdefault(tag, []).append(len(stack))
            if element.owner is element:
                blocks.append(len(stack))
            stack.append(element)
    if at < len(source):
        buffer.append(html.unescape(source[at:]))
    yield from flush()
    close(1)
