"""A small tolerant HTML reader: text blocks with what surrounds them, and media references."""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

#: A comment, a declaration, a tag, or text. An unclosed one reaches the end of the page.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?", re.S)
_SPACE = re.compile(r"\s+")
#: Elements whose content is not text of the page.
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "object", "head", "textarea", "select", "option", "button"}
#: Of those, the ones whose content is not markup either: only their closing tag ends them.
_OPAQUE = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in ("script", "style", "textarea")}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "acronym", "source", "input"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: An element that ends an open one of these kinds when it starts.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}


class Element(NamedTuple):
    """An open element: its tag, its attributes, and a number of its own."""

    tag: str
    attributes: dict[str, str]
    number: int


class Block:
    """A run of text between block boundaries."""

    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: tuple[Element, ...], linked: int):
        self.text, self.path, self.linked = text, path, linked


class Media(NamedTuple):
    """A media reference, in page order among the blocks."""

    source: str
    alt: str
    path: tuple[Element, ...]


def attributes(text: str) -> dict[str, str]:
    """A tag's attributes by lower-case name, the first of each, with references decoded."""
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


def read(page: str) -> list[Block | Media]:
    """Blocks and media references in page order.

    White space inside a block is one space, character references are decoded, ``br``
    is white space. Raw elements, comments and markup give nothing.
    """
    out: list[Block | Media] = []
    path: list[Element] = []
    text: list[str] = []
    linked = number = raw = at = 0

    def flush() -> None:
        nonlocal linked
        if text:
            joined = _SPACE.sub(" ", unescape("".join(text))).strip(" ")
            if joined:
                out.append(Block(joined, tuple(e for e in path if e.tag not in INLINE), min(linked, len(joined))))
            text.clear()
        linked = 0

    while m := _TOKEN.match(page, at):
        at = m.end()
        close, tag, rest, words = m.groups()
        if tag is None:
            if words is not None and not raw:
                text.append(words)
                if any(e.tag == "a" for e in path):
                    linked += len(words.strip())
            continue
        tag = tag.lower()
        if tag not in INLINE:
            flush()
        elif tag == "br":
            if not raw:
                text.append("\n")
            continue
        if close:
            k = next((k for k in range(len(path) - 1, -1, -1) if path[k].tag == tag), None)
            if k is not None and (tag not in INLINE or all(e.tag in INLINE for e in path[k:])):
                if tag not in INLINE:
                    del path[k:]
                else:
                    del path[k]
                raw = sum(e.tag in RAW for e in path)
            continue
        if tag in _CLOSES:
            while path and path[-1].tag in _CLOSES[tag] | INLINE:
                gone = path.pop()
                if gone.tag in _CLOSES[tag]:
                    break
        elif tag not in INLINE:  # a block ends an open paragraph, and what is inline in it
            k = len(path) - 1
            while k >= 0 and path[k].tag in INLINE:
                k -= 1
            if k >= 0 and path[k].tag == "p":
                del path[k:]
        found = attributes(rest) if rest and not rest.isspace() else {}
        number += 1
        element = Element(tag, found, number)
        if tag in ("img", "audio", "video", "source", "embed") and found.get("src") and not raw:
            flush()
            out.append(Media(found["src"].strip(), _SPACE.sub(" ", found.get("alt", "")).strip(), tuple(e for e in path if e.tag not in INLINE)))
        if tag in VOID or rest.rstrip().endswith("/") and tag not in RAW:
            continue
        path.append(element)
        raw += tag in RAW
        if tag in _OPAQUE:
            end = _OPAQUE[tag].search(page, at)
            at = end.start() if end else len(page)
    flush()
    return out
