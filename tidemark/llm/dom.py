"""A small tolerant HTML reader: elements and runs of text as a flat list of nodes, in time linear in the page."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from html import unescape

# Element groups of HTML.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
HIDDEN = frozenset("head template svg math select datalist object canvas audio video".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
BLOCK = CLOSES_P | frozenset("html body button caption dd dt legend li listing tbody td tfoot th thead tr".split())
CLOSED_BY = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tbody": ("thead tbody tr td th", "table"), "thead": ("tr td th", "table"), "tfoot": ("tbody tr td th", "table")}
CLOSED_BY = {k: (a.split(), b.split()) for k, (a, b) in CLOSED_BY.items()}

# A quote only opens a value right after =; one that nothing closes is a plain character.
_ATTR = r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+"
_TAG = r"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|" + _ATTR.replace("([^", "(?:[^") + r")*+)(>|\Z)"
MARKUP = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|" + _TAG, re.S)
ATTR = re.compile(_ATTR)
WORD = re.compile(r"[^\W\d_]+")


@dataclass(slots=True)
class Node:
    """An element, or with tag "" a run of text and inline markup; text is set for runs."""

    tag: str
    parent: int
    depth: int
    tokens: tuple[str, ...] = ()
    kids: list[int] = field(default_factory=list)
    text: str = ""
    linked: int = 0


def attribute_words(attributes: str) -> tuple[str, ...]:
    """The words of class, id and role, lower-cased."""
    found = ATTR.findall(attributes)
    return tuple(w for name, a, b, c in found if name.lower() in ("class", "id", "role") for w in WORD.findall((a or b or c).lower()))


def parse(html: str | None) -> list[Node]:
    """Nodes in document order, the root first.

    Only block elements become nodes that hold others. Inline, void and unknown elements belong to the run of text
    they are in and don't part it (a line break is a space); form fields are nodes without text. Scripts, styles and the like, and elements
    that show no text of their own, are passed over with all in them, if they are closed anywhere. A tag that the page's end cuts off is dropped.
    """
    nodes = [Node("#root", -1, 0)]
    stack = [0]
    depths: dict[str, list[int]] = defaultdict(list)  # places in the stack of the open elements of each tag
    inline: Counter[str] = Counter()
    parts: list[str] = []
    linked = 0
    last_close: dict[str, int] = {}
    closers: dict[str, re.Pattern] = {}

    def end_run() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            top = stack[-1]
            nodes[top].kids.append(len(nodes))
            nodes.append(Node("", top, nodes[top].depth + 1, text=text, linked=min(linked, len(text))))
        linked = 0

    def close_down_to(size: int) -> None:
        end_run()
        while len(stack) > size:
            depths[nodes[stack.pop()].tag].pop()
        inline.clear()

    def last(tag: str) -> int:
        return depths[tag][-1] if depths[tag] else 0

    def add(tag: str, attributes: str) -> None:
        nodes[stack[-1]].kids.append(len(nodes))
        nodes.append(Node(tag, stack[-1], nodes[stack[-1]].depth + 1, attribute_words(attributes) if attributes else ()))

    source, at = html or "", 0
    low = source.lower() if len(source.lower()) == len(source) else source
    size = len(source)
    while at < size:
        m = MARKUP.search(source, at)
        stop = m.start() if m else size
        if stop > at:
            text = unescape(source[at:stop])
            parts.append(text)
            if inline["a"]:
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        if m[2] is None or not m[4]:
            continue  # a comment, a declaration or a cut-off tag
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                if depths[tag]:
                    close_down_to(depths[tag][-1])
                else:
                    end_run()
            elif tag == "br":
                parts.append(" ")
            elif inline[tag]:
                inline[tag] -= 1
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in RAW:
            if tag == "textarea":
                add(tag, m[3])
            if tag not in closers:
                closers[tag] = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I)
            close = closers[tag].search(source, at)
            at = close.end() if close else size
            continue
        if tag in HIDDEN:
            if tag == "select":
                add(tag, m[3])
            if tag not in last_close:
                last_close[tag] = low.rfind(f"</{tag}")
            if last_close[tag] >= at and not (tag in ("svg", "math") and m[3].endswith("/")):
                at = _end_of(source, at, tag)
            continue
        if tag == "input":
            add(tag, m[3])
            continue
        if tag not in BLOCK:
            inline[tag] += 1
            continue
        if tag in CLOSES_P and (p := last("p")) > max(last("table"), last("td"), last("button")):
            close_down_to(p)
        if tag in CLOSED_BY:
            closed, within = CLOSED_BY[tag]
            limit = max(map(last, within))
            firsts = [of[k] for of in map(depths.__getitem__, closed) if (k := bisect_right(of, limit)) < len(of)]
            if firsts:
                close_down_to(min(firsts))
        end_run()
        add(tag, m[3])
        if tag != "hr":
            depths[tag].append(len(stack))
            stack.append(len(nodes) - 1)
    end_run()
    return nodes


def _end_of(source: str, at: int, tag: str) -> int:
    """Behind the end tag that closes the element opened before `at`, counting elements of the same tag inside; the last end tag if there are too few."""
    open_, end = 1, at
    for m in re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*>", re.I).finditer(source, at):
        if m[1]:
            open_, end = open_ - 1, m.end()
            if not open_:
                break
        elif not m[0].endswith("/>"):
            open_ += 1
    return end
