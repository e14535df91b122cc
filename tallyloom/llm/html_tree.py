"""A light HTML reader: the tree of block elements with their statistics, and the text blocks in page order."""

from __future__ import annotations

import re
from html import unescape

# Quotes hold a value only after "=".
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:\-]*)((?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*')|=)*)(>|\Z)", re.S)
_ATTR = re.compile(r"\b(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")
#: Elements whose text is never shown, or is a form's.
SKIP = frozenset("script style template iframe head title textarea select datalist annotation annotation-xml".split())
_RAW = frozenset("script style textarea title iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img br ruby rb rt rp input math svg object canvas audio video noscript".split())
#: Inside these all elements are inline but those that end them.
_DRAWN = frozenset(("math", "svg"))
#: A start tag ends an open element of the second set, up to one of the third.
_P_ENDERS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_P_ENDS = (frozenset({"p"}), frozenset({"table", "td", "th", "button"}))
_ENDS = {n: (frozenset(a.split()), frozenset(b.split())) for n, a, b in (("li", "li", "ul ol menu"), ("dt", "dt dd", "dl"), ("dd", "dt dd", "dl"), ("tr", "tr td th", "table"), ("td", "td th", "tr table"), ("th", "td th", "tr table"), ("option", "option", "select"))}


class Page:
    """Block elements as parallel lists, parents before children; node 0 is the page.

    tag, parent, depth, attrs (words of class, id and role), start and end (text characters before it, and up to its end),
    and of its own text without that of block children: chars, link_chars, words, marks (commas and full stops), inputs.
    blocks: (node, text) in page order.
    """

    def __init__(self, html: str):
        self.tag, self.parent, self.depth, self.attrs = ["#page"], [-1], [0], [()]
        self.chars, self.link_chars, self.words, self.marks, self.inputs, self.inner = [0], [0], [0], [0], [0], [0]
        self.start, self.end = [0], [0]
        self.blocks: list[tuple[int, str]] = []
        self._read(html)

    def _read(self, html: str) -> None:
        stack: list[tuple[str, int, bool]] = [("#page", 0, False)]  # name, its node or that of the block around it, whether it is inline
        spots: dict[str, list[int]] = {"#page": [0]}  # where on the stack each name is open
        unclosed: set[str] = set()  # skipped elements that no end tag follows any more
        node, link, total, at = 0, 0, 0, 0
        held: list[str] = []
        match, size = _TOKEN.match, len(html)

        def flush() -> None:
            if held:
                text = _SPACE.sub(" ", unescape("".join(held))).strip()
                held.clear()
                if text:
                    self.blocks.append((node, text))

        def pop(k: int) -> None:
            nonlocal node, link
            while len(stack) > k:
                name, _, inline = stack.pop()
                spots[name].pop()
                if name == "a":
                    link -= 1
                elif not inline:
                    flush()
                    self.end[node] = total
                    node = stack[-1][1]

        def push(name: str, at: int, inline: bool) -> None:
            spots.setdefault(name, []).append(len(stack))
            stack.append((name, at, inline))

        def last(names: frozenset[str]) -> int:
            """The highest place on the stack of any of the names; -1 if none is open."""
            return max((spots[x][-1] for x in names if spots.get(x)), default=-1)

        while at < size:
            lt = html.find("<", at)
            if lt < 0:
                lt = size
            m = match(html, lt) if lt < size else None
            stop = lt if m is not None else min(lt + 1, size)  # a bare "<" is text
            if stop > at:
                piece = html[at:stop]
                held.append(piece)
                n = len(piece)
                total += n
                self.chars[node] += n
                self.words[node] += piece.count(" ") + 1
                self.marks[node] += piece.count(",") + piece.count(".")
                if link:
                    self.link_chars[node] += n
            if m is None:
                at = stop
                continue
            at = m.end()
            name = m[2]
            if name is None or (not m[4] and at == size):  # a comment, or a tag that is cut off
                continue
            name = name.lower()
            if m[1]:
                if spots.get(name):
                    pop(spots[name][-1])
                continue
            if name in SKIP:
                if name not in INLINE:
                    held.append(" ")
                if not m[3].endswith("/"):
                    close = None if name in unclosed else re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                    if close is None:
                        unclosed.add(name)
                    at = close.end() if close else (size if name in _RAW else at)
                continue
            drawn = last(_DRAWN)
            if drawn > 0 and name in _P_ENDERS:  # a block ends a drawing
                pop(drawn)
                drawn = -1
            if name in INLINE or name in VOID or drawn > 0:
                self.inner[node] += 1
                if name == "input":
                    self.inputs[node] += 1
                if name == "br":
                    held.append(" ")
                elif name == "hr":
                    flush()
                if name not in VOID and not m[3].endswith("/"):
                    push(name, node, True)
                    link += name == "a"
                continue
            if name in _P_ENDERS or name in _ENDS:
                ends, stops = _ENDS.get(name, _P_ENDS)
                while (k := last(ends)) > max(last(stops), 0):
                    pop(k)
                    if name != "tr":
                        break
            flush()
            words: list[str] = []
            if "=" in m[3]:
                for a in _ATTR.finditer(m[3]):
                    words += re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", a[2] or a[3] or a[4] or "").lower())
            self.tag.append(name)
            self.parent.append(node)
            self.depth.append(self.depth[node] + 1)
            self.attrs.append(tuple(words))
            for x in (self.chars, self.link_chars, self.words, self.marks, self.inputs, self.inner, self.end):
                x.append(0)
            self.start.append(total)
            node = len(self.tag) - 1
            if name in ("button",):
                self.inputs[node] += 1
            push(name, node, False)
        pop(1)
        flush()
        self.end[0] = total
