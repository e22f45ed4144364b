"""HTML as a sequence of leaf blocks: text between block boundaries, with its path of tags."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>\"'<]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>\"'<]*)([^>]*)>"
    r"|<[!?/][^>]*>",
    re.S,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[a-z]+")

#: Elements whose content is not markup; it ends with their own end tag, else with the page.
RAW = frozenset("script style noscript iframe title textarea".split())
#: Other elements whose content is never text of the page; they end with their parent at last.
HIDDEN = frozenset("template select svg object canvas".split())
#: Elements that begin and end a block.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html label "
    "legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead "
    "tr ul".split()
)
_EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: A start tag ends these elements if they are open.
_ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
_SCOPES = frozenset("ul ol dl table tr select".split())
#: So many innermost ancestors are named in a path one by one; of the others, each name once.
_DEPTH = 24


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    linked: int
    place: int


def blocks(page: str) -> list[Block]:
    """The blocks of a page that hold text, in order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    held: Counter[str] = Counter()  # names of all open elements
    linked = links = 0
    hidden: int | None = None  # place of the outermost open element of HIDDEN

    def end_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                path: list[str] = []
                for _, names in stack[-_DEPTH:]:
                    path.extend(names)
                if len(stack) > _DEPTH:
                    path[:0] = [name for name in held if name not in path]
                out.append(Block(text, tuple(path), linked, len(out)))
            parts.clear()
        linked = 0

    def close(to: int) -> None:
        nonlocal links, hidden
        for tag, names in stack[to:]:
            links -= tag == "a"
            held.subtract(names)
            for name in names:
                if not held[name]:
                    held.pop(name, None)
        del stack[to:]
        if hidden is not None and to <= hidden:
            hidden = None

    at, end = 0, len(page)
    while at < end:
        found = _TOKEN.search(page, at)
        stop = found.start() if found else end
        if stop > at and hidden is None:
            parts.append(page[at:stop])
            if links:
                linked += stop - at
        if not found:
            break
        at = found.end()
        tag = found.group(2) or found.group(5)
        if not tag:
            continue
        tag = tag.lower()
        if found.group(1) or found.group(4):
            if tag in BLOCKS and hidden is None:
                end_block()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag in BLOCKS and hidden is not None and i < hidden:
                        end_block()
                    close(i)
                    break
                if tag not in BLOCKS and tag not in HIDDEN and stack[i][0] in BLOCKS:
                    break
            continue
        if tag in RAW:
            match = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = match.end() if match else end
            continue
        attributes = found.group(3) or found.group(6) or ""
        if hidden is not None or tag in HIDDEN:
            if tag not in _EMPTY and not attributes.endswith("/"):
                hidden = len(stack) if hidden is None else hidden
                stack.append((tag, (tag,)))
                held[tag] += 1
                links += tag == "a"
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCKS:
            end_block()
            for i in range(len(stack) - 1, -1, -1):  # an open paragraph ends here
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in BLOCKS:
                    break
            ended = _ENDS.get(tag)
            if ended:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ended:
                        close(i)
                        break
                    if stack[i][0] in _SCOPES:
                        break
        if tag in _EMPTY or attributes.endswith("/") and tag not in BLOCKS:
            continue
        names = [tag]
        for match in _NAMES.finditer(attributes):
            value = match.group(1) or match.group(2) or match.group(3) or ""
            names.extend(f".{x}" for x in _PARTS.findall(value.lower()))
        stack.append((tag, tuple(names)))
        held.update(names)
        links += tag == "a"
    end_block()
    return out
