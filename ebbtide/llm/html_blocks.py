"""Web pages as sequences of leaf blocks: what stands between two block-level tags.

The reader forgives what browsers forgive: missing and stray end tags, unquoted attributes,
comments, scripts that contain tags, an end in the middle of a tag.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

# Element kinds of the HTML standard.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead "
    "title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style template textarea title xmp".split())
#: Opening one of these ends an open one of those, up to the nearest of the third.
ENDS = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
    "body": (frozenset({"head"}), frozenset({"html"})),
}
#: An end tag does not reach through these unless it names them.
HOLDS = frozenset("td th table body html".split())

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
QUOTE = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(
    r"""(?<![\w-])(class|id|role|data-main)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
TOKEN = re.compile(r"[a-z0-9]+")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|$)", re.I) for tag in RAW}


class Frame(NamedTuple):
    """An open element: tag, words of class, id and role, and the label if it has one."""

    tag: str
    tokens: tuple[str, ...]
    main: str | None


class Block(NamedTuple):
    """Text of a leaf block, its ancestors from the outermost, and characters in links."""

    text: str
    path: tuple[Frame, ...]
    linked: int


def _tag_end(page: str, at: int) -> int:
    """Where the tag that begins before ``at`` has its >, or the length of the page."""
    while True:
        found = QUOTE.search(page, at)
        if not found:
            return len(page)
        if found.group() == ">":
            return found.start()
        at = found.end()
        if page[max(0, found.start() - 3):found.start()].rstrip().endswith("="):
            close = page.find(found.group(), at)
            at = close + 1 if close >= 0 else at


def _frame(tag: str, inside: str) -> Frame:
    tokens, main = [], None
    if "=" in inside:
        for name, a, b, c in ATTRIBUTE.findall(inside):
            value = html.unescape(a or b or c).lower()
            if name.lower() == "data-main":
                main = value
            else:
                tokens += TOKEN.findall(value)
    return Frame(tag, tuple(tokens), main)


def _close(stack: list[Frame], tags: frozenset[str], until: frozenset[str]) -> None:
    for i in range(len(stack) - 1, -1, -1):
        if stack[i].tag in tags:
            del stack[i:]
            return
        if stack[i].tag in until:
            return


P = frozenset({"p"})
P_HOLDERS = BLOCK - P


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks that have text, in page order."""
    found: list[Block] = []
    if not page:
        return found
    stack: list[Frame] = []
    texts: list[str] = []
    links, linked, at, size = 0, 0, 0, len(page)

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(texts).split())
        if text:
            found.append(Block(text, tuple(stack), linked))
        texts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            texts.append(text)
            linked += len(text) if links else 0

    while at < size:
        open_ = page.find("<", at)
        if open_ < 0:
            add(page[at:])
            break
        follows = page[open_ + 1:open_ + 2]
        if follows in ("!", "?"):
            add(page[at:open_])
            if page.startswith("<!--", open_):
                end = page.find("-->", open_ + 4)
                # <!--> and <!---> are whole comments.
                short = re.match(r"<!---?>", page[open_:open_ + 6])
                at = open_ + short.end() if short else size if end < 0 else end + 3
            else:
                end = page.find(">", open_)
                at = size if end < 0 else end + 1
            continue
        closing = follows == "/"
        name = NAME.match(page, open_ + 1 + closing)
        if not name:
            add(page[at:open_ + 1])
            at = open_ + 1
            continue
        add(page[at:open_])
        tag = name.group().lower()
        end = _tag_end(page, name.end())
        inside = page[name.end():end]
        at = end + 1
        if tag in RAW and not closing:
            if tag in BLOCK:
                flush()
            close = RAW_END[tag].search(page, at)
            at = _tag_end(page, close.end()) + 1 if close else size
            continue
        if tag == "a":
            links = 0 if closing else 1
            continue
        if tag in VOID and tag != "hr":
            if tag == "br":
                texts.append(" ")
            continue
        if tag not in BLOCK:
            continue
        flush()
        if closing:
            if any(f.tag == tag for f in stack):
                _close(stack, frozenset({tag}), HOLDS - {tag})
            links = 0
            continue
        if tag == "hr":
            continue
        if any(f.tag == "p" for f in stack):
            _close(stack, P, P_HOLDERS)
        if tag in ENDS:
            _close(stack, *ENDS[tag])
        stack.append(_frame(tag, inside))
    flush()
    return found
