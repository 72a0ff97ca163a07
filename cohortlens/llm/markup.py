"""HTML pages as trees of block elements with their text."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

# Element names of HTML by what they do to a block of text.
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("html head body title address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                  "frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li listing main menu nav noscript object ol optgroup option p plaintext pre search section "
                  "select summary table tbody td template textarea tfoot th thead tr ul script style iframe svg math video audio canvas button".split())
#: Elements that never hold text to be read.
SILENT = frozenset("script style head title noscript template svg math iframe object video audio canvas button select option optgroup textarea datalist "
                   "xmp noembed noframes frameset".split())
#: Start tags that end an open paragraph.
ENDS_P = BLOCK - frozenset("html head body title script style noscript template svg math video audio canvas button select option optgroup object "
                           "textarea iframe caption tbody td tfoot th thead tr legend".split())
#: Start tags that end open elements of these names, not beyond the elements after the bar.
ENDS = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th caption", "table"), "td": ("td th", "tr table"),
        "th": ("td th", "tr table"), "tbody": ("tr td th thead tbody tfoot caption", "table"), "thead": ("tr td th thead tbody tfoot caption", "table"),
        "tfoot": ("tr td th thead tbody tfoot caption", "table"), "option": ("option", "select"), "optgroup": ("option optgroup", "select")}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
#: Elements that end tags of others don't reach out of, unless they are tables' own.
WALLS = frozenset("td th caption table template html button object".split())
TABLE = frozenset("table tr td th tbody thead tfoot caption".split())

# One markup item: a comment, an end tag, a start tag, a declaration. A quote
# counts after "=" only; nothing is scanned twice (possessive repeats).
_ITEM = re.compile(r"<(?:!--(?:>|->|(?s:.*?)(?:--!?>|\Z))|/([a-zA-Z][^\s/>]*+)[^>]*+>|([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>|[!?/][^>]*+>)")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_WANTED = re.compile(r"(?i)\b(?:class|id|role|itemprop|href|hidden)\b")


@dataclass(slots=True)
class Node:
    """A block element, or an inline one with a class, id or role."""

    tag: str
    names: str
    parent: int
    block: bool
    link: bool = False
    words: str = ""
    children: list[int] = field(default_factory=list)


@dataclass(slots=True)
class Text:
    """A block of text: its pieces by the element that they stand in."""

    node: int
    pieces: list[tuple[int, str, bool]]

    def joined(self, drop=frozenset()) -> str:
        """The text without pieces in dropped elements, references decoded, white space as single spaces."""
        return " ".join("".join(t for n, t, _ in self.pieces if n not in drop).split())


def _attributes(text: str) -> tuple[str, str, bool]:
    """(class, id and role names; itemprop and role; whether it links)."""
    if not text or not _WANTED.search(text):
        return "", "", False
    found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(text)}
    names = " ".join(found[k] for k in ("class", "id") if found.get(k))
    return html.unescape(names), f"{found.get('role', '')} {found.get('itemprop', '')}".strip(), "href" in found


def parse(page: str) -> tuple[list[Node], list[Text]]:
    """The elements and the blocks of text of a page, in page order.

    Elements end as browsers end them as far as text blocks are concerned:
    raw text elements at their own end tag, paragraphs, items, rows and cells
    at the next that they can't hold, inline elements with their block; an
    end tag without its start is ignored (that of a paragraph still ends the
    block). Text is never lost: markup that is
    cut off at the end of the page (a "<" without its end) counts as text
    only where no tag begins there."""
    nodes = [Node("", "", -1, True)]
    texts: list[Text] = []
    stack = [0]
    pieces: list[tuple[int, str, bool]] = []
    links = 0
    opened: Counter[str] = Counter()

    def flush():
        nonlocal pieces
        if pieces:
            if any(t.strip() for _, t, _ in pieces):
                at = stack[-1]
                while not nodes[at].block:
                    at = nodes[at].parent
                texts.append(Text(at, pieces))
            pieces = []

    def add(raw: str):
        if raw:
            pieces.append((stack[-1], html.unescape(raw) if "&" in raw else raw, links > 0))

    def close(depth: int):
        """End the open elements from ``depth`` on."""
        nonlocal links
        if any(nodes[n].block for n in stack[depth:]):
            flush()
        for n in stack[depth:]:
            opened[nodes[n].tag] -= 1
            if nodes[n].tag == "a" and nodes[n].link:
                links -= 1
        del stack[depth:]

    at, size, last = 0, len(page), page.rfind(">") + 1
    while at < size:
        m = _ITEM.search(page, at, last) if at < last else None
        if m is None:
            rest = page[at:]
            cut = re.search(r"<[a-zA-Z/!?]", rest)
            add(rest[:cut.start()] if cut else rest)
            break
        add(page[at:m.start()])
        at = m.end()
        if end := m.group(1):
            end = end.lower()
            block = end in BLOCK
            for depth in range(len(stack) - 1, 0, -1) if opened[end] else ():
                tag = nodes[stack[depth]].tag
                if tag == end:
                    close(depth)
                    break
                if (tag in WALLS and end not in TABLE and end not in ("body", "html")) or (not block and nodes[stack[depth]].block):
                    break
            else:
                if end == "p":
                    flush()
            continue
        if not (tag := m.group(2)):
            continue
        tag, text = tag.lower(), m.group(3)
        if tag == "br":
            add(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        block = tag in BLOCK
        if tag in ENDS_P and opened["p"]:
            for depth in range(len(stack) - 1, 0, -1):
                if nodes[stack[depth]].tag == "p":
                    close(depth)
                    break
                if nodes[stack[depth]].tag in WALLS:
                    break
        if tag in ENDS:
            ended, walls = ENDS[tag]
            lowest = None
            for depth in range(len(stack) - 1, 0, -1) if any(opened[e] for e in ended) else ():
                if nodes[stack[depth]].tag in walls:
                    break
                if nodes[stack[depth]].tag in ended:
                    lowest = depth
            if lowest is not None:
                close(lowest)
        names, words, link = _attributes(text)
        if block:
            flush()
        if tag in RAW:
            # Up to the element's own end tag, whatever stands in between.
            stop = re.compile(rf"(?i)</{tag}(?=[\s/>])[^>]*+>").search(page, at)
            at = stop.end() if stop else size
            continue
        if tag == "plaintext":
            add(page[at:])
            break
        if tag == "a" and link and links:
            # A link can't hold a link: the open one ends.
            depth = max(i for i, n in enumerate(stack) if nodes[n].tag == "a" and nodes[n].link)
            if not any(nodes[n].block for n in stack[depth:]):
                close(depth)
        # Inline elements that say nothing of their own need no node.
        if block or names or words or (tag == "a" and link):
            node = len(nodes)
            nodes.append(Node(tag, names, stack[-1], block, link, words))
            nodes[stack[-1]].children.append(node)
            stack.append(node)
            opened[tag] += 1
            if tag == "a" and link:
                links += 1
    flush()
    return nodes, texts
