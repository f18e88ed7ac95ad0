"""Leaf blocks of a page: runs of text between block elements, with the elements above them."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: Elements that begin and end blocks, that hold no text of the page, that have no end tag.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul button label".split()
)
RAW = frozenset("script style title textarea iframe xmp noembed template svg math object canvas video audio".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Open elements that a start tag closes, and the elements that shield what is outside them.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "body": {"head"}}
SHIELD = frozenset("ul ol dl table select body html div section article".split())

#: Elements nested deeper are siblings at this depth, as browsers have it.
DEEPEST = 512

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+|[^>]*)>", re.S)
_NAMES = re.compile(r"""(?<![\w-])(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


@dataclass
class Block:
    """text: decoded, white space as one space. path: (tag, names) from the root; linked: characters inside links."""

    text: str
    path: tuple[tuple[str, str], ...]
    linked: int


@dataclass
class _Parser:
    stack: list[tuple[str, str]] = field(default_factory=list)
    runs: list[str] = field(default_factory=list)
    linked: int = 0
    links: int = 0
    out: list[Block] = field(default_factory=list)

    def flush(self) -> None:
        if self.runs:
            text = " ".join("".join(self.runs).split())
            if text:
                self.out.append(Block(text, tuple(self.stack), self.linked))
            self.runs.clear()
        self.linked = 0

    def text(self, raw: str) -> None:
        got = html.unescape(raw) if "&" in raw else raw
        self.runs.append(got)
        if self.links:
            self.linked += len(got.strip())

    def open(self, tag: str, attrs: str) -> None:
        if tag == "br":
            self.runs.append(" ")
            return
        if tag == "a":
            self.links = 1
        if tag not in BLOCKS:
            return
        self.flush()
        self.links = 0
        if tag not in ("option", "button", "label", "legend"):
            self.close_open({"p"}, SHIELD - {"body"} | {"button"})
        if tag in CLOSES:
            self.close_open(CLOSES[tag], SHIELD if tag != "body" else frozenset())
        if tag not in VOID:
            if len(self.stack) == DEEPEST:
                self.stack.pop()
            names = " ".join(x for m in _NAMES.findall(attrs) for x in m if x) if "=" in attrs else ""
            self.stack.append((tag, names.lower()))

    def close_open(self, tags: set[str], shield: frozenset[str] | set[str]) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in tags:
                del self.stack[i:]
                return
            if self.stack[i][0] in shield:
                return

    def close(self, tag: str) -> None:
        if tag == "a":
            self.links = 0
        if tag not in BLOCKS:
            return
        self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order; scripts, styles, titles and comments give none.

    Takes time in proportion to the page: no tag is sought beyond the last `>`, where only a comment can begin.
    """
    p, at, n, ends = _Parser(), 0, len(page), {}
    last = page.rfind(">") + 1
    while at < last:
        m = _TAG.search(page, at, last)
        if m is None:
            break
        if m.start() > at:
            p.text(page[at : m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            if at == last and _unclosed(m[0]):
                at = n
            continue
        if m[1]:
            p.close(tag)
        elif tag in RAW:
            if not m[3].rstrip().endswith("/"):
                if tag not in ends:
                    ends[tag] = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I)
                end = ends[tag].search(page, at, last)
                at = end.end() if end else n
        else:
            p.open(tag, m[3])
    if at < n:
        rest = page[at:]
        p.text(rest[: min((i for i in map(rest.find, _OPENINGS) if i >= 0), default=n)])
    p.flush()
    return p.out


_OPENINGS = ("<!--", "<![CDATA[")


def _unclosed(markup: str) -> bool:
    """Whether a comment or a CDATA section lacks its end."""
    return markup.startswith(_OPENINGS[0]) and not markup.endswith("-->") or markup.startswith(_OPENINGS[1]) and not markup.endswith("]]>")
