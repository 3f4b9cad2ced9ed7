"""HTML to leaf blocks: one pass over a page's tags, linear in its length.

A block is the text between two borders of block-level elements, with what describes its
place: the elements above it, each as a tag and the words of its class and id. Broken markup
is read as browsers read it where that decides what a block is: unclosed paragraphs, list
items and table cells end where the next begins, stray end tags are passed over, an inline
element's end does not end a block, comments and tags that never end reach to the end of the
page. Scripts, styles and other texts that no reader sees are skipped.
"""

from __future__ import annotations

import html
import re
from zlib import crc32

#: Sizes of the hashed vectors: elements above a block, the two next above it, words.
ABOVE, NEAR, WORDS = 256, 96, 96

# Fixed values of HTML.
VOID = frozenset("area base basefont bgsound br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
SKIPPED = frozenset("template svg select datalist canvas audio video object button".split())
BLOCK = frozenset(
    "address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
IGNORED = frozenset(("html", "head", "body"))
#: What ends an element that has no end tag: by group, the elements that end each other, and those that hold them.
SIBLINGS = {
    "item": ("li", "ul ol menu dir"),
    "term": ("dt dd", "dl"),
    "cell": ("td th", "tr table"),
    "row": ("tr", "table tbody thead tfoot"),
    "rows": ("tbody thead tfoot", "table"),
    "option": ("option", "select datalist optgroup"),
}
_CELLS = frozenset("td th caption table".split())

_ENDS = {tag: group for group, (ends, _) in SIBLINGS.items() for tag in ends.split()}
_MEMBER: dict[str, list[str]] = {}
for _group, (_own, _holders) in SIBLINGS.items():
    for _tag in (*_own.split(), *_holders.split()):
        _MEMBER.setdefault(_tag, []).append(_group)

#: A tag to its ">" (or to the end of the page; ">" inside a quoted value does not count), or how a comment begins.
_TAG = re.compile(r"""<(?:(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)|(!--)|[!?/])""")
_COMMENT_END = re.compile(r"--!?>")
_NAMES = re.compile(r"""(?:^|[\s"'/])(class|id|role|style|hidden|aria-hidden|itemprop)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_WORD = re.compile(r"[^\W_]+")
#: Longer numbers than this are no character (and Python refuses to read numbers of thousands of digits).
_LONG_NUMBER = re.compile(r"&#(?:[1-9][0-9]{8,}|[xX][1-9a-fA-F][0-9a-fA-F]{7,});?")
_ZEROS = re.compile(r"&#(?:0{8,}+(?=[0-9])|([xX])0{8,}+(?=[0-9a-fA-F]))")


def decode(text: str) -> str:
    """Character references decoded once."""
    if "&" not in text:
        return text
    return html.unescape(_LONG_NUMBER.sub("�", _ZEROS.sub(r"&#\1", text)))


def _bucket(name: str, size: int) -> int:
    return crc32(name.encode()) % size


class Block:
    """A block: its text, the share of it in links, and the hashed names of what it lies in."""

    __slots__ = ("above", "linked", "near", "text")

    def __init__(self, text: str, linked: float, above: tuple[int, ...], near: tuple[int, ...]):
        self.text, self.linked, self.above, self.near = text, linked, above, near

    def words(self) -> list[int]:
        return [crc32(w.encode()) % WORDS for w in _WORD.findall(self.text.lower())]


_NAMED: dict[tuple[str, str], tuple[tuple[int, ...], tuple[str, ...]]] = {}


def _names(tag: str, attributes: str) -> tuple[tuple[int, ...], tuple[str, ...]]:
    """Buckets and names of an element; kept for the elements met before."""
    key = (tag, attributes)
    found = _NAMED.get(key)
    if found is None:
        names = [tag]
        if attributes.strip("/ "):
            for name, *values in _NAMES.findall(attributes):
                name, value = name.lower(), "".join(values)
                if name in ("hidden", "aria-hidden"):
                    names += [] if value.lower() == "false" else ["~hidden"]
                elif name == "style":
                    names += ["~hidden"] if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE) else []
                else:
                    names += ["." + p.lower() for p in _PARTS.findall(value)]
        names = list(dict.fromkeys(names))
        found = tuple({_bucket(n, ABOVE) for n in names}), tuple(names)
        if len(_NAMED) > 20_000 or len(attributes) > 2000:
            _NAMED.clear()
        _NAMED[key] = found
    return found


class _Reader:
    """The open elements and the block that is being read."""

    def __init__(self):
        self.stack: list[tuple[str, tuple[int, ...], tuple[str, ...]]] = []
        self.open: dict[str, list[int]] = {}  # tag -> places on the stack
        self.groups: dict[str, list[tuple[int, str]]] = {g: [] for g in SIBLINGS}
        self.solid: list[int] = []  # places of block-level elements
        self.cells: list[int] = []
        self.active: dict[int, int] = {}
        self.skipping = 0
        self.parts: list[str] = []
        self.links = 0
        self.place: tuple[tuple[int, ...], tuple[int, ...]] | None = None
        self.blocks: list[Block] = []

    def flush(self) -> None:
        if self.parts:
            raw = "".join(self.parts)
            text = " ".join(raw.split())
            if text:
                above, near = self.place
                self.blocks.append(Block(text, min(1.0, self.links / len(raw)), above, near))
            self.parts, self.links, self.place = [], 0, None

    def add(self, text: str) -> None:
        if self.skipping or not text:
            return
        text = decode(text)
        if self.place is None and not text.isspace():
            near = []
            for depth, at in enumerate(self.solid[-1:-3:-1]):
                near += [_bucket(f"{depth}{n}", NEAR) for n in self.stack[at][2]]
            self.place = tuple(self.active), tuple(dict.fromkeys(near))
        self.parts.append(text)
        if self.open.get("a"):
            self.links += len(text)

    def push(self, tag: str, attributes: str) -> None:
        at = len(self.stack)
        buckets, names = _names(tag, attributes)
        self.stack.append((tag, buckets, names))
        self.open.setdefault(tag, []).append(at)
        for b in buckets:
            self.active[b] = self.active.get(b, 0) + 1
        for group in _MEMBER.get(tag, ()):
            self.groups[group].append((at, tag))
        if tag in BLOCK or "-" in tag:
            self.solid.append(at)
        if tag in _CELLS:
            self.cells.append(at)
        self.skipping += tag in SKIPPED

    def pop_to(self, place: int) -> None:
        """Close the element at a place of the stack and all above it."""
        while len(self.stack) > place:
            tag, buckets, _ = self.stack.pop()
            at = len(self.stack)
            self.open[tag].pop()
            for b in buckets:
                if self.active[b] == 1:
                    del self.active[b]
                else:
                    self.active[b] -= 1
            for group in _MEMBER.get(tag, ()):
                self.groups[group].pop()
            if self.solid and self.solid[-1] == at:
                self.solid.pop()
            if tag in _CELLS:
                self.cells.pop()
            self.skipping -= tag in SKIPPED

    def start(self, tag: str, attributes: str) -> None:
        if tag in IGNORED:
            return
        if tag in BLOCK or "-" in tag or tag in SKIPPED:
            self.flush()
        if tag in BLOCK and self.open.get("p"):  # only inline elements lie in a paragraph
            self.pop_to(self.open["p"][-1])
        group = _ENDS.get(tag)
        if group is not None and self.groups[group]:
            at, other = self.groups[group][-1]
            if _ENDS.get(other) == group:
                self.pop_to(at)
        if tag == "br":
            self.add(" ")
        if tag not in VOID:
            self.push(tag, attributes)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.add(" ")
        places = self.open.get(tag)
        if not places:
            return
        at = places[-1]
        if tag in BLOCK or "-" in tag or tag in SKIPPED:
            if tag not in _CELLS and self.cells and at < self.cells[-1] and not _MEMBER.get(tag):
                return  # opened outside of this table
            self.flush()
            self.pop_to(at)
        elif not self.solid or at > self.solid[-1]:
            self.pop_to(at)


def read(page: str) -> list[Block]:
    """The blocks of a page, in order."""
    reader, at, size = _Reader(), 0, len(page)
    while at < size:
        tag = _TAG.search(page, at)
        if tag is None:
            reader.add(page[at:])
            break
        if tag.start() > at:
            reader.add(page[at : tag.start()])
        at = tag.end()
        name = tag[2]
        if name is None:
            if tag[4]:
                end = _COMMENT_END.search(page, tag.start() + 2)
                at = end.end() if end else size
            else:
                at = page.find(">", at - (tag[0] == "<>")) + 1 or size
            continue
        name = name.lower()
        if tag[1]:
            reader.end(name)
        elif name in RAW:
            end = _raw_end(name).search(page, at)
            at = end.start() if end else size
        else:
            reader.start(name, tag[3])
    reader.flush()
    return reader.blocks


_RAW_ENDS: dict[str, re.Pattern] = {}


def _raw_end(name: str) -> re.Pattern:
    if name not in _RAW_ENDS:
        _RAW_ENDS[name] = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE)
    return _RAW_ENDS[name]
