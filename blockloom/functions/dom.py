"""One-pass page walker used inside Arrow batches: the only Python in flattening.

A stack of open elements is a sequential fold over a page's markup. Spark can
express it with aggregate() over a token array, but that runs interpreted and
walked in Python and everything after the text nodes stays in the JVM.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from html.entities import html5
from html.parser import HTMLParser

# Elements that never have content.
VOID_TAGS = frozenset((
    "area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link",
    "menuitem", "meta", "param", "source", "track", "wbr",
    "basefont", "bgsound", "command", "frame", "image", "isindex", "nextid", "spacer",
))
# Elements whose text is not ordinary text.
SPECIAL_TEXT_TAGS = ("script", "style", "template", "rt", "rp")
# Elements that keep whitespace-only text as it is.
PRESERVE_TAGS = ("pre", "textarea")
ASCII_SPACE = " \n\t\f\r"
DOCUMENT = "[document]"


@dataclass(slots=True)
class Node:
    """A text node (or a merged element) with the attributes of its element."""

    text: str
    tag: str
    depth: int
    attrs: dict[str, str]
    special: bool
    rooted: bool


class PageWalker(HTMLParser):
    """Collects text nodes in document order, under the first body if there is one.

    An end tag closes up to the nearest open element of its name and is ignored
    without one; there are no implied end tags.
    """

    def __init__(self, excluded: Iterable[str] = (), merged: Iterable[str] = (), keep_blank: bool = False, cut_to_root: bool = True):
        super().__init__(convert_charrefs=False)
        self._excluded = frozenset(excluded)
        self._merged = frozenset(merged)
        self._keep_blank = keep_blank
        self._cut_to_root = cut_to_root
        self._nodes: list[Node] = []
        self._open: list[tuple[str, dict[str, str]]] = []
        self._count: Counter[str] = Counter()
        self._void_seen: Counter[str] = Counter()
        self._run: list[str] = []
        self._pieces: list[str] = []
        # Stack sizes at which the excluded / merged / root element sits, 0 = none.
        self._gone = self._merge_at = self._root = 0
        self._special = 0  # open elements whose text is not ordinary text
        self._has_root = False
        self.failed = False

    def readable(self, html: str | None) -> bool:
        """False if the parser gives up, as it does on some malformed declarations."""
        try:
            self.feed(html or "")
            self.close()
        except AssertionError:
            return False
        return True

    def walk(self, html: str | None) -> list[Node]:
        """The page's text nodes; none of an unreadable page, after which failed is set."""
        self.failed = not self.readable(html)
        if self.failed:
            return []
        self._flush()
        self._pop_to(0)
        if self._has_root and self._cut_to_root:
            return [n for n in self._nodes if n.rooted]
        return self._nodes

    # -- stack ---------------------------------------------------------------

    def _push(self, name: str, attrs: list[tuple[str, str | None]]) -> None:
        self._open.append((name, {k: v or "" for k, v in attrs}))
        self._count[name] += 1
        if name in SPECIAL_TEXT_TAGS:
            self._special += 1
        if self._gone:
            return
        size = len(self._open)
        if name in self._excluded:
            self._gone = size
        elif name == "body" and not self._has_root:
            self._has_root, self._root = True, size
            self._merge_at = 0
            self._pieces.clear()
        elif name in self._merged and not self._merge_at:
            self._merge_at = size

    def _pop_to(self, size: int) -> None:
        if self._merge_at > size:
            if self._pieces:
                name, attrs = self._open[self._merge_at - 1]
                self._emit(" ".join(self._pieces), name, attrs, self._merge_at, False)
            self._merge_at = 0
            self._pieces.clear()
        for name, _ in self._open[size:]:
            self._count[name] -= 1
            if name in SPECIAL_TEXT_TAGS:
                self._special -= 1
        del self._open[size:]
        if self._gone > size:
            self._gone = 0
        if self._root > size:
            self._root = 0

    def _pop(self, name: str) -> None:
        if self._count[name]:
            size = len(self._open) - 1
            while self._open[size][0] != name:
                size -= 1
            self._pop_to(size)

    # -- text ----------------------------------------------------------------

    def _emit(self, text: str, tag: str, attrs: dict[str, str], depth: int, special: bool) -> None:
        self._nodes.append(Node(text, tag, depth - self._root, attrs, special, self._root > 0))

    def _flush(self, special: bool = False) -> None:
        if not self._run:
            return
        text = "".join(self._run)
        self._run.clear()
        if self._gone:
            return
        if not self._keep_blank:
            text = text.strip()
        elif not text.strip(ASCII_SPACE) and not any(self._count[t] for t in PRESERVE_TAGS):
            text = "\n" if "\n" in text else " "
        if not text:
            return
        special = special or self._special > 0
        if self._merge_at:
            if not special:
                self._pieces.append(text)
            return
        name, attrs = self._open[-1] if self._open else (DOCUMENT, {})
        self._emit(text, name, attrs, len(self._open) + 1, special)

    def _declared(self, text: str, special: bool = True) -> None:
        self._flush()
        self._run.append(text)
        self._flush(special)

    def updatepos(self, i, j):
        """Line and column are not needed, and keeping them takes time."""
        return j

    # -- parser events -------------------------------------------------------

    def handle_starttag(self, tag, attrs):
        self._flush()
        if tag in VOID_TAGS:
            self._void_seen[tag] += 1
        else:
            self._push(tag, attrs)

    def handle_startendtag(self, tag, attrs):
        self._flush()
        self._push(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        # An end tag is taken as belonging to an earlier void tag of its name; so
        # after "<br>", "<br/>" stays open, as in the tree the results must match.
        if self._void_seen[tag]:
            self._void_seen[tag] -= 1
            return
        self._flush()
        self._pop(tag)

    def handle_data(self, data):
        self._run.append(data)

    def handle_entityref(self, name):
        self._run.append(html5.get(name + ";") or html5.get(name) or "&" + name)

    def handle_charref(self, name):
        code = int(name[1:], 16) if name[0] in "xX" else int(name)
        char = ""
        if code < 256:  # 128-159 are read as Windows-1252
            char = bytes([code]).decode("cp1252", "ignore")
        if not char and code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF:
            char = chr(code)
        self._run.append(char or "�")

    def handle_comment(self, data):
        self._flush()

    def handle_decl(self, decl):
        self._declared(decl[len("doctype "):])

    def handle_pi(self, data):
        self._declared(data)

    def unknown_decl(self, data):
        if data.upper().startswith("CDATA["):
            self._declared(data[len("CDATA["):], special=False)
        else:
            self._declared(data)
