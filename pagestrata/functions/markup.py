"""Pages to flat node columns: the standard library's tokeniser and a stack of open elements.

For each element the reader notes its offsets into two texts it writes on the way, canonical HTML and decoded text, and a digest of its markup, in
which each child stands with its own digest: equal digests mean equal markup, and no markup is hashed once per enclosing element. Selecting, comparing and
labelling happen in Spark on those columns. Tree rules are those that matter for real pages: void elements, implied end tags and table
parts, and formatting that was left open and goes on in the next block (``<p><b>a<p>b``). Of formatting left open the last 64 elements go on;
a page that leaves more open would otherwise grow with the square of its size.
"""

from __future__ import annotations

import re
from collections import Counter
from hashlib import blake2b
from html.parser import HTMLParser

# Element groups of the HTML standard.
VOID = frozenset("area base br col embed hr img input keygen link meta param source track wbr".split())
HEAD_ONLY = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
BLOCKS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer "
    "form header hgroup listing main menu nav ol p pre search section summary ul".split()
)
SCOPE = frozenset("applet button caption html marquee object table td template th".split())
SECTIONS = frozenset(("tbody", "tfoot", "thead"))
CELLS = frozenset(("td", "th"))
TABLE_SCOPE = frozenset(("html", "table", "template"))
LIST_STOPS = SCOPE | (BLOCKS - {"address", "div", "p"}) | HEADINGS
#: Start tag -> open elements that it ends, each up to the given stops.
ENDS = {
    **dict.fromkeys((*BLOCKS, *HEADINGS, "hr"), [(frozenset("p"), SCOPE)]),
    "li": [(frozenset(("li",)), LIST_STOPS), (frozenset("p"), SCOPE)],
    **dict.fromkeys(("dd", "dt"), [(frozenset(("dd", "dt")), LIST_STOPS), (frozenset("p"), SCOPE)]),
    "button": [(frozenset(("button",)), SCOPE - {"button"})],
    **dict.fromkeys(CELLS, [(CELLS, TABLE_SCOPE)]),
    "tr": [(CELLS | {"caption"}, TABLE_SCOPE), (frozenset(("tr",)), TABLE_SCOPE)],
    **dict.fromkeys(SECTIONS, [(CELLS | {"caption"}, TABLE_SCOPE), (frozenset(("tr",)), TABLE_SCOPE), (SECTIONS, TABLE_SCOPE)]),
}
#: Table part -> the element it needs around it.
NEEDS = {**dict.fromkeys(CELLS, (frozenset(("tr",)), "tr")), "tr": (SECTIONS, "tbody")}

#: So much formatting goes on in the next block at most.
MOST_FORMATTING = 64

_ESCAPES = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", "'": "&#39;", '"': "&#34;", "\r": "&#13;"})


def _digest(pieces) -> bytes:
    return blake2b("".join(pieces).encode("utf-8", "surrogatepass"), digest_size=16).digest()


class Node:
    """One element and its offsets; ``html_end`` is -1 while the element is open, and ``digest`` holds its pieces of markup until it ends."""

    __slots__ = (
        "node_id", "parent_id", "last_desc_id", "depth", "tag", "attrs",
        "html_start", "inner_start", "inner_end", "html_end", "text_start", "text_end", "digest",
    )


class Reader(HTMLParser):
    """Nodes, canonical HTML and text of one page; ``read`` fills them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[Node] = []
        self.canon = self.text = ""
        self._html: list[str] = []
        self._texts: list[str] = []
        self._at = self._text_at = 0
        self._open: list[Node] = []
        self._open_tags: Counter[str] = Counter()
        self._formatting: list[Node] = []  # opened and not ended by their own tag
        self._seen: set[str] = set()

    def read(self, source: str) -> Reader:
        self.feed(source.replace("\x00", "").replace("\r\n", "\n").replace("\r", "\n"))
        self.close()
        while self._open:
            self._pop()
        self.canon, self.text = "".join(self._html), "".join(self._texts)
        return self

    def _write(self, piece: str) -> None:
        self._html.append(piece)
        self._at += len(piece)
        if self._open:
            self._open[-1].digest.append(piece)

    def _push(self, tag: str, attrs: dict[str, str] | None = None) -> Node:
        node = Node()
        node.node_id = node.last_desc_id = len(self.nodes)
        node.parent_id = self._open[-1].node_id if self._open else -1
        node.depth, node.tag, node.attrs = len(self._open), tag, attrs
        node.html_start, node.html_end = self._at, -1
        node.text_start = node.text_end = self._text_at
        inner = "".join(f' {k}="{v.translate(_ESCAPES)}"' for k, v in (attrs or {}).items())
        self.nodes.append(node)
        node.digest = []
        if tag not in VOID:
            self._open.append(node)
            self._open_tags[tag] += 1
        self._write(f"<{tag}{inner}/>" if tag in VOID else f"<{tag}{inner}>")
        node.inner_start = node.inner_end = self._at
        if tag in VOID:
            node.html_end = self._at
            node.digest = _digest((f"<{tag}{inner}/>",))
        return node

    def _pop(self) -> Node:
        node = self._open[-1]
        node.inner_end, node.text_end = self._at, self._text_at
        self._html.append(f"</{node.tag}>")
        self._at += len(node.tag) + 3
        self._open.pop()
        self._open_tags[node.tag] -= 1
        node.digest = _digest(node.digest)
        if self._open:
            self._open[-1].digest.append("\x00" + node.digest.hex())  # read() takes this character out of the page
        node.html_end, node.last_desc_id = self._at, len(self.nodes) - 1
        if node.tag in CELLS:  # formatting does not go on beyond a cell
            self._formatting = [f for f in self._formatting if f.node_id < node.node_id]
        return node

    def _top(self) -> str:
        return self._open[-1].tag if self._open else ""

    def _in_scope(self, wanted, stops) -> bool:
        if not any(self._open_tags[tag] for tag in wanted):
            return False
        for node in reversed(self._open):
            if node.tag in wanted:
                return True
            if node.tag in stops:
                return False
        return False

    def _end(self, wanted, stops=SCOPE) -> bool:
        """End the nearest of the wanted elements and all in it, if none of the stops is in between."""
        if not self._in_scope(wanted, stops):
            return False
        while self._pop().tag not in wanted:
            pass
        return True

    def _resume(self) -> None:
        """Open again the formatting that ended with its block; of equal ones the last three."""
        if not self._formatting or self._formatting[-1].html_end < 0:
            return
        closed = [i for i, f in enumerate(self._formatting) if f.html_end >= 0]
        for i in closed:
            self._formatting[i] = self._push(self._formatting[i].tag, self._formatting[i].attrs)

    # -- tokens ---------------------------------------------------------

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "head", "body"):
            if tag in self._seen or (tag == "head" and "body" in self._seen):
                return
            self._seen.add(tag)
        values: dict[str, str] = {}
        for name, value in attrs:
            values.setdefault(name, value or "")
        if self._top() == "head" and tag not in HEAD_ONLY:
            self._pop()
        for wanted, stops in ENDS.get(tag, ()):
            self._end(wanted, stops)
        if tag in HEADINGS and self._top() in HEADINGS or tag in ("option", "optgroup") and self._top() == "option":
            self._pop()
        if tag in NEEDS and self._in_scope(("table",), ("html",)):
            self._complete(tag)
        if tag in FORMATTING:
            if tag == "a":
                self._end_formatting("a")
            self._resume()
            same = [f for f in self._formatting if f.tag == tag and f.attrs == (values or None)]
            if len(same) >= 3:
                self._formatting.remove(same[0])
            self._formatting = [*self._formatting[1 - MOST_FORMATTING :], self._push(tag, values or None)]
            return
        inline = tag not in ENDS and tag not in HEAD_ONLY and tag not in NEEDS and tag not in ("html", "head", "body", "table", "caption", "colgroup", "col")
        if inline:
            self._resume()
        self._push(tag, values or None)

    def _complete(self, tag: str) -> None:
        around, missing = NEEDS[tag]
        if not self._in_scope(around, TABLE_SCOPE):
            if missing in NEEDS:
                self._complete(missing)
            self._push(missing)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        before = len(self._open)
        self.handle_starttag(tag, attrs)
        if self._in_scope(("svg", "math"), ()) and len(self._open) > before:
            self._pop()

    def _end_formatting(self, tag: str) -> None:
        found = next((f for f in reversed(self._formatting) if f.tag == tag), None)
        if found is None:
            return
        if found.html_end < 0 and any(n.tag in SCOPE for n in self._open[found.depth :]):
            return
        self._formatting.remove(found)
        if found.html_end < 0:
            inside = self._open[found.depth + 1 :]
            if all(n.tag not in BLOCKS for n in inside):
                while self._pop() is not found:
                    pass

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body") or tag in VOID and tag != "br":
            return
        if tag in FORMATTING:
            self._end_formatting(tag)
        elif tag == "br":
            self._resume()
            self._push("br")
        elif tag == "p":
            if not self._end(("p",)):
                self._push("p")
                self._pop()
        elif tag in HEADINGS:
            self._end(HEADINGS)
        elif tag == "li":
            self._end(("li",), SCOPE | {"ol", "ul"})
        elif tag == "table" or tag in NEEDS or tag in SECTIONS or tag == "caption":
            self._end((tag,), TABLE_SCOPE - {tag})
        else:
            self._end((tag,), SCOPE - {tag} if tag in BLOCKS else BLOCKS | SCOPE - {tag})

    def handle_data(self, data: str) -> None:
        top = self._top()
        if top in ("script", "style"):
            written = data
        else:
            if top == "head" and data.strip():
                self._pop()
            if self._top() != "head" and (self._open or data.strip()) and self._top() not in ("table", "tr", *SECTIONS):
                self._resume()
            written = data.translate(_ESCAPES)
        self._texts.append(data)
        self._text_at += len(data)
        self._write(written)

    def handle_comment(self, data: str) -> None:
        self._write(f"<!--{data}-->")
