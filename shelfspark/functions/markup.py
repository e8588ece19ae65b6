"""A small tolerant reader of HTML for use inside tasks: elements, text, and CSS selectors.

Selector grammar: tag, .class, #id, [a], [a="v"], [a*="v"], :not([a=""]), descendants, comma lists.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SILENT = frozenset(("script", "style", "template"))
# Tags as most are written: lower case, values in double quotes and without references. The standard parser reads all others.
_PLAIN_START = re.compile(r'<([a-z][a-z0-9]*)((?:[ \t\n\r\f]+[a-z][a-z0-9-]*="[^"&]*")*)[ \t\n\r\f]*>')
_PLAIN_END = re.compile(r"</([a-z][a-z0-9]*)>")
_RAW = frozenset("script style textarea title plaintext xmp iframe noembed noframes noscript".split())
# Such tags one after another, without angle brackets in values, and the text between them: cut apart and read in one go.
_RUN = re.compile(
    rf"(?:[^<]*+<(?:/[a-z][a-z0-9]*+|(?!(?:{'|'.join(sorted(_RAW))})[^a-z0-9])[a-z][a-z0-9]*+"
    r'(?:[ \t\n\r\f]++[a-z][a-z0-9-]*+="[^"&<>]*+")*+[ \t\n\r\f]*+)>){0,1000}+'
)
_MAX_SHAPES = 10_000
_PART = re.compile(
    r"""(?P<tag>^[\w-]+|^\*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)
    |:not\(\[(?P<nname>[\w-]+)(?:="(?P<nvalue>[^"]*)")?\]\)
    |\[(?P<name>[\w-]+)(?:(?P<op>\*?=)"(?P<value>[^"]*)")?\]""",
    re.X,
)


class Element:
    """An element of a page. Elements of one shape share their attributes, which are never changed.

    The root has all elements in ``order``; those below an element stand there from its ``place`` + 1 up to ``last``, or to
    the end if it is never closed.
    """

    __slots__ = ("tag", "attrs", "parent", "content", "above", "kind", "place", "last", "order")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None, place: int = -1, kind: tuple | None = None):
        self.tag, self.attrs, self.parent, self.content = tag, attrs, parent, []
        self.above: dict[tuple, bool] | None = None  # whether this element or one around it matches a chain
        self.kind, self.place, self.last = kind, place, None

    def walk(self):
        """Elements below this one in document order, however deep they lie."""
        rest = [c for c in reversed(self.content) if not isinstance(c, str)]
        while rest:
            child = rest.pop()
            yield child
            if child.content:
                rest.extend([c for c in reversed(child.content) if not isinstance(c, str)])

    def pieces(self):
        rest = [iter(self.content)]
        while rest:
            child = next(rest[-1], None)
            if child is None:
                rest.pop()
            elif isinstance(child, str):
                yield child
            elif child.tag not in _SILENT:
                rest.append(iter(child.content))

    def text(self) -> str:
        content = self.content
        if len(content) == 1 and isinstance(content[0], str):
            return content[0]
        return "".join(self.pieces())

    def lines(self) -> str:
        return "\n".join(p.strip() for p in self.pieces() if p.strip())

    def select(self, selector: str):
        chains = _chains(selector)
        return (e for e in self.walk() if any(_matches(e, chain) for chain in chains))

    def release(self) -> None:
        """Cut the ways up, so that the page is freed at once when it is let go, not by a later search for cycles."""
        for element in self.order:
            element.parent = None

    def first(self, selector: str) -> Element | None:
        return next(self.select(selector), None)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.open = Element("", {}, None)
        self.order = self.root.order = []
        self.pending: dict[str, int] = {}  # open elements by tag

    def parse_starttag(self, i):
        plain = _PLAIN_START.match(self.rawdata, i)
        if plain is None or plain[1] in _RAW:
            return super().parse_starttag(i)
        self.lasttag = plain[1]
        end = _RUN.match(self.rawdata, i).end()
        if end == i:
            return super().parse_starttag(i)
        self._read_run(self.rawdata[i + 1 : end])
        return end

    def parse_endtag(self, i):
        plain = _PLAIN_END.match(self.rawdata, i) if self.cdata_elem is None else None
        if plain is None:
            return super().parse_endtag(i)
        end = _RUN.match(self.rawdata, i).end()
        self._read_run(self.rawdata[i + 1 : end])
        return end

    def _read_run(self, run):
        """Plain tags that follow one another, without the first bracket."""
        inside, order, pending = self.open, self.order, self.pending
        content, place = inside.content, len(order)
        for piece in run.split("<"):
            written, _, text = piece.partition(">")
            form, tag, attrs, kind = _SHAPES.get(written) or _shape(written)
            if form == _END:
                if inside.tag == tag:
                    pending[tag] -= 1
                    inside.last = place
                    inside = inside.parent
                    content = inside.content
                elif pending.get(tag):
                    inside = self._close(inside, tag)
                    content = inside.content
            else:
                element = Element(tag, attrs, inside, place, kind)
                content.append(element)
                order.append(element)
                place += 1
                if form == _START:
                    inside = element
                    content = element.content
                    pending[tag] = pending.get(tag, 0) + 1
                else:
                    element.last = place
            if text:
                content.append(unescape(text) if "&" in text else text)
        self.open = inside

    def updatepos(self, i, j):
        return j  # lines are not counted

    def _add(self, tag, attrs):
        element = Element(tag, {k: v or "" for k, v in attrs}, self.open, len(self.order))
        self.open.content.append(element)
        self.order.append(element)
        return element

    def handle_starttag(self, tag, attrs):
        element = self._add(tag, attrs)
        if tag in _VOID:
            element.last = len(self.order)
        else:
            self.open = element
            self.pending[tag] = self.pending.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self._add(tag, attrs).last = len(self.order)

    def handle_endtag(self, tag):
        # An end tag closes everything left open inside its element; one without a start is ignored.
        if self.pending.get(tag):
            self.open = self._close(self.open, tag)

    def _close(self, element, tag):
        """Close the innermost element of this tag and all inside it; what is open then."""
        pending, last = self.pending, len(self.order)
        while element.tag != tag:
            pending[element.tag] -= 1
            element.last = last
            element = element.parent
        pending[tag] -= 1
        element.last = last
        return element.parent

    def handle_data(self, data):
        self.open.content.append(data)


# Forms of plain tags. Templates write the same end tags, and start tags with no attribute or a class alone, over and over:
# they are kept as read. Of other start tags the name and the names of attributes are.
_END, _START, _ALONE = range(3)
_SHAPES: dict[str, tuple[int, str, dict[str, str] | None, tuple | None]] = {}
_NAMED: dict[str, tuple[int, str, list[str], tuple | None]] = {}


def _shape(written: str) -> tuple[int, str, dict[str, str] | None, tuple | None]:
    """Form, name, attributes and kind of a plain tag as it stands between the brackets."""
    parts = written.split('"')
    bare = '"'.join(parts[::2])
    form, tag, names, kind = _NAMED.get(bare) or _names(bare)
    if form == _END:
        shape = form, tag, None, None
    else:
        attrs = dict(zip(names, parts[1::2]))
        shape = form, tag, attrs, kind or (tag, attrs["class"], *attrs)
        if len(attrs) > ("class" in attrs):
            return shape
    if len(_SHAPES) < _MAX_SHAPES:
        _SHAPES[written] = shape
    return shape


def _names(bare: str) -> tuple[int, str, list[str], tuple | None]:
    """Form, name and names of attributes of a plain tag without its values; the kind too, if no class belongs to it."""
    first, *rest = bare.split('"')
    tag, *names = first.split()
    names = [name[:-1] for name in (*names, *map(str.strip, rest)) if name]
    if tag[0] == "/":
        known = _END, tag[1:], names, None
    else:
        known = _ALONE if tag in _VOID else _START, tag, names, None if "class" in names else (tag, None, *dict.fromkeys(names))
    if len(_NAMED) < _MAX_SHAPES:
        _NAMED[bare] = known
    return known


def parse(html: str) -> Element:
    """The page as a tree. Declarations that the parser refuses are read as text."""
    try:
        return _build(html)
    except AssertionError:
        return _build(html.replace("<!", "&lt;!"))


def _build(html: str) -> Element:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def _test(match: re.Match):
    g = match.groupdict()
    tag, cls = g["tag"], g["cls"]
    if tag:
        return lambda e: tag in ("*", e.tag)
    if cls:
        return lambda e: cls in e.attrs.get("class", "").split()
    if g["id"]:
        return lambda e: e.attrs.get("id") == g["id"]
    if g["nname"]:
        return lambda e: g["nname"] not in e.attrs or (g["nvalue"] is not None and e.attrs[g["nname"]] != g["nvalue"])
    if g["op"] == "=":
        return lambda e: e.attrs.get(g["name"]) == g["value"]
    if g["op"]:
        return lambda e: g["value"] in e.attrs.get(g["name"], "")
    return lambda e: g["name"] in e.attrs


@lru_cache(maxsize=512)
def _chains(selector: str) -> tuple:
    """Alternatives of a selector, each a tuple of steps from the ancestor down."""
    return tuple(
        tuple(tuple(_test(m) for m in _PART.finditer(step)) for step in alternative.split())
        for alternative in selector.split(",")
    )


def _matches(element: Element, chain: tuple) -> bool:
    for test in chain[-1]:
        if not test(element):
            return False
    return len(chain) == 1 or _inside(element.parent, chain[:-1])


def _inside(element: Element | None, chain: tuple) -> bool:
    """Whether this element or one around it matches the chain; every element is tested once."""
    path = []
    while element is not None and (element.above is None or chain not in element.above):
        path.append(element)
        element = element.parent
    found = element is not None and element.above[chain]
    for inner in reversed(path):
        found = found or _matches(inner, chain)
        if inner.above is None:
            inner.above = {}
        inner.above[chain] = found
    return found


def _entry(step: str) -> tuple[str, str]:
    """What an element must carry for a step: its tag, a class, or an attribute; ("", "") if it may be any element."""
    kinds = {k: v for m in _PART.finditer(step) for k, v in m.groupdict().items() if v is not None}
    if kinds.get("tag", "*") != "*":
        return "tag", kinds["tag"]
    if "cls" in kinds:
        return "cls", kinds["cls"]
    if "id" in kinds:
        return "name", "id"
    return ("name", kinds["name"]) if "name" in kinds else ("", "")


def _told_by_kind(step: str) -> bool:
    """Whether tag, class and attribute names tell if an element matches this step."""
    kinds = [m.groupdict() for m in _PART.finditer(step)]
    return all(
        not k["id"] and (k["nvalue"] is None or k["nname"] == "class") and (k["op"] is None or k["name"] == "class") for k in kinds
    )


class FirstFinder:
    """First element for each of several selectors, all in one walk; the walk ends when every selector has its element.

    Which selectors may match is the same for elements of one tag, class and attribute names; up to ``KINDS`` such are kept,
    with the selectors that these do not rule out. The chain of a selector they prove is None.
    """

    KINDS = 10_000

    def __init__(self, selectors: list[str]):
        self.kinds: dict[tuple, list[tuple[int, tuple | None]]] = {}
        self.selectors = list(dict.fromkeys(selectors))
        self.index: dict[tuple[str, str], list[tuple[int, tuple, bool]]] = {}
        for place, selector in enumerate(self.selectors):
            for alternative, chain in zip(selector.split(","), _chains(selector), strict=True):
                steps = alternative.split()
                told = len(steps) == 1 and _told_by_kind(steps[0])
                self.index.setdefault(_entry(steps[-1]), []).append((place, chain, told))

    def _candidates(self, e: Element) -> list[tuple[int, tuple | None]]:
        keys = [("", ""), ("tag", e.tag), *(("name", name) for name in e.attrs), *(("cls", name) for name in e.attrs.get("class", "").split())]
        found = [candidate for key in keys for candidate in self.index.get(key, [])]
        return [(place, None if told else chain) for place, chain, told in found if not told or _matches(e, chain)]

    def _of(self, e: Element) -> list[tuple[int, tuple | None]]:
        kind = e.kind
        if kind is None:
            kind = e.kind = (e.tag, e.attrs.get("class"), *e.attrs)
        candidates = self.kinds.get(kind)
        if candidates is None:
            candidates = self._candidates(e)
            if len(self.kinds) < self.KINDS:
                self.kinds[kind] = candidates
        return candidates

    def first(self, elements: Iterable[Element]) -> dict[int, Element]:
        """The first of these elements for each selector, by the place of the selector."""
        found: dict[int, Element] = {}
        open_count, kinds = len(self.selectors), self.kinds
        for e in elements:
            candidates = kinds.get(e.kind)
            if candidates is None:
                candidates = self._of(e)
            for place, chain in candidates:
                if place not in found and (chain is None or _matches(e, chain)):
                    found[place] = e
            if len(found) == open_count:
                break
        return found

    def all(self, elements: Iterable[Element]) -> list[Element]:
        """These elements, as far as they match the first selector that any of them matches."""
        found: dict[int, list[Element]] = {}
        kinds = self.kinds
        for e in elements:
            candidates = kinds.get(e.kind)
            if candidates is None:
                candidates = self._of(e)
            for place, chain in candidates:
                held = found.get(place)
                if (held is None or held[-1] is not e) and (chain is None or _matches(e, chain)):
                    if held is None:
                        found[place] = [e]
                    else:
                        held.append(e)
        return found[min(found)] if found else []

    def find(self, element: Element) -> dict[str, Element]:
        return {self.selectors[place]: e for place, e in self.first(element.walk()).items()}


def label_values(root: Element) -> list[tuple[str, str]]:
    """Labels with their values, from the rows of tables and from definition lists, in order.

    The first cell of a row names the others; rows of heading cells only, and rows of one cell, name nothing. Terms that follow
    one another share the definitions after them. Cells, rows and terms need not be closed; the page may be deep.
    """
    groups: list[list[tuple[str, list[str]]]] = []
    stack: list[tuple] = [(root, None, None)]
    while stack:
        node, group, cell = stack.pop()
        if isinstance(node, str):
            if cell is not None:
                cell[1].append(node)
            continue
        if node.tag in ("script", "style"):
            continue
        if node.tag in ("tr", "dl"):
            group, cell = [], None
            groups.append(group)
        elif node.tag in ("td", "th", "dt", "dd") and group is not None:
            cell = (node.tag, [])
            group.append(cell)
        stack.extend((child, group, cell) for child in reversed(node.content))
    pairs = []
    for group in groups:
        cells = [(tag, " ".join("".join(parts).split())) for tag, parts in group]
        if any(tag in ("dt", "dd") for tag, _ in cells):
            labels, before = [], "dd"
            for tag, text in cells:
                if tag == "dt":
                    labels = [text] if before == "dd" else [*labels, text]
                else:
                    pairs += [(label, text) for label in labels]
                before = tag
        elif len(cells) > 1 and any(tag == "td" for tag, _ in cells):
            pairs.append((cells[0][1], " ".join(text for _, text in cells[1:] if text)))
    return [(label.rstrip(" :"), value) for label, value in pairs if label.rstrip(" :")]
