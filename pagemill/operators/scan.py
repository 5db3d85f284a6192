"""One pass over a page's tags: elements from a stack, then the main region by text density, as marked text.

Markup on real pages is incomplete: end tags are optional or missing, elements
overlap, menus stand inside what they belong to.  The scan keeps the open
elements and closes them as a browser would; what is furniture is decided per
element, from its name, what it holds and how much of its text is links.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

# Placeholders for markdown marks and protected characters while page text is
# decoded and escaped; all are Unicode noncharacters.
MARKS = {"*": "﷐", "#": "﷑", "[": "﷒", "](": "﷓", ")": "﷔", "br": "﷕", "`": "﷖", ">": "﷗", "nl": "﷘", "lead": "﷙"}
KEEP = "﷠﷡﷢﷣﷤﷥"
KEPT = "\n \t*_#"
_KEPT_AS = str.maketrans(KEPT, KEEP)

# Elements by what they mean for the scan.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe".split())
UNSEEN = RAW | frozenset("head title template svg canvas picture".split())
IN_HEAD = RAW | frozenset("title meta link base template".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html main menu nav ol p pre section summary table tbody tfoot thead ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset(("ul", "ol", "menu"))
CONTENT = frozenset(("article", "main"))
CONTAINERS = frozenset("div ul ol menu section table dl p".split())
BARE = frozenset("table thead tbody tfoot tr ul ol menu dl".split())  # hold no text of their own
# A start tag on the left ends open elements on the right, up to one of the last group.
CLOSES = {
    "li": (("li",), LISTS), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    **{part: (("thead", "tbody", "tfoot", "caption"), ("table",)) for part in ("thead", "tbody", "tfoot")},
}
CELLS = frozenset(("table", "td", "th", "caption"))

LINKED = 0.6  # share of letters in links from which a container is a menu
LINKS = 3  # and the fewest links of one

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*"|'[^']*'|["'])*+)>|<[/!?]?[A-Za-z!?][^>]*\Z""", re.S
)
_HREF = re.compile(r"""(?:^|[\s"'/])href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in (*RAW, "title")}
_BESIDES_P = (BLOCKS - {"p"}) | CELLS | {"li"}
_SPACES = re.compile(r"[ \t\r\n\f]+")


@dataclass(slots=True)
class Element:
    name: str
    parent: int
    first: int  # place of its start tag among the parts of the page
    attributes: str = ""
    last: int = -1
    ended: bool = False  # by an end tag of its own
    plain: int = 0  # letters outside links, inside links, and links, of all that it holds
    linked: int = 0
    links: int = 0
    holds: set[str] = field(default_factory=set)


def _until(name: str) -> frozenset[str]:
    """The open elements that an end tag does not reach beyond: cells, tables, and for inline elements all blocks."""
    if name in ("body", "html", "table"):
        return frozenset()
    if name in CELLS or name in ("tr", "thead", "tbody", "tfoot"):
        return frozenset(("table",))
    return CELLS if name in BLOCKS or name == "li" else BLOCKS | CELLS | {"li"}


def elements(html: str) -> tuple[list[Element], list[tuple[int, str | None]]]:
    """Elements in page order, and the page as parts (element, text).

    A part without text is the start of the element or, if the element has one
    before, its end.
    """
    found = [Element("", -1, 0)]
    parts: list[tuple[int, str | None]] = []
    stack = [0]
    open_now: Counter[str] = Counter()  # names of the elements in the stack

    def close(to: int, own: bool) -> None:
        """End the open elements from the top of the stack down to place ``to``."""
        while len(stack) > to:
            number = stack.pop()
            open_now[found[number].name] -= 1
            found[number].last, found[number].ended = len(parts), own and len(stack) == to
            parts.append((number, None))

    def topmost(names: tuple[str, ...] | frozenset[str], until: tuple[str, ...] | frozenset[str]) -> int:
        """Place in the stack of the innermost open element of these names; 0 if none is open or one of ``until`` comes first."""
        if not any(open_now[n] for n in names):
            return 0
        for place in range(len(stack) - 1, 0, -1):
            name = found[stack[place]].name
            if name in names:
                return place
            if name in until:
                return 0
        return 0

    at, size = 0, len(html)
    while at < size:
        tag = _TAG.search(html, at)
        stop = tag.start() if tag else size
        if stop > at:
            parts.append((stack[-1], html[at:stop]))
        if not tag:
            break
        at = tag.end()
        if not tag[2]:
            continue
        name = tag[2].lower()
        if tag[1]:
            place = topmost((name,), _until(name))
            if place:
                close(place, True)
            continue
        if name == "body" or (name not in IN_HEAD and found[stack[-1]].name == "head"):
            place = topmost(("head",), ())
            if place:
                close(place, False)
        if name in BLOCKS:
            place = topmost(("p",), _BESIDES_P)  # a paragraph holds no block
            if place:
                close(place, False)
            if name in HEADINGS and found[stack[-1]].name in HEADINGS:
                close(len(stack) - 1, False)
        if name in CLOSES:
            place = topmost(*CLOSES[name])
            if place:
                close(place, False)
        number = len(found)
        e = Element(name, stack[-1], len(parts), tag[3])
        found.append(e)
        parts.append((number, None))
        empty = name in VOID or (name in UNSEEN and tag[3].endswith("/"))
        if name in _RAW_END and not empty:
            # what stands in it is not markup; a title without an end is an element like others
            end = _RAW_END[name].search(html, at)
            empty = end is not None or name != "title"
            at = end.end() if end else size if empty else at
        if empty:
            e.last, e.ended = len(parts), True
            parts.append((number, None))
        else:
            stack.append(number)
            open_now[name] += 1
    close(1, False)
    found[0].last = len(parts)
    _measure(found, parts)
    return found, parts


def _measure(found: list[Element], parts: list[tuple[int, str | None]]) -> None:
    """Letters, links and names of held elements, summed from the leaves up."""
    in_link = [False] * len(found)
    unseen = [False] * len(found)
    for i, e in enumerate(found[1:], 1):
        in_link[i] = e.name == "a" or in_link[e.parent]
        unseen[i] = e.name in UNSEEN or unseen[e.parent]
    for i, piece in parts:
        if piece is not None and not unseen[i]:
            n = len(piece) - piece.count(" ") - piece.count("\n")
            if in_link[i]:
                found[i].linked += n
            else:
                found[i].plain += n
    for i in range(len(found) - 1, 0, -1):
        e, up = found[i], found[found[i].parent]
        up.plain += e.plain
        up.linked += e.linked
        up.links += e.links + (e.name == "a")
        up.holds |= e.holds
        up.holds.add(e.name)


def _furniture(e: Element, inside: bool, page: Element) -> bool:
    """Whether an element is no part of the content; ``inside``: an article or main part holds it."""
    if e.name in RAW or e.name in ("head", "title"):
        return True
    if not e.ended or e.holds & CONTENT:
        return False  # the rest of the page, or a wrapper around the content
    if e.name in UNSEEN or e.name in ("nav", "aside", "footer"):
        return True
    if e.name == "header":
        return not inside
    if e.name == "form":
        return 2 * e.plain <= page.plain  # some pages stand in one form as a whole
    letters = e.plain + e.linked
    return not inside and e.name in CONTAINERS and e.links >= LINKS and e.linked > LINKED * letters


def marked_content(html: str | None) -> str | None:
    """The main content as text with marks in place of markdown; null for a null page.

    The content goes from the first article to the end of the last, else so
    for main parts, else it is all of the page; less unseen elements and
    furniture.  Named and numbered characters stand as on the page.
    """
    if html is None:
        return None
    found, parts = elements(html)
    inside, gone = [False] * len(found), [False] * len(found)
    for i, e in enumerate(found[1:], 1):
        inside[i] = inside[e.parent] or e.name in CONTENT
        gone[i] = gone[e.parent] or _furniture(e, inside[e.parent], found[0])
    for name in ("article", "main"):
        region = [e for i, e in enumerate(found) if e.name == name and not gone[i] and e.plain + e.linked]
        if region:
            return _Writer(found, parts, gone).write(region[0].first, max(e.last for e in region))
    return _Writer(found, parts, gone).write(0, len(parts))


class _Writer:
    """Marked text of a range of parts."""

    def __init__(self, found: list[Element], parts: list[tuple[int, str | None]], gone: list[bool]):
        self.found, self.parts, self.gone = found, parts, gone
        self.out: list[str] = [""]
        self.opened: list[tuple[int, int]] = []  # inline elements and where their text begins
        self.items: dict[int, int] = {}  # items of a list so far
        self.code = 0

    def write(self, first: int, last: int) -> str:
        for place in range(first, min(last + 1, len(self.parts))):
            number, piece = self.parts[place]
            e = self.found[number]
            if self.gone[number]:
                continue
            if piece is not None:
                self._text(piece, e)
            elif place == e.first:
                self._start(number, e)
            elif place == e.last:
                self._end(number, e)
        return "".join(self.out)

    def _put(self, piece: str) -> None:
        if piece:
            self.out.append(piece)

    def _text(self, piece: str, e: Element) -> None:
        if self.code:
            self._put(piece.translate(_KEPT_AS))
            return
        piece = _SPACES.sub(" ", piece)
        if e.name in BARE and piece == " ":
            return
        self._put(piece.lstrip(" ") if self.out[-1].endswith(("\n", " ", _LEAD)) else piece)

    def _block(self) -> None:
        """An empty line before a block; not between a mark of a heading, item or quotation and its text."""
        if not self.out[-1].endswith(_LEAD):
            self._put("\n\n")

    def _start(self, number: int, e: Element) -> None:
        name = e.name
        if self.code:
            self.code += name in ("pre", "code")
        elif name == "br":
            self._put(MARKS["br"])
        elif name == "hr":
            self._put("\n\n---\n\n")
        elif name == "pre":
            self._put(f"\n\n{MARKS['`'] * 3}{MARKS['nl']}")
            self.code = 1
        elif name == "code":
            self._put(MARKS["`"])
            self.code = 1
        elif name == "li":
            self._item(e)
        elif name in HEADINGS:
            self._put(f"\n\n{MARKS['#'] * int(name[1])}{_LEAD}")
        elif name == "blockquote":
            self._put(f"\n\n{MARKS['>']}{_LEAD}")
        elif name == "tr":
            self._put("\n|")
        elif name in ("td", "th"):
            self._put(" ")
        elif name in BLOCKS:
            self._block()
        elif name in _WRAPS or name == "a":
            self.opened.append((number, len(self.out)))

    def _item(self, e: Element) -> None:
        of = self.found[e.parent]
        self.items[e.parent] = self.items.get(e.parent, 0) + 1
        numbered = of.name == "ol" and not of.holds & LISTS
        if self.out[-1].endswith(" "):
            self.out[-1] = self.out[-1].rstrip(" ")
        self._put(f"\n{self.items[e.parent]}.{_LEAD}" if numbered else f"\n{MARKS['*']}{_LEAD}")

    def _end(self, number: int, e: Element) -> None:
        name = e.name
        if self.code:
            self.code -= name in ("pre", "code")
            if not self.code:
                self._put(MARKS["`"] if name == "code" else f"{MARKS['nl']}{MARKS['`'] * 3}\n\n")
        elif name in ("td", "th"):
            self._put(" |")
        elif name == "tr" and "th" in e.holds:
            heads = sum(x.name == "th" and x.parent == number for x in self.found[number : number + e.last - e.first])
            if heads and self.found[number + 1].name == "th":
                self._put("\n|" + " --- |" * heads)
        elif name in BLOCKS and name != "hr":
            self._put("\n\n")
        elif self.opened and self.opened[-1][0] == number:
            self._wrap(e, self.opened.pop()[1])

    def _wrap(self, e: Element, begin: int) -> None:
        """Put the marks of a closed inline element around its text, blanks outside; none around blocks or nothing."""
        inner = "".join(self.out[begin:])
        text = inner.strip(" ")
        if not e.ended or not text or "\n" in text:
            return
        before, after = inner[: len(inner) - len(inner.lstrip(" "))], inner[len(inner.rstrip(" ")) :]
        if e.name == "a":
            href = _HREF.search(e.attributes)
            if not href:
                return
            target = next(g for g in href.groups() if g is not None).translate(_KEPT_AS)
            text = f"{MARKS['[']}{text}{MARKS['](']}{target}{MARKS[')']}"
        else:
            mark = MARKS["*"] * _WRAPS[e.name]
            text = f"{mark}{text}{mark}"
        self.out[begin:] = [before + text + after]


_LEAD = MARKS["lead"]
_WRAPS = {"em": 1, "i": 1, "strong": 2, "b": 2}
