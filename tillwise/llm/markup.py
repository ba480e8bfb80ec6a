"""Reading HTML: a page as block-level tags and the text blocks between them."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import xxhash

# Fixed values, from the HTML standard and from what sites call their furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that break the text around them.
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "select summary table caption tbody td tfoot th thead title tr ul".split()
)
# A new one of these ends an open one, unless one of the second group stands between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
# Any block ends an open paragraph, unless one of these stands between.
PARAGRAPH = (
    {"p"},
    set("article aside body button details dialog div fieldset figure form main nav section table td ul ol".split()),
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
RAW = frozenset("script style iframe noembed noframes xmp textarea title".split())
FURNITURE = frozenset(
    "nav footer aside form script style head title noscript template button select textarea iframe svg canvas object "
    "dialog menu noembed noframes xmp".split()
)
FURNITURE_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split()
)
FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner banners sponsor sponsors sponsored "
    "promo promos promotion cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal "
    "overlay newsletter subscribe subscription signup login sidebar aside menu menus nav navbar navigation breadcrumb "
    "breadcrumbs topbar toolbar header masthead footer copyright comment comments disqus respond reply replies share "
    "sharing social related recommended recommendations widget widgets pagination pager".split()
)
# Parts of a name that say that something is said about a piece of furniture, not that this is one.
ABOUT = frozenset("no not without with has have".split())

_MARK = re.compile(
    r"""<!--(?:.*?-->|.*\Z)"""
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<more>(?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)(?P<shut>>|\Z)"""
    r"""|<[!?/][^>]*(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass(slots=True)
class Element:
    name: str
    # Number of the path of block elements down to this one.
    path: int
    furniture: bool
    main: bool
    link: bool
    # Inside the header of an article, of which the headings alone are text.
    header: bool


def _named_furniture(value: str) -> bool:
    for name in value.split():
        parts = [p.lower() for p in _PARTS.findall(name)]
        if not ABOUT.intersection(parts) and FURNITURE_NAMES.intersection(parts):
            return True
    return False


class Reader:
    """Turns pages into events; numbers of paths are the same in every task."""

    def __init__(self) -> None:
        self._paths: dict[tuple[int, str], int] = {}
        self._labels: dict[tuple[str, str], tuple[str, bool, bool, bool]] = {}

    def path(self, parent: int, label: str) -> int:
        found = self._paths.get((parent, label))
        if found is None:
            if len(self._paths) > 200_000:
                self._paths.clear()
            found = xxhash.xxh3_64_intdigest(f"{parent} {label}") >> 1
            self._paths[(parent, label)] = found
        return found

    def _described(self, name: str, more: str) -> tuple[str, bool, bool, bool]:
        """An element's label, whether it is furniture, whether by its name alone, and whether it opens the main text."""
        known = self._labels.get((name, more))
        if known is not None:
            return known
        given = {a.lower(): b or c or d for a, b, c, d in _ATTRIBUTE.findall(more)}
        # Numbers in an id name a thing, not a kind of things.
        own = given.get("id", "")
        label = " ".join([name, *sorted(set(given.get("class", "").split())), *([f"#{own}"] if own and not re.search(r"\d", own) else [])])
        role = given.get("role", "").lower()
        whole = name in ("html", "body", "main")
        furniture = name in FURNITURE or not whole and (
            role in FURNITURE_ROLES or "hidden" in given or bool(_HIDDEN.search(given.get("style", "")))
            or _named_furniture(f"{given.get('class', '')} {given.get('id', '')}")
        )
        known = (label, furniture, name in FURNITURE, name in ("article", "main") or role in ("main", "article"))
        if len(self._labels) > 50_000:
            self._labels.clear()
        self._labels[(name, more)] = known
        return known

    def events(self, page: str, texts: bool = True) -> Iterator[tuple[int, tuple[list[str], int, bool] | None]]:
        """``(number, None)`` for a block-level tag, ``(0, (words, words in links, in the main text))`` for a text block.

        Text inside furniture makes no event; without ``texts`` none does.
        """
        root = Element("", 0, False, False, False, False)
        stack = [root]
        pieces: list[str] = []
        linked = 0

        def flushed():
            nonlocal linked
            words = "".join(pieces).split()
            block = (words, min(linked, len(words)), stack[-1].main)
            pieces.clear()
            linked = 0
            return block

        at = 0
        while at < len(page):
            mark = _MARK.search(page, at)
            text = page[at : mark.start() if mark else len(page)]
            top = stack[-1]
            if texts and text and not top.furniture and not top.header:
                text = html.unescape(text) if "&" in text else text
                pieces.append(text)
                if top.link:
                    linked += len(text.split())
            if mark is None:
                break
            at = mark.end()
            name = mark["name"]
            if name is None or not mark["shut"]:
                continue
            name = name.lower()
            block = name in BLOCKS
            if block and pieces:
                words = flushed()
                if words[0]:
                    yield 0, words
            if mark["end"]:
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), 0)
                if depth:
                    if block:
                        yield self.path(stack[depth].path, "/"), None
                    if any(e.name in BLOCKS for e in stack[depth:]) and pieces:
                        words = flushed()
                        if words[0]:
                            yield 0, words
                    del stack[depth:]
                continue
            more = mark["more"]
            if block:
                self._close(stack, *PARAGRAPH)
            if name in CLOSES:
                self._close(stack, *CLOSES[name])
            top = stack[-1]
            label, furniture, by_name, main = self._described(name, more)
            # A site's header is furniture; of an article's own one the headings are text.
            header = top.header and name not in HEADINGS
            if name == "header" and not by_name:
                furniture, header = not top.main, top.main
            path = self.path(top.path, label) if block else top.path
            if block:
                yield path, None
            if name in RAW:
                end = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
                at = end.start() if end else len(page)
            if name in VOID or more.endswith("/") and name not in BLOCKS:
                continue
            stack.append(
                Element(name, path, top.furniture or furniture, top.main or main, top.link or name == "a", header)
            )
        if pieces:
            words = flushed()
            if words[0]:
                yield 0, words

    @staticmethod
    def _close(stack: list[Element], names: set[str], until: set[str]) -> None:
        """Ends the innermost open element of these names, and what is open inside it."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                del stack[i:]
                return
            if stack[i].name in until:
                return


def is_whole(page: str) -> bool:
    """Whether the page ends where a page ends, or never began as one."""
    tail = page[-200:].rstrip().lower()
    return tail.endswith(("</html>", "</body>")) or "<html" not in page[:2000].lower()
