"""HTML extraction: the main text of a page, by rules over its blocks.

A page is cut into blocks at block-level tags.  The first pass decides each
block by its length, the share of its characters inside links and the share of
stop words among its words.  Short blocks and those in between stay undecided,
and the second pass gives them the label of the nearest decided neighbours: the
longer ones first, then, with these decided too, the short ones.

What is made for something else is no main text, whatever it reads like: some
elements and roles (menus, footers, forms, scripts ...), and elements named after
adverts, notices, sidebars, menus and comments.  Only whole words of a class or
id count, and, but for comments, none of them where the element holds the article itself.  Names
that say less (``WEAK``) decide against short blocks alone.  That a block stands
in an article or main element decides only where the rules leave it open.

Pages are taken whole, one by one, by an Arrow batch function, in time linear
in their length at any nesting; nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomer.llm.arrow import give_back, tidy
from fathomer.workspace import bounded_batches

# Frequent function words of four languages.
STOP_WORDS = frozenset(
    """
    a an and are as at be been but by for from had has have he her his i in is it its not of on or our she so that
    the their them there they this to was we were what when which who will with would you your
    au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui mais ne nous on ou par
    pas plus pour qu que qui sa se ses son sur un une vous
    aber als am auch auf aus bei bin bis das dass dem den der des die ein eine einem einen einer er es für hat ich
    ihr im ist mit nach nicht noch nur oder sich sie sind so über um und uns von vor war wenn wie wir zu zum zur
    al como con cuando del desde donde el ella ellos entre era es esta este esto fue ha hay la las lo los me mi más
    muy no nos o para pero por porque que se sin sobre su sus también un una y ya yo
    """.split()
)

_BLOCKS = frozenset(
    """
    address article aside blockquote body br caption center col colgroup dd details dialog dir div dl dt fieldset
    figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noframes
    noscript ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul
    """.split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that hold no main text, wherever they stand.
_ASIDE = frozenset(
    "aside audio button canvas datalist dialog embed footer head iframe map menu nav noembed noframes noscript "
    "object script select style svg template textarea title video".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

# Words of classes and ids that name readers' comments, whose parts may be articles of their own.
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
# Words that name adverts, menus, sides of a page and notices.
STRONG = frozenset(
    """
    ad ads adbox adslot adunit adspace adblock adbanner adwrap adwrapper adcontainer advert adverts advertisement
    advertisements advertising adsense sponsor sponsors sponsored promo promos promotion outbrain taboola
    nav navbar navigation topnav sidenav subnav mainnav sitenav menu submenu mainmenu topmenu sidemenu menubar breadcrumb
    breadcrumbs pagination pager
    sidebar sidebars footer
    cookie cookies cookiebar consent gdpr notice notices notification notifications alert alerts popup newsletter subscribe
    signup
    """.split()
)
# Words that name what often is no main text.
WEAK = frozenset("share sharing sharebar social related recommended recommendations widget widgets banner login toolbar modal overlay".split())
# Words that name the head of a page, or, in an article, its own.
HEAD = frozenset(("header", "masthead", "topbar"))
#: Words that turn the next one, or the one before, into a remark about something else: ``has-sidebar``, ``comments-open``.
_REMARKS = frozenset(("has", "with", "without", "no", "non", "is"))
_STATES = frozenset(("open", "closed", "on", "off", "enabled", "disabled", "visible"))

_TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)>"
    r"|<[!?/][^>]*+>"
    r"|<[!?/a-zA-Z][^>]*+\Z",
    re.S,
)
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_WORD = re.compile(r"[^\W\d_]+")

#: Thresholds of the first pass.
SHORT, LONG = 70, 200
LINKED, MOSTLY_LINKED = 0.3, 0.6
FEW_STOPS, MANY_STOPS = 0.15, 0.3
#: So many short blocks in a row that are links throughout make a menu, also in an article.
MENU = 3


@dataclass(eq=False)
class _Mark:
    """An element that stands aside, with the next one around it."""

    around: _Mark | None
    strong: bool
    #: Whether it counts for nothing where it holds the article.
    yields: bool
    form: bool
    holds: bool = False
    aside: bool = False
    weak: bool = False


@dataclass(eq=False)
class Block:
    """A run of text between block-level tags."""

    where: int  # the container: 0 outside, else the number of the article or main element
    mark: _Mark | None
    heading: bool
    parts: list[tuple[str, _Mark | None, bool]] = field(default_factory=list)
    aside: bool = False
    weak: bool = False
    text: str = ""
    linked: int = 0
    stops: float = 0.0
    label: str = ""

    def share(self) -> float:
        """The share of the text that is inside links."""
        return self.linked / len(self.text)

    def density(self) -> float:
        """The share of stop words among the words."""
        words = _WORD.findall(self.text.lower())
        return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


@dataclass(eq=False)
class _Open:
    name: str
    mark: _Mark | None
    where: int
    heading: bool
    live: bool = True


def _spaced(text: str) -> str:
    return " ".join(html.unescape(text).split())


class _Page:
    """The elements that are open while a page is read.

    The places of each name in the stack are kept, so that finding the element
    that a tag closes takes no walk down the stack.
    """

    def __init__(self) -> None:
        self.stack = [_Open("", None, 0, False)]
        self.places: dict[str, list[int]] = {}
        self.block_places: list[int] = []
        self.links = self.containers = 0
        self.marks: list[_Mark] = []
        self.blocks: list[Block] = []
        self.block = Block(0, None, False)

    def cut(self) -> None:
        """End the block and begin another."""
        if self.block.parts:
            self.blocks.append(self.block)
        top = self.stack[-1]
        self.block = Block(top.where, top.mark, top.heading)

    def text(self, raw: str) -> None:
        if raw:
            self.block.parts.append((raw, self.stack[-1].mark, self.links > 0))

    def _last(self, names: tuple[str, ...]) -> int:
        return max((p[-1] for n in names if (p := self.places.get(n))), default=0)

    def pop_to(self, place: int) -> None:
        while len(self.stack) > place:
            top = self.stack.pop()
            if self.block_places and self.block_places[-1] == len(self.stack):
                self.block_places.pop()
            if top.live:
                self.places[top.name].pop()
                self.links -= top.name == "a"

    def shut(self, names: tuple[str, ...], bounds: tuple[str, ...]) -> None:
        """Close the nearest open element of these names, if no bound stands before it."""
        place = self._last(names)
        if place > self._last(bounds):
            self.pop_to(place)

    def end(self, name: str) -> None:
        place = self._last((name,))
        if not place:
            return
        if name in _BLOCKS or not self.block_places or self.block_places[-1] < place:
            self.pop_to(place)
            return
        # Blocks inside it stay open: the element ends, but keeps its place.
        gone = self.stack[place]
        gone.live, gone.mark = False, self.stack[place - 1].mark
        self.places[name].pop()
        self.links -= name == "a"

    def begin(self, name: str, rest: str) -> None:
        if name == "a" and self.links:
            self.end("a")
        top = self.stack[-1]
        where, attrs = top.where, _attributes(rest)
        mark = self._marked(name, attrs, top)
        if (name in ("article", "main") or attrs.get("role", "").lower() == "main") and (mark is top.mark):
            if mark is not None:
                mark.holds = True
            if not where:
                self.containers += 1
                where = self.containers
        elif name == "h1" and mark is not None:
            mark.holds |= mark.form
        place = len(self.stack)
        self.stack.append(_Open(name, mark, where, top.heading or name in _HEADINGS))
        self.places.setdefault(name, []).append(place)
        if name in _BLOCKS:
            self.block_places.append(place)
        self.links += name == "a"

    def _marked(self, name: str, attrs: dict[str, str], top: _Open) -> _Mark | None:
        """The mark of a new element: its own, or that of what it stands in."""
        found = None  # (strong, yields)
        if name in _ASIDE or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or attrs.get("role", "").lower() in _ROLES:
            found = (True, False)
        elif name == "form" or (name == "header" and not top.where):
            found = (True, True)
        elif name not in ("html", "body", "main") and (names := f"{attrs.get('class', '')} {attrs.get('id', '')}").strip():
            words = _words_of(names)
            if words & COMMENTS:
                found = (True, False)
            elif words & STRONG or (not top.where and words & HEAD):
                found = (True, True)
            elif words & WEAK:
                found = (False, True)
        if found is None:
            return top.mark
        self.marks.append(_Mark(top.mark, *found, name == "form"))
        return self.marks[-1]

    def finish(self) -> list[Block]:
        """The blocks that have text, in order."""
        self.cut()
        for mark in reversed(self.marks):  # inner ones come later
            if mark.holds and mark.around:
                mark.around.holds = True
        for mark in self.marks:
            own = not (mark.yields and mark.holds)
            mark.aside = (own and mark.strong) or bool(mark.around and mark.around.aside)
            mark.weak = (own and not mark.strong) or bool(mark.around and mark.around.weak)
        out = []
        for b in self.blocks:
            b.aside, b.weak = bool(b.mark and b.mark.aside), bool(b.mark and b.mark.weak)
            # Inside a block, an element may stand aside alone, and one of a weak name if it is short.
            parts = [p for p in b.parts if b.aside or not (p[1] and p[1].aside)]
            if not b.weak and 0 < sum(len(p[0]) for p in parts if p[1] and p[1].weak) < SHORT:
                parts = [p for p in parts if not (p[1] and p[1].weak)]
            b.text = _spaced("".join(p[0] for p in parts))
            if b.text:
                b.linked = len(_spaced("".join(p[0] for p in parts if p[2]))) if any(p[2] for p in parts) else 0
                out.append(b)
            b.parts = []
        return out


def _words_of(names: str) -> set[str]:
    """The words of classes and ids, but for remarks."""
    found = set()
    for name in names.split():
        words = [w.lower() for w in _NAME_WORD.findall(name)]
        found |= {w for before, w, after in zip(["", *words], words, [*words[1:], ""], strict=False) if before not in _REMARKS and after not in _STATES}
    return found


def _attributes(rest: str) -> dict[str, str]:
    return {a.lower(): b or c or d for a, b, c, d in _ATTR.findall(rest)} if rest else {}


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page, in order, with their text put in order."""
    p, at = _Page(), 0
    while m := _TAG.search(page, at):
        p.text(page[at : m.start()])
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if name in _BLOCKS:
            p.cut()
        if m["end"] or m["end2"]:
            p.end(name)
        else:
            rest = m["rest"] or m["rest2"] or ""
            if name in _BLOCKS and name != "br":
                p.shut(("p",), ("button", "td", "th", "caption", "object"))
            if name == "li":
                p.shut(("li",), ("ul", "ol", "menu"))
            elif name in ("td", "th"):
                p.shut(("td", "th"), ("table",))
            elif name == "tr":
                p.shut(("tr",), ("table",))
            elif name in ("dt", "dd"):
                p.shut(("dt", "dd"), ("dl",))
            if name not in _VOID and not (rest.endswith("/") and name not in _BLOCKS and name not in _RAW):
                p.begin(name, rest)
            if name in _RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
                at = end.start() if end else len(page)
        if name in _BLOCKS:
            p.cut()
    p.text(page[at:])
    return p.finish()


def _first_pass(blocks: list[Block]) -> None:
    """Labels by the blocks alone: good, bad, or undecided, which is near or short.

    In an article or main element a linked heading and a short link are left
    undecided, and so are blocks of few stop words: tables, code and languages
    without a list have few, too.
    """
    plain = {b.where for b in blocks if not b.aside and b.share() <= LINKED}  # containers of nothing but links are none
    for b in blocks:
        size, share = len(b.text), b.share()
        b.where = b.where if b.where in plain else 0
        b.stops = b.density() if size >= SHORT else 0.0
        if b.aside or (size < SHORT and b.weak) or (not b.where and "©" in b.text):
            b.label = "bad"
        elif b.heading and b.where:
            b.label = "short"
        elif share > LINKED:
            b.label = "short" if b.where and size < SHORT else "bad"
        elif size < SHORT:
            b.label = "short"
        elif b.stops >= MANY_STOPS:
            b.label = "good" if size >= LONG else "near"
        else:
            b.label = "near" if b.stops >= FEW_STOPS or (b.where and not b.weak) else "bad"
    run: list[Block] = []
    for b in [*blocks, Block(-1, None, False)]:
        if b.label == "short" and not b.heading and b.share() > MOSTLY_LINKED and (not run or run[-1].where == b.where):
            run.append(b)
            continue
        if len(run) >= MENU:
            for x in run:
                x.label = "bad"
        run = []
    if not any(b.label == "good" for b in blocks):  # then the best there is
        for b in blocks:
            if b.label == "near" and b.stops >= MANY_STOPS:
                b.label = "good"


def _neighbours(blocks: list[Block]) -> list[tuple[tuple[int, str], tuple[int, str]]]:
    """For each block, (distance, label) of the nearest decided ones of its container before and after it."""
    far = (1 << 60, "")
    before, after = [far] * len(blocks), [far] * len(blocks)
    for out, order in ((before, range(len(blocks))), (after, range(len(blocks) - 1, -1, -1))):
        last: dict[int, int] = {}
        for i in order:
            b = blocks[i]
            if b.where in last:
                out[i] = (abs(i - last[b.where]), blocks[last[b.where]].label)
            if b.label in ("good", "bad") and not b.aside:
                last[b.where] = i
    return list(zip(before, after, strict=True))


def _second_pass(blocks: list[Block]) -> None:
    """Undecided blocks take the label of the nearest decided neighbours of their container.

    Near blocks go first; where the two sides differ at the same distance, or
    there is none, they are good.  A heading goes with what follows it.  A short
    block is bad where the sides differ at the same distance.  In an article or
    main element a short block is good unless both sides say otherwise; outside
    it is bad where there is no side.
    """
    for b, ((d1, one), (d2, two)) in zip(blocks, _neighbours(blocks), strict=True):
        if b.label == "near":
            b.label = "good*" if d1 == d2 and one != two or not (one or two) else (one if d1 <= d2 else two) + "*"
    for b in blocks:
        b.label = b.label.rstrip("*")
    for b, ((d1, one), (d2, two)) in zip(blocks, _neighbours(blocks), strict=True):
        if b.label != "short":
            continue
        if b.where and not (one and two):
            b.label = "good"
        elif b.heading and (one or two):
            b.label = two or one
        elif one == two or d1 != d2:
            b.label = (one if d1 <= d2 else two) or "bad"
        else:
            b.label = "bad"


def main_text(page: str | None) -> str:
    """The main text: the good blocks in page order, joined by one space."""
    if not page:
        return ""
    blocks = blocks_of(page)
    _first_pass(blocks)
    _second_pass(blocks)
    return " ".join(b.text for b in blocks if b.label == "good")


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page: ``page_id, url, text, n_chars``.

    A null or empty page, and one without main text, has the empty text.
    Character references are decoded, white space inside a block becomes one
    space, and nothing is cut.  Rows are taken one by one: repeated or null ids
    stay as they are, other columns are not read, and an empty table gives an
    empty one.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [main_text(page.as_py()) for page in part.column(2)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    columns = pages.select(
        pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html")
    )
    bounded_batches(pages.sparkSession)
    return columns.mapInArrow(tidy(batches), "page_id long, url string, text string, n_chars long")


def main_texts(page: Column) -> Column:
    """The main text of a page as an expression; the empty text for a null or empty page."""

    @F.arrow_udf("string")
    def texts(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in parts:
            yield pa.array([main_text(page.as_py()) for page in pages], pa.string())
        give_back()

    return texts(page.cast("string"))
