"""Main text of web pages by the distribution of text over line blocks.

A page is read once, from front to back, and cut into lines at its block elements, with the markup stripped. Menus, headers, footers,
sidebars, notices, adverts, forms and comments that the markup itself tells, by element, role or whole class and id names, are stripped with it.

A line weighs the length of its text outside links; one without a letter outside its links weighs nothing. Window sums run over ``WINDOW`` lines. They dive to
nothing where lines without weight follow on each other with ``WINDOW`` links or more (a line counts as one at least): a menu
that nothing tells, which goes. The lines between two dives are a stretch; it surges if one of its window sums is over ``SURGE``. What surges is
text as a whole, with its headings, short lines and lines of links; if no stretch does, as on a page of a few words, all are.

``<article>`` and ``<main>`` are a feature of that decision: their edges are dives too, a stretch inside counts as surging, and one outside only surges if
it weighs more than all those inside together, as a body does beside a teaser.

Inside a line white space becomes one space, character references are decoded, lines are joined by one newline. One scan, no shuffle; a page is
handled whole, in time linear in its length. Cases: null and empty html give an empty text; paragraphs, list items and cells that are left open end where HTML
ends them; a closing tag without an opening one is nothing; a tag, comment or script that never ends goes up to the end of the page, but one
whose quote alone never closes ends at the next '>'; a '<' that opens no tag is text, except as the last character. Repeated pages
are read each. Extra columns are kept by ``with_main_text``, which refuses a column name that the pages already have; ``extract`` ignores them.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 60
# Fixed names of HTML elements.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style noscript template svg math iframe object canvas textarea title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = frozenset("nav footer aside form menu dialog head select button fieldset".split())
MAIN = frozenset("article main".split())
#: Elements that hold the text, whatever class they have.
UNTOLD = frozenset("article main body html".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
IN_HEAD = frozenset("meta link title script style base noscript template html head".split())
#: An element that may be left open ends where one of its kind begins, unless an element of its scope stands between: kind -> scope.
SCOPES = {"li": "ul ol menu dir", "dd": "dl", "td": "table tr", "tr": "table"}
KINDS = {"li": "li", "dd": "dd", "dt": "dd", "td": "td", "th": "td", "tr": "tr"}
_RESETS = {name: [i for i, scope in enumerate(SCOPES.values()) if name in scope.split()] for name in "ul ol menu dir dl table tr".split()}
_KIND = {name: list(SCOPES).index(kind) for name, kind in KINDS.items()}
#: Words that mark a part as not of the article, if its class or id is made of them and ``NEUTRAL`` words alone.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs pagination pager "
    "header masthead footer sidebar side aside rail related widget widgets recommended notice notices cookie cookies consent gdpr banner popup modal overlay alert newsletter subscribe signup "
    "login comment comments commentlist respond reply replies disqus discussion share sharing social toolbar form search copyright".split()
)
NEUTRAL = frozenset("site main top bottom left right upper lower primary secondary global box bar block area section wrapper wrap container list links link item items btn button buttons icon icons inner outer mobile desktop".split())
_NAME = re.compile(r"[^\s/>]+")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(\s*=\s*)?")
_BARE = re.compile(r"[^\s>]*")
_PARTS = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_LETTER = re.compile(r"[^\W\d_]")
_LONG_NUMBER = re.compile(r"&#([0-9]{8,});?")


def decode(text: str) -> str:
    """Character references as characters; numbers of any length."""
    if "&" not in text:
        return text
    number = lambda m: f"&#{x};" if len(x := m[1].lstrip("0")) < 8 else "�"
    return references.unescape(_LONG_NUMBER.sub(number, text))


class Reader:
    """Finds in one page, each search going on from where an equal one before it ended: what is not found once is not looked for again."""

    def __init__(self, page: str):
        self.page, self.missing = page, set()

    def find(self, text: str, at: int) -> int:
        if text in self.missing:
            return -1
        found = self.page.find(text, at)
        if found < 0:
            self.missing.add(text)
        return found

    def end_of(self, text: str, at: int) -> int:
        found = self.find(text, at)
        return len(self.page) if found < 0 else found + len(text)

    def attributes(self, at: int) -> tuple[dict[str, str], int, bool]:
        """Attributes by name from ``at`` on (of several with one name the first), where the tag ends, and whether it closes itself."""
        page, out = self.page, {}
        while True:
            m = _ATTRIBUTE.match(page, at)
            if not m:
                end = self.end_of(">", at)
                return out, end, page.endswith("/>", 0, end)
            name, at, value = m[1].lower(), m.end(), ""
            if m[2]:
                quote = page[at : at + 1]
                if quote and quote in "\"'":
                    stop = self.find(quote, at + 1)
                    if stop < 0:  # the quote never closes
                        return out, self.end_of(">", at), False
                    value, at = page[at + 1 : stop], stop + 1
                else:
                    value = _BARE.match(page, at)[0]
                    at += len(value)
            out.setdefault(name, value)


def marked(attributes: dict[str, str]) -> bool:
    """Whether class, id, role or hiding mark a part as not of the article."""
    if not attributes:
        return False
    for name in ("class", "id"):
        for token in attributes.get(name, "").split():
            parts = {x for x in _PARTS.split(_CAMEL.sub("-", token).lower()) if len(x) > 1}
            if parts & MARKS and parts <= MARKS | NEUTRAL:
                return True
    return (
        attributes.get("role", "").lower() in ROLES
        or "hidden" in attributes
        or attributes.get("aria-hidden", "").lower() == "true"
        or bool(_HIDING.search(attributes.get("style", "")))
    )


class Stack:
    """Open elements as (name, set aside, main, places of the open item of each kind in scope); the last one's state tells of what comes."""

    def __init__(self):
        self.open: list[tuple[str, bool, bool, list[int]]] = [("", False, False, [-1] * len(SCOPES))]
        self.names: dict[str, int] = {}
        self.aside = self.main = False

    def push(self, name: str, aside: bool, main: bool) -> None:
        items = self.open[-1][3]
        if name in _RESETS or name in _KIND:
            items = [-1 if k in _RESETS.get(name, ()) else x for k, x in enumerate(items)]
            if name in _KIND:
                items[_KIND[name]] = len(self.open)
        self.open.append((name, aside, main, items))
        self.names[name] = self.names.get(name, 0) + 1
        self.aside, self.main = aside, main

    def cut(self, depth: int) -> None:
        while len(self.open) > depth:
            self.names[self.open.pop()[0]] -= 1
        _, self.aside, self.main, _ = self.open[-1]

    def close(self, name: str) -> None:
        if self.names.get(name):
            depth = len(self.open) - 1
            while self.open[depth][0] != name:
                depth -= 1
            self.cut(depth)

    def begin(self, name: str) -> None:
        """Ends what an opening block element ends."""
        if self.names.get("head") and name not in IN_HEAD:
            self.close("head")
        if self.names.get("p"):
            self.close("p")
        if name in _KIND and (at := self.open[-1][3][_KIND[name]]) >= 0:
            self.cut(at)


def lines(page: str) -> Iterator[tuple[str, int, int, bool]]:
    """(text, weight, links that begin, in the marked main part) of each block that has text and is not told to be aside."""
    reader, stack = Reader(page), Stack()
    text: list[str] = []
    own, links, link_depth, at = 0, 0, -1, 0  # characters and letters outside links; links that begin; where in the stack a link is open
    letters = False

    def line() -> Iterator[tuple[str, int, int, bool]]:
        nonlocal own, links, letters
        joined = " ".join("".join(text).split())
        if joined:
            yield joined, own if letters or not links else 0, links, stack.main
        text.clear()
        own, links, letters = 0, 0, False

    while at < len(page):
        start = reader.find("<", at)
        part = page[at : start if start >= 0 else len(page)]
        if part and not stack.aside:
            part = decode(part)
            text.append(part)
            if link_depth < 0:
                own += len(part.strip())
                letters = letters or bool(_LETTER.search(part))
        if start < 0:
            break
        after = page[start + 1 : start + 2]
        closing = after == "/"
        name_at = start + 2 if closing else start + 1
        if not page[name_at : name_at + 1].isalpha() or not page[name_at].isascii():
            if after in ("!", "?") or closing:  # a comment, or what HTML takes for one
                comment = page.startswith("<!--", start)
                if comment and page.startswith((">", "->"), start + 4):
                    at = page.index(">", start) + 1
                else:
                    at = reader.end_of("-->", start + 4) if comment else reader.end_of(">", start)
            else:
                at = start + 1
                if at < len(page) and not stack.aside:
                    text.append("<")
                    own += link_depth < 0
            continue
        name = _NAME.match(page, name_at)[0]
        at = name_at + len(name)
        attributes, at, itself = ({}, at + 1, False) if page.startswith(">", at) else reader.attributes(at)
        name = name.lower()
        if name in RAW:
            if not closing and not itself:
                end = _ENDS[name].search(page, at) if name not in reader.missing else None
                if end is None:
                    reader.missing.add(name)
                at = reader.end_of(">", end.end()) if end else len(page)
            text.append(" ")
        elif name == "a":
            link_depth = -1 if closing else len(stack.open)
            links += not closing and not stack.aside
        elif name == "br":
            text.append(" ")
        elif name not in BLOCKS:  # its text stays in its block
            if not closing and not itself and name not in VOID and (name in ASIDE or marked(attributes)):
                stack.push(name, True, stack.main)
            elif closing:
                stack.close(name)
            elif stack.names.get(name) and not itself and name not in VOID:
                stack.push(name, stack.aside, stack.main)  # inside a marked one of the same name, whose end this one's is not
        else:
            if text or links:
                yield from line()
            if closing:
                stack.close(name)
            else:
                stack.begin(name)
                if name not in VOID:
                    told = name in ASIDE or name == "header" and not stack.main or name not in UNTOLD and marked(attributes)
                    stack.push(name, stack.aside or told, stack.main or name in MAIN)
            if len(stack.open) < link_depth:  # a link that was left open
                link_depth = -1
    yield from line()


def stretches(found: list[tuple[str, int, int, bool]]) -> Iterator[tuple[list[str], int, int, bool]]:
    """(lines, weight, largest window sum, in the marked main part) between dives and edges of the marked part."""
    own: list[str] = []
    weights: list[int] = []
    run: list[str] = []  # lines without weight since the last other one, and their links
    several, part = 0, False

    def done() -> Iterator[tuple[list[str], int, int, bool]]:
        nonlocal own, weights
        if own:
            sums = [sum(weights[i : i + WINDOW]) for i in range(max(1, len(weights) - WINDOW + 1))]
            yield own, sum(weights), max(sums), part
        own, weights = [], []

    for text, weight, links, main in [*found, ("", 1, 0, None)]:
        if main is not part or main is None:
            if several < WINDOW:
                own += run
                weights += [0] * len(run)
            run, several = [], 0
            yield from done()
            part = main
        if links and not weight:
            run.append(text)
            several += max(1, links)
            continue
        if several >= WINDOW:
            yield from done()
        else:
            own += run
            weights += [0] * len(run)
        run, several = [], 0
        own.append(text)
        weights.append(weight)


def main_text(page: str | None) -> str:
    """The lines of the stretches that surge."""
    found = list(lines(page or ""))
    parts = list(stretches(found))
    inside = sum(weight for _, weight, _, main in parts if main)
    least = inside if any(x[3] for x in parts) else -1
    kept = [own for own, weight, most, main in parts if main or most > SURGE and weight > least]
    if not kept:
        kept = [own for own, _, _, _ in parts] or [[x[0] for x in found]]
    return "\n".join(t for own in kept for t in own)


def with_main_text(pages: DataFrame, column: str = "text") -> DataFrame:
    """The pages with their main text."""
    if column.lower() in map(str.lower, pages.columns):
        raise ValueError(f"the pages have a column {column} already; name another")

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield pa.array([main_text(p.as_py()) for p in pages], pa.string())

    return pages.withColumn(column, F.arrow_udf(run, "string").asNondeterministic()(F.col("html")))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and its length in code points."""
    out = with_main_text(pages.select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
