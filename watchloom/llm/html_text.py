"""Main text of web pages by two-pass block rules.

The page is cut into blocks at block-level tags. Menus, forms, footers, side elements, hidden ones and those whose role or class
names them as such are boilerplate with all they hold, but for a named one that holds an article. The first pass scores
every other block: words, its density of stop words and its length speak for it, a high share of link text against it; a block in
an article or main element gets a point, one outside it loses three where the page has such an element and
most of its dense text lies there. A clear score decides. The rest are short, ambiguous blocks: in the second pass
each inherits the label of the nearest decided neighbour on its side of the article's border, the one before it on ties.
Where none is decided, blocks of an article are text and all others are not. On pages without such an element, list items
before the first dense block are a menu, and where no block is dense at all, those that are not mostly links are text.

Where nothing dense is kept although forms, hidden elements, roles or names drop dense text, those of them that hold at least half of it are
taken for wrappers of the page: they drop nothing, and the blocks are judged anew.

A tag is read attribute by attribute. Pages are read in time linear in their length, whatever is left open: a quote that no
later one closes ends at its tag, and an unfinished tag or comment at the end of the page is markup.
Character references are decoded after tags are removed. Null and empty pages give an empty text; pages may be of any length, rows may repeat,
other columns play no part, and an empty table gives no rows.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.llm.storage import bounded

# Element names, words in class or id that mark boilerplate, and common short words.
BLOCK_TAGS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
DROPPED_TAGS = frozenset("aside audio button canvas datalist dialog footer form head iframe input menu nav noscript object option script select style svg template textarea title video".split())
RAW_TAGS = frozenset("iframe noscript script style template textarea title".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED_NAMES = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice pagination popup promo promoted promotion related respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets".split())
#: Of these a name's first part is meant: ``comment-list``, not ``list``.
PLAIN_HEADS = frozenset("area articles bar block body bottom box button buttons center column container content form group holder inner item items label left link links list main message module outer panel placeholder posts region right row section slot text thread title top unit wrap wrapper zone".split())
NEGATIONS = frozenset("has is no not non with without".split())
DROPPED_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
STOP_WORDS = frozenset(
    "a about and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which will with you "
    "au aux avec ce dans de des du elle en est et il la le les leur lui mais ne nous ou par pas pour que qui sa se ses son sur un une vous "
    "als am an auch auf aus bei das dem den der des die ein eine einer es für hat ich im ist mit nach nicht noch sich sie sind und von war wie wird zu "
    "al como con del el ella en era es esta la las lo los más mi no para pero por que se sin su sus te un una y ya".split()
)
_SAME = {"td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
_END_MAY_LACK = frozenset("p li dt dd option tr td th".split())

LONG_CHARS, RICH_CHARS = 140, 40
STOP_SHARE, LINK_SHARE = 0.20, 0.5
#: The article counts as such if it holds this share of the page's dense text.
ARTICLE_SHARE = 0.25

_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(\s*=\s*)?")
_PLAIN_VALUE = re.compile(r"[^\s>]*")
_SPLIT = re.compile(r"[-_.:]+|(?<=[a-z])(?=[A-Z])")
_HIDDEN_STYLE = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)


def attributes(page: str, at: int, last: dict[str, int]) -> tuple[dict[str, str], int, bool]:
    """Attributes of a tag from behind its name on, where the tag ends, and whether it ends by ``>`` at all; ``last`` has the last place of either quote."""
    found: dict[str, str] = {}
    while True:
        m = _ATTRIBUTE.match(page, at)
        if m is None:
            end = page.find(">", at)
            return found, (len(page) if end < 0 else end + 1), end >= 0
        at, value = m.end(), ""
        if m.group(2):
            quote = page[at : at + 1]
            close = page.find(quote, at + 1) if last.get(quote, -1) > at else -1
            if close >= 0:
                value, at = page[at + 1 : close], close + 1
            else:
                m2 = _PLAIN_VALUE.match(page, at)
                value, at = m2.group(), m2.end()
        found.setdefault(m.group(1).lower(), value)


def _is_name(token: str, names: frozenset) -> bool:
    """Whether a class token or id is one of the names, or a compound that means one."""
    parts = [x.lower() for x in _SPLIT.split(token) if x]
    if not parts or not NEGATIONS.isdisjoint(parts):
        return False
    while len(parts) > 1 and (parts[-1] in PLAIN_HEADS or parts[-1].isdigit()):
        parts.pop()
    return parts[-1] in names


_OUTER_NAMES = frozenset("header masthead banner".split())


def _marked(attrs: dict[str, str], inside: bool) -> tuple[bool, bool]:
    """Whether an element is hidden or has a role of boilerplate, and whether its class or id names it so.

    Inside an article a header is that of the article.
    """
    hard = "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or attrs.get("role", "").lower() in DROPPED_ROLES or _HIDDEN_STYLE.search(attrs.get("style", "")) is not None
    names = DROPPED_NAMES - _OUTER_NAMES if inside else DROPPED_NAMES
    return hard, any(_is_name(t, names) for t in (attrs.get("class", "") + " " + attrs.get("id", "")).split())


class _Element:
    """An open element that is a block or drops what it holds; ``outer`` is the next such dropper around it."""

    __slots__ = ("name", "article", "firm", "hard", "named", "outer", "final", "mass")

    def __init__(self, name: str, article: bool, firm: bool, hard: bool, named: bool, outer: _Element | None):
        self.name, self.article, self.firm, self.hard, self.named, self.outer = name, article, firm, hard, named, outer
        self.final: bool | None = None
        self.mass = 0


def _dropped(e: _Element | None) -> bool:
    """Whether an element or one around it drops its blocks, asked when all names are settled; each element is passed once."""
    passed = []
    while e is not None and e.final is None and not (e.firm or e.hard or e.named):
        passed.append(e)
        e = e.outer
    found = e is not None and bool(e.firm or e.hard or e.named or e.final)
    for x in passed:
        x.final = found
    return found


class _Reader:
    """Blocks of a page. Inline elements leave no trace but the open link, so each tag costs a bounded number of steps."""

    def __init__(self) -> None:
        self.out: list[tuple[str, int, _Element | None, bool]] = []
        self.every: list[_Element] = []
        self.stack: list[_Element] = []
        self.by_name: dict[str, list[int]] = {}
        self.naming: list[_Element] = []  # open elements that only their names drop
        self.articles = 0
        self.link: int | None = None  # how many elements were open when the link was
        self.parts: list[str] = []
        self.links: list[str] = []

    def text(self, piece: str) -> None:
        self.parts.append(piece)
        if self.link is not None:
            self.links.append(piece)

    def flush(self) -> None:
        text = " ".join(_html.unescape("".join(self.parts)).split())
        if text:
            links = " ".join(_html.unescape("".join(self.links)).split())
            self.out.append((text, len(links), self.stack[-1] if self.stack else None, self.articles > 0))
        self.parts, self.links = [], []

    def _cut(self, at: int) -> None:
        """Close the element at a place and all in it."""
        while len(self.stack) > at:
            e = self.stack.pop()
            self.by_name[e.name].pop()
            self.articles -= e.article
            if self.naming and self.naming[-1] is e:
                self.naming.pop()
        if self.link is not None and self.link > at:
            self.link = None

    def opened(self, name: str, attrs: dict[str, str], alone: bool) -> None:
        if name == "br":
            self.parts.append(" ")
            return
        inside, article = self.articles > 0, name in ("article", "main")
        firm, hard, named = name in DROPPED_TAGS and name != "form" or name == "header" and not inside, name == "form", False
        if name not in ("html", "body", "article", "main"):
            more, named = _marked(attrs, inside)
            hard |= more
        kept = name in BLOCK_TAGS or firm or hard or named
        if kept:
            self.flush()
        if name in _END_MAY_LACK and self.stack and self.stack[-1].name in _SAME.get(name, (name,)):
            self._cut(len(self.stack) - 1)
        if kept and name not in VOID_TAGS and not (alone and name == "svg"):
            if article:
                for e in self.naming:  # a name does not drop an article
                    e.named = False
                self.naming.clear()
            e = _Element(name, article, firm, hard, named, self.stack[-1] if self.stack else None)
            self.every.append(e)
            self.by_name.setdefault(name, []).append(len(self.stack))
            if named and not (firm or hard):
                self.naming.append(e)
            self.stack.append(e)
            self.articles += article
        if name == "a":
            self.link = len(self.stack)

    def closed(self, name: str) -> None:
        places = self.by_name.get(name)
        if name in BLOCK_TAGS or places:
            self.flush()
        if name == "a":
            self.link = None
        if places:
            self._cut(places[-1])


def _raw_end(page: str, name: str, at: int) -> int:
    """Where an element whose content is no markup ends."""
    m = _RAW_ENDS[name].search(page, at)
    return m.end() if m else len(page)


_RAW_ENDS = {name: re.compile(rf"</{name}(?![^\s/>])[^>]*>?", re.I) for name in RAW_TAGS}


def blocks(page: str) -> list[tuple[str, int, bool, bool, bool]]:
    """``(text, link characters, dropped, inside the article, list item)`` of every block with text, in page order."""
    r = _read(page)
    found = _settled(r)
    if not any(_mass(b) for b in found if not b[2]) and _unwrap(r):
        found = _settled(r)
    return found


def _mass(block: tuple) -> int:
    """The characters of a dense block that is not mostly links."""
    return len(block[0]) if dense(block[0]) and block[1] <= LINK_SHARE * len(block[0]) else 0


def _settled(r: _Reader) -> list[tuple[str, int, bool, bool, bool]]:
    return [(text, links, _dropped(e), inside, e is not None and e.name == "li") for text, links, e, inside in r.out]


def _unwrap(r: _Reader) -> bool:
    """Take the mark off elements, but for those that their tags drop, that hold at least half of the dense text there is; whether there were any."""
    for text, links, e, _ in r.out:
        if e is not None:
            e.mass += _mass((text, links))
    for e in reversed(r.every):  # an element is opened after the one around it
        if e.firm:
            e.mass = 0
        if e.outer is not None:
            e.outer.mass += e.mass
    total = sum(e.mass for e in r.every if e.outer is None)
    heavy = [e for e in r.every if (e.hard or e.named) and total and 2 * e.mass >= total]
    for e in heavy:
        e.hard = e.named = False
    for e in r.every:
        e.final = None
    return bool(heavy)


def _read(page: str) -> _Reader:
    r, at, n = _Reader(), 0, len(page)
    last = {q: page.rfind(q) for q in ("'", '"')}
    while at < n:
        start = page.find("<", at)
        if start < 0:
            r.text(page[at:])
            break
        if start > at:
            r.text(page[at:start])
        fixed = next((x for x in (("<!--", "-->"), ("<![CDATA[", "]]>")) if page.startswith(x[0], start)), None)
        if fixed:
            end = page.find(fixed[1], start + len(fixed[0]))
            at = n if end < 0 else end + 3
            continue
        closing = page.startswith("</", start)
        m = _TAG_NAME.match(page, start + 1 + closing)
        if m is None:
            if closing or page.startswith(("<!", "<?"), start):
                end = page.find(">", start)
                at = n if end < 0 else end + 1
            else:
                r.text("<")
                at = start + 1
            continue
        name = m.group().lower()
        attrs, at, ended = attributes(page, m.end(), last)
        if not ended:
            break
        if closing:
            r.closed(name)
        elif name in RAW_TAGS:
            r.flush() if name in BLOCK_TAGS else r.parts.append(" ")
            at = _raw_end(page, name, at)
        else:
            r.opened(name, attrs, page[at - 2] == "/")
    r.flush()
    return r


def dense(text: str) -> bool:
    """Whether a block is long, or rich in stop words."""
    if len(text) >= LONG_CHARS:
        return True
    own = text.lower().split()
    stops = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in own)
    return len(text) >= RICH_CHARS and stops >= STOP_SHARE * len(own)


def labels(found: list[tuple]) -> list[bool]:
    """Which blocks are main text."""
    rich, linked = [dense(b[0]) for b in found], [b[1] > LINK_SHARE * len(b[0]) for b in found]
    mass = [len(b[0]) if r and not x and not b[2] else 0 for b, r, x in zip(found, rich, linked)]
    inner = sum(m for m, b in zip(mass, found) if b[3])
    scoped = any(b[3] and not b[2] for b in found) and inner >= ARTICLE_SHARE * sum(mass)
    out: list[bool | None] = []
    for b, r, x in zip(found, rich, linked):
        score = (-2 if x else 2 if r else 0) + ((1 if b[3] else -3) if scoped else 0)
        out.append(False if b[2] or score <= -2 else True if score >= 2 else None)
    # menu items are left out, and say nothing about the blocks beside them
    menu = {i for i in range(out.index(True)) if out[i] is None and found[i][4:] == (True,)} if not scoped and True in out else set()
    for side in (True, False):
        # dropped blocks say nothing about those beside them in an article
        own = [i for i, b in enumerate(found) if (not scoped or b[3] == side) and not (scoped and side and b[2]) and i not in menu]
        _inherit(out, own, default=scoped and side)
        if not scoped:
            break
    return [bool(x) for x in out]


def _inherit(out: list[bool | None], own: list[int], default: bool) -> None:
    """Undecided blocks take the label of the nearest decided one of ``own``, the one before on ties."""
    given = [out[i] for i in own]
    after, ahead = [None] * len(own), None
    for k in range(len(own) - 1, -1, -1):
        ahead = k if given[k] is not None else ahead
        after[k] = ahead
    before = None
    for k, i in enumerate(own):
        if given[k] is not None:
            before = k
            continue
        near = [j for j in (before, after[k]) if j is not None]
        out[i] = given[min(near, key=lambda j: (abs(k - j), j))] if near else default


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    kept = labels(found)
    if not any(kept):  # no block is dense: length is all there is to go by
        kept = [not b[2] and b[1] <= LINK_SHARE * len(b[0]) for b in found]
    return "\n\n".join(b[0] for b, yes in zip(found, kept) if yes)


def extract_table(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(t.as_py()) for t in batch.column(2)]
            yield pa.record_batch({"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    bounded(pages.sparkSession)
    rows = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
