"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.llm.shared import in_batches, own

# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset(
    "head nav footer aside form button select option datalist script style title textarea noscript iframe template "
    "svg math object canvas audio video dialog menu input".split())
ARTICLE = frozenset(["article", "main"])
#: Elements whose start ends an open paragraph, and those that end one of their own kind.
ENDS_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
    "section table ul".split())
ENDS_SAME = frozenset("li dt dd tr td th option".split())
#: Names of classes and ids, without hyphens and underscores, and roles that mark what may not be the article.
MARKS = frozenset(
    "ad ads adbox adcontainer adsense adslot adspace adunit advert advertisement advertisements advertising adverts alert "
    "announcement banner breadcrumb breadcrumbs comment commentlist comments complementary consent contentinfo cookie "
    "cookies dialog discussion disqus footer gdpr hidden login menu menus modal nav navbar navigation newsletter notice "
    "notices overlay pager pagination popup promo promoted promotion recommended recommendations related replies reply respond "
    "search share sharing side sidebar sidebars signup social sponsor sponsored subscribe subscription toolbar widget "
    "widgets "
    # Names made of two words: a mark inside another name, as in no-sidebar, says nothing.
    "adbanner adblock adbox adsbox adslot adwrapper authorbox backtotop bottomnav commentform commentlist commentrespond "
    "commentsarea commentsection commentslist cookiebanner cookiebar cookieconsent cookienotice cookiepolicy footernav "
    "leftsidebar mainmenu mainnav mainnavigation morestories navbar navmenu newsletterform newslettersignup pagefooter pagenav "
    "pagenavigation postnavigation primarynav readmore recommendedarticles relatedarticles relatedcontent relatedlinks relatedposts "
    "relatedstories rightsidebar searchbar searchbox searchform sharebar sharebuttons sharelinks sidebarleft sidebarright "
    "sidenav sitefooter sitenav sitenavigation skiplink skiplinks socialicons sociallinks socialmedia socialshare "
    "sponsoredcontent subscribeform topmenu topnav usercomments widgetarea".split())
#: Marks that are as well names of parts of an article, and so lower its score less.
WEAK_MARKS = frozenset(
    "alert announcement dialog discussion login menu menus notice notices pager promotion recommended recommendations related "
    "replies reply respond search share sharing side social sponsor subscription toolbar".split())
#: Marks that count outside an article only, where its own head may bear them.
OUTER_MARKS = frozenset("header masthead topbar topnav".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"
    # A quote opens a value only behind =, so that an apostrophe in a bare value is a letter of it.
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)>""", re.S)
_LOOSE = re.compile(r"<(?:/?[a-zA-Z!?][^<]*|/?)\Z")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_UNSEEN = re.compile(r"""\bstyle\s*=\s*["']?[^"'>]*\b(?:display\s*:\s*none|visibility\s*:\s*hidden)""", re.I)
#: What the scores in a marked element are multiplied by.
PENALTIES = {"!": 0.5, "!!": 0.05}
_JOINTS = re.compile(r"[-_]+")
_HEADING = re.compile(r"h[1-6]\Z")
_BLANKS = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")


@dataclass(eq=False)
class Element:
    """An open or closed element: its parent, the number of its path of tags and whether it can hold main text."""

    name: str
    parent: Element | None
    path: int
    shut: bool
    inside: bool  # within an article or main element
    mark: str = ""  # ! or !!: bears a class or id that marks what may not be the article
    depth: int = 0
    linked: bool = False  # in a link, with inline elements alone between
    holder: Element = field(init=False)  # itself, or what its inline elements stand in

    def __post_init__(self) -> None:
        self.holder = self.parent.holder if self.parent and self.name in INLINE else self


@dataclass
class Block:
    """A stretch of text between block borders, and the element it stands in."""

    at: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        return _BLANKS.sub(" ", entities.unescape("".join(self.parts))).strip()


def _marks(rest: str, inside: bool) -> tuple[bool, str]:
    """Whether an element is hidden or has the role of a part beside the article, and how whole class names or an id mark it."""
    shut, mark = bool(_UNSEEN.search(rest)), ""
    for name, value in _ATTRIBUTE.findall(rest):
        words = {_JOINTS.sub("", w) for w in (value or name).strip("\"'").lower().split()}
        found = MARKS & words if inside else (MARKS | OUTER_MARKS) & words
        if name.lower() in ("role", "hidden"):
            shut = shut or bool(found) or name.lower() == "hidden"
        elif found:
            mark = max(mark, "!!" if found - WEAK_MARKS else "!")
    return shut, mark


def _element(name: str, rest: str, parent: Element, paths: dict[tuple[int, str], int]) -> Element:
    shut, mark = parent.shut or name in NEVER or (name == "header" and not parent.inside), ""
    if not shut and name not in ("html", "body", "main") and rest:
        shut, mark = _marks(rest, parent.inside)
        if name in INLINE or name in ARTICLE or _HEADING.match(name):
            mark = ""
    # Blocks of a marked element have a path, and so a ratio, of their own.
    path = paths.setdefault((parent.path, name + mark), len(paths) + 1)
    linked = name in INLINE and (name == "a" or parent.linked)
    return Element(name, parent, path, shut, parent.inside or name in ARTICLE, mark, parent.depth + 1, linked)


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order, with the elements they stand in."""
    root = Element("", None, 0, False, False)
    here, block, blocks = root, Block(root), []
    paths: dict[tuple[int, str], int] = {}
    opened: Counter[str] = Counter()
    at, size = 0, len(page)
    stop = page.rfind(">") + 1

    def border(new: Element) -> None:
        nonlocal block
        if block.parts:
            blocks.append(block)
        block = Block(new)

    def say(text: str) -> None:
        if text and not here.shut:
            block.parts.append(text)
            if here.linked:
                block.linked += len(text)

    def leave(e: Element) -> None:
        nonlocal here
        while here is not e.parent:
            opened[here.name] -= 1
            here = here.parent
        if e.name not in INLINE or e.shut != here.shut:
            border(here.holder)

    while at < size:
        token = _TOKEN.search(page, at, stop)
        if not token:
            loose = _LOOSE.search(page, at)
            say(page[at:loose.start() if loose else size])
            break
        say(page[at:token.start()])
        at = token.end()
        name = (token["name"] or "").lower()
        if not name:
            if token[0].startswith("<!--") and not token[0].endswith("-->"):
                break
            if token[0].startswith("<![CDATA["):
                say(token[0][9:-3].replace("&", "&amp;"))
            continue
        if token["end"]:
            e = here
            while opened[name] and e is not root and e.name != name:
                # A closing tag doesn't reach out of a cell or an article.
                e = root if e.name in ("td", "th", "article", "main") and name in INLINE else e.parent
            if opened[name] and e is not root:
                leave(e)
            continue
        over = here.holder
        if over.name == "p" and name in ENDS_P or over.name == name and name in ENDS_SAME:
            leave(over)
        rest = token["rest"]
        if name in VOID:
            if name == "br":
                say(" ")
            elif name not in INLINE:
                border(here.holder)
            continue
        if rest.endswith("/") and name in ("svg", "path"):
            continue
        new = _element(name, rest, here, paths)
        if name in RAW:
            closing = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = closing.end() if closing else size
            if name not in INLINE:
                border(here.holder)
            continue
        changed = new.shut != here.shut
        here = new
        opened[name] += 1
        if name not in INLINE or changed:
            border(here.holder)
    border(root)
    return blocks


def path_scores(paths: list[int], lengths: list[int], points: list[int], radius: int = 1) -> np.ndarray:
    """The fused ratio of each block: text and punctuation per block of its path, smoothed along the page."""
    names, index = np.unique(paths, return_inverse=True)
    n = np.bincount(index, minlength=len(names))
    text = np.bincount(index, lengths, len(names)) / n
    marks = np.bincount(index, points, len(names)) / n
    offsets = np.arange(-radius, radius + 1)
    kernel = np.exp(-offsets ** 2 / 2)
    share = np.convolve(np.ones(len(paths)), kernel, "full")[radius:radius + len(paths)]

    def smooth(ratio: np.ndarray) -> np.ndarray:
        return np.convolve(ratio[index], kernel, "full")[radius:radius + len(paths)] / share

    return smooth(text) * np.log1p(smooth(marks) + 1)


def _elements(blocks: list[Block]) -> list[Element]:
    """The elements blocks stand in, parents before those inside them."""
    found: dict[Element, None] = {}
    for block in blocks:
        e: Element | None = block.at
        while e is not None and e not in found:
            found[e] = None
            e = e.parent
    return sorted(found, key=lambda e: e.depth)


def _held(blocks: list[Block], sizes: list[int], elements: list[Element]) -> dict[Element, int]:
    """Text by element, with all the elements inside it."""
    held = dict.fromkeys(elements, 0)
    for block, size in zip(blocks, sizes, strict=True):
        held[block.at] += size
    for e in reversed(elements):
        if e.parent:
            held[e.parent] += held[e]
    return held


def _passed_down(elements: list[Element], start, of) -> dict:
    """Per element a value made of it and its parent's."""
    values = {None: start}
    for e in elements:
        values[e] = of(e, values[e.parent])
    return values


def main_text(page: str | None, spread: float = 0.5) -> str:
    """The article of a page, its blocks joined by empty lines.

    Content blocks score at least ``spread`` standard deviations of all scores, or half the best. A class or id that marks an
    element lowers the scores in it (``PENALTIES``), unless the element holds most of the text and no article or main is beside it. The outermost article or main element with most of the content bounds the article, or else nothing does. Of
    the other blocks there belong to it: headings, and short blocks from the first content block to the end of the elements that
    hold all content, but no marked ones and no lists of links; and what stands between a heading and the first content block.
    """
    found = [(b, t) for b in blocks_of(page or "") if (t := b.text())]
    if not found:
        return ""
    blocks = [b for b, _ in found]
    lengths = [max(0, len(t) - min(len(t), b.linked)) for b, t in found]
    scores = path_scores([b.at.path for b in blocks], lengths, [len(_PUNCTUATION.findall(t)) for _, t in found])
    elements = _elements(blocks)
    held = _held(blocks, lengths, elements)
    # Beside an article or main element no other part of the page is the most of it.
    articles = _held(blocks, [0] * len(blocks), elements)
    for e in reversed(elements):
        articles[e] += e.name in ARTICLE
        if e.parent:
            articles[e.parent] += articles[e]
    root = elements[0]
    weighed = {e: PENALTIES[e.mark] for e in elements
               if e.mark and not (2 * held[e] > held[root] and (not articles[root] or e.inside or articles[e]))}
    nearest = _passed_down(elements, None, lambda e, above: e if e in weighed else above)
    factor = _passed_down(elements, 1.0, lambda e, above: min(above, weighed.get(e, 1.0)))
    marked = [nearest[b.at] for b in blocks]
    scores = scores * [factor[b.at] for b in blocks]
    limit = min(spread * float(scores.std()), 0.5 * float(scores.max()))
    linked = [n < len(t) / 2 for n, (_, t) in zip(lengths, found, strict=True)]
    # The neighbours' text must not carry a list of links over the threshold.
    content = [s >= limit and not (link and s < scores.max()) for s, link in zip(scores, linked, strict=True)]

    held = _held(blocks, [n if c else 0 for n, c in zip(lengths, content, strict=True)], elements)
    bounds = [e for e in elements if e.name in ARTICLE and 2 * held[e] > held[root]]
    bound = min(bounds, key=lambda e: e.depth, default=None)
    within = _passed_down(elements, bound is None, lambda e, above: above or e is bound)
    inside = [within[b.at] for b in blocks]
    content = [c and i for c, i in zip(content, inside, strict=True)]
    # What all content blocks stand in.
    home = bound
    if home is None:
        amount = _held(blocks, content, elements)
        home = max((e for e in elements if amount[e] == amount[root]), key=lambda e: e.depth)
    at_home = _passed_down(elements, False, lambda e, above: above or e is home)
    headed = _passed_down(elements, False, lambda e, above: above or bool(_HEADING.match(e.name)))
    # Marked elements with content from a block on.
    ahead: set[Element | None] = set()
    followed = [False] * len(blocks)
    for i in reversed(range(len(blocks))):
        if content[i]:
            ahead.add(marked[i])
        followed[i] = marked[i] in ahead
    first = content.index(True)

    def short(i: int) -> bool:
        return inside[i] and marked[i] is None and not linked[i]

    def heading(i: int) -> bool:
        # One in a marked element goes with the content behind it there.
        return inside[i] and headed[blocks[i].at] and (not marked[i] or followed[i])

    keep = [c or (heading(i) or i > first and short(i)) and at_home[blocks[i].at] for i, c in enumerate(content)]
    # The head: from the nearest heading on, over short blocks.
    start = first
    while start > 0 and (heading(start - 1) or short(start - 1)):
        start -= 1
    heads = [i for i in range(start, first) if heading(i)]
    for i in range(heads[0] if heads else first, first):
        keep[i] = True
    if bound is not None:
        keep = [k or short(i) for i, k in enumerate(keep)]
    return "\n\n".join(t for k, (_, t) in zip(keep, found, strict=True) if k)


def extract_main_text(
    pages: DataFrame, html: str = "html", carry: list[str] | None = None,
) -> DataFrame:
    """The columns ``carry`` (all by default) with ``text``, the main text, and ``n_chars``, its code points.

    Whole pages are read, cut off or malformed ones too; a missing page is empty and has an empty text. Rows are
    independent: nothing is shuffled, repeated rows have equal results, no rows give none. Columns
    of ``pages`` named like the results are replaced.
    """
    carry = [c for c in (pages.columns if carry is None else carry) if c not in ("text", "n_chars")]
    source = own("html")
    rows = pages.select(*carry, F.col(html).alias(source))
    schema = T.StructType([
        *pages.select(*carry).schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py()) for p in batch.column(len(carry))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(carry)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=[*carry, "text", "n_chars"])

    return in_batches(rows, run, schema)
