"""Main text of web pages by equivalence-class template deduction."""

from __future__ import annotations

import html as _html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import written

# Elements of HTML by their role.
_RAW = "script|style|textarea|title"
_HIDDEN = frozenset("canvas iframe noscript select svg template".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCK - frozenset(("html", "head", "body"))
_SIDE = frozenset("nav footer aside form menu head dialog label legend fieldset".split())
_HEAD = frozenset(("h1", "h2"))
#: Elements that hold text rather than other blocks.
_TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt pre blockquote figcaption summary option th td tr".split())
_SIDE_WORD = (
    r"(?:ads?|advert\w*|adbox|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|disqus|foot|footer|form|gdpr|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notification|pager|pagination|popup|"
    r"promo\w*|related|replies|respond|search|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|toolbar|widgets?)"
)
# whole class names: a word, or a compound of words and what they usually stand with; no states or layouts (has-header, sidebar-right)
_SIDE_NAME = re.compile(
    rf"(?<!\S)(?:(?:(?:site|page|main|global|top|bottom|post|entry|article|primary|secondary|user|blog)[-_]+)?{_SIDE_WORD}(?:[-_]+(?:{_SIDE_WORD}|area|bar|block|box|buttons?|container|icons?|inner|items?|links?|list|message|overlay|posts?|section|text|title|unit|wrap|wrapper|\d+))*|(?:(?:site|page|main|global|top)[-_]?)?header)(?!\S)"
)
_MAIN_NAME = re.compile(r"(?:^|[\s_-])(?:article|articlebody|content|entry|main|post|story)(?:$|[\s_-])")

_COMMENT = r"<!--.*?(?:-->|$)"
_OTHER = rf"<({_RAW})(?:/>|(?=[\s>/])[^>]*(?:(?<=[\s\"']/)>|(?<![\s\"']/)>.*?(?:</\1\s*>|$)))"
_NAME = r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)"
#: Quoted values may hold '>'. Where a quote has no end, tags end at the next '>', and from there on quotes no longer count.
_QUOTED = re.compile(rf"{_COMMENT}|{_OTHER}|{_NAME}((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?+)*+)>|{_NAME}([^>]*)>|<[!?/][^>]*>", re.S | re.I)
_PLAIN = re.compile(rf"{_COMMENT}|{_OTHER}|(?!)()()()|{_NAME}([^>]*)>|<[!?/][^>]*>", re.S | re.I)
_HIDING = re.compile(rf"<(/?)({'|'.join(sorted(_HIDDEN))})(?=[\s>/])[^>]*>", re.I)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def _mark(parent: int, name: str) -> int:
    return int.from_bytes(blake2b(b"%d/%s" % (parent, name.encode("utf-8", "replace")), digest_size=8).digest(), "little", signed=True)


_ARTICLE, _MAIN, _HELD, _NAMED, _BODY = 1, 2, 3, 4, 5


class _Element:
    """An element of a page. ``token`` names its place: its tag, names and place among its like, under its parent's."""

    __slots__ = ("article", "blocks", "depth", "edge", "heads", "held", "hidden", "kids", "links", "named", "role", "side", "tag", "token", "under", "up", "words")

    def __init__(self, tag: str, up: _Element | None, token: int, side: bool = False, hidden: bool = False):
        self.tag, self.up, self.token, self.side, self.hidden = tag, up, token, side, hidden
        self.depth = up.depth + 1 if up else 0
        self.role, self.named, self.edge, self.held, self.kids = 0, False, False, False, None
        self.article = up.article if up else False  # in an article or main
        self.under: _Element | None = None  # the nearest element, itself included, with a side's name
        self.words = self.links = self.heads = self.blocks = 0  # of all text below, but for sides: words outside links, in links, in first headings; blocks


@dataclass
class Page:
    """What one pass over a page finds: its elements, parents first, and its text blocks with the element around each."""

    elements: list[_Element] = field(default_factory=list)
    blocks: list[tuple[_Element, str, int, int]] = field(default_factory=list)


def _hiding(text: str, end: int) -> set[int]:
    """Where elements of ``_HIDDEN`` begin that have an end tag."""
    found, open_ = set(), {}
    for m in _HIDING.finditer(text, 0, end):
        at = open_.setdefault(m[2].lower(), [])
        if not m[1] and not m[0].endswith("/>"):
            at.append(m.start())
        elif m[1] and at:
            found.add(at.pop())
    return found


def _tags(text: str, end: int) -> Iterator[re.Match]:
    """Tags and what leaves nothing; each character is looked at a bounded number of times."""
    matches = _QUOTED.finditer(text, 0, end)
    while True:
        for m in matches:
            yield m
            if m[6]:
                matches = _PLAIN.finditer(text, m.end(), end)
                break
        else:
            return


def parse(text: str) -> Page:
    """Elements and text blocks in page order.

    Comments, scripts, styles, text areas and titles leave nothing, to the page's end if they have none. Nor do drawings,
    frames, selections, templates and what is shown without scripts or canvas: these end with their own end tag or an
    outer element's, drawings and selections at a block too; without an end tag they hide nothing.
    """
    page, pending, at = Page(), [], 0
    top = base = _Element("", None, 0)
    open_: Counter[str] = Counter()
    holders: list[_Element] = []
    end = text.rfind(">") + 1
    hiding = _hiding(text, end)
    linked = False
    free = False  # an article that no name takes for a side's

    def flush() -> None:
        nonlocal linked
        if top.hidden:
            return
        if pending:
            block = " ".join(_html.unescape("".join(p for p, _ in pending)).split())
            if block:
                words = block.count(" ") + 1
                links = min(words, sum(len(p.split()) for p, a in pending if a))
                page.blocks.append((top, block, words - links, links))
        pending.clear()
        linked = False

    last = None
    for m in _tags(text, end):
        if m.start() > at and not top.hidden:
            pending.append((text[at : m.start()], linked))
        at, last = m.end(), m
        closing, tag, rest = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            if not top.hidden:
                pending.append((" ", linked))
            continue
        if tag == "a":
            linked = not closing
            continue
        if not closing and tag in _BLOCK and tag != "option" and top.tag in ("svg", "select"):
            open_[top.tag] -= 1
            top = top.up  # a block can't be in these
        if closing:
            if open_[tag] > 0:
                while top.tag != tag and top.hidden:
                    open_[top.tag] -= 1
                    top = top.up
                if tag in _BLOCK:
                    flush()
                while True:
                    open_[top.tag] -= 1
                    top, done = top.up, top.tag == tag
                    if done:
                        break
            elif tag in _BLOCK:
                flush()
            continue
        if tag in _BLOCK:
            flush()
        if top.hidden or m.start() in hiding:
            if tag in _BLOCK or tag in ("foreignobject", *_HIDDEN):
                top = _Element(tag, top, top.token, True, True)
                open_[tag] += 1
            continue
        if tag in _VOID or tag not in _BLOCK:
            continue
        if (tag in _CLOSES_P and top.tag == "p") or (tag in ("li", "dd", "dt", "tr", "td", "th", "option") and top.tag == tag):
            open_[top.tag] -= 1
            top = top.up
        if tag in ("li", "dd", "dt", "tr", "td", "th", "option") and top.tag == tag:
            open_[top.tag] -= 1
            top = top.up
        names = " ".join(a or b or c for a, b, c in _NAMES.findall(rest)).lower() if rest.strip() else ""
        like = f"{tag} {re.sub(r'[0-9]+', '#', names)}"
        if top.kids is None:
            top.kids = Counter()
        top.kids[like] += 1
        e = _Element(tag, top, _mark(top.token, f"{like} {top.kids[like]}"))
        e.edge = tag in _SIDE or (tag == "header" and not top.article)
        e.side = top.side or e.edge
        e.named = bool(names and not e.side and tag != "body" and _SIDE_NAME.search(names))
        e.under = e if e.named else top.under
        if not e.side:
            e.role = _ARTICLE if tag == "article" else _MAIN if tag == "main" or names == "main" else _BODY if tag == "body" else _NAMED if names and not e.under and _MAIN_NAME.search(names) else 0
        if e.role in (_ARTICLE, _MAIN):
            free = free or (e.role == _ARTICLE and not e.under)
            over = e.under
            e.role = _HELD if over else e.role
            while over is not None and not over.held:  # a name alone doesn't hide what holds the article
                over.held = True
                if over is e or not over.article:
                    holders.append(over)
                over = over.up.under
            e.article = True
        page.elements.append(e)
        top = e
        open_[tag] += 1
    while top is not base and top.hidden:
        top = top.up
    if at < len(text) and not _unfinished(last, end):
        pending.append((text[at:].split("<!--", 1)[0], linked))
    flush()
    if not free:
        for e in holders:
            e.named = False
    for e, _, words, links in page.blocks:
        if not e.side:
            e.words += words
            e.links += links
            e.blocks += 1
            e.heads += words if e.tag in _HEAD else 0
    for e in reversed(page.elements):
        if not e.edge:
            up = e.up
            up.words, up.links, up.heads, up.blocks = up.words + e.words, up.links + e.links, up.heads + e.heads, up.blocks + e.blocks
    return page


def _unfinished(m: re.Match | None, end: int) -> bool:
    """Whether the last match ran to where tags end without its own end, so that the rest of the page belongs to it."""
    if m is None or m.end() != end:
        return False
    if m[1]:
        return not m[0].endswith("/>") and not re.search(rf"</{m[1]}\s*>$", m[0], re.I)
    return m[0].startswith("<!--") and not m[0].endswith("-->")


class Token(NamedTuple):
    """A token of a host's pages: an element by its place, or a text block under it (``role`` -1).

    Sums are over the pages that count: how many have it, how often, and for what is below it the words outside and in
    links, words of first headings, and blocks.
    """

    token: int
    parent: int
    vector: object
    pages: int
    times: int
    role: int
    named: bool
    holds: bool
    depth: int
    words: int
    links: int
    heads: int
    blocks: int


_TEXT = -1
#: A token that all pages have.
_ANY = 0
#: So many words of a text need one page more to be taken for a template's.
_WORDS_A_PAGE = 5


def _page_tokens(page: Page) -> dict[int, list]:
    """What ``Token`` tells of each token for one page: parent, times, role, named, holds, depth, words, links, heads, blocks."""
    out: dict[int, list] = {_ANY: [_ANY, 1, 0, False, False, 0, 0, 0, 0, 0]}
    for e in page.elements:
        if not e.up.side:
            own = out.setdefault(e.token, [e.up.token, 0, e.role, e.named, e.tag not in _TEXTUAL and not e.side, e.depth, 0, 0, 0, 0])
            own[1] += 1
            for k, v in enumerate((e.words, e.links, e.heads, e.blocks) if not e.side else (0, 0, 0, 0)):
                own[6 + k] += v
    for e, block, words, links in page.blocks:
        if not e.side:
            own = out.setdefault(_mark(e.token, f"={block}"), [e.token, 0, _TEXT, False, False, e.depth + 1, 0, 0, 0, 0])
            own[1] += 1
            for k, v in enumerate((words, links, words if e.tag in _HEAD else 0, 1)):
                own[6 + k] += v
    return out


class Template(NamedTuple):
    """``root``: the element whose slots hold the article, ``drop``: elements in it whose slots don't, ``static``: texts of the template itself."""

    root: int | None
    drop: frozenset[int]
    static: frozenset[int]


def nest(tokens: list[Token], share: float = 0.75) -> Template:
    """The template of a host from its valid classes.

    Tokens of a class occur on the same pages equally often. Elements of classes that occur once a page nest by
    parent into the template; text tokens are its fixed texts, and what they don't account for is in the slots. From
    the outermost element inwards the root moves to the one element below that holds ``share`` of the words in slots
    outside links, and of the first headings, as long as it holds more than single blocks; half of the words are enough
    for an element that is named as an article. Only where there is no such element, one that is an article or main by its
    tag and holds 0.3 of the words is the root.
    Slots under the root are dropped where most words are links, or where a name says so and they hold less than half.
    Texts that hold most words of the root, 2.5 times those in slots and 40 a page, are an article in near copies and no
    template.
    """
    every = max((t.pages for t in tokens), default=0)
    by = {t.token: t for t in tokens}
    left = {t.token: [t.words, t.heads, t.blocks] for t in tokens}
    for t in tokens:
        if t.role == _TEXT:
            at = t.parent
            while at in left and at != _ANY:
                left[at] = [x - y for x, y in zip(left[at], (t.words, t.heads, t.blocks))]
                at = by[at].parent
    below: dict[int, list[Token]] = defaultdict(list)
    for t in tokens:
        if t.role != _TEXT and t.token != _ANY:
            below[t.parent].append(t)
    once = lambda t: t.times == t.pages and t.holds and left[t.token][0] > 0
    total = sum(left[t.token][0] for t in below[_ANY])
    here, now = _ANY, [total, sum(left[t.token][1] for t in below[_ANY]), 0]
    while True:
        fits = [
            t for t in below[here]
            if once(t) and not t.named and left[t.token][0] >= (0.5 if t.role == _NAMED else share) * now[0] and left[t.token][1] >= share * now[1] and left[t.token][2] >= 1.2 * t.pages
        ]
        if not fits:
            break
        here = max(fits, key=lambda t: (left[t.token][0], t.token)).token
        now = left[here]
    root = here if here != _ANY else None
    if root is None:
        for role in (_ARTICLE, _MAIN, _HELD):
            own = [t for t in tokens if t.role == role and once(t) and left[t.token][0] >= 0.3 * total]
            if own:
                root = min(own, key=lambda t: (t.depth, -left[t.token][0], t.token)).token
                break
    words = left[root][0] if root is not None else total
    fixed = by[root].words - words if root is not None else sum(by[t.token].words for t in below[_ANY]) - total
    if fixed > 2.5 * words and fixed >= 40 * every:
        return nest([t for t in tokens if t.role != _TEXT], share)
    drop, inner = set(), [t for t in below[_ANY if root is None else root]]
    while inner:
        t = inner.pop()
        inner += below[t.token]
        rest = max(0, left[t.token][0])
        if (t.named and 2 * rest < max(words, 1)) or (t.holds and t.links > 0 and t.links >= 1.5 * rest):
            drop.add(t.token)
    return Template(root, frozenset(drop), frozenset(t.token for t in tokens if t.role == _TEXT))


_COLUMNS = [("token", pa.int64()), ("parent", pa.int64()), ("n", pa.int64()), ("role", pa.int32()), ("named", pa.bool_()), ("holds", pa.bool_()), ("depth", pa.int32()), *[(c, pa.int64()) for c in ("words", "links", "heads", "blocks")]]
_FOUND = "array<struct<token: bigint, parent: bigint, n: bigint, role: int, named: boolean, holds: boolean, depth: int, words: bigint, links: bigint, heads: bigint, blocks: bigint>>"


def template_classes(pages: DataFrame, host_col: str = "host", html_col: str = "html", min_support: float = 0.5) -> DataFrame:
    """Each host's tokens of valid equivalence classes: host, the class as ``vector``, and the fields of ``Token``.

    Tokens are elements told apart by the path of their ancestors and their place among their like, and text blocks
    under theirs. Rows of a host whose pages have the same longest block, of the blocks that not all of its pages have, are
    one page (of them the one with the least hash of its html), so copies of a page and near copies, by repeated rows or
    under several addresses, have one vote. Tokens of one host whose occurrence vectors (how often each page has them) are the same form a class; the
    vectors are compared by hashes combined over pages, so a host of any number of pages takes one row per token and
    task. A class is valid if ``min_support`` of the pages have it, at least two. A text block asks for more, the
    longer it is, as an article that several pages have can't be told from a template: three pages and one for every five words, and
    half the root of the host's pages beyond ``min_support``. Elements with a side's name need two pages. A page with a
    token has its parents too, so valid classes nest.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: list[tuple] = []
            ends = [0]
            for text in batch.column(1).to_pylist():
                own += [(t, *v) for t, v in _page_tokens(parse(text or "")).items()]
                ends.append(len(own))
            columns = [pa.array(c, t) for c, (_, t) in zip(zip(*own), _COLUMNS)] if own else [pa.array([], t) for _, t in _COLUMNS]
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, [n for n, _ in _COLUMNS]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), listed], ["host", "page", "found"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, names = [], ["host", "page", "token", "words"]
            for host, text, page in zip(*(batch.column(k).to_pylist() for k in range(3))):
                own += {(host, page, _mark(e.token, f"={block}"), words) for e, block, words, _ in parse(text or "").blocks if not e.side}
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*own) if own else [()] * 4, (pa.string(), pa.int64(), pa.int64(), pa.int64()))], names)

    named = pages.select(F.coalesce(host_col, F.lit("")).alias("host"), F.col(html_col).alias("html"), F.xxhash64(html_col).alias("page"))
    # the pages that count: one of each longest block that its host doesn't have everywhere
    every = named.select("host", "page").distinct()
    size = every.groupBy("host").agg(F.count("*").alias("_all"))
    texts = written(named.mapInArrow(blocks, "host string, page bigint, token bigint, words bigint").distinct(), "texts")
    spread = texts.groupBy("host", "token").agg(F.count_distinct("page").alias("_on")).join(size, "host").filter("_on < _all").select("host", "token")
    longest = texts.join(spread, ["host", "token"]).groupBy("host", "page").agg(F.max(F.struct("words", "token"))["token"].alias("_longest"))
    voting = every.join(longest, ["host", "page"], "left").groupBy("host", "_longest").agg(F.min("page").alias("page")).select("host", "page")
    found = named.mapInArrow(count, f"host string, page bigint, found {_FOUND}")
    found = found.groupBy("host", "page").agg(F.first("found").alias("found")).join(voting, ["host", "page"]).select("host", "page", F.inline("found"))
    sums = [F.sum(c).alias(c) for c in ("words", "links", "heads", "blocks")]
    tokens = found.groupBy("host", "token").agg(
        F.bit_xor(F.xxhash64("page", "n")).alias("vector"), F.count("*").alias("pages"), F.sum("n").alias("times"),
        *[F.min(c).alias(c) for c in ("parent", "role", "depth")], F.max("named").alias("named"), F.max("holds").alias("holds"), *sums,
    )
    tokens = written(tokens.filter(f"pages > 1 or token = {_ANY}"), "tokens")
    size = tokens.filter(F.col("token") == _ANY).select(F.col("host").alias("_host"), F.col("pages").alias("host_pages"))
    joined = tokens.filter(F.col("token") != _ANY).join(size, F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    text, share = F.col("role") == _TEXT, min_support * F.col("host_pages")
    least = F.when(text, 3 + (F.col("words") + F.col("links")) / F.col("times") / _WORDS_A_PAGE).otherwise(2)
    share = F.when(text, F.least(F.col("host_pages"), share + F.sqrt("host_pages") / 2)).otherwise(share)
    return joined.filter(((F.col("pages") >= least) & (F.col("pages") >= share)) | F.col("named")).select("host", *Token._fields)


def host_templates(classes: DataFrame) -> DataFrame:
    """(host, root, drop, static) of each host, by ``nest``. A host's valid classes are at most about twice a page's tokens."""
    schema = pa.schema([("host", pa.string()), ("root", pa.int64()), ("drop", pa.list_(pa.int64())), ("static", pa.list_(pa.int64()))])

    def build(rows: pa.Table) -> pa.Table:
        t = nest([Token(*r) for r in zip(*(rows[c].to_pylist() for c in Token._fields))])
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip((rows["host"][0].as_py(), t.root, sorted(t.drop), sorted(t.static)), schema)], schema=schema)

    return classes.groupBy("host").applyInArrow(build, "host string, root bigint, drop array<bigint>, static array<bigint>")


def _alone(page: Page) -> int | None:
    """The root of a page without a template: by role, else as ``nest`` finds it in the page's own tokens."""
    own = [e for e in page.elements if e.role and e.role != _BODY]
    if own:
        return min(own, key=lambda e: (e.role, e.depth)).token
    tokens = [Token(t, v[0], v[1], 1, *v[1:]) for t, v in _page_tokens(page).items() if v[2] != _TEXT]
    return nest(tokens).root


def _extract(text: str | None, root: int | None, static: frozenset[int], drop: frozenset[int] | None = None) -> str:
    """The text in the slots under ``root``. Without a template (``drop`` is None), or on a page that hasn't its root, names decide what is dropped."""
    page = parse(text or "")
    fits = root is not None and any(e.token == root for e in page.elements)
    if not fits:
        root, drop = _alone(page), None if root is not None else drop
    inside: dict[int, tuple[bool, bool]] = {0: (root is None, False)}  # by element: in the root, dropped
    for e in page.elements:
        within, gone = inside[id(e.up)] if e.up.up is not None else inside[0]
        soft = e.named and e.tag not in _TEXTUAL if drop is None else e.token in drop
        inside[id(e)] = (within or e.token == root, gone or soft) if within else (e.token == root, False)
    kept, dropped = [], []
    for e, block, _, _ in page.blocks:
        within, gone = inside[id(e)] if e.up is not None else inside[0]
        if not within or e.side or (static and _mark(e.token, f"={block}") in static):
            continue
        dropped.append(block)
        if not gone:
            kept.append(block)
    return "\n".join(kept or (dropped if drop is None else []))  # names alone never leave a page without text


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_mb: int = 64, host_rows: int = 20_000) -> DataFrame:
    """One row per row of ``pages``: id, url, ``text`` and ``n_chars``.

    Each host's template is deduced from its pages' tokens (``template_classes``) and nested (``host_templates``). The
    slots of the element that holds the article give the text: without the template's fixed texts, without slots of
    links, and without elements of HTML that never belong to it (navigation, footers, asides, forms, headers outside
    an article). A whole class name, id or role that says menu, comments, notice or the like decides only where
    classes can't: on elements that two pages of the host have, and on pages without a template, never on all text
    of such a page. Blocks are trimmed, white space in them is one space, and one line feed joins them. Templates
    hold a few numbers per element of a host: they are broadcast while under ``broadcast_mb``; beyond, pages are
    joined with them by host, those of a host with more than ``host_rows`` pages in as many parts as needed.

    Null html is an empty page, a null url has the host ''. A page that is alone on its host, or unlike its host's
    template, is taken by its own elements. Long pages are read in time that grows with their length. Ids and urls are
    passed on; rows may repeat. Other columns are ignored, an empty table gives no rows.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"), host.alias("_host"))
    classes = template_classes(rows.select(F.col("_host").alias("host"), F.col("_html").alias("html")))
    templates = written(host_templates(classes).withColumnRenamed("host", "_host"), "templates")
    numbers = templates.agg(F.sum(F.size("static") + F.size("drop") + 20)).first()[0] or 0
    if 8 * numbers <= broadcast_mb << 20:
        joined = rows.join(F.broadcast(templates), "_host", "left")
    else:
        # at most a row for each ``host_rows`` pages
        large = written(rows.groupBy("_host").count().filter(F.col("count") > host_rows).select("_host", F.ceil(F.col("count") / host_rows).cast("int").alias("_parts")), "hosts")
        part = lambda df: df.join(F.broadcast(large), "_host", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
        spread = part(rows).withColumn("_part", F.pmod(F.xxhash64("_url", "_html"), F.col("_parts")).cast("int")).drop("_parts")
        joined = spread.join(part(templates).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts"), ["_host", "_part"], "left")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple] = {}
        for batch in batches:
            texts = []
            for k, (text, at) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if at not in seen:
                    if len(seen) > 1000:
                        seen.clear()
                    root, drop, static = (batch.column(c)[k].as_py() for c in (4, 5, 6))
                    seen[at] = root, frozenset(static or ()), None if drop is None else frozenset(drop)
                texts.append(_extract(text, *seen[at]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], [id_col, url_col, "text"])

    schema = f"`{id_col}` {pages.schema[id_col].dataType.simpleString()}, `{url_col}` {pages.schema[url_col].dataType.simpleString()}, text string"
    out = joined.select("_id", "_url", "_html", "_host", "root", "drop", "static").mapInArrow(extract, schema)
    return out.select(id_col, url_col, "text", F.length("text").cast("bigint").alias("n_chars"))
