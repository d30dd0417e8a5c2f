"""Main text of web pages by host consensus on container paths.

Pass 1 reads each page's containers: a container's path is its tags from the body on with their classes, generalised
(digits to #, several classes in order), and its score follows its own prose: long blocks, commas, few links, telling
tag and class names, half of it passed to the parent. Each page votes for its best containers with scores relative to
its top one. Spark sums the votes per (host, path), pre-aggregated. A path whose prose is the same on most pages of its
host is furniture, whatever its name, and is no winner; every other path that STAPLE of the host's pages vote for is,
so a host may have any number of templates, and a winner's row count is bounded by VOTES / STAPLE.

Pass 2 reads each page again and takes the first of its host's winning paths that the page has; a page without any
(or without a host, or of a rarer template) falls back on its own best container. Unless that is an article or main
element, siblings with a quarter of its votes belong to it: an article in two boxes stays whole.

What is left out is judged by structure first. Elements whose tag or role says so (nav, aside, footer, form, ...) go;
of the rest only boxes (never paragraphs, headings, quotes or inline elements) can be furniture by name, and only if
every part of one of their class names or their id says so: `cookie-notice` does, `ad-hoc`, `related-work` and
`has-sidebar` don't. Names that an article may use for its own parts (`legal`, `search`, `header`) count outside of
article and main elements only. A box that holds an article or main element, or most of the page's prose, is never
furniture.

The winners, one row per host, are broadcast if their checked size allows it; otherwise both sides are joined by host,
and the adaptive join splits a host of many pages.

Text: character references decoded, white space inside a block one space, trimmed, blocks in page order joined by one
newline; nothing else is dropped or capped. Unclosed tags, stray end tags and a cut-off last tag are read as browsers
do, near enough: a block starts a new block, an end tag closes what it can.

Defined cases: null or empty html gives empty text; null url has no host; ties of votes go to the smaller path; repeated
rows and null page_ids keep their rows; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pick, slices

#: Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noframes xmp svg select canvas audio video".split())
CONTAINERS = frozenset("html body main article section div td center header footer nav aside form figure table ul ol dl dialog details fieldset blockquote".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre tr th tbody thead tfoot caption figcaption hr address summary legend option menu".split())
#: Elements that are never main text.
BOILER_TAGS = frozenset("nav footer aside form dialog menu button head".split())
#: Class and id names of furniture: anywhere; outside of article and main elements only; words that say nothing either way.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar masthead footer cookie cookies consent gdpr popup modal comment comments commentlist disqus "
    "respond share sharing social related recommended newsletter subscribe pagination pager widget widgets notice".split()
)
OUTSIDE = frozenset("header foot side aside banner overlay replies reviews signup login search toolbar copyright legal skip".split())
NEUTRAL = frozenset("area bar block bottom box btn button buttons column container form group inner item items left link links list main outer panel right row section site slot text top unit wrap wrapper".split())
PART = re.compile(r"[-_]+")
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
GOOD_NAMES = re.compile(r"(^|[-_ ])(article|body|content|entry|main|page|post|story|text)([-_ ]|$)", re.I)

TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|$)|<([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)(>|$)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
SPACE = re.compile(r"\s+")
#: Paths a page votes for; the share of a host's pages that makes a path a winner; of a winner's votes that make a sibling part of it.
VOTES, STAPLE, SIBLING = 6, 0.01, 0.25
#: A path's prose is furniture if it has at most this share of different texts over this many pages or more.
SAME_SHARE, SAME_PAGES = 0.2, 5
#: Hosts' winners are broadcast up to this many bytes of paths.
BROADCAST_BYTES = 16 << 20


@dataclass
class Container:
    path: str
    parent: int
    tag: str
    names: str
    score: float = 0.0
    prose: int = 0
    linked: int = 0
    furniture: bool = False
    holds_article: bool = False


@dataclass
class Page:
    containers: list[Container] = field(default_factory=list)
    blocks: list[tuple[str, int, int]] = field(default_factory=list)  # text, container, characters inside links


def _attributes(source: str) -> dict[str, str]:
    return {k.lower(): unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(source)} if source.strip(" /") else {}


def general(names: str) -> str:
    """Classes in order, digits as #."""
    return ".".join(sorted({re.sub(r"\d+", "#", n.lower()) for n in names.split()}))


def named_furniture(names: str, inside: bool) -> bool:
    """Does a class or id consist of names of furniture only? inside: of an article or main element."""
    for name in names.lower().split():
        parts = [re.sub(r"\d+$", "", p) for p in PART.split(name)]
        told = {p for p in parts if p in FURNITURE or not inside and p in OUTSIDE}
        if told and all(p in told or p in NEUTRAL or not p for p in parts):
            return True
    return False


def read(html: str) -> Page:
    """Containers and text blocks outside boilerplate, in page order."""
    page = Page([Container("", -1, "", "")])
    # Open elements: tag, container before it, whether it starts boilerplate, whether it is a link.
    stack: list[tuple[str, int, bool, bool]] = []
    here, hidden, links = 0, 0, 0
    text: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if text:
            joined = SPACE.sub(" ", "".join(text)).strip()
            if joined:
                page.blocks.append((joined, here, linked))
            text.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal here, hidden, links
        while len(stack) > depth:
            tag, before, starts, link = stack.pop()
            if tag in BLOCKS:
                flush()
            here = before
            hidden -= starts
            links -= link

    def say(piece: str) -> None:
        nonlocal linked
        if piece and not hidden:
            piece = unescape(piece)
            text.append(piece)
            if links:
                linked += len(piece)

    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            say(html[at:])
            break
        say(html[at:lt])
        m = TOKEN.match(html, lt)
        if not m:
            say("<")
            at = lt + 1
            continue
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag in BLOCKS and not any(e[0] == tag for e in stack):
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if tag not in BLOCKS and stack[i][0] in CONTAINERS:  # a stray inline end tag stays inside its container
                    break
            continue
        if not m[2]:
            continue
        if not m[4]:
            break  # the page ends inside a tag
        tag = m[2].lower()
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*[^>]*(?:>|$)", re.I).search(html, at)
            if not m[3].rstrip().endswith("/") or tag not in ("svg", "math"):
                at = end.end() if end else n
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in BLOCKS:
            for i in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph, an item the item before it
                if stack[i][0] == "p" or stack[i][0] == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                    close(i)
                    break
                if stack[i][0] in CONTAINERS:
                    break
            flush()
        if tag in VOID or m[3].rstrip().endswith("/") and tag not in BLOCKS:
            continue
        starts = False
        before = here
        if tag in CONTAINERS or tag in BOILER_TAGS or m[3]:
            a = _attributes(m[3])
            names = f"{a.get('class', '')} {a.get('id', '')}"
            inside = any(e[0] in ("article", "main") for e in stack)
            told = tag in BOILER_TAGS or (tag == "header" and not inside) or a.get("role", "").lower() in ROLES
            starts = "hidden" in a or a.get("aria-hidden") == "true" or told and tag not in CONTAINERS
            if tag in CONTAINERS and tag not in ("html", "body"):
                label = tag + "".join(f".{x}" for x in [general(a.get("class", ""))] if x)
                parent = page.containers[here]
                furniture = told or tag not in ("article", "main", "header", "blockquote", "figure") and named_furniture(names, inside)
                page.containers.append(Container(f"{parent.path}>{label}" if parent.path else label, here, tag, names, furniture=furniture))
                here = len(page.containers) - 1
                if tag in ("article", "main") and not hidden:
                    up = here
                    while up > 0:
                        page.containers[up].holds_article, up = True, page.containers[up].parent
        link = tag == "a"
        stack.append((tag, before, starts, link))
        hidden += starts
        links += link
    close(0)
    flush()
    return without_furniture(page)


def without_furniture(page: Page) -> Page:
    """The page without the blocks of furniture; what holds an article or most of the prose is none."""
    if not any(c.furniture for c in page.containers):
        return page
    prose, total = [0] * len(page.containers), 0
    for text, at, linked in page.blocks:
        free = max(0, len(text) - linked)
        total += free
        while at >= 0:
            prose[at] += free
            at = page.containers[at].parent
    wraps = lambda i, c: c.holds_article and c.tag not in ("nav", "footer", "aside") or c.tag not in BOILER_TAGS - {"form"} and 2 * prose[i] > total
    gone = [False]
    for i, c in enumerate(page.containers[1:], 1):
        gone.append(gone[c.parent] or c.furniture and not wraps(i, c))
    page.blocks = [b for b in page.blocks if not gone[b[1]]]
    return page


def score(page: Page) -> None:
    for text, at, linked in page.blocks:
        free = max(0, len(text) - linked)
        points = free / 100 + text.count(",") * 0.2 + (1 if free >= 25 else 0)
        share = 1.0
        while at > 0 and share > 0.1:
            c = page.containers[at]
            c.score += points * share
            c.prose += free
            c.linked += linked
            at, share = c.parent, share / 2
    for c in page.containers:
        c.score *= 1 - c.linked / max(1, c.linked + c.prose)
        if c.prose:
            c.score *= {"article": 4.0, "main": 3.0}.get(c.tag, 1.0) * (1.5 if GOOD_NAMES.search(c.names) else 1.0)


def best(page: Page, most: int = VOTES) -> list[tuple[str, float]]:
    """The page's best paths with scores relative to the top one; containers of one path count together."""
    score(page)
    total: dict[str, float] = {}
    for c in page.containers[1:]:
        if c.score > 0:
            total[c.path] = total.get(c.path, 0) + c.score
    ranked = sorted(total.items(), key=lambda x: (-x[1], x[0]))[:most]
    return [(p, s / ranked[0][1]) for p, s in ranked]


def within(page: Page, paths: set[str]) -> list[bool]:
    """Per container: is it, or is it in, one on these paths?"""
    inside = [False]
    for c in page.containers[1:]:
        inside.append(c.path in paths or inside[c.parent])
    return inside


def extract(page: Page, ranked: list[tuple[str, float]]) -> str:
    """Blocks of the containers on the first path (of path, votes; best first) that the page has, and of its siblings on
    paths with SIBLING of its votes; without one, of the page's own best container, else all."""
    known = {c.path for c in page.containers if c.path}
    if not any(p in known for p, _ in ranked):
        ranked = best(page)
    top, vote = next(((p, v) for p, v in ranked if p in known), ("", 0.0))
    if not top:
        return "\n".join(t for t, _, _ in page.blocks)
    over, _, own = top.rpartition(">")
    chosen = {top}
    if own.split(".")[0] not in ("article", "main"):
        chosen |= {p for p, v in ranked if p.rpartition(">")[0] == over and v >= SIBLING * vote}
    inside = within(page, chosen)
    return "\n".join(t for t, at, _ in page.blocks if inside[at])


HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"


def votes(pages: DataFrame, most: int = VOTES) -> DataFrame:
    """host, path, vote and a hash of the path's prose, of every page with a host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in slices(batches, column="html"):
            rows = []
            for h, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                page = read(source or "")
                for p, s in best(page, most):
                    inside = within(page, {p})
                    rows.append((h, p, s, xxhash.xxh64_intdigest("\n".join(t for t, at, _ in page.blocks if inside[at]).encode()) >> 1))
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64(), pa.int64()))], names=["host", "path", "vote", "prose"])

    return pages.where("host is not null").select("host", "html").mapInArrow(run, "host string, path string, vote double, prose long")


def winners(pages: DataFrame) -> DataFrame:
    """host, ranked: (path, votes) of every winning path, best first (ties: path)."""
    summed = votes(pages).groupBy("host", "path").agg(F.round(F.sum("vote"), 6).alias("vote"), F.count("*").alias("n"), F.approx_count_distinct("prose").alias("texts"))
    fresh = summed.where(~((F.col("n") >= SAME_PAGES) & (F.col("texts") <= SAME_SHARE * F.col("n"))))
    per_host = pages.where("host is not null").groupBy("host").agg(F.count("*").alias("pages"))
    top = fresh.join(per_host, "host").where(F.col("n") >= STAPLE * F.col("pages"))  # at most VOTES / STAPLE rows a host
    ranked = top.groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("vote")).alias("last"), "path", "vote"))).alias("ranked"))
    return ranked.select("host", F.transform("ranked", lambda x: F.struct(x["path"].alias("path"), x["vote"].alias("vote"))).alias("ranked"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    own = pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("long"), "url", "html", F.lower(F.nullif(F.regexp_extract("url", HOST, 1), F.lit(""))).alias("host"))
    won = cut(winners(own))
    size = won.agg(F.sum(F.length("host") + F.aggregate("ranked", F.lit(0), lambda a, x: a + F.length(x["path"]) + 24))).first()[0] or 0
    joined = own.join(F.broadcast(won) if size <= BROADCAST_BYTES else won, "host", "left").select("page_id", "url", "html", "ranked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, column="html"):
            texts = [extract(read(h or ""), [(x["path"], x["vote"]) for x in p or []]) for h, p in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
