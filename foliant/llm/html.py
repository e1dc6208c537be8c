"""Main text of web pages by consensus paths of their hosts."""

from __future__ import annotations

import bisect
import heapq
import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import pick, stash

# Elements by how they are read.
RAW = {"script", "style", "textarea", "title", "noscript", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr",
    "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th",
    "thead", "tr", "ul",
}
CLOSES_P = BLOCK - {"body", "html", "dd", "dt", "li", "td", "th", "tr", "tbody", "thead", "tfoot"}
HOLDERS = {
    "div", "section", "article", "main", "blockquote", "td", "th", "li", "header", "footer", "aside", "nav", "form",
    "table", "ul", "ol", "dl", "html", "body",
}
#: Start tag: the open elements that it ends, and those that it never reaches past.
IMPLIED = {
    "li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")),
    "tbody": (("thead", "tbody", "tfoot", "tr"), ("table",)), "tfoot": (("thead", "tbody", "tfoot", "tr"), ("table",)),
}
#: Never text of an article.
DROPPED = {
    "script", "style", "noscript", "template", "button", "select", "iframe", "svg", "title", "textarea", "object", "canvas",
    "noembed", "noframes", "xmp", "input", "option", "optgroup", "datalist", "audio", "video", "applet", "progress", "meter",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PROSE = {"p", "pre", "blockquote", "li", "td", "th", "dd", "dt", "figcaption", *HEADINGS}
SIDE_TAGS = {"nav", "footer", "aside", "menu"}
WRAP_TAGS = {"form", "dialog"}
SIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "toolbar", "tablist"}
WRAP_ROLES = {"dialog", "alertdialog", "alert", "form"}
TALK = {"comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "responses"}
NOISE = TALK | {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo",
    "promotion", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "cookie", "cookies",
    "consent", "notice", "banner", "popup", "modal", "newsletter", "subscribe", "subscription", "share", "sharing", "social",
    "related", "recommended", "widget", "pagination", "pager", "login", "signup", "masthead", "toolbar", "hidden", "tags",
    "gdpr", "alert", "paywall",
}
#: Words that leave a noise word's meaning as it is: "site-footer" is a footer, "footer-report" may be anything.
NEUTRAL = {
    "site", "page", "main", "top", "bottom", "left", "right", "box", "list", "block", "section", "area", "wrap", "wrapper",
    "container", "inner", "outer", "bar", "item", "items", "slot", "unit", "link", "links", "buttons", "button", "icons",
    "icon", "form", "panel", "region", "global", "primary", "secondary", "header", "post", "posts", "article", "articles",
    "content", "text", "body", "card", "col", "column", "group", "area", "user", "reader", "google", "media", "thread", "js",
}
ARTICLE_WORDS = {"article", "post", "entry", "story"}

H1, MAIN, ARTICLE, HEADING = 1, 2, 4, 8
#: Text beside an element that is so many times shorter says nothing against the element.
OUTWEIGHS = 10
#: Characters of text that no mere notice has.
SUBSTANTIAL = 200
#: What an article or main element counts more than a plain one.
BONUS = 1.5
#: Votes of a host's further winning paths against its first one's.
ALSO = 0.1
#: And it wins only with votes of this share of the host's pages, so a page's own names win nowhere.
OF_PAGES = 0.05
#: Winning paths that hold less of a page than its own best container by this share follow another template.
ENOUGH = 0.8

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/><]*+)"
    r"((?:[^>\"'=<]++|=\s*+(?:\"[^\"]*+\"(?=[\s/>]|\Z)|'[^']*+'(?=[\s/>]|\Z))?+|[\"'])*+)(?:>|(?=<)|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/<>]++)(?:\s*+=\s*+(\"[^\"]*+\"?+|'[^']*+'?+|[^\s\"'>]*+))?+|[\"'/=]")
_NAMED = re.compile(r"class|id|role|hidden|style|itemprop|href", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NUMBER = re.compile(r"\d+")
_UNSEEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*>?", re.I | re.A) for t in RAW}


class Node:
    """An element. ``start`` and ``end`` are its places in the page's events.

    plain and linked count its characters outside and inside of links, without its noise;
    flags tell what it holds; ``reach`` and ``reach_flags`` also count wrappers inside.
    """

    __slots__ = (
        "tag", "parent", "key", "kind", "mark", "link", "start", "end", "plain", "linked", "flags", "reach", "reach_flags",
        "noise", "value", "best_child",
    )

    def __init__(self, tag: str, parent: Node | None, key: str, kind: str, mark: int, start: int):
        self.tag, self.parent, self.key, self.kind, self.mark, self.start = tag, parent, key, kind, mark, start
        self.link, self.end, self.plain, self.linked, self.flags = False, start, 0, 0, 0
        self.reach, self.reach_flags, self.noise = 0, 0, []
        self.value, self.best_child = 0.0, 0.0


def _noise_of(names: list[str]) -> str:
    """What class names and ids say: "talk" and "wrap" (an advert, a notice, ...) by names that say nothing else, else "weak"."""
    found = ""
    for name in names:
        words = [w.lower() for w in _WORDS.findall(name)]
        if any(w in NOISE for w in words):
            if not all(w in NOISE or w in NEUTRAL for w in words):
                found = found or "weak"
            elif any(w in TALK for w in words):
                return "talk"
            else:
                found = "wrap"
    return found


@lru_cache(maxsize=8192)
def _described(tag: str, attributes: str) -> tuple[str, str, int, bool]:
    """(step of the path, kind, mark, whether it links): a step is the tag with its classes, numbers in them made equal."""
    step, names, found = tag, [], {}
    if attributes and _NAMED.search(attributes):
        for name, value in _ATTRIBUTE.findall(attributes):
            found.setdefault(name.lower(), value.strip("\"'"))
    if found.get("class"):
        names += found["class"].split()
        step = ".".join([tag, *sorted({_NUMBER.sub("0", n.lower()) for n in names})])
    if found.get("id"):
        names += found["id"].split()
    role = found.get("role", "").lower()
    mark = {"h1": H1 | HEADING, "article": ARTICLE, "main": MAIN}.get(tag, HEADING if tag in HEADINGS else 0)
    if role == "main" or found.get("itemprop", "").lower() == "articlebody":
        mark |= MAIN
    kind = ""
    if tag in DROPPED:
        kind = "dropped"
    elif tag not in ("html", "body", "main") and not mark & MAIN:
        kind = _noise_of(names)
        if kind != "talk":
            header = tag == "header" or any(_WORDS.findall(n)[-1:] == ["header"] for n in names)
            if tag in SIDE_TAGS or role in SIDE_ROLES:
                kind = "side"
            elif header and kind in ("", "weak"):
                own = any(w.lower() in ARTICLE_WORDS for n in names for w in _WORDS.findall(n))
                kind = "own header" if own else "header"
            elif tag in WRAP_TAGS or role in WRAP_ROLES or _UNSEEN.search(found.get("style", "")):
                kind = "wrap"
            elif "hidden" in found or found.get("aria-hidden", "").lower() == "true":
                kind = "wrap"
    return step, kind, mark, tag == "a" and "href" in found


def parse(html: str) -> tuple[Node, list]:
    """(root, events) of a page: a node where it opens, None where one closes, and text between.

    Any text is a page: tags that nothing closes end with what holds them, a quote that nothing
    closes ends with its tag, and end tags without a start are left out. Time is linear in the
    length, whatever the nesting: for each tag the places where it is open are kept.
    """
    root = Node("", None, "", "", 0, 0)
    events: list = [root]
    stack = [root]
    where: dict[str, list[int]] = {}
    blocks, holders = [0], [0]
    unseen = 0  # open elements that are dropped
    no_end: set[str] = set()
    at, n = 0, len(html)

    def last(tags: tuple[str, ...]) -> int:
        return max((where[t][-1] for t in tags if where.get(t)), default=0)

    def pop_to(depth: int, closed: bool = False) -> None:
        """Close all elements from ``depth`` of the stack on."""
        nonlocal unseen
        while len(stack) > depth:
            node = stack.pop()
            where[node.tag].pop()
            if blocks[-1] == len(stack):
                blocks.pop()
            if holders[-1] == len(stack):
                holders.pop()
            if node.kind == "dropped":
                unseen -= 1
            elif not unseen:
                node.link = node.link and closed and len(stack) == depth
                node.end = len(events)
                events.append(None)

    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            if not unseen:
                events.append(html[at:])
            break
        if m.start() > at and not unseen:
            events.append(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if where.get(tag) and (tag in BLOCK or where[tag][-1] > blocks[-1]):
                pop_to(where[tag][-1], closed=True)
            elif tag in ("p", "br") and not unseen:
                events.append(" ")
            continue
        if tag == "br":
            if not unseen:
                events.append(" ")
            continue
        if tag in ("html", "body", "head") and (tag == "head" or where.get(tag)):
            continue
        if tag in CLOSES_P and where.get("p") and where["p"][-1] > holders[-1]:
            pop_to(where["p"][-1])
        if tag in IMPLIED:
            ends, bounds = IMPLIED[tag]
            bound = last(bounds)
            opened = [where[t][-1] for t in ends if where.get(t) and where[t][-1] > bound]
            if opened and (bounds != ("ul", "ol") and bounds != ("dl",) or holders[-1] <= max(opened)):
                pop_to(min(opened) if bounds == ("table",) else max(opened))
        elif tag == "a" and where.get("a") and where["a"][-1] > blocks[-1]:
            pop_to(where["a"][-1])
        elif tag in RAW:
            end = None if tag in no_end else _RAW_END[tag].search(html, at)
            if end:
                at = end.end()
            else:
                no_end.add(tag)
                if tag in ("script", "style"):
                    break
            continue
        if tag in VOID:
            if tag == "hr" and not unseen:
                events += [Node("hr", stack[-1], "", "", 0, len(events)), None]
            continue
        attributes = m[3]
        long = len(attributes) > 2000
        step, kind, mark, link = (_described.__wrapped__ if long else _described)(tag, attributes)
        if kind == "header" and (where.get("article") or where.get("main")):
            kind = "own header"
        parent = stack[-1]
        key = xxhash.xxh3_128_hexdigest(f"{parent.key}>{step}")
        node = Node(tag, parent, key, kind, mark, len(events))
        node.link = link
        if attributes.endswith("/") and tag not in BLOCK and tag != "a":
            continue
        where.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            blocks.append(len(stack))
        if tag in HOLDERS:
            holders.append(len(stack))
        stack.append(node)
        if kind == "dropped":
            unseen += 1
        elif not unseen:
            events.append(node)
    pop_to(1)
    root.end = len(events)
    events.append(None)
    return root, events


def _count(events: list) -> None:
    """Characters, flags and noise of every node; a weak node is noise if most of its text is links."""
    node, links = None, 0
    for event in events:
        if event is None:
            links -= node.link
            up = node.parent
            if node.plain + node.linked:
                node.flags |= node.mark
            if node.kind == "weak":
                node.kind = "cut" if node.linked > node.plain else ""
            if up is None:
                return
            if node.kind in ("wrap", "side", "talk", "header"):
                node.reach, node.reach_flags = node.plain, node.flags
                for inner in node.noise:
                    if inner.kind == "wrap":
                        node.reach = max(node.reach, inner.reach)
                        node.reach_flags |= inner.reach_flags
                up.noise.append(node)
            elif node.kind != "cut":
                up.plain += node.plain
                up.linked += node.linked
                up.flags |= node.flags
                if node.noise:
                    if len(up.noise) < len(node.noise):
                        up.noise, node.noise = node.noise, up.noise
                    up.noise += node.noise
            node = up
        elif type(event) is str:
            k = len(event.strip())
            if links:
                node.linked += k
            else:
                node.plain += k
        else:
            node = event
            links += node.link


def _opens(node: Node, outside: int, flags: int) -> bool:
    """Whether an element with a noise mark holds the article itself, from what the page has outside such elements."""
    has, much = node.reach_flags, node.reach >= OUTWEIGHS * outside
    holds_main = bool(has & MAIN or has & H1 and not flags & (H1 | MAIN | ARTICLE)) and node.reach >= outside
    if node.kind == "talk":
        return holds_main
    if node.kind in ("side", "header"):
        return holds_main and much and node.reach >= SUBSTANTIAL
    if node.tag == "form" and much and not flags & (H1 | MAIN | ARTICLE) and node.reach:
        return bool(has & (H1 | MAIN | ARTICLE | HEADING)) or node.reach >= SUBSTANTIAL / 4
    return holds_main or much and (bool(has & (MAIN | ARTICLE | H1)) or node.reach >= SUBSTANTIAL)


def _cut_noise(root: Node, events: list) -> None:
    """Mark as cut what is noise: the largest marked element first, each against the text left outside all others."""
    _count(events)
    outside, flags = root.plain, root.flags
    heap = [(-x.reach, k, x) for k, x in enumerate(root.noise)]
    heapq.heapify(heap)
    number = len(heap)
    while heap:
        _, _, node = heapq.heappop(heap)
        if not _opens(node, outside, flags):
            node.kind = "cut"
            continue
        node.kind = ""
        outside += node.plain
        flags |= node.flags
        for inner in node.noise:
            number += 1
            heapq.heappush(heap, (-inner.reach, number, inner))


class Page:
    """A page's blocks in order, without noise, and the containers that hold them.

    A block is worth its characters less twice those of links; a short one that is neither
    prose nor a sentence is worth nothing. A container is worth its blocks, and counts if it
    is worth more than any container inside; article and main elements have a bonus.
    """

    def __init__(self, html: str):
        self.root, self.events = parse(html)
        _cut_noise(self.root, self.events)
        self.blocks: list[tuple[int, str, float, bool]] = []  # place, text, worth, whether a first heading
        self.containers: list[tuple[float, Node]] = []
        self.marked: list[Node] = []  # main and article elements
        self._read()

    def _read(self) -> None:
        events, parts = self.events, []
        block, node, links, linked = self.root, None, 0, 0
        filtered, heard = 0, 0  # depth in an article's header, and in headings and paragraphs there
        at, n = 0, len(events)
        held: list[Node] = []

        def flush() -> None:
            nonlocal linked
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                worth = len(text) - 2.0 * min(linked, len(text))
                if worth > 0 and len(text) < 25 and block.tag not in PROSE and text[-1] not in ".!?…。！？":
                    worth = 0.0
                block.value += worth
                self.blocks.append((at, text, worth, block.tag == "h1"))
            linked = 0

        while at < n:
            event = events[at]
            if event is None:
                if node.tag in BLOCK or node is self.root:
                    flush()
                    if held:
                        block = held.pop()
                links -= node.link
                filtered -= node.kind == "own header"
                heard -= bool(filtered) and (node.tag in HEADINGS or node.tag == "p")
                up = node.parent
                leaf = node.tag in PROSE and node.tag not in ("td", "th", "li", "blockquote")
                counted = node.value * (BONUS if node.mark & (MAIN | ARTICLE) else 1.0)
                if counted > node.best_child and not leaf:
                    self.containers.append((counted, node))
                    node.best_child = counted
                if node.mark & (MAIN | ARTICLE):
                    self.marked.append(node)
                if up is not None:
                    up.value += node.value
                    up.best_child = max(up.best_child, node.best_child)
                node = up
            elif type(event) is str:
                if not filtered or heard:
                    text = entities.unescape(event) if "&" in event else event
                    parts.append(text)
                    if links:
                        linked += len(text.strip())
            elif event.kind == "cut":
                if event.tag in BLOCK:
                    flush()
                at = event.end
            else:
                if event.tag in BLOCK:
                    flush()
                    held.append(block)
                    block = event
                node = event
                heard += bool(filtered) and (node.tag in HEADINGS or node.tag == "p")
                filtered += node.kind == "own header"
                links += node.link
            at += 1

    def votes(self) -> list[tuple[str, float]]:
        """(path, its containers' worth against that of the best one)."""
        top = max((v for v, _ in self.containers), default=0.0)
        return [(x.key, v / top) for v, x in self.containers if v > 0]

    def text(self, winners: list[str] | None = None) -> str:
        own = max(self.containers, key=lambda c: c[0], default=(0.0, None))[1]
        none = own is None or own.value <= 0
        if none and not self.marked:
            return "\n".join(text for _, text, worth, _ in self.blocks if worth >= 0)
        chosen, ends = [], []  # disjoint, in page order
        if winners and not none:
            by_key: dict[str, list[Node]] = {}
            for v, x in self.containers:
                if v > 0:
                    by_key.setdefault(x.key, []).append(x)
            for key in dict.fromkeys(winners):
                for x in sorted(by_key.get(key, ()), key=lambda x: x.start):
                    k = bisect.bisect_left(ends, x.start)  # the first that does not end before x
                    if k == len(ends) or chosen[k].start > x.end:
                        chosen.insert(k, x)
                        ends.insert(k, x.end)
        if none:
            chosen = self.marked  # a main part of links alone is kept whole
        elif sum(x.value for x in chosen) < ENOUGH * own.value:
            chosen = [own]
        inside: list[tuple[int, int]] = []
        for x in sorted(chosen, key=lambda x: (x.start, -x.end)):
            if not inside or x.start > inside[-1][1]:  # not inside of the one before
                inside.append((x.start, x.end))
        got, first, k = [], [], 0
        for at, text, _, heading in self.blocks:
            while k < len(inside) and inside[k][1] < at:
                k += 1
            if k < len(inside) and inside[k][0] <= at:
                got.append((text, heading))
            elif heading and not got:
                first.append(text)
        if len(first) == 1 and not any(heading for _, heading in got):
            got.insert(0, (first[0], True))  # the title above its article
        return "\n".join(text for text, _ in got)


def page_votes(html: str) -> list[tuple[str, float]]:
    """(path, share of the best container's worth) of all containers of a page."""
    return Page(html).votes()


def page_text(html: str, winners: list[str] | None = None) -> str:
    """Main text by the host's winning paths, else by the page's own best container.

    The containers of the winning paths are taken in the order of votes, each unless it holds
    or lies in one taken before. A page on which they hold less than ``ENOUGH`` of what its own
    best container holds follows another template, and its own container counts. A page
    without a container of worth gives all blocks of its main and article elements, without
    these all its blocks that are not links.
    """
    return Page(html).text(winners)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


#: The path that has a vote of every page.
EACH = ""


def winning_paths(votes: DataFrame) -> DataFrame:
    """(host, winners) of summed votes (host, path, votes): the leading path first, and those with ``ALSO`` of its votes.

    A path needs ``OF_PAGES`` of the host's pages in votes. A page's votes are at most as many as
    its containers, so the winners of a host are bounded by the containers of a page.
    """
    paths = votes.where(F.col("path") != EACH)
    most = paths.groupBy("host").agg(F.max("votes").alias("most"))
    n = votes.where(F.col("path") == EACH).select("host", F.col("votes").alias("pages"))
    ranked = paths.join(most, "host").join(n, "host").where((F.col("votes") >= ALSO * F.col("most")) & (F.col("votes") >= OF_PAGES * F.col("pages")))
    order = F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("rank"), "path")))
    return ranked.groupBy("host").agg(F.transform(order, lambda s: s["path"]).alias("winners"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page: its main text and the number of its code points.

    Each page votes for the tag-class paths of all its containers with their worth; a path is
    named by a digest of its steps. Votes are summed by host and path before a host's winners
    are taken (the first, and all with ``ALSO`` of its votes), so a host with a third of all
    pages is a few rows. Then each page is read again by its host's winners. Elements marked as
    menus, adverts, forms and so on are left out unless they hold the article itself, judged by
    the text inside and outside of them. Null html is empty and has an empty text; a null url is
    a host of its own. Broken markup is read as far as it goes. Repeated rows are extracted
    each; other columns are not read.
    """
    own = pick(pages, page_id=page_id, url=url, html=html).withColumn("host", host_of(F.col("url")))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, str], float] = {}
            for host, page in zip(*(batch.column(c).to_pylist() for c in ("host", "html"))):
                for path, share in [(EACH, 1.0), *page_votes(page or "")]:
                    sums[host, path] = sums.get((host, path), 0.0) + share
            hosts, paths = zip(*sums) if sums else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array([*sums.values()], pa.float64())],
                names=["host", "path", "votes"],
            )

    votes = own.select("host", "html").mapInArrow(vote, "host string, path string, votes double")
    votes = votes.groupBy("host", "path").agg(F.round(F.sum("votes"), 6).alias("votes"))
    # as a table, the join's two sides are plain exchanges, and a host with very many pages can be split
    winners = stash(winning_paths(stash(votes, "votes")), "winners")

    kind = pages.schema[page_id].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                texts = [page_text(h or "", w) for h, w in zip(*(some.column(c).to_pylist() for c in ("html", "winners")))]
                yield pa.RecordBatch.from_arrays(
                    [some.column("page_id"), some.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"]
                )

    joined = own.join(winners, "host", "left").select("page_id", "url", "html", "winners")
    texts = joined.mapInArrow(read, f"page_id {kind}, url string, text string")
    return texts.withColumn("n_chars", F.length("text").cast("long"))
