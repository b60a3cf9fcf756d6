"""Main text of web pages by site style trees.

The pages of one host are merged into a tree of styles: a node is the chain of tags and classes that leads to it. Per node the
pages' presentations (sequence of child styles) and contents (the text below) are counted. A node's importance is the entropy of its
contents and presentations over the pages, relative to the largest possible: a menu says the same on all pages (near 0), an article something
else on each (near 1). Pages of one host with the same text (by the rules of tags and names below) count once. Nodes of at least MIN_PAGES
such pages and an importance below THRESHOLD are noise for the whole host, inside articles too; html, body, what holds an article and what
holds most of the text of its pages never are.

A page loses noise branches, branches whose tag is never content (scripts, styles, forms, menus, asides) and branches whose class, id or
role names a menu, notice, advert, sidebar or comment. Inside an article such names count only for what differs from page to page by
nature (adverts, comments, related links), as the tree judges the rest; they never count for html and body, for what holds an article and,
where none is marked, for what holds most of the page's text. If a page marks an article (or main part), that is its text; otherwise all
that is left. Blocks are the texts between block tags: character references decoded, white space made one space, trimmed,
joined by two line ends.

Only counts per host and node are gathered; noise nodes go to the pages by a join on the host, or to all tasks while they are
few. Null html is empty; pages without host are one site of their own.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import keep
from tallybook.llm.urlfilter import host_of

MIN_PAGES = 5
THRESHOLD = 0.4
CONTENT_WEIGHT = 0.9
BROADCAST_NODES = 50_000
"""Up to this many noise nodes (a few MB) are sent to all tasks; beyond, pages and nodes are shuffled by host."""

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr "
    "html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption center option".split()
)
CLOSED_BY_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("table ul ol dl article section main div body td th blockquote".split())
DROPPED = frozenset("head script style noscript template iframe svg math canvas object form nav aside footer button select textarea menu dialog title xmp input".split())
MAIN = frozenset(("article", "main"))
NOISE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|gdpr|notice|alert|popup|modal|newsletter|"
    r"subscribe|subscription|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|topbar|toolbar|share|sharing|social|related|"
    r"recommended|comments?|commentlist|disqus|respond|replies|login|signup|search|widget|skip|complementary|contentinfo)(?:$|[\s_-])",
    re.I,
)
VARYING_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|related|recommended|comments?|commentlist|disqus|respond|replies)(?:$|[\s_-])", re.I
)
"""Names of noise that differs from page to page, so that a style tree cannot tell it."""
WHOLE = frozenset(("html", "body"))
MOST = 0.5
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I)


@dataclass
class Node:
    tag: str
    key: int
    dropped: bool
    main: bool
    named: bool = False
    parent: Node | None = None
    size: int = 0
    holds_main: bool = False
    gone: bool | None = None
    content: xxhash.xxh3_64 = field(default_factory=xxhash.xxh3_64)
    styles: xxhash.xxh3_64 = field(default_factory=xxhash.xxh3_64)


def read_page(page: str, noise: frozenset[int] | set[int], nodes: list | None = None) -> str:
    """Main text of a page; ``nodes`` collects (key, styles, content, size) of every node with text, the whole page last."""
    root = Node("#root", 0, False, False)
    stack, blocks, pieces, made = [root], [], [], []
    usable = 0  # characters outside tags that are never content

    def flush() -> None:
        if not pieces:
            return
        text = " ".join(html.unescape("".join(pieces)).split())
        pieces.clear()
        if not text:
            return
        raw = text.encode("utf-8", "surrogatepass")
        inside = dropped = False
        for n in stack:
            n.content.update(raw)
            n.size += len(text)
            inside, dropped = inside or n.main, dropped or n.dropped
        if inside:
            for n in stack:
                if n.main:
                    break
                n.holds_main = True
        nonlocal usable
        usable += 0 if dropped else len(text)
        blocks.append((text, inside, stack[-1]))

    def close(upto: int) -> None:
        for node in reversed(stack[upto:]):
            if nodes is not None and node.size and not (node.main or node.holds_main or node.tag in WHOLE):
                nodes.append((node.key, node.styles.intdigest(), node.content.intdigest(), node.size))
        del stack[upto:]

    at, end = 0, len(page)
    while at < end:
        found = _TOKEN.search(page, at)
        if found is None:
            pieces.append(page[at:])
            break
        if found.start() > at:
            pieces.append(page[at : found.start()])
        at = found.end()
        slash, tag, rest = (found.group(1), found.group(2), found.group(3)) if found.group(2) else (found.group(4), found.group(5), found.group(6))
        if not tag:
            continue
        tag = tag.lower()
        if slash:
            if tag in BLOCK:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    if tag not in BLOCK and any(stack[x].tag in BLOCK for x in range(k + 1, len(stack))):
                        break  # an inline tag does not end the blocks within
                    close(k)
                    break
            continue
        if tag == "br":
            pieces.append(" ")
        if tag in BLOCK:
            flush()
            if tag not in ("option", "legend", "summary", "caption"):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "p":
                        close(k)
                        break
                    if stack[k].tag in SCOPE:
                        break
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in CLOSED_BY_SAME.get(tag, ()):
                    close(k)
                    break
                if stack[k].tag in SCOPE and not (tag == "tr" and stack[k].tag in ("td", "th")):
                    break
        if tag in VOID or rest.endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            at = page.find(">", stop.start()) + 1 or end if stop else end
            continue
        names = " ".join(next(g for g in m.groups()[1:] if g is not None) for m in _ATTRIBUTE.finditer(rest)) if rest else ""
        style = f"{tag}.{names}"
        parent = stack[-1]
        parent.styles.update(style.encode("utf-8", "surrogatepass"))
        inside = any(n.main for n in stack)
        main = tag in MAIN or "main" == names.lower()
        dropped = tag in DROPPED or (tag == "header" and not inside)
        named = bool(names and not main and tag not in WHOLE and (VARYING_WORDS if inside else NOISE_WORDS).search(names))
        key = xxhash.xxh3_64_intdigest(style.encode("utf-8", "surrogatepass"), seed=parent.key) >> 1
        stack.append(Node(tag, key, dropped, main, named, parent))
        made.append(stack[-1])
    flush()
    close(1)
    if nodes is not None:
        nodes.append((0, 0, 0, root.size))
    marked = any(inside for _, inside, _ in blocks)
    root.gone = False
    for n in made:  # parents come before what they hold
        judged = (n.named and (marked or n.size <= MOST * usable)) or (n.key in noise and not n.main and n.tag not in WHOLE)
        n.gone = n.parent.gone or n.dropped or (judged and not n.holds_main)
    chosen = [text for text, inside, n in blocks if inside and not n.gone]
    return "\n\n".join(chosen or [text for text, _, n in blocks if not n.gone])


def style_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, nodes) of the pages of each batch: a hash of the text without the tree, and (node, styles, content, share of the page)."""
    for batch in batches:
        hosts, texts, trees = [], [], []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            merged: dict[int, tuple[int, int, int]] = {}
            nodes: list = []
            text = read_page(page or "", frozenset(), nodes)
            *nodes, (_, _, _, whole) = nodes
            for key, styles, content, size in nodes:  # one entry per page and node
                s, c, n = merged.get(key, (0, 0, 0))
                merged[key] = ((s * 31 + styles) & (2**63 - 1), (c * 31 + content) & (2**63 - 1), n + size)
            if merged:
                hosts.append(host)
                texts.append(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1)
                trees.append([{"node": k, "styles": s, "content": c, "share": n / whole} for k, (s, c, n) in sorted(merged.items())])
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(texts, pa.int64()), pa.array(trees, _TREE)], names=["host", "page", "nodes"])


_TREE = pa.list_(pa.struct([("node", pa.int64()), ("styles", pa.int64()), ("content", pa.int64()), ("share", pa.float64())]))


def importance(nodes: DataFrame) -> DataFrame:
    """(host, node, pages, importance, share): entropy of contents and presentations, relative to the largest possible; share of the text."""

    def entropy(kind: str) -> DataFrame:
        counts = nodes.groupBy("host", "node", kind).agg(F.count(F.lit(1)).alias("n"), F.sum("share").alias("share"))
        total = counts.groupBy("host", "node").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("known"), (F.sum("share") / F.sum("n")).alias("share"))
        relative = F.when(F.col("pages") > 1, 1 - F.col("known") / (F.col("pages") * F.log("pages"))).otherwise(1.0)
        return total.select("host", "node", "pages", "share", relative.alias(kind))

    both = entropy("content").join(entropy("styles").drop("pages", "share"), ["host", "node"])
    return both.select("host", "node", "pages", "share", (CONTENT_WEIGHT * F.col("content") + (1 - CONTENT_WEIGHT) * F.col("styles")).alias("importance"))


def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [read_page(page or "", frozenset(noise or ())) for page, noise in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, url, text, n_chars) per row of pages."""
    plain = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), host_of(F.col(url_col).cast("string")).alias("host"), F.col(html_col).cast("string").alias("html")
    )
    trees = plain.select("host", "html").mapInArrow(style_nodes, "host string, page long, nodes array<struct<node:long,styles:long,content:long,share:double>>")
    once = trees.groupBy("host", "page").agg(F.max("nodes").alias("nodes"))
    nodes = keep(once.select("host", F.explode("nodes").alias("n")).select("host", "n.*"), "style-nodes")
    low = (F.col("pages") >= min_pages) & (F.col("importance") < threshold) & (F.col("share") <= MOST)
    noise = keep(importance(nodes).where(low).select("host", "node"), "noise")
    few = noise.count() <= BROADCAST_NODES
    lists = noise.groupBy("host").agg(F.collect_list("node").alias("noise"))
    met = plain.join(F.broadcast(lists) if few else lists, "host", "left")
    return met.select("page_id", "url", "html", "noise").mapInArrow(extract, "page_id long, url string, text string, n_chars long")
