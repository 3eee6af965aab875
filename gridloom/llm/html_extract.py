"""Main text of web pages: a site style tree over each host, with what the markup itself says about its parts.

1. Every page is parsed into elements (unclosed and misnested tags as browsers take them). The pages of a host are merged
   into one style tree: a node is a path of tags and classes; it gathers, over the host's pages, how its children are
   arranged (presentation) and what its own text is (content).
2. The importance of a node is the larger of the entropies of its presentations and of its contents, over the logarithm
   of the number of its occurrences: a menu that is the same on all pages is near 0, text that differs is near 1. Counts
   are grouped by host, node and value, so a host with a third of all pages is no single group.
3. What markup says is a prior on importance: scripts, styles, forms, menus, page headers, footers, sidebars, notices, adverts
   and reader comments (by tag, role, class or id) have none, nor has what stands outside <article> or <main> where a page has
   one. Of all other branches, inside the article too, those go to which the host's style tree gives an importance under `least`.
   Nodes seen fewer than `seen` times on the host are kept: there is no evidence against them. Pages of equal text
   count once, so that copies of an article do not make it look like a menu.

Each page is parsed once; the rest is DataFrame functions. Text: character references decoded, white space inside a block one space, blocks joined by one newline in page order.
Null and empty html gives "" and 0; a null url counts as a host of its own. Rows that repeat each return a row.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.util import materialize, ship_package, small

#: HTML's elements that start a block, that have no content, whose content is no markup.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp template svg math".split())
#: What is never main text, by tag, role, or word of a class or id.
NOISE_TAGS = frozenset("head nav footer aside form button select dialog menu object audio video canvas label".split()) | RAW
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs toolbar footer masthead share sharing social related recommended comment comments disqus respond reply replies widget widgets pagination pager copyright".split()
)
_HEADS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
#: An element that ends when one of these starts, inside the nearest of the containers.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPLIT = re.compile(r"[^a-z0-9]+")


@dataclass(slots=True)
class Node:
    tag: str
    path: str
    noise: bool
    main: bool
    header: bool = False
    styles: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)


@dataclass(slots=True)
class Block:
    text: str
    path: str
    main: int
    noise: bool


def _traits(tag: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """Name in the style tree, and whether the element is noise, main or a header."""
    found = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(attributes)} if "=" in attributes else {}
    label = f"{found.get('class', '')} {found.get('id', '')}".strip()
    words = set(_SPLIT.split(label)) if label else set()
    role = found.get("role", "")
    hidden = found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "") or (attributes and re.search(r"(?:^|\s)hidden(?:\s|/|$)", attributes) is not None)
    main = tag in ("article", "main") or role in ("main", "article")
    noise = tag in NOISE_TAGS or role in NOISE_ROLES or bool(hidden) or (bool(words & NOISE_WORDS) and tag not in ("html", "body"))
    if main and not hidden and not words & {"comment", "comments", "reply", "replies", "related", "recommended", "ad", "ads", "advert", "sponsored", "promo"}:
        noise = False
    name = f"{tag}.{'.'.join(sorted(found.get('class', '').split()))}" if found.get("class") else tag
    return name, noise, main, tag == "header" or "header" in words


def parse(page: str | None) -> tuple[list[Block], list[tuple[str, str, str]]]:
    """Blocks in page order, and for each block element its node path, children and own text."""
    blocks: list[Block] = []
    nodes: list[tuple[str, str, str]] = []
    if not page:
        return blocks, nodes
    stack = [Node("", "", False, False)]
    held: list[str] = []
    n_main = 0

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                top = next(n for n in reversed(stack) if n.tag in BLOCKS or not n.tag)
                inside = any(n.main and not n.noise for n in stack)
                top.text.append(text)
                # headings of a header inside the main part are the article's own; the rest of a header goes
                cut = any(n.noise for n in stack) or (any(n.header for n in stack) and not (inside and any(n.tag in _HEADS for n in stack)))
                blocks.append(Block(text, top.path, sum(n.main for n in stack), cut))

    def pop() -> None:
        node = stack[-1]
        if node.tag in BLOCKS:
            flush()
            nodes.append((node.path, " ".join(node.styles), "\n".join(node.text)))
        stack.pop()

    at, end = 0, len(page)
    while at < end:
        m = _MARKUP.search(page, at)
        if m is None:
            held.append(entities.unescape(page[at:]))
            break
        if m.start() > at:
            held.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            if tag == "p" and all(n.tag != "p" for n in stack):
                flush()
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    while len(stack) > i:
                        pop()
                    break
                if tag not in BLOCKS and stack[i].tag in BLOCKS:
                    break
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = close.end() if close else end
            continue
        if tag in BLOCKS:
            flush()
            if tag not in ("html", "body"):
                # a block ends an open paragraph, and what is open inside it
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p":
                        while len(stack) > i:
                            pop()
                        break
                    if stack[i].tag in BLOCKS:
                        break
            ends, within = _CLOSES.get(tag, ((), ()))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    while len(stack) > i:
                        pop()
                    if tag != "tr":
                        break
                elif stack[i].tag in within:
                    break
            if tag == "body":
                while len(stack) > 1 and any(n.tag == "head" for n in stack):
                    pop()
        if tag in VOID:
            continue
        name, noise, main, header = _traits(tag, attributes)
        above = stack[-1]
        if tag in BLOCKS:
            above.styles.append(name)
        n_main += main and not noise
        stack.append(Node(tag, f"{above.path}/{name}" if tag in BLOCKS else above.path, noise, main and not noise, header))
        if attributes.endswith("/") and tag not in BLOCKS:
            stack.pop()
    flush()
    while len(stack) > 1:
        pop()
    return blocks, nodes


def chosen(blocks: list[Block]) -> list[Block]:
    """The blocks that markup leaves to the style tree: those of the main part where it is marked, else all but noise."""
    inside = [b for b in blocks if b.main and not b.noise]
    return inside or [b for b in blocks if not b.noise]


def host_of(url: str | None) -> str:
    found = re.search(r"://([^/?#]*)", url or "")
    return found[1].lower() if found else ""


def _digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


_PARSED = "page_id long, url string, host string, page long, texts array<string>, paths array<long>, nodes array<struct<path: bigint, kind: int, value: bigint>>"


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for page_id, url, page in zip(batch["page_id"], batch["url"], batch["html"], strict=True):
            blocks, nodes = parse(page)
            left = chosen(blocks)
            at = {path: _digest(path) for path in {n[0] for n in nodes} | {b.path for b in left}}
            values = [(at[path], kind, _digest(value)) for path, styles, text in nodes for kind, value in ((0, styles), (1, text)) if value or not kind]
            rows.append((page_id, url, host_of(url), _digest("\n".join(b.text for b in blocks)), [b.text for b in left], [at[b.path] for b in left], values))
        yield pd.DataFrame(rows, columns=["page_id", "url", "host", "page", "texts", "paths", "nodes"])


def parsed(pages: DataFrame) -> DataFrame:
    """Each page, parsed once: the blocks that markup leaves, their nodes, and all nodes' presentations (0) and contents (1)."""
    ship_package(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInPandas(_parse, _PARSED)


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, kind, value, c): how often each presentation and content occurs; of pages of equal text on a host one counts.

    pages: written down, with a number `row`. Nodes are counted where they are before anything is shuffled.
    """
    groups = materialize(pages.groupBy("host", "page").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "copied")
    copies = materialize(pages.select("row", "host", "page").join(small(groups, groups.count(), 48), ["host", "page"]).where("row <> first").select("row"), "copies")
    nodes = pages.join(small(copies, copies.count(), 16), "row", "left_anti").select("host", F.explode("nodes").alias("n")).select("host", "n.*")
    return nodes.groupBy("host", "path", "kind", "value").agg(F.count("*").alias("c"))


def importance(tree: DataFrame) -> DataFrame:
    """(host, path, n, importance): n occurrences; the larger entropy of presentations and contents over log n."""
    by_kind = tree.groupBy("host", "path", "kind").agg(F.sum("c").alias("n"), F.sum(F.expr("c * ln(c)")).alias("s"))
    entropy = by_kind.withColumn("h", F.expr("if(n > 1, greatest(0D, (ln(n) - s / n) / ln(n)), 1D)"))
    return entropy.groupBy("host", "path").agg(F.max("n").alias("n"), F.max("h").alias("importance"))


def html_extract(pages: DataFrame, least: float = 0.3, seen: int = 10) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    held = materialize(parsed(pages).withColumn("row", F.monotonically_increasing_id()), "parsed")
    weak = materialize(importance(style_tree(held)).where(F.col("n") >= seen).where(F.col("importance") < least).select("host", "path"), "weak")
    asked = held.select("row", "host", F.explode(F.array_distinct("paths")).alias("path"))
    low = materialize(asked.join(small(weak, weak.count(), 64), ["host", "path"]).groupBy("row").agg(F.collect_set("path").alias("low")), "low")
    n, paths = low.agg(F.count("*"), F.coalesce(F.sum(F.size("low")), F.lit(0))).first()
    judged = held.join(small(low, n + paths, 16), "row", "left")
    left = judged.withColumn("text", F.expr("array_join(if(low is null, texts, filter(texts, (t, i) -> not array_contains(low, get(paths, i)))), '\n')"))
    return left.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
