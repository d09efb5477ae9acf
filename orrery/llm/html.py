"""Main text of web pages by consensus on each host's paths.

Pages of a host share templates. Each page's containers are scored by the text they hold and by how little of it lies in
links; a container's path, the chain of tags with their classes and with digits taken out, gets the page's vote. Votes
are summed for each host in Spark, and every page is read again at its host's winning path. A page without that path
uses its own best container.

Within the container, menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments
are left out, by tag and by class, id and role. A class counts if all its words speak of such parts or are words of layout;
a few names that articles use as well count outside of articles only. A block is what block-level tags bound; a line break
inside a block is white space. Each page is parsed twice, once for its vote and once for its text: keeping the parsed blocks
between would write all text to disk once more.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Hosts up to which the table of winning paths is broadcast.
BROADCAST_HOSTS = 50_000
#: A path or a step that is longer goes on as its digest: paths stay whole and their length bounded.
PATH_CHARS = 400

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?>=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)",
    re.S | re.I,
)
#: Elements whose content is no markup.
_RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in ("script", "style", "textarea", "title", "xmp")}
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SELF_CLOSED = re.compile(r"(?:\A|[\s\"'])/\s*\Z")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CONTAINERS = {"html", "body", "main", "article", "section", "div", "td", "center"}
BLOCKS = CONTAINERS | {
    "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "tr", "th", "thead", "tbody", "tfoot", "caption", "blockquote", "pre",
    "figure", "figcaption", "header", "footer", "nav", "aside", "form", "fieldset", "address", "details", "summary", "hr", "hgroup", "dialog", "menu", "head",
}
DROPPED = {
    "nav", "header", "footer", "aside", "form", "fieldset", "button", "select", "option", "datalist", "head", "menu", "dialog",
    "noscript", "template", "iframe", "svg", *_RAW,
}
#: Names of parts that are left out, names that also occur inside articles, and words of layout that may stand beside either.
PARTS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promos promotion promotions banner sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead topbar comment comments commentlist respond reply replies disqus notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe signup "
    "login toolbar pagination pager disclaimer copyright".split()
)
SHARED = frozenset("side foot search share sharing social related recommended widget widgets legal alert alerts tags".split())
LAYOUT = frozenset(
    "box boxes wrap wrapper container block section bar list area inner outer top bottom left right site page global main primary secondary row col column group item items link links "
    "button buttons icon icons slot unit form message policy panel content holder region zone sticky fixed mobile desktop".split()
)
_KEPT = {"html", "body", "article", "main"}
#: Elements that another of their kind or an outer end closes.
_CLOSES = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}


class Box(NamedTuple):
    path: str
    begin: int  # of its blocks
    end: int
    parent: int


def _named(token: str, in_article: bool) -> bool:
    """Whether a class, an id or a role names a part that is left out."""
    words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower()) if w]
    if not words or not all(w in PARTS or w in SHARED or w in LAYOUT for w in words):
        return False
    return any(w in PARTS for w in words) or any(w in SHARED for w in words) and (not in_article or len(words) > 1)


def _digest(text: str) -> str:
    return "#" + hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _boilerplate(tag: str, attrs: str, in_article: bool) -> tuple[bool, str]:
    """(whether the element is left out, its step in a path)."""
    step, out = tag, tag in DROPPED
    if "=" in attrs or "hidden" in attrs.lower():
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), a or b or c
            if name == "class":
                if classes := ".".join(sorted(set(re.sub(r"\d+", "", value.lower()).split()))):
                    step = f"{tag}.{classes}"
            if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                out = True
            elif name in ("class", "id", "role") and not out and tag not in _KEPT:
                out = any(_named(token, in_article) for token in value.split())
    return out, step if len(step) <= PATH_CHARS else tag + _digest(step)


def parse(page: str) -> tuple[list[tuple[str, int]], list[Box]]:
    """The blocks of a page outside boilerplate, each with the characters of it in links, and its containers in page order.

    The header of an article gives its headings only.
    """
    blocks: list[tuple[str, int]] = []
    boxes: list[list] = []
    stack: list[tuple[str, bool, int]] = []  # tag, left out, box or -1
    opened: Counter = Counter()
    inside: list[int] = []  # boxes
    text: list[str] = []
    in_links = links = out = headings = 0

    def end_block() -> None:
        nonlocal in_links
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            if joined:
                blocks.append((joined, min(in_links, len(joined))))
            text.clear()
        in_links = 0

    def pop() -> None:
        nonlocal out, links
        tag, left_out, box = stack.pop()
        opened[tag] -= 1
        out -= left_out
        links -= tag == "a"
        if box >= 0:
            boxes[box][2] = len(blocks)
            inside.pop()

    def heard() -> bool:
        return not out or headings > 0 and out == 1

    at = 0
    while m := _TOKEN.search(page, at):
        if m.start() > at and heard():
            text.append(piece := page[at : m.start()])
            if links:
                in_links += len(piece)
        at = m.end()
        tag = m["tag"]
        if not tag:
            if m[0].startswith("<![CDATA[") and (opened["svg"] or opened["math"]) and heard():
                text.append(entities.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        if tag in BLOCKS:
            end_block()
        elif tag == "br":
            text.append(" ")
        if m["close"]:
            if opened[tag] > 0:
                while stack[-1][0] != tag:
                    pop()
                pop()
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                headings = max(0, headings - 1)
            continue
        attrs = m["attrs"]
        empty = attrs.rstrip().endswith("/") and _SELF_CLOSED.search(attrs) is not None
        if tag in VOID or empty and tag not in BLOCKS:
            continue
        if tag in _RAW:
            end = _RAW[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if closes := _CLOSES.get(tag):
            if any(opened[x] > 0 for x in closes):
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] in closes:
                        while len(stack) > depth:
                            pop()
                        break
                    if stack[depth][0] in BLOCKS and stack[depth][0] != "p":
                        break
        elif tag in BLOCKS:
            while opened["p"] > 0:
                pop()
        in_article = opened["article"] > 0 or opened["main"] > 0
        left_out, step = _boilerplate(tag, attrs, in_article)
        if empty and left_out:
            continue
        box = -1
        if tag in CONTAINERS and not left_out and not out:
            parent = inside[-1] if inside else -1
            above = boxes[parent][0] if inside else ""
            path = f"{above if len(above) <= PATH_CHARS else _digest(above)}>{step}" if above else step
            box = len(boxes)
            boxes.append([path, len(blocks), None, parent])
            inside.append(box)
        if tag == "header" and in_article:
            headings = 0
        if tag in ("h1", "h2", "h3") and out == 1 and opened["header"] > 0 and in_article:
            headings += 1
        links += tag == "a"
        out += left_out
        stack.append((tag, left_out, box))
        opened[tag] += 1
    if at < len(page) and heard():
        text.append(page[at:])
    end_block()
    while stack:
        pop()
    return blocks, [Box(b[0], b[1], b[2] if b[2] is not None else len(blocks), b[3]) for b in boxes]


def score(blocks: list[tuple[str, int]], boxes: list[Box]) -> list[float]:
    """For each container, the text outside links, weighed down for each level of the tree it is farther from its text."""
    upto = [0]
    for t, linked in blocks:
        upto.append(upto[-1] + len(t) - 2 * linked)
    inner = [0] * len(boxes)
    for b in boxes:
        if b.parent >= 0:
            inner[b.parent] += upto[b.end] - upto[b.begin]
    own = [0.0] * len(boxes)
    for i, b in enumerate(boxes):
        # What lies in the container itself counts whole, what lies in inner containers half.
        own[i] = max(0.0, upto[b.end] - upto[b.begin] - inner[i] / 2)
        step = b.path.rsplit(">", 1)[-1].split(".")[0]
        if step in ("article", "main"):
            own[i] *= 1.5
        elif step in ("html", "body"):
            own[i] *= 0.7
    return own


def best(blocks: list[tuple[str, int]], boxes: list[Box]) -> int:
    """Number of the page's best container, -1 if none holds text; the first of equals."""
    s = score(blocks, boxes)
    return max(range(len(s)), key=lambda i: (s[i], -i)) if s and max(s) > 0 else -1


def text_at(blocks: list[tuple[str, int]], boxes: list[Box], path: str | None) -> str:
    """The text at a path, all places of it in page order, or at the page's own best container, or of the whole page."""
    places, upto = [], 0
    for b in boxes:
        if b.path == path and b.begin >= upto and b.end > b.begin:
            places += range(b.begin, b.end)
            upto = b.end
    if not places:
        i = best(blocks, boxes)
        places = range(boxes[i].begin, boxes[i].end) if i >= 0 else range(len(blocks))
    return "\n".join(blocks[p][0] for p in places)


def _host():
    return F.lower(F.coalesce(F.regexp_extract(F.col("url"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, score) for each page with text: its best container's path."""
    common.bounded_batches(common.session(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                blocks, boxes = parse(page)
                i = best(blocks, boxes)
                if i >= 0:
                    rows.append((host, boxes[i].path, float(sum(len(t) - n for t, n in blocks[boxes[i].begin : boxes[i].end]))))
            cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.float64()), strict=True)], names=["host", "path", "score"])

    return pages.select(_host().alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).mapInArrow(run, "host string, path string, score double")


def consensus(pages: DataFrame) -> DataFrame:
    """(host, path): the path with most votes, then most text, then the last by name. Sums come before the exchange by host."""
    sums = votes(pages).groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("score").alias("score"))
    return sums.groupBy("host").agg(F.max(F.struct("n", "score", "path")).alias("m")).select("host", "m.path")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html; other columns are ignored).

    Null and empty html give an empty text. Pages without a host, or with a null url, vote as one host. Repeated rows are
    read each for itself; an empty table gives no rows.
    """
    common.bounded_batches(common.session(pages))
    paths = common.cut(consensus(pages))
    if paths.count() <= BROADCAST_HOSTS:
        paths = F.broadcast(paths)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), _host().alias("host"))
    rows = rows.join(paths, "host", "left").select("page_id", "url", "html", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_at(*parse(page), path) for page, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
