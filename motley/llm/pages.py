"""Main text of web pages by tag-path ratios.

A page is a run of blocks, each with its path of block tags from the root. Per path, text length, punctuation and
link text are summed over its blocks; their ratios to the number of blocks, fused and smoothed over neighbouring
blocks, tell content paths from the rest, so a short paragraph stays with the long ones of its path. Two more features
weigh on a path's score: that it stands in an article element, and that a class or id on it speaks of adverts, comments and
the like. Paths whose score is a part of the best are content. With a content block stays what else its element's parent, or
the article element around it, holds: headings, lists, short entries. Menus, asides, forms, footers and what is hidden, by
their tags and roles, are no blocks at all.

A page is read once from front to back, whatever its faults; paths are numbers in a tree of paths.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motley.llm.common import text_slices, texts_of

# Names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg math object select canvas audio video".split())
OUTSIDE = frozenset("nav footer aside form menu dialog head button fieldset".split())
MAIN = frozenset("article main".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table body html article section div td".split())
ROLES = frozenset("navigation banner contentinfo search complementary dialog alert alertdialog menu menubar toolbar form".split())

#: Words of class and id attributes that mark what is no article. (fixed values)
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|banner\w*|sponsor\w*|promo\w*|cookie\w*|consent\w*|gdpr|notice\w*|alert\w*|sidebar\w*|menu\w*|nav\w*|breadcrumb\w*|"
    r"footer\w*|masthead|topbar|header|site-?header|page-?header|comment\w*|repl(?:y|ies)|disqus\w*|respond|share\w*|sharing|social\w*|related\w*|recommend\w*|more-?stories|teaser\w*|newsletter\w*|subscri\w*|signup|"
    r"login|popup\w*|modal\w*|overlay\w*|widget\w*|pagination|pager|toolbar|tagcloud|skip\w*|copyright|outbrain|taboola)(?=$|[\s_-])",
    re.I,
)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=$|[\s=/])|aria-hidden\s*=\s*["']?true|display\s*:\s*none|visibility\s*:\s*hidden""", re.I)
NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
#: The rest of a tag: a > in quotes does not end it.
REST = re.compile(r"""[^"'>]*+(?:"[^"]*+"[^"'>]*+|'[^']*+'[^"'>]*+)*+>""")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PUNCTUATION = re.compile(r"[,.;:!?…，。！？；：、]")

#: Content paths have this part of the best path's smoothed score.
THRESHOLD = 0.2
#: Blocks in an article element have so many times their score, those under a class word of NOISE so little of it.
ARTICLE_WEIGHT, NOISE_WEIGHT = 4, 1 / 1000
#: Tags of text within a content block's parent that stay with it.
FLOW = frozenset("blockquote dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 li ol p pre table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: More link text than this part of a path makes it a list of links.
LINK_PART = 0.6


class Block(NamedTuple):
    path: int  # number of its path
    text: str
    links: int
    article: int  # number of the outermost article element it stands in; 0 if none
    marked: bool  # whether a class word speaks of no article
    element: int  # its innermost block element


class Element(NamedTuple):
    name: str
    noise: bool
    marked: bool
    article: int
    block: int  # number of itself, or of the block element around an inline one


class Page(NamedTuple):
    blocks: list[Block]
    names: list[str]  # of block elements; the first is the root
    parents: list[int]


def tags_of(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Where each tag begins and ends, its name (empty for comments and declarations), whether it closes, and its attributes.

    Tags before a place that is sent are passed over. Every part of the page is looked at a bounded number of times.
    """
    at, quotes = 0, True
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            end = len(page) if end < 0 else end + 3
            tag = (start, end, "", False, "")
        elif page[start + 1 : start + 2] in ("!", "?"):
            end = page.find(">", start) + 1
            if not end:
                return
            tag = (start, end, "", False, "")
        else:
            name = NAME.match(page, start + 1)
            if not name:
                at = start + 1
                continue
            rest = REST.match(page, name.end()) if quotes else None
            quotes = quotes and rest is not None  # an open quote reaches the end: from here on quotes mean nothing
            end = rest.end() if rest else page.find(">", name.end()) + 1
            if not end:
                return
            tag = (start, end, name[2].lower(), bool(name[1]), page[name.end() : end - 1])
        skip = yield tag
        at = max(end, skip or 0)


def blocks(page: str) -> Page:
    """The page's blocks in order, what its tags mark as no article left out. Unclosed and stray tags do no harm."""
    stack, out, held, links, at = [Element("", False, False, 0, 0)], [], [], 0, 0
    names, parents, paths, tree = [""], [-1], [0], {}
    opened: dict[str, int] = defaultdict(int)  # elements of each name on the stack
    articles = 0

    def flush() -> None:
        nonlocal links
        text = " ".join("".join(held).split())
        if text:
            top = stack[-1]
            out.append(Block(paths[top.block], text, min(links, len(text)), top.article, top.marked, top.block))
        held.clear()
        links = 0

    def pop(to: int) -> None:
        if any(e.name not in INLINE for e in stack[to:]):
            flush()
        for e in stack[to:]:
            opened[e.name] -= 1
        del stack[to:]

    def say(raw: str) -> None:
        nonlocal links
        if raw and not stack[-1].noise:
            held.append(entities.unescape(raw) if "&" in raw else raw)
            if any(e.name == "a" for e in stack[-4:]):
                links += len(held[-1].strip())

    tags, skip = tags_of(page), None
    while True:
        try:
            start, end, name, closes, attributes = tags.send(skip)
        except StopIteration:
            break
        skip = None
        say(page[at:start])
        at = end
        if not name:
            continue
        if closes:
            if opened[name]:
                pop(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name))
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name in ("br", "wbr", "img"):
                held.append(" " if name != "wbr" else "")
            continue
        if name in RAW:
            if not attributes.endswith("/"):
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = skip = close.end() if close else len(page)
            continue
        ends = {"p"} if name in CLOSES_P else SAME_LEVEL.get(name, ())
        if any(opened[x] for x in ends):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in ends:
                    pop(i)
                    break
                if stack[i].name in SCOPES:
                    break
        if name not in INLINE:
            flush()
        said = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
        top, role = stack[-1], said.get("role", "").lower()
        main = name in MAIN or role == "main" or said.get("itemprop", "").lower() == "articlebody"
        words = f"{said.get('class', '')} {said.get('id', '')}"
        noise = top.noise or name in OUTSIDE or name == "header" and not top.article or role in ROLES or bool(attributes and HIDDEN.search(attributes))
        marked = top.marked or name not in ("body", "html") and not main and len(words) > 1 and bool(NOISE.search(words))
        article = top.article
        if main and not noise and (not article or name == "article" and top.name == "main"):
            articles += 1
            article = articles
        if attributes.endswith("/") and name not in INLINE and name not in CLOSES_P:
            continue
        block = top.block
        if name not in INLINE:
            label = f"{name}.{said['class']}" if said.get("class") else name
            names.append(name)
            parents.append(block)
            paths.append(tree.setdefault((paths[block], label), len(tree) + 1))
            block = len(names) - 1
        opened[name] += 1
        stack.append(Element(name, noise, marked, article, block))
    say(page[at:])
    flush()
    return Page(out, names, parents)


def scores(found: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """(score of each block's path, share of link text in it): length, punctuation and links a block of the path, weighed, and smoothed
    over neighbouring blocks; a path has the best of its blocks' scores."""
    sums = defaultdict(lambda: np.zeros(4))
    for b in found:
        sums[b.path] += (1, len(b.text), len(PUNCTUATION.findall(b.text)), b.links)
    n, length, marks, links = np.array([sums[b.path] for b in found]).T
    linked = links / np.maximum(length, 1)
    weight = np.where([b.article > 0 for b in found], ARTICLE_WEIGHT, 1) * np.where([b.marked for b in found], NOISE_WEIGHT, 1)
    fused = length / n * (1 + marks / n) * (1 - linked) * weight
    kernel = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    smooth = np.convolve(fused, kernel, "full")[2:-2] / np.convolve(np.ones(len(fused)), kernel, "full")[2:-2]
    score, best = np.sqrt(fused * smooth), {}
    for b, s in zip(found, score, strict=True):
        best[b.path] = max(best.get(b.path, 0.0), s)
    return np.array([best[b.path] for b in found]), linked


def chosen(page: Page) -> list[bool]:
    """Which blocks are content, by the ratios of their paths, and by what they stand with."""
    found, names, parents = page.blocks, page.names, page.parents
    score, linked = scores(found)
    content = [s >= THRESHOLD * score.max() and x <= LINK_PART for s, x in zip(score, linked, strict=True)]
    articles = {b.article for b, x in zip(found, content, strict=True) if x and b.article}
    holders = {parents[b.element] for b, x in zip(found, content, strict=True) if x and b.element and names[parents[b.element]] not in ("", "body", "html")}
    near: dict[int, bool] = {0: False}

    def beside(element: int) -> bool:
        """In the parent of a content block, with tags of text only between."""
        way = []
        while element not in near:
            if element in holders or names[element] not in FLOW:
                near[element] = element in holders
                break
            way.append(element)
            element = parents[element]
        near.update(dict.fromkeys(way, near[element]))
        return near[element]

    def stays(b: Block, links: float) -> bool:
        if b.marked:
            return False
        if b.article in articles:
            return True
        return beside(b.element) and (links <= LINK_PART or names[b.element] in HEADINGS)

    return [x or stays(b, part) for b, x, part in zip(found, content, linked, strict=True)]


def main_text(html: str) -> str:
    page = blocks(html)
    return " ".join(b.text for b, x in zip(page.blocks, chosen(page), strict=True) if x) if page.blocks else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of `pages` (page_id, url, html): the whole page's main text, empty if it has none.

    A null or empty page has an empty text. Repeated rows stay; other columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "html"):
                texts = [main_text(x) for x in texts_of(part.column("html"))]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string").alias("url"), "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
