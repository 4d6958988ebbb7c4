"""The main text of web pages, by the ratios of their tag paths.

A page is read once into blocks: runs of text between tags that end a line, each with the path of block tags from the root
to it (inline markup is folded into its block). For each path of a page two ratios are summed up: text outside links to
blocks, and punctuation to blocks. Both are smoothed over the blocks in page order with a Gaussian kernel and brought back
to the paths as means, then fused with the share of a path's text outside links to a geometric mean; paths inside an
article or main element weigh more. The path with most text by score is the main path, and a path whose score is at least SHARE of the main path's is content.

The element around the blocks of the main path, or the article (main) element it lies in, holds the article: other
content paths count inside it only. Of the rest inside it, everything in an article that isn't mostly links is kept; in
other elements what stands between content, and headings just above it. So short paragraphs, lists and headings stay.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are known by tag, role or
words of class and id, and never become blocks (headings of a header inside an article do). Where class words leave no
text at all they are not believed, and only tags and roles count.

A null page is empty; an empty one has an empty text. Character references are decoded; white space of any kind inside a
block becomes one space. Broken markup is read as browsers mostly do: missing end tags of paragraphs, items and cells are
supplied, stray ones ignored, an unfinished tag is text. Each row gives a row, repeated ones too.
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from dossier.llm.common import map_rows, table

SHARE = 0.25  # of the main path's score that makes a path content
MAIN_WEIGHT = 4.0  # of paths inside an article or main element
LINKS = 0.5  # share of text in links from which a path is a list of links
KERNEL = (1.0, 0.6065, 0.1353)  # Gaussian of one block's width, at distances 0 to 2

# Tags and words of HTML pages.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big blink cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup td th time tt u var wbr br img".split()
)
SPACED = frozenset("br td th".split())
DROPPED = frozenset(
    "head nav header footer aside form dialog menu template button select option datalist object svg math canvas audio video".split()
) | RAW
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription signup sidebar side sidenav menu nav navbar navigation "
    "breadcrumb breadcrumbs header masthead topbar footer footnav bottombar comment comments commentlist disqus reply replies respond "
    "related recommended recommendations share sharing social widget widgets toolbar pagination pager login search skip copyright".split()
)
BELIEVED_ON_ARTICLES = frozenset("ad ads advert adverts comment comments related recommended promo sponsored teaser".split())
MAIN_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# A start tag of the key ends open elements of the value, up to the tags that bound them.
_ENDED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_BOUNDS = frozenset("ul ol dl table thead tbody tfoot article main section div body html blockquote".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>=]++|=)*+)>""")
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？؟،]")


@dataclass
class Element:
    """An open element: its tag, path, whether it or one around it is dropped, and the nearest article around it."""

    tag: str
    path: int
    dropped: bool
    number: int
    article: int
    header: bool = False  # a header inside an article: only its headings count


@dataclass
class Block:
    text: str
    path: int
    element: int
    tag: str
    article: int
    links: int


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    parents: list[int] = field(default_factory=lambda: [-1])  # of elements
    tags: list[str] = field(default_factory=lambda: ["#"])


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(text)} if text else {}


def _is_dropped(tag: str, given: dict[str, str], classes: bool) -> bool:
    if tag in DROPPED or given.get("role", "").lower() in DROPPED_ROLES:
        return True
    if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(given.get("style", "")):
        return True
    if not classes or tag in ("html", "body", "main"):
        return False
    words: set[str] = set()
    for name in f"{given.get('class', '')} {given.get('id', '')}".split():
        parts = [w.lower() for w in _WORD.findall(name)]
        if not {"has", "with", "no", "without"} & set(parts):
            words.update(parts)
    return bool(words & (BELIEVED_ON_ARTICLES if tag == "article" else DROPPED_WORDS))


def read_page(source: str, classes: bool = True) -> Page:
    """The blocks of a page in order; dropped elements give none. `classes`: believe words of class and id."""
    page = Page()
    paths: dict[tuple[int, str], int] = {}
    stack = [Element("#", 0, False, 0, 0)]
    opened: dict[str, int] = {}
    segments: list[str] = []
    in_links = 0
    links = 0

    def around() -> Element:
        return next(e for e in reversed(stack) if e.tag not in INLINE)

    def flush() -> None:
        nonlocal in_links
        if segments:
            text = " ".join("".join(segments).split())
            if text:
                e = around()
                page.blocks.append(Block(text, e.path, e.number, e.tag, e.article, min(in_links, len(text))))
            segments.clear()
        in_links = 0

    def pop() -> None:
        nonlocal links
        e = stack.pop()
        opened[e.tag] -= 1
        links -= e.tag == "a"

    def add(text: str) -> None:
        nonlocal in_links
        top = stack[-1]
        if top.dropped or (top.header and not any(e.tag in HEADINGS for e in stack)):
            return
        text = html.unescape(text)
        segments.append(text)
        if links:
            in_links += len(text.strip())

    def end_until(tags: tuple[str, ...]) -> None:
        """Close the nearest open element of `tags`, unless a bounding element stands before it."""
        if any(opened.get(t) for t in tags):
            for e in reversed(stack):
                if e.tag in tags:
                    while stack[-1] is not e:
                        pop()
                    pop()
                    return
                if e.tag in _BOUNDS:
                    return

    at, n = 0, len(source)
    while at < n:
        start = source.find("<", at)
        if start < 0:
            add(source[at:])
            break
        if start > at:
            add(source[at:start])
        if source.startswith("<!--", start):
            end = source.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        if source.startswith(("<!", "<?"), start):
            end = source.find(">", start)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(source, start)
        if not m:
            add("<")
            at = start + 1
            continue
        at = m.end()
        closing, tag, rest = m[1], m[2].lower(), m[3]
        if tag not in INLINE:
            flush()
        elif tag in SPACED and segments:
            segments.append(" ")
        if closing:
            if opened.get(tag):
                while stack[-1].tag != tag:
                    pop()
                pop()
            continue
        if tag in VOID:
            continue
        if tag in _ENDED:
            end_until(_ENDED[tag])
        if tag not in INLINE:
            end_until(("p",))
        given = _attributes(rest)
        up = stack[-1]
        article = up.article
        header = up.header or (tag == "header" and article > 0)
        dropped = up.dropped or (_is_dropped(tag, given, classes) and not (tag == "header" and header))
        number, path = up.number, up.path
        if tag not in INLINE:
            number = len(page.parents)
            page.parents.append(up.number)
            page.tags.append("main" if given.get("role") == "main" else tag)
            path = paths.setdefault((up.path, tag), len(paths) + 1)
            if tag == "article" or page.tags[-1] == "main" and not article:
                article = number
        if rest.endswith("/") and tag in ("svg", "path", "g"):
            continue
        stack.append(Element(tag, path, dropped, number, article, header))
        opened[tag] = opened.get(tag, 0) + 1
        links += tag == "a"
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(source, at)
            at = n if end is None else end.start()
    flush()
    return page


def _smoothed(values: list[float]) -> list[float]:
    """Means with Gaussian weights over two neighbours on each side; at the ends over what is there."""
    out = []
    for i in range(len(values)):
        weight = total = 0.0
        for j in range(max(0, i - len(KERNEL) + 1), min(len(values), i + len(KERNEL))):
            w = KERNEL[abs(i - j)]
            weight += w
            total += w * values[j]
        out.append(total / weight)
    return out


@dataclass
class PathRatios:
    blocks: int = 0
    chars: int = 0
    links: int = 0
    punctuation: int = 0
    article: bool = False
    text: float = 0.0
    marks: float = 0.0

    @property
    def score(self) -> float:
        outside = 1 - self.links / self.chars if self.chars else 0.0
        return math.sqrt(self.text * self.marks * outside) * (MAIN_WEIGHT if self.article else 1.0)


def path_ratios(blocks: list[Block]) -> dict[int, PathRatios]:
    """For each path its sums, its smoothed ratios of text and of punctuation to blocks, and the score fused from them."""
    found: dict[int, PathRatios] = {}
    for b in blocks:
        p = found.setdefault(b.path, PathRatios())
        p.blocks += 1
        p.chars += len(b.text)
        p.links += b.links
        p.punctuation += len(_PUNCTUATION.findall(b.text))
        p.article |= b.article > 0
    text = _smoothed([(found[b.path].chars - found[b.path].links) / found[b.path].blocks for b in blocks])
    marks = _smoothed([(found[b.path].punctuation + 1) / found[b.path].blocks for b in blocks])
    for b, t, m in zip(blocks, text, marks):
        found[b.path].text += t / found[b.path].blocks
        found[b.path].marks += m / found[b.path].blocks
    return found


def _holder(page: Page, blocks: list[Block]) -> int:
    """The innermost article around the blocks, or else the deepest element around all of them (above a lone one)."""
    if blocks[0].article and all(b.article == blocks[0].article for b in blocks):
        return blocks[0].article
    chain: list[int] = []
    node = page.parents[blocks[0].element]
    while node > 0:
        chain.append(node)
        node = page.parents[node]
    for b in {b.element: b for b in blocks}.values():
        above, node = set(), b.element
        while node > 0:
            above.add(node)
            node = page.parents[node]
        chain = [c for c in chain if c in above]
    return chain[0] if chain else 0


def content_blocks(page: Page, share: float = SHARE) -> list[Block]:
    """The blocks of the article, in page order."""
    blocks = page.blocks
    if not blocks:
        return []
    paths = path_ratios(blocks)
    main = max(paths, key=lambda p: (paths[p].score * (paths[p].chars - paths[p].links), -p))
    bar = share * paths[main].score
    holder = _holder(page, [b for b in blocks if b.path == main])
    inside = [False] * len(page.parents)  # parents come before their children
    for e in range(1, len(page.parents)):
        inside[e] = e == holder or inside[page.parents[e]]
    own = [b for b in blocks if inside[b.element] or holder == 0]
    content = [paths[b.path].score >= bar for b in own]
    prose = [paths[b.path].links < LINKS * paths[b.path].chars for b in own]
    if holder and page.tags[holder] in MAIN_TAGS:
        return [b for b, c, p in zip(own, content, prose) if c or p]
    first, last = content.index(True), len(content) - 1 - content[::-1].index(True)
    while first and own[first - 1].tag in HEADINGS and prose[first - 1]:
        first -= 1
    return [b for i, b in enumerate(own) if first <= i <= last and (content[i] or prose[i])]


def main_text(source: str | None, share: float = SHARE) -> str:
    """The article's blocks, joined by an empty line."""
    page = read_page(source or "")
    if not page.blocks:
        page = read_page(source or "", classes=False)
    return "\n\n".join(b.text for b in content_blocks(page, share))


def extract_text(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def make():
        def step(given):
            texts = [main_text(h, share) for h in given["html"]]
            yield {"page_id": given["page_id"], "url": given["url"], "text": texts, "n_chars": [len(t) for t in texts]}

        return step

    wanted = pages.selectExpr("cast(page_id as long) page_id", "url", "html")
    return map_rows(wanted, "page_id long, url string, text string, n_chars long", make, rows=64)


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
