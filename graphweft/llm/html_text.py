"""Main text of web pages by tag-path ratios.

A page is read once into blocks (runs of text between block-level tags), each with its root-to-leaf tag path. Per path,
text length and punctuation are averaged over its blocks and fused with their spread; scores are smoothed over nearby
paths with a Gaussian of the distance in the tree of paths; paths at or above a threshold (a share of the weighted mean) are
content paths. The container of the content is found by walking down from the root while one child keeps all of the
content: the blocks of content paths, and first headings and paragraphs of any path. So content split over several containers
stays whole. All blocks in the container are taken in page order, short ones too, but what lies in boilerplate menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments, told by tag, role or
class and id. A class or id token is boilerplate if its last word is, words of structure at its end aside (``site-nav-wrapper``),
and no word denies it or tells a state or layout (``no-sidebar``, ``nav-open``, ``layout-sidebar``). An element so named stays
nevertheless if it holds most of the page's content and either an h1 or main element, or all there is.

Pages are read in one pass over their tags, and elements and tag paths are numbered, so the work is linear in the page however deep it
nests; nothing is capped, and unclosed or stray tags are tolerated the way
browsers do (a paragraph ends where the next block begins; an end tag closes to its nearest open one, or nothing).

Edge cases: a null or empty page gives an empty text; a page without content paths uses all its paths; rows are
independent, so repeated rows and null ids pass through; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, sliced, table

# Element classes of HTML, and words that mark boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
                   " head header hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul").split())
ENDS_P = BLOCK - {"br", "body", "html", "head", "option", "title"}
CONTAINERS = frozenset("html body main article section div td tr tbody table center".split())
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas".split())
DROPPED_TAGS = frozenset("head nav footer aside form button select dialog menu".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
DROPPED_WORDS = frozenset(("ad ads advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs byline comment comments comentarios commentaires kommentare"
                           " consent cookie cookies disclaimer discussion disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices notification"
                           " paywall popup promo promoted promotion reactions recommended related replies reply respond share sharing shares sidebar sidebars sitemap social"
                           " sponsor sponsored subscribe subscription teaser toolbar topbar tracking widget widgets").split())
STRUCTURE = frozenset(("area areas bar block blocks body bottom box btn button buttons center col column container content desktop entries footer form frame grid group head header"
                       " holder icon icons image images info inner item items label left leaderboard link links list lists main media message mobile module next outer overlay panel"
                       " placeholder posts prev previous primary recent rectangle region right row secondary section signup skyscraper slot sticky text this thread title"
                       " toggle tools top trail unit wrap wrapper zone").split())
DENIED_WORDS = frozenset(("active align closed disable disabled enable enabled free grid has have hidden hide hides layout loaded no non not off on open opened ready show shows skin"
                          " template theme visible with without").split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PUNCTUATION = re.compile("[.,;:!?…¿¡。，、؟]")

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_QUOTED_TAG = re.compile(r"""<(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

KEPT, NAMED, DROPPED = 0, 1, 2  # an element's own part; NAMED: boilerplate by a word of class or id


def boilerplate_name(token: str) -> bool:
    """Whether a class or id token names boilerplate."""
    words = [w.lower() for w in _WORD.findall(token)]
    if not DROPPED_WORDS.intersection(words) or DENIED_WORDS.intersection(words):
        return False
    while words and words[-1] not in DROPPED_WORDS and (words[-1] in STRUCTURE or len(words[-1]) == 1):
        words.pop()
    return bool(words) and words[-1] in DROPPED_WORDS


def _part(tag: str, attrs: str, inside_article: bool) -> int:
    if tag in DROPPED_TAGS or (tag == "header" and not inside_article):
        return DROPPED
    if not attrs or attrs.isspace():
        return KEPT
    values: dict[str, str] = {}
    for name, value in _ATTR.findall(attrs):
        values.setdefault(name.lower(), value[1:-1] if value[:1] in ("'", '"') and value[-1:] == value[0] else value)
    if "hidden" in values or DROPPED_ROLES.intersection(values.get("role", "").lower().split()):
        return DROPPED
    if tag not in ("html", "body", "article", "main"):
        names = values.get("class", "").split() + ([] if tag in HEADINGS else values.get("id", "").split())
        if any(map(boilerplate_name, names)):
            return NAMED
    return KEPT


class Page:
    """A page read once. Elements and tag paths are numbered as they open, each with its parent's number, so a block is three numbers
    and its text, however deep it lies."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, int, int]] = []  # text, path, innermost block-level element (-1: none)
        self.tags: list[str] = []  # of each block-level element
        self.parents: list[int] = []
        self.paths: list[tuple[int, str]] = [(-1, "")]  # parent's path, last tag
        self._path_ids: dict[tuple[int, str], int] = {}
        # Of each open element: tag, part, its named element or the enclosing one, block-level element, path, innermost block-level place on the stack.
        self._stack: list[tuple[str, int, int, int, int, int]] = []
        self._open_tags: dict[str, int] = defaultdict(int)
        self._dropped = 0  # open elements that are dropped
        self._named_parents: list[int] = []  # elements named as boilerplate: the enclosing one
        self._named_head: list[bool] = []
        self._named: list[int] = []  # of each block, the innermost element named as boilerplate
        self._buffer: list[str] = []
        self._read(source)
        if self._named_parents:
            self._drop_named()

    def _top(self) -> tuple[int, int, int, int]:
        """Named element, block-level element, path, and place of the innermost block-level element, at the top of the stack."""
        return self._stack[-1][2:] if self._stack else (-1, -1, 0, -1)

    def _flush(self) -> None:
        text = " ".join(entities.unescape("".join(self._buffer)).split())
        if text and not self._dropped:
            named, element, path, _ = self._top()
            self._named.append(named)
            self.blocks.append((text, path, element))
        self._buffer = []

    def _push(self, tag: str, part: int) -> None:
        named, element, path, place = self._top()
        if tag in BLOCK:
            self.tags.append(tag)
            self.parents.append(element)
            element, key = len(self.tags) - 1, (path, tag)
            path = self._path_ids.get(key, -1)
            if path < 0:
                path = self._path_ids[key] = len(self.paths)
                self.paths.append(key)
            place = len(self._stack)
        if part == NAMED:
            self._named_parents.append(named)
            self._named_head.append(False)
            named = len(self._named_parents) - 1
        self._dropped += part == DROPPED
        self._open_tags[tag] += 1
        self._stack.append((tag, part, named, element, path, place))

    def _cut(self, i: int) -> None:
        """Close the elements from place i on."""
        for x in self._stack[i:]:
            self._dropped -= x[1] == DROPPED
            self._open_tags[x[0]] -= 1
        del self._stack[i:]

    def _open(self, tag: str, attrs: str) -> None:
        if tag in ENDS_P:
            self._close_implied(("p",), ("table", "td", "th", "li", "div", "article", "section", "blockquote"))
        if tag == "li":
            self._close_implied(("li",), ("ul", "ol", "menu"))
        elif tag in ("dt", "dd"):
            self._close_implied(("dt", "dd"), ("dl",))
        elif tag in ("td", "th"):
            self._close_implied(("td", "th"), ("table", "tr"))
        elif tag == "tr":
            self._close_implied(("tr",), ("table",))
        elif tag == "body":
            self._close_implied(("head",), ("html",))
        if tag in BLOCK:
            self._flush()
        if tag not in VOID:
            if tag in ("h1", "main"):
                k = self._top()[0]
                while k >= 0 and not self._named_head[k]:
                    self._named_head[k], k = True, self._named_parents[k]
            self._push(tag, _part(tag, attrs, bool(self._open_tags["article"] or self._open_tags["main"])))

    def _drop_named(self) -> None:
        """Blocks in elements named as boilerplate go, but for elements that hold the page's content."""
        content = content_paths(self)
        up, mass = self._named_parents, [0] * len(self._named_parents)
        alone = [False] * (len(mass) + 1)  # whether content lies in this element, or outside all, and in no named element within it
        total = 0
        for (text, path, _), named in zip(self.blocks, self._named):
            if _is_content(self, path, content):
                total += len(text)
                alone[named] = True
                if named >= 0:
                    mass[named] += len(text)
        for k in range(len(up) - 1, -1, -1):
            if up[k] >= 0:
                mass[up[k]] += mass[k]
        kept = [False] * len(up)
        # An element that holds most of the content lies on one line from the root; outer ones come first. It stays if it has the heading, or if
        # no content that stays lies outside it.
        outside = alone[-1]
        for k in range(len(up)):
            inside = up[k] < 0 or kept[up[k]]
            if inside and 2 * mass[k] > total and (self._named_head[k] or not outside):
                kept[k] = True
                outside = outside or alone[k]
        self.blocks = [b for b, named in zip(self.blocks, self._named) if named < 0 or kept[named]]

    def _close_implied(self, tags: tuple[str, ...], stops: tuple[str, ...]) -> None:
        if not any(self._open_tags[t] for t in tags):
            return
        for i in range(len(self._stack) - 1, -1, -1):
            if self._stack[i][0] in tags:
                self._flush()
                self._cut(i)
                return
            if self._stack[i][0] in stops:
                return

    def _close(self, tag: str) -> None:
        if tag in BLOCK:
            self._flush()
        if not self._open_tags[tag]:
            return
        # An inline end tag doesn't close blocks.
        least = -1 if tag in BLOCK else self._top()[3]
        for i in range(len(self._stack) - 1, least, -1):
            if self._stack[i][0] == tag:
                self._cut(i)
                return

    def _read(self, s: str) -> None:
        at, n = 0, len(s)
        lower = None
        while at < n:
            i = s.find("<", at)
            if i < 0:
                self._buffer.append(s[at:])
                break
            if i > at:
                self._buffer.append(s[at:i])
            m = _TAG.match(s, i)
            if not m:
                if s.startswith("<!--", i):
                    j = s.find("-->", i + 4)
                    at = n if j < 0 else j + 3
                elif s.startswith(("<!", "<?"), i):
                    j = s.find(">", i)
                    at = n if j < 0 else j + 1
                elif s.startswith("</", i):
                    j = s.find(">", i)
                    at = n if j < 0 else j + 1
                else:
                    self._buffer.append("<")
                    at = i + 1
                continue
            j = s.find(">", m.end())
            if j < 0:
                break  # a tag that never ends
            attrs = s[m.end():j]
            if attrs.count('"') % 2 or attrs.count("'") % 2:
                q = _QUOTED_TAG.match(s, i)
                if q:
                    j, attrs = q.end() - 1, s[m.end():q.end() - 1]
            at, tag = j + 1, m[2].lower()
            if m[1]:
                self._close(tag)
            elif tag in RAW and not attrs.endswith("/"):
                self._flush() if tag in BLOCK else None
                lower = s.lower() if lower is None else lower
                k = (lower if len(lower) == n else s).find(f"</{tag}", at)
                k = s.find(">", k) if k >= 0 else k
                at = n if k < 0 else k + 1
            else:
                self._open(tag, attrs)
        self._flush()


def path_scores(page: Page) -> dict[int, float]:
    """Fused and smoothed ratio of each tag path: mean length, mean punctuation, and their spread over its blocks."""
    lengths, marks = defaultdict(list), defaultdict(list)
    for text, path, _ in page.blocks:
        lengths[path].append(len(text))
        marks[path].append(len(PUNCTUATION.findall(text)))
    raw = {}
    for path, ls in lengths.items():
        n, ps = len(ls), marks[path]
        mean, dots = sum(ls) / n, sum(ps) / n
        spread = math.sqrt(sum((x - mean) ** 2 for x in ls) / n)
        raw[path] = mean * (1 + dots) * (1 + math.log1p(spread)) * math.log1p(n)
    # Smoothing: a Gaussian of the distance in the tree of paths, up to 2: parent and children 1, siblings 2. Sums per parent keep it linear.
    near, far = math.exp(-1 / 2), math.exp(-2)
    children: dict[int, tuple[float, int]] = defaultdict(lambda: (0.0, 0))
    for path, x in raw.items():
        s, n = children[page.paths[path][0]]
        children[page.paths[path][0]] = s + x, n + 1
    out = {}
    for path, x in raw.items():
        parent = page.paths[path][0]
        total, weight = (x * (1 - far), 1 - far) if parent >= 0 else (x, 1)
        for (s, n), w in ((children.get(parent, (0.0, 0)) if parent >= 0 else (0.0, 0), far), ((raw[parent], 1) if parent in raw else (0.0, 0), near), (children.get(path, (0.0, 0)), near)):
            total, weight = total + w * s, weight + w * n
        out[path] = total / weight
    return out


def _is_content(page: Page, path: int, content: set[int]) -> bool:
    return path in content or page.paths[path][1] in ("h1", "p")


def content_paths(page: Page, share: float = 0.3) -> set[int]:
    """Paths whose score is at least a share of the mean over the text; all, if none is."""
    scores = path_scores(page)
    size: dict[int, int] = defaultdict(int)
    for text, path, _ in page.blocks:
        size[path] += len(text)
    mean = sum(scores[p] * size[p] for p in scores) / max(1, sum(size.values()))
    return {p for p, s in scores.items() if s >= share * mean} or set(scores)


def main_blocks(page: Page, share: float = 0.3) -> list[str]:
    """Texts of the blocks in the content container, in page order."""
    if not page.blocks:
        return []
    content = content_paths(page, share)
    mass, total = [0] * len(page.tags), 0
    holds = [False] * len(page.tags)  # whether a block lies in the element
    for text, path, element in page.blocks:
        w = len(text) * _is_content(page, path, content)
        total += w
        if element >= 0:
            mass[element] += w
            holds[element] = True
    children: dict[int, list[int]] = defaultdict(list)
    for k in range(len(page.tags) - 1, -1, -1):  # parents have smaller numbers
        up = page.parents[k]
        if holds[k]:
            children[up].append(k)
            if up >= 0:
                holds[up] = True
                mass[up] += mass[k]
    node, here = -1, total
    while here:
        best = max((c for c in reversed(children[node]) if page.tags[c] in CONTAINERS), key=mass.__getitem__, default=None)
        if best is None or mass[best] < here:
            break
        node, here = best, mass[best]
        if page.tags[node] in ("article", "main") and not any(page.tags[c] == "article" for c in children[node]):
            break
    if node < 0:
        return [t for t, _, _ in page.blocks]
    inside = [False] * len(page.tags)
    inside[node] = True
    for k in range(node + 1, len(page.tags)):
        inside[k] = page.parents[k] >= 0 and inside[page.parents[k]]
    return [t for t, _, element in page.blocks if element >= 0 and inside[element]]


def main_text(source: str | None) -> str:
    return " ".join(main_blocks(Page(source or "")))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for part in sliced(batches, 2):
            texts = [main_text(h) for h in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=schema)

    slim = pages.select(col(id_col).cast("bigint").alias("page_id"), col(url_col).alias("url"), F.coalesce(col(html_col), F.lit("")).alias("html"))
    return slim.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
