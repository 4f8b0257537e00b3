"""HTML main text by tag-path ratios.

A page is cut into blocks, each with its path of block-level tags from the root. Per path the text length and the punctuation of
all its blocks are added up and set against the number of blocks; the sequence of ratios is smoothed along the page, both ratios are
fused to one score, to which a path's container adds half of its own, and what tags and names say (article, nav, comment ...) is one
weight of it. The paths over the threshold are content: all their blocks are kept, however short. The element that holds most of what they
hold (an article or main, one named so, or one of a kind on the page) is then kept whole: its lists, tables, captions and code too,
but nothing that tags or names tell to be away, and lists of links only where the element is an article or main. A heading in the header of an article is the article's.

Fixed values: the tag and name lists below.

Edge cases: a null or empty html gives an empty text; a page without markup is one block and content; broken or cut-off markup is
read as far as it goes; unclosed p, li, td and the like end where the next one starts; rows are independent; an empty table gives
an empty one; only the named columns are returned.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bounded_batches, fresh_name

# Fixed values.
SKIPPED = {"script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "math", "head", "select", "button", "textarea", "video", "audio"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "br"}
AWAY = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset", "search"}
NAMES_AWAY = {"nav", "navbar", "navigation", "menu", "header", "footer", "foot", "sidebar", "aside", "ad", "ads", "advert", "adverts", "advertisement", "banner", "sponsor", "sponsored", "promo", "cookie", "cookies", "consent", "notice", "notices", "popup", "modal", "subscribe", "newsletter", "comment", "comments", "disqus", "replies", "reply", "share", "social", "related", "recommended", "breadcrumb", "breadcrumbs", "pagination", "pager", "login", "signup", "search", "form", "toolbar", "widget", "copyright", "legal", "masthead", "skip"}
ROLES_AWAY = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog"}
MAIN = {"article", "main"}
NAMES_MAIN = {"article", "content", "main", "post", "entry", "story", "body", "text"}
#: Opening the tag ends an open one of these, unless one of the second set is nearer.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>=]+|=)*+)(?:>|\Z)", re.S)
_NAMED = re.compile(r"(?:^|[\s\"'])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_WORDS = re.compile(r"[a-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
SMOOTH = (0.06, 0.24, 0.4, 0.24, 0.06)
#: A class like has-sidebar tells of a layout, not of the element.
LAYOUT = {"has", "with", "no", "without", "layout"}
HIDDEN = -3
TITLES = {"h1", "h2"}
#: What a path's score is multiplied by: away by tag or role, away by name, nothing said, main.
WEIGHT = {-2: 0.1, -1: 0.15, 0: 1.0, 1: 3.0}


def _says(tag: str, attributes: str, above: int) -> int:
    """A key of WEIGHT, or HIDDEN; above: what the parent says.

    An article or main inside something that is away counts as main, unless its own names are away; other names don't.
    """
    if above == HIDDEN:
        return HIDDEN
    away = -2 if tag in AWAY else 0
    strong = weak = tag in MAIN
    named = False
    for m in _NAMED.finditer(attributes) if attributes else ():
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return HIDDEN
        if name == "role":
            away = -2 if value in ROLES_AWAY else away
            strong = strong or value in ("main", "article")
        if name in ("class", "id"):
            for part in value.split():
                words = _WORDS.findall(part)
                named = named or not LAYOUT.intersection(words) and any(w in NAMES_AWAY for w in words)
                weak = weak or any(w in NAMES_MAIN for w in words)
    if away:
        return away
    if named and (above < 0 or tag not in ("body", "html", "article", "main")):
        return min(above, -1)
    if strong:
        return 1
    return 1 if weak and above >= 0 else above


class Paths:
    """The paths of a page as a tree: a node is a path, its parent the path without the last step."""

    def __init__(self):
        self.parent, self.depth, self.nodes = [0], [0], {}
        self.elements = Counter()  # how many elements have the path
        self.strong: set[int] = set()  # paths of article and main elements

    def below(self, node: int, step: str) -> int:
        if (node, step) not in self.nodes:
            self.nodes[node, step] = len(self.parent)
            self.parent.append(node)
            self.depth.append(self.depth[node] + 1)
        return self.nodes[node, step]

    def shared_depth(self, used: set[int]) -> int:
        """How many steps all the used paths begin with in common."""
        held = [int(n in used) for n in range(len(self.parent))]
        for n in range(len(held) - 1, 0, -1):
            held[self.parent[n]] += held[n]
        return max(d for d, h in zip(self.depth, held) if h == held[0])


def blocks(page: str) -> tuple[list[tuple[int, str, int, int, int]], Paths]:
    """(path, text, characters in links, what the path says, path of the main element around it or -1) of each block with text, in page order; and the paths."""
    out: list[tuple[int, str, int, int, int]] = []
    paths = Paths()
    stack: list[tuple[str, int, int, bool, int, bool]] = []  # (tag, path, says so far, skipped, main element, in its header)
    opened: Counter = Counter()
    parts: list[str] = []
    linked = links = 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text and not (stack and stack[-1][3]):
                out.append((stack[-1][1], text, linked, stack[-1][2], stack[-1][4]) if stack else (0, text, linked, 0, -1))
            parts.clear()
        linked = 0

    def close(at: int):
        nonlocal links
        while len(stack) > at:
            tag = stack[-1][0]
            if tag not in INLINE:
                flush()
            links -= tag == "a"
            opened[tag] -= 1
            stack.pop()

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        run = page[at : m.start() if m else n]
        if run and not (stack and stack[-1][3]):
            parts.append(run)
            linked += len(run.strip()) if links else 0
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            for i in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                if stack[i][0] == tag:
                    close(i)
                    break
            continue
        if tag in VOID:
            if tag == "br":
                parts.append(" ")
            elif tag == "hr":
                flush()
            continue
        ends, stops = CLOSES.get(tag, (set(), set()))
        if tag in ENDS_P:
            ends, stops = {"p"}, {"article", "section", "div", "td", "th", "li", "body", "blockquote", "table", "button"} - {"p"}
        if any(opened[e] for e in ends):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    close(i)
                    break
                if stack[i][0] in stops:
                    break
        if tag not in INLINE:
            flush()
        above = stack[-1] if stack else ("", 0, 0, False, -1, False)
        says = _says(tag, m[3], above[2])
        headed = above[5]
        if headed and tag in TITLES and says != HIDDEN:
            says, headed = 1, False
        elif says in (-1, -2) and above[2] == 1 and above[4] in paths.strong:
            headed = tag == "header" or "header" in m[3].lower()
        if m[3].endswith("/"):
            continue
        node = above[1]
        if tag not in INLINE:
            named = re.search(r"\bclass\s*=\s*[\"']?([^\"'>]*)", m[3]) if m[3] else None
            node = paths.below(node, f"{tag}.{named[1].strip()}" if named else tag)
            paths.elements[node] += 1
        around = above[4]
        if says == 1 and tag not in INLINE and (tag in MAIN or around < 0):
            around = node
            if tag in MAIN:
                paths.strong.add(node)
        stack.append((tag, node, says, above[3] or tag in SKIPPED, around, headed))
        opened[tag] += 1
        links += tag == "a"
        if tag in RAW:
            end = re.compile(rf"</{tag}\b", re.I).search(page, at)
            stop = end.start() if end else n
            if tag not in SKIPPED and not above[3]:
                parts.append(page[at:stop])
            at = stop
    close(0)
    flush()
    return out, paths


def _fused(blocks: int, size: int, marks: int, linked: int, smooth: float) -> float:
    ratio = (size - linked) / blocks
    return math.log1p(0.5 * ratio + 0.5 * smooth) * (1 + math.log1p(marks / blocks)) * math.log1p(size)


def content_paths(found: list[tuple[int, str, int, int, int]], tree: Paths) -> set[tuple[int, int]]:
    """The paths, each with what it says, whose fused and smoothed ratio is over the threshold."""
    paths: dict[tuple[int, int], list[float]] = {}
    for path, text, linked, says, _ in found:
        row = paths.setdefault((path, says), [0, 0, 0, 0, 0.0])
        row[0] += 1
        row[1] += len(text)
        row[2] += len(_PUNCTUATION.findall(text))
        row[3] += min(linked, len(text))
    # Smoothing: a block's ratio takes in its neighbours' along the page; a path has the mean of its blocks.
    raw = [(paths[p, says][1] - paths[p, says][3]) / paths[p, says][0] for p, _, _, says, _ in found]
    for i, (p, _, _, says, _) in enumerate(found):
        paths[p, says][4] += sum(w * raw[min(max(i + k - 2, 0), len(raw) - 1)] for k, w in enumerate(SMOOTH))
    # A container is what stands above a path and not above the whole page; a main one counts anyway. It holds all paths below it that say the same.
    shared = tree.shared_depth({p for p, _ in paths}) if paths else 0
    held = {key: list(row) for key, row in paths.items()}
    for node in range(len(tree.parent) - 1, 0, -1):
        for says in WEIGHT:
            if (node, says) in held:
                box = held.setdefault((tree.parent[node], says), [0, 0, 0, 0, 0.0])
                for i, x in enumerate(held[node, says]):
                    box[i] += x
    fused = {}
    for (node, says), r in paths.items():
        own = _fused(*r[:4], r[4] / r[0])
        if tree.depth[node] - 1 > shared or says > 0 and tree.depth[node] > 1:
            box = held[tree.parent[node], says]
            own = max(own, 0.5 * _fused(*box[:4], box[4] / box[0]))
        fused[node, says] = own * (1 - r[3] / r[1]) * WEIGHT[says]
    most = max(fused.values(), default=0.0)
    mean = sum(fused.values()) / max(len(fused), 1)
    spread = math.sqrt(sum((x - mean) ** 2 for x in fused.values()) / max(len(fused), 1))
    limit = max(0.2 * most, min(mean - 0.2 * spread, 0.35 * most))
    return {key for key, x in fused.items() if x >= limit}


def completed(found: list[tuple[int, str, int, int, int]], tree: Paths, content: set[tuple[int, int]]) -> list[bool]:
    """Which blocks stay: those of content paths, and the rest of the element that holds most of them."""
    kept = [(path, says) in content for path, _, _, says, _ in found]
    most = sum(len(text) for (_, text, *_), k in zip(found, kept, strict=True) if k) / 2
    marked, below = [0] * len(tree.parent), [0] * len(tree.parent)  # kept text of main elements, and of elements that nothing is told of
    for (path, text, _, says, around), k in zip(found, kept, strict=True):
        if k and says == 1:
            marked[around] += len(text)
        elif k and says == 0:
            below[path] += len(text)
    for n in range(len(below) - 1, 0, -1):  # a path comes after its parent
        below[tree.parent[n]] += below[n]
    main = max((n for n in tree.strong if marked[n] >= most), default=-1)
    if main < 0 and found:
        # No article: the innermost element of a kind, below what all blocks share, that holds most of the content.
        shared = tree.shared_depth({b[0] for b in found})
        alone = [n for n in range(1, len(below)) if tree.elements[n] == 1 and max(marked[n], below[n]) >= most and tree.depth[n] > max(1, shared)]
        main = max(alone, key=lambda n: tree.depth[n], default=-1)
    if main < 0:
        return kept
    strong, inside = main in tree.strong, {main}
    for n in range(main + 1, len(tree.parent)):
        if tree.parent[n] in inside:
            inside.add(n)
    says_here = {1} if strong else {0, 1}
    for i, (path, text, linked, says, around) in enumerate(found):
        own = around == main if strong else path in inside
        kept[i] = kept[i] or own and says in says_here and (strong or 2 * linked < len(text))
    return kept


def main_text(page: str | None) -> str:
    found, tree = blocks(page or "")
    found = [b for b in found if b[3] != HIDDEN]
    kept = completed(found, tree, content_paths(found, tree))
    return "\n".join(text for (_, text, *_), k in zip(found, kept, strict=True) if k)


def extract_text(df: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """The columns in keep, the main text and its length in code points."""
    bounded_batches(df.sparkSession)
    inner = fresh_name(keep, "_html")
    schema = T.StructType([*df.select(*[f"`{c}`" for c in keep]).schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(inner)]
            made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *made], names=[*keep, "text", "n_chars"])

    return df.selectExpr(*[f"`{c}`" for c in keep], f"`{html_col}` AS `{inner}`").mapInArrow(run, schema)
