"""Main text of web pages by tag-path ratios.

A page is read as a run of text blocks, each with the path of tags from the root to it (inline
tags left out, as one block may hold many).  Text length and punctuation are summed for each path and divided by the number of its blocks; the two
ratios are fused (their product, in logarithms), spread to the blocks, smoothed along the page
with a Gaussian, averaged over each path again, and paths are cut at a share of the mean.  The chosen text
names the content node: the smallest article or main element with more than half of it, of which all blocks
are kept (and a headline before it); without one, the smallest element with most of it, of which all blocks from
the first to the last chosen one are kept.  Lists, tables and code between paragraphs so stay whole.
Paths through menus, headers (but an article's own), footers, sidebars, notices, adverts, forms, comments, scripts and
styles never count as content.  Where only a name says so (other than of comments), a part that holds most of
the page's sentences is left to the ratios.
"""

from __future__ import annotations

import html as references
import re

import numpy as np
import regex
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, texts

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?][^>]*>", re.S)
NAMED = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas", "select"}
PUNCTUATION = regex.compile(r"\p{P}")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html head legend li main menu nav ol p pre section summary table
tbody td tfoot th thead tr ul title""".split())
#: What ends only with its own end tag, or with the page.
SWALLOWS = {"script", "style", "textarea", "title"}
#: Blocks of running text, in which a button or label is a word among others.
RUNNING = ("/p", "/li", "/td", "/th", "/dd", "/dt", "/h1", "/h2", "/h3", "/h4", "/blockquote")
HEADER_NAMES = re.compile(r"\S*headers?\S*", re.I)
NOT_CONTENT = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "head", "label", "fieldset", "option"} | RAW
#: Parts of class, id and role names of what is no content.
NOISE = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed)?|promo(?:tion)?s?|banners?|cookies?|consent|"
                   r"notices?|popups?|modals?|navigation|navbar|nav|menus?|breadcrumbs?|sidebars?|side|footers?|headers?|masthead|"
                   r"comments?|replies|respond|disqus|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|"
                   r"search|pagination|pager|widgets?|toolbar|copyright|skip|complementary|contentinfo|legal|disclaimer)"
                   r"(?:$|[\s_-])", re.I)
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|replies|respond|disqus)(?:$|[\s_-])", re.I)
#: What a page or wrapper has, or does not have, is not what it is: has-sidebar, no-comments, layout-side.
MODIFIED = re.compile(r"(?:(?<=\s)|(?<=[_-])|^)(?:has|with|without|no|layout)[_-]+\S*", re.I)
SENTENCE = re.compile(r"[.!?。！？।؟]")
#: Tags whose start ends an open paragraph, and lists of tags that end their own kind.
ENDS_P = BLOCKS - {"html", "body", "head", "title"}
SAME_KIND = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"},
             "option": {"select"}}


class Open:
    """One open tag; ``named`` are the numbers of the parts around it that their names call no content, ``place`` its number on the page."""
    __slots__ = ("tag", "path", "content", "named", "place")

    def __init__(self, tag: str, path: str, content: bool, named: tuple[int, ...], place: int = 0) -> None:
        self.tag, self.path, self.content, self.named, self.place = tag, path, content, named, place

    def differs(self, other: Open) -> bool:
        return self.content != other.content or self.named != other.named


def hidden(rest: str) -> bool:
    """Whether the attributes of a tag hide it."""
    for name, *values in ATTRIBUTE.findall(rest):
        name, value = name.lower(), "".join(values).strip().lower()
        if name == "hidden" and value != "false" or name == "aria-hidden" and value == "true" or name == "style" and NO_DISPLAY.search(value):
            return True
    return False


def in_article(path: str) -> bool:
    return "/article/" in f"{path}/" or "/main/" in f"{path}/"


def kept_parts(found: list[tuple[str, str, bool, tuple[int, ...], int]], around: list[str]) -> set[int]:
    """The named parts that hold more than half of the page's text in blocks with sentences (in all, if none has).

    ``around`` has the path that each part stands in.  A part beside an article or main element with text is none of them.
    """
    rows = [(t, named) for t, _, content, named, _ in found if content]
    articles = [named for _, path, content, named, _ in found if content and in_article(path)]
    rows = [r for r in rows if SENTENCE.search(r[0])] or rows
    sizes: dict[int, int] = {}
    for t, named in rows:
        for k in named:
            sizes[k] = sizes.get(k, 0) + len(t)
    total = sum(len(t) for t, _ in rows)
    return {k for k, n in sizes.items() if 2 * n > total and (in_article(around[k]) or all(k in named for named in articles))}


def blocks(page: str) -> tuple[list[tuple[str, str, bool, int]], list[int], list[str]]:
    """Every text block in page order: text, tag path, whether it may be content, and its element.

    Elements are numbered as they open; the second list has the number of each one's parent, the third its tag.
    """
    stack = [Open("", "", True, ())]
    out: list[tuple[str, str, bool, tuple[int, ...], int]] = []
    above, tags = [0], [""]
    endless: set[str] = set()
    parts: list[str] = []
    held: list[str] = []
    owner = stack[0]
    at = 0

    def flush() -> None:
        text = " ".join("".join(held).split())
        if text:
            out.append((text, owner.path, owner.content, owner.named, owner.place))
        held.clear()

    def add(raw: str) -> None:
        nonlocal owner
        if raw:
            if not held:
                owner = stack[-1]
            held.append(references.unescape(raw) if "&" in raw else raw)

    for found in TOKEN.finditer(page):
        if found.start() < at:
            continue
        add(page[at:found.start()])
        at = found.end()
        tag = found.group(2)
        if not tag:
            continue
        tag, rest = tag.lower(), found.group(3)
        if found.group(1):
            if tag in BLOCKS:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    if tag not in BLOCKS and stack[-1].differs(stack[k - 1]):
                        flush()
                    del stack[k:]
                    break
                if stack[k].tag in ("table", "article", "main", "body") and tag not in BLOCKS:
                    break
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in BLOCKS:
            flush()
            if tag in ENDS_P:
                close(stack, "p", {"table", "td", "th", "button", "article", "div", "section", "li", "blockquote"})
            if tag in SAME_KIND:
                close(stack, tag, SAME_KIND[tag])
                if tag in ("dt", "dd"):
                    close(stack, "dd" if tag == "dt" else "dt", SAME_KIND[tag])
        if tag in VOID or rest.endswith("/") and tag not in BLOCKS and tag not in RAW:
            continue
        if tag in RAW:
            flush()
            end = None if tag in endless else re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            if end:
                at = end.end()
            elif tag in SWALLOWS:
                at = len(page)
            else:  # never closed: the page goes on
                endless.add(tag)
            continue
        top = stack[-1]
        names = " ".join(a or b or c for a, b, c in NAMED.findall(rest)) if "=" in rest and tag not in ("html", "body") else ""
        names = MODIFIED.sub("", names) if names and NOISE.search(names) else ""
        own_header = tag == "header" and "/article" in top.path
        if own_header:
            names = HEADER_NAMES.sub("", names)
        word = tag in ("button", "label") and (top.path.endswith("/p") or bool(held) and top.path.endswith(RUNNING))
        content, named = top.content and (tag not in NOT_CONTENT or own_header or word) and not (rest and hidden(rest)) and not (names and COMMENTS.search(names)), top.named
        if names and NOISE.search(names):
            named = (*named, len(parts))
            parts.append(top.path)
        new = Open(tag, f"{top.path}/{tag}" if tag in BLOCKS else top.path, content, named, len(above))
        above.append(top.place)
        tags.append(tag)
        if tag not in BLOCKS and new.differs(top):
            flush()
        stack.append(new)
    add(page[at:])
    flush()
    kept = kept_parts(out, parts) if parts else set()
    return [(t, path, content and kept.issuperset(named), place) for t, path, content, named, place in out], above, tags


def close(stack: list[Open], tag: str, bounds: set[str]) -> None:
    """Close an open ``tag`` and all inside it, unless one of ``bounds`` lies between."""
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == tag:
            del stack[k:]
            return
        if stack[k].tag in bounds:
            return


def scores(lengths: list[int], marks: list[int], paths: list[str], sigma: float) -> np.ndarray:
    """The smoothed, fused ratio of every block's path."""
    names, path = np.unique(np.array(paths, dtype=object), return_inverse=True)
    blocks_of = np.bincount(path)
    ratio = [np.bincount(path, weights=of) / blocks_of for of in (lengths, marks)]
    raw = (np.log1p(ratio[0]) * np.log1p(1 + ratio[1]))[path]
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(raw)), kernel, mode="full")[reach:reach + len(raw)]
    smooth = np.convolve(raw, kernel, mode="full")[reach:reach + len(raw)] / weight
    return (np.bincount(path, weights=smooth) / blocks_of)[path]


def content_node(sizes: list[int], places: list[int], above: list[int], tags: list[str]) -> tuple[list[bool], bool]:
    """Which elements lie in the content node, and whether it is an article or main element; ``sizes`` is chosen text."""
    sums = [0] * len(above)
    for n, k in zip(sizes, places):
        sums[k] += n
    total = sum(sizes)
    for k in range(len(above) - 1, 0, -1):
        sums[above[k]] += sums[k]
    # elements with more than half of the text contain each other, and the inner one has the larger number
    node = max((k for k in range(len(above)) if tags[k] in ("article", "main") and 2 * sums[k] > total), default=0)
    named = node > 0
    if not named:
        node = max(k for k in range(len(above)) if 5 * sums[k] >= 4 * total)
    inside = [False] * len(above)
    inside[node] = True
    for k in range(node + 1, len(above)):
        inside[k] = inside[above[k]]
    return inside, named


def main_text(page: str, sigma: float = 1.0, share: float = 0.2) -> str:
    """Blocks of the content node and of paths whose score is at least ``share`` of the mean over the page's text, one to a line."""
    found, above, tags = blocks(page)
    found = [b for b in found if b[2]]
    if not found:
        return ""
    lengths = [len(b[0]) for b in found]
    marks = [len(PUNCTUATION.findall(b[0])) for b in found]
    score = scores(lengths, marks, [b[1] for b in found], sigma)
    chosen = score >= share * float(np.average(score, weights=lengths))
    inside, named = content_node([n if c else 0 for n, c in zip(lengths, chosen)], [b[3] for b in found], above, tags)
    keep = np.array([inside[b[3]] for b in found])
    if named:
        keep |= chosen & np.array([b[1].endswith("/h1") for b in found])
    else:
        ends = np.flatnonzero(keep & chosen)
        keep[:ends[0]] = keep[ends[-1] + 1:] = False
        keep |= chosen
    return "\n".join(b[0] for b, k in zip(found, keep) if k)


def _extracted(columns: dict, sigma: float, share: float) -> dict:
    text = [main_text(p, sigma, share) for p in texts(columns["html"])]
    return {"page_id": columns["page_id"], "url": columns["url"], "text": text, "n_chars": list(map(len, text))}


def extract_text(pages: DataFrame, sigma: float = 1.0, share: float = 0.2,
                 page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row, in no shuffle.

    A null or empty page, or one without content, has an empty text; null and repeated ids are kept
    as they are; other columns are not looked at.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.col(html).cast("string").alias("html"))
    return map_batches(rows, "page_id long, url string, text string, n_chars long", _extracted, sigma, share)
