"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
PUNCTUATION = re.compile(r"[.,;:!?…。、]")

# Element names of HTML, and words that name the parts of a page.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby "
    "s samp small span strike strong sub sup time tt u var wbr".split()
)
DROPPED = set(
    "nav footer aside form script style noscript template iframe object svg button select textarea dialog menu "
    "head title option canvas audio video applet embed noframes noembed xmp datalist".split()
)
ROOTS = {"article", "main"}
ENDS_PARAGRAPH = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
SAME_LEVEL = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th")}
SAME_LEVEL |= {"th": ("td", "th"), "option": ("option",)}
PART_NAMES = set(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar aside "
    "menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr notice "
    "notices alert popup modal overlay newsletter subscribe subscription signup login social share sharing related "
    "recommended comment comments disqus discussion replies reply respond toolbar pagination pager copyright "
    "disclaimer search navigation contentinfo complementary dialog".split()
)
HEADER_NAMES = {"header", "hero"}
# Share of the text-weighted mean score that a path must reach.
THRESHOLD = 0.5
# Weight of lying in an article or main element; factor of a path that a compound name such as social-share hints at.
ROOT, HINTED = 0.5, 0.4
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
# Parts of lists and tables, which are judged by what stands beside the whole list or table.
STRUCTURE = HEADINGS | set("ul ol li dl dt dd table caption thead tbody tfoot tr td th".split())


class _Paths:
    """Paths from the root to a block, each as the number of a (parent, label) pair, so a deep one takes no more room."""

    def __init__(self) -> None:
        self.known: dict[tuple[int, str], int] = {}
        # By path: name of its last element, and the path of the element in which it,
        # or the list or table that it is part of, stands.
        self.names, self.homes = [""], [0]

    def below(self, parent: int, name: str, label: str) -> int:
        path = self.known.setdefault((parent, name + label), len(self.names))
        if path == len(self.names):
            self.names.append(name)
            self.homes.append(self.homes[parent] if self.names[parent] in STRUCTURE else parent)
        return path


class _Element:
    __slots__ = ("name", "block", "dropped", "root", "path", "link", "hinted")

    def __init__(self, name: str, attributes: str, parent: _Element | None, paths: _Paths) -> None:
        self.name, self.block = name, name not in INLINE
        dropped, label, root = name in DROPPED, "", name in ROOTS
        inside, hinted = parent is not None and parent.root, parent is not None and parent.hinted
        excused = name in ("body", "html", "main", "article")
        if attributes:
            for key, *values, hidden in ATTRIBUTE.findall(attributes):
                value = "".join(values)
                key = key.lower()
                if hidden or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
                    dropped = True
                elif key in ("class", "id", "role"):
                    words = set(re.sub(r"([a-z])([A-Z])|[-_]+", r"\1 \2", value).lower().split())
                    root = root or key == "role" and value.lower() == "main"
                    label += "." + value
                    if not excused and words & PART_NAMES | words & HEADER_NAMES:
                        dropped = dropped or words <= (PART_NAMES if inside else PART_NAMES | HEADER_NAMES)
                        hinted = hinted or bool(words & PART_NAMES)
        dropped = dropped or name == "header" and not inside
        self.dropped = dropped or parent is not None and parent.dropped
        self.hinted = hinted and name not in ROOTS
        self.root = root and not self.dropped or inside
        above = parent.path if parent else 0
        self.path = paths.below(above, name, label) if self.block and parent else above
        self.link = name == "a" or parent is not None and parent.link


def text_blocks(page: str, paths: _Paths) -> list[tuple[int, bool, bool, str, int]]:
    """Path, whether in an article, whether hinted at, text and characters in links of every block outside dropped parts.

    An element is dropped by its name, or by a class, id or role of which every
    word names a part; one that has other words beside is hinted at.
    """
    out: list[tuple[int, bool, bool, str, int]] = []
    stack = [_Element("", "", None, paths)]
    opened: dict[str, int] = {}
    buffer: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                out.append((stack[-1].path, stack[-1].root, stack[-1].hinted, text, linked))
            buffer.clear()
        linked = 0

    def say(segment: str) -> None:
        nonlocal linked
        if stack[-1].dropped:
            return
        buffer.append(html.unescape(segment) if "&" in segment else segment)
        if stack[-1].link:
            linked += len(segment)

    def close(name: str) -> None:
        while True:
            last = stack[-1]
            if last.block:
                flush()
            stack.pop()
            opened[last.name] -= 1
            if last.name == name:
                return

    at, end = 0, len(page)
    while at < end:
        token = TOKEN.search(page, at)
        if token is None:
            say(page[at:])
            break
        if token.start() > at:
            say(page[at : token.start()])
        at = token.end()
        name = (token[2] or token[5] or "").lower()
        if not name:
            continue
        if token[1] or token[4]:
            if opened.get(name):
                if name in INLINE and not any(e.name == name for e in _since_block(stack)):
                    continue
                close(name)
            elif name not in INLINE:
                flush()
            continue
        if name in ENDS_PARAGRAPH and opened.get("p") and _near(stack, ("p",), ()):
            close("p")
        for other in SAME_LEVEL.get(name, ()):
            if opened.get(other) and _near(stack, (other,), ("ul", "ol", "dl", "table", "select")):
                close(other)
        attributes = token[3] or token[6] or ""
        if name in VOID:
            if name == "br":
                say(" ")
            elif name not in INLINE:
                flush()
            continue
        if name in RAW:
            raw_end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            at = page.find(">", raw_end.end()) + 1 or end if raw_end else end
            continue
        element = _Element(name, attributes, stack[-1], paths)
        if element.block:
            flush()
        if attributes.endswith("/") and name in ("svg", "path"):
            continue
        stack.append(element)
        opened[name] = opened.get(name, 0) + 1
    flush()
    return out


def _since_block(stack: list[_Element]) -> Iterator[_Element]:
    for element in reversed(stack):
        if element.block:
            return
        yield element


def _near(stack: list[_Element], names: tuple[str, ...], walls: tuple[str, ...]) -> bool:
    """Whether one of ``names`` is open and no element of ``walls``, nor for a paragraph any other block, lies inside it."""
    for element in reversed(stack):
        if element.name in names:
            return True
        if element.name in walls or not walls and element.block:
            return False
    return False


def main_text(page: str | None) -> str:
    """Blocks of the main text, joined by line ends.

    Parts that the page itself names (menus, headers, forms, comments, ...) are
    dropped by element, class, id or role. Every path from the root to a block
    is scored by its mean text length and punctuation, by how little of it is
    links and by compound names that hint at such a part; it is smoothed with
    the best path that stands in the same element, where parts of a list or
    table and headings count as their whole. To its ratio to the page's
    text-weighted mean comes the article or main element as one more term, with
    the share of the text that it holds: a gain inside, a loss outside. Paths
    under ``THRESHOLD`` are left out.
    """
    paths = _Paths()
    blocks = text_blocks(page or "", paths)
    names, home = paths.names, paths.homes
    sums: dict[tuple[int, bool, bool], list[float]] = {}
    for path, root, hinted, text, linked in blocks:
        row = sums.setdefault((path, root, hinted), [0, 0, 0, 0])
        for i, value in enumerate((1, len(text), len(PUNCTUATION.findall(text)), min(linked, len(text)))):
            row[i] += value
    plain = {
        at: (1.0 if names[at[0]] in HEADINGS else 1 - links / max(1, chars)) * (HINTED if at[2] else 1)
        for at, (_, chars, _, links) in sums.items()
    }
    scores = {at: math.log1p(chars / n) * math.log1p(1 + signs / n) * plain[at] for at, (n, chars, signs, _) in sums.items()}
    best: dict[int, float] = {}
    for at, value in scores.items():
        best[home[at[0]]] = max(best.get(home[at[0]], 0.0), value)
    smooth = {}
    for at, value in scores.items():
        beside = best[home[at[0]]] * plain[at]
        part = names[at[0]] in STRUCTURE
        smooth[at] = max(value, beside) if part else (value + beside) / 2
    weight = sum(row[1] for row in sums.values())
    mean = sum(smooth[at] * row[1] for at, row in sums.items()) / max(1, weight)
    share = sum(row[1] for at, row in sums.items() if at[1]) / max(1, weight)
    fused = {at: smooth[at] / (mean or 1) + ROOT * share * (plain[at] if at[1] else -1) for at in sums}
    return "\n".join(text for path, root, hinted, text, _ in blocks if fused[path, root, hinted] >= THRESHOLD)


def extract(pages: DataFrame, kept: list[Column]) -> DataFrame:
    """``kept`` columns, ``text`` and ``n_chars`` of every row's ``html``; a null page has no text."""
    frame = pages.select(*kept, pages["html"].alias("_html"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column("_html")]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [*batch.schema.names[:-1], "text", "n_chars"],
            )

    schema = frame.drop("_html").schema.add("text", "string").add("n_chars", "long")
    return frame.mapInArrow(run, schema)
