"""Main-text extraction by line-block distribution.

Markup is stripped to one line a block element; elements that never hold the
article (navigation, footers, forms, scripts ...) leave empty lines. The lengths of the
lines, text of links not counted, are summed over a sliding window. A stretch of text
surges where the sum rises above a level taken from the page itself, and reaches from
there, both ways, to the dive points, where the sum falls to nothing or stays far under
the level; headings and short paragraphs beside long ones so belong to it. The stretches
of weight, and what lies between them, are the article. ``article`` and ``main`` elements
only add weight: a light stretch in the same one as a heavy stretch counts as heavy.

Words of a class, id or role, such as "sidebar", only take weight from an element's lines.
Elements round the heaviest stretch are found by that first; they are no boilerplate
whatever they are called. The other ones leave empty lines, and so does what follows
a heading such as "Comments" below the article.
"""

from __future__ import annotations

import html
import re

import numpy as np
from pyspark.sql import DataFrame

from kinelake.llm.arrow import map_column

#: Elements whose content is never article text, elements that
#: interrupt a line, void elements, and words of class, id or role that mark boilerplate.
SKIPPED = frozenset("script style noscript template title nav footer aside form button select textarea iframe object svg canvas dialog menu option".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li link main meta nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MARKS = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies disqus footer masthead menu nav navbar navigation newsletter notice popup promo related share sharing sidebar social sponsor sponsored subscribe widget".split())
CONTAINERS = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Headings of reader comments, with numbers and marks left out.
COMMENT_HEADINGS = frozenset((
    "comments", "reader comments", "user comments", "leave a comment", "leave a reply", "comment", "responses", "replies",
    "kommentare", "leserkommentare", "kommentar schreiben", "commentaires", "commentaires des lecteurs", "laisser un commentaire",
    "comentarios", "comentarios de los lectores", "deja un comentario",
))

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
MARKED = re.compile(r"(?<![^\s\"'])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

#: Lines in a window; sums under a FAR part of the level over LASTING lines are a dive, too.
WINDOW, FAR, LASTING = 3, 4, 6
#: A line counts for this many median lines at most; stretches with this part of the
#: largest one's text belong to the article too.
LONG, COMPARABLE = 4, 4
#: A line in an element with a boilerplate name counts for this part. Text of a link
#: counts as such up to so many characters (an unclosed one would take the page).
DOUBT, LINK = 8, 300
#: Skipped elements that a reader doesn't see: they leave no empty lines.
UNSEEN = frozenset("script style noscript template title option".split())


def _named(tag: str, attributes: str) -> bool:
    """Whether a word of the element's class, id or role marks boilerplate."""
    if tag in CONTAINERS or tag in ("html", "body") or not attributes:
        return False
    return any(word in MARKS for m in MARKED.findall(attributes) for word in re.split(r"[^a-z]+", "".join(m).lower()))


class Line:
    """One block's text; container: number of the outermost article or main element, 0 without; doubts: numbers
    of the open elements with boilerplate names; own: characters that count; gap: an empty line at the
    begin (1) or end (2) of the innermost doubt, or at a skipped element (3)."""

    __slots__ = ("text", "container", "doubts", "own", "gap")

    def __init__(self, text: str, container: int, doubts: tuple, own: int = 0, gap: int = 0) -> None:
        self.text, self.container, self.doubts, self.own, self.gap = text, container, doubts, own, gap


def _plain(pieces: list[str]) -> str:
    return " ".join(html.unescape("".join(pieces)).split())


def lines_of(page: str) -> tuple[list[Line], set[int]]:
    """The lines of a page, and the doubts that comment headings opened."""
    lines: list[Line] = []
    buffer: list[str] = []
    linked: list[str] = []
    depth = containers = 0  # open article and main elements; those begun so far
    skipping, nested = "", 0
    doubts: list[list] = []  # [number, tag, open elements of that tag] of open elements with boilerplate names
    numbers, comments = 0, set()
    link = -1  # characters of the open link so far
    heading = ""
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal numbers
        if not buffer:
            return
        text = _plain(buffer)
        if text:
            own = max(0, len(text) - len(_plain(linked))) if linked else len(text)
            own = own if 4 * own >= len(text) - own else 0
            if heading:
                level = int(heading[1])
                for i, (_, tag, _) in enumerate(doubts):
                    # A heading as high ends what a comment heading began.
                    if tag in HEADINGS and int(tag[1]) >= level:
                        del doubts[i:]
                        break
                name = re.sub(r"[\d().:,\-\s]+", " ", text).strip().lower()
                if name in COMMENT_HEADINGS and any(x.own for x in lines):
                    numbers += 1
                    comments.add(numbers)
                    doubts.append([numbers, heading, 1])
                    gaps(1)
            lines.append(Line(text, containers if depth else 0, tuple(x[0] for x in doubts), own))
        buffer.clear()
        linked.clear()

    def gaps(kind: int) -> None:
        lines.extend([Line("", containers if depth else 0, tuple(x[0] for x in doubts), 0, kind)] * WINDOW)

    while at < end:
        m = TOKEN.search(page, at)
        if not skipping:
            piece = page[at : m.start() if m else end]
            buffer.append(piece)
            if 0 <= link <= LINK:
                linked.append(piece)
                link += len(piece)
        if not m:
            break
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            if not skipping and m[0].startswith("<![CDATA["):
                buffer.append(html.escape(re.sub(r"\]\]>\Z", "", m[0][9:])))
            continue
        tag = tag.lower()
        alone = tag in VOID or (attributes or "").endswith("/")
        if skipping:
            # An unclosed element can't swallow the article or the end of its container.
            lost = (tag in CONTAINERS and (not closing or depth)) or (closing and tag == "body")
            if tag == skipping and not alone:
                nested += -1 if closing else 1
            if nested and not lost:
                continue
            skipping, nested = "", 0
            if not lost:
                continue
        if tag in BLOCKS:
            flush()
        if tag == "a":
            link = 0 if not closing and "href" in (attributes or "").lower() else -1
        if tag in HEADINGS:
            heading = "" if closing else tag
        if doubts and not alone:
            if tag in CONTAINERS and (not closing or depth) or closing and tag == "body":
                # Nor can an unclosed one with a boilerplate name; a comment heading lasts to its container's end.
                kept = [x for x in doubts if x[1] in HEADINGS and not closing]
                if len(kept) < len(doubts):
                    gaps(2)
                doubts[:] = kept
            else:
                for x in doubts:
                    if x[1] == tag and tag not in HEADINGS:
                        x[2] += -1 if closing else 1
                if any(not x[2] for x in doubts):
                    gaps(2)
                    doubts[:] = [x for x in doubts if x[2]]
        if closing:
            if tag in CONTAINERS and depth:
                depth -= 1
            continue
        if alone:
            continue
        if tag in SKIPPED or (tag == "header" and not depth):
            flush()
            if tag not in UNSEEN:
                gaps(3)
            skipping, nested = tag, 1
            if tag in RAW:
                close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at, skipping = (close.end() if close else end), ""
        elif _named(tag, attributes or ""):
            flush()
            numbers += 1
            doubts.append([numbers, tag, 1])
            gaps(1)
        elif tag in CONTAINERS:
            containers += depth == 0
            depth += 1
    flush()
    return lines, comments


def settled_lines(page: str) -> list[Line]:
    """The lines that may be the article's, with empty ones for elements that can't hold it.

    Doubts that the heaviest stretch lies in, by the weight that doubts leave, are cleared;
    headings of comments are not.
    """
    lines, comments = lines_of(page)
    if not any(x.own for x in lines):
        # Nothing but links: their text is all there is.
        for x in lines:
            x.own = len(x.text)
    cleared: set[int] = set()
    if any(x.doubts for x in lines):
        # Lengths keep an eighth of a character's weight.
        lengths = np.array([max(1, x.own * DOUBT // DOUBT ** min(len(x.doubts), 4)) if x.own else 0 for x in lines], dtype=np.int64)
        found = [(weight, first, last) for first, last, weight in stretches(lengths)]
        if found:
            _, first, last = max(found, key=lambda x: (x[0], -x[1]))
            whole = int(lengths[first:last].sum())
            inside: dict[int, int] = {}
            for x, length in zip(lines[first:last], lengths[first:last].tolist(), strict=True):
                for doubt in x.doubts:
                    inside[doubt] = inside.get(doubt, 0) + length
            cleared = {doubt for doubt, length in inside.items() if 2 * length >= whole} - comments
    kept = []
    for x in lines:
        left = [doubt for doubt in x.doubts if doubt not in cleared]
        # Of an element that stays in doubt, the gap at its begin is all that stays.
        if not left and x.gap in (0, 3) or x.gap == 1 and len(left) == 1 and left[0] == x.doubts[-1]:
            kept.append(x)
    return kept


def stretches(lengths: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(first line, last line + 1, weight) of the stretches between surge and dive points; weight 0 if one never surges."""
    filled = lengths[lengths > 0]
    if not len(filled):
        return []
    # No line counts for more than LONG times the median line, so that a huge one leaves the others' level.
    capped = np.minimum(lengths, int(LONG * np.median(filled)) + 1)
    sums = np.convolve(capped, np.ones(window, dtype=np.int64))  # sums[i + window - 1]: lines i to i + window - 1
    level = min(sums[sums > 0].mean(), sums.max() / 4)
    # A line is down if every window that holds it is empty or far under the level for long.
    best = np.lib.stride_tricks.sliding_window_view(sums, window).max(axis=1)
    far = best * FAR < level
    edges = np.flatnonzero(np.diff(np.concatenate(([0], far.astype(np.int8), [0]))))
    cut = {int(x) for first, last in zip(edges[::2], edges[1::2], strict=True) if last - first >= LASTING for x in (first, last)}
    empty = np.convolve(lengths > 0, np.ones(window, dtype=np.int64), mode="valid") == 0
    cut |= {int(x) for x in np.flatnonzero(empty)}
    found, start = [], 0
    for stop in sorted((cut - {0}) | {len(lengths)}):
        weight = int(capped[start:stop].sum())
        if weight:
            found.append((start, stop, weight if best[start:stop].max() >= level else 0))
        start = stop
    return found


def main_text(page: str | None) -> str:
    """The article's text; empty if the page is null, empty, or has no text outside boilerplate."""
    lines = settled_lines(page or "")
    parts = stretches(np.array([x.own for x in lines], dtype=np.int64)) if lines else []
    if not parts:
        return ""
    most = max(weight for _, _, weight in parts)
    heavy = [COMPARABLE * weight >= most for _, _, weight in parts]
    inside = [{x.container for x in lines[first:last] if x.own and x.container} for first, last, _ in parts]
    held = set().union(*[c for c, is_heavy in zip(inside, heavy, strict=True) if is_heavy])
    kept = [part for part, is_heavy, own in zip(parts, heavy, inside, strict=True) if is_heavy or own & held]
    return " ".join(x.text for x in lines[kept[0][0] : kept[-1][1]] if x.text)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """pages without html_col, with text and n_chars (code points) after the other columns.

    A null page counts as empty and has an empty text. Pages are read whole, however
    long. Repeated rows are extracted one by one; other columns pass through, null ids
    too; a column of pages that is already called text or n_chars is replaced. Of
    stretches of equal weight all stay. An empty table gives no rows.
    """
    kept = [c for c in pages.columns if c not in (html_col, text_col, "n_chars")]

    def run(values: list) -> list:
        texts = [main_text(page) for page in values]
        return [texts, [len(text) for text in texts]]

    return map_column(pages, kept, html_col, run, {text_col: "string", "n_chars": "long"})


def op10_html_extract(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages.select("page_id", "url", "html"))
