"""Main text of web pages by the distribution of text over blocks of lines.

Markup is stripped into lines: block elements begin and end lines, inline elements do
not. Elements that never hold the article (menus, forms, scripts and the like) leave no
text, and where one stood, or a container began or ended, the distribution gets a gap of empty lines. Text lengths are summed over sliding windows
of lines. Text starts where the sums surge from nothing and ends where they dive to
nothing; the stretch with the most text is the article. An advert or form amid an article
leaves a gap too, so all text of the stretch's outermost container belongs and counts to it; for
a stretch in no container it is the text in none. Lines inside
``<article>`` or ``<main>`` weigh more, so that a short article beats a long notice.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: Lines of a sliding window, and empty lines that a gap leaves: one more, so that the sums dive.
WINDOW = 3
MARKED_WEIGHT = 50

_GONE = frozenset("head script style noscript template iframe object svg canvas nav footer aside form button select textarea dialog menu audio video".split())
_INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img input".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CONTAINERS = frozenset("div section center details fieldset".split())
_RAW = frozenset("script style textarea title noscript template iframe svg".split())
_BAD_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|advertis\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|signup|login|"
    r"side-?bar|widget|nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|toolbar|footer|masthead|site-?header|page-?header|share|sharing|social|related|recommend\w*|"
    r"comments?|comment-?list|replies|respond|disqus|skip-?link)(?:$|[\s_-])",
    re.I,
)
_BAD_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPACE = re.compile(r"\s+")


def _boilerplate(name: str, attributes: str, inside: int) -> bool:
    if name in _GONE:
        return True
    if name == "header" and not inside:
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    for key, a, b, c in _NAMES.findall(attributes):
        key, value = key.lower(), a or b or c
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "role" and value.lower() in _BAD_ROLE):
            return True
        if key in ("class", "id") and _BAD_NAME.search(value):
            return True
    return False


def lines(page: str) -> list[tuple[str, bool, int]]:
    """(text, whether it stands in an article element, its outermost container or 0) of each line; gaps are runs of empty lines."""
    out: list[tuple[str, bool, int]] = []
    held: list[str] = []
    inside, skip, depth = 0, "", 0
    within: list[str] = []
    opened: Counter[str] = Counter()
    outermost = 0

    def end(gap: bool = False) -> None:
        text = _SPACE.sub(" ", html.unescape("".join(held))).strip() if held else ""
        held.clear()
        if text:
            out.append((text, inside > 0, outermost if within else 0))
        if gap:
            out.extend([("", False, 0)] * (WINDOW + 1))

    pos = 0
    while (m := _TAG.search(page, pos)) is not None:
        if not skip and m.start() > pos:
            held.append(page[pos : m.start()])
        pos = m.end()
        closing, name, attributes = m.group(1), (m.group(2) or "").lower(), m.group(3)
        if not name:
            continue
        if skip:
            if name == skip and not (attributes or "").endswith("/"):
                depth += -1 if closing else 1
                if depth == 0:
                    skip = ""
            elif name in ("article", "main") and not closing and skip not in _RAW:
                skip, depth = "", 0  # an element that was never closed does not swallow the article
            if skip:
                continue
            if name not in ("article", "main") or closing:
                continue
        if closing:
            if name in _INLINE:
                continue
            end(gap=name in ("article", "main"))
            if name in ("article", "main"):
                inside = max(0, inside - 1)
            if opened[name]:  # what was left open inside ends with it
                while (last := within.pop()) != name:
                    opened[last] -= 1
                opened[name] -= 1
            continue
        if _boilerplate(name, attributes, inside):
            end(gap=not inside)
            if name in _VOID or attributes.endswith("/"):
                continue
            if name in _RAW:  # no tags inside: straight to the end tag
                stop = re.compile(rf"</{name}\s*>", re.I).search(page, pos)
                pos = stop.end() if stop else len(page)
                continue
            skip, depth = name, 1
        elif name in _INLINE:
            if name == "br":
                held.append(" ")
        else:
            end(gap=name in ("article", "main") and not inside)
            if name in ("article", "main"):
                inside += 1
            elif name in _CONTAINERS and not attributes.endswith("/"):
                outermost += not within
                within.append(name)
                opened[name] += 1
    if not skip and pos < len(page):
        held.append(page[pos:])
    end()
    return out


def stretches(sizes: np.ndarray, window: int = WINDOW) -> list[tuple[int, int]]:
    """[start, stop) of each run of lines between a surge and a dive of the windowed sums."""
    if not len(sizes):
        return []
    total = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(len(sizes))
    sums = total[np.minimum(at + window, len(sizes))] - total[at]
    # A window that begins at an empty line already counts what follows; the text itself starts at its first line with text.
    on = np.concatenate([[0], (sums > 0).astype(np.int8), [0]])
    step = np.diff(on)
    return [(int(a), int(b)) for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True)]


def main_text(page: str | None) -> str:
    """The article of one page; empty for null, empty or textless pages."""
    own = lines(page or "")
    if not own:
        return ""
    sizes = np.array([len(t) for t, _, _ in own])
    weight = np.array([len(t) * (MARKED_WEIGHT if marked else 1) for t, marked, _ in own])
    found = stretches(sizes)
    if not found:
        return ""
    best = max(found, key=lambda x: (int(weight[x[0] : x[1]].sum()), -x[0]))
    if weight[best[0] : best[1]].sum() > sizes[best[0] : best[1]].sum():  # an article element: all of its stretches are wanted
        kept = [x for x in found if any(own[i][1] for i in range(*x))]
        return "\n".join(own[i][0] for a, b in kept for i in range(a, b) if own[i][0] and own[i][1])
    total: Counter[int] = Counter()
    for text, marked, outer in own:
        total[outer] += 0 if marked else len(text)
    around = [{own[i][2] for i in range(*x) if own[i][0]} for x in found]
    best, around = max((x for x in zip(found, around, strict=True) if not any(own[i][1] for i in range(*x[0]))), key=lambda x: (sum(total[k] for k in x[1]), -x[0][0]))
    return "\n".join(t for i, (t, marked, outer) in enumerate(own) if t and (best[0] <= i < best[1] or (outer in around and not marked)))


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row; a null or empty page has an empty text. Rows repeat as they come."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            arrays = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars"])

    return df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
