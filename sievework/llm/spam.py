"""Problem 10: keyword-stuffed and link-list pages.

A page is cut into lines, and lines into items at sentence ends, bullets, bars, slashes and, in lists, commas. Every item
is reduced to a *shape*: how many words (in classes), how many of them are capitalised, whether links, tags or separators
are in it, how it ends, and whether the page repeats it. Shapes that cannot be a sentence's are junk. A page is flagged
when a few junk shapes together hold more than ``share`` of its words.

Results: null, empty and blank texts, and pages with fewer than ``min_items`` junk items, are never flagged; whole texts
are read; repeated rows are judged alike.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Shapes that may dominate a page together.
FEW = 6
#: Items of a page that hold a word which the page keeps repeating.
REPEATED = 3
_TAG = re.compile(r"<a\b[^>]*?href\s*=\s*[\"']?([^\"'>\s]+)[^>]*>(.*?)</a>", re.I | re.S)
_MARKUP = re.compile(r"<[/!]?[A-Za-z][^<>]*>")
_MARKDOWN = re.compile(r"\[([^\[\]\n]*)\]\(([^\s()]+)\)")
_URL = re.compile(r"(?:https?://|www\.)\S+", re.I)
_BULLET = re.compile(r"^\s*(?:[-*•·–>]|\d{1,3}[.)])\s+")
_BREAK = re.compile(r"\s[|/*•·»~]+\s|\s*[|•·]\s*|\s*;\s+|(?<=[.!?…])[\"'”)]*\s+")
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_END = re.compile(r"[.!?…:;][\"'”»)\]]*$")


def items(text: str) -> list[tuple[str, bool]]:
    """Items of a page with whether a link belongs to each."""
    text = _TAG.sub(lambda m: f" {m.group(2)} http://link \n", text)
    text = _MARKDOWN.sub(lambda m: f"{m.group(1)} http://link \n" if m.group(2).startswith(("http", "/", "www")) else m.group(), text)
    text = _MARKUP.sub(" ", text)
    out = []
    for line in text.split("\n"):
        line = _BULLET.sub("", line)
        if not line.strip():
            continue
        for part in _BREAK.split(line):
            part = part.strip()
            if part:
                bare = _URL.sub(" ", part)
                out.append((bare.strip(), len(bare) != len(part)))
    return out


def shape_of(item: str, words: list[str], link: bool, times: int, echoed: float = 1.0) -> tuple[tuple, int, bool]:
    """Shape, words and whether such an item can't be a sentence. ``echoed`` is the share of its words that the page keeps
    repeating, or 1 beside a link: a short item without a full stop is a label only then, not a line of a poem or a list."""
    n = len(words)
    tags = item.count("#")
    commas = item.count(",") + item.count(";")
    ended = bool(_END.search(item))
    capital = sum(w[0].isupper() for w in words)
    distinct = len({w.lower() for w in words})
    size = 0 if n == 0 else 1 if n <= 2 else 2 if n <= 4 else 3 if n <= 8 else 4 if n <= 20 else 5
    weight = n + (1 if link else 0)
    if link and n <= 10:
        kind = "link"
    elif tags >= 2 and 2 * tags >= n:
        kind = "tags"
    elif commas >= 5 and n <= 4.5 * (commas + 1):
        kind = "list"
    elif n >= 16 and distinct < 0.3 * n:
        kind = "repeating"
    elif times >= 3 and n <= 8:
        kind = "repeated"
    elif not ended and echoed >= 0.5 and (n <= 4 or (n <= 12 and capital >= 0.5 * n)):
        kind = "label"
    else:
        kind = "sentence"
    return (kind, size, capital * 4 // max(1, n), ended), weight, kind != "sentence"


def judged(text: str | None, share: float = 2 / 3, min_items: int = 4) -> tuple[float, int, bool]:
    """Share of the page's words in its few commonest junk shapes, number of junk items, flagged or not."""
    if not text or not text.strip():
        return 0.0, 0, False
    found = items(text)
    times = Counter(item.lower() for item, _ in found)
    words = [_WORD.findall(item) for item, _ in found]
    low = [{w.lower() for w in ws} for ws in words]
    often = {w for w, n in Counter(w for ws in low for w in ws).items() if n >= REPEATED}
    shapes: Counter = Counter()
    total = junk_items = 0
    for i, (item, link) in enumerate(found):
        beside = (i > 0 and found[i - 1][1]) or (i + 1 < len(found) and found[i + 1][1])
        echoed = 1.0 if beside else len(low[i] & often) / max(1, len(low[i]))
        shape, weight, junk = shape_of(item, words[i], link, times[item.lower()], echoed)
        total += weight
        if junk:
            shapes[shape] += weight
            junk_items += item.count("#") + item.count(",") + item.count(";") + 1 if shape[0] in ("tags", "list") else weight // 2 if shape[0] == "repeating" else 1
    if not total:
        return 0.0, junk_items, False
    part = sum(w for _, w in shapes.most_common(FEW)) / total
    return part, junk_items, part > share and junk_items >= min_items


def stuffed(df: DataFrame, key: str, text: str, share: float = 2 / 3, min_items: int = 4) -> DataFrame:
    """(key, junk_share, junk_items, spam) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judged(t, share, min_items) for t in batch.column(1).to_pylist()]
            kinds = [pa.float64(), pa.int32(), pa.bool_()]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [key, "junk_share", "junk_items", "spam"])

    return df.select(key, text).mapInArrow(run, f"`{key}` long, junk_share double, junk_items int, spam boolean")
