"""Problem 4: splitting oversized items at natural boundaries.

Method: recursive bisection. A stretch longer than the limit minus the overlap is cut at the strongest boundary near its
midpoint, or else at the boundary nearest to it, and inside a word only where the stretch has no boundary; both halves are treated
alike, and at last every piece but the first gets the overlap, the characters just before it.
Items within the limit are left out by a length filter in the JVM, so only oversized texts reach Python.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boundaries from the strongest to the weakest: blank line, line end, sentence end, clause end, space. A cut is made behind them.
BOUNDARIES = (r"\n\s*\n+", r"\n", r"[.!?؟…۔]+[\"»”)\]]*\s+", r"[،,;؛:]\s+", r"\s+")
_patterns = [re.compile(p) for p in BOUNDARIES]

PIECES = "field_name string, item_id string, piece_no int, start_char int, end_char int, overlap int, n_pieces int, piece string"


def _glued(text: str, cut: int) -> bool:
    """True if a cut here would part a sign from its letter or stand beside a joining character."""
    if not 0 < cut < len(text):
        return False
    return unicodedata.category(text[cut]) in ("Mn", "Mc", "Me", "Cf") or text[cut - 1] in "‌‍"


def cut_points(text: str, limit: int, overlap: int, near: float = 0.25) -> list[int]:
    """Starts of the pieces of ``text``, 0 first. ``near``: how far from the midpoint the strongest boundary is looked for, as a share of the length."""
    room = limit - overlap
    if limit <= 0 or overlap < 0 or room <= 0:
        raise ValueError("the overlap must be smaller than the limit")
    if len(text) <= limit:
        return [0]
    places = [[m.end() for m in p.finditer(text)] for p in _patterns]
    starts, todo = [], [(0, len(text))]
    while todo:
        a, b = todo.pop()
        # the first piece carries no overlap, so it may be as long as the limit
        if b - a <= (room if a else limit):
            starts.append(a)
            continue
        mid, reach = (a + b) / 2, max(1, int((b - a) * near))
        low, high = max(a + 1, int(mid) - reach), min(b - 1, int(mid) + reach)
        cut = 0
        for ends in places:
            i, j = bisect_left(ends, low), bisect_right(ends, high)
            if i < j:
                k = bisect_left(ends, mid, i, j)
                cut = min(ends[max(i, k - 1) : min(j, k + 1)] or [ends[i]], key=lambda e: abs(e - mid))
                break
        if not cut:  # no boundary near the midpoint: the nearest of any kind, the stronger where two are as near
            beside = []
            for ends in places:
                i, j = bisect_right(ends, a), bisect_left(ends, b)
                k = bisect_left(ends, mid, i, j)
                beside += ends[max(i, k - 1) : min(j, k + 1)]
            cut = min(beside, key=lambda e: abs(e - mid), default=0)
        if not cut:
            cut = int(mid)
            while cut > a + 1 and _glued(text, cut):
                cut -= 1
            cut = max(cut, a + 1)
        todo += [(cut, b), (a, cut)]
    return starts


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """Pieces (start, end, overlap, piece): text[start:end] is the piece's own part, ``overlap`` characters before it come first.

    Own parts joined give the text; no piece is longer than ``limit``. A text within the limit is its only piece, an empty text has one
    empty piece.
    """
    starts = cut_points(text, limit, overlap)
    out = []
    for a, b in zip(starts, [*starts[1:], len(text)]):
        lead = min(overlap, a)
        out.append((a, b, lead, text[a - lead : b]))
    return out


def oversized(items: DataFrame, limits: DataFrame) -> DataFrame:
    """Distinct (field_name, item_id, text, max_chars, overlap_chars) with more code points than the field's limit.

    ``items``: (field_name, item_id, text); other columns aren't read. ``limits`` is a fixed table of a row per field. A null text is
    never oversized; items without an id are left out; rows delivered twice count once; fields without a limit are left out.
    """
    return (
        items.select("field_name", "item_id", "text")
        .join(F.broadcast(limits.select("field_name", "max_chars", "overlap_chars")), "field_name")
        .filter((F.length("text") > F.col("max_chars")) & F.col("item_id").isNotNull())
        .dropDuplicates(["field_name", "item_id", "text"])
    )


def split_oversized(items: DataFrame, limits: DataFrame) -> DataFrame:
    """All pieces of all oversized items, columns as in PIECES. An item stored with two texts gives the pieces of both."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PIECES.split(", ")]
        for b in batches:
            rows = []
            for field, item, text, limit, overlap in zip(b.field_name, b.item_id, b.text, b.max_chars, b.overlap_chars):
                parts = split_text(text, int(limit), int(overlap))
                rows += [(field, item, k, s, e, o, len(parts), p) for k, (s, e, o, p) in enumerate(parts)]
            yield pd.DataFrame(rows, columns=names)

    return oversized(items, limits).mapInPandas(cut, PIECES)
