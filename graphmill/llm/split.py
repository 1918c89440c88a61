"""Splitting oversized texts at natural boundaries by dynamic programming."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Costs of cutting: after a blank line or before a line at the left margin, at another line end (plus one step per
#: level of indentation), after a separator, at white space, anywhere else. One more piece costs PIECE.
TOP, LINE, LEVEL, SEPARATOR, SPACE, ANYWHERE, PIECE, IMBALANCE = 0.0, 1.0, 0.15, 4.0, 6.0, 12.0, 2.0, 4.0

_INNER = re.compile(r"[;{},](?=\S)|\s(?=\S)")


def boundaries(text: str, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where ``text`` may be cut, ascending and without its ends, and what a cut there costs.

    All line ends; within lines longer than half a ``step`` also all separators and white space, and so many other places
    that no two neighbours are further than a quarter of a step apart.
    """
    lines = text.split("\n")
    ends = np.cumsum(np.fromiter((len(line) + 1 for line in lines), np.int64, len(lines)))
    bare = [line.lstrip() for line in lines]
    blank = np.fromiter((not line for line in bare), bool, len(lines))
    indent = np.fromiter((len(a) - len(b) for a, b in zip(lines, bare, strict=True)), np.int64, len(lines))
    unit = max(1, int(indent[(indent > 0) & ~blank].min(initial=8)))
    # A cut after line i stands before line i + 1: that line's indentation decides.
    after_blank, before = blank[:-1], indent[1:]
    costs = np.where(after_blank | ((before == 0) & ~blank[1:]), TOP, LINE) + LEVEL * np.minimum(before // unit, 12)
    closers = np.fromiter((b[:1] in ("}", ")", "]") or b[:3] == "end" for b in bare[1:]), bool, len(lines) - 1)
    costs = costs + np.where(closers, LINE, 0.0) + np.where(blank[1:], 0.3, 0.0)
    places = ends[:-1]
    if (np.diff(ends, prepend=0) > max(1, step // 2)).any():
        extra: dict[int, float] = {}
        start = 0
        for end in ends.tolist():
            end = min(end, len(text))
            if end - start > max(1, step // 2):
                extra |= {m.end(): SPACE if m.group().isspace() else SEPARATOR for m in _INNER.finditer(text, start, end)}
                for place in range(start + max(1, step // 4), end, max(1, step // 4)):
                    # Not within a letter and its combining marks or a CRLF, where that is near.
                    shifted = place
                    while shifted > max(start, place - 16) and (unicodedata.combining(text[shifted]) or text[shifted - 1 : shifted + 1] == "\r\n"):
                        shifted -= 1
                    extra.setdefault(shifted, ANYWHERE)
                    extra.setdefault(place, 2 * ANYWHERE)
            start = end
        known = dict(zip(places.tolist(), costs.tolist(), strict=True))
        merged = sorted((extra | known).items())
        places = np.array([p for p, _ in merged], np.int64)
        costs = np.array([c for _, c in merged])
    inside = (places > 0) & (places < len(text))
    return places[inside], costs[inside]


def cut(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """``(start, end)`` of the pieces of ``text``: each within ``limit`` code points, each starting ``overlap`` before the
    end of the one before. Minimises the costs of the cuts, the number of pieces and their imbalance.

    A text within the limit is one piece; an empty text has none. Raises ValueError for an overlap that leaves no room: it
    may be limit - 1 at most.
    """
    n = len(text)
    if limit < 1:
        raise ValueError("limit must be at least 1")
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    if n <= limit:
        return [(0, n)] if n else []
    step = limit - overlap
    ideal = (n - overlap) / -(-(n - overlap) // step)
    places, costs = boundaries(text, step)
    keep = places > overlap
    # The first place stands for the text's start: the first piece may be longer by the overlap, which it need not repeat.
    places = np.concatenate(([overlap], places[keep], [n]))
    costs = np.concatenate(([0.0], costs[keep], [0.0]))
    best = np.full(len(places), np.inf)
    best[0], back = 0.0, np.zeros(len(places), np.int64)
    lows = np.searchsorted(places, places - step)
    for j in range(1, len(places)):
        low = lows[j]
        off = (places[j] - places[low:j] - ideal) / step
        total = best[low:j] + IMBALANCE * off * off
        k = int(total.argmin()) if j > low else -1
        if k >= 0:
            best[j], back[j] = total[k] + costs[j] + PIECE, low + k
    ends, j = [], len(places) - 1
    while j > 0:
        ends.append(int(places[j]))
        j = int(back[j])
    ends.reverse()
    return list(zip([0, *(e - overlap for e in ends[:-1])], ends, strict=True))


def _pieces(id_column: str, texts: bool):
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text, limit, overlap in batch.itertuples(index=False, name=None):
                for number, (start, end) in enumerate(cut(text, int(limit), int(overlap)), 1):
                    rows.append((key, number, start, end, text[start:end] if texts else None))
            yield pd.DataFrame(rows, columns=[id_column, "piece_no", "start", "end", "text"])

    return split


def split_oversized(items: DataFrame, limits: DataFrame, id_column: str = "request_id", texts: bool = True) -> DataFrame:
    """``(id_column, piece_no, start, end, text)`` of every item of more code points than the limit of its kind.

    ``items`` has ``id_column``, ``kind`` and ``code``; ``limits`` has ``node_type`` (trimmed, lower case), ``max_chars``
    and ``overlap_chars``, a table of settings. Items that are null, without an id, within the limit or of a kind without a limit have no
    rows. An overlap of the limit or more is the largest possible, limit - 1; a negative or null one is 0. ``start`` and
    ``end`` count code points from 0. An item that stands twice comes out once if its content is the
    same. Without ``texts`` the column ``text`` is null. Other columns are ignored.
    """
    limits = limits.select(
        F.lower(F.trim("node_type")).alias("kind"),
        F.col("max_chars").alias("_limit"),
        F.greatest(F.lit(0), F.least(F.coalesce(F.col("overlap_chars"), F.lit(0)), F.col("max_chars") - 1)).alias("_overlap"),
    ).filter(F.col("_limit") >= 1)
    slim = items.filter(F.col(id_column).isNotNull()).select(F.col(id_column), "kind", "code")
    # The length in bytes is at least the length in code points, and is cheaper to test.
    large = slim.join(limits, "kind").filter((F.octet_length("code") > F.col("_limit")) & (F.length("code") > F.col("_limit")))
    kind = slim.schema[id_column].dataType.simpleString()
    pieces = large.select(id_column, "code", "_limit", "_overlap").mapInPandas(
        _pieces(id_column, texts), f"`{id_column}` {kind}, piece_no int, start int, end int, text string"
    )
    return pieces.dropDuplicates([id_column, "piece_no", "start", "end"])
