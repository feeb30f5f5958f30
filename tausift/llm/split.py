"""Cutting long texts into overlapping pieces at natural boundaries.

Balanced targets: the least number of pieces that can hold the text gives equal-length targets; every target moves to the
strongest boundary near it; where the rest no longer fits into the pieces that are left, one is added, and the text is cut
anew with equal targets for the number it took. A natural boundary is never given up to save a piece. All lengths are code
points.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Boundaries from the strongest to the weakest; a cut lies behind the match.
BOUNDARIES = (
    ("paragraph", re.compile(r"(?:\r\n|\r|\n)[^\S\r\n]*(?:\r\n|\r|\n)\s*")),
    ("line", re.compile(r"\r\n|\r|\n")),
    ("sentence", re.compile(r"[。！？।!?]+[」』）)\"'”’]*\s*|\.[)\"'”’]*\s+")),
    ("clause", re.compile(r"[、，；：,;:]\s*")),
    ("space", re.compile(r"\s+")),
)
#: Share of a piece by which a target may move for a stronger boundary.
NEAR = 0.25
_UNBROKEN = re.compile(r"[^\s　。！？!?।]+")


def longest_unbroken(text: str) -> int:
    """Length of the longest stretch without whitespace and without any of 。！？!?।"""
    return max((m.end() - m.start() for m in _UNBROKEN.finditer(text)), default=0)


def unbroken_runs(text: str) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches without whitespace and without any of 。！？!?।, in order."""
    found = [m.span() for m in _UNBROKEN.finditer(text)]
    return [a for a, _ in found], [b for _, b in found]


def _splits_a_character(text: str, at: int) -> bool:
    """Whether a cut at `at` parts a mark, a joiner or a variation from the character it belongs to."""
    return 0 < at < len(text) and (unicodedata.category(text[at]) in ("Mn", "Mc", "Me") or text[at] in "‍️" or text[at - 1] == "‍" or text[at - 1 : at + 1] == "\r\n")


def _unparted(text: str, low: int, high: int, target: int) -> int:
    """The cut in [low, high] nearest to target that parts no character, -1 if there is none."""
    for away in range(max(target - low, high - target) + 1):
        for cut in (target - away, target + away):
            if low <= cut <= high and not _splits_a_character(text, cut):
                return cut
    return -1


class _Boundaries:
    def __init__(self, text: str) -> None:
        self.text = text
        self.levels = [(name, [m.end() for m in pattern.finditer(text)]) for name, pattern in BOUNDARIES]

    def best(self, low: int, high: int, target: int) -> tuple[int, str]:
        """The strongest boundary in [low, high], the nearest to target among equals; low <= high."""
        for name, ends in self.levels:
            a, b = bisect_left(ends, low), bisect_right(ends, high)
            if a < b:
                k = bisect_left(ends, target, a, b)
                return min((ends[j] for j in (k - 1, k) if a <= j < b), key=lambda e: (abs(e - target), e)), name
        return -1, "none"

    def nearest(self, low: int, high: int, target: int) -> tuple[int, str]:
        """The boundary in [low, high] nearest to target, the strongest among equals."""
        found = []
        for level, (name, ends) in enumerate(self.levels):
            a, b = bisect_left(ends, low), bisect_right(ends, high)
            k = bisect_left(ends, target, a, b)
            found += [(abs(ends[j] - target), level, ends[j], name) for j in (k - 1, k) if a <= j < b]
        return min(found)[2:] if found else (-1, "none")


def split_points(text: str, max_size: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, boundary behind which the piece ends) of each piece of text.

    Pieces have at most max_size code points; every piece but the first starts `overlap` code points before the end of
    the one before it. A text within the limit is one piece, an empty text none. boundary is `end` for the last piece and
    `none` where no natural boundary lies between the end of the piece before and the limit; such a cut still keeps
    combining marks with their letter unless that leaves no cut at all.
    """
    if not 0 <= overlap < max_size:
        raise ValueError("overlap must be at least 0 and less than max_size")
    length = len(text)
    if not length:
        return []
    if length <= max_size:
        return [(0, length, "end")]
    marks = _Boundaries(text)
    count = _least_pieces(length, max_size, overlap)
    pieces = _place(marks, length, max_size, overlap, count)
    while len(pieces) > count:  # a limit failed: equal targets for the pieces it took
        count = len(pieces)
        pieces = _place(marks, length, max_size, overlap, count)
    return pieces


def _least_pieces(length: int, max_size: int, overlap: int) -> int:
    """The least number of pieces that hold `length` code points."""
    return 1 + max(0, -(-(length - max_size) // (max_size - overlap)))


def _place(marks: _Boundaries, length: int, max_size: int, overlap: int, count: int) -> list[tuple[int, int, str]]:
    """Pieces by equal targets for `count` pieces, more where the rest doesn't fit into those that are left."""
    pieces: list[tuple[int, int, str]] = []
    start = end = 0
    while True:
        left = max(count - len(pieces), _least_pieces(length - start, max_size, overlap))
        low, high = max(end + 1, start + overlap + 1), min(start + max_size, length - 1)
        if left == 1 or low > high:
            break
        size = (length - start + (left - 1) * overlap) / left
        target = min(max(round(start + size), low), high)
        reach = int(size * NEAR)
        cut, kind = marks.best(max(low, target - reach), min(high, target + reach), target)
        if cut < 0:
            cut, kind = marks.nearest(low, high, target)
        if cut < 0:
            cut, kind = _unparted(marks.text, low, high, target), "none"
            cut = cut if cut >= 0 else target
        pieces.append((start, cut, kind))
        start, end = cut - overlap, cut
    pieces.append((start, length, "end"))
    return pieces


PIECES = T.StructType(
    [
        T.StructField("piece_no", T.IntegerType()),
        T.StructField("n_pieces", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("boundary", T.StringType()),
        T.StructField("unbroken", T.LongType()),
        T.StructField("piece", T.StringType()),
    ]
)


def split_oversized(df: DataFrame, item: str, text: str, max_size: str, overlap: str) -> DataFrame:
    """The pieces of every text that is longer than its limit.

    max_size and overlap name columns that hold each row's own limits. One row per piece: item, max_size, piece_no from 1,
    n_pieces, start, end (code points, end exclusive), boundary, unbroken (the longest of the text's stretches without
    whitespace or sentence end that reach into the piece, at their full length), piece. Null texts, texts within their limit and rows without a limit give no row; an
    overlap that is null counts as 0. item should be unique: rows that repeat it give their pieces again. Other columns of
    df are ignored. No shuffle: each text is cut where it lies.
    """
    rows = df.select(F.col(item).alias("__item"), F.col(text).alias("__text"), F.col(max_size).cast("long").alias("__max"), F.coalesce(F.col(overlap), F.lit(0)).cast("long").alias("__over"))
    rows = rows.filter((F.length("__text") > F.col("__max")) & (F.col("__max") > 0))
    schema = T.StructType([rows.schema["__item"], rows.schema["__max"], *PIECES.fields])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            out: list[tuple] = []
            for row_item, row_text, limit, over in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pieces, (starts, ends) = split_points(row_text, limit, over), unbroken_runs(row_text)
                for k, (a, b, kind) in enumerate(pieces):
                    reach = range(bisect_right(ends, a), bisect_left(starts, b))
                    out.append((row_item, limit, k + 1, len(pieces), a, b, kind, max((ends[j] - starts[j] for j in reach), default=0), row_text[a:b]))
                if len(out) > 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    cut_rows = rows.mapInArrow(cut, schema)
    return cut_rows.withColumnsRenamed({"__item": item, "__max": "max_size"})
