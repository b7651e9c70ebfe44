"""Cutting oversized records at natural boundaries, by lexical cohesion.

The vocabulary of a block before a place is compared with that of a block after it; valleys of
this similarity mark changes of topic. Within the window of places that keep a piece under the
limits, the deepest valley is cut, and the next piece starts the wanted overlap earlier.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
#: Lines on each side of a place whose words are compared.
REACH = 6
#: A piece is at least this many times as long as the overlap, so that pieces move on.
LEAST = 2


@dataclass(frozen=True)
class Limits:
    lines: int = 80
    chars: int = 4000
    overlap_lines: int = 5
    overlap_chars: int = 200


def _cosine(a: Counter, b: Counter) -> float:
    shared = sum(n * b[w] for w, n in a.items() if w in b)
    return shared / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values())) if shared else 0.0


def _cohesion(words: list[list[str]], reach: int) -> list[float]:
    """Similarity of the `reach` atoms before and after each place 1..n-1 (index 0 unused), by sliding counts."""
    n = len(words)
    out = [1.0] * n
    before, after = Counter(), Counter()
    for w in words[:reach]:
        after.update(w)
    for i in range(1, n):
        before.update(words[i - 1])
        after.subtract(words[i - 1])
        if i - 1 - reach >= 0:
            before.subtract(words[i - 1 - reach])
        if i + reach - 1 < n:
            after.update(words[i + reach - 1])
        out[i] = _cosine(+before, +after)
    return out


def _depths(cohesion: list[float]) -> list[float]:
    """How far each place lies below the nearest peaks on both sides (index 0 unused)."""
    n = len(cohesion)
    left, right = cohesion[:], cohesion[:]
    for i in range(2, n):
        if cohesion[i - 1] >= cohesion[i]:
            left[i] = left[i - 1]
    for i in range(n - 2, 0, -1):
        if cohesion[i + 1] >= cohesion[i]:
            right[i] = right[i + 1]
    return [left[i] + right[i] - 2 * cohesion[i] for i in range(n)]


def _atoms(text: str, limits: Limits) -> list[tuple[int, int]]:
    """(start, end) of the smallest parts: lines with their line feeds; of lines over half the limit, their words."""
    out = []
    at = 0
    for line in text.split("\n"):
        end = min(at + len(line) + 1, len(text))
        if end - at > limits.chars // 2:
            step = at
            for m in re.finditer(r"\s+", text[at:end]):
                if at + m.end() < end and at + m.end() - step > 40:
                    out.append((step, at + m.end()))
                    step = at + m.end()
            while end - step > limits.chars // 4:  # no white space: at places without more to tell
                out.append((step, step + limits.chars // 4))
                step += limits.chars // 4
            if end > step:
                out.append((step, end))
        elif end > at:
            out.append((at, end))
        at = end
    # Words of any length are cut as well.
    return [(i, min(i + limits.chars // 4, b)) for a, b in out for i in range(a, b, limits.chars // 4)]


def pieces(text: str, limits: Limits) -> list[tuple[int, int]]:
    """(start, end) of each piece in characters; consecutive pieces overlap; all stay within both limits.

    A text with too many lines overlaps by overlap_lines whole lines. A text with too many
    characters only, or of lines too long for that, overlaps by overlap_chars characters.
    """
    n_lines = text.count("\n") + 1
    if n_lines <= limits.lines and len(text) <= limits.chars:
        return [(0, len(text))]
    atoms = _atoms(text, limits)
    depth = _depths(_cohesion([WORD.findall(text[a:b].lower()) for a, b in atoms], REACH))
    feeds = [m.start() for m in re.finditer("\n", text)]
    ends = [b for _, b in atoms]
    out = []
    start = done = 0
    while True:
        # The furthest end that keeps both limits: a piece with k line feeds has k + 1 lines.
        fed = bisect_right(feeds, start - 1)
        most = min(len(text), start + limits.chars)
        if fed + limits.lines - 1 < len(feeds):
            most = min(most, feeds[fed + limits.lines - 1])
        if most >= len(text):
            out.append((start, len(text)))
            return out
        hi = bisect_right(ends, most) - 1
        # The whole window is searched, but for what would be hardly more than overlap.
        floor = start + LEAST * limits.overlap_chars
        if n_lines > limits.lines:
            at = fed + LEAST * limits.overlap_lines - 1
            floor = feeds[at] + 1 if at < len(feeds) and feeds[at] < most else floor
        places = range(bisect_right(ends, max(done, min(floor, most - 1))), hi + 1)
        if places:
            # Deepest valley; among equal ones a blank line, then lesser indentation after it; then the latest.
            def merit(i: int) -> tuple[bool, float, bool, int, int]:
                nxt = text[ends[i] : ends[i] + 200]
                blank = nxt.startswith(("\n", "\r\n"))
                indent = len(nxt) - len(nxt.lstrip(" \t"))
                whole = text[ends[i] - 1] == "\n"
                return (whole, round(depth[i + 1] if i + 1 < len(depth) else 0.0, 6), blank, -indent, i)

            cut = ends[max(places, key=merit)]
        else:
            cut = most
        out.append((start, cut))
        begin = cut - limits.overlap_chars
        if n_lines > limits.lines:
            # The start of the line that lies overlap_lines lines back, if the cut is at a line's end.
            k = bisect_right(feeds, cut - 1)
            back = feeds[k - 1 - limits.overlap_lines] + 1 if k - 1 - limits.overlap_lines >= 0 else 0
            if text[cut - 1] == "\n" and start < back and cut - back <= limits.chars // 2:
                begin = back
        start, done = max(begin, start + 1), cut


def split(df: DataFrame, id_col: str, text_col: str, line_col: str, limits: Limits) -> DataFrame:
    """(id, piece, pieces, start_char, end_char, start_line, end_line, content) of each row over a limit.

    Rows within both limits and null texts have no row. Lines count from line_col, from 1
    if that is null or below 1. Repeated rows are each cut; only the rows over a limit reach Python.
    """
    big = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(line_col).cast("int").alias("line"))
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    big = big.where((F.length("text") > limits.chars) | (lines > limits.lines))
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, text, line in zip(batch["id"], batch["text"], batch["line"]):
                first = int(line) if line == line and line is not None and line >= 1 else 1
                cuts = pieces(text, limits)
                feeds = [m.start() for m in re.finditer("\n", text)]
                for i, (a, b) in enumerate(cuts):
                    # The piece's last line is that of its last character.
                    out.append((key, i, len(cuts), a, b, first + bisect_right(feeds, a - 1), first + bisect_right(feeds, max(a, b - 1) - 1), text[a:b]))
            yield pd.DataFrame(out, columns=["id", "piece", "pieces", "start_char", "end_char", "start_line", "end_line", "content"])

    schema = f"id {kind}, piece int, pieces int, start_char int, end_char int, start_line int, end_line int, content string"
    return big.mapInPandas(run, schema).withColumnRenamed("id", id_col)
