"""Local alignment: +2 for equal bases, -1 for others, -2 a gap base."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MATCH, MISMATCH, GAP = 2, -1, -2
#: Cells of the full matrix; larger alignments are banded.
FULL = 100_000_000
#: Cells of an alignment that is done side by side with others.
SIDE = 1_000_000


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.upper().encode("utf-8", "surrogatepass"), np.uint8)


def align(query: str, target: str) -> tuple[int, str, str]:
    """(score, aligned query, aligned target) of the best local alignment.

    The best cell is the first in row order; on the way back a diagonal step comes before a gap in the target
    and that before one in the query. A row is one pass: gaps along it are a running maximum.
    """
    q, t = _codes(query), _codes(target)
    m, n = len(q), len(t)
    way = np.zeros((m + 1, n + 1), np.int8)
    above, ramp = np.zeros(n + 1, np.int64), -GAP * np.arange(n + 1)
    best, at = 0, (0, 0)
    for i in range(1, m + 1):
        diagonal = above[:-1] + np.where(t == q[i - 1], MATCH, MISMATCH)
        cell = np.zeros(n + 1, np.int64)
        cell[1:] = np.maximum(0, np.maximum(diagonal, above[1:] + GAP))
        cell = np.maximum.accumulate(cell + ramp) - ramp
        row = cell[1:]
        way[i, 1:] = np.where(row == 0, 0, np.where(row == diagonal, 1, np.where(row == above[1:] + GAP, 2, 3)))
        if n and (top := int(row.max())) > best:
            best, at = top, (i, int(row.argmax()) + 1)
        above = cell
    (i, j), a, b = at, [], []
    while i and j and way[i, j]:
        step = way[i, j]
        a.append("-" if step == 3 else query[i - 1])
        b.append("-" if step == 2 else target[j - 1])
        i, j = i - (step != 3), j - (step != 2)
    return best, "".join(reversed(a)), "".join(reversed(b))


def _banded(query: str, target: str) -> float:
    """Score over twice the shorter length, in a band of cells around the diagonal; gaps lie along rows only."""
    q, t = _codes(query), _codes(target)
    m, n = len(q), len(t)
    w = max(50, min(m, n) // 10)
    above, ramp, best = np.zeros(2 * w + 1, np.int64), -GAP * np.arange(2 * w + 1), 0
    for i in range(1, m + 1):
        j = np.arange(i - w, i + w + 1)
        inside = (j >= 1) & (j <= n)
        score = np.where(t[np.clip(j - 1, 0, n - 1)] == q[i - 1], MATCH, MISMATCH)
        cell = np.where(inside, np.maximum(0, np.maximum(above + score, above + GAP)), 0)
        above = np.where(inside, np.maximum.accumulate(cell + ramp) - ramp, 0)
        best = max(best, int(above.max()))
    return min(100.0, best / (min(m, n) * MATCH) * 100)


def similarity(query: str, target: str) -> float:
    """Equal columns of the best local alignment in percent of its columns."""
    if not query or not target:
        return 0.0
    if (len(query) + 1) * (len(target) + 1) > FULL:
        return _banded(query, target)
    _, a, b = align(query, target)
    same = sum(x.upper() == y.upper() for x, y in zip(a, b, strict=True))
    return same / len(a) * 100.0 if a else 0.0


def similarities(query: str, targets: list[str]) -> list[float]:
    """``similarity`` of one query to many targets; targets of like length are aligned side by side."""
    out = [0.0] * len(targets)
    m, side = len(query), []
    for k, t in enumerate(targets):
        if m and t and (m + 1) * (len(t) + 1) <= SIDE:
            side.append(k)
        else:
            out[k] = similarity(query, t)
    side.sort(key=lambda k: len(targets[k]))
    while side:
        width = len(targets[side[-1]]) + 1
        n = max(1, SIDE * 16 // ((m + 1) * width))
        part, side = side[-n:], side[:-n]
        for k, value in zip(part, _side_by_side(query, [targets[k] for k in part]), strict=True):
            out[k] = value
    return out


def _side_by_side(query: str, targets: list[str]) -> list[float]:
    """As ``align``, a row of all alignments at a time. What fills up shorter targets equals no base, so nothing
    in it is better than what lies before it."""
    q, codes = _codes(query), [_codes(t) for t in targets]
    m, n, b = len(q), max(map(len, codes)), len(codes)
    t = np.zeros((b, n), np.uint8)
    for k, c in enumerate(codes):
        t[k, : len(c)] = c
    way = np.zeros((m + 1, b, n + 1), np.int8)
    above, ramp, rows = np.zeros((b, n + 1), np.int32), -GAP * np.arange(n + 1, dtype=np.int32), np.arange(b)
    best, at_i, at_j = np.zeros(b, np.int32), np.zeros(b, int), np.zeros(b, int)
    for i in range(1, m + 1):
        diagonal = above[:, :-1] + np.where(t == q[i - 1], np.int32(MATCH), np.int32(MISMATCH))
        up = above[:, 1:] + GAP
        cell = np.zeros((b, n + 1), np.int32)
        cell[:, 1:] = np.maximum(0, np.maximum(diagonal, up))
        cell = np.maximum.accumulate(cell + ramp, axis=1) - ramp
        row = cell[:, 1:]
        way[i, :, 1:] = np.where(row == 0, 0, np.where(row == diagonal, 1, np.where(row == up, 2, 3)))
        place = row.argmax(axis=1)
        top = row[rows, place]
        new = top > best
        best[new], at_i[new], at_j[new] = top[new], i, place[new] + 1
        above = cell
    out = []
    for k, text in enumerate(codes):
        i, j, same, total, mine = int(at_i[k]), int(at_j[k]), 0, 0, way[:, k]
        while i and j and (step := mine[i, j]):
            total += 1
            same += step == 1 and q[i - 1] == text[j - 1]
            i, j = i - (step != 3), j - (step != 2)
        out.append(float(same) / total * 100.0 if total else 0.0)
    return out


@F.pandas_udf(T.DoubleType())
def _similarity(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for queries, targets in batches:
        out = pd.Series(0.0, index=queries.index)
        for query, rows in targets.fillna("").groupby(queries.fillna("")):
            known = rows.drop_duplicates()  # equal sequences are aligned once a batch
            out[rows.index] = rows.map(dict(zip(known, similarities(query, known.tolist()), strict=True)))
        yield out


def similarity_of(query: Column, target: Column) -> Column:
    """``similarity`` of columns, in Arrow batches."""
    return _similarity(query, target)
