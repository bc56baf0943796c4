"""Greedy grouping of arrays by jump pointers, over whole Arrow batches.

Where the next group starts depends on where this one does and no more, so the
starts are what is reached from the first item by jumps. The jumps of all items
of a batch come from one binary search in prefix sums; what is reached from the
arrays' first items is found by doubling them. Nothing goes item by item.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def bounds(column: pa.Array) -> np.ndarray:
    """Where each list's items begin in ``column.flatten()``, and the end; null lists have none."""
    lengths = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def lists(values: pa.Array, begin: np.ndarray, like: pa.Array) -> pa.Array:
    """Lists of these values, null where ``like`` is."""
    mask = like.is_null() if like.null_count else None
    return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), values, mask=mask)


def reached(jump: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Flags of what is reached from ``first`` by ``jump``, where ``len(jump)`` is the end."""
    n = len(jump)
    mark, jump = np.zeros(n + 1, bool), np.append(jump, n)
    mark[first] = True
    while (jump[:n] < n).any():
        # so far all that is within 2**k - 1 jumps; these are of 2**k
        mark[jump[np.flatnonzero(mark)]] = True
        jump = jump[jump]
    return mark[:n]


def group_starts(sizes: pa.Array, limit: int, fits: bool) -> pa.Array:
    """The starts, from 0, of the groups of each list of sizes; see :func:`greedy_starts`."""
    begin, flat = bounds(sizes), sizes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    n, sums = len(flat), np.concatenate([[0], np.cumsum(flat)])
    jump = np.searchsorted(sums, sums[:-1] + limit, side="right") - 1 if fits else np.searchsorted(sums, sums[:-1] + limit, side="left")
    jump = np.minimum(np.maximum(jump, np.arange(1, n + 1)), np.repeat(begin[1:], np.diff(begin)))
    found = np.flatnonzero(reached(jump, begin[:-1][np.diff(begin) > 0]))
    row = np.searchsorted(begin, found, side="right") - 1
    counts = np.bincount(row, minlength=len(sizes))
    return lists(pa.array((found - begin[row]).astype(np.int32)), np.concatenate([[0], np.cumsum(counts)]), sizes)


def greedy_starts(sizes: Column, limit: int, fits: bool) -> Column:
    """Where groups start, from 0, in an array of sizes (none null).

    With ``fits`` a group takes items while their sum is at most ``limit``; else
    until it is at least that. Each group has one item at least.
    """

    def starts(column: pa.Array) -> pa.Array:
        return group_starts(column, limit, fits)

    return F.arrow_udf(starts, "array<int>")(sizes)


def token_windows(sums: pa.Array, target: int, overlap: int) -> pa.Array:
    """``start, end`` of the windows, in words from 0, of each list of cumulative token counts by word; see :func:`windows`."""
    begin, flat = bounds(sums), sums.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row, n = np.repeat(np.arange(len(sums)), np.diff(begin)), len(flat)
    # the lists' counts one after the other, so that one search serves all
    last = np.zeros(len(sums), np.int64)
    full = np.diff(begin) > 0
    last[full] = flat[begin[1:][full] - 1]
    before = np.concatenate([[0], np.cumsum(last)])
    ends = flat + before[row]
    starts = np.where(np.arange(n) == begin[row], before[row], np.concatenate([[0], ends[:-1]])) if n else flat
    limit = np.repeat(begin[1:], np.diff(begin))
    stop = np.minimum(np.maximum(np.searchsorted(ends, starts + target, side="right"), np.arange(1, n + 1)), limit)
    # the first word from which at most ``overlap`` tokens of the window are left
    again = np.searchsorted(starts, ends[stop - 1] - overlap, side="left") if n else stop
    jump = np.where(stop == limit, limit, np.minimum(np.maximum(again, np.arange(1, n + 1)), stop))
    # the last window ends its list, so what follows it begins the next one's first
    jump = np.where(stop == limit, n, jump)
    found = np.flatnonzero(reached(jump, begin[:-1][full]))
    of = row[found]
    counts = np.bincount(of, minlength=len(sums))
    spans = pa.StructArray.from_arrays([pa.array((found - begin[of]).astype(np.int32)), pa.array((stop[found] - begin[of]).astype(np.int32))], names=["start", "end"])
    return lists(spans, np.concatenate([[0], np.cumsum(counts)]), sums)


def windows(sums: Column, target: int, overlap: int) -> Column:
    """Windows over words, as ``start, end`` (exclusive), by their tokens: ``sums`` holds the tokens up to each word.

    A window takes words while it has at most ``target`` tokens, one word at
    least; the next begins at the first later word from which the window has at
    most ``overlap`` tokens left. The last one ends with the text.
    """

    def found(column: pa.Array) -> pa.Array:
        return token_windows(column, target, overlap)

    return F.arrow_udf(found, "array<struct<start:int,end:int>>")(sums)
