"""One tile of the blocked sparse product of documents by shingles: overlap counts of the rows that a task holds."""

from __future__ import annotations

import numpy as np

PERCENT = 75


def least_of(n):
    """The least part of a set of ``n`` that any set linked with it must share: ``ceil(PERCENT * n / 100)``."""
    return -(-PERCENT * n // 100)


def least_shared(n, m):
    """The overlap from which sets of ``n`` and ``m`` link, by ``100 * both >= PERCENT * (n + m - both)``."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``starts[k], starts[k] + 1, ...``, ``sizes[k]`` of them, for every k in a row."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _counts(mark: np.ndarray, col: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many of each row's entries in the given range fall on marked columns."""
    run = np.concatenate(([0], np.cumsum(mark[col[_ranges(starts, sizes)]])))
    ends = np.cumsum(sizes)
    return run[ends] - run[ends - sizes]


def merged_parts(sets: list[np.ndarray], part: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """``part`` of each row after rows that link have become of one part, the least of those merged.

    ``sets`` are distinct hashes; rows of one part need no comparison, and of two rows at least one
    must be ``asked``.  Columns come rarest first.  A row is multiplied with those before it in the order of size that share a
    column of both prefixes; counts accumulate over the prefix's columns, rows that can no longer
    reach the least overlap fall out, and the columns behind the prefix are added for the rest.
    """
    n = np.array([len(s) for s in sets], dtype=np.int64)
    by_size = np.argsort(n, kind="stable")
    n, part, asked = n[by_size], part[by_size].copy(), asked[by_size]
    rows = len(n)
    _, col, count = np.unique(np.concatenate([sets[k] for k in by_size] or [np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
    row, often = np.repeat(np.arange(rows), n), count[col]
    held = often > 1
    order = np.lexsort((col[held], often[held], row[held]))
    row, col = row[held][order], col[held][order]
    left = np.bincount(row, minlength=rows)
    start = np.concatenate(([0], np.cumsum(left)))
    # the columns that no other row has are the rarest: they are the beginning of the prefix
    head = np.clip(left - least_of(n) + 1, 0, left)

    heads = _ranges(start[:-1], head)
    head_at = np.concatenate(([0], np.cumsum(head)))
    by_col = np.argsort(col[heads], kind="stable")
    posted, sorted_cols = row[heads][by_col], col[heads][by_col]
    place = np.empty(len(by_col), dtype=np.int64)
    place[by_col] = np.arange(len(by_col))
    first = np.searchsorted(sorted_cols, sorted_cols)[place] if len(place) else place
    lowest = np.searchsorted(n, least_of(n))
    mark, seen = np.zeros(len(count), dtype=bool), np.zeros(rows, dtype=bool)

    for x in range(rows):
        begin, end = first[head_at[x] : head_at[x + 1]], place[head_at[x] : head_at[x + 1]]
        met = posted[_ranges(begin, end - begin)]
        if not len(met):
            continue
        seen[met] = True
        seen[: lowest[x]] = False
        y = np.flatnonzero(seen[:x])
        seen[:x] = False
        y = y[(part[y] != part[x]) & (asked[x] | asked[y])]
        if not len(y):
            continue
        own = col[start[x] : start[x + 1]]
        mark[own] = True
        need = least_shared(n[x], n[y])
        both = _counts(mark, col, start[y], head[y])
        alive = both + np.minimum(left[y] - head[y], left[x]) >= need
        y, need, both = y[alive], need[alive], both[alive]
        both += _counts(mark, col, start[y] + head[y], left[y] - head[y])
        mark[own] = False
        for other in np.unique(part[y[both >= need]]):
            low, high = sorted((other, part[x]))
            part[part == high] = low
    out = np.empty_like(part)
    out[by_size] = part
    return out
