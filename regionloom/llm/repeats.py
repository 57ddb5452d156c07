"""Which windows of a text occur elsewhere: anchors that equal windows share, and exact comparison around them.

Every window of ``window`` symbols (bytes or words) picks an anchor, the k symbols in it with the
smallest hash. Equal windows pick the same anchor at the same place, so a repeated window can be
found among the occurrences of its anchor alone, and only a few of a hundred positions are anchors.
A *span* is the stretch of all windows that picked one anchor. Within one anchor's spans the parts
to the right and to the left of the anchor are sorted; two windows are equal if they agree so
many symbols to the left and so many to the right, which the common prefixes of the two orders tell.
"""

from __future__ import annotations

import numpy as np

_PLACE_BITS = 24


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, from prefix and suffix minima of blocks of w."""
    n = len(values)
    if n < w:
        return np.zeros(0, values.dtype)
    pad = -n % w
    full = np.concatenate([values, np.full(pad, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(full, axis=1).ravel()
    right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n - w + 1], left[w - 1:n])


def anchors(grams: np.ndarray, first: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places p of anchors and the first and last window start that picked each.

    ``grams`` has the hash of the k symbols from every place on; rows begin at ``first``. Windows
    that cross the end of a row are left out. A key holds a place in its lowest bits, so long texts are
    searched in stretches of 2**24 places, which overlap by a window.
    """
    none = np.zeros(0, np.int64)
    if not len(grams):
        return none, none, none
    mask = np.uint64((1 << _PLACE_BITS) - 1)
    step, found = (1 << _PLACE_BITS) - (window - k), []
    for s in range(0, max(1, len(grams) - (window - k)), step):
        part = grams[s:s + (1 << _PLACE_BITS)]
        keys = (part & ~mask) | np.arange(len(part), dtype=np.uint64)
        found.append((sliding_min(keys, window - k + 1) & mask).astype(np.int64) + s)
    picked = np.concatenate(found)
    starts = np.arange(len(picked))
    room = np.repeat(first[1:], np.diff(first))[:len(picked)]
    inside = starts + window <= room
    starts, picked = starts[inside], picked[inside]
    if not len(starts):
        return none, none, none
    cut = np.flatnonzero((np.diff(picked) != 0) | (np.diff(starts) != 1)) + 1
    lo = np.concatenate([[0], cut])
    hi = np.concatenate([cut, [len(starts)]]) - 1
    return picked[lo], starts[lo], starts[hi]


def _split(rank: np.ndarray, order: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort the rows of each rank by a column; the new order and the new ranks (start of the tie group)."""
    order = order[np.lexsort((column[order], rank[order]))]
    r, c = rank[order], column[order]
    fresh = np.concatenate([[True], (r[1:] != r[:-1]) | (c[1:] != c[:-1])])
    new = np.empty_like(rank)
    new[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    return order, new


def deep_shallow_order(words: np.ndarray, group: np.ndarray, shallow: int = 2) -> np.ndarray:
    """Order rows by (group, words): multikey quicksort to a shallow depth, then blind tries.

    The first ``shallow`` words split ties one after the other. What still ties has a long common
    prefix: such a group descends a blind trie, whose nodes know only the first word in which
    their rows differ at all, so common stretches are skipped; each round splits every open node.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    order, rank = _split(np.zeros(n, np.int64), np.arange(n), group)
    for d in range(min(shallow, words.shape[1])):
        order, rank = _split(rank, order, words[:, d])
    while True:
        # open nodes: ties of more than one row
        r = rank[order]
        size = np.bincount(r, minlength=n)
        rows = order[size[r] > 1]
        if not len(rows):
            return order
        head = order[rank[rows]]  # the first row of the node
        differs = words[rows] != words[head]
        skip = np.where(differs.any(axis=1), differs.argmax(axis=1), words.shape[1])
        node, at = np.unique(rank[rows], return_inverse=True)
        branch = np.full(len(node), words.shape[1])
        np.minimum.at(branch, at, skip)
        alive = branch[at] < words.shape[1]
        if not alive.any():
            return order
        column = np.zeros(n, words.dtype)
        column[rows[alive]] = words[rows[alive], branch[at][alive]]
        order, rank = _split(rank, order, column)


def common_prefix(words: np.ndarray, order: np.ndarray, group: np.ndarray, size: np.ndarray, per: int) -> np.ndarray:
    """Symbols that each row of the order shares with the one before (-1 at the first row of a group).

    A word holds ``per`` symbols, the first one in its highest bits.
    """
    lcp = np.full(len(order), -1, np.int64)
    for s in range(1, len(order), 65536):
        a, b = order[s - 1:s - 1 + 65536][:len(order) - s], order[s:s + 65536]
        a = a[:len(b)]
        x = words[a] ^ words[b]
        differs = x != 0
        any_ = differs.any(axis=1)
        at = np.where(any_, differs.argmax(axis=1), words.shape[1])
        got = at * per
        if per > 1:
            bits = x[np.arange(len(b)), np.minimum(at, words.shape[1] - 1)]
            lead = np.zeros(len(b), np.int64)
            for i in range(per - 1):
                lead += (bits >> np.uint64(64 - (64 // per) * (i + 1))) == 0
            got = got + np.where(any_, lead, 0)
        got = np.minimum(got, np.minimum(size[a], size[b]))
        lcp[s:s + 65536] = np.where(group[a] == group[b], got, -1)
    return lcp


def window_classes(group: np.ndarray, right: np.ndarray, right_size: np.ndarray, left: np.ndarray, left_size: np.ndarray,
                   low: np.ndarray, high: np.ndarray, window: int, per: int):
    """For every offset o: the spans that have the window starting o symbols before their anchor, and its class.

    Yields (o, spans, class numbers); equal classes mean equal windows. ``low`` and ``high`` are
    the least and greatest offset of each span's windows.
    """
    n = len(group)
    r_order, l_order = deep_shallow_order(right, group), deep_shallow_order(left, group)
    r_lcp = common_prefix(right, r_order, group, right_size, per)
    l_lcp = common_prefix(left, l_order, group, left_size, per)
    r_class, l_class = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return
    for o in range(int(low.min()), int(high.max()) + 1):
        spans = np.flatnonzero((low <= o) & (o <= high))
        if not len(spans):
            continue
        # rows of an order that share enough stand side by side
        l_class[l_order] = np.cumsum(l_lcp < o)
        r_class[r_order] = np.cumsum(r_lcp < window - o)
        yield o, spans, l_class[spans] * n + r_class[spans]


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Half-open index ranges where a flag is set."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))
