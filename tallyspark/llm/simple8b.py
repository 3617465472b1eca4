"""Simple-8b word-aligned coding of unsigned integers, vectorised.

A 64-bit word holds a selector in its top four bits and, below, as many values of one width as fit in 60 bits.
Values of 2**60 and more are escaped: selector 0 announces that the next word is one raw value. Values are
coded in blocks of ``BLOCK``; the offset of every block's first word is kept, so blocks decode on their own.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
#: (values in a word, bits of each), by selector; fixed values of the format. Selector 0 is the escape.
LAYOUTS = [(1, 64), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
COUNTS = np.array([c for c, _ in LAYOUTS], np.int64)
PAD = int(COUNTS.max())


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    if values.max(initial=0) < 1 << 52:
        return np.frexp(values.astype(np.float64))[1].astype(np.uint8)
    out = np.zeros(values.shape, np.uint8)
    for bits in range(64):
        out += values >= np.uint64(1 << bits)
    return out


def _choices(widths: np.ndarray) -> np.ndarray:
    """For each place in a padded block, the selector that takes the most values from there on."""
    spans = {1: widths}
    size = 1
    while size * 2 <= PAD:
        half = spans[size]
        spans[size * 2] = np.maximum(half[:, :-size], half[:, size:])
        size *= 2
    n = widths.shape[1] - PAD
    best = np.zeros((len(widths), n), np.uint8)
    for selector in range(len(LAYOUTS) - 1, 0, -1):
        count, bits = LAYOUTS[selector]
        size = 1 << (count.bit_length() - 1)
        fits = np.maximum(spans[size][:, :n], spans[size][:, count - size : count - size + n]) <= bits
        if fits.any():
            np.copyto(best, np.uint8(selector), where=fits)
    return best


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block) for unsigned ``values`` of any number."""
    values = np.ascontiguousarray(values, np.uint64)
    blocks = -(-len(values) // BLOCK)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    grid = np.zeros((blocks, BLOCK + PAD), np.uint64)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[: len(values)] = values
    grid[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    ends = np.full(blocks, BLOCK)
    ends[-1] = len(values) - (blocks - 1) * BLOCK
    best = _choices(_widths(grid))
    at, lanes = np.zeros(blocks, np.int64), np.arange(blocks)
    rows, places, chosen = [], [], []
    while len(lanes):
        selector = best[lanes, at]
        rows.append(lanes)
        places.append(at)
        chosen.append(selector)
        at = at + COUNTS[selector]
        more = at < ends[lanes]
        lanes, at = lanes[more], at[more]
    row, place, selector = np.concatenate(rows), np.concatenate(places), np.concatenate(chosen)
    order = np.lexsort((place, row))
    row, place, selector = row[order], place[order], selector[order]
    slots = 1 + (selector == 0)
    target = np.cumsum(slots) - slots
    words = np.zeros(int(slots.sum()), np.uint64)
    start = row * (BLOCK + PAD) + place
    cells = grid.ravel()
    for s, (count, bits) in enumerate(LAYOUTS):
        if not len(which := np.flatnonzero(selector == s)):
            continue
        if s == 0:
            words[target[which] + 1] = cells[start[which]]
            continue
        word = np.full(len(which), s << 60, np.uint64)
        if bits:
            for j in range(count):
                word |= cells[start[which] + j] << np.uint64(j * bits)
        words[target[which]] = word
    firsts = target[np.searchsorted(row, np.arange(blocks))].astype(np.uint32)
    return words, firsts


def decode(words: np.ndarray, firsts: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values again; words of each layout are unpacked together."""
    if not n:
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    # A word behind an escape is data; escapes are rare, so they are walked one by one.
    for i in np.flatnonzero(selector == 0):
        if not raw[i]:
            raw[i + 1] = True
    head = np.flatnonzero(~raw)
    selector = selector[head]
    counts = COUNTS[selector]
    block = np.searchsorted(firsts, head, side="right") - 1
    before = np.cumsum(counts) - counts
    lead = before[np.searchsorted(head, firsts)]
    start = block * (BLOCK + PAD) + before - lead[block]
    cells = np.zeros(len(firsts) * (BLOCK + PAD), np.uint64)
    for s, (count, bits) in enumerate(LAYOUTS):
        if not len(which := np.flatnonzero(selector == s)) or not bits:
            continue
        if s == 0:
            cells[start[which]] = words[head[which] + 1]
            continue
        word, mask = words[head[which]], np.uint64((1 << bits) - 1)
        for j in range(count):
            cells[start[which] + j] = (word >> np.uint64(j * bits)) & mask
    return cells.reshape(len(firsts), BLOCK + PAD)[:, :BLOCK].ravel()[:n]
