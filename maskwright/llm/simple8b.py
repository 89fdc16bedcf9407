"""Word-aligned coding of token ids in 64-bit words, decoded without a loop over ids.

A word's top 4 bits are its selector, the lower 60 its payload. Selectors 1 to 14 hold 60, 30, 20,
15, 12, 10, 8, 7, 6, 5, 4, 3, 2 ids of equal width, or 120 zeros; selector 0 is the escape, one id of
more than 30 bits alone in the payload. Ids come in blocks of ``BLOCK``; a block starts on a word of
its own, and the offsets of the blocks' first words let a reader decode any block alone.
"""

from __future__ import annotations

import numpy as np

#: Fixed values of the format. By selector: ids in a word, and bits of each.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], dtype=np.int64)
WIDTHS = np.array([60, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], dtype=np.int64)
#: Selector 15 is not written.
SELECTORS = range(1, 15)
ESCAPE = 0
#: Ids in a block.
BLOCK = 1024


def bit_widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs; zero needs none."""
    high = (ids >> np.uint64(30)).astype(np.float64)
    low = (ids & np.uint64((1 << 30) - 1)).astype(np.float64)
    return np.where(high > 0, np.frexp(high)[1] + 30, np.frexp(low)[1])


def encode(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all lists one after another; where each block's words begin; blocks in each list.

    All blocks are packed at once, one word of each a step. Ids of 60 bits or more raise ValueError.
    """
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    blocks = -(-sizes // BLOCK)
    total = int(blocks.sum())
    if not total:
        return np.empty(0, np.uint64), np.empty(0, np.int64), blocks
    ids = np.concatenate([np.asarray(x, dtype=np.uint64) for x in lists])
    if int(ids.max()) >> 60:
        raise ValueError("an id has more than 60 bits")
    # every block gets BLOCK cells of its own
    start = np.repeat(np.cumsum(sizes) - sizes, blocks) + BLOCK * (np.arange(total) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    length = np.minimum(BLOCK, np.repeat(np.cumsum(sizes), blocks) - start)
    cell = np.arange(BLOCK)
    inside = cell < length[:, None]
    grid = np.zeros((total, BLOCK), dtype=np.uint64)
    grid[inside] = ids
    width = np.zeros((total, BLOCK), dtype=np.int8)
    width[inside] = bit_widths(ids)
    # for each cell, the selector that takes most ids from there on; ids past the end are zeros.
    # where no window of k ids is narrow enough, none of more ids is
    best = np.full((total, BLOCK), ESCAPE, dtype=np.int8)
    reach = {1: width}
    for s in reversed(SELECTORS):
        k = int(COUNTS[s])
        reach[k] = widest(reach, k)
        fits = reach[k] <= WIDTHS[s]
        if not fits.any():
            break
        best[fits] = s
    # one step a word, in all blocks at once
    at, open_ = np.zeros(total, dtype=np.int64), np.arange(total)
    owners, cells = [], []
    while len(open_):
        here = at[open_]
        owners.append(open_)
        cells.append(here)
        at[open_] = here + COUNTS[best[open_, here]]
        open_ = open_[at[open_] < length[open_]]
    owner, here = np.concatenate(owners), np.concatenate(cells)
    order = np.argsort(owner, kind="stable")
    owner, here = owner[order], here[order]
    chosen = best[owner, here]
    padded = np.concatenate((grid, np.zeros((total, 120), dtype=np.uint64)), axis=1).ravel()
    first = owner * (BLOCK + 120) + here
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen).tolist():
        mine = np.flatnonzero(chosen == s)
        for i in range(int(COUNTS[s]) if WIDTHS[s] else 0):
            words[mine] |= padded[first[mine] + i] << np.uint64(i * WIDTHS[s])
    per_block = np.bincount(owner, minlength=total)
    return words, np.cumsum(per_block) - per_block, blocks


def widest(reach: dict[int, np.ndarray], k: int) -> np.ndarray:
    """From each cell, the widest of k ids, of two overlapping shorter windows already known."""
    half = max(x for x in reach if x < k) if k > 1 else 1
    while half * 2 < k:
        reach[half * 2] = ahead(reach[half], half)
        half *= 2
    return ahead(reach[half], k - half) if k > half else reach[half]


def ahead(wide: np.ndarray, by: int) -> np.ndarray:
    out = wide.copy()
    np.maximum(out[:, :-by], wide[:, by:], out=out[:, :-by])
    return out


def decode_lists(words: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The ids of lists that stand one after another: their words, the first word of every block, ids in each list."""
    words, begins, sizes = (np.asarray(x, dtype=t) for x, t in ((words, np.uint64), (begins, np.int64), (sizes, np.int64)))
    n = int(sizes.sum())
    out = np.zeros(n, dtype=np.uint64)
    if n:
        selector = (words >> np.uint64(60)).astype(np.int64)
        counts = COUNTS[selector]
        # the last word of a block may stand for fewer ids
        blocks = -(-sizes // BLOCK)
        length = np.full(len(begins), BLOCK)
        length[np.cumsum(blocks)[sizes > 0] - 1] = (sizes - BLOCK * (blocks - 1))[sizes > 0]
        last = np.concatenate((begins[1:], [len(words)])) - 1
        counts[last] -= np.add.reduceat(counts, begins) - length
        position = np.cumsum(counts) - counts
        for s in np.unique(selector).tolist():
            here, bits = np.flatnonzero(selector == s), int(WIDTHS[s])
            for i in range(int(COUNTS[s]) if bits else 0):
                here = here[counts[here] > i]
                out[position[here] + i] = words[here] >> np.uint64(i * bits) & np.uint64((1 << bits) - 1)
    return np.split(out, np.cumsum(sizes)[:-1]) if len(sizes) else []


def decode(words: np.ndarray, blocks: np.ndarray, n: int) -> np.ndarray:
    """The n ids of a list from its words and the offsets of its blocks' first words."""
    return decode_lists(words, blocks, np.array([n]))[0]


def decode_block(words: np.ndarray, blocks: np.ndarray, n: int, block: int) -> np.ndarray:
    """One block alone, found by its offset."""
    end = blocks[block + 1] if block + 1 < len(blocks) else len(words)
    return decode(words[blocks[block] : end], np.array([0]), min(BLOCK, n - BLOCK * block))
