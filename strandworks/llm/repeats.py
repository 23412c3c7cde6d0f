"""Numpy kernels for repeated byte strings: rolling hashes, minimum anchors and merged Burrows-Wheeler orders."""

from __future__ import annotations

import numpy as np

#: Bytes of an anchor.
GRAM = 32
#: Bytes that are hashed at once: the arrays of a block stay in the processor's caches.
BLOCK = 1 << 17
#: Multiplier of the polynomial hash; odd and without structure.
BASE = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.uint64:
    return np.uint64(pow(BASE, n, 1 << 64))


def rolling(data: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Mixed hashes of all substrings of the given lengths (ascending); each array has len(data) - length + 1 values."""
    levels = {1: data.astype(np.uint64) + np.uint64(1)}
    n = 1
    while 2 * n <= sizes[-1]:
        h = levels[n]
        levels[2 * n] = h[: len(h) - n] * _powers(n) + h[n:]
        n *= 2
    out = []
    for size in sizes:
        count = len(data) - size + 1
        total, at = None, 0
        for n in sorted(levels, reverse=True):
            if size & n:
                part = levels[n][at : at + count]
                total = part.copy() if total is None else total * _powers(n) + part
                at += n
        out.append(mix(total))
    return out


def sliding(x: np.ndarray, width: int, fold: np.ufunc) -> np.ndarray:
    """The minimum or maximum of every window of the given width."""
    n = 1
    while 2 * n <= width:
        x = fold(x[: len(x) - n], x[n:])
        n *= 2
    return fold(x[: len(x) - (width - n)], x[width - n :]) if width > n else x


def segments(data: np.ndarray, width: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows of one text whose smallest anchor hash is the same.

    Returns for each run: its first window, its number of windows, the anchor, and whether an anchor that stands
    twice may repeat a window inside it. A window's anchor depends on the window's bytes alone, so equal windows meet
    under one anchor.
    """
    parts = []
    for at in range(0, len(data) - width + 1, BLOCK):
        block = data[at : at + BLOCK + width - 1]
        (grams,) = rolling(block, (gram,))
        least = sliding(grams, width - gram + 1, np.minimum)
        new = np.concatenate([[True], least[1:] != least[:-1]])
        first = np.nonzero(new)[0]
        length = np.diff(np.append(first, len(least)))
        anchor = least[first]
        held = sliding(np.concatenate([np.zeros(width - gram, np.uint64), least, np.zeros(width - gram, np.uint64)]), width - gram + 1, np.maximum)
        chosen = grams[grams == held]
        value, count = np.unique(chosen, return_counts=True)
        again = np.isin(anchor, value[count > 1])
        parts.append((first + at, length, anchor, again))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


#: Bytes of the runs of one shard of the transforms.
SHARD = 1 << 19


def _rank(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense ranks of the keys and how many there are."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(new) - 1
    return out, int(new.sum())


def _radix(keys: np.ndarray, most: int) -> np.ndarray:
    """A stable order of small integers by counting on 16 bits at a time."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    shift = 16
    while most >> shift:
        order = order[np.argsort((keys[order] >> shift & 0xFFFF).astype(np.uint16), kind="stable")]
        shift += 16
    return order


def suffix_order(symbol: np.ndarray, follow: np.ndarray, depth: int) -> np.ndarray:
    """The order of a shard's suffixes by their first ``depth`` symbols, by prefix doubling.

    ``symbol``: the rank of each position's symbol; ``follow``: the position of the next symbol, or -1 at the end.
    """
    rank, _ = _rank(symbol)
    h = 1
    order = np.argsort(rank, kind="stable")
    while h < depth:
        after = np.where(follow >= 0, rank[follow] + 1, 0)
        rank, n = _rank(rank * (int(rank.max()) + 2) + after)
        order = np.argsort(rank, kind="stable")
        follow = np.where(follow >= 0, follow[follow], -1)
        h *= 2
        if n == len(rank):
            break
    return order


def merge_transforms(orders: list[np.ndarray], before: list[np.ndarray], ends: list[int], symbols: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The merged order of the suffixes of all shards, and where suffixes begin to differ within ``depth`` symbols.

    ``orders``: each shard's suffix order, its ``ends[i]`` empty suffixes (one for each string) first; ``before``: by
    suffix, the symbol before it (-1 at a string's start), which in the order is the shard's transform. An interleave
    says which shard each place of the merged order comes from. A round reads the transforms through the interleave
    and deals the suffixes to the symbols before them, which sorts them by one symbol more. Where the symbol or the
    former block changes a new block begins: its common prefix with the place before is shorter than the round's
    number. Suffixes are never compared or sorted anew.

    Returns the suffixes (numbered shard after shard) by place, and which places begin a block.
    """
    base = np.concatenate([[0], np.cumsum([len(o) for o in orders])])
    total, loose = int(base[-1]), sum(ends)
    transform = np.concatenate([b[o] for o, b in zip(orders, before, strict=True)])
    kind = np.uint8 if len(orders) <= 256 else np.uint16 if len(orders) <= 65536 else np.int64
    numbers = np.arange(len(orders), dtype=kind)
    tails = np.repeat(numbers, ends)
    interleave = np.concatenate([tails, np.repeat(numbers, np.diff(base) - ends)])
    block = np.zeros(total, np.int64)  # no symbol has been read: all agree

    def places() -> np.ndarray:
        out = np.empty(total, np.int64)
        out[np.argsort(interleave, kind="stable")] = np.arange(total)
        return out

    for _ in range(depth):
        read = transform[places()]
        order = np.nonzero(read >= 0)[0]
        order = order[_radix(read[order], symbols)]
        symbol, former = read[order], block[order]
        new = np.ones(len(order), bool)
        new[1:] = (symbol[1:] != symbol[:-1]) | (former[1:] != former[:-1])
        interleave = np.concatenate([tails, interleave[order]])
        block = np.concatenate([np.arange(loose), loose - 1 + np.cumsum(new)])
    begins = np.ones(total, bool)
    begins[1:] = block[1:] != block[:-1]
    flat = np.concatenate([o + b for o, b in zip(orders, base[:-1], strict=True)])
    return flat[places()], begins


def _told_apart(data: np.ndarray, size: int, at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The ranks of the strings of ``size`` bytes at the given places, with strings of one hash but different bytes
    told apart. ``rank``: the rank of the hash at each of those places."""
    if not len(at):
        return rank
    first = np.full(int(rank.max()) + 1, -1, np.int64)
    first[rank[::-1]] = at[::-1]
    twin = first[rank]
    if size >= 8:
        words = np.lib.stride_tricks.as_strided(data[:8].view("<u8"), (len(data) - 7,), (1,))
        same = np.ones(len(at), bool)
        for j in (*range(0, size - 8, 8), size - 8):
            same &= words[at + j] == words[twin + j]
    else:
        same = np.logical_and.reduce([data[at + j] == data[twin + j] for j in range(size)])
    if same.all():
        return rank
    out, names = rank.copy(), {}
    for i in np.nonzero(np.isin(rank, rank[~same]))[0].tolist():
        out[i] = names.setdefault((int(rank[i]), data[at[i] : at[i] + size].tobytes()), len(first) + len(names))
    return out


def merged_repeats(runs: list[bytes], width: int, step: int, shard_bytes: int = SHARD) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the run, starts, ends) of the bytes covered by windows that stand more than once in the runs.

    A string of symbols is every step-th position of a run. Symbols that stand once end it: no repeated window holds
    one. The rest is dealt to shards by run.
    """
    depth = width // step
    data = np.frombuffer(b"".join(runs), np.uint8)
    if len(data) < width:
        return []
    sizes = np.fromiter(map(len, runs), np.int64, len(runs))
    first = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(runs)), sizes)
    (hashes,) = rolling(data, (step,))
    n = len(hashes)
    whole = owner[:n] == owner[step - 1 : step - 1 + n]
    rank, many = _rank(hashes)
    common = whole & (np.bincount(rank, whole, many)[rank] > 1)
    window = len(data) - width + 1
    live = owner[:window] == owner[width - 1 :]
    for j in range(depth):
        live &= common[j * step : j * step + window]
    if not live.any():
        return []
    kept = np.zeros(n, bool)
    for j in range(depth):
        kept[j * step : j * step + window] |= live
    at = np.nonzero(kept)[0]
    run = owner[at]
    at = at[np.lexsort((at, (at - first[run]) % step, run))]
    run = owner[at]
    chained = np.zeros(len(at), bool)  # the next position continues the string
    chained[:-1] = (at[1:] == at[:-1] + step) & (run[1:] == run[:-1])
    symbol, symbols = _rank(_told_apart(data, step, at, rank[at]))
    shard = first[run] // max(1, min(shard_bytes, len(data) // 2))
    cuts = np.concatenate([[0], np.nonzero(np.diff(shard))[0] + 1, [len(at)]])
    orders, before, ends, suffixes = [], [], [], []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        on = chained[a:b]
        last = np.nonzero(~on)[0]
        m = len(last)
        follow = np.where(on, np.arange(1, b - a + 1), -1)
        previous = np.full(b - a, -1, np.int64)
        previous[1:][on[:-1]] = symbol[a : b - 1][on[:-1]]
        orders.append(np.concatenate([np.arange(m), m + suffix_order(symbol[a:b], follow, depth)]))
        before.append(np.concatenate([symbol[a:b][last], previous]))
        ends.append(m)
        suffixes += [np.full(m, -1, np.int64), at[a:b]]
    order, begins = merge_transforms(orders, before, ends, symbols, depth)
    alone = begins & np.append(begins[1:], True)
    found = np.concatenate(suffixes)[order[~alone]]
    mask = np.zeros(len(data), bool)
    mask[found[found >= 0]] = True
    mask[:window] &= live
    mask[window:] = False
    starts = np.nonzero(mask & ~np.concatenate([[False], mask[:-1]]))[0]
    stops = np.nonzero(mask & ~np.concatenate([mask[1:], [False]]))[0] + width
    # a run's windows end before the next run's begin, but they may be neighbours
    split = np.nonzero(mask[1:] & mask[:-1] & (owner[1:] != owner[:-1]))[0] + 1
    starts, stops = np.sort(np.concatenate([starts, split])), np.sort(np.concatenate([stops, split - 1 + width]))
    out, of = [], owner[starts]
    for i in np.unique(of):
        mine = of == i
        out.append((int(i), starts[mine] - first[i], stops[mine] - first[i]))
    return out
