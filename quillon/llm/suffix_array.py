"""The suffixes of a text in order, by the difference cover modulo 3."""

from __future__ import annotations

import numpy as np

#: Longest text: three of its symbols, or two and a rank, go into one 64-bit key.
LONGEST = 2_500_000


def _sorted(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by ``columns``, and for each row in that order whether it differs from the one before."""
    key = columns[0].astype(np.uint64)
    for c in columns[1:]:
        key = key * np.uint64(int(c.max()) + 1) + c.astype(np.uint64)
    order = np.argsort(key)
    key = key[order]
    return order, np.concatenate(([False], key[1:] != key[:-1]))


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``text`` (whole numbers from 1 on, at most its length or 256), least suffix first.

    Triples at the positions 1 and 2 modulo 3 are sorted and named by rank. Where names tie, the text of names is
    sorted by the same means; its suffixes are the sampled suffixes. The suffixes at positions 0 modulo 3 are sorted
    by their first symbol and the rank of the sampled suffix behind it, and merged in: against either kind of sampled
    suffix by the symbols up to the next place where both are sampled, and the ranks there.
    """
    n = len(text)
    if n > LONGEST:
        raise ValueError(f"texts of over {LONGEST} symbols do not fit the keys")
    if n < 2:
        return np.arange(n)
    s = np.concatenate((text, np.zeros(3, text.dtype))).astype(np.int64)
    # Where the text ends with a whole triple at 1 modulo 3, an empty one keeps the two runs of names apart.
    at = np.concatenate((np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)))
    order, new = _sorted(s[at], s[at + 1], s[at + 2])
    if not new[1:].all():
        name = np.empty(len(at), np.int64)
        name[order] = np.cumsum(new) + 1
        order = suffix_order(name)
    rank = np.zeros(n + 3, np.int64)
    rank[at[order]] = np.arange(1, len(at) + 1)
    sampled = at[order]
    sampled = sampled[sampled < n]
    rest = np.arange(0, n, 3)
    rest = rest[_sorted(s[rest], rank[rest + 1])[0]]
    above, wide = np.uint64(len(at) + 1), np.uint64(int(s.max()) + 1)
    s, rank = s.astype(np.uint64), rank.astype(np.uint64)
    one, two = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    before = np.searchsorted(s[one] * above + rank[one + 1], s[rest] * above + rank[rest + 1])
    before += np.searchsorted((s[two] * wide + s[two + 1]) * above + rank[two + 2], (s[rest] * wide + s[rest + 1]) * above + rank[rest + 2])
    out = np.empty(n, np.int64)
    place = before + np.arange(len(rest))
    out[place] = rest
    free = np.ones(n, bool)
    free[place] = False
    out[free] = sampled
    return out


def repeated_starts(cuts: list[bytes], length: int) -> np.ndarray:
    """``cut, offset`` (two rows) of the ``length``-byte strings in ``cuts`` that start at another place too.

    The cuts are laid end to end with a least symbol between, their suffixes sorted, and the first ``length`` bytes
    of neighbours compared; strings that run over the end of a cut do not count.
    """
    sizes = np.array([len(c) for c in cuts], np.int64)
    raw = np.frombuffer(b"\0".join(cuts) + bytes(9), np.uint8)
    begins = np.cumsum(sizes + 1) - sizes - 1
    n = len(raw) - 9
    whole = np.zeros(n + 1, np.int64)
    long = sizes >= length
    np.add.at(whole, begins[long], 1)
    np.add.at(whole, begins[long] + sizes[long] - length + 1, -1)
    whole = np.cumsum(whole)[:n] > 0
    symbols = raw[:n].astype(np.int64) + 2
    symbols[begins[1:] - 1] = 1
    order = suffix_order(symbols)
    order = order[whole[order]]
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, 8)).view(np.uint64).ravel()
    same = np.arange(len(order) - 1)
    for k in sorted({*range(0, length - 7, 8), length - 8}):
        same = same[words[order[same] + k] == words[order[same + 1] + k]]
    hits = np.unique(np.concatenate((order[same], order[same + 1])))
    cut = np.searchsorted(begins, hits, "right") - 1
    return np.stack((cut, hits - begins[cut]))
