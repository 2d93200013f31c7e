"""Numpy kernel of the name similarity: bit-parallel LCS over batches of pairs.

The longest common subsequence of two strings is found with the bit-parallel
recurrence of Hyyro (2004), run on a whole batch of pairs at a time. Batches are cut by
the size of their tables, so a pair of very long names is a batch of its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

TOKEN_SHARE, PARTIAL_SHARE = 0.7, 0.3
BOOST = 1.08
WORD = 63  # pattern bits per machine word; the top bit stays free for the carry
CELLS = 1 << 21  # words of the character tables held at a time


def _codes(strings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all strings back to back, with start offsets and lengths."""
    lengths = np.fromiter((len(s) for s in strings), dtype=np.int64, count=len(strings))
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(strings) else lengths
    return flat, starts, lengths


def _lcs(pat_flat, pat_start, pat_len, txt_flat, txt_start, txt_len) -> np.ndarray:
    """LCS length of each (pattern slice, text slice) pair; all arrays are per pair."""
    n = len(pat_len)
    out = np.zeros(n, dtype=np.int64)
    if n == 0:
        return out
    alphabet, dense = np.unique(np.concatenate([pat_flat, txt_flat]), return_inverse=True)
    pat_ids, txt_ids = dense[: len(pat_flat)], dense[len(pat_flat):]
    order = np.argsort(pat_len, kind="stable")
    words = np.maximum(1, -(-pat_len[order] // WORD))
    at = 0
    while at < n:
        # As many pairs as the tables of the longest pattern among them leave room for.
        cost = words[at:] * len(alphabet) * np.arange(1, n - at + 1)
        stop = at + max(1, int(np.searchsorted(cost, CELLS, side="right")))
        part = order[at:stop]
        out[part] = _lcs_batch(pat_ids, pat_start[part], pat_len[part], txt_ids, txt_start[part],
                               txt_len[part], len(alphabet), int(words[stop - 1]))
        at = stop
    return out


def _lcs_batch(pat_ids, pat_start, pat_len, txt_ids, txt_start, txt_len, letters, words) -> np.ndarray:
    n = len(pat_len)
    rows = np.arange(n)
    one, low_bits = np.uint64(1), np.uint64((1 << WORD) - 1)
    mask = np.zeros((n, letters, words), dtype=np.uint64)
    for i in range(int(pat_len.max(initial=0))):
        live = rows[pat_len > i]
        mask[live, pat_ids[pat_start[live] + i], i // WORD] |= one << np.uint64(i % WORD)
    state = np.full((n, words), low_bits, dtype=np.uint64)
    for j in range(int(txt_len.max(initial=0))):
        live = rows[txt_len > j]
        hit = mask[live, txt_ids[txt_start[live] + j]]
        carry = np.zeros(len(live), dtype=np.uint64)
        for w in range(words):
            s = state[live, w]
            u = s & hit[:, w]
            total = s + u + carry
            carry = total >> np.uint64(WORD)
            state[live, w] = ((total & low_bits) | (s & ~hit[:, w])) & low_bits
    out = np.zeros(n, dtype=np.int64)
    for w in range(words):
        used = np.clip(pat_len - w * WORD, 0, WORD)
        inside = np.where(used > 0, low_bits >> (np.uint64(WORD) - used.astype(np.uint64)), 0)
        zero = ~state[:, w] & inside.astype(np.uint64)
        out += np.bitwise_count(zero).astype(np.int64)
    return out


def _in_slices(n: int, size: int):
    for at in range(0, n, size):
        yield slice(at, min(n, at + size))


def lcs_lengths(left: list[str], right: list[str], slice_rows: int = 2048) -> np.ndarray:
    """Length of the longest common subsequence per pair."""
    out = np.zeros(len(left), dtype=np.int64)
    for part in _in_slices(len(left), slice_rows):
        out[part] = _lcs(*_codes(left[part]), *_codes(right[part]))
    return out


def indel_ratios(left: list[str], right: list[str]) -> np.ndarray:
    """2*LCS/(la+lb) per pair; two empty strings count as equal."""
    total = np.fromiter((len(a) + len(b) for a, b in zip(left, right)), dtype=np.int64, count=len(left))
    return np.where(total > 0, 2.0 * lcs_lengths(left, right) / np.maximum(total, 1), 1.0)


def _by_length(left: list[str], right: list[str]) -> tuple[list[str], list[str]]:
    """The shorter and the longer string of each pair."""
    return ([a if len(a) <= len(b) else b for a, b in zip(left, right)],
            [b if len(a) <= len(b) else a for a, b in zip(left, right)])


def partial_ratios(left: list[str], right: list[str], slice_rows: int = 4096) -> np.ndarray:
    """Best Indel ratio of the shorter string against windows of the longer one.

    Windows have the length of the shorter string, or are shorter at either end
    of the longer one; strings of equal length are tried both ways.
    """
    short, long = _by_length(left, right)
    pair = list(range(len(short)))
    for i, (a, b) in enumerate(zip(left, right)):
        if len(a) == len(b) and a != b:
            short.append(b)
            long.append(a)
            pair.append(i)
    ls = np.fromiter((len(s) for s in short), dtype=np.int64, count=len(short))
    ll = np.fromiter((len(s) for s in long), dtype=np.int64, count=len(long))
    best = np.zeros(len(left))
    # Windows of string k end at 1 .. ll+ls-1: first growing, then sliding, then shrinking.
    windows = np.where(ls > 0, ll + ls - 1, 0)
    # Work through the pairs in slices of roughly equal numbers of windows.
    bounds = np.searchsorted(np.cumsum(windows), np.arange(slice_rows, windows.sum() + slice_rows,
                                                           slice_rows))
    begin = 0
    for end in np.unique(np.minimum(bounds + 1, len(short))):
        part = slice(begin, end)
        begin = end
        fs, ss, _ = _codes(short[part])
        fl, sl, _ = _codes(long[part])
        count = windows[part]
        owner = np.repeat(np.arange(end - part.start), count)
        if not len(owner):
            continue
        step = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + 1
        lo = np.maximum(step - ls[part][owner], 0)
        hi = np.minimum(step, ll[part][owner])
        lcs = _lcs(fs, ss[owner], ls[part][owner], fl, sl[owner] + lo, hi - lo)
        ratio = 2.0 * lcs / (ls[part][owner] + hi - lo)
        np.maximum.at(best, np.asarray(pair[part])[owner], ratio)
    for i, (a, b) in enumerate(zip(left, right)):
        if not a or not b:
            best[i] = 1.0 if a == b else 0.0
    return best


def partial_bounds(left: list[str], right: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(at least, at most) the partial ratio, at the cost of three subsequences instead of all windows.

    A window w of the longer string gives 2c / (s + w) with a common subsequence c of at most
    min(w, L), where s is the shorter length and L the common subsequence of the whole strings; this is
    never more than 2L / (s + L). The windows at both ends are tried for the lower bound.
    """
    short, long = _by_length(left, right)
    size = np.fromiter((len(s) for s in short), dtype=np.float64, count=len(short))
    whole = lcs_lengths(short, long)
    most = 2.0 * whole / np.maximum(size + whole, 1)
    head = indel_ratios(short, [b[:len(a)] for a, b in zip(short, long)])
    tail = indel_ratios(short, [b[len(b) - len(a):] for a, b in zip(short, long)])
    return np.maximum(head, tail), most


def _blend(token: np.ndarray, partial, boosted: np.ndarray) -> np.ndarray:
    value = TOKEN_SHARE * token + PARTIAL_SHARE * partial
    return np.round(np.where(boosted, np.minimum(1.0, value * BOOST), value), 3)


def name_similarities(pairs: pd.DataFrame) -> np.ndarray:
    """Blended similarity per row of (ta, tb, na, nb, boosted)."""
    token = indel_ratios(list(pairs["ta"]), list(pairs["tb"]))
    partial = partial_ratios(list(pairs["na"]), list(pairs["nb"]))
    return _blend(token, partial, pairs["boosted"].to_numpy(dtype=bool))


def names_reach(pairs: pd.DataFrame, floor: float) -> np.ndarray:
    """Whether the blended similarity of each row is ``floor`` or more.

    The partial ratio is worked out only where its bounds leave the answer open.
    """
    token = indel_ratios(list(pairs["ta"]), list(pairs["tb"]))
    boosted = pairs["boosted"].to_numpy(dtype=bool)
    out = np.zeros(len(pairs), dtype=bool)
    open_ = np.flatnonzero(_blend(token, 1.0, boosted) >= floor)
    left, right = pairs["na"].to_numpy(dtype=object), pairs["nb"].to_numpy(dtype=object)
    least, most = partial_bounds(list(left[open_]), list(right[open_]))
    out[open_] = _blend(token[open_], least, boosted[open_]) >= floor
    open_ = open_[~out[open_] & (_blend(token[open_], most, boosted[open_]) >= floor)]
    partial = partial_ratios(list(left[open_]), list(right[open_]))
    out[open_] = _blend(token[open_], partial, boosted[open_]) >= floor
    return out


def once_each(kernel, blank):
    """The kernel over columns of pairs, run once for each distinct pair; a blank name gives ``blank``."""
    def score(ta, tb, na, nb, boosted) -> pd.Series:
        pairs = pd.DataFrame({"ta": ta, "tb": tb, "na": na, "nb": nb, "boosted": boosted})
        out = np.full(len(pairs), blank)
        todo = ((pairs["na"] != "") & (pairs["nb"] != "")).to_numpy()
        if todo.any():
            work = pairs[todo]
            group = work.groupby(["na", "nb", "boosted"], sort=False).ngroup().to_numpy()
            first = ~pd.Series(group).duplicated().to_numpy()
            out[todo] = kernel(work[first].reset_index(drop=True))[group]
        return pd.Series(out)

    return score
