"""Vectorised text kernels: every function takes a whole Arrow batch and works on its bytes with NumPy.

A *word* of a shingle is a maximal run of ASCII letters, digits, underscores or non-ASCII characters of the
lower-cased text; everything else separates words. A *field* is a maximal run of anything but the six ASCII
blanks. Words, lines and shingles are 64-bit hashes; documents are 128-bit keys. Null texts read as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
BLOCK = 1 << 18
SHINGLE = 5

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = [np.uint64(x) for x in (0xD1342543DE82EF95, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(seed: int) -> np.uint64:
    return mix(np.array([seed + 1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0]


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _P)
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, *range(9, 14)]] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True


def chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about CHUNK_BYTES; a longer text stands alone."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > CHUNK_BYTES:
            yield at, i
            at, held = i, 0
        held += int(n)
    if at < len(sizes):
        yield at, len(sizes)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts and the offset of each, with the end."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or off[-1] == off[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]], off - off[0]


def per_row(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many marked bytes each text has."""
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def _sums(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes between starts and ends."""
    n = len(data)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _POWER(n), out=total[1:])
    # the hash of a run doesn't depend on its place: divide by the power of its start
    return mix((total[end] - total[start]) * _BACK(n)[start] + (end - start).astype(np.uint64))


class _Powers:
    """The first powers of a number, made once for a block and anew for longer runs."""

    def __init__(self, of: np.uint64) -> None:
        self.of, self.made = of, np.zeros(0, dtype=np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        if n <= len(self.made):
            return self.made[:n]
        out = np.full(max(n, 1), self.of, dtype=np.uint64)
        out[0] = 1
        np.cumprod(out, out=out)
        if n <= 2 * BLOCK:
            self.made = out
        return out


_POWER, _BACK = _Powers(_P), _Powers(_P_INV)


class Runs:
    """Runs of marked bytes, cut at the ends of texts: their hashes, places, and ``at``, the offset of each text's."""

    def __init__(self, data: np.ndarray, off: np.ndarray, mask: np.ndarray) -> None:
        n = len(data)
        edge = np.zeros(n + 1, dtype=bool)
        edge[off] = True
        before = np.concatenate([[False], mask[:-1]]) if n else mask
        after = np.concatenate([mask[1:], [False]]) if n else mask
        self.start = np.flatnonzero(mask & (~before | edge[:n]))
        self.end = np.flatnonzero(mask & (~after | edge[1:])) + 1
        self.at = np.searchsorted(self.start, off)
        self.hash = np.zeros(len(self.start), dtype=np.uint64)
        # in blocks, so that a long text needs little memory; a run of over BLOCK bytes is a block of its own
        i = 0
        while i < len(self.start):
            base = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, base + BLOCK, side="right")))
            self.hash[i:j] = _sums(data[base : self.end[j - 1]], self.start[i:j] - base, self.end[i:j] - base)
            i = j

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))


def words(texts: pa.Array) -> Runs:
    data, off = raw(pc.utf8_lower(texts))
    return Runs(data, off, _WORD[data])


def windows(hashes: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of each window of ``width`` runs that lies in one text."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    total = hashes[:n] * _STEP[0]
    for k in range(1, width):
        total = mix(total) + hashes[k : n + k] * _STEP[k % len(_STEP)]
    last = np.repeat(at[1:], np.diff(at))[:n]
    keep = np.arange(n) + width <= last
    return mix(total[keep]), np.flatnonzero(keep)


def shingles(texts: pa.Array, short: bool = True) -> tuple[np.ndarray, np.ndarray, Runs]:
    """Five-word shingles of each text, repeats included: hashes in text order, offset of each text's, and the words.

    ``short``: a text of one to four words has one shingle, its whole sequence of words; else it has none.
    """
    w = words(texts)
    count = np.diff(w.at)
    full, place = windows(w.hash, w.at, SHINGLE)
    row = np.searchsorted(w.at, place, side="right") - 1
    if short and (few := np.flatnonzero((count > 0) & (count < SHINGLE))).size:
        whole = np.zeros(len(few), dtype=np.uint64)
        for k in range(SHINGLE - 1):
            i = w.at[few] + k
            inside = k < count[few]
            whole = np.where(inside, mix(whole) + w.hash[np.minimum(i, len(w.hash) - 1)] * _STEP[k], whole)
        row = np.concatenate([row, few])
        full = np.concatenate([full, mix(whole + count[few].astype(np.uint64))])
        order = np.argsort(row, kind="stable")
        row, full = row[order], full[order]
    return full, np.searchsorted(row, np.arange(len(count) + 1)), w


def sequence_keys(w: Runs) -> np.ndarray:
    """128-bit key of each text's sequence of words, as two columns; zeros for a text without words."""
    rows = len(w.at) - 1
    out = np.zeros((rows, 2), dtype=np.uint64)
    if len(w.hash):
        place = (np.arange(len(w.hash)) - np.repeat(w.at[:-1], np.diff(w.at))).astype(np.uint64)
        has = np.flatnonzero(np.diff(w.at))
        for k in range(2):
            part = mix(w.hash * _STEP[k] + mix(place * _STEP[k + 2] + np.uint64(k + 1)))
            out[has, k] = mix(np.add.reduceat(part, w.at[has]))
    return out


def repeated(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of values with their rows: which occur twice or more in their row, and which equal an earlier one."""
    n = len(hashes)
    if not n:
        return np.zeros(0, dtype=bool), np.zeros(0, dtype=bool)
    key = hashes ^ mix((row.astype(np.uint64) + np.uint64(1)) * _P)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    later, twice = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    later[order[1:]] = same
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return twice, later


def multisets(full: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, with their counts, and the offset of each text's."""
    rows = len(at) - 1
    row = np.repeat(np.arange(rows), np.diff(at))
    order = np.lexsort((full, row))
    full, row = full[order], row[order]
    new = np.ones(len(full), dtype=bool)
    new[1:] = (full[1:] != full[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(full)))
    return full[first], count, np.searchsorted(row[first], np.arange(rows + 1))


def poisson_signatures(value: np.ndarray, weight: np.ndarray, at: np.ndarray, size: int, seed: int = 7) -> np.ndarray:
    """BagMinHash signatures of multisets, ``size`` registers each; a register is zero for an empty multiset.

    Each value has a Poisson process over (time, weight level). Its levels are split in halves by powers of two:
    [0, 1), [1, 2), [2, 4), [4, 8) and so on, each with a process of its own whose rate is its length; an arrival in
    a block that the weight cuts goes to the left or right half by the bits of its hash, again and again, until its
    level is known, and counts only below the weight. Arrivals fall on the registers at random, and a register keeps
    the first, so two registers agree with the probability of the weighted Jaccard similarity. Arrivals are made in
    order of time and only up to a limit that doubles until each register has one: about size * ln(size) arrivals a
    document however long it is, besides the first of each value.
    """
    rows = len(at) - 1
    out = np.zeros((rows, size), dtype=np.uint64)
    total = np.zeros(rows)
    has = np.flatnonzero(np.diff(at))
    if not has.size:
        return out
    total[has] = np.add.reduceat(weight.astype(np.float64), at[has])
    row = np.repeat(np.arange(rows), np.diff(at))
    # one entry for each value and block of levels: block 0 is [0, 1), block j is [2^(j-1), 2^j), the last may be cut
    power = np.floor(np.log2(weight.astype(np.float64))).astype(np.int64)
    blocks = power + 1 + (weight > (1 << power))
    if len(item := np.flatnonzero(blocks > 1)):
        item = np.repeat(np.arange(len(value)), blocks)
        block = np.arange(len(item)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        value, weight, row = value[item], weight[item], row[item]
        rate = np.where(block == 0, 1.0, np.exp2(np.maximum(block - 1, 0)))
    else:
        block, rate = np.zeros(len(value), dtype=np.int64), np.ones(len(value))
    first = mix(value + seeded(seed) + block.astype(np.uint64) * _STEP[1])
    best = np.full(rows * size, np.inf)
    limit = np.zeros(rows)
    limit[has] = (np.log(size) + 2.5) / total[has]

    def later(state: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        state = mix(state + _P)
        u = ((state * _STEP[2]) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        return state, -np.log1p(-u) * gap

    live = np.arange(len(value))
    while live.size:
        r, gap, w, j = row[live], 1 / (rate[live] * size), weight[live], block[live]
        end = limit[r]
        state, time = later(first[live], gap)
        while (due := np.flatnonzero(time <= end)).size:
            r, gap, w, j, end, state, time = (x[due] for x in (r, gap, w, j, end, state, time))
            register = ((state >> np.uint64(32)) % np.uint64(size)).astype(np.int64)
            slot, at_time = r * size + register, time
            if j.any():  # of a block that starts at its own length
                level = np.where(j == 0, 0.0, np.exp2(j - 1) * (1 + (state & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32))
                slot, at_time = slot[level < w], time[level < w]
            np.minimum.at(best, slot, at_time)
            state, more = later(state, gap)
            time = time + more
        # registers that are still empty: the same arrivals again, up to twice the time
        open_ = np.isinf(best.reshape(rows, size)).any(axis=1) & (limit > 0)
        limit[open_] *= 2
        live = live[open_[row[live]]]
    best = best.reshape(rows, size)
    out[has] = mix(best[has].view(np.uint64) ^ mix(np.arange(1, size + 1, dtype=np.uint64) * _P))
    return out


def minimum_signatures(value: np.ndarray, at: np.ndarray, size: int, seed: int = 11) -> np.ndarray:
    """MinHash signatures of 32 bits of the groups of values between offsets; all ones for an empty group."""
    out = np.full((len(at) - 1, size), 0xFFFFFFFF, dtype=np.uint32)
    has = np.flatnonzero(np.diff(at))
    if has.size:
        for k in range(size):
            a, b = seeded(seed + 2 * k) | np.uint64(1), seeded(seed + 2 * k + 1)
            out[has, k] = np.minimum.reduceat(((value * a + b) >> np.uint64(32)).astype(np.uint32), at[has])
    return out


FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_stops", "n_chars", "n_symbol_words")


def features(texts: pa.Array) -> dict[str, np.ndarray]:
    """Exact shape counts of each whole text; fields are the words here."""
    data, off = raw(texts)
    blank = _BLANK[data]
    w = Runs(data, off, ~blank)
    head = (data & 0xC0) != 0x80
    hashes, place = windows(w.hash, w.at, SHINGLE)
    row = w.row()
    twice, _ = repeated(hashes, row[place]) if len(place) else (np.zeros(0, dtype=bool), None)
    cover = np.zeros(len(w.hash) + 1, dtype=np.int64)
    np.add.at(cover, place[twice], 1)
    np.add.at(cover, np.minimum(place[twice] + SHINGLE, len(w.hash)), -1)
    covered = np.cumsum(cover[:-1]) > 0
    lines = Runs(data, off, data != 10)
    seen = np.concatenate([[0], np.cumsum(~blank)])
    real = seen[lines.end] > seen[lines.start]
    line_row = lines.row()
    _, later = repeated(lines.hash[real], line_row[real])
    n = len(off) - 1
    last = data[w.end - 1] if len(w.end) else np.zeros(0, dtype=np.uint8)
    stops = (last == 46) | (last == 33) | (last == 63)
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    count = lambda r, m: np.bincount(r[m], minlength=n).astype(np.int64)
    return {
        "n_words": np.diff(w.at).astype(np.int64),
        "word_chars": per_row(head & ~blank, off),
        "n_symbols": per_row(_SYMBOL[data], off),
        "n_dup_lines": count(line_row[real], later),
        "n_repeat_words": count(row, covered),
        "n_lines": count(line_row, real),
        "n_upper": per_row(_UPPER[data], off),
        "n_letters": per_row(_LETTER[data], off),
        "n_digits": per_row(_DIGIT[data], off),
        "n_stops": count(row, stops),
        "n_chars": per_row(head, off),
        "n_symbol_words": count(row, symbols[w.end] > symbols[w.start]),
    }
