"""Kneser-Ney models of characters, in sorted arrays.

A symbol is 12 bits. A code point below 0x800 is one symbol; a higher one is two, its upper bits above 0x810 and then its
lower eleven, so that no two texts have the same symbols. 1 opens and 2 ends a word. An n-gram of up to five symbols is one
exact 64-bit key, its suffix a mask and its context a shift.

Models of single words score a word from its opening mark to its end. Units score text across words: each is a run of a
text whose first ``LEFT`` code points are only context, and whose other symbols are scored with all of it.
"""

from __future__ import annotations

import numpy as np

BITS, ORDER, OPEN, END = 12, 5, 1, 2
SYMBOLS = 1 << BITS
LEFT = ORDER - 1
BLANK = chr(END)
NARROW, UPPER = 0x800, 0x810
DENSE = 1 << 25  # entries of a table of possible n-grams, beyond which they are sorted


def coded(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a text, and the number of symbols of each of its code points."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    high = raw >= NARROW
    if not high.any():
        return np.maximum(raw, END), np.ones(len(raw), np.int64)
    width = 1 + high
    out = np.repeat(np.where(raw < NARROW, np.maximum(raw, END), UPPER + (raw >> 11)), width)
    at = np.cumsum(width) - 1
    out[at[high]] = 3 + (raw[high] & 0x7FF)
    return out, width


def sizes_of(words: list[str], width: np.ndarray) -> np.ndarray:
    """Number of symbols of each word."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    total = np.concatenate([[0], np.cumsum(width)])[ends]
    return np.diff(total, prepend=0)


def symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all words with their marks, the place of each in its word, and the word it is of."""
    raw, width = coded("".join(words))
    sizes = sizes_of(words, width) + 2
    starts = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.int64)
    inside = np.ones(len(out), bool)
    inside[starts] = inside[starts + sizes - 1] = False
    out[inside], out[starts], out[starts + sizes - 1] = np.maximum(raw, 3), OPEN, END
    return out, np.arange(len(out)) - np.repeat(starts, sizes), np.repeat(np.arange(len(words)), sizes)


def keys(syms: np.ndarray, k: int) -> np.ndarray:
    """Key of the k symbols that end at each place; only meaningful from the k-th symbol of a word on."""
    out = syms.copy()
    for j in range(1, k):
        out[j:] |= syms[:-j] << (BITS * j)
    return out


def raw_counts(words: list[str], counts: np.ndarray, order: int = ORDER) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Counts of full-order n-grams, and of the shorter ones that open a word."""
    syms, place, word = symbols(words)
    weight, out = counts[word], {}
    for k in range(2, order + 1):
        at = (place >= k - 1) if k == order else (place == k - 1)
        found, inverse = np.unique(keys(syms, k)[at], return_inverse=True)
        out[k] = found, np.bincount(inverse, weights=weight[at], minlength=len(found)).astype(np.int64)
    return out


def discounts(n: list[float]) -> list[float]:
    """D1, D2 and D3+ of modified Kneser-Ney smoothing, from the numbers of n-grams seen one to four times."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not n1 or not n2:
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)]


def discount_of(counts: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3).astype(np.int64)]


class Tables:
    """For each order: n-gram keys with discounted shares, and context keys with the weight left for the next lower order."""

    def __init__(self, grams: dict[int, tuple[np.ndarray, np.ndarray]], contexts: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.grams, self.contexts = grams, contexts

    @classmethod
    def train(cls, words: list[str], counts: np.ndarray, order: int = ORDER) -> Tables:
        raw, grams, contexts = raw_counts(words, counts, order), {}, {}
        seen = raw[order]
        for k in range(order, 0, -1):
            found, c = seen
            if k < order:
                mask = (1 << (BITS * k)) - 1
                types, n = np.unique(found & mask, return_counts=True)
                if k > 1:
                    opened = raw[k]
                    types, c = np.concatenate([types, opened[0]]), np.concatenate([n, opened[1]])
                    types, inverse = np.unique(types, return_inverse=True)
                    c = np.bincount(inverse, weights=c).astype(np.int64)
                else:
                    c = n
                found = types
            d = discounts([int((c == i).sum()) for i in (1, 2, 3, 4)])
            ctx, inverse = np.unique(found >> BITS, return_inverse=True)
            total, off = np.bincount(inverse, weights=c), discount_of(c, d)
            grams[k] = found, (c - off) / total[inverse]
            contexts[k] = ctx, np.bincount(inverse, weights=off) / total
            seen = found, c
        return cls(grams, contexts)

    def gram(self, k: int, wanted: np.ndarray) -> np.ndarray:
        return look_up(*self.grams[k], wanted, 0.0)

    def context(self, k: int, wanted: np.ndarray) -> np.ndarray:
        return look_up(*self.contexts[k], wanted, 1.0)


def look_up(known: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    if not len(known):
        return np.full((len(wanted), *values.shape[1:]), missing)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    out = values[at].astype(np.float64)
    out[known[at] != wanted] = missing
    return out


def merged(models: list[Tables], order: int = ORDER) -> Tables:
    """Several models as one whose values have a column for each."""
    out: list[dict] = [{}, {}]
    for which, missing in ((0, 0.0), (1, 1.0)):
        for k in range(1, order + 1):
            each = [(m.grams, m.contexts)[which][k] for m in models]
            union = np.unique(np.concatenate([x for x, _ in each])) if each else np.zeros(0, np.int64)
            out[which][k] = union, np.stack([look_up(x, v, union, missing) for x, v in each], 1).astype(np.float32)
    return Tables(*out)


def score(tables, words: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Natural log probability of each word, its end included, a column for each model if tables hold several; and the
    number of symbols scored."""
    syms, place, word = symbols(words)
    at = place >= 1
    p = None
    for k in range(1, order + 1):
        here = keys(syms, k)
        if p is None:
            p = tables.gram(1, here) + tables.context(1, here >> BITS) / SYMBOLS
            continue
        use = np.flatnonzero(place >= k - 1)
        p[use] = tables.gram(k, here[use]) + tables.context(k, here[use] >> BITS) * p[use]
    p = np.log(np.maximum(p[at], 1e-12))
    starts = np.flatnonzero(np.diff(word[at], prepend=-1))
    n = np.bincount(word[at], minlength=len(words))
    return np.add.reduceat(p, starts, axis=0) if len(p) else np.zeros((0, *p.shape[1:])), n


def units(words: list[str], most: int = 1 << 18) -> list[str]:
    """Units of a text's words: runs of at most ``most`` code points, each after the last ones of the run before it.

    The text opens with blanks and has one after each word. Together the units score each symbol after the opening once.
    """
    stream = BLANK * LEFT + BLANK.join(words) + BLANK
    return [stream[i : i + LEFT + most] for i in range(0, len(stream) - LEFT, most)] if words else []


def placed(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the joined units, which of them are scored, and the unit of each."""
    raw, width = coded("".join(parts))
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths)
    before = np.concatenate([[0], np.cumsum(width)]) if len(raw) > len(width) else np.arange(len(width) + 1)
    unit = np.repeat(np.arange(len(parts)), np.diff(before[ends], prepend=0))
    return raw, np.arange(len(raw)) >= before[ends - lengths + LEFT][unit], unit


def distinct(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The different ones of codes below ``size`` in order, and the place of each code among them."""
    if size > DENSE:
        return np.unique(codes, return_inverse=True)
    there = np.zeros(size, bool)
    there[codes] = True
    seen = np.flatnonzero(there)
    place = np.empty(size, np.int32)
    place[seen] = np.arange(len(seen), dtype=np.int32)
    return seen, place[codes]


class Grams:
    """The n-grams that end at some places of a row of symbols, told apart order by order.

    An n-gram is numbered by its first symbol and the number of its suffix, which keeps the order of keys, so that a table
    of a batch's possible numbers takes the place of sorting its keys.
    """

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        self.at, self.order = at, 0
        self.used = np.flatnonzero(np.bincount(raw, minlength=SYMBOLS))
        number = np.zeros(SYMBOLS, np.int32)
        number[self.used] = np.arange(len(self.used))
        self.small = number[raw]
        self.keys, self.number = np.zeros(1, np.int64), np.zeros(len(at), np.int32)

    def longer(self) -> None:
        """One order up: keys holds the different n-grams in order, number which of them ends at each place."""
        n = len(self.keys)
        codes = self.small[self.at - self.order].astype(np.int64)
        codes *= n
        codes += self.number
        seen, self.number = distinct(codes, len(self.used) * n)
        first, rest = np.divmod(seen, max(n, 1))
        self.keys = self.used[first] << (BITS * self.order) | self.keys[rest]
        self.order += 1

    def only(self, kept: np.ndarray, known: np.ndarray | None = None) -> None:
        """Leaves the places that are kept; and known, if given, says which n-grams these have."""
        self.at, self.number = self.at[kept], self.number[kept]
        if known is not None:
            self.keys, self.number = self.keys[known], (np.cumsum(known, dtype=np.int32) - 1)[self.number]
