"""Splits texts into the words that byte-level BPE merges stay inside, whole blocks of text at a time with numpy.

The split is that of the pattern of the public rank files: contractions ('s 't 're 've 'm 'll 'd), an optional blank with a run of
letters, of digits or of other signs, white space up to the last character before a word, and other white space.
"""

from __future__ import annotations

import sys
from itertools import chain

import numpy as np

LETTER, DIGIT, SPACE, OTHER = 1, 2, 3, 4
#: Contractions after an apostrophe. Fixed values.
_ONE, _TWO = "stmd", ("re", "ve", "ll")


def character_classes() -> np.ndarray:
    """A class for every code point."""
    import regex

    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            shift = lambda i: i if i < 0xD800 else i + 0x800
            table[shift(m.start()) : shift(m.end() - 1) + 1] = kind
    return table


def boundaries(points: np.ndarray, classes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of words in code points. first: where the texts begin, in rising order, all below len(points)."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes[points]
    opens = np.zeros(n, bool)
    opens[first] = True
    change = np.ones(n, bool)  # another class than before, or another text
    change[1:] = kind[1:] != kind[:-1]
    change |= opens
    start = change.copy()
    space = kind == SPACE
    # The last character of white space before a word stands alone, and a blank joins the word.
    before_word = np.zeros(n, bool)
    before_word[:-1] = space[:-1] & ~space[1:] & ~opens[1:]
    start |= before_word
    joined = np.zeros(n, bool)
    joined[1:] = before_word[:-1] & (points[:-1] == 32)
    start &= ~joined
    # Contractions: an apostrophe that begins a word of its own, and the letters after it.
    for i in np.flatnonzero((points == 39) & start & (kind == OTHER)):
        if i + 1 >= n or opens[i + 1] or kind[i + 1] != LETTER:
            continue
        a = chr(points[i + 1])
        size = 1 if a in _ONE else 2 if i + 2 < n and not opens[i + 2] and a + chr(points[i + 2]) in _TWO else 0
        if size:
            start[i + 1] = False
            if i + 1 + size < n and kind[i + 1 + size] == LETTER and not opens[i + 1 + size]:
                start[i + 1 + size] = True
    return np.flatnonzero(start)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    base, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
    out = []
    for x in (base, inverse):
        p = np.full(n, x, np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


class Splitter:
    """Words of blocks of texts: each block's distinct words and, for each place, the number of its word."""

    def __init__(self, classes: np.ndarray):
        self.classes = classes
        self.powers = _powers(1 << 16)

    def words(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct words, the word at each place, and the places of each text as offsets (one more than texts)."""
        import pandas as pd

        if sum(map(len, texts)) >= 2**31:
            raise ValueError("a block of texts holds 2^31 characters at most")
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        n = len(points)
        if not n:
            return [], np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        first = (ends - lengths)[lengths > 0]
        starts = boundaries(points, self.classes, first)
        stops = np.append(starts[1:], n)
        sizes = stops - starts
        if len(self.powers[0]) <= n:
            self.powers = _powers(1 << int(n).bit_length())
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.multiply(points, self.powers[0][:n], out=sums[1:])
            np.cumsum(sums[1:], out=sums[1:])
            keys = (sums[stops] - sums[starts]) * self.powers[1][starts]
            keys += sizes.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        del sums
        codes, distinct = pd.factorize(keys)
        sample = np.zeros(len(distinct), np.int64)
        sample[codes[::-1]] = np.arange(len(codes))[::-1]  # the first place of each word
        move = starts[sample][codes] - starts
        there = np.repeat(move.astype(np.int32), sizes)
        there += np.arange(n, dtype=np.int32)
        if (sizes[sample][codes] != sizes).any() or not np.array_equal(points[there], points):  # two words share a key
            every = [whole[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
            codes, found = pd.factorize(np.array(every, dtype=object))
            words = list(found)
        else:
            words = [whole[a:b] for a, b in zip(starts[sample].tolist(), stops[sample].tolist(), strict=True)]
        places = np.searchsorted(starts, np.append(ends - lengths, n))
        return words, codes.astype(np.int32), places


def slices(batches, column: int, most: int):
    """Slices of record batches with at most `most` bytes in a column of texts or bytes, or one row."""
    import pyarrow.compute as pc

    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def blocks(batches, text: int, most: int):
    """slices, and the texts of each. A null text is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for part in slices(batches, text, most):
        yield part, pc.fill_null(part.column(text), pa.scalar("", part.column(text).type))


def flat(lists: list, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Lists end to end, and where each begins (one more than lists)."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    at = np.zeros(len(lists) + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    values = np.fromiter(chain.from_iterable(lists), dtype, int(at[-1]))
    return values, at


def gather(values: np.ndarray, at: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists numbered by codes end to end, and where each begins (one more than codes)."""
    sizes = (at[1:] - at[:-1])[codes]
    begin = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(sizes, out=begin[1:])
    index = np.arange(begin[-1]) + np.repeat(at[:-1][codes] - begin[:-1], sizes)
    return values[index], begin
