"""Runs of words that repeat with a period, by harmonic grid probing.

A run of period p is at least 4 p words long, so among the words 0, p, 2p, ... three neighbours jp lie in it with (j+1)p also in it. All grid points
of a period are tested at once (word jp against word (j+1)p, on the array and itself moved by p), which makes n / p tests, n log n in all. Where three in a row
are equal, the stretch of words that equal the word p later is extended to both sides by comparing chunks that double. A grid point inside a run that was found
for a divisor of p, and all that its stretch covers, are skipped: such a stretch has the smaller period throughout. Stretches whose first p words repeat
a shorter block are no runs of p.

Texts are probed in blocks, end to end with a mark between them that equals nothing, so short texts cost no calls of their own. Words are compared by their
number in the block's dictionary, which has their bytes.

Defined cases: a null or empty text has no words and no runs; very long texts are a block of their own, in a few arrays of the text's size; ties
and repeated rows are worked on each by itself; an empty table gives an empty result; columns with the names of new ones are carried on as {name}_in,
and no other column is read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import aside, fresh
from riskweave.llm.pretokens import blocks

_BLOCK = 4 << 20
_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
#: What the method needs: a run of 4 periods has three neighbouring grid points.
LEAST_PERIODS = 4


def words_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end in the bytes of texts end to end, and how many words lie before each text (one more than texts)."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    opens, closes = ~space, ~space
    first = np.zeros(len(data) + 1, bool)
    first[np.concatenate([[0], ends])] = True
    opens[1:] &= space[:-1] | first[1:-1]
    closes[:-1] &= space[1:] | first[1:-1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, np.concatenate([[0], ends]))


def word_numbers(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Equal numbers for equal words."""
    import pyarrow as pa

    sizes = stops - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[stops] -= 1  # a word may begin where another text's last one ends
    letters = data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _agree(x: np.ndarray, at: int, p: int) -> int:
    """How many words from `at` on equal the word p later."""
    n, size, most = 0, 32, len(x) - p - at
    while n < most:
        size = min(size, most - n)
        differ = x[at + n : at + n + size] != x[at + n + p : at + n + p + size]
        k = int(differ.argmax())
        if differ[k]:
            return n + k
        n, size = n + size, 2 * size
    return n


def _agree_before(x: np.ndarray, at: int, p: int) -> int:
    """How many words before `at`, one after the other, equal the word p later."""
    n, size = 0, 32
    while n < at:
        size = min(size, at - n)
        differ = (x[at - n - size : at - n] != x[at - n - size + p : at - n + p])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            return n + k
        n, size = n + size, 2 * size
    return n


def _prime_factors(p: int) -> list[int]:
    out, d = [], 2
    while d * d <= p:
        if p % d == 0:
            out.append(d)
            while p % d == 0:
                p //= d
        d += 1
    return [*out, p] if p > 1 else out


def probe(x: np.ndarray, longest: int, least: int = 6, periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in an array of numbers: maximal stretches with smallest period p of max(least, periods * p) numbers or more.
    longest: of how many numbers a run consists at most."""
    if periods < LEAST_PERIODS:
        raise ValueError(f"grids find runs of {LEAST_PERIODS} periods or more")
    n, runs = len(x), []
    period_of, end_of = np.zeros(n, np.int64), np.zeros(n, np.int64)  # of a run over each place
    for p in range(1, longest // periods + 1):
        same = x[: n - p : p] == x[p::p]
        hits = np.flatnonzero(same[:-2] & same[1:-1] & same[2:]) * p if len(same) > 2 else ()
        i = 0
        while i < len(hits):
            at = int(hits[i])
            q, to = int(period_of[at]), int(end_of[at])
            if not (q and p % q == 0 and at + p < to):  # else a run of a divisor has this stretch, and it ends there
                back, on = _agree_before(x, at, p), _agree(x, at, p)
                start, length, to = at - back, back + on + p, at + on + p
                if length >= max(least, periods * p):
                    block = x[start : start + p]
                    if not any(np.array_equal(block[: p - p // f], block[p // f :]) for f in _prime_factors(p)):
                        runs.append((start, length, p))
                        free = period_of[start:to] == 0
                        period_of[start:to][free], end_of[start:to][free] = p, to
            i = max(i + 1, int(np.searchsorted(hits, to - p)))
    return runs


def _block(texts, least: int, periods: int):
    """The runs of each text, as Arrow arrays of starts, lengths, periods and offsets, and the texts without repetitions."""
    import pyarrow as pa

    raw = texts.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    ends = offsets[1:] - offsets[0]
    if not len(data):
        starts = stops = np.zeros(0, np.int64)
        before = np.zeros(len(texts) + 1, np.int64)
    else:
        starts, stops, before = words_of(data, ends)
    counts = np.diff(before)
    owner = np.repeat(np.arange(len(counts)), counts)
    numbers = word_numbers(data, starts, stops) if len(starts) else np.zeros(0, np.int64)
    x = np.empty(len(numbers) + len(counts), np.int64)
    place = np.arange(len(numbers)) + owner
    x[place] = numbers
    x[before[1:] + np.arange(len(counts))] = -1 - np.arange(len(counts))  # a mark after each text
    runs = np.array(sorted(probe(x, int(counts.max(initial=0)), least, periods)), np.int64).reshape(-1, 3)
    of = np.searchsorted(before[1:] + np.arange(len(counts)), runs[:, 0])  # the text of each run
    dropped = np.zeros(len(x) + 1, np.int64)
    np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
    np.add.at(dropped, runs[:, 0] + runs[:, 1], -1)
    kept = (np.cumsum(dropped[:-1]) == 0)[place]
    first = before[:-1][of] + of
    at = np.searchsorted(of, np.arange(len(counts) + 1))
    columns = [pa.array(c) for c in (runs[:, 0] - first, runs[:, 1], runs[:, 2])]
    listed = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.StructArray.from_arrays(columns, names=["start", "length", "period"]))
    return counts, listed, _joined(data, starts[kept], stops[kept], owner[kept], len(counts))


def _joined(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, owner: np.ndarray, texts: int):
    """Words of each text, joined by blanks: the bytes of words, and the one after each word but its text's last."""
    import pyarrow as pa

    follows = np.zeros(len(starts), bool)
    follows[:-1] = owner[1:] == owner[:-1]
    change = np.zeros(len(data) + 2, np.int8)
    change[starts] += 1
    change[stops + follows] -= 1
    chosen = np.cumsum(change[: len(data)], dtype=np.int8).view(bool)
    spaced = data.copy()
    spaced[stops[follows]] = 32
    sizes = np.bincount(owner, weights=stops - starts + follows, minlength=texts).astype(np.int64)
    offsets = np.zeros(texts + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_string(), texts, [None, pa.py_buffer(offsets), pa.py_buffer(spaced[chosen])]).cast(pa.string())


def find_runs(docs: DataFrame, text_col: str = "text", least: int = 6, periods: int = LEAST_PERIODS) -> DataFrame:
    """docs with n_words, runs (by start, then period; words count from 0) and collapsed (the words but those that a run has after its first period,
    with one blank between them) in place of the text. A word is what is not a blank or 09-0D."""
    text, *_ = fresh(docs, "text")
    carried = aside(docs.withColumnRenamed(text_col, text), "n_words", "runs", "collapsed")
    carried = carried.select(*[c for c in carried.columns if c != text], text)

    def run(batches):
        import pyarrow as pa

        for part, texts in blocks(batches, part_text, _BLOCK):
            counts, runs, collapsed = _block(texts, least, periods)
            made = [pa.array(counts, pa.int64()), runs, collapsed]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=[*part.schema.names[:-1], "n_words", "runs", "collapsed"])

    part_text = len(carried.columns) - 1
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema.fields[:-1]], "n_words bigint", f"runs {_RUNS}", "collapsed string"])
    return carried.mapInArrow(run, schema)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared as whole numbers; the first of those; null without runs."""
    none = F.lit(None).cast(_RUNS[6:-1])
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, none, lambda best, r: F.when(better(best, r), r).otherwise(best))


def lines(runs: Column) -> Column:
    """Each run as start,length,period and a line feed."""
    return F.array_join(F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")


def planted(text: Column, doc_id: Column) -> Column:
    """A text in which, for one in ten ids, what follows a certain word repeats a few words over and over. h = crc32(id), g = floor(h / 10): if h % 10 = 0, each
    word i >= a = g % n becomes word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)). Other texts, and those without words, stay as they are."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x09-\x0D ]+"), lambda w: w != "")

    def placed(s: Column) -> Column:
        n = F.size(s["w"]).cast("long")
        a = F.pmod(g, n)
        return F.struct(s["w"].alias("w"), a.alias("a"), (1 + F.floor((n - a) / (3 + g % 8))).alias("p"))

    def repeated(s: Column) -> Column:
        again = lambda i: F.element_at(s["w"], (s["a"] + F.pmod(i - s["a"], s["p"]) + 1).cast("int"))
        return F.array_join(F.transform(s["w"], lambda w, i: F.when(i < s["a"], w).otherwise(again(i))), " ")

    changed = F.transform(F.transform(F.array(F.struct(words.alias("w"))), placed), repeated)[0]
    return F.when((h % 10 == 0) & (F.length(text) > 0) & text.rlike(r"[^\x09-\x0D ]"), changed).otherwise(text)
