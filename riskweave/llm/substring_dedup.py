"""Substring deduplication by sliding spans of sentences.

A text is cut into sentences (after a word that ends in . ! ? and at line ends); a sentence of more than `piece_words` words is cut
further, at places that its own words set: after a word whose hash with the two before it is less than those of the `_NEAR` words on
either side. A passage of two texts is so cut alike whatever stands before it, from `_NEAR` + 2 words after its start to `_NEAR` before
its end. Where no such place comes for `piece_words` words, cuts are counted from the last one (a run of one word has none at all). A
span is the shortest run of consecutive sentences from a sentence on, or up to a sentence, that has `sentences` sentences and `words`
words. Every span is hashed with 128 bits, equal spans are joined over all documents, and the sentences that any repeated span covers
are removed, but for the span's first place: the document with the smallest id, and its first place there.

A text's distinct hashes are written once with its id, and texts are read twice in all: here, and when passages are taken out. A window
over what is written finds the first document of each hash; documents that are not first learn which hashes go, and find these spans in
their text anew. Very common spans would bring all their documents into one task. So each task counts its most common hashes with a
bounded summary, whose size follows the number of spans; the summaries' sum names every hash that more than `_MOST_ROWS` documents or
more than one in `common / 2` spans have, the first documents of these are found by an aggregation of their own, and their rows are
dealt by the id as well.

Words are runs of characters other than ASCII white space and compared after lower-casing A-Z.

Defined cases: a null, empty or wordless text has no spans and stays as it is; texts shorter than a span stay; very long texts are cut and
hashed whole, in a block of their own; a row with a null id takes no part and stays; rows with one id are one document (what they share
with each other stays, repeated rows are treated alike); ties between ids don't occur then; an empty table gives an empty result; other
columns are carried along and never read, whatever their names (one that `report` names goes on as {name}_in). A text may come out empty
when all of it is repeated; its row stays.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.common import aside, cut, forget, fresh
from riskweave.llm.pretokens import blocks

_BLOCK = 2 << 20
#: What a task may get of one hash, and how many hashes may be dealt apart (they are broadcast, some 32 MB): enough for 2^39 spans, beyond which the former grows.
_MOST_ROWS, _MOST_COMMON = 1 << 20, 1 << 20
#: A cut's hash is the least of those of so many words before and after it, so cuts are more than this apart and 2 _NEAR + 1 on average.
_NEAR = 3
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Shape(NamedTuple):
    """What a span is."""

    sentences: int = 3
    words: int = 20
    piece_words: int = 16


class Spans(NamedTuple):
    """Spans of a block of texts, by text and place, and the sentences that they are runs of."""

    text: np.ndarray  # number of the text
    h1: np.ndarray
    h2: np.ndarray
    first: np.ndarray  # first sentence
    last: np.ndarray  # one past the last sentence
    sentence_text: np.ndarray
    start: np.ndarray  # of sentences, in characters of their text
    stop: np.ndarray


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    out = []
    for x in (base, pow(base, -1, 2**64)):
        p = np.full(n, x, np.uint64)
        p[:1] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def _mixed(h: np.ndarray, odd: int) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(odd)
    return h ^ (h >> np.uint64(29))


def _run_hash(h: np.ndarray, first: np.ndarray, last: np.ndarray, base: int) -> np.ndarray:
    """Hashes of runs [first, last) of h: the same for equal runs, wherever they stand."""
    power, back = _powers(len(h) + 1, base)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * power[:-1], out=sums[1:])
    return (sums[last] - sums[first]) * back[first]


def _cuts(word: np.ndarray, first: np.ndarray, most: int) -> np.ndarray:
    """Where pieces begin, as numbers of words: at sentences (first) and, in those of more than `most` words, at cuts."""
    n = len(word)
    edge = np.append(first, n)
    size = np.diff(edge)
    own = np.repeat(np.arange(len(first)), size)
    place = np.arange(n) - first[own]
    mixed = word * np.uint64(_ODD[0])
    mixed[2:] += word[1:-1] * np.uint64(_ODD[2]) + word[:-2] * np.uint64(_ODD[3])
    mixed = _mixed(mixed, _ODD[0])
    mixed[place < 2] = np.uint64(2**64 - 1)  # no cut there, and nothing that stands before counts
    least = (place >= 2) & (place < size[own] - 1) & (size[own] > most)
    for d in range(1, min(_NEAR, n - 1) + 1):
        lower, same = mixed[d:] < mixed[:-d], own[d:] == own[:-d]
        least[d:] &= lower | ~same
        least[:-d] &= (mixed[:-d] < mixed[d:]) | ~same
    begin = np.unique(np.concatenate([first, np.flatnonzero(least) + 1]))
    more = (np.diff(np.append(begin, n)) - 1) // most  # further cuts in each piece of a long sentence
    more[size[own[begin]] <= most] = 0
    back = np.concatenate([[0], np.cumsum(more)[:-1]])
    extra = np.repeat(begin, more) + (np.arange(more.sum()) - np.repeat(back, more) + 1) * most
    return np.unique(np.concatenate([begin, extra])) if len(extra) else begin


def spans(texts, shape: Shape) -> Spans:
    """Spans of a pyarrow string array without nulls."""
    import pyarrow as pa

    raw = texts.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    at = offsets - offsets[0]
    none = np.zeros(0, np.int64)
    if not at[-1]:
        return Spans(*[none] * 8)
    data = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    n = len(data)
    text_of = np.repeat(np.arange(len(raw)), np.diff(at))
    opens = np.zeros(n + 1, bool)
    opens[at] = True  # where texts begin, and the end
    word = ~_SPACE[data]
    before = np.concatenate([[False], word[:-1]])
    starts = np.flatnonzero(word & (~before | opens[:-1]))
    if not len(starts):
        return Spans(*[none] * 8)
    after = np.append(word[1:], False)
    stops = np.flatnonzero(word & (~after | opens[1:])) + 1
    own = text_of[starts]
    with np.errstate(over="ignore"):
        h = _run_hash((_LOWER[data] + np.uint64(1)).astype(np.uint64), starts, stops, _ODD[1])
        h = _mixed(h + (stops - starts).astype(np.uint64) * np.uint64(_ODD[4]), _ODD[2])
        ends = np.isin(data[stops - 1], np.frombuffer(b".!?", np.uint8))
        lines = np.concatenate([[0], np.cumsum(data == 10)])
        ends[:-1] |= (lines[starts[1:]] > lines[stops[:-1]]) | (own[1:] != own[:-1])
        begin = _cuts(h, np.append(0, np.flatnonzero(ends[:-1]) + 1), shape.piece_words)
        m = len(begin)
        edge = np.append(begin, len(h))
        sentence_text = own[begin]
        low, high = np.searchsorted(sentence_text, sentence_text), np.searchsorted(sentence_text, sentence_text, side="right")
        i = np.arange(m)
        on = np.maximum(np.searchsorted(edge, edge[i] + shape.words), i + shape.sentences)
        up = np.minimum(np.searchsorted(edge, edge[i + 1] - shape.words, side="right") - 1, i + 1 - shape.sentences)
        good, fits = on <= high, up >= low
        pair = np.unique(np.concatenate([i[good] * (m + 1) + on[good], up[fits] * (m + 1) + i[fits] + 1]))
        first, last = pair // (m + 1), pair % (m + 1)
        a, b = edge[first], edge[last]
        h1 = _mixed(_run_hash(h, a, b, _ODD[3]) + (b - a).astype(np.uint64), _ODD[0]).view(np.int64)
        h2 = _mixed(_run_hash(_mixed(h, _ODD[3]), a, b, _ODD[4]), _ODD[2]).view(np.int64)
    # Sentences reach up to the next one of their text, in characters.
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    from_ = starts[begin]
    to = np.append(from_[1:], n)
    final = np.append(sentence_text[1:] != sentence_text[:-1], True)
    to[final] = at[1:][sentence_text[final]]
    base = chars[at[sentence_text]]
    return Spans(sentence_text[first], h1, h2, first, last, sentence_text, chars[from_] - base, chars[to] - base)


def _summed(keys: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts by key, cut down to `most` keys by taking the next largest count from all."""
    keys, place = np.unique(keys, return_inverse=True)
    counts = np.bincount(place, counts, len(keys)).astype(np.int64)
    if len(keys) > most:
        counts = counts - np.partition(counts, -most - 1)[-most - 1]
        keys, counts = keys[counts > 0], counts[counts > 0]
    return keys, counts


def _distinct(found: Spans) -> tuple[np.ndarray, np.ndarray]:
    """One span for each hash of a text, and how often the text has it."""
    order = np.lexsort((found.h2, found.h1, found.text))
    rows = np.stack([found.text[order], found.h1[order], found.h2[order]])
    new = np.append(True, (rows[:, 1:] != rows[:, :-1]).any(axis=0)) if len(order) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return order[at], np.diff(np.append(at, len(order)))


def hashed_spans(rows: DataFrame, shape: Shape) -> DataFrame:
    """id, h1, h2, again of every distinct hash of a text. again: whether the text has it more than once. rows: id, text."""

    def run(batches):
        import pyarrow as pa

        for part, texts in blocks(batches, 1, _BLOCK):
            found = spans(texts, shape)
            one, often = _distinct(found)
            columns = [part.column(0).take(pa.array(found.text[one])), pa.array(found.h1[one]), pa.array(found.h2[one]), pa.array(often > 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "h1", "h2", "again"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, h1 long, h2 long, again boolean")


def common_hashes(hashed: DataFrame, counters: int) -> DataFrame:
    """h1 (the first half) of every hash that more than two in `counters` rows have, and of some more, fewer than `counters` in all."""

    def run(batches):
        import pyarrow as pa

        keys, counts, waiting, held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def summed():
            new = np.concatenate([keys[:0], *waiting])
            return _summed(np.append(keys, new), np.append(counts, np.ones(len(new), np.int64)), counters)

        for batch in batches:
            waiting.append(batch.column(0).to_numpy())
            held += batch.num_rows
            if held > counters:  # as many as the counters, so that sorting them stays in proportion to the rows
                (keys, counts), waiting, held = summed(), [], 0
        keys, counts = summed()
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["h1", "n"])

    # A summary misses one in `counters` rows at most, so what has twice as many has more than this.
    enough = max(hashed.count() / counters, 1)
    return hashed.select("h1").mapInArrow(run, "h1 long, n long").groupBy("h1").agg(F.sum("n").alias("n")).where(F.col("n") > enough).select("h1")


def repeated_hashes(docs: DataFrame, shape: Shape = Shape(), id_col: str = "doc_id", text_col: str = "text", common: int = 2048) -> DataFrame:
    """id and the hashes (array of h1, h2, own) of its spans that stand elsewhere before, or (own) that it has first and has again. A written table."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    every = hashed = cut(hashed_spans(rows, shape))
    counters = min(max(common, 2 * hashed.count() // _MOST_ROWS), _MOST_COMMON)
    known = F.lit(None).cast(dict(rows.dtypes)["id"])
    if counters:
        origins = hashed.join(F.broadcast(common_hashes(hashed, counters)), "h1").groupBy("h1", "h2").agg(F.min("id").alias("known"))
        every = hashed.join(F.broadcast(origins), ["h1", "h2"], "left")  # as many rows, but for hashes alike in their first half
        known = F.col("known")
    salt = F.when(known.isNotNull(), F.pmod(F.xxhash64("id"), F.lit(1 << 20))).otherwise(0)
    same = Window.partitionBy("h1", "h2", "salt")
    first = every.withColumn("salt", salt).withColumn("origin", F.coalesce(known, F.min("id").over(same)))
    own = F.col("id") == F.col("origin")
    gone = first.where(~own | F.col("again")).select("id", F.struct("h1", "h2", own.alias("own")).alias("hash"))
    found = cut(gone.groupBy("id").agg(F.collect_set("hash").alias("hashes")))  # bounded by the document
    forget(hashed)
    return found


def _left(texts, h1: list, h2: list, own: list, shape: Shape) -> tuple[list[str], np.ndarray]:
    """What is left of texts (a pyarrow string array) without the spans of these hashes, and how many spans are gone from each."""
    found = spans(texts, shape)
    sizes = np.fromiter(map(len, h1), np.int64, len(h1))
    text = np.repeat(np.arange(len(h1)), sizes)
    whole = lambda lists, kind: np.concatenate([np.asarray(x, kind) for x in lists]) if len(lists) else np.zeros(0, kind)
    with np.errstate(over="ignore"):
        key = lambda t, a, b: _mixed(t.astype(np.uint64) * np.uint64(_ODD[4]) + a.view(np.uint64), _ODD[0]) + b.view(np.uint64)
        wanted, place = np.unique(key(text, whole(h1, np.int64), whole(h2, np.int64)), return_index=True)
        keys = key(found.text, found.h1, found.h2)
    gone = np.zeros(len(keys), bool)
    if len(wanted) and len(keys):
        near = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
        gone = wanted[near] == keys
        kept = whole(own, bool)[place][near]  # the first place of these stays
        _, first = np.unique(keys, return_index=True)
        is_first = np.zeros(len(keys), bool)
        is_first[first] = True
        gone &= ~(kept & is_first)
    depth = np.zeros(len(found.start) + 1, np.int64)
    np.add.at(depth, found.first[gone], 1)
    np.add.at(depth, found.last[gone], -1)
    covered = np.cumsum(depth)[:-1] > 0
    number = np.bincount(found.text[gone], minlength=len(texts))
    out = texts.to_pylist()
    at = np.flatnonzero(covered)
    edge = np.searchsorted(found.sentence_text[at], np.arange(len(out) + 1))
    for i in np.flatnonzero(number).tolist():
        mine = at[edge[i] : edge[i + 1]]
        parts, done = [], 0
        for a, b in zip(found.start[mine].tolist(), found.stop[mine].tolist(), strict=True):
            parts.append(out[i][done:a])
            done = b
        out[i] = "".join([*parts, out[i][done:]])
    return out, number


def _cleaner(shape: Shape):
    @F.pandas_udf("struct<text:string,spans:long>")
    def clean(texts: pd.Series, h1: pd.Series, h2: pd.Series, own: pd.Series) -> pd.DataFrame:
        import pyarrow as pa

        out, number = np.full(len(texts), None, object), np.zeros(len(texts), np.int64)
        rows = np.flatnonzero(texts.notna() & h1.notna())
        size = np.cumsum(texts.iloc[rows].str.len().to_numpy(np.int64)) if len(rows) else np.zeros(0, np.int64)
        at = 0
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + _BLOCK, side="right")))
            part = rows[at:to]
            lists = [x.iloc[part].tolist() for x in (h1, h2, own)]
            out[part], number[part] = _left(pa.array(texts.iloc[part], pa.string()), *lists, shape)
            at = to
        return pd.DataFrame({"text": out, "spans": number})

    return clean


def drop_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    chars_col: str | None = None,
    report: tuple[str, str] | None = None,
    least_sentences: int = 3,
    least_words: int = 20,
    piece_words: int = 16,
    common: int = 2048,
) -> DataFrame:
    """docs with repeated passages taken out of the text. chars_col, if given, gets the new length of changed texts; report names two
    more columns for the number of spans and of characters taken out."""
    shape = Shape(least_sentences, least_words, piece_words)
    docs = aside(docs, *(report or ()))
    key, hashes, new, old = fresh(docs, "id", "hashes", "new", "old")
    found = repeated_hashes(docs, shape, id_col, text_col, common).select(F.col("id").alias(key), F.col("hashes").alias(hashes))
    joined = docs.withColumn(key, F.col(id_col)).join(found, key, "left")
    some = F.col(hashes).isNotNull()
    part = lambda name: F.transform(hashes, lambda x: x[name])
    # Texts without such hashes do not go to Python.
    out = joined.withColumn(new, _cleaner(shape)(F.when(some, F.col(text_col)), part("h1"), part("h2"), part("own"))).withColumn(old, F.length(text_col))
    changed = F.coalesce(F.col(f"{new}.spans") > 0, F.lit(False))
    out = out.withColumn(text_col, F.when(changed, F.col(f"{new}.text")).otherwise(F.col(text_col)))
    if chars_col:
        kind = dict(docs.dtypes)[chars_col]
        out = out.withColumn(chars_col, F.when(changed, F.length(text_col).cast(kind)).otherwise(F.col(chars_col)))
    if report:
        out = out.withColumns({report[0]: F.coalesce(F.col(f"{new}.spans"), F.lit(0)).cast("long"), report[1]: F.coalesce(F.col(old) - F.length(text_col), F.lit(0)).cast("long")})
    return out.select(*docs.columns, *(report or ()))
