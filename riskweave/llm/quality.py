"""Quality selection by importance resampling.

Target text (documents labelled good and not toxic) and raw text (all documents) each get a generative model: the share of every
bucket of hashed unigrams and bigrams. A document's weight is the ratio of the two, and the sample is drawn by Gumbel top-k: log weight
plus Gumbel noise from a hash of the id, largest first. What counts as k is the number of documents whose log weight per token is at
least a cut-off, which is set so that `keep_good` of the good labelled rows pass that the model has not seen (a quarter, by a hash of
the id), and lowered by a standard error for what few labels leave open.

A mean over a long document hides a few words that good text never has. So the same ratio is taken once more of unigrams by the number of
documents that have them, and a document's worst word is held to a cut-off of the same kind; only documents that pass are drawn. A word
weighs in as far as target documents should have it by its share of all: rare words, wherever they stand, weigh next to nothing.

The models and the ranking use every document. Labels come from at most `most_labels` labelled rows (those with the smallest hash of
their id), so they can be broadcast; the models have `buckets` and `term_buckets` numbers each. The k-th largest value is found by counting
values in ever narrower ranges, 4,096 counts at a time.

Defined cases: a null or empty text has no tokens, weight 0 and no share in the models; very long texts are read whole, in a block of their
own; ids that repeat have the same noise, and ties at the k-th place all stay; a null id draws its noise as the text "null"; without good
labels to measure the cut-offs on, all documents stay; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import cut, fresh
from riskweave.llm.pretokens import blocks

_BLOCK = 2 << 20
_BASE = 0x9E3779B97F4A7C15


def _classes() -> np.ndarray:
    """Of bytes: 0 white space, 1 parts of words, 2 other signs."""
    table = np.full(256, 2, np.uint8)
    for c in b"\t\n\x0b\x0c\r ":
        table[c] = 0
    for a, b in ((48, 58), (65, 91), (97, 123), (128, 256)):
        table[a:b] = 1
    return table


class _Tokens(NamedTuple):
    """Hashes of a block's unigrams, and where each text's begin (one more than texts)."""

    one: np.ndarray
    places: np.ndarray


def _tokens(texts) -> _Tokens:
    """Tokens (runs of word bytes or of other signs) of a pyarrow string array's texts."""
    import pyarrow as pa

    raw = texts.cast(pa.large_binary())
    if raw.null_count:
        raise ValueError("texts hold nulls")
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    buf = raw.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[offsets[0] : offsets[-1]] if buf is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    at = offsets - offsets[0]
    n = len(data)
    none = _Tokens(np.zeros(0, np.uint64), np.zeros(len(raw) + 1, np.int64))
    if not n:
        return none
    kind = _classes()[data]
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    change[at[:-1][at[:-1] < n]] = True
    starts = np.flatnonzero(change & (kind > 0))
    edges = np.flatnonzero(change)
    stops = np.append(edges, n)[np.searchsorted(edges, starts) + 1]
    if not len(starts):
        return none
    base, inverse = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 2**64))
    with np.errstate(over="ignore"):
        power = np.full(n, base, np.uint64)
        power[0] = 1
        np.cumprod(power, out=power)
        sums = np.zeros(n + 1, np.uint64)
        np.multiply(data + np.uint64(1), power, out=sums[1:])
        np.cumsum(sums[1:], out=sums[1:])
        back = np.full(n, inverse, np.uint64)
        back[0] = 1
        np.cumprod(back, out=back)
        one = (sums[stops] - sums[starts]) * back[starts]
        one ^= one >> np.uint64(29)
        one *= np.uint64(0xBF58476D1CE4E5B9)
        one ^= one >> np.uint64(32)
    return _Tokens(one, np.searchsorted(starts, at))


def features(tokens: _Tokens, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all unigrams and bigrams, and where each text's begin (one more than texts)."""
    one, places = tokens
    if not len(one):
        return np.zeros(0, np.int32), np.zeros(len(places), np.int64)
    with np.errstate(over="ignore"):
        two = (one[:-1] * np.uint64(0x94D049BB133111EB) + one[1:]) * np.uint64(_BASE)
    # Unigram i stands at 2 i and its bigram after it; a text's last token has no bigram, which is taken out.
    out = np.empty(2 * len(one), np.int32)
    out[::2] = (one >> np.uint64(20)) % np.uint64(buckets)
    out[1:-1:2] = (two >> np.uint64(20)) % np.uint64(buckets)
    some = places[1:] > places[:-1]
    there = np.ones(len(out), bool)
    there[2 * places[1:][some] - 1] = False
    begin = 2 * places - np.concatenate([[0], np.cumsum(some)])
    return out[there], begin


def terms(tokens: _Tokens, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each text's unigrams, every one once, and where each text's begin."""
    own = np.repeat(np.arange(len(tokens.places) - 1, dtype=np.int64), np.diff(tokens.places))
    key = own * buckets + ((tokens.one >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64)
    key.sort()
    if len(key):
        key = key[np.append(True, key[1:] != key[:-1])]
    return (key % buckets).astype(np.int32), np.searchsorted(key, np.arange(len(tokens.places), dtype=np.int64) * buckets)


class Models(NamedTuple):
    """Log ratios by bucket: of n-gram shares, and of the shares of documents that have a unigram."""

    grams: np.ndarray
    terms: np.ndarray


def count_models(docs: DataFrame, good: DataFrame, buckets: int, term_buckets: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of n-grams and of documents with a unigram by (raw, target) and bucket, and documents (raw, target).
    good: bounded table of ids (column id) of target documents."""
    target = good.select(F.col("id").alias("good_id")).distinct()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(target), F.col("id") == F.col("good_id"), "left")
    size = buckets + term_buckets + 1

    def run(batches):
        import pyarrow as pa

        total = np.zeros((2, size), np.int64)
        for part, texts in blocks(batches, 1, _BLOCK):
            tokens, good_row = _tokens(texts), part.column(2).is_valid().to_numpy(zero_copy_only=False)
            for (found, at), shift in ((features(tokens, buckets), 0), (terms(tokens, term_buckets), buckets)):
                total[0, shift:] += np.bincount(found, minlength=size - shift)
                total[1, shift:] += np.bincount(found[np.repeat(good_row, np.diff(at))], minlength=size - shift)
            total[:, -1] += (len(good_row), good_row.sum())
        kind, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[kind, bucket])], names=["kind", "bucket", "n"])

    counted = rows.select("id", "text", "good_id").mapInArrow(run, "kind int, bucket int, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n"))
    found = counted.toArrow()  # 2 x size rows at most
    out = np.zeros((2, size), np.float64)
    out[found["kind"].to_numpy(), found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out[:, :buckets], out[:, buckets:-1], out[:, -1]


def log_ratio(counts: np.ndarray) -> np.ndarray:
    """Log of target share over raw share by bucket. The raw share smooths the target's, so a bucket that no target has counts as little
    as its own frequency can tell."""
    raw = counts[0] + 1
    p = raw / raw.sum()
    t = counts[1] + p * max(1.0, min(counts[1].sum(), 0.5 * len(p)))
    return (np.log(t / t.sum()) - np.log(p)).astype(np.float32)


def term_ratio(counts: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """Log of target documents with a unigram over how many should have it, with one more on either side."""
    due = counts[0] * (documents[1] / max(documents[0], 1.0))
    return (np.log(counts[1] + 1) - np.log(due + 1)).astype(np.float32)


def weights(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, content (hash of the text), log_weight, worst (the least ratio of its unigrams, 0 without any), tokens of every row."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        import pyarrow as pa

        for part, texts in blocks(batches, 2, _BLOCK):
            tokens = _tokens(texts)
            found, at = features(tokens, len(models.grams))
            sums = np.concatenate([[0.0], np.cumsum(models.grams[found], dtype=np.float64)])
            weight, counted = sums[at[1:]] - sums[at[:-1]], np.diff(tokens.places)
            found, at = terms(tokens, len(models.terms))
            least = np.minimum.reduceat(np.append(models.terms[found], np.float32(0)), at[:-1]) if len(found) else np.zeros(len(counted), np.float32)
            least = np.where(counted > 0, np.minimum(least, 0), 0).astype(np.float64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(weight), pa.array(least), pa.array(counted.astype(np.int64))], names=["id", "content", "log_weight", "worst", "tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("content"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, content long, log_weight double, worst double, tokens long")


def gumbel(key: Column, seed: int) -> Column:
    """Gumbel noise from a key's MD5."""
    bits = F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f"|{seed}"))), 1, 13), 16, 10).cast("long")
    return -F.ln(-F.ln((bits + F.lit(0.5)) / F.lit(float(2**52))))


def kth_largest(values: DataFrame, k: int) -> float:
    """The k-th largest of the finite numbers in column `value`: the range that holds it is cut into 4,096 slots and counted, again and
    again, until one number is left."""
    double = F.col("value")
    bounds = values.agg(F.min(double).alias("lo"), F.max(double).alias("hi"), F.count("*").alias("n")).first()
    if not bounds["n"]:
        raise ValueError("no values")
    lo, hi, left = bounds["lo"], bounds["hi"], k
    steps = 4096
    while hi > lo:
        width = (hi - lo) / steps
        if lo + width == lo or hi - width == hi:
            rows = values.where((double >= lo) & (double <= hi)).groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("value")).limit(1 << 16).collect()
            for r in rows:
                left -= r["n"]
                if left <= 0:
                    return r["value"]
            return rows[-1]["value"]
        slot = F.least(F.floor((double - lo) / F.lit(width)), F.lit(steps - 1)).cast("int")
        inside = values.where((double >= lo) & (double <= hi)).groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        for r in sorted(inside.collect(), key=lambda r: -r["slot"]):  # `steps` rows at most
            if left <= r["n"]:
                lo, hi = r["lo"], r["hi"]
                break
            left -= r["n"]
    return lo


def bounded_labels(labels: DataFrame, most_labels: int) -> DataFrame:
    """id, good of at most most_labels labelled rows. Rows without a quality label are none; a missing toxic label counts as 0."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    rows = rows.select(F.col("doc_id").alias("id"), ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"))
    return rows.orderBy(F.xxhash64("id"), "id", "good").limit(most_labels)


def resample(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = 1 << 15,
    term_buckets: int = 1 << 18,
    keep_good: float = 0.99,
    most_labels: int = 50_000,
    seed: int = 7,
) -> DataFrame:
    """id, content, tokens, log_weight, worst, value (with noise) and selected of every row."""
    known = cut(bounded_labels(labels, most_labels).where("good"))
    held_out = F.pmod(F.xxhash64("id"), F.lit(4)) == 0
    grams, documents_with, n = count_models(docs, known.where(~held_out), buckets, term_buckets, id_col, text_col)
    scored = weights(docs, Models(log_ratio(grams), term_ratio(documents_with, n)), id_col, text_col)
    scored = cut(scored.withColumn("value", F.col("log_weight") + gumbel(F.col("id"), seed)).withColumn("rate", F.col("log_weight") / F.greatest("tokens", F.lit(1))))
    good = scored.join(F.broadcast(known.where(held_out).select("id").distinct()), "id")
    lowest = lambda c: (F.percentile_approx(c, 1 - keep_good, 10000) - F.coalesce(F.stddev_samp(c), F.lit(0.0)) / F.sqrt(F.count("*"))).alias(c)
    cuts = good.agg(lowest("rate"), lowest("worst")).first()
    if cuts["rate"] is None:
        return scored.withColumn("selected", F.lit(True)).drop("rate")
    drawn = scored.where(F.col("worst") >= cuts["worst"])
    k = drawn.where(F.col("rate") >= cuts["rate"]).count()
    if not k:
        return scored.withColumn("selected", F.lit(False)).drop("rate")
    threshold = kth_largest(drawn.select("value"), k)
    return scored.withColumn("selected", (F.col("worst") >= cuts["worst"]) & (F.col("value") >= F.lit(threshold))).drop("rate")


def keep_selected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that are selected, with all their columns."""
    key, content = fresh(docs, "key", "content")
    name = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    chosen = resample(docs, labels, id_col, text_col, **options).where("selected")
    chosen = chosen.select(name(F.col("id")).alias(key), F.col("content").alias(content))
    own = docs.withColumns({key: name(F.col(id_col)), content: F.xxhash64(text_col)})
    return own.join(chosen, [key, content], "left_semi").drop(key, content)
