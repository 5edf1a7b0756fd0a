"""Language identification of mixed-language texts.

Words are runs of letters and marks. Script ranges narrow the candidates: a language is one for a word if enough of its training
letters were in the word's script (a script that no language has leaves all of them). Each candidate scores the word by the log
probability of its hashed letter n-grams (pairs and triples, with the word's ends), less that of the best candidate, and not below a
floor, so that one odd word cannot decide a text. Viterbi decoding over the words, with a penalty for each switch, labels them, and
runs of one label are the text's spans. All texts of a block are decoded together, one word of each at a time.

The model counts n-grams of every labelled text: `buckets` numbers a language, whatever the table's size. Counts are summed inside
each task before the shuffle.

Defined cases: a null text, or one without letters, has no spans; rows without a language are not learned from; without any labelled
text there are no languages and no spans; ties go to the language that sorts first; very long texts are labelled whole, in a block of
their own; repeated rows are labelled one by one; an empty table gives an empty result; other columns are never read, whatever their names.
"""

from __future__ import annotations

import sys
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.pretokens import blocks

_BLOCK = 4 << 20
_LETTER, _MARK = 1, 2
UNKNOWN = "und"

#: First code points of ranges and their scripts. Fixed values.
_SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"), (0x08A0, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"),
    (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"),
    (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"),
    (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1CC0, "other"), (0x1D00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"),
    (0x2C80, "other"), (0x2DE0, "cyrillic"), (0x2E00, "other"), (0x2E80, "han"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"),
    (0x3190, "other"), (0x31F0, "kana"), (0x3200, "other"), (0x3400, "han"), (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"),
    (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"),
    (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"),
    (0xFFE0, "other"), (0x20000, "han"), (0x323B0, "other"),
)
SCRIPTS = tuple(sorted({s for _, s in _SCRIPTS}))


class Model(NamedTuple):
    languages: tuple[str, ...]
    scores: np.ndarray  # languages x buckets, log probabilities
    allowed: np.ndarray  # scripts x languages


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of code points: letter or mark, number of the script, lower case."""
    import regex

    size = sys.maxunicode + 1
    kind, lower = np.zeros(size, np.uint8), np.arange(size, dtype=np.uint32)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, size)]))
    shift = lambda i: i if i < 0xD800 else i + 0x800
    for value, pattern in ((_LETTER, r"\p{L}+"), (_MARK, r"\p{M}+")):
        for m in regex.finditer(pattern, every):
            kind[shift(m.start()) : shift(m.end() - 1) + 1] = value
    for m in regex.finditer(r"\p{Lu}", every):
        small = m.group().lower()
        if len(small) == 1:
            lower[ord(m.group())] = ord(small)
    script = np.zeros(size, np.uint8)
    begins = [b for b, _ in _SCRIPTS] + [size]
    for (b, name), e in zip(_SCRIPTS, begins[1:], strict=True):
        script[b:e] = SCRIPTS.index(name)
    return kind, script, lower


class Words(NamedTuple):
    first: np.ndarray  # of each word, in characters of the block
    last: np.ndarray  # one past it
    script: np.ndarray
    buckets: np.ndarray  # of n-grams
    at: np.ndarray  # where each word's n-grams begin, one more than words
    places: np.ndarray  # of each text's words, one more than texts
    begin: np.ndarray  # of each text in characters
    letters: np.ndarray  # of each text


def words(texts: list[str], buckets: int) -> Words:
    kind_of, script_of, lower = _tables()
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    begin = np.append(0, ends)
    points = np.frombuffer(("\n".join(texts) + "\n" if texts else "").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kind_of[points]
    inside = np.zeros(len(points) + 1, bool)
    inside[1:] = kind > 0
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edges[::2], edges[1::2]
    # All letters of words end to end, each word between two zeros.
    sizes = last - first
    to = np.cumsum(sizes + 1)
    letters = np.zeros(int(to[-1]) + 2 if len(to) else 2, np.uint64)
    there = np.flatnonzero(kind > 0)
    letters[there - np.repeat(first, sizes) + np.repeat(to - sizes, sizes)] = lower[points[there]] if len(there) else 0
    # One pair and one triple begin at each letter and at the zero before it.
    with np.errstate(over="ignore"):
        pair = letters[:-1] * np.uint64(0x9E3779B97F4A7C15) + letters[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        third = letters[2:].copy()
        third[to - 1] = 0  # a word's last triple has nothing of the next word, which may be another text's
        triple = np.zeros_like(pair)
        triple[:-1] = pair[:-1] * np.uint64(0xD6E8FEB86659FD93) + third * np.uint64(0xA0761D6478BD642F) + np.uint64(1)
        out = np.empty((len(pair), 2), np.uint32)
        for j, h in enumerate((pair, triple)):
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            out[:, j] = (h >> np.uint64(33)) % np.uint64(buckets)
    at = np.append(0, 2 * to)
    heads = np.flatnonzero(kind == _LETTER)
    return Words(first, last, script_of[points[first]] if len(first) else np.zeros(0, np.uint8), out[: len(out) - 1].ravel()[: at[-1]], at, np.searchsorted(first, begin), begin, np.diff(np.searchsorted(heads, begin)))


def count(docs: DataFrame, text_col: str, lang_col: str, buckets: int) -> DataFrame:
    """lang, bucket, n: n-grams of texts by language; bucket -1 - s counts the letters in script s."""
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))

    def run(batches):
        import pyarrow as pa

        totals: dict[str, np.ndarray] = {}
        for part, texts in blocks(batches, 0, _BLOCK):
            w = words(texts.to_pylist(), buckets)
            langs = np.array(part.column(1).to_pylist(), object)
            for lang in sorted(set(langs)):
                total = totals.setdefault(lang, np.zeros(buckets + len(SCRIPTS), np.int64))
                own = np.repeat(langs == lang, np.diff(w.places))
                total[:buckets] += np.bincount(w.buckets[np.repeat(own, np.diff(w.at))], minlength=buckets)
                total[buckets:] += np.bincount(w.script[own], (w.last - w.first)[own], minlength=len(SCRIPTS)).astype(np.int64)
        for lang, total in totals.items():
            some = np.flatnonzero(total)
            bucket = np.where(some < buckets, some, buckets - 1 - some)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(bucket.astype(np.int32)), pa.array(total[some])], names=["lang", "bucket", "n"])

    return rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", buckets: int = 1 << 15, least_share: float = 0.02) -> Model:
    """A model of all labelled rows. A script is a language's if it has `least_share` of the language's letters."""
    counted: dict[str, np.ndarray] = {}
    for r in count(docs, text_col, lang_col, buckets).toLocalIterator():  # buckets and scripts by language, whatever the table
        own = counted.setdefault(r["lang"], np.zeros(buckets + len(SCRIPTS)))
        own[r["bucket"] if r["bucket"] >= 0 else buckets - 1 - r["bucket"]] = r["n"]
    languages = tuple(sorted(counted))
    grams = np.array([counted[k][:buckets] for k in languages]).reshape(-1, buckets)
    letters = np.array([counted[k][buckets:] for k in languages]).reshape(-1, len(SCRIPTS))
    # What all languages have together smooths each of them.
    shared = (grams.sum(axis=0) + 1) / (grams.sum() + buckets)
    weight = np.minimum(grams.sum(axis=1, keepdims=True), 0.02 * buckets) + 1
    scores = np.log((grams + weight * shared) / (grams.sum(axis=1, keepdims=True) + weight))
    allowed = letters.T > least_share * np.maximum(letters.sum(axis=1), 1)
    allowed[~allowed.any(axis=1)] = True
    return Model(languages, scores.astype(np.float32), allowed)


def word_scores(w: Words, model: Model, floor: float) -> np.ndarray:
    """Log probabilities by word and language, at most 0 for the best candidate and not below -floor."""
    out = np.empty((len(w.first), len(model.languages)))
    for j, table in enumerate(model.scores):
        sums = np.append(0.0, np.cumsum(table[w.buckets], dtype=np.float64))
        out[:, j] = sums[w.at[1:]] - sums[w.at[:-1]]
    out[~model.allowed[w.script]] = -np.inf
    out -= out.max(axis=1, keepdims=True)
    return np.maximum(out, -floor)


def viterbi(scores: np.ndarray, places: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word; places: where the texts' words begin (one more than texts). Texts advance together, a word at a time."""
    n, k = scores.shape
    sizes = np.diff(places)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = places[:-1][order], sizes[order]
    steps = int(sizes[0]) if len(sizes) else 0
    label = np.zeros(n, np.int8 if k < 128 else np.int32)
    if not steps or k == 1:
        return label
    active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(steps), side="right")
    switched, best_before = np.zeros((n, k), bool), np.zeros(n, label.dtype)
    value = scores[begin[: active[0]]]
    final = np.empty((len(sizes), k))
    for t in range(1, steps):
        m = int(active[t])
        if m < len(value):
            final[m : len(value)] = value[m:]
            value = value[:m]
        at = begin[:m] + t
        best = value.argmax(axis=1)
        other = value[np.arange(m), best][:, None] - penalty
        go = other > value
        switched[at] = go
        best_before[at] = best
        value = np.where(go, other, value) + scores[at]
    final[: len(value)] = value
    now = final[: active[0]].argmax(axis=1).astype(label.dtype)
    for t in range(steps - 1, -1, -1):
        m = int(active[t])
        at = begin[:m] + t
        label[at] = now[:m]
        now[:m] = np.where(switched[at, now[:m]], best_before[at], now[:m])
    return label


def label_spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = 12.0, floor: float = 8.0) -> DataFrame:
    """id, letters and spans (first and one past the last character, letters of words, lang) of every row."""
    kind = dict(docs.dtypes)[id_col]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages

    def run(batches):
        import pyarrow as pa

        model = sent.value
        fields = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("letters", pa.int64()), ("lang", pa.string())]))
        for part, texts in blocks(batches, 1, _BLOCK):
            w = words(texts.to_pylist(), model.scores.shape[1])
            spans: list[list] = [[] for _ in range(part.num_rows)]
            if model.languages and len(w.first):
                label = viterbi(word_scores(w, model, floor), w.places, penalty)
                new = np.ones(len(label), bool)
                new[1:] = label[1:] != label[:-1]
                new[w.places[:-1][w.places[:-1] < len(label)]] = True
                heads = np.flatnonzero(new)
                tails = np.append(heads[1:], len(label)) - 1
                size = np.add.reduceat(w.last - w.first, heads)
                doc = np.searchsorted(w.places, heads, side="right") - 1
                base = w.begin[doc]
                for d, a, b, n, lang in zip(doc.tolist(), (w.first[heads] - base).tolist(), (w.last[tails] - base).tolist(), size.tolist(), label[heads].tolist(), strict=True):
                    if w.letters[d]:
                        spans[d].append({"first": a, "last": b, "letters": n, "lang": model.languages[lang]})
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(w.letters), pa.array(spans, fields)], names=["id", "letters", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, letters long, spans array<struct<first:long,last:long,letters:long,lang:string>>")


def main_language(spans: Column, languages: tuple[str, ...]) -> Column:
    """struct(lang, share): the language of most letters in the spans, and its share of them; UNKNOWN and 0 without spans."""
    if not languages:
        return F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("share"))
    size = lambda kept: F.aggregate(kept, F.lit(0).cast("long"), lambda n, s: n + s["letters"])
    own = lambda k: size(F.filter(spans, lambda s: s["lang"] == k))
    of = [F.struct(own(k).alias("n"), F.lit(-i).alias("order"), F.lit(k).alias("lang")) for i, k in enumerate(languages)]
    best = F.greatest(*of) if len(of) > 1 else of[0]
    known = F.size(spans) > 0
    share = best["n"] / F.greatest(size(spans), F.lit(1).cast("long"))
    return F.struct(F.when(known, best["lang"]).otherwise(UNKNOWN).alias("lang"), F.when(known, share).otherwise(0.0).alias("share"))
