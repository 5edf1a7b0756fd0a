import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from riskweave.llm import quality, substring_dedup
from riskweave.llm.common import cut
from riskweave.llm.substring_dedup import Shape, spans
from riskweave.sources.caches import exists

SHAPE = Shape()
MASK = 2**64 - 1
SPACE = "\t\n\x0b\x0c\r "


def mixed(h, odd):
    h ^= h >> 32
    h = h * odd & MASK
    return h ^ h >> 29


def word_hash(word):
    """The hash of a word as the operator has it, with plain numbers."""
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in word.encode())
    h = sum((b + 1) * pow(substring_dedup._ODD[1], k, 2**64) for k, b in enumerate(raw))
    return mixed((h + len(raw) * substring_dedup._ODD[4]) & MASK, substring_dedup._ODD[2])


def slow_cuts(words, most):
    """Numbers of words before each cut of a long sentence, with its ends."""
    h, n = [word_hash(w) for w in words], len(words)
    odd = substring_dedup._ODD
    m = [MASK, MASK, *(mixed((h[i] * odd[0] + h[i - 1] * odd[2] + h[i - 2] * odd[3]) & MASK, odd[0]) for i in range(2, n))]
    out = [0]
    for i in range(2, n):
        near = [j for d in range(1, substring_dedup._NEAR + 1) for j in (i - d, i + d) if 0 <= j < n]
        if i == n - 1 or all(m[i] < m[j] for j in near):
            while i + 1 - out[-1] > most:
                out.append(out[-1] + most)
            out.append(i + 1)
    return out


def sentences(text, piece_words):
    """(start, end, lower-cased words) of sentences; each end is the next start."""
    words = [(m.start(), m.end()) for m in re.finditer(f"[^{SPACE}]+", text)]
    groups, own = [], []
    for k, (a, b) in enumerate(words):
        own.append((a, b))
        last = k == len(words) - 1
        if last or text[b - 1] in ".!?" or "\n" in text[b : words[k + 1][0]]:
            groups.append(own)
            own = []
    pieces = []
    for g in groups:
        lower = ["".join(c.lower() if "A" <= c <= "Z" else c for c in text[a:b]) for a, b in g]
        cuts = slow_cuts(lower, piece_words) if len(g) > piece_words else [0, len(g)]
        pieces += [(g[x][0], lower[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]
    ends = [*(a for a, _ in pieces[1:]), len(text)]
    return [(a, e, w) for (a, w), e in zip(pieces, ends, strict=False)]


def slow_drop(docs, least_sentences=3, least_words=20, piece_words=16):
    """Every span of every document against all others, with plain loops."""
    places = defaultdict(list)
    for i, t in docs:
        own = sentences(t or "", piece_words)
        n = len(own)
        for a in range(n):
            for b in range(a + least_sentences, n + 1):
                size = lambda a, b: b - a >= least_sentences and sum(len(w) for _, _, w in own[a:b]) >= least_words
                if size(a, b) and not (size(a + 1, b) and size(a, b - 1)):
                    places[tuple(x for _, _, w in own[a:b] for x in w)].append((i, own[a][0], own[b - 1][1]))
    drop = defaultdict(set)
    for found in places.values():
        for i, a, b in sorted(found)[1:]:
            drop[i].update(range(a, b))
    return {i: "".join(c for k, c in enumerate(t or "") if k not in drop[i]) for i, t in docs}


def test_spans_are_the_shortest_runs():
    """Sentences of so many words, as runs (first, one past the last)."""
    runs = lambda counts, shape: {*zip(*(x.tolist() for x in spans(pa.array([" ".join(" ".join(f"w{k}x{i}" for i in range(n)) + "." for k, n in enumerate(counts))]), shape)[3:5]), strict=True)}
    assert runs([10, 10, 10, 1], Shape(3, 20, 40)) == {(0, 3), (1, 4)}
    assert runs([1, 1, 1, 30], Shape(3, 20, 40)) == {(0, 4), (1, 4)}
    assert runs([5, 5], Shape(3, 1, 40)) == set()


def test_sentences_tile_and_long_ones_are_cut(prose):
    texts = ["One two. Three four!\n\nfive" + " six" * 40 + " Seven? eight", *(re.sub(r"\.", "", t) for t in prose(20, words=(3, 90))), "", " \n", " a", "é 世界. É?\n\tb"]
    found = spans(pa.array(texts), SHAPE)
    for i, t in enumerate(texts):
        own, mine = sentences(t, 16), found.sentence_text == i
        assert [(a, b) for a, b, _ in own] == [*zip(found.start[mine].tolist(), found.stop[mine].tolist(), strict=True)]
        assert max((len(w) for _, _, w in own), default=0) <= 16 and [x for _, _, w in own for x in w] == re.sub("[A-Z]", lambda m: m[0].lower(), t).split()


def test_common_hashes_are_all_found():
    """A summary of few counters keeps every key that is common enough, however the counts come in."""
    import random

    r = random.Random(1)
    keys, counts, all_ = np.zeros(0, np.int64), np.zeros(0, np.int64), []
    for _ in range(50):
        new = [r.choice([1, 2, 3]) if r.random() < 0.3 else r.randrange(10, 10**6) for _ in range(200)]
        all_ += new
        keys, counts = substring_dedup._summed(np.append(keys, new), np.append(counts, np.ones(200, np.int64)), 32)
    assert len(keys) <= 32 and {1, 2, 3} <= {*keys.tolist()}
    for k, n in zip(keys.tolist(), counts.tolist(), strict=True):
        assert all_.count(k) - len(all_) / 32 <= n <= all_.count(k)


def test_common_hashes_of_a_table(spark):
    """Hashes of more than two in `counters` rows are all named, and fewer than `counters`, however the rows are dealt."""
    import random

    r = random.Random(5)
    values = [7] * 3000 + [8] * 700 + [9] * 30 + [r.randrange(100, 10**9) for _ in range(6000)]
    r.shuffle(values)
    rows = spark.createDataFrame([(v,) for v in values], "h1 long").repartition(5)
    for counters in (4, 32, 1000):
        got = {x.h1 for x in substring_dedup.common_hashes(rows, counters).collect()}
        assert {v for v in (7, 8, 9) if values.count(v) > 2 * len(values) / counters} <= got <= {7, 8, 9} and len(got) < counters


def test_inner_tables_go(spark, table, prose, monkeypatch):
    """Only the table that the result reads stays in the shared folder."""
    made = []
    monkeypatch.setattr(substring_dedup, "cut", lambda df: made.append(cut(df)) or made[-1])
    rows = list(enumerate(prose(4, words=(60, 60)) * 2))
    assert substring_dedup.drop_repeats(table(rows)).where("length(text) = 0").count() == 4
    assert [exists(spark, t.cut_path) for t in made] == [False, True]


def test_repeats_match_brute_force(table, prose):
    texts = prose(40, words=(30, 150), seed=4)
    passage, single = prose(2, words=(60, 60), seed=9)
    single = re.sub(r"\.", "", single)
    rows = []
    for i, t in enumerate(texts):
        lines = [t]
        if i % 3 == 0:
            lines.insert(i % 2, passage)
        if i % 5 == 0:
            lines.append(single)
        rows.append((i, "\n".join(lines)))
    want = slow_drop(rows)
    for common in (2048, 3, 0):  # with all, some or no hash dealt as a common one
        got = {r.doc_id: r for r in substring_dedup.drop_repeats(table(rows), chars_col="n_chars", common=common).collect()}
        for i, t in rows:
            assert got[i].text == want[i] and got[i].n_chars == len(want[i])
    holders = [i for i in want if passage in want[i]]
    assert holders == [0]
    clean = [i for i in range(40) if i % 3 and i % 5]
    assert all(want[i] == texts[i] for i in clean)


def test_passages_are_found_at_every_offset(table):
    """60 words in the midst of texts without full stops, after every number of words."""
    import random

    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeiounrst") for _ in range(r.randint(3, 9)))
    passage = " ".join(word() for _ in range(60))
    text = lambda k: " ".join([*(word() for _ in range(20 + k)), passage, *(word() for _ in range(30))])
    rows = [(k, text(k)) for k in range(17)]
    got = {x.doc_id: x for x in substring_dedup.drop_repeats(table(rows), report=("spans", "chars")).collect()}
    want = slow_drop(rows)
    assert all(got[k].text == want[k] for k, _ in rows)
    assert got[0].spans == 0 and all(got[k].chars >= len(passage) / 2 for k in range(1, 17))


def test_repeats_of_odd_rows(odd):
    got = substring_dedup.drop_repeats(odd, chars_col="n_chars", report=("a", "b"))
    assert got.columns == [*odd.columns, "a", "b"]
    rows = got.collect()
    assert len(rows) == odd.count()
    assert {r.doc_id: len(r.text) > 1000 for r in rows if r.doc_id in (5, 6)} == {5: True, 6: False}
    assert substring_dedup.drop_repeats(odd.limit(0)).count() == 0
    clash = substring_dedup.drop_repeats(odd, report=("key", "n"))
    assert {"key", "n", "key_in", "n_in"} <= {*clash.columns} and clash.where("key_in != 'x'").count() == 0


def test_repeats_inside_a_text_and_of_one_id(table, prose):
    """A passage that a text has twice stays where it stands first; rows with one id are one document."""
    passage, a, b = prose(3, words=(60, 60), seed=12)
    rows = [(1, "\n".join([passage, a, passage])), (2, "\n".join([b, passage])), (2, "\n".join([b, passage]))]
    got = substring_dedup.drop_repeats(table(rows), report=("spans", "chars")).collect()
    want = slow_drop(rows[:2])
    assert sorted(r.text for r in got) == sorted([want[1], want[2], want[2]]) and passage not in want[2] and want[1].count(passage) == 1
    assert min(r.spans for r in got) > 0


def slow_features(text, buckets):
    mask = 2**64 - 1
    tokens = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\t-\r ]+", text.encode())
    one = []
    for t in tokens:
        h = sum((b + 1) * pow(0x9E3779B97F4A7C15, k, 2**64) for k, b in enumerate(t)) & mask
        h ^= h >> 29
        h = h * 0xBF58476D1CE4E5B9 & mask
        one.append(h ^ h >> 32)
    two = [(a * 0x94D049BB133111EB + b) * 0x9E3779B97F4A7C15 & mask for a, b in zip(one, one[1:], strict=False)]
    return sorted((h >> 20) % buckets for h in one + two)


def test_features_match_brute_force(prose):
    texts = [*prose(30), "", "a", "!!", " ", "x!!y  é-世界\x00", "", "\n"]
    for part in (pa.array(texts), pa.array(["zz", *texts]).slice(1)):
        found, at = quality.features(quality._tokens(part), 997)
        assert len(at) == len(texts) + 1 and at[-1] == len(found)
        for i, t in enumerate(texts):
            assert sorted(found[at[i] : at[i + 1]].tolist()) == slow_features(t, 997)


@pytest.fixture
def labelled(spark, table, prose):
    good, bad = prose(150, seed=1), [t.upper().replace(" ", "!! ") for t in prose(50, seed=2)]
    docs = table(list(enumerate(good + bad)))
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(0, 200, 2)] + [(1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_resampling_rejects_junk(labelled):
    docs, labels = labelled
    rows = quality.resample(docs, labels, buckets=256).collect()
    assert len(rows) == 200
    kept = {r.id for r in rows if r.selected}
    assert len(kept & set(range(150))) >= 145 and len(kept & set(range(150, 200))) <= 2
    assert {r.doc_id for r in quality.keep_selected(docs, labels, buckets=256).collect()} == kept


def test_resampling_matches_brute_force(labelled):
    docs, labels = labelled
    texts = {r.doc_id: r.text for r in docs.collect()}
    from pyspark.sql import functions as F

    good = {r.doc_id for r in labels.where((F.pmod(F.xxhash64("doc_id"), F.lit(4)) != 0)).collect() if r.quality == 1} & set(texts)
    counts = np.zeros((2, 64))
    for i, t in texts.items():
        for f in slow_features(t, 64):
            counts[0, f] += 1
            counts[1, f] += i in good
    ratio = quality.log_ratio(counts)
    rows = quality.resample(docs, labels, buckets=64).collect()
    for r in rows:
        assert r.log_weight == pytest.approx(sum(float(ratio[f]) for f in slow_features(texts[r.id], 64)), abs=1e-4)
    values = sorted((r.value for r in rows), reverse=True)
    k = sum(r.selected for r in rows)
    assert all(r.selected == (r.value >= values[k - 1]) for r in rows)


def test_kth_largest(spark):
    import random

    r = random.Random(2)
    values = [r.gauss(0, 10 ** r.randint(-3, 5)) for _ in range(3000)] + [1.5] * 500
    df = spark.createDataFrame([(v,) for v in values], "value double")
    for k in (1, 2, 777, 1500, 3500):
        assert quality.kth_largest(df, k) == sorted(values, reverse=True)[k - 1]


def test_resampling_of_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.keep_selected(odd, none).count() == odd.count()
    one = spark.createDataFrame([(5, 1, 0), (7, 0, None)], "doc_id long, quality int, toxic int")
    got = quality.resample(odd, one)
    assert got.count() == odd.count() and got.where("selected").count() > 0
    kept = quality.keep_selected(odd, one)
    assert kept.columns == odd.columns and kept.count() == got.where("selected").count()
    assert quality.resample(odd.limit(0), one).count() == 0
