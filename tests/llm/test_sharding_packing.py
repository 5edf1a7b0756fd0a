import hashlib
import math
import zlib
from collections import Counter, defaultdict

import public_tokenizers
from tokenizers import Tokenizer

from riskweave.llm import packing, sharding

FILE = public_tokenizers.path("byte_bpe_50k.json")


def slow_shard(key, weights):
    def score(i):
        u = (int(hashlib.md5(f"{key}|{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return -weights[i] / math.log(u)

    return max(range(len(weights)), key=score)


def test_rendezvous_matches_brute_force(table):
    rows = [(i, "ü" * (i % 5)) for i in range(600)]
    for weights in ([1.0] * 24, [1.0, 3.0, 0.5, 2.0]):
        got = sharding.shard_rows(table(rows), weights=weights, rows_at_once=50).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r["shard"] == slow_shard(r.doc_id, weights)
            assert r.grown_shard == slow_shard(r.doc_id, [*weights, 1.0])
            assert r.grown_shard in (r["shard"], len(weights))
            assert r["size"] == 8 + 2 * (r.doc_id % 5) and r.text_crc32 == zlib.crc32(("ü" * (r.doc_id % 5)).encode())
        slots = defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    counts = Counter(r["shard"] for r in got)
    assert counts[1] > counts[0] > counts[2]


def test_sharding_of_odd_rows(odd):
    got = sharding.shard_rows(odd).collect()
    assert len(got) == odd.count()
    assert len({(r["shard"], r.slot) for r in got}) == len(got)
    assert sharding.shard_rows(odd.limit(0)).count() == 0


def test_rows_that_repeat_are_numbered_in_chunks(spark):
    """Many rows alike, some twice and some once, in three groups: gapless numbers, whatever the size of a chunk."""
    rows = [(0, 7)] * 250 + [(1, i % 40) for i in range(60)] + [(2, 1)]
    df = spark.createDataFrame(rows, "g int, x int")
    for at_once in (7, 100, 10_000):
        got = sharding.gapless_slots(df, "g", rows_at_once=at_once).collect()
        assert sorted((r.g, r.x) for r in got) == sorted(rows)
        for g, n in ((0, 250), (1, 60), (2, 1)):
            assert sorted(r.slot for r in got if r.g == g) == list(range(n))


def check_packed(rows, texts, size):
    encode = Tokenizer.from_file(FILE)
    import numpy as np

    own = defaultdict(list)
    for r in rows:
        own[r.doc_id].append(r)
    for i, t in texts.items():
        ids = np.array([*encode.encode(t or "", add_special_tokens=False).ids, 0], np.uint32)
        pieces = sorted(own[i], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        assert sum(p.length for p in pieces) == len(ids) and len(pieces) == -(-len(ids) // size)
        assert all(p.length == size for p in pieces[1:])
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    total = sum(r.length for r in rows)
    return len(bins), -(-total // size)


def test_packing_matches_the_tokenizer_and_fills_sequences(table, prose):
    texts = dict(enumerate(prose(300, words=(1, 120)) + ["it's we'll  \n\n x 123 !?", "<|endoftext|> é 世界 😀", "a<|endoftext|><|endoftext|>b <|endoftext", "", "a" * 500]))
    got = packing.pack(table(list(texts.items())), FILE, size=128).collect()
    bins, least = check_packed(got, texts, 128)
    assert bins <= least * 1.02 + 1


def test_packing_of_odd_rows(odd, table):
    got = packing.pack(odd, FILE).collect()
    assert sum(r.doc_id == 3 for r in got) == 2 and {r.doc_id for r in got} == {None, *range(1, 10)}
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert packing.pack(odd.limit(0), FILE).count() == 0
    check_packed(packing.pack(table([(1, "word " * 9000), (2, None)]), FILE).collect(), {1: "word " * 9000, 2: None}, 2048)


def test_best_two_fit_replaces_the_smallest():
    """Greedy takes 6 and 3 of 10; 3 gives way to 2 and 2, which fill the gap."""
    steps = packing.plan({6: 1, 3: 2, 2: 2}, 10)
    assert steps[0] == (1, [6, 2, 2])
    assert sum(t for t, _ in steps) == 2
    used = Counter()
    for times, lengths in packing.plan({7: 10**9, 3: 10**9 + 5, 1: 17}, 10):
        for n in lengths:
            used[n] += times
    assert used == {7: 10**9, 3: 10**9 + 5, 1: 17}
