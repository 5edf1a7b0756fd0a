import hashlib
import random
from collections import defaultdict

import xxhash

from riskweave.llm import exact_dedup, simhash


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_exact_groups_match_brute_force(table, prose):
    texts = prose(60)
    rows = [(i, texts[i % 45] if i % 3 else texts[i % 45].upper()) for i in range(200)] + [(900, None), (901, "")]
    got = {r.doc_id: r for r in exact_dedup.exact_groups(table(rows), keep="max").collect()}
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    assert len(got) == len(rows)
    for t, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())


def test_exact_copies_leave_one_row(table, prose, odd):
    texts = prose(20)
    docs = table([(i, texts[i % 20]) for i in range(100)] + [(99, texts[99 % 20])] * 3)
    kept = exact_dedup.drop_exact_copies(docs, keep="min").collect()
    assert sorted(r.doc_id for r in kept) == list(range(20))
    got = exact_dedup.drop_exact_copies(odd, keep="max")
    assert got.columns == odd.columns
    assert sorted((r.doc_id, (r.text or "")[:5]) for r in got.collect()) == [(2, ""), (4, "A"), (6, "word0"), (7, "!!! ??"[:5]), (8, "é ü 世界 \x00 x"[:5]), (9, " \n\t ")]
    assert exact_dedup.drop_exact_copies(odd.limit(0)).count() == 0
    assert exact_dedup.exact_groups(odd).count() == odd.count()


def slow_fingerprint(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", lower(text)) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps):
    """id -> smallest id reachable; fps: id -> fingerprint."""
    parent = {i: i for i in fps}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(fps)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_simhash_matches_brute_force(table, prose):
    texts, r = prose(40, words=(3, 200)), random.Random(3)
    rows = []
    for i in range(160):
        words = texts[i % 40].split()
        for _ in range(r.randint(0, 2)):
            words[r.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words) if i % 7 else " ".join(words).upper()))
    rows += [(500, None), (501, " \n"), (502, "one two"), (503, "One Two")]
    got = {x.id: x for x in simhash.near_classes(table(rows)).collect()}
    fps = {i: slow_fingerprint(t) for i, t in rows}
    assert {i: x.fp % 2**64 for i, x in got.items()} == fps
    assert {i: x.component_id for i, x in got.items()} == slow_components(fps)


def test_links_in_crowded_balls_and_chains(spark):
    """Fingerprints near each other, more than are compared by pairs, and a chain: the same components as all pairs give."""
    r = random.Random(5)
    fps = {0, 2**64 - 1}
    for _ in range(3):
        base = r.getrandbits(64)
        for _ in range(150):
            x = base
            for b in r.sample(range(64), r.randint(0, 4)):
                x ^= 1 << b
            fps.add(x)
    x = r.getrandbits(64)
    for _ in range(40):
        for b in r.sample(range(64), 4):
            x ^= 1 << b
        fps.add(x)
    fps |= {r.getrandbits(64) for _ in range(200)}
    signed = [x - (x >> 63 << 64) for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = slow_components({x: x % 2**64 for x in signed})
    for compared, halves_up_to in ((2, 1 << 29), (16, 1 << 29), (16, 0)):
        got = {x.node: x.label for x in simhash.classes(df, compared, halves_up_to).collect()}
        assert {x: got.get(x, x) for x in signed} == want


def test_near_copies_leave_one_row(odd, table):
    got = simhash.drop_near_copies(odd)
    assert got.columns == odd.columns
    assert sorted((r.doc_id, (r.text or "")[:3]) for r in got.collect()) == [(1, ""), (3, "a"), (5, "wor"), (7, "!!!"), (8, "é ü")]
    assert simhash.drop_near_copies(odd.limit(0)).count() == 0
    only_null = table([(None, "a b c d e f"), (None, "a b c d e f")])
    assert [r.doc_id for r in simhash.drop_near_copies(only_null).collect()] == [None]


def test_groups_are_joined_large_and_small(spark):
    """Groups beyond the bound are broadcast, the others joined, rows without a group stay with nulls; the same result for every bound."""
    from pyspark.sql import functions as F

    from riskweave.llm.common import cut, forget, join_groups

    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 30}", "x") for i in range(300)] + [(900, "none", "x")], "id long, k string, salt string")
    groups = cut(rows.where("k != 'none'").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least")))
    want = sorted((r.id, r.k, r.salt, None if r.k == "none" else min(x for x in range(300) if ("hot" if x % 3 else f"k{x % 30}") == r.k)) for r in rows.collect())
    for most in (2, 20, 4096):  # one large group, one again, all
        got = join_groups(rows, groups, ["k"], "n", "id", most)
        assert got.columns == ["id", "k", "salt", "least"] and sorted(map(tuple, got.collect())) == want
    none = cut(groups.limit(0))
    assert join_groups(rows, none, ["k"], "n", "id").where("least IS NULL").count() == 301
    forget(groups)
    assert not __import__("os").path.exists(groups.cut_path.removeprefix("file:"))
