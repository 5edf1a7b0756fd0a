"""Multiset hashes of documents, periodic runs of words, and k-means by balls, held against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.llm import ball_kmeans, multiset_hash, periodic_runs, queries

SPACE = re.compile(r"[ \t-\r]+")


def slow_lanes(text):
    exact, signs, n = [0] * 8, [0] * 64, 0
    for p in (text or "").split("\n"):
        if not p:
            continue
        sha = hashlib.sha256(p.encode()).hexdigest()
        exact = [(x + int(sha[8 * i : 8 * i + 8], 16)) % 2**32 for i, x in enumerate(exact)]
        words = [w for w in SPACE.split(p) if w]
        for a, b in zip(words, [*words[1:], ""]):
            md5 = hashlib.md5(f"{a} {b}".encode()).hexdigest()
            lo, hi = int(md5[:8], 16), int(md5[8:16], 16)
            signs = [x + (((hi if i >= 32 else lo) >> i % 32) & 1) for i, x in enumerate(signs)]
            n += 1
    return [*exact, n, *signs]


def slow_likeness(a, b):
    if a == b:
        return 1.0
    x, y = ([2 * c - v[8] for c in v[9:]] for v in (a, b))
    size = math.sqrt(sum(c * c for c in x) * sum(c * c for c in y))
    return max(0.0, min(1.0, sum(p * q for p, q in zip(x, y, strict=True)) / size)) if size else 0.0


def test_paragraphs_in_any_order_come_and_go(spark, prose):
    lines = prose(6, seed=3)
    texts = ["\n".join(lines), "\n".join(lines[::-1]), "\n\n".join(lines), "\n".join(lines[:4]), "\n".join(lines[4:]), "\n".join([*lines, lines[0]])]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    of = {r["id"]: r["lanes"] for r in multiset_hash.lanes(rows, ["id"], "text").collect()}
    assert of == {i: slow_lanes(t) for i, t in enumerate(texts)}
    assert of[0] == of[1] == of[2] != of[5]
    sums = spark.createDataFrame([(of[0], of[3], of[4])], "a array<long>, b array<long>, c array<long>")
    assert tuple(sums.select(multiset_hash.add(F.col("b"), F.col("c")), multiset_hash.remove(F.col("a"), F.col("c"))).first()) == (of[0], of[3])


def slow_edits(rows):
    """By row: n_chars, edited_sha256, both fingerprints and likenesses. Rows that repeat are one document."""
    known = sorted({(i is None, i or 0, hashlib.md5((t or "").encode()).digest(), t or "") for i, t in rows})
    out = defaultdict(list)
    for k, (none, i, _, t) in enumerate(known):
        u = known[(k + 1) % len(known)][3]
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        a, b, c = slow_lanes(t), slow_lanes(edited), slow_lanes(u)
        form = lambda v: "".join(f"{x:08x}" for x in v)
        row = (None if none else i, len(t), hashlib.sha256(edited.encode()).hexdigest(), form(a), form(b), slow_likeness(a, b), slow_likeness(a, c))
        out[row] = sum((j, s or "") == (row[0], t) for j, s in rows)
    return sorted((row for row, n in out.items() for _ in range(n)), key=repr)


def edits(docs):
    rows = multiset_hash.edited_fingerprints(docs)
    own, edited, following = F.col("lanes"), F.col("edited_lanes"), F.col("next_lanes")
    form, like = multiset_hash.text_form, multiset_hash.likeness
    rows = rows.select("doc_id", "n_chars", "edited_sha256", form(own), form(edited), like(own, edited), like(own, following))
    return sorted(map(tuple, rows.collect()), key=repr)


def test_edited_fingerprints_match_brute_force(spark, table, odd, prose):
    rows = [(7 * i % 41, "\n".join(t)) for i, t in enumerate(zip(prose(41, seed=5), prose(41, seed=6), strict=True))] + [(50, "世界 é\nü a"), (51, "x")]
    assert edits(table(rows).repartition(5)) == slow_edits(rows)
    some = odd.where("doc_id < 5 OR doc_id > 6 OR doc_id IS NULL")
    assert edits(some) == slow_edits([(r["doc_id"], r["text"]) for r in some.collect()])
    assert edits(odd.where("doc_id = 5")) == slow_edits([(r["doc_id"], r["text"]) for r in odd.where("doc_id = 5").collect()])
    assert edits(odd.limit(0)) == []


def test_documents_follow_over_ranges(spark, table):
    rows = [(i * 3, f"text {i}") for i in range(200)]
    got = multiset_hash.followers(table(rows), rows_at_once=9).collect()
    assert {r["key"]: r["next_key"] for r in got} == {f"={i * 3}": f"={(i + 1) % 200 * 3}" for i in range(200)}


def test_op11_needs_no_python_workers(spark, tmp_path, table):
    table([(1, "a b\nc"), (2, "d")]).write.parquet(str(tmp_path / "documents.parquet"))
    plan = queries.op11_multiset_hash(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def slow_runs(words, least=6, periods=4):
    """Of all stretches: period by period, every maximal stretch of equal words p apart; of equal stretches the smallest period."""
    found = {}
    for p in range(1, len(words) // periods + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            length = j - i + p
            if j > i and length >= max(least, periods * p) and not any(all(words[k] == words[k + q] for k in range(i, i + length - q)) for q in range(1, p)):
                found[i, p] = (i, length, p)
            i = max(j, i + 1)
    return [found[k] for k in sorted(found)]


def slow_collapsed(words, runs):
    gone = {i for a, n, p in runs for i in range(a + p, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return [w for w in SPACE.split(text or "") if w]


def periodic(r, n):
    words = [r.choice("abc" if r.random() < 0.9 else "abcdef") for _ in range(n)]
    for _ in range(r.randint(0, 3)):
        block = [r.choice("abcd") for _ in range(r.randint(1, 6))]
        at = r.randint(0, len(words))
        words[at:at] = (block * 12)[: r.randint(1, 12 * len(block))]
    return words


def test_runs_match_brute_force(spark, table):
    r = random.Random(8)
    texts = [r.choice([" ", "\n", "  \t"]).join(periodic(r, r.randint(0, 60))) + r.choice(["", " "]) for _ in range(400)]
    texts += ["a " * 5000, "a b " * 3000 + "c", " ".join("ab" * 10) + " " + " ".join("abc" * 10), "é ü é ü é ü é ü", "a\x1ca a\x00 a", None, "", " \n "]
    got = periodic_runs.find_runs(table(list(enumerate(texts)))).collect()
    assert len(got) == len(texts) and sum(len(x["runs"]) for x in got) > 100
    for x in got:
        words = split(texts[x["doc_id"]])
        if len(words) < 1000:
            want = slow_runs(words)
            assert [tuple(y) for y in x["runs"]] == want and x["n_words"] == len(words), texts[x["doc_id"]]
            assert x["collapsed"] == slow_collapsed(words, want)
    by = {x["doc_id"]: x for x in got}
    assert [tuple(y) for y in by[400]["runs"]] == [(0, 5000, 1)] and by[400]["collapsed"] == "a"
    assert [tuple(y) for y in by[401]["runs"]] == [(0, 6000, 2)] and by[401]["collapsed"] == "a b c"


def test_runs_of_odd_and_empty_tables(spark, odd):
    got = periodic_runs.find_runs(odd.withColumns({"n_words": F.lit("x"), "runs": F.lit("y")}))
    rows = got.collect()
    assert {"n_words_in", "runs_in", "key", "start"} <= {*got.columns} and "text" not in got.columns
    assert len(rows) == odd.count() and all(r["runs_in"] == "y" and r["n_words_in"] == "x" and not r["runs"] for r in rows)
    long = next(r for r in rows if r["doc_id"] == 5)
    assert long["n_words"] == 40000 and len(split(long["collapsed"])) == 40000
    assert periodic_runs.find_runs(odd.limit(0)).collect() == []


def test_op12_matches_brute_force(spark, prose, table, tmp_path):
    rows = [(i, t) for i, t in enumerate(prose(300, words=(0, 80), seed=12))] + [(400, None), (None, "a b " * 9), (401, "")]
    table(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()}
    seen = 0
    for i, text in rows:
        words = split(text)
        h, n = zlib.crc32(str(i).encode()), len(words)
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a, seen = g % n, seen + 1
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs = slow_runs(words)
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None, None, None))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want = (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(slow_collapsed(words, runs)))
        assert tuple(got[i]) == want
    assert seen > 15 and len(got) == len(rows)


def slow_kmeans(rows, k, rounds):
    """clusters by id, with distances, and centroids."""
    vectors = sorted(rows, key=lambda r: (hashlib.sha256(f"3:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in vectors[:k]]
    for done in range(rounds + 1):
        best = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)) for _, v in vectors]
        if done < rounds:
            for j in range(len(centroids)):
                mine = [v for (_, v), b in zip(vectors, best, strict=True) if b[1] == j]
                if mine:
                    centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted((repr(i), j, d) for (i, _), (d, j) in zip(vectors, best, strict=True)), centroids


def vectors_table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_balls_match_brute_force(spark):
    r = np.random.default_rng(4)
    centres = r.normal(size=(9, 6)) * 3
    rows = [(i, [float(x) for x in centres[i % 9] + r.normal(size=6) * (0.3 if i % 4 else 1.5)]) for i in range(700)]
    found = ball_kmeans.cluster(vectors_table(spark, rows).repartition(5), k=6, rounds=7, dim=6, scale=16)
    want, centroids = slow_kmeans([(i, [math.floor(16 * x) for x in v]) for i, v in rows], 6, 7)
    got = found.rows.collect()
    assert sorted((repr(x["id"]), x["cluster"], x["distance"]) for x in got) == want and found.centroids == centroids
    assert found.compared[0] < 0.6 * found.compared[1] and sum(found.members) == 700  # balls spare most comparisons
    for j in range(6):
        own = [x["distance"] for x in got if x["cluster"] == j]
        assert (found.members[j], found.inertia[j], found.radius[j]) == (len(own), sum(own), max(own, default=0))


def test_balls_with_ties_and_odd_rows(spark):
    """Whole numbers near each other give many ties; rows repeat; other vectors are left out."""
    r = random.Random(9)
    rows = [(r.randint(0, 60), [float(r.randint(0, 2)) for _ in range(3)]) for _ in range(200)] + [(None, [1.0, 1.0, 1.0])]
    bad = [(300, None), (301, [1.0, None, 1.0]), (302, [1.0, math.nan, 0.0]), (303, [1.0, math.inf, 0.0]), (304, [1.0]), (305, [])]
    table = vectors_table(spark, rows + bad).withColumns({c: F.lit("x") for c in ("id", "vector", "cluster", "kind", "distance", "sums")})
    for scale in (1, 2):
        found = ball_kmeans.cluster(table.repartition(3), k=8, rounds=10, dim=3, scale=scale)
        want, centroids = slow_kmeans([(i, [math.floor(scale * x) for x in v]) for i, v in rows], 8, 10)
        assert sorted((repr(x["id"]), x["cluster"], x["distance"]) for x in found.rows.collect()) == want and found.centroids == centroids
    few = ball_kmeans.cluster(vectors_table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [9.0, 9.0])]), k=8, dim=2)
    assert len(few.centroids) == 3 and sorted(x["cluster"] for x in few.rows.collect())[0] == 0
    assert ball_kmeans.summary(ball_kmeans.cluster(vectors_table(spark, bad), dim=3)).collect() == []
    with pytest.raises(Exception, match="too large"):
        ball_kmeans.cluster(vectors_table(spark, [(1, [1e30, 0.0])]), dim=2)


@pytest.mark.parametrize("name", ["op11_multiset_hash", "op13_ball_kmeans"])
def test_sql_gives_the_same_rows(spark, name):
    duckdb = pytest.importorskip("duckdb")
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
