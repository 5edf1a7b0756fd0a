"""Every registered query of the subpackage over the smallest supplied tables, the pipeline against brute force, and the entry module."""

import hashlib
import os
import re
import subprocess
import sys
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_dedup import slow_components, slow_fingerprint
from test_sharding_packing import check_packed, slow_shard
from test_substring_quality import slow_drop

import __spark_entry__
import corpus_pipeline
from riskweave.llm import bpe, licenses, quality, queries

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_all_are_registered():
    names = {*queries.QUERIES, "pipeline"}
    known = __spark_entry__.queries()
    assert names <= {*known} and {int(re.match(r"op(\d+)_", n)[1]) for n in names - {"pipeline"}} == {*range(1, 14)}
    assert "op5_exact_dedup" in __spark_entry__.oracle_sql()


@needs_data
def test_op1(spark, texts):
    rows = queries.op1_license_scans(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[r["doc_id"]]))
        places = [(k, x) for phrase, x in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places)) and r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert {x for _, x in places} <= {*r["labels"].split(",")} and 0 <= r["score"] <= 1
        assert (r["first_word"], r["last_word"]) == (min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))


@needs_data
def test_op2(spark, texts):
    rows, slots = queries.op2_rendezvous_sharding(spark, SF).collect(), defaultdict(list)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert r["shard"] == slow_shard(r["doc_id"], [1.0] * 24) and r["grown_shard"] == slow_shard(r["doc_id"], [1.0] * 25)
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == len(texts) and all(sorted(s) == list(range(len(s))) for s in slots.values())


@needs_data
def test_op3(spark, texts):
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = queries.op3_byte_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = np.array(library.encode_ordinary(texts[r["doc_id"]]), "<u4")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


@needs_data
def test_op4(spark, texts):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op4_language_id(spark, SF).collect()
    assert len(rows) == len(texts) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and lang[r["doc_id"]]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.9 * len(held)


@needs_data
def test_op5(spark):
    duckdb = pytest.importorskip("duckdb")
    got = queries.op5_exact_dedup(spark, SF)
    sql = queries.ORACLE_SQL["op5_exact_dedup"].replace("FROM documents", f"FROM '{SF}/documents.parquet'")
    want = duckdb.sql(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


@needs_data
def test_op6(spark, texts):
    rows = queries.op6_simhash_near_dedup(spark, SF).collect()
    prints = {r["doc_id"]: int(r["fingerprint"], 16) for r in rows}
    assert all(prints[i] == slow_fingerprint(t) for i, t in texts.items() if len(t) < 20000) and all(len(r["fingerprint"]) == 16 for r in rows)
    assert {r["doc_id"]: r["component_id"] for r in rows} == slow_components(prints)


@needs_data
def test_op7(spark, texts):
    rows = queries.op7_gif_frames(spark, SF).collect()
    by_text = defaultdict(set)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        by_text[raw].add(tuple(r)[1:])
    assert len(rows) == len(texts) and all(len(x) == 1 for x in by_text.values())


@needs_data
def test_op8(spark, texts):
    """As registered, against every span of every document."""
    want = slow_drop([*texts.items()])
    rows = queries.op8_substring_dedup(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["text"] or "") == want[r["doc_id"]] and len(texts[r["doc_id"]]) - len(r["text"] or "") == r["chars_removed"]


@needs_data
def test_op9_and_10(spark, texts):
    rows = queries.op9_quality_resampling(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == {*texts} and 0 < sum(r["selected"] for r in rows) <= len(rows)
    bins, least = check_packed(queries.op10_best_fit_packing(spark, SF).collect(), texts, 2048)
    assert bins <= least * 1.05 + 1


@pytest.fixture
def corpus(spark, prose, tmp_path):
    """Documents with copies, near copies, shared passages, junk, toxic words, a null and an empty text; labels for most of them."""
    good = prose(120, words=(40, 90), seed=21)
    passage = prose(1, words=(70, 70), seed=22)[0]
    rows = {i: t for i, t in enumerate(good)}
    rows |= {200 + i: good[i].upper() for i in range(10)}
    rows |= {220 + i: " ".join([*good[20 + i].split(), "Really", "so."]) for i in range(6)}
    rows |= {240 + i: "\n".join([t, passage, u]) for i, (t, u) in enumerate(zip(prose(6, seed=23), prose(6, seed=24), strict=True))}
    rows |= {300 + i: t.replace(" ", " ### %%% ") for i, t in enumerate(prose(40, words=(40, 60), seed=25))}
    rows |= {400 + i: t + " Vileword again, vileword." for i, t in enumerate(prose(30, words=(40, 90), seed=26))}
    rows |= {500: None, 501: ""}
    full = [(i, t, "en", "s", None if t is None else len(t), "kept") for i, t in rows.items()]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, label string").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(not 300 <= i < 400), int(400 <= i < 500)) for i in rows if i % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), rows


def test_pipeline_matches_brute_force(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "label"], name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    chosen = {r["id"] for r in quality.resample(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).where("selected").collect()}
    assert {*kept[0]} == chosen and sum(i < 300 for i in chosen) >= 135 and not any(300 <= i < 400 for i in chosen) and sum(400 <= i < 500 for i in chosen) <= 2
    groups = defaultdict(list)
    for i, t in kept[0].items():
        groups[re.sub("[A-Z]", lambda m: m[0].lower(), t or "")].append(i)
    assert {*kept[1]} == {max(ids) for ids in groups.values()}
    classes = slow_components({i: slow_fingerprint(t) for i, t in kept[1].items()})
    assert {*kept[2]} == {*classes.values()}
    assert kept[3] == {i: t if kept[2][i] is not None else None for i, t in slow_drop([*kept[2].items()]).items()}
    got = corpus_pipeline.run(spark, folder).collect()
    bins, least = check_packed(got, kept[3], 2048)
    assert {r["doc_id"] for r in got} == {*kept[3]} and bins <= least + 1


def test_pipeline_of_empty_and_odd_tables(spark, odd, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, docs, n in (("odd", odd, 6), ("empty", odd.limit(0), 0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == odd.columns, name
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.count() <= n and corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).select("doc_id").distinct().count() == docs.count()


@pytest.mark.parametrize("missing", ["riskweave.llm", "corpus_pipeline", "public_tokenizers"])
def test_entry_without_the_operators(missing):
    """Without the subpackage, the pipeline or what they need, the other queries are there."""
    code = f"import sys; sys.modules['{missing}'] = None; import warnings; warnings.simplefilter('ignore'); import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(n.startswith('op') for n in q) and 'pipeline' not in q; assert {{*e.oracle_sql()}} <= {{*q}}"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
