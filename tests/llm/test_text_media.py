"""License scans, byte-level BPE, language identification and GIF frames against brute force, other libraries and round trips."""

import random
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.llm import bpe, gif, language, licenses

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


# License scans


def test_phrases_stand_at_every_place(spark, table):
    rows = [(1, "ALL rights reserved. all rights reserved"), (2, "cc-by and CC BY, cc  by"), (3, None), (4, "all rights, ünreserved"), (5, "GNU General Public License é")]
    got = {r["doc_id"]: r for r in licenses.summary(licenses.scan(table(rows))).collect()}
    for i, text in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        places = [(k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        assert got[i]["n_words"] == len(words) and got[i]["n_base"] == len(places)
        assert got[i]["first_word"] == min((k for k, _ in places), default=None) and got[i]["last_word"] == max((k for k, _ in places), default=None)
        assert got[i]["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert 0 <= got[i]["score"] <= 1
    assert got[3]["score"] == 0 and got[3]["labels"] == ""


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Released under the MIT License.", "mit"),
        ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
        ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc"),
        ("Licensed under a Creative Commons Attribution 4.0", "cc-by"),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gpl,gpl-3.0"),
        ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License", "gpl,lgpl"),
        ("Apache License\n Version 2.0, January 2004\n http://www.apache.org/licenses/", "apache-2.0"),
        ("GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007", "agpl,gpl"),
        ("# SPDX-License-Identifier: Apache-2.0", "apache-2.0"),
        ("SPDX-License-Identifier: CC-BY-SA-4.0", "cc-by,cc-by-sa"),
        ("MIT License\n\nCopyright (c) 2020", "mit"),
        ("Boost Software License - Version 1.0 - August 17th, 2003", "bsl-1.0"),
        ("are made available under the terms of the Eclipse Public License v2.0", "epl-2.0"),
        ("are made available under the terms of the Eclipse Public License 2.0 which", "epl-2.0"),
        ("Licensed under the Apache Foundation License 2.0", ""),  # mandatory words differ
        ("the MIT School License", ""),
    ],
)
def test_templates(spark, table, text, labels):
    assert licenses.summary(licenses.scan(table([(1, "x. " + text + " Y")]))).first()["labels"] == labels


def test_markup_regions():
    machine = licenses.Automaton([("a", False, 'grant <<beginOptional>>of <<beginOptional>>all<<endOptional>> rights<<endOptional>> to <<var;name="who";original="x";words="1-2">> now')])
    whole = lambda t: machine.longest(licenses.words_of(t).__getitem__, 0, len(licenses.words_of(t))) != {}
    assert whole("grant to me now") and whole("grant of rights to you two now") and whole("grant of all rights to x now")
    assert not whole("grant to now") and not whole("grant all rights to me now") and not whole("grant to a b c now")
    for bad in ("<<beginOptional>>a<<endOptional>>", "a <<beginOptional>>b", "a <<other>> b"):
        with pytest.raises(ValueError):
            licenses.Automaton([("a", False, bad)])


def every_wording(wording):
    """All word sequences that a template allows, None for a word of any kind."""
    part = re.compile(r"<<(.*?)>>", re.S)

    def read(text):
        """Sequences of a text up to its end or the end of an optional region, and what is left."""
        out = [()]
        while text:
            m = part.search(text)
            words = tuple(licenses.words_of(text[: m.start() if m else len(text)]))
            out, text = [o + words for o in out], text[m.end() :] if m else ""
            if not m:
                break
            if m[1] == "beginOptional":
                inside, text = read(text)
                out = [o + i for o in out for i in ((), *inside)]
            elif m[1] == "endOptional":
                return out, text
            else:
                fields = dict(re.findall(r'(\w+)="([^"]*)"', m[1]))
                if "words" in fields:
                    low, high = map(int, fields["words"].split("-"))
                    ways = [(None,) * k for k in range(low, high + 1)]
                else:
                    ways = [tuple(licenses.words_of(x)) for x in fields["match"].split("|")]
                out = [o + w for o in out for w in ways]
        return out, ""

    return {*read(wording)[0]}


def test_templates_match_all_their_wordings():
    """The machine against every wording of every template, at every place of texts made of them with words changed, lost or put in."""
    every = [(label, w) for label, wordings in licenses.templates().items() for x in wordings for w in every_wording(x)]
    assert len(every) > 3000
    kinds = sorted({label for label, _ in every})
    machine = licenses.Automaton([(label, False, x) for label, wordings in licenses.templates().items() for x in wordings])
    by_first = {}
    for label, w in every:
        by_first.setdefault(w[0], []).append((label, w))
    r = random.Random(8)
    for _ in range(150):
        words = []
        for _ in range(r.randint(1, 3)):
            label = r.choice(kinds)
            words += [w or b"x" for w in r.choice([w for k, w in every if k == label])]
            words += [b"z"] * r.randint(0, 2)
        for _ in range(r.choice((0, 0, 1, 2))):
            i = r.randrange(len(words))
            words[i : i + 1] = r.choice(([], [b"other"], [words[i], words[i]]))
        for i in range(len(words)):
            want = {}
            for label, w in by_first.get(words[i], ()):
                if i + len(w) <= len(words) and all(a is None or a == b for a, b in zip(w, words[i:], strict=False)):
                    want[label] = max(want.get(label, 0), i + len(w))
            got = {machine.kinds[k][0]: end for k, end in machine.longest(words.__getitem__, i, len(words)).items()}
            assert got == want


def test_odd_rows_scan(odd):
    assert licenses.scan(odd).count() == 12 and licenses.scan(odd.limit(0)).count() == 0


# Byte-level BPE


def test_ids_match_the_library_and_decode(spark, table, prose):
    import tiktoken

    r = random.Random(3)
    rare = ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 600), r.randrange(0x3040, 0x9000), r.randrange(0x1F300, 0x1F600)])) for _ in range(50)) for _ in range(40)]
    texts = [*prose(40), *rare, "", None, "a" * 5000, "don't we'll 's", " \n\n x  y", "<|endoftext|>", "ab" * 2000]
    docs = table(list(enumerate(texts)))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    rows = bpe.decode(bpe.encode(docs, RANKS), RANKS).select("doc_id", "ids", "n_tokens", "decoded").collect()
    assert len(rows) == len(texts)
    for row in rows:
        text = texts[row["doc_id"]] or ""
        ids = np.frombuffer(row["ids"], "<u4").tolist()
        assert ids == library.encode_ordinary(text) and row["n_tokens"] == len(ids) and bytes(row["decoded"]) == text.encode()


def test_one_corpus_of_all_words_gives_the_same_ids(odd, table, prose, monkeypatch):
    monkeypatch.setattr(bpe, "_BLOCK", 2000)  # many blocks; long texts have one of their own
    for docs in (odd, table(list(enumerate([*prose(60), "", None, " \n\n x"]))), odd.limit(0)):
        docs = docs.withColumn("ids", F.lit("i"))
        of = lambda df: sorted(((r["doc_id"], bytes(r["ids"]), r["n_tokens"], r["ids_in"]) for r in df.select("doc_id", "ids", "n_tokens", "ids_in").collect()), key=repr)
        one = bpe.encode_by_corpus(docs.repartition(3), RANKS)
        assert "text" not in one.columns and of(one) == of(bpe.encode(docs, RANKS))


def test_odd_rows_encode(odd):
    out = bpe.decode(bpe.encode(odd, RANKS), RANKS)
    assert out.where(F.decode("decoded", "utf-8") != F.coalesce("text", F.lit(""))).count() == 0 and out.count() == 12
    assert bpe.encode(odd.limit(0), RANKS).count() == 0
    clash = odd.withColumns({"ids": F.lit("i"), "Decoded": F.lit("d"), "n_tokens": F.lit("t"), "ids_in": F.lit("j")})
    out = bpe.decode(bpe.encode(clash, RANKS), RANKS)
    assert {"ids", "decoded", "n_tokens", "ids_in_", "ids_in", "Decoded_in", "n_tokens_in"} <= {*out.columns} and len({c.lower() for c in out.columns}) == len(out.columns)
    assert out.where("ids_in_ = 'i' AND ids_in = 'j' AND Decoded_in = 'd' AND n_tokens_in = 't'").count() == 12
    none = bpe.decode(out.select("doc_id", F.lit(None).cast("binary").alias("ids")), RANKS)
    assert none.where("decoded IS NULL").count() == 12


# Language identification


def _tongues(n, seed):
    r = random.Random(seed)
    parts = {"en": ["the", "ing", "tion", "wh", "ough"], "de": ["ung", "ein", "sch", "ü", "keit"], "ru": ["ов", "ист", "пр", "ни", "ж"]}
    text = lambda lang: " ".join("".join(r.choices(parts[lang], k=r.randint(1, 4))) for _ in range(r.randint(5, 40)))
    return [(lang, text(lang)) for lang in r.choices(list(parts), k=n)], text


def test_held_out_accuracy_and_spans(spark, table):
    rows, text = _tongues(300, 4)
    docs = table([(i, t, lang) for i, (lang, t) in enumerate(rows)])
    model = language.fit(docs.where("doc_id % 3 > 0"))
    assert model.languages == ("de", "en", "ru")
    main = language.main_language(F.col("spans"), model.languages)
    got = {r["id"]: r["main"]["lang"] for r in language.label_spans(docs.where("doc_id % 3 = 0"), model).withColumn("main", main).collect()}
    assert sum(got[i] == rows[i][0] for i in got) >= 0.98 * len(got)
    mixed = text("en") + " - " + text("ru")
    spans = language.label_spans(table([(1, mixed)]), model).first()["spans"]
    assert [s["lang"] for s in spans] == ["en", "ru"] and mixed[spans[1]["first"] : spans[1]["last"]] == mixed.split(" - ")[1]


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(1)
    scores, places = -r.random((9, 3)) * 5, np.array([0, 4, 4, 9])
    label = language.viterbi(scores, places, 2.0)
    from itertools import product

    for a, b in ((0, 4), (4, 9)):
        value = lambda path, a=a: sum(scores[a + i, p] for i, p in enumerate(path)) - 2.0 * sum(x != y for x, y in zip(path, path[1:], strict=False))
        assert value(label[a:b].tolist()) == pytest.approx(max(map(value, product(range(3), repeat=b - a))))


def slow_grams(word, buckets):
    """Buckets of a word's pairs and triples of letters, one by one, with nothing before and after it."""
    out, letters = [], [0, *(ord(c.lower() if len(c.lower()) == 1 else c) for c in word), 0, 0]
    for a, b, c in zip(letters, letters[1:], letters[2:]):
        pair = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) % 2**64
        for h in (pair, (pair * 0xD6E8FEB86659FD93 + c * 0xA0761D6478BD642F + 1) % 2**64):
            out.append((((h ^ (h >> 31)) * 0xBF58476D1CE4E5B9 % 2**64) >> 33) % buckets)
    return out


def test_scores_of_words_by_plain_loops(spark, table):
    """Counts, scripts and scores of words, however texts are dealt over blocks."""
    import regex

    texts = [("de", "Der große Hund läuft, 12 Mal."), ("ru", "Большая собака бежит"), ("en", "The big dog ran"), ("en", "a DOG the of"), ("de", "und der die"), ("ru", "и Мир да")] * 3
    rows = [(i, t, lang) for i, (lang, t) in enumerate(texts)]
    buckets = 512
    words_in = lambda t: regex.findall(r"[\p{L}\p{M}]+", t)
    grams = {lang: np.zeros(buckets) for lang in ("de", "en", "ru")}
    letters = {lang: {"latin": 0, "other": 0} for lang in grams}
    for lang, t in texts:
        for w in words_in(t):
            np.add.at(grams[lang], slow_grams(w, buckets), 1)
            letters[lang]["latin" if ord(w[0]) < 0x370 else "other"] += len(w)
    every = sum(grams.values())
    shared = (every + 1) / (every.sum() + buckets)
    for parts in (1, 4):
        model = language.fit(table(rows).repartition(parts), buckets=buckets)
        assert model.languages == ("de", "en", "ru")
        for j, lang in enumerate(model.languages):
            weight = min(grams[lang].sum(), 0.02 * buckets) + 1
            assert np.allclose(model.scores[j], np.log((grams[lang] + weight * shared) / (grams[lang].sum() + weight)), atol=1e-5)
    for chosen in (["Hund the собака"], ["Hund the собака", "x", "läuft"], ["läuft", "Hund the собака"]):  # the same whatever stands beside it
        w = language.words(chosen, buckets)
        got = language.word_scores(w, model, 8.0)
        for i, word in enumerate(x for t in chosen for x in words_in(t)):
            assert w.buckets[w.at[i] : w.at[i + 1]].tolist() == slow_grams(word, buckets)
            want = np.array([model.scores[j][slow_grams(word, buckets)].sum(dtype=np.float64) for j in range(3)])
            want[[j for j, lang in enumerate(model.languages) if letters[lang]["latin" if ord(word[0]) < 0x370 else "other"] <= 0.02 * sum(letters[lang].values())]] = -np.inf
            assert np.allclose(got[i], np.maximum(want - want.max(), -8.0), atol=1e-6)


def test_odd_rows_language(spark, odd):
    model = language.fit(odd)
    main = language.main_language(F.col("spans"), model.languages)
    rows = language.label_spans(odd, model).withColumn("main", main).collect()
    assert len(rows) == 12 and all(r["main"]["lang"] == "und" and r["main"]["share"] == 0 for r in rows if not r["letters"])
    empty = language.fit(odd.limit(0))
    assert empty.languages == () and language.label_spans(odd, empty).where("size(spans) > 0").count() == 0


# GIF frames


@pytest.mark.parametrize("least", [2, 4, 8])
def test_lzw_round_trip(least):
    r = random.Random(least)
    for n in (1, 7, 300, 5000, 70000):
        for samples in (bytes(r.choices(range(1 << least), k=n)), bytes([r.randrange(1 << least)]) * n):
            got, whole = gif.lzw_decode(gif.lzw_encode(samples, least), least, n)
            assert got.tobytes() == samples and whole


def _file(frames, width=4, height=4, interlaced=False):
    """A GIF with four colours; frames: (left, top, w, h, samples, disposal, transparent)."""
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0x81, 0, 0), bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])]
    for left, top, w, h, samples, disposal, transparent in frames:
        stream = gif.lzw_encode(bytes(samples), 2)
        out += [b"\x21\xf9\x04", struct.pack("<BHBB", disposal << 2 | (transparent is not None), 7, transparent or 0, 0)]
        out += [b"\x2c", struct.pack("<HHHHB", left, top, w, h, 0x40 * interlaced), b"\x02", bytes([len(stream)]), stream, b"\0"]
    return b"".join([*out, b"\x3b"])


def test_disposal_and_transparency():
    full = [1] * 16
    size, frames, error = gif.read_gif(_file([(0, 0, 4, 4, full, 1, None), (1, 1, 2, 2, [2] * 4, 3, None), (0, 0, 2, 1, [3, 0], 2, 0), (3, 3, 1, 1, [2], 0, None)]))
    assert size == (4, 4) and error is None and [f["delay_ms"] for f in frames] == [70] * 4
    shown = [np.frombuffer(f["pixels"], np.uint8).reshape(4, 4, -1) for f in frames]
    assert frames[0]["mode"] == "RGB" and (shown[0] == [255, 0, 0]).all()
    assert (shown[1][1:3, 1:3] == [0, 255, 0]).all() and (shown[1][0] == [255, 0, 0]).all()
    assert (shown[2][1:3, 1:3] == [255, 0, 0]).all() and (shown[2][0, 0] == [0, 0, 255]).all() and (shown[2][0, 1] == [255, 0, 0]).all()  # put back; index 0 shows through
    assert frames[3]["mode"] == "RGBA" and (shown[3][0, :2, 3] == 0).all() and (shown[3][3, 3] == [0, 255, 0, 255]).all()  # cleared
    assert frames[0]["histogram"][3 << 4] == 16


def test_interlaced_rows_and_faults():
    samples = [k % 4 for k in range(8) for _ in range(2)]
    _, frames, _ = gif.read_gif(_file([(0, 0, 2, 8, samples, 0, None)], 2, 8, True))
    order = [0, 4, 2, 6, 1, 3, 5, 7]
    colours = [(0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255)]
    got = np.frombuffer(frames[0]["pixels"], np.uint8).reshape(8, 2, 3)
    assert all(tuple(got[row, 0]) == colours[k % 4] for k, row in enumerate(order))
    good = _file([(0, 0, 4, 4, [1] * 16, 0, None)] * 2)
    assert gif.read_gif(b"")[2] == "no GIF" and len(gif.read_gif(good)[1]) == 2
    for cut in range(13, len(good) - 1):
        _, frames, error = gif.read_gif(good[:cut])
        assert error is not None and len(frames) <= 2


def test_payload_round_trip(spark, table, odd):
    texts = ["", None, "a" * 64, "é" * 500, "x" * 200000]
    docs = table([*enumerate(texts)]).withColumn("samples", gif.padded(F.col("text")))
    read = gif.decode(gif.encode(docs, "samples")).withColumn("payload", gif.grey_samples(F.col("frames"), F.col("canvas_width")))
    for r in read.collect():
        raw = (texts[r["doc_id"]] or "").encode()
        assert bytes(r["payload"]) == bytes(r["samples"]) == raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0") and r["error"] is None
    assert gif.decode(odd.select(F.encode("text", "utf-8").alias("media"), "key")).where("error IS NULL").count() == 0
    clash = docs.withColumns({c: F.lit("x") for c in ("media", "Frames", "error", "canvas_width")})
    again = gif.decode(gif.encode(clash, "samples"))
    assert again.where("media_in = 'x' AND Frames_in = 'x' AND error_in = 'x' AND canvas_width_in = 'x' AND error IS NULL").count() == 5
    empty = odd.limit(0).select("key", F.encode("text", "utf-8").alias("samples"))
    assert gif.decode(gif.encode(empty, "samples")).count() == 0


def slow_lzw(stream, least):
    """A plain decoder of a code stream: a dictionary of byte strings, one code at a time."""
    bits = "".join(f"{b:08b}"[::-1] for b in stream)
    clear, end = 1 << least, (1 << least) + 1
    out, at, width, table, before = [], 0, least + 1, {}, None
    while at + width <= len(bits):
        code = int(bits[at : at + width][::-1], 2)
        at += width
        if code == clear:
            table, width, before = {i: bytes([i]) for i in range(clear)}, least + 1, None
            new = end + 1
            continue
        if code == end:
            return b"".join(out), True
        entry = table[code] if code in table else before + before[:1]
        out.append(entry)
        if before is not None and new < 4096:
            table[new] = before + entry[:1]
            new += 1
            if new == 1 << width and width < 12:
                width += 1
        before = entry
    return b"".join(out), False


@pytest.mark.parametrize("least", [2, 5, 8])
def test_streams_match_a_plain_decoder(least):
    """What is written is read by a textbook decoder, and a stream by hand and the published one of four colours are read rightly."""
    r = random.Random(least)
    for n in (1, 50, 3000, 20000):
        samples = bytes(r.choices(range(1 << least), weights=[1 + (i == 1) * 20 for i in range(1 << least)], k=n))
        stream = gif.lzw_encode(samples, least)
        assert slow_lzw(stream, least) == (samples, True) and gif.lzw_decode(stream, least, n)[0].tobytes() == samples
    # Clear, 1, 6 (two of 1, just being made), 6, 2, end: three-bit codes, four after the table has eight entries.
    codes = [(4, 3), (1, 3), (6, 3), (6, 3), (2, 4), (5, 4)]
    bits = "".join(f"{c:0{w}b}"[::-1] for c, w in codes)
    stream = bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
    want = bytes([1, 1, 1, 1, 1, 2])
    assert slow_lzw(stream, 2) == (want, True) and gif.lzw_decode(stream, 2, 6)[0].tobytes() == want
    # Ten by ten pixels of a well-known example file.
    sample = bytes.fromhex("8C2D99872A1CDC33A0027 5EC95FAA8DE608C0491 4C01".replace(" ", ""))
    pixels, whole = slow_lzw(sample, 2)
    assert whole and len(pixels) == 100 and gif.lzw_decode(sample, 2, 100)[0].tobytes() == pixels
