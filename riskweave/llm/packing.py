"""Best-fit packing of documents into sequences of a fixed number of tokens.

The method is best-two-fit: a sequence is filled greedily, largest piece first; then its smallest piece gives way to two unpacked
pieces that fill the enlarged gap more tightly, as long as that helps. What fits depends on lengths alone, so the plan is made from the
count of pieces of each length (at most one number for each length up to the sequence's, whatever the corpus) and says how often
each combination of lengths occurs. The pieces then take their places in parallel: they are numbered inside each length, and that
number leads to a sequence and an offset.

Token ids are those of the tokenizers library for the text without special tokens added. A special token that stands in the text itself
is one id, as that library has it.

Defined cases: a null text is empty and has the end id alone; very long texts are encoded whole, in a block of their own; a document longer
than a sequence is cut, its first piece being the shorter one; rows that repeat are packed once each; of pieces of one length it is left
open which takes which place; a null id is carried along; an empty table gives no pieces; other columns are not read, whatever their names.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import cut
from riskweave.llm.pretokens import Splitter, blocks, character_classes, flat, gather
from riskweave.llm.sharding import gapless_slots

_BLOCK = 4 << 20
_WORDS_KEPT = 150_000


def byte_ranks(tokenizer_json: str) -> dict[bytes, int]:
    """Ranks of a byte-level BPE tokenizer file. Its merges must be numbered in their order, as rank files have them."""
    with open(tokenizer_json, encoding="utf-8") as f:
        model = json.load(f)["model"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [model["vocab"]["".join(m)] for m in merges]
    if ids != sorted(ids) or model.get("ignore_merges"):
        raise ValueError("the merges are not numbered in order of rank")
    known = {*("".join(m) for m in merges), *byte_of}
    return {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token in known}


class WordEncoder:
    """Token ids of texts by way of their distinct words; words met lately are kept, up to a bound. Words are encoded by tiktoken with the
    file's merges, which is faster on single words than the library that the file is for; texts with special tokens go to that library."""

    def __init__(self, tokenizer_json: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(tokenizer_json, encoding="utf-8") as f:
            described = json.load(f)
        split = json.dumps(described.get("pre_tokenizer"))
        if described.get("normalizer") or '"ByteLevel"' not in split or '"add_prefix_space": true' in split:
            raise ValueError("words can be encoded on their own only with a byte-level split and no normalizer or prefix space")
        self.tokenizer = Tokenizer.from_file(tokenizer_json)
        self.special = [t["content"] for t in described.get("added_tokens", [])]
        self.word = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_ranks(tokenizer_json), special_tokens={}).encode_ordinary
        self.split = Splitter(character_classes())
        self.kept: dict[str, list[int]] = {}

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text begins (one more than texts)."""
        odd = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
        words, codes, places = self.split.words(["" if i in {*odd} else t for i, t in enumerate(texts)] if odd else texts)
        if len(self.kept) > _WORDS_KEPT:
            self.kept.clear()
        lists = []
        for w in words:
            ids = self.kept.get(w)
            if ids is None:
                self.kept[w] = ids = self.word(w)
            lists.append(ids)
        values, at = flat(lists, np.uint32)
        ids, begin = gather(values, at, codes)
        begin = begin[places]
        if odd:  # these go to the library whole
            lists = [ids[a:b] for a, b in zip(begin[:-1], begin[1:], strict=True)]
            for i in odd:
                lists[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
            ids, begin = np.concatenate(lists), np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        return ids, begin


def token_pieces(docs: DataFrame, tokenizer_json: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of the documents' ids: id, piece, start, length, ids_crc32. The file's path must be readable on every executor."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        import pyarrow as pa

        encoder = None
        for part, texts in blocks(batches, 1, _BLOCK):
            encoder = encoder or WordEncoder(tokenizer_json)
            ids, at = encoder.encode(texts.to_pylist())
            rows, piece, start, length, crc = [], [], [], [], []
            end = np.array([end_id], np.uint32)
            for i in range(part.num_rows):
                own = np.concatenate([ids[at[i] : at[i + 1]], end])
                done, k = 0, 0
                while done < len(own):
                    n = (len(own) - done) % size or size
                    rows.append(i)
                    piece.append(k)
                    start.append(done)
                    length.append(n)
                    crc.append(zlib.crc32(own[done : done + n].tobytes()))
                    done, k = done + n, k + 1
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """(how often, lengths of one sequence) until all counts are used up. Each step uses up a length as far as it occurs in the step."""
    left = np.zeros(size + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    steps = []
    every = np.arange(size + 1)

    def below(have: np.ndarray) -> np.ndarray:
        """The largest length that is left and not over each number; 0 for none."""
        return np.maximum.accumulate(np.where(have > 0, every, 0))

    while left.any():
        have = left.copy()
        bin_, gap = [], size
        at_most = below(have)
        while at_most[gap]:
            n = int(at_most[gap])
            fit = min(gap // n, int(have[n]))
            bin_ += [n] * fit
            have[n] -= fit
            gap -= n * fit
            if not have[n]:
                at_most = below(have)
        while gap and len(bin_) > 1:
            s = bin_[-1]
            room = gap + s
            at_most = below(have)
            a = every[1:room][have[1:room] > 0]
            b = at_most[room - a]
            b = np.where((b == a) & (have[a] < 2), at_most[b - 1] * (b > 0), b)
            both = np.where(b > 0, a + b, 0)
            if not len(a) or both.max() <= s:
                break
            k = int(both.argmax())
            x, y = int(a[k]), int(b[k])
            have[s] += 1
            have[x] -= 1
            have[y] -= 1
            bin_ = sorted([*bin_[:-1], x, y], reverse=True)
            gap = room - x - y
        lengths, often = np.unique(bin_, return_counts=True)
        times = int((left[lengths] // often).min())
        left[lengths] -= often * times
        steps.append((times, bin_))
    return steps


def _places(steps: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows (length, first number, count in one sequence, first sequence, offset in it), by length and first number."""
    rows, used, sequence = [], {}, 0
    for times, bin_ in steps:
        offset = 0
        lengths, often = np.unique(bin_, return_counts=True)
        for n, c in zip(lengths[::-1].tolist(), often[::-1].tolist(), strict=True):
            rows.append((n, used.get(n, 0), c, sequence, offset))
            used[n] = used.get(n, 0) + c * times
            offset += n * c
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def place(pieces: DataFrame, size: int = 2048, rows_at_once: int = 1000) -> DataFrame:
    """pieces (id, piece, start, length, ids_crc32) with sequence_id and offset."""
    pieces = cut(pieces)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `size` rows at most
    table = _places(plan(counts, size))
    numbered = gapless_slots(pieces, "length", "number", rows_at_once)

    def run(batches):
        import pyarrow as pa

        keys = table[:, 0] << 48 | table[:, 1]
        for batch in batches:
            n, number = (batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("length", "number"))
            row = table[np.searchsorted(keys, n << 48 | number, side="right") - 1]
            beyond = number - row[:, 1]
            sequence, offset = row[:, 3] + beyond // np.maximum(row[:, 2], 1), row[:, 4] + beyond % np.maximum(row[:, 2], 1) * n
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = dict(pieces.dtypes)["id"]
    return numbered.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_json: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document: id, piece, start, length, ids_crc32, sequence_id, offset."""
    return place(token_pieces(docs, tokenizer_json, size, end_id, id_col, text_col), size).withColumnRenamed("id", id_col)
